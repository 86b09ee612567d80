"""SimHash near-duplicates: byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, materialise, quoted, shared_dir

#: Shingles hashed at a time, that a very long text needs no more memory.
BLOCK = 1 << 16
#: Fingerprints of a list up to which each two of it are tallied; longer lists go by places of one turned bit.
PAIRED = 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included; 0 without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        tokens, words = [b" ".join(tokens)], 1
    n = len(tokens) - words + 1
    counts = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, BLOCK):
        part = tokens[at : min(at + BLOCK, n) + words - 1]
        h = np.array([digest(join(s), seed) for s in zip(*(part[i:] for i in range(words)))], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), words, seed) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(f.view(np.int64))], names=["id", "fp"])

    shared_dir(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def shared_bytes(a: Column, b: Column) -> Column:
    """Number of the eight byte positions in which two fingerprints agree."""
    x = a.bitwiseXOR(b)
    tally = F.lit(0)
    for i in range(8):
        tally = tally + F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0)
    return tally


def postings(nodes: DataFrame) -> DataFrame:
    """The index: (list, free, fp), a row for each fingerprint and each choice of two of the four pairs of neighbouring byte positions.

    list is the bytes at the chosen positions, the others zero; free is a mask of the other positions.
    """
    fp, kept = F.col("fp"), []
    for chosen in combinations(range(4), 2):
        mask = sum(0xFFFF << 16 * i for i in chosen)
        own = F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")
        kept.append(F.struct(fp.bitwiseAND(own).alias("list"), F.lit(sum(3 << 2 * i for i in range(4) if i not in chosen)).alias("free")))
    return nodes.select(fp, F.explode(F.array(*kept)).alias("p")).select("p.list", "p.free", "fp")


def links(nodes: DataFrame, max_bits: int = 2, paired: int = PAIRED) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints from nodes(fp) that link all at most max_bits apart, and no others.

    Two bits lie in two bytes at most, so that a pair agrees in at least 6 of
    the 8 byte positions and in two of their four pairs whole. A list of one
    position holds one in 256 of all fingerprints and would pair their square; a list
    of two pairs of positions holds one in 2**32 of evenly spread ones. Within a list of
    at most paired fingerprints the shared positions of each two are tallied, those with
    fewer than 6 are left out before they become rows, and the bits of the others are compared.

    A longer list is not paired. Its members may differ from a partner in
    the other positions only, and there each is listed again with every single bit
    turned: two differ in two bits or fewer exactly if they meet at a place,
    and all who meet at one are within two bits, so that they are linked to the least of
    the 65 at most. So a list of any length costs a multiple of its length, and every link
    is a pair of the result or a path of two. Tally and bits of these pairs are checked as well.
    """
    if max_bits != 2:
        raise ValueError("places of one turned bit are exact for two bits only")
    fp, a, b, m = F.col("fp"), F.col("a"), F.col("b"), F.col("m")
    close = lambda x, y: (shared_bytes(x, y) >= 8 - max_bits) & (F.bit_count(x.bitwiseXOR(y)) <= max_bits)
    listed = postings(nodes)
    # Lists are counted before any is gathered, so that none longer than paired ever is.
    counts = materialise(listed.groupBy("list", "free").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    met = listed.join(counts, ["list", "free"])
    short = met.where(F.col("n") <= paired).groupBy("list", "free").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    first = short.select("m", F.posexplode("m").alias("i", "a"))
    pairs = first.select("a", F.explode(F.filter(F.slice(m, F.col("i") + 2, paired), lambda y: close(a, y))).alias("b"))
    bit = lambda i: F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")
    members = met.where(F.col("n") > paired).groupBy("fp").agg(F.bit_or("free").alias("free"))
    turned = [F.when(F.col("free").bitwiseAND(F.lit(1 << i // 8)) != 0, fp.bitwiseXOR(bit(i))) for i in range(64)]
    places = members.select(fp, F.explode(F.array_compact(F.array(fp, *turned))).alias("place"))
    there = places.groupBy("place").agg(F.sort_array(F.collect_list("fp")).alias("m")).where(F.size("m") > 1)
    stars = there.select(m[0].alias("a"), F.explode(F.slice("m", 2, 64)).alias("b")).where(close(a, b))
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, max_bits: int = 2
) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the least id reachable over links.

    Rows with equal fingerprints are one node (exact copies cost one
    aggregated row); links() joins the nodes and connected_components()
    the links. Null, empty and blank texts: fingerprint zero, linked like
    any other. Very long texts are hashed in blocks. Ties and repeated rows: kept, alike. Null ids: kept, and no
    component is named after them. Empty table: no rows. Other columns, whatever their names, are not carried.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    parts = connected_components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    rooted = materialise(rooted.select("fp", "root", "least"), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(materialise(named, "components"), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without the near-duplicates: of each component the rows of the least id stay, and all rows whose id is null.

    Texts are joined with the ids that go, which are few where duplicates are:
    a table of known size that is broadcast only while it is small. An id
    that is the least of one component stays with all of its rows. Null, empty
    and long texts, ties, repeated rows and empty tables: as near_duplicates() has them. All columns are carried, whatever their names.
    """
    found = near_duplicates(docs.select(quoted(id_col), quoted(how.get("text_col", "text"))), id_col=id_col, **how)
    ids = found.select(quoted(id_col).alias("gone"), (quoted(id_col) == F.col("component_id")).alias("stays")).where("gone is not null")
    gone = materialise(ids.groupBy("gone").agg(F.bool_or("stays").alias("stays")).where("not stays").select("gone"), "gone")
    names = docs.columns
    apart = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = F.col(f"c{names.index(id_col)}")
    return apart.join(gone, own == F.col("gone"), "left_anti").toDF(*names)
