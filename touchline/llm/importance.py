"""Importance resampling towards a target: hashed word features with a broadcast head vocabulary."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialise, quoted, shared_dir

#: Buckets of features; words and pairs of the head vocabulary, and bytes of a word in it, which bound what is broadcast.
BUCKETS, HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 10000, 1 << 15, 1 << 17, 32
#: Bytes of text counted at once; occurrences in them from which a feature is proposed for the head.
SLICE, PROPOSED = 4 << 20, 4
#: Words from which a document can be drawn, and how many of a hundred of these are.
LEAST_WORDS, DRAWN = 20, 25

_WORD = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Word bytes in lower case, all others 0.
_LOWER = np.array([(b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD else 0 for b in range(256)], np.uint8)
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


@dataclass
class Words:
    """Words of some texts: place of each in the distinct ones, its text, and whether it repeats the last word of the piece before."""

    code: np.ndarray
    text: np.ndarray
    again: np.ndarray
    distinct: list[bytes]


def words_of(pieces: list[tuple[int, bytes, bool]]) -> Words:
    """Words of pieces (text, bytes, whether the first word repeats)."""
    body = _LOWER[np.frombuffer(b"".join(p[1] for p in pieces), np.uint8)]
    ends = np.cumsum([len(p[1]) for p in pieces])
    on = body != 0
    head = on.copy()
    head[1:] &= ~on[:-1]
    firsts = np.concatenate([[0], ends[:-1]])
    firsts = firsts[firsts < len(on)]
    head[firsts] = on[firsts]
    starts = np.flatnonzero(head)
    data = body[on]
    offsets = np.append((np.cumsum(on) - 1)[starts], len(data)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    piece = np.searchsorted(ends, starts, side="right")
    first = np.ones(len(starts), bool)
    first[1:] = piece[1:] != piece[:-1]
    return Words(coded.indices.to_numpy().astype(np.int64), np.array([p[0] for p in pieces])[piece] if len(starts) else np.empty(0, np.int64), first & np.array([p[2] for p in pieces], bool)[piece], coded.dictionary.to_pylist())


def pieces_of(texts: pa.Array) -> Iterator[list[tuple[int, bytes, bool]]]:
    """Slices of about SLICE bytes; a longer text is cut between words, and a piece begins with the last word before it."""
    out: list[tuple[int, bytes, bool]] = []
    size = 0
    for i, text in enumerate(texts):
        left, lead = text.as_buffer().to_pybytes(), False
        while True:
            cut = _GAP.search(left, SLICE) if len(left) > SLICE else None
            piece = left[: cut.start()] if cut else left
            out.append((i, piece, lead))
            size += len(piece)
            if size >= SLICE:
                yield out
                out, size = [], 0
            if not cut:
                break
            words = [w for w in _GAP.split(piece[-SLICE:]) if w]
            # Of a word as long as the slice the piece itself is searched.
            last = words[-1] if words and len(words[-1]) < SLICE else next((w for w in reversed(_GAP.split(piece)) if w), b"")
            left, lead = last + left[cut.start() :], bool(last)
    if out:
        yield out


def pairs_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of consecutive words (as first * number of words + second), the place of each pair in them, and the second words' places."""
    at = np.flatnonzero((w.text[1:] == w.text[:-1]) & ~(w.again[1:])) + 1
    of, distinct = pd.factorize(w.code[at - 1] * len(w.distinct) + w.code[at])
    return distinct, of, at


@dataclass
class Head:
    """CRC states of frequent words, and buckets of frequent pairs by (place of first word) * HEAD_WORDS + place of second."""

    place: dict[bytes, int]
    state: np.ndarray
    pairs: np.ndarray
    bucket: np.ndarray


def head_of(words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int) -> Head:
    place = {w: i for i, w in enumerate(words)}
    known = sorted((place[a] * HEAD_WORDS + place[b], zlib.crc32(a + b" " + b) % buckets) for a, b in pairs if a in place and b in place)
    return Head(place, np.array([zlib.crc32(w) for w in words], np.int64), np.array([k for k, _ in known], np.int64), np.array([b for _, b in known], np.int64))


def buckets_of(w: Words, head: Head, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word and pair: (text, bucket) of the words, then of the pairs.

    Frequent words have their CRC state, and frequent pairs their bucket, from the head; of the
    others each distinct one of the slice gets its CRC, a pair from the state of its first word on.
    """
    place = np.array([head.place.get(x, -1) for x in w.distinct], np.int64)
    state = np.where(place >= 0, head.state[place] if len(head.state) else 0, 0)
    for i in np.flatnonzero(place < 0):
        state[i] = zlib.crc32(w.distinct[i])
    distinct, of, at = pairs_of(w)
    one, two = distinct // max(1, len(w.distinct)), distinct % max(1, len(w.distinct))
    key = np.where((place[one] >= 0) & (place[two] >= 0), place[one] * HEAD_WORDS + place[two], -1)
    found = np.minimum(np.searchsorted(head.pairs, key), max(0, len(head.pairs) - 1))
    known = head.pairs[found] == key if len(head.pairs) else np.zeros(len(key), bool)
    bucket = np.where(known, head.bucket[found] if len(head.pairs) else 0, 0)
    tail = np.flatnonzero(~known)
    spaced, states = [b" " + x for x in w.distinct], state.tolist()
    bucket[tail] = [zlib.crc32(spaced[b], states[a]) % buckets for a, b in zip(one[tail].tolist(), two[tail].tolist())]
    new = ~w.again
    return w.text[new], (state % buckets)[w.code[new]], w.text[at], bucket[of]


def head_vocabulary(texts: DataFrame, buckets: int) -> Head:
    """The most frequent words and pairs of the texts (body binary), HEAD_WORDS and HEAD_PAIRS at most.

    Proposed are features that are frequent in a slice; which are chosen decides speed alone, never a result.
    """

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pieces in pieces_of(b.column("body")):
                w = words_of(pieces)
                short = np.array([len(x) <= HEAD_BYTES for x in w.distinct], bool)
                n = np.bincount(w.code, minlength=len(w.distinct))
                often = np.flatnonzero((n >= PROPOSED) & short)
                distinct, of, _ = pairs_of(w)
                times = np.bincount(of, minlength=len(distinct))
                one, two = distinct // max(1, len(w.distinct)), distinct % max(1, len(w.distinct))
                pair = np.flatnonzero((times >= PROPOSED) & short[one] & short[two])
                first = [w.distinct[i] for i in often] + [w.distinct[i] for i in one[pair]]
                second = [None] * len(often) + [w.distinct[i] for i in two[pair]]
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array(np.concatenate([n[often], times[pair]]).astype(np.int64))], names=["first", "second", "n"])

    counts = materialise(texts.mapInArrow(proposed, "first binary, second binary, n bigint").groupBy("first", "second").agg(F.sum("n").alias("n")), "head")
    step, pair = F.floor(F.log2("n") * 8), F.col("second").isNotNull()
    sizes = counts.groupBy(pair.alias("pair"), step.alias("step")).agg(F.count("*").alias("n")).collect()

    def top(of_pairs: bool, most: int) -> list:
        """Those above the lowest count that no more than `most` reach; only they come to the driver."""
        left, least = most, None
        for r in sorted((r for r in sizes if r["pair"] == of_pairs), key=lambda r: -r["step"]):
            left -= r["n"]
            if left < 0:
                break
            least = r["step"]
        return [] if least is None else counts.where((pair == of_pairs) & (step >= least)).select("first", "second").collect()

    words = [bytes(r["first"]) for r in top(False, HEAD_WORDS)]
    return head_of(words, [(bytes(r["first"]), bytes(r["second"])) for r in top(True, HEAD_PAIRS)], buckets)


def bodies(df: DataFrame, text_col: str, *more) -> DataFrame:
    return df.select(*more, F.encode(F.coalesce(quoted(text_col), F.lit("")), "UTF-8").alias("body"))


def bucket_totals(texts: DataFrame, head, buckets: int, name: str) -> DataFrame:
    """(bucket, name): features of all texts in each bucket; each task adds up its own first."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for pieces in pieces_of(b.column("body")):
                _, one, _, two = buckets_of(words_of(pieces), head.value, buckets)
                n += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    return texts.mapInArrow(totals, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias(name))


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, seed: int = 7,
    least_words: int = LEAST_WORDS, drawn: int = DRAWN,
) -> DataFrame:
    """Per row: id, n_features, weight, score, and rank among those drawn (null: not drawn).

    Features are words and pairs of consecutive words, counted in buckets of their CRC-32. A bucket's
    gain compares its share of the target's features with that of all rows'; a row's weight is the mean gain of its
    features, and its score adds noise that depends on seed and id alone, so that the highest scores are
    a draw without replacement by weight.

    The head vocabulary, bounded by HEAD_WORDS, HEAD_PAIRS and HEAD_BYTES whatever the table's size, is broadcast: CRC states of frequent words
    and buckets of frequent pairs. Unseen features take their CRC directly; both
    add to the same exact totals. Of these only the buckets reach the driver. Ranks come from a range-partitioned sort and
    the counts of its partitions.

    Null text: no features, weight 0. Null id: hashed as the empty string, after all ids in ties; repeated ids share their noise, repeated rows are rows of their own.
    Ties: the smaller id. Very long texts are counted in pieces. Empty tables: no rows, or gains from the other alone. Other columns, whatever their names, are not carried.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    texts, aims = bodies(docs, text_col), bodies(target, target_col)
    head = spark.sparkContext.broadcast(head_vocabulary(texts, buckets))
    both = bucket_totals(texts, head, buckets, "s").join(bucket_totals(aims, head, buckets, "t"), "bucket", "full").na.fill(0)
    counts = {r["bucket"]: (r["s"], r["t"]) for r in both.collect()}
    s, t = (np.array([counts.get(b, (0, 0))[k] for b in range(buckets)], np.int64) for k in (0, 1))
    ratio = (t + 1).astype(np.float64) * float(s.sum() + buckets) / ((s + 1).astype(np.float64) * float(t.sum() + buckets))
    gain = np.floor(1000 * np.log(ratio)).astype(np.int64)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            n, sums, words = (np.zeros(rows, np.int64) for _ in range(3))
            for pieces in pieces_of(b.column("body")):
                for k, (text, bucket) in enumerate(zip(*[iter(buckets_of(words_of(pieces), head.value, buckets))] * 2)):
                    cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.empty(0, np.int64)
                    if len(cuts):
                        each = np.diff(np.append(cuts, len(text)))
                        n[text[cuts]] += each
                        sums[text[cuts]] += np.add.reduceat(gain[bucket], cuts)
                        words[text[cuts]] += each * (k == 0)
            tie = pa.array([zlib.crc32(x.as_buffer()) for x in b.column("body")], pa.int64())
            columns = [b.column("id"), pa.array(n), pa.array(sums // np.maximum(n, 1)), pa.array(words >= least_words), tie]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_features", "weight", "able", "tie"])

    found = bodies(docs, text_col, quoted(id_col).cast("bigint").alias("id")).mapInArrow(weighed, "id bigint, n_features bigint, weight bigint, able boolean, tie bigint")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(found.withColumn("score", F.col("weight") + noise), "scores")
    k = (scored.agg(F.count_if("able")).first()[0] or 0) * drawn // 100
    # Rows that are alike in all of this can change places, so they are dealt at random by their place in the table.
    keys = [F.desc("able"), F.desc("score"), F.asc_nulls_last("id"), F.col("tie"), F.xxhash64("place")]
    placed = scored.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    in_order = materialise(placed.select("id", "n_features", "weight", "score", "able", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("local")), "ranks")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = in_order.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.col("first") + F.col("local") + 1
    return in_order.join(parts, "part").select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("able") & (place <= k), place).alias("rank"))
