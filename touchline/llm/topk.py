"""Exact top-k inner products over an impact-ordered score-at-a-time index."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialise, quoted, shared_dir

#: Bits of one digit of an impact: a posting segment holds a digit of a block's impacts.
DIGIT = 3
#: Possible members that are rescored rather than told apart by another segment, as a part of all pairs.
FEW = 1 / 64
#: Rows of an index block; of a share of the index (a group of blocks) and of the queries (a group's) at most; queries processed together; least number of shares.
CANDIDATES, SHARE, QUERIES, TOGETHER, LEAST_SHARES = 4096, 65536, 16384, 1024, 24

INDEX = "share int, block int, place int, weight double, ids binary, least array<string>, segment binary"


def usable(vector: Column) -> Column:
    """Not null, and all components finite and not null."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of floor(256 * x) as integers, shorter ones filled up with 0; exact Python integers where int64 is too small."""
    x = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    if np.abs(x).max(initial=0) < 2**52:
        return np.floor(x * 256.0).astype(np.int64)
    # From 2 ** 52 on a double is an integer, so that the factor is exact.
    return np.array([[int(v) * 256 if abs(v) >= 2**52 else int(np.floor(v * 256.0)) for v in row] for row in x], object).reshape(x.shape)


def index_rows(share: int, block: int, ids: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    """The block's part of the index: its posting segments by falling impact (place from 0), the first with the block's ids and least values.

    Each component is a posting of its dimension, its impact the excess over the
    dimension's least, so that no impact is negative. Impacts are
    quantised to digits; a segment is the postings' digits of one weight. As a
    vector has a posting in each dimension, a segment is dense: digits by vector, then dimension.
    """
    least = c.min(0)
    excess = c - least
    digits = max(1, -(-int(excess.max(initial=0)).bit_length() // DIGIT))
    rows = []
    for place, d in enumerate(range(digits - 1, -1, -1)):
        segment = ((excess >> (DIGIT * d)) & ((1 << DIGIT) - 1)).astype(np.uint8)
        head = place == 0
        rows.append((share, block, place, float(1 << DIGIT * d), ids.tobytes() if head else None, [str(int(v)) for v in least] if head else None, segment.tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])


class Block:
    """A block of the index, read segment by segment."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("place")
        self.ids = np.frombuffer(rows["ids"].iloc[0], np.int64)
        self.least = [int(v) for v in rows["least"].iloc[0]]
        self.segments = [(w, np.frombuffer(s, np.uint8).reshape(len(self.ids), len(self.least))) for w, s in zip(rows["weight"], rows["segment"])]
        self.largest = max((abs(v) for v in self.least), default=0) + int(self.segments[0][0]) * (1 << DIGIT)

    def exact(self, at: np.ndarray, kind: type) -> np.ndarray:
        """The vectors at these places."""
        out = np.array(self.least, kind) + np.zeros((len(at), 1), kind)
        for d, (_, segment) in enumerate(reversed(self.segments)):
            out = out + (segment[at].astype(kind) << (DIGIT * d))
        return out


def block_top(q_ids: np.ndarray, q: np.ndarray, block: Block, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's place, score) of each query's k best candidates of the block that reach its bar, its own id left out.

    Segments are processed by falling impact for all queries, into one
    accumulator a pair; after each, what is left of an impact is at most
    weight - 1, which bounds every score from both sides. A
    candidate whose upper bound is below k lower bounds, or below the bar that earlier blocks have set, is out, by proof.
    The others are possible members; processing stops when they are few
    or no segment is left, and all of them are scored exactly, in integers.
    """
    own = q_ids[:, None] == block.ids[None, :]
    floats = q.astype(np.float64)
    size = np.abs(floats).sum(1)
    # Sums below 2 ** 52 are exact; this is more than any others can be off.
    off = (size * float(block.largest) * 2.0**-44)[:, None]
    kind = np.float32 if float(size.max(initial=0)) * (1 << DIGIT) < 2**24 else np.float64
    above, below = np.maximum(floats, 0).sum(1)[:, None], np.minimum(floats, 0).sum(1)[:, None]
    known = np.repeat((floats @ np.array(block.least, np.float64))[:, None], len(block.ids), 1)
    narrow = floats.astype(kind)
    for weight, segment in block.segments:
        known += (narrow @ segment.astype(kind).T).astype(np.float64) * weight
        slack = weight - 1.0
        lower = np.where(own, -np.inf, known + slack * below - off)
        reach = np.partition(lower, -k, axis=1)[:, -k] if len(block.ids) > k else np.full(len(q), -np.inf)
        # Scores are held at the bounds of a long before they are compared.
        wanted = np.minimum(np.maximum(reach, bar), 2.0**63 * (1 - 2.0**-52))
        possible = ~own & (np.maximum(known + slack * above + off, -(2.0**63)) >= wanted[:, None])
        if possible.sum() <= max(k * len(q), FEW * possible.size):
            break
    at, to = np.nonzero(possible)
    whole = np.int64 if float(size.max(initial=0)) * block.largest < 2**62 else object
    exact = np.empty(len(at), whole)
    for lo in range(0, len(at), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        exact[part] = (q[at[part]].astype(whole) * block.exact(to[part], whole)).sum(1)
    exact = np.array([min(max(int(v), -(2**63)), 2**63 - 1) for v in exact], np.int64) if whole is object else exact
    return best_of(at, to, exact, block.ids[to], k)


def best_of(at: np.ndarray, to: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query's place, ties to the smaller id."""
    order = np.lexsort((ids, ~score, at))  # ~score falls as score grows, and does not overflow
    at, to, score = at[order], to[order], score[order]
    best = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[best], to[best], score[best]


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best inner products of floor(256 * x) with each query, ties to the smaller id.

    The index is a written table: every vector in one of its blocks, a row for
    each posting segment. Blocks are dealt in shares, queries in groups; each pair of
    share and group is one task of bounded size, so that neither table is
    broadcast. A task reads its blocks' segments by falling impact,
    carries each query's bar from block to block and gives k rows for each query.
    In dense vectors no posting list is short, so that every pair has an accumulator:
    the work is queries times candidates, with the segments that proof needs.

    Rows whose vector is null or holds null or non-finite components, or whose id is null,
    take no part; shorter vectors count as filled up with zeros. A query id that repeats
    asks with its least vector; a row of the query's own id is never its
    answer. Repeated rows are candidates each. Scores beyond a long are held at its bounds. Fewer than k candidates: all.
    Empty table: no rows. Other columns, whatever their names, are not carried.
    """
    shared_dir(vectors.sparkSession)
    asks = vectors.select(quoted(id_col).cast("bigint").alias("id"), quoted(vector_col).alias("v"), is_query.alias("asks"))
    rows = materialise(asks.where(F.col("id").isNotNull() & usable(F.col("v"))), "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if("asks").alias("q")).first()
    width = facts["width"] or 0
    shares, groups = max(LEAST_SHARES, ceil(facts["n"] / SHARE)), max(1, ceil(facts["q"] / QUERIES))
    blocks = ceil(facts["n"] / shares / CANDIDATES)
    # By place in the written table and not by id, which rows may share.
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares * max(1, blocks))).cast("int")

    def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return index_rows(key[0] % shares, key[0], g["id"].to_numpy(), matrix(g["v"], width))

    index = materialise(rows.select("id", "v", spread.alias("b")).groupBy("b").applyInPandas(build, INDEX), "index")
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    queries = asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    segments = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")
        parts = [Block(rows) for _, rows in c.groupby("block")]
        out = []
        for lo in range(0, len(q), TOGETHER):
            part = q.iloc[lo : lo + TOGETHER]
            q_ids, values = part["id"].to_numpy(), matrix(part["v"], width)
            at, ids, found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            bar = np.full(len(part), -np.inf)
            for block in parts:
                more_at, to, more = block_top(q_ids, values, block, k, bar)
                at, ids, found = np.concatenate([at, more_at]), np.concatenate([ids, block.ids[to]]), np.concatenate([found, more])
                at, keep, found = best_of(at, np.arange(len(at)), found, ids, k)
                ids = ids[keep]
                full = np.flatnonzero(np.bincount(at, minlength=len(part)) == k)
                # A double just below the k-th score.
                bar[full] = np.nextafter(np.array([found[np.searchsorted(at, f, side="right") - 1] for f in full], np.float64), -np.inf)
            out.append(pd.DataFrame({"query_id": q_ids[at], "id": ids, "score": found}))
        return pd.concat(out)

    best = queries.groupBy("share", "group").cogroup(segments.groupBy("share", "group")).applyInPandas(score, "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
