"""Hard-negative mining with score bounds from angles to reference directions."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialise, quoted, shared_dir
from .topk import best_of, matrix, usable

#: Reference directions (vectors of least hash, a bounded sample that decides speed alone), and rows of a window of the index.
REFERENCES, WINDOW = 32, 128
#: Rows of an index block, of a share of the index and of a group of anchors at most; anchors together; least number of shares.
CANDIDATES, SHARE, ANCHORS, TOGETHER, LEAST_SHARES = 4096, 65536, 16384, 1024, 24
#: Positives of an anchor, negatives of a positive, and the least and greatest score of a negative in hundredths of the positive's.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95

INDEX = "share int, block int, ids binary, labels binary, norms binary, angles binary, whole boolean, values binary"
_MAX = 2**63 - 1


def unit(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as directions in double precision, and their lengths (scaled first, that squares stay finite)."""
    x = c.astype(np.float64)
    top = np.abs(x).max(1, initial=0)
    y = x / np.where(top > 0, top, 1)[:, None]
    size = np.sqrt((y * y).sum(1))
    return y / np.where(size > 0, size, 1)[:, None], size * top


def angles_to(directions: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions @ references.T, -1.0, 1.0))


def slack(width: int) -> float:
    """More than an angle can be off: arccos moves by 2.23 * sqrt(d) at most where its argument moves by d."""
    return 2.23 * ((width + 8) * 2.0**-51) ** 0.5


class Block:
    """A block of the index in windows of WINDOW rows, each with its range of labels, norms and angles."""

    def __init__(self, row: dict, width: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        n = len(self.ids)
        values = row["values"]
        self.c = np.frombuffer(values, np.int64).reshape(n, width) if row["whole"] else np.array([int(v) for v in bytes(values).decode().split(",")] if width else [], object).reshape(n, width)
        norms, angles = np.frombuffer(row["norms"]), np.frombuffer(row["angles"]).reshape(n, -1)
        cuts = np.arange(0, n, WINDOW)
        self.cuts = np.append(cuts, n)
        at = lambda f, x: f.reduceat(x, cuts, axis=0)
        self.label = at(np.minimum, self.labels), at(np.maximum, self.labels)
        self.norm = at(np.minimum, norms), at(np.maximum, norms)
        self.angle = at(np.minimum, angles), at(np.maximum, angles)

    def bounds(self, angles: np.ndarray, norms: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of every score of each anchor in each window.

        Two angles to a reference differ by no more than the angle between the vectors, which is no more than their
        sum, nor than what is left of the circle. The cosines at both ends, times the
        norms that make them widest, bound the scores; both are moved out by more than rounding can amount to.
        """
        off = 4 * slack(width)
        near, far = np.zeros((len(angles), len(self.cuts) - 1)), np.full((len(angles), len(self.cuts) - 1), np.pi)
        for r in range(angles.shape[1]):
            a, lo, hi = angles[:, r : r + 1], self.angle[0][None, :, r], self.angle[1][None, :, r]
            near = np.maximum(near, np.maximum(a - hi, lo - a))
            # The sum falls and rises by turns: beyond pi the way round the other side is shorter.
            far = np.minimum(far, np.where((a + lo <= np.pi) & (a + hi >= np.pi), np.pi, np.maximum(np.where(a + lo > np.pi, 2 * np.pi - a - lo, 0), np.where(a + hi < np.pi, a + hi, 0))))
        top, low = np.cos(np.clip(near - off, 0, np.pi)), np.cos(np.clip(far + off, 0, np.pi))
        few, many = self.norm[0][None, :], self.norm[1][None, :]
        with np.errstate(over="ignore", invalid="ignore"):
            upper = norms[:, None] * np.where(top >= 0, many, few) * top
            lower = norms[:, None] * np.where(low >= 0, few, many) * low
            room = 1.0 + norms[:, None] * many * 1e-9
            return lower - room, upper + room

    def scores(self, q: np.ndarray, part: slice) -> np.ndarray:
        """Integer inner products, held at the bounds of a long."""
        c = self.c[part]
        if q.dtype != object and c.dtype != object:
            most = float(np.abs(q).sum(1, dtype=np.float64).max(initial=0)) * float(np.abs(c).max(initial=0))
            if most < 2**53:
                return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
            if most < 2**62:
                return q @ c.T
        exact = q.astype(object) @ c.T.astype(object)
        return np.array([[min(max(int(v), -_MAX - 1), _MAX) for v in row] for row in exact], np.int64).reshape(exact.shape)


def index_row(share: int, block: int, ids: np.ndarray, labels: np.ndarray, c: np.ndarray, references: np.ndarray) -> tuple:
    """The block in the order of label, nearest reference and angle to it, so that windows are narrow."""
    directions, norms = unit(c)
    angles = angles_to(directions, references)
    nearest = angles.argmin(1)
    order = np.lexsort((ids, angles[np.arange(len(ids)), nearest], nearest, labels))
    whole = c.dtype != object
    values = c[order].astype(np.int64).tobytes() if whole else ",".join(str(int(v)) for v in c[order].ravel()).encode()
    return share, block, ids[order].tobytes(), labels[order].tobytes(), norms[order].tobytes(), angles[order].tobytes(), whole, values


def merged(held: list[np.ndarray], at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best (place, id, score) of each place, of those held and new ones."""
    at, ids, score = (np.concatenate(x) for x in zip(held, (at, ids, score)))
    at, keep, score = best_of(at, np.arange(len(at)), score, ids, k)
    return [at, ids[keep], score]


def bars(held: list[np.ndarray], n: int, k: int) -> np.ndarray:
    """Score of the k-th best of each place, or -inf; a double just below."""
    bar = np.full(n, -np.inf)
    full = np.flatnonzero(np.bincount(held[0], minlength=n) == k)
    last = np.searchsorted(held[0], full, side="right") - 1
    bar[full] = np.nextafter(held[2][last].astype(np.float64), -np.inf)
    return bar


def positives_in(blocks: list[Block], ids: np.ndarray, labels: np.ndarray, q: np.ndarray, angles: np.ndarray, norms: np.ndarray, k: int) -> list[np.ndarray]:
    """(anchor's place, id, score) of each anchor's k best rows of its own label; windows below the bar get no scoring."""
    held = [np.empty(0, np.int64)] * 3
    for b in blocks:
        _, upper = b.bounds(angles, norms, q.shape[1])
        for w, (lo, hi) in enumerate(zip(b.cuts[:-1], b.cuts[1:])):
            ask = np.flatnonzero((b.label[0][w] <= labels) & (labels <= b.label[1][w]) & ~(upper[:, w] < bars(held, len(ids), k)))
            if not len(ask):
                continue
            part = slice(lo, hi)
            score = b.scores(q[ask], part)
            a, c = np.nonzero((labels[ask, None] == b.labels[None, part]) & (ids[ask, None] != b.ids[None, part]))
            held = merged(held, ask[a], b.ids[part][c], score[a, c], k)
    return held


def negatives_in(blocks: list[Block], of: np.ndarray, least: np.ndarray, most: np.ndarray, labels: np.ndarray, q: np.ndarray, angles: np.ndarray, norms: np.ndarray, k: int) -> list[np.ndarray]:
    """(row's place, id, score) of the k best rows of another label whose score is from least to most, for each row (an anchor's place, bounds)."""
    held = [np.empty(0, np.int64)] * 3
    for b in blocks:
        lower, upper = b.bounds(angles, norms, q.shape[1])
        for w, (lo, hi) in enumerate(zip(b.cuts[:-1], b.cuts[1:])):
            other = ~((b.label[0][w] == labels) & (b.label[1][w] == labels))
            bar = np.maximum(least.astype(np.float64) * (1 - 2.0**-50 * np.sign(least)), bars(held, len(of), k))
            ask = np.flatnonzero(other[of] & ~(upper[of, w] < bar) & ~(lower[of, w] > most.astype(np.float64) * (1 + 2.0**-50 * np.sign(most))))
            if not len(ask):
                continue
            part = slice(lo, hi)
            anchors, row = np.unique(of[ask], return_inverse=True)
            score = b.scores(q[anchors], part)[row]
            a, c = np.nonzero((labels[of[ask], None] != b.labels[None, part]) & (score >= least[ask, None]) & (score <= most[ask, None]))
            if len(a):
                a, c, score = best_of(a, c, score[a, c], b.ids[part][c], k)
                held = merged(held, ask[a], b.ids[part][c], score, k)
    return held


def mine(
    vectors: DataFrame, label: Column, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's best rows of
    its label the best rows of other labels whose score is from least to most hundredths of it.

    Scores are integer inner products of floor(256 * x), ties go to the smaller id. The index is a written table of blocks that hold each
    vector's angles to the reference directions. In a task, each window of a block gets an interval of scores for
    each anchor; only windows that reach the anchor's bar (positives) or overlap its wanted
    scores and reach its bar (negatives) are scored, in integers. Blocks are dealt in shares and anchors in
    groups as in top_k(), so that neither table is broadcast and no label is a group of its own; the
    work that bounds leave grows with anchors times rows.

    Rows whose label, id or vector is null, or whose vector holds null or non-finite components, take no part; shorter
    vectors count as filled up with zeros. An anchor id that repeats asks with its least (label, vector); a row of the anchor's own id is
    never its positive. Repeated rows are candidates each. Fewer rows than asked for: all. Scores beyond a long are held at its bounds. Empty table: no rows. Other columns, whatever their names, are not carried.
    """
    shared_dir(vectors.sparkSession)
    asked = vectors.select(quoted(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), quoted(vector_col).alias("v"), is_anchor.alias("asks"))
    rows = materialise(asked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))), "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if("asks").alias("q")).first()
    width = facts["width"] or 0
    shares, groups = max(LEAST_SHARES, ceil(facts["n"] / SHARE)), max(1, ceil(facts["q"] / ANCHORS))
    blocks = shares * max(1, ceil(facts["n"] / shares / CANDIDATES))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(REFERENCES).select("v").toPandas()["v"]
    references = unit(matrix(sample, width))[0]

    def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        row = index_row(key[0] % shares, key[0], g["id"].to_numpy(), g["label"].to_numpy(), matrix(g["v"], width), references)
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    # By place in the written table and not by id, which rows may share.
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    index = materialise(rows.select("id", "label", "v", spread.alias("b")).groupBy("b").applyInPandas(build, INDEX), "index")
    index = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    anchors = rows.where("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")

    def dealt(asks: DataFrame) -> DataFrame:
        return asks.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def together(q: pd.DataFrame, c: pd.DataFrame) -> Iterator[tuple]:
        parts = [Block(r, width) for r in c.to_dict("records")] if len(q) else []
        for lo in range(0, len(q) if parts else 0, TOGETHER):
            part = q.iloc[lo : lo + TOGETHER]
            ints = matrix(part["v"], width)
            directions, norms = unit(ints)
            yield part, parts, ints, angles_to(directions, references), norms

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": [], "id": [], "score": []}).astype("int64")]
        for part, parts, ints, angles, norms in together(q, c):
            ids = part["id"].to_numpy()
            at, found, score = positives_in(parts, ids, part["label"].to_numpy(), ints, angles, norms, positives)
            out.append(pd.DataFrame({"anchor": ids[at], "id": found, "score": score}))
        return pd.concat(out)

    def hard(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": [], "positive_score": [], "id": [], "score": []}).astype("int64")]
        for part, parts, ints, angles, norms in together(q, c):
            ids, scores = part["id"].to_numpy(), [np.unique(np.asarray(s, np.int64)) for s in part["scores"]]
            of, of_score = np.repeat(np.arange(len(part)), [len(s) for s in scores]), np.concatenate(scores)
            # Exact bounds of the integer score: least * p <= 100 * n <= most * p.
            lo = np.array([-(-least * p // 100) for p in of_score.tolist()], np.int64)
            hi = np.array([most * p // 100 for p in of_score.tolist()], np.int64)
            at, found, score = negatives_in(parts, of, lo, hi, part["label"].to_numpy(), ints, angles, norms, negatives)
            out.append(pd.DataFrame({"anchor": ids[of[at]], "positive_score": of_score[at], "id": found, "score": score}))
        return pd.concat(out)

    def cogrouped(asks: DataFrame, f, schema: str) -> DataFrame:
        return dealt(asks).groupBy("share", "group").cogroup(index.groupBy("share", "group")).applyInPandas(f, schema)

    def first(df: DataFrame, k: int, *by: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))
        return df.withColumn("rank", rank).where(F.col("rank") <= k)

    near = materialise(first(cogrouped(anchors, best, "anchor bigint, id bigint, score bigint"), positives, "anchor"), "positives")
    wanted = near.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("scores"))
    found = first(cogrouped(anchors.join(wanted, "id"), hard, "anchor bigint, positive_score bigint, id bigint, score bigint"), negatives, "anchor", "positive_score")
    near = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(found, ["anchor", "positive_score"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
