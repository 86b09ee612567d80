"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, cos, log, log1p, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import connected_components, materialise, quoted, shared_dir
from .topk import usable

#: What share of isolated pairs exactly at the threshold the passes must meet, whatever the table's size.
RECALL = 0.999
#: Windows that passes_for() chooses among, and what handing a vector to a pass costs, in comparisons.
WINDOWS, COPY = (64, 128, 256, 512, 1024, 2048, 4096, 8192), 2000
#: Windows are no longer than this part of the table, that small tables are not compared in all pairs either.
PART = 4
#: Bits that a pair must share beyond those that tell n rows apart, for tables that fill the directions unevenly.
SPARE_BITS = 1
#: Random hashes of a pass that are concatenated into its sort key.
BITS = 62
#: Rows of a task's share of a pass, at least; and rows compared at a time.
CHUNK, BLOCK = 4096, 1024
#: Components of unit vectors are handed out as 16-bit integers of this scale.
SCALE = 32767


def unit_rows(vectors: pd.Series | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of length 1 in double precision, shorter ones filled up with zeros."""
    if isinstance(vectors, pd.Series):
        vectors = pa.array(vectors, pa.list_(pa.float64()))
    sizes, values = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        x = values.reshape(len(sizes), width)
    else:
        x = np.zeros((len(sizes), width))
        x[np.arange(width) < sizes[:, None]] = values
    # Scaled first, that the squares of tiny or huge components stay finite.
    x = x / np.abs(x).max(1, initial=0, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For 0..n-1, the least place reachable over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def passes_for(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(window, passes) of the least work that meets a pair at the threshold with probability recall at least.

    A random plane leaves two vectors of angle a on one side with
    probability p = 1 - a / pi. In lexicographic order of the bits, rows that share the first
    k bits stand together, n / 2 ** k of them if these fill the directions evenly, so a pass
    whose window is that wide meets the pair with p ** k, and
    log(1 - recall) / log(1 - p ** k) passes suffice. k is taken SPARE_BITS larger than an even
    table needs. Pairs above the threshold are met more often. The
    condition is that no direction is much more crowded than SPARE_BITS allow: where the rows' mean cosine is 0.7, among 200,000
    rows 0.96 of such pairs are met. A table no longer than the least window is one pass over all pairs.
    """
    p, best = 1.0 - acos(min(1.0, max(-1.0, threshold))) / pi, None
    for window in WINDOWS:
        if window > WINDOWS[0] and window * PART > n:
            break
        k = 0 if n <= window else ceil(log2(n / window)) + SPARE_BITS
        met = p**k
        passes = 1 if met == 1.0 else ceil(log(1.0 - recall) / log1p(-met))
        work = passes * (COPY + min(window, n))
        if best is None or work < best[0]:
            best = work, window, passes
    return best[1], best[2]


def projection_links(nodes: DataFrame, width: int, threshold: float, window: int, passes: int, seed: int) -> DataFrame:
    """Edges (a, b) that join the nodes(id, v) as all pairs at the threshold within a window of any pass do.

    A pass sorts all vectors by the signs of BITS random projections, read as one
    number, and compares each with the `window` before it. Only (pass, number, id) is
    sorted, by range partitioning with ties split by id, so that
    no crowded direction lands in one task; running counts give every row its rank,
    and ranks are cut into shares of equal size, each with the window before it, so that no
    pair is lost at a border. The vectors are joined once to the ranks as 16-bit integers.
    The rounding moves a cosine by a provable bound: pairs above it are linked in
    the task, which gives an edge a row and block at most, pairs closer to the threshold are
    given apart and checked in double precision against the vectors.
    """
    weights = 1 << np.arange(BITS, dtype=np.int64)[::-1]
    band = sqrt(width) / SCALE * 1.001 + width * 2.0**-22
    share = max(CHUNK, window)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [np.random.default_rng((seed, p)).standard_normal((width, BITS)) for p in range(passes)]
        for b in batches:
            x = unit_rows(b.column("v"), width)
            for p in range(passes):
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(np.full(len(x), p, np.int32)), pa.array(((x @ planes[p]) > 0) @ weights)], names=["id", "turn", "bits"]
                )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=["id", "part", "local"])
            at += n

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.rint(unit_rows(b.column("v"), width) * SCALE).astype("<i2")
            data = pa.Array.from_buffers(pa.binary(width * 2), len(x), [None, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("id"), data.cast(pa.binary())], names=["id", "packed"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> Iterator[pa.RecordBatch]:
            g = pa.Table.from_batches(held)
            own, ids, rank = g.column("chunk")[0].as_py(), g.column("id").to_numpy(), g.column("rank").to_numpy()
            x = np.frombuffer(b"".join(g.column("packed").to_pylist()), "<i2").reshape(len(ids), width).astype(np.float32) / np.float32(SCALE)
            first = int(np.searchsorted(rank, own * share))
            for lo in range(first, len(ids), BLOCK):
                hi = min(lo + BLOCK, len(ids))
                before = int(np.searchsorted(rank, rank[lo] - window))
                cosine = x[lo:hi] @ x[before:hi].T
                a, c = np.nonzero(cosine >= threshold - band)
                value = cosine[a, c]
                a += lo - before
                near = (c < a) & (rank[before + a] - rank[before + c] <= window)
                sure, doubt = near & (value >= threshold + band), near & (value < threshold + band)
                label = _least_labels(a[sure], c[sure], hi - before)
                moved = np.flatnonzero(label != np.arange(hi - before))
                of = ids[before:hi]
                one, two = np.concatenate([of[label[moved]], of[a[doubt]]]), np.concatenate([of[moved], of[c[doubt]]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(np.arange(len(one)) < len(moved))], names=["a", "b", "sure"]
                )

        for b in batches:
            if not b.num_rows:
                continue
            chunk = b.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[-1].column("chunk")[0].as_py() != chunk[lo]:
                    yield from found()
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from found()

    codes = nodes.select("id", "v").mapInArrow(hashed, "id bigint, turn int, bits bigint")
    local = materialise(codes.repartitionByRange("turn", "bits", "id").sortWithinPartitions("turn", "bits", "id").mapInArrow(counted, "id bigint, part int, local bigint"), "ranks")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = materialise(local.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "parts")
    ranks = local.join(parts, "part").select("id", (F.col("first") + F.col("local")).alias("rank"))
    vectors = nodes.select("id", "v").mapInArrow(packed, "id bigint, packed binary")
    dealt = ranks.join(vectors, "id").select("id", "rank", "packed", F.explode(F.sequence(F.floor(F.col("rank") / share), F.floor((F.col("rank") + window) / share))).alias("chunk"))
    pairs = materialise(
        dealt.repartition("chunk").sortWithinPartitions("chunk", "rank").mapInArrow(compared, "a bigint, b bigint, sure boolean").groupBy("a", "b").agg(F.bool_or("sure").alias("sure")), "pairs"
    )

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            link = np.einsum("ij,ij->i", unit_rows(b.column("v"), width), unit_rows(b.column("w"), width)) >= threshold
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(link))

    left, right = nodes.select(F.col("id").alias("a"), "v"), nodes.select(F.col("id").alias("b"), F.col("v").alias("w"))
    close = pairs.where("not sure").select("a", "b").join(left, "a").join(right, "b").select("a", "b", "v", "w").mapInArrow(checked, "a bigint, b bigint")
    return pairs.where("sure").select("a", "b").unionByName(close)


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
    recall: float = RECALL, seed: int = 8,
) -> DataFrame:
    """Per row: id, n_links (other rows at cosine >= threshold), component_id (least id reachable) and kept.

    Equal vectors are one node with a number of copies. Components
    are the union of the pairs that projection_links() has verified in any pass; its window and passes
    follow from the number of vectors: a pair at the threshold is missed with probability 1 - recall at most, and in a table
    that fills the directions about evenly. As windows are bounded, links are then counted inside each
    component without regard to which of them the passes met. Members within half the threshold's angle of
    the component's least member are a ball, in which any two
    are linked, so that it is counted and not compared; only members outside are
    compared, in blocks, with all of their component.

    Vectors that are null, zero or hold null or non-finite components,
    and rows of null id, link with nothing and are kept. Rows that share
    an id are one node of the components. Ties: all are linked. Empty table: no rows. Other columns, whatever their names, are not carried.
    """
    shared_dir(vectors.sparkSession)
    v = quoted(vector_col)
    good = F.coalesce(quoted(id_col).isNotNull() & usable(v) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(quoted(id_col).cast("bigint").alias("id"), F.when(good, v).alias("v"))
    nodes = materialise(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "nodes")
    shape = nodes.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n")).first()
    width = shape["w"] or 1
    parts = connected_components(projection_links(nodes, width, threshold, *passes_for(shape["n"], threshold, recall), seed))
    members = materialise(nodes.join(parts.withColumnRenamed("node", "id"), "id"), "members")
    heart = members.where("id = component").groupBy("component").agg(F.min("v").alias("heart"))
    # cos(half of the angle), with room for rounding: any two in the ball are then at the threshold or above.
    half = cos(acos(min(1.0, max(-1.0, threshold))) / 2) + 1e-9

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            inside = np.einsum("ij,ij->i", unit_rows(b["v"], width), unit_rows(b["heart"], width)) >= half
            yield b.drop(columns="heart").assign(inside=inside)

    kind = nodes.schema["v"].dataType.simpleString()
    member_schema = f"id bigint, v {kind}, copies bigint, component bigint"
    placed = materialise(
        members.join(heart, "component").select("id", "v", "copies", "component", "heart").mapInPandas(beside, f"{member_schema}, inside boolean"), "placed"
    )
    sizes = placed.groupBy("component").agg(
        F.sum(F.when(F.col("inside"), F.col("copies")).otherwise(0)).alias("ball"), F.count("*").alias("n"), F.count_if(~F.col("inside")).alias("outside")
    )
    sizes = materialise(sizes, "sizes")
    rough = sizes.where("outside > 0").select("component", F.ceil(F.col("outside") / BLOCK).cast("int").alias("ob"), F.ceil(F.col("n") / BLOCK).cast("int").alias("mb"))
    dealt = placed.join(rough, "component")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = dealt.where("not inside").withColumn("o", block("ob")).withColumn("m", each("mb")).drop("ob", "mb")
    inner = dealt.withColumn("m", block("mb")).withColumn("o", each("ob")).drop("ob", "mb")
    inner = inner.select(*[F.col(c).alias(f"other_{c}") for c in inner.columns])

    def count(o: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(o) or not len(m):
            return pd.DataFrame({"id": [], "more": []}).astype("int64")
        o_ids, m_ids = o["id"].to_numpy(), m["other_id"].to_numpy()
        near = (unit_rows(o["v"], width) @ unit_rows(m["other_v"], width).T >= threshold) & (o_ids[:, None] != m_ids[None, :])
        ball = m["other_inside"].to_numpy(bool)
        return pd.DataFrame({
            "id": np.concatenate([o_ids, m_ids[ball]]),
            "more": np.concatenate([near @ m["other_copies"].to_numpy(), near[:, ball].T @ o["copies"].to_numpy()]).astype(np.int64),
        })

    keys = ["component", "o", "m"]
    more = outer.groupBy(*keys).cogroup(inner.groupBy(*[f"other_{k}" for k in keys])).applyInPandas(count, "id bigint, more bigint").groupBy("id").agg(F.sum("more").alias("more"))
    linked = (
        placed.join(sizes.select("component", "ball"), "component").join(more, "id", "left")
        .select("id", "component", (F.when(F.col("inside"), F.col("ball") - F.col("copies")).otherwise(0) + F.coalesce("more", F.lit(0))).alias("others"))
    )
    of_vector = nodes.join(linked, "id", "left").select(
        "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    out = rows.join(materialise(of_vector, "linked"), "v", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(quoted(id_col) == F.col("component_id"), F.lit(True)))
