"""K-d tree partitioning of documents into shards of near equal bytes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import drop_path, materialise, quoted, seeded_hash, stored, unit

#: Bins of one histogram pass, and sums that the driver gets at most in one: with many open nodes the bins are fewer and the passes more.
BINS, LEAST_BINS, SUMS = 2048, 16, 1 << 20
#: A cut may miss its share of a node's bytes by this part of them before a bin is searched more finely.
TOLERANCE = 0.001
#: ... and by this part of one shard before a group of equal texts is cut through.
GROUP_TOLERANCE = 0.012
#: Places in the order of rows of equal texts: a hash of the id, then of the row.
ORDER = 1 << 62
#: Groups of equal texts above this part of a shard are told apart; there are at most shards / HEAVY of them.
HEAVY = 0.02


@dataclass
class Node:
    """A node of the tree: how many leaves it is for, the first of them, and its bytes."""

    leaves: int
    first: int
    bytes: int = 0


def _key(dim: int) -> Column:
    """Order along a dimension; equal values by checksum, so that equal texts stay together."""
    return F.shiftleft(F.col(f"d{dim}"), 32) + F.col("crc")


def _pick(values: list, kind: str) -> Column:
    """The value for the row's node, from one literal array."""
    return F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("node") + 1)


def _node_key(dims: list[int], n_dims: int) -> Column:
    return F.element_at(F.array(*[_key(d) for d in range(n_dims + 1)]), _pick(dims, "int") + 1)


def _cuts(rows: DataFrame, n_dims: int, nodes: list[Node], dims: dict[int, int], bounds: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Weighted quantile of each open node along its dimension: {node: (key, order)}; rows from there on go right.

    Histogram descent: the bytes of at most BINS bins of the node's key
    range are summed in partial aggregates; the bin that holds the wanted
    share is binned again until it weighs next to nothing or is one key. A key (a group of equal texts)
    that is too heavy for either side is descended likewise along the order of its rows.
    """
    want = {i: nodes[i].bytes * (nodes[i].leaves // 2) / nodes[i].leaves for i in dims}
    state = {i: (*bounds[i], 0.0) for i in dims}  # least key, greatest key, bytes below
    group: dict[int, int] = {}  # key of nodes that are descended along the order of its rows
    found: dict[int, tuple[int, int]] = {}
    each = range(len(nodes))
    while state:
        bins = max(LEAST_BINS, min(BINS, SUMS // len(state)))
        step = {i: max(1, -(-(hi - lo + 1) // bins)) for i, (lo, hi, _) in state.items()}
        hist: dict[int, list[tuple[int, int, int]]] = {i: [] for i in state}
        at, whole = _node_key([dims.get(i, 0) for i in each], n_dims), _pick([group.get(i, -1) for i in each], "bigint")
        binned = (
            rows.where(F.col("node").isin(*state))
            .select(
                "node", "size", F.when(whole < 0, at).when(at == whole, F.col("u")).alias("key"), _pick([step.get(i, 1) for i in each], "bigint").alias("step"),
                _pick([state.get(i, (0, 0))[0] for i in each], "bigint").alias("lo"), _pick([state.get(i, (0, 0))[1] for i in each], "bigint").alias("hi"),
            )
            .where("key between lo and hi")
            .groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        )
        for r in binned.collect():
            hist[r["node"]].append((r["bin"], r["bytes"], r["n"]))
        for i in list(state):
            lo, hi, below = state[i]
            for b, weight, n in sorted(hist[i]):
                if below + weight >= want[i] or (b, weight, n) == max(hist[i]):
                    break
                below += weight
            start, one = lo + b * step[i], step[i] == 1
            short, over = want[i] - below, below + weight - want[i]
            edge = start if abs(short) <= abs(over) else start + step[i]
            if i in group and (one or n == 1 or weight <= TOLERANCE * nodes[i].bytes / nodes[i].leaves):
                found[i] = (group[i], edge)
            elif i not in group and (weight <= TOLERANCE * nodes[i].bytes or (one and (n == 1 or min(abs(short), abs(over)) <= GROUP_TOLERANCE * nodes[i].bytes / nodes[i].leaves))):
                found[i] = (edge, 0)
            elif one:  # a group of equal texts too heavy for either side
                group[i], state[i] = start, (0, ORDER - 1, below)
                continue
            else:
                state[i] = (start, min(hi, start + step[i] - 1), below)
                continue
            del state[i]
    return found


def shard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: dict[str, Column] | None = None,
    shards: int | None = 16,
    target_bytes: int | None = None,
    seed: int = 6,
) -> DataFrame:
    """Per row: id, size, text_crc32, shard and slot (gapless from 0 in the shard).

    The tree: a node for k > 1 leaves is cut at the weighted (by size)
    quantile that gives k // 2 leaves their share of the bytes, along the
    dimension that is widest in the node against its width in the whole
    table. The dimensions default to the text's bytes and its bytes per
    character, which equal texts share, and ties follow the checksum, so
    equal texts come to one shard. Where such a group outweighs HEAVY of
    a node it is set aside first, by a dimension of group bytes; only a
    group that can't go to either side without an error of
    GROUP_TOLERANCE of a shard is cut through, as often as it takes, along a seeded order of its rows: by hash of the id, and
    rows of one id or of none by their place in the written table. So each cut is met to a row.
    shards gives the number of leaves; with target_bytes it is
    ceil(all bytes / target_bytes) instead.

    Only sums go to the driver: min and max of each node and at most SUMS
    of their bins. Slots are dealt in buckets of a hash, whose counts alone
    are put in sequence. Null text: size 1 and checksum 0. Null and
    repeated ids, repeated rows: rows of their own, told apart by place. Very long texts: their own size, in a shard that may be theirs alone. Fewer rows than shards: some shards
    stay empty. Empty table: no rows. Other columns, whatever their names, are not carried.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + F.lit(1)
    if dimensions is None:
        dimensions = {"size": size, "density": F.floor(size * 1000 / (F.char_length(text) + 1))}
    rows = docs.select(
        quoted(id_col).alias("id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        # A long below 2^31, that a key holds it above the checksum.
        *[F.greatest(F.lit(0), F.least(F.coalesce(c.cast("long"), F.lit(0)), F.lit(2**31 - 1))).alias(f"d{k}") for k, c in enumerate(dimensions.values(), 1)],
    )
    n_dims = len(dimensions)
    rows, kept = stored(rows, "shard-rows")
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n, all_bytes = total["n"], total["bytes"] or 0
    leaves = max(1, math.ceil(all_bytes / target_bytes) if target_bytes else shards or 1)
    heavy = (
        rows.groupBy("crc", "size").agg(F.sum("size").alias("g"), F.count("*").alias("c"), F.approx_count_distinct("id").alias("ids"))
        .where((F.col("c") > 1) & (F.col("g") > F.lit(HEAVY * all_bytes / leaves))).withColumn("few", F.col("ids") * 2 < F.col("c")).drop("c", "ids")
    )
    # In steps of the least heavy group; the heaviest groups come first along d0.
    unit_bytes = max(1, int(HEAVY * all_bytes / leaves))
    first = kept
    rows, kept = stored(
        rows.join(materialise(heavy, "shard-heavy"), ["crc", "size"], "left")
        .withColumn("d0", F.lit(2**30) - F.least(F.expr(f"coalesce(g, 0) div {unit_bytes}"), F.lit(2**30))).drop("g")
        .withColumn("row", seeded_hash(seed, F.monotonically_increasing_id()))
        .withColumn("u", F.shiftleft(F.shiftrightunsigned(seeded_hash(seed + 1, F.col("id")), 24), 22) + F.shiftrightunsigned(F.col("row"), 42))
        # Rows of no id, and those of a heavy text with few ids, are dealt to slots by place.
        .withColumn("h", F.when(F.col("id").isNull() | F.coalesce("few", F.lit(False)), F.col("row")).otherwise(seeded_hash(seed, F.col("id"), F.col("crc"), F.col("size"))))
        .drop("row", "few").withColumn("node", F.lit(0)),
        "shard-rows",
    )
    drop_path(rows.sparkSession, first)
    nodes = [Node(leaves, 0)]
    spread: dict[int, int] = {}
    while n and any(x.leaves > 1 for x in nodes):
        stats = {
            r["node"]: r
            for r in rows.groupBy("node").agg(
                F.sum("size").alias("bytes"),
                *[f(_key(d)).alias(f"{w}{d}") for d in range(n_dims + 1) for w, f in (("lo", F.min), ("hi", F.max))],
            ).collect()
        }
        dims, bounds = {}, {}
        for i, x in enumerate(nodes):
            x.bytes = stats[i]["bytes"] if i in stats else 0
            if x.leaves == 1 or not x.bytes:
                continue
            r = stats[i]
            width = {d: (r[f"hi{d}"] >> 32) - (r[f"lo{d}"] >> 32) for d in range(1, n_dims + 1)}
            spread = spread or dict(width)
            heaviest = (2**30 - (r["lo0"] >> 32)) * unit_bytes
            dim = 0 if heaviest > HEAVY * x.bytes else max(width, key=lambda d: (width[d] / max(1, spread[d]), -d))
            dims[i], bounds[i] = dim, (r[f"lo{dim}"], r[f"hi{dim}"])
        cut = _cuts(rows, n_dims, nodes, dims, bounds)
        grown: list[Node] = []
        base: list[int] = []
        for i, x in enumerate(nodes):
            base.append(len(grown))
            if i in cut:
                k = x.leaves // 2
                grown += [Node(k, x.first), Node(x.leaves - k, x.first + k)]
            else:
                grown.append(Node(1, x.first, x.bytes))
        at, each = _node_key([dims.get(i, 0) for i in range(len(nodes))], n_dims), range(len(nodes))
        edge, order = (_pick([cut[i][k] if i in cut else 2**63 - 1 for i in each], "bigint") for k in (0, 1))
        right = ~((at < edge) | ((at == edge) & (F.col("u") < order)))
        level, (rows, kept) = kept, stored(rows.withColumn("node", _pick(base, "int") + right.cast("int")), "shard-rows")
        drop_path(rows.sparkSession, level)
        nodes = grown
    placed = rows.select("id", "size", "crc", "h", _pick([x.first for x in nodes], "int").alias("shard"))
    # Buckets of about this many rows; both they and their number grow with the root of the table.
    per_bucket = max(32, math.isqrt(n) // 4)
    placed = placed.withColumn("bucket", F.floor(unit(F.col("h")) * F.lit(max(1, n // leaves // per_bucket))))
    ahead = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
        .select("shard", "bucket", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("start"))
    )
    within = W.partitionBy("shard", "bucket").orderBy("h", "id", "crc", "size")
    return (
        placed.withColumn("r", F.row_number().over(within)).join(starts, ["shard", "bucket"])
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
            (F.col("start") + F.col("r") - 1).cast("long").alias("slot"),
        )
    )
