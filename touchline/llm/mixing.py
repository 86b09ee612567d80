"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialise, quoted, seeded_hash, unit

#: Words are runs of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bins of a source's seeded order that a round of filling its budget looks at; together they hold about twice what is left of it, or all.
SLICES = 1024
#: A round: documents of at most limit words are hashed into bins, and those in the taken bins are taken.
ROUNDS = "array<struct<turn:int,limit:double,bins:double,taken:array<bigint>>>"


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def water_fill(sources: DataFrame, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """Add target to (source, source_size, weight): weight-proportional, at most max_epochs * source_size.

    Clamping the sources above their cap and resharing the excess by weight
    until none is above ends at target = min(cap, level * weight). Ordered
    by cap / weight, the clamped sources come first, so the level is read
    from two running sums instead of a loop: after k clamped sources it is
    (total - their caps) / (weight of the rest), and the first k whose next
    source stays below its cap is the fixed point. With more asked for than
    all caps hold, every target is its cap. An empty table gives no rows;
    sources without words get 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = W.partitionBy()
    s = (
        sources.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level_here", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
        .withColumn("free", F.col("level_here") * F.col("weight") <= F.col("cap"))
        # The level of the first free source in that order; every later one is free too.
        .withColumn("level", F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", F.col("level_here").alias("v")))).over(everything)["v"])
    )
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return s.select(*sources.columns, target.alias("target"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """A row's own part in the mix: size, source and place in the seeded order, of id and text."""
    return [word_count(quoted(text_col)).alias("__size"), quoted(source_col).alias("__source"), seeded_hash(seed, quoted(id_col), quoted(text_col)).alias("__h")]


def _repeats(rows: DataFrame) -> DataFrame:
    """The places (__again) of rows with words that several rows of _rows() have."""
    return materialise(rows.where("__size > 0").groupBy(F.col("__h").alias("__again")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "mix-repeats")


def _apart(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """rows, those of equal id and text numbered by source and each given a place of its own; the others are not shuffled.

    Numbers count on from one input partition to the next, so that all copies
    of one row are never in one task. They run without gaps, so that a source's
    copies have the same places whenever and however dealt they are numbered.
    """
    if repeats.isEmpty():
        return rows
    marked = rows.withColumn("__part", F.spark_partition_id()).join(repeats, F.col("__h") == F.col("__again"), "left")
    key = ("__again", "__source", "__part")
    own = F.row_number().over(W.partitionBy(*key).orderBy("__again"))
    many = materialise(marked.where("__again is not null").withColumn("__copy", own), "mix-copies")
    counts = many.groupBy(*key).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("__again", "__source").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select(F.col("__again").alias("k0"), F.col("__source").alias("k1"), F.col("__part").alias("k2"), F.coalesce(earlier, F.lit(0)).alias("__before"))
    same = (F.col("__again") == F.col("k0")) & F.col("__source").eqNullSafe(F.col("k1")) & (F.col("__part") == F.col("k2"))
    placed = many.join(before, same).withColumn("__h", seeded_hash(0, F.col("__h"), (F.col("__before") + F.col("__copy")).cast("int")))
    return marked.where("__again is null").drop("__again", "__part").unionByName(placed.select(*rows.columns))


def _bin(h: Column, turn: Column, bins: Column) -> Column:
    """A row's bin in a round."""
    return F.floor(unit(F.xxhash64(h, turn)) * bins).cast("bigint")


def _taken(rounds: Column) -> Column:
    """Whether one of its source's rounds takes a row."""
    return F.exists(rounds, lambda x: (F.col("__size") <= x["limit"]) & F.array_contains(x["taken"], _bin(F.col("__h"), x["turn"], x["bins"])))


def _filled(rows: DataFrame, state: DataFrame) -> DataFrame:
    """state(source, rest, ...) plus the rounds that take rows of at most rest words of each source, until no row left fits the rest.

    A round hashes the rows that still fit into so many bins that the first
    SLICES hold about twice the rest, and takes those bins in turn that
    fit what is then left of it, the few large ones before the others use up
    what would fill the gaps between them. A bin that does not fit is left
    out and its rows are hashed anew in the next round, by then without those too
    large, so that no long text or large bin keeps others out.
    """
    size, h, same = F.col("__size"), F.col("__h"), F.col("source").eqNullSafe(F.col("s"))
    state = materialise(state.withColumn("rounds", F.array().cast(ROUNDS)), "mix-state")
    for turn in count():
        live = lambda state, *more: (
            rows.where(size > 0).join(state.select("source", "rest", "rounds", *more), F.col("source").eqNullSafe(F.col("__source"))).where((size <= F.col("rest")) & ~_taken(F.col("rounds")))
        )
        words = live(state).groupBy(F.col("source").alias("s")).agg(F.sum(size).alias("words"))
        state = materialise(
            state.join(words, same, "left").drop("s").withColumn("bins", F.greatest(F.lit(float(SLICES)), F.col("words") / F.col("rest") * (SLICES / 2))), "mix-state"
        )
        if state.where("words > 0").isEmpty():
            return state.drop("words", "bins")
        # At most SLICES sums of a source, in one partial aggregation.
        slices = live(state, "bins").withColumn("bin", _bin(h, F.lit(turn), F.col("bins"))).where(F.col("bin") < SLICES).groupBy("source", "bin").agg(F.sum(size).alias("words"))
        inside = slices.groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_list(F.struct("bin", "words"))).alias("slices"))
        # Bins above a hundredth of the rest come first, up to their part of the rest or what the others cannot fill.
        heavy = lambda x: x["words"] > F.col("rest") / 100
        total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc + x["words"])
        large, light = F.filter("slices", heavy), F.filter("slices", lambda x: ~heavy(x))
        wanted = F.greatest(F.col("rest") * F.col("large") / (F.col("large") + F.col("light")), F.col("rest") - F.col("light"))
        fits = F.aggregate(
            F.concat(large, light), F.struct(F.col("rest").alias("rest"), F.array().cast("array<bigint>").alias("taken")),
            lambda acc, x: F.when(
                (x["words"] <= acc["rest"]) & (~heavy(x) | (F.col("rest") - acc["rest"] < F.col("wanted"))),
                F.struct((acc["rest"] - x["words"]).alias("rest"), F.concat(acc["taken"], F.array(x["bin"])).alias("taken")),
            ).otherwise(acc),
        )
        own = F.struct(F.lit(turn).alias("turn"), F.col("rest").alias("limit"), "bins", F.col("fits.taken").alias("taken"))
        state = materialise(
            state.join(inside, same, "left").withColumn("large", total(large)).withColumn("light", total(light)).withColumn("wanted", wanted).withColumn("fits", F.when(F.col("slices").isNotNull(), fits))
            .withColumn("rounds", F.when(F.size("fits.taken") > 0, F.concat("rounds", F.array(own).cast(ROUNDS))).otherwise(F.col("rounds")))
            .withColumn("rest", F.coalesce("fits.rest", "rest")).drop("s", "slices", "large", "light", "wanted", "fits", "words", "bins"),
            "mix-state",
        )


def plan(rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """Per source of _rows(): source_size, target, whole repetitions, and the rounds that take rows once more."""
    size, source = F.col("__size"), F.col("__source")
    ranked = (
        rows.groupBy(source.alias("source")).agg(F.sum(size).alias("source_size"))
        .withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = water_fill(
        ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1)), share, max_epochs
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.least(F.floor(ratio + 1e-12), F.lit(max_epochs)).cast("int"))
    budget = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    return _filled(rows, sources.select("source", "source_size", "target", "whole", budget.alias("rest"))).drop("rest")


def _joined(rows: DataFrame, plans: DataFrame, max_epochs: int) -> DataFrame:
    """rows with the plan of their source as __source_size and __target, and __reps."""
    p = plans.select(*[F.col(c).alias(f"__plan_{c}") for c in plans.columns])
    size = F.col("__size")
    once = _taken(F.col("__plan_rounds"))
    reps = F.when(size > 0, F.least(F.col("__plan_whole") + once.cast("int"), F.lit(max_epochs))).otherwise(0)
    return rows.join(p, F.col("__source").eqNullSafe(F.col("__plan_source"))).withColumn("__reps", reps.cast("int"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 1,
) -> DataFrame:
    """Per row: id, size, source, source_size, target (its source's), reps and taken = reps * size.

    Sources, by code point with null last, take the weights in turn. Each
    document is taken floor(target / source_size) times, and a seeded part
    of the source once more, until no document that was left out fits the
    rest of the budget. All native, one pass over the texts; the words of a source
    are summed in partial aggregates, so a hot source is never gathered.

    Null text: size 0, never taken. Null source: a source of its own. Null
    ids and repeated rows: decided by their text too, and each of several equal
    rows by itself. Empty table: no rows. Other
    columns, whatever their names, are not carried.
    """
    rows = materialise(docs.select(quoted(id_col).alias("__key"), *_rows(docs, id_col, text_col, source_col, seed)), "mix-rows")
    if not (repeats := _repeats(rows)).isEmpty():
        rows = materialise(_apart(rows, repeats), "mix-rows")
    out = _joined(rows, plan(rows, weights, share, max_epochs), max_epochs)
    return out.select(
        F.col("__key").alias(id_col), F.col("__size").alias("size"), F.col("__source").alias("source"), F.col("__plan_source_size").alias("source_size"),
        F.col("__plan_target").alias("target"), F.col("__reps").alias("reps"), (F.col("__reps") * F.col("__size")).cast("long").alias("taken"),
    )


def mixed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 1,
) -> DataFrame:
    """The rows of docs, all their columns, as often as mix() takes them.

    The texts are not shuffled, but for those of repeated rows: only the small plan is joined to them.
    Null texts, sources and ids, empty and very long texts, ties and repeated rows: as in mix(); rows without words are never
    taken. Empty table: no rows. All columns are carried, whatever their names.
    """
    names = docs.columns
    bare = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = _rows(bare, *[f"c{names.index(c)}" for c in (id_col, text_col, source_col)], seed)
    rows = materialise(bare.select(*own), "mix-rows")
    repeats = _repeats(rows)
    plans = plan(_apart(rows, repeats), weights, share, max_epochs)
    out = _joined(_apart(bare.select("*", *own), repeats), plans, max_epochs).where("__reps > 0")
    return out.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__reps")))).select(bare.columns).toDF(*names)
