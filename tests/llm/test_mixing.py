import re

import pytest
from pyspark.sql import functions as F

from touchline.llm import mixing
from touchline.llm.mixing import mix, mixed, water_fill


def looped(sizes, weights, epochs=3.0):
    """Clamp and reshare until no source is above its cap."""
    total, fixed = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, w = total - sum(fixed.values()), sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > epochs * sizes[i] + 1e-9] if free else []
        if not over:
            return [fixed.get(i, left * weights[i] / w if w else 0.0) for i in range(len(sizes))]
        fixed |= {i: epochs * sizes[i] for i in over}


@pytest.mark.parametrize("sizes", [[10, 1000, 30], [1, 1, 1, 1], [5, 0, 100, 7, 7000, 1], [0, 0]])
def test_water_filling_equals_the_loop(spark, sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    df = spark.createDataFrame([(f"s{i}", s, w, i + 1) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight double, rank int")
    got = [r.target for r in water_fill(df).orderBy("source").collect()]
    assert got == pytest.approx(looped(sizes, weights))


def test_mix_keeps_its_promises(spark):
    rows = [(i, " ".join(["w"] * (1 + (i * 7919) % 60)), f"s{0 if i % 3 else i % 7}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(900)) and got != []
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    by = {}
    for r in got:
        assert r.size == words[r.doc_id] and r.taken == r.reps * r.size <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    order = sorted(by)
    targets = looped([sum(r.size for r in by[s]) for s in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))])
    for s, target in zip(order, targets):
        assert by[s][0].target == pytest.approx(target) and by[s][0].source_size == sum(r.size for r in by[s])
        assert sum(r.taken for r in by[s]) == pytest.approx(target, abs=max(2, 0.01 * target))
    again = mix(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_odd_rows(odd, none):
    got = mix(odd).collect()
    assert len(got) == 9 and all(r.taken == 0 for r in got if r.size == 0)
    assert mix(none).count() == 0
    out = mixed(odd)
    assert out.columns == odd.columns and out.where("text is null").count() == 0
    assert {r["size"] for r in out.select("size").distinct().collect()} <= {"clash"}
    assert mixed(none).count() == 0
    taken = sum(r.reps for r in got)
    assert out.select(F.count("*")).first()[0] == taken


@pytest.mark.parametrize("kind", ["long text", "null ids", "one id", "equal rows"])
def test_nothing_keeps_the_rest_out(spark, kind):
    """A source with a part that does not fit its budget is still filled until no document left fits."""
    rows = [(i, f"{i} " + "w " * ((i * 7919) % 600), "a") for i in range(500)] + [(1000, "x " * 20_000, "b"), (1001, "y " * 400_000, "c")]
    odd = {
        "long text": [(900 + k, "w " * 150_000, "a") for k in range(2)], "null ids": [(None, f"n{k} " * 100, "a") for k in range(2000)],
        "one id": [(900, f"n{k} " * 100, "a") for k in range(2000)], "equal rows": [(900, "n " * 100, "a")] * 2000,
    }[kind]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, source string")
    for seed in range(3):
        got = mix(df, weights=(1.0, 20.0, 1.9), seed=seed).where("source = 'a'").collect()
        least = min(r.reps for r in got)
        rest = got[0].target - sum(r.taken for r in got)
        assert 0 <= rest < min(r.size for r in got if r.reps == least) and rest < 0.01 * got[0].target, (kind, seed, rest)


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "w " * (i + 1), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    for c in ("__size", "__source", "__h", "__reps", "__turn", "__again", "__plan_rounds", "c1", "a.b"):
        df = df.withColumn(c, F.concat(F.lit("own "), F.col("doc_id").cast("string")))
    out = mixed(df)
    assert out.columns == df.columns and sorted(set(map(str, out.collect()))) == sorted(str(r) for r in df.collect() if r.doc_id in {x.doc_id for x in out.select("doc_id").collect()})
    assert mix(df).where("reps > 0").count() == out.select("doc_id").distinct().count()


def test_copies_are_numbered_alike_however_dealt(spark):
    """Copies of one row get a place each, the same ones from any partitioning, and no task numbers more than a partition's."""
    rows = spark.createDataFrame([(None, "one two", s) for s in ("a", None) for _ in range(300)] + [(1, "x", "a"), (1, "x", "b"), (2, "y", "a")], "doc_id long, text string, source string")
    found = []
    for n in (1, 7, 40):
        own = rows.repartition(n).select(*mixing._rows(rows, "doc_id", "text", "source", 1))
        again = mixing._repeats(own)
        out = mixing._apart(own, again)
        assert out.columns == own.columns and out.count() == 603
        assert out.groupBy("__source").agg(F.count_distinct("__h").alias("n"), F.count("*").alias("m")).where("n <> m").count() == 0
        found.append(sorted(map(str, out.collect())))
    assert found[0] == found[1] == found[2]
