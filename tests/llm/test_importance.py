import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import importance
from touchline.llm.importance import buckets_of, head_of, pieces_of, resample, words_of


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(rows, target, buckets=10000):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(of(f) for _, x in rows for f in features(x)), Counter(of(f) for x in target for f in features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain(of(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: len(able) * 25 // 100], 1)}
    return sorted([(*r[:4], rank.get(id(r))) for r in out], key=str)


def run(spark, rows, target):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("id", F.lit("clash"))
    out = resample(df.repartition(3), spark.createDataFrame([(x,) for x in target], "text string"))
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("slice_bytes", (4 << 20, 60))
def test_against_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(importance, "SLICE", slice_bytes)
    rng = np.random.default_rng(1)
    vocabulary = ["The", "cat", "é", "ÉCOLE", "x1", "a b", "😀", "don't", "w" * 70] + [f"v{i}" for i in range(60)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    rows = [(i, text(int(rng.integers(0, 60)))) for i in range(150)]
    rows += [(None, rows[40][1]), (500, None), (501, ""), (502, " .!"), (503, "w" * 70), (504, "the cat " * 300)]
    target = [text(30) for _ in range(10)] + [None, ""]
    assert run(spark, rows, target) == brute(rows, target)


def test_repeated_rows_and_ties(spark):
    rows = [(i % 7, "one two three " * 8) for i in range(70)] + [(None, "four five six seven " * 6)] * 9
    got = run(spark, rows, ["one two"])
    want = brute(rows, ["one two"])
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 20)) == sorted(r[4] for r in want if r[4])


def test_empty(spark):
    assert run(spark, [], ["x"]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_head_changes_nothing():
    texts = pa.array([b"a b c a b d", b"a b", b"", b"e"])
    w = words_of(next(pieces_of(texts)))
    plain = buckets_of(w, head_of([], [], 100), 100)
    full = buckets_of(w, head_of([b"b", b"a", b"zz"], [(b"a", b"b"), (b"b", b"a"), (b"zz", b"q")], 100), 100)
    assert all((x == y).all() for x, y in zip(plain, full)) and len(plain[2]) == 6
