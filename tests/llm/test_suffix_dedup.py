import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import suffix_dedup
from touchline.llm.suffix_dedup import LENGTH, equal_strings, parse, remove_repeats


def brute(rows):
    """Per row (id, n_bytes, n_removed, n_spans, sha256)."""
    big = 2**63 - 1
    bodies = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in bodies:
        for p in range(len(b) - LENGTH + 1):
            s = b[p : p + LENGTH]
            least[s] = min(i, least.get(s, big))
    out = []
    for (i, b), (own, _) in zip(bodies, rows):
        off = np.zeros(len(b), bool)
        for p in range(len(b) - LENGTH + 1):
            if least[b[p : p + LENGTH]] < i:
                off[p : p + LENGTH] = True
        kept = bytes(x for x, o in zip(b, off) if not o)
        spans = sum(1 for p in range(len(b)) if off[p] and (p == 0 or not off[p - 1]))
        out.append((own, len(b), int(off.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pack", F.lit("clash")).withColumn("id", F.lit("clash"))
    return sorted((tuple(r) for r in remove_repeats(df.repartition(3), **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def words(rng, n, of=40):
    return " ".join("".join(rng.choice(list("abcdeé"), 4)) if rng.random() < 0.5 else f"w{rng.integers(of)}" for _ in range(n))


@pytest.mark.parametrize("hot", (4096, 1))
@pytest.mark.parametrize("pack", (8 << 20, 3000))
def test_against_brute_force(spark, monkeypatch, hot, pack):
    monkeypatch.setattr(suffix_dedup, "PACK", pack)
    rng = np.random.default_rng(3)
    shared = [words(rng, n) for n in (12, 30, 80)]
    rows = []
    for i in range(80):
        text = words(rng, int(rng.integers(0, 60)))
        for s in shared:
            if rng.random() < 0.3:
                cut = int(rng.integers(0, len(s) // 2))
                text += " " + s[cut:] + words(rng, 3)
        rows.append((int(rng.integers(0, 60)), text))
    rows += [(None, shared[2]), (None, shared[2]), (5, None), (6, ""), (7, "a" * 49), (8, "a" * 50), (9, "a" * 300), (10, "ab" * 120), (11, "ab" * 60), (12, "\0" * 70), (13, "\0" * 90), rows[0], rows[1]]
    assert run(spark, rows, hot_packs=hot) == brute(rows)


def test_long_texts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 512)
    rng = np.random.default_rng(4)
    long = words(rng, 3000, 10**6)
    rows = [(2, long), (1, long[5000:5049]), (3, long[700:1500] + "!" + long[4000:4050] + "?" + long[9000:9049]), (4, "x" * 5000)]
    assert run(spark, rows) == brute(rows)


def test_every_string_has_one_phrase():
    rng = np.random.default_rng(5)
    for body in (rng.integers(0, 256, 3000), rng.integers(97, 99, 3000), np.zeros(500)):
        body = body.astype(np.uint8)
        lens = np.array([0, 30, 50, len(body) - 80])
        found = parse(body, lens)
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(found.first, found.last)])
        assert starts.tolist() == [30, *range(80, len(body) - LENGTH + 1)]
        assert (found.last - found.first <= LENGTH - suffix_dedup.WINDOW).all()


def test_equal_strings_in_order():
    body = np.frombuffer(b"x" * 60 + b"y" + b"x" * 60, np.uint8)
    starts = np.array([0, 10, 61, 71, 11])
    assert equal_strings(body, starts, np.array([5, 6, 3, 9, 1])).tolist() == [3, 3, 3, 3, 1]


def test_kept_bytes_and_empty_table(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from it"
    rows = [(1, text), (2, "Before: " + text + " :after")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept).decode() for r in remove_repeats(df).collect()}
    assert kept[1] == text and kept[2] == "Before:  :after"
    assert remove_repeats(df.where("false")).collect() == []
