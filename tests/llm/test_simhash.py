import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from touchline.llm import simhash
from touchline.llm.common import connected_components


def slow(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one two", "A b C d", "É é ß words and words and words " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow(text)


def components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            parent[find(j)] = find(i)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("paired", [2, simhash.PAIRED, 10_000])
def test_links_lose_nothing(spark, paired):
    """Whether lists are tallied by pairs or go by places."""
    rng = random.Random(7)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice((1, 2, 3))):
                f ^= 1 << b
    fps |= {(1 << 63) | x for x in range(512)}  # a list of hundreds that share seven bytes
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    longest = simhash.postings(nodes).groupBy("list", "free").count().agg(F.max("count")).first()[0]
    assert longest >= 512 and simhash.postings(nodes).count() == 6 * len(fps)
    edges = simhash.links(nodes, paired=paired)
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= 2 for r in edges.collect())
    found = {r.node: r.component for r in connected_components(edges).collect()}
    root = components(fps)
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(signed[i])
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert found == want


def test_the_tally_rejects(spark):
    """Two that share a list but only four or five byte positions, and two that share six but differ in three bits, are no pair."""
    fps = [0, 0x0101, 0x01010101, 0x010101, 0x0300000000000000, 0x0700000000000000]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = {(x, y) for x, y in itertools.combinations(sorted(fps), 2) if bin(x ^ y).count("1") <= 2}
    assert got == want and (0, 0x010101) not in got
    tally = {(x, y): sum((x >> 8 * i & 255) == (y >> 8 * i & 255) for i in range(8)) for x, y in itertools.combinations(fps, 2)}
    pairs = spark.createDataFrame([(*k, v) for k, v in tally.items()], "a long, b long, n int")
    assert pairs.where(simhash.shared_bytes(F.col("a"), F.col("b")) != F.col("n")).count() == 0


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    names = rng.sample(range(10**9), 300)
    edges = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:])] + [(names[0], names[0]), (None, 5)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(n, min(names)) for n in names}
    assert connected_components(edges.where("a = 0")).count() == 0


def test_documents(spark, odd, none):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    rows = odd.select("doc_id", "text").collect()
    assert {(i, f) for i, f, _ in got} == {(r.doc_id, f"{slow(r.text):016x}") for r in rows}
    part = {i: c for i, _, c in got}
    assert part[1] == part[2] == 1 and part[3] == part[4] == part[5] == 3 and part[6] == 6
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "6", "7", "None"]
    dotted = odd.withColumn("a.b", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("c0", F.lit(3))
    again = simhash.keep_one(dotted)
    assert again.columns == dotted.columns and again.where("gone = 2 and c0 = 3 and `a.b` = 1").count() == 6
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_copies_of_real_documents(spark, sf):
    from touchline.llm.queries import op10_simhash, table

    rows = {r.doc_id: slow(r.text) for r in table(spark, sf, "documents").collect()}
    ids = sorted(rows)
    root = components([rows[i] for i in ids])
    first = {}
    for i, r in zip(ids, root):
        first[r] = min(first.get(r, i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash(spark, sf).collect()}
    assert got == {i: (f"{rows[i]:016x}", first[r]) for i, r in zip(ids, root)}
    assert F is not None
