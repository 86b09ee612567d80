import random
import zlib

import pytest

from touchline.llm.sharding import shard


def check(rows, got, shards):
    assert len(got) == len(rows) and all(0 <= r.shard < shards for r in got)
    for k in range(shards):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert sorted(map(str, ((r.doc_id, r["size"], r.text_crc32) for r in got))) == sorted(map(str, ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)))


def test_equal_bytes_and_whole_groups(spark):
    rows = [(i, f"text {i} " * (1 + (i * 37) % 90)) for i in range(1500)] + [(10_000 + i, "copies of one text " * 20) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard(df, shards=16).collect()
    check(rows, got, 16)
    size = [sum(r["size"] for r in got if r.shard == k) for k in range(16)]
    assert max(size) <= 1.03 * sum(size) / 16 and min(size) >= 0.97 * sum(size) / 16
    groups = {}
    for r in got:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    again = {(r.doc_id, r.shard, r.slot) for r in shard(df.repartition(7), shards=16).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_a_third_in_one_group_is_still_balanced(spark):
    rows = [(i, "the same " * 30) for i in range(500)] + [(1000 + i, f"another {i} " * 30) for i in range(900)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect()
    check(rows, got, 5)
    size = [sum(r["size"] for r in got if r.shard == k) for k in range(5)]
    assert max(size) <= 1.06 * sum(size) / 5 and min(size) >= 0.94 * sum(size) / 5


@pytest.mark.parametrize("share, ids, shards", ((0.33, "distinct", 64), (0.5, "equal", 5), (0.7, "distinct", 16), (0.9, "null", 16), (1.0, "null", 5)))
def test_groups_cut_many_times(spark, share, ids, shards):
    n = int(6000 * share)
    of = {"distinct": lambda i: i, "equal": lambda i: 7, "null": lambda i: None}[ids]
    rows = [(of(i), "the same words " * 4) for i in range(n)] + [(10_000 + i, f"other words {i:05d} " * 3 + "x" * (i % 7)) for i in range(6000 - n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = shard(df, shards=shards).collect()
    check(rows, got, shards)
    size = [sum(r["size"] for r in got if r.shard == k) for k in range(shards)]
    assert max(size) <= 1.03 * sum(size) / shards and min(size) >= 0.97 * sum(size) / shards


def test_target_bytes_and_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(rows, shard(odd, shards=4).collect(), 4)
    assert shard(none, shards=4).count() == 0
    assert {r.shard for r in shard(odd, target_bytes=10**9).collect()} == {0}


def brute(rows, shards):
    """The tree cut by cut over sorted lists: {id: shard}, for texts that are all different."""
    items = []
    for i, t in rows:
        raw = t.encode()
        size = len(raw) + 1
        items.append((i, size, zlib.crc32(raw), (size, size * 1000 // (len(t) + 1))))
    width = lambda part, d: max(x[3][d] for x in part) - min(x[3][d] for x in part)
    whole, out = [width(items, d) for d in (0, 1)], {}

    def cut(part, leaves, first):
        if leaves == 1 or not part:
            out.update((x[0], first) for x in part)
            return
        d = max((0, 1), key=lambda d: (width(part, d) / max(1, whole[d]), -d))
        part = sorted(part, key=lambda x: (x[3][d], x[2]))
        want, below = sum(x[1] for x in part) * (leaves // 2) / leaves, 0
        for at, x in enumerate(part):
            if below + x[1] >= want:
                break
            below += x[1]
        at += abs(want - below) > abs(below + part[at][1] - want)
        cut(part[:at], leaves // 2, first)
        cut(part[at:], leaves - leaves // 2, first + leaves // 2)

    cut(items, shards, 0)
    return out


def test_cuts_equal_a_tree_over_sorted_lists(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcé漢 ", [5, 5, 5, 1 + i % 9, i % 4, 3], k=rng.randint(20, 400)))) for i in range(300)]
    for shards in (2, 5, 16):
        got = {r.doc_id: r.shard for r in shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards).collect()}
        assert got == brute(rows, shards)
