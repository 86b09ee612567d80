import bisect
import zlib

import numpy as np
import pytest

from touchline.llm.packing import SumIndex, WordEncoder, best_fit, pack, plan

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_words_add_up_to_the_text():
    enc = WordEncoder.of(None)
    texts = ["Héllo, wörld!! it's <|startoftext|>X <|STARTOFTEXT|> a.b,c. ΟΔΟΣ İx ﬁ ́x \x1c\x85 1234.5, don't'S 😀😀. x...", None, "", "A" * 3000, "x y　z."]
    for t, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_everything(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, 101, 40)} | {100: 3}
    bins = plan(counts, 100)
    used = {}
    for lengths, n in bins:
        assert sum(lengths) <= 100 and n > 0
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == counts
    gaps = []  # best-fit decreasing, item by item
    for x in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        i = bisect.bisect_left(gaps, x)
        bisect.insort(gaps, (gaps.pop(i) if i < len(gaps) else 100) - x)
    assert -(-sum(k * n for k, n in counts.items()) // 100) <= sum(n for _, n in bins) <= len(gaps)


def test_plan_uses_exact_combinations():
    assert sorted(plan({60: 2, 40: 2}, 100)) == [((60, 40), 2)]
    assert plan({50: 4, 30: 4, 20: 4}, 100)[0][1] and sum(n for _, n in plan({50: 4, 30: 4, 20: 4}, 100)) == 4
    assert sum(n for _, n in plan({70: 1, 10: 3}, 100)) == 1 and plan({}, 100) == []
    assert sum(n for _, n in plan({100: 5, 1: 100}, 100)) == 6


def test_pack(spark, odd, none):
    got = pack(odd, capacity=64).collect()
    enc = WordEncoder.of(None)
    rows = odd.select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(str(r.doc_id), k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in got) // 64) + 1
    assert pack(none).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_plan_of_real_documents_is_exact_fills(folder):
    import pyarrow.parquet as pq

    counts = {}
    for ids in WordEncoder.of(None).encode(pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column("text").to_pylist()):
        n = len(ids) // 4 + 1
        for size in [2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0):
            counts[size] = counts.get(size, 0) + 1
    bins = plan(counts, 2048)
    many = sum(n for _, n in bins)
    assert many == -(-sum(k * n for k, n in counts.items()) // 2048)  # no plan has fewer
    assert many <= sum(n for _, n in best_fit(counts, 2048))
    assert sum(n for used, n in bins if sum(used) == 2048 and len(used) <= 4) > 0.7 * many


def test_index_follows_what_is_used():
    rng = np.random.default_rng(3)
    have = np.zeros(65, np.int64)
    have[rng.integers(1, 65, 30)] = rng.integers(1, 3)
    index = SumIndex(have.copy())
    for x in np.flatnonzero(have).tolist():
        index.take((x,), int(index.have[x]))
        fresh = SumIndex(index.have.copy())
        assert (index.one == fresh.one).all() and (index.two == fresh.two).all() and (index.three == fresh.three).all()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
