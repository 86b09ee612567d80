import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import langid

EN = "the house and the garden with this that where there is nothing other than the weather"
DE = "der garten und das haus mit diesem nicht ueber schon zwischen wirklich ganz gut sein"
RU = "привет мир это язык который мы знаем хорошо"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, l) for i in range(40) for t, l in ((EN, "en"), (DE, "de"), (RU, "ru"))] + [(0, None, "en"), (0, EN, None)]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_model(model):
    assert model.languages == ["de", "en", "ru"]
    latin, cyrillic = langid._NAMES.index("Latin"), langid._NAMES.index("Cyrillic")
    assert model.scripts[latin].tolist() == [True, True, False] and model.scripts[cyrillic].tolist() == [False, False, True]


def test_labels(spark, model):
    texts = [(1, EN), (2, DE), (3, RU), (4, f"{EN} {EN} {DE}"), (5, None), (6, ""), (7, "123 .,"), (8, "漢字"), (9, RU + " " + EN)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "ru", "en"]
    assert [(s.lang, s.first_word, s.last_word) for s in got[4].lang_spans] == [("en", 0, 31), ("de", 32, 46)]
    assert [s.lang for s in got[9].lang_spans] == ["ru", "en"]
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (5, 6, 7))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[8].score < 0.5


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    scores = -rng.gamma(1, 2, (9, 3)).astype(np.float32)
    lengths = np.array([6, 5, 1])
    index = rng.integers(0, 9, 12)
    path = langid.viterbi(scores, index, lengths, 1.5)
    at = 0
    for n in lengths:
        own = scores[index[at : at + n]]
        cost = lambda p: sum(own[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        assert cost(path[at : at + n]) == pytest.approx(max(map(cost, itertools.product(range(3), repeat=int(n)))), abs=1e-4)
        at += n


@pytest.mark.parametrize("cells", [1, 7, 60, 1000])
def test_blocks_give_the_same_path(cells):
    rng = np.random.default_rng(5)
    scores = -rng.gamma(1, 2, (50, 4)).astype(np.float32)
    lengths = np.array([400, 90, 90, 31, 7, 1, 1])
    index = rng.integers(0, 50, lengths.sum())
    assert (langid.viterbi(scores, index, lengths, 2.5, cells) == langid.viterbi(scores, index, lengths, 2.5)).all()


def test_a_text_longer_than_a_block(model, monkeypatch):
    """More words times languages than are held at a time, with a change of language in the middle of a block."""
    monkeypatch.setattr(langid, "CELLS", 1 << 16)
    label = langid.Labeller(model, langid.SWITCH)
    n = 3000
    (lang, score, spans), (other, _, _) = label.label([f"{EN} " * 2 * n + f"{DE} " * n, RU])
    assert lang == "en" and 0 <= score <= 1 and other == "ru"
    assert spans == [("en", 0, 32 * n - 1), ("de", 32 * n, 47 * n - 1)]


def test_every_label_is_learned(spark):
    """Rare labels too, and more than fit a byte."""
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, 12))) for _ in range(300)]
    rows = [(3 * k + j, f"{words[k]} {words[k]} {words[k]}", f"l{k:03}") for k in range(300) for j in range(1 + (k < 299))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == [f"l{k:03}" for k in range(300)]
    got = langid.identify(docs.withColumnRenamed("lang", "truth"), model).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.truth for r in got)


def test_odd_rows(spark, odd, none, model):
    out = langid.identify(odd, model)
    assert out.count() == 9 and out.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "score"]
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(none)
    assert empty.languages == [] and {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    flags = spark.range(6).select(langid.held_out(F.col("id")).alias("h"), F.crc32(F.col("id").cast("string")).alias("c")).collect()
    assert all(r.h == (r.c % 3 == 1) for r in flags)


def test_held_out_accuracy(spark, sf):
    from touchline.llm.queries import op5_langid, table

    truth = table(spark, sf, "documents").select("doc_id", "lang")
    got = op5_langid(spark, sf).join(truth, "doc_id").where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got >= 0.95


def test_copies_are_drawn_apart(spark):
    """A label of one much copied text is learned, and its copies do not all come in."""
    docs = spark.createDataFrame([(i, RU, "ru") for i in range(3000)] + [(5000, DE, "de")], "doc_id long, text string, lang string")
    assert langid.fit(docs, sample=1).languages == ["de", "ru"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.where("doc_id in (7, 5000)").withColumn("a.b", F.lit(1)), langid.fit(docs, sample=1)).collect()}
    assert got == {7: "ru", 5000: "de"}
