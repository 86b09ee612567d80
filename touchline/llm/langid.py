"""Language identification: script ranges, per-word scores, Viterbi over words."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import quoted, seeded_hash, shared_dir, unit

#: Hashed byte n-grams of 1 to ORDER bytes, in this many buckets; one more, of score 0, stands for none.
BUCKETS, ORDER = 1 << 15, 4
#: The sample that a model is fitted on: at most about this many documents of each language, drawn by a seeded hash.
SAMPLE = 2000
#: First code points of runs of the Unicode script blocks told apart here, and whether each run is such a script.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"),
    (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)
_FIRST = [a for a, _ in SCRIPTS]
_NAMES = sorted({s for _, s in SCRIPTS})
#: A language may be written in a script that has this share of its sample's letters.
SCRIPT_SHARE = 0.005
#: What changing the language between two words costs, and the most that one word says, in nats.
SWITCH, CLAMP = 10.0, 8.0
#: What a text without a letter is labelled, and a letter, for Java's expressions.
UNKNOWN, LETTER = "und", r"\p{L}"
#: Words whose scores a worker remembers, and text handled together.
REMEMBERED, GROUP_CHARS = 250_000, 3 << 20
#: New words scored at a time.
LEARNED = 1 << 14
#: Back pointers and word scores (words times languages) in memory at a time.
CELLS = 1 << 24


def script_of(word: str) -> int:
    """Index of the script of the first letter."""
    return _NAMES.index(SCRIPTS[max(0, bisect_right(_FIRST, ord(word[0])) - 1)][1])


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of <word> for each n (ORDER rows over all bytes) and where each word's bytes begin."""
    raw = [b"\x02" + w.encode("utf-8", "replace") + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    size = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(size) - size
    left = np.repeat(starts + size, size) - np.arange(len(data))  # bytes up to the word's end
    out = np.full((ORDER, len(data)), BUCKETS, np.int64)
    h = np.zeros(len(data), np.uint64)
    for n in range(1, ORDER + 1):
        h = h * np.uint64(257) + np.concatenate([data[n - 1 :], np.zeros(min(n - 1, len(data)), np.uint64)])[: len(data)] + np.uint64(1)
        bucket = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)
        out[n - 1] = np.where(left >= n, bucket, BUCKETS)
    return out, starts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + 1, languages): log-probability, last row 0
    scripts: np.ndarray  # (scripts, languages): whether the language is written in it

    def score(self, words: list[str]) -> np.ndarray:
        """(words, languages): how well each language explains each word, the best 0, at least -CLAMP."""
        f, starts = features(words)
        total = sum(np.add.reduceat(self.weights[f[n]], starts, axis=0) for n in range(ORDER)) / ORDER
        may = self.scripts[[script_of(w) for w in words]]
        known = may.any(1, keepdims=True)
        total = np.where(known, np.where(may, total, -np.inf), 0.0)  # a script of no language says nothing
        return np.maximum(total - total.max(1, keepdims=True), -CLAMP).astype(np.float32)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 5, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows of docs: n-gram counts of a seeded sample of at most about `sample` rows of each language.

    The sample is drawn by a hash of id and text, so that copies of a text under other ids
    are drawn apart; the row of the least hash is always in it, so that every label has one. Counts are summed over the cluster; the driver gets at most
    (BUCKETS + scripts) sums for each language. Null texts and labels teach nothing. Empty table: a model without languages.
    """
    shared_dir(docs.sparkSession)
    place = unit(seeded_hash(seed, quoted(id_col), quoted(text_col)))
    known = docs.where(quoted(lang_col).isNotNull() & quoted(text_col).isNotNull()).select(quoted(lang_col).alias("lang"), quoted(text_col).alias("text"), place.alias("place"))
    facts = {r["lang"]: r for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()}
    sizes = {k: r["n"] for k, r in facts.items()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros((len(_NAMES), 0), bool))
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(max(sample / n, facts[k]["least"])))]), F.col("lang"))
    drawn = known.where(F.col("place") <= share).drop("place")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                words = Counter()
                for t in texts:
                    words.update(t.lower().split())
                clean = Counter()
                for w, n in words.items():
                    if w := letters_of(w):
                        clean[w] += n
                if not clean:
                    continue
                own = sums.setdefault(lang, np.zeros(BUCKETS + 1 + len(_NAMES)))
                names, times = list(clean), np.array(list(clean.values()), float)
                f, starts = features(names)
                per_byte = np.repeat(times, np.diff(np.append(starts, f.shape[1])))
                for n in range(ORDER):
                    own[: BUCKETS + 1] += np.bincount(f[n], per_byte, BUCKETS + 1)
                own[BUCKETS + 1 :] += np.bincount([script_of(w) for w in names], times * [len(w) for w in names], len(_NAMES))
        for lang, own in sums.items():
            own[BUCKETS] = 0
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": own[at]})

    rows = drawn.mapInPandas(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((BUCKETS + 1 + len(_NAMES), len(languages)))
    at = {k: i for i, k in enumerate(languages)}
    for r in rows:
        counts[r["bucket"], at[r["lang"]]] = r["n"]
    grams, letters = counts[:BUCKETS] + 0.5, counts[BUCKETS + 1 :]
    weights = np.vstack([np.log(grams / grams.sum(0)), np.zeros(len(languages))])
    return Model(languages, weights, letters >= np.maximum(SCRIPT_SHARE * letters.sum(0), 1e-9))


def viterbi(scores: np.ndarray, index: np.ndarray, lengths: np.ndarray, switch: float, cells: int = CELLS) -> np.ndarray:
    """Best language of each word: word j has scores[index[j]]; documents lie one after the other with these lengths (none 0), longest first.

    Back pointers are kept for about cells words times languages at a time. Where there
    are more, the steps are cut into blocks: the scores at each block's start are kept, and the blocks
    are run once more from the last to the first for their pointers. The path is the same.
    """
    n_docs, n_lang = len(lengths), scores.shape[1]
    starts = np.cumsum(lengths) - lengths
    steps = int(lengths[0]) if n_docs else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # documents longer than step t
    kind = np.min_scalar_type(max(n_lang - 1, 0))
    own = np.arange(n_lang, dtype=kind)
    last = np.empty(n_docs, np.int64)
    path = np.empty(len(index), kind)
    before = np.concatenate([[0], np.cumsum(active)])  # words in the steps before t
    rows = max(1, cells // max(1, n_lang))
    cuts = [0]
    while cuts[-1] < steps:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(before, before[cuts[-1]] + rows, side="right")) - 1))

    def forward(lo: int, hi: int, v: np.ndarray, back: np.ndarray | None) -> np.ndarray:
        for t in range(lo, hi):
            a = active[t]
            at = starts[:a] + t
            if not t:
                v = scores[index[at]].copy()
                continue
            if a < len(v):
                last[a : len(v)] = v[a:].argmax(1)
                v = v[:a]
            best = v.argmax(1)
            jump = v[np.arange(a), best] - np.float32(switch)
            if back is not None:
                back[before[t] - before[lo] : before[t + 1] - before[lo]] = np.where(jump[:, None] > v, best[:, None].astype(kind), own)
            v = np.maximum(v, jump[:, None]) + scores[index[at]]
        return v

    kept, v = [], np.zeros((n_docs, n_lang), np.float32)
    for lo, hi in zip(cuts, cuts[1:-1]):
        kept.append(v)
        v = forward(lo, hi, v, None)
    kept.append(v)
    for k in range(len(cuts) - 2, -1, -1):
        lo, hi = cuts[k], cuts[k + 1]
        back = np.empty((before[hi] - before[lo], n_lang), kind)
        v = forward(lo, hi, kept.pop(), back)
        if hi == steps:
            last[: len(v)] = v.argmax(1)
        for t in range(hi - 1, lo - 1, -1):
            a = active[t]
            path[starts[:a] + t] = last[:a]
            if t:
                last[:a] = back[np.arange(a) + before[t] - before[lo], last[:a]]
    return path


class Labeller:
    """Scores of the words met so far, by word."""

    def __init__(self, model: Model, switch: float):
        self.model, self.switch = model, switch
        # What is kept for each word is as wide as the languages are many.
        self.room = min(1.0, 64 / max(1, len(model.languages)))
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.weight = np.zeros(0, np.int64)

    def _learn(self, words: set[str]) -> None:
        fresh = list(words)
        clean = [letters_of(w) for w in fresh]
        found = np.zeros((len(fresh), self.scores.shape[1]), np.float32)
        step = max(1, int(LEARNED * self.room))
        for lo in range(0, len(fresh), step):
            part = clean[lo : lo + step]
            if some := [w for w in part if w]:
                found[lo : lo + step][[bool(w) for w in part]] = self.model.score(some)
        self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh))))
        self.scores = np.vstack([self.scores, found])
        self.weight = np.concatenate([self.weight, [len(w) for w in clean]]).astype(np.int64)

    def label(self, texts: list[str | None]) -> Iterator[tuple[str, float, list]]:
        """(language or und, score, spans) for each text; a span is (language, first word, last word), words as split at white space."""
        if len(self.at) > REMEMBERED * self.room:
            self._forget()
        words = [(t or "").lower().split() for t in texts]
        if unknown := set().union(*words).difference(self.at):
            self._learn(unknown)
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        get = self.at.__getitem__
        index = np.fromiter((i for d in order for i in map(get, words[d])), np.int64, int(lengths.sum()))
        del words
        path = viterbi(self.scores, index, lengths[order], self.switch, CELLS)
        n_lang = self.scores.shape[1]
        ends = np.cumsum(lengths[order])
        doc = np.repeat(np.arange(len(order)), lengths[order])
        share = np.bincount(doc * n_lang + path.astype(np.int64), self.weight[index], len(order) * n_lang).reshape(-1, n_lang)
        out: list = [(UNKNOWN, 0.0, [])] * len(texts)
        for k, d in enumerate(order):
            letters = share[k].sum()
            if not letters:
                continue
            lo, hi = ends[k] - lengths[d], ends[k]
            step = max(1, CELLS // max(1, n_lang))
            total = sum(self.scores[index[x : min(x + step, hi)]].sum(0, dtype=np.float64) for x in range(lo, hi, step))
            best = int(share[k].argmax())
            sure = 1.0 / np.exp(np.clip(total - total[best], -700, 700)).sum()
            cuts = np.flatnonzero(np.diff(path[lo:hi])) + 1
            spans = [(self.model.languages[path[lo + a]], int(a), int(b) - 1) for a, b in zip([0, *cuts], [*cuts, hi - lo])]
            out[d] = (self.model.languages[best], float(share[k][best] / letters * min(1.0, sure)), spans)
        return iter(out)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """docs plus lang_pred, score (0 to 1) and lang_spans, which replace columns of these names.

    Each word's script narrows the languages, the n-grams of the word
    score them, and the cheapest path over the words with a penalty for each
    change labels spans; the language with most letters is the
    document's, its score that share times the probability of the language among all by all words.
    Null text, text without a letter (empty ones too), or a model without languages: und,
    score 0, no spans. Ties go to the language that comes first by name. Repeated rows and null ids: labelled each. Very long texts are labelled whole, their paths in blocks of words.
    Empty table: no rows. All other columns are carried, whatever their names. Nothing is shuffled; only one group of texts is held in memory.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_spans")]
    # By place, that no name of a column needs to be quoted below.
    rows, own_text = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)]), f"c{kept.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(shared.value, switch)
        for b in batches:
            texts, found = iter(b.column(own_text)), []
            while len(found) < b.num_rows:
                group, size = [], 0
                for t in texts:
                    group.append(t.as_py())
                    if (size := size + len(group[-1] or "")) >= GROUP_CHARS * own.room:
                        break
                found += own.label(group) if own.model.languages else [(UNKNOWN, 0.0, [])] * len(group)
            spans = [[{"lang": a, "first_word": i, "last_word": j} for a, i, j in x[2]] for x in found]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(spans, kind)],
                names=[*b.schema.names, "lang_pred", "score", "lang_spans"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(
        run, f"{schema}, lang_pred string, score double, lang_spans array<struct<lang:string,first_word:bigint,last_word:bigint>>"
    ).toDF(*kept, "lang_pred", "score", "lang_spans")


def held_out(id_col: Column) -> Column:
    """The third of the rows that nothing is learned from, by the checksum of the id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))
