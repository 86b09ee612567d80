"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialise, quoted, shared_dir

#: Words whose ids a Python worker remembers; beyond it starts again.
REMEMBERED = 1_000_000
#: New words encoded as one text.
JOINED = 512
#: Texts encoded together, about this many bytes.
GROUP_BYTES = 2 << 20
#: Lengths up to this part of the capacity are kept from exact fills for the gaps that best fit leaves.
SHORT = 1 / 8
#: In so many parts exact fills may be given back to best fit, the last found first.
STEPS = 16
#: Texts that any tokenizer must encode word by word to be accepted.
PROBES = ("Two words, and 3.5 more!", "  leading\ttabs\nand lines  ", "don't (stop) here... ÄÖÜ naïve 日本語 x;y?", "UPPER lower MiXed 12,000;")

_encoders: dict[str, "WordEncoder"] = {}
_TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: An ASCII letter or digit, or a letter of two bytes from Latin-1 Supplement and Latin Extended-A, but for the one whose lower case ends in a mark.
_ALNUM = re.compile(rb"(?:[A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])\Z")


class WordEncoder:
    """Ids of texts, by way of remembered ids of their white-space separated words.

    For a tokenizer that drops white space and merges nothing across it (word_bpe_49k),
    a text's ids are its words' ids one after the other. A trailing run of
    punctuation after a Latin letter or a digit is a word of its own to it. Another tokenizer
    is refused (ValueError) where PROBES show that this does not hold for it.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[bytes, bytes] = {}
        for sample in PROBES:
            if np.frombuffer(next(self.encode([sample])), "<u4").tolist() != self.tokenizer.encode(sample, add_special_tokens=False).ids:
                raise ValueError(f"{path}: a text's ids are not its words' ids")

    @classmethod
    def of(cls, path: str | None) -> "WordEncoder":
        """The worker's own; a worker keeps it from task to task."""
        if (key := path or "") not in _encoders:
            _encoders[key] = cls(path)
        return _encoders[key]

    @staticmethod
    def words(text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        # Lower case is what the tokenizer makes of it anyway, but for special tokens.
        return (raw if b"<|" in raw else raw.lower()).split()

    def _learn(self, words: set[bytes]) -> None:
        ends: dict[bytes, tuple[bytes, bytes]] = {}
        plain: set[bytes] = set()
        for w in words:
            core = w.rstrip(_TAIL)
            if core != w and _ALNUM.search(core):
                ends[w] = core, w[len(core) :]
                plain.update(ends[w])
            else:
                plain.add(w)
        fresh = [w.decode("utf-8", "replace") for w in plain if w not in self.ids]
        groups = [fresh[lo : lo + JOINED] for lo in range(0, len(fresh), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4").tobytes()
            sizes = np.fromiter(map(len, group), np.int64, len(group)) + 1
            first = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            cuts = [*(4 * np.searchsorted(first, np.cumsum(sizes) - sizes)).tolist(), len(ids)]
            self.ids.update((w.encode("utf-8"), ids[a:z]) for w, a, z in zip(group, cuts, cuts[1:]))
        for w, (core, tail) in ends.items():
            self.ids[w] = self.ids[core] + self.ids[tail]

    def encode(self, texts: Iterable) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text (Arrow string scalars or strings); null is empty."""
        rest = iter(texts)
        while True:
            group, size = [], 0
            for t in rest:
                t = (t.as_py() if isinstance(t, pa.Scalar) else t) or ""
                group.append(self.words(t))
                if (size := size + len(t)) >= GROUP_BYTES:
                    break
            if not group:
                return
            if len(self.ids) > REMEMBERED:
                self.ids.clear()
            if unknown := set().union(*group).difference(self.ids):
                self._learn(unknown)
            get = self.ids.__getitem__
            for words in group:
                yield b"".join(map(get, words))


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, tokenizer: str | None) -> DataFrame:
    """A row per piece: id, piece, start, length, crc, its rank among the task's pieces of that length, and the number of its row of docs."""
    shared_dir(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder.of(tokenizer), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        seen, before = np.zeros(capacity + 1, np.int64), part << 40
        for b in batches:
            rows: list[tuple[int, ...]] = []
            for place, ids in enumerate(encoder.encode(b.column("text"))):
                ids += end
                for k, at in enumerate(range(0, len(ids), capacity * 4)):
                    own = ids[at : at + capacity * 4]
                    n = len(own) // 4
                    rows.append((place, k, at // 4, n, zlib.crc32(own), part, seen[n], before + place))
                    seen[n] += 1
            before += b.num_rows
            of, *numbers = np.array(rows, np.int64).reshape(-1, 8).T
            kinds = (np.int32, np.int64, np.int64, np.int64, np.int32, np.int64, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(of)), *(pa.array(x.astype(t)) for x, t in zip(numbers, kinds))],
                names=["id", "piece", "start", "length", "crc", "part", "rank", "row"],
            )

    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, crc bigint, part int, rank bigint, row bigint")


class SumIndex:
    """Lengths with their availability counts, and how many (ordered) choices of one, two and three of them add up to each sum."""

    def __init__(self, have: np.ndarray):
        self.have = have
        self.one = (have > 0).astype(np.int64)
        self.two = np.convolve(self.one, self.one)[: len(have)]
        self.three = np.convolve(self.two, self.one)[: len(have)]

    def take(self, used: tuple[int, ...], times: int) -> None:
        """Use each of these lengths as often; sums of a length used up leave the index."""
        for x in used:
            self.have[x] -= times
        for x in set(used):
            if not self.have[x] and self.one[x]:
                up = lambda v, by: np.concatenate([np.zeros(by, np.int64), v])[: len(v)]
                nothing = np.zeros(len(self.one), np.int64)
                nothing[0] = 1
                self.three += 3 * (up(self.one, 2 * x) - up(self.two, x)) - up(nothing, 3 * x)
                self.two += up(nothing, 2 * x) - 2 * up(self.one, x)
                self.one[x] = 0

    def pair(self, total: int, beside: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """The most unequal available pair of this sum, next to the lengths already chosen."""
        spare = lambda x: self.have[x] - beside.count(x)
        longer = np.arange((total + 1) // 2, total)
        for a in longer[(self.one[longer] > 0) & (self.one[total - longer] > 0)][::-1].tolist():
            if spare(a) > 0 and spare(total - a) > (a == total - a):
                return a, total - a
        return None

    def complement(self, length: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three further available lengths that fill the gap beside this one exactly."""
        if gap == 0:
            return ()
        if self.have[gap] > (gap == length):
            return (gap,)
        if self.two[gap] and (found := self.pair(gap, (length,))):
            return found
        if self.three[gap]:
            firsts = np.arange(1, gap)
            for a in firsts[(self.one[firsts] > 0) & (self.two[gap - firsts] > 0)][::-1].tolist():
                if self.have[a] > (a == length) and (found := self.pair(gap - a, (length, a))):
                    return a, *found
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins for counts[length] items of each length: (lengths of a bin, number of such bins).

    From the longest down, an item's gap is looked up among the single
    lengths, the sums of two and the sums of three; a combination that
    fills it exactly is used as often as all of its lengths last, which
    uses up at least one length, so there are at most capacity such
    kinds of bins. Lengths of at most SHORT of the capacity are not spent on exact
    fills: the items that find no exact complement go best-fit decreasing, and it is
    the short ones that fill the gaps which those leave. Where exact fills of small items still
    take what longer ones need, the last of them are given back to best fit: of the
    first 0, 1 ... STEPS of STEPS parts of the exact fills, as many stand as give the fewest bins.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    short = np.where(np.arange(capacity + 1) <= SHORT * capacity, have, 0)
    index = SumIndex(have - short)
    bins: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while index.have[length]:
            found = index.complement(length, capacity - length)
            if found is None:
                break
            used = (length, *found)
            times = min(int(index.have[x]) // used.count(x) for x in set(used))
            bins.append((used, times))
            index.take(used, times)
    rest = index.have + short
    plans, stand = [], bins
    for step in range(STEPS, -1, -1):
        stand, back = bins[: len(bins) * step // STEPS], stand[len(bins) * step // STEPS :]
        for used, times in back:
            for x in used:
                rest[x] += times
        plans.append(stand + best_fit({x: int(n) for x, n in enumerate(rest) if n}, capacity))
    return min(plans, key=lambda kinds: sum(n for _, n in kinds))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: the longest first, each into the fullest bin that holds it, equal bins together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = min((g for g in open_bins if g >= length), default=None)
            if gap is None:
                each = min(left, capacity // length)
                many, used = left // each, (length,) * each
                open_bins.setdefault(capacity - length * each, []).append((used, many))
                left -= many * each
                continue
            used, many = open_bins[gap].pop()
            take = min(left, many)
            if many > take:
                open_bins[gap].append((used, many - take))
            if not open_bins[gap]:
                del open_bins[gap]
            open_bins.setdefault(gap - length, []).append(((*used, length), take))
            left -= take
    return [b for kinds in open_bins.values() for b in kinds]


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    tokenizer: str | None = None,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, row, sequence_id and offset.

    A document is its text's ids, then end_id; one longer than capacity
    is cut into pieces of capacity, the last maybe shorter. Pieces of equal length
    are interchangeable, so bins are planned from the counts of at most
    capacity lengths (all that reaches the driver) and pieces are dealt to them by
    their rank among those of their length: the rank in their task plus
    the counts of earlier tasks. A hot length is thus never gathered.

    row numbers the rows of docs (any numbers), so that a document that is there several times is told from its
    repetitions. Null and empty text: the single id end_id. Null and repeated ids, repeated rows: rows
    of their own. Very long texts: cut, never shortened. Ties of length: any order. Empty table: no rows. Other columns, whatever their names, are not carried.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, id_col, text_col, capacity, end_id, tokenizer), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, sequences, offsets = [], [], []
    dealt: dict[int, int] = {}
    first = 0
    for used, times in plan(counts, capacity):
        at = 0
        for x in used:
            keys.append((x << 48) + dealt.get(x, 0))
            sequences.append(first)
            offsets.append(at)
            dealt[x] = dealt.get(x, 0) + times
            at += x
        first += times
    order = np.argsort(np.array(keys, np.int64))
    runs = spark.sparkContext.broadcast(tuple(np.array(v, np.int64)[order] for v in (keys, sequences, offsets)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = runs.value
        for b in batches:
            key = (b.column("length").to_numpy() << 48) + b.column("rank").to_numpy()
            run = np.searchsorted(keys, key, side="right") - 1
            *kept, _ = b.columns
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequences[run] + key - keys[run]), pa.array(offsets[run])], names=[*b.schema.names[:-1], "sequence_id", "offset"]
            )

    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ahead = (
        cut.groupBy("part", "length").agg(F.count("*").alias("n"))
        .select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    )
    ranked = cut.join(ahead, ["part", "length"]).select(
        F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "row", (F.col("ahead") + F.col("rank")).alias("rank")
    )
    kind = ranked.schema.fields[0].dataType.simpleString()
    return ranked.mapInArrow(
        place, f"`{id_col.replace('`', '``')}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint, sequence_id bigint, offset bigint"
    )
