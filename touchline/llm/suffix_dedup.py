"""Removal of repeated byte strings by prefix-free parsing and sorted suffixes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialise, quoted, shared_dir

#: Bytes of a repeated string, and of the rolling hash's window.
LENGTH, WINDOW = 50, 20
#: Bytes of text in a pack, in a block hashed at once, and for which a bucket of triggers or of phrases is planned.
PACK, BLOCK, TRIGGER_BYTES, PHRASE_BYTES = 8 << 20, 1 << 18, 64 << 20, 8 << 20
#: A trigger in more packs than this has its phrases cut to single strings, which are dealt by content instead of by trigger.
HOT_PACKS = 4096
#: Order of texts without an id: after all others.
LAST = np.iinfo(np.int64).max

PACKS = "pack bigint, bytes bigint, ids binary, lens binary, body binary"
REPLY = "pack bigint, bucket int, kind int, body binary"
_FACTOR = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays, one after the other, compressed, with their bytes before them."""
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def spread(body: bytes) -> bytes:
    return pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)


def rolling(text: np.ndarray) -> np.ndarray:
    """A hash of each WINDOW bytes, put together from hashes of 16 and 4."""
    part, held = _BYTE[text], {}
    for width in (1, 2, 4, 8):
        held[width] = part
        part = part[:-width] * np.uint64(pow(_FACTOR, width, 1 << 64)) + part[width:]
    n = len(text) - WINDOW + 1
    h = part[:n] * np.uint64(pow(_FACTOR, 4, 1 << 64)) + held[4][16 : 16 + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


@dataclass
class Parse:
    """Phrases of a pack: the trigger's hash, the first and last string start (places in the pack) and the text's number."""

    trigger: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray


def parse(body: np.ndarray, lens: np.ndarray) -> Parse:
    """Each string of LENGTH bytes that lies in one text belongs to the phrase of its trigger.

    A trigger is a place of least rolling hash (leftmost of several) among the windows of some string, so
    that every string holds one and equal strings hold it at the same place: no phrase
    end is missed wherever a string stands, which is what prefix-free means here. A phrase is the text
    from the first string of a trigger to the end of its last.
    """
    ends = np.cumsum(lens)
    none = np.empty(0, np.int64)
    found = [(np.empty(0, np.uint64), none, none)]
    reach = LENGTH - WINDOW + 1
    for lo in range(0, len(body) - LENGTH + 1, BLOCK):
        text = body[lo : lo + BLOCK + LENGTH - 1]
        h = rolling(text)
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        for width in (1, 2, 4, 8):
            least = np.minimum(least[:-width], least[width:])
        at = (np.minimum(least[: len(h) - reach + 1], least[reach - 16 :][: len(h) - reach + 1]) & _PLACE).astype(np.int64)
        place = np.arange(lo, lo + len(at))
        one, two = np.searchsorted(ends, [lo, lo + len(at)], side="right")
        inside = np.ones(len(at), bool)
        for end in ends[one : two + 1]:  # strings that cross the end of a text
            inside[max(0, end - LENGTH + 1 - lo) : max(0, end - lo)] = False
        at, place = at[inside], place[inside]
        if len(at):
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)]))
            found.append((h[at[new]], place[new], place[np.append(new[1:], len(at)) - 1]))
    trigger, first, last = (np.concatenate(x) for x in zip(*found))
    return Parse(trigger, first, last, np.searchsorted(ends, first, side="right"))


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, Parse]:
    """ids, lens and bytes of a pack, and its parse."""
    ids, lens = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64)
    body = np.frombuffer(spread(row["body"]), np.uint8)
    return ids, lens, body, parse(body, lens)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, body) as packs of PACK bytes or one text; part of the number is the task's, so that a committed table has it once."""
    at = TaskContext.get().partitionId() << 33

    def row(ids: list, bodies: list) -> pa.RecordBatch:
        nonlocal at
        at += 1
        lens = np.array([len(b) for b in bodies], np.int64)
        keys = np.array([LAST if i is None else i for i in ids], np.int64)
        nulls = np.array([i is None for i in ids], np.int8)
        columns = [at - 1, int(lens.sum()), np.concatenate([keys, nulls.astype(np.int64)]).tobytes(), lens.tobytes(), squeeze(np.frombuffer(b"".join(bodies), np.uint8))]
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names=[c.split()[0] for c in PACKS.split(", ")])

    ids: list = []
    bodies: list = []
    size = 0
    for b in batches:
        for i, text in zip(b.column("id").to_pylist(), b.column("body")):
            text = text.as_buffer().to_pybytes()
            if ids and size + len(text) > PACK:
                yield row(ids, bodies)
                ids, bodies, size = [], [], 0
            ids.append(i)
            bodies.append(text)
            size += len(text)
    if ids:
        yield row(ids, bodies)


def trigger_keys(found: Parse, buckets: int) -> np.ndarray:
    """Bucket and 31 bits of each trigger in one number."""
    return (((found.trigger >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) << 31) | (found.trigger & np.uint64(2**31 - 1)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[lo]), slice(lo, hi)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], names=[n for n, _ in names])


def repeated(g: pa.Table, hot_packs: int) -> pa.Table:
    """For each pack's triggers of a bucket 0, 1 where another text has it too, 2 where more than hot_packs packs have it."""
    packs, bucket = g.column("pack").to_pylist(), g.column("bucket")[0].as_py()
    parts = [np.frombuffer(spread(b), np.uint32) for b in g.column("body").to_pylist()]
    every = np.concatenate(parts)
    _, of, n = np.unique(every >> np.uint32(1), return_inverse=True, return_counts=True)
    more = np.bincount(of, weights=every & np.uint32(1)) + n > 1
    flags = (more.astype(np.uint8) + (n > hot_packs))[of]
    cuts = np.cumsum([0, *(len(p) for p in parts)])
    return pa.Table.from_batches([_batch([(p, bucket, 0, squeeze(flags[lo:hi])) for p, lo, hi in zip(packs, cuts[:-1], cuts[1:])], REPLY)])


@dataclass
class Phrases:
    """Distinct candidate phrases of a pack by bucket, and for each occurrence (first, last, text, phrase)."""

    bucket: np.ndarray
    words: pa.Array
    least: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    phrase: np.ndarray


def phrases(ids: np.ndarray, body: np.ndarray, found: Parse, flags: np.ndarray, buckets: tuple[int, int]) -> Phrases:
    """The phrases whose trigger is repeated, each once with the least id that has it.

    Those of a hot trigger are cut to their single strings and dealt by these, so that no
    number of texts around one trigger comes to one task.
    """
    _, of = np.unique(trigger_keys(found, buckets[0]), return_inverse=True)
    flag = flags[of] if len(of) else np.empty(0, np.uint8)
    take = np.flatnonzero(flag > 0)
    first, last, text, trigger, hot = found.first[take], found.last[take], found.text[take], found.trigger[take], flag[take] == 2
    times = np.where(hot, last - first + 1, 1)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    hot = np.repeat(hot, times)
    first, last = np.repeat(first, times) + nth, np.where(hot, np.repeat(first, times) + nth, np.repeat(last, times))
    text, trigger = np.repeat(text, times), np.repeat(trigger, times)
    size = last - first + LENGTH
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = body[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)]
    if not len(first):
        none = np.empty(0, np.int64)
        return Phrases(none, pa.array([], pa.large_binary()), none, first, last, text, none)
    whole = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    coded = whole.dictionary_encode()
    code, n = coded.indices.to_numpy(), len(coded.dictionary)
    least = np.full(n, LAST)
    np.minimum.at(least, code, ids[text])
    bucket = np.empty(n, np.int64)
    bucket[code] = ((trigger >> np.uint64(8)) % np.uint64(buckets[1])).astype(np.int64)
    if hot.any():
        for c in np.unique(code[hot]):
            bucket[c] = zlib.crc32(coded.dictionary[c].as_py()) % buckets[1]
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return Phrases(bucket[order], coded.dictionary.take(pa.array(order)), least[order], first, last, text, rank[code])


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of binaries."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def equal_strings(body: np.ndarray, starts: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each suffix (its start in body) the least value of those that share its first LENGTH bytes.

    Suffixes are sorted by 8 bytes at a time, as numbers in which the first byte weighs most; a suffix that no
    other shares so far has its final place and drops out, the others are sorted on within
    their ties. The result is the suffix array as far as LENGTH bytes decide it.
    """
    out = value.copy()
    words = np.ndarray(shape=(max(0, len(body) - 7),), dtype=">u8", buffer=body.tobytes(), strides=(1,))
    left, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        if not len(left):
            return out
        word = words[starts[left] + depth].astype(np.uint64)
        order = np.lexsort((word, group)) if depth else np.argsort(word, kind="stable")
        left, word, group = left[order], word[order], group[order]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (group[1:] != group[:-1])])
        tied = ~(new & np.append(new[1:], True))
        left, group = left[tied], (np.cumsum(new) - 1)[tied]
    if len(left):
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[left] = np.repeat(np.minimum.reduceat(value[left], heads), np.diff(np.append(heads, len(left))))
    return out


def ordered(g: pa.Table) -> pa.Table:
    """For each pack's phrases of a bucket, as bits from the first string on: a text of smaller id has it.

    The dictionary holds each phrase once with the least id of any pack; its suffixes of LENGTH bytes
    and more, which are the strings that start in the phrase, are put in corpus order.
    """
    packs, bucket = g.column("pack").to_pylist(), g.column("bucket")[0].as_py()
    lens, least, data, counts = [], [], [], []
    for row in g.column("body").to_pylist():
        raw = spread(row)
        n = int.from_bytes(raw[:8], "little")
        counts.append(n)
        least.append(np.frombuffer(raw, np.int64, n, 8))
        lens.append(np.frombuffer(raw, np.uint8, n, 8 + 8 * n))
        data.append(raw[8 + 9 * n :])
    size, ids = np.concatenate(lens).astype(np.int64), np.concatenate(least)
    offsets = np.concatenate([[0], np.cumsum(size)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))]).dictionary_encode()
    code = coded.indices.to_numpy()
    best = np.full(len(coded.dictionary), LAST)
    np.minimum.at(best, code, ids)
    begin, body = _bytes_of(coded.dictionary)
    strings = np.diff(begin) - LENGTH + 1
    head = np.cumsum(strings) - strings
    starts = np.arange(strings.sum()) + np.repeat(begin[:-1] - head, strings)
    value = equal_strings(body, starts, np.repeat(best, strings))
    # Back to each pack's own phrases.
    times = size - LENGTH + 1
    top = np.cumsum(times) - times
    nth = np.arange(times.sum()) - np.repeat(top, times)
    smaller = value[np.repeat(head[code], times) + nth] < np.repeat(ids, times)
    masks = np.bitwise_or.reduceat(smaller.astype(np.uint32) << nth.astype(np.uint32), top)
    cuts = np.cumsum([0, *counts])
    return pa.Table.from_batches([_batch([(p, bucket, 1, squeeze(masks[lo:hi])) for p, lo, hi in zip(packs, cuts[:-1], cuts[1:])], REPLY)])


def replies(g: pa.Table, kind: int, dtype: type) -> np.ndarray:
    """A pack's replies of a kind in the order of the buckets."""
    rows = sorted((b, x) for b, k, x in zip(g.column("bucket").to_pylist(), g.column("kind").to_pylist(), g.column("body").to_pylist()) if k == kind)
    return np.concatenate([np.empty(0, dtype), *(np.frombuffer(spread(x), dtype) for _, x in rows)])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot_packs: int = HOT_PACKS) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and kept: the bytes left.

    A byte goes if it is covered by a string of LENGTH bytes, within its text, that also
    starts in a row of a smaller id; spans are maximal runs of such bytes.

    Texts are written once in compressed packs. (1) Rolling-hash triggers cut each text into phrases;
    of each pack only the triggers' fingerprints, sorted, go to buckets, which reply
    which of them some other text holds too. (2) The phrases of these triggers, each once a pack with
    the least id that has it, are the dictionary; in its buckets the
    suffixes are put in corpus order, in which equal strings stand together, and the least id of each is known. A phrase
    carries the bytes that end its last string, so that the order of what follows a phrase,
    which the suffix array of the parse would give, is read from the dictionary as far as LENGTH bytes need it; the parse
    itself stays with the packs, whose phrases get the replies in their own order. Comparisons are of
    bytes; a fingerprint can only let a phrase be compared in vain. Packs are rejoined by their number;
    work grows with the text, and copies of any number are one phrase a pack.

    Null text: empty. Null id: after all ids, and rows of equal or null id never shorten each other, repeated rows included.
    Texts shorter than LENGTH: kept. Very long texts: a pack of their own. Empty table: no rows. Other columns, whatever their names, are not carried.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    body = F.encode(F.coalesce(quoted(text_col), F.lit("")), "UTF-8")
    packs = materialise(docs.select(quoted(id_col).cast("bigint").alias("id"), body.alias("body")).mapInArrow(packed, PACKS), "packs")
    size = packs.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(32, ceil(size / TRIGGER_BYTES)), max(64, ceil(size / PHRASE_BYTES))

    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            ids, _, _, found = opened(row)
            key, owner = trigger_keys(found, buckets[0]), ids[: len(ids) // 2][found.text]
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head) if len(key) else np.empty(0, bool)
            print_ = ((key[head] & (2**31 - 1)) << 1 | several).astype(np.uint32)
            out = [(row["pack"], b, 0, squeeze(print_[part])) for b, part in _by_bucket(key[head] >> 31)]
            if out:
                yield _batch(out, REPLY)

    def candidates(pack: pa.Table, reply: pa.Table) -> pa.Table:
        out = []
        for row in pack.to_pylist():
            ids, _, text, found = opened(row)
            p = phrases(ids[: len(ids) // 2], text, found, replies(reply, 0, np.uint8), buckets)
            begin, data = _bytes_of(p.words)
            for b, part in _by_bucket(p.bucket):
                n = part.stop - part.start
                lens = np.diff(begin[part.start : part.stop + 1]).astype(np.uint8)
                out.append((row["pack"], b, 1, squeeze(np.array([n]), p.least[part], lens, data[begin[part.start] : begin[part.stop]])))
        return pa.Table.from_batches([_batch(out, REPLY)])

    def shortened(pack: pa.Table, reply: pa.Table) -> pa.Table:
        out = []
        for row in pack.to_pylist():
            ids, lens, text, found = opened(row)
            ids, null = np.split(ids, 2)
            p = phrases(ids, text, found, replies(reply, 0, np.uint8), buckets)
            mask = replies(reply, 1, np.uint32)[p.phrase].astype(np.int64)
            # A text after the pack's least has every string of the phrase behind it.
            mask[ids[p.text] > p.least[p.phrase]] = -1
            times = p.last - p.first + 1
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            gone = (np.repeat(mask, times) >> nth) & 1 == 1
            at = (np.repeat(p.first, times) + nth)[gone]
            step = np.zeros(len(text) + 1, np.int32)
            step[at] += 1
            step[at + LENGTH] -= 1
            covered = np.cumsum(step[:-1]) > 0
            ends = np.cumsum(lens)
            for i, none, lo, hi in zip(ids.tolist(), null.tolist(), (ends - lens).tolist(), ends.tolist()):
                off = covered[lo:hi]
                kept = text[lo:hi][~off].tobytes()
                spans = int(off[:1].sum() + (off[1:] & ~off[:-1]).sum())
                out.append((None if none else i, hi - lo, hi - lo - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        return pa.Table.from_batches([_batch(out, result)])

    result = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    prints = packs.mapInArrow(triggers, REPLY)
    told = materialise(prints.groupBy("bucket").applyInArrow(lambda g: repeated(g, hot_packs), REPLY), "triggers")
    dictionary = packs.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(candidates, REPLY)
    order = materialise(dictionary.groupBy("bucket").applyInArrow(ordered, REPLY), "phrases")
    out = packs.groupBy("pack").cogroup(told.unionByName(order).groupBy("pack")).applyInArrow(shortened, result)
    return out.withColumnRenamed("id", id_col)
