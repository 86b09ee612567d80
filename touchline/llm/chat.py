"""Chat formatting as a prefix tree: shared turns are emitted once, depth-first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialise, quoted, shared_dir

#: The template's own control strings, and others that a text may hold; none appears in an escaped text.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (
    TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: Bytes of a digest that names a turn's content or a node.
DIGEST = 16
#: Code points of the stream that one part of a read-back holds, at least, of its own.
PART_CHARS = 16 << 20


def escape(text: str) -> str:
    """A backslash doubled, and one put after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text begins and ends in it, in code points."""
    head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse_segment(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, _, body = formatted.removeprefix(TURN).partition(TEXT)
    return unescape(role), unescape(body.removesuffix(END))


def _digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()[:DIGEST]


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def tree(conversations: DataFrame, *, conv_col: str = "conv_id", loss_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the prefix tree of conversations(conv, turn, role, text).

    nodes, one row for each different beginning of a conversation: node
    (digest of the turns up to it), depth, segment (its last turn, formatted),
    start and stop (its place in the one emitted stream, in code points),
    position (the code points of its ancestors, which is its first position id),
    attends (the intervals of the stream that hold its ancestors, in order; it
    attends to these and to itself), run_start, ends (whether a conversation ends here),
    loss_start and loss_stop (the span of its text in the segment if the role is
    loss_role, else null). ends, one row per conversation: conv, n_turns and node.

    The stream is depth-first at any depth. A run is a stretch of the tree
    without a fork; a node's key is the digests of the heads of the runs
    on its path, so that the order of (key, depth) is depth-first and as long as the
    forks passed, not the turns. A run is one interval of the stream, so
    a node attends to as many intervals as it has runs on its path.

    All of this is worked out on digests and lengths; a conversation is streamed in turn order
    through a running digest, so its length is not bounded by memory, and equal
    nodes are merged by partial aggregation, so a first turn that a third of all
    share costs a row a task. The texts are shuffled once, by content, to be joined
    with the nodes; emitted() sorts the result into the stream.

    Null role and text: empty. Null turns come first; ties are ordered by role, then by the text's SHA-256.
    Very long texts are segments of their own. Rows of null conv are one conversation. Repeated rows: repeated
    turns. Empty table: no rows. Other columns, whatever their names, are not carried.
    """
    shared_dir(conversations.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(quoted(conv_col).cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    facts = pa.schema([
        ("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text_sha", pa.binary()), ("content", pa.binary()), ("length", pa.int64()),
        ("loss_start", pa.int64()), ("loss_stop", pa.int64()),
    ])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "text"))):
                formatted, lo, hi = segment(role, text)
                own = (lo, hi) if role == loss_role else (None, None)
                out.append((conv, turn, role, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), _digest(formatted.encode("utf-8", "surrogatepass")), len(formatted), *own))
            yield _batch(out, facts)

    links = pa.schema([
        ("conv", pa.int64()), ("depth", pa.int64()), ("parent", pa.binary()), ("node", pa.binary()), ("content", pa.binary()), ("length", pa.int64()), ("position", pa.int64()),
        ("loss_start", pa.int64()), ("loss_stop", pa.int64()), ("ends", pa.bool_()),
    ])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for b in batches:
            for conv, content, length, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv", "content", "length", "loss_start", "loss_stop"))):
                if last is None or conv != last[0]:
                    if last:
                        out.append((*last, True))
                    depth, parent, position = 0, None, 0
                else:
                    out.append((*last, False))
                    depth, parent, position = last[1] + 1, last[3], last[6] + last[5]
                last = (conv, depth, parent, _digest(parent or b"", content), content, length, position, lo, hi)
            yield _batch(out, links)
            out = []
        if last:
            yield _batch([(*last, True)], links)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key = object(), b""
        for b in batches:
            keys = []
            for conv, node, head in zip(*(b.column(c).to_pylist() for c in ("conv", "node", "head"))):
                if conv != at:
                    at, key = conv, b""
                if head:
                    key += node
                keys.append(key)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(keys, pa.binary())], names=[*b.schema.names[:-1], "key"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            starts = []
            for n in b.column("length").to_pylist():
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(starts, pa.int64())], names=[*b.schema.names, "part", "local"])

    narrow = rows.mapInArrow(measured, "conv bigint, turn bigint, role string, text_sha binary, content binary, length bigint, loss_start bigint, loss_stop bigint")
    ordered = narrow.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text_sha")
    turns = materialise(
        ordered.mapInArrow(
            chained, "conv bigint, depth bigint, parent binary, node binary, content binary, length bigint, position bigint, loss_start bigint, loss_stop bigint, ends boolean"
        ),
        "turns",
    )
    forks = materialise(turns.where("parent is not null").select("parent", "node").distinct().groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select("parent", F.lit(True).alias("fork")), "forks")
    headed = turns.join(forks, "parent", "left").select(
        "conv", "depth", "node", "content", "length", "position", "loss_start", "loss_stop", "ends", (F.col("parent").isNull() | F.col("fork").isNotNull()).alias("head")
    )
    kept = "conv bigint, depth bigint, node binary, content binary, length bigint, position bigint, loss_start bigint, loss_stop bigint, ends boolean"
    keys = headed.repartition("conv").sortWithinPartitions("conv", "depth").mapInArrow(keyed, f"{kept}, key binary")
    merged = keys.groupBy("node").agg(F.bool_or("ends").alias("ends"), *[F.first(c).alias(c) for c in ("depth", "content", "length", "position", "loss_start", "loss_stop", "key")])
    stream = merged.repartitionByRange("key", "depth").sortWithinPartitions("key", "depth")
    local = materialise(
        stream.mapInArrow(
            placed, "node binary, ends boolean, depth bigint, content binary, length bigint, position bigint, loss_start bigint, loss_stop bigint, key binary, part int, local bigint"
        ),
        "places",
    )
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = materialise(local.groupBy("part").agg(F.sum("length").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "parts")
    start = F.col("first") + F.col("local")
    head = F.substring("key", F.length("key") - DIGEST + 1, F.lit(DIGEST))
    nodes = local.join(parts, "part").withColumns({"start": start, "stop": start + F.col("length"), "run": head})
    runs = materialise(nodes.groupBy("run").agg(F.min("start").alias("run_start"), F.max("stop").alias("run_stop"), F.first("key").alias("key")), "runs")
    above = runs.where(F.length("key") > DIGEST).select(
        F.col("run").alias("of"), F.explode(F.transform(F.sequence(F.lit(0), (F.length("key") / DIGEST).cast("int") - 2), lambda i: F.substring("key", i * DIGEST + 1, F.lit(DIGEST)))).alias("run")
    )
    intervals = above.join(runs, "run").groupBy("of").agg(F.array_sort(F.collect_list(F.struct(F.col("run_start").alias("start"), F.col("run_stop").alias("stop")))).alias("above"))
    runs = materialise(
        runs.join(intervals, F.col("run") == F.col("of"), "left")
        .select("run", "run_start", F.coalesce("above", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("above")), "run-intervals",
    )
    own = F.when(F.col("start") > F.col("run_start"), F.array(F.struct(F.col("run_start").alias("start"), F.col("start").alias("stop")))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    nodes = materialise(
        nodes.join(runs, "run").select("node", "content", "depth", "start", "stop", "position", F.concat("above", own).alias("attends"), "run_start", "ends", "loss_start", "loss_stop"), "nodes"
    )

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [segment(r, t)[0] for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary()), pa.array(texts, pa.string())], names=["content", "segment"]
            )

    contents = rows.select("role", "text").mapInArrow(formatted, "content binary, segment string").groupBy("content").agg(F.first("segment").alias("segment"))
    # A left join with unique contents: what reads only places never touches a text.
    return (
        nodes.join(contents, "content", "left").select("node", "depth", "segment", "start", "stop", "position", "attends", "run_start", "ends", "loss_start", "loss_stop"),
        turns.where("ends").select("conv", (F.col("depth") + 1).alias("n_turns"), "node"),
    )


def emitted(nodes: DataFrame) -> DataFrame:
    """The nodes of tree() as the stream: range-partitioned and sorted by their place. Empty: empty."""
    return nodes.repartitionByRange("start").sortWithinPartitions("start")


def read_back(nodes: DataFrame, ends: DataFrame, *, part_chars: int = PART_CHARS) -> DataFrame:
    """Per conversation, from the emitted nodes: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and attends.

    The stream is read depth-first in parts that begin with a run. Running
    digests are kept at the forks of the path, so a shared turn is read once
    for all who share it, and what a part needs from before it, the runs that its first
    node attends to, is read ahead of it. Each conversation
    takes what was read where it ends. attends are the merged intervals that its
    last turn sees, itself included. ValueError where a position does not follow its
    ancestors' code points. Null conv: a conversation as others. Empty: no rows.
    """
    shared_dir(nodes.sparkSession)
    part = lambda c: F.floor(F.col(c) / part_chars)
    interval = "array<struct<start:bigint,stop:bigint>>"
    runs = materialise(
        nodes.where("start = run_start").groupBy(part("run_start").alias("part")).agg(F.min_by("attends", "start").alias("attends"))
        .select("part", F.explode("attends").alias("a")).groupBy(F.col("a.start").alias("run")).agg(F.collect_list("part").alias("parts")), "read-ahead",
    )
    own = part("run_start")
    dealt = (
        nodes.join(runs, F.col("run_start") == F.col("run"), "left")
        .withColumn("part", F.explode(F.array_union(F.array(own), F.coalesce("parts", F.array().cast("array<bigint>")))))
        .select("part", "start", "stop", "node", "segment", "position", "attends", "run_start", (F.col("ends") & (F.col("part") == own)).alias("ends"), "loss_start", "loss_stop")
    )
    read = pa.schema([
        ("node", pa.binary()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
        ("attends", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ])

    def merged(intervals: list[dict]) -> list[dict]:
        out: list[dict] = []
        for i in intervals:
            if out and out[-1]["stop"] == i["start"]:
                out[-1] = {"start": out[-1]["start"], "stop": i["stop"]}
            else:
                out.append(i)
        return out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("part", "start", "stop", "node", "segment", "position", "attends", "run_start", "ends", "loss_start", "loss_stop")
        at, run, stack, state = None, None, [], None
        for b in batches:
            out = []
            for of, start, stop, node, formatted, position, attends, own_run, ends_here, lo, hi in zip(*(b.column(c).to_pylist() for c in names)):
                if of != at:
                    at, run, stack, state = of, None, [], None
                if own_run != run:
                    if state:
                        stack.append((run, state))
                    above = attends[-1]["start"] if attends else None
                    while stack and stack[-1][0] != above:
                        stack.pop()
                    if stack:
                        turns, loss, chars, total = stack[-1][1]
                        state = [turns.copy(), loss.copy(), chars, total]
                    else:
                        state = [hashlib.sha256(), hashlib.sha256(), 0, 0]
                    run = own_run
                if position != state[3]:
                    raise ValueError(f"the turn at {start}: position {position} after {state[3]} code points")
                role, text = parse_segment(formatted)
                state[0].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    masked = unescape(formatted[lo:hi])
                    state[1].update(masked.encode("utf-8", "surrogatepass"))
                    state[2] += len(masked)
                state[3] += len(formatted)
                if ends_here:
                    out.append((node, state[0].hexdigest(), state[2], state[1].hexdigest(), state[3], merged([*attends, {"start": start, "stop": stop}])))
            yield _batch(out, read)

    found = dealt.repartition("part").sortWithinPartitions("part", "start").mapInArrow(
        walk, f"node binary, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, attends {interval}"
    )
    return ends.join(found, "node").select("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attends")
