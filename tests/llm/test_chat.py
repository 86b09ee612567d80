import hashlib

import pytest
from pyspark.sql import functions as F

from touchline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
HELLO = "hello \\ there"


def place(r):
    return r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).digest()


def convs():
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, "user", "of null"), (90, None, None, None), (90, 1, "assistant", "")]
    for c in range(12):
        rows += [(c, 0, "system", HELLO), (c, 1, "user", f"question {c % 3}"), (c, 2, "assistant", f"answer {c % 2} <|end|>\\"), (c, 3, "user", "é😀\n<|text|>"), (c, 3, "assistant", f"{c % 4}")]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", "long") for t in range(300)]
    # Six that share 64 turns and part below, some again at the 70th.
    for c in range(200, 206):
        rows += [(c, t, "user", f"shared {t}") for t in range(64)] + [(c, t, "assistant", f"own {c % 3}") for t in range(64, 70)] + [(c, t, "user", f"last {c}") for t in range(70, 73)]
    return rows


@pytest.mark.parametrize("text", ["", "\\", "\\\\n", "</s>", "<\\/s>", "<</SYS>><<|end|>", "[INST][INST]", "<|turn|><|text|>", "plain é😀", "<|en" + "d|>\\"])
def test_escape(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not chat._CONTROL.search(out)
    assert chat.parse_segment(chat.segment(text, text)[0]) == (text, text)


@pytest.mark.parametrize("part_chars", [64, chat.PART_CHARS])
def test_read_back(spark, part_chars):
    df = spark.createDataFrame(convs(), SCHEMA).withColumn("node", F.lit("clash"))
    nodes, ends = chat.tree(df)
    got = {r.conv: r for r in chat.read_back(nodes, ends, part_chars=part_chars).collect()}
    by = {}
    for c, t, role, text in sorted(convs(), key=place):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        masked = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(masked))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(masked.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.segment(a, b)[0]) for a, b in turns) == sum(x.stop - x.start for x in r.attends)


def test_tree_is_emitted_once_depth_first(spark):
    rows = sorted(chat.emitted(chat.tree(spark.createDataFrame(convs(), SCHEMA))[0]).collect(), key=lambda r: r.start)
    prefixes = set()
    for c in {r[0] for r in convs()}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((x for x in convs() if x[0] == c), key=place)]
        prefixes |= {tuple(turns[:n]) for n in range(1, len(turns) + 1)}
    assert len(rows) == len(prefixes)
    at, open_ = 0, []
    for r in rows:
        assert r.start == at and r.stop - r.start == len(r.segment)
        at = r.stop
        open_ = open_[: r.depth]  # a node follows its parent or a subtree beside it
        assert len(open_) == r.depth and r.position == sum(z - a for a, z in open_)
        assert {x for i in r.attends for x in range(i.start, i.stop)} == {x for a, z in open_ for x in range(a, z)}
        open_.append((r.start, r.stop))
        if r.loss_start is not None:
            role, text = chat.parse_segment(r.segment)
            assert role == "assistant" and chat.unescape(r.segment[r.loss_start : r.loss_stop]) == text
    none = chat.tree(spark.createDataFrame([], SCHEMA))
    assert none[0].count() == 0 and chat.read_back(*none).count() == 0
