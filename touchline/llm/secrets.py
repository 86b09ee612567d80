"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, quoted

#: Fixed patterns and least lengths of the base kinds, in the order in which spans of equal start are listed.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 or more characters: a shorter run holds none
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 or more
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
#: Parts that count only next to their complements.
WEAK_ACCESS = r"""(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{8,13}(?![A-Z0-9])|((?i)access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,})"""
WEAK_SECRET = r"""(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"""
WEAK_VALUE = 6
ENDPOINT = r"""(?<![A-Za-z0-9])(?:((?i)https?|ftp|amqp|redis|postgres(?:ql)?|mysql|mongodb)://[^\x20\x09-\x0D"'<>]+|((?i)endpoint|host|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,})"""
#: Parts within this many code points of each other are in one scope.
SCOPE = 256

#: Elements of an array that one aggregate appends to its result; appending copies what is there.
CHUNK = 256

_SPAN = "struct<start:bigint,kind:int,stop:bigint,value:bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value worked out once: an expression inside a lambda is worked out for each element."""
    return F.transform(F.array(value), body)[0]


def _chunks(array: Column) -> Column:
    last = lambda a: F.greatest(F.ceil(F.size(a) / CHUNK).cast("int") - 1, F.lit(0))
    return _let(array, lambda a: F.transform(F.sequence(F.lit(0), last(a)), lambda i: F.slice(a, i * CHUNK + 1, F.lit(CHUNK))))


def _running(array: Column, zero: Column, state: str, step: Callable[[Column, Column], Column], give: Callable[[Column, Column], Column], kind: str) -> Column:
    """give(state before x, x) for each x of the array, the state going on by step(state, x); in time that grows with the array.

    The states at the heads of chunks come first, from aggregates that
    keep nothing; then each chunk's results are appended to a short array of its own.
    """
    none = lambda k: F.coalesce(F.lit(None).cast(f"array<{k}>"), F.array().cast(f"array<{k}>"))
    heads = lambda chunks: F.aggregate(
        chunks, F.struct(zero.cast(state).alias("s"), none(state).alias("out")),
        lambda acc, c: F.struct(F.aggregate(c, acc["s"], lambda s, x: step(s, x).cast(state)).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")),
    )["out"]
    within = lambda z: F.aggregate(
        z["c"], F.struct(z["s"].alias("s"), none(kind).alias("out")),
        lambda acc, x: F.struct(step(acc["s"], x).cast(state).alias("s"), F.concat(acc["out"], F.array(give(acc["s"], x).cast(kind))).alias("out")),
    )["out"]
    return _let(_chunks(array), lambda chunks: F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), heads(chunks).alias("s")), within)))


def _spans(text: Column, pattern: str, kind: int, value_group: int | None = None) -> Column:
    """Array of (start, kind, stop, value's length) of the leftmost non-overlapping matches, in code points.

    What split() leaves and what regexp_extract_all() finds are the same
    matcher's gaps and hits, so running sums of their lengths are offsets.
    """
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(value_group)) if value_group else hits
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x).cast("bigint"))
    parts = F.arrays_zip(
        lengths(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))).alias("gap"), lengths(hits).alias("hit"), lengths(values).alias("value")
    )
    spans = _running(
        parts, F.lit(0), "bigint", lambda at, x: at + x["gap"] + x["hit"],
        lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["hit"]).alias("stop"), x["value"].alias("value")), _SPAN,
    )
    # Most texts hold no match; then only the search for one is paid for.
    return F.coalesce(F.when(text.rlike(pattern), spans), F.array().cast(f"array<{_SPAN}>"))


#: Which spans are parts of which complement: login names, secrets, places.
_SIDES = ((1, 3), (0, 4), (5,))
_FLAGS = "struct<a:boolean,b:boolean,c:boolean>"


def _beside(parts: Column, scope: int) -> Column:
    """For each of the parts, sorted by start, whether a login name, a secret or a place is within the scope: an interval join in two sweeps.

    One that starts before a part reaches it if the latest stop so far does,
    one that starts after it if the nearest start to come does.
    """
    is_side = lambda x, side: x["kind"].isin(*side)
    named = lambda values: F.struct(*[v.alias(n) for v, n in zip(values, "abc")])
    far = 1 << 40
    edges = "struct<a:bigint,b:bigint,c:bigint>"
    back = _running(
        parts, named([F.lit(-far)] * 3), edges, lambda s, x: named([F.when(is_side(x, k), F.greatest(s[n], x["stop"])).otherwise(s[n]) for k, n in zip(_SIDES, "abc")]),
        lambda s, x: named([s[n] > x["start"] - scope for n in "abc"]), _FLAGS,
    )
    ahead = _running(
        F.reverse(parts), named([F.lit(far)] * 3), edges, lambda s, x: named([F.when(is_side(x, k), x["start"]).otherwise(s[n]) for k, n in zip(_SIDES, "abc")]),
        lambda s, x: named([s[n] < x["stop"] + scope for n in "abc"]), _FLAGS,
    )
    return F.transform(F.arrays_zip(back.alias("back"), F.reverse(ahead).alias("ahead")), lambda z: named([z["back"][n] | z["ahead"][n] for n in "abc"]))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def scan(docs: DataFrame, *, text_col: str = "text", scope: int = SCOPE, spans_col: str = "secret_spans") -> DataFrame:
    """docs plus secret_spans (array of start, kind, stop, value), sorted by start, then kind.

    Base kinds (assign, access, hex) always stand. Weak parts (login names
    and short access keys, short assigned values and bare 40-character
    tokens, endpoints) are joined with the intervals of their complements
    inside the document and reported only where these co-occur within
    scope code points: an access part with a secret, a secret with an
    access part or endpoint, an endpoint with both. The join is two sweeps over a
    document's sorted parts inside the row, so nothing is shuffled, copies or hot sources cost
    what their own text costs, and the time grows with a text's length and spans. Null and empty texts: no spans. Ties: spans of equal start by kind. Repeated
    rows and null ids: scanned each. Empty table: no rows. All columns are carried, whatever their names; one named spans_col is replaced.
    """
    names = fresh(docs, "assigned", "access", "hexes", "user", "bare", "place", "parts")
    assigned, access, hexes, user, bare, place, parts = names
    text = F.coalesce(quoted(text_col), F.lit(""))
    found = docs.withColumns({
        assigned: _spans(text, ASSIGN, 0, 2), access: _spans(text, ACCESS, 1), hexes: _spans(text, HEX, 2),
        user: _spans(text, WEAK_ACCESS, 3), bare: _spans(text, WEAK_SECRET, 4), place: _spans(text, ENDPOINT, 5),
    })
    strong = F.filter(assigned, lambda x: x["value"] >= ASSIGN_VALUE)
    short = F.transform(
        F.filter(assigned, lambda x: (x["value"] >= WEAK_VALUE) & (x["value"] < ASSIGN_VALUE)),
        lambda x: F.struct(x["start"], F.lit(4).alias("kind"), x["stop"], x["value"]),
    )
    found = found.withColumn(parts, F.when(F.size(user) + F.size(bare) + F.size(place) + F.size(short) > 0, F.array_sort(F.concat(strong, access, F.col(user), F.col(bare), short, F.col(place)))))
    linked = F.filter(
        F.arrays_zip(F.col(parts).alias("part"), _beside(F.col(parts), scope).alias("by")),
        lambda z: ((z["part"]["kind"] == 3) & z["by"]["b"]) | ((z["part"]["kind"] == 4) & (z["by"]["a"] | z["by"]["c"])) | ((z["part"]["kind"] == 5) & z["by"]["a"] & z["by"]["b"]),
    )
    base = F.concat(strong, access, F.col(hexes))
    spans = F.array_sort(F.when(F.col(parts).isNotNull(), F.concat(base, F.transform(linked, lambda z: z["part"]))).otherwise(base))
    return found.withColumn(spans_col, spans).drop(*names)


def redact(docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs with every reported span of the text replaced by mask; overlapping spans are one.

    Texts without spans stay as they are, null and empty ones too; ties, repeated rows and very long texts are as in scan().
    Empty table: no rows. All columns are carried, whatever their names.
    """
    (spans_col,) = fresh(docs, "spans")
    text, spans = quoted(text_col), F.col(spans_col)
    # What is kept: from the furthest stop so far to each start; null where spans overlap.
    kept = _running(spans, F.lit(0), "bigint", lambda at, s: F.greatest(at, s["stop"]), lambda at, s: F.struct(at.alias("start"), s["start"].alias("stop")), "struct<start:bigint,stop:bigint>")
    # Chunks of them are cut from the text first, for substring() counts from its first argument's start.
    cut = F.transform(
        _chunks(F.filter(kept, lambda x: x["stop"] >= x["start"])),
        lambda c: F.transform(
            F.array(F.struct(F.substring(text, c[0]["start"].cast("int") + 1, (F.element_at(c, -1)["stop"] - c[0]["start"]).cast("int")).alias("text"), c[0]["start"].alias("at"))),
            lambda own: F.array_join(F.transform(c, lambda x: F.concat(F.substring(own["text"], (x["start"] - own["at"]).cast("int") + 1, (x["stop"] - x["start"]).cast("int")), F.lit(mask))), ""),
        )[0],
    )
    end = F.array_max(F.transform(spans, lambda s: s["stop"]))
    whole = F.concat(F.array_join(cut, ""), F.substring(text, end.cast("int") + 1, F.length(text)))
    return scan(docs, text_col=text_col, scope=scope, spans_col=spans_col).withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text)).drop(spans_col)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: id, counts of the base kinds, base_sha256, spans and n_weak (linked weak parts).

    Nulls, empty and very long texts, ties and repeated rows: as in scan(). Empty table: no rows. Other columns, whatever their names, are not carried.
    """
    s = scan(docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")), scope=scope)
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    return s.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.filter("secret_spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("secret_spans")).alias("spans"),
        F.size(F.filter("secret_spans", lambda x: x["kind"] > 2)).cast("long").alias("n_weak"),
    )
