"""Registered queries on keyed streams, paged sources, payloads without a schema and elements of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import drift, paged, pages
from ..storage import scratch
from ..streaming import keyed
from .registry import Star, query

#: Days of a landed slice, how late a reading may come, and after what time a player is quiet.
SLICE_DAYS, LATE_HOURS, QUIET_HOURS = 8, 6, 48
#: Orders of a landed page.
PAGE = 2000


@query(f"""WITH e AS (SELECT user_id, event_id, ts, value, CAST(epoch_ms(ts) AS BIGINT) AS ms, CAST(date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) // {SLICE_DAYS} + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS BIGINT) AS s FROM events),
    w AS (SELECT s, max(max(ms)) OVER (ORDER BY s) - {LATE_HOURS} * 3600000 AS mark FROM e GROUP BY s),
    a AS (SELECT e.* FROM e LEFT JOIN w ON w.s = e.s - 1 WHERE mark IS NULL OR ms > mark),
    l AS (SELECT *, lag(s) OVER o AS ps, lag(ms) OVER o AS pms, lag(value) OVER o AS pv, lead(s) OVER o AS ns FROM a WINDOW o AS (PARTITION BY user_id ORDER BY s, ts, event_id))
    SELECT user_id, event_id, l.ts, value, CASE WHEN ps < l.s AND b.mark >= pms + {QUIET_HOURS} * 3600000 THEN NULL ELSE pv END AS previous, 'reading' AS kind FROM l LEFT JOIN w AS b ON b.s = l.s - 1
    UNION ALL SELECT user_id, event_id, l.ts, value, NULL, 'quiet' FROM l JOIN w ON w.s = coalesce(ns - 1, (SELECT max(s) FROM w)) WHERE (ns IS NULL OR ns > l.s) AND mark >= ms + {QUIET_HOURS} * 3600000""")
def price_readings(s: Star) -> DataFrame:
    """Each player's reading beside the last one, from slices that land one after the other, some readings a slice late; each run starts anew from the checkpoint of the one before."""
    events = s.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    first = events.agg(F.min("ts").cast("date").alias("day"))
    at = (F.datediff(F.col("ts").cast("date"), "day") / SLICE_DAYS).cast("int") + F.when(F.col("event_id") % 37 == 0, 1).otherwise(0)
    sliced = events.crossJoin(F.broadcast(first)).withColumn("slice", at).drop("day")
    landed, target, checkpoint = (scratch(s.spark, f"readings-{x}") for x in ("landed", "rows", "checkpoint"))
    for k in range((sliced.agg(F.max("slice")).first()[0] or 0) + 1):
        sliced.where(F.col("slice") == k).drop("slice").write.parquet(f"{landed}/{k}")
        run = keyed.take_readings(s.spark, f"{landed}/*", "user_id bigint, event_id bigint, ts timestamp, value double", target, checkpoint, late=f"{LATE_HOURS} hours", quiet_ms=QUIET_HOURS * 3600000)
        run.awaitTermination()
    return s.spark.read.schema(keyed.OUT).parquet(target).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""SELECT CAST(o_orderkey // {PAGE} AS INT) AS page, o_orderkey AS entry, o_custkey AS rank, CAST(round(o_totalprice * 100) AS BIGINT) AS total, NULL AS error FROM orders
    UNION ALL SELECT NULL, NULL, NULL, NULL, 'JSONDecodeError' FROM (SELECT min(o_orderkey) FROM orders)""")
def paged_standings(s: Star) -> DataFrame:
    """Orders landed as pages of a league's standings, and one page cut off in the middle."""
    result = F.struct(F.col("o_orderkey").alias("entry"), F.col("o_custkey").alias("rank"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total"))
    rows = s.orders.select(F.floor(F.col("o_orderkey") / PAGE).cast("int").alias("page"), result.alias("r"))
    whole = rows.groupBy("page").agg(F.collect_list("r").alias("results")).select("page", F.to_json(F.struct(F.struct("page", F.lit(True).alias("has_next"), "results").alias("standings"))).alias("value"))
    cut = s.orders.agg(F.min("o_orderkey")).select(F.lit(-1).alias("page"), F.lit('{"standings": {"page": 1, "results": [{"entry": ').alias("value"))
    folder = scratch(s.spark, "pages")
    whole.unionByName(cut).write.partitionBy("page").text(folder)
    paged.register(s.spark)
    out = s.spark.read.format(paged.NAME).option("path", folder).load()
    return out.withColumn("error", F.element_at(F.split("error", ": "), -1))


_PAYLOAD = """CASE WHEN event_id % 5 = 0 THEN concat('{"k": "', json_extract_string(props, '$.k'), '", "v": {"x": [', CAST(event_id % 7 AS VARCHAR(9)), ', 2]}}') WHEN event_id % 11 = 0 THEN '{"k": ' ELSE props END"""


def _drifting(s: Star) -> DataFrame:
    """Events whose payload has three forms: k as a number, k as text beside a nested v, and broken JSON."""
    k = F.get_json_object("props", "$.k")
    late = F.concat(F.lit('{"k": "'), k, F.lit('", "v": {"x": ['), (F.col("event_id") % 7).cast("string"), F.lit(", 2]}}"))
    text = F.when(F.col("event_id") % 5 == 0, late).when(F.col("event_id") % 11 == 0, '{"k": ').otherwise(F.col("props"))
    return drift.opened(s.events.select("event_id", text.alias("props")), "props")


@query(f"""WITH p AS (SELECT event_id, CASE WHEN json_valid(t) THEN t END AS t FROM (SELECT event_id, {_PAYLOAD} AS t FROM events) AS q)
    SELECT event_id, TRY_CAST(json_extract_string(t, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(t, '$.v.x[0]') AS INT) AS x, CAST(json_extract_string(t, '$.gone') AS VARCHAR) AS gone FROM p""")
def drifting_props(s: Star) -> DataFrame:
    return drift.typed(_drifting(s), {"k": ("$.k", "bigint"), "x": ("$.v.x[0]", "int"), "gone": ("$.gone", "string")}).select("event_id", "k", "x", "gone")


@query("""SELECT CASE WHEN event_id % 5 = 0 THEN 'OBJECT<k: STRING, v: OBJECT<x: ARRAY<BIGINT>>>' WHEN event_id % 11 = 0 THEN NULL ELSE 'OBJECT<k: BIGINT>' END AS shape, count(*) AS n FROM events GROUP BY 1""")
def payload_shapes(s: Star) -> DataFrame:
    return drift.shapes(_drifting(s))


@query("""SELECT event_id, CAST(unnest([event_id % 7, 2]) AS BIGINT) AS x FROM events WHERE event_id % 5 = 0""")
def payload_elements(s: Star) -> DataFrame:
    return drift.exploded(_drifting(s), "payload", "$.v.x", "x").select("event_id", F.col("x").cast("bigint").alias("x"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS t, regexp_extract_all(html, '(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS x FROM pages),
    h AS (SELECT page_id, regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS t, regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS x FROM pages),
    e AS (SELECT page_id, 'link' AS kind, unnest(range(1, len(t) + 1)) AS i, t, x, '' AS p FROM l UNION ALL SELECT page_id, 'heading', unnest(range(1, len(t) + 1)), t, x, 'h' FROM h)
    SELECT page_id, kind, CAST(i AS INT) AS place, concat(p, t[i]) AS target, regexp_replace(x[i], '<[^>]*>', '', 'g') AS text FROM e""")
def page_elements(s: Star) -> DataFrame:
    return pages.page_elements(s.pages.select("page_id", "html"), "page_id")
