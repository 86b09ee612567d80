from pyspark.sql import functions as F

from touchline import report
from touchline.plans import refresh
from touchline.sources.catalog import Catalog
from touchline.streaming import snapshots, windows

SCHEMA = "ts timestamp, player_id int, cost int"


def rows(spark, values):
    return spark.createDataFrame(values, "ts string, player_id int, cost int").withColumn("ts", F.col("ts").cast("timestamp"))


def test_snapshots_keep_the_last_reading(spark, tmp_path):
    landed, target, check = (str(tmp_path / x) for x in ("landed", "target", "check"))
    rows(spark, [("2026-01-01 09:00:00", 1, 50), ("2026-01-01 09:00:00", 2, 60)]).write.parquet(landed)
    snapshots.start(spark, landed, SCHEMA, target, check).awaitTermination()
    rows(spark, [("2026-01-01 09:00:00", 1, 51), ("2026-01-02 09:00:00", 1, 52)]).write.mode("append").parquet(landed)
    snapshots.start(spark, landed, SCHEMA, target, check).awaitTermination()
    snapshots.start(spark, landed, SCHEMA, target, check).awaitTermination()
    got = {(str(r.ts), r.player_id): r.cost for r in snapshots.read(spark, target).collect()}
    assert got == {("2026-01-01 09:00:00", 1): 51, ("2026-01-01 09:00:00", 2): 60, ("2026-01-02 09:00:00", 1): 52}


def test_stream_equals_batch(spark, tmp_path):
    landed = str(tmp_path / "events")
    batch = rows(spark, [(f"2026-01-0{d} 0{h}:10:00", h % 2, d) for d in (1, 2) for h in range(5)])
    batch.write.parquet(landed)
    total = dict(n=F.count("*"), total=F.sum("cost"))
    stream = spark.readStream.schema(SCHEMA).parquet(landed)
    streamed = windows.drain(windows.tumbling(stream, "2 hours", ["player_id"], late="1 hour", **total), "stream_equals_batch")
    assert sorted(streamed.collect()) == sorted(windows.tumbling(batch, "2 hours", ["player_id"], **total).collect())
    slid = windows.tumbling(batch, "2 hours", ["player_id"], slide="1 hour", **total)
    assert slid.agg(F.sum("n")).first()[0] == 20
    assert windows.sessions(batch, "90 minutes", ["player_id"], n=F.count("*")).agg(F.sum("n")).first()[0] == 10
    assert windows.first_seen(batch, ["player_id"], "1 hour").isStreaming is False


def test_reports(spark):
    df = spark.createDataFrame([("<b>", 1.5, None)], "name string, value double, other int")
    page = report.html_report("T & T", {"Prices": df, "Gone": None})
    assert "&lt;b&gt;" in page and "<b>" not in page and "T &amp; T" in page and "not available" in page
    text = report.text_report({"Block": df}).split("\n")
    assert text[0] == "Block" and text[3].split() == ["<b>", "1.50", "-"]
    assert (report.countdown(-1), report.countdown(3700), report.countdown(90000)) == ("passed", "1h 1m", "1d 1h")


def test_refresh(spark, tmp_path):
    import json

    boot = {"elements": [{"id": 1, "web_name": "A", "first_name": "A", "second_name": "B", "team": 1, "element_type": 3, "now_cost": 55, "status": "a", "selected_by_percent": "1.0", "minutes": 90}],
            "teams": [{"id": 1, "name": "Arsenal", "short_name": "ARS"}], "events": [{"id": 1, "deadline_time": "2026-08-21T17:30:00Z", "finished": True}]}
    (tmp_path / "bootstrap.json").write_text(json.dumps(boot))
    (tmp_path / "fixtures-1.json").write_text(json.dumps([{"id": 1, "event": 1, "stats": []}]))
    live = {"elements": [{"id": 1, "stats": {"minutes": 90, "total_points": 2}, "explain": [{"fixture": 1, "stats": [{"identifier": "minutes", "points": 2, "value": 90}]}]}]}
    (tmp_path / "live-1.json").write_text(json.dumps(live))
    store, landed = Catalog(spark, str(tmp_path / "store")), str(tmp_path)
    done, code = refresh.run_jobs({
        "prices": lambda: refresh.take_prices(store, landed, "2026-08-21 09:00:00"), "again": lambda: refresh.take_prices(store, landed, "2026-08-21 09:00:00"),
        "game": lambda: refresh.load_game(store, landed), "live": lambda: refresh.load_live(store, landed, [1]), "pages": lambda: 1 / 0,
    }, frozenset({"pages"}))
    assert code == 0 and done["pages"].startswith("ZeroDivisionError") and done["game"] == done["again"] == "ok"
    assert store.load("prices/history").count() == 1 and refresh.load_live(store, landed, [1]) == 0
    assert refresh.run_jobs({"x": lambda: 1 / 0})[1] == 1
