"""python -m touchline COMMAND: refresh, prices, project, backtest, reconcile, movers, risks, league, brief, tables, decide."""

from __future__ import annotations

import argparse
import datetime as dt
import glob
import sys

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .operators.rates import STATS
from .session import session


def _so_far(store) -> DataFrame:
    """Counts of the running season by player."""
    return store.load("game/live_stats").groupBy(F.col("element").alias("id")).agg(*[F.sum(c).alias(c) for c in STATS])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="touchline")
    parser.add_argument("command", choices=("refresh", "prices", "project", "backtest", "reconcile", "movers", "risks", "league", "brief", "tables", "decide"))
    parser.add_argument("--root", required=True, help="folder of the stored tables")
    parser.add_argument("--landed", help="folder of landed documents")
    parser.add_argument("--gws", default="", help="gameweeks, as 1,2,3")
    parser.add_argument("--entry", type=int, help="the user's entry")
    parser.add_argument("--season", help="season of a backtest, as 2025-26")
    parser.add_argument("--sims", type=int, default=2000)
    parser.add_argument("--out", help="file to write")
    a = parser.parse_args(argv)
    from . import report
    from .operators import bonus, monitor, optimise, reconcile, state
    from .plans import briefs, projection, refresh
    from .sources import payloads as P
    from .sources.catalog import Catalog

    spark = session()
    store = Catalog(spark, a.root)
    gws = [int(g) for g in a.gws.split(",") if g]
    now = dt.datetime.now(dt.timezone.utc).replace(microsecond=0, tzinfo=None).isoformat(sep=" ")
    if a.command in ("refresh", "prices"):
        jobs = {"prices": lambda: refresh.take_prices(store, a.landed, now)}
        if a.command == "refresh":
            jobs |= {"game": lambda: refresh.load_game(store, a.landed), "live": lambda: refresh.load_live(store, a.landed, gws),
                     "history": lambda: refresh.load_history(store, a.landed), "provider": lambda: refresh.load_provider(store, a.landed), "pages": lambda: refresh.load_pages(store, a.landed)}
        # A blocked page, or archives that have not landed, do not fail a refresh.
        done, code = refresh.run_jobs(jobs, frozenset({"history", "provider", "pages"}))
        print("\n".join(f"{k}: {v}" for k, v in done.items()))
        return code
    if a.command == "tables":
        text = "\n".join(f"{n:40s} {rows:>10d} rows {cols:>4d} columns" for n, rows, cols in store.describe()) + "\n"
    elif a.command == "project":
        played = store.load("game/live_stats").agg(P.F.max("gw").alias("g")).first()["g"] or 0
        out = projection.project(
            store.load("game/elements").join(_so_far(store), "id", "left").na.fill(0), store.load("game/teams"), store.load("game/fixtures"), store.load("game/live_stats").select("element", "minutes", "starts"),
            store.load("history/merged_gw"), gws, pd.Timestamp(now), n_gws=int(played), n_sims=a.sims,
        )
        name = f"projections/gw{min(gws)}-{max(gws)}"
        store.save(out, name)
        text = report.text_block(name, store.load(name).orderBy(P.F.desc("ep"), "player_id").select("player_id", "gw", "ep", "sd", "p10", "p90").limit(25))
    elif a.command == "backtest":
        done = projection.run_backtest(store.load("history/merged_gw"), [(a.season, g) for g in gws], n_sims=a.sims)
        text = report.text_report({"Errors": done["errors"], "Calibration": done["calibration"]})
    elif a.command == "reconcile":
        both = reconcile.rebuilt_points(store.load("game/live_explain"), store.load("game/live_stats"))
        scores = bonus.bonus_from_fixture_stats(store.load("game/fixture_stats"))
        given = store.load("game/fixture_stats").where("identifier = 'bonus'").select("fixture", "element", P.F.col("value").alias("bonus"))
        text = report.text_report({
            "Points that do not add up": both.where("total_points <> rebuilt"), "Fixtures by bonus": reconcile.reconcile_bonus(scores.drop("bonus"), given).groupBy("agrees").count(),
        })
    elif a.command == "brief":
        panel = lambda name, f: f(store.load(name)) if store.exists(name) else None
        as_text = lambda df, c: df.withColumn(c, P.F.col(c).cast("string"))
        coming = lambda df: df.where(P.F.col("event").isin(*gws)) if gws else df
        squad = None
        if a.entry and glob.glob(f"{a.landed}/picks-{a.entry}-*.json") and store.exists("game/elements"):
            held = P.league_tables(P.read_json(spark, f"{a.landed}/picks-{a.entry}-*.json", P.PICKS), P.read_json(spark, f"{a.landed}/history-*.json", P.HISTORY), P.read_json(spark, f"{a.landed}/standings.json", P.STANDINGS))["picks"]
            last = held.where(P.F.col("entry") == a.entry).agg(P.F.max("gw").alias("gw")).first()["gw"]
            squad = briefs.squad_rows(held, store.load("game/elements"), store.load("game/teams"), a.entry, last)
        text = report.html_report("Brief", {
            "Deadline": panel("game/events", lambda df: briefs.deadline(as_text(df, "deadline_time"), min(gws)) if gws else None),
            "Squad": squad,
            "Fixtures": panel("game/fixtures", lambda df: briefs.fixture_rows(as_text(coming(df), "kickoff_time"), store.load("game/teams"))),
            "Price movers": panel("prices/history", lambda df: monitor.movers(monitor.latest_snapshot(df)).select("web_name", "now_cost", "proj_pct_today", "direction")),
            "Risks": panel("game/elements", lambda df: monitor.scan_risks(df.withColumn("team", P.F.col("team_short")), len(gws)).select("severity", "web_name", "team", "kind", "detail").limit(20)),
            "Projections": panel(store.newest("projections") or "projections/none", lambda df: df.orderBy(P.F.desc("ep"), "player_id").limit(25)),
        })
    elif a.command == "movers":
        text = report.text_block("Price movers", monitor.movers(monitor.latest_snapshot(store.load("prices/history"))).select("web_name", "now_cost", "proj_pct_today", "direction"))
    elif a.command == "risks":
        text = report.text_block("Risks", monitor.scan_risks(store.load("game/elements").withColumn("team", P.F.col("team_short")), len(gws)).select("severity", "web_name", "team", "kind", "detail"))
    elif a.command == "league":
        tables = P.league_tables(
            P.read_json(spark, f"{a.landed}/picks-*.json", P.PICKS), P.read_json(spark, f"{a.landed}/history-*.json", P.HISTORY), P.read_json(spark, f"{a.landed}/standings.json", P.STANDINGS)
        )
        gw = max(gws)
        moves = P.read_json(spark, f"{a.landed}/transfers-*.json", P.TRANSFERS) if glob.glob(f"{a.landed}/transfers-*.json") else None
        if moves is not None:
            tables["transfers"] = moves.where("entry is not null").withColumnRenamed("event", "gw")
        played = store.load("game/live_stats").select("gw", "element", P.F.col("total_points").alias("points"), "minutes")
        players = store.load("game/elements").select(P.F.col("id").alias("element"), P.F.col("web_name").alias("name"), P.F.col("team_short").alias("team"), "position")
        final = P.final_gameweeks(store.load("game/fixtures"), store.load("game/events"))
        blocks = briefs.league_blocks(tables, players, played, final, a.entry, gw, remaining=38 - gw)
        text = report.text_report(blocks)
    else:
        # A pool of 20 a position and the squad held are all that the driver gets.
        ahead = store.load(store.newest("projections"))
        picks = P.read_json(spark, f"{a.landed}/picks-{a.entry}-*.json", P.PICKS)
        boot = P.read_json(spark, f"{a.landed}/bootstrap.json", P.BOOTSTRAP, ("elements",))
        moves = P.read_json(spark, f"{a.landed}/transfers-{a.entry}.json", P.TRANSFERS).where("entry is not null")
        me = state.manager_state(boot, P.read_json(spark, f"{a.landed}/history-{a.entry}.json", P.HISTORY), picks, moves).first()
        owned = spark.createDataFrame([(int(p.element),) for p in me.squad], "player_id long")
        pool = state.candidate_pool(ahead, 20, owned).select("player_id")
        frame = ahead.join(pool, "player_id", "left_semi").toPandas()
        begin = optimise.Start(tuple(int(p.element) for p in me.squad), me.bank, me.free, {int(p.element): p.selling for p in me.squad})
        first = int(frame["gw"].min())
        options = {"hold": {}} | {c.chip: {first: c.chip} for c in me.chips if c.left}
        record = optimise.compare_options(frame, begin, options)
        report.save_decision(record, a.out or f"{a.root}/decisions/latest.json")
        text = "".join(f"{n}: {o['objective']:.2f} ({o['points']:.2f} points, {o['status']})\n" for n, o in record["options"].items()) + f"best: {record['best']}\n"
    if a.out and a.command != "decide":
        with open(a.out, "w") as f:
            f.write(text)
    print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
