"""Refreshing stored tables from landed documents, each source by itself."""

from __future__ import annotations

import re
import traceback
from collections.abc import Callable

from pyspark.sql import functions as F

from ..operators import monitor, reconcile
from ..sources import archive, pages, payloads as P
from ..sources.catalog import Catalog
from ..storage import hadoop


def run_jobs(jobs: dict[str, Callable[[], object]], optional: frozenset[str] = frozenset()) -> tuple[dict[str, str], int]:
    """({job: ok or error}, exit code): a failing job does not stop the others; only one that is not optional makes the code 1."""
    out, code = {}, 0
    for name, job in jobs.items():
        try:
            job()
            out[name] = "ok"
        except Exception as e:  # each source stands by itself
            out[name] = "".join(traceback.format_exception_only(e)).strip()
            code = code if name in optional else 1
    return out, code


def load_game(catalog: Catalog, landed: str) -> None:
    """players, teams, events, fixtures and their statistics from landed bootstrap.json and fixtures*.json."""
    spark = catalog.spark
    boot = P.read_json(spark, f"{landed}/bootstrap.json", P.BOOTSTRAP, ("elements", "teams", "events"))
    teams, events = P.rows_of(boot, "teams"), P.rows_of(boot, "events")
    catalog.save(P.elements_frame(P.rows_of(boot, "elements"), teams), "game/elements")
    catalog.save(teams, "game/teams")
    catalog.save(P.events_frame(events), "game/events")
    fixtures = P.read_json(spark, f"{landed}/fixtures*.json", P.FIXTURES, ("id",))
    catalog.save(P.fixtures_frame(fixtures), "game/fixtures")
    catalog.save(P.fixture_stats_frame(fixtures), "game/fixture_stats")


def load_live(catalog: Catalog, landed: str, gws: list[int]) -> int:
    """live statistics and their lines of these gameweeks, in place of what was stored of them; the number of players whose lines do not add up, counted as they are written.

    Gameweeks that are not named keep their files.
    """
    from functools import reduce

    if not gws:
        return 0
    pages = [(g, P.read_json(catalog.spark, f"{landed}/live-{g}.json", P.LIVE, ("elements",))) for g in gws]
    union = lambda f: reduce(lambda a, b: a.unionByName(b), [f(p, g) for g, p in pages])
    catalog.replace(union(P.live_explain_frame), "game/live_explain", "gw")
    stats = union(P.live_points_frame)
    lines = catalog.load("game/live_explain").where(F.col("gw").isin(gws))
    both = reconcile.rebuilt_points(lines, stats).select("gw", "element", "rebuilt")
    checked = stats.join(both, ["gw", "element"], "left").withColumn("adds_up", F.col("total_points") == F.col("rebuilt")).drop("rebuilt")
    counts = catalog.replace(checked, "game/live_stats", "gw", rows=F.count("*"), off=F.count_if(~F.col("adds_up")))
    return counts["off"]


def load_history(catalog: Catalog, landed: str) -> int:
    """history/merged_gw from landed season-SEASON.csv, with positions and clubs of lookup-SEASON.csv (element, position_lookup, team_lookup) where there is one; each season a partition. The number of rows."""
    total = 0
    for season, path in _landed(catalog, landed, r"season-(.+)\.csv"):
        lookup = dict(_landed(catalog, landed, r"lookup-(.+)\.csv")).get(season)
        rows = archive.normalise_season(archive.read_csv(catalog.spark, path), season, archive.read_csv(catalog.spark, lookup) if lookup else None)
        total += catalog.replace(rows, "history/merged_gw", "season", rows=F.count("*"))["rows"]
    if not total:
        raise FileNotFoundError(f"no season-SEASON.csv with rows under {landed}")
    return total


def load_provider(catalog: Catalog, landed: str) -> int:
    """provider/players and provider/fixtures from landed provider-LEAGUE-SEASON.json; each season of a league a partition. The number of players."""
    total = 0
    for of, path in _landed(catalog, landed, r"provider-(.+-\d+)\.json"):
        league, _, season = of.rpartition("-")
        page = P.read_json(catalog.spark, path, P.PROVIDER, ("players",))
        of = F.lit(of)
        total += catalog.replace(P.provider_players(page, season, league).withColumn("of", of), "provider/players", "of", rows=F.count("*"))["rows"]
        catalog.replace(P.provider_fixtures(page, season, league).withColumn("of", of), "provider/fixtures", "of")
    return total


def load_pages(catalog: Catalog, landed: str) -> int:
    """guarded/tables (page, number, place, cells) of landed page-NAME.html; RuntimeError where every page is a challenge.

    Tables hidden in comments are read too. A challenge page has no rows, and does not stop the others.
    """
    raw = catalog.spark.read.format("binaryFile").load(f"{landed}/page-*.html")
    pages_ = raw.select(F.regexp_extract("path", "page-([^/]+)[.]html$", 1).alias("page"), F.decode("content", "UTF-8").alias("html")).withColumn("blocked", pages.challenged(F.col("html")))
    rows = pages.table_rows(pages_.where("not blocked"), "page")
    n = catalog.replace(rows, "guarded/tables", "page", rows=F.count("*"))["rows"]
    if not n and not pages_.where("blocked").isEmpty():
        raise RuntimeError("every page is a challenge, not content")
    return n


def _landed(catalog: Catalog, folder: str, pattern: str) -> list[tuple[str, str]]:
    """(what the pattern's group says, path) of landed files, by name."""
    fs, p = hadoop(catalog.spark, folder)
    found = [(re.fullmatch(pattern, s.getPath().getName()), s.getPath().toString()) for s in fs.listStatus(p)]
    return sorted((m[1], path) for m, path in found if m)


def take_prices(catalog: Catalog, landed: str, taken_at: str) -> None:
    """Append a price snapshot as a partition of its own; a second one of the same time replaces the first. Prices come first, since they cannot be had again."""
    boot = P.read_json(catalog.spark, f"{landed}/bootstrap.json", P.BOOTSTRAP, ("elements",))
    rows = monitor.price_rows(P.rows_of(boot, "elements"), F.lit(taken_at).cast("timestamp"))
    rows = monitor.deduplicate(rows, ["ts", "player_id"], [F.col("now_cost")])
    catalog.append(rows, "prices/history", taken="".join(c for c in taken_at if c.isalnum()))
