"""Landing remote documents: spaced, retried, cached by day. Runs on the driver, before and beside Spark."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random
import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from .pages import CHALLENGE, embedded_json

RETRIED = (408, 425, 429, 500, 502, 503, 504)


class FetchError(RuntimeError):
    """A document that could not be had, or is not what it should be."""


def cache_key(url: str, params: dict | None = None) -> str:
    """A readable prefix and 16 digits of a hash of the address and its sorted parameters."""
    full = url + ("?" + urllib.parse.urlencode(sorted(params.items())) if params else "")
    readable = re.sub(r"[^A-Za-z0-9]+", "_", urllib.parse.urlparse(url).path).strip("_")[-60:]
    return f"{readable or 'root'}-{hashlib.sha256(full.encode()).hexdigest()[:16]}"


def retry_delay(attempt: int, retry_after: str | None, jitter: float = 0.5) -> float:
    """What the server asks for, if more than 0 and at most 120 s, else 2 to the attempt, at most 30 s, and a little more."""
    try:
        asked = float(retry_after or "")
        if 0 < asked <= 120:
            return asked
    except ValueError:
        pass
    return min(2.0**attempt, 30.0) + random.random() * jitter


def _open(url: str, data: bytes | None, headers: dict[str, str], timeout: float) -> tuple[int, bytes, dict[str, str]]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=data, headers=headers), timeout=timeout) as r:
            return r.status, r.read(), dict(r.headers)
    except urllib.error.HTTPError as e:
        return e.code, e.read(), dict(e.headers or {})


class Client:
    """Requests at least `spacing` seconds apart, cached in a folder per day (or for `ttl` seconds); `offline` only reads the cache."""

    def __init__(self, cache: str, spacing: float = 0.4, tries: int = 4, ttl: float | None = None, offline: bool = False, timeout: float = 30.0, transport: Callable = _open, sleep: Callable = time.sleep):
        self.cache, self.spacing, self.tries, self.ttl, self.offline, self.timeout = Path(cache), spacing, tries, ttl, offline, timeout
        self.transport, self.sleep = transport, sleep
        self.lock, self.last = threading.Lock(), 0.0
        self.calls = self.hits = 0

    def _path(self, key: str) -> Path:
        day = "ttl" if self.ttl is not None else dt.date.today().isoformat()
        return self.cache / day / key

    def _wait(self) -> None:
        with self.lock:
            pause = self.last + self.spacing - time.monotonic()
            if pause > 0:
                self.sleep(pause)
            self.last = time.monotonic()

    def get(self, url: str, params: dict | None = None, cached: bool = True) -> bytes:
        path = self._path(cache_key(url, params))
        if cached and path.exists() and (self.ttl is None or time.time() - path.stat().st_mtime < self.ttl or self.offline):
            self.hits += 1
            return path.read_bytes()
        if self.offline:
            raise FetchError(f"offline and not cached: {url}")
        full = url + ("?" + urllib.parse.urlencode(sorted(params.items())) if params else "")
        body = self._send(full, None)
        if cached:
            path.parent.mkdir(parents=True, exist_ok=True)
            temp = path.with_suffix(f".{time.time_ns()}")
            temp.write_bytes(body)
            temp.replace(path)
        return body

    def _send(self, url: str, data: bytes | None) -> bytes:
        status: object = None
        for attempt in range(self.tries):
            self._wait()
            self.calls += 1
            try:
                status, body, headers = self.transport(url, data, {"User-Agent": "touchline"}, self.timeout)
            except OSError as e:
                status, headers = e, {}
            else:
                if status < 400:
                    return body
                if status not in RETRIED:
                    break
            if attempt + 1 < self.tries:
                self.sleep(retry_delay(attempt, headers.get("Retry-After")))
        raise FetchError(f"{url}: {status}")

    def get_json(self, url: str, params: dict | None = None, required: Iterable[str] = (), cached: bool = True):
        """A JSON document with its required fields; one that does not parse is dropped from the cache."""
        try:
            value = json.loads(self.get(url, params, cached))
        except ValueError as e:
            self._path(cache_key(url, params)).unlink(missing_ok=True)
            raise FetchError(f"{url}: not JSON") from e
        if missing := [k for k in required if not isinstance(value, dict) or k not in value]:
            raise FetchError(f"{url}: lacks {missing}")
        return value

    def post_json(self, url: str, fields: dict):
        return json.loads(self._send(url, urllib.parse.urlencode(fields).encode()))


class GameApi:
    """Endpoints of the game's public interface under a base address, which the caller gives."""

    def __init__(self, client: Client, base: str):
        self.client, self.base = client, base.rstrip("/")

    def _get(self, path: str, *required: str, cached: bool = True, **params):
        return self.client.get_json(f"{self.base}/{path}", params or None, required, cached)

    def bootstrap(self, cached: bool = True):
        return self._get("bootstrap-static/", "elements", "teams", "events", cached=cached)

    def fixtures(self, event: int | None = None):
        return self._get("fixtures/", **({"event": event} if event else {}))

    def live(self, gw: int, final: bool = False):
        """A running gameweek changes, so that only a final one is kept."""
        return self._get(f"event/{gw}/live/", "elements", cached=final)

    def element_summary(self, element: int):
        return self._get(f"element-summary/{element}/", "history")

    def entry(self, entry: int):
        return self._get(f"entry/{entry}/", "id")

    def entry_history(self, entry: int):
        return self._get(f"entry/{entry}/history/", "current")

    def entry_picks(self, entry: int, gw: int):
        return self._get(f"entry/{entry}/event/{gw}/picks/", "picks")

    def entry_transfers(self, entry: int):
        return self._get(f"entry/{entry}/transfers/")

    def standings(self, league: int, page: int = 1):
        return self._get(f"leagues-classic/{league}/standings/", "standings", page_standings=page)

    def all_standings(self, league: int, max_pages: int = 20) -> list[dict]:
        """Pages until the last, an empty one, or max_pages."""
        rows: list[dict] = []
        for page in range(1, max_pages + 1):
            table = self.standings(league, page)["standings"]
            rows += table["results"]
            if not table["results"] or not table.get("has_next"):
                break
        return rows

    def sweep(self, elements: Iterable[int]) -> Iterator[tuple[int, dict | None, str | None]]:
        """(element, summary, error) of each; a failure does not end the sweep."""
        for e in elements:
            try:
                yield e, self.element_summary(e), None
            except FetchError as error:
                yield e, None, str(error)


class ProviderApi:
    """A provider of match statistics under a base address: its endpoints for scripts first, else the data embedded in its pages."""

    def __init__(self, client: Client, base: str):
        self.client, self.base = client, base.rstrip("/")

    def _either(self, endpoint: str, page: str, variable: str):
        try:
            return self.client.get_json(f"{self.base}/{endpoint}")
        except FetchError as first:
            try:
                return embedded_json(self.client.get(f"{self.base}/{page}").decode("utf-8", "replace"), variable)
            except (FetchError, ValueError) as second:
                raise FetchError(f"neither {endpoint} nor {page} has it: {first}; {second}") from second

    def league(self, league: str, season: str) -> dict:
        """teams, players and dates; a page embeds only its players."""
        data = self._either(f"getLeagueData/{league}/{season}", f"league/{league}/{season}", "playersData")
        return {"players": data, "teams": {}, "dates": []} if isinstance(data, list) else data

    def player(self, player: str) -> dict:
        """{player_id, matches, shots} as payloads.player_matches() and player_shots() read them."""
        data = self._either(f"getPlayerData/{player}", f"player/{player}", "matchesData")
        found = {"matches": data} if isinstance(data, list) else data
        return {"player_id": str(player), "matches": found.get("matches") or [], "shots": found.get("shots") or []}

    def team(self, title: str, season: str) -> dict:
        """{dates, players, statistics} of a club, whose title may have blanks."""
        name = title.replace(" ", "_")
        data = self._either(f"getTeamData/{name}/{season}", f"team/{name}/{season}", "datesData")
        return {"dates": data, "players": [], "statistics": {}} if isinstance(data, list) else data

    def match_shots(self, match: str) -> dict:
        """{h, a} as payloads.shots_frame() reads them."""
        return self._either(f"getMatchData/{match}", f"match/{match}", "shotsData")


class GuardedPages:
    """Pages of a site that may answer with a challenge instead of content; nothing is made up where it does."""

    def __init__(self, client: Client, base: str):
        self.client, self.base = client, base.rstrip("/")

    def fetch(self, path: str) -> str:
        """The page's HTML; FetchError where the site refuses or sends a challenge."""
        html = self.client.get(f"{self.base}/{path.lstrip('/')}", cached=False).decode("utf-8", "replace")
        if any(mark in html[:4000].lower() for mark in CHALLENGE):
            raise FetchError(f"{path}: a challenge, not content")
        return html

    def probe(self, paths: Iterable[str]) -> list[tuple[str, bool, str]]:
        """(path, available, why not) of each; never raises for a page that is blocked."""
        out = []
        for path in paths:
            try:
                self.fetch(path)
                out.append((path, True, ""))
            except FetchError as e:
                out.append((path, False, str(e)))
        return out


def land_league(api: GameApi, league: int, folder: str, gameweeks: list[int], final: set[int] = frozenset(), max_pages: int = 50) -> list[int]:
    """Write a league's documents as JSON files that sources.payloads reads; the entries."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    put = lambda name, value: (out / f"{name}.json").write_text(json.dumps(value))
    put("bootstrap", api.bootstrap())
    rows = api.all_standings(league, max_pages)
    put("standings", {"standings": {"has_next": False, "results": rows}})
    for gw in gameweeks:
        put(f"live-{gw}", api.live(gw, gw in final))
        put(f"fixtures-{gw}", api.fixtures(gw))
    entries = [r["entry"] for r in rows]
    for e in entries:
        put(f"history-{e}", {"entry": e, **api.entry_history(e)})
        put(f"transfers-{e}", api.entry_transfers(e))
        for gw in gameweeks:
            put(f"picks-{e}-{gw}", {"entry": e, "gw": gw, **api.entry_picks(e, gw)})
    return entries
