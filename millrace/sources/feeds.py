"""REST feeds as Python data sources: bars per ticker, flights per airport, day and direction.

The transport is a callable (path, params) -> (status, headers, payload), so that the sources run
without a network in tests; the default one uses urllib. Retries, rate limits and token refresh sit
in ``Client``; each ticker, or airport, day and direction, is one input partition.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str, dict], tuple[int, dict, object]]


class TokenCache:
    """A bearer token, asked for anew before it expires (``margin`` seconds early) or when told to."""

    def __init__(self, ask: Callable[[], tuple[str, float]], margin: float = 60, clock=time.monotonic):
        self.ask, self.margin, self.clock = ask, margin, clock
        self._token, self._until = None, 0.0

    def refresh(self) -> None:
        self._token = None

    @property
    def token(self) -> str:
        if self._token is None or self.clock() >= self._until - self.margin:
            self._token, lasts = self.ask()
            self._until = self.clock() + lasts
        return self._token


class QuotaError(RuntimeError):
    """The service asks for a longer pause than the client accepts."""


def http(base: str, headers: dict | None = None) -> Transport:
    def get(path: str, params: dict) -> tuple[int, dict, object]:
        url = f"{base}{path}?{urllib.parse.urlencode(params)}"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=30) as r:
                return r.status, dict(r.headers), json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), None

    return get


class Client:
    """Rate limit over a sliding minute, back-off on 429 and 5xx, one token refresh on 401."""

    def __init__(self, get: Transport, per_minute: int = 60, retries: int = 7, most_wait: float = 300, refresh: Callable[[], None] | None = None, sleep=time.sleep, clock=time.monotonic):
        self.get, self.per_minute, self.retries, self.most_wait = get, per_minute, retries, most_wait
        self.refresh, self.sleep, self.clock = refresh, sleep, clock
        self.calls: deque[float] = deque()

    def _pace(self) -> None:
        now = self.clock()
        while self.calls and now - self.calls[0] >= 60:
            self.calls.popleft()
        if len(self.calls) >= self.per_minute:
            self.sleep(60 - (now - self.calls[0]))
            self.calls.popleft()
        self.calls.append(self.clock())

    def fetch(self, path: str, params: dict):
        refreshed = False
        for attempt in range(self.retries + 1):
            self._pace()
            status, headers, payload = self.get(path, params)
            if status == 200:
                return payload
            if status == 404:
                return []
            if status == 401 and self.refresh and not refreshed:
                refreshed = True
                self.refresh()
                continue
            if status == 429 or status >= 500:
                wait = float(headers.get("Retry-After", min(60, 2**attempt)))
                if wait > self.most_wait:
                    raise QuotaError(f"asked to wait {wait:.0f} s")
                self.sleep(wait)
                continue
            raise RuntimeError(f"HTTP {status} for {path}")
        raise RuntimeError(f"no answer for {path} after {self.retries} retries")


def backward_pages(fetch: Callable[[dict], list[dict]], size: int = 5000) -> Iterator[dict]:
    """Rows of pages that run from the newest row back, until a short or empty page."""
    end = None
    while True:
        page = fetch({"outputsize": size} | ({"end_date": end} if end else {}))
        yield from page
        if len(page) < size:
            return
        end = min(r["datetime"] for r in page)


BARS = "symbol string, ts string, open string, high string, low string, close string, volume string, seq long"


class _Part(InputPartition):
    def __init__(self, key: str, order: int):
        self.key, self.order = key, order


class BarsReader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport | None):
        self.options, self.transport = options, transport

    def partitions(self):
        return [_Part(t.strip(), i) for i, t in enumerate(self.options["tickers"].split(","))]

    def read(self, part):
        # the allowance is the service's, not a ticker's: each reader takes an equal share of it
        share = max(1, int(self.options.get("per_minute", 8)) // len(self.partitions()))
        client = Client(self.transport or http(self.options["url"]), share)
        params = {"symbol": part.key, "interval": self.options.get("interval", "1min")}
        rows = backward_pages(lambda more: client.fetch("/time_series", params | more), int(self.options.get("page", 5000)))
        for n, r in enumerate(rows):
            yield part.key, r.get("datetime"), r.get("open"), r.get("high"), r.get("low"), r.get("close"), r.get("volume"), -n


class BarsSource(DataSource):
    """spark.read.format("rest_bars"); rows are text, to be typed by ``typed_bars``."""

    transport: Transport | None = None

    @classmethod
    def name(cls) -> str:
        return "rest_bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> DataSourceReader:
        return BarsReader(dict(self.options), type(self).transport)


class FlightsReader(DataSourceReader):
    """One partition an airport, UTC day and direction. A part that fails is left out, but if all fail, or
    the quota is gone, the read fails."""

    def __init__(self, options: dict, transport: Transport | None):
        self.options, self.transport = options, transport

    def partitions(self):
        days = day_bounds(datetime.fromisoformat(self.options["start"]).replace(tzinfo=UTC), datetime.fromisoformat(self.options["end"]).replace(tzinfo=UTC))
        keys = [f"{a.strip().upper()} {d} {lo} {hi}" for a in self.options["airports"].split(",") for lo, hi in days for d in ("arrival", "departure")]
        return [_Part(k, i) for i, k in enumerate(keys)]

    def read(self, part):
        airport, direction, begin, end = part.key.split()
        share = max(1, int(self.options.get("per_minute", 60)) // max(1, len(self.partitions())))
        client = Client(self.transport or http(self.options["url"]), share, retries=int(self.options.get("retries", 7)))
        try:
            found = client.fetch(f"/flights/{direction}", {"airport": airport, "begin": int(begin), "end": int(end)})
        except QuotaError:
            raise
        except RuntimeError as e:
            yield airport, direction, None, str(e)
            return
        for flight in found:
            yield airport, direction, json.dumps(flight), None


class FlightsSource(DataSource):
    """spark.read.format("rest_flights"): airport, direction, value (JSON) and, for parts that failed, error."""

    transport: Transport | None = None

    @classmethod
    def name(cls) -> str:
        return "rest_flights"

    def schema(self) -> str:
        return "airport string, direction string, value string, error string"

    def reader(self, schema) -> DataSourceReader:
        return FlightsReader(dict(self.options), type(self).transport)


def typed_flights(raw: DataFrame) -> DataFrame:
    """The flights of ``rest_flights`` with types, both directions; fails if there are errors and nothing else."""
    lost = raw.agg(F.count("error").alias("errors"), F.count("value").alias("found")).first()
    if lost["errors"] and not lost["found"]:
        raise RuntimeError(f"all {lost['errors']} requests failed")
    parts = [flights_from_json(raw.where(F.col("direction") == d).select("airport", "value"), F.col("airport"), d) for d in ("arrival", "departure")]
    return parts[0].unionByName(parts[1])


def typed_bars(raw: DataFrame) -> DataFrame:
    """Numbers where they parse, UTC timestamps, adjusted_close = close; no negative price or volume."""
    x = raw.select("symbol", F.expr("try_cast(ts AS timestamp)").alias("ts"), *[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("open", "high", "low", "close", "volume")], "seq")
    return x.withColumn("adjusted_close", F.col("close")).where("ts IS NOT NULL AND close >= 0 AND volume >= 0")


def normalised_columns(df: DataFrame) -> DataFrame:
    """Lower case, spaces as underscores, the spellings of the adjusted close as one (close if absent)."""
    x = df.toDF(*[{"adj_close": "adjusted_close", "adjclose": "adjusted_close"}.get(n := c.strip().lower().replace(" ", "_"), n) for c in df.columns])
    return x if "adjusted_close" in x.columns else x.withColumn("adjusted_close", F.col("close"))


def day_bounds(start: datetime, end: datetime) -> list[tuple[int, int]]:
    """UTC days between two instants as (first second, last second), the ends clipped."""
    out, at = [], start.astimezone(UTC)
    end = end.astimezone(UTC)
    while at <= end:
        midnight = (at + timedelta(days=1)).replace(hour=0, minute=0, second=0, microsecond=0)
        out.append((int(at.timestamp()), int(min(midnight - timedelta(seconds=1), end).timestamp())))
        at = midnight
    return out


FLIGHT_JSON = (
    "icao24 string, firstSeen long, lastSeen long, callsign string, estDepartureAirport string, estArrivalAirport string, "
    "estDepartureAirportHorizDistance int, estArrivalAirportHorizDistance int"
)


def flights_from_json(lines: DataFrame, airport: str | Column, direction: str) -> DataFrame:
    """Typed flights of a column ``value`` of JSON objects; rows without icao24 or times are left out."""
    airport = F.lit(airport) if isinstance(airport, str) else airport
    x = lines.select(airport.alias("_airport"), F.from_json("value", FLIGHT_JSON).alias("f")).select("_airport", "f.*").where("icao24 IS NOT NULL AND firstSeen IS NOT NULL AND lastSeen IS NOT NULL")
    distance = "estArrivalAirportHorizDistance" if direction == "arrival" else "estDepartureAirportHorizDistance"
    return x.select(
        F.lower(F.trim("icao24")).alias("icao24"), F.lit(direction).alias("direction"), F.col("_airport").alias("airport"), F.timestamp_seconds("firstSeen").alias("first_seen"),
        F.timestamp_seconds("lastSeen").alias("last_seen"), F.nullif(F.trim("callsign"), F.lit("")).alias("callsign"), F.col("estDepartureAirport").alias("dep_airport"),
        F.col("estArrivalAirport").alias("arr_airport"), F.col(distance).alias("distance"),
    )
