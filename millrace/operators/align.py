"""Aligning unrelated datasets: daily spines, trading-day joins, baskets, asset maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Airports with the tickers exposed to them, and their regions.
AIRPORT_TICKERS = {
    "KJFK": ["DAL", "UAL", "AAL", "JBLU"], "KLAX": ["DAL", "UAL", "AAL", "LUV"], "KORD": ["UAL", "AAL", "LUV"], "KATL": ["DAL"], "KDFW": ["AAL"],
    "EGLL": ["IAG.L", "RYA.L", "EZJ.L"], "EDDF": ["LHA.DE", "FRA.DE"], "LFPG": ["AF.PA", "ADP.PA"], "EHAM": ["AF.PA", "KLM.AS"], "RJTT": ["9201.T", "9202.T"],
}
AIRPORT_REGION = {"KJFK": "US-NE", "KLAX": "US-W", "KORD": "US-MW", "KATL": "US-SE", "KDFW": "US-S", "EGLL": "EU-UK", "EDDF": "EU-DE", "LFPG": "EU-FR", "EHAM": "EU-NL", "RJTT": "ASIA-JP"}
ROUTE_TICKERS = {"KJFK->EGLL": ["DAL", "IAG.L"], "KJFK->LFPG": ["DAL", "AF.PA"], "KLAX->RJTT": ["UAL", "9201.T"]}


class AssetMap:
    """Airports, routes and tickers; the maps are literals, so lookups are column expressions."""

    def __init__(self, airports=None, regions=None, routes=None):
        self.airports, self.regions, self.routes = airports or AIRPORT_TICKERS, regions or AIRPORT_REGION, routes or ROUTE_TICKERS

    @staticmethod
    def _lookup(table: dict, key: Column, empty: Column) -> Column:
        literal = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])
        return F.coalesce(F.try_element_at(literal, key), empty)

    def tickers(self, airport: Column) -> Column:
        return self._lookup(self.airports, F.upper(airport), F.array().cast("array<string>"))

    def region(self, airport: Column) -> Column:
        return self._lookup(self.regions, F.upper(airport), F.lit(None).cast("string"))

    def route_tickers(self, origin: Column, destination: Column) -> Column:
        return self._lookup(self.routes, F.concat_ws("->", F.upper(origin), F.upper(destination)), F.array().cast("array<string>"))

    def airports_of(self, ticker: Column) -> Column:
        back: dict[str, list[str]] = {}
        for airport, tickers in self.airports.items():
            for t in tickers:
                back.setdefault(t, []).append(airport)
        return self._lookup(back, ticker, F.array().cast("array<string>"))

    def all_tickers(self) -> list[str]:
        return sorted({t for v in self.airports.values() for t in v})


def daily_spine(df: DataFrame, value: str, how: str = "sum", key: str = "symbol") -> DataFrame:
    """(key, day, value) for every calendar day between a key's first and last: empty days sum to 0,
    and have no mean or last value."""
    day = F.to_date("ts")
    agg = {"sum": F.sum(value), "mean": F.avg(value), "last": F.max_by(value, "ts"), "first": F.min_by(value, "ts"), "max": F.max(value), "min": F.min(value)}[how]
    daily = df.groupBy(key, day.alias("day")).agg(agg.alias(value))
    spine = daily.groupBy(key).agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    out = spine.join(daily, [key, "day"], "left")
    return out.withColumn(value, F.coalesce(value, F.lit(0))) if how == "sum" else out


def keep_last_day(df: DataFrame, key: str = "symbol") -> DataFrame:
    """The last row of each UTC day of a key, with ``day``."""
    w = Window.partitionBy(key, "day").orderBy(F.col("ts").desc())
    return df.withColumn("day", F.to_date("ts")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "ts")


def trading_day_join(left: DataFrame, right: DataFrame, how: str = "inner", shift_days: int = 0, suffixes: tuple[str, str] = ("_flight", "_ohlcv")) -> DataFrame:
    """Joins two daily frames (day, ...) on the day, the left one moved by shift_days calendar days;
    names that clash get suffixes."""
    clash = {c for c in left.columns if c in right.columns and c != "day"}
    l = left.select(F.date_add("day", shift_days).alias("day"), *[F.col(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns if c != "day"])  # noqa: E741
    r = right.select("day", *[F.col(c).alias(c + suffixes[1] if c in clash else c) for c in right.columns if c != "day"])
    return l.join(r, "day", how)


def basket(feature: DataFrame, closes: DataFrame, symbols: list[str]) -> DataFrame:
    """One feature (day, value) beside <symbol>_close of every symbol, outer on the day."""
    wide = closes.groupBy("day").pivot("symbol", symbols).agg(F.max_by("close", "ts"))
    return feature.join(wide.select("day", *[F.col(f"`{s}`").alias(f"{s}_close") for s in symbols]), "day", "full")


def next_after(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, name: str) -> DataFrame:
    """As-of join: each left row with the first right time strictly after its own, without a range join."""
    a = left.withColumn("_at", F.col(left_at)).withColumn("_kind", F.lit(1))
    b = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_kind"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(1, Window.unboundedFollowing)
    x = a.unionByName(b, allowMissingColumns=True).withColumn(name, F.first(F.when(F.col("_kind") == 0, F.col("_at")), ignorenulls=True).over(w))
    return x.where("_kind = 1").drop("_at", "_kind")
