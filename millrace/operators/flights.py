"""Flight events: cleaning and daily features per airport. Every feature is (airport, day, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.bars import keep_last

#: Call-sign prefixes of cargo airlines.
CARGO_PREFIXES = ("GTI", "FDX", "UPS", "CLX", "GEC", "ABW", "CKS", "MPH", "CAO")


def _name(c: str) -> Column:
    return F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))


def clean(flights: DataFrame, most_distance: int = 10_000, seq: str = "seq") -> DataFrame:
    """One row (the last) of each (icao24, first_seen, direction, airport) as delivered; names
    trimmed and upper-cased, empty ones null; no null or reversed times; no low confidence."""
    x = keep_last(flights, ["icao24", "first_seen", "direction", "airport"], seq)
    x = x.withColumn("callsign", _name("callsign")).withColumn("airport", _name("airport"))
    x = x.withColumn("dep_airport", _name("dep_airport")).withColumn("arr_airport", _name("arr_airport"))
    x = x.where("first_seen IS NOT NULL AND last_seen IS NOT NULL AND last_seen >= first_seen")
    return x.where(~F.coalesce(F.col("distance") > most_distance, F.lit(False)))


def _daily(flights: DataFrame) -> DataFrame:
    return flights.withColumn("day", F.to_date("first_seen"))


def routes(flights: DataFrame) -> DataFrame:
    x = _daily(flights).where("dep_airport IS NOT NULL AND arr_airport IS NOT NULL")
    return x.groupBy("airport", "day").agg(F.count_distinct("dep_airport", "arr_airport").alias("route_count"))


def cargo(flights: DataFrame, prefixes: tuple[str, ...] = CARGO_PREFIXES) -> DataFrame:
    is_cargo = F.coalesce(F.substring("callsign", 1, 3).isin(*prefixes), F.lit(False))
    x = _daily(flights).groupBy("airport", "day").agg(F.count_if(~is_cargo).alias("passenger_flights"), F.count_if(is_cargo).alias("cargo_flights"))
    return x.withColumn("cargo_ratio", F.col("cargo_flights") / (F.col("passenger_flights") + F.col("cargo_flights")))


def net_flow(flights: DataFrame) -> DataFrame:
    x = _daily(flights).groupBy("airport", "day").agg(F.count_if(F.col("direction") == "arrival").alias("arrivals"), F.count_if(F.col("direction") == "departure").alias("departures"))
    return x.withColumn("net_flow", F.col("arrivals") - F.col("departures"))


def turnarounds(flights: DataFrame) -> DataFrame:
    """Each arrival with the first departure of the same aircraft and airport after it landed.

    Arrivals (at last_seen) and departures (at first_seen) are one ordered stream in which an arrival
    comes after departures of its own instant; the next departure is a window away: no range join.
    """
    a = flights.where("direction = 'arrival'").select("icao24", "airport", F.col("last_seen").alias("at"), F.lit(1).alias("kind"), "seq")
    d = flights.where("direction = 'departure'").select("icao24", "airport", F.col("first_seen").alias("at"), F.lit(0).alias("kind"), "seq")
    w = Window.partitionBy("icao24", "airport").orderBy("at", "kind", "seq").rowsBetween(1, Window.unboundedFollowing)
    x = a.unionByName(d).withColumn("departed", F.first(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(w))
    return x.where("kind = 1 AND departed IS NOT NULL").select("icao24", "airport", F.col("at").alias("landed"), "departed")


def turnaround(flights: DataFrame) -> DataFrame:
    x = turnarounds(flights).withColumn("m", (F.unix_micros("departed") - F.unix_micros("landed")) / 60e6)
    return x.groupBy("airport", F.to_date("landed").alias("day")).agg(F.avg("m").alias("turnaround_minutes"))


def fleet(flights: DataFrame) -> DataFrame:
    x = _daily(flights).groupBy("airport", "day").agg(F.count_distinct("icao24").alias("unique_aircraft"), F.count(F.lit(1)).alias("flights"))
    return x.withColumn("flights_per_aircraft", F.col("flights") / F.col("unique_aircraft"))


def hub(flights: DataFrame) -> DataFrame:
    """Distinct counterparts, and the Herfindahl index of their shares."""
    other = F.when(F.col("direction") == "arrival", F.col("dep_airport")).otherwise(F.col("arr_airport"))
    n = _daily(flights).withColumn("o", other).where("o IS NOT NULL").groupBy("airport", "day", "o").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("airport", "day").agg(F.count(F.lit(1)).alias("connected_airports"), (F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("hub_hhi"))


def airlines(flights: DataFrame) -> DataFrame:
    n = _daily(flights).where("callsign IS NOT NULL").groupBy("airport", "day", F.substring("callsign", 1, 3).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("airport", "day").agg(F.count(F.lit(1)).alias("airlines"), (F.max("n") / F.sum("n")).alias("top_airline_share"))


def congestion(flights: DataFrame, minutes: int = 15) -> DataFrame:
    """Most flights in any trailing (t - minutes, t] of the day, and the mean duration in minutes."""
    us = F.unix_micros("first_seen")
    w = Window.partitionBy("airport", "day").orderBy("us").rangeBetween(-(minutes * 60_000_000 - 1), 0)
    x = _daily(flights).withColumn("us", us).withColumn("c", F.count(F.lit(1)).over(w))
    return x.groupBy("airport", "day").agg(F.max("c").alias("peak_flights"), F.avg((F.unix_micros("last_seen") - F.col("us")) / 60e6).alias("mean_duration_minutes"))


def supply_z(flights: DataFrame, window: int = 7) -> DataFrame:
    """Daily flights against the trailing mean and deviation of so many days with flights."""
    w = Window.partitionBy("airport").orderBy("day").rowsBetween(-(window - 1), 0)
    x = _daily(flights).groupBy("airport", "day").agg(F.count(F.lit(1)).alias("flights"))
    return x.withColumn("z", F.try_divide(F.col("flights") - F.avg("flights").over(w), F.stddev_samp("flights").over(w)))


def event_flag(flights: DataFrame, window: int = 14, z: float = 2.5) -> DataFrame:
    return supply_z(flights, window).withColumn("event_flag", F.coalesce((F.abs("z") >= z).cast("double"), F.lit(0.0)))


FEATURES = {
    "route_count": routes, "passenger_cargo_proxy": cargo, "net_flow": net_flow, "turnaround_time": turnaround, "fleet_utilization": fleet, "hub_analysis": hub,
    "airline_strategy": airlines, "delay_congestion": congestion, "supply_demand": supply_z, "event_detection": event_flag,
}


def long_features(flights: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(airport, day, feature_name, feature_value) of the named features, nulls left out."""
    out = None
    for name in names or list(FEATURES):
        x = FEATURES[name](flights)
        values = [c for c in x.columns if c not in ("airport", "day")]
        prefix = {"supply_demand": "supply_demand_", "event_detection": "event_"}.get(name, "")
        x = x.select("airport", "day", *[F.col(c).cast("double").alias(prefix + c if c in ("z", "flights") else c) for c in values])
        rows = x.unpivot(["airport", "day"], x.columns[2:], "feature_name", "feature_value").where("feature_value IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out
