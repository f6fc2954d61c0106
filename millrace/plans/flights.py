"""Registered queries on flight-style events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import flights as FL
from millrace.plans import sql as Q
from millrace.plans.registered import query, shown
from millrace.sources import tables as T

DAY = ["airport", "day"]
_D = "airport, first_seen::DATE::VARCHAR AS day"
_DD = "d AS (SELECT *, first_seen::DATE AS day FROM f)"


def _flights(spark: SparkSession, sf: str) -> DataFrame:
    return T.flights(spark, sf)


@query(f"""WITH {Q.FLIGHTS}, g AS (SELECT icao24, first_seen, last_seen, direction, CASE WHEN seq % 3 = 0 THEN ' ' || lower(airport) ELSE airport END AS airport, CASE WHEN seq % 5 = 0 THEN '  ' ELSE lower(callsign) END AS callsign,
dep_airport, arr_airport, CASE WHEN seq % 7 = 0 THEN NULL ELSE distance END AS distance, seq FROM f UNION ALL SELECT icao24, first_seen, last_seen, direction, CASE WHEN seq % 3 = 0 THEN ' ' || lower(airport) ELSE airport END, callsign, dep_airport, arr_airport, distance, seq + 1000000000 FROM f WHERE seq % 4 = 0),
o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY icao24, first_seen, direction, airport ORDER BY seq DESC) = 1)
SELECT icao24, epoch_us(first_seen) // 1000000 AS first_seen, direction, nullif(upper(trim(airport)), '') AS airport, nullif(upper(trim(callsign)), '') AS callsign, distance, seq FROM o
WHERE last_seen >= first_seen AND NOT coalesce(distance > 10000, false)""")
def flight_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Cleans flights with padding, empty call signs, missing distances and repeats put in by rule."""
    f = _flights(spark, sf)
    here = F.when(F.col("seq") % 3 == 0, F.concat(F.lit(" "), F.lower("airport"))).otherwise(F.col("airport"))
    first = f.withColumn("airport", here).withColumn("callsign", F.when(F.col("seq") % 5 == 0, "  ").otherwise(F.lower("callsign"))).withColumn("distance", F.when(F.col("seq") % 7 != 0, F.col("distance")))
    again = f.withColumn("airport", here).where("seq % 4 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
    return shown(FL.clean(first.unionByName(again)), ["icao24", "first_seen", "direction", "airport"], ["callsign", "distance", "seq"])


@query(f"WITH {Q.FLIGHTS} SELECT {_D}, count(DISTINCT (dep_airport, arr_airport)) AS route_count FROM f GROUP BY ALL")
def flight_routes(spark: SparkSession, sf: str) -> DataFrame:
    return shown(FL.routes(_flights(spark, sf)), DAY, ["route_count"])


@query(f"""WITH {Q.FLIGHTS} SELECT {_D}, count(*) FILTER (callsign <> 'PUR') AS passenger_flights, count(*) FILTER (callsign = 'PUR') AS cargo_flights,
round(count(*) FILTER (callsign = 'PUR') / count(*), 6) AS cargo_ratio FROM f GROUP BY ALL""")
def flight_cargo(spark: SparkSession, sf: str) -> DataFrame:
    return shown(FL.cargo(_flights(spark, sf), ("PUR",)), DAY, ["passenger_flights", "cargo_flights", "cargo_ratio"])


@query(f"""WITH {Q.FLIGHTS} SELECT {_D}, count(*) FILTER (direction = 'arrival') AS arrivals, count(*) FILTER (direction = 'departure') AS departures,
count(*) FILTER (direction = 'arrival') - count(*) FILTER (direction = 'departure') AS net_flow FROM f GROUP BY ALL""")
def flight_netflow(spark: SparkSession, sf: str) -> DataFrame:
    return shown(FL.net_flow(_flights(spark, sf)), DAY, ["arrivals", "departures", "net_flow"])


@query(f"""WITH {Q.FLIGHTS}, a AS (SELECT seq, icao24, airport, last_seen AS t FROM f WHERE direction = 'arrival'), d AS (SELECT icao24, airport, first_seen AS t FROM f WHERE direction = 'departure'),
n AS (SELECT a.seq, a.airport, a.t, min(d.t) AS u FROM a JOIN d ON d.icao24 = a.icao24 AND d.airport = a.airport AND d.t > a.t GROUP BY ALL)
SELECT airport, t::DATE::VARCHAR AS day, round(avg((epoch_us(u) - epoch_us(t)) / 60000000), 4) AS turnaround_minutes FROM n GROUP BY ALL""")
def flight_turnaround(spark: SparkSession, sf: str) -> DataFrame:
    return shown(FL.turnaround(_flights(spark, sf)), DAY, ["turnaround_minutes"], 4)


@query(f"WITH {Q.FLIGHTS} SELECT {_D}, count(DISTINCT icao24) AS unique_aircraft, count(*) AS flights, round(count(*) / count(DISTINCT icao24), 6) AS flights_per_aircraft FROM f GROUP BY ALL")
def flight_fleet(spark: SparkSession, sf: str) -> DataFrame:
    return shown(FL.fleet(_flights(spark, sf)), DAY, ["unique_aircraft", "flights", "flights_per_aircraft"])


@query(f"""WITH {Q.FLIGHTS}, {_DD}, n AS (SELECT airport, day, CASE WHEN direction = 'arrival' THEN dep_airport ELSE arr_airport END AS o, count(*) AS n FROM d GROUP BY ALL)
SELECT airport, day::VARCHAR AS day, count(*) AS connected_airports, round(sum(n * n) / pow(sum(n), 2), 6) AS hub_hhi FROM n WHERE o IS NOT NULL GROUP BY ALL""")
def flight_hub_hhi(spark: SparkSession, sf: str) -> DataFrame:
    return shown(FL.hub(_flights(spark, sf)), DAY, ["connected_airports", "hub_hhi"])


@query(f"""WITH {Q.FLIGHTS}, {_DD}, n AS (SELECT airport, day, left(callsign, 3) AS p, count(*) AS n FROM d GROUP BY ALL)
SELECT airport, day::VARCHAR AS day, count(*) AS airlines, round(max(n) / sum(n), 6) AS top_airline_share FROM n GROUP BY ALL""")
def flight_airline_share(spark: SparkSession, sf: str) -> DataFrame:
    return shown(FL.airlines(_flights(spark, sf)), DAY, ["airlines", "top_airline_share"])


@query(f"""WITH {Q.FLIGHTS}, {_DD}, c AS (SELECT *, count(*) OVER (PARTITION BY airport, day ORDER BY epoch_us(first_seen) RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) AS c FROM d)
SELECT airport, day::VARCHAR AS day, max(c) AS peak_flights, round(avg((epoch_us(last_seen) - epoch_us(first_seen)) / 60000000), 4) AS mean_duration_minutes FROM c GROUP BY ALL""")
def flight_peak(spark: SparkSession, sf: str) -> DataFrame:
    return shown(FL.congestion(_flights(spark, sf)), DAY, ["peak_flights", "mean_duration_minutes"], 4)


def _z(n: int) -> str:
    w = f"(PARTITION BY airport ORDER BY day ROWS {n - 1} PRECEDING)"
    return f"c AS (SELECT airport, day, count(*) AS flights FROM d GROUP BY ALL), z AS (SELECT *, (flights - avg(flights) OVER {w}) / nullif(stddev_samp(flights) OVER {w}, 0) AS z FROM c)"


@query(f"WITH {Q.FLIGHTS}, {_DD}, {_z(7)} SELECT airport, day::VARCHAR AS day, flights, round(z, 6) AS z FROM z")
def flight_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return shown(FL.supply_z(_flights(spark, sf)), DAY, ["flights", "z"])


@query(f"WITH {Q.FLIGHTS}, {_DD}, {_z(14)} SELECT airport, day::VARCHAR AS day, coalesce((abs(z) >= 2.5)::INT, 0)::DOUBLE AS event_flag FROM z")
def flight_event_flag(spark: SparkSession, sf: str) -> DataFrame:
    return shown(FL.event_flag(_flights(spark, sf)), DAY, ["event_flag"])


@query(f"""WITH {Q.FLIGHTS}, a AS (SELECT {_D}, count(DISTINCT (dep_airport, arr_airport))::DOUBLE AS route_count, count(DISTINCT icao24)::DOUBLE AS unique_aircraft, count(*)::DOUBLE AS flights,
count(*) / count(DISTINCT icao24) AS flights_per_aircraft FROM f GROUP BY ALL)
SELECT airport, day, feature_name, round(feature_value, 6) AS feature_value FROM (UNPIVOT a ON route_count, unique_aircraft, flights, flights_per_aircraft INTO NAME feature_name VALUE feature_value)""")
def flight_features_long(spark: SparkSession, sf: str) -> DataFrame:
    x = FL.long_features(_flights(spark, sf), ["route_count", "fleet_utilization"])
    return shown(x, [*DAY, "feature_name"], ["feature_value"])
