"""DuckDB building blocks of the oracle queries: the adapters of sources.tables as CTEs."""

B1H = """
ticks AS (SELECT event_type AS symbol, ts, value AS price, event_id AS tie FROM events),
b AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
    count(*)::DOUBLE AS volume FROM ticks GROUP BY ALL)"""

B1D = """
li AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS p, l_quantity AS q,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem),
b AS (SELECT symbol, ts, arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close, sum(q)::DOUBLE AS volume FROM li GROUP BY ALL)"""

FLIGHTS = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type IN ('click', 'view') AS arrival FROM events
    WHERE event_type IN ('click', 'view', 'purchase', 'signup')),
f AS (SELECT user_id::VARCHAR AS icao24, CASE WHEN arrival THEN 'arrival' ELSE 'departure' END AS direction, 'K' || (event_id % 8) AS airport,
    ts AS first_seen, make_timestamp(epoch_us(ts) + round(value * 60000000)::BIGINT) AS last_seen, upper(left(event_type, 3)) AS callsign,
    CASE WHEN arrival THEN 'A' || (k % 7) ELSE 'K' || (event_id % 8) END AS dep_airport,
    CASE WHEN arrival THEN 'K' || (event_id % 8) ELSE 'A' || (k % 7) END AS arr_airport, k * 200 AS distance, event_id AS seq FROM e)"""


def columns(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def ema(x: str, a: float, first: int = 0, pos: str = "pos") -> str:
    """A window expression: growing weights, fine for series of some thousand rows."""
    q = 1 - a
    seed = f"CASE WHEN {pos} = {first} THEN {x} WHEN {pos} > {first} THEN {a!r}::DOUBLE * {x} END"
    return f"CASE WHEN {pos} >= {first} THEN sum(({seed}) * pow({q!r}::DOUBLE, -({pos} % 5000))) OVER (PARTITION BY symbol ORDER BY pos) * pow({q!r}::DOUBLE, {pos} % 5000) END"
