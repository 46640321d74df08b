"""Stand-in inputs built from the driver tables.

The test data has no flights table, so ``trips`` maps the TPC-H-ish star
schema onto the flights schema (the rules are fixed by FIXTURES.md §3). It
only produces rows in the shape the jobs expect: every job downstream is
written against the flights schema and must be right on any data of that
shape. The same mapping is written once as Spark DataFrame code and once as
DuckDB SQL text (``TRIPS_SQL``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _code(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 2, "0"))


def trips(spark: SparkSession, data_dir: str) -> DataFrame:
    """Flight-shaped fact view: lineitem ⋈ orders ⋈ customer ⋈ supplier."""
    li = read_table(spark, data_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_linestatus", "l_shipdate")
    o = read_table(spark, data_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, data_dir, "customer").select("c_custkey", "c_nationkey")
    s = read_table(spark, data_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(c, o.o_custkey == c.c_custkey)
           .join(s, li.l_suppkey == s.s_suppkey))
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    late = (pk * 7 + ok * 3 + ln * 31 + sk * 13) % 211 >= 190 - 2 * (ok % 25)
    delay = (F.when(pk % 89 == 0, F.lit(None).cast("double"))
              .when(late, (16 + ((pk * 5 + ok) % 45) * 5).cast("double"))
              .otherwise(((pk * 11 + ok * 7) % 60 - 44).cast("double")))
    return j.select(
        (ok * 10 + ln).alias("flight_id"),
        F.year("l_shipdate").alias("YEAR"),
        F.month("l_shipdate").alias("MONTH"),
        F.dayofmonth("l_shipdate").alias("DAY"),
        (F.weekday("l_shipdate") + 1).alias("DAY_OF_WEEK"),
        _code("A", sk % 14).alias("AIRLINE"),
        F.when(pk % 97 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("T"), pk.cast("string"))).alias("TAIL_NUMBER"),
        _code("N", F.col("s_nationkey")).alias("ORIGIN_AIRPORT"),
        _code("N", F.col("c_nationkey")).alias("DESTINATION_AIRPORT"),
        ((ok % 25) * 100 + pk % 60).cast("int").alias("SCHEDULED_DEPARTURE"),
        (((ok + ln) % 25) * 100 + sk % 60).cast("int").alias("SCHEDULED_ARRIVAL"),
        (F.col("l_quantity") * 50).alias("DISTANCE"),
        delay.alias("ARRIVAL_DELAY"),
        F.when((F.col("l_returnflag") == "R") & (ln == 7), 1).otherwise(0).alias("CANCELLED"),
        F.when((F.col("l_returnflag") == "A") & (ln == 7) & (F.col("l_linestatus") == "F"), 1)
         .otherwise(0).alias("DIVERTED"),
    )


def airports(spark: SparkSession, data_dir: str) -> DataFrame:
    """Airport dimension from ``nation`` with invented coordinates."""
    n = read_table(spark, data_dir, "nation")
    k = F.col("n_nationkey")
    nocoord = k.isin(3, 11)
    return n.select(
        _code("N", k).alias("IATA_CODE"),
        F.col("n_name").alias("AIRPORT"),
        F.lower("n_name").alias("CITY"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("STATE"),
        F.lit("USA").alias("COUNTRY"),
        F.when(nocoord, F.lit(None).cast("double")).otherwise((k * 3 - 35).cast("double")).alias("LATITUDE"),
        F.when(nocoord, F.lit(None).cast("double")).otherwise((k * 7 - 90).cast("double")).alias("LONGITUDE"),
    )


def airlines(spark: SparkSession, data_dir: str) -> DataFrame:
    """Airline dimension from ``supplier``: one name per airline code."""
    s = read_table(spark, data_dir, "supplier")
    return (s.groupBy(_code("A", F.col("s_suppkey") % 14).alias("IATA_CODE"))
             .agg(F.min("s_name").alias("AIRLINE")))


def slot_log(spark: SparkSession, data_dir: str) -> DataFrame:
    """Session log from ``events``: session = user, slot = event type."""
    e = read_table(spark, data_dir, "events")
    return e.select(
        F.col("user_id").alias("session_id"), F.col("ts"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("slot"), F.col("value"), F.col("props"))


def tool_call_log(spark: SparkSession, data_dir: str) -> DataFrame:
    """Tool-call records from ``events``: one call per event whose JSON
    arguments set the slot named by the event type."""
    e = read_table(spark, data_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), F.col("ts"), F.col("event_id").alias("seq"),
                    F.to_json(F.create_map(F.col("event_type"), F.col("value"))).alias("args"))


def message_log(spark: SparkSession, data_dir: str) -> DataFrame:
    """Message log from ``events`` in short sessions (a user's events among 500
    in a row): tool calls, results, malformed and plain messages by turns, so
    that every rule has rows."""
    e = read_table(spark, data_dir, "events")
    i = F.col("event_id")
    turn, v = i % 11, i % 997
    code = _code("N", i % 25)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    share = F.concat(F.lit("0."), F.lpad(v.cast("string"), 3, "0"))
    bodies = [
        text('{"month": ', i % 12 + 1, ', "day_of_week": ', i % 7 + 1, ', "origin_airport_code": "', code, '", "airline_code": null}'),
        text('{"month": ', i % 12 + 1, ', "day_of_week": 5, "scheduled_departure_hour": ', i % 24, ', "scheduled_arrival_hour": ', v % 24,
             ', "origin_airport_code": "', code, '", "destination_airport_code": "N01", "airline_code": "A0', i % 9, '", "distance": ', v, "}"),
        text('{"origin_airport_code": "", "destination_airport_code": "', code, '", "month": 12}'),
        text('{"query": "', code, '", "month": 3}'),
        text('{"delay_probability": ', share, ', "delayed": true, "delay_minutes": ', v, "}"),
        text('{"delay_probability": ', share, "}"),
        text('{"delay_probability": null, "distance_miles": ', v, ".5}"),
        text('{"distance_miles": 7, "updated_slots": {"airline_code": "A07", "month": null, "distance": ', v, ', "scheduled_departure_hour": 6}}'),
        text('{"distance_miles": ', v),
        text("departing from ", code),
        text('{"success": false, "error": "no route ', v, '"}')]
    body, tool = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, b in enumerate(bodies):
        body = F.when(turn == k, b).otherwise(body)
    for k, name in enumerate(("update_flight_slots", "call_predict_api", "calculate_distance", "search_airports")):
        tool = F.when(turn == k, name).otherwise(tool)
    kind = F.when(turn < 4, "call").when(turn == 9, "user").otherwise("result")
    return e.select((F.col("user_id") * 100000 + F.floor(i / 500)).alias("session_id"), F.col("ts"), i.alias("seq"),
                    kind.alias("kind"), tool.alias("tool"), body.alias("body"))


# ---------------------------------------------------------------------------
# DuckDB text of the same stand-ins (CTE bodies).
TRIPS_SQL = """
SELECT l_orderkey*10 + l_linenumber AS flight_id,
  CAST(year(l_shipdate) AS INTEGER) AS "YEAR",
  CAST(month(l_shipdate) AS INTEGER) AS "MONTH",
  CAST(day(l_shipdate) AS INTEGER) AS "DAY",
  CAST(isodow(l_shipdate) AS INTEGER) AS DAY_OF_WEEK,
  concat('A', lpad(CAST(l_suppkey % 14 AS VARCHAR), 2, '0')) AS AIRLINE,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE concat('T', CAST(l_partkey AS VARCHAR)) END AS TAIL_NUMBER,
  concat('N', lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) AS ORIGIN_AIRPORT,
  concat('N', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS DESTINATION_AIRPORT,
  CAST((l_orderkey % 25)*100 + l_partkey % 60 AS INTEGER) AS SCHEDULED_DEPARTURE,
  CAST(((l_orderkey + l_linenumber) % 25)*100 + l_suppkey % 60 AS INTEGER) AS SCHEDULED_ARRIVAL,
  l_quantity * 50 AS DISTANCE,
  CASE WHEN l_partkey % 89 = 0 THEN NULL
       WHEN (l_partkey*7 + l_orderkey*3 + l_linenumber*31 + l_suppkey*13) % 211 >= 190 - 2*(l_orderkey % 25)
         THEN CAST(16 + ((l_partkey*5 + l_orderkey) % 45)*5 AS DOUBLE)
       ELSE CAST((l_partkey*11 + l_orderkey*7) % 60 - 44 AS DOUBLE) END AS ARRIVAL_DELAY,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 1 ELSE 0 END AS CANCELLED,
  CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 AND l_linestatus = 'F' THEN 1 ELSE 0 END AS DIVERTED
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
"""

AIRPORTS_SQL = """
SELECT concat('N', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS IATA_CODE,
  n_name AS AIRPORT,
  lower(n_name) AS CITY,
  concat('R', CAST(n_regionkey AS VARCHAR)) AS STATE,
  'USA' AS COUNTRY,
  CASE WHEN n_nationkey IN (3, 11) THEN NULL ELSE CAST(n_nationkey*3 - 35 AS DOUBLE) END AS LATITUDE,
  CASE WHEN n_nationkey IN (3, 11) THEN NULL ELSE CAST(n_nationkey*7 - 90 AS DOUBLE) END AS LONGITUDE
FROM nation
"""

AIRLINES_SQL = """
SELECT concat('A', lpad(CAST(s_suppkey % 14 AS VARCHAR), 2, '0')) AS IATA_CODE, min(s_name) AS AIRLINE
FROM supplier GROUP BY 1
"""

SLOT_LOG_SQL = """
SELECT user_id AS session_id, ts, event_id AS seq, event_type AS slot, value, props FROM events
"""

#: The same log as typed columns, without going through JSON.
MESSAGES_SQL = """
SELECT user_id * 100000 + event_id // 500 AS session_id, ts, event_id AS seq, event_id % 11 AS turn, event_id % 997 AS v,
  concat('N', lpad(CAST(event_id % 25 AS VARCHAR), 2, '0')) AS code, event_id AS i FROM events
"""
