"""DuckDB oracle text: shared CTEs for the flights-shaped stand-in.

Each oracle query is self-contained: ``with_(...)`` prefixes the CTEs it
needs. Derived doubles are rounded to 6 digits on both engines.
"""

from __future__ import annotations

from ..sources.fixtures import AIRLINES_SQL, AIRPORTS_SQL, SLOT_LOG_SQL, TRIPS_SQL

TRAIN = "(1, 2, 3, 4, 5, 6, 7, 8, 9, 10)"
TEST = "(11, 12)"


def slot_case(h: str) -> str:
    return (f"CASE WHEN {h} > -1 AND {h} <= 5 THEN 'night' WHEN {h} > 5 AND {h} <= 11 THEN 'morning' "
            f"WHEN {h} > 11 AND {h} <= 17 THEN 'afternoon' WHEN {h} > 17 AND {h} <= 23 THEN 'evening' END")


DIST_CASE = ("CASE WHEN DISTANCE >= 0 AND DISTANCE < 500 THEN 'short' "
             "WHEN DISTANCE >= 500 AND DISTANCE < 1500 THEN 'medium' WHEN DISTANCE >= 1500 THEN 'long' END")


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


LATE = "CASE WHEN ARRIVAL_DELAY > 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"

CTE = {
    "trips": f"trips AS ({TRIPS_SQL})",
    "airports": f"airports AS ({AIRPORTS_SQL})",
    "airlines": f"airlines AS ({AIRLINES_SQL})",
    "slot_log": f"slot_log AS ({SLOT_LOG_SQL})",
    "clean": ("clean AS (SELECT * EXCLUDE (CANCELLED, DIVERTED) FROM trips WHERE CANCELLED = 0 AND DIVERTED = 0 "
              "AND ARRIVAL_DELAY IS NOT NULL AND SCHEDULED_DEPARTURE IS NOT NULL AND TAIL_NUMBER IS NOT NULL)"),
    "eda": ("eda AS (SELECT *, CAST((SCHEDULED_DEPARTURE // 100) % 24 AS INTEGER) AS DEP_HOUR, "
            "CAST((SCHEDULED_ARRIVAL // 100) % 24 AS INTEGER) AS ARR_HOUR, "
            "ORIGIN_AIRPORT || '-' || DESTINATION_AIRPORT AS ROUTE "
            "FROM trips WHERE CANCELLED = 0 AND ARRIVAL_DELAY IS NOT NULL)"),
    "hours": ("hours AS (SELECT *, CAST((SCHEDULED_DEPARTURE // 100) % 24 AS INTEGER) AS DEP_HOUR, "
              "CAST((SCHEDULED_ARRIVAL // 100) % 24 AS INTEGER) AS ARR_HOUR FROM clean)"),
    "prep": (
        "prep AS (SELECT *, "
        f"{slot_case('DEP_HOUR')} AS DEP_TIME_SLOT, {slot_case('ARR_HOUR')} AS ARR_TIME_SLOT, "
        f"{flag('DEP_HOUR IN (7, 8, 9, 17, 18, 19, 20)')} AS DEP_IS_PEAK_HOUR, "
        f"{flag('ARR_HOUR IN (7, 8, 9, 17, 18, 19, 20)')} AS ARR_IS_PEAK_HOUR, "
        f"{flag('DEP_HOUR IN (0, 1, 2, 3, 4, 5, 21, 22, 23)')} AS DEP_IS_RED_EYE, "
        f"{flag('ARR_HOUR IN (0, 1, 2, 3, 4, 5, 21, 22, 23)')} AS ARR_IS_RED_EYE, "
        f"{flag('DAY_OF_WEEK IN (6, 7)')} AS IS_WEEKEND, "
        f"{flag('"MONTH" IN (6, 7, 8)')} AS IS_SUMMER, "
        f"{flag('"MONTH" IN (7, 8, 12)')} AS IS_HOLIDAY_SEASON, "
        "sin(2*pi()*\"MONTH\"/12) AS MONTH_SIN, cos(2*pi()*\"MONTH\"/12) AS MONTH_COS, "
        "sin(2*pi()*DAY_OF_WEEK/7) AS DAY_SIN, cos(2*pi()*DAY_OF_WEEK/7) AS DAY_COS, "
        "sin(2*pi()*DEP_HOUR/24) AS DEP_HOUR_SIN, cos(2*pi()*DEP_HOUR/24) AS DEP_HOUR_COS, "
        "sin(2*pi()*ARR_HOUR/24) AS ARR_HOUR_SIN, cos(2*pi()*ARR_HOUR/24) AS ARR_HOUR_COS "
        "FROM hours)"),
    "routed": ("routed AS (SELECT *, ORIGIN_AIRPORT || '-' || DESTINATION_AIRPORT AS ROUTE, "
               f"{DIST_CASE} AS DISTANCE_CAT FROM prep)"),
    "tr": f"tr AS (SELECT * FROM routed WHERE \"MONTH\" IN {TRAIN})",
    "te": f"te AS (SELECT * FROM routed WHERE \"MONTH\" IN {TEST})",
    "g": f"g AS (SELECT avg(ARRIVAL_DELAY) AS gm, avg({LATE}) AS gr FROM tr)",
    "rs": f"rs AS (SELECT ROUTE, avg(ARRIVAL_DELAY) AS m, avg({LATE}) AS r FROM tr WHERE ROUTE IS NOT NULL GROUP BY ROUTE)",
    "als": f"als AS (SELECT AIRLINE, avg(ARRIVAL_DELAY) AS m, avg({LATE}) AS r FROM tr WHERE AIRLINE IS NOT NULL GROUP BY AIRLINE)",
    "hs": f"hs AS (SELECT DEP_HOUR, avg(ARRIVAL_DELAY) AS m, avg({LATE}) AS r FROM tr WHERE DEP_HOUR IS NOT NULL GROUP BY DEP_HOUR)",
    "os": "os AS (SELECT ORIGIN_AIRPORT, avg(ARRIVAL_DELAY) AS m FROM tr WHERE ORIGIN_AIRPORT IS NOT NULL GROUP BY ORIGIN_AIRPORT)",
    "ds": ("ds AS (SELECT DESTINATION_AIRPORT, avg(ARRIVAL_DELAY) AS m FROM tr WHERE DESTINATION_AIRPORT IS NOT NULL "
           "GROUP BY DESTINATION_AIRPORT)"),
    "traffic": ("traffic AS (SELECT airport, CAST(sum(d) AS BIGINT) AS departures, CAST(sum(a) AS BIGINT) AS arrivals, "
                "CAST(sum(d) + sum(a) AS BIGINT) AS total_movements FROM ("
                "SELECT ORIGIN_AIRPORT AS airport, 1 AS d, 0 AS a FROM tr UNION ALL "
                "SELECT DESTINATION_AIRPORT AS airport, 0 AS d, 1 AS a FROM tr) WHERE airport IS NOT NULL GROUP BY airport)"),
    "hubs": ("hubs AS (SELECT airport FROM traffic WHERE total_movements >= "
             "(SELECT quantile_cont(total_movements, 0.9) FROM traffic))"),
    # fitted features applied to a frame named by the {src} placeholder
}

ORDER = ["trips", "airports", "airlines", "slot_log", "clean", "eda", "hours", "prep", "routed", "tr", "te",
         "g", "rs", "als", "hs", "os", "ds", "traffic", "hubs"]

DEPS = {
    "clean": ["trips"], "eda": ["trips"], "hours": ["clean"], "prep": ["hours"], "routed": ["prep"],
    "tr": ["routed"], "te": ["routed"], "g": ["tr"], "rs": ["tr"], "als": ["tr"], "hs": ["tr"],
    "os": ["tr"], "ds": ["tr"], "traffic": ["tr"], "hubs": ["traffic"],
}


def featured(src: str, name: str) -> str:
    """CTE applying the train-fitted statistics to frame ``src``."""
    return (
        f"{name} AS (SELECT s.*, "
        "coalesce(rs.m, g.gm) AS ROUTE_DELAY_MEAN, coalesce(rs.r, g.gr) AS ROUTE_DELAY_RATE_15, "
        "coalesce(als.m, g.gm) AS AIRLINE_DELAY_MEAN, coalesce(als.r, g.gr) AS AIRLINE_DELAY_RATE_15, "
        "coalesce(hs.m, g.gm) AS HOUR_DELAY_MEAN, coalesce(hs.r, g.gr) AS HOUR_DELAY_RATE_15, "
        "CASE WHEN ho.airport IS NULL THEN 0 ELSE 1 END AS IS_ORIGIN_HUB, "
        "CASE WHEN hd.airport IS NULL THEN 0 ELSE 1 END AS IS_DEST_HUB, "
        "coalesce(rs.m, g.gm) AS ROUTE_TE, coalesce(als.m, g.gm) AS AIRLINE_TE, "
        "coalesce(os.m, g.gm) AS ORIGIN_AIRPORT_TE, coalesce(ds.m, g.gm) AS DESTINATION_AIRPORT_TE "
        f"FROM {src} s CROSS JOIN g "
        "LEFT JOIN rs ON s.ROUTE = rs.ROUTE LEFT JOIN als ON s.AIRLINE = als.AIRLINE "
        "LEFT JOIN hs ON s.DEP_HOUR = hs.DEP_HOUR LEFT JOIN os ON s.ORIGIN_AIRPORT = os.ORIGIN_AIRPORT "
        "LEFT JOIN ds ON s.DESTINATION_AIRPORT = ds.DESTINATION_AIRPORT "
        "LEFT JOIN hubs ho ON s.ORIGIN_AIRPORT = ho.airport LEFT JOIN hubs hd ON s.DESTINATION_AIRPORT = hd.airport)")


FEATURE_CTES = ["g", "rs", "als", "hs", "os", "ds", "traffic", "hubs"]


def with_(names, body: str, extra=()) -> str:
    """``WITH`` clause holding the named CTEs (+ their dependencies)."""
    need: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in need:
            need.append(n)
    for n in names:
        add(n)
    parts = [CTE[n] for n in ORDER if n in need] + list(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body
