"""Lookup joins (J1–J6), hub flags (F11) and distances.

Lookups are left equi-joins. A lookup side is broadcast only when its row
count is known and its rows and bytes are under ``BROADCAST_MAX_ROWS`` and
``BROADCAST_MAX_BYTES``; otherwise the join is left
to the planner (sort-merge / shuffle-hash, AQE may still convert it at
runtime from measured sizes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X


def sized(table: DataFrame, rows: int | None = None, max_rows: int = C.BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint behind a size check. ``rows`` is the known row count
    (e.g. recorded when a fitted table was written); when unknown it is
    counted, which is cheap for materialised tables."""
    n = table.count() if rows is None else rows
    return F.broadcast(table) if n <= max_rows and n * row_width(table) <= C.BROADCAST_MAX_BYTES else table


def row_width(table: DataFrame) -> int:
    """Bytes of a row in a broadcast table by its schema: 8 a number, 32 a
    string, 256 anything nested, 16 for the row itself."""
    simple = {"string": 32}
    return 16 + sum(256 if t.startswith(("array", "map", "struct")) else simple.get(t, 8) for _, t in table.dtypes)


def first_per_key(dim: DataFrame, key: str) -> DataFrame:
    """One row per key ("first match"): the minimum row by all columns,
    which is deterministic regardless of file order."""
    others = [c for c in dim.columns if c != key]
    if not others:
        return dim.dropDuplicates([key])
    s = F.min(F.struct(*[F.col(c) for c in others])).alias("_r")
    return dim.groupBy(key).agg(s).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def lookup_codes(probe: DataFrame, code_col: str, dim: DataFrame, key: str = "IATA_CODE",
                 prefix: str = "", dim_rows: int | None = None) -> DataFrame:
    """Attach dimension columns by an upper-cased code; no match -> nulls."""
    d = first_per_key(dim, key)
    d = d.select(*[F.col(c).alias(prefix + c) for c in d.columns])
    p = probe.withColumn("_code", X.norm_code(code_col))
    out = p.join(sized(d, dim_rows), p["_code"] == d[prefix + key], "left")
    return out.drop("_code")


def distance_between(pairs: DataFrame, airports: DataFrame, origin="origin_code", dest="dest_code",
                     airports_rows: int | None = None) -> DataFrame:
    """Two-role dimension join + great-circle distance.

    Adds ``distance_miles`` and ``error``: 'airport_not_found' when either
    code is unknown, 'missing_coordinates' when a found airport has no
    coordinates (the distance is then null)."""
    a = first_per_key(airports.select("IATA_CODE", "LATITUDE", "LONGITUDE"), "IATA_CODE")
    n = a.count() if airports_rows is None else airports_rows
    o = a.select(F.col("IATA_CODE").alias("_o_code"), F.col("LATITUDE").alias("_o_lat"),
                 F.col("LONGITUDE").alias("_o_lon"))
    d = a.select(F.col("IATA_CODE").alias("_d_code"), F.col("LATITUDE").alias("_d_lat"),
                 F.col("LONGITUDE").alias("_d_lon"))
    p = pairs.withColumns({"_oc": X.norm_code(origin), "_dc": X.norm_code(dest)})
    j = (p.join(sized(o, n), p["_oc"] == o["_o_code"], "left")
          .join(sized(d, n), p["_dc"] == d["_d_code"], "left"))
    dist = X.haversine_miles("_o_lat", "_o_lon", "_d_lat", "_d_lon")
    err = (F.when(F.col("_o_code").isNull() | F.col("_d_code").isNull(), F.lit("airport_not_found"))
            .when(dist.isNull(), F.lit("missing_coordinates")))
    return (j.withColumns({"distance_miles": dist, "error": err})
             .drop("_oc", "_dc", "_o_code", "_d_code", "_o_lat", "_o_lon", "_d_lat", "_d_lon"))


def add_hub_flags(df: DataFrame, hubs: DataFrame, hubs_rows: int | None = None,
                  origin="ORIGIN_AIRPORT", dest="DESTINATION_AIRPORT") -> DataFrame:
    """IS_ORIGIN_HUB / IS_DEST_HUB via two left joins to the hub set
    (null code -> 0, like pandas isin)."""
    h = hubs.select(F.col("HUB_AIRPORT")).distinct()
    n = h.count() if hubs_rows is None else hubs_rows
    ho = sized(h.select(F.col("HUB_AIRPORT").alias("_ho"), F.lit(1).alias("IS_ORIGIN_HUB")), n)
    hd = sized(h.select(F.col("HUB_AIRPORT").alias("_hd"), F.lit(1).alias("IS_DEST_HUB")), n)
    out = (df.join(ho, df[origin] == ho["_ho"], "left")
             .join(hd, F.col(dest) == hd["_hd"], "left"))
    return (out.withColumns({"IS_ORIGIN_HUB": F.coalesce("IS_ORIGIN_HUB", F.lit(0)),
                             "IS_DEST_HUB": F.coalesce("IS_DEST_HUB", F.lit(0))})
               .drop("_ho", "_hd"))


def lookup_with_fallback(df: DataFrame, table: DataFrame, key: str, cols: dict, rows: int | None = None,
                         df_key: str | None = None) -> DataFrame:
    """Left join a fitted (key -> value) table and fill misses with
    a global value. ``cols`` maps table column -> (output name, fallback)."""
    t = table.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_v_{c}") for c in cols])
    j = df.join(sized(t, rows), F.col(df_key or key) == F.col("_k"), "left")
    def fill(c, fb):
        v = F.col(f"_v_{c}")
        return v if fb is None else F.coalesce(v, F.lit(fb).cast(table.schema[c].dataType))
    return j.withColumns({out: fill(c, fb) for c, (out, fb) in cols.items()}
                         ).drop("_k", *[f"_v_{c}" for c in cols])
