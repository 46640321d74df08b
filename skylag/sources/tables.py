"""Readers with explicit schemas and an existence check.

The fact table of the domain is a flights table (schema ``FLIGHTS``); the
two dimensions are airports and airlines. The driver's Parquet tables are
read with their own explicit schemas (``TABLE_SCHEMAS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_I, _L, _D, _S = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()
_TS = T.TimestampNTZType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


FLIGHTS = _schema(
    ("YEAR", _I), ("MONTH", _I), ("DAY", _I), ("DAY_OF_WEEK", _I), ("AIRLINE", _S),
    ("FLIGHT_NUMBER", _I), ("TAIL_NUMBER", _S), ("ORIGIN_AIRPORT", _S),
    ("DESTINATION_AIRPORT", _S), ("SCHEDULED_DEPARTURE", _I), ("DEPARTURE_TIME", _D),
    ("DEPARTURE_DELAY", _D), ("TAXI_OUT", _D), ("WHEELS_OFF", _D), ("SCHEDULED_TIME", _D),
    ("ELAPSED_TIME", _D), ("AIR_TIME", _D), ("DISTANCE", _D), ("WHEELS_ON", _D),
    ("TAXI_IN", _D), ("SCHEDULED_ARRIVAL", _I), ("ARRIVAL_TIME", _D), ("ARRIVAL_DELAY", _D),
    ("DIVERTED", _I), ("CANCELLED", _I), ("CANCELLATION_REASON", _S),
    ("AIR_SYSTEM_DELAY", _D), ("SECURITY_DELAY", _D), ("AIRLINE_DELAY", _D),
    ("LATE_AIRCRAFT_DELAY", _D), ("WEATHER_DELAY", _D),
)
AIRPORTS = _schema(("IATA_CODE", _S), ("AIRPORT", _S), ("CITY", _S), ("STATE", _S),
                   ("COUNTRY", _S), ("LATITUDE", _D), ("LONGITUDE", _D))
AIRLINES = _schema(("IATA_CODE", _S), ("AIRLINE", _S))

TABLE_SCHEMAS = {
    "region": _schema(("r_regionkey", _I), ("r_name", _S)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _schema(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _schema(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _schema(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
    "embeddings": _schema(("vec_id", _L), ("embedding", T.ArrayType(T.FloatType())), ("label", _I)),
    "conversations": _schema(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
    "documents": _schema(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L)),
    "labels": _schema(("doc_id", _L), ("quality", _I), ("toxic", _I)),
    "pages": _schema(("page_id", _L), ("url", _S), ("html", _S)),
    "benchmark": _schema(("item_id", _L), ("text", _S)),
}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def path_size(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


SPREAD_BYTES, SPREAD_LEAST, SPREAD_SMALL = 32 << 20, 8, 1 << 20


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly: a file of one row group is read by one task,
    which then would do all the work behind it."""
    return df.repartition(F.xxhash64(*df.columns))


def spread(df: DataFrame, size_bytes: int, per_partition: int = SPREAD_BYTES) -> DataFrame:
    """Layout of data that is read many times (model training): rows are dealt
    by their hash over one partition per ``per_partition`` stored bytes, 8 at
    least or as many as it has MB (a level of a tree is a job: tasks of a few
    thousand rows cost more to start than to run). A fixed rule of the data
    alone, so that a fitted model does not depend on the number of cores or on
    how the files were cut."""
    n = max(1, min(SPREAD_LEAST, -(-size_bytes // SPREAD_SMALL)), -(-size_bytes // per_partition))
    return df.repartition(n, F.xxhash64(*df.columns))


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One driver table with its explicit schema."""
    path = f"{data_dir.rstrip('/')}/{name}.parquet"
    return _nan_to_null(spark.read.schema(TABLE_SCHEMAS[name]).parquet(path))


def load_raw_tables(spark: SparkSession, data_dir: str, names) -> dict[str, DataFrame]:
    """Check every input exists first, then read them all lazily."""
    paths = {n: f"{data_dir.rstrip('/')}/{n}.parquet" for n in names}
    for n, p in paths.items():
        if not path_exists(spark, p):
            raise FileNotFoundError(f"Required data file not found: {p}")
    return {n: read_table(spark, data_dir, n) for n in names}


def _nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares greater than any number in Spark; pandas treats it as
    missing. Normalise to null at the read boundary."""
    cols = [F.nanvl(F.col(f.name), F.lit(None).cast(_D)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def read_flights_csv(spark: SparkSession, path: str) -> DataFrame:
    """The flights CSV with its explicit schema (no inference pass); the
    header names are validated against the schema (``enforceSchema`` off),
    so a file with another column order fails instead of being mis-read.
    Malformed rows are not in the result: ``rejected_flights`` has them."""
    return _nan_to_null(_flights_csv(spark, path).where(F.col(_CORRUPT).isNull() & _whole_row()).drop(_CORRUPT))


def rejected_flights(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the flights CSV that its schema cannot hold, with the raw line
    in ``_corrupt_record``: write or count them beside the load."""
    return _flights_csv(spark, path).where(F.col(_CORRUPT).isNotNull() & _whole_row())


def rejection_reasons(rejected: DataFrame) -> DataFrame:
    """The rejected rows with ``reason``: ``columns`` if the line has not one
    field per column, else the first column whose field is no number (quoted
    fields hold no commas in this layout)."""
    fields = F.split(_CORRUPT, ",", -1)
    numbers = [F.when((fields[i] != "") & fields[i].try_cast("double").isNull(), F.lit(f.name))
               for i, f in enumerate(FLIGHTS.fields) if not isinstance(f.dataType, T.StringType)]
    return rejected.withColumn("reason", F.when(F.size(fields) != len(FLIGHTS.fields), "columns").otherwise(F.coalesce(*numbers)))


_CORRUPT = "_corrupt_record"


def _whole_row():
    """Always true, but needs every column: the reader then parses whole rows,
    and which of them are malformed does not depend on a query's columns."""
    return F.length(F.concat_ws(",", *[F.col(f.name).cast("string") for f in FLIGHTS.fields])) >= 0


def _flights_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*FLIGHTS.fields, T.StructField(_CORRUPT, T.StringType())])
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).csv(path))


def read_airports_csv(spark: SparkSession, path: str) -> DataFrame:
    df = (spark.read.schema(AIRPORTS).option("header", True).option("enforceSchema", False)
          .option("encoding", "UTF-8").csv(path))
    return _nan_to_null(df)


def read_airlines_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AIRLINES).option("header", True).option("enforceSchema", False).csv(path)


def load_flight_data(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """S1 for the domain's own CSV layout: flights, airports, airlines."""
    files = {"flights": "flights.csv", "airports": "airports.csv", "airlines": "airlines.csv"}
    for f in files.values():
        p = f"{data_dir.rstrip('/')}/{f}"
        if not path_exists(spark, p):
            raise FileNotFoundError(f"Required data file not found: {p}")
    d = data_dir.rstrip("/")
    return {
        "flights": read_flights_csv(spark, f"{d}/flights.csv"),
        "airports": read_airports_csv(spark, f"{d}/airports.csv"),
        "airlines": read_airlines_csv(spark, f"{d}/airlines.csv"),
    }
