"""Session state tables from ordered logs.

A session log has one row per event: (session_id, ts, seq, slot, value,
payload...). The state of a session is the latest non-null value of each
slot. It is computed with ONE group-by per session using ``max_by`` keyed
on (ts, seq): partial aggregation keeps one candidate per slot per map
task, so a session with a third of all events is still combined map-side
and never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from . import clean as P


def _order_key(ts="ts", seq="seq"):
    return F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))


def slot_state(log: DataFrame, slots, session="session_id", slot="slot", value="value",
               ts="ts", seq="seq") -> DataFrame:
    """One row per session, one column per declared slot holding
    the latest non-null value (null when never set)."""
    key = _order_key(ts, seq)
    aggs = [F.max_by(F.col(value), F.when((F.col(slot) == s) & F.col(value).isNotNull(), key)).alias(s)
            for s in slots]
    return log.groupBy(session).agg(*aggs)


def _typed(fields) -> dict[str, str]:
    return dict(fields) if isinstance(fields, dict) else {f: "DOUBLE" for f in fields}


def slot_state_from_calls(calls: DataFrame, fields, args="args", session="session_id", ts="ts",
                          seq="seq") -> DataFrame:
    """K1 in the tool-call form: each record carries a JSON object of slot
    arguments (any subset of ``fields``: a name -> type mapping, or names of
    DOUBLE slots); malformed JSON is ignored (PERMISSIVE parse) and null
    arguments never overwrite a slot. One group-by per session with
    ``max_by`` per field (map-side combined)."""
    fields = _typed(fields)
    schema = ", ".join(f"`{f}` {t}" for f, t in fields.items())
    parsed = calls.withColumn("_a", X.parse_json(args, schema))
    key = _order_key(ts, seq)
    aggs = [F.max_by(F.col(f"_a.{f}"), F.when(F.col(f"_a.{f}").isNotNull(), key)).alias(f) for f in fields]
    return parsed.groupBy(session).agg(*aggs)


#: Fixed: tools whose arguments set any slot, and the one that sets the two airports only.
SLOT_TOOLS = ("call_predict_api", "update_flight_slots")
DISTANCE_TOOL = "calculate_distance"
AIRPORT_SLOTS = ("origin_airport_code", "destination_airport_code")


def state_from_messages(log: DataFrame, fields: dict[str, str], session="session_id", kind="kind", tool="tool",
                        body="body", ts="ts", seq="seq", distance_slot="distance") -> DataFrame:
    """K1 + W5 from a message log: one row per session with its slots and the
    last prediction (struct delay_probability, delayed, delay_minutes; null if
    there is none).

    A ``call`` row has the tool's name and its JSON arguments: ``SLOT_TOOLS``
    set every non-null slot, ``DISTANCE_TOOL`` only the two airports, if not
    empty; other tools set none. A ``result`` row has a JSON object:
    ``distance_miles`` sets ``distance_slot``, non-null entries of
    ``updated_slots`` set their slots (and win within one message), a non-null
    ``delay_probability`` makes a prediction, with defaults false and 0.0.
    Malformed JSON sets nothing. One group-by per session, combined map-side."""
    slots = ", ".join(f"`{f}` {t}" for f, t in fields.items())
    call = X.parse_json(body, slots)
    result = X.parse_json(body, f"delay_probability DOUBLE, delayed BOOLEAN, delay_minutes DOUBLE, distance_miles DOUBLE, "
                                f"updated_slots STRUCT<{slots.replace('` ', '`: ')}>")
    rows = (log.withColumn("_c", F.when(F.col(kind) == "call", call)).withColumn("_r", F.when(F.col(kind) == "result", result)))
    key = _order_key(ts, seq)

    def value(f: str):
        told = F.when(F.col(tool).isin(*SLOT_TOOLS), F.col(f"_c.{f}"))
        if f in AIRPORT_SLOTS:
            told = F.coalesce(told, F.when((F.col(tool) == DISTANCE_TOOL) & (F.col(f"_c.{f}") != ""), F.col(f"_c.{f}")))
        got = [F.col(f"_r.updated_slots.{f}")] + ([F.col("_r.distance_miles").cast(fields[f])] if f == distance_slot else [])
        return F.coalesce(told, *got)

    prediction = F.when(F.col("_r.delay_probability").isNotNull(), F.struct(
        F.col("_r.delay_probability").alias("delay_probability"), F.coalesce("_r.delayed", F.lit(False)).alias("delayed"),
        F.coalesce("_r.delay_minutes", F.lit(0.0)).alias("delay_minutes")))
    named = {f: value(f) for f in fields} | {"last_prediction": prediction}
    rows = rows.select(session, key.alias("_k"), *[v.alias(n) for n, v in named.items()])
    return rows.groupBy(session).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_k"))).alias(n) for n in named])


def status_from_messages(log: DataFrame, fields: dict[str, str] = C.SLOT_TYPES, session="session_id", **columns) -> DataFrame:
    """K1 + W5 + P12 + P14 + K2 + F26 in one pass over the message log: the
    slots, the last prediction, the missing slots, whether a prediction may be
    asked for (with the reason if not) and the reply. ``columns`` are those of
    ``state_from_messages``; the log is grouped once and joined with nothing."""
    s = P.gate(state_from_messages(log, fields, session=session, **columns), list(fields))
    return s.withColumn("reply", X.reply_fallback(F.col("last_prediction.delay_probability"), "missing"))


def latest_record(log: DataFrame, record, session="session_id", ts="ts", seq="seq",
                  name="last_record") -> DataFrame:
    """Latest non-null record (e.g. a prediction struct) per session."""
    key = F.when(record.isNotNull(), _order_key(ts, seq))
    return log.groupBy(session).agg(F.max_by(record, key).alias(name))


def keep_last(df: DataFrame, n=C.SESSION_HISTORY, session="conv_id", order="turn") -> DataFrame:
    """The last ``n`` messages of each session. ``row_number() <= n``
    plans as a partial (map-side) + final WindowGroupLimit."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def session_status(log: DataFrame, slots, record, session="session_id") -> DataFrame:
    """K2: slots, missing list, completeness, last record and reply text.
    ``record`` is a struct with a ``delay_probability`` field. The log is
    grouped once."""
    key = _order_key()
    told = [F.max_by("value", F.when((F.col("slot") == s) & F.col("value").isNotNull(), key)).alias(s) for s in slots]
    last = F.max_by(record, F.when(record.isNotNull(), key)).alias("last_record")
    s = log.groupBy(session).agg(*told, last)
    s = s.withColumn("missing", X.missing_fields(list(slots))).withColumn("complete", F.size("missing") == 0)
    return s.withColumn("reply", X.reply_fallback(F.col("last_record.delay_probability"), "missing"))
