"""JSON messages of several kinds as one event table.

Every message becomes an array of canonical event structs, so a table with mixed kinds is
read once, parsed once and exploded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalise_source, parse_event_time

POSITION = (
    "struct<location:string,date_entered:timestamp,date_update:timestamp,"
    "total_activations:int,recent_activations:int>"
)
TZ = "EET"
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}

ABC = "id long, timestamp string, symbol string, price int, volume double"
FITBIT = "fitbit struct<timestamp:string,steps:double,stairs:double,naps:double>"
SCALE = "scale struct<timestamp:string,weight:double,height:double,bmi:double,bmiCategory:string>"
LOCATION = (
    "location string, timestamp string, dateEntered string, dateUpdate string, "
    "totalActivations int, recentActivations int"
)

# Event type, JSON field and code of each reading.
FITBIT_READINGS = [("Steps", "steps", 1), ("Stairs", "stairs", 2), ("Naps", "naps", 4)]
SCALE_READINGS = [("Weight", "weight", 5), ("Height", "height", 6), ("Bmi", "bmi", 7)]
LOCATION_CODE, CATEGORY_CODE, PATIENT = 3, 8, 10


def event(name, ts, source, kind, symbol, value=None, value_str=None, position=None, patient=None) -> Column:
    def or_null(x, of):
        return F.lit(None).cast(of) if x is None else x.cast(of)

    return F.struct(
        name.alias("name"),
        parse_event_time(ts, tz=TZ).alias("ts"),
        F.lit(source).alias("source"),
        kind.alias("event_type"),
        symbol.cast("int").alias("symbol"),
        or_null(value, "double").alias("value"),
        or_null(value_str, "string").alias("value_str"),
        or_null(position, POSITION).alias("position"),
        or_null(patient, "long").alias("patient_id"),
    )


def abc_events(m: Column, seq: Column) -> Column:
    name = F.concat(m["symbol"], m["id"].cast("string"))
    return F.array(event(name, m["timestamp"], "Abc", m["symbol"], m["price"], m["volume"]))


def readings(m: Column, source: str, kinds, seq: Column) -> list[Column]:
    return [
        event(
            F.concat(F.lit(field + "_"), seq.cast("string")), m["timestamp"], source,
            F.lit(kind), F.lit(code), m[field],
        )
        for kind, field, code in kinds
    ]


def fitbit_events(m: Column, seq: Column) -> Column:
    return F.array(*readings(m["fitbit"], "Fitbit", FITBIT_READINGS, seq))


def scale_events(m: Column, seq: Column) -> Column:
    m = m["scale"]
    name = F.concat(F.lit("bmiCat_"), seq.cast("string"))
    category = event(
        name, m["timestamp"], "Scale", F.lit("BmiCat"), F.lit(CATEGORY_CODE), value_str=m["bmiCategory"]
    )
    return F.array(*readings(m, "Scale", SCALE_READINGS, seq), category)


def location_events(m: Column, seq: Column) -> Column:
    position = F.struct(
        m["location"].alias("location"),
        parse_event_time(m["dateEntered"], tz=TZ).alias("date_entered"),
        parse_event_time(m["dateUpdate"], tz=TZ).alias("date_update"),
        m["totalActivations"].alias("total_activations"),
        m["recentActivations"].alias("recent_activations"),
    )
    name = F.concat(F.lit("location_"), seq.cast("string"))
    return F.array(
        event(
            name, m["timestamp"], "Locations", m["location"], F.lit(LOCATION_CODE),
            position=F.when(m["location"].isNotNull(), position), patient=F.lit(PATIENT),
        )
    )


# Message kind (capitalised topic) to JSON schema and event builder.
MESSAGE_KINDS: dict[str, tuple[str, Callable[[Column, Column], Column]]] = {
    "Abc": (ABC, abc_events),
    "Fitbit": (FITBIT, fitbit_events),
    "Scale": (SCALE, scale_events),
    "Location": (LOCATION, location_events),
}


def explode_events(df: DataFrame, kind: Column, names, json_col: str, seq: str) -> DataFrame:
    """Parse each message once, by the schema of its kind, then build its events.

    No message is lost: one of an unknown kind, or whose text does not parse, gives one row without event, and one
    with a damaged field keeps its text in ``_corrupt_record`` on all its events; ``quarantine`` returns both.
    """
    rest = [c for c in df.columns if c not in (json_col, "_corrupt_record")]
    text = F.col(json_col)
    parsed = df.select(
        *rest, text.alias("_raw"),
        *[
            F.when(kind == n, F.from_json(text, f"{MESSAGE_KINDS[n][0]}, _corrupt_record string", PERMISSIVE)).alias(f"_m_{n}")
            for n in names
        ],
        kind.alias("_kind"),
    )
    made = F.lit(None)
    for n in names:
        made = F.when(F.col("_kind") == n, MESSAGE_KINDS[n][1](F.col(f"_m_{n}"), F.col(seq))).otherwise(made)
    damaged = F.coalesce(*[F.col(f"_m_{n}")["_corrupt_record"] for n in names])
    known = F.coalesce(F.col("_kind").isin(*names), F.lit(False))
    damaged = F.when(known, damaged).otherwise(F.coalesce("_raw", F.lit("")))
    out = parsed.select(*rest, F.explode_outer(made).alias("_ev"), "_raw", damaged.alias("_corrupt_record"))
    return out.select(*rest, "_ev.*", "_raw", "_corrupt_record")


def normalise_abc(df: DataFrame, json_col: str = "value", seq: str = "arrival_seq") -> DataFrame:
    """Letter messages: one event, type = symbol, value = volume, symbol = price."""
    return explode_events(df, F.lit("Abc"), ["Abc"], json_col, seq)


def normalise_fitbit(df: DataFrame, json_col: str = "value", seq: str = "arrival_seq") -> DataFrame:
    """Fitbit messages: Steps, Stairs and Naps."""
    return explode_events(df, F.lit("Fitbit"), ["Fitbit"], json_col, seq)


def normalise_scale(df: DataFrame, json_col: str = "value", seq: str = "arrival_seq") -> DataFrame:
    """Scale messages: Weight, Height, Bmi and BmiCat (a text)."""
    return explode_events(df, F.lit("Scale"), ["Scale"], json_col, seq)


def normalise_location(df: DataFrame, json_col: str = "value", seq: str = "arrival_seq") -> DataFrame:
    """Location messages: one event whose type is the room, with the position nested."""
    return explode_events(df, F.lit("Location"), ["Location"], json_col, seq)


def normalise(
    df: DataFrame, kind_col: str = "kind", json_col: str = "value", seq: str = "arrival_seq"
) -> DataFrame:
    """Mixed messages: the parser is picked per row by the kind (case of its first letter
    does not matter).  Rows of an unknown kind have no event and go to ``quarantine``."""
    kind = capitalise_source(kind_col)
    kind = F.when(F.upper(kind) == "ABC", "Abc").when(kind == "Locations", "Location").otherwise(kind)
    return explode_events(df, kind, ["Abc", "Fitbit", "Scale", "Location"], json_col, seq)


def quarantine(df: DataFrame, ts: str = "ts", also: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows that did not parse or have no usable time go to ``bad``."""
    bad = F.col(ts).isNull()
    if "_corrupt_record" in df.columns:
        bad = bad | F.col("_corrupt_record").isNotNull()
    if also is not None:
        bad = bad | F.coalesce(also, F.lit(False))
    return df.filter(~bad), df.filter(bad)


def until_sentinel(df: DataFrame, json_col: str = "value", seq: str = "arrival_seq") -> DataFrame:
    """Messages that arrived before the first ``{"Terminate": true}``."""
    stop = F.get_json_object(json_col, "$.Terminate") == "true"
    first = df.filter(stop).agg(F.min(seq).alias("_stop"))
    stop_at = first.scalar()
    return df.filter(stop_at.isNull() | (F.col(seq) < stop_at))
