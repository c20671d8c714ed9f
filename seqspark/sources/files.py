"""Event files: delimited stock, check and OHLCV rows, and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import digits, parse_event_time

STOCK = "event_id long, ts long, symbol int, price int, volume int"
CHECK = "event_id long, ts long, src string, dst string"
OHLCV = "key string, ts long, open double, peak double, low double, close double, volume double"
JSON = "id long, timestamp string, symbol string, price int, volume double, out_of_order boolean, _corrupt_record string"

# Numeric codes of the known tickers; any other ticker has none.
TICKERS = {"AAPL": 0, "AMZN": 1, "FB": 2, "AVID": 3}


def delimited(spark: SparkSession, path: str, schema: str, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return (
        reader.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def read_stock_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """``id, ts, symbol, price, volume`` with or without a blank after the comma."""
    return delimited(spark, path, STOCK, streaming)


def read_check_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """``id, ts, src, dst``; the numbers inside src and dst become comparable columns."""
    df = delimited(spark, path, CHECK, streaming)
    return df.withColumns({"src_no": digits("src"), "dst_no": digits("dst")})


def ticker_code(col: str) -> Column:
    out = F.lit(None).cast("int")
    for name, code in TICKERS.items():
        out = F.when(F.col(col) == name, code).otherwise(out)
    return out


def read_ohlcv_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """``key,ts,open,peak,low,close,volume`` with a ticker code and an id.

    The id is 128 bits of the whole row, so ticks of one ticker and time differ, rows that are equal in every field are
    one event, and nothing depends on file splits.
    """
    df = delimited(spark, path, OHLCV, streaming)
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.md5(row).alias("event_id"), "*", ticker_code("key").alias("symbol"))


def read_json_events(spark: SparkSession, path: str, streaming: bool = False, tz: str = "EET") -> DataFrame:
    """JSON lines ``{id, timestamp, symbol, price, volume, out_of_order}``.

    Lines that do not parse keep their text in ``_corrupt_record`` (see ``quarantine``).
    """
    reader = spark.readStream if streaming else spark.read
    df = reader.schema(JSON).option("mode", "PERMISSIVE").json(path)
    return df.select(
        F.col("id").alias("event_id"), parse_event_time("timestamp", tz=tz).alias("ts"),
        "symbol", "price", "volume", "out_of_order", "_corrupt_record",
    )
