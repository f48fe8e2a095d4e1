"""Loads that keep what they refuse: every line of a file or message of a feed is judged, and none is lost.

A judged table has the fields, the raw text and a reason, which is null for what is accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_FIELDS = ("symbol", "action", "shares", "price", "date", "commission", "notes")
FEED = "ev string, sym string, t long, p double, s double, bp double, ap double"


@dataclass(frozen=True)
class Judged:
    accepted: int
    rejected: int


def judge_trades(spark: SparkSession, path: str) -> DataFrame:
    """S5 the lines of CSV files with a header, in the order symbol, action, shares, price, date, commission, notes. Short lines lack their
    last fields, further fields are let go. Symbols are trimmed and in upper case, actions in lower case; a price that is no number is
    0. Reasons, the first that holds: symbol or date empty, shares no finite number above 0, action neither buy nor sell."""
    schema = ", ".join(f"_{c} string" for c in CSV_FIELDS) + ", _raw string"
    lines = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_raw", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    text = {c: F.trim(F.coalesce(f"_{c}", F.lit(""))) for c in CSV_FIELDS}
    number = {c: text[c].try_cast("double") for c in ("shares", "price", "commission")}
    finite = (number["shares"] > 0) & (number["shares"] < float("inf"))
    symbol, action = F.upper(text["symbol"]), F.lower(text["action"])
    reason = (
        F.when(symbol == "", "symbol").when(text["date"] == "", "date").when(~F.coalesce(finite, F.lit(False)), "shares")
        .when(~action.isin("buy", "sell"), "action")
    )
    raw = F.coalesce("_raw", F.to_csv(F.struct(*[f"_{c}" for c in CSV_FIELDS])))
    return lines.select(
        symbol.alias("symbol"), action.alias("action"), number["shares"].alias("shares"), F.coalesce(number["price"], F.lit(0.0)).alias("price"), text["date"].alias("date"),
        number["commission"].alias("commission"), F.nullif(text["notes"], F.lit("")).alias("notes"), raw.alias("raw"), reason.alias("reason"),
    )


def judge_feed(lines: DataFrame, column: str = "value") -> DataFrame:
    """S11 trades (T) and quotes (Q) of a feed's lines, each a JSON array of messages or one message; stream or batch. Reasons: malformed
    (no JSON object), kind (another kind of message), field (one of its fields is missing or no number), price (not above 0)."""
    many = F.from_json(column, "array<string>")
    each = F.when(F.ltrim(column).startswith("["), many).otherwise(F.array(column))
    # a line that is no array, and an empty one, is judged as it is
    x = lines.select(F.explode(F.when(F.size(F.coalesce(each, F.array().cast("array<string>"))) > 0, each).otherwise(F.array(column))).alias("raw"))
    x = x.withColumn("_x", F.from_json("raw", FEED))
    ev, quote = F.col("_x.ev"), F.col("_x.ev") == "Q"
    price = F.when(quote, (F.col("_x.bp") + F.col("_x.ap")) / 2).otherwise(F.col("_x.p"))
    lacks = F.col("_x.sym").isNull() | F.col("_x.t").isNull() | price.isNull() | (~quote & F.col("_x.s").isNull())
    shaped = F.ltrim("raw").startswith("{") & F.get_json_object("raw", "$").isNotNull()
    reason = F.when(~F.coalesce(shaped, F.lit(False)), "malformed").when(ev.isNull() | ~ev.isin("T", "Q"), "kind").when(lacks, "field").when(price <= 0, "price")
    return x.select(
        ev.alias("kind"), F.col("_x.sym").alias("symbol"), F.timestamp_millis("_x.t").alias("ts"), price.alias("price"),
        F.when(quote, F.lit(0.0)).otherwise(F.col("_x.s")).alias("size"), F.when(quote, F.col("_x.bp")).alias("bid"), F.when(quote, F.col("_x.ap")).alias("ask"), "raw", reason.alias("reason"),
    )


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("reason is null").drop("raw", "reason")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null").select("raw", "reason")


def keep(judged: DataFrame, path: str, load: str) -> Judged:
    """Write a judged load below `path`, accepted and rejected rows apart, in one pass. A load of the same name is written anew, so
    that a run that was broken off can be run again."""
    to = f"{path}/load={load}"
    verdict = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    judged.withColumn("verdict", verdict).write.mode("overwrite").partitionBy("verdict").parquet(to)
    n = {r.verdict: r["count"] for r in judged.sparkSession.read.parquet(to).groupBy("verdict").count().collect()}
    return Judged(n.get("accepted", 0), n.get("rejected", 0))
