"""JSON-lines records: tolerant scan, strict scan, sink, and the one-document summary sink."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilframe.functions.text import strip

STRICT_SCHEMA = "line_no long, value string"


@F.pandas_udf(StringType())
def _lenient(lines: pd.Series) -> pd.Series:
    """Lines that only a lenient reader takes, as strict JSON: of repeated keys the last, NaN and infinities as null."""

    def one(line: str | None) -> str | None:
        if line is None:
            return None
        try:
            return json.dumps(json.loads(line, parse_constant=lambda _: None), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return lines.map(one)


def scan_lines(lines: DataFrame, limit: int | None = None, lenient: bool = False) -> DataFrame:
    """Text lines (column value) to accepted records (column raw, a VARIANT).

    Blank and malformed lines are skipped; lines that hold a list or a scalar are kept. lenient also takes
    objects with repeated keys, and NaN and infinities. A limit of None or 0 means all, and otherwise
    counts accepted records.
    """
    parsed = lines.select(strip(F.col("value")).alias("line")).where("line <> ''").withColumn("raw", F.try_parse_json("line"))
    if lenient:
        parsed = parsed.withColumn("raw", F.coalesce("raw", F.try_parse_json(_lenient(F.when(F.col("raw").isNull(), F.col("line"))))))
    accepted = parsed.where("raw is not null").select("raw")
    return accepted.limit(limit) if limit else accepted


def scan(spark: SparkSession, path: str, limit: int | None = None, lenient: bool = False) -> DataFrame:
    """Records of JSON-lines files; a missing path raises."""
    return scan_lines(spark.read.text(path), limit, lenient)


def objects(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that are objects, and the others by kind, length and digest only, for a quarantine table."""
    whole = F.try_variant_get("raw", "$", "map<string,variant>")
    others = records.where(whole.isNull()).select(F.schema_of_variant("raw").alias("kind"), F.length(F.to_json("raw")).alias("n_chars"), F.sha2(F.to_json("raw"), 256).alias("line_sha256"))
    return records.where(whole.isNotNull()), others


def rejected_lines(lines: DataFrame) -> DataFrame:
    """What scan_lines skips as malformed, by length only: the lines may hold private text."""
    stripped = lines.select(strip(F.col("value")).alias("line")).where("line <> ''")
    return stripped.where(F.try_parse_json("line").isNull()).select(F.length("line").alias("n_chars"), F.sha2("line", 256).alias("line_sha256"))


def scan_strict(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records of JSON-lines files where a blank or malformed line is an error.

    The limit counts physical lines, in file order: one file is one partition here, as line numbers
    need it read in order. Errors surface when the result is computed.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line_no", "value"))
    chosen = lines.where(F.col("line_no") < limit) if limit else lines
    bad = F.raise_error(F.concat(F.lit("malformed line "), F.col("line_no").cast("string")))
    return chosen.select(F.coalesce(F.try_parse_json(F.nullif(strip(F.col("value")), F.lit(""))), F.parse_json(bad.cast("string"))).alias("raw"))


def as_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row; null fields are written, non-ASCII characters kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def save(df: DataFrame, path: str) -> None:
    """Write JSON lines (a folder of part files), replacing what was there; errors are raised."""
    as_lines(df).write.mode("overwrite").text(path)


def summary_document(summary: DataFrame, details: DataFrame | None = None, most_details: int = 10_000) -> str:
    """One pretty-printed JSON document on the driver: the summary row, and details if few enough.

    More than most_details rows belong in a table of their own (save), and raise here.
    """
    document = json.loads(as_lines(summary).first().value)
    if details is not None:
        rows = as_lines(details).limit(most_details + 1).collect()
        if len(rows) > most_details:
            raise ValueError(f"more than {most_details} details; save them as a table")
        document["details"] = [json.loads(r.value) for r in rows]
    return json.dumps(document, indent=2, ensure_ascii=False)
