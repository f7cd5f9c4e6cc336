"""What the corpus operators share: tables in the shared folder, and small column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilframe.sources.shared import removed, shared_dir, small_batches, written

__all__ = ["ascii_lower", "attached", "held_out", "hot_keys", "mapped", "removed", "row_key", "shared_dir", "small_batches", "table", "utf8", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, UPPER.lower())


def held_out(col: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Keys that hold more than one row in so many are dealt out, in parts of that share, or of PART_ROWS if fewer.
SHARES = 512
PART_ROWS = 1_000_000
#: At most so many keys are ever known as hot; see `hot_keys`.
HOT_KEYS = 200_000


def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """(key, parts) of the keys whose rows should be dealt to several tasks, few enough to broadcast.

    A key is hot above 1 / SHARES of all rows, or above PART_ROWS; where that would be more than
    HOT_KEYS keys, above 1 / HOT_KEYS of all rows, so there are never more. Keys are counted with a
    map-side combine. Give total, the number of rows, if it is known.
    """
    total = rows.count() if total is None else total
    most = max(1, min(total // SHARES, PART_ROWS), total // HOT_KEYS)
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > most) & F.col(key).isNotNull())
    return counted.select(F.col(key), F.ceil(F.col("n") / most).cast("int").alias("parts"))


def attached(rows: DataFrame, facts: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Inner equi-join of rows to facts on key, where a key may hold most rows and few facts.

    Rows of a hot key are dealt to parts by their contents and by the input partition they come from, so
    repeats of one row are dealt out too; the key's facts go to every part. The join always
    shuffles: if few rows were broadcast instead, one key's would leave from the task of its fact.
    """
    hot = F.broadcast(hot_keys(rows, key, total))
    spread = F.xxhash64(*rows.columns).bitwiseXOR(F.xxhash64(F.spark_partition_id()))
    dealt = rows.withColumn("_spread", spread).join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod("_spread", "parts"), F.lit(0)).cast("int")).drop("_spread", "parts")
    every = facts.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return dealt.hint("merge").join(every, [key, "_part"]).drop("_part")


def row_key() -> Column:
    """A row's document as a join key: rows of one doc_id and text are alike, and nulls are values."""
    text = F.col("text").cast("string")
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(text.isNull(), "n").otherwise(":"), F.hex(F.xxhash64(text)), F.hex(F.crc32(F.coalesce(text, F.lit("")).cast("binary"))))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def mapped(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict], schema: StructType | str) -> DataFrame:
    """Apply per_batch (a record batch to a dict of Arrow-convertible columns) batch by batch.

    No shuffle; memory is bounded by one Arrow batch.
    """
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = per_batch(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for f in arrow for c in [cols[f.name]]],
                    schema=arrow,
                )

    return small_batches(df).mapInArrow(run, out)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)

