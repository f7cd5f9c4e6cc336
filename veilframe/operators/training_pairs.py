"""Supervised rewrite pairs: teacher rewrites and training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import prompts, text
from veilframe.sources.models import ModelBackend, answered


def teacher_rows(records: DataFrame, teacher: ModelBackend, compat: bool = False) -> DataFrame:
    """Records with a teacher's rewrite as anonymized_response; blank, failed and empty ones are out.

    compat puts a log tag in the place of the context, as the first teacher prompt did.
    """
    rows = records.where(~text.is_blank(F.col("response")))
    context = F.col("context") if "context" in records.columns else F.lit("")
    tag = text.context_tag(context, F.lit(None)) if compat else None
    got = answered(rows, teacher, "teacher", 0, 0.7, prompts.teacher_prompt(F.col("response"), context, tag), "rewrite")
    return got.where(~text.is_blank(F.col("rewrite"))).withColumn("anonymized_response", text.strip(F.col("rewrite"))).drop("rewrite")


def training_texts(records: DataFrame) -> DataFrame:
    """(text) of rows where both texts are present; empty ones pass."""
    context = F.col("context") if "context" in records.columns else F.lit("")
    both = records.where(F.col("response").isNotNull() & F.col("anonymized_response").isNotNull())
    return both.select(prompts.training_text(F.col("response"), F.col("anonymized_response"), context).alias("text"))


def training_texts_of_variants(raw: DataFrame) -> DataFrame:
    """The same from JSON records (column raw): both keys present, null counting as present but empty."""
    get = lambda key: F.when(F.try_variant_get("raw", f"$.{key}", "variant").isNotNull(), F.coalesce(F.try_variant_get("raw", f"$.{key}", "string"), F.lit("")))
    return training_texts(raw.select(get("response").alias("response"), get("anonymized_response").alias("anonymized_response"), F.coalesce(get("context"), F.lit("")).alias("context")))
