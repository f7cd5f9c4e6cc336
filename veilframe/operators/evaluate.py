"""Utility and privacy of anonymized records, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import metrics, prompts, rules, text
from veilframe.functions.jsonx import attack, first_json_text
from veilframe.functions.rules import TaskProfile
from veilframe.sources.models import ModelBackend, answered

SCORES = ("readability", "meaning", "hallucinations")


def _score(judge: Column, name: str) -> tuple[Column, Column]:
    """(value, problem) of one nested score: missing is 0, text is read as a number."""
    outer = rules.node(judge, name)
    is_object = F.try_variant_get(outer, "$", "map<string,variant>").isNotNull()
    inner = F.try_variant_get(judge, f"$.{name}.score", "variant")
    number = F.try_variant_get(inner, "$", "double")
    value = F.when(outer.isNull() | inner.isNull(), 0.0).otherwise(number)
    problem = F.when(outer.isNotNull() & ~is_object, "dropped").when(inner.isNotNull() & number.isNull(), "parse_error")
    return value, problem


def utility(judge: Column) -> Column:
    """STRUCT<combined, readability, meaning, hallucinations, error> of a judge's JSON text.

    error is api_error without an answer, parse_error for a score that is no number, and dropped
    where the answer or a score has the wrong shape; the numbers are null then.
    """
    v = F.try_parse_json(judge)
    listed = F.try_variant_get(v, "$", "array<variant>").isNotNull()
    falsy = v.isNull() | judge.isin("{}", "[]", "null", "0", '""', "false")
    parts = {name: _score(v, name) for name in SCORES}
    problems = [p for _, p in parts.values()]
    wrong = [F.coalesce(p == "dropped", F.lit(False)) for p in problems]
    bad = [F.coalesce(p == "parse_error", F.lit(False)) for p in problems]
    error = F.when(falsy, "api_error").when(listed | wrong[0] | wrong[1] | wrong[2], "dropped").when(bad[0] | bad[1] | bad[2], "parse_error")
    fine = lambda c: F.when(error.isNull(), c)
    readability, meaning, hallucinations = (parts[n][0] for n in SCORES)
    combined = (readability / 10 + meaning / 10 + hallucinations) / 3
    return F.struct(fine(combined).alias("combined"), *[fine(parts[n][0]).alias(n) for n in SCORES], error.alias("error"))


def summarized(details: DataFrame, total_records: DataFrame) -> DataFrame:
    """One row (average_utility, attack_success_rate, total_records).

    The average is over rows that have a combined utility; the rate is all leaks over all
    attributes; both are 0 without rows. total_records counts what was loaded, not what was scored.
    """
    kept = details.where("dropped_reason is null")
    scores = kept.agg(
        F.coalesce(F.avg("utility.combined"), F.lit(0.0)).alias("average_utility"),
        F.coalesce(F.try_divide(F.sum("leaked_count"), F.sum("total_attributes")), F.lit(0.0)).alias("attack_success_rate"),
    )
    return scores.crossJoin(total_records.agg(F.count(F.lit(1)).alias("total_records")))  # one row each


def compared_success_rate(details: DataFrame) -> DataFrame:
    """One row (attack_success_rate): all leaks over the attributes that rules compare."""
    kept = details.where("dropped_reason is null")
    return kept.agg(F.coalesce(F.try_divide(F.sum("leaked_count"), F.sum("compared_attributes")), F.lit(0.0)).alias("attack_success_rate"))


def scored(responses: DataFrame, profile: TaskProfile, compat: bool = False) -> DataFrame:
    """Details from records with their judge and adversary answers.

    Needs record_id, response, anonymized_response, personality (JSON text), judge_response and
    adversary_response. Rows without both texts are out. dropped_reason tells rows that count in no
    average: no adversary answer, a judge's answer of the wrong shape, or a null profile.
    """
    rows = responses.where(text.is_evaluable(F.col("response"), F.col("anonymized_response")))
    rows = rows.withColumn("judge_json", first_json_text(F.coalesce("judge_response", F.lit("")))).withColumn("attack", attack(F.coalesce("adversary_response", F.lit(""))))
    truth, guess = F.try_parse_json(F.coalesce("personality", F.lit("{}"))), F.try_parse_json("attack.guess_json")
    found = rules.leaks(profile, truth, guess, compat)
    rows = rows.withColumns({"utility": utility(F.col("judge_json")), "leaked_attributes": found})
    leaked, total = rules.risk_counts(profile, truth, F.col("leaked_attributes"))
    reason = F.when(F.col("adversary_response").isNull(), "adversary_api_error").when(F.col("utility.error") == "dropped", "judge_shape").when(F.is_variant_null(truth), "null_profile")
    return rows.select(
        F.coalesce(F.col("record_id"), F.lit(-1)).alias("record_id"), "utility", leaked.alias("leaked_count"), F.coalesce(total, F.lit(0)).alias("total_attributes"), rules.compared_count(profile, truth).alias("compared_attributes"), "leaked_attributes",
        F.col("attack.guess_json").alias("attacker_guess"), metrics.rouge_l_score("response", "anonymized_response").alias("rouge_l_f1"),
        metrics.bleu_score("response", "anonymized_response").alias("bleu"), reason.alias("dropped_reason"),
    )


def evaluate(records: DataFrame, profile: TaskProfile, judge: ModelBackend, adversary: ModelBackend, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(summary, details): one judge and one adversary call per evaluable record."""
    fit = records.drop("judge_response", "adversary_response").where(text.is_evaluable(F.col("response"), F.col("anonymized_response")))
    judged = answered(fit, judge, "judge", 0, 0.1, prompts.judge_prompt(F.col("response"), F.col("anonymized_response")), "judge_response")
    both = answered(judged, adversary, "attacker", 0, 0.1, prompts.attack_prompt(profile, F.col("anonymized_response")), "adversary_response")
    details = scored(both, profile, compat)
    return summarized(details, records), details
