"""Run drivers: scan, operator, sink, with logs of counts. `python -m veilframe.run --help` lists them."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import logs
from veilframe.functions.rules import HEALTH, MULTI, TaskProfile
from veilframe.operators import evaluate, loops, training_pairs
from veilframe.sources import jsonl
from veilframe.sources.models import CachedBackend, HttpBackend, ModelBackend, RuleBackend, sizes_only
from veilframe.sources.shared import written

PROFILES = {"multi": MULTI, "health": HEALTH}


def _field(key: str) -> Column:
    return F.try_variant_get("raw", f"$.{key}", "string")


def load(spark: SparkSession, source: str, limit: int | None = None, quarantine: str | None = None) -> DataFrame:
    """Records of a JSON-lines source with the fields that operators read, and the whole object as `raw`.

    Lines that hold no object go to the quarantine, by kind, length and digest.
    """
    records, others = jsonl.objects(written(jsonl.scan(spark, source, limit, lenient=True), "records")[0])
    if quarantine:
        jsonl.save(others, quarantine)
    number = F.coalesce(_field("record_id"), F.lit("-1"))
    texts = [_field(k).alias(k) for k in ("response", "context", "anonymized_response")]
    personality = F.to_json(F.try_variant_get("raw", "$.personality", "variant")).alias("personality")
    loaded = records.select(number.alias("record_id"), *texts, personality, "raw")
    size = sizes_only(loaded, "response").first()
    logs.LOGGER.info("loaded %d texts of %d characters, digest %s; %d lines hold no object", size.n_rows, size.n_chars, size.digest[:12], others.count())
    return loaded


def passed_through(result: DataFrame, **fields: Column) -> DataFrame:
    """One column, the JSON object of each record as it came with the given fields put in."""
    own = F.map_filter(F.try_variant_get("raw", "$", "map<string,variant>"), lambda k, _: ~k.isin(*fields))
    put = F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), F.coalesce(F.try_parse_json(F.to_json(c)), F.parse_json(F.lit("null"))))])
    return result.select(F.to_json(F.map_concat(own, put)).alias("value"))


def anonymize(spark: SparkSession, source: str, target: str, profile: TaskProfile, roles: loops.Roles, kind: str = "three", max_iterations: int | None = None, limit: int | None = None, quarantine: str | None = None) -> DataFrame:
    """Records taken through a loop and written as JSON lines, each as it came with anonymized_response and meta."""
    records = load(spark, source, limit, quarantine)
    loop, rounds = (loops.three_role_loop, 10) if kind == "three" else (loops.two_role_loop, 5)
    result, _ = written(loop(records, profile, roles, rounds if max_iterations is None else max_iterations), "result")
    meta = F.struct("outcome.*")
    text = F.struct(F.col("anonymized_response").alias("x"))
    lines = passed_through(result.withColumn("_meta", meta).withColumn("_text", text), anonymized_response=F.col("_text"), meta=F.col("_meta"))
    # A bare text has no JSON of its own in to_json, so it goes in a struct and out of it again.
    unwrapped = F.regexp_replace("value", r'"anonymized_response":\{"x":("(?:[^"\\]|\\.)*+")\}', r'"anonymized_response":$1')
    lines.select(F.regexp_replace(unwrapped, r'"anonymized_response":\{\}', '"anonymized_response":null').alias("value")).write.mode("overwrite").text(target)
    for row in result.groupBy("outcome.status").agg(F.count(F.lit(1)).alias("n")).orderBy("status").collect():
        logs.LOGGER.info("%s: %d records", row.status, row.n)
    return result


def assess(spark: SparkSession, source: str, target: str, profile: TaskProfile, judge: ModelBackend, adversary: ModelBackend, limit: int | None = None) -> str:
    """Evaluate anonymized records; details as JSON lines under target, the summary as its document."""
    summary, details = evaluate.evaluate(load(spark, source, limit).drop("raw"), profile, judge, adversary)
    details, _ = written(details, "details")
    jsonl.save(details.drop("attacker_guess"), target)
    return jsonl.summary_document(summary)


def teach(spark: SparkSession, source: str, target: str, teacher: ModelBackend, limit: int | None = None) -> None:
    """Teacher rewrites as JSON lines (response, anonymized_response, context)."""
    rows = training_pairs.teacher_rows(load(spark, source, limit).drop("raw", "personality", "anonymized_response"), teacher)
    jsonl.save(rows, target)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Anonymize JSON lines, evaluate the result, or write teacher rewrites.")
    parser.add_argument("what", choices=("anonymize", "evaluate", "teach"))
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--profile", choices=sorted(PROFILES), default="multi")
    parser.add_argument("--loop", choices=("two", "three"), default="three")
    parser.add_argument("--iterations", type=int)
    parser.add_argument("--limit", type=int, default=0)
    parser.add_argument("--quarantine")
    parser.add_argument("--url", help="chat service; without it, the rule-based test double answers")
    parser.add_argument("--model", default="")
    parser.add_argument("--answers", help="folder, mounted by all executors, that keeps finished answers")
    parser.add_argument("--log-level", default="INFO")
    parser.add_argument("--log-file")
    given = parser.parse_args(arguments)
    logs.setup(given.log_level, given.log_file)
    backend: ModelBackend = HttpBackend(given.url, given.model) if given.url else RuleBackend()
    if given.answers:
        backend = CachedBackend(backend, given.answers)
    spark = SparkSession.builder.appName(f"veilframe {given.what}").getOrCreate()
    profile = PROFILES[given.profile]
    if given.what == "anonymize":
        anonymize(spark, given.input, given.output, profile, loops.bind_roles(backend), given.loop, given.iterations, given.limit, given.quarantine)
    elif given.what == "evaluate":
        print(assess(spark, given.input, given.output, profile, backend, backend, given.limit))
    else:
        teach(spark, given.input, given.output, backend, given.limit)


if __name__ == "__main__":
    main()
