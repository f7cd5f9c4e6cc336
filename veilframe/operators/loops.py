"""The anonymization loops over an active set.

Each round takes only the records still active through one batched model call per role, and is
written once, which settles its calls and cuts the lineage (a task that runs again calls again, unless
the backend keeps its answers: sources.models.CachedBackend). A record leaves the active set when it
is settled; the loop ends when none is left. Nothing is shuffled between rounds: a record's state
travels in its row, beside the record itself in one column, so no column of the record is touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import prompts, rules, text
from veilframe.functions.jsonx import first_json_text, guess_json
from veilframe.functions.rules import TaskProfile
from veilframe.sources.models import ModelBackend, answered
from veilframe.sources.shared import written

ATTACK_TEMPERATURE, ARBITER_TEMPERATURE, EDIT_TEMPERATURE = 0.1, 0.0, 0.5
ANSWER = "_answer"
RECORD = "_record"  # the record as it came, while it is in the loop
OUTCOME = "outcome"  # what a loop tells of a record, in one column beside its own
HISTORY = "array<struct<iteration:int,text:string,inference:string,guess_json:string,leaks:string,actionable:array<string>>>"


@dataclass
class Roles:
    attacker: ModelBackend
    anonymizer: ModelBackend
    arbitrator: ModelBackend | None = None


def bind_roles(shared: ModelBackend | None = None, attacker: ModelBackend | None = None, anonymizer: ModelBackend | None = None) -> Roles:
    """One model for all roles, which wins if given, or a separate attacker and anonymizer; else an error."""
    if shared is not None:
        return Roles(shared, shared, shared)
    if attacker is None or anonymizer is None:
        raise ValueError("give one shared model, or an attacker and an anonymizer")
    return Roles(attacker, anonymizer, attacker)


def _start(records: DataFrame, source: str) -> DataFrame:
    """Loop state, and the record in one column. records may not have a column OUTCOME."""
    if OUTCOME in records.columns:
        raise ValueError(f"reserved column: {OUTCOME}")
    return records.select(
        F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias(RECORD),
        "record_id",
        F.col(source).cast("string").alias("current"),
        F.when(text.is_blank(F.col(source)), "skipped").alias("status"),
        F.lit(0).alias("iterations"),
        *[F.lit(None).cast("string").alias(c) for c in ("error", "inference", "guess_json", "leaks_json")],
        F.lit(False).alias("model_failure"),
        F.lit(0).alias("calls"),
        F.array().cast(HISTORY).alias("history"),
    )


def _open() -> Column:
    return F.col("status").isNull()


def _attack(active: DataFrame, profile: TaskProfile, roles: Roles, iteration: int, allow_unknown: bool) -> DataFrame:
    prompt = F.when(_open(), prompts.attack_prompt(profile, F.col("current"), allow_unknown))
    got = answered(active, roles.attacker, "attacker", iteration, ATTACK_TEMPERATURE, prompt, ANSWER, write=False)
    response = F.coalesce(ANSWER, F.lit(""))
    now = {"inference": text.inference_part(response), "guess_json": guess_json(response), "model_failure": F.col("model_failure") | (response == ""), "calls": F.col("calls") + 1}
    return got.withColumns({k: F.when(_open(), v).otherwise(F.col(k)) for k, v in now.items()}).drop(ANSWER)


def _finish(parts: list[DataFrame], outcome: list[str], compat: bool, order: str | None) -> DataFrame:
    """The records with anonymized_response, which replaces a column of that name, and OUTCOME.

    A success that rests on a failed generation is a model error, unless compat is asked for.
    """
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if not compat:
        out = out.withColumn("status", F.when(F.col("model_failure") & F.col("status").startswith("success"), "model_error").otherwise(F.col("status")))
    own = [c for c in out.schema[RECORD].dataType.names if c != "anonymized_response"]
    out = out.select(*[F.col(f"{RECORD}.`{c}`").alias(c) for c in own], "anonymized_response", F.struct(*outcome).alias(OUTCOME))
    return out.orderBy(order) if order else out


def two_role_loop(records: DataFrame, profile: TaskProfile, roles: Roles, max_iterations: int = 5, source: str = "response", compat: bool = False, order: str | None = None) -> DataFrame:
    """Attack; while not safe and rounds remain, edit by the attacker's reasoning and attack again.

    records needs record_id and the text column `source`; all its columns pass through. Adds
    anonymized_response and OUTCOME: status (skipped, success_original, success, max_iterations, or
    model_error unless compat), iterations, guess_json, model_failure and calls. An empty edit becomes
    the text, as there is no sanity check here.
    """
    state, _ = written(_start(records, source), "loop")
    done = [state.where("status is not null")]
    active = _attack(state.where("status is null"), profile, roles, 0, True)

    def split(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        judged, _ = written(df.withColumn("status", F.when(rules.is_safe(profile, F.try_parse_json("guess_json")), label)), "round")
        return judged.where("status is not null"), judged.where("status is null")

    settled, active = split(active, "success_original")
    done.append(settled)
    for i in range(1, max_iterations + 1):
        if active.isEmpty():
            break
        edited = answered(active, roles.anonymizer, "anonymizer", i, EDIT_TEMPERATURE, prompts.anonymize_prompt(F.col("current"), F.col("inference")), ANSWER, write=False)
        edited = edited.withColumns({"current": text.after_hash(F.coalesce(ANSWER, F.lit(""))), "iterations": F.lit(i), "calls": F.col("calls") + 1}).drop(ANSWER)
        settled, active = split(_attack(edited, profile, roles, i, True), "success")
        done.append(settled)
    done.append(active.withColumn("status", F.lit("max_iterations")))
    ended = [part.withColumn("anonymized_response", F.when(F.col("status") == "skipped", "").otherwise(F.col("current"))) for part in done]
    return _finish(ended, ["status", "iterations", "guess_json", "model_failure", "calls"], compat, order)


def _arbitrate(active: DataFrame, profile: TaskProfile, roles: Roles, iteration: int) -> DataFrame:
    """Findings of the arbitrator about the guessed attributes; no call where nothing was guessed."""
    guess = F.try_parse_json("guess_json")
    keys = F.map_keys(F.try_variant_get(guess, "$", "map<string,variant>"))
    named = F.coalesce(F.when(rules.node(guess, "error").isNotNull(), F.array(*map(F.lit, profile.attributes))).otherwise(keys), F.array().cast("array<string>"))
    called = _open() & (F.size(named) > 0)
    prompt = F.when(called, prompts.arbitrate_prompt(profile, F.col("current"), named, F.col("inference")))
    got = answered(active, roles.arbitrator or roles.attacker, "arbitrator", iteration, ARBITER_TEMPERATURE, prompt, ANSWER, write=False)
    return got.withColumns({
        "leaks_json": F.when(_open(), F.coalesce(first_json_text(F.coalesce(ANSWER, F.lit(""))), F.lit("[]"))).otherwise(F.col("leaks_json")),
        "model_failure": F.col("model_failure") | (called & (F.coalesce(ANSWER, F.lit("")) == "")),
        "calls": F.col("calls") + F.when(called, 1).otherwise(0),
    }).drop(ANSWER)


def _record(df: DataFrame, profile: TaskProfile, iteration: int) -> DataFrame:
    found = rules.actionable(F.try_parse_json("leaks_json"), profile.actionable)
    entry = F.struct(
        F.lit(iteration).alias("iteration"), F.col("current").alias("text"), F.col("inference"), F.col("guess_json"),
        F.col("leaks_json").alias("leaks"), rules.labelled(found).alias("actionable"),
    )
    return df.withColumn("history", F.when(_open(), F.array_append("history", entry)).otherwise(F.col("history")))


def _leaking(profile: TaskProfile) -> Column:
    return rules.has_leaks(profile, rules.actionable(F.try_parse_json("leaks_json"), profile.actionable), F.try_parse_json("guess_json"))


def three_role_loop(records: DataFrame, profile: TaskProfile, roles: Roles, max_iterations: int = 10, source: str = "response", compat: bool = False, order: str | None = None) -> DataFrame:
    """Attack and arbitrate; while leaks remain and rounds do, edit, check the edit, attack and arbitrate.

    records needs record_id and the text column `source`; all its columns pass through. Adds
    anonymized_response (null if skipped) and OUTCOME: status (skipped, success_original, success,
    model_error, max_iterations), error, iterations, guess_json (final guess; null for
    success_original and skipped), final_leaked_attributes, history, model_failure and calls. An edit
    that fails its check ends the record with the text before it, and the round leaves no history.
    """
    state, _ = written(_start(records, source), "loop")
    done = [state.where("status is not null")]
    active = _arbitrate(_attack(state.where("status is null"), profile, roles, 0, False), profile, roles, 0)

    def split(df: DataFrame, label: str, iteration: int) -> tuple[DataFrame, DataFrame]:
        settled = F.when(_open(), F.when(~_leaking(profile), label)).otherwise(F.col("status"))
        judged, _ = written(_record(df, profile, iteration).withColumn("status", settled), "round")
        return judged.where("status is not null"), judged.where("status is null")

    settled, active = split(active, "success_original", 0)
    done.append(settled)
    for i in range(1, max_iterations + 1):
        if active.isEmpty():
            break
        notes = rules.feedback(rules.actionable(F.try_parse_json("leaks_json"), profile.actionable))
        edited = answered(active, roles.anonymizer, "anonymizer", i, EDIT_TEMPERATURE, prompts.anonymize_prompt(F.col("current"), notes), ANSWER, write=False)
        edited = edited.withColumns({"edit": text.after_hash(F.coalesce(ANSWER, F.lit(""))), "calls": F.col("calls") + 1, "iterations": F.lit(i)}).drop(ANSWER)
        edited = edited.withColumn("error", text.sanity_error(F.col("edit"), F.col("current")))
        # A failed edit settles its record here; no later call of the round is made for it.
        checked = edited.withColumns({"status": F.when(F.col("error").isNotNull(), "model_error"), "current": F.when(F.col("error").isNull(), F.col("edit")).otherwise(F.col("current"))}).drop("edit")
        settled, active = split(_arbitrate(_attack(checked, profile, roles, i, False), profile, roles, i), "success", i)
        done.append(settled)
    done.append(active.withColumn("status", F.lit("max_iterations")))
    original = F.col("status").isin("success_original", "skipped")
    left = rules.labelled(rules.actionable(F.try_parse_json("leaks_json"), profile.actionable))
    ended = [
        part.withColumns({
            "anonymized_response": F.when(F.col("status") != "skipped", F.col("current")),
            "final_leaked_attributes": F.when(F.col("status").isin("success", "max_iterations"), left),
            "guess_json": F.when(~original, F.col("guess_json")),
        })
        for part in done
    ]
    return _finish(ended, ["status", "error", "iterations", "guess_json", "final_leaked_attributes", "history", "model_failure", "calls"], compat, order)


def last_history(result: DataFrame) -> DataFrame:
    """(record_id, iteration, text): each record's last history entry, from history in long form."""
    from pyspark.sql import Window as W

    long = result.select("record_id", F.explode(f"{OUTCOME}.history").alias("h")).select("record_id", "h.iteration", "h.text")
    latest = F.row_number().over(W.partitionBy("record_id").orderBy(F.desc("iteration")))
    return long.withColumn("nth", latest).where("nth = 1").drop("nth")
