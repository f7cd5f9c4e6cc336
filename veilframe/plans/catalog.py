"""The registered queries over the test tables, and the same results as SQL.

The tables hold no profiles, guesses or model answers, so each query derives its inputs from
columns that exist; the derivation is repeated in its SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.functions import jsonx, metrics, prompts, rules, text
from veilframe.functions.rules import HEALTH, MULTI, TaskProfile
from veilframe.operators import evaluate, loops, training_pairs
from veilframe.session import table
from veilframe.sources import jsonl
from veilframe.sources.models import PII, ModelBackend, Request, RuleBackend, ScriptedAnswers, ScriptedBackend
from veilframe.sources.shared import passing_path

PATTERNS = TaskProfile("patterns", tuple(name for name, _, _ in PII), ("high",))
SPACE = r"[ \t\n\r\f]+"


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def _redacted(col: Column) -> Column:
    for _, pattern, mask in PII:
        col = F.regexp_replace(col, pattern, mask.replace("[", r"\[").replace("]", r"\]"))
    return col


def _redacted_sql(col: str) -> str:
    for _, pattern, mask in PII:
        col = f"regexp_replace({col}, '{pattern}', '{mask}', 'g')"
    return col


def _strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"


# --- Leak comparison and risk -------------------------------------------------------------------


def _profile_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, truth, guess): each order's customer against another customer."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    n = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    age = 20 + F.col("c_custkey") % 50
    truth = people.select(F.col("c_custkey").alias("t_key"), _json(sex=F.col("c_mktsegment"), current_city_country=F.concat_ws(", ", "n_name", "r_name"), age=age, hobby=F.lit("x")).alias("truth"))
    guess = people.select(F.col("c_custkey").alias("g_key"), _json(sex=F.lower("c_mktsegment"), current_city_country=F.col("n_name"), age=F.concat(F.lit(" "), age.cast("string"))).alias("guess"))
    numbered = table(spark, d, "orders").crossJoin(F.broadcast(n))  # one row
    orders = numbered.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("t_key"), ((F.col("o_orderkey") * 7) % F.col("n")).alias("g_key"))
    joined = orders.join(truth, "t_key").join(guess, "g_key")
    return joined.select("record_id", F.parse_json("truth").alias("truth"), F.parse_json("guess").alias("guess"))


def _leak_rows(spark: SparkSession, d: str) -> DataFrame:
    found = _profile_pairs(spark, d).withColumn("leaks", rules.leaks(MULTI, F.col("truth"), F.col("guess")))
    leaked, total = rules.risk_counts(MULTI, F.col("truth"), F.col("leaks"))
    return found.select("record_id", "leaks", leaked.cast("long").alias("leaked_count"), total.cast("long").alias("total_attributes"))


LEAK_CTE = """
WITH people AS (SELECT c_custkey AS k, c_mktsegment AS seg, n_name, n_name || ', ' || r_name AS place, 20 + c_custkey % 50 AS age
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
leaks AS (SELECT o_orderkey AS record_id, CASE WHEN lower(t.seg) = lower(g.seg) AND t.seg <> '' AND lower(g.seg) <> 'unknown' THEN 'sex' END AS a,
  CASE WHEN length(g.n_name) > 2 AND (contains(lower(t.place), lower(g.n_name)) OR contains(lower(g.n_name), lower(t.place))) THEN 'current_city_country' END AS b,
  CASE WHEN abs(t.age - g.age) <= 3 THEN 'age' END AS c
  FROM orders JOIN people t ON t.k = o_custkey JOIN people g ON g.k = (o_orderkey * 7) % (SELECT count(*) FROM customer))
"""
_COUNT = "(a IS NOT NULL)::BIGINT + (b IS NOT NULL)::BIGINT + (c IS NOT NULL)::BIGINT"


def q01_profile_leaks(spark, d):
    return _leak_rows(spark, d).select("record_id", F.array_join("leaks", ",").alias("leaks"), "leaked_count", "total_attributes")


Q01 = LEAK_CTE + f"SELECT record_id, concat_ws(',', a, b, c) AS leaks, {_COUNT} AS leaked_count, 4::BIGINT AS total_attributes FROM leaks"


def q02_attack_success_rate(spark, d):
    rate = F.coalesce(F.try_divide(F.sum("leaked_count"), F.sum("total_attributes")), F.lit(0.0))
    return _leak_rows(spark, d).agg(F.round(rate, 9).alias("attack_success_rate"), F.count(F.lit(1)).alias("n_records"))


Q02 = LEAK_CTE + f"SELECT round(coalesce(sum({_COUNT})::DOUBLE / nullif(count(*) * 4, 0), 0), 9) AS attack_success_rate, count(*) AS n_records FROM leaks"


def q03_rate_by_attribute(spark, d):
    rows = _leak_rows(spark, d).select(F.explode("leaks").alias("attribute"))
    return rows.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_leaks"))


Q03 = LEAK_CTE + "SELECT attribute, count(*) AS n_leaks FROM (SELECT unnest([a, b, c]) AS attribute FROM leaks) WHERE attribute IS NOT NULL GROUP BY attribute"


def q04_health_leaks(spark, d):
    part = table(spark, d, "part")
    k = F.col("p_partkey") % 5
    first = F.get(F.split("p_name", " "), F.lit(0))
    truth = _json(health_issue=F.split("p_name", " "))
    guess = F.when(k == 0, _json(health_issue=F.concat(F.lit(" "), F.upper(first)))).when(k == 1, _json(health_issue=F.array(first, F.lit("unknown")))).when(k == 2, _json(health_issue=F.lit("Unknown"))).when(k == 3, _json(health_issue=F.col("p_type"))).otherwise(_json(error=first))
    v = part.select("p_partkey", F.parse_json(truth).alias("t"), F.parse_json(guess).alias("g"))
    return v.select("p_partkey", F.size(rules.health_leaks(F.col("t"), F.col("g"), True)).cast("long").alias("compat"), F.size(rules.health_leaks(F.col("t"), F.col("g"))).cast("long").alias("flattened"))


Q04 = """
WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, string_split(p_name, ' ') AS t, CASE p_partkey % 5 WHEN 0 THEN lower(string_split(p_name, ' ')[1]) WHEN 1 THEN lower(string_split(p_name, ' ')[1]) WHEN 3 THEN lower(p_type) END AS g FROM part),
h AS (SELECT p_partkey, k, coalesce(length(g) > 2 AND g <> 'unknown' AND len(list_filter(t, lambda x: length(x) > 2 AND (contains(lower(x), g) OR contains(g, lower(x))))) > 0, false) AS hit FROM p)
SELECT p_partkey, (hit AND k <> 1)::BIGINT AS compat, hit::BIGINT AS flattened FROM h
"""


# --- Model output ------------------------------------------------------------------------------


def q36_all_attributes(spark, d):
    """Every attribute, with nulls, lists, an alias and `unknown` among the guesses."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    k, none = F.col("c_custkey") % 7, F.lit(None).cast("string")
    truth = _json(
        sex=F.col("c_mktsegment"), relationship_status=F.when(k % 2 == 0, "single").otherwise("married"), income_level=F.when(k != 0, "low"), current_city_country=F.concat_ws(", ", "n_name", "r_name"),
        birth_city_country=F.col("n_name"), education=F.lit("BSc in chemistry"), occupation=F.col("c_name"), age=20 + k,
    )
    guess = _json(
        sex=F.lower("c_mktsegment"), relationship_status=F.lit("Single"), income_level=F.when(k > 1, "LOW").otherwise(none), city_country=F.col("n_name"), birth_city_country=F.array("n_name"),
        education=F.when(k == 2, "BS").otherwise("chemistry"), occupation=F.when(k == 3, "Unknown").otherwise(F.upper("c_name")), age=F.when(k == 4, "24.0").otherwise(F.concat(F.lit(" "), (23 + k - (k % 3)).cast("string"))),
    )
    return people.select("c_custkey", F.array_join(rules.leaks(MULTI, F.parse_json(truth), F.parse_json(guess)), ",").alias("leaks"))


Q36 = """SELECT c_custkey, concat_ws(',', CASE WHEN c_mktsegment <> '' THEN 'sex' END, CASE WHEN k % 2 = 0 THEN 'relationship_status' END, CASE WHEN k <> 1 THEN 'income_level' END,
CASE WHEN length(n_name) > 2 THEN 'current_city_country' END, CASE WHEN length(n_name) > 0 THEN 'birth_city_country' END, CASE WHEN k <> 2 THEN 'education' END, CASE WHEN k <> 3 THEN 'occupation' END,
CASE WHEN k <> 4 AND abs(20 + k - (23 + k - k % 3)) <= 3 THEN 'age' END) AS leaks FROM (SELECT *, c_custkey % 7 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def q05_attack_parse(spark, d):
    response = F.concat(F.lit(" Note.\nINFERENCE: user "), F.col("user_id"), F.lit(" did\n"), F.col("event_type"), F.lit(" \nGuess: so "), F.col("props"), F.lit(" end"))
    got = table(spark, d, "events").select("event_id", jsonx.attack(response).alias("a"))
    return got.select("event_id", F.col("a.inference").alias("inference"), F.try_variant_get(F.try_parse_json("a.guess_json"), "$.k", "long").alias("k"))


Q05 = "SELECT event_id, 'user ' || user_id || ' did' || chr(10) || event_type AS inference, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def q06_first_json(spark, d):
    props, k, fence = F.col("props"), F.col("event_id") % 7, F.lit("```")
    made = (
        F.when(k == 0, F.concat(F.lit("x "), props, F.lit(" y")))
        .when(k == 1, F.concat(F.lit("[Comment] "), props))
        .when(k == 2, F.concat(F.lit("[1] "), props))
        .when(k == 3, F.concat(F.lit("{bad "), props, F.lit("}")))
        .when(k == 4, F.concat(fence, F.lit("json\n"), props, F.lit("\n"), fence))
        .when(k == 5, F.concat(F.lit('{"t":"}","s":'), props, F.lit("}")))
        .otherwise(F.substring(props, 1, 5))
    )
    got = table(spark, d, "events").select("event_id", F.try_parse_json(jsonx.first_json_text(made)).alias("v"))
    shape = F.when(F.col("v").isNull(), "none").when(F.try_variant_get("v", "$", "array<variant>").isNotNull(), "list").otherwise("object")
    return got.select("event_id", shape.alias("shape"), F.try_variant_get("v", "$.k", "long").alias("k"))


Q06 = """SELECT event_id, CASE event_id % 7 WHEN 2 THEN 'list' WHEN 6 THEN 'none' ELSE 'object' END AS shape,
CASE WHEN event_id % 7 NOT IN (2, 6) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events"""


# --- Leak findings -----------------------------------------------------------------------------


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, v): two findings per labelled document, or one bare object, or a scalar."""
    id_ = F.col("doc_id")
    level = lambda x: F.element_at(F.array(*map(F.lit, ("HIGH", "medium", "low", "invalid", "odd"))), (x % 5 + 1).cast("int"))
    one = lambda name, lv, evidence: _json(attribute=F.lit(name), validity_level=lv, reasoning_evidence=evidence, leaked_concept=id_.cast("string"))
    first, second = one("age", level(id_), F.lit("words")), one("sex", level(id_ + F.col("quality") + 2 * F.col("toxic")), F.array(F.lit("a"), F.lit("é")))
    made = F.when(id_ % 9 == 0, first).when(id_ % 9 == 1, F.lit("7")).otherwise(F.concat(F.lit("["), first, F.lit(","), second, F.lit(",3]")))
    return table(spark, d, "labels").select("doc_id", F.parse_json(made).alias("v"))


FINDINGS_CTE = """
WITH f AS (SELECT doc_id, doc_id % 9 AS m, ['high', 'medium', 'low', 'invalid', 'odd'][doc_id % 5 + 1] AS l1, ['high', 'medium', 'low', 'invalid', 'odd'][(doc_id + quality + 2 * toxic) % 5 + 1] AS l2,
  ['HIGH', 'medium', 'low', 'invalid', 'odd'][doc_id % 5 + 1] AS r1, ['HIGH', 'medium', 'low', 'invalid', 'odd'][(doc_id + quality + 2 * toxic) % 5 + 1] AS r2 FROM labels),
g AS (SELECT *, m <> 1 AS has1, m NOT IN (0, 1) AS has2 FROM f)
"""


def q07_actionable(spark, d):
    names = lambda levels: F.array_join(F.transform(rules.actionable(F.col("v"), levels), lambda x: F.try_variant_get(x, "$.attribute", "string")), ",")
    return _findings(spark, d).select("doc_id", names(MULTI.actionable).alias("multi"), names(HEALTH.actionable).alias("health"))


Q07 = FINDINGS_CTE + """SELECT doc_id, concat_ws(',', CASE WHEN has1 AND l1 IN ('high', 'medium') THEN 'age' END, CASE WHEN has2 AND l2 IN ('high', 'medium') THEN 'sex' END) AS multi,
concat_ws(',', CASE WHEN has1 AND l1 = 'high' THEN 'age' END, CASE WHEN has2 AND l2 = 'high' THEN 'sex' END) AS health FROM g"""


def q08_validity_histogram(spark, d):
    counts = rules.validity_counts(F.col("v"))
    rows = _findings(spark, d).select(*[c.alias(k) for k, c in counts.items()])
    return rows.agg(*[F.sum(k).cast("long").alias(k) for k in counts])


Q08 = FINDINGS_CTE + "SELECT " + ", ".join(f"CAST(sum((has1 AND l1 = '{x}')::INT + (has2 AND l2 = '{x}')::INT) AS BIGINT) AS {x}" for x in rules.LEVELS) + ", CAST(sum((has1 AND l1 = 'odd')::INT + (has2 AND l2 = 'odd')::INT + (m = 1)::INT + has2::INT) AS BIGINT) AS other FROM g"


def q09_feedback(spark, d):
    notes = F.parse_json(rules.feedback(rules.actionable(F.col("v"), rules.LEVELS)))
    get = lambda path, kind="string": F.try_variant_get("n", path, kind)
    return _findings(spark, d).select("doc_id", notes.alias("n")).select(
        "doc_id", F.size(get("$", "array<variant>")).cast("long").alias("n_entries"), get("$[0].attribute").alias("attribute"), get("$[0].leaked_concept").alias("concept"),
        get("$[0].evidence[0]").alias("evidence"), get("$[0].reasoning_evidence[0]").alias("reasoning"), F.is_variant_null(get("$[0].validation_notes", "variant")).alias("null_notes"),
    )


Q09 = FINDINGS_CTE + """, h AS (SELECT *, has1 AND l1 <> 'odd' AS u1, has2 AND l2 <> 'odd' AS u2 FROM g)
SELECT doc_id, u1::BIGINT + u2::BIGINT AS n_entries, CASE WHEN u1 THEN 'age' WHEN u2 THEN 'sex' END AS attribute, CASE WHEN u1 OR u2 THEN doc_id::VARCHAR END AS concept,
CASE WHEN u1 THEN 'words' WHEN u2 THEN 'a' END AS evidence, CASE WHEN u1 THEN 'words' WHEN u2 THEN 'a' END AS reasoning, (u1 OR u2) AS null_notes FROM h"""


def q10_has_leaks(spark, d):
    k = F.col("doc_id") % 3
    guess = F.parse_json(F.when(k == 0, F.lit('{"health_issue":"Unknown"}')).when(k == 1, F.lit('{"health_issue":"asthma"}')).otherwise(F.lit("{}")))
    multi = rules.has_leaks(MULTI, rules.actionable(F.col("v"), MULTI.actionable), guess)
    health = rules.has_leaks(HEALTH, rules.actionable(F.col("v"), HEALTH.actionable), guess)
    return _findings(spark, d).select("doc_id", multi.alias("multi"), health.alias("health"))


Q10 = FINDINGS_CTE + """SELECT doc_id, (has1 AND l1 IN ('high', 'medium')) OR (has2 AND l2 IN ('high', 'medium')) AS multi,
((has1 AND l1 = 'high') OR (has2 AND l2 = 'high')) AND doc_id % 3 = 1 AS health FROM g"""


def q11_safe(spark, d):
    k = F.col("event_id") % 6
    made = (
        F.when(k == 0, F.lit('{"health_issue":"unknown","age":"Unknown"}'))
        .when(k == 1, F.concat(F.lit('{"sex":"unknown","p":'), F.col("props"), F.lit("}")))
        .when(k == 2, F.lit('{"error":"x"}'))
        .when(k == 3, F.lit("{}"))
        .when(k == 4, F.lit('{"health_issue":null}'))
        .otherwise(F.lit('{"health_issue":"flu"}'))
    )
    rows = table(spark, d, "events").select("event_id", F.parse_json(made).alias("g"))
    return rows.select("event_id", rules.is_safe(MULTI, F.col("g")).alias("multi"), rules.is_safe(HEALTH, F.col("g")).alias("health"))


Q11 = "SELECT event_id, event_id % 6 = 0 AS multi, event_id % 6 IN (0, 1) AS health FROM events"


# --- Text rules --------------------------------------------------------------------------------


def q12_sanity(spark, d):
    error = text.sanity_error(_redacted(F.col("text")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", error.alias("error"))


Q12 = f"""WITH r AS (SELECT doc_id, {_strip_sql("text")} AS a, {_strip_sql(_redacted_sql("text"))} AS b FROM documents)
SELECT doc_id, CASE WHEN length(b) < 20 THEN 'catastrophic_deletion: length ' || length(b) WHEN a = b THEN 'anonymizer_stuck: text unchanged' END AS error FROM r"""


def q13_after_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.after_hash(F.col("text"))).alias("rest"))


Q13 = "SELECT doc_id, md5(" + _strip_sql("CASE WHEN contains(text, '#') THEN substr(text, strpos(text, '#') + 1) ELSE text END") + ") AS rest FROM documents"


def q14_truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.truncated(F.col("text"))).alias("short"))


Q14 = "SELECT doc_id, md5(CASE WHEN text IS NULL THEN '' WHEN length(text) > 400 THEN substr(text, 1, 400) || '... [truncated, len=' || length(text) || ']' ELSE text END) AS short FROM documents"


def q15_context_tag(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.context_tag(F.col("conv_id"), F.when(F.col("turn") > 0, F.col("turn"))).alias("tag"))


Q15 = "SELECT conv_id, turn, '[record ' || conv_id || '][iter ' || CASE WHEN turn > 0 THEN turn::VARCHAR ELSE '?' END || ']' AS tag FROM conversations"


def q16_chat_render(spark, d):
    """Turns are gathered per conversation, of a few messages each, and put in order."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", F.md5(prompts.rendered(F.col("m"))).alias("rendered"))


Q16 = "SELECT conv_id, md5(string_agg('<' || role || '>' || text, chr(10) ORDER BY turn)) AS rendered FROM conversations GROUP BY conv_id"


def q16b_prompts(spark, d):
    t = F.col("text")
    made = {
        "attack": prompts.attack_prompt(MULTI, t), "attack_two_role": prompts.attack_prompt(HEALTH, t, True), "arbitrate": prompts.arbitrate_prompt(MULTI, t, F.array(F.lit("age")), F.col("lang")),
        "anonymize": prompts.anonymize_prompt(t, F.col("source")), "judge": prompts.judge_prompt(t, F.col("lang")), "teach": prompts.teacher_prompt(t, F.col("lang")),
    }
    none = prompts.arbitrate_prompt(MULTI, t, F.array().cast("array<string>"), F.col("lang")).isNull()
    return table(spark, d, "documents").select("doc_id", *[F.md5(prompts.rendered(c)).alias(k) for k, c in made.items()], none.alias("no_call"))


def _prompt_sql(system: str, user: str) -> str:
    return "md5('<system>" + system.replace("'", "''") + "' || chr(10) || '<user>' || " + user + ")"


Q16B = "SELECT doc_id, " + ", ".join([
    _prompt_sql(prompts.attacker_system(MULTI), "'Comment:' || chr(10) || text") + " AS attack",
    _prompt_sql(prompts.attacker_system(HEALTH, True), "'Comment:' || chr(10) || text") + " AS attack_two_role",
    _prompt_sql(prompts.arbitrator_system(MULTI), "concat('Comment:', chr(10), text, chr(10), chr(10), 'Attributes:', chr(10), '[\"age\"]', chr(10), chr(10), 'Inference:', chr(10), lang)") + " AS arbitrate",
    _prompt_sql(prompts.ANONYMIZER, "concat('Comment:', chr(10), text, chr(10), chr(10), 'Feedback:', chr(10), source)") + " AS anonymize",
    _prompt_sql(prompts.JUDGE, "concat('Original:', chr(10), text, chr(10), chr(10), 'Edited:', chr(10), lang)") + " AS judge",
    _prompt_sql(prompts.TEACHER, "concat('Context:', chr(10), lang, chr(10), chr(10), 'Comment:', chr(10), text)") + " AS teach",
]) + ", true AS no_call FROM documents"


# --- Utility -----------------------------------------------------------------------------------


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, quality, toxic, judge): judge's answers of all kinds, valid and not."""
    k, mark = F.col("doc_id") % 6, (1 + F.col("doc_id") % 10).cast("string")
    part = lambda name, score: F.concat(F.lit(f'"{name}":{{"score":'), score, F.lit("}"))
    whole = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    r, m, h = part("readability", mark), part("meaning", F.lit('"8"')), part("hallucinations", F.col("quality").cast("string"))
    judge = (
        F.when(k == 0, whole(r, m, h)).when(k == 1, whole(r, part("meaning", F.lit("7.5")), h)).when(k == 2, whole(r, F.lit('"meaning":8'), h))
        .when(k == 3, whole(r, part("meaning", F.lit('"good"')), h)).when(k == 4, F.lit(None).cast("string")).otherwise(whole(r, h))
    )
    return table(spark, d, "labels").select("doc_id", "quality", "toxic", judge.alias("judge"))


JUDGED_CTE = """
j AS (SELECT doc_id, quality, toxic, CASE doc_id % 6 WHEN 2 THEN 'dropped' WHEN 3 THEN 'parse_error' WHEN 4 THEN 'api_error' END AS error,
  (1 + doc_id % 10)::DOUBLE AS r, CASE doc_id % 6 WHEN 0 THEN 8.0 WHEN 1 THEN 7.5 ELSE 0.0 END AS m FROM labels),
u AS (SELECT *, CASE WHEN error IS NULL THEN (r / 10 + m / 10 + quality) / 3 END AS combined FROM j)
"""


def q17_combined_utility(spark, d):
    rows = _judged(spark, d).select("doc_id", evaluate.utility(F.col("judge")).alias("u"))
    return rows.select("doc_id", F.round("u.combined", 9).alias("combined"), F.col("u.error").alias("error"))


Q17 = "WITH " + JUDGED_CTE.strip() + " SELECT doc_id, round(combined, 9) AS combined, error FROM u"


def q18_average_utility(spark, d):
    rows = _judged(spark, d).select(evaluate.utility(F.col("judge")).alias("u"))
    return rows.agg(F.round(F.coalesce(F.avg("u.combined"), F.lit(0.0)), 9).alias("average_utility"))


Q18 = "WITH " + JUDGED_CTE.strip() + " SELECT round(coalesce(avg(combined), 0), 9) AS average_utility FROM u"


def q19_evaluation_summary(spark, d):
    id_ = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("response"), F.when(id_ % 13 != 0, _redacted(F.col("text"))).alias("anonymized_response"))
    guess = F.concat(F.lit("Inference: a\nGuess: "), _json(age=20 + (id_ * 3) % 50, sex=F.when(id_ % 2 == 0, "Male").otherwise("female")))
    rows = docs.join(_judged(spark, d), "doc_id").select(
        id_.alias("record_id"), "response", "anonymized_response", _json(age=20 + id_ % 50, sex=F.lit("male")).alias("personality"), F.col("judge").alias("judge_response"),
        F.when(id_ % 11 != 0, guess).alias("adversary_response"),
    )
    out = evaluate.summarized(evaluate.scored(rows, MULTI), rows)
    return out.select(F.round("average_utility", 9).alias("average_utility"), F.round("attack_success_rate", 9).alias("attack_success_rate"), "total_records")


Q19 = "WITH " + JUDGED_CTE.strip() + """, e AS (SELECT u.*, text FROM u JOIN documents USING (doc_id)),
k AS (SELECT * FROM e WHERE doc_id % 13 <> 0 AND length(text) > 0 AND doc_id % 11 <> 0 AND coalesce(error, '') <> 'dropped')
SELECT round(coalesce(avg(combined), 0), 9) AS average_utility,
  round(coalesce(sum((doc_id % 2 = 0)::INT + (abs((20 + doc_id % 50) - (20 + (doc_id * 3) % 50)) <= 3)::INT)::DOUBLE / nullif(count(*) * 2, 0), 0), 9) AS attack_success_rate,
  (SELECT count(*) FROM e) AS total_records FROM k"""


# --- Records, pairs, files ---------------------------------------------------------------------


def q20_training_texts(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    rows = table(spark, d, "documents").join(good, "doc_id").select(F.col("text").alias("response"), _redacted(F.col("text")).alias("anonymized_response"), F.when(F.col("lang") != "en", F.col("lang")).alias("context"))
    return training_pairs.training_texts(rows).select(F.md5("text").alias("text_md5"))


Q20 = f"""SELECT md5(CASE WHEN lang <> 'en' THEN 'Context: ' || lang || chr(10) ELSE '' END || 'Comment: ' || text || chr(10) || 'Rewritten: ' || {_redacted_sql("text")}) AS text_md5
FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text IS NOT NULL"""


def q21_skipped(spark, d):
    blanked = F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 10 == 1, None).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.is_blank(blanked).alias("skipped"), text.is_evaluable(F.col("text"), blanked).alias("evaluable"))


Q21 = """SELECT doc_id, doc_id % 10 IN (0, 1) OR coalesce(length(text), 0) = 0 AS skipped, doc_id % 10 NOT IN (0, 1) AND coalesce(length(text), 0) > 0 AS evaluable FROM documents"""


def q22_jsonl_round_trip(spark, d):
    path = passing_path(spark, "lines")
    jsonl.save(table(spark, d, "documents").withColumn("none", F.lit(None).cast("string")), path)
    get = lambda key, kind: F.variant_get("raw", f"$.{key}", kind)
    return jsonl.scan(spark, path).select(get("doc_id", "long").alias("doc_id"), F.md5(get("text", "string")).alias("text_md5"), get("n_chars", "long").alias("n_chars"), F.is_variant_null(get("none", "variant")).alias("null_kept"))


Q22 = "SELECT doc_id, md5(text) AS text_md5, n_chars, true AS null_kept FROM documents"


def _odd_lines(spark: SparkSession, d: str) -> DataFrame:
    """A line a document: objects, blank and malformed lines, lists, scalars and null."""
    k, id_ = F.col("doc_id") % 8, F.col("doc_id").cast("string")
    whole = F.to_json(F.struct("doc_id", "text"))
    made = (
        F.when(k == 0, whole).when(k == 1, "  \t ").when(k == 2, F.concat(F.lit("{bad "), id_)).when(k == 3, F.concat(F.lit("["), id_, F.lit(",2]")))
        .when(k == 4, id_).when(k == 5, F.concat(F.lit('"x'), id_, F.lit('"'))).when(k == 6, F.concat(F.lit(" \t"), whole, F.lit("  "))).otherwise(F.lit("null"))
    )
    return table(spark, d, "documents").select(made.alias("value"))


def q34_odd_lines(spark, d):
    path = passing_path(spark, "odd-lines")
    _odd_lines(spark, d).write.text(path)
    object_ = F.try_variant_get("raw", "$", "map<string,variant>").isNotNull()
    shape = F.when(F.is_variant_null("raw"), "null").when(object_, "object").when(F.try_variant_get("raw", "$", "array<variant>").isNotNull(), "list").otherwise("scalar")
    return jsonl.scan(spark, path).groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(object_, F.try_variant_get("raw", "$.doc_id", "long"))).alias("id_sum"))


Q34 = """SELECT CASE WHEN doc_id % 8 IN (0, 6) THEN 'object' WHEN doc_id % 8 = 3 THEN 'list' WHEN doc_id % 8 = 7 THEN 'null' ELSE 'scalar' END AS shape, count(*) AS n,
CAST(sum(CASE WHEN doc_id % 8 IN (0, 6) THEN doc_id END) AS BIGINT) AS id_sum FROM documents WHERE doc_id % 8 NOT IN (1, 2) GROUP BY 1"""


def q23_limit(spark, d):
    """A scan's limit, the feature here, counts accepted records; which ones they are is free, so their number and kind are told."""
    path = passing_path(spark, "odd-lines")
    _odd_lines(spark, d).write.text(path)
    rows = jsonl.scan(spark, path, 100)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw").isNull()).alias("n_empty"))


Q23 = "SELECT least(100, count(*)) AS n, 0::BIGINT AS n_empty FROM documents WHERE doc_id % 8 NOT IN (1, 2)"


def q35_strict_scan(spark, d):
    """The first lines of one ordered file, which the strict scan's limit counts."""
    path = passing_path(spark, "strict-lines")
    jsonl.as_lines(table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5"))).repartition(1).sortWithinPartitions(F.get_json_object("value", "$.doc_id").cast("long")).write.text(path)
    rows = jsonl.scan_strict(spark, path, 150)
    return rows.select(F.variant_get("raw", "$.doc_id", "long").alias("doc_id"), F.variant_get("raw", "$.text_md5", "string").alias("text_md5"))


Q35 = "SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT 150"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("reference"), _redacted(F.col("text")).alias("candidate"))


def q24_clipped_bigrams(spark, d):
    return metrics.clipped_matches(_pairs(spark, d), 2).select("record_id", F.col("matched").cast("long").alias("matched"), F.col("total").cast("long").alias("total"))


Q24 = f"""WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array({_redacted_sql("text")}, '{SPACE}'), lambda x: x <> '') AS c FROM documents),
rg AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(generate_series(1, len(r) - 1), lambda i: r[i] || ' ' || r[i + 1])) AS g FROM p) GROUP BY ALL),
cg AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(generate_series(1, len(c) - 1), lambda i: c[i] || ' ' || c[i + 1])) AS g FROM p) GROUP BY ALL)
SELECT doc_id AS record_id, CAST(sum(least(cg.n, coalesce(rg.n, 0))) AS BIGINT) AS matched, CAST(sum(cg.n) AS BIGINT) AS total FROM cg LEFT JOIN rg USING (doc_id, g) GROUP BY doc_id"""


def q25_bleu(spark, d):
    return _pairs(spark, d).select("record_id", F.round(metrics.bleu_score("reference", "candidate"), 9).alias("bleu"))


_TOKENS = "list_filter(regexp_split_to_array({}, '" + SPACE + "'), lambda x: x <> '')"
Q25 = f"""WITH p AS (SELECT doc_id, {_TOKENS.format("text")} AS r, {_TOKENS.format(_redacted_sql("text"))} AS c FROM documents),
g AS (SELECT doc_id, n, 0 AS side, unnest(list_transform(generate_series(1, len(r) - n + 1), lambda i: array_to_string(r[i : i + n - 1], ' '))) AS gram FROM p, generate_series(1, 5) o(n) WHERE len(r) >= n
  UNION ALL SELECT doc_id, n, 1, unnest(list_transform(generate_series(1, len(c) - n + 1), lambda i: array_to_string(c[i : i + n - 1], ' '))) FROM p, generate_series(1, 5) o(n) WHERE len(c) >= n),
k AS (SELECT doc_id, n, gram, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS shared FROM g GROUP BY ALL),
m AS (SELECT p.doc_id, len(r) AS lr, len(c) AS lc, list_transform([1, 2, 3, 4, 5], lambda n: coalesce(map_extract(x.mm, n)[1], 0)) AS m
  FROM p LEFT JOIN (SELECT doc_id, map_from_entries(list((n, t))) AS mm FROM (SELECT doc_id, n, sum(shared) AS t FROM k GROUP BY ALL) GROUP BY doc_id) x USING (doc_id)),
z AS (SELECT *, list_transform([1, 2, 3, 4], lambda n: len(list_filter(m[1:n], lambda x: x = 0))) AS zeros FROM m),
q AS (SELECT *, list_transform([1, 2, 3, 4, 5], lambda n: CASE WHEN n < 5 AND m[n] = 0 AND lc > 1 THEN ln(lc) / (5 * pow(2, zeros[n])) ELSE m[n]::DOUBLE END / greatest(1, lc - n + 1)) AS p FROM z),
s1 AS (SELECT *, (p[1] + 1 + p[1] + p[2]) / 3 AS a FROM q), s2 AS (SELECT *, (a + p[2] + p[3]) / 3 AS b FROM s1), s3 AS (SELECT *, (b + p[3] + p[4]) / 3 AS e FROM s2), s4 AS (SELECT *, (e + p[4] + p[5]) / 3 AS f FROM s3)
SELECT doc_id AS record_id, round(CASE WHEN lr = 0 OR lc = 0 OR lr IS NULL OR lc IS NULL OR m[1] = 0 THEN 0 ELSE CASE WHEN lc > lr THEN 1 ELSE exp(1 - lr / lc) END * exp((ln(a) + ln(b) + ln(e) + ln(f)) / 4) END, 9) AS bleu FROM s4"""


def q26_common_tokens(spark, d):
    """Longest common subsequence of white-space tokens, over whole texts."""
    return _pairs(spark, d).select("record_id", metrics.common_tokens("reference", "candidate").alias("lcs"))


def q27_rouge_l(spark, d):
    return _pairs(spark, d).select("record_id", F.round(metrics.rouge_l_score("reference", "candidate"), 9).alias("rouge_l"))


def q37_turn_rouge(spark, d):
    """ROUGE-L, unstemmed, of each turn against the one before; short texts, so SQL can hold the table of the subsequence."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", before.alias("before")).where("before is not null and text is not null")
    return rows.select("conv_id", "turn", F.round(metrics.rouge_l_unstemmed("before", "text"), 9).alias("rouge_l"))


Q37 = """WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
w AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(before), '[a-z0-9]+'), lambda x: [(hash(x) % 4611686018427387904)::BIGINT]) AS a, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: (hash(x) % 4611686018427387904)::BIGINT) AS b FROM t WHERE before IS NOT NULL AND text IS NOT NULL),
l AS (SELECT conv_id, turn, len(a) AS la, len(b) AS lb, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE
  list_last(list_reduce(a, lambda prev, e: list_reduce(list_transform(generate_series(1, len(b)), lambda j: [j::BIGINT]),
    lambda acc, j: list_append(acc, CASE WHEN b[j[1]] = e[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], acc[len(acc)]) END), [0::BIGINT]),
    list_transform(generate_series(0, len(b)), lambda j: 0::BIGINT))) END AS lcs FROM w)
SELECT conv_id, turn, round(CASE WHEN lcs = 0 THEN 0 ELSE 2 * lcs::DOUBLE / (la + lb) END, 9) AS rouge_l FROM l"""


# --- Loops -------------------------------------------------------------------------------------


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("response"), "lang")


def q28_two_role_loop(spark, d):
    out = loops.two_role_loop(_comments(spark, d), PATTERNS, loops.bind_roles(RuleBackend()))
    return out.select("record_id", "lang", "outcome.status", F.col("outcome.iterations").cast("long").alias("iterations"), F.col("outcome.calls").cast("long").alias("calls"), F.md5("anonymized_response").alias("text_md5"))


Q28 = f"""WITH r AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_redacted_sql("coalesce(text, '')")} AS red FROM documents)
SELECT doc_id AS record_id, lang, CASE WHEN text = '' THEN 'skipped' WHEN red = text THEN 'success_original' ELSE 'success' END AS status, (red <> text)::BIGINT AS iterations,
CASE WHEN text = '' THEN 0 WHEN red = text THEN 1 ELSE 3 END::BIGINT AS calls, md5(CASE WHEN red = text THEN text ELSE {_strip_sql("red")} END) AS text_md5 FROM r"""


def scripted_answer(record_id: str, role: str, iteration: int) -> str:
    """By record_id modulo 5: 1 never leaks, 2 is edited to nothing, 3 leaks twice, 4 always."""
    k = int(record_id) % 5
    if role == "attacker":
        return 'Inference: speaks of age\nGuess: {"age": 30}'
    if role == "arbitrator":
        return "[]" if k == 1 or (k == 3 and iteration >= 2) else '[{"attribute": "age", "validity_level": "Medium"}]'
    return "cut\n#\ntoo short" if k == 2 else f"changed\n#\nEdit number {iteration} of record {record_id}, long enough."


def _three_role(spark: SparkSession, d: str) -> DataFrame:
    rows = _comments(spark, d).withColumn("response", F.when(F.col("record_id") % 5 == 0, "").otherwise(F.coalesce(F.nullif("response", F.lit("")), F.lit("some text"))))
    return loops.three_role_loop(rows, MULTI, loops.bind_roles(ScriptedBackend(scripted_answer)), max_iterations=3)


def q29_three_role_loop(spark, d):
    return _three_role(spark, d).select(
        "record_id", "outcome.status", F.col("outcome.iterations").cast("long").alias("iterations"), F.col("outcome.calls").cast("long").alias("calls"), F.size("outcome.history").cast("long").alias("n_history"),
        F.array_join("outcome.final_leaked_attributes", ",").alias("left_over"), F.md5("anonymized_response").alias("text_md5"), F.regexp_extract("outcome.error", "^[a-z_]+", 0).alias("error"),
    )


Q29 = """WITH d AS (SELECT doc_id, doc_id % 5 AS k, coalesce(nullif(text, ''), 'some text') AS text FROM documents)
SELECT doc_id AS record_id, ['skipped', 'success_original', 'model_error', 'success', 'max_iterations'][k + 1] AS status, [0, 0, 1, 2, 3][k + 1]::BIGINT AS iterations, [0, 2, 3, 8, 11][k + 1]::BIGINT AS calls,
[0, 1, 1, 3, 4][k + 1]::BIGINT AS n_history, CASE k WHEN 3 THEN '' WHEN 4 THEN 'age (Medium)' END AS left_over,
CASE WHEN k IN (1, 2) THEN md5(text) WHEN k = 3 THEN md5('Edit number 2 of record ' || doc_id || ', long enough.') WHEN k = 4 THEN md5('Edit number 3 of record ' || doc_id || ', long enough.') END AS text_md5,
CASE k WHEN 2 THEN 'catastrophic_deletion' END AS error FROM d"""


def q30_last_history(spark, d):
    return loops.last_history(_three_role(spark, d)).select("record_id", F.col("iteration").cast("long").alias("iteration"), F.md5("text").alias("text_md5"))


Q30 = """WITH d AS (SELECT doc_id, doc_id % 5 AS k, coalesce(nullif(text, ''), 'some text') AS text FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id AS record_id, [0, 0, 2, 3][k]::BIGINT AS iteration, md5(CASE WHEN k > 2 THEN 'Edit number ' || (k - 1) || ' of record ' || doc_id || ', long enough.' ELSE text END) AS text_md5 FROM d"""


@dataclass
class Failing:
    """A backend whose calls fail for every seventh record."""

    inner: ModelBackend

    def generate(self, requests: list[Request]) -> list[str | None]:
        return [None if int(r.record_id) % 7 == 0 else a for r, a in zip(requests, self.inner.generate(requests), strict=True)]


def q31_teacher_rows(spark, d):
    out = training_pairs.teacher_rows(_comments(spark, d).withColumnRenamed("lang", "context"), Failing(RuleBackend()))
    return out.select("record_id", "context", F.md5("anonymized_response").alias("text_md5"))


Q31 = f"SELECT doc_id AS record_id, lang AS context, md5({_strip_sql(_redacted_sql('text'))}) AS text_md5 FROM documents WHERE doc_id % 7 <> 0 AND length(text) > 0"


def constant_answer(record_id: str, role: str, iteration: int) -> str:
    return "why\n#\nA constant text without patterns."


def q32_role_binding(spark, d):
    one = loops.two_role_loop(_comments(spark, d), PATTERNS, loops.bind_roles(RuleBackend()))
    two = loops.two_role_loop(_comments(spark, d), PATTERNS, loops.bind_roles(attacker=RuleBackend(), anonymizer=ScriptedBackend(constant_answer)))
    both = one.withColumn("binding", F.lit("shared")).unionByName(two.withColumn("binding", F.lit("separate")))
    return both.where("outcome.status = 'success'").groupBy("binding").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("anonymized_response").alias("n_texts"))


Q32 = f"""WITH r AS (SELECT text, {_redacted_sql("text")} AS red FROM documents WHERE length(text) > 0), s AS (SELECT {_strip_sql("red")} AS t FROM r WHERE red <> text)
SELECT 'shared' AS binding, count(*) AS n, count(DISTINCT t) AS n_texts FROM s HAVING count(*) > 0 UNION ALL SELECT 'separate', count(*), count(DISTINCT 1) FROM s HAVING count(*) > 0"""


def q38_scripted_table(spark, d):
    """The two-role loop with answers from a table, met by a join: even records are guessed until their edit, odd ones not at all."""
    rows = _comments(spark, d).where("length(response) > 0")
    k, given = F.col("record_id") % 2, F.col("record_id")
    answer = lambda role, i, text: rows.select(given, F.lit(role).alias("role"), F.lit(i).alias("iteration"), text.alias("answer"))
    known, unknown = F.lit('Inference: a\nGuess: {"age": 30}'), F.lit('Inference: a\nGuess: {"age": "unknown"}')
    answers = answer("attacker", 0, F.when(k == 0, known).otherwise(unknown)).unionByName(answer("anonymizer", 1, F.concat(F.lit("why\n#\nedit of "), given.cast("string")))).unionByName(answer("attacker", 1, unknown))
    out = loops.two_role_loop(rows, MULTI, loops.bind_roles(ScriptedAnswers(answers)))
    return out.select("record_id", "outcome.status", F.col("outcome.calls").cast("long").alias("calls"), F.md5("anonymized_response").alias("text_md5"))


Q38 = """SELECT doc_id AS record_id, CASE doc_id % 2 WHEN 0 THEN 'success' ELSE 'success_original' END AS status, CASE doc_id % 2 WHEN 0 THEN 3 ELSE 1 END::BIGINT AS calls,
md5(CASE doc_id % 2 WHEN 0 THEN 'edit of ' || doc_id ELSE text END) AS text_md5 FROM documents WHERE length(text) > 0"""


def q33_label_list(spark, d):
    found = rules.labelled(rules.actionable(F.col("v"), MULTI.actionable))
    return _findings(spark, d).select("doc_id", F.array_join(found, ",").alias("labels"))


Q33 = FINDINGS_CTE + """SELECT doc_id, concat_ws(',', CASE WHEN has1 AND l1 IN ('high', 'medium') THEN 'age (' || r1 || ')' END, CASE WHEN has2 AND l2 IN ('high', 'medium') THEN 'sex (' || r2 || ')' END) AS labels FROM g"""


_ALL: list[tuple[Callable, str | None]] = [
    (q01_profile_leaks, Q01), (q02_attack_success_rate, Q02), (q03_rate_by_attribute, Q03), (q04_health_leaks, Q04), (q05_attack_parse, Q05), (q06_first_json, Q06), (q07_actionable, Q07),
    (q08_validity_histogram, Q08), (q09_feedback, Q09), (q10_has_leaks, Q10), (q11_safe, Q11), (q12_sanity, Q12), (q13_after_hash, Q13), (q14_truncated, Q14), (q15_context_tag, Q15),
    (q16_chat_render, Q16), (q16b_prompts, Q16B), (q17_combined_utility, Q17), (q18_average_utility, Q18), (q19_evaluation_summary, Q19), (q20_training_texts, Q20), (q21_skipped, Q21),
    (q22_jsonl_round_trip, Q22), (q23_limit, Q23), (q24_clipped_bigrams, Q24), (q25_bleu, Q25), (q26_common_tokens, None), (q27_rouge_l, None), (q28_two_role_loop, Q28),
    (q29_three_role_loop, Q29), (q30_last_history, Q30), (q31_teacher_rows, Q31), (q32_role_binding, Q32), (q33_label_list, Q33),
    (q34_odd_lines, Q34), (q35_strict_scan, Q35), (q36_all_attributes, Q36), (q37_turn_rouge, Q37), (q38_scripted_table, Q38),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _ALL if sql}
