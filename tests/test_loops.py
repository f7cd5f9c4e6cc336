"""Loops, evaluation, sources and backends."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from veilframe import logs, run
from veilframe.functions import prompts
from veilframe.functions.rules import HEALTH, MULTI
from veilframe.operators import evaluate, loops, training_pairs
from veilframe.plans import catalog
from veilframe.sources import jsonl, models
from veilframe.streaming import incremental


def comments(spark, rows):
    return spark.createDataFrame(rows, "record_id long, response string, mood string")


def test_three_role_exits_and_call_counts(spark):
    rows = comments(spark, [(0, "", "a"), (5, None, "b"), (1, "text one", "c"), (2, "text two", "d"), (3, "text three", "e"), (4, "text four", "f")])
    got = {r.record_id: r for r in loops.three_role_loop(rows, MULTI, loops.bind_roles(models.ScriptedBackend(catalog.scripted_answer)), max_iterations=4).select("*", "outcome.*").collect()}
    assert {k: r.status for k, r in got.items()} == {0: "skipped", 5: "skipped", 1: "success_original", 2: "model_error", 3: "success", 4: "max_iterations"}
    assert {k: r.calls for k, r in got.items()} == {0: 0, 5: 0, 1: 2, 2: 3, 3: 2 + 3 * 2, 4: 2 + 3 * 4}
    assert got[0].anonymized_response is None and got[1].anonymized_response == "text one" and got[2].anonymized_response == "text two"
    assert got[1].guess_json is None and len(got[2].history) == 1 and got[2].error.startswith("catastrophic")
    assert got[3].final_leaked_attributes == [] and got[4].final_leaked_attributes == ["age (Medium)"]
    assert [h.iteration for h in got[4].history] == [0, 1, 2, 3, 4] and {r.mood for r in got.values()} == set("abcdef")


def test_failed_generations_are_flagged_and_fail_closed(spark):
    rows = comments(spark, [(1, "some text", "a")])
    silent_roles = loops.bind_roles(models.ScriptedBackend(lambda *_: ""))
    strict, compat = (loops.three_role_loop(rows, MULTI, silent_roles, compat=c).select("outcome.*").first() for c in (False, True))
    assert (strict.status, compat.status, strict.model_failure, compat.model_failure) == ("model_error", "success_original", True, True)


def test_two_role_exits(spark):
    rows = comments(spark, [(1, "write to a.b@example.com now", "a"), (2, "nothing here", "b"), (3, "", "c")])
    got = {r.record_id: r for r in loops.two_role_loop(rows, catalog.PATTERNS, loops.bind_roles(models.RuleBackend())).select("*", "outcome.*").collect()}
    assert {k: (r.status, r.calls, r.anonymized_response) for k, r in got.items()} == {1: ("success", 3, "write to [EMAIL] now"), 2: ("success_original", 1, "nothing here"), 3: ("skipped", 0, "")}
    stubborn = loops.bind_roles(attacker=models.RuleBackend(), anonymizer=models.ScriptedBackend(lambda *_: "x\n#\nstill a.b@example.com"))
    out = loops.two_role_loop(rows, catalog.PATTERNS, stubborn, max_iterations=2, order="record_id").select("*", "outcome.*").collect()
    assert [(r.record_id, r.status, r.calls) for r in out] == [(1, "max_iterations", 5), (2, "success_original", 1), (3, "skipped", 0)]
    with pytest.raises(ValueError):
        loops.bind_roles(attacker=models.RuleBackend())


def test_evaluation(spark):
    score = lambda r, m, h: json.dumps({"readability": {"score": r}, "meaning": {"score": m}, "hallucinations": {"score": h}})
    guess = 'Inference: x\nGuess: {"age": 31, "sex": "f"}'
    rows = [
        (1, "a text", "b text", '{"age":30,"sex":"F","x":1}', score(10, "8", 1), guess), (2, "a", "b", '{"age":50}', score(1, "bad", 1), guess), (3, "a", "b", '{"age":30}', None, guess),
        (4, "a", "b", '{"age":30}', score(10, 10, 1), None), (5, "a", "b", '{"age":30}', '{"meaning": 3}', guess), (6, "a", "b", "null", score(10, 10, 1), guess), (7, "a", "", "{}", None, None),
    ]
    frame = spark.createDataFrame(rows, "record_id long, response string, anonymized_response string, personality string, judge_response string, adversary_response string")
    details = evaluate.scored(frame, MULTI)
    got = {r.record_id: r for r in details.collect()}
    assert {k: r.dropped_reason for k, r in got.items()} == {1: None, 2: None, 3: None, 4: "adversary_api_error", 5: "judge_shape", 6: "null_profile"}
    assert got[1].utility.combined == pytest.approx(2.8 / 3) and got[2].utility.error == "parse_error" and got[3].utility.error == "api_error"
    assert (got[1].leaked_count, got[1].total_attributes, got[3].leaked_count) == (2, 3, 1)
    summary = evaluate.summarized(details, frame)
    row = summary.first()
    assert (row.average_utility, row.attack_success_rate, row.total_records) == (pytest.approx(2.8 / 3), pytest.approx(3 / 5), 7)
    none = frame.where("false")
    assert tuple(evaluate.summarized(evaluate.scored(none, MULTI), frame).first()) == (0.0, 0.0, 7)
    assert json.loads(jsonl.summary_document(summary, details.select("record_id")))["details"][0]["record_id"] in got
    live, _ = evaluate.evaluate(frame, MULTI, models.ScriptedBackend(catalog.scripted_answer), models.ScriptedBackend(catalog.scripted_answer))
    assert live.first().total_records == 7
    assert evaluate.scored(frame, HEALTH).first().total_attributes == 1


def test_teacher_and_training_texts(spark):
    rows = spark.createDataFrame([(1, "call +49 (30) 1234567", "c"), (7, "x", ""), (2, "", "c")], "record_id long, response string, context string")
    got = training_pairs.teacher_rows(rows, catalog.Failing(models.RuleBackend())).collect()
    assert [(r.record_id, r.anonymized_response) for r in got] == [(1, "call [PHONE]")]
    texts = training_pairs.training_texts(spark.createDataFrame([("a", "b", "c"), ("a", "", None), (None, "b", "c")], "response string, anonymized_response string, context string"))
    assert [r.text for r in texts.collect()] == ["Context: c\nComment: a\nRewritten: b", "Comment: a\nRewritten: "]
    raw = spark.createDataFrame([('{"response":"a","anonymized_response":null}',), ('{"response":"a"}',)], "j string").select(F.parse_json("j").alias("raw"))
    assert training_pairs.training_texts_of_variants(raw).count() == 1


def test_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"a": "é", "b": null}\n\n  \n{bad\n[1,2]\n7\n', encoding="utf-8")
    path = f"file://{tmp_path}/in.jsonl"
    assert sorted(r.j for r in jsonl.scan(spark, path).select(F.to_json("raw").alias("j")).collect()) == ["7", "[1,2]", '{"a":"é","b":null}']
    assert jsonl.scan(spark, path, 2).count() == 2 and jsonl.scan(spark, path, 0).count() == 3
    assert jsonl.rejected_lines(spark.read.text(path)).collect()[0].n_chars == 4
    with pytest.raises(Exception, match="malformed line"):
        jsonl.scan_strict(spark, path).collect()
    assert jsonl.scan_strict(spark, path, 1).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jsonl.scan(spark, f"file://{tmp_path}/none.jsonl")
    jsonl.save(spark.createDataFrame([(1, None, "é")], "x long, y string, z string"), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").first().value == '{"x":1,"y":null,"z":"é"}'


def test_streamed_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text('{"a": 1}\n{bad\n')
    query = incremental.run_on_arrival(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", lambda df: df.select(F.variant_get("raw", "$.a", "long").alias("a")))
    query.awaitTermination(60)
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/out/batch=0").collect()] == ['{"a":1}']


def test_backends(monkeypatch):
    request = models.Request("1", "judge", 0, [{"role": "user", "content": "x"}], 0.1)
    monkeypatch.delenv("API_KEY", raising=False)
    assert models.HttpBackend("http://none", "m").generate([request]) == [None]
    waits, calls = [], []

    def post(url, headers, body, timeout):
        calls.append(body["max_tokens"])
        if len(calls) < 3:
            raise OSError
        return {"choices": [{"message": {"content": " fine "}}]}

    assert models.HttpBackend("http://none", "m", "k", pause=waits.append, post=post).generate([request]) == ["fine"]
    assert calls == [1024] * 3 and waits == [2.0, 4.0]

    def broken(*_):
        raise OSError

    assert models.HttpBackend("http://none", "m", "k", pause=waits.append, post=broken).generate([request]) == [None] and waits[2:] == [2.0, 4.0, 6.0]
    sizes = []

    def load():
        def texts(conversations, temperature, n):
            sizes.append(len(conversations))
            return [m[0]["content"] * n if temperature and m[0]["content"] != "bad" else 1 / 0 for m in conversations]

        return texts

    local = models.LocalBackend("t", load, 2, batch=3)
    assert local.generate([request, request._replace(temperature=0.0)]) == ["xx", ""]
    sizes.clear()
    many = [request._replace(messages=[{"role": "user", "content": c}]) for c in ("a", "b", "c", "d", "bad")]
    assert local.generate(many) == ["aa", "bb", "cc", "dd", ""] and sizes == [3, 2, 1, 1]


def test_remote_calls_run_side_by_side(monkeypatch):
    import threading

    together = threading.Barrier(4, timeout=20)

    def post(url, headers, body, timeout):
        together.wait()
        return {"choices": [{"message": {"content": body["messages"][0]["content"]}}]}

    requests = [models.Request(str(i), "judge", 0, [{"role": "user", "content": f"x{i}"}], 0.1) for i in range(8)]
    assert models.HttpBackend("http://none", "m", "k", workers=4, post=post).generate(requests) == [f"x{i}" for i in range(8)]


def test_a_task_that_runs_again_calls_no_finished_answer_again(spark, tmp_path):
    """Four of five calls are answered before the first run of a task fails; only what is left is asked by the second."""

    class Counting:
        def __init__(self, folder):
            self.folder = folder

        def generate(self, requests):
            import os

            for r in requests:
                with open(os.path.join(self.folder, f"{r.record_id}-{r.role}-{r.iteration}"), "a") as file:
                    file.write("x")
            return [f"Inference: {r.record_id}" for r in requests]

    (tmp_path / "calls").mkdir()
    backend = models.CachedBackend(Counting(str(tmp_path / "calls")), str(tmp_path / "answers"))
    requests = [models.Request(str(i), "attacker", 0, [{"role": "user", "content": "é\n"}], 0.1) for i in range(5)]
    backend.generate(requests[:4])
    assert backend.generate(requests) == [f"Inference: {i}" for i in range(5)]
    assert {p.name: p.read_text() for p in (tmp_path / "calls").iterdir()} == {f"{i}-attacker-0": "x" for i in range(5)}
    assert models.CachedBackend(models.ScriptedBackend(lambda *_: ""), str(tmp_path / "answers")).generate([requests[0]._replace(iteration=1)]) == [""]
    rows = comments(spark, [(10 + i, f"text {i} long enough to keep", "a") for i in range(3)])
    for _ in range(2):
        loops.two_role_loop(rows, MULTI, loops.bind_roles(backend), max_iterations=1).collect()
    assert {p.read_text() for p in (tmp_path / "calls").iterdir()} == {"x"}


def test_columns_of_the_records_pass_through_whatever_their_names(spark):
    names = ("current", "status", "iterations", "error", "inference", "guess_json", "leaks_json", "history", "calls", "model_failure")
    rows = spark.createDataFrame([(1, "write to a.b@example.com now", *[f"own {n}" for n in names])], "record_id long, response string, " + ", ".join(f"{n} string" for n in names))
    for out in (loops.two_role_loop(rows, catalog.PATTERNS, loops.bind_roles(models.RuleBackend())), loops.three_role_loop(rows, MULTI, loops.bind_roles(models.ScriptedBackend(catalog.scripted_answer)))):
        row = out.first()
        assert {n: row[n] for n in names} == {n: f"own {n}" for n in names} and row.outcome.status.startswith("success")
    with pytest.raises(ValueError, match="outcome"):
        loops.two_role_loop(rows.withColumn("outcome", F.lit(1)), MULTI, loops.bind_roles(models.RuleBackend()))
    with pytest.raises(ValueError, match="_prompt"):
        models.answered(rows.withColumn("_prompt", F.lit(1)), models.RuleBackend(), "teacher", 0, 0.1, F.lit(None))


def test_run_drivers(spark, tmp_path, caplog):
    lines = ['{"record_id": 1, "response": "write to a.b@example.com now", "x": {"y": [1, null]}, "a.b": 2}', '{"response": "", "z": "é\\""}', "[1]", "{bad", "", '{"response": "plain words", "response": "nothing to \\"hide\\" here", "n": NaN}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines), encoding="utf-8")
    base = f"file://{tmp_path}"
    logs.setup("nonsense", str(tmp_path / "log.txt"))
    run.anonymize(spark, f"{base}/in.jsonl", f"{base}/out", catalog.PATTERNS, loops.bind_roles(models.RuleBackend()), "two", quarantine=f"{base}/odd")
    got = {x.get("record_id"): x for x in (json.loads(r.value) for r in spark.read.text(f"{base}/out").where("value not like '%nothing%'").collect())}
    assert got[1]["anonymized_response"] == "write to [EMAIL] now" and got[1]["x"] == {"y": [1, None]} and got[1]["a.b"] == 2 and got[1]["meta"]["status"] == "success"
    assert got[None]["anonymized_response"] == "" and got[None]["z"] == 'é"' and got[None]["meta"]["status"] == "skipped"
    kept = json.loads(spark.read.text(f"{base}/out").where("value like '%nothing%'").first().value)
    assert kept["anonymized_response"] == 'nothing to "hide" here' and kept["n"] is None
    assert json.loads(spark.read.text(f"{base}/odd").first().value)["n_chars"] == 3
    logged = (tmp_path / "log.txt").read_text()
    assert "loaded 3 texts" in logged and "success: 1 records" in logged and "example.com" not in logged and logs.LOGGER.level == logging.INFO
    summary = json.loads(run.assess(spark, f"{base}/out", f"{base}/details", MULTI, models.ScriptedBackend(catalog.scripted_answer), models.ScriptedBackend(catalog.scripted_answer)))
    assert summary["total_records"] == 3
    run.teach(spark, f"{base}/in.jsonl", f"{base}/taught", models.RuleBackend())
    assert sorted(json.loads(r.value)["anonymized_response"] for r in spark.read.text(f"{base}/taught").collect()) == ['nothing to "hide" here', "write to [EMAIL] now"]
    logs.setup()


def test_python_gets_few_bytes_of_long_prompts_at_a_time(spark):
    rows = spark.range(0, 300, 1, 1).select(F.col("id").alias("record_id"), F.repeat(F.lit("x"), 50_000).alias("response"))

    class Sizes:
        def generate(self, requests):
            return [str(sum(len(m["content"]) for r in requests for m in r.messages))] * len(requests)

    got = models.answered(rows, Sizes(), "attacker", 0, 0.1, prompts.attack_prompt(MULTI, F.col("response")), "answer", write=False)
    assert 0 < max(int(r.answer) for r in got.select("answer").collect()) < 6_000_000
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()  # other columns stay in the JVM


def test_empty_attribute_list_makes_no_prompt(spark):
    row = spark.range(1).select(prompts.arbitrate_prompt(MULTI, F.lit("t"), F.array().cast("array<string>"), F.lit("i")).alias("p")).first()
    assert row.p is None


def test_private_text_stays_out_of_logs(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"record_id": 1, "response": "my secret 10.1.2.3 address"}\n', encoding="utf-8")
    logs.setup("DEBUG", str(tmp_path / "log.txt"))
    run.anonymize(spark, f"file://{tmp_path}/in.jsonl", f"file://{tmp_path}/out", catalog.PATTERNS, loops.bind_roles(models.RuleBackend()))
    logs.setup()
    logged = (tmp_path / "log.txt").read_text()
    assert "loaded 1 texts of 26 characters" in logged and "10.1.2.3" not in logged and "secret" not in logged
