"""Rules, JSON extraction and text functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions import jsonx, metrics, rules, text
from veilframe.functions.rules import HEALTH, MULTI


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def v(json_text):
    return F.parse_json(F.lit(json_text))


@pytest.mark.parametrize(
    ("truth", "guess", "want"),
    [
        ('{"sex":"male"}', '{"sex":"MALE"}', ["sex"]),
        ('{"sex":"male"}', '{"sex":"unknown"}', []),
        ('{"sex":null}', '{"sex":null}', ["sex"]),
        ('{"sex":""}', '{"sex":""}', []),
        ('{"sex":"male"}', '{"sex":"male","error":"x"}', []),
        ('{"current_city_country":"paris, france"}', '{"current_city_country":"Paris"}', ["current_city_country"]),
        ('{"current_city_country":"paris, france"}', '{"current_city_country":"FR"}', []),
        ('{"education":"bsc physics"}', '{"education":["BSc physics"]}', ["education"]),
        ('{"age":35}', '{"age":38}', ["age"]),
        ('{"age":35}', '{"age":39}', []),
        ('{"age":35}', '{"age":" 38 "}', ["age"]),
        ('{"age":35}', '{"age":"38.0"}', []),
        ('{"age":35.7}', '{"age":32}', ["age"]),
        ('{"age":null}', '{"age":35}', []),
        ('{"age":30,"sex":"f","occupation":"nurse"}', '{"age":31,"sex":"F","occupation":"night nurse"}', ["sex", "occupation", "age"]),
        ("null", '{"sex":"male"}', []),
        ("{}", "{}", []),
    ],
)
def test_profile_comparison(spark, truth, guess, want):
    assert one(spark, x=rules.leaks(MULTI, v(truth), v(guess))).x == want


@pytest.mark.parametrize(
    ("truth", "guess", "compat", "flattened"),
    [
        ('{"health_issue":["Asthma","flu"]}', '{"health_issue":" asthma "}', 1, 1),
        ('{"health_issue":["asthma"]}', '{"health_issue":["asthma"]}', 0, 1),
        ('{"health_issue":"severe asthma"}', '{"health_issue":"asthma"}', 1, 1),
        ('{"health_issue":["asthma"]}', '{"health_issue":"unknown"}', 0, 0),
        ('{"health_issue":["as"]}', '{"health_issue":"asthma"}', 0, 0),
        ('{"health_issue":["asthma"]}', '{"health_issue":"as"}', 0, 0),
        ("{}", '{"health_issue":"asthma"}', 0, 0),
    ],
)
def test_health_comparison(spark, truth, guess, compat, flattened):
    row = one(spark, a=rules.health_leaks(v(truth), v(guess), True), b=rules.health_leaks(v(truth), v(guess)))
    assert (len(row.a), len(row.b)) == (compat, flattened)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('x {"a":1} y', {"a": 1}),
        ('[Comment] {"a":1}', {"a": 1}),
        ('[1] {"a":1}', [1]),
        ('{bad {"a":1}}', {"a": 1}),
        ('{"t":"}","s":{"score":3}}', {"score": 3}),
        ('{"a":1', None),
        ("", None),
        (None, None),
        ('```json\n{"a":[1,{"b":2}]}\n```', {"a": [1, {"b": 2}]}),
        ("no json", None),
        ('} ] {"a": NaN}', pytest.approx({"a": float("nan")}, nan_ok=True)),
    ],
)
def test_first_json(given, want):
    assert jsonx.first_json(given) == want


def test_first_json_aware_of_strings():
    assert jsonx.first_json('{"t":"}","s":{"score":3}}', string_aware=True) == {"t": "}", "s": {"score": 3}}


def test_attack_takes_the_first_guess(spark):
    row = one(spark, a=jsonx.attack(F.lit("Inference: I guess: x Guess: {}")), b=jsonx.attack(F.lit("[1]")), c=jsonx.attack(F.lit("")))
    assert (row.a.inference, row.a.guess_json) == ("I", "{}")
    assert "error" in row.b.guess_json and row.c.inference == ""


def test_text_functions(spark):
    lit = F.lit
    row = one(
        spark, short=text.sanity_error(lit(" 123456789012345678 "), lit("x")), stuck=text.sanity_error(lit(" the same text, long enough "), lit("the same text, long enough")),
        fine=text.sanity_error(lit("a changed text, long enough"), lit("the same text")), hash_=text.after_hash(lit("why\n#\nnew #tag")), none=text.after_hash(lit(" no separator ")),
        anchored=text.after_hash(lit("a #tag\n#\nnew"), True), cut=text.truncated(lit("abcdef"), 3), null_=text.truncated(lit(None).cast("string")), tag=text.context_tag(lit(3), lit(None)),
    )
    assert row.short.startswith("catastrophic") and "18" in row.short and row.stuck.startswith("anonymizer_stuck") and row.fine is None
    assert (row.hash_, row.none, row.anchored) == ("new #tag", "no separator", "new")
    assert (row.cut, row.null_, row.tag) == ("abc... [truncated, len=6]", "", "[record 3][iter ?]")


def test_findings(spark):
    many = v('[{"attribute":"age","validity_level":"High","reasoning_evidence":"w"},{"attribute":"sex","validity_level":"medium"},7,{"x":1}]')
    bare, scalar, empty = v('{"attribute":"age","validity_level":"low"}'), v("7"), v("[]")
    row = one(spark, a=F.size(rules.actionable(many, MULTI.actionable)), b=F.size(rules.actionable(many, HEALTH.actionable)), c=F.size(rules.actionable(bare, ("low",))), d=F.size(rules.actionable(scalar, MULTI.actionable)), e=rules.labelled(rules.actionable(many, MULTI.actionable)), f=rules.feedback(rules.actionable(many, MULTI.actionable)))
    assert (row.a, row.b, row.c, row.d, row.e) == (2, 1, 1, 0, ["age (High)", "sex (medium)"])
    assert '"evidence":["w"]' in row.f and '"evidence":[]' in row.f and '"validation_notes":null' in row.f
    for value, want in ((many, (1, 1, 0, 0, 2)), (bare, (0, 0, 1, 0, 0)), (scalar, (0, 0, 0, 0, 1)), (empty, (0, 0, 0, 0, 0)), (v("0"), (0, 0, 0, 0, 0))):
        assert tuple(one(spark, **rules.validity_counts(value))) == want


def test_loop_predicates(spark):
    found = rules.actionable(v('[{"validity_level":"high"}]'), HEALTH.actionable)
    cases = {"{}": (True, False, False, False), '{"health_issue":"Unknown"}': (True, False, True, True), '{"health_issue":null}': (True, True, False, False), '{"error":"x"}': (True, False, False, False), '{"a":"unknown","b":"UNKNOWN"}': (True, False, True, True)}
    for guess, want in cases.items():
        g = v(guess)
        assert tuple(one(spark, a=rules.has_leaks(MULTI, found, g), b=rules.has_leaks(HEALTH, found, g), c=rules.is_safe(MULTI, g), d=rules.is_safe(HEALTH, g))) == want, guess


def test_bleu_and_rouge_by_hand(spark):
    assert metrics.bleu("", "a b") == metrics.bleu("a b", None) == metrics.bleu("a b c", "x y z") == 0.0
    same = metrics.bleu("the cat sat on the mat today", "the cat sat on the mat today")
    assert metrics.bleu("the cat sat on the mat today", "the cat sat on a mat today") < same
    assert 0 < metrics.bleu("one", "one") and metrics.rouge_l("a b", "c d") == 0.0
    assert metrics.rouge_l("The cats sat", "the cat sat") == 1.0
    assert metrics.rouge_l("police killed the gunman", "police kill the gunman") == 1.0
    assert metrics.rouge_l("a b c d", "b x c d") == pytest.approx(0.75)
    assert [metrics.porter(w) for w in ("caresses", "ponies", "relational", "hopping", "happy", "agreed", "adjustment")] == ["caress", "poni", "relat", "hop", "happi", "agre", "adjust"]
    assert spark.createDataFrame([("a b", "a b"), (None, None)], "a string, b string").select(metrics.bleu_score("a", "b").alias("x")).collect()[1].x == 0.0


def test_lcs_by_dynamic_programming():
    import random

    rng = random.Random(0)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert metrics.lcs_length(a, b) == table[-1][-1]


def test_clipped_matches_shuffles_no_text_but_that_of_repeated_ids(spark):
    rows = [(1, "a b a b", "a b a b a b"), (2, "x", "y"), (3, None, "p q"), (4, "p q", None), (None, "a b", "a b"), (5, "a b c", "a b"), (5, "b c", "b c c"), (6, " a b", " a\tb ")]
    frame = spark.createDataFrame(rows, "record_id long, reference string, candidate string")
    got = sorted(map(tuple, metrics.clipped_matches(frame, 2).collect()), key=str)
    assert got == sorted([(1, 3, 5), (3, 0, 1), (None, 1, 1), (5, 2, 3), (6, 0, 1)], key=str)
    plan = metrics.clipped_matches(frame.where("record_id < 5"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_leaks_read_each_value_once(spark):
    """The plan stays small: a text parsed within the call is parsed once, not at every reference."""
    frame = spark.createDataFrame([('{"age": 30, "sex": "F"}', '{"age": " 32", "sex": "f", "city_country": "x"}')], "t string, g string")
    out = frame.select(rules.leaks(MULTI, F.parse_json("t"), F.parse_json("g")).alias("leaks"))
    assert out.first().leaks == ["sex", "age"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(t#") == 1 and plan.count("parseJson(g#") == 1
