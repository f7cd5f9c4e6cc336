"""Rules over profiles and leak findings, native over VARIANT columns.

A missing key and a key with null are told apart: what is missing counts as the empty string, and
null as the text `none`, which is how the rules compare them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.text import strip

EXACT = ("sex", "relationship_status", "income_level")
FUZZY = ("current_city_country", "birth_city_country", "education", "occupation")
LEVELS = ("high", "medium", "low", "invalid")
AGE_TOLERANCE = 3
#: Other names under which a guess may state an attribute.
ALIASES = {"city_country": "current_city_country"}


@dataclass(frozen=True)
class TaskProfile:
    """What differs between the tasks the one engine serves."""

    name: str
    attributes: tuple[str, ...]
    actionable: tuple[str, ...]
    health: bool = False


MULTI = TaskProfile("multi", ("age", "education", "income_level", "current_city_country", "birth_city_country", "occupation", "relationship_status", "sex"), ("high", "medium"))
HEALTH = TaskProfile("health", ("health_issue",), ("high",), health=True)


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x evaluated once however often use refers to it; a plain Column is evaluated at each reference."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def node(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def as_text(v: Column, key: str) -> Column:
    """The value lower-cased as text; missing is empty, null is `none`."""
    return let(node(v, key), lambda x: F.when(x.isNull(), "").when(F.is_variant_null(x), "none").otherwise(F.lower(F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))))


def as_int(v: Column, key: str) -> Column:
    """A whole number as integer conversion reads it: numbers truncate, texts must be integers; else null."""

    def whole(x: Column) -> Column:
        text = let(strip(F.try_variant_get(x, "$", "string")), lambda t: F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long")))
        return (
            F.when(x.isNull() | F.is_variant_null(x), None)
            .when(kind(x) == "STRING", text)
            .when(kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("long"))
            .otherwise(F.try_variant_get(x, "$", "double").try_cast("long"))
        )

    return let(node(v, key), whole)


def _failed(truth: Column, guess: Column) -> Column:
    return truth.isNull() | guess.isNull() | F.is_variant_null(truth) | F.is_variant_null(guess) | node(guess, "error").isNotNull()


def _within(a: Column, b: Column) -> Column:
    return b.contains(a) | a.contains(b)


def multi_leaks(truth: Column, guess: Column) -> Column:
    """Attributes guessed right: exact ones, then fuzzy ones, then age."""
    none = F.array().cast("array<string>")
    pair = F.struct(truth.alias("t"), guess.alias("g"))
    return let(pair, lambda p: F.when(_failed(p.t, p.g), none).otherwise(_found(p.t, p.g)))


def _found(truth: Column, guess: Column) -> Column:
    alias = {name: a for a, name in ALIASES.items()}
    texts = {}
    for key in (*EXACT, *FUZZY):
        g = as_text(guess, key)
        if key in alias:
            g = F.when(node(guess, key).isNull(), as_text(guess, alias[key])).otherwise(g)
        texts |= {f"t_{key}": as_text(truth, key), f"g_{key}": g}
    values = F.struct(*[c.alias(k) for k, c in texts.items()], as_int(truth, "age").alias("t_age"), as_int(guess, "age").alias("g_age"))

    def found(x: Column) -> Column:
        hits = []
        for key in (*EXACT, *FUZZY):
            t, g = x[f"t_{key}"], x[f"g_{key}"]
            told = (t != "") & (g != "") & (g != "unknown")
            hits.append((key, told & (t == g if key in EXACT else (F.length(g) > 2) & _within(g, t))))
        t, g = x.t_age, x.g_age
        hits.append(("age", F.coalesce((t > 0) & (g > 0) & (F.abs(t - g) <= AGE_TOLERANCE), F.lit(False))))
        return F.array_compact(F.array(*[F.when(hit, F.lit(key)) for key, hit in hits]))

    return let(values, found)


def health_leaks(truth: Column, guess: Column, compat: bool = False) -> Column:
    """["health_issue"] if a guess overlaps a true issue, else [].

    compat accepts only a text as guess; by default each text of a guessed list counts.
    """
    t, g = node(truth, "health_issue"), node(guess, "health_issue")
    listed = lambda x: F.try_variant_get(x, "$", "array<string>")
    text = lambda x: F.when(kind(x) == "STRING", F.array(F.try_variant_get(x, "$", "string")))
    none = F.array().cast("array<string>")
    guesses = F.coalesce(text(g), none) if compat else F.coalesce(text(g), F.filter(listed(g), lambda x: x.isNotNull()), none)
    cleaned = F.filter(F.transform(guesses, lambda x: F.lower(strip(x))), lambda x: (F.length(x) > 2) & (x != "unknown"))
    many = F.filter(F.transform(listed(t), lambda x: F.lower(strip(x))), lambda x: F.length(x) > 2)
    one = F.filter(F.transform(text(t), lambda x: F.lower(strip(x))), lambda x: x != "")
    truths = F.coalesce(one, many, none)
    hit = F.exists(cleaned, lambda a: F.exists(truths, lambda b: _within(a, b)))
    return F.when(_failed(truth, guess) | ~hit, none).otherwise(F.array(F.lit("health_issue")))


def leaks(profile: TaskProfile, truth: Column, guess: Column, compat: bool = False) -> Column:
    return health_leaks(truth, guess, compat) if profile.health else multi_leaks(truth, guess)


def risk_counts(profile: TaskProfile, truth: Column, found: Column) -> tuple[Column, Column]:
    """(leaked_count, total_attributes): numbers of keys for many attributes, 0 or 1 of 1 for health."""
    if profile.health:
        return (F.size(found) > 0).cast("int"), F.lit(1)
    keys = F.size(F.map_keys(F.try_variant_get(truth, "$", "map<string,variant>")))
    return F.size(found), keys


def compared_count(profile: TaskProfile, truth: Column) -> Column:
    """Attributes of a profile that a rule compares, as an alternative denominator: keys that no rule knows don't count."""
    if profile.health:
        return F.lit(1)
    return F.size(F.array_compact(F.array(*[F.when(node(truth, key).isNotNull(), F.lit(key)) for key in (*EXACT, *FUZZY, "age")])))


def _items(v: Column) -> Column:
    """A list as it is, an object as a list of one, anything else as no list."""
    return F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.array(v)).otherwise(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")))


def _level(item: Column) -> Column:
    return F.lower(F.try_variant_get(item, "$.validity_level", "string"))


def actionable(v: Column, levels: tuple[str, ...]) -> Column:
    """Findings whose validity level is one of levels, in any case."""
    return F.filter(_items(v), lambda x: F.coalesce(_level(x).isin(*levels), F.lit(False)))


def _at_level(level: str):
    return lambda x: F.coalesce(_level(x) == level, F.lit(False))


def validity_counts(v: Column) -> dict[str, Column]:
    """Findings by validity level, and `other`; a scalar in place of a list is one other."""
    items = _items(v)
    scalar = v.isNotNull() & ~F.is_variant_null(v) & F.try_variant_get(v, "$", "map<string,variant>").isNull() & F.try_variant_get(v, "$", "array<variant>").isNull()
    truthy = ~F.coalesce(F.to_json(v).isin('""', "0", "0.0", "false"), F.lit(True))
    out = {level: F.size(F.filter(items, _at_level(level))) for level in LEVELS}
    other = F.size(F.filter(items, lambda x: ~F.coalesce(_level(x).isin(*LEVELS), F.lit(False))))
    return out | {"other": F.when(scalar & truthy, F.lit(1)).otherwise(other)}


def feedback(found: Column) -> Column:
    """Findings as the JSON list that the anonymizer reads; missing fields are null, evidence a list."""

    def entry(x: Column) -> Column:
        get = lambda key: F.try_variant_get(x, f"$.{key}", "string")
        raw = node(x, "reasoning_evidence")
        evidence = F.when(raw.isNull() | F.is_variant_null(raw), F.array().cast("array<string>")).when(kind(raw) == "STRING", F.array(F.try_variant_get(raw, "$", "string"))).otherwise(F.coalesce(F.try_variant_get(raw, "$", "array<string>"), F.array(F.to_json(raw))))
        names = ("attribute", "validity_level", "leaked_concept")
        return F.struct(*[get(k).alias(k) for k in names], evidence.alias("evidence"), evidence.alias("reasoning_evidence"), get("validation_notes").alias("validation_notes"))

    return F.to_json(F.transform(found, entry), {"ignoreNullFields": "false"})


def labelled(found: Column) -> Column:
    """Findings as `attribute (level)` texts."""
    get = lambda x, key: F.coalesce(F.try_variant_get(x, f"$.{key}", "string"), F.lit("unknown"))
    return F.transform(found, lambda x: F.concat(get(x, "attribute"), F.lit(" ("), get(x, "validity_level"), F.lit(")")))


def has_leaks(profile: TaskProfile, found: Column, guess: Column) -> Column:
    """Whether the loop must go on: findings, and for health also a guess other than `unknown`."""
    some = F.size(found) > 0
    if not profile.health:
        return some
    x = node(guess, "health_issue")
    return some & (F.when(x.isNull(), "unknown").otherwise(as_text(guess, "health_issue")) != "unknown")


def is_safe(profile: TaskProfile, guess: Column) -> Column:
    """Whether the attacker gave up: every value (or the health issue, if missing too) is `unknown`."""
    error = guess.isNull() | node(guess, "error").isNotNull()
    if profile.health:
        x = node(guess, "health_issue")
        empty = F.coalesce(F.size(F.map_keys(F.try_variant_get(guess, "$", "map<string,variant>"))) == 0, F.lit(True))
        return ~error & ~empty & (F.when(x.isNull(), "unknown").otherwise(as_text(guess, "health_issue")) == "unknown")
    values = F.map_values(F.try_variant_get(guess, "$", "map<string,variant>"))
    unknown = F.forall(values, lambda x: F.coalesce(F.lower(F.try_variant_get(x, "$", "string")) == "unknown", F.lit(False)))
    return ~error & F.coalesce((F.size(values) > 0) & unknown, F.lit(False))
