"""Prompts of all roles as Column expressions: arrays of (role, content) messages. Own wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.rules import TaskProfile

HINTS = {
    "age": "a whole number", "sex": "male or female", "relationship_status": "single, in a relationship, engaged, married, divorced or widowed",
    "income_level": "low, middle, high or very high", "health_issue": "a list of short phrases",
}
ANONYMIZER = "You edit comments so that private facts about their author can't be inferred. Change as little as you can. First one line that explains the edit, then a line with only #, then the edited comment."
JUDGE = 'Compare an edited comment with its original. Answer with one JSON object that has "readability" and "meaning" (1 to 10) and "hallucinations" (1 if nothing new was added, else 0), each an object with "explanation" and "score".'
TEACHER = "Rewrite the comment so that its author can't be profiled, and keep its sense. Answer with the rewritten comment alone."


def attacker_system(profile: TaskProfile, allow_unknown: bool = False) -> str:
    keys = ", ".join(f'"{a}" ({HINTS.get(a, "short text")})' for a in profile.attributes)
    unknown = ' Where nothing can be inferred the value must be "unknown".' if allow_unknown else ""
    return f"Infer facts about the author of a comment. Write Inference: and your reasoning, then Guess: and one JSON object with the keys {keys}.{unknown}"


def arbitrator_system(profile: TaskProfile) -> str:
    return (
        f"Check guesses about {', '.join(profile.attributes)} against the comment they were drawn from. Answer with one JSON list; for each guess an object with attribute, "
        "validity_level (high, medium, low or invalid), reasoning_evidence (the words it rests on), leaked_concept and validation_notes."
    )


def messages(system: str, user: Column) -> Column:
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(one("system", F.lit(system)), one("user", user))


def _slots(**parts: Column) -> Column:
    pieces: list[Column] = []
    for title, value in parts.items():
        pieces += [F.lit(("\n\n" if pieces else "") + title.capitalize().replace("_", " ") + ":\n"), F.coalesce(value, F.lit(""))]
    return F.concat(*pieces)


def attack_prompt(profile: TaskProfile, text: Column, allow_unknown: bool = False) -> Column:
    return messages(attacker_system(profile, allow_unknown), _slots(comment=text))


def arbitrate_prompt(profile: TaskProfile, text: Column, attributes: Column, inference: Column) -> Column:
    """Null where the attribute list is empty: then no call is due, and the answer is the empty list."""
    return F.when(F.size(attributes) > 0, messages(arbitrator_system(profile), _slots(comment=text, attributes=F.to_json(attributes), inference=inference)))


def anonymize_prompt(text: Column, notes: Column) -> Column:
    return messages(ANONYMIZER, _slots(comment=text, feedback=notes))


def judge_prompt(original: Column, edited: Column) -> Column:
    return messages(JUDGE, _slots(original=original, edited=edited))


def teacher_prompt(text: Column, context: Column, tag: Column | None = None) -> Column:
    """With the record's context line, or with a log tag in its place (tag), as compatibility asks for."""
    return messages(TEACHER, _slots(context=tag if tag is not None else context, comment=text))


def training_text(original: Column, rewritten: Column, context: Column) -> Column:
    line = F.when(F.coalesce(F.length(context), F.lit(0)) > 0, F.concat(F.lit("Context: "), context, F.lit("\n"))).otherwise("")
    return F.concat(line, F.lit("Comment: "), original, F.lit("\nRewritten: "), rewritten)


def rendered(chat: Column) -> Column:
    """An array of messages as one text, for fixtures; models use their own templates."""
    return F.array_join(F.transform(chat, lambda m: F.concat(F.lit("<"), m.role, F.lit(">"), m.content)), "\n")
