"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TEXT = 20


def strip(col: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def is_blank(col: Column) -> Column:
    """Null or empty: what is skipped before any model call."""
    return F.coalesce(F.length(col), F.lit(0)) == 0


def is_evaluable(original: Column, rewritten: Column) -> Column:
    """Both texts present and non-empty, whatever the status says."""
    return ~is_blank(original) & ~is_blank(rewritten)


def after_hash(col: Column, anchored: bool = False) -> Column:
    """What follows the first '#', stripped; the whole text, stripped, without one.

    anchored looks for a line that is only '#', which leaves hashtags and headings alone.
    """
    parts = F.split(col, r"(?m)^[ \t]*#[ \t]*$" if anchored else "#", 2)
    return strip(F.coalesce(F.get(parts, F.lit(1)), col))


def truncated(col: Column, limit: int = 400) -> Column:
    """A prefix with a note of the full length; null gives the empty string."""
    note = F.concat(F.substring(col, 1, limit), F.lit("... [truncated, len="), F.length(col).cast("string"), F.lit("]"))
    return F.when(col.isNull(), "").when(F.length(col) > limit, note).otherwise(col)


def context_tag(record: Column, round_: Column) -> Column:
    unknown = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("[record "), unknown(record), F.lit("][iter "), unknown(round_), F.lit("]"))


def sanity_error(edited: Column, previous: Column, least: int = MIN_TEXT) -> Column:
    """Why an edit can't be right: far too short, or no change; null if neither."""
    text = strip(edited)
    short = F.concat(F.lit("catastrophic_deletion: length "), F.length(text).cast("string"))
    return F.when(F.length(text) < least, short).when(text == strip(previous), "anonymizer_stuck: text unchanged")


def inference_part(response: Column) -> Column:
    """The prose between `Inference:` and the first `Guess:` or the end, in any case, stripped."""
    return strip(F.regexp_extract(response, r"(?is)Inference:(.*?)(Guess:|$)", 1))
