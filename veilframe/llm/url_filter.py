"""URL filter by a temporal list: every capture is judged by the entries active when it was fetched.

The list is a log of dated changes. For each key, a change holds from its time until the next one,
so the log becomes non-overlapping validity intervals; a capture joins the interval of each of its
keys (host, parent domains, host with leading path parts) that holds its fetch time, and the most
specific key decides. DataFrame operations only.

Scale. The join is an equi-join on the key with the time as a further condition, so a capture
yields at most one row per key. A host with a third of all captures is a hot key: its captures are
dealt to parts, as many as its count asks for, and its few intervals go to each (`common.attached`).
Repeats of a capture are counted where they lie and judged once. A key with very many changes has
them ordered day by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.llm.common import attached

ACTIONS = ("block", "allow", "remove")


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, action, at) changes to (key, action, valid_from, valid_to) intervals, valid_to exclusive or null.

    Of changes to a key at one time, the last by action in the order block, allow, remove holds.
    Changes with null fields or unknown actions are out. A remove ends what held and leaves none.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    known = entries.select("key", "action", "at").where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(*ACTIONS))
    one = known.groupBy("key", "at").agg(F.max_by("action", rank).alias("action"))
    # The next change is one of the same day, or the first of the key's next day that has any.
    one = one.withColumn("day", F.date_trunc("day", "at"))
    days = one.groupBy("key", "day").agg(F.min("at").alias("first"))
    days = days.select("key", "day", F.lead("first").over(W.partitionBy("key").orderBy("day")).alias("later"))
    within = F.lead("at").over(W.partitionBy("key", "day").orderBy("at"))
    closed = one.withColumn("next", within).join(days, ["key", "day"])
    return closed.where("action <> 'remove'").select("key", "action", F.col("at").alias("valid_from"), F.coalesce("next", "later").alias("valid_to"))


def path_depth(entries: DataFrame) -> int:
    """The most path parts of any list key."""
    return max(0, entries.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0)


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port or closing dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def url_keys(url: Column, path_parts: int) -> Column:
    """Distinct list keys of a URL: its host, each parent domain of two or more labels, and host/path prefixes of up to path_parts parts."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    parents = F.when(
        F.size(labels) > 2,
        F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    ).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), "/"), lambda x: x != "")
    most = F.least(F.size(parts), F.lit(path_parts))
    paths = F.when(most > 0, F.transform(F.sequence(F.lit(1), most), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(host), parents, paths)))


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, verdict, rule, rule_since, n_active) for every capture.

    captures needs page_id, url and fetched_at; entries key, action and at. A key is a host, a parent
    domain, or a host with leading path parts of any number (`h.org/a/b`, without a closing slash; empty
    parts of a URL's path are passed over). The longest active key decides (ties by key); `none`
    without one, and for captures without a host or time, or with a null URL. Rows equal
    in id, url and time are one capture's repeats, and each is returned. Other columns are ignored;
    URLs of any length are read whole. Empty captures give an empty result, an empty list `none`.
    """
    capture = ["page_id", "url", "fetched_at"]
    rows = captures.select(*capture).withColumn("from_part", F.spark_partition_id()).groupBy(*capture, "from_part").agg(F.count(F.lit(1)).alias("copies")).drop("from_part")
    keyed = captures.select(*capture).where(F.col("fetched_at").isNotNull()).distinct().withColumn("key", F.explode(url_keys(F.col("url"), path_depth(entries))))
    active = attached(keyed, validity_intervals(entries), "key").where((F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    best = F.max(F.struct(F.length("key").alias("n"), F.col("key"), F.col("action"), F.col("valid_from")))
    decided = active.groupBy(*capture).agg(best.alias("best"), F.count(F.lit(1)).alias("n_active"))
    decided = decided.select(F.col("page_id").alias("d_id"), F.col("url").alias("d_url"), F.col("fetched_at").alias("d_at"), "best", "n_active")
    joined = rows.join(decided, rows.page_id.eqNullSafe(decided.d_id) & rows.url.eqNullSafe(decided.d_url) & (rows.fetched_at == decided.d_at), "left")
    judged = joined.select(
        "page_id", "url", "fetched_at", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.key").alias("rule"),
        F.col("best.valid_from").alias("rule_since"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    )
    return judged.drop("copy")
