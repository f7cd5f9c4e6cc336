"""Mixing sources to target weights by drawing fixed-length token blocks.

Each source's documents are packed end to end into blocks of BLOCK words. Output shards have a
fixed number of slots; how many slots of a shard each source gets is a multinomial draw from the
targets, seeded by the shard's number, and what the draws leave open or exceed is settled in a last
shard. The k-th slot of a source, counted over all shards, takes the block that a pseudorandom
permutation of the source's block indices gives for k (a new permutation for each pass over the
source). A source's last slots are cut short so that its words meet its target. Slots learn the bin of
their block by index, then meet the bin's documents, and each slot's block is cut from the texts
there: the mixture is a table of slots with their texts, and what it takes of each document is
counted from it.

Scale. Packing needs running sums only within bins of about BIN documents (fewer where they are
long), so a source with a third of all rows is as many bins as its size asks for; sums over a source's
bins go in two steps, by chunks of CHUNK. Copies of one row above the share that `hot_keys` names are
a count dealt to bins, not rows that meet. Sources are ranked, weighed and drawn by Spark, in groups of
GROUP, and may be any number. Texts are shuffled once, by bin, as no block crosses a bin; a bin is in
memory whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.llm.common import SPACE_WORD, hot_keys, utf8, written
from veilframe.sources.shared import new_path

BLOCK = 256
BIN = 256
#: Sources of long documents get more bins, of about so many words.
BIN_WORDS = 1 << 20
SLOTS = 65_536
WEIGHTS = (3, 1, 2)  # fixed value, repeating over the sources in order
RATIO = 1.5
MOST_REPEATS = 2.0
SEED = 20_240_229
#: Sources of one group in the draws, and bins of one chunk in the running sums.
GROUP = 4_096
CHUNK = 4_096


def ranked_sources(sized: DataFrame) -> DataFrame:
    """(sid, source, size, n): totals by source, numbered by code point with null last; `sized` has source, size, copies."""
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("n"))
    # A sort's partitions are ranges, so the rows before each partition give its first number.
    sorted_, _ = written(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    before, firsts = 0, []
    for row in sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        firsts.append((row.part, before))
        before += row.n
    offsets = F.broadcast(sized.sparkSession.createDataFrame(firsts, "part long, first long"))
    return sorted_.withColumn("part", part).join(offsets, "part").select((F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("sid"), "source", "size", "n")


def source_targets(sources: DataFrame, ratio: float = RATIO, most: float = MOST_REPEATS) -> DataFrame:
    """sources with weight and target: shares of ratio * sum(size) by weight, none above most * size; the excess is reshared.

    A target is the lesser of most * size and level * weight. The level is found by rounds of one
    aggregate over the sources: what the full ones leave, over the weights of the others; the full
    ones only grow in number. Sums are of integers, so reruns agree.
    """
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
    whole = weighed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    level, full = ratio * whole["size"] / max(1, whole["weight"]), -1
    while True:
        row = weighed.where(most * F.col("size") < level * F.col("weight")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.count(F.lit(1)).alias("n")).first()
        if row.n <= full or row["weight"] == whole["weight"]:
            break
        full = row.n
        level = (ratio * whole["size"] - most * row["size"]) / (whole["weight"] - row["weight"])
    return weighed.withColumn("target", F.least(most * F.col("size"), F.lit(float(level)) * F.col("weight")))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size) applied to index: a Feistel network, cycle-walked."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 2**63, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (high := out >= size).any():
        out[high] = once(out[high])
    return out.astype(np.int64)


class Mixture(NamedTuple):
    """The mix, one row a slot, its path in the shared folder, and the documents it draws on.

    slots: (shard, slot, source, text, n_words, parts, sid, bin, block); parts name the documents
    of the text in order, with the words it has of each. documents: (sid, bin, nth, doc_id, size,
    source_size, target); parts and documents meet on (sid, bin, nth).
    """

    slots: DataFrame
    path: str
    documents: DataFrame


MIXED = "shard long, slot long, source string, text string, n_words long, parts array<struct<nth:int,doc_id:bigint,words:bigint>>, sid long, bin long, block long"
PARTS = pa.list_(pa.struct([("nth", pa.int32()), ("doc_id", pa.int64()), ("words", pa.int64())]))
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Between the pieces of different documents in a slot's text.
SEPARATOR = b"\n\n"


def _bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes."""
    edges = np.flatnonzero(np.diff(_SPACE[np.frombuffer(text, np.uint8)].astype(np.int8), prepend=1, append=1))
    return edges[::2], edges[1::2]


def _cut(docs: pa.Table, slots: pa.Table, block: int) -> pa.Table:
    """The slots of one bin, with the text of their blocks, up to each slot's limit, cut from the bin's documents."""
    order = pc.sort_indices(docs, [("doc_id", "ascending"), ("h", "ascending"), ("size", "ascending")], null_placement="at_start").to_pylist() if slots.num_rows else []
    ids, texts, copies = docs["doc_id"].to_pylist(), utf8(docs["text"]), docs["copies"].to_pylist()
    pieces: dict[int, list] = {b: [] for b in slots["b"].to_pylist()}
    at, nth = 0, 0
    for row in order:
        starts, ends = _bounds(texts[row] or b"")
        for _ in range(copies[row]):
            nth += 1
            for b in range(at // block, -(-(at + len(starts)) // block)):
                low, high = max(b * block - at, 0), min((b + 1) * block - at, len(starts))
                if b in pieces and high > low:
                    pieces[b].append((nth, row, low, high, starts, ends))
            at += len(starts)
    parts, mixed = [], []
    for b, limit in zip(slots["b"].to_pylist(), slots["limit"].to_pylist(), strict=True):
        own, cut, left = [], [], limit
        for nth, row, low, high, starts, ends in pieces[b]:
            high = min(high, low + left)
            if high > low:
                own.append({"nth": nth, "doc_id": ids[row], "words": high - low})
                cut.append(texts[row][starts[low] : ends[high - 1]])
                left -= high - low
        parts.append(own), mixed.append(SEPARATOR.join(cut))
    columns = {
        "shard": slots["shard"], "slot": slots["slot"],
        "source": pa.array([docs["source"][0].as_py()] * len(mixed) if mixed else [], pa.string()),
        "text": pa.array(mixed, pa.binary()).view(pa.string()),
        "n_words": pa.array([sum(p["words"] for p in x) for x in parts], pa.int64()),
        "parts": pa.array(parts, PARTS),
        "sid": slots["sid"], "bin": slots["bin"], "block": slots["block"],
    }
    return pa.table(columns)


def _slots(draws: DataFrame, seed: int) -> DataFrame:
    """(shard, sid, k0, take, n_blocks) to one row a slot: (shard, slot, sid, k, block); a shard's sources are shuffled."""
    shard = W.partitionBy("shard")
    before = F.sum("take").over(shard.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)) - F.col("take")
    draws = draws.select("*", before.alias("before"), F.sum("take").over(shard).alias("whole"))

    def run(batches):
        for batch in batches:
            for shard, sid, first, take, size, before, whole in zip(*(batch[c] for c in ("shard", "sid", "k0", "take", "n_blocks", "before", "whole")), strict=True):
                for low in range(first, first + take, SLOTS):
                    k = np.arange(low, min(low + SLOTS, first + take))
                    out = np.empty(len(k), np.int64)
                    for turn in range(int(k[0] // size), int(k[-1] // size) + 1):
                        mine = k // size == turn
                        out[mine] = permuted(k[mine] % size, size, seed * 1_000_003 + sid * 1009 + turn)
                    slot = permuted(k - first + before, int(whole), (seed + 1) * 1_000_003 + int(shard))
                    yield pd.DataFrame({"shard": shard, "slot": slot, "sid": sid, "k": k, "block": out})

    return draws.repartition("shard", "sid").mapInPandas(run, "shard long, slot long, sid long, k long, block long")


def mixed_slots(plan: DataFrame, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """The draws of the mix, one row a slot: (shard, slot, sid, k, block), from (sid, n_blocks, n_slots).

    A shard's counts are multinomial over all sources: first over groups of sources, then over the
    sources of each group that drew any. What a source drew beyond its slots is dropped, and what it
    lacks is a last shard's.
    """
    spark = plan.sparkSession
    wanted, _ = written(plan.where("n_slots > 0").withColumn("grp", F.floor(F.col("sid") / GROUP)), "wanted")
    groups = wanted.groupBy("grp").agg(F.sum("n_slots").alias("n")).orderBy("grp").collect()
    total = sum(r.n for r in groups)
    if not total:
        return spark.createDataFrame([], "shard long, slot long, sid long, k long, block long")
    names, share = [r.grp for r in groups], np.array([r.n for r in groups]) / total
    n_shards = -(-total // slots)

    def draw_groups(batches):
        for batch in batches:
            for shard in batch["id"]:
                n = np.random.default_rng([seed, shard]).multinomial(min(slots, total - shard * slots), share)
                drawn = np.flatnonzero(n)
                yield pd.DataFrame({"shard": shard, "grp": np.array(names)[drawn], "n": n[drawn]})

    def draw_sources(batches):
        for batch in batches:
            for shard, grp, n, members in zip(batch["shard"], batch["grp"], batch["n"], batch["members"], strict=True):
                members = sorted((m["sid"], m["n_slots"]) for m in members)
                weight = np.array([w for _, w in members], float)
                got = np.random.default_rng([seed, shard, grp + 1]).multinomial(n, weight / weight.sum())
                drawn = np.flatnonzero(got)
                yield pd.DataFrame({"shard": shard, "sid": np.array([i for i, _ in members])[drawn], "n": got[drawn]})

    members = wanted.groupBy("grp").agg(F.collect_list(F.struct("sid", "n_slots")).alias("members"))  # at most GROUP a row
    draws = spark.range(n_shards).mapInPandas(draw_groups, "shard long, grp long, n long").join(members, "grp").mapInPandas(draw_sources, "shard long, sid long, n long")
    draws, _ = written(draws, "draws")
    run = W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    counted = draws.join(wanted, "sid").withColumn("k0", F.sum("n").over(run) - F.col("n"))
    kept = counted.select("shard", "sid", "k0", F.least("n", F.col("n_slots") - F.col("k0")).alias("take"), "n_blocks")
    drawn = draws.groupBy("sid").agg(F.sum("n").alias("k0"))
    open_ = wanted.join(drawn, "sid", "left").select(F.lit(n_shards).cast("long").alias("shard"), "sid", F.coalesce("k0", F.lit(0)).alias("k0"), (F.col("n_slots") - F.coalesce("k0", F.lit(0))).alias("take"), "n_blocks")
    return _slots(kept.unionByName(open_).where("take > 0"), seed)


def _numbered(bins: DataFrame) -> DataFrame:
    """(sid, bin, blocks, words) with `first`, the source's blocks in the bins before; summed by chunks."""
    bins = bins.withColumn("chunk", F.floor(F.col("bin") / CHUNK))
    chunks = bins.groupBy("sid", "chunk").agg(F.sum("blocks").alias("n"))
    chunks = chunks.select("sid", "chunk", (F.sum("n").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    own = F.sum("blocks").over(W.partitionBy("sid", "chunk").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("blocks")
    return bins.withColumn("own", own).join(chunks, ["sid", "chunk"]).select("sid", "bin", "blocks", "words", (F.col("base") + F.col("own")).alias("first"))


def _settled(drawn: DataFrame, sources: DataFrame) -> DataFrame:
    """drawn slots with `limit`: what each takes of its block's words, so that a source's sum meets its target.

    What a source has too much is taken from its last slots, as many as hold it: slots are drawn with
    a margin of about their number's square root, and the window looks at a few times as many.
    """
    sums = drawn.groupBy("sid").agg(F.sum("words").alias("drawn"))
    excess = sources.join(sums, "sid").select("sid", "n_slots", F.greatest(F.lit(0), F.col("drawn") - F.round("target").cast("long")).alias("excess"))
    # One row a source: broadcast by the planner's own measure of size, or by a shuffle.
    known = drawn.join(excess, "sid").withColumn("last", F.col("k") >= F.col("n_slots") - 64 - 6 * F.ceil(F.sqrt("n_slots")))
    behind = F.sum("words").over(W.partitionBy("sid").orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)) - F.col("words")
    cut = known.where("last").withColumn("limit", F.col("words") - F.greatest(F.lit(0), F.least("words", F.col("excess") - behind)))
    return known.where("not last").withColumn("limit", F.col("words")).unionByName(cut).where("limit > 0").drop("excess", "n_slots", "last")


def mixture(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, bin_docs: int = BIN) -> Mixture:
    """The mix of docs (doc_id, text, source), written to the shared folder with its texts.

    Sizes are runs of non-space characters (null text: 0). Sources weigh 3, 1, 2, repeating, by
    code point with null last, and share 1.5 times all sizes; a target stops at twice its source's
    size and the excess is reshared. Reruns agree, as every draw is seeded. A block is taken at
    most twice. White space within a document's piece is kept. Texts of any length, repeated rows, null
    ids and other columns are handled like others; an empty table gives an empty mixture.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text.alias("text"), size.alias("size"), F.xxhash64("doc_id", "source", text).alias("h"))
    rows, _ = written(docs.drop("text"), "sizes")
    hot, _ = written(hot_keys(rows, "h", rows.count()), "copies")
    crowded = F.broadcast(hot)

    def dealt(frame: DataFrame, *columns: str) -> DataFrame:
        """Rows with copies: those of hot h as a count for each part, others as they are, with part and copies 0 and 1."""
        known = frame.join(crowded, "h", "left")
        lone = known.where("parts is null").select("h", *columns, F.lit(0).alias("part"), F.lit(1).cast("long").alias("copies"))
        many = known.where("parts is not null").groupBy("h").agg(*[F.first(c).alias(c) for c in columns], F.max("parts").alias("parts"), F.count(F.lit(1)).alias("n"))
        part = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        share = F.floor(F.col("n") / F.col("parts")) + F.when(F.col("part") < F.col("n") % F.col("parts"), 1).otherwise(0)
        return lone.unionByName(part.select("h", *columns, "part", share.cast("long").alias("copies")))

    sized, _ = written(dealt(rows, "doc_id", "source", "size"), "units")
    named, _ = written(source_targets(ranked_sources(sized)), "targets")
    named = named.withColumn("n_bins", F.greatest(F.ceil(F.col("n") / bin_docs), F.ceil(F.col("size") / BIN_WORDS)))

    def binned(frame: DataFrame) -> DataFrame:
        sources = named.select("sid", F.col("source").alias("src"), F.col("size").alias("source_size"), "target", "n_bins")
        bin = F.pmod(F.when(F.col("part") == 0, F.col("h")).otherwise(F.xxhash64("h", "part")), "n_bins")
        return frame.join(sources, frame.source.eqNullSafe(sources.src)).withColumn("bin", bin)

    bins = binned(sized).groupBy("sid", "bin").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    bins, _ = written(_numbered(bins.withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))), "bins")
    blocks = bins.groupBy("sid").agg(F.sum("blocks").alias("n_blocks"))
    # A few more slots than the target asks for, as some blocks are short; the last ones are cut.
    asked = F.ceil(F.col("target") * F.col("n_blocks") / F.greatest("size", F.lit(1)))
    n_slots = F.least(F.lit(2) * F.col("n_blocks"), asked + F.ceil(F.sqrt(asked)) + 1).cast("long")
    plan, _ = written(named.join(blocks, "sid").withColumn("n_slots", F.when(F.col("size") > 0, n_slots).otherwise(0)), "plan")

    placed = bins.where("blocks > 0").select("sid", "bin", "words", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    placed = placed.select("sid", "bin", "b", (F.col("first") + F.col("b")).alias("block"), F.least(F.lit(block).cast("long"), F.col("words") - F.col("b") * block).alias("words"))
    # The planner can't see how many slots a draw stands for and would broadcast them; they grow with the input.
    drawn, _ = written(mixed_slots(plan.select("sid", "n_blocks", "n_slots"), slots, seed).hint("merge").join(placed, ["sid", "block"]), "slots")
    drawn = _settled(drawn, plan.select("sid", "n_slots", "target"))
    texts = binned(dealt(docs, "doc_id", "source", "size", "text")).select("sid", "bin", "source", "doc_id", "h", "size", "copies", "text")
    mixed = texts.groupBy("sid", "bin").cogroup(drawn.groupBy("sid", "bin")).applyInArrow(lambda d, s: _cut(d, s, block), MIXED)
    path = new_path(spark, "mixture")
    mixed.write.option("compression", "zstd").parquet(path)

    upto = F.sum("copies").over(W.partitionBy("sid", "bin").orderBy("doc_id", "h", "size").rowsBetween(W.unboundedPreceding, 0))
    numbered = binned(sized).withColumn("upto", upto).withColumn("nth", F.explode(F.sequence((F.col("upto") - F.col("copies") + 1).cast("int"), F.col("upto").cast("int"))))
    documents = numbered.select("sid", "bin", "nth", "doc_id", "size", "source_size", "target")
    return Mixture(spark.read.schema(mixed.schema).parquet(path), path, documents)


def mix(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, bin_docs: int = BIN) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs, counted from its mixture().

    A block is taken at most twice, so no document exceeds twice its size. Null ids and repeated
    rows are documents like others; empty sources and tables give zeros or no rows. The mixture
    itself stays in the shared folder, as mixture-*.
    """
    mixed = mixture(docs, block, slots, seed, bin_docs)
    parts = mixed.slots.select("sid", "bin", F.explode("parts").alias("part"))
    taken = parts.groupBy("sid", "bin", F.col("part.nth").alias("nth")).agg(F.sum("part.words").alias("taken"))
    return mixed.documents.join(taken.hint("merge"), ["sid", "bin", "nth"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
