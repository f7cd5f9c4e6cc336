"""SimHash near-duplicate groups with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in at
most four bits differ in at most two bits over some two of the three segments (pigeonhole), and a
segment pair within two bits shares a nearby Golay codeword (see golay). So each fingerprint gets,
for each pair of segments, the product of the two segments' nearby codeword indices as keys (84 on
average), equal keys meet, and exact comparison of all 64 bits confirms. Nothing is missed and
nothing unconfirmed links.

Scale. Only distinct fingerprints are keyed, so exact copies cost nothing beyond one aggregate. In
a shared key the confirmed links leave as stars around the least member (at most one row a member
and key, never all pairs); members already reached are not compared again. Keys that a sample
shows to be large are cut into parts and each pair of parts meets in a task of its own, so no task
holds an unbounded group; the sample decides only how work is dealt out, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import attached, mapped, row_key, utf8, written
from veilframe.llm.components import component_labels
from veilframe.llm.golay import nearby_indices

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of one key that one task compares; larger keys are cut into parts of this size.
PART = 20_000
#: One fingerprint in so many is looked at to find large keys.
SAMPLE = 64
#: The so many largest keys are broadcast (16 bytes each); further ones hold few members each and meet theirs by a shuffle.
BROADCAST_KEYS = 200_000
_LANE = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit SimHash fingerprints of UTF-8 texts; null and wordless texts give zero.

    Words are the runs between ASCII white space after lower-casing A-Z; shingles of `shingle`
    words (repeats counted; the whole sequence if shorter) are hashed by XXH64; a bit is set if
    it is set in over half of the hashes.
    """
    digest = xxhash.xxh64_intdigest
    hashes: list[np.ndarray] = [np.empty(0, np.uint64)]
    counts: list[int] = []
    for text in texts:
        words = text.lower().split() if text else []
        n = len(words) - shingle + 1
        if n > 1:
            ends = np.cumsum([len(w) + 1 for w in words])
            joined = b" ".join(words)
            starts = [0, *ends[: n - 1].tolist()]
            stops = (ends[shingle - 1 :] - 1).tolist()
            hashes.append(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n))
            counts.append(n)
        elif words:
            hashes.append(np.array([digest(b" ".join(words), SEED)], np.uint64))
            counts.append(1)
        else:
            counts.append(0)
    return _majority(np.concatenate(hashes), np.array(counts, np.int64))


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bitwise majority of each run of hashes, counted in eight byte-wide lanes at a time."""
    out = np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    pieces = -(-counts // 255)  # a lane counts to 255
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[owner] + nth * 255
    full = np.flatnonzero(counts)
    offsets = (np.cumsum(pieces) - pieces)[full]
    half = counts[full, None]
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANE, starts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), offsets, axis=0)
        out[full] |= (2 * ones > half).astype(np.uint8).view(np.uint64).ravel() << np.uint64(shift)
    return out


def fingerprint_table(docs: DataFrame, keys: bool = False) -> DataFrame:
    """(doc_id, fp), and the row's key if asked: fp is the fingerprint as a signed long. Input needs doc_id and text."""

    def run(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in batch.schema.names if c != "text"} | {"fp": pa.array(fingerprints_of(utf8(batch.column("text"))).view(np.int64))}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([row_key().alias("key")] if keys else []))
    return mapped(rows, run, "doc_id long, fp long" + ", key string" * keys)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owner): every key of each fingerprint; owner is the fingerprint's position."""
    sides = [nearby_indices((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)) for at, width in SEGMENTS]
    keys, owners = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, real_a), (b, real_b) = sides[i], sides[j]
        key = (np.int64(pair) << 24) | (a[:, :, None] << 12) | b[:, None, :]
        real = real_a[:, :, None] & real_b[:, None, :]
        keys.append(key[real])
        owners.append(np.nonzero(real)[0])
    return np.concatenate(keys), np.concatenate(owners)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        key, owner = golay_keys(fp.view(np.uint64))
        return {"key": pa.array(key), "fp": pa.array(fp[owner])}

    return mapped(fps.select("fp"), run, "key long, fp long")


def stars(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member reached) among fingerprints that one key brought together.

    A breadth-first search that never compares a member again once reached: near-linear where the
    members lie close together, and at most all pairs of the (bounded) part where they do not.
    """
    rest = np.unique(fps)
    out_u, out_v = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                out_u.append(found)
                out_v.append(np.full(len(found), root))
                queue.extend(found)
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *out_u]), np.concatenate([empty, *out_v])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links from rows sorted by (key, part); a key may span batches."""
    held: list[np.ndarray] = []  # fingerprints of the key that the last batch ended in
    held_key: tuple | None = None

    def emit(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "fp"))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        first = edge[0] if len(edge) else len(key)
        us, vs = [], []
        if held_key == (key[0], part[0]):
            held.append(fp[:first])
        else:
            if held_key is not None:
                a, b = stars(np.concatenate(held))
                us.append(a), vs.append(b)
            held, held_key = [fp[:first]], (key[0], part[0])
        if len(edge):
            a, b = stars(np.concatenate(held))
            us.append(a), vs.append(b)
            held, held_key = [fp[edge[-1] :]], (key[edge[-1]], part[edge[-1]])
            starts, stops = edge[:-1], edge[1:]
            sizes = stops - starts
            group = np.repeat(np.arange(len(sizes)), sizes)
            inner = fp[edge[0] : edge[-1]]
            small = np.repeat(sizes <= 4, sizes)
            for step in (1, 2, 3):
                if len(inner) > step:
                    hit = (group[step:] == group[:-step]) & small[step:]
                    a, b = inner[step:][hit], inner[:-step][hit]
                    near = np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS
                    us.append(np.maximum(a, b)[near]), vs.append(np.minimum(a, b)[near])
            for g in np.flatnonzero(sizes > 4):
                a, b = stars(fp[starts[g] : stops[g]])
                us.append(a), vs.append(b)
        if us and sum(map(len, us)):
            yield emit(us, vs)
    if held_key is not None:
        a, b = stars(np.concatenate(held))
        if len(a):
            yield emit([a], [b])


def fingerprint_links(fps: DataFrame, part: int = PART, sample: int = SAMPLE, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Distinct fingerprints (fp) to distinct links (u, v) whose closure joins all within MAX_BITS."""
    seen = fps.where(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0)
    large = _keyed(seen).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * sample > part)
    large, _ = written(large.select("key", F.ceil(F.col("n") * sample / part).cast("int").alias("parts")), "large-keys")
    n_large = large.count()
    keyed = _keyed(fps)
    if n_large:
        own = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.col("parts")).cast("int")
        meet = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, own) * F.col("parts") + F.greatest(x, own))
        )
        largest = large.orderBy(F.desc("parts"), "key").limit(broadcast_keys)
        keyed = keyed.join(F.broadcast(largest), "key", "left")
        if n_large > broadcast_keys:
            rest = large.join(largest, "key", "left_anti").withColumnRenamed("parts", "further")
            keyed = keyed.join(rest.hint("merge"), "key", "left").withColumn("parts", F.coalesce("parts", "further")).drop("further")
        keyed = keyed.select("key", F.explode(meet).alias("part"), "fp")
    else:
        keyed = keyed.withColumn("part", F.lit(0))
    dealt = keyed.select("key", F.col("part").cast("int"), "fp").repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_linked, "u long, v long").distinct()


def _groups(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) to one row per distinct fingerprint: (fp, component_id)."""
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels, _ = written(component_labels(fingerprint_links(firsts.select("fp"))), "labels")
    labelled = labels.join(firsts.withColumnRenamed("fp", "node"), "node")
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    linked = attached(labels, smallest, "label").select(F.col("node").alias("fp"), "component_id")
    return firsts.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs, which needs doc_id and text.

    Documents whose fingerprints differ in at most MAX_BITS bits are linked; component_id is the
    smallest doc_id reachable. Null, empty and wordless texts have fingerprint zero and are linked
    like any other. Rows with a null doc_id are grouped but never name a group (component_id is
    null only where a group has no id at all); repeated rows stay. Other columns are ignored. An
    empty table gives an empty result.
    """
    prints, _ = written(fingerprint_table(docs), "fingerprints")
    found = attached(prints, _groups(prints), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, with all columns, less all but one row of each near-duplicate group.

    The row of the smallest doc_id stays, rows without id coming last, and ties going by the text's
    hash; so a row goes only where one linked to it stays, however ids repeat. Of equal ids
    and texts one row stays, that of the least hash of all columns. Null, empty and wordless texts form a
    group (see near_duplicates). An empty table stays empty.
    """
    prints, _ = written(fingerprint_table(docs, keys=True), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("best")
    firsts = prints.groupBy("fp").agg(best)
    labels, _ = written(component_labels(fingerprint_links(firsts.select("fp"))), "labels")
    grouped = firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    chosen = grouped.groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("best").alias("best")).select(F.col("best.key").alias("_key")).distinct()
    copies = prints.groupBy(F.col("key").alias("_key")).agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    kept, _ = written(chosen.join(copies, "_key"), "kept")
    met = attached(docs.withColumn("_key", row_key()), kept, "_key")
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
    once = met.where("_repeated").groupBy("_key").agg(least).select("row.*")
    return met.where("not _repeated").select(*docs.columns).unionByName(once.select(*docs.columns))
