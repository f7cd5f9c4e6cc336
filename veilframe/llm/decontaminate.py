"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. Patterns of one length form a class with the
three tables of Wu and Manber (1994), whose symbols are words here: a shift table over blocks of
two words says how far the search may jump without missing a window, buckets by the last block
(then by the first) hold the windows to test where the jump is zero, and a direct comparison
confirms. Over windows of ten words most positions of a document are never looked at.

The benchmark's size is checked. Up to TABLE_BYTES its tables go to every worker, and the documents are
scanned where they lie, without a shuffle. Beyond that the driver never holds it: the shift table is
Wu and Manber's own form, an array over hashed blocks, and so is the table of pairs of first and last
block; both are of a fixed size whatever the benchmark's (a fuller table only passes more positions).
One scan of the documents yields the positions that both let through, and an equi-join of their words
with the windows is the direct comparison. Results meet their documents by salted joins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import attached, mapped, row_key, small_batches, utf8, written

WINDOW = 10
#: Benchmark text whose tables go to every worker, which holds about 50 times this in memory.
TABLE_BYTES = 4 << 20
#: Entries of the hashed tables beyond that: bytes of shifts for each window length, bits of pairs for all.
SHIFTS, PAIRS = 1 << 22, 1 << 27
RAW_WORD = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]++"
_WORDS = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z and non-ASCII characters of UTF-8 text, after lower-casing A-Z."""
    return text.translate(_WORDS).split() if text else []


class Patterns:
    """Search tables for windows of benchmark items."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> None:
        found: dict[int, dict[tuple, set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if words else 0):
                found.setdefault(size, {}).setdefault(tuple(words[at : at + size]), set()).add(item)
        self.classes = [self._tables(size, windows) for size, windows in sorted(found.items())]

    @staticmethod
    def _tables(size: int, windows: dict[tuple, set[str]]) -> tuple:
        block = min(2, size)
        shift: dict[tuple, int] = {}
        buckets: dict[tuple, dict[tuple, list]] = {}
        for words, items in windows.items():
            for end in range(block, size + 1):
                key = words[end - block : end]
                shift[key] = min(shift.get(key, size), size - end)
            buckets.setdefault(words[-block:], {}).setdefault(words[:block], []).append((words, items))
        return size, block, shift, buckets

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Half-open word intervals of all occurrences, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        total = len(words)
        for size, block, shift, buckets in self.classes:
            jump, look, end = size - block + 1, shift.get, size
            while end <= total:
                key = tuple(words[end - block : end])
                step = look(key, jump)
                if step:
                    end += step
                    continue
                start = end - size
                for window, owners in buckets[key].get(tuple(words[start : start + block]), ()):
                    if tuple(words[start:end]) == window:
                        spans.append((start, end))
                        items |= owners
                end += 1
        return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside at least one interval."""
    total = reach = 0
    for start, end in sorted(spans):
        if end > reach:
            total += end - max(start, reach)
            reach = end
    return total


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) of benchmark rows with both, as strings and UTF-8."""
    return benchmark.select(F.col("item_id").cast("string"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).where("item_id is not null and text is not null")


def _small(items: DataFrame, table_bytes: int) -> tuple | None:
    """The items as (name, broadcast list), if their texts and ids have at most table_bytes."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0]
    if total > table_bytes:
        return None
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(sorted({(r[0], bytes(r[1])) for r in items.collect()}))


_built: dict[tuple, Patterns] = {}


def _patterns(known: tuple, window: int) -> Patterns:
    """The tables, built once per worker process."""
    name, items = known
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = Patterns(items.value, window)
    return _built[name, window]


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words): distinct windows of the items, their words space-joined, of any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                found = sorted({b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}) if words else []
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], names=["item_id", "words"])

    return items.mapInArrow(run, "item_id string, words binary").distinct()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _block_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block that ends at each word from the block's length on: two words, or one in one-word windows."""
    mixed = hashes if size < 2 else (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[1:]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _pair(first: np.ndarray, last: np.ndarray, size: int, pairs: int) -> np.ndarray:
    mixed = (first * np.uint64(0x94D049BB133111EB) + np.uint64(size)) ^ last
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(20)) % np.uint64(pairs)).astype(np.int64)


def hashed_tables(windows: DataFrame, shifts: int, pairs: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Shift tables by window length, and the bits of pairs of first and last block; both of fixed size.

    The least shift of each entry, and which pairs there are, are aggregated by Spark; at most `shifts`
    rows a window length, and `pairs` / 8 rows, reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for joined in batch.column("words").to_pylist():
                words = joined.split(b" ")
                size, block = len(words), min(2, len(words))
                hashes = _block_hashes(_word_hashes(words), size)
                slots = (hashes % np.uint64(shifts)).tolist()
                out += [(size, slot, size - block - i) for i, slot in enumerate(slots)]
                bit = int(_pair(hashes[:1], hashes[-1:], size, pairs)[0])
                out.append((0, bit >> 3, 1 << (bit & 7)))
            table, slot, value = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), pa.array(slot, pa.int64()), pa.array(value, pa.int32())], names=["size", "slot", "value"])

    rows = windows.select("words").distinct().mapInArrow(run, "size int, slot long, value int")
    least = rows.groupBy("size", "slot").agg(F.min("value").alias("least"), F.bit_or("value").alias("bits"))
    got = least.select("size", "slot", F.when(F.col("size") == 0, F.col("bits")).otherwise(F.col("least")).cast("int").alias("value")).toArrow()
    size, slot, value = (got.column(c).to_numpy() for c in ("size", "slot", "value"))
    bits = np.zeros(pairs // 8, np.uint8)
    bits[slot[size == 0]] = value[size == 0]
    tables = {}
    for s in sorted(set(size.tolist()) - {0}):
        tables[s] = np.full(shifts, s - min(2, s) + 1, np.uint8)
        tables[s][slot[size == s]] = value[size == s]
    return tables, bits


def candidates(words: list[bytes], tables: dict[int, np.ndarray], bits: np.ndarray) -> list[tuple[int, int]]:
    """(start, size) of the positions that the hashed tables don't rule out."""
    out = []
    hashes = _word_hashes(words)
    for size, table in tables.items():
        if len(words) < size:
            continue
        blocks = _block_hashes(hashes, size)
        steps = table[blocks % np.uint64(len(table))].tolist()
        reach, end, last = size - min(2, size), size - min(2, size), len(steps)
        zero = []
        while end < last:
            step = steps[end]
            if step:
                end += step
            else:
                zero.append(end)
                end += 1
        if zero:
            at = np.array(zero)
            pair = _pair(blocks[at - reach], blocks[at], size, 8 * len(bits))
            out += [(int(a) - reach, size) for a in at[(bits[pair >> 3] >> (pair & 7)) & 1 == 1]]
    return out


def _met(rows: DataFrame, items: DataFrame, window: int, shifts: int, pairs: int) -> DataFrame:
    """(key, n_hit, items) of documents in which windows occur; rows are (key, text)."""
    windows, _ = written(_windows(items, window), "windows")
    shared = rows.sparkSession.sparkContext.broadcast(hashed_tables(windows, shifts, pairs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, bits = shared.value
            keys, starts, sizes, texts = [], [], [], []
            for key, text in zip(batch.column("key").to_pylist(), utf8(batch.column("text")), strict=True):
                words = words_of(text)
                for start, size in candidates(words, tables, bits):
                    keys.append(key), starts.append(start), sizes.append(size), texts.append(b" ".join(words[start : start + size]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary())], names=["key", "start", "size", "words"])

    seen = small_batches(rows).mapInArrow(scan, "key string, start int, size int, words binary").distinct()
    known = windows.select("words").distinct()
    hits, _ = written(attached(seen, known, "words"), "hits")
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    reach = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, x: F.struct((s.n + F.greatest(x.end - F.greatest(x.start, s.to), F.lit(0))).alias("n"), F.greatest(s.to, x.end).alias("to")), lambda s: s.n.cast("long"))
    # A window's items are dealt out by salts on its documents' side.
    salted = hits.select("key", "words").distinct().withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(OWNER_SALTS)))
    owners = windows.join(salted.select("words", "salt").distinct(), "words")
    named = salted.hint("merge").join(owners, ["words", "salt"]).select("key", "item_id").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return spans.select("key", reach.alias("n_hit")).join(named, "key")


OWNER_SALTS = 64


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_bytes: int = TABLE_BYTES, shifts: int = SHIFTS, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) for every row of docs.

    docs needs doc_id and text, benchmark item_id and text. A window is `window` consecutive words
    of an item; a shorter item is one window. A document word inside any occurrence of a window is
    hit. Null and empty texts have no words; texts of any length are read whole. Benchmark rows with
    null id or text, and items without words, match nothing; an empty benchmark leaves all clean. Rows
    of one item_id count as one item; repeated documents stay. Other columns are ignored, an empty
    table gives an empty result.
    """
    items = _items(benchmark)
    known = _small(items, table_bytes)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if known:

        def scan(batch: pa.RecordBatch) -> dict:
            patterns = _patterns(known, window)
            words = [words_of(t) for t in utf8(batch.column("text"))]
            found = [patterns.hits(w) for w in words]
            return {"doc_id": batch.column("doc_id"), "n_words": list(map(len, words)), "n_hit": [covered(s) for s, _ in found], "items": [sorted(x) for _, x in found]}

        done = mapped(rows, scan, "doc_id long, n_words long, n_hit long, items array<string>")
    else:
        keyed = rows.withColumn("key", row_key())
        met = _met(keyed.select("key", "text"), items, window, shifts, pairs)
        counted = keyed.select("doc_id", "key", F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("long").alias("n_words"))
        facts = counted.select("key").distinct().join(met, "key", "left")
        done = attached(counted, facts, "key").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return done.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_bytes: int = TABLE_BYTES, shifts: int = SHIFTS, pairs: int = PAIRS) -> DataFrame:
    """docs, with all columns, less the rows in which any benchmark window occurs.

    Rows without text or words stay, as do repeated rows, in any number; an empty benchmark or table
    changes nothing.
    """
    items = _items(benchmark)
    known = _small(items, table_bytes)
    if known:

        def keep(batches):
            for batch in batches:
                patterns = _patterns(known, window)
                yield batch.filter(pa.array([not patterns.hits(words_of(t))[0] for t in utf8(batch.column("text"))], pa.bool_()))

        return small_batches(docs).mapInArrow(keep, docs.schema)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("key", row_key())
    met = _met(rows.select("key", "text"), items, window, shifts, pairs).select("key", F.lit(True).alias("_met"))
    facts = rows.select("key").distinct().join(met, "key", "left").withColumnRenamed("key", "_key")
    keyed = docs.withColumn("_key", row_key())
    return attached(keyed, facts, "_key").where("_met is null").select(*docs.columns)
