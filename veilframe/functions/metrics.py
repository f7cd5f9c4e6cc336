"""Text similarity: BLEU with smoothing method 7, and ROUGE-L, as Arrow-batched functions.

BLEU: sentence level over white-space tokens, orders 1 to 4, uniform weights, brevity penalty
(Papineni et al. 2002); smoothing 7 is method 4 followed by method 5 (Chen and Cherry 2014).
ROUGE-L: F-measure of the longest common subsequence (Lin 2004) over lower-cased alphanumeric ASCII
tokens; tokens of more than three letters are stemmed (Porter 1980). Clipped n-gram counts are also
given per record (clipped_matches).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from veilframe.sources.shared import small_batches, written

ORDERS = 4


def clipped(ref: list[str], hyp: list[str], orders: int) -> list[int]:
    """Clipped n-gram matches of orders 1 to `orders`; n-grams are numbered, not built."""
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(t, len(index)) for t in (*ref, *hyp)], np.int64)
    a, b = ids[: len(ref)], ids[len(ref) :]
    first, second, out = a, b, []
    for n in range(1, orders + 1):
        if n > 1:  # an n-gram is the (n-1)-gram before its last token, and that token
            first, second = first[:-1] * len(index) + a[n - 1 :], second[:-1] * len(index) + b[n - 1 :]
        if not (len(first) and len(second)):
            return out + [0] * (orders + 1 - n)
        distinct, both = np.unique(np.concatenate([first, second]), return_inverse=True)
        first, second = both[: len(first)], both[len(first) :]
        out.append(int(np.minimum(np.bincount(first, minlength=len(distinct)), np.bincount(second, minlength=len(distinct))).sum()))
    return out


def bleu(reference: str | None, candidate: str | None) -> float:
    ref, hyp = (reference or "").split(), (candidate or "").split()
    if not ref or not hyp:
        return 0.0
    matches = clipped(ref, hyp, ORDERS + 1)
    totals = [max(1, len(hyp) - n + 1) for n in range(1, ORDERS + 2)]
    if not matches[0]:
        return 0.0
    precisions, doubled = [m / t for m, t in zip(matches, totals, strict=True)], 1.0
    if len(hyp) > 1:  # method 4: zeros shrink geometrically, faster for short candidates
        for i, m in enumerate(matches[:ORDERS]):
            if not m:
                doubled *= 2
                precisions[i] = math.log(len(hyp)) / (5 * doubled) / totals[i]
    smoothed, before = [], precisions[0] + 1  # method 5: average with the neighbours
    for i in range(ORDERS):
        before = (before + precisions[i] + precisions[i + 1]) / 3
        smoothed.append(before)
    if min(smoothed) <= 0:
        return 0.0
    brevity = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return brevity * math.exp(sum(map(math.log, smoothed)) / ORDERS)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows (Hyyro 2004); equal beginnings and ends are set aside first."""
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return same + tail
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        match = row & where.get(y, 0)
        row = ((row + match) | (row - match)) & full
    return same + tail + len(a) - row.bit_count()


_TOKEN = re.compile(r"[a-z0-9]+")


def rouge_l(target: str | None, prediction: str | None, stemmed: bool = True) -> float:
    a, b = (_TOKEN.findall((x or "").lower()) for x in (target, prediction))
    if stemmed:
        a, b = ([_stem(t) if len(t) > 3 else t for t in x] for x in (a, b))
    common = lcs_length(a, b)
    return 2 * common / (len(a) + len(b)) if common else 0.0


# Fixed values of Porter (1980): suffix and replacement by step; the condition is on the stem.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v by letter; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        end = _longest(word, ("ed", "ing"))
        if end and "v" in _shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = _longest(word, _STEP4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


_stem = lru_cache(maxsize=200_000)(porter)  # texts repeat their words


@F.pandas_udf(DoubleType())
def bleu_score(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([bleu(a, b) for a, b in zip(reference, candidate, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def rouge_l_score(target: pd.Series, prediction: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(a, b) for a, b in zip(target, prediction, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def rouge_l_unstemmed(target: pd.Series, prediction: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(a, b, False) for a, b in zip(target, prediction, strict=True)], dtype="float64")


@F.pandas_udf(LongType())
def common_tokens(target: pd.Series, prediction: pd.Series) -> pd.Series:
    """Longest common subsequence of white-space tokens."""
    return pd.Series([lcs_length((a or "").split(), (b or "").split()) for a, b in zip(target, prediction, strict=True)], dtype="int64")


_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Repeated ids that are few enough to broadcast.
FEW_IDS = 100_000


def clipped_matches(pairs: DataFrame, n: int) -> DataFrame:
    """(record_id, reference, candidate) to (record_id, matched, total) n-grams, clipped.

    A record on one row, as records mostly are, is counted where its row lies, and no text is shuffled. The
    rows of an id that is on several count together; only those are dealt out by record.
    """
    pairs = pairs.select("record_id", "candidate", "reference")
    repeated, _ = written(pairs.groupBy("record_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("record_id").alias("_again")), "repeated-ids")
    many = repeated.count()
    if not many:
        return _matches_of_rows(pairs, n)
    same = F.col("record_id").eqNullSafe(F.col("_again"))
    repeated = F.broadcast(repeated) if many <= FEW_IDS else repeated
    return _matches_of_rows(pairs.join(repeated, same, "left_anti"), n).unionByName(_matches_of_groups(pairs.join(repeated, same, "left_semi"), n))


def _matches_of_rows(pairs: DataFrame, n: int) -> DataFrame:
    """Each row by itself."""
    schema = StructType([pairs.schema["record_id"], StructField("matched", LongType()), StructField("total", LongType())])

    def tokens(x: str | None) -> list[str]:
        return [t for t in _SPACE.split(x or "") if t]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, matched, total = [], [], []
            for i, (candidate, reference) in enumerate(zip(batch.column("candidate"), batch.column("reference"), strict=True)):
                found = tokens(candidate.as_py())
                if len(found) >= n:
                    at.append(i)
                    matched.append(clipped(tokens(reference.as_py()), found, n)[-1])
                    total.append(len(found) - n + 1)
            ids = batch.column("record_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(matched, pa.int64()), pa.array(total, pa.int64())], names=["record_id", "matched", "total"])

    return small_batches(pairs).mapInArrow(run, schema)


def _matches_of_groups(pairs: DataFrame, n: int) -> DataFrame:
    """The rows of a record together, by DataFrame operations: dealt out once, then both aggregates work where the n-grams arise."""

    def grams(column: str, candidate: int) -> Column:
        tokens = F.col(column)
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]).alias("gram"), F.lit(candidate).alias("c"), F.lit(1 - candidate).alias("r")))

    tokens = lambda column: F.filter(F.split(F.col(column), r"[ \t\n\r\f]+"), lambda x: x != "")
    dealt = pairs.select("record_id", "candidate", "reference").repartition("record_id")
    split = dealt.select("record_id", tokens("candidate").alias("candidate"), tokens("reference").alias("reference"))
    long = split.select("record_id", F.explode(F.concat(grams("candidate", 1), grams("reference", 0))).alias("g"))
    counts = long.groupBy("record_id", F.col("g.gram").alias("gram")).agg(F.sum("g.c").alias("c"), F.sum("g.r").alias("r"))
    return counts.groupBy("record_id").agg(F.sum(F.least("c", "r")).alias("matched"), F.sum("c").alias("total")).where("total > 0")
