"""Toxicity: a linear-chain conditional random field tags toxic words; marginals make the score.

Labels exist only per document, so the field is learned in two steps. Words and word beginnings that
mark toxic documents of a bounded sample significantly label the tokens of a first fit. Then the
likelihood of the document labels themselves is raised: a document is toxic when any of its tokens is,
with some noise, and the chance that none is comes from the forward messages; its gradient is the
expected token labels under the document's label less those without it. So words that the list lacks
are learned from the documents that they explain, by themselves and by their neighbours: a token's
weight is that of its word and word beginnings, and of those before and after it. A document's
score is a logistic function of its token marginals: their largest, their sum, and their share.
Scoring reads each text whole, where it lies, with no shuffle; forward-backward runs in step over
many documents of like length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import held_out, mapped, utf8
from veilframe.llm.decontaminate import words_of
from veilframe.llm.near_dup import fingerprints_of, stars

#: Bound of the labelled sample, by label (expected, chosen by hash), and its longest text.
SAMPLE_TOXIC = 2_500
SAMPLE_CLEAN = 5_000
SAMPLE_CHARS = 20_000
PREFIXES = (4, 5, 6)
EVIDENCE = 4.0  # likelihood ratio statistic a marking word must reach, beyond 2 ln(words tested)
SAME_DOCUMENTS = 0.8  # overlap from which units of different beginnings count as one passage
SPAN = 40  # tokens of a training sequence
STEPS = 50
BAG_SPAN = 64  # tokens of a chain of the second fit
BAG_CHAINS = 6  # chains of a clean document there, at seeded places; toxic documents are read whole
BAG_STEPS = 40
RATE = 0.1
#: Pull of a weight to the first fit's; how many times that for neighbours' weights, and for the bias and transitions.
PENALTY, NEIGHBOURS, SHARED = 0.3, 4.0, 400.0
LOOSE = 20  # toxic documents that must hold a listed word for half of its weight in the first fit
MISSED, FALSE = 0.05, 0.01  # chances that a document with a toxic token is labelled clean, and one without toxic
UNIT_COUNT, CONTEXT_COUNT = 4, 30  # occurrences from which a word or beginning is learned, and as a neighbour
TOKENS_AT_ONCE = 400_000
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass
class Model:
    #: Weights of a word or word beginning: at the token itself, before it, and after it.
    units: dict[bytes, tuple[float, float, float]] = field(default_factory=dict)
    bias: float = -4.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0, 0.0]))
    cache: dict[bytes, int] = field(default_factory=dict)
    rows: list[tuple[float, float, float]] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))  # rows as an array, as far as it was needed

    def row(self, word: bytes) -> int:
        """Place in rows of the word's weights."""
        got = self.cache.get(word)
        if got is None:
            known = [self.units[u] for u in units_of(word) if u in self.units]
            got = self.cache[word] = len(self.rows)
            self.rows.append(tuple(map(sum, zip(*known, strict=True))) if known else (0.0, 0.0, 0.0))
        return got

    def emissions(self, tokens: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the toxic label of every token, from it and its neighbours, laid end to end; and the sizes."""
        if len(self.rows) > CACHED:
            self.forget()
        sizes = np.array([len(t) for t in tokens], np.int64)
        row = self.row
        at = np.fromiter((row(w) for t in tokens for w in t), np.int64, int(sizes.sum()))
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :])])
        return self.bias + _placed(*self.table.T, at, sizes), sizes

    def forget(self) -> None:
        self.cache, self.rows, self.table = {}, [], np.zeros((0, 3))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "rows": [], "table": np.zeros((0, 3))}


#: Words whose weights a worker keeps.
CACHED = 300_000


def _placed(own: np.ndarray, before: np.ndarray, after: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each token's own weight, that of its left neighbour as such, and that of its right one."""
    out = own[at]
    if len(at) > 1:
        ends = np.cumsum(sizes)[:-1]
        joined = np.ones(len(at) - 1)
        joined[ends[(ends > 0) & (ends < len(at))] - 1] = 0  # the last of a sequence has none after it
        out[1:] += before[at[:-1]] * joined
        out[:-1] += after[at[1:]] * joined
    return out


def units_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings of fixed lengths marked as such."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


def marginals(emissions: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probability of the toxic label of every token of sequences laid end to end.

    Forward and backward messages of two labels are kept as ratios, so a step is one fraction. The
    sequences advance together, longest first, so a step touches only those still running.
    """
    a = np.exp(transition)
    weight = np.exp(np.clip(emissions, -30, 30))
    out = np.empty(len(weight))
    starts = np.cumsum(sizes) - sizes
    by = np.argsort(-sizes, kind="stable")
    by = by[sizes[by] > 0]
    first, length = starts[by], sizes[by]
    if not len(by):
        return out
    running = np.searchsorted(-length, -np.arange(length[0]), side="left")  # sequences longer than t
    message = np.empty(0)
    for t, k in enumerate(running):
        at = first[:k] + t
        message = weight[at] if t == 0 else weight[at] * (a[0, 1] + a[1, 1] * message[:k]) / (a[0, 0] + a[1, 0] * message[:k])
        out[at] = message
    back = np.ones(len(by))  # ratio of backward messages at the token that each sequence is at
    for t in range(length[0] - 1, -1, -1):
        k = running[t]
        at, b = first[:k] + t, back[:k]
        joint = out[at] * b
        out[at] = joint / (1 + joint)
        x = weight[at] * b
        back[:k] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
    return out


def _features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(documents, 4): one, largest marginal, log of their sum, log of their share per thousand."""
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1
    full = np.flatnonzero(sizes)
    if len(full):
        at = (np.cumsum(sizes) - sizes)[full]
        total = np.add.reduceat(p, at)
        out[full, 1] = np.maximum.reduceat(p, at)
        out[full, 2] = np.log1p(total)
        out[full, 3] = np.log1p(1000 * total / sizes[full])
    return out


def _tokens_marginals(tokens: list[list[bytes]], model: Model) -> tuple[np.ndarray, np.ndarray]:
    emissions, sizes = model.emissions(tokens)
    return marginals(emissions, sizes, model.transition), sizes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _doc_units(text: bytes) -> set[bytes]:
    return {u for w in set(words_of(text)) for u in units_of(w)}


def _marking(texts: list[bytes], toxic: np.ndarray) -> set[bytes]:
    """Units whose presence marks toxic documents, by likelihood ratio and purity.

    Toxic documents are counted first, and clean ones only for units that could still pass.
    """
    n1, n0 = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        if label:
            n1.update(_doc_units(text))
    n1 = {u: n for u, n in n1.items() if n >= 4}
    for text, label in zip(texts, toxic, strict=True):
        if not label:
            n0.update(u for u in _doc_units(text) if u in n1)
    share = toxic.mean()
    least = EVIDENCE + 2 * np.log(max(1, len(n1)))
    out = set()
    for unit, k1 in n1.items():
        k0, k = n0[unit], n0[unit] + k1
        if k1 / k > 0.9:
            ratio = 2 * (k1 * np.log(k1 / k / share) + (k0 * np.log(k0 / k / (1 - share)) if k0 else 0))
            if ratio >= least:
                out.add(unit)
    return _without_passages(sorted(out), [t for t, y in zip(texts, toxic, strict=True) if y])


def _without_passages(units: list[bytes], texts: list[bytes]) -> set[bytes]:
    """units less those that share their documents with units of other beginnings.

    Words of a passage that repeats across documents look alike as evidence, but occur together;
    words that mark toxicity occur each in documents of its own.
    """
    where = np.zeros((len(units), len(texts)), np.float32)
    position = {u: i for i, u in enumerate(units)}
    for k, text in enumerate(texts):
        where[[position[u] for u in _doc_units(text) if u in position], k] = 1
    size = where.sum(1)
    out = set(units)
    for i in range(0, len(units), 512):
        both = where[i : i + 512] @ where.T
        alike = both / (size[i : i + 512, None] + size - both) > SAME_DOCUMENTS
        for r, c in zip(*np.nonzero(alike), strict=True):
            if units[i + r][:4] != units[c][:4]:
                out.discard(units[i + r])
    return out


def _fit_field(sequences: list[list[bytes]], marking: set[bytes], model: Model) -> None:
    """Gradient ascent (Adam) on the penalised log-likelihood of the token labels."""
    names = Counter(u for s in sequences for w in s for u in set(units_of(w)))
    index = {u: i for i, u in enumerate(sorted(u for u, n in names.items() if n >= 3 or u in marking))}
    sizes = np.array([len(s) for s in sequences], np.int64)
    flat = [w for s in sequences for w in s]
    label = np.array([any(u in marking for u in units_of(w)) for w in flat], float)
    col = np.fromiter((index.get(u, -1) for w in flat for u in units_of(w)), np.int64)
    row = np.repeat(np.arange(len(flat)), np.fromiter((len(units_of(w)) for w in flat), np.int64, len(flat)))[col >= 0]
    col = col[col >= 0]
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(sizes) - sizes] = False  # tokens with a token before them
    after = np.flatnonzero(inner)
    size = len(index) + 5
    theta, mean, square = np.zeros(size), np.zeros(size), np.zeros(size)
    theta[-5] = -4.0

    def one_hot_pairs(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
        return np.array([((1 - prev) * (1 - cur)).sum(), ((1 - prev) * cur).sum(), (prev * (1 - cur)).sum(), (prev * cur).sum()])

    seen = one_hot_pairs(label[after - 1], label[after])
    for step in range(1, STEPS + 1):
        transition = theta[-4:].reshape(2, 2)
        emissions = theta[-5] + np.bincount(row, theta[col], len(flat))
        p = marginals(emissions, sizes, transition)
        # Pair marginals: P(prev, cur) from the single ones and the local factor.
        weight, a = np.exp(np.clip(emissions, -30, 30)), np.exp(transition)
        odds = p / np.maximum(1 - p, 1e-12)
        forward = _forward(weight, sizes, a)
        forward_prev = forward[after - 1]
        back_cur = odds[after] / np.maximum(forward[after], 1e-12)
        cells = np.stack([np.ones(len(after)) * a[0, 0], a[0, 1] * weight[after] * back_cur, forward_prev * a[1, 0], forward_prev * a[1, 1] * weight[after] * back_cur])
        expected = (cells / cells.sum(0)).sum(1) if len(after) else np.zeros(4)
        gradient = np.concatenate([np.bincount(col, (label - p)[row], len(index)), [(label - p).sum()], seen - expected]) - 0.05 * theta
        gradient /= max(1, len(sequences))
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient * gradient - square)
        theta += 0.25 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    model.units = {u: (float(theta[i]), 0.0, 0.0) for u, i in index.items() if abs(theta[i]) > 1e-3}
    model.bias, model.transition = float(theta[-5]), theta[-4:].reshape(2, 2).copy()


def _forward(weight: np.ndarray, sizes: np.ndarray, a: np.ndarray) -> np.ndarray:
    out = np.empty(len(weight))
    starts = np.cumsum(sizes) - sizes
    for t in range(int(sizes.max(initial=0))):
        on = sizes > t
        at = starts[on] + t
        out[at] = weight[at] if t == 0 else weight[at] * (a[0, 1] + a[1, 1] * out[at - 1]) / (a[0, 0] + a[1, 0] * out[at - 1])
    return out


def none_toxic(emissions: np.ndarray, sizes: np.ndarray, transition: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """Log probability, for each sequence laid end to end, that no token of it is toxic.

    forward holds the ratios of the forward messages (see _forward), of which the normalising sum is made.
    """
    a = np.exp(transition)
    out = np.zeros(len(sizes))
    if not len(forward):
        return out
    starts = np.cumsum(sizes) - sizes
    # The messages of the clean label grow by a[0,0] + a[1,0] * ratio a step; the path of clean labels by a[0,0].
    grown = np.log1p(a[1, 0] / a[0, 0] * forward)
    full = sizes > 0
    whole = np.add.reduceat(grown, starts[full])
    last = forward[starts[full] + sizes[full] - 1]
    out[full] = -(whole - np.log1p(a[1, 0] / a[0, 0] * last) + np.log1p(last))
    return out


def _raise_likelihood(texts: list[bytes], toxic: np.ndarray, model: Model, rng: np.random.Generator) -> None:
    """Gradient ascent (Adam) on the penalised likelihood of the document labels, from the first fit on."""
    vocabulary: dict[bytes, int] = {}
    chains: list[np.ndarray] = []
    bag: list[int] = []
    for d, text in enumerate(texts):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int32)
        parts = [ids[i : i + BAG_SPAN] for i in range(0, len(ids), BAG_SPAN)]
        if not toxic[d] and len(parts) > BAG_CHAINS:
            parts = [parts[i] for i in sorted(rng.choice(len(parts), BAG_CHAINS, replace=False))]
        chains += parts
        bag += [d] * len(parts)
    if not chains:
        return
    at, sizes, bag = np.concatenate(chains), np.array([len(c) for c in chains], np.int64), np.array(bag)
    words = list(vocabulary)
    seen = np.bincount(at, minlength=len(words))
    counts: Counter = Counter()
    for w, n in zip(words, seen.tolist(), strict=True):
        for u in units_of(w):
            counts[u] += n
    kept = {u: i for i, u in enumerate(sorted(u for u, n in counts.items() if n >= UNIT_COUNT or u in model.units))}
    near = np.array([counts[u] >= CONTEXT_COUNT for u in kept])
    del counts
    backed: Counter = Counter()
    for text, y in zip(texts, toxic, strict=True):
        if y:
            backed.update(u for u in _doc_units(text) if u in model.units)
    col = np.fromiter((kept.get(u, -1) for w in words for u in units_of(w)), np.int64)
    row = np.repeat(np.arange(len(words)), np.fromiter((len(units_of(w)) for w in words), np.int64, len(words)))[col >= 0]
    col, n = col[col >= 0], len(kept)
    theta = np.zeros(3 * n + 5)
    for u, i in kept.items():
        # What the first fit has against a word is only that the list lacks it; what few documents back is held loosely.
        theta[i] = max(0.0, model.units.get(u, (0.0,))[0]) * backed[u] / (backed[u] + LOOSE)
    del backed, vocabulary, chains
    theta[-5], theta[-4:] = model.bias, model.transition.ravel()
    start = theta.copy()  # the penalty draws to the first fit
    penalty = np.repeat([PENALTY, NEIGHBOURS * PENALTY, NEIGHBOURS * PENALTY], n)
    mean, square = np.zeros(len(theta)), np.zeros(len(theta))
    ends = np.cumsum(sizes)
    # Blocks of whole documents, about TOKENS_AT_ONCE tokens each, bound the memory of a step.
    last = np.flatnonzero(np.r_[bag[1:] != bag[:-1], True])
    cuts = last[np.unique(np.searchsorted(ends[last], np.arange(TOKENS_AT_ONCE, int(ends[-1]) + TOKENS_AT_ONCE, TOKENS_AT_ONCE)).clip(max=len(last) - 1))] + 1
    blocks = list(zip(np.r_[0, cuts[:-1]], cuts, strict=True))

    def block_gradient(low: int, high: int) -> np.ndarray:
        """Of the chains low to high: by unit and place, of the bias, and of the transitions."""
        first = ends[low] - sizes[low]
        tokens, own_sizes, own_bag = at[first : ends[high - 1]], sizes[low:high], bag[low:high] - bag[low]
        labels = toxic[bag[low] : bag[high - 1] + 1]
        emissions = theta[-5] + _placed(*weights, tokens, own_sizes)
        transition = theta[-4:].reshape(2, 2)
        a, weight = np.exp(transition), np.exp(np.clip(emissions, -30, 30))
        forward = _forward(weight, own_sizes, a)
        p = marginals(emissions, own_sizes, transition)
        none = np.exp(np.bincount(own_bag, none_toxic(emissions, own_sizes, transition, forward), len(labels)))
        seen_label = np.where(labels == 1, (1 - none) * (1 - MISSED) + none * FALSE, (1 - none) * MISSED + none * (1 - FALSE))
        factor = np.where(labels == 1, 1.0, -1.0) * none * (1 - MISSED - FALSE) / seen_label  # of expected features less those of the clean path
        owner = np.repeat(own_bag, own_sizes)
        pull = factor[owner] * p
        joined = np.ones(len(tokens) - 1)
        joined[np.cumsum(own_sizes)[:-1] - 1] = 0
        inner = np.flatnonzero(joined) + 1
        back = p[inner] / np.maximum(1 - p[inner], 1e-12) / np.maximum(forward[inner], 1e-12)
        cells = np.stack([np.full(len(inner), a[0, 0]), a[0, 1] * weight[inner] * back, forward[inner - 1] * a[1, 0], forward[inner - 1] * a[1, 1] * weight[inner] * back])
        cells /= cells.sum(0)
        cells[0] -= 1
        by_word = np.bincount(tokens, pull, len(words))
        by_left = np.bincount(tokens[:-1], pull[1:] * joined, len(words))
        by_right = np.bincount(tokens[1:], pull[:-1] * joined, len(words))
        return np.concatenate([np.bincount(col, g[row], n) for g in (by_word, by_left, by_right)] + [[pull.sum()], (cells * factor[owner[inner]]).sum(1)])

    for step in range(1, BAG_STEPS + 1):
        weights = [np.bincount(row, theta[k * n : (k + 1) * n][col], len(words)) for k in range(3)]
        gradient = sum(block_gradient(low, high) for low, high in blocks)
        gradient[n : 2 * n] *= near
        gradient[2 * n : 3 * n] *= near
        gradient[: 3 * n] -= penalty * (theta - start)[: 3 * n]
        gradient[-5:] -= SHARED * PENALTY * (theta - start)[-5:]
        gradient /= len(texts)
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient * gradient - square)
        theta += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    model.units = {u: tuple(theta[[i, n + i, 2 * n + i]].tolist()) for u, i in kept.items() if np.abs(theta[[i, n + i, 2 * n + i]]).max() > 1e-2}
    model.bias, model.transition = float(theta[-5]), theta[-4:].reshape(2, 2).copy()


def fit(samples: list[tuple[bytes, int]], seed: int = 3) -> Model:
    """Fit field and document score to (UTF-8 text, 0 or 1). Near copies count once."""
    model = Model()
    samples = sorted(set(samples))
    prints = fingerprints_of([t for t, _ in samples]).view(np.int64)
    members, _ = stars(prints) if len(prints) else (np.empty(0, np.int64), None)
    dropped, kept, seen = set(members.tolist()), [], set()
    for sample, fp in zip(samples, prints.tolist(), strict=True):
        if fp not in dropped and fp not in seen:
            kept.append(sample)
            seen.add(fp)
    toxic = np.array([y for _, y in kept])
    if not len(kept) or toxic.min() == toxic.max():
        model.document = np.array([4.0 if len(kept) and toxic[0] else -4.0, 0.0, 0.0, 0.0])
        return model
    texts = [t for t, _ in kept]
    marking = _marking(texts, toxic)
    rng = np.random.default_rng(seed)
    sequences = []
    for text, y in zip(texts, toxic, strict=True):
        words = words_of(text)
        if not words:
            continue
        marked = [i for i, w in enumerate(words) if any(u in marking for u in units_of(w))] if y else []
        centres = marked[:3] if marked else rng.integers(0, len(words), 1).tolist()
        for c in centres:
            at = max(0, c - int(rng.integers(0, SPAN)))
            sequences.append(words[at : at + SPAN])
    _fit_field(sequences, marking, model)
    _raise_likelihood(texts, toxic, model, rng)
    parts = [_features(*_tokens_marginals([words_of(t) for t in texts[i : i + 500]], model)) for i in range(0, len(texts), 500)]
    model.forget()
    x, w = np.concatenate(parts), np.zeros(4)
    for _ in range(60):  # Newton steps of a ridge-penalised logistic regression
        q = _sigmoid(x @ w)
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(4)
        w += np.linalg.solve(hessian, x.T @ (toxic - q) - 0.5 * w)
    model.document = w
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out.

    About SAMPLE_TOXIC and SAMPLE_CLEAN documents are chosen by hash (all, where there are fewer)
    among texts of up to SAMPLE_CHARS characters; the ids are broadcast, being so bounded. Labels
    other than 0 and 1 are out; of several labels of a document the largest counts.
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = 1 << 30
    limit = F.lit(0)
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        limit = F.when(F.col("toxic") == value, min(wide, most * wide // max(1, counts.get(value, 0)))).otherwise(limit)
    most = 2 * (SAMPLE_TOXIC + SAMPLE_CLEAN)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(wide)) < limit).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    found = texts.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", "toxic").orderBy("h", "text").limit(most).toArrow()
    return fit(list(zip(utf8(found.column("text").combine_chunks()), found.column("toxic").to_pylist(), strict=True)))


def score_texts(texts: list[bytes | None], model: Model) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Scores, and the toxic spans of each text as code point offsets (end exclusive)."""
    tokens = [words_of(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: len(tokens[i]))
    scores, spans = np.empty(len(texts)), [[] for _ in texts]
    at = 0
    while at < len(order):
        stop, total = at, 0
        while stop < len(order) and (stop == at or total + len(tokens[order[stop]]) <= TOKENS_AT_ONCE):
            total += len(tokens[order[stop]])
            stop += 1
        group = order[at:stop]
        p, sizes = _tokens_marginals([tokens[i] for i in group], model)
        scores[group] = _sigmoid(_features(p, sizes) @ model.document)
        edge = np.r_[0, np.cumsum(sizes)]
        hits = np.flatnonzero(p >= 0.5)
        for k in np.unique(np.searchsorted(edge, hits, side="right") - 1):
            marked = set((hits[(hits >= edge[k]) & (hits < edge[k + 1])] - edge[k]).tolist())
            spans[group[k]] = _offsets(texts[group[k]], marked)
        at = stop
    return scores, spans


def _offsets(text: bytes, marked: set[int]) -> list[tuple[int, int]]:
    """Character spans of the marked tokens; neighbours join."""
    out: list[list[int]] = []
    done_bytes = done_chars = 0
    last = -2
    for i, m in enumerate(_TOKEN.finditer(text)):
        if i in marked:
            done_chars += len(text[done_bytes : m.start()].decode("utf-8", "replace"))
            start, width = done_chars, len(m[0].decode("utf-8", "replace"))
            done_bytes, done_chars = m.end(), start + width
            if last == i - 1:
                out[-1][1] = start + width
            else:
                out.append([start, start + width])
            last = i
    return [tuple(x) for x in out]


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row of docs (doc_id, text).

    labels (doc_id, toxic) teaches only through rows that aren't held out. Null, empty and wordless
    texts get the score of a document without toxic tokens. Without labels of both kinds all
    documents get one score. spans is start:end of offending words in code points, comma-joined.
    Rows with a null doc_id are not held out; repeated rows stay; other columns are ignored. Texts of
    any length are read whole. An empty table gives an empty result; equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def run(batch: pa.RecordBatch) -> dict:
        score, spans = score_texts(utf8(batch.column("text")), shared.value)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= 0.5).astype(np.int32), "spans": [",".join(f"{a}:{b}" for a, b in s) for s in spans]}

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return mapped(rows, run, "doc_id long, held_out boolean, score double, predicted int, spans string")
