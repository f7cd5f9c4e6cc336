"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units (Cho et al. 2014) read the UTF-8 bytes of a text from either side; a
linear layer over both states labels every byte, and the mean of the byte probabilities is the
document's. The network is trained here, in numpy, by backpropagation through time. Texts are read
whole, as consecutive windows of WINDOW bytes that start from a zero state, so one long document
and many short ones cost the same per byte and memory is bounded by CHUNK windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import held_out, mapped, small_batches, utf8

HIDDEN = 8
WINDOW = 128
CHUNK = 2048
#: Training: documents a language (expected, chosen by hash), windows a document, bytes a window.
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 3
TRAIN_CHARS = 96
TRAIN_BYTES = 64
EPOCHS = 8
BATCH = 128
SEED = 7
PAD = 256
UNDETERMINED = "und"
#: The most frequent so many languages are learned.
MOST_LANGUAGES = 512
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]


def _cell(x: np.ndarray, h: np.ndarray, w: dict, d: str) -> tuple:
    """One step for all rows: new state and what backpropagation needs."""
    n = h.shape[1]
    ax, ah = w[f"E{d}"][x], h @ w[f"U{d}"] + w[f"c{d}"]
    gates = 1 / (1 + np.exp(-(ax[:, : 2 * n] + ah[:, : 2 * n])))
    z, r = gates[:, :n], gates[:, n:]
    new = np.tanh(ax[:, 2 * n :] + r * ah[:, 2 * n :])
    return new + z * (h - new), (x, h, z, r, new, ah[:, 2 * n :])


def _cell_back(dh: np.ndarray, kept: tuple, w: dict, d: str, grad: dict, dx: list) -> np.ndarray:
    x, h, z, r, new, hn = kept
    dz = dh * (h - new) * z * (1 - z)
    dn = dh * (1 - z) * (1 - new * new)
    dr = dn * hn * r * (1 - r)
    state = np.concatenate([dz, dr, dn * r], 1)
    grad[f"U{d}"] += h.T @ state
    grad[f"c{d}"] += state.sum(0)
    dx.append((x, np.concatenate([dz, dr, dn], 1)))
    return dh * z + state @ w[f"U{d}"].T


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: dict) -> tuple[float, dict]:
    """Mean cross-entropy over all labelled (not padded) bytes; x: (steps, rows) symbols, y: rows' classes."""
    steps, rows = x.shape
    n = w["Uf"].shape[0]
    states = {"f": np.zeros((steps, rows, n), w["W"].dtype), "b": np.zeros((steps, rows, n), w["W"].dtype)}
    kept: dict[str, list] = {"f": [], "b": []}
    order = {"f": range(steps), "b": range(steps - 1, -1, -1)}
    for d in "fb":
        h = np.zeros((rows, n), w["W"].dtype)
        for t in order[d]:
            h, k = _cell(x[t], h, w, d)
            states[d][t] = h
            kept[d].append(k)
    both = np.concatenate([states["f"], states["b"]], 2)
    scores = both @ w["W"] + w["bias"]
    scores -= scores.max(2, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(2, keepdims=True)
    real = x != PAD
    count = real.sum()
    loss = -np.log(p[:, np.arange(rows), y] + 1e-12)[real].sum() / count
    dscore = p
    dscore[:, np.arange(rows), y] -= 1
    dscore *= real[:, :, None] / count
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["W"] = np.einsum("tri,trj->ij", both, dscore)
    grad["bias"] = dscore.sum((0, 1))
    dboth = dscore @ w["W"].T
    for i, d in enumerate("fb"):
        dh, dx = np.zeros((rows, n), w["W"].dtype), []
        for at, t in reversed(list(enumerate(order[d]))):
            dh = _cell_back(dh + dboth[t, :, i * n : (i + 1) * n], kept[d][at], w, d, grad, dx)
        symbols, change = np.concatenate([a for a, _ in dx]), np.concatenate([b for _, b in dx])
        by = np.argsort(symbols, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(symbols[by]) > 0])
        grad[f"E{d}"][symbols[by][first]] = np.add.reduceat(change[by], first, axis=0)
    return float(loss), grad


def initial(classes: int, hidden: int = HIDDEN, seed: int = SEED, dtype: type = np.float32) -> dict:
    rng = np.random.default_rng(seed)
    w = {"W": rng.normal(0, 0.3, (2 * hidden, classes)), "bias": np.zeros(classes)}
    for d in "fb":
        w |= {f"E{d}": rng.normal(0, 0.3, (PAD + 1, 3 * hidden)), f"U{d}": rng.normal(0, 0.3, (hidden, 3 * hidden)), f"c{d}": np.zeros(3 * hidden)}
    return {k: v.astype(dtype) for k, v in w.items()}


def fit(samples: list[tuple[bytes, str]], epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = SEED) -> Model:
    """Train on (bytes, language); each sample is cut or padded to TRAIN_BYTES."""
    languages = sorted({s[1] for s in samples})
    if len(languages) < 2:
        return Model(languages, {})
    x = np.full((len(samples), TRAIN_BYTES), PAD, np.int64)
    for i, (text, _) in enumerate(samples):
        x[i, : len(text[:TRAIN_BYTES])] = np.frombuffer(text[:TRAIN_BYTES], np.uint8)
    y = np.array([languages.index(s[1]) for s in samples])
    w, rng = initial(len(languages), hidden, seed), np.random.default_rng(seed)
    mean, square = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    total, step = epochs * max(1, -(-len(x) // BATCH)), 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = shuffled[at : at + BATCH]
            if not (x[rows] != PAD).any():
                continue
            _, grad = loss_and_gradient(np.ascontiguousarray(x[rows].T), y[rows], w)
            step += 1
            rate = 0.02 * (1 - 0.9 * step / total)
            for k, g in grad.items():  # Adam
                g = np.clip(g, -1, 1)
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                w[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(w[k].dtype)
    return Model(languages, w)


def _run(x: np.ndarray, w: dict, d: str, real: np.ndarray | None) -> np.ndarray:
    """States (steps, hidden, rows) of one direction, float32, without allocation inside the loop.

    Features lie along the rows' axis last, so every operation runs over contiguous memory. Padding
    keeps the state, so the backward reader of a short window starts at its last byte.
    """
    steps, rows = x.shape
    n = w[f"U{d}"].shape[0]
    # Halved gate inputs: sigmoid(a) = (1 + tanh(a / 2)) / 2.
    scale = np.r_[np.full(2 * n, 0.5), np.ones(n)].astype(np.float32)
    table, u = w[f"E{d}"] * scale, np.ascontiguousarray((w[f"U{d}"] * scale).T)
    table[:, : 2 * n] += (w[f"c{d}"] * scale)[: 2 * n]
    table = np.ascontiguousarray(table.T)
    bias = w[f"c{d}"][2 * n :, None]
    out = np.empty((steps, n, rows), np.float32)
    ax, ah = np.empty((3 * n, rows), np.float32), np.empty((3 * n, rows), np.float32)
    gates, new = ah[: 2 * n], ah[2 * n :]
    h = np.zeros((n, rows), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        np.take(table, x[t], 1, ax, mode="clip")
        np.dot(u, h, ah)
        gates += ax[: 2 * n]
        np.tanh(gates, gates)
        gates += 1
        gates *= 0.5
        new += bias
        new *= gates[n:]
        new += ax[2 * n :]
        np.tanh(new, new)
        state = out[t]
        np.subtract(h, new, state)
        state *= gates[:n]
        state += new
        if real is not None:
            np.copyto(state, h, where=~real[t])
        h = state
    return out


def _labels(x: np.ndarray, model: Model, padded: bool) -> np.ndarray:
    """Class probabilities (steps, classes, rows) of every byte; zero where padded."""
    w, real = model.weights, x != PAD if padded else None
    n = w["Uf"].shape[0]
    f, b = _run(x, w, "f", real), _run(x, w, "b", real)
    wf, wb, bias = np.ascontiguousarray(w["W"][:n].T), np.ascontiguousarray(w["W"][n:].T), w["bias"][:, None]
    p = np.empty((len(x), len(wf), x.shape[1]), np.float32)
    for t in range(len(x)):
        q = p[t]
        np.dot(wf, f[t], q)
        q += wb @ b[t]
        q += bias
        np.exp(q, q)  # states are within 1, so the scores can't overflow
        q /= q.sum(0)
        if padded:
            q *= real[t]
    return p


def label_bytes(text: bytes, model: Model) -> np.ndarray:
    """(bytes, classes): the probabilities of every byte of one text."""
    out = []
    for at in range(0, len(text), WINDOW):
        x = np.frombuffer(text[at : at + WINDOW], np.uint8).astype(np.int64)[:, None]
        out.append(_labels(x, model, False)[:, :, 0])
    return np.concatenate(out) if out else np.empty((0, len(model.languages)))


def document_probabilities(texts: list[bytes], model: Model) -> np.ndarray:
    """(texts, classes): mean of the byte probabilities; rows of empty texts are zero."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = np.zeros((len(texts), len(model.languages)))
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    for padded, count in ((False, sizes // WINDOW), (True, (sizes % WINDOW > 0).astype(np.int64))):
        owner = np.repeat(np.arange(len(texts)), count)
        if padded:
            at = starts[owner] + sizes[owner] // WINDOW * WINDOW
            by = np.argsort(sizes[owner] % WINDOW, kind="stable")  # windows of like length together
            owner, at = owner[by], at[by]
        else:
            at = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        for k in range(0, len(owner), CHUNK):
            own, first = owner[k : k + CHUNK], at[k : k + CHUNK]
            if padded:
                width = int((sizes[own] % WINDOW).max())
                place = first + np.arange(width)[:, None]
                inside = place < (starts + sizes)[own]
                x = np.where(inside, buffer[np.minimum(place, len(buffer) - 1)].astype(np.int64), PAD)
            else:
                x = buffer[first + np.arange(WINDOW)[:, None]].astype(np.int64)
            np.add.at(total, own, _labels(x, model, padded).sum(0, dtype=np.float64).T)
    return total / np.maximum(sizes, 1)[:, None]


def has_letter(text: bytes | None) -> bool:
    """Whether any character is of a Unicode letter category (Lu, Ll, Lt, Lm, Lo); numerals such as ½ or Ⅷ are not."""
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace"))))


def predict(texts: list[bytes | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and its probability; `und` and 0 for texts without a letter, or if nothing was learned."""
    lettered = np.array([has_letter(t) for t in texts], bool)
    if not model.weights:
        only = model.languages[0] if model.languages else UNDETERMINED
        return [only if a else UNDETERMINED for a in lettered], np.where(lettered & bool(model.languages), 1.0, 0.0)
    p = document_probabilities([t or b"" for t in texts], model)
    best = p.argmax(1) if len(p) else np.empty(0, int)
    return [model.languages[b] if a else UNDETERMINED for a, b in zip(lettered, best, strict=True)], np.where(lettered, np.minimum(p[np.arange(len(p)), best], 1.0), 0.0)


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, epochs: int = EPOCHS) -> Model:
    """Fit on rows that aren't held out and have lang and text.

    About per_language documents of each of the MOST_LANGUAGES most frequent languages are chosen by hash
    (all, where there are fewer), and WINDOWS_PER_DOC windows of TRAIN_CHARS characters at hashed
    places of each go to the driver; that bound doesn't grow with the table. Reruns choose alike.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return Model([], {})
    wide = 1 << 30
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(wide, per_language * wide // n))])
    chosen = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(wide)) < limits[F.col("lang")]))
    room = F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))
    parts = [F.substring("text", 1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), room).cast("int"), F.lit(TRAIN_CHARS)) for k in range(WINDOWS_PER_DOC)]
    found = chosen.select("lang", F.explode(F.array_distinct(F.array(*parts))).alias("part")).where("part <> ''")
    found = found.orderBy(F.xxhash64("lang", "part"), "lang", "part").limit(4 * WINDOWS_PER_DOC * per_language * len(counts))
    samples = sorted((r.part.encode("utf-8", "replace"), r.lang) for r in found.collect())
    return fit(samples, epochs)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang to learn from).

    Null, empty and letterless texts are `und` with score 0; so is everything where no labelled
    row exists. Where one language is all there is, it is the answer for all texts with a letter.
    Texts of any length are read whole. Rows with a null doc_id are not held out. Repeated rows stay, and
    equal texts get equal answers (ties go to the first language); other columns are ignored. An
    empty table gives an empty result.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        lang, score = predict(utf8(batch.column("text")), shared.value)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": lang, "score": score}

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return mapped(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, model: Model | None = None, least: float = 0.3) -> DataFrame:
    """docs, all columns, less rows without a language: no letter, or no language of probability `least`.

    Null and empty texts go, as all rows do where no language can be learned; repeated rows stay or go
    together, and an empty table stays empty. The network knows no language but those it learned, so a
    text in another one goes only where the learned ones share its bytes about evenly.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            lang, score = predict(utf8(batch.column("text")), shared.value)
            yield batch.filter(pa.array([a != UNDETERMINED and b >= least for a, b in zip(lang, score, strict=True)], pa.bool_()))

    return small_batches(docs).mapInArrow(keep, docs.schema)
