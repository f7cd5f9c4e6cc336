"""Model backends, and the one way a DataFrame calls them.

A backend answers batches. In this environment there are no language models and no network, so
tests and queries use a scripted backend and a rule-based one. The rule-based backend recognises a
few fixed patterns; it is a test double, not a measure of what a model would find.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.request
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilframe.sources.shared import small_batches, written


class Request(NamedTuple):
    record_id: str
    role: str
    iteration: int
    messages: list[dict]
    temperature: float


class ModelBackend(Protocol):
    def generate(self, requests: list[Request]) -> list[str | None]:
        """One answer per request: the empty string for a failed generation, null for a failed call."""


@dataclass
class ScriptedBackend:
    """Answers from a function of (record_id, role, iteration), which must be picklable."""

    answer: Callable[[str, str, int], str | None]

    def generate(self, requests: list[Request]) -> list[str | None]:
        return [self.answer(r.record_id, r.role, r.iteration) for r in requests]


@dataclass
class ScriptedAnswers:
    """Answers from a table (record_id, role, iteration, answer), met by an equi-join; a row it lacks is a failed call."""

    answers: DataFrame

    def answered(self, df: DataFrame, role: str, iteration: int, prompt: Column, into: str) -> DataFrame:
        mine = self.answers.where((F.col("role") == role) & (F.col("iteration") == iteration)).select(F.col("record_id").cast("string").alias("_asked"), F.col("answer").alias("_answered"))
        met = df.withColumn("_due", prompt.isNotNull()).join(mine, F.col("_due") & (F.col("record_id").cast("string") == F.col("_asked")), "left")
        return met.withColumn(into, F.col("_answered")).drop("_due", "_asked", "_answered")


#: Patterns and their replacements, in the order they apply.
PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[EMAIL]"),
    ("card", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "[CARD]"),
    ("phone", r"\+[0-9][0-9 ()-]{7,}[0-9]", "[PHONE]"),
    ("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]"),
)


@dataclass
class RuleBackend:
    """Attacks by finding the fixed patterns and anonymizes by replacing them."""

    explained: str = "Replaced patterns."

    def generate(self, requests: list[Request]) -> list[str | None]:
        return [self._one(r) for r in requests]

    def _one(self, request: Request) -> str:
        text = _slot(request.messages[-1]["content"], "Comment")
        found = {name: m[0] for name, pattern, _ in PII if (m := re.search(pattern, text))}
        if request.role == "attacker":
            return f"Inference: {len(found)} kinds found\nGuess: " + json.dumps({name: found.get(name, "unknown") for name, _, _ in PII}, ensure_ascii=False)
        if request.role == "arbitrator":
            return json.dumps([{"attribute": k, "validity_level": "high", "reasoning_evidence": [v], "leaked_concept": k, "validation_notes": ""} for k, v in found.items()], ensure_ascii=False)
        for _, pattern, mask in PII:
            text = re.sub(pattern, mask, text)
        return text if request.role == "teacher" else f"{self.explained}\n#\n{text}"


def _slot(content: str, title: str) -> str:
    """The slot's text: up to the next slot that follows a comment in our prompts, or the end."""
    text = content.split(f"{title}:\n", 1)[-1]
    return re.split(r"\n\n(?:Feedback|Attributes):\n", text)[0] if title == "Comment" else text


@dataclass
class HttpBackend:
    """A chat-completions service. The key comes from the argument or API_KEY; without one no call is made."""

    url: str
    model: str
    key: str | None = None
    max_tokens: int = 1024
    timeout: float = 60.0
    attempts: int = 3
    workers: int = 10  # calls at a time, of one task
    pause: Callable[[float], None] = time.sleep
    post: Callable[[str, dict, dict, float], dict] | None = field(default=None)

    def generate(self, requests: list[Request]) -> list[str | None]:
        key = self.key or os.environ.get("API_KEY")
        if not key:
            return [None] * len(requests)
        with ThreadPoolExecutor(self.workers) as pool:
            return list(pool.map(lambda r: self._one(r, key), requests))

    def _one(self, request: Request, key: str) -> str | None:
        body = {"model": self.model, "messages": request.messages, "temperature": request.temperature, "max_tokens": self.max_tokens}
        for attempt in range(1, self.attempts + 1):
            try:
                answer = (self.post or _post)(self.url, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, body, self.timeout)
                return answer["choices"][0]["message"]["content"].strip()
            except Exception:  # any failure counts as one attempt; the text isn't logged
                self.pause(2.0 * attempt)
        return None


def _post(url: str, headers: dict, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return json.load(response)


@dataclass
class LocalBackend:
    """A model in the executor's own process, loaded once per process by `load` (any generation engine).

    load() returns a function of (conversations, temperature, max_new_tokens) to as many texts, which gets
    up to `batch` conversations of one temperature at a time. A failed load raises. Of a batch that
    fails, each conversation is tried by itself; one that fails again gives the empty string.
    Sampling is on where temperature > 0.
    """

    name: str
    load: Callable[[], Callable[[list[list[dict]], float, int], list[str]]]
    max_new_tokens: int = 1024
    batch: int = 8

    def generate(self, requests: list[Request]) -> list[str | None]:
        if self.name not in _loaded:
            _loaded[self.name] = self.load()
        out: list[str | None] = [None] * len(requests)
        for temperature in sorted({r.temperature for r in requests}):
            due = [i for i, r in enumerate(requests) if r.temperature == temperature]
            for at in range(0, len(due), self.batch):
                part = due[at : at + self.batch]
                for i, text in zip(part, self._texts([requests[i].messages for i in part], temperature), strict=True):
                    out[i] = text
        return out

    def _texts(self, conversations: list[list[dict]], temperature: float) -> list[str]:
        try:
            texts = _loaded[self.name](conversations, temperature, self.max_new_tokens)
            if len(texts) == len(conversations):
                return texts
        except Exception:  # by contract
            pass
        return [""] if len(conversations) == 1 else [self._texts([c], temperature)[0] for c in conversations]


@dataclass
class CachedBackend:
    """A backend whose answers are kept by request in a folder that all executors mount.

    A task that runs again, after a lost executor or as a speculative copy, finds the answers of
    its first run, so finished calls aren't made twice. The key is a hash of record, role, iteration,
    messages and temperature; the folder holds answers, which may be private, and no prompts.
    Failed calls and generations aren't kept.
    """

    inner: ModelBackend
    folder: str

    def _path(self, request: Request) -> str:
        digest = hashlib.sha256(json.dumps(list(request), sort_keys=True).encode()).hexdigest()
        return os.path.join(self.folder, digest[:2], digest)

    def generate(self, requests: list[Request]) -> list[str | None]:
        out: list[str | None] = [None] * len(requests)
        due = []
        for i, request in enumerate(requests):
            try:
                with open(self._path(request), encoding="utf-8", newline="") as file:
                    out[i] = file.read()
            except FileNotFoundError:
                due.append(i)
        for i, answer in zip(due, self.inner.generate([requests[i] for i in due]) if due else [], strict=True):
            out[i] = answer
            if answer:
                path = self._path(requests[i])
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8", newline="") as file:
                    file.write(answer)
                os.replace(part, path)  # whole or not at all
        return out


_loaded: dict[str, Callable] = {}


PROMPT = "_prompt"


def answered(df: DataFrame, backend: ModelBackend | ScriptedAnswers, role: str, iteration: int, temperature: float, prompt: Column, into: str = "response", write: bool = True) -> DataFrame:
    """df with the backend's answer to each row's prompt (null prompt: no call, null answer).

    df needs record_id, and may not have the columns `into` and PROMPT. With write, the result is a table
    in the shared folder, so plans on it never call again; without, the caller writes it. A task that
    runs again calls again, unless the backend is a CachedBackend.
    """
    taken = {into, PROMPT} & set(df.columns)
    if taken:
        raise ValueError(f"reserved columns: {', '.join(sorted(taken))}")
    if isinstance(backend, ScriptedAnswers):
        met = backend.answered(df, role, iteration, prompt, into)
        return written(met, f"answers-{role}")[0] if write else met

    @F.arrow_udf(StringType())
    def answer(ids: pa.Array, prompts: pa.Array) -> pa.Array:
        asked = prompts.to_pylist()
        due = [i for i, p in enumerate(asked) if p is not None]
        answers: list[str | None] = [None] * len(asked)
        of = ids.to_pylist()
        for i, a in zip(due, backend.generate([Request(str(of[i]), role, iteration, asked[i], temperature) for i in due]), strict=True):
            answers[i] = a
        return pa.array(answers, pa.string())

    # Only id and prompt go to Python; the rest of a row, as long as its history may be, stays in the JVM.
    out = small_batches(df).withColumn(into, answer.asNondeterministic()(F.col("record_id"), prompt))
    return written(out, f"answers-{role}")[0] if write else out


def sizes_only(df: DataFrame, column: str) -> DataFrame:
    """One row of what a log may say of a text column: rows, characters, and a digest of all texts in any order; never text."""
    digest = F.sha2(F.coalesce(F.sum(F.xxhash64(column).cast("decimal(38,0)")), F.lit(0)).cast("string"), 256)
    return df.agg(F.count(column).alias("n_rows"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("n_chars"), digest.alias("digest"))
