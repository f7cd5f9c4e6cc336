"""Secret scan: fixed patterns, and assignment-aware lexing of source and configuration text.

The patterns find assigned values after a sensitive word, access keys and long hexadecimal runs.
The lexer reads lines of common languages and configuration formats as assignments of literals to
names, follows constants through later names and concatenations, and scores each literal by the
most sensitive name it reaches and by how much it looks like a credential. What the lexer adds has
the kind `lexed`; it never removes a pattern's span. One pass where the rows lie, no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import mapped, small_batches

KINDS = ("assign", "access", "hex", "lexed")
THRESHOLD = 0.5
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the same as runs of any length less the short ones
#: Words of a name and how strongly each marks its value as secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 0.9, "auth": 0.6, "bearer": 0.8, "key": 0.45, "pass": 0.7, "salt": 0.5, "dsn": 0.5,
}
PLACEHOLDER = re.compile(r"(?i)^(?:changeme|example|placeholder|your[_-].*|x{4,}|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|none|null|true|false|undefined|test|todo)$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: A run of names is consumed once, whether or not an operator follows, so long runs and chains cost linear time.
_HEAD = re.compile(
    r"""(?:(?:"(?P<dq>[\w.\- ]++)"|'(?P<sq>[\w.\- ]++)')[ \t]*+(?P<qop>:=|=>|=(?![=>])|:(?![:/]))|(?<![\w$])(?:(?![A-Za-z_$])\w)*+(?P<name>[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+|\[["'][\w-]++["']\])*+)(?:[ \t]*+(?P<op>:=|=>|=(?![=>])|:(?![:/])))?)[ \t]*+"""
)
_TERM = re.compile(r"""(?P<quoted>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)|(?P<bare>[^\s"'`,;+(){}\[\]]++)""")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\|\|)[ \t]*")


def _sensitivity(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:], strict=False)]
    return max((NAME_WEIGHTS.get(w, 0.0) for w in words + pairs), default=0.0)


_ENDS = 16


class _Literal:
    """What strength needs of a concatenation that is built from its end: counts, length, and both ends."""

    def __init__(self, counts: dict | None = None, size: int = 0, first: str = "", last: str = ""):
        self.counts, self.size, self.first, self.last = Counter(counts or {}), size, first, last

    def put_before(self, counts: dict, size: int, first: str, last: str) -> None:
        self.counts.update(counts)
        # Ends of a shorter text than _ENDS are the whole of it.
        self.last = (last + self.last)[-_ENDS:] if self.size < _ENDS else self.last
        self.first = (first + self.first)[:_ENDS] if size < _ENDS else first
        self.size += size

    def put_text(self, text: str) -> None:
        if text:
            self.put_before(Counter(text), len(text), text[:_ENDS], text[-_ENDS:])

    def copy(self) -> _Literal:
        return _Literal(self.counts, self.size, self.first, self.last)

    def _placeholder(self) -> bool:
        ends = self.first + (self.last[-min(self.size - _ENDS, _ENDS) :] if self.size > _ENDS else "")
        same = set(ends) <= {"x", "X"} or set(ends) == {"*"}
        return bool(PLACEHOLDER.match(ends)) and (not same or set(self.counts) <= {"x", "X"} or set(self.counts) == {"*"})

    def strength(self) -> float:
        """0 to 1: long, mixed and uneven literals look like credentials; words and placeholders don't."""
        if self.size < 6 or self._placeholder() or any(c.isspace() for c in self.counts):
            return 0.0
        entropy = -sum(c / self.size * math.log2(c / self.size) for c in self.counts.values())
        distinct = "".join(self.counts)
        classes = sum(bool(re.search(p, distinct)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        return min(1.0, entropy / 3.5) * (0.5 + 0.25 * min(classes - 1, 2))


class _Value:
    """The value of one head: a chain's terms from a term, or from within a bare one, to its end."""

    def __init__(self, at: int, start: int, weight: float, arrow: bool):
        self.at, self.start, self.weight, self.arrow = at, start, weight, arrow
        self.own: object = None
        self.used = False
        self.score = 0.0
        self.literal: _Literal | None = None


class _Chain:
    """Joined terms (start, end, kind, constant), parsed once; heads within its bare terms share its rest."""

    def __init__(self):
        self.terms: list[tuple[int, int, str, _Value | None]] = []
        self.facts: list[tuple[int, int]] = []
        self.values: list[_Value] = []
        self.before: dict[str, _Value | None] = {}
        self.rest: list[tuple[tuple[bool, bool], tuple[bool, bool]]] = []

    def close(self) -> None:
        """For each term, of the terms after it and by plain and => heads: all resolved, any part."""
        state = ((True, True), (False, False))
        for start, end, kind, _ in reversed(self.terms):
            self.rest.append(state)
            (plain, arrow), (some, other) = state
            part = kind == "ref" or kind == "quoted" and end > start
            state = ((plain and kind != "none", arrow and kind not in ("none", "bare")), (some or part or kind == "bare", other or part))
        self.rest.reverse()

    def evaluate(self, text: str) -> None:
        """Scores of the values that count, in one pass from the end."""
        for arrow in (False, True):
            asked = sorted((v for v in self.values if v.arrow == arrow and (v.weight or v.used)), key=lambda v: v.start)
            if not asked:
                continue
            run = _Literal()
            for i in range(len(self.terms) - 1, asked[0].at - 1, -1):
                start, end, kind, constant = self.terms[i]
                at, rest = end, None
                while asked and asked[-1].at == i:
                    v = asked.pop()
                    if isinstance(v.own, _Value) or v.own == "none" or kind != "bare" and v.own == "bare":
                        mine = (rest or run).copy() if at == end else rest.copy()
                        if isinstance(v.own, _Value):
                            c = v.own.literal
                            mine.put_before(c.counts, c.size, c.first, c.last)
                        elif v.own == "bare":
                            mine.put_text(text[v.start : end])
                    else:
                        if v.own == "bare":
                            if rest is None:
                                rest = run.copy()
                            run.put_text(text[v.start : at])
                            at = v.start
                        else:
                            run.put_text(text[v.start : end])
                            at = start
                        mine = run
                    if v.weight:
                        v.score = v.weight * mine.strength()
                    if v.used:
                        v.literal = mine.copy()
                if not asked:
                    break
                if kind == "ref":
                    run = rest or run
                    run.put_before(constant.literal.counts, constant.literal.size, constant.literal.first, constant.literal.last)
                elif kind == "quoted" or kind == "bare" and not arrow:
                    run.put_text(text[start:at])
                elif rest is not None:
                    run = rest

    def spread(self, best: dict[tuple[int, int], float]) -> None:
        """Give each part the best score of the values that hold it."""
        for arrow in (False, True):
            values = sorted((v for v in self.values if v.arrow == arrow), key=lambda v: v.start)
            top, turn = 0.0, 0
            for i in range(values[0].at if values else len(self.terms), len(self.terms)):
                start, end, kind, constant = self.terms[i]
                if top:
                    if kind == "ref":
                        constant.score = max(constant.score, top)
                    elif kind == "quoted" and end > start or kind == "bare" and not arrow:
                        best[start, end] = max(best.get((start, end), 0.0), top)
                while turn < len(values) and values[turn].at == i:
                    v = values[turn]
                    turn += 1
                    if isinstance(v.own, _Value):
                        v.own.score = max(v.own.score, v.score)
                    elif v.own in ("quoted", "bare") and end > v.start and v.score:
                        best[v.start, end] = max(best.get((v.start, end), 0.0), v.score)
                    top = max(top, v.score)


def lexed(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach sensitive names, best score of each, by start.

    Time is linear in the text for a bounded alphabet: a term is read once, heads within a bare term
    are values of the chain that holds it, and constants are references. Names in an expression mean
    what they did where it starts.
    """
    known: dict[str, _Value] = {}
    chains: list[_Chain] = []
    bare: list[tuple[int, int]] = []  # by start: bare terms read so far, and in held their chains
    held: dict[int, tuple[_Chain, int]] = {}

    def kind_of(start: int, end: int, last_mark: int, last_digit: int, chain: _Chain) -> tuple[str, _Value | None]:
        if start > last_mark and (name := text[start:end]) is not None:
            constant = chain.before[name] if name in chain.before else known.get(name)
            if constant is not None:
                constant.used = True
                return "ref", constant
        return ("bare" if last_digit >= start and end - start >= 8 else "none"), None

    for head in _HEAD.finditer(text):
        op = head["op"] or head["qop"]
        if not op:
            continue
        name, at, arrow = head["dq"] or head["sq"] or head["name"], head.end(), op == "=>"
        place = bisect_right(bare, (at, len(text) + 1)) - 1
        if place >= 0 and at < bare[place][1]:
            chain, index = held[bare[place][0]]
        else:
            chain, index, here = _Chain(), 0, at
            while term := _TERM.match(text, here):
                start, end = term.span()
                if term["quoted"]:
                    chain.terms.append((start + 1, end - 1, "quoted", None))
                    chain.facts.append((-1, -1))
                else:
                    run = term["bare"]
                    mark = max(run.rfind("="), run.rfind(":"))
                    digit = next((k for k in range(len(run) - 1, -1, -1) if run[k].isdecimal()), -1)
                    chain.facts.append((start + mark if mark >= 0 else -1, start + digit if digit >= 0 else -1))
                    insort(bare, (start, end))
                    held[start] = (chain, len(chain.terms))
                    chain.terms.append((start, end, *kind_of(start, end, *chain.facts[-1], chain)))
                if not (more := _JOIN.match(text, end)):
                    break
                here = more.end()
            if not chain.terms:
                continue
            chain.close()
            chains.append(chain)
        start, end, kind, constant = chain.terms[index]
        if kind == "quoted":
            own = "quoted"
        else:
            start = at
            kind, constant = kind_of(start, end, *chain.facts[index], chain)
            own = constant or ("none" if arrow else kind)
        value = _Value(index, start, _sensitivity(name), arrow)
        value.own = own
        resolved, some = (x[arrow] for x in chain.rest[index])
        if not (some or isinstance(own, _Value) or own == "bare" or own == "quoted" and end > start):
            continue
        chain.values.append(value)
        if resolved and own != "none":
            chain.before.setdefault(name, known.get(name))
            known[name] = value
    best: dict[tuple[int, int], float] = {}
    for chain in chains:
        chain.evaluate(text)
    for chain in reversed(chains):
        chain.spread(best)
    return sorted((s, e, x) for (s, e), x in best.items() if x >= threshold)


def scan(text: str | None) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, value start, value end), by start and then kind as in KINDS."""
    if not text:
        return []
    found = []
    folded = text.lower()
    if "pass" in folded or "secret" in folded or "token" in folded or "api" in folded:
        found += [(m.start(), m.end(), "assign", *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(*m.span(), "hex", *m.span()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        found += [(s, e, "lexed", s, e) for s, e, _ in lexed(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _listed(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs (doc_id, text).

    Spans are kind:start:end in code points, end exclusive. Null and empty texts have none (the
    digest of the empty string, and an empty list); repeated rows stay; other columns are ignored. Texts
    of any length are read whole, in linear time; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> dict:
        found = [scan(t) for t in batch.column("text").to_pylist()]
        base = [[s for s in x if s[2] != "lexed"] for x in found]
        return {
            "doc_id": batch.column("doc_id"),
            **{f"n_{kind}": [sum(s[2] == kind for s in x) for x in base] for kind in KINDS[:3]},
            "base_sha256": [hashlib.sha256(_listed(x).encode()).hexdigest() for x in base],
            "spans": [_listed(x) for x in found],
        }

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked_text(text: str | None, mask: str = "[SECRET]") -> str | None:
    """text with each secret value, overlapping ones together, replaced by the mask."""
    out, at, last = [], 0, -1
    for start, end in sorted({(s[3], s[4]) for s in scan(text)}):
        if start >= last:
            out += [text[at:start], mask]
            at = last = end
        elif end > last:
            at = last = end
    return "".join([*out, text[at:]]) if out else text


def masked(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs, all columns and rows, with secret values masked in text and n_chars recounted where it changed.

    Null, empty and long texts and repeated rows are treated like others; an empty table stays empty.
    """

    def run(batches):
        for batch in batches:
            before = batch.column("text").to_pylist()
            after = [masked_text(t, mask) for t in before]
            if after != before:
                names = batch.schema.names
                columns = list(batch.columns)
                columns[names.index("text")] = pa.array(after, batch.schema.field("text").type)
                if "n_chars" in names:
                    sizes = [n if a == b else len(a) for n, a, b in zip(batch.column("n_chars").to_pylist(), after, before, strict=True)]
                    columns[names.index("n_chars")] = pa.array(sizes, batch.schema.field("n_chars").type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return small_batches(docs).mapInArrow(run, docs.schema)
