"""Secrets in whole texts, found through a trigram inverted index.

Every rule is a regular expression.  From its syntax tree a Boolean query over lower-cased
byte trigrams is derived that every match must satisfy.  Texts come in segments of a few
megabytes; each segment gets an inverted index from the trigrams that some rule asks for to
the sorted numbers of the texts that hold them.  A rule's query intersects and unites these
postings, and only the texts that remain are searched with the expression itself.  A rule
whose query asks for nothing (such as a run of hexadecimal digits) searches every text.
A segment never leaves its task, so there is no shuffle and no size that matters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.base import field, over_texts, text_buffers


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose ``group`` has at least ``least`` characters.

    Patterns are over ASCII, so that places in UTF-8 bytes and characters correspond.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

# --- a Boolean trigram query for an expression ---------------------------------------
# True asks for nothing; a bytes trigram asks for itself; ("and"|"or", parts) combine.

_MOST = 64


def _join(kind: str, parts: Iterable):
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif True in parts or not parts:
        return True
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _needed(strings: set[bytes]):
    """What a text must hold if it holds one of the strings."""
    return _join("or", [_join("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items) -> set[bytes] | None:
    """The strings of a character class, folded; None for a large or negated one."""
    out: set[bytes] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower().encode())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower().encode() for c in range(value[0], value[1] + 1)}
        else:
            return None
        if len(out) > 8:
            return None
    return out


def _analyse(tree) -> tuple[set[bytes] | None, object]:
    """The strings a tree can match if they are few, else None; and what every match needs."""
    exact: set[bytes] | None = {b""}
    run: set[bytes] = {b""}
    needs = []
    for kind, value in tree:
        if kind is op.LITERAL:
            part, need = {chr(value).lower().encode()}, True
        elif kind is op.IN:
            part, need = _class(value), True
        elif kind is op.SUBPATTERN:
            part, need = _analyse(value[3])
        elif kind is op.BRANCH:
            sides = [_analyse(b) for b in value[1]]
            part = set().union(*[s for s, _ in sides]) if all(s is not None for s, _ in sides) else None
            need = _join("or", [n for _, n in sides])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            part, need = _analyse(body)
            if part is not None and most == 1:
                part = part | {b""} if least == 0 else part
            elif part is not None and least == most and len(part) ** min(least, 8) <= _MOST and least <= 8:
                part = _power(part, least)
            else:
                part = None
            need = need if least else True
        elif kind is op.AT:
            continue
        else:
            part, need = None, True
        if part is None:
            needs += [_needed(run), need]
            exact, run = None, {b""}
            continue
        if len(run) * len(part) > _MOST:
            needs.append(_needed(run))
            exact, run = None, {b""}
        run = {a + b for a in run for b in part}
        if exact is not None:
            exact = run
    needs.append(_needed(run))
    return exact, _join("and", needs)


def _power(part: set[bytes], times: int) -> set[bytes]:
    out = {b""}
    for _ in range(times):
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str):
    """The Boolean trigram query of an expression: what each text with a match must hold, lower-cased."""
    return _analyse(_parser.parse(pattern))[1]


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*[trigrams(p) for p in query[1]])


# --- the index of a segment ---------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


def postings(texts: pa.Array, grams: Sequence[bytes]) -> dict[bytes, np.ndarray]:
    """The sorted numbers of the texts that hold each trigram, letters in either case."""
    raw, at = text_buffers(texts)
    low, high = int(at[0]), int(at[-1])
    data = _LOWER[raw[low:high]]
    if len(data) < 3 or not grams:
        return {g: np.zeros(0, np.int64) for g in grams}
    wanted = _table(tuple(grams))
    codes = data[:-2].astype(np.int32) << 16
    codes |= data[1:-1].astype(np.int32) << 8
    codes |= data[2:]
    places = np.flatnonzero(wanted[codes])
    rows = np.searchsorted(at, places + low, "right") - 1
    inside = places + low + 3 <= at[rows + 1]
    places, rows = places[inside], rows[inside]
    found = codes[places]
    return {g: np.unique(rows[found == _code(g)]) for g in grams}


@lru_cache(4)
def _table(grams: tuple[bytes, ...]) -> np.ndarray:
    table = np.zeros(1 << 24, np.bool_)
    table[[_code(g) for g in grams]] = True
    return table


def candidates(query, index: dict[bytes, np.ndarray], rows: int) -> np.ndarray:
    """The texts that satisfy a query."""
    if query is True:
        return np.arange(rows)
    if isinstance(query, bytes):
        return index[query]
    parts = sorted((candidates(p, index, rows) for p in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


class Scanner:
    """Compiled rules and the trigrams they ask for."""

    def __init__(self, rules: Sequence[Rule]):
        if len({r.kind for r in rules}) < len(rules):
            raise ValueError("two rules of one kind")
        self.rules = list(rules)
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.grams = sorted(set().union(*[trigrams(q) for q in self.queries])) if rules else []
        self.compiled = [re.compile(r.pattern.encode(), re.IGNORECASE if r.any_case else 0) for r in rules]

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of each text in code points, by start, then by the order of the rules."""
        raw, at = text_buffers(texts)
        index = postings(texts, self.grams)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        whole = memoryview(raw)
        for number, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.compiled)):
            for row in candidates(query, index, len(texts)).tolist():
                for m in pattern.finditer(whole[at[row]:at[row + 1]]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[row].append((m.start(), number, m.end()))
        out = []
        for row, spans in enumerate(found):
            spans.sort()
            body = raw[at[row]:at[row + 1]] if spans else None
            places = _characters(body, [p for s, _, e in spans for p in (s, e)])
            out.append([(places[s], places[e], self.rules[k].kind) for s, k, e in spans])
        return out


def _characters(body: np.ndarray | None, places: list[int]) -> dict[int, int]:
    """Byte places as code points."""
    if not places:
        return {}
    order, out, done, n = sorted(set(places)), {}, 0, 0
    for p in order:
        n += int(np.count_nonzero((body[done:p] & 0xC0) != 0x80))
        done, out[p] = p, n
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
                 rules: Sequence[Rule] = BASE + EXTRA) -> DataFrame:
    """The kept columns and ``spans``: an array of (kind, start, end) in code points, end exclusive.

    Spans of one kind do not overlap, those of different kinds may.  Sorted by start, then by
    the order of ``rules``.  Null and empty texts have none.
    """
    rules = tuple(rules)

    def scan(texts: pa.Array, scanner: Scanner):
        rows = [[{"kind": k, "start": s, "end": e} for s, e, k in spans] for spans in scanner.scan(texts)]
        return [pa.array(rows, _SPANS)]

    return over_texts(docs, text, list(keep), "spans array<struct<kind:string,start:long,end:long>>", scan,
                      lambda: Scanner(rules))


def redact(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """The text with every secret replaced by its kind in angle brackets; overlapping ones become one."""
    out, done, i = [], 0, 0
    spans = sorted(spans, key=lambda s: s[0])
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[done:start], f"<{kind}>"]
        done = end
    return "".join([*out, text[done:]])


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars",
                   rules: Sequence[Rule] = BASE + EXTRA) -> DataFrame:
    """``docs`` with all columns, secrets in ``text`` replaced, and ``length`` (if there) brought up to date.

    Texts without a secret, null ones too, stay as they are.
    """
    rules, names = tuple(rules), [f"_c{i}" for i in range(len(docs.columns))]
    body = names[docs.columns.index(text)]

    def clean(texts: pa.Array, scanner: Scanner):
        found = scanner.scan(texts)
        out = [redact(t, s) if s else t for t, s in zip(texts.to_pylist(), found)]
        return [pa.array(out, pa.string()), pa.array([bool(s) for s in found], pa.bool_())]

    # Columns go by their places, so that any names may clash.
    marked = docs.toDF(*names).withColumn("_null", F.col(body).isNull())
    kept = [n for n in names if n != body]
    done = over_texts(marked, body, [*kept, "_null"], "_clean string, _hit boolean", clean, lambda: Scanner(rules))
    columns = []
    for n, c in zip(names, docs.columns):
        if n == body:
            columns.append(F.when(~F.col("_null"), F.col("_clean")).alias(n))
        elif c == length:
            columns.append(F.when(F.col("_hit"), F.length("_clean")).otherwise(F.col(n)).cast(docs.schema[c].dataType).alias(n))
        else:
            columns.append(F.col(n))
    return done.select(*columns).toDF(*docs.columns)
