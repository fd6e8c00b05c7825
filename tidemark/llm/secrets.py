"""Secret scans by a trigram inverted index.

Each rule's pattern yields a Boolean query over trigrams that any match must contain. Texts are indexed in segments of
bounded size: for every trigram that some query names, the ascending list of the segment's documents that hold it.
Queries intersect and unite these postings, the surviving documents are verified with the pattern, and a rule without
mandatory trigrams scans every document. A segment never leaves its task, so there is no shuffle, and the cost is one pass.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, steps, texts_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if `group` (0: all of it) has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three kinds that every scan reports, in this order.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds of secrets with a fixed beginning.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

# --- Boolean trigram queries. None is true (no condition); else ("and" | "or", parts), parts being trigrams or queries.
_MOST = 16  # exact strings kept for a part of a pattern


def _all(parts):
    parts = [p for p in parts if p is not None]
    return parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts))) if parts else None


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return None if None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(s: str):
    return _all([s[i : i + 3] for i in range(len(s) - 2)]) if len(s) >= 3 else None


def _of_set(strings):
    return _any([_grams(s) for s in strings]) if strings else None


@dataclass
class _Info:
    """Of a part of a pattern: all strings it can match (None: too many), or else what they begin and end with; query."""

    exact: frozenset | None
    prefix: frozenset = frozenset({""})
    suffix: frozenset = frozenset({""})
    query: object = None


def _loose(exact: frozenset) -> _Info:
    """Exact strings turned into a query, and short beginnings and ends that neighbours may complete."""
    return _Info(None, frozenset(s[:2] for s in exact), frozenset(s[-2:] for s in exact), _of_set(exact))


def _concat(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= _MOST:
        return _Info(frozenset(x + y for x in a.exact for y in b.exact))
    across = frozenset(x + y for x in (a.exact if a.exact is not None else a.suffix) for y in (b.exact if b.exact is not None else b.prefix))
    joined = _of_set(across) if len(across) <= _MOST**2 else None
    la, lb = (_loose(x.exact) if x.exact is not None else x for x in (a, b))
    prefix, suffix = la.prefix, lb.suffix
    if a.exact is not None and len(a.exact) * len(lb.prefix) <= _MOST:
        prefix = frozenset((x + y)[:2] for x in a.exact for y in lb.prefix)
    if b.exact is not None and len(b.exact) * len(la.suffix) <= _MOST:
        suffix = frozenset((x + y)[-2:] for x in la.suffix for y in b.exact)
    return _Info(None, prefix, suffix, _all([la.query, lb.query, joined]))


def _union(parts: list[_Info]) -> _Info:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= _MOST:
        return _Info(frozenset().union(*(p.exact for p in parts)))
    parts = [_loose(p.exact) if p.exact is not None else p for p in parts]
    return _Info(None, frozenset().union(*(p.prefix for p in parts)), frozenset().union(*(p.suffix for p in parts)), _any([p.query for p in parts]))


_ANYTHING = _Info(None)


def _node(op, arg) -> _Info:
    if op is sre.LITERAL:
        return _Info(frozenset({chr(arg).lower()}))
    if op is sre.IN:
        chars = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < _MOST:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return _ANYTHING
        return _Info(frozenset(chars)) if len(chars) <= _MOST // 2 else _ANYTHING
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        return _union([_sequence(x) for x in arg[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        if (least, most) == (0, 1):
            return _union([_sequence(inner), _Info(frozenset({""}))])
        if not least:
            return _ANYTHING
        once = _sequence(inner)
        out = once
        for _ in range(min(least, 3) - 1):
            out = _concat(out, once)
        return out if least == most <= 3 else _concat(out, _ANYTHING)
    if op is sre.AT:
        return _Info(frozenset({""}))
    return _ANYTHING


def _sequence(items) -> _Info:
    out = _Info(frozenset({""}))
    for op, arg in items:
        out = _concat(out, _node(op, arg))
    return out


def trigram_query(pattern: str):
    """What the lower-cased text of any match must contain: None, a trigram, or ("and" | "or", parts)."""
    x = _sequence(parser.parse(pattern))
    return _of_set(x.exact) if x.exact is not None else x.query


def named_trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*(named_trigrams(p) for p in query[1]))


def evaluate(query, postings: dict[str, np.ndarray]) -> np.ndarray:
    """The documents that fulfil a query, from ascending posting lists."""
    if isinstance(query, str):
        return postings[query]
    lists = sorted((evaluate(p, postings) for p in query[1]), key=len)
    return functools.reduce(functools.partial(np.intersect1d, assume_unique=True) if query[0] == "and" else np.union1d, lists)


def build_postings(texts: list[str], trigrams: set[str]) -> dict[str, np.ndarray]:
    """The segment's inverted index: for each trigram the numbers of the documents that hold it in either case."""
    folded = [t.lower() for t in texts]
    return {g: np.array([i for i, t in enumerate(folded) if g in t], np.int64) for g in trigrams}


def scan_segment(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of each document's matches, by code points, ordered by start, then by rule."""
    queries = [trigram_query(r.pattern) for r in rules]
    postings = build_postings(texts, set().union(*map(named_trigrams, queries)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for n, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        verify = _compiled(rule)
        for i in range(len(texts)) if query is None else evaluate(query, postings).tolist():
            found[i] += ((m.start(), n, m.end()) for m in verify.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least)
    for x in found:
        x.sort()
    return found


@functools.lru_cache(64)
def _compiled(rule: Rule) -> re.Pattern:
    # A rule that is one greedy run of a class: asking for its least length at once finds the same runs, faster.
    run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return re.compile(f"{run[1]}{{{rule.least},}}" if run and not rule.group else rule.pattern)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and matches, array<struct<kind, start, end>> by start, then by the order of rules, of every row's whole text.

    Offsets count code points, ends are exclusive. Null text counts as empty: no matches. Repeated rows each get a row.
    Other columns are ignored. Matches of one rule don't overlap; those of different rules may.
    """
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in steps(batches, most=STEP_BYTES):
            found = scan_segment(b.column("text").to_pylist(), rules)
            rows = pa.array([[{"kind": rules[n].kind, "start": s, "end": e} for s, n, e in x] for x in found], out)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows], names=["doc_id", "matches"])

    return texts_of(docs).mapInArrow(run, "doc_id bigint, matches array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with every found secret in text replaced by [kind]; overlapping ones are replaced together, as the first.

    All columns stay, in their order, n_chars follows the text if there is one. Null text stays null.
    """
    at = docs.columns.index("text")

    def run(batches):
        for b in steps(batches):
            old = b.column(at).to_pylist()
            new = list(old)
            for i, spans in enumerate(scan_segment([x or "" for x in old], rules)):
                if spans:
                    parts, end = [], 0
                    for s, n, e in spans:
                        if s >= end:
                            parts += [old[i][end:s], f"[{rules[n].kind}]"]
                        end = max(end, e)
                    new[i] = "".join(parts) + old[i][end:]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _joined(kinds: tuple[str, ...] | None):
    kept = "matches" if kinds is None else f"filter(matches, m -> m.kind IN ({', '.join(map(repr, kinds))}))"
    return F.expr(f"array_join(transform({kept}, m -> concat_ws(':', m.kind, m.start, m.end)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row: see scan()."""
    base = tuple(r.kind for r in BASE)
    return scan(docs).select(
        "doc_id", *(F.expr(f"CAST(size(filter(matches, m -> m.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in base),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(None).alias("spans"),
    )


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of spans already ordered."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
