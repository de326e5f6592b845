"""Secret scans: trigram queries derived from each rule's pattern, looked up in an inverted index."""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from demandloom.llm.common import bound_batches, pick

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, n_scanned int"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Kinds, patterns and lengths of the base rules, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Rules for further well-known shapes.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("code_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES

# --- Boolean trigram queries -------------------------------------------------------------------
# A query is True (every text qualifies), ("tri", t), ("and", parts) or ("or", parts).
# An expression is summed up by the set of texts it can match, if that is small, and by a query.

MOST_TEXTS = 64


def _all(parts):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _any(parts):
    if any(p is True for p in parts):
        return True
    parts = tuple(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", parts)


def _literal(text: str):
    """All trigrams of a text that must occur; case and non-ASCII letters are left open."""
    data = text.encode()
    return _all([("tri", data[i : i + 3]) for i in range(len(data) - 2)])


def _exact_query(texts):
    return True if texts is None else _any([_literal(t) for t in sorted(texts)])


def _sequence(items):
    """Joins neighbours while their texts are few; else turns what is known so far into a query."""
    texts, queries, pure = {""}, [], True
    for item_texts, query in items:
        queries.append(query)
        if item_texts is not None and len(texts) * len(item_texts) <= MOST_TEXTS:
            texts = {a + b for a, b in product(texts, item_texts)}
        else:
            queries.append(_exact_query(texts))
            pure, texts = False, {""} if item_texts is None else set(item_texts)
    if pure:
        return texts, _all(queries)
    return None, _all([*queries, _exact_query(texts)])


def _expand(op, value):
    if op is sre.LITERAL:
        return {chr(value).lower()}, True
    if op is sre.IN:
        found = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                found.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (found, True) if len(found) <= 8 else (None, True)
    if op is sre.SUBPATTERN:
        return _sequence([_expand(*x) for x in value[3]])
    if op is sre.BRANCH:
        branches = [_sequence([_expand(*x) for x in b]) for b in value[1]]
        if all(t is not None for t, _ in branches):
            texts = set().union(*(t for t, _ in branches))
            if len(texts) <= MOST_TEXTS:
                return texts, True
        return None, _any([_all([q, _exact_query(t)]) for t, q in branches])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = value
        texts, query = _sequence([_expand(*x) for x in body])
        if low == 0:
            return (({""} | texts) if high == 1 and texts is not None else None), True
        if low == high == 1:
            return texts, query
        return None, _all([query, _exact_query(texts)])
    if op is sre.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str):
    """The trigrams, of texts folded to lower case, without which the pattern cannot match.

    True means that no trigram is mandatory, so every text must be scanned.
    """
    texts, query = _sequence([_expand(*x) for x in parser.parse(pattern)])
    return _all([query, _exact_query(texts)])


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams_of(q) for q in query[1]))


# --- Inverted index of a segment ---------------------------------------------------------------


class Segment:
    """Postings of the wanted trigrams over the texts of one batch: trigram -> ascending text numbers."""

    def __init__(self, texts: list[str], wanted: set[bytes]):
        self.size = len(texts)
        self.postings = dict.fromkeys(wanted, np.empty(0, np.int64))
        if not wanted or not texts:
            return
        # Two zero bytes between texts keep trigrams from crossing over.
        parts = [t.encode("utf-8", "replace").lower() + b"\0\0" for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8)
        codes = np.array(sorted(int.from_bytes(t, "big") for t in wanted), np.uint32)
        firsts = np.zeros(1 << 16, bool)
        firsts[codes >> np.uint32(8)] = True
        pairs = (data[:-2].astype(np.uint16) << 8) | data[1:-1]
        at = np.flatnonzero(firsts[pairs])
        full = (pairs[at].astype(np.uint32) << np.uint32(8)) | data[at + 2]
        hit = np.isin(full, codes)
        at, full = at[hit], full[hit]
        owner = np.searchsorted(np.cumsum([len(p) for p in parts]), at, side="right")
        order = np.argsort(full, kind="stable")
        full, owner = full[order], owner[order]
        for code in codes:
            low, high = np.searchsorted(full, [code, code + np.uint32(1)])
            self.postings[int(code).to_bytes(3, "big")] = np.unique(owner[low:high])

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if query[0] == "tri":
            return self.postings[query[1]]
        parts = sorted((self.candidates(q) for q in query[1]), key=len)
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        found = parts[0]
        for p in parts[1:]:
            found = np.intersect1d(found, p, assume_unique=True)
        return found


def scan(texts: list[str], rules: tuple[Rule, ...] = RULES) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """Per text, (start, rule number, end) of every secret; and how many rules were run on it."""
    queries = [trigram_query(r.pattern) for r in rules]
    segment = Segment(texts, set().union(*map(trigrams_of, queries)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    scanned = np.zeros(len(texts), np.int32)
    for k, (rule, query) in enumerate(zip(rules, queries)):
        compiled = re.compile(rule.pattern, re.ASCII)
        for i in segment.candidates(query):
            scanned[i] += 1
            for m in compiled.finditer(texts[i]):
                if len(m[rule.group]) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    for spans in found:
        spans.sort()
    return found, scanned


def _joined(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in spans)


def find_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Spans of secrets in every whole text: counts and digest of the base kinds, and all spans.

    Every Arrow batch of a task is one segment of the inverted index, so the index is built,
    used and dropped inside the task, and no text is shuffled. Needs doc_id and text; other columns
    are ignored. A NULL or empty text has no spans. Repeated rows give repeated results. Spans
    start at code points and exclude the end; spans with the same start are listed in rule order.
    """
    bound_batches(docs.sparkSession)
    rules = BASE_RULES + tuple(more)
    n_base = len(BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scanned = scan([t or "" for t in batch.column("text").to_pylist()], rules)
            base = [[s for s in spans if s[1] < n_base] for spans in found]
            counts = [[sum(s[1] == k for s in spans) for spans in base] for k in range(n_base)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(_joined(s, rules).encode()).hexdigest() for s in base]),
                    pa.array([_joined(s, rules) for s in found]),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array(scanned, pa.int32()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "n_scanned"],
            )

    return pick(docs, "doc_id", "text").mapInArrow(run, RESULT)
