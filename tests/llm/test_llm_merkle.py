"""The Merkle manifest against plain hashing, also where blocks stack up, and on awkward tables."""

import hashlib
import zlib

import pytest
from llm_data import SCHEMA, WIDE, awkward, corpus, widened

from demandloom.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def level(nodes):
    return [nodes[i : i + 8] for i in range(0, len(nodes), 8)]


def walk(nodes, at):
    """Root, and (left, right) siblings of one node on each level."""
    path = []
    while len(nodes) > 1:
        run = level(nodes)[at // 8]
        path.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        nodes, at = [digest("".join(r)) for r in level(nodes)], at // 8
    return nodes[0], path


def plain(rows):
    def leaf(i, text, lang, source, n):
        return digest("".join(map(field, (i, source, lang, n, text))))

    trees = {}
    for i, text, lang, source, n in rows:
        lowered = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        own = leaf(i, text, lang, source, n)
        bad = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        trees.setdefault(lang, []).append((i, own, leaf(i, lowered, lang, source, n) if bad else own))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for v in trees.values():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subroots = [walk([x[1] for x in trees[g]], 0)[0] for g in langs]
    out = []
    for k, g in enumerate(langs):
        root, above = walk(subroots, k)
        for at, (i, own, other) in enumerate(trees[g]):
            path = walk([x[1] for x in trees[g]], at)[1] + above
            now = other
            for left, right in path:
                now = digest(left + now + right)
            out.append((i, own, subroots[k], root, digest("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=repr)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [awkward(), corpus(90), corpus(1), [(i, "A", "xx", None, i) for i in range(600)]], ids=len)
def test_manifest_matches_plain_hashing(spark, rows):
    got = listed(merkle.manifest(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)
    assert all(not r[6] or r[5] == r[3] for r in got)


def test_blocks_above_blocks(spark, monkeypatch):
    """Blocks of 8 leaves, so that 600 leaves need three layers of blocks."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, f"Text {i}", "en" if i % 9 else None, "s", i) for i in range(660)]
    assert listed(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_other_columns_and_empty_table(spark):
    assert listed(merkle.manifest(spark.createDataFrame(widened(awkward()), WIDE))) == plain(awkward())
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_is_found_by_every_changed_text(spark):
    rows = {r[0]: r for r in corpus(60)}
    for r in merkle.manifest(spark.createDataFrame(list(rows.values()), SCHEMA)).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in rows[r.doc_id][1])
        assert r.verified == (not changed)


def test_leaves_stay_in_bounded_rows(spark):
    """No row of blocks holds more than 4,096 leaves, whatever the size of a language."""
    rows = [(i, None, "en", None, None) for i in range(5000)]
    nodes = merkle.ranked(merkle.leaves(spark.createDataFrame(rows, SCHEMA)), "doc_id", "digest")
    assert [r["rank"] for r in nodes.orderBy("doc_id").collect()] == list(range(5000))
    phases = merkle.built(nodes)
    assert [p.count() for p in phases] == [2, 1]
    assert "Join" not in phases[0]._jdf.queryExecution().executedPlan().toString()
