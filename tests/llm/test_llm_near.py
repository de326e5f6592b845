"""Near-duplicates, repeated passages and repeated lines against plain all-pairs versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from llm_data import SCHEMA, corpus, edited, text

from demandloom.llm.lines import find_repeated_lines, remove_repeated_lines
from demandloom.llm.near import CHUNKS, MOST_DIFFERENT, POSITIONS, chunk_keys, components, near_duplicates
from demandloom.llm.repeats import Texts, recompress, remove_repeats, telling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_plain(rows, width):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width", [4, 5])
def test_components_equal_all_pairs(spark, width):
    rng = random.Random(width)
    rows = corpus()
    base = text(rng, "en", 12)
    rows += [(1000 + i, edited(rng, base, 0.004 * i), "en", "s", 1) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), width).collect()}
    want = near_plain(rows, width)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 10


def test_chunk_keys_meet_every_pair_within_the_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, POSITIONS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(POSITIONS, MOST_DIFFERENT, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, MOST_DIFFERENT).astype(np.uint16)
    assert MOST_DIFFERENT == 2 * CHUNKS - 1
    assert all(set(x) & set(y) for x, y in zip(chunk_keys(a).tolist(), chunk_keys(b).tolist()))
    assert len(set(chunk_keys(a).ravel().tolist())) == a.shape[0] * POSITIONS


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 250: 200, 300: 200}


def repeats_plain(rows):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), left, hashlib.sha256(left.encode()).hexdigest())
    return out


def test_repeated_passages_equal_a_scan_of_all_windows(spark):
    rng = random.Random(8)
    rows = corpus()
    unit = text(rng, "en", 1)
    rows += [(500, " ".join([unit] * 6), "en", "s", 1), (501, "a b " * 40, "en", "s", 1), (502, "a " * 19, "en", "s", 1), (503, "b a " * 40, "en", "s", 1)]
    want = repeats_plain(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 1000


def test_symbols_inside_a_passage_do_not_depend_on_its_surroundings():
    """Telling symbols whose context lies inside a shared passage are the same wherever it stands."""
    rng = random.Random(2)
    for trial in range(200):
        letters = rng.choice([2, 3, 50])
        passage = [f"w{rng.randrange(letters)}" for _ in range(20)]
        around = [[f"w{rng.randrange(letters)}" for _ in range(rng.randrange(8))] for _ in range(4)]
        found = []
        for before, after in ((around[0], around[1]), (around[2], around[3])):
            texts = Texts([" ".join(before + passage + after)], {})
            s = recompress(texts.word, texts.starts)
            inside = telling(s) & (s.low >= len(before)) & (s.high <= len(before) + 20)
            found.append(list(zip(s.name[inside], s.start[inside] - len(before), s.end[inside] - len(before))))
        assert found[0] == found[1], trial


def lines_plain(rows):
    sets, out = [], {}
    for i, t, *_ in sorted(rows):
        kept = []
        for line in t.split("\n"):
            w = set(WORD.findall(line.lower()))
            if w and any(5 * len(w & s) >= 4 * len(w | s) for s in sets):
                sets.append(w)
                continue
            if w:
                sets.append(w)
            kept.append(line)
        out[i] = ("\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept))
    return out


def test_line_removal_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = corpus()
    line = text(rng, "en", 1)
    shorts = ["a b c d", "a b c d e", "A b c d", "b a", "a b", "a", "a b c d e f g h i j", "a b c d e f g h i x", "a b c d e f g h x y"]
    rows += [(2000 + i, edited(rng, line, 0.02 * (i % 9)) + "\n" + shorts[i % len(shorts)] + "\n" + " ".join(rng.sample("abcdefg", 5)), "en", "s", 1) for i in range(40)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in remove_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = lines_plain(rows)
    assert got == want


def test_found_lines_equal_all_pairs(spark):
    rng = random.Random(9)
    base = [text(rng, "en", 1) for _ in range(6)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), 0.03 * (i % 8)) for _ in range(4)) + "\n \n" + "x y z w"[: 2 * (i % 4) + 1], "en", "s", 1) for i in range(60)]
    want = lines_plain(rows)
    found = {r.doc_id: r for r in find_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(r.n_removed for r in found.values()) > 50
    for i, t, *_ in rows:
        lines, gone = t.split("\n"), {int(x) for x in found[i].removed.split(",") if x}
        left = "\n".join(x for at, x in enumerate(lines) if at not in gone)
        assert (left, found[i].n_lines, found[i].n_removed) == want[i] and len(gone) == found[i].n_removed
