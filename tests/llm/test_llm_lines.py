"""Candidates of the line join: few rows are written for them, and no match between long lines is lost."""

import random

import pytest
from llm_data import SCHEMA
from pyspark.sql import functions as F
from test_llm_near import lines_plain

from demandloom.llm import lines


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture
def written(monkeypatch):
    """The number of rows of each table that is written for pairs of lines."""
    found, settle = {}, lines.settle

    def counted(df, label):
        out = settle(df, label)
        if "to_doc" in out.columns:
            found[label] = out.count()
        return out

    monkeypatch.setattr(lines, "settle", counted)
    return found


@pytest.mark.parametrize("n", [120, 240])
def test_long_lines_of_common_words_are_no_candidates(spark, written, n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(3 * n)]
    texts = [" ".join(rng.sample(vocabulary, n)) for _ in range(150)]
    out = lines.remove_repeated_lines(rows_of(spark, texts)).collect()
    assert sum(r.n_removed for r in out) == 0
    assert written and max(written.values()) <= len(texts)


def test_near_copies_make_no_square(spark, written):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(w if rng.random() < 0.98 else f"x{rng.randrange(50)}" for w in base) for _ in range(150)]
    out = lines.remove_repeated_lines(rows_of(spark, texts)).collect()
    assert sum(r.n_removed for r in out) == 149
    assert max(written.values()) <= 2 * len(texts)


def test_long_near_lines_equal_all_pairs(spark):
    rng = random.Random(2)
    texts = []
    for n in (58, 64, 70, 120, 128, 135, 250, 300):
        base = [f"w{n}x{i}" if i % 2 else f"c{i}" for i in range(n)]
        for _ in range(9):
            kept = [w if rng.random() > 0.045 else f"y{rng.randrange(10**6)}" for w in base if rng.random() > 0.02]
            texts.append(" ".join(kept))
    rng.shuffle(texts)
    docs = rows_of(spark, texts)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.remove_repeated_lines(docs).collect()}
    assert got == lines_plain([(r.doc_id, r.text) for r in docs.collect()])
    assert 10 < sum(v[2] for v in got.values()) < len(texts) - 8


def test_parities_differ_at_most_where_words_do(spark):
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(-(1 << 58), 1 << 58), n)) for n in (5, 60, 64, 65, 90, 128, 129, 200)]
    sets += [sorted(rng.sample(s, len(s) - k) + [rng.randrange(1 << 58) for _ in range(j)]) for s in sets for k, j in ((0, 1), (2, 0), (3, 4))]
    given = spark.createDataFrame(list(enumerate(sets)), "id int, tokens array<bigint>").withColumn("n", F.size("tokens"))
    line = given.select("id", F.struct("n", *lines._parities(F.col("tokens"), F.col("n"))).alias("a"))
    both = line.crossJoin(line.toDF("to", "b")).select("id", "to", lines._differ("a", "b").alias("d"))
    for r in both.collect():
        apart = len(set(sets[r.id]) ^ set(sets[r.to]))
        assert r.d <= apart and (apart - r.d) % 2 == 0


def test_lines_meet_only_lines_of_about_their_size(spark):
    sizes = (8, 9, 10, 16, 40, 100)
    given = [(i, i, n, 0, 0, 0, 0, [5 << 58 | w << lines.LEFT_OUT for w in range(n // 5 + 1)]) for i, n in enumerate(sizes)]
    firsts = spark.createDataFrame(given, "line bigint, set bigint, n int, bits bigint, bits1 bigint, bits2 bigint, bits3 bigint, prefix array<bigint>")
    tokens = {}
    for r in lines._by_word(firsts).collect():
        tokens.setdefault(r.n, set()).add(r.token)
    met = {(a, b) for a in sizes for b in sizes if a < b and tokens[a] & tokens[b]}
    assert {(8, 9), (8, 10), (9, 10)} <= met and not {(8, 40), (10, 100), (16, 100), (16, 40), (40, 100)} & met
    assert all(len(tokens[n]) <= n // 5 + 1 + n // 9 + 1 for n in sizes)


@pytest.mark.parametrize("first, step", [(0, 1), ((1 << 32) - 70, 1), (-50, 1), (1 << 40, 1 << 30)])
def test_lines_at_the_borders_of_size_classes_equal_all_pairs(spark, first, step):
    rng = random.Random(4)
    texts = []
    for n in (4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65):
        base = [f"v{n}x{i}" for i in range(n)]
        for more in (0, n // 5, n // 4, n // 4 + 1):
            texts.append(" ".join(base + [f"z{n}x{i}" for i in range(more)]) + "\nsame line")
    rng.shuffle(texts)
    docs = spark.createDataFrame([(first + i * step, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.remove_repeated_lines(docs).collect()}
    assert got == lines_plain([(r.doc_id, r.text) for r in docs.collect()])


def test_texts_are_read_once_for_both_sides_of_pairs(spark, monkeypatch):
    rounds, settle = [], lines.settle
    monkeypatch.setattr(lines, "settle", lambda df, label: rounds.append(label) or settle(df, label))
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join(base[2:]), " ".join(base[:30] + [f"y{i}" for i in range(10)])]
    out = lines.remove_repeated_lines(rows_of(spark, texts)).collect()
    assert sum(r.n_removed for r in out) == 1
    assert rounds.count("texts") == rounds.count("judged") + rounds.count("left")
