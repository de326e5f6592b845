"""Every operator and stage on awkward rows, on clashing extra columns, and on an empty table."""

import pytest
from llm_data import SCHEMA, WIDE, awkward, corpus, widened

import corpus_pipeline
from demandloom.llm.language import fit, identify, predict
from demandloom.llm.lines import drop_repeated_lines, remove_repeated_lines
from demandloom.llm.mixing import mix
from demandloom.llm.near import near_duplicates
from demandloom.llm.packing import pack_documents
from demandloom.llm.pseudonyms import replace_personal_data
from demandloom.llm.quality import quality
from demandloom.llm.repeats import remove_repeats
from demandloom.llm.secrets import find_secrets
from demandloom.llm.spots import fingerprint

ROW_BY_ROW = {
    "quality": quality, "near": near_duplicates, "language": identify, "secrets": find_secrets, "spots": fingerprint,
    "pseudonyms": replace_personal_data, "repeats": remove_repeats, "mixing": mix, "lines": remove_repeated_lines,
}


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_one_row_each_whatever_else_the_table_holds(spark, plain, name):
    run = ROW_BY_ROW[name]
    rows = listed(run(plain))
    assert [r[0] for r in rows if r[0] is not None].__len__() == 16 and len(rows) == 18
    wide = spark.createDataFrame(widened(awkward()), WIDE)
    assert listed(run(wide)) == rows


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_empty_table(spark, name):
    out = ROW_BY_ROW[name](spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and "doc_id" in out.columns


def test_packing_of_awkward_rows(spark, plain):
    rows = pack_documents(plain, capacity=64).collect()
    assert sum(r.n_tokens for r in rows) == sum(len((t[1] or "").encode().split()) for t in awkward())
    assert all((r.bin is None) == (r.n_tokens == 0) for r in rows)
    wide = spark.createDataFrame(widened(awkward()), WIDE)
    assert listed(pack_documents(wide, capacity=64)) == listed(pack_documents(plain, capacity=64))
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_language_rules_for_missing_text(spark, plain):
    got = {r.doc_id: r for r in identify(plain).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 9, 10)] == ["und"] * 5
    assert got[1].score == 0 and got[1].ambiguous
    unlabelled = fit(plain.where("lang = 'none'"))
    assert {r.lang_pred for r in predict(plain, unlabelled).collect()} == {"und"}


def test_near_rules_for_missing_ids_and_ties(spark, plain):
    rows = near_duplicates(plain).collect()
    assert {(r.component_id, r.kept) for r in rows if r.doc_id is None} == {(None, True)}
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id in (4, 5, 7, 8, 1, 2)} == {
        (4, 4, True), (5, 4, False), (7, 7, True), (8, 7, False), (1, 1, True), (2, 2, True)
    }


def test_repeats_rules_for_repeated_rows_and_missing_ids(spark, plain):
    rows = remove_repeats(plain).collect()
    copies = {r.doc_id: r.n_removed for r in rows if r.n_words == len(awkward()[3][1].split())}
    # The text without an id stands first and stays whole; its copies lose all words.
    assert copies[None] == 0 and copies[4] == copies[5] == len(awkward()[3][1].split())
    assert next(r for r in rows if r.doc_id == 12).n_removed == 300 - 20 + 19


def test_repeats_of_texts_with_one_id(spark):
    # The upper 31 bits of the two texts' hashes agree.
    passage = " ".join(f"p{k}" for k in range(25))
    own, copy = " ".join(f"a23307w{k}" for k in range(25)), f"{passage} b31914"
    for i in (5, None):
        docs = spark.createDataFrame([(i, own), (i, copy), (-(1 << 62) if i else None, passage)], "doc_id long, text string")
        got = {r.text: r.n_removed for r in remove_repeats(docs).collect()}
        assert got[own] == 0 and sum(got.values()) == 25


def test_lines_rules(spark, plain):
    rows = {r.doc_id: r for r in remove_repeated_lines(plain).collect()}
    assert rows[1].text is None and rows[1].n_lines == 0
    assert (rows[2].text, rows[9].text) == ("", "\n\n\n")
    assert (rows[7].text, rows[8].text, rows[8].n_removed) == ("one", "", 1)


def test_lines_of_repeated_rows_stay(spark):
    rows = [(1, "alpha beta gamma\ndelta epsilon zeta"), (1, "alpha beta gamma\ndelta epsilon zeta"), (2, "delta epsilon zeta\neta theta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert listed(remove_repeated_lines(docs)) == [(1, rows[0][1], 2, 0)] * 2 + [(2, "eta theta", 2, 1)]
    assert listed(drop_repeated_lines(docs)) == [rows[0], rows[0], (2, "eta theta")]


def test_lines_of_many_texts_without_ids(spark):
    line = lambda i, k: " ".join(f"w{i}x{k}x{j}" for j in range(4))
    texts = [f"{'one line in every other text' if i % 2 else line(i, 0)}\n{line(i, 1)}" for i in range(1000)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    whole, cut = set(texts), {t.split("\n")[1] for t in texts[1::2]}
    for out in (remove_repeated_lines(docs), drop_repeated_lines(docs)):
        got = [r.text for r in out.collect()]
        assert len(got) == len(set(got)) == 1000 and len(whole & set(got)) == 501 and len(cut & set(got)) == 499


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    last = stage == corpus_pipeline.STAGES[-1][0]
    for rows, schema in ((awkward(), SCHEMA), ([], SCHEMA), (widened(awkward() + corpus(20)), WIDE)):
        docs = spark.createDataFrame(rows, schema)
        out = run(spark, docs, "")
        got = out.collect()
        if not last:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            assert len(got) <= len(rows)
