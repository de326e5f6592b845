"""The pipeline's stages against plain versions, one after the other, and the queries as registered."""

from llm_data import SCHEMA, corpus
from test_llm_near import lines_plain, near_plain

import __spark_entry__ as entry
import corpus_pipeline
from demandloom.llm.common import settle
from demandloom.llm.language import identify
from demandloom.llm.mixing import mix


def test_stages_keep_what_their_operator_keeps(spark):
    docs = spark.createDataFrame(corpus(120) + [(900, "12 34", "en", "s", 5), (901, None, "en", "s", None)], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.collect()}

    kept = settle(stages["language_id"](spark, docs, ""), "t")
    assert ids(kept) == {r.doc_id for r in identify(docs).collect() if not r.ambiguous} and not ids(kept) & {900, 901}
    assert len(ids(kept)) > 110

    lines = settle(stages["line_dedup"](spark, kept, ""), "t")
    want = {i: t for i, (t, *_) in lines_plain([(r.doc_id, r.text) for r in kept.collect()]).items() if t.split()}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = settle(stages["near_dedup"](spark, lines, ""), "t")
    assert ids(near) == {i for i, (_, c) in near_plain([(r.doc_id, r.text) for r in lines.collect()], 5).items() if i == c}

    mixed = settle(stages["source_mixing"](spark, near, ""), "t")
    assert ids(mixed) == {r.doc_id for r in mix(near).collect() if r.sampled} and 0 < len(ids(mixed)) < len(ids(near))

    packed = stages["packing"](spark, mixed, "").collect()
    assert {r.doc_id for r in packed} == ids(mixed)
    assert sum(r.n_tokens for r in packed) == sum(len(r.text.encode().split()) for r in mixed.collect())


def test_registered(spark, small):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    rows = entry.queries()["pipeline"](spark, small).collect()
    assert len(rows) > 50
