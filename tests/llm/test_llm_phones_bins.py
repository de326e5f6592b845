"""Phones in all their written forms, and repeated rows over many shards."""

import time

import pytest
from pyspark.sql import functions as F

from demandloom.llm.packing import SHARD_ROWS, pack
from demandloom.llm.pseudonyms import DEFAULT_KEY, Feistel, _only_digits, country_code, pseudonymise

FORMS = [
    ["+1 415 555 0100", "+14155550100", "+1 (415) 555-0100", "(415) 555-0100", "415-555-0100", "+1-415-555-0100"],
    ["+442079460958", "+44 20 7946 0958", "+44 (20) 7946 0958"],
    ["+4915112345678", "+49 151 1234 5678"],
    ["+351 912 345 678", "+351912345678"],
    ["+1 (017) 555-7713", "+10175557713"],
]


@pytest.fixture(scope="module")
def f():
    return Feistel(DEFAULT_KEY)


@pytest.mark.parametrize("forms", FORMS, ids=lambda x: x[0])
def test_one_number_has_one_pseudonym(f, forms):
    code = country_code(_only_digits(forms[0]))
    found = set()
    for form in forms:
        new, spans = pseudonymise(f"call {form} now", f)
        assert [k for _, _, k in spans] == ["phone"]
        shown = new.removeprefix("call ").removesuffix(" now")
        # The form stays: digits stand where digits stood.
        assert [c if not c.isdigit() else "0" for c in shown] == [c if not c.isdigit() else "0" for c in form]
        digits = _only_digits(shown)
        if form.startswith("+"):
            assert digits.startswith(code)
            digits = digits[len(code) :]
        found.add(digits)
        assert pseudonymise(new, f, back=True)[0] == f"call {form} now"
    assert len(found) == 1 and found != {_only_digits(forms[0])[len(code) :]}


def test_american_numbers_stay_valid_and_others_stay_others(f):
    seen = set()
    for i in range(3000):
        number = f"{(i * 37) % 1000:03d}{(i * 91) % 1000:03d}{i:04d}"
        text = f"+1{number}"
        new = pseudonymise(text, f)[0]
        assert (number[0] >= "2" and number[3] >= "2") == (new[2] >= "2" and new[5] >= "2")
        assert pseudonymise(new, f, back=True)[0] == text
        seen.add(new)
    assert len(seen) == 3000


def test_country_codes():
    assert [country_code(d) for d in ("14155550100", "79161234567", "442079460958", "351912345678", "4915112345678", "21612345678")] == ["1", "7", "44", "351", "49", "216"]


def test_equal_rows_fill_many_shards(spark):
    n = 100_000
    items = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit(100).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("cluster"))
    began = time.time()
    packed = pack(items).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("bin").alias("bins")).collect()
    assert time.time() - began < 60
    assert sum(r.n for r in packed) == n and len(packed) == -(-n // SHARD_ROWS)
    assert max(r.n for r in packed) < 1.5 * SHARD_ROWS
    assert all(r.bins == -(-r.n // 20) for r in packed)
