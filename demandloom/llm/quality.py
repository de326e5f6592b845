"""Quality rules as a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import SPACES, STOP_WORDS, let, pick, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Words that count as function words, as written and at the start of a sentence.
FUNCTION_WORDS = sorted({form for group in STOP_WORDS.values() for w in group for form in (w, w.capitalize())})


@dataclass(frozen=True)
class Rule:
    """A document passes if `low * per <= measure <= high * per`, all whole numbers."""

    name: str
    measure: str
    per: str
    low: float = 0.0
    high: float = float("inf")


#: Production thresholds. Ratios are compared after multiplication, so no division by zero can occur.
RULES = (
    Rule("length", "n_words", "one", 20, 100_000),
    Rule("word_length", "word_chars", "n_words", 2, 14),
    Rule("symbols", "n_symbols", "n_words", 0, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.04, 0.9),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0, 0.5),
    Rule("line_length", "n_words", "n_lines", 2, 20_000),
)


def repeated_words(tokens: Column) -> Column:
    """Words that lie in windows of 8 words found twice or more in the same text.

    Windows are compared by 64-bit hashes of word hashes; the sort runs only for texts in which
    a window repeats.
    """

    def covered(sorted_windows: Column) -> Column:
        twice = F.filter(
            sorted_windows,
            lambda e, k: F.coalesce(F.get(sorted_windows, k - 1)["h"] == e["h"], F.lit(False))
            | F.coalesce(F.get(sorted_windows, k + 1)["h"] == e["h"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), spans)

    def spans(starts: Column) -> Column:
        lengths = F.transform(
            starts, lambda s, k: F.coalesce(F.least(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")
        )
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b)

    def in_windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW)))), if_any)

    def if_any(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    short = F.size(tokens) <= WINDOW
    return F.when(short, F.lit(0).cast("long")).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), in_windows))


def _passes(rule: Rule) -> Column:
    measure, per = F.col(rule.measure), F.col(rule.per)
    tests = [measure >= F.lit(rule.low) * per]
    if rule.high != float("inf"):
        tests.append(measure <= F.lit(rule.high) * per)
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures of each whole text, one `<rule>_ok` column per rule, and the verdict.

    Needs doc_id and text; other columns are ignored. One row per input row, repeated rows and
    NULL ids included. A NULL or empty text has no words and fails `base_failed`.
    """
    base = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = base.select(
        "doc_id",
        "text",
        words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"),
    )
    measured = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(FUNCTION_WORDS))).cast("long").alias("n_stop_words"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.lit(1).cast("long").alias("one"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = ~failed
    for rule in rules:
        verdict = verdict & _passes(rule)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        *[_passes(r).alias(f"{r.name}_ok") for r in rules],
        failed.alias("base_failed"),
        verdict.alias("kept"),
    )
