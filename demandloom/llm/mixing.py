"""Mixing sources to target weights: iterative proportional fitting over a few marginals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import pick, settle, words

MARGINALS = ("source", "lang", "topic")
#: Without given targets, a category's share is its token share raised to this power, then scaled to 1.
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Tokens wanted, as a share of the input's.
RATE = 0.5
ROUNDS = 12
#: What a document looks like stands in for a topic label: (name, condition on the text).
TOPICS = (
    ("table", "text LIKE '% | %'"),
    ("shout", "text LIKE '%!!%'"),
    ("marked", "text LIKE '%##%' OR text LIKE '%$$%' OR text LIKE '%&&%'"),
)
OTHER_TOPICS = ((200, "short"), (2000, "medium"))
LONG_TOPIC = "long"


def topic(text: str, n_tokens: str) -> Column:
    """Topic of a document by the shape and length of its text."""
    chosen = None
    for name, condition in TOPICS:
        test = F.expr(condition.replace("text", text))
        chosen = F.when(test, name) if chosen is None else chosen.when(test, name)
    for most, name in OTHER_TOPICS:
        chosen = chosen.when(F.col(n_tokens) < most, name)
    return chosen.otherwise(LONG_TOPIC)


def with_shape(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens; a NULL text has no tokens and the topic `short`."""
    base = pick(docs, "doc_id", "text", "source", "lang")
    counted = base.select("doc_id", "text", "source", "lang", F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    return counted.select("doc_id", "source", "lang", topic("text", "n_tokens").alias("topic"), "n_tokens")


def rake(
    cells: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    rate: float = RATE,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Sampling probability per cell of (source, lang, topic), from its `tokens`.

    Weights start at the token counts. Every round scales them so that each marginal in turn meets
    its target, then trims them to tokens / rate, as no document can be drawn with a probability
    above 1; the next round makes up for what was trimmed. NULL is a category of its own. Targets
    may name a share for each category of a marginal; categories not named get the share 0, and
    marginals not named follow their tempered token shares. Cells without tokens get probability 0.
    """
    targets = targets or {}
    frame = cells.withColumn("w", F.col("tokens").cast("double"))
    whole = F.sum("tokens").over(Window.partitionBy())
    for m in MARGINALS:
        own = Window.partitionBy(m)
        if m in targets:
            share = F.coalesce(F.create_map(*[F.lit(x) for kv in targets[m].items() for x in kv])[F.col(m)], F.lit(0.0))
            frame = frame.withColumn(f"target_{m}", share * whole)
            continue
        power = F.pow(F.sum("tokens").over(own) / whole, F.lit(TEMPERATURE[m]))
        frame = frame.withColumn("power", F.when(whole > 0, power).otherwise(0.0))
        # Each category counts once in the scale: its cells share its power by their number.
        frame = frame.withColumn("part", F.col("power") / F.count(F.lit(1)).over(own))
        total = F.sum("part").over(Window.partitionBy())
        frame = frame.withColumn(f"target_{m}", F.when(total > 0, F.col("power") / total * whole).otherwise(0.0)).drop("power", "part")
    cap = F.col("tokens") / F.lit(rate)
    for r in range(rounds):
        for m in MARGINALS:
            now = F.sum("w").over(Window.partitionBy(m))
            frame = frame.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"target_{m}") / now).otherwise(0.0))
        frame = frame.withColumn("w", F.least("w", cap))
        if r % 4 == 3 and r + 1 < rounds:
            frame = settle(frame, "rake")
    probability = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(rate) * F.col("w") / F.col("tokens"))).otherwise(0.0)
    return frame.select(*MARGINALS, "tokens", F.round("w", 3).alias("weight"), F.round(probability, 9).alias("probability"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone, so a rerun samples the same documents."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def cells_of(shaped: DataFrame) -> DataFrame:
    return shaped.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens"))


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    rate: float = RATE,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Per document: its cell, tokens, the cell's probability, and whether it is sampled.

    Needs doc_id, text, source and lang; other columns are ignored. Documents without words have
    probability 0. A NULL id is never sampled. Repeated ids are drawn alike. The cells are summed
    from every document; their table is written to the shared folder, and Spark broadcasts it only
    if its measured size is under the session's threshold.
    """
    shaped = settle(with_shape(docs), "shaped")
    cells = settle(rake(settle(cells_of(shaped), "cells"), targets, rate, rounds), "raked")
    lookup = cells.select(*[F.col(m).alias(f"cell_{m}") for m in MARGINALS], "weight", "probability")
    match = F.lit(True)
    for m in MARGINALS:
        match = match & F.col(m).eqNullSafe(F.col(f"cell_{m}"))
    joined = shaped.join(lookup, match, "left")
    sampled = (F.col("n_tokens") > 0) & F.coalesce(draw(F.col("doc_id")) < F.col("probability"), F.lit(False))
    return joined.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", sampled.alias("sampled"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents with all their columns.

    Ids that occur more than once are kept or dropped together, as they are drawn alike, unless
    their cells differ; then the id stays if any of its rows is sampled.
    """
    chosen = mix(docs, **options).where("sampled").select(F.col("doc_id").alias("sampled_id")).distinct()
    at = docs.columns.index("doc_id")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = numbered.join(chosen, F.col(f"c{at}") == F.col("sampled_id"), "left_semi")
    return kept.toDF(*docs.columns)
