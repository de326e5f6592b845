"""Hard negatives: positives' upper limits cut an anchor's scores into slots; the best of each slot answer all windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import pick, settle

POSITIVES, NEGATIVES = 5, 3
#: A negative must score at least 50 and at most 95 percent of its positive.
LEAST, MOST = 50, 95
#: Rows and anchors of a block, blocks that meet under one join key, and rows scored at a time.
ROWS, ANCHORS, GROUP, CHUNK = 8192, 1024, 8, 2048
#: Components of a block at most, where its vectors are long: 8 MB.
VALUES = 1 << 20
NO_LIMIT = -(1 << 62)

BLOCK = "n int, dim int, ids binary, labels binary, vectors binary, uppers binary, lowers binary"
SCORED = "anchor_id long, slot int, score long, vec_id long"


def whole_vectors(rows: DataFrame, relabel: bool = True) -> DataFrame:
    """vec_id, label, vector of floor(256 x), one row per vec_id; rows that cannot take part are left out."""
    base = pick(rows, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    good = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")) if relabel else F.col("label")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    one = good.select("vec_id", F.struct(label.alias("label"), whole.alias("vector")).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return one.select("vec_id", "row.label", "row.vector")


def _pack(batches: list[pa.RecordBatch]) -> dict:
    table = pa.Table.from_batches(batches)
    vectors = table["vector"].combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    dim = int(lengths.max(initial=0))
    matrix = np.zeros((len(table), dim), np.int64)  # shorter vectors are filled with zeros
    matrix[np.arange(dim) < lengths[:, None]] = vectors.flatten().to_numpy()
    out = {"n": len(table), "dim": dim, "ids": table["vec_id"], "labels": table["label"], "vectors": matrix.ravel()}
    for name in ("uppers", "lowers"):
        out[name] = np.concatenate([[], *table[name].to_pylist()]).astype(np.int64) if name in table.column_names else None
    return {k: v if v is None or isinstance(v, int) else np.asarray(v, np.int64).tobytes() for k, v in out.items()}


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of up to `size` rows and VALUES components, written; a task holds one block at a time."""
    schema = pa.schema([("n", pa.int32()), ("dim", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "vectors", "uppers", "lowers")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        dim = rows_held = 0
        for batch in batches:
            lengths = np.diff(batch.column("vector").offsets.to_numpy())
            dim = max(dim, int(lengths.max(initial=0)))
            most = max(1, min(size, VALUES // max(dim, 1)))
            while batch.num_rows:
                if rows_held >= most:
                    yield pa.RecordBatch.from_pylist([_pack(held)], schema)
                    held, rows_held = [], 0
                held.append(batch.slice(0, most - rows_held))
                batch = batch.slice(held[-1].num_rows)
                rows_held += held[-1].num_rows
        if held:
            yield pa.RecordBatch.from_pylist([_pack(held)], schema)

    return settle(rows.mapInArrow(run, BLOCK), "vectors")


def _numbers(row: dict, name: str, *shape: int) -> np.ndarray:
    return np.frombuffer(row[name], np.int64).reshape(shape)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they cannot round, else in longs."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound >= 2.0**62:
        raise OverflowError("inner products do not fit a long")
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if bound < 2.0**52 else a @ b.T


class Best:
    """The best k (score, vec_id) per anchor and slot of what has been seen."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.found = k, np.zeros((0, 4), np.int64)
        self.worst = np.full((anchors, slots), NO_LIMIT)

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        good = score >= self.worst[anchor, slot]
        new = np.stack([x[good] for x in (anchor, slot, score, vec_id)], 1).astype(np.int64)
        rows = np.concatenate([self.found, new])
        rows = rows[np.lexsort((rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
        key = rows[:, 0] * self.worst.shape[1] + rows[:, 1]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        self.found = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.worst[last[:, 0], last[:, 1]] = last[:, 2]


def _score(pair: dict, k: int, same_label: bool) -> pa.RecordBatch:
    """Best k of one block of rows for one block of anchors, per slot of the score."""
    n, m, dim = pair["a_n"], pair["n"], pair["a_dim"]
    ids, labels = _numbers(pair, "a_ids", n), _numbers(pair, "a_labels", n)
    own = _numbers(pair, "a_vectors", n, dim)
    all_ids, all_labels, others = _numbers(pair, "ids", m), _numbers(pair, "labels", m), _numbers(pair, "vectors", m, pair["dim"])
    width = min(dim, pair["dim"])  # components that one of the two lacks count as zeros
    uppers = None if same_label else _numbers(pair, "a_uppers", n, -1)
    lowers = None if same_label else _numbers(pair, "a_lowers", n, -1).min(1)
    best = Best(n, 1 if same_label else uppers.shape[1], k)
    for at in range(0, m, CHUNK):
        part = slice(at, at + CHUNK)
        scores = _products(own[:, :width], others[part, :width])
        alike = labels[:, None] == all_labels[None, part]
        if same_label:
            hit = alike & (ids[:, None] != all_ids[None, part])
            a, r = np.nonzero(hit)
            slot = np.zeros(len(a), np.int64)
        else:
            a, r = np.nonzero(~alike & (scores <= uppers[:, :1]) & (scores >= lowers[:, None]))
            # Limits descend, so the slot is the last limit that is not below the score.
            slot = (uppers[a] >= scores[a, r][:, None]).sum(1) - 1
        best.add(a, slot, scores[a, r], all_ids[part][r])
    a, slot, score, vec_id = best.found.T
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[a]), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(vec_id)], names=["anchor_id", "slot", "score", "vec_id"]
    )


def best_by_slot(anchors: DataFrame, rows: DataFrame, groups: int, k: int, same_label: bool) -> DataFrame:
    """anchor_id, slot, score, vec_id: the best k rows per anchor and slot.

    Every block of anchors meets every block of rows under the rows' group. Each pair of blocks keeps
    its best; what pairs of one task find is combined before the shuffle, the rest after it.
    """
    asked = anchors.select([F.col(c).alias(f"a_{c}") for c in anchors.columns]).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = rows.drop("uppers", "lowers").withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _score(batch.slice(i, 1).to_pylist()[0], k, same_label)

    scored = dealt.join(asked, "group").drop("group").mapInArrow(run, SCORED)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _limit(score: Column, percent: int, up: bool) -> Column:
    """Least whole number n with 100 n >= percent * score, or the greatest with 100 n <= percent * score."""
    n = F.floor(percent * score / F.lit(100).cast("decimal(20,0)")) if not up else F.ceil(percent * score / F.lit(100).cast("decimal(20,0)"))
    return n.cast("long")


def _suffixes(slots: Column, k: int) -> Column:
    """For each slot the best k of it and all lower ones: merged from the lowest slot upwards."""
    empty = F.array().cast("array<struct<down:bigint,vec_id:bigint>>")
    start = F.struct(empty.alias("best"), F.array().cast("array<array<struct<down:bigint,vec_id:bigint>>>").alias("all"))

    def step(state: Column, own: Column) -> Column:
        best = F.slice(F.array_sort(F.concat(state["best"], own)), 1, k)
        return F.struct(best.alias("best"), F.concat(F.array(best), state["all"]).alias("all"))

    return F.aggregate(F.reverse(slots), start, step, lambda s: s["all"])


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, relabel: bool = True) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Needs vec_id, embedding and label; other columns are ignored. Rows with a NULL vec_id, label or
    vector, or with a NULL or non-finite component, take no part. Of several rows with one vec_id the
    one with the smallest label, then vector, counts. Components become floor(256 x); of vectors of
    different lengths the shorter is filled with zeros. Scores are whole inner products, higher first,
    ties by vec_id; they must fit a long, else the job fails. `relabel` applies the task's change of
    label where 7 divides vec_id. Anchors are the rows whose vec_id `every` divides; their positives
    are the first `positives` others of their label.

    1. Blocks of anchors meet all blocks of rows and keep their best rows of the same label.
    2. The positives' upper limits, highest first, cut the scores of an anchor into disjoint slots. The
       blocks meet again and keep the best `negatives` per slot.
    3. A positive's window holds its own slot and all lower ones, down to its lower limit, so running
       merges from the lowest slot upwards answer all windows.

    A positive without a negative in its window, as every one with a negative score, gives no row.
    """
    vectors = settle(whole_vectors(rows, relabel), "whole")
    packed = blocks(vectors, ROWS)
    groups = max(1, -(-packed.count() // GROUP))
    asked = vectors.where(F.col("vec_id") % every == 0)
    count = max(1, -(-asked.count() // ANCHORS))
    found = best_by_slot(blocks(asked.repartition(count, "vec_id"), ANCHORS), packed, groups, positives, True)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id")))
    near = settle(found.groupBy("anchor_id").agg(ordered.alias("positives")), "positives")

    # Every anchor has as many limits as it may have positives; missing ones hold no score.
    scores = F.transform("positives", lambda p: -p["down"])
    padding = F.array_repeat(F.lit(NO_LIMIT).cast("long"), F.lit(positives) - F.size("positives"))
    limits = near.select(
        F.col("anchor_id").alias("vec_id"),
        F.concat(F.transform(scores, lambda s: _limit(s, MOST, False)), padding).alias("uppers"),
        F.concat(F.transform(scores, lambda s: _limit(s, LEAST, True)), F.array_repeat(F.lit(-NO_LIMIT).cast("long"), F.lit(positives) - F.size("positives"))).alias("lowers"),
    )
    bounded = blocks(asked.join(limits, "vec_id").repartition(count, "vec_id"), ANCHORS)
    slots = best_by_slot(bounded, packed, groups, negatives, False)
    entry = F.struct("slot", (-F.col("score")).alias("down"), "vec_id")
    hits = slots.groupBy("anchor_id").agg(F.collect_list(entry).alias("hits"))
    per_slot = F.transform(
        F.sequence(F.lit(0), F.lit(positives - 1)),
        lambda i: F.transform(F.filter("hits", lambda h: h["slot"] == i), lambda h: F.struct(h["down"].alias("down"), h["vec_id"].alias("vec_id"))),
    )
    answers = hits.join(near, "anchor_id").select("anchor_id", "positives", _suffixes(per_slot, negatives).alias("best"))
    each = answers.select("anchor_id", "best", F.posexplode("positives").alias("i", "positive"))
    fits = F.filter(F.col("best")[F.col("i")], lambda h: -100 * h["down"] >= -LEAST * F.col("positive.down"))
    rows_out = each.select("anchor_id", "positive", F.posexplode(fits).alias("place", "negative"))
    return rows_out.select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"),
        F.col("negative.vec_id").alias("negative_id"), (-F.col("positive.down")).alias("positive_score"), (-F.col("negative.down")).alias("negative_score"),
    )
