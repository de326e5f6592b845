"""SpotSigs fingerprints: chains of content words after common words, compared by Jaccard."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import STOP_WORDS, bound_batches, pick, settle

#: Content words per chain.
CHAIN = 2
ANCHORS = frozenset(w.encode() for group in STOP_WORDS.values() for w in group)
#: A word chosen by its hash opens a chain if no common word stands within so many words of it, and
#: if none of so many words on either side has a smaller hash.
BARREN, CHOSEN = 8, 2
RANGE_ROWS = 4000
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots int, length_band int"


def bare(word: str) -> str:
    """The word without outer marks and symbols."""
    start, end = 0, len(word)
    while start < end and unicodedata.category(word[start])[0] in "PS":
        start += 1
    while start < end and unicodedata.category(word[end - 1])[0] in "PS":
        end -= 1
    return word[start:end]


def _chosen(word: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Starts of chains of neighbouring words, where common words are missing; they depend on words nearby only."""
    n = len(word)
    counted = np.append(0, np.cumsum(anchor))
    at = np.arange(n)
    chosen = counted[np.minimum(at + BARREN + 1, n)] == counted[np.maximum(at - BARREN, 0)]
    if chosen.any():
        for i in range(1, CHOSEN + 1):
            chosen[i:] &= word[i:] <= word[:-i]
            chosen[:-i] &= word[:-i] <= word[i:]
    return np.flatnonzero(chosen[: max(0, n - CHAIN)])


class Spots:
    """Spot signatures of texts; remembers the hashes of words, up to a bound."""

    def __init__(self, most_words: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.most = most_words

    def _word(self, word: bytes) -> int:
        """Hash of a bare word, 0 for symbols alone; the lowest bit tells anchors from content words."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            kept = bare(word.decode()).encode()
            found = xxhash.xxh3_64_intdigest(kept) & ~1 | (kept in ANCHORS) if kept else 0
            self.known[word] = found
        return found

    def signatures(self, text: str) -> np.ndarray:
        """Ascending 32-bit signatures, also of chains after chosen words. A text with words but no full chain gets one for all its words."""
        tokens = text.lower().encode("utf-8", "replace").split()
        if not tokens:
            return np.empty(0, np.uint32)
        word = np.fromiter(map(self._word, tokens), np.uint64, len(tokens))
        word = word[word != 0]
        anchor = (word & np.uint64(1)).astype(bool)
        content, at = word[~anchor], np.flatnonzero(anchor)
        first = at - np.arange(len(at))  # content words before the anchor
        full = first + CHAIN <= len(content)
        extra = _chosen(word, anchor if full.any() else np.zeros(len(word), bool))
        if not full.any() and not len(extra):
            whole = word.tobytes() if len(word) else b" ".join(tokens)
            return np.array([xxhash.xxh3_64_intdigest(whole) >> 32], np.uint32)
        mixed = np.append(word[at[full]], word[extra])
        for i in range(CHAIN):
            follows = np.append(content[first[full] + i], word[extra + 1 + i])
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + follows
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def written(signatures: np.ndarray) -> str:
    """Fingerprint as text: base64 of the ascending signatures, four little-endian bytes each."""
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def length_band(size: int, threshold: float = 0.8) -> int:
    """Partition by set length: sets whose bands differ by more than one cannot reach the threshold."""
    return int(np.floor(np.log(max(size, 1)) / -np.log(threshold))) if size else -1


def _step(id_column: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most the id, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    table = F.lit(cuts)
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda low, step: F.when((low + step <= len(cuts)) & (F.get(table, low + step - 1) <= id_column), low + step).otherwise(low),
    )


def _in_order(docs: DataFrame, range_rows: int) -> DataFrame:
    """Documents dealt to ranges of ids, ordered in each, with the next range's first id as a tail.

    One shuffle of the texts: the cuts come from a sketch of the ids, the first id of each range from
    a sum over ids alone. NULL ids belong to the first range and stand before all others.
    """
    spark = docs.sparkSession
    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = base.count()
    ranges = max(1, min(n // range_rows, 20_000))
    cuts: list[int] = []
    if ranges > 1:
        found = base.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
        cuts = sorted(set(found or []))
    step = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_step(F.col("doc_id"), cuts))
    ids = base.select(step.alias("part"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    # One row per range: at most as many as there are cuts.
    firsts = sorted((r.part, r.id) for r in ids.groupBy("part").agg(F.min("id").alias("id")).collect())
    tails = [(firsts[(i + 1) % len(firsts)][1], firsts[i][0]) for i in range(len(firsts))]
    tail = spark.createDataFrame(tails or [(0, 0)], "tail_of_id long, tail_of_part int").where(F.lit(bool(tails)))
    keyed = base.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("part", step)
    joined = keyed.join(F.broadcast(tail), F.col("id") == F.col("tail_of_id"), "left")
    own = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("tail")))
    extra = F.array(F.struct(F.col("tail_of_part").alias("part"), F.lit(1).alias("tail")))
    placed = joined.select(
        "doc_id", "text", F.explode(F.when(F.col("tail_of_part").isNull(), own).otherwise(F.concat(own, extra))).alias("at")
    ).select("doc_id", "text", F.col("at.part").alias("part"), F.col("at.tail").alias("tail"))
    return placed.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "tail", "doc_id", "text")


def fingerprint(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text has its last quarter of code points replaced by the start of the next document,
    in ascending doc_id; the first follows the last. Needs doc_id and text; other columns are
    ignored. NULL counts as an empty text, whose fingerprint is empty; two empty ones are alike.
    Documents with the same id follow each other in the order of their texts, NULL ids come first;
    repeated rows give one result each.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = Spots()
        held = None  # part, id, text, signatures of the row before
        rows: list[tuple] = []

        def result(row, next_text, next_signatures):
            _, doc_id, text, own = row
            cut = len(text) // 4
            edited = text[: len(text) - cut] + next_text[:cut]
            changed = own if edited == text else spots.signatures(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
            return (doc_id, len(text), digest, written(own), written(changed), jaccard(own, changed), jaccard(own, next_signatures), len(own), length_band(len(own)))

        def flush():
            names = [f.split()[0] for f in RESULT.split(", ")]
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.int32()]
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for doc_id, text, part, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "tail"))):
                if held and held[0] == part:
                    own = spots.signatures(text)
                    rows.append(result(held, text, own))
                    held = None if tail else (part, doc_id, text, own)
                elif not tail:
                    held = (part, doc_id, text, spots.signatures(text))
                if len(rows) >= 128:
                    yield flush()
        if rows:
            yield flush()

    return _in_order(docs, range_rows).mapInArrow(run, RESULT)


def similar_pairs(fingerprints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of distinct fingerprints whose Jaccard likeness reaches the threshold.

    Needs fingerprint; gives fingerprint_a < fingerprint_b and likeness. Copies are folded first.
    A set meets others only through the signatures of its prefix, ordered by a hash, and only in its
    own or the next length band, so most sets are pruned before they are compared.
    """
    bound_batches(fingerprints.sparkSession)
    sets = settle(fingerprints.select("fingerprint").where("fingerprint <> ''").distinct(), "spots")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys, bands, sizes = [], [], [], []
            for name in batch.column("fingerprint").to_pylist():
                found = read(name)
                n = len(found)
                order = np.sort(found.astype(np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32))
                prefix = order[: n - int(np.ceil(threshold * n - 1e-9)) + 1]
                names += [name] * len(prefix)
                keys += prefix.tolist()
                bands += [length_band(n, threshold)] * len(prefix)
                sizes += [n] * len(prefix)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(keys, pa.int64()), pa.array(bands, pa.int32()), pa.array(sizes, pa.int32())],
                names=["fingerprint", "spot", "band", "n"],
            )

    rows = sets.mapInArrow(prefixes, "fingerprint string, spot long, band int, n int")
    left = rows.select(F.col("fingerprint").alias("a"), "spot", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("n").alias("na"))
    right = rows.select(F.col("fingerprint").alias("b"), "spot", "band", F.col("n").alias("nb"))
    near = (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))
    pairs = left.join(right, ["spot", "band"]).where(near & (F.col("a") != F.col("b")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likeness = [jaccard(read(a), read(b)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(likeness, pa.float64())], names=["fingerprint_a", "fingerprint_b", "likeness"]
            )

    return pairs.mapInArrow(compare, "fingerprint_a string, fingerprint_b string, likeness double").where(F.col("likeness") >= threshold)
