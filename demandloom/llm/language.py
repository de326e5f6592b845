"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import bound_batches, pick

BUCKETS = 1 << 15
#: Upper bound, in expectation, of the labelled rows that the classifiers are fitted on; a tenth
#: as many more rows set the scales of their margins. All other steps read every row.
FIT_ROWS = 20_000
SLOT = 2048
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are no ASCII letters become spaces; bytes of other letters stay.
TO_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, code_distance int"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a NULL id is not held out, and not learned from either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every 3-byte gram of the texts, and where each text's grams begin."""
    parts = [b" " + t.lower().encode("utf-8", "replace").translate(TO_LETTERS) + b"  " for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32), starts


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one per language: every way to split up to 7 languages in two, else random splits.

    Of the random codes, the one with the largest least distance of 50 seeded draws is taken.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1.0 if (s >> i) & 1 else -1.0 for s in splits] for i in range(n)])
    width = 15 * int(np.ceil(np.log2(n)))
    best, found = None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, width))
        gap = int(min(((code[i] != code[j]).sum()) for i in range(n) for j in range(i)))
        if gap > found:
            best, found = code, gap
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log odds of a gram for bit +1
    scales: np.ndarray  # margin to log odds, per bit
    trust: np.ndarray  # weight of a bit's loss

    def margins(self, texts: list[str]) -> np.ndarray:
        at, starts = grams(texts)
        sums = np.add.reduceat(self.weights[at], starts, axis=0)
        lengths = np.diff(np.append(starts, len(at)))[:, None]
        return sums / np.maximum(lengths, 1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, ambiguity flag and Hamming distance to the chosen codeword, per text.

        The loss of a language sums, over bits, the bit's trust times the logistic loss of its
        margin against the codeword. A text is ambiguous if the runner-up is nearly as good, or if
        as many bits are wrong as the code can no longer correct.
        """
        signed = margins * self.scales
        loss = np.stack([(self.trust * np.logaddexp(0, -signed * c)).sum(axis=1) for c in self.code], axis=1)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ranked = np.sort(share, axis=1)
        runner_up = ranked[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        wrong = (np.sign(signed) != self.code[best]).sum(axis=1)
        n = len(self.languages)
        least = min((int((self.code[i] != self.code[j]).sum()) for i in range(n) for j in range(i)), default=1)
        unclear = (ranked[:, -1] - runner_up < 0.2) | ((2 * wrong >= least) & (n > 1))
        return best, share[np.arange(len(share)), best], unclear, wrong


def _gram_counts(rows: DataFrame) -> DataFrame:
    """lang, slot, counts: occurrences of every gram bucket, in slots of 2,048 buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(text or "")
            for lang, texts in by_lang.items():
                found = np.bincount(grams(texts)[0], minlength=BUCKETS)
                total[lang] = total[lang] + found if lang in total else found
        for lang, counts in total.items():
            slots = counts.reshape(-1, SLOT)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [lang] * len(slots),
                    "slot": pa.array(range(len(slots)), pa.int32()),
                    "counts": [s.astype("<i8").tobytes() for s in slots],
                }
            )

    def add(group: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(c, "<i8") for c in group["counts"].to_pylist())
        return pa.table({"lang": [group["lang"][0].as_py()], "slot": pa.array([group["slot"][0].as_py()], pa.int32()), "counts": [counts.tobytes()]})

    schema = "lang string, slot int, counts binary"
    return rows.select("text", "lang").mapInArrow(count, schema).groupBy("lang", "slot").applyInArrow(add, schema)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learns from text and lang of rows that are not held out and have a lang.

    The sample is chosen by a hash of the id, so it is the same on every run. What reaches the
    driver is one count per language and gram bucket, and a few margins per calibration row.
    """
    bound_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", "lang")
    usable = rows.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    n = usable.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    share = min(1.0, fit_rows / n) if n else 1.0
    few = n <= fit_rows  # then the same rows serve for both steps
    counts: dict[str, np.ndarray] = {}
    for r in _gram_counts(usable.where(place < share)).collect():
        counts.setdefault(r.lang, np.zeros(BUCKETS))[r.slot * SLOT : (r.slot + 1) * SLOT] = np.frombuffer(r.counts, "<i8")
    languages = tuple(sorted(counts))
    code = codewords(len(languages))
    bits = code.shape[1]
    if not languages:
        return LanguageModel((), code, np.zeros((BUCKETS, bits)), np.ones(bits), np.ones(bits))
    table = np.stack([counts[x] / max(1.0, counts[x].sum()) for x in languages])
    weights = np.zeros((BUCKETS, bits), np.float32)
    for b in range(bits):
        side = [table[code[:, b] == s].mean(axis=0) if (code[:, b] == s).any() else np.zeros(BUCKETS) for s in (1, -1)]
        weights[:, b] = np.log(side[0] + 1e-6) - np.log(side[1] + 1e-6)
    weights[grams([" "])[0]] = 0  # blanks say nothing
    raw = LanguageModel(languages, code, weights, np.ones(bits), np.ones(bits))
    check = usable.where(place < share / 10) if few else usable.where((place >= share) & (place < share * 1.1))
    scales, trust = _calibrate(raw, check)
    return LanguageModel(languages, code, weights, scales, trust)


def _calibrate(model: LanguageModel, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per bit, the scale with the least logistic loss, and a trust that falls with its error rate."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(t, x) for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()) if t and LETTER.search(t)]
            if kept:
                found = model.margins([t for t, _ in kept]).astype("<f4")
                yield pa.RecordBatch.from_pydict({"lang": [x for _, x in kept], "margins": [m.tobytes() for m in found]})

    got = rows.select("text", "lang").mapInArrow(measure, "lang string, margins binary").collect()
    bits = model.code.shape[1]
    place = {x: i for i, x in enumerate(model.languages)}
    got = [r for r in got if r.lang in place]
    if not got:
        return np.full(bits, 10.0), np.ones(bits)
    margins = np.stack([np.frombuffer(r.margins, "<f4") for r in got]).astype(float)
    signed = margins * model.code[[place[r.lang] for r in got]]
    grid = np.geomspace(0.1, 100, 40)
    loss = np.stack([np.logaddexp(0, -signed * g).mean(axis=0) for g in grid])
    errors = (signed <= 0).mean(axis=0)
    return grid[loss.argmin(axis=0)], np.maximum(1 - 2 * errors, 0.05)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), ambiguous, code_distance, one row per input row.

    Only the text is read by the prediction. A NULL text, one without letters, or a model without
    languages gives `und` with score 0, flagged as ambiguous.
    """
    bound_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            usable = [i for i, t in enumerate(texts) if model.languages and t and LETTER.search(t)]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            unclear, wrong = np.ones(len(texts), bool), np.zeros(len(texts), np.int32)
            for at in range(0, len(usable), 64):
                part = usable[at : at + 64]
                best, scores[part], unclear[part], wrong[part] = model.decode(model.margins([texts[i] for i in part]))
                for i, b in zip(part, best):
                    names[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores), pa.array(unclear), pa.array(wrong, pa.int32())],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous", "code_distance"],
            )

    return rows.mapInArrow(run, RESULT)


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """`predict` with a model fitted on the same table."""
    return predict(docs, fit(docs, fit_rows))


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents, with all their columns, whose language is clear.

    Texts that are NULL or have no letters, and texts whose prediction is ambiguous, are rejected.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clear = np.zeros(len(texts), bool)
            usable = [i for i, t in enumerate(texts) if model.languages and t and LETTER.search(t)]
            for start in range(0, len(usable), 64):
                part = usable[start : start + 64]
                clear[part] = ~model.decode(model.margins([texts[i] for i in part]))[2]
            yield batch.filter(pa.array(clear))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
