"""Repeated passages across documents, found by recompression of word sequences.

Recompression names the runs of equal symbols and then pairs of neighbouring symbols, round by
round. A name is a hash of what it stands for and of the round, and which symbols may open or close
a pair is a bit of the symbol's own hash, so names agree in all documents without any exchange. The parse
of a passage then depends on its words alone, except near its ends. Every symbol therefore carries
its context: the span of words on which its existence depends. A symbol whose context lies inside
a window occurs in every equal window at the same place; so a window that holds a symbol which
occurs once in the whole corpus cannot be repeated. The windows that remain are verified by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import bound_batches, pick

#: Words per window, and rounds of pair naming after the runs of a round were named.
WINDOW, ROUNDS = 20, 4
#: Shorter symbols tell little: they are not counted and rule nothing out.
LEAST_WORDS = 3

POWER = np.uint64(0x9FB21C651E98DF25)
ONE = np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def named(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of (a, b); the kind tells the rounds, and runs from pairs."""
    salt = np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))
    return mixed(mixed(a + salt) * np.uint64(3) + b)


@dataclass
class Symbols:
    """Symbols of one or more texts side by side, in order."""

    name: np.ndarray
    start: np.ndarray  # first word
    end: np.ndarray  # after the last word
    low: np.ndarray  # context: the words low..high-1; one beyond a text's edge if it depends on the edge
    high: np.ndarray
    first: np.ndarray  # begins a text
    last: np.ndarray  # ends a text


def _name_runs(s: Symbols, word: np.ndarray, round_: int) -> Symbols:
    """Replaces each maximal run of a symbol by one symbol for (symbol, length).

    That a symbol is not part of a longer run must follow from its context. One word is enough if
    it differs from the word with which an equal neighbour would have to begin or end.
    """
    n = len(s.name)
    same = np.zeros(n, bool)  # equal to the symbol before
    same[1:] = (s.name[1:] == s.name[:-1]) & ~s.first[1:]
    heads = np.flatnonzero(~same)
    tails = np.append(heads[1:], n) - 1
    length = (tails - heads + 1).astype(np.uint64)
    name = s.name[heads]
    many = length > ONE
    name = np.where(many, named(2 * round_ + 1, name, length), name)
    start, end, first, last = s.start[heads], s.end[tails], s.first[heads], s.last[tails]
    before, after = np.maximum(heads - 1, 0), np.minimum(tails + 1, n - 1)
    # The last word of a symbol in the run, and its first word.
    ends_with, begins_with = word[s.end[heads] - 1], word[s.start[heads]]
    by_word = word[np.maximum(start - 1, 0)] != ends_with
    low = np.where(first | by_word, start - 1, s.low[before])
    by_word = word[np.minimum(end, len(word) - 1)] != begins_with
    high = np.where(last | by_word, end + 1, s.high[after])
    low = np.minimum(low, np.minimum.reduceat(s.low, heads))
    high = np.maximum(high, np.maximum.reduceat(s.high, heads))
    return Symbols(name, start, end, low, high, first, last)


def _name_pairs(s: Symbols, round_: int) -> Symbols:
    """Merges an opening symbol with a closing symbol after it.

    A merge depends on the two alone. An opening symbol stays alone because of what follows it, a
    closing one because of what stands before it.
    """
    n = len(s.name)
    opens = (mixed(s.name + np.uint64(round_)) >> np.uint64(63)).astype(bool)
    merge = np.zeros(n, bool)  # with the next
    merge[:-1] = opens[:-1] & ~opens[1:] & ~s.last[:-1]
    merged = np.zeros(n, bool)  # with the one before
    merged[1:] = merge[:-1]
    low, high = s.low.copy(), s.high.copy()
    alone_open = opens & ~merge
    alone_close = ~opens & ~merged
    after = np.append(s.high[1:], 0)
    before = np.append(0, s.low[:-1])
    high = np.where(alone_open, np.where(s.last, s.end + 1, np.maximum(high, after)), high)
    low = np.where(alone_close, np.where(s.first, s.start - 1, np.minimum(low, before)), low)
    keep = np.flatnonzero(~merged)
    joined = merge[keep]
    right = np.minimum(keep + 1, n - 1)
    return Symbols(
        np.where(joined, named(2 * round_ + 2, s.name[keep], s.name[right]), s.name[keep]),
        s.start[keep],
        np.where(joined, s.end[right], s.end[keep]),
        np.where(joined, np.minimum(s.low[keep], s.low[right]), low[keep]),
        np.where(joined, np.maximum(s.high[keep], s.high[right]), high[keep]),
        s.first[keep],
        np.where(joined, s.last[right], s.last[keep]),
    )


def recompress(word: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """Symbols of texts given as word hashes one after another; `starts` holds the non-empty texts' first words."""
    n = len(word)
    at = np.arange(n)
    first = np.zeros(n, bool)
    first[starts] = True
    last = np.append(first[1:], True)
    s = Symbols(word, at, at + 1, at, at + 1, first, last)
    for r in range(rounds):
        s = _name_pairs(_name_runs(s, word, r), r)
    return s


def telling(s: Symbols) -> np.ndarray:
    """Which symbols fit into a window with their context and are long enough to be counted."""
    return (s.high - s.low <= WINDOW) & (s.end - s.start >= LEAST_WORDS)


class Texts:
    """The words of a batch of texts as hashes, and where each text begins."""

    def __init__(self, texts: list[str | None], known: dict[bytes, int]):
        tokens = [(t or "").encode("utf-8", "replace").split() for t in texts]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.tokens = tokens
        flat = [w for t in tokens for w in t]
        for w in set(flat).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        self.word = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
        if len(known) > 500_000:
            known.clear()

    def symbols(self) -> Symbols | None:
        return recompress(self.word, self.starts[self.lengths > 0]) if len(self.word) else None

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Number of the text that holds each word."""
        return np.searchsorted(self.starts + self.lengths, at, side="right")

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Start of every window that lies in one text, and a hash of its words."""
        n = len(self.word)
        if n < WINDOW:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        # Horner over blocks of 1, 2, 4, 8, 16 words, joined to 20.
        block, size, total, done, power = mixed(self.word), 1, None, 0, POWER
        while size <= WINDOW:
            if WINDOW & size:
                total = block if total is None else total[: len(block) - done] * power + block[done:]
                done += size
            block = block[:-size] * power + block[size:]
            power = np.uint64(int(power) ** 2 % (1 << 64))
            size *= 2
        ends = np.repeat(self.starts + self.lengths, self.lengths)
        at = np.arange(n - WINDOW + 1)
        at = at[at + WINDOW <= ends[: n - WINDOW + 1]]
        return at, mixed(total)[at]


def _tag(at: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Position in the text and the flag in one number that orders like the position."""
    return (at.astype(np.int64) << 1) | sure.astype(np.int64)


def _first_in_batch(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Marks, for every distinct key, the entry with the least rank."""
    order = np.lexsort((rank, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


def _spread(own: list[np.ndarray], tag: np.ndarray) -> np.ndarray:
    """Somewhere to go for rows that need to meet no others."""
    name = tag.astype(np.uint64)
    for key in own:
        name = mixed(key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + name)
    return name.astype(np.int64)


def _schema(keys: list[str], *more: str) -> str:
    return ", ".join(["route long", *[f"{k} long" for k in keys], "tag long", *more])


def _symbol_rows(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Every telling symbol: once per batch under its name, further ones of the batch marked as sure to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = Texts(batch.column("text").to_pylist(), known)
            s = texts.symbols()
            if s is None:
                continue
            use = telling(s)
            name, start = s.name[use], s.start[use]
            owner = texts.owner(start)
            _, back, times = np.unique(name, return_inverse=True, return_counts=True)
            sure = times[back] > 1
            probe = _first_in_batch(name, start)
            own = [batch.column(k).to_numpy()[owner] for k in keys]
            tag = _tag(start - texts.starts[owner], sure)
            route = np.where(probe, name.astype(np.int64), _spread(own, tag))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (route, *own, tag)], names=["route", *keys, "tag"])

    return docs.mapInArrow(run, _schema(keys))


def _repeated_symbols(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The document's keys, starts: where each text holds symbols that occur again somewhere in the corpus."""
    met = Window.partitionBy("route")
    sure = F.col("tag").bitwiseAND(F.lit(1))
    counted = rows.select(*keys, "tag", sure.alias("sure"), F.count(F.lit(1)).over(met).alias("times"), F.max(sure).over(met).alias("any"))
    again = counted.where("times > 1 OR any = 1 OR sure = 1")
    return again.select(*keys, F.shiftright("tag", 1).cast("int").alias("at")).groupBy(*keys).agg(F.collect_list("at").alias("starts"))


def _candidates(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Windows that no unique symbol rules out, packed: route, the document's keys, tag, n, checks.

    Equal windows hold equal telling symbols, so neighbouring windows go to the name of the first
    symbol that they hold together, as one row with a 64-bit hash per window. Windows that repeat an
    earlier one of the same batch need no meeting: they go as spans without hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = Texts(batch.column("text").to_pylist(), known)
            s = texts.symbols()
            if s is None:
                continue
            use = telling(s)
            name, start, low, high = s.name[use], s.start[use], s.low[use], s.high[use]
            listed = batch.column("starts")
            found = [np.asarray(x.values.to_numpy(), np.int64) + at for x, at in zip(listed, texts.starts) if x.is_valid]
            again = np.zeros(len(texts.word) + 1, bool)
            if found:
                again[np.concatenate(found)] = True
            once = ~again[start]
            # A unique symbol rules out the windows that hold its context: starts high-20..low.
            change = np.zeros(len(texts.word) + 2, np.int64)
            np.add.at(change, np.maximum(high[once] - WINDOW, 0), 1)
            np.add.at(change, low[once] + 1, -1)
            ruled_out = np.cumsum(change) > 0
            at, hash_ = texts.windows()
            left = ~ruled_out[at]
            at, hash_ = at[left], hash_[left]
            if not len(at):
                continue
            owner = texts.owner(at)
            own = [batch.column(k).to_numpy()[owner] for k in keys]
            place = at - texts.starts[owner]

            rank = np.empty(len(at), np.int64)
            rank[np.lexsort((place, *reversed(own)))] = np.arange(len(at))
            probe = _first_in_batch(hash_, rank)
            lead = np.empty(len(at), np.int64)
            _, back = np.unique(hash_, return_inverse=True)
            lead[back[probe]] = np.flatnonzero(probe)
            lead = lead[back]
            # A repeated row is the same document: its windows are no later ones.
            sure = ~probe & np.logical_or.reduce([k != k[lead] for k in (*own, place)])

            # Contexts ascend with the symbols, so the first that begins inside is found by search.
            symbol = np.searchsorted(low, at)
            inside = np.minimum(symbol, len(high) - 1)
            holds = (symbol < len(high)) & (high[inside] <= at + WINDOW) if len(high) else np.zeros(len(at), bool)
            route = np.where(holds, name[inside], hash_) if len(high) else hash_
            keep = probe | sure
            at, hash_, place, sure, route, owner, *own = (x[keep] for x in (at, hash_, place, sure, route, owner, *own))
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]) | (sure[1:] != sure[:-1]) | (~sure[1:] & (route[1:] != route[:-1]))
            heads = np.flatnonzero(new)
            n = np.diff(np.append(heads, len(at)))
            own = [k[heads] for k in own]
            tag = _tag(place[heads], sure[heads])
            route = np.where(sure[heads], _spread(own, tag), route[heads].astype(np.int64))
            sizes = np.where(sure[heads], 0, n)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            checks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hash_[~sure].astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(route), *map(pa.array, own), pa.array(tag), pa.array(n.astype(np.int32)), checks],
                names=["route", *keys, "tag", "n", "checks"],
            )

    return docs.mapInArrow(run, _schema(keys, "n int", "checks array<long>"))


def _repeated_windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The document's keys, spans (start, n): windows whose words also start earlier."""
    sure = F.col("tag").bitwiseAND(F.lit(1)) == 1
    start = F.shiftright("tag", 1).cast("int").alias("first")
    # Sure spans have no hashes, meet nobody, and pass through as they are.
    windows = rows.repartition("route").select(
        "route", *keys, start, "n", sure.alias("sure"), F.posexplode_outer("checks").alias("k", "check")
    )
    placed = windows.select("route", "check", "sure", "n", F.struct(*keys, (F.col("first") + F.coalesce("k", F.lit(0))).alias("at")).alias("place"))
    met = placed.withColumn("earliest", F.min("place").over(Window.partitionBy("route", "check")))
    later = met.where("sure OR place > earliest").select(
        *[f"place.{k}" for k in keys], "place.at", F.when(F.col("sure"), F.col("n")).otherwise(1).alias("n")
    )
    return later.groupBy(*keys).agg(F.collect_list(F.struct("at", "n")).alias("spans"))


REMOVED = "doc_id long, n_words long, n_removed long, text string, kept_sha256 string"


def _remove(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans"))):
                tokens = (text.as_py() or "").encode("utf-8", "replace").split()
                n = len(tokens)
                if spans.is_valid:
                    at, many = (spans.values.field(i).to_numpy() for i in (0, 1))
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + many - 1 + WINDOW, -1)
                    kept = np.flatnonzero(np.cumsum(change)[:n] == 0)
                    tokens = [tokens[i] for i in kept]
                left = b" ".join(tokens)
                rows.append((doc_id.as_py(), n, n - len(tokens), left.decode(), hashlib.sha256(left).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [f.split()[0] for f in REMOVED.split(", ")]
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.mapInArrow(run, REMOVED)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Texts without the words of repeated windows, their counts, and a digest of what is kept.

    Needs doc_id and text; other columns are ignored. A window is 20 consecutive words of one
    text; its words go if the same words also start earlier (smaller doc_id, or further left in the same
    text). Windows are judged on the input. Kept words are joined by one space. A NULL text has
    no words. A NULL id stands before all others. Rows with the same id are ordered by a hash of their
    texts; equal rows count as one document and get equal results.

    One exchange of the texts serves both joins: with the repeated symbols, and with the repeated windows.
    """
    bound_batches(docs.sparkSession)
    no_id = F.lit(-(1 << 63))
    named = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("doc"), "text")
    # A part tells apart different texts with the same id, where there are any.
    unique = named.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    keys = ["doc"] if unique else ["doc", "part"]
    part = F.lit(0).cast("long") if unique else F.xxhash64("text")
    base = named.select("doc", part.alias("part"), "text")
    # The small side is hashed, so the texts are not sorted; both joins read the same columns.
    symbols = _repeated_symbols(_symbol_rows(base, keys), keys).hint("shuffle_hash")
    windows = _repeated_windows(_candidates(base.join(symbols, keys, "left"), keys), keys).hint("shuffle_hash")
    judged = base.join(windows, keys, "left")
    return _remove(judged.select(F.when(F.col("doc") != no_id, F.col("doc")).alias("doc_id"), "text", "spans"))
