"""Near-duplicate lines: an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import SPACES, discard, let, pick, settle, settle_hashes, shipped

#: Two lines match if 5 * common >= 4 * distinct words in either, that is a Jaccard of 0.8 or more.
#: Rarity is measured in so many hash buckets of words. Any order gives the same result, a finer
#: one fewer candidates; raise the bits with the vocabulary. One byte per bucket reaches every task.
SKETCH_BITS = 19
#: Size of the filter that picks the lines to be read again, 6 bits to the byte. It may pick too
#: many lines, never too few.
FILTER_BYTES = 1 << 19
NO_ID = -(1 << 63)
#: Bits of a word's hash beside its level, and how many of them the join leaves out: words that then
#: look alike only add candidates, which are confirmed.
TOKEN_BITS, LEFT_OUT = 58, 19


#: A document, and a line of one.
DOC, KEY = ("doc", "part"), ("doc", "part", "place")
#: Parities of a line's words by their hashes: 64 bits, 128 beyond WIDE words, 256 beyond twice as many.
BITS, WIDE = ("bits", "bits1", "bits2", "bits3"), 64
#: What tells the set of words of a line from others; equal sets have equal parities and prefixes, too.
SET = ("set", "n", *BITS, "prefix")
TO_KEY = tuple(f"to_{c}" for c in KEY)
#: A line as one number has its place in the lower bits; documents beyond 32 bits need all of KEY.
PLACE_BITS = 31


def _doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def _ids(docs: DataFrame) -> tuple[bool, bool]:
    """Whether no id repeats, and whether one number can stand for a line, too; NULL ids are one id."""
    ids = pick(docs, "doc_id").select(_doc(F.col("doc_id")).alias("doc"))
    counted = ids.groupBy("doc").agg(F.count("*").alias("n"))
    most, first, last = counted.agg(F.max("n"), F.min("doc"), F.max("doc")).first()
    unique = most is None or most == 1
    return unique, unique and most is not None and first >= 0 and last < 1 << (63 - PLACE_BITS)


def _part(unique: bool, text: Column) -> Column:
    """Tells apart different texts with the same id, where there are any."""
    return F.lit(0).cast("long") if unique else F.xxhash64(text)


def _base(docs: DataFrame, unique: bool) -> DataFrame:
    part = _part(unique, F.col("text"))
    return pick(docs, "doc_id", "text").select(_doc(F.col("doc_id")).alias("doc"), part.alias("part"), "text")


def _line(narrow: bool) -> Column:
    """A line as one value that is ordered as its KEY: a number if that can hold it."""
    if not narrow:
        return F.struct(*KEY)
    return F.call_function("shiftleft", F.col("doc"), F.lit(PLACE_BITS)).bitwiseOR(F.col("place").cast("long"))


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with the KEY of `line` and of `to_line`, where they have one, in place of it."""
    kinds = dict(rows.dtypes)

    def key(name: str, to: str) -> list[Column]:
        if kinds[name] != "bigint":
            return [F.col(f"{name}.{c}").alias(to + c) for c in KEY]
        place = F.col(name).bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
        return [F.shiftright(name, PLACE_BITS).alias(f"{to}doc"), F.lit(0).cast("long").alias(f"{to}part"), place.alias(f"{to}place")]

    ends = {"line": "", "to_line": "to_"}
    return rows.select(*[c for name in rows.columns for c in (key(name, ends[name]) if name in ends else [F.col(name)])])


def _has_word(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(SPACES))) > 0


def _plain(text: Column) -> Column:
    """The text in lower case, with one kind of blank beside line feeds."""
    out = F.lower(text)
    for blank in SPACES[1:].replace("\n", ""):  # many times faster than translate or a pattern
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return out


def _hashes(plain: Column) -> Column:
    """64-bit hashes of the words of a plain line, and of the empty text between neighbouring blanks."""
    return F.transform(F.split(plain, " "), lambda w: F.xxhash64(w))


def _byte(table: Column, at: Column) -> Column:
    """Byte of a value that holds ASCII only.

    Never NULL, so that joins by what is made of it add no test for NULL below the exchange that all
    uses of the crowd share.
    """
    return F.coalesce(F.ascii(F.substring(table, at + 1, 1).cast("string")), F.lit(0))


def _flag(place: Column, width: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int") * width)


def _words(base: DataFrame) -> DataFrame:
    """One row per line with words: doc, part, place, hashes (64 bits each) of its different words."""
    # A whole text is made plain at once: neither case nor blanks reach across a line feed.
    plain = base.select(*DOC, _plain(F.col("text")).alias("text"))
    lines = plain.select(*DOC, F.posexplode(F.split("text", "\n")).alias("place", "line")).where(F.trim("line") != "")
    hashes = F.array_remove(F.array_distinct(_hashes(F.col("line"))), F.xxhash64(F.lit("")))
    return lines.select(*KEY, hashes.alias("hashes"))


def _rarity(words: DataFrame) -> Column:
    """Levels of the hash buckets of words, rarer words first: the bits of the number of lines with a word, 31 at most."""
    found = words.select(F.explode("hashes").alias("h"))
    counts = found.groupBy(F.col("h").bitwiseAND((1 << SKETCH_BITS) - 1).cast("int").alias("b")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(31), F.floor(F.log2("n")).cast("int") + 1).cast("long")
    # Twelve levels of five bits to a row: 2^19 buckets are 43,691 rows for the driver.
    packed = counts.groupBy(F.floor(F.col("b") / 12).cast("int").alias("r")).agg(
        F.bit_or(F.call_function("shiftleft", level, (F.col("b") % 12) * 5)).alias("levels")
    )
    levels = [0] * (12 * ((1 << SKETCH_BITS) // 12 + 1))
    for r, value in packed.collect():
        for i in range(12):
            levels[12 * r + i] = value >> (5 * i) & 31
    return settle(words.sparkSession.createDataFrame([(levels,)], "data array<tinyint>"), "levels").scalar()


def _sets(words: DataFrame, narrow: bool) -> DataFrame:
    """One row per line with words: line, set (hash of all words), n, parities, prefix (rarest words first)."""
    size = 1 << SKETCH_BITS

    def ranked(t: Column) -> Column:
        # Never NULL, so that Spark sorts plain numbers.
        level = F.coalesce(F.get(F.col("levels"), t.bitwiseAND(size - 1).cast("int")), F.lit(0).cast("tinyint")).cast("long")
        return F.call_function("shiftleft", level, F.lit(TOKEN_BITS)).bitwiseOR(t.bitwiseAND((1 << TOKEN_BITS) - 1))

    tokens = F.sort_array(F.transform("hashes", ranked))
    sets = words.withColumn("levels", _rarity(words)).select(_line(narrow).alias("line"), tokens.alias("tokens"))
    # 4/5 of the words must be shared, rounded up, so a match shares a word of the first n - 4n/5 + 1.
    length = F.col("n") - F.floor((4 * F.col("n") + 4) / 5).cast("int") + 1
    signed = sets.select("line", "tokens", F.xxhash64("tokens").alias("set"), F.size("tokens").alias("n"))
    return signed.select("line", "set", "n", *_parities(F.col("tokens"), F.col("n")), F.slice("tokens", F.lit(1), length).alias("prefix"))


def _parities(tokens: Column, n: Column) -> list[Column]:
    """Whether each of 64 places is hit by an odd number of words: of all words, and in wide lines of part of them.

    Bits 6 and 7 of a word cut the words in four; the parities of the quarters follow from these four.
    """

    def parity(quarter: int | None, bits: int = 0) -> Column:
        def add(a: Column, t: Column) -> Column:
            flag = _flag(t.bitwiseAND(63), 1)
            return a.bitwiseXOR(flag if quarter is None else F.when(t.bitwiseAND(bits) == quarter, flag).otherwise(0))

        return F.aggregate(tokens, F.lit(0).cast("long"), add)

    some = [F.when(n > least, parity(q, b)).otherwise(0) for least, q, b in ((WIDE, 64, 64), (2 * WIDE, 128, 192), (2 * WIDE, 192, 192))]
    return [c.alias(name) for name, c in zip(BITS, (parity(None), *some))]


def _differ(a: str, b: str) -> Column:
    """At most the number of words that only one of two lines has: places where their parities differ.

    Unlike bits set by any word, parities tell long lines apart as well as short ones.
    """
    every, odd, low, high = (F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in BITS)
    even, low_rest, high_rest = every.bitwiseXOR(odd), every.bitwiseXOR(odd).bitwiseXOR(low), odd.bitwiseXOR(high)
    shorter = F.least(f"{a}.n", f"{b}.n")
    quarters = F.bit_count(low) + F.bit_count(low_rest) + F.bit_count(high) + F.bit_count(high_rest)
    halves = F.bit_count(even) + F.bit_count(odd)
    return F.when(shorter > 2 * WIDE, quarters).when(shorter > WIDE, halves).otherwise(F.bit_count(every))


def _firsts(sets: DataFrame) -> DataFrame:
    """The first line of each set of words; lines are folded before the exchange, however often one repeats."""
    return sets.groupBy(*SET).agg(F.min("line").alias("line"))


def _by_doc(places: DataFrame, name: str) -> DataFrame:
    return places.groupBy(*DOC).agg(F.collect_set("place").alias(name))


def _may_match(a: str, b: str) -> Column:
    """Length, positional and parity filters for two rows that share a prefix word.

    Two lines match if 9 * common words >= 4 * (n + m). The positional bound holds for the first word
    that they share, which has a row of its own.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * rest >= 4 * (n + m)) & (9 * _differ(a, b) <= n + m)


def _size_class(n: Column) -> Column:
    """Classes of sizes that double, so that sizes 4/5 apart are in one class or in neighbours."""
    return F.floor(F.log2(n)).cast("long")


def _by_word(firsts: DataFrame) -> DataFrame:
    """Rows of each line for its prefix words: token (a word and a class of sizes), line, n, at, parities.

    Of two lines that match, the one with more words shares with the other one of its own prefix and of
    the first m - 8m/9 + 1 words of the other, which has m: at least 4/9 of n + m words are common. They
    meet in the class of the longer line, so a line that lines of the next class may match has rows of
    these first words there, too.

    Words, lines and numbers of words are never NULL, so that joins add no test for NULL below the
    exchange that all uses of the rows share.
    """
    line = F.coalesce("line", F.lit(0)) if dict(firsts.dtypes)["line"] == "bigint" else F.struct(*[f"line.{c}" for c in KEY])
    n = F.col("n")
    sized = firsts.select(
        line.alias("line"), F.coalesce("n", F.lit(0)).alias("n"), *BITS, "prefix", _size_class(n).alias("own"),
        _size_class(F.floor(5 * n / 4)).alias("next"), (n - F.floor((8 * n + 8) / 9) + 1).alias("short"),
    )
    words = sized.select("line", "n", *BITS, "own", "next", "short", F.posexplode("prefix").alias("at", "word"))
    sizes = F.when((F.col("next") > F.col("own")) & (F.col("at") < F.col("short")), F.array("own", "next")).otherwise(F.array("own"))
    rows = words.select("line", "n", "at", *BITS, "word", F.explode(sizes).alias("size"))
    token = F.shiftright("word", LEFT_OUT) * 32 + F.col("size")
    return rows.select(F.coalesce(token, F.lit(0)).alias("token"), "line", "n", "at", *BITS)


def _pairs(later: DataFrame, rows: DataFrame, also: Column | None = None) -> DataFrame:
    """Lines with the earlier lines that share a prefix word and may match, and in how many places they differ."""
    # Most pairs of a word end at the first tests, which are the cheapest.
    met = (F.col("b.line") < F.col("a.line")) & _may_match("a", "b")
    both = later.alias("a").join(rows.alias("b"), F.col("a.token") == F.col("b.token")).where(met if also is None else met & also)
    return both.select("a.line", "a.n", F.col("b.line").alias("to_line"), F.col("b.n").alias("to_n"), _differ("a", "b").alias("differ"))


def _nearest(firsts: DataFrame) -> DataFrame:
    """Each line that has candidates, with the one that differs least.

    A line that may match the hub of a token, its first line, is not held against others of that token:
    a group of near copies makes as many rows as it has lines.
    """
    # Dealt out before the window makes structures of them, the rows are shuffled once for it and the join.
    rows = _by_word(firsts).repartition("token")
    line = ("line", "n", "at", *BITS)
    hub = F.min(F.struct(*line)).over(Window.partitionBy("token"))
    met = rows.withColumn("hub", hub).where(F.col("line") != F.col("hub.line"))
    near = _may_match("own", "hub")
    met = met.select("token", F.struct(*line).alias("own"), "hub").select("token", "own.*", F.col("hub.line").alias("hub"), near.alias("near"))
    pairs = _pairs(met, rows, ~F.col("a.near") | (F.col("b.line") == F.col("a.hub")))
    to = F.min(F.struct("differ", "to_line", "to_n")).alias("to")
    return _keyed(pairs.groupBy("line", "n").agg(to).select("line", "n", "to.to_line", "to.to_n"))


def _prefixes_allow(pairs: DataFrame, firsts: DataFrame, ends: tuple[Column, Column]) -> DataFrame:
    """The pairs that may still match after their prefixes are compared whole; no match is left out.

    Of two prefixes, words of the one that ends first and are not in the other are not in the other
    line either. Words are cut to 16 bits, which can only make more of them look common.
    """
    short = F.transform("prefix", lambda t: (t.bitwiseAND(0xFFFF) - 0x8000).cast("short"))
    side, other = _ends(_keyed(firsts), ends, "cuts", F.element_at("prefix", -1).alias("end"), short.alias("cut"))
    other = other.toDF(*TO_KEY, "to_end", "to_cut")
    both = pairs.join(side, [*KEY]).join(other, [*TO_KEY])
    same = F.size(F.array_intersect("cut", "to_cut"))
    alike = F.size("cut") - F.size(F.array_distinct("cut"))  # words of one line that look alike
    to_alike = F.size("to_cut") - F.size(F.array_distinct("to_cut"))
    least = F.floor((4 * (F.col("n") + F.col("to_n")) + 8) / 9)
    most = same + F.when(F.col("end") <= F.col("to_end"), alike + F.col("n") - F.size("cut")).otherwise(
        to_alike + F.col("to_n") - F.size("to_cut")
    )
    return both.where(most >= least).select(*pairs.columns)


def _wanted_filter(ends: DataFrame, *key: str) -> Column:
    """A test on the key that holds for all rows of the ends, and for few other rows."""
    place = F.pmod(F.xxhash64(*key), F.lit(6 * FILTER_BYTES))
    rows = ends.select(place.alias("p")).groupBy(F.floor(F.col("p") / 60).cast("int").alias("r")).agg(F.bit_or(_flag(F.col("p") % 60, 1)).alias("bits"))
    table = bytearray(b" " * (10 * (6 * FILTER_BYTES // 60 + 1)))
    for r, bits in rows.collect():  # bounded by the size of the filter
        for i in range(10):
            table[10 * r + i] = 32 + (bits >> (6 * i) & 63)
    byte = _byte(shipped(ends.sparkSession, bytes(table), "filter"), F.floor(place / 6).cast("int")) - 32
    return F.call_function("shiftright", byte, (place % 6).cast("int")).bitwiseAND(1) == 1


def _end_filters(pairs: DataFrame) -> tuple[Column, Column]:
    """Tests on the key of a line for those that are the later and the earlier one of a pair."""
    return _wanted_filter(pairs, *KEY), _wanted_filter(pairs.select(*TO_KEY).toDF(*KEY), *KEY)


def _ends(lines: DataFrame, ends: tuple[Column, Column], label: str, *values: Column) -> list[DataFrame]:
    """KEY and values of the lines that the filters pick for either side of pairs; the lines are read once for both."""
    flags = [picked.alias(name) for picked, name in zip(ends, ("later", "earlier"))]
    picked = lines.select("*", *flags).where("later OR earlier").select(*KEY, *values, "later", "earlier")
    kept = settle(picked, label)
    return [kept.where(name).drop("later", "earlier") for name in ("later", "earlier")]


def _confirmed(base: DataFrame, pairs: DataFrame, ends: tuple[Column, Column]) -> DataFrame:
    """The pairs with whether their full sets of words, of n and to_n words, match. Only lines that the filters pick are shuffled."""
    lines = base.select(*DOC, F.posexplode(F.split("text", "\n")).alias("place", "line"))
    # Equal rows of the table hold equal lines; one of them is enough.
    plain, other = _ends(lines, ends, "texts", _plain(F.col("line")).alias("line"))
    other = other.toDF(*TO_KEY, "to_line")
    both = pairs.join(plain, [*KEY]).join(other, [*TO_KEY])
    common = F.size(F.array_intersect(F.array_remove(F.split("line", " "), ""), F.split("to_line", " ")))
    counted = both.select(*KEY, *TO_KEY, (F.col("n") + F.col("to_n")).alias("all"), common.alias("common"))
    return counted.select(*KEY, *TO_KEY, (5 * F.col("common") >= 4 * (F.col("all") - F.col("common"))).alias("ok"))


def repeated_lines(base: DataFrame, narrow: bool = False) -> DataFrame:
    """doc, part, gone: line numbers of every line that matches an earlier line.

    1. The words of each line, rarest first, are cut to the prefix. Of lines with the same set of
       words all but the first go. Only the first takes part in what follows.
    2. Lines of about the same size that share a prefix word and pass the filters are candidates. Each line meets the hub of
       the word, which is its first line. A line that the filters keep apart from the hub meets all
       others of the word.
    3. Each line is compared with its nearest candidate on their full sets of words. A line that does
       not match it meets all earlier lines of its words, so none is missed; these pairs first compare
       their whole prefixes, and only texts of those that pass are shuffled.
    """
    words = settle_hashes(_words(base), "words")
    sets = settle_hashes(_sets(words, narrow), "sets")
    discard(words)
    firsts = settle_hashes(_firsts(sets), "firsts")
    # The same place of an equal row is no other line.
    copies = settle(_keyed(sets.select("line").join(firsts.select("line"), "line", "left_anti")), "copies")
    discard(sets)

    tried = settle(_nearest(firsts), "tried")
    judged = settle(_confirmed(base, tried, _end_filters(tried)).distinct(), "judged")
    gone = judged.where("ok").select(*KEY)
    open_lines = settle(judged.where("NOT ok").select(*KEY, *TO_KEY), "open")
    if not open_lines.isEmpty():
        asked = open_lines.select(_line(narrow).alias("line"))
        picked = firsts.where(_wanted_filter(asked, "line")).join(asked, "line", "left_semi")
        asks = settle(_by_word(picked), "asks")
        rows = _by_word(firsts)
        more = _keyed(_pairs(asks, rows.where(_wanted_filter(asks, "token"))).drop("differ").distinct())
        more = settle(more.join(open_lines, [*KEY, *TO_KEY], "left_anti"), "more")
        ends = _end_filters(more)
        left = settle(_prefixes_allow(more, firsts, ends), "left")
        gone = gone.unionByName(_confirmed(base, left, ends).where("ok").select(*KEY))
        discard(more, asks)
    discard(firsts)
    return _by_doc(gone.unionByName(copies), "gone")


def find_repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (ascending line numbers from 0); one row per input row.

    The lines are those that `remove_repeated_lines` removes; no text is shuffled to list them.
    """
    unique, narrow = _ids(docs)
    base = _base(docs, unique)
    counted = base.select(*DOC, F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    judged = counted.join(repeated_lines(base, narrow), [*DOC], "left")
    removed = F.sort_array(F.coalesce("gone", F.array().cast("array<int>")))
    return judged.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_lines",
        F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"),
    )


def _kept(lines: Column, gone: Column) -> Column:
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(numbers, lambda i: lines[i]), "\n")


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_removed; one row per input row.

    Needs doc_id and text; other columns are ignored. Lines are split at line feeds. A line goes if an
    earlier line (smaller doc_id, or further up in the same text) has the same text, or a set of
    lower-cased words with a Jaccard likeness of 0.8 or more, whether or not that line stays. Lines
    without words stay. A NULL text stays NULL and has no lines; a NULL id stands before all others.
    Texts with the same id are ordered by a hash; equal rows count as one document and get equal results.
    """
    unique, narrow = _ids(docs)
    base = _base(docs, unique)
    judged = base.join(repeated_lines(base, narrow).hint("shuffle_hash"), [*DOC], "left")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), lambda x: _kept(x, F.col("gone"))))
    return judged.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        left.alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, texts without repeated lines, and n_chars to match.

    Matches are those of `remove_repeated_lines`. A document goes if it had words and keeps none.
    """
    at = {name: f"c{docs.columns.index(name)}" for name in ("doc_id", "text", "n_chars") if name in docs.columns}
    unique, narrow = _ids(docs)
    gone = settle(repeated_lines(_base(docs, unique), narrow), "gone")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.col(at["text"])
    keyed = numbered.withColumns({"doc": _doc(F.col(at["doc_id"])), "part": _part(unique, text)})
    # Only documents that the filter picks are shuffled; the others are surely whole.
    picked = _wanted_filter(gone, *DOC)
    judged = keyed.where(picked).join(gone.hint("shuffle_hash"), [*DOC], "left")
    left = F.when(F.col("gone").isNull(), text).otherwise(let(F.split(text, "\n"), lambda x: _kept(x, F.col("gone"))))
    kept = judged.withColumn("left", left).where(F.col("gone").isNull() | _has_word(F.col("left")))
    new = {at["text"]: F.col("left")}
    if "n_chars" in at:
        new[at["n_chars"]] = F.length("left").cast(dict(numbered.dtypes)[at["n_chars"]])
    changed = kept.select([new.get(c, F.col(c)).alias(c) for c in numbered.columns])
    return keyed.where(~picked).select(*numbered.columns).unionByName(changed).toDF(*docs.columns)
