"""Small tables for the document operators: awkward rows, and a table with planted copies."""

from __future__ import annotations

import random

from pyspark.sql import types as T

FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
# Extra columns whose names clash with the operators' own, or differ from the table's in case alone.
EXTRA = [("DOC_ID", T.StringType()), ("words", T.StringType()), ("n_tokens", T.StringType()), ("part", T.StringType()), ("c1", T.StringType()), ("kept", T.StringType())]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in FIELDS])
WIDE = T.StructType([T.StructField(n, t) for n, t in [EXTRA[0], *FIELDS, *EXTRA[1:]]])

STEMS = "ka lo mi ne ru sa ti vo ze pa do fi gu he ji".split()
COMMON = {
    "en": "the of and to in that is for with".split(),
    "fr": "le la les des une dans pour que est".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    end = {"en": "ing", "fr": "eau"}[lang]
    out = []
    for _ in range(n):
        out.append(rng.choice(COMMON[lang]) if rng.random() < 0.3 else "".join(rng.choices(STEMS, k=3)) + end)
    return " ".join(out).capitalize() + "."


def text(rng: random.Random, lang: str = "en", lines: int = 5) -> str:
    return "\n".join(sentence(rng, lang, rng.randint(8, 25)) for _ in range(lines))


def edited(rng: random.Random, base: str, share: float) -> str:
    words = base.split(" ")
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = "x" + "".join(rng.choices(STEMS, k=4))
    return " ".join(words)


def corpus(n: int = 90, seed: int = 3) -> list[tuple]:
    """Documents with exact copies, near copies of several degrees, shared lines and shared passages."""
    rng = random.Random(seed)
    rows, passage, line = [], sentence(rng, "en", 60), sentence(rng, "fr", 12)
    for i in range(n):
        lang = "fr" if i % 3 == 0 else "en"
        body = text(rng, lang, rng.randint(1, 8))
        if i % 10 == 4:
            body = rows[i - 3][1]
        elif i % 10 == 5:
            body = edited(rng, rows[i - 4][1], rng.choice([0.01, 0.03, 0.08]))
        elif i % 10 == 6:
            body = body + "\n" + passage + "\n" + line
        elif i % 10 == 7:
            body = line.upper() + "\n" + body
        elif i % 10 == 8:
            body = "go go go " * 15 + passage + " " + body
        rows.append((i, body, lang, f"src{i % 4}", len(body)))
    return rows


def awkward() -> list[tuple]:
    """NULLs in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    same = text(rng)
    long = text(rng, "en", 1500)
    return [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\r\n\x0b\x0c ", "fr", "a", 7),
        (4, same, None, "b", len(same)),
        (5, same, "en", None, len(same)),
        (5, same, "en", None, len(same)),
        (None, same, "en", "b", len(same)),
        (None, None, None, None, None),
        (6, long, "en", "b", len(long)),
        (7, "one", "en", "c", 3),
        (8, "one", "en", "c", 3),
        (9, "\n\n\n", "en", "c", 3),
        (10, "1234 5678 !!", "en", "c", 12),
        (11, "é ü \U0001f600 ſK", "fr", "c", 9),
        (12, "w " * 300, "en", "c", 600),
        (-3, text(rng, "fr"), "fr", "c", 10),
        (13, text(rng, "fr"), "fr", "d", 10),
        (13, text(rng, "fr"), "fr", "d", 10),
    ]


def widened(rows: list[tuple]) -> list[tuple]:
    return [("other", *r, "w", "9", "p", "c", "k") for r in rows]
