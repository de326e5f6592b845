"""Column-name clean-up, on Python names and on Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\v\u00a0"

# Characters each caller removes from a name before it compares it, and whether
# it also strips white space from the ends.
NAME_NOISE = {
    "ingest": (" _", True),
    "upload": (" _", False),
    "screen": (WHITESPACE + "_-", False),
    "defaults": (WHITESPACE + "_", False),
}


def clean_name(name: str, style: str = "ingest") -> str:
    noise, strip = NAME_NOISE[style]
    lowered = name.lower().strip(WHITESPACE) if strip else name.lower()
    return lowered.translate({ord(c): None for c in noise})


def clean_name_col(name: Column, style: str = "ingest") -> Column:
    noise, strip = NAME_NOISE[style]
    lowered = F.btrim(F.lower(name), F.lit(WHITESPACE)) if strip else F.lower(name)
    return F.translate(lowered, noise, "")


def guess_column(
    names: list[str], candidates: list[str], style: str = "ingest", by_candidate: bool = False
) -> str | None:
    """Best column for a role: exact matches first, then names that contain a candidate.

    Names that clean up alike count as one: it keeps its first place and its last spelling.
    `by_candidate` ranks by candidate before exactness, as the request form does.
    """
    spelled = {clean_name(n, style): n for n in names}
    if by_candidate:
        spelled = {}
        for n in names:
            spelled.setdefault(clean_name(n, style), n)
    ranked = []
    for order, candidate in enumerate(candidates):
        key = clean_name(candidate, style)
        for place, (cleaned, name) in enumerate(spelled.items()):
            if key in cleaned:
                partial = 0 if by_candidate else int(cleaned != key)
                ranked.append((partial, order, place, name))
    return min(ranked)[3] if ranked else None


def dataset_kind_from_file(file_name: Column) -> Column:
    """Dataset kind told by a file name; the first rule that fits wins."""
    # Name fragments per kind, in rule order.
    rules = [
        ("sales", ["sales", "sell"]),
        ("inventory", ["inventory", "stock"]),
        ("production", ["production", "manufacturing"]),
        ("purchase_orders", ["purchase", "po_", "vendor"]),
        ("master_data", ["master", "catalog"]),
        ("external_signals", ["signal", "external", "macro"]),
    ]
    lowered = F.lower(file_name)
    choices = []
    for kind, fragments in rules:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.contains(lowered, F.lit(fragment))
        choices.append(F.when(hit, F.lit(kind)))
    return F.coalesce(*choices)
