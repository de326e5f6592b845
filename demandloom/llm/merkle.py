"""Merkle manifest of a table: ranks are grouped away digit by digit within bounded blocks of nested structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import pick, settle

#: Children of a node, and levels that are rolled up inside one row: a block holds 8^4 leaves at most.
ARITY, LEVELS = 8, 4
BLOCK = ARITY**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest of each row, and its `other` digest where the tampering rule picks it."""
    base = pick(docs, "doc_id", "source", "lang", "n_chars", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    own = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = _digest(*own, _field(F.translate("text", UPPER, LOWER)))
    # Never NULL, and in the order of the languages with NULL first.
    tree = F.concat(F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce("lang", F.lit("")))
    return base.select(
        tree.alias("tree"), "doc_id", _digest(*own, _field(F.col("text"))).alias("digest"),
        F.when(picked, lowered).alias("other"),
    )


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """`rank` of each row within its tree from 0, and the `size` of the tree; equal rows get ranks of their own.

    One sort by (tree, order) over ranges: a row's place inside its range is counted as it is written,
    and only the ranges' counts per tree are summed up. A large tree spans many ranges.
    """
    ways = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order]
    tied = settle(nodes.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    placed = tied.repartitionByRange(ways, *keys, "tie").sortWithinPartitions(*keys, "tie")
    # The upper bits of such an id are the range, the lower 33 the place in it.
    rows = settle(placed.drop("tie").withColumn("id", F.monotonically_increasing_id()), "ranges")
    rows = rows.select(*nodes.columns, F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND((1 << 33) - 1).alias("place"))
    counts = rows.groupBy("tree", "range").agg(F.count("*").alias("n"), F.min("place").alias("start"))
    tree = Window.partitionBy("tree")
    sums = counts.select(
        "tree", "range", "start", F.sum("n").over(tree).alias("size"),
        (F.sum("n").over(tree.orderBy("range")) - F.col("n")).alias("before"),
    )
    rank = F.col("before") + F.col("place") - F.col("start")
    return rows.join(sums, ["tree", "range"]).select(*nodes.columns, rank.alias("rank"), "size")


def _levels() -> Column:
    """Levels that a tree of `size` nodes still needs, as far as one block goes."""
    found = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        found = F.when(F.col("size") <= ARITY**k, k).otherwise(found)
    return found


def _rolled(nodes: DataFrame) -> DataFrame:
    """One row per block of a tree: the nested nodes under its `digest`.

    The last digit of the rank goes with each grouping. All groupings nest inside the same
    exchange by block.
    """
    own = [c for c in nodes.columns if c not in ("tree", "rank", "size")]
    rows = nodes.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long")).repartition("tree", "block")
    item = F.struct(F.col("rank").alias("at"), *own)
    for k in range(1, LEVELS + 1):
        up = rows.withColumn("up", F.floor(F.col("rank") / ARITY).cast("long"))
        kids = up.groupBy("tree", "size", "block", "up").agg(F.sort_array(F.collect_list(item)).alias("kids"))
        digests = F.transform("kids", lambda x: x["digest"])
        joined = F.when(_levels() >= k, F.sha2(F.array_join(digests, ""), 256)).otherwise(digests[0])
        rows = kids.select("tree", "size", "block", F.col("up").alias("rank"), "kids", joined.alias("digest"))
        item = F.struct(F.col("rank").alias("at"), "digest", "kids")
    return rows.drop("rank")


def built(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the ranked nodes, then blocks of those blocks, until each tree is one block."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    phases = [settle(_rolled(nodes), "blocks")]
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        last = phases[-1]
        upper = last.select("tree", F.col("block").alias("rank"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"), "digest")
        phases.append(settle(_rolled(upper), "blocks"))
    return phases


def _siblings(kids: Column) -> Column:
    """The children, each with the digests to its left and right."""
    digests = F.transform(kids, lambda x: x["digest"])

    def one(x: Column, i: Column) -> Column:
        left, right = F.slice(digests, F.lit(1), i), F.slice(digests, i + 2, F.lit(ARITY))
        return F.struct(x.alias("node"), F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(kids, one)


def opened(phases: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes again, each with its `path` of siblings up to the top, and the further columns of `above`.

    `above` holds tree, block, path and what every node of that block shall carry. Inside a block
    the nested structs are transformed and exploded, without a join. Only blocks of more than one
    level of blocks look up the path above them, a row for 4,096 leaves.
    """
    for phase in reversed(phases):
        carried = [c for c in above.columns if c not in ("tree", "block", "path")]
        rows = phase.drop("digest").join(above, ["tree", "block"])
        for k in range(LEVELS, 0, -1):
            out = rows.select("tree", "size", *carried, "path", F.explode(_siblings(F.col("kids"))).alias("kid"))
            step = F.when(_levels() >= k, F.array(F.struct("kid.left", "kid.right"))).otherwise(F.array().cast("array<struct<left:string,right:string>>"))
            node = ["kid.node.kids"] if k > 1 else [F.col("kid.node").alias("node")]
            rows = out.select("tree", "size", *carried, F.concat(step, "path").alias("path"), *node)
        above = rows.select("tree", F.col("node.at").alias("block"), "path", *carried, *([] if phase is not phases[0] else ["node"]))
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row per row of the table.

    Needs doc_id, source, lang, n_chars and text; other columns are ignored. A leaf is the SHA-256 of
    the five values, each `-` if NULL, else its UTF-8 length, a colon and the value. The leaves of one
    language, in the order of doc_id, make a tree: eight consecutive nodes become their hash until
    one is left. The roots of the languages, NULL first, then bytewise, make the last tree likewise.
    A NULL doc_id comes first; rows with one id are ordered by their leaves, and equal rows are
    leaves side by side. A tree of one leaf is that leaf. An empty table gives no rows.

    `proof_sha256` is the hash of all siblings on the way up. `folded_root` is folded from the siblings
    and the row's own leaf; where 3 divides the CRC-32 of the decimal doc_id, the text is tampered
    with first: its A-Z are lower-cased. A NULL id is not tampered with.
    """
    nodes = ranked(leaves(docs), "doc_id", "digest")
    phases = built(settle(nodes, "ranked"))
    subroots = phases[-1].select("tree", "digest")
    tops = built(settle(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name"), "ranked"))
    no_path = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    top = tops[-1].select("tree", "block", no_path, F.col("digest").alias("root"))
    roots = opened(tops, top).select(F.col("node.name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("node.digest").alias("subroot"), "root")
    proofs = opened(phases, settle(roots, "roots"))
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = F.aggregate("path", F.coalesce("node.other", "node.digest"), lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))
    return proofs.select(
        F.col("node.doc_id").alias("doc_id"), F.col("node.digest").alias("leaf"), "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
