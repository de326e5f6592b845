"""Best-fit packing of documents into fixed token windows under conflict constraints."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import pick, settle, words

CAPACITY = 2048
SHARD_ROWS = 8192
PACKED = "doc_id long, piece int, n_tokens long, source string, cluster string, shard int, bin long, bin_offset long"


class Bins:
    """Open bins ordered by residual; each carries a bitmap of its sources and of its clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []
        self.by_residual: dict[int, dict[int, list[int]]] = {}
        self.clusters: list[int] = []

    def _put(self, number: int, residual: int, sources: int) -> None:
        if residual not in self.by_residual:
            insort(self.residuals, residual)
            self.by_residual[residual] = {}
        self.by_residual[residual].setdefault(sources, []).append(number)

    def place(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece: the tightest bin without its source and cluster, else a new one."""
        for at in range(bisect_left(self.residuals, need), len(self.residuals)):
            residual = self.residuals[at]
            groups = self.by_residual[residual]
            for sources, numbers in groups.items():
                if sources & source:
                    continue
                for i, number in enumerate(numbers):
                    if self.clusters[number] & cluster:
                        continue
                    numbers.pop(i)
                    if not numbers:
                        del groups[sources]
                        if not groups:
                            del self.by_residual[residual]
                            self.residuals.pop(at)
                    self.clusters[number] |= cluster
                    if residual > need:
                        self._put(number, residual - need, sources | source)
                    return number, self.capacity - residual
        self.clusters.append(cluster)
        number = len(self.clusters) - 1
        if self.capacity > need:
            self._put(number, self.capacity - need, source)
        return number, 0


def _bits(values: list[str | None], shared_only: bool) -> list[int]:
    """One bit per distinct value; 0 for NULL and, if wanted, for values that occur once."""
    counts = Counter(v for v in values if v is not None)
    chosen = sorted(v for v, n in counts.items() if n > 1 or not shared_only)
    bit = {v: 1 << i for i, v in enumerate(chosen)}
    return [bit.get(v, 0) for v in values]


def _pack_shard(pieces: pa.Table, capacity: int) -> pa.Table:
    keys = [("n_tokens", "descending")] + [(k, "ascending") for k in ("doc_id", "piece", "source", "cluster")]
    pieces = pieces.take(pc.sort_indices(pieces, sort_keys=keys, null_placement="at_start"))
    sources = _bits(pieces["source"].to_pylist(), False)
    clusters = _bits(pieces["cluster"].to_pylist(), True)
    bins = Bins(capacity)
    placed = [bins.place(n, s, c) for n, s, c in zip(pieces["n_tokens"].to_pylist(), sources, clusters)]
    return pieces.append_column("bin", pa.array([p[0] for p in placed], pa.int64())).append_column(
        "bin_offset", pa.array([p[1] for p in placed], pa.int64())
    )


def pack(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Bins for items with doc_id, n_tokens, source and cluster.

    Items longer than the capacity are cut into full pieces and a rest, none is lost. Pieces are
    dealt to shards of about `shard_rows` by a hash of their values and their place in the written table, and each shard is packed by best fit,
    longest piece first: the search goes on through the bins in order of their residual until one
    holds neither the source nor the cluster of the piece. A bin is named by (shard, bin). Items
    without tokens get no bin. A NULL source or cluster conflicts with nothing. Repeated rows are
    packed as often as they occur; ties are taken by doc_id, piece, source and cluster.
    """
    base = items.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n_tokens"),
        F.col("source").cast("string").alias("source"),
        F.col("cluster").cast("string").alias("cluster"),
    )
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("long"))
    pieces = settle(
        base.select("doc_id", "source", "cluster", "n_tokens", F.explode(cuts).alias("piece")).select(
            "doc_id",
            F.col("piece").cast("int").alias("piece"),
            F.least(F.col("n_tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("n_tokens"),
            "source",
            "cluster",
            F.monotonically_increasing_id().alias("row"),
        ),
        "pieces",
    )
    filled = pieces.where("n_tokens > 0")
    shards = max(1, -(-filled.count() // shard_rows))
    # The written row's number parts the copies of a repeated row, which would else fill one shard.
    key = F.xxhash64("doc_id", "piece", "source", "cluster", "row")
    dealt = filled.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int")).drop("row")

    def run(group: pa.Table) -> pa.Table:
        return _pack_shard(group, capacity)

    empty = pieces.where("n_tokens <= 0").select(
        "doc_id", "piece", "n_tokens", "source", "cluster",
        F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("bin_offset"),
    )
    return dealt.groupBy("shard").applyInArrow(run, PACKED).unionByName(empty)


def packing_items(docs: DataFrame) -> DataFrame:
    """doc_id, number of words, source, and a cluster shared by texts that are equal but for case and spacing."""
    base = pick(docs, "doc_id", "text", "source")
    tokens = base.select("doc_id", "source", words(F.lower("text")).alias("words"))
    return tokens.select(
        "doc_id", "source", F.size("words").cast("long").alias("n_tokens"),
        F.when(F.size("words") > 0, F.md5(F.array_join("words", " "))).alias("cluster"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`pack` for a table with doc_id, text and source; copies of a text never share a bin."""
    return pack(packing_items(docs), capacity, shard_rows)
