"""Planning datasets seen in a star schema of orders (region ... lineitem, events).

The views hold no hints and no limits: Spark prunes their columns, and picks broadcast joins
for the dimension tables only where their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ways in which a file may write its dates, dealt out by line number.
RAW_DATE_FORMATS = ["M/d/yyyy", "yyyy-MM-dd", "M/d/yy", "yyyyMMdd", "M-d-yyyy", "d.M.yyyy", "MMM d, yyyy"]


class StarViews:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _with_region(self, facts: DataFrame, nation_key: str) -> DataFrame:
        """Adds `location`, the region's name.

        The facts come first and each dimension is joined on its own: Spark then knows every
        dimension's size and can broadcast it, instead of guessing the size of a joined one.
        """
        nation, region = self.table("nation"), self.table("region")
        return (
            facts.join(nation, F.col(nation_key) == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumnRenamed("r_name", "location")
        )

    def _supplied(self, sold: DataFrame) -> DataFrame:
        """Sales with the region of their supplier."""
        return self._with_region(sold.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")), "s_nationkey")

    def _sold(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_shipdate").cast("date").alias("date"), "l_partkey", "l_suppkey",
            F.col("l_quantity").alias("quantity"), "l_orderkey", "l_linenumber",
        )

    def sales(self) -> DataFrame:
        """Sales by brand and region of the supplier."""
        branded = self._sold().join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return self._supplied(branded).select("date", F.col("p_brand").alias("sku"), "location", "quantity")

    def brand_sales(self) -> DataFrame:
        """Sales by brand without location, for series that do not use it."""
        return self._sold().join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            "date", F.col("p_brand").alias("sku"), "quantity"
        )

    def part_sales(self) -> DataFrame:
        """Sales by part without location."""
        return self._sold().select("date", part_sku(F.col("l_partkey")).alias("sku"), "quantity")

    def located_part_sales(self) -> DataFrame:
        """Sales by part and region of the supplier."""
        return self._supplied(self._sold()).select(
            "date", part_sku(F.col("l_partkey")).alias("sku"), "location", "quantity"
        )

    def raw_sales(self) -> DataFrame:
        """Sales as a file might name them, all as text, with dates in mixed formats."""
        way = F.pmod("l_linenumber", F.lit(len(RAW_DATE_FORMATS)))
        written = F.lit(None).cast("string")
        for i, date_format in enumerate(RAW_DATE_FORMATS):
            written = F.when(way == i, F.date_format("date", date_format)).otherwise(written)
        return self._supplied(self._sold()).select(
            written.alias("Order_Date"),
            part_sku(F.col("l_partkey")).alias("Product ID"),
            F.col("location").alias("Region"),
            F.col("quantity").cast("string").alias("Order Qty"),
            F.format_string("%d", "l_orderkey").alias("Invoice"),
            F.col("l_linenumber").alias("Line"),
        )

    def _ordered(self) -> DataFrame:
        bought = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return self._with_region(bought, "c_nationkey")

    def signals(self) -> DataFrame:
        """Order facts per day and customer region, as external signals."""
        return self._ordered().groupBy(F.col("o_orderdate").cast("date").alias("date"), "location").agg(
            F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("is_holiday"),
            (F.avg("c_acctbal") / 100).alias("temperature"),
            F.count("*").cast("double").alias("google_trends_index"),
            F.avg((F.col("o_orderpriority") == "2-HIGH").cast("double")).alias("promotion"),
            F.avg("o_totalprice").alias("price"),
        )

    def order_signals(self) -> DataFrame:
        """One signal row per order, so that (date, location) keys repeat."""
        return self._ordered().select(F.col("o_orderdate").cast("date").alias("date"), "location", F.col("o_totalprice").alias("price"))

    def event_sales(self) -> DataFrame:
        """Purchase events by user."""
        return self.table("events").where(F.col("event_type") == "purchase").select(
            F.col("ts").cast("date").alias("date"),
            F.concat(F.lit("USER-"), F.col("user_id").cast("string")).alias("sku"),
            F.col("value").alias("quantity"),
        )


def part_sku(key: Column) -> Column:
    return F.concat(F.lit("SKU-"), key.cast("string"))
