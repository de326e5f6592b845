"""Demand planning on Spark: DataFrame operators from raw sales to scenarios."""
