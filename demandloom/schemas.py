"""Dataset kinds and their columns."""

from __future__ import annotations

from pyspark.sql import types as T

# The dataset kinds and the columns each must have.
REQUIRED_COLUMNS = {
    "sales": [],
    "inventory": ["date", "sku", "location", "stock_level"],
    "production": ["date", "line_id", "sku", "capacity"],
    "purchase_orders": ["po_id", "sku", "supplier", "location", "order_date", "eta_date"],
    "master_data": ["sku", "description", "category", "uom"],
    "external_signals": ["date", "location"],
}
KINDS = tuple(REQUIRED_COLUMNS)

# Sales roles and the names that stand for them.
SALES_ROLES = {
    "date": ["date", "order_date", "orderdate"],
    "sku": ["sku", "product", "item", "product_id", "productid"],
    "location": ["location", "region", "store", "warehouse", "country"],
    "quantity": ["quantity", "qty", "units", "orderquantity", "order_qty"],
}
NO_SKU, NO_LOCATION = "ALL-SKU", "ALL-LOC"

# Signal columns; the first is filled with 0, the others with their mean.
HOLIDAY = "is_holiday"
MEAN_SIGNALS = ["temperature", "google_trends_index", "promotion", "price"]

# Types given to known columns of text files; all other columns stay as they are read.
COLUMN_TYPES = {
    "inventory": {"date": "date", "stock_level": "double"},
    "production": {"date": "date", "capacity": "double"},
    "purchase_orders": {"order_date": "date", "eta_date": "date"},
    "master_data": {},
    "external_signals": {"date": "date", HOLIDAY: "int", **{c: "double" for c in MEAN_SIGNALS}},
}

# Texts that a data file uses for "missing".
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

FORECAST_POINT = T.StructType(
    [
        T.StructField("sku", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("q10", T.DoubleType()),
        T.StructField("q50", T.DoubleType()),
        T.StructField("q90", T.DoubleType()),
    ]
)
