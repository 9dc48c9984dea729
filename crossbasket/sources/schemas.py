"""Declared schemas of the lookup files."""

from __future__ import annotations

from pyspark.sql import types as T


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


MAINCAT_MAPPING = _text("maincat_desc", "arti_cate_name", "bu_desc")
CATEGORY_MAPPING = _text("category_desc", "arti_cate_name")
SUBCAT_CODES = T.StructType(
    [
        T.StructField("item_subcat_desc", T.StringType()),
        T.StructField("arti_cate_code", T.IntegerType()),
    ]
)
CATEGORY_CODES = T.StructType(
    [
        T.StructField("arti_cate_code", T.IntegerType()),
        T.StructField("arti_cate_name", T.StringType()),
    ]
)
ISSUE_LIST = _text("member_no", "issue_location", "issue_location_name")
UNIQUE_CUSTOMERS = T.StructType(
    [T.StructField("pair", T.StringType()), T.StructField("n", T.LongType())]
)
