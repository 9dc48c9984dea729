"""Retail roles derived from a TPC-H-like star schema.

The driver's tables hold no member files or contacts, so the two chains' inputs are derived
from them, deterministically and over all rows: lines of status F are chain A's sales, those
of status O chain B's, and shops of two nations carry B's carve-out. Member numbers, e-mails and phones grow with the customers
(no wrap-around), with a few rows per member and a few members per contact; one placeholder phone
is shared by a fixed part of the members of both chains.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbasket.functions.text import trim_all
from crossbasket.operators.sales import enrich_member
from crossbasket.operators.skew import growing
from crossbasket.sources.tables import read_table

ODD_DATE = "1998-05-01"
DUMMY_ITEM = "7"
CARVEOUT_BRAND = "CV"
HOME_REGION = "HK"

# A member's number per chain out of the customer number ``ck``; some customers share one.
NUMBER_A = """CAST(2 + (ck - CASE WHEN ck % 5 = 4 THEN 4 ELSE 0 END) % 3 AS STRING) || '0'
    || CAST(ck - CASE WHEN ck % 5 = 4 THEN 4 ELSE 0 END AS STRING)"""
NUMBER_B = "'C' || CAST(ck - CASE WHEN ck % 3 = 2 THEN 1 ELSE 0 END AS STRING)"


class Roles:
    """The raw inputs of both chains, as lazy frames over the tables in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}
        self._staged_b: DataFrame | None = None

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def _lines(self) -> DataFrame:
        orders = self._table("orders").selectExpr(
            "o_orderkey AS l_orderkey", "o_custkey AS ck", "CAST(o_orderdate AS DATE) AS order_date"
        )
        parts = self._table("part").selectExpr(
            "p_partkey AS l_partkey",
            "CASE WHEN p_partkey % 29 <> 0 THEN p_brand END AS brand",
            "p_name",
            "p_type",
            "p_size",
            "split_part(p_name, ' ', 2) AS noun",
        )
        lines = self._table("lineitem").selectExpr(
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_returnflag",
            "l_linestatus",
            "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amt",
            "CAST(l_quantity AS DECIMAL(18,0)) AS qty",
        )
        return lines.join(growing(orders), "l_orderkey").join(growing(parts), "l_partkey")

    def _suppliers(self) -> DataFrame:
        nation = self._table("nation").withColumnRenamed("n_nationkey", "s_nationkey")
        region = self._table("region").withColumnRenamed("r_regionkey", "n_regionkey")
        return self._table("supplier").join(nation, "s_nationkey").join(region, "n_regionkey")

    def sales_a(self) -> DataFrame:
        return (
            self._lines()
            .where("l_linestatus = 'F'")
            .selectExpr(
                f"{NUMBER_A} AS vip_no",
                "CAST(l_orderkey AS STRING) AS order_no",
                "order_date",
                "date_format(order_date, 'yyyyMMdd') AS order_ymd",
                "CAST(l_suppkey AS STRING) AS loc_code",
                "brand AS brand_desc",
                "' ' || p_name AS prod_desc",
                "p_type AS category_desc",
                "p_type AS class_desc",
                "noun AS subclass_desc",
                """CASE p_size % 5 WHEN 0 THEN 'COS' WHEN 1 THEN 'WW' WHEN 2 THEN 'MW'
                   WHEN 3 THEN 'HL' ELSE 'LSA' END AS bu_desc""",
                "amt",
                "qty",
            )
        )

    def order_numbers_a(self) -> DataFrame:
        """The order number of each of chain A's lines, before orders and parts are joined to it."""
        lines = self._table("lineitem").where("l_linestatus = 'F'")
        return lines.selectExpr("CAST(l_orderkey AS STRING) AS order_no")

    def stores(self) -> DataFrame:
        return self._suppliers().selectExpr(
            "CAST(s_suppkey AS STRING) AS store_id",
            "r_name AS vat_region_name",
            "s_name AS store_name",
        )

    def with_sales_b(self, staged: DataFrame) -> Roles:
        """The same roles with chain B's raw lines read from where they were written."""
        roles = copy.copy(self)
        roles._staged_b = staged
        return roles

    def sales_b(self) -> DataFrame:
        """Raw lines of chain B, the carve-out's included."""
        if self._staged_b is not None:
            return self._staged_b
        regions = self._suppliers().selectExpr(
            "s_suppkey AS l_suppkey",
            """CASE r_name WHEN 'ASIA' THEN 'HK' WHEN 'EUROPE' THEN 'IH'
               ELSE substr(r_name, 1, 2) END AS region_key""",
            f"""CASE WHEN n_name IN ('NATION_7', 'NATION_12') THEN '{CARVEOUT_BRAND}'
               ELSE 'BX' END AS shop_brand""",
        )
        return (
            self._lines()
            .where("l_linestatus = 'O'")
            .join(regions, "l_suppkey")
            .selectExpr(
                "'V' || CAST(ck AS STRING) AS vip_no",
                "CAST(l_suppkey AS STRING) AS shop_code",
                "CAST(l_orderkey AS STRING) AS invoice_no",
                "order_date",
                "region_key",
                "' ' || brand || ' ' AS prod_brand",
                "CAST(l_partkey AS STRING) AS item_code",
                "noun AS item_subcat_desc",
                "shop_brand",
                """CASE WHEN l_linenumber % 2 = 0 THEN CAST(order_date AS STRING) || ' pos'
                   ELSE 'manual' END AS invoice_remark""",
                """CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 0 ELSE 1 END
                   AS valid_tx_flag""",
                "CASE WHEN l_linenumber = 7 THEN 'V' END AS void_flag",
                "amt",
                "qty",
            )
        )

    def brands(self) -> DataFrame:
        """All brands but one, with their display names."""
        named = self._table("part").where("p_brand <> 'Brand#13'")
        return named.selectExpr(
            "p_brand || '  ' AS brand_code", "upper(p_brand) AS brand_desc"
        ).distinct()

    def sku_versions(self) -> DataFrame:
        """Two versions per item: alike in all, alike in the date only, of different dates,
        or without any."""
        versions = self._table("part").selectExpr("*", "explode(array(0, 1)) AS version")
        return versions.selectExpr(
            "CAST(p_partkey AS STRING) AS item_code",
            "p_name AS item_desc",
            """CASE WHEN p_partkey % 8 = 4 THEN 'v' ELSE 'v' || CAST(version AS STRING) END
               AS item_desc_c""",
            "substr(p_type, 1, 2) AS item_cat",
            "p_brand AS brand_code",
            """CASE WHEN p_partkey % 19 = 0 THEN NULL
               WHEN version = 0 OR p_partkey % 4 = 0 THEN DATE '1998-01-01'
               ELSE DATE '1999-01-01' END AS last_modified_date""",
        )

    def shops(self) -> DataFrame:
        return self._table("supplier").selectExpr(
            "CAST(s_suppkey AS STRING) AS shop_code", "s_name AS shop_desc"
        )

    def categories(self) -> DataFrame:
        return self._table("part").selectExpr(
            "substr(p_type, 1, 2) AS maincat_code", "p_type AS maincat_desc"
        ).distinct()

    def mapping_a(self) -> DataFrame:
        return self._table("part").selectExpr(
            "p_type AS category_desc",
            """CASE p_type WHEN 'STANDARD' THEN 'Skincare' WHEN 'SMALL' THEN 'Makeup'
               WHEN 'MEDIUM' THEN 'Accessories' END AS arti_cate_name""",
        ).where("arti_cate_name IS NOT NULL").distinct()

    def mapping_b(self) -> DataFrame:
        return self._table("part").selectExpr(
            "p_type AS maincat_desc",
            """CASE p_type WHEN 'STANDARD' THEN 'Skincare' WHEN 'SMALL' THEN 'Makeup'
               WHEN 'LARGE' THEN 'Fragrance' WHEN 'PROMO' THEN 'Haircare' END AS arti_cate_name""",
            "CASE p_type WHEN 'SMALL' THEN 'MW' ELSE 'WW' END AS bu_desc",
        ).where("arti_cate_name IS NOT NULL").distinct()

    def subcat_codes(self) -> DataFrame:
        """Subcategory to category code by the length of the word: one code for most, a second
        one for words of five letters, the same row twice for words of four."""
        codes = self._table("part").selectExpr(
            "split_part(p_name, ' ', 2) AS item_subcat_desc",
            "length(split_part(p_name, ' ', 2)) AS arti_cate_code",
        ).distinct()
        second = codes.where("arti_cate_code = 5").withColumn("arti_cate_code", F.lit(15))
        return codes.unionByName(second).unionByName(codes.where("arti_cate_code = 4"))

    def category_codes(self) -> DataFrame:
        """Category codes with names; code 6 is missing."""
        return self.subcat_codes().where("arti_cate_code <> 6").selectExpr(
            "arti_cate_code", "'Group ' || CAST(arti_cate_code AS STRING) AS arti_cate_name"
        ).distinct()

    def _customers(self) -> DataFrame:
        first = self._table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
        first = first.selectExpr(
            "o_custkey AS ck", "CAST(CAST(first AS DATE) AS STRING) AS first_buy"
        )
        nation = self._table("nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS nation")
        customers = self._table("customer").selectExpr("c_custkey AS ck", "c_nationkey")
        return customers.join(growing(first), "ck", "left").join(nation, "c_nationkey")

    def members_a(self) -> DataFrame:
        return self._customers().selectExpr(
            f"{NUMBER_A} AS vip_no",
            """CASE WHEN ck % 11 = 0 THEN '' WHEN ck % 13 = 0 THEN NULL
               WHEN ck % 19 = 0 THEN ' User' || CAST(ck AS STRING) || '@x.com '
               ELSE 'User' || CAST(ck AS STRING) || '@x.com' END AS email""",
            """CASE WHEN ck % 7 = 0 THEN NULL WHEN ck % 50 = 8 THEN '852-00000000' ELSE
               CASE ck % 4 WHEN 0 THEN '+852' WHEN 1 THEN '852-' WHEN 2 THEN ' ' ELSE '+86' END
               || CAST(50000000 + ck - ck % 3 AS STRING) END AS phone_no""",
            "CASE ck % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS sex",
            "CAST(1950 + ck % 50 AS STRING) || '-01-01' AS birth_date",
            """CASE ck % 5 WHEN 0 THEN 'Tracking' WHEN 1 THEN 'Gold' WHEN 2 THEN 'Diamond'
               WHEN 3 THEN 'Platinum' ELSE 'Privilege' END AS card_type""",
            "CASE ck % 4 WHEN 0 THEN 'COS' WHEN 1 THEN 'HL' WHEN 2 THEN 'WW' END AS join_bu_desc",
            """CASE WHEN ck % 17 = 0 THEN '3999-12-31'
               ELSE CAST(1990 + ck % 9 AS STRING) || '-06-15' END AS card_start_date""",
            "first_buy AS first_transaction_date",
            "nation AS country_of_residence",
        )

    def members_b(self) -> DataFrame:
        return self._customers().selectExpr(
            f"""CASE WHEN ck % 23 = 0 THEN 'V' || CAST(ck AS STRING) ELSE {NUMBER_B} END
               AS vip_main_no""",
            """CASE WHEN ck % 5 = 0 THEN NULL
               WHEN ck % 4 = 1 THEN 'uSER' || CAST(ck AS STRING) || '@X.com'
               WHEN ck % 4 = 2 THEN 'uSER' || CAST(ck - 1 AS STRING) || '@X.com'
               ELSE 'other' || CAST(ck AS STRING) || '@x.com' END AS vip_email""",
            """CASE WHEN ck % 10 = 0 THEN '' WHEN ck % 12 = 9 THEN '85200000000'
               WHEN ck % 8 = 1 THEN '852' || CAST(50000000 + ck - ck % 3 AS STRING)
               WHEN ck % 2 = 0 THEN '852' || CAST(50000000 + ck AS STRING)
               ELSE '9' || CAST(50000000 + ck AS STRING) END AS vip_tel_2""",
            "CASE ck % 2 WHEN 0 THEN 'F' ELSE 'M' END AS vip_sex",
            "CAST(ck % 6 AS STRING) AS vip_type",
            "CAST(1950 + ck % 50 AS STRING) AS vip_birth_iyy",
            "CAST(1 + ck % 12 AS STRING) AS vip_birth_imm",
            "CAST(1 + ck % 28 AS STRING) AS vip_birth_idd",
            "first_buy AS vip_first_pur_date",
            "CASE WHEN ck % 31 <> 0 THEN first_buy END AS vip_issue_date",
            "nation AS region_key",
        )

    def member_map(self) -> DataFrame:
        """Member number to main number: none for some, a second, larger one for others."""
        twice = self._table("customer").selectExpr("c_custkey AS ck", "explode(array(0, 1)) AS nth")
        return twice.selectExpr(
            "'V' || CAST(ck AS STRING) AS vip_no",
            f"""CASE WHEN ck % 23 = 0 THEN NULL WHEN nth = 0 THEN {NUMBER_B}
               WHEN ck % 10 = 0 THEN 'D' || CAST(ck AS STRING) END AS vip_main_no""",
        )

    def types(self) -> DataFrame:
        # Member types; a code can mean different things in two regions.
        return self.spark.sql(
            """
            SELECT * FROM VALUES
              ('0', 'ICARD Gold', 'HK'),
              ('1', 'ICARD Silver', 'HK'),
              ('2', 'JB1', 'HK'),
              ('3', 'STAFF', 'HK'),
              ('4', 'ICARD Diamond', 'HK'),
              ('0', 'OLD', 'TW'),
              ('5', 'OLD', 'TW')
            AS t(viptyp_code, viptyp_desc, region_key)
            """
        )

    def issue_list(self, hot: DataFrame | None = None) -> DataFrame:
        """Every carve-out customer with the place of joining: the smallest shop code they
        bought at."""
        sales = self.sales_b().filter(F.col("shop_brand") == CARVEOUT_BRAND)
        lines = enrich_member(
            trim_all(sales), self.member_map(), "vip_no", "vip_main_no", hot, ["invoice_no"]
        )
        first = lines.groupBy("vip_main_no").agg(F.min("shop_code").alias("issue_location"))
        return first.withColumnRenamed("vip_main_no", "member_no")
