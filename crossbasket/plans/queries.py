"""The registered queries: every operator over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbasket.functions import (
    card_date_sentinel,
    category_default,
    cleanse_phone,
    labelled,
    order_date_format,
    tenure_group,
    tenure_years,
    tier_whitelist,
    trim_all,
    update_tier,
)
from crossbasket.functions.tiers import (
    BEAUTY_TIERS,
    FASHION_TIERS,
    OTHER_TIER,
    TIER_ORDER_A,
    TIER_ORDER_B,
)
from crossbasket.operators import cohort, kpi, labels, matching, members, profile, sales, stores
from crossbasket.operators.skew import spread_join
from crossbasket.plans import mart as marts
from crossbasket.plans import reports
from crossbasket.plans.mart import LINE_A, LINE_B, PAIRS, Mart, Scope, key_of, mart_for
from crossbasket.sources.roles import Roles
from crossbasket.sources.schemas import MAINCAT_MAPPING
from crossbasket.sources.tables import mapping_with_codes, read_mapping, register_views

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2001-12-31"
EARLY_AS_OF = "1998-06-30"
FASHION_UNITS = ("WW", "MW", "LSA", "MSA")
BRAND = "Brand#2"
BRAND_UPPER = "BRAND#2"
COHORT_BRANDS = ("BRAND#1", "BRAND#2", "BRAND#3", "BRAND#4", "BRAND#5")
SHOPS_C = ("6", "22", "49", "50", "84", "94", "118", "132", "161", "169", "210")
SHOPS_B = ("7", "9", "14", "18", "27")
FIRST_YEAR = ("1997-04-01", "1998-03-31")
SECOND_YEAR = ("1998-04-01", "1999-03-31")

_QUERIES: dict[str, Query] = {}


def _raw(name: str):
    """Registers a query over the raw roles."""

    def register(build: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        _QUERIES[name] = lambda spark, folder: build(Roles(spark, folder))
        return build

    return register


def _on_mart(name: str):
    """Registers a query over the written datamart."""

    def register(build: Callable[[Mart], DataFrame]) -> Callable[[Mart], DataFrame]:
        _QUERIES[name] = lambda spark, folder: build(mart_for(spark, folder))
        return build

    return register


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def _double(col: Column, digits: int = 4) -> Column:
    return F.round(col.cast("double"), digits)


def _lines(df: DataFrame, *dims: str) -> DataFrame:
    """Lines and amount per combination of ``dims``."""
    return df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n_lines"), _double(F.sum("amt")).alias("amt")
    )


def _sides(**frames: DataFrame) -> DataFrame:
    tagged = [df.select(F.lit(side).alias("side"), "*") for side, df in frames.items()]
    return reduce(DataFrame.unionByName, tagged)


# --- sources and sinks


@_on_mart("mapping_lookup")
def mapping_lookup(mart: Mart) -> DataFrame:
    """A mapping file, with a stray blank in its header, looked up for every line."""
    mapping = read_mapping(mart.spark, f"{mart.root}/mapping", MAINCAT_MAPPING)
    mapping = mapping.select(
        F.col("maincat_desc").alias("category_desc"),
        "arti_cate_name",
        F.col("bu_desc").alias("mapped_unit"),
    )
    mapped = mart.roles.sales_a().join(mapping, ["category_desc"], "left")
    mapped = mapped.withColumn("arti_cate_name", category_default(F.col("arti_cate_name")))
    return _lines(mapped, "arti_cate_name", "mapped_unit")


@_raw("category_mapping_dim")
def category_mapping_dim(roles: Roles) -> DataFrame:
    return mapping_with_codes(roles.subcat_codes(), roles.category_codes(), "arti_cate_code")


@_on_mart("datamart_roundtrip")
def datamart_roundtrip(mart: Mart) -> DataFrame:
    """Rows and amounts of the datamart's tables as read back."""
    tables = [
        _lines(mart.tables[f"sales_{chain}"].withColumn("chain", F.lit(chain)), "chain")
        for chain in ("a", "cos", "b", "c")
    ]
    return reduce(DataFrame.unionByName, tables)


@_on_mart("issue_list")
def issue_list(mart: Mart) -> DataFrame:
    """A list of keys from a CSV file with blanks in its header."""
    return mart.issue_list()


@_on_mart("sales_view")
def sales_view(mart: Mart) -> DataFrame:
    """A figure in SQL over a registered view of the datamart."""
    register_views({"crossbasket_sales_a": mart.tables["sales_a"]})
    return mart.spark.sql(
        """
        SELECT bu_desc, in_b, count(*) AS n_lines, round(CAST(sum(amt) AS DOUBLE), 4) AS amt
        FROM crossbasket_sales_a GROUP BY bu_desc, in_b
        """
    )


# --- scalar functions


@_raw("trim_all")
def trim_all_rows(roles: Roles) -> DataFrame:
    return trim_all(roles.members_a()).select("vip_no", "email", "phone_no", "card_start_date")



@_raw("cleanse_phone")
def cleansed_phones(roles: Roles) -> DataFrame:
    of_a = roles.members_a().select(F.col("vip_no").alias("member"), F.col("phone_no").alias("raw"))
    of_b = roles.members_b().select(
        F.col("vip_main_no").alias("member"), F.col("vip_tel_2").alias("raw")
    )
    return of_a.unionByName(of_b).withColumn("cleaned", cleanse_phone(F.col("raw")))



@_raw("update_tier")
def updated_tiers(roles: Roles) -> DataFrame:
    tier = update_tier(F.col("vip_no"), F.col("join_bu_desc"), F.col("card_type"))
    return roles.members_a().select("vip_no", "join_bu_desc", "card_type", tier.alias("tier"))



@_raw("order_date_format")
def order_dates(roles: Roles) -> DataFrame:
    dated = roles.sales_a().withColumn("order_date", order_date_format(F.col("order_ymd")))
    return _lines(dated, "order_date")



@_raw("card_date_sentinel")
def card_dates(roles: Roles) -> DataFrame:
    updated = card_date_sentinel(F.col("card_start_date"))
    return roles.members_a().select("vip_no", "card_start_date", updated.alias("updated"))



@_raw("tier_whitelist")
def whitelisted_tiers(roles: Roles) -> DataFrame:
    types = roles.types().withColumnRenamed("viptyp_code", "vip_type").drop("region_key")
    tier = F.col("viptyp_desc")
    return (
        roles.members_b()
        .join(types, ["vip_type"], "left")
        .groupBy(
            "vip_type",
            tier_whitelist(tier, BEAUTY_TIERS).alias("beauty_tier"),
            tier_whitelist(tier, FASHION_TIERS).alias("fashion_tier"),
        )
        .agg(F.count(F.lit(1)).alias("n_members"))
    )



@_raw("category_default")
def defaulted_categories(roles: Roles) -> DataFrame:
    lines = roles.sales_a().join(roles.mapping_a(), ["category_desc"], "left")
    mapped = F.col("arti_cate_name")
    return _lines(
        lines.withColumn("category", category_default(mapped)).withColumn(
            "unit_category", category_default(mapped, F.col("bu_desc"))
        ),
        "category",
        "unit_category",
    )



@_on_mart("member_key_resolve")
def member_key_resolve(mart: Mart) -> DataFrame:
    lines = sales.enrich_member(
        mart.roles.sales_b().select("vip_no", "invoice_no", "item_code", "amt"),
        mart.roles.member_map(),
        "vip_no",
        "vip_main_no",
        mart.tables["hot_number"],
        LINE_B,
    )
    return _lines(lines, "vip_no", "vip_main_no")


@_raw("tenure_years")
def tenures(roles: Roles) -> DataFrame:
    since = F.col("vip_first_pur_date").try_cast("date")
    return roles.members_b().select(
        "vip_main_no",
        since.alias("since"),
        tenure_years(since, AS_OF).alias("years"),
        tenure_years(since, EARLY_AS_OF).alias("years_early"),
    )



@_raw("tenure_group")
def tenure_groups(roles: Roles) -> DataFrame:
    years = tenure_years(F.col("vip_first_pur_date").try_cast("date"), EARLY_AS_OF)
    grouped = roles.members_b().select(years.alias("years"))
    years = F.col("years")
    return grouped.groupBy(
        "years",
        tenure_group(years).alias("from_1"),
        tenure_group(years, low=0).alias("from_0"),
        tenure_group(years, low=0, strict=True).alias("strict"),
    ).agg(F.count(F.lit(1)).alias("n_members"))



# --- filters


@_raw("valid_transactions")
def valid_transactions(roles: Roles) -> DataFrame:
    return _lines(sales.valid_transactions(roles.sales_b()), "shop_code")


@_raw("exclude_brand")
def exclude_brand(roles: Roles) -> DataFrame:
    what = Scope()
    kept = sales.exclude_brand(roles.sales_a(), "brand_desc", what.carved_brand)
    return _lines(sales.exclude_brand(kept, "brand_desc", what.left_out_brand), "brand_desc")


@_raw("segment_in_out")
def segment_in_out(roles: Roles) -> DataFrame:
    lines = roles.sales_a()
    parts = _sides(
        inside=sales.segment(lines, "bu_desc", FASHION_UNITS),
        outside=sales.segment(lines, "bu_desc", FASHION_UNITS, negate=True),
    )
    return _lines(parts, "side", "bu_desc")


@_raw("sales_scope")
def sales_scope(roles: Roles) -> DataFrame:
    what = Scope()
    located = roles.sales_a().join(
        roles.stores().withColumnRenamed("store_id", "loc_code"), ["loc_code"], "left"
    )
    bounds = (what.start, what.end)
    of_a = sales.scope(located, "order_date", *bounds, "vat_region_name", what.regions_a)
    of_b = sales.scope(
        marts.valid_sales_b(roles), "order_date", *bounds, "region_key", what.regions_b
    )
    both = _sides(
        a=of_a.select(F.col("vat_region_name").alias("region"), "order_date", "amt"),
        b=of_b.select(F.col("region_key").alias("region"), "order_date", "amt"),
    )
    return both.groupBy("side", "region").agg(
        F.count(F.lit(1)).alias("n_lines"),
        _double(F.sum("amt")).alias("amt"),
        F.min("order_date").alias("first_date"),
        F.max("order_date").alias("last_date"),
    )


# --- members and sales


@_raw("golden_record_a")
def golden_record_a(roles: Roles) -> DataFrame:
    return marts.golden_a(roles)


@_raw("golden_record_b")
def golden_record_b(roles: Roles) -> DataFrame:
    return marts.golden_b(roles)


@_raw("member_type_join")
def member_type_join(roles: Roles) -> DataFrame:
    typed = members.member_type_join(roles.members_b(), roles.types(), "HK", FASHION_TIERS)
    return typed.select("vip_main_no", "vip_sex", "region_key", "viptyp_desc_cleaned")


@_raw("member_attribute_fetch")
def member_attribute_fetch(roles: Roles) -> DataFrame:
    """Typed members with the birth years of all their raw rows, as often as a self join repeats them."""
    names = ["vip_main_no", "vip_type", "vip_sex", "region_key", "vip_birth_iyy"]
    raw = roles.members_b().select(*names)
    types = roles.types().filter("region_key = 'HK'").select(F.col("viptyp_code").alias("vip_type"))
    return members.fetch_attribute(raw.join(types, ["vip_type"]), raw, "vip_main_no", "vip_birth_iyy")


@_raw("active_members")
def active_members(roles: Roles) -> DataFrame:
    golden = marts.golden_a(roles).drop("email", "mobile")
    return members.active_members(golden, marts.scoped_sales_a(roles, Scope()), "vip_no")


@_on_mart("enrich_sales")
def enrich_sales(mart: Mart) -> DataFrame:
    lines = marts.enriched_sales_b(mart.roles, mart.roles.sales_b(), mart.tables["hot_number"])
    return lines.groupBy("brand_desc", "maincat_desc", "arti_cate_name", "bu_desc").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.countDistinct("vip_main_no").alias("n_members"),
        _double(F.sum("amt")).alias("amt"),
    )


@_raw("latest_per_key")
def latest_per_key(roles: Roles) -> DataFrame:
    return marts.current_skus(roles)


@_raw("brand_code_lookup")
def brand_code_lookup(roles: Roles) -> DataFrame:
    return sales.brand_code_lookup(roles.sales_b(), roles.brands())


@_raw("carveout_keys")
def carveout_keys(roles: Roles) -> DataFrame:
    return marts.keys_of_c(roles)


def _carveout(mart: Mart) -> dict:
    """The written keys of the carve-out and how to deal the lines of a hot one."""
    return {"keys": mart.tables["keys_c"], "hot": mart.tables["hot_key"], "by": LINE_B}


@_on_mart("exclude_carveout")
def exclude_carveout(mart: Mart) -> DataFrame:
    kept = sales.exclude_carveout(marts.valid_sales_b(mart.roles), **_carveout(mart))
    return _lines(kept, "shop_code", "region_key")


@_on_mart("carveout_semi")
def carveout_semi(mart: Mart) -> DataFrame:
    kept = sales.carveout_semi(marts.valid_sales_b(mart.roles), **_carveout(mart))
    return _lines(kept, "shop_code", "region_key")


@_on_mart("carveout_sales")
def carveout_sales(mart: Mart) -> DataFrame:
    """Chain C's lines with a brand, over all dates, and its transactions that have none."""
    lines = marts.valid_sales_b(mart.roles).filter(F.col("prod_brand").isNotNull())
    lines = lines.withColumn("arti_cate_name", F.lit("b's own"))
    mapping = marts.mapping_c(mart.roles).withColumnRenamed("c_cate_name", "arti_cate_name")
    rows = sales.carveout_sales(lines, mapping=mapping, **_carveout(mart))
    return rows.select(
        "sales_main_key",
        "item_code",
        "item_subcat_desc",
        "arti_cate_name",
        _double(F.col("amt")).alias("amt"),
    )


@_on_mart("brand_info")
def brand_info(mart: Mart) -> DataFrame:
    return _brand_info(mart, by_year=False)


@_on_mart("brand_info_by_year")
def brand_info_by_year(mart: Mart) -> DataFrame:
    return _brand_info(mart, by_year=True)


def _brand_info(mart: Mart, by_year: bool) -> DataFrame:
    lines = mart.tables["history_b"]
    lines = lines.filter((F.col("region_key") == "HK") & F.col("prod_brand").isin(BRAND, "Brand#3"))
    kept = sales.exclude_carveout(
        lines, mart.tables["keys_c"], hot=mart.tables["hot_key"], by=["vip_main_no", "prod_brand"]
    )
    return profile.brand_info(
        kept, "prod_brand", "vip_main_no", "sales_main_key", "order_date", by_year
    )


# --- matching


@_on_mart("match_customers")
def match_customers(mart: Mart) -> DataFrame:
    return matching.match_customers(
        mart.members("a"), mart.members("b"), "vip_no", "vip_main_no", "a", "b"
    )


@_on_mart("unique_customers")
def unique_customers(mart: Mart) -> DataFrame:
    """Unique customers of every pair; pairs with the same second chain share a join."""
    counts = []
    for b in ("b", "c"):
        firsts = [a for a, second in PAIRS if second == b]
        partners = matching.smallest_partners(
            mart.members(b), key_of(b), {a: (mart.members(a), key_of(a)) for a in firsts}
        )
        one_row = partners.agg(*[F.countDistinct(a).alias(f"{a}_{b}") for a in firsts])
        counts.append(one_row.unpivot([], None, "pair", "n"))
    return reduce(DataFrame.unionByName, counts)


@_on_mart("label_overlap")
def label_overlap(mart: Mart) -> DataFrame:
    a, b, c = (mart.members(chain) for chain in ("a", "b", "c"))
    lines = mart.tables["sales_a"].drop("in_b", "in_c")
    overlaps = {
        "in_b": matching.overlap_keys(a, b, "vip_no"),
        "in_c": matching.overlap_keys(a, c, "vip_no"),
    }
    marked = labels.label_overlap(lines, "vip_no", overlaps, hot=mart.tables["hot_a"], by=LINE_A)
    return marked.select(
        "vip_no", "order_no", "loc_code", "prod_desc", _double(F.col("amt")).alias("amt"),
        "in_b", "in_c",
    )


def _brand_buyers_b(mart: Mart) -> DataFrame:
    """Active members of B who bought the brand in scope."""
    lines = mart.tables["sales_b"].filter(F.col("prod_brand") == BRAND)
    return members.active_members(mart.members("b"), lines, "vip_main_no")


def _brand_lines_a(mart: Mart) -> DataFrame:
    return mart.tables["sales_a"].filter(F.col("brand_desc").contains(BRAND))


@_on_mart("brand_pairs")
def brand_pairs(mart: Mart) -> DataFrame:
    return matching.match_customers(
        mart.members("a"), _brand_buyers_b(mart), "vip_no", "vip_main_no", "a", "b", False
    )


def _fanned_out_a(mart: Mart, lines: DataFrame | None = None, how: str = "left") -> DataFrame:
    """A's lines marked by, and weighted with, their matches among B's brand buyers."""
    pairs = matching.pairs_per_member(mart.members("a"), _brand_buyers_b(mart), "vip_no")
    lines = mart.tables["sales_a"] if lines is None else lines
    return labels.label_fanout(
        lines.drop("in_b", "in_c"), "vip_no", pairs, "in_b", "copies", how, mart.tables["hot_a"], LINE_A
    )


@_on_mart("label_fanout")
def label_fanout(mart: Mart) -> DataFrame:
    return _fanned_out_a(mart).groupBy("in_b").agg(
        F.sum("copies").alias("n_lines"),
        F.countDistinct("order_no").alias("n_orders"),
        _double(F.sum(F.col("amt") * F.col("copies"))).alias("amt"),
    )


@_on_mart("brand_segments")
def brand_segments(mart: Mart) -> DataFrame:
    """Customers who buy the brand in A only, in B only, or in both with a match."""
    a, of_b = mart.members("a"), _brand_buyers_b(mart)
    of_a = members.active_members(a, _brand_lines_a(mart), "vip_no")
    matched = matching.overlap_keys(of_a, of_b, "vip_no")
    partners = matching.smallest_partners(
        of_b, "vip_main_no", {"any": (a, "vip_no"), "buyer": (of_a, "vip_no")}
    )
    known = partners.filter(F.col("any").isNotNull()).select("vip_main_no")
    segments = {
        "a_only": labels.segment_keys(of_a, matched, "vip_no", inside=False),
        "b_only": labels.segment_keys(of_b, known, "vip_main_no", inside=False),
        "both_a": matched,
        "both_b": partners.filter(F.col("buyer").isNotNull()),
    }
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("segment"), "n")
        for name, df in segments.items()
    ]
    pairs = matching.pair_counts(of_a, of_b, name="n").select(F.lit("pairs").alias("segment"), "n")
    return reduce(DataFrame.unionByName, [*counts, pairs])


@_on_mart("overlap_minus_brand")
def overlap_minus_brand(mart: Mart) -> DataFrame:
    """Matched with a brand buyer of B, but no buyer of the brand in A."""
    matched = matching.overlap_keys(mart.members("a"), _brand_buyers_b(mart), "vip_no")
    return matched.subtract(_brand_lines_a(mart).select("vip_no").distinct())


# --- figures


@_on_mart("kpi_aov")
def kpi_aov(mart: Mart) -> DataFrame:
    a, b = mart.chain("a"), mart.chain("b")
    return _sides(a=kpi.aov(a, "in_b"), b=kpi.aov(b, "in_a"))


@_on_mart("kpi_upt")
def kpi_upt(mart: Mart) -> DataFrame:
    a, b = mart.chain("a"), mart.chain("b")
    return _sides(a=kpi.upt(a, "in_b"), b=kpi.upt(b, "in_a"))


@_on_mart("kpi_price_point")
def kpi_price_point(mart: Mart) -> DataFrame:
    a, b = mart.chain("a"), mart.chain("b")
    return _sides(a=kpi.avg_price_point(a, "in_b"), b=kpi.avg_price_point(b, "in_a"))


@_on_mart("kpi_trans_per_cust")
def kpi_trans_per_cust(mart: Mart) -> DataFrame:
    a, b, n = mart.chain("a"), mart.chain("b"), mart.unique("a", "b")
    return _sides(
        a=kpi.avg_trans_per_cust(a, "in_b", n), b=kpi.avg_trans_per_cust(b, "in_a", n)
    )


@_on_mart("kpi_spend_per_cust")
def kpi_spend_per_cust(mart: Mart) -> DataFrame:
    a, b, n = mart.chain("a"), mart.chain("b"), mart.unique("a", "b")
    return _sides(
        a=kpi.avg_spend_per_cust(a, "in_b", n), b=kpi.avg_spend_per_cust(b, "in_a", n)
    )


@_on_mart("sales_behavior")
def sales_behavior(mart: Mart) -> DataFrame:
    return kpi.sales_behavior(
        mart.chain("a"), mart.chain("b"), "in_a", "in_b", mart.unique("a", "b")
    )


_on_mart("pair_report")(reports.pair_report)
_on_mart("pair_report_grid")(
    lambda mart: reports.as_grid(reports.pair_report(mart), kpi.BEHAVIOR_METRICS)
)
_on_mart("pair_demo_report")(lambda mart: reports.demo_report(mart, AS_OF))
_on_mart("pair_wallet_report")(reports.wallet_report)
_on_mart("pair_price_report")(reports.price_report)


@_on_mart("overlap_penetration")
def overlap_penetration(mart: Mart) -> DataFrame:
    a, b = mart.chain("a"), mart.chain("b")
    return _sides(a=kpi.overlap_penetration(a, "in_b"), b=kpi.overlap_penetration(b, "in_a"))


@_on_mart("tenure_share")
def tenure_share(mart: Mart) -> DataFrame:
    return kpi.demo_table(mart.chain("a"), mart.chain("b"), "in_a", "in_b", AS_OF)


@_on_mart("share_of_wallet")
def share_of_wallet(mart: Mart) -> DataFrame:
    return kpi.share_of_wallet(mart.chain("a"), mart.chain("b"), "in_a", "in_b")


@_on_mart("tier_percent")
def tier_percent(mart: Mart) -> DataFrame:
    return _sides(
        a=kpi.tier_percent(mart.chain("a"), "in_b", TIER_ORDER_A),
        b=kpi.tier_percent(mart.chain("b"), "in_a", TIER_ORDER_B),
    ).orderBy("side", F.asc_nulls_last("display_order"), F.asc_nulls_last("tier"))


@_on_mart("pricepoint_by_cat")
def pricepoint_by_cat(mart: Mart) -> DataFrame:
    return kpi.pricepoint_by_cat(mart.chain("a").overlapping("in_b"))


@_on_mart("pricepoint_table")
def pricepoint_table(mart: Mart) -> DataFrame:
    return kpi.pricepoint_table(mart.chain("a"), mart.chain("b"), "in_a", "in_b")


@_on_mart("top_brand")
def top_brand(mart: Mart) -> DataFrame:
    return profile.top_by(mart.chain("a").overlapping("in_b"), "brand_desc", "vip_no", 10)


@_on_mart("top_brand_segment")
def top_brand_segment(mart: Mart) -> DataFrame:
    fashion = sales.segment(mart.chain("a").overlapping("in_b"), "bu_desc", FASHION_UNITS)
    return profile.top_by(fashion, "brand_desc", "vip_no", 10)


@_on_mart("top_class")
def top_class(mart: Mart) -> DataFrame:
    unit = sales.segment(mart.chain("a").overlapping("in_b"), "bu_desc", ["COS"])
    return profile.top_by(unit, "class_desc", "vip_no")


@_on_mart("top_subclass")
def top_subclass(mart: Mart) -> DataFrame:
    """What else overlapping customers bought in orders with a line of the unit."""
    lines = mart.chain("a").overlapping("in_b").filter(F.col("bu_desc") == "COS")
    lines = lines.filter(~F.lower("class_desc").like("%promo%"))
    raw = mart.roles.sales_a().select(
        "order_no",
        labelled(F.col("class_desc"), F.col("subclass_desc")).alias("class_subclass"),
    )
    return profile.customers_by_order_content(
        lines, raw, "order_no", ["class_subclass"], "vip_no", 10, hot=mart.tables["hot_order"]
    )


@_on_mart("tier_matrix")
def tier_matrix(mart: Mart) -> DataFrame:
    return profile.pair_matrix(
        mart.members("a"), mart.members("b"), "tier", [*BEAUTY_TIERS, OTHER_TIER]
    )


@_on_mart("tenure_matrix")
def tenure_matrix(mart: Mart) -> DataFrame:
    return profile.tenure_matrix(mart.members("a"), mart.members("b"), AS_OF)


@_on_mart("gender_counts")
def gender_counts(mart: Mart) -> DataFrame:
    return _sides(
        a=profile.value_counts(mart.members("a"), "sex"),
        b=profile.value_counts(mart.members("b"), "sex"),
    )


@_on_mart("pair_gender")
def pair_gender(mart: Mart) -> DataFrame:
    return profile.pair_distribution(mart.members("a"), mart.members("b"), "sex")


@_on_mart("pair_nationality")
def pair_nationality(mart: Mart) -> DataFrame:
    return profile.pair_distribution(
        mart.members("a"), mart.members("b"), "nationality", of_b=True
    )


@_on_mart("sow_by_bu")
def sow_by_bu(mart: Mart) -> DataFrame:
    return profile.sow_by(mart.chain("a").overlapping("in_b"), "bu_desc")


@_on_mart("sow_by_category")
def sow_by_category(mart: Mart) -> DataFrame:
    unit = mart.chain("a").overlapping("in_b").filter(F.col("bu_desc") == "COS")
    return profile.sow_by_both(
        profile.sow_by(unit, "arti_cate_name"),
        profile.sow_by(mart.chain("b").overlapping("in_a"), "arti_cate_name"),
        "arti_cate_name",
    )


@_on_mart("spend_by_cat_flag")
def spend_by_cat_flag(mart: Mart) -> DataFrame:
    return profile.spend_by(mart.tables["sales_b"], ["arti_cate_name", "in_a"])


@_on_mart("penetration_by_store")
def penetration_by_store(mart: Mart) -> DataFrame:
    return profile.penetration_by_store(mart.tables["sales_b"], "shop_desc", "in_a")


@_on_mart("brand_products")
def brand_products(mart: Mart) -> DataFrame:
    lines = mart.chain("a").overlapping("in_b").filter(F.col("brand_desc") == BRAND)
    return profile.customers_by(lines, ["prod_desc"], "vip_no")


@_on_mart("brand_cross_shop")
def brand_cross_shop(mart: Mart) -> DataFrame:
    """Overlapping buyers of the brand in A and in B, and the pairs who bought in both."""
    lines_a = mart.chain("a").overlapping("in_b")
    lines_a = lines_a.filter(F.upper("brand_desc") == BRAND_UPPER)
    lines_b = mart.chain("b").overlapping("in_a").filter(F.col("brand_desc") == BRAND_UPPER)
    of_a = members.active_members(mart.members("a"), lines_a, "vip_no")
    of_b = members.active_members(mart.members("b"), lines_b, "vip_main_no")
    pairs = matching.pair_counts(of_a, of_b)
    n_a = lines_a.agg(F.countDistinct("vip_no").alias("n")).scalar()
    n_b = lines_b.agg(F.countDistinct("vip_main_no").alias("n")).scalar()
    return pairs.select(n_a.alias("n_a"), n_b.alias("n_b"), "n_pairs")


@_on_mart("segment_pricepoint")
def segment_pricepoint(mart: Mart) -> DataFrame:
    """Price points by category of three customer segments of a brand."""
    of_b = _brand_buyers_b(mart)
    lines = _brand_lines_a(mart)
    of_a = members.active_members(mart.members("a"), lines, "vip_no")
    pairs = matching.pairs_per_member(of_a, of_b, "vip_no")
    both = labels.label_fanout(
        lines.drop("in_b", "in_c"), "vip_no", pairs, "both", "copies", "inner", mart.tables["hot_a"], LINE_A
    )
    units = sales.segment(mart.tables["sales_a"], "bu_desc", FASHION_UNITS)
    units = _fanned_out_a(mart, units, "inner")

    def weighted(df: DataFrame) -> DataFrame:
        copies = F.col("copies")
        return df.select(
            "arti_cate_name",
            (F.col("amt") * copies).alias("amt"),
            (F.col("qty") * copies).alias("qty"),
        )

    segments = {
        "a_only": _only_a_lines(mart),
        "both": weighted(both),
        "fashion": weighted(units),
    }
    tables = {name: kpi.pricepoint_by_cat(df) for name, df in segments.items()}
    return _sides(**tables).select("side", "category", "price_point").orderBy(
        "side", F.desc("price_point"), "category"
    )


def _only_a_lines(mart: Mart) -> DataFrame:
    """A's lines of the brand by customers without a match among B's buyers of it."""
    lines = _brand_lines_a(mart)
    matched = matching.overlap_keys(mart.members("a"), _brand_buyers_b(mart), "vip_no")
    only = labels.segment_keys(lines, matched, "vip_no", inside=False)
    return spread_join(lines, only, ["vip_no"], "left_semi", mart.tables["hot_a"], LINE_A)


@_on_mart("segment_spend_share")
def segment_spend_share(mart: Mart) -> DataFrame:
    return profile.sow_by(_only_a_lines(mart), "bu_desc")


@_on_mart("segment_subclass")
def segment_subclass(mart: Mart) -> DataFrame:
    raw = mart.roles.sales_a().select("order_no", "subclass_desc")
    return profile.customers_by_order_content(
        _only_a_lines(mart),
        raw,
        "order_no",
        ["subclass_desc"],
        "vip_no",
        13,
        ["class_desc"],
        mart.tables["hot_order"],
    )


@_on_mart("distinct_items")
def distinct_items(mart: Mart) -> DataFrame:
    return profile.distinct_values(
        mart.tables["sales_b"],
        ["item_desc", "arti_cate_name", "maincat_desc"],
        (F.col("prod_brand") == BRAND) & F.col("arti_cate_name").isin("Makeup", "Haircare"),
    )


@_on_mart("brand_list")
def brand_list(mart: Mart) -> DataFrame:
    return profile.sorted_values(mart.tables["sales_cos"], "brand_desc")


# --- stores and lists


@_on_mart("store_lookup")
def store_lookup(mart: Mart) -> DataFrame:
    flagged = mart.chain("a").overlapping("in_c")
    return stores.store_lookup(flagged, mart.roles.stores(), "loc_code")


@_on_mart("customers_by_store")
def customers_by_store(mart: Mart) -> DataFrame:
    flagged = mart.chain("a").overlapping("in_b").drop("store_name")
    named = stores.with_store(
        flagged, mart.roles.stores(), "loc_code", "store_name"
    )
    return profile.customers_by(named, ["loc_code", "store_name"], "vip_no")


@_on_mart("store_in_out")
def store_in_out(mart: Mart) -> DataFrame:
    flagged = mart.chain("c").overlapping("in_b")
    return stores.store_in_out(flagged, "vip_main_no", "shop_code", SHOPS_C)


@_on_mart("store_intersect")
def store_intersect(mart: Mart) -> DataFrame:
    flagged = mart.chain("b").overlapping("in_a")
    return stores.shared_customers(
        flagged.filter(F.col("shop_code").isin(*SHOPS_B)),
        flagged.filter(~F.col("shop_code").isin(*SHOPS_B)),
        "vip_main_no",
    )


@_on_mart("order_line_rejoin")
def order_line_rejoin(mart: Mart) -> DataFrame:
    """Price points of chain C by the subcategories found in the raw transaction."""
    raw = marts.valid_sales_b(mart.roles)
    lines = sales.order_line_rejoin(
        mart.tables["sales_c"],
        raw,
        "sales_main_key",
        "item_subcat_desc",
        hot=mart.tables["hot_key"],
        by=["item_code"],
    )
    copies = F.col("copies")
    weighted = lines.select(
        "item_subcat_desc",
        (F.col("amt") * copies).alias("amt"),
        (F.col("qty") * copies).alias("qty"),
    )
    return kpi.pricepoint_by_cat(weighted, "item_subcat_desc")


@_on_mart("issue_counts")
def issue_counts(mart: Mart) -> DataFrame:
    return stores.issue_counts(
        mart.issue_list(),
        mart.tables["sales_c"],
        "member_no",
        "issue_location",
        "vip_main_no",
        "shop_code",
        SHOPS_C,
        ["in_a", "in_b"],
    )


@_on_mart("issue_intersect")
def issue_intersect(mart: Mart) -> DataFrame:
    """Members who joined in one of the shops and shop both there and elsewhere."""
    joined = mart.issue_list().filter(F.col("issue_location").isin(*SHOPS_C)).select(
        F.col("member_no").alias("vip_main_no")
    )
    lines = mart.tables["sales_b"].select("vip_main_no", "shop_code", *LINE_B)
    lines = spread_join(
        lines, joined.distinct(), ["vip_main_no"], "left_semi", mart.tables["hot_b"], LINE_B
    )
    inside = F.col("shop_code").isin(*SHOPS_B)
    return stores.shared_customers(lines.filter(inside), lines.filter(~inside), "vip_main_no")


@_on_mart("issue_right_join")
def issue_right_join(mart: Mart) -> DataFrame:
    history = mart.tables["history_b"].filter(F.col("carved_out") == 1)
    window = F.col("order_date").between(*[F.lit(d).cast("date") for d in SECOND_YEAR])
    return stores.issue_right_join(
        mart.issue_list(), history, "member_no", "issue_location", "vip_main_no", SHOPS_C, window
    )


@_on_mart("cohort_retention")
def cohort_retention(mart: Mart) -> DataFrame:
    """Buyers of some brands in B and C over two years."""
    bought = sales.scope(
        mart.tables["history_b"], "order_date", FIRST_YEAR[0], SECOND_YEAR[1], "region_key", ["HK"]
    ).filter(F.upper("prod_brand").isin(*COHORT_BRANDS))
    bought = bought.withColumn("second", F.col("order_date") >= F.lit(SECOND_YEAR[0]).cast("date"))

    def buyers(carved_out: int, year: bool) -> DataFrame:
        rows = bought.filter((F.col("carved_out") == carved_out) & (F.col("second") == year))
        return rows.select("vip_main_no")

    return cohort.cohort_retention(
        mart.members("b"),
        mart.members("c"),
        "vip_main_no",
        "vip_main_no",
        buyers(0, False),
        buyers(1, False),
        buyers(0, True),
        buyers(1, True),
    )


@_on_mart("cohort_retention_pivot")
def cohort_retention_pivot(mart: Mart) -> DataFrame:
    return cohort.pivot_retention(cohort_retention(mart))
