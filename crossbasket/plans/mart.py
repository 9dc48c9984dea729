"""The datamart: scoped sales and active members of each chain, labelled with the overlaps.

Three chains take part: A, B, and C, which is carved out of B. Beside A as a whole its
beauty unit (``cos``) and A without one brand (``exc``) are matched too.

The stages are written once and read back: every figure of the reports needs the scoped
lines several times over (whose customers are active, whom they match, what they bought),
and a scan of a fiscal year's lines is far cheaper than a scan of all of them with its joins.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.functions.text import transaction_key, trim_all
from crossbasket.operators.kpi import Chain, order_parts
from crossbasket.operators.labels import label_overlap, label_rows
from crossbasket.operators.matching import smallest_partners
from crossbasket.operators.members import golden_record_a, golden_record_b
from crossbasket.operators.sales import (
    carveout_keys,
    enrich_member,
    enrich_sales_a,
    enrich_sales_b,
    exclude_brand,
    latest_per_key,
    mark_carveout,
    scope,
    valid_transactions,
)
from crossbasket.operators.skew import growing, hot_groups
from crossbasket.session import delete_folder, folder_state, publish_text, read_text, shared_dir
from crossbasket.sources.roles import (
    CARVEOUT_BRAND,
    DUMMY_ITEM,
    HOME_REGION,
    ODD_DATE,
    Roles,
)
from crossbasket.sources.tables import (
    mapping_with_codes,
    read_datamart,
    read_list,
    read_metrics,
    write_datamart,
    write_metrics,
)


@dataclass(frozen=True)
class Scope:
    """What the datamart covers."""

    start: str = "1998-04-01"
    end: str = "1999-03-31"
    regions_a: tuple[str, ...] = ("ASIA", "EUROPE")
    regions_b: tuple[str, ...] = ("HK", "IH")
    carved_brand: str = "Brand#7"  # chain C's brand, not counted as chain A's sales
    left_out_brand: str = "Brand#1"  # what ``exc`` leaves out
    unit: str = "COS"


UNIT_SLICE = "cos"
PAIRS = (("a", "b"), ("a", "c"), ("b", "c"), (UNIT_SLICE, "b"), (UNIT_SLICE, "c"), ("exc", "b"))
REPORT_PAIRS = (("a", "b"), ("a", "c"), ("b", "c"), (UNIT_SLICE, "b"), (UNIT_SLICE, "c"))
LINE_A, LINE_B = ["order_no", "loc_code"], ["invoice_no", "item_code"]  # tell sales lines apart


def scoped_sales_a(roles: Roles, what: Scope) -> DataFrame:
    """Chain A's enriched lines in scope; dates are cut before the joins, regions by them."""
    dated = scope(roles.sales_a(), "order_date", what.start, what.end)
    lines = enrich_sales_a(dated, roles.stores(), roles.mapping_a(), what.unit)
    in_region = lines.filter(F.col("vat_region_name").isin(*what.regions_a))
    return exclude_brand(in_region, "brand_desc", what.carved_brand)


def current_skus(roles: Roles) -> DataFrame:
    return latest_per_key(roles.sku_versions(), "item_code", "last_modified_date")


def enriched_sales_b(roles: Roles, sales: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    return enrich_sales_b(
        sales,
        roles.brands(),
        current_skus(roles),
        roles.member_map(),
        roles.shops(),
        roles.categories(),
        roles.mapping_b(),
        hot=hot,
    )


def _keyed(sales: DataFrame) -> DataFrame:
    return trim_all(sales).withColumn(
        "sales_main_key", transaction_key(F.col("shop_code"), F.col("invoice_no"))
    )


def valid_sales_b(roles: Roles) -> DataFrame:
    """Valid raw lines of chain B, trimmed, with their transaction key."""
    return _keyed(valid_transactions(roles.sales_b()))


def history_b(roles: Roles, keys: DataFrame, hot: dict[str, DataFrame]) -> DataFrame:
    """Who bought which brand when in chain B, over all dates, with the carve-out marked."""
    lines = mark_carveout(valid_sales_b(roles), keys, hot=hot["hot_key"], by=LINE_B)
    lines = enrich_member(lines, roles.member_map(), "vip_no", "vip_main_no", hot["hot_number"], LINE_B)
    return lines.select(
        "sales_main_key", "vip_main_no", "prod_brand", "region_key", "order_date", "carved_out"
    ).distinct()


def keys_of_c(roles: Roles) -> DataFrame:
    """Transaction keys of chain C, over all dates."""
    return carveout_keys(_keyed(roles.sales_b()), CARVEOUT_BRAND, HOME_REGION, ODD_DATE, DUMMY_ITEM)


def mapping_c(roles: Roles) -> DataFrame:
    mapping = mapping_with_codes(roles.subcat_codes(), roles.category_codes(), "arti_cate_code")
    return mapping.select("item_subcat_desc", F.col("arti_cate_name").alias("c_cate_name"))


def scoped_sales_bc(
    roles: Roles, what: Scope, keys: DataFrame, hot: Mapping[str, DataFrame | None]
) -> DataFrame:
    """Lines of B and C in scope; ``carved_out`` tells them apart.

    Chain C's lines have their category from their own mapping, which B's never meet: a line of C
    is there once for each category its subcategory has, however often the mapping says so.
    """
    dated = scope(
        roles.sales_b(), "order_date", what.start, what.end, "region_key", what.regions_b
    )
    lines = enriched_sales_b(roles, dated, hot.get("hot_number"))
    lines = mark_carveout(lines, keys, hot=hot.get("hot_key"), by=LINE_B)
    mapping = mapping_c(roles).distinct().withColumnRenamed("item_subcat_desc", "_subcat")
    lines = lines.withColumn("_subcat", F.when(F.col("carved_out") == 1, F.col("item_subcat_desc")))
    lines = lines.join(mapping, ["_subcat"], "left").drop("_subcat")
    category = F.when(F.col("carved_out") == 1, F.col("c_cate_name"))
    return lines.withColumn(
        "arti_cate_name", category.otherwise(F.col("arti_cate_name"))
    ).drop("c_cate_name")


def golden_a(roles: Roles) -> DataFrame:
    return golden_record_a(roles.members_a())


def golden_b(roles: Roles) -> DataFrame:
    return golden_record_b(roles.members_b(), roles.types(), HOME_REGION)


def _active(members: DataFrame, key: str, buyers: dict[str, DataFrame]) -> DataFrame:
    """Members who bought in any of ``buyers``' lines, with a 0/1 column for each."""
    keys = {label: lines.select(key).dropna().distinct() for label, lines in buyers.items()}
    marked = label_overlap(members, key, keys, dedup_rows=False, unique_key=True)
    return marked.filter(reduce(Column.__or__, [F.col(label) == 1 for label in buyers]))


# The labels of each chain's sales and members: the chains it is matched with.
OTHERS = {"a": ("b", "c"), "cos": ("b", "c"), "b": ("a", "c", "cos"), "c": ("a", "b", "cos")}


def order_bits(chain: str) -> dict[str, int]:
    """The bit of each label in the masks of a chain's orders; those of the unit are in chain A's."""
    first = len(OTHERS["a"]) if chain == UNIT_SLICE else 0
    return {f"in_{other}": first + i for i, other in enumerate(OTHERS[chain])}


def _order_conditions(chain: str, unit: str) -> list[Column]:
    """What the bits say, in their order."""
    labels = [F.col(f"in_{other}") == 1 for other in OTHERS[chain]]
    if chain == "a":
        labels += [(F.col(f"in_{other}") == 1) & (F.col("bu_desc") == unit) for other in OTHERS[UNIT_SLICE]]
    return labels


def key_of(chain: str) -> str:
    return "vip_main_no" if chain in ("b", "c") else "vip_no"


def _members_of(tables: dict[str, DataFrame], kind: str, chain: str) -> DataFrame:
    """A chain's rows of the member table it shares with its parent chain."""
    rows = tables[f"{kind}_b" if chain in ("b", "c") else f"{kind}_a"]
    return rows.filter(F.col(f"active_{chain}") == 1)


def _labelled_members(tables: dict[str, DataFrame], chain: str) -> DataFrame:
    """A chain's active members with a 0/1 column for each chain they are matched in."""
    rows = _members_of(tables, "members", chain)
    plain = [c for c in rows.columns if not c.startswith(("in_", "active_"))]
    labels = [
        F.col(f"in_{other}").isNotNull().cast("int").alias(f"in_{other}")
        for other in OTHERS.get(chain, ())
    ]
    return rows.select(*plain, *labels)


class Mart:
    """A written datamart; the attributes are scans of its tables.

    Tables are read by the schemas in its manifest, so opening one runs no Spark job.
    """

    TABLES = (
        "members_a", "members_b", "sales_a", "sales_b", "sales_c", "orders_a", "orders_b", "orders_c",
        "keys_c", "history_b", "hot_number", "hot_key", "hot_order", "hot_a", "hot_b",
    )

    def __init__(self, spark: SparkSession, root: str, source: str, what: Scope = Scope()):
        self.spark = spark
        self.root = root
        self.source = source
        manifest = read_text(spark, f"{root}/{MANIFEST}")
        if manifest is None:
            raise FileNotFoundError(f"{root} is no finished datamart")
        schemas = {name: T.StructType.fromJson(schema) for name, schema in json.loads(manifest)["schemas"].items()}
        self.tables = read_datamart(spark, root, self.TABLES, schemas)
        self.tables["sales_cos"] = self.tables["sales_a"].filter(F.col("bu_desc") == what.unit)
        self.n_unique = read_metrics(spark, f"{root}/n_unique")

    @property
    def roles(self) -> Roles:
        return Roles(self.spark, self.source)

    def issue_list(self) -> DataFrame:
        return read_list(self.spark, f"{self.root}/issue_list")

    def members(self, chain: str) -> DataFrame:
        """Active members of a chain, with the labels of its sales."""
        return _labelled_members(self.tables, chain)

    def chain(self, name: str) -> Chain:
        return Chain(
            name=name,
            sales=self.tables[f"sales_{name}"],
            members=self.members(name),
            key=key_of(name),
            order="sales_main_key" if name in ("b", "c") else "order_no",
            orders=self.tables["orders_a" if name == UNIT_SLICE else f"orders_{name}"],
            bits=order_bits(name),
        )

    def unique(self, a: str, b: str) -> DataFrame:
        """The stored number of unique customers of a pair, as a single value."""
        return self.n_unique.filter(F.col("pair") == f"{a}_{b}").agg(F.max("n").alias("n"))


def build_mart(spark: SparkSession, roles: Roles, root: str, what: Scope = Scope()) -> Mart:
    """Builds all tables under ``root``; runs Spark jobs.

    What later plans need of the whole history - the carve-out's keys, the hot keys, who bought
    which brand when - is written first, so that no figure scans the raw lines for it again. Chain
    B's raw lines, which six tables start from, are put together once and kept until those are written.
    """
    raw = write_datamart(
        {"raw_b": roles.sales_b(), "hot_order": hot_groups(roles.order_numbers_a(), ["order_no"])}, root
    )
    roles = roles.with_sales_b(raw.pop("raw_b"))
    lines_b = valid_sales_b(roles)
    first = raw | write_datamart(
        {
            "keys_c": keys_of_c(roles),
            "hot_number": hot_groups(lines_b, ["vip_no"]),
            "hot_key": hot_groups(lines_b, ["sales_main_key"]),
        },
        root,
    )
    listed = roles.issue_list(first["hot_number"])
    listed = listed.withColumnsRenamed({"member_no": "Member No", "issue_location": "Issue Location "})
    listed.write.mode("overwrite").csv(f"{root}/issue_list", header=True)
    mapping = roles.mapping_b().withColumnRenamed("bu_desc", "bu_desc ")  # a stray blank
    mapping.write.mode("overwrite").csv(f"{root}/mapping", header=True)
    scoped = write_datamart(
        {
            "scope_a": scoped_sales_a(roles, what),
            "scope_bc": scoped_sales_bc(roles, what, first["keys_c"], first),
            "history_b": history_b(roles, first["keys_c"], first),
        },
        root,
        {"scope_bc": ["carved_out"]},
    )
    delete_folder(spark, f"{root}/raw_b")
    hot = write_datamart(
        {
            "hot_a": hot_groups(scoped["scope_a"], ["vip_no"]),
            "hot_b": hot_groups(scoped["scope_bc"], ["vip_main_no"]),
        },
        root,
    )
    sales = {
        "a": scoped["scope_a"],
        "cos": scoped["scope_a"].filter(F.col("bu_desc") == what.unit),
        "b": scoped["scope_bc"].filter(F.col("carved_out") == 0).drop("carved_out"),
        "c": scoped["scope_bc"].filter(F.col("carved_out") == 1).drop("carved_out"),
    }
    without_brand = exclude_brand(sales["a"], "brand_desc", what.left_out_brand)
    buyers_a = {"active_a": sales["a"], "active_cos": sales["cos"], "active_exc": without_brand}
    buyers_b = {"active_b": sales["b"], "active_c": sales["c"]}
    active = write_datamart(
        {
            "active_a": _active(golden_a(roles), "vip_no", buyers_a),
            "active_b": _active(golden_b(roles), "vip_main_no", buyers_b),
        },
        root,
    )

    def members(chain: str) -> DataFrame:
        return _members_of(active, "active", chain)

    partners_a = smallest_partners(
        active["active_a"],
        "vip_no",
        {"in_b": (members("b"), "vip_main_no"), "in_c": (members("c"), "vip_main_no")},
    )
    partners_b = smallest_partners(
        active["active_b"],
        "vip_main_no",
        {f"in_{chain}": (members(chain), key_of(chain)) for chain in ("a", "cos", "exc", "b", "c")},
    )
    matched = write_datamart(
        {
            "members_a": active["active_a"].join(growing(partners_a), ["vip_no"], "left"),
            "members_b": active["active_b"].join(growing(partners_b), ["vip_main_no"], "left"),
        },
        root,
    )

    def unique(a: str, b: str) -> DataFrame:
        """The distinct smallest A partners of a chain's members."""
        rows = _members_of(matched, "members", b)
        count = rows.agg(F.countDistinct(f"in_{a}").alias("n"))
        return count.select(F.lit(f"{a}_{b}").alias("pair"), "n")

    write_metrics(reduce(DataFrame.unionByName, [unique(a, b) for a, b in PAIRS]), f"{root}/n_unique")

    def marked(chain: str) -> DataFrame:
        """A chain's sales labelled from its members; only matched members need to be met."""
        flags = _labelled_members(matched, chain).select(
            key_of(chain), *[f"in_{other}" for other in OTHERS[chain]]
        )
        any_match = reduce(
            Column.__or__, [F.col(f"in_{other}") == 1 for other in OTHERS[chain]]
        )
        # lines in scope are distinct already
        groups, by = (hot["hot_b"], LINE_B) if chain in ("b", "c") else (hot["hot_a"], LINE_A)
        return label_rows(
            sales[chain], key_of(chain), flags.filter(any_match), dedup_rows=False, hot=groups, by=by
        )

    # the unit's sales have the labels of chain A's
    chains = ("a", "b", "c")
    labelled = write_datamart(
        {f"sales_{chain}": marked(chain) for chain in chains},
        root,
        # the two labels most figures filter on become folders a scan can skip
        {f"sales_{chain}": [f"in_{o}" for o in OTHERS[chain][:2]] for chain in chains},
    )
    orders = {
        f"orders_{chain}": order_parts(
            labelled[f"sales_{chain}"],
            "sales_main_key" if chain in ("b", "c") else "order_no",
            _order_conditions(chain, what.unit),
        )
        for chain in chains
    }
    tables = first | scoped | hot | matched | labelled | write_datamart(orders, root)
    schemas = {name: tables[name].schema.jsonValue() for name in Mart.TABLES}
    publish_text(spark, f"{root}/{MANIFEST}", json.dumps({"schemas": schemas}))
    return Mart(spark, root, roles.folder, what)


# Part of a datamart's name; raise it when its tables or their rules change.
LAYOUT = 3
MANIFEST = "_manifest.json"  # written last within a build
_OPEN: dict[tuple[str, str], Mart] = {}


def _source_version(spark: SparkSession, folder: str) -> str:
    """Changes whenever a file of the source tables does; asks the file system only."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return " ".join(folder_state(spark, f"{folder}/{name}.parquet") for name in names)


def mart_for(spark: SparkSession, folder: str) -> Mart:
    """The datamart over the tables in ``folder``, opened if an application has built it from the same files,
    and built otherwise.

    Each build has a folder of its own; a pointer, named after the source files and put there as a whole when the
    build is finished, tells which one is valid. So a build that was killed is never read, two that run at once
    do not touch each other, and one of them becomes the datamart. An application keeps what it
    opened; opening runs no Spark job.
    """
    name = hashlib.sha256(f"{LAYOUT} {folder} {_source_version(spark, folder)}".encode()).hexdigest()[:16]
    pointer = f"{shared_dir(spark)}/crossbasket/mart-{name}"
    application = (spark.sparkContext.applicationId, pointer)
    if application in _OPEN and read_text(spark, f"{_OPEN[application].root}/{MANIFEST}"):
        return _OPEN[application]
    root = read_text(spark, pointer)
    if root is None or read_text(spark, f"{root}/{MANIFEST}") is None:  # none yet, or cleared meanwhile
        if root is not None:
            delete_folder(spark, pointer)
        own = f"{pointer}-{uuid.uuid4().hex}"
        build_mart(spark, Roles(spark, folder), own)
        root = publish_text(spark, pointer, own)
        if root != own:
            delete_folder(spark, own)
    _OPEN[application] = Mart(spark, root, folder)
    return _OPEN[application]
