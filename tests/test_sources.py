import os
import shutil
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from crossbasket.plans import mart
from crossbasket.plans.mart import Mart, mart_for
from crossbasket.session import publish_text, read_text, shared_dir, stage
from crossbasket.sources import tables
from crossbasket.sources.schemas import ISSUE_LIST, MAINCAT_MAPPING

SMALLEST = "/root/testdata/sf0.001"


def test_mapping_file_with_stray_blanks(spark, tmp_path, rows):
    path = tmp_path / "mapping.csv"
    path.write_text("maincat_desc,arti_cate_name,bu_desc \nSKIN , Skincare,WW\nHAIR,,\n")
    got = tables.read_mapping(spark, str(path), MAINCAT_MAPPING)
    assert got.columns == ["maincat_desc", "arti_cate_name", "bu_desc"]
    assert rows(got) == [("HAIR", None, None), ("SKIN", "Skincare", "WW")]


def test_mapping_goes_by_name_and_sets_broken_rows_apart(spark, tmp_path, rows):
    path = tmp_path / "mapping.csv"
    path.write_text(
        ' bu_desc ,note, arti_cate_code,maincat_desc,arti_cate_name\n'
        'WW, x,7, SKIN ,Skincare\n'
        'WW,,seven,HAIR,Haircare\n'
        'MW,,8\n'
        'MW,"a,b",9,NAIL,"Nails, hands"\n'
        'MW,,9,NAIL,Nails,more\n'
    )
    schema = T.StructType.fromDDL("maincat_desc string, arti_cate_name string, bu_desc string, arti_cate_code int")
    got = tables.read_mapping(spark, str(path), schema)
    assert got.columns == schema.fieldNames()
    assert rows(got) == [("NAIL", "Nails, hands", "MW", 9), ("SKIN", "Skincare", "WW", 7)]
    assert rows(got.select("bu_desc")) == [("MW",), ("WW",)] and got.count() == 2
    bad = tables.malformed_rows(spark, str(path), schema)
    assert rows(bad) == [("MW,,8",), ("MW,,9,NAIL,Nails,more",), ("WW,,seven,HAIR,Haircare",)] and bad.count() == 3
    with pytest.raises(ValueError):
        tables.read_mapping(spark, str(path), T.StructType.fromDDL("maincat_desc string, other string"))


def test_issue_list_file(spark, tmp_path, rows):
    path = tmp_path / "issue.csv"
    path.write_text("Member No,Issue Location,Issue Location Name\n007,S1,Shop one\n")
    assert rows(tables.read_mapping(spark, str(path), ISSUE_LIST)) == [("007", "S1", "Shop one")]
    raw = tables.snake_case(spark.read.csv(str(path), header=True))
    assert raw.columns == ISSUE_LIST.fieldNames()


def test_mapping_with_codes(spark, rows):
    mapping = spark.createDataFrame([("soap", 1), ("pen", 2)], "item string, code int")
    codes = spark.createDataFrame([(1, "Care")], "code int, name string")
    assert rows(tables.mapping_with_codes(mapping, codes, "code")) == [
        (1, "soap", "Care"),
        (2, "pen", None),
    ]


def test_datamart_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "k string, flag int")
    root = str(tmp_path)
    scans = tables.write_datamart({"one": df, "two": df}, root, {"two": ["flag"]})
    assert sorted(os.listdir(tmp_path / "two"))[-2:] == ["flag=0", "flag=1"]
    again = tables.read_datamart(spark, root, ["one", "two"], {"two": df.schema})
    for got in (scans["one"], scans["two"], again["one"], again["two"]):
        assert got.schema == df.schema
        assert rows(got) == rows(df)
    tables.write_datamart({"one": df.limit(1)}, root)
    assert tables.read_datamart(spark, root, ["one"])["one"].count() == 1
    tables.register_views(again)
    assert tables.read_table(spark, "two", ["k"]).columns == ["k"]
    assert tables.read_table(spark, f"{root}/two").count() == 2


def test_metrics_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a_b", 5)], "pair string, n bigint")
    path = str(tmp_path / "n")
    tables.write_metrics(df, path)
    assert rows(tables.read_metrics(spark, path)) == [("a_b", 5)]


def test_staged_scan_prunes(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 2, 0)], "k string, v int, flag int")
    scan = stage(df, f"{shared_dir(spark)}/crossbasket/test/{os.getpid()}", ("flag",))
    plan = scan.filter("flag = 1").select("k")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(flag" in plan
    assert "ReadSchema: struct<k:string>" in plan


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_mart_is_reused_until_its_sources_change(spark, tmp_path):
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        shutil.copyfile(f"{SMALLEST}/{name}.parquet", tmp_path / f"{name}.parquet")
    folder = str(tmp_path)
    first = mart_for(spark, folder)
    assert mart_for(spark, folder).root == first.root
    rebuilt = Mart(spark, first.root, folder)
    assert rebuilt.tables["sales_a"].count() == first.tables["sales_a"].count()
    orders = pq.read_table(tmp_path / "orders.parquet")
    pq.write_table(orders.slice(0, 800), tmp_path / "orders.parquet")
    changed = mart_for(spark, folder)
    assert changed.root != first.root
    assert changed.tables["sales_a"].count() < first.tables["sales_a"].count()


def test_of_several_that_publish_one_file_stays(spark, tmp_path):
    path = f"{tmp_path}/pointer"
    assert read_text(spark, path) is None
    first = publish_text(spark, path, "first \u00e9")
    assert first == read_text(spark, path) == "first \u00e9"
    second = publish_text(spark, path, "second")
    assert second == read_text(spark, path) and second in ("first \u00e9", "second")
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["pointer"]


@pytest.fixture
def own_tables(spark, tmp_path):
    if not os.path.isdir(SMALLEST):
        pytest.skip("no test tables")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        shutil.copyfile(f"{SMALLEST}/{name}.parquet", tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_builds_at_once_leave_one_whole_mart(spark, own_tables, monkeypatch):
    monkeypatch.setattr(mart, "_OPEN", {})
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda _: mart_for(spark, own_tables), range(2)))
    sums = [m.tables["orders_a"].agg({"amt": "sum"}).first()[0] for m in both]
    assert sums[0] == sums[1]
    monkeypatch.setattr(mart, "_OPEN", {})
    assert mart_for(spark, own_tables).root in {m.root for m in both}


def test_a_killed_build_leaves_the_datamart_readable(spark, own_tables, monkeypatch):
    first = mart_for(spark, own_tables)
    rows = first.tables["sales_a"].count()
    orders = pq.read_table(f"{own_tables}/orders.parquet")
    pq.write_table(orders.slice(0, 700), f"{own_tables}/orders.parquet")
    whole = mart.write_metrics

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(mart, "write_metrics", killed)
    with pytest.raises(KeyboardInterrupt):
        mart_for(spark, own_tables)
    assert Mart(spark, first.root, own_tables).tables["sales_a"].count() == rows
    monkeypatch.setattr(mart, "write_metrics", whole)
    again = mart_for(spark, own_tables)
    assert again.root != first.root and again.tables["sales_a"].count() < rows
