"""The registered queries as plain SQL over the base tables.

Written from the definitions, the literal way: matches as one join with a disjunction, labels
as left joins to the pair list, shares as ratios of subqueries. ``SHARED`` states the roles
of the tables and the datamart; each query adds its own SELECT.
"""

from __future__ import annotations

SHARED = r"""
WITH base AS (
  SELECT l.l_orderkey, l.l_suppkey, l.l_partkey, l.l_linenumber, l.l_returnflag,
    l.l_linestatus,
    CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS amt,
    CAST(l.l_quantity AS DECIMAL(18,0)) AS qty,
    o.o_custkey AS ck, CAST(o.o_orderdate AS DATE) AS order_date,
    CASE WHEN p.p_partkey % 29 <> 0 THEN p.p_brand END AS brand, p.p_name, p.p_type, p.p_size,
    split_part(p.p_name, ' ', 2) AS noun
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey),
supp AS (
  SELECT s_suppkey, s_name, n_name, r_name FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw_a AS (
  SELECT CAST(2 + (ck - CASE WHEN ck % 5 = 4 THEN 4 ELSE 0 END) % 3 AS VARCHAR) || '0'
      || CAST(ck - CASE WHEN ck % 5 = 4 THEN 4 ELSE 0 END AS VARCHAR) AS vip_no,
    CAST(l_orderkey AS VARCHAR) AS order_no, order_date,
    strftime(order_date, '%Y%m%d') AS order_ymd,
    CAST(l_suppkey AS VARCHAR) AS loc_code, brand AS brand_desc, p_name AS prod_desc,
    p_type AS category_desc, p_type AS class_desc, noun AS subclass_desc,
    CASE p_size % 5 WHEN 0 THEN 'COS' WHEN 1 THEN 'WW' WHEN 2 THEN 'MW' WHEN 3 THEN 'HL'
      ELSE 'LSA' END AS bu_desc, amt, qty
  FROM base WHERE l_linestatus = 'F'),
stores AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS store_id, r_name AS vat_region_name, s_name AS store_name
  FROM supp),
raw_b AS (
  SELECT 'V' || CAST(ck AS VARCHAR) AS vip_no, CAST(l_suppkey AS VARCHAR) AS shop_code,
    CAST(l_orderkey AS VARCHAR) AS invoice_no,
    CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_orderkey AS VARCHAR) AS sales_main_key,
    order_date,
    CASE r_name WHEN 'ASIA' THEN 'HK' WHEN 'EUROPE' THEN 'IH' ELSE substr(r_name, 1, 2) END
      AS region_key,
    brand AS prod_brand, CAST(l_partkey AS VARCHAR) AS item_code, noun AS item_subcat_desc,
    CASE WHEN n_name IN ('NATION_7', 'NATION_12') THEN 'CV' ELSE 'BX' END AS shop_brand,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(order_date AS VARCHAR) || ' pos' ELSE 'manual' END
      AS invoice_remark,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 0 ELSE 1 END AS valid_tx_flag,
    CASE WHEN l_linenumber = 7 THEN 'V' END AS void_flag, amt, qty
  FROM base JOIN supp ON l_suppkey = s_suppkey WHERE l_linestatus = 'O'),
valid_b AS (SELECT * FROM raw_b WHERE valid_tx_flag = 1 AND void_flag IS NULL),
brands AS (
  SELECT DISTINCT p_brand AS brand_code, upper(p_brand) AS brand_desc FROM part
  WHERE p_brand <> 'Brand#13'),
sku_versions AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_code, p_name AS item_desc,
    CASE WHEN p_partkey % 8 = 4 THEN 'v' ELSE 'v' || CAST(v AS VARCHAR) END AS item_desc_c,
    substr(p_type, 1, 2) AS item_cat, p_brand AS brand_code,
    CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN v = 0 OR p_partkey % 4 = 0
      THEN DATE '1998-01-01' ELSE DATE '1999-01-01' END AS last_modified_date
  FROM part CROSS JOIN (VALUES (0), (1)) AS t(v)),
clean_sku AS (
  SELECT DISTINCT s.* FROM sku_versions s
  JOIN (SELECT item_code, MAX(last_modified_date) AS latest FROM sku_versions GROUP BY item_code) m
    ON s.item_code = m.item_code AND s.last_modified_date = m.latest),
cats AS (SELECT DISTINCT substr(p_type, 1, 2) AS maincat_code, p_type AS maincat_desc FROM part),
map_a AS (
  SELECT * FROM (VALUES ('STANDARD', 'Skincare'), ('SMALL', 'Makeup'), ('MEDIUM', 'Accessories'))
    AS t(category_desc, arti_cate_name)),
map_b AS (
  SELECT * FROM (VALUES ('STANDARD', 'Skincare', 'WW'), ('SMALL', 'Makeup', 'MW'),
    ('LARGE', 'Fragrance', 'WW'), ('PROMO', 'Haircare', 'WW'))
    AS t(maincat_desc, arti_cate_name, bu_desc)),
subcat AS (
  SELECT DISTINCT split_part(p_name, ' ', 2) AS item_subcat_desc,
    length(split_part(p_name, ' ', 2)) AS arti_cate_code FROM part),
subcats AS (
  SELECT * FROM subcat UNION ALL SELECT item_subcat_desc, 15 FROM subcat WHERE arti_cate_code = 5
  UNION ALL SELECT * FROM subcat WHERE arti_cate_code = 4),
map_c AS (
  SELECT item_subcat_desc, arti_cate_code,
    CASE WHEN arti_cate_code <> 6 THEN 'Group ' || CAST(arti_cate_code AS VARCHAR) END
      AS arti_cate_name
  FROM subcats),
member_map AS (
  SELECT 'V' || CAST(c_custkey AS VARCHAR) AS vip_no,
    CASE WHEN c_custkey % 23 = 0 THEN NULL
      WHEN v = 0 THEN 'C' || CAST(c_custkey - CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END AS VARCHAR)
      WHEN c_custkey % 10 = 0 THEN 'D' || CAST(c_custkey AS VARCHAR) END AS vip_main_no
  FROM customer CROSS JOIN (VALUES (0), (1)) AS t(v)),
vip AS (
  SELECT vip_no, MIN(vip_main_no) AS vip_main_no FROM member_map
  WHERE vip_main_no IS NOT NULL GROUP BY vip_no),
first_buy AS (
  SELECT o_custkey, CAST(CAST(MIN(o_orderdate) AS DATE) AS VARCHAR) AS first_buy
  FROM orders GROUP BY o_custkey),
customers AS (
  SELECT c_custkey AS ck, first_buy, n_name AS nation FROM customer
  JOIN nation ON c_nationkey = n_nationkey LEFT JOIN first_buy ON o_custkey = c_custkey),
members_a AS (
  SELECT CAST(2 + (ck - CASE WHEN ck % 5 = 4 THEN 4 ELSE 0 END) % 3 AS VARCHAR) || '0'
      || CAST(ck - CASE WHEN ck % 5 = 4 THEN 4 ELSE 0 END AS VARCHAR) AS vip_no,
    CASE WHEN ck % 11 = 0 THEN '' WHEN ck % 13 = 0 THEN NULL
      WHEN ck % 19 = 0 THEN ' User' || CAST(ck AS VARCHAR) || '@x.com '
      ELSE 'User' || CAST(ck AS VARCHAR) || '@x.com' END AS email,
    CASE WHEN ck % 7 = 0 THEN NULL WHEN ck % 50 = 8 THEN '852-00000000' ELSE
      CASE ck % 4 WHEN 0 THEN '+852' WHEN 1 THEN '852-' WHEN 2 THEN ' ' ELSE '+86' END
      || CAST(50000000 + ck - ck % 3 AS VARCHAR) END AS phone_no,
    CASE ck % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS sex,
    CAST(1950 + ck % 50 AS VARCHAR) || '-01-01' AS birth_date,
    CASE ck % 5 WHEN 0 THEN 'Tracking' WHEN 1 THEN 'Gold' WHEN 2 THEN 'Diamond'
      WHEN 3 THEN 'Platinum' ELSE 'Privilege' END AS card_type,
    CASE ck % 4 WHEN 0 THEN 'COS' WHEN 1 THEN 'HL' WHEN 2 THEN 'WW' END AS join_bu_desc,
    CASE WHEN ck % 17 = 0 THEN '3999-12-31'
      ELSE CAST(1990 + ck % 9 AS VARCHAR) || '-06-15' END AS card_start_date,
    first_buy AS first_transaction_date, nation AS country_of_residence
  FROM customers),
members_b AS (
  SELECT CASE WHEN ck % 23 = 0 THEN 'V' || CAST(ck AS VARCHAR)
      ELSE 'C' || CAST(ck - CASE WHEN ck % 3 = 2 THEN 1 ELSE 0 END AS VARCHAR) END AS vip_main_no,
    CASE WHEN ck % 5 = 0 THEN NULL
      WHEN ck % 4 = 1 THEN 'uSER' || CAST(ck AS VARCHAR) || '@X.com'
      WHEN ck % 4 = 2 THEN 'uSER' || CAST(ck - 1 AS VARCHAR) || '@X.com'
      ELSE 'other' || CAST(ck AS VARCHAR) || '@x.com' END AS vip_email,
    CASE WHEN ck % 10 = 0 THEN '' WHEN ck % 12 = 9 THEN '85200000000'
      WHEN ck % 8 = 1 THEN '852' || CAST(50000000 + ck - ck % 3 AS VARCHAR)
      WHEN ck % 2 = 0 THEN '852' || CAST(50000000 + ck AS VARCHAR)
      ELSE '9' || CAST(50000000 + ck AS VARCHAR) END AS vip_tel_2,
    CASE ck % 2 WHEN 0 THEN 'F' ELSE 'M' END AS vip_sex,
    CAST(ck % 6 AS VARCHAR) AS vip_type,
    CAST(1950 + ck % 50 AS VARCHAR) AS vip_birth_iyy,
    CAST(1 + ck % 12 AS VARCHAR) AS vip_birth_imm,
    CAST(1 + ck % 28 AS VARCHAR) AS vip_birth_idd,
    first_buy AS vip_first_pur_date,
    CASE WHEN ck % 31 <> 0 THEN first_buy END AS vip_issue_date, nation AS region_key
  FROM customers),
types AS (
  SELECT * FROM (VALUES ('0', 'ICARD Gold', 'HK'), ('1', 'ICARD Silver', 'HK'),
    ('2', 'JB1', 'HK'), ('3', 'STAFF', 'HK'), ('4', 'ICARD Diamond', 'HK'),
    ('0', 'OLD', 'TW'), ('5', 'OLD', 'TW')) AS t(viptyp_code, viptyp_desc, region_key)),
phones AS (
  SELECT vip_no AS member, phone_no AS raw FROM members_a
  UNION ALL SELECT vip_main_no, vip_tel_2 FROM members_b),
phones0 AS (
  SELECT DISTINCT raw, CASE WHEN raw IS NULL THEN ''
    ELSE list_extract(string_split(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '-'), -1) END AS p
  FROM phones),
phones1 AS (
  SELECT raw, CASE WHEN starts_with(p, '+852') THEN substr(p, 5) ELSE p END AS p FROM phones0),
phones2 AS (
  SELECT raw, CASE WHEN starts_with(p, '+86') THEN substr(p, 4) ELSE p END AS p FROM phones1),
phones3 AS (
  SELECT raw, CASE WHEN starts_with(p, '852') THEN substr(p, 4) ELSE p END AS p FROM phones2),
cleansed AS (
  SELECT raw, CASE WHEN starts_with(p, '86') THEN substr(p, 3) ELSE p END AS p FROM phones3),
tiers_a AS (
  SELECT *, CASE WHEN card_type = 'Tracking' THEN
      CASE WHEN substr(vip_no, 1, 1) = '2' THEN 'Beauty+'
        WHEN substr(vip_no, 1, 1) = '3' AND join_bu_desc = 'COS' THEN 'Beauty+'
        ELSE 'Privilege' END ELSE card_type END AS tier
  FROM members_a),
max_a AS (
  SELECT vip_no, MAX(trim(phone_no)) AS phone, LOWER(MAX(trim(email))) AS email, MAX(sex) AS sex,
    MAX(birth_date) AS birth_date,
    MAX(CASE WHEN card_start_date = '3999-12-31' THEN '1999-12-31' ELSE card_start_date END)
      AS card_start_date,
    MAX(join_bu_desc) AS join_bu_desc, CAST(MAX(first_transaction_date) AS DATE) AS first_purchase,
    MAX(tier) AS tier, MAX(country_of_residence) AS nationality
  FROM tiers_a GROUP BY vip_no),
golden_a AS (
  SELECT m.* EXCLUDE (phone), c.p AS mobile FROM max_a m
  JOIN (SELECT DISTINCT trim(raw) AS raw, p FROM cleansed) c
    ON m.phone IS NOT DISTINCT FROM c.raw),
typed_b AS (
  SELECT DISTINCT m.* EXCLUDE (vip_type), CASE WHEN t.viptyp_desc IN ('JB1', 'JB ESTEEME',
      'JB ESSENTIAL', 'ICARD Pre-member', 'ICARD Silver', 'ICARD Gold', 'ICARD Diamond',
      'ICARD Diamond - Taiwan') THEN t.viptyp_desc ELSE 'OTHERS' END AS tier
  FROM members_b m LEFT JOIN types t ON m.vip_type = t.viptyp_code WHERE t.region_key = 'HK'),
max_b AS (
  SELECT vip_main_no, MAX(vip_tel_2) AS phone, LOWER(MAX(vip_email)) AS email,
    MAX(vip_birth_iyy) AS birth_year, MAX(vip_birth_imm) AS birth_month,
    MAX(vip_birth_idd) AS birth_day, MAX(vip_sex) AS sex,
    CAST(MAX(vip_first_pur_date) AS DATE) AS first_purchase,
    CAST(MAX(vip_issue_date) AS DATE) AS issue_date, MIN(tier) AS tier,
    MAX(region_key) AS nationality
  FROM typed_b GROUP BY vip_main_no),
golden_b AS (
  SELECT m.* EXCLUDE (phone), c.p AS mobile FROM max_b m
  JOIN cleansed c ON m.phone IS NOT DISTINCT FROM c.raw),
enriched_a AS (
  SELECT DISTINCT a.*, s.vat_region_name, s.store_name,
    CASE WHEN a.bu_desc = 'COS' THEN COALESCE(m.arti_cate_name, 'others') ELSE a.bu_desc END
      AS arti_cate_name
  FROM raw_a a LEFT JOIN stores s ON a.loc_code = s.store_id
  LEFT JOIN map_a m ON a.category_desc = m.category_desc),
scope_a AS (
  SELECT * FROM enriched_a
  WHERE order_date BETWEEN DATE '1998-04-01' AND DATE '1999-03-31'
    AND vat_region_name IN ('ASIA', 'EUROPE') AND brand_desc NOT LIKE '%Brand#7%'),
scope_cos AS (SELECT * FROM scope_a WHERE bu_desc = 'COS'),
scope_exc AS (SELECT * FROM scope_a WHERE brand_desc NOT LIKE '%Brand#1%'),
enriched_b AS (
  SELECT DISTINCT a.*, b.brand_desc, k.item_desc, k.item_desc_c, k.item_cat,
    COALESCE(v.vip_main_no, a.vip_no) AS vip_main_no, s.s_name AS shop_desc, c.maincat_desc,
    COALESCE(m.arti_cate_name, 'others') AS arti_cate_name, m.bu_desc
  FROM valid_b a LEFT JOIN brands b ON a.prod_brand = b.brand_code
  LEFT JOIN clean_sku k ON a.item_code = k.item_code AND a.prod_brand = b.brand_code
  LEFT JOIN vip v ON a.vip_no = v.vip_no
  LEFT JOIN supplier s ON a.shop_code = CAST(s.s_suppkey AS VARCHAR)
  LEFT JOIN cats c ON k.item_cat = c.maincat_code
  LEFT JOIN map_b m ON c.maincat_desc = m.maincat_desc),
c_keys AS (
  SELECT DISTINCT sales_main_key FROM valid_b
  WHERE shop_brand = 'CV' AND region_key = 'HK' AND item_code <> '7'
    AND order_date <> DATE '1998-05-01'
  UNION
  SELECT DISTINCT sales_main_key FROM valid_b
  WHERE shop_brand = 'CV' AND region_key = 'HK' AND item_code <> '7'
    AND order_date = DATE '1998-05-01' AND invoice_remark LIKE '1998-05-01%'),
scope_bc AS (
  SELECT * FROM enriched_b
  WHERE order_date BETWEEN DATE '1998-04-01' AND DATE '1999-03-31' AND region_key IN ('HK', 'IH')),
scope_b AS (SELECT * FROM scope_bc WHERE sales_main_key NOT IN (SELECT sales_main_key FROM c_keys)),
scope_c AS (
  SELECT x.* EXCLUDE (arti_cate_name), m.arti_cate_name
  FROM scope_bc x LEFT JOIN map_c m ON x.item_subcat_desc = m.item_subcat_desc
  JOIN c_keys k ON x.sales_main_key = k.sales_main_key),
act_a AS (SELECT * FROM golden_a WHERE vip_no IN (SELECT vip_no FROM scope_a)),
act_cos AS (SELECT * FROM golden_a WHERE vip_no IN (SELECT vip_no FROM scope_cos)),
act_exc AS (SELECT * FROM golden_a WHERE vip_no IN (SELECT vip_no FROM scope_exc)),
act_b AS (SELECT * FROM golden_b WHERE vip_main_no IN (SELECT vip_main_no FROM scope_b)),
act_c AS (SELECT * FROM golden_b WHERE vip_main_no IN (SELECT vip_main_no FROM scope_c)),
"""


def _pair(name: str, a: str, b: str, a_key: str, b_key: str) -> str:
    return f"""
{name} AS (
  SELECT DISTINCT a.{a_key} AS ak, b.{b_key} AS bk, a.email AS a_email, b.email AS b_email,
    a.mobile AS a_mobile, b.mobile AS b_mobile
  FROM {a} a JOIN {b} b
  ON (a.email <> '' AND a.email IS NOT NULL AND a.email = b.email)
  OR (a.mobile <> '' AND a.mobile IS NOT NULL AND a.mobile = b.mobile))"""


def _labelled(name: str, rows: str, key: str, labels: dict[str, tuple[str, str]]) -> str:
    columns = [
        f"CASE WHEN {label}.k IS NOT NULL THEN 1 ELSE 0 END AS {label}" for label in labels
    ]
    joins = [
        f"LEFT JOIN (SELECT DISTINCT {side} AS k FROM {pairs}) {label} ON x.{key} = {label}.k"
        for label, (pairs, side) in labels.items()
    ]
    return f"""
{name} AS (SELECT DISTINCT x.*, {", ".join(columns)} FROM {rows} x {" ".join(joins)})"""


_PAIRS = {
    "a_b": ("act_a", "act_b", "vip_no"),
    "a_c": ("act_a", "act_c", "vip_no"),
    "b_c": ("act_b", "act_c", "vip_main_no"),
    "cos_b": ("act_cos", "act_b", "vip_no"),
    "cos_c": ("act_cos", "act_c", "vip_no"),
    "exc_b": ("act_exc", "act_b", "vip_no"),
}
_LABELS = {
    "a": ("vip_no", {"in_b": ("pair_a_b", "ak"), "in_c": ("pair_a_c", "ak")}),
    "cos": ("vip_no", {"in_b": ("pair_cos_b", "ak"), "in_c": ("pair_cos_c", "ak")}),
    "b": (
        "vip_main_no",
        {"in_a": ("pair_a_b", "bk"), "in_c": ("pair_b_c", "ak"), "in_cos": ("pair_cos_b", "bk")},
    ),
    "c": (
        "vip_main_no",
        {"in_a": ("pair_a_c", "bk"), "in_b": ("pair_b_c", "bk"), "in_cos": ("pair_cos_c", "bk")},
    ),
}
_UNIQUE = " UNION ALL ".join(
    f"SELECT '{name}' AS pair, COUNT(DISTINCT m) AS n"
    f" FROM (SELECT bk, MIN(ak) AS m FROM pair_{name} GROUP BY bk)"
    for name in _PAIRS
)

PREFIX = (
    SHARED
    + ",".join(
        [_pair(f"pair_{n}", a, b, k, "vip_main_no") for n, (a, b, k) in _PAIRS.items()]
        + [_labelled(f"sales_{c}", f"scope_{c}", k, ls) for c, (k, ls) in _LABELS.items()]
        + [_labelled(f"mem_{c}", f"act_{c}", k, ls) for c, (k, ls) in _LABELS.items()]
    )
    + f",\nuniq AS ({_UNIQUE}),"
    + r"""
brand_b AS (
  SELECT * FROM act_b WHERE vip_main_no IN
    (SELECT vip_main_no FROM scope_b WHERE prod_brand = 'Brand#2')),
lines_brand_a AS (SELECT * FROM scope_a WHERE brand_desc LIKE '%Brand#2%'),
pair_brand AS (SELECT * FROM pair_a_b WHERE bk IN (SELECT vip_main_no FROM brand_b)),
brand_both AS (
  SELECT DISTINCT p.ak, p.bk FROM pair_brand p
  JOIN lines_brand_a a ON a.vip_no = p.ak JOIN brand_b b ON b.vip_main_no = p.bk),
issue AS (
  SELECT COALESCE(v.vip_main_no, r.vip_no) AS member_no, MIN(shop_code) AS issue_location
  FROM raw_b r LEFT JOIN vip v ON r.vip_no = v.vip_no WHERE shop_brand = 'CV' GROUP BY 1)
"""
)

_LINES = "COUNT(*) AS n_lines, round(CAST(SUM(amt) AS DOUBLE), 4) AS amt"


def _ratio(part: str, whole: str, digits: int = 4) -> str:
    return (
        f"round(CASE WHEN {whole} <> 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) END,"
        f" {digits})"
    )


def _percent(part: str, whole: str) -> str:
    return (
        f"round(CASE WHEN {whole} <> 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE)"
        " * 100 END, 2)"
    )


def _flagged(side: str) -> tuple[str, str]:
    """Lines of a chain's customers overlapping in the pair (A, B), and its order column."""
    return {
        "a": ("(SELECT * FROM sales_a WHERE in_b = 1)", "order_no"),
        "b": ("(SELECT * FROM sales_b WHERE in_a = 1)", "sales_main_key"),
    }[side]


def _both_sides(select: str) -> str:
    """``select`` with {rows} and {order} filled in for A and for B."""
    parts = []
    for side in ("a", "b"):
        rows, order = _flagged(side)
        parts.append(select.format(side=side, rows=rows, order=order))
    return " UNION ALL ".join(parts)


def _behavior(a: str, b: str) -> str:
    metrics = {
        "n_customers": "CAST(u AS DOUBLE)",
        "aov": _ratio("amt", "orders"),
        "upt": _ratio("qty", "orders"),
        "avg_trans_per_cust": _ratio("orders", "u"),
        "avg_spend_per_cust": _ratio("amt", "u"),
        "avg_price_point": _ratio("amt", "qty"),
    }
    sides = []
    for side, other in ((a, b), (b, a)):
        order = "sales_main_key" if side in ("b", "c") else "order_no"
        totals = (
            f"(SELECT SUM(amt) AS amt, SUM(qty) AS qty, COUNT(DISTINCT {order}) AS orders,"
            f" (SELECT n FROM uniq WHERE pair = '{a}_{b}') AS u"
            f" FROM sales_{side} WHERE in_{other} = 1)"
        )
        sides += [
            f"SELECT '{a}_{b}' AS pair, '{side}' AS side, '{name}' AS metric, {value} AS value"
            f" FROM {totals}"
            for name, value in metrics.items()
        ]
    return " UNION ALL ".join(sides)


def _tenure(date: str, as_of: str) -> str:
    return f"CAST(floor(date_diff('day', {date}, DATE '{as_of}') / 365) AS BIGINT)"


def _demo_side(side: str, key: str, other: str) -> str:
    tenure = "floor(date_diff('day', first_purchase, DATE '2001-12-31') / 365)"
    groups = {
        "tenure1-2": "t <= 2",
        "tenure3-4": "t BETWEEN 3 AND 4",
        "tenure5-6": "t BETWEEN 5 AND 6",
        "tenure7-8": "t BETWEEN 7 AND 8",
        "tenure>8": "t > 8",
    }
    share = _percent(
        f"(SELECT COUNT(*) FROM (SELECT DISTINCT {key} FROM sales_{side} WHERE in_{other} = 1))",
        f"(SELECT COUNT(*) FROM (SELECT DISTINCT {key} FROM sales_{side}))",
    )
    parts = [f"SELECT '{side}' AS side, 'overlap_customers' AS metric, {share} AS pct"]
    rows = f"(SELECT {key}, {tenure} AS t FROM mem_{side} WHERE in_{other} = 1)"
    for name, condition in groups.items():
        pct = _percent(
            f"COUNT(DISTINCT CASE WHEN {condition} THEN {key} END)", f"COUNT(DISTINCT {key})"
        )
        parts.append(f"SELECT '{side}', '{name}', {pct} FROM {rows}")
    return " UNION ALL ".join(parts)


_KEYS = {"a": "vip_no", "cos": "vip_no", "b": "vip_main_no", "c": "vip_main_no"}
_REPORT_PAIRS = (("a", "b"), ("a", "c"), ("b", "c"), ("cos", "b"), ("cos", "c"))


def _wallet(a: str, b: str) -> str:
    one = f"SELECT SUM(amt) FROM sales_{a} WHERE in_{b} = 1"
    other = f"SELECT SUM(amt) FROM sales_{b} WHERE in_{a} = 1"
    return f"""
SELECT side, round(CAST(amt AS DOUBLE), 4) AS sales, {_percent("amt", "total")} AS share_pct
FROM (SELECT '{a}' AS side, ({one}) AS amt, ({one}) + ({other}) AS total
  UNION ALL SELECT '{b}', ({other}), ({one}) + ({other}))"""


def _price_table(a: str, b: str) -> str:
    def side(chain: str, other: str) -> str:
        price = _ratio("SUM(amt)", "SUM(qty)", 2)
        return (
            f"(SELECT arti_cate_name AS c, {price} AS {chain}_price_point"
            f" FROM sales_{chain} WHERE in_{other} = 1 GROUP BY 1)"
        )

    return (
        f"SELECT COALESCE(x.c, y.c) AS category, {a}_price_point, {b}_price_point"
        f" FROM {side(a, b)} x FULL JOIN {side(b, a)} y ON x.c = y.c"
    )


def _top(dim: str, rows: str, key: str, n: int | None) -> str:
    total = f"(SELECT COUNT(DISTINCT {key}) FROM {rows})"
    limit = "" if n is None else f" LIMIT {n}"
    return (
        f"SELECT {dim}, COUNT(DISTINCT {key}) AS count_customer,"
        f" {_percent(f'COUNT(DISTINCT {key})', total)} AS percentage"
        f" FROM {rows} GROUP BY {dim}"
        f" ORDER BY count_customer DESC, {dim} ASC NULLS LAST{limit}"
    )


def _sow(dim: str, rows: str) -> str:
    return (
        f"SELECT {dim}, round(CAST(SUM(amt) AS DOUBLE), 4) AS amt,"
        f" {_ratio('SUM(amt)', f'(SELECT SUM(amt) FROM {rows})', 6)} AS pct"
        f" FROM {rows} GROUP BY {dim}"
    )


def _matrix(attr: str, a: str, b: str, columns: tuple[str, ...]) -> str:
    """Shares of the pairs; ``a`` and ``b`` are members with a column ``attr``."""
    cells = ", ".join(f"MAX(CASE WHEN y = '{c}' THEN pct END) AS \"{c}\"" for c in columns)
    joined = (
        f"(SELECT a.{attr} AS x, b.{attr} AS y FROM pair_a_b p"
        f" JOIN {a} a ON a.vip_no = p.ak JOIN {b} b ON b.vip_main_no = p.bk)"
    )
    return (
        f"SELECT x AS a_{attr}, {cells} FROM (SELECT x, y,"
        f" {_ratio('COUNT(*)', f'(SELECT COUNT(*) FROM {joined})', 6)} AS pct"
        f" FROM {joined} GROUP BY x, y) GROUP BY x"
    )


_TIERS = (
    "JB1",
    "JB ESTEEME",
    "JB ESSENTIAL",
    "ICARD Pre-member",
    "ICARD Silver",
    "ICARD Gold",
    "ICARD Diamond",
    "ICARD Diamond - Taiwan",
    "OTHERS",
)
_TENURES = ("tenure1-2", "tenure3-4", "tenure5-6", "tenure7-8", "tenure>8")


def _group(years: str, low: int, rest: str = "'tenure>8'") -> str:
    return (
        f"CASE WHEN {years} BETWEEN {low} AND 2 THEN 'tenure{low}-2'"
        f" WHEN {years} BETWEEN 3 AND 4 THEN 'tenure3-4'"
        f" WHEN {years} BETWEEN 5 AND 6 THEN 'tenure5-6'"
        f" WHEN {years} BETWEEN 7 AND 8 THEN 'tenure7-8' ELSE {rest} END"
    )


def _with_tenure(rows: str) -> str:
    years = "floor(date_diff('day', first_purchase, DATE '2001-12-31') / 365)"
    return f"(SELECT *, {_group(years, 1)} AS tenure FROM {rows})"


def _pair_share(attr: str, side: str) -> str:
    joined = (
        f"(SELECT {side}.{attr} AS v FROM pair_a_b p JOIN act_a a ON a.vip_no = p.ak"
        " JOIN act_b b ON b.vip_main_no = p.bk)"
    )
    return (
        f"SELECT v AS {attr}, COUNT(*) AS n_pairs,"
        f" {_ratio('COUNT(*)', f'(SELECT COUNT(*) FROM {joined})', 6)} AS pct"
        f" FROM {joined} GROUP BY v"
    )


def _tier_rank(order: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN '{tier}' THEN {i}" for i, tier in enumerate(order, 1))
    return f"CASE tier {cases} END"


def _tier_side(side: str, key: str, other: str, order: tuple[str, ...]) -> str:
    rows = f"(SELECT * FROM mem_{side} WHERE in_{other} = 1)"
    total = f"(SELECT COUNT(DISTINCT {key}) FROM {rows})"
    return (
        f"SELECT '{side}' AS side, tier, COUNT(DISTINCT {key}) AS n_members,"
        f" {_ratio(f'COUNT(DISTINCT {key})', total, 6)} AS share,"
        f" {_tier_rank(order)} AS display_order FROM {rows} GROUP BY tier"
    )


_SHOPS_C = "('6', '22', '49', '50', '84', '94', '118', '132', '161', '169', '210')"
_SHOPS_B = "('7', '9', '14', '18', '27')"
_FASHION = "('WW', 'MW', 'LSA', 'MSA')"
_FAN_A = (
    "(SELECT s.*, CASE WHEN p.bk IS NOT NULL THEN 1 ELSE 0 END AS in_b"
    " FROM scope_a s LEFT JOIN pair_brand p ON s.vip_no = p.ak)"
)


def _prices(side: str, rows: str) -> str:
    return (
        f"SELECT '{side}' AS side, arti_cate_name AS category,"
        f" {_ratio('SUM(amt)', 'SUM(qty)')} AS price_point FROM {rows} GROUP BY arti_cate_name"
    )


def _issue_case(name: str, location: str, shop: str) -> str:
    return (
        f"SELECT '{name}' AS \"case\", COUNT(DISTINCT vip_main_no) AS n_members"
        " FROM sales_c s RIGHT JOIN issue i ON s.vip_main_no = i.member_no"
        f" AND {location} AND {shop}"
    )


def _issue_both(name: str, location: str) -> str:
    def half(shop: str) -> str:
        return (
            "SELECT DISTINCT vip_main_no FROM sales_c s JOIN issue i"
            f" ON s.vip_main_no = i.member_no AND {location} AND {shop}"
        )

    inside, outside = f"shop_code IN {_SHOPS_C}", f"shop_code NOT IN {_SHOPS_C}"
    return (
        f"SELECT '{name}', COUNT(*) FROM ({half(outside)} INTERSECT {half(inside)})"
    )


_JOINED_IN = f"issue_location IN {_SHOPS_C}"
_JOINED_OUT = f"issue_location NOT IN {_SHOPS_C}"
_SHOP_IN = f"shop_code IN {_SHOPS_C}"
_SHOP_OUT = f"shop_code NOT IN {_SHOPS_C}"

_HISTORY_C = (
    "(SELECT r.*, COALESCE(v.vip_main_no, r.vip_no) AS vip_main_no FROM valid_b r"
    " JOIN c_keys k ON r.sales_main_key = k.sales_main_key LEFT JOIN vip v ON r.vip_no = v.vip_no)"
)

_BRAND_INFO = (
    "COUNT(DISTINCT COALESCE(v.vip_main_no, r.vip_no)) AS n_member,"
    " COUNT(DISTINCT sales_main_key) AS n_trans, MIN(order_date) AS min_date,"
    " MAX(order_date) AS max_date FROM valid_b r LEFT JOIN vip v ON r.vip_no = v.vip_no"
    " WHERE sales_main_key NOT IN (SELECT sales_main_key FROM c_keys) AND region_key = 'HK'"
    " AND prod_brand IN ('Brand#2', 'Brand#3')"
)


def _buyers(name: str, carved: bool, first: str, last: str) -> str:
    inside = "IN" if carved else "NOT IN"
    return (
        f"{name} AS (SELECT DISTINCT COALESCE(v.vip_main_no, r.vip_no) AS k FROM valid_b r"
        " LEFT JOIN vip v ON r.vip_no = v.vip_no WHERE region_key = 'HK'"
        " AND upper(prod_brand) IN ('BRAND#1', 'BRAND#2', 'BRAND#3', 'BRAND#4', 'BRAND#5')"
        f" AND order_date BETWEEN DATE '{first}' AND DATE '{last}'"
        f" AND sales_main_key {inside} (SELECT sales_main_key FROM c_keys))"
    )


_COHORT = (
    ", "
    + ", ".join(
        [
            _buyers("b1", False, "1997-04-01", "1998-03-31"),
            _buyers("c1", True, "1997-04-01", "1998-03-31"),
            _buyers("b2", False, "1998-04-01", "1999-03-31"),
            _buyers("c2", True, "1998-04-01", "1999-03-31"),
        ]
    )
    + """
SELECT label_first, label_second, COUNT(*) AS n FROM (
  SELECT DISTINCT b1.k AS bk, c1.k AS ck,
    CASE WHEN b1.k IS NOT NULL AND c1.k IS NOT NULL THEN 'both' WHEN b1.k IS NOT NULL THEN 'a_only'
      WHEN c1.k IS NOT NULL THEN 'b_only' ELSE 'inactive' END AS label_first,
    CASE WHEN b2.k IS NOT NULL AND c2.k IS NOT NULL THEN 'both' WHEN b2.k IS NOT NULL THEN 'a_only'
      WHEN c2.k IS NOT NULL THEN 'b_only' ELSE 'inactive' END AS label_second
  FROM pair_b_c p FULL OUTER JOIN b1 ON p.ak = b1.k FULL OUTER JOIN c1 ON p.bk = c1.k
  LEFT JOIN b2 ON b1.k = b2.k LEFT JOIN c2 ON c1.k = c2.k
  WHERE b1.k IS NOT NULL OR c1.k IS NOT NULL)
GROUP BY label_first, label_second"""
)

_SELECTS: dict[str, str] = {
    "mapping_lookup": f"""
SELECT COALESCE(m.arti_cate_name, 'others') AS arti_cate_name, m.bu_desc AS mapped_unit, {_LINES}
FROM raw_a a LEFT JOIN map_b m ON a.category_desc = m.maincat_desc GROUP BY 1, 2""",
    "category_mapping_dim": "SELECT CAST(arti_cate_code AS INTEGER) AS arti_cate_code, item_subcat_desc, arti_cate_name FROM map_c",
    "datamart_roundtrip": " UNION ALL ".join(
        f"SELECT '{c}' AS chain, {_LINES} FROM sales_{c}" for c in ("a", "cos", "b", "c")
    ),
    "trim_all": """
SELECT vip_no, trim(email) AS email, trim(phone_no) AS phone_no, card_start_date FROM members_a""",
    "cleanse_phone": """
SELECT p.member, p.raw, c.p AS cleaned FROM phones p
JOIN cleansed c ON p.raw IS NOT DISTINCT FROM c.raw""",
    "update_tier": "SELECT vip_no, join_bu_desc, card_type, tier FROM tiers_a",
    "order_date_format": f"""
SELECT CAST(strptime(order_ymd, '%Y%m%d') AS DATE) AS order_date, {_LINES} FROM raw_a GROUP BY 1""",
    "card_date_sentinel": """
SELECT vip_no, card_start_date, CASE WHEN card_start_date = '3999-12-31' THEN '1999-12-31'
  ELSE card_start_date END AS updated FROM members_a""",
    "tier_whitelist": """
SELECT m.vip_type,
  CASE WHEN viptyp_desc IN ('JB1', 'JB ESTEEME', 'JB ESSENTIAL', 'ICARD Pre-member',
    'ICARD Silver', 'ICARD Gold', 'ICARD Diamond', 'ICARD Diamond - Taiwan') THEN viptyp_desc
    ELSE 'OTHERS' END AS beauty_tier,
  CASE WHEN viptyp_desc IN ('ICARD Pre-member', 'ICARD Silver', 'ICARD Gold', 'ICARD Diamond',
    'ICARD Diamond - Taiwan') THEN viptyp_desc ELSE 'OTHERS' END AS fashion_tier,
  COUNT(*) AS n_members
FROM members_b m LEFT JOIN types t ON m.vip_type = t.viptyp_code GROUP BY 1, 2, 3""",
    "category_default": f"""
SELECT COALESCE(m.arti_cate_name, 'others') AS category,
  CASE WHEN bu_desc = 'COS' THEN COALESCE(m.arti_cate_name, 'others') ELSE bu_desc END
    AS unit_category, {_LINES}
FROM raw_a a LEFT JOIN map_a m ON a.category_desc = m.category_desc GROUP BY 1, 2""",
    "member_key_resolve": f"""
SELECT r.vip_no, COALESCE(v.vip_main_no, r.vip_no) AS vip_main_no, {_LINES}
FROM raw_b r LEFT JOIN vip v ON r.vip_no = v.vip_no GROUP BY 1, 2""",
    "tenure_years": f"""
SELECT vip_main_no, CAST(vip_first_pur_date AS DATE) AS since,
  {_tenure("CAST(vip_first_pur_date AS DATE)", "2001-12-31")} AS years,
  {_tenure("CAST(vip_first_pur_date AS DATE)", "1998-06-30")} AS years_early
FROM members_b""",
    "tenure_group": f"""
SELECT years, {_group("years", 1)} AS from_1, {_group("years", 0)} AS from_0,
  {_group("years", 0, "CASE WHEN years > 8 THEN 'tenure>8' ELSE 'unknown' END")} AS strict,
  COUNT(*) AS n_members
FROM (SELECT {_tenure("CAST(vip_first_pur_date AS DATE)", "1998-06-30")} AS years FROM members_b)
GROUP BY 1, 2, 3, 4""",
    "valid_transactions": f"SELECT shop_code, {_LINES} FROM valid_b GROUP BY shop_code",
    "exclude_brand": f"""
SELECT brand_desc, {_LINES} FROM raw_a
WHERE brand_desc NOT LIKE '%Brand#7%' AND brand_desc NOT LIKE '%Brand#1%' GROUP BY brand_desc""",
    "segment_in_out": f"""
SELECT 'inside' AS side, bu_desc, {_LINES} FROM raw_a WHERE bu_desc IN {_FASHION} GROUP BY bu_desc
UNION ALL
SELECT 'outside', bu_desc, {_LINES} FROM raw_a WHERE bu_desc NOT IN {_FASHION} GROUP BY bu_desc""",
    "sales_scope": f"""
SELECT 'a' AS side, vat_region_name AS region, {_LINES}, MIN(order_date) AS first_date,
  MAX(order_date) AS last_date
FROM raw_a JOIN stores ON loc_code = store_id
WHERE order_date BETWEEN DATE '1998-04-01' AND DATE '1999-03-31'
  AND vat_region_name IN ('ASIA', 'EUROPE') GROUP BY vat_region_name
UNION ALL
SELECT 'b', region_key, {_LINES}, MIN(order_date), MAX(order_date) FROM valid_b
WHERE order_date BETWEEN DATE '1998-04-01' AND DATE '1999-03-31'
  AND region_key IN ('HK', 'IH') GROUP BY region_key""",
    "golden_record_a": "SELECT * FROM golden_a",
    "golden_record_b": "SELECT * FROM golden_b",
    "member_type_join": """
SELECT vip_main_no, vip_sex, region_key, tier AS viptyp_desc_cleaned FROM (
  SELECT DISTINCT m.* EXCLUDE (vip_type), CASE WHEN t.viptyp_desc IN ('ICARD Pre-member',
    'ICARD Silver', 'ICARD Gold', 'ICARD Diamond', 'ICARD Diamond - Taiwan') THEN t.viptyp_desc
    ELSE 'OTHERS' END AS tier
  FROM members_b m LEFT JOIN types t ON m.vip_type = t.viptyp_code WHERE t.region_key = 'HK')""",
    "member_attribute_fetch": """
SELECT a.vip_main_no, a.vip_type, a.vip_sex, a.region_key, b.vip_birth_iyy, COUNT(*) AS copies
FROM members_b a LEFT JOIN types t ON a.vip_type = t.viptyp_code
LEFT JOIN members_b b ON a.vip_main_no = b.vip_main_no
WHERE t.region_key = 'HK' GROUP BY ALL""",
    "active_members": """
SELECT DISTINCT g.* EXCLUDE (email, mobile) FROM golden_a g JOIN scope_a s USING (vip_no)""",
    "enrich_sales": f"""
SELECT brand_desc, maincat_desc, arti_cate_name, bu_desc, COUNT(*) AS n_lines,
  COUNT(DISTINCT vip_main_no) AS n_members, round(CAST(SUM(amt) AS DOUBLE), 4) AS amt
FROM enriched_b GROUP BY 1, 2, 3, 4""",
    "latest_per_key": "SELECT * FROM clean_sku",
    "brand_code_lookup": """
SELECT DISTINCT prod_brand, b.brand_desc FROM raw_b LEFT JOIN brands b ON prod_brand = brand_code""",
    "carveout_keys": "SELECT sales_main_key FROM c_keys",
    "exclude_carveout": f"""
SELECT shop_code, region_key, {_LINES} FROM valid_b
WHERE sales_main_key NOT IN (SELECT sales_main_key FROM c_keys) GROUP BY 1, 2""",
    "carveout_semi": f"""
SELECT shop_code, region_key, {_LINES} FROM valid_b
WHERE sales_main_key IN (SELECT sales_main_key FROM c_keys) GROUP BY 1, 2""",
    "carveout_sales": """
SELECT k.sales_main_key, s.item_code, s.item_subcat_desc, m.arti_cate_name,
  round(CAST(s.amt AS DOUBLE), 4) AS amt
FROM (SELECT * FROM valid_b WHERE prod_brand IS NOT NULL) s
LEFT JOIN map_c m ON s.item_subcat_desc = m.item_subcat_desc
RIGHT JOIN c_keys k ON s.sales_main_key = k.sales_main_key""",
    "brand_info": f"SELECT prod_brand, {_BRAND_INFO} GROUP BY prod_brand",
    "brand_info_by_year": f"""
SELECT prod_brand, CAST(year(order_date) AS INTEGER) AS year, {_BRAND_INFO} GROUP BY 1, 2""",
    "match_customers": """
SELECT ak AS a_key, bk AS b_key, 'a_b' AS overlap_name, a_email, b_email, a_mobile, b_mobile
FROM pair_a_b""",
    "unique_customers": "SELECT pair, n FROM uniq",
    "label_overlap": """
SELECT vip_no, order_no, loc_code, prod_desc, round(CAST(amt AS DOUBLE), 4) AS amt, in_b, in_c
FROM sales_a""",
    "brand_pairs": "SELECT DISTINCT ak AS a_key, bk AS b_key, 'a_b' AS overlap_name FROM pair_brand",
    "label_fanout": f"""
SELECT in_b, COUNT(*) AS n_lines, COUNT(DISTINCT order_no) AS n_orders,
  round(CAST(SUM(amt) AS DOUBLE), 4) AS amt FROM {_FAN_A} GROUP BY in_b""",
    "brand_segments": """
SELECT 'a_only' AS segment, COUNT(DISTINCT vip_no) AS n FROM lines_brand_a
WHERE vip_no NOT IN (SELECT ak FROM pair_brand)
UNION ALL SELECT 'b_only', COUNT(DISTINCT vip_main_no) FROM brand_b
WHERE vip_main_no NOT IN (SELECT bk FROM pair_brand)
UNION ALL SELECT 'both_a', COUNT(DISTINCT ak) FROM brand_both
UNION ALL SELECT 'both_b', COUNT(DISTINCT bk) FROM brand_both
UNION ALL SELECT 'pairs', COUNT(*) FROM brand_both""",
    "overlap_minus_brand": """
SELECT DISTINCT ak AS vip_no FROM pair_brand EXCEPT SELECT DISTINCT vip_no FROM lines_brand_a""",
    "kpi_aov": _both_sides(
        f"SELECT '{{side}}' AS side, {_ratio('SUM(amt)', 'COUNT(DISTINCT {order})')} AS aov"
        " FROM {rows}"
    ),
    "kpi_upt": _both_sides(
        f"SELECT '{{side}}' AS side, {_ratio('SUM(qty)', 'COUNT(DISTINCT {order})')} AS upt"
        " FROM {rows}"
    ),
    "kpi_price_point": _both_sides(
        f"SELECT '{{side}}' AS side, {_ratio('SUM(amt)', 'SUM(qty)')} AS avg_price_point"
        " FROM {rows}"
    ),
    "kpi_trans_per_cust": _both_sides(
        f"""SELECT '{{side}}' AS side,
  {_ratio("COUNT(DISTINCT {order})", "(SELECT n FROM uniq WHERE pair = 'a_b')")}
    AS avg_trans_per_cust FROM {{rows}}"""
    ),
    "kpi_spend_per_cust": _both_sides(
        f"""SELECT '{{side}}' AS side,
  {_ratio("SUM(amt)", "(SELECT n FROM uniq WHERE pair = 'a_b')")}
    AS avg_spend_per_cust FROM {{rows}}"""
    ),
    "sales_behavior": _behavior("a", "b"),
    "pair_report": " UNION ALL ".join(
        _behavior(a, b) for a, b in _REPORT_PAIRS
    ),
    "pair_demo_report": " UNION ALL ".join(
        f"SELECT '{a}_{b}' AS pair, * FROM ({_demo_side(a, _KEYS[a], b)}"
        f" UNION ALL {_demo_side(b, _KEYS[b], a)})"
        for a, b in _REPORT_PAIRS
    ),
    "pair_wallet_report": " UNION ALL ".join(
        f"SELECT '{a}_{b}' AS pair, * FROM ({_wallet(a, b)})" for a, b in _REPORT_PAIRS
    ),
    "pair_price_report": " UNION ALL ".join(
        f"SELECT '{a}_{b}' AS pair, category, {a}_price_point AS first_price_point,"
        f" {b}_price_point AS second_price_point FROM ({_price_table(a, b)})"
        for a, b in _REPORT_PAIRS
    ),
    "overlap_penetration": " UNION ALL ".join(
        f"""SELECT '{side}' AS side, n_overlap, n_all, {_ratio("n_overlap", "n_all", 6)} AS penetration
FROM (SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT {key} FROM sales_{side} WHERE in_{other} = 1))
  AS n_overlap, (SELECT COUNT(*) FROM (SELECT DISTINCT {key} FROM sales_{side})) AS n_all)"""
        for side, key, other in (("a", "vip_no", "b"), ("b", "vip_main_no", "a"))
    ),
    "tenure_share": " UNION ALL ".join(
        [_demo_side("a", "vip_no", "b"), _demo_side("b", "vip_main_no", "a")]
    ),
    "share_of_wallet": _wallet("a", "b"),
    "tier_percent": " UNION ALL ".join(
        [
            _tier_side(
                "a", "vip_no", "b", ("Beauty+", "Privilege", "Gold", "Platinum", "Diamond")
            ),
            _tier_side(
                "b",
                "vip_main_no",
                "a",
                ("ICARD Silver", "ICARD Gold", "ICARD Diamond", "ICARD Pre-member", "OTHERS"),
            ),
        ]
    ),
    "pricepoint_by_cat": f"""
SELECT arti_cate_name AS category, round(CAST(SUM(amt) AS DOUBLE), 4) AS sum_sales,
  CAST(SUM(qty) AS DOUBLE) AS sum_qty, {_ratio("SUM(amt)", "SUM(qty)")} AS price_point
FROM sales_a WHERE in_b = 1 GROUP BY arti_cate_name""",
    "pricepoint_table": _price_table("a", "b"),
    "top_brand": _top("brand_desc", _flagged("a")[0], "vip_no", 10),
    "top_brand_segment": _top(
        "brand_desc",
        f"(SELECT * FROM sales_a WHERE in_b = 1 AND bu_desc IN {_FASHION})",
        "vip_no",
        10,
    ),
    "top_class": _top(
        "class_desc",
        "(SELECT * FROM sales_a WHERE in_b = 1 AND bu_desc = 'COS')",
        "vip_no",
        None,
    ),
    "top_subclass": """
SELECT s.class_desc || '-' || s.subclass_desc AS class_subclass,
  COUNT(DISTINCT a.vip_no) AS n_customers
FROM sales_a a LEFT JOIN raw_a s ON a.order_no = s.order_no
WHERE a.in_b = 1 AND a.bu_desc = 'COS' AND lower(a.class_desc) NOT LIKE '%promo%'
GROUP BY 1 ORDER BY 2 DESC, 1 ASC NULLS LAST LIMIT 10""",
    "tier_matrix": _matrix("tier", "act_a", "act_b", _TIERS),
    "tenure_matrix": _matrix("tenure", _with_tenure("act_a"), _with_tenure("act_b"), _TENURES),
    "gender_counts": """
SELECT 'a' AS side, sex, COUNT(*) AS n FROM act_a WHERE sex IS NOT NULL GROUP BY sex
UNION ALL SELECT 'b', sex, COUNT(*) FROM act_b WHERE sex IS NOT NULL GROUP BY sex""",
    "pair_gender": _pair_share("sex", "a"),
    "pair_nationality": _pair_share("nationality", "b"),
    "sow_by_bu": _sow("bu_desc", _flagged("a")[0]),
    "sow_by_category": f"""
SELECT COALESCE(a.arti_cate_name, b.arti_cate_name) AS arti_cate_name, a.pct AS pct_a,
  b.pct AS pct_b
FROM ({_sow("arti_cate_name", "(SELECT * FROM sales_a WHERE in_b = 1 AND bu_desc = 'COS')")}) a
FULL JOIN ({_sow("arti_cate_name", _flagged("b")[0])}) b ON a.arti_cate_name = b.arti_cate_name""",
    "spend_by_cat_flag": """
SELECT arti_cate_name, in_a, round(CAST(SUM(amt) AS DOUBLE), 4) AS amt FROM sales_b GROUP BY 1, 2""",
    "penetration_by_store": """
SELECT shop_desc, round(AVG(CAST(in_a AS DOUBLE)), 6) AS penetration FROM sales_b
GROUP BY shop_desc ORDER BY penetration DESC, shop_desc ASC NULLS LAST LIMIT 6""",
    "brand_products": """
SELECT prod_desc, COUNT(DISTINCT vip_no) AS n_customers FROM sales_a
WHERE in_b = 1 AND brand_desc = 'Brand#2' GROUP BY prod_desc""",
    "brand_cross_shop": """
SELECT (SELECT COUNT(DISTINCT vip_no) FROM sales_a WHERE in_b = 1 AND upper(brand_desc) = 'BRAND#2')
  AS n_a,
  (SELECT COUNT(DISTINCT vip_main_no) FROM sales_b WHERE in_a = 1 AND brand_desc = 'BRAND#2') AS n_b,
  (SELECT COUNT(*) FROM pair_a_b
    WHERE ak IN (SELECT vip_no FROM sales_a WHERE in_b = 1 AND upper(brand_desc) = 'BRAND#2')
      AND bk IN (SELECT vip_main_no FROM sales_b WHERE in_a = 1 AND brand_desc = 'BRAND#2'))
  AS n_pairs""",
    "segment_pricepoint": " UNION ALL ".join(
        [
            _prices(
                "a_only",
                "(SELECT * FROM lines_brand_a WHERE vip_no NOT IN (SELECT ak FROM pair_brand))",
            ),
            _prices(
                "both", "(SELECT l.* FROM lines_brand_a l RIGHT JOIN brand_both c ON l.vip_no = c.ak)"
            ),
            _prices("fashion", f"(SELECT * FROM {_FAN_A} WHERE in_b = 1 AND bu_desc IN {_FASHION})"),
        ]
    ),
    "segment_spend_share": _sow(
        "bu_desc", "(SELECT * FROM lines_brand_a WHERE vip_no NOT IN (SELECT ak FROM pair_brand))"
    ),
    "segment_subclass": """
SELECT a.class_desc, s.subclass_desc, COUNT(DISTINCT a.vip_no) AS n_customers
FROM lines_brand_a a LEFT JOIN raw_a s ON a.order_no = s.order_no
WHERE a.vip_no NOT IN (SELECT ak FROM pair_brand)
GROUP BY 1, 2 ORDER BY 3 DESC, 1 ASC NULLS LAST, 2 ASC NULLS LAST LIMIT 13""",
    "distinct_items": """
SELECT DISTINCT item_desc, arti_cate_name, maincat_desc FROM scope_b
WHERE prod_brand = 'Brand#2' AND arti_cate_name IN ('Makeup', 'Haircare')""",
    "brand_list": "SELECT DISTINCT brand_desc FROM scope_cos ORDER BY brand_desc",
    "store_lookup": """
SELECT DISTINCT s.loc_code, d.store_name FROM sales_a s LEFT JOIN stores d ON s.loc_code = d.store_id
WHERE in_c = 1""",
    "customers_by_store": """
SELECT s.loc_code, d.store_name, COUNT(DISTINCT vip_no) AS n_customers
FROM sales_a s LEFT JOIN stores d ON s.loc_code = d.store_id WHERE in_b = 1 GROUP BY 1, 2""",
    "store_in_out": f"""
SELECT (SELECT COUNT(DISTINCT vip_main_no) FROM sales_c WHERE in_b = 1 AND {_SHOP_IN}) AS n_inside,
  (SELECT COUNT(DISTINCT vip_main_no) FROM (
    SELECT DISTINCT vip_main_no FROM sales_c WHERE in_b = 1 AND {_SHOP_IN}
    INTERSECT SELECT DISTINCT vip_main_no FROM sales_c WHERE in_b = 1 AND {_SHOP_OUT})) AS n_both""",
    "store_intersect": f"""
SELECT DISTINCT vip_main_no FROM sales_b WHERE in_a = 1 AND shop_code IN {_SHOPS_B}
INTERSECT
SELECT DISTINCT vip_main_no FROM sales_b WHERE in_a = 1 AND shop_code NOT IN {_SHOPS_B}""",
    "order_line_rejoin": f"""
SELECT item_subcat_desc AS category, round(CAST(SUM(amt) AS DOUBLE), 4) AS sum_sales,
  CAST(SUM(qty) AS DOUBLE) AS sum_qty, {_ratio("SUM(amt)", "SUM(qty)")} AS price_point
FROM (SELECT s.amt, s.qty, r.item_subcat_desc FROM sales_c s
  LEFT JOIN valid_b r ON s.sales_main_key = r.sales_main_key) GROUP BY item_subcat_desc""",
    "issue_counts": " UNION ALL ".join(
        [
            _issue_case("n_buyers", "TRUE", "TRUE"),
            _issue_case("joined_out", _JOINED_OUT, "TRUE"),
            _issue_case("joined_out_shop_out", _JOINED_OUT, _SHOP_OUT),
            _issue_case("joined_out_shop_in", _JOINED_OUT, _SHOP_IN),
            _issue_both("joined_out_shop_both", _JOINED_OUT),
            _issue_case("joined_in_shop_in", _JOINED_IN, _SHOP_IN),
            _issue_case("joined_in_shop_out", _JOINED_IN, _SHOP_OUT),
            _issue_both("joined_in_shop_both", _JOINED_IN),
            _issue_case("joined_out_unlabelled", _JOINED_OUT, "in_a = 0 AND in_b = 0"),
        ]
    ),
    "issue_intersect": f"""
SELECT DISTINCT s.vip_main_no FROM sales_b s JOIN issue i ON s.vip_main_no = i.member_no
  AND {_JOINED_IN} AND shop_code IN {_SHOPS_B}
INTERSECT
SELECT DISTINCT s.vip_main_no FROM sales_b s JOIN issue i ON s.vip_main_no = i.member_no
  AND {_JOINED_IN} AND shop_code NOT IN {_SHOPS_B}""",
    "issue_right_join": f"""
SELECT (SELECT COUNT(DISTINCT member_no) FROM issue) AS n_listed,
  (SELECT COUNT(DISTINCT vip_main_no) FROM {_HISTORY_C} s
    RIGHT JOIN issue i ON s.vip_main_no = i.member_no) AS n_sold,
  (SELECT COUNT(DISTINCT vip_main_no) FROM {_HISTORY_C} s
    RIGHT JOIN issue i ON s.vip_main_no = i.member_no AND {_JOINED_IN}) AS n_sold_at_shops,
  (SELECT COUNT(DISTINCT vip_main_no) FROM {_HISTORY_C} s
    RIGHT JOIN issue i ON s.vip_main_no = i.member_no
    WHERE order_date BETWEEN DATE '1998-04-01' AND DATE '1999-03-31' AND {_JOINED_IN})
    AS n_sold_at_shops_in_window""",
    "cohort_retention": _COHORT,
    "cohort_retention_pivot": _COHORT.replace(
        "\nSELECT label_first, label_second, COUNT(*) AS n FROM (",
        ", retained AS (SELECT label_first, label_second, COUNT(*) AS n FROM (",
    )
    + """)
SELECT label_first, MAX(CASE WHEN label_second = 'both' THEN n END) AS "both",
  MAX(CASE WHEN label_second = 'a_only' THEN n END) AS a_only,
  MAX(CASE WHEN label_second = 'b_only' THEN n END) AS b_only,
  MAX(CASE WHEN label_second = 'inactive' THEN n END) AS inactive
FROM retained GROUP BY label_first""",
    "pair_report_grid": "SELECT pair, side, "
    + ", ".join(
        f"MAX(CASE WHEN metric = '{m}' THEN value END) AS {m}"
        for m in (
            "n_customers", "aov", "upt", "avg_trans_per_cust", "avg_spend_per_cust", "avg_price_point",
        )
    )
    + " FROM ("
    + " UNION ALL ".join(_behavior(a, b) for a, b in _REPORT_PAIRS)
    + ") GROUP BY pair, side",
    "issue_list": "SELECT member_no, issue_location FROM issue",
    "sales_view": f"SELECT bu_desc, in_b, {_LINES} FROM sales_a GROUP BY bu_desc, in_b",
}


def oracle_queries() -> dict[str, str]:
    """Each query's full SQL text."""
    return {name: f"{PREFIX}{select}" for name, select in _SELECTS.items()}
