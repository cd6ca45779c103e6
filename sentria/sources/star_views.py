"""Report tables derived from the star-schema test tables.

Orders play reports, order lines play report drugs and reactions, and
supplier -> nation -> region plays preferred term -> high-level term -> organ
class. Each view is one SQL text that Spark and DuckDB both run, so a query and
its check read the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentria.session import tasks_for

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# The report key of the tables that have one.
_REPORT_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}

# Text date "dd-MON-yy" of a date expression, in functions both engines share.
_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def _text_date(d: str) -> str:
    return (
        f"concat(lpad(CAST(day({d}) AS STRING), 2, '0'), '-', "
        f"substr('{_MONTHS}', 3 * month({d}) - 2, 3), '-', "
        f"lpad(CAST(year({d}) % 100 AS STRING), 2, '0'))"
    )


VIEWS: dict[str, str] = {
    "reports": f"""
SELECT o_orderkey AS REPORT_ID, CAST(o_orderkey AS STRING) AS REPORT_NO,
  CAST(o_orderdate AS DATE) AS DATINTRECEIVED_CLEAN,
  {_text_date('CAST(o_orderdate AS DATE)')} AS DATINTRECEIVED,
  CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' ELSE '' END AS SERIOUSNESS_ENG,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus = 'F' THEN 1 WHEN o_orderkey % 7 = 1 THEN 2 END AS DEATH,
  CASE WHEN o_orderkey % 11 = 0 THEN 1 END AS DISABILITY,
  CASE WHEN o_orderkey % 13 = 0 THEN 1 END AS CONGENITAL_ANOMALY,
  CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS LIFE_THREATENING,
  CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS HOSP_REQUIRED,
  CASE WHEN o_orderkey % 4 = 0 THEN 1 END AS OTHER_MEDICALLY_IMP_COND,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Male' WHEN 'MACHINERY' THEN 'Male' WHEN 'AUTOMOBILE' THEN 'Female'
       WHEN 'HOUSEHOLD' THEN 'Female' ELSE '' END AS GENDER_ENG,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal / 80 END AS AGE_Y,
  CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS REPORTER_TYPE_ENG,
  o_orderpriority AS OUTCOME_ENG
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "report_drug": """
SELECT l_orderkey AS REPORT_ID, CAST(l_orderkey AS STRING) AS REPORT_NO,
  l_orderkey * 100 + l_linenumber AS REPORT_DRUG_ID, l_partkey AS DRUG_PRODUCT_ID,
  concat(p_brand, ' ', p_type) AS DRUGNAME,
  CASE l_returnflag WHEN 'A' THEN 'Suspect' WHEN 'R' THEN 'Concomitant' ELSE 'Treatment' END AS DRUGINVOLV_ENG,
  CASE WHEN l_linenumber <> 7 THEN p_name END AS INDICATION_NAME_ENG
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "drug_ingredients": """
SELECT p_partkey AS DRUG_PRODUCT_ID, p_brand AS ACTIVE_INGREDIENT_NAME FROM {part}""",
    "substances": """
SELECT DISTINCT p_type AS ing, concat(p_brand, ' ', p_type) AS DRUGNAME FROM {part}""",
    "reactions": """
SELECT l_orderkey AS REPORT_ID, CAST(l_orderkey AS STRING) AS REPORT_NO, s_name AS PT_NAME_ENG,
  n_name AS HLT_Term, r_name AS SOC_NAME_ENG, CASE WHEN s_suppkey % 10 = 0 THEN 'SMQ 0' END AS SMQ,
  CASE WHEN l_orderkey % 2 = 0 THEN 'v.18.1' ELSE 'v.19.0' END AS MEDDRA_VERSION
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # Two dictionary versions; the newer lacks some terms, and each term also
    # has a secondary row under another high-level term.
    "hierarchy": """
SELECT s_suppkey AS PT_Code, n_nationkey AS HLT_Code, r_regionkey AS HLGT_Code, r_regionkey AS SOC_Code,
  s_name AS PT_Term, n_name AS HLT_Term, concat('GROUP ', r_name) AS HLGT_Term, r_name AS SOC_Term,
  substr(r_name, 1, 4) AS SOC_Abbrev, r_regionkey AS Primary_PT_SOC, flag AS Primary_SOC_flag, version AS MEDDRA_VERSION
FROM (
  SELECT s_suppkey, s_name, s_nationkey AS nk, 'Y' AS flag, 'v.18.1' AS version FROM {supplier}
  UNION ALL SELECT s_suppkey, s_name, s_nationkey AS nk, 'Y', 'v.19.0' FROM {supplier} WHERE s_suppkey % 10 <> 3
  UNION ALL SELECT s_suppkey, s_name, (s_nationkey + 1) % 25 AS nk, 'N', 'v.18.1' FROM {supplier}
) t JOIN {nation} ON nk = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # Report x ingredient x reaction fact; ingredient = brand, about one row in
    # 41 without a preferred term.
    "fact": """
SELECT d.l_orderkey AS REPORT_ID, concat(p_brand, ' ', p_type) AS DRUGNAME, p_brand AS ing,
  CASE WHEN r.l_linenumber + r.l_orderkey % 41 = 41 THEN NULL ELSE s_name END AS PT_NAME_ENG,
  CASE WHEN s_suppkey % 17 = 5 THEN NULL ELSE n_name END AS HLT_NAME_ENG,
  r_name AS SOC_NAME_ENG,
  CASE WHEN d.l_orderkey % 2 = 0 THEN 'v.18.1' ELSE 'v.19.0' END AS MEDDRA_VERSION,
  CAST(year(CAST(o_orderdate AS DATE)) * 10 + quarter(CAST(o_orderdate AS DATE)) AS BIGINT) AS quarter
FROM {lineitem} d JOIN {part} ON d.l_partkey = p_partkey
  JOIN {lineitem} r ON d.l_orderkey = r.l_orderkey
  JOIN {supplier} ON r.l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
  JOIN {region} ON n_regionkey = r_regionkey JOIN {orders} ON d.l_orderkey = o_orderkey""",
    # The same rows before they are joined: report x ingredient and report x reaction, with the report's quarter.
    "report_ingredients": """
SELECT l_orderkey AS REPORT_ID, p_brand AS ing,
  CAST(year(CAST(o_orderdate AS DATE)) * 10 + quarter(CAST(o_orderdate AS DATE)) AS BIGINT) AS quarter
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey""",
    "report_terms": """
SELECT l_orderkey AS REPORT_ID, CASE WHEN l_linenumber + l_orderkey % 41 = 41 THEN NULL ELSE s_name END AS PT_NAME_ENG,
  CASE WHEN s_suppkey % 17 = 5 THEN NULL ELSE n_name END AS HLT_NAME_ENG,
  CAST(year(CAST(o_orderdate AS DATE)) * 10 + quarter(CAST(o_orderdate AS DATE)) AS BIGINT) AS quarter
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
  JOIN {region} ON n_regionkey = r_regionkey JOIN {orders} ON l_orderkey = o_orderkey""",
    # Text dates over six decades, for the two-digit-year rule.
    "extract_dates": f"""
SELECT o_orderkey AS REPORT_ID, {_text_date('received')} AS DATRECEIVED, {_text_date('first_received')} AS DATINTRECEIVED,
  received, first_received
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS received,
        make_date(CAST(year(CAST(o_orderdate AS DATE)) - o_orderkey % 60 AS INT), CAST(month(CAST(o_orderdate AS DATE)) AS INT),
          CAST(1 + o_orderkey % 28 AS INT)) AS first_received
      FROM {{orders}}) t""",
    # Flat rows of the nested documents.
    "doc_reports": """
SELECT o_orderkey AS REPORT_ID, CAST(o_orderdate AS DATE) AS receivedate,
  CASE WHEN o_orderkey % 9 <> 0 THEN n_name END AS occurcountry,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS serious,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus = 'F' THEN 1 END AS death,
  CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS lifethreatening, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS hospitalization,
  CASE WHEN o_orderkey % 11 = 0 THEN 1 END AS disabling, CASE WHEN o_orderkey % 13 = 0 THEN 1 END AS congenitalanomali,
  CASE WHEN o_orderkey % 4 = 0 THEN 1 END AS other,
  CASE WHEN o_orderkey % 8 BETWEEN 1 AND 6 THEN CAST(o_orderkey % 8 AS INT) END AS qualification,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'HOUSEHOLD' THEN 0 END AS patientsex,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal / 80 END AS patientonsetage,
  CASE WHEN o_orderkey % 19 <> 0 THEN CAST(800 + o_orderkey % 7 AS STRING) END AS patientonsetageunit
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "doc_drugs": """
SELECT l_orderkey AS REPORT_ID, CASE WHEN l_linenumber <> 7 THEN p_name END AS drugindication,
  p_brand AS generic_name, concat(p_brand, ' ', p_type) AS brand_name, p_type AS pharm_class_epc
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "doc_reactions": """
SELECT l_orderkey AS REPORT_ID, s_name AS reactionmeddrapt, CAST(1 + (l_linenumber + l_orderkey) % 7 AS INT) AS reactionoutcome
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    # Monthly counts of all orders.
    "events_months": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS time_p, count(*) AS n
FROM {orders} GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)""",
}


def duckdb_view(name: str) -> str:
    """SQL text of a view over plainly named tables."""
    return VIEWS[name].format(**{t: t for t in _TABLES}).replace("AS STRING", "AS VARCHAR")


def with_views(body: str, *names: str) -> str:
    """A query text with the named views as common table expressions."""
    ctes = ", ".join(f"{n} AS ({duckdb_view(n)})" for n in names)
    rest = body.lstrip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {ctes}, {rest[5:]}"
    return f"WITH {ctes} {rest}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the report tables as a DataFrame."""
    used = {t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)


def report_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Number of tasks that the rows by report are dealt to: it follows the rows."""
    return tasks_for(*[table(spark, sf_dir, t) for t in _REPORT_KEYS])


def rows_by_report(spark: SparkSession, sf_dir: str, *names: str, tasks: int | None = None) -> list[DataFrame]:
    """Views over order lines, these and their orders dealt by report before anything is joined.

    Only keys and the columns in use are moved, once; names are looked up behind the
    exchange, and sets per report need no other. The number of tasks follows the rows,
    so that what a task sorts, hashes and collects does not grow with the tables; give
    ``tasks`` if ``report_tasks`` was asked before.
    """
    tables = {t: table(spark, sf_dir, t) for t in _TABLES}
    tasks = tasks or report_tasks(spark, sf_dir)
    dealt = {t: tables[t].repartition(tasks, key) for t, key in _REPORT_KEYS.items()}
    # A task's share of the orders is at most about TASK_ROWS narrow rows: no sorts for this join.
    dealt["orders"] = dealt["orders"].hint("shuffle_hash")
    return [spark.sql(VIEWS[v], **{t: x for t, x in (tables | dealt).items() if "{" + t + "}" in VIEWS[v]}) for v in names]
