"""Panels built from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed text: the main panel, valid in Spark SQL and in ANSI dialects.
PANEL_SQL = """
SELECT l_extendedprice AS y, o_totalprice AS y2,
       CAST(l_quantity AS double) AS x, l_discount AS x2,
       l_tax AS c_tax,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size AS double) END AS c_size,
       CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS c_sbal,
       CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE p_retailprice END AS c_retail,
       c_acctbal AS c_cbal,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_linenumber AS double) END AS z,
       o_custkey AS firm, p_brand AS ind, year(o_orderdate) AS tm,
       s_nationkey AS region, c_nationkey AS home,
       l_partkey * 10 + year(o_orderdate) % 10 AS cell
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem", "orders", "customer", "part", "supplier")
    return spark.sql(PANEL_SQL)


# Fixed text: hourly panel of events.
EVENTS_SQL = """
SELECT value AS y, CAST({k} AS double) AS x, user_id AS firm, event_type AS ind,
       date_trunc('hour', ts) AS tm, date_trunc('day', ts) AS region
FROM events
"""
# Fixed text: documents with few clusters.
DOCS_SQL = """
SELECT CAST(quality AS double) AS y, CAST(n_chars AS double) AS x,
       CAST(toxic AS double) AS c1, source AS firm, lang AS region
FROM documents JOIN labels ON documents.doc_id = labels.doc_id
"""
# Fixed text: a result table over the orders, for the reports.
MODELS_SQL = """
SELECT CASE WHEN o_custkey % 3 = 0 THEN 'y1' ELSE 'y0' END AS y,
       CASE WHEN o_custkey % 5 = 0 THEN 'x1' ELSE 'x0' END AS x,
       CASE WHEN o_custkey % 7 = 0 THEN 'no_absorb_robust'
            ELSE 'ab_firm_time_cl_firm' END AS spec_tag,
       o_orderkey AS bits,
       (o_totalprice - 150000) / 1000 AS coef,
       CAST(7 + o_custkey % 2 * 6 AS double) AS se,
       (o_totalprice - 150000) / 1000 / CAST(7 + o_custkey % 2 * 6 AS double) AS t_value,
       CAST(o_orderkey % 211 AS double) / 1000 AS p_value,
       1000 + o_custkey % 97 AS obs,
       o_orderkey % 2 = 0 AS in_a,
       o_orderkey % 3 = 0 AS in_b,
       o_custkey % 2 = 0 AS in_c,
       o_custkey % 2 = 1 AND o_orderkey % 5 = 0 AS in_d,
       (o_totalprice - 160000) / 1000 AS coef_a,
       CAST(o_orderkey % 173 AS double) / 1000 AS p_a
FROM orders
"""


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(EVENTS_SQL.format(k="get_json_object(props, '$.k')"))


def docs_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "documents", "labels")
    return spark.sql(DOCS_SQL)


def order_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as a result table: nested columns made from the flags."""
    tables(spark, sf_dir, "orders")
    flat = spark.sql(MODELS_SQL)
    optional = [F.when(F.col(f"in_{c}"), F.lit(c)) for c in "abcd"]
    width = F.lit(2.5) * F.col("se")

    def stat(name, coef, p):
        return F.struct(
            F.lit(name).alias("name"), coef.alias("coef"), F.lit(1.0).alias("se"),
            coef.alias("t_value"), p.alias("p_value"),
        )

    return flat.select(
        "y", "x", "spec_tag", F.col("spec_tag").alias("spec_name"), "bits",
        "coef", "se", "t_value", "p_value",
        *[F.lit(None).cast("double").alias(n) for n in ("adj_r2", "within_r2", "f_stat")],
        F.lit(100).cast("long").alias("df_resid"),
        (F.col("coef") - width).alias("ci99_lo"), (F.col("coef") + width).alias("ci99_hi"),
        (F.col("coef") - 2 * F.col("se")).alias("ci95_lo"),
        (F.col("coef") + 2 * F.col("se")).alias("ci95_hi"),
        (F.col("coef") - F.col("se")).alias("ci90_lo"),
        (F.col("coef") + F.col("se")).alias("ci90_hi"),
        F.array_compact(F.array(*optional)).alias("controls_test"),
        F.array_compact(F.array(F.lit("m"), *optional)).alias("controls_all"),
        F.array_compact(
            F.array(
                stat("m", F.col("coef"), F.col("p_value")),
                F.when(F.col("in_a"), stat("a", F.col("coef_a"), F.col("p_a"))),
            )
        ).alias("control_stats"),
        (F.col("in_a") & F.col("in_b") & (F.col("in_c") | F.col("in_d"))).alias("is_full"),
        "obs",
        F.lit("ok").alias("status"),
    )
