"""Data-quality gates as queries: each returns its violations or its report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, splits
from ..registry import query
from .relational import PATCH_SQL, patches


def N():
    """Rows."""
    return F.count(F.lit(1))


@query("Q1_split_problems", f"""
WITH {PATCH_SQL}, q AS (SELECT * FROM p WHERE NOT (split = 'test' AND tumor_frac > 0.05)),
c AS (SELECT s, count(DISTINCT slide_id) FILTER (split = s) AS n, count(*) FILTER (split = s AND tumor_frac > 0.05) AS tumor FROM q, (VALUES ('train'), ('val'), ('test')) v(s) GROUP BY 1)
SELECT CASE WHEN n = 0 THEN s || ': no slides' WHEN n < 3 THEN s || ': only ' || n || ' slides' END AS problem FROM c WHERE n < 3
UNION ALL SELECT s || ': no tumor patches' FROM c WHERE n > 0 AND tumor = 0""")
def _(t):
    p = patches(t).filter(~((F.col("split") == "test") & (F.col("tumor_frac") > 0.05)))
    return splits.split_problems(p).select(F.explode("problems").alias("problem"))


@query("Q3_S13_failures", "SELECT event_id, user_id AS slide FROM events WHERE event_type = 'error'")
def _(t):
    return quality.unacknowledged(t.events.filter("event_type = 'error'").select("event_id", F.col("user_id").alias("slide")), False)


@query("Q4_tissue_contract", """
WITH s AS (SELECT l_orderkey AS slide_id, round(avg(l_quantity / 50.0::DOUBLE), 9) AS frac, sum(l_quantity) * 0.05::DOUBLE AS mm2 FROM lineitem GROUP BY 1)
SELECT slide_id, CASE WHEN frac > 0.9 THEN 'too much tissue' ELSE 'too little tissue' END AS problem FROM s WHERE frac > 0.9 OR mm2 < 1""")
def _(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("slide_id")).agg(F.round(F.avg(F.col("l_quantity") / 50.0), 9).alias("frac"), (F.sum("l_quantity") * 0.05).alias("mm2"))
    return quality.tissue_contract(s, F.col("frac"), F.col("mm2")).select("slide_id", "problem")


@query("Q6_index_audit", f"""
WITH {PATCH_SQL}, s AS (SELECT split, slide_id, sum(tumor_frac) AS captured, count(*) AS n FROM p GROUP BY 1, 2)
SELECT split, count(*) AS slides, round(quantile_cont(captured, 0.1), 6) AS q10, round(quantile_cont(captured, 0.5), 6) AS median, count(*) FILTER (captured < 0.0799999) AS poor FROM s GROUP BY 1""")
def _(t):
    s = patches(t).groupBy("split", "slide_id").agg(F.round(F.sum("tumor_frac"), 9).alias("captured"))
    q = lambda p: F.round(F.percentile("captured", F.lit(p)), 6)
    return s.groupBy("split").agg(N().alias("slides"), q(0.1).alias("q10"), q(0.5).alias("median"), F.count_if(F.col("captured") < F.lit(0.0799999)).alias("poor"))


@query("Q7_cohort_probe", """
SELECT c_mktsegment AS vendor, count(*) AS n, count(DISTINCT c_nationkey) AS sites, count(*) FILTER (c_acctbal <= 0) AS no_scale, round(avg(c_acctbal), 8) AS mean FROM customer GROUP BY 1""")
def _(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("vendor")).agg(N().alias("n"), F.countDistinct("c_nationkey").alias("sites"), F.count_if(F.col("c_acctbal") <= 0).alias("no_scale"), F.round(F.avg("c_acctbal"), 8).alias("mean"))


@query("Q8_tissue_review", """
WITH r AS (SELECT s_nationkey AS vendor, s_suppkey, greatest(0, least(1, s_acctbal / 10000.0::DOUBLE)) AS iou FROM supplier)
SELECT vendor, count(*) AS n, round(avg(iou), 9) AS mean, round(min(iou), 6) AS worst, count(*) FILTER (iou < 0.2) AS suspect FROM r GROUP BY 1""")
def _(t):
    iou = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s_acctbal") / 10000.0))
    r = t.supplier.select(F.col("s_nationkey").alias("vendor"), iou.alias("iou"))
    return r.groupBy("vendor").agg(N().alias("n"), F.round(F.avg("iou"), 9).alias("mean"), F.round(F.min("iou"), 6).alias("worst"), F.count_if(F.col("iou") < 0.2).alias("suspect"))


@query("Q9_bucket_diagnosis", r"""
SELECT regexp_extract(url, '^(https?://[^/]*)/', 1) AS folder, regexp_extract(url, '://[^/]*/([a-z]*)/', 1) AS ext, count(*) AS n, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1, 2""")
def _(t):
    p = t.pages.select(F.regexp_extract("url", "^(https?://[^/]*)/", 1).alias("folder"), F.regexp_extract("url", "://[^/]*/([a-z]*)/", 1).alias("ext"), F.octet_length("html").alias("b"))
    return p.groupBy("folder", "ext").agg(N().alias("n"), F.sum("b").alias("bytes"))


@query("Q10_not_binary", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE round(l_tax * 100) NOT IN (0, 1)")
def _(t):
    d = t.lineitem.withColumn("v", F.round(F.col("l_tax") * 100).cast("int"))
    return quality.not_binary(d, F.col("v")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("Q13_plan_warnings", """
WITH s AS (SELECT count(*) FILTER (lang = 'en') AS t, count(*) FILTER (lang = 'es') AS n FROM documents)
SELECT 'tumor' AS kind, t AS n, 100000 AS least FROM s WHERE t < 100000 UNION ALL SELECT 'normal', n, 200000 FROM s WHERE n < 200000""")
def _(t):
    kind = F.when(F.col("lang") == "en", "tumor").when(F.col("lang") == "es", "normal")
    return quality.plan_warnings(t.documents.select(kind.alias("kind")), least={"tumor": 100_000, "normal": 200_000})
