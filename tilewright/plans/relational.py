"""Relational queries: index summary, joins, aggregates, rankings, samples, sets.

Stand-ins: line items are patches (slide l_orderkey, tumour share l_discount, tissue share l_quantity / 50), orders are
slides, customers are patients with their segment as class.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys, units
from ..operators import sampling, splits
from ..registry import query


def N():
    """Rows."""
    return F.count(F.lit(1))


SPLIT_SQL = "CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END"
PATCH_SQL = f"""p AS (SELECT l_orderkey AS slide_id, l_linenumber, l_partkey, l_suppkey, l_quantity / 50.0::DOUBLE AS tissue_frac, l_discount AS tumor_frac,
  CASE WHEN l_discount > 0.05 THEN 'tumor' WHEN l_discount > 0 THEN 'boundary' ELSE 'normal' END AS bucket, {SPLIT_SQL} AS split
  FROM (SELECT *, ('0x' || substr(md5('1337:' || o_custkey), 1, 8))::BIGINT % 100 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def patches(t):
    line = t.lineitem.select(F.col("l_orderkey").alias("slide_id"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 50.0).alias("tissue_frac"), F.col("l_discount").alias("tumor_frac"))
    slides = t.orders.select("o_orderkey", keys.hash_split(F.col("o_custkey")).alias("split"))
    return line.join(slides, F.col("slide_id") == F.col("o_orderkey")).drop("o_orderkey").withColumn("bucket", units.bucket(F.col("tumor_frac")))


@query("patch_index_summary", f"WITH {PATCH_SQL} SELECT split, bucket, count(*) AS n_patches, count(DISTINCT slide_id) AS n_slides FROM p GROUP BY 1, 2")
def _(t):
    return patches(t).groupBy("split", "bucket").agg(N().alias("n_patches"), F.countDistinct("slide_id").alias("n_slides"))


@query("O2_stratified_split", """
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1337:' || c_mktsegment || ':' || c_custkey)) - 1 AS i,
  count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
v AS (SELECT *, greatest(round_even(n * 15 / 100.0::DOUBLE, 0), 1) AS nv FROM r),
c AS (SELECT *, greatest(least(round_even(n * 70 / 100.0::DOUBLE, 0), n - nv - 1), 1) AS nt FROM v)
SELECT c_custkey, c_mktsegment, CASE WHEN i < nt THEN 'train' WHEN i < nt + nv THEN 'val' ELSE 'test' END AS split FROM c""")
def _(t):
    return splits.stratified_split(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


@query("W1_O14_tissue_gate", f"""
WITH {PATCH_SQL} SELECT split, count(*) AS n, floor(count(*) FILTER (bucket = 'tumor') * (1 + 3 + 0.1::DOUBLE))::BIGINT AS epoch FROM p WHERE tissue_frac >= 0.10 GROUP BY 1""")
def _(t):
    d = patches(t).filter(F.col("tissue_frac") >= 0.10)
    return d.groupBy("split").agg(N().alias("n"), sampling.epoch_length(F.count_if(F.col("bucket") == "tumor")).alias("epoch"))


@query("W2_W3_split_and_class_filters", f"WITH {PATCH_SQL} SELECT slide_id, l_linenumber, tumor_frac, split FROM p WHERE split IN ('train', 'val') AND tumor_frac > 0.05 AND tissue_frac > 0.5")
def _(t):
    return patches(t).filter(F.col("split").isin("train", "val") & (F.col("tumor_frac") > 0.05) & (F.col("tissue_frac") > 0.5)).select("slide_id", "l_linenumber", "tumor_frac", "split")


@query("W4_O17_budget_plan", """
WITH o AS (SELECT doc_id, 'obj_' || doc_id AS name, n_chars AS size, CASE lang WHEN 'en' THEN 'tumor' WHEN 'de' THEN 'normal' WHEN 'fr' THEN 'annotation' ELSE 'other' END AS kind FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('1337:' || name)) AS j FROM o WHERE kind IN ('tumor', 'normal')),
k AS (SELECT *, CASE WHEN kind = 'tumor' THEN j WHEN 1.0 > j - 1 THEN 0 ELSE floor((j - 1) / 1.0) + 1 END AS pos, (kind = 'normal')::INT AS second FROM r),
s AS (SELECT *, sum(size) OVER (ORDER BY pos, second, j) + (SELECT coalesce(sum(size), 0) FROM o WHERE kind = 'annotation') > 900000 AS over FROM k),
g AS (SELECT *, max(over::INT) OVER (ORDER BY pos, second, j) AS gone FROM s)
SELECT name, kind, size FROM g WHERE gone = 0 UNION ALL SELECT name, kind, size FROM o WHERE kind = 'annotation'""")
def _(t):
    kind = F.when(F.col("lang") == "en", "tumor").when(F.col("lang") == "de", "normal").when(F.col("lang") == "fr", "annotation").otherwise("other")
    o = t.documents.select(F.concat(F.lit("obj_"), F.col("doc_id").cast("string")).alias("name"), kind.alias("kind"), F.col("n_chars").alias("size"))
    return sampling.interleaved_plan(o, 900_000)


@query("W6_fresh_failures", """
SELECT count(*) AS failures FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def _(t):
    """Failures older than the table they belong to are stale and don't count."""
    newest = t.events.agg(F.max("ts").alias("top"))
    return t.events.filter("event_type = 'error'").crossJoin(F.broadcast(newest)).filter("ts >= top - interval 1 day").agg(N().alias("failures"))


@query("W7_dropna", "SELECT o_orderkey, quality FROM orders JOIN labels ON o_orderkey = doc_id WHERE quality IS NOT NULL")
def _(t):
    d = t.orders.join(t.labels, F.col("o_orderkey") == F.col("doc_id"), "left").select("o_orderkey", "quality")
    return d.dropna(subset=["quality"])


@query("W8_scale_outliers", "SELECT p_partkey, p_size FROM part WHERE p_size / 8.0::DOUBLE > 2 OR p_size / 8.0::DOUBLE < 0.5")
def _(t):
    r = F.col("p_size") / 8.0
    return t.part.filter((r > 2) | (r < 0.5)).select("p_partkey", "p_size")


@query("J1_left_join_coalesce", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(s_name, 'none') AS vendor FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey""")
def _(t):
    s = t.supplier.filter("s_acctbal > 0").select("s_suppkey", "s_name")
    return t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("s_name", F.lit("none")).alias("vendor"))


@query("J2_two_key_left_join", """
WITH m AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2),
s AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS tumor_frac FROM lineitem WHERE l_tax > 0.02 GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, n, tumor_frac FROM m LEFT JOIN s USING (l_orderkey, l_linenumber)""")
def _(t):
    m = t.lineitem.filter("l_quantity > 25").groupBy("l_orderkey", "l_linenumber").agg(N().alias("n"))
    s = t.lineitem.filter(F.col("l_tax") > 0.02).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("tumor_frac"))
    return m.join(s, ["l_orderkey", "l_linenumber"], "left")


@query("J3_full_outer_join", """
WITH a AS (SELECT l_orderkey AS slide_id, count(*) AS lesions FROM lineitem WHERE l_discount > 0.08 GROUP BY 1),
b AS (SELECT l_orderkey AS slide_id, round(sum(l_quantity), 2) AS coverage FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT slide_id, lesions, coverage FROM a FULL JOIN b USING (slide_id)""")
def _(t):
    a = t.lineitem.filter(F.col("l_discount") > 0.08).groupBy(F.col("l_orderkey").alias("slide_id")).agg(N().alias("lesions"))
    b = t.lineitem.filter(F.col("l_quantity") > 40).groupBy(F.col("l_orderkey").alias("slide_id")).agg(F.round(F.sum("l_quantity"), 2).alias("coverage"))
    return a.join(b, "slide_id", "outer")


@query("J4_J5_lookup_joins", """
SELECT c_custkey, n_name, r_name, coalesce(s.n, 0) AS n_suppliers, 1.0::DOUBLE AS residual FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = c_nationkey""")
def _(t):
    s = t.supplier.filter("s_acctbal > 5000").groupBy("s_nationkey").agg(N().alias("n"))
    d = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(s, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    return d.select("c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_suppliers"), F.lit(1.0).alias("residual"))


@query("J6_sibling_annotation_join", """
SELECT page_id, coalesce(len(string_split(text, ' ')), 0)::BIGINT AS n_coords FROM pages LEFT JOIN benchmark ON page_id = item_id""")
def _(t):
    """A slide without its file has an empty geometry, not a missing one."""
    d = t.pages.select("page_id").join(t.benchmark, F.col("page_id") == F.col("item_id"), "left")
    return d.select("page_id", F.coalesce(F.size(F.split("text", " ")), F.lit(0)).cast("long").alias("n_coords")).withColumn("n_coords", F.greatest("n_coords", F.lit(0)))


@query("J7_J16_present_and_missing", """
SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS present FROM documents""")
def _(t):
    known = t.labels.select("doc_id").distinct()
    have = t.documents.join(known, "doc_id", "left_semi").select("doc_id", F.lit(True).alias("present"))
    return have.unionByName(t.documents.join(known, "doc_id", "left_anti").select("doc_id", F.lit(False).alias("present")))


@query("J8_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return t.documents.join(t.labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("J9_Q2_split_leaks", """
SELECT l_orderkey AS slide_id, count(DISTINCT l_returnflag) AS n_splits FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def _(t):
    return splits.leaks(t.lineitem.select(F.col("l_orderkey").alias("slide_id"), F.col("l_returnflag").alias("split")))


@query("A1_A2_A6_split_report", f"""
WITH {PATCH_SQL} SELECT split, count(*) AS n, count(DISTINCT slide_id) AS slides, round(avg((tumor_frac > 0.05)::INT), 6) AS tumor_rate, count(*) FILTER (tumor_frac = 0) AS normal FROM p GROUP BY 1""")
def _(t):
    rate = F.avg((F.col("tumor_frac") > 0.05).cast("double"))
    return patches(t).groupBy("split").agg(N().alias("n"), F.countDistinct("slide_id").alias("slides"), F.round(rate, 6).alias("tumor_rate"), F.count_if(F.col("tumor_frac") == 0).alias("normal"))


@query("A3_class_by_split", f"""
WITH {PATCH_SQL} SELECT bucket, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM p GROUP BY 1""")
def _(t):
    return patches(t).groupBy("bucket").pivot("split", ["train", "val", "test"]).count().fillna(0)


@query("A4_frequencies", "SELECT p_brand, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY 1")
def _(t):
    d = t.part.groupBy("p_brand").agg(N().alias("n"))
    return d.withColumn("place", F.rank().over(W.orderBy(F.col("n").desc(), "p_brand")).cast("long"))


@query("A5_sums_by_kind", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("lang").agg(N().alias("n"), F.sum("n_chars").alias("bytes"))


@query("A7_quantiles", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.99), 4) AS q99 FROM lineitem GROUP BY 1""")
def _(t):
    q = lambda p: F.round(F.percentile("l_extendedprice", F.lit(p)), 4)
    return t.lineitem.groupBy("l_returnflag").agg(q(0.1).alias("q10"), q(0.5).alias("median"), q(0.99).alias("q99"))


@query("A8_A9_upper_median", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = n // 2) AS upper_median, max(value) FILTER (i = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99 FROM r GROUP BY 1""")
def _(t):
    """Order statistics by rank, not by gathering a group's values."""
    w = W.partitionBy("event_type")
    d = t.events.select("event_type", "value", (F.row_number().over(w.orderBy("value")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda k: F.max(F.when(F.col("i") == k, F.col("value")))
    return d.groupBy("event_type").agg(at(F.floor(F.col("n") / 2)).alias("upper_median"), at(F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1)).alias("p99"))


@query("A10_A11_describe_by_vendor", """
SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 8) AS mean, round(quantile_cont(s_acctbal, 0.5), 4) AS median, min(s_acctbal) AS least, max(s_acctbal) AS most FROM supplier GROUP BY 1""")
def _(t):
    b = "s_acctbal"
    return t.supplier.groupBy("s_nationkey").agg(N().alias("n"), F.round(F.avg(b), 8).alias("mean"), F.round(F.percentile(b, F.lit(0.5)), 4).alias("median"), F.min(b).alias("least"), F.max(b).alias("most"))


@query("A30_evaluable_by_split", f"""
WITH {PATCH_SQL}, s AS (SELECT split, slide_id, count(*) FILTER (tumor_frac > 0.05) AS evaluable, count(*) FILTER (bucket = 'boundary') AS itc FROM p GROUP BY 1, 2)
SELECT split, sum(evaluable)::BIGINT AS lesions, count(*) FILTER (evaluable > 0) AS slides, count(*) FILTER (evaluable = 0 AND itc > 0) AS itc_only FROM s GROUP BY 1""")
def _(t):
    s = patches(t).groupBy("split", "slide_id").agg(F.count_if(F.col("tumor_frac") > 0.05).alias("evaluable"), F.count_if(F.col("bucket") == "boundary").alias("itc"))
    return s.groupBy("split").agg(F.sum("evaluable").alias("lesions"), F.count_if(F.col("evaluable") > 0).alias("slides"), F.count_if((F.col("evaluable") == 0) & (F.col("itc") > 0)).alias("itc_only"))


@query("A31_group_count_map", "SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def _(t):
    counts = t.part.groupBy("p_type", "p_brand").agg(N().alias("n"))
    maps = counts.groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "n"))).alias("m"))
    return maps.select("p_type", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.size("m").cast("long").alias("brands"))


def KEY():
    """A patch's key."""
    return F.concat_ws("_", "slide_id", "l_linenumber", "l_partkey", "l_suppkey")


KEY_SQL = "slide_id || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey"


@query("O1_first_per_group", f"""
WITH {PATCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY md5('1337:' || {KEY_SQL}), {KEY_SQL}) AS k FROM p)
SELECT {KEY_SQL} AS key, bucket FROM r WHERE k <= 2""")
def _(t):
    return sampling.first_per_group(patches(t), ["slide_id"], KEY(), 2).select(KEY().alias("key"), "bucket")


@query("O7_O8_chunk_order_and_batches", """
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size // 16, p_partkey // 1024, p_size, p_partkey) - 1 AS place,
  (row_number() OVER (PARTITION BY p_brand ORDER BY p_size // 16, p_partkey // 1024, p_size, p_partkey) - 1) // 32 AS batch FROM part""")
def _(t):
    w = W.partitionBy("p_brand").orderBy(F.floor(F.col("p_size") / 16), F.floor(F.col("p_partkey") / 1024), "p_size", "p_partkey")
    d = t.part.select("p_partkey", (F.row_number().over(w) - 1).cast("long").alias("place"))
    return d.withColumn("batch", F.floor(F.col("place") / 32))


@query("O9_O10_suspects", """
WITH lo AS (SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 8), hi AS (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 8),
fl AS (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)
SELECT s_suppkey FROM lo UNION SELECT s_suppkey FROM hi UNION SELECT s_suppkey FROM fl""")
def _(t):
    s = t.supplier
    low, high = s.orderBy("s_acctbal", "s_suppkey").limit(8), s.orderBy(F.col("s_acctbal").desc(), "s_suppkey").limit(8)
    return low.unionByName(high).unionByName(s.filter("s_nationkey = 3")).dropDuplicates(["s_suppkey"]).select("s_suppkey")


@query("O11_O16_seeded_sample", f"""
WITH {PATCH_SQL} SELECT {KEY_SQL} AS key FROM p WHERE split = 'val' ORDER BY md5('7:' || {KEY_SQL}), {KEY_SQL} LIMIT 500""")
def _(t):
    return sampling.sample(patches(t).filter("split = 'val'").select(KEY().alias("key")), F.col("key"), 500, seed=7)


@query("O12_proportional_cap", f"""
WITH {PATCH_SQL}, r AS (SELECT bucket, {KEY_SQL} AS key, row_number() OVER (PARTITION BY bucket ORDER BY md5('1337:' || {KEY_SQL}), {KEY_SQL}) AS i,
  count(*) OVER (PARTITION BY bucket) AS n, count(*) OVER () AS a FROM p)
SELECT bucket, key FROM r WHERE i <= CASE WHEN a <= 3000 THEN n ELSE greatest(CASE WHEN bucket = 'boundary' THEN 0 ELSE 1 END, floor(n * 3000.0::DOUBLE / a)) END""")
def _(t):
    return sampling.proportional_cap(patches(t).select("bucket", KEY().alias("key")), "bucket", F.col("key"), 3000)


@query("O13_O15_balanced_draw", f"""
WITH {PATCH_SQL}, q AS (SELECT bucket, {KEY_SQL} AS key, bucket = 'normal' AND tissue_frac > 0.9 AS hard FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket, hard ORDER BY md5('1337:' || key), key) AS i FROM q),
s AS (SELECT count(*) FILTER (bucket = 'tumor') AS np, count(*) FILTER (bucket = 'normal') AS nn, count(*) FILTER (bucket = 'boundary') AS nb, count(*) FILTER (hard) AS nh FROM q),
d AS (SELECT *, least(nh, floor(np * 3 * 0.15::DOUBLE)) AS dh, floor(np * 0.1::DOUBLE) AS db FROM s),
c AS (SELECT key, bucket, CASE WHEN bucket = 'tumor' THEN 1 WHEN hard THEN (i <= dh)::INT
  WHEN bucket = 'normal' THEN floor((np * 3 - dh) / greatest(nn - nh, 1)) + (i <= (np * 3 - dh) % greatest(nn - nh, 1))::INT
  ELSE floor(db / greatest(nb, 1)) + (i <= db % greatest(nb, 1))::INT END AS copies FROM r, d)
SELECT key, bucket, copies::BIGINT AS copies FROM c WHERE copies > 0""")
def _(t):
    p = patches(t).select("bucket", KEY().alias("key"), "tissue_frac")
    d = sampling.balanced_draw(p, "bucket", F.col("key"), hard=F.col("tissue_frac") > 0.9)
    return d.select("key", "bucket", "copies")


@query("O18_ordering", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS place FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).cast("long").alias("place"))


@query("O19_early_stop", """
WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events),
b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY epoch) AS best FROM e),
s AS (SELECT *, max(CASE WHEN value = best AND value > coalesce(prev, -1) THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS pos
      FROM (SELECT *, lag(best) OVER (PARTITION BY user_id ORDER BY epoch) AS prev FROM b))
SELECT user_id, coalesce(min(epoch) FILTER (epoch - pos >= 8), max(epoch)) AS stop FROM s GROUP BY 1""")
def _(t):
    """The first epoch that is `patience` past the last improvement."""
    line = W.partitionBy("user_id").orderBy("epoch")
    e = t.events.select("user_id", "value", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("epoch"))
    b = e.withColumn("before", F.max("value").over(line.rowsBetween(W.unboundedPreceding, -1)))
    s = b.withColumn("at", F.max(F.when(F.col("value") > F.coalesce("before", F.lit(-1.0)), F.col("epoch"))).over(line))
    return s.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("epoch") - F.col("at") >= 8, F.col("epoch"))), F.max("epoch")).alias("stop"))


@query("O20_S20_shards")
def _(t):
    d = t.customer.groupBy("c_nationkey").agg(N().alias("n"))
    return sampling.shard_ids(d, "n", "c_nationkey", 200)


@query("O21_relabel", """
SELECT vec_id, label, dense_rank() OVER (ORDER BY first) AS new FROM (SELECT vec_id, label, min(vec_id) OVER (PARTITION BY label) AS first FROM embeddings)""")
def _(t):
    """Labels 1, 2, ... in the order of their first cells: ranked once a label, then joined back."""
    first = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("first"))
    ranks = first.select("label", F.dense_rank().over(W.orderBy("first")).cast("long").alias("new"))
    return t.embeddings.select("vec_id", "label").join(ranks, "label").select("vec_id", "label", "new")


@query("R30_jitter_copies", """
WITH c AS (SELECT p_partkey, j, p_size * 10 AS x, p_size * 20 AS y FROM part, range(1, 4) r(j))
SELECT p_partkey, j::INTEGER AS jitter, greatest(0, x + ('0x' || substr(md5('1337:x:' || p_partkey || ':' || j), 1, 8))::BIGINT % 257 - 128)::BIGINT AS x0,
  greatest(0, y + ('0x' || substr(md5('1337:y:' || p_partkey || ':' || j), 1, 8))::BIGINT % 257 - 128)::BIGINT AS y0 FROM c""")
def _(t):
    s = F.col("p_size").cast("long")
    return sampling.jittered(t.part.select("p_partkey", (s * 10).alias("x0"), (s * 20).alias("y0")), 3, key=F.col("p_partkey"))


@query("U1_U2_unions", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"))).distinct()
    return a.unionByName(t.nation.select(F.col("n_nationkey").alias("k")))


@query("U3_U4_intersect_except", """
SELECT k, 'both' AS side FROM (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT k, 'first' FROM (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    side = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("k"))
    a, r = side("A"), side("R")
    return a.intersect(r).withColumn("side", F.lit("both")).unionByName(a.subtract(r).withColumn("side", F.lit("first")))


@query("U5_mask_logic", """
SELECT count(*) FILTER (a OR b) AS either, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a FROM (SELECT l_discount > 0.05 AS a, l_tax > 0.04 AS b FROM lineitem)""")
def _(t):
    a, b = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    return t.lineitem.agg(F.count_if(a | b).alias("either"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"))
