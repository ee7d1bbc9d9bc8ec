"""Joins, aggregates, windows and set operations over the order tables, and the manifest's upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import manifest
from ..sources.tables import CHUNKS_SQL, chunks, table
from .registry import query


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def join_inner(spark, sf_dir):
    c, n, r = _t(spark, sf_dir, "customer", "nation", "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.coalesce(F.round(F.sum("o_totalprice"), 2), F.lit(0.0)).alias("total"))


@query("SELECT coalesce(a.n, b.n) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS n, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS n, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.n = b.n")
def join_full_outer(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer", "supplier")
    a = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full_outer").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def join_semi(spark, sf_dir):
    p, l = _t(spark, sf_dir, "part", "lineitem")
    return p.join(l.filter("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT a.l_orderkey, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1")
def join_theta_ordered(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    a, b = l.alias("a"), l.alias("b")
    return a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber"))).groupBy(F.col("a.l_orderkey").alias("l_orderkey")).agg(F.count("*").alias("pairs"))


@query("SELECT n_regionkey, count(*) AS pairs FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey <> b.n_nationkey GROUP BY 1")
def join_self(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    other = n.select("n_regionkey", F.col("n_nationkey").alias("other"))
    return n.join(other, "n_regionkey").filter("n_nationkey <> other").groupBy("n_regionkey").agg(F.count("*").alias("pairs"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, count(*) AS n FROM lineitem GROUP BY 1, 2")
def aggregate_pricing(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.min("l_quantity").alias("min_qty"), F.max("l_quantity").alias("max_qty"), F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def aggregate_having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 12")


@query("SELECT c_mktsegment, sum((c_acctbal < 0)::INT)::BIGINT AS negative, sum((c_acctbal > 5000)::INT)::BIGINT AS rich, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def aggregate_conditional(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy("c_mktsegment").agg(F.sum((F.col("c_acctbal") < 0).cast("long")).alias("negative"), F.sum((F.col("c_acctbal") > 5000).cast("long")).alias("rich"), F.countDistinct("c_nationkey").alias("nations"))


@query("SELECT coalesce(source, 'ALL') AS source, coalesce(lang, 'ALL') AS lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def aggregate_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.rollup("source", "lang").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("ALL")).alias("source"), F.coalesce("lang", F.lit("ALL")).alias("lang"), "n")


@query("SELECT source, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs, min(doc_id) AS first_doc FROM documents GROUP BY source")
def aggregate_collect(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), "|").alias("langs"), F.min("doc_id").alias("first_doc"))


@query("SELECT o_orderkey, o_custkey, r FROM (SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INT AS r FROM orders) WHERE r <= 3")
def window_topk(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("r")).filter("r <= 3")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type)::INT AS kind, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")
def window_running(spark, sf_dir):
    u = Window.partitionBy("user_id")
    w = u.orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running"), F.dense_rank().over(u.orderBy("event_type")).alias("kind"), F.first("event_type").over(w).alias("first_type"), F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS around FROM events")
def window_rows_frame(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-1, 1)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("around"))


@query("SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events) GROUP BY user_id, event_type, island")
def window_islands(spark, sf_dir):
    run = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("island", run).groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).drop("island")


@query("SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("n")).union(s.select("s_nationkey")).distinct()


@query("SELECT l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_intersect(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p")).intersect(l.filter("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT p_partkey AS p FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_except(spark, sf_dir):
    p, l = _t(spark, sf_dir, "part", "lineitem")
    return p.select(F.col("p_partkey").alias("p")).subtract(l.filter("l_returnflag = 'R'").select("l_partkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def sort_topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT coalesce(source, '') AS source, array_to_string(list_sort(list(DISTINCT lang)), '|') AS langs FROM documents GROUP BY 1")
def distinct_in_order(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("lang"))), "|").alias("langs"))


@query("SELECT user_id AS entry_id, arg_max(event_type, (ts, event_id)) AS status, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY 1")
def manifest_last_wins(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("entry_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return manifest.latest(log)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def manifest_antijoin(spark, sf_dir):
    return manifest.not_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def incremental_since_watermark(spark, sf_dir):
    return manifest.since(table(spark, sf_dir, "events"), "ts", "2 days").select("event_id")


@query(f"WITH {CHUNKS_SQL}, h AS (SELECT chunk_id, paper_id, sha256(chunk_text) AS h FROM chunks) SELECT chunk_id, row_number() OVER (PARTITION BY paper_id, h ORDER BY chunk_id) > 1 AS duplicate FROM h")
def duplicate_chunk_flags(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("h", F.sha2("chunk_text", 256))
    return c.select("chunk_id", (F.row_number().over(Window.partitionBy("paper_id", "h").orderBy("chunk_id")) > 1).alias("duplicate"))


@query("SELECT item_id, count(doc_id) AS documents FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def known_items(spark, sf_dir):
    from ..operators.contain import containing

    b, d = _t(spark, sf_dir, "benchmark", "documents")
    hits = containing(d.select(F.col("doc_id").alias("id"), "text"), b.select(F.col("item_id").alias("item"), F.col("text").alias("passage")))
    return b.select(F.col("item_id")).join(hits.groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents")), "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"))
