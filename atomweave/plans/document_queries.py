"""Document, listing and metric queries on the relational tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.functions import scalars as S
from atomweave.operators import documents as D
from atomweave.operators import metrics as M
from atomweave.operators.ranking import numbered
from atomweave.sources.adapters import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("p1_select_fields", "SELECT o_orderkey, o_totalprice FROM orders")
def p1(spark, sf_dir):
    return D.select_fields(table(spark, sf_dir, "orders"), "o_orderkey, o_totalprice, missing")


@query("p2_allowed_fields", "SELECT c_custkey, c_mktsegment FROM customer")
def p2(spark, sf_dir):
    return D.allowed_fields(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_custkey", "__proto__"])


@query("p3_dotted_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def p3(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("p6_wildcard_expansion", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS BIGINT) AS \"status F\", CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS BIGINT) AS \"status O\", CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS BIGINT) AS \"status P\" FROM orders GROUP BY o_custkey")
def p6(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    maps = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("status"))
    return D.expand_map(maps, "status", "status", ["F", "O", "P"])


@query("p7_remove_arrays", "SELECT vec_id, label FROM embeddings")
def p7(spark, sf_dir):
    return D.remove_arrays(table(spark, sf_dir, "embeddings"))


@query("p8_vector_components", "SELECT vec_id, embedding[1] AS \"embedding x\", embedding[2] AS \"embedding y\", embedding[3] AS \"embedding z\" FROM embeddings")
def p8(spark, sf_dir):
    from atomweave.operators.particles import flatten_vector

    return flatten_vector(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", ["x", "y", "z"])


@query("p9_null_to_zero", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def p9(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", D.numeric_default(F.col("quality"), "int").alias("quality"))


@query("p10_present_columns", "SELECT column_name FROM (SELECT unnest(['quality', 'toxic']) AS column_name)")
def p10(spark, sf_dir):
    df = table(spark, sf_dir, "labels").withColumn("nothing", F.lit(None).cast("int"))
    return spark.createDataFrame([(c,) for c in D.present_columns(df, ["doc_id"])], "column_name string")


@query("p11_flat_rows", "SELECT c_custkey, c_name, c_nationkey AS nation, c_acctbal AS balance FROM customer")
def p11(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit("x").alias("c_name"), F.struct("c_name", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")).alias("row"))
    return D.flat_rows(c, ["c_custkey", "c_name"], "row")


@query("f6_equal_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def f6(spark, sf_dir):
    return D.equal_filters(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": 1}, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey")


@query("f7_text_search", r"""WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS words FROM documents), s AS (SELECT doc_id, len(list_intersect(words, ['license', 'mit', 'password'])) AS score FROM w) SELECT doc_id, CAST(score AS INT) AS score FROM s WHERE score > 0""")
def f7(spark, sf_dir):
    return D.text_search(table(spark, sf_dir, "documents"), ["text"], "License MIT password").select("doc_id", "score")


@query("f8_substring", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '#0000001') OR contains(lower(c_mktsegment), '#0000001')")
def f8(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(D.contains_any(["c_name", "c_mktsegment"], "#0000001")).select("c_custkey")


@query("f9_membership", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3))")
def f9(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where(F.col("c_nationkey").isin(1, 2, 3)).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("f10_predicates", "SELECT event_id FROM events WHERE (event_type = 'error' OR value > 9e1) AND event_type <> 'view' AND props IS NOT NULL")
def f10(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(((F.col("event_type") == "error") | (F.col("value") > 90.0)) & (F.col("event_type") != "view") & F.col("props").isNotNull()).select("event_id")


@query("f14_time_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def f14(spark, sf_dir):
    since = F.date_sub(F.lit("2024-01-31").cast("date"), 10).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where(F.col("ts") >= since).select("event_id")


@query("o1_multi_key_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_totalprice, o_orderkey) AS place FROM orders")
def o1(spark, sf_dir):
    """The whole order, by its numbers."""
    return numbered(table(spark, sf_dir, "orders"), D.sort_keys("-o_orderdate,o_totalprice", "o_orderkey"), "place").select("o_orderkey", "place")


@query("o2_offset_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200")
def o2(spark, sf_dir):
    return D.page(D.sort_by(table(spark, sf_dir, "orders"), "-o_orderdate", "o_orderkey"), 3).select("o_orderkey", "o_orderdate")


@query("o3_keyset_page", "SELECT event_id, user_id FROM events WHERE user_id > 40 OR (user_id = 40 AND event_id > 500) ORDER BY user_id, event_id LIMIT 51")
def o3(spark, sf_dir):
    return D.keyset_page(table(spark, sf_dir, "events"), (40, 500), 50, keys=("user_id", "event_id")).select("event_id", "user_id")


@query("o5_client_sort", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer")
def o5(spark, sf_dir):
    from atomweave.operators.ranking import numbered

    return numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [*D.client_sort("c_acctbal"), F.col("c_custkey")], "place").select("c_custkey", "place")


@query("o13_history_page", "SELECT * FROM (SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 50 OFFSET 50) ORDER BY conv_id, turn")
def o13(spark, sf_dir):
    newest = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").orderBy(F.desc("conv_id"), F.desc("turn")).offset(50).limit(50)
    return newest.orderBy("conv_id", "turn")


@query("j7_populate", "SELECT o.o_orderkey, c.c_name AS name, c.c_nationkey AS nation FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def j7(spark, sf_dir):
    joined = D.populate(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "customer", ["c_name", "c_nationkey"])
    return joined.select("o_orderkey", F.col("customer.c_name").alias("name"), F.col("customer.c_nationkey").alias("nation"))


@query("j8_lookup_chain", "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def j8(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j9_missing_results", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j9(spark, sf_dir):
    """Orders without a returned line."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("j10_frame_exposures", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), k AS (SELECT DISTINCT event_type FROM events), n AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT CAST(d.day AS VARCHAR) AS day, k.event_type, coalesce(n.n, 0) AS n FROM d CROSS JOIN k LEFT JOIN n ON n.day = d.day AND n.event_type = k.event_type")
def j10(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "event_type")
    every = e.select("day").distinct().crossJoin(e.select("event_type").distinct())
    counts = e.groupBy("day", "event_type").agg(F.count("*").alias("n"))
    same = every["day"].eqNullSafe(counts["day"]) & every["event_type"].eqNullSafe(counts["event_type"])
    return every.join(counts, same, "left").select(every["day"].cast("string").alias("day"), every["event_type"], F.coalesce("n", F.lit(0)).alias("n"))


@query("a18_daily_activity", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS activities, round(sum(value), 2) AS minutes FROM events GROUP BY 1")
def a18(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date"), F.array(F.struct("event_type", "user_id")).alias("activity"), F.col("value").alias("minutes_online"))
    return M.daily_activity(rows).select(F.col("date").cast("string").alias("day"), F.size("activity").cast("long").alias("activities"), F.round("minutes_online", 2).alias("minutes"))


@query("a19_sum_by_cluster", "SELECT coalesce(nullif(event_type, 'view'), 'main-cluster') AS event_type, CAST(sum(user_id) AS BIGINT) AS user_id FROM events GROUP BY 1")
def a19(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type")))
    return M.sum_by_cluster(e, "event_type", "user_id")


@query("a20_metric_buckets", """WITH b AS (SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-06-01') AS this_month, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-05-01' AND o_orderdate < TIMESTAMP '1997-06-01') AS last_month FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-20' GROUP BY 1)
SELECT *, CAST(CASE WHEN last_month = 0 THEN CASE WHEN this_month > 0 THEN 100 ELSE 0 END ELSE floor((this_month - last_month) * 1e2 / last_month + 5e-1) END AS BIGINT) AS change FROM b""")
def a20(spark, sf_dir):
    now = F.lit("1997-06-20").cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < now)
    return M.metric_buckets(o, "o_orderdate", F.lit("1997-06-20").cast("timestamp"), ["o_orderpriority"])


@query("a20_weekly_buckets", "WITH c AS (SELECT date_trunc('week', o_orderdate) AS week, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), l AS (SELECT DISTINCT week FROM c ORDER BY week DESC LIMIT 12) SELECT CAST(CAST(week AS DATE) AS VARCHAR) AS week, o_orderstatus, n FROM c WHERE week IN (SELECT week FROM l)")
def a20w(spark, sf_dir):
    w = M.weekly_counts(table(spark, sf_dir, "orders"), "o_orderdate", ["o_orderstatus"])
    return w.select(F.col("week").cast("date").cast("string").alias("week"), "o_orderstatus", "n")


@query("a21_merge_series", "WITH a AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS orders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, count(*) AS lines FROM lineitem WHERE l_quantity > 49 GROUP BY 1) SELECT coalesce(a.day, b.day) AS day, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines FROM a FULL JOIN b ON a.day = b.day")
def a21(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("day")).agg(F.count("*").alias("v"))
    b = table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy(F.col("l_shipdate").cast("date").cast("string").alias("day")).agg(F.count("*").alias("v"))
    return M.merge_series([a, b], ["orders", "lines"], "day", "v")


@query("a22_distinct", "SELECT DISTINCT source, lang FROM documents")
def a22(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "lang").distinct()


@query("a23_page_info", "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 1e2)) AS BIGINT) AS total_pages FROM orders")
def a23(spark, sf_dir):
    return D.page_info(table(spark, sf_dir, "orders"))


_JOBS = "jobs AS (SELECT user_id * 10 + event_id % 10 AS job_id, user_id AS trajectory, event_id % 10 AS timestep, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'completed' ELSE 'running' END AS status, ts, event_id FROM events)"


def _jobs(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type").isin("purchase", "signup"), "completed").otherwise("running")
    return table(spark, sf_dir, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("job_id"), F.col("user_id").alias("trajectory"), (F.col("event_id") % 10).alias("timestep"), kind.alias("status"), "ts")


@query("a24_job_rollup", f"WITH {_JOBS}, l AS (SELECT job_id, arg_max(trajectory, ts) AS trajectory, arg_max(timestep, ts) AS timestep, arg_max(status, ts) AS status FROM jobs GROUP BY job_id) SELECT trajectory, timestep, count(*) AS n_jobs, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS status, count(*) FILTER (WHERE status = 'completed') AS n_done FROM l GROUP BY 1, 2")
def a24(spark, sf_dir):
    return M.job_rollup(_jobs(spark, sf_dir))


@query("a25_progress", "WITH t AS (SELECT o_custkey AS analysis, count(*) AS total FROM orders GROUP BY 1), d AS (SELECT o_custkey AS analysis, count(DISTINCT o_orderkey) AS completed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT t.analysis, total, coalesce(completed, 0) AS completed, coalesce(completed, 0) >= total AS finished FROM t LEFT JOIN d USING (analysis)")
def a25(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("analysis"), F.col("o_orderkey").alias("item"), "o_orderstatus")
    return M.progress(o.where("o_orderstatus = 'F'"), o.groupBy("analysis").agg(F.count("*").alias("total")), "analysis")


@query("a26_models_per_frame", "SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(['preview'], list(event_type)))), ',') AS models FROM events GROUP BY user_id")
def a26(spark, sf_dir):
    models = F.array_sort(F.array_union(F.array(F.lit("preview")), F.collect_set("event_type")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(models, ",").alias("models"))


@query("a28_median", "SELECT l_returnflag, median(l_extendedprice) AS median_price, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def a28(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.median("l_extendedprice").alias("median_price"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"))


@query("w3_percentage", "SELECT o_orderstatus, count(*) AS n, round(count(*) * 1e2 / sum(count(*)) OVER (), 6) AS percentage FROM orders GROUP BY 1")
def w3(spark, sf_dir):
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counts.select("*", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("percentage"))


@query("w4_counter_rates", "WITH s AS (SELECT *, lag(value) OVER w AS pv, lag(epoch_us(ts)) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, round(coalesce(greatest(0e0, CASE WHEN epoch_us(ts) = pt THEN NULL ELSE (value - pv) / ((epoch_us(ts) - pt) / 1e6) END), 0e0), 9) AS value_rate FROM s")
def w4(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return M.counter_rates(e, "user_id", "ts", ["value"]).select("event_id", F.round("value_rate", 9).alias("value_rate"))


@query("w5_latest_turn", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def w5(spark, sf_dir):
    return M.latest_per_key(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role")


@query("u2_set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u2(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("t1_slugify", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def t1(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.slugify(F.col("p_name")).alias("slug"))


@query("t5_name_parts", "SELECT event_id, CAST(event_id AS BIGINT) AS timestep, event_type AS model FROM events")
def t5(spark, sf_dir):
    step, model = S.raster_parts(F.concat("event_id", F.lit("_"), "event_type", F.lit(".png")))
    return table(spark, sf_dir, "events").select("event_id", step.alias("timestep"), model.alias("model"))


@query("t7_redact", "SELECT event_id, '[REDACTED]' AS token, event_type AS kind FROM events")
def t7(spark, sf_dir):
    m = S.redact(F.create_map(F.lit("accessToken"), F.col("props"), F.lit("kind"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(m, "accessToken").alias("token"), F.element_at(m, "kind").alias("kind"))


@query("d3_online_minutes", "WITH p AS (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM events) SELECT event_id, CAST(ceil((epoch_us(until) - epoch_us(ts)) / 6e7) AS BIGINT) AS minutes FROM p WHERE until IS NOT NULL")
def d3(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("until", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts"))).where("until is not null")
    return e.select("event_id", S.online_minutes(F.col("ts"), F.col("until")).alias("minutes"))


@query("d4_status", "SELECT event_id, CASE WHEN value >= 90 OR user_id >= 90 THEN 'Critical' WHEN value >= 75 OR user_id >= 75 THEN 'Warning' ELSE 'Healthy' END AS status FROM events")
def d4(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.server_status(F.col("value"), F.col("user_id"), F.lit(0)).alias("status"))


@query("k13_upsert", "SELECT o_orderkey, max(o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS o_totalprice, max(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END) AS version FROM orders GROUP BY 1")
def k13(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("version"))
    new = old.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("version"))
    return D.upsert(old, new, ["o_orderkey"], "version")


@query("k14_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def k14(spark, sf_dir):
    tables = {
        "customer": table(spark, sf_dir, "customer").withColumn("_id", F.col("c_custkey")),
        "orders": table(spark, sf_dir, "orders").withColumn("_id", F.col("o_orderkey")),
        "lineitem": table(spark, sf_dir, "lineitem").withColumn("_id", F.col("l_orderkey") * 8 + F.col("l_linenumber")),
    }
    left = D.cascade_delete(tables, [("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders")], "customer", tables["customer"].where("c_nationkey = 3"))
    return left["lineitem"].select("l_orderkey", "l_linenumber")


@query("s9_chunk_merge", "SELECT conv_id, count(*) AS n_texts, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def s9(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array("text").alias("texts"), F.create_map("role", "text").alias("last"), "role")
    m = D.merge_chunks(c, ["conv_id"], "turn", ["texts"], ["last"], ["role"])
    return m.select("conv_id", F.size("texts").cast("long").alias("n_texts"), "role")


@query("s12_prefix_sizes", "SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def s12(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@query("k9_chart_series", "SELECT vec_id, CAST(i AS INT) AS x, embedding[i] AS y FROM embeddings, (SELECT unnest([1, 2, 3]) AS i)")
def k9(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("xs"), F.slice("embedding", 1, 3).alias("ys"))
    return e.select("vec_id", F.inline(F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))))
