"""Smaller operators on the relational tables: lookups, slices, tensors, text and status functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomweave.functions import cell as C
from atomweave.functions import linalg as L
from atomweave.functions import scalars as S
from atomweave.operators import documents as D
from atomweave.operators import lines
from atomweave.operators import metrics as M
from atomweave.operators import particles
from atomweave.operators.ranking import numbered
from atomweave.plans import workflow as W
from atomweave.sources.adapters import ATOMS_SQL, atoms, cube_cells, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "f2_filter_source",
    f"""WITH atoms AS ({ATOMS_SQL}), v AS (SELECT l_orderkey * 8 + l_linenumber AS id, max_by(l_quantity, l_suppkey * 1000 + l_quantity) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT a.id, 'x' AS property FROM atoms a LEFT JOIN v USING (id) WHERE CAST(coalesce(v.x, 0) AS FLOAT) >= 4e1 UNION ALL SELECT id, 'Z' FROM atoms WHERE CAST(CAST(z AS FLOAT) AS DOUBLE) >= 1.9e1""",
)
def f2(spark, sf_dir):
    """A property is a modifier's column if it has one of that name (``x``, which the dump has too), else the dump's, in any case (``Z``)."""
    a = atoms(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    values = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") * 1000 + F.col("l_quantity")).alias("ordinal"), F.lit("x").alias("name"), F.col("l_quantity").alias("value"))
    out = []
    for name, bound in (("x", 40.0), ("Z", 19.0)):
        rows, column = particles.filter_source(a, values, name)
        out.append(rows.where(particles.predicate(F.col(column), ">=", bound)).select("id", F.lit(name).alias("property")))
    return out[0].unionByName(out[1])


@query("f11_selected_frame", f"WITH atoms AS ({ATOMS_SQL}) SELECT id, frame FROM atoms WHERE frame = 1996")
def f11(spark, sf_dir):
    return atoms(spark, sf_dir, 1996).select("id", F.col("frame").cast("long").alias("frame"))


@query("f12_if_statement", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def f12(spark, sf_dir):
    """Conditions on constants are decided on the driver and pick the branch; the branch is a plan."""
    taken = W.decide([{"left": "{{ a.k }}", "operator": "!=", "right": "2"}, {"left": "true", "operator": "==", "right": True, "join": "OR"}], {"a": {"k": 2}})
    o = table(spark, sf_dir, "orders")
    return (o.where((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT")) if taken else o.limit(0)).select("o_orderkey")


@query("f15_id_or_slug", "SELECT p_partkey FROM part WHERE CAST(p_partkey AS VARCHAR) = '7' OR regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '7'")
def f15(spark, sf_dir):
    return table(spark, sf_dir, "part").where((F.col("p_partkey").cast("string") == "7") | (S.slugify(F.col("p_name")) == "7")).select("p_partkey")


@query("p4_template_reference", "SELECT n_nationkey, n_name AS value FROM nation")
def p4(spark, sf_dir):
    path = W.interpolate("{{ node.column }}", {"node": {"column": "n_name"}})
    return table(spark, sf_dir, "nation").select("n_nationkey", F.col(path).alias("value"))


@query("p5_interpolation", "SELECT n_nationkey, 'nation ' || n_name || ' of ' || n_regionkey || '!' AS label FROM nation")
def p5(spark, sf_dir):
    tail = W.interpolate("{{ a.missing }}!", {"a": {}})
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("nation "), "n_name", F.lit(" of "), "n_regionkey", F.lit(tail)).alias("label"))


@query("p13_computed_projection", "SELECT vec_id, 'cna' AS mode, embedding[1] AS head, label AS label_id FROM embeddings")
def p13(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("ref", F.struct(F.col("label").alias("_id"), F.lit("x").alias("name")))
    return e.select("vec_id", F.lit("cna").alias("mode"), F.get("embedding", F.lit(0)).alias("head"), F.col("ref._id").alias("label_id"))


@query("u1_union_series", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def u1(spark, sf_dir):
    one = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    two = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))
    return one.unionByName(two)


@query("u3_members_but_self", "WITH m AS (SELECT n_regionkey, list_sort(list_distinct(list_concat([100 + n_regionkey], list(n_nationkey)))) AS m FROM nation GROUP BY 1) SELECT n_regionkey, array_to_string(list_filter(m, lambda x: x <> n_regionkey), ',') AS members FROM m")
def u3(spark, sf_dir):
    g = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("m"))
    members = F.array_sort(F.array_union(F.array(F.lit(100) + F.col("n_regionkey")), F.col("m")))
    return g.select("n_regionkey", F.array_join(F.filter(members, lambda x: x != F.col("n_regionkey")).cast("array<string>"), ",").alias("members"))


@query("j12_two_step_paths", "WITH e AS (SELECT DISTINCT c_nationkey AS a, o_custkey % 25 AS b FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey <> o_custkey % 25), p AS (SELECT x.a, y.b, min(abs(x.a - x.b) + abs(y.a - y.b)) AS d FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b GROUP BY 1, 2) SELECT CAST(a AS BIGINT) AS a, b, CAST(min(d) AS BIGINT) AS distance FROM (SELECT a, b, abs(a - b) AS d FROM e UNION ALL SELECT * FROM p) GROUP BY 1, 2")
def j12(spark, sf_dir):
    """Shortest transition between clusters over at most one other."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    e = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").cast("long").alias("a"), (F.col("o_custkey") % 25).alias("b")).where("a <> b").distinct()
    e = e.withColumn("d", F.abs(F.col("a") - F.col("b")))
    two = e.select("a", F.col("b").alias("m"), F.col("d").alias("d1")).join(e.select(F.col("a").alias("m"), "b", F.col("d").alias("d2")), "m").where("a <> b")
    return e.unionByName(two.select("a", "b", (F.col("d1") + F.col("d2")).alias("d"))).groupBy("a", "b").agg(F.min("d").alias("distance"))


@query("j14_metrics_with_counts", "WITH l AS (SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY 1), n AS (SELECT o_custkey % 150 AS user_id, count(*) AS n FROM orders GROUP BY 1) SELECT l.user_id, l.value, coalesce(n.n, 0) AS analyses FROM l LEFT JOIN n USING (user_id)")
def j14(spark, sf_dir):
    latest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "ts").alias("value"))
    counts = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 150).alias("user_id")).agg(F.count("*").alias("n"))
    return latest.join(counts, "user_id", "left").select("user_id", "value", F.coalesce("n", F.lit(0)).alias("analyses"))


@query("a10_grain_table", "SELECT l_suppkey AS grain, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS place FROM lineitem GROUP BY 1 HAVING count(*) >= 20")
def a10(spark, sf_dir):
    grains = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("grain")).agg(F.count("*").alias("size")).where("size >= 20")
    return numbered(grains, [F.desc("size"), F.col("grain")], "place")


@query("a13_circuit_statistics", "WITH c AS (SELECT l_orderkey, count(*) AS edges, count(*) < 2 AS dangling, bool_or(l_returnflag = 'R') AS blocked FROM lineitem GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (WHERE dangling) AS dangling, count(*) FILTER (WHERE blocked) AS blocked, round(avg(edges), 6) AS mean_edges, min(edges) AS min_edges, max(edges) AS max_edges FROM c")
def a13(spark, sf_dir):
    """Orders as circuits of their lines: dangling with one alone, blocked by a returned one."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("edges"), (F.count("*") < 2).alias("dangling"), F.bool_or(F.col("l_returnflag") == "R").alias("blocked"))
    return lines.circuit_statistics(c).withColumn("mean_edges", F.round("mean_edges", 6))


@query("o4_chunked_page", "WITH n AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) SELECT conv_id, ordinal, total FROM n WHERE ordinal >= 2 AND ordinal < 4")
def o4(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("rows"))
    return c.select("conv_id", F.posexplode("rows").alias("ordinal", "r"), F.size("rows").cast("long").alias("total")).where("ordinal >= 2 and ordinal < 4").select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), "total")


@query("o7_k_smallest", "SELECT vec_id, round(list_sum(list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))[1:3]), 6) AS low3 FROM embeddings")
def o7(spark, sf_dir):
    low = F.slice(F.array_sort(F.col("embedding").cast("array<double>")), 1, 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(low, F.lit(0.0), lambda a, x: a + x), 6).alias("low3"))


@query("o8_rank_by_size", "SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS cluster FROM orders GROUP BY 1")
def o8(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"))
    return numbered(sizes, [F.desc("size"), F.col("o_custkey")], "cluster").select("o_custkey", "cluster")


@query("o9_latest_sample", "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def o9(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    return e.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"))


@query("o12_last_labels", "WITH l AS (SELECT DISTINCT year(o_orderdate) * 100 + month(o_orderdate) AS label FROM orders ORDER BY 1 DESC LIMIT 12) SELECT array_to_string(list_sort(list(label)), ',') AS labels FROM l")
def o12(spark, sf_dir):
    labels = table(spark, sf_dir, "orders").select((F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("label")).distinct()
    last = labels.agg(F.array_sort(F.collect_list("label")).alias("l")).select(F.slice("l", F.greatest(F.size("l") - 11, F.lit(1)), F.lit(12)).alias("l"))
    return last.select(F.array_join(F.col("l").cast("array<string>"), ",").alias("labels"))


@query("t4_vector_text", "SELECT vec_id, '[' || printf('%.3f', CAST(embedding[1] AS DOUBLE)) || ' ' || printf('%.3f', CAST(embedding[2] AS DOUBLE)) || ' ' || printf('%.3f', CAST(embedding[3] AS DOUBLE)) || ']' AS t FROM embeddings")
def t4(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", S.vector_text(F.slice(F.col("embedding").cast("array<double>"), 1, 3)).alias("t"))


@query("t6_client_ip", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id WHEN event_id % 3 = 1 THEN '10.1.0.1' ELSE '127.0.0.1' END AS ip FROM events")
def t6(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), "user_id", F.lit(", 1.1.1.1")))
    real = F.when(F.col("event_id") % 3 == 1, F.lit("10.1.0.1"))
    return e.select("event_id", S.client_ip(forwarded, real, F.lit(None).cast("string"), F.lit("127.0.0.1")).alias("ip"))


@query("t8_lenient_numbers", "SELECT event_id, coalesce(TRY_CAST(replace(event_type, 'view', '12.5') AS DOUBLE), 0) AS v FROM events")
def t8(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.regexp_replace("event_type", "view", "12.5").try_cast("double"), F.lit(0.0)).alias("v"))


@query("d1_calendar_keys", "SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month FROM orders")
def d1(spark, sf_dir):
    text = lambda c: c.cast("date").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", text(S.week_key(F.col("o_orderdate"))).alias("week"), text(F.date_trunc("month", "o_orderdate")).alias("month"))


@query("d2_start_of_range", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - 365 AS VARCHAR) AS since FROM orders")
def d2(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_sub(F.col("o_orderdate").cast("date"), 365).cast("string").alias("since"))


@query("m1_reduced_coordinates", f"WITH atoms AS ({ATOMS_SQL}) SELECT id, round(x / 2e1, 6) AS s0, round(x / 2e1 * 2e1, 6) AS x FROM atoms")
def m1(spark, sf_dir):
    a = atoms(spark, sf_dir)
    placed = a.join(C.with_geometry(cube_cells(a)), "frame")
    s = C.reduced([F.col(c) for c in "xyz"])
    placed = placed.select("*", *[c.alias(f"s{i}") for i, c in enumerate(s)])
    back = C.absolute([F.col(f"s{i}") for i in range(3)])
    return placed.select("id", F.round("s0", 6).alias("s0"), F.round(back[0], 6).alias("x"))


_T = "CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d, CAST(embedding[5] AS DOUBLE) AS e, CAST(embedding[6] AS DOUBLE) AS f, CAST(embedding[7] AS DOUBLE) AS g, CAST(embedding[8] AS DOUBLE) AS h, CAST(embedding[9] AS DOUBLE) AS i"


@query("m4_determinant", f"WITH t AS (SELECT vec_id, {_T} FROM embeddings) SELECT vec_id, round(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g), 6) AS det, round(a * a + d * d + g * g, 6) AS xx FROM t")
def m4(spark, sf_dir):
    m = [F.get("embedding", F.lit(k)).cast("double") for k in range(9)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(L.det(m), 6).alias("det"), F.round(L.gram(m)[0], 6).alias("xx"))


_CELLS = [f"x{i}" for i in range(9)]


def _sql_minor(m: list[str]) -> str:
    return f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"


_COFACTORS = [f"({_CELLS[3 * ((i + 1) % 3) + (j + 1) % 3]} * {_CELLS[3 * ((i + 2) % 3) + (j + 2) % 3]} - {_CELLS[3 * ((i + 1) % 3) + (j + 2) % 3]} * {_CELLS[3 * ((i + 2) % 3) + (j + 1) % 3]})" for i in range(3) for j in range(3)]
_NEWTON = ", ".join(f"({x} + {c} / {_sql_minor(_CELLS)}) / 2" for x, c in zip(_CELLS, _COFACTORS))
_STRETCH = ", ".join(f"r{i} * a{j} + r{3 + i} * a{3 + j} + r{6 + i} * a{6 + j} AS {n}" for n, (i, j) in zip(("xx", "yy", "zz", "xy", "xz", "yz"), ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))))
_ROUND = lambda cols: ", ".join(f"round({c}, 4) + 0e0 AS {c}" for c in cols)


@query(
    "m4_affine_decomposition",
    f"""WITH RECURSIVE a AS (SELECT vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) + {float(i % 4 == 0)!r} AS a{i}' for i in range(9))} FROM embeddings),
n AS (SELECT vec_id, 0 AS k, {', '.join(f'a{i} AS x{i}' for i in range(9))} FROM a UNION ALL SELECT vec_id, k + 1, {_NEWTON} FROM n WHERE k < 40),
q AS (SELECT a.*, CAST(sign({_sql_minor(_CELLS)}) AS DOUBLE) AS sign, {', '.join(f'x{i} AS r{i}' for i in range(9))} FROM n JOIN a USING (vec_id) WHERE k = 40),
s AS (SELECT *, {_STRETCH} FROM q), t AS (SELECT *, (xx + yy + zz) / 3 AS m FROM s),
u AS (SELECT *, sqrt((pow(xx - m, 2) + pow(yy - m, 2) + pow(zz - m, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM t),
e AS (SELECT *, acos(greatest(-1, least(1, {_sql_minor(['(xx - m)', 'xy', 'xz', 'xy', '(yy - m)', 'yz', 'xz', 'yz', '(zz - m)'])} / (2 * p * p * p)))) / 3 AS w FROM u),
d AS (SELECT *, m + 2 * p * cos(w) AS k1, m + 2 * p * cos(w - 2 * pi() / 3) AS k2, m + 2 * p * cos(w + 2 * pi() / 3) AS k3,
  sqrt(greatest(0, 1 + sign * (r0 + r4 + r8))) / 2 AS turn FROM e)
SELECT vec_id, sign, {_ROUND(['turn', 'xx', 'yy', 'zz', 'xy', 'xz', 'yz', 'k1', 'k2', 'k3'])} FROM d""",
)
def m4_affine(spark, sf_dir):
    """Vectors as deformations, nine components added to the identity: orientation, real part of the rotation, stretch, scaling."""
    m = [F.get("embedding", F.lit(k)).cast("double") + float(k % 4 == 0) for k in range(9)]
    told = L.affine_decomposition(table(spark, sf_dir, "embeddings"), m, [F.lit(0.0)] * 3)
    near = lambda c, i: F.round(F.get(c, F.lit(i)), 4) + 0.0
    parts = [near("stretch", i).alias(n) for i, n in enumerate(("xx", "yy", "zz", "xy", "xz", "yz"))] + [near("scaling", i).alias(f"k{i + 1}") for i in range(3)]
    return told.select("vec_id", "sign", near("rotation", 3).alias("turn"), *parts)


_FOUR = [f"CAST(embedding[{k + 1}] AS DOUBLE)" for k in range(16)]
_MINOR4 = lambda i, j: _sql_minor([f"m{4 * r + c}" for r in range(4) if r != i for c in range(4) if c != j])


@query(
    "m4_four_by_four",
    f"""WITH t AS (SELECT vec_id, {', '.join(f'{x} AS m{k}' for k, x in enumerate(_FOUR))} FROM embeddings), d AS (SELECT *, {' '.join(f"{'-' if j % 2 else '+'} m{j} * {_MINOR4(0, j)}" for j in range(4))} AS det FROM t)
SELECT vec_id, round(det * 1e3, 6) + 0e0 AS det, {', '.join(f"round({'-' if (i + j) % 2 else ''}{_MINOR4(j, i)} * 1e3, 6) + 0e0 AS c{i}{j}" for i in range(4) for j in range(4))} FROM d""",
)
def m4_four(spark, sf_dir):
    """Determinants of 4x4 matrices and the adjugates that their inverses come from, in thousandths."""
    m = [F.get("embedding", F.lit(k)).cast("double") for k in range(16)]
    d, back = L.det4(m), L.inverse4(m)
    parts = [(F.round(back[4 * i + j] * d * 1e3, 6) + 0.0).alias(f"c{i}{j}") for i in range(4) for j in range(4)]
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(d * 1e3, 6) + 0.0).alias("det"), *parts)


@query("m7_gram_tensor", f"WITH t AS (SELECT vec_id, {_T} FROM embeddings) SELECT vec_id, round(a * a + d * d + g * g, 6) AS xx, round(b * b + e * e + h * h, 6) AS yy, round(c * c + f * f + i * i, 6) AS zz, round(a * b + d * e + g * h, 6) + 0e0 AS xy, round(a * c + d * f + g * i, 6) + 0e0 AS xz, round(b * c + e * f + h * i, 6) + 0e0 AS yz FROM t")
def m7_gram(spark, sf_dir):
    m = [F.get("embedding", F.lit(k)).cast("double") for k in range(9)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *[(F.round(v, 6) + 0.0).alias(n) for v, n in zip(L.gram(m), ("xx", "yy", "zz", "xy", "xz", "yz"))])


@query("m9_edge_weight", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount < 1e-5 THEN 1 ELSE exp(-(l_discount * 20) * (l_discount * 20) / 3e0) END, 6) AS w FROM lineitem")
def m9(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(L.graph_weight(F.col("l_discount") * 20), 6).alias("w"))


@query("m10_harmonic_mean", "SELECT p_partkey, round(2e0 / (1e0 / p_size + 1e0 / p_retailprice), 6) AS h FROM part")
def m10(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(L.harmonic_mean(F.col("p_size"), F.col("p_retailprice")), 6).alias("h"))


@query("q1_array_functions", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, CAST(len(list(event_type)) AS BIGINT) AS n FROM events GROUP BY 1")
def q1(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("l"))
    return g.select("user_id", F.array_join(F.array_sort(F.array_distinct("l")), ",").alias("kinds"), F.size("l").cast("long").alias("n"))


@query("q3_json_round_trip", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k FROM events")
def q3(spark, sf_dir):
    parsed = F.from_json("props", "k long")
    text = F.to_json(F.struct((parsed["k"] + 1).alias("k")))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(text, "k long")["k"].alias("k"))


@query("s13_virtual_listing", "SELECT source || '/' || lang AS path, count(*) AS files FROM documents GROUP BY 1")
def s13(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"))
    return paths.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.count("*").alias("files"))


@query("k7_cell_document", f"WITH atoms AS ({ATOMS_SQL}), n AS (SELECT frame, 1e1 + frame % 7 AS size FROM atoms GROUP BY frame) SELECT frame, round(pow(size, 3), 6) AS volume, round(size, 6) AS len_a, 9e1 AS alpha, round(1 / size, 6) AS reciprocal FROM n")
def k7(spark, sf_dir):
    """A cube for each frame as a document, and what reading it back gives."""
    frames = atoms(spark, sf_dir).select("frame").distinct()
    edge = lambda i: F.array(*[F.when(F.lit(k == i), 10.0 + F.col("frame") % 7).otherwise(0.0) for k in range(3)])
    cells = frames.select("frame", edge(0).alias("a"), edge(1).alias("b"), edge(2).alias("c"), F.array(*[F.lit(0.0)] * 3).alias("origin"), F.array(*[F.lit(True)] * 3).alias("pbc"))
    fields = {**C.lengths_and_angles(), **C.reciprocal()}
    written = C.with_geometry(cells).select("frame", F.to_json(F.struct("volume", *[v.alias(k) for k, v in fields.items()])).alias("document"))
    read = F.from_json("document", "volume double, len_a double, alpha double, reciprocal_a array<double>")
    told = {"volume": read["volume"], "len_a": read["len_a"], "alpha": read["alpha"], "reciprocal": F.get(read["reciprocal_a"], F.lit(0))}
    return written.select("frame", *[F.round(v, 6).alias(k) for k, v in told.items()])


@query("r3_recent_history", "SELECT user_id, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1")
def r3(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.where(F.col("ts") > last.scalar() - F.expr("interval 1 day")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("r11_entity_status", "WITH s AS (SELECT user_id, bool_or(event_type = 'view') AS busy FROM events GROUP BY 1) SELECT c_custkey, CASE WHEN busy THEN 'running' ELSE 'completed' END AS status FROM customer LEFT JOIN s ON user_id = c_custkey")
def r11(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.bool_or(F.col("event_type") == "view").alias("busy"))
    joined = table(spark, sf_dir, "customer").join(s, "c_custkey", "left")
    return joined.select("c_custkey", F.when(F.coalesce("busy", F.lit(False)), "running").otherwise("completed").alias("status"))


@query("w5_latest_per_user", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w5u(spark, sf_dir):
    return M.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")
