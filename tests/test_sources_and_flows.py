import datetime as dt

import pytest
from pyspark.sql import functions as F

from atomweave.functions import scalars
from atomweave.operators import documents, metrics
from atomweave.plans import workflow as W
from atomweave.sources import lammps
from atomweave.streaming import flows

DUMP = """ITEM: TIMESTEP
100
ITEM: NUMBER OF ATOMS
2
ITEM: BOX BOUNDS pp pp ff
0.0 4.0
0.0 4.0
0.0 4.0
ITEM: ATOMS id type x y z c_pe
7 2 0.5 1.0 1.5 -3.5
3 1 1.8 1.8 0.0 -3.25
ITEM: TIMESTEP
200
"""
SCALED = """ITEM: TIMESTEP
5
ITEM: NUMBER OF ATOMS
1
ITEM: BOX BOUNDS xy xz yz pp pp pp
0.0 5.0 1.0
0.0 4.0 0.0
0.0 4.0 0.0
ITEM: ATOMS xs ys zs
0.5 0.5 0.25"""
DATA = "made by hand\n\n2 atoms\n1 atom types\n\n0 3 xlo xhi\n0 3 ylo yhi\n0 3 zlo zhi\n\nAtoms # charge\n\n1 1 0.5 0.1 0.2 0.3\n2 1 -0.5 1 2 2.5\n"


def test_dump_and_data_files(spark, tmp_path):
    (tmp_path / "a.dump").write_text(DUMP)
    (tmp_path / "b.dump").write_text(SCALED.replace("\n", "\r\n"))
    (tmp_path / "c.data").write_text(DATA)
    (tmp_path / "d.dump").write_text(DUMP.replace("1.8 1.8 0.0", "1.8 oops 0.0"))
    (tmp_path / "e.txt").write_text("nothing of the kind\n")
    path = str(tmp_path)
    rows = {(r.file[-6:], r.ordinal): r for r in lammps.read_atoms(spark, path, ["c_pe"]).collect()}
    assert set(rows) == {("a.dump", 0), ("a.dump", 1), ("b.dump", 0), ("c.data", 0), ("c.data", 1)}
    a = rows["a.dump", 1]
    assert (a.id, a.type, a.x, a.y, a.z, a.props["c_pe"], a.timestep) == (3, 1, 1.8, 1.8, 0.0, -3.25, 100)
    b = rows["b.dump", 0]
    assert (b.id, b.type, b.x, b.y, b.z) == (1, 1, pytest.approx(2.5), pytest.approx(2.0), pytest.approx(1.0))
    assert (rows["c.data", 1].x, rows["c.data", 1].z) == (1.0, 2.5)
    meta = {r.file[-6:]: r for r in lammps.read_metadata(spark, path).collect()}
    assert meta["a.dump"].pbc == [True, True, False] and not meta["/e.txt"[-6:]].ok
    assert {r.file[-5:] for r in lammps.corrupt_files(spark, path).collect()} == {".dump", "e.txt"}
    loose = lammps.read_atoms(spark, path, permissive=True).where("file like '%d.dump' and ordinal = 1").first()
    assert loose.y == 0.0


def test_dump_round_trip(spark, tmp_path):
    atoms = spark.createDataFrame([(1, 1, 2, 0.25, 0.5, 1.0), (1, 2, 1, 3.0, 2.0, 1.5)], "frame int, id long, type int, x double, y double, z double")
    cells = spark.createDataFrame([(1, [4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0], [0.0] * 3, [True, True, False])], "frame int, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>")
    lammps.write_dump_text(atoms, cells).coalesce(1).sortWithinPartitions("frame", "place").select("value").write.text(str(tmp_path / "out"))
    back = lammps.read_atoms(spark, str(tmp_path / "out")).orderBy("id").collect()
    assert [(r.id, r.type, r.x, r.y, r.z) for r in back] == [(1, 2, 0.25, 0.5, 1.0), (2, 1, 3.0, 2.0, 1.5)]


def flow(edges, **kinds):
    return {"nodes": [{"id": k, **v} for k, v in kinds.items()], "edges": [{"source": s, "target": t, "sourceHandle": h} for s, t, h in edges]}


def test_order_cycles_and_branches():
    n = {"type": "schema"}
    diamond = flow([("a", "b", None), ("a", "c", None), ("b", "d", None), ("c", "d", None)], a=n, b=n, c=n, d=n)
    assert W.ordered(diamond) == ["a", "b", "c", "d"]
    loop = flow([("a", "b", None), ("b", "c", None), ("c", "b", None)], a=n, b=n, c=n)
    assert W.ordered(loop) == ["a"] and "cycle" in " ".join(W.problems(loop))
    assert W.reachable(diamond, "b") == {"d"} and W.reachable(diamond, "d", backwards=True) == {"a", "b", "c"}
    branch = flow([("i", "x", "true"), ("i", "y", "false"), ("y", "z", None)], i=n, x=n, y=n, z=n)
    assert W.reachable(branch, "i", "false") == {"y", "z"}


def test_conditions_and_references():
    values = {"n": {"mode": "2", "list": [{"k": True}]}}
    assert W.interpolate("{{ n.list.0.k }}", values) is True and W.interpolate("a {{n.mode}} {{n.nothing}}!", values) == "a 2 !"
    one = lambda left, right, op="==", join="AND": {"left": left, "operator": op, "right": right, "join": join}
    assert W.decide([], values) and W.decide([one("{{ n.mode }}", 2)], values) and W.decide([one("true", True)], values)
    assert W.decide([one(1, 2), one(1, 1, join="OR")], values) and not W.decide([one(1, 2), one(1, 1)], values)
    assert not W.loosely_equal("", 0) and W.loosely_equal("1.0", "1")
    assert W.bind_arguments([{"argument": "mic", "default": True}, {"argument": "k", "value": 4}], {"mic": False, "k": 9}) == {"mic": False, "k": 4}


def test_argument_strings():
    assert scalars.split_arguments("""--a 1 --b "two words" --c='x y' ''""") == ["--a", "1", "--b", "two words", "--c=x y", ""]


def test_keyset_pages_cover_every_row_once(spark):
    df = spark.createDataFrame([(i % 3, f"id{i:02d}") for i in range(25)], "timestep int, _id string")
    for descending in (False, True):
        seen, cursor = [], None
        while True:
            rows = documents.keyset_page(df, cursor, 4, descending).collect()
            seen += [tuple(r) for r in rows[:4]]
            if len(rows) <= 4:
                break
            cursor = seen[-1]
        assert seen == sorted(map(tuple, df.collect()), reverse=descending)


def test_documents(spark):
    df = spark.createDataFrame([(1, None, [1, 2], ("a", [1]))], "k int, v int, arr array<int>, s struct<p:string,q:array<int>>")
    assert documents.remove_arrays(df).columns == ["k", "v", "s"] and documents.present_columns(df, ["k"]) == ["arr", "s"]
    chunks = spark.createDataFrame([(1, 0, [1], {"a": 1, "b": 1}, None), (1, 1, [2, 3], {"b": 2}, "x"), (1, 2, None, None, None)], "k int, o int, l array<int>, m map<string,int>, s string")
    r = documents.merge_chunks(chunks, ["k"], "o", ["l"], ["m"], ["s"]).first()
    assert (r.l, r.m, r.s) == ([1, 2, 3], {"a": 1, "b": 2}, "x")
    assert [r[0] for r in spark.createDataFrame([("10",), ("9",), (None,), ("b",), ("A",)], "c string").orderBy(*documents.client_sort("c")).collect()] == [None, "9", "10", "A", "b"]


def test_percent_change_and_reactions(spark):
    pct = lambda a, b: spark.range(1).select(scalars.percent_change(F.lit(a), F.lit(b))).first()[0]
    assert [pct(0, 0), pct(3, 0), pct(1, 8), pct(9, 8)] == [0, 100, -87, 13]
    kind = "array<struct<emoji:string,users:array<string>>>"
    df = spark.createDataFrame([([("+", ["u", "v"]), ("-", ["w"])],)], f"r {kind}")
    toggled = lambda user, emoji: [tuple(x) for x in df.select(scalars.toggle_reaction(F.col("r"), F.lit(user), F.lit(emoji))).first()[0]]
    assert toggled("u", "+") == [("+", ["v"]), ("-", ["w"])]
    assert toggled("w", "+") == [("+", ["u", "v", "w"])]
    assert toggled("x", "*") == [("+", ["u", "v"]), ("-", ["w"]), ("*", ["x"])]


def test_job_rollup(spark):
    rows = [("j1", "t", 1, "running", 1), ("j1", "t", 1, "completed", 2), ("j2", "t", 1, "failed", 1), ("j3", "t", 2, "queued", 1)]
    out = metrics.job_rollup(spark.createDataFrame(rows, "job_id string, trajectory string, timestep int, status string, ts int"))
    assert {(r.timestep, r.status, r.n_done) for r in out.collect()} == {(1, "partial", 1), (2, "running", 0)}


def one_by_one(spark, tmp_path, batches, schema):
    """A stream that reads each batch in a trigger of its own."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))


def test_sessions_close_once(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 12, m)
    batches = [[("s", "done", 1, t(0)), ("t", "open", 1, t(1))], [("s", "open", 2, t(2))], [("s", "done", 1, t(3)), ("t", "done", 1, t(4)), ("u", "open", 1, t(5))]]
    source = one_by_one(spark, tmp_path, batches, "session_id string, kind string, count int, ts timestamp")
    run = flows.session_completions(source).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("sessions").collect())) == [("s", 2), ("t", 1)]


def test_silent_servers_expire(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 12, 0, s)
    batches = [[("a", t(0), 1.0), ("b", t(0), 5.0)], [("b", t(14), 6.0), ("b", t(2), 9.0)], [("b", t(40), 7.0)], [("b", t(41), 8.0)]]
    source = one_by_one(spark, tmp_path, batches, "server string, ts timestamp, value double")
    run = flows.latest_with_heartbeat(source).writeStream.format("memory").queryName("beats").outputMode("update").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    rows = [tuple(r) for r in spark.table("beats").collect()]
    assert ("a", 1.0, True) in rows and [r[1] for r in rows if r[0] == "b" and not r[2]][:2] == [5.0, 6.0]
    assert rows.count(("a", 1.0, True)) == 1


def test_status_feed_sends_the_snapshot_once_and_cuts_bursts(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "team string, job_id string, status string, ts timestamp"
    before = spark.createDataFrame([("x", "j0", "queued", t(0))], schema)
    batches = [[("x", "j0", "running", t(1)), ("x", "j0", "done", t(2))], [("y", f"k{i}", "done", t(10 + i)) for i in range(8)]]
    seen = []
    feed = flows.status_feed(before, lambda rows: seen.append(sorted((r.team, r.job_id, r.status, r.kind) for r in rows.collect())), most=5, keep=3)
    run = one_by_one(spark, tmp_path, batches, schema).writeStream.foreachBatch(feed).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert seen == [[("x", "j0", "queued", "snapshot")], [("x", "j0", "done", "change")], [("y", f"k{i}", "done", "change") for i in (5, 6, 7)]]
    seen.clear()
    again = flows.status_feed(before, lambda rows: seen.append([r.kind for r in rows.collect()]))  # a restart goes on with its own batch number
    again(before, 7)
    again(before, 8)
    assert seen == [["snapshot"], ["change"], ["change"]]


def test_parked_jobs_meet_their_upload(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    spark.createDataFrame([("j", "a", 1, t), ("k", "a", 2, t)], "job_id string, trajectory string, timestep int, job_ts timestamp").write.parquet(str(tmp_path / "jobs"))
    spark.createDataFrame([("a", 1, t + dt.timedelta(minutes=5))], "trajectory string, timestep int, upload_ts timestamp").write.parquet(str(tmp_path / "uploads"))
    stream = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    run = flows.ready_jobs(stream("jobs"), stream("uploads")).writeStream.format("memory").queryName("ready").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.job_id for r in spark.table("ready").collect()] == ["j"]
