import json
import pathlib
import random
import tempfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from obsflow.operators import sequence as q
from obsflow.sources import grids as g
from obsflow.sources import projects as s
from obsflow.streaming import stateful as st

KEY = ["k"]


def test_sample_grid_picks_the_latest_sample(sized):
    d = sized.createDataFrame([("x", 1, 0.5, "a"), ("x", 2, 1.5, "b"), ("x", 3, 4.0, "c")], "s string, i int, t double, v string")
    assert rows(g.sample_grid(d, ["s"], ["i"], "t", 1.0), "k", "grid_t", "v") == [
        (0, 0.0, None), (1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, "b")]
    assert [r[0] for r in rows(g.sample_grid(d, ["s"], ["i"], "t", 1.0, start=0.5, end=2.0), "grid_t")] == [0.5, 1.5]
    with pytest.raises(ValueError):
        g.sample_grid(d, ["s"], ["i"], "t", 1.0, start=3.0, end=2.0)


def test_tail_is_added_once(spark):
    d = spark.createDataFrame([("x", 2.2), ("y", 0.1)], "s string, d double")
    assert rows(g.tail_anchored_grid(d, "d", 1.0), "s", "t") == [("x", 0.0), ("x", 1.0), ("x", 2.0), ("y", 0.0)]


def test_documents_round_trip(sized):
    with tempfile.TemporaryDirectory(prefix="run-") as folder:
        line = {"path": "a.png", "time": 1.0, "view": 1}
        doc = {"version": 1, "title": "T", "source": "s", "region": {"left": 0, "top": 0, "right": 1, "bottom": 1}, "lines": [line] * 5, "warnings": ["Chord mode keeps original colors now"]}
        for name, text in (("good", json.dumps(doc)), ("old", json.dumps({**doc, "version": 2})), ("cut", json.dumps(doc)[:30])):
            with open(f"{folder}/{name}.json", "w") as f:
                f.write(text)
        head, lines, errors = s.read_projects(sized, folder)
        assert rows(head, "title", "notation", "bars_per_line", "warnings") == [("T", "staff", 0, [s.NEW_WARNING])]
        assert rows(lines, "seq", "included", "height_scale") == [(i, True, 1.0) for i in range(5)]
        assert sorted(r[0] for r in errors.select("error").collect()) == ["malformed", "unsupported version"]
        parts = s.project_parts(head.select("path_key", "title", "source", "region"), lines.select("path_key", "seq", "path", "time", "view"), ["path_key"], ["seq"], 2)
        text = "".join(r[0] for r in rows(parts, "text", "part", order=["part"]))
        back = json.loads(text)
        assert parts.count() == 5 and [x["seq"] for x in back["lines"]] == list(range(5)) and back["title"] == "T"


def test_bundles(spark):
    m = spark.createDataFrame([("b", n, 10) for n in ("project.json", "a.png", "../escape.png", "C:\\escape.png", "folder/image.png", "x.txt", "..")], "k string, entry string, size long")
    refs = spark.createDataFrame([("b", "a.png"), ("b", "lost.png")], "k string, entry string")
    got = rows(s.bundle_check(m, refs, KEY, "entry", "size", max_bytes=50), "rule", "entry")
    assert got == [("invalid path", ".."), ("invalid path", "../escape.png"), ("invalid path", "C:\\escape.png"), ("invalid path", "folder/image.png"),
                   ("missing image", "lost.png"), ("too large", None), ("unexpected file", "x.txt")]


def test_snapshots_of_half_written_jobs(spark):
    import os
    with tempfile.TemporaryDirectory(prefix="run-") as folder:
        for job, files in (("one", {"checkpoint.json": '{"bars": [1, 2]}', "review.json": "{}"}), ("two", {"checkpoint.json": '{"bars": [1'})):
            os.mkdir(f"{folder}/{job}")
            for n, text in files.items():
                with open(f"{folder}/{job}/{n}", "w") as f:
                    f.write(text)
        out = s.usage_snapshots(spark, f"{folder}/*")
        assert rows(out, "job", "saved_bars", "finished", "cancelled") == [("one", 2, True, False), ("two", 0, False, False)]
        with tempfile.TemporaryDirectory(prefix="run-") as other:
            seen = run(spark, s.usage_snapshots(spark, f"{folder}/*", streaming=True), other, "snapshots")
            assert rows(seen.filter("name = 'checkpoint.json'"), "job", "saved_bars") == [("one", 2), ("two", None)]


def test_rewritten_files_come_again(spark):
    with tempfile.TemporaryDirectory(prefix="run-") as folder:
        def put(job, name, text):
            path = pathlib.Path(folder, "jobs", job, name)
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
            return path

        def seen():
            return sorted(((r.job, r.name, r.saved_bars) for r in run(spark, s.usage_snapshots(spark, f"{folder}/jobs/*", streaming=True), folder, "seen").collect()), key=str)

        half = put("one", "checkpoint.json", '{"bars": [1')
        put("two", "checkpoint.json", '{"bars": []}')
        put("two", "_other", "hidden")
        first = [("one", "checkpoint.json", None), ("two", "checkpoint.json", 0)]
        assert seen() == first and seen() == first
        half.write_text('{"bars": [1, 2, 3]}')
        put("three", "review.json", "{}")
        assert set(seen()) == {*first, ("one", "checkpoint.json", 3), ("three", "review.json", None)}


def test_captures_continue_the_numbering(sized):
    old = sized.createDataFrame([("k", 1), ("k", 2)], "k string, seq long")
    new = sized.createDataFrame([("k", 5), ("k", 5), ("j", 1)], "k string, at int").withColumn("id", F.monotonically_increasing_id())
    assert rows(s.append_captures(new, KEY, ["at", "id"], old), "k", "seq", "view") == [("j", 1, 0), ("k", 3, 0), ("k", 4, 0)]


def feed(spark, folder, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def run(spark, df, folder, name):
    d = f"{folder}/{name}"
    w = df.writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/log").trigger(availableNow=True).start()
    w.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{d}/out")


def test_streams_match_the_stored_form(spark):
    schema = "k string, i int, t double, sig double, f string"
    values = [0, 0.02, 0.03, 1, 1, 1, 5, 0, 0, 0.05, 0.06, 2, 2, 2, 2]
    data = [("a", i, 1000.0 + i, float(v), "x" if v < 1 else "y") for i, v in enumerate(values)]
    # Out of order inside a trigger, in order between triggers.
    batches = [data[:4][::-1], data[4:9][::-1], data[9:], [("z", 99, 2000.0, 0.0, "x")], [("z", 100, 3000.0, 0.0, "x")]]
    with tempfile.TemporaryDirectory(prefix="run-") as folder:
        src = feed(spark, folder, batches, schema).withColumn("at", F.timestamp_seconds("t"))
        views = st.stable_views_stream(src, KEY, ["i"], "t", "sig", 0.035, 1.0, event_time="at", watermark="1 second", idle_ms=60_000, k=1)
        got = rows(run(spark, views, folder, "views").filter("k = 'a'"), "view", "t0", "until", "count")
        stored = spark.createDataFrame(data, schema)
        assert got == rows(q.stable_views(stored, KEY, ["i"], "t", "sig", 0.035, 1.0), "view", "t0", "until", "count")
        holds = st.hold_dedup_stream(src, KEY, ["i"], "t", "f", 6.0, event_time="at", watermark="1 second", idle_ms=60_000)
        got = rows(run(spark, holds, folder, "holds").filter("k = 'a'"), "i", "f")
        assert got == rows(q.hold_dedup(stored, KEY, ["i"], "t", "f"), "i", "f")


def test_rows_of_several_triggers_are_folded_in_event_order(spark):
    schema = "k string, i int, t double, sig double, f string"
    rnd = random.Random(5)
    data = [("a", i, 100.0 + 10 * i + rnd.random(), float(rnd.choice([0, 0, 0.02, 1])), rnd.choice("xxy")) for i in range(60)]
    data += [("b", i, t, 0.0, "x") for i, t in enumerate([100.0, 110.0, 130.0, 140.0, 120.0, 150.0])]
    arrival = sorted(data[:60], key=lambda r: r[2] + rnd.random() * 50)
    batches = [arrival[at:at + 9] for at in range(0, 60, 9)]
    batches[0] = batches[0] + data[60:64]
    batches[1] = batches[1] + data[64:]
    # Rows of one key only push the watermark on.
    batches += [[("z", 99, 5000.0, 0.0, "x")], [("z", 100, 9000.0, 0.0, "x")]]
    stored = spark.createDataFrame(data, schema)
    with tempfile.TemporaryDirectory(prefix="run-") as folder:
        src = feed(spark, folder, batches, schema).withColumn("at", F.timestamp_seconds("t"))
        views = st.stable_views_stream(src, KEY, ["t"], "t", "sig", 0.035, 10.0, event_time="at", watermark="10 minutes", idle_ms=60_000, k=1)
        want = rows(q.stable_views(stored, KEY, ["t"], "t", "sig", 0.035, 10.0), "k", "view", "t0", "until", "count")
        assert rows(run(spark, views, folder, "views").filter("k <> 'z'"), "k", "view", "t0", "until", "count") == want
        holds = st.hold_dedup_stream(src, KEY, ["t"], "t", "f", 45.0, event_time="at", watermark="10 minutes", idle_ms=60_000)
        want = rows(q.hold_dedup(stored, KEY, ["t"], "t", "f", 45.0), "k", "t", "f")
        assert rows(run(spark, holds, folder, "holds").filter("k <> 'z'"), "k", "t", "f") == want


def test_progress_stream(spark):
    schema = "k string, i int, t double, phase string"
    with tempfile.TemporaryDirectory(prefix="run-") as folder:
        src = feed(spark, folder, [[("a", 1, 1.0, "read")], [("a", 2, 2.0, "check")]], schema).withColumns({"at": F.timestamp_seconds("t"), "done": F.lit(1), "n": F.lit(2)})
        out = st.progress_stream(src, KEY, "at", ["i"], "phase", "done", "n")
        w = out.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
        w.awaitTermination()
        assert rows(spark.table("progress"), "k", "phase") == [("a", "check")]


def test_files_below_a_folder(spark, tmp_path):
    for name, text in {"a/1.json": '{"bars":["x","y"]', "a/checkpoint.json": '{"bars":["x","y"]}', "b/c/review.json": "", "a/_temporary/0/checkpoint.json": "x", "b/.checkpoint.json.crc": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    out = s.usage_snapshots(spark, str(tmp_path))
    assert rows(out, "job", "saved_bars", "finished") == [("a", 2, False), ("c", 0, True)]
    assert rows(s.read_projects(spark, str(tmp_path))[2].select(F.regexp_extract("path_key", "([^/]+)$", 1).alias("f"), "error")) == [
        ("1.json", "malformed"), ("checkpoint.json", "malformed"), ("review.json", "malformed")]


def test_tasks_of_very_many_files(monkeypatch):
    from obsflow.sources import files
    monkeypatch.setattr(files._Versions, "_listed", lambda self: [(k, f"/x/{k}") for k in range(100_000)])
    parts = files._Versions("/x", 0).partitions({"at": -1, "path": ""}, {"at": 10**9, "path": ""})
    assert len(parts) <= files.PARTITIONS and [p for x in parts for p, _ in x.files] == [f"/x/{k}" for k in range(100_000)]
