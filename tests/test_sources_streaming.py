import time
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fahrwerk.model import physics_groups
from fahrwerk.sources import files
from fahrwerk.streaming import buffer


def test_runs_keep_their_order(spark, tmp_path):
    (tmp_path / "simulation_7_mass_8300_friction_0.75.csv").write_text("imu_acc_x,context\n" + "\n".join(f"{i}.5,road" for i in range(50)) + "\nNaN,crash\n")
    got = files.read_runs(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.IMU_ACC_X for r in got[:3]] == [0.5, 1.5, 2.5] and got[-1].IMU_ACC_X is None
    assert (got[0].run_id, got[0].mass, got[0].friction) == (7, 8300, 0.75)


def test_context_and_series(spark, tmp_path):
    ctx = {"id": "a", "sigs": [5, 6], "vehicles": [{"body": {"mass": 8300}, "sensors": [{"kind": "imu", "readings": [{"measurement": "m", "unit": "3", "t0": "1", "tf": "9", "dev": "0"}]}], "actuation": [], "telemetry": []}],
           "environment": {"simulatorSettings": {"map_friction": 0.5}, "location": {"map_features": {"pothole": [{"latitude": 1.0, "longitude": 2.0, "altitude": 0.0, "r": 2.56, "class": "small"}] * 2}}}}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "ctx.json").write_text(json.dumps(ctx, indent=1))
    c = files.read_run_context(spark, str(tmp_path / "c"))
    assert (c.first().mass, c.first().friction) == (8300.0, 0.5)
    assert files.readings(c).count() == 2
    assert sorted(r.label for r in files.features_of(c).collect()) == ["pothole_small_2.56_1", "pothole_small_2.56_2"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps({"series": [{"dev": 0, "value": 1.5, "x": 1, "y": 2, "z": 3, "timestamp": 7}]}))
    (tmp_path / "s" / "b.json").write_text('{"series": []}')
    (tmp_path / "s" / "c.json").write_text("{not json")
    s = files.read_series(spark, str(tmp_path / "s")).collect()
    assert [(r.sensor, r.value) for r in s] == [("IMU_ACC_X", 1.5)]
    (tmp_path / "s" / "d.json").write_text(json.dumps({"series": [{"dev": 16, "value": "AAAA"}, {"dev": 16, "value": [{"speed": 2}]}]}))
    s = files.read_series(spark, str(tmp_path / "s"))
    assert [(r.value, r.raw) for r in s.where("dev = 16").orderBy("pos").collect()] == [(None, "AAAA"), (None, '[{"speed": 2}]')]
    assert files.expected_length(s) == 2 and files.expected_length(s.limit(0)) == 0
    assert {r.unit for r in files.readings(c, {"sensor": 77}).collect()} == {77}


def test_files_of_results_and_models(spark, tmp_path):
    df = spark.createDataFrame([("imu", "a.bin", bytearray(b"xyz")), ("gps", "b.bin", bytearray(b"")), ("gps", None, None)], "measurement string, name string, blob binary")
    assert files.write_blobs(df, str(tmp_path / "blobs")) == 2 and (tmp_path / "blobs" / "a.bin").read_bytes() == b"xyz"
    files.write_measurements(df.select("measurement", "name"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).where("measurement = 'gps'").count() == 2
    files.write_report(spark, ["inertia 3", "average 1"], str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["inertia 3", "average 1"]
    files.save_arrays(spark, {"w": np.arange(6.0).reshape(2, 3), "b": np.zeros(2)}, str(tmp_path / "model"))
    got = files.load_arrays(spark, str(tmp_path / "model"))
    assert got["w"].tolist() == [[0, 1, 2], [3, 4, 5]] and got["b"].shape == (2,)
    files.write_results(spark.createDataFrame([(1, 0.5)], "run int, mae double"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().mae == "0.5"
    files.write_runs(spark.createDataFrame([(3, 0.5), (4, 1.5)], "run_id int, v double"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).where("run_id = 4").first().v == 1.5


def test_finding_runs_and_columns(spark, tmp_path):
    (tmp_path / "simulation_7_mass_8300_friction_0.75.csv").write_text("a\n1\n")
    assert files.find_run(spark, str(tmp_path), 7).endswith("simulation_7_mass_8300_friction_0.75.csv")
    with pytest.raises(FileNotFoundError):
        files.find_run(spark, str(tmp_path), 70)
    assert files.missing_inputs(spark, [str(tmp_path), str(tmp_path / "no")]) == [str(tmp_path / "no")]
    df = spark.createDataFrame([(1, 2)], "Speed int, brake int")
    assert files.check_columns(df, ["SPEED", "GEAR", "brake"]) == (["SPEED", "brake"], ["GEAR"])


def test_three_regimes(spark):
    got = files.three_regimes(spark, 9, 5, 2).groupBy("target").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).orderBy("target").collect()
    assert [r.n for r in got] == [30] * 3 and all(r.target + 1 <= r.lo <= r.hi <= r.target + 2 for r in got)
    with pytest.raises(ValueError):
        files.three_regimes(spark, 10, 5, 2)


def test_pages_of_equal_times_and_event_windows(spark, tmp_path, monkeypatch):
    from fahrwerk.sources import store

    records = [{"dev": 1, "value": i, "timestamp": i // 3} for i in range(10)]
    monkeypatch.setattr(store, "post", lambda url, body, retries: {"series": [r for r in records if r["timestamp"] >= body["series"]["t0"]][:4]})
    assert [r[2] for r in store.pages({"url": ""}, 0, 99)] == list(range(10))
    e = spark.createDataFrame([(1, "2024-01-01 00:01:00", 2.0), (1, "2024-01-01 00:09:00", 4.0), (1, "2024-01-01 00:11:00", 1.0)], "dev long, t string, value double").withColumn("t", F.to_timestamp("t"))
    assert [(r.n, r["mean"]) for r in buffer.event_windows(e).orderBy("start").collect()] == [(2, 3.0), (1, 1.0)]
    for _ in range(2):
        buffer.write_once(e, 5, str(tmp_path / "sink"))
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3


def test_groups(spark):
    assert physics_groups(spark).count() == 11


def test_stream_flushes_by_count(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = "dev long, t long, value double"
    for i in range(3):
        spark.createDataFrame([(d, 10 * i + j, 1.0) for d in (1, 2) for j in range(4)], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = buffer.flush_by_count(stream, 5).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out).groupBy("dev").agg(F.count("*").alias("n"), F.sum("n").alias("rows")).orderBy("dev").collect()
    assert [(r.dev, r.n, r.rows) for r in got] == [(1, 2, 10), (2, 2, 10)]


def serve(records, put):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Store(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/get":
                q = body["series"]
                out = {"series": [r for r in records if q["t0"] <= r["timestamp"] <= q["t1"]][:3]}
            elif self.path == "/last":
                out = {"t": max(r["timestamp"] for r in records)}
            else:
                put.append((self.path, body))
                out = {}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}"


def test_record_store(spark, tmp_path):
    from fahrwerk.sources.store import RecordStore

    put = []
    server, url = serve([{"dev": 1, "unit": 5, "signature": 2, "value": float(i), "timestamp": i} for i in range(20)], put)
    spark.dataSource.register(RecordStore)
    df = spark.read.format("record_store").options(url=url, unit=5, dev=1, signature=2, t0=0, tf=19, slice=7).load()
    assert [r.t for r in df.orderBy("t").collect()] == list(range(20))
    df.coalesce(1).write.format("record_store").options(url=url, buffer=8).mode("append").save()
    assert sum(len(b["records"]) for p, b in put if p == "/put") == 20 and [p for p, _ in put].count("/create") == 3
    stream = spark.readStream.format("record_store").options(url=url, unit=5, dev=1, signature=2, t0=0).load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 20
    server.shutdown()


def asking(records, asked):
    """A server as ``serve``'s that also heeds unit, device and signature, and keeps what it was asked for."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Store(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            q = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["series"]
            asked.append(q)
            same = [r for r in records if all(r[k] == q[k] for k in ("unit", "dev", "signature") if k in q)]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"series": [r for r in same if q["t0"] <= r["timestamp"] <= q["t1"]][:4]}).encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}"


def test_filters_reach_the_store(spark):
    from fahrwerk.sources.store import RecordStore

    asked = []
    server, url = asking([{"unit": u, "dev": 1, "signature": 2, "value": 1.0, "timestamp": i} for i in range(30) for u in (5, 6)], asked)
    spark.dataSource.register(RecordStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("record_store").options(url=url, dev=1, t0=0, tf=29, slice=5, pushdown=True).load()
        got = df.where("t >= 8 and t < 20 and unit = 6 and value > 0").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        server.shutdown()
    assert sorted((r.unit, r.t) for r in got) == [(6, t) for t in range(8, 20)]
    assert asked and all(q["unit"] == 6 and q["dev"] == 1 and q["t0"] >= 8 and q["t1"] <= 19 for q in asked)


def test_readings_are_fetched_by_slices(spark, tmp_path):
    from fahrwerk.sources import store

    records = [{"unit": u, "dev": d, "signature": s, "value": u * 100.0 + i, "timestamp": i} for u in (1, 2) for d in (0, 1) for s in (7, 8) for i in range(0, 40, 2)]
    asked = []
    server, url = asking(records, asked)
    rows = [("imu", 1, 0, 7, 0, 39, "x"), ("imu", 2, 1, 8, 5, 9, None), ("gps", 2, 1, 8, 5, 9, "again"), ("no", 1, 1, None, 0, 9, "x"), ("late", 1, 1, 7, 9, 5, "x"), ("none", 9, 0, 7, 0, 9, "x")]
    plan = spark.createDataFrame(rows, "measurement string, unit long, dev long, signature long, t0 long, tf long, value string")
    got = store.fetched(plan, url, slice=10, tasks=3)
    assert got.columns == [*plan.columns, "record"]
    found = sorted((r.measurement, r.value or "", r.record.t, r.record.value, r.record.raw) for r in got.collect())
    want = [("imu", "x", t, 100.0 + t, str(100.0 + t)) for t in range(0, 40, 2)] + [(m, v, t, 200.0 + t, str(200.0 + t)) for m, v in (("imu", ""), ("gps", "again")) for t in (6, 8)]
    assert found == sorted(want)
    assert all(q["t1"] - q["t0"] < 10 for q in asked) and {q["unit"] for q in asked} == {1, 2, 9}
    assert store.fetched(plan.limit(0), url).count() == 0
    server.shutdown()


def test_readings_to_blobs_to_files(spark, tmp_path):
    """Run contexts give readings, readings series, and series files, in one plan."""
    import base64

    from fahrwerk.sources import store

    ctx = {"id": "a", "sigs": [5, 6], "vehicles": [{"body": {"mass": 8300}, "sensors": [{"kind": "camera", "readings": [{"measurement": "m", "unit": "3", "t0": "0", "tf": "35", "dev": "4"}]}], "actuation": [], "telemetry": []}],
           "environment": {"simulatorSettings": {"map_friction": 0.5}, "location": {"map_features": {}}}}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "ctx.json").write_text(json.dumps(ctx))
    text = lambda s, t: base64.b64encode(f"{s} at {t}".encode()).decode()
    records = [{"unit": 3, "dev": 0, "signature": s, "value": text(s, t) if t != 15 else "!", "timestamp": t} for s in (5, 6) for t in range(0, 36, 5)]
    server, url = asking(records, [])
    readings = files.readings(files.read_run_context(spark, str(tmp_path / "c")))
    blobs = store.fetched_blobs(readings, url, step=10)
    assert files.write_blobs(blobs, str(tmp_path / "blobs")) == 2 * 6
    server.shutdown()
    assert {p.name: p.read_text() for p in (tmp_path / "blobs").iterdir()} == {f"m-{t}_{s}.raw": f"{s} at {t}" for s in (5, 6) for t in (0, 5, 10, 20, 25, 30)}


def test_zipped_contexts(spark):
    import base64
    import io
    import zipfile

    from fahrwerk.sources.store import time_slices, zipped_contexts

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.json", json.dumps({"id": "abc\nrun 1"}))
        z.writestr("b.json", json.dumps({"id": "other\nrun 2"}))
    df = spark.createDataFrame([(base64.b64encode(raw.getvalue()).decode(),), ("bm8=",), (None,)], "value string")
    assert zipped_contexts(df, "value", "abc").count() == 1
    assert [r.until for r in time_slices(spark.createDataFrame([(0, 3_500_000)], "t0 long, tf long")).collect()] == [1_000_000, 2_000_000, 3_000_000]


def test_pointer_walk_on_a_stream(spark, tmp_path):
    from fahrwerk.operators import joins

    rows = [(1, t, None) for t in (0, 10, 20, 30, 40, 50, 60, 70)] + [(1, t, i) for i, t in enumerate([5, 15, 15, 20, 25, 36, 45, 66])] + [(2, 3, 0), (2, 9, None), (2, 4, 1)]
    schema, src = "run_id long, t long, rid long", str(tmp_path / "in")
    for lo, hi in ((0, 16), (16, 37), (37, 99)):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).coalesce(1).write.mode("append").parquet(src)
    q = buffer.pointer_walk(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    all_rows = spark.createDataFrame(rows, schema)
    want = joins.asof_sequential(all_rows.where("rid is not null"), all_rows.where("rid is null"), "run_id")
    key = lambda df: sorted((r.run_id, r.rid, r.t, r.ego) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(want)


def test_pointer_walk_in_small_batches_keeps_little(spark, tmp_path):
    """Batches of a few times each, against the batch form; and what the states hold."""
    import random

    from fahrwerk.operators import joins

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

    walk = {}
    fake = type("Rows", (), {"groupBy": lambda self, *_: self, "applyInPandasWithState": lambda self, run, *_: walk.setdefault("run", run)})
    buffer.pointer_walk(fake())
    rng, rows, want, held = random.Random(4), [], [], 0
    for run_id in range(40):
        times = sorted(rng.sample(range(200), 60))
        own = [(run_id, t, None if rng.random() < rng.choice([0.3, 0.6]) else i) for i, t in enumerate(times)]
        own += [(run_id, t, 1000 + i) for i, (_, t, r) in enumerate(own) if r is None and rng.random() < 0.1]
        own.sort(key=lambda r: (r[1], r[2] is not None))
        state = State()
        batches = [[]]
        for row in own:  # a batch ends between two times only
            if batches[-1] and row[1] != batches[-1][-1][1] and rng.random() < 0.4:
                batches.append([])
            batches[-1].append(row)
        for part in [*batches, [(run_id, 10_000, None)]]:
            frame = pd.DataFrame(part, columns=["run_id", "t", "rid"]).astype({"rid": "float"})
            want += [tuple(map(int, x)) for out in walk["run"]((run_id,), iter([frame]), state) for x in out.itertuples(index=False)]
            held = max(held, len(state.get[2]))
            assert not state.get[1] or (len(state.get[2]) == 1 and not state.get[3])
        rows += [*own, (run_id, 10_000, None)]
    frame = spark.createDataFrame(rows, "run_id long, t long, rid long")
    got = joins.asof_sequential(frame.where("rid is not null"), frame.where("rid is null"), "run_id")
    assert sorted((r.run_id, r.rid, r.t, r.ego) for r in got.collect()) == sorted(want) and held <= 2


def test_buffers_flush_when_told_and_when_idle(spark, tmp_path):
    schema, src = "dev long, t long, value double", str(tmp_path / "in")
    first = [(1, t, 1.0) for t in range(7)] + [(2, 5, 2.0), (3, 1, 1.0)]
    second = [(1, 9, 1.0), (1, None, None), (2, 6, 2.0)]
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = buffer.flush_by_count(stream, 3, idle=1500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            found = spark.read.schema(buffer.CHUNK).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
            if sum(r.n for r in found) == 11:
                break
    finally:
        q.stop()
    got = sorted((r.dev, r.chunk, r.n) for r in found)
    assert [x for x in got if x[0] == 1] == [(1, 0, 3), (1, 1, 3), (1, 2, 2)]  # the order to flush
    assert sum(n for d, _, n in got if d == 2) == 2 and sum(n for d, _, n in got if d == 3) == 1  # idle


def test_records_reach_the_store_once(spark, tmp_path):
    """A put fails in the midst of an epoch; the query starts again, and the store holds each record once, with its signature."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from fahrwerk.operators import records
    from fahrwerk.plans.records import _egos
    from fahrwerk.sources.store import RecordStore
    from fahrwerk.sources.telemetry import entries

    held, told, puts = {}, [], []

    class Store(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bad = False
            if self.path == "/put":
                puts.append(body["batch"])
                bad = len(puts) == 4
                if not bad:
                    held.setdefault(body["batch"], body["records"])
            elif self.path in ("/commit", "/abort"):
                told.append((self.path, body["epoch"]))
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(RecordStore)
    sf = "/root/testdata/sf0.001"
    made = records.for_store(records.si_records(entries(spark, sf), _egos(spark, sf), ["run_id"], step=50000, signature=77)).limit(300)
    src = str(tmp_path / "in")
    made.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(src)
    options = {"url": f"http://127.0.0.1:{server.server_port}", "buffer": 20, "retries": 1, "epochs": "true", "checkpointLocation": str(tmp_path / "c")}
    start = lambda: stream.writeStream.format("record_store").options(**options).start()
    with pytest.raises(Exception):  # noqa: B017
        start().processAllAvailable()
    assert 0 < sum(map(len, held.values())) < 300 and ("/abort", 0) in told
    q = start()
    q.processAllAvailable()
    q.stop()
    server.shutdown()
    key = lambda r: (r["dev"], r["t"], r["unit"], r["value"], round(r["x"] or 0, 6), r["signature"], r["version"])
    assert sorted(map(str, (key(r) for part in held.values() for r in part))) == sorted(map(str, map(key, spark.read.parquet(src).collect())))
    assert {r["signature"] for part in held.values() for r in part} == {77} and ("/commit", 0) in told
