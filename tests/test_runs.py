"""Feeds by day, keyed state, isolated actions, snapshots, changes, counts and archiving, with what goes wrong in each."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimp.operators import changes
from palimp.sources import by_day, archive, ingest, snapshots
from palimp.sources.day_feed import DayReader, covered
from palimp.sources.paged import SCHEMA, HttpError
from palimp.sources.service import Service, http
from palimp.streaming import actions, feed, known

from tests import fake_service


def reader(spark, **options):
    return DayReader(spark.createDataFrame([], SCHEMA).schema, {"fetch": "tests.fake_service.days", "pace": "0", "run": "a", **options})


def test_offsets_alone_say_what_a_batch_reads(spark):
    r = reader(spark, desde="2024-01-05", ate="2024-01-11", days="3")
    start, ends = r.initialOffset(), []
    for _ in range(5):
        ends.append(r.latestOffset())
    assert [e["ate"] for e in ends] == ["2024-01-07", "2024-01-10", "2024-01-11", "2024-01-11", "2024-01-11"]
    wanted = lambda a, b: [d for p in r.partitions(a, b) for d in p.days]
    assert wanted(start, ends[0]) == ["2024-01-05", "2024-01-06", "2024-01-07"] and wanted(ends[0], ends[1])[0] == "2024-01-08"
    later = reader(spark, desde="2024-01-11", ate="2024-01-12", run="b").latestOffset()
    assert wanted(ends[2], later) == ["2024-01-11"] and reader(spark, desde="2024-01-11", ate="2024-01-12", run="b", days="9").latestOffset()["ate"] == "2024-01-12"
    assert wanted(ends[2], {"ate": "2024-01-02", "run": "c", "desde": "2024-01-01"}) == ["2024-01-01", "2024-01-02"]
    assert wanted(ends[2], reader(spark, desde="2024-02-01", ate="2024-01-12", run="d").latestOffset()) == []
    three = reader(spark, desde="2024-01-01", ate="2024-01-05", days="9", readers="2")
    assert sorted(d for p in three.partitions(start, three.latestOffset()) for d in p.days) == [f"2024-01-0{i}" for i in range(1, 6)]
    assert len([row for p in three.partitions(start, three.latestOffset()) for row in three.read(p)]) == 10


def test_days_have_readers_of_their_own_without_a_pace(spark):
    start = reader(spark, desde="2024-01-01", ate="2024-01-05").initialOffset()
    counts = []
    for options in ({}, {"pace": "0.1"}, {"pace": "0.1", "readers": "3"}, {"readers": "2"}):
        r = reader(spark, desde="2024-01-01", ate="2024-01-05", days="9", **options)
        counts.append(len(r.partitions(start, r.latestOffset())))
    assert counts == [5, 1, 3, 2]


def test_a_page_takes_its_own_rows_alone(spark, tmp_path, monkeypatch):
    rows = [(str(i), i, f"2024-01-0{1 + i // 7}") for i in range(17) if i // 7 != 1] + [("x", 99, "2024-01-05")]
    by_day.write(spark.createDataFrame(rows, "idProduto string, pos int, dia string"), f"file://{tmp_path}/d")
    monkeypatch.setattr(by_day, "days", lambda a, b: ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05"])
    fetch = by_day.serve(f"file://{tmp_path}/d")
    pages = [fetch({"count": 4, "page": n, "periodoPublicacaoInicial": "", "periodoPublicacaoFinal": ""}, 1) for n in range(1, 5)]
    assert [[r["pos"] for r in p["content"]] for p in pages] == [[0, 1, 2, 3], [4, 5, 6, 14], [15, 16, 99], []]
    assert [(p["totalElements"], p["totalPages"], p["last"]) for p in pages] == [(11, 3, False), (11, 3, False), (11, 3, True), (11, 3, True)]


def test_feed_stops_goes_on_and_moves_back(spark, tmp_path):
    table, state = f"{tmp_path}/t", f"{tmp_path}/c"
    batches = []
    go = lambda **k: feed.run(spark, table, state, fetch="tests.fake_service.days", pace=0, then=lambda new, n: batches.append((n, new.count())), **k)
    assert covered(spark, state) is None
    go(desde="2024-01-05", ate="2024-01-08", days=2)
    assert covered(spark, state) == "2024-01-08" and [n for n, _ in batches] == [0, 1]
    go(ate="2024-01-10", days=9)
    go(ate="2024-01-10", days=9)  # the same day again: nothing new
    assert covered(spark, state) == "2024-01-10" and [c for _, c in batches] == [4, 4, 2, 0]
    go(desde="2024-01-01", ate="2024-01-12", days=30)
    rows = [(r["registro"], r["expediente"], r["data"]) for r in spark.read.parquet(table).collect()]
    keys = [(a, b) for a, b, _ in rows]
    assert len(keys) == len(set(keys)) == 16 and ("1", "new", "2024-01-01") in rows and ("101", "again", "2024-01-05") in rows


def test_state_costs_what_a_batch_brings(spark, tmp_path):
    """Late and repeated rows over restarts; rows of state touched are those of the batch, whatever was before."""
    src, schema = tmp_path / "in", "registro string, expediente string, ts timestamp"
    day = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/d{n}")
    at = lambda d: dt.datetime(2024, 1, d)
    touched, got = [], []

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{src}/*")
        with known.state_store(spark):
            before = len(got)
            q = known.unseen(stream, ["registro", "expediente"], "ts").writeStream.foreachBatch(lambda b, _: got.append(sorted((r[0], r[1], r[2].day) for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/c").start()
            q.processAllAvailable()
            touched.append(max(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]))
            q.stop()
            assert len(got) > before

    day(1, [(str(i), "a", at(9)) for i in range(200)])
    run()
    day(2, [("3", "a", at(2)), ("new", "b", at(8)), ("new", "b", at(7))])  # late for a known key, and a key twice
    run()
    day(3, [("new", "b", at(1)), ("late", "c", at(1))])
    run()
    assert len(got[0]) == 200 and [x for x in got[1:] if x] == [[("new", "b", 7)], [("late", "c", 1)]]
    assert touched[0] >= 200 and max(touched[1:]) <= 4


def test_rows_are_reduced_before_the_state(monkeypatch):
    """A task's rows come down to one for each key, the earliest (nulls last), however they are cut into batches."""
    monkeypatch.setattr(known, "LEAST", 4)
    rows = [("a", 3, 1), ("b", None, 2), ("a", 1, 3), (None, 5, 4), ("b", 7, 5), ("a", 1, 6), ("c", None, 7), (None, 4, 8), ("b", 9, 9)]
    for cut in (1, 2, 9):
        parts = [pa.RecordBatch.from_pylist([dict(zip("ktn", r, strict=True)) for r in rows[i : i + cut]], pa.schema([("k", pa.string()), ("t", pa.int64()), ("n", pa.int64())])) for i in range(0, 9, cut)]
        got = [tuple(r.values()) for b in known._one_each(["k"], "t")(iter(parts)) for r in b.to_pylist()]
        assert sorted(got, key=str) == sorted([("a", 1, 3), ("b", 7, 5), ("c", None, 7), (None, 4, 8)], key=str)


def test_keys_cost_no_call_each(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("registro string, expediente string, ts timestamp").parquet(f"{tmp_path}/in")
    plan = known.unseen(stream, ["registro", "expediente"], "ts")._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    src, schema = tmp_path / "in", "registro string, expediente string, ts timestamp"
    got = []
    for n, rows in enumerate(([("a", "x", dt.datetime(2024, 1, 1))], [("b", "x", dt.datetime(2024, 3, 1))], [("c", "x", dt.datetime(2024, 3, 2))], [("a", "x", dt.datetime(2024, 3, 3))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/d{n}")
        stream = spark.readStream.schema(schema).parquet(f"{src}/*").withWatermark("ts", "1 day")
        with known.state_store(spark):
            q = known.unseen(stream, ["registro", "expediente"], "ts", forget_ms=10 * 86_400_000).writeStream.foreachBatch(lambda b, _: got.extend((r[0], r[2].month) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
            q.processAllAvailable()
            q.stop()
    assert got == [("a", 1), ("b", 3), ("c", 3), ("a", 3)]


def test_a_failing_key_harms_no_other(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.touch()

    def visit(key, anew):
        with open(calls, "a") as f:
            f.write(f"{key}\n")
        if key == "bad":
            raise RuntimeError("no")
        if key == "gone":
            raise HttpError(404)
        if key == "old" and not anew or key == "dead":
            raise HttpError(403)
        return key.upper()

    run = actions.on_batch(f"{tmp_path}/o", "k", visit, readers=2)
    batch = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    run(batch("x", "x", "bad", "old", None), 0)
    run(batch("y", "dead", "gone"), 1)
    run(batch("y", "dead", "gone"), 1)  # the same batch again
    got = {(r["batch"], r["key"]): (r["ok"], r["attempts"], r["result"], r["error"]) for r in actions.results(spark, f"{tmp_path}/o").collect()}
    assert got[0, "x"] == (True, 1, "X", None) and got[0, "old"] == (True, 2, "OLD", None) and got[0, "bad"] == (False, 1, None, "RuntimeError: no")
    assert got[1, "dead"][:2] == (False, 2) and got[1, "gone"][:2] == (False, 1) and len(got) == 6
    assert calls.read_text().split().count("x") == 1
    assert {r["key"] for r in spark.read.parquet(f"{tmp_path}/o/dead").collect()} == {"bad", "dead", "gone"}
    run(batch("bad2", "gone"), 2)
    assert {(r["key"], r["attempts"]) for r in actions.pending(spark, f"{tmp_path}/o").collect()} == {("bad", 1), ("dead", 2), ("gone", 2)}


def test_snapshots(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(100).selectExpr("id", "cast(id as string) as s")
    assert snapshots.state(spark, path) == {"versao": None, "atualizado": None, "rows": 0, "files": []}
    assert snapshots.read(spark, path, rows.schema).count() == 0
    assert snapshots.write(rows, path, "2024-01-01", items=F.count("*"), **snapshots.counted(odd=F.col("id") % 2 == 1)) == {"items": 100, "odd": 50}
    broken = rows.withColumn("s", F.expr("if(id = 77, raise_error('x'), s)"))
    with pytest.raises(Exception, match="x"):
        snapshots.write(broken, path, "2024-01-02")
    about = snapshots.state(spark, path)
    assert (about["versao"], about["atualizado"], about["rows"]) == (0, "2024-01-01", 100) and snapshots.read(spark, path, rows.schema).count() == 100
    snapshots.write(rows.limit(10), path, "2024-01-03", mode="append")
    snapshots.write(rows.limit(0), path, mode="append")
    assert snapshots.state(spark, path)["atualizado"] == str(dt.date.today())
    assert snapshots.read(spark, path, rows.schema).count() == 110 and snapshots.read(spark, path, rows.schema, version=0).count() == 100
    snapshots.write(rows.limit(5), path)
    assert snapshots.swept(path) > 0 and snapshots.read(spark, path, rows.schema).count() == 5 and snapshots.state(spark, path)["versao"] == 3


def test_streamed_versions_are_batches(spark, tmp_path):
    """A batch that is committed twice is there once, and the listener sees what was observed."""
    from palimp.streaming.progress import Counts

    src, path = f"{tmp_path}/in", f"{tmp_path}/t"
    spark.dataSource.register(snapshots.Snapshots)
    listener = Counts()
    spark.streams.addListener(listener)
    try:
        for n in range(3):
            spark.range(n * 10, n * 10 + 10).coalesce(1).write.parquet(f"{src}/d{n}")
            stream = spark.readStream.schema("id long").parquet(f"{src}/*").observe("run", F.count("*").alias("items"), F.count_if(F.col("id") % 5 == 0).alias("errors"))
            q = stream.writeStream.format("snapshot").option("path", path).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            q.awaitTermination()
        assert snapshots.state(spark, path)["rows"] == 30 and sorted(r["id"] for r in snapshots.read(spark, path, "id long").collect()) == list(range(30))
        writer = snapshots.StreamWriter(None, {"path": path}, False)
        last = snapshots.state(spark, path)
        again = [snapshots.Written(last["files"][-1:], 10)]
        writer.commit(again, last["versao"])
        assert snapshots.state(spark, path)["rows"] == 30
        assert [c["items"] for c in listener.wait(spark, 3)] == [10] * 3 and sum(c["errors"] for c in listener.rows) == 6
    finally:
        spark.streams.removeListener(listener)


def test_changes(spark, tmp_path):
    old = [(1, "a", None), (2, "b", 1), (3, "c", 1), (None, "n", 1)]
    new = [(1, "a", 0), (2, "b", 1), (4, "d", 1), (None, "m", 1)]
    for name, rows in (("old", old), ("new", new), ("none", [])):
        changes.write_state(spark.createDataFrame(rows, "k int, s string, v int").withColumn("seen", F.lit(name)), f"{tmp_path}/{name}", ["k"], ("seen",), buckets=8)
    got = lambda a, b: {(r["k"], r["change"]) for r in changes.changes(spark, f"{tmp_path}/{a}", f"{tmp_path}/{b}", ["k"]).collect()}
    assert got("old", "new") == {(1, "changed"), (3, "gone"), (4, "added"), (None, "changed")}
    assert got("old", "old") == set() and changes.unequal(spark, f"{tmp_path}/old", f"{tmp_path}/old") == []
    assert got("old", "none") == {(k, "gone") for k in (1, 2, 3, None)} and got("none", "new") == {(k, "added") for k in (1, 2, 4, None)}


def test_unchanged_buckets_are_not_read(spark, tmp_path):
    rows = spark.range(2000).withColumn("v", F.col("id") % 7)
    changes.write_state(rows, f"{tmp_path}/a", ["id"], buckets=64)
    changes.write_state(rows.withColumn("v", F.when(F.col("id") == 5, -1).otherwise(F.col("v"))), f"{tmp_path}/b", ["id"], buckets=64)
    (bucket,) = changes.unequal(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    found = changes.changes(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["id"])
    assert [tuple(r) for r in found.collect()] == [(5, "changed")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.splitlines() if "FileScan" in x or "PartitionFilters" in x]
    assert len(filters) >= 2 and all(f" = {bucket})" in x for x in filters)


def test_archiving_products(spark, tmp_path):
    remembered, root = tmp_path / "service.json", f"{tmp_path}/archive"
    remembered.write_text(json.dumps({"asked": [], "generation": 0}))
    where = str(remembered)

    def transport(path, params, timeout):
        import os

        os.environ["PALIMP_SERVICE"] = where
        return fake_service.product_service(path, params, timeout)

    def extract(content):
        if content == b"odd":
            raise ValueError("unreadable")
        return {"paginas": 1, "documentos": [{"tipo": "vp", "secoes": {"1": content.decode()}}], "historico_tabela": [], "marcado": True, "documentos_linhas": []}

    targets = spark.createDataFrame([("100",), ("200",), ("300",), ("999",), ("100",), (None,)], "registro string")
    go = lambda **k: {(r["registro"], r["expediente"], r["tipo"]): r["error"] for r in ingest.fetch(spark, targets, root, transport, extract, pace=0, **k).collect()}
    got = go()
    # Ids of all but the last product's history have run out by the time the files are asked for; they are renewed.
    assert got["999", None, None].startswith("LookupError") and got["200", "e3", "vps"].startswith("HttpError") and got["300", "e2", "vp"] == "ValueError: unreadable"
    assert {k for k, e in got.items() if e is None} == {("100", "e3", "vp"), ("100", "e3", "vps"), ("100", "e2", "vp"), ("200", "e3", "vp"), ("200", "e2", "vp"), ("300", "e3", "vp"), ("300", "e3", "vps")}
    rows = {(r["registro"], r["expediente"], r["tipo"]): r for r in archive.versions(spark, root).collect()}
    assert set(rows) == {k for k, e in got.items() if e is None} and rows["100", "e3", "vp"]["situacao"] == "ok"
    metas = {r["registro"]: r for r in archive.meta(spark, root).collect()}
    assert set(metas) == {"100", "200", "300"} and metas["100"]["detalhe"]["principioAtivo"] == "x"
    assert "idBula" not in (tmp_path / "archive/100/meta.json").read_text()
    asked = len(json.loads(remembered.read_text())["asked"])
    again = go()
    files = [p for p in json.loads(remembered.read_text())["asked"][asked:] if p.startswith("medicamentos")]
    assert set(again) == {("999", None, None), ("200", "e3", "vps"), ("300", "e2", "vp")} and all("200-3-vps" in p or "300-2-vp/" in p for p in files)
    assert ("100", "e1", "vp") in go(latest=None)


def test_commands(spark, tmp_path, capsys, monkeypatch):
    """catalog, feed and fetch from the command line, on the made-up service."""
    from palimp import __main__ as command
    from palimp.operators.catalog import stale

    monkeypatch.setattr(command, "session", lambda: spark)
    remembered = tmp_path / "service.json"
    remembered.write_text(json.dumps({"asked": [], "generation": 0}))
    monkeypatch.setenv("PALIMP_SERVICE", str(remembered))
    command.main(["catalog", "-", f"{tmp_path}/cat", "--service", "tests.fake_service.fetch", "--pace", "0"])
    assert "25" in capsys.readouterr().out and snapshots.state(spark, f"{tmp_path}/cat")["rows"] == 25
    command.main(["catalog", "-", f"{tmp_path}/cat", "--service", "tests.fake_service.fetch", "--pace", "0"])
    assert capsys.readouterr().out == "" and snapshots.state(spark, f"{tmp_path}/cat")["versao"] == 0
    command.main(["feed", f"{tmp_path}/feed", f"{tmp_path}/state", "--de", "2024-01-01", "--ate", "2024-01-03", "--service", "tests.fake_service.days", "--pace", "0"])
    assert "2024-01-03" in capsys.readouterr().out and spark.read.parquet(f"{tmp_path}/feed").count() == 6
    with pytest.raises(SystemExit):
        command.main(["fetch", f"{tmp_path}/archive", "999", "--service", "tests.fake_service.product_service", "--extract", "json.loads", "--pace", "0"])
    assert "LookupError" in capsys.readouterr().out
    assert stale(None, "2024-01-08") and stale("2024-01-01", "2024-01-08") and not stale("2024-01-02", "2024-01-08")


class _Answers(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        self.seen.append((self.path, self.headers.get("x-proxy-key")))
        n = len(self.seen)
        if n == 1:
            self.send_response(503)
            self.end_headers()
            return
        body = b'{"content": [1' if n == 2 else b"%PDF" if "parecer" in self.path else b'{"content": [{"a": 1}], "last": true}'
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_http_transport():
    server = HTTPServer(("127.0.0.1", 0), _Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        waits = []
        service = Service(http("http://nowhere.invalid", {"PALIMP_PROXY": f"http://127.0.0.1:{server.server_port}/", "PALIMP_PROXY_KEY": "k"}), pace=0, sleep=waits.append)
        assert list(service.found(nomeProduto="á b")) == [{"a": 1}] and waits == [2.0, 4.0]
        assert _Answers.seen[0] == ("/bulario?count=200&page=1&filter%5BnomeProduto%5D=%C3%A1+b", "k")
        assert service.file("x") == b"%PDF"
        with pytest.raises(ConnectionError):
            Service(http("http://127.0.0.1:1", {}), pace=0, retries=0).search()
    finally:
        server.shutdown()
