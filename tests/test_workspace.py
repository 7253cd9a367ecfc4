import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loam.facade import Toolkit, Workspace
from loam.sources import files, state
from loam.streaming import jobs

NOW = datetime(2024, 3, 1)


@pytest.fixture
def folder(tmp_path):
    for path, body in {"knowledge/short_term/a.md": b"# A\n" + b"some text here " * 10, "knowledge/long_term/b.TXT": b"bad \xff\xfe bytes", "knowledge/short_term/_cache_web/w.md": b"cached", "knowledge/x.bin": b"\x00", "knowledge/c.docx": b"not a docx", "memory/m.md": b"note", "chat_history/c.jsonl": b'{"role":"user","content":"hi"}\n\n{bad\r\n{"text":"x"}\n'}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    old = (NOW - timedelta(days=10)).timestamp()
    os.utime(tmp_path / "knowledge/short_term/_cache_web/w.md", (old, old))
    return tmp_path


@pytest.fixture
def workspace(spark, folder):
    w = Workspace(spark, str(folder), as_of=NOW)
    texts = ["a chunk of text that is long enough", "a chunk  of text that is long enough", "", "another chunk of text, also long enough"]
    w.write_chunks(files.chunks_from_lists(spark, texts, metadatas=[{"source": "a.md"}] * 4))
    return w


def test_readers(spark, folder):
    docs = {r.name: r for r in files.read_documents(spark, str(folder / "knowledge")).collect()}
    assert set(docs) == {"a.md", "b.TXT", "w.md", "c.docx"}
    assert docs["b.TXT"].content == "bad �� bytes" and docs["b.TXT"].rel_path == "long_term/b.TXT" and docs["a.md"].content.startswith("# A")
    lines = files.read_chat_lines(spark, str(folder / "chat_history")).orderBy("line_num").collect()
    assert [(r.line_num, r.line[:4]) for r in lines] == [(1, '{"ro'), (3, "{bad"), (4, '{"te')]
    times = {r.rel_path: r.category for r in files.file_times(spark, str(folder / "knowledge")).collect()}
    assert times["short_term/_cache_web/w.md"] == "web_cache" and times["x.bin"] == "unknown" and times["long_term/b.TXT"] == "long_term"
    want = spark.createDataFrame([(str(folder / "knowledge/short_term/a.md"),), ("/nowhere.md",)], "path string")
    assert sorted(r.found for r in files.expected_files(want, files.scan(spark, str(folder / "knowledge"))).collect()) == [False, True]


def test_state(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path / "state"))
    assert store.read("cycles").count() == 0
    for i in range(4):
        store.append("cycles", spark.createDataFrame([(NOW + timedelta(hours=i), i / 10)], state.CYCLES))
    assert store.read("cycles").count() == 4
    store.keep_newest("cycles", 2)
    store.append("cycles", spark.createDataFrame([(NOW + timedelta(hours=9), 0.9)], state.CYCLES))
    assert sorted(r.health_score for r in store.read("cycles").collect()) == [0.2, 0.3, 0.9]


def test_checks(workspace, folder):
    found = workspace.health_check()
    assert found["health"].first().status in ("healthy", "warning", "critical") and found["components"].count() == 4
    workspace.health_check()
    assert state.read_history(workspace.spark, f"{folder}/.governance/history").count() == 2
    assert "Overall:" in workspace.report(str(folder / "report.md")) and (folder / "report.md").exists()
    targets = {r.target for r in workspace.validate_all().select("target").distinct().collect()}
    assert targets == {"chunks", "documents", "chat", "memory"}
    assert {r.rule_name for r in workspace.validate_chat().where("NOT passed").collect()} == {"jsonl_valid", "message_has_role", "message_has_content"}
    assert workspace.profile_knowledge().count() == 5 and workspace.problems().count() == 1
    r = {x.rel_path: x for x in workspace.records().collect()}["short_term/_cache_web/w.md"]
    assert r.is_expired and r.action == "delete"
    assert workspace.memory_records().count() == 1
    paths = state.unlink_expired(workspace.records(), str(folder / "knowledge"))
    assert len(paths) == 1 and os.path.exists(paths[0])
    state.unlink_expired(workspace.records(), str(folder / "knowledge"), really=True)
    assert not os.path.exists(paths[0])


def test_changes(workspace, spark):
    assert [tuple(r) for r in workspace.remove_duplicates().collect()] == [("hash", 1)]
    assert workspace.chunks().count() == 3
    assert workspace.embed_quality().first().coverage == 1.0
    workspace.record_ingestion(spark.createDataFrame([(1, "a.md", "a.md", ["1"], "kb")], "seq long, path string, name string, chunk_ids array<string>, collection string"))
    assert workspace.lineage("collection:kb").count() == 2 and workspace.mermaid().startswith("graph LR")
    assert not workspace.update_alert("nothing", resolved=True)


def test_cycle(workspace):
    assert workspace.should_run()
    seen = []
    out = workspace.tick(on_alerts=seen.extend)
    assert out["ran"] and {"decision_type": "delete_duplicates", "status": "success", "affected": 1} in out["executed"]
    assert not workspace.should_run() and workspace.tick() == {"ran": False}


def test_approved_decisions(workspace, folder):
    cached = folder / "knowledge/short_term/_cache_web/w.md"
    waiting = workspace.agent_cycle(execute=True)["executed"]
    assert {"decision_type": "delete_expired", "status": "skipped", "affected": 0} in waiting and cached.exists()
    done = workspace.agent_cycle(execute=True, approved=("delete_expired", "quarantine"))["executed"]
    assert {"decision_type": "delete_expired", "status": "success", "affected": 1} in done and not cached.exists()
    assert not workspace.chunks().where("content = ''").count()
    kept = workspace.state.read("executions")
    assert kept.count() == len(waiting) + len(done) and kept.where("decision_type = 'delete_expired' AND status = 'success'").count() == 1
    assert workspace._execute("quarantine", False)["status"] == "skipped"
    workspace.embed_quality = lambda: 1 / 0
    assert workspace._execute("enrich_metadata")["status"] == "failed"


def test_freshness_report(workspace):
    text = workspace.freshness_report()
    assert text.startswith("Freshness Report (2024-03-01 00:00)") and "Expired assets:" in text and "(age: 10d)" in text
    workspace.save_freshness()
    assert workspace.state.read("freshness").count() == workspace.records().count()


def test_toolkit(workspace):
    kit = Toolkit(workspace)
    assert len(kit.definitions()) == 11
    assert json.loads(kit.call("governance_find_duplicates")) == {"count": 1, "ids": [1]}
    assert json.loads(kit.call("governance_validate"))["total"] > 0
    assert json.loads(kit.call("governance_state"))["needs_dedup"] is True
    assert "error" in json.loads(kit.call("nothing")) and "error" in json.loads(kit.call("governance_get_lineage"))
    path = workspace.root + "/knowledge/short_term/a.md"
    assert json.loads(kit.call("governance_profile_document", path=path))["verdict"] == "ingest"


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "store")
    rows = files.chunks_from_lists(spark, ["first text of the stream", "second text of the stream", "first  text of the stream", " "])
    rows.write.mode("append").parquet(source)
    stream = jobs.read_stream(spark, source, rows.schema)
    profiles = []
    for _ in range(2):
        jobs.ingest(stream, out, str(tmp_path / "cp"), F.lit(NOW).cast("timestamp_ntz"), lambda p, n: profiles.append(p.first().total)).awaitTermination()
        files.chunks_from_lists(spark, ["second text of the stream", "third text of the stream"]).write.mode("append").parquet(source)
    assert sorted(r.content for r in spark.read.parquet(out).collect()) == ["first text of the stream", "second text of the stream", "third text of the stream"]
    assert sum(profiles) == 6

    events = spark.createDataFrame([(NOW + timedelta(hours=h), "k", float(h), f"t{h // 6 % 3}") for h in range(0, 48, 6)], "ts timestamp_ntz, k string, v double, body string")
    events.select(F.col("ts").cast("timestamp").alias("ts"), "k", "v", "body").write.parquet(str(tmp_path / "ev"))
    ev = jobs.read_stream(spark, str(tmp_path / "ev"), "ts timestamp, k string, v double, body string")
    for name, df, n in (("w", jobs.windows(ev, "ts", F.col("v")), 2), ("s", jobs.sessions(ev, "ts", "k", "7 hours"), 1), ("d", jobs.drop_repeated(ev, "ts", "body", "2 days"), 3)):
        mode = "append" if name == "d" else "complete"
        q = df.writeStream.format("memory").queryName(f"q_{name}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"q_{name}").count() == n
    ticks = []
    q = jobs.periodic(spark, ticks.append, "1 second")
    for _ in range(60):
        if len(ticks) > 1:
            break
        time.sleep(0.5)
    assert jobs.status(q)["running"] and len(ticks) > 1
    q.stop()
    assert not jobs.status(q)["running"]
