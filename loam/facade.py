"""A workspace folder behind one object: knowledge/, chat_history/, memory/, a chunk store and state."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.config import DEFAULT, Config
from loam.operators import dedup, freshness, health, lineage, planner, profile, retrieval, rules
from loam.plans import checks
from loam.sources import files
from loam.sources.state import StateStore, append_history, markdown_report, unlink_expired, without


class Workspace:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None, as_of: datetime | None = None, config: Config = DEFAULT):
        self.spark, self.root, self.config = spark, str(Path(root)), config
        self.store = store or f"{self.root}/chunks"
        self.state = StateStore(spark, f"{self.root}/.governance")
        self._as_of = as_of
        self.rules = rules.RuleSets(config)

    @property
    def as_of(self) -> Column:
        return F.lit(self._as_of or datetime.now()).cast("timestamp_ntz")

    def _folder(self, name: str) -> str | None:
        path = Path(self.root, name)
        return str(path) if path.is_dir() and any(p.is_file() for p in path.rglob("*")) else None

    def chunks(self) -> DataFrame:
        return self._current() if Path(self.store).exists() else files.chunks_from_lists(self.spark, [])

    def _current(self) -> DataFrame:
        last = max((p.name for p in Path(self.store).glob("v*") if (p / "_SUCCESS").exists()), default=None)
        return files.read_chunks(self.spark, f"{self.store}/{last}" if last else self.store)

    def write_chunks(self, chunks: DataFrame) -> None:
        """The next snapshot of the store."""
        number = max((int(p.name[1:]) for p in Path(self.store).glob("v*")), default=0) + 1
        chunks.write.parquet(f"{self.store}/v{number:08d}")

    # --- checks ---

    def records(self) -> DataFrame:
        folder = self._folder("knowledge")
        if folder is None:
            found = self.spark.createDataFrame([], "asset_id string, rel_path string, category string, updated_at timestamp_ntz")
        else:
            found = files.file_times(self.spark, folder)
        return freshness.freshness_records(found, freshness.policies(self.spark, self.config), self.as_of)

    def memory_records(self) -> DataFrame | None:
        folder = self._folder("memory")
        if folder is None:
            return None
        notes = files.scan(self.spark, folder, (".md",)).select(F.concat(F.lit("memory:"), "name").alias("asset_id"), F.col("mtime").alias("updated_at"))
        return freshness.memory_records(notes, freshness.policies(self.spark, self.config), self.as_of)

    def profile_knowledge(self) -> DataFrame | None:
        folder = self._folder("knowledge")
        return profile.knowledge_base_profile(files.read_documents(self.spark, folder), self.chunks(), self.as_of, self.config) if folder else None

    def profile_document(self, path: str) -> DataFrame:
        found = files.read_documents(self.spark, str(Path(path).parent)).where(F.col("name") == Path(path).name)
        return retrieval.ingest_gate(profile.document_profile(found, self.as_of, self.config), self.config.quarantine_below)

    def profile_chunks(self) -> DataFrame:
        return profile.chunk_recommendations(profile.chunk_profile(self.chunks(), config=self.config))

    def problems(self) -> DataFrame:
        return profile.chunk_problems(self.chunks(), self.config)

    def health_check(self, record: bool = True) -> dict[str, DataFrame]:
        found = checks.health_check(self.chunks(), self.records(), self.as_of, self.config)
        if record:
            append_history(found["health"], found["components"], self.as_of, f"{self.root}/.governance/history")
            self.state.append("alerts", found["alerts"].join(self.state.read("alerts").select("id"), "id", "left_anti"))
        return found

    def report(self, path: str | None = None) -> str:
        found = self.health_check(record=False)
        return markdown_report(found["health"], found["components"], path)

    def validate_chunks(self) -> DataFrame:
        out = self.rules.validate("knowledge_chunks", self.chunks(), ["ordinal"])
        return rules.stop_after_error(out) if self.config.fail_on_error else out

    def validate_documents(self) -> DataFrame | None:
        folder = self._folder("knowledge")
        return self.rules.validate("document_files", files.scan(self.spark, folder, files.DOCUMENT_SUFFIXES).withColumn("found", F.lit(True)), ["path"]) if folder else None

    def validate_chat(self) -> DataFrame | None:
        folder = self._folder("chat_history")
        return self.rules.validate("chat_history", files.read_chat_lines(self.spark, folder), ["path", "line_num"]) if folder else None

    def validate_memory(self) -> DataFrame | None:
        folder = self._folder("memory")
        return self.rules.validate("memory", files.read_notes(self.spark, folder), ["path"]) if folder else None

    def validate_all(self) -> DataFrame:
        """All targets that are there, as (target, rule_name, passed, severity, category, message)."""
        parts = [(n, r) for n, r in (("chunks", self.validate_chunks()), ("documents", self.validate_documents()), ("chat", self.validate_chat()), ("memory", self.validate_memory())) if r is not None]
        out = None
        for name, part in parts:
            part = part.select(F.lit(name).alias("target"), "rule_name", "passed", "severity", "category", "message")
            out = part if out is None else out.unionByName(part)
        return out

    # --- changes ---

    def find_duplicates(self, semantic: bool = False, threshold: float | None = None) -> DataFrame:
        """(ordinal, removed_by) of what would go."""
        c = self.chunks()
        if semantic and "embedding" in c.columns:
            return dedup.two_phase(c, self.config.semantic_threshold if threshold is None else threshold)
        return dedup.exact_duplicates(c).where("NOT is_keep").select("ordinal", F.lit("hash").alias("removed_by"))

    def remove_duplicates(self, semantic: bool = False, threshold: float | None = None) -> DataFrame:
        """Writes the store without duplicates; returns how many went by which phase."""
        gone = self.find_duplicates(semantic, threshold)
        counted = self.spark.createDataFrame(gone.groupBy("removed_by").agg(F.count(F.lit(1)).alias("n")).collect(), "removed_by string, n long")
        self.write_chunks(without(self.chunks(), gone))
        return counted

    def embed_quality(self) -> DataFrame:
        base = self.chunks().select("ordinal", "chunk_id", "content", "metadata", *(["embedding"] if "embedding" in self.chunks().columns else []))
        self.write_chunks(retrieval.embed_quality(base, self.as_of, config=self.config))
        return retrieval.quality_summary(self.chunks())

    def record_ingestion(self, ingests: DataFrame) -> None:
        for name, rows in zip(("nodes", "edges"), lineage.record_ingestion(ingests)):
            self.state.append(name, rows)

    def record_web_cache(self, pages: DataFrame) -> None:
        for name, rows in zip(("nodes", "edges"), lineage.record_web_cache(pages)):
            self.state.append(name, rows)

    def record_chat_export(self, exports: DataFrame) -> None:
        for name, rows in zip(("nodes", "edges"), lineage.record_chat_export(exports)):
            self.state.append(name, rows)

    def lineage(self, node: str, up: bool = True) -> DataFrame:
        return lineage.chain(lineage.first_nodes(self.state.read("nodes")), self.state.read("edges"), self.spark.createDataFrame([(node,)], "node string"), up)

    def mermaid(self) -> str:
        return "\n".join(r.line for r in lineage.mermaid(lineage.first_nodes(self.state.read("nodes")), self.state.read("edges")).orderBy("part", "seq").collect())

    def alerts(self) -> DataFrame:
        return health.active(self.state.read("alerts"))

    def update_alert(self, alert_id: str, acknowledged: bool | None = None, resolved: bool | None = None) -> bool:
        there = self.state.read("alerts")
        if not there.where(F.col("id") == alert_id).limit(1).count():
            return False
        self.state.replace("alerts", health.update_alert(there, alert_id, acknowledged, resolved))
        return True

    # --- the cycle ---

    def agent_cycle(self, execute: bool = False, approved: Collection[str] = ()) -> dict[str, Any]:
        """Signals, decisions and plan; with execute, the safe decisions and those of the approved kinds are carried out. The last 100 cycles and executions are kept."""
        found = checks.agent_cycle(self.chunks(), self.records(), self.config)
        decided = [r.asDict() for r in planner.messages(found["decisions"]).collect()]
        row = found["signals"].first()
        self.state.append("cycles", self.spark.range(1).select(self.as_of.alias("ts"), F.lit(row.health_score).alias("health_score")))
        self.state.keep_newest("cycles")
        kinds = [d["decision_type"] for d in decided]
        done = [self._execute(k, k in planner.AUTO_SAFE or k in approved) for k in kinds] if execute else []
        if done:
            rows = self.spark.createDataFrame([(d["decision_type"], d["status"], d["affected"]) for d in done], "decision_type string, status string, affected long")
            self.state.append("executions", rows.withColumn("ts", self.as_of))
            self.state.keep_newest("executions")
        return {"signals": row.asDict(), "decisions": decided, "plan": found["plan"].first().asDict(), "executed": done}

    def _execute(self, kind: str, allowed: bool = True) -> dict[str, Any]:
        """Carries out one decision: 'success' with the rows or files it changed, 'skipped' without approval or a way to do it, 'failed' with the error."""
        handlers: dict[str, Callable[[], int]] = {
            "delete_duplicates": lambda: self._shrunk(self.remove_duplicates),
            "delete_empty_chunks": lambda: self._shrunk(lambda: self.write_chunks(without(self.chunks(), retrieval.noise_chunks(self.chunks())))),
            "quarantine": lambda: self._shrunk(lambda: self.write_chunks(without(self.chunks(), retrieval.quarantine_set(self.chunks())))),
            "delete_expired": lambda: len(unlink_expired(self.records(), f"{self.root}/knowledge", really=True)),
            "enrich_metadata": lambda: self.embed_quality().first().total,
            "no_action": lambda: 0,
        }
        if not allowed or kind not in handlers:
            return {"decision_type": kind, "status": "skipped", "affected": 0}
        try:
            return {"decision_type": kind, "status": "success", "affected": handlers[kind]()}
        except Exception as e:
            return {"decision_type": kind, "status": "failed", "affected": 0, "error": str(e)[:2000]}

    def _shrunk(self, change: Callable[[], Any]) -> int:
        before = self.chunks().count()
        change()
        return before - self.chunks().count()

    def freshness_report(self) -> str:
        return freshness.freshness_text(self.records(), self.as_of)

    def save_freshness(self) -> None:
        """The freshness records as the state's newest snapshot."""
        self.state.replace("freshness", self.records().withColumn("scan_time", self.as_of))

    def governance_state(self) -> DataFrame:
        row = checks.signals(self.chunks(), self.records(), self.config).row
        return planner.governance_state(row, health.trend(self.state.read("cycles")))

    def should_run(self) -> bool:
        return bool(planner.should_run(self.state.read("cycles"), self.as_of).first().run)

    def tick(self, execute: bool = True, on_alerts: Callable[[list[dict]], None] | None = None) -> dict[str, Any]:
        """One round of the run loop: a cycle if it is time, quality into the store, and alerts to the callback."""
        if not self.should_run():
            return {"ran": False}
        out = self.agent_cycle(execute)
        self.embed_quality()
        alerts = [r.asDict() for r in self.health_check()["alerts"].collect()]
        if alerts and on_alerts:
            on_alerts(alerts)
        return {"ran": True, **out, "alerts": len(alerts)}


class Toolkit:
    """The workspace as eleven named tools with JSON answers."""

    def __init__(self, workspace: Workspace):
        w = self.workspace = workspace
        rows = lambda df, n=50: [] if df is None else [r.asDict(recursive=True) for r in df.limit(n).collect()]
        one = lambda df: df.first().asDict(recursive=True)

        def validate() -> dict:
            found = w.validate_all()
            return {**one(rules.validation_summary(found)), "by_rule": rows(rules.failures_by_rule(found)), "failures": rows(found.where("NOT passed"), w.config.max_failures_listed)}

        def check_freshness() -> dict:
            r = w.records()
            return {**one(freshness.freshness_summary(r)), "stale": rows(freshness.stale_only(r).orderBy("asset_id"), 20), "expired": rows(freshness.expired(r).orderBy("asset_id"), 20)}

        nothing: dict[str, str] = {}
        self.tools: dict[str, tuple[str, dict[str, str], Callable[..., Any]]] = {
            "governance_agent_cycle": ("Run one cycle", {"execute": "boolean", "approved": "array"}, lambda execute=False, approved=(): w.agent_cycle(execute, approved)),
            "governance_state": ("The state of the knowledge base", nothing, lambda: one(w.governance_state())),
            "governance_health_check": ("Health and its components", nothing, lambda: (lambda f: {"health": one(f["health"]), "components": rows(f["components"]), "alerts": rows(f["alerts"])})(w.health_check())),
            "governance_find_duplicates": ("Chunks that duplicates would remove", {"semantic": "boolean"}, lambda semantic=False: (lambda g: {"count": g.count(), "ids": [r.ordinal for r in g.orderBy("ordinal").limit(100).collect()]})(w.find_duplicates(semantic))),
            "governance_remove_duplicates": ("Remove duplicate chunks", {"semantic": "boolean"}, lambda semantic=False: {r.removed_by: r.n for r in w.remove_duplicates(semantic).collect()}),
            "governance_validate": ("Check all rules", nothing, validate),
            "governance_check_freshness": ("Ages against policies", nothing, check_freshness),
            "governance_profile_document": ("Profile a file and say whether to ingest it", {"path": "string"}, lambda path: one(w.profile_document(path))),
            "governance_embed_quality": ("Write quality into the chunks", nothing, lambda: one(w.embed_quality())),
            "governance_get_alerts": ("Active alerts", nothing, lambda: rows(w.alerts(), 100)),
            "governance_get_lineage": ("What a node comes from or leads to", {"node": "string", "up": "boolean"}, lambda node, up=True: rows(w.lineage(node, up), 1000)),
        }

    def definitions(self) -> list[dict[str, Any]]:
        return [{"name": n, "description": d, "parameters": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}}} for n, (d, p, _) in self.tools.items()]

    def call(self, name: str, **arguments: Any) -> str:
        """The tool's answer as JSON; an unknown tool or a failure is an answer with error."""
        if name not in self.tools:
            return json.dumps({"error": f"unknown tool: {name}"})
        try:
            return json.dumps(self.tools[name][2](**arguments), default=str, ensure_ascii=False)
        except Exception as e:
            return json.dumps({"error": str(e)[:2000]})
