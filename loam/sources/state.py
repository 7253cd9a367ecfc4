"""State as immutable snapshots and append-only tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALERTS = "id string, kind string, level string, title string, message string, source string, as_of timestamp_ntz, acknowledged boolean, resolved boolean"
NODES = "id string, name string, node_type string, metadata map<string,string>, seq long"
EDGES = "source string, target string, operation string, seq long"
CYCLES = "ts timestamp_ntz, health_score double"
EXECUTIONS = "ts timestamp_ntz, decision_type string, status string, affected long"
HISTORY = "ts timestamp_ntz, overall double, status string, components map<string,double>"
FRESHNESS = "asset_id string, category string, updated_at timestamp_ntz, is_stale boolean, is_expired boolean, freshness_score double, scan_time timestamp_ntz"
SCHEMAS = {"alerts": ALERTS, "nodes": NODES, "edges": EDGES, "cycles": CYCLES, "executions": EXECUTIONS, "history": HISTORY, "freshness": FRESHNESS}


class StateStore:
    """Tables below one folder of a file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _snapshots(self, name: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """The last whole snapshot and what was appended since; an empty table if there is none."""
        there = self._snapshots(name)
        if not there:
            return self.spark.createDataFrame([], SCHEMAS[name])
        base = max((s for s in there if s.startswith("s")), default="", key=lambda s: s[1:])
        paths = [s for s in there if s == base or (s.startswith("a") and s[1:] > base[1:])]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.root}/{name}/{s}" for s in paths))

    def _next(self, name: str, kind: str) -> str:
        there = self._snapshots(name)
        number = max((int(s[1:]) for s in there), default=0) + 1
        return f"{self.root}/{name}/{kind}{number:08d}"

    def append(self, name: str, rows: DataFrame) -> None:
        fields = [f.split(" ")[0] for f in _columns(SCHEMAS[name])]
        rows.select(*fields).write.parquet(self._next(name, "a"))

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new snapshot; readers see the old one until it is whole."""
        fields = [f.split(" ")[0] for f in _columns(SCHEMAS[name])]
        rows.select(*fields).write.parquet(self._next(name, "s"))

    def keep_newest(self, name: str, n: int = 100, order: str = "ts") -> None:
        self.replace(name, self.read(name).orderBy(F.desc(order)).limit(n))


def _columns(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return out


def append_history(score: DataFrame, components: DataFrame, as_of, path: str) -> None:
    """One JSON line with the time, the score, the status and all components."""
    parts = components.agg(F.map_from_entries(F.collect_list(F.struct("name", "score"))).alias("components"))
    score.crossJoin(parts).select(as_of.alias("ts"), "overall", "status", "components").write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path)


def without(chunks: DataFrame, removed: DataFrame, key: str = "ordinal") -> DataFrame:
    """The next snapshot without the removed rows: the DELETE of a table format without one."""
    return chunks.join(removed.select(key), key, "left_anti")


def unlink_expired(records: DataFrame, root: str, really: bool = False) -> list[str]:
    """Files whose policy says delete; they are unlinked only if really is set. A list of paths, of files of one folder."""
    paths = [f"{root}/{r.rel_path}" for r in records.where("is_expired AND action = 'delete'").select("rel_path").toLocalIterator()]
    if really:
        for p in paths:
            if os.path.isfile(p):
                os.unlink(p)
    return paths


def markdown_report(score: DataFrame, components: DataFrame, path: str | None = None) -> str:
    """The health report as Markdown, from one row and at most four components."""
    top = score.first()
    lines = ["# Health", "", f"Overall: {top.overall:.1%} ({top.status})", "", "| component | score | weight |", "|---|---|---|"]
    lines += [f"| {r.name} | {r.score:.1%} | {r.weight:.0%} |" for r in components.orderBy("score").collect()]
    out = "\n".join(lines) + "\n"
    if path:
        Path(path).write_text(out)
    return out
