"""Validation rules as columns: a set of rules is evaluated in one scan, as an array of structs that is then inlined."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.config import DEFAULT, Config
from loam.functions import text as T

ERROR, WARNING, INFO = "error", "warning", "info"


@dataclass(frozen=True)
class Rule:
    """A predicate over a row. NULL counts as a failure of the check itself: it fails as an error, whatever the severity."""

    name: str
    predicate: Column | None
    severity: str = WARNING
    category: str = "validity"
    message: Column | str = ""
    enabled: bool = True

    def result(self) -> Column:
        if not self.enabled:
            passed, severity = F.lit(True), F.lit(self.severity)
        elif self.predicate is None:
            passed, severity = F.lit(False), F.lit(ERROR)
        else:
            passed = F.coalesce(self.predicate, F.lit(False))
            severity = F.when(self.predicate.isNull(), ERROR).otherwise(self.severity)
        message = self.message if isinstance(self.message, Column) else F.lit(self.message or self.name)
        return F.struct(F.lit(self.name).alias("rule_name"), passed.alias("passed"), severity.alias("severity"), F.lit(self.category).alias("category"), F.when(~passed, message).otherwise("ok").alias("message"))


def validate(rows: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """One row for each row and enabled rule: the kept columns, rule_name, passed, severity, category, message."""
    on = [r.result() for r in rules if r.enabled]
    if not on:
        on = [Rule("none", F.lit(True)).result()]
        rows = rows.limit(0)
    return rows.select(*keep, F.inline(F.array(*on)))


def chunk_rules(config: Config = DEFAULT) -> list[Rule]:
    x = F.col("content")
    return [
        Rule("chunk_not_empty", ~T.is_blank(x), ERROR, "completeness", "The chunk is empty"),
        Rule("chunk_min_length", F.when(x.isNotNull(), F.length(T.strip(x)) >= config.min_chunk_length), WARNING, "completeness", "The chunk is short"),
        Rule("chunk_max_length", F.length(x) <= config.max_chunk_length, WARNING, "consistency", "The chunk is long"),
        Rule("chunk_no_replacement_chars", ~x.contains("�"), WARNING, "validity", "The chunk has replacement characters"),
        Rule("chunk_no_control_chars", ~x.rlike(f"[{T.CONTROL}]"), WARNING, "validity", "The chunk has control characters"),
        Rule("chunk_has_source", F.coalesce(F.col("metadata")["source"], F.lit("")) != "", WARNING, "completeness", "The chunk names no source"),
    ]


FORMATS = (".txt", ".md", ".pdf", ".docx", ".xlsx")


def file_rules(max_bytes: int = 50 * 1024 * 1024) -> list[Rule]:
    """For rows of path, found, size and content (bytes)."""
    ext = T.suffix(F.col("path"))
    return [
        Rule("file_exists", F.col("found"), ERROR, "completeness", "The file is missing"),
        Rule("file_not_empty", F.coalesce(F.col("size"), F.lit(0)) > 0, ERROR, "completeness", "The file is empty"),
        Rule("file_supported_format", ext.isin(*FORMATS), ERROR, "validity", "The format is not supported"),
        Rule("file_size_reasonable", F.coalesce(F.col("size"), F.lit(0)) < max_bytes, WARNING, "validity", "The file is too large"),
        Rule("file_utf8_readable", F.when(ext.isin(".txt", ".md"), F.coalesce(F.expr("is_valid_utf8(CAST(content AS STRING))"), F.lit(False))).otherwise(True), WARNING, "validity", "The file is no UTF-8"),
    ]


def chat_rules() -> list[Rule]:
    """For rows of line. The three rules look at one line together."""
    line = F.col("line")
    return [
        Rule("jsonl_valid", T.valid_json(line), ERROR, "validity", "The line is no JSON"),
        Rule("message_has_role", T.has_key(line, "role"), ERROR, "completeness", "The message has no role"),
        Rule("message_has_content", T.json_truthy(line, "content") | T.json_truthy(line, "text"), WARNING, "completeness", "The message has no content"),
    ]


def memory_rules() -> list[Rule]:
    x = F.col("content")
    return [
        Rule("memory_not_empty", ~T.is_blank(x), WARNING, "completeness", "The note is empty"),
        Rule("memory_has_structure", T.has_heading(x), INFO, "consistency", "The note has no heading"),
    ]


class RuleSets:
    """Named sets of rules; a custom set replaces a built-in one of its name."""

    def __init__(self, config: Config = DEFAULT):
        self.sets: dict[str, list[Rule]] = {"knowledge_chunks": chunk_rules(config), "document_files": file_rules(), "chat_history": chat_rules(), "memory": memory_rules()}

    def register(self, name: str, rules: Sequence[Rule]) -> None:
        self.sets[name] = list(rules)

    def validate(self, name: str, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return validate(rows, self.sets[name], keep)


def stop_after_error(results: DataFrame, order: str = "ordinal") -> DataFrame:
    """The results up to the first row with a failed error, that row among them.

    The first such row is one number: an aggregate joined back, no window over everything.
    """
    first = results.where((F.col("severity") == ERROR) & ~F.col("passed")).agg(F.min(order).alias("_first"))
    return results.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.col(order) <= F.col("_first"))).drop("_first")


def validation_summary(results: DataFrame) -> DataFrame:
    """One row: total, passed, errors, warnings, infos, pass_rate (1 for no results)."""
    failed = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), failed(ERROR).alias("errors"), failed(WARNING).alias("warnings"), failed(INFO).alias("infos")).withColumn("pass_rate", F.coalesce(F.try_divide(F.col("passed").cast("double"), F.col("total")), F.lit(1.0)))


def failures_by_rule(results: DataFrame) -> DataFrame:
    return results.where("NOT passed").groupBy("rule_name").agg(F.count(F.lit(1)).alias("failures")).orderBy(F.desc("failures"), "rule_name")


def first_failures(results: DataFrame, order: Sequence[str], limit: int = 50) -> DataFrame:
    """The first failures of a report, in order."""
    return results.where("NOT passed").orderBy(*order, "rule_name").limit(limit)


def last_n(rows: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """The newest n rows: top-k on each partition, then over all."""
    return rows.orderBy(F.desc(order)).limit(n)

