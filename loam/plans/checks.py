"""The health check and the planner's cycle as plans: each signal is computed once, from one scan of the chunks per shuffle key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.config import DEFAULT, Config
from loam.operators import dedup, freshness, health, planner, profile, rules
from loam.storage import written


@dataclass(frozen=True)
class Signals:
    components: DataFrame
    row: DataFrame


def signals(chunks: DataFrame, records: DataFrame, config: Config = DEFAULT) -> Signals:
    """Quality, validation, duplicates and freshness as component rows and as the planner's row.

    The four one-row results are written once and used by both.
    """
    quality = profile.chunk_profile(chunks, config=config).select("overall", "issues", "total")
    duplicates = dedup.duplicate_stats(chunks)
    checked = rules.validation_summary(rules.validate(chunks, rules.chunk_rules(config)))
    fresh = freshness.freshness_summary(records)
    one = quality.crossJoin(duplicates.drop("total_items")).crossJoin(checked.withColumnsRenamed({"total": "checks"})).crossJoin(fresh.withColumnsRenamed({"total": "assets"}))
    one = written(one)
    components = health.health_components(one, one.select(F.col("checks").alias("total"), "passed"), one, one)
    row = planner.signals(health.health_score(components), one, one, one, one)
    return Signals(components, row)


def health_check(chunks: DataFrame, records: DataFrame, as_of, config: Config = DEFAULT) -> dict[str, DataFrame]:
    """Components, the score and the alerts that follow."""
    found = signals(chunks, records, config)
    score = health.health_score(found.components)
    return {"components": found.components, "health": score, "alerts": health.with_state(health.health_alerts(score, found.components, as_of, config.alert_threshold))}


def agent_cycle(chunks: DataFrame, records: DataFrame, config: Config = DEFAULT) -> dict[str, DataFrame]:
    """Signals, the ordered decisions and the plan."""
    row = signals(chunks, records, config).row
    decided = planner.decisions(row)
    return {"signals": row, "decisions": planner.ordered(decided), "plan": planner.action_plan(decided, row)}
