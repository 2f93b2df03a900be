"""Data-quality checks and the gate.

A check is a condition that bad rows meet. All checks of a table are counted in one pass over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.schemas import REFERENCES, Reference
from outings.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class RowCheck:
    """Rows of ``table`` that meet ``bad`` are counted under ``name``; checks with one name add up."""

    name: str
    table: str
    bad: Column
    detail: str
    severity: str = "error"


@dataclass(frozen=True)
class KeyCheck:
    """Keys of ``table`` that more than one row has."""

    name: str
    table: str
    keys: tuple[str, ...]
    detail: str
    severity: str = "error"


@dataclass(frozen=True)
class ReferenceCheck:
    """Rows whose reference finds no parent; a null reference finds none."""

    name: str
    references: tuple[Reference, ...]
    detail: str
    severity: str = "error"


Check = RowCheck | KeyCheck | ReferenceCheck


def outside(column: str, low: int, high: int) -> Column:
    return (F.col(column) < low) | (F.col(column) > high)


def _reference(child: str, parent: str) -> Reference:
    return next(r for r in REFERENCES if r.child == child and r.parent == parent)


def default_checks(settings: Settings = DEFAULTS) -> list[Check]:
    dim = settings.embedding_dim

    def wrong_length(vector: str) -> Column:
        return F.size(vector) != dim

    return [
        RowCheck("weather.forecast_ts not null", "weather_snapshots", F.col("forecast_ts").isNull(),
                 "null forecast_ts"),
        RowCheck("destinations have coordinates", "destinations",
                 F.col("latitude").isNull() | F.col("longitude").isNull(), "destinations missing lat/long"),
        RowCheck("us_aqi within 0-500", "weather_snapshots", outside("us_aqi", 0, 500),
                 "rows with out-of-range AQI"),
        RowCheck("precipitation_prob within 0-100", "weather_snapshots", outside("precipitation_prob", 0, 100),
                 "rows with out-of-range precip prob"),
        RowCheck("trips end_date >= start_date", "trips", F.col("end_date") < F.col("start_date"),
                 "trips with end before start"),
        RowCheck(f"embeddings are {dim}-dim", "destinations", wrong_length("description_embedding"),
                 "embeddings with wrong dimension"),
        RowCheck(f"embeddings are {dim}-dim", "activities", wrong_length("requirements_embedding"),
                 "embeddings with wrong dimension"),
        RowCheck("all activities embedded", "activities", F.col("requirements_embedding").isNull(),
                 "activities without an embedding", "warn"),
        ReferenceCheck("no orphan foreign keys",
                       (_reference("trips", "destinations"), _reference("itinerary_items", "trips"),
                        _reference("weather_snapshots", "destinations"), _reference("packing_items", "trips")),
                       "orphan rows"),
        ReferenceCheck("every trip has a user", (_reference("trips", "users"),), "trips without a user"),
        KeyCheck("weather_snapshots unique per (dest, hour)", "weather_snapshots",
                 ("destination_id", "forecast_ts"), "duplicate (destination_id, forecast_ts) keys"),
    ]


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def count_orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Their number. Child rows are counted per reference value first, so a frequent value is one row in the join."""
    values = child.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    return orphans(values, column, parent, key).agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("bad"))


def count_repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.agg(F.count_if(F.col("_rows") > 1).alias("bad"))


def reference_report(tables: Mapping[str, DataFrame], references: Sequence[Reference] = tuple(REFERENCES)) -> DataFrame:
    """Orphans per reference between the given tables."""
    report = None
    for r in references:
        if r.child not in tables or r.parent not in tables:
            continue
        part = count_orphans(tables[r.child], r.column, tables[r.parent], r.key).select(
            F.lit(r.child).alias("child"), F.lit(r.parent).alias("parent"), F.col("bad").alias("orphans"))
        report = part if report is None else report.unionByName(part)
    return report


def quality_report(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """One row per check: name, passed, detail, severity."""
    counted = []
    by_table: dict[str, list[RowCheck]] = {}
    for check in checks:
        if isinstance(check, RowCheck):
            by_table.setdefault(check.table, []).append(check)
        elif isinstance(check, KeyCheck):
            counted.append(_labelled(count_repeated_keys(tables[check.table], check.keys), check))
        else:
            counted.extend(_labelled(count_orphans(tables[r.child], r.column, tables[r.parent], r.key), check)
                           for r in check.references)
    for table, row_checks in by_table.items():
        counts = tables[table].agg(*[F.count_if(check.bad).alias(f"c{i}") for i, check in enumerate(row_checks)])
        labels = F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(c.detail).alias("what"),
                                    F.lit(c.severity).alias("severity"), F.col(f"c{i}").alias("bad"))
                           for i, c in enumerate(row_checks)])
        counted.append(counts.select(F.inline(labels)))
    rows = counted[0]
    for part in counted[1:]:
        rows = rows.unionByName(part)
    totals = rows.groupBy("name", "what", "severity").agg(F.sum("bad").alias("bad"))
    return totals.select("name", (F.col("bad") == 0).alias("passed"),
                         F.concat(F.col("bad").cast("string"), F.lit(" "), F.col("what")).alias("detail"), "severity")


def _labelled(count: DataFrame, check: Check) -> DataFrame:
    return count.select(F.lit(check.name).alias("name"), F.lit(check.detail).alias("what"),
                        F.lit(check.severity).alias("severity"), "bad")


def report_summary(report: DataFrame) -> DataFrame:
    """Whether the gate passes: no failed check of severity "error"."""
    failed = (F.col("severity") == "error") & ~F.col("passed")
    return (report.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(failed).alias("n_failed_errors"))
            .select((F.col("n_failed_errors") == 0).alias("passed"), "n_checks", "n_failed_errors"))


class QualityGateError(AssertionError):
    """Raised by the gate; the message lists the failed checks."""


def gate(report: DataFrame) -> list:
    """The report rows, one per check; raises if a check of severity "error" failed."""
    rows = report.collect()
    failed = sorted(f"{r['name']}: {r['detail']}" for r in rows if r["severity"] == "error" and not r["passed"])
    if failed:
        raise QualityGateError(f"data-quality gate failed: {failed}")
    return rows
