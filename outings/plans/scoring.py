"""Outcome scoring of recorded assistant runs.

A run is scored from its transcript (run_id, step, tool, error) and from table snapshots before and after it. Each
scorer gives one row per run: run_id, task, passed, detail.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _result(df: DataFrame, task: str, passed: Column, *detail: Column) -> DataFrame:
    return df.select("run_id", F.lit(task).alias("task"), F.coalesce(passed, F.lit(False)).alias("passed"),
                     F.concat(*detail).alias("detail"))


def _text(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def tool_fired(runs: DataFrame, transcript: DataFrame, task: str, tool: str) -> DataFrame:
    """Passes if the run used the tool; a run that broke off with an error fails."""
    broken = F.col("error").isNotNull() if "error" in transcript.columns else F.lit(False)
    used = transcript.groupBy("run_id").agg(
        F.bool_or(F.col("tool") == tool).alias("fired"), F.bool_or(broken).alias("broken"),
        F.array_join(F.sort_array(F.collect_set("tool")), ", ").alias("tools"))
    scored = runs.select("run_id").join(used, "run_id", "left")
    return _result(scored, task, F.col("fired") & ~F.col("broken"), F.lit("tools="),
                   F.coalesce("tools", F.lit("")))


def count_change(runs: DataFrame, before: DataFrame, after: DataFrame, task: str,
                 exactly: int | None = None) -> DataFrame:
    """Passes if a run has more rows after than before, or exactly ``exactly`` more."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))

    scored = (runs.select("run_id").join(count(before, "n_before"), "run_id", "left")
              .join(count(after, "n_after"), "run_id", "left")
              .na.fill(0, ["n_before", "n_after"]))
    grown = F.col("n_after") - F.col("n_before")
    return _result(scored, task, grown > 0 if exactly is None else grown == exactly, F.lit("before="),
                   _text(F.col("n_before")), F.lit(" after="), _text(F.col("n_after")))


def no_outdoor_on_bad_day(runs: DataFrame, before: DataFrame, after: DataFrame, bad_days: DataFrame,
                          task: str) -> DataFrame:
    """Passes if there were planned outdoor items and none is left on a bad day.

    ``before`` and ``after``: run_id, day_date, status, is_outdoor. ``bad_days``: run_id, day_date.
    """
    planned = F.col("is_outdoor") & (F.col("status") == "planned")
    there = before.where(planned).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_before"))
    left = (after.where(planned).join(bad_days.select("run_id", "day_date"), ["run_id", "day_date"], "left_semi")
            .groupBy("run_id").agg(F.count(F.lit(1)).alias("n_left")))
    scored = (runs.select("run_id").join(there, "run_id", "left").join(left, "run_id", "left")
              .na.fill(0, ["n_before", "n_left"]))
    return _result(scored, task, (F.col("n_before") > 0) & (F.col("n_left") == 0), F.lit("outdoor_before="),
                   _text(F.col("n_before")), F.lit(" still_on_bad_day_after="), _text(F.col("n_left")))


def every_change_has_reason(runs: DataFrame, after: DataFrame, task: str) -> DataFrame:
    """Passes if items were rescheduled and each says why."""
    has_reason = F.coalesce(F.col("reschedule_reason") != "", F.lit(False))
    counts = (after.where(F.col("status") == "rescheduled").groupBy("run_id")
              .agg(F.count(F.lit(1)).alias("n_changed"), F.count_if(has_reason).alias("n_reasons")))
    scored = runs.select("run_id").join(counts, "run_id", "left").na.fill(0, ["n_changed", "n_reasons"])
    return _result(scored, task, (F.col("n_changed") > 0) & (F.col("n_changed") == F.col("n_reasons")),
                   F.lit("rescheduled="), _text(F.col("n_changed")), F.lit(" with_reason="),
                   _text(F.col("n_reasons")))


def combine(results: Sequence[DataFrame]) -> DataFrame:
    rows = results[0]
    for part in results[1:]:
        rows = rows.unionByName(part)
    return rows


def score(results: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Passed over all tasks as "k/n", and the pass rate; over everything, or per run or task."""
    totals = results.groupBy(*per).agg(F.count_if("passed").alias("n_pass"), F.count(F.lit(1)).alias("n_tasks"))
    return totals.select(*per, F.concat(F.col("n_pass").cast("string"), F.lit("/"), F.col("n_tasks").cast("string"))
                         .alias("score"), F.bround(F.col("n_pass") / F.col("n_tasks"), 3).alias("pass_rate"))


@dataclass(frozen=True)
class Recording:
    """What recorded runs left behind. Each run is asked to find indoor activities, reschedule for the weather,
    build a packing list, add one item, and judge the air; ``transcript`` has the ``task`` of every step.

    The snapshots have ``run_id`` in place of the trip; items also have ``is_outdoor``.
    """

    transcript: DataFrame
    reschedule: tuple[DataFrame, DataFrame]
    packing: tuple[DataFrame, DataFrame]
    addition: tuple[DataFrame, DataFrame]
    bad_days: DataFrame


@dataclass(frozen=True)
class Task:
    """A predicate over one run: aggregates of the run's rows (see ``recorded_rows``) and, from them, passed and detail."""

    name: str
    measures: Mapping[str, Column]
    passed: Column
    detail: Column


def _counted(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def tool_task(name: str, step: str, tool: str) -> Task:
    """Passes if the run used the tool in its step, and the step did not break off."""
    own = F.col("source") == f"step:{step}"
    key = f"{step}_{tool}"
    tools = F.array_join(F.sort_array(F.collect_set(F.when(own, F.col("tool")))), ", ")
    return Task(name, {f"{key}_fired": F.bool_or(own & (F.col("tool") == tool)), f"{key}_broken": F.bool_or(own & F.col("broken")),
                       f"{key}_tools": tools},
                F.col(f"{key}_fired") & ~F.coalesce(f"{key}_broken", F.lit(False)), F.concat(F.lit("tools="), F.col(f"{key}_tools")))


def growth_task(name: str, table: str, exactly: int | None = None) -> Task:
    """Passes if the table has more rows of the run after than before, or exactly so many more."""
    before, after = (F.col(f"{table}_{when}") for when in ("before", "after"))
    grown = after - before
    return Task(name, {f"{table}_{when}": _counted(F.col("source") == f"{table}:{when}") for when in ("before", "after")},
                grown > 0 if exactly is None else grown == exactly,
                F.concat(F.lit("before="), before.cast("string"), F.lit(" after="), after.cast("string")))


def bad_day_task(name: str) -> Task:
    """Passes if there were planned outdoor items and none is left on a bad day."""
    there, left = F.col("outdoor_before"), F.col("outdoor_left")
    planned = F.col("is_outdoor") & (F.col("status") == "planned")
    return Task(name, {"outdoor_before": _counted((F.col("source") == "items:before") & planned),
                       "outdoor_left": _counted((F.col("source") == "items:after") & planned & F.col("bad_day"))},
                (there > 0) & (left == 0),
                F.concat(F.lit("outdoor_before="), there.cast("string"), F.lit(" still_on_bad_day_after="), left.cast("string")))


def reason_task(name: str) -> Task:
    """Passes if items were rescheduled and each says why."""
    changed, told = F.col("n_changed"), F.col("n_reasons")
    moved = (F.col("source") == "items:after") & (F.col("status") == "rescheduled")
    return Task(name, {"n_changed": _counted(moved), "n_reasons": _counted(moved & (F.col("reason") != ""))},
                (changed > 0) & (changed == told),
                F.concat(F.lit("rescheduled="), changed.cast("string"), F.lit(" with_reason="), told.cast("string")))


def golden_tasks() -> tuple[Task, ...]:
    """The six tasks of an evaluation."""
    return (tool_task("retrieval: searches for indoor activities", "retrieval", "search_activities"),
            bad_day_task("reschedule: no outdoor item left on a bad day"),
            reason_task("reschedule: every change has a reason"),
            growth_task("packing: list is created", "packing"),
            growth_task("add: exactly one item added", "addition", 1),
            tool_task("grounding: checks weather before answering", "grounding", "weather_by_day"))


ROWS = {"source": "string", "tool": "string", "broken": "boolean", "is_outdoor": "boolean", "status": "string", "bad_day": "boolean",
        "reason": "string"}


def recorded_rows(recording: Recording) -> DataFrame:
    """What the runs left behind as rows of one layout: run_id, source (table and state), and the columns that tasks look at."""
    def rows(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select("run_id", *[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in ROWS.items()])

    steps = recording.transcript
    broken = F.col("error").isNotNull() if "error" in steps.columns else F.lit(False)
    out = rows(steps, source=F.concat(F.lit("step:"), F.col("task")), tool=F.col("tool"), broken=broken)
    for name, states in (("packing", recording.packing), ("addition", recording.addition)):
        for when, df in zip(("before", "after"), states):
            out = out.unionByName(rows(df, source=F.lit(f"{name}:{when}")))
    before, after = recording.reschedule
    bad = recording.bad_days.select("run_id", "day_date", F.lit(True).alias("bad_day")).distinct()
    after = after.join(bad, ["run_id", "day_date"], "left")
    state = {"is_outdoor": F.col("is_outdoor"), "status": F.col("status")}
    out = out.unionByName(rows(before, source=F.lit("items:before"), **state))
    return out.unionByName(rows(after, source=F.lit("items:after"), **state, bad_day=F.coalesce("bad_day", F.lit(False)),
                                reason=F.col("reschedule_reason")))


def evaluate_tasks(runs: DataFrame, rows: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """run_id, task, passed, detail. The measures of all tasks are one aggregation by run, whatever the number of tasks; runs
    without any row have the measures of no rows."""
    measures = {name: value for task in tasks for name, value in task.measures.items()}
    asked = runs.select("run_id").distinct()
    every = asked.select("run_id", *[F.lit(None).cast(kind).alias(name) for name, kind in ROWS.items()], F.lit(True).alias("asked"))
    rows = rows.select("run_id", *ROWS, F.lit(False).alias("asked")).unionByName(every)
    measured = rows.groupBy("run_id").agg(F.bool_or("asked").alias("asked"), *[v.alias(n) for n, v in measures.items()]).where("asked")
    results = F.array(*[F.struct(F.lit(t.name).alias("task"), F.coalesce(t.passed, F.lit(False)).alias("passed"), t.detail.alias("detail"))
                        for t in tasks])
    return measured.select("run_id", F.inline(results))


def evaluate_runs(runs: DataFrame, recording: Recording) -> DataFrame:
    """The results of every run in the six tasks, from one aggregation over all that was recorded."""
    return evaluate_tasks(runs, recorded_rows(recording), golden_tasks())
