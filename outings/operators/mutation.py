"""Table changes as functions of snapshots.

A change takes the old snapshot and the rows to apply, and gives one frame: the new table with a column that says
how each row was changed. ``Mutation`` splits that frame into the new snapshot and the changed rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outings.functions.scalars import blank_to_null, clamp_day, iso_date
from outings.operators.keyed import assign_ids, highest, latest_per_key, number_in_group, rows_before_blocks, top_per_group
from outings.schemas import REFERENCES
from outings.sources.tables import finished, materialized

CHANGE = "_change"


@dataclass(frozen=True)
class Mutation:
    """``frame`` holds the new table, its ``_change`` being null for untouched rows."""

    frame: DataFrame
    removed: DataFrame | None = None

    @property
    def snapshot(self) -> DataFrame:
        return self.frame.drop(CHANGE)

    @property
    def changed(self) -> DataFrame:
        return self.frame.where(F.col(CHANGE).isNotNull())


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str],
           insert_values: Mapping[str, Column] | None = None, update_values: Mapping[str, Column] | None = None,
           newest_first: Sequence[Column] | None = None) -> Mutation:
    """Insert the source rows with a new key; for a known key set only the ``update`` columns.

    ``insert_values`` fill columns the source lacks, ``update_values`` set columns on a known key (a change time,
    say). The source must have one row per key; ``newest_first`` reduces it to that on the partitioning the join
    needs anyway.
    """
    if newest_first is not None:
        source = latest_per_key(source, keys, newest_first)
    source = source.select(*[c for c in source.columns if c in target.columns])
    insert_values, update_values = dict(insert_values or {}), dict(update_values or {})
    old = target.withColumn("_old", F.lit(True))
    new = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in source.columns if c not in keys],
                        F.lit(True).alias("_new"))
    merged = old.join(new, list(keys), "full")
    was_there, arrives = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def value(c: str) -> Column:
        incoming = F.col(f"_new_{c}") if c in source.columns else F.lit(None)
        if c in insert_values:
            incoming = F.coalesce(incoming, insert_values[c])
        if c in update_values:
            on_update = update_values[c]
        elif c in update:
            on_update = F.col(f"_new_{c}")
        else:
            on_update = F.col(c)
        return F.when(~was_there, incoming).when(arrives, on_update).otherwise(F.col(c))

    change = F.when(arrives & was_there, "updated").when(arrives, "inserted")
    columns = [F.col(c) if c in keys else value(c).cast(target.schema[c].dataType).alias(c) for c in target.columns]
    return Mutation(merged.select(*columns, change.alias(CHANGE)))


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str],
                  insert_values: Mapping[str, Column] | None = None,
                  first: Sequence[Column] | None = None) -> Mutation:
    """Insert the source rows whose key is not in the target; ``first`` picks one of several rows with one key."""
    if first is not None:
        source = top_per_group(source, keys, first, 1)
    insert_values = dict(insert_values or {})
    absent = source.join(target.select(*keys), list(keys), "left_anti")
    fields = {f.name: f.dataType for f in target.schema}
    columns = []
    for c in target.columns:
        incoming = F.col(c) if c in source.columns else F.lit(None)
        if c in insert_values:
            incoming = F.coalesce(incoming, insert_values[c])
        columns.append(incoming.cast(fields[c]).alias(c))
    inserted = absent.select(*columns, F.lit("inserted").alias(CHANGE))
    return Mutation(target.withColumn(CHANGE, F.lit(None).cast("string")).unionByName(inserted))


def insert_rows(target: DataFrame, rows: DataFrame, id_column: str, unique_key: Sequence[str],
                values: Mapping[str, Column] | None = None) -> Mutation:
    """Append rows with new ids after the highest one; columns the rows lack take ``values`` or null."""
    values = dict(values or {})
    numbered = assign_ids(rows, id_column, unique_key, highest(target, id_column))
    columns = [(F.col(c) if c in numbered.columns else values.get(c, F.lit(None))).cast(f.dataType).alias(c)
               for c, f in zip(target.columns, target.schema)]
    inserted = numbered.select(*columns, F.lit("inserted").alias(CHANGE))
    return Mutation(target.withColumn(CHANGE, F.lit(None).cast("string")).unionByName(inserted))


def partial_update(target: DataFrame, changes: DataFrame, key: str, values: Mapping[str, Column]) -> Mutation:
    """Set ``values`` on the rows whose key is in ``changes``, which has one row per key.

    In ``values`` the change columns carry the prefix ``_new_``.
    """
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key],
                         F.lit(True).alias("_new"))
    hit = F.col("_new").isNotNull()
    columns = [F.when(hit, values[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c)
               if c in values else F.col(c) for c in target.columns]
    merged = target.join(new, key, "left")
    return Mutation(merged.select(*columns, F.when(hit, "updated").alias(CHANGE)))


def move_items(items: DataFrame, moves: DataFrame, now: Column | None = None) -> Mutation:
    """Reschedule items: blank values and malformed days keep what is there, the status always changes.

    ``moves``: item_id, day_date (text), start_time, end_time, reason.
    """
    keep = {"start_time": "start_time", "end_time": "end_time", "reschedule_reason": "reason"}
    values = {c: F.coalesce(blank_to_null(f"_new_{n}"), F.col(c)) for c, n in keep.items()}
    values["day_date"] = F.coalesce(iso_date("_new_day_date"), F.col("day_date"))
    values["status"] = F.lit("rescheduled")
    values["updated_at"] = F.current_timestamp() if now is None else now
    return partial_update(items, moves, "item_id", {c: v for c, v in values.items() if c in items.columns})


def swap_items(items: DataFrame, swaps: DataFrame, now: Column | None = None) -> Mutation:
    """Give items another activity. ``swaps``: item_id, activity_id, title, reason."""
    values = {"activity_id": F.col("_new_activity_id"), "title": F.col("_new_title"),
              "status": F.lit("rescheduled"), "reschedule_reason": F.col("_new_reason"),
              "updated_at": F.current_timestamp() if now is None else now}
    return partial_update(items, swaps, "item_id", {c: v for c, v in values.items() if c in items.columns})


def append_in_group(target: DataFrame, requests: DataFrame, group: Sequence[str], sequence: str,
                    position: str = "sort_order", block_rows: int = 1_000_000) -> DataFrame:
    """The requests with the positions they take after the rows their group already has (from 1 if none).

    ``sequence`` is a unique whole-number column that says in which order the requests came. The requests are written once: they are
    counted and numbered. They meet the ends of their groups first, which deals them out as the numbering needs them. The result is
    written too, so the requests and the shuffles of this step do not stay beside those of the next.
    """
    def placed() -> DataFrame:
        written = materialized(requests, "requests")
        before = rows_before_blocks(written, group, sequence, block_rows)
        ends = target.groupBy(*group).agg(F.max(position).alias("_end"))
        numbered = number_in_group(written.join(ends, list(group), "left"), group, sequence, "_number", block_rows, before)
        return numbered.select(*requests.columns, (F.coalesce("_end", F.lit(0)) + F.col("_number")).cast("int").alias(position))

    return finished(requests.sparkSession, placed, "positions")


def add_items(items: DataFrame, requests: DataFrame, trips: DataFrame, activities: DataFrame,
              sequence: str = "request_id") -> DataFrame:
    """Rows to append to an itinerary, one per request.

    ``requests``: the sequence column, trip_id, day_date (text), title, activity_id, start_time, end_time, notes.
    The day is moved into the trip; an activity id that names no activity becomes null.
    """
    window = trips.select("trip_id", F.col("start_date").alias("_start"), F.col("end_date").alias("_end_day"))
    known = activities.select("activity_id", F.lit(True).alias("_known"))
    # What the join with the activities moves is what the row needs.
    dated = requests.join(window, "trip_id", "inner").select(
        sequence, "trip_id", clamp_day("day_date", "_start", "_end_day").alias("day_date"),
        F.coalesce("title", F.lit("Untitled")).alias("title"), "activity_id",
        blank_to_null("start_time").alias("start_time"), blank_to_null("end_time").alias("end_time"), "notes")
    rows = (dated.join(known, "activity_id", "left")
            .select(sequence, "trip_id", "day_date", "title", F.when(F.col("_known"), F.col("activity_id")).alias("activity_id"),
                    "start_time", "end_time", "notes", F.lit("planned").alias("status")))
    return append_in_group(items, rows, ["trip_id", "day_date"], sequence)


def delete_rows(target: DataFrame, doomed: DataFrame, on: Sequence[str]) -> Mutation:
    """Remove the rows whose key is in ``doomed``; ``removed`` is what went."""
    keys = doomed.select(*on)
    kept = target.join(keys, list(on), "left_anti")
    return Mutation(kept.withColumn(CHANGE, F.lit(None).cast("string")), target.join(keys, list(on), "left_semi"))


def delete_cascade(tables: Mapping[str, DataFrame], parent: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """Delete rows of ``parent`` by its key and follow the references of the child tables.

    Raises if a restricting reference still points at a doomed row.
    """
    tables = dict(tables)
    references = [r for r in REFERENCES if r.parent == parent and r.child in tables]
    for ref in references:
        keys = doomed.select(F.col(ref.key).alias(ref.column))
        if ref.on_delete == "restrict" and not tables[ref.child].join(keys, ref.column, "left_semi").isEmpty():
            raise ValueError(f"{ref.child}.{ref.column} still refers to rows of {parent}")
    for ref in references:
        keys = doomed.select(F.col(ref.key).alias(ref.column)).distinct()
        child = tables[ref.child]
        if ref.on_delete == "cascade":
            gone = child.join(keys, ref.column, "left_semi")
            tables[ref.child] = child.join(keys, ref.column, "left_anti").select(*child.columns)
            tables = delete_cascade(tables, ref.child, gone)
        elif ref.on_delete == "set null":
            marked = child.join(keys.withColumn("_gone", F.lit(True)), ref.column, "left")
            tables[ref.child] = marked.select(
                *[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == ref.column else F.col(c)
                  for c in child.columns])
    key = next((r.key for r in REFERENCES if r.parent == parent), None)
    if key is not None:
        tables[parent] = tables[parent].join(doomed.select(key), key, "left_anti").select(*tables[parent].columns)
    return tables


def align_trips(trips: DataFrame, weather: DataFrame, days: int = 3) -> Mutation:
    """Move each trip to the first forecast days of its destination."""
    first_days = top_per_group(weather.select("destination_id", "forecast_date").distinct(), ["destination_id"],
                               [F.col("forecast_date").asc_nulls_last()], days)
    spans = first_days.groupBy("destination_id").agg(F.min("forecast_date").alias("start_date"),
                                                     F.max("forecast_date").alias("end_date"))
    return partial_update(trips, spans, "destination_id",
                          {"start_date": F.col("_new_start_date"), "end_date": F.col("_new_end_date")})


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "item_id", column: str = "status") -> DataFrame:
    """Rows of ``after`` that are new or differ in ``column``."""
    old = before.select(key, F.col(column).alias("_old_value"), F.lit(True).alias("_old"))
    return (after.join(old, key, "left")
            .where(F.col("_old").isNull() | ~F.col(column).eqNullSafe(F.col("_old_value")))
            .select(*after.columns))
