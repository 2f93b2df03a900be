"""Listings, nested trip records and summary counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DateType,
    DecimalType,
    MapType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from outings.functions.scalars import blurb


def trip_header(trips: DataFrame, destinations: DataFrame) -> DataFrame:
    places = destinations.select("destination_id", F.col("name").alias("destination"), "country", "latitude",
                                 "longitude")
    return (trips.join(places, "destination_id").orderBy("trip_id")
            .select("trip_id", "title", "start_date", "end_date", "status", "destination_id", "destination",
                    "country", "latitude", "longitude"))


def list_destinations(destinations: DataFrame) -> DataFrame:
    return (destinations.orderBy(F.col("name").asc_nulls_last())
            .select("destination_id", "name", "country", "latitude", "longitude",
                    blurb("description").alias("blurb")))


def trip_bundle(header: DataFrame, weather: DataFrame, items: DataFrame, packing: DataFrame) -> DataFrame:
    """Each trip with its weather days, items and packing list, as one nested record per trip, section and day.

    ``section`` is "weather", "itinerary" or "packing", and the list of that name holds the entries in display order; a
    packing list has no day. The layout is the same whatever the size of a trip, a record grows with one day or packing
    list only, and records in the order of (section, day) are the whole trip. A trip without entries has one record
    without a section. The entries of a section are dealt by trip and gathered on their own, so that only lists meet the header.
    """
    sections = {"weather": weather, "itinerary": items, "packing": packing}
    order = {"weather": ["forecast_date"], "itinerary": ["sort_order", "item_id"], "packing": ["category", "item_name"]}
    day = {"weather": F.col("forecast_date"), "itinerary": F.col("day_date"), "packing": F.lit(None)}
    entry = {name: F.struct(*order[name], *[c for c in df.columns
                                            if c not in (*order[name], "trip_id", "destination_id")])
             for name, df in sections.items()}

    def records(name: str) -> DataFrame:
        rows = sections[name].select("trip_id", day[name].cast("date").alias("day"), entry[name].alias(name))
        gathered = rows.repartition("trip_id").groupBy("trip_id", "day").agg(F.sort_array(F.collect_list(name)).alias(name))
        lists = [F.col(n) if n == name else _no_entries(sections[n], entry[n]).alias(n) for n in sections]
        return gathered.select("trip_id", F.lit(name).alias("section"), "day", *lists)

    return header.join(records("weather").unionByName(records("itinerary")).unionByName(records("packing")), "trip_id", "left")


def _no_entries(df: DataFrame, struct: Column) -> Column:
    return F.array().cast(ArrayType(df.select(struct.alias("x")).schema["x"].dataType))


def itinerary_by_day(items: DataFrame) -> DataFrame:
    """The items of every trip day as one list in display order."""
    columns = ["sort_order", "item_id", *[c for c in items.columns
                                          if c not in ("sort_order", "item_id", "trip_id", "day_date")]]
    return (items.groupBy("trip_id", "day_date")
            .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("items")))


def _plain(value: Column, kind: DataType) -> Column:
    """A value with its decimals as doubles and its dates and times as text, at any depth of lists, maps and structs."""
    if isinstance(kind, DecimalType):
        return value.cast("double")
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return value.cast("string")
    if not _has_plain_form(kind):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(
            _plain(e["key"], kind.keyType).alias("key"), _plain(e["value"], kind.valueType).alias("value"))))
    fields = F.struct(*[_plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.when(value.isNotNull(), fields)


def _has_plain_form(kind: DataType) -> bool:
    """Whether anything inside the type has to be converted."""
    if isinstance(kind, ArrayType):
        return _has_plain_form(kind.elementType)
    if isinstance(kind, MapType):
        return _has_plain_form(kind.keyType) or _has_plain_form(kind.valueType)
    if isinstance(kind, StructType):
        return any(_has_plain_form(f.dataType) for f in kind.fields)
    return isinstance(kind, (DecimalType, DateType, TimestampType, TimestampNTZType))


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Rows as JSON text: decimals as doubles, dates and times as text, nested ones too. Parts without such values are
    passed on as they are."""
    columns = [_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))


def row_counts(tables: Mapping[str, DataFrame], minimums: Mapping[str, int]) -> DataFrame:
    """Rows of every table against the minimum it should have."""
    report = None
    for name, df in tables.items():
        least = minimums.get(name, 0)
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(least).cast("long").alias("minimum"),
            (F.col("rows") >= least).alias("pass"))
        report = part if report is None else report.unionByName(part)
    return report


def distinct_counts(destinations: DataFrame, activities: DataFrame) -> DataFrame:
    """Countries, activity categories, and outdoor and indoor activities, as name and value."""
    countries = destinations.agg(F.count_distinct("country").alias("distinct_countries"))
    kinds = activities.agg(F.count_distinct("category").alias("distinct_activity_categories"),
                           F.count_if("is_outdoor").alias("outdoor_activities"),
                           F.count_if(~F.col("is_outdoor")).alias("indoor_activities"))
    return _name_value(countries, "metric").unionByName(_name_value(kinds, "metric"))


def items_per_day(items: DataFrame, trips: DataFrame) -> DataFrame:
    """Items counted per trip and day; the counting comes before the join."""
    counts = items.groupBy("trip_id", "day_date").agg(F.count(F.lit(1)).alias("items_that_day"))
    return counts.join(trips.select("trip_id", "title"), "trip_id").select("title", "day_date", "items_that_day")


def country_histogram(destinations: DataFrame) -> DataFrame:
    return (destinations.groupBy("country").agg(F.count(F.lit(1)).alias("destinations"))
            .orderBy(F.col("destinations").desc(), "country"))


def scale_summary(destinations: DataFrame, weather: DataFrame, vector: str = "description_embedding") -> DataFrame:
    """Destinations, countries, weather rows and embedded destinations, as name and value."""
    places = destinations.agg(F.count(F.lit(1)).alias("destinations"),
                              F.count_distinct("country").alias("countries"),
                              F.count_if(F.col(vector).isNotNull()).alias("embedded_destinations"))
    hours = weather.agg(F.count(F.lit(1)).alias("weather_rows"))
    return _name_value(places, "metric").unionByName(_name_value(hours, "metric"))


def _name_value(one_row: DataFrame, name: str) -> DataFrame:
    columns = one_row.columns
    return one_row.unpivot([], columns, name, "value")
