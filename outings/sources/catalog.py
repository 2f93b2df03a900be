"""The built-in destination catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Destination name and country.
DESTINATIONS = (
    ("Banff", "Canada"), ("Whistler", "Canada"), ("Kyoto", "Japan"), ("Springdale", "United States"),
    ("Moab", "United States"), ("Sedona", "United States"), ("Flagstaff", "United States"),
    ("Asheville", "United States"), ("Boulder", "United States"), ("Jackson", "United States"),
    ("Reykjavik", "Iceland"), ("Queenstown", "New Zealand"), ("Interlaken", "Switzerland"),
    ("Zermatt", "Switzerland"), ("Chamonix", "France"), ("Cusco", "Peru"), ("Cape Town", "South Africa"),
    ("Puerto Natales", "Chile"), ("Ubud", "Indonesia"), ("Pokhara", "Nepal"), ("Chiang Mai", "Thailand"),
    ("Ljubljana", "Slovenia"), ("Bergen", "Norway"), ("Innsbruck", "Austria"), ("Hobart", "Australia"),
)


def destination_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DESTINATIONS, "name string, country string")
