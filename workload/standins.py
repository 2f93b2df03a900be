"""Outing tables made from the test tables, in SQL that Spark and DuckDB both run.

A name in braces is a table or another view.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_bronze": """
SELECT user_id AS destination_id, date_trunc('hour', ts) AS forecast_ts, CAST(ts AS DATE) AS forecast_date,
       value * 0.1 - 5.0 AS temperature_c, value / 100.0 AS precipitation_mm,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS precipitation_prob,
       CAST((event_id * 7) % 180 AS INT) AS us_aqi, ts AS ingested_at, event_id
FROM {events}""",
    "v_weather": """
SELECT destination_id, forecast_ts, forecast_date, temperature_c, precipitation_mm, precipitation_prob, us_aqi
FROM (SELECT b.*, row_number() OVER (PARTITION BY destination_id, forecast_ts
                                     ORDER BY ingested_at DESC, event_id DESC) AS rn FROM {v_bronze} b) x
WHERE rn = 1""",
    "v_destinations": """
SELECT u.user_id AS destination_id, concat('dest_', u.user_id) AS name, n.n_name AS country,
       CAST((u.user_id * 37) % 180 - 90 AS DOUBLE) AS latitude,
       CAST((u.user_id * 73) % 360 - 180 AS DOUBLE) AS longitude, d.text AS description
FROM (SELECT DISTINCT user_id FROM {events}) u
JOIN {nation} n ON n.n_nationkey = u.user_id % 25
LEFT JOIN {documents} d ON d.doc_id = u.user_id""",
    "v_trips": """
SELECT o_orderkey AS trip_id, o_custkey AS user_id,
       o_custkey % (SELECT max(user_id) + 1 FROM {events}) AS destination_id,
       concat('trip_', o_orderkey) AS title,
       DATE '2024-01-01' + CAST(o_orderkey % 27 AS INT) AS start_date,
       DATE '2024-01-01' + CAST(o_orderkey % 27 + o_orderkey % 4 AS INT) AS end_date,
       CASE o_orderstatus WHEN 'O' THEN 'planning' WHEN 'P' THEN 'booked' ELSE 'complete' END AS status
FROM {orders}""",
    "v_activities": """
SELECT p_partkey AS activity_id, p_partkey % (SELECT max(user_id) + 1 FROM {events}) AS destination_id,
       concat(p_name, ' ', p_partkey) AS name, lower(p_type) AS category, p_size % 2 = 0 AS is_outdoor,
       CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE e.embedding END AS requirements_embedding
FROM {part} LEFT JOIN {embeddings} e ON e.vec_id = p_partkey % (SELECT max(vec_id) + 1 FROM {embeddings})""",
    "v_items": """
SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS trip_id, l_partkey AS activity_id,
       t.start_date + CAST(l_linenumber % (l_orderkey % 4 + 1) AS INT) AS day_date,
       concat('item_', l_partkey) AS title,
       CASE WHEN l_linestatus = 'O' THEN 'planned' ELSE 'done' END AS status, l_linenumber AS sort_order
FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                     ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn
      FROM {lineitem} l) x
JOIN {v_trips} t ON t.trip_id = x.l_orderkey
WHERE rn = 1""",
    "v_packing": """
SELECT l_orderkey AS trip_id, p_name AS item_name, min(p_brand) AS category, CAST(sum(l_quantity) AS INT) AS quantity
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
GROUP BY l_orderkey, p_name""",
    "v_users": """
SELECT c_custkey AS user_id, concat(c_name, '@example.com') AS email, lower(c_mktsegment) AS interest,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS notes
FROM {customer}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str, built: dict[str, DataFrame] | None = None) -> DataFrame:
    """A test table or a stand-in view as a frame. ``built`` keeps the frames, so that each is made once."""
    built = {} if built is None else built
    if name not in built:
        if name in VIEWS:
            inputs = {used: table(spark, sf_dir, used, built) for used in dict.fromkeys(_NAME.findall(VIEWS[name]))}
            built[name] = spark.sql(VIEWS[name], **inputs)
        else:
            built[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return built[name]


@lru_cache(maxsize=None)
def _closure(name: str) -> tuple[str, ...]:
    found: list[str] = []
    for used in dict.fromkeys(_NAME.findall(VIEWS[name])):
        if used in VIEWS:
            found.extend(v for v in _closure(used) if v not in found)
    return (*found, name)


def sql(query: str, ctes: dict[str, str] | None = None) -> str:
    """A DuckDB statement with the views it names in front. ``ctes`` are further views, in order."""
    own = dict(ctes or {})
    needed: list[str] = []
    for text in (*own.values(), query):
        for used in _NAME.findall(text):
            if used in VIEWS:
                needed.extend(v for v in _closure(used) if v not in needed)
    parts = {name: VIEWS[name] for name in needed} | own
    plain = {name: _NAME.sub(r"\1", text) for name, text in parts.items()}
    prefix = ",\n".join(f"{name} AS ({text})" for name, text in plain.items())
    body = _NAME.sub(r"\1", query)
    return f"WITH {prefix}\n{body}" if prefix else body
