"""The itinerary fold against a plain loop over days."""

import numpy as np
from pyspark.sql import functions as F

from outings.functions.vectors import HashEmbedder
from outings.plans.itinerary import generate_itinerary
from outings.settings import Settings

from datetime import date, timedelta

EMBEDDER = HashEmbedder(16)
WORDS = "lake museum river trail food art view walk summit garden".split()
START = date(2026, 5, 1)


def loop(trip_days, bad, ranked, outdoor, n):
    used, plan = set(), []
    for day in range(trip_days):
        indoor = day in bad
        pool = [a for a in ranked[indoor] if not (indoor and outdoor[a])]
        picks = [a for a in pool if a not in used][:n]
        used |= set(picks)
        plan += [(day, i + 1, a) for i, a in enumerate(picks)]
    return plan


def test_matches_a_loop(spark):
    rng = np.random.default_rng(11)
    names = {i: " ".join(rng.choice(WORDS, 3)) for i in range(60)}
    outdoor = {i: bool(rng.random() < 0.6) for i in names}
    vector = {i: EMBEDDER([t])[0].astype(float) for i, t in names.items()}
    activities = spark.createDataFrame(
        [(i, i % 3, names[i], outdoor[i], [float(x) for x in vector[i]] if i % 8 else None) for i in names],
        "activity_id long, destination_id long, name string, is_outdoor boolean, requirements_embedding array<float>")
    users = {1: ["lake", "food"], 2: [], 3: ["art"]}
    trips = [(t, int(rng.integers(1, 5)), int(rng.integers(0, 3)), int(rng.integers(1, 9))) for t in range(40)]
    trip_df = spark.createDataFrame([(t, u, d, START, START + timedelta(days=n - 1)) for t, u, d, n in trips],
                                    "trip_id long, user_id long, destination_id long, start_date date, end_date date")
    bad = {d: {int(x) for x in rng.choice(8, 4, replace=False)} for d in range(3)}
    weather = spark.createDataFrame(
        [(d, START + timedelta(days=k), 90 if k in bad[d] else 0) for d in range(3) for k in range(6)],
        "destination_id long, forecast_date date, precipitation_prob int").select(
        "*", F.lit(1.0).alias("temperature_c"), F.lit(0.0).alias("precipitation_mm"), F.lit(1).alias("us_aqi"))
    user_df = spark.createDataFrame(list(users.items()), "user_id long, interests array<string>")
    got = {}
    for r in generate_itinerary(trip_df, user_df, activities, weather, EMBEDDER, Settings(activities_per_day=2)).collect():
        got.setdefault(r.trip_id, []).append(((r.day_date - START).days, r.sort_order, r.activity_id))
    expected = {}
    for t, u, d, n in trips:
        interests = " ".join(users.get(u) or []) or "sightseeing"
        ranked = {}
        for indoor, kind in ((True, "indoor"), (False, "outdoor and indoor")):
            q = EMBEDDER([f"{interests} {kind} activities"])[0].astype(float)
            scores = sorted((-round(float(q @ vector[i] / np.linalg.norm(q) / np.linalg.norm(vector[i])), 9), i)
                            for i in names if i % 3 == d and i % 8)
            ranked[indoor] = [i for _, i in scores]
        plan = loop(n, {k for k in bad[d] if k < 6}, ranked, outdoor, 2)
        if plan:
            expected[t] = plan
    assert {t: sorted(p) for t, p in got.items()} == {t: sorted(p) for t, p in expected.items()}
