"""A small consistent data set: two users, three places, three trips, one of them planned and forecast."""

from datetime import date, datetime

from outings.schemas import DDL

USERS = [(1, "alex@example.com", "Alex", ["hiking", "photography", "food"], "Likes trails and local food."),
         (2, "sam@example.com", "Sam", ["museums", "architecture", "coffee"], "Prefers indoor sites.")]

PLACES = [(1, "Banff", "Canada", 51.1784, -115.5708, "America/Edmonton", "A resort town in the Rockies."),
          (2, "Kyoto", "Japan", 35.0116, 135.7681, "Asia/Tokyo", "Temples and gardens."),
          (3, "Springdale", "United States", 37.1889, -112.9986, "America/Denver", "Red-rock canyons.")]

ACTIVITIES = [(1, 1, "Johnston Canyon Hike", "hiking", True), (2, 1, "Lake Louise Canoeing", "water", True),
              (3, 1, "Banff Park Museum", "museum", False), (4, 1, "Banff Upper Hot Springs", "wellness", False),
              (5, 2, "Fushimi Inari Shrine", "landmark", True), (6, 2, "Kyoto National Museum", "museum", False),
              (7, 2, "Arashiyama Bamboo Grove", "nature", True), (8, 2, "Nishiki Market Food Walk", "food", False),
              (9, 3, "Angels Landing", "hiking", True), (10, 3, "The Narrows", "hiking", True),
              (11, 3, "Zion Human History Museum", "museum", False), (12, 3, "Emerald Pools Trail", "hiking", True)]

TRIPS = [(1, 1, 1, "Rockies Long Weekend", date(2026, 8, 14), date(2026, 8, 16)),
         (2, 1, 3, "Zion Canyon Trip", date(2026, 9, 4), date(2026, 9, 6)),
         (3, 2, 2, "Kyoto Culture Week", date(2026, 10, 10), date(2026, 10, 12))]

# item, activity, day, start, end, position
ITEMS = [(1, 1, 14, "08:00", "11:00", 1), (2, 2, 14, "13:00", "15:00", 2), (3, 4, 14, "16:00", "17:30", 3),
         (4, 3, 15, "09:00", "10:30", 1), (5, 2, 15, "11:00", "13:00", 2), (6, 4, 15, "15:00", "16:30", 3),
         (7, 1, 16, "08:30", "11:30", 1), (8, 3, 16, "12:30", "14:00", 2), (9, 4, 16, "15:00", "16:30", 3)]

# day, hour, temperature, rain mm, rain probability, wind, aqi
WEATHER = [(14, 9, 14.0, 0.0, 5, 8.0, 22), (14, 13, 19.0, 0.2, 10, 12.0, 25), (15, 9, 12.0, 4.5, 80, 20.0, 30),
           (15, 13, 13.0, 6.0, 85, 24.0, 34), (16, 9, 16.0, 0.0, 0, 6.0, 20), (16, 13, 21.0, 0.0, 0, 7.0, 18)]

PACKING = [("Hiking boots", "gear"), ("Rain jacket", "clothing"), ("Swimwear", "clothing"),
           ("Reusable water bottle", "gear"), ("Sunscreen SPF50", "health"), ("Park pass", "documents")]

NOW = datetime(2026, 8, 1)


def _frame(spark, table, rows):
    """Rows as dicts; columns that are not named are null."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(DDL[table]).names
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], DDL[table])


def seed_tables(spark):
    names = {a[0]: a[2] for a in ACTIVITIES}
    rows = {
        "users": [dict(user_id=i, email=e, display_name=d, interests=w, notes=n) for i, e, d, w, n in USERS],
        "destinations": [dict(destination_id=i, name=n, country=c, latitude=la, longitude=lo, timezone=tz, description=d)
                         for i, n, c, la, lo, tz, d in PLACES],
        "activities": [dict(activity_id=i, destination_id=d, name=n, category=c, is_outdoor=o, weather_sensitive=o,
                            tags=[]) for i, d, n, c, o in ACTIVITIES],
        "trips": [dict(trip_id=i, user_id=u, destination_id=d, title=t, start_date=s, end_date=e, status="planning")
                  for i, u, d, t, s, e in TRIPS],
        "itinerary_items": [dict(item_id=i, trip_id=1, activity_id=a, day_date=date(2026, 8, d), start_time=s,
                                 end_time=e, title=names[a], status="planned", sort_order=p)
                            for i, a, d, s, e, p in ITEMS],
        "weather_snapshots": [dict(snapshot_id=n, destination_id=1, captured_at=NOW,
                                   forecast_ts=datetime(2026, 8, d, h), forecast_date=date(2026, 8, d),
                                   temperature_c=t, precipitation_mm=mm, precipitation_prob=p, wind_kph=w, us_aqi=q,
                                   source="open-meteo") for n, (d, h, t, mm, p, w, q) in enumerate(WEATHER, 1)],
        "packing_items": [dict(packing_id=n, trip_id=1, item_name=i, category=c, quantity=1, reason="seed",
                               is_checked=n == 2) for n, (i, c) in enumerate(PACKING, 1)],
    }
    return {name: _frame(spark, name, table) for name, table in rows.items()}
