"""Reference lists a planner maintains by hand, and their CSV reader."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

# They must equal the published seed lists for results to match.
CALENDAR_EVENTS = [
    ("Ganesh Chaturthi", "festival", date(2025, 8, 27), 11),
    ("Navratri", "festival", date(2025, 9, 22), 9),
    ("Dussehra", "festival", date(2025, 10, 2), 1),
    ("Diwali", "festival", date(2025, 10, 20), 5),
    ("Christmas", "festival", date(2025, 12, 25), 2),
    ("New Year", "festival", date(2026, 1, 1), 2),
    ("Makar Sankranti", "festival", date(2026, 1, 14), 2),
    ("Maha Shivaratri", "festival", date(2026, 2, 15), 1),
    ("Holi", "festival", date(2026, 3, 3), 2),
    ("Gudi Padwa", "festival", date(2026, 3, 19), 1),
    ("Eid al-Fitr", "festival", date(2026, 3, 20), 2),
    ("Ram Navami", "festival", date(2026, 3, 26), 1),
    ("Akshaya Tritiya", "festival", date(2026, 4, 19), 1),
    ("Independence Day", "festival", date(2026, 8, 15), 1),
    ("Raksha Bandhan", "festival", date(2026, 8, 28), 1),
    ("IPL 2026", "sports_season", date(2026, 3, 20), 70),
]

# Half-open bands of days to expiry.
DTE_BANDS = [
    ("0-1d", 0, 1, 1),
    ("1-2d", 1, 2, 2),
    ("2-3d", 2, 3, 3),
    ("3-5d", 3, 5, 4),
    ("5-7d", 5, 7, 5),
    ("7d+", 7, 9999, 6),
]

PROMOTIONS = [
    ("PROMO-MD-30", "markdown", "platform", 0.30),
    ("PROMO-MD-50", "markdown", "platform", 0.50),
    ("PROMO-DEAL11", "deal_11", "brand", None),
]

SEED_SCHEMAS = {
    "calendar_events": "event_name string, event_type string, start_date date, duration_days int",
    "dte_bands": "band string, min_days int, max_days int, sort_order int",
    "promotions": "promo_id string, promo_type string, funding_source string, contracted_depth_pct double",
}
SEED_ROWS = {
    "calendar_events": CALENDAR_EVENTS,
    "dte_bands": DTE_BANDS,
    "promotions": PROMOTIONS,
}


def seed(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(SEED_ROWS[name], SEED_SCHEMAS[name])


def read_seed_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The same list from a CSV file with a header, under its declared schema."""
    return spark.read.csv(path, header=True, schema=SEED_SCHEMAS[name])
