"""Seed rows of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.sources.io import seed

# Fixed values: (state_code, state_name, is_territory).
US_STATES = [
    ("AL", "Alabama", False), ("AK", "Alaska", False), ("AZ", "Arizona", False),
    ("AR", "Arkansas", False), ("CA", "California", False), ("CO", "Colorado", False),
    ("CT", "Connecticut", False), ("DE", "Delaware", False), ("FL", "Florida", False),
    ("GA", "Georgia", False), ("HI", "Hawaii", False), ("ID", "Idaho", False),
    ("IL", "Illinois", False), ("IN", "Indiana", False), ("IA", "Iowa", False),
    ("KS", "Kansas", False), ("KY", "Kentucky", False), ("LA", "Louisiana", False),
    ("ME", "Maine", False), ("MD", "Maryland", False), ("MA", "Massachusetts", False),
    ("MI", "Michigan", False), ("MN", "Minnesota", False), ("MS", "Mississippi", False),
    ("MO", "Missouri", False), ("MT", "Montana", False), ("NE", "Nebraska", False),
    ("NV", "Nevada", False), ("NH", "New Hampshire", False), ("NJ", "New Jersey", False),
    ("NM", "New Mexico", False), ("NY", "New York", False), ("NC", "North Carolina", False),
    ("ND", "North Dakota", False), ("OH", "Ohio", False), ("OK", "Oklahoma", False),
    ("OR", "Oregon", False), ("PA", "Pennsylvania", False), ("RI", "Rhode Island", False),
    ("SC", "South Carolina", False), ("SD", "South Dakota", False), ("TN", "Tennessee", False),
    ("TX", "Texas", False), ("UT", "Utah", False), ("VT", "Vermont", False),
    ("VA", "Virginia", False), ("WA", "Washington", False), ("WV", "West Virginia", False),
    ("WI", "Wisconsin", False), ("WY", "Wyoming", False), ("DC", "District of Columbia", True),
    ("PR", "Puerto Rico", True), ("GU", "Guam", True), ("AS", "American Samoa", True),
    ("VI", "Virgin Islands", True), ("MP", "Northern Mariana Islands", True),
]

# Fixed values: (code, name, description).
FINDING_TYPES = [
    ("topic_extraction", "Topic Extraction",
     "Topics and categories identified in the bill (Pass 1 — Haiku)"),
    ("bill_summary", "Bill Summary",
     "Concise summary of the bill content and intent (Pass 1 — Haiku)"),
    ("policy_analysis", "Policy Analysis",
     "Deeper analysis of policy implications and impact (Pass 2 — Sonnet)"),
    ("stance_detection", "Stance Detection",
     "Nuanced detection of political stances and positions (Pass 3 — Opus)"),
    ("pork", "Pork Barrel Spending",
     "Earmarks, directed spending, or provisions that benefit a specific district or interest group"),
    ("rider", "Policy Rider",
     "Unrelated provisions attached to a larger bill to ensure passage"),
    ("lobbying", "Lobbying Influence",
     "Provisions that appear to benefit specific lobbying interests"),
    ("constitutional", "Constitutional Concern",
     "Provisions that raise constitutional questions or challenges"),
    ("impact_analysis", "Impact Analysis",
     "Analysis of who is affected and how (Pass 2 — Sonnet)"),
    ("fiscal_estimate", "Fiscal Estimate",
     "Estimated cost, timeframe, and fiscal impact (Pass 2 — Sonnet)"),
    ("civil_liberties", "Civil Liberties Impact",
     "Impact on civil liberties, privacy, or individual rights"),
    ("environmental", "Environmental Impact",
     "Impact on the environment, climate, or natural resources"),
]

# Fixed values: (name, description, version, status).
UNCLASSIFIED = (
    "unclassified",
    "Reserved node for concept groups that match no taxonomy node.",
    0,
    "active",
)


def us_states(spark: SparkSession) -> DataFrame:
    return seed(spark, US_STATES, "state_code string, state_name string, is_territory boolean")


def finding_types(spark: SparkSession) -> DataFrame:
    return seed(spark, FINDING_TYPES, "code string, name string, description string")


def concept_taxonomy(spark: SparkSession) -> DataFrame:
    return seed(spark, [UNCLASSIFIED], "name string, description string, version int, status string")
