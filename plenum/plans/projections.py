"""Filters, predicates, scalar functions and chunking on the driver tables."""

from pyspark.sql import functions as F

from plenum.functions import scalar
from plenum.functions.text import chunk, reassemble
from plenum.operators import filters
from plenum.operators.joins import normalize_codes
from plenum.plans.registry import query

LABELED_SQL = """SELECT d.doc_id, d.lang, l.quality FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def labeled(t):
    """Every document with its quality label, NULL where it has none."""
    return t("documents", "doc_id", "lang").join(t("labels", "doc_id", "quality"), "doc_id", "left")


@query("where_null", f"SELECT doc_id, lang FROM ({LABELED_SQL}) WHERE quality IS NULL")
def where_null(t):
    return filters.where_null(labeled(t), "quality").select("doc_id", "lang")


@query("where_present", f"SELECT * FROM ({LABELED_SQL}) WHERE quality IS NOT NULL")
def where_present(t):
    return filters.where_present(labeled(t), "quality").select("doc_id", "lang", "quality")


@query(
    "needs_refresh",
    """SELECT d.doc_id, d.source AS expected, 'src' || l.quality AS stored
    FROM (SELECT doc_id, CASE WHEN lang <> 'fr' THEN source END AS source FROM documents) d
    LEFT JOIN labels l ON l.doc_id = d.doc_id
    WHERE d.source IS NOT NULL AND d.source IS DISTINCT FROM 'src' || l.quality""",
)
def needs_refresh(t):
    bills = t("documents", "doc_id", "lang", "source").select(
        "doc_id", F.when(F.col("lang") != "fr", F.col("source")).alias("expected")
    )
    versions = t("labels", "doc_id", "quality").select(
        "doc_id", F.concat(F.lit("src"), F.col("quality").cast("string")).alias("stored")
    )
    return filters.needs_refresh(
        bills, versions, version_id="doc_id", expected="expected", stored="stored"
    )


@query(
    "normalize_codes",
    """SELECT c.c_custkey, CASE WHEN c.c_acctbal < 0 THEN substr(r.r_name, 1, 2)
        WHEN c.c_mktsegment = 'MACHINERY' THEN 'Atlantis' ELSE substr(r.r_name, 1, 2) END AS place
    FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
    JOIN region r ON r.r_regionkey = n.n_regionkey""",
)
def normalize(t):
    """Region names in any case become two-letter codes; codes and unknown names stay."""
    region = t("region", "r_regionkey", "r_name")
    places = (
        t("customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        .join(t("nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "c_custkey",
            F.when(F.col("c_acctbal") < 0, F.substring("r_name", 1, 2))
            .when(F.col("c_mktsegment") == "MACHINERY", "Atlantis")
            .otherwise(F.lower("r_name"))
            .alias("place"),
        )
    )
    codes = region.select("r_name", F.substring("r_name", 1, 2).alias("code"))
    return normalize_codes(places, "place", codes, "r_name", "code")


@query(
    "range_predicates",
    """SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem
    WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_tax > 0 AND l_tax <= 0.05 AND l_quantity >= 10""",
)
def range_predicates(t):
    return (
        t("lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
        .filter(scalar.in_range("l_discount", 0.02, 0.06))
        .filter(scalar.in_range("l_tax", 0, 0.05, open_low=True))
        .filter(scalar.in_range("l_quantity", 10))
        .drop("l_quantity")
    )


@query(
    "membership",
    "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')",
)
def membership(t):
    return filters.one_of(t("events", "event_id", "event_type"), "event_type", ["click", "view"])


@query(
    "like_patterns",
    """SELECT p_partkey, p_name FROM part
    WHERE p_name LIKE 's%' AND p_name NOT LIKE '%ring' AND p_type <> 'PROMO'""",
)
def like_patterns(t):
    parts = filters.like(t("part", "p_partkey", "p_name", "p_type"), "p_name", "s%")
    parts = filters.like(parts, "p_name", "%ring", negate=True)
    return parts.filter(F.col("p_type") != "PROMO").select("p_partkey", "p_name")


@query(
    "named_subset",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 100",
)
def named_subset(t):
    subsets = {
        "costly_errors": (F.col("event_type") == "error") & (F.col("value") > 100),
        "signups": F.col("event_type") == "signup",
    }
    events = t("events", "event_id", "user_id", "value", "event_type")
    return filters.subset(events, "costly_errors", subsets).drop("event_type")


@query(
    "value_mapping",
    """SELECT o_orderkey,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low'
        ELSE o_orderpriority END AS kept,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' END AS strict,
      CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done'
        ELSE 'other' END AS searched
    FROM orders""",
)
def value_mapping(t):
    names = {"1-URGENT": "urgent", "5-LOW": "low"}
    searched = scalar.first_match(
        [(F.col("o_totalprice") > 300000, "large"), (F.col("o_orderstatus") == "F", "done")], "other"
    )
    return t("orders", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus").select(
        "o_orderkey",
        scalar.map_values("o_orderpriority", names).alias("kept"),
        scalar.map_values("o_orderpriority", names, "null").alias("strict"),
        searched.alias("searched"),
    )


@query("case_functions", "SELECT p_partkey, upper(p_name) AS upper_name, lower(p_type) AS lower_type FROM part")
def case_functions(t):
    return t("part", "p_partkey", "p_name", "p_type").select(
        "p_partkey", F.upper("p_name").alias("upper_name"), F.lower("p_type").alias("lower_type")
    )


@query(
    "text_length",
    "SELECT doc_id, length(text) AS text_length, length(text) = n_chars AS declared FROM documents",
)
def text_length(t):
    return t("documents", "doc_id", "text", "n_chars").select(
        "doc_id",
        F.length("text").cast("long").alias("text_length"),
        (F.length("text") == F.col("n_chars")).alias("declared"),
    )


@query(
    "coalesce_greatest",
    f"""SELECT doc_id, coalesce(quality, -1) AS quality,
      greatest(coalesce(quality, -1), 0) AS floor_zero FROM ({LABELED_SQL})""",
)
def coalesce_greatest(t):
    quality = F.coalesce("quality", F.lit(-1))
    return labeled(t).select(
        "doc_id", quality.alias("quality"), F.greatest(quality, F.lit(0)).alias("floor_zero")
    )


@query(
    "casts",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS user_text, event_type,
      CASE WHEN event_type IN ('click', 'view') THEN event_type END AS browsing FROM events""",
)
def casts(t):
    known = ["signup", "error", "click", "view", "purchase"]
    return t("events", "event_id", "user_id", "event_type").select(
        "event_id",
        F.col("user_id").cast("string").alias("user_text"),
        scalar.to_domain("event_type", known).alias("event_type"),
        scalar.to_domain("event_type", known[2:4], strict=False).alias("browsing"),
    )


@query(
    "array_functions",
    """SELECT p_partkey, element, CAST(list_position([p_brand, p_type], element) AS BIGINT) AS at,
      array_to_string([p_brand, p_type], '+') AS joined, 0 AS topics
    FROM (SELECT *, unnest([p_brand, p_type]) AS element FROM part)""",
)
def array_functions(t):
    pair = F.array("p_brand", "p_type")
    return (
        t("part", "p_partkey", "p_brand", "p_type")
        .withColumns({"pair": pair, "none": scalar.empty_array("string")})
        .select("p_partkey", "pair", "none", F.explode("pair").alias("element"))
        .select(
            "p_partkey",
            "element",
            F.array_position("pair", F.col("element")).alias("at"),
            F.array_join("pair", "+").alias("joined"),
            F.size("none").alias("topics"),
        )
    )


@query(
    "natural_keys",
    """SELECT o_orderkey, k AS vote_key, CAST(split_part(k, '-', 1) AS INTEGER) AS congress,
      split_part(k, '-', 2) AS chamber, CAST(split_part(k, '-', 3) AS BIGINT) AS roll
    FROM (SELECT o_orderkey, year(o_orderdate) || '-' || o_orderstatus || '-' || o_orderkey AS k
      FROM orders)""",
)
def natural_keys(t):
    key = scalar.natural_key(F.year("o_orderdate"), "o_orderstatus", "o_orderkey")
    keyed = t("orders", "o_orderkey", "o_orderdate", "o_orderstatus").select(
        "o_orderkey", key.alias("vote_key")
    )
    parts = scalar.parse_key("vote_key", ["congress", "chamber", "roll"], ["int", "string", "bigint"])
    return keyed.select("o_orderkey", "vote_key", *parts)


@query(
    "load_stamp",
    "SELECT o_orderkey, TIMESTAMP '2026-01-01 12:00:00' AS created_at, 36 AS id_length FROM orders",
)
def load_stamp(t):
    stamped = scalar.with_uuid(scalar.stamp(t("orders", "o_orderkey"), "2026-01-01 12:00:00"))
    at = F.col("created_at").cast("timestamp_ntz").alias("created_at")
    return stamped.select("o_orderkey", at, F.length("id").alias("id_length"))


@query(
    "text_chunks",
    """SELECT doc_id, CAST(i AS INTEGER) AS chunk_index,
      substring(text, CAST(i * 400 + 1 AS BIGINT), 500) AS content
    FROM (SELECT doc_id, text,
        unnest(range(greatest(CAST(ceil((length(text) - 100) / 400.0) AS BIGINT), 1))) AS i
      FROM documents WHERE length(text) > 0)""",
)
def text_chunks(t):
    return chunk(t("documents", "doc_id", "text"), "text", 500, 100)


@query(
    "text_chunks_bytes",
    """SELECT doc_id, CAST(i AS INTEGER) AS chunk_index,
      substring(bytes, CAST(i * 1800 + 1 AS BIGINT), 2000) AS content_hex
    FROM (SELECT doc_id, bytes,
        unnest(range(greatest(CAST(ceil((length(bytes) / 2 - 100) / 900.0) AS BIGINT), 1))) AS i
      FROM (SELECT doc_id, hex(encode(text)) AS bytes FROM documents) WHERE length(bytes) > 0)""",
)
def text_chunks_bytes(t):
    pieces = chunk(t("documents", "doc_id", "text"), "text", 1000, 100, unit="bytes")
    return pieces.select("doc_id", "chunk_index", F.hex("content").alias("content_hex"))


@query(
    "reassemble",
    """SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id""",
)
def reassemble_turns(t):
    turns = t("conversations", "conv_id", "turn", "text")
    return reassemble(turns, ["conv_id"], "turn", "text", separator="|")


@query("reassemble_chunks", "SELECT doc_id, text AS content FROM documents WHERE length(text) > 0")
def reassemble_chunks(t):
    """Texts cut into overlapping chunks and put back together."""
    chunks = chunk(t("documents", "doc_id", "text"), "text", 500, 100)
    return reassemble(chunks, ["doc_id"], "chunk_index", "content", overlap=100)
