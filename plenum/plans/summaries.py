"""Aggregations and ordered-per-key operators on the driver tables."""

from pyspark.sql import functions as F

from plenum.operators import aggregates, ids, windows
from plenum.operators.scoring import advance_stage
from plenum.plans.projections import LABELED_SQL, labeled
from plenum.plans.registry import query
from plenum.sources.io import seed


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(t):
    return aggregates.row_count(t("lineitem", "l_orderkey"))


@query(
    "null_count",
    f"""SELECT count(*) FILTER (quality IS NULL) AS quality,
      count(*) FILTER (lang IS NULL) AS lang FROM ({LABELED_SQL})""",
)
def null_count(t):
    return aggregates.null_count(labeled(t), "quality", "lang")


@query("next_id", "SELECT greatest(coalesce(max(o_orderkey), 1), 1) AS next_id FROM orders")
def next_id(t):
    return ids.next_id(t("orders", "o_orderkey"), "o_orderkey")


@query(
    "list_columns",
    """SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS columns
    FROM lineitem GROUP BY l_orderkey""",
)
def list_columns(t):
    lines = t("lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return aggregates.list_cols(lines, ["l_orderkey"], "l_returnflag", "l_linenumber")


RESULTS_SQL = """SELECT user_id, CASE event_type WHEN 'error' THEN 'failed'
      WHEN 'signup' THEN 'skipped' ELSE 'success' END AS status,
      CASE WHEN event_type = 'error' THEN
        CASE WHEN value < 50 THEN 'Transient' ELSE 'Systemic' END END AS error_class
    FROM events"""

ROLLUP_SQL = f"""SELECT user_id, count(*) AS items_processed,
      count(*) FILTER (status = 'success') AS items_succeeded,
      count(*) FILTER (status = 'failed') AS items_failed
    FROM ({RESULTS_SQL}) GROUP BY user_id"""


def results(t):
    """Events as per-item results of a step per user."""
    kind = F.col("event_type")
    return t("events", "user_id", "event_type", "value").select(
        "user_id",
        F.when(kind == "error", "failed").when(kind == "signup", "skipped").otherwise("success").alias("status"),
        F.when(kind == "error", F.when(F.col("value") < 50, "Transient").otherwise("Systemic")).alias("error_class"),
    )


@query("rollup_results", ROLLUP_SQL)
def rollup_results(t):
    return aggregates.rollup_results(results(t), ["user_id"], "status")


@query(
    "run_status",
    f"""SELECT *, CASE WHEN items_failed = 0 THEN 'completed'
      WHEN items_failed < items_processed THEN 'completed_with_errors' ELSE 'failed' END AS status
    FROM ({ROLLUP_SQL})""",
)
def run_status(t):
    return aggregates.derive_status(rollup_results(t))


@query(
    "errors_by_class",
    f"""SELECT user_id, count(*) FILTER (error_class = 'Transient') AS transient,
      count(*) FILTER (error_class = 'Systemic') AS systemic FROM ({RESULTS_SQL}) GROUP BY user_id""",
)
def errors_by_class(t):
    return aggregates.errors_by_class(
        results(t), ["user_id"], "error_class", {"Transient": "transient", "Systemic": "systemic"}
    )


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(t):
    return aggregates.dup_keys(t("lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query(
    "null_profile_diff",
    """SELECT 'o_totalprice' AS column_name, count(*) FILTER (o_orderstatus = 'P') AS nulls_a,
      0 AS nulls_b FROM orders
    UNION ALL SELECT 'o_orderpriority', 0, count(*) FILTER (o_totalprice > 400000) FROM orders""",
)
def null_profile_diff(t):
    columns = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    orders = t("orders", *columns, "o_orderstatus")
    live = orders.withColumn("o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    mirror = orders.withColumn(
        "o_orderpriority", F.when(F.col("o_totalprice") <= 400000, F.col("o_orderpriority"))
    )
    return aggregates.null_profile_diff(live, mirror, columns)


@query(
    "retry_state",
    """SELECT user_id, retry_count, max_retries,
      CASE WHEN retry_count >= max_retries THEN 'exhausted' ELSE 'retryable' END AS state
    FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS retry_count,
        count(*) FILTER (event_type = 'signup') AS max_retries FROM events GROUP BY user_id)""",
)
def retry_state(t):
    steps = t("events", "user_id", "event_type").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("retry_count"),
        F.count_if(F.col("event_type") == "signup").alias("max_retries"),
    )
    return aggregates.retry_state(steps)


@query(
    "latest_per_key",
    """SELECT event_id, user_id, ts, event_type FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events) WHERE pos = 1""",
)
def latest_per_key(t):
    return windows.latest(t("events", "event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


@query(
    "dedupe_keep_first",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem) WHERE pos = 1""",
)
def dedupe_keep_first(t):
    order = ["l_partkey", "l_suppkey", "l_quantity"]
    lines = t("lineitem", "l_orderkey", "l_linenumber", *order)
    return windows.dedupe_keep_first(lines, ["l_orderkey", "l_linenumber"], order)


@query(
    "score_trend",
    """SELECT event_id, user_id, ts, value, lag(value) OVER w AS previous,
      value - lag(value) OVER w AS delta
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def score_trend(t):
    return windows.trend(
        t("events", "event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value",
        F.to_date("ts"),
    )


@query(
    "assign_ids",
    """SELECT c_name, 1000 + row_number() OVER (ORDER BY md5(c_name), c_name) AS id FROM customer""",
)
def assign_ids(t):
    return ids.assign_ids(t("customer", "c_name"), "c_name", after=1000)


@query(
    "advance_stage",
    """SELECT key AS o_orderkey, stage FROM (
      SELECT key, stage, row_number() OVER (PARTITION BY key ORDER BY
        CASE stage WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'R' THEN 3 WHEN 'F' THEN 3 END DESC NULLS LAST,
        stage IS NULL, old DESC, stage DESC) AS pos
      FROM (SELECT o_orderkey AS key, CASE o_orderpriority WHEN '1-URGENT' THEN 'X'
            WHEN '5-LOW' THEN o_orderstatus WHEN '2-HIGH' THEN 'F' END AS stage, 1 AS old FROM orders
          UNION ALL
          SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'R' ELSE l_linestatus END, 0
          FROM lineitem WHERE l_quantity < 10))
    WHERE pos = 1""",
)
def stages(t):
    """Some orders have no stage yet, some an unknown one; two stages share a rank."""
    ranks = seed(t.spark, [("P", 1), ("O", 2), ("R", 3), ("F", 3)], "stage string, rank int")
    priority = F.col("o_orderpriority")
    current = t("orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select(
        "o_orderkey",
        F.when(priority == "1-URGENT", "X").when(priority == "5-LOW", F.col("o_orderstatus"))
        .when(priority == "2-HIGH", "F").alias("stage"),
    )
    lines = t("lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity").filter("l_quantity < 10")
    flag = F.col("l_returnflag")
    incoming = lines.select(
        F.col("l_orderkey").alias("o_orderkey"), F.when(flag == "R", flag).otherwise(F.col("l_linestatus")).alias("stage")
    )
    return advance_stage(current, incoming, ranks, ["o_orderkey"], "stage")


@query(
    "seniority",
    """SELECT s_suppkey, s_nationkey, rank, CAST(seniority AS INTEGER) AS seniority FROM (SELECT *, row_number() OVER (
        PARTITION BY s_nationkey ORDER BY rank NULLS LAST, s_suppkey) AS seniority
      FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS rank
        FROM supplier)) WHERE seniority <= 3""",
)
def seniority(t):
    members = t("supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(
        "s_suppkey", "s_nationkey",
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("rank"),
    )
    return windows.seniority(members, ["s_nationkey"], "rank", ["s_suppkey"], 3)


@query("display_order", "SELECT p_partkey, p_size, p_name FROM part ORDER BY p_size, p_partkey")
def display_order(t):
    return windows.in_order(t("part", "p_partkey", "p_size", "p_name"), ["p_size"], ["p_partkey"])


@query("global_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def global_order(t):
    return windows.in_order(
        t("orders", "o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc()], ["o_orderkey"]
    )


@query(
    "highlights",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_discount, CAST(position AS INTEGER) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY l_partkey
        ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS position FROM lineitem)
    WHERE position <= 3""",
)
def highlights(t):
    lines = t("lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_discount")
    return windows.highlights(lines, ["l_partkey"], "l_discount", ["l_orderkey", "l_linenumber"], 3)
