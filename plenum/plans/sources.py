"""Sources and sinks on the driver tables."""

import uuid

from pyspark.sql import functions as F

from plenum.plans.registry import query
from plenum.schema.seeds import us_states
from plenum.session import materialize, shared_dir
from plenum.sources import io, merge
from plenum.sources.buckets import BucketedTable

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("table_scan", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
def table_scan(t):
    return t("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query(
    "seed_lookup",
    """WITH states AS (
      SELECT * FROM (VALUES
        (0,'Alabama'),(1,'Alaska'),(2,'Arizona'),(3,'Arkansas'),(4,'California'),(5,'Colorado'),
        (6,'Connecticut'),(7,'Delaware'),(8,'Florida'),(9,'Georgia'),(10,'Hawaii'),(11,'Idaho'),
        (12,'Illinois'),(13,'Indiana'),(14,'Iowa'),(15,'Kansas'),(16,'Kentucky'),(17,'Louisiana'),
        (18,'Maine'),(19,'Maryland'),(20,'Massachusetts'),(21,'Michigan'),(22,'Minnesota'),
        (23,'Mississippi'),(24,'Missouri')) v(pos, state_name))
    SELECT state_name, count(*) AS customers
    FROM customer JOIN states ON pos = c_nationkey GROUP BY state_name""",
)
def seed_lookup(t):
    """Customers per state, nation number n standing for the n-th seeded state."""
    codes = [r["state_code"] for r in us_states(t.spark).collect()]
    at = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("state_code")) - 1
    states = us_states(t.spark).select("state_name", at.cast("int").alias("c_nationkey"))
    people = t("customer", "c_nationkey").join(states, "c_nationkey")
    return people.groupBy("state_name").agg(F.count("*").alias("customers"))


@query(
    "insert_select",
    """SELECT o_orderkey, o_totalprice, 'stored' AS origin FROM orders WHERE o_orderstatus = 'F'
    UNION ALL
    SELECT o_orderkey, o_totalprice, 'inserted' FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def insert_select(t):
    orders = t("orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    target = orders.filter("o_orderstatus = 'F'").select(
        "o_orderkey", "o_totalprice", F.lit("stored").alias("origin")
    )
    source = orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")
    return io.insert_select(target, source, {"origin": F.lit("inserted")})


@query(
    "insert_if_absent",
    """WITH stored AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'),
    offered AS (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey,
        l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
        l_shipdate) AS pos
      FROM lineitem WHERE l_returnflag <> 'R')
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM stored
    UNION ALL
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM offered o
    WHERE pos = 1 AND NOT EXISTS (SELECT 1 FROM stored s
      WHERE s.l_orderkey = o.l_orderkey AND s.l_linenumber = o.l_linenumber)""",
)
def insert_if_absent(t):
    lines = t("lineitem", *LINE)
    merged = merge.insert_if_absent(
        lines.filter("l_returnflag = 'R'"),
        lines.filter("l_returnflag <> 'R'"),
        ["l_orderkey", "l_linenumber"],
        LINE[2:],
    )
    return merged.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")


@query(
    "upsert",
    """WITH delta AS (
      SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey,
        o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, 'changed' AS o_orderpriority
      FROM orders WHERE o_orderstatus <> 'O')
    SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority,
      coalesce(d.o_totalprice, o.o_totalprice) AS o_totalprice
    FROM orders o LEFT JOIN delta d ON d.o_orderkey = o.o_orderkey
    UNION ALL
    SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM delta
    WHERE o_orderstatus = 'P'""",
)
def upsert(t):
    """Finished orders come in with a new price, pending ones as new orders."""
    columns = ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"]
    key = F.col("o_orderkey")
    delta = t("orders", *columns, "o_orderstatus").filter("o_orderstatus <> 'O'").select(
        F.when(F.col("o_orderstatus") == "P", -key - 1).otherwise(key).alias("o_orderkey"),
        "o_custkey",
        F.lit("changed").alias("o_orderpriority"),
        (F.col("o_totalprice") + 1).alias("o_totalprice"),
    )
    target = t("orders", *columns)
    return merge.upsert(target, delta, ["o_orderkey"], ["o_totalprice"], ["o_totalprice", "o_custkey"])


REPLACE_SQL = """WITH stored AS (
      SELECT CASE WHEN role <> 'system' THEN conv_id END AS conv_id, turn, text FROM conversations),
    fresh AS (SELECT conv_id, turn - 6 AS turn, '~' || text AS text FROM conversations WHERE turn >= 6)
    SELECT conv_id, turn, text FROM stored
    WHERE conv_id IS NULL OR conv_id NOT IN (SELECT conv_id FROM fresh)
    UNION ALL SELECT conv_id, turn, text FROM fresh"""


@query("replace_by_key", REPLACE_SQL)
def replace_by_key(t):
    """Long conversations are replaced by their last turns; system turns have no parent."""
    return merge.replace_by_key(*conversations(t), "conv_id")


def conversations(t):
    rows = t("conversations", "conv_id", "turn", "role", "text")
    stored = rows.select(
        F.when(F.col("role") != "system", F.col("conv_id")).alias("conv_id"), "turn", "text"
    )
    fresh = rows.filter("turn >= 6").select(
        "conv_id", (F.col("turn") - 6).alias("turn"), F.concat(F.lit("~"), "text").alias("text")
    )
    return stored, fresh


@query("replace_in_buckets", REPLACE_SQL)
def replace_in_buckets(t):
    """The same, in a stored table of which only the buckets concerned are rewritten."""
    stored, fresh = conversations(t)
    path = f"{shared_dir(t.spark)}/buckets-{uuid.uuid4().hex}"
    table = BucketedTable(t.spark, path, stored.schema, ("conv_id",), 16)
    table.rewrite(stored, lambda old, new: old.unionByName(new))
    table.replace(fresh)
    return table.read()


ARCHIVED_SQL = """SELECT o.o_orderkey, o.o_totalprice, o.updated,
      TIMESTAMP '2026-01-01 00:00:00' AS archived_at
    FROM (SELECT o_orderkey, o_totalprice,
            CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS updated FROM orders) o
    JOIN (SELECT l_orderkey, max(l_shipdate) AS incoming FROM lineitem GROUP BY l_orderkey) n
      ON n.l_orderkey = o.o_orderkey
    WHERE o.updated IS NULL OR n.incoming > o.updated"""


def archived(t):
    """Orders about to be overwritten by a later shipment; pending orders stand for
    placeholders without an update date."""
    current = t("orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus").select(
        "o_orderkey", "o_totalprice",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("updated"),
    )
    incoming = t("lineitem", "l_orderkey", "l_shipdate").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("updated")
    )
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return merge.archive_changed(current, incoming, ["o_orderkey"], at, updated="updated")


query("archive_changed", ARCHIVED_SQL)(archived)


@query(
    "archive_children",
    f"""SELECT h.o_orderkey AS history_id, l.l_orderkey, l.l_linenumber, l.l_quantity
    FROM lineitem l JOIN ({ARCHIVED_SQL}) h ON h.o_orderkey = l.l_orderkey""",
)
def archive_children(t):
    """The history rows are written first, then their children are filed under them."""
    history = materialize(archived(t).withColumn("history_id", F.col("o_orderkey")), "history")
    children = t("lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return merge.archive_children(children, history, {"l_orderkey": "o_orderkey"}, "history_id")


@query(
    "enrich",
    """WITH stored AS (
      SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name END AS c_name, c_mktsegment,
        c_acctbal FROM customer),
    src AS (
      SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN -c_custkey - 1 ELSE c_custkey END AS c_custkey,
        upper(c_name) AS c_name,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE lower(c_mktsegment) END AS c_mktsegment
      FROM customer)
    SELECT s.c_custkey, coalesce(n.c_name, s.c_name) AS c_name,
      coalesce(n.c_mktsegment, s.c_mktsegment) AS c_mktsegment, s.c_acctbal
    FROM stored s LEFT JOIN src n ON n.c_custkey = s.c_custkey
    UNION ALL
    SELECT c_custkey, c_name, c_mktsegment, CAST(NULL AS DOUBLE) FROM src WHERE c_custkey < 0""",
)
def enrich(t):
    rows = t("customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    target = rows.withColumn("c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_name")))
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    src = rows.select(
        F.when(segment == "BUILDING", -key - 1).otherwise(key).alias("c_custkey"),
        F.upper("c_name").alias("c_name"),
        F.when(segment != "MACHINERY", F.lower(segment)).alias("c_mktsegment"),
    )
    return merge.enrich(target, src, ["c_custkey"], ["c_name", "c_mktsegment"], ["c_name"])


CASCADES = [
    ("orders", ["o_custkey"], "customer", ["c_custkey"]),
    ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
]


@query(
    "cascade_delete",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (
      SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
      WHERE c_mktsegment = 'FURNITURE')""",
)
def cascade_delete(t):
    """Line items left after deleting a market segment's customers."""
    tables = {
        "customer": t("customer", "c_custkey", "c_mktsegment"),
        "orders": t("orders", "o_orderkey", "o_custkey"),
        "lineitem": t("lineitem", "l_orderkey", "l_linenumber", "l_partkey"),
    }
    doomed = tables["customer"].filter("c_mktsegment = 'FURNITURE'").select("c_custkey")
    return merge.cascade_delete(tables, CASCADES, "customer", doomed)["lineitem"]


@query(
    "cascade_self_reference",
    """WITH RECURSIVE gone AS (
      SELECT doc_id FROM documents WHERE lang = 'de' AND doc_id % 4 = 1
      UNION SELECT d.doc_id FROM documents d JOIN gone g ON d.doc_id > 0 AND d.doc_id // 2 = g.doc_id)
    SELECT doc_id, quality FROM labels WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM gone)""",
)
def cascade_self_reference(t):
    """Labels left after deleting documents with all that derive from them; a document
    derives from the one with half its number."""
    derived = t("documents", "doc_id", "lang").withColumn("source_id", F.when(F.col("doc_id") > 0, F.floor(F.col("doc_id") / 2)))
    tables = {"documents": derived, "labels": t("labels", "doc_id", "quality")}
    doomed = derived.filter("lang = 'de' AND doc_id % 4 = 1").select("doc_id")
    cascades = [
        ("documents", ["source_id"], "documents", ["doc_id"]),
        ("labels", ["doc_id"], "documents", ["doc_id"]),
    ]
    return merge.cascade_delete(tables, cascades, "documents", doomed)["labels"]
