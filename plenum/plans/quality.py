"""Integrity rules and table evolution on the driver tables."""

from pyspark.sql import functions as F

from plenum.operators import evolve, quality
from plenum.plans.projections import LABELED_SQL, labeled
from plenum.plans.registry import query


@query(
    "check_not_null",
    f"SELECT doc_id, 'quality_not_null' AS rule FROM ({LABELED_SQL}) WHERE quality IS NULL",
)
def check_not_null(t):
    return quality.violations(labeled(t), ["doc_id"], quality.not_null("quality"), quality.not_null("lang"))


@query(
    "check_unique",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def check_unique(t):
    keys = ["l_orderkey", "l_linenumber"]
    return quality.unique_violations(t("lineitem", *keys), keys)


@query(
    "check_unique_partial",
    """SELECT lang, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NOT NULL AND source <> 'src0' GROUP BY ALL HAVING count(*) > 1""",
)
def check_unique_partial(t):
    """A partial key: rows outside the predicate and rows with a NULL do not count."""
    rows = t("documents", "doc_id", "lang", "source").join(t("labels", "doc_id", "quality"), "doc_id", "left")
    return quality.unique_violations(rows, ["lang", "quality"], where=F.col("source") != "src0")


@query(
    "check_xor",
    """SELECT d.doc_id, 'quality_xor_item_id' AS rule FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id
    WHERE (l.quality IS NULL) = (b.item_id IS NULL)""",
)
def check_xor(t):
    items = t("benchmark", "item_id").withColumn("doc_id", F.col("item_id"))
    rows = labeled(t).join(items, "doc_id", "left")
    return quality.violations(rows, ["doc_id"], quality.exactly_one("quality", "item_id"))


@query(
    "check_range",
    """SELECT l_orderkey, l_linenumber, unnest(list_filter([
        CASE WHEN NOT l_discount BETWEEN 0 AND 0.09 THEN 'l_discount_range' END,
        CASE WHEN NOT (l_tax > 0 AND l_tax <= 1) THEN 'l_tax_range' END], lambda r: r IS NOT NULL)) AS rule
    FROM lineitem""",
)
def check_range(t):
    lines = t("lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return quality.violations(
        lines, ["l_orderkey", "l_linenumber"],
        quality.within("l_discount", 0, 0.09), quality.within("l_tax", 0, 1, open_low=True),
    )


@query(
    "check_conditional_presence",
    """SELECT event_id, 'name_presence' AS rule FROM (
      SELECT event_id, event_type, CASE WHEN value > 100 THEN props END AS name FROM events)
    WHERE (event_type = 'purchase') <> (name IS NOT NULL)""",
)
def check_conditional_presence(t):
    rows = t("events", "event_id", "event_type", "value", "props").withColumn(
        "name", F.when(F.col("value") > 100, F.col("props"))
    )
    rule = quality.present_iff("name", F.col("event_type") == "purchase")
    return quality.violations(rows, ["event_id"], rule)


@query(
    "check_domain",
    """SELECT event_id, 'event_type_domain' AS rule FROM events
    WHERE event_type NOT IN ('click', 'view', 'purchase')""",
)
def check_domain(t):
    rule = quality.in_domain("event_type", ["click", "view", "purchase"])
    return quality.violations(t("events", "event_id", "event_type"), ["event_id"], rule)


@query(
    "check_union_shape",
    """SELECT o_orderkey, 'kind_shape' AS rule FROM (
      SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'BILL' WHEN 'O' THEN 'AMENDMENT' END AS kind,
        CASE WHEN o_totalprice > 200000 THEN 'hr' END AS bill_type,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'hamdt' END AS amendment_type FROM orders)
    WHERE NOT CASE WHEN kind IS NULL THEN bill_type IS NULL AND amendment_type IS NULL
      WHEN kind = 'BILL' THEN bill_type IS NOT NULL AND amendment_type IS NULL
      ELSE bill_type IS NULL AND amendment_type IS NOT NULL END""",
)
def check_union_shape(t):
    status = F.col("o_orderstatus")
    rows = t("orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").select(
        "o_orderkey",
        F.when(status == "F", "BILL").when(status == "O", "AMENDMENT").alias("kind"),
        F.when(F.col("o_totalprice") > 200000, "hr").alias("bill_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "hamdt").alias("amendment_type"),
    )
    rule = quality.union_shape("kind", {"BILL": "bill_type", "AMENDMENT": "amendment_type"})
    return quality.violations(rows, ["o_orderkey"], rule)


@query(
    "check_references",
    """SELECT 'lineitem' AS child, 'l_orderkey' AS columns, 'orders' AS parent,
      count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL
    SELECT 'documents', 'doc_id', 'labels', count(*) FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def check_references(t):
    tables = {
        "lineitem": t("lineitem", "l_orderkey"), "orders": t("orders", "o_orderkey"),
        "documents": t("documents", "doc_id"), "labels": t("labels", "doc_id"),
    }
    return quality.reference_violations(
        tables,
        [("lineitem", {"l_orderkey": "o_orderkey"}, "orders"), ("documents", {"doc_id": "doc_id"}, "labels")],
    )


# What refers to what among the driver tables.
REFERENCES = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("documents", "doc_id", "labels", "doc_id"),
    ("embeddings", "vec_id", "documents", "doc_id"),
    ("part", "p_size", "supplier", "s_suppkey"),
]


@query(
    "reference_report",
    " UNION ALL ".join(
        f"""SELECT '{child}' AS child, '{column}' AS columns, '{parent}' AS parent, count(*) AS orphans FROM {child} c
        WHERE c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})"""
        for child, column, parent, key in REFERENCES
    ),
)
def reference_report(t):
    """Every reference between the tables, each table read once."""
    wanted: dict[str, set] = {}
    for child, column, parent, key in REFERENCES:
        wanted.setdefault(child, set()).add(column)
        wanted.setdefault(parent, set()).add(key)
    tables = {name: t(name, *sorted(columns)) for name, columns in wanted.items()}
    return quality.reference_violations(tables, [(c, {column: key}, p) for c, column, p, key in REFERENCES])


@query(
    "orphan_rows",
    """SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (
      SELECT 1 FROM supplier WHERE s_suppkey = o_custkey)""",
)
def orphan_rows(t):
    return quality.orphans(t("orders", "o_orderkey", "o_custkey"), t("supplier", "s_suppkey"), {"o_custkey": "s_suppkey"})


@query(
    "quality_report",
    """SELECT 'o_custkey_not_null' AS rule, count(*) FILTER (o_custkey IS NULL) AS violations, count(*) AS rows FROM orders
    UNION ALL SELECT 'o_totalprice_range', count(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 400000), count(*) FROM orders
    UNION ALL SELECT 'o_orderstatus_domain', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')), count(*) FROM orders""",
)
def quality_report(t):
    orders = t("orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return quality.quality_report(
        orders, quality.not_null("o_custkey"), quality.within("o_totalprice", 1000, 400000),
        quality.in_domain("o_orderstatus", ["O", "F"]),
    )


@query("add_column", "SELECT p_partkey, p_size, 3 AS max_retries FROM part")
def add_column(t):
    parts = evolve.add_column(t("part", "p_partkey", "p_size"), "max_retries", "int", 3)
    return evolve.add_column(parts, "p_size", "int", 0)


@query("drop_columns", "SELECT p_partkey, p_type FROM part")
def drop_columns(t):
    return evolve.drop_columns(t("part", "p_partkey", "p_type", "p_size"), "p_size", "absent")


@query("rename_column", "SELECT p_partkey, p_name AS title FROM part")
def rename_column(t):
    return evolve.rename(t("part", "p_partkey", "p_name"), "p_name", "title")


@query(
    "retype_column",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
      CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'none' ELSE lower(o_orderpriority) END AS o_orderpriority
    FROM orders""",
)
def retype_column(t):
    label = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "none").otherwise(F.lower("o_orderpriority"))
    orders = evolve.retype(t("orders", "o_orderkey", "o_orderpriority"), "o_orderkey", "string")
    return evolve.retype(orders, "o_orderpriority", "string", label)


@query(
    "backfill",
    """SELECT d.doc_id, coalesce(CASE WHEN d.lang = 'fr' THEN 'set' END,
      CASE WHEN l.quality IS NOT NULL THEN 'member' WHEN b.item_id IS NOT NULL THEN 'committee' END) AS sponsor_type
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
)
def backfill(t):
    items = t("benchmark", "item_id").withColumn("doc_id", F.col("item_id"))
    rows = labeled(t).join(items, "doc_id", "left").withColumn(
        "sponsor_type", F.when(F.col("lang") == "fr", "set")
    )
    cases = [(F.col("quality").isNotNull(), "member"), (F.col("item_id").isNotNull(), "committee")]
    return evolve.backfill(rows, "sponsor_type", cases).select("doc_id", "sponsor_type")


@query(
    "split_union",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'BILL' ELSE 'AMENDMENT' END AS kind,
      CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS bill_type,
      CASE WHEN o_orderstatus = 'P' THEN o_orderstatus END AS amendment_type FROM orders""",
)
def split_union(t):
    kinds = {"BILL": ("bill_type", ["F", "O"]), "AMENDMENT": ("amendment_type", ["P"])}
    return evolve.split_union(t("orders", "o_orderkey", "o_orderstatus"), "o_orderstatus", "kind", kinds)


SPLIT_DIM_SQL = """SELECT o_orderpriority, row_number() OVER (ORDER BY md5(o_orderpriority)) AS id
    FROM (SELECT DISTINCT o_orderpriority FROM orders)"""


def split_priorities(t):
    refs = t("customer", "c_custkey", "c_name")
    named = t("orders", "o_custkey", "o_orderpriority").join(
        refs, F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderpriority", "c_name")
    return evolve.split_bridge(named, "o_orderpriority", "c_name", refs, "c_name", "c_custkey")


@query("split_dimension", SPLIT_DIM_SQL)
def split_dimension(t):
    return split_priorities(t)[0]


@query(
    "split_bridge",
    f"""SELECT d.id AS o_orderpriority_id, o.o_custkey AS c_name_id
    FROM orders o JOIN ({SPLIT_DIM_SQL}) d ON d.o_orderpriority = o.o_orderpriority""",
)
def split_bridge(t):
    return split_priorities(t)[1]


@query(
    "collapse_runs",
    """SELECT event_id, step AS step_id FROM events
    JOIN (SELECT o_custkey, min(o_orderkey) AS step FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
      ON o_custkey = user_id""",
)
def collapse_runs(t):
    results = t("events", "event_id", "user_id").toDF("event_id", "run_id")
    steps = t("orders", "o_custkey", "o_orderkey", "o_orderstatus").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("id")
    )
    return evolve.collapse(results, steps, "run_id", "id")


@query(
    "wide_to_child",
    """SELECT * FROM (SELECT p_partkey, unnest(['name', 'brand', 'type']) AS stage,
        unnest([p_name, p_brand, nullif(p_type, 'PROMO')]) AS value FROM part)
    WHERE value IS NOT NULL""",
)
def wide_to_child(t):
    parts = t("part", "p_partkey", "p_name", "p_brand", "p_type").withColumn(
        "p_type", F.when(F.col("p_type") != "PROMO", F.col("p_type"))
    )
    stages = {"p_name": "name", "p_brand": "brand", "p_type": "type"}
    return evolve.to_child(parts, ["p_partkey"], stages, stage="stage", value="value")


@query(
    "code_to_id",
    """SELECT p_partkey, brand_id FROM part LEFT JOIN (
      SELECT p_brand AS b, min(p_partkey) AS brand_id FROM part WHERE p_size > 25 GROUP BY p_brand) ON b = p_brand""",
)
def code_to_id(t):
    parts = t("part", "p_partkey", "p_brand")
    brands = t("part", "p_partkey", "p_brand", "p_size").filter("p_size > 25").groupBy("p_brand").agg(
        F.min("p_partkey").alias("id")
    )
    return evolve.code_to_id(parts, brands, "p_brand", "p_brand", "id", "brand_id")


@query("reset_vector", "SELECT vec_id, label, true AS pending FROM embeddings")
def reset_vector(t):
    emptied = evolve.reset_vector(t("embeddings", "vec_id", "label", "embedding"), "embedding")
    return emptied.select("vec_id", "label", F.col("embedding").isNull().alias("pending"))
