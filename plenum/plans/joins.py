"""Joins and set operations on the driver tables."""

from pyspark.sql import functions as F

from plenum.operators import joins, sets
from plenum.operators.skew import grouped_for_join
from plenum.operators.tree import resolve_ancestor
from plenum.operators.windows import seniority
from plenum.plans.registry import query


def identity_inputs(t):
    """Line items as vote positions: open lines are recorded under the supplier's own
    id, filled ones under an alias; suppliers in debt have no mapping."""
    lines = t(
        "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "l_returnflag",
        "l_shipdate",
    )
    open_ = F.col("l_linestatus") == "O"
    positions = lines.select(
        F.col("l_linenumber").alias("id"),
        F.col("l_orderkey").alias("vote_id"),
        F.when(open_, F.col("l_suppkey")).alias("member_id"),
        F.when(~open_, F.col("l_suppkey") + 1000000).alias("lis_member_id"),
        F.col("l_returnflag").alias("position"),
        F.col("l_shipdate").alias("created_at"),
    )
    mapping = t("supplier", "s_suppkey", "s_acctbal").filter("s_acctbal >= 0").select(
        F.col("s_suppkey").alias("member_id"),
        (F.col("s_suppkey") + 1000000).alias("lis_member_id"),
    )
    return positions, mapping


RESOLVED_SQL = """SELECT l_linenumber AS id, l_orderkey AS vote_id, l_suppkey AS member_id,
      CAST(NULL AS BIGINT) AS lis_member_id, l_returnflag AS position, l_shipdate AS created_at
    FROM lineitem WHERE l_linestatus = 'O'
    UNION ALL
    SELECT l_linenumber, l_orderkey, s_suppkey, l_suppkey + 1000000, l_returnflag, l_shipdate
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal >= 0
    WHERE l_linestatus <> 'O'"""


@query("resolve_identity", RESOLVED_SQL)
def resolve_identity(t):
    return joins.resolve_identity(*identity_inputs(t))


@query(
    "resolve_identity_documents",
    """SELECT doc_id, doc_id AS member_id, CAST(NULL AS BIGINT) AS alias_id, source FROM documents
    WHERE lang = 'en'
    UNION ALL
    SELECT d.doc_id, l.quality, d.doc_id, d.source FROM documents d
    JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang <> 'en'""",
)
def resolve_identity_documents(t):
    english = F.col("lang") == "en"
    positions = t("documents", "doc_id", "lang", "source").select(
        "doc_id",
        F.when(english, F.col("doc_id")).alias("member_id"),
        F.when(~english, F.col("doc_id")).alias("alias_id"),
        "source",
    )
    mapping = t("labels", "doc_id", "quality").select(
        F.col("quality").cast("bigint").alias("member_id"), F.col("doc_id").alias("alias_id")
    )
    return joins.resolve_identity(positions, mapping, "member_id", "alias_id")


@query(
    "map_pairs",
    """SELECT c.c_custkey AS customer_id, n.n_nationkey AS nation_id, o.o_orderkey
    FROM orders o
    JOIN customer c ON c.c_name = 'Customer#' || lpad(CAST(o.o_custkey AS VARCHAR), 9, '0')
    JOIN nation n ON n.n_name = 'NATION_' || (o.o_custkey % 30)""",
)
def map_pairs(t):
    """Pairs of names become pairs of ids; unknown nation names drop out."""
    key = F.col("o_custkey")
    links = t("orders", "o_orderkey", "o_custkey").select(
        F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0")).alias("customer"),
        F.concat(F.lit("NATION_"), (key % 30).cast("string")).alias("nation"),
        "o_orderkey",
    )
    return joins.map_pairs(
        links, t("customer", "c_custkey", "c_name"), t("nation", "n_nationkey", "n_name"),
        left_on=("customer", "c_name"), right_on=("nation", "n_name"),
        left_id="c_custkey", right_id="n_nationkey", names=("customer_id", "nation_id"),
    )


@query(
    "lookup_update",
    """SELECT c_custkey, coalesce(n_name, c_mktsegment) AS c_mktsegment FROM customer
    LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3""",
)
def lookup_update(t):
    nations = t("nation", "n_nationkey", "n_name", "n_regionkey").filter("n_regionkey < 3")
    customers = t("customer", "c_custkey", "c_nationkey", "c_mktsegment")
    return joins.lookup_update(
        customers, nations, {"c_nationkey": "n_nationkey"}, {"c_mktsegment": "n_name"}
    ).drop("c_nationkey")


def remap_inputs(t, orders):
    child = t("lineitem", "l_orderkey", "l_linenumber", "l_quantity").withColumn(
        "l_orderkey", F.concat(F.lit("O-"), F.col("l_orderkey").cast("string"))
    )
    parent = orders.select(
        F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("natural_key"),
        (F.col("o_orderkey") + 5000000).alias("id"),
    )
    return child, parent


@query("remap_strict", "SELECT l_orderkey + 5000000 AS order_id, l_linenumber, l_quantity FROM lineitem")
def remap_strict(t):
    child, parent = remap_inputs(t, t("orders", "o_orderkey"))
    return joins.remap_fk(child, parent, "l_orderkey", "natural_key", "id", strict=True, new="order_id")


@query(
    "remap_lenient",
    """SELECT CASE WHEN o_orderstatus <> 'P' THEN l_orderkey + 5000000 END AS l_orderkey,
      l_linenumber, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def remap_lenient(t):
    live = t("orders", "o_orderkey", "o_orderstatus").filter("o_orderstatus <> 'P'")
    child, parent = remap_inputs(t, live)
    return joins.remap_fk(child, parent, "l_orderkey", "natural_key", "id", strict=False)


@query(
    "resolve_parent",
    """SELECT a.p_partkey AS id, b.p_partkey AS parent_id, a.p_brand FROM part a
    LEFT JOIN part b ON a.p_partkey > 0 AND b.p_partkey = a.p_partkey // 2""",
)
def resolve_parent(t):
    name = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
    above = F.concat(F.lit("part-"), F.floor(F.col("p_partkey") / 2).cast("string"))
    tree = t("part", "p_partkey", "p_brand").select(
        F.col("p_partkey").alias("id"),
        name.alias("natural_key"),
        F.when(F.col("p_partkey") > 0, above).alias("parent"),
        "p_brand",
    )
    resolved = joins.resolve_parent(tree, "natural_key", "parent", "id", new="parent_id")
    return resolved.select("id", "parent_id", "p_brand")


@query(
    "drop_orphans",
    """SELECT doc_id, source FROM documents
    WHERE doc_id IS NULL OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)""",
)
def drop_orphans(t):
    return joins.drop_orphans(t("documents", "doc_id", "source"), t("labels", "doc_id"), "doc_id", "doc_id")


@query(
    "processed",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def processed(t):
    done = t("labels", "doc_id", "quality").filter("quality = 1")
    return joins.processed(t("documents", "doc_id", "lang"), done, "doc_id")


@query(
    "unprocessed",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def unprocessed(t):
    done = t("labels", "doc_id", "quality").filter("quality = 1")
    return joins.unprocessed(t("documents", "doc_id", "lang"), done, "doc_id")


@query(
    "composite_key_join",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, g.copies FROM lineitem l
    JOIN (SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL) g
      ON g.l_orderkey = l.l_orderkey AND g.l_linenumber = l.l_linenumber""",
)
def composite_key_join(t):
    lines = t("lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    keys = ["l_orderkey", "l_linenumber"]
    return lines.join(grouped_for_join(lines, keys, F.count("*").alias("copies")), keys)


@query(
    "resolve_ancestor",
    """WITH RECURSIVE walk AS (
      SELECT p_partkey AS node, p_partkey AS root, CAST(0 AS BIGINT) AS depth FROM part
      WHERE p_partkey % 2 = 0 AND p_partkey < 16
      UNION ALL
      SELECT p.p_partkey, w.root, w.depth + 1 FROM part p JOIN walk w ON w.node = p.p_partkey // 2
      WHERE NOT (p.p_partkey % 2 = 0 AND p.p_partkey < 16))
    SELECT node AS p_partkey, root AS root_id, depth, p_brand AS root_p_brand
    FROM walk JOIN part ON p_partkey = root""",
)
def ancestors(t):
    """A forest over all parts: part p hangs under p div 2, a few are roots."""
    key = F.col("p_partkey")
    nodes = t("part", "p_partkey", "p_brand").withColumn(
        "parent", F.when(~((key % 2 == 0) & (key < 16)), F.floor(key / 2))
    )
    return resolve_ancestor(nodes, "p_partkey", "parent", ["p_brand"])


@query(
    "lookup_first_match",
    """SELECT o_orderkey, part FROM orders
    LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey)
      ON l_orderkey = o_orderkey""",
)
def lookup_first_match(t):
    return joins.lookup_update(
        t("orders", "o_orderkey"), t("lineitem", "l_orderkey", "l_partkey"),
        {"o_orderkey": "l_orderkey"}, {"part": "l_partkey"}, pick="min",
    )


@query(
    "branch_lookup",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN c_name ELSE s_name END AS name
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN supplier ON s_suppkey = o_custkey""",
)
def branch_lookup(t):
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderstatus").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("customer"),
        F.col("o_custkey").alias("supplier"),
    )
    customers = t("customer", "c_custkey", "c_name").toDF("key", "name")
    suppliers = t("supplier", "s_suppkey", "s_name").toDF("key", "name")
    return joins.branch_lookup(
        orders, customers, suppliers, a_key="customer", b_key="supplier", lookup_key="key",
        values=["name"],
    ).select("o_orderkey", "name")


def pairing_inputs(t):
    """Two senators per nation by balance; every supplier also holds a district of
    its own, and customers live in the district that has their number."""
    suppliers = t("supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    senators = seniority(suppliers, ["s_nationkey"], "s_acctbal", ["s_suppkey"], 2).select(
        F.col("s_suppkey").alias("member_id"),
        F.col("s_nationkey").alias("state"),
        F.lit(None).cast("bigint").alias("district"),
        F.lit("Senate").alias("chamber"),
    )
    house = suppliers.select(
        F.col("s_suppkey").alias("member_id"),
        F.col("s_nationkey").alias("state"),
        F.col("s_suppkey").alias("district"),
        F.lit("House").alias("chamber"),
    )
    users = t("customer", "c_custkey", "c_nationkey", "c_acctbal").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_nationkey").alias("state"),
        F.col("c_custkey").alias("district"),
        "c_acctbal",
    )
    return users, house.unionByName(senators)


SENATORS_SQL = """SELECT s_suppkey, s_nationkey FROM (SELECT *, row_number() OVER (
      PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS pos FROM supplier) WHERE pos <= 2"""


@query(
    "pair",
    f"""SELECT c_custkey AS user_id, s_suppkey AS member_id, c_nationkey AS state,
      c_custkey AS district, 'House' AS chamber
    FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey = c_custkey
    UNION ALL
    SELECT c_custkey, s_suppkey, c_nationkey, NULL, 'Senate'
    FROM customer JOIN ({SENATORS_SQL}) ON s_nationkey = c_nationkey""",
)
def pair(t):
    return joins.pair(*pairing_inputs(t))


@query(
    "stale_pairs",
    f"""WITH senators AS ({SENATORS_SQL}),
    now AS (SELECT c_custkey AS user_id, s_suppkey AS member_id
      FROM customer JOIN senators ON s_nationkey = c_nationkey
      UNION SELECT c_custkey, s_suppkey FROM customer
        JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey = c_custkey),
    moved AS (SELECT c_custkey,
        CASE WHEN c_acctbal < 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS nation
      FROM customer),
    before AS (SELECT c_custkey AS user_id, s_suppkey AS member_id
      FROM moved JOIN senators ON s_nationkey = nation
      UNION SELECT c_custkey, s_suppkey FROM moved
        JOIN supplier ON s_nationkey = nation AND s_suppkey = c_custkey)
    SELECT user_id, member_id, 'stale' AS status FROM (FROM before EXCEPT FROM now)
    UNION ALL SELECT user_id, member_id, 'missing' FROM (FROM now EXCEPT FROM before)""",
)
def stale_pairs(t):
    """Pairings stored when customers in debt lived one nation further on."""
    users, members = pairing_inputs(t)
    moved = users.withColumn(
        "state",
        F.when(F.col("c_acctbal") < 0, (F.col("state") + 1) % 25).otherwise(F.col("state")),
    )
    return joins.stale_pairs(
        joins.pair(moved, members), joins.pair(users, members), ["user_id", "member_id"]
    )


@query("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier")
def union_all(t):
    return sets.union_all(
        t("nation", "n_name").toDF("name"), t("customer", "c_name").toDF("name"),
        t("supplier", "s_name").toDF("name"),
    )


@query("missing_rows", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_rows(t):
    return sets.missing(t("documents", "doc_id"), t("labels", "doc_id"))
