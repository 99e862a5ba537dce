"""Stances, alignments and scores on the driver tables.

Roles: an order is a vote, its customer the bill, its line items the positions of
the suppliers as members. Orders also serve as analyses of their customer's bill.
"""

from pyspark.sql import functions as F

from plenum.functions.scalar import map_values
from plenum.operators import scoring
from plenum.operators.joins import resolve_identity
from plenum.operators.skew import grouped_for_join
from plenum.plans.joins import RESOLVED_SQL, identity_inputs
from plenum.plans.registry import query
from plenum.session import materialize


def stances(t):
    positions = resolve_identity(*identity_inputs(t)).select("member_id", "vote_id", "position")
    status = F.col("o_orderstatus")
    votes = t("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").select(
        F.col("o_orderkey").alias("vote_id"),
        F.when(status != "P", F.col("o_custkey")).alias("bill_id"),
        F.when(status == "F", F.col("o_orderkey")).alias("amendment_id"),
        F.col("o_orderdate").alias("vote_date"),
    )
    bills = t("customer", "c_custkey").toDF("bill_id")
    analyses = t("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").filter(
        "o_orderstatus = 'P'"
    ).select(
        F.col("o_custkey").alias("bill_id"),
        F.col("o_orderkey").alias("analysis_id"),
        F.col("o_orderdate").alias("completed_at"),
        F.array("o_orderpriority", F.year("o_orderdate").cast("string")).alias("topics"),
    )
    return scoring.materialize_stances(positions, votes, bills, analyses)


STANCES_SQL = f"""SELECT p.member_id, v.o_custkey AS bill_id, p.vote_id, p.position,
      CASE WHEN v.o_orderstatus = 'F' THEN v.o_orderkey END AS amendment_id,
      v.o_orderdate AS vote_date, a.priority, a.year
    FROM (SELECT member_id, vote_id, min(position) AS position FROM ({RESOLVED_SQL}) GROUP BY ALL) p
    JOIN orders v ON v.o_orderkey = p.vote_id AND v.o_orderstatus <> 'P'
    LEFT JOIN (SELECT o_custkey, o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS year
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
        ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos FROM orders WHERE o_orderstatus = 'P')
      WHERE pos = 1) a ON a.o_custkey = v.o_custkey"""


@query(
    "materialize_stances",
    f"""SELECT member_id, bill_id, vote_id, position, vote_date,
      coalesce(priority || ',' || year, '') AS topics FROM ({STANCES_SQL})""",
)
def materialize_stances(t):
    return stances(t).select(
        "member_id", "bill_id", "vote_id", "position", "vote_date", F.array_join("topics", ",").alias("topics")
    )


@query(
    "stance_topics",
    f"""WITH stances AS ({STANCES_SQL}),
    topics AS (SELECT *, priority AS topic FROM stances WHERE priority IS NOT NULL
      UNION ALL SELECT *, year FROM stances WHERE year IS NOT NULL),
    bill_findings AS (SELECT o_custkey AS id, o_orderpriority AS topic, min(o_orderkey) AS finding_id,
        arg_min(CASE WHEN o_totalprice > 250000 THEN 'Progressive' ELSE 'Conservative' END, o_orderkey) AS direction
      FROM orders GROUP BY ALL),
    amendment_findings AS (SELECT l_orderkey AS id, l_returnflag AS flag, min(l_partkey) AS finding_id
      FROM lineitem GROUP BY ALL)
    SELECT t.member_id, t.bill_id, t.vote_id, t.topic,
      CASE WHEN t.amendment_id IS NULL THEN b.finding_id ELSE a.finding_id END AS finding_id,
      CASE WHEN t.amendment_id IS NULL THEN b.direction WHEN a.id IS NOT NULL THEN 'Neutral' END AS stance_direction
    FROM topics t
    LEFT JOIN bill_findings b ON b.id = t.bill_id AND b.topic = t.topic
    LEFT JOIN amendment_findings a ON a.id = t.amendment_id
      AND CASE a.flag WHEN 'A' THEN '1-URGENT' WHEN 'N' THEN '2-HIGH' ELSE '5-LOW' END = t.topic""",
)
def stance_topics(t):
    direction = F.when(F.col("o_totalprice") > 250000, "Progressive").otherwise("Conservative")
    bill_findings = t("orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice").select(
        F.col("o_custkey").alias("legislation_id"),
        F.col("o_orderpriority").alias("topic"),
        F.col("o_orderkey").alias("finding_id"),
        direction.alias("stance_direction"),
    )
    flag = F.col("l_returnflag")
    amendment_findings = t("lineitem", "l_orderkey", "l_partkey", "l_returnflag").select(
        F.col("l_orderkey").alias("legislation_id"),
        F.when(flag == "A", "1-URGENT").when(flag == "N", "2-HIGH").otherwise("5-LOW").alias("topic"),
        F.col("l_partkey").alias("finding_id"),
        F.lit("Neutral").alias("stance_direction"),
    )
    found = scoring.stance_topics(stances(t), bill_findings, amendment_findings)
    return found.select("member_id", "bill_id", "vote_id", "topic", "finding_id", "stance_direction")


@query(
    "align",
    """WITH bought AS (SELECT o_custkey AS user_id, l_partkey AS bill_id, p_type AS topic, l_returnflag, p_size
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
    prefs AS (SELECT user_id, topic,
        2.0::DOUBLE * CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / CAST(count(*) AS DOUBLE) - 1.0 AS stance
      FROM bought GROUP BY ALL),
    wanted AS (SELECT DISTINCT user_id, bill_id, topic, p_size FROM bought)
    SELECT w.user_id, w.bill_id, w.topic, p.stance AS user_stance_score,
      CASE WHEN p_size > 30 THEN 'Progressive' WHEN p_size < 15 THEN 'Conservative' ELSE 'Neutral' END AS stance_direction,
      1.0::DOUBLE - abs(p.stance - CASE WHEN p_size > 30 THEN 1 WHEN p_size < 15 THEN -1 ELSE 0 END) / 2.0::DOUBLE AS alignment_score
    FROM wanted w JOIN prefs p ON p.user_id = w.user_id AND p.topic = w.topic""",
)
def align(t):
    """Users are customers, bills the parts they ordered, topics the part types."""
    parts = t("part", "p_partkey", "p_type", "p_size")
    bought = (
        t("lineitem", "l_orderkey", "l_partkey", "l_returnflag")
        .join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("bill_id"), "l_returnflag")
    )
    returned = F.count_if(F.col("l_returnflag") == "R").cast("double")
    preferences = grouped_for_join(
        bought.join(parts.select(F.col("p_partkey").alias("bill_id"), F.col("p_type").alias("topic")), "bill_id"),
        ["user_id", "topic"],
        (F.lit(2.0) * returned / F.count("*").cast("double") - 1.0).alias("user_stance_score"),
    )
    size = F.col("p_size")
    topics = parts.select(
        F.col("p_partkey").alias("bill_id"),
        F.col("p_type").alias("topic"),
        F.when(size > 30, "Progressive").when(size < 15, "Conservative").otherwise("Neutral").alias("stance_direction"),
    )
    return scoring.align(bought, preferences, topics)


@query(
    "extract_stances",
    """WITH answers AS (SELECT o_custkey AS user_id, l_partkey AS question_id,
        min(CASE WHEN l_quantity <= 45 THEN l_returnflag END) AS option
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
    chosen AS (SELECT user_id, p_brand, p_type, p_size,
        CASE option WHEN 'A' THEN -1.0 WHEN 'N' THEN 0.5 ELSE 1.0 END AS multiplier, p_size % 10 + 1 AS signal
      FROM answers JOIN part ON p_partkey = question_id WHERE option IS NOT NULL),
    topics AS (SELECT user_id, p_brand AS topic, 1.0 AS weight, 1 AS sign, multiplier, signal FROM chosen
      UNION ALL
      SELECT user_id, p_type, 0.6, CASE WHEN p_size > 25 THEN -1 ELSE 1 END, multiplier, signal FROM chosen)
    SELECT user_id, topic,
      round(CAST(sum(weight * multiplier * sign) AS DOUBLE) / CAST(sum(weight) AS DOUBLE), 9) AS user_stance_score,
      max(signal) AS importance, count(*) AS answers
    FROM topics GROUP BY user_id, topic""",
)
def extract_stances(t):
    """Questions are parts; customers answer by the return flag of what they ordered."""
    t.size_partitions("lineitem", "orders")
    quantity = F.col("l_quantity")
    responses = (
        t("lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
        .join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("question_id"))
        .agg(F.min(F.when(quantity <= 45, F.col("l_returnflag"))).alias("selected_option"))
    )
    parts = t("part", "p_partkey", "p_brand", "p_type", "p_size")
    choices = F.array(
        *[
            F.struct(F.lit(o).alias("option_value"), F.lit(m).alias("stance_multiplier"))
            for o, m in (("A", -1.0), ("N", 0.5), ("R", 1.0))
        ]
    )
    options = parts.select(
        F.col("p_partkey").alias("question_id"),
        (F.col("p_size") % 10 + 1).alias("importance_signal"),
        F.inline(choices),
    )
    conservative = F.when(F.col("p_size") > 25, "Conservative").otherwise("Progressive")
    asked = F.array(
        F.struct(F.col("p_brand").alias("topic"), F.lit("Progressive").alias("agree_stance"),
                 F.lit(1.0).alias("weight")),
        F.struct(F.col("p_type").alias("topic"), conservative.alias("agree_stance"),
                 F.lit(0.6).alias("weight")),
    )
    topics = parts.select(F.col("p_partkey").alias("question_id"), F.inline(asked))
    found = scoring.extract_stances(responses, options, topics)
    return found.withColumn("user_stance_score", F.round("user_stance_score", 9))


CASTS = {"A": "Yea", "N": "Nay", "R": "Present"}
STANCES = ("support", "oppose", "neutral")


def evidence(t):
    """Every line item as one member's vote on one bill and one topic, scored for the
    customers of a nation taken together."""
    t.size_partitions("lineitem", "orders")
    return (
        t("lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount", "l_returnflag")
        .join(
            t("orders", "o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
        )
        .join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("c_nationkey").alias("user_id"),
            F.col("l_suppkey").alias("member_id"),
            F.year("o_orderdate").alias("congress"),
            F.col("p_type").alias("topic"),
            F.col("l_orderkey").alias("bill_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vote_id"),
            (F.col("l_discount") * 10).alias("alignment_score"),
            map_values("l_returnflag", CASTS, "null").alias("vote"),
            F.element_at(
                F.array(*[F.lit(s) for s in STANCES]), (F.col("c_nationkey") + F.length("p_type")).cast("int") % 3 + 1
            ).alias("stance"),
        )
    )


EVIDENCE_SQL = """SELECT c_nationkey AS user_id, l_suppkey AS member_id,
      CAST(year(o_orderdate) AS INTEGER) AS congress, p_type AS topic, l_orderkey AS bill_id,
      l_orderkey * 10 + l_linenumber AS vote_id,
      l_discount * 10 AS alignment_score,
      CASE l_returnflag WHEN 'A' THEN 'Yea' WHEN 'N' THEN 'Nay' WHEN 'R' THEN 'Present' END AS vote,
      ['support', 'oppose', 'neutral'][(c_nationkey + length(p_type)) % 3 + 1] AS stance
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey"""

SCORE_SQL = f"""SELECT CASE WHEN grouping(congress) = 0 AND grouping(topic) = 0 THEN 'congress_topic'
        WHEN grouping(congress) = 0 THEN 'congress' WHEN grouping(topic) = 0 THEN 'topic'
        ELSE 'overall' END AS grain, user_id, member_id, congress, topic,
      round(avg(alignment_score), 7) AS score,
      count(DISTINCT bill_id) AS bills, count(DISTINCT vote_id) AS votes
    FROM ({EVIDENCE_SQL})
    GROUP BY GROUPING SETS ((user_id, member_id), (user_id, member_id, topic),
      (user_id, member_id, congress), (user_id, member_id, congress, topic))"""


@query("score_rollup", SCORE_SQL)
def score_rollup(t):
    return scores(evidence(t))


def scores(rows):
    """The rollup, rounded so that the order of summation does not show."""
    return scoring.score_rollup(rows).withColumn("score", F.round("score", 7))


def by_grain(rows):
    """The scores of one grain, rounded likewise."""
    return lambda grain: scoring.score_grain(rows, grain).withColumn("score", F.round("score", 7))


@query(
    "score_congress",
    f"""SELECT user_id, member_id, congress, score AS overall_score, bills AS bills_considered,
      votes AS votes_analyzed FROM ({SCORE_SQL}) WHERE grain = 'congress'""",
)
def score_congress(t):
    return scoring.score_tables(by_grain(evidence(t)))["score_congress"]


@query(
    "rescored_topics",
    f"SELECT user_id, member_id, congress, topic, score, bills, votes FROM ({SCORE_SQL}) WHERE grain = 'congress_topic'",
)
def rescored_topics(t):
    """Stored scores brought up to date: one user's seventh votes have come since, and the
    sixth were recorded too low. The result is that of all evidence scored anew."""
    rows = evidence(t)
    number, concerned = F.col("vote_id") % 10, F.col("user_id") == 3
    low = F.col("alignment_score") - F.lit(1.0)
    late, wrong = concerned & (number == 7), concerned & (number == 6)
    before = rows.filter(~late).withColumn("alignment_score", F.when(wrong, low).otherwise(F.col("alignment_score")))
    changes = rows.filter(late | wrong).withColumn("sign", F.lit(1)).unionByName(
        rows.filter(wrong).withColumn("alignment_score", low).withColumn("sign", F.lit(-1))
    )
    parts = materialize(scoring.score_parts(before), "parts")
    stored = materialize(scoring.scores_of_parts(parts, "congress_topic"), "scores")
    return scoring.rescored(parts, stored, changes, "congress_topic").withColumn("score", F.round("score", 7))


def snapshot(t):
    rows = evidence(t)
    return scoring.snapshot_scores(
        by_grain(rows), rows, 2, "2026-01-01 00:00:00", "vote.recorded"
    )


SNAPSHOT_ID = "user_id || '/' || member_id || '/2026-01-01 00:00:00' AS score_id"


@query(
    "snapshot_scores",
    f"""SELECT {SNAPSHOT_ID}, user_id, member_id, TIMESTAMP '2026-01-01 00:00:00' AS computed_at,
      score AS aggregate_score, 'vote.recorded' AS trigger_event, CAST(NULL AS VARCHAR) AS reasoning
    FROM ({SCORE_SQL}) WHERE grain = 'overall'""",
)
def snapshot_history(t):
    history = snapshot(t)["score_history"]
    return history.withColumn("computed_at", F.col("computed_at").cast("timestamp_ntz"))


@query(
    "snapshot_congress_topics",
    f"SELECT {SNAPSHOT_ID}, congress, topic, score FROM ({SCORE_SQL}) WHERE grain = 'congress_topic'",
)
def snapshot_congress_topics(t):
    return snapshot(t)["score_history_congress_topics"]


@query(
    "snapshot_highlights",
    f"""SELECT {SNAPSHOT_ID}, bill_id, topic, stance, vote, alignment_score AS alignment,
      CAST(position AS INTEGER) AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, member_id, topic
        ORDER BY alignment_score DESC, bill_id) AS position
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, member_id, topic, bill_id
          ORDER BY alignment_score DESC, vote_id, vote, stance) AS nth FROM ({EVIDENCE_SQL}))
      WHERE nth = 1)
    WHERE position <= 2""",
)
def snapshot_highlights(t):
    return snapshot(t)["score_history_highlights"]


STATUS_SQL = """SELECT user_id AS bill_id,
      coalesce(bool_or(event_type = 'click'), false) AS has_votes,
      coalesce(bool_or(event_type = 'view'), false) AS has_analysis,
      coalesce(bool_or(event_type = 'view' AND value < 10), false)
        AND coalesce(bool_or(event_type = 'view' AND value BETWEEN 10 AND 150), false)
        AND coalesce(bool_or(event_type = 'view' AND value > 150), false) AS all_passes_completed,
      max(ts) FILTER (event_type = 'click') AS votes_updated_at,
      max(ts) FILTER (event_type = 'view') AS analysis_completed_at
    FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id"""


def bill_status(t):
    """Clicks are votes on the user's bill, views are analyses in three passes."""
    events = t("events", "user_id", "event_type", "ts", "value")
    votes = events.filter("event_type = 'click'").select(
        F.col("user_id").alias("bill_id"), F.col("ts").alias("voted_at")
    )
    value = F.col("value")
    analyses = events.filter("event_type = 'view'").select(
        F.col("user_id").alias("bill_id"),
        F.when(value < 10, 1).when(value <= 150, 2).otherwise(3).alias("pass_number"),
        F.col("ts").alias("completed_at"),
    )
    return scoring.readiness(votes, analyses, [1, 2, 3])


query("readiness", STATUS_SQL)(bill_status)


@query(
    "ready_queue",
    f"""SELECT s.bill_id, s.votes_updated_at, s.analysis_completed_at, p.last_run AS stances_materialized_at
    FROM ({STATUS_SQL}) s LEFT JOIN (SELECT user_id, max(ts) AS last_run FROM events
      WHERE event_type = 'purchase' GROUP BY user_id) p ON p.user_id = s.bill_id
    WHERE has_votes AND all_passes_completed
      AND (p.last_run IS NULL OR greatest(votes_updated_at, analysis_completed_at) > p.last_run)""",
)
def ready_queue(t):
    runs = t("events", "user_id", "event_type", "ts").filter("event_type = 'purchase'").groupBy(
        F.col("user_id").alias("bill_id")
    ).agg(F.max("ts").alias("stances_materialized_at"))
    status = bill_status(t).join(runs, "bill_id", "left")
    return scoring.ready(status).select(
        "bill_id", "votes_updated_at", "analysis_completed_at", "stances_materialized_at"
    )


@query(
    "changed_users",
    """SELECT user_id, changed AS last_stance_change_at FROM (
      SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS changed,
        max(ts) FILTER (event_type = 'view' AND value > 100) AS scored FROM events GROUP BY user_id)
    WHERE changed IS NOT NULL AND (scored IS NULL OR changed > scored)""",
)
def changed_users(t):
    events = t("events", "user_id", "event_type", "ts", "value")
    users = events.filter("event_type = 'purchase'").groupBy("user_id").agg(
        F.max("ts").alias("last_stance_change_at")
    )
    scores = events.filter("event_type = 'view' AND value > 100").select(
        "user_id", F.col("ts").alias("last_updated")
    )
    return scoring.changed_users(users, scores)


@query(
    "topic_overlap",
    """WITH topics AS (SELECT DISTINCT user_id, event_type AS topic FROM events WHERE value > 115),
    people AS (SELECT DISTINCT user_id, user_id + 1 AS member_id FROM topics)
    SELECT p.user_id, p.member_id,
      CASE WHEN count(m.topic) = 0 THEN 'no_overlap' ELSE 'scored' END AS status,
      count(m.topic) AS shared_topics,
      coalesce(string_agg(u.topic, ',' ORDER BY u.topic) FILTER (m.topic IS NULL), '') AS non_overlapping_topics
    FROM people p JOIN topics u ON u.user_id = p.user_id
    LEFT JOIN topics m ON m.user_id = p.member_id AND m.topic = u.topic GROUP BY p.user_id, p.member_id""",
)
def topic_overlap(t):
    """Each user is paired with the next one as the member."""
    topics = t("events", "user_id", "event_type", "value").filter("value > 115").select(
        "user_id", F.col("event_type").alias("topic")
    )
    pairs = topics.select("user_id", (F.col("user_id") + 1).alias("member_id")).distinct()
    rows = scoring.overlap(pairs, topics, topics.withColumnRenamed("user_id", "member_id"))
    return rows.withColumn("non_overlapping_topics", F.array_join("non_overlapping_topics", ","))
