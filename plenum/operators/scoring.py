"""From votes, topics and preferences to alignment scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators.joins import branch_lookup
from plenum.operators.skew import distinct_keys
from plenum.operators.windows import highlights as top_alignments
from plenum.operators.windows import latest, top_per_key


def materialize_stances(
    positions: DataFrame, votes: DataFrame, bills: DataFrame, analyses: DataFrame
) -> DataFrame:
    """How each member voted on each bill: one row per member, bill and vote.

    Votes without a bill drop out. Topics come from the bill's newest analysis, and
    are empty without one. Should a member hold two positions in one vote, the
    smallest is taken.
    """
    held = positions.groupBy("member_id", "vote_id").agg(F.min("position").alias("position"))
    newest = latest(
        analyses, ["bill_id"], ["completed_at", "analysis_id"], for_join=True
    ).select("bill_id", "topics")
    on_bills = votes.filter(F.col("bill_id").isNotNull()).join(bills.select("bill_id"), "bill_id", "left_semi")
    about = on_bills.join(newest, "bill_id", "left")
    type_ = analyses.schema["topics"].dataType
    topics = F.coalesce("topics", F.array().cast(type_)).alias("topics")
    rest = [c for c in votes.columns if c not in ("vote_id", "bill_id")]
    return held.join(about, "vote_id").select(
        "member_id", "bill_id", "vote_id", "position", *rest, topics
    )


def stance_topics(
    stances: DataFrame, bill_findings: DataFrame, amendment_findings: DataFrame
) -> DataFrame:
    """Stances by topic, with the finding that gives the direction: the amendment's
    when the vote was on an amendment, else the bill's. Both findings tables have
    ``legislation_id, topic, finding_id, stance_direction``; the smallest finding id
    of a text and topic is used."""

    def first(findings: DataFrame) -> DataFrame:
        return top_per_key(findings, ["legislation_id", "topic"], ["finding_id"], 1)

    rows = stances.select(
        *[c for c in stances.columns if c != "topics"], F.explode("topics").alias("topic")
    )
    return branch_lookup(
        rows, first(amendment_findings), first(bill_findings),
        a_key="amendment_id", b_key="bill_id", lookup_key="legislation_id",
        values=["finding_id", "stance_direction"], shared=["topic"],
    )


def align(
    requests: DataFrame, preferences: DataFrame, topics: DataFrame, item: str = "bill_id"
) -> DataFrame:
    """Alignment in [0, 1] of a user with a bill (or amendment) on each shared topic.

    ``requests`` lists the user and item pairs to score, so the work grows with the
    pairs asked for, not with all users times all items. Stances lie in [-1, 1];
    the alignment is ``1 - |user - item| / 2``.
    """
    direction = F.col("stance_direction")
    number = F.when(direction == "Progressive", 1.0).when(direction == "Conservative", -1.0)
    wanted = requests.select("user_id", item).distinct()
    stated = topics.select(item, "topic", "stance_direction", number.otherwise(0.0).alias("_item"))
    score = 1.0 - F.abs(F.col("user_stance_score") - F.col("_item")) / 2.0
    return (
        wanted.join(stated, item)
        .join(preferences.select("user_id", "topic", "user_stance_score"), ["user_id", "topic"])
        .select("user_id", item, "topic", "user_stance_score", "stance_direction",
                score.alias("alignment_score"))
    )


def extract_stances(responses: DataFrame, options: DataFrame, topics: DataFrame) -> DataFrame:
    """Stances from multiple-choice answers, without a model.

    Per user and topic: the weighted mean of the chosen options' multipliers, turned
    around where agreeing is the conservative answer, and the largest importance
    signal. Free-text answers carry no option and drop out.
    """
    chosen = responses.filter(F.col("selected_option").isNotNull()).join(
        options.withColumnRenamed("option_value", "selected_option"),
        ["question_id", "selected_option"],
    )
    sign = F.when(F.col("agree_stance") == "Conservative", -1).otherwise(1)
    signal = F.col("weight") * F.col("stance_multiplier") * sign
    return (
        chosen.join(topics, "question_id")
        .groupBy("user_id", "topic")
        .agg(
            F.sum(signal).alias("_signal"),
            F.sum("weight").alias("_weight"),
            F.max("importance_signal").alias("importance"),
            F.count("*").alias("answers"),
        )
        .select("user_id", "topic", (F.col("_signal") / F.col("_weight")).alias("user_stance_score"),
                "importance", "answers")
    )


def score_rollup(evidence: DataFrame) -> DataFrame:
    """Scores at four grains: overall, per topic, per congress, per congress and topic.

    ``evidence`` has ``user_id, member_id, congress, topic, bill_id, vote_id,
    alignment_score``; the score is the mean alignment, without NULLs. A vote belongs to one bill and
    a bill to one congress. So votes are collapsed first, then bills, and the counts
    of different bills and votes of every grain are plain sums from there; a busy
    user-member pair is spread over its votes before it is combined. ``grain`` names
    the level; the columns a level lacks are NULL.
    """
    pair = ["user_id", "member_id"]
    keys = [*pair, "congress", "topic", "_all_topics"]
    sums = [F.sum("_sum").alias("_sum"), F.sum("_rows").alias("_rows")]
    by_topic = evidence.groupBy(*pair, "congress", "topic", "bill_id", "vote_id").agg(
        F.sum("alignment_score").alias("_sum"), F.count("alignment_score").alias("_rows")
    )
    # Groupings that keep the bill stay where a join on the bill has put the rows.
    over_topics = by_topic.groupBy(*pair, "congress", "bill_id", "vote_id").agg(*sums)
    no_topic = F.lit(None).cast(evidence.schema["topic"].dataType)
    levels = (
        (by_topic, ["topic"], {"_all_topics": F.lit(False)}),
        (over_topics, [], {"topic": no_topic, "_all_topics": F.lit(True)}),
    )
    topics, whole = (
        per_vote.groupBy(*pair, "congress", *topic, "bill_id").agg(*sums, F.count("*").alias("_votes")).withColumns(rest)
        for per_vote, topic, rest in levels
    )
    per_bill = topics.unionByName(whole)
    per_congress = per_bill.groupBy(*keys).agg(
        F.sum("_sum").alias("_sum"), F.sum("_rows").alias("_rows"),
        F.sum("_votes").alias("_votes"), F.count("*").alias("_bills"),
    )
    lifetime = F.grouping("congress") == 1
    grain = (
        F.when(F.col("_all_topics") & lifetime, "overall")
        .when(F.col("_all_topics"), "congress")
        .when(lifetime, "topic")
        .otherwise("congress_topic")
    )
    rest = [*pair, "topic", "_all_topics"]
    return (
        per_congress.groupingSets(
            [[F.col(c) for c in (*rest, *congress)] for congress in ([], ["congress"])],
            *rest, "congress",
        )
        .agg(
            grain.alias("grain"),
            F.try_divide(F.sum("_sum"), F.sum("_rows")).alias("score"),
            F.sum("_bills").alias("bills"),
            F.sum("_votes").alias("votes"),
        )
        .select("grain", *pair, "congress", "topic", "score", "bills", "votes")
    )


def score_grain(evidence: DataFrame, grain: str) -> DataFrame:
    """One grain of ``score_rollup`` (``overall``, ``topic``, ``congress`` or
    ``congress_topic``), without the work for the others."""
    keys = ["user_id", "member_id", *{"overall": [], "topic": ["topic"], "congress": ["congress"],
                                      "congress_topic": ["congress", "topic"]}[grain]]
    per_vote = evidence.groupBy(*keys, "bill_id", "vote_id").agg(
        F.sum("alignment_score").alias("_sum"), F.count("alignment_score").alias("_rows")
    )
    per_bill = per_vote.groupBy(*keys, "bill_id").agg(
        F.sum("_sum").alias("_sum"), F.sum("_rows").alias("_rows"), F.count("*").alias("_votes")
    )
    return per_bill.groupBy(*keys).agg(
        F.try_divide(F.sum("_sum"), F.sum("_rows")).alias("score"),
        F.count("*").alias("bills"),
        F.sum("_votes").alias("votes"),
    )


PARTS = ["user_id", "member_id", "congress", "topic", "bill_id", "vote_id"]
EXACT = "decimal(38,15)"


def score_parts(evidence: DataFrame) -> DataFrame:
    """What scores are made of, to be stored: per user, member, congress, topic, bill and
    vote the sum of alignments, how many are not NULL, and how many rows there are. Sums are
    decimals, so that what was added can be taken away without a remainder; an alignment
    that is no number counts as NULL."""
    return _parts(evidence.withColumn("sign", F.lit(1)))


def _parts(signed: DataFrame) -> DataFrame:
    alignment, sign = F.col("alignment_score").try_cast(EXACT), F.col("sign").cast("bigint")
    return signed.groupBy(*PARTS).agg(
        F.coalesce(F.sum((alignment * sign).cast(EXACT)), F.lit(0)).cast(EXACT).alias("total"),
        F.coalesce(F.sum(F.when(alignment.isNotNull(), sign)), F.lit(0)).alias("known"),
        F.sum(sign).alias("present"),
    )


def changed_parts(parts: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored parts of the pairs of user and member that ``changes`` concerns, brought
    up to date. ``changes`` is evidence with a ``sign``: 1 for a row that came, -1 for one
    that went; a corrected row is both. Parts without rows left are not kept. Stored parts
    of other pairs are only looked up, not shuffled where the changes are few."""
    delta = _parts(changes)
    pair = ["user_id", "member_id"]
    concerned = delta.select(*[F.col(c).alias(f"_{c}") for c in pair]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in pair]
    stored = parts.join(concerned, same, "left_semi").select(*PARTS, "total", "known", "present")
    sums = [F.sum(c).cast(EXACT if c == "total" else "bigint").alias(c) for c in ("total", "known", "present")]
    return stored.unionByName(delta).groupBy(*PARTS).agg(*sums).filter("present > 0")


def scores_of_parts(parts: DataFrame, grain: str) -> DataFrame:
    """One grain of ``score_rollup`` from stored parts. Pairs whose evidence is all gone
    have no row, so a caller that replaces the scores of changed pairs drops these."""
    keys = ["user_id", "member_id", *{"overall": [], "topic": ["topic"], "congress": ["congress"],
                                      "congress_topic": ["congress", "topic"]}[grain]]
    per_vote = parts.groupBy(*keys, "bill_id", "vote_id").agg(F.sum("total").alias("_sum"), F.sum("known").alias("_rows"))
    per_bill = per_vote.groupBy(*keys, "bill_id").agg(
        F.sum("_sum").alias("_sum"), F.sum("_rows").alias("_rows"), F.count("*").alias("_votes")
    )
    return per_bill.groupBy(*keys).agg(
        F.try_divide(F.sum("_sum").cast("double"), F.sum("_rows")).alias("score"),
        F.count("*").alias("bills"),
        F.sum("_votes").alias("votes"),
    )


def rescored(parts: DataFrame, scores: DataFrame, changes: DataFrame, grain: str) -> DataFrame:
    """The scores of one grain after ``changes``: those of the pairs concerned are made anew
    from their parts, all others stay as they are stored."""
    fresh = scores_of_parts(changed_parts(parts, changes), grain).select(*scores.columns)
    pair = ["user_id", "member_id"]
    concerned = changes.select(*[F.col(c).alias(f"_{c}") for c in pair]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in pair]
    return scores.join(concerned, same, "left_anti").unionByName(fresh)


def score_tables(rollup: DataFrame | Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """The four score tables of the data model, from a rollup or from a function that
    gives the scores of one grain."""
    pair, score = ["user_id", "member_id"], F.col("score")
    counts = [F.col("bills").alias("bills_considered"), F.col("votes").alias("votes_analyzed")]

    def at(grain: str) -> DataFrame:
        return rollup(grain) if callable(rollup) else rollup.filter(F.col("grain") == grain)

    return {
        "scores": at("overall").select(
            *pair, score.alias("aggregate_score"), F.col("bills").alias("total_bills"),
            F.col("votes").alias("total_votes"),
        ),
        "score_topics": at("topic").select(*pair, "topic", "score"),
        "score_congress": at("congress").select(
            *pair, "congress", score.alias("overall_score"), *counts
        ),
        "score_congress_topics": at("congress_topic").select(*pair, "congress", "topic", "score"),
    }


def notable_bills(evidence: DataFrame, n: int) -> DataFrame:
    """The ``n`` bills of each user, member and topic with the strongest alignment, each
    with its best aligned vote and the user's stance; ties by vote id, then the vote. ``evidence``
    also has ``stance``, the user's on the topic, and ``vote``, how the member voted. A
    bill voted on many times counts once, so user, member, bill and topic are a key."""
    keys = ["user_id", "member_id", "topic"]
    strongest = F.col("alignment_score").desc_nulls_last()
    once = top_per_key(evidence, [*keys, "bill_id"], [strongest, "vote_id", "vote", "stance"], 1)
    return top_alignments(once, keys, "alignment_score", ["bill_id"], n)


def snapshot_scores(
    rollup: DataFrame | Callable[[str], DataFrame], evidence: DataFrame, n: int, at: str, trigger: str
) -> dict[str, DataFrame]:
    """Rows to append to the score history: the score with its instant and trigger,
    and its children per congress, per congress and topic, and its highlights, all
    under one snapshot id. Reasoning may be added later and starts as NULL. Highlights
    are one row per score, bill and topic, without votes of unknown alignment."""
    tables = score_tables(rollup)
    parts = [F.col(c).cast("string") for c in ("user_id", "member_id")]
    score_id = F.concat_ws("/", *parts, F.lit(at)).alias("score_id")
    notable = notable_bills(evidence.filter(F.col("alignment_score").isNotNull()), n)
    return {
        "score_history": tables["scores"].select(
            score_id, "user_id", "member_id", F.lit(at).cast("timestamp").alias("computed_at"),
            "aggregate_score", F.lit(trigger).alias("trigger_event"),
            F.lit(None).cast("string").alias("reasoning"),
        ),
        "score_history_congress": tables["score_congress"].select(
            score_id, "congress", "overall_score", "bills_considered", "votes_analyzed"
        ),
        "score_history_congress_topics": tables["score_congress_topics"].select(
            score_id, "congress", "topic", "score"
        ),
        "score_history_highlights": notable.select(
            score_id, "bill_id", "topic", "stance", "vote", F.col("alignment_score").alias("alignment"),
            "position",
        ),
    }


def readiness(votes: DataFrame, analyses: DataFrame, passes: Sequence[int]) -> DataFrame:
    """Per bill: are there votes, is there an analysis, are all passes through, and
    when did each last arrive. ``votes`` has ``bill_id, voted_at``; ``analyses`` has
    ``bill_id, pass_number, completed_at``. Both are stacked and grouped once."""
    stacked = votes.select("bill_id", "voted_at").unionByName(
        analyses.select("bill_id", "pass_number", "completed_at"), allowMissingColumns=True
    )
    through = [F.bool_or(F.coalesce(F.col("pass_number") == p, F.lit(False))) for p in passes]
    every = through[0]
    for one in through[1:]:
        every = every & one
    return stacked.groupBy("bill_id").agg(
        F.bool_or(F.col("voted_at").isNotNull()).alias("has_votes"),
        F.bool_or(F.col("completed_at").isNotNull()).alias("has_analysis"),
        every.alias("all_passes_completed"),
        F.max("voted_at").alias("votes_updated_at"),
        F.max("completed_at").alias("analysis_completed_at"),
    )


def ready(status: DataFrame, last_run: str = "stances_materialized_at") -> DataFrame:
    """Bills to process: both inputs complete, and never processed or changed since."""
    newest = F.greatest("votes_updated_at", "analysis_completed_at")
    due = F.col(last_run).isNull() | (newest > F.col(last_run))
    return status.filter(F.col("has_votes") & F.col("all_passes_completed") & due)


def changed_users(users: DataFrame, scores: DataFrame) -> DataFrame:
    """Users whose stances changed after their last score, or who have none yet."""
    scored = scores.groupBy("user_id").agg(F.max("last_updated").alias("_scored"))
    changed = F.col("last_stance_change_at")
    return (
        users.filter(changed.isNotNull())
        .join(scored, "user_id", "left")
        .filter(F.col("_scored").isNull() | (changed > F.col("_scored")))
        .select(*users.columns)
    )


def overlap(pairs: DataFrame, user_topics: DataFrame, member_topics: DataFrame) -> DataFrame:
    """For each pair: ``scored`` or ``no_overlap``, the number of shared topics, and
    the user's topics the member never voted on. Topics come from a closed
    vocabulary, so the list of one pair stays short."""
    mine = user_topics.select("user_id", "topic").distinct()
    theirs = distinct_keys(member_topics, ["member_id", "topic"]).withColumn("_shared", F.lit(1))
    joined = pairs.select("user_id", "member_id").join(mine, "user_id").join(
        theirs, ["member_id", "topic"], "left"
    )
    shared = F.count("_shared")
    unseen = F.collect_set(F.when(F.col("_shared").isNull(), F.col("topic")))
    return joined.groupBy("user_id", "member_id").agg(
        F.when(shared == 0, "no_overlap").otherwise("scored").alias("status"),
        shared.alias("shared_topics"),
        F.sort_array(unseen).alias("non_overlapping_topics"),
    )


def advance_stage(
    current: DataFrame, incoming: DataFrame, ranks: DataFrame, keys: Sequence[str], stage: str,
    rank: str = "rank",
) -> DataFrame:
    """The furthest stage each key has reached, one row per key. A write can only move a
    key forward, so late or concurrent writers cannot set it back. ``ranks`` orders the
    stages. Stages without a rank come before all others, NULL before those; of stages
    with equal rank the current one stays, or else the greatest of the incoming."""
    both = current.select(*keys, stage, F.lit(1).alias("_old")).unionByName(
        incoming.select(*keys, stage, F.lit(0).alias("_old"))
    )
    ranked = both.join(ranks.select(stage, F.col(rank).alias("_rank")), stage, "left")
    furthest = F.max(F.struct("_rank", F.col(stage).isNotNull().alias("_known"), "_old", stage)).alias("_furthest")
    return ranked.groupBy(*keys).agg(furthest).select(*keys, F.col(f"_furthest.{stage}").alias(stage))
