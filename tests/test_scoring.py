import itertools
import random

from pyspark.sql import functions as F

from plenum.operators import scoring

EVIDENCE = "user_id int, member_id int, congress int, topic string, bill_id int, vote_id int, alignment_score double"


def evidence_rows():
    rng = random.Random(5)
    out = []
    for vote in range(120):
        bill = vote % 25
        for topic in rng.sample(["a", "b", "c"], rng.randint(1, 3)):
            for member in range(3):
                out.append((rng.randint(1, 2), member, bill % 4, topic, bill, vote, rng.randint(0, 8) / 8))
    return out


def test_score_rollup_against_brute_force(spark):
    data = evidence_rows()
    got = {
        (r["grain"], r["user_id"], r["member_id"], r["congress"], r["topic"]): (r["score"], r["bills"], r["votes"])
        for r in scoring.score_rollup(spark.createDataFrame(data, EVIDENCE)).collect()
    }
    want = {}
    for grain, by_c, by_t in (("overall", 0, 0), ("topic", 0, 1), ("congress", 1, 0), ("congress_topic", 1, 1)):
        groups = {}
        for u, m, c, t, b, v, s in data:
            groups.setdefault((grain, u, m, c if by_c else None, t if by_t else None), []).append((b, v, s))
        for key, rows in groups.items():
            want[key] = (sum(s for *_, s in rows) / len(rows), len({b for b, *_ in rows}), len({v for _, v, _ in rows}))
    assert got == want


def with_casts(df):
    return df.withColumns({"vote": F.expr("if(vote_id % 2 = 0, 'Yea', 'Nay')"), "stance": F.expr("concat('on ', topic)")})


def test_each_grain_is_the_rollup_of_it(spark):
    data = spark.createDataFrame([*evidence_rows(), (9, 9, 9, None, 900, 900, None)], EVIDENCE)
    rollup = scoring.score_rollup(data)
    for grain in ("overall", "topic", "congress", "congress_topic"):
        one = scoring.score_grain(data, grain)
        want = rollup.filter(F.col("grain") == grain).select(*one.columns)
        assert sorted(map(repr, one.collect())) == sorted(map(repr, want.collect()))
        assert one._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 0


def test_highlights_have_a_key_stance_and_vote(spark):
    data = [*evidence_rows(), (1, 0, 0, "a", 0, 999, None)]
    df = with_casts(spark.createDataFrame(data, EVIDENCE))
    parts = scoring.snapshot_scores(lambda g: scoring.score_grain(df, g), df, 3, "2026-01-01 00:00:00", "vote.recorded")
    got = {(r.score_id, r.bill_id, r.topic): (r.stance, r.vote, r.alignment, r.position)
           for r in parts["score_history_highlights"].collect()}
    assert len(got) == parts["score_history_highlights"].count()
    best = {}
    for u, m, _, t, b, v, s in data:
        if s is not None and ((u, m, t, b) not in best or (-s, v) < best[u, m, t, b]):
            best[u, m, t, b] = (-s, v)
    want = {}
    for u, m, t in {k[:3] for k in best}:
        ranked = sorted((*sv, b) for (*k, b), sv in best.items() if tuple(k) == (u, m, t))
        ranked = sorted(ranked, key=lambda x: (x[0], x[2]))[:3]
        for place, (s, v, b) in enumerate(ranked, 1):
            want[f"{u}/{m}/2026-01-01 00:00:00", b, t] = (f"on {t}", "Nay" if v % 2 else "Yea", -s, place)
    assert got == want


def test_snapshot_children_share_the_id(spark):
    df = with_casts(spark.createDataFrame(evidence_rows(), EVIDENCE))
    parts = scoring.snapshot_scores(scoring.score_rollup(df), df, 1, "2026-01-01 00:00:00", "vote.recorded")
    ids = {r["score_id"] for r in parts["score_history"].collect()}
    assert "1/0/2026-01-01 00:00:00" in ids
    for name in ("score_history_congress", "score_history_congress_topics", "score_history_highlights"):
        assert {r["score_id"] for r in parts[name].select("score_id").collect()} == ids
    top = parts["score_history_highlights"].groupBy("score_id", "topic").count()
    assert top.filter("count > 1").count() == 0
    assert parts["score_history"].filter("reasoning IS NULL").count() == len(ids)


def test_materialize_stances(spark, rows):
    positions = spark.createDataFrame([(1, 10, "Yea"), (2, 10, "Nay"), (1, 11, "Yea"), (1, 12, "Yea")], "member_id int, vote_id int, position string")
    votes = spark.createDataFrame([(10, 100, 118), (11, None, 118), (12, 101, 118)], "vote_id int, bill_id int, congress int")
    bills = spark.createDataFrame([(100,), (101,)], "bill_id int")
    analyses = spark.createDataFrame([(100, 1, "2024", ["old"]), (100, 2, "2025", ["tax", "health"])],
                                     "bill_id int, analysis_id int, completed_at string, topics array<string>")
    got = rows(scoring.materialize_stances(positions, votes, bills, analyses))
    assert got == [
        (1, 100, 10, "Yea", 118, ["tax", "health"]), (1, 101, 12, "Yea", 118, []),
        (2, 100, 10, "Nay", 118, ["tax", "health"]),
    ]


def test_align_bounds_and_direction(spark, rows):
    prefs = spark.createDataFrame([(1, "t", 1.0), (2, "t", -0.5)], "user_id int, topic string, user_stance_score double")
    topics = spark.createDataFrame([(9, "t", "Progressive")], "bill_id int, topic string, stance_direction string")
    requests = spark.createDataFrame([(1, 9), (2, 9), (2, 9), (3, 9)], "user_id int, bill_id int")
    assert rows(scoring.align(requests, prefs, topics), "user_id", "alignment_score") == [(1, 1.0), (2, 0.25)]


def test_extract_stances(spark, rows):
    responses = spark.createDataFrame([(1, "q1", "agree", None), (1, "q2", "no", None), (1, "q3", None, "text")],
                                      "user_id int, question_id string, selected_option string, custom_text string")
    options = spark.createDataFrame([("q1", "agree", 1.0, 4), ("q2", "no", -1.0, 9), ("q3", "agree", 1.0, 10)],
                                    "question_id string, option_value string, stance_multiplier double, importance_signal int")
    topics = spark.createDataFrame([("q1", "t", "Progressive", 1.0), ("q2", "t", "Conservative", 0.5), ("q3", "t", "Progressive", 1.0)],
                                   "question_id string, topic string, agree_stance string, weight double")
    assert rows(scoring.extract_stances(responses, options, topics)) == [(1, "t", 1.0, 9, 2)]


def test_overlap(spark, rows):
    pairs = spark.createDataFrame([(1, 7), (2, 7)], "user_id int, member_id int")
    mine = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "user_id int, topic string")
    theirs = spark.createDataFrame([(7, "a"), (7, "a"), (8, "c")], "member_id int, topic string")
    assert rows(scoring.overlap(pairs, mine, theirs)) == [(1, 7, "scored", 1, ["b"]), (2, 7, "no_overlap", 0, ["c"])]


def test_stage_does_not_depend_on_order(spark, rows):
    ranks = spark.createDataFrame([("IH", 1), ("RH", 2), ("ENR", 3)], "stage string, rank int")
    empty = spark.createDataFrame([], "bill int, stage string")
    for order in itertools.permutations(["IH", "ENR", "RH"]):
        state = empty
        for stage in order:
            state = scoring.advance_stage(state, spark.createDataFrame([(1, stage)], "bill int, stage string"), ranks, ["bill"], "stage")
        assert rows(state) == [(1, "ENR")]


def test_stage_keeps_unknown_and_tied_stages(spark, rows):
    ranks = spark.createDataFrame([("I", 1), ("O", 2), ("OO", 2)], "stage string, rank int")
    kind = "bill int, stage string"
    current = spark.createDataFrame([(1, "O"), (2, "X"), (3, None), (4, None), (5, "X")], kind)
    incoming = spark.createDataFrame([(1, "OO"), (4, "X"), (5, "I"), (6, "O"), (6, "OO"), (6, "I")], kind)
    found = scoring.advance_stage(current, incoming, ranks, ["bill"], "stage")
    assert rows(found) == [(1, "O"), (2, "X"), (3, None), (4, "X"), (5, "I"), (6, "OO")]


def test_score_is_a_mean_without_nulls(spark):
    cases = [(1, 2, 118, "a", 1, 1, 0.5), (1, 2, 118, "a", 1, 2, None), (1, 3, 118, "a", 1, 1, None)]
    df = spark.createDataFrame(cases, EVIDENCE)
    found = {(r["grain"], r["member_id"]): r["score"] for r in scoring.score_rollup(df).collect()}
    assert {found[g, 2] for g in ("overall", "topic", "congress", "congress_topic")} == {0.5}
    assert found["overall", 3] is None


def test_readiness_and_ready(spark, rows):
    votes = spark.createDataFrame([(1, "2024"), (2, "2024")], "bill_id int, voted_at string")
    analyses = spark.createDataFrame([(1, 1, "2025"), (1, 2, "2023"), (2, 1, "2025"), (3, 1, "2025"), (3, 2, "2025")],
                                     "bill_id int, pass_number int, completed_at string")
    status = scoring.readiness(votes, analyses, [1, 2])
    assert rows(status) == [
        (1, True, True, True, "2024", "2025"), (2, True, True, False, "2024", "2025"),
        (3, False, True, True, None, "2025"),
    ]
    runs = lambda at: status.withColumn("stances_materialized_at", F.lit(at).cast("string"))
    assert rows(scoring.ready(runs(None)), "bill_id") == [(1,)]
    assert rows(scoring.ready(runs("2026")), "bill_id") == []
    assert rows(scoring.ready(runs("2024")), "bill_id") == [(1,)]


def test_changed_users(spark, rows):
    users = spark.createDataFrame([(1, "2025"), (2, "2023"), (3, "2025"), (4, None)], "user_id int, last_stance_change_at string")
    scores = spark.createDataFrame([(1, "2024"), (2, "2024"), (1, "2022")], "user_id int, last_updated string")
    assert rows(scoring.changed_users(users, scores), "user_id") == [(1,), (3,)]


def test_changed_scores_equal_all_evidence_scored_anew(spark):
    """Rows come, go and are corrected, some without alignment or key; one pair loses all."""
    rng = random.Random(8)
    before = evidence_rows() + [(1, 0, 1, None, 3, None, None), (None, 2, 1, "a", 5, 5, 0.1), (9, 9, 1, "a", 1, 1, 0.3)]
    gone = [r for r in before if r[0] == 9] + rng.sample([r for r in before if r[1] == 0], 20)
    corrected = rng.sample([r for r in before if r[1] == 1], 10)
    came = [(1, 0, 2, "c", 900, 901, 0.7), (7, 7, 1, "b", 1, 1, 0.2), (None, 2, 1, "a", 6, 6, None), (1, 0, 1, "d", 3, 11, float("nan"))]
    after = list(before)
    for r in gone + corrected:
        after.remove(r)
    after += came + [(*r[:6], 0.9) for r in corrected]
    signed = [(*r, -1) for r in gone + corrected] + [(*r, 1) for r in came] + [(*r[:6], 0.9, 1) for r in corrected]
    changes = spark.createDataFrame(signed, EVIDENCE + ", sign int")
    parts = scoring.score_parts(spark.createDataFrame(before, EVIDENCE))
    known = [(*r[:6], None if r[6] != r[6] else r[6]) for r in after]
    final = spark.createDataFrame(known, EVIDENCE)

    def plain(df):
        cols = [c for c in ("user_id", "member_id", "congress", "topic") if c in df.columns]
        return sorted(
            [(*[r[c] for c in cols], None if r["score"] is None else round(r["score"], 9), r["bills"], r["votes"]) for r in df.collect()],
            key=repr,
        )

    for grain in ("overall", "topic", "congress", "congress_topic"):
        stored = scoring.scores_of_parts(parts, grain)
        assert plain(scoring.rescored(parts, stored, changes, grain)) == plain(scoring.score_grain(final, grain))
        assert plain(scoring.rescored(parts, stored, changes.limit(0), grain)) == plain(stored)
    kept = scoring.changed_parts(parts, changes)
    assert kept.select("user_id", "member_id").distinct().count() < parts.select("user_id", "member_id").distinct().count()


def test_rollup_keeps_rows_of_a_bill_in_place(spark, rows):
    """Rows that a join has put by bill are not shuffled again before the bill is summed up;
    votes on several topics count once in the grains over all topics."""
    data = [(u, m, c, t, 10 * c + b, 100 * c + 10 * b + v, float(v)) for u in (1, None) for m in (1, 2) for c in (1, 2)
            for t in ("x", "y", None) for b in (0, 1) for v in (0, 1, 2) if t != "y" or v < 2]
    schema = "user_id int, member_id int, congress int, topic string, bill_id int, vote_id int, alignment_score double"
    found = scoring.score_rollup(spark.createDataFrame(data, schema).repartition("bill_id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not any("vote_id" in line for line in moved) and sum("bill_id" in line for line in moved) <= 2
    overall = [tuple(r) for r in found.filter("grain = 'overall'").select("user_id", "member_id", "bills", "votes").collect()]
    assert sorted(overall, key=repr) == sorted([(u, m, 4, 12) for u in (1, None) for m in (1, 2)], key=repr)
    assert found.filter("grain = 'congress_topic'").count() == 24
