from plenum.operators import evolve, ids, windows
from plenum.sources import io, merge
from pyspark.sql import functions as F
import random

import pytest

VERSION = "amendment_id long, version_type string, format_type string, url string, note string"
KEYS = ["amendment_id", "version_type", "format_type"]


def test_upsert_changes_listed_columns_only(spark, rows):
    empty = spark.createDataFrame([], VERSION)
    one = spark.createDataFrame([(90044, "SUB", "PDF", "u/v1", "first")], VERSION)
    two = spark.createDataFrame([(90044, "SUB", "PDF", "u/v2", "second")], VERSION)
    once = merge.upsert(empty, one, KEYS, ["url"], ["url"])
    twice = merge.upsert(once, two, KEYS, ["url"], ["url"])
    assert rows(twice) == [(90044, "SUB", "PDF", "u/v2", "first")]
    assert rows(merge.upsert(twice, two, KEYS, ["url"], ["url"])) == rows(twice)


def test_upsert_orders_conflicting_source_rows(spark, rows):
    target = spark.createDataFrame([(1, "old")], "k long, v string")
    src = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "k long, v string")
    assert rows(merge.upsert(target, src, ["k"], ["v"], [F.col("v").desc()])) == [(1, "b"), (2, "d")]


def test_upsert_can_set_null_and_null_keys_never_conflict(spark, rows):
    target = spark.createDataFrame([(1, "old"), (None, "x")], "k long, v string")
    src = spark.createDataFrame([(1, None), (None, "y"), (None, "y")], "k long, v string")
    got = rows(merge.upsert(target, src, ["k"], ["v"], ["v"]))
    assert got == sorted([(1, None), (None, "x"), (None, "y"), (None, "y")], key=repr)


def test_insert_if_absent_never_overwrites(spark, rows):
    shape = "member_id long, start_year int, party string, source string"
    target = spark.createDataFrame([(1, 2009, "Democrat", "old")], shape)
    src = spark.createDataFrame(
        [(1, 2009, "Democrat", "new"), (1, 2009, "Republican", "b"), (1, 2009, "Republican", "a")], shape
    )
    keys = ["member_id", "start_year", "party"]
    once = merge.insert_if_absent(target, src, keys, ["source"])
    expected = [(1, 2009, "Democrat", "old"), (1, 2009, "Republican", "a")]
    assert rows(once) == expected
    assert rows(merge.insert_if_absent(once, src, keys, ["source"])) == expected


def test_replace_by_key_is_idempotent_and_leaves_loose_rows(spark, rows):
    shape = "version_id long, chunk_index int, content string"
    target = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (None, 0, "loose")], shape)
    src = spark.createDataFrame([(1, 0, "A")], shape)
    once = merge.replace_by_key(target, src, "version_id")
    assert rows(once) == sorted([(1, 0, "A"), (2, 0, "c"), (None, 0, "loose")], key=repr)
    assert rows(merge.replace_by_key(once, src, "version_id")) == rows(once)


def test_enrich_does_not_clobber(spark, rows):
    shape = "id long, title string, summary string"
    target = spark.createDataFrame([(1, "T", "S"), (2, None, None)], shape)
    src = spark.createDataFrame([(1, None), (2, "new"), (3, "placeholder")], "id long, title string")
    got = merge.enrich(target, src, ["id"], ["title"], ["title"])
    assert rows(got) == [(1, "T", "S"), (2, "new", None), (3, "placeholder", None)]


def test_archive_takes_placeholders_and_newer_rows_only(spark, rows):
    shape = "id long, title string, updated string"
    current = spark.createDataFrame([(1, None, None), (2, "B", "2024"), (3, "C", "2026"), (4, "D", "2024")], shape)
    incoming = spark.createDataFrame([(1, "A", "2025"), (2, "B2", "2025"), (3, "C2", "2025")], shape)
    got = merge.archive_changed(current, incoming, ["id"], "2026-01-01", updated="updated")
    assert rows(got, "id", "title") == [(1, None), (2, "B")]
    children = spark.createDataFrame([(1, "x"), (3, "y")], "bill_id long, name string")
    history = got.withColumn("history_id", F.col("id") + 100)
    assert rows(merge.archive_children(children, history, {"bill_id": "id"}, "history_id")) == [(101, 1, "x")]


def test_cascade_through_two_levels_and_two_paths(spark, rows):
    tables = {
        "bills": spark.createDataFrame([(1,), (2,)], "id long"),
        "votes": spark.createDataFrame([(10, 1), (20, 2)], "id long, bill_id long"),
        "positions": spark.createDataFrame(
            [(1, 10, None), (2, 20, None), (3, 20, 1), (4, None, None)], "id long, vote_id long, bill_id long"
        ),
    }
    cascades = [
        ("votes", ["bill_id"], "bills", ["id"]),
        ("positions", ["vote_id"], "votes", ["id"]),
        ("positions", ["bill_id"], "bills", ["id"]),
    ]
    left = merge.cascade_delete(tables, cascades, "bills", tables["bills"].filter("id = 1"))
    assert rows(left["bills"]) == [(2,)]
    assert rows(left["votes"]) == [(20, 2)]
    assert [r[0] for r in rows(left["positions"])] == [2, 4]


def survivors(tables, cascades, root, doomed):
    """The rows that are left when deletions are repeated until nothing changes."""
    gone = {n: set() for n in tables}
    gone[root] = {i for i, r in enumerate(tables[root]) if any(all(r[k] == d[k] for k in d) for d in doomed)}
    while True:
        before = sum(map(len, gone.values()))
        for child, ours, parent, theirs in cascades:
            keys = {tuple(tables[parent][i][c] for c in theirs) for i in gone[parent]}
            gone[child] |= {i for i, r in enumerate(tables[child]) if tuple(r[c] for c in ours) in keys and None not in [r[c] for c in ours]}
        if sum(map(len, gone.values())) == before:
            return {n: [r for i, r in enumerate(rows) if i not in gone[n]] for n, rows in tables.items()}


LOOP = [
    ("nodes", ["parent"], "nodes", ["id"]),
    ("links", ["a", "b"], "nodes", ["id", "kind"]),
    ("nodes", ["via"], "links", ["link"]),
    ("leaves", ["link"], "links", ["link"]),
    ("leaves", ["leaf_of"], "leaves", ["leaf"]),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_cascade_through_self_references_and_loops(spark, rows, seed):
    rng = random.Random(seed)
    some = lambda n, none=0.3: None if rng.random() < none else rng.randrange(n)
    tables = {
        "nodes": [{"id": i, "kind": i % 3, "parent": some(i) if i else None, "via": some(90, 0.6)} for i in range(80)],
        "links": [{"link": i, "a": (a := some(80, 0.1)), "b": None if a is None else a % 3 if rng.random() < 0.8 else 9} for i in range(60)],
        "leaves": [{"leaf": i, "link": some(70), "leaf_of": some(60, 0.6), "note": "x"} for i in range(60)],
        "other": [{"id": 1}],
    }
    schemas = {
        "nodes": "id long, kind int, parent long, via long", "links": "link long, a long, b int",
        "leaves": "leaf long, link long, leaf_of long, note string", "other": "id long",
    }
    tables["nodes"].append(dict(tables["nodes"][5]))
    frames = {n: spark.createDataFrame([tuple(r.values()) for r in found], schemas[n]) for n, found in tables.items()}
    left = merge.cascade_delete(frames, LOOP, "nodes", spark.createDataFrame([(70,), (3,), (999,)], "id long"))
    want = survivors(tables, LOOP, "nodes", [{"id": 70}, {"id": 3}])
    assert sorted(left) == ["leaves", "links", "nodes"]
    for name, df in left.items():
        assert df.columns == frames[name].columns
        assert rows(df) == sorted((tuple(r.values()) for r in want[name]), key=repr)
    assert 0 < len(want["nodes"]) < 81


def test_cascade_of_nothing(spark, rows):
    nodes = spark.createDataFrame([(1, None), (2, 1)], "id long, parent long")
    left = merge.cascade_delete({"nodes": nodes}, [("nodes", ["parent"], "nodes", ["id"])], "nodes", nodes.select("id").limit(0))
    assert rows(left["nodes"]) == [(1, None), (2, 1)]


def test_parents_come_first_and_loops_together():
    cascades = [("b", ["x"], "a", ["x"]), ("c", ["x"], "b", ["x"]), ("b", ["x"], "c", ["x"]), ("d", ["x"], "c", ["x"]), ("e", ["x"], "a", ["x"])]
    groups = merge._parents_first(merge._reach("a", cascades), cascades)
    assert groups[0] == ["a"] and groups.index(["b", "c"]) < groups.index(["d"]) and ["e"] in groups


def test_insert_select_fills_defaults(spark, rows):
    target = spark.createDataFrame([(1, "a")], "id long, origin string")
    got = io.insert_select(target, spark.createDataFrame([(2,)], "id int"), {"origin": F.lit("new")})
    assert rows(got) == [(1, "a"), (2, "new")]
    with pytest.raises(Exception):
        io.insert_select(target, spark.createDataFrame([(2,)], "id int")).collect()


def test_write_version_refuses_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id long")
    path = str(tmp_path / "v1")
    io.write_version(df, path)
    with pytest.raises(Exception):
        io.write_version(df, path)
    io.append(df, path)
    assert io.scan(spark, path, "id long", ["id"]).count() == 2


def test_ids_are_dense_continue_and_repeat(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("natural_key"))
    first = ids.assign_ids(keys, "natural_key", after=41)
    again = ids.assign_ids(keys.repartition(7), "natural_key", after=41)
    numbers = sorted(r["id"] for r in first.collect())
    assert numbers == list(range(42, 5042))
    assert first.exceptAll(again).count() == 0


def test_next_id_of_an_empty_table(spark, rows):
    assert rows(ids.next_id(spark.createDataFrame([], "id long"), "id")) == [(1,)]


def test_trend_over_slices_equals_one_window(spark):
    from pyspark.sql import Window

    points = spark.range(400).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("at"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7) % 13).alias("v"),
    )
    got = windows.trend(points, ["k"], ["at"], "v", F.floor(F.col("at") / 50))
    w = Window.partitionBy("k").orderBy("at")
    want = points.withColumn("previous", F.lag("v").over(w)).withColumn("delta", F.col("v") - F.col("previous"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 2)
    plan = windows.top_per_key(df, ["k"], ["id"], 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_split_bridge(spark, rows):
    mapping = spark.createDataFrame([("L1", "m1"), ("L1", "m2"), ("L2", "m1"), ("L3", "??")], "lis string, member string")
    members = spark.createDataFrame([("m1", 1), ("m2", 2)], "nk string, id long")
    dim, bridge = evolve.split_bridge(mapping, "lis", "member", members, "nk", "id")
    number = {r["lis"]: r["id"] for r in dim.collect()}
    assert sorted(number.values()) == [1, 2, 3]
    assert rows(bridge) == sorted([(number["L1"], 1), (number["L1"], 2), (number["L2"], 1)])


def test_collapse_picks_smallest_step_and_drops_unmapped(spark, rows):
    results = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, None)], "id long, run_id string")
    steps = spark.createDataFrame([("r1", 9), ("r1", 4)], "run_id string, id long")
    assert rows(evolve.collapse(results, steps, "run_id", "id")) == [(1, 4)]


def test_evolution_guards(spark):
    df = spark.createDataFrame([(1, "x")], "id long, a string")
    assert evolve.add_column(df, "a", "int", 5).schema == df.schema
    assert evolve.drop_columns(df, "zzz").columns == ["id", "a"]
    assert evolve.reset_vector(df, "v").schema["v"].dataType.simpleString() == "array<float>"
