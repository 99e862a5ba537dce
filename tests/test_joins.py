import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plenum.operators import joins
from plenum.operators.tree import resolve_ancestor

POSITIONS = "id long, vote_id long, member_id long, lis_member_id long, position string"


def test_resolved_view(spark, rows):
    positions = spark.createDataFrame(
        [(1, 9, 10, None, "Yea"), (2, 9, None, 501, "Nay"), (3, 9, None, 502, "Nay")], POSITIONS
    )
    mapping = spark.createDataFrame([(20, 501)], "member_id long, lis_member_id long")
    got = rows(joins.resolve_identity(positions, mapping))
    assert got == [(1, 9, 10, None, "Yea"), (2, 9, 20, 501, "Nay")]


def test_alias_with_two_members_gives_two_rows(spark):
    positions = spark.createDataFrame([(2, 9, None, 501, "Nay")], POSITIONS)
    mapping = spark.createDataFrame([(20, 501), (21, 501)], "member_id long, lis_member_id long")
    assert joins.resolve_identity(positions, mapping).count() == 2


def test_remap_strict_fails_on_an_orphan_lenient_gives_null(spark, rows):
    child = spark.createDataFrame([(1, "a"), (2, "zz")], "id long, parent string")
    parent = spark.createDataFrame([("a", 70)], "natural_key string, id long")
    lenient = joins.remap_fk(child, parent, "parent", "natural_key", "id", strict=False)
    assert rows(lenient) == [(1, 70), (2, None)]
    strict = joins.remap_fk(child, parent, "parent", "natural_key", "id", strict=True)
    with pytest.raises(PySparkException, match="no parent for parent = zz"):
        strict.collect()


def test_lookup_update_keeps_unmatched_and_sets_null_on_match(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    lookup = spark.createDataFrame([(1, "new"), (2, None)], "k2 long, w string")
    assert rows(joins.lookup_update(df, lookup, {"k": "k2"}, {"v": "w"})) == [
        (1, "new"), (2, None), (3, "z")
    ]


def test_lookup_update_picks_the_smallest_of_many(spark, rows):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    lookup = spark.createDataFrame([(1, 8), (1, 5)], "k2 long, w long")
    assert rows(joins.lookup_update(df, lookup, {"k": "k2"}, {"step": "w"}, pick="min")) == [(1, 5), (2, None)]


def test_normalize_codes_leaves_codes_and_unknown_names(spark, rows):
    df = spark.createDataFrame([("california",), ("CA",), ("Atlantis",), (None,)], "state string")
    lookup = spark.createDataFrame([("California", "CA")], "name string, code string")
    got = rows(joins.normalize_codes(df, "state", lookup, "name", "code"))
    assert sorted(got, key=repr) == sorted([("CA",), ("CA",), ("Atlantis",), (None,)], key=repr)


def test_drop_orphans_keeps_rows_without_reference(spark, rows):
    child = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id long, fk long")
    parent = spark.createDataFrame([(7,), (None,)], "key long")
    assert rows(joins.drop_orphans(child, parent, "fk", "key")) == [(1, 7), (3, None)]


def test_branch_lookup_uses_one_side_only(spark, rows):
    df = spark.createDataFrame([(1, 5, 6), (2, None, 6), (3, 9, 6)], "id long, a long, b long")
    a = spark.createDataFrame([(5, "A5")], "key long, v string")
    b = spark.createDataFrame([(6, "B6")], "key long, v string")
    got = joins.branch_lookup(df, a, b, a_key="a", b_key="b", lookup_key="key", values=["v"])
    assert rows(got, "id", "v") == [(1, "A5"), (2, "B6"), (3, None)]


def test_pairing_by_chamber(spark, rows):
    users = spark.createDataFrame([("u", "CA", 12), ("w", "CA", 13)], "user_id string, state string, district int")
    members = spark.createDataFrame(
        [(1, "CA", 12, "House"), (2, "CA", None, "Senate"), (3, "CA", None, "Senate"), (4, "TX", None, "Senate")],
        "member_id long, state string, district int, chamber string",
    )
    got = rows(joins.pair(users, members), "user_id", "member_id", "district", "chamber")
    assert got == [
        ("u", 1, 12, "House"), ("u", 2, None, "Senate"), ("u", 3, None, "Senate"),
        ("w", 2, None, "Senate"), ("w", 3, None, "Senate"),
    ]


def test_stale_pairs(spark, rows):
    old = spark.createDataFrame([(1, 2), (1, 3)], "user_id long, member_id long")
    new = spark.createDataFrame([(1, 3), (1, 4)], "user_id long, member_id long")
    assert rows(joins.stale_pairs(old, new, ["user_id", "member_id"])) == [(1, 2, "stale"), (1, 4, "missing")]


def test_ancestor_handles_depth_cycles_and_missing_parents(spark, rows):
    chain = [(i, i - 1 if i else None, f"p{i}") for i in range(40)]
    cycle = [(100, 101, "c"), (101, 100, "c"), (102, 100, "c")]
    dangling = [(200, 999, "d"), (201, 200, "d")]
    nodes = spark.createDataFrame(chain + cycle + dangling, "id long, parent long, bill string")
    got = {r["id"]: (r["root_id"], r["depth"], r["root_bill"]) for r in resolve_ancestor(nodes, "id", "parent", ["bill"]).collect()}
    assert {got[i] for i in range(40)} == {(0, i, "p0") for i in range(40)}
    assert all(got[i] == (None, None, None) for i in (100, 101, 102, 200, 201))
    assert len(got) == len(chain + cycle + dangling)


def test_ancestor_of_nothing(spark):
    nodes = spark.createDataFrame([], "id long, parent long, bill string")
    assert resolve_ancestor(nodes, "id", "parent", ["bill"]).count() == 0


def test_map_pairs_drops_unknown_keys(spark, rows):
    links = spark.createDataFrame([("a", "x"), ("a", "?"), ("b", "x")], "l string, r string")
    left = spark.createDataFrame([("a", 1), ("b", 2)], "nk string, id long")
    right = spark.createDataFrame([("x", 9)], "nk string, id long")
    got = joins.map_pairs(links, left, right, left_on=("l", "nk"), right_on=("r", "nk"),
                          left_id="id", right_id="id", names=("left_id", "right_id"))
    assert rows(got) == [(1, 9), (2, 9)]


def test_unprocessed_and_processed(spark, rows):
    work = spark.createDataFrame([(1,), (2,)], "version_id long")
    done = spark.createDataFrame([(2,), (2,)], "version_id long")
    assert rows(joins.unprocessed(work, done, "version_id")) == [(1,)]
    assert rows(joins.processed(work, done, "version_id")) == [(2,)]
    assert joins.unprocessed(work, done.filter(F.lit(False)), "version_id").count() == 2
