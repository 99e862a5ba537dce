import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.functions.vector import cosine_distance, distance_to
from plenum.operators import metric_tree, similarity
from plenum.operators.components import connected_components


def vectors(spark, n, seed, clusters=6, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    points = centres[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, width))
    points[n // 3 : n // 2] = points[0]  # many equal vectors
    points = points.astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, embedding array<float>")
    return df, points.astype(np.float64)


def brute(queries, base, digits=6):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(1 - unit(queries) @ unit(base).T, digits) + 0.0


@pytest.mark.parametrize("k", [1, 5, 400])
def test_knn_join_equals_brute_force(spark, k):
    left, q = vectors(spark, 50, 1)
    right, b = vectors(spark, 300, 2)
    distances = brute(q, b)
    got = {}
    pairs = similarity.knn_join(left, right, k, left_id="id", right_id="id", block_rows=40)
    for r in pairs.collect():
        got.setdefault(r["left_id"], []).append((r["position"], r["right_id"], r["distance"]))
    assert len(got) == 50
    for i, found in got.items():
        want = sorted((d, j) for j, d in enumerate(distances[i]))[:k]
        assert [j for _, j, _ in sorted(found)] == [j for _, j in want]
        assert [d for *_, d in sorted(found)] == pytest.approx([d for d, _ in want])


def test_knn_join_with_itself_and_unusable_vectors(spark):
    df, _ = vectors(spark, 60, 3)
    df = df.unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 8)], df.schema))
    pairs = similarity.knn_join(df, df, 2, left_id="id", right_id="id", skip_same=True).collect()
    assert len(pairs) == 120
    assert all(p["left_id"] != p["right_id"] and p["right_id"] < 900 for p in pairs)


def test_joins_with_nothing_on_one_side(spark):
    df, _ = vectors(spark, 20, 7)
    none = df.filter("id < 0")
    for left, right in ((df, none), (none, df), (none, none)):
        assert similarity.knn_join(left, right, 2, left_id="id", right_id="id").count() == 0
    nodes = none.withColumnRenamed("id", "node_id")
    labels = similarity.classify(df, nodes, 0.5, group_id="id", node_id="node_id", unclassified=7)
    assert labels.filter("node_id = 7 AND score = 0").count() == 20


def test_vectors_of_different_widths_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.5, 1.0]), (3, [1.0, 0.0, 1.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="different widths"):
        similarity.knn_join(df, df, 1, left_id="id", right_id="id").collect()


def test_within_distance_equals_brute_force(spark):
    left, q = vectors(spark, 40, 4)
    right, b = vectors(spark, 80, 5)
    want = {(i, j) for i, row in enumerate(brute(q, b)) for j, d in enumerate(row) if d <= 0.25}
    got = similarity.within_distance(left, right, 0.25, left_id="id", right_id="id").collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == want and len(got) == len(want)


def test_classify_falls_back(spark, rows):
    groups = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0]), (3, None)], "group_id long, embedding array<float>")
    nodes = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.9, 0.5])], "node_id long, embedding array<float>")
    got = rows(similarity.classify(groups, nodes, 0.8, group_id="group_id", node_id="node_id", unclassified=0))
    assert [(g, n) for g, n, _ in got] == [(1, 7), (1, 8), (2, 0), (3, 0)]
    assert all(0 <= s <= 1 for _, _, s in got)


def test_distances_of_odd_vectors(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [])],
        "id int, v array<float>",
    ).withColumn("q", F.array(F.lit(1.0), F.lit(0.0)))
    for distance in (cosine_distance("v", "q"), distance_to("v", [1.0, 0.0])):
        got = [r["d"] for r in df.orderBy("id").select(distance.alias("d")).collect()]
        assert got == [0.0, 0.0, 2.0, None, None, None, None]


def test_knn_orders_and_filters(spark, rows):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<float>")
    assert [r[0] for r in rows(similarity.knn(df, [1.0, 0.0], 2, id_="id", vector="v"), "id")] == [1, 3]
    only = similarity.knn(df, [1.0, 0.0], 2, id_="id", vector="v", where=F.col("id") > 1)
    assert [r[0] for r in rows(only, "id")] == [2, 3]


def test_concept_groups_are_components_of_near_sections(spark):
    df, points = vectors(spark, 150, 6)
    rows = [(900, None), (901, [0.0] * 8), (902, [0.0] * 8), (3, [float(x) for x in points[3]]), (None, [1.0] * 8)]
    df = df.unionByName(spark.createDataFrame(rows, df.schema))
    near = brute(points, points) <= 0.02
    group = list(range(150))
    for _ in range(150):
        group = [min(group[j] for j in np.flatnonzero(near[i])) for i in range(150)]
    got = similarity.concept_groups(df, 0.02, id_="id", block_rows=20).collect()
    assert sorted(map(tuple, got)) == sorted([*enumerate(group), (900, 900), (901, 901), (902, 902)])
    assert 3 < len(set(group)) < 150
    assert similarity.concept_groups(df.limit(0), 0.02, id_="id").count() == 0
    assert similarity.concept_groups(df.filter("id > 899"), 0.02, id_="id").count() == 3


def test_clustered_vectors_are_mostly_never_compared(spark):
    df, points = vectors(spark, 4000, 9, clusters=60, width=16)
    df = df.filter("id < 1333 or id >= 2000")  # without the many equal ones
    report = {}
    pairs = similarity.knn_join(df, df, 3, left_id="id", right_id="id", skip_same=True, block_rows=64, report=report)
    ids = np.array([i for i in range(4000) if not 1333 <= i < 2000])
    distances = brute(points[ids], points[ids])
    np.fill_diagonal(distances, 9)
    want = {(int(ids[i]), int(ids[j])) for i, row in enumerate(distances) for j in np.lexsort((ids, row))[:3]}
    assert {(r["left_id"], r["right_id"]) for r in pairs.collect()} == want
    assert report["vectors"] == len(ids) and report["compared"] < 0.25 * len(ids) ** 2


def test_tree_bounds_never_lose_a_vector():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(900, 5))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = metric_tree.Tree(points[:30])
    cell, gap = tree.nearest(points)
    every = metric_tree.gaps(points, tree.centres)
    assert (cell == every.argmin(axis=1)).all() and np.allclose(gap, every.min(axis=1))
    for c in range(30):
        tree.reach[c], tree.inner[c] = gap[cell == c].max(), gap[cell == c].min()
    row, found = tree.within(points, np.full(900, 0.3))
    visited = set(zip(row.tolist(), found.tolist()))
    near = np.argwhere(metric_tree.gaps(points, points) <= 0.3)
    assert all((i, cell[j]) in visited for i, j in near.tolist())
    assert len(visited) < 900 * 30 / 2
    row, found = tree.filled(points, np.bincount(cell, minlength=30), 50)
    held = np.zeros(900, np.int64)
    np.add.at(held, row, np.bincount(cell, minlength=30)[found])
    assert (held >= 50).all()


def test_components_of_chains_and_stars(spark):
    nodes = spark.createDataFrame([(i,) for i in [*range(60), 100, 101, 102, 5, None]], "n long")
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (41, 41), (50, 777), (None, 3), (777, 51)]
    df = spark.createDataFrame(links, "a long, b long")
    found = connected_components(nodes, df, node="n", a="a", b="b").collect()
    want = {i: 0 if i <= 40 else i for i in range(60)} | {100: 100, 101: 100, 102: 100}
    assert sorted(map(tuple, found), key=repr) == sorted([*want.items(), (5, 0), (None, None)], key=repr)
    assert connected_components(nodes, df.limit(0), node="n", a="a", b="b").filter("component <> n").count() == 0


def test_chained_names_components():
    rng = np.random.default_rng(3)
    for _ in range(50):
        keep = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.2
        mine, theirs = similarity._chained(keep)
        whole = np.block([[np.eye(len(keep)), keep], [keep.T, np.eye(keep.shape[1])]])
        reach = np.linalg.matrix_power(whole, 20) > 0
        for i, row in enumerate(reach):
            cols = np.flatnonzero(row[len(keep) :])
            want = cols[0] if len(cols) and (i < len(keep) or keep[:, i - len(keep)].any()) else -1
            assert (mine[i] if i < len(keep) else theirs[i - len(keep)]) == want


def test_near_pairs_equal_those_of_all_distances_in_double():
    rng = np.random.default_rng(5)
    right = rng.normal(size=(1500, 12))
    right[700:900] = right[0]
    right[900:1000] += 1e-5 * rng.normal(size=(100, 12))
    left = np.concatenate([right[::2], rng.normal(size=(300, 12))])
    left, right = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (left, right))
    same = np.where(np.arange(len(left)) < 750, 2 * np.arange(len(left)), -1)
    whole = np.round(1.0 - left @ right.T, 6) + 0.0
    whole[np.flatnonzero(same >= 0), same[same >= 0]] = np.inf
    for wanted in (np.full(len(left), np.inf), np.sort(whole, axis=1)[:, 2], np.where(same >= 0, np.inf, 0.3)):
        rows, cols, distance = similarity._near(left, right, wanted, same, 3, 6)
        for r in range(len(left)):
            best = np.lexsort((np.arange(1500), whole[r]))[:3]
            best = best[whole[r, best] <= wanted[r]]
            assert cols[rows == r].tolist() == best.tolist() and np.allclose(distance[rows == r], whole[r, best])
    rows, cols, distance = similarity._near(left, right, np.full(len(left), 0.4), same, None, 6)
    assert len(rows) == (whole <= 0.4).sum() and (whole[rows, cols] <= 0.4).all()
