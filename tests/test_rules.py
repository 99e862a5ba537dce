import hashlib
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plenum.functions import scalar
from plenum.functions.text import chunk, reassemble
from plenum.operators import aggregates, filters, quality
from plenum.operators.aggregates import list_cols
from plenum.schema import seeds
from plenum.schema.domains import DOMAINS
from plenum.session import shared_dir


def broken(df, rule):
    return sorted(r["id"] for r in quality.violations(df, ["id"], rule).collect())


def test_xor_identity(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5, 6), (3, 5, None), (4, None, 6)], "id int, m long, l long")
    assert broken(df, quality.exactly_one("m", "l")) == [1, 2]


def test_candidate_name(spark):
    df = spark.createDataFrame(
        [(1, "Yea", "Jeffries"), (2, "Candidate", None), (3, "Candidate", "Jeffries"), (4, None, None), (5, "Nay", None)],
        "id int, position string, name string",
    )
    assert broken(df, quality.present_iff("name", "position = 'Candidate'")) == [1, 2]


def test_union_shapes(spark):
    legal = [(1, None, None, None), (2, "BILL", "hr", None), (3, "AMENDMENT", None, "hamdt")]
    illegal = [(4, "BILL", None, "hamdt"), (5, "AMENDMENT", "hr", None), (6, None, "hr", None),
               (7, "BILL", "hr", "hamdt"), (8, "MOTION", None, None)]
    df = spark.createDataFrame(legal + illegal, "id int, kind string, bill_type string, amendment_type string")
    rule = quality.union_shape("kind", {"BILL": "bill_type", "AMENDMENT": "amendment_type"})
    assert broken(df, rule) == [4, 5, 6, 7, 8]


def test_checks_pass_on_null(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, 0.5)], "id int, score double")
    assert broken(df, quality.within("score", 0, 1)) == [2]
    assert broken(df, quality.not_null("score")) == [1]


def test_domain_report_and_strict(spark):
    df = spark.createDataFrame([(1, "IH"), (2, "BOGUS"), (3, None)], "id int, code string")
    codes = DOMAINS["text_version_code_type"]
    assert broken(df, quality.in_domain("code", codes)) == [2]
    lenient = df.select(scalar.to_domain("code", codes, strict=False).alias("c")).collect()
    assert [r["c"] for r in lenient] == ["IH", None, None]
    with pytest.raises(PySparkException, match="outside its domain: BOGUS"):
        df.select(scalar.to_domain("code", codes)).collect()


def test_unique_treats_nulls_as_distinct(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5), (2, 5)], "a int, b int")
    assert rows(quality.unique_violations(df, ["a", "b"])) == [(2, 5, 2)]
    assert len(rows(quality.unique_violations(df, ["a", "b"], nulls_distinct=False))) == 2
    assert rows(quality.unique_violations(df, ["a", "b"], where=F.col("a") < 2)) == []


def test_orphans_skip_partly_null_references(spark, rows):
    child = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, 9, 9)], "id int, a int, b int")
    parent = spark.createDataFrame([(1, 1)], "x int, y int")
    assert rows(quality.orphans(child, parent, {"a": "x", "b": "y"}), "id") == [(3,)]


def test_quality_report_counts_in_one_pass(spark, rows):
    df = spark.createDataFrame([(1, None), (2, 7)], "id int, n int")
    got = rows(quality.quality_report(df, quality.not_null("n"), quality.within("n", 0, 5)), "rule", "violations", "rows")
    assert got == [("n_not_null", 1, 2), ("n_range", 1, 2)]


def test_dim_report(spark, rows):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "v array<float>")
    assert rows(quality.dim_report(df, "v", 2)) == [(1, 1, False), (2, 1, True)]


def test_needs_refresh_with_missing_stored_code(spark, rows):
    bills = spark.createDataFrame([(1, "IH", 5), (2, "IH", None), (3, None, 5), (4, "RH", 5)], "id int, expected string, version_id int")
    versions = spark.createDataFrame([(5, "IH")], "version_id int, stored string")
    got = filters.needs_refresh(bills, versions, version_id="version_id", expected="expected", stored="stored")
    assert rows(got, "id") == [(2,), (4,)]


def test_null_profile_diff(spark, rows):
    a = spark.createDataFrame([(1, None, None)], "x int, y int, z int")
    b = spark.createDataFrame([(1, None, 3)], "x int, y int, z int")
    assert rows(aggregates.null_profile_diff(a, b)) == [("z", 1, 0)]


def test_status_rule(spark, rows):
    df = spark.createDataFrame([(3, 0), (3, 1), (3, 3)], "items_processed long, items_failed long")
    assert [r[2] for r in rows(aggregates.derive_status(df))] == ["completed", "completed_with_errors", "failed"]


def test_natural_keys(spark, rows):
    df = spark.createDataFrame([(118, "Senate", 1, 42), (118, None, 1, 42)], "c int, ch string, s int, r int")
    keyed = df.select(scalar.natural_key("c", "ch", "s", "r").alias("k"))
    assert rows(keyed) == [("118-Senate-1-42",), (None,)]
    parts = keyed.filter("k is not null").select(*scalar.parse_key("k", ["c", "ch", "s", "r"], ["int", "string", "int", "int"]))
    assert rows(parts) == [(118, "Senate", 1, 42)]


def test_map_values_modes(spark, rows):
    df = spark.createDataFrame([("Chair",), ("Member",)], "p string")
    kept = df.select(scalar.map_values("p", {"Chair": "Chairman"}))
    nulled = df.select(scalar.map_values("p", {"Chair": "Chairman"}, "null"))
    assert rows(kept) == [("Chairman",), ("Member",)]
    assert rows(nulled) == [("Chairman",), (None,)]


def split(text, size, overlap):
    step, out = size - overlap, []
    i = 0
    while text and (i == 0 or i * step + overlap < len(text)):
        out.append(text[i * step : i * step + size])
        i += 1
    return out


@pytest.mark.parametrize("size,overlap", [(5, 0), (5, 2), (7, 6), (100, 10)])
def test_chunks_against_brute_force(spark, size, overlap):
    texts = ["", "a", "abcde", "abcdef", "héllo wörld ✓ 𝄞𝄞 " * 40, "x" * 333, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r["id"], r["chunk_index"]): r["content"] for r in chunk(df, "text", size, overlap).collect()}
    want = {(i, n): c for i, t in enumerate(texts) for n, c in enumerate(split(t, size, overlap))}
    assert got == want
    raw = {(r["id"], r["chunk_index"]): bytes(r["content"]) for r in chunk(df, "text", size, overlap, unit="bytes").collect()}
    want = {(i, n): c for i, t in enumerate(texts) for n, c in enumerate(split((t or "").encode(), size, overlap))}
    assert raw == want


@pytest.mark.parametrize("unit", ["chars", "bytes"])
def test_chunks_of_long_texts_take_time_in_proportion(spark, tmp_path, unit):
    """16 MB in chunks of 500, read from a table, against slices of the text itself."""
    text = "".join(f"word {i} ✓ " for i in range(1_100_000))[: 16 << 20]
    data = text if unit == "chars" else text.encode()
    spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id int, text string").write.parquet(f"{tmp_path}/t")
    began = time.monotonic()
    cut = chunk(spark.read.parquet(f"{tmp_path}/t"), "text", 500, 100, unit=unit)
    got = cut.select("id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("m")).collect()
    assert time.monotonic() - began < 30
    want = {(1, n): c for n, c in enumerate(split(data, 500, 100))}
    want[2, 0] = "short" if unit == "chars" else b"short"
    plain = {k: c.encode() if unit == "chars" else c for k, c in want.items()}
    assert {(r.id, r.chunk_index): r.m for r in got} == {k: hashlib.md5(c).hexdigest() for k, c in plain.items()}


def test_long_texts_come_back_in_parts(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    parts = reassemble(chunk(df, "text", 10, 3), ["id"], "chunk_index", "content", overlap=3, part_chunks=16).collect()
    assert len(parts) > 3
    assert "".join(r["content"] for r in sorted(parts, key=lambda r: r["part"])) == text


def test_a_long_text_is_one_row(spark):
    text = "".join(chr(97 + i % 26) for i in range(10_050))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert [r["content"] for r in reassemble(chunk(df, "text", 1), ["id"], "chunk_index", "content").collect()] == [text]


def test_intermediates_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_lists_keep_repeats(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, None), (2, 1, None)], "k int, o int, v string")
    assert rows(list_cols(df, ["k"], "v", "o")) == [(1, "a,a,b"), (2, None)]


def test_seeds(spark):
    assert seeds.us_states(spark).distinct().count() == 56
    assert seeds.us_states(spark).filter("is_territory").count() == 6
    assert seeds.finding_types(spark).select("code").distinct().count() == 12
    assert seeds.concept_taxonomy(spark).first()["name"] == "unclassified"


def test_references_in_one_shuffle(spark, rows):
    """NULL parts, keys of two columns, self references, other types, repeated parents."""
    nodes = spark.createDataFrame([(1, None, 1, "a"), (2, 1, 1, None), (3, 9, 2, "b"), (3, 3, 1, "b")], "id int, up int, x int, y string")
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c")], "x bigint, y string")
    none = pairs.limit(0)
    tables = {"nodes": nodes, "pairs": pairs, "none": none}
    refs = [
        ("nodes", {"up": "id"}, "nodes"), ("nodes", {"x": "x", "y": "y"}, "pairs"), ("pairs", {"x": "id"}, "nodes"),
        ("nodes", {"x": "x"}, "none"), ("none", {"x": "x"}, "pairs"), ("none", {"x": "id"}, "nodes"),
    ]
    found = rows(quality.reference_violations(tables, refs), "child", "columns", "parent", "orphans")
    slow = [(c, ",".join(on), p, quality.orphans(tables[c], tables[p], on).count()) for c, on, p in refs]
    assert found == sorted(slow, key=repr) and ("nodes", "x,y", "pairs", 2) in found


def test_hot_reference_is_counted_before_the_shuffle(spark):
    child = spark.range(30000).select((F.col("id") % 3 * F.col("id")).alias("p"))
    report = quality.reference_violations({"c": child, "p": spark.range(10)}, [("c", {"p": "id"}, "p")])
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and plan.count("hashpartitioning(target") <= 3
    assert report.first()["orphans"] == child.filter("p >= 10").count()
