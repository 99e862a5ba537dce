from pyspark.sql import types as T

from plenum.schema import model
from plenum.schema.domains import DOMAINS
from plenum.sources import merge


def test_size_of_the_model():
    tables = model.tables()
    references = [r for t in tables.values() for r in t.references]
    assert len(tables) == 67
    assert len(references) == 107 and sum(r.cascade for r in references) == 46
    assert sum(len(t.widths) for t in tables.values()) == 21
    assert {w for t in tables.values() for w in t.widths.values()} == {1024}


def test_every_name_resolves(spark):
    tables = model.tables()
    for table in tables.values():
        names = set(table.schema.names)
        assert names and len(names) == len(table.schema.names)
        assert set(table.domains.values()) <= set(DOMAINS)
        for key in table.keys:
            assert set(key.columns) <= names
        assert set(model.INTENDED_KEYS.get(table.name, ())) <= names
        for ref in table.references:
            assert set(ref.columns) <= names
            assert set(ref.parent_columns) <= set(tables[ref.parent].schema.names)
        for rule in table.rules():
            assert rule.name


def test_some_columns():
    votes = model.tables()["vote_positions"]
    assert votes.schema["vote_id"].dataType == T.LongType() and not votes.schema["vote_id"].nullable
    assert votes.domains["position"] == "vote_cast_type"
    assert model.Key(("vote_id", "member_id"), "member_id IS NOT NULL") in votes.keys
    stances = model.tables()["member_bill_stance_topics"]
    composite = [r for r in stances.references if len(r.columns) == 3]
    assert composite[0].parent == "member_bill_stances" and composite[0].cascade


def rows_for(table, *given):
    """Rows with the given values and NULL elsewhere, in the table's shape."""
    names = model.tables()[table].schema.names
    return [tuple(g.get(n) for n in names) for g in given]


def frame(spark, table, *given):
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in model.tables()[table].schema])
    return spark.createDataFrame(rows_for(table, *given), shape)


def test_integrity_report(spark):
    data = {
        "lis_members": frame(spark, "lis_members", {"id": 1, "natural_key": "S1"}, {"id": 1, "natural_key": None}),
        "vote_positions": frame(
            spark, "vote_positions",
            {"id": 1, "vote_id": 5, "lis_member_id": 1, "position": "Yea"},
            {"id": 2, "vote_id": 5, "lis_member_id": 1, "position": "Candidate"},
            {"id": 3, "vote_id": 5, "lis_member_id": 9, "member_id": 4, "position": "Maybe"},
        ),
    }
    found = {(r["table"], r["rule"]): r["violations"] for r in model.integrity_report(data).collect() if r["violations"]}
    assert found[("lis_members", "unique(id)")] == 1
    assert found[("lis_members", "natural_key_not_null")] == 1
    assert found[("vote_positions", "unique(vote_id,lis_member_id)")] == 1
    assert found[("vote_positions", "lis_member_id→lis_members")] == 1
    assert found[("vote_positions", "member_id_xor_lis_member_id")] == 1
    assert found[("vote_positions", "position_domain")] == 1
    assert found[("vote_positions", "vote_cast_candidate_name_presence")] == 1
    assert ("vote_positions", "unique(vote_id,member_id)") not in found


def test_scan_and_cascade_of_the_model(spark, rows, tmp_path):
    bills = frame(spark, "bills", {"id": 1}, {"id": 2})
    subjects = frame(spark, "bill_subjects", {"id": 10, "bill_id": 1}, {"id": 20, "bill_id": 2})
    for name, df in (("bills", bills), ("bill_subjects", subjects)):
        df.write.parquet(str(tmp_path / name))
    stored = {n: model.scan(spark, str(tmp_path), n) for n in ("bills", "bill_subjects")}
    assert stored["bill_subjects"].columns == model.tables()["bill_subjects"].schema.names
    cascades = [c for c in model.cascades() if c[0] in stored and c[2] in stored]
    left = merge.cascade_delete(stored, cascades, "bills", stored["bills"].filter("id = 1").select("id"))
    assert rows(left["bill_subjects"], "id") == [(20,)]


def test_every_reference_of_the_model_in_one_shuffle(spark):
    """A row with all references set and a row with none, in every table: each reference is
    reported, and each counts the one that points nowhere."""
    data, expected = {}, {}
    for name, table in model.tables().items():
        data[name] = spark.createDataFrame([], table.schema)
    for name, table in model.tables().items():
        for ref in table.references:
            expected[(name, f"{'+'.join(ref.columns)}→{ref.parent}")] = 0
    refs = [
        (n, dict(zip(r.columns, r.parent_columns)), r.parent) for n, t in model.tables().items() for r in t.references
    ]
    report = model.quality.reference_violations(data, refs)
    plan = report._jdf.queryExecution().executedPlan().toString()
    scans = sum(bool(t.references) or any(r.parent == n for u in model.tables().values() for r in u.references)
                for n, t in model.tables().items())
    assert len(refs) == 107 and plan.count("Generate explode") <= scans
    found = {(r["child"], r["columns"].replace(",", "+") + "→" + r["parent"]): r["orphans"] for r in report.collect()}
    assert found == expected
