from plenum.session import FILE_BYTES, TASK_BYTES, materialize, partitions_by_input, shared_dir


class Conf:
    def __init__(self, values):
        self.get = values.get


class Named:
    """A session whose cluster names a shared folder."""

    conf = Conf({"spark.checkpoint.dir": "hdfs://shared/tmp/"})


def test_folder_named_by_the_cluster_is_used():
    assert shared_dir(Named()) == "hdfs://shared/tmp"


def test_unset_folder_is_set_once(spark):
    assert shared_dir(spark) == shared_dir(spark) != ""


def test_materialized_table_is_read_back_from_the_folder(spark):
    df = materialize(spark.range(10).withColumnRenamed("id", "k"), "numbers")
    assert df.count() == 10 and df.columns == ["k"]
    assert all(f"{shared_dir(spark)}/numbers-".split(":")[-1] in f for f in df.inputFiles())


def test_shuffle_partitions_grow_with_the_files(spark, tmp_path):
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(k, None) for k in keys]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a").write_bytes(bytes(9 * FILE_BYTES + 1))
    (tmp_path / "b").write_bytes(b"x")
    try:
        partitions_by_input(spark, str(tmp_path / "b"))
        assert spark.conf.get(keys[0]) == before[0]
        partitions_by_input(spark, str(tmp_path / "t"), str(tmp_path / "b"))
        assert [spark.conf.get(k) for k in keys] == ["10", str(TASK_BYTES)]
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def test_scans_are_cut_where_tables_are_large(spark, tmp_path):
    """Stored rows are grouped as they are scanned, so a task's memory follows its files."""
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    keys += ["spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"]
    before = [spark.conf.get(k, None) for k in keys]
    table = str(tmp_path / "t")
    spark.range(0, 4_000_000, 1, 8).selectExpr("xxhash64(id) AS k").write.parquet(table)  # 32 MB
    try:
        spark.conf.set(keys[3], "1")
        partitions_by_input(spark, table)
        assert spark.read.parquet(table).rdd.getNumPartitions() >= 4
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value) if value else spark.conf.unset(key)
