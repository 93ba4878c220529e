from pathlib import Path

from ranksmith import storage


def test_folder_named_by_the_session_wins(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    used = storage.checkpoint_dir(spark)
    assert used == spark.sparkContext.getCheckpointDir()
    if named is not None:
        assert named in used


def test_copy_keeps_rows_columns_and_types(spark):
    table = spark.createDataFrame([(1, "b", 2.0), (2, "a/ö", None)], "x int, kind string, `y z` double")
    for by in (None, "kind"):
        copy = storage.written(table, "copy", by)
        assert copy.dtypes == table.dtypes
        assert sorted(map(tuple, copy.collect())) == sorted(map(tuple, table.collect()))


def test_scratch_can_be_cleared(spark):
    path = storage.scratch_path(spark, "gone")
    storage.written(spark.range(3), "gone", path=path)
    local = Path(path.removeprefix("file:"))
    assert local.is_dir()
    storage.remove(spark, path)
    assert not local.exists()
