"""Results as a user gets them: written, not only collected."""

from tilewright.queries import QUERIES


def test_columns_that_differ_by_case_are_written(spark, sf_dir, tmp_path):
    before = spark.conf.get("spark.sql.caseSensitive")
    df = QUERIES["set1_concat"](spark, sf_dir)
    df.write.parquet(f"file://{tmp_path}/out")
    back = df.sparkSession.read.parquet(f"file://{tmp_path}/out")
    assert back.columns == ["imp", "T", "n", "n_pred", "t"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert spark.conf.get("spark.sql.caseSensitive") == before
    assert df.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
