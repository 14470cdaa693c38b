from merchlens.session import cut_lineage, scratch_path, shared_folder


def test_scratch_lives_in_the_shared_folder(spark):
    folder = shared_folder(spark)
    assert scratch_path(spark, "x").startswith(folder) and shared_folder(spark) == folder


def test_cut_lineage_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, {"a b": "c"}, None)], "id long, `odd (name)` map<string,string>, n int")
    cut = cut_lineage(df)
    assert cut.dtypes == df.dtypes and cut.collect() == df.collect()
    assert cut_lineage(df.limit(0)).count() == 0
