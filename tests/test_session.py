import shutil

from tradewind import session as S


def test_stage_is_built_once_and_rebuilt_when_its_folder_is_gone(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert S.staged(spark, "t1", build).count() == 5 and S.staged(spark, "t1", build).count() == 5
    assert len(calls) == 1
    path = S._STAGED[(spark.sparkContext.applicationId, "t1")]
    shutil.move(path, path + "-gone")
    spark.catalog.clearCache()
    assert S.staged(spark, "t1", build).count() == 5 and len(calls) == 2


def test_spread_leaves_wide_tables_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert S.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    assert S.spread(spark.range(10, numPartitions=3 * cores)).rdd.getNumPartitions() == 3 * cores


def test_spread_does_not_shuffle_a_table_with_a_split_a_core(spark):
    table = spark.range(10, numPartitions=spark.sparkContext.defaultParallelism)
    assert S.spread(table) is table
