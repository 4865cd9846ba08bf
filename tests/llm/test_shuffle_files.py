"""Written intermediate tables leave the session's settings as they were."""

import pytest
from pyspark.sql import functions as F

from lapreplay.llm import common


def test_setting_is_put_back(spark):
    for before in ("false", "true"):
        spark.conf.set(common.CLEANUP, before)
        out = common.written(spark.range(100).repartition(3, "id"), "kept")
        assert spark.conf.get(common.CLEANUP) == before and out.count() == 100
        with pytest.raises(Exception, match="lost"):
            common.written(spark.range(3).select(F.raise_error(F.lit("lost")).alias("x")), "failed")
        assert spark.conf.get(common.CLEANUP) == before
    spark.conf.unset(common.CLEANUP)


def test_a_table_can_be_written_twice(spark):
    d = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    a, b = common.written(d, "one"), common.written(d.join(common.written(d, "two").withColumnRenamed("count", "c"), "k"), "three")
    assert a.count() == b.count() == d.count() == 7
