import pytest

import __spark_entry__ as entry
from framelake.plans import catalogue

from .compare import assert_same
from .conftest import DATA


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert name in catalogue.SQL
    assert_same(ours, duck.sql(catalogue.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_results_do_not_depend_on_partitions(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(tuple, catalogue.QUERIES["winsor_clip"](spark, DATA).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == sorted(map(tuple, catalogue.QUERIES["winsor_clip"](spark, DATA).collect()))
