"""Derived inputs that several readers share."""

from pyspark.sql import functions as F

from checks import views

SMALL = "/root/testdata/sf0.001"


def hashed(df):
    return df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()


def test_shared_base_gives_the_same_inputs_without_reading_the_tables_again(spark):
    with views.shared_base(spark, SMALL) as base:
        shared = [
            views.captured_a(spark, SMALL, base), views.captured_b(spark, SMALL, base), views.captures(spark, SMALL, "brand", base=base)
        ]
    alone = [views.captured_a(spark, SMALL), views.captured_b(spark, SMALL), views.captures(spark, SMALL, "brand")]
    for one, other in zip(shared, alone, strict=True):
        assert hashed(one) == hashed(other)
        assert not [f for f in one.inputFiles() if "lineitem" in f]
