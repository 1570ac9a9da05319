"""Relational queries on small cases that the test tables don't have."""

from tessera.queries import relational as R


def test_a_small_return_is_a_return(spark):
    part = spark.createDataFrame([(1, "large"), (2, "small"), (3, "kept"), (4, "unsold")], "p_partkey long, p_name string")
    lines = [(1, "R", 45.0), (2, "R", 1.0), (3, "N", 45.0), (None, "R", 2.0)]
    lineitem = spark.createDataFrame(lines, "l_partkey long, l_returnflag string, l_quantity double")
    assert sorted(map(tuple, R.parts_never_returned(part, lineitem).collect())) == [(3, "kept"), (4, "unsold")]
