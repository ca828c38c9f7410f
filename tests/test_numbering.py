"""Numbers over whole tables and within groups, by any partitioning."""

import random

import pytest

from evidencelake.operators import plan
from evidencelake.operators.numbering import placed


@pytest.mark.parametrize("n", ["1", "5"])
def test_numbers_within_groups_have_no_gaps(spark, n):
    spark.conf.set("spark.sql.shuffle.partitions", n)
    rng = random.Random(1)
    rows = [(rng.choice([None, "", "a", "hot", "hot", "hot", "é"]), rng.choice([None, *range(40)]), i) for i in range(600)]
    found = placed(spark.createDataFrame(rows, "g string, o long, i long"), ["o", "i"], "place", ["g"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {(g, i): p for g in {r[0] for r in rows} for p, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=key))}
    assert {(r["g"], r["i"]): r["place"] for r in found} == want and len(found) == len(rows)


def test_numbers_of_huge_uneven_and_missing_ordinals(spark):
    rows = [(2**62, "c"), (None, "d"), (-(2**62), "a"), (5, "b"), (None, "e")]
    found = {r["x"]: r["n"] for r in plan.numbered(spark.createDataFrame(rows, "o long, x string"), "o", "n").collect()}
    assert [found[x] for x in "abc"] == [1, 2, 3] and {found["d"], found["e"]} == {4, 5}
    assert plan.numbered(spark.createDataFrame([], "o long, x string"), "o", "n").count() == 0
