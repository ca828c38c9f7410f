"""Assignment in the source's order against the rule carried out one record after the other."""

import random

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import assignment, linkage

KEYS = "id string, priority int, key_type string, key_value string"


def sequential(source, target):
    """source: id to (at, keys), target: id to keys."""
    used, out, unsure = set(), {}, set()
    for s, (_, keys) in sorted(source.items(), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])):
        found = {t: next(k for k in keys if k in target[t]) for t in target if set(keys) & set(target[t])}
        free = [t for t in found if t not in used]
        if not found:
            out[s] = ("no_candidate", None, None, 0)
        elif len(free) == 1:
            used.add(free[0])
            out[s] = ("matched", free[0], "=".join(found[free[0]]), len(found))
        else:
            unsure |= set(found)
            out[s] = ("multiple_candidates" if free else "no_available_candidate", None, None, len(found))
    return out, sorted(t for t in target if t not in used and t not in unsure)


def run(spark, source, target):
    rows = lambda side: [(i, n, *k) for i, keys in side.items() for n, k in enumerate(keys)]
    s, t = (spark.createDataFrame(rows(x), KEYS) for x in ({i: k for i, (_, k) in source.items()}, target))
    order = spark.createDataFrame([(i, at) for i, (at, _) in source.items()], "id string, at long")
    found = assignment.assign(s, t, order)
    left = assignment.left_over(found, s, t, spark.createDataFrame([(i,) for i in target], "id string"))
    return {r["source_id"]: (r["status"], r["target_id"], r["key"], r["n_candidates"]) for r in found.collect()}, sorted(r["id"] for r in left.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_crossing_candidates(spark, seed):
    rng = random.Random(seed)
    side = lambda n, x: {f"{x}{i}": [k for k in (("key", str(rng.randrange(n))), ("doi", str(rng.randrange(n // 2))), ("title", rng.choice(["hot", *map(str, range(n))]))) if rng.random() < 0.6] for i in range(n)}
    source = {i: (rng.choice([None, *range(30)]), keys) for i, keys in side(60, "s").items()}
    target = side(50, "t")
    assert run(spark, source, target) == sequential(source, target)


def test_chains_of_records_that_wait_for_each_other(spark):
    target = {f"t{i}": [("key", str(i)), ("doi", str(i + 1))] for i in range(6)}
    source = {f"s{i}": (i, [("key", str(i)), ("doi", str(i))]) for i in range(6)}
    assert run(spark, source, target) == sequential(source, target)
    assert run(spark, {}, target) == ({}, sorted(target)) and run(spark, source, {})[0] == dict.fromkeys(source, ("no_candidate", None, None, 0))


def test_frequent_title_makes_no_pairs(spark):
    n = 20_000
    side = lambda x: linkage.match_keys(spark.range(n).select(F.concat(F.lit(x), "id").alias("id"), F.col("id").alias("doi")), doi=F.col("doi"), title=F.lit("editorial"))
    found = assignment.assign(side("s"), side("t"), spark.range(n).select(F.concat(F.lit("s"), "id").alias("id"), F.col("id").alias("at")))
    assert [tuple(r) for r in found.groupBy("status", "n_candidates").count().collect()] == [("multiple_candidates", n, n)]  # 400 million pairs
