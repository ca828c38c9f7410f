"""Assigning records of a source to records of a target one to one, in the source's order, without listing pairs.

The rule: records of the source come in order. One takes a target record if exactly one of those that share a key with it
is still free; if there are more, or none is free any more, it is ambiguous and takes nothing.

Done in rounds. What a record finds under one key depends only on how many records of that key are free, and, if it is
one, on which: so each key keeps its two target records that are free the longest, not its pairs. A record is decided once
undecided earlier ones can't change what it finds:

* more than one is free for sure under one of its keys. Earlier records with that key take nothing then, so only records
  without it count as rivals, and all records of a frequent title are decided at once;
* or it finds at most one under each key, and no undecided earlier record has a key of those.

The earliest undecided record of each connected part is always decided, so rounds end; they are as many as the longest
chain of records that wait for each other. Every round is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.operators.numbering import placed
from evidencelake.sources.scratch import kept

NEVER = (1 << 63) - 1
MATCHED, SEVERAL, NONE_FREE, NO_CANDIDATE = "matched", "multiple_candidates", "no_available_candidate", "no_candidate"


def key_lists(keys: DataFrame, name: str) -> DataFrame:
    """name and keys: a record's few keys, as 'type=value', by their priority. keys: id, priority, key_type, key_value."""
    entry = F.struct("priority", F.concat_ws("=", "key_type", "key_value").alias("key"))
    return keys.groupBy(F.col("id").alias(name)).agg(F.transform(F.array_sort(F.collect_set(entry)), lambda x: x["key"]).alias("keys"))


def _pairs(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each two different keys of a record: other and key."""
    each = df.select(*columns, "keys", F.explode("keys").alias("key"))
    return each.select(*columns, "key", F.explode("keys").alias("other")).where("other <> key")


def _decided(waiting: DataFrame, targets: DataFrame, taken: DataFrame) -> DataFrame:
    """waiting (source_id, at, keys) with status and target_id; a null status is undecided."""
    asked = waiting.select("source_id", "at", F.explode("keys").alias("key"))
    rivals = asked.groupBy("key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = _pairs(waiting).groupBy("key", "other").agg(F.count(F.lit(1)).alias("n_shared"))
    # the earliest undecided record that could take a target, and the same without those that have the key in question
    per_key = targets.select("target_id", "keys", F.explode("keys").alias("key"))
    of_target = per_key.join(rivals, "key").groupBy("target_id").agg(F.min("first").alias("first"))
    others = _pairs(targets, "target_id").join(rivals.withColumnRenamed("key", "other"), "other").join(shared, ["key", "other"], "left")
    outside = others.where("n > coalesce(n_shared, 0)").groupBy("target_id", "key").agg(F.min("first").alias("outside"))
    held = per_key.drop("keys").join(of_target, "target_id").join(outside, ["target_id", "key"], "left").join(taken, "target_id", "left")
    never = F.lit(NEVER)
    free = held.select("key", "target_id", "first", F.coalesce("taken_at", never).alias("until"), F.least(F.coalesce("taken_at", never), F.coalesce("outside", never)).alias("surely"))
    top = lambda by: free.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(by), "target_id"))).where("rank <= 2")  # noqa: E731  (tasks keep two of a key before rows are dealt out)
    longest = top("until").groupBy("key").agg(F.max_by(F.struct("target_id", "first", "until"), F.when(F.col("rank") == 1, 1)).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("until"))).alias("second"))
    surest = top("surely").where("rank = 2").select("key", F.col("surely").alias("second_surely"))
    seen = asked.join(longest, "key").join(surest, "key", "left")
    found = seen.groupBy("source_id").agg(
        F.coalesce(F.bool_or(F.col("second_surely") >= F.col("at")), F.lit(False)).alias("several"), F.coalesce(F.bool_or(F.col("second") > F.col("at")), F.lit(False)).alias("open"),
        F.collect_set(F.when(F.col("best.until") > F.col("at"), F.struct("best.target_id", (F.col("best.first") >= F.col("at")).alias("sure")))).alias("left"),
    )
    sure = F.size(F.filter("left", lambda x: x["sure"]))
    status = F.when(F.col("several") | (~F.col("open") & (sure > 1)), SEVERAL).when(~F.col("open") & (F.size("left") == 0), NONE_FREE).when(~F.col("open") & (F.size("left") == 1) & (sure == 1), MATCHED)
    verdict = found.select("source_id", status.alias("status"), F.get(F.col("left.target_id"), F.lit(0)).alias("only"))
    return waiting.join(verdict, "source_id").select("source_id", "at", "keys", "status", F.when(F.col("status") == MATCHED, F.col("only")).alias("target_id"))


def candidate_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """source_id and n_candidates: how many different target records share a key with it, from counts of key combinations.

    Both have keys, a list of a few; as many rows as a list has subsets are made, and no pair.
    """
    def subsets(df: DataFrame, *columns: str) -> DataFrame:
        most = df.agg(F.max(F.size("keys"))).first()[0] or 0
        sets = [F.array(*(F.get("keys", F.lit(i)) for i in c)) for n in range(1, most + 1) for c in combinations(range(most), n)]
        own = df.select(*columns, F.explode(F.array(*(F.array_sort(s) for s in sets))).alias("subset")) if sets else df.select(*columns, F.lit(None).cast("array<string>").alias("subset"))
        return own.where("not exists(subset, x -> x is null)")

    sizes = subsets(target).groupBy("subset").agg(F.count(F.lit(1)).alias("n"))
    signed = subsets(source, "source_id").join(sizes, "subset").withColumn("n", F.when(F.size("subset") % 2 == 1, F.col("n")).otherwise(-F.col("n")))
    return signed.groupBy("source_id").agg(F.sum("n").alias("n_candidates"))


def listed_candidates(source: DataFrame, target: DataFrame) -> DataFrame:
    """source_id, target_id and key of the keys that one record alone has on either side; other keys are in candidate_counts."""
    side = lambda df, name: df.select(name, F.explode("keys").alias("key"))
    single = lambda df: side(df, df.columns[0]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    few = single(source).withColumnRenamed("n", "a").join(single(target).withColumnRenamed("n", "b"), "key").where("a = 1 or b = 1").select("key")
    return side(source, "source_id").join(few, "key").join(side(target, "target_id"), "key").select("source_id", "target_id", "key")


def assign(source_keys: DataFrame, target_keys: DataFrame, order: DataFrame, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """source_id, at (its place in the order, from 0), status, target_id, key (the first that both have) and n_candidates, for every record of order.

    The keys have id, priority, key_type and key_value; order has id and at, of any ordered type: equal ones go by id.
    """
    places = placed(order.select(F.col("id").alias("source_id"), F.col("at").alias("given")), ["given", "source_id"], "at", keep=keep).select("source_id", "at")
    target = keep(key_lists(target_keys, "target_id"))
    every = keep(places.join(key_lists(source_keys, "source_id"), "source_id", "left"))
    known = target.select(F.explode("keys").alias("key")).distinct()
    # only keys that the target has count
    useful = every.select("source_id", F.posexplode("keys").alias("pos", "key")).join(known, "key").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("keys"))
    waiting = first = keep(every.select("source_id", "at").join(useful, "source_id").select("source_id", "at", "keys"))
    done: list[DataFrame] = []
    while not waiting.isEmpty():
        matched = [d.where(F.col("status") == MATCHED).select("target_id", F.col("at").alias("taken_at")) for d in done]
        taken = reduce(DataFrame.unionByName, matched) if matched else target.limit(0).select("target_id", F.lit(None).cast("long").alias("taken_at"))
        done.append(keep(_decided(waiting, target, taken)))
        waiting = done[-1].where("status is null").select("source_id", "at", "keys")
    verdicts = reduce(DataFrame.unionByName, [d.where("status is not null") for d in done]) if done else first.select("*", F.lit(None).cast("string").alias("status"), F.lit(None).cast(dict(target.dtypes)["target_id"]).alias("target_id"))
    with_key = verdicts.join(target.withColumnRenamed("keys", "own"), "target_id", "left").withColumn("key", F.get(F.array_intersect("keys", "own"), F.lit(0)))
    counted = with_key.join(candidate_counts(first, target), "source_id").select("source_id", "status", "target_id", "key", "n_candidates")
    return every.select("source_id", "at").join(counted, "source_id", "left").select(
        "source_id", "at", F.coalesce("status", F.lit(NO_CANDIDATE)).alias("status"), "target_id", "key", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
    )


def left_over(assigned: DataFrame, source_keys: DataFrame, target_keys: DataFrame, target_ids: DataFrame) -> DataFrame:
    """id of the target records that nothing takes and that are no candidate of an ambiguous record."""
    unsure = assigned.where(F.col("status").isin(SEVERAL, NONE_FREE)).select(F.col("source_id").alias("id"))
    blocked = source_keys.join(unsure, "id", "left_semi").select("key_type", "key_value").distinct()
    touched = target_keys.join(blocked, ["key_type", "key_value"]).select("id")
    taken = assigned.where(F.col("status") == MATCHED).select(F.col("target_id").alias("id"))
    return target_ids.select("id").join(touched.unionByName(taken).distinct(), "id", "left_anti")


def match_name(number: Column) -> Column:
    """match-0001, match-0002, ...; with more digits from 10,000 on."""
    text = number.cast("string")
    return F.concat(F.lit("match-"), F.when(number < 10_000, F.lpad(text, 4, "0")).otherwise(text))
