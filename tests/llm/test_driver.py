"""What is brought to the driver."""

from pyspark.sql import functions as F

from evidencelake.llm import knclassify, nearjoin

from test_dedup import brute_components


def test_signatures_of_many_nodes_are_not_broadcast(spark, docs, texts, monkeypatch):
    seen, plain = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (seen.append(df.columns), plain(df))[1])
    monkeypatch.setattr(nearjoin, "SIGNED", -1, raising=False)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_groups(docs).collect()} == brute_components(texts)
    base = [f"w{i}" for i in range(100)]
    rows = [(i or None, " ".join(base[:i] + [f"own{i}"] + base[i + 1 :])) for i in range(3)]
    found = nearjoin.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in found) == [(0, 1), (1, 1), (2, 1)]
    assert not [c for c in seen if "sig" in c]


def test_trusted_ids_are_found_once(spark):
    """Once to count them and once to join them, not for each threshold."""
    read = spark.sparkContext.accumulator(0)
    labels = spark.createDataFrame(spark.sparkContext.parallelize([(i, 1) for i in range(50)], 1).map(lambda r: (read.add(1), r)[1]), "doc_id long, quality int")
    found = spark.createDataFrame([(i, i, "en" if i % 2 else "fr", 100, -200.0 - i) for i in range(80)], "uid long, doc_id long, lang string, n_grams long, log_prob double")
    assert knclassify.judged(found, labels).count() == 80
    assert read.value <= 100
