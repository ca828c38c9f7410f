"""The pipeline's stages one by one, and its whole run against the stages done by brute force."""

from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_components
from test_quality import brute_classifier
from tokenizers import Tokenizer

import corpus_pipeline
from evidencelake.llm import rules

CLASHING = ["copy_id", "rejected_key", "own", "th", "starts", "uid", "failed", "measures"]


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    """Documents with nulls, empty, repeated and long ones and with columns of the operators' own names; labels that trust none."""
    where = tmp_path_factory.mktemp("sf")
    long = docs.limit(1).select(F.lit(9000).cast("long").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30000)), lambda i: F.concat(F.lit("long"), i.cast("string")))).alias("text"), "lang", "source", F.lit(0).cast("long").alias("n_chars"), "failed")
    every = docs.unionByName(long).withColumns({c: F.lit(c) for c in CLASHING})
    every.write.parquet(f"{where}/documents.parquet")
    docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages_keep_columns_and_stand_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    repeated = docs.union(docs.where("doc_id in (3, 20)"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, repeated, folder)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert len(rows) <= repeated.count() and all(r["copy_id"] == "copy_id" and r["own"] == "own" for r in rows), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def without_repeats(texts):
    seen, out = set(), []
    for i, t in texts:
        data = t.encode()
        gone = bytearray(len(data))
        own = [data[p : p + 50] for p in range(len(data) - 49)]
        for p, x in enumerate(own):
            if x in seen:
                gone[p : p + 50] = b"\1" * 50
        seen.update(own)
        out.append((i, bytes(x for x, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def by_stages(rows, trusted):
    """The (doc_id, lang, text) rows left by each stage, the last as ids of tokens by document."""
    policy = rules.POLICIES[rules.CURRENT]
    passed = [r for r in rows if not any(eval(rules.RULES[x], {}, dict(zip(rules.MEASURES, rules.measure(r[2] or ""), strict=True))) for x in policy)]
    judged = brute_classifier(passed, trusted)
    clean = [(i, t) for i, _, t in passed if judged[i][1]]
    groups = brute_components(clean)
    kept = without_repeats([(i, t) for i, t in clean if groups[i][1] == i])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return passed, clean, {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in kept}


def run_and_compare(spark, where, trusted):
    rows = sorted(((r["doc_id"], r["lang"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang", "text").collect()), key=lambda r: r[0])
    passed, clean, want = by_stages(rows, trusted)
    found = defaultdict(list)
    for r in corpus_pipeline.run(spark, where).collect():
        found[r["doc_id"]].append((r["start"], r["ids"]))
    assert {i: [x for _, ids in sorted(parts) for x in ids] for i, parts in found.items()} == want
    return rows, passed, clean, want


def test_run_equals_the_stages_by_brute_force(spark, folder):
    rows, passed, clean, want = run_and_compare(spark, folder, set())
    assert 9000 in want and len(want) < len(passed) == len(clean) < len(rows)


def test_run_with_trusted_labels_equals_the_stages_by_brute_force(spark, folder, tmp_path):
    """The classifier rejects documents here, so what follows works on less."""
    every = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(9100 + i, " ".join(f"xQ{'abcdefg'[i]}z{'hijklmn'[k % 7]}jK{'opqrstuvwxyz'[k // 7]}" for k in range(84))) for i in range(3)]
    added = spark.createDataFrame(odd, "doc_id long, text string")
    every.unionByName(added, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    trusted = {r["doc_id"] for r in every.select("doc_id").collect() if r["doc_id"] % 5}
    spark.createDataFrame([(i, int(i in trusted), 0) for i in range(9200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    _, passed, clean, want = run_and_compare(spark, str(tmp_path), trusted)
    ids = {r[0] for r in passed}
    assert {9100, 9101, 9102} <= ids and not {9100, 9101, 9102} & {i for i, _ in clean}
    assert len(want) < len(clean) < len(passed) and len(clean) > 0.7 * len(passed)
