import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import test_quality

from evidencelake.llm import common, knpoints, registry

ORDER = knpoints.ORDER


def brute_points(texts):
    """Interpolated modified Kneser-Ney over code points by dictionaries, from the uniform distribution up."""
    grams = lambda t: [t[i : i + ORDER] for i in range(len(t or "") - ORDER + 1)]
    levels = {ORDER: Counter(g for t in texts for g in grams(t or ""))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    lower = lambda _: 1 / (len(levels[1]) + 1)
    for k in range(1, ORDER + 1):
        counts, kinds = levels[k], Counter(levels[k].values())
        y = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] else 0.5
        d1 = min(0.95, max(0.1, 1 - 2 * y * kinds[2] / kinds[1])) if kinds[1] else 0.5
        d2 = min(1.9, max(0.1, 2 - 3 * y * kinds[3] / kinds[2])) if kinds[2] else 0.7
        d3 = min(2.9, max(0.1, 3 - 4 * y * kinds[4] / kinds[3])) if kinds[3] else 0.9
        total, left = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            left[g[:-1]] += (d1, d2, d3)[min(n, 3) - 1]

        def p(g, counts=counts, total=total, left=left, lower=lower, d=(d1, d2, d3)):
            n, head = counts.get(g, 0), g[:-1]
            return (n - (d[min(n, 3) - 1] if n else 0) + left[head] * lower(g[1:])) / total[head] if total[head] else lower(g[1:])

        lower = p
    top = lower
    return lambda text: (len(grams(text or "")), sum(math.log(top(g)) for g in grams(text or "")))


def test_every_code_point_counts(spark, docs, texts, empty, monkeypatch):
    """Against brute force: nulls, empty, short and repeated texts, a language without a model, several blocks to a batch,
    and texts in another script that differ in letters alone, which classes of characters can't tell from one another."""
    monkeypatch.setattr(test_quality, "brute_model", brute_points)
    cyrillic = "тихая река течёт мимо старой мельницы и снова шумит у камней "
    odd = "".join(chr(0x430 + (ord(c) * 7 + i) % 32) if c != " " else c for i, c in enumerate(cyrillic))
    added = [(700 + i, cyrillic * 3, "ru") for i in range(25)] + [(800, odd * 3, "ru"), (801, "the an st", "fr"), (802, "日本", "ru"), (803, "😀" * 9, "en")]
    every = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(added, "doc_id long, text string, lang string"))
    every = every.union(every.where("doc_id = 7"))
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in every.collect()]
    trusted = {i for i, _ in texts if i % 4} | set(range(700, 724))
    want = test_quality.brute_classifier(rows, trusted)
    found = knpoints.classify(every, spark.createDataFrame([(i, 1) for i in trusted], "doc_id long, quality int")).collect()
    assert len(found) == len(rows)
    for r in found:
        perplexity, kept = want[r["doc_id"]]
        assert (r["perplexity"] is None) if perplexity is None else math.isclose(r["perplexity"], perplexity, rel_tol=1e-6), r
        assert r["kept"] == kept, r
    assert want[724][1] and not want[800][1]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert knpoints.classify(empty, labels).count() == 0 and knpoints.classify(docs, labels.limit(0)).where("kept").count() == docs.count()


def test_the_query_tells_scripts_apart(spark, tmp_path):
    """Words as long as trusted ones, of other letters of the same script, are not kept."""
    good = "тихая река течёт мимо старой мельницы и шумит у камней " * 4
    odd = "".join(chr(0x430 + (ord(c) * 7 + i) % 32) if c != " " else c for i, c in enumerate(good))
    spark.createDataFrame([(i, "ru", good) for i in range(40)] + [(99, "ru", odd)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"]: r["kept"] for r in registry.op9_quality_classifier(spark, str(tmp_path)).collect()}
    assert all(kept[i] for i in range(40)) and not kept[99]


@pytest.mark.parametrize("dense", [knpoints.DENSE, 0])
def test_grams_are_numbered(texts, monkeypatch, dense):
    """By tables and by sorting: each place has its own gram, and no gram spans two texts."""
    monkeypatch.setattr(knpoints, "DENSE", dense)
    monkeypatch.setattr(knpoints, "SLICE", 1000)
    every = [t or "" for _, t in texts] + ["日本語" * 9, "\U0010ffff😀" * 5, "\x00" * 7]
    number, grams, places = knpoints.distinct(every)
    held = ["".join(map(chr, g)) for g in grams.T]
    assert held == sorted(set(held)) and len(places) == len(every)
    for t, at in zip(every, places, strict=True):
        assert [held[i] for i in number[at]] == [t[i : i + ORDER] for i in range(len(t) - ORDER + 1)]
    for short in ([], [""], ["abcd", "efg"]):
        number, grams, places = knpoints.distinct(short)
        assert not len(number) and grams.shape == (ORDER, 0) and len(places) == len(short)


def test_shards_hold_every_gram_once():
    grams = np.random.default_rng(2).integers(0, [[300], [0x110000], [9], [40], [0x110000]], (ORDER, 5000))
    order, shards = knpoints.dealt(grams, 3)
    assert sorted(order) == list(range(5000)) and [j for _, _, j in shards] == [i for _, i, _ in shards[1:]] + [5000]
    where = {}
    for shard, i, j in shards:
        part = grams[:, order[i:j]]
        assert (knpoints.unpack(knpoints.pack(part), ORDER, j - i) == part).all()
        for c, d in part[2:4].T.tolist():
            assert where.setdefault((c, d), shard) == shard < 3 * knpoints.BUCKETS


def test_tables_stay_small_beside_the_texts(spark, tmp_path, monkeypatch):
    """The grams sent and kept don't outgrow the texts: scratch tables at their peak, against the texts' bytes."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = [(i, rng.choice(["en", "fr", "de"]), " ".join(rng.choices(vocabulary, k=600))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    used = lambda: sum(p.stat().st_size for p in shared.rglob("*.parquet"))
    before, seen = used(), []
    keep = common.Scratch.keep
    monkeypatch.setattr(common.Scratch, "keep", lambda *a, **b: (keep(*a, **b), seen.append(used() - before))[0])
    assert registry.op9_quality_classifier(spark, str(tmp_path)).count() == 400
    size = sum(len(t) for _, _, t in rows)
    assert 0 < max(seen) < size, (max(seen), size)
