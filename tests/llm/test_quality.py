import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import backoff, knclassify, registry, rules, toxicity


def brute_measures(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_ledger_and_policies(docs, texts, empty):
    entries = rules.ledger(docs)
    judged = {r["doc_id"]: r for r in rules.judge(entries).collect()}
    for i, text in texts:
        r, want = judged[i], brute_measures(text)
        assert tuple(r[m] for m in rules.MEASURES[:5]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    effects = {r["rule"]: r for r in rules.ablation(entries).collect()}
    n = sum(1 for r in judged.values() if r["failed"] & rules.BIT["too_short"])
    assert effects["too_short"]["n_failed"] == n
    kept = rules.passing(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in judged.items() if r["kept"])
    assert rules.ledger(empty).count() == 0 and rules.ablation(rules.ledger(empty)).first()["n_docs"] == 0


def test_backoff_equals_sql(spark, docs, empty):
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    want = sorted(map(repr, c.execute(f"select doc_id, n_grams, score from ({registry.ORACLES['op4_lm_scoring']})").fetchall()))
    assert sorted(repr((r["doc_id"], r["n_grams"], r["score"])) for r in backoff.score(docs).collect()) == want
    assert backoff.score(empty).count() == 0


def brute_word_scores(texts):
    """Stupid backoff over words by dictionaries, document by document."""
    split = {i: (t or "").encode().split() for i, t in texts}
    n = Counter(tuple(w[k : k + size]) for w in split.values() for size in (1, 2, 3) for k in range(len(w) - size + 1))
    everything = sum(map(len, split.values()))

    def one(a, b, c):
        if n[a, b, c] >= backoff.MIN_COUNT:
            return n[a, b, c] / n[a, b]
        if n[b, c] >= backoff.MIN_COUNT:
            return 0.4 * n[b, c] / n[b,]
        return 0.4 * 0.4 * n[c,] / everything

    logs = {i: [math.log(one(*g)) for g in zip(w, w[1:], w[2:], strict=False)] for i, w in split.items()}
    return {i: (len(x), sum(x) / len(x) if x else None) for i, x in logs.items()}


def test_word_backoff_equals_brute_force(spark, texts, docs, empty):
    found = {r["doc_id"]: (r["n_grams"], r["score"]) for r in backoff.score_words(docs).collect()}
    want = brute_word_scores(texts)
    assert found.keys() == want.keys()
    for i, (n, s) in want.items():
        assert found[i][0] == n and (found[i][1] is None if s is None else math.isclose(found[i][1], s, abs_tol=2e-6))
    assert backoff.score_words(empty).count() == 0


def test_word_backoff_sees_word_order(spark):
    fluent = "the old mill stands by the quiet river and its wheel still turns when the snow melts in spring"
    rows = [(i, fluent) for i in range(10)] + [(99, " ".join(sorted(fluent.split())))]
    found = {r["doc_id"]: r["score"] for r in backoff.score_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] > found[99] + 2


def test_kneser_ney_sums_to_one():
    counts = np.random.default_rng(1).poisson(0.05, (64, 64, 64))
    assert np.allclose(np.exp(knclassify.kneser_ney(counts)).sum(-1), 1)


def brute_model(texts):
    """Interpolated modified Kneser-Ney over character classes by dictionaries: log p(c | ab) as a function."""
    n = Counter()
    for t in texts:
        c = [int(knclassify.CODES[min(ord(x), 256)]) for x in t or ""]
        n.update(zip(c, c[1:], c[2:], strict=False))
    after = Counter((b, c) for _, b, c in n)
    first = Counter((c,) for _, c in after)

    def level(counts, lower):
        kinds = Counter(counts.values())
        y = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] else 0.5
        d1 = max(0.1, 1 - 2 * y * kinds[2] / kinds[1]) if kinds[1] else 0.5
        d2 = max(0.1, 2 - 3 * y * kinds[3] / kinds[2]) if kinds[2] else 0.7
        d3 = max(0.1, 3 - 4 * y * kinds[4] / kinds[3]) if kinds[3] else 0.9
        off = lambda k: 0.0 if k == 0 else min(d1, 0.95) if k == 1 else min(d2, 1.9) if k == 2 else min(d3, 2.9)
        total, left = Counter(), Counter()
        for gram, k in counts.items():
            total[gram[:-1]] += k
            left[gram[:-1]] += off(k)

        def p(gram):
            k, head = counts.get(gram, 0), gram[:-1]
            return (k - off(k) + left[head] * lower(gram[1:])) / total[head] if total[head] else lower(gram[1:])

        return p

    one = level(first, lambda _: 1 / knclassify.CLASSES)
    three = level(n, level(after, one))

    def log_prob(text):
        c = [int(knclassify.CODES[min(ord(x), 256)]) for x in text or ""]
        grams = list(zip(c, c[1:], c[2:], strict=False))
        return len(grams), sum(math.log(three(g)) for g in grams)

    return log_prob


def brute_classifier(rows, trusted):
    """(doc_id, lang, text) rows and trusted ids: doc_id to (perplexity, kept)."""
    good = [r for r in rows if r[0] in trusted]
    if not good:
        return {i: (None, True) for i, _, _ in rows}
    size = Counter(lang for _, lang, _ in good if lang is not None)
    models = {lang: brute_model([t for _, x, t in good if x == lang]) for lang, n in size.items() if n >= knclassify.MIN_DOCS} | {knclassify.OTHER: brute_model([t for _, _, t in good])}
    own = {i: lang if lang in models else knclassify.OTHER for i, lang, _ in rows}
    found = {i: models[own[i]](t) for i, _, t in rows}
    judged = [i for i, _, _ in good if found[i][0]]
    at = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values)) - 1)]
    loss = {i: -found[i][1] / found[i][0] for i in judged}
    middle = {lang: at([loss[i] for i in judged if own[i] == lang], 0.5) for lang in {own[i] for i in judged}}
    overall = at(loss.values(), 0.5)
    rate = {i: (knclassify.PRIOR * middle.get(own[i], overall) - lp) / (knclassify.PRIOR + n) for i, (n, lp) in found.items()}

    def bar(ids):
        low, high = (at([rate[i] for i in ids], q) for q in knclassify.QUANTILES)
        return high + knclassify.SLACK * max(high - low, knclassify.LEAST_SLACK)

    bars = {lang: bar([i for i in judged if own[i] == lang]) for lang in middle}
    return {i: (math.exp(-lp / n) if n else None, rate[i] <= bars.get(own[i], bar(judged))) for i, (n, lp) in found.items()}


def test_classifier_equals_brute_force(spark, docs, texts):
    """On nulls, empty and repeated texts, two scripts, a language without a model of its own and odd documents."""
    odd = [(500 + i, " ".join(f"xQ{i}z{k % 7}jK" for k in range(60)), "en") for i in range(4)]
    every = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(odd + [(600, "the an st", "fr")], "doc_id long, text string, lang string"))
    every = every.union(every.where("doc_id = 7"))  # a trusted row twice teaches twice
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in every.collect()]
    trusted = {i for i, _ in texts if i % 4}
    found = knclassify.classify(every, spark.createDataFrame([(i, 1) for i in trusted], "doc_id long, quality int")).collect()
    want = brute_classifier(rows, trusted)
    assert len(found) == len(rows)
    for r in found:
        perplexity, kept = want[r["doc_id"]]
        assert (r["perplexity"] is None) if perplexity is None else math.isclose(r["perplexity"], perplexity, rel_tol=1e-4), r
        assert r["kept"] == kept, r
    assert not any(want[i][1] for i, _, _ in odd) and want[600][1]


def test_classifier(spark, empty):
    good = [(i, "en", "the quiet river runs past the old mill and over the stones again " * 4) for i in range(40)]
    odd = [(100 + i, "en", "XQ%% ZZ## KJ&& 99$$ QX** WV|| " * 8) for i in range(5)] + [(200, "xx", "the old mill"), (201, None, None), (202, "en", "")]
    docs = spark.createDataFrame(good + odd, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(None, 1), (5, None), (999, 1)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in knclassify.classify(docs, labels).collect()}
    assert len(found) == len(good) + len(odd)
    assert all(found[i]["kept"] for i in range(40)) and not any(found[100 + i]["kept"] for i in range(5))
    assert found[201]["kept"] and found[202]["kept"] and found[200]["model_lang"] == knclassify.OTHER
    assert knclassify.passing(docs, labels).count() == len(good) + 3
    assert knclassify.classify(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert knclassify.classify(empty, labels).count() == 0


def distance(a, b):
    """Edits with swaps of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


@pytest.mark.parametrize("word", "idiot idoit idi0t idiott diot worthless wrothless worthles worthlezz idea wordless scum scun pathetically pathetic banana".split())
def test_automata_find_what_edit_distance_finds(word):
    lexicon = toxicity.Lexicon({"idiot": 3.0, "worthless": 3.0, "scum": 2.0, "pathetic*": 2.0})
    best = min(((distance(word, t), t) for t in ("idiot", "worthless", "scum") if distance(word, t) <= toxicity.edits(t)), default=None)
    if word.startswith("pathetic"):
        best = (0, "pathetic*")
    found = lexicon.match(word)
    assert (found and (found[0], lexicon.terms[found[1]])) == best


def brute_measurements(text, weights):
    """By edit distance to every term, places in quotation marks letter by letter, and every window of words."""
    low = text.lower()
    inside, k = [False] * len(low), 0
    while k < len(low):
        end = next((j for j in range(k + 1, len(low)) if low[j] in '"“”„«»\n'), None) if low[k] in '"“„«' else None
        if end is not None and low[end] in '"”“»':
            inside[k : end + 1] = [True] * (end + 1 - k)
            k = end
        k += 1
    found = [(m.start(), m[0]) for m in toxicity.WORD.finditer(low)]
    hits = []  # place, weight, kind, term
    for place, (start, word) in enumerate(found):
        near = [(distance(word, t), t) for t in weights if not t.endswith("*")]
        near = [(d, t) for d, t in near if d <= toxicity.edits(t)] + [(0, t) for t in weights if t.endswith("*") and word.startswith(t[:-1])]
        if near:
            d, term = min(near)
            kind = "cited" if inside[start] else "stems" if term.endswith("*") else "fuzzy" if d else "exact"
            hits.append((place, weights[term] * 0.5**d, kind, term))
    if not hits:
        return [0.0] * len(toxicity.MEASURED)
    total = lambda *kinds: sum(w for _, w, k, _ in hits if k in kinds)
    window = lambda *kinds: max(sum(w for p, w, k, _ in hits if k in kinds and s <= p < s + toxicity.WINDOW) for s in range(-toxicity.WINDOW, len(found)))
    bare = ("exact", "fuzzy", "stems")
    amounts = [total("exact"), total("fuzzy"), total("stems"), total("cited"), window(*bare), window("cited"), len({h[3] for h in hits}), 100 * total(*bare) / len(found)]
    return [math.log1p(x) for x in amounts] + [float(total("exact") > 0)]


def test_measurements_equal_brute_force():
    weights = {"idiot": 3.0, "worthless": 2.5, "scum": 2.0, "pathetic*": 1.5}
    lexicon, rng = toxicity.Lexicon(weights), random.Random(3)
    parts = ["idiot", "idoit", "scum", "worthles", "pathetically", "river", "mill", "stone", '"', '"', "“", "”", "\n", "and", "the", "was"]
    for length in [0, 1, 5, 20, 60, 200] * 20:
        text = " ".join(rng.choice(parts) for _ in range(length))
        assert np.allclose(toxicity.measurements(text, lexicon), brute_measurements(text, weights)), text


def test_quotation_counts_apart():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scum": 2.0})
    named = lambda text: dict(zip(toxicity.MEASURED, toxicity.measurements(text, lexicon), strict=True))
    bare, cited = named("idiot scum idiot scum"), named('he said "idiot scum idiot scum" and left')
    assert bare["bare_window"] == cited["cited_window"] > 0 and bare["cited_window"] == cited["bare_window"] == bare["cited"] == 0
    far = named("idiot " + "river " * 60 + '"scum"')  # the bare one comes first; only the quoted one is quoted
    assert math.isclose(math.expm1(far["exact"]), 3) and math.isclose(math.expm1(far["cited"]), 2)


def test_scores_are_the_fit_over_the_measurements(spark):
    """Null, empty, very long and repeated texts and extra columns, with a lexicon that was learned."""
    plain, rude = "the old mill stands by the river", "you worthless idiot by the river"
    rows = [(i, plain, "x") for i in range(300)] + [(1000 + i, f"{rude} {i}", "x") for i in range(100)]
    cases = [(2000, None, "x"), (2001, "", "x"), (2002, plain, "x"), (2003, rude, "x"), (2003, rude, "x"), (2004, f"{plain} " * 40_000, "x"), (None, rude, "x")]
    docs = spark.createDataFrame(rows + cases, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _, _ in rows] + [(None, 1), (3000, 1), (5, None)], "doc_id long, toxic int")
    found = [(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.score(docs, labels).collect()]
    assert len(found) == len(rows + cases)
    score = {i: s for i, s, _ in found}
    assert score[2000] == score[2001] == score[2002] == score[2004] == score[0] < 0.5 < score[2003] == score[None]
    assert [p for i, _, p in found if i == 2003] == [1, 1] and all(p == (s >= 0.5) for _, s, p in found)


def test_toxicity_on_held_out_rows(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = toxicity.score(docs, labels)
    held = found.where("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.9
    assert found.where("score is null or score < 0 or score > 1").isEmpty() and found.count() == docs.count()
    assert toxicity.score(docs, labels.limit(0)).where("predicted = 1").isEmpty()
    assert math.isclose(0.0, float(toxicity.score(empty, labels).count()))


def test_toxicity_prior_does_not_depend_on_the_cap(spark):
    plain, rude = "the old mill stands by the river", "you worthless idiot by the river"
    rows = [(i, plain, 0) for i in range(400)] + [(1000 + i, rude if i < 20 else plain, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole, capped = ({r["doc_id"]: r["score"] for r in toxicity.score(df.drop("toxic"), df.select("doc_id", "toxic"), max_rows=n).collect()} for n in (10_000, 30))
    assert whole[0] < 0.15 and abs(whole[0] - capped[0]) < 0.05
