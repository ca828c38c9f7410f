import hashlib
import tracemalloc
from itertools import combinations

import numpy as np

from evidencelake.llm import nearjoin, suffixdup


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(sets, 2):
            if sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def test_near_groups_equal_brute_force(docs, texts, empty):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_groups(docs).collect()}
    assert found == brute_components(texts)
    assert nearjoin.near_groups(empty).count() == 0


def test_crowd_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in range(1 + i % 7):
            own[(i * 13 + k * 29) % 200] = f"own{i}-{k}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_groups(docs).collect()} == brute_components(rows)


def test_one_of_each_keeps_columns(docs, texts):
    want = brute_components(texts)
    kept = nearjoin.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def brute_removed(texts):
    seen, out = set(), {}
    for i, t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        own = [data[p : p + 50] for p in range(len(data) - 49)]
        for p, x in enumerate(own):
            if x in seen:
                gone[p : p + 50] = b"\1" * 50
        seen.update(own)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(docs, texts, empty):
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdup.remove_repeats(docs.repartition(3)).collect()}
    assert found == brute_removed(texts)
    assert suffixdup.remove_repeats(empty).count() == 0
    cut = suffixdup.without_repeats(docs)
    assert cut.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut.collect())


def test_a_batch_is_held_once():
    """Gathering frees what it has copied, and what leaves a task is copied in small batches."""
    n, columns = 200_000, 9
    tracemalloc.start()
    parts = [tuple(np.full(n // 10, i, np.int64) for i in range(columns)) for _ in range(10)]
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    kept = suffixdup._gathered(parts)
    assert tracemalloc.get_traced_memory()[1] < 1.3 * size and not parts
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    batches = list(suffixdup._both(kept, [c[:5] for c in kept[:4]], list("abcdefghi")))
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 0.1 * size and sum(b.num_rows for b in batches) == n + 5 and batches[-1].column("i").null_count == 5


def test_same_or_null_ids_remove_nothing(spark):
    text = "one passage that is rather longer than fifty bytes, to be sure of it"
    docs = spark.createDataFrame([(1, text), (1, "more " + text), (None, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in suffixdup.remove_repeats(docs).collect()] == [0, 0, 0]


def test_prefixes_meet_under_each_order():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * 0.95)), replace=False), rng.integers(0, 1 << 62, 1).astype(np.uint64)]))
        true = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert nearjoin.links(a, b) == true


def test_parities_differ_in_no_more_places_than_tokens():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(0, 2000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, 20).astype(np.uint64)]))
        differing = sum(int(x).bit_count() for x in (nearjoin.parities(a) ^ nearjoin.parities(b)).view(np.uint64))
        assert differing <= len(np.setxor1d(a, b))
    assert not nearjoin.parities(np.zeros(0, np.uint64)).any()
