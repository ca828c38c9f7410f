import hashlib
import zlib

import duckdb
import pytest

from evidencelake.llm import merkle, registry

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, tampered=False):
    out = ""
    for i, v in enumerate(row):
        v = None if v is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in v) if tampered and i == 4 else str(v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return sha(out)


def tree(digests, fan):
    """The root, and for each digest the (left, right) siblings of each level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(at):
            base = p - p % fan
            paths[i].append(("".join(level[base:p]), "".join(level[p + 1 : base + fan])))
            at[i] = p // fan
        level = [sha("".join(level[b : b + fan])) for b in range(0, len(level), fan)]
    return level[0], paths


def brute(rows, fan):
    """rows: (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    trees = [tree([leaf(r) for r in g], fan) for g in groups]
    root, tops = tree([t[0] for t in trees], fan)
    out = []
    for g, (subroot, paths), top in zip(groups, trees, tops, strict=True):
        for r, path in zip(g, paths, strict=True):
            whole = path + top
            own = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in whole:
                own = sha(left + own + right)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in whole)), own, own == root))
    return sorted(out, key=repr)


def found(df, fan):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.manifest(df, fan).collect()), key=repr)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, index string, tree string"


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_equals_brute_force(spark, fan):
    rows = [(i, "hot" if i % 3 else f"s{i % 11}", "en", i, f"Text {i} É") for i in range(150)]
    rows += [(None, "hot", None, None, None), (7, "hot", "en", 7, "again"), (8, None, "", 0, ""), (8, None, "", 0, ""), (9, "", "x", -1, "A" * 200_000), (-5, "zz", "Ü", 1, "Z"), (10, "one", "a", 1, "B")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], COLUMNS)
    assert found(df, fan) == brute(rows, fan)


def test_small_tables(spark):
    make = lambda rows: spark.createDataFrame([(*r, None, None) for r in rows], COLUMNS)
    assert merkle.manifest(make([])).collect() == []
    for rows in ([(1, None, None, None, None)], [(10, "a", "b", 1, "T"), (10, "a", "b", 1, "T")], [(10, "a", "b", 1, "T"), (11, None, "b", 1, "T")]):
        assert found(make(rows), 16) == brute(rows, 16)
    changed = {r["doc_id"]: r["verified"] for r in merkle.manifest(make([(i, "a", "b", 1, "T") for i in range(40)])).collect()}
    assert all(changed[i] == (zlib.crc32(str(i).encode()) % 5 != 0) for i in range(40))


def test_query_equals_brute_force_and_sql(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    mine = registry.op13_merkle_manifest(spark, SF)
    assert sorted(map(tuple, mine.collect()), key=repr) == brute([tuple(r) for r in rows], 16)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(c.execute(f"select {', '.join(mine.columns)} from ({registry.ORACLES['op13_merkle_manifest']})").fetchall(), key=repr) == brute([tuple(r) for r in rows], 16)
