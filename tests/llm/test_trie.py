import hashlib
import random
import zlib

import duckdb
import pytest

from evidencelake.llm import registry, trie

SF = "/root/testdata/sf0.001"
COLUMNS = "conv_id long, turn long, role string, text string, id string, depth string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    said = lambda r: hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    whole = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, said(r))):
        whole.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members, made = {}, {}
    for c, turns in whole.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = whole.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(made[c]) + 1):
            members.setdefault(tuple(made[c][:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    totals = {}
    for key in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in children.get(key, [])]
        saved = (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        totals[key] = sum(x[0] for x in below) if below else 1, saved + sum(x[1] for x in below)
    out = []
    for key, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(made[c]) == len(key))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children.get(key, [])), *totals[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in NAMES) for r in trie.prefix_trie(df).collect()), key=repr)


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_equals_brute_force(spark, partitions):
    rng = random.Random(7)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", None, ""]), rng.choice([None, "", "a", "bé"])) for c in [*range(-6, 40), None] for _ in range(rng.randint(1, 10))]
    rows += [(c, i, "user", "same") for c in range(100, 130) for i in range(12)] + [(55, 1, "user", "twice")] * 3 + [(c, 0, "user", "x") for c in (200, 204)]
    rows += [(c, i, "user", f"{i}" + "long " * (20_000 if i == 40 else 1)) for c in (300, 310) for i in range(90 if c == 300 else 70)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    mine = found(spark.createDataFrame([(*r, "clash", "clash") for r in rows], COLUMNS))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert mine == brute(rows)


def test_small_tables(spark):
    make = lambda rows: spark.createDataFrame([(*r, None, None) for r in rows], COLUMNS)
    assert found(make([])) == [] and found(make([(None, 1, "user", "x")])) == []
    turnless = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    assert found(make([(turnless, 0, "user", "x")])) == brute([(turnless, 0, "user", "x")]) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_query_equals_brute_force_and_sql(spark):
    want = brute([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    assert sorted((tuple(r[c] for c in NAMES) for r in registry.op11_prefix_trie(spark, SF).collect()), key=repr) == want
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    assert sorted(c.execute(f"select {', '.join(NAMES)} from ({registry.ORACLES['op11_prefix_trie']})").fetchall(), key=repr) == want
