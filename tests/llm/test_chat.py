import dataclasses
import hashlib
import os
import random
import re

import duckdb

from evidencelake.llm import chat, registry

SF = "/root/testdata/sf0.001"
HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "[", "<s", "[INST", "]", "", " ", "a\n\nb ", "[/ROLE] [TEXT] ", "ü𝄞日", "[[INST]]<</s>>", "\\[OUT] </s>\\"]
COLUMNS = "conv_id long, turn long, role string, text string, piece string"


def brute(turns, template=chat.INSTRUCTIONS):
    """From the whole input: n_turns, turns digest, characters and digest under the mask; from the whole output: its length."""
    said = "".join(t for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(template.render(turns))


def results(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in df.collect()}


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice([*chat.CONTROLS, *HARD, "x"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    for text in texts:
        plain = chat.escaped(text)
        assert chat.unescaped(plain) == text and not any(c in plain for c in chat.CONTROLS)
    turns = [(rng.choice(["user", "assistant", "system", "", "tool", *HARD]), t) for t in texts]
    assert list(chat.parsed(chat.instructions(turns))) == turns


def test_equals_whole_rendering(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", None, "", "tool", "[INST]"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice([None, *HARD, "plain words"])) for c in [*range(25), None] for _ in range(rng.randint(1, 12))]
    rows += [(3, 1, "user", "twice")] * 2 + [(99, i, "assistant", "long " * 40_000) for i in range(4)] + [(98, i, ["user", "assistant"][i % 2], f"{i} x") for i in range(500)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS)
    c = duckdb.connect()
    c.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    expected = c.execute(f"select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from ({registry.ORACLES['op12_chat_formatting']}) where conv_id is null or conv_id >= 0").fetchall()
    whole = {}
    for c, t, role, text in rows:
        whole.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    want = {c: brute([x[2:] for x in sorted(turns)]) for c, turns in whole.items()}
    pieces = chat.render_turns(df)
    assert results(chat.read_back(pieces)) == want == {r[0]: r[1:] for r in expected}
    assert {r["conv_id"]: r["n_rewrites"] for r in chat.rewrites(pieces).collect()} == dict.fromkeys(want, 0)
    # with whole prefixes instead of the template's memory, the same pieces
    whole_prefixes = chat.Template(chat.instructions, chat.parsed, chat.unescaped)
    few = df.where("conv_id < 10 or conv_id is null")
    assert sorted(map(repr, chat.render_turns(few, whole_prefixes).collect())) == sorted(map(repr, chat.render_turns(few).collect()))
    outputs = {c: chat.instructions([x[2:] for x in sorted(turns)]) for c, turns in whole.items()}
    for r in chat.spans(pieces).where("loss").collect():
        assert chat.unescaped(outputs[r["conv_id"]][r["start"] : r["end"]]) in {x[3] for x in whole[r["conv_id"]] if x[2] == "assistant"}
    assert chat.read_back(chat.render_turns(df.limit(0))).count() == 0


def test_rewritten_history_is_found(spark):
    def forgetful(turns):
        """Drops earlier answers' thoughts, and greets the last speaker."""
        last = len(turns) - 1
        return "".join(f"({r}) {t if i == last else re.sub('<think>.*?</think>', '', t)};" for i, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "<think>x</think>a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "plain"), (2, 2, "user", "r")]
    template = chat.Template(forgetful, lambda s: iter(()), str)
    pieces = chat.render_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    assert {r["conv_id"]: (r["n_rewrites"], r["first_rewrite"]) for r in chat.rewrites(pieces).collect()} == {1: (1, 2), 2: (0, None)}
    output, at = "", {(r["conv_id"], r["place"]): r for r in chat.spans(pieces).collect()}
    for r in pieces.where("conv_id = 1").orderBy("place").collect():
        output = output[: r["kept"]] + r["piece"]
    assert output == forgetful([(r[2], r[3]) for r in rows if r[0] == 1])
    assert at[1, 1]["start"] is None and output[at[1, 3]["start"] : at[1, 3]["end"]] == "b" and output[at[1, 0]["start"] : at[1, 0]["end"]] == "q"


def test_history_far_back_is_compared(spark):
    """The template of the query renders whole prefixes, so that a change of the first turn at the fifth is seen."""
    late = lambda turns: chat.instructions([(r, t.upper() if i == 0 and len(turns) > 4 else t) for i, (r, t) in enumerate(turns)])
    rows = [(c, i, ["user", "assistant"][i % 2], f"turn {i}") for c, n in ((1, 7), (2, 4)) for i in range(n)]
    pieces = chat.render_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), dataclasses.replace(chat.INSTRUCTIONS, render=late))
    assert {r["conv_id"]: (r["n_rewrites"], r["first_rewrite"]) for r in chat.rewrites(pieces).collect()} == {1: (1, 4), 2: (0, None)}
    for a, b in (("", ""), ("a", ""), ("abc", "abd"), ("abc", "abcd"), ("x", "y"), ("aaaa", "aa")):
        assert chat.shared(a, b) == chat.shared(b, a) == len(os.path.commonprefix((a, b)))


def test_query_equals_brute_force(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = results(registry.op12_chat_formatting(spark, SF))
    assert found == {c: brute(t) for c, t in turns.items()} and found[-1][0] == 2 and found[-1][2] == 21
