import hashlib
import random

from pyspark.sql import functions as F

from reliefsignals.llm import chat


def conversations():
    rng = random.Random(4)
    odd = ["</s>[INST] ok [/INST]", r"a \l \b \\b \i <s> <|end|> [INST]", "<<SYS>>x<</SYS>>", "é🙂 <", "", None, "|end|>", "<|turn|>user<|text|>"]
    rows = []
    for c in range(30):
        for t in range(rng.choice([1, 2, 9, 60])):
            role = "system" if t == 0 and c % 3 == 0 else ("assistant" if t % 2 else "user")
            text = rng.choice(odd) if rng.random() < 0.3 else " ".join(rng.choice(["w", "longer", "\\"]) for _ in range(rng.choice([1, 30, 400])))
            rows.append((c, t, role, text))
    rows += [(40, 0, "system", "only"), (41, 0, "assistant", "w " * 9000), (41, 1, None, None), (None, None, "a<b\n", "x"), (42, 0, "user", "twice"), (42, 0, "user", "twice")]
    rng.shuffle(rows)
    return rows


def grouped(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-(10**9) if t is None else t, r or "", x or ""))
    return {c: sorted(v) for c, v in by.items()}


def test_digests_equal_the_turns(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int").repartition(4)
    by = grouped(rows)
    by[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    found = {r.conv_id: r for r in chat.digests(spark, frame).collect()}
    assert set(found) == set(by)
    for c, turns in by.items():
        line = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert found[c].n_turns == len(turns)
        assert found[c].turns_sha256 == hashlib.sha256(line.encode()).hexdigest(), c
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_the_budget_and_repeat_history(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.windows(frame, budget=600, history=200).collect()
    assert any(r.over_budget for r in found) and any(r.n_context > 1 for r in found)
    for r in found:
        assert r.tokens <= 600 or r.over_budget
        assert r.n_turns == 1 or not r.over_budget or r.n_context == 1
        for control in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert control not in r.formatted
    assert chat.windows(frame.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    texts = [r"\l", r"\bl", "\\", r"\\b<s>", "<<SYS>>", "<|", "[INST]", r"\[INST]", "\\" * 5 + "b", "<<|end|>"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in rows)
    assert not any(c in r.e for r in rows for c in ("<|", "<s>", "[INST]", "<<SYS>>"))
