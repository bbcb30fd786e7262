"""The audit against applying the filters one by one."""

import random
import re
from itertools import permutations

import numpy as np

from reliefsignals.llm import audit


def failures(row, firsts):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = set()
    if len(words) < 200:
        found.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        found.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        found.add("C")
    if set(text) & set("#$%&*|"):
        found.add("D")
    if row[0] is not None and firsts.get(text) is not None and row[0] > firsts[text]:
        found.add("E")
    return found


def expected(rows, good, toxic):
    firsts = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    checked = [(r[0], r[2] or "", failures(r, firsts)) for r in rows]
    out = []
    for part in {p for _, p, _ in checked}:
        mine, found, total = [c for c in checked if c[1] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            kept = mine
            for step, x in enumerate(order, 1):
                gone, before = [c for c in kept if x in c[2]], kept
                kept = [c for c in kept if x not in c[2]]
                total[x] += len(gone)
                redundant = sum(x in c[2] for c in mine) - sum(x in c[2] for c in before)
                only = sum(c[2] == {x} for c in mine)
                lost = [sum(c[0] in ids for c in gone) for ids in (good, toxic)]
                found.append([part, "".join(order), step, len(kept), len(gone), redundant, only, *lost, x])
        out += [(*f[:-1], total[f[-1]]) for f in found]
    return sorted(out)


def table(seed=3):
    rng, rows = random.Random(seed), []
    for i in range(300):
        words = [rng.choice(["alpha", "beta"]) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 199, 200, 260]))]
        text = rng.choice([" ", "\t\n", "\x0b"]).join(words)
        text = rng.choice([text, text, text.upper(), text + " 100%", "É" * 10 + text, " " + text + " "])
        rows.append((i, text, rng.choice(["hot", "hot", "b", "", None])))
    rows += [(1000 + k, rows[5][1], rng.choice(["hot", "b", None])) for k in range(90)]
    rows += [(None, rows[5][1], "hot"), (None, None, None), (2000, None, "b"), (2001, "", "b"), (2001, "", "b"), (2000, None, "hot")]
    rows += [(3000, "x " * 50_000, "long"), (3000, "x " * 50_000, "long")]
    rng.shuffle(rows)
    return rows


def test_audit_equals_applying_filters(spark):
    rows = table()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mask int").repartition(4)
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 1100, 2)] + [(2001, 1, 1), (2001, 1, None), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = sorted(map(tuple, audit.audit(frame, marks).collect()))
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    want = expected(rows, good, toxic)
    assert len(found) == 600 * 4 and found == want
    assert any(r[7] for r in found) and any(r[8] for r in found)


def test_gray_code_walk_equals_counting():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, (32, 3))
    states = audit.survivors(counts)
    for subset in range(32):
        assert (states[subset] == counts[[m for m in range(32) if not m & subset]].sum(axis=0)).all()


def test_no_plan_step_sees_rows_after_the_cells(spark):
    """Only cells reach Python: one exchange by part and mask before it."""
    frame = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    plan = audit.audit(frame, marks)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInPandas") < plan.index("hashpartitioning(part") < plan.index("hashpartitioning(digest")
