"""The manifest against a plain recursive tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from reliefsignals.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + merkle.FAN]) for i in range(0, len(out[-1]), merkle.FAN)])
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        first = at - at % merkle.FAN
        run = level[first : first + merkle.FAN]
        yield run[: at - first], run[at - first + 1 :]
        at //= merkle.FAN


def expected(rows):
    order = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (mine, levels([leaf(r) for r in mine]))
    top = levels([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        mine, tree = trees[s]
        for i, r in enumerate(mine):
            path = [*siblings(tree, i), *siblings(top, k)]
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in path for x in (*left, *right)])
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def documents(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for s, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Plain É text", "lower", "A" * 40, "Ü|:-"])
            rows.append((rng.choice([None, *range(50 * n)]) if rng.random() < 0.1 else rng.randrange(10 * n + 1), s, rng.choice([None, "en"]), rng.choice([None, 5]), text))
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {"a": 2},
        {None: 1, "b": 1},
        {"only": 17},
        {"only": 300},
        {"a": 16, "é": 17, "z": 256, "": 1, None: 257, "Z": 1},
        {f"s{i}": 1 + i % 3 for i in range(40)},
        {"hot": 4200, "b": 1, "c": 33},
    ],
    ids=str,
)
def test_digests_equal_plain_trees(spark, sizes):
    rows = documents(sizes)
    rows += rows[:3]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string")
    found = merkle.digests(spark, frame.repartition(5))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.select(names).collect()), key=str) == expected(rows)


def test_proofs_fold_to_the_root_and_others_do_not(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.proofs(spark, frame)
    checked = found.select(
        (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("own"),
        (merkle.fold(F.reverse("leaf"), F.col("proof")) == F.col("root")).alias("other"),
    )
    assert checked.groupBy("own", "other").count().collect() == [(True, False, 700)]


def test_a_change_moves_only_its_own_group(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(60)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    before = {r.doc_id: r for r in merkle.proofs(spark, spark.createDataFrame(rows, schema)).collect()}
    rows[4] = (*rows[4][:4], "changed")
    after = {r.doc_id: r for r in merkle.proofs(spark, spark.createDataFrame(rows, schema)).collect()}
    assert {i % 3 for i in before if before[i].subroot != after[i].subroot} == {1}
    assert {i for i in before if before[i].leaf != after[i].leaf} == {4} and before[0].root != after[0].root
