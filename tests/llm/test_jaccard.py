import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefsignals.llm import jaccard


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = [None, "", "  \t", "One two", "one TWO", "one two three", "É a b c d", "é a b c d"]
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 150]))]
        if rng.random() < 0.3:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            changed = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "  "]).join(changed))
    texts += [texts[10]] * 20
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("frequent", [3, 64])
def test_classes_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus(frequent, 70)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, node string, component int").repartition(5)
    found = {tuple(r) for r in jaccard.classes(spark, docs).collect()}
    assert found == brute(rows)


def test_near_pairs_of_sets_of_all_sizes():
    """Every pair that links is found, pairs of unrelated sets are not, whatever their size."""
    rng = np.random.default_rng(5)
    sets = []
    for n in [1, 3, 5, 40, 60, 64, 65, 90, 200, 255, 256, 300, 6000]:
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for share in (1.0, 0.96, 0.8):
            kept = base[: max(1, int(np.ceil(share * n)))]
            sets.append(np.unique(np.concatenate((kept, rng.integers(0, 2**63, n // 20).astype(np.uint64)))))
    sizes = np.array([len(s) for s in sets])
    vectors, groups = [jaccard.count_vector(s) for s in sets], np.arange(len(sets))
    found = {tuple(sorted(p)) for p in jaccard.near_pairs(vectors, sizes, groups)}
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            assert (i, j) in found
        elif not both and min(sizes[i], sizes[j]) >= 40:
            assert (i, j) not in found


def chained(seed, bases=12, steps=25):
    """Texts that walk away from their origin a few words at a time, and share passages with all others."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows, i = [], 0
    for b in range(bases):
        words = [f"b{b}w{rng.randrange(60)}" for _ in range(rng.choice([70, 90, 120]))]
        for _ in range(steps):
            rows.append((i, " ".join(words + passage)))
            i += 1
            words = list(words)
            words[rng.randrange(len(words))] = f"c{rng.randrange(9)}"
    return rows


def test_hot_blocks_are_dealt_out_and_lose_no_link(spark, monkeypatch):
    """Blocks of 300 nodes in parts of 20: same links, and each pair of parts in a place of its own."""
    monkeypatch.setattr(jaccard, "PART_NODES", 20)
    monkeypatch.setattr(jaccard, "TASK_ROWS", 50)
    rows = chained(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in jaccard.classes(spark, docs).collect()} == brute(rows)


def test_every_pair_of_a_dealt_block_shares_a_cell(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_NODES", 10)
    rng = random.Random(2)
    rows = [(1, node, rng.choice([3, 4, 50, 60, 66, 67, 80, 88, 89, 400]), 150) for node in range(150)]
    cells = {}
    for r in jaccard._dealt(spark.createDataFrame(rows, "key long, node long, n int, m long")).collect():
        cells.setdefault((r.key, r.lo, r.hi), set()).add(r.node)
    size = {node: n for _, node, n, _ in rows}
    for a, b in itertools.combinations(size, 2):
        if 100 * min(size[a], size[b]) >= 75 * max(size[a], size[b]):
            assert any({a, b} <= cell for cell in cells.values())
    assert max(map(len, cells.values())) <= 80


def test_overlapping_finds_every_pair_within_the_bound():
    rng = np.random.default_rng(3)
    counts = np.concatenate([rng.poisson(4, (120, 8)), np.repeat(rng.poisson(4, (3, 8)), 15, axis=0)])
    sizes, groups = counts.sum(axis=1), np.arange(len(counts)) // 3
    found = {tuple(sorted(p)) for p in jaccard.overlapping(counts, sizes, groups)}
    for i, j in itertools.combinations(range(len(counts)), 2):
        bound = np.minimum(counts[i], counts[j]).sum()
        near = 175 * bound >= 75 * (sizes[i] + sizes[j]) and 100 * min(sizes[i], sizes[j]) >= 75 * max(sizes[i], sizes[j])
        if near and groups[i] != groups[j]:
            assert (i, j) in found
    assert all(groups[i] != groups[j] for i, j in found)


def test_blocks_of_the_same_nodes_are_compared_once(spark, monkeypatch):
    """Texts that share a passage meet under each of its shingles; what is compared is one such block."""
    rng = random.Random(4)
    rows, lists = [], []
    for g in range(4):
        passage = [f"p{g}w{i}" for i in range(30)]
        for k in range(3):
            own = [f"g{g}k{k}w{i}" for i in range(12)]
            rows += [(len(rows) + j, " ".join(own[: 12 - j] + ["x"] * j + passage)) for j in range(2)]
    rng.shuffle(rows)
    compare = jaccard._surviving_pairs

    def noted(members, *rest):
        lists.extend(tuple(sorted(r.nodes)) for r in members.groupBy("key").agg(F.collect_list("node").alias("nodes")).collect())
        return compare(members, *rest)

    monkeypatch.setattr(jaccard, "_surviving_pairs", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard.classes(spark, docs).collect()} == brute(rows)
    assert lists and len(lists) == len(set(lists))


def test_sets_are_sent_only_for_pairs_that_can_link(spark, monkeypatch):
    """A short text inside a long one shares all its shingles with it, and is still too small for a link."""
    word = [f"w{i}" for i in range(200)]
    near = [*word[:90], "new", *word[91:]]
    rows = [(1, " ".join(word)), (2, " ".join(near)), (3, " ".join(word[:50])), (4, " ".join(word[100:140]))]
    sent, verify = [], jaccard._verified

    def noted(pairs, sets):
        size = {r.node: r.n for r in sets.collect()}
        sent.extend((size[r.a], size[r.b]) for r in pairs.collect())
        return verify(pairs, sets)

    monkeypatch.setattr(jaccard, "_verified", noted)
    found = {tuple(r) for r in jaccard.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows) and len({c for *_, c in found}) == 3
    assert sent and all(100 * min(x) >= 75 * max(x) for x in sent)


def test_representatives_keep_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text.replace("w50", "other")
    rows = [(5, text, "a"), (7, near, "b"), (9, text, "c"), (11, "else where", "d"), (12, None, "e"), (13, "", "f"), (None, "alone here", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    assert {r.part for r in jaccard.representatives(spark, docs).collect()} == {"a", "d", "e", "f", "g"}
    assert jaccard.representatives(spark, docs.limit(0)).count() == 0
