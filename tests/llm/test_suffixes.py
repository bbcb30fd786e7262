import hashlib
import random

from reliefsignals.llm import suffixes


def brute(rows):
    data = {i: (t or "").encode() for i, t in rows}
    least = {}
    for i in sorted(data):
        for p in range(len(data[i]) - 49):
            least.setdefault(data[i][p : p + 50], i)
    out = set()
    for i, d in data.items():
        gone = [False] * len(d)
        for p in range(len(d) - 49):
            if least[d[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.add((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: "".join(word() for _ in range(n))
    passages = [prose(n)[:k] for n, k in ((30, 50), (30, 51), (40, 79), (60, 200), (30, 49))]
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 300, "x" * 120, "ab" * 60, "ab" * 70]
    for _ in range(60):
        parts = [prose(rng.randint(1, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng.randint(0, 12))]
        texts.append("".join(parts))
    texts += [texts[20]] * 4 + [texts[21][:-5] + "q" + texts[21][-5:], texts[22][3:], "é" * 40]
    rng.shuffle(texts)
    return [(2 * i, t) for i, t in enumerate(texts)]


def test_removed_bytes_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, starts int").repartition(4)
        assert {tuple(r) for r in suffixes.digests(spark, docs).collect()} == brute(rows)


def test_cover_is_a_difference_cover():
    differences = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert differences == set(range(suffixes.PERIOD))


def test_empty_table_and_null_id(spark):
    docs = spark.createDataFrame([(None, "y" * 60), (1, "y" * 60)], "doc_id long, text string")
    assert suffixes.digests(spark, docs.limit(0)).count() == 0
    assert {(r.doc_id, r.n_removed) for r in suffixes.digests(spark, docs).collect()} == {(None, 0), (1, 60)}
