import re

from reliefsignals.llm import decontaminate


def sets(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, items):
    """Shingles of five words; items with fewer are looked for as runs of their own length."""
    out = []
    for i, t in docs:
        words = re.findall(r"[^\W_]+", (t or "").lower())
        runs = {n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} for n in range(1, 6)}
        for k, u in items:
            s = sets(u)
            shared = sum(x in runs[len(x)] for x in s)
            if s and shared >= 0.75 * len(s):
                out.append((i, k, shared, len(s)))
    return out


def test_matches_equal_brute_force(spark):
    item = " ".join(f"q{i}" for i in range(60))
    most = " ".join(f"q{i}" for i in range(50))
    half = " ".join(f"q{i}" for i in range(30))
    items = [(1, item), (2, "two words"), (3, None), (4, ""), (5, item), (None, "a b c d e f g")]
    filler = " ".join(f"f{i}" for i in range(30_000))
    docs = [(1, filler + " " + item.upper() + ". " + filler), (2, "x " + most), (3, half), (4, "Two, words!"), (5, None), (6, ""), (7, "zz a b c d e f g"), (7, "zz a b c d e f g")]
    left = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    found = decontaminate.contamination(spark, left, right)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:4] for r in found.collect()), key=key) == sorted(expected, key=key)
    small = decontaminate.contamination(spark, left, right, block_items=2)
    assert sorted((tuple(r)[:4] for r in small.collect()), key=key) == sorted(expected, key=key)
    assert {r.doc_id for r in decontaminate.without_contaminated(spark, left, right).collect()} == {3, 5, 6}
    assert decontaminate.contamination(spark, left, right.limit(0)).count() == 0
    assert decontaminate.contamination(spark, left.limit(0), right).count() == 0


def test_short_items_inside_long_documents(spark):
    """Items of one to four words, and sizes around every partition's bounds, against brute force."""
    items = [(n, " ".join(f"w{n}x{j}" for j in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 19, 20, 35, 36, 67, 68, 69, 140)]
    items += [(200, "common"), (201, "common word"), (202, "Common, WORD again")]
    docs = [(0, "a common word again and again"), (1, "common"), (2, "word common"), (3, None), (4, "")]
    filler = " ".join(f"f{i}" for i in range(3000))
    for n, text in items[:-3]:
        words = text.split()
        shingles = max(1, n - 4)
        for lost in {0, shingles // 4, shingles // 4 + 1}:
            docs.append((1000 * n + lost, f"{filler} {' '.join(words[lost:])} {filler}"))
    left = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.contamination(spark, left, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r)[:4] for r in found.collect()) == sorted(brute(docs, items))
    assert {(0, 200), (0, 201), (0, 202), (1, 200), (2, 200)} <= {tuple(r)[:2] for r in found.collect()}


def test_many_short_items(spark):
    items = spark.range(100_000).selectExpr("id AS item_id", "concat_ws(' ', 'k', id, id % 7) AS text")
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some text k ', id * 250, ' ', id * 250 % 7, ' and more') AS text")
    rows = decontaminate.contamination(spark, docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(i, 250 * i) for i in range(400)]
