import hashlib
import random

from pyspark.sql import functions as F

from reliefsignals.llm import fingerprints


def test_neighbours_and_edits_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN_ROWS", 10)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)] + ["é", "ß🙂"]
    texts = [None, "", "one", "\t"] + [" ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 400, 3000]))) for _ in range(150)]
    rows = [(7 * i, t) for i, t in enumerate(texts)] + [(3_000, texts[20])]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, run string").repartition(5)
    found = {r.doc_id: r for r in fingerprints.fingerprints(spark, docs).collect()}
    assert len(found) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])

    def jaccard(a, b):
        def sets(t):
            w = t.lower().split()
            return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

        x, y = sets(a), sets(b)
        return len(x & y) / len(x | y) if x | y else None

    errors = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert found[i].n_chars == len(t)
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
        true = jaccard(t, edited)
        if true is not None:
            errors.append(abs(found[i].near_edited - true))
    assert sum(errors) / len(errors) < 0.05
    assert found[3_000].fingerprint == found[7 * 20].fingerprint
    same = {r.fingerprint for r in found.values() if r.n_chars == 0}
    assert same == {"0:"}


def test_sketches_merge_and_contain(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    short = " ".join(f"w{i}" for i in range(5_000, 5_600))
    row = spark.createDataFrame([(long, short)], "a string, b string")
    row = row.select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    row = row.select(
        fingerprints.containment(F.col("b"), F.col("a")).alias("inside"),
        fingerprints.containment(F.col("a"), F.col("b")).alias("other"),
        (fingerprints.merged(F.col("a"), F.col("b")) == F.col("a")).alias("absorbed"),
    ).first()
    assert row.inside == 1.0 and row.other < 0.1 and row.absorbed


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert fingerprints.fingerprints(spark, docs.limit(0)).count() == 0
    assert fingerprints.fingerprints(spark, docs).first().near_next == 1.0
    many = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], "doc_id long, text string")
    assert fingerprints.fingerprints(spark, many).count() == 4


def test_repeated_lines_keep_hashes_and_unknown_is_null(spark):
    rows = []
    for i in range(40):
        line = " ".join(f"r{i}x{j}" for j in range(36))
        rows.append((i, (line + "\n") * 68, " ".join(f"w{j}" for j in range(400 * i, 400 * i + 24))))
    long = " ".join(f"w{j}" for j in range(20_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string, short string")
    pairs = docs.select("doc_id", fingerprints.sketch(F.col("text")).alias("a"), fingerprints.sketch(F.col("short")).alias("short"), fingerprints.sketch(F.lit(long)).alias("long"))
    following = pairs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    found = pairs.join(following, "doc_id").select(
        F.size("a.hashes").alias("n"),
        fingerprints.likeness(F.col("a"), F.col("b")).alias("near"),
        fingerprints.likeness(F.col("a"), F.col("a")).alias("same"),
        fingerprints.containment(F.col("short"), F.col("long")).alias("inside"),
        fingerprints.containment(F.col("short"), fingerprints.sketch(F.lit(" "))).alias("in_nothing"),
    )
    found = found.collect()
    assert len(found) == 39
    assert all((r.n, r.near, r.same, r.in_nothing) == (36, 0.0, 1.0, 0.0) for r in found)
    assert {r.inside for r in found} == {None, 1.0}
