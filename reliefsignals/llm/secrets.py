"""Secret scan: candidates, and a random forest that removes false positives, with DataFrame functions only.

A candidate is a word (run of non-space characters) of at least ``SHORTEST`` characters that
has a digit, or a word of any length that a name such as ``password`` or ``token`` and ``=`` or
``:`` announce, in the same word or in the one or two words before it. Its features are its
length, transitions between character classes, dictionary coverage (share of its letters
that lie in corpus words), its path, the neighbouring words, and whether a name announces it. A random forest is trained on
labelled findings: rows of ``doc_id, place, label`` that join to candidates.

The given tables hold no reviewed findings. ``reviewed`` stands in for them: it labels those
candidates whose form alone decides (fixed patterns of public key formats and of personal data)
and leaves all others open, so also a weak password that a name announces; the forest never sees the patterns, and scores every candidate.

Training takes about ``MAX_FINDINGS`` labelled findings at most, by a hash of document and
place. The dictionary is the ``DICTIONARY`` most frequent words of at least three letters
over all documents; a top-k list, bounded by its parameter. Values are returned as SHA-256, never in clear.

Null and empty texts have no candidates. A null path has no path features. Repeated rows give
their findings once per row. Without findings of both labels the score is null and every
candidate is kept, so nothing is lost for want of training.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefsignals.llm.bounds import written

SHORTEST = 8
MAX_FINDINGS = 50_000
DICTIONARY = 5_000
TREES, DEPTH, SEED = 20, 6, 7
THRESHOLD = 0.5

# Names that announce a secret, paths that announce examples.
NAMES = r"(?i)(passw(or)?d|passwd|secret|token|api_?key|access_?key|credential|auth)"
EXAMPLES = r"(?i)(test|example|sample|doc|mock|fixture|demo)"
ASSIGNED = rf"{NAMES}\S*[=:]\S+"
CANDIDATE = rf"^(?=\S*[0-9])\S{{{SHORTEST},}}$|{ASSIGNED}"
# A name and its sign at the end of a word, a sign alone, a sign before a value.
NAMED = rf"{NAMES}\S*[=:]>?[\"'(\[{{<]*$"
SIGN = r"^[=:]+>?[\"'(\[{<]*$"
SIGNED = r"^[=:]+>?[^=:>]"
SIGNED_START = r"^[=:]+>?"

# Forms that decide by themselves.
TRUE_FORMS = r"^(AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|xox[bap]-[0-9A-Za-z-]{20,}|[0-9a-f]{40}|[0-9a-f]{18})$"
FALSE_FORMS = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$|^[0-9][0-9 .:/+-]*$|^https?://|^[A-Za-z]+[.,]?[0-9]{1,2}[.,]?$"

FEATURES = (
    "length", "runs", "runs_per_char", "digits", "uppers", "hexes", "vowel_runs", "distinct_chars", "marks", "coverage",
    "path_depth", "path_example", "before_names", "own_name", "assigned", "before_letters", "after_letters",
    "announced_value",
)


def _announced(word, i: Column) -> Column:
    """Whether a secret's name and ``=`` or ``:`` stand in the word ``i`` before its value, or in the words before it."""
    last = F.coalesce(word(i - 1), F.lit(""))
    apart = last.rlike(NAMED) | (last.rlike(SIGN) & F.coalesce(word(i - 2), F.lit("")).rlike(NAMES))
    after = ~word(i).rlike(SIGN)
    return word(i).rlike(ASSIGNED) | ((word(i) != "") & after & apart) | (word(i).rlike(SIGNED) & last.rlike(NAMES))


def candidates(documents: DataFrame, path: str = "source", key: str = "doc_id") -> DataFrame:
    """``doc_id, place, path, word, announced, value, before, after``; ``place`` is the word's number in the text."""
    words = documents.select(F.col(key).alias("doc_id"), F.col(path).cast("string").alias("path"), F.split("text", r"\s+").alias("w"))

    def word(i: Column) -> Column:
        return F.get("w", i)

    found = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).rlike(CANDIDATE) | _announced(word, i))
    near = F.transform(
        found,
        lambda i: F.struct(
            i.alias("place"),
            F.get("w", i).alias("word"),
            _announced(word, i).alias("announced"),
            F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)).alias("before"),
            F.coalesce(F.get("w", i + 1), F.lit("")).alias("after"),
        ),
    )
    rows = words.filter(F.size("w") > 0).select("doc_id", "path", F.inline(near))
    own = F.when(F.col("announced"), F.regexp_replace("word", SIGNED_START, "")).otherwise(F.col("word"))
    bare = F.regexp_replace(F.regexp_replace(own, r"^[A-Za-z_-]+[=:]", ""), r"^[\"'(<\[]+|[\"')>\],.;]+$", "")
    return rows.withColumn("value", bare)


def dictionary(documents: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """The most frequent words of the texts, as ``entry``."""
    words = documents.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("entry")).filter(F.length("entry") >= 3)
    return words.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entry").limit(size).select("entry")


def _count(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)).cast("double")


def features(found: DataFrame, entries: DataFrame) -> DataFrame:
    """The candidates with the columns ``FEATURES``."""
    runs = found.select("value").distinct().select("value", F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("entry")).filter("entry != ''")
    known = runs.join(F.broadcast(entries.withColumn("known", F.lit(1))), "entry", "left")
    cover = known.groupBy(F.col("value").alias("v")).agg((F.sum(F.when(F.col("known") == 1, F.length("entry")).otherwise(0)) / F.sum(F.length("entry"))).alias("cover"))
    n = F.greatest(F.length("value"), F.lit(1)).cast("double")
    rows = found.join(cover, found["value"] == cover["v"], "left").drop("v")
    return rows.select(
        *found.columns,
        F.length("value").cast("double").alias("length"),
        _count("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+").alias("runs"),
        (_count("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+") / n).alias("runs_per_char"),
        (_count("[0-9]") / n).alias("digits"),
        (_count("[A-Z]") / n).alias("uppers"),
        (_count("[0-9a-f]") / n).alias("hexes"),
        (_count("(?i)[aeiou]+") / n).alias("vowel_runs"),
        F.size(F.array_distinct(F.split("value", ""))).cast("double").alias("distinct_chars"),
        _count("[^a-zA-Z0-9]").alias("marks"),
        F.coalesce("cover", F.lit(0.0)).alias("coverage"),
        F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).cast("double").alias("path_depth"),
        F.coalesce(F.col("path").rlike(EXAMPLES), F.lit(False)).cast("double").alias("path_example"),
        F.col("before").rlike(NAMES).cast("double").alias("before_names"),
        F.col("word").rlike(NAMES + "[=:]").cast("double").alias("own_name"),
        F.col("word").rlike("[=:]").cast("double").alias("assigned"),
        F.regexp_count("before", F.lit("[A-Za-z]")).cast("double").alias("before_letters"),
        F.regexp_count("after", F.lit("[A-Za-z]")).cast("double").alias("after_letters"),
        F.col("announced").cast("double").alias("announced_value"),
    )


def reviewed(found: DataFrame) -> DataFrame:
    """Findings that their form decides: ``doc_id, place, label``; no form makes an announced value a false positive."""
    value = F.col("value")
    label = F.when(value.rlike(TRUE_FORMS), 1.0).when(~F.col("announced") & value.rlike(FALSE_FORMS), 0.0)
    return found.select("doc_id", "place", label.alias("label")).filter("label is not null")


def scan(documents: DataFrame, labelled: DataFrame | None = None, path: str = "source", limit: int = MAX_FINDINGS) -> DataFrame:
    """``doc_id, place, length, value_sha256, score, is_secret`` of every candidate."""
    spark = documents.sparkSession
    # Candidates are read twice below; they are few beside the texts they come from.
    found = written(spark, candidates(documents, path), "candidates")
    table = written(spark, features(found, dictionary(documents)), "findings")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    known = reviewed(table) if labelled is None else labelled.select("doc_id", "place", F.col("label").cast("double").alias("label"))
    n, kinds = known.agg(F.count("label"), F.count_distinct("label")).first()
    out = ["doc_id", "place", F.length("value").cast("int").alias("length"), F.sha2(F.encode("value", "UTF-8"), 256).alias("value_sha256")]
    if kinds < 2:
        return table.select(*out, F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_secret"))
    if n > limit:
        known = known.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id", "place"), F.lit(n)) < limit)
    examples = assembled.join(known.dropDuplicates(["doc_id", "place"]), ["doc_id", "place"]).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    scored = forest.fit(examples).transform(assembled)
    return scored.select(*out, vector_to_array("probability")[1].alias("score")).withColumn("is_secret", F.col("score") >= THRESHOLD)
