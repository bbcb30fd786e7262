"""From texts to scores to labels."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefsignals import fixed_values as fv
from reliefsignals.functions.labels import name_of
from reliefsignals.functions.text import clean_text, info_signal

# A model turns texts into a (texts x labels) array of logits.
Model = Callable[[Sequence[str]], np.ndarray]


def sigmoid(x: Column) -> Column:
    """Logistic function that cannot overflow, as double."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + small)).otherwise(small / (F.lit(1.0) + small))


def length_batches() -> Callable[..., Iterator[np.ndarray]]:
    """The function that cuts texts into batches; a nested one, so that it reaches workers by value."""

    def batches(sizes: np.ndarray, batch_size: int, batch_cells: int | None = None) -> Iterator[np.ndarray]:
        """Positions of texts in batches of texts of like length, shortest first.

        A model pads the texts of a batch to the longest. A batch has at most ``batch_size`` texts
        and, if given, ``batch_cells`` characters with its padding, but never less than one text.
        """
        order = np.argsort(sizes, kind="stable")
        start = 0
        while start < len(order):
            end = min(start + batch_size, len(order))
            if batch_cells is not None:
                padded = sizes[order[start:end]].astype(np.int64) * np.arange(1, end - start + 1)
                end = start + max(1, int(np.searchsorted(padded, batch_cells, side="right")))
            yield order[start:end]
            start = end

    return batches


def score_batch(
    df: DataFrame,
    load_model: Callable[[], Model],
    labels: Sequence[str],
    *,
    text_column: str = "tweet",
    clean: bool = True,
    batch_size: int = 256,
    batch_cells: int | None = None,
) -> DataFrame:
    """Add ``scored_text`` and one ``prob_<label>`` column per label.

    Only the text travels to Python, whole and in Arrow batches; all other columns stay on
    the JVM.  The model is loaded once per worker process and serves all its tasks.  A model
    that reads a limited window cuts or splits texts itself: that choice is its loader's.

    The model sees texts of like length together (``length_batches``), at most ``batch_size`` at once
    and, with ``batch_cells``, fewer where they are long; rows keep their order.
    """
    names = [f"l{i}" for i in range(len(labels))]
    token, cut = uuid.uuid4().hex, length_batches()

    @F.pandas_udf(", ".join(f"{n} float" for n in names))
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # Worker processes are reused between tasks, and keep what hangs on a module.
        loaded = vars(sys).setdefault("_scoring_models", {})
        if token not in loaded:
            loaded[token] = load_model()
        for texts in batches:
            found = np.zeros((len(texts), len(names)), np.float32)
            for at in cut(texts.str.len().to_numpy(np.int64), batch_size, batch_cells):
                part = np.asarray(loaded[token](texts.iloc[at].tolist()), dtype=np.float32)
                if part.ndim != 2 or part.shape[1] != len(names):
                    raise ValueError(f"the model must return {len(names)} logits per text")
                found[at] = part
            yield pd.DataFrame(found, columns=names)

    text = clean_text(F.col(text_column)) if clean else F.coalesce(F.col(text_column), F.lit(""))
    scored = df.withColumn("scored_text", text).withColumn("_logits", logits("scored_text"))
    probs = {
        f"prob_{x}": sigmoid(F.col("_logits")[n].cast("double")).cast("float").cast("double")
        for n, x in zip(names, labels)
    }
    return scored.withColumns(probs).drop("_logits")


def linear_scorer(df: DataFrame, weights: Mapping[str, Sequence[float]], vector_column: str = "embedding") -> DataFrame:
    """Add ``logit_<label>`` and ``prob_<label>``: a linear model on a vector column, no Python."""

    def dot(w: Sequence[float]) -> Column:
        fixed = F.array(*[F.lit(float(v)) for v in w])
        products = F.zip_with(F.col(vector_column), fixed, lambda a, b: a.cast("double") * b)
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    scored = df.withColumns({f"logit_{x}": dot(w) for x, w in weights.items()})
    return scored.withColumns({f"prob_{x}": sigmoid(F.col(f"logit_{x}")) for x in weights})


def _reaches(prob: Column, threshold: float) -> Column:
    # Scores and thresholds are compared in single precision, as the classifier does.
    return F.coalesce(prob.cast("float") >= F.lit(threshold).cast("float"), F.lit(False))


def apply_thresholds(df: DataFrame, thresholds: Mapping[str, float] = fv.THRESHOLDS) -> DataFrame:
    """Add ``pred_<label>`` and ``predicted``, the labels whose score reaches its threshold.

    Labels and thresholds must be the same set: a label that has a score but no threshold,
    or a threshold without a score, raises.
    """
    scored = {c.removeprefix("prob_") for c in df.columns if c.startswith("prob_")}
    if scored != set(thresholds):
        raise ValueError(
            f"labels without a threshold: {sorted(scored - set(thresholds))};"
            f" thresholds without a score: {sorted(set(thresholds) - scored)}"
        )
    hits = {x: _reaches(F.col(f"prob_{x}"), t) for x, t in thresholds.items()}
    flagged = df.withColumns({f"pred_{x}": h.cast("int") for x, h in hits.items()})
    names = [F.when(F.col(f"pred_{x}") == 1, F.lit(x)) for x in thresholds]
    return flagged.withColumn("predicted", F.array_compact(F.array(*names)))


def score_postprocess(df: DataFrame, text_column: str = "scored_text", *, compose: bool = False) -> DataFrame:
    """Append the information label last where score and text suggest it.

    The text of ``score_batch`` is composed already; for raw text set ``compose``.
    """
    label = fv.INFO_LABEL
    add = (
        ~F.array_contains("predicted", label)
        & (F.coalesce(F.col(f"prob_{label}"), F.lit(0.0)) >= fv.INFO_MIN_PROB)
        & info_signal(F.col(text_column), compose=compose)
    )
    return df.withColumn(
        "predicted", F.when(add, F.array_append("predicted", F.lit(label))).otherwise(F.col("predicted"))
    )


def score_detail(df: DataFrame, thresholds: Mapping[str, float] = fv.THRESHOLDS, id_column: str = "id") -> DataFrame:
    """One row per message and label, best score first: ``position`` numbers them.

    Each message's few scores are sorted inside its own row; nothing is shuffled.
    """
    entries = [
        F.struct(
            (-F.coalesce(F.col(f"prob_{x}"), F.lit(-1.0))).alias("order"),
            F.lit(i).alias("tie"),
            F.lit(x).alias("label"),
            F.lit(name_of(x)).alias("label_name"),
            F.col(f"prob_{x}").alias("prob"),
            F.lit(float(t)).alias("threshold"),
            _reaches(F.col(f"prob_{x}"), t).alias("predicted"),
        )
        for i, (x, t) in enumerate(thresholds.items())
    ]
    rows = df.select(F.col(id_column).alias("id"), F.posexplode(F.array_sort(F.array(*entries))))
    fields = ("label", "label_name", "prob", "threshold", "predicted")
    return rows.select("id", (F.col("pos") + 1).alias("position"), *[f"col.{c}" for c in fields])
