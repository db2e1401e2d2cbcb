"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade > k) = 1 / (1 + exp(-(w . x - threshold_k))), the weights w shared by all thresholds, which are
kept in order. x holds the words of a text and their beginnings (each once) among those that the
labelled sample ties to toxic texts. The score is the expected severity, the sum of P(grade > k) over k.

The labels have two flags, toxic and quality; grades come from both: 0 for clean, 1 for toxic texts of good
quality, 2 for toxic ones of bad quality (those of unknown quality count as good).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read, staged
from .words import FOLD

#: Labelled documents in the training sample at most, in expectation.
SAMPLE, GRADES = 20_000, 3
#: Toxic texts of the sample that a word must occur in, as a share (rarer ones tie to single authors), and
#: standard deviations above chance. All such words are features.
SUPPORT, ABOVE = 0.02, 5


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; null has none."""
    return text.lower().encode("utf-8", "replace").translate(FOLD).split() if isinstance(text, str) else []


def features_of(distinct: set[bytes]) -> set[bytes]:
    """The words and their beginnings of 4, 5 and 6 bytes, which stand for inflected forms."""
    out = set(distinct)
    for n in (4, 5, 6):
        out |= {b"^" + w[:n] for w in distinct if len(w) >= n}
    return out


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, grade) of about `sample` labelled documents at most, chosen by a hash of the id. Only the
    sampled labels and ids, whose number is bounded, are broadcast; of texts only hashes are shuffled. Repeated
    labels of a document count once, with the worst flags; labels without id or toxic flag don't count. A text
    that many documents copy counts once, with the worst grade."""
    quality = F.col("quality") if "quality" in labels.columns else F.lit(None).cast("int")
    grade = F.when(F.col("toxic") > 0, F.when(quality == 0, 2).otherwise(1)).otherwise(0)
    flags = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(grade).alias("grade_"))
    share = min(1.0, sample / max(1, flags.count()))
    chosen = flags.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    rows = docs.select("doc_id", "text").where("text is not null")
    keys = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade_", F.xxhash64("text").alias("key"))
    keys = keys.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("grade_").alias("grade"))
    found = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(keys), ["doc_id", "key"])
    return staged(found.dropDuplicates(["doc_id", "key"]).select("text", "grade"), "labelled")


def fit(x: list[np.ndarray], grade: np.ndarray, width: int, grades: int, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds in ascending order) by gradient ascent (Adam) on the likelihood of the
    grades. x: each row's feature numbers. A threshold is the one before plus exp(gap)."""
    row = np.repeat(np.arange(len(x)), [len(r) for r in x])
    col = np.concatenate(x) if len(row) else np.zeros(0, int)
    theta = np.zeros(width + grades - 1)
    first = np.zeros_like(theta)
    second = np.zeros_like(theta)
    logistic = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    for t in range(1, steps + 1):
        w, gaps = theta[:width], np.exp(theta[width + 1 :])
        cut = np.concatenate(([-np.inf], theta[width] + np.concatenate(([0], np.cumsum(gaps))), [np.inf]))
        z = np.bincount(row, w[col], len(x))
        above, below = logistic(cut[grade + 1] - z), logistic(cut[grade] - z)
        slope_a, slope_b = above * (1 - above), below * (1 - below)
        p = np.maximum(above - below, 1e-9)
        by_z = -(slope_a - slope_b) / p
        by_cut = np.bincount(grade, slope_a / p, grades)[:-1] - np.bincount(grade, slope_b / p, grades)[1:]
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate((np.bincount(col, by_z[row], width), [tail[0]], tail[1:] * gaps)) / max(1, len(x))
        gradient[:width] -= decay * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return theta[:width], theta[width] + np.concatenate(([0], np.cumsum(np.exp(theta[width + 1 :]))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """{words: {word: number}, weights, thresholds}. Without labels of both kinds the model has no words
    and rates every text 0."""
    bounded_batches(docs.sparkSession)
    chosen = sample_of(docs, labels, sample)

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for text, grade in zip(batch["text"], batch["grade"], strict=True):
                for word in features_of(set(words(text))):
                    found.setdefault(word, [0, 0])[int(grade > 0)] += 1
            yield pd.DataFrame([(w, *n) for w, n in found.items()], columns=["word", "clean", "toxic"])

    totals = {r["t"]: r["n"] for r in chosen.groupBy((F.col("grade") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return {"words": {}, "weights": np.zeros(0), "thresholds": np.full(GRADES - 1, 30.0)}
    rate = F.lit(totals[True] / (totals[True] + totals[False]))
    counts = chosen.mapInPandas(distinct, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = F.col("clean") + F.col("toxic")
    z = (F.col("toxic") - n * rate) / F.sqrt(n * rate * (1 - rate))  # how far from what chance gives
    support = max(5, SUPPORT * totals[True])
    telling = counts.where((F.col("toxic") >= support) & (z >= ABOVE)).select("word").collect()  # words of the bounded sample
    number = {w: k for k, w in enumerate(sorted(bytes(r["word"]) for r in telling))}

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [sorted(number[w] for w in number.keys() & features_of(set(words(t)))) for t in batch["text"]], "grade": batch["grade"]})

    rows = chosen.mapInPandas(featured, "x array<int>, grade int").toPandas()  # the bounded sample
    weights, thresholds = fit([np.array(r, int) for r in rows["x"]], rows["grade"].to_numpy(), len(number), GRADES)
    return {"words": number, "weights": weights, "thresholds": thresholds}


def rate(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with severity (expected grade, 0 to 2), grade (the most probable one) and toxic (whether any
    grade over 0 is more probable than 0). Null and empty texts have severity 0 and aren't toxic;
    columns of docs named as a new one give way; all else, repeated rows and null ids too, passes through. A
    very long text counts by its distinct words."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int, toxic boolean")
    def score(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        number, weights, thresholds = model["words"], model["weights"], model["thresholds"]
        found = [[number[w] for w in features_of(set(words(t))) & number.keys()] for t in texts]
        z = np.array([weights[f].sum() if f else 0.0 for f in found])
        empty = np.array([not isinstance(t, str) or not t.strip() for t in texts], bool)
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - thresholds, -30, 30)))
        above[empty] = 0
        each = -np.diff(np.hstack((np.ones((len(z), 1)), above, np.zeros((len(z), 1)))), axis=1)
        return pd.DataFrame({"severity": above.sum(1), "grade": each.argmax(1).astype("int32"), "toxic": above[:, 0] > 0.5})

    kept = [c for c in docs.columns if c not in ("severity", "grade", "toxic")]
    return docs.select(*kept, score(text).alias("rated_")).select(*kept, "rated_.*")


def op9_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, severity, grade, toxic."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return rate(docs, train(docs, read(spark, sf_dir, "labels"))).select("doc_id", "severity", "grade", "toxic")
