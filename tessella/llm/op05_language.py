"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of other characters than letters becomes one blank; n-grams of 1 to
`max_n` characters fall into `buckets` hash buckets. Counts per language come from Spark aggregation
over a sample of labelled texts, and the log-probability matrix (buckets x languages) is broadcast in
shards of LANGUAGES columns, as many as there are languages. A batch's texts are one sparse matrix of counts
(text, bucket, count), which is multiplied with the log-probabilities shard by shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read, staged

#: Documents a language gives to the training sample at most, in expectation.
SAMPLE = 4000
#: Languages of a shard of the matrix: BUCKETS x 128 floats; more languages take more shards.
LANGUAGES = 128
BUCKETS, MAX_N, PIECE = 1 << 16, 4, 1 << 18
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """By code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None, buckets: int = BUCKETS, max_n: int = MAX_N) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's n-grams, a piece of the text at a time; the same for pieces of any length.
    A text without letters has none."""
    text = (text or "").lower()
    held, after = np.array([32], np.uint64), False  # the last characters so far, and whether the last was a letter
    any_ = told = False
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "replace"), "<u4")
        letters = _is_letter()[points]
        any_ |= bool(letters.any())
        kept = np.where(letters, points, 32).astype(np.uint64)[letters | np.concatenate(([after], letters[:-1]))]
        after = bool(letters[-1])
        if at + PIECE >= len(text) and after:
            kept = np.concatenate((kept, np.array([32], np.uint64)))
        if not any_:
            continue  # blanks ahead of the first letter, of which `held` has one
        own = np.concatenate((held, kept))
        key = np.zeros(len(own), np.uint64)
        for n in range(1, max_n + 1):
            if len(own) < n:
                break
            key = key[: len(own) - n + 1] * np.uint64(0x100000001B3) + own[n - 1 :]
            fresh = key[max(0, len(held) - n + 1) if told else 0 :]
            fresh = fresh * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            yield ((fresh * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % buckets
        told, held = True, own[max(0, len(own) - max_n + 1) :]


def train(labelled: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, max_n: int = MAX_N) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """(languages in order, shards of log-probabilities buckets x languages, log-priors) from (doc_id, text,
    lang). Priors count all labelled rows; n-grams come from about `sample` rows a language at most,
    chosen by a hash of the id. Rows of null text or lang don't count."""
    rows = labelled.select(F.col("doc_id").cast("string").alias("id"), "text", "lang").where("text is not null and lang is not null")
    totals = rows.groupBy("lang").count().collect()
    totals = sorted((r["lang"], r["count"]) for r in totals)
    langs = [lang for lang, _ in totals]
    if not langs:
        return [], [np.zeros((buckets, 0), np.float32)], np.zeros(0)
    share = labelled.sparkSession.createDataFrame([(lang, min(1.0, sample / n)) for lang, n in totals], "lang string, share double")
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    chosen = rows.join(F.broadcast(share), "lang").where(place < F.col("share"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if lang not in sums:
                    if len(sums) >= LANGUAGES:  # a task holds so many at a time
                        yield from told(sums)
                        sums = {}
                    sums[lang] = np.zeros(buckets, np.int64)
                for ids in grams(text, buckets, max_n):
                    sums[lang] += np.bincount(ids, minlength=buckets)
        yield from told(sums)

    def told(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, n in sums.items():
            found = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": found, "n": n[found]})

    counts = chosen.select("text", "lang").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    shards = [langs[k : k + LANGUAGES] for k in range(0, len(langs), LANGUAGES)]
    counts = staged(counts, "grams") if len(shards) > 1 else counts
    matrices = []
    for own in shards:
        matrix = np.full((buckets, len(own)), 0.5)
        got = (counts.where(F.col("lang").between(own[0], own[-1])) if len(shards) > 1 else counts).toPandas()  # at most buckets x LANGUAGES rows
        matrix[got["bucket"], got["lang"].map({x: k for k, x in enumerate(own)})] += got["n"]
        matrices.append(np.log(matrix / matrix.sum(0)).astype(np.float32))
    prior = np.array([n for _, n in totals], float)
    return langs, matrices, np.log(prior / prior.sum())


#: N-grams of a sparse matrix at most, but for one piece of a text.
ENTRIES = 1 << 20


def sparse(texts, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, bucket, count) of the texts' n-grams, in order of both, some ENTRIES n-grams at a time."""
    held, size = [], 0

    def summed():
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return key // buckets, key % buckets, n.astype(float)

    for k, text in enumerate(texts):
        for ids in grams(text, buckets) if isinstance(text, str) else ():
            held.append(ids + k * buckets)
            size += len(ids)
            if size >= ENTRIES:
                yield summed()
                held, size = [], 0
    if size:
        yield summed()


def predict(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the probability of that language. A null text, one without
    letters, and any text under a model of no languages give `und` and 0. Columns of docs named as the
    new ones give way; other columns, repeated rows and null ids pass through."""
    bounded_batches(docs.sparkSession)
    langs, matrices, prior = model
    buckets = len(matrices[0])
    shared = docs.sparkSession.sparkContext.broadcast((langs, prior))
    shards = [docs.sparkSession.sparkContext.broadcast(m) for m in matrices]

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        langs, prior = shared.value
        total = np.tile(prior.astype(float), (len(texts), 1))
        seen = np.zeros(len(texts))
        for row, bucket, n in sparse(texts, buckets):
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            seen[row[first]] += np.add.reduceat(n, first)
            sums = [np.add.reduceat(n[:, None] * m.value[bucket], first, axis=0) for m in shards]
            total[row[first]] += np.concatenate(sums, axis=1)
        if not langs:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0})
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1)[:, None]).sum(1)
        return pd.DataFrame({"lang_pred": np.where(seen > 0, np.array(langs, object)[best], UNKNOWN), "score": np.where(seen > 0, score, 0.0)})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, score(text).alias("predicted_")).select(*kept, "predicted_.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learnt from documents that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train(docs.where(~held))
    out = predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
