"""Near-duplicate documents by Order MinHash.

Every 5-word run of a text is labelled with its occurrence number. A sketch is made of the two
labelled runs that are smallest under one hash permutation, joined in the order in which they stand in
the text, so two texts agree on it only if they share the runs and their order. Texts that agree on a
sketch are candidates; their words are aligned. The alignment is the longest common subsequence of
words within a band, and the similarity (common words in order over all words, which minds edits,
not runs that an edit breaks) must reach 0.8. Texts of one length may differ in one word of nine.

A change of every tenth word leaves 0.42 of the runs in common; two texts then agree on one sketch
with probability 0.42^2, and on some of 24 with 0.99.

Exact copies fall into one class first and meet the join once. A bucket's members are held against a
few leaders, and only those that no leader connects against all others, in blocks that give out
links alone (common.bucket_links).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import bounded_batches, bucket_links, connected_components, outline, read, staged  # noqa: F401
from .words import labelled, mixed, shingles, word_hashes

WORDS, SIMILARITY, SKETCHES, MINIMA = 5, 0.8, 24, 2
#: Ids up to this number are broadcast to filter the texts (16 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def sketches(runs: np.ndarray, count: int = SKETCHES, minima: int = MINIMA) -> np.ndarray:
    """`count` sketches of a text's labelled runs; one number each. The first 8 bits tell which."""
    marks = mixed(np.arange(1, count + 1, dtype=np.uint64))
    n = min(minima, len(runs))
    at = np.empty((count, n), np.int64)
    step = max(1, (1 << 20) // len(runs))  # permutations at once: a long text goes one by one
    for k in range(0, count, step):
        order = (runs ^ marks[k : k + step, None]) * np.uint64(0x9E3779B97F4A7C15)
        order ^= order >> np.uint64(32)
        at[k : k + step] = np.argpartition(order, n - 1, axis=1)[:, :n]
    at.sort(axis=1)
    key = marks
    for j in range(n):
        key = mixed(key * np.uint64(0x100000001B3) + runs[at[:, j]])
    return (key & np.uint64(0x00FFFFFFFFFFFFFF)) | (np.arange(count, dtype=np.uint64) << np.uint64(56))


def _in_order(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Words that stand in both texts in one order, by the matches of labelled words within the band: fewer
    than the longest common subsequence where a word put in moves the labels of its kind."""
    _, i, j = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    targets = j[near][np.argsort(i[near])]
    if (np.diff(targets) > 0).all():
        return len(targets)
    tails: list[int] = []
    for x in targets.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def aligned(a: np.ndarray, b: np.ndarray, band: int, least: int) -> int:
    """Length of the longest common subsequence of a and b with no matched pair further than about `band` off the
    diagonal; -1 as soon as `least` can't be reached. Column sets are integers of one bit a word of a."""
    step = max(64, band)
    columns, rows = a.tolist(), b.tolist()
    open_ = (1 << len(columns)) - 1  # bits of a whose match doesn't lengthen the subsequence yet
    for top in range(0, len(rows), step):
        low, high = max(0, top - band), min(len(columns), top + step + band)
        if low >= high:
            break
        places: dict = {}
        for k in range(low, high):
            places[columns[k]] = places.get(columns[k], 0) | 1 << (k - low)
        mask = (1 << (high - low)) - 1
        v = was = open_ >> low & mask
        for w in rows[top : top + step]:
            u = v & places.get(w, 0)
            if u:
                v = (v + u | v - u) & mask
        open_ ^= (v ^ was) << low
        if len(columns) - open_.bit_count() + max(0, len(rows) - top - step) < least:
            return -1
    return len(columns) - open_.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Common words in order over all words, by alignment in the band that a similarity of `least` leaves room
    for; 0 where it can't be reached."""
    total = len(a) + len(b)
    need = int(np.ceil(least * total / (1 + least) - 1e-9))
    if not len(a) or not len(b) or min(len(a), len(b)) < need:
        return 0.0
    band = max(len(a), len(b)) - need
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[:short] != b[:short])
    head = int(unlike[0]) if len(unlike) else short
    unlike = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(unlike[0]) if len(unlike) else short - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    n = head + tail
    if len(a) and len(b):
        kinds, of = np.unique(np.concatenate((a, b)), return_inverse=True)
        most = np.minimum(np.bincount(of[: len(a)], minlength=len(kinds)), np.bincount(of[len(a) :], minlength=len(kinds))).sum()
        if n + most < need:  # words in common in any order
            return 0.0
        found = _in_order(a, b, band)
        n += found if n + found >= need else max(0, aligned(a, b, band, need - n))
    return n / (total - n) if n >= need else 0.0


#: Members of a bucket that all are held against first.
LEADERS = 2


def may_be_alike(one: np.ndarray, many: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Whether the words in common, which are no more than the counts in common, can reach a similarity of `least`."""
    return common.may_be_alike(one, many, least)


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    return labelled(shingles(words, k))


def signatures(docs: DataFrame, text: str = "text", words: int = WORDS, count: int = SKETCHES) -> DataFrame:
    """(doc_id, class, sketches): class is a digest of the text's words; null where there are none."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, sketch = [], []
            for t in batch["text"]:
                own = word_hashes(t.as_py() or "")
                digest.append(hashlib.md5(own.tobytes()).digest() if len(own) else None)
                sketch.append(sketches(_runs(own, words), count).view(np.int64) if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "class", "sketches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(sign, f"doc_id {kind}, class binary, sketches array<long>")


def words_of(docs: DataFrame, ids: DataFrame, text: str = "text") -> DataFrame:
    """(rep, runs): the word hashes of the texts with these ids; of repeated rows the least text's."""
    small = ids.count() <= BROADCAST_IDS
    named = docs.select(F.col("doc_id").alias("rep"), F.col(text).alias("text")).where("text is not null")
    chosen = named.join(F.broadcast(ids) if small else ids, "rep", "left_semi").groupBy("rep").agg(F.min("text").alias("text"))

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: word_hashes(t).tobytes())

    return chosen.select("rep", hashed("text").alias("runs"))


def near_duplicates(docs: DataFrame, text: str = "text", words: int = WORDS, least: float = SIMILARITY, count: int = SKETCHES) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of exactly equal word sequences), n_verified (other classes
    that this one was held against and found alike; not all that it is like), component_id (the smallest doc_id that links reach), kept (whether
    the document stands for its component).

    One row per row of docs. Texts without words (null, empty, blanks) and rows without id link with
    nothing: class and component are their own id, and they are kept. Rows of one id with different texts are held
    against others by the least of these texts and share what it links with. Other columns are ignored. A very long
    text is one row: its words take 8 bytes each.
    """
    bounded_batches(docs.sparkSession)
    signed = signatures(docs, text, words, count).withColumn("class", F.when(F.col("doc_id").isNotNull(), F.col("class")))
    signed = staged(signed, "signatures")
    usable = signed.where("class is not null")
    classes = usable.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("sketches").alias("sketches"))
    alike = lambda x, y: similarity(x, y, least) >= least
    links = bucket_links(staged(classes.select("rep", "sketches"), "classes"), lambda ids: words_of(docs, ids, text), alike, agree=1,
        leaders=LEADERS, least=least)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n"))
    component = connected_components(links)
    by_rep = degree.join(component.withColumnRenamed("node", "rep"), "rep")
    known = classes.select("class", "rep").join(by_rep, "rep", "left")
    return (
        signed.select("doc_id", "class").join(known, "class", "left")
        .select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_verified"),
                F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
