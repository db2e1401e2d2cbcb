"""Best-fit packing of tokenised documents into sequences, by linear grouping.

A piece's length is one of the at most `size` integers 1..size, so the whole corpus is described by a
histogram of that many counts. The plan is made on the driver from this histogram alone, and it is a
list of runs (of one length, ranks a..b go to sequences s..s+b-a at one offset) whose number depends
on `size` and `groups`, never on the corpus. Spark then numbers the pieces of each length and looks
each piece up in the runs.

1. Large lengths are split into groups of equal cardinality, each rounded up to its largest length.
2. The cutting-stock programme over the few rounded sizes is solved by column generation (knapsack
   pricing), which gives configurations and how often to use each.
3. Actual pieces, longest first within their group, replace the rounded ones; the true gaps return.
4. What the rounded-down solution left over, and then the small lengths, go by best fit, longest first.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, read, staged

SIZE, EOS = 1024, 2
#: Pieces of one length are numbered in so many independent shares.
SHARES = 256


_encoders: dict = {}


def _tokenizer(name: str):
    """`tokenizers` with the vocabulary `name` of public_tokenizers."""
    if name not in _encoders:
        import public_tokenizers as public
        from tokenizers import Tokenizer

        _encoders[name] = Tokenizer.from_file(public.path(name))
    return _encoders[name]


def _encoder(name: str):
    """`tiktoken` with the same vocabulary and special tokens: the same ids in a quarter of the time."""
    key = ("fast", name)
    if key not in _encoders:
        import public_tokenizers as public
        import tiktoken

        with open(public.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: k for k, t in _tokenizer(name).get_added_tokens_decoder().items()}
        _encoders[key] = tiktoken.Encoding("corpus", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[key]


#: A run of blanks of this length is beyond the depth of tiktoken's pattern matcher, by far.
BLANKS = re.compile(r"\s{20000}")


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """Ids of the text as `tokenizers` gives them, with special tokens where their strings stand, and the end mark."""
    if BLANKS.search(text):
        ids = _tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    else:
        ids = _encoder(vocabulary).encode(text, allowed_special="all")
    return np.array([*ids, EOS], "<u4")


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each document; null texts are empty
    ones. Only documents of over `size` ids are cut; the first piece takes what `size` doesn't divide."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = token_ids(text if isinstance(text, str) else "", vocabulary)
                first = (len(ids) - 1) % size + 1
                ends = range(first, len(ids) + 1, size)
                for k, end in enumerate(ends):
                    start = 0 if k == 0 else end - size
                    rows.append((doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": batch["doc_id"].dtype})

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if kind in ("bigint", "int"):  # nullable integers would arrive as floats
        named, kind = named.withColumn("doc_id", F.col("doc_id").cast("string")), "string"
        out = named.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")
        return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    return named.mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _configurations(sizes: list[int], counts: list[int], size: int, rounds: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over the sizes (how many of each) and how often to use each: the cutting-stock
    programme by column generation, rounded down."""
    n = len(sizes)
    s, need = np.array(sizes), np.array(counts, float)
    basis = np.diag([size // x for x in sizes]).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use, price = inverse @ need, inverse.sum(0)  # price: each size's worth, in sequences
        best, last = np.zeros(size + 1), np.full(size + 1, -1)
        for room in range(1, size + 1):
            fits = s <= room
            best[room], last[room] = best[room - 1], -2
            if fits.any():
                worth = best[room - s[fits]] + price[fits]
                k = int(worth.argmax())
                if worth[k] > best[room] + 1e-12:
                    best[room], last[room] = worth[k], int(np.flatnonzero(fits)[k])
        if best[size] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), size
        while room > 0 and last[room] != -1:
            if last[room] == -2:
                room -= 1
            else:
                column[last[room]] += 1
                room -= s[last[room]]
        way = inverse @ column
        ratio = np.where(way > 1e-9, use / np.where(way > 1e-9, way, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = column
    use = np.floor(np.linalg.solve(basis, need) + 1e-6).astype(int)
    return [(basis[:, j].astype(int), int(use[j])) for j in range(n) if use[j] > 0]


def plan(histogram: dict[int, int], size: int = SIZE, groups: int = 96, large: float = 1 / 8, rounds: int = 400) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, offset) that place every piece of the
    histogram {length: pieces}; sequences are numbered from 0."""
    left = {k: v for k, v in histogram.items() if v > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    made = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    # full pieces fill a sequence each
    if left.get(size):
        made = left[size]
        put(size, made, 0, 0)
    big = [x for x in sorted(left, reverse=True) if left[x] and size > x > size * large]
    total = sum(left[x] for x in big)
    members: list[list[int]] = []
    count = 0
    for x in big:  # equal cardinality: a new group with every total / groups pieces
        if not members or count * groups >= total:
            members.append([])
            count = 0
        members[-1].append(x)
        count += left[x]
    if members:
        patterns = _configurations([m[0] for m in members], [sum(left[x] for x in m) for m in members], size, rounds)
        for pattern, times in sorted(patterns, key=lambda p: -p[1]):
            slots = [g for g, many in enumerate(pattern) for _ in range(many)]
            while times > 0:  # as many sequences at once as have the same actual lengths in all slots
                taken: dict[int, int] = {}
                chosen = []
                for k, g in enumerate(slots):
                    # the last slot takes the longest actual piece that still fits, of whatever group
                    open_to = members[g] if k + 1 < len(slots) else [x for x in big if x <= size - sum(chosen)]
                    x = next((x for x in open_to if left[x] > taken.get(x, 0)), None)
                    if x is not None:
                        chosen.append(x)
                        taken[x] = taken.get(x, 0) + 1
                if not chosen:
                    break
                n = min(times, *(left[x] // many for x, many in taken.items()))
                at = 0
                for x in chosen:
                    put(x, n, made, at)
                    at += x
                if at < size:
                    gaps.setdefault(size - at, []).append((made, n))
                made += n
                times -= n
    for x in sorted(left, reverse=True):  # what is over and the small ones, by best fit
        while left[x]:
            room = min((r for r in gaps if r >= x), default=None)
            if room is None:
                per = size // x
                n = max(1, left[x] // per) if left[x] >= per else 1
                fill = min(per, left[x])
                for k in range(fill):
                    put(x, n, made, k * x)
                if size - fill * x:
                    gaps.setdefault(size - fill * x, []).append((made, n))
                made += n
                continue
            first, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            take = min(n, left[x])
            put(x, take, first, size - room)
            if room > x:
                gaps.setdefault(room - x, []).append((first, take))
            if n > take:
                gaps.setdefault(room, []).append((first + take, n - take))
    return runs


#: (groups, smallest length that counts as large, as a share of the size).
SETTINGS = ((48, 1 / 4), (96, 1 / 4), (96, 3 / 8), (192, 1 / 2))


def best_plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """The plan of the fewest sequences among SETTINGS; ties go to the first."""
    plans = [plan(histogram, size, groups, large) for groups, large in SETTINGS]
    return min(plans, key=lambda runs: max((first + n for _, _, n, first, _ in runs), default=0))


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty documents of one id; a very long text is cut like any other, its ids held at once;
    other columns are ignored; repeated rows and null ids are packed as any other; an
    empty table gives none. Sequences are gapless from 0 and hold at most `size` ids.
    """
    cut = staged(pieces(docs, size, vocabulary), "pieces").withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SHARES)).cast("int"))
    counts = cut.groupBy("length", "share").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `size` rows
    runs = sorted(best_plan(histogram, size))
    spark = docs.sparkSession
    # a length's shares follow each other: at most size x SHARES rows
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("share")) - F.col("count"))
    own = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(own) - 1).join(before.select("length", "share", "before"), ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, _, sequence, offset = table.value.T
        keys = length * (1 << 48) + first
        for batch in batches:
            at = np.searchsorted(keys, batch["length"].to_numpy() * (1 << 48) + batch["rank"].to_numpy(), "right") - 1
            yield pd.DataFrame({"row": batch["row"], "sequence_id": sequence[at] + batch["rank"].to_numpy() - first[at], "offset": offset[at]})

    row = F.struct("doc_id", "piece", "start", "length", "ids_crc32").alias("row")
    row_type = ranked.select(row).schema["row"].dataType.simpleString()
    placed = ranked.select(row, "length", "rank").mapInArrow(_arrow(place), f"row {row_type}, sequence_id long, offset long")
    return placed.select("row.*", "sequence_id", "offset")


def _arrow(place):
    """mapInArrow over `place`, the row's struct passed on untouched."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = next(place(iter([pd.DataFrame({"row": range(batch.num_rows), "length": batch["length"].to_numpy(), "rank": batch["rank"].to_numpy()})])))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(seen["sequence_id"]), pa.array(seen["offset"])], ["row", "sequence_id", "offset"])

    return run


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
