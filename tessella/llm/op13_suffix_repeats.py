"""Repeated substrings by difference covers: what is covered by a string of 400 bytes that starts elsewhere too.

Positions of a document are sampled where their offset modulo 183 lies in a difference cover of 14 residues, so
that of any two equal strings some sampled pair stands at one common place within 183 bytes. Then, as in the
difference-cover construction of suffix arrays, but bounded by the length that matters:

1. Sampled positions are named by their tuple of 218 bytes (sorted, equal tuples have equal names).
2. Names recurse: where tuples repeat, the triple of names here, one and two periods on names 584 bytes. A
   repeated triple proves every start within it; all but the first of its class are done with.
3. The remaining suffixes are merged: starts near a repeated tuple that no triple settles are named by their 400
   bytes, together with those of each class's first copy, and equal neighbours in the sorted order repeat.

Names are fingerprints (64 bits for tuples, which only select; 96 bits for what decides, from two polynomial
hashes), not ranks: an order of fingerprints puts equal prefixes side by side, which is all that is asked. Two
different strings among 10 ** 13 share one with a probability under 0.001. Texts lie in chunks of some 4 MB; a chunk
sends each name once to the name's range and gets bits back, so no name, however common, gathers its places.

A null text is empty. Each row is a document of its own, whatever its id; copies of a whole text of 400 bytes or more
lose all of it. Shorter texts are kept. A document of any length is one row of a chunk, held whole by one
task with some 20 bytes of working space for each byte that repeats. Names are sorted in parts, and chunks go through
row groups, pages and Arrow batches of a few each, so that a task's memory depends neither on how many chunks its split or partition
holds nor on how much of them repeats. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read, staged
from .words import _power, mixed

#: Bytes that must repeat.
LENGTH = 400
#: Period of the sample and its residues: every difference modulo 183 is one between two of them.
PERIOD = 183
COVER = (0, 12, 19, 20, 22, 43, 60, 71, 76, 85, 89, 115, 121, 168)
#: Bytes of a tuple; of three tuples a period apart, which overlap.
TUPLE = LENGTH - PERIOD + 1
TRIPLE = TUPLE + 2 * PERIOD
#: Bytes of a chunk's texts (a longer text is a chunk of its own), of a range of names, of a piece that is hashed at once.
CHUNK, RANGE, PIECE = 4 << 20, 16 << 20, 1 << 17
#: Names that are sorted at once, about; parts of a chunk's or a range's names at most.
SORTED, PARTS = 1 << 18, 16
#: Bytes of an Arrow batch: few chunks.
BATCH_BYTES = 8 << 20
#: Chunks of a row group, each a page of its own. Parquet else looks at sizes from the hundredth row on only.
FEW_ROWS = {"parquet.block.row.count.limit": "2", "parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}
#: Bytes of a name by round: tuples, triples of names, whole strings.
WIDTH = {"tuple": 8, "triple": 12, "string": 12}
_TABLES = mixed(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 256)


def hashes(data: np.ndarray, starts: np.ndarray, length: int, half: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the `length` bytes at each of the ascending starts, piece by piece; of the second the upper half alone, if so asked."""
    out = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint32 if half else np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + PIECE, PIECE, dtype=starts.dtype))
    for k in range(len(cuts) - 1):
        i, j = cuts[k], cuts[k + 1]
        if i == j:
            continue
        since = int(starts[i])
        part = data[since : int(starts[j - 1]) + length]
        at = starts[i:j] - since
        down = _power("down", len(part))[at]
        for h in range(2):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLES[h][part] * _power("up", len(part))[: len(part)], dtype=np.uint64)))
            name = mixed((sums[at + length] - sums[at]) * down)
            out[h][i:j] = name >> np.uint64(32) if half and h else name
    return out


def ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): the order of names and where in it each distinct one begins."""
    order = np.argsort(high)
    h, w = high[order], low[order]
    if ((h[1:] == h[:-1]) & (w[1:] != w[:-1])).any():  # equal halves may lie mixed
        order = np.lexsort((low, high))
        h, w = high[order], low[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return order, np.flatnonzero(fresh)


def inside(size: int, since: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Which of size places lie in some closed range since..to."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, since, 1)
    np.subtract.at(edge, to + 1, 1)
    return np.cumsum(edge, dtype=np.int32, out=edge)[:-1] > 0


def range_of(names: np.ndarray, ranges: int, first: int, last: int) -> np.ndarray:
    """Where each of the ranges first..last - 1 of so many begins among sorted names of theirs, the end of the last included."""
    edges = np.array([(k << 64) // ranges for k in range(first + 1, last)], np.uint64)
    return np.concatenate(([0], np.searchsorted(names, edges), [len(names)]))


def parts_of(names: np.ndarray, ranges: int):
    """(first, last, places) for stretches of ranges first..last - 1: where their names stand, ascending. There are as many stretches
    as keep them near SORTED names each, so that sorting one takes little space."""
    parts = max(1, min(PARTS, ranges, -(-len(names) // SORTED)))
    for p in range(parts):
        first, last = p * ranges // parts, (p + 1) * ranges // parts
        here = names >= np.uint64((first << 64) // ranges)
        if last < ranges:
            here &= names < np.uint64((last << 64) // ranges)
        yield first, last, np.flatnonzero(here)


class Chunk:
    """Texts side by side, and what is known of their positions after each round."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, ranges: int, told: dict):
        self.data, self.ends, self.ranges, self.told = data, ends, ranges, told
        self.begins = np.concatenate(([0], ends[:-1]))
        sizes = ends - self.begins
        longest = int(sizes.max()) if len(sizes) else 0
        grid = (np.arange(longest // PERIOD + 1)[:, None] * PERIOD + np.array(COVER)).ravel()
        count = np.searchsorted(grid, sizes - TUPLE, "right")
        own = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.samples = grid[own] + np.repeat(self.begins, count)
        self.begin_of, self.end_of = np.repeat(self.begins, count), np.repeat(ends, count)
        self.ahead = own + 2 * len(COVER) < np.repeat(count, count)
        self.tuples = hashes(data, self.samples, TUPLE)

    def _heard(self, kind: str, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(repeated, later): whether each name stands elsewhere too, and whether at an earlier place."""
        told = self.told.get(kind, {})
        repeated, later = np.empty(len(high), bool), np.empty(len(high), bool)
        for first, last, places in parts_of(high, self.ranges):
            names = high[places]
            order, begins = ranked(names, low[places])
            size = np.diff(np.append(begins, len(order)))
            bounds = range_of(names[order[begins]], self.ranges, first, last)
            across, earlier = np.zeros(len(begins), bool), np.zeros(len(begins), bool)
            for k in range(first, last):
                if k in told:
                    i, j = bounds[k - first], bounds[k - first + 1]
                    across[i:j], earlier[i:j] = np.unpackbits(np.frombuffer(told[k], np.uint8)).reshape(2, -1)[:, : j - i]
            found, after = np.empty(len(order), bool), np.ones(len(order), bool)
            found[order] = np.repeat(across | (size > 1), size)
            if len(begins):
                after[np.minimum.reduceat(order, begins)] = earlier
            repeated[places], later[places] = found, after & found
        return repeated, later

    def names(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The names that a round asks about, with what the rounds before have told."""
        high, low = self.tuples
        if kind == "tuple":
            return high, np.zeros(len(high), np.uint32)
        self.near, _ = self._heard("tuple", high, np.zeros(len(high), np.uint32))
        first = np.flatnonzero(self.ahead)
        first = first[self.near[first] & self.near[first + len(COVER)] & self.near[first + 2 * len(COVER)]]
        self.triples = self.samples[first]
        joined = []
        for name in (high, low):
            three = np.zeros(len(first), np.uint64)
            for step in range(3):
                three = mixed(three * np.uint64(0x9E3779B97F4A7C15) + name[first + step * len(COVER)])
            joined.append(three)
        triple = joined[0], (joined[1] >> np.uint64(32)).astype(np.uint32)
        if kind == "triple":
            return triple
        proven, later = self._heard("triple", *triple)
        size = len(self.data)
        spread = lambda which: inside(size, self.triples[which], self.triples[which] + TRIPLE - LENGTH)
        self.proven = spread(proven)
        close = np.flatnonzero(self.near)
        since, to = np.maximum(self.samples[close] - PERIOD + 1, self.begin_of[close]), np.minimum(self.samples[close], self.end_of[close] - LENGTH)
        there = since <= to
        self.open = np.flatnonzero(inside(size, since[there], to[there]) & ~spread(later)).astype(np.int32)  # a row of Arrow has under 2 GB
        return hashes(self.data, self.open, LENGTH, half=True)

    def sent(self, kind: str):
        """(range, names) for each range that has any: each distinct name once, in order."""
        high, low = self.names(kind)
        for first, last, places in parts_of(high, self.ranges):
            one, two = high[places], low[places]
            order, begins = ranked(one, two)
            one, two = one[order[begins]], two[order[begins]]
            bounds = range_of(one, self.ranges, first, last)
            for k in np.flatnonzero(np.diff(bounds)):
                cut = slice(bounds[k], bounds[k + 1])
                yield first + int(k), one[cut].tobytes() + (two[cut].tobytes() if WIDTH[kind] > 8 else b"")

    def covered(self) -> np.ndarray:
        """Which bytes some repeated string covers."""
        repeated, _ = self._heard("string", *self.names("string"))
        starts = self.proven
        starts[self.open[repeated]] = True
        total = np.cumsum(starts, dtype=np.int32)
        gone = total > 0
        gone[LENGTH:] = total[LENGTH:] > total[:-LENGTH]
        return gone


def decided(chunks: list[int], names: list[bytes], width: int) -> list[bytes]:
    """For each chunk's names of one range: a bit each whether another chunk has it, then whether an earlier one has."""
    count = np.array([len(x) // width for x in names])
    high = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(names, count, strict=True)])
    low = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(names, count, strict=True)]) if width > 8 else np.zeros(len(high), np.uint32)
    place = np.repeat(np.argsort(np.argsort(np.array(chunks))).astype(np.int32), count)
    across, earlier = np.empty(len(high), bool), np.empty(len(high), bool)
    least, most = (int(x) for x in (high.min(), high.max()))
    parts = max(1, min(PARTS, -(-len(high) // SORTED)))
    for p in range(parts):
        here = high >= np.uint64(least + p * (most + 1 - least) // parts)
        if p + 1 < parts:
            here &= high < np.uint64(least + (p + 1) * (most + 1 - least) // parts)
        places = np.flatnonzero(here)
        if not len(places):
            continue
        order, begins = ranked(high[places], low[places])
        size = np.diff(np.append(begins, len(order)))
        across[places[order]] = np.repeat(size > 1, size)
        order = places[order]
        earlier[order] = place[order] > np.repeat(np.minimum.reduceat(place[order], begins), size)
    ends = np.cumsum(count)
    return [np.concatenate((np.packbits(across[e - n : e]), np.packbits(earlier[e - n : e]))).tobytes() for e, n in zip(ends, count, strict=True)]


def gathered(sent):
    """Lists of (range, names), each of some CHUNK bytes of names at most."""
    out, size = [], 0
    for r, names in sent:
        if out and size + len(names) > CHUNK:
            yield out
            out, size = [], 0
        out.append((r, names))
        size += len(names)
    if out:
        yield out


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, ids, ends, data), staged: texts as UTF-8 side by side, in chunks that stay as they are."""
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches):
        from pyspark import TaskContext

        at, k, id_type = TaskContext.get().partitionId() << 32, 0, None
        ids, texts, size = [], [], 0

        def row():
            ends = np.cumsum([len(t) for t in texts])
            return pa.RecordBatch.from_arrays(
                [pa.array([at + k], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([ends], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())], ["chunk", "ids", "ends", "data"])

        for batch in batches:
            id_type = batch["id"].type
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                if texts and size + len(text or b"") > CHUNK:
                    yield row()
                    k, ids, texts, size = k + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text or b"")
                size += len(texts[-1])
        if texts:
            yield row()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(pack, f"chunk long, ids array<{kind}>, ends array<long>, data binary"), "chunks", "zstd", FEW_ROWS)


def _opened(batch: pa.RecordBatch, ranges: int):
    """(row, Chunk) for each row of a batch of chunks, with what they were told."""
    for k in range(batch.num_rows):
        told: dict = {}
        if "told" in batch.schema.names:
            for t in batch["told"][k].as_py() or ():
                told.setdefault(t["round"], {})[t["range"]] = t["bits"]
        yield k, Chunk(np.frombuffer(batch["data"][k].as_buffer(), np.uint8), np.array(batch["ends"][k].values, np.int64), ranges, told)


def _answer(kind: str):
    width = WIDTH[kind]

    def answer(group: pa.Table) -> pa.Table:
        bits = decided(group["chunk"].to_pylist(), [x.as_buffer() for x in group["names"]], width)
        return pa.table({"chunk": group["chunk"], "round": pa.array([kind] * len(bits)), "range": group["range"], "bits": pa.array(bits, pa.binary())})

    return answer


def _told(chunks: DataFrame, replies: DataFrame | None) -> DataFrame:
    """Chunks with the replies to them; a reply is a bit or two for a name."""
    if replies is None:
        return chunks
    told = replies.groupBy("chunk").agg(F.collect_list(F.struct("round", "range", "bits")).alias("told"))
    return chunks.join(told.hint("shuffle_hash"), "chunk", "left")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans array<struct<start, end>>, kept binary), a row for each of docs: the maximal runs of removed bytes and
    the bytes that are left (which need not be UTF-8, where a removed run ends within a character)."""
    chunks = chunked(docs, id_col, text_col)
    total = chunks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    ranges = max(1, -(-3 * total // RANGE))
    replies: DataFrame | None = None
    for kind in WIDTH:

        def ask(batches, kind=kind):
            for batch in batches:
                for k, chunk in _opened(batch, ranges):
                    for out in gathered(chunk.sent(kind)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([batch["chunk"][k].as_py()] * len(out), pa.int64()), pa.array([r for r, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["chunk", "range", "names"])
                    del chunk  # before the next one is made

        asked = _told(chunks, replies).mapInArrow(ask, "chunk long, range int, names binary")
        told = staged(asked.groupBy("range").applyInArrow(_answer(kind), "chunk long, round string, range int, bits binary"), "told")
        replies = told if replies is None else replies.union(told)

    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for k, chunk in _opened(batch, ranges):
                gone = chunk.covered()
                rows: list[tuple] = []
                for doc_id, begin, end in zip(batch["ids"][k].values.to_pylist(), chunk.begins.tolist(), chunk.ends.tolist(), strict=True):
                    mask = gone[begin:end]
                    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
                    spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
                    rows.append((doc_id, end - begin, spans, chunk.data[begin:end][~mask].tobytes()))
                ids, sizes, spans, kept = zip(*rows, strict=True)
                del chunk, gone, rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch["ids"].type.value_type), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return _told(chunks, replies).mapInArrow(cut, f"id {id_type}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every document, and the digest of the rest."""
    found = repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 400 bytes by its digest, over hexadecimal text (two digits a byte) in overlapping blocks of 512 bytes.
ORACLE_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
b AS (SELECT r, k, substr(h, 1024 * k + 1, 1824) AS h FROM (SELECT r, h, unnest(range(0, len(h) // 1024 + 1)) AS k FROM d)),
p AS (SELECT r, 512 * k + i AS i, md5_number(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, k, h, unnest(range(0, least(512, len(h) // 2 - 399))) AS i FROM b)),
s AS (SELECT r, i FROM p SEMI JOIN (SELECT k FROM p GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM s),
runs AS (SELECT r, min(i) AS b, max(i) + 400 AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM g) GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS b, b AS e FROM runs UNION ALL SELECT r, max(e), NULL FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * b + 1, 2 * (coalesce(e, len(h) // 2) - b)), '' ORDER BY b) AS h FROM gaps JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(e - b) AS removed, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""
