"""Ranked lexical search: compressed postings in shards, merged document at a time by a heap of cursors.

A shard holds the documents of some 16 MB of text. Its documents are numbered by ascending doc_id, and each
term's postings (number, occurrences) are differences and counts in variable-length bytes. A block of items
is ranked shard by shard: a heap of one cursor a term walks the postings in the order of documents, each item
keeps its best documents in a bounded heap (score, then doc_id), and the shards' bests are merged.

Null and empty texts and texts without a term are in no posting and count nowhere; items without a term get
no rows. Rows that repeat a doc_id are documents of their own (each may be ranked), rows that repeat an
item_id are items of their own. A null doc_id comes before the others at equal scores. Other columns of
either table aren't read.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL, bounded_batches, read, staged

#: Bytes of text of a shard (a longer text is a shard of its own); items ranked together.
SHARD_BYTES, ITEMS = 16 << 20, 256
#: Postings scored at once: PORTION times ITEMS numbers at most.
PORTION = 8192
TOP = 20
#: A-Z to lower case, other ASCII that is no digit or small letter to a blank; bytes from 128 up stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(_FOLD).split()


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers from 0 up in bytes of seven bits, the lowest first, of which the top bit says that more follow; and
    where each number begins, the end of all last."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    top = int(v.max()) if len(v) else 0
    for k in range(1, 10):
        if top < 1 << 7 * k:
            break
        size += v >= np.uint64(1 << 7 * k)
    begins = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(begins[-1]), np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        more = np.flatnonzero(size > k)
        part = (v[more] >> np.uint64(7 * k)) & np.uint64(127)
        out[begins[more] + k] = part.astype(np.uint8) | np.where(size[more] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), begins


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    starts = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    place = np.arange(len(b)) - np.repeat(starts, last - starts + 1)
    parts = (b & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, starts).astype(np.int64) if len(b) else np.zeros(0, np.int64)


class _Shard:
    """The inverted index of some documents, while it is built."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.lengths, self.words, self.bytes = [], [], [], 0

    def add(self, doc_id, text: bytes) -> None:
        known = self.vocabulary
        found = [known.setdefault(w, len(known)) for w in terms(text)]
        if found:
            self.ids.append(doc_id)
            self.lengths.append(len(found))
            self.words.append(np.array(found, np.int64))
            self.bytes += len(text)

    def rows(self, shard: int, kind: pa.DataType, schema: pa.Schema):
        """One row of the documents (term null), then one row a term."""
        ids, lengths = pa.array(self.ids, kind), np.array(self.lengths, np.int64)
        order = pc.sort_indices(pa.table({"k": ids}), sort_keys=[("k", "ascending")], null_placement="at_start").to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        # postings by term, then document; equal ones counted
        key = np.sort(np.concatenate(self.words) * len(order) + np.repeat(number, lengths))
        fresh = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times, key = np.diff(np.append(fresh, len(key))), key[fresh]
        term, doc = np.divmod(key, len(order))
        begins = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        gaps = np.diff(doc, prepend=0)
        gaps[begins[:-1]] = doc[begins[:-1]]
        names = list(self.vocabulary)
        head = {"shard": [shard], "term": [None], "n": [len(order)], "total": [int(lengths.sum())], "ids": [ids.take(pa.array(order))], "docs": [packed(lengths[order])[0]], "times": [None]}
        yield pa.RecordBatch.from_pydict(head, schema)
        (docs, doc_at), (times, time_at) = packed(gaps), packed(times)
        doc_at, time_at, count = doc_at[begins].tolist(), time_at[begins].tolist(), np.diff(begins)
        for since in range(0, len(names), 5000):
            many = range(since, min(since + 5000, len(names)))
            no = [None] * len(many)
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard] * len(many), "term": names[many.start : many.stop], "n": count[many.start : many.stop], "total": no, "ids": no,
                 "docs": [docs[doc_at[k] : doc_at[k + 1]] for k in many], "times": [times[time_at[k] : time_at[k + 1]] for k in many]}, schema)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The staged index: (shard, term binary, n, total, ids, docs, times). A term's row has n documents; docs are
    the differences of their numbers and times the occurrences. The row of a shard's documents has no term; its n
    is their count, total their terms, ids the doc_ids by number and docs their lengths in terms."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"shard long, term binary, n long, total long, ids array<{kind}>, docs binary, times binary"

    def shards(batches):
        from pyspark import TaskContext

        base, k, shard = TaskContext.get().partitionId() << 32, 0, _Shard()
        for batch in batches:
            id_type = batch.schema.field("id").type
            schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("total", pa.int64()), ("ids", pa.list_(id_type)), ("docs", pa.binary()), ("times", pa.binary())])
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.bytes >= SHARD_BYTES:
                    yield from shard.rows(base + k, id_type, schema)
                    k, shard = k + 1, _Shard()
        if shard.ids:
            yield from shard.rows(base + k, id_type, schema)

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return staged(given.mapInArrow(shards, out), "postings")


def _asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, asked): terms of each row of items and how often it has them."""
    numbered = staged(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text")), "items")
    kind = numbered.schema["item_id"].dataType.simpleString()

    def split(batches):
        from collections import Counter

        for batch in batches:
            for item, item_id, text in zip(batch["item"], batch["item_id"], batch["text"].cast(pa.binary()), strict=True):
                found = Counter(terms(text.as_py()))
                many = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * many, pa.int64()), pa.array([item_id.as_py()] * many, item_id.type), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["item", "item_id", "term", "asked"])

    return staged(numbered.where("text is not null").mapInArrow(split, f"item long, item_id {kind}, term binary, asked long"), "asked")


def _walk(postings: list[np.ndarray], times: list[np.ndarray]):
    """Portions (document, list, occurrences) of all lists, merged by ascending document; a document is whole in its portion."""
    width = len(postings)
    cursors = [zip((p * width + k).tolist(), t.tolist()) for k, (p, t) in enumerate(zip(postings, times, strict=True))]
    merged, rest = heapq.merge(*cursors), []
    while True:
        portion = rest + list(islice(merged, PORTION))
        if len(portion) == len(rest):
            if rest:
                key, tf = np.array(rest, np.int64).T
                yield key // width, key % width, tf
            return
        key, tf = np.array(portion, np.int64).T
        doc = key // width
        whole = int(np.searchsorted(doc, doc[-1]))
        rest = portion[whole:]
        if whole:
            yield doc[:whole], key[:whole] % width, tf[:whole]


def _best(postings, times, weight, asks, lengths, n_docs: int, n_terms: int, top: int):
    """{item: [(score, -document), ...]}: each item's best documents of one shard."""
    members = sorted({i for items, _ in asks for i in items})
    place = {item: k for k, item in enumerate(members)}
    columns = [np.array([place[i] for i in items], np.int64) for items, _ in asks]
    repeats = [np.array(n, np.int64) for _, n in asks]
    begins = np.concatenate(([0], np.cumsum([len(c) for c in columns])))
    columns, repeats = np.concatenate(columns), np.concatenate(repeats)
    m = 75 + (25 * lengths * n_docs) // n_terms
    bests, least = [[] for _ in members], np.zeros(len(members), np.int64)
    for doc, k, tf in _walk(postings, times):
        part = weight[k] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        size = begins[k + 1] - begins[k]
        at = np.repeat(begins[k] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        docs, row = np.unique(doc, return_inverse=True)
        score = np.zeros(len(docs) * len(members), np.int64)
        np.add.at(score, np.repeat(row, size) * len(members) + columns[at], np.repeat(part, size) * repeats[at])
        score = score.reshape(len(docs), len(members))
        for d, i in zip(*np.nonzero(score > least), strict=True):
            heap, entry = bests[i], (int(score[d, i]), -int(docs[d]))
            if len(heap) < top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == top:
                least[i] = heap[0][0]
    return dict(zip(members, bests, strict=True))


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of the index for each row of items.

    Terms' weights and the lengths' mean are of the whole index. The asked terms go to the index by
    broadcast while they are at most SMALL, else by a shuffle in which a frequent term is split by shard.
    """
    spark = index.sparkSession
    totals = index.where("term is null").agg(F.sum("n").alias("n_docs"), F.sum("total").alias("n_terms")).first()
    n_docs, n_terms = totals["n_docs"] or 0, totals["n_terms"] or 1
    asked = _asked(items, id_col, text_col)
    pairs, n_items = asked.agg(F.count("*"), F.count_distinct("item")).first()
    blocks = max(1, -(-n_items // ITEMS))
    asks = asked.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "term", "item", "asked")
    asks = asks.groupBy("block", "term").agg(F.collect_list(F.struct("item", "asked")).alias("asks"))
    # the lists of asked terms, then how rare each of these is in the whole index
    distinct = asked.select("term").distinct()
    salts = 1 if pairs <= SMALL else 64
    salted = lambda df, salt: df.withColumn("salt", salt)
    spread = lambda df: F.broadcast(df) if pairs <= SMALL else salted(df, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = ["term"] if pairs <= SMALL else ["term", "salt"]
    lists = index.where("term is not null")
    if pairs > SMALL:
        lists = salted(lists, F.pmod(F.xxhash64("shard"), F.lit(salts)).cast("int"))
    lists = staged(lists.join(spread(distinct), on), "lists")
    rare = lists.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("weight")
    weighted = asks.join(rare.select("term", weight), "term")
    wanted = lists.join(spread(weighted), on).select("shard", "block", "term", "weight", "asks", "docs", "times", F.lit(None).cast(index.schema["ids"].dataType).alias("ids"))
    heads = index.where("term is null").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "term", F.lit(None).cast("long").alias("weight"), F.lit(None).cast(weighted.schema["asks"].dataType).alias("asks"), "docs", "times", "ids",
    )
    doc_kind = index.schema["ids"].dataType.elementType.simpleString()

    def rank(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        is_list = pc.is_valid(group["term"])
        head, wanted = group.filter(pc.invert(is_list)), group.filter(is_list)
        ids, lengths = head["ids"][0].values, unpacked(head["docs"][0].as_py())
        out: dict[str, list] = {"item": [], "at": [], "score": []}
        if wanted.num_rows:
            asks = [([a["item"] for a in x], [a["asked"] for a in x]) for x in wanted["asks"].to_pylist()]
            postings = [np.cumsum(unpacked(x.as_py())) for x in wanted["docs"]]
            times = [unpacked(x.as_py()) for x in wanted["times"]]
            for item, heap in _best(postings, times, wanted["weight"].to_numpy(), asks, lengths, n_docs, n_terms, top).items():
                for score, at in heap:
                    out["item"].append(item)
                    out["at"].append(-at)
                    out["score"].append(score)
        return pa.table({"item": pa.array(out["item"], pa.int64()), "doc_id": ids.take(pa.array(out["at"], pa.int64())), "score": pa.array(out["score"], pa.int64())})

    found = wanted.unionByName(heads).groupBy("shard", "block").applyInArrow(rank, f"item long, doc_id {doc_kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = asked.select("item", "item_id").distinct()
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return search(build(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""WITH folded AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, r, len(ws)::BIGINT AS n, unnest(ws) AS term FROM folded WHERE len(ws) > 0),
tf AS (SELECT doc_id, r, n, term, count(*)::BIGINT AS tf FROM d GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS nn, sum(len(ws))::BIGINT AS l FROM folded WHERE len(ws) > 0),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
q AS (SELECT i, item_id, term, count(*)::BIGINT AS k FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
c AS (SELECT i, item_id, doc_id, r, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY i, item_id, doc_id, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20"""
