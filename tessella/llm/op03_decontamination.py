"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the test items.

A word is a run of ASCII letters or digits (A-Z lower-cased) or of characters beyond ASCII. An item's
windows are its runs of `window` words; an item of fewer words is one window. Texts are scanned once,
as strings of word codes of one length, so a match's offset gives a word's number and maps from there to the original
text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, read, staged
from .words import FOLD, spans

WINDOW = 10
#: Words of the items of one automaton, which takes some 210 MB at most; more go to further automata, one
#: staged pass over the rows each.
SHARD_WORDS = 100_000


def normalised(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return text.encode("utf-8", "replace").translate(FOLD).split() if isinstance(text, str) else []


def item_windows(text: str | None, window: int) -> set[bytes]:
    words = normalised(text)
    return {b" ".join(words[k : k + window]) for k in range(max(1, len(words) - window + 1))} if words else set()


def coded(number: int, width: int) -> str:
    """A word's number as `width` characters, the first of them below 128 and the others from 128 on, so
    that codes are met at the beginnings of words only."""
    digits = [number >> 7 * k & 127 for k in range(width)]
    return chr(digits[0]) + "".join(chr(128 + d) for d in digits[1:])


def automaton(items: list[tuple[str | None, str]], window: int):
    """(codes of the items' words, automaton of all windows, each with its words and items); None without
    windows. Words that no item has share the code of number 0."""
    import ahocorasick

    found: dict[bytes, set] = {}
    for item_id, text in items:
        for w in item_windows(text, window):
            found.setdefault(w, set()).add(item_id)
    if not found:
        return None
    words = sorted({x for w in found for x in w.split(b" ")})
    width = 1 + max(1, -(-(len(words) + 1).bit_length() // 7) - 1)
    code = {w: coded(k, width) for k, w in enumerate(words, 1)}
    out = ahocorasick.Automaton()
    for w, ids in found.items():
        key = w.split(b" ")
        out.add_word("".join([code[x] for x in key]), (len(key), frozenset(ids)))
    out.make_automaton()
    return code, out


_built: dict = {}


def _automaton(shared, window: int):
    of, items = shared.value
    if _built.get("of") != of:
        _built.update(of=of, automaton=automaton(items, window))
    return _built["automaton"]


def scan(text: str | None, machine) -> tuple[int, list[tuple[int, int]], set]:
    """(words, hit word ranges merged and in order, items with occurring windows) of a text."""
    words = normalised(text)
    if not words or machine is None:
        return len(words), [], set()
    code, windows = machine
    width = len(next(iter(code.values())))
    known, other = code.get, coded(0, width)
    found = list(windows.iter("".join([known(w, other) for w in words])))
    if not found:
        return len(words), [], set()
    ranges: list[tuple[int, int]] = []
    for to, since in sorted(((end + 1) // width, (end + 1) // width - n) for end, (n, _) in found):
        while ranges and ranges[-1][1] >= since:
            since = min(since, ranges.pop()[0])
        ranges.append((since, to))
    return len(words), ranges, set().union(*(ids for _, (_, ids) in found))


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point offsets (end exclusive) of the original text."""
    data = text.encode("utf-8", "replace")
    starts, ends = spans(np.frombuffer(data.translate(FOLD), np.uint8))
    place = lambda b: len(data[:b].decode("utf-8", "ignore"))
    return [(place(starts[a]), place(ends[b - 1])) for a, b in ranges]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", passed: list[str] | None = None) -> DataFrame:
    """The columns `passed` (all by default) of docs with n_words, hits (array of struct<since, to>: ranges of
    hit words) and items (array of item ids as strings).

    Null and empty texts have no words and no hits, null or empty items no windows; an item without an id
    hits but isn't listed; repeated rows give repeated rows; columns of docs named as a new one give way; an empty benchmark hits nothing. The
    benchmark goes to the executors in shards of some SHARD_WORDS words (an item goes whole), each one
    pass over the rows; passes are staged, so neither the driver nor a Python worker holds more than one
    automaton. A text of any length is scanned whole; so are ties and overlaps: each item that occurs is listed.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("text is not null")
    size = items.agg(F.sum(F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    shards = -(-size // SHARD_WORDS) or 1
    kept = [c for c in (docs.columns if passed is None else passed) if c not in ("n_words", "hits", "items")]
    out = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<since:int,to:int>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k) if shards > 1 else items
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in own.collect()]))
        after = [f for f in out.schema if f.name != "text" or k + 1 < shards]  # the last pass drops the text
        out = out.mapInArrow(_pass(shared, window, k + 1 < shards), T.StructType(after))
        out = staged(out, "scanned") if k + 1 < shards else out
    return out.select("row.*", "n_words", "hits", "items")


def _pass(shared, window: int, keep_text: bool):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shared, window)
        for batch in batches:
            n, hits, items = [], [], []
            for text, old, known in zip(batch["text"], batch["hits"], batch["items"], strict=True):
                words, ranges, ids = scan(text.as_py(), machine)
                n.append(words)
                hits.append([{"since": a, "to": b} for a, b in _merged([(r["since"], r["to"]) for r in old.as_py()] + ranges)])
                items.append(sorted({*known.as_py(), *(i for i in ids if i is not None)}))
            hit_type = pa.list_(pa.struct([("since", pa.int32()), ("to", pa.int32())]))
            out = {"row": batch["row"], "text": batch["text"], "n_words": pa.array(n, pa.int64()), "hits": pa.array(hits, hit_type), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict({k: v for k, v in out.items() if keep_text or k != "text"})

    return run


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), passed=["doc_id"])
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + (r["to"] - r["since"]).cast("long"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )



_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS k FROM iw WHERE len(ws) > 0)),
dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM dw),
found AS (
  SELECT doc_id, k, windows.n, item_id
  FROM (SELECT doc_id, k, m.n, array_to_string(ws[k : k + m.n - 1], ' ') AS w, len(ws) AS total
        FROM pos, (SELECT DISTINCT n FROM windows) m WHERE k + m.n - 1 <= len(ws)) g
  JOIN windows ON windows.n = g.n AND windows.w = g.w),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT dw.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
