"""Passages that repeat across documents, by paragraph MinHash banding.

A text's paragraphs are its sentences (cut at line ends and after sentence marks; sentences of under five
words join each other). Of paragraphs of over LONG words, parts of PART words are paragraphs too: those
whose hash is the least of PART neighbours, so that the cuts follow from the content alone. Every run of
RUN words thus holds a whole paragraph, wherever it was cut out.

1. Equal paragraphs of two documents form a cluster. Different ones are banded by MinHash over their 5-word
   shingles, bands and rows tuned for recall at Jaccard similarity 0.8; those that share a band are held
   against each other by exact similarity (common.bucket_links), and components of links are clusters.
2. An exact check follows. Of the runs of RUN words around a clustered paragraph, the first and the last are
   looked up among those of other documents; where neither stands in another one, all between them are.
3. Runs found join up to passages, with them chains of neighbouring clustered paragraphs that one other
   document shares (edited passages), RUN words at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL, bounded_batches, bucket_links, connected_components, forget, read, small, staged
from .words import FOLD, _power, mixed, spans

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Words of a passage at least, of a paragraph that is cut once more, of such a part, of an edited part between
#: two runs of one passage.
RUN, LONG, PART, BETWEEN = 50, 22, 12, 20
#: Words of the smallest paragraphs that can be similar without being equal: 4 of 5 shingles in common.
LEAST = WORDS + 3


def tuned(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 1) -> int:
    """Bands of `rows` rows each that find a pair of that similarity with that probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def hashed(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(bytes, folded bytes, starts, ends and hashes of the words, number of the first word of each text and of
    all words) of texts, one after the other."""
    data = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(data), np.uint8)
    folded = np.frombuffer(raw.tobytes().translate(FOLD), np.uint8)
    starts, ends = spans(folded)
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * _power("up", len(folded))[: len(folded)], dtype=np.uint64, out=sums[1:])
    word = mixed((sums[ends] - sums[starts]) * _power("down", len(folded))[starts])
    return raw, folded, starts, ends, word, np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)]))


#: Bytes of texts that are hashed at once; a longer text goes alone.
AT_ONCE = 1 << 18


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(number of the first row, `hashed` of the texts) for groups of neighbouring rows."""
    held, size, since = [], 0, 0
    for k, t in enumerate(batch["text"]):
        t = t.as_py() or ""
        if held and size + len(t) > AT_ONCE:
            yield since, hashed(held)
            held, size, since = [], 0, k
        held.append(t)
        size += len(t)
    if held:
        yield since, hashed(held)


def _between(word: np.ndarray):
    """A function that hashes the words from a to b, for arrays of places."""
    n = len(word)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * _power("up", n)[:n], dtype=np.uint64)))
    return lambda a, b: mixed((sums[b] - sums[a]) * _power("down", n)[np.minimum(a, n - 1)])


def runs_of(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by place of the first."""
    n = len(word) - k + 1
    if n < 1:
        return word[:0]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * _power("up", len(word))[: len(word)], dtype=np.uint64)))
    return mixed((sums[k:] - sums[:n]) * _power("down", len(word))[:n])


def _sliding(of, x: np.ndarray, width: int) -> np.ndarray:
    """np.minimum or np.maximum over each `width` neighbours, in log(width) steps."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[:-step], x[step:])
        done += step
    return x


def sentences(raw: np.ndarray, folded: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, words) of the sentences of texts that begin at those words. A cut counts if a sentence
    beside it has WORDS words, so it depends on its two neighbours only."""
    mark = (raw == 46) | (raw == 33) | (raw == 63)  # . ! ?
    cut = raw == 10
    cut[1:] |= mark[:-1] & (folded[1:] == 32)
    of = np.searchsorted(np.flatnonzero(cut), starts)
    new = np.zeros(len(starts) + 1, bool)
    new[begin] = True
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    large = np.diff(np.append(first, len(starts))) >= WORDS
    kept = new[first]
    kept[1:] |= large[1:] | large[:-1]
    at = first[kept]
    return at, np.diff(np.append(at, len(starts)))


def parts(word: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the parts of PART words of the sentences of over LONG words: each is the least of
    some PART neighbours within the sentence, the last one where several are equal."""
    run = runs_of(word, PART)
    if len(run) < PART or (words <= LONG).all():
        return np.zeros(0, np.int64), run[:0]
    low = np.uint64(0xFFFFFF)
    ranked = (run & ~low) | (low - (np.arange(len(run), dtype=np.uint64) & low))
    least = _sliding(np.minimum, ranked, PART)
    of = np.repeat(np.arange(len(at)), words)
    least = np.where(of[: len(least)] == of[2 * PART - 2 :], least, 0)
    edge = np.zeros(PART - 1, np.uint64)
    found = np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, least, edge)), PART) == ranked)
    return found, run[found]


def paragraphs(known: tuple[np.ndarray, ...]) -> dict[str, np.ndarray] | None:
    """at, words and content (a hash of all words) of the paragraphs of hashed texts, sentences first, and
    `sentences`, their number; None where there are none."""
    raw, folded, starts, _, word, begin = known
    if len(starts) < WORDS:
        return None
    at, words = sentences(raw, folded, starts, begin)
    more, content = parts(word, at, words)
    at, words = at[words >= WORDS], words[words >= WORDS]
    own = mixed(_between(word)(at, at + words) + words.astype(np.uint64))
    return {"at": np.concatenate((at, more)), "words": np.concatenate((words, np.full(len(more), PART))), "content": np.concatenate((own, mixed(content + np.uint64(PART)))), "sentences": len(at)}


def shingles_of(word: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all paragraphs, place of each one's first)."""
    many = words - WORDS + 1
    first = np.cumsum(many) - many
    return runs_of(word, WORDS)[np.repeat(at - first, many) + np.arange(many.sum())], first


def scanned(docs: DataFrame, text: str = "text", bands: int = 5) -> DataFrame:
    """(doc_id, at, words, content, since, until, left, right, sketches) of all paragraphs. left and right are
    hashes of the first and the last run of RUN words around it, since and until their places, null in shorter
    texts and for longer paragraphs. sketches is null for those that can be similar to none but equal ones."""

    marks = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def sketched(word: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        shingle, first = shingles_of(word, at, words)
        order = (shingle ^ marks[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        order ^= order >> np.uint64(32)
        return mixed(np.minimum.reduceat(order, first, axis=1) + marks[:, None]).T.ravel().view(np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, known in _groups(batch):
                p = paragraphs(known)
                if p is None or not len(p["at"]):
                    continue
                word, begin, at, words = known[4], known[5], p["at"], p["words"]
                of = np.searchsorted(begin, at, "right") - 1
                run = runs_of(word, RUN)
                since, until = np.maximum(begin[of], at + words - RUN), np.minimum(at, begin[of + 1] - RUN)
                lost = (words > RUN) | (begin[of + 1] - begin[of] < RUN)
                around = lambda place: pa.array(run[np.where(lost, 0, place)].view(np.int64) if len(run) else np.zeros(len(at), np.int64), mask=lost)  # noqa: B023, E731
                banded = np.flatnonzero(words[: p["sentences"]] >= LEAST)
                has = np.zeros(len(at), bool)
                has[banded] = True
                flat = pa.array(sketched(word, at[banded], words[banded]) if len(banded) else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * bands))).astype(np.int32)), flat, mask=pa.array(~has))
                number = lambda x, mask=None: pa.array(x.astype(np.int32), mask=mask)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(row + of)), number(at - begin[of]), number(words), pa.array(p["content"].view(np.int64)), number(since - begin[of], lost), number(until - begin[of], lost), around(since), around(until), lists],
                    ["doc_id", "at", "words", "content", "since", "until", "left", "right", "sketches"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).where("doc_id is not null and text is not null").mapInArrow(
        scan, f"doc_id {kind}, at int, words int, content long, since int, until int, left long, right long, sketches array<long>"
    )


def _marked(docs: DataFrame, marks: DataFrame, text: str) -> DataFrame:
    """(doc_id, text, marks) of the texts with marks (doc_id, mark): the others aren't read on."""
    ends = staged(marks.groupBy("doc_id").agg(F.collect_set("mark").alias("marks")), "marks")
    docs = docs.select("doc_id", F.col(text).alias("text")).where("doc_id is not null and text is not null")
    # by shuffle at every size: marks grow with the texts; a row for each id is hashed, so that texts aren't sorted
    return docs.join(ends.hint("shuffle_hash"), "doc_id")


def _contents(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(rep, runs): the sorted shingles of the wanted contents (rep, low), each from a text that holds it, low."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, known in _groups(batch):
                p = paragraphs(known)
                begin = known[5]
                own = batch["marks"].slice(row, len(begin) - 1).flatten().to_numpy()
                hit = np.flatnonzero(np.isin(p["content"].view(np.int64), own)) if p else np.zeros(0, np.int64)
                hit = hit[np.unique(p["content"][hit], return_index=True)[1]] if len(hit) else hit
                if len(hit):
                    shingle, first = shingles_of(known[4], p["at"][hit], p["words"][hit])
                    shingles = [np.unique(x).tobytes() for x in np.split(shingle, first[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(p["content"][hit].view(np.int64)), pa.array(shingles, pa.binary())], ["rep", "runs"])

    found = _marked(docs, wanted.select(F.col("low").alias("doc_id"), F.col("rep").alias("mark")), text).select("text", "marks").mapInArrow(look_up, "rep long, runs binary")
    return found.groupBy("rep").agg(F.first("runs").alias("runs"))


def _windows(docs: DataFrame, ranges: DataFrame, text: str) -> DataFrame:
    """(doc_id, at, run): hashes of the runs of RUN words from since to until of ranges (doc_id, since, until)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, known in _groups(batch):
                run, begin = runs_of(known[4], RUN), known[5]
                own = batch["marks"].slice(row, len(begin) - 1)
                ahead = np.repeat(begin[:-1], own.value_lengths().to_numpy())
                mark = own.flatten().to_numpy()
                since, until = ahead + (mark >> 32), ahead + (mark & 0xFFFFFFFF)
                fits = until + RUN <= np.repeat(begin[1:], own.value_lengths().to_numpy())  # a repeated id may have a shorter text too
                opened = np.bincount(since[fits], minlength=len(run) + 1) - np.bincount(until[fits] + 1, minlength=len(run) + 1)
                at = np.flatnonzero(np.cumsum(opened)[: len(run)] > 0)
                of = np.searchsorted(begin, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row + of)), pa.array((at - begin[of]).astype(np.int32)), pa.array(run[at].view(np.int64))], ["doc_id", "at", "run"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    mark = F.shiftleft(F.col("since").cast("long"), 32) + F.col("until")
    return _marked(docs, ranges.select("doc_id", mark.alias("mark")), text).mapInArrow(look, f"doc_id {kind}, at int, run long")


def _placed(docs: DataFrame, passages: DataFrame, text: str) -> DataFrame:
    """passages (doc_id, at, to, ...) with start and end, the code points of their words."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, cols = [], {c: [] for c in ("at", "to", "start", "end")}
            for k, (t, own) in enumerate(zip(batch["text"], batch["marks"], strict=True)):
                raw = np.frombuffer(t.as_py().encode("utf-8", "replace"), np.uint8)
                starts, ends = spans(np.frombuffer(raw.tobytes().translate(FOLD), np.uint8))
                points = np.cumsum((raw & 0xC0) != 0x80)
                mark = own.values.to_numpy()
                at, to = mark >> 32, mark & 0xFFFFFFFF
                fits = to <= len(starts)  # a repeated id may have a shorter text too
                at, to = at[fits], to[fits]
                owner.append(np.full(len(at), k))
                for c, x in (("at", at), ("to", to), ("start", points[starts[at]] - 1), ("end", points[ends[to - 1] - 1])):
                    cols[c].append(x.astype(np.int32))
            if owner:
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(np.concatenate(owner))), *(pa.array(np.concatenate(x)) for x in cols.values())], ["doc_id", *cols])

    kind = docs.schema["doc_id"].dataType.simpleString()
    mark = F.shiftleft(F.col("at").cast("long"), 32) + F.col("to")
    where = _marked(docs, passages.select("doc_id", mark.alias("mark")), text).mapInArrow(place, f"doc_id {kind}, at int, to int, start int, end int")
    return passages.join(where.dropDuplicates(["doc_id", "at", "to"]), ["doc_id", "at", "to"])


def jaccard(x: set, y: set) -> float:
    """Of two sets of shingles."""
    common = len(x & y)
    return common / (len(x) + len(y) - common)


def clusters_of(docs: DataFrame, units: DataFrame, text: str, least: float) -> DataFrame:
    """(content, cluster_id, low, high): the contents that stand in two documents or more, or are similar to
    one of another document; low and high are the cluster's smallest and largest documents."""
    contents = units.groupBy("content").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    banded = units.where("sketches is not null")
    bucket = F.explode("sketches").alias("bucket")
    shared = banded.select("content", bucket).groupBy("bucket").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").select("bucket")
    shared = staged(shared, "shared")
    ids = staged(banded.select("content", bucket).join(small(shared, 5 * SMALL), "bucket", "left_semi").select("content").distinct(), "ids")
    met = banded.select("content", "sketches", "doc_id").join(small(ids, 5 * SMALL), "content", "left_semi")
    met = staged(met.groupBy("content").agg(F.first("sketches").alias("sketches"), F.min("doc_id").alias("low")), "met")
    reps = met.select(F.col("content").alias("rep"), "sketches")
    wanted = met.select(F.col("content").alias("rep"), "low")
    links = bucket_links(reps, lambda ids: _contents(docs, wanted.join(ids, "rep", "left_semi"), text), lambda x, y: min(len(x), len(y)) >= least * max(len(x), len(y)) and jaccard(x, y) >= least, agree=1, opened=lambda x: set(x.tolist()), least=least)
    linked = staged(connected_components(links).withColumnRenamed("node", "content"), "linked")
    # contents are grouped once: what stands in one document and is like no other content goes
    named = contents.join(small(linked), "content", "left").where("component is not null or low <> high")
    named = staged(named, "contents")
    ends = named.where("component is not null").groupBy("component").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most")
    alone = named.where("component is null").select("content", F.col("content").alias("cluster_id"), "low", "high")
    inside = named.join(ends, "component").select("content", F.col("component").alias("cluster_id"), F.col("least").alias("low"), F.col("most").alias("high"))
    return staged(alone.union(inside), "clusters")


def _ranges(runs: DataFrame) -> DataFrame:
    """(doc_id, at, to, cluster_id, low) of what runs of RUN words (doc_id, at, cluster_id, low) cover: those of
    RUN neighbouring places overlap, so they are one range."""
    found = runs.groupBy("doc_id", "low", F.floor(F.col("at") / RUN).alias("block")).agg(F.min("at").alias("at"), (F.max("at") + RUN).alias("to"), F.min("cluster_id").alias("cluster_id"))
    return found.select("doc_id", "at", "to", "cluster_id", "low")


def verbatim(docs: DataFrame, hits: DataFrame, text: str) -> DataFrame:
    """(doc_id, at, to, cluster_id, low) of ranges of words whose runs of RUN words another document has too,
    around hits, the clustered paragraphs. A paragraph without such a run at its first and last place is looked
    at in all of them."""
    near = hits.where("since is not null")
    ends = near.select("doc_id", F.explode(F.array("left", "right")).alias("run"))
    both = staged(ends.groupBy("run").agg(F.min("doc_id").alias("of"), F.max("doc_id").alias("high")).where("of <> high").select("run", "of"), "ends")
    ends = both.hint("shuffle_hash")  # as many as the input has: by shuffle at every size
    known = near.join(ends.select(F.col("run").alias("left"), F.col("of").alias("of_left")), "left", "left").join(ends.select(F.col("run").alias("right"), F.col("of").alias("of_right")), "right", "left")
    known = staged(known.select("doc_id", "content", "cluster_id", "since", "until", "of_left", "of_right").repartition("doc_id"), "known")
    side = F.explode(F.array(F.struct(F.col("since").alias("at"), F.col("of_left").alias("low")), F.struct(F.col("until").alias("at"), F.col("of_right").alias("low")))).alias("side")
    outer = _ranges(known.select("doc_id", "cluster_id", side).select("doc_id", "side.at", "cluster_id", "side.low").where("low is not null"))
    open_ = staged(known.where("of_left is null and of_right is null").select("content").distinct(), "open")
    windows = staged(_windows(docs, known.join(open_.hint("shuffle_hash"), "content", "left_semi"), text), "windows")
    shared = windows.groupBy("run").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("run", "low")
    inner = _ranges(windows.join(shared, "run").select("doc_id", "at", F.col("run").alias("cluster_id"), "low"))
    out = staged(outer.union(inner), "verbatim")
    forget(windows, known, both)
    return out


def _chains(hits: DataFrame, keys: list[str], between: int) -> DataFrame:
    """hits with passage, the number of a chain among those of equal keys: each hit begins at most `between`
    words after all before it end; and seen, the end of those before."""
    order = Window.partitionBy(*keys).orderBy("at", "to", "cluster_id")
    seen = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("seen", seen)
    return hits.withColumn("passage", F.sum((~F.coalesce(F.col("at") <= F.col("seen") + between, F.lit(False))).cast("int")).over(order))


_fresh = lambda since: F.greatest(F.lit(0), F.col("to") - F.greatest("at", since))


def repeated_passages(docs: DataFrame, text: str = "text", min_words: int = RUN, least: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, start, end (code points, end exclusive), n_words, removed_words, cluster_id, kept: one row
    per passage of min_words words or more that repeats in another document. Of each cluster, and of each run,
    the smallest doc_id keeps its own; removed_words counts those of others, and kept says that there are
    none. cluster_id is the cluster of the passage's first paragraph, or a verbatim run's hash.

    Verbatim repeats of min_words words (RUN at least) are all found. Their edges lie at most a paragraph
    within the repeat. Null and empty texts, rows without id and paragraphs of under five words have no
    part in it; repeated rows of one id count as one document; an empty table gives no rows; other columns
    are ignored. A text of any length is one row of a batch: its words' hashes take some 60 bytes each.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col(text).alias("text"))
    units = staged(scanned(docs, "text", tuned(least, recall)), "paragraphs")
    clusters = clusters_of(docs, units, "text", least)
    hits = staged(units.drop("sketches").join(clusters.hint("shuffle_hash"), "content"), "hits")
    forget(units)
    runs = verbatim(docs, hits, "text")
    # edited passages: neighbouring paragraphs that the same other document shares
    other = F.when(F.col("low") < F.col("doc_id"), F.col("low")).otherwise(F.col("high"))
    beside = hits.where("low <> high").select("doc_id", other.alias("other"), "at", (F.col("at") + F.col("words")).alias("to"), "cluster_id", "low")
    chains = _chains(beside, ["doc_id", "other"], BETWEEN).groupBy("doc_id", "other", "passage")
    chains = chains.agg(F.min("at").alias("at"), F.max("to").alias("to"), F.sum(_fresh("seen")).alias("n"), F.min_by("cluster_id", "at").alias("cluster_id"), F.min("low").alias("low"))
    chains = chains.where(F.col("n") >= RUN).select("doc_id", "at", "to", "cluster_id", "low")
    found = _chains(runs.select("doc_id", "at", "to", "cluster_id", "low").union(chains).distinct(), ["doc_id"], BETWEEN)
    lost = F.col("low") < F.col("doc_id")
    before = Window.partitionBy("doc_id").orderBy("at", "to", "cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("gone", F.max(F.when(lost, F.col("to"))).over(before))
    passages = found.groupBy("doc_id", "passage").agg(
        F.min("at").alias("at"), F.max("to").alias("to"), F.sum(_fresh("seen")).alias("n_words"),
        F.sum(F.when(lost, _fresh("gone")).otherwise(0)).alias("removed_words"), F.min_by("cluster_id", F.struct("at", "cluster_id")).alias("cluster_id"),
    )
    passages = staged(passages.where(F.col("n_words") >= min_words), "passages")
    return _placed(docs, passages, "text").select("doc_id", "start", "end", "n_words", "removed_words", "cluster_id", (F.col("removed_words") == 0).alias("kept"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
