"""Staging, batches and connected components for the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of a batch that goes to Python: texts may be long, and a batch is held whole on both sides.
BATCH = 500


def bounded_batches(spark: SparkSession, most: int | None = None) -> None:
    """Lower the session's Arrow batches to BATCH rows, where they are larger, and to about `most` bytes, if so asked."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH:
        spark.conf.set(key, str(BATCH))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if most is not None and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


#: Shuffle files go when the write that made them has ended: no later job reads them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside leaves no shuffle files."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, compression: str = "snappy", options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later jobs neither repeat the
    work above it nor lose it with an executor. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.options(**(options or {})).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


#: Rows that a broadcast may have at most (of a few numbers each: some 10 MB); more rows go by a shuffle.
SMALL = 200_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, a staged table of a few numbers a row, with a broadcast hint where it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


#: Neighbours from which a node counts as a hub, and hubs at most, as a share of all links' ends.
HUB, HUBS = 1000, 10_000


def _with_least(both: DataFrame, ends: int) -> DataFrame:
    """both (u, v) and m, the least v of each u. Nodes of many neighbours, of which there can be but HUBS,
    are joined by broadcast, so that no task gathers a hub's neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    many = max(HUB, ends // HUBS)
    with cleaned(both.sparkSession):
        hubs_here = ends >= many and least.agg(F.max("n")).first()[0] >= many
    if not hubs_here:
        return both.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.where(F.col("n") >= many).select("u", "m"))
    others = both.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") < many).select("u", "m"), "u")
    return both.join(hubs, "u").union(others)


#: Edges that are contracted at once: a task holds no more of them (some 2 MB, less than a partition of a shuffle).
AT_ONCE = 100_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Other edges (u, v) that connect the same: in each stretch of a partition every node has one, to the
    smallest node that the stretch's edges reach. Long chains shorten by it, so that there are fewer rounds."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        def found(schema) -> pa.RecordBatch:
            nodes = [x for x in above if root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(nodes, schema.field("u").type), pa.array([root(x) for x in nodes], schema.field("v").type)], ["u", "v"])

        held = 0
        for batch in batches:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
                u, v = root(u), root(v)
                if u != v:
                    above[max(u, v)] = min(u, v)
            held += batch.num_rows
            if held >= AT_ONCE:
                yield found(batch.schema)
                above.clear()
                held = 0
        if held:
            yield found(batch.schema)

    return edges.select("u", "v").mapInArrow(contract, edges.select("u", "v").schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that links
    reach. Alternates large-star and small-star: each round rewires every node to the smallest
    neighbour, so the rounds grow with the logarithm of a component's diameter and no task gathers a
    component. Nodes are of any orderable type; null ends and self links are ignored."""
    e = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )

    def state(e: DataFrame) -> tuple:
        with cleaned(e.sparkSession):
            return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def stars(e: DataFrame) -> tuple[DataFrame, bool]:
        """e written and contracted as it is read, and whether that was one stretch, which leaves nothing to do."""
        whole = staged(e, "edges")
        few = whole.count() <= AT_ONCE
        out = staged(_contracted(whole.coalesce(1) if few else whole), "stars")
        forget(whole)
        return out, few

    # rounds are written, and the shuffle files and tables of those before go: they would outweigh the links
    e, done = stars(e)
    before = None if done else state(e)
    while not done:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        last = e
        e, done = stars(
            _with_least(large, before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        forget(last)
        now = state(e)
        done, before = done or now == before, now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


#: Classes of items that an outline counts.
OUTLINE = 64


def outline(items: np.ndarray) -> np.ndarray:
    """How many items (hashes) of each of OUTLINE classes a text has."""
    return np.bincount((items >> np.uint64(58)).astype(np.int64), minlength=OUTLINE)


def outlines(texts: list[np.ndarray]) -> np.ndarray:
    """The outline of each of many texts, a row each, in the smallest type that holds the counts."""
    of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    kind = (np.concatenate(texts) >> np.uint64(58)).astype(np.int64) if texts else of
    found = np.bincount(of * OUTLINE + kind, minlength=len(texts) * OUTLINE).reshape(-1, OUTLINE)
    return found.astype(np.min_scalar_type(int(found.max(initial=0))))


def may_be_alike(one: np.ndarray, many: np.ndarray, least: float) -> np.ndarray:
    """Whether the items in common, which are no more than the counts in common, can reach `least` of all items."""
    total = one.sum(dtype=np.int64) + many.sum(1, dtype=np.int64)
    return np.minimum(one, many).sum(1, dtype=np.int64) >= least * total / (1 + least) - 1e-6


#: Members that a bucket holds others against first; members and bytes of a block, in the mean.
LEADERS, BLOCK, BLOCK_BYTES = 8, 2048, 2 << 20


def bucket_links(reps: DataFrame, runs_of, alike, agree: int, opened=lambda x: x, leaders: int = LEADERS, least: float | None = None) -> DataFrame:
    """Verified links (a, b) among texts that share a sketch, enough of them to connect whatever is
    connected; a bucket of any size neither meets in one task nor makes all its pairs.

    reps: (rep, sketches), one row a text; sketches is an array of longs of which equal numbers at one
    place make a bucket. runs_of(ids (rep)) -> (rep, runs binary) of those texts. alike(x, y) decides on
    two runs, each as `opened` makes it of an array of uint64. agree: equal sketches that two similar texts have all but surely.
    leaders: how many members of a bucket all are held against first; what is connected doesn't depend on it, but how many
    redundant links come out does. least: where alike accepts no pair that has less than that share of its items in common,
    whatever their order, counts of items (outlines) rule out pairs of a block by numpy, without loss.

    1. Each member is held against up to `leaders` members of its bucket.
    2. Of buckets that have more members than leaders and aren't all connected by that, the members outside the bucket's first
       component are held against all others, in pairs of blocks; only what links two components that
       the block has not yet joined comes out.
    """
    buckets = reps.select("rep", F.posexplode("sketches").alias("band", "bucket"))
    slot = F.pmod(F.xxhash64("rep"), F.lit(leaders))
    heads = buckets.groupBy("band", "bucket").agg(
        F.count("*").alias("n"), *(F.min(F.when(slot == k, F.col("rep"))).alias(f"of_{k}") for k in range(leaders))
    )
    heads = heads.where("n > 1").select("band", "bucket", "n", F.array_compact(F.array(*(f"of_{k}" for k in range(leaders)))).alias("leaders"))
    shared = staged(buckets.join(heads, ["band", "bucket"]), "shared")
    pairs = shared.select("rep", F.explode("leaders").alias("leader")).where("rep <> leader")
    pairs = pairs.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    runs = staged(runs_of(staged(shared.select("rep").distinct(), "paired")), "runs")

    @F.pandas_udf("boolean")
    def holds(x, y):
        import pandas as pd

        return pd.Series([alike(opened(np.frombuffer(p, np.uint64)), opened(np.frombuffer(q, np.uint64))) for p, q in zip(x, y, strict=True)], dtype=bool)

    both = pairs.join(runs.select(F.col("rep").alias("a"), F.col("runs").alias("of_a")), "a").join(runs.select(F.col("rep").alias("b"), F.col("runs").alias("of_b")), "b")
    links = staged(both.where(holds("of_a", "of_b")).select("a", "b"), "links")

    # what is still apart within a bucket
    known = staged(connected_components(links), "components")
    placed = shared.where(F.col("n") > F.size("leaders")).select("band", "bucket", "n", "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    split = placed.groupBy("band", "bucket").agg(F.min("component").alias("first"), F.max("component").alias("last"))
    apart = placed.join(split.where("first <> last"), ["band", "bucket"])
    apart = apart.join(reps, "rep").join(runs, "rep")
    apart = staged(apart, "apart")
    weight = apart.groupBy("band", "bucket").agg(F.sum(F.octet_length("runs")).alias("bytes"))
    apart = apart.join(weight, ["band", "bucket"])
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("rep", F.lit(1)), parts).alias("block")
    member = F.struct("rep", "component", (F.col("component") != F.col("first")).alias("outer"), "sketches", "runs")
    blocks = staged(apart.groupBy("band", "bucket", parts.alias("parts"), block).agg(F.collect_list(member).alias("members"), F.max(F.col("component") != F.col("first")).alias("outer")), "blocks")
    # each block names the blocks that it meets, so that a large bucket's pairs fall to many tasks
    meets = F.explode(F.sequence("block", F.col("parts") - 1)).alias("j")
    left = blocks.select("band", "bucket", F.col("block").alias("i"), meets, F.col("members").alias("of_i"), F.col("outer").alias("outer_i"))
    right = blocks.select("band", "bucket", F.col("block").alias("j"), F.col("members").alias("of_j"), F.col("outer").alias("outer_j"))
    crossed = left.join(right, ["band", "bucket", "j"]).where("outer_i or outer_j").select("band", "i", "j", "of_i", "of_j")

    def members(rows):
        """(ids, components, whether outside the first component, sketches, runs, outlines) of a block."""
        rows = rows.values
        data = rows.field("runs")
        sketch = rows.field("sketches")
        data = [np.frombuffer(x.as_buffer(), np.uint64) for x in data]
        return (rows.field("rep"), rows.field("component").to_pylist(), np.array(rows.field("outer").to_pylist(), bool),
                sketch.flatten().to_numpy().reshape(len(rows), -1), data, None if least is None else outlines(data))

    def compare(batches):
        for batch in batches:
            found_a, found_b = [], []
            for band, i, j, mine, others in zip(*(batch[c] for c in ("band", "i", "j", "of_i", "of_j")), strict=True):
                group: dict = {}

                def root(x, group=group):
                    while group.get(x, x) != x:
                        x = group[x]
                    return x

                (ids_i, component_i, outer_i, sketch_i, runs_i, shape_i), (ids_j, component_j, outer_j, sketch_j, runs_j, shape_j) = members(mine), members(others)
                hits: tuple[list, list] = ([], [])
                # those of the first component meet only the others
                everyone, others_j = np.arange(len(ids_j)), np.flatnonzero(outer_j)
                sketch_others, shape_others = sketch_j[others_j], None if least is None else shape_j[others_j]
                open_i, open_j = {}, {}
                for p in range(len(ids_i)):
                    pool, sketches, shapes = (everyone, sketch_j, shape_j) if outer_i[p] else (others_j, sketch_others, shape_others)
                    if i == j:  # the pairs of one block count once
                        after = np.searchsorted(pool, p, "right")
                        pool, sketches, shapes = pool[after:], sketches[after:], None if least is None else shapes[after:]
                    if not len(pool):
                        continue
                    if least is not None:
                        fit = np.flatnonzero(may_be_alike(shape_i[p], shapes, least))
                        pool, sketches = pool[fit], sketches[fit]
                    same = sketches == sketch_i[p]
                    # a pair is compared in the first band that both share, once
                    for q in pool[(same.sum(1) >= agree) & (same.argmax(1) == band.as_py())]:
                        if root(component_i[p]) == root(component_j[q]):
                            continue
                        if p not in open_i:
                            open_i[p] = opened(runs_i[p])
                        if q not in open_j:
                            open_j[q] = opened(runs_j[q])
                        if alike(open_i[p], open_j[q]):
                            hits[0].append(p)
                            hits[1].append(q)
                            group[root(component_i[p])] = root(component_j[q])
                found_a.append(ids_i.take(pa.array(hits[0], pa.int64())))
                found_b.append(ids_j.take(pa.array(hits[1], pa.int64())))
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(found_a), pa.concat_arrays(found_b)], ["a", "b"])

    kind = reps.schema["rep"].dataType.simpleString()
    more = crossed.mapInArrow(compare, f"a {kind}, b {kind}")
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return staged(links.union(more).distinct(), "links")
