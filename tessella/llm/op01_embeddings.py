"""Near-duplicate embeddings by sorted projection passes.

Each pass draws random hyperplanes, concatenates a vector's sign bits to a 63-bit key, sorts all vectors
by it and compares each with its next neighbours, a bounded window. Vectors whose cosine reaches the
threshold agree on nine bits in ten, so they stand close in some pass. Planes go through the mean of the
vectors that share the key so far (LEVELS), so that a dense group's keys part its own members; the number of
passes follows from that of the vectors and from how dense they lie. Means, counts and distances are those of
all vectors: tasks add up whole numbers by cell, so that no order of adding matters. Verified pairs of all
passes are united into components.

Within a component every pair is then counted exactly, by matrix products of blocks that give out one
number per vector: a dense group of any size has its whole number of links, without a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleaned, connected_components, read, staged

#: Passes at least and at most.
COSINE, PASSES, MOST, WINDOW, BITS = 0.95, 16, 64, 32, 63
#: Bits of a key before planes are centred anew; vectors of a cell that has an own mean, at least: so many, and
#: all vectors over CELLS (other cells take the mean of the cell they part); share of pairs at the threshold that
#: passes are to find.
LEVELS, FEW, CELLS, RECALL = (6, 6, 51), 16, 4096, 0.999
#: Parts of one in sums, parts of an octave in counts of squared distances, bytes of sums that a task holds.
GRAIN, OCTAVE, HELD = 1 << 20, 64, 32 << 20
#: Vectors of a block in the exact count, in the mean, and of a matrix product.
BLOCK, TILE = 2048, 512


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by their largest component first, so that no square
    overflows or vanishes."""
    rows = rows.astype(float)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def usable(v) -> np.ndarray | None:
    """A vector's components; None for null, empty or zero vectors and such with null or non-finite
    components."""
    row = v.as_py()
    if not row or any(x is None for x in row):
        return None
    x = np.array(row, float)
    return x if np.isfinite(x).all() and x.any() else None


def _number(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, raw binary, dim) of the vectors that can link; raw has the components in their own type."""
    number = _number(vectors)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [usable(v) for v in batch["embedding"]]
            good = [k for k, x in enumerate(rows) if x is not None]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(pa.array(good, pa.int64())), pa.array([rows[k].astype(number).tobytes() for k in good], pa.binary()), pa.array([len(rows[k]) for k in good], pa.int32())],
                ["vec_id", "raw", "dim"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").where("vec_id is not null").mapInArrow(scale, f"vec_id {kind}, raw binary, dim int")


@lru_cache(MOST)
def planes_of(seed: int, dim: int, k: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, k]).standard_normal((dim, BITS))


def _among(code: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each code is one of the ordered `known`, its place there)."""
    if not len(known):
        return np.zeros(len(code), bool), np.zeros(len(code), np.int64)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    return known[at] == code, at


def _centres(code: np.ndarray, known: np.ndarray, own: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """A row for each code: its cell's own, where `known` has the cell, else that of `parent`."""
    there, at = _among(code, known)
    return np.where(there[:, None], own[at], parent) if there.any() else parent


def _coded(x: np.ndarray, planes: np.ndarray, tables: list) -> tuple[np.ndarray, np.ndarray]:
    """(keys of unit vectors by the levels of one pass that `tables` has, their places on the planes). A level has
    the cells with an own mean and each mean's place on the planes from that level on."""
    at, code, place = 0, np.zeros(len(x), np.int64), x @ planes
    centre = np.zeros((len(x), BITS), np.float32)
    for (known, own), width in zip(tables, LEVELS, strict=False):
        centre = _centres(code, known, own, centre[:, -own.shape[1] :])
        bits = place[:, at : at + width] > centre[:, :width]
        code = (code << width) | (bits.astype(np.int64) << np.arange(width - 1, -1, -1)).sum(1)
        at += width
    return code, place


def _vectors(batch: pa.RecordBatch, number: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows of the batch, unit vectors) for each length of vectors."""
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        yield dim, own, unit(np.frombuffer(b"".join(batch["raw"].take(pa.array(own)).to_pylist()), number).reshape(-1, dim))


def added(cell: np.ndarray, n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each cell once, in order, with what its rows add up to."""
    order = np.argsort(cell, kind="stable")
    first = np.flatnonzero(np.diff(cell[order], prepend=-1))
    if len(first) == len(cell):
        return cell[order], n[order], sums[order]
    return cell[order][first], np.add.reduceat(n[order], first), np.add.reduceat(sums[order], first)


def _added_up(parts: Iterator[tuple], whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows (dim, cell, n, sums) of what parts (dim, cell, n, sums) add up to: each cell once if `whole`, else
    again whenever the cells outgrow HELD."""
    held: dict[int, list] = {}
    size, most = 0, HELD

    def contract() -> int:
        for dim, some in held.items():
            held[dim] = [added(*(np.concatenate(x) for x in zip(*some, strict=True)))]
        return sum(x.nbytes for some in held.values() for x in some[0])

    def rows() -> Iterator[pa.RecordBatch]:
        for dim, [(cell, n, sums)] in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(cell), pa.int32()), pa.array(cell, pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in sums], pa.binary())], ["dim", "cell", "n", "sums"])
        held.clear()

    for dim, *part in parts:
        held.setdefault(dim, []).append(part)
        size += sum(x.nbytes for x in part)
        if size > most:
            size = contract()
            if whole:
                most = max(HELD, 2 * size)
            elif size > HELD // 2:
                yield from rows()
                size = 0
    contract()
    yield from rows()


def _sums(reps: DataFrame, models: dict, level: int, since: int, seed: int, number: str, wanted: dict | None = None, count: bool = False) -> dict:
    """{dim: (cells, n, sums)} over all vectors: for the passes from `since` on the cells (pass * CELLS + key so far) with
    their vectors and, unless only those count, the sums of places on the planes from `level` on, times GRAIN; of
    pass 0, which comes by itself, the sums of the vectors. `wanted`: the cells that are asked for, if not all."""
    shared = reps.sparkSession.sparkContext.broadcast((models, wanted))
    at = sum(LEVELS[:level])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        models, wanted = shared.value
        for batch in batches:
            for dim, _, x in _vectors(batch, number):
                for k in range(since, len(models[dim])):
                    code, place = _coded(x, planes_of(seed, dim, k), models[dim][k])
                    cell, value = code + k * CELLS, place[:, :0] if count else x if k == 0 else place[:, at:]
                    if wanted is not None:
                        own = _among(cell, wanted.get(dim, cell[:0]))[0]
                        cell, value = cell[own], value[own]
                    if len(cell):
                        yield dim, *added(cell, np.ones(len(cell), np.int64), np.rint(value * GRAIN).astype(np.int64))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                own = pa.array(np.flatnonzero(dims == dim))
                cell, n, sums = (batch[c].take(own) for c in ("cell", "n", "sums"))
                yield dim, cell.to_numpy(), n.to_numpy(), np.frombuffer(b"".join(sums.to_pylist()), np.int64).reshape(len(cell), -1)

    kind = "dim int, cell long, n long, sums binary"
    found = reps.select("raw", "dim").mapInArrow(lambda batches: _added_up(parts(batches), False), kind)
    if count:
        found = found.groupBy("dim", "cell").agg(F.sum("n").alias("n")).where(F.col("n") >= FEW).withColumn("sums", F.lit(b""))
    else:
        found = found.repartition("dim", "cell").mapInArrow(lambda batches: _added_up(again(batches), True), kind)
    out: dict = {}
    with cleaned(reps.sparkSession):
        rows = found.toArrow()
    for dim, *part in again(rows.to_batches()):
        out.setdefault(dim, []).append(part)
    shared.unpersist()
    return {dim: added(*(np.concatenate(x) for x in zip(*some, strict=True))) for dim, some in out.items()}


def _spread(reps: DataFrame, models: dict, means: dict, seed: int, number: str) -> dict:
    """{dim: (squared distances, n)} of all vectors from the last means of pass 0, in steps of an octave's OCTAVE-th."""
    shared = reps.sparkSession.sparkContext.broadcast((models, means))
    least = 32 * OCTAVE

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        models, means = shared.value
        for batch in batches:
            for dim, _, x in _vectors(batch, number):
                centre = np.zeros_like(x)
                for level, (known, own) in enumerate(means[dim]):
                    centre = _centres(_coded(x, planes_of(seed, dim, 0), models[dim][0][:level])[0], known, own, centre)
                octave = np.log2(np.maximum(((x - centre) ** 2).sum(1), 1e-9))
                yield dim, *added(np.floor(octave * OCTAVE).astype(np.int64) + least, np.ones(len(x), np.int64), np.zeros((len(x), 0), np.int64))

    found = reps.select("raw", "dim").mapInArrow(lambda batches: _added_up(parts(batches), False), "dim int, cell long, n long, sums binary")
    out: dict = {}
    with cleaned(reps.sparkSession):
        for r in found.groupBy("dim", "cell").agg(F.sum("n").alias("n")).orderBy("dim", "cell").collect():
            out.setdefault(r["dim"], []).append((2.0 ** ((r["cell"] - least) / OCTAVE), r["n"]))
    shared.unpersist()
    return {dim: tuple(np.array(x) for x in zip(*some, strict=True)) for dim, some in out.items()}


def enough(rows: int, spread: tuple[np.ndarray, np.ndarray], least: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that find a pair at the threshold with that probability, PASSES to MOST: among all rows, and
    among those that lie densest around their means, where fewer bits agree. spread: (squared distances, ascending, n)."""
    out, (distance, n) = PASSES, spread
    for share in (0.02, 0.05, 0.1, 0.25, 0.5, 1.0):
        around = max(float(distance[np.searchsorted(np.cumsum(n), share / 2 * n.sum())]), 1e-9)
        alike = 1 - np.arccos(max(-1.0, 1 - (1 - least) / around)) / np.pi
        found = alike ** max(0.0, np.log2(max(share * rows, 1) / window))
        out = max(out, MOST if found < 1e-6 else PASSES if found > 1 - 1e-9 else int(np.ceil(np.log(1 - recall) / np.log(1 - found))))
    return min(out, MOST)


def models_of(reps: DataFrame, passes: int | None, window: int, seed: int, least: float, number: str) -> dict[int, list]:
    """{dim: tables of each pass, for `_coded`} of reps (raw, dim)."""
    with cleaned(reps.sparkSession):
        total = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    few = {dim: max(FEW, n // CELLS) for dim, n in total.items()}
    models: dict[int, list] = {dim: [[]] for dim in total}
    means: dict[int, list] = {dim: [] for dim in total}

    def deepen(level: int, since: int) -> None:
        wanted, at = None, sum(LEVELS[:level])
        if level > 1:
            wanted = {dim: cell[n >= few[dim]] for dim, (cell, n, _) in _sums(reps, models, level, since, seed, number, count=True).items()}
        found = _sums(reps, models, level, since, seed, number, wanted)
        for dim, tables in models.items():
            cell, n, sums = found.get(dim, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BITS - at if since else dim))))
            own = n >= (few[dim] if level else 1)
            cell, mean = cell[own], sums[own] / (GRAIN * n[own, None])
            for k in range(since, len(tables)):
                i, j = np.searchsorted(cell, [k * CELLS, (k + 1) * CELLS])
                known, places = cell[i:j] - k * CELLS, mean[i:j]
                if not since:
                    means[dim].append((known, places))
                    places = places @ planes_of(seed, dim, k)[:, at:]
                tables[k].append((known, places.astype(np.float32)))

    for level in range(len(LEVELS)):
        deepen(level, 0)
    spread = {} if passes else _spread(reps, models, means, seed, number)
    for dim, n in total.items():
        count, whole = passes or enough(n, spread[dim], least, window), means[dim][0]
        models[dim] += [[(whole[0], (whole[1] @ planes_of(seed, dim, k)).astype(np.float32))] for k in range(1, count)]
    for level in range(1, len(LEVELS)):
        deepen(level, 1)
    return models


def keyed(reps: DataFrame, passes: int | None, window: int, seed: int, least: float, number: str) -> DataFrame:
    """reps (vec_id, raw, dim) with their keys, one a pass."""
    shared = reps.sparkSession.sparkContext.broadcast(models_of(reps, passes, window, seed, least, number))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [None] * batch.num_rows
            for dim, own, x in _vectors(batch, number):
                found = [_coded(x, planes_of(seed, dim, k), tables)[0] for k, tables in enumerate(shared.value[dim])]
                for k, row in zip(own, np.stack(found, 1), strict=True):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("vec_id", "raw", "dim")), pa.array(keys, pa.list_(pa.int64()))], ["vec_id", "raw", "dim", "keys"])

    return reps.mapInArrow(key, f"vec_id {reps.schema['vec_id'].dataType.simpleString()}, raw binary, dim int, keys array<long>")


#: Beyond rounding: pairs this close to the threshold are decided by the sum of their products.
CLOSE = 1e-9


def alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """For unit vectors x and y whether the cosines of row x[i] and row y[j] reach `least`; a pair's answer is the
    same in every block."""
    cosine = x @ y.T
    i, j = np.nonzero(np.abs(cosine - least) <= CLOSE)
    cosine[i, j] = (x[i] * y[j]).sum(1)
    return cosine >= least


def _near(window: int, least: float, number: str):
    """Rows (a, b) of a strip's vectors at most `window` places apart whose cosine reaches `least`. The last
    `window` vectors of a batch are the first of the next one; the first and last ones of a whole strip come out
    as rows of their own (side, strip, row), for `_across`."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        group, head, strip = None, None, TaskContext.get().partitionId()

        def out(a, b, side=None, rows=None):
            n = len(a) if rows is None else rows.num_rows
            edge = pa.nulls(n, edge_type) if rows is None else rows.to_struct_array().combine_chunks()
            a, b = (x if rows is None else pa.nulls(n, kind) for x in (a, b))
            return pa.RecordBatch.from_arrays([a, b, pa.array([side] * n, pa.string()), pa.array([strip] * n, pa.int32()), edge], ["a", "b", "side", "strip", "row"])

        kind = edge_type = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if edge_type is None:
                edge_type, kind = pa.struct(list(batch.schema)), batch.schema.field("vec_id").type
            head = table.slice(0, window) if head is None else pa.concat_tables([head, table]).slice(0, window) if head.num_rows < window else head
            passes, dims = batch["pass"].to_numpy(), batch["dim"].to_numpy()
            cuts = np.flatnonzero(np.diff(passes) | np.diff(dims)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(passes)], strict=True):
                own = (passes[lo], dims[lo])
                part = table.slice(lo, hi - lo)
                fresh = 0 if held is None or own != group else held.num_rows
                if fresh:
                    part = pa.concat_tables([held, part])
                group = own
                a, b = _pairs(part, fresh, window, least, number)
                if len(a):
                    yield out(a, b)
                held = part.slice(max(0, part.num_rows - window))
        if held is not None:
            yield out([], [], "head", head)
            yield out([], [], "tail", held)

    return run


def _pairs(part: pa.Table, fresh: int, window: int, least: float, number: str) -> tuple[pa.Array, pa.Array]:
    """Ids of the alike pairs of an ordered table, at most `window` places apart, that aren't both among the first `fresh`."""
    x = unit(np.frombuffer(b"".join(part["raw"].to_pylist()), number).reshape(part.num_rows, -1))
    ids = part["vec_id"].combine_chunks()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, min(window, len(x) - 1) + 1):
        since = max(0, fresh - gap)
        at = since + np.flatnonzero((x[since:-gap] * x[since + gap :]).sum(1) >= least)
        a.append(at)
        b.append(at + gap)
    return ids.take(pa.array(np.concatenate(a))), ids.take(pa.array(np.concatenate(b)))


def _across(window: int, least: float, number: str):
    """Alike pairs of the last rows of a strip and the first of the next: one group a strip's end."""

    def run(rows: pa.Table) -> pa.Table:
        one = lambda side: rows.filter(pa.compute.equal(rows["side"], side))["row"].combine_chunks()
        tail, head = (pa.Table.from_struct_array(x).sort_by([(c, "ascending") for c in ("pass", "dim", "key", "vec_id")]) for x in (one("tail"), one("head")))
        last = {k: tail[k][-1].as_py() for k in ("pass", "dim")} if tail.num_rows else None
        same = lambda t: t.filter(pa.compute.and_(pa.compute.equal(t["pass"], last["pass"]), pa.compute.equal(t["dim"], last["dim"])))
        if last is None or not head.num_rows or not same(head).num_rows:
            return pa.table({"a": pa.array([], rows["a"].type), "b": pa.array([], rows["b"].type)})
        tail = same(tail)
        a, b = _pairs(pa.concat_tables([tail, same(head)]), tail.num_rows, window, least, number)
        return pa.table({"a": a, "b": b})

    return run


def _links_inside(good: DataFrame, component: DataFrame, least: float, number: str) -> DataFrame:
    """(vec_id, n_links) of the members of components: all pairs of a component, block by block."""
    size = component.groupBy("component").agg(F.count("*").alias("n"))
    member = component.join(size, "component").join(good.select(F.col("vec_id").alias("node"), "raw", "dim"), "node")
    parts = F.ceil(F.col("n") / BLOCK)
    block = F.pmod(F.xxhash64("node"), parts).alias("block")
    blocks = staged(member.groupBy("component", "dim", parts.alias("parts"), block).agg(F.collect_list(F.struct("node", "raw")).alias("of")), "blocks")
    # each block names the blocks that it meets, so that a large component's pairs fall to many tasks
    meets = F.explode(F.sequence("block", F.col("parts") - 1)).alias("j")
    left = blocks.select("component", "dim", F.col("block").alias("i"), meets, F.col("of").alias("of_i"))
    pair = left.join(blocks.select("component", "dim", F.col("block").alias("j"), F.col("of").alias("of_j")), ["component", "dim", "j"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, totals = [], []
            kind = batch["of_i"].type.value_type.field("node").type
            for i, j, mine, others in zip(batch["i"], batch["j"], batch["of_i"], batch["of_j"], strict=True):
                mine, others = mine.values, others.values
                x, y = (unit(np.frombuffer(b"".join(v.field("raw").to_pylist()), number).reshape(len(v), -1)) for v in (mine, others))
                id_x, id_y = (v.field("node").to_numpy(False) for v in (mine, others))
                of_x, of_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                for p in range(0, len(x), TILE):
                    for q in range(0, len(y), TILE):
                        hit = alike(x[p : p + TILE], y[q : q + TILE], least)
                        hit &= id_x[p : p + TILE, None] != id_y[None, q : q + TILE]
                        of_x[p : p + TILE] += hit.sum(1)
                        of_y[q : q + TILE] += hit.sum(0)
                ids.append(mine.field("node"))
                totals.append(of_x)
                if i.as_py() != j.as_py():
                    ids.append(others.field("node"))
                    totals.append(of_y)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids).cast(kind) if ids else pa.array([], kind), pa.array(np.concatenate(totals) if totals else [], pa.int64())], ["vec_id", "n"])

    kind = good.schema["vec_id"].dataType.simpleString()
    return pair.select("i", "j", "of_i", "of_j").mapInArrow(count, f"vec_id {kind}, n long").groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame, least: float = COSINE, passes: int | None = None, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors`.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor do
    rows without id, nor vectors of different lengths; such a vector's component is its own id. Of
    repeated ids one row's vector stands for all. Other columns are ignored. Without `passes` their number
    follows from the vectors (`enough`).
    """
    good = staged(prepared(vectors.select("vec_id", "embedding")).dropDuplicates(["vec_id"]), "units")
    spark, number = vectors.sparkSession, _number(vectors)
    # equal vectors count once in the passes; only one of them stands in the sorted rows
    same = good.groupBy("dim", F.xxhash64("raw").alias("h"), "raw").agg(F.min("vec_id").alias("rep"))
    reps = staged(same.select(F.col("rep").alias("vec_id"), "raw", "dim"), "reps")
    reps = staged(keyed(reps, passes, window, seed, least, number), "keyed")
    # strips of each pass's order: ranges of the key, so that one pass may take many tasks
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = reps.select("vec_id", "raw", "dim", F.posexplode("keys").alias("pass", "key"))
    ordered = rows.repartitionByRange(parts, "pass", "dim", "key", "vec_id").sortWithinPartitions("pass", "dim", "key", "vec_id")
    kind = good.schema["vec_id"].dataType.simpleString()
    row = "struct<pass:int,dim:int,key:bigint,vec_id:" + kind + ",raw:binary>"
    found = ordered.select("pass", "dim", "key", "vec_id", "raw").mapInArrow(_near(window, least, number), f"a {kind}, b {kind}, side string, strip int, row {row}")
    found = staged(found, "found")
    # the rows beside the edges of strips: 2 x window a strip
    edges = found.where("side is not null").withColumn("edge", F.col("strip") + F.when(F.col("side") == "tail", 1).otherwise(0))
    across = edges.groupBy("edge").applyInArrow(_across(window, least, number), f"a {kind}, b {kind}")
    pairs = found.where("a is not null").select("a", "b").union(across)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    copies = good.join(same.select("raw", "dim", "rep"), ["raw", "dim"]).where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    component = staged(connected_components(staged(pairs.union(copies), "links")), "components")
    linked = _links_inside(good, component, least, number).join(component.select(F.col("node").alias("vec_id"), "component"), "vec_id")
    return (
        vectors.select("vec_id").join(linked, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
