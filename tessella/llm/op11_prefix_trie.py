"""The trie of conversations' shared beginnings, by partition refinement.

All conversations start in one class, the root. A round for each turn splits every active class by that turn's
(role, text): parts of several conversations stay active, a conversation that is left alone retires, and its
remaining turns are a chain of nodes that no round visits. Counts of leaves and savings are folded back over the
active classes from the deepest up.

Turns are ordered by turn (null first); equal turns by role, then text. Null roles and texts are empty. Rows
without conv_id belong to no conversation. Rows that repeat are turns of their own. No rows: no nodes. Other
columns aren't read. Texts go into a digest of (role, text) at once and are shuffled only to be ordered.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HUB, HUBS, SMALL, read, staged

#: Ids that are joined to one text by a row: conv_ids are distinct, so a range of as many holds no more.
IDS = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, ordinal from 1, key, words), staged. A conversation of any length is numbered over many tasks:
    rows are dealt by range and counted per part first."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    dealt = staged(dealt.select("conv_id", F.monotonically_increasing_id().alias("at"), key.alias("key"), words.alias("words")), "turns")
    part = F.shiftright("at", 33)
    parts = dealt.groupBy("conv_id", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = staged(parts.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")), "parts")
    numbered = dealt.withColumn("part", part).join(_hinted(parts), ["conv_id", "part"])
    return staged(numbered.select("conv_id", (F.col("at") + F.col("shift")).alias("ordinal"), "key", "words"), "ordered")


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first one of its twenty."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key, words) and (conv_id, length) of the rebuilt conversations, staged; a conversation
    without turns has length 0."""
    own = turns.groupBy("conv_id").agg(F.max("ordinal").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % 20
    given = own.select(F.col("conv_id").alias("base"), F.col("own").alias("given"))
    convs = own.select("conv_id", "own", base.alias("base"), borrowed(F.col("conv_id")).alias("h")).join(given, "base", "left")
    taken = F.least(F.coalesce("given", F.lit(0)), "h")
    convs = staged(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "convs")
    shared = turns.where("ordinal <= 3").select(F.col("conv_id").alias("base"), F.col("ordinal").alias("depth"), "key", "words")
    first = convs.join(shared, "base").where("depth <= h").select("conv_id", "depth", "key", "words")
    kept = turns.where(F.col("ordinal") > borrowed(F.col("conv_id"))).join(_hinted(convs.select("conv_id", "h", "taken")), "conv_id")
    kept = kept.select("conv_id", (F.col("ordinal") - F.col("h") + F.col("taken")).alias("depth"), "key", "words")
    # by depth, so that a round reads its own slice only
    rows = first.union(kept).repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id")
    return staged(rows, "rebuilt"), convs.select("conv_id", "length")


def _placed(step: DataFrame, parts: DataFrame) -> DataFrame:
    """(conv_id, node, length): the members of step (conv_id, node, key, length) in parts (parent, key, node, n). Parts
    of many members, which are few, go by broadcast, so that no task gathers one; all do where there are few."""
    total = step.count()
    many = max(HUB, total // HUBS)
    named = parts.select(F.col("parent"), "key", F.col("node").alias("part"), "n")
    step = step.withColumnRenamed("node", "parent")
    join = lambda p: step.join(p, ["parent", "key"]).select("conv_id", F.col("part").alias("node"), "length")
    if parts.count() <= SMALL:
        return join(F.broadcast(named))
    return join(F.broadcast(named.where(F.col("n") >= many))).union(join(named.where(F.col("n") < many)))


def _ends(ended: DataFrame) -> DataFrame:
    """(conv_id, depth, ends): digest of the ids that end in each node (node, depth, id). Ids are joined to texts
    by ranges that hold at most IDS of them; only a node of several such texts streams them, in order, through
    one digest (SHA-256 goes in order), and holds none."""
    texts = ended.groupBy("node", "depth", F.floor(F.col("id") / IDS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    texts = staged(texts, "ends")
    many = texts.groupBy("node", "depth").agg(F.count("*").alias("n"))
    texts = texts.join(many, ["node", "depth"])
    alone = texts.where("n = 1").select("node", "depth", F.sha2("ids", 256).alias("ends"))

    def digests(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for node, depth, ids in zip(batch["node"].to_pylist(), batch["depth"].to_pylist(), batch["ids"], strict=True):
                if (node, depth) != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (node, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            yield _digests(out)
        if at is not None:
            yield _digests([(*at, state.hexdigest())])

    long = texts.where("n > 1").repartition("node", "depth").sortWithinPartitions("node", "depth", "range")
    return alone.union(long.select("node", "depth", "ids").mapInArrow(digests, "node long, depth long, ends string"))


def _digests(rows: list) -> pa.RecordBatch:
    node, depth, ends = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(depth, pa.int64()), pa.array(ends, pa.string())], ["node", "depth", "ends"])


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, depth, key, words) of given lengths (conv_id, length).

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). Rounds are
    as many as the longest beginning that two conversations share.
    """
    root = lengths.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).first()
    long = lambda v: F.lit(v).cast("long")
    active = [lengths.select("conv_id", long(root["node"]).alias("node"), F.col("length").cast("long").alias("length"))]
    parts: list[DataFrame] = []
    many = root["n"]
    while many:
        turn = rows.where(F.col("depth") == len(active)).select("conv_id", "key", "words")
        step = active[-1].join(turn, "conv_id")
        split = step.groupBy(F.col("node").alias("parent"), "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("words").alias("words"), F.min("length").alias("length"))
        parts.append(staged(split, "split"))
        shared = parts[-1].where("n > 1")
        many = shared.count()
        if many:
            active.append(staged(_placed(step.select("conv_id", "node", "key", "length"), shared), "active"))
    # the chains of those who retired: alone from depth d on
    shape = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    out = lengths.sparkSession.createDataFrame([], shape)
    for d, split in enumerate(parts, 1):
        chain = split.where("n = 1").select(F.col("node").alias("conv_id"), "parent", "length", F.explode(F.sequence(long(d), F.col("length"))).alias("depth"))
        last = F.col("depth") == F.col("length")
        out = out.union(chain.select(
            "conv_id", "depth", F.when(F.col("depth") == d, F.col("parent")).otherwise(F.col("conv_id")), long(1), F.when(last, 0).otherwise(1).cast("long"), long(1), long(0),
            F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_EMPTY)))
    # folded back from the deepest shared nodes to the root
    below, nodes = None, []
    for d in range(len(parts), -1, -1):
        if d:
            here = parts[d - 1].select("node", "parent", "n", ((F.col("n") - 1) * F.col("words")).alias("saves"))
        else:
            here = lengths.sparkSession.createDataFrame([(root["node"], None, root["n"], 0)] if root["n"] else [], "node long, parent long, n long, saves long")
        if below is not None:
            under = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("leaves").alias("under_leaves"), F.sum("saved").alias("under_saved"))
            here = here.join(under, "node", "left")
        else:
            here = here.select("*", *(F.lit(None).cast("long").alias(c) for c in ("children", "under_leaves", "under_saved")))
        here = here.select("node", "parent", "n", F.coalesce("children", long(0)).alias("children"), F.coalesce("under_leaves", long(1)).alias("leaves"), (F.col("saves") + F.coalesce("under_saved", long(0))).alias("saved"))
        below = staged(here, "folded") if d else here
        nodes.append((d, below.where("n > 1") if d else below))
    ended = None
    for d, members in enumerate(active):
        at = members.where(F.col("length") == d).select("node", long(d).alias("depth"), F.col("conv_id").alias("id"))
        ended = at if ended is None else ended.union(at)
    shared = None
    for d, found in nodes:
        at = found.select("node", long(d).alias("depth"), "parent", "n", "children", "leaves", "saved")
        shared = at if shared is None else shared.union(at)
    shared = shared.join(_ends(ended), ["node", "depth"], "left")
    return out.union(shared.select("node", "depth", "parent", "n", "children", "leaves", "saved", F.coalesce("ends", F.lit(_EMPTY))))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return trie(*rebuilt(ordered_turns(read(spark, sf_dir, "conversations"))))


#: CRC-32 bit by bit: DuckDB has none.
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

ORACLE_SQL = rf"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS o FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, ({_CRC}) % 4 AS h, n FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
k AS (SELECT c.conv_id, c.base, c.h, least(coalesce(b.n, 0), c.h) AS taken, least(coalesce(b.n, 0), c.h) + greatest(c.n - c.h, 0) AS len FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, t.o AS depth, t.role, t.text FROM k JOIN t ON t.conv_id = k.base AND t.o <= k.h UNION ALL SELECT k.conv_id, t.o - k.h + k.taken, t.role, t.text FROM k JOIN t ON t.conv_id = k.conv_id AND t.o > k.h),
p AS (SELECT conv_id, depth, text, string_agg(len(role) || ':' || role || len(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM r),
m AS (SELECT conv_id, depth, text, sha256(prefix) AS prefix FROM p UNION ALL SELECT conv_id, 0, '', '' FROM k),
g AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node, count(*) OVER (PARTITION BY depth, prefix) AS n FROM m),
e AS (SELECT g.node, g.depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM g JOIN k USING (conv_id) WHERE k.len = g.depth GROUP BY g.node, g.depth),
d AS (SELECT g.node, g.depth, any_value(g.n) AS n, any_value(g.text) AS text, any_value(u.node) AS parent FROM g LEFT JOIN g u ON u.conv_id = g.node AND u.depth = g.depth - 1 WHERE g.conv_id = g.node GROUP BY g.node, g.depth),
f AS (SELECT d.*, (n - 1) * len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS saves, coalesce(kids, 0) AS kids FROM d LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS kids FROM d WHERE depth > 0 GROUP BY ALL) q ON q.parent = d.node AND q.depth = d.depth),
s AS (SELECT g.node, g.depth, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(f.saves) AS saved FROM f JOIN g ON g.conv_id = f.node AND g.depth <= f.depth GROUP BY g.node, g.depth)
SELECT f.node AS conv_id, f.depth::BIGINT AS depth, f.parent AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM f JOIN s USING (node, depth) LEFT JOIN e USING (node, depth)"""
