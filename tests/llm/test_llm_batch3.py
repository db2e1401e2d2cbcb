"""Small cases for the trie of conversations, ranked search and repeated substrings: nulls, empties, ties, repeated
rows, empty tables, long texts and columns with clashing names, against plain versions."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import op11_prefix_trie as trie
from tessella.llm import op12_ranked_search as search
from tessella.llm import op13_suffix_repeats as suffixes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query, sql", [(trie.op11_prefix_trie, trie.ORACLE_SQL), (search.op12_ranked_search, search.ORACLE_SQL), (suffixes.op13_suffix_repeats, suffixes.ORACLE_SQL)])
def test_query_against_sql(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(sql)
    got = query(spark, SF).select(list(want.columns)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


# the trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = set()
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in nodes) for p in under)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(full[c]) == len(path)))
        parent = min(nodes[path[:-1]]) if path else None
        out.add((min(members), len(path), parent, len(members), len(kids), leaves, sum((len(nodes[p]) - 1) * words(p) for p in under), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes_of(spark, rows, names="conv_id long, turn long, role string, text string"):
    df = trie.trie(*trie.rebuilt(trie.ordered_turns(spark.createDataFrame(rows, names))))
    return {tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def test_trie_against_plain(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} {c % 3 if t else ''}\tx y") for c in range(30) for t in range(c % 5)]
    rows += [(40, None, None, None), (40, 1, "user", "b"), (40, 1, "user", "a"), (41, 0, "user", "b"), (41, 0, "user", "b"), (None, 0, "user", "x"), (-5, 0, "user", "turn 0 "), (57, 3, None, "long " * 20000)]
    got = nodes_of(spark, rows)
    assert got == plain_trie(rows)


def test_trie_with_many_ends_in_one_node(spark, monkeypatch):
    """Ids of one node stream through the digest in order when a range holds but a few."""
    monkeypatch.setattr(trie, "IDS", 3)
    rows = [(c, 0, "user", "same") for c in range(50)] + [(c, t, "user", "same") for c in range(60, 64) for t in range(6)]
    assert nodes_of(spark, rows) == plain_trie(rows)


def test_trie_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(trie, "SMALL", 0)
    monkeypatch.setattr(trie, "HUB", 5)
    rows = [(c, t, "user", str(min(t, c % 4))) for c in range(40) for t in range(5)]
    assert nodes_of(spark, rows) == plain_trie(rows)


def test_trie_of_nothing_and_clashes(spark):
    assert nodes_of(spark, []) == set()
    rows = [(c, t, "user", "x", 1, 2, 3) for c in range(5) for t in range(4)]
    got = nodes_of(spark, rows, "conv_id long, turn long, role string, text string, node long, depth long, key long")
    assert got == plain_trie([r[:4] for r in rows])


# ranked search


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=40))
def test_packed_numbers(values):
    data, begins = search.packed(np.array(values, np.int64))
    assert search.unpacked(data).tolist() == values and begins[-1] == len(data)


def plain_search(docs, items, top=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, words(t)) for d, t in docs if words(t)]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    df = Counter(x for _, w in held for x in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in held:
            tf, m = Counter(w), 75 + 25 * len(w) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x in words(text) if tf[x])
            if score > 0:
                scores.append((-score, d if d is not None else -(10**9)))
        out += [(item, k + 1, None if d == -(10**9) else d, -s) for k, (s, d) in enumerate(heapq.nsmallest(top, scores))]
    return sorted(out, key=str)


def test_search_against_plain(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(["Alpha", "beta", "gämma", "x1", "Ünder", "the", "the,of", "ÀB-c"], n))
    docs = [(int(d), text(int(rng.integers(1, 40)))) for d in rng.permutation(120)]
    docs += [(500, None), (501, ""), (502, "--- !"), (None, docs[0][1]), (docs[1][0], docs[1][1]), (503, "Alpha " * 30000 + "tail")]
    items = [(1, "alpha alpha gämma"), (2, "THE of x1 x1"), (2, "tail"), (3, None), (4, ""), (None, "beta"), (5, "nowhere")]
    columns = spark.createDataFrame([(*d, 7, 8) for d in docs], "doc_id long, text string, term long, shard long"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, item long")
    for size, most, portion in ((16 << 20, 200_000, 8192), (200, 0, 3)):
        monkeypatch.setattr(search, "SHARD_BYTES", size)
        monkeypatch.setattr(search, "SMALL", most)
        monkeypatch.setattr(search, "PORTION", portion)
        got = search.search(search.build(columns[0]), columns[1])
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items)


def test_search_in_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(search.build(docs), items).count() == 0
    assert search.search(search.build(spark.createDataFrame([(1, "a")], "doc_id long, text string")), items.where("false")).count() == 0


# repeated substrings


def plain_repeats(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def spread(spark, texts, tmp, monkeypatch=None, chunk=4 << 20):
    if monkeypatch:
        monkeypatch.setattr(suffixes, "CHUNK", chunk)
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, chunk long, kept long").repartition(3)
    df.write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.op13_suffix_repeats(spark, str(tmp)).collect()}
    return [got[k] for k in range(len(texts))]


def test_cover_holds_all_differences():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("chunk", [4 << 20, 3000])
def test_repeats_against_plain(spark, tmp_path, monkeypatch, chunk):
    rng = np.random.default_rng(7)
    letters = lambda n: "".join(rng.choice(list("abcdeé "), n))
    shared = [letters(n) for n in (380, 399, 400, 401, 520, 583, 584, 700, 1500)]
    texts = [None, "", "short", "a" * 399, "a" * 400, "b" * 401, "xy" * 900, letters(9000)]
    for k in range(40):  # passages at any offset, overlapping, cut and joined anew
        parts = [letters(int(rng.integers(0, 300)))]
        for _ in range(int(rng.integers(1, 4))):
            s = shared[int(rng.integers(len(shared)))]
            i = int(rng.integers(0, max(1, len(s) - 390))) if k % 2 else 0
            parts += [s[i:], letters(int(rng.integers(0, 200)))]
        texts.append("".join(parts))
    texts += [texts[10], texts[10], texts[11] + "!", "a" * 400]
    assert spread(spark, texts, tmp_path, monkeypatch, chunk) == plain_repeats(texts)


def test_repeats_in_a_long_text_and_in_nothing(spark, tmp_path):
    rng = np.random.default_rng(8)
    long = "".join(map(chr, rng.integers(97, 123, 1_500_000)))
    texts = [long + long[1_200_000:1_200_450] + "#", long[700_000:700_399] + "é"]
    got = spread(spark, texts, tmp_path)
    assert got[0][:3] == (1_500_451, 900, 2) or got[0][:3] == (1_500_451, 900, 1)
    assert got[1][1:3] == (0, 0)
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    assert suffixes.op13_suffix_repeats(spark, f"{tmp_path}/none").count() == 0


def test_a_chunk_takes_little_space_and_few_lie_in_a_row_group(spark, tmp_path, monkeypatch):
    """Else memory grows with the chunks of a split, which are one page and one batch, and with the bytes that repeat."""
    import glob
    import tracemalloc

    import pyarrow.parquet as pq

    text = np.random.default_rng(9).integers(97, 123, 1 << 20).astype(np.uint8)
    chunk = suffixes.Chunk(np.concatenate((text, text)), np.array([len(text), 2 * len(text)]), 64, {})
    chunk.names("tuple")
    tracemalloc.start()
    gone = chunk.covered()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert gone.all() and len(chunk.open) > len(text) // 2
    assert most < 40 * len(gone)  # half of the bytes are named by their 400 bytes
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    df = spark.createDataFrame([(k, f"{k} " * 300) for k in range(40)], "doc_id long, text string").coalesce(1)
    files = [f for path in suffixes.chunked(df, "doc_id", "text").inputFiles() for f in glob.glob(path.removeprefix("file://"))]
    rows = [g.num_rows for f in files for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(rows) >= 20 and max(rows) <= 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 8 << 20
