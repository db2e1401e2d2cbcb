"""Small cases for embeddings, archives, decontamination, packing and language: nulls, empties, ties,
repeated rows, empty tables and columns with clashing names."""

import hashlib
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import op01_embeddings, op02_warc, op03_decontamination, op04_packing, op05_language

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


# embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + 0.05 * rng.standard_normal(16)], 0) for i in range(200)]
    rows += [(200, rows[3][1], 1), (201, rows[3][1], 1), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] * 16, 1), (205, [1.0, None] * 8, 1), (206, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component long")
    got = {r["vec_id"]: r for r in op01_embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows[:202]]
    unit = np.array([v / np.sqrt(v @ v) for _, v in good])
    near = unit @ unit.T >= 0.95
    for k in range(202):
        assert got[k]["n_links"] == near[k].sum() - 1
        assert got[k]["kept"] == (got[k]["component_id"] == k)
    for k in range(202, 207):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert got[200]["component_id"] == got[3]["component_id"] == got[201]["component_id"]


def test_embeddings_of_a_dense_group(spark):
    """Pairs at cosine 0.952 within a group whose vectors all are at cosine 0.8 to each other."""
    rng = np.random.default_rng(5)
    turn = lambda x, cosine: cosine * x + np.sqrt(1 - cosine**2) * op01_embeddings.unit((d := rng.standard_normal(x.shape)) - (d * x).sum(1, keepdims=True) * x)
    centre = np.repeat(op01_embeddings.unit(rng.standard_normal((1, 64))), 6000, 0)
    group = turn(centre, np.sqrt(0.8))
    x = np.concatenate([group, turn(group[:400], 0.952)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in op01_embeddings.near_duplicates(df).collect()}
    near = x @ x.T >= 0.95
    whole = sum(got[k]["n_links"] == near[k].sum() - 1 for k in range(400))
    assert whole >= 396


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op01_embeddings.near_duplicates(df).count() == 0


def test_embedding_models_from_all_vectors(spark, tmp_path):
    """A dense group is keyed by its own means whatever its ids; ids that a sample by their hash had left out."""
    rng = np.random.default_rng(6)
    turn = lambda x, cosine: cosine * x + np.sqrt(1 - cosine**2) * op01_embeddings.unit((d := rng.standard_normal(x.shape)) - (d * x).sum(1, keepdims=True) * x)
    group = turn(np.repeat(op01_embeddings.unit(rng.standard_normal((1, 512))), 4000, 0), np.sqrt(0.8))
    x = np.concatenate([group, turn(group[:400], 0.952), op01_embeddings.unit(rng.standard_normal((600, 512)))])
    hashed = spark.range(40_000).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1_000_003)) >= 790_000).toPandas()
    ids = np.concatenate([hashed["id"][hashed["h"]][:4400], hashed["id"][~hashed["h"]][:600]])
    of = {k: v for v, k in enumerate(ids.tolist())}
    path = str(tmp_path / "vectors.parquet")
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(x), pa.list_(pa.float64()))}), path)
    reps = op01_embeddings.staged(op01_embeddings.prepared(spark.read.parquet(path)), "units")
    rows = op01_embeddings.keyed(reps, None, op01_embeddings.WINDOW, 7, op01_embeddings.COSINE, "<f8").select("vec_id", "keys").collect()
    keys = np.array([r["keys"] for r in sorted(rows, key=lambda r: of[r["vec_id"]])])
    met = np.zeros(400, bool)
    for key in keys.T:
        place = np.argsort(np.argsort(key, kind="stable"))
        met |= np.abs(place[:400] - place[4000:4400]) <= op01_embeddings.WINDOW
    assert keys.shape[1] > op01_embeddings.PASSES  # the group is dense, and is seen
    assert met.sum() >= 396
    # means and keys are those of a plain computation over all vectors, at any partitioning
    models = [op01_embeddings.models_of(reps.repartition(n), 2, op01_embeddings.WINDOW, 7, op01_embeddings.COSINE, "<f8")[512] for n in (1, 5)]
    assert all(np.array_equal(a, b) for one, other in zip(*models, strict=True) for p, q in zip(one, other, strict=True) for a, b in zip(p, q, strict=True))
    for k, tables in enumerate(models[0]):
        place, code, at = x @ op01_embeddings.planes_of(7, 512, k), np.zeros(len(x), np.int64), 0
        centre = np.zeros_like(place)
        for (known, own), width in zip(tables, op01_embeddings.LEVELS, strict=True):
            cells, n = np.unique(code, return_counts=True)
            assert known.tolist() == cells[n >= 16].tolist()
            for cell, places in zip(known.tolist(), own, strict=True):
                assert np.allclose(places, (mean := place[code == cell].mean(0))[at:], atol=1e-4)
                centre[code == cell] = mean
            code = (code << width) | ((place > centre)[:, at : at + width].astype(np.int64) << np.arange(width - 1, -1, -1)).sum(1)
            at += width


def test_embedding_sums_of_bounded_size(monkeypatch):
    """What a task gives out again and again adds up to the same."""
    rng = np.random.default_rng(8)
    parts = [(int(rng.integers(2, 4)), rng.integers(0, 50, 40), np.ones(40, np.int64), rng.integers(-9, 9, (40, 3))) for _ in range(30)]
    monkeypatch.setattr(op01_embeddings, "HELD", 2000)
    for whole in (False, True):
        found: dict = {}
        rows = [r for batch in op01_embeddings._added_up(iter(parts), whole) for r in batch.to_pylist()]
        assert whole == (len(rows) == len({(r["dim"], r["cell"]) for r in rows}))
        for r in rows:
            found[r["dim"], r["cell"]] = found.get((r["dim"], r["cell"]), 0) + np.array([r["n"], *np.frombuffer(r["sums"], np.int64)])
        want: dict = {}
        for dim, cell, n, sums in parts:
            for c, k, v in zip(cell.tolist(), n, sums, strict=True):
                want[dim, c] = want.get((dim, c), 0) + np.array([k, *v])
        assert {k: v.tolist() for k, v in found.items()} == {k: v.tolist() for k, v in want.items()}
    assert list(op01_embeddings._added_up(iter(()), True)) == []


# archives


@given(st.binary(max_size=300), st.integers(4, 40))
@settings(max_examples=60, deadline=None)
def test_chunked_round_trip(payload, size):
    assert op02_warc.dechunked(op02_warc.chunked(payload, size)) == payload


def test_broken_chunks():
    with pytest.raises(ValueError):
        op02_warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_archives_round_trip(spark, tmp_path):
    long = "é<p>\r\n\r\n" * 300
    rows = [(1, "http://a/b c", long), (2, None, long), (5, "http://a", long), (3, "u", None), (4, "u", ""), (6, "u", "ab" * 400), (7, "u", "ab" * 400), (8, "u", "WARC/1.1\r\n\r\n" * 9), (9, "u", "x" * 1000 + "ü" * 90000), (9, "u", "x" * 1000 + "ü" * 90000), (None, "u", "n" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    op02_warc.write(pages, str(tmp_path / "w"), segment=1000)
    got = op02_warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["origin"].split(":")[2], []).append(r)
    text = {str(i): (h or "") for i, _, h in rows if i is not None} | {"": "n" * 1200}
    for page, found in by.items():
        payload = text[page].encode()
        for r in found:
            assert r["payload_bytes"] == len(payload) and r["digest"] == hashlib.sha1(payload).hexdigest()
            assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == payload
    assert [by[k][0]["record_type"] for k in "1 2 5 6 7".split()] == ["revisit", "revisit", "response", "response", "response"]
    assert by["1"][0]["refers_to"].split(":")[2] == "5" and len(by["9"]) == 2


def test_archives_keep_the_whole_url(spark, tmp_path):
    urls = ["http://a/ü€?q=1", "http://a/" + "x" * 6000, "http://a/b c", "", None]
    pages = spark.createDataFrame([(k, u, "y" * 3000 + str(k)) for k, u in enumerate(urls)] + [(9, urls[0], "y" * 3000 + "0")], "page_id long, url string, html string")
    op02_warc.write(pages, str(tmp_path / "w"), segment=2000)
    op02_warc.write(pages, str(tmp_path / "v"))
    for folder in "wv":
        got = {int(r["origin"].split(":")[2]): r["target_uri"] for r in op02_warc.read_archives(spark, str(tmp_path / folder)).collect()}
        assert got == {k: None if u is None else quote(u, safe="".join(map(chr, range(33, 127)))) for k, u in [*enumerate(urls), (9, urls[0])]}


def test_missing_segment(spark, tmp_path):
    parts = list(op02_warc.records("urn:page:1:x", "u", hashlib.sha1(b"y" * 500).hexdigest(), b"y" * 500, None, 200))
    (tmp_path / "a.warc").write_bytes(b"".join(p + op02_warc.END for p in parts[:1] + parts[2:]))
    with pytest.raises(Exception, match="segments"):
        op02_warc.read_archives(spark, str(tmp_path)).collect()


# decontamination


def brute_hits(text, items, window=10):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)})) if t else []
    words, hit, found = cut(text), set(), set()
    for i, t in items:
        w = cut(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[k : k + n]:
                    hit |= set(range(p, p + n))
                    if i is not None:
                        found.add(str(i))
    return len(words), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    words = [f"w{k % 17}É" if k % 3 else f"W{k}" for k in range(40)]
    items = [(1, " ".join(words[:14])), (1, "Short Item"), (2, "short, item"), (3, None), (4, ""), (None, " ".join(words[20:32])), (10, " ".join(words[5:15]))]
    docs = [(1, "x " + "--".join(words) + " y", 9), (2, "short item SHORT ITEM; short", 9), (3, None, 9), (4, "", 9), (5, "... !!", 9), (None, " ".join(words[:11]), 9), (6, "a " * 3000 + " ".join(words[4:17]), 9), (2, "short item SHORT ITEM; short", 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for shard in (op03_decontamination.SHARD_WORDS, 8):
        op03_decontamination.SHARD_WORDS, old = shard, op03_decontamination.SHARD_WORDS
        got = op03_decontamination.decontaminate(d, b).collect()
        op03_decontamination.SHARD_WORDS = old
        want = [(i, *brute_hits(t, items)) for i, t, _ in docs]
        key = lambda r: (str(r[0]), r[1])
        assert sorted(((r["doc_id"], r["n_words"], sum(h["to"] - h["since"] for h in r["hits"]), r["items"]) for r in got), key=key) == sorted(want, key=key)
    assert op03_decontamination.decontaminate(d, b.limit(0)).where("size(hits) > 0").count() == 0
    assert op03_decontamination.decontaminate(d.limit(0), b).count() == 0


def test_original_spans():
    text = "Ä one,  TWO"
    assert [text[a:b] for a, b in op03_decontamination.original_spans(text, [(0, 1), (1, 3)])] == ["Ä", "one,  TWO"]


# packing


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=40, deadline=None)
def test_plan_places_every_piece_once(lengths):
    histogram = {x: lengths.count(x) for x in lengths}
    for runs in (op04_packing.plan(histogram, 64, 4, 1 / 8), op04_packing.best_plan(histogram, 64)):
        seqs, ranks = {}, {}
        for length, first, n, sequence, offset in runs:
            for k in range(n):
                seqs.setdefault(sequence + k, []).append((offset, length))
                ranks.setdefault(length, []).append(first + k)
        assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in histogram.items()}
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64


def test_long_runs_of_blanks_fall_back():
    from tokenizers import Tokenizer

    text = "a" + " " * 600_000 + "\n \n" * 100_000 + "<|endoftext|>b"
    want = Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert op04_packing.token_ids(text, "byte_bpe_50k.json").tolist() == [*want, 2]


def test_grouping_comes_near_the_bound():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 1025, 20000), rng.integers(300, 700, 20000), np.minimum(1024, rng.geometric(0.004, 20000))):
        histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        used = max(first + n for _, _, n, first, _ in op04_packing.best_plan(histogram))
        bound = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
        assert used <= 1.03 * bound + 2


def test_packing_ids_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["", None, "Hello  world\n\n it's", "<|endoftext|> x", "é" * 3000, "a b " * 2000, "   \t", "日本語 12345 ٣", " " * 3000, "x" * 5000]
    df = spark.createDataFrame([(k if k else None, t, 1) for k, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, length int")
    got = op04_packing.pack(df).collect()
    for k, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == (k if k else None)})
        assert sum(x[2] for x in own) == len(ids) and own[0][2] == (len(ids) - 1) % 1024 + 1
        assert all(crc == zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, crc in own)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in s) <= 1024 and sorted(s)[0][0] == 0 for s in seqs.values())
    assert op04_packing.pack(df.limit(0)).count() == 0


# language


def test_language(spark):
    en, de = "the cat and the dog went home ", "der hund und die katze gehen nach hause "
    rows = [(k, (en if k % 2 else de) * (1 + k % 3), "en" if k % 2 else "de", "x") for k in range(40)] + [(90, None, "en", "x"), (91, "123 !!", "de", "x"), (92, "", None, "x"), (None, en, None, "x"), (93, en * 20000, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = op05_language.predict(df, op05_language.train(df)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == ("en" if k % 2 else "de") and 0.5 < by[k]["score"] <= 1 for k in range(40))
    assert [by[k]["lang_pred"] for k in (90, 91, 92, None, 93)] == ["und", "und", "und", "en", "en"]
    assert op05_language.predict(df, op05_language.train(df.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert op05_language.predict(df.limit(0), op05_language.train(df)).count() == 0


def test_more_languages_than_a_shard(spark):
    words = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}q" for k in range(150)]
    rows = [(k, f"{w} " * 30, f"l{k}") for k, w in enumerate(words)] + [(1000 + k, f"{words[0]} " * 30, "l0") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op05_language.train(df)
    assert len(model[0]) == 150
    got = op05_language.predict(df, model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got)


@pytest.mark.parametrize("text", ["Ein langer Text, mit Zeichen und 12 Zahlen  " * 50, "a", " .a", "123 456 " * 40 + "b c", "ab" * 60 + " ", "ΑΣ ΟΔΟΣ " * 30])
@pytest.mark.parametrize("piece", [1, 2, 3, 5, 97])
def test_grams_do_not_depend_on_pieces(text, piece, monkeypatch):
    whole = np.sort(np.concatenate(list(op05_language.grams(text))))
    monkeypatch.setattr(op05_language, "PIECE", piece)
    cut = np.sort(np.concatenate(list(op05_language.grams(text))))
    assert whole.tolist() == cut.tolist()


def brute_language(texts, langs_of, text):
    """Plain multinomial naive Bayes over the same n-grams, in exact counts."""
    import math
    from collections import Counter

    def counted(t):
        s = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        s = __import__("re").sub(" +", " ", s)
        return Counter(s[k : k + n] for n in range(1, 5) for k in range(len(s) - n + 1))

    langs = sorted(set(langs_of))
    sums = {x: sum((counted(t) for t, y in zip(texts, langs_of, strict=True) if y == x), Counter()) for x in langs}
    score = {x: math.log(langs_of.count(x) / len(langs_of)) + sum(n * math.log((sums[x][g] + 0.5) / (sum(sums[x].values()) + 0.5 * op05_language.BUCKETS)) for g, n in counted(text).items()) for x in langs}
    best = max(score.values())
    return max(score, key=score.get), 1 / sum(math.exp(s - best) for s in score.values())


def test_language_against_brute_force(spark, tmp_path):
    """The query on a small table: plain naive Bayes gives the same languages and, but for hash collisions, scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").limit(120).select("doc_id", "text", "lang").withColumn("text", F.substring("text", 1, 300)).toPandas()
    table = spark.createDataFrame([(int(r.doc_id), r.text, r.lang) for r in docs.itertuples()], "doc_id long, text string, lang string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op05_language.op5_language_id(spark, str(tmp_path)).collect()}
    held = {int(d): zlib.crc32(str(d).encode()) % 3 == 1 for d in docs.doc_id}
    known = [(t, x) for d, t, x in zip(docs.doc_id, docs.text, docs.lang, strict=True) if not held[int(d)] and isinstance(x, str)]
    right = 0
    for d, t, lang in zip(docs.doc_id, docs.text, docs.lang, strict=True):
        r = got[int(d)]
        assert r["held_out"] == held[int(d)]
        want = brute_language([k[0] for k in known], [k[1] for k in known], t)
        if any(c.isalpha() for c in t):
            assert r["lang_pred"] == want[0] and abs(r["score"] - want[1]) < 0.05
        right += held[int(d)] and r["lang_pred"] == lang
    assert right >= 0.9 * sum(held.values())


@pytest.mark.parametrize("strips", ["1", "7", "40"])
def test_embedding_links_across_strips(spark, strips):
    """Whatever the number of strips, pairs beside their edges meet: one pass over vectors that all lie along a line."""
    rng = np.random.default_rng(4)
    x = np.stack([np.cos(np.arange(300) * 0.3), np.sin(np.arange(300) * 0.3)], 1) @ rng.standard_normal((2, 8))
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", strips)
    try:
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op01_embeddings.near_duplicates(df, passes=3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    unit = op01_embeddings.unit(x)
    links = op01_embeddings.alike(unit, unit, op01_embeddings.COSINE)
    assert [got[k][0] for k in range(300)] == (links.sum(1) - 1).tolist()
    component = np.arange(300)
    for _ in range(300):
        component = np.where(links, component[None, :], 300).min(1)
    assert [got[k][1] for k in range(300)] == component.tolist()
