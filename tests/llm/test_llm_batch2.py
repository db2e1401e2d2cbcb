"""Small cases for personal data, near-duplicates, passages, toxicity, URL filter and the pipeline."""

import hashlib
import os
import re

import numpy as np
import pytest

from tessella.llm import op06_pii, op07_order_minhash, op08_passages, op09_toxicity, op10_url_filter
from tessella.llm import common
from tessella.llm.common import bucket_links, connected_components
from tessella.llm.words import labelled, shingles, word_hashes

SF = "/root/testdata/sf0.001"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}.get(kind, lambda: True)():  # noqa: B023
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


PII_TEXTS = [
    "mail a.b@c-d.example.com, é then x@y and z@1.2.3.4.", "a@b.c_d@e.f.g @h.i", ".@x.y a@b.c.@x.y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (234) 567-8901 +12 +123456789012345678 ++1 2345678901", None, "", "+", "5" * 3000, "1.1.1.1" * 500, "a" * 5000 + "@" + "b." * 3000 + "c", "x@y.z" * 300, "éü 1.2.3.4 ñ +49 30 1234567 4111111111111111", "call me at 555-123-4567 or bob [at] example [dot] com",
]


def test_pii_base_against_plain_patterns(spark):
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(PII_TEXTS)] + [(1, PII_TEXTS[1], 5), (None, PII_TEXTS[0], 5)], "doc_id long, text string, base int")
    found = op06_pii.find(df, ["doc_id"])
    got = found.select("doc_id", op06_pii.listed(found["base"]).alias("base"), op06_pii.listed(found["spans"]).alias("spans")).collect()
    assert len(got) == len(PII_TEXTS) + 2
    for r in got:
        want = brute_spans(PII_TEXTS[r["doc_id"] if r["doc_id"] is not None else 0])
        assert r["base"] == ",".join(want)
        assert set(want) - {""} <= set(r["spans"].split(","))
    assert op06_pii.find(df.limit(0), ["doc_id"]).count() == 0


def test_pii_redaction(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(PII_TEXTS)], "doc_id long, text string")
    found = op06_pii.find(df, ["doc_id", "text"])
    for r in found.select("doc_id", "text", op06_pii.redacted(found["text"], found["base"]).alias("out")).collect():
        text, out, at = r["text"], "", 0
        for s in brute_spans(text):
            kind, a, b = s.split(":")
            if int(b) > at:
                out, at = out + text[at : max(at, int(a))] + f"[{kind}]", int(b)
        assert r["out"] == (None if text is None else out + text[at:])


def test_pii_long_texts_and_loose_spans(spark):
    """Loose spans that labelers agree on are added wherever no base span stands; long texts take seconds."""
    import time

    long = " ".join(f"a{k}@x{k}.org 4{k:09d}" for k in range(6000))
    rows = [(k, f"{' '.join(prose(k, 20))} call me at 555-{k:03d}-{4000 + k} or mail p{k}@gmail.com please") for k in range(200)]
    rows += [(1000 + k, f"{' '.join(prose(k, 20))} order no {k:09d} of the year {k}") for k in range(200)] + [(5000, long)]
    began = time.time()
    found = op06_pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"])
    got = {r["doc_id"]: r for r in found.select("doc_id", op06_pii.listed(found["spans"]).alias("spans"), op06_pii.redacted(found["text"], found["spans"]).alias("out")).collect()}
    assert time.time() - began < 60
    texts = dict(rows)
    for k in range(200):
        at = texts[k].index("555-")
        assert f"number:{at}:{at + 12}" in got[k]["spans"] and got[1000 + k]["spans"] == ""
        assert got[k]["out"].endswith("call me at [number] or mail [email] please")
    assert [x for x in got[5000]["spans"].split(",") if x.startswith("email")] == brute_spans(long)


def test_prefixes(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 3, 10, 97, 100):
        v = [(7 * k) % 13 for k in range(n)]
        df = spark.createDataFrame([(v,)], "v array<int>")
        total, most = df.select(op06_pii.prefixes(F.col("v"), F.lit(0), lambda a, b: a + b), op06_pii.prefixes(F.col("v"), F.lit(0), lambda a, b: F.greatest(a, b))).first()
        assert total == [sum(v[:k]) for k in range(n)] and most == [max([0, *v[:k]]) for k in range(n)]


def test_reliabilities_find_the_better_labeler():
    rng = np.random.default_rng(3)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple(int(y if rng.random() < p else not y) for p in (0.95, 0.9, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    prior, tables = op06_pii.reliabilities(counts)
    assert abs(prior - 0.4) < 0.06 and tables[0][1][0] > tables[2][1][0] and tables[0][1][0] > 0.88


# near-duplicates


def plain_similarity(a, b):
    from difflib import SequenceMatcher

    n = sum(m.size for m in SequenceMatcher(None, list(a), list(b), autojunk=False).get_matching_blocks())
    return n / (len(a) + len(b) - n)


def test_near_duplicates(spark):
    a, b = prose(1, 300), prose(2, 200)
    near = a[:150] + ["changed"] + a[151:]
    far = a[:100] + prose(9, 100) + a[200:]
    texts = [(1, " ".join(a)), (2, " ".join(a).upper()), (3, " ".join(near)), (4, " ".join(b)), (5, " ".join(far)), (6, None), (7, ""), (8, " ,. "), (9, "one two"), (10, "One, two!"), (None, " ".join(a)), (4, " ".join(b))]
    texts += [(100 + k, " ".join([*a[:k], f"x{k}", *a[k + 1 :]])) for k in range(60)]
    df = spark.createDataFrame([(*t, 3) for t in texts], "doc_id long, text string, class int").select("doc_id", "text")
    got = op07_order_minhash.near_duplicates(df).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["component_id"] == 1 for k in (1, 2, 3, *range(100, 160))) and by[1]["kept"] and not by[2]["kept"]
    assert all(by[k]["component_id"] == k and by[k]["kept"] for k in (4, 5, 6, 7, 8, 9)) and by[10]["component_id"] == 9
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert op07_order_minhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    a = prose(seed, 120)
    b = list(a)
    for k in rng.integers(0, len(b), seed * 2):
        b[k] = "z"
    x, y = (labelled(shingles(word_hashes(" ".join(t)), 5)) for t in (a, b))
    want = plain_similarity(x, y)
    got = op07_order_minhash.similarity(x, y)
    assert (got >= 0.8) == (want >= 0.8) and (got == 0 or abs(got - want) < 0.03)


def plain_common(a, b):
    """Longest common subsequence by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("seed", range(40))
def test_words_are_aligned_as_by_the_table(seed):
    rng = np.random.default_rng(seed)
    kinds = int(rng.choice([3, 30, 3000]))
    a = rng.integers(0, kinds, int(rng.integers(1, 260))).tolist()
    b = list(a)
    for _ in range(int(len(a) * rng.uniform(0, 0.25))):
        at, what = int(rng.integers(0, len(b) + 1)), int(rng.integers(0, 3))
        b[at : at + (what > 0)] = [] if what == 2 else [int(rng.integers(0, kinds))]
    n = plain_common(a, b)
    want = n / (len(a) + len(b) - n)
    got = op07_order_minhash.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
    assert (got >= 0.8) == (want >= 0.8) and got <= want + 1e-9
    assert op07_order_minhash.aligned(np.array(a), np.array(b), max(len(a), len(b)), 0) == n


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_near_duplicates_against_all_pairs(spark, sf):
    """Every pair of texts of 20 words and more that is alike by the plain table ends in one component, and every
    component hangs together by such pairs."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    words = {r["doc_id"]: word_hashes(r["text"] or "").tolist() for r in docs.collect()}
    got = {r["doc_id"]: r["component_id"] for r in op07_order_minhash.near_duplicates(docs).collect()}
    ids = sorted(words)
    counts = {k: np.bincount(np.array(words[k], np.uint64) % np.uint64(1024), minlength=1024) if words[k] else np.zeros(1024, int) for k in ids}
    table = np.array([counts[k] for k in ids])
    size, parent = table.sum(1), {k: k for k in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r, a in enumerate(ids):
        both = np.minimum(table[r], table[r + 1 :]).sum(1)
        for q in np.flatnonzero((both > 0) & (both >= 0.8 * (size[r] + size[r + 1 :] - both))):
            b = ids[r + 1 + q]
            alike = words[a] == words[b] or op07_order_minhash.aligned(np.array(words[a]), np.array(words[b]), max(len(words[a]), len(words[b])), 0) * 1.8 >= 0.8 * (len(words[a]) + len(words[b]))
            if alike:
                parent[max(root(a), root(b))] = min(root(a), root(b))
                assert min(len(words[a]), len(words[b])) < 20 or got[a] == got[b]
    assert all(root(k) == root(got[k]) for k in ids)


def test_near_duplicates_by_edits(spark):
    """Nine words of ten in order are alike, wherever the others are; the same words in another order aren't."""
    base = prose(5, 400)
    changed = [f"y{k}" if k % 11 == 5 else w for k, w in enumerate(base)]
    cut = [w for k, w in enumerate(base) if k % 12 != 7]
    turned = base[200:] + base[:200]
    long = prose(6, 60_000)
    texts = [(1, base), (2, changed), (3, cut), (4, turned), (5, long), (6, [w for k, w in enumerate(long) if k % 50])]
    df = spark.createDataFrame([(k, " ".join(t), 1, 2) for k, t in texts], "doc_id long, text string, class int, rep int")
    got = {r["doc_id"]: r["component_id"] for r in op07_order_minhash.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_outlines_let_all_alike_through():
    rng = np.random.default_rng(1)
    for seed in range(60):
        a = word_hashes(" ".join(prose(seed, 60)))
        b = np.delete(a, rng.integers(0, len(a), seed % 14))
        if op07_order_minhash.similarity(a, b) >= 0.8:
            assert op07_order_minhash.may_be_alike(op07_order_minhash.outline(a), np.array([op07_order_minhash.outline(b)]))[0]


def test_bucket_links_connect_what_hangs_together(spark):
    # one bucket of many, in which each is like its neighbours only: no leader is like all
    rows = [(k, [7, 100 + k // 40]) for k in range(400)]
    reps = spark.createDataFrame(rows, "rep long, sketches array<long>")
    runs = lambda ids: ids.selectExpr("rep", "unhex(lpad(hex(rep), 16, '0')) as runs")
    value = lambda x: int.from_bytes(x.tobytes(), "big")
    links = bucket_links(reps, runs, lambda x, y: abs(value(x) - value(y)) <= 1, agree=1)
    found = connected_components(links).collect()
    assert len(found) == 400 and {r["component"] for r in found} == {0}
    assert links.count() < 2000


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100}


# passages


def sentences(seed, n):
    w = prose(seed, n * 9)
    return " ".join(" ".join(w[k : k + 9]).capitalize() + "." for k in range(0, len(w), 9))


def test_passages(spark):
    shared = sentences(50, 7)
    docs = [(k, sentences(k, 12) + (f" {shared} " if k % 3 == 0 else " ") + sentences(100 + k, 5) + "\nA short licence line here.") for k in range(30)]
    docs += [(200, None), (201, ""), (202, "Tiny."), (None, shared), (3, docs[3][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int").select("doc_id", "text")
    got = op08_passages.repeated_passages(df).collect()
    assert sorted({r["doc_id"] for r in got}) == [k for k in range(30) if k % 3 == 0]
    texts = dict(docs)
    for r in got:
        assert shared[:40] in texts[r["doc_id"]][r["start"] : r["end"]] and r["kept"] == (r["doc_id"] == 0)
    assert op08_passages.repeated_passages(df.limit(0)).count() == 0


def test_passages_cut_anywhere(spark):
    """Runs of 50 words that start and end within a sentence, or have no sentence marks around them."""
    marked = prose(50, 27)  # parts of two sentences
    shared = " ".join(marked) + ". " + " ".join(prose(51, 23))
    plain = " ".join(prose(52, 50))
    around = lambda k: (" ".join(prose(1000 + k, 30)), " ".join(prose(2000 + k, 30)))
    docs = [(k, f" {shared if k < 3 else plain} ".join(around(k)) + ("." if k < 3 else "")) for k in range(6)] + [(9, " ".join(prose(60, 200)))]
    got = op08_passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2, 3, 4, 5]
    texts = dict(docs)
    for r in got:
        assert texts[r["doc_id"]][r["start"] : r["end"]] == (shared if r["doc_id"] < 3 else plain)
        assert r["n_words"] == 50 and r["kept"] == (r["doc_id"] in (0, 3)) and r["removed_words"] == (0 if r["kept"] else 50)


@pytest.mark.parametrize("sf", [SF])
def test_passages_against_brute_force(spark, sf):
    """All documents that share a run of 50 words with another one, and none that doesn't come near."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = {r["doc_id"]: r["text"] for r in table.collect()}
    words = {d: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)})) for d, t in docs.items()}
    owners, shingle = {}, {}
    for d, w in words.items():
        shingle[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for k in range(len(w) - 49):
            owners.setdefault(tuple(w[k : k + 50]), set()).add(d)
    want = {d for o in owners.values() if len(o) > 1 for d in o}
    got = op08_passages.repeated_passages(table).collect()
    found = {r["doc_id"] for r in got}
    assert want <= found
    for r in got:
        own = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", docs[r["doc_id"]][r["start"] : r["end"]].translate({c: c + 32 for c in range(65, 91)}))
        assert len(own) >= 50
        mine = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        # an edited passage shares most of its shingles with one other document
        assert r["doc_id"] in want or max(len(mine & s) for d, s in shingle.items() if d != r["doc_id"]) >= 0.6 * len(mine)


def test_passages_clashing_columns(spark):
    shared = " ".join(prose(70, 60))
    df = spark.createDataFrame([(k, f"{' '.join(prose(k, 30))} {shared} x", 1, 2, 3) for k in range(3)], "doc_id long, text string, start int, content int, sketches int")
    assert {r["doc_id"] for r in op08_passages.repeated_passages(df).collect()} == {0, 1, 2}


def test_passages_of_repeated_words(spark):
    """Ties: every run of a text of one word is equal; a text of any length is one row."""
    df = spark.createDataFrame([(0, "a " * 300), (1, "b a " * 2 + "a " * 60), (2, "c " * 200), (3, "d " * 49), (4, "d " * 49)], "doc_id long, text string")
    assert {r["doc_id"] for r in op08_passages.repeated_passages(df).collect()} == {0, 1}


def test_bands():
    assert op08_passages.tuned(0.8, 0.95, 1) == 2 and op08_passages.tuned(0.5, 0.95, 2) == 11


def test_bands_meet_all_but_one_pair_in_a_thousand():
    assert (1 - op08_passages.SIMILARITY) ** op08_passages.tuned() <= 0.001


# toxicity


def test_toxicity(spark):
    bad = ["vile", "awful", "horrid"]
    rows, labels = [], []
    for k in range(300):
        w = prose(1000 + k, 80)
        toxic = k % 4 == 0
        if toxic:
            w[10 : 10 + 1 + k % 3] = [bad[(k + j) % 3] for j in range(1 + k % 3)]
        rows.append((k, " ".join(w), "x"))
        labels.append((k, 1, int(toxic)))
    labels += [(0, 1, 1), (5, 1, None), (None, 1, 1)]
    rows += [(900, None, "x"), (901, "", "x"), (902, "vile awful horrid", "x"), (None, "plain words", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = op09_toxicity.rate(d, op09_toxicity.train(d, lab)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["toxic"] == (k % 4 == 0) for k in range(300))
    assert not by[900]["toxic"] and by[900]["severity"] == 0 and not by[901]["toxic"] and by[902]["toxic"] and not by[None]["toxic"]
    assert op09_toxicity.rate(d, op09_toxicity.train(d, lab.limit(0))).where("toxic").count() == 0
    assert op09_toxicity.rate(d.limit(0), op09_toxicity.train(d.limit(0), lab)).count() == 0


def test_ordinal_thresholds_stay_in_order():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 400)
    x = [np.array([g]) for g in grade]
    w, cut = op09_toxicity.fit(x, grade, 4, 4)
    assert (np.diff(cut) > 0).all() and (np.diff(w) > 0).all()


# URL filter


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/a?x=1"), (2, "http://example.com/en/a"), (3, "https://example.com"), (4, "https://a.b.net/es/1#f"), (5, "https://net/fr/"), (6, "ftp://x.org/en"), (7, None), (8, "no scheme"), (9, "http://badexample.com/en/"), (10, "http://example.com?q=/en/"), (11, "http://"), (2, "http://example.com/en/a")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in op10_url_filter.judge(df).collect()}
    want = {1: ("www.example.com", "/en/a", "www.example.com/en/"), 2: ("example.com", "/en/a", "example.com/en/"), 3: ("example.com", "", None), 4: ("a.b.net", "/es/1", "net/es/"), 5: ("net", "/fr/", "net/fr/"), 6: ("x.org", "/en", None), 7: ("", "", None), 8: ("", "", None), 9: ("badexample.com", "/en/", "com/"), 10: ("example.com", "", None), 11: ("", "", None)}
    assert {k: (r["host"], r["path"], r["rule"]) for k, r in got.items()} == want
    assert [got[k]["verdict"] for k in (1, 2, 4, 5, 9)] == ["allow", "block", "block", "block", "allow"]
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert op10_url_filter.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in op10_url_filter.judge(df.where("page_id in (6, 7)")).collect()} == {"allow"}


# pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entropy_of_any_length(spark):
    rows = [("http://h/" + "ab" * 5000, "h", "/"), ("aab", "", ""), ("é\U0001f600" * 3000 + "$.", "", ""), ("", "", "")]
    got = [r["entropy"] for r in op10_url_filter.lexical(spark.createDataFrame(rows, "url string, host string, path string").coalesce(1)).collect()]
    for (u, _, _), e in zip(rows, got, strict=True):
        p = np.array([u.count(c) / len(u) for c in set(u)] or [1.0])
        assert abs(e + (p * np.log2(p)).sum()) < 1e-9


def test_every_suffix_has_its_rate(spark):
    rows = [(f"u{k}-{j}", f"h.s{k}", float(k % 2)) for k in range(1500) for j in range(5)]
    urls = spark.createDataFrame(rows, "url string, host string, label double")
    got = {(r["suffix"], r["fold"]): r["suffix_rate"] for r in op10_url_filter.suffix_rates(urls, 0.5).collect()}
    assert {k: v for (k, fold), v in got.items() if fold == -1} == {f"s{k}": 0.75 if k % 2 else 0.25 for k in range(1500)}
    fold = {r["url"]: r["fold"] for r in urls.select("url", op10_url_filter.fold_of(urls["url"]).alias("fold")).collect()}
    for k in (0, 1, 7):
        for f in range(op10_url_filter.FOLDS):
            own = [x for u, _, x in rows[5 * k : 5 * k + 5] if fold[u] != f]
            assert got[f"s{k}", f] == (sum(own) + 2.5) / (len(own) + 5)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        out = out.cache()
        assert set(r[0] for r in out.select("doc_id").collect()) <= set(r[0] for r in seen.select("doc_id").collect())
        assert out.count() == seen.count() if name == "pii" else out.count() <= seen.count()
        seen = out
    packed = p.STAGES[-1][1](spark, seen, SF)
    assert packed.select("doc_id").distinct().count() == seen.select("doc_id").distinct().count()
    assert hashlib.sha1(b"").hexdigest()


@pytest.mark.parametrize("at_once", [500, 100_000])
def test_components_leave_no_shuffle_files(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "AT_ONCE", at_once)  # by rounds, and in one stretch
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    rows = [(k, k + 1) for k in range(3000)] + [(f"{k:05}", f"{k + 1:05}") for k in range(5000, 5300)]
    e = spark.createDataFrame([(f"{a:05}" if isinstance(a, int) else a, f"{b:05}" if isinstance(b, int) else b) for a, b in rows], "a string, b string").repartition(8)
    before = files()
    found = connected_components(e)
    assert files() - before <= 20  # each round left some before
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {**{f"{k:05}": "00000" for k in range(3001)}, **{f"{k:05}": "05000" for k in range(5000, 5301)}}


def test_outlines_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 63, 20, np.uint64) * np.uint64(2) for _ in range(40)]
    texts = [np.unique(x) for b in base for x in (b, np.append(b[2:], rng.integers(0, 1 << 63, 2, np.uint64)))]
    shapes = common.outlines(texts)
    may = np.array([common.may_be_alike(s, shapes, 0.8) for s in shapes])
    alike = np.array([[op08_passages.jaccard(set(x.tolist()), set(y.tolist())) >= 0.8 for y in texts] for x in texts])
    assert alike.sum() > 80 and (may | ~alike).all() and may.sum() < 400  # 6,400 pairs
    assert common.outlines([]).shape == (0, 64)
    # one bucket, small blocks: the same components with and without the outlines
    reps = spark.createDataFrame([(k, [1, 2]) for k in range(len(texts))], "rep long, sketches array<long>")
    runs = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(texts)], "rep long, runs binary")
    same = lambda x, y: op08_passages.jaccard(x, y) >= 0.8
    got = [{r["node"]: r["component"] for r in connected_components(bucket_links(reps, lambda ids: runs.join(ids, "rep"), same, 1, lambda x: set(x.tolist()), **more)).collect()} for more in ({}, {"least": 0.8})]
    assert got[0] == got[1] and len(got[0]) == 80 and len(set(got[0].values())) == 40
