"""Personal data: fixed patterns, and a span classifier from weakly supervised labels.

DataFrame functions only. Four patterns give the base spans. Looser candidates (numbers and addresses
that no pattern takes) and the base spans then get votes from labelers: a regex labeler on the shape (stricter
than the base patterns), gazetteers of issuer prefixes, mail providers and reserved networks, and a context
labeler on the words before. Expectation-maximisation over the counts of vote patterns (at most 3^3 of them a kind)
estimates each labeler's reliability without true labels; its posteriors train a naive Bayes span
classifier over shape, length and context, which decides on the candidates.

The texts are scanned once; what goes on is spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, staged

KINDS = ("email", "ip", "card", "phone")
#: A match is tried from the start of a run only (or where the last match ended), and runs are taken
#: without giving back: the same matches as of the plain patterns, in time linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # candidates: grouped numbers, and addresses with an unusual sign or without a dot
    "number": r"(?<![0-9A-Za-z.])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])",
    "address": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
}
CUES = r"(?i)\b(phone|tel|telephone|call|mobile|fax|mail|e-mail|contact|reach|card|visa|account|iban|ssn|passport|address|telefon|anruf|konto|correo|tarjeta|carte|courriel)\b"
COUNTER_CUES = r"(?i)\b(isbn|order|version|page|figure|table|line|item|model|no|nr|release|chapter|doi|vol)\b\W*$"
# fixed values: issuers' first digits, mail providers, networks that no person has (IANA's special-purpose registry)
ISSUERS = r"^(4|5[0-8]|2[2-7]|3[0-9]|6)"
PROVIDERS = ("aol", "example", "fastmail", "free", "gmail", "gmx", "googlemail", "hotmail", "icloud", "laposte", "libero", "live", "mail", "me", "msn", "orange", "outlook", "proton", "protonmail", "qq", "t-online", "wanadoo", "web", "yahoo", "yandex", "zoho")
DOMAINS = rf"(?i)^({'|'.join(PROVIDERS)})[0-9]*(\.|\[dot\]| dot |$)"
RESERVED = r"^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
#: Probability from which a candidate becomes a span; hash buckets of the classifier's features.
SURE, BUCKETS = 0.95, 2048
_SPAN = "array<struct<start:int,end:int,match:string,before:string>>"


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def prefixes(values: Column, zero: Column, add) -> Column:
    """For each element what `add` makes of `zero` and all before it. An array grows by being copied, so they
    are gathered in blocks of the square root of their number, and a text of n spans takes n ** 1.5 steps."""
    kind = lambda out: F.array_remove(F.array(out), out)

    def all_before(block: Column, since: Column) -> Column:
        start = F.struct(since.alias("at"), kind(since).alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def scan(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(v) - 1, width), lambda k: F.slice(v, k + 1, width))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, all_before(F.transform(b, lambda one: F.aggregate(one, zero, add)), zero), all_before)))

    # blocks' sums are combined as elements are: `add` takes a value of its own kind too
    return _let(values, lambda v: F.when(F.size(v) > 0, scan(v)).otherwise(kind(zero)))


def matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost and without overlap: array of struct<start, end, match, before>; start and
    end (exclusive) in code points, before has the 24 characters ahead."""
    none = F.array().cast(_SPAN)

    def placed(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("match"))
        ahead = lambda p: prefixes(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["match"])), F.lit(0), lambda a, b: a + b)

        def span(x: Column, at: Column) -> Column:
            since = at + F.length(x["gap"])
            return F.struct(since.alias("start"), (since + F.length(x["match"])).alias("end"), x["match"].alias("match"), F.right(x["gap"], F.lit(24)).alias("before"))

        return _let(pairs, lambda p: F.zip_with(p, ahead(p), span))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda s, v: s + v) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    n = F.length(_digits(match))
    if kind == "card":
        return n.between(14, 19) & _luhn(_digits(match))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def spans(docs: DataFrame, passed: list[str], text: str = "text") -> DataFrame:
    """docs' columns `passed`, with base (array of struct<start, rank, end, kind, match, before>, by start,
    then kind) and loose (the candidates that touch no base span, in the same form)."""
    body = F.coalesce(F.col(text), F.lit(""))
    typed = lambda found, rank, kind: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["match"].alias("match"), m["before"].alias("before")))
    gate = {"email": F.contains(body, F.lit("@")), "phone": F.contains(body, F.lit("+"))}

    def of(kind: str, rank: int) -> Column:
        found = matches(body, PATTERNS[kind])
        if kind in gate:
            found = F.when(gate[kind], found).otherwise(F.array().cast(_SPAN))
        return typed(F.filter(found, lambda m: _valid(kind, m["match"])), rank, kind)

    base = [of(kind, rank) for rank, kind in enumerate(KINDS)]
    signs = F.contains(body, F.lit("@")) | F.contains(body, F.lit("at]")) | F.contains(body, F.lit("at)"))
    loose = [typed(matches(body, PATTERNS["number"]), 4, "number"), typed(F.when(signs, matches(body, PATTERNS["address"])).otherwise(F.array().cast(_SPAN)), 5, "address")]
    kept = [F.col(c) for c in passed]
    out = docs.select(F.struct(*kept).alias("row"), F.array_sort(F.concat(*base)).alias("base"), F.concat(*loose).alias("loose"))
    return out.select("row", "base", F.when(F.size("loose") > 0, free(F.array_sort(F.concat("base", "loose")))).otherwise(F.col("loose")).alias("loose"))


def free(found: Column) -> Column:
    """Of spans in order those of no base kind that touch none of a base kind: the base spans before end
    before them, and the next one begins behind them."""
    base = lambda c: c["rank"] < len(KINDS)
    most = F.lit(2**31 - 1)
    before = lambda a: prefixes(F.transform(a, lambda c: F.when(base(c), c["end"]).otherwise(0)), F.lit(0), lambda x, y: F.greatest(x, y))
    behind = lambda a: F.reverse(prefixes(F.transform(F.reverse(a), lambda c: F.when(base(c), c["start"]).otherwise(most)), most, lambda x, y: F.least(x, y)))
    each = lambda a: F.arrays_zip(a.alias("c"), before(a).alias("before"), behind(a).alias("behind"))
    kept = lambda a: F.filter(each(a), lambda x: ~base(x["c"]) & (x["before"] <= x["c"]["start"]) & (x["behind"] >= x["c"]["end"]))
    return _let(found, lambda a: F.transform(kept(a), lambda x: x["c"]))


def _votes(c: Column) -> list[Column]:
    """1 personal, 0 not, -1 no opinion: of the regex, gazetteer and context labelers."""
    digits = _digits(c["match"])
    n, kind, match = F.length(digits), c["kind"], c["match"]
    vote = lambda sure, not_: F.when(sure, 1).when(not_, 0).otherwise(-1)
    shape = (
        F.when(kind == "email", vote(match.rlike(r"^[A-Za-z0-9][^@]*@.+\.[A-Za-z]{2,24}$"), match.rlike("^[._%+-]*@|@-|-$")))
        .when(kind == "ip", vote(match.rlike("[0-9]{2}"), match.rlike(r"(^|\.)0[0-9]")))
        .when(kind == "card", vote(match.rlike("^([0-9]{4}[ -]){3}[0-9]{2,7}$|^[0-9]+$"), F.lit(False)))
        .when(kind == "phone", vote(match.rlike(r"^\+[1-9]"), match.rlike(r"^\+0")))
        .when(kind == "address", vote(F.contains(match, F.lit(".")) | match.rlike("dot"), F.lit(True)))
        .otherwise(vote(match.rlike(r"^\(?[0-9]{3}[) .-]{1,2}[0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), match.rlike("^[0-9]+$")))
    )
    host = F.regexp_extract(match, r"(?:@|at[\])] ?)(.*)$", 1)
    listed = (
        F.when(kind == "ip", vote(F.lit(False), match.rlike(RESERVED)))
        .when(kind.isin("email", "address"), vote(host.rlike(DOMAINS), F.lit(False)))
        .when(n.between(14, 19), vote(digits.rlike(ISSUERS) & _luhn(digits), F.lit(True)))
        .otherwise(-1)
    )
    context = F.when(c["before"].rlike(CUES), 1).when(c["before"].rlike(COUNTER_CUES), 0).otherwise(-1)
    return [shape, listed, context]


def _features(c: Column) -> Column:
    """The classifier's features of a span, as hash buckets."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c["match"], "[0-9]", "9"), "[A-Za-z]+", "a"), "9{5,}", "9+"), "(?:a[._%+-]?)++", "a")
    told = F.array(
        F.concat(F.lit("shape:"), F.left(shape, F.lit(24))),
        F.concat(F.lit("digits:"), F.least(F.length(_digits(c["match"])), F.lit(20)).cast("string")),
        F.concat(F.lit("cue:"), F.lower(F.regexp_extract(c["before"], CUES, 1))),
        F.concat(F.lit("counter:"), c["before"].rlike(COUNTER_CUES).cast("string")),
        F.concat(F.lit("luhn:"), (F.length(_digits(c["match"])).between(14, 19) & _luhn(_digits(c["match"]))).cast("string")),
    )
    return F.transform(told, lambda f: F.pmod(F.xxhash64(f), F.lit(BUCKETS)).cast("int"))


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(share of personal spans, per labeler {vote: (P(vote | personal), P(vote | not))}) by
    expectation-maximisation over the counts of vote patterns. Labelers start as mostly right."""
    width = len(next(iter(counts))) if counts else 0
    prior, tables = 0.5, [{1: (0.6, 0.1), 0: (0.1, 0.6), -1: (0.3, 0.3)} for _ in range(width)]
    for _ in range(rounds):
        yes = dict.fromkeys(counts, 0.0)
        for votes in counts:
            p, q = prior, 1 - prior
            for t, v in zip(tables, votes, strict=True):
                p, q = p * t[v][0], q * t[v][1]
            yes[votes] = p / (p + q)
        total = sum(counts.values())
        ones = sum(yes[v] * n for v, n in counts.items())
        prior = (ones + 1) / (total + 2)
        for k in range(width):
            for vote in (1, 0, -1):
                a = sum(yes[v] * n for v, n in counts.items() if v[k] == vote)
                b = sum((1 - yes[v]) * n for v, n in counts.items() if v[k] == vote)
                tables[k][vote] = ((a + 1) / (ones + 3), (b + 1) / (total - ones + 3))
    return prior, tables


def _map(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.lit(None).cast("map<string,double>")


def find(docs: DataFrame, passed: list[str], text: str = "text") -> DataFrame:
    """docs' columns `passed`, with base and spans (array of struct<start, rank, end, kind>): all spans by
    start, then kind. Null and empty texts have none; a text of n matches takes n ** 1.5 steps; repeated rows give repeated rows; an empty table
    gives none; columns named base or spans give way."""
    passed = [c for c in passed if c not in ("base", "spans")]
    found = staged(spans(docs, passed, text), "spans")
    each = found.select(F.explode(F.concat("base", "loose")).alias("c"))
    voted = each.select("c", F.array(*_votes(F.col("c"))).alias("votes"))
    counts = {tuple(r["votes"]): r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3^3 rows
    if counts:
        prior, tables = reliabilities(counts)
        posterior = {}
        for votes in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, votes, strict=True))
            posterior[",".join(map(str, votes))] = 1 / (1 + math.exp(-odds))
        p = F.element_at(_map(posterior), F.array_join(F.col("votes").cast("array<string>"), ","))
        weighed = voted.select(p.alias("p"), F.explode(F.array_distinct(_features(F.col("c")))).alias("bucket"))
        table = weighed.groupBy("bucket").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # at most BUCKETS rows
        yes = sum(posterior[",".join(map(str, v))] * n for v, n in counts.items())
        no = sum(counts.values()) - yes
        bias = math.log((yes + 1) / (no + 1))
        odds = [0.0] * BUCKETS
        for r in table:
            odds[r["bucket"]] = math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1))
        weights = F.array(*map(F.lit, odds))
        score = lambda c: F.aggregate(F.array_distinct(_features(c)), F.lit(bias), lambda s, f: s + weights[f])
        sure = math.log(SURE / (1 - SURE))
        # a labeler at least must have spoken for it: the classifier alone doesn't open new ground
        added = F.filter("loose", lambda c: (score(c) >= sure) & (F.greatest(*_votes(c)) == 1))
    else:
        added = F.filter("loose", lambda c: F.lit(False))
    bare = lambda a: F.transform(a, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    return found.select("row.*", bare(F.col("base")).alias("base"), F.array_sort(bare(F.concat(F.col("base"), added))).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of a block of text from which pieces are cut: a place in a string is found by counting to it.
PIECE = 4096


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in square brackets; of overlapping spans the later
    one only adds what it reaches beyond."""

    def cut(blocks: Column, since: Column, to: Column) -> Column:
        first = F.floor(since / PIECE).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, F.floor((to - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(to > since, F.substring(held, since - first * PIECE + 1, to - since)).otherwise("")

    def piece(blocks: Column):
        def of(s: Column, at: Column) -> Column:
            return F.when(s["end"] > at, F.concat(cut(blocks, at, F.greatest(at, s["start"])), F.lit("["), s["kind"], F.lit("]"))).otherwise("")

        return of

    def joined(blocks: Column) -> Column:
        last = F.aggregate(found, F.lit(0), lambda m, s: F.greatest(m, s["end"]))
        at = prefixes(F.transform(found, lambda s: s["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
        return F.concat(F.array_join(F.zip_with(found, at, piece(blocks)), ""), cut(blocks, last, F.length(text)))

    return F.when(text.isNotNull(), _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), joined))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(n(k).alias(f"n_{k}") for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
