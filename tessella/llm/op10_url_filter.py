"""URL filter: rules first, gradient-boosted trees on lexical features for what no rule fits.

DataFrame functions only. The trees (Spark ML's) are trained on URLs that rules label, a bounded
sample of them; the features say nothing of the host's or path's exact words, so what the trees learn
carries over to other hosts: lengths, depth, digit and letter shares, entropy, counts of parameters,
separators and labels, and per suffix how often the rules block a URL of it, over all URLs that they label
(for a URL in training, over those of the other FOLDS - 1 folds: a rate doesn't know the label it predicts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, staged

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: URLs in the training sample at most, in expectation; trees and their depth.
SAMPLE, TREES, DEPTH, FOLDS = 50_000, 20, 4, 5
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digit_share", "letter_share", "hyphens", "dots", "entropy", "parameters", "query_length", "has_fragment", "is_https", "ends_in_slash", "has_extension", "suffix_rate"]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first :// up to / ? # or the end, A-Z lower-cased; the path from
    there up to ? # or the end. Null urls and those without :// have both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, or null. A rule fits its host
    and all its subdomains where the path starts with the rule's. Ties go to the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """df (with host and path) and its features but suffix_rate, and suffix."""
    u = F.coalesce(F.col(url), F.lit(""))
    kept = lambda c, pattern: F.length(F.regexp_replace(c, pattern, ""))
    n = F.greatest(F.length(u), F.lit(1))
    # a character's count is what the text loses without it: linear in the text for each distinct one
    each = F.transform(F.array_distinct(F.split(u, "")), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return df.withColumns({
        "url_length": F.length(u), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": kept(F.col("path"), "[^/]"), "labels": kept(F.col("host"), "[^.]") + 1,
        "digit_share": kept(u, "[^0-9]") / n, "host_digit_share": kept(F.col("host"), "[^0-9]") / F.greatest(F.length("host"), F.lit(1)),
        "letter_share": kept(u, "[^A-Za-z]") / n, "hyphens": kept(u, "[^-]"), "dots": kept(u, "[^.]"),
        "entropy": -F.aggregate(F.when(u == "", F.array(F.lit(1.0))).otherwise(each), F.lit(0.0), lambda s, p: s + p * F.log2(p)),
        "parameters": F.when(query == "", 0).otherwise(kept(query, "[^&;]") + 1), "query_length": F.length(query),
        "has_fragment": F.contains(u, F.lit("#")).cast("int"), "is_https": F.startswith(F.lower(u), F.lit("https:")).cast("int"),
        "ends_in_slash": F.endswith(F.col("path"), F.lit("/")).cast("int"), "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
        "suffix": F.substring_index("host", ".", -1),
    })


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(3)), F.lit(FOLDS)).cast("int")


def suffix_rates(urls: DataFrame, mean: float) -> DataFrame:
    """(suffix, fold, suffix_rate) of all suffixes of labelled URLs (url, host, label), drawn to the mean by five
    URLs: of fold -1 over all of them, of the others over the URLs outside that fold."""
    suffix = F.substring_index("host", ".", -1).alias("suffix")
    each = urls.groupBy(suffix, fold_of(F.col("url")).alias("of")).agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    folds = F.explode(F.array(*(F.lit(k) for k in range(-1, FOLDS)))).alias("fold")
    beside = each.select("*", folds).groupBy("suffix", "fold").agg(F.sum(F.when(F.col("of") != F.col("fold"), F.col("bad")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("of") != F.col("fold"), F.col("n")).otherwise(0)).alias("n"))
    return beside.select("suffix", "fold", ((F.col("bad") + 5 * mean) / (F.col("n") + 5)).alias("suffix_rate"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """pages with host, path, rule, p_block and verdict.

    Every row gets a verdict: its rule's, else block where the trees give over 0.5. Where rules label no
    URL, or all alike, the verdict of the rest is allow or that label. Columns of pages named as a new
    one give way; null urls are judged by their features (all 0). p_block is null where a rule decides.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    new = ["host", "path", "rule", "p_block", "verdict"]
    kept = [c for c in pages.columns if c not in new]
    host, path = parts(F.col(url))
    rows = pages.select(F.struct(*kept).alias("row"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    # an url that many rows share counts once
    urls = rows.where("fit is not null").select("url", "host", "path", (F.col("fit.verdict") == "block").cast("double").alias("label")).distinct()
    totals = {r["label"]: r["n"] for r in urls.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        only = F.lit("block" if 1.0 in totals else "allow")
        return rows.select("row.*", "host", "path", "fit.rule", F.lit(None).cast("double").alias("p_block"), F.coalesce("fit.verdict", only).alias("verdict"))
    share = min(1.0, sample / sum(totals.values()))
    train = staged(lexical(urls.where(F.pmod(F.xxhash64("url"), F.lit(1_000_003)) < share * 1_000_003)), "urls")
    mean = totals[1.0] / sum(totals.values())
    rates = staged(suffix_rates(urls, mean), "rates")
    rated = lambda df, fold: df.withColumn("fold", fold).join(rates, ["suffix", "fold"], "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(mean)))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, checkpointInterval=-1, cacheNodeIds=False, maxMemoryInMB=128)
    model = gbt.fit(assembler.transform(rated(train, fold_of(F.col("url")))).select("features", "label"))
    scored = model.transform(assembler.transform(rated(lexical(rows), F.lit(-1))))
    p = F.when(F.col("fit").isNull(), vector_to_array("probability")[1])
    return scored.select("row.*", "host", "path", "fit.rule", p.alias("p_block"), F.coalesce("fit.verdict", F.when(p > 0.5, "block").otherwise("allow")).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
