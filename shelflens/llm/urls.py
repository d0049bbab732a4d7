"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for URLs without a rule.

1. A rule fits its host and all subdomains where the path starts with the rule's; the longest rule that fits gives the verdict.
2. URLs with a rule are the labelled ones. Trees are boosted on at most ``TRAINING_URLS`` of them, those with the smallest hashes.
3. Features: lengths, depth, digit ratio, entropy, counts of parameters, labels and marks, and statistics of the host's suffix.
   The statistics count all URLs: how many share the last label and the last two, and which smoothed share of the
   labelled among them is blocked. A training URL is not counted in its own share: shares are taken over the other folds.
4. The trees' verdict holds where no rule fits.

Defined results: a null URL or one without "://" has an empty host and path and no rule; its features are those of the empty text,
so the trees judge it like any other. An empty path fits no rule. Without any labelled URL everything else is allowed, with
labels of one kind only everything gets that kind. URLs of any length are read whole. Repeated rows are judged each; rows with null ids
stay. Among rules of equal length the first one wins. An empty table gives an empty table. Other columns are ignored, whatever
their names; ids keep their type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from shelflens.session import materialize

#: (verdict, host, path), an example of the parameter
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRAINING_URLS = 20_000
FOLDS = 5
SMOOTHING = 4.0  # how many labelled URLs the wider suffix counts for
TREES = 20
DEPTH = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first "://"; the empty text if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null."""
    found = F.lit(None)
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found.cast("struct<rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters; 0 for the empty text."""
    state = lambda last, run, total: F.struct(last.alias("last"), run.alias("run"), total.alias("total"))
    weight = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    characters = F.array_sort(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1))
    bits = F.aggregate(
        characters, state(F.lit(""), F.lit(0.0), F.lit(0.0)),
        lambda s, c: F.when(s["last"] == c, state(c, s["run"] + 1, s["total"])).otherwise(state(c, F.lit(1.0), s["total"] + weight(s["run"]))),
        lambda s: s["total"] + weight(s["run"]))
    n = F.length(text).cast("double")
    return F.when(n > 0, F.log2(n) - bits / n).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match a class."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")).cast("double")


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the text of a URL, never null."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    size = F.length(url).cast("double")
    return {
        "url_length": size,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"),
        "labels": F.size(F.filter(F.split(host, r"\."), lambda p: p != "")).cast("double"),
        "digit_ratio": F.when(size > 0, _count(url, "0-9") / size).otherwise(0.0),
        "host_digits": _count(host, "0-9"),
        "path_digits": _count(path, "0-9"),
        "hyphens": _count(url, "-"),
        "url_entropy": entropy(url),
        "host_entropy": entropy(host),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "slash_end": path.endswith("/").cast("double"),
        "secure": url.startswith("https:").cast("double"),
    }


SUFFIX_FEATURES = ("wide_urls", "wide_blocked", "near_urls", "near_blocked")


def _suffixes(rows: DataFrame) -> DataFrame:
    """``near`` is the host's last two labels, ``wide`` its last one; ``fold`` deals URLs by hash."""
    return rows.withColumn("near", F.substring_index("host", ".", -2)).withColumn("wide", F.substring_index("host", ".", -1)).withColumn(
        "fold", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(FOLDS)).cast("int"))


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """One row per ``near`` suffix: URLs, labelled and blocked ones of it and of its last label, in all and by fold."""
    sums = [F.count("*").alias("n")]
    for f in range(FOLDS):
        sums += [F.count_if((F.col("fold") == f) & F.col("label").isNotNull()).alias(f"l{f}"),
                 F.sum(F.when(F.col("fold") == f, F.col("label")).otherwise(0.0)).alias(f"b{f}")]
    near = materialize(rows.groupBy("near", "wide").agg(*sums), "suffixes")
    array = lambda c, p: F.array(*[F.coalesce(F.col(f"{c}{f}"), F.lit(0)).cast("double") for f in range(FOLDS)]).alias(p)
    wide = near.groupBy("wide").agg(F.sum("n").alias("n"), *[F.sum(f"{c}{f}").alias(f"{c}{f}") for f in range(FOLDS) for c in "lb"])
    return near.select("near", "wide", F.col("n").alias("near_n"), array("l", "near_l"), array("b", "near_b")).join(
        wide.select("wide", F.col("n").alias("wide_n"), array("l", "wide_l"), array("b", "wide_b")), "wide").drop("wide")


def _with_suffix_features(rows: DataFrame, statistics: DataFrame, own_fold: bool) -> DataFrame:
    """``rows`` with the suffix features; without ``own_fold`` the shares leave out the fold of the row."""
    def total(name: str) -> Column:
        whole = F.aggregate(name, F.lit(0.0), lambda s, x: s + x)
        return whole if own_fold else whole - F.get(name, F.col("fold"))

    joined = rows.join(statistics, "near", "left")
    joined = joined.withColumn("wide_blocked", (total("wide_b") + SMOOTHING * 0.5) / (total("wide_l") + SMOOTHING))
    joined = joined.withColumn("near_blocked", (total("near_b") + SMOOTHING * F.col("wide_blocked")) / (total("near_l") + SMOOTHING))
    joined = joined.withColumn("wide_urls", F.log1p("wide_n")).withColumn("near_urls", F.log1p("near_n"))
    return joined.drop("near_n", "wide_n", "near_l", "near_b", "wide_l", "wide_b")


def read_urls(pages: DataFrame, id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """id, url, host, path, rule, verdict and label (1 blocked, 0 allowed, null without a rule)."""
    text = F.col(f"`{url}`").cast("string")
    rows = pages.select(F.col(f"`{id}`").alias("id"), text.alias("url"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rows = rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    return rows.select("id", "url", "host", "path", "fit.rule", "fit.verdict").withColumn("label", (F.col("verdict") == "block").cast("double"))


def feature_names() -> list[str]:
    return [*lexical_features(F.lit(""), F.lit(""), F.lit("")), *SUFFIX_FEATURES]


def _featured(rows: DataFrame) -> DataFrame:
    found = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    return rows.select("*", *[c.alias(name) for name, c in found.items()])


def learn(rows: DataFrame, statistics: DataFrame, training_urls: int = TRAINING_URLS, trees: int = TREES,
          depth: int = DEPTH) -> GBTClassificationModel | float:
    """Boosted trees from labelled ``rows`` (of :func:`read_urls` with suffixes), or the only label there is (0 without any)."""
    picked = rows.where("label is not null").orderBy(F.xxhash64("url"), "url", "id").limit(training_urls)
    picked = materialize(_featured(_with_suffix_features(picked, statistics, own_fold=False)), "training_urls")
    labels = [r.label for r in picked.select("label").distinct().collect()]
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    vectors = VectorAssembler(inputCols=feature_names(), outputCol="features").transform(picked.orderBy(F.xxhash64("url"), "url", "id"))
    vectors = materialize(vectors.select("label", "features"), "training_vectors")
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(vectors)


def judge(pages: DataFrame, id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          training_urls: int = TRAINING_URLS) -> DataFrame:
    """One row per URL: id, host, path, rule, verdict (allow or block), score (the trees' probability of a block)."""
    rows = _suffixes(read_urls(pages, id, url, rules))
    statistics = materialize(suffix_statistics(rows), "suffix_statistics")
    model = learn(rows, statistics, training_urls)
    if isinstance(model, float):
        judged = rows.withColumn("score", F.lit(model))
    else:
        featured = _featured(_with_suffix_features(rows, statistics, own_fold=True))
        vectors = VectorAssembler(inputCols=feature_names(), outputCol="features").transform(featured)
        judged = model.transform(vectors).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
