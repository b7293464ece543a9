"""URL filters by association rules: FP-growth mines combinations of URL tokens from labelled URLs; rules pruned by support
and confidence are matched through an inverted index. A list of written rules comes before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.llm.common import set_aside, staged

BLOCKED = "label:block"
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
ADDED = ("host", "path", "rule", "verdict")

# Fixed values: (rule, verdict).
WRITTEN_RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), upper, upper.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def written_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (ties: the later in order of spelling), or null. A rule fits its
    host and all subdomains if the URL's path starts with the rule's."""
    fits = []
    for rule, verdict in rules:
        rule_host, _, rest = rule.partition("/")
        on_host = (host_ == rule_host) | host_.endswith(f".{rule_host}")
        fits.append(F.when(on_host & path_.startswith(f"/{rest}"), F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def tokens(host_: Column, path_: Column) -> Column:
    """Distinct tokens: host labels and their hyphenated parts, path segments; numbers in a path are one token."""
    hosts = F.transform(F.array_union(F.split(host_, r"\."), F.split(host_, r"[.\-]")), lambda t: F.concat(F.lit("h:"), t))
    segments = F.transform(F.split(path_, r"[/.]"), lambda t: F.concat(F.lit("p:"), F.regexp_replace(t, "^[0-9]+$", "#")))
    return F.array_distinct(F.filter(F.concat(hosts, segments), lambda t: ~t.isin("h:", "p:")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens array) from labelled (tokens array, blocked boolean): sets of tokens, of any number, that occur with
    a blocked label in min_support of the rows, and without one in at most 1 - min_confidence of theirs. A rule that
    contains another one is pruned: it matches nothing more."""
    labelled = staged(labelled.where("blocked is not null"), "labelled")
    schema = "rule_id string, tokens array<string>"
    spark = labelled.sparkSession
    if labelled.where("blocked").isEmpty():
        return spark.createDataFrame([], schema)
    items = labelled.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BLOCKED)
    rules = staged(rules.select(F.array_sort("antecedent").alias("tokens")).select(F.array_join("tokens", " ").alias("rule_id"), "tokens"), "rules")
    larger = holding(rules.select(F.col("rule_id").alias("url"), "tokens"), rules).where(F.size("needed") < F.size("held"))
    return rules.join(larger.select(F.col("url").alias("rule_id")).distinct(), "rule_id", "left_anti")


def holding(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, held, needed) for each rule all of whose tokens a row of urls (url, tokens) holds. The index files each rule under
    its rarest token, so tokens that all URLs share lead to few rules."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    held = urls.select("url", F.col("tokens").alias("held"), F.explode("tokens").alias("token"))
    times = held.join(wanted, "token", "left_semi").groupBy("token").count()
    filed = rules.withColumn("token", F.explode("tokens")).join(times, "token", "left")
    rarest = filed.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), F.col("token"))).alias("token"), F.first("tokens").alias("needed"))
    return held.join(rarest.select("token", "needed"), "token").where(F.size(F.array_except("needed", "held")) == 0).select("url", "held", "needed")


def matching(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url of every row of urls (url, tokens) that holds all tokens of some rule."""
    return holding(urls, staged(rules, "index")).select("url").distinct()


def judge(
    pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str]] = WRITTEN_RULES, url_col: str = "url",
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """pages with host, path, the written rule that decides (or null) and the verdict, block or allow.

    labels holds (url, blocked); URLs that a written rule decides are labelled by it too. Both are mined, and the mined rules
    decide where no written one does; a URL that no rule matches is allowed. Null URLs and URLs without :// have empty
    host and path and are allowed; repeated rows get equal verdicts; input columns named like an added one come back as
    <name>_in. A URL that fills a third of the rows is matched once.
    """
    pages = set_aside(pages, ADDED)
    url_col = url_col if url_col in pages.columns else f"{url_col}_in"
    spark_urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct()
    split = spark_urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    split = staged(split.withColumns({"tokens": tokens(F.col("host"), F.col("path")), "written": written_rule(F.col("host"), F.col("path"), rules)["verdict"]}), "urls")
    given = split.where("written is not null").select("tokens", (F.col("written") == "block").alias("blocked"))
    if labels is not None:
        own = split.where("written is null").join(labels.groupBy(F.col("url").alias("__url")).agg(F.max("blocked").alias("blocked")), F.col("url") == F.col("__url"))
        given = given.union(own.select("tokens", "blocked"))
    blocked = staged(matching(split.where("written is null").select("url", "tokens"), mine(given, min_support, min_confidence)), "blocked")
    judged = pages.withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col))})
    judged = judged.withColumn("__rule", written_rule(F.col("host"), F.col("path"), rules))
    met = judged.join(blocked.withColumnRenamed("url", "__hit"), F.col(url_col) == F.col("__hit"), "left")
    mined = F.when(F.col("__hit").isNotNull(), "block").otherwise("allow")
    return met.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.verdict"), mined)}).drop("__rule", "__hit")
