"""URL verdicts from explicit host/path rules and from mined association rules.

Explicit rules decide first (the longest that fits). For the other URLs, Spark's
FP-growth mines token combinations of labelled URLs; rules whose consequent is
the block label are pruned by support, confidence and lift, and indexed by their
rarest token. A URL is blocked if all tokens of an indexed rule occur in it.

Everything here is DataFrame operations. Matching runs once per distinct URL.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no tokens, so no rule fits and the verdict is ``default``; repeated rows each
get the verdict of their URL; without labelled URLs no rule is mined; an empty
table gives an empty result; tokens of a URL of any length are all used, each once.
Columns beyond those named are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.sources.shared import store

BLOCK = "=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct lower-case tokens: host labels (``h:``), path segments (``p:``, digits as ``0``), query keys (``q:``)."""
    path = F.regexp_replace(F.lower(path_of(url)), r"[0-9]+", "0")
    query = F.lower(F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit("")))

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    return F.array_distinct(
        F.concat(
            tagged("h:", F.split(host_of(url), r"\.")),
            tagged("p:", F.split(path, "/")),
            tagged("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        )
    )


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(size, verdict, rule), or null.

    ``rules`` holds (verdict, host, path). Looked up by host suffix: a rule is
    only compared with URLs on its host or a subdomain.
    """
    by_host: dict[str, list[Column]] = {}
    for verdict, rule_host, rule_path in rules:
        rule = rule_host + rule_path
        by_host.setdefault(rule_host, []).append(
            F.struct(
                F.lit(len(rule)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"), F.lit(rule_path).alias("path")
            )
        )
    if not by_host:
        return F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    index = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*own))])
    labels = F.split(host, r"\.")
    depth = F.least(F.size(labels), F.lit(max(h.count(".") + 1 for h in by_host)))
    suffixes = F.transform(
        F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".")
    )
    fitting = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(index, s)), lambda x: x.isNotNull())), lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("size"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))


def mine_rules(
    labelled: DataFrame,
    url_col: str = "url",
    block_col: str = "block",
    min_support: float = 0.02,
    min_count: int = 2,
    min_confidence: float = 0.6,
) -> DataFrame:
    """(antecedent, confidence, key) of the rules ``tokens => block`` that survive pruning.

    ``key`` is the antecedent's rarest token. Support is the share of labelled
    URLs that hold the tokens and the label; ``min_count`` of them there must be. A
    lift of one says nothing beyond the base rate; any above it will do, as more
    cannot be reached where most labels are block.
    """
    spark = labelled.sparkSession
    tokens = tokens_of(F.col(url_col))
    items = labelled.select(
        F.when(F.col(block_col), F.concat(tokens, F.array(F.lit(BLOCK)))).otherwise(tokens).alias("items")
    ).where(F.size("items") > 0)
    n = items.count()
    if n == 0:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, key string")
    # a support above one cannot be asked for; with fewer URLs than min_count nothing passes the count below
    support = min(1.0, max(min_support, (min_count - 0.5) / n))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(
        (F.col("consequent") == F.array(F.lit(BLOCK)))
        & (F.col("lift") > 1)
        & (F.round(F.col("support") * n) >= min_count)
    ).select(F.sort_array("antecedent").alias("antecedent"), "confidence")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("t"), "freq")
    keyed = rules.withColumn("t", F.explode("antecedent")).join(single, "t")
    keyed = keyed.groupBy("antecedent").agg(
        F.max("confidence").alias("confidence"), F.min(F.struct("freq", "t"))["t"].alias("key")
    )
    # written, so that its size is known where tokens look up their rules
    return store(keyed, "url-rules")


def listed(pages: DataFrame, explicit: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """(url, block) of the rows that an explicit rule decides: labels that follow from the URL alone."""
    url = F.col(url_col)
    rule = explicit_rule(host_of(url), path_of(url), explicit)
    return pages.select(url.alias("url"), (rule["verdict"] == "block").alias("block")).where("block is not null")


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, confidence) of the distinct URLs that some mined rule covers."""
    distinct = urls.select(F.col(url_col).alias("__url")).where(F.col("__url").isNotNull()).distinct()
    tokens = distinct.withColumn("__tokens", tokens_of(F.col("__url")))
    probes = tokens.withColumn("key", F.explode("__tokens"))
    hits = probes.join(rules, "key").where(F.size(F.array_except("antecedent", "__tokens")) == 0)
    return hits.groupBy("__url").agg(F.max("confidence").alias("__confidence"))


def judge(
    pages: DataFrame,
    explicit: list[tuple[str, str, str]],
    mined: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(id, host, path, rule, verdict, decided_by) for every row of ``pages``."""
    d = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"))
    d = d.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    d = d.withColumn("__rule", explicit_rule(F.col("host"), F.col("path"), explicit))
    open_urls = d.where(F.col("__rule").isNull()).select("__url")
    hits = match_rules(open_urls, mined, "__url")
    d = d.join(hits, "__url", "left")
    blocked = F.when(F.col("__confidence").isNotNull(), F.lit("block"))
    return d.select(
        F.col("__id").alias(id_col),
        "host",
        "path",
        F.col("__rule")["rule"].alias("rule"),
        F.coalesce(F.col("__rule")["verdict"], blocked, F.lit(default)).alias("verdict"),
        F.when(F.col("__rule").isNotNull(), "list").when(blocked.isNotNull(), "association").otherwise("default").alias("decided_by"),
    )
