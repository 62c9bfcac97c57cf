"""URL filters: a rule list, and association rules mined by FP-growth for the urls it leaves open.

A url is a set of tokens (scheme, host parts, words of the path, names of query fields). The
labelled urls carry one item more, their label; FP-growth over all urls finds token sets that
imply it. Only tokens that enough labelled urls hold can be in a rule, and tokens that the very
same urls hold are one item, as a rule with any of them holds where a rule with all of them
does: the words of one long url, or of a template, so do not multiply into all their subsets.
Of the rules that hold, those that contain another are left out; they match no further url.
A mined rule holds if its support and its confidence reach their thresholds, where
confidence is the share of *all* urls with the tokens that carry the label: a set that many
unlabelled urls share proves nothing. Rules are filed under their rarest token; a url probes
that index with its tokens and a hit is checked in full.

Defined results: a null url or one without `://` has an empty host and path, no rule and no
token, and is allowed; repeated rows are judged each; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.runtime import materialise

ALLOW, BLOCK = "allow", "block"
LABEL = "label=block"
LEAST_ROWS = 2
RULES = (
    (ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`, without fragment and query; null if there is none."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1))


def host_of(url: Column) -> Column:
    host = F.substring_index(_rest(url), "/", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = _rest(url)
    return F.coalesce(F.substr(rest, F.length(F.substring_index(rest, "/", 1)) + 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):  # the longest is tried first
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens; numbers are not tokens, being nearly unique."""
    has = F.instr(url, "://") > 0
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))))
    parts = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    folders = F.transform(F.regexp_extract_all(path, F.lit(r"[^/.\-_0-9]+"), F.lit(0)), lambda x: F.concat(F.lit("path:"), F.lower(x)))
    asked = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    fields = F.transform(F.regexp_extract_all(asked, F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("field:"), x))
    return F.when(has, F.array_distinct(F.concat(scheme, parts, folders, fields))).otherwise(F.array().cast("array<string>"))


def merged_items(urls: DataFrame, least: int) -> DataFrame:
    """(token, item) of the tokens that `least` labelled rows (tokens, blocked) hold; tokens of the very same rows share an item.

    Two sums of independent 64-bit hashes over the rows of a token, and their number, tell equal sets of rows. There are at
    most as many such tokens as all labelled rows hold, divided by `least`."""
    rows = urls.withColumn("row_", F.monotonically_increasing_id())
    share = lambda salt: F.sum(F.xxhash64(F.lit(salt), "row_").cast("decimal(20,0)"))
    held = rows.select("row_", "blocked", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(
        F.count_if("blocked").alias("labelled"), F.struct(F.count(F.lit(1)), share(1), share(2)).alias("rows_")).where(F.col("labelled") >= least)
    return held.withColumn("item", F.min("token").over(Window.partitionBy("rows_"))).select("token", "item")


def mined_rules(urls: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(filed_under, tokens, confidence) from stored rows (tokens, blocked): the rules that contain no other rule.

    A rule needs the support of `least_rows` labelled rows at least, however few rows there are."""
    number = urls.count()
    least = max(least_rows, math.ceil(min_support * number - 1e-9))
    items = materialise(merged_items(urls, least), "url-items")
    # Each labelled row with its items; those without any say nothing.
    mapped = urls.withColumn("row_", F.monotonically_increasing_id()).select("row_", "blocked", F.explode("tokens").alias("token")).join(items, "token")
    baskets = mapped.groupBy("row_").agg(F.max("blocked").alias("blocked"), F.collect_set("item").alias("items"))
    baskets = materialise(baskets.select(F.when(F.col("blocked"), F.array_append("items", F.lit(LABEL))).otherwise(F.col("items")).alias("items")), "url-baskets")
    baskets_number = baskets.count()
    if not baskets_number:
        return urls.sparkSession.createDataFrame([], "filed_under string, tokens array<string>, confidence double")
    share = max(0.0, (least - 0.5) / baskets_number)
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, share), minConfidence=min_confidence).fit(baskets)
    rules = found.associationRules.where(F.array_contains("consequent", LABEL)).select(
        F.array_sort("antecedent").alias("tokens"), "confidence")
    # A rule is filed under the token that the fewest urls hold.
    held = found.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = (
        rules.select("tokens", F.explode("tokens").alias("token")).join(held, "token")
        .groupBy("tokens").agg(F.min_by("token", F.struct("freq", "token")).alias("filed_under")))
    rules = materialise(rules.join(rarest, "tokens").select("filed_under", "tokens", "confidence"), "url-rules")
    inner = rules.select("filed_under", F.col("tokens").alias("needs"))
    larger = (
        rules.select("tokens", F.explode("tokens").alias("filed_under")).join(inner, "filed_under")
        .where((F.size("needs") < F.size("tokens")) & (F.size(F.array_except("needs", "tokens")) == 0)).select("tokens").distinct())
    return materialise(rules.join(larger, "tokens", "left_anti"), "url-rules")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labels: DataFrame | None = None,
          min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """Host, path, rule and verdict of every url, with the confidence of the method's block.

    The urls that the rule list blocks are the labelled ones, unless `labels` (id, blocked) is given.
    """
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    rule, verdict = matching_rule(host, path, rules)
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns(
        {"host": host_of(url), "path": path_of(url)})
    parsed = materialise(parsed.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), url_tokens(url, host, path).alias("tokens"),
        F.monotonically_increasing_id().alias("number")), "url-parsed")
    if labels is None:
        labelled = parsed.select("tokens", F.coalesce(F.col("listed") == BLOCK, F.lit(False)).alias("blocked"))
    else:
        labelled = parsed.join(labels.groupBy(F.col("id").alias("page_id")).agg(F.max("blocked").alias("blocked")), "page_id", "left")
        labelled = labelled.select("tokens", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    labelled = materialise(labelled, "url-labelled")
    index = mined_rules(labelled, min_support, min_confidence).withColumnRenamed("tokens", "needs")
    probes = parsed.where("listed IS NULL").select("number", "tokens", F.explode("tokens").alias("filed_under"))
    hits = (
        probes.join(index, "filed_under").where(F.size(F.array_except("needs", "tokens")) == 0)
        .groupBy("number").agg(F.max("confidence").alias("confidence")))
    mined = F.when(F.col("confidence").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return parsed.join(hits, "number", "left").select(
        F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("listed", mined).alias("verdict"), "confidence")
