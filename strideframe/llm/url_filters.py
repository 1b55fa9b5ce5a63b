"""URL filters: host and path rules first, then association rules mined from labelled URLs.

Spark's FP-growth mines the token combinations of labelled URLs together with their label; the
rules towards the bad label are pruned by support, confidence and lift. A rule is filed under
its rarest token (an inverted index); a URL looks up its tokens and is blocked if all tokens of
a rule found there are among its own. The support is a number of URLs, not a share, so a bad host
becomes a rule however many other URLs there are. DataFrame operations only.

Tokens that never occur apart in labelled URLs are mined as one, so a URL that is labelled often
doesn't yield all subsets of its tokens. What is left grows with the combinations of frequent items that
do occur apart: URLs of k such items that repeat in ``LEAST`` variants each can still yield 2^k sets.

Judging is done for each distinct URL and joined back, so a URL that fills a third of the table
is judged once. A null URL, or one without ``://``, has empty host and path, no tokens and no
rule; it is allowed. Repeated rows get equal answers. Without labels there are no mined rules.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import written

#: (verdict, rule); fixed values
HOST_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: least number of labelled URLs that a rule holds for, whatever their share
LEAST = 10
CONFIDENCE = 0.8
LIFT = 1.5
BAD, GOOD = "label:bad", "label:good"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: the host's endings by label, and the words of path and query."""
    labels = F.split(host_of(url), r"\.")
    host = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -i, i), ".")))
    words = F.filter(F.split(F.regexp_extract(_rest(url), r"^[^/?#]*(.*)", 1), r"[^A-Za-z0-9_-]+"), lambda w: w != "")
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(host, F.transform(words, lambda w: F.concat(F.lit("word:"), w)))))


def host_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def mine(urls: DataFrame, labels: DataFrame, key: str = "page_id", label_key: str = "doc_id", support: float = 0.0, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame | None:
    """rule (items), support, confidence and lift of what points to bad URLs; None without labels. See :func:`mined`."""
    found = mined(urls, labels, key, label_key, support, confidence, lift)
    return None if found is None else found[0]


def mined(urls: DataFrame, labels: DataFrame, key: str = "page_id", label_key: str = "doc_id", support: float = 0.0, confidence: float = CONFIDENCE, lift: float = LIFT) -> tuple[DataFrame, DataFrame] | None:
    """The rules over items, and the item of each token (token, item); None without labels.

    An item stands for tokens that occur in the same labelled URLs, under the name of the first of them. As a rule
    with one of them holds with any other as well, a URL has an item if it has one of its tokens.

    ``urls`` has ``key`` and url, ``labels`` has ``label_key``, quality and toxic. A label is bad
    if the quality is 0 or the text toxic; rows without either are left out. A rule holds for
    ``LEAST`` URLs at least, and for the share ``support`` of them where that is asked for.
    """
    judged = labels.select(labels[label_key].alias("_k"), F.when((labels["quality"] == 0) | (labels["toxic"] == 1), BAD).when(labels["quality"] == 1, GOOD).alias("_label")).where("_label is not null")
    baskets = urls.select(urls[key].alias("_k"), F.coalesce(urls["url"], F.lit("")).alias("url")).join(judged, "_k").select(F.struct("_k", F.monotonically_increasing_id()).alias("_b"), tokens_of(F.col("url")).alias("tokens"), "_label")
    baskets = written(baskets, "baskets")
    n = baskets.count()
    if not n:
        return None
    items, of = alike(baskets)
    baskets = items.select(F.array_append("items", F.col("_label")).alias("items"))
    # half a URL less, as the share is rounded up to whole URLs again
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, (LEAST - 0.5) / n)), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD) & (F.col("lift") >= lift))
    return found.select(F.array_sort("antecedent").alias("rule"), "support", "confidence", "lift"), of


def alike(baskets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Baskets of items (``_b``, items, ``_label``), and the item of each token (token, item).

    Tokens that stand in the same labelled URLs, all of them, are one item: any rule with one holds with the others
    too. A URL that is labelled often, and the endings of a host that never occur apart, are single items then
    instead of all their combinations. Tokens of fewer than ``LEAST`` URLs can't be in a rule and are left out.
    """
    each = baskets.select("_b", F.explode("tokens").alias("token"))
    where = [F.bit_xor(F.xxhash64(F.lit(seed), "_b")).alias(f"_x{seed}") for seed in (1, 2)]
    same = each.groupBy("token").agg(F.count("*").alias("_n"), *where).where(F.col("_n") >= LEAST)
    groups = same.groupBy("_n", "_x1", "_x2").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    of = written(groups.select(F.explode("tokens").alias("token"), "item"), "items")
    held = each.join(of.where("token = item").select("token"), "token").groupBy("_b").agg(F.collect_list("token").alias("items"))
    return baskets.select("_b", "_label").join(held, "_b", "left").select("_b", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "_label"), of


def indexed(rules: DataFrame) -> DataFrame:
    """The rules filed under the token that the fewest rules share; of equals the first in order."""
    common = rules.select(F.explode("rule").alias("token")).groupBy("token").count()
    by = rules.select("rule", "confidence", "support", F.explode("rule").alias("token")).join(common, "token")
    return by.groupBy("rule", "confidence", "support").agg(F.min_by("token", F.struct("count", "token")).alias("token"))


def matched(urls: DataFrame, index: DataFrame, of: DataFrame) -> DataFrame:
    """url, confidence and items of the best rule, of the URLs that some rule fits."""
    items = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token")).join(of, "token").groupBy("url").agg(F.collect_set("item").alias("tokens"))
    looked = items.withColumn("token", F.explode("tokens"))
    found = looked.join(index, "token").where(F.size(F.array_except("rule", "tokens")) == 0)
    return found.groupBy("url").agg(F.max_by(F.struct("confidence", "rule"), F.struct("confidence", "support", "rule")).alias("best")).select("url", F.col("best.confidence").alias("confidence"), F.array_join("best.rule", " ").alias("mined_rule"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = HOST_RULES, key: str = "page_id", url: str = "url", support: float = 0.0, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule with its confidence where one fits."""
    rows = pages.select(pages[key].alias("page_id"), F.coalesce(pages[url], F.lit("")).alias("url"))
    found = mined(rows, labels, "page_id", support=support, confidence=confidence)
    if found is None:
        rows = rows.withColumns({"confidence": F.lit(None).cast("double"), "mined_rule": F.lit(None).cast("string")})
    else:
        rows = rows.join(matched(rows.select("url").distinct(), indexed(found[0]), found[1]), "url", "left")
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = host_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule", F.col("confidence").alias("mined_confidence"))
