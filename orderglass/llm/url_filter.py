"""URL filter: fixed host and path rules, and association rules mined from labelled pages.

FP-growth mines combinations of URL tokens with the outcome of labelled pages. Rules for ``block`` of any length
that at least ``MIN_PAGES`` blocked pages bear out, that pass the confidence, and that no shorter rule makes
superfluous, are kept in an inverted index under their rarest token; a URL is matched with the rules under its own
tokens. A fixed rule decides before any mined one.

A page is labelled through the document whose number ends its path; such a document counts as ``block`` if
its quality is 0 or it is toxic.

Defined cases: a null URL or one without ``://`` has an empty host and path, no tokens and verdict allow;
without labelled pages nothing is mined; repeated rows are judged alike; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderglass.llm.common import ascii_lower, table
from orderglass.session import stage

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Blocked pages that a rule needs, however many are labelled.
MIN_PAGES = 5
MIN_CONFIDENCE = 0.6


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column) -> Column:
    """Struct of the longest fitting rule and its verdict, or null."""
    found = None
    for of, prefix, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(prefix))
        rule = F.struct(F.lit(of + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return found


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL: host, its domains, path parts (numbers as ``#``) and query names."""
    host, path = host_of(url), path_of(url)
    # The top domain first, the whole host last.
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat(F.lit("h:"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")),
    )
    parts = F.filter(F.split(F.regexp_replace(ascii_lower(path), r"\d+", "#"), r"[/]"), lambda p: p != "")
    names = F.regexp_extract_all(F.split_part(F.coalesce(url, F.lit("")), F.lit("#"), F.lit(1)), F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    tokens = F.concat(
        domains, F.transform(parts, lambda p: F.concat(F.lit("p:"), p)), F.transform(names, lambda q: F.concat(F.lit("q:"), q))
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(tokens))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and outcome (block or allow) of the pages whose document is labelled."""
    number = F.regexp_extract(path_of(F.col("url")), r"(\d{1,18})[^/\d]*/?$", 1)
    known = pages.select("url", number.alias("n")).filter("n != ''").select("url", F.col("n").cast("long").alias("of"))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    outcome = labels.groupBy("doc_id").agg(F.max(F.when(bad, "block").otherwise("allow")).alias("outcome"))
    return known.join(outcome, F.col("of") == F.col("doc_id")).select("url", "outcome")


def _baskets(labelled: DataFrame) -> DataFrame:
    """items of one basket per page without its host, and of one per domain of its host.

    A page's domains hold each other, so a rule needs one of them at most. In baskets of their own they do not
    multiply the combinations; the other tokens are marked there (``'``), as they count once per domain.
    """
    tokens, outcome = tokens_of(F.col("url")), F.concat(F.lit("y:"), F.col("outcome"))
    domain = F.filter(tokens, lambda t: F.startswith(t, F.lit("h:")))
    others = F.filter(tokens, lambda t: ~F.startswith(t, F.lit("h:")))
    marked = F.transform(others, lambda t: F.concat(F.lit("'"), t))
    by_domain = F.transform(domain, lambda t: F.concat(F.array(t, outcome), marked))
    return labelled.select(F.explode(F.concat(F.array(F.array_append(others, outcome)), by_domain)).alias("items"))


def _item_facts(baskets: DataFrame, least: int) -> DataFrame:
    """(item, kind, n, bad, chosen): items of at least ``least`` blocked baskets, how many baskets hold them, and one
    item that stands for all of its kind that the same baskets hold, by 128 bits of hash.

    Tokens that always come together, such as the query names of one form, would double the combinations each.
    """
    held = baskets.select("id", F.array_contains("items", "y:block").alias("bad"), F.explode("items").alias("item")).filter(
        ~F.startswith("item", F.lit("y:"))
    )
    kind = F.when(F.startswith("item", F.lit("h:")), "h").when(F.startswith("item", F.lit("'")), "'").otherwise("")
    facts = held.groupBy("item").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("bad"),
        *(F.bit_xor(F.xxhash64(F.lit(seed), "id")).alias(f"seen{seed}") for seed in (1, 2)),
    ).filter(F.col("bad") >= least).withColumn("kind", kind)
    alike = ["kind", "n", "bad", "seen1", "seen2"]
    return facts.join(facts.groupBy(*alike).agg(F.min("item").alias("chosen")), alike).select("item", "kind", "n", "bad", "chosen")


def _with_members(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """(tokens, confidence): each rule with every token that one of its tokens stands for."""
    members = facts.groupBy(F.col("chosen").alias("token")).agg(F.collect_list(F.ltrim("item", F.lit("'"))).alias("members"))
    lists = rules.select("rule", "confidence", F.explode("antecedent").alias("token")).join(members, "token").groupBy("rule", "confidence").agg(
        F.collect_list("members").alias("lists")
    )
    none = F.array(F.array().cast("array<string>"))
    each = F.aggregate("lists", none, lambda made, one: F.flatten(F.transform(made, lambda begun: F.transform(one, lambda t: F.array_append(begun, t)))))
    return lists.select(F.explode(each).alias("tokens"), "confidence").select(F.array_sort("tokens").alias("tokens"), "confidence").distinct()


def mine_rules(labelled: DataFrame, support: float | None = None, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, confidence, anchor) of the rules for ``block``; the anchor is the rarest token.

    ``support`` is a share of the labelled pages; without it a rule needs ``MIN_PAGES`` blocked pages.
    """
    baskets = stage(_baskets(labelled).select(F.monotonically_increasing_id().alias("id"), "items"), "url-baskets")
    least = MIN_PAGES if support is None else max(1, math.ceil(support * labelled.count()))
    # Half a page less, as the share is multiplied and rounded up again.
    share = min(1.0, (least - 0.5) / max(1, baskets.count()))
    facts = stage(_item_facts(baskets, least), "url-items")
    # A token that only blocked pages hold is a rule by itself, and makes each larger one superfluous.
    pure = facts.filter("n = bad and kind <> \"'\"").select(F.array("item").alias("tokens"), F.lit(1.0).alias("confidence"))
    mixed = facts.filter("n > bad")
    used = baskets.select("id", F.explode("items").alias("item")).join(mixed.filter("item = chosen").select("item"), "item", "left_semi")
    outcome = baskets.select("id", F.filter("items", lambda t: F.startswith(t, F.lit("y:"))).alias("y"))
    reduced = stage(outcome.join(used.groupBy("id").agg(F.collect_list("item").alias("few")), "id").select(F.concat("few", "y").alias("items")), "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, share * baskets.count() / max(1, reduced.count())), minConfidence=confidence).fit(reduced)
    one_domain = F.exists("antecedent", lambda t: F.startswith(t, F.lit("h:")))
    marked = F.exists("antecedent", lambda t: F.startswith(t, F.lit("'")))
    found = model.associationRules.filter(
        (F.get("consequent", F.lit(0)) == "y:block") & (one_domain | ~marked)
        & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("y:")))
    ).select(F.monotonically_increasing_id().alias("rule"), "antecedent", "confidence")
    rules = stage(pure.unionAll(_with_members(stage(found, "url-found"), mixed)), "url-rules")
    often = facts.filter("kind <> \"'\"").select(F.col("item").alias("token"), F.col("n").alias("freq"))
    rarest = rules.withColumn("token", F.explode("tokens")).join(often, "token").groupBy("tokens", "confidence").agg(
        F.min_by("token", F.struct("freq", "token")).alias("anchor")
    )
    rarest = stage(rarest, "url-anchors")
    # A rule is superfluous if one with fewer of its tokens is as sure.
    some = rarest.withColumn("token", F.explode("tokens"))
    shorter = rarest.select(F.col("tokens").alias("fewer"), F.col("confidence").alias("sure"), F.col("anchor").alias("token"))
    worse = some.join(shorter, "token").filter(
        (F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))
    ).select("tokens").distinct()
    return rarest.join(worse, "tokens", "left_anti")


def judge_urls(pages: DataFrame, labels: DataFrame, support: float | None = None, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and the confidence of the best mined rule of every page."""
    index = stage(mine_rules(page_labels(pages, labels), support, confidence), "url-index")
    urls = pages.select("url").distinct().withColumn("all", tokens_of(F.col("url")))
    open_ = urls.filter(fixed_rule(host_of(F.col("url")), path_of(F.col("url"))).isNull())
    hits = (
        open_.withColumn("anchor", F.explode("all")).join(index, "anchor")
        .filter(F.size(F.array_except("tokens", "all")) == 0)
        .groupBy("url").agg(F.max("confidence").alias("block_confidence"))
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    fixed = fixed_rule(host, path)
    mined = F.when(F.col("block_confidence").isNotNull(), "block").otherwise("allow")
    return pages.select("page_id", "url").join(hits, "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), fixed["rule"].alias("rule"),
        F.coalesce(fixed["verdict"], mined).alias("verdict"), "block_confidence",
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
