"""Audit of how document filters interact, by the Hart-Mas-Colell potential of a removal game.

Filters are players; a coalition is worth the documents that fail at least one of its filters. Per part of the
corpus the potentials of all coalitions follow from one another, smaller coalitions first: that of a coalition is
its worth plus the potentials of the coalitions with one filter less, over its size. A filter's Shapley value is the
potential of all filters minus the potential without it, so no order is simulated. The steps of an order are
differences of worths between its growing coalitions. All of it is in whole numbers: potentials are kept times the
factorial of the coalition's size.

Documents become counts per part and set of failed filters before anything else, at most 32 rows a part. A text is
read once, for its measures and its digest; copies are found by SHA-256 digests, whose groups shrink to a row per
task before they are shuffled.

Defined cases: a null text is empty, a null language is the part ''; a row without doc_id has no labels, and neither
copies another nor is copied; rows that repeat a doc_id are documents of their own, do not copy each other, and share
their labels; a document that several label rows call good or toxic counts once; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderglass.llm.common import let, table, words_of
from orderglass.session import stage

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"


def _bits(conditions: list[Column]) -> Column:
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def text_failures(text: Column) -> Column:
    """Bit i is set where the i-th of the filters A-D, which look at one text alone, fails."""
    counts = let(words_of(text), lambda words: F.struct(
        F.size(words).cast("long").alias("words"), F.size(F.array_distinct(words)).cast("long").alias("distinct")
    ))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return let(counts, lambda n: _bits([
        n["words"] < LEAST_WORDS, 100 * n["distinct"] < DISTINCT_PERCENT * n["words"],
        100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text), text.rlike(SYMBOLS),
    ]))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents per part and set of failed filters, and the labelled ones of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("base"),
    ), "audit-rows")
    copy = 1 << FILTERS.index("E")
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("marked")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    numbered = rows.filter("doc_id is not null").groupBy("doc_id", "part", "digest", "base").agg(F.count("*").alias("n"))
    kinds = ["digest", "part", "base", "good", "toxic"]
    known = numbered.join(marked, F.col("doc_id") == F.col("marked"), "left").fillna(False, ["good", "toxic"])
    # The copies of a text shrink to a row per task, part and label before they meet.
    merged = known.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"))
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    judged = merged.withColumn("passing", F.when(first, F.col("at_least")).otherwise(0)).select(
        *kinds, F.explode(F.array(
            F.struct(F.col("base").alias("fails"), F.col("passing").alias("n")),
            F.struct(F.col("base").bitwiseOR(F.lit(copy)).alias("fails"), (F.col("n") - F.col("passing")).alias("n")),
        )).alias("each"),
    ).select("part", "each.fails", "each.n", "good", "toxic").filter("n > 0")
    unnumbered = rows.filter("doc_id is null").groupBy("part", F.col("base").alias("fails")).agg(F.count("*").alias("n"))
    everyone = judged.unionAll(unnumbered.select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    return everyone.groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def potentials(worth: Column, players: int) -> Column:
    """Potential of each coalition times the factorial of its size, from the coalitions' worths by bit set."""
    less_one = F.array(*(F.lit(factorial(max(size - 1, 0))) for size in range(players + 1)))

    def grow(known: Column, coalition: Column) -> Column:
        without = sum(
            (F.when(coalition.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, coalition.bitwiseXOR(F.lit(1 << i)))).otherwise(0) for i in range(players)),
            F.lit(0).cast("long"),
        )
        return F.array_append(known, F.get(less_one, F.bit_count(coalition)) * F.get(worth, coalition) + without)

    # A coalition's number is above those of its parts.
    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << players) - 1)), F.array(F.lit(0).cast("long")), grow)


def filter_steps(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every step of every order of ``filters`` per part, from (part, fails, n, good, toxic) counts."""
    players = len(filters)
    everyone = (1 << players) - 1
    coalitions = F.sequence(F.lit(0), F.lit(everyone))

    def lost(name: str) -> Column:
        """Documents that a coalition removes, by coalition."""
        return F.transform(coalitions, lambda of: F.aggregate(
            "rows", F.lit(0).cast("long"), lambda total, row: total + F.when(row["fails"].bitwiseAND(of) != 0, row[name]).otherwise(0)
        ))

    parts = counts.groupBy("part").agg(
        F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("rows"),  # one per set of failed filters
        F.sum("n").alias("total"),
    ).select("part", "total", *(lost(name).alias(name) for name in ("n", "good", "toxic")))
    orders = F.array(*(F.lit("".join(order)) for order in permutations(filters)))
    steps = parts.withColumn("potential", potentials(F.col("n"), players)).select(
        "*", F.explode(orders).alias("filter_order")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(players))).alias("step"))

    def bit(place: Column) -> Column:
        own = F.instr(F.lit(filters), F.substring("filter_order", place, F.lit(1)))
        return F.get(F.array(*(F.lit(1 << i) for i in range(players))), own - 1)

    before = F.aggregate(F.sequence(F.lit(1), F.lit(players)), F.lit(0), lambda held, place: held + F.when(place < F.col("step"), bit(place)).otherwise(0))
    placed = steps.withColumn("own", bit(F.col("step"))).withColumn("before", before)
    after = F.col("before").bitwiseOR(F.col("own"))
    removed = F.get("n", after) - F.get("n", "before")
    without = F.lit(everyone).bitwiseXOR(F.col("own"))
    return placed.select(
        "part", "filter_order", "step", (F.col("total") - F.get("n", after)).alias("kept"), removed.alias("removed"),
        (F.get("n", "own") - removed).alias("redundant"), (F.get("n", F.lit(everyone)) - F.get("n", without)).alias("unique_fails"),
        *((F.get(name, after) - F.get(name, "before")).alias(f"{name}_lost") for name in ("good", "toxic")),
        (F.get("potential", F.lit(everyone)) - players * F.get("potential", without)).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of every order of the five filters, per language."""
    return filter_steps(failure_counts(docs, labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT body, min(doc_id) AS first_id FROM texts GROUP BY body
), marks AS (
  SELECT doc_id AS marked, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
         100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 3 * length(body) AS C,
         regexp_matches(body, '[#$%&*|]') AS D, coalesce(doc_id > first_id, false) AS E
  FROM texts JOIN firsts USING (body) LEFT JOIN marks ON doc_id = marked
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), kinds AS (
  SELECT part, concat(CASE WHEN A THEN 'A' END, CASE WHEN B THEN 'B' END, CASE WHEN C THEN 'C' END, CASE WHEN D THEN 'D' END, CASE WHEN E THEN 'E' END) AS fails,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged GROUP BY ALL
), counted AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT gone AND NOT now), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND now), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND now), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND now), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND now), 0) AS toxic_lost
  FROM (SELECT kinds.*, steps.*, contains(fails, own) AS now, earlier <> '' AND regexp_matches(fails, '[' || earlier || 'x]') AS gone FROM kinds, steps)
  GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
