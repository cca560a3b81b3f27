"""Quality rules: hashed n-gram log-likelihood ratios between trusted and raw text.

Words and word pairs of a document are hashed into buckets. Two multinomials over the buckets, one from
trusted documents and one from the whole corpus, give each bucket a log ratio; a document's score is the
mean ratio of its words and pairs, and a fixed threshold decides. Documents that fail the base rules are
rejected whatever their score.

Defined cases: a null or blank text has no words and fails the base rules; without trusted rows every
ratio is 0 and only the base rules decide; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderglass.llm.common import let, table, words_of

BUCKETS = 1 << 14
#: Trusted documents that the target multinomial is fitted on, at most; the raw one covers the corpus.
TRUSTED_ROWS = 20_000
THRESHOLD = -0.12
PRIOR = 10
WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(hashes: Column, gap: int) -> Column:
    """Hash of each element with the one ``gap`` places on; the last ``gap`` are not meaningful."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + gap)))


def _first(values: Column, fewer: int) -> Column:
    return F.slice(values, 1, F.greatest(F.size(values) - fewer, F.lit(0)))


def _features(hashes: Column, pairs: Column) -> Column:
    return F.concat(hashes, _first(pairs, 1))


def bucket_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> list[float]:
    """Log ratio per bucket, raw counts cover every document."""
    trusted = (
        labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
        .select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows)
        .withColumn("is_trusted", F.lit(1))
    )
    hashes = let(_hashes(words_of(F.col("text"))), lambda h: _features(h, _pairs(h, 1)))
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left")
    counts = (
        flagged.select(F.explode(hashes).alias("h"), "is_trusted")
        .groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"))
        .agg(F.count("*").alias("raw"), F.count("is_trusted").alias("trusted"))
    )
    rows = counts.collect()  # at most ``buckets`` rows
    return _log_ratios(rows, buckets)


def _log_ratios(rows: list, buckets: int) -> list[float]:
    """log of trusted counts over those expected from the raw corpus, both raised by PRIOR.

    The prior keeps buckets with little evidence near 0, as most are in a small corpus.
    """
    share = sum(row["trusted"] for row in rows) / max(1, sum(row["raw"] for row in rows))
    found = [0.0] * buckets
    if share:
        for row in rows:
            found[row["bucket"]] = log((row["trusted"] + PRIOR) / (row["raw"] * share + PRIOR))
    return found


def _weight_literal(weights: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")


def _mean_weight(features: Column, weights: list[float]) -> Column:
    known, n = _weight_literal(weights), F.size(features)
    total = F.aggregate(
        features, F.lit(0.0), lambda acc, h: acc + F.get(known, F.pmod(h, F.lit(len(weights))).cast("int"))
    )
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("at"))))

    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        starts = F.sort_array(F.transform(again, lambda x: x["at"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
        return F.aggregate(
            starts, start,
            lambda acc, at: F.struct(
                (acc["n"] + F.least(F.lit(WINDOW).cast("long"), at - acc["last"])).alias("n"), at.alias("last")
            ),
        )["n"]

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
        let(placed, repeated)
    )


def quality_column(text: Column, weights: list[float], threshold: float = THRESHOLD) -> Column:
    """Struct of the base counts, the score, base_failed and kept for one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)

    def measures(h1: Column) -> Column:
        def after_pairs(h2: Column) -> Column:
            return F.struct(
                F.size(h1).cast("long").alias("n_words"),
                _mean_weight(_features(h1, h2), weights).alias("score"),
                let(_first(let(_pairs(h2, 2), lambda h4: _pairs(h4, 4)), WINDOW - 1), _covered).alias("n_repeat_words"),
            )

        return let(_pairs(h1, 1), after_pairs)

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        return F.struct(
            m["n_words"].alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (m["score"] >= threshold)).alias("kept"),
            m["score"].alias("score"),
        )

    return let(let(_hashes(words_of(text)), measures), verdict)


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of every document."""
    weights = bucket_weights(docs, labels)
    return docs.select("doc_id", quality_column(F.col("text"), weights, threshold).alias("q")).select("doc_id", "q.*")


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    weights = bucket_weights(docs, labels)
    return docs.filter(quality_column(F.col("text"), weights, threshold)["kept"])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
