"""Proof, from key counts alone, that a join cannot multiply or lose rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderglass.functions.keys import LEADING_ZERO, join_key_columns, numeric_key, text_key
from orderglass.functions.text import percent_text, quoted
from orderglass.operators.key_sketch import SKETCH_KEYS, bottom_k, estimated_match, relative_error

# Fixed value: an order-line table must find at least this share of its rows in the order table.
MINIMUM_LINE_TO_HEADER_MATCH = 0.20
FORMAT_WARNING = (
    "Key formats may differ because leading zeros are present; values such as '001' and '1' were not "
    "treated as the same text identifier."
)
ROWS = "decimal(38,0)"


def key_counts(df: DataFrame, keys: Sequence[Column], prefix: str, weight: str | None = None) -> DataFrame:
    """Rows per key. A row with any null key part counts under the all-null key.

    With ``weight``, each row of ``df`` stands for that many rows.
    """
    names = [f"{prefix}{i}" for i in range(len(keys))]
    rows = F.col(weight) if weight else F.lit(1)
    keyed = df.select(*[key.alias(name) for key, name in zip(keys, names)], rows.cast("bigint").alias("_rows"))
    complete = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in names])
    return (
        keyed.select(*[F.when(complete, F.col(name)).alias(name) for name in names], "_rows")
        .groupBy(*names)
        .agg(F.sum("_rows").alias(f"{prefix}n"))
    )


def overlap_measures(left_known: Column, right_known: Column, left_n: Column, right_n: Column) -> list[Column]:
    """Aggregates over the full join of two key-count tables (one row per key, nulls never match)."""
    on_left, on_right = left_n.isNotNull(), right_n.isNotNull()
    matched = on_left & on_right & left_known
    growth = left_n.cast(ROWS) * (right_n - 1).cast(ROWS)

    def rows(n: Column, condition: Column | None = None) -> Column:
        value = n if condition is None else F.when(condition, n)
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return [
        rows(left_n).alias("before_row_count"),
        rows(left_n, ~left_known).alias("left_null_key_count"),
        rows(right_n, ~right_known).alias("right_null_key_count"),
        rows(left_n, left_known).alias("left_key_rows"),
        rows(right_n, right_known).alias("right_key_rows"),
        F.count_if(on_left & left_known).alias("left_distinct_keys"),
        F.count_if(on_right & right_known).alias("right_distinct_keys"),
        rows(left_n, matched).alias("matched_row_count"),
        F.count_if(matched).alias("matched_key_count"),
        F.count_if(on_right & right_known & (right_n > 1)).alias("right_duplicate_key_count"),
        rows(right_n, right_known & (right_n > 1)).alias("right_duplicate_row_count"),
        (F.count_if(matched & (left_n > 1) & (right_n > 1)) > 0).alias("many_to_many_risk"),
        F.coalesce(F.sum(F.when(matched, growth)), F.lit(0)).cast(ROWS).alias("row_count_change"),
    ]


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _percent(rate: Column) -> Column:
    return percent_text(rate)


def with_verdicts(measured: DataFrame, fact_to_fact: Column, line_to_header: Column, format_warnings: Column) -> DataFrame:
    """Rates, cardinality, risk flags and block reasons from the measures; one row per examined pair."""
    c = F.col
    rates = measured.withColumns({
        "match_rate": _share(c("matched_row_count"), c("before_row_count")),
        "distinct_overlap_rate": _share(c("matched_key_count"), c("left_distinct_keys")),
        "left_key_uniqueness": _share(c("left_distinct_keys"), c("left_key_rows")),
        "right_key_uniqueness": _share(c("right_distinct_keys"), c("right_key_rows")),
        "after_row_count": (c("before_row_count").cast(ROWS) + c("row_count_change")).cast(ROWS),
        "row_inflation": c("row_count_change") > 0,
        "fact_to_fact_risk": fact_to_fact,
        "format_warnings": format_warnings,
    })
    left_unique = (c("left_key_rows") > 0) & (c("left_key_rows") == c("left_distinct_keys"))
    right_unique = (c("right_key_rows") > 0) & (c("right_key_rows") == c("right_distinct_keys"))
    low_match = line_to_header & (c("match_rate") < MINIMUM_LINE_TO_HEADER_MATCH)
    risks = [
        (F.size("format_warnings") > 0, "key_format_mismatch", None),
        (c("right_null_key_count") > 0, "right_key_nulls", F.concat(
            F.lit("Right relationship key contains "), c("right_null_key_count").cast("string"),
            F.lit(" null key row(s)."))),
        (c("right_duplicate_key_count") > 0, "right_key_not_unique", F.concat(
            F.lit("Right key is not unique: "), c("right_duplicate_key_count").cast("string"),
            F.lit(" duplicate key group(s) across "), c("right_duplicate_row_count").cast("string"),
            F.lit(" row(s)."))),
        (c("many_to_many_risk"), "many_to_many", F.lit(
            "Many-to-many risk: at least one matched key repeats on both tables.")),
        (c("row_inflation"), "row_inflation", F.concat(
            F.lit("Dry-run left join would increase rows from "), c("before_row_count").cast("string"),
            F.lit(" to "), c("after_row_count").cast("string"), F.lit(" (+"),
            c("row_count_change").cast("string"), F.lit(")."))),
        (fact_to_fact, "fact_to_fact", F.lit(
            "Both tables are classified as fact tables; their grains may differ.")),
        (low_match, "order_line_to_header_low_match", F.concat(
            F.lit("Order-line to order-header match rate "), _percent(c("match_rate")),
            F.lit(f" is below the required {MINIMUM_LINE_TO_HEADER_MATCH:.1%}."))),
    ]
    return rates.withColumns({
        "expected_join_type": F.when(left_unique & right_unique, "one_to_one")
        .when(right_unique, "many_to_one").when(left_unique, "one_to_many").otherwise("many_to_many"),
        "risk_flags": F.array_compact(F.array(*[F.when(test, flag) for test, flag, _ in risks])),
        "block_reasons": F.array_compact(F.array(*[
            F.when(test, reason) for test, _, reason in risks if reason is not None
        ])),
    }).withColumn("blocked", F.size("block_reasons") > 0)


SAFETY_COLUMNS = (
    "match_rate", "distinct_overlap_rate", "left_key_uniqueness", "right_key_uniqueness",
    "left_null_key_count", "right_null_key_count", "right_duplicate_key_count", "right_duplicate_row_count",
    "before_row_count", "after_row_count", "row_count_change", "expected_join_type", "many_to_many_risk",
    "row_inflation", "fact_to_fact_risk", "blocked", "block_reasons", "risk_flags", "format_warnings",
    "matched_row_count",
)


def role_risks(left_role: str, right_role: str, left_entity: str, right_entity: str) -> tuple[bool, bool]:
    """Whether two facts would be joined, and whether it is the harmless line-to-order case."""
    line_to_header = left_entity == "order_line" and right_entity == "order_header"
    return left_role == "fact" and right_role == "fact" and not line_to_header, line_to_header


def leading_zero_overlap(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """One row: distinct keys shared as text and as numbers, and whether leading zeros would explain a gap."""
    def keys(df: DataFrame, name: str, side: str) -> DataFrame:
        column = quoted(name)
        forms = df.select(F.explode(F.array(
            F.struct(F.lit("text").alias("form"), text_key(column).alias("key")),
            F.struct(F.lit("numeric").alias("form"), numeric_key(column).alias("key")),
        )).alias("k")).select("k.form", "k.key").where("key is not null")
        return forms.distinct().withColumn(side, F.lit(True))

    both = keys(left, left_on, "l").join(keys(right, right_on, "r"), ["form", "key"], "full")
    shared = F.col("l") & F.col("r")
    zero = (F.col("form") == "text") & F.col("key").rlike(LEADING_ZERO)
    counts = both.agg(
        F.count_if(shared & (F.col("form") == "text")).alias("text_overlap"),
        F.count_if(shared & (F.col("form") == "numeric")).alias("numeric_overlap"),
        F.coalesce(F.bool_or(zero), F.lit(False)).alias("has_leading_zeros"),
    )
    warn = F.col("has_leading_zeros") & (F.col("numeric_overlap") > F.col("text_overlap"))
    return counts.withColumn("format_warning", F.when(warn, FORMAT_WARNING))


def join_safety(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    kinds: Sequence[str] | None = None,
    left_role: str = "unknown",
    right_role: str = "unknown",
    left_entity: str = "unknown",
    right_entity: str = "unknown",
    unicode_text: bool | None = None,
    left_weight: str | None = None,
) -> DataFrame:
    """Examine a left join without running it; one row.

    Both tables shrink to one row per key before they meet, so the key that holds a third of the rows is one
    row here. The predicted growth is a product of two counts and is kept in a wide decimal. With
    ``left_weight`` each left row stands for that many rows.
    """
    measured = measured_overlap(left, right, left_on, right_on, kinds, unicode_text, left_weight)
    fact_to_fact, line_to_header = role_risks(left_role, right_role, left_entity, right_entity)
    return with_verdicts(
        measured, F.lit(fact_to_fact), F.lit(line_to_header), F.col("format_warnings")
    ).select(*SAFETY_COLUMNS)


def measured_overlap(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    kinds: Sequence[str] | None = None,
    unicode_text: bool | None = None,
    left_weight: str | None = None,
) -> DataFrame:
    """The counts behind :func:`join_safety`, before any verdict; one row."""
    kinds = kinds or ["text"] * len(left_on)
    left_keys, right_keys = join_key_columns(left, right, left_on, right_on, kinds, unicode_text)
    counts = key_counts(left, left_keys, "l", left_weight).join(
        key_counts(right, right_keys, "r"),
        [F.col(f"l{i}") == F.col(f"r{i}") for i in range(len(left_keys))],
        "full",
    )
    measured = counts.agg(*overlap_measures(
        F.col("l0").isNotNull(), F.col("r0").isNotNull(), F.col("ln"), F.col("rn")
    ))
    # Leading zeros only exist in text columns.
    warnings = [
        leading_zero_overlap(left, right, a, b).select("format_warning").scalar()
        for a, b in zip(left_on, right_on)
        if T.StringType() in (left.schema[a].dataType, right.schema[b].dataType)
    ]
    return measured.withColumn(
        "format_warnings",
        F.array_compact(F.array(*warnings)) if warnings else F.array().cast("array<string>"),
    )


def sample_overlap(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, kind: str = "text", sketch_keys: int = SKETCH_KEYS
) -> DataFrame:
    """One row: the estimated share of left rows whose key exists on the right, from a bottom-k sample of left keys.

    The sample needs no row order, both sides rank a key alike, and the estimate's relative error is at most
    ``relative_error``; up to ``sketch_keys`` distinct keys the result is exact. Only sampled keys meet the right table.
    """
    (left_key,), (right_key,) = join_key_columns(left, right, [left_on], [right_on], [kind])
    counts = left.select(F.lit(0).alias("spec"), left_key.alias("key")).groupBy("spec", "key").agg(F.count(F.lit(1)).alias("n"))
    found = right.select(right_key.alias("key")).where("key is not null").distinct().withColumn("found", F.lit(True))
    sample = bottom_k(counts, k=sketch_keys).join(found, "key", "left").withColumn("matched", F.col("found").isNotNull())
    return estimated_match(sample, ("spec",)).drop("spec").withColumn("relative_error", F.lit(relative_error(sketch_keys)))
