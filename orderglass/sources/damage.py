"""How damaged a table's text looks after it was decoded with the wrong encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderglass.functions.text import quoted

# Characters and sequences that wrong decoding leaves behind, and the rejection threshold.
SUSPICIOUS_CHARACTERS = "ÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞæðñþ±º»¼½¾"
DAMAGED_SEQUENCES = (
    "Ã ", "Ã¡", "Ã©", "Ã­", "Ã³", "Ãº", "Â ", "ï¿½", "éÌ", "Æ·", "±à", "ºÅ", "éÆ·", "锟斤拷",
)
DAMAGE_THRESHOLD = 0.55
# Fixed value: the absolute weights below belong to so many values.
JUDGED_VALUES = 60
REPLACEMENT = chr(0xFFFD)

_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
_RUN = r"[¡-ÿ]{4,}"


def _occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def _sequence_count(text: Column) -> Column:
    lowered = F.lower(text)
    counts = [
        ((F.length(lowered) - F.length(F.replace(lowered, F.lit(s.lower()), F.lit("")))) / len(s)).cast("bigint")
        for s in DAMAGED_SEQUENCES
    ]
    return sum(counts[1:], counts[0])


def damage_measures(text: Column) -> dict[str, Column]:
    """Counts per text that add up over a table."""
    return {
        "characters": F.length(F.regexp_replace(text, r"\s", "")).cast("bigint"),
        "replacements": (F.length(text) - F.length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))).cast("bigint"),
        "controls": _occurrences(text, _CONTROL),
        "suspicious": _occurrences(text, f"[{SUSPICIOUS_CHARACTERS}]"),
        "sequences": _sequence_count(text),
        "runs": _occurrences(text, _RUN),
    }


def damage_score(counts_total: dict[str, Column]) -> Column:
    """The weighted score, 0 to 1, from the summed counts.

    Suspicious characters, sequences and runs weigh by how many of them ``JUDGED_VALUES`` values hold on average, so
    equally damaged tables score alike at any size; a smaller table is judged by its own values.
    """
    n = F.greatest(counts_total["characters"], F.lit(1)).cast("double")
    scale = F.lit(float(JUDGED_VALUES)) / F.greatest(counts_total["present"], F.lit(JUDGED_VALUES))
    suspicious, sequences, runs = (counts_total[k] * scale for k in ("suspicious", "sequences", "runs"))

    def part(test: Column, value: Column, cap: float) -> Column:
        return F.when(test, F.least(F.lit(cap), value)).otherwise(0.0)

    c = counts_total
    score = (
        part(c["replacements"] > 0, c["replacements"] / n * 20.0, 1.0)
        + part(c["controls"] > 0, c["controls"] / n * 20.0, 0.8)
        + part(suspicious >= 4, c["suspicious"] / n * 2.5, 0.65)
        + part(sequences >= 2, sequences * 0.12, 0.7)
        + part(runs >= 2, runs * 0.12, 0.5)
    )
    return F.round(F.least(F.lit(1.0), score), 4)


def text_damage(df: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Damage score over headers and all text values, per group or for the whole table.

    Whole columns are measured, in one pass; the counts are plain sums and combine on the map side.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in groups]
    measured = {name: damage_measures(quoted(name)) for name in texts}
    keys = ("characters", "replacements", "controls", "suspicious", "sequences", "runs")
    headers = damage_measures(F.lit(" ".join(df.columns)))
    header_row = df.sparkSession.range(1).select(*[headers[k].alias(k) for k in keys]).first()
    summed = df.groupBy(*map(quoted, groups)).agg(*[
        (F.lit(header_row[k]) + F.coalesce(
            F.sum(sum((F.coalesce(measured[name][k], F.lit(0)) for name in texts), F.lit(0))), F.lit(0)
        )).alias(k)
        for k in keys
    ], sum((F.count(quoted(name)) for name in texts), F.lit(0)).alias("present"))
    score = damage_score({k: F.col(k) for k in (*keys, "present")})
    return summed.withColumn("damage_score", score).drop("present").withColumn("looks_damaged", F.col("damage_score") >= DAMAGE_THRESHOLD)


def require_readable(df: DataFrame, path: str = "") -> DataFrame:
    """``df`` itself, or an error when its text looks wrongly decoded."""
    score = text_damage(df).first()["damage_score"]
    if score >= DAMAGE_THRESHOLD:
        raise ValueError(
            f"The text of {path or 'the table'} looks wrongly decoded (damage score {score:.2f}). "
            "Read it with another encoding or save it as UTF-8."
        )
    return df
