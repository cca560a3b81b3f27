"""Recommendation of a source column for each standard order field.

Every (field, column) is a row with its points. Names meet fields through an index of phrases; what the values read as
comes from one aggregate over the table. Fields and columns are then matched in rounds: each round takes the rows that
are the best of their field and of their column, which gives the same result as taking the best row of all again and
again.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderglass import vocabulary as words
from orderglass.operators import mapping as mp
from orderglass.operators.profile import mapping_evidence
from orderglass.session import stage

# ---- Fixed values: points ------------------------------------------------------------------------------------
CONTEXT_POINTS, RATE_POINTS, ENTITY_POINTS, FOREIGN_ENTITY, KEY_AS_NAME = 10.0, 15.0, 20.0, -70.0, -45.0
#: Deduction where a field's name is only part of the column's.
PARTIAL_NAME = 8.0
#: Highest score of a column most of whose values do not read as the field's type.
UNREADABLE = 45.0
DISPLAY_FIELDS = ("customer_name", "product_name", "category", "store_name")
NAMED_FIELDS = ("store_id", "store_name")
#: What stands in for a field without a column: strategy, score, reason.
SUBSTITUTES = {
    "discount_rate": ("default_zero", 55.0, (
        "No compatible discount field was found. A default of 0 is available, but it must be confirmed because it "
        "asserts that no discount was applied.")),
    "returned": ("not_provided", 55.0, (
        "No compatible returned field was found. The values stay unknown; this does not mean no orders were returned.")),
    "customer_id": ("not_provided", 55.0, (
        "No customer identifier was found. Customer analysis can be skipped without inventing identifiers.")),
}
NOTHING_FOUND = "No source column met the minimum recommendation threshold."

_HAN = re.compile("[一-鿿]")
PARTS = ("column_name_alias", "business_context", "semantic_type", "sample_value_compatibility", "entity_role_consistency", "identifier_display_penalty")


def _phrases(name: str) -> set[str]:
    """Every run of whole words of a name and, as Chinese has no spaces, every part of a Chinese name."""
    parts = words.normalized(name).split()
    found = {" ".join(parts[a:b]) for a in range(len(parts)) for b in range(a + 1, len(parts) + 1)}
    if _HAN.search(name):
        run = "".join(parts)
        found |= {part for a in range(len(run)) for b in range(a + 1, len(run) + 1) if _HAN.search(part := run[a:b])}
    return found


def _phrase(text: str) -> str:
    text = words.normalized(text)
    return text.replace(" ", "") if _HAN.search(text) else text


def _field_table(spark: SparkSession) -> DataFrame:
    rows = []
    for place, field in enumerate(mp.STANDARD_FIELDS):
        required = field in mp.REQUIRED_FIELDS
        kind = mp.FIELD_TYPES[field]
        reads = "numeric_rate" if kind in mp.NUMBER_TYPES else {"date": "date_rate", "boolean": "boolean_rate"}.get(kind, "text_rate")
        rows.append((place, field, required, kind, reads, mp.FIELD_ENTITIES.get(field), *SUBSTITUTES.get(
            field, ("unmapped" if required else "omit", 0.0, NOTHING_FOUND))))
    return spark.createDataFrame(
        rows, "place int, field string, required boolean, kind string, reads string, entity string, substitute string, substitute_score double, substitute_reason string"
    )


def _field_phrases(spark: SparkSession) -> DataFrame:
    """(phrase, field, points of a name, whether it is a context word)."""
    names = {(_phrase(text), field): float(points) for field, texts in mp.FIELD_NAMES.items() for text, points in texts.items()}
    for field, entity in mp.IDENTIFIER_FIELDS.items():
        for text in words.IDENTIFIER_NAMES[entity]:
            names.setdefault((_phrase(text), field), float(mp.SHARED_IDENTIFIER_POINTS))
    rows = [(phrase, field, points, False) for (phrase, field), points in names.items()]
    rows += [(_phrase(text), field, 0.0, True) for field, texts in mp.FIELD_CONTEXTS.items() for text in texts]
    return spark.createDataFrame(rows, "phrase string, field string, points double, context boolean")


def _column_table(spark: SparkSession, columns: Sequence[str], entities: Mapping[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """One row per column with what its name says, and the phrases of its name: the column's own and with its table's."""
    rows, phrases = [], []
    for place, column in enumerate(columns):
        local = column.rsplit(".", 1)[-1]
        rows.append((place, column, mp.source_entity(column, entities), words.is_key_like(local)))
        phrases += [(column, phrase, False, phrase == _phrase(local)) for phrase in _phrases(local)]
        phrases += [(column, phrase, True, False) for phrase in _phrases(column)]
    return (
        spark.createDataFrame(rows, "column_place int, column_name string, column_entity string, names_a_key boolean"),
        spark.createDataFrame(phrases, "column_name string, phrase string, context boolean, whole boolean"),
    )


def field_scores(df: DataFrame, entities: Mapping[str, str] | None = None) -> DataFrame:
    """Points (0-100) of every column of ``df`` for every standard field, and their parts."""
    spark, c = df.sparkSession, F.col
    columns, column_phrases = _column_table(spark, df.columns, entities)
    met = column_phrases.join(_field_phrases(spark), ["phrase", "context"]).groupBy("field", "column_name").agg(
        # A name that fits as a whole counts as it is; of partial ones the best counts.
        F.coalesce(F.max(F.when(c("whole"), c("points"))), F.max(F.when(~c("context"), c("points") - PARTIAL_NAME)), F.lit(0.0)).alias("alias"),
        F.bool_or("context").alias("in_context"),
    )
    evidence = columns.join(mapping_evidence(df), "column_name")
    fields = F.array(*(F.lit(field) for field in mp.STANDARD_FIELDS))
    rows = evidence.withColumn("field", F.explode(fields)).join(_field_table(spark), "field").join(met, ["field", "column_name"], "left")
    rate = sum((F.when(c("reads") == name, c(name)).otherwise(0.0) for name in ("numeric_rate", "date_rate", "boolean_rate", "text_rate")), F.lit(0.0))
    rows = rows.withColumns({"rate": rate, "alias": F.coalesce("alias", F.lit(0.0))})
    points = dict(zip(PARTS, (
        c("alias"), F.when(c("in_context"), CONTEXT_POINTS).otherwise(0.0),
        F.round(RATE_POINTS * c("rate"), 2), F.round(RATE_POINTS * c("rate"), 2),
        F.when(c("column_entity") == c("entity"), ENTITY_POINTS)
        .when(c("entity").isNotNull() & c("column_entity").isin(*mp.KNOWN_ENTITIES), FOREIGN_ENTITY).otherwise(0.0),
        F.when(c("names_a_key") & c("field").isin(*DISPLAY_FIELDS), KEY_AS_NAME).otherwise(0.0),
    ), strict=True))
    limits = F.least(
        F.lit(100.0), F.when(c("field").isin(*NAMED_FIELDS) & (c("alias") == 0), mp.RECOMMENDATION_THRESHOLD - 1),
        F.when((c("reads") != "text_rate") & (c("present_count") > 0) & (c("rate") < 0.5), UNREADABLE),
    )
    total = reduce(Column.__add__, points.values())
    share = F.concat(F.round(100 * c("rate"), 0).cast("int").cast("string"), F.lit("%"))
    reason = F.concat(
        F.lit("The name counts "), c("alias").cast("int").cast("string"), F.lit(" points, its context "),
        points["business_context"].cast("int").cast("string"), F.lit("; "), share, F.lit(" of the values read as "), c("kind"),
        F.lit("; the column belongs to entity "), c("column_entity"), F.lit("."),
    )
    return rows.select(
        "place", "field", "required", "kind", "column_place", "column_name",
        F.round(F.greatest(F.lit(0.0), F.least(total, limits)), 2).alias("score"),
        F.create_map(*(item for name, value in points.items() for item in (F.lit(name), value))).alias("parts"), reason.alias("reason"),
    )


def one_to_one(scores: DataFrame, left: str, right: str, order: Column) -> DataFrame:
    """Rows of ``scores`` so that each left and each right value occurs once at most, the least of ``order`` first.

    ``order`` must tell all rows apart. Each round settles at least the least row of all, mostly many more.
    """
    rest, chosen = stage(scores.withColumn("_order", order), "scores"), []
    while True:
        first = [F.col("_order") == F.min("_order").over(Window.partitionBy(side)) for side in (left, right)]
        best = stage(rest.withColumns({"_l": first[0], "_r": first[1]}).where("_l and _r").drop("_l", "_r"), "matched")
        if best.isEmpty():
            return reduce(DataFrame.unionByName, [*chosen, best]).drop("_order")
        chosen.append(best)
        rest = stage(rest.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti"), "scores")


def recommend_fields(df: DataFrame, entities: Mapping[str, str] | None = None) -> DataFrame:
    """A source column or a substitute per standard field, each column used once; best scores are given out first."""
    good = field_scores(df, entities).where(F.col("score") >= mp.RECOMMENDATION_THRESHOLD)
    # Of equal scores a required field comes first, then the later field name, then the earlier column.
    order = F.struct((-F.col("score")).alias("score"), (~F.col("required")).alias("optional"), (-F.col("name_place")).alias("name"), "column_place")
    places = {field: place for place, field in enumerate(sorted(mp.STANDARD_FIELDS))}
    placed = good.withColumn("name_place", F.element_at(F.create_map(*(F.lit(x) for item in places.items() for x in item)), F.col("field")))
    found = one_to_one(placed, "field", "column_name", order).select("field", "column_name", "score", "parts", "reason")
    joined = _field_table(df.sparkSession).join(found, "field", "left")
    c = F.col
    none = F.create_map(*(item for name in PARTS for item in (F.lit(name), F.lit(0.0))))
    return joined.orderBy("place").select(
        c("field").alias("standard_field"), "required", c("kind").alias("target_type"),
        F.when(c("column_name").isNotNull(), "source").otherwise(c("substitute")).alias("recommended_strategy"),
        c("column_name").alias("recommended_source"), F.coalesce("score", "substitute_score").alias("confidence_score"),
        F.coalesce("parts", none).alias("score_breakdown"), F.coalesce("reason", "substitute_reason").alias("explanation"),
    )


def choices_from(recommendations: DataFrame, confirmed: bool = False) -> list[mp.FieldChoice]:
    """The recommended mapping, one choice per standard field."""
    return [
        mp.FieldChoice(r["standard_field"], r["recommended_strategy"], r["recommended_source"], confirmed) for r in recommendations.collect()
    ]
