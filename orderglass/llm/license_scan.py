"""License scan: ordered signature rules behind a keyword filter, with containment suppression.

A text is lower-cased (A-Z only) and cut into words; every word is kept as `` word `` so that patterns of
whole words cannot share a blank. Rules whose keyword occurs are matched; a detection inside a longer one,
or on the same words as an earlier rule, is suppressed. The base phrases are counted apart from the rules
and keep their labels whatever is suppressed.

Defined cases: a null or wordless text has n_words 0, null places, empty labels and score 0; an empty table
gives no rows; repeated rows are judged alike; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderglass.llm.common import ascii_lower, let, table
from orderglass.llm.license_rules import compiled

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced_words(text: Column) -> Column:
    """`` w1  w2  w3 `` for the words of a text, empty without words."""
    words = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, " "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _count_words(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def _base(spaced: Column, n_words: Column) -> list[Column]:
    """Per phrase: label, places, first and last start."""
    found = []
    for phrase, label in BASE.items():
        words = phrase.split(" ")
        mark = "".join(f" {w} " for w in words)
        n = ((F.length(spaced) - F.length(F.replace(spaced, F.lit(mark), F.lit("")))) / len(mark)).cast("long")
        first = _count_words(F.substring_index(spaced, mark, 1)).cast("long")
        last = (n_words - _count_words(F.substring_index(spaced, mark, -1)) - len(words)).cast("long")
        hit = F.contains(spaced, F.lit(mark))
        found.append(F.when(hit, F.struct(F.lit(label).alias("label"), n.alias("n"), first.alias("first"), last.alias("last"))))
    return found


def _rule_array() -> Column:
    rows = ", ".join(
        f"named_struct('rank', {rank}, 'label', '{label}', 'strength', {strength}D, 'keywords', split('{keyword}', '[|]'), 'pattern', '{pattern}')"
        for rank, label, strength, keyword, pattern in compiled()
    )
    return F.expr(f"array({rows})")


DETECTIONS = "array<struct<start:int,negative_end:int,rank:int,label:string,strength:double>>"
SCAN_WIDTH = 64


def _nothing() -> Column:
    return F.array().cast(DETECTIONS)


def _scanned(values: Column, op: Callable[[Column, Column], Column], body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` with a function that gives ``op`` over all values before a place (from 0), starting with 0.

    Values are scanned in groups of SCAN_WIDTH, and the groups' results again, so no array grows value by value.
    """
    zero = F.array(F.lit(0))

    def grown(acc: Column, value: Column) -> Column:
        return F.array_append(acc, op(F.element_at(acc, -1), value))

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(SCAN_WIDTH))
    groups = F.transform(starts, lambda at: F.aggregate(F.slice(values, at, F.lit(SCAN_WIDTH)), zero, grown))

    def by_group(groups: Column) -> Column:
        before = F.aggregate(F.transform(groups, lambda group: F.element_at(group, -1)), zero, grown)

        def at(before: Column) -> Column:
            group = lambda i: F.shiftright(i, 6)
            return body(lambda i: op(F.get(before, group(i)), F.get(F.get(groups, group(i)), i.bitwiseAND(F.lit(SCAN_WIDTH - 1)))))

        return let(before, at)

    return let(groups, by_group)


def _places(spaced: Column, rule: Column) -> Column:
    """Detections of one rule as (start, end, rank, label, strength), in words."""
    gaps = F.transform(F.split(spaced, rule["pattern"], -1), _count_words)
    sizes = F.transform(F.regexp_extract_all(spaced, rule["pattern"], F.lit(0)), _count_words)

    def from_parts(parts: Column) -> Column:
        steps = F.transform(parts["sizes"], lambda size, i: F.get(parts["gaps"], i) + size)

        def placed(ends_before: Callable[[Column], Column]) -> Column:
            def found(size: Column, i: Column) -> Column:
                start = ends_before(i) + F.get(parts["gaps"], i)
                return F.struct(
                    start.alias("start"), (-(start + size)).alias("negative_end"), rule["rank"].alias("rank"),
                    rule["label"].alias("label"), rule["strength"].alias("strength"),
                )

            return F.transform(parts["sizes"], found)

        return F.when(F.size(parts["sizes"]) > 0, let(steps, lambda s: _scanned(s, lambda x, y: x + y, placed))).otherwise(_nothing())

    return let(F.struct(gaps.alias("gaps"), sizes.alias("sizes")), from_parts)


def _surviving(found: Column) -> Column:
    """Detections that no longer or, on the same words, earlier one contains."""

    def in_order(found: Column) -> Column:
        def apart(reach_before: Callable[[Column], Column]) -> Column:
            return F.filter(found, lambda d, i: -d["negative_end"] > reach_before(i))

        return let(F.transform(found, lambda d: -d["negative_end"]), lambda ends: _scanned(ends, lambda x, y: F.greatest(x, y), apart))

    return F.when(F.size(found) > 0, let(F.sort_array(found), in_order)).otherwise(found)


def scan_column(text: Column) -> Column:
    """Struct of the base places, the labels, the score and the surviving detections of one text."""

    def detected(spaced: Column) -> Column:
        # The keyword filter: rules none of whose keywords is in the text are never matched.
        keywords = sorted({k for rule in compiled() for k in rule[3].split("|")})
        words = F.array_intersect(F.split(F.trim(spaced), "  "), F.array(*[F.lit(k) for k in keywords if not k.endswith("*")]))
        begun = [F.when(F.contains(spaced, F.lit(f" {k.removesuffix('*')}")), F.lit(k)) for k in keywords if k.endswith("*")]
        present = F.concat(words, F.array_compact(F.array(*begun)))

        def search(present: Column) -> Column:
            tried = F.filter(_rule_array(), lambda rule: F.arrays_overlap(present, rule["keywords"]))
            found = F.flatten(F.transform(tried, lambda rule: _places(spaced, rule)))
            return F.when(F.size(present) > 0, let(found, _surviving)).otherwise(_nothing())

        return let(present, search)

    def judge(parts: Column) -> Column:
        base, found = parts["base"], parts["found"]
        base_labels = F.array_sort(F.transform(base, lambda b: b["label"]))
        labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(found, lambda d: d["label"]))))
        sure = F.coalesce(F.array_max(F.transform(found, lambda d: d["strength"])), F.lit(0.0))
        return F.struct(
            parts["n_words"].cast("long").alias("n_words"),
            F.aggregate(base, F.lit(0).cast("long"), lambda acc, b: acc + b["n"]).alias("n_base"),
            F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"),
            F.array_max(F.transform(base, lambda b: b["last"])).alias("last_word"),
            F.array_join(base_labels, ",").alias("base_labels"),
            F.array_join(labels, ",").alias("labels"),
            F.greatest(sure, F.when(F.size(base) > 0, F.lit(0.8)).otherwise(F.lit(0.0))).alias("score"),
            F.transform(found, lambda d: F.struct(
                d["start"].alias("start"), (-d["negative_end"]).alias("end"), d["label"].alias("label"), d["rank"].alias("rule"),
            )).alias("detections"),
        )

    def parts_of(spaced: Column) -> Column:
        def with_count(n_words: Column) -> Column:
            base = F.array_compact(F.array(*_base(spaced, n_words)))
            return F.struct(n_words.alias("n_words"), base.alias("base"), detected(spaced).alias("found"))

        return let(let(_count_words(spaced), with_count), judge)

    return let(spaced_words(text), parts_of)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, labels, score and the surviving detections of every document."""
    return docs.select("doc_id", scan_column(F.col("text")).alias("scan")).select("doc_id", "scan.*")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")
