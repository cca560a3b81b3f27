import math
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from orderglass.llm.filter_audit import audit_filters, failure_counts, filter_steps

LABELS = "doc_id long, quality int, toxic int, kept string"


def failures(doc, text, texts):
    words = (text or "").encode("utf-8").split()
    body = text or ""
    found = ["A"] * (len(words) < 200) + ["B"] * (100 * len(set(words)) < 50 * len(words))
    found += ["C"] * (100 * sum("A" <= c <= "Z" for c in body) > 3 * len(body)) + ["D"] * any(c in "#$%&*|" for c in body)
    smaller = doc is not None and any(i is not None and i < doc and (t or "") == body for i, t in texts)
    return set(found + ["E"] * smaller)


def brute(rows, labels):
    """Every step by running every order over every document."""
    texts = [(row[0], row[1]) for row in rows]
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    parts, expected = {}, {}
    for doc, text, lang in rows:
        parts.setdefault(lang or "", []).append((failures(doc, text, texts), doc in good, doc in toxic))
    for part, members in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(members)
            for step, own in enumerate(order, 1):
                gone = [m for m in left if own in m[0]]
                left = [m for m in left if own not in m[0]]
                shapley[own] += len(gone)
                expected[part, order, step] = [
                    len(left), len(gone), sum(own in m[0] for m in members) - len(gone), sum(m[0] == {own} for m in members),
                    sum(m[1] for m in gone), sum(m[2] for m in gone),
                ]
        for (of, order, step), row in expected.items():
            if of == part:
                row.append(shapley[order[step - 1]])
    return expected


def result(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[name] for name in names] for r in df.collect()}


def test_audit_against_brute_force(spark, docs_of, odd):
    prose = " ".join(f"w{i}" for i in range(250))
    rows = [(*row, "en") for row in odd] + [
        (20, prose, None), (21, prose, ""), (22, prose.upper(), "de"), (22, prose.upper(), "de"), (19, prose + " #", "de"),
        (24, "a b " * 150, "de"), (25, "A | b " * 150, "fr"), (None, prose, "fr"), (-3, prose, "fr"), (26, "É" * 10 + " |", "fr"),
        (27, "A" * 3 + "b" * 97, "fr"), (28, "A" * 4 + "b" * 96, "fr"), (30, "same", "de"),
    ]
    labels = [(20, 1, 0, "x"), (20, 1, 1, "x"), (20, 0, 0, "x"), (22, 1, None, "x"), (25, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (6, 1, 0, "x")]
    docs = docs_of([(doc, text, lang, "s") for doc, text, lang in rows])
    found = audit_filters(docs, spark.createDataFrame(labels, LABELS))
    assert result(found) == brute(rows, labels)
    assert dict(found.dtypes) == {
        "part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(
            ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint"),
    }


def test_audit_of_nothing(spark, docs_of):
    assert audit_filters(docs_of([]), spark.createDataFrame([], LABELS)).count() == 0


def test_copies_of_a_text_in_one_large_group(spark, docs_of):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"),
    )
    counts = {r["fails"]: r["n"] for r in failure_counts(docs, spark.createDataFrame([], LABELS)).collect()}
    assert counts == {0b00001: 20_001, 0b10001: 9_999}


@pytest.mark.parametrize("filters", ["A", "AB", "ABC"])
def test_shapley_of_other_numbers_of_filters(spark, filters):
    everyone = 1 << len(filters)
    counts = spark.createDataFrame([("p", s, 3 * s + 1, 0, 0) for s in range(everyone)], "part string, fails int, n long, good long, toxic long")
    found = {(r["filter_order"][r["step"] - 1]): r["shapley"] for r in filter_steps(counts, filters).collect()}
    for i, name in enumerate(filters):
        shares = sum((3 * s + 1) / bin(s).count("1") for s in range(everyone) if s >> i & 1)
        assert found[name] == round(shares * math.factorial(len(filters)))
