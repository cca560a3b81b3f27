"""Language identification: known words first, then progressively shorter character n-grams.

A word seen in training scores by its log frequency per language. An unseen word scores by its character
n-grams of the greatest length of which any is known, down to single characters. A document's language is
the one with the greatest sum over all its words.

Training reads a bounded sample: about ``sample`` labelled documents per language, chosen by hash among the given
ones. All their words and n-grams are kept; the sample alone bounds the model. Prediction reads every whole text and
nothing but the text.

Defined cases: a null text, one without letters, or a model without languages gives ``und`` and score 0; ties
go to the first language in order; repeated rows are judged alike; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderglass.llm.common import table
from orderglass.session import stage

SAMPLE = 3000
LONGEST = 5
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 200_000


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies per language of words (n = 0) and of n-grams by length: a row per entry."""

    def __init__(self, languages: list[str], places: dict[int, dict[str, int]], scores: dict[int, np.ndarray]) -> None:
        self.languages, self.places, self.scores = languages, places, scores

    @classmethod
    def of_counts(cls, languages: list[str], tables: dict[int, tuple[list[str], np.ndarray]]) -> Model:
        """``tables``: per length the entries and their counts, a row per entry and a column per language."""
        places, scores = {}, {}
        for n, (entries, seen) in tables.items():
            places[n] = {gram: i for i, gram in enumerate(entries)}
            scores[n] = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * (len(entries) + 1)))
        return cls(languages, places, scores)

    def word(self, word: str) -> np.ndarray | None:
        """Scores of one lower-case word, or None if nothing of it is known."""
        known = self.places[0].get(word)
        if known is not None:
            return self.scores[0][known]
        for n in range(LONGEST, 0, -1):
            rows = [g for g in map(self.places[n].get, _grams(word, n)) if g is not None]
            if rows:
                return self.scores[n][rows].mean(axis=0)
        return None


class _Scorer:
    """Scores of texts, remembering the words met so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.languages)))

    def _place(self, word: str) -> int:
        at = len(self.place)
        if at == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        found = self.model.word(word)
        self.scores[at] = 0 if found is None else found
        self.place[word] = at
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        # Word characters beyond letters (fractions, raised digits) are no letters by themselves.
        if not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        if len(self.place) > _REMEMBERED:
            self._clear()
        place = self.place
        at = [place[w] if w in place else self._place(w) for w in words]
        total = self.scores[at].sum(axis=0)
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(np.clip(total - total[best], -50, 0)).sum())


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from text and lang of ``docs``: all words and n-grams of about ``sample`` documents per language.

    Languages are numbered, so any text may be the name of one.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_language = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(per_language)
    if not languages:
        return Model.of_counts([], {n: ([], np.zeros((0, 0))) for n in range(LONGEST + 1)})
    facts = F.element_at(F.create_map(*[
        F.struct(F.lit(i).alias("number"), F.lit(min(1.0, sample / per_language[k])).alias("share")) if half else F.lit(k)
        for i, k in enumerate(languages) for half in (0, 1)
    ]), F.col("lang"))
    chosen = known.withColumn("fact", facts).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("fact.share") * 1_000_000)
    words = chosen.select(F.col("fact.number").alias("number"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("gram"))
    counted = stage(words.groupBy("number", "gram").agg(F.count("*").alias("n")), "language-words")
    marked = F.concat(F.lit("<"), F.col("gram"), F.lit(">"))
    tables = {}
    for n in range(LONGEST + 1):
        if n:
            text = marked if n > 1 else F.col("gram")
            starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
            grams = counted.select("number", F.explode(F.transform(starts, lambda i, t=text: F.substring(t, i, F.lit(n)))).alias("gram"), "n")
        else:
            grams = counted
        per = grams.groupBy("gram").agg(F.array(*(
            F.sum(F.when(F.col("number") == i, F.col("n")).otherwise(0)) for i in range(len(languages))
        )).alias("counts"))
        found = per.toArrow()  # bounded by the sample
        counts = found.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        tables[n] = found.column("gram").to_pylist(), counts.reshape(-1, len(languages))
    return Model.of_counts(languages, tables)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    # Its size is bounded by the sample of labelled documents.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.places, model.scores))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(Model(*shared.value))
        for batch in batches:
            found = [scorer(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.filter(~held_out(F.col("doc_id")))))
