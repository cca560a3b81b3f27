"""Ranked lexical search of test items over all documents, by presence masks of the matched terms.

Documents shrink to their postings: the terms of the items that they hold, with frequencies. Statistics of all
documents give each term its weight. A task then takes its documents in blocks. Within a block each term has a bitmap
of the documents that hold it; stacked, an item's bitmaps give each document the mask of the terms that it matches,
and equal masks are one group. A mask's ceiling is the sum of the most that each of its terms adds to any document of
the block. Masks are evaluated by falling ceiling, documents exactly, until the item's best documents so far are all
above the next ceiling. A task returns the best documents per item, and the best of these are the result.

Items are taken in blocks of at most ``BLOCK_TERMS`` terms (or one item), which bounds what is sent to each executor;
documents are read once per block of items. Nothing is collected but statistics of a block's terms.

Defined cases: a null text has no terms, such documents are not counted; an item without terms finds nothing; rows
that share an item_id (null as well) are one item with the terms of all; rows that repeat a doc_id are ranked each,
rows without doc_id come after others of the same score; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderglass.llm.common import ascii_lower, table
from orderglass.llm.decontamination import BETWEEN, plain_words
from orderglass.session import stage

TOP = 10
BLOCK_TERMS = 50_000
#: Documents, postings, and cells of an item's stacked bitmaps that are held at once.
BLOCK_DOCS, BLOCK_POSTINGS, BLOCK_CELLS = 8192, 2_000_000, 16_000_000
#: Fixed values of the score.
WEIGHT_SCALE, TF_SCALE, TF_UNIT, LENGTH_SHARE, LENGTH_UNIT, SATURATION = 1000, 1_000_000_000, 1000, 90, 100, 8
SALTS = 16


def term_weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


class _Block:
    """The postings of some documents by term: bitmaps, what each posting adds to a score, and each term's most."""

    def __init__(self, docs: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, words: int) -> None:
        self.docs, self.count = docs, len(docs)
        own = np.repeat(np.arange(self.count), sizes)
        length = (LENGTH_UNIT - LENGTH_SHARE) + (LENGTH_SHARE * n * documents) // max(words, 1)
        adds = weights[terms] * ((TF_SCALE * tf) // (TF_UNIT * tf + SATURATION * length[own]))
        order = np.argsort(terms, kind="stable")
        self.adds = adds[order]
        held, first = np.unique(terms[order], return_index=True)
        self.row = np.full(len(weights), -1)
        self.row[held] = np.arange(len(held))
        at = own[order]
        of = self.row[terms[order]]
        self.place = of * self.count + at  # rising: by term, then document
        self.bitmaps = np.zeros((len(held), -(-self.count // 8)), dtype=np.uint8)
        np.bitwise_or.at(self.bitmaps, (of, at >> 3), (128 >> (at & 7)).astype(np.uint8))
        self.most = np.maximum.reduceat(self.adds, first) if len(held) else np.zeros(0, dtype=np.int64)

    def masks(self, rows: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Ceiling of each distinct mask of the documents low..high, and the mask of each document."""
        bits = np.unpackbits(self.bitmaps[rows, low // 8 : -(-high // 8)], axis=1, count=high - low)
        packed = np.packbits(bits, axis=0)
        wide = np.zeros((-(-len(packed) // 8) * 8, high - low), dtype=np.uint8)
        wide[: len(packed)] = packed
        words = np.ascontiguousarray(wide.T).view(np.uint64)
        _, first, mask = np.unique(words[:, 0], return_index=True, return_inverse=True)
        for k in range(1, words.shape[1]):  # groups split further by each 64 terms
            _, part = np.unique(words[:, k], return_inverse=True)
            _, first, mask = np.unique(mask * (high - low) + part, return_index=True, return_inverse=True)
        return self.most[rows] @ bits[:, first].astype(np.int64), mask

    def scores(self, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        wanted = rows[:, None] * self.count + docs[None, :]
        at = np.minimum(np.searchsorted(self.place, wanted), len(self.place) - 1)
        return np.where(self.place[at] == wanted, self.adds[at], 0).sum(axis=0)


def _better(found: list[tuple], scores: np.ndarray, docs: list, top: int) -> list[tuple]:
    """The best ``top`` of what was found and new documents: (-score, without id, doc_id)."""
    return sorted([*found, *((-s, d is None, d or 0) for s, d in zip(scores.tolist(), docs, strict=True))])[:top]


def search_block(block: _Block, terms: np.ndarray, found: list[tuple], top: int) -> list[tuple]:
    """The best documents of an item, from those found before and the block's."""
    rows = block.row[terms]
    rows = rows[rows >= 0]
    if not len(rows):
        return found
    width = max(8, min(block.count, BLOCK_CELLS // len(rows)) // 8 * 8)
    for low in range(0, block.count, width):
        high = min(low + width, block.count)
        ceilings, mask = block.masks(rows, low, high)
        order = np.argsort(-ceilings, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        by_mask = np.argsort(rank[mask], kind="stable")
        ends = np.cumsum(np.bincount(rank[mask], minlength=len(order)))
        falling = ceilings[order]
        at = done = 0
        step = 2 * top
        while at < len(order):
            least = -found[-1][0] if len(found) == top else 1
            # Masks up to the next ``step`` documents, as far as their ceilings can still matter.
            to = min(int(np.searchsorted(ends, done + step)) + 1, int(np.searchsorted(-falling, -least, side="right")), len(order))
            if to <= at:
                break
            docs = by_mask[done : ends[to - 1]] + low
            scores = block.scores(rows, docs)
            good = np.flatnonzero(scores >= least)
            found = _better(found, scores[good], [block.docs[d] for d in docs[good].tolist()], top)
            at, done, step = to, int(ends[to - 1]), 2 * step
    return found


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the terms of the vocabulary that the document holds, with frequencies."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the block of items

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for data in batch.column("data"):
                words = plain_words(data.as_py())
                codes = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                held, tf = np.unique(codes[codes >= 0], return_counts=True)
                sizes.append(len(words))
                terms.append(held.astype(np.int32))
                counts.append(tf.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "tf"],
            )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    result = stage(given.mapInArrow(read, "doc_id long, n long, terms array<int>, tf array<long>").filter("n > 0"), "search-postings")
    sent.unpersist()
    return result


def _best(postings: DataFrame, items: list[tuple], weights: np.ndarray, documents: int, words: int, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item."""
    sent = postings.sparkSession.sparkContext.broadcast((items, weights))  # bounded by the block of items

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        best: list[list[tuple]] = [[] for _ in items]

        def take(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            n, terms, tf = (rows.column(c).combine_chunks() for c in ("n", "terms", "tf"))
            block = _Block(
                rows.column("doc_id").to_pylist(), n.to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy(),
                tf.flatten().to_numpy(), weights, documents, words,
            )
            for i, (_, wanted) in enumerate(items):
                best[i] = search_block(block, wanted, best[i], top)

        held, size = [], 0
        for batch in batches:
            sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            low = 0
            while low < batch.num_rows:  # a block ends with BLOCK_DOCS documents or the one that fills BLOCK_POSTINGS
                room = BLOCK_DOCS - sum(b.num_rows for b in held)
                fits = int(np.searchsorted(np.cumsum(sizes[low:]), BLOCK_POSTINGS - size)) + 1
                high = min(batch.num_rows, low + min(room, fits))
                held.append(batch.slice(low, high - low))
                size += int(sizes[low:high].sum())
                if size >= BLOCK_POSTINGS or sum(b.num_rows for b in held) >= BLOCK_DOCS:
                    take(held)
                    held, size = [], 0
                low = high
        if held:
            take(held)
        rows = [(name, None if none else doc, -minus) for (name, _), found in zip(items, best, strict=True) for minus, none, doc in found]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"]
        )

    result = stage(postings.mapInArrow(search, "item string, doc_id long, score long"), "search-best")
    sent.unpersist()
    return result


def _item_blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """(item, distinct terms) of all items that have terms, in blocks of bounded size."""
    words = F.array_distinct(F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), BETWEEN), ""))
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.explode(words).alias("term"))
    sets = stage(rows.groupBy("item").agg(F.collect_set("term").alias("terms")), "search-items")  # one item's terms
    held, size = [], 0
    for row in sets.toLocalIterator():  # one partition at a time
        if held and size + len(row["terms"]) > block_terms:
            yield held
            held, size = [], 0
        held.append((row["item"], row["terms"]))
        size += len(row["terms"])
    if held:
        yield held


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the best ``top`` documents of each item."""
    found = None
    for block in _item_blocks(items, block_terms):
        vocabulary: dict[bytes, int] = {}
        wanted = [(item, np.array([vocabulary.setdefault(t.encode(), len(vocabulary)) for t in terms], dtype=np.int64)) for item, terms in block]
        postings = _postings(docs, vocabulary)
        documents, words = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for row in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toLocalIterator():
            weights[row["term"]] = term_weight(documents, row["n"])
        best = _best(postings, wanted, weights, documents, words, top)
        found = best if found is None else found.unionAll(best)
    kind = items.schema["item_id"].dataType
    if found is None:
        found = items.sparkSession.createDataFrame([], "item string, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # The rows of one item are one list per task: the best of salted groups first.
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(words)) AS BIGINT) AS words FROM texts WHERE len(words) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), held AS (
  SELECT r, doc_id, CAST(n AS BIGINT) AS n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM texts) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term
), adds AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))) AS points
  FROM held JOIN weights USING (term), totals
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(points) AS BIGINT) AS score FROM asked JOIN adds USING (term) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) QUALIFY row_number() OVER best <= 10
"""
