"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items become words, and a block of items one suffix automaton over words, which holds every substring of every item
once. A document's words are streamed through it; after each word the automaton knows the longest suffix read so far
that some item holds. As soon as that is a window long, its words are hit, and the state tells the items. Stretches
whose neighbouring words never stand together in an item cannot hold a window and are not walked.

A block holds at most ``BLOCK_WORDS`` item words, and so its automaton at most twice as many states and three times as
many arrows, which bounds what is sent to each executor; items are read block by block, and longer items are cut into
segments that overlap by a window less one word. All documents are read once per block; only documents with hits are
merged. Documents are never shuffled while there is one block.

Defined cases: a null text has no words and no hits; an item without words has no windows; one of fewer words than a
window is a window of its own; rows that share an item_id are one item, a null item_id is the item ''; rows that
repeat a doc_id are judged each by its text; no documents give no rows; no items leave all documents clean; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderglass.llm.common import ascii_lower, table
from orderglass.session import stage

WINDOW = 10
BLOCK_WORDS = 100_000
SEGMENT_WORDS = 20_000
#: Separators of words, once A-Z is lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
FOUND = "doc_id long, th long, n_words long, longest long, spans array<struct<begin:long,end:long>>, items array<string>"


def plain_words(data: bytes | None) -> list[bytes]:
    """Words of UTF-8 text: runs of letters and digits, A-Z lower-cased, and of everything beyond ASCII."""
    return (data or b"").translate(_PLAIN).split()


def suffix_automaton(sequences: Iterable[list[int]]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Arrows, suffix links and lengths of the states that hold all substrings of ``sequences``; 0 is the empty one."""
    arrows: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def state(size: int, out: dict[int, int], up: int) -> int:
        arrows.append(out)
        link.append(up)
        length.append(size)
        return len(arrows) - 1

    def exact(p: int, word: int) -> int:
        """The state of p's longest string and ``word``, split off its longer ones if need be."""
        q = arrows[p][word]
        if length[q] == length[p] + 1:
            return q
        part = state(length[p] + 1, dict(arrows[q]), link[q])
        link[q] = part
        while p >= 0 and arrows[p].get(word) == q:
            arrows[p][word] = part
            p = link[p]
        return part

    for sequence in sequences:
        last = 0
        for word in sequence:
            if word in arrows[last]:
                last = exact(last, word)
                continue
            fresh = state(length[last] + 1, {}, 0)
            p = last
            while p >= 0 and word not in arrows[p]:
                arrows[p][word] = fresh
                p = link[p]
            if p >= 0:
                link[fresh] = exact(p, word)
            last = fresh
    return arrows, link, length


def item_tables(segments: list[tuple[str, list[str]]], window: int) -> dict:
    """What tasks need to match a block of (item id, words) segments."""
    vocabulary: dict[bytes, int] = {}
    coded = [[vocabulary.setdefault(w.encode(), len(vocabulary)) for w in words] for _, words in segments]
    arrows, link, length = suffix_automaton(coded)
    # The state that holds the last ``window`` words of a longer match.
    cut = list(range(len(link)))
    for s in np.argsort(length, kind="stable")[1:].tolist():
        if length[link[s]] >= window:
            cut[s] = cut[link[s]]
    names = sorted({name for name, _ in segments})
    number = {name: i for i, name in enumerate(names)}
    holders: dict[int, set[int]] = {}
    short: dict[int, list[tuple[int, int]]] = {}  # items below a window: state -> (words, item)
    for (name, _), codes in zip(segments, coded, strict=True):
        at = 0
        for place, code in enumerate(codes, 1):
            at = arrows[at][code]
            if place >= window:
                holders.setdefault(cut[at], set()).add(number[name])
        if 0 < len(codes) < window:
            short.setdefault(at, []).append((len(codes), number[name]))
    near = list(range(len(link)))  # the next state, itself first, that ends such an item; there are window - 1 at most
    for s in np.argsort(length, kind="stable").tolist():
        if s not in short:
            near[s] = near[link[s]] if s else 0
    size = max(len(vocabulary), 1)
    pairs = {a * size + b for codes in coded for a, b in zip(codes, codes[1:], strict=False)}
    return {
        "window": window, "least": min((min(len(c), window) for c in coded if c), default=window), "vocabulary": vocabulary,
        "pairs": np.array(sorted(pairs), dtype=np.int64), "go": {s * size + w: t for s, out in enumerate(arrows) for w, t in out.items()},
        "link": link, "length": length, "cut": cut, "near": near, "names": names,
        "holders": {s: sorted(items) for s, items in holders.items()}, "short": short,
    }


def match_words(words: list[bytes], tables: dict) -> tuple[list[tuple[int, int]], list[str], int]:
    """Hit spans (sorted, apart), sorted names of the items, and the words of the longest match."""
    vocabulary, window = tables["vocabulary"], tables["window"]
    codes = np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    pairs, size = tables["pairs"], max(len(vocabulary), 1)
    # Stretches in which all neighbours stand together in some item.
    known = codes >= 0
    chained = np.zeros(len(codes) + 1, dtype=bool)  # chained[i]: i - 1 and i go together
    both = np.flatnonzero(known[:-1] & known[1:])
    if len(both) and len(pairs):
        code = codes[both] * size + codes[both + 1]
        chained[both[pairs[np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)] == code] + 1] = True
    begins = np.flatnonzero(known & ~chained[:-1])
    ends = np.flatnonzero(known & ~chained[1:]) + 1
    wide = ends - begins >= tables["least"]
    go, link, length, cut, near, short = (tables[name] for name in ("go", "link", "length", "cut", "near", "short"))
    spans: list[tuple[int, int]] = []
    states: set[int] = set()
    found: set[int] = set()
    longest = 0
    for begin, end in zip(begins[wide].tolist(), ends[wide].tolist(), strict=True):
        at = matched = 0
        for place, code in enumerate(codes[begin:end].tolist(), begin + 1):
            to = go.get(at * size + code)
            while to is None and at:
                at = link[at]
                matched = length[at]
                to = go.get(at * size + code)
            if to is None:
                continue
            at, matched = to, matched + 1
            if matched >= window:
                states.add(cut[at])
                longest = max(longest, matched)
                if spans and spans[-1][1] >= place - matched:
                    spans[-1] = (min(spans[-1][0], place - matched), place)
                else:
                    spans.append((place - matched, place))
            if short:
                up = near[at]
                while up:
                    for n, item in short[up]:
                        if n <= matched:
                            found.add(item)
                            spans.append((place - n, place))
                            longest = max(longest, n)
                    up = near[link[up]]
    for s in states:
        found.update(tables["holders"][s])
    return _merged(spans), [tables["names"][i] for i in sorted(found)], longest


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    apart: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if apart and begin <= apart[-1][1]:
            apart[-1] = (apart[-1][0], max(end, apart[-1][1]))
        else:
            apart.append((begin, end))
    return apart


def _blocks(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Segments of the items in blocks of bounded size; at least one block, be it empty."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), BETWEEN), "")
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).filter("size(words) > 0")
    length = min(SEGMENT_WORDS, block_words)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)), F.lit(length)))
    segments = stage(
        rows.select("item", "words", start.alias("start")).select("item", F.slice("words", F.col("start"), F.lit(length + window - 1)).alias("words")).distinct(),
        "benchmark-segments",
    )
    held, size, any_ = [], 0, False
    for row in segments.toLocalIterator():  # one partition at a time
        if held and size + len(row["words"]) > block_words:
            yield held
            held, size, any_ = [], 0, True
        held.append((row["item"], row["words"]))
        size += len(row["words"])
    if held or not any_:
        yield held


def _scanned(docs: DataFrame, tables: dict, hits_only: bool) -> DataFrame:
    """One pass of all documents through one automaton."""
    sent = docs.sparkSession.sparkContext.broadcast(tables)  # bounded by the block
    kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for batch in batches:
            rows = []
            for doc, th, data in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("data"), strict=True):
                words = plain_words(data.as_py())
                spans, items, longest = match_words(words, tables)
                if spans or not hits_only:
                    rows.append((doc, th, len(words), longest, [{"begin": a, "end": b} for a, b in spans], items))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "th", "n_words", "longest", "spans", "items"]
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("data"))
    result = stage(given.mapInArrow(scan, FOUND), "benchmark-hits")
    sent.unpersist()
    return result


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, th (hash of its text), n_words, n_hit, longest match, spans of hit words, names of the items."""
    first = more = None
    for block in _blocks(items, window, block_words):
        hits = _scanned(docs, item_tables(block, window), hits_only=first is not None)
        if first is None:
            first = hits
        else:
            more = hits if more is None else more.unionAll(hits)
    if more is not None:
        # Rows that repeat doc_id and text have the same hits.
        same = F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("th") == F.col("m_th"))
        rest = more.groupBy(F.col("doc_id").alias("m_doc"), F.col("th").alias("m_th")).agg(
            F.max("longest").alias("m_longest"), F.array_distinct(F.flatten(F.collect_set("spans"))).alias("m_spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("m_items"),  # at most one document's
        )
        joined = first.join(rest, same, "left")
        both = F.array_sort(F.concat("spans", F.coalesce("m_spans", F.array().cast("array<struct<begin:long,end:long>>"))))

        def merge(apart: F.Column, span: F.Column) -> F.Column:
            last = F.get(apart, F.size(apart) - 1)
            joint = F.concat(
                F.slice(apart, F.lit(1), F.size(apart) - 1),
                F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))),
            )
            return F.when((F.size(apart) > 0) & (span["begin"] <= last["end"]), joint).otherwise(F.array_append(apart, span))

        first = joined.select(
            "doc_id", "th", "n_words", F.greatest("longest", F.coalesce("m_longest", F.lit(0))).alias("longest"),
            F.aggregate(both, F.array().cast("array<struct<begin:long,end:long>>"), merge).alias("spans"),
            F.array_distinct(F.concat("items", F.coalesce("m_items", F.array().cast("array<string>")))).alias("items"),
        )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["begin"])
    return first.select("doc_id", "th", "n_words", hit.alias("n_hit"), "longest", "spans", F.array_sort("items").alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_span: int = WINDOW - 1, max_coverage: float = 0.5) -> DataFrame:
    """``docs``, with all columns, without hit spans of more than ``max_span`` words.

    A document goes as a whole where more than ``max_coverage`` of its words are hit. Of a removed span the text from
    its first word to its last goes.
    """
    found = contamination(docs, items, window).filter("n_hit > 0").select(
        F.col("doc_id").alias("__doc"), F.col("th").alias("__th"),
        (F.col("n_hit") <= max_coverage * F.col("n_words")).alias("__stays"), F.filter("spans", lambda s: s["end"] - s["begin"] > max_span).alias("__spans"),
    ).groupBy("__doc", "__th").agg(F.first("__stays").alias("__stays"), F.first("__spans").alias("__spans"))
    keyed = docs.withColumn("__of", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__of") == F.col("__th")), "left")
    kept = joined.filter("__stays is null or __stays")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                if spans:
                    data = text.encode()
                    places = [m.span() for m in word.finditer(data)]
                    for span in reversed(spans):
                        data = data[: places[span["begin"]][0]] + data[places[span["end"] - 1][1] :]
                    text = data.decode()
                texts.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).drop_columns(["__spans"])

    return kept.select(*docs.columns, "__spans").mapInArrow(cut, docs.schema)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of all documents against all benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS phrase
  FROM items, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS t(i) WHERE len(words) > 0
), starts AS (
  SELECT r, i, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM texts, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)
), hits AS (
  SELECT r, i, size, item FROM starts JOIN windows USING (size, phrase)
), places AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN places USING (r) LEFT JOIN named USING (r)
"""
