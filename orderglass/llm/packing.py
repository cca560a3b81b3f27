"""Best-fit packing of tokenised documents into sequences, planned on the histogram of piece lengths.

Documents become pieces of at most ``limit`` tokens (ids plus a closing id 0; a longer document's first
piece takes the remainder). Only the histogram of lengths, at most ``limit`` rows, reaches the driver. There
a best-fit-decreasing plan works on counts: bins that are filled alike are one class with a count, each
length splits at most one class and opens at most two, so the plan has at most ``4 * limit`` classes at any input size. Pieces are
ranked within their length, and a piece takes the slot that the plan holds for its rank.

Defined cases: a null text is empty and packs its closing id alone; rows that repeat a doc_id are separate
documents; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderglass.llm.common import table
from orderglass.session import stage

LIMIT = 2048
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of so many characters is beyond the quick library's pattern matcher.
LONG_SPACE = 1000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Byte-level BPE ids of a text as the tokenizer of the file gives them.

    The file names byte strings by id in merge order, which is all that its merges say; the rank-based library
    encodes the same ids several times as fast. Texts that it reads otherwise or not at all go to the tokenizer itself:
    those with one of the file's added tokens, and those with very long white space.
    """
    import tiktoken
    from tokenizers import Tokenizer

    file = json.loads(Path(vocabulary).read_text(encoding="utf-8"))
    names = file["model"]["vocab"]
    added = "|".join(re.escape(token["content"]) for token in file.get("added_tokens") or () if token["content"])
    unlike = re.compile("|".join(filter(None, (added, rf"\s{{{LONG_SPACE},}}"))))
    whole = Tokenizer.from_file(vocabulary)
    byte_of = {letter: value for value, letter in enumerate(_byte_letters())}
    ranks = {bytes(byte_of[c] for c in name): i for name, i in names.items() if all(c in byte_of for c in name)}
    ranks = {name: i for name, i in ranks.items() if i < len(ranks)}
    quick = tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: whole.encode(text, add_special_tokens=False).ids if unlike.search(text) else quick(text)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def tokenized_pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = array("I", [*ids_of(text.as_py() or ""), 0]).tobytes()
                n = len(ids) // 4
                end = n % limit or min(n, limit)
                begin = piece = 0
                while begin < n:
                    rows.append((doc, piece, begin, end - begin, zlib.crc32(ids[4 * begin : 4 * end])))
                    begin, end, piece = end, end + limit, piece + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


def plan_slots(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts: (length, first rank, slots, first sequence, offset) rows.

    Ranks ``first .. first + slots - 1`` of a length take the sequences ``first sequence + 0, 1, ...``.
    """
    classes: dict[int, list[tuple[int, int]]] = {}  # free tokens -> [(first sequence, sequences)]
    free: list[int] = []
    slots, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room not in classes:
            classes[room] = []
            insort(free, room)
        classes[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free, length)
            if at == len(free):  # open as many sequences as equal pieces of this length fill
                per = limit // length
                n = max(1, left // per)
                room, first, offset = limit, opened, 0
                opened += n
                for _ in range(min(per, left)):
                    slots.append((length, rank, n, first, limit - room))
                    rank, left, room = rank + n, left - n, room - length
                put(room, first, n) if room else None
                continue
            room = free[at]
            first, n = classes[room].pop()
            if not classes[room]:
                del classes[room]
                free.pop(at)
            used = min(n, left)
            slots.append((length, rank, used, first, limit - room))
            rank, left = rank + used, left - used
            if room > length:
                put(room - length, first, used)
            if n > used:
                put(room, first + used, n - used)
    return slots


def _ranked(pieces: DataFrame) -> DataFrame:
    """Rank of each piece within its length, from 0, by counts per group of documents first.

    A length that holds a third of all pieces is spread over many groups, each ranked by itself.
    """
    groups = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 << 12)).alias("part")
    rows = pieces.select("*", groups)
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("place"))


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    pieces = stage(tokenized_pieces(docs, vocabulary, limit), "pieces")
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *slot in plan_slots(histogram, limit):
        plan.setdefault(length, []).append(tuple(slot))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {length: np.array(slots, dtype=np.int64) for length, slots in plan.items()}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                slots = tables[int(length)]
                at = np.searchsorted(slots[:, 0], ranks[rows], side="right") - 1
                sequence[rows] = slots[at, 2] + ranks[rows] - slots[at, 0]
                offset[rows] = slots[at, 3]
            kept = [batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return _ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, f"{PIECES}, sequence_id long, offset long"
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
