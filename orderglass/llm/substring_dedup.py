"""Removal of long repeated substrings by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Three steps find them:

1. Every window of ``length`` bytes is assigned to the smallest hash of its 40-byte grams. Equal windows get
   equal keys, and neighbouring windows mostly share theirs, so a text becomes a row of pieces (key, digest,
   place, windows), one per 190 bytes or so. Keys whose gram occurs once are done: none of their windows repeats.
2. The distinct pieces of a key that has several are brought together in blocks. In a block, suffixes are
   sorted and their Burrows-Wheeler transform is extended backwards, breadth first: values of the common
   prefix of neighbouring suffixes are derived in increasing order and the search stops at ``length``.
   Neighbours without a value by then share at least ``length`` bytes. To take few steps, one symbol is a
   string of up to 40 bytes; windows with a symbol that occurs once in the block do not enter the sort.
3. Repeated windows go back to the documents, where their union is cut out.

A key with very many distinct pieces does not fit a block. Its windows are counted one by one by 128-bit
digest, with counts combined before they are shuffled; this is exact at any size as well.
Copies of a piece are merged by digest first, so a group of copies is one row per task.

Defined cases: a null text is empty; rows that repeat doc_id and text are documents of their own and repeat
each other; texts shorter than ``length`` stay whole; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderglass.llm.common import table
from orderglass.session import stage

LENGTH = 400
GRAM = 40
#: Windows of a piece, at most; longer stretches with one key become several pieces.
PIECE_WINDOWS = 1024
#: Distinct pieces of one key that are compared in a block; more are counted window by window.
BLOCK_PIECES = 1500
BLOCK_BYTES = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """Hash of the gram at every place of ``data`` that holds a whole one."""
    n = len(data) - gram + 1
    found = np.zeros(n, dtype=np.uint64)
    if gram % 8 == 0:
        for at in range(0, gram, 8):
            found = _mixed(found + np.ndarray(n, dtype="<u8", buffer=data, offset=at, strides=(1,)))
        return found
    letters = np.frombuffer(data, dtype=np.uint8)
    for at in range(gram):
        found = _mixed(found + letters[at : at + n])
    return found


def _window_keys(hashes: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` hashes in a row: minima of running blocks from both sides."""
    padded = np.full(-(-len(hashes) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(hashes)] = hashes
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(hashes) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _cut(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(key, first window, windows, places of the key's gram) of the pieces of one text."""
    gram = min(GRAM, length)
    hashes, width = _gram_hashes(data, gram), length - gram + 1
    keys = _window_keys(hashes, width)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(keys)))
    if sizes.max() > PIECE_WINDOWS:
        starts = np.concatenate([np.arange(s, s + n, PIECE_WINDOWS) for s, n in zip(starts, sizes, strict=True)])
        sizes = np.diff(np.append(starts, len(keys)))
    own = [int(np.count_nonzero(hashes[s : s + n + width - 1] == keys[s])) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return keys[starts], starts, sizes, own


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For every window of every piece whether its string also starts elsewhere in ``pieces``."""
    step = max(d for d in range(1, min(GRAM, length) + 1) if length % d == 0)
    levels = length // step
    sizes = np.array([len(p) for p in pieces])
    # One place per byte and one for the end of each piece.
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    left = np.repeat(ends, sizes + 1) - np.arange(n)  # bytes from here to the end of the piece
    code = _symbols(b"\0".join(pieces) + b"\0" * step, step)
    # A window can only repeat if each of its symbols does, so only the places of such windows are sorted.
    often = left >= step
    often &= (np.bincount(code[often], minlength=n) > 1)[code]
    whole = often.copy()
    for level in range(1, levels):
        whole[: n - level * step] &= often[level * step :]
        whole[max(0, n - level * step) :] = False
    used = whole.copy()
    for level in range(1, levels):
        used[level * step :] |= whole[: n - level * step]
    place = np.flatnonzero(used)
    marks = np.zeros(n, dtype=bool)
    if len(place):
        marks[place] = _shared(code[place], place, used, step, levels)
    return [marks[end - size : end - length + 1] for end, size in zip(ends, sizes, strict=True)]


def _shared(code: np.ndarray, place: np.ndarray, used: np.ndarray, step: int, levels: int) -> np.ndarray:
    """For every used place whether its suffix shares its first ``levels`` symbols with another one.

    The suffix at a place goes on ``step`` places later, if that place is used, and ends there otherwise; an end equals
    nothing. Number ``n`` stands for no suffix.
    """
    n = len(place)
    number = np.full(len(used) + step, n)
    number[place] = np.arange(n)
    ahead = np.append(number[place + step], n)
    back = np.where(place >= step, number[place - step], n)
    # Suffix order up to ``levels`` symbols, by doubling; ends come first.
    rank, reach, jump = code, 1, ahead
    while reach < levels:
        rank = _named(rank, np.append(rank + 1, 0)[jump[:n]])
        reach, jump = 2 * reach, jump[jump]
    order = _sorted_places(rank)
    at = np.empty(n, dtype=np.int64)
    at[order] = np.arange(n)
    # The transform: the symbol before each suffix, and where its suffix stands (one step back).
    has = np.flatnonzero(back[order] < n)
    before = back[order[has]]
    by_symbol = _sorted_places(code[before])
    target = np.sort(at[before])  # a symbol's suffixes stand together, in the order of what follows them
    symbol = code[before[by_symbol]]
    stand = has[by_symbol]
    same = np.flatnonzero(symbol[1:] == symbol[:-1])
    low, high, result = stand[same], stand[same + 1], target[same + 1]
    # Breadth-first expansion: a border between two intervals extends to the suffixes that precede it.
    first, ended = code[order], ahead[order] == n
    border = np.ones(n, dtype=bool)
    border[1:] = first[1:] != first[:-1]
    known = border.copy()
    for level in range(1, levels):
        count = np.cumsum(border)
        hit = count[high] > count[low]
        border = np.zeros(n, dtype=bool)
        border[result[hit]] = True
        if level == 1:  # a lone symbol shares no more than itself
            border[1:] |= ended[1:] | ended[:-1]
        border &= ~known
        known |= border
        low, high, result = low[~hit], high[~hit], result[~hit]
    shared = np.flatnonzero(~known)
    found = np.zeros(n, dtype=bool)
    found[order[shared]] = True
    found[order[shared - 1]] = True
    return found


def _symbols(data: bytes, step: int) -> np.ndarray:
    """A number for the string of ``step`` bytes at every place of ``data`` that holds a whole one; equal strings, equal numbers."""
    hashes = _gram_hashes(data, step)
    n = len(hashes)
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    equal = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    letters = np.frombuffer(data, dtype=np.uint8)
    one, two = order[equal], order[equal + 1]
    spots = sorted({*range(0, step - 7, 8), step - 8}) if step >= 8 else []
    words = [np.ndarray(n, dtype="<u8", buffer=data, offset=at, strides=(1,)) for at in spots]
    words = words or [letters[at : at + n] for at in range(step)]
    if all(np.array_equal(w[one], w[two]) for w in words):
        names = np.zeros(n, dtype=np.int64)
        names[1:] = np.cumsum(sorted_[1:] != sorted_[:-1])
        code = np.empty(n, dtype=np.int64)
        code[order] = names
        return code
    # Two strings share a hash: names of longer strings from pairs of names.
    code, width = letters.astype(np.int64), 1
    while width < step:
        take = min(width, step - width)
        code = _named(code, np.append(code[take:], np.zeros(take, dtype=np.int64)))
        width += take
    return code[:n]


def _sorted_places(values: np.ndarray) -> np.ndarray:
    """Places in the order of ``values``, equal ones in place order; a sort of numbers that hold both is faster than a stable one."""
    bits = max(1, len(values).bit_length())
    return np.sort((values << bits) | np.arange(len(values))) & ((1 << bits) - 1)


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b)."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _batch(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names.split())


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text; with doc_id it names the row) and data (the bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("data"))


def _pieces(rows: DataFrame, length: int) -> DataFrame:
    kinds = [pa.int64()] * 5 + [pa.int32()] * 3

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, th, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "data")), strict=True):
                if len(data) < length:
                    continue
                view = memoryview(data)
                keys, starts, sizes, own = _cut(data, length)
                for key, start, size, n in zip(keys.tolist(), starts.tolist(), sizes.tolist(), own, strict=True):
                    digest = hashlib.blake2b(view[start : start + size + length - 1], digest_size=16).digest()
                    one, two = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                    found.append((doc, th, key - (1 << 63), one, two, start, size, n))
            yield _batch(found, "doc_id th key d1 d2 start windows own", kinds)

    return rows.mapInArrow(cut, "doc_id long, th long, key long, d1 long, d2 long, start int, windows int, own int")


def _repeats(candidates: DataFrame, docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Repeated runs of windows per distinct piece (key, d1, d2, begin, end), and the texts of all documents.

    Texts of documents without candidates are summed up at once (n_bytes, digest).
    """
    variants = stage(candidates.groupBy("key", "d1", "d2").agg(
        F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("th").alias("th"),
        F.first("start").alias("start"), F.first("windows").alias("windows"), F.first("own").alias("own"),
    ), "repeat-variants")
    kinds = variants.groupBy("key").agg(F.count("*").alias("pieces"), F.max("own").alias("own"))
    several = kinds.filter("pieces > 1 or own > 1").select("key", (F.col("pieces") > BLOCK_PIECES).alias("many"))
    # A copied piece repeats as a whole. Copies still meet the other pieces of their key.
    wanted = variants.join(several, "key").select(
        "doc_id", "th", F.struct("key", "d1", "d2", "start", "windows", "many").alias("piece")
    )
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list("piece").alias("pieces"))  # at most one document's
    ids = candidates.select(F.col("doc_id").alias("c_doc"), F.col("th").alias("c_th")).distinct()
    of_row = F.col("c_doc").eqNullSafe(F.col("doc_id")) & (F.col("c_th") == F.col("th"))  # null ids are ids as well
    named = ids.join(lists, of_row, "left").select(
        "c_doc", "c_th", F.coalesce("pieces", F.array().cast("array<struct<key:long,d1:long,d2:long,start:int,windows:int,many:boolean>>")).alias("pieces")
    )
    rows = _identified(docs)
    joined = rows.join(named, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("th") == F.col("c_th")), "left")
    plain = F.col("pieces").isNull()
    texts = stage(joined.select(
        "doc_id", "th", F.length("data").cast("long").alias("n_bytes"), F.when(plain, F.sha2("data", 256)).alias("whole_sha256"), "data", "pieces",
    ), "repeat-texts")

    given = texts.filter("size(pieces) > 0").select("data", F.explode("pieces").alias("piece")).select(
        "piece.*", F.expr(f"substring(data, piece.start + 1, piece.windows + {length - 1})").alias("data")
    )
    few = stage(given.filter("not many").select("key", "d1", "d2", "data"), "repeat-few")
    volume = few.agg(F.sum(F.length("data"))).head()[0] or 0
    blocks = max(1, -(-volume // BLOCK_BYTES))
    kind = "key long, d1 long, d2 long, begin int, end int"
    arrow = [pa.int64()] * 3 + [pa.int32()] * 2

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "key d1 d2 begin end"

        def solve(pieces: list[tuple]) -> pa.RecordBatch:
            marks = repeated_windows([p[3] for p in pieces], length)
            return _batch([(*p[:3], a, b) for p, m in zip(pieces, marks, strict=True) for a, b in _runs(m)], names, arrow)

        # Rows come sorted by key: whole keys are gathered until they fill a block.
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "d1", "d2", "data")), strict=True):
                if size > BLOCK_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    by_block = few.repartition(int(blocks), "key").sortWithinPartitions("key").mapInArrow(expand, kind)

    window_kinds = [pa.int64()] * 5 + [pa.int32()]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, one, two, data in zip(*(batch.column(c).to_pylist() for c in ("key", "d1", "d2", "data")), strict=True):
                view = memoryview(data)
                for at in range(len(data) - length + 1):
                    w = xxhash.xxh3_128_intdigest(view[at : at + length])
                    found.append((key, one, two, (w >> 64) - (1 << 63), (w & ((1 << 64) - 1)) - (1 << 63), at))
            yield _batch(found, "key d1 d2 w1 w2 at", window_kinds)

    single = given.filter("many").select("key", "d1", "d2", "data").mapInArrow(windows, "key long, d1 long, d2 long, w1 long, w2 long, at int")
    single = stage(single, "repeat-windows")
    again = single.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1")
    by_count = single.join(again, ["w1", "w2"]).select("key", "d1", "d2", F.col("at").alias("begin"), (F.col("at") + 1).alias("end"))
    whole = variants.filter("n > 1").select("key", "d1", "d2", F.lit(0).alias("begin"), F.col("windows").alias("end"))
    return by_block.unionAll(by_count).unionAll(whole), texts


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept (bytes) and kept (the bytes that stay) of every document."""
    pieces = stage(_pieces(_identified(docs), length), "repeat-pieces")
    often = pieces.groupBy("key").agg(F.sum("own").alias("n")).filter("n > 1").select("key")
    candidates = stage(pieces.join(often, "key", "left_semi"), "repeat-candidates")
    found, texts = _repeats(candidates, docs, length)
    runs = stage(found, "repeat-runs").groupBy("key", "d1", "d2").agg(
        F.collect_list(F.struct("begin", "end")).alias("runs")  # at most PIECE_WINDOWS
    )
    spans = candidates.join(runs, ["key", "d1", "d2"]).select("doc_id", "th", F.explode("runs").alias("run"), "start").select(
        "doc_id", "th", (F.col("start") + F.col("run.begin")).alias("begin"), (F.col("start") + F.col("run.end") + (length - 1)).alias("end")
    ).distinct()  # rows that repeat doc_id and text give the same spans
    cuts = spans.groupBy(F.col("doc_id").alias("c_doc"), F.col("th").alias("c_th")).agg(
        F.collect_list(F.struct("begin", "end")).alias("cuts")  # at most one document's
    )
    plain = texts.filter("whole_sha256 is not null").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("whole_sha256").alias("kept_sha256"), F.col("n_bytes").alias("n_kept"), F.col("data").alias("kept"),
    )
    open_ = texts.filter("whole_sha256 is null").select("doc_id", "th", "data").join(
        cuts, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("th") == F.col("c_th")), "left"
    )
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data, cuts_ in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "cuts")), strict=True):
                kept, at, removed, n = [], 0, 0, 0
                last = -1
                for begin, end in sorted((c["begin"], c["end"]) for c in cuts_ or ()):
                    if begin > last:
                        n += 1
                        kept.append(data[at:begin])
                    removed += max(0, end - max(begin, at))
                    at = last = max(at, end)
                kept.append(data[at:])
                rest = b"".join(kept)
                rows.append((doc, len(data), removed, n, hashlib.sha256(rest).hexdigest(), len(rest), rest))
            yield _batch(rows, "doc_id n_bytes n_removed n_spans kept_sha256 n_kept kept", kinds)

    judged = open_.select("doc_id", "data", "cuts").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, kept binary"
    )
    return plain.unionAll(judged)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings of 400 bytes: the contract's columns, the bytes kept, and the text kept.

    Cuts fall between bytes; a character that a cut splits is shown in ``text`` as replaced, kept_sha256 and n_kept
    are of the bytes.
    """
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
