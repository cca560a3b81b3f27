"""Near-duplicate detection by circulant MinHash, banding and exact verification.

Documents become sets of word shingles. Two permutations of the hash space give all signature coordinates:
the first shuffles a set once, the second, shifted circularly by k, is the k-th hash. Bands of coordinates
find candidates; every link is confirmed on the full sets.

Documents with equal sets are one class, so copies are merged before anything else. Classes that share a
band are first compared with the smallest class of that band only, which is linear work. The pairs whose
signatures leave a link possible make families; what is still apart within a family is compared exactly, in
blocks of bounded size, and what shares a band across families is compared pair by pair. So no link between
components can be lost except by banding, which misses a pair at the threshold with probability
(1 - 0.8^7)^64, about 3e-7, or by signatures, which are 7 deviations away there.

Defined cases: null and blank texts have n_shingles 0, no links, and are their own component; rows that
repeat a doc_id are judged each by their text and stay or go together in ``drop_near_copies``; a row without
a doc_id always stays; an empty table gives no rows; other columns play no part.
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
from orderglass.llm.components import connected_components, refined
from orderglass.session import stage

BANDS, ROWS = 64, 7
#: Coordinates, of 8 bits each, that two classes are compared by, and the equal share below which they are no
#: candidates: 7 deviations below the expected share at the threshold.
COMPARED, SIGNATURE_SHARE = 200, 0.6
#: Single bits of 256 coordinates, as four longs: a pair at the threshold differs in 26 of them, with deviation 5.
BIT_WORDS, DIFFERENT_BITS = 4, 56
_REMEMBERED = 500_000
#: Full sets that are compared at once, in bytes.
BLOCK_BYTES = 1_500_000


class _Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.size, len(words))
        mixed = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for k in range(size):
            mixed = _mix64(mixed + hashes[k : len(words) - size + 1 + k])
        return np.unique(mixed)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash signatures of non-empty sets, one row each."""
    # Cutting to 32 bits defines the universe; the first permutation shuffles it.
    shuffled = _mix32(np.concatenate(sets).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    found = np.empty((len(sets), coordinates), dtype=np.uint32)
    for k in range(coordinates):
        found[:, k] = np.minimum.reduceat(_mix32(shuffled - np.uint32(k)), starts)
    return found


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, class (digest of the set), bands and a signature of 8 bits per coordinate."""
    kind = "doc_id long, n_shingles long, class binary, bands array<long>, signature binary, bits array<long>"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _Shingler(shingle)

        def flush(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            marks: list = [None] * len(sets)
            bits: list = [None] * len(sets)
            if full:
                found = signatures([sets[i] for i in full], BANDS * ROWS)
                keys = np.zeros((len(full), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    keys = _mix64(keys + found.reshape(len(full), BANDS, ROWS)[:, :, r] + np.uint64(r))
                single = np.packbits((found[:, : 64 * BIT_WORDS] >> 9) & 1, axis=1).view(np.int64)
                for i, row in zip(full, single, strict=True):
                    bits[i] = row
                for i, key, mark in zip(full, keys.view(np.int64), found[:, :COMPARED].astype(np.uint8), strict=True):
                    bands[i], marks[i] = key, mark.tobytes()
            classes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            columns = [ids, [len(s) for s in sets], classes, bands, marks, bits]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            names = ["doc_id", "n_shingles", "class", "bands", "signature", "bits"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            ids, sets, total = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc)
                sets.append(shingler(text.as_py()))
                total += len(sets[-1])
                if total > 50_000:  # a working set that stays in the cache
                    yield flush(ids, sets)
                    ids, sets, total = [], [], 0
            if ids:
                yield flush(ids, sets)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, kind)


def _full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(class, shingles) of the wanted classes, from one document each (class, doc_id, words)."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _Shingler(shingle)
        for batch in batches:
            sets = [shingler(text.as_py()) for text in batch.column("text")]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in sets]
            keep = [i for i, (a, b) in enumerate(zip(digests, batch.column("class").to_pylist(), strict=True)) if a == b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in keep], pa.binary()), pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                names=["class", "shingles"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text")
    of = wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("__doc"))).select("class", "text")
    return of.mapInArrow(shingles, "class binary, shingles binary")


def _alike(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs whose sizes and signatures leave the threshold possible."""
    a = marks.select(F.col("class").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    b = marks.select(F.col("class").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    joined = pairs.join(a, "a").join(b, "b").filter((100 * F.least("na", "nb") >= 80 * F.greatest("na", "nb")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= SIGNATURE_SHARE))

    return joined.select("a", "b", "sa", "sb").mapInArrow(compare, "a binary, b binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= 80 * union on the full sets."""
    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                at = np.searchsorted(p, q)
                common = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                keep.append(100 * common >= 80 * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Sets are large: a batch holds few of them.
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary")


def _family_links(families: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of each family: exact, on full sets, block against block.

    A family is cut into blocks of about BLOCK_BYTES; every pair of blocks is one group of bounded size. Of the
    links between two components a group returns one, so the result grows with the members, not their pairs.
    """
    named = families.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    narrow = stage(named.join(sets, "class").select("family", "class", "root", F.length("shingles").alias("bytes")), "near-families")
    sizes = narrow.groupBy("family").agg(F.sum("bytes").alias("bytes"), F.min("root").alias("r"), F.max("root").alias("s"))
    parts = sizes.filter(F.col("r") != F.col("s")).select("family", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    # Only narrow rows meet by family; the sets come by class.
    rows = narrow.join(parts, "family").withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int")).join(sets, "class")
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # One column: a partitioning by family alone would serve three, and leave all blocks of a family in one task.
    block_pair = F.struct("family", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).alias("blocks")

    def compare(block: pa.Table) -> pa.Table:
        own = block.column("own").to_numpy()
        classes, tops = block.column("class").to_pylist(), block.column("root").to_pylist()
        sets_ = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in block.column("shingles")]
        lengths = np.array([len(v) for v in sets_])
        holder = np.repeat(np.arange(len(sets_)), lengths)
        _, entry = np.unique(np.concatenate(sets_), return_inverse=True)
        by_entry = holder[np.argsort(entry, kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.bincount(entry))])
        places = np.concatenate([[0], np.cumsum(lengths)])
        above = {t: t for t in tops}

        def top(t: bytes) -> bytes:
            while above[t] != t:
                above[t] = t = above[above[t]]
            return t

        one, two = [], []
        cross = len(np.unique(own)) > 1
        for i in range(len(sets_)):
            mine = entry[places[i] : places[i + 1]]
            common = np.bincount(np.concatenate([by_entry[starts[e] : starts[e + 1]] for e in mine]), minlength=len(sets_))
            linked = 100 * common >= 80 * (lengths[i] + lengths - common)
            linked[: i + 1] = False
            if cross:
                linked &= own != own[i]
            for j in np.flatnonzero(linked):
                x, y = top(tops[i]), top(tops[j])
                if x != y:
                    above[max(x, y)] = min(x, y)
                    one.append(classes[i])
                    two.append(classes[j])
        return pa.table({"a": pa.array(one, pa.binary()), "b": pa.array(two, pa.binary())})

    return each.select(block_pair, "own", "class", "root", "shingles").groupBy("blocks").applyInArrow(compare, "a binary, b binary")


def near_links(docs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(node, root) of the classes that are linked with another class."""
    classes = stage(
        rows.filter("class is not null").groupBy("class").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature"),
            F.first("bits").alias("bits"),
        ), "near-classes",
    )
    marks = classes.select("class", "n_shingles", "signature")
    banded = classes.select("class", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("class").alias("least"), F.count("*").alias("n")).filter("n > 1")
    members = stage(banded.join(buckets.drop("n"), ["band", "key"]), "near-members")
    star = members.filter(F.col("class") != F.col("least")).select(F.col("class").alias("b"), F.col("least").alias("a")).distinct()
    candidates = stage(_alike(star, marks), "near-candidates")

    def sets_of(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct()
        return stage(_full_sets(docs, classes.select("class", "doc_id").join(needed, "class"), shingle), "near-sets")

    sets = sets_of(candidates)
    links = stage(_confirmed(candidates, sets), "near-links")
    roots = connected_components(links)
    # Families: classes whose signatures leave a link possible, directly or through others.
    # What is linked already is one node of that graph, and of the following ones.
    families = refined(roots, candidates).select(F.col("node").alias("class"), F.col("root").alias("family"))
    roots = refined(roots, stage(_family_links(families, roots, sets), "near-links"))
    # Members of one band that are in different families have no such chain: compared pair by pair.
    placed = members.join(families, "class", "left").withColumn("family", F.coalesce("family", "class"))
    kinds = placed.groupBy("band", "key").agg(F.min("family").alias("r"), F.max("family").alias("s")).filter(F.col("r") != F.col("s"))
    apart = stage(placed.join(kinds.select("band", "key"), ["band", "key"]).select("band", "key", "class", "family", "n_shingles")
                  .join(classes.select("class", "bits"), "class"), "near-apart")
    left, right = apart.alias("l"), apart.alias("r")
    different = sum((F.bit_count(F.get("l.bits", F.lit(i)).bitwiseXOR(F.get("r.bits", F.lit(i)))) for i in range(BIT_WORDS)), F.lit(0))
    rest = left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.class") < F.col("r.class"))
                     & (F.col("l.family") != F.col("r.family")) & (100 * F.least("l.n_shingles", "r.n_shingles") >= 80 * F.greatest("l.n_shingles", "r.n_shingles"))
                     & (different <= DIFFERENT_BITS))
    pairs = rest.select(F.col("l.class").alias("a"), F.col("r.class").alias("b")).distinct().join(candidates, ["a", "b"], "left_anti")
    more = stage(_alike(pairs, marks), "near-more")
    if not more.limit(1).count():
        return roots
    return refined(roots, stage(_confirmed(more, sets_of(more)), "near-links"))


def near_groups(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = stage(_sketched(docs, shingle), "near-rows")
    roots = near_links(docs, rows, shingle)
    narrow = rows.select("doc_id", "n_shingles", "class")
    # One row per document and class before the joins: a class of a third of all rows is spread by doc_id.
    tops = narrow.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    known = tops.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    component = stage(known.join(smallest, "root").select("class", "component"), "near-components")
    judged = narrow.join(component, "class", "left")
    found = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return judged.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group."""
    verdict = near_groups(docs, shingle).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = verdict.filter("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti").select(*docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, on four-word shingles."""
    return near_groups(table(spark, sf_dir, "documents"))
