"""Mixing sources to target weights by min-cost flow, then seeded choice of documents.

Documents are summed up per membership pattern (the set of sources they belong to). A small network routes
words from patterns to the sources' targets; a pattern's first pass over its documents costs nothing and
every further pass costs more, so documents repeat only where a target cannot be met otherwise. The flow of
a pattern is a number of whole passes and a rest; for the rest, documents are taken in seeded order.
The driver sees one row per pattern, never documents.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in
order; repeated rows are documents of their own; without words every target is 0; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderglass.llm.common import table
from orderglass.session import stage

PASSES = 3
WEIGHTS = (1, 2, 3)
SEED = 20
_LEVEL_BITS, _LEVELS = 10, 6  # a seeded place has 60 bits
_FILLS = 6

Pattern = tuple[str | None, ...]


def targets_by_weight(sizes: dict[str | None, int], total: int) -> dict[str | None, float]:
    """Shares of ``total`` by weight, none above PASSES times its size; the excess goes to the others."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {source: WEIGHTS[i % len(WEIGHTS)] for i, source in enumerate(order)}
    found: dict[str | None, float] = {}
    while len(found) < len(order):
        open_ = [s for s in order if s not in found]
        left, shares = total - sum(found.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / shares > PASSES * sizes[s]]
        for source in over or open_:
            found[source] = float(PASSES * sizes[source]) if over else left * weight[source] / shares
    return found


def route(supply: dict[Pattern, int], targets: dict[str | None, int]) -> dict[Pattern, dict[str | None, int]]:
    """Words that each pattern gives each of its sources at least cost: successive shortest paths.

    Pass ``k`` of a pattern holds its words once more and costs ``k - 1`` per word, a convex cost.
    """
    nodes = {name: i for i, name in enumerate(["start", "end", *(("p", p) for p in supply), *(("s", s) for s in targets)])}
    heads: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    leaving: list[list[int]] = [[] for _ in nodes]

    def arc(a: object, b: object, capacity: int, price: int) -> int:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            leaving[nodes[x]].append(len(heads))
            heads.append(nodes[y])
            room.append(c)
            cost.append(w)
        return len(heads) - 2

    routes = {}
    for pattern, words in supply.items():
        for k in range(PASSES):
            arc("start", ("p", pattern), words, k)
        for source in pattern:
            routes[pattern, source] = arc(("p", pattern), ("s", source), PASSES * words, 0)
    for source, words in targets.items():
        arc(("s", source), "end", words, 0)
    while True:
        far = [None] * len(nodes)
        by = [-1] * len(nodes)
        far[0], queue, queued = 0, deque([0]), [False] * len(nodes)
        while queue:
            at = queue.popleft()
            queued[at] = False
            for e in leaving[at]:
                to, d = heads[e], far[at] + cost[e]
                if room[e] and (far[to] is None or d < far[to]):
                    far[to], by[to] = d, e
                    if not queued[to]:
                        queue.append(to)
                        queued[to] = True
        if far[1] is None:
            break
        path, at = [], 1
        while at:
            path.append(by[at])
            at = heads[by[at] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most
    flow: dict[Pattern, dict[str | None, int]] = {p: {} for p in supply}
    for (pattern, source), e in routes.items():
        flow[pattern][source] = room[e ^ 1]
    return flow


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(size: Column) -> Column:
    """Seeded place of a document, 60 bits; only rows that agree in doc_id and size use their row number."""
    seeded = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", size), 24)
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))
    return F.shiftleft(seeded, 20) + own


def _key(sources: Column) -> Column:
    """Text key of a membership pattern, told apart from any other."""
    return F.to_json(F.transform(sources, lambda s: F.array(s)))


def _choice(size: Column, place: Column, chosen: Column) -> Column:
    """Whether any fill took the document: a fill has a largest size and an end place."""
    return F.exists(chosen, lambda c: (size <= c["limit"]) & (place < c["cut"]))


def _fill(spark: SparkSession, rows: DataFrame, rest: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """Fills per pattern: the longest seeded run of documents within the rest, then again for what is left.

    Each level of a run narrows its end by 10 bits of the place, from sums per pattern and bucket.
    """
    chosen: dict[str, list[tuple[int, int]]] = {p: [] for p in rest}
    kind = "pattern string, rest long, prefix long, todo long, chosen array<struct<limit:long,cut:long>>"
    for _ in range(_FILLS):
        limit = {p: r for p, r in rest.items() if r > 0}
        state = {p: [0, r] for p, r in limit.items()}  # prefix of the end, words still to take
        ends: dict[str, int] = {}
        for level in reversed(range(_LEVELS)):
            if not state:
                break
            now = spark.createDataFrame([(p, limit[p], a, todo, chosen[p]) for p, (a, todo) in state.items()], kind)
            shift = level * _LEVEL_BITS
            near = rows.join(F.broadcast(now), "pattern").filter(
                (F.col("size") <= F.col("rest")) & (F.shiftright("place", shift + _LEVEL_BITS) == F.col("prefix"))
                & ~_choice(F.col("size"), F.col("place"), F.col("chosen"))
            )
            bucket = F.shiftright("place", shift).bitwiseAND(F.lit((1 << _LEVEL_BITS) - 1))
            sums = near.groupBy("pattern", "todo", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
            run = Window.partitionBy("pattern").orderBy("bucket")
            reached = sums.withColumn("upto", F.sum("words").over(run))
            over = F.col("upto") > F.col("todo")
            first = reached.groupBy("pattern").agg(
                F.min(F.when(over, F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "n"))).alias("over"),
                F.max("upto").alias("all"),
            )
            found = {row["pattern"]: row for row in first.collect()}  # one row per pattern
            for pattern, (prefix, todo) in list(state.items()):
                row = found.get(pattern)
                if row is None or row["over"] is None:  # every document left fits
                    ends[pattern] = (prefix + 1) << (shift + _LEVEL_BITS)
                    rest[pattern] = todo - (row["all"] if row else 0)
                    del state[pattern]
                    continue
                prefix, todo = (prefix << _LEVEL_BITS) | row["over"]["bucket"], todo - row["over"]["before"]
                state[pattern] = [prefix, todo]
                if row["over"]["n"] == 1 or not level:
                    ends[pattern], rest[pattern] = prefix << shift, todo
                    del state[pattern]
        before = {p: list(c) for p, c in chosen.items()}
        for pattern, end in ends.items():
            if end:
                chosen[pattern].append((limit[pattern], end))
        if chosen == before or not any(r > 0 for r in rest.values()):
            break
    return chosen


def plan_mix(docs: DataFrame, sources: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document rows, one row per pattern: passes and fills, one row per source: source_size and target)."""
    spark = docs.sparkSession
    size = size_of(F.col("text"))
    rows = docs.select("doc_id", size.alias("size"), F.array_sort(F.array_distinct(sources)).alias("sources"))
    rows = stage(rows.select("*", _key(F.col("sources")).alias("pattern"), _place(F.col("size")).alias("place")), "mix-rows")
    sums = rows.groupBy("pattern", "sources").agg(F.sum("size").alias("words")).collect()  # one row per pattern
    keys: dict[Pattern, str] = {tuple(row["sources"]): row["pattern"] for row in sums}
    supply: dict[Pattern, int] = {tuple(row["sources"]): row["words"] for row in sums}
    sizes: dict[str | None, int] = {}
    for pattern, words in supply.items():
        for source in pattern:
            sizes[source] = sizes.get(source, 0) + words
    targets = targets_by_weight(sizes, sum(supply.values()))
    flow = route(supply, {s: round(t) for s, t in targets.items()})
    passes, rest = {}, {}
    for pattern, words in supply.items():
        passes[keys[pattern]], rest[keys[pattern]] = divmod(sum(flow[pattern].values()), words) if words else (0, 0)
    chosen = _fill(spark, rows, rest)
    patterns = spark.createDataFrame(
        [(p, k, chosen[p]) for p, k in passes.items()], "pattern string, passes int, chosen array<struct<limit:long,cut:long>>"
    )
    found = spark.createDataFrame(
        [(s, sizes[s], targets[s]) for s in sizes], "source string, source_size long, target double"
    )
    return rows, patterns, found


def mix_documents(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken of every document of single-source documents."""
    rows, patterns, sources = plan_mix(docs, F.array(F.col(source)))
    times = F.col("passes") + _choice(F.col("size"), F.col("place"), F.col("chosen")).cast("int")
    # Both tables have one row per source or pattern; AQE decides on a broadcast by their size.
    judged = rows.join(patterns, "pattern").withColumn("source", F.get("sources", F.lit(0)))
    named = judged.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return named.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    _, patterns, _ = plan_mix(docs, F.array(F.col(source)))
    patterns = patterns.select(*[F.col(c).alias(f"__{c}") for c in patterns.columns])
    rows = docs.withColumn("__size", size_of(F.col("text"))).withColumn("__place", _place(F.col("__size")))
    rows = rows.withColumn("__of", _key(F.array(F.col(source))))
    joined = rows.join(patterns, F.col("__of") == F.col("__pattern"))
    times = F.col("__passes") + _choice(F.col("__size"), F.col("__place"), F.col("__chosen")).cast("int")
    kept = joined.withColumn("__times", times).filter("__times > 0")
    return kept.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to the sources' target weights."""
    return mix_documents(table(spark, sf_dir, "documents"))
