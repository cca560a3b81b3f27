import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from orderglass.llm import ranked_search as search

ITEMS = "item_id long, text string, kept string"


def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered) if t]


def brute(docs, items, top):
    """Every score of every item and document."""
    counted = [(doc, Counter(terms_of(text))) for doc, text in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    rows = []
    for item, terms in asked.items():
        scored = []
        for doc, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        rows += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(rows, key=str)


def result(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def corpus(seed, n):
    pick = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(40)] + ["É", "zz"]
    prose = lambda k: " ".join(vocabulary[min(int(pick.expovariate(0.12)), 41)] for _ in range(k))
    docs = [(i, prose(pick.choice([1, 3, 8, 20, 60]))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(15)]  # ties
    return docs, [(i, prose(pick.choice([1, 2, 6, 12, 30]))) for i in range(12)]


@pytest.mark.parametrize("block_terms", [15, 50_000])
def test_ranks_against_brute_force(spark, docs_of, block_terms):
    docs, items = corpus(5, 400)
    docs += [(None, "t1 t2 zz"), (None, "t1 t2 zz"), (900, None), (901, " ,,"), (3, "t30 t31 T31"), (902, "zz " * 20_000)]
    items += [(50, None), (51, "nowhere"), (None, "zz É"), (0, "t39 t38"), (52, "zz " * 5_000)]
    found = search.ranked_search(docs_of(docs), spark.createDataFrame([(*i, "x") for i in items], ITEMS), block_terms=block_terms)
    assert result(found) == brute(docs, items, 10)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_small_blocks_and_wide_masks(spark, docs_of, monkeypatch):
    docs, items = corpus(8, 150)
    many = [f"v{i}" for i in range(200)]
    pick = random.Random(1)
    docs += [(2000 + i, " ".join(pick.sample(many, 90))) for i in range(60)]
    items += [(70, " ".join(many)), (71, " ".join(many[:130]))]
    wanted = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    for name, value in (("BLOCK_DOCS", 16), ("BLOCK_POSTINGS", 300), ("BLOCK_CELLS", 800)):
        monkeypatch.setattr(search, name, value)
    assert result(search.ranked_search(docs_of(docs), wanted, top=4)) == brute(docs, items, 4)


def test_masks_and_ceilings_of_a_block():
    weights = np.arange(1, 71)
    pick = random.Random(2)
    held = [sorted(pick.sample(range(70), pick.randint(0, 70))) for _ in range(40)] + [[1, 5], [1, 5], []]
    sizes = np.array([len(h) for h in held])
    terms = np.array([t for h in held for t in h])
    tf = np.array([pick.randint(1, 5) for _ in terms])
    block = search._Block(list(range(len(held))), sizes.astype(np.int64), sizes, terms, tf, weights, len(held), int(sizes.sum()))
    rows = block.row[block.row >= 0]
    ceilings, mask = block.masks(rows, 0, len(held))
    assert len(ceilings) == len({tuple(h) for h in held})
    groups = {}
    for doc, group in enumerate(mask):
        groups.setdefault(int(group), set()).add(tuple(held[doc]))
    assert all(len(sets) == 1 for sets in groups.values())
    assert (block.scores(rows, np.arange(len(held))) <= ceilings[mask]).all()


def test_nothing_to_search(spark, docs_of, odd):
    items = spark.createDataFrame([(1, "same", "x"), (2, "word", "x")], ITEMS)
    assert search.ranked_search(docs_of([]), items).count() == 0
    assert search.ranked_search(docs_of(odd), spark.createDataFrame([], ITEMS)).count() == 0
    assert result(search.ranked_search(docs_of(odd), items)) == brute([(r[0], r[1]) for r in odd], [(1, "same"), (2, "word")], 10)
