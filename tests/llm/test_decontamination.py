import hashlib
import random
import re

import pytest

from orderglass.llm.decontamination import contamination, decontaminate, item_tables, match_words, plain_words, suffix_automaton

ITEMS = "item_id long, text string, kept string"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def brute(text, items, window):
    """Hit places and item names of one text."""
    words, hit, names = words_of(text), set(), set()
    for item, wanted in items:
        wanted = words_of(wanted)
        size = min(window, len(wanted))
        for at in range(len(wanted) - size + 1) if size else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == wanted[at : at + size]:
                    hit.update(range(i, i + size))
                    names.add("" if item is None else str(item))
    return len(words), len(hit), sorted(names)


def random_cases(seed, n_docs, n_items):
    """Texts over a tiny vocabulary, so that partial, nested and repeated matches abound."""
    pick = random.Random(seed)
    prose = lambda n: " ".join(pick.choice("a b c É dd".split()) for _ in range(n))
    items = [(i, prose(pick.randint(0, 14))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        text = prose(pick.randint(0, 30))
        if pick.random() < 0.5 and items:
            text += " " + pick.choice(items)[1].upper() + "," + prose(4)
        docs.append((i, text))
    return docs, items


def found_of(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in df.collect()}


def test_automaton_holds_every_substring_once():
    pick = random.Random(3)
    sequences = [[pick.randint(0, 2) for _ in range(pick.randint(0, 12))] for _ in range(20)]
    arrows, link, length = suffix_automaton(sequences)
    expected = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    assert sum(length[s] - length[link[s]] for s in range(1, len(link))) == len(expected)
    for string in expected:
        at = 0
        for word in string:
            at = arrows[at][word]
        assert length[link[at]] < len(string) <= length[at]


@pytest.mark.parametrize("seed", range(6))
def test_matches_against_brute_force(seed):
    docs, items = random_cases(seed, 60, 25)
    tables = item_tables([(str(i), words_of(t)) for i, t in items], 4)
    for _, text in docs:
        spans, names, longest = match_words(plain_words(text.encode()), tables)
        n_words, n_hit, expected = brute(text, items, 4)
        assert (sum(b - a for a, b in spans), names) == (n_hit, expected)
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert longest <= max((b - a for a, b in spans), default=0)


@pytest.mark.parametrize("block_words", [13, 40, 100_000])
def test_blocks_of_items(spark, docs_of, block_words):
    docs, items = random_cases(11, 50, 20)
    items += [(3, "a b c É dd a b c É dd"), (None, "É É É"), (77, None), (78, "!!")]
    docs += [(100, None), (100, items[0][1]), (None, "x É É É x")]
    found = contamination(docs_of(docs), spark.createDataFrame([(*i, "x") for i in items], ITEMS), window=5, block_words=block_words)
    rows = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in found.collect())
    assert rows == sorted((str(doc), *brute(text, items, 5)) for doc, text in docs)
    for row in found.collect():
        spans = [(s["begin"], s["end"]) for s in row["spans"]]
        assert spans == sorted(spans) and sum(b - a for a, b in spans) == row["n_hit"]


def test_a_long_item_is_cut_into_segments_without_loss(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(95))
    docs = [(i, " ".join(f"w{k}" for k in range(i, i + 10))) for i in range(-3, 90)]
    found = found_of(contamination(docs_of(docs), spark.createDataFrame([(5, text, "x")], ITEMS), block_words=30))
    assert {i for i, (_, hit, _) in found.items() if hit} == set(range(0, 86))


def test_odd_rows_and_no_items(spark, docs_of, odd):
    items = spark.createDataFrame([(1, "same", "x"), (1, "cödé X ünï", "x")], ITEMS)
    rows = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in contamination(docs_of(odd), items).collect())
    assert rows == sorted([
        ("1", 0, 0, []), ("2", 0, 0, []), ("3", 0, 0, []), ("4", 20_000, 0, []), ("5", 1, 1, ["1"]), ("6", 1, 1, ["1"]), ("6", 1, 1, ["1"]),
        ("None", 1, 1, ["1"]), ("7", 3, 0, []),
    ])
    none = spark.createDataFrame([], ITEMS)
    assert {r["n_hit"] for r in contamination(docs_of(odd), none).collect()} == {0}
    assert contamination(docs_of([]), items).count() == 0


def test_a_long_repeating_text_is_linear(spark):
    tables = item_tables([("1", ["a"] * 3_000), ("2", ["a"]), ("3", ["a", "a"])], 10)
    spans, names, longest = match_words([b"a"] * 300_000, tables)
    assert (spans, names, longest) == ([(0, 300_000)], ["1", "2", "3"], 3_000)


def test_spans_are_removed_and_covered_documents_go(spark, docs_of):
    item = "one two three four five six seven eight nine ten"
    docs = docs_of([
        (1, f"Before it, ONE two three. Four five six seven eight nine ten! after {'x ' * 30}"), (2, item), (3, None), (4, "clean"),
        (None, f"{'é ' * 40}{item}."), (5, "one two three four five six seven eight nine"),
    ])
    left = {r["doc_id"]: r for r in decontaminate(docs, spark.createDataFrame([(9, item, "x")], ITEMS)).collect()}
    assert set(left) == {1, 3, 4, None, 5}
    assert left[1]["text"] == "Before it, ! after " + "x " * 30
    assert left[None]["text"] == "é " * 40 + "."
    assert left[1]["kept"] == "clash" and left[3]["text"] is None


def test_query(spark, docs_of, tmp_path):
    from orderglass.llm.decontamination import op12_decontamination

    item = "one two three four five six seven eight nine ten eleven"
    docs_of([(1, f"x {item} y"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, item, "x"), (9, item, "x")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in op12_decontamination(spark, str(tmp_path)).collect()}
    assert rows[1].asDict() == {
        "doc_id": 1, "n_words": 13, "n_hit": 11, "n_items": 2, "items_sha256": hashlib.sha256(b"10,9").hexdigest(), "contaminated": True,
    }
    assert (rows[2]["n_words"], rows[2]["contaminated"], rows[2]["items_sha256"]) == (0, False, hashlib.sha256(b"").hexdigest())
