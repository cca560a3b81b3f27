"""Corpus operators against brute force on small tables and on the smallest given one."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orderglass.llm import exact_dedup, html_text, language_id, license_scan, mixing, near_dedup, packing, quality, substring_dedup, url_filter
from orderglass.llm.components import connected_components
from orderglass.llm.license_rules import compiled

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def given(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


# 1 substring deduplication

def brute_windows(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


def brute_removed(texts, length):
    found = []
    for text, marks in zip(texts, brute_windows(texts, length), strict=True):
        gone = bytearray(len(text))
        for i, mark in enumerate(marks):
            if mark:
                gone[i : i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        found.append((len(text), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return found


@pytest.mark.parametrize("seed", range(12))
def test_interval_expansion(seed):
    rng = random.Random(seed)
    length = rng.choice([4, 6, 7, 16, 20, 32, 48])
    base = bytes(rng.choice(b"ab" if seed % 2 else b"abcdef") for _ in range(300))
    pieces = [base[(a := rng.randint(0, 200)) : a + length + rng.randint(0, 80)] + bytes(rng.choices(b"abc", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
    assert [m.tolist() for m in substring_dedup.repeated_windows(pieces, length)] == brute_windows(pieces, length)


def test_only_windows_of_repeated_symbols_are_sorted(monkeypatch):
    rng = random.Random(3)
    pieces = [rng.randbytes(900) for _ in range(40)]
    pieces.append(pieces[0][100:600] + rng.randbytes(300))
    sorted_places, shared = [], substring_dedup._shared
    monkeypatch.setattr(substring_dedup, "_shared", lambda code, *rest: sorted_places.append(len(code)) or shared(code, *rest))
    assert [m.tolist() for m in substring_dedup.repeated_windows(pieces, 400)] == brute_windows(pieces, 400)
    # 101 windows stand twice: the places of their symbols, of 36,840 places in all.
    assert sorted_places == [2 * (101 + 360)]


@pytest.mark.parametrize("length", [3, 8, 12, 40])
def test_symbols_with_equal_hashes(length, monkeypatch):
    rng = random.Random(length)
    pieces = [bytes(rng.choices(b"ab", k=length + rng.randint(0, 90))) for _ in range(6)]
    pieces += [pieces[0][: length + 2], b"\0" * (length + 5)]
    monkeypatch.setattr(substring_dedup, "_gram_hashes", lambda data, gram: np.arange(len(data) - gram + 1, dtype=np.uint64) % 5)
    assert [m.tolist() for m in substring_dedup.repeated_windows(pieces, length)] == brute_windows(pieces, length)


def test_substrings_on_given(spark, given):
    rows = {r["doc_id"]: tuple(r)[1:5] for r in substring_dedup.op1_substring_dedup(spark, FOLDER).collect()}
    ids = sorted(given)
    assert [rows[i] for i in ids] == brute_removed([(given[i] or "").encode() for i in ids], 400)


def test_substrings_odd(docs_of, odd, monkeypatch):
    for many in (1500, 1):  # in blocks, and window by window
        monkeypatch.setattr(substring_dedup, "BLOCK_PIECES", many)
        rows = substring_dedup.remove_repeats(docs_of(odd), 40).collect()
        want = brute_removed([(text or "").encode() for _, text in odd], 40)
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == sorted(want)
    assert substring_dedup.remove_repeats(docs_of([]), 40).count() == 0


def test_substrings_of_null_ids(docs_of, monkeypatch):
    rng = random.Random(5)
    words = [f"{rng.getrandbits(40):x}" for _ in range(120)]
    texts = [f"{i} start " * 30 + " ".join(words[a : a + rng.randint(30, 60)]) + f" end {i}" * 30 for i, a in enumerate(rng.choices(range(90), k=24))]
    for ids in ([None] * 24, [i if i % 2 else None for i in range(24)]):
        for many in (1500, 1):
            monkeypatch.setattr(substring_dedup, "BLOCK_PIECES", many)
            rows = substring_dedup.remove_repeats(docs_of(list(zip(ids, texts, strict=True))), 120).collect()
            want = brute_removed([text.encode() for text in texts], 120)
            assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == sorted(want)


# 2 licenses

def test_license_places(docs_of, odd):
    rows = license_scan.scan_licenses(docs_of([
        (1, "CC-BY 4.0, cc by; All rights\nreserved. GNU Lesser General Public License v3"), (2, "accc by"), (3, "Released under the MIT License."), *odd,
    ])).collect()
    one, two, mit = rows[:3]
    assert (one["n_words"], one["n_base"], one["first_word"], one["last_word"]) == (15, 4, 0, 11)
    assert one["base_labels"] == "cc-by,gpl,reserved" and "lgpl" in one["labels"].split(",")
    assert (two["n_base"], two["first_word"], two["labels"], two["score"]) == (0, None, "", 0.0)
    assert mit["labels"] == "mit" and mit["score"] == 1.0
    assert len(rows) == 3 + len(odd) and rows[3]["n_words"] == 0
    assert license_scan.scan_licenses(docs_of([])).count() == 0


def test_license_rules():
    rules = compiled()
    assert len(rules) > 200
    assert all(re.compile(r[4]) for r in rules)


def texts_of_rule(pattern):
    """Shortest and longest texts that a rule matches, one per alternative of each of its words."""
    texts = set()
    words = [(w, bool(o)) for w, o in re.findall(r" \(\?:(.*?)\) (\)\?)?", pattern)]
    forms = [[re.sub(r"\[(.).*?\](\{4\})?\+?", lambda m: m[1] * (4 if m[2] else 1), f) for a in w.split("|") for f in {re.sub(r"(.)\?", "", a), a.replace("?", "")}] for w, _ in words]
    for i, of in enumerate(forms):
        for form in of:
            texts.add(" ".join(form if i == k else f[0] for k, f in enumerate(forms) if i == k or not words[k][1]))
            texts.add(" ".join(form if i == k else f[0] for k, f in enumerate(forms)))
    return texts


def test_license_keywords(docs_of):
    texts, rules = [], {}
    for rank, _, _, _, pattern in compiled():
        for text in texts_of_rule(pattern):
            spaced = "".join(f" {w} " for w in text.split(" "))
            if re.fullmatch(pattern, spaced):
                rules[len(texts)] = rank
                texts.append((len(texts), f"Zz {text.title() if text.isascii() else text}, zz"))
    assert set(rules.values()) == set(range(len(compiled())))
    rows = license_scan.scan_licenses(docs_of([*texts, (-1, "Released under GPLv3."), (-2, "LGPLv2, AGPLv3")])).collect()
    # Where another rule has the label, it found at least as long a stretch.
    ends = {r["doc_id"]: [(d["start"], d["end"], d["rule"]) for d in r["detections"]] for r in rows}
    for i, rank in rules.items():
        n = len(texts[i][1].split()) - 2
        assert any(a <= 1 and b >= 1 + n and rule <= rank for a, b, rule in ends[i]), (texts[i], ends[i])
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in rows}
    assert found[-1] == ("gpl", 0.8) and found[-2] == ("agpl,lgpl", 0.8)


# 3 pages

PAGE = (
    '<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>'
    '<div class="cookie-notice">We use cookies, do you agree?</div><article><h1>Title &amp; more</h1><p>First  <b>bold</b> line.<br>Goes on.'
    '<p>Second&nbsp;one, with text.</p><div class="ad">Buy now!</div><form>Name</form></article><aside>More</aside>'
    '<div id="comments"><p>Nice post, thanks a lot.</p></div><footer>&copy; x</footer></body></html>'
)


def test_page_text(spark):
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst bold line. Goes on.\n\nSecond one, with text."
    plain = "<body><div class=menu><a href=a>One</a></div><div><p>Some text, and then some more of it.</p><p>Again, text.</p></div></body>"
    assert html_text.main_text(plain) == "Some text, and then some more of it.\n\nAgain, text."
    pages = spark.createDataFrame([(1, "u", None, 3), (1, None, "", 3), (None, "u", PAGE, 3)], "page_id long, url string, html string, text int")
    assert sorted(r["n_chars"] for r in html_text.extract_pages(pages).collect()) == [0, 0, len(html_text.main_text(PAGE))]
    assert html_text.extract_pages(pages.limit(0)).count() == 0
    assert html_text.main_text("<p>" * 3000 + "deep" + "</b></i>" * 10 + "<" * 50) != ""


def test_page_names_only_weight():
    paragraphs = ["The council met on Monday, and it talked about the bridge for hours.", "Nobody, it said, had asked for the report.", "A vote is due in May; the mayor wants a new road."]
    text, body = "\n\n".join(paragraphs), "".join(f"<p>{p}</p>" for p in paragraphs)
    for line in ("<p class='post-meta'>By X</p>", "<p class='text-center'>By X</p>"):
        assert html_text.main_text(f"<body>{line}<div>{body}</div></body>") == f"By X\n\n{text}"
    for wrapper in (
        "class='content has-sidebar'", "id='no-sidebar'", "class='search-page'", "class='social-news'", "id='related_story'",
        "class='page-with-header content'", "class='notice-board'", "class='post-header-wide'",
    ):
        for tag in ("div", "section"):
            page = f"<body><nav>Home</nav><{tag} {wrapper}>{body}</{tag}><div class='sidebar'>{body}</div><footer>x</footer></body>"
            assert html_text.main_text(page) == text, wrapper
    for beside in ("<div class='share-buttons'>Share this, please.</div>", "<div class='comment-body'>Nice post, thanks.</div>", "<div class=widget-content>Read more, here.</div>"):
        assert html_text.main_text(f"<body><div>{body}</div>{beside}</body>") == text, beside


def test_page_skips_at_true_places():
    for letters in ("İ", "İ" * 40):
        for tag in ("script", "STYLE", "template"):
            page = f"<body><p>{letters} first, text.</p><{tag}>var a = 1;</{tag.lower()} ><p>Second one, with text.</p></body>"
            assert html_text.main_text(page) == f"{letters} first, text.\n\nSecond one, with text."


# 4 quality

def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, given, labels, docs_of, odd):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for rows, texts in ((quality.op4_quality_rules(spark, FOLDER), list(given.items())), (quality.judge_quality(docs_of(odd), labels), odd)):
        found = sorted((r["doc_id"] or 0, *(r[n] for n in names)) for r in rows.collect())
        assert found == sorted((doc or 0, *brute_quality(text)) for doc, text in texts)
    assert quality.judge_quality(docs_of([]), labels).count() == 0
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    judged = quality.op4_quality_rules(spark, FOLDER).filter("not base_failed").collect()
    assert all(r["kept"] for r in judged if r["doc_id"] in good)


# 5 near duplicates

def brute_groups(texts, size):
    sets, above = {}, {}
    for doc, text in texts:
        words = (text or "").translate(LOWER).encode().split()
        sets[doc] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
        above[doc] = doc

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def test_near_groups(spark, given, docs_of):
    rows = near_dedup.op5_near_dedup(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_groups(given.items(), 4)
    rng, base = random.Random(3), [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):  # a chain of ever more edits: links and near misses in one family
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(50)}"
        texts.append((i, " ".join(words)))
    rows = near_dedup.near_groups(docs_of(texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_groups(texts, 4)


def test_near_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)  # many pairs of blocks per family
    rng, texts = random.Random(4), []
    for i in range(90):
        words = [f"w{k}" for k in range(60)]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(60)] = f"x{rng.randrange(50)}"
        texts.append((i, " ".join(words)))
    rows = near_dedup.near_groups(docs_of(texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_groups(texts, 4)


def test_near_odd(docs_of, odd):
    rows = near_dedup.near_groups(docs_of(odd)).collect()
    assert len(rows) == len(odd) and all(r["component_id"] == 5 for r in rows if r["doc_id"] in (5, 6))
    assert {r["doc_id"] for r in near_dedup.drop_near_copies(docs_of(odd)).collect()} == {1, 2, 3, 4, 5, None, 7}
    assert near_dedup.near_groups(docs_of([])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


# 6 packing

def test_packing(spark, given, docs_of, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = [*odd, (8, "a <|endoftext|> b<|endoftext|>"), (9, " " * 100_000 + "x\n" + "\t" * 3_000), (10, "x" * 20_000), (11, "<|endoftext|" + " \u3000" * 900)]
    for rows, texts, limit in ((packing.op6_best_fit_packing(spark, FOLDER), list(given.items()), 2048), (packing.pack_documents(docs_of(odd), path, 64), odd, 64)):
        want, total = Counter(), 0
        for doc, text in texts:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
            total += len(ids)
            cuts = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)] if len(ids) > limit else [0, len(ids)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        rows = rows.collect()
        assert Counter(tuple(r)[:5] for r in rows) == want
        by = defaultdict(list)
        for r in rows:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= limit
        assert len(by) <= total / limit * 1.1 + 1
    assert packing.pack_documents(docs_of([]), path).count() == 0


def test_plan_covers_histogram():
    rng = random.Random(0)
    histogram = {rng.randint(1, 100): rng.randint(1, 1000) for _ in range(60)}
    slots = packing.plan_slots(histogram, 100)
    fill = Counter()
    for length, _, n, first, offset in slots:
        for s in range(first, first + n):
            assert fill[s] == offset
            fill[s] += length
    got = Counter()
    for length, rank, n, *_ in slots:
        assert rank == got[length]
        got[length] += n
    assert got == histogram and max(fill.values()) <= 100


# 7 mixing

def test_targets_and_flow():
    assert mixing.targets_by_weight({"a": 10, "b": 10, None: 100}, 120) == {"a": 22.5, "b": 30.0, None: 67.5}
    targets = mixing.targets_by_weight({"a": 1, "b": 50, None: 100}, 151)
    assert targets["a"] == 3.0 and abs(sum(targets.values()) - 151) < 1e-9
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10})
    assert sum(flow["a",].values()) == 10 and flow["a", "b"] == {"a": 10, "b": 0} and flow["b",] == {"b": 10}
    assert mixing.route({("a",): 10}, {"a": 25}) == {("a",): {"a": 25}}


def test_mix(spark, docs_of, odd):
    rows = mixing.op7_mix_sources(spark, FOLDER).collect()
    again = mixing.op7_mix_sources(spark, FOLDER).collect()
    assert sorted(rows) == sorted(again) and all(r["taken"] <= 3 * r["size"] for r in rows)
    by, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        source = r["source_size"], r["target"]
        by[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    assert all(-1 <= source[1] - taken <= largest[source] for source, taken in by.items())
    assert sum(by.values()) >= 0.95 * sum(r["size"] for r in rows)
    mixed = mixing.mix_documents(docs_of([(i, "a b c", "en", None if i % 2 else "x") for i in range(40)] + odd)).collect()
    assert len(mixed) == 40 + len(odd)
    assert mixing.mix_documents(docs_of([])).count() == 0
    kept = mixing.mixed_rows(docs_of([(i, "a b c", "en", "x" if i % 3 else "y") for i in range(300)]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "kept"] and kept.count() == 300


# 8 URLs

def test_urls(spark, labels):
    urls = ["http://a.b.NET/en/x", "https://sub.example.net/en/5?x=1", "http://example.com/de/1", "http://x.org/fr/#t", "http://x.org/en/", "nothing", None, "http://other.com", "ftp://a://b.net/?q"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judge_urls(pages, labels).collect()}
    assert rows[0] == ("a.b.net", "/en/x", "net/", "block")
    assert rows[1] == ("sub.example.net", "/en/5", "example.net/en/", "allow")
    assert rows[2][2:] == ("example.com/de/", "block") and rows[3][2:] == ("org/fr/", "allow")
    assert rows[5] == rows[6] == ("", "", None, "allow") and rows[8][:2] == ("a:", "//b.net/")
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0


def test_mined_rules(spark):
    rows = [(f"http://bad.com/p/{i}", "block") for i in range(30)] + [(f"http://good.com/p/{i}", "allow") for i in range(30)]
    rules = url_filter.mine_rules(spark.createDataFrame(rows, "url string, outcome string"), 0.05, 0.9).collect()
    assert {tuple(r["tokens"]) for r in rules} == {("h:bad.com",)}


def test_rules_of_all_sizes(spark):
    few = url_filter.MIN_PAGES
    allowed = [(f"http://h{i}.com/p/{i}", "allow") for i in range(20_000)]
    # A small host among many pages, too small a one, a deep host, and four tokens that only together are sure.
    rows = [("http://bad.com/x", "block")] * few + [("http://rare.com/x", "block")] * (few - 1)
    rows += [("http://a.b.c.d.e.org/", "block")] * few + [("http://z.b.c.d.e.org/", "allow")] * few
    parts = ["de", "shop", "cart"]
    rows += [("http://mix.net/de/shop/cart?id=1", "block")] * few
    rows += [(f"http://mix.net/{'/'.join(p for p in parts if p != gone)}?id=1", "allow") for gone in parts for _ in range(few)]
    rows += [("http://mix.net/de/shop/cart", "allow")] * few + [("http://w.net/de/shop/cart?id=1", "allow")] * few
    rules = url_filter.mine_rules(spark.createDataFrame(allowed + rows, "url string, outcome string")).collect()
    found = {tuple(r["tokens"]): r["confidence"] for r in rules}
    assert found[("h:bad.com",)] == found[("h:a.b.c.d.e.org",)] == 1.0
    assert found[("h:mix.net", "p:cart", "p:de", "p:shop", "q:id")] == 1.0
    assert not any("h:rare.com" in tokens or "h:b.c.d.e.org" in tokens for tokens in found)


# 9 languages

def test_languages(spark, docs_of, odd):
    rows = language_id.op9_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in tested) >= 0.95 * len(tested)
    model = language_id.train(docs_of([(1, "the cat"), (2, "der Hund", "de")]))
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs_of([*odd, (10, "hunde"), (11, "12 34"), (12, "½ ²")]), model).collect()}
    assert found[1] == found[2] == found[3] == found[11] == found[12] == "und" and found[10] == "de"
    empty = language_id.train(docs_of([]))
    assert [r["lang_pred"] for r in language_id.identify(docs_of([(1, "a")]), empty).collect()] == ["und"]


# 10 exact deduplication

def test_exact(spark, docs_of, odd, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_AT_ONCE", 2)
    rows = exact_dedup.exact_groups(docs_of(odd + [(8, "same")] * 5)).collect()
    same = [r for r in rows if r["keep_id"] == 8]
    assert len(same) == 9 and sum(r["kept"] for r in same) == 1 and all(r["group_size"] == 9 for r in same)
    assert sum(r["kept"] for r in rows) == len({text or "" for _, text in odd})
    kept = exact_dedup.drop_exact_copies(docs_of(odd + [(8, "same")] * 5))
    assert kept.columns == ["doc_id", "text", "lang", "source", "kept"] and kept.count() == len({text or "" for _, text in odd})
    assert exact_dedup.exact_groups(docs_of([])).count() == 0


def test_exact_oracle(spark):
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
        want = connection.execute(exact_dedup.ORACLE).fetchall()
    assert sorted(map(tuple, exact_dedup.op10_exact_dedup(spark, FOLDER).collect())) == sorted(want)


# Pipeline

def test_pipeline(spark, given, labels):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    want = {r["doc_id"] for r in quality.judge_quality(docs, labels).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    once = corpus_pipeline.exact_dedup(spark, kept, FOLDER)
    last = {given[i]: i for i in sorted(want)}
    assert {r["doc_id"] for r in once.collect()} == set(last.values())
    apart = corpus_pipeline.near_dedup(spark, once, FOLDER)
    groups = brute_groups([(i, given[i]) for i in sorted(last.values())], 5)
    assert {r["doc_id"] for r in apart.collect()} == {d for d, (_, top) in groups.items() if d == top}
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.filter(F.col("offset") + F.col("length") > 2048).count() == 0
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} <= {d for d, (_, top) in groups.items() if d == top}


def test_license_hits_are_linear(spark):
    text = "\n".join(f"file{i} licensed under the Apache License, Version 2.0 or GPLv3, all rights reserved" for i in range(6_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    license_scan.scan_licenses(docs.withColumn("text", F.lit("MIT License"))).collect()
    begin = time.perf_counter()
    row = license_scan.scan_licenses(docs).first()
    assert time.perf_counter() - begin < 20 and len(row["detections"]) >= 12_000
    places = [(d["start"], d["end"]) for d in row["detections"]]
    assert places == sorted(places) and all(a[1] < b[1] for a, b in zip(places, places[1:], strict=False))
    one = license_scan.scan_licenses(docs.withColumn("text", F.lit(text.split("\n")[0]))).first()
    n = row["n_words"] // 6_000
    assert {(a % n, b - a) for a, b in places} == {(d["start"], d["end"] - d["start"]) for d in one["detections"]}


@pytest.mark.parametrize("wrapper", ['class="story legal"', 'class="text promo"', 'class="content banner"', 'class="modal content"', 'class="search"', 'id="overlay"', 'id="form"'])
def test_wrappers_of_whole_articles(wrapper):
    article = [f"{name} of the story has many words, marks, and more." * 4 for name in ("First", "Second", "Third")]
    page = (
        f"<nav><a href=/>Home</a></nav><div class=promo><p>Buy now, cheap.</p></div><div {wrapper}>{''.join(f'<p>{p}</p>' for p in article)}"
        f"<div class=notice>We use cookies.</div></div><div class=comments><p>{'A reader writes. ' * 20}</p></div>"
    )
    assert html_text.main_text(page) == "\n\n".join(article)


@pytest.mark.parametrize("broken", ["<a ", "<!", "<a '", '<a "" ', "<b></i>", "<div>x"])
def test_broken_pages_are_linear(broken):
    begin = time.perf_counter()
    html_text.main_text(broken * (1_000_000 // len(broken)) if broken != "<div>x" else broken * 20_000)
    assert time.perf_counter() - begin < 5


def test_any_name_of_a_language(spark):
    rows = [(i, f"{word} {word}{i}", lang) for i, (word, lang) in enumerate([("uno", "gram"), ("eins", "a`b"), ("un", "n"), ("one", "number")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert found == {doc: lang for doc, _, lang in rows}


def test_urls_with_many_shared_names(spark):
    query = "&".join(f"utm{i}=1" for i in range(20))
    urls = [(f"http://a{i}.org/x{i}/?{query}", "block") for i in range(6)] + [("http://a9.org/?" + query, "allow")] * 2
    urls += [(f"http://b.com/y/?k={i}", "block") for i in range(6)] + [(f"http://c.com/z/{i}", "allow") for i in range(9)]
    begin = time.perf_counter()
    rules = {(tuple(r["tokens"]), round(r["confidence"], 3)) for r in url_filter.mine_rules(spark.createDataFrame(urls, "url string, outcome string")).collect()}
    assert time.perf_counter() - begin < 60
    assert rules >= {((f"q:utm{i}",), 0.75) for i in range(20)} | {(("h:b.com",), 1.0), (("p:y",), 1.0), (("q:k",), 1.0)}
    assert all(len(tokens) == 1 or sure > 0.75 for tokens, sure in rules)
