"""Periodic runs, source divergence and decontamination against brute force, on given tables and on small awkward ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tributary.llm import benchmark_automaton, source_trees, square_catchers

SF = "/root/testdata/sf0.001"
BLANK_WORD = r"[^\x20\x09-\x0D]+"
ROWS = [
    (1, None, None, None, "x", 3),
    (2, "", "en", None, "x", 3),
    (3, " \n\t\x0b ", "en", "a", None, 3),
    (4, "word " * 3000 + "end.", "en", "b", "x", 3),
    (None, "A lone id. " * 20, "en", "b", "x", 3),
    (5, "One. Two. Three. Four.", "en", "a", "x", 3),
    (5, "One. Two. Three. Four.", "en", "a", "x", 3),
    (6, "a b a b a b a b\x1ca b a b \x85 é É 日本 🙂 é É 日本 🙂 é É 日本 🙂 é É 日本 🙂 \\ [x]", "en", "a", "x", 3),
    (7, "long" * 30000, "de", "c", "x", 3),
    (8, "x y z " * 60000, "de", "c", "x", 3),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, runs string, n_words int"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, docs.collect()


# periodic runs


def all_runs(t, least=6, exponent=4):
    """Every stretch of equal words at every distance, kept if no smaller distance fits it."""
    found = []
    for q in range(1, len(t) // exponent + 1):
        i = 0
        while i < len(t) - q:
            if t[i] != t[i + q]:
                i += 1
                continue
            s = i
            while i < len(t) - q and t[i] == t[i + q]:
                i += 1
            w = t[s : i + q]
            if len(w) >= max(least, exponent * q) and not any(w[d:] == w[:-d] for d in range(1, q)):
                found.append((s, len(w), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_in_regular_texts():
    pick = random.Random(3)
    for _ in range(1500):
        n, letters = pick.choice([5, 8, 13, 20, 40, 80, 150]), pick.choice([1, 2, 2, 3, 5])
        t = [pick.randrange(letters) for _ in range(n)]
        for _ in range(pick.randrange(4)):
            a, e = pick.randrange(n), pick.randrange(n + 1)
            p = pick.randrange(1, max(2, (n - a) // 3 + 1))
            for i in range(a, e):
                t[i] = t[a + (i - a) % p]
        want = all_runs(t)
        assert square_catchers.runs_of(t) == want
        assert square_catchers.runs_of(t, piece=pick.randrange(1, 30)) == want  # appended in any pieces


def test_runs_of_well_known_words():
    a, b = "0", "01"
    while len(b) < 2000:
        a, b = b, b + a
    assert square_catchers.runs_of(list(b)) == []  # no Fibonacci word holds a fourth power
    thue = "".join(str(i.bit_count() % 2) for i in range(4096))
    assert square_catchers.runs_of(list(thue)) == []
    assert square_catchers.runs_of(list((thue[:512] + "2") * 5)) == [(0, 2565, 513)]
    assert square_catchers.runs_of([0] * 300000) == [(0, 300000, 1)]


def planted(doc_id, text):
    t = re.findall(BLANK_WORD, text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and t:
        g = h // 10
        a = g % len(t)
        p = 1 + (len(t) - a) // (3 + g % 8)
        t = t[:a] + [t[a + (i - a) % p] for i in range(a, len(t))]
    return t


def run_row(doc_id, text, runs):
    t = planted(doc_id, text)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(t) if i not in dropped)
    digest = tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)


def test_runs_of_given_documents(given, spark):
    docs, rows = given
    got = {tuple(r) for r in square_catchers.query(spark, SF).collect()}
    assert got == {run_row(r.doc_id, r.text, all_runs(planted(r.doc_id, r.text))) for r in rows} and len(got) == len(rows)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_awkward_rows(awkward, empty):
    rows = square_catchers.digests(square_catchers.periodic_runs(square_catchers.planted(awkward))).collect()
    known = {4: [(0, 3000, 1)], 8: [(0, 180000, 3)]}
    want = [run_row(d, t, known[d] if d in known else all_runs(planted(d, t))) for d, t, *_ in ROWS]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    found = square_catchers.periodic_runs(awkward)
    assert sorted(found.columns) == sorted([*set(SCHEMA.replace(",", "").split()[::2]) - {"text"}, "collapsed"])
    assert found.filter("doc_id = 6").first().collapsed == "a b a b a b a b\x1ca b a b \x85 é É 日本 🙂 \\ [x]"
    assert square_catchers.digests(square_catchers.periodic_runs(square_catchers.planted(empty))).count() == 0


# divergence of sources


def audit(rows, least, top):
    """(lang, source, part, item, value, rank) from dense tables of all terms."""
    counts, among, groups = Counter(), Counter(), set()
    for r in rows:
        lang, source, text = (x or "" for x in (r.lang, r.source, r.text))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        counts.update((lang, source, w) for w in words)
        among.update((lang, w) for w in set(words))
    out = set()
    for lang, source in groups:
        kept = sorted(w for (x, w), n in among.items() if x == lang and n >= least)
        sources = sorted(s for x, s in groups if x == lang)

        def shares(which):
            total = {w: sum(counts[lang, s, w] for s in which) for w in kept}
            size = sum(total.values()) + 5 * len(kept)
            return {w: 1 + 1000000000 * (n + 5) // size for w, n in total.items()}

        mine, whole = shares([source]), shares(sources)
        pairs = []
        for other in sources:
            if other != source:
                theirs = shares([other])
                pairs.append((sum(abs(mine[w] - theirs[w]) for w in kept), other))
        terms = [(mine[w] - whole[w], w) for w in kept if counts[lang, source, w] and mine[w] > whole[w]]
        for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
            for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]):
                out.add((lang, source, part, item, value, i + 1))
    return out


def test_divergence_of_given_documents(given):
    docs, rows = given
    for least, top in ((30, 50), (3, 7)):
        got = [tuple(r) for r in source_trees.divergence(docs, least, top).collect()]
        want = audit(rows, least, top)
        assert set(got) == want and len(got) == len(want) and len(want) > 500


def test_divergence_of_awkward_rows(awkward, empty):
    for least in (1, 2, 99):
        got = {tuple(r) for r in source_trees.divergence(awkward, least).collect()}
        assert got == audit(awkward.collect(), least, 50)
    assert source_trees.divergence(empty).count() == 0


def test_counts_are_handed_over_in_parts(given):
    docs, _ = given
    whole = {tuple(r) for r in source_trees.term_counts(docs).collect()}
    assert whole == {tuple(r) for r in source_trees.term_counts(docs, held=50).collect()}


def test_tree_shares_paths(table):
    texts = {"a": "p q r s", "b": "p q r s t", "c": "p q u", "d": "p"}
    docs = table("lang string, source string, text string", [("x", s, t) for s, t in texts.items()])
    audited = source_trees.Audit(source_trees.term_counts(docs), 1)
    share = {r.rank: r.p for r in audited.counts.select("rank", "p").distinct().collect()}  # every term occurs once per source
    nodes = audited.nodes().collect()
    paths = defaultdict(int)
    order = {s: i for i, s in enumerate("dcab", 1)}  # fewest occurrences first
    for term in "pqrstu":
        path = sorted((order[s] << source_trees.SHARE_BITS) + share[order[s]] for s, t in texts.items() if term in t)
        for d in range(1, len(path) + 1):
            paths[tuple(path[:d])] += 1
    assert {tuple(r.path): r.m for r in nodes} == paths


# decontamination

ITEMS = [
    (1, "The quick brown Fox jumps over the lazy dog, and then it sleeps for nine hours."),
    (2, "the quick brown fox jumps over the lazy dog and then it runs"),
    (2, "another text of the same item"),
    (10, "forty-two"),
    (None, "É日本 🙂"),
    (4, None),
    (5, " .. "),
    (6, "É日本 🙂"),
]
TEXTS = [
    "Well: THE QUICK\nbrown-fox  jumps over the lazy dog; and then it sleeps, for nine hours! The rest forty two",
    "the quick brown fox jumps over the lazy dog",
    "forty\x00two forty two 42 é日本 É日本 🙂🙂 É日本 🙂",
    "another text of the same items another text of the same item another text of the same item",
    "athe quick brown fox jumps over the lazy dog and",
    None,
    "",
]


def contaminated(text, items):
    def norm(t):
        lower = re.sub("[A-Z]", lambda x: x[0].lower(), t or "")
        return [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]

    places = norm(text)
    words, hit, found = [w for *_, w in places], set(), set()
    for item, asked in items:
        w = [x for *_, x in norm(asked)]
        for i in range(len(w) - min(len(w), 10) + 1 if w else 0):
            window = w[i : i + 10]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found.add("" if item is None else str(item))
    spans, marks = [], sorted(hit)
    for i in marks:
        if spans and spans[-1][1] == i - 1:
            spans[-1] = (spans[-1][0], i, spans[-1][2], places[i][1])
        else:
            spans.append((i, i, *places[i][:2]))
    return len(words), len(hit), spans, sorted(found)


@pytest.mark.parametrize("block_chars", [benchmark_automaton.BLOCK_CHARS, 150])
def test_contamination_of_small_texts(table, block_chars):
    texts = TEXTS + [t for t, *_ in [(x[1],) for x in ROWS[:9]]]
    docs = table("doc_id int, text string, spans int, other string", [(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, TEXTS[0], 1, "x")])
    items = table("item_id bigint, text string", ITEMS)
    out = benchmark_automaton.contamination(docs, items, block_chars=block_chars)
    assert sorted(out.columns) == sorted(["doc_id", "other", "n_words", "n_hit", "spans", "items"])
    rows = out.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        n, hit, spans, found = contaminated(texts[r.doc_id], ITEMS)
        assert (r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"]) == (n, hit, spans, found), r.doc_id


def test_spans_are_offsets_of_the_text(table):
    docs = table("doc_id int, text string", [(0, "🙂 Well, " + TEXTS[0])])
    (span, last) = benchmark_automaton.contamination(docs, table("item_id int, text string", ITEMS)).first().spans
    text = "🙂 Well, " + TEXTS[0]
    assert text[span.begin : span.end].startswith("THE QUICK\nbrown") and text[span.begin : span.end].endswith("nine hours")
    assert text[last.begin : last.end] == "forty two"


def test_contamination_of_empty_tables(table, empty, awkward):
    items = table("item_id bigint, text string", ITEMS)
    assert benchmark_automaton.contamination(empty, items).count() == 0
    rows = benchmark_automaton.digests(benchmark_automaton.contamination(awkward, items.limit(0))).collect()
    assert len(rows) == len(ROWS) and not any(r.contaminated for r in rows)


def test_marks_join_to_spans():
    marks = np.array([1, 1, 0, 1, 0, 0, 1], bool)
    assert [(s["first"], s["last"]) for s in benchmark_automaton.stretches(b"a b c d e f g", marks)] == [(0, 1), (3, 3), (6, 6)]
