"""Operators on documents against brute force, on given tables and on small awkward ones."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tributary.llm import avi_mjpeg, license_diagonals, line_rules, pareto_mix, piece_trie, quality_qda, signature_tree, token_files

SF = "/root/testdata/sf0.001"
AWKWARD = [
    (1, None, "en", "a", "x"),
    (2, "", "en", None, "x"),
    (3, " \n\t ", None, "a", None),
    (4, "word " * 3000 + "end.", "en", "b", "x"),
    (None, "A lone id. " * 20, "en", "b", "x"),
    (5, "One. Two. Three. Four.", "en", "a", "x"),
    (5, "One. Two. Three. Four.", "en", "a", "x"),
    (6, "Under the MIT License, and CC-BY-NC; cc by nc cc by nc \x0b ▁ é 日本 🙂 <|endoftext|>   \x85 \\ [x]", "en", "a", "x"),
    (7, "long" * 30000, "en", "c", "x"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, size string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    return docs, [tuple(r) for r in docs.collect()]


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


# quality rules


def rules(text):
    w = words(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("which", ["given", "awkward"])
def test_line_rules_counts(which, given, awkward):
    docs = given[0] if which == "given" else awkward
    rows = line_rules.measure(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(r.text)
        assert not (r.base_failed and r.kept)


def test_line_rules_verdict(table, empty):
    prose = "\n".join(" ".join(f"word{i * j}" for j in range(7, 17)) + "." for i in range(1, 9))
    menu = "\n".join(["Home | About | Contact | News", "Login", "All rights reserved.", "wow!! such!! noise!! here!!", "no end of this line"] * 12)
    rows = {r.doc_id: r for r in line_rules.measure(table("doc_id int, text string", [(1, prose + "\nHome | About | Contact |\nAll rights reserved."), (2, menu + "\n" + prose[:200])])).collect()}
    assert rows[1].kept and rows[1].clean_text == prose
    assert not rows[2].kept and rows[2].n_words >= 50
    assert line_rules.measure(empty).count() == 0
    assert line_rules.stage(None, empty, "").columns == empty.columns


def test_line_rules_see_any_space_at_the_end_of_a_line(table):
    prose = [" ".join(f"word{i * j}" for j in range(7, 17)) + "." for i in range(1, 9)]
    menu = "Home | About | Contact |"
    texts = {"unix": "\n".join(prose), "windows": "\r\n".join(prose), "tabs": "\t \n".join(prose), "feeds": "\x0b\x0c\n".join(prose)}
    mixed = "\r\n".join([*prose[:4], menu]) + "\n" + "\n".join(prose[4:])
    rows = {r.name: r for r in line_rules.measure(table("name string, text string", [*texts.items(), ("mixed", mixed)])).collect()}
    for name, text in texts.items():
        assert rows[name].kept and rows[name].clean_text == text and rows[name].n_kept_words == rows["unix"].n_words
    assert rows["mixed"].kept and rows["mixed"].clean_text == "\r\n".join(prose[:4]) + "\r\n" + "\n".join(prose[4:])


# mix


def test_mix_against_order(table, empty):
    rows = [(i, "w " * (i % 37), f"s{i % 5}" if i % 11 else None) for i in range(900)] + [(1000, "w " * 4000, "s1"), (1000, "w " * 4000, "s1"), (1001, None, "s9"), (None, "w w", "s9")]
    docs = table("doc_id bigint, text string, source string", rows)
    got = pareto_mix.mix(docs).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        assert r.copies <= 2 and r.taken == r.copies * r.size
        by[r.source].append(r)
    names = sorted(k for k in by if k is not None) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    size = {k: sum(r.size for r in v) for k, v in by.items()}
    full, target = set(), {}
    while True:
        rate = (1.5 * total - sum(2 * size[k] for k in full)) / max(1e-9, sum(weight[k] for k in names if k not in full))
        more = {k for k in names if k not in full and rate * weight[k] > 2 * size[k]}
        if not more:
            break
        full |= more
    for k, v in by.items():
        target = 2 * size[k] if k in full else rate * weight[k]
        assert v[0].source_size == size[k] and math.isclose(v[0].target, target)
        assert abs(sum(r.taken for r in v) - target) <= max(r.size for r in v)
    assert sorted(map(str, got)) == sorted(map(str, pareto_mix.mix(docs.repartition(3)).collect()))
    assert pareto_mix.mix(empty).count() == 0


# token files

TOKENIZERS = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("which", ["given", "awkward"])
def test_token_files(which, spark, given, awkward):
    from tokenizers import Tokenizer

    docs = given[0] if which == "given" else awkward
    path = TOKENIZERS.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = token_files.encode_table(spark, docs, path, 50_257).collect()
    want, start = [], 0
    for doc, text in sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_units_are_encoded_on_their_own():
    import random

    path, rng = TOKENIZERS.path("byte_bpe_50k.json"), random.Random(1)
    encoder = token_files.Encoder(path, "<u2")
    parts = [*"ab Z.,!?'s  \n\n-_é日1 2\t\x85", "'s", "don't", "<|endoftext|>", ".,", "!!", " .", "\n "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(2000)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder(texts)] == want


@pytest.mark.parametrize("units", [20, 10**6])
def test_long_texts_are_encoded_in_segments(monkeypatch, units):
    monkeypatch.setattr(token_files, "SEGMENT", 50)
    monkeypatch.setattr(token_files, "CACHE_UNITS", units)
    encoder = token_files.Encoder(TOKENIZERS.path("byte_bpe_50k.json"), "<u2")
    texts = ["one two, three. " * 40 + "end", "x" * 1000, "a\nb " * 99 + "c\td", "long" * 5000 + " " + "word " * 20 + ".", "", "tail of\n"]
    for some in (texts, texts[::-1], texts[:1]):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder(some)] == [e.ids for e in encoder.tokenizer.encode_batch(some, add_special_tokens=False)]


def test_token_files_wide_and_empty(spark, empty, table):
    path = TOKENIZERS.path("byte_bpe_50k.json")
    assert token_files.encode_table(spark, empty, path, 50_257).count() == 0
    one = token_files.encode_table(spark, table("doc_id bigint, text string", [(1, "a b c")]), path, 1 << 17, end_id=70_000).first()
    assert (one.start, one.n_tokens) == (0, 4)


# quality classifier


def test_statistics_of_awkward_texts():
    for text in ("", " ", "x", "\n\n", "!" * 1000, "é" * 50, "a b " * 10_000):
        assert np.isfinite(quality_qda.statistics(text)).all() and len(quality_qda.statistics(text)) == len(quality_qda.FEATURES)


def test_discriminant_is_the_log_density_ratio():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))]
    model = quality_qda.from_moments([len(a) for a in x], [a.sum(0) for a in x], [a.T @ a for a in x], pool=0.0, ridge=0.0)
    point = np.array([[0.3, -0.2, 1.0]])

    def density(a):
        covariance, mean = np.cov(a.T), a.mean(0)
        d = point[0] - mean
        return math.log(len(a) / 500) - 0.5 * math.log(np.linalg.det(covariance)) - 0.5 * d @ np.linalg.inv(covariance) @ d

    assert math.isclose(model.scores(point)[0], 1 / (1 + math.exp(density(x[0]) - density(x[1]))), rel_tol=1e-9)
    assert quality_qda.from_moments([0, 0], np.zeros((2, 3)), np.zeros((2, 3, 3))).scores(point) == [0.5]
    assert quality_qda.from_moments([0, 5], np.zeros((2, 3)), np.zeros((2, 3, 3))).scores(point) == [1.0]


def test_classifier_on_held_out_rows(spark):
    got = {r.doc_id: r for r in quality_qda.query(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 for k, r in got.items())
    right = [got[k].predicted == q for k, q in labels.items() if got[k].held_out]
    assert sum(right) / len(right) > 0.95


def test_classifier_on_awkward_rows(spark, awkward, empty):
    vectors = quality_qda.features(awkward)
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (5, 1), (7, None), (3, 2), (6, 1), (6, 1)], "doc_id bigint, quality int")
    rows = quality_qda.score(vectors, quality_qda.train(vectors, labels)).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows) and {r.size for r in rows} == {"x", None}
    assert quality_qda.features(empty).count() == 0
    assert quality_qda.train(vectors, labels.limit(0)).constant == 0.5


# media


@pytest.mark.parametrize("which", ["given", "awkward"])
def test_media_round_trip(which, given, awkward):
    docs = given[0] if which == "given" else awkward
    rows = collections.defaultdict(list)
    for r in avi_mjpeg.digests(docs).collect():
        rows[r.doc_id].append(r)
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        for g in rows[r.doc_id]:
            assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert sum(map(len, rows.values())) == docs.count()


def test_media_parts():
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 256, (5, avi_mjpeg.HEIGHT, avi_mjpeg.WIDTH), np.uint8)
    files = avi_mjpeg.encode_frames(samples)
    assert (avi_mjpeg.decode_frames(files) == samples).all()
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" and b"\xff\xc3" in f for f in files)
    media = avi_mjpeg.write_avi(samples.tobytes()[:3000])
    frames, rate, length = avi_mjpeg.read_avi(media)
    assert (len(frames), rate, length) == (3, 25.0, 3000)
    with pytest.raises(ValueError):
        avi_mjpeg.decode_frames([files[0].replace(b"\xff\xc3", b"\xff\xc0")])
    with pytest.raises(ValueError):
        avi_mjpeg.read_avi(b"RIFF....WAVE")


def test_shots_and_clips(spark, table):
    dark, light = np.zeros((20, 16, 64), np.uint8) + 10, np.zeros((15, 16, 64), np.uint8) + 200
    first, difference = avi_mjpeg.shots(np.concatenate([dark, light, dark]))
    assert first.tolist() == [0, 20, 35] and difference[20] == 1
    media = avi_mjpeg.write_avi(np.concatenate([dark, light]).tobytes())
    rows = avi_mjpeg.clips(spark.createDataFrame([(1, bytearray(media)), (2, None)], "id int, media binary")).collect()
    assert [(r.id, r.clip, r.start_s, r.end_s, r.n_frames, r.mean_luma) for r in rows] == [(1, 0, 0.0, 0.8, 20, 10.0), (1, 1, 0.8, 1.4, 15, 200.0)]


# licences


def licence_places(text):
    w = words((text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = [(i, label) for label, phrase in license_diagonals.BASE for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


@pytest.mark.parametrize("which", ["given", "awkward"])
def test_licence_base(which, given, awkward):
    docs = given[0] if which == "given" else awkward
    got = sorted(((r.doc_id or 0, *r[1:6]) for r in license_diagonals.scan(docs).collect()), key=str)
    assert got == sorted(((r.doc_id or 0, *licence_places(r.text)) for r in docs.collect()), key=str)


def test_licence_spans(table, empty):
    grant = license_diagonals.TEMPLATES[0][1]
    drifted = grant.replace("free of charge", "entirely free of any charge")
    rows = {r.doc_id: r for r in license_diagonals.scan(table("doc_id int, text string", [(1, "x " + drifted), (2, grant[:60]), (3, grant.upper().replace(" ", "\n* ")), (4, "Under, the MIT license under the mit LICENSE")])).collect()}
    assert rows[3].labels == "mit" and rows[3].score == 1.0 and rows[3].n_base == 0
    assert rows[1].labels in ("", "mit") and rows[1].score < 1
    assert rows[2].labels == "" and rows[2].score == 0
    assert (rows[4].n_base, rows[4].first_word, rows[4].last_word, rows[4].base_labels) == (2, 0, 4, "mit")
    assert license_diagonals.scan(empty).count() == 0


def test_whole_licences_are_templates(table):
    whole = " ".join(f"word{i * 7 % 401}" for i in range(400))
    short = "licensed under the apache license version 2 0"
    touched = whole.replace("word70 ", "other ").replace("word301 ", "one more ")
    texts = [whole, "x y " + touched, " ".join(whole.split()[:200]), short.replace("2 0", "2 1"), short.replace("apache", "b").replace("under", "c")]
    docs = table("doc_id int, text string", list(enumerate(texts)))
    rows = {r.doc_id: r for r in license_diagonals.scan(docs, templates=[("long", whole), ("short", short)]).collect()}
    assert [rows[i].labels for i in range(5)] == ["long", "long", "", "apache-2,short", ""]
    assert rows[0].score == 1 and 0.99 < rows[1].score < 1 and rows[3].score == 1 and rows[3].base_labels == "apache-2"


def test_licences_in_long_texts(table):
    """Twice the words take about twice the time: a row per word that carries its text would take four times."""
    import time

    def scanned(n):
        start = time.time()
        docs = table("doc_id int, n int", [(1, n)]).selectExpr("doc_id", "concat(repeat('some word ', n div 2), 'under the MIT license') AS text")
        (row,) = license_diagonals.scan(docs).collect()
        assert (row.n_words, row.first_word, row.labels) == (n + 4, n, "mit")
        return time.time() - start

    scanned(1000)
    once = scanned(160_000)
    assert scanned(320_000) < 2 * once + 5


# pieces


def test_pieces_round_trip(spark, given, awkward, empty):
    path = piece_trie.model_path()
    for docs in (given[0], awkward):
        rows = piece_trie.digests(docs, path).collect()
        assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    back = piece_trie.decode(piece_trie.encode(awkward, path), path)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in AWKWARD)
    assert piece_trie.encode(empty, path).count() == 0


def test_segmentation_is_the_best(given):
    pieces = piece_trie.Pieces(piece_trie.model_path())
    score = {i: s for s, i in pieces.ids.values()}
    sample = {"▁" + w for _, text, _ in given[1][:12] for w in words(text)[:40]} | {"▁日本語", "x", "▁", "▁a🙂b"}
    sample |= {"▁" * n + w for n in range(1, 40) for w in ("", "return", "x")}

    def best(word):
        top = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                found = pieces.ids.get(word[start:end])
                if found:
                    top[end] = max(top[end], top[start] + found[0])
            if word[end - 1] not in pieces.ids:
                top[end] = max(top[end], top[end - 1] + pieces.unknown)
        return top[-1]

    got = dict(pieces.segment(sample))
    assert got.keys() == sample
    for word, ids in got.items():
        assert pieces.decode([pieces.ids["x"][1], *ids]).replace(" ", "▁") == word
        assert not word.startswith("▁" * 20) or len(ids) < len(word) / 4  # runs of blanks have pieces
        spelt = sum(len(c.encode()) for c in word if c not in pieces.ids)
        assert math.isclose(sum(score.get(i, 0) for i in ids) + pieces.unknown * sum(c not in pieces.ids for c in word), best(word))
        assert sum(i in set(pieces.bytes.values()) for i in ids) == spelt


# near duplicates


def sets_of(text):
    w = words((text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(d, sets_of(t)) for d, t in rows]
    by = collections.defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    seen = set()
    for group in by.values():
        for j in group:
            for i in group:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    if 100 * len(a & b) >= 75 * len(a | b):
                        parent[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[top(i)] = min(low.get(top(i), math.inf), math.inf if d is None else d)
    return sorted((str(d), len(s), None if low[top(i)] == math.inf else low[top(i)]) for i, (d, s) in enumerate(sets))


def test_near_duplicates_of_given_documents(given):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in signature_tree.join_components(given[0]).collect())
    assert got == brute_components([(d, t) for d, t, _ in given[1]])


def test_near_duplicates_at_the_threshold(table, awkward, empty):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(150):
        w = list(base[: rng.randrange(30, 400)] if i % 5 == 0 else base)
        for _ in range(rng.randrange(0, 22)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    passage = " ".join(base[:60])
    rows += [(200 + i, passage + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.choice([0, 5, 12, 20, 300])))) for i in range(60)]
    rows += [(300, "a b"), (301, "A  b"), (302, "a"), (303, None), (304, ""), (None, "a b"), (300, "a b")]
    docs = table("doc_id bigint, text string", rows)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in signature_tree.join_components(docs).collect())
    assert got == brute_components(rows)
    assert signature_tree.join_components(empty).count() == 0
    assert signature_tree.join_components(awkward).count() == len(AWKWARD)


def test_near_duplicates_that_extend_short_texts(table):
    import random

    rng = random.Random(11)
    rows = []
    for i in range(800):
        n = rng.randrange(35, 50)
        m = min(65, 4 * n // 3 - rng.randrange(0, 3))
        w = [f"w{rng.randrange(10**9)}" for _ in range(m + 4)]
        rows += [(2 * i, " ".join(w[: n + 4])), (2 * i + 1, " ".join(w))]
    docs = table("doc_id bigint, text string", rows)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in signature_tree.join_components(docs).collect())
    assert got == brute_components(rows)


def test_near_duplicates_of_rows_that_share_ids(table):
    import random

    rng = random.Random(12)
    fresh = lambda n=80: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    near = lambda text: " ".join([*text.split()[:-4], *fresh(4)])
    T, U, V, W, X, Y, Z = (" ".join(fresh()) for _ in range(7))
    rows = [(1, T), (2, T), (2, U), (3, near(U))]
    # a row without id that is a copy, and others without id that are not
    rows += [(None, T), (None, V), (9, near(V)), (None, W), (None, near(W))]
    # two texts of one id, each with a near copy
    rows += [(20, X), (20, Y), (21, near(X)), (22, near(Y))]
    rows += [(30, Z)] * 40 + [(31, near(Z)), (31, near(Z))]
    docs = table("doc_id bigint, text string", rows).repartition(5)
    named = lambda x: 10**6 if x is None else x
    got = sorted((str(named(r.doc_id)), r.n_shingles, named(r.component_id)) for r in signature_tree.join_components(docs).collect())
    assert got == brute_components([(named(d), t) for d, t in rows])
    left = collections.Counter((r.doc_id, r.text) for r in signature_tree.stage(None, docs, "").collect())
    assert left == collections.Counter((d, t) for d, t in rows if (d, t) in {(1, T), (2, U), (9, rows[6][1]), (20, X), (20, Y), (30, Z)} or d is None)


def test_shingles_are_those_of_the_words(given):
    for _, text, _ in given[1][:60]:
        assert len(signature_tree.shingles(text)) == len(sets_of(text))
    a, b = signature_tree.shingles("A b\tc\x0bd e f"), signature_tree.shingles("a  B c d e\nf ")
    assert (a == b).all() and len(a) == 2


def test_tree_bound_holds(given):
    texts = [t for _, t, _ in given[1][:80]]
    sets = [signature_tree.shingles(t) for t in texts]
    maps = [signature_tree.bitmap(s).view("<u8") for s in sets]
    for a, x in zip(sets[::3], maps[::3]):
        for b, y in zip(sets, maps):
            slack = min(len(s) - int(np.bitwise_count(m).sum()) for s, m in ((a, x), (b, y)))
            assert len(np.intersect1d(a, b)) <= slack + int(np.bitwise_count(x & y).sum())


def test_near_duplicates_of_a_crowd(table):
    """Two thousand texts of one template: half of them link in long chains, the others share much with all and link with none."""
    pick = np.random.default_rng(5)
    core = [f"core{i}" for i in range(60)]
    texts = []
    for i in range(2000):
        own = [f"own{i}x{j}" for j in range(45)] if i % 2 else [f"all{(i // 2 + j) // 40}x{j}" for j in range(45)]
        w = core + own
        if i % 2 == 0:
            w[int(pick.integers(60))] = f"odd{i}"
        texts.append(" ".join(w))
    docs = table("doc_id int, text string", list(enumerate(texts)))
    found = {r.doc_id: r.component_id for r in signature_tree.join_components(docs).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    up = list(range(2000))

    def top(x):
        while up[x] != x:
            x = up[x] = up[up[x]]
        return x

    for a in range(0, 2000, 2):  # texts with words of their own link with none
        for b in range(a + 2, 2000, 2):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert found == {i: top(i) for i in range(2000)}
    assert all(100 * len(sets[a] & sets[b]) < 75 * len(sets[a] | sets[b]) for a in range(1, 60, 2) for b in range(2000) if a != b)
