"""Conversations, archives, registration and the pipeline."""

import base64
import collections
import hashlib
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import database, rows_of
from tributary.llm import chat_layouts, registry, warc_chain
from tributary.tables import shared_folder

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# conversations


def test_conversations_as_given(spark):
    got = {r.conv_id: r for r in chat_layouts.query(spark, SF).collect()}
    by = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    by[-1] = [(0, "user", chat_layouts.CONTROL), (1, "assistant", chat_layouts.CONTROL)]
    assert got.keys() == by.keys()
    for k, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha(loss))


def test_awkward_turns(table):
    hard = "\\ \\e \\l < [s]\\b </s><s>[user]\n ]\n 🙂é" * 3
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", hard), (1, 2, None, hard), (1, 3, "assistant", ""),
        (2, 0, "a]\n[b", "</s>"), (2, None, "assistant", "first"), (2, 0, "a]\n[b", "</s>"), (2, 5, "human", "h"), (2, 3, "gpt", "g"),
        (None, 0, "user", "x" * 100_000), (3, 0, "user", "only"),
    ]
    records = chat_layouts.as_records(table("conv_id bigint, turn bigint, role string, text string", rows))
    formatted = chat_layouts.format_turns(chat_layouts.conversations(chat_layouts.canonical_turns(records, keys=("conv_id", "part"))))
    back = {r.conv_id: r for r in chat_layouts.read_back(formatted).collect()}
    by = collections.defaultdict(list)
    for k, turn, role, text in rows:
        by[k].append(((turn is not None, turn or 0), role or "", text or ""))
    assert back.keys() == by.keys()
    for k, turns in by.items():
        turns.sort()
        assert [tuple(x) for x in back[k].turns] == [(r, t) for _, r, t in turns]
        assert back[k].loss_text == "".join(t for _, r, t in turns if r == "assistant")
        assert back[k].formatted.count("</s>") == len(turns) == back[k].formatted.count("<s>[")


def test_long_conversations(spark):
    """Twice the turns take about twice the time, and every assistant text is under the mask."""
    import time

    def formatted(n):
        start = time.time()
        turn = spark.range(n).selectExpr("CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('text <', id, '>') AS text", "id")
        whole = turn.groupBy().agg(F.sort_array(F.collect_list(F.struct("id", "role", "text"))).alias("t")).select(F.lit(1).alias("conv_id"), F.expr("transform(t, x -> struct(x.role AS role, x.text AS text)) AS turns"))
        (row,) = chat_layouts.digests(chat_layouts.format_turns(whole)).collect()
        loss = "".join(f"text <{i}>" for i in range(1, n, 2))
        assert (row.n_turns, row.loss_chars, row.loss_sha256) == (n, len(loss), sha(loss))
        return time.time() - start

    for n in (1, 255, 256, 257, 513, 1000):
        formatted(n)
    once = formatted(25_000)
    assert formatted(50_000) < 2 * once + 5


def test_layouts_are_told_by_fingerprints(spark, tmp_path):
    (tmp_path / "mixed.json").write_text(
        "\n".join(
            [
                '{"conv_id": 1, "prompt": "p", "completion": "c", "other": 1}',
                '{"conv_id": 2, "task": {"instruction": "i", "output": "o"}}',
                '{"conv_id": 3, "messages": [{"role": "user", "content": "u"}, {"role": "assistant"}]}',
                '{"conv_id": 4, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}',
                '{"conv_id": 5, "system": "s"}',
                '{"conv_id": 6, "prompt": "p", "system": "s"}',
                '{"conv_id": 7, "messages": []}',
                '{"conv_id": 8, "prompt": "p", "messages": [{"role": "user", "content": "u"}]}',
            ]
        )
    )
    got = {r.conv_id: (r.layout, [tuple(x) for x in r.turns]) for r in chat_layouts.canonical_turns(spark.read.json(str(tmp_path))).collect()}
    assert got == {
        1: ("prompt", [("user", "p"), ("assistant", "c")]),
        2: ("instruction", [("user", "i"), ("assistant", "o")]),
        3: ("messages", [("user", "u"), ("assistant", "")]),
        4: ("conversations", [("user", "h"), ("assistant", "g")]),
        5: (None, []),
        6: ("prompt", [("system", "s"), ("user", "p")]),
        7: ("messages", []),
        8: (None, []),
    }
    assert chat_layouts.canonical_turns(spark.createDataFrame([], f"conv_id int, {chat_layouts.UNION}")).count() == 0


# archives


def archived(spark, pages, range_bytes):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    archives = warc_chain.write_archives(pages, folder)
    return folder, archives, warc_chain.read_archives(archives, folder, range_bytes)


def by_hand(rows):
    first = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", page)
    out, done = [], set()
    for page, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        response = first[html or ""] == page and (html or "") not in done
        if response:
            done.add(html or "")
        out.append((page, len(data), digest, "response" if response else "revisit", None if response else first[html or ""]))
    return sorted(out, key=str)


TRAP = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\nWARC/1.1\r\n"
#: Ends where the record around it ends: its successor is a true one.
INNER = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello"
PAGES = [
    (1, "http://a/", TRAP * 40), (2, "http://b/ c\r\nX: y", "same"), (3, None, "same"), (3, "http://d", "other"), (4, "u" * 100_000, None), (5, "é", ""),
    (10, "http://x", INNER), (6, "http://e", "WARC/1.1\r\n" * 3000), (None, "http://f", "lone"), (7, "http://g", "big" * 50_000), (8, "h", "same"), (9, "i", "twice"), (9, "i", "twice"), (9, "j", "twice"),
]


@pytest.mark.parametrize("range_bytes", [700, 1 << 14, 4 << 20])
def test_archives_round_trip(spark, table, range_bytes):
    pages = table("page_id bigint, url string, html string", PAGES).repartition(2)
    _, _, back = archived(spark, pages, range_bytes)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()]
    assert sorted(got, key=str) == by_hand(PAGES)


def test_candidates_inside_payloads_are_rejected(spark, table):
    pages = table("page_id bigint, url string, html string", PAGES).coalesce(1)
    folder, archives, back = archived(spark, pages, 1 << 12)
    seen = warc_chain.candidates(archives, folder, 1 << 12)
    assert seen.groupBy("name", "exit").count().filter("count > 1").count()
    assert seen.count() > len(PAGES) == back.count()
    texts = {r.page_id: bytes(r.payload).decode() for r in back.collect() if r.record_type == "response" and r.page_id in (1, 6, 7)}
    assert texts == {k: html for k, _, html in PAGES if k in (1, 6, 7)}


def test_given_pages(spark, table):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_chain.query(spark, SF).collect()]
    assert sorted(got, key=str) == by_hand(rows)
    _, _, back = archived(spark, table("page_id bigint, url string, html string", []), 1 << 12)
    assert back.count() == 0


# registration


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_agrees(spark, name):
    df = registry.queries()[name](spark, SF)
    cursor = database(SF).execute(registry.oracle_sql()[name])
    columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, want)


def test_every_operator_has_one_query():
    numbers = [int(n.removeprefix("op").split("_")[0]) for n in registry.queries()]
    assert sorted(numbers) == list(range(1, 14))


# pipeline


def test_pipeline_is_its_stages(spark):
    from tributary.llm import line_rules, pareto_mix, piece_trie, quality_qda, signature_tree

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "source_mix", "piece_encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id: r.clean_text for r in line_rules.measure(docs).filter("kept").collect()}
    one = line_rules.stage(spark, docs, SF).cache()
    assert {r.doc_id: r.text for r in one.collect()} == kept and one.columns == columns
    two = quality_qda.stage(spark, one, SF).cache()
    assert two.columns == columns and {r.doc_id for r in two.collect()} <= kept.keys()
    three = signature_tree.stage(spark, two, SF).cache()
    component = {r.doc_id: r.component_id for r in signature_tree.join_components(two.select("doc_id", "text")).collect()}
    assert sorted(r.doc_id for r in three.collect()) == sorted(set(component.values())) and three.columns == columns
    four = pareto_mix.stage(spark, three, SF).cache()
    copies = {r.doc_id: r.copies for r in pareto_mix.mix(three).collect()}
    assert collections.Counter(r.doc_id for r in four.collect()) == {k: n for k, n in copies.items() if n} and four.columns == columns
    last = corpus_pipeline.run(spark, SF)
    pieces = piece_trie.Pieces(piece_trie.model_path())
    assert sorted((r.doc_id, pieces.decode(r.ids)) for r in last.collect()) == sorted((r.doc_id, r.text) for r in four.collect())


def test_duckdb_is_here():
    assert duckdb.connect().execute("SELECT 1").fetchall() == [(1,)]
