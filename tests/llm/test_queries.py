"""Each query over the smallest tables, against its plain version or its SQL."""

import html
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points
from fillwright.llm import queries

from . import brute

SF_DIR = "/root/testdata/sf0.001"


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF_DIR}/{name}.parquet'").fetchall()


def run(spark, name):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, SF_DIR).collect())


def test_every_operator_has_a_query():
    numbers = {re.match(r"op(\d+)_", name)[1] for name in queries.QUERIES}
    assert numbers == {str(n) for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_points.queries())


def test_op1(spark):
    texts = dict(table("documents", "doc_id, text"))
    got = run(spark, "op1_secrets")
    assert len(got) == len(texts)
    for doc_id, n_assign, n_access, n_hex, digest, spans, *_ in got:
        base = brute.base_secrets(texts[doc_id])
        assert digest == brute.sha(",".join(base))
        assert [n_assign, n_access, n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(spans.split(",")) | {""}


def test_op2(spark):
    got = {r[0]: r for r in run(spark, "op2_main_text")}
    pages = table("pages", "page_id, html")
    assert len(got) == len(pages)
    for page_id, source in pages:
        inside = re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1]
        spaced = re.sub(r"</?(?:p|h1|br|ul|li|div)\b[^>]*>", " ", inside)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", spaced)).split())
        assert got[page_id][2:4] == (want, len(want))


def test_op3(spark):
    assert run(spark, "op3_repeats") == sorted(brute.repeats(table("documents", "doc_id, text")))


def test_op4(spark):
    labels = dict(table("labels", "doc_id, quality"))
    got = run(spark, "op4_quality")
    assert all(held == (zlib.crc32(str(i).encode()) % 3 == 1) for i, held, _, _ in got)
    assert all(0 <= score <= 1 and predicted == (score >= 0.5) for _, _, score, predicted in got)
    judged = [predicted == labels[i] for i, held, _, predicted in got if held and i in labels]
    assert sum(judged) / len(judged) >= 0.9


def test_op5(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    assert run(spark, "op5_lines") == sorted(db.execute(queries.ORACLES["op5_lines"]).fetchall())


def test_op6(spark):
    assert run(spark, "op6_near_duplicates") == sorted(brute.near_duplicates(table("documents", "doc_id, text")))


def test_op7(spark):
    texts = dict(table("documents", "doc_id, text"))
    got = run(spark, "op7_sharding")
    loads, places = defaultdict(int), defaultdict(list)
    for doc_id, size, crc, law, shard, slot, grown, *_ in got:
        raw = (texts.pop(doc_id) or "").encode()
        assert (size, crc, law, grown) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        loads[shard] += size
        places[shard].append(slot)
    assert not texts
    assert set(loads) == set(range(40))
    largest = max(size for _, size, *_ in got)
    assert max(loads.values()) - min(loads.values()) <= largest
    assert all(sorted(held) == list(range(len(held))) for held in places.values())


def test_op8(spark):
    check_packing(run(spark, "op8_packing"), table("documents", "doc_id, text"))


def check_packing(got, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = {}
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for number, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want[doc_id, number] = (start, len(part), zlib.crc32(part.tobytes()))
    assert {(r[0], r[1]): r[2:5] for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for *_, length, _, sequence, offset in got:
        bins[sequence].append((offset, length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r[3] for r in got)
    assert len(bins) <= 1.01 * -(-total // 2048) + 1


def test_op9(spark):
    assert run(spark, "op9_near_vectors") == sorted(brute.near_vectors(table("embeddings", "vec_id, embedding, label")))


def test_op10(spark):
    docs, items = table("documents", "doc_id, text"), table("benchmark", "item_id, text")
    assert run(spark, "op10_decontamination") == sorted(brute.decontamination(docs, items))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op7_sharding"}))
def test_no_cross_join(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", ["op5_lines", "op7_sharding"])
def test_native(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
