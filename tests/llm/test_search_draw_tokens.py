"""Operators 11 to 13: against plain versions, SQL and the tokenizer's library, with edge rows."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from fillwright.llm import byte_bpe, importance, lexical, queries

from . import brute
from .test_edges import DOCS, ITEM, rows_with_edges, words
from .test_queries import SF_DIR, run, table

KEY = lambda r: tuple((v is None, v or 0) for v in r)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows_with_edges(), DOCS).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op11_search", "op12_resampling"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF_DIR)
    cursor = db.execute(queries.ORACLES[name])
    order = [[c[0] for c in cursor.description].index(c) for c in got.columns]
    want = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(want, key=KEY)
    plain = {"op11_search": brute.search, "op12_resampling": brute.resampling}[name]
    assert sorted(plain(table("documents", "doc_id, text"), table("benchmark", "item_id, text")), key=KEY) == sorted(want, key=KEY)


# 11


def items_with_edges():
    r = random.Random(8)
    shared = words(30, 2)
    rows = [(i, f"{shared} {words(10, 20 + i)} own{i}") for i in range(12)]
    return rows + [(20, None), (21, ""), (22, "?!"), (23, "ONE two two Three"), (23, "one"), (None, shared), (24, "nowhere at all"), (25, " ".join(r.choice(["the3", "of4"]) for _ in range(60)))]


@pytest.mark.parametrize("block", [lexical.BLOCK_TERMS, 40])
def test_search(spark, docs, block):
    items = spark.createDataFrame(items_with_edges(), "item_id long, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    clash = docs.withColumn("score", F.lit("old")).withColumn("item", F.lit(1)).withColumn("id", F.lit(7))
    got = lexical.search_items(clash, items, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute.search([(i, t) for i, t, _ in rows_with_edges()], items_with_edges())
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(want, key=KEY)
    assert len({r[0] for r in want}) > 12


def test_search_in_empty_tables(spark, docs, empty):
    items = spark.createDataFrame(items_with_edges(), "item_id long, text string")
    assert lexical.search_items(empty, items).count() == 0
    assert lexical.search_items(docs, items.limit(0)).count() == 0
    assert lexical.search_items(docs.where("text IS NULL"), items).count() == 0


def test_shared_sums_are_the_whole_sums():
    r = np.random.default_rng(3)
    core = [list(range(40)), list(range(20, 60)), list(range(60, 64))]
    rows = {}
    for item in range(30):
        for term in {*core[item % 3], *core[(item + 1) % 2], *(int(x) for x in r.integers(0, 500, 6))}:
            rows[item, term] = int(r.integers(1, 4)) if term % 7 == 0 else 1
    item, term = np.array(list(rows)).T
    graph = lexical.share_terms(item, term, np.array(list(rows.values())))
    # each made node serves two items or more, and there is less to add up
    pairs = np.concatenate(graph.rounds)
    serves = [set() for _ in range(graph.size)]
    for i in range(len(graph.items)):
        for node in graph.nodes[graph.begin[i] : graph.begin[i + 1]]:
            serves[node].add(i)
    for made in range(graph.size - 1, graph.leaves - 1, -1):
        for node in pairs[made - graph.leaves]:
            serves[node] |= serves[made]
    assert len(pairs) and all(len(s) >= 2 for s in serves[graph.leaves :])
    assert len(graph.nodes) + len(pairs) < len(rows) / 2
    docs = 5
    value = r.integers(0, 1000, (len(graph.term), docs))
    place, row = np.nonzero(value >= 0)
    got = lexical._accumulated(graph, row, place, value[place, row], docs)
    spot = {t: i for i, t in enumerate(graph.term.tolist())}
    want = np.zeros_like(got)
    for (i, t), n in rows.items():
        want[graph.items.tolist().index(i)] += n * value[spot[t]]
    assert (got == want).all()


def test_lengths_beyond_64_bits():
    n = np.array([5, 1 << 40])
    assert lexical._length_factors(n, 1 << 30, 1 << 45).tolist() == [25 + 75 * int(x) * (1 << 30) // (1 << 45) for x in n]


def test_best_of_a_task_keeps_ties_by_id():
    r = random.Random(6)
    best = lexical._Best(3, 4)
    rows = []
    for _ in range(40):
        scores = np.array([[r.randrange(0, 5) for _ in range(6)] for _ in range(3)])
        ids, missing = np.array([r.randrange(30) for _ in range(6)]), np.array([int(r.random() < 0.1) for _ in range(6)])
        best.add(scores, missing, ids)
        rows += [(i, -scores[i, d], missing[d], ids[d]) for i in range(3) for d in range(6) if scores[i, d] > 0]
    want = [row for i in range(3) for row in sorted(x for x in rows if x[0] == i)[:4]]
    assert [(a, -b, c, d) for a, b, c, d in best.settle().T.tolist()] == [tuple(map(int, w)) for w in want]


# 12


def test_resampling(spark, docs, empty):
    target = [(1, ITEM), (2, None), (3, words(60, 2)), (4, "")]
    items = spark.createDataFrame(target, "item_id long, text string")
    clash = docs.withColumn("weight", F.lit("old")).withColumn("rank", F.lit("x")).withColumn("n_words", F.lit(None).cast("int"))
    for percent in (5, 60):
        got = importance.resample(clash, items, percent=percent).drop("n_words")
        want = brute.resampling([(i, t) for i, t, _ in rows_with_edges()], target, percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=KEY) == sorted(want, key=KEY)
    assert sum(r[4] is not None for r in want) == 6
    assert importance.resample(empty, items).count() == 0
    assert importance.resample(docs, items.limit(0)).count() == len(rows_with_edges())


@pytest.mark.parametrize(("bits", "rows"), [(3, 7), (11, 1 << 18)])
def test_radix_rank(spark, bits, rows):
    r = random.Random(bits)
    low, high = -(1 << 63), (1 << 63) - 1
    values = [(r.choice([r.randrange(-40, 40), low, high, None, 7]), r.choice([None, r.randrange(5)]), i) for i in range(300)]
    frame = spark.createDataFrame(values, "a long, b int, n int").repartition(5).withColumn("rank", F.lit("old"))
    for keys in ([("a", True), ("b", False)], [("b", True), ("n", False)], [("b", False)]):
        if bits == 3 and keys[0][0] == "a":
            continue  # 22 passes
        got = sorted(importance.radix_rank(frame, keys, "rank", bits, rows).collect(), key=lambda x: x.rank)
        assert [x.rank for x in got] == list(range(1, 301))
        order = [[(x[k] is None, (-x[k] if down else x[k]) if x[k] is not None else 0) for k, down in keys] for x in got]
        assert order == sorted(order)
    assert importance.radix_rank(frame.limit(0), [("a", True)]).count() == 0


def test_features_of_long_words():
    import pyarrow as pa
    import zlib

    from fillwright.llm.words import NOT_ALPHANUMERIC, Words

    r = random.Random(1)
    texts = [" ".join("é" * r.randrange(0, 40) + "aZ" * r.choice([1, 20, 24, 25, 200]) for _ in range(r.randrange(0, 7))) for _ in range(50)]
    held = Words(pa.array([*texts, None]), NOT_ALPHANUMERIC, lower=True)
    got = [[] for _ in range(held.rows)]
    for row, bucket in importance.feature_buckets(held, importance._lowered(held)):
        for i, b in zip(row, bucket, strict=True):
            got[i].append(b)
    for text, buckets in zip(texts, got, strict=False):
        ws = brute.lower(text).split()
        assert sorted(buckets) == sorted(zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(ws) - n + 1))


# 13


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.vocabulary_path(), known_words=400)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_op13(spark, library):
    texts = dict(table("documents", "doc_id, text"))
    got = run(spark, "op13_byte_bpe")
    assert len(got) == len(texts)
    for doc_id, n, ids_digest, decoded_digest in got:
        ids = library.encode_ordinary(texts[doc_id] or "")
        assert (n, ids_digest, decoded_digest) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(texts[doc_id] or ""))


def test_every_token_is_its_own_encoding(encoder):
    # what lets long words be contracted at many places in one round
    tokens = [t for t in encoder.ranks if len(t) > 1]
    for query in (byte_bpe._LEFTMOST, byte_bpe._EVERY_LEAST):
        ids, counts = encoder.contract(tokens, query)
        assert counts.max() == 1 and ids.tolist() == [encoder.ranks[t] for t in tokens]


def test_odd_texts(encoder, library, monkeypatch):
    r = random.Random(3)
    texts = ["", "a" * 5000, "aaab" * 900, "x" * 20_000, " \n\n \t x  ", "it's DON'T 日本語日本語" * 40, "\x00\x00a\x1c b\x85 c  ", "<|endoftext|>"]
    texts += ["".join(r.choice("ab") for _ in range(3000)), "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(900))]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x4E00, 0x9000), r.randrange(0x1F300, 0x1F600), 0x300])) for _ in range(4000))]
    want = [library.encode_ordinary(t) for t in texts]
    for size in (byte_bpe.SLICE, 50):
        monkeypatch.setattr(byte_bpe, "SLICE", size)
        values, counts = encoder.encode(texts)
        assert [p.tolist() for p in np.split(values, np.cumsum(counts)[:-1])] == want
        assert encoder.decode(values, counts) == [t.encode() for t in texts]


def test_coding_edges(spark, docs, empty, library):
    clash = docs.withColumn("ids", F.lit("old")).withColumn("decoded", F.lit(1)).withColumn("extra", F.lit("kept"))
    coded = byte_bpe.encode_texts(clash)
    assert coded.columns == ["doc_id", "text", "source", "decoded", "extra", "ids"]
    both = byte_bpe.decode_ids(coded)
    assert both.columns == ["doc_id", "text", "source", "extra", "ids", "decoded"]
    rows = both.collect()
    assert len(rows) == len(rows_with_edges())
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(empty)).count() == 0
    once = byte_bpe.round_trip(clash)
    assert once.columns == ["doc_id", "source", "extra", "ids", "decoded"]
    assert sorted(map(str, once.collect())) == sorted(map(str, both.drop("text").collect()))
    odd = spark.createDataFrame([(None,), ([],), ([64, None, 65, 999_999],)], "ids array<int>")
    known = library.decode_single_token_bytes
    assert [bytes(r.decoded) for r in byte_bpe.decode_ids(odd).collect()] == [b"", b"", known(64) + known(65)]
    broken = spark.sql("SELECT CAST(X'61FF62' AS STRING) AS text")
    assert bytes(byte_bpe.decode_ids(byte_bpe.encode_texts(broken)).first().decoded).decode() == "a�b"


def test_rank_file_without_a_byte(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="no token for the bytes"):
        byte_bpe.read_ranks(str(path))


def test_digests_are_of_the_whole_result(spark):
    row = queries.QUERIES["op13_byte_bpe"](spark, SF_DIR).orderBy(F.desc("n_tokens")).first()
    assert row.n_tokens > 1000 and len(row.ids_sha256) == len(hashlib.sha256().hexdigest())
