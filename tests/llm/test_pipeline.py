"""The pipeline against plain versions of its stages."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from fillwright.llm import line_dedup

from . import brute
from .test_queries import SF_DIR, check_packing


def plain_lines(docs):
    def frequent(held):
        pages, totals = {}, {}
        for (source, page), lines in held.items():
            totals.setdefault(source, set()).add(page)
            for line in lines:
                pages.setdefault((source, line), set()).add(page)
        return {k for k, n in pages.items() if len(n) >= line_dedup.MIN_PAGES and len(n) > line_dedup.MAX_RATIO * len(totals[k[0]])}

    texts = {(source, text): {x.strip(" ") for x in (text or "").split("\n")} - {""} for _, text, source in docs}
    gone = frequent(texts)
    groups = {}
    for (source, text), lines in texts.items():
        common = frozenset(x for x in lines if (source, x) in gone)
        alike = common and sum(map(len, common)) >= line_dedup.NEAR * sum(map(len, lines))
        groups.setdefault((source, common if alike else text), set()).update(common)
    gone = frequent(groups)
    return [(i, "\n".join(x for x in text.split("\n") if (s, x.strip(" ")) not in gone) if text is not None else None, s) for i, text, s in docs]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    numbers = [name for name, _ in corpus_pipeline.STAGES]
    assert len(numbers) == 5 and corpus_pipeline.ORACLE_SQL is None
    good = corpus_pipeline.quality_classifier(spark, docs, SF_DIR)
    assert good.columns == docs.columns
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF_DIR}/labels.parquet'").fetchall())
    kept = {r.doc_id for r in good.collect()}
    judged = [(i in kept) == bool(q) for i, q in quality.items()]
    assert sum(judged) / len(judged) > 0.9
    rows = [(r.doc_id, r.text, r.source) for r in good.collect()]

    lines = corpus_pipeline.line_dedup(spark, good, SF_DIR)
    assert lines.columns == docs.columns
    want = plain_lines(rows)
    assert sorted((r.doc_id, r.text, r.source) for r in lines.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    single = corpus_pipeline.minhash_near_dedup(spark, lines, SF_DIR)
    assert single.columns == docs.columns
    left = {i for i, _, _, k in brute.near_duplicates([(i, t) for i, t, _ in want]) if k}
    assert {r.doc_id for r in single.collect()} == left

    clean = corpus_pipeline.benchmark_decontamination(spark, single, SF_DIR)
    assert clean.columns == docs.columns
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    texts = [(i, t) for i, t, _ in want if i in left]
    good_ids = {r[0] for r in brute.decontamination(texts, items) if not r[5]}
    assert {r.doc_id for r in clean.collect()} == good_ids

    final = [(i, t) for i, t in texts if i in good_ids]
    check_packing([tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).collect()], final)


def test_pipeline_with_edges(spark, tmp_path):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "src1", None)], table.schema)
    for name, frame in (("some", table.union(odd)), ("none", table.limit(0))):
        folder = str(tmp_path / name)
        frame.write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            held = spark.read.parquet(f"{SF_DIR}/{other}.parquet")
            (held if name == "some" else held.limit(0)).write.parquet(f"{folder}/{other}.parquet")
        assert (corpus_pipeline.run(spark, folder).count() > 0) == (name == "some")


def test_copies_keep_their_lines(spark):
    copied = "a title\nfirst own line\nsecond own line"
    rows = [(i, copied, "en", "h", len(copied)) for i in range(20)]
    rows += [(100 + i, f"menu\nown line {i}", "en", "h", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SF_DIR).collect()}
    assert all(got[i] == copied for i in range(20))
    assert all(got[100 + i] == f"own line {i}" for i in range(40))


def test_near_copies_keep_their_lines(spark):
    shared = "a title of some length\nfirst own line of them\nsecond own line of them"
    rows = [(i, f"{shared}\nedit {i}", "en", "h", 0) for i in range(20)]
    rows += [(100 + i, f"menu\nown line {i}, which is longer than the menu", "en", "h", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SF_DIR).collect()}
    assert all(got[i] == f"{shared}\nedit {i}" for i in range(20))
    assert all(got[100 + i] == f"own line {i}, which is longer than the menu" for i in range(40))
    named = docs.withColumn("n_lines", F.lit("kept")).withColumn("n_dropped", F.lit(2))
    assert corpus_pipeline.line_dedup(spark, named, SF_DIR).columns == named.columns
