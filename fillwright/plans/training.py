"""Queries over token arrays and fine-tuning batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwright.functions.tokens import (
    attention_mask,
    byte_tokenizer,
    decode,
    drop_special_ids,
    encode,
    encoded_length,
    function_tokenizer,
)
from fillwright.operators.models import (
    attach_model,
    decoding_mode,
    reject_over_context,
    token_budget,
)
from fillwright.operators.ordering import shuffled_batches
from fillwright.operators.sft import (
    count_truncated,
    encode_with_padding,
    sft_batches,
    sft_map,
)
from fillwright.plans.catalogue import query
from fillwright.plans.views import (
    DOCUMENT_PAIR_SQL,
    MODEL_KEY_SQL,
    MODEL_SQL,
    PAIR_SQL,
    bytes_sql,
    csv_text,
    document_pairs,
    documents,
    model_key,
    sft_pairs,
    table,
    with_sql,
)

TOKENS = byte_tokenizer()
PAIR_TEMPLATE = "Q: {instruction}\nA: {response}"
LIMIT = 160
ROWS = 16

_TEXT_IDS = bytes_sql("text")


def _csv(array: str) -> str:
    return f"array_to_string({array}, ',')"


@query(
    f"""SELECT doc_id AS id, CAST(len({_TEXT_IDS}) + 2 AS BIGINT) AS n_ids,
    md5({_csv(f"[256] || {_TEXT_IDS} || [257]")}) AS md5_ids FROM documents"""
)
def q_encode_bytes(spark, sf_dir):
    ids = encode("text", TOKENS, add_bos=True, add_eos=True)
    return (
        documents(spark, sf_dir)
        .select(F.col("doc_id").alias("id"), ids.alias("ids"))
        .select("id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(csv_text("ids")).alias("md5_ids"))
    )


@query(
    f"""SELECT doc_id AS id, md5({_csv(f"[256] || {_TEXT_IDS}")}) AS md5_ids, md5(text) AS md5_text
    FROM documents"""
)
def q_encode_arrow(spark, sf_dir):
    tokens = byte_tokenizer(arrow=True)
    return (
        documents(spark, sf_dir)
        .select(F.col("doc_id").alias("id"), encode("text", tokens, add_bos=True).alias("ids"))
        .select(
            "id",
            F.md5(csv_text("ids")).alias("md5_ids"),
            F.md5(decode("ids", tokens)).alias("md5_text"),
        )
    )


@query(
    f"""SELECT doc_id AS id, CAST(octet_length(encode(text)) + 2 AS BIGINT) AS n_full,
    md5({_csv(f"[256] || ({_TEXT_IDS})[:{LIMIT}] || [257]")}) AS md5_ids FROM documents"""
)
def q_encode_truncated(spark, sf_dir):
    # the limit applies to the text's own ids; begin and end come on top
    ids = encode("text", TOKENS, add_bos=True, add_eos=True, truncation=LIMIT)
    full = encoded_length("text", TOKENS, add_bos=True, add_eos=True)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        full.cast("bigint").alias("n_full"),
        F.md5(csv_text(ids)).alias("md5_ids"),
    )


@query(
    f"""SELECT doc_id AS id, CAST(length(text) AS BIGINT) AS n_ids,
    md5({_csv("list_transform(string_split(text, ''), lambda c: unicode(c))")}) AS md5_ids
    FROM documents"""
)
def q_encode_function(spark, sf_dir):
    # a caller's tokenizer, here one id per code point
    points = function_tokenizer(
        lambda texts: [[ord(c) for c in t] for t in texts],
        lambda rows: ["".join(chr(i) for i in row) for row in rows],
    )
    return (
        documents(spark, sf_dir)
        .select(F.col("doc_id").alias("id"), encode("text", points).alias("ids"))
        .select("id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(csv_text("ids")).alias("md5_ids"))
    )


@query("SELECT doc_id AS id, md5(text) AS md5_text, true AS same FROM documents")
def q_decode_roundtrip(spark, sf_dir):
    ids = encode("text", TOKENS, add_bos=True, add_eos=True)
    back = decode("ids", TOKENS)
    return (
        documents(spark, sf_dir)
        .select(F.col("doc_id").alias("id"), "text", ids.alias("ids"))
        .select("id", "text", back.alias("back"))
        .select("id", F.md5("back").alias("md5_text"), (F.col("back") == F.col("text")).alias("same"))
    )


@query(
    f"SELECT doc_id AS id, md5({_csv(_TEXT_IDS)}) AS md5_ids FROM documents"
)
def q_drop_special_ids(spark, sf_dir):
    ids = F.concat(encode("text", TOKENS, add_bos=True, add_eos=True), F.array(F.lit(258)))
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.md5(csv_text(drop_special_ids(ids, TOKENS))).alias("md5_ids")
    )


def _example_sql(view: str, limit: int) -> str:
    prompt = bytes_sql("'Q: ' || problem || chr(10) || 'A: '")
    return f"""
v_ids AS (SELECT id, [256] || {prompt} AS p, {bytes_sql("solution")} || [257] AS c FROM {view}),
v_example AS (
  SELECT id, (p || c)[:{limit}] AS input_ids,
         (list_transform(p, lambda x: -100) || c)[:{limit}] AS labels,
         len(p) + len(c) > {limit} AS exceeding_length FROM v_ids)"""


@query(
    with_sql(PAIR_SQL, _example_sql("v_sft", LIMIT))
    + f"""SELECT id, {_csv("input_ids")} AS input_csv, {_csv("labels")} AS labels_csv,
    exceeding_length FROM v_example"""
)
def q_sft_map(spark, sf_dir):
    examples = sft_map(sft_pairs(spark, sf_dir), PAIR_TEMPLATE, TOKENS, LIMIT, keep=("id",))
    return examples.select(
        "id",
        csv_text("input_ids").alias("input_csv"),
        csv_text("labels").alias("labels_csv"),
        "exceeding_length",
    )


@query(
    with_sql(DOCUMENT_PAIR_SQL, _example_sql("v_docpair", 1216))
    + f"""SELECT id, md5({_csv("input_ids")}) AS md5_input, md5({_csv("labels")}) AS md5_labels,
    exceeding_length FROM v_example"""
)
def q_sft_map_documents(spark, sf_dir):
    examples = sft_map(document_pairs(spark, sf_dir), PAIR_TEMPLATE, TOKENS, keep=("id",))
    return examples.select(
        "id",
        F.md5(csv_text("input_ids")).alias("md5_input"),
        F.md5(csv_text("labels")).alias("md5_labels"),
        "exceeding_length",
    )


@query(
    with_sql(DOCUMENT_PAIR_SQL)
    + """SELECT CAST(sum(CASE WHEN octet_length(encode(problem)) + octet_length(encode(solution)) + 9
    > 1216 THEN 1 ELSE 0 END) AS BIGINT) AS truncated, count(*) AS total FROM v_docpair"""
)
def q_truncated(spark, sf_dir):
    return count_truncated(sft_map(document_pairs(spark, sf_dir), PAIR_TEMPLATE, TOKENS))


_BATCHED = with_sql(PAIR_SQL, _example_sql("v_sft", LIMIT)) + f""",
v_batch AS (
  SELECT *, (row_number() OVER (ORDER BY md5('42:' || id), id) - 1) // {ROWS} AS batch_id
  FROM v_example),
v_wide AS (SELECT *, CAST(max(len(input_ids)) OVER (PARTITION BY batch_id) AS INT) AS width FROM v_batch)
"""


def _batches(spark, sf_dir, tokenizer, pad_to_max_length=False):
    # ordered while the rows are still text
    pairs = sft_pairs(spark, sf_dir)
    return sft_batches(
        pairs, PAIR_TEMPLATE, tokenizer, ROWS, LIMIT, pad_to_max_length, keep=("id",), shuffle_by="id"
    )


def _padded_sql(width: str, pad: int) -> str:
    padded = f"list_resize(input_ids, {width}, {pad})"
    mask = f"list_transform({padded}, lambda x: x <> {pad})"
    return f"""{_csv(padded)} AS ids_csv, {_csv(f"list_resize(labels, {width}, -100)")} AS labels_csv,
    {_csv(mask)} AS mask_csv"""


def _flat(batches):
    return batches.select(
        "batch_id",
        "id",
        "width",
        csv_text("input_ids").alias("ids_csv"),
        csv_text("labels").alias("labels_csv"),
        csv_text("attention_mask").alias("mask_csv"),
    )


@query(_BATCHED + f"SELECT batch_id, id, width, {_padded_sql('width', 258)} FROM v_wide")
def q_collate(spark, sf_dir):
    return _flat(_batches(spark, sf_dir, TOKENS))


@query(
    with_sql(DOCUMENT_PAIR_SQL, _example_sql("v_docpair", 1216))
    + f""", b AS (SELECT *, (row_number() OVER (ORDER BY md5('42:' || id), id) - 1) // 64 AS batch_id
      FROM v_example),
    w AS (SELECT *, CAST(max(len(input_ids)) OVER (PARTITION BY batch_id) AS INT) AS width FROM b),
    p AS (SELECT *, list_resize(input_ids, width, 258) AS ids FROM w)
    SELECT batch_id, id, width, md5({_csv("ids")}) AS md5_ids,
    md5({_csv("list_resize(labels, width, -100)")}) AS md5_labels,
    CAST(len(list_filter(ids, lambda x: x <> 258)) AS INT) AS n_real FROM p"""
)
def q_sft_batches(spark, sf_dir):
    """The whole training table: shuffled documents to padded batches."""
    pairs = document_pairs(spark, sf_dir)
    batches = sft_batches(pairs, PAIR_TEMPLATE, TOKENS, 64, keep=("id",), shuffle_by="id")
    return batches.select(
        "batch_id",
        "id",
        "width",
        F.md5(csv_text("input_ids")).alias("md5_ids"),
        F.md5(csv_text("labels")).alias("md5_labels"),
        F.size(F.filter("attention_mask", lambda m: m)).alias("n_real"),
    )


@query(_BATCHED + f"SELECT batch_id, id, {LIMIT} AS width, {_padded_sql(str(LIMIT), 257)} FROM v_wide")
def q_collate_to_max(spark, sf_dir):
    # no pad id: padding is the end id, and the mask hides real end ids as well
    return _flat(_batches(spark, sf_dir, byte_tokenizer(pad_id=None), pad_to_max_length=True))


_PROMPT_IDS = f"[256] || {bytes_sql('problem')}"


@query(
    with_sql(PAIR_SQL)
    + f""", b AS (SELECT id, {_PROMPT_IDS} AS ids,
      (row_number() OVER (ORDER BY md5('42:' || id), id) - 1) // {ROWS} AS batch_id FROM v_sft),
    w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM b)
    SELECT batch_id, id, {_csv("list_transform(range(width - len(ids)), lambda x: 258) || ids")}
    AS ids_csv FROM w"""
)
def q_pad_left(spark, sf_dir):
    length = encoded_length("problem", TOKENS, add_bos=True)
    batches = shuffled_batches(sft_pairs(spark, sf_dir), "id", ROWS, length=length)
    padded = encode_with_padding(batches, "problem", TOKENS, add_bos=True)
    return padded.select("batch_id", "id", csv_text("input_ids").alias("ids_csv"))


@query(
    f"""SELECT doc_id AS id, {_csv(f"list_transform({_TEXT_IDS}, lambda x: x <> 32)")} AS mask_csv
    FROM documents"""
)
def q_attention_mask(spark, sf_dir):
    # the blank as pad id: every blank of the text is masked
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        csv_text(attention_mask(encode("text", TOKENS), 32)).alias("mask_csv"),
    )


@query(
    with_sql(MODEL_SQL)
    + f""", d AS (
      SELECT doc_id, {MODEL_KEY_SQL} AS model_key, octet_length(encode(text)) + 1 AS used FROM documents),
    j AS (SELECT *, coalesce(max_context_size, 16384) AS ctx FROM d LEFT JOIN v_models USING (model_key))
    SELECT model_key, doc_id AS id, CAST(least(ctx - used, 4000, 12000 - used) AS BIGINT) AS budget,
    CASE WHEN used >= ctx THEN 1 ELSE 0 END AS rejected FROM j"""
)
def q_token_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        model_key().alias("model_key"),
        encoded_length("text", TOKENS, add_bos=True).alias("used"),
    )
    marked = reject_over_context(attach_model(docs), "used")
    return marked.select(
        "model_key",
        F.col("doc_id").alias("id"),
        token_budget("used", max_new_tokens=4000, max_length=12000).alias("budget"),
        F.col("reject_reason").isNotNull().cast("int").alias("rejected"),
    )


@query(
    """SELECT (doc_id % 5) / CAST(4 AS DOUBLE) AS temperature, doc_id % 5 <> 0 AS do_sample,
    CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 5) / CAST(4 AS DOUBLE) END AS sampling_temperature,
    count(*) AS n FROM documents GROUP BY ALL"""
)
def q_decoding_mode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        ((F.col("doc_id") % 5) / F.lit(4.0)).alias("temperature")
    )
    columns = ["temperature", "do_sample", "sampling_temperature"]
    return decoding_mode(docs).groupBy(*columns).agg(F.count("*").alias("n"))
