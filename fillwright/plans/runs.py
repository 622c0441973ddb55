"""Whole runs over the tables: instruction tasks, token completion, training files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fillwright.functions.chat_templates import render_template_chat
from fillwright.functions.text import extract_code_block, render_template
from fillwright.functions.tokens import byte_tokenizer
from fillwright.operators.completions import (
    batch_widths,
    budget_batches,
    code_answers,
    complete,
    complete_tokens,
    padding_share,
)
from fillwright.operators.instruct import (
    attach_fewshots,
    chat_messages,
    fewshot_prefix_compact,
    mapper_for,
    render_chat,
)
from fillwright.operators.ordering import seeded_shuffle
from fillwright.operators.sft import sft_batches
from fillwright.plans.catalogue import query
from fillwright.plans.prompts import _DS_LEAD, _fence_sql, _prefix_sql
from fillwright.plans.training import PAIR_TEMPLATE, TOKENS, _example_sql
from fillwright.plans.views import (
    DOCUMENT_PAIR_SQL,
    EXAMPLES,
    PAIR_SQL,
    WS_SQL,
    document_pairs,
    documents,
    sft_pairs,
    sql_text,
    table,
    with_sql,
)
from fillwright.session import scratch_dir
from fillwright.sources.readers import (
    inline_fewshots,
    open_benchmark,
    open_text2code,
    read_fewshots,
    read_sft_jsonl,
)
from fillwright.sources.writers import write_batches, write_solutions


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/runs-{uuid.uuid4().hex}"


_SHOTS = "".join(p.rstrip() + s.strip() for p, s in EXAMPLES)


@query(f"SELECT doc_id, md5({sql_text(_SHOTS)} || text) AS md5_prompt FROM documents")
def q_attach_fewshots(spark, sf_dir):
    """Examples from a JSON file, in front of every document."""
    path = f"{_folder(spark)}/shots"
    shots = inline_fewshots(spark, EXAMPLES)
    example = F.struct("ord", "problem", "solution")
    listed = F.transform(F.sort_array(F.collect_list(example)), lambda e: e.dropFields("ord"))
    shots.agg(F.to_json(listed).alias("value")).coalesce(1).write.text(path)
    block = fewshot_prefix_compact(read_fewshots(spark, path))
    prompts = attach_fewshots(documents(spark, sf_dir), block)
    return prompts.select("doc_id", F.md5(F.concat("shots", "text")).alias("md5_prompt"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS n FROM documents")
def q_open_text2code(spark, sf_dir):
    """A task map without splits, through the mapper of its benchmark."""
    tasks = open_text2code(spark, "humaneval", f"{sf_dir}/documents.parquet")
    named = tasks.withColumnsRenamed({"doc_id": "task_id", "text": "prompt"})
    mapped = mapper_for("humaneval")(named)
    return mapped.select("id", F.char_length("prompt").cast("bigint").alias("n"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS task_id, md5(text) AS md5_prompt, lang AS suffix
    FROM documents"""
)
def q_open_infill(spark, sf_dir):
    """Infill tasks of a benchmark named on a command line."""
    path = f"{_folder(spark)}/tasks.jsonl"
    docs = documents(spark, sf_dir)
    rows = docs.select(F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("prompt"), F.col("lang").alias("suffix"))
    rows.write.json(path, compression="gzip")
    kind, tasks = open_benchmark(spark, "hei", path)
    return tasks.select("task_id", F.md5("prompt").alias("md5_prompt"), "suffix")


@query(
    f"""WITH p AS (SELECT doc_id, {_fence_sql(_DS_LEAD, "text")} || chr(10) || {_prefix_sql("text")}
      AS prompt, '{{"lang":"' || lang || '"}}' AS metadata FROM documents)
    SELECT 'n' || length(prompt) || chr(10) AS code, metadata FROM p"""
)
def q_write_ds_solutions(spark, sf_dir):
    """Data-science instruct run: split, map, render, complete, cut, write."""
    docs = documents(spark, sf_dir)
    literal = F.concat(F.lit('{"lang":"'), "lang", F.lit('"}'))
    rows = docs.select(F.col("doc_id").alias("task_id"), F.col("text").alias("prompt"), literal.alias("metadata"))
    path = f"{_folder(spark)}/test"
    rows.write.parquet(path)
    tasks = open_text2code(spark, "ds1000", {"train": f"{path}-none", "test": path})
    mapped = mapper_for("ds1000", shots=EXAMPLES)(tasks.withColumn("metadata", F.parse_json("metadata")))
    prompt = render_template("{instruction}\n{response}", instruction=F.col("instruction"), response=F.col("response_prefix"))
    done = complete(mapped.select(prompt.alias("prompt"), "metadata"), _fenced_length())
    cut = code_answers(done.withColumn("completion", extract_code_block("completion")))
    written = write_solutions(cut, f"{_folder(spark)}/solutions.jsonl", "ds1000")
    answers = spark.read.schema("code string, metadata variant").json(written)
    return answers.select("code", F.to_json("metadata").alias("metadata"))


def _fenced_length():
    def make():
        return lambda prompts: [f"n{len(p)}```\nmore" for p in prompts]

    return make


ROLES = {"user": ("<user>\n", "\n"), "assistant": ("<answer>\n", "\n")}


@query("SELECT doc_id, md5('<user>' || chr(10) || text || chr(10) || '<answer>') AS md5_chat FROM documents")
def q_render_chat(spark, sf_dir):
    docs = documents(spark, sf_dir)
    chat = render_chat(chat_messages("text"), ROLES, "<answer>")
    return docs.select("doc_id", F.md5(chat).alias("md5_chat"))


# Three shapes of chat templates that public tokenizers carry.
TEMPLATES = {
    "marked": (
        "{% for message in messages %}{{'<|im_start|>' + message['role'] + '\n' + message['content'] "
        "+ '<|im_end|>' + '\n'}}{% endfor %}"
        "{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"
    ),
    "bracketed": (
        "{% for message in messages %}\n"
        "    {% if message['role'] == 'user' %}\n"
        "{{ bos_token + '[INST] ' + message['content'] | trim + ' [/INST]' }}\n"
        "    {%- elif message['role'] == 'assistant' -%}\n"
        "{{ ' ' + message['content'] | trim + ' ' + eos_token }}\n"
        "    {%- endif %}\n"
        "{% endfor %}"
    ),
    "headed": (
        "{%- if messages[0]['role'] != 'system' -%}{{ bos_token + 'You answer questions.\n' }}{%- endif -%}"
        "{%- for message in messages -%}{%- if message['role'] == 'user' -%}"
        "{{'### Instruction:\n' + message.content + '\n'}}"
        "{%- else -%}{{'### Response:\n' + message.content}}"
        "{%- if not loop.last -%}{{ '\n<|EOT|>\n' }}{%- endif -%}{%- endif -%}{%- endfor -%}"
        "{%- if add_generation_prompt and messages[0]['role'] == 'user' -%}{{ '### Response:' }}{%- endif -%}"
    ),
}

_CHAT_SQL = """WITH m AS (SELECT *, turn // 8 AS part, row_number() OVER (PARTITION BY conv_id, turn // 8 ORDER BY turn) AS n,
  count(*) OVER (PARTITION BY conv_id, turn // 8) AS size,
  first_value(role) OVER (PARTITION BY conv_id, turn // 8 ORDER BY turn) AS head FROM conversations),
t AS (SELECT conv_id, part, any_value(head) AS head, count(*) AS n_messages,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS marked,
  string_agg(CASE role WHEN 'user' THEN '<s>[INST] ' || trim(text, {ws}) || ' [/INST]'
    WHEN 'assistant' THEN ' ' || trim(text, {ws}) || ' </s>' ELSE '' END, '' ORDER BY turn) AS bracketed,
  string_agg(CASE WHEN role = 'user' THEN '### Instruction:' || chr(10) || text || chr(10)
    ELSE '### Response:' || chr(10) || text || CASE WHEN n < size THEN chr(10) || '<|EOT|>' || chr(10) ELSE '' END
    END, '' ORDER BY turn) AS headed
  FROM m GROUP BY conv_id, part)
SELECT conv_id, part, n_messages, md5(marked || '<|im_start|>assistant' || chr(10)) AS marked, md5(bracketed) AS bracketed,
  md5(CASE WHEN head <> 'system' THEN '<s>You answer questions.' || chr(10) ELSE '' END || headed
    || CASE WHEN head = 'user' THEN '### Response:' ELSE '' END) AS headed FROM t"""


@query(_CHAT_SQL.format(ws=WS_SQL))
def q_chat_templates(spark, sf_dir):
    """Eight turns of a conversation at a time, through three chat templates."""
    turns = table(spark, sf_dir, "conversations").withColumn("part", F.expr("turn div 8"))
    message = F.struct("turn", "role", F.col("text").alias("content"))
    # eight turns at most
    chats = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    rendered = [
        F.md5(render_template_chat("messages", template, "<s>", "</s>")).alias(name)
        for name, template in TEMPLATES.items()
    ]
    return chats.select("conv_id", "part", F.size("messages").cast("bigint").alias("n_messages"), *rendered)


_TOKENS = 16_384
_BATCH_SQL = f"""WITH d AS (SELECT doc_id, octet_length(encode(text)) + 1 AS length FROM documents),
c AS (SELECT *, coalesce(list_filter({batch_widths(_TOKENS)}, lambda w: w >= length)[1], length) AS class FROM d),
p AS (SELECT *, (row_number() OVER (PARTITION BY class ORDER BY doc_id) - 1)
  // greatest(1, least(64, {_TOKENS} // class)) AS nth FROM c),
b AS (SELECT *, max(length) OVER (PARTITION BY class, nth) AS width, count(*) OVER (PARTITION BY class, nth) AS rows FROM p)
"""


@query(
    _BATCH_SQL
    + """SELECT doc_id, CASE WHEN width < 16384 THEN 'w' || width || ' r' || rows END AS completion FROM b"""
)
def q_budget_batches(spark, sf_dir):
    """Documents of like length in batches of 16,384 tokens; answers tell the batch."""
    length = F.octet_length("text") + 1
    batches = budget_batches(documents(spark, sf_dir), length, "doc_id", _TOKENS)
    sized = batches.withColumn("max_context_size", F.lit(_TOKENS))
    done = complete_tokens(sized, "text", byte_tokenizer(), _width_and_rows, max_new_tokens=32)
    return done.select("doc_id", "completion")


@query(
    _BATCH_SQL
    + """SELECT count(*) AS n, count(DISTINCT (class, nth)) AS batches, CAST(sum(width) AS BIGINT) AS tokens,
    round(1 - sum(length) / sum(width), 9) AS padding FROM b"""
)
def q_padding_share(spark, sf_dir):
    length = F.octet_length("text") + 1
    batches = budget_batches(documents(spark, sf_dir), length, "doc_id", _TOKENS)
    return padding_share(batches, length).withColumn("padding", F.round("padding", 9))


def _width_and_rows():
    return lambda rows, limits: [[*ids, *f"w{len(ids)} r{len(rows)}".encode(), 257] for ids in rows]


_CONTEXT = 2500


@query(
    f"""WITH b AS (SELECT doc_id, doc_id // 8 AS batch_id, octet_length(encode(text)) + 1 AS n FROM documents),
    w AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS width FROM b)
    SELECT doc_id, CASE WHEN width >= {_CONTEXT} THEN 'input fills the context' END AS reject_reason,
    CASE WHEN width < {_CONTEXT} THEN 'k' || least({_CONTEXT} - width, 200, {2 * _CONTEXT} - width) END AS completion
    FROM w"""
)
def q_complete_tokens(spark, sf_dir):
    """Batches of eight documents through a function over token ids."""
    docs = documents(spark, sf_dir).withColumn("batch_id", F.expr("doc_id div 8"))
    sized = docs.withColumn("max_context_size", F.lit(_CONTEXT))
    done = complete_tokens(sized, "text", byte_tokenizer(), _budget_in_words)
    return done.select("doc_id", "reject_reason", "completion")


def _budget_in_words():
    return lambda rows, limits: [[*ids, *f"k{n}".encode(), 257] for ids, n in zip(rows, limits)]


@query(
    with_sql(PAIR_SQL, DOCUMENT_PAIR_SQL, "v_all AS (SELECT id, problem, solution, 0 AS source_ord FROM v_sft UNION ALL SELECT id, problem, solution, 1 FROM v_docpair)", _example_sql("v_all", 1216))
    + """SELECT CAST(count(*) AS BIGINT) AS total,
    CAST(sum(exceeding_length::INT) AS BIGINT) AS truncated, true AS reported,
    CAST(sum(len(input_ids)) AS BIGINT) AS n_ids,
    CAST(ceil(count(*) / 32.0) AS BIGINT) AS batches FROM v_example"""
)
def q_training_run(spark, sf_dir):
    """Pairs of two corpora from files, shuffled, to stored padded batches; what was
    cut is counted, and the bounds are tested, by the pass that writes them."""
    folder = _folder(spark)
    paths = [f"{folder}/chat.jsonl", f"{folder}/docs.jsonl"]
    for df, path in zip((sft_pairs(spark, sf_dir), document_pairs(spark, sf_dir)), paths):
        df.select("problem", "solution").write.json(path)
    pairs = read_sft_jsonl(spark, paths)
    shuffled = seeded_shuffle(pairs, ["source_ord", "problem", "solution"], unique=False)
    report = write_batches(sft_batches(shuffled, PAIR_TEMPLATE, TOKENS, 32), f"{folder}/batches")
    stored = spark.read.parquet(f"{folder}/batches")
    real = F.size(F.filter("attention_mask", lambda m: m))
    return stored.agg(
        F.count("*").alias("total"),
        F.count_if("exceeding_length").alias("truncated"),
        (
            (F.count("*") == report["total"]) & (F.count_if("exceeding_length") == report["truncated"])
        ).alias("reported"),
        F.sum(real).cast("bigint").alias("n_ids"),
        F.countDistinct("batch_id").alias("batches"),
    )
