"""Token arrays, training examples and batches against plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fillwright.functions import tokens as tk
from fillwright.operators import sft
from fillwright.operators.ordering import chunk

BYTES = tk.byte_tokenizer()
ARROW = tk.byte_tokenizer(arrow=True)
POINTS = tk.function_tokenizer(
    lambda texts: [[ord(c) for c in t] for t in texts],
    lambda rows: ["".join(chr(i) for i in row) for row in rows],
    bos_id=-1,
    eos_id=-2,
    special_ids=(-1, -2),
)
TEMPLATE = "[{instruction}] {response}"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    alphabet = "ab é\n　🙂\x00ß"
    values = ["", "x", "é", "🙂"] + [
        "".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(60)
    ]
    return spark.createDataFrame(list(enumerate(values)), "id int, t string").cache()


@pytest.mark.parametrize("tokenizer", [BYTES, ARROW])
def test_byte_ids_equal_utf8(texts, tokenizer):
    rows = texts.select(
        "t",
        tk.encode("t", tokenizer).alias("ids"),
        tk.encode("t", tokenizer, add_bos=True, add_eos=True, truncation=4).alias("cut"),
        tk.encode("t", tokenizer, truncation=0).alias("none"),
        tk.encoded_length("t", tokenizer, add_bos=True).alias("n"),
    ).collect()
    for r in rows:
        data = list(r.t.encode())
        assert r.ids == data
        assert r.cut == [256, *data[:4], 257]
        assert r.none == []
        assert r.n == len(data) + 1


@pytest.mark.parametrize("tokenizer", [BYTES, ARROW])
def test_null_text_has_null_ids(spark, tokenizer):
    rows = [("ab",), (None,), ("",), ("é",), (None,)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    ids = tk.encode("t", tokenizer)
    got = df.select(ids.alias("ids"), tk.decode(ids, tokenizer).alias("back")).collect()
    assert [r.ids for r in got] == [[97, 98], None, [], [195, 169], None]
    assert [r.back for r in got] == [t for t, in rows]


@pytest.mark.parametrize("tokenizer", [BYTES, ARROW])
def test_decode_round_trip(texts, tokenizer):
    ids = tk.encode("t", tokenizer, add_bos=True, add_eos=True)
    for r in texts.select("t", tk.decode(ids, tokenizer).alias("back")).collect():
        assert r.back == r.t
    cut = tk.encode(F.lit("a🙂"), tokenizer, truncation=3)
    assert "�" in texts.select(tk.decode(cut, tokenizer)).first()[0]


def test_no_specials_defined(texts):
    bare = tk.byte_tokenizer(None, None, None)
    ids = tk.encode("t", bare, add_bos=True, add_eos=True)
    assert all(r.ids == list(r.t.encode()) for r in texts.select("t", ids.alias("ids")).collect())
    with pytest.raises(ValueError):
        bare.pad_token_or_eos
    assert tk.byte_tokenizer(pad_id=None).pad_token_or_eos == 257
    assert BYTES.pad_token_or_eos == 258


def test_function_tokenizer(texts):
    ids = tk.encode("t", POINTS, add_bos=True, add_eos=True, truncation=5)
    rows = texts.select("t", ids.alias("ids")).select(
        "t", "ids", tk.decode("ids", POINTS).alias("back")
    )
    for r in rows.collect():
        assert r.ids == [-1, *[ord(c) for c in r.t[:5]], -2]
        assert r.back == r.t[:5]


def expected_example(problem, solution, limit, encode, bos, eos):
    prompt = [bos, *encode(TEMPLATE.format(instruction=problem, response=""))]
    answer = [*encode(solution), eos]
    whole = prompt + answer
    labels = [-100] * len(prompt) + answer
    return whole[:limit], labels[:limit], len(whole) > limit


@pytest.mark.parametrize("limit", [1, 5, 9, 12, 1216])
@pytest.mark.parametrize("kind", ["bytes", "arrow", "function"])
def test_sft_map(texts, limit, kind):
    tokenizer = {"bytes": BYTES, "arrow": ARROW, "function": POINTS}[kind]

    def encode(text):
        return [ord(c) for c in text] if kind == "function" else list(text.encode())

    pairs = texts.select("id", F.col("t").alias("problem"), F.reverse("t").alias("solution"))
    sources = {r.id: r for r in pairs.collect()}
    got = sft.sft_map(pairs, TEMPLATE, tokenizer, limit, keep=("id",))
    assert got.columns == ["id", "input_ids", "labels", "exceeding_length"]
    rows = got.collect()
    for r in rows:
        pair = sources[r.id]
        want = expected_example(
            pair.problem, pair.solution, limit, encode, tokenizer.bos_id, tokenizer.eos_id
        )
        assert (r.input_ids, r.labels, r.exceeding_length) == want
    counted = sft.count_truncated(got).first()
    assert tuple(counted) == (sum(r.exceeding_length for r in rows), len(rows))


def test_library_tokenizer(texts):
    tokenizers = pytest.importorskip("tokenizers")
    bpe = tokenizers.Tokenizer(tokenizers.models.BPE())
    bpe.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    bpe.decoder = tokenizers.decoders.ByteLevel()
    trainer = tokenizers.trainers.BpeTrainer(
        vocab_size=300, initial_alphabet=tokenizers.pre_tokenizers.ByteLevel.alphabet(),
        show_progress=False,
    )
    bpe.train_from_iterator(["ab ab ab a b", "é 🙂 ab"], trainer)
    library = tk.function_tokenizer(
        lambda batch: [e.ids for e in bpe.encode_batch(batch, add_special_tokens=False)],
        lambda rows: bpe.decode_batch(rows),
        eos_id=299,
        special_ids=(299,),
    )
    ids = tk.encode("t", library, add_eos=True)
    rows = texts.select("t", ids.alias("ids")).select("t", "ids", tk.decode("ids", library).alias("b"))
    for r in rows.collect():
        assert r.ids == [*bpe.encode(r.t, add_special_tokens=False).ids, 299]
        assert r.b == r.t


def test_user_tokenizer_runs_once_per_column(texts):
    pairs = texts.select(F.col("t").alias("problem"), F.col("t").alias("solution"))
    plan = sft.sft_map(pairs, TEMPLATE, POINTS)._jdf.queryExecution().executedPlan().toString()
    evals = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(evals) == 1 and evals[0].count("to_ids(") == 2


def test_parts_of_an_example(spark):
    df = spark.createDataFrame([("ab", "c")], "p string, s string")
    prompt, answer = sft.sft_prompt_ids("p", BYTES), sft.sft_completion_ids("s", BYTES)
    row = df.select(prompt.alias("p"), answer.alias("c")).select(
        "p", "c", sft.sft_concat("p", "c"), sft.sft_labels("p", "c"), sft.sft_truncate("p", 2)
    ).first()
    assert list(row) == [
        [256, 97, 98], [99, 257], [256, 97, 98, 99, 257], [-100, -100, -100, 99, 257], [256, 97],
    ]


def test_padding(spark):
    df = spark.createDataFrame([([1, 2],), ([],), ([1, 2, 3],)], "ids array<int>")
    right = [r[0] for r in df.select(tk.pad_right("ids", 3, 9)).collect()]
    left = [r[0] for r in df.select(tk.pad_left("ids", 3, 9)).collect()]
    assert right == [[1, 2, 9], [9, 9, 9], [1, 2, 3]]
    assert left == [[9, 1, 2], [9, 9, 9], [1, 2, 3]]
    with pytest.raises(Exception, match="below the length"):
        df.select(tk.pad_right("ids", 2, 9)).collect()


def test_mask_hides_real_end_ids_when_padding_is_the_end(spark):
    df = spark.createDataFrame([([5, 257, 257],)], "ids array<int>")
    assert df.select(tk.attention_mask("ids", 257)).first()[0] == [True, False, False]


def test_strip_prompt_ids(spark):
    df = spark.createDataFrame([([1, 2, 3], 2), ([1], 1), ([], 0)], "o array<int>, n int")
    assert [r[0] for r in df.select(tk.strip_prompt_ids("o", "n")).collect()] == [[3], [], []]


def collated(rows, pad, limit, to_max):
    width = limit if to_max else max(len(r[0]) for r in rows)
    out = []
    for ids, labels in rows:
        ids = ids + [pad] * (width - len(ids))
        out.append((ids, labels + [-100] * (width - len(labels)), [i != pad for i in ids]))
    return out


@pytest.mark.parametrize("to_max", [False, True])
def test_batches(texts, to_max):
    pairs = texts.select(
        F.col("id").alias("ord"), F.col("t").alias("problem"), F.reverse("t").alias("solution")
    )
    limit = 20
    got = sft.sft_batches(pairs, TEMPLATE, BYTES, 7, limit, to_max, keep=("ord",)).collect()
    plain = {r.ord: r for r in sft.sft_map(pairs, TEMPLATE, BYTES, limit, keep=("ord",)).collect()}
    assert len(got) == len(plain)
    by_batch = {}
    for r in sorted(got, key=lambda r: r.ord):
        assert r.batch_id == r.ord // 7
        by_batch.setdefault(r.batch_id, []).append(r)
    for batch in by_batch.values():
        want = collated(
            [(plain[r.ord].input_ids, plain[r.ord].labels) for r in batch], 258, limit, to_max
        )
        assert [(r.input_ids, r.labels, r.attention_mask) for r in batch] == want
        assert {r.width for r in batch} == {len(want[0][0])}
    # collate finds the same widths from the arrays themselves
    examples = sft.sft_map(chunk(pairs, 7), TEMPLATE, BYTES, limit, keep=("ord", "batch_id"))
    again = sft.collate(examples, 258, limit, to_max).collect()
    assert {r.ord: r.input_ids for r in again} == {r.ord: r.input_ids for r in got}


def test_batch_over_the_limit_raises(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [1, 2, 3])], "batch_id int, input_ids array<int>, labels array<int>")
    with pytest.raises(Exception, match="wider than the limit"):
        sft.collate(df, 0, 2).collect()


def test_encode_with_padding(texts):
    batches = texts.withColumn("batch_id", F.col("id") % 3)
    for side in ("left", "right"):
        rows = sft.encode_with_padding(batches, "t", BYTES, side, add_bos=True).collect()
        width = {}
        for r in rows:
            width[r.batch_id] = max(width.get(r.batch_id, 0), len(r.t.encode()) + 1)
        for r in rows:
            ids = [256, *r.t.encode()]
            pad = [258] * (width[r.batch_id] - len(ids))
            assert r.input_ids == (pad + ids if side == "left" else ids + pad)
    with pytest.raises(ValueError):
        sft.encode_with_padding(batches, "t", BYTES, "middle")


def test_batches_tokenize_once(texts):
    pairs = texts.select("id", F.col("id").alias("ord"), F.col("t").alias("problem"), F.col("t").alias("solution"))
    batches = sft.sft_batches(pairs, TEMPLATE, POINTS, 7, 20, keep=("id",))
    padded = sft.encode_with_padding(pairs.withColumn("batch_id", F.col("id") % 2), "problem", POINTS)
    for df, calls in ((batches, 2), (padded, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        evals = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
        assert len(evals) == 1 and evals[0].count("to_ids(") == calls
    widths = {(r.batch_id, r.width): None for r in batches.collect()}
    assert len(widths) == len({b for b, _ in widths})
    assert all(len(r.input_ids) == r.width == len(r.labels) for r in batches.collect())
    assert all(len(r.input_ids) == r.width for r in padded.collect())


@pytest.mark.parametrize("arrow", [False, True])
def test_special_ids_have_no_bytes(spark, arrow):
    df = spark.createDataFrame([([256, 97, 98, 257],)], "ids array<int>")
    tokens = tk.byte_tokenizer(arrow=arrow)
    assert df.select(tk.decode("ids", tokens, skip_special=False)).first()[0] == "ab"


def test_a_batch_of_ids_is_given_back_in_pieces(spark):
    ids, text = tk._arrow_byte_functions()
    widen, narrow = (next(c.cell_contents.func for c in f.__closure__ if hasattr(c.cell_contents, "func")) for f in (ids, text))
    rows = [b"", None, b"ab" * tk.CHUNK, *[b"x" * 3000] * 1000, None]
    made = list(widen(iter([pa.array(rows, pa.binary()), pa.array([], pa.binary())])))
    assert pa.chunked_array(made).to_pylist() == [None if r is None else list(r) for r in rows]
    assert all(len(piece) == 1 or len(piece.flatten()) <= tk.CHUNK for piece in made)
    back = list(narrow(iter([pa.concat_arrays(made)])))
    assert pa.chunked_array(back).to_pylist() == rows
    assert len(back) > 3
    frame = spark.createDataFrame([(i, None if r is None else r.decode()) for i, r in enumerate(rows)], "i int, text string").coalesce(1)
    got = frame.select("i", tk.encode("text", ARROW).alias("ids"), "text").select("i", F.size("ids"), tk.decode("ids", ARROW).eqNullSafe(F.col("text"))).collect()
    assert sorted(tuple(x) for x in got) == [(i, None if r is None else len(r), True) for i, r in enumerate(rows)]
