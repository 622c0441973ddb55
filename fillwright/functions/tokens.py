"""Token arrays as Column expressions, and the pluggable tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillwright.functions.text import _col

# Bytes or ids that a worker turns at once, whatever the size of the Arrow batch.
CHUNK = 1 << 20
IGNORED_INDEX = -100  # fixed value: label of positions the loss leaves out


@dataclass(frozen=True)
class Tokenizer:
    """How text becomes ids and back.

    ``ids(text, limit)`` gives at most ``limit`` ids of a text (all of them for
    None) and ``length(text)`` their full number; ``text(ids)`` is the inverse.
    ``cheap_length`` says that a length costs no tokenizing.
    """

    ids: Callable[[Column, int | None], Column]
    length: Callable[[Column], Column]
    text: Callable[[Column], Column]
    bos_id: int | None = None
    eos_id: int | None = None
    pad_id: int | None = None
    special_ids: tuple[int, ...] = field(default=())
    cheap_length: bool = True

    @property
    def pad_token_or_eos(self) -> int:
        """The pad id, or the end id for a tokenizer without one."""
        pad = self.pad_id if self.pad_id is not None else self.eos_id
        if pad is None:
            raise ValueError("the tokenizer has neither a pad nor an end id")
        return pad


def _utf8(text: Column, limit: int | None) -> Column:
    # the first bytes give the first ids, so a sequence that is cut anyway is
    # not expanded beyond its limit
    data = F.encode(text, "UTF-8")
    return data if limit is None else F.substring(data, 1, limit)


def _byte_ids(text: Column, limit: int | None) -> Column:
    # Latin-1 maps each byte to one character, so splitting that reading of the
    # UTF-8 bytes yields the bytes; the empty text would split into one piece
    chars = F.split(F.decode(_utf8(text, limit), "ISO-8859-1"), "")
    none = (F.octet_length(text) == 0) | F.lit(limit == 0)
    empty = F.array().cast("array<int>")
    return F.when(none, empty).otherwise(F.transform(chars, lambda c: F.ascii(c)))


def _byte_text(ids: Column) -> Column:
    # a sequence cut inside a character decodes to the replacement character
    chars = F.array_join(F.transform(ids, lambda i: F.char(i)), "")
    return F.make_valid_utf8(F.encode(chars, "ISO-8859-1").cast("string"))


def _pieces(rows: pa.Array, lengths: pa.Array) -> Iterator[pa.Array]:
    """Slices of an array whose ``lengths`` add up to ``CHUNK`` at most, or one row."""
    import numpy as np

    ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = before = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        yield rows.slice(at, upto - at)
        at, before = upto, int(ends[upto - 1])


def _arrow_byte_functions() -> tuple[Callable, Callable]:
    """The same two functions as one numpy cast per piece of an Arrow batch, no row loop."""

    def widened(data: pa.Array) -> pa.Array:
        import numpy as np

        data = data.cast(pa.large_binary())
        _, ends, values = data.buffers()
        at = np.frombuffer(ends, np.int64, len(data) + 1, data.offset * 8)
        raw = np.frombuffer(values or b"", np.uint8)[at[0] : at[-1]]
        starts = pa.array(at - at[0]).cast(pa.int32())
        return pa.ListArray.from_arrays(starts, pa.array(raw.astype(np.int32)), mask=data.is_null())

    def narrowed(ids: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(sizes, out=at[1:])
        raw = ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
        buffers = [None, pa.py_buffer(at), pa.py_buffer(raw)]
        data = pa.Array.from_buffers(pa.binary(), len(ids), buffers)
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.binary()), data)

    # ids are four times their text, so a batch is given back piece by piece
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def widen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc

        for data in batches:
            yield from map(widened, _pieces(data, pc.binary_length(data)))

    @F.arrow_udf(T.BinaryType())
    def narrow(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield from map(narrowed, _pieces(ids, ids.value_lengths()))

    return (
        lambda text, limit: widen(_utf8(text, limit)),
        lambda ids: F.make_valid_utf8(narrow(ids).cast("string")),
    )


def byte_tokenizer(
    bos_id: int | None = 256,
    eos_id: int | None = 257,
    pad_id: int | None = 258,
    arrow: bool = False,
) -> Tokenizer:
    """One id per UTF-8 byte; the special ids follow the bytes.

    Computed by expressions in the JVM, or with ``arrow=True`` by numpy in
    Python workers, which is faster on long texts and needs their memory.
    """
    specials = tuple(i for i in (bos_id, eos_id, pad_id) if i is not None)
    ids, text = _arrow_byte_functions() if arrow else (_byte_ids, _byte_text)
    # an id past the bytes has no text, also where special ids are not dropped
    return Tokenizer(ids, F.octet_length, lambda i: text(F.filter(i, lambda x: x < 256)), bos_id, eos_id, pad_id, specials)


def function_tokenizer(
    encode: Callable[[list[str]], list[list[int]]],
    decode: Callable[[list[list[int]]], list[str]],
    bos_id: int | None = None,
    eos_id: int | None = None,
    pad_id: int | None = None,
    special_ids: tuple[int, ...] = (),
) -> Tokenizer:
    """A tokenizer given as two Python functions over batches of texts.

    They run in Arrow batches next to the data and must not add specials. Ids
    are computed for the whole text, then cut.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def to_ids(texts: pa.Array) -> pa.Array:
        return pa.array(encode(texts.to_pylist()), pa.list_(pa.int32()))

    @F.arrow_udf(T.StringType())
    def to_text(rows: pa.Array) -> pa.Array:
        return pa.array(decode(rows.to_pylist()), pa.string())

    def ids(text: Column, limit: int | None) -> Column:
        whole = to_ids(text)
        return whole if limit is None else F.slice(whole, 1, limit)

    return Tokenizer(
        ids, lambda text: F.size(to_ids(text)), to_text, bos_id, eos_id, pad_id, special_ids, False
    )


def _one(token: int) -> Column:
    return F.array(F.lit(token))


def encode(
    text: Column | str,
    tokenizer: Tokenizer,
    add_bos: bool = False,
    add_eos: bool = False,
    truncation: int | None = None,
) -> Column:
    """Ids of a text; the limit applies before the begin and end ids, which are
    added only where the tokenizer defines them."""
    parts = [tokenizer.ids(_col(text), truncation)]
    if add_bos and tokenizer.bos_id is not None:
        parts.insert(0, _one(tokenizer.bos_id))
    if add_eos and tokenizer.eos_id is not None:
        parts.append(_one(tokenizer.eos_id))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def encoded_length(
    text: Column | str, tokenizer: Tokenizer, add_bos: bool = False, add_eos: bool = False
) -> Column:
    """``size(encode(...))`` without building the ids."""
    extra = int(add_bos and tokenizer.bos_id is not None)
    extra += int(add_eos and tokenizer.eos_id is not None)
    return tokenizer.length(_col(text)) + extra


def drop_special_ids(ids: Column | str, tokenizer: Tokenizer) -> Column:
    if not tokenizer.special_ids:
        return _col(ids)
    return F.filter(_col(ids), lambda i: ~i.isin(*tokenizer.special_ids))


def decode(ids: Column | str, tokenizer: Tokenizer, skip_special: bool = True) -> Column:
    """Text of the ids, without the special ones unless asked for."""
    kept = drop_special_ids(ids, tokenizer) if skip_special else _col(ids)
    return tokenizer.text(kept)


def pad_right(ids: Column | str, width: Column | int, value: int) -> Column:
    return F.concat(_col(ids), _padding(ids, width, value))


def pad_left(ids: Column | str, width: Column | int, value: int) -> Column:
    return F.concat(_padding(ids, width, value), _col(ids))


def _padding(ids: Column | str, width: Column | int, value: int) -> Column:
    target = F.lit(width) if isinstance(width, int) else width
    missing = target - F.size(_col(ids))
    message = F.lit("the padded width is below the length of a row")
    count = F.when(missing >= 0, missing).otherwise(F.raise_error(message))
    return F.array_repeat(F.lit(value), count.cast("int"))


def attention_mask(ids: Column | str, pad_id: int) -> Column:
    """True where the id is not the pad id. With the end id as padding a real
    end id is masked too."""
    return F.transform(_col(ids), lambda i: i != pad_id)


def strip_prompt_ids(output: Column | str, input_len: Column | str) -> Column:
    """The ids after the first ``input_len``."""
    out = _col(output)
    return F.slice(out, _col(input_len) + 1, F.greatest(F.size(out), F.lit(0)))
