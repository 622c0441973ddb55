"""Python literals read by expressions: text to JSON without a Python worker.

The text is cut into tokens by one pattern. Tokens of literals whose JSON form is
beyond doubt are translated one by one; whether brackets match and commas stand
right is then for the JSON parser to judge. Everything else is left open, as a
null: other escapes than JSON knows, numbers whose printed form may differ,
prefixes, comments, nested tuples, keys that are no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPE = r"\\(?:[\\'\"nrtbf]|u[0-9a-fA-F]{4})"
_SINGLE = rf"'[^'\\\r\n]*+(?:{_ESCAPE}[^'\\\r\n]*+)*+'"
_DOUBLE = rf'"[^"\\\r\n]*+(?:{_ESCAPE}[^"\\\r\n]*+)*+"'
# whole numbers, and fractions that are printed as they are written
_NUMBER = r"-?(?:0|[1-9][0-9]{0,9})\.(?:0|[0-9]{0,3}[1-9])|-?[1-9][0-9]{0,17}|0"
_TOKEN = rf"{_SINGLE}|{_DOUBLE}|True|False|None|{_NUMBER}|[\[\]{{}}(),:]|[ \t\r\n]++"
# the pattern needs stack for each escape of a string
_MOST_ESCAPES = 500

_WORDS = {"True": "true", "False": "false", "None": "null"}
_BRACKETS = {"(": "[", ")": "]"}


def _is_text(token: Column) -> Column:
    return F.substring(token, 1, 1).isin("'", '"')


def _json_text(token: Column) -> Column:
    """A quoted token with the quotes and escapes of JSON."""
    inner = F.substr(token, F.lit(2), F.char_length(token) - 2)
    # quotes lose their backslash, other escapes are the same; then those that JSON escapes get one
    bare = F.regexp_replace(inner, r"""(\\[^'"])|\\(['"])""", "$1$2")
    return F.concat(F.lit('"'), F.replace(bare, F.lit('"'), F.lit('\\"')), F.lit('"'))


def _kind(token: Column) -> Column:
    return F.when(token.isin(*"[]{}(),:"), token).otherwise("v")


def _one_value(tokens: Column) -> Column:
    """The brackets close at the last token and not before: the JSON parser stops
    where a first value ends and does not tell what follows it."""

    def step(state: Column, token: Column) -> Column:
        opens = F.when(token.isin(*"[{("), 1).when(token.isin(*"]})"), -1).otherwise(0)
        depth = state["depth"] + opens
        beyond = state["beyond"] | (state["some"] & (state["depth"] == 0)) | (depth < 0)
        return F.struct(F.lit(True).alias("some"), depth.alias("depth"), beyond.alias("beyond"))

    start = F.struct(F.lit(False).alias("some"), F.lit(0).alias("depth"), F.lit(False).alias("beyond"))
    return F.aggregate(tokens, start, step, lambda s: (s["depth"] == 0) & ~s["beyond"])


def with_literal_json(df: DataFrame, column: str, json: str) -> DataFrame:
    """Add ``json``, the JSON text of the literal in ``column``; null where it is left open."""
    text = F.col(column)
    escapes = F.char_length(text) - F.char_length(F.replace(text, F.lit("\\")))
    tokens = F.when(escapes <= _MOST_ESCAPES, F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)))
    cut = df.withColumn("_all", tokens)
    said = F.filter("_all", lambda t: F.btrim(t, F.lit(" \t\r\n")) != "")
    cut = cut.withColumn("_said", said)
    kinds = F.array_join(F.transform("_said", _kind), "")
    # tuples of plain values become lists; what is left in round brackets is open
    flat = F.regexp_replace(kinds, r"\(\)|\(v(?:,v)*+,\)|\(v(?:,v)++\)", "v")
    # line breaks count inside brackets only
    ends = F.btrim(text, F.lit(" \t"))
    whole = F.substring(ends, 1, 1).isin(*"[{(") & F.substring(ends, -1, 1).isin(*"]})")
    known = (
        (F.char_length(F.array_join("_all", "")) == F.char_length(text))
        & ~F.contains(flat, F.lit("("))
        & ~F.contains(flat, F.lit(")"))
        & _one_value(F.col("_said"))
        & ~flat.rlike(r"[\[{,:],")  # a comma that follows nothing
        & (whole | ~text.rlike(r"[\r\n]"))
    )
    following = F.concat(F.slice("_said", F.lit(2), F.greatest(F.size("_said"), F.lit(0))), F.array(F.lit("")))

    def translated(token: Column, after: Column) -> Column:
        last = (token == ",") & after.isin(*"]})")
        plain = F.coalesce(F.create_map(*[F.lit(x) for kv in (_WORDS | _BRACKETS).items() for x in kv])[token], token)
        return F.when(last, "").when(_is_text(token), _json_text(token)).otherwise(plain)

    joined = F.array_join(F.zip_with("_said", following, translated), " ")
    return cut.withColumn(json, F.when(known, joined)).drop("_all", "_said")
