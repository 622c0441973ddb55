"""Column expressions over text: strip, search, templates, code fences."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything Python's str.strip() removes: the code points isspace() accepts,
# the last of which is U+3000.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

FENCE = "```"
# Fixed value: what stands for the completion in an infill task.
MARKER = "{{completion}}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_py(c: Column | str) -> Column:
    """``str.strip()``; SQL ``trim`` alone removes only the space."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def rstrip_py(c: Column | str) -> Column:
    """``str.rstrip()``."""
    return F.rtrim(_col(c), F.lit(WHITESPACE))


normalise_answer = strip_py


def index_of(c: Column | str, needle: str) -> Column:
    """0-based first position of ``needle``; -1 when absent."""
    return F.instr(_col(c), F.lit(needle)) - 1


def rindex_of(c: Column | str, needle: str) -> Column:
    """0-based last position of ``needle``; -1 when absent."""
    text = _col(c)
    tail = F.char_length(F.substring_index(text, needle, -1))
    at = F.char_length(text) - tail - len(needle)
    return F.when(F.contains(text, F.lit(needle)), at).otherwise(F.lit(-1))


def slice_text(c: Column | str, start: Column, end: Column) -> Column:
    """``text[start:end]`` for non-negative 0-based bounds."""
    return F.substr(_col(c), start + 1, F.greatest(end - start, F.lit(0)))


def id_as_string(c: Column | str) -> Column:
    return _col(c).cast("string")


def render_template(template: str, **slots: Column | str) -> Column:
    """``template.format(**slots)`` as one concat.

    The template is cut at its slots once, when the plan is built, so a value
    that itself holds ``{response}`` stays as it is.
    """
    pieces: list[Column] = []
    for literal, slot, spec, conversion in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if slot is None:
            continue
        if spec or conversion:
            raise ValueError(f"slot {{{slot}}} takes no format or conversion")
        if slot not in slots:
            raise KeyError(slot)
        value = slots[slot]
        pieces.append(F.lit(value) if isinstance(value, str) else value)
    return F.concat(*pieces) if pieces else F.lit("")


def extract_code_block(c: Column | str) -> Column:
    """Text before the first fence, or all of it."""
    return F.substring_index(_col(c), FENCE, 1)


def answer_newline(c: Column | str) -> Column:
    return F.concat(_col(c), F.lit("\n"))
