"""Chat templates of tokenizers as one expression over the messages of a row.

A chat tokenizer carries a small template: a loop over messages with tests on
role and place, texts around each message, and what asks for an answer. The part
of that language which such templates use is read once, when the plan is built,
and becomes a Column, so the chats are rendered in the JVM. A tag or name that is
not among them raises.

Known are ``{{ }}`` with texts, ``+``, ``| trim`` and names; ``{% for message in
messages %}``, ``{% if %}`` with ``elif`` and ``else``; ``==``, ``!=``, ``and``,
``or``, ``not``, ``%``; ``loop.first``, ``loop.last``, ``loop.index0``,
``messages[0]['role']``, ``bos_token``, ``eos_token``, ``add_generation_prompt``
and ``raise_exception``; ``{#`` notes and ``-`` at a tag's edge.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fillwright.functions.text import _col, strip_py

_TAGS = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", re.DOTALL)
_WORDS = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[-+%()\[\].|]))")


@dataclass
class _Scope:
    """What names stand for at one place of the template."""

    messages: Column
    bos: str
    eos: str
    generation: bool
    message: Column | None = None
    index: Column | None = None


_Node = Callable[[_Scope], Column]


class _Expression:
    """One expression by descent: or, and, not, comparison, sum, filter, value."""

    def __init__(self, source: str):
        self.source, self.words, at = source, [], 0
        while source[at:].strip():
            found = _WORDS.match(source, at)
            if not found:
                raise ValueError(f"chat template: cannot read {source[at:].strip()!r}")
            self.words.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def whole(self) -> _Node:
        node = self._or()
        if self.at < len(self.words):
            raise ValueError(f"chat template: cannot read {self.source.strip()!r}")
        return node

    def _take(self, *options: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] != "text" and self.words[self.at][1] in options:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def _need(self, option: str) -> None:
        if not self._take(option):
            raise ValueError(f"chat template: {option!r} is missing in {self.source.strip()!r}")

    def _or(self) -> _Node:
        left = self._and()
        while self._take("or"):
            left = (lambda a, b: lambda s: a(s) | b(s))(left, self._and())
        return left

    def _and(self) -> _Node:
        left = self._not()
        while self._take("and"):
            left = (lambda a, b: lambda s: a(s) & b(s))(left, self._not())
        return left

    def _not(self) -> _Node:
        if self._take("not"):
            inner = self._not()
            return lambda s: ~inner(s)
        left = self._sum()
        sign = self._take("==", "!=")
        if not sign:
            return left
        right = self._sum()
        # a null, as a missing role, equals nothing but a null
        same = lambda s: left(s).eqNullSafe(right(s))
        return same if sign == "==" else lambda s: ~same(s)

    def _sum(self) -> _Node:
        left = self._filtered()
        while sign := self._take("+", "%"):
            right = self._filtered()
            join = F.concat if sign == "+" else (lambda a, b: a % b)
            left = (lambda a, b, j: lambda s: j(a(s), b(s)))(left, right, join)
        return left

    def _filtered(self) -> _Node:
        inner = self._value()
        while self._take("|"):
            self._need("trim")
            inner = (lambda a: lambda s: strip_py(a(s)))(inner)
        return inner

    def _value(self) -> _Node:
        if self._take("("):
            inner = self._or()
            self._need(")")
            return inner
        kind, word = self.words[self.at] if self.at < len(self.words) else (None, "")
        self.at += 1
        if kind == "text":
            text = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), word[1:-1], flags=re.DOTALL)
            return lambda s: F.lit(text)
        if kind == "number":
            return lambda s: F.lit(int(word))
        if kind == "name":
            return self._name(word)
        raise ValueError(f"chat template: cannot read {self.source.strip()!r}")

    def _field(self) -> str:
        if self._take("."):
            self.at += 1
            return self.words[self.at - 1][1]
        self._need("[")
        kind, word = self.words[self.at]
        self.at += 1
        self._need("]")
        return word[1:-1] if kind == "text" else word

    def _name(self, word: str) -> _Node:
        if word == "message":
            field = self._field()
            return lambda s: _in_loop(s).message[field]
        if word == "messages":
            place, field = int(self._field()), self._field()
            return lambda s: F.get(s.messages, F.lit(place))[field]
        if word == "loop":
            places = {
                "first": lambda s: _in_loop(s).index == 0,
                "last": lambda s: _in_loop(s).index == F.size(s.messages) - 1,
                "index0": lambda s: _in_loop(s).index,
                "index": lambda s: _in_loop(s).index + 1,
            }
            field = self._field()
            if field in places:
                return places[field]
            raise ValueError(f"chat template: no loop.{field}")
        if word == "raise_exception":
            self._need("(")
            inner = self._or()
            self._need(")")
            return lambda s: F.raise_error(inner(s)).cast("string")
        names = {
            "bos_token": lambda s: F.lit(s.bos),
            "eos_token": lambda s: F.lit(s.eos),
            "add_generation_prompt": lambda s: F.lit(s.generation),
            "true": lambda s: F.lit(True),
            "false": lambda s: F.lit(False),
        }
        if word.lower() in names:
            return names[word.lower()]
        raise ValueError(f"chat template: no name {word!r}")


def _in_loop(scope: _Scope) -> _Scope:
    if scope.message is None:
        raise ValueError("chat template: a message is named outside the loop")
    return scope


def _pieces(template: str) -> list[tuple[str, str]]:
    """(kind, text) of texts, outputs and statements.

    As in the tokenizers' own rendering, blanks from the start of a line up to a
    statement are the template's, and so is a line break right after it; ``-``
    takes all blanks beside a tag.
    """
    out: list[tuple[str, str]] = []
    at, strip = 0, False
    for tag in [*_TAGS.finditer(template), None]:
        text = template[at : tag.start()] if tag else template[at:]
        if strip:
            text = text.lstrip()
        body = tag[0][2:-2] if tag else ""
        if body.startswith("-"):
            text, body = text.rstrip(), body[1:]
        last = text.rpartition("\n")[2]
        begins = "\n" in text or at == 0 or template[at - 1] == "\n"
        if tag and not tag[0].startswith("{{") and begins and not last.strip(" \t"):
            text = text[: len(text) - len(last)]
        if text:
            out.append(("text", text))
        if not tag:
            break
        strip = body.endswith("-")
        body = body[:-1] if strip else body
        at = tag.end()
        if not tag[0].startswith("{{") and template[at : at + 1] == "\n":
            at += 1
        if not tag[0].startswith("{#"):
            out.append(("output" if tag[0].startswith("{{") else "statement", body.strip()))
    return out


def _block(pieces: list[tuple[str, str]], ends: tuple[str, ...]) -> tuple[_Node, str]:
    """The pieces up to a statement that begins with one of ``ends``, and that statement."""
    parts: list[_Node] = []

    def whole(scope: _Scope) -> Column:
        return F.concat(*[part(scope) for part in parts]) if parts else F.lit("")

    while pieces:
        kind, body = pieces.pop(0)
        if kind == "text":
            parts.append((lambda text: lambda s: F.lit(text))(body))
        elif kind == "output":
            parts.append((lambda node: lambda s: node(s).cast("string"))(_Expression(body).whole()))
        elif body.split(None, 1)[0] in ends:
            return whole, body
        elif body.startswith("if "):
            parts.append(_choice(pieces, body[3:]))
        elif re.fullmatch(r"for\s+message\s+in\s+messages", body):
            parts.append(_loop(pieces))
        else:
            raise ValueError(f"chat template: no statement {body!r}")
    if ends:
        raise ValueError(f"chat template: {ends[-1]} is missing")
    return whole, ""


def _choice(pieces: list[tuple[str, str]], test: str) -> _Node:
    cases: list[tuple[_Node, _Node]] = []
    otherwise: _Node = lambda s: F.lit("")
    while True:
        condition = _Expression(test).whole()
        inner, end = _block(pieces, ("elif", "else", "endif"))
        cases.append((condition, inner))
        if end.startswith("elif"):
            test = end[4:]
            continue
        if end == "else":
            otherwise, _ = _block(pieces, ("endif",))
        break

    def choose(scope: _Scope) -> Column:
        out = otherwise(scope)
        for condition, inner in reversed(cases):
            out = F.when(F.coalesce(condition(scope), F.lit(False)), inner(scope)).otherwise(out)
        return out

    return choose


def _loop(pieces: list[tuple[str, str]]) -> _Node:
    inner, _ = _block(pieces, ("endfor",))

    def each(scope: _Scope) -> Column:
        def one(message: Column, index: Column) -> Column:
            return inner(_Scope(scope.messages, scope.bos, scope.eos, scope.generation, message, index))

        texts = F.transform(scope.messages, one)
        # joining would leave a null out, and with it a message
        return F.when(F.forall(texts, lambda t: t.isNotNull()), F.array_join(texts, ""))

    return each


def render_template_chat(
    messages: Column | str,
    template: str,
    bos_token: str = "",
    eos_token: str = "",
    add_generation_prompt: bool = True,
) -> Column:
    """Chat messages as the text a tokenizer's chat template makes of them.

    ``messages`` is an array of structs with ``role`` and ``content``. A message
    whose text is null makes the chat null; so does a null array.
    """
    whole, _ = _block(_pieces(template), ())
    return whole(_Scope(_col(messages), bos_token, eos_token, add_generation_prompt))
