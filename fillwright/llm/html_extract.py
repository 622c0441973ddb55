"""Main text of pages by template deduction over equivalence classes.

Tokens of a page are its block tags, told apart by the path to them and by what
they begin with, and its blocks of text. Over the pages of a host, tokens with
the same occurrence vector (how often each page has them) form an equivalence
class. A class that is frequent, has several tokens, a tag among them, and the
same order of tokens on every page is valid. The tags of valid classes nest and
are the host's template, a tree; what the template does not explain are the
slots below its tags.

Each tag of the tree is weighed by the text that varies from page to page in its
slots, links apart. From the top the tree is followed into the one part that
holds most of it, as long as there is such a part and it stands once on a page:
that is the article, whatever its tags are called. Names only help where the
weights do not speak: a page's own ``article`` inside that part, or beside it,
and words such as advert or comments for what is left out of it. All other text
of the article is kept, fixed headings and paragraphs as well.

Rows of a host with one html are one page in all counts: each weighs its share
of ``UNIT``, so no html is moved to find one row of each group.

Occurrence vectors are compared by a 64-bit fingerprint that adds up in any
order, so a host with a third of all pages is a partial sum per task, and a
host's template has at most (tokens of a page) / ``SHARE`` tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from fillwright.session import write_through

from .frames import with_fields
from .html_blocks import Block, scan
from .words import chunks, signed

# A template token is on this share of a host's pages, and on so many of them.
SHARE = 0.5
MIN_PAGES = 10
MIN_TOKENS = 3
# The weight of a page, dealt to its copies. Rounding back is exact up to 2**31 rows and pages of a host.
UNIT = 1 << 32
# Block tags whose fixed text belongs to the article around them.
LABELS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption figcaption summary".split())
HEADINGS = frozenset("h1 h2 h3".split())
# Tags that may hold a whole article, and the share of the varying text that leads into one.
CONTAINERS = frozenset("html body div section article main td center blockquote".split())
LEADS = 0.6
# A container stands once on a page, but for few pages.
ONCE = 1.02

SLOT = StructType([StructField("slot", StringType(), False), StructField("text", StringType(), False)])
FIELDS = (StructField("text", StringType(), False), StructField("slots", ArrayType(SLOT, False), False))


def host_of(url: str | Column) -> Column:
    """The lower-cased host of a URL; empty if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


@lru_cache(1 << 16)
def _tag_token(path: str) -> int:
    return xxhash.xxh64_intdigest("<" + path)


def _text_token(block: Block) -> int:
    return xxhash.xxh64_intdigest(f"{block.path}\n{block.text}")


def _tokens(page: str) -> list[tuple[int, str | None]]:
    """(token, path of a tag or None for text), tags first, both in page order."""
    blocks, paths = scan(page)
    return [(_tag_token(path), path) for path in paths] + [(_text_token(block), None) for block in blocks]


def _fingerprint(page: int, count: int) -> int:
    return xxhash.xxh64_intdigest(b"%d:%d" % (page, count))


def weighted(pages: DataFrame) -> DataFrame:
    """``pages`` (host, page, html) with ``weight``: ``UNIT`` over the rows of the host with this html."""
    keyed = pages.withColumns({"_a": F.xxhash64("html"), "_b": F.xxhash64("html", F.lit(1))})
    copies = write_through(keyed.groupBy("host", "_a", "_b").agg(F.count("*").alias("_n")).where("_n > 1"))
    joined = keyed.join(copies, ["host", "_a", "_b"], "left")
    return joined.select("host", "page", "html", F.expr(f"{UNIT}L DIV coalesce(_n, 1L)").alias("weight"))


def _units(weight: str) -> Column:
    """The pages that weights add up to."""
    return F.expr(f"(sum({weight}) + {UNIT // 2}L) DIV {UNIT}L")


def token_vectors(pages: DataFrame) -> DataFrame:
    """(host, token, path, pages, vector) of ``weighted`` pages: support and fingerprint."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "html"):
                found: dict[tuple, list[int]] = {}
                for host, page, source, weight in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html", "weight")), strict=True):
                    here: dict[tuple, int] = {}
                    for token in _tokens(source or ""):
                        here[token] = here.get(token, 0) + 1
                    marks: dict[int, int] = {}
                    for (token, path), n in here.items():
                        mark = marks.get(n)
                        if mark is None:
                            mark = marks[n] = _fingerprint(page, n)
                        held = found.setdefault((host, token, path), [0, 0, 0])
                        held[0] += weight
                        # two sums of 32 bits each, which repeated rows do not cancel
                        held[1] += mark & 0xFFFFFFFF
                        held[2] += mark >> 32
                hosts, tokens, paths = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hosts, pa.string()),
                        pa.array(signed(np.array(tokens, np.uint64))),
                        pa.array(paths, pa.string()),
                        *(pa.array([held[i] for held in found.values()], pa.int64()) for i in range(3)),
                    ],
                    names=["host", "token", "path", "pages", "low", "high"],
                )

    counted = pages.mapInArrow(count, "host string, token long, path string, pages long, low long, high long")
    return counted.groupBy("host", "token", "path").agg(_units("pages").alias("pages"), F.xxhash64(F.sum("low"), F.sum("high")).alias("vector"))


def equivalence_classes(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(host, vector, pages, tokens, paths): frequent classes of tokens with one occurrence vector."""
    pages = weighted(pages)
    totals = pages.groupBy("host").agg(_units("weight").alias("host_pages"))
    frequent = token_vectors(pages).where(F.col("pages") >= min_pages).join(totals, "host").where(F.col("pages") >= F.lit(share) * F.col("host_pages"))
    classes = frequent.groupBy("host", "vector").agg(
        F.first("pages").alias("pages"),
        F.sort_array(F.collect_list("token")).alias("tokens"),
        F.sort_array(F.collect_list("path")).alias("paths"),
    )
    return classes.where((F.size("tokens") >= min_tokens) & (F.size("paths") > 0))


def _joined(pages: DataFrame, lists: DataFrame) -> DataFrame:
    """Pages with their host's list. Its size is known: small ones are broadcast, a hot host is split otherwise."""
    return pages.join(lists, "host", "left")


def _weigh(blocks: list[Block], paths: list[str], known: dict, held: dict[str, list[int]], host: str) -> None:
    """Add a page to the weights of the template tags of its host: varying text, varying
    text of headings, all text, occurrences and pages."""
    for path in set(paths):
        if path in known:
            entry = held.setdefault((host, path), [0] * 5)
            entry[3] += paths.count(path)
            entry[4] += 1
    for block in blocks:
        varies = 0 if block.outside or signed_token(_text_token(block)) in known else len(block.text) - block.links
        heading = varies if block.path.rpartition(">")[2].partition("/")[0].partition(".")[0] in HEADINGS else 0
        path = block.path
        while path:
            entry = held.get((host, path))
            if entry:
                entry[0] += varies
                entry[1] += heading
                entry[2] += len(block.text)
            path = path.rpartition(">")[0]


def signed_token(token: int) -> int:
    return token - (1 << 64) if token >> 63 else token


def templates(pages: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The valid classes, those whose tokens come in one and the same order on all
    their pages, and the weights of the tags in them: (host, path, varies, headings,
    whole, times, seen)."""
    classes = write_through(equivalence_classes(pages, **options))
    lists = write_through(classes.groupBy("host").agg(F.collect_list(F.struct("vector", "tokens", "paths")).alias("classes")))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes_of: dict[str, dict[int, int]] = {}
        for whole in batches:
            for batch in chunks(whole, "html"):
                found, weights = set(), {}
                lists = batch.column("classes")
                for i, (host, source) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                    if not lists[i].is_valid:
                        continue
                    if host not in classes_of:
                        if len(classes_of) >= 256:
                            classes_of.clear()
                        known = {t: c["vector"] for c in lists[i].as_py() for t in c["tokens"]}
                        known |= {path: None for c in lists[i].as_py() for path in c["paths"]}
                        classes_of[host] = known
                    known, seen = classes_of[host], {}
                    blocks, paths = scan(source or "")
                    tokens = [_tag_token(path) for path in paths] + [_text_token(block) for block in blocks]
                    for token in map(signed_token, tokens):
                        if token in known:
                            seen.setdefault(known[token], {})[token] = None  # first places only
                    for vector, tokens in seen.items():
                        found.add((host, vector, xxhash.xxh64_intdigest(repr(list(tokens))) >> 1))
                    _weigh(blocks, paths, known, weights, host)
                rows = [(host, vector, mark, None, *[None] * 5) for host, vector, mark in sorted(found)]
                rows += [(host, None, None, path, *sums) for (host, path), sums in weights.items()]
                columns = list(zip(*rows, strict=True)) or [()] * 9
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    sums = ("varies", "headings", "whole", "times", "seen")
    names = ["host", "vector", "mark", "path", *sums]
    schema = "host string, vector long, mark long, path string, " + ", ".join(f"{s} long" for s in sums)
    # summed before they are stored: a few rows a host, read for the classes and for the weights
    told = _joined(pages, lists).where("classes IS NOT NULL").select("host", "html", "classes").mapInArrow(order, schema)
    told = told.groupBy("host", "vector", "path").agg(F.min("mark").alias("a"), F.max("mark").alias("b"), *[F.sum(s).alias(s) for s in sums])
    told = write_through(told)
    valid = classes.join(told.where("a = b").select("host", "vector"), ["host", "vector"], "left_semi")
    within = valid.select("host", F.explode("paths").alias("path")).distinct()
    return valid, told.where("path IS NOT NULL").select("host", "path", *sums).join(within, ["host", "path"], "left_semi")


def _tag(path: str) -> str:
    return path.rpartition(">")[2].partition("/")[0].partition(".")[0]


def _is_under(path: str, top: str) -> bool:
    return path == top or path.startswith(top + ">")


def article_path(weights: list[dict]) -> str | None:
    """The template tag that holds the article, by the weights of a host's template tags;
    None where the varying text lies in the body itself or nowhere."""
    parts = {w["path"]: w for w in weights if _tag(w["path"]) in CONTAINERS and w["times"] <= ONCE * w["seen"] and w["varies"]}
    here, trail = None, []
    while True:
        below = [p for p in parts if p != here and (here is None or _is_under(p, here))]
        if not below:
            break
        # the heaviest part, of equals the outermost
        best = max(below, key=lambda p: (parts[p]["varies"], -p.count(">")))
        if here is not None and parts[best]["varies"] < LEADS * parts[here]["varies"]:
            break
        trail.append(best)
        here = best
    # a part around it that adds headings only belongs to it
    while len(trail) > 1:
        inner, outer = parts[trail[-1]], parts[trail[-2]]
        if outer["whole"] - inner["whole"] > outer["headings"] - inner["headings"]:
            break
        trail.pop()
    return trail[-1] if trail and _tag(trail[-1]) not in ("html", "body") else None


class Template:
    """A host's template: the tree of its tags, the texts that are fixed, and the article's part."""

    def __init__(self, classes: list[dict], weights: list[dict] = ()):
        self.tokens = {t & (1 << 64) - 1 for c in classes for t in c["tokens"]}
        self.paths = {p for c in classes for p in c["paths"]}
        self.article = article_path(list(weights))

    def slot(self, path: str) -> str:
        """The innermost template tag around a path: the slot that text there fills."""
        while path and path not in self.paths:
            path = path.rpartition(">")[0]
        return path


def _is_label(block: Block) -> bool:
    return _tag(block.path) in LABELS


def _named(path: str) -> str:
    """The tags of a path, without what they begin with."""
    return ">".join(part.partition("/")[0] for part in path.split(">"))


def page_slots(page: str, template: Template | None = None) -> list[tuple[str, str]]:
    """(slot, text) of the article text of a page, in order."""
    blocks = [b for b in scan(page)[0] if not b.outside]
    part = [b for b in blocks if template and template.article and _is_under(b.path, template.article)]
    named = [b for b in blocks if b.root == 3]
    if part:
        # an article by name is a part of the slots, or stands where they are not
        kept = [b for b in part if b.root == 3] or named or part
    else:
        free = [b for b in blocks if _text_token(b) not in template.tokens] if template else blocks
        root = max((b.root for b in free or blocks), default=0)
        fixed = {id(b) for b in blocks} - {id(b) for b in free}
        kept = [b for b in blocks if b.root == root and (id(b) not in fixed or root == 3 or root and _is_label(b))]
    return [(_named(template.slot(b.path) if template else b.path), b.text) for b in kept]


def extract_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """``pages`` with ``text`` and ``slots``, the article's blocks and the template slot of each.

    A block is text without a break between block tags; white space in it is
    one space, and character references are decoded. ``text`` joins the blocks
    by one space and is empty if there is none. Null and empty pages have no
    text. Pages without a host form one host; a host with few pages has no
    template, and its pages are read by their own tags. Copies of a page and
    repeated rows are one page of the host. Input columns named like a result column give
    way; all others are passed on.
    """
    source = pages.select(host_of(url).alias("host"), F.xxhash64(id_column, html).alias("page"), F.col(html).alias("html"))
    valid, weights = templates(source, **options)
    held = valid.groupBy("host").agg(F.collect_list(F.struct("vector", "tokens", "paths")).alias("_classes"))
    tree = weights.groupBy("host").agg(F.collect_list(F.struct("path", "varies", "headings", "whole", "times", "seen")).alias("_weights"))
    lists = write_through(held.join(tree, "host", "left"))
    schema = with_fields(pages, *FIELDS)
    names = schema.fieldNames()
    passed = names[: -len(FIELDS)]
    joined = pages.select("*", host_of(url).alias("_host")).join(lists.withColumnRenamed("host", "_host"), "_host", "left")
    # ``html`` may be named like a result column, so it is carried under its own name.
    joined = joined.select(*passed, F.col(html).alias("_html"), "_host", "_classes", "_weights")
    slot = pa.struct([pa.field("slot", pa.string(), False), pa.field("text", pa.string(), False)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Template] = {}
        for whole in batches:
            for batch in chunks(whole, "_html"):
                lists, found = batch.column("_classes"), []
                for i, (host, source) in enumerate(zip(batch.column("_host").to_pylist(), batch.column("_html").to_pylist(), strict=True)):
                    template = None
                    if lists[i].is_valid:
                        if host not in held:
                            if len(held) >= 256:
                                held.clear()
                            held[host] = Template(lists[i].as_py(), batch.column("_weights")[i].as_py() or [])
                        template = held[host]
                    found.append(page_slots(source or "", template))
                texts = [" ".join(text for _, text in row) for row in found]
                slots = [[{"slot": s, "text": t} for s, t in row] for row in found]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in passed] + [pa.array(texts, pa.string()), pa.array(slots, pa.list_(pa.field("element", slot, False)))], names=names)

    return joined.mapInArrow(read, schema)
