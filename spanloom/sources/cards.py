"""Debate cards from HTML pages by a table function, and the rules that a card must pass.

:func:`cards` joins pages laterally with a function that reads a page once and hands out each card as soon as it is
complete. A card begins at a heading (its abstract); the first paragraph that begins after it is the citation, the second one
the document, whichever heading comes between, so that headings may share paragraphs. A paragraph ends at its end tag or
where another block begins. Marked runs are spans of the document by running offsets; a mark inside a mark belongs to it.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tags that end an open paragraph; headings and paragraphs among them.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 div ul ol dl table form blockquote pre section article aside header footer nav main hr address fieldset".split())
SILENT = frozenset(("script", "style"))
CARD = "card: int, abstract: string, citation: string, document: string, spans: array<struct<start_pos:int,end_pos:int,content:string>>"


class _Paragraph:
    """A paragraph while it is read; ``spans`` are (start, end) of its outermost marked runs."""

    def __init__(self):
        self.parts, self.size, self.depth, self.begun, self.spans = [], 0, 0, 0, []

    def text(self) -> str:
        return "".join(self.parts)

    def close(self) -> None:
        if self.depth:
            self.spans.append((self.begun, self.size))
            self.depth = 0


#: A comment, a declaration, or a tag whose quoted values may hold anything.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.S)


def read_cards(page: str, heading: str, mark: str) -> Iterator[dict]:
    """Cards ``{abstract, paragraphs}`` in the order of their headings, each once its two paragraphs are complete."""
    cards, waiting = deque(), []
    title = paragraph = None
    last, at = 0, 0
    while True:
        m = _TAG.search(page, at)
        lo = m.start() if m else len(page)
        if lo > last:
            text = unescape(page[last:lo])
            if title is not None:
                title["abstract"].append(text)
            if paragraph is not None:
                paragraph.parts.append(text)
                paragraph.size += len(text)
        if not m:
            break
        last = at = m.end()
        if not m[2]:
            continue
        tag, ends = m[2].lower(), m[1]
        if tag == mark and tag not in BLOCKS:
            if paragraph is not None and (not ends or paragraph.depth):
                paragraph.depth += -1 if ends else 1
                if ends and not paragraph.depth:
                    paragraph.spans.append((paragraph.begun, paragraph.size))
                elif not ends and paragraph.depth == 1:
                    paragraph.begun = paragraph.size
        elif tag in SILENT:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at) if not ends else None
            last = at = stop.end() if stop else at if ends else len(page)
        elif tag in BLOCKS or tag == heading:
            if paragraph is not None:
                paragraph.close()
                paragraph = None
            if ends:
                title = None if tag == heading else title
            elif tag == heading:
                title = {"abstract": [], "paragraphs": []}
                cards.append(title)
                waiting.append(title)
            elif tag == "p":
                paragraph = _Paragraph()
                for card in waiting:
                    card["paragraphs"].append(paragraph)
                waiting = [c for c in waiting if len(c["paragraphs"]) < 2]
            while cards and cards[0] is not title and len(cards[0]["paragraphs"]) == 2 and cards[0]["paragraphs"][1] is not paragraph:
                yield cards.popleft()
    if paragraph is not None:
        paragraph.close()
    yield from cards


@F.udtf(returnType=CARD)
class HtmlCards:
    """``html_cards(html, heading, mark)``: a row a heading; citation and document are null where a page ends before them."""

    def eval(self, html: str, heading: str, mark: str):
        if html is not None:
            for k, card in enumerate(read_cards(html, heading, mark)):
                yield self.row(k, card)

    @staticmethod
    def row(k, card):
        texts = [p.text() for p in card["paragraphs"]] + [None, None]
        spans = [(a, b, texts[1][a:b]) for a, b in card["paragraphs"][1].spans] if texts[1] is not None else None
        return k, "".join(card["abstract"]), texts[0], texts[1], spans


def cards(pages: DataFrame, heading: str = "h4", mark: str = "u", keep: tuple[str, ...] = ("page_id",), html_col: str = "html") -> DataFrame:
    """``(*keep, card, abstract, citation, document, spans)``: every heading of every page."""
    called = HtmlCards(F.col(html_col).outer(), F.lit(heading), F.lit(mark))
    return pages.lateralJoin(called).select(*keep, "card", "abstract", "citation", "document", "spans")


def word_count(c: Column) -> Column:
    """Runs outside white space."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def judge_cards(found: DataFrame, order: tuple[str, ...] = ("page_id",), least_words: int = 20, least_extract: int = 10, least_abstract: int = 3) -> DataFrame:
    """``found`` with extract, counts, ratios, ``status`` and, for valid cards, ``card_id`` by file from 0.

    The rules in their order: ``no_paragraph``; ``empty`` (no second paragraph); ``too_short`` (document under ``least_words``);
    ``duplicate`` (an earlier card, by file and place, has the document, whatever became of it); ``too_short`` (extract or abstract
    of no more than their least words); ``too_long`` (extract or abstract not shorter than the document); else ``valid``.
    """
    extract = F.array_join(F.transform("spans", lambda s: s["content"]), " ")
    counted = found.withColumn("extract", extract).withColumns({f"{c}_words": word_count(F.col(c)) for c in ("document", "abstract", "extract")})
    counted = counted.withColumns({"abstract_ratio": F.try_divide("abstract_words", "document_words"), "extract_ratio": F.try_divide("extract_words", "document_words")})
    long = F.col("document_words") >= least_words
    # Documents meet by their digests; those that need not be told apart keep to themselves.
    place = F.struct(*order, "card")
    named = counted.withColumns({"_place": place, "_key": F.when(long, F.sha2("document", 256)).otherwise(F.to_json(place))})
    first = named.groupBy("_key").agg(F.min("_place").alias("_first"))
    placed = named.join(first, "_key")
    status = (
        F.when(F.col("citation").isNull(), "no_paragraph").when(F.col("document").isNull(), "empty").when(~long, "too_short").when(F.col("_place") > F.col("_first"), "duplicate")
        .when((F.col("extract_words") <= least_extract) | (F.col("abstract_words") <= least_abstract), "too_short")
        .when((F.col("abstract_ratio") >= 1) | (F.col("extract_ratio") >= 1), "too_long").otherwise("valid")
    )
    out = placed.withColumn("status", status).drop("_key", "_place", "_first")
    place = F.row_number().over(Window.partitionBy(*order, F.col("status") == "valid").orderBy("card")) - 1
    return out.withColumn("card_id", F.when(F.col("status") == "valid", place))


def skip_counts(judged: DataFrame) -> DataFrame:
    """How many cards each rule stopped, with the total as ``total``."""
    return judged.groupingSets([[F.col("status")], []], F.col("status")).agg(F.count("*").alias("n"), F.grouping("status").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("status")).alias("status"), "n")
