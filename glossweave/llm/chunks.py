"""Cutting long texts at natural boundaries by packing a tree of their structure."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.tables import spread

_BREAK = r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"
#: Levels of the tree, from the outermost inwards; the name of a cut is the level of the nodes it parts.
LEVELS = ("section", "element", "paragraph", "item", "line", "sentence", "word")
_HEADING = re.compile(rf"(?:^|(?<=[\n\r\x0b\x0c\x85\u2028\u2029]))[ \t]*(?:(#{{1,6}})[ \t]|<h([1-6])\b)", re.I)
_TAG = re.compile(r"<(/?)(section|article|div|blockquote|pre|ul|ol|li|dl|dt|dd|table|tr|td|th|p|br|hr)\b[^<>]*>", re.I)
#: Elements that end where the next of their kind begins, if no tag ended them.
_OPEN_ENDED = frozenset("li dt dd tr td th p".split())
_ITEM = re.compile(r"(?:^|(?<=[\n\r\x0b\x0c\x85\u2028\u2029]))([ \t]*)(?:[-*+\u2022\u2013]|\d{1,3}[.)]|[A-Za-z][.)])[ \t]")
_FLAT = {
    "paragraph": re.compile(rf"(?:{_BREAK})[^\S\r\n]*(?:{_BREAK})\s*"),
    "line": re.compile(_BREAK),
    "sentence": re.compile(r"[.!?]\s+"),
    "word": re.compile(r"\s+"),
}
_LAST_BREAK = re.compile(rf"(?:{_BREAK})$")
#: Elements and items nested deeper belong to their ancestor of this depth.
MAX_DEPTH = 64


class Tree:
    """The structure of a text, as far down as somebody looks.

    Nodes are (a, b, level): sections nest by the depth of their headings, elements by their tags, items by
    their indentation; below them come paragraphs, lines, sentences and words. The children of a node cover
    it without gaps. A level that doesn't divide a node is passed over.
    """

    def __init__(self, text: str):
        self.text = text
        self.heads = [(m.start(), len(m[1]) if m[1] else int(m[2])) for m in _HEADING.finditer(text)]
        self.items = [(m.start(), min(len(m[1].expandtabs(4)), MAX_DEPTH)) for m in _ITEM.finditer(text)]
        self.elements = self._elements()
        self.starts = {"section": [x for x, _ in self.heads], "item": [x for x, _ in self.items], "element": [x for x, _, _ in self.elements]}
        self.flat: dict[str, list[int]] = {}

    def _elements(self) -> list[tuple[int, int, int]]:
        out, stack = [], []

        def close(end: int) -> None:
            start, _ = stack.pop()
            if len(stack) < MAX_DEPTH:
                out.append((start, end, len(stack)))

        for m in _TAG.finditer(self.text):
            name = m[2].lower()
            if name in ("br", "hr"):
                stack.append((m.start(), name))
                close(m.end())
            elif not m[1]:
                if stack and stack[-1][1] == name and name in _OPEN_ENDED:
                    close(m.start())
                stack.append((m.start(), name))
            elif any(n == name for _, n in stack):
                while stack[-1][1] != name:  # what was left open inside ends here too
                    close(m.start())
                end = m.end()
                while end < len(self.text) and self.text[end].isspace():
                    end += 1
                close(end)
        return sorted(out)

    def _cuts(self, a: int, b: int, level: str) -> list[int]:
        """Where the children of [a, b) on ``level`` begin, other than at ``a``."""
        if level in _FLAT:
            if level not in self.flat:
                self.flat[level] = [m.end() for m in _FLAT[level].finditer(self.text)]
            at = self.flat[level]
            return at[bisect_right(at, a) : bisect_left(at, b)]
        starts = self.starts[level]
        if level == "element":
            inside = [e for e in self.elements[bisect_left(starts, a) : bisect_left(starts, b)] if e[1] <= b and e[:2] != (a, b)]
            top = min((d for _, _, d in inside), default=0)
            return sorted({x for s, e, d in inside if d == top for x in (s, e) if a < x < b})
        marks = (self.heads if level == "section" else self.items)[bisect_right(starts, a) : bisect_left(starts, b)]
        top = min((d for _, d in marks), default=0)
        return [x for x, d in marks if d == top]

    def children(self, a: int, b: int, level: int) -> tuple[list[tuple[int, int]], int]:
        """The children of [a, b) on the outermost level from ``level`` inwards that divides it, and that level."""
        while level < len(LEVELS):
            if len(nodes := self._nodes(a, b, LEVELS[level])) > 1:
                return nodes, level
            level += 1
        return [], level

    def finest(self, limit: int) -> str:
        """The finest level on which a node must be opened for stretches within ``limit``: sentence, word or inside.

        Lines are opened where they are too large, their sentences where those are, and words are cut where
        they are. A sentence is measured between ends: ``.``, ``!`` or ``?`` before white space, or a line break.
        """
        text, worst = self.text, "sentence"
        for a, b in self._nodes(0, len(text), "line"):
            if b - a <= limit:
                continue
            if m := _LAST_BREAK.search(text, max(a, b - 2), b):
                b = m.start()
            for x, y in self._nodes(a, b, "sentence"):
                # the white space before a sentence is measured with it, that after it with the next one
                start, end = a + len(text[a:x].rstrip()), x + len(text[x:y].rstrip())
                if y == b and text[end - 1 : end] not in (".", "!", "?"):
                    end = y
                if max(end - start, y - end if y == b else 0) <= limit:
                    continue
                worst = "word"
                if any(len(text[u:v].rstrip()) > limit for u, v in self._nodes(x, y, "word")):
                    return "inside"
        return worst

    def _nodes(self, a: int, b: int, level: str) -> list[tuple[int, int]]:
        cuts = self._cuts(a, b, level)
        return list(zip([a, *cuts], [*cuts, b]))


def cut_kind(text: str, limit: int) -> str | None:
    """The coarsest level of the tree that can keep every piece of ``text`` within ``limit``; None for a text within it."""
    return Tree(text).finest(limit) if len(text) > limit else None


def pack_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Half-open core spans that cover ``text`` without gaps, with the level of each one's right cut.

    Only nodes larger than ``limit - overlap`` are opened, so that a piece with its overlap stays within the
    limit. Neighbouring children of one parent are merged while they stay within it; pieces never join parts
    of an opened node with what is outside it. A stretch without any boundary is cut inside, not before a
    combining mark.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n, cap = len(text), limit - overlap
    if n <= limit:
        return [(0, n, "end")]
    tree = Tree(text)

    def inside(a: int, b: int) -> list[tuple[int, int, str]]:
        out, x = [], a
        while x < b:
            y = min(b, x + cap)
            while x + 1 < y < b and unicodedata.combining(text[y]):
                y -= 1
            out.append((x, y, "inside"))
            x = y
        return out

    def pack(a: int, b: int, level: int) -> list[tuple[int, int, str]]:
        kids, level = tree.children(a, b, level)
        if not kids:
            return inside(a, b)
        out, merged, name = [], False, LEVELS[level]  # merged: the last piece is a run of whole children
        for x, y in kids:
            if y - x > cap:
                out += pack(x, y, level)
                out[-1] = (*out[-1][:2], name)
                merged = False
            elif merged and y - out[-1][0] <= cap:
                out[-1] = (out[-1][0], y, name)
            else:
                out.append((x, y, name))
                merged = True
        return out

    return pack(0, n, 0)


def split_texts(docs: DataFrame, doc_id: str, text: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """(doc_id, piece_no, a, b, piece, boundary, cut_kind): the pieces of every text longer than ``limit``.

    Pieces are at most ``limit`` characters; each begins with the last ``overlap`` characters of the one
    before (with all of it, if it is shorter), then goes on with ``text[a:b]``; the stretches [a, b)
    together are the whole text. ``boundary`` is the level of the cut after a piece (``end`` for the
    last). ``cut_kind`` says what the text's own tree allows at ``limit``; pieces are packed to ``limit -
    overlap``, so a sentence between the two sizes is still cut at a word. Texts within the limit, empty and null texts give no row; extra columns are ignored; repeated
    rows are cut each on their own. One text is the unit of work, read once and cut in linear time.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    long = docs.where(F.length(text) > limit).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"]):
                kind, before, spans = cut_kind(t, limit), "", pack_spans(t, limit, overlap)
                for k, (a, b, level) in enumerate(spans, 1):
                    piece = (before[len(before) - min(overlap, len(before)) :] if overlap else "") + t[a:b]
                    rows.append((i, k, a, b, piece, level if b < len(t) else "end", kind))
                    before = piece
            yield pd.DataFrame(rows, columns=["id", "piece_no", "a", "b", "piece", "boundary", "cut_kind"])

    out = spread(long, "id").mapInPandas(cut, f"id {id_type}, piece_no long, a long, b long, piece string, boundary string, cut_kind string")
    return out.withColumnRenamed("id", doc_id)
