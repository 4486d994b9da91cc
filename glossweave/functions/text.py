"""Text as Column expressions: tokens with offsets, windows, sentences, chunks, phrase patterns, contexts."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frequent function words that alone make no mention.
STOP_WORDS = ("a", "an", "the", "of", "to", "in", "is", "for", "or", "has", "and", "with", "on", "at", "by", "from", "as", "that", "this", "it", "be", "are", "was", "were")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_RUN = re.compile(r"\S+")
_WORDS, _REST, _SPACE, _GAP = re.compile(r"\w+"), re.compile(r"\w*"), re.compile(r"\s*"), re.compile(r"[\w\s-]*")
_BETWEEN = re.compile(r"[^\s!-/:-@\[-`{-~]+")
_SPAN = T.ArrayType(T.StructType([T.StructField("s", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))


def _found(texts: pa.Array, rx: re.Pattern) -> tuple[list[int], list[str], list[int], list[int]]:
    """List offsets, strings, starts and ends of all matches, in one pass over each text."""
    ends, s, a, b = [0], [], [], []
    for t in texts:
        for m in rx.finditer(t.as_py() or ""):
            s.append(m[0])
            a.append(m.start())
            b.append(m.end())
        ends.append(len(s))
    return ends, s, a, b


def _lists(texts: pa.Array, ends: list[int], values: pa.StructArray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=texts.is_null())


def _spans_udf(rx: re.Pattern):
    def spans(texts: pa.Array) -> pa.Array:
        ends, s, a, b = _found(texts, rx)
        return _lists(texts, ends, pa.StructArray.from_arrays([pa.array(s, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["s", "a", "b"]))

    return F.arrow_udf(spans, _SPAN)


_TOKENS = T.ArrayType(
    T.StructType(
        [T.StructField("ix", T.IntegerType()), T.StructField("ix_end", T.IntegerType())]
        + [T.StructField(c, T.StringType()) for c in ("text", "lemma", "pos")]
        + [T.StructField("is_stop", T.BooleanType())]
    )
)


def _lemma(word: str) -> str:
    low = word.lower()
    return _ENDING.sub("", low) if len(low) > 4 else low


def tokens_of(texts: pa.Array) -> pa.Array:
    """The tokens of an Arrow batch of texts, as ``tokens`` gives them."""
    ends, s, a, b = _found(texts, _TOKEN)
    stop = frozenset(STOP_WORDS)
    fields = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(s, pa.string()), pa.array([_lemma(w) for w in s], pa.string()),
              pa.array(["WORD" if w[0].isalnum() or w[0] == "_" else "PUNCT" for w in s], pa.string()), pa.array([w.lower() in stop for w in s], pa.bool_())]
    return _lists(texts, ends, pa.StructArray.from_arrays(fields, _TOKENS.elementType.names))


_ENDING = re.compile("(ing|ed|es|s)$")


def lemma(word: Column) -> Column:
    """Lower case without the endings -ing, -ed, -es, -s of longer words."""
    w = F.lower(word)
    return F.when(F.length(w) > 4, F.regexp_replace(w, "(ing|ed|es|s)$", "")).otherwise(w)


def tokens(text: Column | str) -> Column:
    """array<struct<ix, ix_end, text, lemma, pos, is_stop>>: words and signs with half-open character offsets.

    Spark's regex functions give no positions, and cumulating lengths in a fold copies its array at every
    step; an Arrow function reads each text once. Null for null, empty for a text without tokens.
    """
    return F.arrow_udf(tokens_of, _TOKENS)(text)


def word_spans(text: Column | str) -> Column:
    """array<struct<s, a, b>>: runs without white space."""
    return _spans_udf(_RUN)(text)


def word_boundaries(text: Column | str) -> Column:
    """array<struct<s, a, b>>: stretches between white space and ASCII punctuation; empty for an empty text (S5, trap X40)."""
    return _spans_udf(_BETWEEN)(text)


def windows(toks: Column, width: int) -> Column:
    """All runs of ``width`` consecutive tokens; none for a shorter array."""
    n = F.size(toks)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.slice(toks, i, width))).otherwise(F.slice(F.array(toks), 1, 0))


def keeps(toks: Column) -> Column:
    """A window without punctuation and not of stop words only; an empty one is dropped (P10)."""
    return (F.size(toks) > 0) & ~F.exists(toks, lambda t: t["pos"] == "PUNCT") & ~F.forall(toks, lambda t: t["is_stop"])


def lemma_key(toks: Column) -> Column:
    """Lemmas joined by blanks."""
    return F.array_join(F.transform(toks, lambda t: t["lemma"]), " ")


def word_grouping(label: Column | str) -> Column:
    """Number of words, if it is 1 to 4."""
    label = F.col(label) if isinstance(label, str) else label
    n = F.size(F.split(F.trim(label), r"\s+"))
    return F.when((F.trim(label) != "") & n.between(1, 4), n)


def sentences(text: Column | str) -> Column:
    """Sentences of a text with collapsed white space, split after . ! ? between a lower-case sign and a capital."""
    text = F.col(text) if isinstance(text, str) else text
    flat = F.regexp_replace(text, r"\s+", " ")
    # fixed values: the boundary, and the signs taken off both ends (white space and plus signs)
    boundary, ends = r"(?<=[^A-Z][.!?])\s*(?=[A-Z])", r"^[\s+]+|[\s+]+$"
    return F.filter(F.transform(F.split(flat, boundary), lambda s: F.regexp_replace(s, ends, "")), lambda s: s != "")


def chunks(text: Column | str, most: int) -> Column:
    """Pieces of at most ``most`` characters that end with white space where there is some (S3, trap X32: line breaks between pieces are lost)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(rf"(.{{1,{most - 1}}}(?:\s|$)|.{{1,{most}}})"), F.lit(1))


def budget_pieces(text: Column | str, most: int, tokenizer: Callable[[str], list[tuple[int, int]]] | None = None) -> Column:
    """array<string>: a text in pieces of at most ``most`` tokens that together are the text.

    ``tokenizer`` gives the (start, end) of every token; words and signs without one. A piece goes as far as the
    budget allows, then back to the last blank in it, if there is one behind its first character. Empty for an
    empty text, null for null.
    """
    if most < 1:
        raise ValueError("a piece needs at least one token")
    spans_of = tokenizer or (lambda t: [m.span() for m in _TOKEN.finditer(t)])

    def cut(texts: pa.Array) -> pa.Array:
        out, ends = [], [0]
        for x in texts:
            t = x.as_py() or ""
            starts = [a for a, _ in spans_of(t)]
            at = 0
            while at < len(t):
                k = bisect_left(starts, at)  # tokens that begin in this piece; one that a blank never divides is whole
                end = starts[k + most] if k + most < len(starts) else len(t)
                if end < len(t) and (blank := t.rfind(" ", at + 1, end)) > at:
                    end = blank
                out.append(t[at:end])
                at = end
            ends.append(len(out))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.string()), mask=texts.is_null())

    return F.arrow_udf(cut, "array<string>")(text)


def phrase_matches(text: Column | str, phrase: str, suffix: int = 1, buffer: int = 10) -> Column:
    """array<struct<s, a, b>>: where the words of a phrase follow each other in a text (S1, traps X31, X34).

    Words are looked at one by one. Each phrase word of more than 5 letters loses its last ``suffix`` letters;
    a text word fits when it begins with what is left. White space and fewer than ``buffer`` further characters,
    letters, digits, white space and hyphens only, may lie between two. Case counts. Matches don't overlap; of
    several continuations the longest gap is taken.
    """
    stems = [w[: len(w) - suffix] if suffix > 0 and len(w) > 5 else w for w in phrase.split()]

    def one(t: str) -> list[tuple[str, int, int]]:
        starts = [m.start() for m in _WORDS.finditer(t)]
        out, free = [], 0

        def follow(k: int, a: int) -> int | None:
            """Where stems[k:] end if the first of them stands at ``a``."""
            if not t.startswith(stems[k], a):
                return None
            end = _REST.match(t, a + len(stems[k])).end()
            if k + 1 == len(stems):
                return end
            lead = _SPACE.match(t, end).end()
            for nxt in reversed(starts[bisect_left(starts, lead) : bisect_left(starts, lead + buffer)] if lead > end else ()):
                if _GAP.fullmatch(t, lead, nxt) and (last := follow(k + 1, nxt)) is not None:
                    return last
            return None

        for a in starts if stems else ():
            if a >= free and (end := follow(0, a)) is not None:
                out.append((t[a:end], a, end))
                free = end
        return out

    def find(texts: pa.Array) -> pa.Array:
        found = [one(x.as_py() or "") for x in texts]
        s, a, b = zip(*[m for ms in found for m in ms]) if any(found) else ((), (), ())
        ends = [0]
        for ms in found:
            ends.append(ends[-1] + len(ms))
        return _lists(texts, ends, pa.StructArray.from_arrays([pa.array(s, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["s", "a", "b"]))

    return F.arrow_udf(find, _SPAN)(text)


def overlapping(spans: Column, a: Column, b: Column) -> Column:
    """Spans (structs with a and b) that overlap [a, b); empty ones never do."""
    return F.filter(spans, lambda t: (t["a"] < b) & (t["b"] > a) & (t["b"] > t["a"]))


def contexts(text: Column | str, marks: Column | str, before: int = 5, after: int = 5) -> Column:
    """array<string>: for each of ``marks`` (structs that begin with a and b) the mention in « » between up to ``before`` and ``after`` words.

    The text is split into words once for all of its mentions. Empty strings where the text is null.
    """

    def around(texts: pa.Array, marks: pa.Array) -> pa.Array:
        out, ends = [], [0]
        flat = marks.flatten()
        starts, stops, at = flat.field(0).to_pylist(), flat.field(1).to_pylist(), 0
        for t, n in zip(texts, marks.value_lengths().fill_null(0).to_pylist()):
            body = t.as_py()
            spans = [m.span() for m in _RUN.finditer(body or "")]
            firsts, lasts = [x for x, _ in spans], [y for _, y in spans]
            word = lambda k: body[firsts[k] : lasts[k]]  # noqa: E731, B023
            for a, b in zip(starts[at : at + n], stops[at : at + n]):
                if body is None or a is None or b is None:
                    out.append("")
                    continue
                # words that end by a, words that begin from b on, and those that overlap [a, b) between them
                left, right = bisect_right(lasts, a), bisect_left(firsts, b)
                inside = " ".join(map(word, range(left, right)))
                out.append(" ".join([*map(word, range(max(0, left - before), left)), f"«{inside}»", *map(word, range(right, min(len(spans), right + after)))]))
            at += n
            ends.append(len(out))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.string()))

    return F.arrow_udf(around, "array<string>")(text, marks)


def simplicity(label: Column, frequency: Column, least: float = 1e-8, multiword: float = 0.2, stopword: float = 0.3) -> Column:
    """Harmonic mean of the content words' frequencies with penalties for further and for stop words.

    ``frequency`` is a map from word to frequency.
    """
    # fixed values: these words and the three numbers above decide results
    stops = ("is", "of", "the", "a", "an", "to", "for", "or", "in", "has")
    words = F.filter(F.split(F.lower(F.trim(label)), r"\s+"), lambda w: w != "")
    content = F.filter(words, lambda w: ~w.isin(*stops))
    n, k = F.size(words), F.size(content)
    inverse = F.aggregate(content, F.lit(0.0), lambda s, w: s + 1 / F.greatest(F.coalesce(F.try_element_at(frequency, w), F.lit(least)), F.lit(least)))
    penalty = F.when(n > 1, F.greatest(F.lit(0.0), 1 - multiword * (n - 1)) * F.when(n > k, F.greatest(F.lit(0.0), 1 - stopword * (n - k))).otherwise(1.0)).otherwise(1.0)
    return F.when(n == 0, 0.0).when(k == 0, least).otherwise(F.try_divide(k.cast("double"), inverse) * penalty)


def combination_key(members: Column) -> Column:
    """arity:model/layer+model/layer with sorted members."""
    return F.concat(F.size(members).cast("string"), F.lit(":"), F.array_join(F.array_sort(members), "+"))


def combination_members(key: Column) -> Column:
    """The members of a combination key."""
    return F.split(F.substring_index(key, ":", -1), r"\+")


def layer_indices(spec: str) -> list[int]:
    """Distinct negative layer numbers of a digit string, ascending."""
    digits = re.sub(r"[,\s_]", "", spec)
    if not digits or not digits.isdigit():
        raise ValueError(f"not a layer specification: {spec!r}")
    return sorted({-int(c) for c in digits})
