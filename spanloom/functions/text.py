"""Span algebra over text as column expressions: find, trim, overlap, resolve, render.

A span is a struct with start and end, code points from 0, end exclusive. Nothing here moves rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
CANDIDATE = "array<struct<start:int,end:int,label:string,priority:int,source:string>>"


def rx(pattern: str, fold: bool = False) -> str:
    """Classes and word boundaries over Unicode, as the patterns mean them; fold: ignore case."""
    return ("(?Ui)" if fold else "(?U)") + guarded(pattern, fold)


def guarded(pattern: str, fold: bool = False) -> str:
    """The pattern behind a cheap test that every match passes: its first character, and none of a word before a word boundary.

    Most places in a text fail it, so that boundaries over Unicode and alternatives are tried at few. The test may let more
    pass than can match, never less; patterns whose first character is not told stay as they are.
    """
    try:
        tree = parser.parse(pattern.replace(r"\z", r"\Z"))
    except re.error:  # syntax of Java only
        return pattern
    first = _first(tree, fold or bool(tree.state.flags & re.IGNORECASE))
    if first is None or first[1]:
        return pattern
    chars, _, bounded = first
    rest = "\\x{80}-\\x{10ffff}" if any(c > 127 for c in chars) else ""
    test = f"(?=(?-i:[{''.join(rf'\x{c:02x}' for c in sorted(chars) if c < 128)}{rest}]))"
    words = all(c > 127 or chr(c).isalnum() or c == 95 for c in chars)
    return test + ("(?<!(?-i:[A-Za-z0-9_]))" if bounded and words else "") + f"(?:{pattern})"


_BEYOND = 128  #: stands for all characters beyond ASCII
_CLASSES = {
    parser.CATEGORY_DIGIT: {*range(48, 58), _BEYOND}, parser.CATEGORY_WORD: {*(c for c in range(128) if chr(c).isalnum() or c == 95), _BEYOND},
    parser.CATEGORY_SPACE: {*range(9, 14), *range(28, 33), _BEYOND},
}


def _first(seq, fold: bool) -> tuple[set[int], bool, bool] | None:
    """What a match of a parsed pattern can begin with, whether it can be empty, and whether it begins at a word boundary; None: unknown."""
    chars, bounded = set(), False

    def add(low: int, high: int) -> None:
        for c in range(low, min(high, 127) + 1):
            chars.update({c, ord(chr(c).lower()), ord(chr(c).upper())} if fold else {c})
            if fold and chr(c).lower() in "iks":  # other characters fold to these
                chars.add(_BEYOND)
        if high > 127:
            chars.add(_BEYOND)
            if fold:
                chars.update(map(ord, "iIkKsS"))

    for op, av in seq:
        if op is parser.AT:
            bounded |= av is parser.AT_BOUNDARY and not chars
        elif op is parser.ASSERT_NOT and av[0] < 0 and list(av[1]) == [(parser.IN, [(parser.CATEGORY, parser.CATEGORY_WORD)])]:
            bounded |= not chars
        elif op in (parser.ASSERT, parser.ASSERT_NOT):
            pass
        elif op is parser.LITERAL:
            add(av, av)
            return chars, False, bounded
        elif op is parser.IN:
            for kind, value in av:
                if kind is parser.LITERAL:
                    add(value, value)
                elif kind is parser.RANGE:
                    add(*value)
                elif kind is parser.CATEGORY and value in _CLASSES:
                    chars |= _CLASSES[value]
                else:
                    return None
            return chars, False, bounded
        else:
            if op is parser.SUBPATTERN:
                parts, optional, inner = [av[3]], False, (fold or bool(av[1] & re.IGNORECASE)) and not av[2] & re.IGNORECASE
            elif op is parser.BRANCH:
                parts, optional, inner = av[1], False, fold
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
                parts, optional, inner = [av[2]], av[0] == 0, fold
            else:
                return None
            got = [_first(part, inner) for part in parts]
            if any(g is None for g in got):
                return None
            # A boundary within counts where nothing can stand before it and no way leads past it.
            bounded |= not chars and not optional and all(g[2] for g in got)
            chars.update(*[g[0] for g in got])
            if not optional and not any(g[1] for g in got):
                return chars, False, bounded
    return chars, True, bounded


def piece(text: Column, start: Column, end: Column) -> Column:
    """Characters start .. end - 1."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once; an expression that a lambda mentions twice would else run twice."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


MARK = "\x01"


def find(text: Column, pattern: str | Column, group: int | None = None, gate: str | None = None) -> Column:
    """All matches with offsets. group: the span is that group, and group - 1 holds all that precedes it in the match.

    No built-in gives code-point offsets; they follow from the lengths of what matched and of what lies between. One pass of
    the regex puts marks around the parts of each match (a mark in the text counts as U+0002, to patterns the same), then the
    pieces are added up in turn: what lies before a match, the match; or what lies before, the groups, the match.
    gate: a cheaper regex without which nothing can match. A pattern column may be built from data.
    """
    found = F.coalesce(spans_of(cut(text, pattern, group), group), F.array().cast(SPAN))
    return F.when(text.rlike(gate), found).otherwise(F.array().cast(SPAN)) if gate else found


def cut(text: Column, pattern: str | Column, group: int | None = None) -> Column:
    """The pieces of find: null for a null text or pattern."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = ["$0"] if group is None else [f"${group - 1}", f"${group}", "$0"]
    return F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("\x02")), p, F.lit(MARK + MARK.join(parts) + MARK)), MARK, -1)


def spans_of(pieces: Column, group: int | None = None) -> Column:
    """Pieces of cut, added up to the spans that matched."""
    turns, at_value = (2, 1) if group is None else (4, 2)

    def step(acc: Column, x: Column) -> Column:
        turn, at, n = acc["turn"], acc["at"], F.length(x)
        start = at if group is None else at + acc["lead"]
        span = F.struct(start.alias("start"), (start + n).alias("end"), x.alias("text"))
        out = F.when(turn == at_value, F.array_append(acc["out"], span)).otherwise(acc["out"])
        moved = at + n if group is None else F.when((turn == 0) | (turn == 3), at + n).otherwise(at)
        lead = [] if group is None else [F.when(turn == 1, n).otherwise(acc["lead"]).alias("lead")]
        return F.struct(((turn + 1) % turns).alias("turn"), moved.alias("at"), *lead, out.alias("out"))

    zero = [F.lit(0).alias(n) for n in (("turn", "at") if group is None else ("turn", "at", "lead"))]
    return F.aggregate(pieces, F.struct(*zero, F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])


def trimmed(span: Column) -> Column:
    """Without outer white space and trailing , . ; : | -"""

    def cut(left: Column) -> Column:
        start = span["end"] - F.length(left)
        kept = F.regexp_replace(left, r"(?U)[\s,.;:|-]+\z", "")
        return let(kept, lambda k: F.struct(start.alias("start"), (start + F.length(k)).alias("end"), k.alias("text")))

    return let(F.regexp_replace(span["text"], r"\A(?U)\s+", ""), cut)


def digits_in(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def labelled(spans: Column, label: str, priority: int, source: str) -> Column:
    """Candidates of one layer."""
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(source).alias("source"))
    )


def resolve(candidates: Column) -> Column:
    """The best non-overlapping subset: by priority, length, start, label; then sorted by position. Empty spans go."""
    ranked = F.sort_array(  # compares without a lambda
        F.transform(
            F.filter(candidates, lambda c: c["end"] > c["start"]),
            lambda c: F.struct((-c["priority"]).alias("p"), (c["start"] - c["end"]).alias("n"), c["start"].alias("start"), c["label"].alias("label"), c["end"].alias("end"), c["source"].alias("source")),
        )
    )
    back = F.transform(
        ranked, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["label"].alias("label"), (-r["p"]).alias("priority"), r["source"].alias("source"))
    )
    return F.sort_array(kept_in_order(back))


def kept_in_order(candidates: Column) -> Column:
    """Greedy: each candidate that overlaps none kept before it."""
    return F.aggregate(
        candidates,
        F.array().cast(CANDIDATE),
        lambda acc, c: F.when(F.exists(acc, lambda o: overlaps(o, c)), acc).otherwise(F.array_append(acc, c)),
    )


def render(text: Column, spans: Column) -> Column:
    """Every span replaced by [LABEL], from the right so that offsets stay true."""
    return F.aggregate(
        F.reverse(spans),
        text,
        lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("["), s["label"], F.lit("]"), F.substring(t, s["end"] + 1, F.length(t))),
    )


def public(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences and clauses: after . ; : with white space, and lines."""
    return F.filter(F.transform(F.split(text, r"(?<=[.;:])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Trimmed, non-empty parts that end with . or a line; lists with ; or : stay in one piece."""
    return F.filter(F.transform(F.split(text, r"(?<=\.)\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def flattened(text: Column, limit: int = 220) -> Column:
    """One line of at most `limit` characters, line feeds shown as \\n."""
    one = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit - 3), F.lit("..."))).otherwise(one)


def snippet(text: Column, start: Column, end: Column, context: int = 30) -> Column:
    """The span in «», with its surroundings."""
    low = F.greatest(start - context, F.lit(0))
    return flattened(F.concat(piece(text, low, start), F.lit("«"), piece(text, start, end), F.lit("»"), piece(text, end, end + context)))
