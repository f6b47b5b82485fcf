"""Repeated passages by winnowing over line hashes: window minima, positions, extension both ways, deletion of later runs.

A text is cut into short lines: after line feeds, and after a punctuation mark or a word in d before a blank. Cuts depend on what stands beside them only, so equal passages have equal lines but for a part of a
line at either end, wherever they begin. Of every WINDOW consecutive line hashes the least is selected (Schleimer,
Wilkerson and Aiken 2003), and each line of LONG words; the fingerprint of a selected line is the hash of the lines from it on that hold MIN_WORDS
words, so each fingerprint that recurs is a repeated run by itself, and whatever holds MIN_WORDS words after a window
of lines shares one. Fingerprints are joined with the first place where they occur, by (doc_id, row, line), and never
with each other; the runs of each pair of rows at each distance are extended both ways by comparing line hashes, and
what they cover is deleted. Only DataFrame functions.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Zero-width cuts, so that the lines joined are the text; none within white space, so that each line has a word.
CUT = r"(?<=[\n \t])(?=\S)(?<=\n|[.!?,;:|d][ \t])"
#: Lines of which one is selected, and words with which a line is selected anyway: where lines are long, a window is too.
WINDOW, LONG = 4, 10
#: White space as Unicode has it, beside the blank and the line feed, and what tells that a line's blanks are not its words.
OTHER = [chr(c) for c in (0x9, 0xB, 0xC, 0xD, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: First bytes of most of them.
GENERAL = b"\xe2\x80"
DOUBLE = ["  ", "\n\n", " \n", "\n "]
WORD = rf"[^ \n{''.join(f'\\x{{{ord(c):X}}}' for c in OTHER)}]+"
#: Words of whole lines in a run that is deleted: a passage of 50 words, less a part of a line and a window.
MIN_WORDS = 20
#: Lines of a run and its words in one number: words << LINES | lines.
LINES = 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), CUT)


def _uneven(text: Column) -> Column:
    """Whether `text` has white space other than single blanks and line feeds between words.

    One look at each character for what a Latin-1 table holds, substrings for the rest, since a class of so many ranges
    is slow; the rest is sought in texts beyond ASCII only, and what begins with the bytes E2 80 only where these stand.
    """
    any_of = lambda parts: functools.reduce(lambda a, b: a | b, [text.contains(x) for x in parts])
    low, high = [c for c in OTHER if c <= "\xff"], [c for c in OTHER if c > "\xff"]
    general = [c for c in high if c.encode().startswith(GENERAL)]
    beyond = any_of(c for c in high if c not in general) | (text.contains(F.lit(GENERAL).cast("string")) & any_of(general))
    latin = f"[{''.join(f'\\x{{{ord(c):X}}}' for c in low)}]"
    return text.startswith(" ") | text.startswith("\n") | any_of(DOUBLE) | text.rlike(latin) | ((F.length(text) < F.octet_length(text)) & beyond)


def _spots(h: Column, w: Column, least: int) -> Column:
    """array of (fp, at, k): the selected lines from which on k lines have the words."""
    # The lowest bits give way to the place in the window, so that the least says where it stands, the left one of equals.
    bits = (WINDOW - 1).bit_length()
    marked = lambda j, k: F.get(h, j + k).bitwiseAND(F.lit(-1 << bits)).bitwiseOR(F.lit(k))  # noqa: E731  null outside
    long = F.filter(F.transform(w, lambda x, i: F.when(x >= LONG, i)), lambda i: i.isNotNull())
    windows = F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0)))
    least_of = F.transform(windows, lambda j: j + F.least(*[marked(j, k) for k in range(WINDOW)]).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
    selected = F.array_distinct(F.concat(least_of, long))
    enough, some = least << LINES, 8

    def packed(i: Column) -> Column:
        """Words and lines from line i on until there are enough. A line has a word at least, so `least` lines do."""
        add = lambda a, x: F.when(a >= enough, a).otherwise(a + F.shiftleft(x.cast("long"), LINES) + 1)
        few = F.aggregate(F.slice(w, i + 1, F.lit(some)), F.lit(0).cast("long"), add)
        more = lambda a: F.aggregate(F.slice(w, i + 1 + some, F.lit(least + 1)), a, add)
        return F.element_at(F.transform(F.array(few), lambda a: F.when(a >= enough, a).otherwise(more(a))), 1)

    starts = F.filter(F.transform(selected, lambda i: F.struct(i.alias("at"), packed(i).alias("p"))), lambda s: s["p"] >= enough)
    k = lambda s: s["p"].bitwiseAND(F.lit((1 << LINES) - 1)).cast("int")
    return F.transform(starts, lambda s: F.struct(F.xxhash64(F.slice(h, s["at"] + 1, k(s))).alias("fp"), s["at"].alias("at"), k(s).alias("k")))


def lines_of(docs: DataFrame, least: int = MIN_WORDS, with_text: bool = False) -> DataFrame:
    """row, doc_id, h (hash of each line), w (its words), spots (its fingerprints), written to shared storage."""
    text = F.coalesce("text", F.lit(""))
    # The last line ends like the others, so that it has a word for each blank and is found inside longer texts.
    closed = F.when((text == "") | text.endswith(" ") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit(" ")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", _uneven(text).alias("uneven"), _lines(closed).alias("lines"))
    # Words are runs of what is not white space; texts with single blanks only need no regex for each line.
    spaced = F.transform("lines", lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + x.endswith("\n").cast("int"))
    counted = F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD)))
    rows = rows.select("row", "doc_id", "text", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.when(F.col("uneven"), counted).otherwise(spaced).alias("w"))
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("h.list.element", "spots.list.element.fp")}  # hashes hardly repeat
    return stage(rows.withColumn("spots", _spots(F.col("h"), F.col("w"), least)).select("row", "doc_id", "h", "w", "spots", *(["text"] if with_text else [])), "lines", plain)


def _merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, a, b: spans a to b (exclusive) with the same keys that touch, as one."""
    before = Window.partitionBy(*keys).orderBy("a")
    reach = F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("opens", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1)))
    return opens.withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def repeats(lines: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """row, spans (start, end of the lines that occur earlier, sorted), copies_of, for rows of `lines` that have any.

    A run of equal lines has a fingerprint after every window, so beyond its outermost ones lie fewer lines than
    `least` and a window: so many are compared both ways. Where the first place of an outermost fingerprint goes on
    differently than a later one, the run may lack as much at that end. What meets at one key is one row per task for
    the first place, and is never paired.
    """
    spots = lines.select("row", "doc_id", F.explode("spots").alias("x"))
    at = F.shiftleft(F.col("x.at").cast("long"), LINES)
    spots = spots.select("x.fp", "doc_id", "row", at.bitwiseOR(F.col("x.k").cast("long")).alias("place"))
    first = spots.groupBy("fp").agg(F.min(F.struct("doc_id", "row", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    # Staged, so that both sides of the join are plain shuffles and a hot fingerprint's rows can be split at run time.
    first = stage(first.filter("n > 1").drop("n"), "first-places")
    later = spots.join(first, "fp").filter("row <> first.row or place <> first.place")
    start = lambda place: F.shiftright(place, LINES)
    spans = later.select("row", F.col("first.row").alias("source"), (start(F.col("place")) - start(F.col("first.place"))).alias("distance"), start(F.col("place")).alias("a"),
                         (start(F.col("place")) + F.col("place").bitwiseAND(F.lit((1 << LINES) - 1))).alias("b"), F.col("first.doc_id").alias("name"))
    runs = _merged(spans.repartition("row"), ["row", "source", "distance", "name"])
    hashes, reach = lines.select(F.col("row").alias("at_row"), F.col("h")), least + WINDOW
    sourced = runs.join(hashes, F.col("source") == F.col("at_row")).select(
        "row", "name", "a", "b",
        F.reverse(F.slice("h", F.greatest(F.col("a") - F.col("distance") - reach, F.lit(0)).cast("int") + 1, F.least(F.col("a") - F.col("distance"), F.lit(reach)).cast("int"))).alias("left"),
        F.slice("h", (F.col("b") - F.col("distance")).cast("int") + 1, F.lit(reach)).alias("right"),
    )
    equal = lambda flags: F.coalesce(F.nullif(F.array_position(flags, False), F.lit(0)) - 1, F.size(flags).cast("long"))  # noqa: E731  how many before the first that differs
    line = lambda i: F.get("h", i.cast("int"))  # noqa: E731  null outside
    left = equal(F.transform("left", lambda x, j: x.eqNullSafe(line(F.col("a") - 1 - j))))
    right = equal(F.transform("right", lambda x, j: x.eqNullSafe(line(F.col("b") + j))))
    grown = sourced.join(hashes, F.col("row") == F.col("at_row")).select("row", "name", (F.col("a") - left).alias("a"), (F.col("b") + right).alias("b"))
    names = grown.groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("copies_of"))
    whole = _merged(grown, ["row"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("a").cast("int").alias("start"), F.col("b").cast("int").alias("end")))).alias("spans"))
    return whole.join(names, "row")


def _report(lines: DataFrame, found: DataFrame) -> DataFrame:
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    out = lines.select(*[c for c in lines.columns if c not in ("h", "spots")]).join(found, "row", "left")
    runs = F.transform(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), total(F.slice("w", r["start"] + 1, r["end"] - r["start"])).alias("words")))
    return out.withColumns(
        {
            "runs": runs,
            "copies_of": F.coalesce("copies_of", F.array().cast("array<long>")),
            "n_lines": F.size("w").cast("long"),
            "n_words": total(F.col("w")),
            "removed_words": total(F.transform(runs, lambda r: r["words"])),
        }
    )


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_words, removed_words, runs, copies_of for each row of `docs`.

    runs lists the line intervals (end exclusive, with their words) covered by runs of at least `least` words that
    occur earlier, in a row with a smaller (doc_id, place in the table) or further up in the same text; copies_of the
    ids of the texts they were matched with. Null text counts as empty and has one empty line; null ids sort first;
    the second of two repeated rows repeats the first. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    lines = lines_of(docs, least)
    return _report(lines, repeats(lines, least)).select("doc_id", "n_lines", "n_words", "removed_words", "runs", "copies_of")


def delete_repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id and text without the runs that repeated_runs reports, one row per row of `docs`; all other characters stay.

    Nulls, empty texts, repeated rows, empty tables and other columns as there.
    """
    lines = lines_of(docs, least, with_text=True)
    out = _report(lines, repeats(lines, least)).withColumn("lines", _lines(F.col("text")))
    ends = F.concat(F.array(F.lit(0)), F.col("runs.end"))
    starts = F.concat(F.col("runs.start"), F.array(F.size("lines")))
    left = F.zip_with(ends, starts, lambda a, b: F.array_join(F.slice("lines", a + 1, F.greatest(b - a, F.lit(0))), ""))
    return out.select("doc_id", F.when(F.size("runs") > 0, F.array_join(left, "")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
