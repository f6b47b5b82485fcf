"""Benchmark decontamination by the q-gram lemma, verified by banded alignment.

A place in a text within k edits of an item of m characters shares at least t = m + 1 - q (k + 1) of the item's
q-grams with it, on diagonals (place in the text minus place in the item) that lie within 2 k of each other. Shared
q-grams are counted in bands of diagonals that overlap by 2 k, so one band holds them all; bands with fewer than t
are dropped, the regions of the others are aligned within the band (Rasmussen, Stoye and Myers 2006).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, stage

WORD = re.compile(r"\w+")
#: Length of the grams, edits allowed as a share of an item's characters.
GRAM, BUDGET = 10, 0.07
#: Characters of benchmark text that one pass over the documents holds (an index takes some 40 bytes for each); larger
#: benchmarks take more passes, of which each is written before the next block reaches the driver.
BLOCK_CHARS = 4_000_000
#: Characters of documents looked at together, and bits of the prefilter's index.
SLAB, FILTER_BITS = 1 << 20, 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> str:
    """Lower-cased words joined by single blanks."""
    return " ".join(WORD.findall((text or "").lower()))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q-gram."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = int(_BASE)
    width, power = 1, codes.astype(np.uint64)  # hashes of the first `width` characters, doubled
    h, done = np.zeros(n, np.uint64), 0
    while True:
        if q & width:  # append `width` characters
            h = h * np.uint64(pow(base, width, 1 << 64)) + power[done : done + n]
            done += width
        if done == q:
            break
        power = power[: len(power) - width] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
        width *= 2
    return h ^ (h >> np.uint64(29))


def alignment(item: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of `item` in `region`, or None if it takes more than `budget` edits.

    Free start and end in the region; a row holds only diagonals 0 to len(region) - len(item) + budget, the band.
    """
    m, width = len(item), len(region) - len(item) + 2 * budget + 1
    if width <= 0:
        return None
    sought, found = item.tobytes(), -1
    while (found := region.tobytes().find(sought, found + 1)) >= 0:  # the item itself needs no rows
        if found % 4 == 0:
            return 0, found // 4, found // 4 + m
    padded = np.concatenate((np.full(budget, 0xFFFFFFFF, np.uint32), region, np.full(budget + 1, 0xFFFFFFFF, np.uint32)))
    big, steps = m + len(region) + 1, np.arange(width)
    row = np.zeros(width, np.int64)  # row[j]: item[:i] ends at padded[j + i]
    begun = steps.copy()
    for i in range(m):
        take = row + (padded[i : i + width] != item[i])
        drop = np.append(row[1:], big) + 1  # the item's character is missing in the text
        origin = np.where(drop < take, np.append(begun[1:], 0), begun)
        new = np.minimum(take, drop)
        run = np.minimum.accumulate(new - steps)  # characters of the text beyond the item's
        at = np.maximum.accumulate(np.where(new - steps == run, steps, 0))
        row, begun = run + steps, origin[at]
        if row.min() > budget:
            return None
    j = int(row.argmin())
    edits = int(row[j])
    return None if edits > budget else (edits, max(0, int(begun[j]) - budget), min(len(region), j + m - budget))


class Index:
    """The q-grams of a block of benchmark items, (id, text) each. Items shorter than a gram have none and are passed over."""

    def __init__(self, items: list[tuple[int, str]], q: int = GRAM, budget: float = BUDGET):
        self.q = q
        kept = [(i, c) for i, t in items if len(c := _codes(normalised(t))) >= q]
        self.ids = [i for i, _ in kept]
        self.codes = [c for _, c in kept]
        size = np.array([len(c) for c in self.codes], np.int64)
        self.size = size
        self.edits = np.minimum((size * budget).astype(np.int64), (size - q) // q)  # the lemma needs t >= 1
        self.least = size + 1 - q * (self.edits + 1)
        self.step = np.maximum(16, 2 * self.edits + 1)
        self.shift = 2 * int(size.max(initial=0)) + 1  # keeps numbers of diagonals and bands positive
        grams = [_grams(c, q) for c in self.codes]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(kept)), [len(g) for g in grams])[order] if kept else np.zeros(0, np.int64)
        self.at = (np.concatenate([np.arange(len(g)) for g in grams])[order]) if kept else np.zeros(0, np.int64)
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.grams >> np.uint64(64 - FILTER_BITS)] = True

    def _candidates(self, codes: np.ndarray) -> np.ndarray:
        """(item, band) with enough shared q-grams."""
        h = _grams(codes, self.q)
        places = np.flatnonzero(self.maybe[h >> np.uint64(64 - FILTER_BITS)])
        if not len(places) or not len(self.grams):
            return np.zeros((0, 2), np.int64)
        slot = np.minimum(np.searchsorted(self.grams, h[places]), len(self.grams) - 1)
        same = self.grams[slot] == h[places]
        places, slot = places[same], slot[same]
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        many = self.first[slot + 1] - self.first[slot]
        for part in np.array_split(np.arange(len(places)), int(many.sum()) // 4_000_000 + 1):
            n = many[part]
            if not n.sum():
                continue
            entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[slot[part]], n)
            item = self.item[entry]
            diagonal = np.repeat(places[part], n) - self.at[entry] + self.shift
            step = self.step[item]
            band = diagonal // step
            low = diagonal - band * step < 2 * self.edits[item]  # also lies in the overlap of the band before
            key = np.concatenate((item << 40 | band, (item << 40 | band - 1)[low]))
            counts.append(np.unique(key, return_counts=True))
        if not counts:
            return np.zeros((0, 2), np.int64)
        keys, back = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
        total = np.bincount(back, np.concatenate([c for _, c in counts]), len(keys))
        keys = keys[total >= self.least[keys >> 40]]
        return np.stack((keys >> 40, keys & ((1 << 40) - 1)), 1)

    def search(self, texts: list[str]) -> list[dict[int, tuple[int, int, int]]]:
        """For each normalised text: item id -> (edits, start, end) of its best place, characters of that text."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        overlap = int(self.size.max() + 2 * self.edits.max()) + self.q if len(self.size) else 0
        slab: list[tuple[int, int, str]] = []
        held = 0
        for k, text in enumerate(texts):
            for at in range(0, max(len(text), 1), SLAB):  # long texts in pieces that overlap by an item
                piece = text[at : at + SLAB + overlap]
                slab.append((k, at, piece))
                held += len(piece)
                if held > SLAB:
                    self._slab(slab, out)
                    slab, held = [], 0
        self._slab(slab, out)
        return out

    def _slab(self, slab: list[tuple[int, int, str]], out: list[dict[int, tuple[int, int, int]]]) -> None:
        if not slab or not self.ids:
            return
        codes = _codes("\n".join(p for _, _, p in slab))
        ends = np.cumsum([len(p) + 1 for _, _, p in slab])
        starts = np.concatenate(([0], ends[:-1]))
        for item, band in self._candidates(codes).tolist():
            k, m = int(self.edits[item]), int(self.size[item])
            low = band * int(self.step[item]) - self.shift - k
            high = low + int(self.step[item]) + 4 * k + m
            for piece in range(int(np.searchsorted(ends, max(low, 0), "right")), len(slab)):
                if starts[piece] >= high:
                    break
                a, b = max(low, int(starts[piece])), min(high, int(ends[piece]) - 1)
                if b - a < m - k:
                    continue
                region = codes[a:b]
                found = alignment(self.codes[item], region, k)
                if found:
                    doc, at, _ = slab[piece]
                    place = (found[0], at + a - int(starts[piece]) + found[1], at + a - int(starts[piece]) + found[2])
                    name = self.ids[item]
                    out[doc][name] = min(out[doc].get(name, place), place)


def _blocks(benchmark: DataFrame) -> tuple[int, Callable[[int], list[tuple[int, str]]]]:
    """Number of blocks of about BLOCK_CHARS characters, and what collects one of them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-total // BLOCK_CHARS) or 1
    return n, lambda k: [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


_HITS = "array<struct<item_id:long,edits:int,start:int,end:int>>"


def _searched(rows: DataFrame, columns: list[tuple[str, pa.DataType, str]], block: list[tuple[int, str]], q: int, budget: float) -> DataFrame:
    """`columns` (name, type, DDL) of `rows`, and items, those of the block that its text holds."""
    index = rows.sparkSession.sparkContext.broadcast(Index(block, q, budget))  # of a block, so bounded
    found = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([*[(name, kind) for name, kind, _ in columns], ("items", found)])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = index.value.search([normalised(cell.as_py()) for cell in batch.column("text")])
            items = [[{"item_id": i, "edits": e, "start": a, "end": b} for i, (e, a, b) in sorted(new.items())] for new in hits]
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name, _, _ in columns], pa.array(items, found)], schema=schema)

    return rows.mapInArrow(work, ", ".join(f"{name} {ddl}" for name, _, ddl in columns) + f", items {_HITS}")


def contaminations(docs: DataFrame, benchmark: DataFrame, q: int = GRAM, budget: float = BUDGET) -> DataFrame:
    """doc_id, contaminated, items for each row of `docs`; items holds (item_id, edits, start, end) by item_id.

    An item is in a document if some place is within budget * its length edits of it, both normalised to
    lower-case words joined by blanks; start and end count characters of the normalised text. Null texts count as
    empty; null items, and items shorter than q characters, match nothing; an empty benchmark leaves all clean.
    Items with one id are one item, which any of its texts shows. Repeated rows and null ids pass through; other
    columns are ignored, whatever their names. With one block nothing is shuffled; with more, each pass writes the
    texts it found something in, by digest, and these meet the documents' digests in the end.
    """
    n, block = _blocks(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if n == 1:
        found = _searched(rows, [("doc_id", pa.int64(), "long")], block(0), q, budget)
    else:
        keyed = rows.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
        passes = [stage(_searched(keyed.select("digest", "text"), [("digest", pa.binary(), "binary")], block(k), q, budget).filter("size(items) > 0"), "benchmark-hits") for k in range(n)]
        first = [p.groupBy("digest").agg(F.first("items").alias("items")) for p in passes]  # equal texts hold the same
        together = first[0]
        for p in first[1:]:
            together = together.union(p)
        best = F.array_sort(F.flatten(F.collect_list("items")))
        lesser = F.filter(best, lambda x, i: (i == 0) | (F.get(best, i - 1)["item_id"] != x["item_id"]))  # an id in two blocks: fewest edits
        hits = stage(together.groupBy("digest").agg(lesser.alias("items")), "benchmark-items")
        for p in passes:
            free(p)
        found = keyed.drop("text").join(hits, "digest", "left").select("doc_id", F.coalesce("items", F.array().cast(_HITS)).alias("items"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.array_sort("items").alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = GRAM, budget: float = BUDGET) -> DataFrame:
    """Rows of `docs` that hold no benchmark item, all columns as they were; judged where they are read.

    Null and empty texts hold none and stay, rows with a null or repeated id are judged each by its own text, an
    empty benchmark drops nothing, an empty table stays empty; no column is added, so none can clash. Where the
    benchmark takes several passes, each but the last writes what it leaves.
    """
    n, block = _blocks(benchmark)
    left = docs
    for k in range(n):
        before, left = left, left.filter(_clean(docs.sparkSession.sparkContext.broadcast(Index(block(k), q, budget)))(F.col("text")))
        if k + 1 < n:
            left = stage(left, "benchmark-left")
            free(before)
    return left


def _clean(index: Broadcast):  # noqa: ANN202
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        return pa.array([not found for found in index.value.search([normalised(cell.as_py()) for cell in text])], pa.bool_())

    return clean
