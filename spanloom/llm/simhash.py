"""SimHash near-duplicates: exact links within a Hamming radius, found by bit-sliced comparison.

Distinct fingerprints are cut into blocks of bits. Two that differ in at most `radius` bits agree on all bits of
at least blocks - radius blocks, so they meet under one of the C(blocks, radius) keys made of that many blocks:
no link is lost. What shares a key is compared bit-sliced: the bits of 64 fingerprints at one position lie in one
machine word, a comparison of a fingerprint with 64 others is 64 XORs whose results feed carry-save counters,
and a word is abandoned once all its lanes exceed the radius.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, stage

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one key compared in one piece of work; larger keys are cut into a grid of such pieces.
CELL = 16384
#: Pairs (fingerprint, word of 64) held in memory at a time.
JOBS = 1 << 17
#: Tasks that share the neighbours of one node.
STARS = 16
#: Characters hashed at a time, so that very long texts need no memory in proportion.
PIECE = 1 << 20


def _pieces(data: bytes, width: int) -> Iterator[list[bytes]]:
    """Words, in runs that overlap by width - 1 words."""
    if len(data) <= PIECE:
        yield data.split()
        return
    carry: list[bytes] = []
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = re.compile(rb"[\x20\x09-\x0D]").search(data, end)
            end = cut.start() if cut else len(data)
        words = carry + data[at:end].split()
        at = end
        if len(words) < width and at < len(data):
            carry = words
            continue
        yield words
        carry = words[len(words) - width + 1 :] if width > 1 else []


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash over the XXH64 of all word shingles, repeats included; 0 where there are no words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, total, few = np.zeros(64, np.int64), 0, []
    for words in _pieces((text or "").encode("utf-8", "replace").lower(), width):
        few = words
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], "<u8")
        for part in np.array_split(hashes, len(hashes) // 65536 + 1):
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return digest(b" ".join(few), SEED) if few else 0
    return sum(1 << k for k in np.flatnonzero(2 * counts > total).tolist())


def fingerprints(docs: DataFrame, width: int = SHINGLE, row_key: Column | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and `row_key` (bytes) if given, one row per row of `docs`."""
    import pyarrow as pa

    fields = [("doc_id", pa.int64()), ("fp", pa.int64())] + ([("row_key", pa.binary())] if row_key is not None else [])
    schema = pa.schema(fields)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(cell.as_py(), width) for cell in batch.column("text")], np.uint64).view(np.int64)
            more = [batch.column(name) for name, _ in fields[2:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), *more], schema=schema)

    more = [row_key.alias("row_key")] if row_key is not None else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(work, "doc_id long, fp long" + ", row_key binary" * len(more))


# ------------------------------------------------------------------ comparison within a key


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit j of planes[p, w] is bit p of fps[64 w + j]."""
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T).reshape(64, words, 64), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(64, words)


def _near(planes: np.ndarray, queries: np.ndarray, words: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For jobs (query, word): (job numbers, lanes within the radius as bits). alive: the lanes that count."""
    jobs = np.arange(len(queries))
    over = ~alive
    digits = max(1, radius.bit_length())
    counter = [np.zeros(len(jobs), np.uint64) for _ in range(digits)]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(64):
        carry = planes[p, words] ^ (((queries >> np.uint64(p)) & np.uint64(1)) * full)
        for d in range(digits):  # carry-save: add one bit to 64 counters at once
            counter[d], carry = counter[d] ^ carry, counter[d] & carry
        over |= carry
        if radius + 1 < 1 << digits:  # lanes whose counter is now past the radius
            beyond = np.zeros(len(jobs), np.uint64)
            equal = np.full(len(jobs), full)
            for d in reversed(range(digits)):
                if radius >> d & 1:
                    equal &= counter[d]
                else:
                    beyond |= equal & counter[d]
                    equal &= ~counter[d]
            over |= beyond
        if p % 8 == 7:
            left = over != full
            if not left.all():  # abandon words in which every lane exceeds the radius
                jobs, over, queries, words = jobs[left], over[left], queries[left], words[left]
                counter = [c[left] for c in counter]
                if not len(jobs):
                    break
    return jobs, ~over


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _spread(jobs: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(job, lane) for every set bit."""
    hit = lanes != 0
    jobs, lanes = jobs[hit], lanes[hit]
    row, lane = np.nonzero(np.unpackbits(np.ascontiguousarray(lanes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return jobs[row], lane


def linked(fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (i, j) that connect what links within each run fps[starts[k]:starts[k + 1]], as trees."""
    runs = np.append(starts, len(fps))
    sizes = np.diff(runs)
    union = _Union(len(fps))
    # Every run gets whole words of its own; words of all runs lie side by side.
    words_of = -(-sizes // 64)
    first_word = np.concatenate(([0], np.cumsum(words_of)[:-1]))
    slot = np.arange(len(fps)) - np.repeat(runs[:-1], sizes) + np.repeat(first_word * 64, sizes)
    at_slot = np.full(int(words_of.sum()) * 64, -1)
    at_slot[slot] = np.arange(len(fps))
    laid = np.zeros(len(at_slot), np.uint64)
    laid[slot] = fps
    planes = _planes(laid)
    used = np.ascontiguousarray(np.packbits((at_slot >= 0).reshape(-1, 64), axis=1, bitorder="little")).view("<u8").ravel()
    settled = np.zeros(len(fps), bool)

    def compare(queries: np.ndarray, words: np.ndarray) -> None:
        for at in range(0, len(queries), JOBS):
            q, w = queries[at : at + JOBS], words[at : at + JOBS]
            jobs, lanes = _near(planes, fps[q], w, used[w], radius)
            for k in range(0, len(jobs), JOBS // 16):
                job, lane = _spread(jobs[k : k + JOBS // 16], lanes[k : k + JOBS // 16])
                a, b = q[job], at_slot[w[job] * 64 + lane]
                roots = np.array(union.up)
                ra, rb = roots[a], roots[b]
                differ = ra != rb
                if differ.any():
                    for x, y in np.unique(np.stack([ra[differ], rb[differ]], 1), axis=0).tolist():
                        union.join(x, y)

    # Crowded runs first shed what lies around a few hubs: those members need no comparison among themselves.
    for k in np.flatnonzero(sizes > 512).tolist():
        for _ in range(8):
            free = np.flatnonzero(~settled[runs[k] : runs[k + 1]]) + runs[k]
            if len(free) < 64:
                break
            span = np.arange(first_word[k], first_word[k] + words_of[k])
            hub = int(free[0])
            jobs, lanes = _near(planes, np.full(len(span), fps[hub]), span, used[span], radius)
            job, lane = _spread(jobs, lanes)
            members = at_slot[span[job] * 64 + lane]
            members = members[~settled[members]]
            for m in members.tolist():
                union.join(hub, m)
            settled[members] = True
            if len(members) * 10 < len(free):
                break
    hubs = np.array([union.find(i) for i in np.flatnonzero(settled).tolist()], int)
    lone = np.concatenate((np.flatnonzero(~settled), np.unique(hubs)))
    run_of = np.repeat(np.arange(len(sizes)), sizes)
    # A settled member's links to other settled members of another hub still count, so all but the largest
    # hub's members of a run are compared with the whole run.
    for k in np.flatnonzero(sizes > 512).tolist():
        inside = np.flatnonzero(settled[runs[k] : runs[k + 1]]) + runs[k]
        if len(inside):
            roots = np.array([union.find(i) for i in inside.tolist()])
            names, counts = np.unique(roots, return_counts=True)
            lone = np.concatenate((lone, inside[roots != names[counts.argmax()]]))
    lone = np.unique(lone)
    repeat = words_of[run_of[lone]]
    for part in np.array_split(np.arange(len(lone)), int(repeat.sum()) // (4 * JOBS) + 1):
        q, n = lone[part], repeat[part]
        if len(q):
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            compare(np.repeat(q, n), np.repeat(first_word[run_of[q]], n) + offset)
    return [(i, r) for i in range(len(fps)) if (r := union.find(i)) != i]


# ------------------------------------------------------------------ keys, links, components


def _blocks(n: int) -> list[int]:
    """Bit offsets of n nearly equal blocks."""
    return [64 * k // n for k in range(n + 1)]


def _mask(offsets: list[int], chosen: Iterable[int]) -> int:
    value = sum(((1 << (offsets[k + 1] - offsets[k])) - 1) << offsets[k] for k in chosen)
    return value - (1 << 64) if value >> 63 else value


def blocks_for(distinct: int, radius: int = RADIUS) -> int:
    """So many blocks that a key of random fingerprints holds few; any number above the radius gives the same links."""
    n = radius + 2
    while distinct >> (64 * (n - radius) // n) > 8 and n < 2 * radius:
        n += 1
    return n


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`; their components are those of all pairs within the radius."""
    import pyarrow as pa

    n = blocks or blocks_for(distinct.count(), radius)
    offsets = _blocks(n)
    masks = [_mask(offsets, chosen) for chosen in combinations(range(n), n - radius)]
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "key")
    )
    sizes = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    grid = F.ceil(F.col("size") / F.lit(cell)).cast("int")
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("g")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    cells = (
        keyed.join(sizes, ["band", "key"])
        .withColumn("g", grid)
        .withColumn("c", part)
        .select("band", "key", "fp", "c", other.alias("d"))
        .select("fp", F.xxhash64("band", "key", F.least("c", "d"), F.greatest("c", "d")).alias("cell"))
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def compared(cells_: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(fps):
                starts = np.flatnonzero(np.concatenate(([True], cells_[1:] != cells_[:-1])))
                edges = np.array(linked(fps.view(np.uint64), starts, radius), int).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(fps[edges[:, 0]]), pa.array(fps[edges[:, 1]])], schema=schema)

        for batch in batches:
            held_cell = np.concatenate((held_cell, batch.column("cell").to_numpy()))
            held_fp = np.concatenate((held_fp, batch.column("fp").to_numpy()))
            ready = int(np.searchsorted(held_cell, held_cell[-1])) if len(held_cell) else 0  # the last cell may go on
            if ready >= 4096:
                yield from compared(held_cell[:ready], held_fp[:ready])
                held_cell, held_fp = held_cell[ready:], held_fp[ready:]
        yield from compared(held_cell, held_fp)

    return cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the component's least node.

    Alternating large and small stars; each round is written to shared storage, so lineage stays short.
    """
    spark = edges.sparkSession
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Only the greater neighbours of a node go on; a centre of many is dealt to STARS tasks.
        least = least.select("a", "m", F.explode(F.sequence(F.lit(0), F.lit(STARS - 1))).alias("salt"))
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"), F.pmod(F.xxhash64("a"), F.lit(STARS)).cast("int").alias("salt"))
        large = up.join(least, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        last, now = now, stage(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(),
            "stars",
        )
        free(last)
        total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == state:
            break
        state = tuple(total)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def near_groups(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of `docs`.

    Fingerprints link when at most `radius` bits differ; a component is all that links reach, named by its
    smallest doc_id. Null text counts as empty; texts without words share fingerprint zero and link like any
    other. Repeated rows pass through; a component of null ids only has a null name. Equal fingerprints are
    compared once, however many documents share them.
    """
    marked = stage(fingerprints(docs, width), "fingerprints")
    names = _least(marked, F.col("doc_id"), radius, blocks, cell).withColumnRenamed("least", "component_id")
    return marked.join(names, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _least(marked: DataFrame, value: Column, radius: int = RADIUS, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """fp, least (the least `value` of all rows in its component) for each fingerprint of `marked`."""
    # Without a partial step per fingerprint a third of all rows would meet in one task.
    distinct = stage(marked.groupBy("fp").agg(F.min(value).alias("least_here")), "distinct")
    roots = stage(components(links(distinct.select("fp"), radius, blocks, cell)), "roots")
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_here", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_here").alias("least"))
    return named.join(least, "root").select("fp", "least")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each near-duplicate component, the smallest doc_id; all columns as they were.

    Ids need be neither unique nor present: rows are told apart by id and text. Of several texts with the smallest
    id the one whose digest is lowest stays, of equal rows one; null ids come last, so a component without any id
    is a group like any other. Null and empty texts share fingerprint zero and link like any other. An empty table
    stays empty. Rows travel as one struct, so columns may have any names; equal rows meet where they are read, before
    the texts move, once.
    """
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256))
    marked = stage(fingerprints(docs, row_key=key), "fingerprints")
    first = _least(marked, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    gone = marked.join(first, "fp").filter(F.col("row_key") != F.col("least.row_key")).select(F.col("row_key").alias("_gone_key")).distinct()
    one = docs.select(key.alias("k"), F.struct("*").alias("r")).groupBy("k").agg(F.first("r").alias("r"))
    return one.join(gone, F.col("k") == F.col("_gone_key"), "left_anti").select("r.*")
