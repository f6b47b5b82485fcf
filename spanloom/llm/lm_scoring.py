"""Language-model scores: exact unigram counts, and a log-bilinear neural model trained with noise-contrastive estimation.

The neural model predicts classes from the two preceding ones: the most frequent words each have one, the end of a
text has one, and all other words share an eighth as many by how they end. Within a shared class a word has its
discounted relative frequency, and all its words unseen in training together what the discount left (Good and Turing),
so the probabilities of the words seen, the end, and "unseen" of each shared class sum to one after every context.

Counts are exact over all training texts, and the classes grow with the square root of the number of distinct words.
Training is data-parallel: rows are dealt to shards by a hash of what they hold, so many as the number of tokens asks
for; each shard starts from the same parameters and makes one pass in numpy, and the results are averaged by token
count in a tree, so what meets in one place is FAN_IN models, and the model does not depend on the number of tasks.
Probabilities are normalised by batched matrix products over the
distinct contexts of a batch.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Classes of the neural model, width of its vectors, words of context, noise words per batch, tokens per batch, step size.
CLASSES, WIDTH, CONTEXT, NOISE, BATCH, STEP = 512, 24, 2, 32, 8192, 0.05
#: Distinct words up to which CLASSES classes are enough; with four times as many there are twice the classes.
TYPES = 1 << 21
#: Contexts of a matrix product when scoring.
BLOCK = 1024
#: Classes with a word of their own for each class that others share, and the bytes at a word's end that choose it.
OWN, ENDING = 8, 2
#: Pairs of classes up to which a worker holds the norm of each context; beyond, those of the contexts at hand are computed.
NORMS = 1 << 23
#: Training tokens of a shard, and models averaged in one place.
SHARD, FAN_IN = 2_000_000, 32
#: Most frequent words whose counts every worker holds; counts of all others are joined. A bound, not a cut: both ways give the same.
HELD = 400_000
#: Key of the end of a text among the words; no word holds a line feed.
END = "\n"
_END = END.encode()
#: Distinct words that a counting task holds before it hands them on.
FLUSH = 400_000
HELD_OUT = "crc32(coalesce(cast(doc_id as string), '')) % 7 = 2"


def _words(text: str | None) -> list[bytes]:
    """Words of the contract in UTF-8, A-Z lower-cased: bytes know no other letters and just the six separators."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training rows of `docs`, the end of each text included under END.

    Counted within tasks first; what a task holds is bounded by FLUSH words, whatever it reads.
    """
    import pyarrow as pa

    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(found.items())
            found.clear()
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in part], pa.string()), pa.array([k for _, k in part], pa.int64())], schema=schema)

        for batch in batches:
            for cell in batch.column("text"):
                found.update(_words(cell.as_py()))
            found[_END] += batch.num_rows
            if len(found) > FLUSH:
                yield from flush()
        yield from flush()

    train = docs.filter(f"not ({HELD_OUT})").select("text")
    return train.mapInArrow(work, "word string, n long").filter("n > 0").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    tokens: int  # N
    types: int  # V
    head: dict[bytes, int]  # word -> class; the end is class 0, the shared ones follow
    counts: dict[bytes, int]  # of the words held
    shared: list[int]  # training tokens of each shared class
    unseen: list[float]  # share of each for words never seen
    least: int | None  # all words with this count or more are held

    @property
    def classes(self) -> int:
        return len(self.head) + len(self.shared)


class Endings(dict):
    """Last bytes of a word -> its shared class, as they are met; there are no more than endings of ENDING bytes."""

    def __init__(self, shared: int):
        super().__init__()
        self.shared = shared

    def __missing__(self, ending: bytes) -> int:
        self[ending] = k = 1 + zlib.crc32(ending) % self.shared
        return k


def _classes(words: Iterable[bytes], head: dict[bytes, int], endings: Endings) -> list[int]:
    """Class of each word; 0, the end's, is none of them."""
    own = head.get
    return [own(w) or endings[w[-ENDING:]] for w in words]


def _shared_class(word: Column, shared: int) -> Column:
    """The class that Endings gives a word outside the head, less one."""
    return F.pmod(F.crc32(F.substring(F.encode(word, "utf-8"), -ENDING, ENDING)), F.lit(shared)).cast("int")


def classes_for(types: int) -> int:
    """A power of two times CLASSES."""
    return CLASSES << max(0, (math.ceil(math.log2(max(types, 1) / TYPES)) + 1) // 2)


def vocabulary(counts: DataFrame, classes: int | None = None, held: int = HELD) -> Vocabulary:
    """`counts` as word_counts gives; at most `held` words, those of the classes and the end reach the driver."""
    classes = classes or classes_for(counts.count())
    sizes = [[0, 0, 0] for _ in range(1 + max(1, classes // OWN))]  # tokens, types, types met once: of the end, and by shared class
    place = F.when(F.col("word") == END, 0).otherwise(1 + _shared_class(F.col("word"), len(sizes) - 1))
    for r in counts.groupBy(place.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect():
        sizes[r["k"]] = [r["n"], r["v"], r["once"]]
    n, v = (sum(x[i] for x in sizes) for i in range(2))
    level = F.floor(F.log2("c") * 16).cast("long")
    rows = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()
    total, least = 0, None  # the least count such that at most `held` words have it
    for r in rows:  # a few hundred levels at most
        total += r["n"]
        if total > held:
            break
        least = r["least"]
    top = [] if least is None else counts.filter(F.col("c") >= least).collect()
    known = {r["word"].encode(): r["c"] for r in top}
    most = counts.filter(F.col("word") != END).orderBy(F.desc("c"), "word").limit(classes - 2).collect()
    known |= {r["word"].encode(): r["c"] for r in most}  # words that tie at the edge of `held` too
    known |= {_END: r["c"] for r in counts.filter(F.col("word") == END).collect()}
    head = {_END: 0} | {r["word"].encode(): k for k, r in enumerate(most, len(sizes))}
    for r in most:
        of = sizes[1 + zlib.crc32(r["word"].encode()[-ENDING:]) % (len(sizes) - 1)]
        of[0], of[2] = of[0] - r["c"], of[2] - (r["c"] == 1)
    unseen = [(once + 1) / (c + once + 2) if c else 1.0 for c, _, once in sizes[1:]]
    return Vocabulary(n, v, head, known, [c for c, *_ in sizes[1:]], unseen, least)


class LogBilinear:
    """s(w | h) = b_w + q_w . sum_i C_i r_{h_i}, over classes."""

    def __init__(self, unigram: np.ndarray, width: int = WIDTH, seed: int = 0):
        rng, n = np.random.default_rng(seed), len(unigram)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.noise = unigram
        self.params = {"R": normal(n, width), "Q": normal(n, width), "C": np.stack([np.eye(width, dtype=np.float32)] * CONTEXT) * 0.5, "b": np.log(unigram).astype(np.float32)}

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, p in self.params.items():
            self.params[k] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size

    def context(self, h: np.ndarray) -> np.ndarray:
        p = self.params
        return sum(p["R"][h[:, i]] @ p["C"][i] for i in range(CONTEXT))

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], seed: int = 1) -> int:
        """One pass of noise-contrastive estimation over (contexts, classes); number of tokens."""
        rng, seen = np.random.default_rng(seed), 0
        squares = {k: np.full_like(v, 1e-6) for k, v in self.params.items()}
        n = len(self.noise)
        offset = np.log(NOISE * self.noise).astype(np.float32)
        edges = np.cumsum(self.noise)
        scatter = lambda rows, values: np.stack([np.bincount(rows, x, n) for x in values])  # noqa: E731  sums by class, a row for each dimension
        for h, w in batches:
            p, m = self.params, len(w)
            h, w = h.T.astype(np.intp), w.astype(np.intp)
            # Vectors are columns here. What is linear in them is done once for each class, not for each token.
            r = sum(np.take((p["R"] @ p["C"][i]).T, h[i], 1) for i in range(CONTEXT))
            noise = np.minimum(np.searchsorted(edges, rng.random(NOISE)), n - 1)
            target, drawn = np.take(p["Q"].T, w, 1), p["Q"][noise]
            true = np.einsum("dm,dm->m", r, target) + (p["b"] - offset)[w]
            down = drawn @ r
            down += (p["b"] - offset)[noise][:, None]
            up = (1 / (1 + np.exp(np.clip(true, -30, 30)))) / m  # d loss / d s, data
            np.clip(down, -30, 30, out=down)  # noise; NOISE words stand for NOISE draws of each token
            np.exp(np.negative(down, out=down), out=down)
            down += 1
            np.divide(np.float32(1 / m), down, out=down)
            grad = {k: np.zeros_like(v) for k, v in p.items()}
            grad["Q"] += scatter(w, up * r).T
            np.subtract.at(grad["Q"], noise, down @ r.T)
            grad["b"] += np.bincount(w, up, n)
            np.subtract.at(grad["b"], noise, down.sum(1))
            back = up * target - drawn.T @ down
            for i in range(CONTEXT):
                at = scatter(h[i], back)
                grad["C"][i] = p["R"].T @ at.T
                grad["R"] += (p["C"][i] @ at).T
            for k, g in grad.items():
                squares[k] += g * g
                p[k] += STEP * g / np.sqrt(squares[k])
            seen += m
        return seen

    def norms(self) -> np.ndarray | None:
        """Logarithm of the sum of exp s(. | h) for each context, by its two classes; None where these are too many.

        The scores of a context are those of its first class plus those of its second, so the sums of all contexts
        are one product of matrices of exponentials. None, too, where these lie too far apart for it.
        """
        n, p = len(self.noise), {k: v.astype(np.float64) for k, v in self.params.items()}
        if n * n > NORMS:
            return None
        first, second = p["R"] @ p["C"][0] @ p["Q"].T + p["b"], p["R"] @ p["C"][1] @ p["Q"].T
        most = [x.max(1, keepdims=True) for x in (first, second)]
        sums = np.exp(np.subtract(first, most[0], out=first), out=first) @ np.exp(np.subtract(second, most[1], out=second), out=second).T
        return None if sums.min() < 1e-200 else np.log(sums, out=sums) + most[0] + most[1].T

    def log10(self, h: np.ndarray, w: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
        """Normalised log10 p(w | h). Without `norms`, one matrix product for each block of distinct contexts."""
        if norms is not None:
            p, out = self.params, norms[h[:, 0], h[:, 1]]
            of = [p["R"] @ p["C"][i] for i in range(CONTEXT)]
            for at in range(0, len(w), BATCH):
                some = slice(at, at + BATCH)
                r = sum(np.take(of[i], h[some, i], 0) for i in range(CONTEXT))
                out[some] = (np.einsum("md,md->m", r, np.take(p["Q"], w[some], 0)) + p["b"][w[some]] - out[some]) / math.log(10)
            return out
        n = len(self.noise)
        code = h[:, 0].astype(np.int64) * n + h[:, 1]
        distinct, inverse = np.unique(code, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        bounds = np.searchsorted(inverse[order], np.arange(0, len(distinct) + BLOCK, BLOCK))
        out = np.empty(len(w))
        for k in range(len(bounds) - 1):
            some = distinct[k * BLOCK : (k + 1) * BLOCK]
            if not len(some):
                break
            scores = self.context(np.stack([some // n, some % n], 1)) @ self.params["Q"].T + self.params["b"]
            scores -= scores.max(1, keepdims=True)
            norm = np.log(np.exp(scores).sum(1))
            rows = order[bounds[k] : bounds[k + 1]]
            local = inverse[rows] - k * BLOCK
            out[rows] = (scores[local, w[rows]] - norm[local]) / math.log(10)
        return out


def _sequence(words: list[bytes], head: dict[bytes, int], endings: Endings) -> np.ndarray:
    """Class ids of a text and its end, after CONTEXT ends as the start."""
    ids = np.zeros(len(words) + CONTEXT + 1, np.int32)
    ids[CONTEXT:-1] = _classes(words, head, endings)
    return ids


def _contexts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([np.stack([x[CONTEXT - 1 - i : len(x) - 1 - i] for i in range(CONTEXT)], 1) for x in parts])
    return h, np.concatenate([x[CONTEXT:] for x in parts])


def _unigram(v: Vocabulary) -> np.ndarray:
    weights = np.ones(v.classes)
    for word, k in v.head.items():
        weights[k] += v.counts.get(word, 0)
    weights[1 : 1 + len(v.shared)] += v.shared
    return weights / weights.sum()


def train(docs: DataFrame, v: Vocabulary) -> LogBilinear:
    """The neural model from all training rows of `docs`."""
    import pyarrow as pa

    start = LogBilinear(_unigram(v))
    shards = max(1, -(-v.tokens // SHARD))
    shipped = docs.sparkSession.sparkContext.broadcast((Vocabulary(v.tokens, v.types, v.head, {}, v.shared, v.unseen, v.least), start.noise))
    schema = pa.schema([("shard", pa.int64()), ("n", pa.float64()), ("sum", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard stand together, in an order of their own."""
        vocab, noise = shipped.value
        endings = Endings(len(vocab.shared))

        def texts() -> Iterator[tuple[int, str | None]]:
            for batch in batches:
                for shard, cell in zip(batch.column("shard").to_pylist(), batch.column("text")):
                    yield shard, cell.as_py()

        def stream(rows: Iterable[tuple[int, str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            parts: list[np.ndarray] = []
            size = 0
            for _, text in rows:
                parts.append(_sequence(_words(text), vocab.head, endings))
                size += len(parts[-1])
                if size > 64 * BATCH:
                    yield from mixed(parts)
                    parts, size = [], 0
            if parts:
                yield from mixed(parts)

        def mixed(parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            h, w = _contexts(parts)
            order = np.random.default_rng(len(w)).permutation(len(w))  # neighbours of a text in different batches
            for at in range(0, len(w), BATCH):
                rows = order[at : at + BATCH]
                yield h[rows], w[rows]

        for shard, rows in groupby(texts(), key=lambda x: x[0]):
            model = LogBilinear(noise)
            n = model.train(stream(rows))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [float(n)], "sum": [(model.flat().astype(np.float64) * n).tobytes()]}, schema=schema)

    def add(table: pa.Table) -> pa.Table:
        n, total = _added(zip(table.column("shard").to_pylist(), table.column("n").to_pylist(), table.column("sum")))
        return pa.table({"shard": [min(table.column("shard").to_pylist()) // FAN_IN], "n": [n], "sum": [total.tobytes()]}, schema=schema)

    ddl = "shard long, n double, sum binary"
    text = docs.filter(f"not ({HELD_OUT})").select("text", F.xxhash64("doc_id", "text").alias("at"))
    text = text.withColumn("shard", F.pmod("at", F.lit(shards)))
    models = text.repartition(shards, "shard").sortWithinPartitions("shard", "at", "text").select("shard", "text").mapInArrow(work, ddl)
    while shards > FAN_IN:
        models, shards = models.groupBy(F.expr(f"shard div {FAN_IN}")).applyInArrow(add, ddl), -(-shards // FAN_IN)
    rows = models.collect()  # FAN_IN models at most
    if rows:
        n, total = _added([(r["shard"], r["n"], r["sum"]) for r in rows])
        start.load(total / n)
    return start


def _added(models: Iterable[tuple[int, float, object]]) -> tuple[float, np.ndarray]:
    """Sums of (shard, n, sum) by shard, so that the order of arrival does not matter."""
    n, total = 0.0, None
    for _, k, blob in sorted(models, key=lambda m: m[0]):
        part = np.frombuffer(blob.as_py() if hasattr(blob, "as_py") else blob)
        n, total = n + k, part if total is None else total + part
    return n, total


class Scorer:
    """What a worker needs to score texts: the model, and the terms of the words held, by their index.

    A missing word has the last index. There the terms are 0, and the class is set by the caller.
    """

    def __init__(self, v: Vocabulary, params: dict[str, np.ndarray], noise: np.ndarray, each: list[float]):
        self.lm, self.head, self.endings = LogBilinear(noise), v.head, Endings(len(v.shared))
        self.lm.params = {k: p.astype(np.float64) for k, p in params.items()}  # sums that hardly depend on the batch
        self.norms = self.lm.norms()
        counts = np.fromiter(v.counts.values(), np.float64, len(v.counts))
        self.index = {w: i for i, w in enumerate(v.counts)}.get
        self.base = np.append(np.log10(counts + 1), 0.0)
        self.classes = np.array([*_classes((w if w != _END else b"" for w in v.counts), v.head, self.endings), 1], np.int32)
        own = np.fromiter(map(v.head.__contains__, v.counts), bool, len(counts))
        within = np.array(each)[np.where(own, 0, self.classes[:-1] - 1)]
        self.inside = np.append(np.where(own, 0.0, np.log10(counts * within, where=~own, out=np.zeros(len(counts)))), 0.0)
        self.end_base, self.end_known = (math.log10(v.counts[_END] + 1), 1) if _END in v.counts else (0.0, 0)


_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, make: Callable[[], Scorer]) -> Scorer:
    """The scorer of a run, made once in each worker that takes several of its tasks; one at a time is held."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = make()
    return _SCORERS[name]


def score_documents(docs: DataFrame, classes: int | None = None, held: int = HELD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`.

    Learns from the rows not held out (crc32(doc_id as text) mod 7 is not 2; a null id counts as empty text). A
    null text counts as empty and has one token, its end. base_score is the add-one unigram log10 probability,
    score the neural model's, in which an unseen word has the probability of "unseen" in its shared class. Without
    training rows base_score is 0 and score that of the untrained model. Repeated rows pass through; an empty table
    gives an empty result; other columns are ignored, whatever their names. `classes` is what classes_for says unless given.
    """
    import pyarrow as pa

    counts = stage(word_counts(docs), "word-counts")
    v = vocabulary(counts, classes, held)
    model = train(docs, v)
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((v, model.params, model.noise))
    #: What the count of a word is multiplied with for its probability within its shared class.
    each = [(1 - u) / max(c, 1) for u, c in zip(v.unseen, v.shared)]
    tail = pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int32()), ("k", pa.int32())]))
    name = uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("neural", pa.float64()), ("tail", tail)])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(name, lambda: Scorer(*shipped.value, each))
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            parts: list[np.ndarray] = []

            def flush() -> pa.RecordBatch:
                h, w = _contexts(parts)
                lengths = np.array([len(x) - CONTEXT for x in parts])
                sums = np.add.reduceat(of.lm.log10(h, w, of.norms), np.concatenate(([0], np.cumsum(lengths)[:-1])))
                rows[5] = [float(a + b) for a, b in zip(sums, rows[5])]
                out = pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, schema)], schema=schema)
                for x in rows:
                    x.clear()
                rows[5] = []
                parts.clear()
                return out

            size = 0
            for doc_id, held_out, cell in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text")):
                words = _words(cell.as_py())
                at = np.fromiter(map(of.index, words, repeat(-1)), np.int64, len(words))
                missing = np.flatnonzero(at < 0)
                others = [words[i] for i in missing.tolist()]
                rare = [{"word": w.decode(), "tf": n, "k": of.endings[w[-ENDING:]] - 1} for w, n in Counter(others).items()]
                base, inside, n_known = float(of.base[at].sum()) + of.end_base, float(of.inside[at].sum()), len(words) - len(missing) + of.end_known
                ids = np.zeros(len(words) + CONTEXT + 1, np.int32)
                ids[CONTEXT:-1] = of.classes[at]
                ids[CONTEXT + missing] = _classes(others, of.head, of.endings)
                parts.append(ids)
                for column, value in zip(rows, (doc_id, held_out, len(words) + 1, n_known, base, inside, rare)):
                    column.append(value)
                size += len(words)
                if size > 1_000_000:
                    yield flush()
                    size = 0
            if parts:
                yield flush()

    ddl = "doc_id long, held_out boolean, n_tokens long, known long, base double, neural double, tail array<struct<word:string,tf:int,k:int>>"
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(HELD_OUT).alias("held_out"), "text")
    scored = stage(first.mapInArrow(work, ddl).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    least = 1 << 62 if v.least is None else v.least
    rest = counts.filter((F.col("c") < least) & (F.col("word") != END)).withColumnRenamed("word", "w")
    rare = scored.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.tf").alias("tf"), F.col("t.k").alias("k"))
    found = rare.join(rest, F.col("word") == F.col("w"), "left")
    tf, of_class = F.col("tf"), lambda values: F.get(F.lit(values), F.col("k"))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), tf).otherwise(0)).alias("known_2"),
        F.sum(tf * F.coalesce(F.log10(F.col("c") + 1), F.lit(0.0))).alias("base_2"),
        F.sum(tf * F.when(F.col("c").isNotNull(), F.log10(F.col("c") * of_class(each))).otherwise(of_class([math.log10(u) for u in v.unseen]))).alias("inside_2"),
    )
    joined = scored.drop("tail").join(sums, "row", "left").fillna(0, ["known_2"]).fillna(0.0, ["base_2", "inside_2"])
    per_token = math.log10(v.tokens + v.types + 1)
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("known_2")).cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base_2") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), (F.col("neural") + F.col("inside_2")).alias("score"),
    )
