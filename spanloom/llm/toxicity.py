"""Toxicity by maximum-scoring segments: token log-odds, every significant passage, extreme-value calibration.

Token log-odds come from labelled training documents with nested Dirichlet priors: a word's rate of toxic
documents is drawn towards that of its longest shorter prefix, down to the overall rate, so unseen words of a
known stem score like the stem. A linear scan finds all maximal scoring segments of a text; the number of
segments as high as S in n background tokens is about K n exp(-lambda S) (Karlin and Altschul 1990), which turns
each into an expected count; the evidence of all significant ones is summed and mapped to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows the classifier is fitted on at most (those with the least hash of their id); they bound the nodes too.
MAX_LABELLED = 20_000
#: Words in either generation of a worker's memo.
MEMO = 60_000
#: Prefix lengths that are nodes, documents of the prior, least log-odds and z score of a
#: scoring node, and most log-odds: nested nodes see the same documents, so longer odds would count them twice.
PREFIXES, PRIOR, LEAST_ODDS, LEAST_Z, MOST_ODDS = (4, 5, 6, 7, 8), 2.0, 1.5, 4.0, 6.0
#: Expected count in a background text below which a segment is significant; one label in so many calibrates.
SIGNIFICANT, CALIBRATE = 0.05, 4


def nodes_of(word: str) -> list[str]:
    """The word itself, marked by a final blank, and its prefixes, longest first."""
    return [word + " ", *[word[:k] for k in reversed(PREFIXES) if len(word) >= k]]


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    neutral: float = -0.05  # of a token without a scoring node
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    weights: tuple[float, float] = (-3.0, 1.0)

    def __post_init__(self) -> None:
        self._memo: dict[str, float] = {}
        self._older: dict[str, float] = {}

    def _odds_of(self, word: str) -> float:
        score = self._older.get(word)
        if score is None:
            score = next((self.odds[x] for x in nodes_of(word) if x in self.odds), 0.0)
        if len(self._memo) >= MEMO:  # words met again while a generation fills outlive the other
            self._older, self._memo = self._memo, {}
        self._memo[word] = score
        return score

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """Number of tokens, and (position, log-odds) of those that score."""
        out, n = [], 0
        for n, m in enumerate(WORD.finditer((text or "").lower()), 1):
            word = m[0]
            score = self._memo.get(word)
            if score is None:
                score = self._odds_of(word)
            if score:
                out.append((n - 1, score))
        return n, out

    def expected(self, n: int, score: float) -> float:
        """Log of the number of segments this high in a background text of n tokens."""
        return math.log(self.scale * max(n, 1)) - self.rate * score

    def judged(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability of toxic, and the significant passages (first word, end word, score)."""
        n, hits = self.hits(text)
        found = [s for s in segments(hits, self.neutral) if self.expected(n, s[2]) < math.log(SIGNIFICANT)]
        return self.probability(self.evidence(n, found)), found

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        return math.log1p(sum(math.log(SIGNIFICANT) - self.expected(n, s[2]) for s in found))

    def probability(self, evidence: float) -> float:
        z = self.weights[0] + self.weights[1] * evidence
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def segments(hits: list[tuple[int, float]], neutral: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa 1999) as (start, end, score); tokens between hits score `neutral`.

    Each segment kept points to the nearest one before it with a lower sum on its left, so the search for that one
    follows pointers over what can be no answer, and the scan takes time in proportion to the hits.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, pointer
    total, at = 0.0, 0
    for position, score in hits:
        total += neutral * (position - at)
        start, before = position, total
        total += score
        at = position + 1
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                break
            start, _, before, _, up = kept[j]
            del kept[j:]
            j = up
        kept.append((start, at, before, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in kept]


def _fitted_odds(rows: list[tuple[str, int, int]], n0: int, n1: int) -> dict[str, float]:
    """Log-odds of the nodes that score: significant themselves, or below one that is."""
    base = n1 / max(n0 + n1, 1)
    rates: dict[str, float] = {}
    out: dict[str, float] = {}
    logit = lambda p: math.log(p / (1 - p))
    for node, c0, c1 in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        parent = next((rates[node[:k]] for k in range(len(node) - 1, 0, -1) if node[:k] in rates), base)
        rate = rates[node] = (c1 + PRIOR * parent) / (c0 + c1 + PRIOR)
        odds = logit(min(max(rate, 1e-9), 1 - 1e-9)) - logit(min(max(base, 1e-9), 1 - 1e-9))
        expected = (c0 + c1) * base
        if odds >= LEAST_ODDS and (c1 - expected) / math.sqrt(max(expected, 1e-9)) >= LEAST_Z:
            out[node] = min(odds, MOST_ODDS)
        elif any(node[:k] in out for k in range(1, len(node))):
            out[node] = min(odds, MOST_ODDS) if odds >= LEAST_ODDS else 0.0
    return out


def _rate_of(scores: Counter, tokens: int, neutral: float) -> float:
    """lambda > 0 with mean of exp(lambda * score) over background tokens 1."""
    hits = sum(scores.values())
    mean = lambda x: sum(c * math.exp(min(x * s, 600.0)) for s, c in scores.items()) + (tokens - hits) * math.exp(x * neutral) - tokens
    low, high = 1e-3, 20.0
    if not tokens or mean(low) >= 0 or mean(high) <= 0:
        return 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 0 else (low, middle)
    return low


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the labelled documents whose crc32(doc_id as text) mod 5 is not 0, at most `max_labelled` of them.

    Token counts are per document, from whole texts. Rows without id or text count as they are: no id, no label; no
    text, no words. Labels other than 0 and 1 are passed over, of contradicting labels of one id 1 holds, and every row
    of `docs` with a labelled id is learnt from. Other columns of either table are ignored, whatever their names.
    Without both labels among the learnt rows, as with an empty table, the model calls nothing toxic.
    """
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE)))
    rows = sample.collect()  # max_labelled rows at most
    if not rows:
        return Model()
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], sample.schema))
    of = docs.select("doc_id", "text").join(sample.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).select("text", "y", "part")
    counted = pa.schema([("node", pa.string()), ("c0", pa.int64()), ("c1", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(found[0].keys() | found[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[x] for x in names], pa.int64()) for c in found]], schema=counted)
            for c in found:
                c.clear()
            return batch

        for batch in batches:
            for cell, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                words = set(WORD.findall((cell.as_py() or "").lower()))
                found[y].update({x for w in words for x in nodes_of(w)} | {""})
                if len(found[0]) + len(found[1]) > 400_000:
                    yield flush()
        yield flush()

    fitted = of.filter("part > 0").drop("part").mapInArrow(count, "node string, c0 long, c1 long").groupBy("node").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    fitted = stage(fitted, "toxic-nodes")
    rows_of = lambda df: [(r["node"], r["c0"], r["c1"]) for r in df.collect()]  # noqa: E731  no more than the labelled rows hold
    twice = rows_of(fitted.filter("c1 >= 2 or node = ''"))  # what can score by itself, and with it all its prefixes
    n0, n1 = next(((c0, c1) for node, c0, c1 in twice if node == ""), (0, 0))
    if not n0 or not n1:
        return Model()
    twice = [r for r in twice if r[0]]
    scoring = [x for x, odds in _fitted_odds(twice, n0, n1).items() if odds]
    # Rarer words below a scoring prefix have a say of their own: clean ones do not score as the prefix does.
    prefix = F.lit(False)
    for k in PREFIXES:
        if same := [x for x in scoring if len(x) == k and x[-1] != " "]:
            prefix = prefix | ((F.length("node") > k) & F.substring("node", 1, k).isin(same))
    below = rows_of(fitted.filter(F.col("c1") < 2).filter(prefix))
    model = Model(_fitted_odds(twice + below, n0, n1))
    seen = pa.schema([("y", pa.int32()), ("n", pa.int64()), ("at", pa.list_(pa.int64())), ("s", pa.list_(pa.float64()))])

    def hit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.hits(cell.as_py()) for cell in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("y").to_pylist(), pa.int32()), pa.array([n for n, _ in got], pa.int64()), pa.array([[i for i, _ in h] for _, h in got], pa.list_(pa.int64())), pa.array([[s for _, s in h] for _, h in got], pa.list_(pa.float64()))],
                schema=seen,
            )

    held = of.filter("part = 0").drop("part").mapInArrow(hit, "y int, n long, at array<long>, s array<double>").collect()
    return _calibrated(model, [(r["y"], r["n"], list(zip(r["at"], r["s"]))) for r in held])


def _calibrated(model: Model, held: list[tuple[int, int, list[tuple[int, float]]]]) -> Model:
    tokens, hits = [0, 0], [0, 0]
    background: Counter = Counter()
    for y, n, found in held:
        tokens[y] += n
        hits[y] += len(found)
        if not y:
            background.update(s for _, s in found)
    share = [(hits[y] + 0.5) / (tokens[y] + 1.0) for y in (0, 1)]
    model.neutral = min(-1e-3, math.log((1 - share[1]) / (1 - share[0])))
    model.rate = _rate_of(background, tokens[0], model.neutral)
    scores = sorted(s[2] for y, _, found in held if not y for s in segments(found, model.neutral))
    least = scores[len(scores) // 2] if scores else 0.0
    model.scale = (sum(s >= least for s in scores) + 0.5) * math.exp(model.rate * least) / max(tokens[0], 1)
    x = np.array([model.evidence(n, [s for s in segments(found, model.neutral) if model.expected(n, s[2]) < math.log(SIGNIFICANT)]) for _, n, found in held])
    y = np.array([v for v, _, _ in held], float)
    design, w = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    for _ in range(50):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - 0.05 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2), grad)
        w = w + np.clip(step, -5, 5)
    model.weights = (float(w[0]), float(w[1]))
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for each row of `docs`.

    held_out: crc32(doc_id as text) mod 5 is 0 (a null id counts as empty text). score is the probability of
    toxic, predicted is 1 from 0.5 on, passages lists the significant segments as first word, end word
    (exclusive) and log-odds. A null or empty text has no passage and the score of none. Repeated rows pass
    through; only the text enters the score.
    """
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("odds", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", passage)])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.judged(cell.as_py()) for cell in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([p for p, _ in got], pa.float64()), pa.array([int(p >= 0.5) for p, _ in got], pa.int32()), pa.array([[{"start": a, "end": b, "odds": s} for a, b, s in f] for _, f in got], passage)],
                schema=schema,
            )

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")).mapInArrow(
        work, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start:long,end:long,odds:double>>"
    )


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of `docs` not predicted toxic, all columns as they were; the text is judged where it is read, nothing moves.

    Null and empty texts are judged like any text without hits, rows with a null id or a repeated one each by their
    own text. An empty table stays empty; no column is added, so none can clash.
    """
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        return pa.array([model.judged(cell.as_py())[0] < 0.5 for cell in text], pa.bool_())

    return docs.filter(clean(F.col("text")))
