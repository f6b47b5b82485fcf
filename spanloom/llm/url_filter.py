"""URL filter: domain and path rules first, then the log-likelihood ratio of two character language models.

URLs that a rule decides are the training set: one smoothed Markov model for allowed, one for blocked ones.
The order varies by context: the estimate in a context of two characters leans on that of one and of none as
far as the context is rare. A URL no rule decides is blocked when its mean log ratio per character falls below a
threshold calibrated on decided URLs held out of the models. Only DataFrame functions: each model is an array
over all triples of a fixed alphabet, so its size is bounded whatever the number of URLs, and scoring is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, stage

#: Fixed values of the contract: rule, verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Symbols of the models: start, end, any other character, then those kept; all digits count as 0.
ALPHABET = "^$~/.-_%=&+0abcdefghijklmnopqrstuvwxyz"
SIZE = len(ALPHABET)
#: Weight of the shorter context in the longer one's estimate, in characters.
BACKOFF = 4.0
#: Decided URLs whose MD5 begins with one of these (3 of 16) calibrate the threshold; bins of scores to a unit.
CALIBRATE, BINS = ("0", "1", "2"), 100
MICRO = 1_000_000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(raw, UPPER, UPPER.lower()), path


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _codes(host: Column, path: Column) -> Column:
    """Alphabet positions of the URL's characters, after two starts and before one end."""
    text = F.translate(F.concat(host, path), UPPER + "123456789", UPPER.lower() + "000000000")
    text = F.regexp_replace(text, "[^/._%=&+0a-z-]", "~")
    return F.transform(F.split(F.concat(F.lit("^^"), text, F.lit("$")), ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)


def _triples(codes: Column) -> Column:
    at = lambda i: F.element_at(codes, i)
    return F.transform(
        F.sequence(F.lit(3), F.greatest(F.lit(3), F.size(codes))),
        lambda i: (at(i - 2) * SIZE + at(i - 1)) * SIZE + at(i),
    )


def train(decided: DataFrame, backoff: float = BACKOFF) -> DataFrame:
    """One row, one column `ratio`: log p(c | ab, allow) - log p(c | ab, block) for every triple abc of the alphabet, in millionths,
    comma-joined: sums of integers come out the same in any order.

    `decided` has `codes` and `verdict`. Counts cover all its rows; without rows every ratio is 0.
    """
    seen = stage(decided.select("verdict", F.explode(_triples(F.col("codes"))).alias("id")).groupBy("id").agg(
        F.count_if(F.col("verdict") == "allow").cast("double").alias("allow"),
        F.count_if(F.col("verdict") == "block").cast("double").alias("block"),
    ), "url-triples")
    grid = decided.sparkSession.range(SIZE**3).join(seen, "id", "left").fillna(0.0)
    grid = grid.select("id", (F.col("id") / SIZE).cast("long").alias("ab"), (F.col("id") % (SIZE * SIZE)).alias("bc"), (F.col("id") % SIZE).alias("c"), "allow", "block")
    grid = grid.withColumn("b", (F.col("bc") / SIZE).cast("long"))
    for keys in ("ab", "bc", "b", "c"):
        same = Window.partitionBy(keys)
        grid = grid.withColumns({f"{k}_{keys}": F.sum(k).over(same) for k in ("allow", "block")})
    total = {k: F.lit(seen.agg(F.sum(k)).first()[0] or 0.0) for k in ("allow", "block")}

    def log_p(k: str) -> Column:
        p0 = (F.col(f"{k}_c") + 1.0) / (total[k] + float(SIZE))
        p1 = (F.col(f"{k}_bc") + backoff * p0) / (F.col(f"{k}_b") + backoff)
        return F.log((F.col(k) + backoff * p1) / (F.col(f"{k}_ab") + backoff))

    ratios = grid.select(F.struct("id", F.round((log_p("allow") - log_p("block")) * MICRO).cast("long").alias("r")).alias("x"))
    return ratios.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"].cast("string")), ",").alias("ratio"))


def _score(ratio: Column, codes: Column) -> Column:
    triples = _triples(codes)
    total = F.aggregate(triples, F.lit(0).cast("long"), lambda acc, t: acc + F.element_at(ratio, (t + 1).cast("int")))
    return total.cast("double") / (F.size(triples) * F.lit(MICRO))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of `pages`.

    The longest fitting rule decides; elsewhere rule is null and the models do. score is the mean log ratio per
    character, allow over block (0 on an empty training set). A null url, or one without `://`, has empty host
    and path and is judged by the models like any other. Without decided URLs of both verdicts to calibrate on the threshold is 0.
    Repeated rows and null ids pass through; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "url", "host", "path", rule.alias("rule"), says.alias("verdict"), _codes(F.col("host"), F.col("path")).alias("codes"))
    decided = rows.filter(F.col("rule").isNotNull())
    held = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1).isin(*CALIBRATE)
    # len(ALPHABET) ** 3 numbers, whatever the input: small enough to travel as a literal of the plan.
    ratio = F.split(F.lit(train(decided.filter(~held)).first()["ratio"]), ",").cast("array<long>")
    limit = _threshold(decided.filter(held).select("verdict", _score(ratio, F.col("codes")).alias("score"))).first()["threshold"]
    scored = rows.withColumn("score", _score(ratio, F.col("codes")))
    chosen = F.coalesce("verdict", F.when(F.col("score") < limit, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", chosen.alias("verdict"), "score")


def _threshold(scored: DataFrame) -> DataFrame:
    """One row: the bin edge below which to block, with the best balanced accuracy on `scored`; ties go to the one nearest 0.

    Bins are few whatever the input: per-character ratios of smoothed models are bounded, and so is the table.
    """
    bins = scored.groupBy(F.floor(F.col("score") * BINS).cast("long").alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block")
    )
    whole = bins.agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"), F.array_sort(F.collect_list(F.struct("bin", "allow", "block"))).alias("bins"))
    edges = whole.select("all_allow", "all_block", "bins", F.explode_outer("bins").alias("edge"))
    below = lambda k: F.aggregate(F.filter("bins", lambda x: x["bin"] < F.col("edge.bin")), F.lit(0).cast("long"), lambda a, x: a + x[k])
    gain = F.try_divide(below("block"), F.col("all_block")) - F.try_divide(below("allow"), F.col("all_allow"))  # null with one verdict only
    best = edges.select(F.struct(gain.alias("gain"), (-F.abs("edge.bin")).alias("near"), F.col("edge.bin").alias("bin")).alias("x")).agg(F.max("x").alias("x"))
    return best.select(F.coalesce(F.when(F.col("x.gain") > 0, F.col("x.bin") / F.lit(float(BINS))), F.lit(0.0)).alias("threshold"))
