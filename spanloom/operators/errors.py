"""Error analysis: what was missed or invented, why, and the sentences that show it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import flattened, overlaps, paragraphs, piece, rx, sentences, snippet
from .metrics import normal_list, normal_token, numeric, tolerance_score


def miss_reason(true: Column, predicted: Column) -> Column:
    """wrong label (same offsets), boundary (overlap) or leaked."""
    same = F.exists(predicted, lambda p: (p["start"] == true["start"]) & (p["end"] == true["end"]))
    near = F.exists(predicted, lambda p: overlaps(p, true))
    return F.when(same, "wrong label").when(near, "boundary").otherwise("leaked")


def span_problems(counts: DataFrame, text: str = "note_text", context: int = 30) -> DataFrame:
    """case_id, kind (missed or spurious), label, reason, start, end, shown for all spans without an exact partner.

    `counts` is what metrics.span_counts returns; both differences are row-local.
    """
    t, p, note = F.col("_t"), F.col("_p"), F.col(text)
    show = lambda s: snippet(note, s["start"], s["end"], context)
    row = lambda s, kind, reason: F.struct(F.lit(kind).alias("kind"), s["label"].alias("label"), reason.alias("reason"), s["start"].alias("start"), s["end"].alias("end"), show(s).alias("shown"))
    missed = F.transform(F.array_except(t, p), lambda s: row(s, "missed", miss_reason(s, p)))
    spurious = F.transform(F.array_except(p, t), lambda s: row(s, "spurious", F.lit(None).cast("string")))
    return counts.select("case_id", F.explode(F.concat(missed, spurious)).alias("x")).select("case_id", "x.*")


def evidence(text: Column, canonical: Column, limit: int = 2, field: str | None = None) -> Column:
    """Up to `limit` sentences with the most words of the name, at least two of them if it has two long ones.

    Without any, and with a field, the lines that open as a section of that field do: an abbreviation or a brand
    shares no word with the canonical name.
    """
    parts = F.split(canonical, "_")
    long = F.filter(parts, lambda w: F.length(w) > 3)
    words = F.when(F.size(long) > 0, long).otherwise(parts)
    need = F.least(F.lit(2), F.size(words))
    hits = lambda s: F.size(F.filter(words, lambda w: F.regexp_like(F.lower(s), F.concat(F.lit(r"\b"), w))))
    found = F.filter(F.transform(sentences(text), lambda s, i: F.struct((-hits(s)).alias("rank"), i.alias("i"), s.alias("s"))), lambda x: -x["rank"] >= need)
    best = F.transform(F.slice(F.array_sort(found), 1, limit), lambda x: flattened(x["s"]))
    if field is None:
        return best
    opens = rx(rf"\A(?s:.{{0,{v.SECTION_WITHIN - 1}}}?)\b(?:" + "|".join(v.SECTION_WORDS[field]) + ")", True)
    sections = F.transform(F.filter(paragraphs(text), lambda s: s.rlike(opens)), lambda s: F.concat(F.lit("(section) "), flattened(s)))
    return F.when(F.size(best) > 0, best).otherwise(F.slice(sections, 1, limit))


def cue_sentences(text: Column, pattern: str, limit: int = 2) -> Column:
    return F.slice(F.filter(sentences(text), lambda s: s.rlike(rx(pattern, True))), 1, limit)


def list_problems(cases: DataFrame, field: str, text: str = "note_text", true: str = "truth", pred: str = "prediction") -> DataFrame:
    """case_id, kind (missing or extra), value, evidence."""
    t, p = normal_list(F.col(f"{true}.{field}")), normal_list(F.col(f"{pred}.{field}"))
    tag = lambda values, kind: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    rows = cases.select("case_id", F.col(text).alias("_text"), F.explode(F.concat(tag(F.array_except(t, p), "missing"), tag(F.array_except(p, t), "extra"))).alias("x"))
    return rows.select("case_id", "x.*", evidence(F.col("_text"), F.col("x.value"), field=field if field in v.SECTION_WORDS else None).alias("evidence"))


def numeric_problems(cases: DataFrame, true: str = "truth", pred: str = "prediction") -> DataFrame:
    """case_id, field, kind (invented, missing, off), error for all numbers that are not within tolerance."""
    out = []
    for f, tolerance in v.TOLERANCE.items():
        t, p = F.col(f"{true}.{f}"), F.col(f"{pred}.{f}")
        kind = F.when(numeric(t).isNull(), "invented").when(numeric(p).isNull(), "missing").otherwise("off")
        out.append(F.when(tolerance_score(t, p, tolerance) < 1, F.struct(F.lit(f).alias("field"), kind.alias("kind"), (numeric(p) - numeric(t)).alias("error"))))
    return cases.select("case_id", F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("x")).select("case_id", "x.*")


def category_problems(cases: DataFrame, true: str = "truth", pred: str = "prediction") -> DataFrame:
    out = []
    for f in ("smoking_status", "allergy"):
        t, p = normal_token(F.col(f"{true}.{f}")), normal_token(F.col(f"{pred}.{f}"))
        out.append(F.when(t != p, F.struct(F.lit(f).alias("field"), t.alias("expected"), p.alias("got"))))
    return cases.select("case_id", F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("x")).select("case_id", "x.*")


def summary(problems: DataFrame, keys: tuple[str, ...], examples: int = 3) -> DataFrame:
    """Counts by keys, most first, and the ids of the first examples."""
    per = Window.partitionBy(*keys).orderBy("case_id")
    some = problems.withColumn("_i", F.row_number().over(per))
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_i") <= examples, F.col("case_id")))).alias("examples")).orderBy(F.desc("n"), *keys)


def matched_text(text: Column, span: Column) -> Column:
    return piece(text, span["start"], span["end"])
