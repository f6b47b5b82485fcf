"""Nine features of a readmission model as columns; fixed scales, so no site's statistics leak into another's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name order of the vector.
FEATURES = ("age", "atrial_fibrillation", "chronic_kidney_disease", "heart_failure", "hemoglobin", "lvef", "lvef_missing", "n_medications", "prior_admissions_12m")


def safe_number(value: Column, default: float) -> Column:
    """A finite double, else the default (null, unparsable, NaN, infinite)."""
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == F.lit(float("inf"))), F.lit(float(default))).otherwise(n)


def scaled(value: Column, typical: float, step: float) -> Column:
    return F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (safe_number(value, typical) - typical) / step))


def with_features(cases: DataFrame, structured: str = "structured_features", record: str = "extracted_clinical_data") -> DataFrame:
    """`cases` with a column for each feature. A missing LVEF is 0 and flagged."""
    s, r = (lambda k: F.col(f"{structured}.{k}")), (lambda k: F.col(f"{record}.{k}"))
    has = lambda d: F.coalesce(F.array_contains(r("diagnoses"), d), F.lit(False)).cast("double")
    count = F.when(r("medications").isNull(), 0).otherwise(F.size(r("medications")))
    return cases.withColumns(
        {
            "age": scaled(s("age_years"), 60, 15),
            "atrial_fibrillation": has("atrial_fibrillation"),
            "chronic_kidney_disease": has("chronic_kidney_disease"),
            "heart_failure": has("heart_failure"),
            "hemoglobin": scaled(r("hemoglobin_g_dl"), 13, 2),
            "lvef": scaled(r("lvef_percent"), 55, 10),
            "lvef_missing": r("lvef_percent").isNull().cast("double"),
            "n_medications": F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (count - 3) / F.lit(2.0))),
            "prior_admissions_12m": F.least(safe_number(s("prior_admissions_12m"), 0), F.lit(5.0)) / 2.0,
        }
    )


def vector(keep: tuple[str, ...] = FEATURES) -> Column:
    """The kept features in order, and a constant 1 for the intercept."""
    return F.array(*[F.col(k).cast("double") for k in sorted(keep)], F.lit(1.0))


def simple_vector(structured: str = "structured_features", site: str = "hospital_id", sites: tuple[str, ...] = ()) -> Column:
    """The structured fields as they are and the site as indicator columns, for comparison."""
    s = lambda k: F.col(f"{structured}.{k}")
    fields = [safe_number(s(k), 0) for k in ("age_years", "prior_admissions_12m", "length_of_stay_days")]
    flags = [(s("sex") == "male").cast("double"), s("emergency_admission").cast("double"), *[(F.col(site) == x).cast("double") for x in sites]]
    return F.array(*fields, *[F.coalesce(f, F.lit(0.0)) for f in flags], F.lit(1.0))
