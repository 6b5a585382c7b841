"""Expressions over score rows: ratios, agreement, rounding, sentences, number text."""
from pyspark.sql import Column, functions as F

# Numeric code of every agreement class; unknown classes get the code of `neither`.
AGREEMENT_CODES = {
    "reference": 0,
    "neither": 1,
    "driftlens_only": 2,
    "mcddd_only": 3,
    "both": 4,
    "mcddd_missing": 5,
}
ABRUPT_RATIO = 1.3


def ratio(score: Column, threshold: Column, digits: int | None = 4) -> Column:
    value = F.try_divide(score, F.when(threshold != 0, threshold))
    return value if digits is None else F.round(value, digits)


def _alarm_pair(first: Column, second: Column, both: str, neither: str) -> Column:
    return (
        F.when(first & second, both).when(first, "driftlens_only").when(second, "mcddd_only").otherwise(neither)
    )


def classify_agreement(is_reference: Column, first_alarm: Column, second_alarm: Column) -> Column:
    first, second = F.coalesce(first_alarm, F.lit(False)), F.coalesce(second_alarm, F.lit(False))
    return (
        F.when(F.coalesce(is_reference, F.lit(False)), "reference")
        .when(second_alarm.isNull(), "mcddd_missing")
        .otherwise(_alarm_pair(first, second, "both", "neither"))
    )


def alarm_overlap(first_alarm: Column, second_alarm: Column) -> Column:
    """Evaluation vocabulary: a missing alarm counts as no alarm."""
    first, second = F.coalesce(first_alarm, F.lit(False)), F.coalesce(second_alarm, F.lit(False))
    return _alarm_pair(first, second, "both_alarm", "both_no_alarm")


def agreement_code(agreement: Column) -> Column:
    pairs = [F.lit(part) for item in AGREEMENT_CODES.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), agreement), F.lit(AGREEMENT_CODES["neither"]))


def fixed(value: Column, digits: int) -> Column:
    """Text with fixed decimals; ties are decided on the exact binary value."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits if digits else "0"))


def sig(value: Column, digits: int = 6) -> Column:
    """Round to significant digits (fixed decimals would flatten very small scores)."""
    pattern = "0." + "0" * (digits - 1) + "E0"
    return F.call_function("format_number", value, F.lit(pattern)).cast("double")


def throughput(posts: Column, latency_ms: Column) -> Column:
    return F.coalesce(F.when(latency_ms > 0, posts / (latency_ms / F.lit(1000.0))), F.lit(0.0))


def change_type(first_ratio: Column, second_ratio: Column) -> Column:
    abrupt = F.coalesce(first_ratio > ABRUPT_RATIO, F.lit(False)) | F.coalesce(second_ratio > ABRUPT_RATIO, F.lit(False))
    return F.when(abrupt, "abrupt").otherwise("gradual")


# The sentences of the detector rationale.
RATIONALE_BOTH = (
    "Both detectors agreed on drift. DriftLens FDD score (%s) exceeded its threshold by %s%%, "
    "while MCD-DD discrepancy (%s) exceeded its threshold by %s%%."
)
RATIONALE_FIRST_ONLY = (
    "DriftLens alarmed (ratio: %s) due to cumulative distribution shift away from the fixed %s baseline. "
    "MCD-DD did not alarm (ratio: %s <= 1.0) because its %d-window rolling context adapts to gradual transitions."
)
RATIONALE_SECOND_ONLY = (
    "MCD-DD alarmed (ratio: %s) due to high discrepancy against its immediate contrastive context windows. "
    "DriftLens remained quiet (ratio: %s <= 1.0) because the sample distribution remained within its "
    "conservative p99 baseline boundary."
)
RATIONALE_NEITHER = "Neither detector observed significant distribution movement beyond normal random variation."


def rationale(baseline: str = "April 2020", context_windows: int = 10) -> Column:
    """Sentence for a compared row (`driftlens_*` and `mcddd_*` columns)."""
    first, second = F.coalesce("driftlens_alarm", F.lit(False)), F.coalesce("mcddd_alarm", F.lit(False))
    first_ratio = F.coalesce("driftlens_ratio", F.lit(0.0))
    second_ratio = F.coalesce("mcddd_ratio", F.lit(0.0))

    def excess(r):
        return fixed((r - 1) * 100, 1)

    two = [fixed(first_ratio, 2), fixed(second_ratio, 2)]
    return (
        F.when(first & second, F.format_string(RATIONALE_BOTH, fixed(F.col("driftlens_score"), 4), excess(first_ratio),
                                               fixed(F.col("mcddd_score"), 4), excess(second_ratio)))
        .when(first, F.format_string(RATIONALE_FIRST_ONLY, two[0], F.lit(baseline), two[1], F.lit(context_windows)))
        .when(second, F.format_string(RATIONALE_SECOND_ONLY, two[1], two[0]))
        .otherwise(F.lit(RATIONALE_NEITHER))
    )


def float_text(value: Column) -> Column:
    """Shortest decimal text, plain between 1e-4 and 1e16 and with a two-digit exponent outside."""
    size, text = F.abs(value), value.cast("string")
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    scientific = F.regexp_replace(F.regexp_replace(text, r"(\.0)?E", "e"), r"e-([0-9])$", "e-0$1")
    scientific = F.regexp_replace(scientific, r"e([0-9])", "e+$1")
    return (
        F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )
