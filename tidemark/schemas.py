"""Explicit schemas of everything read from files or topics."""
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


MESSAGE = _struct(post_id=StringType(), timestamp=StringType(), text=StringType(), source=StringType())

WINDOW = _struct(
    window_id=LongType(), window_start=StringType(), window_end=StringType(),
    texts=ArrayType(StringType()), timestamps=ArrayType(StringType()), post_ids=ArrayType(StringType()),
    post_count=IntegerType(), part=IntegerType(), part_offset=LongType(),
)

VECTOR = _struct(window_id=LongType(), post_id=StringType(), embedding=ArrayType(FloatType()))

# Superset of what detectors and post-processing write; `normalise_scores` resolves the alternatives.
SCORE_INPUT = _struct(
    window_id=LongType(), window_start=StringType(), timestamp=StringType(),
    driftlens_score=DoubleType(), driftlens_alarm=BooleanType(),
    threshold=DoubleType(), driftlens_threshold=DoubleType(),
    mcddd_score=DoubleType(), mcddd_alarm=BooleanType(), mcddd_threshold=DoubleType(), mcddd_lag=IntegerType(),
    n_posts=LongType(), post_count=LongType(), n_used=LongType(), is_reference=BooleanType(),
    agreement=StringType(),
    processing_latency_ms=DoubleType(), throughput_posts_per_sec=DoubleType(),
    cpu_pct=DoubleType(), mem_mb=DoubleType(), pipeline=StringType(),
)

_POINT = _struct(position=IntegerType(), window_id=LongType(), window_start=StringType())
_VOLUME = _struct(position=IntegerType(), window_id=LongType(), window_start=StringType(), factor=IntegerType())
GROUND_TRUTH = _struct(
    scenario=StringType(), n_windows=IntegerType(), n_posts=LongType(),
    ground_truth=_struct(
        concept_drift=BooleanType(), drift_start=_POINT, drift_end=_POINT, volume_change=_VOLUME,
        expected_alarm_windows=StringType(), note=StringType(),
    ),
)
