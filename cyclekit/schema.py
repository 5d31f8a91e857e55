"""Data contracts: fixed values, feature lists and declared schemas.

Everything under "Fixed values" must equal the source system's constants for
results to agree; they are stated here once, in natural order."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must match the source system exactly)
# ---------------------------------------------------------------------------
SENTINEL_VALUE = -999
AERATION_CURRENT_THRESHOLD = 3.0
NO3_ABSOLUTE_THRESHOLD = 20.0
NO3_SPIKE_WINDOW = 5
NO3_SPIKE_STD_THRESHOLD = 5.0
STEP_MINUTES = 10

QUALITY_REACTORS = ["반응조 A", "반응조 B"]
CURRENT_REACTORS = ["MOP-202A 포기기", "MOP-202B 포기기"]
REACTOR_NAME_MAP = {"MOP-202A 포기기": "반응조A", "MOP-202B 포기기": "반응조B"}
VALID_REACTORS = ["반응조A", "반응조B"]

SENTINEL_COLS = ["nh4", "ph"]
INTERP_COLS = ["nh4", "no3", "ph"]

QUALITY_HEADER = ["계측기명", "수집시간", "nh4", "_unnamed", "no3", "ph", "temp",
                  "toc", "ss", "pump_remote", "pump_run", "pump_fault",
                  "valve_remote", "valve_open", "valve_close", "s_can_fail"]
CURRENT_HEADER = ["계측기이름", "수집시간", "온도", "진동", "상전류(R)",
                  "상전류(S)", "상전류(T)", "상전압(R)", "상전압(S)", "상전압(T)"]
QUALITY_NAME_COL = "계측기명"
CURRENT_NAME_COL = "계측기이름"
TIME_COL = "수집시간"
CURRENT_COL = "상전류(R)"
LEGACY_TIME_FORMAT = "M'월'd'월'yy H:mm"   # source pattern month-월-day-월-year hour:minute

XGB_FEATURES = ["nh4", "no3", "ph", "temp", "상전류(R)", "nh4_no3_ratio", "do_saturation",
                "nh4_diff", "no3_diff", "ph_diff", "nh4_rolling_mean", "nh4_decay_rate",
                "hour_sin", "hour_cos", "weekday", "reactor"]
XGB_MONOTONE_CONSTRAINTS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0)
XGB_TARGET = "cycle_runtime"
XGB_FORBIDDEN = {"elapsed_time", "T_remaining", "current_aeration", "cycle_runtime"}

LSTM_FEATURES = ["nh4", "no3", "ph", "temp", "상전류(R)", "nh4_no3_ratio", "do_saturation",
                 "nh4_diff", "no3_diff", "ph_diff", "nh4_rolling_mean", "nh4_decay_rate",
                 "hour_sin", "hour_cos", "weekday", "elapsed_time"]
LSTM_TARGET = "T_remaining"
LSTM_FORBIDDEN = {"cycle_runtime", "current_aeration", "T_remaining"}

WATER_QUALITY_FEATURES = {"nh4", "no3", "nh4_diff", "no3_diff", "nh4_no3_ratio",
                          "nh4_decay_rate", "nh4_rolling_mean"}

WINDOW_SIZE = 7
LSTM_WINDOW_THRESHOLD = 60          # (WINDOW_SIZE - 1) * 10 minutes
MIN_T_SIGNAL = 10
STOP_THRESHOLD = 20
EARLY_STOP_MARGIN = 20
MAX_T_SIGNAL = 250
NH4_SAFETY_THRESHOLD = 5.0
SCALER_CLIP = 5.0
UNDERPREDICTION_MARGIN = 20

ANNUAL_TOTAL_KWH = 958_862
AERATOR_RATIO = 0.55
KRW_PER_KWH = 110
TEST_MONTH_DAYS = 31

SEPT_IMPUTE = {"temp": (23.87, 21.33), "do_saturation": (8.437, 8.843)}
IMPUTE_MONTH_SPAN_DAYS = 29

STAGES = [("0~30", 0, 30), ("31~90", 31, 90), ("91+", 91, 9999)]
LATE_STAGE_MIN = 91
TARGETS = {  # metric -> (mae_target, rmse_target)
    "late_stage": (30.0, 45.0),
    "step_model": (30.0, 45.0),
    "start_model": (60.0, 75.0),
}

# Request field -> feature of the two models' contracts (P15); only the current has another name.
START_FIELDS = {("current_r" if f == "상전류(R)" else f): f for f in XGB_FEATURES}
STEP_FIELDS = {("current_r" if f == "상전류(R)" else f): f for f in LSTM_FEATURES}

# API input bounds: column -> (low, high); None means open on that side.
INPUT_BOUNDS = {
    "nh4": (0.0, 100.0),
    "no3": (0.0, 100.0),
    "ph": (0.0, 14.0),
    "temp": (0.0, 40.0),
    "current_r": (0.0, None),
    "hour_sin": (-1.0, 1.0),
    "hour_cos": (-1.0, 1.0),
    "weekday": (0, 6),
}

# ---------------------------------------------------------------------------


def aerator_kwh_per_min() -> float:
    return ANNUAL_TOTAL_KWH * AERATOR_RATIO / 365 / 1440


@dataclass(frozen=True)
class FeatureSpec:
    """Immutable feature contract: ordered features, target, forbidden set and
    (optional) monotone constraints aligned with the features."""
    name: str
    features: tuple[str, ...]
    target: str
    forbidden: frozenset[str]
    monotone: tuple[int, ...] | None = None
    extra: dict = field(default_factory=dict, compare=False)

    def violations(self) -> list[str]:
        out = []
        leaks = sorted(set(self.features) & set(self.forbidden))
        if leaks:
            out.append(f"leakage: {leaks}")
        if len(set(self.features)) != len(self.features):
            out.append("duplicate features")
        if self.monotone is not None and len(self.monotone) != len(self.features):
            out.append(f"constraints length {len(self.monotone)} != features {len(self.features)}")
        return out

    def assert_valid(self, schema: T.StructType | None = None) -> None:
        problems = self.violations()
        if schema is not None:
            missing = [c for c in (*self.features, self.target) if c not in schema.fieldNames()]
            if missing:
                problems.append(f"missing columns: {missing}")
        if problems:
            raise ValueError(f"{self.name}: " + "; ".join(problems))


CYCLE_SPEC = FeatureSpec("cycle_start", tuple(XGB_FEATURES), XGB_TARGET,
                         frozenset(XGB_FORBIDDEN), XGB_MONOTONE_CONSTRAINTS)
STEP_SPEC = FeatureSpec("step", tuple(LSTM_FEATURES), LSTM_TARGET, frozenset(LSTM_FORBIDDEN))


def _str_fields(names):
    return [T.StructField(n, T.StringType(), True) for n in names]


QUALITY_NUMERIC = {"nh4", "no3", "ph", "temp"}
QUALITY_SCHEMA = T.StructType([
    T.StructField(n, T.DoubleType() if n in QUALITY_NUMERIC else T.StringType(), True)
    for n in QUALITY_HEADER])
CURRENT_SCHEMA = T.StructType([
    T.StructField(n, T.StringType() if n in (CURRENT_NAME_COL, TIME_COL) else T.DoubleType(), True)
    for n in CURRENT_HEADER])

AUDIT_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("cycle_id", T.StringType()),
    T.StructField("reactor", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in
      ["nh4", "no3", "ph", "temp", "current_r", "nh4_no3_ratio", "do_saturation",
       "nh4_diff", "no3_diff", "ph_diff", "nh4_rolling_mean", "nh4_decay_rate",
       "hour_sin", "hour_cos"]],
    T.StructField("weekday", T.IntegerType()),
    T.StructField("elapsed_time", T.IntegerType()),
    T.StructField("t_signal", T.IntegerType()),
    T.StructField("should_continue", T.BooleanType()),
    T.StructField("was_clamped", T.BooleanType()),
    T.StructField("mode", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("section", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("updated_at", T.TimestampType()),
])
