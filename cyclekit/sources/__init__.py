from .readers import read_months, read_sensor_csv  # noqa: F401
from .sinks import append_audit, upsert_metrics, write_features  # noqa: F401
