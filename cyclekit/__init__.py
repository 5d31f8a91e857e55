"""cyclekit: on/off cycle analytics on Spark.

Main entry points (all DataFrame in, DataFrame out):
  operators.series.SeriesSpec / with_position / block_scan / with_halo  - ordered-series layout
  plans.build.build_dataset                                             - feature build (ML7)
  operators.control.replay / cycle_outcomes                             - batch back-test (C5)
  operators.metrics.*                                                   - error, safety, energy KPIs
  streaming.control.control_stream                                      - live control signal (ST1)
"""
from .operators.series import SeriesSpec, block_scan, with_halo, with_position  # noqa: F401
from .plans.build import build_dataset, cycle_table  # noqa: F401

__version__ = "0.1.0"
