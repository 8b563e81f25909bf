"""The engine's registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from steploom.operators import agreement, audit, counterfactual, detectors, experiments, intervals, prefixes, release, risk

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p3_found": intervals.p3_found,
    "p3_coverage": intervals.p3_coverage,
    "detector_triggers": detectors.detector_triggers,
    "first_triggers": detectors.first_triggers,
    "trigger_location": detectors.trigger_location,
    "detector_metrics": detectors.metrics,
    "near_f1_pairs": detectors.near_f1_pairs,
    "best_and_worst_detectors": detectors.best_and_worst,
    "detector_availability": detectors.availability,
}
ORACLES: dict[str, str] = {
    "p3_found": intervals.P3_FOUND_SQL,
    "p3_coverage": intervals.P3_COVERAGE_SQL,
    "detector_triggers": detectors.DETECTOR_TRIGGERS_SQL,
    "first_triggers": detectors.FIRST_TRIGGERS_SQL,
    "trigger_location": detectors.TRIGGER_LOCATION_SQL,
    "detector_metrics": detectors.METRICS_SQL,
    "near_f1_pairs": detectors.NEAR_F1_PAIRS_SQL,
    "best_and_worst_detectors": detectors.BEST_AND_WORST_SQL,
    "detector_availability": detectors.AVAILABILITY_SQL,
}
for _module in (audit, counterfactual, experiments, agreement, prefixes, risk, release):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
