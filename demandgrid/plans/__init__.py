"""The registered reports."""

from demandgrid.plans import distribution_reports, effect_reports, feature_reports, group_reports, series_reports, table_reports
from demandgrid.plans.catalog import REPORTS

__all__ = [
    "REPORTS", "distribution_reports", "effect_reports", "feature_reports", "group_reports", "series_reports", "table_reports",
]
