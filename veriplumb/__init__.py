"""veriplumb: data-quality analytics expressed as Spark DataFrame plans."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_PLACES = {
    "operators.model": ("Constraint", "DatasetConstraints", "FieldConstraints", "InvalidConstraint"),
    "operators.profile": ("all_booleans", "profile", "profile_table"),
    "operators.discover": ("discover_df", "discover_table"),
    "operators.verify": ("verify_df", "verify_table", "violating_values"),
    "operators.custom": ("Calculator", "Detector", "discover_with", "verify_with"),
    "operators.detect": ("detect_df", "detect_table", "observed"),
    "operators.rexinfer": ("extract", "extract_checked", "infer", "coverage", "incremental_coverage", "align", "aligned_view"),
    "operators.compare": ("compare", "all_fields_except"),
    "operators.textdiff": ("compare_texts", "compare_files", "compare_binary"),
    "sources.readers": ("load", "read_csv_with_metadata", "read_database", "check_table_exists"),
    "sources.writers": ("save",),
    "streaming.checks": ("verify_stream", "quarantine"),
    "reftest": ("ReferenceTest", "ReferenceTestCase", "captured", "tag"),
}
_WHERE = {name: place for place, names in _PLACES.items() for name in names}
__all__ = [*_WHERE, "__version__"]


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(name)
