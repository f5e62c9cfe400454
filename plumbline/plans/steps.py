"""A list of preparation steps, replayed as one lazy plan.

Undoing a step is replaying the list without it.
"""

from __future__ import annotations

from collections.abc import Mapping
from collections.abc import Sequence as Listing

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from plumbline.operators import prep


def _missing(df, p, order):
    return prep.handle_missing(df, p["column"], p["strategy"], p.get("value"), order=order)


STEPS = {
    "filter": lambda df, p, o: prep.filter_rows(df, p["column"], p["operator"], p.get("value")),
    "sort": lambda df, p, o: prep.sort_rows(df, p["by"]),
    "find_replace": lambda df, p, o: prep.find_replace(
        df, p["column"], p["find"], p["replace"], p.get("regex", False)
    ),
    "dedup": lambda df, p, o: prep.remove_duplicates(df, p["keys"], o),
    "missing": _missing,
    "trim": lambda df, p, o: prep.trim_columns(df, p.get("columns")),
    "rename": lambda df, p, o: prep.rename_column(df, p["old"], p["new"]),
    "change_type": lambda df, p, o: prep.change_type(df, p["column"], p["target"]),
    "calculated": lambda df, p, o: prep.calculated_column(df, p["name"], p["expression"]),
    "recode": lambda df, p, o: prep.recode(df, p["column"], p["mapping"], p.get("new_column")),
    "bin": lambda df, p, o: prep.bin_column(
        df, p["column"], p.get("bins", 5), p["new_column"], p.get("breaks")
    ),
    "split": lambda df, p, o: prep.split_column(df, p["column"], p["delimiter"], p.get("parts", 2)),
    "concat": lambda df, p, o: prep.concat_columns(
        df, p["columns"], p["separator"], p["new_column"]
    ),
}


def replay(
    df: DataFrame,
    steps: Listing[Mapping],
    *,
    order: str | Listing[str],
    skip_errors: bool = False,
) -> DataFrame:
    """Apply the steps in turn; a failing step raises, or is left out with ``skip_errors``."""
    for step in steps:
        kind = step.get("type")
        if kind not in STEPS:
            if skip_errors:
                continue
            raise ValueError(f"unknown step {kind!r}")
        try:
            nxt = STEPS[kind](df, step.get("params", {}), order)
            nxt.schema  # analysis errors show here, not when the plan runs
            df = nxt
        except (ValueError, KeyError, AnalysisException):
            if not skip_errors:
                raise
    return df
