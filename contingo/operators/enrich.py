"""The whole enrichment analysis as one DataFrame function: cohort ->
contingency sweep (optionally stratified) -> odds ratio, Wald interval,
Fisher p -> Benjamini-Hochberg per family -> significance labels.

Nothing here is collected: the caller writes the result (for example with
``sources.write_parquet(out, path, partition_by=["stratum"])``, one
directory per stratum in a single write)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from contingo.operators.counts import Spec, contingency_sweep, contingency_sweep_by_id
from contingo.operators.stats import bh_adjust, with_fisher_and_or, with_significance_labels


def enrich(cohort: DataFrame, id_cols: Sequence[str], comparisons: Sequence[Spec],
           predictions: Sequence[Spec], strata: Column | None = None, alpha: float = 0.05,
           one_row_per_id: bool = False) -> DataFrame:
    """Enrichment of every (comparison, prediction) category pair, corrected
    within each (stratum, predictionType, comparisonType) family.  With
    ``one_row_per_id`` the cohort has one row for each entity and array
    columns for multi-valued categories."""
    counts = contingency_sweep_by_id(cohort, comparisons, predictions, strata=strata) if one_row_per_id else \
        contingency_sweep(cohort, id_cols, comparisons, predictions, strata=strata)
    stats = with_fisher_and_or(counts)
    family = (["stratum"] if strata is not None else []) + ["predictionType", "comparisonType"]
    corrected = bh_adjust(stats, group_cols=family, tiebreak=["prediction", "comparison"])
    return with_significance_labels(corrected, alpha=alpha)
