"""Cleaning of a raw panel, end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.rules import Rule, usable_rules
from panelweave.operators.fill import apply_rules
from panelweave.operators.quality import clean_infinities, drop_sparse_columns, fill_rate_quantile, quality_report, require_columns, row_fill_rate
from panelweave.sources.tables import cached_result
from panelweave.spec import PanelSpec, q


def clean_panel(
    df: DataFrame,
    spec: PanelSpec,
    rules: Mapping[str, Sequence[Rule]],
    required_before: Sequence[str] = (),
    required_after: Sequence[str] = (),
    row_pct: float = 0.0,
    row_quantile: float = 0.0,
    col_pct: float = 0.0,
    score_cols: Sequence[str] | None = None,
    append_quality: bool = True,
    annual_aware: bool = True,
    checkpoint: bool = True,
    cache_root: str | None = None,
    cache_key: Mapping[str, object] | None = None,
    refresh: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(clean panel, quality report).

    Infinities go first; the fill rate is taken over all input rows, then required columns, the row threshold,
    the row quantile and the column threshold apply; what is left is filled by ``rules`` and must have
    ``required_after``. Rules about columns that are not there or were cut are left out. The report is one row: the
    counts of ``quality_report``, the columns cut, the rules left out and the rows lost after filling.

    With ``cache_root`` both are written there once and read back for the same settings; ``cache_key`` must then name
    the input (its path or snapshot), which the settings do not.
    """
    if cache_root is not None:
        if not cache_key:
            raise ValueError("cache_key must name the input of a cached result")
        texts = {c: [f"{r.kind}:{r.body}:{sorted(r.kwargs.items())}" for r in rs] for c, rs in rules.items()}
        settings = {"required_before": list(required_before), "required_after": list(required_after), "row_pct": row_pct, "row_quantile": row_quantile, "col_pct": col_pct}
        settings |= {"score_cols": list(score_cols or ()), "append_quality": append_quality, "annual_aware": annual_aware, "rules": texts, "key": dict(cache_key)}
        build = lambda: clean_panel(df, spec, rules, required_before, required_after, row_pct, row_quantile, col_pct, score_cols, append_quality, annual_aware, checkpoint)
        return cached_result(df.sparkSession, cache_root, settings, build, refresh)
    df = clean_infinities(df)
    cols = list(score_cols or df.columns)
    report = quality_report(df, cols, required_before, row_pct, row_quantile)
    rated = row_fill_rate(df, cols, "data_quality")
    kept = require_columns(rated, required_before).filter(F.col("data_quality") >= row_pct)
    if row_quantile > 0:
        kept = kept.filter(F.col("data_quality") >= fill_rate_quantile(df, cols, row_quantile))
    if col_pct > 0:
        # The column threshold looks at all input rows, too.
        wanted = drop_sparse_columns(df, col_pct, keep=[spec.comp, spec.period, spec.industry]).columns
        kept = kept.select(*[q(c) for c in wanted], "data_quality")
    cut = [c for c in df.columns if c not in kept.columns]
    usable, left_out = usable_rules(rules, kept.columns)
    filled = apply_rules(kept, spec, usable, annual_aware=annual_aware, checkpoint=checkpoint)
    clean = require_columns(filled, required_after)
    lost = F.lit(False)
    for c in required_after:
        lost = lost | q(c).isNull()
    texts = lambda names: F.array(*[F.lit(x) for x in names]).cast("array<string>")
    report = report.select("*", texts(cut).alias("dropped_columns"), texts(left_out).alias("skipped_rules"), filled.agg(F.count_if(lost)).scalar().alias("dropped_after"))
    return (clean if append_quality else clean.drop("data_quality")), report
