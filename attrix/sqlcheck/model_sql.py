"""DuckDB twin of the fitted feature transform + fixed linear model (scored table)."""

from __future__ import annotations

from .. import config as C
from ..operators.models import FIXED_MODEL
from .parts import fe_ctes

ONE = "CAST(1 AS DOUBLE)"


def dlit(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _weighted_categories() -> list[tuple[int, str, str, float]]:
    out = []
    for name, w in FIXED_MODEL.weights.items():
        if "_" in name and w:
            col, val = name.split("_", 1)
            if col in C.FE_CATEGORICAL_COLS:
                out.append((C.FE_CATEGORICAL_COLS.index(col), col, val, w))
    return sorted(out, key=lambda t: (t[0], t[2]))


def logit_sql(f: str = "f", s: str = "s") -> str:
    terms = [dlit(FIXED_MODEL.intercept)]
    for c in C.FE_NUMERIC_COLS:
        w = FIXED_MODEL.weights.get(c, 0.0)
        if w:
            sd = f"CASE WHEN {s}.sd_{c} = 0 OR {s}.sd_{c} IS NULL THEN {ONE} ELSE {s}.sd_{c} END"
            terms.append(f"{dlit(w)} * ((CAST({f}.{c} AS DOUBLE) - {s}.mu_{c}) / {sd})")
    for i, (_, col, val, w) in enumerate(_weighted_categories()):
        terms.append(
            f"{dlit(w)} * (CASE WHEN {s}.seen_{i} THEN CAST(coalesce({f}.{col} = '{val}', false) AS DOUBLE) "
            f"ELSE CAST(0 AS DOUBLE) END)"
        )
    for c in C.FE_BINARY_COLS:
        w = FIXED_MODEL.weights.get(c, 0.0)
        if w:
            terms.append(f"{dlit(w)} * CAST({f}.{c} AS DOUBLE)")
    return "\n      + ".join(terms)


def scored_ctes(source: str = "with_folds") -> str:
    """Defines fe_s (engineered, train-median filled), train_stats and scored (adds p)."""
    med = f"(SELECT median(TotalCharges) FROM {source} WHERE split = 'train')"
    stats = []
    for c in C.FE_NUMERIC_COLS:
        stats.append(f"avg(CAST({c} AS DOUBLE)) AS mu_{c}")
        stats.append(f"stddev_pop(CAST({c} AS DOUBLE)) AS sd_{c}")
    for i, (_, col, val, _) in enumerate(_weighted_categories()):
        stats.append(f"coalesce(bool_or({col} = '{val}'), false) AS seen_{i}")
    return fe_ctes(source, med, name="fe_s") + f""",
train_stats AS (
  SELECT {', '.join(stats)}
  FROM fe_s WHERE split = 'train'
),
scored AS (
  SELECT f.*, {ONE} / ({ONE} + exp(-(
      {logit_sql()}
  ))) AS p
  FROM fe_s f CROSS JOIN train_stats s
)"""
