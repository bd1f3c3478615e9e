"""DuckDB texts for the threshold metrics, curves and business figures."""

from __future__ import annotations

from .. import config as C


def dl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def values_table(ths: list[float]) -> str:
    rows = ", ".join(f"({i}, {dl(t)})" for i, t in enumerate(ths))
    return f"(SELECT * FROM (VALUES {rows}) AS v(idx, th))"


def div0(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def counts_sql(rows: str, ths_table: str) -> str:
    """(th, tn, fp, fn, tp) per threshold by brute force over ``rows(y, p)``."""
    return f"""SELECT t.th AS threshold,
    count(r.y) FILTER (WHERE r.p < t.th AND r.y <> 1) AS tn,
    count(r.y) FILTER (WHERE r.p >= t.th AND r.y <> 1) AS fp,
    count(r.y) FILTER (WHERE r.p < t.th AND r.y = 1) AS fn,
    count(r.y) FILTER (WHERE r.p >= t.th AND r.y = 1) AS tp
  FROM {ths_table} t CROSS JOIN {rows} r GROUP BY t.th"""


def rates_sql() -> str:
    return (f"{div0('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {div0('tp', 'tp + fp')} AS precision, "
            f"{div0('tp', 'tp + fn')} AS recall, {div0('tn', 'tn + fp')} AS specificity, "
            f"{div0('2 * tp', '2 * tp + fp + fn')} AS f1")


def net_sql(tp: str = "tp", fp: str = "fp") -> str:
    return (f"{tp} * {dl(C.RETENTION_RATE * C.CLV)} - ({tp} + {fp}) * {dl(C.CAMPAIGN_COST_PER_HEAD)}")


def impact_sql() -> str:
    cost = f"(tp + fp) * {dl(C.CAMPAIGN_COST_PER_HEAD)}"
    saved = f"tp * {dl(C.RETENTION_RATE)} * {dl(C.CLV)}"
    return (f"(tp + fn) * {dl(C.CLV)} AS unmitigated_loss, CAST(tp + fp AS BIGINT) AS targeted, "
            f"CAST(tp AS BIGINT) AS caught, tp * {dl(C.RETENTION_RATE)} AS retained, {saved} AS saved_revenue, "
            f"{cost} AS campaign_cost, {saved} - {cost} AS net_savings, "
            f"CASE WHEN {cost} > 0 THEN ({saved} - {cost}) / ({cost}) * CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS roi_pct")


def auc_sql(rows: str) -> str:
    """Mann-Whitney form of the ROC-AUC with average ranks for ties (independent of the Spark kernel)."""
    return f"""(SELECT CASE WHEN P = 0 OR N = 0 THEN NULL ELSE (sum_r - P * (P + 1) / 2.0) / (CAST(P AS DOUBLE) * N) END
   FROM (SELECT sum(r) FILTER (WHERE y = 1) AS sum_r, count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y <> 1) AS N
         FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM {rows})))"""


def curve_sql(rows: str) -> str:
    """Per distinct score, descending: pos, neg, cumulative tp/fp, totals P/N."""
    return f"""(SELECT score, pos, neg,
      sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
      sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
      sum(pos) OVER () AS P, sum(neg) OVER () AS N
    FROM (SELECT p AS score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
          FROM {rows} GROUP BY p))"""
