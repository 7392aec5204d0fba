"""Classifier metrics over scored, labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .base import SCORED_SQL, query

_WITH = f"WITH {SCORED_SQL}"
_ENDS = """n AS (SELECT sum(y) AS np, sum(1 - y) AS nn FROM scored),
ties AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p),
run AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM ties)"""


def _pairs(t):
    return t.scored().select("y", F.expr("IF(p >= 0.5, 1, 0)").alias("predicted"))


@query("confusion_matrix", f"""{_WITH} SELECT y AS truth, count(*) FILTER (p < 0.5) AS predicted_0, count(*) FILTER (p >= 0.5) AS predicted_1 FROM scored GROUP BY y""")
def matrix(t):
    return M.confusion_matrix(_pairs(t), "y", "predicted", [0, 1])


@query("classification_report", f"""{_WITH}, c AS (SELECT v.k, count(*) FILTER (y = k AND (p >= 0.5) = (k = 1)) AS hit, count(*) FILTER (y = k) AS support,
  count(*) FILTER ((p >= 0.5) = (k = 1)) AS named FROM scored, (VALUES (0), (1)) v(k) GROUP BY v.k),
r AS (SELECT k, support, hit, CASE WHEN named > 0 THEN hit / named::DOUBLE ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS re FROM c),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM r)
SELECT CAST(k AS VARCHAR) AS label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def report(t):
    rows = M.report_rows(M.confusion(_pairs(t), "y", "predicted"))
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("roc_auc", f"{_WITH}, {_ENDS} SELECT round(sum(neg * (tp - pos / 2.0)) / max(np * nn), 6) AS roc_auc FROM run, n")
def auc(t):
    return M.roc_auc(t.scored(), "y", "p").select(F.round("roc_auc", 6).alias("roc_auc"))


@query("roc_curve", f"{_WITH}, {_ENDS} SELECT p AS threshold, round(fp / nn::DOUBLE, 6) AS fpr, round(tp / np::DOUBLE, 6) AS tpr FROM run, n")
def roc(t):
    return M.roc_curve(t.scored(), "y", "p").select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("average_precision", f"{_WITH}, {_ENDS} SELECT round(sum(pos * tp / (tp + fp)::DOUBLE) / max(np), 6) AS average_precision FROM run, n")
def ap(t):
    return M.average_precision(t.scored(), "y", "p").select(F.round("average_precision", 6).alias("average_precision"))


@query("pr_curve", f"{_WITH}, {_ENDS} SELECT p AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / np::DOUBLE, 6) AS recall FROM run, n")
def pr(t):
    return M.pr_curve(t.scored(), "y", "p").select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("brier_score", f"{_WITH} SELECT round(avg((p - y) * (p - y)), 6) AS brier_score FROM scored")
def brier(t):
    return t.scored().agg(F.round(M.brier("y", "p"), 6).alias("brier_score"))


@query("log_loss", f"""{_WITH} SELECT round(avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
  ELSE ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) END), 6) AS log_loss FROM scored""")
def loss(t):
    return t.scored().agg(F.round(M.log_loss("y", "p"), 6).alias("log_loss"))
