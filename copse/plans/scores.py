"""Queries of splits, preparation, metrics and importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, preparation
from . import adapters
from .adapters import FEATURES, SCORES, WIDTH
from .points import rounded
from .registry import query

_RUN = """g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM a_scores GROUP BY score),
r AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC))"""
_AUC = "sum(pos * (n - fp + neg / 2.0e0)) / any_value(p * n)"
_AP = "sum(pos / CAST(p AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE)))"
_C = "count(*) FILTER (score >= {t} AND y = 1) AS tp, count(*) FILTER (score >= {t} AND y = 0) AS fp, count(*) FILTER (score < {t} AND y = 1) AS fn, count(*) FILTER (score < {t} AND y = 0) AS tn"
_ACC, _F1 = "(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)", "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END"
_FB = "CASE WHEN tp = 0 THEN 0.0e0 ELSE 3.25e0 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (2.25e0 * (tp / (tp + fp)::DOUBLE) + (tp / (tp + fn)::DOUBLE)) END"
_GRID = "grid AS (SELECT 0.01e0 + i.range * (0.98e0 / 198) AS t FROM range(199) i)"
_SCAN = f"{_GRID}, c AS (SELECT {{by}} t, {_C.format(t='t')} FROM a_scores, grid GROUP BY {{by}} t), scan AS (SELECT {{by}} t, {_FB} AS fbeta FROM c)"
_CV = f"{_SCAN.format(by='fold,')}, best AS (SELECT fold, t, row_number() OVER (PARTITION BY fold ORDER BY round(fbeta, 12) DESC, t) AS k, fbeta FROM scan)"


@query("roc_curve", f"WITH {SCORES}, {_RUN} SELECT round(score, 6) AS threshold, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr FROM r")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(adapters.scores(spark, sf_dir)))


@query("roc_auc", f"WITH {SCORES}, {_RUN} SELECT round({_AUC}, 6) AS roc_auc FROM r")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(adapters.scores(spark, sf_dir)))


@query("pr_curve", f"WITH {SCORES}, {_RUN} SELECT round(score, 6) AS threshold, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(p AS DOUBLE), 6) AS recall FROM r")
def pr_curve(spark, sf_dir):
    return rounded(metrics.pr_curve(adapters.scores(spark, sf_dir)))


@query("average_precision", f"WITH {SCORES}, {_RUN} SELECT round({_AP}, 6) AS pr_auc FROM r")
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(adapters.scores(spark, sf_dir)))


@query("brier", f"WITH {SCORES} SELECT round(avg((score - y) * (score - y)), 6) AS brier FROM a_scores")
def brier(spark, sf_dir):
    return rounded(metrics.brier(adapters.scores(spark, sf_dir)))


@query("accuracy_f1", f"WITH {SCORES}, c AS (SELECT {_C.format(t='0.5e0')} FROM a_scores) SELECT round({_ACC}, 6) AS accuracy, round({_F1}, 6) AS f1 FROM c")
def accuracy_f1(spark, sf_dir):
    return rounded(metrics.accuracy_f1(adapters.scores(spark, sf_dir)))


@query("confusion", f"WITH {SCORES} SELECT CAST(y AS INTEGER) AS y, count(*) FILTER (score < 0.5e0) AS pred_0, count(*) FILTER (score >= 0.5e0) AS pred_1 FROM a_scores GROUP BY y")
def confusion(spark, sf_dir):
    return metrics.confusion(adapters.scores(spark, sf_dir))


@query(
    "class_report",
    f"""WITH {SCORES}, c AS (SELECT {_C.format(t="0.5e0")} FROM a_scores),
k AS (SELECT '0' AS label, tn AS t, fn AS a, fp AS b FROM c UNION ALL SELECT '1', tp, fp, fn FROM c),
m AS (SELECT label, CASE WHEN t + a > 0 THEN t / CAST(t + a AS DOUBLE) ELSE 0 END AS precision, CASE WHEN t + b > 0 THEN t / CAST(t + b AS DOUBLE) ELSE 0 END AS recall,
  CASE WHEN 2 * t + a + b > 0 THEN 2 * t / CAST(2 * t + a + b AS DOUBLE) ELSE 0 END AS f1, t + b AS support FROM k),
al AS (SELECT * FROM m UNION ALL SELECT 'accuracy', {_ACC}, {_ACC}, {_ACC}, tp + fp + fn + tn FROM c
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM al""",
)
def class_report(spark, sf_dir):
    return rounded(metrics.class_report(adapters.scores(spark, sf_dir)))


@query("calibration_bins", f"WITH {SCORES} SELECT CAST(greatest(ceil(score * 8) - 1, 0) AS INTEGER) AS bin, round(avg(score), 6) AS mean_predicted, round(avg(y), 6) AS fraction_positive, count(*) AS n FROM a_scores GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return rounded(metrics.calibration_bins(adapters.scores(spark, sf_dir)))


@query("fbeta_scan", f"WITH {SCORES}, {_SCAN.format(by='')} SELECT round(t, 6) AS t, round(fbeta, 6) AS fbeta FROM scan")
def fbeta_scan(spark, sf_dir):
    return rounded(metrics.fbeta_scan(adapters.scores(spark, sf_dir)))


@query("threshold_folds", f"WITH {SCORES}, {_CV} SELECT fold, round(t, 6) AS t, round(fbeta, 6) AS fbeta FROM best WHERE k = 1")
def threshold_folds(spark, sf_dir):
    scan = metrics.fbeta_scan(adapters.scores(spark, sf_dir), ("fold",)).withColumn("fbeta", F.round("fbeta", 12))
    return rounded(metrics.best_threshold(scan))


@query("threshold_cv", f"WITH {SCORES}, {_CV} SELECT round(quantile_cont(t, 0.5), 6) AS threshold FROM best WHERE k = 1")
def threshold_cv(spark, sf_dir):
    return rounded(metrics.cv_threshold(adapters.scores(spark, sf_dir)))


@query(
    "metrics_table",
    f"""WITH {SCORES}, {_RUN}, {_CV},
s AS (SELECT 'model@0.50' AS label, 0.5e0 AS threshold UNION ALL SELECT 'model@cv_opt', quantile_cont(t, 0.5) FROM best WHERE k = 1 UNION ALL SELECT 'model_proba_only', NULL),
b AS (SELECT {_AUC} AS roc_auc, {_AP} AS pr_auc FROM r),
e AS (SELECT label, threshold, {_C.format(t="threshold")}, avg((score - y) * (score - y)) AS brier FROM a_scores, s GROUP BY label, threshold)
SELECT label, round(threshold, 6) AS threshold, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier,
  CASE WHEN threshold IS NOT NULL THEN round({_ACC}, 6) END AS accuracy, CASE WHEN threshold IS NOT NULL THEN round({_F1}, 6) END AS f1 FROM e, b""",
)
def metrics_table(spark, sf_dir):
    return rounded(metrics.metrics_table(adapters.scores(spark, sf_dir)))


# -- preparation -------------------------------------------------------------------------------

_XS = [f"x{j}" for j in range(WIDTH)]
_SPLIT = """sp AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR)), id) <= count(*) OVER (PARTITION BY y) * 0.2e0 AS is_test FROM a_features)"""
_IMP = f"{_SPLIT}, med AS (SELECT {', '.join(f'quantile_cont({x}, 0.5) AS m_{x}' for x in _XS)} FROM sp WHERE NOT is_test), imp AS (SELECT id, y, is_test, {', '.join(f'coalesce({x}, m_{x}) AS {x}' for x in _XS)} FROM sp, med)"


def _split(spark, sf_dir):
    return preparation.stratified_split(adapters.features(spark, sf_dir))


def _imputed(spark, sf_dir):
    return preparation.impute(_split(spark, sf_dir), _XS)


@query("strat_split", f"WITH {FEATURES}, {_SPLIT} SELECT id, y, is_test FROM sp")
def strat_split(spark, sf_dir):
    return _split(spark, sf_dir).select("id", "y", "is_test")


@query("impute_median", f"WITH {FEATURES}, {_IMP} SELECT id, y, is_test, {', '.join(f'round({x}, 6) + 0.0e0 AS {x}' for x in _XS)} FROM imp")
def impute_median(spark, sf_dir):
    return rounded(_imputed(spark, sf_dir))


@query(
    "standardize",
    f"""WITH {FEATURES}, {_IMP}, st AS (SELECT {", ".join(f"avg({x}) AS a_{x}, CASE WHEN stddev_pop({x}) > 0 THEN stddev_pop({x}) ELSE 1 END AS s_{x}" for x in _XS)} FROM imp WHERE NOT is_test)
SELECT id, y, is_test, {", ".join(f"round(({x} - a_{x}) / s_{x}, 6) + 0.0e0 AS {x}" for x in _XS)} FROM imp, st""",
)
def standardize(spark, sf_dir):
    return rounded(preparation.standardise(_imputed(spark, sf_dir), _XS))


_WEIGHTS = [((j * 7) % 11 - 5) / 5.0 for j in range(WIDTH)]
_REPEATS = 200


def _z(cols: dict[str, str]) -> str:
    return "round(1.0e0 / (1.0e0 + exp(-(0.0e0" + "".join(f" + {cols[x]} * {w!r}::DOUBLE" for x, w in zip(_XS, _WEIGHTS, strict=True)) + "))), 9)"


_PERM = f"""{FEATURES}, {_IMP}, t AS (SELECT * FROM imp WHERE is_test),
bs AS (SELECT y, {_z({x: x for x in _XS})} AS score FROM t), bg AS (SELECT score, sum(y) AS pos, count(*) AS n FROM bs GROUP BY score),
br AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS al, sum(pos) OVER () AS p FROM bg WINDOW w AS (ORDER BY score DESC)), base AS (SELECT sum(pos / CAST(p AS DOUBLE) * (tp / CAST(al AS DOUBLE))) AS baseline_ap FROM br),
fr AS (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in _XS)}) f(feature), (SELECT range AS rep FROM range({_REPEATS})) q),
d AS (SELECT t.*, feature, rep, row_number() OVER (PARTITION BY feature, rep ORDER BY md5(CAST(id AS VARCHAR)), id) AS k FROM t, fr),
v AS (SELECT feature, rep, row_number() OVER (PARTITION BY feature, rep ORDER BY md5(CAST(id AS VARCHAR) || '|' || feature || '|' || CAST(rep AS VARCHAR)), id) AS k, CASE feature {" ".join(f"WHEN '{x}' THEN {x}" for x in _XS)} END AS val FROM t, fr),
ps AS (SELECT d.feature, d.rep, y, {_z({x: f"CASE WHEN d.feature = '{x}' THEN val ELSE {x} END" for x in _XS})} AS score FROM d JOIN v ON d.feature = v.feature AND d.rep = v.rep AND d.k = v.k),
pg AS (SELECT feature, rep, score, sum(y) AS pos, count(*) AS n FROM ps GROUP BY feature, rep, score),
pr AS (SELECT feature, rep, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS al, sum(pos) OVER (PARTITION BY feature, rep) AS p FROM pg WINDOW w AS (PARTITION BY feature, rep ORDER BY score DESC)),
pa AS (SELECT feature, rep, sum(pos / CAST(p AS DOUBLE) * (tp / CAST(al AS DOUBLE))) AS ap FROM pr GROUP BY feature, rep),
im AS (SELECT feature, round(avg(baseline_ap - ap), 9) AS perm_importance_mean, stddev_pop(baseline_ap - ap) AS perm_importance_std, any_value(baseline_ap) AS baseline_ap FROM pa, base GROUP BY feature)"""
_SHARE = f"""{_PERM}, sh AS (SELECT 'linear' AS model, *, greatest(perm_importance_mean, 0) AS imp_pos, sum(greatest(perm_importance_mean, 0)) OVER () AS tot, count(*) OVER () AS cnt, row_number() OVER (ORDER BY perm_importance_mean DESC, feature) AS rank FROM im)"""
_SHOWN = """model, feature, round(perm_importance_mean, 6) + 0.0e0 AS perm_importance_mean, round(perm_importance_std, 6) AS perm_importance_std, round(imp_pos, 6) + 0.0e0 AS imp_pos, round(baseline_ap, 6) AS baseline_ap,
  round(CASE WHEN tot > 0 THEN imp_pos / tot * 100 ELSE 0 END, 6) + 0.0e0 AS share_percent, round(imp_pos / baseline_ap * 100, 6) + 0.0e0 AS rel_drop_percent, round(CASE WHEN cnt > 1 THEN 100.0e0 * (1.0e0 - (rank - 1) / CAST(cnt - 1 AS DOUBLE)) ELSE 100 END, 6) + 0.0e0 AS rank_percentile"""


def _importance(spark, sf_dir):
    test = _imputed(spark, sf_dir).where("is_test")
    imp = preparation.permutation_importance(test, _XS, preparation.linear_score(_XS, _WEIGHTS), _REPEATS)
    return imp.withColumn("perm_importance_mean", F.round("perm_importance_mean", 9))


@query("perm_importance_linear", f"WITH {_PERM} SELECT feature, round(perm_importance_mean, 6) + 0.0e0 AS perm_importance_mean, round(perm_importance_std, 6) AS perm_importance_std, round(baseline_ap, 6) AS baseline_ap FROM im")
def perm_importance_linear(spark, sf_dir):
    return rounded(_importance(spark, sf_dir))


@query("importance_share_rank", f"WITH {_SHARE} SELECT {_SHOWN} FROM sh")
def importance_share_rank(spark, sf_dir):
    return rounded(preparation.importance_shares(_importance(spark, sf_dir), "linear"))


@query("importance_top20", f"WITH {_SHARE} SELECT {_SHOWN}, CAST(rank AS INTEGER) AS rank FROM sh WHERE rank <= 20")
def importance_top20(spark, sf_dir):
    return rounded(preparation.top_features(preparation.importance_shares(_importance(spark, sf_dir), "linear")))
