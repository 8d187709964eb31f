"""Queries: walk-forward studies, discovery, calibration, gates and macro relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import macro as O
from tidemark.operators import scan as S
from tidemark.operators import calibration as C
from tidemark.operators import trees as T
from tidemark.operators import walk as K
from tidemark.operators import windows as W
from tidemark.plans.analysis_queries import OUTCOMES, R, _outcomes, _returns
from tidemark.plans.registry import BY, daily, hourly, lag, over, query, read, roll, with_returns
from tidemark.plans.window_queries import CROSS, SO_FAR

# --- outcomes and folds -----------------------------------------------------------------------------------------


@query("res02_outcome_contract", f"WITH {CROSS}, k AS (SELECT event_id, symbol, ts, direction, price, ts + to_days(1) AS target FROM ev WHERE direction IS NOT NULL), en AS (SELECT k.*, b.ts AS realized_end, b.close AS c FROM k ASOF LEFT JOIN bars b ON k.symbol = b.symbol AND k.target <= b.ts) SELECT event_id, realized_end, ((c / price - 1) * CASE WHEN direction = 'bearish' THEN -1 ELSE 1 END >= 0)::INT AS hit_threshold_1d FROM en", t="realized_end")
def _(spark, d):
    bars = daily(spark, d)
    return L.contract(W.crossovers(bars), bars, 1)


@query("res04_expanding_folds", "WITH n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1), k AS (SELECT symbol, n, unnest(range(greatest(0, (n - 50 + 19) // 20))) AS k FROM n) SELECT symbol, k::INT AS fold, 0::BIGINT AS train_lo, 50 + k * 20 AS train_hi, 50 + k * 20 AS test_lo, least(70 + k * 20, n) AS test_hi FROM k")
def _(spark, d):
    from tidemark.operators.folds import expanding_folds_of

    return expanding_folds_of(daily(spark, d), 50, 20)


_NUM = f"{OUTCOMES}, nu AS (SELECT event_id, ts, direction, ret, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM oc WHERE horizon_days = 5), nn AS (SELECT count(*) AS n FROM nu), fo AS (SELECT k::INT AS fold, 60 + k * 30 AS v0, 90 + k * 30 AS s0, 120 + k * 30 AS s1 FROM nn, range(100000) AS t(k) WHERE 120 + k * 30 <= n), ft AS (SELECT fo.*, a.ts AS v_ts, b.ts AS s_ts FROM fo JOIN nu a ON a.idx = v0 JOIN nu b ON b.idx = s0), pa AS (SELECT fold, direction, ret, CASE WHEN idx < v0 AND ts < v_ts - INTERVAL 5 DAY THEN 'train' WHEN idx >= v0 AND idx < s0 AND ts < s_ts - INTERVAL 5 DAY THEN 'validation' WHEN idx >= s0 AND idx < s1 AND ts >= s_ts + INTERVAL 2 DAY THEN 'test' END AS role FROM ft JOIN nu ON idx < s1), ma AS (SELECT * FROM pa WHERE direction = 'bullish' AND ret IS NOT NULL), va AS (SELECT ft.fold, " + ", ".join(f"count(*) FILTER (WHERE role = '{r}') AS n_{r}, coalesce(avg((ret > 0)::INT) FILTER (WHERE role = '{r}'), 0) AS p_{r}, coalesce(avg(ret) FILTER (WHERE role = '{r}'), 0) AS mean_{r}" for r in ("train", "validation", "test")) + " FROM ft LEFT JOIN ma USING (fold) GROUP BY 1), z AS (SELECT *, 1.959963984540054 ** 2 AS q FROM va), wi AS (SELECT *, (p_test + q / (2 * n_test)) / (1 + q / n_test) AS mid, 1.959963984540054 / (1 + q / n_test) * sqrt(p_test * (1 - p_test) / n_test + q / (4 * n_test * n_test)) AS half FROM z), ws AS (SELECT fold, n_train, n_validation, n_test, p_train, p_validation, p_test, mean_train, mean_validation, mean_test, CASE WHEN n_test > 0 THEN mid - half END AS ci_lo, CASE WHEN n_test > 0 THEN mid + half END AS ci_hi, n_test >= 10 AND greatest(p_train, p_validation, p_test) - least(p_train, p_validation, p_test) <= 0.15 AS passed FROM wi)"


def _validated(spark, d):
    events = K.numbered(_outcomes(spark, d).where("horizon_days = 5"))
    return K.validate_condition(events, F.col("direction") == "bullish", "ret", (60, 30, 30, 30), 5, 2, 10)


@query("res06_walk_forward_condition", f"WITH {_NUM} SELECT * FROM ws", r="p_train p_validation p_test mean_train mean_validation mean_test ci_lo ci_hi")
def _(spark, d):
    return _validated(spark, d)


@query("res06_verdict", f"WITH {_NUM} SELECT count(*) AS folds, count(*) FILTER (WHERE passed) AS passed, CASE WHEN count(*) = 0 THEN 'INSUFFICIENT_DATA' WHEN count(*) FILTER (WHERE passed) = count(*) THEN 'VALIDATED' ELSE 'INCONCLUSIVE' END AS status FROM ws")
def _(spark, d):
    return K.verdict(_validated(spark, d))


# --- model against baseline -------------------------------------------------------------------------------------

_X = f"xr AS (SELECT symbol, ts, x, fwd, CASE WHEN fwd > 0.2 THEN 1 WHEN fwd < -0.2 THEN -1 ELSE 0 END AS y FROM (SELECT symbol, ts, (close - {lag('close', 5)}) / {lag('close', 5)} AS x, lead(close, 5) OVER ({BY}) / close - 1 AS fwd FROM bars) WHERE x IS NOT NULL AND fwd IS NOT NULL), xi AS (SELECT *, row_number() OVER ({BY}) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM xr), xf AS (SELECT *, unnest(generate_series(greatest(0, (idx - 119) // 40 + ((idx - 119) % 40 > 0)::INT), least((n - 120) // 40, idx // 40))) AS fold FROM xi WHERE n >= 120 AND greatest(0, (idx - 119) // 40 + ((idx - 119) % 40 > 0)::INT) <= least((n - 120) // 40, idx // 40)), xp AS (SELECT *, CASE WHEN idx - fold * 40 < 80 THEN 'train' ELSE 'validation' END AS role FROM xf)"


def _model_sql(keys: str = "symbol, fold", parts: str = "xp") -> str:
    bin_ = "CASE WHEN hi = lo THEN 0 ELSE least(4, greatest(0, floor((x - lo) / (hi - lo) * 5))) END::INT"
    share = "avg((y = 1)::INT) AS u, avg((y = 0)::INT) AS f, avg((y = -1)::INT) AS w"
    return (
        f"en2 AS (SELECT {keys}, min(x) AS lo, max(x) AS hi FROM {parts} WHERE role = 'train' GROUP BY ALL), tb AS (SELECT {keys}, {bin_} AS bin, {share} FROM {parts} JOIN en2 USING ({keys}) WHERE role = 'train' GROUP BY ALL), wh AS (SELECT {keys}, avg((y = 1)::INT) AS u0, avg((y = 0)::INT) AS f0, avg((y = -1)::INT) AS w0 FROM {parts} WHERE role = 'train' GROUP BY ALL), "
        f"sc AS (SELECT {keys}, y, fwd, coalesce(u, u0) AS p_up, coalesce(f, f0) AS p_flat, coalesce(w, w0) AS p_down, CASE WHEN u0 >= f0 AND u0 >= w0 THEN 1 WHEN f0 >= w0 THEN 0 ELSE -1 END AS baseline FROM (SELECT *, {bin_} AS bin FROM {parts} JOIN en2 USING ({keys}) WHERE role = 'validation') LEFT JOIN tb USING ({keys}, bin) JOIN wh USING ({keys})), "
        "pr2 AS (SELECT *, CASE WHEN p_up >= p_flat AND p_up >= p_down THEN 1 WHEN p_flat >= p_down THEN 0 ELSE -1 END AS predicted FROM sc), "
        "br AS (SELECT *, (p_up - (y = 1)::INT) ** 2 + (p_flat - (y = 0)::INT) ** 2 + (p_down - (y = -1)::INT) ** 2 AS brier FROM pr2)"
    )


def _parts(spark, d):
    own = daily(spark, d).select("symbol", "ts", (F.col("close") / W.previous("close", 5) - 1).alias("x"), (F.lead("close", 5).over(W.series()) / F.col("close") - 1).alias("ret")).where("x is not null and ret is not null")
    own = own.withColumn("y", F.when(F.col("ret") > 0.2, 1).when(F.col("ret") < -0.2, -1).otherwise(0))
    return K.rolling_folds(S.row_index(own), 80, 40, 40)


def _scored(spark, d):
    return K.binned_model(_parts(spark, d), "x", "y", 5, ["symbol", "fold"])


@query("res09_walk_forward_experiment", f"WITH {_X}, {_model_sql()} SELECT symbol, count(*) AS n, avg((predicted = y)::INT) AS accuracy, avg((baseline = y)::INT) AS baseline_accuracy, avg(brier) AS brier, coalesce(avg((y = 1)::INT) FILTER (WHERE predicted = 1), 0) AS precision_up, coalesce(avg((y = -1)::INT) FILTER (WHERE predicted = -1), 0) AS precision_down, coalesce(avg((predicted = 1)::INT) FILTER (WHERE y = 1), 0) AS recall_up, coalesce(avg((predicted = -1)::INT) FILTER (WHERE y = -1), 0) AS recall_down, avg((predicted = y AND (predicted = 0 OR abs(fwd) > 0.3))::INT) AS net_accuracy, count(*) FILTER (WHERE predicted = y AND baseline <> y) AS wins, count(*) FILTER (WHERE baseline = y AND predicted <> y) AS losses FROM br GROUP BY 1", r="accuracy baseline_accuracy brier precision_up precision_down recall_up recall_down net_accuracy")
def _(spark, d):
    return K.experiment(_scored(spark, d), "y", F.lit(0.3), ["symbol"])


_SETS = {"price": "x", "volume": "v", "range": "g"}
_XS = _X.replace("fwd, CASE WHEN fwd > 0.2", "v, g, fwd, CASE WHEN fwd > 0.2").replace("AS fwd FROM bars)", "AS fwd, volume AS v, high - low AS g FROM bars)")
_LONG = "xl AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature_set, symbol, fold, role, y, fwd, {c} AS x FROM xp" for n, c in _SETS.items()) + ")"


@query("res10_feature_sets", f"WITH {_XS}, {_LONG}, {_model_sql('feature_set, symbol, fold', 'xl')} SELECT feature_set, count(*) AS n, avg((predicted = y)::INT) AS accuracy, avg(brier) AS brier FROM br GROUP BY 1", r="accuracy brier")
def _(spark, d):
    own = daily(spark, d).select("symbol", "ts", (F.col("close") / W.previous("close", 5) - 1).alias("price"), F.col("volume"), (F.col("high") - F.col("low")).alias("range"), (F.lead("close", 5).over(W.series()) / F.col("close") - 1).alias("ret")).where("price is not null and ret is not null")
    own = S.row_index(own.withColumn("y", F.when(F.col("ret") > 0.2, 1).when(F.col("ret") < -0.2, -1).otherwise(0)))
    parts = K.rolling_folds(own, 80, 40, 40)
    long = parts.select("symbol", "fold", "role", "y", "ret", F.inline(F.array(*[F.struct(F.lit(n).alias("feature_set"), F.col(n).cast("double").alias("x")) for n in _SETS])))
    scored = K.binned_model(long, "x", "y", 5, ["feature_set", "symbol", "fold"])
    return K.experiment(scored, "y", F.lit(0.3), ["feature_set"]).select("feature_set", "n", "accuracy", "brier")


_D = f"de AS (SELECT fold, symbol, ts, x, dayofmonth(ts) % 3 AS part, (fwd > 0)::INT AS hit, CASE WHEN idx - fold * 40 < 56 THEN 'inner_train' ELSE 'inner_validation' END AS role FROM xp WHERE role = 'train')"
_CANDIDATES = "ca AS (SELECT *, 'part=0' AS candidate FROM de WHERE part = 0 UNION ALL SELECT *, 'part=1' FROM de WHERE part = 1 UNION ALL SELECT *, 'part=2' FROM de WHERE part = 2 UNION ALL SELECT *, 'x>median' FROM de WHERE x > 0 UNION ALL SELECT *, 'x<=median' FROM de WHERE x <= 0)"
_SCORES = "wb AS (SELECT fold, (0.5 + sum(hit)) / (1 + count(*)) AS base FROM de WHERE role = 'inner_train' GROUP BY 1), cs AS (SELECT fold, candidate, count(*) FILTER (WHERE role = 'inner_train') AS n_train, coalesce(sum(hit) FILTER (WHERE role = 'inner_train'), 0) AS h, count(*) FILTER (WHERE role = 'inner_validation') AS n_validation, coalesce(sum(hit) FILTER (WHERE role = 'inner_validation'), 0) AS v FROM {c} GROUP BY 1, 2), si AS (SELECT cs.*, (0.5 + h) / (1 + n_train) AS p, base FROM cs JOIN wb USING (fold) WHERE n_train >= 8 AND n_validation >= 8), sx AS (SELECT fold, candidate, n_train, n_validation, (v * (1 - base) ** 2 + (n_validation - v) * base ** 2) / n_validation - (v * (1 - p) ** 2 + (n_validation - v) * p ** 2) / n_validation AS improvement FROM si), sr AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(improvement, 12) DESC, n_validation DESC, candidate) AS rank FROM sx)"


def _discovery(spark, d):
    own = _parts(spark, d).where("role = 'train'")
    own = own.select("fold", "symbol", "ts", "x", (F.dayofmonth("ts") % 3).alias("part"), (F.col("ret") > 0).cast("int").alias("hit"), F.when(F.col("idx") - F.col("fold") * 40 < 56, "inner_train").otherwise("inner_validation").alias("role"))
    return own, K.candidates({"part": [0, 1, 2]}, {"x": 0.0})


@query("res12_nested_discovery", f"WITH {_X}, {_D}, {_CANDIDATES}, {_SCORES.format(c='ca')} SELECT fold, candidate, n_train, n_validation, improvement FROM sr WHERE rank = 1", r="improvement")
def _(spark, d):
    parts, predicates = _discovery(spark, d)
    return K.best_candidate(K.candidate_scores(parts, predicates, "hit", 8)).drop("rank")


@query("res13_interactions", f"WITH {_X}, {_D}, pc AS (SELECT de.*, '(part=' || part || ') AND (x<=median)' AS candidate FROM de WHERE x <= 0 UNION ALL SELECT de.*, '(part=' || part || ') AND (x>median)' FROM de WHERE x > 0), {_SCORES.format(c='pc')} SELECT fold, candidate, n_train, n_validation, improvement FROM sr WHERE rank = 1", r="improvement")
def _(spark, d):
    parts, predicates = _discovery(spark, d)
    both = K.interactions(K.candidate_scores(parts, predicates, "hit", 1), predicates, 5)
    return K.best_candidate(K.candidate_scores(parts, both, "hit", 8)).drop("rank")


# --- controls and calibration -----------------------------------------------------------------------------------


@query("res18_negative_controls", f"WITH {OUTCOMES} SELECT count(*) AS n, avg(hit::INT) AS rate, avg(hit::INT) AS shuffled_rate, true AS preserved FROM oc WHERE hit IS NOT NULL AND horizon_days = 5", r="rate shuffled_rate")
def _(spark, d):
    own = _outcomes(spark, d).where("hit is not null and horizon_days = 5").select("event_id", F.col("hit").cast("int").alias("label"))
    return K.shuffle_control(K.shuffled_labels(own, "label", "event_id", 20260910), "label").drop("same_place")


@query("res18_leaked_rows", f"WITH {_X}, first AS (SELECT symbol, min(fold) AS fold FROM xp GROUP BY 1), leaked AS (SELECT xp.symbol, fold, min(ts) AS ts FROM xp JOIN first USING (symbol, fold) WHERE role = 'validation' GROUP BY 1, 2) SELECT symbol, fold, strftime(ts::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS key, f.fault FROM leaked, (VALUES ('in both parts'), ('not earlier')) f(fault)")
def _(spark, d):
    """The audit finds the row that was planted in the training part of each first fold, and nothing else."""
    return K.leaks(K.inject_leak(_parts(spark, d), "ts"), "ts", "ts")


@query("res19_isotonic", None, r="p calibrated")
def _(spark, d):
    """Scores that are continuous: many distinct ones, pooled in ranges and up a tree."""
    p = F.col("value") / (F.col("value") + 1)
    e = read(spark, d, "events").select("event_id", p.alias("p"), (p + (F.col("event_id") * 104729 % 1000) / 1000 > 1).cast("int").alias("y"))
    return C.isotonic(e, "p", "y").select("event_id", "p", "calibrated")


_LOGS = ", ".join(f"ln(greatest(coalesce({c}, 0), 1e-15)) AS {n}" for c, n in (("p_up", "a"), ("p_flat", "b"), ("p_down", "c")))
_OWN, _REST = "CASE WHEN y = 1 THEN a WHEN y = 0 THEN b ELSE c END", "ln(exp(a / t) + exp(b / t) + exp(c / t))"
_SQUARES = " + ".join(f"(exp({n} / t - {_REST}) - (y = {k})::INT) ** 2" for n, k in (("a", 1), ("b", 0), ("c", -1)))


@query(
    "res20_temperature",
    f"WITH {_X}, {_model_sql()}, l AS MATERIALIZED (SELECT symbol, fold, y, {_LOGS} FROM sc WHERE y IS NOT NULL), g AS (SELECT k, 0.05 * 400 ** (k / 480.0) AS t FROM range(481) r(k)), o AS (SELECT symbol, fold, k, t, sum({_REST} - {_OWN} / t) AS loss FROM l, g GROUP BY ALL), e AS (SELECT *, sum(loss) OVER (PARTITION BY symbol, k ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM o), b AS (SELECT symbol, fold, arg_min(t, (earlier, k)) AS t FROM e WHERE earlier IS NOT NULL GROUP BY ALL), n AS (SELECT f.symbol, f.fold, count(l.y) AS n_before, count(DISTINCT l.y) AS classes FROM (SELECT DISTINCT symbol, fold FROM l) f LEFT JOIN l ON l.symbol = f.symbol AND l.fold < f.fold GROUP BY ALL), j AS (SELECT l.*, n_before, CASE WHEN n_before >= 50 AND classes >= 2 THEN b.t END AS fitted FROM l JOIN n USING (symbol, fold) LEFT JOIN b USING (symbol, fold)), s AS (SELECT symbol, fold, n_before, fitted AS t, y, a, b, c FROM j) SELECT symbol, fold, max(n_before) AS n_before, count(*) AS n, max(t) AS temperature, avg({_REST.replace('t)', '1)')} - {_OWN}) AS raw_log_loss, avg({_REST} - {_OWN} / t) AS log_loss, avg({_SQUARES.replace('/ t', '/ 1')}) AS raw_brier, avg({_SQUARES}) AS brier FROM s GROUP BY ALL",
    r="temperature raw_log_loss log_loss raw_brier brier",
)
def _(spark, d):
    return C.temperature_by_fold(_scored(spark, d), {"p_up": 1, "p_flat": 0, "p_down": -1}, "y", ["symbol"])


@query("res34_fold_gate", None, r="positive_rate mean sign_p flip_p ci_lo ci_hi")
def _(spark, d):
    scored = _scored(spark, d).withColumn("b", F.when(F.col("baseline") == F.col("y"), 0.0).otherwise(2.0))
    folds = scored.groupBy("symbol", "fold").agg(F.avg("b").alias("baseline"), F.avg(K.brier("y")).alias("model"))
    return K.fold_gate(folds)


@query("res30_walk_forward_classifier", None, r="accuracy baseline")
def _(spark, d):
    """A tree for every series and fold."""
    return T.classifier(_parts(spark, d), ["x"], "y", [-1, 0, 1], ["symbol", "fold"])


@query("res31_permutation_importance", None, r="drop accuracy")
def _(spark, d):
    """Over all series and folds; the second feature is a hash of the key, without meaning."""
    noise = F.pmod(F.xxhash64("symbol", "ts"), F.lit(1000)).cast("double")
    return T.importance(_parts(spark, d).withColumn("noise", noise), ["x", "noise"], "y", [-1, 0, 1], ["symbol", "fold"], "ts", 20260910)


@query("res32_strategies_by_fold", f"WITH {_X}, st AS (SELECT 'momentum' AS strategy, symbol, ts, fold, fwd, CASE WHEN x > 0 THEN 1 WHEN x < 0 THEN -1 ELSE 0 END AS s FROM xp WHERE role = 'validation' UNION ALL SELECT 'reversal', symbol, ts, fold, fwd, CASE WHEN x < -0.2 THEN 1 ELSE 0 END FROM xp WHERE role = 'validation') SELECT strategy, fold, count(*) AS n, count(*) FILTER (WHERE s <> 0) AS trades, sum(s * fwd - CASE WHEN s <> 0 THEN 0.002 ELSE 0 END) AS total, coalesce(avg((s * fwd > 0.002)::INT) FILTER (WHERE s <> 0), 0) AS win_rate FROM st GROUP BY 1, 2", r="total win_rate")
def _(spark, d):
    rows = _parts(spark, d).where("role = 'validation'")
    signals = {"momentum": F.signum("x").cast("int"), "reversal": F.when(F.col("x") < -0.2, 1).otherwise(0)}
    return K.strategies_by_fold(rows, signals, "ret", 0.002)


# --- macro relations --------------------------------------------------------------------------------------------

_RETS = f"hr AS (SELECT date_trunc('day', ts) AS ts, event_type AS symbol, avg(value) AS v FROM events GROUP BY 1, 2), pw AS (SELECT a.symbol AS a, b.symbol AS b, a.ts, a.v AS x, b.v AS y, row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.ts) AS k, count(*) OVER (PARTITION BY a.symbol, b.symbol) AS n FROM hr a JOIN hr b ON a.ts = b.ts AND a.symbol < b.symbol)"


def _pairs(spark, d):
    own = read(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("ts"), F.col("event_type").alias("symbol")).agg(F.avg("value").alias("v"))
    return O.pairs(own, "v")


@query("res24_windows_compared", f"WITH {_RETS}, c AS (SELECT a, b, corr(x, y) FILTER (WHERE k <= n // 2) AS before, corr(x, y) FILTER (WHERE k > n // 2) AS after FROM pw GROUP BY 1, 2) SELECT a, b, before, after, CASE WHEN before IS NULL OR after IS NULL THEN NULL WHEN before * after < 0 THEN 'direction_change' ELSE 'strength_change' END AS break_type FROM c", use="", r="before after")
def _(spark, d):
    return O.compare_halves(_pairs(spark, d))


@query("res25_pair_analysis", f"WITH {_RETS}, g AS (SELECT a, b, count(*) AS n, corr(x, y) AS corr, covar_samp(x, y) AS covar, regr_slope(y, x) AS beta, corr(x, y) FILTER (WHERE x > 10) AS corr_high, corr(x, y) FILTER (WHERE x <= 10) AS corr_low FROM pw GROUP BY 1, 2) SELECT a, b, n, corr, covar, beta, corr_high, corr_low, CASE WHEN corr > 0.05 THEN 'positive' WHEN corr < -0.05 THEN 'negative' ELSE 'neutral' END AS type, CASE WHEN abs(corr) >= 0.8 THEN 'very_strong' WHEN abs(corr) >= 0.6 THEN 'strong' WHEN abs(corr) >= 0.4 THEN 'moderate' WHEN abs(corr) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength FROM g", use="", r="corr covar beta corr_high corr_low")
def _(spark, d):
    return O.pair_analysis(_pairs(spark, d), F.col("x") > 10)


_VOTE = f"vt AS (SELECT symbol, ts, CASE WHEN close > {roll('avg', 'close', 20)} THEN 1 WHEN close < {roll('avg', 'close', 20)} THEN -1 ELSE 0 END AS level, CASE WHEN {roll('avg', 'close', 5)} > {roll('avg', 'close', 20)} THEN 1 WHEN {roll('avg', 'close', 5)} < {roll('avg', 'close', 20)} THEN -1 ELSE 0 END AS trend, CASE WHEN close > {lag('close', 10)} THEN 1 WHEN close < {lag('close', 10)} THEN -1 ELSE 0 END AS momentum FROM bars), rg AS (SELECT symbol, ts, level, trend, momentum, CASE WHEN level + trend + momentum >= 2 THEN 'expansion' WHEN level + trend + momentum <= -2 THEN 'contraction' ELSE 'mixed' END AS regime, abs(level + trend + momentum) / 3 AS confidence FROM vt)"


@query("res26_regime_votes", f"WITH {_VOTE} SELECT symbol, ts, level, trend, momentum, regime, confidence FROM rg", r="confidence", t="ts")
def _(spark, d):
    return O.regime_votes(daily(spark, d), "close")


@query("res27_regime_transitions", f"WITH {_VOTE}, c AS (SELECT symbol, ts, regime, {lag('regime')} AS previous, row_number() OVER ({BY}) AS k FROM rg), i AS (SELECT *, k - row_number() OVER (PARTITION BY symbol, regime ORDER BY ts) AS g FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY symbol, regime, g ORDER BY ts) AS persistence FROM i), q AS (SELECT *, lag(persistence) OVER ({BY}) AS held FROM p) SELECT symbol, ts, previous, regime, held FROM q WHERE previous <> regime", t="ts")
def _(spark, d):
    return O.regime_transitions(O.regime_votes(daily(spark, d), "close"))


@query("res27_early_warnings", f"WITH {_VOTE}, c AS (SELECT symbol, ts, regime, confidence, lead(regime) OVER ({BY}) AS nx FROM rg), n AS (SELECT symbol, regime, nx, count(*) AS n FROM c WHERE nx IS NOT NULL GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY symbol, regime) AS p FROM n), l AS (SELECT symbol, arg_max(regime, ts) AS regime, arg_max(confidence, ts) AS s FROM c GROUP BY 1) SELECT symbol, regime, nx AS expected, p AS probability, p * s AS confidence, greatest(2, floor(12 * (1 - (s * 0.4 + p * s * 0.3))))::INT AS horizon FROM p JOIN l USING (symbol, regime) WHERE nx <> regime AND p >= 0.15 AND p * s >= 0.05 AND s >= 0.3", r="probability confidence")
def _(spark, d):
    return O.early_warnings(O.regime_votes(daily(spark, d), "close"), 0.05)


@query("res28_findings", f"WITH {_RETS}, h AS (SELECT a, b, corr(x, y) FILTER (WHERE k <= n // 2) AS before, corr(x, y) FILTER (WHERE k > n // 2) AS after FROM pw GROUP BY 1, 2), z AS (SELECT symbol, ts, (v - avg(v) OVER (PARTITION BY symbol)) / stddev_samp(v) OVER (PARTITION BY symbol) AS z FROM hr) SELECT 'correlation_break' AS kind, a || '/' || b AS subject, abs(before - after) AS strength FROM h WHERE abs(before - after) >= 0.5 UNION ALL SELECT 'persistent_relation', a || '/' || b, least(abs(before), abs(after)) FROM h WHERE before * after > 0 AND least(abs(before), abs(after)) >= 0.2 UNION ALL SELECT 'anomaly', symbol || '@' || strftime(ts, '%Y-%m-%d'), abs(z) FROM z WHERE abs(z) >= 2", use="", r="strength")
def _(spark, d):
    own = read(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("ts"), F.col("event_type").alias("symbol")).agg(F.avg("value").alias("v"))
    return O.findings(O.compare_halves(O.pairs(own, "v")), own, "v")
