"""Folds, evaluation, model and artefact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadwatch import settings as S
from roadwatch.functions import columns as C
from roadwatch.operators import anchors, boosting, calibration as K, encoding as enc, evaluation as V, learning as L, neighbours as N, ranking, rules, stats
from roadwatch.plans import corridors, deployment as dep, spatial as geo
from roadwatch.plans.registry import FEATURES_SQL, artefact, features, hash_sql, incidents, on_features, query, spatial
from roadwatch.session import new_folder
from roadwatch.sources import collections, documents as D

# ---------------------------------------------------------------------- folds
_HASHED = f", hf AS (SELECT *, {hash_sql('id', 42)} AS h FROM ft)"


def folds_sql(label):
    return FEATURES_SQL + _HASHED + (
        f", fo AS (SELECT *, CAST((row_number() OVER (PARTITION BY {label} ORDER BY h, id) - 1) % 5 AS INTEGER) AS fold FROM hf)")


def encoding_sql(column, target, source="fo", out="te"):
    return (f", {out} AS (SELECT id, fold, {target} AS y, coalesce(prior + (m - prior) / (1 + exp(-(n - 20) / 20.0::DOUBLE)), prior) AS score FROM (SELECT r.*, "
            f"c.n - x.n AS n, (c.s - x.s) / nullif(c.n - x.n, 0)::DOUBLE AS m, (t.s - f.s) / (t.n - f.n)::DOUBLE AS prior FROM {source} r "
            f"JOIN (SELECT {column}, count(*) AS n, sum({target}) AS s FROM {source} GROUP BY 1) c USING ({column}) "
            f"JOIN (SELECT {column}, fold, count(*) AS n, sum({target}) AS s FROM {source} GROUP BY 1, 2) x USING ({column}, fold) "
            f"JOIN (SELECT fold, count(*) AS n, sum({target}) AS s FROM {source} GROUP BY 1) f USING (fold), "
            f"(SELECT count(*) AS n, sum({target}) AS s FROM {source}) t))")


@query("stratified_folds", folds_sql("closure") + " SELECT id, closure, fold FROM fo")
def stratified_folds(spark, sf):
    return ranking.stratified_folds(features(spark, sf).select("id", "closure"), "closure")


@query("kfolds", FEATURES_SQL + _HASHED + " SELECT id, CAST(h % 5 AS INTEGER) AS fold FROM hf")
def kfolds(spark, sf):
    return ranking.kfolds(features(spark, sf).select("id"))


@query("fold_split", folds_sql("closure") + " SELECT fold, count(*) AS validation, (SELECT count(*) FROM fo) - count(*) AS training, "
       "CAST(sum(closure) AS BIGINT) AS positives FROM fo GROUP BY 1")
def fold_split(spark, sf):
    per_fold = stratified_folds(spark, sf).groupBy("fold").agg(
        F.count("*").alias("validation"), F.sum("closure").alias("positives")).persist()
    total = per_fold.agg(F.sum("validation")).scalar()
    return per_fold.withColumn("training", total - F.col("validation"))


def rule_scores(spark, sf):
    """Priority score of each row: its corridor's High rate in the other folds."""
    ft = features(spark, sf).select("id", "corridor_cat", "high")
    rows = ranking.stratified_folds(ft, "high").persist()
    out = enc.out_of_fold_encoding(rows, "corridor_cat", "high", "score")
    return out.select("id", "fold", F.col("high").alias("y"), F.round("score", 9).alias("score"))


RULE_SQL = folds_sql("high") + encoding_sql("corridor_cat", "high", out="te0") + ", te AS (SELECT id, fold, y, round(score, 9) AS score FROM te0)"


@query("out_of_fold_encoding", RULE_SQL + " SELECT id, fold, round(score, 6) AS score FROM te")
def out_of_fold_encoding(spark, sf):
    return rule_scores(spark, sf).select("id", "fold", F.round("score", 6).alias("score"))


# ----------------------------------------------------------------- evaluation
def auc_sql(by=""):
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return (f"SELECT {head}sum(p * (cn - n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auc FROM (SELECT *, sum(n) OVER ({part} ORDER BY score) AS cn FROM "
            f"(SELECT {head}score, sum(y) AS p, sum(1 - y) AS n FROM te GROUP BY {head}score)) {group}")


@query("auc_rank", RULE_SQL + f" SELECT round(auc, 6) AS auc FROM ({auc_sql()})")
def auc_rank(spark, sf):
    return V.auc(rule_scores(spark, sf), "score", "y").select(F.round("auc", 6).alias("auc"))


CAUSE_SQL = folds_sql("closure") + encoding_sql("cause_cat", "closure", out="te0") + ", te AS (SELECT id, fold, y, round(score, 9) AS score FROM te0)"


@query("cause_only_auc", CAUSE_SQL + f" SELECT round(avg(auc), 6) AS mean_auc, count(*) AS folds FROM ({auc_sql('fold')})")
def cause_only_auc(spark, sf):
    rows = ranking.stratified_folds(features(spark, sf).select("id", "cause_cat", "closure"), "closure").persist()
    scored = enc.out_of_fold_encoding(rows, "cause_cat", "closure", "score").withColumn("score", F.round("score", 9))
    per_fold = V.auc(scored, "score", "closure", by=["fold"])
    return per_fold.agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.count("*").alias("folds"))


_CURVE = (", hs AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM te GROUP BY 1), cu AS (SELECT score, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, "
          "(SELECT sum(y) FROM te) AS t FROM hs WINDOW w AS (ORDER BY score DESC))")


@query("pr_curve", RULE_SQL + _CURVE + " SELECT round(score, 6) AS score, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / t::DOUBLE, 6) AS recall FROM cu")
def pr_curve(spark, sf):
    return V.pr_curve(rule_scores(spark, sf), "score", "y").select(
        *[F.round(c, 6).alias(c) for c in ("score", "precision", "recall")])


@query("average_precision", RULE_SQL + _CURVE + " SELECT round(sum(p / t::DOUBLE * tp / (tp + fp)::DOUBLE), 6) AS average_precision FROM cu")
def average_precision(spark, sf):
    out = V.average_precision(rule_scores(spark, sf), "score", "y")
    return out.select(F.round("average_precision", 6).alias("average_precision"))


_SWEEP = (", th AS (SELECT round(0.05::DOUBLE + i * 0.01::DOUBLE, 12) AS threshold FROM range(91) t(i)), "
          "tp AS (SELECT threshold, sum(y) FILTER (WHERE score >= threshold) AS tp, count(*) FILTER (WHERE score >= threshold) AS pp, sum(y) AS t FROM th, te GROUP BY 1), "
          "sw AS (SELECT threshold, round(coalesce(tp, 0) / greatest(pp, 1)::DOUBLE, 6) AS precision, round(coalesce(tp, 0) / t::DOUBLE, 6) AS recall, "
          "round(2 * coalesce(tp, 0) / (pp + t)::DOUBLE, 6) AS f1 FROM tp)")


def _sweep(spark, sf):
    out = V.threshold_sweep(rule_scores(spark, sf), "score", "y")
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("threshold_sweep", RULE_SQL + _SWEEP + " SELECT * FROM sw")
def threshold_sweep(spark, sf):
    return _sweep(spark, sf)


@query("best_threshold", RULE_SQL + _SWEEP + " SELECT * FROM sw ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf):
    return V.best_threshold(_sweep(spark, sf))


@query("probability_histogram", RULE_SQL + " SELECT CAST(least(floor(score * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM te GROUP BY 1")
def probability_histogram(spark, sf):
    return V.histogram(rule_scores(spark, sf), "score")


DURATION_SQL = FEATURES_SQL + _HASHED + (
    ", fo AS (SELECT *, CAST(h % 5 AS INTEGER) AS fold, ln(1 + duration_h) AS log_h FROM hf WHERE duration_h BETWEEN 0 AND 720)"
    + encoding_sql("cause_cat", "log_h", out="te0") + ", te AS (SELECT te0.id, y, round(score, 9) AS score, cause_cat FROM te0 JOIN fo USING (id))")


def cause_mean_predictions(spark, sf):
    """Log duration predicted by the cause's out-of-fold mean: the floor any model must beat."""
    logs = L.log_durations(features(spark, sf)).select("id", "cause_cat", "log_h")
    rows = ranking.kfolds(logs).persist()
    out = enc.out_of_fold_encoding(rows, "cause_cat", "log_h", "predicted")
    return out.withColumn("predicted", F.round("predicted", 9))


@query("regression_metrics", DURATION_SQL + " SELECT count(*) AS n, round(avg(abs(exp(y) - exp(score))), 4) AS mae_h, round(median(abs(exp(y) - exp(score))), 4) AS median_ae_h, "
       "round(1 - sum((y - score) ** 2) / (var_pop(y) * count(*)), 4) AS r2_log FROM te")
def regression_metrics(spark, sf):
    out = V.regression_metrics(cause_mean_predictions(spark, sf), "log_h", "predicted")
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("mae_h", "median_ae_h", "r2_log")])


_MARGIN = ", mg AS (SELECT cause_cat, quantile_cont(y - score, 0.9) AS margin FROM te GROUP BY 1)"


@query("conformal_margin", DURATION_SQL + _MARGIN + " SELECT cause_cat, round(margin, 6) AS margin FROM mg")
def conformal_margin(spark, sf):
    return L.conformal_margin(cause_mean_predictions(spark, sf), "predicted").select("cause_cat", F.round("margin", 6).alias("margin"))


@query("p90_coverage", DURATION_SQL + _MARGIN + " SELECT count(*) AS n, round(avg(CAST(y <= score + greatest(margin, 0) + 1e-7 AS INTEGER)), 4) AS coverage FROM te JOIN mg USING (cause_cat)")
def p90_coverage(spark, sf):
    oof = cause_mean_predictions(spark, sf).persist()
    out = L.with_p90(oof, L.conformal_margin(oof, "predicted"), "predicted", F.lit(0.0))
    out = out.withColumn("p90_log", F.col("p90_log") + 1e-7)   # rows exactly on the margin count as covered
    return L.coverage(out).select("n", F.round("coverage", 4).alias("coverage"))


# ------------------------------------------------------------- attached scores
_SCORED = "(SELECT id, impact_score FROM im WHERE id % 10 <> 0)"


def _scores(spark, sf):
    return dep.impact(spark, sf).filter(F.col("id") % 10 != 0).select(
        "id", F.col("impact_score").alias("composite_impact_score"), "closure_probability")


@query("attach_scores", dep.rules_sql(f"SELECT i.id, coalesce(s.impact_score, 5.0::DOUBLE) / 10 AS impact_weight FROM incidents i LEFT JOIN {_SCORED} s USING (id)"))
def attach_scores(spark, sf):
    return D.attach_scores(incidents(spark, sf).select("id"), _scores(spark, sf)).select("id", "impact_weight")


@query("read_scores", dep.rules_sql(f"SELECT i.id, s.impact_score AS composite_impact_score, coalesce(s.impact_score, 5.0::DOUBLE) / 10 AS impact_weight FROM incidents i LEFT JOIN {_SCORED} s USING (id)"))
def read_scores(spark, sf):
    path = new_folder(spark, "scores")
    _scores(spark, sf).write.parquet(path)
    out = D.attach_scores(incidents(spark, sf).select("id"), spark.read.parquet(path))
    return out.select("id", "composite_impact_score", "impact_weight")


@query("align_predictions", dep.rules_sql("SELECT i.id, i.status, im.impact_score FROM incidents i JOIN im USING (id)"))
def align_predictions(spark, sf):
    return incidents(spark, sf).select("id", "status").join(dep.impact(spark, sf).select("id", "impact_score"), "id")


@query("score_distribution", dep.rules_sql("SELECT impact_score, count(*) AS n FROM im GROUP BY 1"))
def score_distribution(spark, sf):
    return L.score_distribution(dep.impact(spark, sf), "impact_score")


@query("score_summary", dep.rules_sql("SELECT round(avg(impact_score), 6) AS mean, median(impact_score)::DOUBLE AS median FROM im"))
def score_summary(spark, sf):
    """Ten possible scores: the exact median keeps at most ten counters."""
    return dep.impact(spark, sf).agg(F.round(F.avg("impact_score"), 6).alias("mean"), F.median("impact_score").alias("median"))


_MED = "(SELECT cause_cat, median(duration_h) AS m, count(*) AS n FROM ft WHERE duration_h BETWEEN 0 AND 720 GROUP BY 1)"


@query("duration_fallback", on_features(
    f"SELECT ft.id, round(CASE WHEN n < 400 THEN m ELSE 1.0 END, 6) AS p50_h, round(CASE WHEN n < 400 THEN m * 2 ELSE 2.5 END, 6) AS p90_h FROM ft LEFT JOIN {_MED} USING (cause_cat)"))
def duration_fallback(spark, sf):
    """Causes below 400 examples fall back here, so that the feed has some of each kind."""
    ft = features(spark, sf)
    medians = stats.cause_medians(ft, min_examples=400)
    flat = ft.select("id", "cause_cat", F.lit(1.0).alias("p50_h"), F.lit(2.5).alias("p90_h"))
    out = L.duration_fallback(flat, medians, F.lit(1.0))
    return out.select("id", F.round("p50_h", 6).alias("p50_h"), F.round("p90_h", 6).alias("p90_h"))


# ---------------------------------------------------------------------- models
#: trees of the registered models and configurations of the search
TREES, CONFIGURATIONS = 100, 20
FOLDS = range(S.N_FOLDS)
NEARBY = boosting.Counted("nearby_closure_rate", "closure", "nearby_n", "nearby_s", weight=1.0)
_PLAIN = (*S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
_RESTRICTED = (*S.NUMERIC_FEATURES, *S.PRIORITY_CATEGORICAL)


def _family(name, label, whole=True, **params):
    """One model per fold left out, and one of all rows."""
    return [boosting.Spec(name, label, held_out=f, trees=TREES, **params) for f in [*FOLDS, *([None] if whole else [])]]


def _grown(spark, sf, name, build) -> boosting.Grown:
    """Fitted models are artefacts too: saved once, with their scores, and loaded from then on."""
    def made():
        path = new_folder(spark, name)
        build().save(path)
        return spark.createDataFrame([(path,)], "path string")
    return boosting.Grown.load(spark, artefact(spark, sf, name, made).first().path)


def training(spark, sf):
    """Features with folds that both labels are even in, and the closures near by, counted per fold."""
    def made():
        ft = ranking.stratified_folds(features(spark, sf).withColumn("_both", F.col("closure") * 2 + F.col("high")), "_both").drop("_both")
        return N.nearby_fold_counts(ft, "closure", S.N_FOLDS, NEARBY.n, NEARBY.s)
    return artefact(spark, sf, "training", made)


def label_models(spark, sf) -> boosting.Grown:
    """Closure with and without the nearby rate, priority with all columns and in its restricted form: grown together."""
    specs = [*_family("closure", "closure", balanced=True), *_family("closure without nearby", "closure", False, balanced=True, features=_PLAIN),
             *_family("priority", "high"), *_family("priority restricted", "high", features=_RESTRICTED)]
    return _grown(spark, sf, "label-models", lambda: boosting.grow(
        training(spark, sf), specs, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES, S.N_FOLDS, counted=[NEARBY]))


def duration_training(spark, sf):
    return ranking.kfolds(features(spark, sf).withColumn("log_h", F.when(C.usable_duration(F.col("duration_h")), F.log1p("duration_h"))))


def duration_models(spark, sf) -> boosting.Grown:
    """Median and 0.9 quantile of log hours, grown together; rows without a usable duration train nothing."""
    specs = [*_family("p50", "log_h", loss="quantile", quantile=0.5), *_family("p90", "log_h", loss="quantile", quantile=0.9)]
    return _grown(spark, sf, "duration-models", lambda: boosting.grow(
        duration_training(spark, sf), specs, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES, S.N_FOLDS))


def closure_oof(spark, sf):
    return label_models(spark, sf).held_out("closure", "closure_p")


@query("closure_model")
def closure_model(spark, sf):
    return label_models(spark, sf).score(training(spark, sf), {"closure": "closure_p"}).select("id", "closure", "closure_p")


@query("oof_predictions")
def oof_predictions(spark, sf):
    return closure_oof(spark, sf).select("id", F.col("closure").cast("int").alias("closure"), "fold", "closure_p")


@query("closure_threshold")
def closure_threshold(spark, sf):
    return V.best_threshold(V.threshold_sweep(closure_oof(spark, sf), "closure_p", "closure"))


def fitted_threshold(spark, sf) -> float:
    return closure_threshold(spark, sf).first().threshold


@query("random_search")
def random_search(spark, sf):
    return artefact(spark, sf, "search", lambda: L.random_search(features(spark, sf), "closure", CONFIGURATIONS)).orderBy(
        F.desc(F.round("mean_auc", 9)), "iterations", "step", "depth", "subsample")


def tuned_models(spark, sf) -> boosting.Grown:
    """The search's winner, fitted again on five folds and on all rows, with the nearby rate."""
    best = random_search(spark, sf).first()
    params = dict(trees=best.iterations, step=best.step, depth=best.depth, subsample=best.subsample)
    specs = [boosting.Spec("tuned", "closure", held_out=f, balanced=True, **params) for f in [*FOLDS, None]]
    return _grown(spark, sf, "tuned-models", lambda: boosting.grow(
        training(spark, sf), specs, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES, S.N_FOLDS, counted=[NEARBY]))


@query("tuned_closure_auc")
def tuned_closure_auc(spark, sf):
    """The winning configuration and its quality on rows that it was not fitted on."""
    oof = tuned_models(spark, sf).held_out("tuned", "tuned_p")
    best = random_search(spark, sf).limit(1).drop("mean_auc")
    return best.crossJoin(V.auc(oof, "tuned_p", "closure")).withColumn("average_precision", V.average_precision(oof, "tuned_p", "closure").scalar())


def tuned_calibrated(spark, sf):
    """Held-out scores of the tuned model, each calibrated by the other folds."""
    oof = tuned_models(spark, sf).held_out("tuned", "tuned_p")
    return K.apply(oof, K.fit_other_folds(oof, "tuned_p", "closure", S.N_FOLDS), "tuned_p", "calibrated_p", F.col("fold"))


@query("nearby_feature_gain")
def nearby_feature_gain(spark, sf):
    """Held-out AUC of the closure model with the nearby closure rate and without it."""
    grown = label_models(spark, sf)
    parts = [V.auc(grown.held_out(name, "p"), "p", "closure").select(F.lit(name).alias("model"), "auc") for name in ("closure", "closure without nearby")]
    return parts[0].unionByName(parts[1])


@query("isotonic_calibration")
def isotonic_calibration(spark, sf):
    """Each held-out closure score calibrated by the other folds."""
    oof = closure_oof(spark, sf)
    out = K.apply(oof, K.fit_other_folds(oof, "closure_p", "closure", S.N_FOLDS), "closure_p", "calibrated_p", F.col("fold"))
    return out.select("id", F.col("closure").cast("int").alias("closure"), "closure_p", "calibrated_p")


#: max-min formula over the distinct scores of each group g: points pt (g, score, s, w) to fit(g, score, value)
ISOTONIC_SQL = (", cs AS (SELECT g, score, sum(s) OVER o AS cs, sum(w) OVER o AS cw, s, w, row_number() OVER o AS i FROM pt WINDOW o AS (PARTITION BY g ORDER BY score)), "
                "av AS (SELECT a.g, a.i AS lo, b.i AS hi, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)::DOUBLE AS m FROM cs a JOIN cs b ON a.g = b.g AND a.i <= b.i), "
                "mi AS (SELECT c.g, c.i, lo, min(m) AS m FROM cs c JOIN av ON av.g = c.g AND lo <= c.i AND hi >= c.i GROUP BY 1, 2, 3), "
                "fit AS (SELECT g, score, value FROM cs JOIN (SELECT g, i, max(m) AS value FROM mi GROUP BY 1, 2) USING (g, i))")


@query("isotonic_rule_scores", RULE_SQL + ", pt AS (SELECT 0 AS g, score, sum(y) AS s, count(*) AS w FROM te GROUP BY 2)" + ISOTONIC_SQL
       + " SELECT id, round(value, 6) AS calibrated FROM te JOIN fit USING (score)")
def isotonic_rule_scores(spark, sf):
    """Corridor-rule scores calibrated by one isotonic fit."""
    rows = rule_scores(spark, sf)
    out = K.apply(rows, K.fit(rows, "score", "y"), "score", "calibrated")
    return out.select("id", F.round("calibrated", 6).alias("calibrated"))


@query("isotonic_other_folds", RULE_SQL + ", pt AS (SELECT f AS g, score, sum(y) AS s, count(*) AS w FROM te JOIN (SELECT range AS f FROM range(5)) ON f <> fold GROUP BY 1, 2)" + ISOTONIC_SQL
       + " SELECT g AS fold, round(score, 6) AS score, round(value, 6) AS value FROM fit")
def isotonic_other_folds(spark, sf):
    """The five cross-fitted calibrations of the corridor-rule scores, at the scores they were fitted on."""
    rows = rule_scores(spark, sf)
    fits = K.fit_other_folds(rows, "score", "y", S.N_FOLDS)
    points = rows.select(F.explode(F.sequence(F.lit(0), F.lit(S.N_FOLDS - 1))).alias("g"), "fold", "score").where("g != fold").select("g", "score").distinct()
    out = K.apply(points, fits, "score", "value", F.col("g"))
    return out.select(F.col("g").cast("bigint").alias("fold"), F.round("score", 6).alias("score"), F.round("value", 6).alias("value"))


@query("priority_model")
def priority_model(spark, sf):
    return label_models(spark, sf).score(training(spark, sf), {"priority": "priority_p"}).select("id", "high", "priority_p")


def priority_oof(spark, sf):
    """Held-out scores of the restricted form."""
    return label_models(spark, sf).held_out("priority restricted", "priority_p").withColumn("high", F.col("high").cast("int"))


@query("priority_restricted")
def priority_restricted(spark, sf):
    """Priority without corridor and station, which give the rule away; every row scored by a model that has not seen it."""
    return priority_oof(spark, sf).select("id", "high", "priority_p")


@query("priority_oof_auc")
def priority_oof_auc(spark, sf):
    """Quality of the restricted priority model on rows it was not fitted on."""
    oof = priority_oof(spark, sf)
    return V.auc(oof, "priority_p", "high").withColumn("average_precision", V.average_precision(oof, "priority_p", "high").scalar())


@query("priority_calibration")
def priority_calibration(spark, sf):
    """Each held-out priority score calibrated by the other folds."""
    oof = priority_oof(spark, sf)
    return K.apply(oof, K.fit_other_folds(oof, "priority_p", "high", S.N_FOLDS), "priority_p", "calibrated_p", F.col("fold")).select(
        "id", "high", "priority_p", "calibrated_p")


@query("closure_oof_quality")
def closure_oof_quality(spark, sf):
    """AUC and average precision of the closure model's held-out scores."""
    oof = closure_oof(spark, sf)
    return V.auc(oof, "closure_p", "closure").withColumn("average_precision", V.average_precision(oof, "closure_p", "closure").scalar())


def duration_oof(spark, sf):
    """Held-out quantiles of log hours, of rows with a usable duration."""
    grown = duration_models(spark, sf)
    p90 = grown.held_out("p90", "p90_raw").select("id", "p90_raw")
    both = grown.held_out("p50", "p50_log").where("log_h is not null").join(p90, "id")
    return both.withColumn("p90_log", F.greatest("p90_raw", "p50_log")).drop("p90_raw")


@query("duration_p50")
def duration_p50(spark, sf):
    return V.regression_metrics(duration_oof(spark, sf), "log_h", "p50_log")


@query("duration_p90")
def duration_p90(spark, sf):
    return L.coverage(duration_oof(spark, sf))


@query("duration_pinball")
def duration_pinball(spark, sf):
    """Held-out quantile losses: the quantile models, and the median with each cause's margin from the other folds' residuals."""
    oof = duration_oof(spark, sf).join(features(spark, sf).select("id", "cause_cat"), "id").persist()
    dealt = oof.withColumn("g", F.explode(F.array(*[F.lit(f) for f in FOLDS]))).where("g != fold").withColumn("residual", F.col("log_h") - F.col("p50_log"))
    margins = ranking.exact_quantiles(dealt, ["g", "cause_cat"], "residual", {"margin": 0.9}, 1e-4).withColumnRenamed("g", "fold")
    both = oof.join(F.broadcast(margins), ["fold", "cause_cat"], "left").withColumn("conformal", F.col("p50_log") + F.coalesce("margin", F.lit(0.0)))
    return both.agg(F.count("*").alias("n"), F.avg(L.pinball("log_h", "p50_log", 0.5)).alias("p50_loss"), F.avg(L.pinball("log_h", "p90_log", 0.9)).alias("p90_loss"),
                    F.avg(L.pinball("log_h", "conformal", 0.9)).alias("conformal_p90_loss"))


def importances(spark, grown, name):
    return spark.createDataFrame(grown.importances(name), "feature string, importance double").orderBy(F.desc("importance"), "feature")


@query("feature_importance")
def feature_importance(spark, sf):
    return importances(spark, label_models(spark, sf), "closure")


@query("priority_importance")
def priority_importance(spark, sf):
    return importances(spark, label_models(spark, sf), "priority")


@query("duration_importance")
def duration_importance(spark, sf):
    return importances(spark, duration_models(spark, sf), "p50")


@query("top_features")
def top_features(spark, sf):
    top = feature_importance(spark, sf).limit(12)
    label = F.replace(F.replace("feature", F.lit("_"), F.lit(" ")), F.lit(" cat"), F.lit(""))
    return top.select(label.alias("name"), F.round(F.col("importance") * 100, 2).alias("importance"))


def predictions(spark, sf):
    """The tuned closure model and the restricted priority model, both calibrated on held-out scores, and both duration quantiles."""
    rows = training(spark, sf)
    tuned, labels = tuned_models(spark, sf), label_models(spark, sf)
    threshold = V.best_threshold(V.threshold_sweep(tuned_calibrated(spark, sf), "calibrated_p", "closure")).first().threshold
    scored = labels.score(tuned.score(rows, {"tuned": "raw_closure"}), {"priority restricted": "raw_priority"})
    scored = duration_models(spark, sf).score(scored.drop("fold"), {"p50": "p50_log", "p90": "p90_log"})
    scored = K.apply(scored, K.fit(tuned.held_out("tuned", "p"), "p", "closure"), "raw_closure", "closure_p")
    scored = K.apply(scored, K.fit(priority_oof(spark, sf), "priority_p", "high"), "raw_priority", "priority_p")
    scored = scored.withColumn("p50_h", F.greatest(F.expm1("p50_log"), F.lit(0.0)))
    scored = scored.withColumn("p90_h", F.greatest(F.expm1("p90_log"), F.col("p50_h")))
    ft = features(spark, sf)
    medians = stats.cause_medians(ft)
    overall = stats.duration_quantiles(ft, {"m": 0.5}).scalar()
    log_p95 = stats.log_duration_p95(ft).scalar()
    return L.predict_impact(scored, medians, overall, log_p95, threshold)


@query("predict_impact")
def predict_impact(spark, sf):
    return artefact(spark, sf, "impact-scores", lambda: predictions(spark, sf))


@query("load_models")
def load_models(spark, sf):
    """Scores of a priority model read back from its folder."""
    return label_models(spark, sf).score(training(spark, sf), {"priority": "priority_p"}).groupBy("corridor_cat").agg(
        F.count("*").alias("n"), F.round(F.avg("priority_p"), 6).alias("mean_p"))


@query("save_models", "SELECT count(*) AS n, count(*) AS same FROM events")
def save_models(spark, sf):
    """Save, load, and compare the scores of both on the whole table."""
    fitted = label_models(spark, sf)
    path = new_folder(spark, "model-copy")
    fitted.save(path)
    again = boosting.Grown.load(spark, path)
    rows = training(spark, sf)
    a = fitted.score(rows, {"closure": "p1"}).select("id", "p1")
    b = again.score(rows, {"closure": "p2"}).select("id", "p2")
    return a.join(b, "id").agg(F.count("*").alias("n"), F.count_if(F.col("p1") == F.col("p2")).alias("same"))


# -------------------------------------------------------------------- artefacts
@query("write_duration_fallback", on_features(
    f"SELECT m.cause_cat, round(m, 6) AS median_h, n AS n_examples, n < 30 AS is_fallback, (SELECT round(median(duration_h), 6) FROM ft WHERE duration_h BETWEEN 0 AND 720) AS global_median_h, "
    f"(SELECT round(quantile_cont(ln(1 + duration_h), 0.95), 6) FROM ft WHERE duration_h BETWEEN 0 AND 720) AS duration_log_p95 FROM {_MED} m"))
def write_duration_fallback(spark, sf):
    path = new_folder(spark, "fallback")
    threshold = fitted_threshold(spark, sf)
    D.write_json(D.fallback_document(features(spark, sf), closure_threshold=threshold), path)
    schema = ("global_median_h double, duration_log_p95 double, cause_medians map<string,double>, n_examples map<string,bigint>, "
              "fallback_causes array<string>")
    doc = spark.read.schema(schema).json(path)
    each = doc.select("*", F.explode("cause_medians").alias("cause_cat", "median_h"))
    return each.select("cause_cat", "median_h", F.element_at("n_examples", F.col("cause_cat")).alias("n_examples"),
                       F.array_contains("fallback_causes", F.col("cause_cat")).alias("is_fallback"), "global_median_h", "duration_log_p95")


@query("write_run_metadata", geo.DBSCAN_SQL + " SELECT (SELECT count(*) FROM incidents) AS n_rows_raw, count(*) AS n_rows_total, 500.0::DOUBLE AS eps_metres, 5 AS min_samples, "
       "count(DISTINCT cluster_id) FILTER (WHERE cluster_id >= 0) AS n_clusters, count(*) FILTER (WHERE cluster_id < 0) AS n_noise, "
       "(SELECT round(avg(closure), 4) FROM sp) AS overall_closure_baseline FROM dbl")
def write_run_metadata(spark, sf):
    path = new_folder(spark, "metadata")
    raw = incidents(spark, sf).agg(F.count("*").alias("n_rows_raw")).scalar()
    base = spatial(spark, sf).agg(F.round(F.avg("closure"), 4)).scalar()
    counts = geo.K.cluster_counts(geo.clustered(spark, sf))
    D.write_json(counts.select(
        F.lit("v1").alias("version"), F.current_timestamp().cast("string").alias("trained_at"), raw.alias("n_rows_raw"),
        F.col("n_rows").alias("n_rows_total"), F.struct(
            F.lit(S.EPS_METRES).alias("eps_metres"), F.lit(S.MIN_SAMPLES).alias("min_samples"), "n_clusters", "n_noise").alias("dbscan"),
        F.struct(F.lit(S.KDE_FACTOR).alias("bandwidth"), F.lit(S.KDE_GRID).alias("grid_size")).alias("kde"),
        base.alias("overall_closure_baseline")), path)
    doc = spark.read.json(path)
    return doc.select("n_rows_raw", "n_rows_total", "dbscan.eps_metres", F.col("dbscan.min_samples").cast("int").alias("min_samples"),
                      "dbscan.n_clusters", "dbscan.n_noise", "overall_closure_baseline")


_LEVELS = ("HIGH", "MEDIUM", "LOW")


@query("write_area_metadata", "SELECT * FROM (" + geo.STATS_SQL + " SELECT count(*) AS clusters, "
       + ", ".join(f"count(*) FILTER (WHERE risk_level = '{v}') AS {v.lower()}_clusters" for v in _LEVELS) + " FROM st) a, ("
       + corridors.RISK_SQL + " SELECT count(*) AS corridors, CAST(sum(event_count) AS BIGINT) AS corridor_events, "
       + ", ".join(f"count(*) FILTER (WHERE risk_tier = '{v}') AS {v.lower()}_corridors" for v in _LEVELS)
       + f", {S.LAT_MIN}::DOUBLE AS lat_min, {S.LAT_MAX}::DOUBLE AS lat_max, {S.LON_MIN}::DOUBLE AS lon_min, {S.LON_MAX}::DOUBLE AS lon_max FROM cr) b")
def write_area_metadata(spark, sf):
    """The spatial part of the run's metadata: the box, clusters by risk level and corridors by tier; one row, counted before it meets."""
    def by_level(column):
        return [F.count_if(F.col(column) == v).alias(v.lower()) for v in _LEVELS]

    path = new_folder(spark, "area-metadata")
    tiers = corridors.risk(spark, sf).agg(
        F.struct(F.count("*").alias("n"), F.sum("event_count").alias("events"), *by_level("risk_tier"))).scalar()
    box = F.struct(*[F.lit(getattr(S, n)).alias(n.lower()) for n in ("LAT_MIN", "LAT_MAX", "LON_MIN", "LON_MAX")])
    levels = F.struct(F.count("*").alias("n"), *by_level("risk_level"))
    D.write_json(geo.cluster_table(spark, sf).agg(levels.alias("clusters")).select("clusters", tiers.alias("corridors"), box.alias("box")), path)
    doc = spark.read.json(path)
    return doc.select(F.col("clusters.n").alias("clusters"), F.col("corridors.n").alias("corridors"), F.col("corridors.events").alias("corridor_events"),
                      *[F.col(f"{part}.{v.lower()}").alias(f"{v.lower()}_{part}") for part in ("clusters", "corridors") for v in _LEVELS], "box.*")


@query("export_plans", dep.rules_sql(
    "SELECT incident_id, impact_score, recommended_officers, recommended_barricades FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM pl) WHERE rn <= 20",
    dep.ALL_CASES + " WHERE assigned_to_police_id IS NOT NULL"))
def export_plans(spark, sf):
    """The published report shows the first 20 comparisons."""
    report = anchors.anchor_comparison(incidents(spark, sf), corridors.risk(spark, sf))
    path = new_folder(spark, "plans")
    D.write_json(report.orderBy(F.expr("try_cast(incident_id AS bigint)"), "incident_id").limit(20), path)
    return spark.read.json(path).select(
        "incident_id", F.col("engine_impact_score").cast("int").alias("impact_score"),
        F.col("engine_recommended_officers").cast("int").alias("recommended_officers"),
        F.col("engine_recommended_barricades").cast("int").alias("recommended_barricades"))


@query("export_set", dep.rules_sql(
    "SELECT 'plans' AS document, count(*) AS entries, CAST(sum(recommended_officers) AS BIGINT) AS officers FROM pl "
    "UNION ALL SELECT 'comparisons', count(*), CAST(sum(recommended_officers) AS BIGINT) FROM (SELECT recommended_officers FROM pl "
    "WHERE id IN (SELECT id FROM incidents WHERE assigned_to_police_id IS NOT NULL) ORDER BY id LIMIT 20) "
    "UNION ALL SELECT 'templates', 16, NULL UNION ALL SELECT 'validation', 1, NULL"))
def export_set(spark, sf):
    """The whole export: every plan, the first comparisons, the decision table and the validation summary, each a JSON document
    written in parallel, read back with its entries counted."""
    inc, risk = incidents(spark, sf), corridors.risk(spark, sf)
    report = anchors.anchor_comparison(inc, risk)
    plans = rules.recommend_batch(dep.impact(spark, sf), risk).withColumn("_at", F.expr("try_cast(incident_id AS bigint)"))
    first = report.withColumn("_at", F.expr("try_cast(incident_id AS bigint)")).orderBy("_at", "incident_id").limit(20)
    summary = anchors.validation_summary(report)
    tables = {"plans": (plans, ["_at", "incident_id"]), "comparisons": (first, ["_at", "incident_id"]),
              "templates": (rules.all_templates(spark), ["template_cause"]), "validation": (summary, ["n_cases"])}
    made = []
    for name, (table, order) in tables.items():
        path = new_folder(spark, f"export-{name}")
        ends = spark.createDataFrame([(f'{{"document":"{name}","entries":[', '],"complete":true}')], "head string, tail string")
        fields = F.struct(*[F.col(c) for c in table.columns if c != "_at"])
        written = collections.write_document(table, F.to_json(fields), order, path, ends)
        officers = {"plans": "recommended_officers", "comparisons": "engine_recommended_officers"}.get(name)
        entries = collections.read_entries(spark, path, f"{officers or '_none'} int")
        total = F.sum(f"entry.{officers}") if officers else F.lit(None)
        made.append(entries.agg(F.lit(name).alias("document"), F.count("*").alias("entries"), total.cast("bigint").alias("officers"), F.lit(written).alias("written")))
    out = made[0]
    for other in made[1:]:
        out = out.unionByName(other)
    return out.where("entries = written").drop("written")
