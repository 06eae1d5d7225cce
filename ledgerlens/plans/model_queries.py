"""Registered model queries: isolation forest (E1–E4, E15, G10–G14, G27,
G30), reconstruction error (E5) and boosted trees (E8–E10).  Not expressible
in SQL: checked by rows here and by unit tests against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import clean as C
from ledgerlens.operators import evaluate as G
from ledgerlens.operators import features as D
from ledgerlens.operators import forest as IF
from ledgerlens.operators import models as M
from ledgerlens.plans.flagship import _memo, feature_table, scored_table
from ledgerlens.plans.registry import register
from ledgerlens.session import cut_lineage

BASELINE = {"n_trees": 200, "contamination": 0.05, "max_samples": "auto", "max_features": 1.0, "bootstrap": False}


def model_matrix(spark, sf):
    """16 features → drop > 50% missing (B18) → 3·IQR clip (B19) → median
    fill (B9) → robust scale on all rows (D14) → exact 80/20 split (D16)."""
    def build():
        f = feature_table(spark, sf)
        profile = C.missing_profile(f, list(D.MODEL_FEATURES))      # one pass serves B18 and the fill
        cols = C.drop_sparse_columns(f, list(D.MODEL_FEATURES), 0.5, profile)
        m = f.select("record_id", "recipient_id", "recipient_state", "nature", "date_of_payment",
                     F.col("amount").alias("raw_amount"), F.col("payment_year").alias("raw_year"), *cols)
        m, params = C.prepare_matrix(m, cols, 3.0, nulls=profile[1])
        # every fitted value is a literal by now: the matrix is computed where it is read
        return D.scale_apply(D.exact_split(m, "record_id", 0.2, 42), params, cols), cols
    return _memo("matrix", spark, sf, build)


def forest_model(spark, sf):
    def build():
        m, cols = model_matrix(spark, sf)
        return IF.fit(m.where(F.col("is_train") == 1), "record_id", cols, **BASELINE)
    return _memo("forest", spark, sf, build)


@register("e1_forest_nodes")
def e1(spark, sf):
    return forest_model(spark, sf).nodes


@register("e1_forest_sampling", """
SELECT 200 AS n_trees, least(256, n - CAST(ceil(n * 0.2) AS BIGINT)) AS min_root_rows,
       least(256, n - CAST(ceil(n * 0.2) AS BIGINT)) AS max_root_rows
FROM (SELECT count(*) AS n FROM payments WHERE abs(amount) > 0 AND date_of_payment IS NOT NULL AND recipient_id IS NOT NULL)""")
def e1s(spark, sf):
    """Every tree exists and holds exactly min(256, training rows) rows."""
    root = forest_model(spark, sf).nodes.where("node = 0")
    return root.agg(F.count(F.lit(1)).cast("int").alias("n_trees"), F.min("n_samples").cast("long").alias("min_root_rows"),
                    F.max("n_samples").cast("long").alias("max_root_rows"))


@register("e2_forest_scores")
def e2(spark, sf):
    m, _ = model_matrix(spark, sf)
    # the percentile rank reads the scores twice (value counts, then the join
    # back): write them once rather than run the tree traversal twice
    s = cut_lineage(IF.score(forest_model(spark, sf), m, "record_id", keep=["is_train"]))
    return D.score_percentile(s, "anomaly_score", "anomaly_score_percentile")


@register("e3_forest_flag_rates")
def e3(spark, sf):
    m, _ = model_matrix(spark, sf)
    s = IF.score(forest_model(spark, sf), m, "record_id", keep=["is_train"])
    return s.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.sum("is_anomaly").alias("n_flagged"),
                                     F.avg("is_anomaly").alias("flagged_rate"), F.avg("anomaly_score").alias("mean_score"))


@register("e4_forest_stability")
def e4(spark, sf):
    m, _ = model_matrix(spark, sf)
    return IF.stability(forest_model(spark, sf), m, "record_id")


@register("e5_reconstruction_error")
def e5(spark, sf):
    m, cols = model_matrix(spark, sf)
    mm = D.scale_apply(m, D.minmax_fit(m, cols), cols)   # the network's min-max inputs (D15)
    mm = mm.select("record_id", "is_train", *cols)           # only what the pass needs goes through Python
    r = M.reconstruction_detector(mm.where(F.col("is_train") == 1), mm, cols)
    return r.select("record_id", "is_train", "reconstruction_error", "threshold", "is_anomaly")


def gbt_rows(spark, sf):
    """Labelled rows of the boosted trees with their 80/20 split."""
    def build():
        from ledgerlens.operators import detect as E

        m, cols = model_matrix(spark, sf)
        # E6 on the model features; the reference's percentile rule labels every
        # row of this data (see README), so the "any extreme feature" rule is used
        # labels, split, fit and predictions read these rows many times: the matrix's
        # nested expressions are worked out once
        lab = E.pseudo_labels(cut_lineage(m.select("record_id", *cols)), cols, rule="any")
        lab = D.exact_split(lab.select("record_id", "pseudo_label", *cols), "record_id", 0.2, 42, label="pseudo_label", out="is_train")
        return lab.withColumn("_valid", F.col("is_train") == 0), cols
    return _memo("gbt_rows", spark, sf, build)


def _gbt(spark, sf):
    def build():
        lab, cols = gbt_rows(spark, sf)
        model, w = M.gbt_fit(lab, cols, "pseudo_label", validation_col="_valid")
        return model, lab, cols
    return _memo("gbt", spark, sf, build)


@register("e8_gbt_predictions")
def e8(spark, sf):
    model, lab, cols = _gbt(spark, sf)
    return M.gbt_predict(model, lab, cols).select("record_id", "is_train", "pseudo_label", "probability_1", "predicted")


@register("e8_prediction_rows", """
SELECT count(*) AS n_rows, count(*) AS n_records, CAST(0 AS BIGINT) AS out_of_range FROM payments
WHERE abs(amount) > 0 AND date_of_payment IS NOT NULL AND recipient_id IS NOT NULL""")
def e8r(spark, sf):
    """Every cleaned payment has one prediction, and probabilities lie in 0..1."""
    p = e8(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record_id").alias("n_records"),
                 F.sum((~F.col("probability_1").between(0, 1)).cast("long")).alias("out_of_range"))


@register("e10_gbt_importances")
def e10(spark, sf):
    model, _, cols = _gbt(spark, sf)
    imp = M.importances(spark, model, cols)
    return D.cumulative_share(imp, "importance", "feature")     # D19 on the importance table


@register("e9_gbt_evaluation")
def e9(spark, sf):
    model, lab, cols = _gbt(spark, sf)
    # counts and curves read the predictions several times: the trees are walked once
    p = cut_lineage(M.gbt_predict(model, lab, cols).select("is_train", "pseudo_label", "probability_1", "predicted"))
    rows = []
    for split, name in ((1, "train"), (0, "test")):
        part = p.where(F.col("is_train") == split)
        auc = G.roc_auc(part, "probability_1", "pseudo_label").select("roc_auc").scalar()
        rows.append(G.classification_report(part, "pseudo_label", "predicted")
                    .withColumn("split", F.lit(name)).withColumn("roc_auc", auc))
    return rows[0].unionByName(rows[1])


def _search_data(spark, sf):
    m, cols = model_matrix(spark, sf)
    train = m.where(F.col("is_train") == 1)
    t2 = D.exact_split(train.drop("is_train"), "record_id", 0.25, 42, out="_hp")
    return t2.where(F.col("_hp") == 1).drop("_hp"), t2.where(F.col("_hp") == 0).drop("_hp"), cols


def _grid_results(spark, sf):
    def build():
        tr, va, cols = _search_data(spark, sf)
        return cut_lineage(IF.search(tr, va, "record_id", cols, IF.grid_candidates()))
    return _memo("grid_search", spark, sf, build)


@register("g10_grid_search")
def g10(spark, sf):
    return _grid_results(spark, sf)


@register("g10_grid_space", """
SELECT 48 AS n_candidates, 150 AS min_trees, 250 AS max_trees, 0.03 AS min_contamination, 0.07 AS max_contamination, 24 AS n_bootstrap""",
          payments=False)
def g10s(spark, sf):
    """The grid search scored its whole space."""
    return _grid_results(spark, sf).agg(
        F.countDistinct("candidate").cast("int").alias("n_candidates"), F.min("n_estimators").alias("min_trees"),
        F.max("n_estimators").alias("max_trees"), F.min("contamination").alias("min_contamination"),
        F.max("contamination").alias("max_contamination"), F.sum(F.col("bootstrap").cast("int")).cast("int").alias("n_bootstrap"))


def _random_results(spark, sf):
    def build():
        tr, va, cols = _search_data(spark, sf)
        return cut_lineage(IF.search(tr, va, "record_id", cols, IF.random_candidates(30, 42)))
    return _memo("random_search", spark, sf, build)


@register("g11_random_search")
def g11(spark, sf):
    return _random_results(spark, sf)


@register("g12_cv_grid_search")
def g12(spark, sf):
    m, cols = model_matrix(spark, sf)
    return IF.cv_search(m.where(F.col("is_train") == 1), "record_id", cols, IF.grid_candidates(IF.FOLD_GRID), folds=2)


def _tuned_scores(spark, sf):
    """Scores of the baseline forest and of the tuned one: the best candidate of
    grid and random search (by score, then search and number), fitted anew on all
    training rows."""
    def build():
        m, cols = model_matrix(spark, sf)
        train = m.where(F.col("is_train") == 1)
        found = (_grid_results(spark, sf).withColumn("search", F.lit("grid"))
                 .unionByName(_random_results(spark, sf).withColumn("search", F.lit("random"))))
        best = G.top_configurations(found, "score", 1).first()
        tuned = IF.fit(train, "record_id", cols, best["n_estimators"], int(best["max_samples"]), best["contamination"],
                       best["max_features"], best["bootstrap"])
        parts = [IF.score(f, m, "record_id", keep=["is_train"]).withColumn("model", F.lit(name))
                 for name, f in (("baseline", forest_model(spark, sf)), ("tuned", tuned))]
        return cut_lineage(parts[0].unionByName(parts[1]))
    return _memo("tuned", spark, sf, build)


@register("g15_tuned_vs_baseline")
def g15t(spark, sf):
    """Tuned forest against the baseline on the test rows."""
    return G.model_comparison(_tuned_scores(spark, sf).where(F.col("is_train") == 0), "model", "anomaly_score", "is_anomaly")


@register("g29_tuned_flag_rates")
def g29t(spark, sf):
    """Flagged share of both forests on training and test rows."""
    return G.flagged_rate_by_split(_tuned_scores(spark, sf), "is_train", "model", "is_anomaly")


@register("g29_tuned_rows", """
SELECT m.model, s.is_train, CASE s.is_train WHEN 1 THEN n - t ELSE t END AS n
FROM (SELECT count(*) AS n, CAST(ceil(count(*) * 0.2) AS BIGINT) AS t FROM payments
      WHERE abs(amount) > 0 AND date_of_payment IS NOT NULL AND recipient_id IS NOT NULL),
     (VALUES (0), (1)) s(is_train), (VALUES ('baseline'), ('tuned')) m(model)""")
def g29r(spark, sf):
    """Both forests scored every row once, in the exact 80/20 split."""
    return _tuned_scores(spark, sf).groupBy("model", "is_train").agg(F.countDistinct("record_id").alias("n"))


@register("g13_mean_score_by_param")
def g13(spark, sf):
    return G.mean_by_param(_random_results(spark, sf).where(F.col("score") > F.lit(float("-inf"))), "max_samples")


@register("g13_grid_mean_score_by_param")
def g13g(spark, sf):
    return G.mean_by_param(_grid_results(spark, sf).where(F.col("score") > F.lit(float("-inf"))), "n_estimators")


@register("g14_param_correlation")
def g14(spark, sf):
    r = _random_results(spark, sf).where(F.col("score") > F.lit(float("-inf")))
    return G.param_correlation(r, ["n_estimators", "contamination", "max_features"])


@register("g27_best_so_far")
def g27(spark, sf):
    return G.best_so_far(_random_results(spark, sf), "candidate")


@register("g30_top_configurations")
def g30(spark, sf):
    return G.top_configurations(_random_results(spark, sf), "score", 10)


@register("e15_batch_scoring")
def e15(spark, sf):
    """Batch scoring of the feature table: nested result per payment (all 16
    features recomputed from the tables, T20) — the totals are in
    ``e15_batch_totals``."""
    m, _ = model_matrix(spark, sf)
    # the payment's own values travel through the scoring pass: no join back
    s = IF.score(forest_model(spark, sf), m, "record_id", keep=["recipient_id", "raw_amount", "raw_year", "nature", "recipient_state"])
    return s.select("record_id", F.struct(
        F.struct(F.col("recipient_id").alias("profile_id"), F.col("raw_amount").alias("amount"), F.col("raw_year").alias("year"),
                 "nature", F.col("recipient_state").alias("state")).alias("record"),
        "anomaly_score", (F.col("is_anomaly") == 1).alias("is_anomaly"), "confidence").alias("result"))


@register("e15_batch_totals")
def e15t(spark, sf):
    r = e15(spark, sf)
    return r.agg(F.count(F.lit(1)).alias("total_records"),
                 F.sum(F.col("result.is_anomaly").cast("long")).alias("anomalies_detected"),
                 (F.avg(F.col("result.is_anomaly").cast("double")) * 100).alias("anomaly_rate_pct"),
                 F.avg("result.record.amount").alias("avg_amount_all"),
                 F.avg(F.when(F.col("result.is_anomaly"), F.col("result.record.amount"))).alias("avg_amount_anomaly"))


_VALID_ROWS = """payments WHERE abs(amount) > 0 AND date_of_payment IS NOT NULL AND recipient_id IS NOT NULL"""


@register("e2_score_rows", f"""
SELECT count(*) AS n_rows, count(*) AS n_records, CAST(0 AS BIGINT) AS out_of_range FROM {_VALID_ROWS}""")
def e2r(spark, sf):
    """One forest score per cleaned payment, raw scores in -1..0, percentiles in 0..100."""
    bad = ~F.col("raw_score").between(-1, 0) | ~F.col("anomaly_score_percentile").between(0, 100)
    return e2(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record_id").alias("n_records"),
                             F.sum(bad.cast("long")).alias("out_of_range"))


@register("e5_error_rows", f"""
SELECT count(*) AS n_rows, count(*) AS n_records, CAST(0 AS BIGINT) AS misflagged FROM {_VALID_ROWS}""")
def e5r(spark, sf):
    """One reconstruction error per cleaned payment; flagged exactly above the threshold."""
    wrong = (F.col("is_anomaly") == 1) != (F.col("reconstruction_error") > F.col("threshold"))
    return e5(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record_id").alias("n_records"),
                             F.sum(wrong.cast("long")).alias("misflagged"))


@register("e10_importance_total", """
SELECT CAST(count(*) AS BIGINT) AS n_features, 1.0::DOUBLE AS total FROM (SELECT unnest(range(16)))""", payments=False)
def e10s(spark, sf):
    """The importances of the 16 features add up to one."""
    return e10(spark, sf).agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum("importance"), 6).alias("total"))


@register("e15_result_rows", f"""
SELECT count(*) AS n_rows, count(*) AS n_records, round(sum(abs(amount)), 2) AS total_amount FROM {_VALID_ROWS}""")
def e15r(spark, sf):
    """One nested result per cleaned payment, with the payment's own amount."""
    return e15(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record_id").alias("n_records"),
                              F.round(F.sum("result.record.amount"), 2).alias("total_amount"))
