"""Feature engineering, joins and windows (survey §2.4, D1–D22).

Per-recipient and per-peer statistics are aggregates joined back on their
keys (sort-merge or, when AQE sees a small side at run time, broadcast).
Order-dependent features (time-ordered history, previous amount, ranks,
splits of exact size) use the range-partitioned running primitive, so no
single recipient — however hot — is sorted inside one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.ordered import exact_quantiles, running, tie_average_rank
from ledgerlens.functions.skew import group_lookup
from ledgerlens.functions.stats import clean_double, safe_div, unit_hash, weekday_mon0
from ledgerlens.session import cut_lineage, fitted_params, sized_partitions

# Fixed values that must equal the reference's behaviour.
SPLIT_BINS = ((0.4, "train"), (0.5, "test"), (0.6, "validation"), (1.0, "production"))
MODEL_FEATURES = ("amount", "number_of_payments", "payment_year", "payment_month", "payment_quarter",
                  "payment_dayofweek", "is_weekend", "hist_pay_count", "hist_pay_total", "hist_pay_avg",
                  "hist_pay_std", "hist_pay_max", "amt_to_avg_ratio", "amt_to_max_ratio", "is_new_recipient",
                  "is_high_risk_nature")

# In the payments view the nature column is the order priority; this value
# plays the part of the reference's high-risk natures.
PAYMENTS_HIGH_RISK = ("1-URGENT",)


def _and(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


# ---------------------------------------------------------------- D1, D7
def calendar(df: DataFrame, date_col: str = "date_of_payment") -> DataFrame:
    """Year, month, quarter, Monday-0 weekday, weekend flag."""
    d = F.col(date_col)
    return df.withColumns({
        "payment_year": F.year(d),
        "payment_month": F.month(d),
        "payment_quarter": F.quarter(d),
        "payment_dayofweek": weekday_mon0(d),
        "is_weekend": (weekday_mon0(d) >= 5).cast("int"),
    })


def high_risk_flag(df: DataFrame, nature_col: str = "nature", natures: Sequence[str] = PAYMENTS_HIGH_RISK
                   ) -> DataFrame:
    """1 when the nature is on the high-risk list (NULL → 0)."""
    return df.withColumn("is_high_risk_nature", F.coalesce(F.col(nature_col).isin(*natures), F.lit(False)).cast("int"))


# ---------------------------------------------------------------- D2, D3, D10, D16, D17
def random_split(df: DataFrame, key: str = "record_id", seed: int = 42, out: str = "dataset_usage",
                 bins: Sequence[tuple[float, str]] = SPLIT_BINS) -> DataFrame:
    """40/10/10/40 split from a hash of the row key, right-closed bins
    like ``pd.cut`` (T9: exactly 0 falls outside → NULL)."""
    return df.withColumn(out, split_bins(unit_hash(key, seed), bins))


def split_bins(h: Column, bins: Sequence[tuple[float, str]] = SPLIT_BINS) -> Column:
    """``pd.cut(h, [0, …], labels)``: right-closed bins, 0 itself → NULL."""
    expr = None
    lo = 0.0
    for hi, label in bins:
        cond = (h > lo) & (h <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
        lo = hi
    return expr


def split_shares(df: DataFrame, col: str = "dataset_usage") -> DataFrame:
    """D3: rows and % per split label."""
    total = df.select(F.count(F.lit(1))).scalar()
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows")) \
             .withColumn("pct", F.round(F.col("n_rows") * 100.0 / total, 6))


def time_split(df: DataFrame, date_col: str, train_end: str, valid_end: str, out: str = "time_split") -> DataFrame:
    """Train before ``train_end`` ≤ validation < ``valid_end`` ≤ test."""
    d = F.col(date_col)
    return df.withColumn(out, F.when(d < F.lit(train_end).cast("timestamp_ntz"), "train")
                         .when(d < F.lit(valid_end).cast("timestamp_ntz"), "validation")
                         .when(d.isNotNull(), "test"))


def exact_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, label: str | None = None,
                out: str = "is_train") -> DataFrame:
    """D16 / D17 (``label`` set: stratified): rows ranked by md5(key ‖ seed);
    the first n − ceil(test_size·n) of each stratum are train, like
    ``train_test_split``.

    No row moves: counts over ``SPLIT_BUCKETS`` equal ranges of the hash tell the
    range that holds the last train row of a stratum, a second scan counts the keys of
    that range, and the split is a comparison with the key found there.  Where copies
    of one key lie on both sides, or the strata are too many for the driver, the rank
    is a running count spread by range."""
    strata = [label] if label else []
    src = df.select(*[F.col(c).alias("_label") for c in strata], F.col(key).alias("_key"), unit_hash(key, seed).alias("_h"))
    bucket = F.floor(F.col("_h") * SPLIT_BUCKETS).cast("int")
    keys = ["_label"] if label else []
    last = {}                                   # stratum -> (range, rank of its last train row inside the range)
    if not label or len(df.select(label).distinct().limit(MOST_STRATA + 1).collect()) <= MOST_STRATA:
        counted = src.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c")).toArrow()      # MOST_STRATA · SPLIT_BUCKETS rows at most
        groups: dict = {}
        for s, b, c in zip(counted["_label"].to_pylist() if label else [None] * len(counted), counted["_b"].to_pylist(), counted["_c"].to_pylist()):
            groups.setdefault(s, []).append((b, c))
        for s, pairs in groups.items():
            pairs.sort()
            left = (n := sum(c for _, c in pairs)) - math.ceil(n * test_size)
            for b, c in pairs:
                if left <= c:
                    last[s] = (b, left)
                    break
                left -= c
    same = lambda s: F.col("_label").eqNullSafe(F.lit(s)) if label else F.lit(True)
    near = [same(s) & (bucket == b) for s, (b, _) in last.items()]
    found: dict = {}
    if near:
        inside = src.where(reduce(lambda a, b: a | b, near)).groupBy(*keys, "_h", "_key").agg(F.count(F.lit(1)).alias("_c"))
        for r in inside.orderBy(*keys, "_h", "_key").limit(MOST_NEAR + 1).collect():
            found.setdefault(r["_label"] if label else None, []).append((r["_h"], r["_key"], r["_c"]))
    cuts = {}
    for s, (_, left) in last.items():
        cum = 0
        for h, k, c in found.get(s, []):
            cum += c
            if cum >= left:
                cuts[s] = (h, k, left == cum, left)
                break
    if not last or sum(map(len, found.values())) > MOST_NEAR or len(cuts) < len(last) or not all(whole or not left for _, _, whole, left in cuts.values()):
        return _ranked_split(df, key, test_size, seed, label, out)
    h, k = F.col("_h"), F.col(key)
    train = None
    for s, (at, key_at, _, left) in cuts.items():
        upto = k.isNull() if key_at is None else k.isNull() | (k <= F.lit(key_at).cast(df.schema[key].dataType))
        is_in = F.lit(False) if not left else (h < F.lit(at)) | ((h == F.lit(at)) & upto)
        mine = F.col(label).eqNullSafe(F.lit(s).cast(df.schema[label].dataType)) if label else F.lit(True)
        train = F.when(mine, is_in) if train is None else train.when(mine, is_in)
    return df.withColumn("_h", unit_hash(key, seed)).withColumn(out, train.cast("int")).drop("_h")


#: ranges of the hash, strata and keys of the last ranges that the driver counts
SPLIT_BUCKETS, MOST_STRATA, MOST_NEAR = 1 << 16, 16, 200_000


def _ranked_split(df: DataFrame, key: str, test_size: float, seed: int, label: str | None, out: str) -> DataFrame:
    """``exact_split`` by a running count over all rows."""
    groups = [label] if label else []
    src = df.withColumn("_h", unit_hash(key, seed)).withColumn("_one", F.lit(1))
    r = running(src, ["_h", key], ["_one"], groups, "sum", ["_rank"])
    if label:
        r = group_lookup(r, df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), [label], "inner")
    else:
        r = r.withColumn("_n", df.select(F.count(F.lit(1))).scalar())
    n_train = F.col("_n") - F.ceil(F.col("_n") * F.lit(test_size))
    return r.withColumn(out, (F.col("_rank") <= n_train).cast("int")).drop("_h", "_one", "_rank", "_n")


# ---------------------------------------------------------------- D4–D6 (random-split mode, as in the reference code)
def recipient_history(df: DataFrame, key: str = "recipient_id", amount: str = "amount") -> DataFrame:
    """Count, total, mean, sample std, max of amount per recipient (NULL keys dropped)."""
    x = clean_double(amount)
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.count(x).alias("hist_pay_count"), F.coalesce(F.sum(x), F.lit(0.0)).alias("hist_pay_total"),
                   F.avg(x).alias("hist_pay_avg"), F.stddev_samp(x).alias("hist_pay_std"),
                   F.max(x).alias("hist_pay_max")))


def attach_history(df: DataFrame, hist: DataFrame, key: str = "recipient_id") -> DataFrame:
    """Left equi join of the history onto every payment."""
    return group_lookup(df, hist, [key])


def history_ratios(df: DataFrame, global_median: Column, amount: str = "amount") -> DataFrame:
    """D6, in the reference's order: ratios, new-recipient flag, then fills
    (mean → global median; ratio to mean → amount / global median; rest → 0).
    Division by zero gives NULL and then takes the same fallback."""
    x = F.col(amount)
    out = df.withColumns({
        "amt_to_avg_ratio": safe_div(x, "hist_pay_avg"),
        "amt_to_max_ratio": safe_div(x, "hist_pay_max"),
        "is_new_recipient": F.col("hist_pay_avg").isNull().cast("int"),
    })
    out = out.withColumns({
        "hist_pay_avg": F.coalesce(F.col("hist_pay_avg"), global_median),
        "amt_to_avg_ratio": F.coalesce(F.col("amt_to_avg_ratio"), safe_div(x, global_median)),
        "hist_pay_count": F.coalesce(F.col("hist_pay_count").cast("double"), F.lit(0.0)),
        "hist_pay_total": F.coalesce(F.col("hist_pay_total"), F.lit(0.0)),
        "hist_pay_std": F.coalesce(F.col("hist_pay_std"), F.lit(0.0)),
        "hist_pay_max": F.coalesce(F.col("hist_pay_max"), F.lit(0.0)),
        "amt_to_max_ratio": F.coalesce(F.col("amt_to_max_ratio"), F.lit(0.0)),
    })
    return out


def random_history_features(df: DataFrame, key: str = "recipient_id", amount: str = "amount",
                            record_key: str = "record_id", seed: int = 42) -> DataFrame:
    """D2 + D4–D6 as the reference code does it (T15 ``history="random"``):
    history from the 'train' split, joined onto every row."""
    split = random_split(df, record_key, seed)
    train = split.where(F.col("dataset_usage") == "train")
    med = exact_quantiles(train, amount, [0.5], [], ["m"]).select("m").scalar()
    return history_ratios(attach_history(split, recipient_history(train, key, amount), key), med, amount)


# ---------------------------------------------------------------- D9 (leak-free, default)
def time_history(df: DataFrame, key: str = "recipient_id", date_col: str = "date_of_payment",
                 amount: str = "amount") -> DataFrame:
    """Each payment's recipient statistics over payments on strictly
    earlier days (no look-ahead, no same-day leakage).

    One exchange by recipient and a range window over its payments.  Recipients
    that hold a large share of the rows (``hot_keys``) go by their days instead
    (``_history_by_day``), as do rows without recipient or date, so no task sorts a
    hot recipient.  ``df`` is read more than once: pass a written table."""
    known = F.col(key).isNotNull() & F.to_date(F.col(date_col)).isNotNull()
    gaps = not df.where(~known).isEmpty()
    hot = hot_keys(df.where(known), key)
    ordinary = known & ~F.col(key).isin(hot) if hot else known
    out = _history_by_payment(df.where(ordinary) if gaps or hot else df, key, date_col, amount)
    return out.unionByName(_history_by_day(df.where(~ordinary), key, date_col, amount)) if gaps or hot else out


#: rows looked at for hot keys; a key of HOT_SHARE of them or more is hot
HOT_SAMPLE, HOT_SHARE = 200_000, 1 / 500


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys that hold about ``HOT_SHARE`` of the rows or more, 1 / ``HOT_SHARE`` of them
    at most.  Read off a bounded sample: it decides how rows travel, never a result."""
    n = df.count()
    if n * HOT_SHARE < HOT_ROWS:
        return []
    seen = df.select(key).sample(min(1.0, HOT_SAMPLE / n), 42).groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    share = min(n, HOT_SAMPLE) * HOT_SHARE
    return [r[0] for r in fitted_params(seen.where(F.col("_c") >= share))]


#: fewer rows of a key than this never make a task slow
HOT_ROWS = 20_000


def _history_by_payment(df: DataFrame, key: str, date_col: str, amount: str) -> DataFrame:
    """History by a range window over a recipient's payments; key and date known."""
    src = df.repartition(sized_partitions(df.sparkSession, df), key)
    src = src.withColumns({"_x": clean_double(amount), "_day": F.unix_date(F.to_date(F.col(date_col)))})
    whole = Window.partitionBy(key)
    w = whole.orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    # spread around a value of the recipient's own scale (the least of its first day),
    # so that large amounts with small differences keep their variance
    first = F.min(F.when(F.col("_x").isNotNull(), F.struct("_day", "_x"))).over(whole.orderBy("_day").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))["_x"]
    src = src.withColumn("_d", F.col("_x") - first)
    src = src.withColumns({"_n": F.count("_x").over(w).cast("double"), "_s": F.sum("_x").over(w), "_m": F.max("_x").over(w),
                           "_c1": F.sum("_d").over(w), "_c2": F.sum(F.col("_d") * F.col("_d")).over(w)})
    n = F.col("_n")
    var = F.when(n > 1, F.greatest((F.col("_c2") - F.col("_c1") * F.col("_c1") / n) / (n - 1), F.lit(0.0)))
    return src.select(*df.columns, n.alias("hist_pay_count"), F.coalesce("_s", F.lit(0.0)).alias("hist_pay_total"),
                      F.when(n > 0, F.col("_s") / n).alias("hist_pay_avg"), F.sqrt(var).alias("hist_pay_std"),
                      F.col("_m").alias("hist_pay_max"))


def _history_by_day(df: DataFrame, key: str, date_col: str, amount: str) -> DataFrame:
    """History of recipients of any size.

    Payments are first reduced to one row per (recipient, day) — map-side —
    then running sums/max over earlier days come from a window over that
    daily table, joined back on (recipient, day)."""
    x = clean_double(amount)
    day = F.to_date(F.col(date_col))
    daily = _daily(df, key, day, [F.count(x).alias("_n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("_s"), F.avg(x).alias("_a"),
                                  F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("_q"), F.max(x).alias("_m")])
    w = _per_recipient_days().rowsBetween(Window.unboundedPreceding, -1)
    # spread around a value of the recipient's own scale (the first day's mean), so
    # that large amounts with small differences keep their variance: with shifted
    # sums, M2 = Σ(M2 of the day) + Σ n·(a − c)² − (Σ n·(a − c))² / Σ n
    first = F.first("_a", ignorenulls=True).over(_per_recipient_days().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    daily = daily.withColumn("_d", F.coalesce(F.col("_a") - first, F.lit(0.0)))
    n = F.sum("_n").over(w)
    hist = daily.select("_k", "_day", F.coalesce(n, F.lit(0)).cast("double").alias("_cn"),
                        F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias("_cs"),
                        F.coalesce(F.sum("_q").over(w), F.lit(0.0)).alias("_cq"),
                        F.coalesce(F.sum(F.col("_n") * F.col("_d") * F.col("_d")).over(w), F.lit(0.0)).alias("_c2"),
                        F.coalesce(F.sum(F.col("_n") * F.col("_d")).over(w), F.lit(0.0)).alias("_c1"),
                        F.max("_m").over(w).alias("_cm"))
    n = F.col("_cn")
    m2 = F.col("_cq") + F.col("_c2") - F.col("_c1") * F.col("_c1") / n
    var = F.when(n > 1, F.greatest(m2 / (n - 1), F.lit(0.0)))
    hist = hist.select(F.col("_k"), F.col("_day"),
                       n.alias("hist_pay_count"), F.col("_cs").alias("hist_pay_total"),
                       F.when(n > 0, F.col("_cs") / n).alias("hist_pay_avg"),
                       F.sqrt(var).alias("hist_pay_std"), F.col("_cm").alias("hist_pay_max"))
    j = df.join(hist, (F.col(key) == F.col("_k")) & (day == F.col("_day")), "left").drop("_k", "_day")
    return j


def _daily(df: DataFrame, key: str, day: Column, aggs: list) -> DataFrame:
    """One row per (recipient, calendar day), aggregated map-side first."""
    return (df.where(F.col(key).isNotNull() & day.isNotNull())
              .groupBy(F.col(key).alias("_k"), day.alias("_day")).agg(*aggs))


def _per_recipient_days() -> Window:
    """Window over the daily table of one recipient, in day order.

    A window puts a whole partition-key group into one task.  Here a group
    is one recipient's *days*, not its payments: a recipient holding a third
    of all rows still has at most one row per calendar day, so a group is
    bounded by the data's date span (3,653 rows for ten years), whatever the
    row count.  Tables whose groups grow with the data use
    ``functions.ordered.running`` instead."""
    return Window.partitionBy("_k").orderBy(F.unix_date("_day"))


def time_history_features(df: DataFrame, key: str = "recipient_id", date_col: str = "date_of_payment",
                          amount: str = "amount") -> DataFrame:
    """D9 + D6: leak-free history with the reference's ratio and fill rules;
    the global median fallback is the median of all amounts."""
    return filled_history(time_history(df, key, date_col, amount), amount_median(df, amount), amount)


def amount_median(df: DataFrame, amount: str = "amount") -> Column:
    """The median of all amounts, a literal."""
    return F.lit(fitted_params(exact_quantiles(df, amount, [0.5], [], ["m"]))[0]["m"]).cast("double")


def filled_history(h: DataFrame, median: Column, amount: str = "amount") -> DataFrame:
    """D6 on a ``time_history`` table.  The average is read off total and count, so
    a stored history may do without it."""
    earlier = F.col("hist_pay_count") > 0
    h = h.withColumn("hist_pay_avg", F.when(earlier, F.col("hist_pay_total") / F.col("hist_pay_count")))
    h = h.withColumn("hist_pay_max", F.when(earlier, F.col("hist_pay_max")))
    return history_ratios(h, median, amount)


# ---------------------------------------------------------------- D8, D11–D13
def derived_features(agg: DataFrame, prefix: str = "amount_") -> DataFrame:
    """D8 on a C26 table: cv = std/(mean+1), log1p total, log1p mean, diversity."""
    out = agg.withColumns({
        "amount_cv": safe_div(F.col(f"{prefix}std"), F.col(f"{prefix}mean") + 1),
        "log_total_amount": F.log1p(F.col(f"{prefix}sum")),
        "log_mean_amount": F.log1p(F.col(f"{prefix}mean")),
    })
    if "form_nunique" in agg.columns:
        out = out.withColumn("payment_form_diversity", F.col("form_nunique"))
    if "nature_nunique" in agg.columns:
        out = out.withColumn("payment_nature_diversity", F.col("nature_nunique"))
    return out


# Consistency constant of the median absolute deviation for normal data
# (Iglewicz and Hoaglin's modified z-score).
MAD_Z = 0.6745


def peer_scores(df: DataFrame, value: str = "amount", peers: Sequence[str] = ("specialty", "recipient_state",
                                                                              "recipient_type")) -> DataFrame:
    """Z and robust z of ``value`` within its peer group.

    z = (x − mean)/std (sample std; NULL when std is 0 or undefined);
    robust z = 0.6745·(x − median)/MAD (NULL when MAD is 0).  Median and MAD
    are exact."""
    peers = list(peers)
    x = clean_double(value)
    src = df.withColumn("_x", x)
    mom = src.groupBy(*peers).agg(F.count("_x").alias("peer_n"), F.avg("_x").alias("peer_mean"),
                                  F.stddev_samp("_x").alias("peer_std"))
    # read three times below: written once
    med = cut_lineage(exact_quantiles(src, "_x", [0.5], peers, ["peer_median"]))
    dev = group_lookup(src.select(*peers, "_x"), med, peers, "inner")
    dev = dev.select(*peers, F.abs(F.col("_x") - F.col("peer_median")).alias("_d"))
    med = med.select(*[F.col(c).alias(f"_m_{c}") for c in peers], "peer_median")
    mad = exact_quantiles(dev, "_d", [0.5], peers, ["peer_mad"])
    mad = mad.select(*[F.col(c).alias(f"_q_{c}") for c in peers], "peer_mad")
    stats = (mom.join(med, _and([mom[c].eqNullSafe(med[f"_m_{c}"]) for c in peers]), "left")
                .join(mad, _and([mom[c].eqNullSafe(mad[f"_q_{c}"]) for c in peers]), "left")
                .select(*peers, "peer_n", "peer_mean", "peer_std", "peer_median", "peer_mad"))
    out = group_lookup(src, stats, peers)
    return out.withColumns({
        "peer_z": F.when(F.col("peer_std") > 0, (F.col("_x") - F.col("peer_mean")) / F.col("peer_std")),
        "peer_robust_z": F.when(F.col("peer_mad") > 0, F.lit(MAD_Z) * (F.col("_x") - F.col("peer_median"))
                                / F.col("peer_mad")),
    }).drop("_x")


def frequency_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Share of rows holding the same value (NULL is its own value)."""
    out = out or f"{col}_freq"
    total = df.select(F.count(F.lit(1))).scalar()
    j = group_lookup(df, df.groupBy(col).agg(F.count(F.lit(1)).alias("_fc")), [col])
    return j.withColumn(out, F.col("_fc") / total).drop("_fc")


#: stands for a missing amount in a running "last": below every finite double but the least
_NO_AMOUNT = -1.7976931348623157e308


def relationship_features(df: DataFrame, key: str = "recipient_id", payer: str = "payer_id",
                          date_col: str = "date_of_payment", amount: str = "amount",
                          order_key: str = "record_id") -> DataFrame:
    """Distinct payers per recipient, payments per (recipient, payer),
    previous payment amount of the recipient (time order, ties by row key) and
    the ratio to it."""
    div = df.groupBy(key).agg(F.countDistinct(payer).alias("payer_diversity"))
    rel = df.groupBy(key, payer).agg(F.count(F.lit(1)).alias("relationship_count"))
    # the previous row's amount, NULL or not: a missing amount travels as a marker
    src = df.withColumn("_amt", clean_double(amount)).withColumn("_seen", F.coalesce("_amt", F.lit(_NO_AMOUNT)))
    prev = running(src, [date_col, order_key], ["_seen"], [key], "last", ["prev_amount"], exclusive=True).drop("_seen")
    prev = prev.withColumn("prev_amount", F.when(F.col("prev_amount") != _NO_AMOUNT, F.col("prev_amount")))
    out = group_lookup(group_lookup(prev, div, [key]), rel, [key, payer])
    return out.withColumn("amount_change_ratio", safe_div("_amt", "prev_amount")).drop("_amt")


# ---------------------------------------------------------------- D14, D15
def robust_scale_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D14 fit: (column, center = median, scale = IQR, or 1 when IQR is 0 — T11)."""
    from ledgerlens.operators.clean import column_quantiles

    q = column_quantiles(df, cols, [0.25, 0.5, 0.75], ["q1", "center", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select("column", "center", F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"))


def minmax_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D15 fit: (column, center = min, scale = max − min); range 0 → output 0."""
    cols = list(cols)
    ends = [f(clean_double(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    r = fitted_params(df.agg(*ends), 1)[0]                   # one aggregate, no row a value
    rows = [(c, r[f"lo{i}"], None if r[f"lo{i}"] is None else r[f"hi{i}"] - r[f"lo{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, center double, scale double")


def scale_apply(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Apply a fitted (column, center, scale) table: (x − center)/scale, and 0
    where the scale is 0.  The table has one row per column (its size is fixed
    by the feature list), so it is collected once and enters as literals."""
    fitted = {r["column"]: r for r in fitted_params(params)}
    exprs = {}
    for c in cols:
        center, scale = float(fitted[c]["center"]), float(fitted[c]["scale"])
        exprs[c] = F.lit(0.0) if scale == 0 else (clean_double(c) - F.lit(center)) / F.lit(scale)
    return df.withColumns(exprs)


# ---------------------------------------------------------------- D18–D22
def score_percentile(df: DataFrame, score: str = "anomaly_score", out: str = "anomaly_score_percentile"
                     ) -> DataFrame:
    """``rank(pct=True) * 100`` with average ties."""
    return tie_average_rank(df, score, [], "_pr").withColumn(out, F.col("_pr") * 100.0).drop("_pr")


def cumulative_share(small: DataFrame, value: str, order: str, out: str = "cumulative_share") -> DataFrame:
    """Running share on a small table (one row per feature — its size is
    the feature count, so an unpartitioned window is bounded)."""
    w = Window.orderBy(F.col(value).desc(), F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    return small.withColumn(out, safe_div(F.sum(value).over(w), small.select(F.sum(value)).scalar()))


def top_n(df: DataFrame, score: str, key: str, n: int = 10, ascending: bool = True) -> DataFrame:
    """N rows by score (ties by key).  ``limit`` is the feature."""
    s = F.col(score).asc() if ascending else F.col(score).desc()
    return df.orderBy(s, F.col(key).asc()).limit(n)


def every_kth(df: DataFrame, order: str, key: str, max_points: int = 100) -> DataFrame:
    """Every k-th row of the ordered table, k = ceil(n / max_points)."""
    src = df.withColumn("_one", F.lit(1))
    r = running(src, [order, key], ["_one"], [], "sum", ["_rn"])
    n = df.select(F.count(F.lit(1))).scalar()
    step = F.greatest(F.ceil(n / F.lit(float(max_points))), F.lit(1))
    return r.where(((F.col("_rn") - 1) % step) == 0).withColumn("point_index", (F.col("_rn") - 1).cast("bigint")) \
            .drop("_one", "_rn")


def rolling_sums(df: DataFrame, key: str = "recipient_id", date_col: str = "date_of_payment",
                 amount: str = "amount", days: int = 30) -> DataFrame:
    """D13 (rolling sums): per recipient and day, the number and total of
    payments in the window [day − days, day].

    Payments are reduced to one row per (recipient, day) map-side; a range
    window over day numbers then sums the last ``days`` + 1 days (a group is
    one recipient's days, bounded by the date span — see
    ``_per_recipient_days``)."""
    x = clean_double(amount)
    day = F.to_date(F.col(date_col))
    daily = _daily(df, key, day, [F.count(x).alias("_n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("_s")])
    w = _per_recipient_days().rangeBetween(-days, 0)
    return daily.select(F.col("_k").alias(key), F.col("_day").alias("day"),
                        F.sum("_n").over(w).cast("bigint").alias(f"n_payments_{days}d"),
                        F.sum("_s").over(w).alias(f"total_amount_{days}d"))


def sudden_changes(df: DataFrame, since: str, key: str = "recipient_id", date_col: str = "date_of_payment", amount: str = "amount",
                   slack: float = 0.5, limit: float = 5.0) -> DataFrame:
    """D13 (sudden change): two-sided cumulative sums of a recipient's daily totals.

    Level and deviation (sample) come from the recipient's payment days before
    ``since``; from then on each payment day adds its distance from the level in
    deviations, less ``slack``, to the upward sum (and its negative to the
    downward one), which never falls below 0.  A sum above ``limit`` is a change.
    With prefix sums P that is P - min(0, least P so far), so two running windows
    give it.  Amounts count in whole cents and steps in millionths (of at most a
    million deviations): sums are exact in any order.

    One row per recipient with a payment day from ``since`` on: n_days, base_days,
    level, up_max, down_max (largest sums), up_since, down_since (first day above
    the limit, null if none).  With fewer than two days before or no deviation the
    sums are null.  Null keys, dates and amounts are left out.

    Payments are reduced to days map-side first: a window group is bounded by the
    date span, whatever share of the payments a recipient holds."""
    x = clean_double(amount)
    day = F.to_date(F.col(date_col))
    daily = _daily(df.where(x.isNotNull()), key, day, [F.sum(F.round(x * 100).cast("long")).cast("decimal(18,0)").alias("_x")])
    early = F.col("_day") < F.lit(since).cast("date")
    base = daily.where(early).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.sum("_x").cast("decimal(19,0)").alias("_s1"),
                                                F.sum(F.col("_x") * F.col("_x")).alias("_s2"))
    spread = (F.col("_n").cast("decimal(10,0)") * F.col("_s2") - F.col("_s1") * F.col("_s1")).cast("double")
    base = base.select("_k", "_n", (F.col("_s1").cast("double") / F.col("_n")).alias("_mean"),
                       F.when(spread > 0, F.sqrt(spread / (F.col("_n") * (F.col("_n") - 1)).cast("double"))).alias("_sd"))
    z = F.greatest(F.least((F.col("_x").cast("double") - F.col("_mean")) / F.col("_sd"), F.lit(1e6)), F.lit(-1e6))
    steps = (daily.where(~early).join(base, "_k", "left")
             .withColumn("_up", F.round((z - slack) * 1e6).cast("long")).withColumn("_down", F.round((-z - slack) * 1e6).cast("long")))
    w = Window.partitionBy("_k").orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.withColumns({"_pu": F.sum("_up").over(w), "_pd": F.sum("_down").over(w)}).withColumns(
        {"_su": F.col("_pu") - F.least(F.lit(0), F.min("_pu").over(w)), "_sd_": F.col("_pd") - F.least(F.lit(0), F.min("_pd").over(w))})
    over = lambda c: F.min(F.when(F.col(c) > int(limit * 1e6), F.col("_day")))
    most = lambda c: F.when(F.max("_sd").isNotNull(), F.max(c) / 1e6)
    return sums.groupBy(F.col("_k").alias(key)).agg(
        F.count(F.lit(1)).alias("n_days"), F.coalesce(F.max("_n"), F.lit(0)).cast("long").alias("base_days"),
        (F.max("_mean") / 100).alias("level"), most("_su").alias("up_max"), most("_sd_").alias("down_max"),
        F.when(F.max("_sd").isNotNull(), over("_su")).alias("up_since"), F.when(F.max("_sd").isNotNull(), over("_sd_")).alias("down_since"))
