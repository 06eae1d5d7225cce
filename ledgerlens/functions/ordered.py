"""Order-dependent operators without a single-partition window.

A window ``OVER (PARTITION BY g ORDER BY v)`` puts a whole group in one task
and a window with no ``PARTITION BY`` puts the whole table there.  Either
breaks when one key holds a third of the rows.  The primitive here spreads the
ordered data by *range* over many tasks instead:

1. ``repartitionByRange`` on (group keys, order keys) and sort inside each
   partition, so a hot group spans many partitions;
2. one Arrow pass per partition (``mapInPandas``) computes the running value
   inside the partition and emits, per partition, at most two summary rows
   (its first and its last group; only those can cross a partition border);
3. the result is checkpointed (reliable, so both readers see the same
   partition ids even after an executor is lost);
4. the summary rows — at most ``2 × partitions``, a bound that does not grow
   with the data — get their carry from earlier partitions with a small
   window and are broadcast back onto the data rows.

Running sums (``how="sum"``) serve exact quantiles, tie-averaged percentile
ranks, ROC curves and AUC; ``how="last"`` (last non-NULL value so far) serves
forward and backward fill.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.skew import group_lookup
from ledgerlens.session import cut_lineage, fitted_params, shuffle_partitions

_PID = "_ll_pid"
_KIND = "_ll_kind"


def _same_key(a: tuple, b: tuple) -> bool:
    if a is None or b is None:
        return False
    for x, y in zip(a, b):
        xn = x is None or (isinstance(x, float) and math.isnan(x))
        yn = y is None or (isinstance(y, float) and math.isnan(y))
        if xn or yn:
            if not (xn and yn):
                return False
        elif x != y:
            return False
    return True


def _row_key(pdf: pd.DataFrame, cols: Sequence[str], i: int) -> tuple:
    if not cols:
        return ()
    return tuple(pdf[c].iat[i] for c in cols)


def _segments(pdf: pd.DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Contiguous group id per row (rows are sorted by ``cols``)."""
    if not cols:
        return np.zeros(len(pdf), dtype=np.int64)
    return pdf.groupby(list(cols), dropna=False, sort=False).ngroup().to_numpy()


def _combine(how: str, a: np.ndarray, carry: float) -> np.ndarray:
    if how == "sum":
        return a + carry
    if how == "max":
        return np.where(np.isnan(a), carry, np.fmax(a, carry))
    return np.where(np.isnan(a), carry, a)


def _local_pass(group_cols: Sequence[str], value_cols: Sequence[str], out_cols: Sequence[str], hows: Sequence[str],
                exclusive: bool = False):
    group_cols, value_cols, out_cols, hows = list(group_cols), list(value_cols), list(out_cols), list(hows)

    def running_values(vals: pd.DataFrame, seg: np.ndarray) -> pd.DataFrame:
        out = {}
        for c, how in zip(value_cols, hows):
            s = vals[c]
            if how == "sum":
                out[c] = s.fillna(0.0).groupby(seg, sort=False).cumsum()
            elif how == "max":
                out[c] = s.groupby(seg, sort=False).cummax().groupby(seg, sort=False).ffill()
            else:
                out[c] = s.groupby(seg, sort=False).ffill()
        return pd.DataFrame(out, index=vals.index)

    def run(batches):
        carry_key = None
        carry = None           # running value of the group open at the batch border
        first_key = None
        first_val = None       # running value at the end of the partition's first group
        first_done = False
        pid = None
        template = None
        for pdf in batches:
            if pdf.empty:
                continue
            if template is None:
                template = pdf.iloc[:0]
                pid = int(pdf[_PID].iat[0])
                first_key = _row_key(pdf, group_cols, 0)
            seg = _segments(pdf, group_cols)
            vals = pdf[value_cols].astype("float64")
            run_vals = running_values(vals, seg)
            # rows of the first segment continue the group open at the border
            head = seg == seg[0]
            continues = carry is not None and _same_key(carry_key, _row_key(pdf, group_cols, 0))
            if continues:
                for j, c in enumerate(value_cols):
                    col = run_vals[c].to_numpy(copy=True)
                    col[head] = _combine(hows[j], col[head], carry[j])
                    run_vals[c] = col
            emit_vals = run_vals
            if exclusive:
                # value over strictly earlier rows of the same group
                emit_vals = run_vals.groupby(seg, sort=False).shift(1)
                if continues:
                    for j, c in enumerate(value_cols):
                        col = emit_vals[c].to_numpy(copy=True)
                        col[0] = carry[j]
                        emit_vals[c] = col
            if not first_done:
                changed = np.nonzero(seg != seg[0])[0] if _same_key(first_key, _row_key(pdf, group_cols, 0)) else np.array([0])
                if len(changed):
                    k = int(changed[0])
                    # k == 0: the first group ended exactly at the previous batch border
                    first_val = run_vals.iloc[k - 1].to_numpy() if k > 0 else carry
                    first_done = True
            last = len(pdf) - 1
            carry_key = _row_key(pdf, group_cols, last)
            carry = run_vals.iloc[last].to_numpy()
            out = pdf.copy()
            for c, o in zip(value_cols, out_cols):
                out[o] = emit_vals[c].to_numpy()
            out[_KIND] = 0
            yield out
        if template is None:
            return
        if not first_done:
            first_val = carry
        rows = [(first_key, first_val)]
        if not _same_key(first_key, carry_key):
            rows.append((carry_key, carry))
        summary = []
        for key, vals in rows:
            rec = {c: None for c in template.columns}
            rec[_PID] = pid
            for c, v in zip(group_cols, key):
                rec[c] = v
            for o, v in zip(out_cols, vals):
                rec[o] = float(v) if v is not None and not np.isnan(v) else None
            rec[_KIND] = 1
            summary.append(rec)
        yield pd.DataFrame(summary, columns=list(template.columns) + list(out_cols) + [_KIND])

    return run


def running(df: DataFrame, order_cols: Sequence[str | Column], value_cols: Sequence[str],
            group_cols: Sequence[str] = (), how: str | Sequence[str] = "sum", out_cols: Sequence[str] | None = None,
            num_partitions: int | None = None, exclusive: bool = False) -> DataFrame:
    """Running sum (``how="sum"``), running max (``"max"``) or last non-NULL
    value (``"last"``) of ``value_cols`` within ``group_cols``, in
    ``order_cols`` order; NULL values are skipped.  Inclusive of the current row unless
    ``exclusive=True`` (then: over strictly earlier rows; a sum over no rows
    is 0, a max or last over no rows is NULL).

    ``order_cols`` may hold sort expressions (``F.col(c).desc()``).  Ties in
    the order keys are split in an arbitrary but fixed way; callers that need
    tie semantics aggregate to distinct keys first.  Output columns are
    doubles.
    """
    group_cols = list(group_cols)
    value_cols = list(value_cols)
    hows = [how] * len(value_cols) if isinstance(how, str) else list(how)
    assert len(hows) == len(value_cols) and all(h in ("sum", "max", "last") for h in hows)
    out_cols = list(out_cols or [f"{h}_{c}" for h, c in zip(hows, value_cols)])
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    order_exprs = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    sort_exprs = [F.col(c) for c in group_cols] + order_exprs
    # the range sampler and the write below both read the input; when it ends
    # in a shuffle (the usual case: counts per key) the second read reuses the
    # shuffle files, so no cache is needed
    ranged = (df.repartitionByRange(n, *sort_exprs)
                .sortWithinPartitions(*sort_exprs)
                .withColumn(_PID, F.spark_partition_id()))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in ranged.schema.fields]
                          + [T.StructField(o, T.DoubleType(), True) for o in out_cols]
                          + [T.StructField(_KIND, T.IntegerType(), False)])
    staged = cut_lineage(ranged.mapInPandas(_local_pass(group_cols, value_cols, out_cols, hows, exclusive), schema))

    summary = staged.where(F.col(_KIND) == 1).select(_PID, *group_cols, *out_cols)
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    agg = {"sum": F.sum, "max": F.max, "last": lambda o: F.last(o, ignorenulls=True)}
    carries = [agg[h](o).over(w).alias(f"_c_{o}") for h, o in zip(hows, out_cols)]
    offsets = summary.select(F.col(_PID).alias("_o_pid"),
                             *[F.col(c).alias(f"_o_{c}") for c in group_cols], *carries)
    data = staged.where(F.col(_KIND) == 0)
    cond = [data[_PID] == offsets["_o_pid"]] + [data[c].eqNullSafe(offsets[f"_o_{c}"]) for c in group_cols]
    # offsets hold at most two rows per partition: a bound set by the plan, not the data
    joined = data.join(F.broadcast(offsets), reduce(lambda a, b: a & b, cond), "left")
    fixed = []
    for how, o in zip(hows, out_cols):
        if how == "sum":
            fixed.append((F.coalesce(F.col(o), F.lit(0.0)) + F.coalesce(F.col(f"_c_{o}"), F.lit(0.0))).alias(o))
        elif how == "max":
            fixed.append(F.greatest(F.col(o), F.col(f"_c_{o}")).alias(o))
        else:
            fixed.append(F.coalesce(F.col(o), F.col(f"_c_{o}")).alias(o))
    keep = [c for c in df.columns if c not in out_cols]
    return joined.select(*keep, *fixed)


def _with_group_size(cum: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Attach ``_n`` (rows per group), summed from the checkpointed running
    table (so the source is not read again).  Without groups it is a scalar
    subquery, evaluated once; with groups an equi-join on the group keys (AQE
    turns it into a broadcast when the group table is small at run time)."""
    if not group_cols:
        return cum.withColumn("_n", cum.select(F.sum("_c")).scalar())
    sizes = cum.groupBy(*group_cols).agg(F.sum("_c").alias("_n"))
    sizes = sizes.select(*[F.col(c).alias(f"_s_{c}") for c in group_cols], "_n")
    cond = reduce(lambda a, b: a & b, [cum[c].eqNullSafe(sizes[f"_s_{c}"]) for c in group_cols])
    return cum.join(sizes, cond, "inner").drop(*[f"_s_{c}" for c in group_cols])


#: rank accuracy of the bracketing sketch, and the bracket's half width in units of it
ACCURACY, HALF_WIDTH = 50_000, 3


def _linear(lo: Column, hi: Column, d: Column) -> Column:
    """numpy's linear rule: lo + (hi − lo)·d below the midpoint, lo·(1 − d) + hi·d
    from it on, with the rounding DuckDB shows."""
    return F.when(d < 0.5, lo + (hi - lo) * d).otherwise(lo * (1 - d) + hi * d)


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float | Column],
                    group_cols: Sequence[str] = (), names: Sequence[str] | None = None,
                    bounded_groups: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy/pandas default).

    One row per group; NULL and NaN values are ignored.  No sort and no copy of
    the data: a mergeable sketch brackets every quantile, then the rows outside
    all brackets are only counted (one count per gap between brackets, map-side)
    while the values inside keep their own counts.

    Without groups the digits of the value are counted (``wide_quantiles``).  Where
    ``bounded_groups`` says that the groups are a fixed list (flags, parameters), the
    result is selected by the driver from such counts: brackets are narrowed, a scan
    a time, until at most ``FEW`` values are left inside (two scans for up to some ten
    million rows).  These scans run when this is called.  For open groups the values inside, about
    ``2·HALF_WIDTH/ACCURACY`` of a group's rows per quantile, are summed up per
    group; should a position fall into a gap there, the query fails.  A probability
    may be a Column over the group columns (a different quantile per group); those
    take a range-spread running count."""
    group_cols = list(group_cols)
    names = list(names or [f"q_{i}" if isinstance(p, Column) else f"q_{str(p).replace('.', '_')}"
                           for i, p in enumerate(probs)])
    v = F.col(value_col).cast("double")
    vals = df.select(*group_cols, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if any(isinstance(p, Column) for p in probs):
        counts = vals.groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_c"))
        both = _with_group_size(running(counts, ["_v"], ["_c"], group_cols, "sum", ["_cum"]), group_cols)
        both = both.withColumns({"_gap": F.lit(False), "_first": F.col("_v"), "_c": F.col("_c")})
    elif not group_cols:
        found = wide_quantiles(vals, ["_v"], probs)["_v"]
        return df.sparkSession.createDataFrame([tuple(found or [None] * len(probs))], T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    elif bounded_groups:
        return _selected(vals, [float(p) for p in probs], group_cols, names)
    else:
        both = _bracketed(vals, [float(p) for p in probs], group_cols)
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * (p if isinstance(p, Column) else F.lit(float(p)))
        lo, hi = F.floor(pos), F.ceil(pos)
        at = F.struct("_v", "_gap", "_first", "_c", "_cum")
        aggs.append(F.min(F.when(F.col("_cum") > lo, at)).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("_cum") > hi, at)).alias(f"_hi{i}"))
        aggs += [F.first(pos - lo).alias(f"_f{i}"), F.first(lo).alias(f"_lop{i}"), F.first(hi).alias(f"_hip{i}")]
    agg = both.groupBy(*group_cols).agg(*aggs)
    missed = F.raise_error(F.lit("a quantile fell outside its bracket")).cast("double")

    def value(e: str, position: str) -> Column:
        """The value at a position: of an entry inside a bracket, or the first or
        last one of a gap, which are known too."""
        e, k = F.col(e), F.col(position)
        return (F.when(~e["_gap"] | (k == e["_cum"] - 1), e["_v"]).when(k == e["_cum"] - e["_c"], e["_first"])
                .when(e.isNotNull(), missed))

    outs = [_linear(value(f"_lo{i}", f"_lop{i}"), value(f"_hi{i}", f"_hip{i}"), F.col(f"_f{i}")).alias(nm)
            for i, nm in enumerate(names)]
    return agg.select(*group_cols, *outs)


def _bracketed(vals: DataFrame, probs: Sequence[float], group_cols: Sequence[str]) -> DataFrame:
    """(groups, _v, _cum, _n, _gap): cumulative counts over the values inside the
    quantiles' brackets, with one row (its largest value) per gap between them."""
    half = HALF_WIDTH / ACCURACY
    edges = [x for p in probs for x in (max(p - half, 0.0), min(p + half, 1.0))]
    fits = [F.percentile_approx("_v", edges, ACCURACY).alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
            F.count(F.lit(1)).alias("_n")]
    fit = vals.groupBy(*group_cols).agg(*fits)
    rows = group_lookup(vals, fit, group_cols, "inner")
    brackets = [(F.col("_min") if p <= half else F.col("_e")[2 * i], F.col("_max") if p >= 1 - half else F.col("_e")[2 * i + 1])
                for i, p in enumerate(probs)]
    counts = _gap_counts(rows, brackets, [*group_cols, "_n"])
    w = Window.partitionBy(*group_cols).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*group_cols, "_v", "_first", "_c", "_n", F.sum("_c").over(w).alias("_cum"), (~F.col("_in")).alias("_gap"))


def _gap_counts(rows: DataFrame, brackets: Sequence[tuple[Column, Column]], keys: Sequence[str]) -> DataFrame:
    """Per group: a count for every value inside a bracket and one for every gap
    between brackets, with its smallest and largest value."""
    x = F.col("_v")
    inside, below = F.lit(False), F.lit(0)
    for lo, hi in brackets:
        inside = inside | ((x >= lo) & (x <= hi))
        below = below + (x > hi).cast("int")
    kept = rows.select(*keys, "_v", inside.alias("_in"), below.alias("_below"))
    return kept.groupBy(*keys, "_in", "_below", F.when(F.col("_in"), x).alias("_key")).agg(
        F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_v"), F.min("_v").alias("_first"))


#: rank accuracy of the selection's sketches; values inside brackets that are
#: counted in the driver's reach; steps a bracket is cut into when narrowed
SELECT_ACCURACY, FEW, STEPS = 10_000, 20_000, 512


def _selected(vals: DataFrame, probs: Sequence[float], group_cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Exact quantiles of a fixed list of groups by narrowing brackets."""
    spark, keys, m = vals.sparkSession, list(group_cols), len(probs)
    half = HALF_WIDTH / SELECT_ACCURACY
    edges = [x for p in probs for x in (max(p - half, 0.0), min(p + half, 1.0))]
    fit = vals.groupBy(*keys).agg(F.percentile_approx("_v", edges, SELECT_ACCURACY).alias("_e"), F.min("_v").alias("_min"),
                                  F.max("_v").alias("_max"), F.count(F.lit(1)).alias("_n"))
    groups = []                                  # [key, n, (position, share) and bracket of every quantile, rows inside]
    for r in fitted_params(fit):
        at = [((r["_n"] - 1) * p) for p in probs]
        brackets = [[r["_min"] if p <= half else r["_e"][2 * i], r["_max"] if p >= 1 - half else r["_e"][2 * i + 1]]
                    for i, p in enumerate(probs)] if r["_n"] else []
        groups.append({"key": tuple(r[c] for c in keys), "n": r["_n"], "at": at, "in": brackets, "ends": (r["_min"], r["_max"]),
                       "rows": [min(1.0, 2 * half) * r["_n"]] * m, "value": {}})
    state = T.StructType([vals.schema[c] for c in keys] + [T.StructField("_in", T.ArrayType(T.ArrayType(T.DoubleType())))])
    renamed = T.StructType([T.StructField(f"_b_{f.name}" if f.name in keys else f.name, f.dataType) for f in state.fields])

    def rows_with_brackets(open_groups):
        """The values of groups that still have an open quantile, beside their brackets."""
        table = F.broadcast(spark.createDataFrame([(*g["key"], g["in"]) for g in open_groups], renamed))
        cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in keys])
        return vals.join(table, cond), lambda i, e: F.col("_in")[i][e]

    margin = 1 + math.ceil(2 * STEPS / SELECT_ACCURACY)          # steps a sketch may be off
    for _ in range(100):
        open_groups = [g for g in groups if g["n"] and len(g["value"]) < m]
        if not open_groups:
            break
        rows, end = rows_with_brackets(open_groups)
        if all(max(g["rows"]) <= 1.0 or sum(g["rows"]) <= FEW for g in open_groups):
            counts = _gap_counts(rows, [(end(i, 0), end(i, 1)) for i in range(m)], keys)
            per_group: dict[tuple, list] = {}
            for r in fitted_params(counts, max_rows=len(open_groups) * (2 * FEW + m * (2 * STEPS + 1) + 1)):
                per_group.setdefault(tuple(r[c] for c in keys), []).append((r["_v"], r["_first"], r["_c"], r["_in"]))
            for g in open_groups:
                _read_off(g, per_group[_own_key(g["key"], per_group)], m)
            continue
        # too many values inside: cut the brackets further
        x = F.col("_v")
        aggs = []
        for i in range(m):
            within = F.when((x >= end(i, 0)) & (x <= end(i, 1)), x)
            aggs += [F.sum((x < end(i, 0)).cast("long")).alias(f"_b{i}"), F.count(within).alias(f"_c{i}"),
                     F.percentile_approx(within, [k / STEPS for k in range(STEPS + 1)], SELECT_ACCURACY).alias(f"_q{i}")]
        found = {tuple(r[c] for c in keys): r for r in fitted_params(rows.groupBy(*keys).agg(*aggs))}
        for g in open_groups:
            r = found[_own_key(g["key"], found)]
            for i in range(m):
                lo, hi = math.floor(g["at"][i]), math.ceil(g["at"][i])
                below, count, cuts = r[f"_b{i}"], r[f"_c{i}"], r[f"_q{i}"]
                if lo < below or hi >= below + count:            # not inside after all: the whole side
                    g["in"][i] = [g["ends"][0], g["in"][i][1]] if lo < below else [g["in"][i][0], g["ends"][1]]
                    g["rows"][i] = float(g["n"])
                    continue
                a = max(math.floor((lo - below) / count * STEPS) - margin, 0)
                z = min(math.ceil((hi - below + 1) / count * STEPS) + margin, STEPS)
                narrow = [g["in"][i][0] if a == 0 else cuts[a], g["in"][i][1] if z == STEPS else cuts[z]]
                done = narrow == g["in"][i] or narrow[0] == narrow[1]
                g["in"][i], g["rows"][i] = narrow, 1.0 if done else count * (z - a) / STEPS
    else:
        raise RuntimeError("the brackets of a quantile did not close")
    out = []
    for g in groups:
        values = [_linear_value(*g["value"][i]) if g["n"] else None for i in range(m)]
        out.append((*g["key"], *values))
    schema = T.StructType([vals.schema[c] for c in keys] + [T.StructField(n, T.DoubleType()) for n in names])
    return spark.createDataFrame(out, schema)


#: rows that are counted at a time; buckets of a round over all columns; values left
#: that are counted one by one; prefixes of a column whose extremes are looked up
DIGIT_ROWS, DIGIT_BUCKETS, DIGIT_FEW, DIGIT_ENDS = 1 << 17, 1 << 20, 100_000, 16
_LOW63 = np.int64(0x7FFFFFFFFFFFFFFF)
_DIGITS = "c int, kind int, b long, n long, lo long, hi long"


def _sortable(v: np.ndarray) -> np.ndarray:
    """The doubles' bits as integers in the doubles' order (0.0 for -0.0)."""
    bits = (v + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & _LOW63)


def _digit_counts(src: DataFrame, asked: dict[int, np.ndarray], shift: int, bits: int, single: set[int]):
    """One scan over the columns ``asked`` names: counts of the next ``bits`` binary digits
    of the values that begin with an asked prefix (every value, without a prefix), down
    to digit ``shift``.  Rows (c, kind, b, n, lo, hi): kind 0 a bucket, ``hi`` 1 where values
    go on after these digits, kind 1 the least and largest value of a prefix; for the columns ``single`` the values themselves, kind 2."""
    import pyarrow as pa

    cols = sorted(asked)

    def run(batches):
        sums = {c: np.zeros(max(len(asked[c]), 1) << bits, np.int64) for c in cols if c not in single}
        longer = {c: np.zeros(len(sums[c]), bool) for c in sums}
        ends = {c: np.tile([[_LOW63], [~_LOW63]], len(asked[c])) for c in sums if 0 < len(asked[c]) <= DIGIT_ENDS}
        values: dict = {c: [] for c in single}
        held, n = [], 0

        def count():
            table = pa.Table.from_batches(held)
            for at, c in enumerate(cols):
                v = table.column(at).to_numpy()
                s = _sortable(v[v == v])
                if not len(asked[c]):                           # the first round
                    at_bucket = (s >> shift) + (1 << bits - 1)
                    sums[c] += np.bincount(at_bucket, minlength=1 << bits)
                    longer[c][at_bucket[(s & ((1 << shift) - 1)) != 0]] = True
                    continue
                mine, top = asked[c], s >> (shift + bits)
                slot = np.minimum(np.searchsorted(mine, top), len(mine) - 1)
                keep = mine[slot] == top
                s, slot = s[keep], slot[keep]
                if c in values:
                    values[c].append(s)
                    continue
                at_bucket = (slot << bits) + ((s >> shift) & ((1 << bits) - 1))
                sums[c] += np.bincount(at_bucket, minlength=len(mine) << bits)
                longer[c][at_bucket[(s & ((1 << shift) - 1)) != 0]] = True
                if c in ends and len(s):
                    for k in range(len(mine)):
                        x = s[slot == k]
                        if len(x):
                            ends[c][0, k], ends[c][1, k] = min(ends[c][0, k], x.min()), max(ends[c][1, k], x.max())

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= DIGIT_ROWS:
                count()
                held, n = [], 0
        if n:
            count()

        def rows(c, kind, b, n, lo=None, hi=None):
            zero = np.zeros(len(b), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), c, np.int32)), pa.array(np.full(len(b), kind, np.int32)), pa.array(b),
                                               pa.array(n), pa.array(zero if lo is None else lo), pa.array(zero if hi is None else hi)],
                                              names=["c", "kind", "b", "n", "lo", "hi"])

        for c in cols:
            if c in values:
                if values[c]:
                    v, n = np.unique(np.concatenate(values[c]), return_counts=True)
                    yield rows(c, 2, v, n)
                continue
            at = np.flatnonzero(sums[c])
            b = (asked[c][at >> bits] << bits) + (at & ((1 << bits) - 1)) if len(asked[c]) else at - (1 << bits - 1)
            yield rows(c, 0, b, sums[c][at], hi=longer[c][at].astype(np.int64))
            if c in ends:
                seen = ends[c][0] <= ends[c][1]
                yield rows(c, 1, asked[c][seen], np.zeros(int(seen.sum()), np.int64), ends[c][0][seen], ends[c][1][seen])

    counted = src.select(*[f"_x{c}" for c in cols]).mapInArrow(run, _DIGITS)
    return counted.groupBy("c", "kind", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow().sort_by("b")


def wide_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float] | None]:
    """Exact quantiles (numpy's linear rule) of many columns side by side; NULL and NaN
    are ignored, a column without values gives None.

    The values are never sorted, copied or turned into rows.  A scan counts the leading
    binary digits of every column's values (as integers in the doubles' order), the next
    one the digits after them, for values with a prefix that holds an asked position
    only; at most ``DIGIT_BUCKETS`` counts come back.  Once a column has few values left
    (its share of ``DIGIT_FEW``) these are counted one by one; a value whose further digits
    are all 0 and a prefix with one value are done.  Three scans as a rule."""
    cols, probs = list(cols), [float(p) for p in probs]
    src = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    at = {}                                      # column -> positions of the quantiles, 0-based
    wanted: dict = {i: None for i in range(len(cols))}        # column -> {position: (prefix, values below it)}
    found: dict = {i: {} for i in wanted}
    shift, bits, single = 48, 16, set()
    while wanted:
        asked = {i: np.unique([b for b, _ in w.values()]) if w else np.empty(0, np.int64) for i, w in wanted.items()}
        got = _digit_counts(src, asked, shift, bits, single)
        c, kind, b, n, lo, hi = (got[k].to_numpy() for k in got.column_names)
        few = set()
        for i in list(wanted):
            mine = (c == i) & (kind == (2 if i in single else 0))
            buckets, counts, more = b[mine], n[mine], hi[mine]
            if wanted[i] is None:
                total = int(counts.sum())
                at[i] = [(total - 1) * p for p in probs]
                wanted[i] = {k: (0, 0) for x in at[i] for k in (math.floor(x), math.ceil(x))} if total else {}
                starts = np.zeros(len(buckets), np.int64)
            else:
                starts = buckets >> (shift + bits if i in single else bits)
            one = {int(p): float((v ^ ((v >> 63) & _LOW63)).view(np.float64)) for p, v, w in
                   zip(*(x[(c == i) & (kind == 1)] for x in (b, lo, hi))) if v == w}
            ahead, left = {}, {}
            for k, (prefix, below) in wanted[i].items():
                if prefix in one:
                    found[i][k] = one[prefix]
                    continue
                inside = starts == prefix
                cum = below + np.cumsum(counts[inside])
                j = int(np.searchsorted(cum, k, "right"))
                v, held = buckets[inside][j], int(counts[inside][j])
                if i in single or not more[inside][j]:              # all digits are known
                    v = v if i in single else v << np.int64(shift)
                    found[i][k] = float((v ^ ((v >> 63) & _LOW63)).view(np.float64))
                else:
                    ahead[k] = (int(v), int(cum[j]) - held)
                    left[v] = held
            wanted[i] = ahead
            if not ahead:
                del wanted[i]
            elif sum(left.values()) <= DIGIT_FEW // len(cols):
                few.add(i)
        single = few
        if wanted:
            prefixes = max(sum(len({b for b, _ in w.values()}) for i, w in wanted.items() if i not in few), 1)
            bits = max(1, min(16, shift, (DIGIT_BUCKETS // prefixes).bit_length() - 1))
            shift -= bits
    return {c: [_linear_value(found[i][math.floor(x)], found[i][math.ceil(x)], x - math.floor(x)) for x in at[i]] if found[i] else None
            for i, c in enumerate(cols)}


def _own_key(key: tuple, table: dict) -> tuple:
    """The key as it stands in ``table`` (a NaN is not equal to itself)."""
    return key if key in table else next(k for k in table if _same_key(k, key))


def _read_off(g: dict, entries: list[tuple], m: int) -> None:
    """The values at the asked positions from counts of values and gaps; a position
    inside a gap whose value is not known makes the gap its next bracket."""
    entries.sort(key=lambda e: e[0])
    cum = np.cumsum([e[2] for e in entries])
    for i in range(m):
        found = []
        for pos in (math.floor(g["at"][i]), math.ceil(g["at"][i])):
            at = int(np.searchsorted(cum, pos, "right"))
            last, first, count, inside = entries[at]
            if inside or pos == cum[at] - 1:
                found.append(last)
            elif pos == cum[at] - count:
                found.append(first)
            else:
                g["in"][i], g["rows"][i] = [first, last], float(count)
        if len(found) == 2:
            g["value"][i] = (*found, g["at"][i] - math.floor(g["at"][i]))


def _linear_value(lo: float, hi: float, d: float) -> float:
    return lo + (hi - lo) * d if d < 0.5 else lo * (1 - d) + hi * d


def tie_average_rank(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                     out_col: str = "pct_rank", descending: bool = False) -> DataFrame:
    """pandas ``rank(method='average', pct=True)``: (rows below + (ties+1)/2) / n.

    NULL values get a NULL rank and do not count in n.  Returns every input
    row with ``out_col`` added (joined back on the value).
    """
    group_cols = list(group_cols)
    v = F.col(value_col)
    valid = df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    counts = valid.groupBy(*group_cols, F.col(value_col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = [F.col("_v").desc()] if descending else [F.col("_v")]
    cum = running(counts, order, ["_c"], group_cols, "sum", ["_cum"])
    ranked = _with_group_size(cum, group_cols)
    ranked = ranked.select(*group_cols, F.col("_v").alias(value_col),
                           ((F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0) / F.col("_n")).alias(out_col))
    return group_lookup(df, ranked, [*group_cols, value_col])
