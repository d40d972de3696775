"""The time-series operators applied to the driver's tables, each with the same query in DuckDB's SQL.

Stations are event types. ``hourly`` and ``fine`` (ten minutes) are regular grids of the mean value ``v``, the
largest value ``w`` of bins with two events or more, and the number of events ``n``, which has natural zeros.
``daily`` has a row for each day of orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, session
from .axis import Axis
from .functions.missing import is_missing
from .operators import features, fills, merge, metrics, outliers, quality, runs, scaling, splits, stats, time_axis
from .operators.rules import ColumnRules
from .plans.cleaner import Cleaner
from .sources import tables

HOUR, TEN = 3_600_000_000, 600_000_000
#: Added before rounding: the engines round ties differently, and means of short decimals are often ties.
TIES = 1.3e-8
AXIS = Axis("ts", ("s",))
DAY = Axis("ts", ())
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gridded(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bins = time_axis.at_micros(time_axis.floor_time(F.col("ts"), step))
    rows = e.groupBy(F.col("event_type").alias("s"), bins.alias("ts")).agg(F.round(F.avg("value") + TIES, 6).alias("v"), F.when(F.count("*") >= 2, F.max("value")).alias("w"), F.count("*").cast("double").alias("n"))
    return time_axis.on_grid(rows, AXIS, step).withColumn("n", F.coalesce("n", F.lit(0.0))).select("s", "ts", "v", "w", "n")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridded(spark, sf_dir, HOUR)


def fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridded(spark, sf_dir, TEN)


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with events only, so that steps are uneven."""
    return hourly(spark, sf_dir).where("n > 0")


def exact_mean(c: str) -> Column:
    """The mean of a column, free of the order in which its rows are added: whole numbers are added exactly, and what is left
    is too small to lose digits. A plain sum of thousands of rows puts a mean off by about 1e-9, which shows next to a tie."""
    whole = F.rint(c)
    return (F.sum(whole) + F.sum(F.nanvl(F.col(c) - whole, F.lit(0.0)))) / F.nullif(F.count(c), F.lit(0))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_timestamp_ntz(F.to_date("o_orderdate").cast("string"), F.lit("yyyy-MM-dd")).alias("ts")).agg(F.round(exact_mean("o_totalprice") + TIES, 6).alias("price"), F.count("*").cast("double").alias("orders"))


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.to_timestamp_ntz(F.to_date("l_shipdate").cast("string"), F.lit("yyyy-MM-dd")).alias("ts")).agg(F.round(F.avg("l_discount") + TIES, 6).alias("discount"), F.count("*").cast("double").alias("orders"))


_GRID = """{g}_h AS (SELECT event_type AS s, time_bucket(INTERVAL '{step}', ts) AS t, round(avg(value) + 1.3e-8, 6) AS v,
  CASE WHEN count(*) >= 2 THEN max(value) END AS w, count(*) AS n FROM events GROUP BY 1, 2),
{g}_g AS (SELECT s, unnest(generate_series(lo, hi, INTERVAL '{step}')) AS t FROM (SELECT s, min(t) AS lo, max(t) AS hi FROM {g}_h GROUP BY s)),
{g} AS (SELECT s, CAST(t AS TIMESTAMP) AS ts, v, w, CAST(coalesce(n, 0) AS DOUBLE) AS n, row_number() OVER (PARTITION BY s ORDER BY t) AS rn
  FROM {g}_g LEFT JOIN {g}_h USING (s, t))"""
BASE = {
    "hourly": _GRID.format(g="hourly", step="1 hour"),
    "fine": _GRID.format(g="fine", step="10 minutes"),
    "daily": "daily AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, round(avg(o_totalprice) + 1.3e-8, 6) AS price, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1)",
    "shipped": "shipped AS (SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, round(avg(l_discount) + 1.3e-8, 6) AS discount, CAST(count(*) AS DOUBLE) AS orders FROM lineitem GROUP BY 1)",
}
BASE["binned"] = BASE["hourly"] + ",\nbinned AS (SELECT s, ts, v, w, n, row_number() OVER (PARTITION BY s ORDER BY ts) AS rn FROM hourly WHERE n > 0)"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, counts as longs: what both engines can agree on."""
    kinds = {"double": lambda c: F.round(F.col(c) + TIES, 6) + 0.0, "int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long")}
    return df.select(*(kinds[k](c).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes))


def query(name: str, base: str | tuple[str, ...] = (), sql: str | None = None, doubles: str = ""):
    """Register a query; ``sql`` may use the base tables, and its ``doubles`` are rounded."""

    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.ship(spark)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            names = (base,) if isinstance(base, str) else base
            sep = "\n" if not names else "WITH " + ",\n".join(BASE[b] for b in names) + ("\n" if not sql.lstrip().startswith(",") else "")
            text = sep + sql
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c} + 1.3e-8, 6) + 0.0 AS {c}' for c in doubles.split())}) FROM ({text})" if doubles else text
        return fn

    return put


def islands(src: str, kind: str, out: str) -> str:
    """CTE that adds ``kind`` and the length ``len`` of its run to the rows of ``src``."""
    return f""", {out}_k AS (SELECT *, {kind} AS kind FROM {src}), {out}_i AS (SELECT *, rn - row_number() OVER (PARTITION BY s, kind ORDER BY ts) AS gid FROM {out}_k),
{out} AS (SELECT *, count(*) OVER (PARTITION BY s, kind, gid) AS len FROM {out}_i)"""


def neighbours(src: str, flag: str, out: str, at: str = "rn", v: str = "v") -> str:
    """CTE that adds ``filled``: ``v`` interpolated at the rows where ``flag`` holds."""
    w = "OVER (PARTITION BY s ORDER BY ts ROWS BETWEEN {} AND {})"
    back, ahead = w.format("UNBOUNDED PRECEDING", "CURRENT ROW"), w.format("CURRENT ROW", "UNBOUNDED FOLLOWING")
    return f""", {out}_x AS (SELECT *, {flag} AS spot, CASE WHEN NOT ({flag}) THEN {v} END AS x, {at} AS place FROM {src}),
{out}_n AS (SELECT *, last_value(x IGNORE NULLS) {back} AS pv, last_value(CASE WHEN x IS NOT NULL THEN place END IGNORE NULLS) {back} AS pa,
  first_value(x IGNORE NULLS) {ahead} AS nv, first_value(CASE WHEN x IS NOT NULL THEN place END IGNORE NULLS) {ahead} AS na FROM {out}_x),
{out} AS (SELECT *, CASE WHEN spot THEN pv + (nv - pv) * (place - pa) / nullif(na - pa, 0) ELSE {v} END AS filled FROM {out}_n)"""


NAN = "CASE WHEN v IS NULL THEN 'nan' END"
RULES = {"keep": [1, 2], "interpolate": [3, 6], "drop_rows": [7, None]}
ACTION = "CASE WHEN kind IS NULL THEN NULL WHEN len BETWEEN 3 AND 6 THEN 'interpolate' WHEN len >= 7 THEN 'drop_rows' ELSE 'keep' END"


# ---- time axis
@query("hourly_grid", "hourly", "SELECT s, ts, v, w, n FROM hourly", "v w n")
def _(spark, d):
    return hourly(spark, d)


@query("missing_runs", "hourly", islands("hourly", NAN, "r") + " SELECT s, 'v' AS \"column\", kind, len AS length, count(*) // len AS runs, count(*) AS points FROM r WHERE kind IS NOT NULL GROUP BY s, kind, len")
def missing_runs(spark, d):
    return quality.run_length_table(hourly(spark, d), AXIS, ["v"], zeros=False)


@query("infer_freq", "binned", ", d AS (SELECT s, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY s ORDER BY ts) AS step FROM binned), c AS (SELECT s, step, count(*) AS k FROM d WHERE step > 0 GROUP BY 1, 2) SELECT s, arg_max(step, k * 1000000000000000 - step) AS freq_us FROM c GROUP BY s")
def _(spark, d):
    return time_axis.infer_freq(binned(spark, d), AXIS)


@query("absent_timestamps", "hourly", "SELECT s, ts FROM hourly WHERE n = 0 AND ts >= (SELECT min(ts) FROM hourly)")
def _(spark, d):
    return time_axis.absent_timestamps(binned(spark, d), AXIS, HOUR)


@query("time_report", "binned", ", a AS (SELECT s, count(*) AS missing_timestamps FROM hourly WHERE n = 0 GROUP BY s) SELECT s, count(*) AS rows, count(*) - count(DISTINCT ts) AS duplicates, TRUE AS was_sorted, min(ts) AS start, max(ts) AS \"end\", coalesce(any_value(missing_timestamps), 0) AS missing_timestamps FROM binned LEFT JOIN a USING (s) GROUP BY s")
def _(spark, d):
    return time_axis.time_report(binned(spark, d), AXIS, HOUR)


def _hours(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("s"), time_axis.at_micros(time_axis.floor_time(F.col("ts"), HOUR)).alias("ts"), "event_id", "value")


_HOURS = "SELECT event_type AS s, date_trunc('hour', ts) AS ts, event_id, value FROM events"
_ORDERED = Axis("ts", ("s",), "event_id")


@query("dedupe_mean", (), f"SELECT s, CAST(ts AS TIMESTAMP) AS ts, avg(value) AS value FROM ({_HOURS}) GROUP BY s, ts", "value")
def _(spark, d):
    return time_axis.deduplicated(_hours(spark, d).drop("event_id"), AXIS, "mean")


for _how, _sort in (("first", "event_id"), ("last", "event_id DESC")):
    query(f"dedupe_{_how}", (), f"SELECT s, CAST(ts AS TIMESTAMP) AS ts, event_id, value FROM ({_HOURS}) QUALIFY row_number() OVER (PARTITION BY s, ts ORDER BY {_sort}) = 1", "value")(lambda spark, d, how=_how: time_axis.deduplicated(_hours(spark, d), _ORDERED, how))


@query("dedupe_drop", (), f"SELECT s, CAST(ts AS TIMESTAMP) AS ts, event_id, value FROM ({_HOURS}) QUALIFY count(*) OVER (PARTITION BY s, ts) = 1", "value")
def _(spark, d):
    return time_axis.deduplicated(_hours(spark, d), _ORDERED, "drop")


_SEVEN = ", o AS (SELECT s, date_trunc('day', min(ts)) AS o FROM hourly GROUP BY s), q AS (SELECT s, o + to_microseconds((epoch_us(ts) - epoch_us(o)) // 25200000000 * 25200000000) AS ts, v, w, n FROM hourly JOIN o USING (s))"


@query("resample_7h", "hourly", _SEVEN + " SELECT s, CAST(ts AS TIMESTAMP) AS ts, avg(v) AS v, avg(w) AS w, avg(n) AS n FROM q GROUP BY s, ts", "v w n")
def _(spark, d):
    return time_axis.resampled(hourly(spark, d), AXIS, "7h")


@query("resample_sum", "hourly", _SEVEN + " SELECT s, CAST(ts AS TIMESTAMP) AS ts, coalesce(sum(v), 0) AS v, coalesce(sum(w), 0) AS w, sum(n) AS n FROM q GROUP BY s, ts", "v w n")
def _(spark, d):
    return time_axis.resampled(hourly(spark, d), AXIS, "7h", "sum")


# ---- quality
@query("missing_mask", "fine", "SELECT s, count_if(v IS NULL) AS v, count_if(n = 0) AS n FROM fine GROUP BY s")
def _(spark, d):
    return quality.missing_mask(fine(spark, d), ["v", "n"], zeros=True).groupBy("s").agg(F.count_if("v").alias("v"), F.count_if("n").alias("n"))


_BOTH = " UNION ALL ".join
_ZERO = "CASE WHEN n = 0 THEN 'nan_or_zero' END"


@query("run_length_table", "fine", islands("fine", "CASE WHEN v IS NULL THEN 'nan_or_zero' END", "a") + islands("fine", _ZERO, "b") + " SELECT s, c AS \"column\", kind, len AS length, count(*) // len AS runs, count(*) AS points FROM (SELECT s, 'v' AS c, kind, len FROM a UNION ALL SELECT s, 'n', kind, len FROM b) WHERE kind IS NOT NULL GROUP BY s, c, kind, len")
def _(spark, d):
    return quality.run_length_table(fine(spark, d), AXIS, ["v", "n"])


@query("find_blocks", "fine", islands("fine", "CASE WHEN v IS NULL THEN 'nan' END", "a") + islands("fine", "CASE WHEN n = 0 THEN 'zero' END", "b") + " SELECT s, c AS \"column\", kind, min(ts) AS start, max(ts) AS \"end\", count(*) AS length, CAST(sum(x) AS BIGINT) AS n_nan, CAST(sum(z) AS BIGINT) AS n_zeros FROM (SELECT s, ts, 'v' AS c, kind, gid, len, 1 AS x, 0 AS z FROM a UNION ALL SELECT s, ts, 'n', kind, gid, len, 0, 1 FROM b) WHERE kind IS NOT NULL AND len >= 4 GROUP BY s, c, kind, gid")
def _(spark, d):
    return quality.blocks(fine(spark, d), AXIS, ["v", "n"], 4)


@query("runs_of", "fine", islands("fine", NAN, "r") + " SELECT s, min(ts) AS start, max(ts) AS \"end\", min(rn) - 1 AS start_pos, max(rn) - 1 AS end_pos, count(*) AS length FROM r WHERE kind IS NOT NULL GROUP BY s, gid")
def _(spark, d):
    return runs.runs_of(fine(spark, d), AXIS, is_missing("v"))


@query("run_lengths", "fine", islands("fine", NAN, "r") + " SELECT s, ts, CASE WHEN kind IS NULL THEN 0 ELSE len END AS run_length FROM r")
def _(spark, d):
    return runs.run_lengths(fine(spark, d), AXIS, is_missing("v")).select("s", "ts", "run_length")


@query("describe_columns", "fine", " UNION ALL ".join(f"SELECT s, '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nan, round(100.0 * (count(*) - count({c})) / count(*), 4) AS nan_pct, count_if({c} = 0) AS zeros, round(100.0 * count_if({c} = 0) / count(*), 4) AS zeros_pct, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, median({c}) AS median, stddev_samp({c}) AS std, count({c}) > 0 AS is_numeric FROM fine GROUP BY s" for c in ("v", "w", "n")), "nan_pct zeros_pct min max mean median std")
def _(spark, d):
    return quality.describe_columns(fine(spark, d), ["v", "w", "n"], ("s",))


@query("missing_map", "fine", ", c AS (SELECT *, count(*) OVER (PARTITION BY s) AS total FROM fine) SELECT s, (rn * least(48, total) - 1) // total AS bucket, min(ts) AS ts, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS v, avg(CASE WHEN w IS NULL THEN 1.0 ELSE 0 END) AS w FROM c GROUP BY 1, 2", "v w")
def _(spark, d):
    return quality.missing_map(fine(spark, d), AXIS, ["v", "w"], 48)


@query("compare_missing", "fine", neighbours("fine", "v IS NULL", "f") + " SELECT 'v' AS \"column\", count_if(v IS NULL) AS before, 100.0 * count_if(v IS NULL) / count(*) AS before_pct, count_if(filled IS NULL) AS after, 100.0 * count_if(filled IS NULL) / count(*) AS after_pct, 100.0 * (count_if(v IS NULL) - count_if(filled IS NULL)) / count(*) AS diff_pct FROM f", "before_pct after_pct diff_pct")
def _(spark, d):
    before = fine(spark, d)
    return quality.compare_missing(before, fills.linear_interpolation(before, AXIS, ["v"], None), ["v"])


_DROP = islands("fine", NAN, "r")


@query("removed_periods", "fine", _DROP + " SELECT s, min(ts) AS start, max(ts) AS \"end\", count(*) AS rows, 'v' AS reason FROM r WHERE kind IS NOT NULL AND len >= 7 GROUP BY s, gid")
def _(spark, d):
    flagged = fills.drop_flags(fine(spark, d), AXIS, {"v": ColumnRules.of({"runs": RULES})})
    return quality.removed_periods(flagged, AXIS, F.col("__drop"), {"v": F.col("v__drop")})


# ---- rules and fills
_RUNS = {c: ColumnRules.of({"runs": RULES}) for c in ("v",)}


@query("plan_table", "fine", _DROP + f", p AS (SELECT s, len, {ACTION} AS action FROM r WHERE kind IS NOT NULL) SELECT s, 'v' AS \"column\", 'missing' AS kind, CASE action WHEN 'keep' THEN '[1, 2]' WHEN 'interpolate' THEN '[3, 6]' ELSE '[7, inf]' END AS length, action, CAST(round(sum(1.0 / len)) AS BIGINT) AS runs, count(*) AS points FROM p GROUP BY s, action")
def _(spark, d):
    return fills.plan_table(fine(spark, d), AXIS, _RUNS)


@query("drop_long_runs", "fine", _DROP + " SELECT s, ts, v, w, n FROM r WHERE NOT (kind IS NOT NULL AND len >= 7)", "v w n")
def _(spark, d):
    return fills.dropped_runs(fine(spark, d), AXIS, _RUNS)


@query("interpolate_linear", "fine", _DROP + neighbours("r", "(kind IS NOT NULL AND len BETWEEN 1 AND 6)", "f") + " SELECT s, ts, filled AS v, w, n FROM f", "v w n")
def _(spark, d):
    return fills.linear_interpolation(fine(spark, d), AXIS, ["v"], 6)


@query("interpolate_time", "binned", neighbours("binned", "w IS NULL", "f", "epoch_us(ts)", "w") + " SELECT s, ts, v, filled AS w, n FROM f", "v w n")
def _(spark, d):
    return fills.linear_interpolation(binned(spark, d), AXIS, ["w"], None, method="time")


@query("forward_fill", "fine", _DROP + " SELECT s, ts, CASE WHEN kind IS NOT NULL AND len <= 2 THEN last_value(v IGNORE NULLS) OVER (PARTITION BY s ORDER BY ts) ELSE v END AS v, w, n FROM r", "v w n")
def _(spark, d):
    return fills.forward_fill(fine(spark, d), AXIS, ["v"], 2)


@query("backward_fill", "fine", _DROP + " SELECT s, ts, CASE WHEN kind IS NOT NULL AND len <= 3 THEN first_value(v IGNORE NULLS) OVER (PARTITION BY s ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE v END AS v, w, n FROM r", "v w n")
def _(spark, d):
    return fills.filled(fine(spark, d), AXIS, fills.run_rules(["v"], {"bfill": [1, 3]}))


@query("fill_zero_set_nan", "fine", islands("fine", "CASE WHEN n = 0 THEN 'z' END", "a") + ", b AS (SELECT s, ts, v, w, CASE WHEN kind IS NOT NULL AND len >= 3 THEN NULL ELSE n END AS n, rn FROM a)" + islands("b", NAN, "r") + " SELECT s, ts, CASE WHEN kind IS NOT NULL AND len <= 2 THEN 0.0 ELSE v END AS v, w, n FROM r", "v w n")
def _(spark, d):
    return fills.filled(fine(spark, d), AXIS, {"v": ColumnRules.of({"runs": {"fill_zero": [1, 2]}}), "n": ColumnRules.of({"zeros": True, "runs": {"set_nan": [3, None]}})})


_MIXED = "CASE WHEN ts >= TIMESTAMP '2024-01-10' AND n = 0 THEN NULL ELSE n END"


@query("separate_kinds", "fine", f", m AS (SELECT s, ts, v, w, {_MIXED} AS n, rn FROM fine)" + islands("m", "CASE WHEN n IS NULL THEN 'nan' WHEN n = 0 THEN 'zero' END", "r") + neighbours("r", "(kind = 'zero' AND len BETWEEN 1 AND 2) IS TRUE", "f", v="n") + " SELECT s, ts, v, w, CASE WHEN kind = 'nan' AND len <= 3 THEN 0.0 ELSE filled END AS n FROM f", "v w n")
def _(spark, d):
    rows = fine(spark, d).withColumn("n", F.when(~((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("n") == 0)), F.col("n")))
    return fills.filled(rows, AXIS, {"n": ColumnRules.of({"zeros": True, "merge": False, "nan_runs": {"fill_zero": [1, 3]}, "zero_runs": {"interpolate": [1, 2]}})})


@query("missing_processor", "fine", _DROP + ", k AS (SELECT s, ts, v, w, n, row_number() OVER (PARTITION BY s ORDER BY ts) AS rn FROM r WHERE NOT (kind IS NOT NULL AND len >= 7))" + islands("k", NAN, "q") + neighbours("q", "(kind IS NOT NULL AND len BETWEEN 3 AND 6)", "f") + " SELECT s, ts, filled AS v, w, n FROM f", "v w n")
def _(spark, d):
    return fills.process_missing(fine(spark, d), AXIS, _RUNS)


@query("fill_report", "fine", _DROP + neighbours("r", "(kind IS NOT NULL AND len BETWEEN 3 AND 6)", "f") + " SELECT s, 'v' AS \"column\", count(kind) AS missing_before, count(DISTINCT gid) FILTER (kind IS NOT NULL) AS runs, count_if(kind IS NOT NULL AND len <= 2) AS kept, 0 AS outliers_interpolated, count_if(spot AND filled IS NOT NULL) AS interpolated, count_if(spot AND filled IS NULL) AS interpolation_failed, 0 AS fill_zero, 0 AS ffill, 0 AS bfill, 0 AS set_nan, count_if(filled IS NULL) AS missing_after, round(100.0 * count(kind) / count(*), 4) AS missing_before_pct, round(100.0 * count_if(filled IS NULL) / count(*), 4) AS missing_after_pct FROM f GROUP BY s", "missing_before_pct missing_after_pct")
def _(spark, d):
    return fills.fill_report(fine(spark, d), AXIS, _RUNS)


@query("nan_to_zero", "fine", "SELECT s, ts, coalesce(v, 0) AS v, w, n FROM fine", "v w n")
def _(spark, d):
    return fills.nan_to_zero(fine(spark, d), ["v"])


@query("median_imputer", "fine", ", a AS (SELECT s, median(v) AS av FROM fine GROUP BY s), g AS (SELECT s, hour(ts) AS h, median(v) AS gv FROM fine GROUP BY 1, 2) SELECT f.s, f.ts, coalesce(f.v, gv, av) AS v, f.w, f.n FROM fine f JOIN a USING (s) JOIN g ON g.s = f.s AND g.h = hour(f.ts)", "v w n")
def _(spark, d):
    rows = fine(spark, d)
    return fills.median_imputed(rows, rows, AXIS, ["v"], ["hour"])


# ---- outliers
_FIT = ", f AS (SELECT s, avg(v) FILTER (v <> 0) AS m, stddev_samp(v) FILTER (v <> 0) AS sd, quantile_cont(v, 0.25) FILTER (v <> 0) AS q1, quantile_cont(v, 0.75) FILTER (v <> 0) AS q3 FROM hourly GROUP BY s)"
_Z = "coalesce(abs(v - m) / sd > 2, FALSE)"
_IQR = "coalesce(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1), FALSE)"


def _processor(spark, d, detectors, action="flag", **options):
    rows = hourly(spark, d)
    return outliers.OutlierProcessor(AXIS, detectors, columns=["v"], action=action, **options).fit(rows).transform(rows).drop("w")


def _flag(name, detectors, sql, base="hourly", **options):
    query(name, base, sql, "v n")(lambda spark, d: _processor(spark, d, detectors, **options))


_flag("outlier_zscore", {"zscore": {"threshold": 2}}, f"{_FIT} SELECT s, ts, v, n, {_Z} AS v_outlier FROM hourly JOIN f USING (s)")
_flag("outlier_iqr", {"iqr": {}}, f"{_FIT} SELECT s, ts, v, n, {_IQR} AS v_outlier FROM hourly JOIN f USING (s)")
_C = "OVER (PARTITION BY s ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)"
_flag("outlier_hampel", {"hampel": {"window": 24}}, f", a AS (SELECT *, CASE WHEN v <> 0 THEN v END AS x FROM hourly), b AS (SELECT *, abs(x - CASE WHEN count(x) {_C} >= 10 THEN quantile_cont(x, 0.5) {_C} END) AS dev FROM a), c AS (SELECT *, 1.4826 * CASE WHEN count(dev) {_C} >= 10 THEN quantile_cont(dev, 0.5) {_C} END AS sigma FROM b) SELECT s, ts, v, n, coalesce(sigma > 0 AND dev > 3 * sigma, FALSE) AS v_outlier FROM c")
_flag("outlier_rolling_median", {"rolling_median": {"window": 24, "threshold": 2.5}}, f", a AS (SELECT *, CASE WHEN count(v) {_C} >= 8 THEN abs(v - quantile_cont(v, 0.5) {_C}) / nullif(stddev_samp(v) {_C}, 0) END AS z FROM hourly) SELECT s, ts, v, n, coalesce(z > 2.5, FALSE) AS v_outlier FROM a")
_flag("outlier_diff", {"diff": {"threshold": 3}}, ", a AS (SELECT *, v - lag(v) OVER (PARTITION BY s ORDER BY ts) AS step FROM hourly), f AS (SELECT s, stddev_pop(step) FILTER (step <> 0) AS sd FROM a GROUP BY s) SELECT s, ts, v, n, coalesce(sd > 0 AND abs(step) > 3 * sd, FALSE) AS v_outlier FROM a JOIN f USING (s)")
_flag("outlier_physical", {}, "SELECT s, ts, v, n, coalesce(v < 10 OR v > 100, FALSE) AS v_outlier FROM hourly", limits={"v": (10, 100)})
for _action, _sql in {
    "set_nan": f"{_FIT} SELECT s, ts, CASE WHEN NOT {_Z} THEN v END AS v, n FROM hourly JOIN f USING (s)",
    "clip": f"{_FIT} SELECT s, ts, CASE WHEN {_Z} THEN greatest(m - 2 * sd, least(m + 2 * sd, v)) ELSE v END AS v, n FROM hourly JOIN f USING (s)",
    "drop_rows": f"{_FIT} SELECT s, ts, v, n FROM hourly JOIN f USING (s) WHERE NOT {_Z}",
    "interpolate": f"{_FIT}, z AS (SELECT * FROM hourly JOIN f USING (s))" + neighbours("z", _Z, "i") + " SELECT s, ts, filled AS v, n FROM i",
}.items():
    _flag(f"outlier_{_action}", {"zscore": {"threshold": 2}}, _sql, action=_action)


@query("outlier_diagnose", "hourly", f"{_FIT}, a AS (SELECT s, {_Z} AS z, {_IQR} AS i FROM hourly JOIN f USING (s)) SELECT s, 'v' AS \"column\", detector, count_if(flag) AS count, round(100 * avg(CASE WHEN flag THEN 1.0 ELSE 0 END), 4) AS pct FROM (SELECT s, 'zscore' AS detector, z AS flag FROM a UNION ALL SELECT s, 'iqr', i FROM a UNION ALL SELECT s, 'applied', z FROM a) GROUP BY s, detector", "pct")
def _(spark, d):
    rows = hourly(spark, d)
    return outliers.OutlierProcessor(AXIS, {"zscore": {"threshold": 2}, "iqr": {}}, ["zscore"], columns=["v"]).fit(rows).diagnose(rows)


# ---- cleaner
_CONFIG = {"missing": {"columns": {"v": {"runs": RULES}}}, "outliers": {"detectors": {"zscore": {"threshold": 3}}}, "exclude": [{"start": "2024-01-05 00:00", "end": "2024-01-05 01:00", "columns": ["v"]}]}
_EXCLUDED = ", e AS (SELECT s, ts, CASE WHEN ts BETWEEN TIMESTAMP '2024-01-05 00:00' AND TIMESTAMP '2024-01-05 01:00' THEN NULL ELSE v END AS v, n, rn FROM fine)" + islands("e", NAN, "r")
_KEPT = ", k AS (SELECT s, ts, v, n, row_number() OVER (PARTITION BY s ORDER BY ts) AS rn FROM r WHERE NOT (kind IS NOT NULL AND len >= 7)), f AS (SELECT s, avg(v) FILTER (v <> 0) AS m, stddev_samp(v) FILTER (v <> 0) AS sd, count(v) FILTER (v <> 0) AS c FROM k GROUP BY s)"


def _cleaner(spark, d):
    rows = fine(spark, d).drop("w")
    return Cleaner(AXIS, _CONFIG, columns=["v"]).fit(rows), rows


@query("cleaner", "fine", _EXCLUDED + _KEPT + islands("k", NAN, "q") + ", z AS (SELECT * FROM q JOIN f USING (s))" + neighbours("z", "((kind IS NOT NULL AND len BETWEEN 3 AND 6) OR coalesce(c >= 10 AND sd > 0 AND abs(v - m) / sd > 3, FALSE))", "i") + " SELECT s, ts, filled AS v, n FROM i", "v n")
def _(spark, d):
    cleaner, rows = _cleaner(spark, d)
    return cleaner.transform(rows)


@query("cleaner_plan", "fine", _EXCLUDED + f", p AS (SELECT s, len, {ACTION} AS action FROM r WHERE kind IS NOT NULL) SELECT s, 'v' AS \"column\", 'missing' AS kind, CASE action WHEN 'keep' THEN '[1, 2]' WHEN 'interpolate' THEN '[3, 6]' ELSE '[7, inf]' END AS length, action, CAST(round(sum(1.0 / len)) AS BIGINT) AS runs, count(*) AS points FROM p GROUP BY s, action")
def _(spark, d):
    cleaner, rows = _cleaner(spark, d)
    return cleaner.plan(rows)["runs"]


@query("cleaner_removed", "fine", _EXCLUDED + " SELECT s, min(ts) AS start, max(ts) AS \"end\", count(*) AS rows, 'v' AS reason FROM r WHERE kind IS NOT NULL AND len >= 7 GROUP BY s, gid")
def _(spark, d):
    cleaner, rows = _cleaner(spark, d)
    return cleaner.get_report(rows)["removed_periods"]


# ---- features
@query("calendar", "hourly", "SELECT s, ts, hour(ts) AS HOUR, day(ts) AS DAY, month(ts) AS MONTH, year(ts) AS YEAR, isodow(ts) - 1 AS WEEKDAY, dayofyear(ts) AS DAY_OF_YEAR, hour(ts) * 60 + minute(ts) AS MINUTE_OF_DAY, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS WEEKEND FROM hourly")
def _(spark, d):
    return features.calendar_features(hourly(spark, d).select("s", "ts"), "ts", ["hour", "day", "month", "year", "weekday", "day_of_year", "minute_of_day", "weekend"])


@query("cyclic", "hourly", "SELECT s, ts, sin(2 * pi() * v / 360) AS v_SIN, cos(2 * pi() * v / 360) AS v_COS, sin(2 * pi() * hour(ts) / 24) AS HOUR_SIN, cos(2 * pi() * hour(ts) / 24) AS HOUR_COS FROM hourly", "v_SIN v_COS HOUR_SIN HOUR_COS")
def _(spark, d):
    return features.cyclic_features(hourly(spark, d).select("s", "ts", "v"), "ts", {"v": 360, "hour": 24})


@query("lags", "binned", " SELECT a.s, a.ts, a.v, b.v AS v_lag_1, c.v AS v_lag_24 FROM binned a LEFT JOIN binned b ON b.s = a.s AND b.ts = a.ts - INTERVAL 1 HOUR LEFT JOIN binned c ON c.s = a.s AND c.ts = a.ts - INTERVAL 24 HOUR", "v v_lag_1 v_lag_24")
def _(spark, d):
    return features.lag_features(binned(spark, d).select("s", "ts", "v"), AXIS, ["v"], [1, 24], "1h")


_R = "OVER (PARTITION BY s ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


@query("rolling", "binned", f"SELECT s, ts, v, " + ", ".join(f"CASE WHEN count(v) {_R} >= 6 THEN {f} {_R} END AS v_roll_{n}_6" for n, f in (("mean", "avg(v)"), ("std", "stddev_samp(v)"), ("median", "quantile_cont(v, 0.5)"), ("max", "max(v)"))) + " FROM binned", "v v_roll_mean_6 v_roll_std_6 v_roll_median_6 v_roll_max_6")
def _(spark, d):
    return features.rolling_features(binned(spark, d).select("s", "ts", "v"), AXIS, ["v"], [6], ["mean", "std", "median", "max"], "1h")


_RC = "OVER (PARTITION BY s ORDER BY ts RANGE BETWEEN INTERVAL 3 HOUR - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW)".replace("INTERVAL 3 HOUR - INTERVAL 1 MICROSECOND", "INTERVAL '2:59:59.999999'")


@query("rolling_current", "binned", f"SELECT s, ts, v, CASE WHEN count(v) {_RC} >= 3 THEN sum(v) {_RC} END AS v_roll_sum_3 FROM binned", "v v_roll_sum_3")
def _(spark, d):
    return features.rolling_features(binned(spark, d).select("s", "ts", "v"), AXIS, ["v"], [3], ["sum"], "1h", include_current=True)


@query("windows", "binned", ", a AS (SELECT *, CASE WHEN w IS NOT NULL THEN 1 ELSE 0 END AS ok, CASE WHEN ts - lag(ts) OVER (PARTITION BY s ORDER BY ts) = INTERVAL 1 HOUR THEN 1 ELSE 0 END AS near FROM binned), b AS (SELECT *, sum(ok) OVER (PARTITION BY s ORDER BY ts ROWS 5 PRECEDING) AS oks, sum(near) OVER (PARTITION BY s ORDER BY ts ROWS 4 PRECEDING) AS nears, list(w) OVER (PARTITION BY s ORDER BY ts ROWS 5 PRECEDING) AS ws FROM a) SELECT s, ts, rn - 1 AS position, ws[1] AS first, ws[6] AS last, list_sum(ws) AS total FROM b WHERE oks = 6 AND nears = 5 AND rn >= 6", "first last total")
def _(spark, d):
    found = features.make_windows(binned(spark, d), AXIS, ["w"], 6, "1h")
    return found.select("s", "ts", "position", F.col("window")[0][0].alias("first"), F.col("window")[5][0].alias("last"), F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]).alias("total"))


# ---- scaling
_STATS = ", p AS (SELECT avg(v) AS m, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1, median(v) AS q2, quantile_cont(v, 0.75) AS q3, max(abs(v)) AS ma FROM hourly)"
for _method, _expr in {"standard": "(v - m) / sd", "minmax": "(v - lo) / (hi - lo) * 2 - 1", "robust": "(v - q2) / (q3 - q1)", "maxabs": "v / ma"}.items():
    query(f"scale_{_method}", "hourly", f"{_STATS} SELECT s, ts, {_expr} AS v FROM hourly, p", "v")(
        lambda spark, d, m=_method: scaling.Scaler(m, ["v"], feature_range=(-1, 1) if m == "minmax" else (0, 1)).fit(hourly(spark, d)).transform(hourly(spark, d).select("s", "ts", "v"))
    )


@query("scale_inverse", "hourly", "SELECT s, ts, v FROM hourly", "v")
def _(spark, d):
    scaler = scaling.Scaler("robust", ["v"]).fit(hourly(spark, d))
    return scaler.inverse_transform(scaler.transform(hourly(spark, d).select("s", "ts", "v")))


def _target(kind, back=False):
    def run(spark, d):
        rows = hourly(spark, d).select("s", "ts", "v")
        t = scaling.TargetTransform(kind).fit(rows, "v")
        z = t.transform(F.col("v"))
        return rows.withColumn("v", t.inverse_transform(z) if back else z)

    return run


query("target_minmax", "hourly", f"{_STATS} SELECT s, ts, (v - lo) / (hi - lo) AS v FROM hourly, p", "v")(_target("minmax"))
_U = "greatest(1e-6, least(1 - 1e-6, (v - lo) / (hi - lo + 1e-6)))"
query("target_logit", "hourly", f"{_STATS} SELECT s, ts, CASE WHEN v IS NOT NULL THEN greatest(-10, least(10, ln({_U} / (1 - {_U})))) END AS v FROM hourly, p", "v")(_target("minmax_logit"))
query("target_minmax_inverse", "hourly", "SELECT s, ts, v FROM hourly", "v")(_target("minmax", True))


# ---- merge
@query("merge_outer", ("daily", "shipped"), "SELECT coalesce(d.ts, h.ts) AS ts, price, d.orders AS a_orders, discount, h.orders AS b_orders FROM daily d FULL JOIN shipped h ON d.ts = h.ts", "price a_orders discount b_orders")
def _(spark, d):
    return merge.merge_by_time({"a": daily(spark, d), "b": shipped(spark, d)}, DAY)


@query("merge_inner", ("daily", "shipped"), "SELECT d.ts, price AS a_price, d.orders AS a_orders, discount AS b_discount, h.orders AS b_orders FROM daily d JOIN shipped h ON d.ts = h.ts", "a_price a_orders b_discount b_orders")
def _(spark, d):
    return merge.merge_by_time({"a": daily(spark, d), "b": shipped(spark, d)}, DAY, "inner", prefix=True)


# ---- statistics
_PAIRS = "(VALUES ('v', 'w'), ('v', 'n'), ('w', 'n')) AS c(a, b)"
_LONG = ", l AS (SELECT s, a, b, CASE a WHEN 'v' THEN v ELSE w END AS x, CASE b WHEN 'w' THEN w ELSE n END AS y FROM fine, (VALUES ('v', 'w'), ('v', 'n'), ('w', 'n')) AS c(a, b)), p AS (SELECT * FROM l WHERE x IS NOT NULL AND y IS NOT NULL)"


@query("corr_pearson", "fine", _LONG + " SELECT s, a, b, corr(x, y) AS r, count(*) AS n FROM p GROUP BY s, a, b", "r")
def _(spark, d):
    return stats.correlation(fine(spark, d), ["v", "w", "n"], keys=("s",))


_RANK = "rank() OVER (PARTITION BY s, a, b ORDER BY {0}) + (count(*) OVER (PARTITION BY s, a, b, {0}) - 1) / 2.0 AS r{0}"


@query("corr_spearman", "fine", _LONG + f", q AS (SELECT *, {_RANK.format('x')}, {_RANK.format('y')} FROM p) SELECT s, a, b, corr(rx, ry) AS r, count(*) AS n FROM q GROUP BY s, a, b", "r")
def _(spark, d):
    return stats.correlation(fine(spark, d), ["v", "w", "n"], "spearman", ("s",))


@query("corr_kendall", "hourly", ", p AS (SELECT s, rn, v, n FROM hourly WHERE v IS NOT NULL), q AS (SELECT a.s, sign(a.v - b.v) * sign(a.n - b.n) AS c, abs(sign(a.v - b.v)) AS x, abs(sign(a.n - b.n)) AS y FROM p a JOIN p b ON a.s = b.s AND a.rn < b.rn) SELECT s, 'v' AS a, 'n' AS b, sum(c) / (sqrt(sum(x)) * sqrt(sum(y))) AS r, (SELECT count(*) FROM p WHERE p.s = q.s) AS n FROM q GROUP BY s", "r")
def _(spark, d):
    return stats.correlation(hourly(spark, d), ["v", "n"], "kendall", ("s",))


@query("pair_counts", "fine", _LONG + " SELECT s, a, b, count(*) AS n FROM p GROUP BY s, a, b")
def _(spark, d):
    return stats.pair_counts(fine(spark, d), ["v", "w", "n"], ("s",))


@query("target_correlation", "fine", _LONG + " SELECT s, b AS \"column\", corr(x, y) AS r FROM p WHERE a = 'v' GROUP BY s, b", "r")
def _(spark, d):
    return stats.target_correlation(fine(spark, d), ["w", "n"], "v", keys=("s",))


@query("acf", "hourly", neighbours("hourly", "v IS NULL", "i") + ", e AS (SELECT s, rn, coalesce(filled, last_value(filled IGNORE NULLS) OVER (PARTITION BY s ORDER BY rn), first_value(filled IGNORE NULLS) OVER (PARTITION BY s ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM i), c AS (SELECT s, rn, x - avg(x) OVER (PARTITION BY s) AS x FROM e), q AS (SELECT s, sum(x * x) AS q FROM c GROUP BY s) SELECT a.s, a.rn - b.rn AS lag, sum(a.x * b.x) / any_value(q) AS acf FROM c a JOIN c b ON a.s = b.s AND a.rn - b.rn BETWEEN 0 AND 48 JOIN q ON q.s = a.s GROUP BY 1, 2", "acf")
def _(spark, d):
    return stats.acf(hourly(spark, d), AXIS, "v", 48)


_CENTRED = neighbours("hourly", "v IS NULL", "i") + ", e AS (SELECT s, rn, coalesce(filled, last_value(filled IGNORE NULLS) OVER (PARTITION BY s ORDER BY rn), first_value(filled IGNORE NULLS) OVER (PARTITION BY s ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM i), c AS (SELECT s, rn - 1 AS t, x - avg(x) OVER (PARTITION BY s) AS x, count(*) OVER (PARTITION BY s) AS n FROM e)"


@query("spectrum", "hourly", _CENTRED + ", k AS (SELECT DISTINCT s, n, unnest(range(1, n // 2 + 1)) AS k FROM (SELECT DISTINCT s, n FROM c)), w AS (SELECT s, k, any_value(c.n) AS n, sum(x * cos(2 * pi() * ((k * t) % c.n) / c.n)) AS a, sum(x * sin(2 * pi() * ((k * t) % c.n) / c.n)) AS b FROM c JOIN k USING (s) GROUP BY s, k) SELECT s, k / n AS frequency, n / k AS period_steps, n / k AS period_hours, round(a * a + b * b, 3) AS power FROM w", "frequency period_steps period_hours power")
def _(spark, d):
    return stats.spectrum(hourly(spark, d), AXIS, "v").withColumn("power", F.round("power", 3))


@query("histogram", "hourly", ", e AS (SELECT s, min(v) AS lo, max(v) AS hi FROM hourly GROUP BY s), p AS (SELECT s, lo, (hi - lo) / 20 AS step, CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin FROM hourly JOIN e USING (s) WHERE v IS NOT NULL) SELECT s, bin, lo + bin * step AS low, lo + (bin + 1) * step AS high, count(*) AS n FROM p GROUP BY s, bin, lo, step", "low high")
def _(spark, d):
    return stats.histogram(hourly(spark, d), "v", 20, ("s",))


@query("box", "hourly", "SELECT s, 'v' AS \"column\", min(v) AS low, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS high FROM hourly GROUP BY s", "low q1 median q3 high")
def _(spark, d):
    return stats.box(hourly(spark, d), ["v"], ("s",))


@query("wind_rose", "hourly", ", r AS (SELECT s, v, (w * 7) % 360 AS d FROM hourly WHERE v IS NOT NULL AND w IS NOT NULL) SELECT s, CAST(floor((d + 11.25) / 22.5) AS BIGINT) % 16 AS sector, CASE WHEN v >= 60 THEN 2 WHEN v >= 40 THEN 1 ELSE 0 END AS speed_class, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM r b WHERE b.s = r.s) AS share FROM r WHERE v BETWEEN 0 AND 100 GROUP BY 1, 2, 3", "share")
def _(spark, d):
    return stats.wind_rose(hourly(spark, d).withColumn("d", F.col("w") * 7), "v", "d", 16, [0.0, 40.0, 60.0, 100.0], ("s",))


# ---- sources: an untidy file of daily orders, written to the shared folder
def _untidy(spark, d) -> str:
    """A file in cp1251 with remarks, semicolons, decimal commas, cells and times that can't be read, and lines out of order."""
    rows = daily(spark, d).select("ts", F.date_format("ts", "dd.MM.yyyy HH:mm").alias("t"), F.format_string("%.6f", "price").alias("p"), F.col("orders").cast("long").cast("string").alias("o")).orderBy("ts").collect()  # one line for each day
    lines = [(r.o, f"{'нет' if int(r.o) % 7 == 5 else r.t};{'сбой' if int(r.o) % 5 == 3 else r.p.replace('.', ',')};{r.o};день {r.ts:%j}") for r in rows]
    text = "Станция;ПС-2\r\nвысота;12\r\n\r\nTIMESTAMP;PRICE;ORDERS;COMMENT\r\n" + "".join(f"{line}\r\n" for _, line in sorted(lines, key=lambda x: x[0]))
    path = f"{scratch.shared_dir(spark)}/untidy-{uuid.uuid4().hex}.csv"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(text.encode("cp1251")))
    out.close()
    return path


_UNTIDY = ", u AS (SELECT ts, CASE WHEN CAST(orders AS BIGINT) % 5 <> 3 THEN price END AS price, orders, 'день ' || strftime(ts, '%j') AS comment, CAST(orders AS BIGINT) % 7 = 5 AS lost FROM daily)"


@query("source_untidy", "daily", _UNTIDY + " SELECT ts, price, orders, comment FROM u WHERE NOT lost", "price orders")
def _(spark, d):
    found = tables.load_table(spark, _untidy(spark, d), target="PRICE", time_format="%d.%m.%Y %H:%M").df
    return found.select(F.col("TIMESTAMP").alias("ts"), F.col("PRICE").cast("double").alias("price"), F.col("ORDERS").cast("double").alias("orders"), F.col("COMMENT").alias("comment"))


@query("source_info", "daily", _UNTIDY + ", b AS (SELECT * FROM u WHERE NOT lost) SELECT (SELECT count(*) FROM u) AS rows_read, (SELECT count(*) FROM u WHERE lost) AS bad_timestamps, (SELECT count(*) FROM b) AS rows, (SELECT count(*) FROM b WHERE price IS NULL) AS bad_prices, 'PRICE' AS target, 'ORDERS' AS features, 'ignore' AS comment_role")
def _(spark, d):
    ds = tables.load_table(spark, _untidy(spark, d), target="PRICE")
    i = ds.info
    row = (i["rows_read"], i["bad_timestamps"], i["rows"], i["coercion_failures"].get("PRICE", 0), ds.target, ",".join(ds.features), ds.spec.columns["COMMENT"].role)
    return spark.createDataFrame([row], "rows_read long, bad_timestamps long, rows long, bad_prices long, target string, features string, comment_role string")


@query("source_preview", (), "SELECT * FROM (VALUES (0, 'Станция', 'ПС-2', false), (1, 'высота', '12', false), (2, '', '', false), (3, 'TIMESTAMP', 'PRICE', true)) t(row, first, second, header)")
def _(spark, d):
    rows, header = tables.raw_preview(spark, _untidy(spark, d), 4)
    return spark.createDataFrame([(i, r[0], r[1], i == header) for i, r in enumerate(rows)], "row int, first string, second string, header boolean")


# ---- splits
def _parts(split):
    return split.train.withColumn("part", F.lit("train")).unionByName(split.val.withColumn("part", F.lit("val"))).unionByName(split.test.withColumn("part", F.lit("test")))


_LAST = "(SELECT max(ts) FROM hourly)"


@query("split_duration", "hourly", f"SELECT s, ts, v, CASE WHEN ts > {_LAST} - INTERVAL 5 DAY THEN 'test' WHEN ts > (SELECT max(ts) FROM hourly WHERE ts <= {_LAST} - INTERVAL 5 DAY) - INTERVAL 2 DAY THEN 'val' ELSE 'train' END AS part FROM hourly", "v")
def _(spark, d):
    return _parts(splits.split_by_time(hourly(spark, d).select("s", "ts", "v"), AXIS, "5D", "2D"))


@query("split_count", "hourly", ", r AS (SELECT ts, dense_rank() OVER (ORDER BY ts DESC) AS k FROM (SELECT DISTINCT ts FROM hourly)) SELECT s, ts, CASE WHEN k <= 24 THEN 'test' WHEN k <= 36 THEN 'val' ELSE 'train' END AS part FROM hourly JOIN r USING (ts)")
def _(spark, d):
    return _parts(splits.split_by_time(hourly(spark, d).select("s", "ts"), AXIS, 24, 12))


@query("split_date", "hourly", "SELECT s, ts, v, CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 'test' WHEN ts >= TIMESTAMP '2024-01-20' THEN 'val' ELSE 'train' END AS part FROM hourly", "v")
def _(spark, d):
    return _parts(splits.split_by_time(hourly(spark, d).select("s", "ts", "v"), AXIS, "2024-01-25", "2024-01-20"))


@query("split_rows", "hourly", ", b AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts DESC) AS k FROM hourly) SELECT s, ts, CASE WHEN k <= 120 THEN 'test' WHEN k <= 168 THEN 'val' ELSE 'train' END AS part FROM b")
def _(spark, d):
    return splits.split_rows(hourly(spark, d).select("s", "ts"), AXIS, 120, 48)


@query("split_boundaries", "hourly", f", p AS (SELECT ts, CASE WHEN ts > {_LAST} - INTERVAL 5 DAY THEN 'test' ELSE 'train' END AS part FROM hourly) SELECT part, min(ts) AS start, max(ts) AS \"end\", count(*) AS rows FROM p GROUP BY part")
def _(spark, d):
    return splits.split_by_time(hourly(spark, d), AXIS, "5D").boundaries(AXIS)


@query("expanding_folds", "hourly", f"SELECT fold, CASE WHEN ts > hi - INTERVAL 4 DAY THEN 'test' ELSE 'train' END AS part, count(*) AS rows FROM hourly, (SELECT 2 - i AS fold, {_LAST} - i * INTERVAL 4 DAY AS hi FROM range(3) t(i)) WHERE ts <= hi GROUP BY 1, 2")
def _(spark, d):
    out = None
    for i, s in enumerate(splits.expanding_window_splits(hourly(spark, d), AXIS, 3, "4D")):
        for n, p in s.parts().items():
            row = p.agg(F.count("*").alias("rows")).select(F.lit(i).alias("fold"), F.lit(n).alias("part"), "rows")
            out = row if out is None else out.unionByName(row)
    return out


# ---- metrics, of the value a day before as the forecast
def _naive(spark, d):
    return hourly(spark, d).withColumns({"p": F.lag("v", 24).over(AXIS.window()), "sd": F.lit(20.0)}).withColumns({"lo": F.col("p") - 20, "hi": F.col("p") + 20}).select("s", "ts", "v", "p", "sd", "lo", "hi")


_NAIVE = ", a AS (SELECT s, ts, rn, v, lag(v, 24) OVER (PARTITION BY s ORDER BY ts) AS p FROM hourly), m AS (SELECT *, p - v AS e, CASE WHEN p IS NOT NULL THEN v END AS t FROM a)"
_M = {
    "mae": "avg(abs(e))", "mse": "avg(e * e)", "rmse": "sqrt(avg(e * e))", "r2": "1 - avg(e * e) / var_pop(CASE WHEN e IS NOT NULL THEN t END)", "bias": "avg(e)",
    "mape": "100 * avg(CASE WHEN abs(v) > 1e-9 THEN abs(e / v) END)", "smape": "100 * avg(2 * abs(e) / nullif(abs(v) + abs(p), 0))", "nmae": "avg(abs(e)) / 100", "nrmse": "sqrt(avg(e * e)) / 100",
    "coverage": "100 * avg(CASE WHEN v IS NOT NULL AND p IS NOT NULL THEN CASE WHEN v BETWEEN p - 20 AND p + 20 THEN 1.0 ELSE 0 END END)", "interval_width": "avg((p + 20) - (p - 20))",
}


@query("metrics", "hourly", f"{_NAIVE} SELECT s, {', '.join(f'{e} AS {n}' for n, e in _M.items())} FROM m GROUP BY s", " ".join(_M))
def _(spark, d):
    return metrics.evaluate(_naive(spark, d), "v", "p", list(_M), ("s",), norm=100.0, lower="lo", upper="hi")


_T = "(1 / (1 + 0.3275911 * abs(z / sqrt(2))))"
_ERF = f"(sign(z) * (1 - ({_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429))))) * exp(-z * z / 2)))"


@query("metrics_crps", "hourly", f"{_NAIVE}, z AS (SELECT s, -e / 20 AS z FROM m WHERE e IS NOT NULL) SELECT s, avg(20 * (z * {_ERF} + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))) AS crps FROM z GROUP BY s", "crps")
def _(spark, d):
    return metrics.evaluate(_naive(spark, d), "v", "p", ["crps"], ("s",), std="sd")


_W = f"{_NAIVE}, c AS (SELECT s, count(*) AS total FROM a GROUP BY s), w AS (SELECT s, unnest(range(0, (total - 120) // 24 + 1)) AS window_id FROM c WHERE total >= 120), x AS (SELECT w.window_id, m.* FROM w JOIN m ON m.s = w.s AND m.rn > w.window_id * 24 AND m.rn <= w.window_id * 24 + 120)"


@query("metrics_by_window", "hourly", f"{_W} SELECT s, window_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, avg(abs(e)) / 100 AS nmae, sqrt(avg(e * e)) / 100 AS nrmse FROM x GROUP BY s, window_id", "nmae nrmse")
def _(spark, d):
    return metrics.evaluate_by_window(_naive(spark, d), AXIS, "v", "p", 120, 24, ["nmae", "nrmse"], norm=100.0)


@query("metrics_by_duration", "hourly", f"{_NAIVE}, b AS (SELECT s, min(ts) AS t0, max(ts) + INTERVAL 1 HOUR AS t1 FROM a GROUP BY s), w AS (SELECT s, t0, unnest(range(0, epoch_us(t1 - INTERVAL 2 DAY) // 86400000000 - epoch_us(t0) // 86400000000 + 2)) AS window_id, t1 FROM b), y AS (SELECT s, window_id, t0 + window_id * INTERVAL 1 DAY AS lo, t0 + (window_id + 2) * INTERVAL 1 DAY AS hi FROM w WHERE t0 + (window_id + 2) * INTERVAL 1 DAY <= t1) SELECT y.s, window_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, avg(abs(e)) AS mae FROM y JOIN m ON m.s = y.s AND m.ts >= lo AND m.ts < hi GROUP BY y.s, window_id", "mae")
def _(spark, d):
    return metrics.evaluate_by_window(_naive(spark, d), AXIS, "v", "p", "2D", "1D", ["mae"])


@query("metrics_by_group", "hourly", f"{_NAIVE} SELECT s, hour(ts) AS \"group\", count(*) AS n, avg(abs(e)) AS mae, avg(e) AS bias FROM m GROUP BY 1, 2", "mae bias")
def _(spark, d):
    return metrics.evaluate_by_group(_naive(spark, d), AXIS, "v", "p", "hour", ["mae", "bias"])


@query("summarize_windows", "hourly", f"{_W}, g AS (SELECT s, window_id, avg(abs(e)) AS mae FROM x GROUP BY s, window_id) SELECT s, 'mae' AS metric, avg(mae) AS mean, stddev_samp(mae) AS std, min(mae) AS min, max(mae) AS max FROM g GROUP BY s", "mean std min max")
def _(spark, d):
    return metrics.summarize_windows(metrics.evaluate_by_window(_naive(spark, d), AXIS, "v", "p", 120, 24, ["mae"]), ["mae"], ("s",))


@query("residuals", "hourly", f"{_NAIVE}, b AS (SELECT s, min(e) AS lo, max(e) AS hi FROM m GROUP BY s), q AS (SELECT m.s, lo, (hi - lo) / 10 AS step, CAST(least(floor((e - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin FROM m JOIN b USING (s) WHERE e IS NOT NULL) SELECT s, bin, lo + bin * step AS low, lo + (bin + 1) * step AS high, count(*) AS n FROM q GROUP BY s, bin, lo, step", "low high")
def _(spark, d):
    return stats.histogram(_naive(spark, d).withColumn("e", F.col("p") - F.col("v")), "e", 10, ("s",))


@query("dataset_slice", "hourly", "SELECT s, ts, v FROM hourly WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'", "v")
def _(spark, d):
    from .frame import Dataset

    return Dataset(hourly(spark, d).select("s", "ts", "v"), AXIS).slice("2024-01-10", "2024-01-12").df


@query("reference_power", "hourly", "SELECT max(abs(v)) AS power, 'max' AS basis FROM hourly", "power")
def _(spark, d):
    from .frame import Dataset
    from .spec import StationSpec

    power, basis = Dataset(hourly(spark, d), AXIS, StationSpec.from_dict({"columns": {"v": "target"}})).reference_power()
    return spark.range(1).select(F.lit(power).alias("power"), F.lit(basis).alias("basis"))


@query("head", "hourly", "SELECT s, ts, v FROM hourly ORDER BY s, ts LIMIT 10", "v")
def _(spark, d):
    return hourly(spark, d).select("s", "ts", "v").orderBy("s", "ts").limit(10)


# ---- forecasts
def _lagged(spark, d):
    from .plans.forecaster import Forecaster

    split = splits.split_by_time(hourly(spark, d).select("s", "ts", "v"), AXIS, "5D")
    return Forecaster("linear", AXIS, target="v", features=[], lags={"v": [24]}, freq="1h").fit(split.train), split


@query("forecast_linear", "hourly", f"""{_NAIVE}, c AS (SELECT max(ts) - INTERVAL 5 DAY AS cut FROM hourly), f AS (SELECT regr_slope(v, p) AS k, regr_intercept(v, p) AS b FROM a, c WHERE ts <= cut)
SELECT s, ts, v, k * p + b AS prediction FROM a, c, f WHERE ts > cut""", "v prediction")
def _(spark, d):
    forecaster, split = _lagged(spark, d)
    return forecaster.predict(split.test, split.train).select("s", "ts", "v", "prediction")


@query("forecast_recursive", "hourly", f"""{_NAIVE}, c AS (SELECT max(ts) - INTERVAL 5 DAY AS cut FROM hourly), f AS (SELECT regr_slope(v, p) AS k, regr_intercept(v, p) AS b FROM a, c WHERE ts <= cut)
SELECT s, ts, k * p + b AS prediction FROM a, c, f WHERE ts > cut AND ts <= cut + INTERVAL 3 HOUR""", "prediction")
def _(spark, d):
    forecaster, split = _lagged(spark, d)
    first = split.test.where(F.col("ts") <= F.lit(split.train.agg(F.max("ts")).first()[0]) + F.expr("INTERVAL 3 HOURS"))
    return forecaster.predict_recursive(first, split.train).select("s", "ts", "prediction")


@query("forecast_recursive_whole")
def _(spark, d):
    """The counts of events, for ``v`` has gaps that would end every forecast, through the whole test part. Lag 1 feeds back."""
    from .plans.forecaster import Forecaster

    split = splits.split_by_time(hourly(spark, d).select("s", "ts", "n"), AXIS, "5D")
    forecaster = Forecaster("linear", AXIS, target="n", features=[], lags={"n": [1, 24]}, freq="1h").fit(split.train)
    return forecaster.predict_recursive(split.test, split.train).select("s", "ts", "n", "prediction")


@query("forecast_evaluate", "hourly", f"""{_NAIVE}, c AS (SELECT max(ts) - INTERVAL 5 DAY AS cut FROM hourly), f AS (SELECT regr_slope(v, p) AS k, regr_intercept(v, p) AS b FROM a, c WHERE ts <= cut)
SELECT avg(abs(k * p + b - v)) / 100 AS nmae, sqrt(avg((k * p + b - v) * (k * p + b - v))) / 100 AS nrmse FROM a, c, f WHERE ts > cut""", "nmae nrmse")
def _(spark, d):
    forecaster, split = _lagged(spark, d)
    found = forecaster.evaluate(split.test, split.train, ["nmae", "nrmse"], norm=100.0)
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in found.items()))
