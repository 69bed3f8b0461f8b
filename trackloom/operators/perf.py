"""Frames for comparing implementations, scaling and time spent."""

from __future__ import annotations

from collections.abc import Callable
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..work import materialise


def comparison(results: DataFrame) -> DataFrame:
    """Adds relative_speed, memory_efficiency and overall_score to (implementation, execution_time, memory_usage_mb, accuracy).

    With one row the ratios are not taken (null).
    """
    whole = W.partitionBy()
    many = F.count("*").over(whole) > 1
    speed = F.min("execution_time").over(whole) / F.col("execution_time")
    memory = F.min("memory_usage_mb").over(whole) / F.greatest("memory_usage_mb", F.lit(0.1))
    out = results.withColumn("relative_speed", F.when(many, speed)).withColumn("memory_efficiency", F.when(many, memory))
    usage = F.col("memory_usage_mb") / F.greatest(F.max("memory_usage_mb").over(whole), F.lit(0.1))
    return out.withColumn("overall_score", F.when(many, 0.5 * F.col("relative_speed") + 0.3 / F.greatest(usage, F.lit(0.1)) + 0.2 * F.coalesce("accuracy", F.lit(0.0))))


def scalability_fit(runs: DataFrame) -> DataFrame:
    """model, r2, best of least squares of ``seconds`` on n, on (n, n^2) and on n log2(n + 1).

    Sums for the normal equations come from one aggregate; the quadratic's are centred.
    """
    n, y = F.col("n").cast("double"), F.col("seconds").cast("double")
    x2 = n * F.log2(n + 1)
    s = runs.select(n.alias("n"), y.alias("y"), x2.alias("l")).crossJoin(runs.agg(F.avg("n").alias("mn"), F.avg("seconds").alias("my")))
    u, q, v = F.col("n") - F.col("mn"), F.col("n") * F.col("n"), F.col("y") - F.col("my")
    sums = s.agg(
        F.regr_r2("y", "n").alias("linear"), F.regr_r2("y", "l").alias("n_log_n"), F.sum(v * v).alias("tot"),
        F.covar_pop(F.col("n"), F.col("n")).alias("a"), F.covar_pop(F.col("n"), q).alias("b"), F.covar_pop(q, q).alias("c"), F.covar_pop(F.col("n"), F.col("y")).alias("d"), F.covar_pop(q, F.col("y")).alias("e"), F.var_pop("y").alias("t"), F.sum(u * 0).alias("z"),
    )
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    quad = F.when((F.col("t") > 0) & (det > 0), ((F.col("c") * F.col("d") - F.col("b") * F.col("e")) * F.col("d") + (F.col("a") * F.col("e") - F.col("b") * F.col("d")) * F.col("e")) / det / F.col("t")).otherwise(0.0)
    zero = lambda c: F.when(F.col("tot") > 0, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), zero(c).alias("r2"), F.lit(k).alias("k")) for k, (m, c) in enumerate((("linear", F.col("linear")), ("quadratic", quad), ("n_log_n", F.col("n_log_n"))))]))
    fits = sums.select(each.alias("m")).select("m.*")
    return fits.withColumn("best", F.row_number().over(W.orderBy(F.col("r2").desc(), "k")) == 1).drop("k")


def complexity(runs: DataFrame) -> DataFrame:
    """exponent of the last two sizes, and its class."""
    w = W.orderBy("n")
    e = runs.select("n", (F.log(F.col("seconds") / F.lag("seconds").over(w)) / F.log(F.col("n") / F.lag("n").over(w))).alias("exponent")).orderBy(F.col("n").desc()).limit(1)
    return e.select("exponent", F.when(F.col("exponent") < 1.2, "near linear").when(F.col("exponent") < 1.8, "n log n").otherwise("near quadratic").alias("class"))


def speedup_efficiency(runs: DataFrame) -> DataFrame:
    """(n_jobs, seconds): speed-up over one job, efficiency, and the parallel fraction p of Amdahl's law fitted to all rows.

    1 / speedup = 1 - p (1 - 1 / n), so p is a least-squares slope through the origin.
    """
    serial = runs.filter("n_jobs = 1").agg(F.min("seconds").alias("serial"))
    s = runs.crossJoin(serial).withColumn("speedup", F.col("serial") / F.col("seconds")).withColumn("efficiency", F.col("speedup") / F.col("n_jobs"))
    x, y = 1 - 1 / F.col("n_jobs"), 1 - 1 / F.col("speedup")
    fit = s.agg(F.when(F.sum(x * x) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(x * y) / F.sum(x * x)))).otherwise(0.0).alias("parallel_fraction"))
    return s.drop("serial").crossJoin(fit)


def bottlenecks(calls: DataFrame, least_share: float = 0.1) -> DataFrame:
    """function, seconds, n_calls, share: functions over the share of all time, largest first, with a priority."""
    t = calls.groupBy("function").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n_calls"))
    s = t.withColumn("share", F.col("seconds") / F.sum("seconds").over(W.partitionBy()))
    return s.filter(F.col("share") > least_share).withColumn("priority", F.when(F.col("share") > 0.3, "high").when(F.col("share") > 0.2, "medium").otherwise("low")).orderBy(F.col("share").desc(), "function")


def memory_peaks(snapshots: DataFrame) -> DataFrame:
    """(seq, mb): change to the one before (first 0), and whether it passes mean + 2 deviations of all changes."""
    d = snapshots.withColumn("diff_mb", F.coalesce(F.col("mb") - F.lag("mb").over(W.orderBy("seq")), F.lit(0.0)))
    whole = W.partitionBy()
    return d.withColumn("is_peak", F.col("diff_mb") > F.avg("diff_mb").over(whole) + 2 * F.stddev_samp("diff_mb").over(whole))


def memory_trend(snapshots: DataFrame) -> DataFrame:
    """One row of (seq, mb): number, range, growth from first to last, and growth by step of seq."""
    s = snapshots.agg(F.count("*").alias("n_snapshots"), F.min("mb").alias("least_mb"), F.max("mb").alias("most_mb"), (F.max_by("mb", "seq") - F.min_by("mb", "seq")).alias("growth_mb"), (F.max("seq") - F.min("seq")).alias("steps"))
    return s.withColumn("growth_per_step", F.when(F.col("steps") > 0, F.col("growth_mb") / F.col("steps")).otherwise(0.0)).drop("steps")


def memory_consumers(calls: DataFrame, threshold_mb: float) -> DataFrame:
    """function, mb of (function, mb): the mean growth of functions over the threshold, largest first."""
    return calls.groupBy("function").agg(F.avg("mb").alias("mb")).filter(F.col("mb") > threshold_mb).orderBy(F.col("mb").desc(), "function")


def top_functions(calls: DataFrame, k: int = 10) -> DataFrame:
    """function, seconds, n_calls: the k functions of most time, ties by name."""
    t = calls.groupBy("function").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n_calls"))
    return t.orderBy(F.col("seconds").desc(), "function").limit(k)


def call_tree(calls: DataFrame, levels: int = 32) -> DataFrame:
    """path, depth, seconds, n_calls of (function, caller, seconds): calls from roots (caller null) down, by path.

    One join a level; a path ends where it would meet a function again.
    """
    edges = calls.groupBy("caller", "function").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n_calls"))
    level = edges.filter("caller is null").select(F.array("function").alias("path"), "seconds", "n_calls")
    out = level
    for _ in range(levels):
        level = materialise(level.select("path").join(edges.filter("caller is not null"), F.element_at("path", -1) == F.col("caller")).filter(~F.array_contains("path", F.col("function"))).select(F.array_append("path", F.col("function")).alias("path"), "seconds", "n_calls"), "calls")
        if level.isEmpty():
            break
        out = out.union(level)
    return out.select("path", F.size("path").alias("depth"), "seconds", "n_calls")


def measure(spark: SparkSession, plans: dict[str, Callable[[], DataFrame]], repeats: int = 1) -> DataFrame:
    """implementation, repeat, seconds, n_rows: each plan run into the no-op sink."""
    rows = []
    for name, plan in plans.items():
        for k in range(repeats):
            began = perf_counter()
            df = plan()
            n = df.count()
            rows.append((name, k, perf_counter() - began, n))
    return spark.createDataFrame(rows, "implementation string, repeat int, seconds double, n_rows long")
