"""Time profiles of activity: totals, slot shares, spines, calendar roll-ups, behaviour clusters."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.functions import calendar as cal
from activity_engine.session import durable

SLOTS = ("morning", "afternoon", "evening", "night")
FEATURES = (*SLOTS, "weekend_pct")


def platform_profile(events: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Per key: total, mean hour and weekday, weekend share and the share of each day slot. One aggregate."""
    hour, weekday = F.hour(ts), F.dayofweek(ts)
    slot = cal.day_slot(hour, cal.PROFILE_CUTS)
    total = F.count("*")
    return events.groupBy(*keys).agg(
        total.alias("total"),
        F.avg(hour).alias("avg_hour"),
        F.avg(weekday).alias("avg_weekday"),
        (F.count_if(cal.is_weekend(weekday)) / total).alias("weekend_pct"),
        *[(F.count_if(slot == s) / total).alias(s) for s in SLOTS],
    )


def standardised(profiles: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """``features``: the columns assembled, centred and scaled by their sample deviation."""
    assembled = VectorAssembler(inputCols=list(columns), outputCol="raw_features").transform(profiles)
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    return scaler.fit(assembled).transform(assembled)


def zscores(profiles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column minus its mean over its sample deviation, 0 where it never varies; plain columns."""
    moments = profiles.agg(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns])
    ).scalar()
    return profiles.withColumn("_m", moments).withColumns({
        f"z_{c}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_m.m_{c}"), F.col(f"_m.s_{c}")), F.lit(0.0))
        for c in columns
    }).drop("_m")


def behaviour_clusters(profiles: DataFrame, k: int = 4, seed: int = 42, iterations: int = 100) -> DataFrame:
    """Profiles with their k-means cluster."""
    return clustered(standardised(profiles), k, seed, iterations)


def clustered(scaled: DataFrame, k: int, seed: int = 42, iterations: int = 100) -> DataFrame:
    """Standardised profiles with their k-means cluster."""
    model = KMeans(featuresCol="features", predictionCol="cluster", k=k, seed=seed, maxIter=iterations).fit(scaled)
    return model.transform(scaled)


def silhouette(clustered: DataFrame) -> float:
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(clustered)


def silhouettes(profiles: DataFrame, ks: Sequence[int], at_once: int = 7) -> list[tuple[int, float]]:
    """The silhouette for each number of clusters. Profiles are standardised once; the fits, whose many short rounds leave most
    cores idle, run side by side."""
    scaled = durable(standardised(profiles).select("features"))
    scaled.persist()
    try:
        with ThreadPoolExecutor(at_once) as pool:
            return list(zip(ks, pool.map(inheritable_thread_target(profiles.sparkSession)(lambda k: silhouette(clustered(scaled, k))), ks)))
    finally:
        scaled.unpersist()


def describe_clusters(profiles: DataFrame, cluster: str, platform: str) -> DataFrame:
    """Per cluster: its platforms, mean hour and weekday, weekend share, items, and the period and day-type words."""
    def mean(column: str, digits: int) -> Column:
        # Rounded finely first: equal means round alike in whatever order they were summed.
        return F.round(F.round(F.avg(column), 9), digits).alias(column)

    summary = profiles.groupBy(cluster).agg(
        F.array_sort(F.collect_set(platform)).alias("platforms"),
        mean("avg_hour", 1), mean("avg_weekday", 1), mean("weekend_pct", 3),
        F.sum("total").alias("item_count"),
    )
    return summary.withColumns({
        "time_period": cal.day_slot(F.rint("avg_hour"), cal.PERIOD_CUTS),
        "day_type": F.when(F.col("weekend_pct") > 0.35, "Weekend").otherwise("Semaine"),
    })


def spine(spark: SparkSession, name: str, first: int, last: int) -> DataFrame:
    """Every value of a calendar part (24 hours, 7 weekdays, 12 months)."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def on_spine(counts: DataFrame, spine_df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    return spine_df.join(counts, key, "left").na.fill(0, subset=list(values))


def period_filter(
    df: DataFrame, ts: str, years: Sequence[int] = (), months: Sequence[str] = (), weeks: Sequence[int] = ()
) -> DataFrame:
    """Year, then month, then week selection; an empty selection keeps everything."""
    for values, part in ((years, F.year(ts)), (months, F.date_format(ts, "yyyy-MM")), (weeks, F.weekofyear(ts))):
        if values:
            df = df.filter(part.isin(*values))
    return df


def period_options(df: DataFrame, ts: str) -> DataFrame:
    """Values that can be chosen at each level: (level, value)."""
    levels = {"year": F.year(ts).cast("string"), "month": F.date_format(ts, "yyyy-MM"),
              "week": F.lpad(F.weekofyear(ts).cast("string"), 2, "0")}
    pairs = F.array(*[F.struct(F.lit(n).alias("level"), v.alias("value")) for n, v in levels.items()])
    return df.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def cyclic(hour: Column, weekday: Column) -> dict[str, Column]:
    """Hour and weekday as points on a circle."""
    def turn(value: Column, period: int) -> Column:
        return value * F.lit(2 * 3.141592653589793 / period)

    return {
        "hour_sin": F.sin(turn(hour, 24)), "hour_cos": F.cos(turn(hour, 24)),
        "weekday_sin": F.sin(turn(weekday, 7)), "weekday_cos": F.cos(turn(weekday, 7)),
    }


def calendar_rollup(events: DataFrame, ts: str, source: str) -> DataFrame:
    """Counts per day, hour and source: the one grouped table all calendar views are read from."""
    return events.groupBy(F.to_date(ts).alias("day"), F.hour(ts).alias("hour"), source).agg(F.count("*").alias("n"))
