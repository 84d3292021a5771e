"""Delay quantiles: feature table, bounded samples per train, quantile forest, calibration.

The forest is Spark ML's regression forest; each leaf keeps the quantiles of its training delays
(a quantile regression forest), and a row gets the mean of its leaves' quantiles. Each level is then
shifted by the quantile of its own errors on rows kept aside (conformal quantile regression), so that
the stated share of delays is covered.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..functions.score import curve_mean, monotone, tier_code
from ..functions.text import lookup
from ..session import cut_lineage

FEATURES = ["baseline", "tier_code", "dist_km", "frac_route", "sched_hour", "day_offset", "dow", "month"]
LEVELS = fixed.QUANTILE_LEVELS


def build_features(obs: DataFrame, stops: DataFrame, baselines: DataFrame, tiers: DataFrame) -> DataFrame:
    """Delay observations with the timetable position, the train's average and its tier.

    ``obs`` is cleaned; ``stops`` carries train_no, station_no, cum_km, arr_min and day;
    ``baselines`` train_no and avg_delay; ``tiers`` train_no and tier.
    """
    baselines = cut_lineage(baselines.select("train_no", F.col("avg_delay").alias("baseline")))
    # only trains with an average count; their stops are read for the positions and for the whole length
    position = cut_lineage(
        stops.join(baselines, "train_no", "left_semi").groupBy("train_no", "station_no").agg(
            F.max_by(F.struct("cum_km", "arr_min", "day"), F.struct("day", "cum_km", "arr_min")).alias("s"), F.max("cum_km").alias("far_km")))
    total = position.groupBy("train_no").agg(F.max("far_km").alias("total_km"))
    position = position.select("train_no", "station_no", "s.*").join(total, "train_no")
    day = F.try_to_date(F.col("obs_date").cast("string"))
    rows = (
        obs.filter(F.col("delay_min").isNotNull())
        .join(baselines, "train_no")
        .join(position, ["train_no", "station_no"])
        .join(tiers.select("train_no", "tier"), "train_no", "left")
        .withColumn("__day", day).filter(F.col("__day").isNotNull())
    )
    return rows.select(
        "train_no", "obs_date", "station_no",
        F.col("baseline").cast("double").alias("baseline"),
        tier_code(F.col("tier")).cast("double").alias("tier_code"),
        F.col("cum_km").alias("dist_km"),
        F.when(F.col("total_km") > 0, F.col("cum_km") / F.col("total_km")).otherwise(0.0).alias("frac_route"),
        F.coalesce(F.floor(F.col("arr_min") / 60), F.lit(-1)).cast("double").alias("sched_hour"),
        (F.col("day") - 1).cast("double").alias("day_offset"),
        F.weekday("__day").cast("double").alias("dow"),
        F.month("__day").cast("double").alias("month"),
        F.col("delay_min").cast("double").alias("delay"),
    )


def sample_per_key(df: DataFrame, key: str, identity: list[str], cap: int = 400, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per key: those with the smallest seeded hash, the same on every run.

    This is a sampling operator; Spark cuts each key map-side, so a huge key is not shuffled whole.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in identity], F.lit(str(seed)))
    over = W.partitionBy(key).orderBy("__h", *identity)
    return (
        df.withColumn("__h", F.md5(text)).withColumn("__rn", F.row_number().over(over))
        .filter(F.col("__rn") <= cap).drop("__h", "__rn")
    )


def is_held_out(identity: list[str], share: float = 0.15, seed: int = 42) -> Column:
    """True for a fixed share of rows, by hash of their identity and not by their partition."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in identity], F.lit(f"split{seed}"))
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint") < int(share * 2**32)


def _filled(df: DataFrame) -> DataFrame:
    """Missing position as -1 with a flag, as the assembler takes no NULL."""
    flag = F.when(F.col("dist_km").isNull() | F.col("frac_route").isNull(), 1.0).otherwise(0.0)
    out = df.withColumn("no_position", flag)
    for c in FEATURES:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(-1.0)))
    return out


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*FEATURES, "no_position"], outputCol="features").transform(_filled(df))


@dataclass
class QuantileForest:
    """A forest and, per tree and leaf, the delay quantiles of its training rows."""

    forest: RandomForestRegressionModel
    leaves: list[list[list[float]]]
    n_rows: int
    trained_at: str
    shifts: list[float] = field(default_factory=lambda: [0.0] * len(LEVELS))

    def metadata(self, spark, mae_model: float | None = None, mae_baseline: float | None = None) -> DataFrame:
        return spark.createDataFrame(
            [(self.trained_at, self.n_rows, mae_model, mae_baseline, self.shifts)],
            "trained_at string, n_rows bigint, mae_model double, mae_baseline double, shifts array<double>",
        )

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.forest.write().overwrite().save(f"{path}/forest")
        rows = [(t, i, q) for t, tree in enumerate(self.leaves) for i, q in enumerate(tree)]
        spark.createDataFrame(rows, "tree int, leaf int, curve array<double>").write.mode("overwrite").parquet(f"{path}/leaves")
        self.metadata(spark).write.mode("overwrite").json(f"{path}/metadata")


def load_forest(spark, path: str) -> QuantileForest:
    forest = RandomForestRegressionModel.load(f"{path}/forest")
    rows = spark.read.parquet(f"{path}/leaves").orderBy("tree", "leaf").collect()  # bounded by trees x leaves
    leaves: list[list[list[float]]] = []
    for r in rows:
        while len(leaves) <= r["tree"]:
            leaves.append([])
        leaves[r["tree"]].append(list(r["curve"]))
    meta = spark.read.json(f"{path}/metadata").first()
    return QuantileForest(forest, leaves, meta["n_rows"], meta["trained_at"], list(meta["shifts"]))


def leaf_quantiles(scored: DataFrame) -> DataFrame:
    """(tree, leaf, curve): exact discrete quantiles from counts per (tree, leaf, delay).

    Delays are whole minutes in a fixed range, so a leaf has at most 1561 counts, however many rows.
    """
    each = scored.select(F.col("delay"), F.posexplode(vector_to_array("leaf")).alias("tree", "leaf_id"))
    hist = each.groupBy("tree", F.col("leaf_id").cast("int").alias("leaf"), "delay").agg(F.count(F.lit(1)).alias("n"))
    over = W.partitionBy("tree", "leaf")
    ranked = hist.withColumn("total", F.sum("n").over(over)).withColumn(
        "upto", F.sum("n").over(over.orderBy("delay").rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    at = [F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("delay"))) for q in LEVELS]
    return ranked.groupBy("tree", "leaf").agg(F.array(*at).alias("curve"))


def fit_quantile_forest(
    train: DataFrame, trained_at: str, trees: int = 20, depth: int = 6, min_leaf: int = 200, seed: int = 42
) -> QuantileForest:
    """Fit the forest and its leaf quantiles. The leaf table holds at most trees x 2^depth rows."""
    data = _assembled(train)
    learner = RandomForestRegressor(
        featuresCol="features", labelCol="delay", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, seed=seed, leafCol="leaf", maxBins=64,
    )
    forest = learner.fit(data)
    rows = leaf_quantiles(forest.transform(data)).collect()  # bounded by trees x leaves
    leaves: list[list[list[float]]] = [[] for _ in range(trees)]
    for r in sorted(rows, key=lambda r: (r["tree"], r["leaf"])):
        tree = leaves[r["tree"]]
        # a leaf that no training row reaches repeats the one before
        while len(tree) < r["leaf"]:
            tree.append(tree[-1] if tree else list(r["curve"]))
        tree.append(list(r["curve"]))
    n_rows = int(train.count())
    return QuantileForest(forest, leaves, n_rows, trained_at)


def calibrated(model: QuantileForest, rows: DataFrame, accuracy: int = 10_000) -> QuantileForest:
    """The forest with every level moved by that quantile of its errors on the given rows.

    The errors are summed up in a sketch of bounded size per level; six numbers reach the driver.
    """
    scored = predict_quantiles(model, rows, gate=False)
    errors = [
        F.percentile_approx(F.col("delay") - F.element_at("raw_curve", i + 1), q, accuracy).alias(f"e{i}")
        for i, q in enumerate(LEVELS)
    ]
    found = scored.agg(*errors).first()
    shifts = [s + (found[f"e{i}"] or 0.0) for i, s in enumerate(model.shifts)]
    return replace(model, shifts=shifts)


def predict_quantiles(model: QuantileForest, rows: DataFrame, gate: bool = True) -> DataFrame:
    """Add ``curve``, ``avg_delay``, ``p50`` and ``p90``; NULL where a row may not be predicted.

    A row needs a baseline, a weekday and a month, and a journey day up to the next day.
    """
    scored = model.forest.transform(_assembled(rows)).withColumn("__leaf", vector_to_array("leaf"))
    spark = rows.sparkSession
    table = spark.createDataFrame([(1, model.leaves)], "__one int, __table array<array<array<double>>>")
    joined = scored.withColumn("__one", F.lit(1)).join(F.broadcast(table), "__one")  # one row of bounded size
    curves = F.transform(
        "__leaf", lambda leaf, tree: F.get(F.get(F.col("__table"), tree), leaf.cast("int"))
    )
    n = len(model.leaves)
    shifts = F.array(*[F.lit(float(x)) for x in model.shifts])
    curve = F.transform(
        F.sequence(F.lit(0), F.lit(len(LEVELS) - 1)),
        lambda i: F.aggregate(curves, F.lit(0.0), lambda acc, c: acc + F.get(c, i)) / n + F.get(shifts, i),
    )
    allowed = F.lit(True)
    if gate:
        known = (F.col("baseline") >= 0) | (F.col("baseline") < -1)
        allowed = known & (F.col("dow") >= 0) & (F.col("month") >= 1) & (F.col("day_offset") <= fixed.MODEL_MAX_DAY_OFFSET)
    out = joined.withColumn("raw_curve", F.when(allowed, curve)).withColumn("curve", monotone(F.col("raw_curve")))
    out = out.drop("__leaf", "__one", "__table", "features", "leaf", "prediction", "no_position")
    mid, tail = LEVELS.index(0.5) + 1, LEVELS.index(0.9) + 1
    return (
        out.withColumn("avg_delay", curve_mean(F.col("curve")))
        .withColumn("p50", F.element_at("curve", mid)).withColumn("p90", F.element_at("curve", tail))
    )


def error_report(scored: DataFrame) -> DataFrame:
    """MAE of the predicted mean and of the flat baseline, and the relative gain."""
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs(F.col("avg_delay") - F.col("delay"))), 6).alias("mae_model"),
        F.round(F.avg(F.abs(F.col("baseline") - F.col("delay"))), 6).alias("mae_baseline"),
    ).withColumn("gain_pct", F.round(100 * (F.col("mae_baseline") - F.col("mae_model")) / F.col("mae_baseline"), 4))


def coverage_report(scored: DataFrame, curve: str = "curve") -> DataFrame:
    """Share of delays up to each predicted quantile: one pass, then one row per level."""
    shares = [
        F.avg(F.when(F.col("delay") <= F.element_at(curve, i + 1), 1.0).otherwise(0.0)).alias(f"q{i}")
        for i in range(len(LEVELS))
    ]
    pairs = F.array(*[F.struct(F.lit(q).alias("level"), F.round(F.col(f"q{i}"), 6).alias("covered")) for i, q in enumerate(LEVELS)])
    return scored.agg(*shares).select(F.explode(pairs).alias("p")).select("p.*")


def stratified_report(scored: DataFrame, min_rows: int = 200) -> DataFrame:
    """p50 error and p90 coverage by tier and by journey day (0, 1, 2+), both from one pass."""
    names = {code: name for name, code in fixed.TIER_CODE.items()}
    tier = lookup(names, F.col("tier_code").cast("int"))
    bucket = F.when(F.col("day_offset") <= 0, "0").when(F.col("day_offset") == 1, "1").otherwise("2+")
    rows = scored.select(tier.alias("tier"), bucket.alias("day_bucket"), "delay", "p50", "p90")
    out = rows.groupingSets([["tier"], ["day_bucket"]], "tier", "day_bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs(F.col("p50") - F.col("delay"))), 6).alias("p50_mae"),
        F.round(F.avg(F.when(F.col("delay") <= F.col("p90"), 1.0).otherwise(0.0)), 6).alias("p90_coverage"),
    )
    return out.filter(F.col("n") >= min_rows)


def model_age(metadata: DataFrame, as_of: Column) -> DataFrame:
    """Age in days and whether the model is past its retraining date."""
    age = F.datediff(as_of, F.to_date(F.left("trained_at", F.lit(10))))
    return metadata.withColumn("age_days", age).withColumn("stale", age > fixed.MODEL_STALE_DAYS)
