"""Leakage-aware regression on temporal splits with Spark ML."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ratingloom.operators.forests import Forest, ForestModel
from ratingloom.operators.joins import reproduction_diff, settled, with_one_row
from ratingloom.operators.metrics import METRICS, metric_row, metrics_ledger, regression_metrics, select_best
from ratingloom.operators.ordering import head_by, row_position, summary_position
from ratingloom.operators.quantiles import grouped_quantiles
from ratingloom.session import shared_folder, stored
from ratingloom.sources import schema as S

# --- fixed values: features, model parameters, grid --------------------------------------------------

TARGET = "co2_emissions_g_km"
NUMERIC_FEATURES = ["model_year", "engine_size_l", "cylinders", "gear_count"]
CATEGORICAL_FEATURES = ["make", "vehicle_class", "transmission_family", "fuel_type"]
MEASURED_FEATURES = [
    "fuel_cons_city_l_100km",
    "fuel_cons_hwy_l_100km",
    "fuel_cons_comb_l_100km",
    "fuel_economy_comb_mpg",
]
RIDGE_ALPHA = 10.0
BOOSTING = {"rounds": 250, "step": 0.05, "depth": 5, "leaf_rows": 20}
FOREST_TREES = 300
FOREST_GRID = [
    {"max_depth": 14, "min_samples_leaf": 1, "max_features": 0.7},
    {"max_depth": 18, "min_samples_leaf": 1, "max_features": 0.7},
    {"max_depth": None, "min_samples_leaf": 1, "max_features": 0.7},
    {"max_depth": None, "min_samples_leaf": 1, "max_features": 1.0},
]
DIAGNOSTIC_FOREST = {"max_depth": 18, "min_samples_leaf": 1, "max_features": 0.9}
SEED = 42
REPEATS = 8
REPRODUCTION_TOLERANCE = 0.00051
# rounds of the keyed permutation, and steps after which a place must be inside
ROUNDS, WALK = 6, 128
# a walk looks at its place after so many steps; all but one place in 2^FIRST_STEPS have come back by then
FIRST_STEPS = 8

# trees stop at this depth; it stands for "no limit"
DEEPEST = 30
RAW_PREDICTION = "prediction"
HELD = "__held"
# scaled numbers and one column per level; the trees read the same rows as plain numbers and level indices
LINEAR, TREE = "features", "tree_features"
# histograms of one pass over the rows may take so much memory of a task; deeper levels take several passes
LEVEL_MB = 1024
# rows of one part of the vector store; a row takes some 200 bytes, so a task moves some 50 MB whatever the table's size
PART_ROWS = 250_000
# rows with their partners in one task; a row takes some 40 bytes
SWAPPED_ROWS = 1_000_000
# numbers are cut into so many bins; a category with more levels gets one for each
BINS = 32


def assert_no_leakage(features: list[str], excluded: list[str] = S.LEAKY_COLUMNS) -> list[str]:
    """The features, or an error naming those that leak the target."""
    leaking = sorted(set(features) & set(excluded))
    if leaking:
        raise ValueError(f"features leak the target: {leaking}")
    return features


@dataclass
class Splits:
    """Row sets of a temporal evaluation; development is train and validation together."""

    df: DataFrame
    period: str = "model_year"
    train_until: int = S.TRAIN_UNTIL
    validate_until: int = S.VALIDATE_UNTIL

    @property
    def train(self) -> DataFrame:
        return self.df.where(F.col(self.period) <= self.train_until)

    @property
    def validation(self) -> DataFrame:
        return self.df.where(F.col(self.period).between(self.train_until + 1, self.validate_until))

    @property
    def development(self) -> DataFrame:
        return self.df.where(F.col(self.period) <= self.validate_until)

    @property
    def test(self) -> DataFrame:
        return self.df.where(F.col(self.period) > self.validate_until)


# --- preprocessing -----------------------------------------------------------------------------------


def most_frequent(df: DataFrame, names: list[str]) -> dict[str, str]:
    """Most frequent known value per column; a tie goes to the smaller value."""
    pairs = df.select(*[F.col(n).cast("string").alias(n) for n in names]).unpivot([], names, "name", "value")
    counted = pairs.where(F.col("value").isNotNull()).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("n")).alias("n"), F.col("value"))
    modes = counted.groupBy("name").agg(F.min(order).alias("best"))
    return {row["name"]: row["best"]["value"] for row in modes.collect()}


def numeric_statistics(df: DataFrame, names: list[str]) -> dict[str, dict[str, float]]:
    """Exact median, and mean and population deviation after filling with it, per column."""
    numbers = df.select(*[F.col(n).cast("double").alias(n) for n in names])
    long = numbers.unpivot([], names, "name", "value")
    medians = {r["name"]: r["median"] for r in grouped_quantiles(long, "value", {"median": 0.5}, ["name"]).collect()}
    filled = {n: F.coalesce(F.col(n), F.lit(medians[n])) for n in names}
    moments = numbers.agg(
        *[F.avg(c).alias(f"mean_{n}") for n, c in filled.items()],
        *[F.stddev_pop(c).alias(f"spread_{n}") for n, c in filled.items()],
    ).first()
    return {
        n: {"median": medians[n], "mean": moments[f"mean_{n}"], "spread": moments[f"spread_{n}"] or 1.0}
        for n in names
    }


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def build_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]) -> list:
    """Stages that fill, scale and encode: fill values and scales come from ``train`` alone.

    Numbers: exact median, then population standardisation. Categories: most frequent value, then one
    column per level seen in training; a level first seen later encodes as all zeros.
    """
    stats, modes = numeric_statistics(train, numeric), most_frequent(train, categorical)
    scaled = [
        f"(coalesce(cast(`{n}` as double), {s['median']!r}D) - {s['mean']!r}D) / {s['spread']!r}D AS `{n}__scaled`"
        for n, s in stats.items()
    ]
    filled = [f"coalesce(cast(`{n}` as string), {_literal(modes[n])}) AS `{n}__filled`" for n in categorical]
    statement = f"SELECT *, {', '.join(scaled + filled)} FROM __THIS__"
    return [
        SQLTransformer(statement=statement),
        StringIndexer(
            inputCols=[f"{n}__filled" for n in categorical],
            outputCols=[f"{n}__index" for n in categorical],
            handleInvalid="keep",
        ),
        OneHotEncoder(
            inputCols=[f"{n}__index" for n in categorical],
            outputCols=[f"{n}__levels" for n in categorical],
            dropLast=True,
        ),
        VectorAssembler(
            inputCols=[f"{n}__scaled" for n in numeric] + [f"{n}__levels" for n in categorical],
            outputCol=LINEAR,
        ),
        VectorAssembler(
            inputCols=[f"{n}__scaled" for n in numeric] + [f"{n}__index" for n in categorical], outputCol=TREE
        ),
    ]


def preprocess(train: DataFrame, df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Feature vectors of ``df`` from a preprocessor fitted on ``train``."""
    return Pipeline(stages=build_preprocessor(train, numeric, categorical)).fit(train).transform(df)


# --- estimators --------------------------------------------------------------------------------------


def ridge(train: DataFrame, alpha: float = RIDGE_ALPHA, target: str = TARGET) -> LinearRegression:
    """Ridge with penalty ``alpha`` on the summed squared errors of ``train``.

    The solver is the normal equations: one pass sums the products of all pairs of columns in each partition, the sums
    are merged in a tree and solved once, so the fit is exact and the driver holds columns x columns numbers at any size.
    Spark averages its loss over the rows and divides it by the spread of the target, so the penalty is
    scaled by both.
    """
    known = train.agg(
        F.count(target).alias("rows"), F.stddev_pop(F.col(target).cast("double")).alias("spread")
    ).first()
    penalty = alpha * (known["spread"] or 0.0) / max(known["rows"], 1)
    return LinearRegression(
        featuresCol=LINEAR, labelCol=target, regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal"
    )


def boosted_trees(
    rounds: int = BOOSTING["rounds"],
    step: float = BOOSTING["step"],
    depth: int = BOOSTING["depth"],
    leaf_rows: int = BOOSTING["leaf_rows"],
    target: str = TARGET,
    seed: int = SEED,
    held: str | None = HELD,
    tolerance: float = 1e-4,
) -> GBTRegressor:
    """Gradient boosting; trees grow level by level, a leaf penalty is not available.

    ``held`` names a column that is true for rows kept back from the trees; rounds end once they stop improving on them.
    """
    return GBTRegressor(
        featuresCol=TREE, labelCol=target, maxIter=rounds, stepSize=step, maxDepth=depth, minInstancesPerNode=leaf_rows,
        seed=seed, validationIndicatorCol=held, validationTol=tolerance, maxMemoryInMB=LEVEL_MB, maxBins=BINS,
    )


def forest(
    max_depth: int | None = None,
    min_samples_leaf: int = 1,
    max_features: float = 1.0,
    trees: int = FOREST_TREES,
    target: str = TARGET,
    seed: int = SEED,
) -> Forest:
    """A forest whose upper nodes are split from histograms and whose small subtrees grow in one task each."""
    return Forest(
        TREE, target, trees, min(max_depth or DEEPEST, DEEPEST), min_samples_leaf, min(max_features, 1.0), BINS, seed
    )


@dataclass
class Vectors:
    """A preprocessor and the labelled rows it was fitted on, as vectors stored once in even parts for every fit."""

    preprocessor: PipelineModel
    rows: DataFrame
    levels: int

    def fit(self, estimator) -> PipelineModel:
        """The preprocessor with the estimator fitted on the stored vectors, as one persistable model."""
        if estimator.hasParam("maxBins"):
            estimator = estimator.copy({estimator.getParam("maxBins"): max(BINS, self.levels)})
        return PipelineModel(stages=[*self.preprocessor.stages, estimator.fit(self.rows)])


def vectors(train: DataFrame, numeric: list[str], categorical: list[str], target: str = TARGET) -> Vectors:
    """Preprocess the training rows once. Parts are even and at least as many as there are cores, so no fit runs in a few
    tasks because a shuffle before it left few partitions; their number grows with the rows, so their size does not."""
    spark = train.sparkSession
    shared_folder(spark)
    labelled = train.withColumn(target, F.col(target).cast("double"))
    # a tenth, drawn by a digest of the features, is what boosting checks its rounds against
    drawn = F.pmod(F.xxhash64(F.lit(SEED), *numeric, *categorical), F.lit(10)) == 0
    # the statistics take several passes over a narrow table
    narrow = stored(labelled.select(target, *numeric, *categorical, drawn.alias(HELD)), "training-rows")
    preprocessor = Pipeline(stages=build_preprocessor(narrow, numeric, categorical)).fit(narrow)
    made = preprocessor.transform(narrow).select(target, HELD, LINEAR, TREE)
    sizes = narrow.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    read, size = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    parts = max(read, spark.sparkContext.defaultParallelism, -(-size // PART_ROWS))
    # one level more than was seen stands for unknown ones
    seen = [len(labels) for stage in preprocessor.stages if hasattr(stage, "labelsArray") for labels in stage.labelsArray]
    return Vectors(preprocessor, stored(made.repartition(parts), "vectors"), max(seen, default=0) + 1)


def fit(train: DataFrame, estimator, numeric: list[str], categorical: list[str], target: str = TARGET) -> PipelineModel:
    """Preprocessor and estimator fitted on the same rows, as one persistable model."""
    return vectors(train, numeric, categorical, target).fit(estimator)


def predict(model: PipelineModel, df: DataFrame, name: str = RAW_PREDICTION) -> DataFrame:
    """The frame with one more column; helper columns of the model are dropped."""
    scored = model.transform(df)
    return scored.select(*df.columns, F.col(RAW_PREDICTION).alias(name))


def median_baseline(train: DataFrame, df: DataFrame, target: str = TARGET, name: str = RAW_PREDICTION) -> DataFrame:
    """Every row predicted by the exact training median."""
    median = grouped_quantiles(train, target, {"median": 0.5}).scalar()
    return df.withColumn(name, median)


# --- tuning, selection, evaluation -------------------------------------------------------------------


def tune_forest(
    train: DataFrame,
    validation: DataFrame,
    numeric: list[str],
    categorical: list[str],
    grid: list[dict] | None = None,
    trees: int = FOREST_TREES,
    target: str = TARGET,
) -> DataFrame:
    """Validation metrics of every grid point, best first; the best one is marked.

    Rows are preprocessed and stored once; each grid point then trains on the same vectors.
    """
    return tuned_on(vectors(train, numeric, categorical, target), validation, grid, trees, target)


def tuned_on(
    known: Vectors, validation: DataFrame, grid: list[dict] | None = None, trees: int = FOREST_TREES, target: str = TARGET
) -> DataFrame:
    """``tune_forest`` on rows that are vectors already.

    Draws depend neither on the depth nor on one another, so grid points that differ in depth alone are one forest, grown once
    to the largest depth and cut at the others. The time of its growth counts for each of them.
    """
    checked = stored(known.preprocessor.transform(validation).select(target, TREE), "checked-vectors")
    rows, grown = [], {}
    points = grid or FOREST_GRID
    for number, point in enumerate(points, start=1):
        started = time.time()
        others = {name: value for name, value in point.items() if name != "max_depth"}
        same = tuple(sorted(others.items()))
        if same not in grown:
            depths = [p["max_depth"] or DEEPEST for p in points if p.items() >= others.items()]
            deepest = forest(max(depths), trees=trees, target=target, **others)
            grown[same] = known.fit(deepest).stages[-1], time.time() - started
            started = time.time()
        whole, took = grown[same]
        model = whole.cut_at(min(point["max_depth"] or DEEPEST, DEEPEST))
        found = regression_metrics(model.transform(checked), target, RAW_PREDICTION).first()
        rows.append(
            (
                number,
                "Random Forest",
                point["max_depth"],
                point["min_samples_leaf"],
                float(point["max_features"]),
                trees,
                *[float(found[m]) for m in METRICS],
                round(took + time.time() - started, 3),
            )
        )
    schema = StructType(
        [
            StructField("tuning_id", IntegerType()),
            StructField("model_name", StringType()),
            StructField("max_depth", IntegerType()),
            StructField("min_samples_leaf", IntegerType()),
            StructField("max_features", DoubleType()),
            StructField("n_estimators", IntegerType()),
            *[StructField(m, DoubleType()) for m in METRICS],
            StructField("elapsed_seconds", DoubleType()),
        ]
    )
    results = validation.sparkSession.createDataFrame(rows, schema)
    return mark_selected(results).orderBy("mae", "rmse", "tuning_id")


def mark_selected(results: DataFrame, key: str = "tuning_id") -> DataFrame:
    """Flag the row that ``select_best`` would take."""
    best = select_best(results, key).select(F.col(key).alias("best")).scalar()
    return results.withColumn("selected_configuration", (F.col(key) == best).cast("int"))


LEDGER_KEYS = ["model_name", "model_scope", "split", "eligible_for_selection", "fit_period"]


@dataclass
class Evaluation:
    """What a temporal evaluation leaves behind."""

    metrics: DataFrame
    tuning: DataFrame
    model: PipelineModel | None
    selected_name: str
    parameters: dict = field(default_factory=dict)


def evaluate(
    splits: Splits,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    measured: list[str] | None = None,
    grid: list[dict] | None = None,
    trees: int = FOREST_TREES,
    boosting: dict | None = None,
    target: str = TARGET,
) -> Evaluation:
    """Fit the candidates on train, select on validation, refit on development, test once.

    The winner has the smallest validation MAE, then RMSE. A baseline and a measurement-rich diagnostic
    are tested beside it and never eligible.
    """
    numeric = assert_no_leakage(numeric or NUMERIC_FEATURES)
    categorical = assert_no_leakage(categorical or CATEGORICAL_FEATURES)
    rich = numeric + (MEASURED_FEATURES if measured is None else measured)
    scope = "early_specification"
    grid = grid or FOREST_GRID
    boosting = boosting or BOOSTING
    train, development = splits.train, splits.development
    fitted_on = f"until {splits.train_until}"
    refitted_on = f"until {splits.validate_until} refit"
    known = vectors(train, numeric, categorical, target)
    tuning = tuned_on(known, splits.validation, grid, trees, target)
    tuned = tuning.where("selected_configuration = 1").first()
    best = grid[tuned["tuning_id"] - 1]

    candidates = {
        "Ridge Regression": lambda rows: ridge(rows, target=target),
        "Gradient Boosted Trees": lambda rows: boosted_trees(**boosting, target=target),
        "Random Forest (Tuned)": lambda rows: forest(trees=trees, target=target, **best),
    }
    rows = [
        metric_row(
            median_baseline(train, splits.validation, target),
            "Median Baseline", scope, "validation", True, fitted_on, target, RAW_PREDICTION,
        )
    ]
    for name, build in candidates.items():
        if name.startswith("Random Forest"):
            # the grid point that won was fitted and checked already
            row = tuning.where("selected_configuration = 1").select(
                *[F.lit(v).alias(n) for n, v in zip(LEDGER_KEYS, (name, scope, "validation", 1, fitted_on), strict=True)],
                *METRICS,
            )
        else:
            scored = predict(known.fit(build(known.rows)), splits.validation)
            row = metric_row(scored, name, scope, "validation", True, fitted_on, target, RAW_PREDICTION)
        rows.append(row)
    validation = settled(metrics_ledger(rows))
    selected = select_best(validation).first()["model_name"]

    model = None
    if selected in candidates:
        refit = vectors(development, numeric, categorical, target)
        model = refit.fit(candidates[selected](refit.rows))
        tested = predict(model, splits.test)
    else:
        tested = median_baseline(development, splits.test, target)
    baseline = median_baseline(development, splits.test, target)
    diagnostic = leaky_diagnostic(splits, rich, categorical, trees, target)
    test_rows = [
        metric_row(tested, selected, scope, "test", True, refitted_on, target, RAW_PREDICTION),
        metric_row(baseline, "Median Baseline", scope, "test", False, refitted_on, target, RAW_PREDICTION),
        diagnostic,
    ]
    test = metrics_ledger(test_rows).withColumn("metric_id", F.col("metric_id") + len(rows))
    return Evaluation(validation.unionByName(test), tuning, model, selected, best)


def leaky_diagnostic(
    splits: Splits, numeric: list[str], categorical: list[str], trees: int = FOREST_TREES, target: str = TARGET,
    parameters: dict | None = None,
) -> DataFrame:
    """Test metrics of a forest that also sees measured consumption; never eligible for selection."""
    estimator = forest(trees=trees, target=target, **(parameters or DIAGNOSTIC_FOREST))
    scored = predict(fit(splits.development, estimator, numeric, categorical, target), splits.test)
    return metric_row(
        scored, "Measurement-Rich Forest (Diagnostic)", "measurement_rich_circular_diagnostic", "test", False,
        f"until {splits.validate_until} refit", target, RAW_PREDICTION,
    )


# --- importance and reproduction ---------------------------------------------------------------------


def _scrambled(spot: Column, bits: int, *seeds: Column) -> Column:
    """A keyed bijection of 0 .. 2^bits - 1: a Feistel network whose halves may differ by one bit. The number of rounds is
    even, so that the halves end as wide as they began."""
    left, right = bits // 2, bits - bits // 2
    even, odd = (F.lit((1 << width) - 1).cast("long") for width in (left, right))

    def turned(halves: Column, number: Column) -> Column:
        mixed = F.xxhash64(*seeds, number, halves["low"]).bitwiseAND(F.when(number % 2 == 0, even).otherwise(odd))
        return F.struct(halves["low"].alias("high"), halves["high"].bitwiseXOR(mixed).alias("low"))

    halves = F.struct(F.shiftright(spot, right).alias("high"), spot.bitwiseAND(odd).alias("low"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, halves, turned, lambda at: F.shiftleft(at["high"], right) + at["low"])


def permuted(spot: Column, rows: int, *seeds: Column) -> Column:
    """Another place for each of the places 0 .. rows - 1, all different; seeds choose the permutation.

    A place that falls outside walks on along its cycle until it is inside again; more than half of all places are inside,
    so that ``WALK`` steps are enough but for one place in 2^WALK, which is an error. An aggregate runs to the end of its
    sequence, so nearly all places take only the first ``FIRST_STEPS``.
    """
    bits = max(2, (rows - 1).bit_length())
    inside = F.lit(rows)

    def step(at: Column, _: Column) -> Column:
        return F.when((at["n"] > 0) & (at["spot"] < inside), at).otherwise(
            F.struct(_scrambled(at["spot"], bits, *seeds).alias("spot"), (at["n"] + 1).alias("n"))
        )

    def ended(at: Column) -> Column:
        return F.when((at["n"] > 0) & (at["spot"] < inside), at["spot"])

    def walked_on(at: Column) -> Column:
        lost = F.raise_error(F.lit("a permuted place did not come back")).cast("long")
        return F.coalesce(ended(at), F.aggregate(F.sequence(F.lit(FIRST_STEPS + 1), F.lit(WALK)), at, step, ended), lost)

    start = F.struct(spot.cast("long").alias("spot"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FIRST_STEPS)), start, step, walked_on)


def shuffled_partners(
    df: DataFrame, key: str, columns: list[str], repeats: int, seed: int = SEED
) -> DataFrame:
    """For every repeat, each row with the ``columns`` of another row of a random permutation.

    Rows are numbered by key once; the partner's number is a keyed bijection of a row's own, so a repeat needs no sort and
    all repeats meet their partners in one join on the number.
    """
    # read twice, by both sides of the join and by every feature
    numbered = stored(row_position(df, [key], name="__spot", start=0), "numbered-rows")
    size = numbered.count()
    if size == 0:
        return numbered.select(F.lit(0).alias("__repeat"), *df.columns, F.struct(*columns).alias("__partner"))
    every = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("__repeat")
    rows = numbered.select("*", every)
    drawn = rows.withColumn("__drawn", permuted(F.col("__spot"), size, F.lit(seed), F.col("__repeat"))).drop("__spot")
    partners = numbered.select(F.col("__spot").alias("__drawn"), F.struct(*columns).alias("__partner"))
    return drawn.join(partners, "__drawn").drop("__drawn")


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    features: list[str],
    key: str,
    model_name: str,
    repeats: int = REPEATS,
    seed: int = SEED,
    target: str = TARGET,
) -> DataFrame:
    """Mean and population deviation of the MAE increase when one feature is shuffled, best first.

    The preprocessor works on each feature alone, so rows that a forest scores are made levels once, before they are shuffled.
    """
    needed = df.select(key, target, *features)
    slots = level_slots(model, features)
    if slots is not None:
        levels = model.stages[-1].with_levels(PipelineModel(model.stages[:-1]).transform(needed), "__levels")
        # read by the intact rows and by the numbering
        coded = stored(levels.select(key, F.col(target).cast("double").alias(target), "__levels"), "coded-rows")
        paired = shuffled_partners(coded, key, ["__levels"], repeats, seed)
        own, swapped = F.col("__levels"), F.col("__partner.__levels").alias("__swapped")
        partners = stored(paired.select("__repeat", target, own, swapped), "partners")
        cores, rows = df.sparkSession.sparkContext.defaultParallelism, coded.count()
        parts = [max(cores, -(-n * rows // SWAPPED_ROWS)) for n in (repeats, 1)]
        losses = model.stages[-1].swapped_losses(partners, target, slots, parts[0])
        whole = coded.select(F.lit(0).alias("__repeat"), target, own, own.alias("__swapped"))
        found = model.stages[-1].swapped_losses(whole, target, {features[0]: slots[features[0]]}, parts[1])
        return _importances(losses, found.select(F.col("mae").alias("intact_mae")), model_name)
    actual = F.col(target).cast("double")
    error = F.abs(F.col(RAW_PREDICTION) - actual)
    intact = model.transform(needed).agg(F.avg(error).alias("intact_mae"))
    paired = stored(shuffled_partners(needed, key, features, repeats, seed), "partners")
    shuffled = []
    for name in features:
        swapped = paired.withColumn(name, F.col(f"__partner.{name}"))
        losses = model.transform(swapped).groupBy("__repeat").agg(F.avg(error).alias("mae"))
        shuffled.append(losses.select(F.lit(name).alias("feature"), "__repeat", "mae"))
    losses = shuffled[0]
    for other in shuffled[1:]:
        losses = losses.unionByName(other)
    return _importances(losses, intact, model_name)


def level_slots(model: PipelineModel, features: list[str]) -> dict[str, int] | None:
    """The place of every feature in the vector of a forest that tasks hold whole; None for any other model."""
    made = [s for s in model.stages[:-1] if isinstance(s, VectorAssembler) and s.getOutputCol() == TREE]
    if not made or not isinstance(model.stages[-1], ForestModel) or model.stages[-1].subtrees is not None:
        return None
    inputs = made[0].getInputCols()
    places = {name: inputs.index(f"{name}{end}") for name in features for end in ("__scaled", "__index") if f"{name}{end}" in inputs}
    return places if len(places) == len(features) == len(set(places.values())) else None


def _importances(losses: DataFrame, intact: DataFrame, model_name: str) -> DataFrame:
    increase = F.col("mae") - F.col("intact_mae")
    table = with_one_row(losses, intact).groupBy("feature").agg(
        F.avg(increase).alias("importance_mean_mae_increase"),
        F.stddev_pop(increase).alias("importance_std"),
    )
    named = table.withColumn("model_name", F.lit(model_name))
    numbered = summary_position(named, ["-importance_mean_mae_increase", "feature"], "importance_id")
    return numbered.select(
        "importance_id", "model_name", "feature", "importance_mean_mae_increase", "importance_std"
    )


def reproduction_check(
    path: str, df: DataFrame, stored: DataFrame, key: str, value: str, sample: int = 25,
    tolerance: float = REPRODUCTION_TOLERANCE,
) -> DataFrame:
    """Reload a saved model, score the first rows again and compare with the stored predictions."""
    model = PipelineModel.load(path)
    rebuilt = predict(model, head_by(df, key, sample), value).select(key, value)
    found = reproduction_diff(stored.select(key, value), rebuilt, key, value)
    return found.withColumn("reproduced", (F.col("max_difference") <= F.lit(tolerance)).cast("int"))
