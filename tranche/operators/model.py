"""Cancellation-risk model (M1-M15) as a ``pyspark.ml`` pipeline.

Training runs distributed (gradient-boosted trees build each tree from
partition-level histograms) on every training row, in a number of partitions that
follows the number of rows alone, so its result does not depend on the cluster.
Scoring is a lazy ``transform``, so the top-50 list and the probability histogram are ordinary DataFrame queries over all
companies (D-2: not over a truncated set).

The split orders each class's companies by md5 of key and seed and cuts at an exact
rank: the same companies whatever the partitions, and the same in SQL.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tranche import config as C
from tranche.functions import exprs as X
from tranche.operators import risk as RK
from tranche.session import ensure_checkpoint_dir
from tranche.sources import files
from tranche.sources.store import write_and_reload

FEATURES = C.ML_FEATURES
LABEL = C.ML_LABEL
M1_COLUMNS = [
    "cnpj_raiz", "total_parcelamentos", "qtd_ativos", "qtd_cancelados", "qtd_quitados",
    "qtd_pendentes_1a_parcela", "taxa_sucesso_pct", "valor_total_parcelado", "valor_medio_parcelamento",
    "media_parcelas", "media_dias_quitacao", "media_dias_ate_cancelamento",
    "dias_desde_ultimo_parcelamento", "flag_reincidente", "flag_nunca_quitou", "flag_simples_nacional",
    "classificacao_comportamento",
]


@dataclass(frozen=True)
class ModelParams:
    """Model size as in the reference trainer; split 80/20 stratified."""

    max_iter: int = 100
    max_depth: int = 5
    step_size: float = 0.1
    seed: int = 42
    test_fraction: float = 0.2
    min_agreements: int = 2
    # training rows of each class, those of the smallest hashes; None: all of them
    max_rows_per_class: int | None = None
    # at least, of the training rows, by hash of the company; every boosting round
    # runs several jobs, so many tiny partitions cost far more than the work they hold
    partitions: int = 8
    rows_a_partition: int = 250_000          # of the training rows; more of them, more partitions


DEFAULT_MODEL = ModelParams()


def training_frame(companies: DataFrame, mp: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Companies with >= 2 agreements, label = has active agreements
    and a risky behaviour class (D-6: the label leaks from the features;
    kept for parity)."""
    label = F.when((F.col("qtd_ativos") > 0)
                   & F.col("classificacao_comportamento").isin(C.RISKY_BEHAVIOURS), F.lit(1)).otherwise(F.lit(0))
    return (companies.where(F.col("total_parcelamentos") >= mp.min_agreements)
            .select(*M1_COLUMNS, label.alias(LABEL)))


def clean_training(frame: DataFrame) -> DataFrame:
    """Drop rows with a null (or NaN) feature or label."""
    return frame.na.drop(subset=FEATURES + [LABEL])


def as_double_features(df: DataFrame) -> DataFrame:
    """Features as double (decimals and ints), other columns untouched."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in FEATURES else F.col(c) for c in df.columns])


def scoring_frame(companies_scored: DataFrame) -> DataFrame:
    """The columns of a company table with all features as double; a feature that it lacks is 0."""
    absent = [F.lit(0.0).alias(c) for c in FEATURES if c not in companies_scored.columns]
    return as_double_features(companies_scored).select("*", *absent)


def stored(df: DataFrame, what: str) -> DataFrame:
    return write_and_reload(df, f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}")


def company_hash(mp: ModelParams = DEFAULT_MODEL) -> Column:
    return F.md5(F.concat(F.col("cnpj_raiz"), F.lit(f":{mp.seed}")).cast("binary"))


def hash_cuts(hashed: DataFrame, by: str, take: Callable[[Column], Column]) -> DataFrame:
    """(``by``, ``_cut``): the hash up to which a class has exactly ``take(rows)`` rows (``hashed`` has ``_h``, hex digits).

    Rows are counted by the hash's first four digits, at most 65,536 counts a class;
    only the rows that share the cut's digits are ranked."""
    digits = F.substring("_h", 1, 4)
    counts = hashed.groupBy(by, digits.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    of = Window.partitionBy(by)
    run = counts.select(by, "_b", "_c", F.sum("_c").over(of.orderBy("_b")).alias("_upto"), take(F.sum("_c").over(of)).alias("_k"))
    at = run.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k")))
    at = F.broadcast(at.select(by, "_b", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_r")))       # one row a class
    inside = hashed.select(by, "_h", digits.alias("_b")).join(at, [by, "_b"])
    rank = F.row_number().over(of.orderBy("_h"))
    return inside.withColumn("_rank", rank).where(F.col("_rank") == F.col("_r")).select(by, F.col("_h").alias("_cut"))


def stratified_split(frame: DataFrame, mp: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """M4: adds ``is_test``: of each class, exactly the ``test_fraction`` (rounded
    down) of its companies whose hashes are smallest."""
    hashed = frame.withColumn("_h", company_hash(mp))
    cuts = hash_cuts(hashed, LABEL, lambda n: F.floor(n * F.lit(mp.test_fraction)))
    return (hashed.join(F.broadcast(cuts), LABEL, "left")                   # one row a class
            .withColumn("is_test", F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False)))
            .select(*frame.columns, "is_test"))


def bounded_sample(frame: DataFrame, mp: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Of each class, the at most ``max_rows_per_class`` rows whose hashes are smallest; all rows without that bound."""
    if mp.max_rows_per_class is None:
        return frame
    hashed = frame.withColumn("_h", company_hash(mp))
    cuts = hash_cuts(hashed, LABEL, lambda n: F.least(n, F.lit(mp.max_rows_per_class)))
    return hashed.join(F.broadcast(cuts), LABEL).where(F.col("_h") <= F.col("_cut")).select(*frame.columns)


def exact_medians(df: DataFrame, cols: list[str], ranges: int = 1_024) -> dict[str, float | None]:
    """Exact (interpolated) medians by selection; no value list reaches the driver.

    For each middle rank the interval that holds it is cut into ``ranges`` equal
    ranges, the rows of each are counted on the executors with their smallest and
    largest value, and the range with the rank, narrowed to those two values, is the
    next interval.  It ends when they are equal; at least one value leaves every
    round, and usually all but a thousandth.  A round collects at most ``ranges``
    rows for each of the two ranks of a column.  Nulls and NaN are left out."""
    wide = stored(df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols]), "medians")
    big = float("inf")
    first = wide.agg(*[f(c).alias(f"{name}_{i}") for i, c in enumerate(cols) for name, f in (
        ("n", F.count), ("low", lambda c: F.count_if(F.col(c) == -big)), ("high", lambda c: F.count_if(F.col(c) == big)),
        ("min", lambda c: F.min(F.when(F.abs(F.col(c)) < big, F.col(c)))), ("max", lambda c: F.max(F.when(F.abs(F.col(c)) < big, F.col(c)))))]).first()
    found: dict[tuple[int, int], float] = {}
    still: dict[tuple[int, int], tuple[float, float, int]] = {}        # (column, rank) -> smallest, largest, rows below
    for i in range(len(cols)):
        n, low, high = (first[f"{k}_{i}"] for k in ("n", "low", "high"))
        for k in {(n - 1) // 2, n // 2} if n else ():
            if k < low or k >= n - high:
                found[i, k] = -big if k < low else big
            else:
                still[i, k] = (first[f"min_{i}"], first[f"max_{i}"], low)
    while still:
        open_now = sorted({(i, lo, hi, below) for (i, _), (lo, hi, below) in still.items() if lo < hi})
        found |= {key: lo for key, (lo, hi, _) in still.items() if lo == hi}
        still = {key: at for key, at in still.items() if at[0] < at[1]}
        if not open_now:
            break
        pieces = []
        for j, (i, lo, hi, _) in enumerate(open_now):
            x = F.col(cols[i])
            place = F.least(F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * ranges).cast("int"), F.lit(ranges - 1))
            pieces.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(j).alias("j"), place.alias("place"), x.alias("x"))))
        counted: dict[int, list] = {}
        for r in (wide.select(F.explode(F.array(*pieces)).alias("p")).where(F.col("p").isNotNull())
                  .groupBy("p.j", "p.place").agg(F.count(F.lit(1)).alias("n"), F.min("p.x").alias("lo"), F.max("p.x").alias("hi"))
                  .collect()):                                          # at most len(open_now) * ranges rows
            counted.setdefault(r["j"], []).append(r)
        for (i, k), (lo, hi, below) in list(still.items()):
            upto = below
            for r in sorted(counted[open_now.index((i, lo, hi, below))], key=lambda r: r["place"]):
                if upto <= k < upto + r["n"]:
                    still[i, k] = (r["lo"], r["hi"], upto)
                    break
                upto += r["n"]
    middle = {i: [x for (j, _), x in sorted(found.items()) if j == i] for i in range(len(cols))}
    return {c: (middle[i][0] + middle[i][-1]) / 2.0 if middle[i] else None for i, c in enumerate(cols)}


def feature_medians(frame: DataFrame) -> DataFrame:
    """A14 as a one-row frame (feature -> exact median)."""
    med = exact_medians(frame, FEATURES)
    schema = ", ".join(f"{c} double" for c in FEATURES)
    return frame.sparkSession.createDataFrame([tuple(med[c] for c in FEATURES)], schema)


def build_pipeline(mp: ModelParams = DEFAULT_MODEL) -> Pipeline:
    """M3 + M5 + M6: median imputer (fitted on training data), assembler,
    standard scaler (fit on train only), gradient-boosted trees."""
    imputed = [f"{c}__imp" for c in FEATURES]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=FEATURES, outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol="features_raw", handleInvalid="error"),
        StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True),
        GBTClassifier(featuresCol="features", labelCol=LABEL, maxIter=mp.max_iter, maxDepth=mp.max_depth,
                      stepSize=mp.step_size, seed=mp.seed, checkpointInterval=10),
    ])


@dataclass
class TrainedModel:
    model: PipelineModel
    accuracy: float
    roc_auc: float
    importances: dict[str, float]
    n_train: int
    n_test: int
    n_fitted: int = 0                        # training rows that the fit read
    test_predictions: str | None = None      # where the test rows' predictions are stored


def roc_auc(predictions: DataFrame, score: str = "prob_cancelamento", label: str = LABEL) -> float | None:
    """M9: area under the ROC curve as a rank sum, ties counted half (None unless both classes are there).

    Equal scores are counted first; their ranks are the sum of the counts of the
    lower ranges (one number a partition) and a running sum within the range."""
    counted = predictions.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"),
                                             F.sum(1 - F.col(label).cast("long")).alias("neg"))
    ranged = stored(counted.repartitionByRange(score).withColumn("pid", F.spark_partition_id()), "score-ranges")
    parts = sorted((r["pid"], r["neg"], r["pos"]) for r in ranged.groupBy("pid").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).collect())
    n_neg, n_pos = sum(p[1] for p in parts), sum(p[2] for p in parts)
    if not n_neg or not n_pos:
        return None
    lower, upto = [], 0
    for pid, neg, _ in parts:
        lower.append((pid, upto))
        upto += neg
    offsets = F.broadcast(predictions.sparkSession.createDataFrame(lower, "pid int, lower long"))       # one row a partition
    before = F.sum("neg").over(Window.partitionBy("pid").orderBy(score)) - F.col("neg")
    pairs = F.col("pos") * (F.col("lower") + before) + F.col("pos") * F.col("neg") / F.lit(2.0)
    return ranged.join(offsets, "pid").select(pairs.alias("x")).agg(F.sum("x")).first()[0] / n_neg / n_pos


def evaluate(predictions: DataFrame) -> tuple[float, float, int]:
    """M8/M9: accuracy, area under the ROC curve and rows of (prob_cancelamento, risco_ml, label)."""
    acc, n = predictions.agg(F.avg((F.col("risco_ml") == F.col(LABEL)).cast("double")), F.count(F.lit(1))).first()
    return float(acc or 0.0), float(roc_auc(predictions) or 0.0), n


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """M7: ``rows`` (features as double) with probability and class."""
    return model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias("prob_cancelamento"),
                                        F.col("prediction").cast("int").alias("risco_ml"))


def train(companies: DataFrame, mp: ModelParams = DEFAULT_MODEL) -> TrainedModel:
    """Frame, clean, split, fit on all training rows (unless a bound is given), evaluate on all test rows.

    The frame is stored before the split, which reads it three times."""
    frame = stored(as_double_features(clean_training(training_frame(companies, mp))), "model-frame")
    split = stored(stratified_split(frame.withColumn(LABEL, F.col(LABEL).cast("double")), mp), "model-split")
    test_df = split.where("is_test")
    fitted = bounded_sample(split.where("NOT is_test"), mp)
    if mp.max_rows_per_class is not None:
        fitted = stored(fitted, "model-rows")
    n_fitted = fitted.count()
    partitions = max(mp.partitions, -(-n_fitted // mp.rows_a_partition))
    # The same rows in the same order in every run, whatever files they were read from.
    model = build_pipeline(mp).fit(fitted.repartition(partitions, "cnpj_raiz").sortWithinPartitions("cnpj_raiz"))
    where = f"{ensure_checkpoint_dir(companies.sparkSession).rstrip('/')}/test-predictions-{uuid.uuid4().hex}"
    acc, auc, n_test = evaluate(write_and_reload(predicted(model, test_df), where))
    imp = dict(zip(FEATURES, [float(v) for v in model.stages[-1].featureImportances.toArray()]))
    return TrainedModel(model, acc, auc, imp, split.where("NOT is_test").count(), n_test, n_fitted, where)


def kept_at(root: str, version: str, mp: ModelParams = DEFAULT_MODEL) -> str:
    """Where the model of one version of the input is kept."""
    return f"{root.rstrip('/')}/{hashlib.sha256(repr((version, mp)).encode()).hexdigest()}"


def is_kept(spark: SparkSession, root: str, version: str, mp: ModelParams = DEFAULT_MODEL) -> bool:
    return files.exists(spark, f"{kept_at(root, version, mp)}/metrics")


def fit_or_load(companies: DataFrame, root: str, version: str, mp: ModelParams = DEFAULT_MODEL) -> TrainedModel:
    """The model of one version of the input, fitted once and kept under ``root``.

    ``version`` names the input (``plans.builds.source_version``): another version, or
    other parameters, have a model of their own.  The metrics are written last, so
    a model that has them is whole."""
    spark = companies.sparkSession
    path = kept_at(root, version, mp)
    if is_kept(spark, root, version, mp):
        return TrainedModel(model=load(f"{path}/model"), **json.loads(files.read_text(spark, f"{path}/metrics")))
    tm = train(companies, mp)
    save(tm, f"{path}/model")
    files.write_text(spark, f"{path}/metrics", json.dumps({k: v for k, v in vars(tm).items() if k != "model"}))
    return tm


def metrics_frame(tm: TrainedModel, spark) -> DataFrame:
    """M8/M9: one row of metrics (+ F6-style text)."""
    df = spark.createDataFrame([(tm.accuracy, tm.roc_auc, tm.n_train, tm.n_test)],
                               "accuracy double, roc_auc double, n_treino long, n_teste long")
    return df.withColumn("accuracy_texto", X.format_pct(F.col("accuracy") * 100.0)) \
             .withColumn("auc_texto", X.format_pattern("roc_auc", "0.000"))


def importance_frame(tm: TrainedModel, spark) -> DataFrame:
    """Feature importances, ascending."""
    return (spark.createDataFrame(list(tm.importances.items()), "feature string, importancia double")
            .orderBy("importancia", "feature"))


def score_companies(tm: TrainedModel, companies_scored: DataFrame) -> DataFrame:
    """Probability and class for every company.

    A feature that the company table lacks is 0; nulls are filled by the imputer
    fitted on training data."""
    keep = [c for c in companies_scored.columns if c not in FEATURES]
    return (predicted(tm.model, scoring_frame(companies_scored))
            .select(*keep, *FEATURES, "prob_cancelamento", "risco_ml")
            .withColumn("faixa_probabilidade", X.probability_band("prob_cancelamento")))


def top_probability(predictions: DataFrame, n: int = 50) -> DataFrame:
    """Highest cancellation probability (key as tie-breaker)."""
    return predictions.orderBy(F.col("prob_cancelamento").desc(), F.col("cnpj_raiz")).limit(n)


def probability_histogram(predictions: DataFrame, bins: int = 50) -> DataFrame:
    """M13/A17."""
    return RK.histogram(predictions, "prob_cancelamento", bins)


def save(tm: TrainedModel, path: str) -> None:
    """Persist the fitted pipeline (shared storage path)."""
    tm.model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
