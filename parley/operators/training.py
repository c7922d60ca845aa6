"""Training the five classifiers of the cascade and scoring with them.

A classifier is a Spark ML pipeline over hashed words: fitting is a distributed sum of gradients,
so its cost grows with the examples and its model stays small. The candidate with the
best macro F1 on the validation split is kept; the first one wins ties.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.tokens import punctuation_tokens
from parley.operators.classmetrics import class_f1
from parley.operators.labels import module_examples
from parley.operators.sampling import balance
from parley.schema import MODULES
from parley.session import durable

FEATURES = 1 << 14
REGULARIZATION = (0.01, 0.1)


def _words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_words", punctuation_tokens(F.col(text)))


def fit_features(train: DataFrame, text: str = "context", features: int = FEATURES) -> PipelineModel:
    """Hashed word counts, weighted by how rare the words are in the training texts."""
    stages = [
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
    ]
    return Pipeline(stages=stages).fit(_words(train, text))


def _classifier(label: str, regularization: float) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="_features",
        labelCol=label,
        family="multinomial",
        regParam=regularization,
        maxIter=20,
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        predictionCol="_prediction",
    )


def score_text(model: PipelineModel, df: DataFrame, output: str, text: str = "context") -> DataFrame:
    """Add the class probabilities of a text as an array column."""
    scored = model.transform(_words(df, text))
    return scored.select(*df.columns, vector_to_array("_probability").alias(output))


def macro_f1(scored: DataFrame, probs: str, label: str = "label") -> float:
    best = (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
    row = class_f1(scored.withColumn("_best", best), label, "_best").first()
    return float(row["macro_f1"] or 0.0) if row else 0.0


def fit_best(
    train: DataFrame,
    validation: DataFrame,
    grid: Sequence[float] = REGULARIZATION,
    text: str = "context",
    label: str = "label",
    features: int = FEATURES,
) -> tuple[PipelineModel, float]:
    """The candidate with the highest validation macro F1, and that score."""
    if not grid:
        raise ValueError("the grid is empty")
    weigh = fit_features(train, text, features)
    ready = weigh.transform(_words(train, text)).select("_features", label).persist()
    check = weigh.transform(_words(validation, text)).select("_features", label).persist()
    try:
        tried = []
        for value in grid:
            model = _classifier(label, value).fit(ready)
            probs = model.transform(check).select(label, vector_to_array("_probability").alias("_p"))
            tried.append((macro_f1(probs, "_p", label), model))
    finally:
        ready.unpersist()
        check.unpersist()
    # max keeps the first of equal scores
    score, model = max(tried, key=lambda pair: pair[0])
    return PipelineModel([*weigh.stages, model]), score


def train_modules(
    utterances: DataFrame, grid: Sequence[float] = REGULARIZATION, features: int = FEATURES
) -> dict[str, tuple[PipelineModel, float]]:
    """Fit every module on its own examples; predictors see balanced classes.

    The examples are made once for all modules and stored, as every fit reads them repeatedly.
    """
    spark = utterances.sparkSession
    examples = durable(module_examples(utterances))
    balanced_names = [name for name, _, _, oversample, _ in MODULES if oversample]
    train = examples.filter("split = 'train'")
    balanced = durable(
        balance(
            train.filter(F.col("module").isin(balanced_names)), ["module"], ["conv_id", "turn_idx"]
        )
    )
    def fit(name: str) -> tuple[PipelineModel, float]:
        own = F.col("module") == name
        source = balanced.drop("copy") if name in balanced_names else train
        checked = examples.filter(own & (F.col("split") == "validation"))
        return fit_best(source.filter(own), checked, grid, features=features)

    # the modules do not depend on each other, so their Spark jobs are submitted side by side
    names = [name for name, *_ in MODULES]
    with ThreadPool(len(names)) as pool:
        return dict(zip(names, pool.map(inheritable_thread_target(spark)(fit), names)))


def scorers(models: dict[str, PipelineModel]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Scoring functions for :func:`parley.operators.cascade.score_by_route`.

    A module that looks at one turn only is given the current turn, all others the full context.
    """
    return {name: partial(score_text, model, output=name, text=module_input(name)) for name, model in models.items()}


def module_input(name: str) -> str:
    """The column that a module reads."""
    width = {module: turns for module, *_, turns in MODULES}
    return "current_turn" if width[name] == 1 else "context"


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_models(path: str) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{path}/{name}") for name, *_ in MODULES}
