"""Hyperparameter search: every candidate is scored by stratified folds on Spark."""

from __future__ import annotations

import itertools
import math
import random
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.scalars import algorithm_name, strip_prefix
from sparktab.operators import metrics, split
from sparktab.operators.estimators import fit_classifier
from sparktab.operators.features import build_encoder
from sparktab.operators.modelling import feature_columns_of, stored_encoded, with_class_number
from sparktab.operators.prep import ROW_ID
from sparktab.session import remove, store


@dataclass(frozen=True)
class Choice:
    values: tuple


@dataclass(frozen=True)
class IntRange:
    low: int
    high: int


@dataclass(frozen=True)
class FloatRange:
    low: float
    high: float
    log: bool = False


# List spaces for grid and random search.
LIST_SPACES: dict[str, dict[str, list]] = {
    "svm": {"C": [0.1, 1, 10], "gamma": ["scale", 0.1, 0.01], "kernel": ["rbf", "linear"]},
    "random_forest": {
        "n_estimators": [100, 200, 300],
        "max_depth": [5, 10, 20],
        "min_samples_split": [2, 5],
    },
    "adaboost": {"n_estimators": [50, 150, 300], "learning_rate": [0.05, 0.1, 0.5, 1.0]},
    "xgboost": {
        "n_estimators": [100, 200, 300],
        "max_depth": [3, 6, 9],
        "learning_rate": [0.03, 0.1, 0.2],
        "subsample": [0.8, 0.9, 1.0],
        "colsample_bytree": [0.8, 0.9, 1.0],
    },
    "knn": {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"]},
    "logistic_regression": {
        "C": [0.01, 0.1, 1, 10],
        "solver": ["lbfgs"],
        "max_iter": [300, 500, 1000],
    },
    "neural_network": {
        "hidden_layer_sizes": [(32,), (64, 32)],
        "learning_rate_init": [0.0005, 0.001],
        "max_iter": [250, 350],
        "early_stopping": [True],
    },
}
# Distributions for sequential search.
RANGE_SPACES: dict[str, dict] = {
    "svm": {
        "C": FloatRange(1e-2, 10.0, log=True),
        "gamma": FloatRange(1e-3, 1.0, log=True),
        "kernel": Choice(("rbf", "linear")),
    },
    "random_forest": {
        "n_estimators": IntRange(80, 300),
        "max_depth": IntRange(3, 20),
        "min_samples_split": IntRange(2, 10),
    },
    "adaboost": {
        "n_estimators": IntRange(50, 400),
        "learning_rate": FloatRange(0.01, 1.0, log=True),
    },
    "xgboost": {
        "n_estimators": IntRange(100, 400),
        "max_depth": IntRange(3, 10),
        "learning_rate": FloatRange(0.01, 0.3, log=True),
        "subsample": FloatRange(0.7, 1.0),
        "colsample_bytree": FloatRange(0.7, 1.0),
    },
    "knn": {"n_neighbors": IntRange(3, 15), "weights": Choice(("uniform", "distance"))},
    "logistic_regression": {
        "C": FloatRange(1e-3, 10.0, log=True),
        "max_iter": IntRange(200, 1000),
        "solver": Choice(("lbfgs",)),
    },
    "neural_network": {
        "hidden_layer_sizes": Choice(((32,), (64, 32))),
        "learning_rate_init": FloatRange(5e-4, 2e-3, log=True),
        "max_iter": IntRange(200, 400),
        "early_stopping": Choice((True,)),
    },
}
# Scorings that become macro means beyond two classes.
MACRO_SCORINGS = {"f1": "f1_macro", "precision": "precision_macro", "recall": "recall_macro"}


def resolve_scoring(scoring: str, n_classes: int) -> str:
    return MACRO_SCORINGS.get(scoring, scoring) if n_classes > 2 else scoring


def score_rows(scored: DataFrame, classes: list, scoring: str) -> float | None:
    """One number for rows with label, prediction and probability; greater is better."""
    if scoring in ("accuracy", "f1", "precision", "recall"):
        return metrics.classification_metrics(scored).first()[scoring]
    if scoring in MACRO_SCORINGS.values():
        return metrics.macro_metrics(metrics.confusion_counts(scored)).first()[scoring]
    if scoring in ("roc_auc", "roc_auc_ovr"):
        return metrics.roc_auc(scored, classes).first()["roc_auc"]
    losses = {"neg_log_loss": "log_loss", "neg_brier_score": "brier_score"}
    if scoring in losses:
        loss = metrics.probability_losses(scored, classes).first()[losses[scoring]]
        return None if loss is None else -loss
    raise ValueError(f"Unknown scoring: {scoring}")


class FoldScorer:
    """Mean fold score of parameter sets.

    The encoder of a fold depends on its training rows only, so it is fitted once per
    fold and its stored output serves every candidate; no validation row leaks in.
    """

    def __init__(
        self,
        df: DataFrame,
        target: str,
        counts: dict,
        algorithm: str,
        cv: int = 3,
        scoring: str = "f1",
        seed: int = 42,
        row_id: str = ROW_ID,
        parallelism: int = 2,
    ):
        self.algorithm = algorithm_name(algorithm)
        self.classes = list(counts)
        self.scoring = resolve_scoring(scoring, len(counts))
        self.row_id, self.parallelism = row_id, parallelism
        features = feature_columns_of(df, target, row_id)
        numbered = with_class_number(df, target, self.classes)
        plan = build_encoder(numbered, features)
        folded, at = store(split.stratified_folds(numbered, target, row_id, counts, cv, seed), "folds")
        self.folds, self._paths = [], [at]
        for f in range(cv):
            train = folded.where(F.col("fold") != f).drop("fold")
            valid = folded.where(F.col("fold") == f).drop("fold")
            pair, paths = stored_encoded([train, valid], plan.fit(train), row_id, target)
            self.folds.append(pair)
            self._paths += paths

    def _fold_score(self, params: dict, fold: list[DataFrame]) -> float:
        train, valid = fold
        stages = fit_classifier(self.algorithm, train, len(self.classes), params, self.row_id)
        scored = PipelineModel(stages).transform(valid).select(
            "label", "prediction", vector_to_array("probability").alias("probability")
        )
        numbers = [float(i) for i in range(len(self.classes))]
        value = score_rows(scored, numbers, self.scoring)
        return -math.inf if value is None else value

    def scores(self, candidates: list[dict]) -> list[float]:
        """Mean score per candidate; candidates and folds run as concurrent Spark jobs."""
        tasks = [(strip_prefix(c), fold) for c in candidates for fold in self.folds]
        with ThreadPool(max(1, min(self.parallelism, len(tasks)))) as pool:
            flat = pool.starmap(self._fold_score, tasks)
        k = len(self.folds)
        return [sum(flat[i * k : (i + 1) * k]) / k for i in range(len(candidates))]

    def close(self) -> None:
        remove(self.folds[0][0].sparkSession, *self._paths)


def expand_grid(space: dict[str, list]) -> list[dict]:
    names = sorted(space)
    return [dict(zip(names, values)) for values in itertools.product(*[space[n] for n in names])]


def grid_candidates(space: dict[str, list]) -> list[dict]:
    return expand_grid(space)


def random_candidates(space: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """Seeded draw without replacement, the whole grid if it is smaller."""
    grid = expand_grid(space)
    return random.Random(seed).sample(grid, min(n_iter, len(grid)))


class SequentialProposer:
    """Tree-structured Parzen proposals (Bergstra et al. 2011), one trial after another.

    Trials are split into a good and a bad part; values are drawn from a kernel density
    of the good part and the draw with the best good/bad density ratio is proposed.
    """

    STARTUP, DRAWS, GOOD_SHARE = 10, 24, 0.25

    def __init__(self, space: dict, seed: int = 42):
        self.space, self.rng = space, random.Random(seed)
        self.trials: list[tuple[dict, float]] = []

    def tell(self, params: dict, score: float) -> None:
        self.trials.append((params, score))

    def ask(self) -> dict:
        if len(self.trials) < self.STARTUP:
            return {n: self._uniform(s) for n, s in self.space.items()}
        ranked = sorted(self.trials, key=lambda t: -t[1])
        cut = max(1, math.ceil(self.GOOD_SHARE * len(ranked)))
        good, bad = ranked[:cut], ranked[cut:]
        out = {}
        for name, s in self.space.items():
            near, far = ([p[name] for p, _ in part] for part in (good, bad))
            draws = [self._draw(s, near) for _ in range(self.DRAWS)]
            out[name] = max(draws, key=lambda v: self._density(s, near, v) / self._density(s, far, v))
        return out

    def _uniform(self, s):
        if isinstance(s, Choice):
            return self.rng.choice(s.values)
        lo, hi = self._axis(s, s.low), self._axis(s, s.high)
        return self._value(s, self.rng.uniform(lo, hi))

    @staticmethod
    def _axis(s, v) -> float:
        return math.log(v) if isinstance(s, FloatRange) and s.log else float(v)

    @staticmethod
    def _value(s, x):
        if isinstance(s, IntRange):
            return min(s.high, max(s.low, round(x)))
        v = math.exp(x) if s.log else x
        return min(s.high, max(s.low, v))

    def _width(self, s, seen) -> float:
        return (self._axis(s, s.high) - self._axis(s, s.low)) / max(1.0, math.sqrt(len(seen)))

    def _draw(self, s, seen):
        # One pseudo trial keeps every value reachable.
        if not seen or self.rng.random() < 1 / (len(seen) + 1):
            return self._uniform(s)
        centre = self.rng.choice(seen)
        if isinstance(s, Choice):
            return centre
        return self._value(s, self.rng.gauss(self._axis(s, centre), self._width(s, seen)))

    def _density(self, s, seen, v) -> float:
        if isinstance(s, Choice):
            return (seen.count(v) + 1 / len(s.values)) / (len(seen) + 1)
        span = self._axis(s, s.high) - self._axis(s, s.low)
        x, w = self._axis(s, v), self._width(s, seen)
        kernels = sum(
            math.exp(-0.5 * ((x - self._axis(s, c)) / w) ** 2) / (w * math.sqrt(2 * math.pi))
            for c in seen
        )
        return (kernels + 1 / span) / (len(seen) + 1)


def search(
    scorer: FoldScorer,
    method: str,
    space: dict | None = None,
    n_iter: int = 20,
    n_trials: int = 20,
    seed: int = 42,
) -> list[tuple[dict, float]]:
    """All (parameters, mean score) of a search, in the order they were tried."""
    if method in ("grid", "random", "automl_quick"):
        lists = strip_prefix(space or LIST_SPACES[scorer.algorithm])
        candidates = (
            grid_candidates(lists)
            if method == "grid"
            else random_candidates(lists, 5 if method == "automl_quick" else n_iter, seed)
        )
        return list(zip(candidates, scorer.scores(candidates)))
    if method not in ("sequential", "optuna"):
        raise ValueError(f"Unknown search method: {method}")
    proposer = SequentialProposer(strip_prefix(space or RANGE_SPACES[scorer.algorithm]), seed)
    for _ in range(n_trials):
        params = proposer.ask()
        proposer.tell(params, scorer.scores([params])[0])
    return proposer.trials


def best_trial(trials: list[tuple[dict, float]]) -> tuple[dict, float]:
    return max(trials, key=lambda t: t[1])
