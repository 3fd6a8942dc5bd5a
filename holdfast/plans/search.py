"""Search that learns from its trials, stops poor ones early, and can be taken up again.

Proposals come from a density surrogate (tree-structured Parzen estimator, Bergstra et al. 2011): finished trials
are parted into the best quarter and the rest, each parameter gets a density for both, values are drawn from
the first, and of many draws the one with the highest ratio is proposed. Proposals of a batch count as
poor trials until they are scored, so a batch spreads out.

Folds are the rungs of a trial. After each one the mean score so far is compared with the median that
all trials had on the same rung; a trial below it is stopped. The trials of a batch go from rung to rung
together, so the outcome does not depend on which job ends first.

Every score is appended to a ledger, keyed by the hash of the plan and the hash of the parameters. A
search that is broken off asks the ledger first and fits only what is missing; as proposals are seeded
and depend on scores alone, it goes on with the same trials.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool
from statistics import median

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from holdfast.operators.split import add_folds
from holdfast.plans.models import make_model, prepared, weight_columns
from holdfast.plans.tuning import RANGES, auc, tuning_summary
from holdfast.schema import ID, TARGET
from holdfast.session import staged

#: Share of the best trials, draws per proposal, and random trials at the start.
BEST, DRAWS, FIRST = 0.25, 64, 5
#: Trials that must have reached a rung before one is stopped there.
LEAST = 3


# ---- parameters as numbers -------------------------------------------------------------------
def to_unit(spec, value) -> float:
    """A value as a number between 0 and 1, or as its place in a list."""
    if isinstance(spec, list):
        return float(spec.index(value))
    kind, low, high = spec
    if kind == "log":
        return math.log(value / low) / math.log(high / low)
    return (value - low) / (high - low) if high > low else 0.0


def from_unit(spec, u: float):
    if isinstance(spec, list):
        return spec[int(u)]
    kind, low, high = spec
    u = min(1.0, max(0.0, u))
    if kind == "int":
        return int(min(high, low + math.floor(u * (high - low + 1))))
    return low * (high / low) ** u if kind == "log" else low + u * (high - low)


class Density:
    """Density of one parameter over the values it had in some trials, mixed with an even one."""

    def __init__(self, spec, units: Sequence[float]):
        self.spec, self.units = spec, np.sort(np.asarray(units, float))
        if isinstance(spec, list):
            counts = np.ones(len(spec))
            for u in self.units:
                counts[int(u)] += 1
            self.weights = counts / counts.sum()
        elif len(self.units):
            # as wide as the gap to the neighbours, within limits
            edges = np.concatenate([[0.0], self.units, [1.0]])
            gaps = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
            self.width = np.clip(gaps, 1.0 / min(100, 1 + len(self.units)), 1.0)

    def draw(self, rng: np.random.Generator) -> float:
        if isinstance(self.spec, list):
            return float(rng.choice(len(self.weights), p=self.weights))
        at = int(rng.integers(len(self.units) + 1))
        if at == len(self.units):
            return float(rng.random())
        for _ in range(100):
            u = float(rng.normal(self.units[at], self.width[at]))
            if 0.0 <= u <= 1.0:
                return u
        return float(self.units[at])

    def log(self, u: float) -> float:
        if isinstance(self.spec, list):
            return math.log(self.weights[int(u)])
        total = 1.0
        for c, w in zip(self.units, getattr(self, "width", ())):
            inside = 0.5 * (math.erf((1 - c) / (w * math.sqrt(2))) + math.erf(c / (w * math.sqrt(2))))
            total += math.exp(-0.5 * ((u - c) / w) ** 2) / (w * math.sqrt(2 * math.pi) * inside)
        return math.log(total / (1 + len(self.units)))


def propose(space: dict, trials: Sequence[tuple[dict, float]], n: int, seed: int = 42,
            first: int = FIRST) -> list[dict]:
    """The next ``n`` parameter sets after scored trials (parameters, score; higher is better)."""
    rng = np.random.default_rng([seed, len(trials)])
    out: list[dict] = []
    for _ in range(n):
        if len(trials) < first:
            out.append({k: from_unit(s, float(rng.integers(len(s))) if isinstance(s, list)
                                     else float(rng.random())) for k, s in space.items()})
            continue
        ranked = sorted(trials, key=lambda t: -t[1])
        good = max(1, math.ceil(BEST * math.sqrt(len(ranked))) if len(ranked) < 16
                   else math.ceil(BEST * len(ranked)))
        best = [p for p, _ in ranked[:good]]
        rest = [p for p, _ in ranked[good:]] + out
        near = {k: Density(s, [to_unit(s, p[k]) for p in best]) for k, s in space.items()}
        far = {k: Density(s, [to_unit(s, p[k]) for p in rest]) for k, s in space.items()}
        draws = [{k: d.draw(rng) for k, d in near.items()} for _ in range(DRAWS)]
        chosen = max(draws, key=lambda u: sum(near[k].log(u[k]) - far[k].log(u[k]) for k in space))
        out.append({k: from_unit(s, chosen[k]) for k, s in space.items()})
    return out


# ---- ledger ----------------------------------------------------------------------------------
def key_of(value) -> str:
    """Hash of a plan or of parameters, whatever the order of their names."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:32]


class Ledger:
    """Append-only table of scores in a shared folder: plan, params_key, rung, params, score."""

    SCHEMA = "plan string, params_key string, rung int, params string, score double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def known(self, plan: str) -> dict[tuple[str, int], float]:
        """Scores of a plan by parameters and rung; there are a few for each trial."""
        rows = self.read().where(f"plan = '{plan}'").collect()
        return {(r["params_key"], r["rung"]): r["score"] for r in rows}

    def add(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(
                self.path)


# ---- search ----------------------------------------------------------------------------------
def run_trials(space: dict, n_trials: int, rungs: int, score, parallelism: int = 2, seed: int = 42,
               stop: bool = True, strategy: str = "surrogate", ledger: Ledger | None = None,
               plan: str = "") -> list[dict]:
    """Runs trials in batches of ``parallelism``; ``score(params, rung)`` scores one rung of a trial.

    Each trial has params, scores (one for each rung it reached), status (Completed or Stopped) and
    objective, the mean of its scores.
    """
    known = ledger.known(plan) if ledger else {}
    trials: list[dict] = []
    while len(trials) < n_trials:
        scored = [(t["params"], t["objective"]) for t in trials]
        batch = propose(space, scored, min(parallelism, n_trials - len(trials)), seed,
                        FIRST if strategy == "surrogate" else n_trials)
        live = [{"params": p, "scores": [], "status": "Completed"} for p in batch]
        for rung in range(rungs):
            going = [t for t in live if t["status"] == "Completed"]
            missing = [t for t in going if (key_of(t["params"]), rung) not in known]
            if missing:
                with ThreadPool(len(missing)) as pool:
                    spark = SparkSession.getActiveSession()
                    run = lambda t, r=rung: score(t["params"], r)
                    found = pool.map(inheritable_thread_target(spark)(run) if spark else run, missing)
                new = [(plan, key_of(t["params"]), rung, json.dumps(t["params"]), float(s))
                       for t, s in zip(missing, found)]
                known.update({(r[1], r[2]): r[4] for r in new})
                if ledger:
                    ledger.add(new)
            for t in going:
                t["scores"].append(known[key_of(t["params"]), rung])
            reached = [sum(t["scores"][:rung + 1]) / (rung + 1) for t in (*trials, *live)
                       if len(t["scores"]) > rung]
            if stop and rung + 1 < rungs and len(reached) > LEAST:
                middle = median(reached)
                for t in going:
                    if sum(t["scores"]) / len(t["scores"]) < middle:
                        t["status"] = "Stopped"
        for t in live:
            t["objective"] = sum(t["scores"]) / len(t["scores"])
        trials += live
    return trials


def search(df: DataFrame, algorithm: str, space: dict, n_trials: int, folds: int, pre,
           target: str = TARGET, id_col: str = ID, evaluator=None, parallelism: int = 2,
           seed: int = 42, stop: bool = True, strategy: str = "surrogate", ledger: str | None = None,
           fixed: dict | None = None) -> tuple[dict, float, DataFrame]:
    """Best parameters, their mean fold score, and all trials with status and rungs reached.

    ``ledger`` names a folder all executors share; a search with the same plan over the same rows
    takes up what is there. Only completed trials can be the best.
    """
    spark = df.sparkSession
    evaluator = evaluator or auc()
    names = space.get("weightCol", [])
    folded = add_folds(df, target, folds, id_col=id_col)
    data = staged(weight_columns(prepared(pre, folded, target, keep=["fold"]), names), "search")
    plan = key_of([algorithm, space, folds, seed, strategy, fixed or {}, pre.feature_names, data.count(),
                   type(evaluator).__name__, stop])

    def score(params: dict, rung: int) -> float:
        model = make_model(algorithm, {**(fixed or {}), **params}).fit(data.where(f"fold <> {rung}"))
        return evaluator.evaluate(model.transform(data.where(f"fold = {rung}")))

    trials = run_trials(space, n_trials, folds, score, parallelism, seed, stop, strategy,
                        Ledger(spark, ledger) if ledger else None, plan)
    best = max((t for t in trials if t["status"] == "Completed"), key=lambda t: t["objective"])
    rows = [(f"trial-{i}", t["status"], ", ".join(f"{k}={v}" for k, v in t["params"].items()),
             float(t["objective"]) if t["status"] == "Completed" else None, len(t["scores"]))
            for i, t in enumerate(trials)]
    return best["params"], best["objective"], spark.createDataFrame(
        rows, "job string, status string, params string, objective double, rungs int")


def quick_tune(df: DataFrame, algorithm: str, pre, max_jobs: int = 5, folds: int = 3,
               target: str = TARGET, id_col: str = ID, space: dict | None = None,
               ledger: str | None = None) -> DataFrame:
    """Search with default ranges and the AUC objective, two trials at a time."""
    _, _, trials = search(df, algorithm, space or RANGES[algorithm], max_jobs, folds, pre, target,
                          id_col, parallelism=2, ledger=ledger)
    return tuning_summary(trials)
