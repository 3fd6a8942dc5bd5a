import numpy as np
import pytest

from holdfast.plans import search as se

SPACE = {"x": ("float", -5.0, 10.0), "y": ("log", 1e-3, 10.0), "k": ("int", 1, 12),
         "kind": ["a", "b", "c", "d"]}


def bowl(p, rung=0):
    """Highest at x = 3, y = 0.1, k = 7, kind = c."""
    return -((p["x"] - 3) / 5) ** 2 - (np.log10(p["y"]) + 1) ** 2 - ((p["k"] - 7) / 5) ** 2 - (
        0.0 if p["kind"] == "c" else 0.5) + 0.01 * rung


def test_surrogate_beats_random_draws():
    best = {"surrogate": [], "random": []}
    for strategy, found in best.items():
        for seed in range(20):
            trials = se.run_trials(SPACE, 40, 1, bowl, 4, seed, strategy=strategy)
            found.append(max(t["objective"] for t in trials))
    wins = np.mean(np.array(best["surrogate"]) > np.array(best["random"]))
    assert np.mean(best["surrogate"]) > np.mean(best["random"]) + 0.05 and wins >= 0.7


def test_seeded_reruns_agree():
    a, b = (se.run_trials(SPACE, 17, 2, bowl, 3, seed=5) for _ in range(2))
    assert a == b
    assert all(-5 <= t["params"]["x"] <= 10 and 1e-3 <= t["params"]["y"] <= 10
               and 1 <= t["params"]["k"] <= 12 and isinstance(t["params"]["k"], int) for t in a)


@pytest.mark.parametrize("spec", list(SPACE.values()))
def test_units_and_back(spec):
    rng = np.random.default_rng(1)
    for _ in range(50):
        v = se.from_unit(spec, float(rng.integers(4)) if isinstance(spec, list) else rng.random())
        again = se.from_unit(spec, se.to_unit(spec, v))
        assert again == (pytest.approx(v) if isinstance(v, float) else v) or spec[0] == "int"


def test_densities_sum_to_one():
    d = se.Density(("float", 0.0, 1.0), [0.1, 0.12, 0.9])
    grid = (np.arange(4000) + 0.5) / 4000
    assert np.mean([np.exp(d.log(u)) for u in grid]) == pytest.approx(1, abs=1e-3)
    kinds = se.Density(["a", "b", "c"], [1.0, 1.0])
    assert sum(np.exp(kinds.log(float(i))) for i in range(3)) == pytest.approx(1)


def test_poor_trials_stop_and_the_best_stays():
    whole = se.run_trials(SPACE, 16, 4, bowl, 4, seed=3, stop=False, strategy="random")
    cut = se.run_trials(SPACE, 16, 4, bowl, 4, seed=3, strategy="random")
    assert [t["params"] for t in whole] == [t["params"] for t in cut]
    stopped = [t for t in cut if t["status"] == "Stopped"]
    assert stopped and all(len(t["scores"]) < 4 for t in stopped)
    best = [max((t for t in ts if t["status"] == "Completed"), key=lambda t: t["objective"])["params"]
            for ts in (whole, cut)]
    assert best[0] == best[1]


def test_broken_off_search_is_taken_up(spark, tmp_path):
    ledger = se.Ledger(spark, f"{tmp_path}/ledger")
    calls = []

    def counted(p, rung, limit=None):
        if limit is not None and len(calls) >= limit:
            raise RuntimeError("lost")
        calls.append((se.key_of(p), rung))
        return bowl(p, rung)

    want = se.run_trials(SPACE, 8, 2, bowl, 2, seed=9)
    with pytest.raises(RuntimeError):
        se.run_trials(SPACE, 8, 2, lambda p, r: counted(p, r, 9), 2, seed=9, ledger=ledger, plan="p")
    kept = len(ledger.known("p"))
    calls.clear()
    got = se.run_trials(SPACE, 8, 2, counted, 2, seed=9, ledger=ledger, plan="p")
    assert got == want and kept >= 8
    assert len(calls) == sum(len(t["scores"]) for t in want) - kept
    assert len(calls) == len(set(calls))
    calls.clear()
    assert se.run_trials(SPACE, 8, 2, counted, 2, seed=9, ledger=ledger, plan="p") == want and not calls
    se.run_trials(SPACE, 2, 1, counted, 2, seed=9, ledger=ledger, plan="other")
    assert len(calls) == 2


def test_search_over_rows(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler

    class Pre:
        feature_names = ["a", "b"]

        def transform(self, df):
            return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)

    rng = np.random.default_rng(4)
    rows = [(f"r{i}", float(a), float(b), int(a + b > 1)) for i, (a, b) in enumerate(rng.random((200, 2)))]
    df = spark.createDataFrame(rows, ["CustomerID", "a", "b", "Churn"])
    space = {"maxDepth": ("int", 1, 6), "minInstancesPerNode": ("int", 1, 10)}
    run = lambda: se.search(df, "decision_tree", space, 4, 2, Pre(), ledger=f"{tmp_path}/l")
    best, score, trials = run()
    assert score > 0.7 and 1 <= best["maxDepth"] <= 6
    assert trials.count() == 4
    before = spark.read.parquet(f"{tmp_path}/l").count()
    assert run()[:2] == (best, score) and spark.read.parquet(f"{tmp_path}/l").count() == before
    summary = se.tuning_summary(trials).first()
    assert summary["total_jobs"] == 4 and summary["best_objective"] == pytest.approx(score)
