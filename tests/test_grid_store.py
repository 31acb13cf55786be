"""Grid search: true figures per fold, and a search that goes on where it was killed."""

import pytest

from cellpulse.operators import model
from cellpulse.session import scratch_path

GRID = {"numTrees": [2], "maxDepth": [2, 3]}


@pytest.fixture(scope="module")
def ready(spark):
    rows = [(i % 3, i % 2, i % 2 if i % 10 else 1 - i % 2) for i in range(90)]
    return model.assembled(spark.createDataFrame(rows, "fold int, v_idx int, label int"), ["v"], [], {"v": 2})


def test_figures_are_those_of_the_confusion_matrix(spark, ready):
    for r in model.forest_grid_cv(ready, GRID, folds=3):
        scored = model.score(r.model, ready.where(f"fold = {r.fold}"), ["label"])
        one = model.binary_metrics(model.confusion(scored, classes=[0, 1])).first()
        assert (r.accuracy, r.precision, r.recall) == (one.accuracy, one.precision_1, one.recall_1)
        assert r.f_measure == pytest.approx(one.f1_1, abs=1e-15)
        assert r.accuracy < 1 and r.n_valid == 30 and r.n_train == 60


def test_a_constant_model_shows(spark):
    r = model.FoldResult({}, 0, None, 10, [(0, 0, 8), (1, 0, 2)])
    assert (r.accuracy, r.precision, r.recall, r.f_measure) == (0.8, None, 0.0, None)


def test_constant_forest_turns_the_keys_red(spark, monkeypatch):
    import oracle_compare
    from conftest import SF_SMALL
    real = model.fit_forest
    monkeypatch.setattr(model, "fit_forest", lambda rows, label="label", **p: real(
        rows.selectExpr("features", f"cast(0 as double) as {label}").unionByName(
            rows.limit(1).selectExpr("features", f"cast(1 as double) as {label}")), label, numTrees=3, maxDepth=0))
    for key in ("rf_fit_predict", "rf_grid_cv", "predict_target"):
        assert not oracle_compare.compare(spark, key, SF_SMALL).get("values_match"), key


def test_a_killed_search_fits_only_the_rest(spark, ready, monkeypatch):
    store, fits, real = scratch_path(spark, "t-grid"), [], model.fit_forest

    def counted(*args, **params):
        if len(fits) == 2:
            raise KeyboardInterrupt("killed")
        fits.append(params)
        return real(*args, **params)

    monkeypatch.setattr(model, "fit_forest", counted)
    with pytest.raises(KeyboardInterrupt):
        model.forest_grid_cv(ready, GRID, folds=3, parallelism=1, store=store)
    done = list(fits)
    monkeypatch.setattr(model, "fit_forest", lambda *a, **p: fits.append(p) or real(*a, **p))
    found = model.forest_grid_cv(ready, GRID, folds=3, parallelism=1, store=store)
    assert len(done) == 2 and len(fits) == 6
    again = model.forest_grid_cv(ready.repartition(5), GRID, folds=3, store=store)
    assert len(fits) == 6 and [r.counts for r in again] == [r.counts for r in found]
    monkeypatch.undo()
    fresh = model.forest_grid_cv(ready, GRID, folds=3)
    assert [(r.point, r.fold, r.counts, r.n_train) for r in found] == [(r.point, r.fold, r.counts, r.n_train) for r in fresh]
    assert [r.model.toDebugString.split("\n", 1)[1] for r in found] == [r.model.toDebugString.split("\n", 1)[1] for r in fresh]


def test_other_data_or_settings_share_nothing(spark, ready, monkeypatch):
    store, fits, real = scratch_path(spark, "t-grid"), [], model.fit_forest
    monkeypatch.setattr(model, "fit_forest", lambda *a, **p: fits.append(p) or real(*a, **p))
    one = {"numTrees": [2], "maxDepth": [2]}
    model.forest_grid_cv(ready, one, folds=3, store=store)
    model.forest_grid_cv(ready, one, folds=3, store=store)
    assert len(fits) == 3
    model.forest_grid_cv(ready, one, folds=3, store=store, seed=2)
    model.forest_grid_cv(ready.unionByName(ready.limit(1)), one, folds=3, store=store)
    assert len(fits) == 9
