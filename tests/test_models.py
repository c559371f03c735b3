from quartzfold.operators import experiment, models
from quartzfold.plans import queries


def test_registered_models_are_those_of_the_grids(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "_outer", lambda s, d, kind, params: asked.append((kind, params)))
    monkeypatch.setattr(queries.pipeline, "supervised_search", lambda f, grid, kind, columns: asked.append((kind, len(grid))))
    monkeypatch.setattr(queries, "rounded", lambda m, *a, **k: m)
    queries.QUERIES["rf_outer_eval"](spark, "")
    queries.QUERIES["gbt_outer_eval"](spark, "")
    for kind, params in asked:
        values = experiment.FOREST_GRID if kind == "forest" else experiment.BOOST_GRID
        assert set(params) == set(values) and all(params[k] in values[k] for k in values)
    forest, boost = (models.build(kind, params) for kind, params in asked)
    assert forest.getNumTrees() >= 100 and forest.getMaxDepth() == 30 and boost.getMaxIter() >= 100
    asked.clear()
    queries.rf_search(spark, "/root/testdata/sf0.001")
    queries.gbt_search(spark, "/root/testdata/sf0.001")
    assert asked == [("forest", 162), ("boost", 81)]
