"""Registered queries run the whole job of their operator: the parameters they hand over are caught before any work."""

import pytest

from sparktab.operators import diagnostics, estimators, tuning
from sparktab.plans import catalog
from sparktab.plans.oracles import ORACLES


class Caught(Exception):
    pass


@pytest.fixture
def catch(monkeypatch):
    """Calls a query with one helper replaced and returns what the helper was given."""

    def run(query, owner, helper):
        def caught(*args, **named):
            raise Caught(args, named)

        monkeypatch.setattr(owner, helper, caught)
        monkeypatch.setattr(catalog.fx, "clf_base", lambda *_: None)
        with pytest.raises(Caught) as found:
            catalog.QUERIES[query](None, "")
        return found.value.args

    return run


@pytest.mark.parametrize("query", ["fit_logistic", "fit_gbt", "fit_adaboost", "fit_mlp"])
def test_fits_have_the_default_work(catch, query):
    (_, _, algorithm, params), _ = catch(query, catalog, "_measured")
    assert estimators.resolve_parameters(algorithm, params) == estimators.DEFAULTS[algorithm]


def test_seeds_have_the_default_forest(catch):
    (_, target, seeds, params, _), _ = catch("seed_stability", diagnostics, "seed_scores")
    assert seeds == list(range(10))
    assert estimators.resolve_parameters("random_forest", params) == estimators.DEFAULTS["random_forest"]


def test_sequential_search_leaves_its_random_start(catch):
    _, given = catch("tune_sequential", catalog, "_tuned")
    request = catalog.workflows.TuneRequest("lines", **given)
    assert request.n_trials == 20 > tuning.SequentialProposer.STARTUP
    ranges = tuning.RANGE_SPACES["logistic_regression"]
    assert {n: s for n, s in ranges.items() if n != "solver"} == given["search_space"]
    scores = iter(range(request.n_trials))
    densities = []

    class Told(tuning.SequentialProposer):
        def _density(self, s, seen, v):
            densities.append(len(self.trials))
            return super()._density(s, seen, v)

    proposer = Told(given["search_space"])
    for score in scores:
        proposer.tell(proposer.ask(), score)
    assert set(densities) == set(range(10, 20))


def test_the_grid_of_the_analysis_is_whole(catch):
    (_, _, sizes, depths, *_), _ = catch("bias_variance", diagnostics, "bias_variance")
    assert sizes == [50, 200, 500] and depths == [None, 5, 10]
    assert "(50), (200), (500)" in ORACLES["bias_variance"]
