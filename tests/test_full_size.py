"""Registered queries run the whole job: sizes as in the reference."""

import inspect

import pytest

from quantloom.kernels import worlds
from quantloom.operators import models, resample
from quantloom.plans import studies, t3


def calls(monkeypatch, module, name, query):
    """Arguments, defaults included, with which ``query`` calls a function of ``module``; the call itself goes no further."""

    class Stop(Exception):
        pass

    seen, real = [], inspect.signature(getattr(module, name))

    def spy(*a, **k):
        b = real.bind(*a, **k)
        b.apply_defaults()
        seen.append(b.arguments)
        raise Stop

    monkeypatch.setattr(module, name, spy)
    with pytest.raises(Stop):
        query()
    return seen[0]


@pytest.mark.parametrize("query", [studies.QUERIES["study_decathlon"], studies.QUERIES["study_decathlon2"], studies.QUERIES["study_score_se"], t3.QUERIES["agent_battery"]])
def test_agent_batteries_are_whole(monkeypatch, query):
    a = calls(monkeypatch, models, "agent_batteries", lambda: query(None, None))
    assert (a["seeds"], a["rows"], a["draws"]) == (8, 6000, 120)
    if query is t3.QUERIES["agent_battery"]:
        assert set(a["configs"] or worlds.CONFIGS) == set(worlds.CONFIGS)


@pytest.mark.parametrize("name", ["study_decathlon3", "study_decathlon4"])
def test_pairs_are_whole(monkeypatch, name):
    a = calls(monkeypatch, models, "grid", lambda: studies.QUERIES[name](None, None))
    assert [seed for _, seed in a["rows"]] == list(range(100, 132))
    p = inspect.signature(studies._paired).parameters
    assert p["rows"].default == 6000 and p["draws"].default == 120


def test_tails_are_whole(monkeypatch):
    a = calls(monkeypatch, models, "grid", lambda: studies.QUERIES["study_tails"](None, None))
    assert len({c[2] for c in a["rows"]}) == 8 and {c[4] for c in a["rows"]} == {2, 3, 4, 5}
    assert inspect.signature(studies.khallucination).parameters["rows"].default == 3000
    assert "iters=120" in (fit := inspect.getsource(studies.khallucination)) and "restarts=2" in fit


@pytest.mark.parametrize(("name", "draws"), [("permutation_mi", 200), ("harvest_gap", 300)])
def test_resampling_is_whole(monkeypatch, name, draws):
    monkeypatch.setattr(t3, "_coded", lambda s, d: None)
    assert calls(monkeypatch, resample, name, lambda: t3.QUERIES[name](None, None))["draws"] == draws
