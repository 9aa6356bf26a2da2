"""Registered walk-forward queries refit and rebalance every 21 rows, as the reference does."""

import inspect

import pytest

from quantloom.operators import models
from quantloom.plans import book, studies, t3


@pytest.mark.parametrize(
    ("name", "query"),
    [
        ("regimes", "hmm_regimes"), ("regimes", "thmm_regimes"), ("regimes", "dhmm_regimes"), ("jump_regimes", "jump_regimes"), ("horserace", "regime_horserace"),
        ("variance_forecasts", "variance_forecasts"), ("estimator_bakeoff", "minvar_bakeoff"), ("rebalance_windows", "hrp_weights"),
        ("rebalance_windows", "black_litterman"), ("rebalance_windows", "rmt_denoise"), ("rebalance_windows", "min_cvar"), ("rebalance_windows", "ou_sscores"), ("rebalance_windows", "study_cvar"),
    ],
)
def test_strides(monkeypatch, name, query):
    class Stop(Exception):
        pass

    seen, real = [], inspect.signature(getattr(models, name))

    def spy(*a, **k):
        b = real.bind(*a, **k)
        b.apply_defaults()
        seen.append(b.arguments["every"])
        raise Stop

    monkeypatch.setattr(models, name, spy)
    for m in (t3, studies):
        for f in ("_feats", "_rets", "_gr"):
            monkeypatch.setattr(m, f, lambda s, d: None, raising=False)
    with pytest.raises(Stop):
        (t3.QUERIES | studies.QUERIES)[query](None, None)
    assert seen == [21]


def test_books_rebalance_every_21_rows():
    assert t3._CFG.every == studies.CFG.every == book.BookConfig().every == 21
