"""The books' regimes are those of the walk-forward model: later rows change none of the earlier."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.plans import book, studies, t1, t3


@pytest.mark.parametrize(("query", "taker"), [(t3.QUERIES["core_book"], "run_book"), (t3.QUERIES["signal_sleeves"], "sleeves"), (studies.QUERIES["study_ensemble"], "sleeves"), (studies.QUERIES["study_forensics"], "sleeves"), (studies.QUERIES["study_synthesis"], "run_book")])
def test_book_regimes_are_causal(spark, monkeypatch, query, taker):
    class Stop(Exception):
        pass

    rng = np.random.default_rng(3)
    n, cut = 900, 790
    r = rng.standard_normal(n) * np.where(np.arange(n) // 60 % 2, 0.02, 0.005)
    r[cut:] *= 20  # later rows unlike all before
    day = dt.datetime(2000, 1, 1)
    rows = [("flag", day + dt.timedelta(days=k), float(v)) for k, v in enumerate(r)]
    seen = []

    def spy(rets, regimes, *rest, **more):
        seen.append(regimes)
        raise Stop

    monkeypatch.setattr(book, taker, spy)
    for m in (t1, t3, studies):
        monkeypatch.setattr(m, "_rets", lambda s, d: None)
    got = []
    for length in (cut, n):
        x = spark.createDataFrame(rows[:length], "u string, date timestamp, r double")
        for m in (t1, t3, studies):
            monkeypatch.setattr(m, "_mkt", lambda s, d, x=x: x)
        with pytest.raises(Stop):
            query(spark, None)
        g = {q["date"]: q["regime"] for q in seen[-1].where(F.col("date") < day + dt.timedelta(days=cut - 1)).collect()}
        assert len(g) == cut - 1 and set(g.values()) <= {0, 1, 2}
        got.append(g)
    assert got[0] == got[1]
    assert all(v == 1 for k, v in got[0].items() if k < day + dt.timedelta(days=700))
