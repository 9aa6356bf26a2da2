"""All registered queries of the engine and the SQL of those that SQL can express."""

from __future__ import annotations

from . import studies, t1, t1b, t3, t4, t5

QUERIES = {**t1.QUERIES, **t1b.QUERIES, **t3.QUERIES, **t4.QUERIES, **studies.QUERIES}
ORACLE = {**t1.ORACLE, **t5.oracle()}
