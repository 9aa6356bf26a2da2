"""The classifier is trained whole: 20,000 features and rows, 400 rounds."""

import inspect

from quantloom.llm import toxicity


def test_training_is_whole():
    p = inspect.signature(toxicity.train).parameters
    assert (p["features"].default, p["max_rows"].default, p["rounds"].default) == (20_000, 20_000, 400)
