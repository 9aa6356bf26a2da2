"""No worker encodes unverified: without the library the operator does not load."""

import subprocess
import sys
from pathlib import Path


def test_missing_library_is_not_swallowed():
    code = "import sys; sys.modules['sentencepiece'] = None; import quantloom.llm.pieces"
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    assert got.returncode != 0 and "sentencepiece" in got.stderr
