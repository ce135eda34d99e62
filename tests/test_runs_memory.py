"""Runs of a batch of long texts: some of them are Python's at a time."""

import tracemalloc

import pyarrow as pa

from quillspark.functions import texscan


def test_runs_are_python_s_in_parts():
    text = "prose $x_1$ more prose of a line " * 600
    texts = pa.array([text] * 600 + [None, ""])
    typed = pa.array([False] * 601 + [True])
    tracemalloc.start()
    out = texscan._runs_of(texts, typed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(text) * 600  # as dicts and texts of the whole batch it is several times that
    assert out[0].as_py() == texscan.runs_of(text, False) and out[599].as_py() == out[0].as_py()
    assert out[600].as_py() is None and out[601].as_py() == [] and len(out) == 602
