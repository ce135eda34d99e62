"""Single passes over TeX sources for what patterns can't count: delimiters by parity, and nested braces.

Each pass reads a text once, however it is made, and runs in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIGN = re.compile(r"(?<!\\)\\*+\$|\\[\[\]()]|\n")
_CLOSES = {r"\[": r"\]", r"\(": r"\)"}
_WORD = re.compile(r"[A-Za-z]{2,}")


class _Signs:
    """The delimiters of a text in order, and for each the next one that could close it."""

    def __init__(self, text: str) -> None:
        self.kind: list[str] = []  # $, a bracket with its backslash, or a line end; an escaped dollar is "\\$"
        self.at: list[int] = []
        for m in _SIGN.finditer(text):
            sign = m[0]
            if sign[-1] == "$":
                sign = "$" if len(sign) % 2 else r"\$"
            self.kind.append(sign)
            self.at.append(m.end() - len(sign))
        self.closer: list[int | None] = [None] * len(self.kind)
        ahead: dict[str, int | None] = {}
        for i in range(len(self.kind) - 1, -1, -1):
            k = self.kind[i]
            self.closer[i] = ahead.get(_CLOSES.get(k, k))
            if k == "\n":
                ahead["$"] = None  # dollars don't reach over a line end
            else:
                ahead[k] = i


def runs_of(text: str, typed: bool) -> list[dict[str, str]]:
    """Prose and mathematics of a text in order."""
    signs = _Signs(text)
    out: list[dict[str, str]] = []
    told, i = 0, 0  # told: what has been given out so far
    while i < len(signs.kind):
        kind, at, j = signs.kind[i], signs.at[i], signs.closer[i]
        i += 1
        if j is None or kind in (r"\]", r"\)", r"\$", "\n") or (kind == "$" and typed):
            continue
        begin, end = at + len(kind), signs.at[j]
        if kind == "$":
            inner = text[begin:end].strip()
            if inner and (r"\[" in inner or r"\(" in inner or (inner[0].isdecimal() and len(_WORD.findall(inner)) > 1)):
                continue
        else:  # brackets hold plain formulas only: no command, no dollar
            if text.find("\\", begin, end) >= 0 or text.find("$", begin, end) >= 0:
                continue
            inner = text[begin:end].strip()
        i = j + 1
        if inner:
            if at > told:
                out.append({"kind": "prose", "text": text[told:at]})
            out.append({"kind": "math", "text": inner})
            told = end + len(kind)
    if told < len(text):
        out.append({"kind": "prose", "text": text[told:]})
    return out


def arguments_of(text: str, command: re.Pattern) -> list[str]:
    """What stands in balanced braces behind each command, in the order of the commands, nested ones too."""
    opens = {m.end() for m in command.finditer(text)}
    if not opens:
        return []
    found, depth = [], []
    for m in re.finditer(r"\\.|[{}]", text, re.DOTALL):
        if m[0] == "{":
            depth.append(m.end())
        elif m[0] == "}" and depth:
            begin = depth.pop()
            if begin in opens:
                found.append((begin, m.start()))
    return [text[a:b] for a, b in sorted(found)]


RUNS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


#: Characters of runs that are Python's at a time.
PART = 1_000_000


def _runs_of(texts: pa.Array, typed: pa.Array) -> pa.Array:
    """Runs of a batch's texts, read one by one; only some of them are Python's own, the rest is Arrow's memory."""
    ends, null, kinds, found, parts, size = [0], [], [], [], [], 0
    kind = pa.struct([("kind", pa.string()), ("text", pa.string())])

    def close() -> None:
        nonlocal size
        parts.append(pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(found, pa.string())], fields=list(kind)))
        kinds.clear(), found.clear()
        size = 0

    for text, k in zip(texts, typed, strict=True):
        own = runs_of(t, bool(k.as_py())) if (t := text.as_py()) is not None else []
        for r in own:
            kinds.append(r["kind"])
            found.append(r["text"])
            size += len(r["text"]) + 32
        null.append(t is None)
        ends.append(ends[-1] + len(own))
        if size > PART:
            close()
    close()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts), type=pa.list_(kind), mask=pa.array(null, pa.bool_()))


_runs = F.arrow_udf(_runs_of, RUNS)


def runs(text: Column, typed: Column) -> Column:
    return _runs(text, F.coalesce(typed, F.lit(False)))


def arguments(text: Column, command: str) -> Column:
    form = re.compile(rf"(?:{command})\s*\{{")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([arguments_of(t, form) if isinstance(t, str) else None for t in texts], dtype=object)

    return read(text)
