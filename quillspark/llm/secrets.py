"""Secret scan with one combined deterministic automaton (operator 2).

Every rule is a small regular expression over ASCII bytes.  All rules are parsed
into one NFA with a self-looping start, determinised by subset construction and
minimised by partition refinement; what is left is a transition array
``next[state, byte]`` and a bit mask ``accepts[state]``.  A batch of documents is
one byte buffer that is walked once, many lanes side by side: lanes are cut behind
bytes that bring every state back to the start, so each lane may begin there.

The walk yields the places where some rule first completes.  From these, per rule,
a reversed automaton finds the leftmost start and the rule's own automaton the
longest end, which gives the leftmost, non-overlapping matches.  A private key is found by its
BEGIN line and reaches to its END line; without one, over the lines of its alphabet below.

Defined results: null or empty text has no spans; every row of the input gives one
row (repeated ids too, a null id stays null); a very long text is scanned whole, in a batch of its own;
an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_text
from .tokens import slices

# The base rules of the contract; (kind, expression, any case, group, least length).
# "group" is the index of the part in "<...>" whose length counts, or 0 for the whole match.
BASE_RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", True, "tail", 6),
    ("access", r"AKIA[A-Z0-9]+", "", False, "all", 20),
    ("hex", r"[0-9a-f]+", "", False, "all", 24),
]
# Further rules: well-known public token shapes.  The combined automaton finds their heads, which are
# short, so its states stay few; GO_ON is how a match goes on from there.
MORE_RULES = [
    ("github", r"gh(p|o|u|s|r)_", "", False, "all", 40),
    ("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", "", False, "all", 0),
    ("github_pat", r"github_pat_", "", False, "all", 40),
    ("slack", r"xox(a|b|p|o|r|s)-", "", False, "all", 20),
    ("google", r"AIza", "", False, "all", 39),
    ("stripe", r"(s|r)k_(live|test)_", "", False, "all", 24),
    ("jwt", r"eyJ", "", False, "all", 0),
]
_KEY_LINE = r"\x0d?\x0a" + "[A-Za-z0-9+/=]" * 16 + "[A-Za-z0-9+/=]*"
GO_ON = {
    "github": r"[A-Za-z0-9]+",
    # A key's body up to its END line, or else whole lines of its alphabet.
    "pem": r"(([\x00-\x2c\x2e-\xff]|-[\x00-\x2c\x2e-\xff])*-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----|(" + _KEY_LINE + r")*)",
    "github_pat": r"[A-Za-z0-9_]+",
    "slack": r"[A-Za-z0-9-]+",
    "google": r"[A-Za-z0-9_-]+",
    "stripe": r"[A-Za-z0-9]+",
    "jwt": r"[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
}
KINDS = [r[0] for r in BASE_RULES + MORE_RULES]
BASE = 3

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:BASE]]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]
)


# --- rules to automata -------------------------------------------------------------------


class Nfa:
    """Thompson construction; moves[s] is a list of (byte set, target), None for an empty move."""

    def __init__(self) -> None:
        self.moves: list[list] = []

    def state(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1

    def parse(self, rule: str, fold: bool) -> tuple[int, int]:
        first, last, at = self._either(rule, 0, fold)
        if at != len(rule):
            raise ValueError(f"rule not understood at {at}: {rule}")
        return first, last

    def _either(self, r, i, fold):
        parts, (a, b, i) = [], self._chain(r, i, fold)
        parts.append((a, b))
        while i < len(r) and r[i] == "|":
            a, b, i = self._chain(r, i + 1, fold)
            parts.append((a, b))
        if len(parts) == 1:
            return *parts[0], i
        first, last = self.state(), self.state()
        for a, b in parts:
            self.moves[first].append((None, a))
            self.moves[b].append((None, last))
        return first, last, i

    def _chain(self, r, i, fold):
        first = last = self.state()
        while i < len(r) and r[i] not in "|)":
            a, b, i = self._piece(r, i, fold)
            self.moves[last].append((None, a))
            last = b
        return first, last, i

    def _piece(self, r, i, fold):
        if r[i] == "(":
            a, b, i = self._either(r, i + 1, fold)
            i += 1
        else:
            chars, i = self._chars(r, i)
            if fold:
                chars |= {ord(c) for x in chars for c in (chr(x).lower(), chr(x).upper()) if x < 128}
            a, b = self.state(), self.state()
            self.moves[a].append((frozenset(chars), b))
        if i < len(r) and r[i] in "*+?":
            first, last = self.state(), self.state()
            self.moves[first].append((None, a))
            self.moves[b].append((None, last))
            if r[i] != "+":
                self.moves[first].append((None, last))
            if r[i] != "?":
                self.moves[b].append((None, a))
            a, b, i = first, last, i + 1
        return a, b, i

    def _chars(self, r, i):
        if r[i] != "[":
            c, i = self._one(r, i)
            return {c}, i
        out, i = set(), i + 1
        while r[i] != "]":
            c, i = self._one(r, i)
            if r[i] == "-" and r[i + 1] != "]":
                d, i = self._one(r, i + 1)
                out |= set(range(c, d + 1))
            else:
                out.add(c)
        return out, i + 1

    @staticmethod
    def _one(r, i):
        if r[i] == "\\":
            return (int(r[i + 2 : i + 4], 16), i + 4) if r[i + 1] == "x" else (ord(r[i + 1]), i + 2)
        return ord(r[i]), i + 1

    def reversed(self) -> Nfa:
        back = Nfa()
        back.moves = [[] for _ in self.moves]
        for s, moves in enumerate(self.moves):
            for chars, t in moves:
                back.moves[t].append((chars, s))
        return back

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for chars, t in self.moves[todo.pop()]:
                if chars is None and t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def determinise(nfa: Nfa, starts, finals: dict[int, int], search: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction. finals: state to bit mask; search: the start set is added at each byte."""
    begin = nfa.closure(starts)
    ids, rows, masks, todo = {begin: 0}, [], [], [begin]
    alike: dict[tuple, list[int]] = {}  # bytes that no rule tells apart are tried once
    sets = list({chars for moves in nfa.moves for chars, _ in moves if chars})
    for c in range(256):
        alike.setdefault(tuple(c in chars for chars in sets), []).append(c)
    groups = [(g[0], g) for g in alike.values()]
    while todo:
        now = todo.pop(0)
        masks.append(sum(1 << k for k in range(63) if any(finals.get(s, 0) >> k & 1 for s in now)))
        row, moves = [0] * 256, [m for s in now for m in nfa.moves[s] if m[0]]
        for c, group in groups:
            key = {t for chars, t in moves if c in chars}
            to = nfa.closure(key | begin if search else key)
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            for x in group:
                row[x] = ids[to]
        rows.append(row)
    return np.array(rows, dtype=np.int32), np.array(masks, dtype=np.int64)


def minimise(table: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement; state 0 stays the start."""
    block = np.unique(masks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = {b: k for k, b in enumerate(dict.fromkeys(block.tolist()))}
    new = np.array([order[b] for b in block.tolist()])
    _, pick = np.unique(new, return_index=True)
    return new[table[pick]].astype(np.int32), masks[pick]


@lru_cache(maxsize=1)
def automata():
    """The combined search automaton, and for each rule its own and its reversed one."""
    rules = BASE_RULES + MORE_RULES
    nfa, starts, finals, single = Nfa(), [], {}, []
    for k, (_, head, tail, fold, _, least) in enumerate(rules):
        a, b = nfa.parse(head, fold)
        if tail:
            c, d = nfa.parse(tail, False)
            nfa.moves[b].append((None, c))
        else:
            d = b
        # A single class of characters repeated has its least length from the start.
        starts.append(a)
        finals[d] = finals.get(d, 0) | 1 << k
        single.append((a, d))
    table, masks = minimise(*determinise(nfa, _with_counts(nfa, rules, starts, finals, single), finals, True))
    back = nfa.reversed()
    whole = []
    for (a, d), rule in zip(single, rules, strict=True):
        more = Nfa()
        more.moves = [list(m) for m in nfa.moves]
        last = d
        if rule[0] in GO_ON:
            c, last = more.parse(GO_ON[rule[0]], False)
            more.moves[d].append((None, c))
        whole.append((more, a, last))
    own = [minimise(*determinise(n, [a], {d: 1}, False)) for n, a, d in whole]
    rev = [minimise(*determinise(back, [d], {a: 1}, False)) for a, d in single]
    home = (table == 0).all(axis=0)
    return table, masks, home, own, rev


def _with_counts(nfa, rules, starts, finals, single):
    """For a rule that is one repeated class, write the least length out as a chain of states,
    so that ordinary words do not count as matches.  Runs are maximal, so the longest match
    of the chain is the run itself and shorter runs would be dropped anyway."""
    for k, (kind, head, _, _, _, least) in enumerate(rules):
        if kind == "hex":
            chars, _ = nfa._chars(head, 0)
            finals.pop(single[k][1], None)
            first = at = nfa.state()
            for _ in range(least):
                to = nfa.state()
                nfa.moves[at].append((frozenset(chars), to))
                at = to
            nfa.moves[at].append((frozenset(chars), at))
            finals[at] = 1 << k
            starts[k], single[k] = first, (first, at)
    return starts


# --- the byte pass -----------------------------------------------------------------------

LANES = 4096


def events(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end offset, rule mask) wherever the combined automaton accepts, in order."""
    table, masks, home, _, _ = automata()
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    safe = np.flatnonzero(home[buf]) + 1
    step = max(256, n // LANES)
    want = np.arange(step, n, step)
    at = np.searchsorted(safe, want)
    cuts = np.unique(np.concatenate([[0], safe[at[at < len(safe)]], [n]]))
    first, length = cuts[:-1], np.diff(cuts)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    flat, hot = table.ravel(), masks != 0
    state = np.zeros(len(first), dtype=np.int32)
    live = np.searchsorted(-length, -np.arange(length[0]), side="left")  # lanes longer than i
    ends, kinds = [], []
    for i in range(int(length[0])):
        m = live[i]
        s = flat[(state[:m] << 8) + buf[first[:m] + i]]
        state[:m] = s
        h = np.flatnonzero(hot[s])
        if len(h):
            ends.append(first[h] + i + 1)
            kinds.append(masks[s[h]])
    if not ends:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    e, k = np.concatenate(ends), np.concatenate(kinds)
    o = np.argsort(e, kind="stable")
    return e[o], k[o]


def _leftmost(rev, data: bytes, end: int, low: int) -> int:
    """Smallest start in low..end from which data[start:end] is a match, or -1."""
    table, masks = rev
    s, best, i = 0, -1, end
    dead = _dead(table, masks)
    while i > low:
        i -= 1
        s = table[s, data[i]]
        if masks[s]:
            best = i
        if dead[s]:
            break
    return best


def _longest(own, data: bytes, start: int, high: int) -> tuple[int, int]:
    """(end of the longest match from ``start`` or -1, where no further byte could help)."""
    table, masks = own
    s, best, i = 0, -1, start
    dead = _dead(table, masks)
    while i < high:
        s = table[s, data[i]]
        i += 1
        if masks[s]:
            best = i
        if dead[s]:
            return best, i - 1
    return best, i


_DEAD: dict[int, np.ndarray] = {}


def _dead(table, masks) -> np.ndarray:
    if id(table) not in _DEAD:
        _DEAD[id(table)] = (table == np.arange(len(table))[:, None]).all(axis=1) & (masks == 0)
    return _DEAD[id(table)]


_VALUE = frozenset(map(ord, string.ascii_letters + string.digits + "+/_.=-"))


def _tail_length(data: bytes, start: int, end: int) -> int:
    """Characters of the value: what follows the first separator, its blanks and its quote."""
    i = start
    while data[i] not in b":=":
        i += 1
    i += 1
    while data[i] == 0x20:
        i += 1
    if data[i] in b"\"'":
        i += 1
    return end - i


def scan(texts: list[str], chars: int = 6_000_000) -> list[list[tuple[int, int, int]]]:
    """(start, end, rule) in code points for every text, sorted by start, then rule."""
    return [found for a, b in slices(texts, chars) for found in _scan(texts[a:b])]


def _scan(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    docs = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(docs) + b"\n"  # a new line brings every state home
    buf = np.frombuffer(data, dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])]).astype(np.int64)
    ends, masks = events(buf)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(ends):
        return out
    _, _, _, own, rev = automata()
    rules = BASE_RULES + MORE_RULES
    which = np.searchsorted(begin, ends, side="left") - 1
    for k, (_, _, _, _, part, least) in enumerate(rules):
        done = 0
        for e, d in zip(ends[(masks >> k) & 1 == 1].tolist(), which[(masks >> k) & 1 == 1].tolist(), strict=True):
            low, high = max(done, int(begin[d])), int(begin[d + 1]) - 1
            if e <= low or e > high:
                continue
            start = _leftmost(rev[k], data, e, low)
            if start < 0:
                continue
            stop, reached = _longest(own[k], data, start, high)
            if stop < 0:
                done = reached  # a later head before this place fails at it as well
                continue
            done = stop
            if (_tail_length(data, start, stop) if part == "tail" else stop - start) >= least:
                out[d].append((start - int(begin[d]), stop - int(begin[d]), k))
    for d, found in enumerate(out):
        if found:
            raw = docs[d]
            if not raw.isascii():
                found = [(len(raw[:a].decode("utf-8", "surrogatepass")), len(raw[:b].decode("utf-8", "surrogatepass")), k) for a, b, k in found]
            out[d] = sorted(found, key=lambda x: (x[0], x[2]))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _batches(frames):
    for f in frames:
        found = scan([as_text(t) for t in f["text"]])
        base = [[x for x in s if x[2] < BASE] for s in found]
        yield pd.DataFrame(
            {"doc_id": f["doc_id"].astype("Int64")}
            | {f"n_{KINDS[k]}": [sum(x[2] == k for x in s) for s in base] for k in range(BASE)}
            | {"base_sha256": [hashlib.sha256(_joined(s).encode()).hexdigest() for s in base], "spans": [_joined(s) for s in found], "n_spans": [len(s) for s in found]}
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with the counts, the digest and the list of its spans."""
    return docs.select("doc_id", "text").mapInPandas(_batches, SCHEMA)


def redact_text(text: str, spans) -> str:
    """``text`` with the union of the spans written as [SECRET]."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns, with the secrets in ``column`` replaced; null stays null.

    ``n_chars``, where it exists, is the length of the new text.
    """
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        found = scan([as_text(t) for t in texts])
        return pd.Series([redact_text(t, s) if s else t for t, s in zip(texts, found, strict=True)], dtype=object)

    out = docs.withColumn(column, clean(docs[column]))
    if column == "text" and "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
