"""Chat formatting with minimum-cost role repair (operator 10).

Legal conversations are an optional system turn, then user and assistant in turn, ending
with the assistant.  Dynamic programming over that automaton decides for every source turn
its role and whether it opens a turn, is merged into the one before, or has empty turns put
before it, so that the sum of the costs is least (``MERGE``, ``RELABEL``, ``UNKNOWN`` for
roles that are no role at all, ``INSERT``).  Then the repaired turns are rendered.

Turns are dealt by range of (conversation, turn), so even one conversation with a third of
all rows is spread over many tasks.  A conversation inside one range is repaired there.
For one that reaches over a border, each part is first reduced to its least costs from
every state to every state; these small tables, one for each part, are chained to find the
states at the borders, and the parts are then repaired between their two states.

A result row is one source turn, or one inserted turn, with its share of the rendered
text; rows of a conversation in order of (out_turn, part) put together are its rendering,
so no text ever has to be gathered.

Defined results: rows with a null conv_id are one conversation, a null turn comes first,
ties in turn are ordered by role and text, repeated rows are all kept; a null role is
unknown, a null text empty; a very long text is kept whole; other columns are ignored; without rows
nothing is returned.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, materialise

MERGE, RELABEL, UNKNOWN, INSERT = 1, 3, 1, 2
ROLES = ["system", "user", "assistant"]
# Other common names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatbot": "assistant", "developer": "system"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

START, STATES, FAR = 0, 4, 1 << 40
#: state (0 at the start, else 1 + role of the last turn) to the roles that may follow
FOLLOW = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
#: empty turns that make a legal end
ENDING = {0: (), 1: (1, 2), 2: (2,), 3: ()}

TURN = "conv_id long, turn long, role string, text string, seg int, pos long, whole boolean"
DECISION = "out_role int, opens boolean, relabelled boolean, before array<int>, after array<int>, out_turn long, part long, last boolean"


@lru_cache(maxsize=1024)
def role_of(role) -> int:
    name = as_text(role).strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


@lru_cache(maxsize=1)
def options() -> list[list[list[tuple]]]:
    """options()[role][state]: (cost, next state, new role, opens a turn, empty turns before it)."""
    out = []
    for r in range(4):
        per = []
        for s in range(STATES):
            found = []
            for o in range(3):
                price = 0 if r == o else UNKNOWN if r == 3 else RELABEL
                if s == 1 + o:
                    found.append((price + MERGE, s, o, False, ()))
                if o in FOLLOW[s]:
                    found.append((price, 1 + o, o, True, ()))
                else:
                    found += [(price + INSERT, 1 + o, o, True, (e,)) for e in FOLLOW[s] if o in FOLLOW[1 + e]]
            per.append(found)
        out.append(per)
    return out


def ending_cost(state: int) -> int:
    return INSERT * len(ENDING[state])


def costs(roles: list[int], entry: int) -> tuple[list[int], list[list]]:
    """Least cost to every state behind the roles, and for each turn and state the way there."""
    table = options()
    best = [FAR] * STATES
    best[entry] = 0
    back = []
    for r in roles:
        new, way = [FAR] * STATES, [None] * STATES
        for s in range(STATES):
            if best[s] < FAR:
                for choice in table[r][s]:
                    if best[s] + choice[0] < new[choice[1]]:
                        new[choice[1]], way[choice[1]] = best[s] + choice[0], (s, choice)
        best = new
        back.append(way)
    return best, back


def decide(roles: list[int], entry: int, leave: int | None) -> tuple[list[tuple], int]:
    """The chosen option of every turn, and the state behind them; leave: None at the conversation's end."""
    best, back = costs(roles, entry)
    if leave is None:
        leave = min(range(STATES), key=lambda s: (best[s] + ending_cost(s), s))
    state, out = leave, []
    for way in reversed(back):
        state, choice = way[state]
        out.append(choice)
    return out[::-1], leave


_COLUMNS = ["out_role", "opens", "relabelled", "before", "after", "out_turn", "part", "last"]


def _rows(roles: tuple[int, ...], entry: int, leave: int | None) -> list[tuple]:
    """Rows of DECISION; out_turn and part count from the piece's own beginning."""
    chosen, state = decide(roles, entry, leave)
    turn, part, rows = -1, 0, []
    for k, (_, _, o, opens, before) in enumerate(chosen):
        if opens:
            turn, part = turn + 1 + len(before), 0
        else:
            part += 1
        last = leave is None and k == len(chosen) - 1
        rows.append((o, opens, roles[k] != o, list(before), list(ENDING[state]) if last else [], turn, part, last))
    return rows


#: Short conversations repeat their sequence of roles; a worker decides each sequence once.
_SHORT = 24
_short_rows = lru_cache(maxsize=20_000)(lambda roles: _rows(roles, START, None))


def _batches(frames):
    """(frame of whole conversations one behind another, where each begins, whether the first, and the last, touches the border)."""
    rest, first = None, True
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        key = f["conv_id"].astype("Int64").fillna(-(1 << 62)).to_numpy(dtype=np.int64)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
        if len(cuts) > 1:
            yield f.iloc[: cuts[-1]], cuts[:-1], first, False
            first = False
        rest = f.iloc[cuts[-1] :]
    if rest is not None and len(rest):
        yield rest, [0], first, True


def _repair_frames(frames):
    from pyspark import TaskContext

    seg, pos = TaskContext.get().partitionId(), 0
    undecided = (None,) * len(_COLUMNS)
    for f, starts, first, last in _batches(frames):
        roles = tuple(map(role_of, f["role"].tolist()))
        rows, whole = [], []
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(f)], strict=True)):
            # A piece at the border may go on elsewhere; it is decided later.
            border = first and k == 0 or last and k == len(starts) - 1
            rows += [undecided] * (b - a) if border else _short_rows(roles[a:b]) if b - a <= _SHORT else _rows(roles[a:b], START, None)
            whole += [not border] * (b - a)
        out = f[["conv_id", "turn", "role", "text"]].reset_index(drop=True)
        out["conv_id"], out["turn"] = out["conv_id"].astype("Int64"), out["turn"].astype("Int64")
        out["seg"], out["pos"], out["whole"] = seg, range(pos, pos + len(out)), whole
        for name, column in zip(_COLUMNS, zip(*rows, strict=True), strict=True):
            kind = {"out_role": "Int32", "out_turn": "Int64", "part": "Int64"}.get(name)
            out[name] = pd.array(column, dtype=kind) if kind else pd.Series(column, dtype=object)
        pos += len(out)
        yield out


def _table(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least costs of a piece from every state to every state."""
    roles = [role_of(r) for r in pdf.sort_values("pos")["role"]]
    flat = [min(FAR, c) for s in range(STATES) for c in costs(roles, s)[0]]
    return pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64").iloc[:1].array, "seg": pdf["seg"].iloc[:1].array, "table": [flat]})


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """States before and behind each piece of a conversation; -1 behind the last one."""
    pdf = pdf.sort_values("seg")
    best, back = [FAR] * STATES, []
    best[START] = 0
    for t in pdf["table"]:
        new, way = [FAR] * STATES, [0] * STATES
        for s in range(STATES):
            for e in range(STATES):
                if best[s] < FAR and t[4 * s + e] < FAR and best[s] + t[4 * s + e] < new[e]:
                    new[e], way[e] = best[s] + t[4 * s + e], s
        best = new
        back.append(way)
    state = min(range(STATES), key=lambda s: (best[s] + ending_cost(s), s))
    entry, leave = [], []
    for way in reversed(back):
        leave.append(state)
        state = way[state]
        entry.append(state)
    leave[0] = -1
    return pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64").array, "seg": pdf["seg"].array, "entry": entry[::-1], "leave": leave[::-1]})


def _piece_decisions(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos", ignore_index=True)
    entry, leave = int(pdf["entry"].iloc[0]), int(pdf["leave"].iloc[0])
    d = pd.DataFrame(_rows(tuple(map(role_of, pdf["role"])), entry, None if leave < 0 else leave), columns=_COLUMNS)
    return pd.concat([pdf[["seg", "pos"]], d], axis=1).assign(conv_id=pdf["conv_id"].astype("Int64"))


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, out_turn, part, role, action, turn (of the source; null if inserted), text, rendered."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    keys = ["conv_id", "turn", "_r", "_h", "_n"]
    rows = rows.withColumns({"_r": F.coalesce("role", F.lit("")), "_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    turns = materialise(dealt.mapInPandas(_repair_frames, f"{TURN}, {DECISION}"), "turns")

    # Pieces at the borders of ranges: roles only.
    edge = turns.where(~F.col("whole")).select("conv_id", "seg", "pos", "role")
    tables = edge.groupBy("conv_id", "seg").applyInPandas(_table, "conv_id long, seg int, table array<long>")
    states = tables.groupBy("conv_id").applyInPandas(_chain, "conv_id long, seg int, entry int, leave int").withColumnsRenamed({"conv_id": "c", "seg": "s"})
    told = edge.join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))).drop("c", "s")
    chosen = materialise(told.groupBy("conv_id", "seg").applyInPandas(_piece_decisions, f"conv_id long, seg int, pos long, {DECISION}"), "decisions")
    # Turns and parts go on where the piece before ended.
    ends = chosen.groupBy("conv_id", "seg").agg(F.max(F.struct("pos", "out_turn", "part")).alias("e"))
    w = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), F.coalesce(F.sum(F.col("e.out_turn") + 1).over(w), F.lit(0)).alias("base"))
    # What is merged into the last turn of an earlier piece counts on from that piece's last part.
    chosen = chosen.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))).drop("c", "s")
    chosen = chosen.withColumns({"part": F.when(F.col("out_turn") < 0, F.col("pos") + (F.col("seg").cast("long") + 1) * (1 << 33)).otherwise(F.col("part")), "out_turn": F.col("out_turn") + F.col("base")}).drop("base")
    names = ["out_role", "opens", "relabelled", "before", "after", "out_turn", "part", "last"]
    late = turns.where(~F.col("whole")).drop(*names).join(chosen.select("seg", "pos", *names), ["seg", "pos"])
    return _rendered(turns.where("whole").unionByName(late.select(*turns.columns)))


def _rendered(turns: DataFrame) -> DataFrame:
    """Rows of source and inserted turns with their share of the text."""
    name = F.array(*[F.lit(r) for r in ROLES])
    text = F.coalesce("text", F.lit(""))
    shown = F.replace(text, F.lit("<|im_"), F.lit("<| im_"))  # a text can't write marks
    head = lambda turn, role: F.concat(F.when(turn > 0, CLOSE).otherwise(""), F.lit(OPEN), role, F.lit("\n"))
    end = F.when(F.col("last") & (F.size("after") == 0), CLOSE).otherwise("")
    role = F.get(name, F.col("out_role"))
    own = F.struct(
        F.col("out_turn").alias("out_turn"), F.col("part").alias("part"), role.alias("role"),
        F.concat(F.when(F.col("opens"), "keep").otherwise("merge"), F.when(F.col("relabelled"), "+relabel").otherwise("")).alias("action"),
        F.col("turn").alias("turn"), text.alias("text"),
        F.concat(F.when(F.col("opens"), head(F.col("out_turn"), role)).otherwise("\n"), shown, end).alias("rendered"),
    )
    none = F.lit(None).cast("long")

    def inserted(at, r, close):
        return F.struct(
            at.cast("long").alias("out_turn"), F.lit(0).cast("long").alias("part"), F.get(name, r).alias("role"), F.lit("insert").alias("action"),
            none.alias("turn"), F.lit("").alias("text"), F.concat(head(at, F.get(name, r)), close).alias("rendered"),
        )

    before = F.transform("before", lambda r, k: inserted(F.col("out_turn") - F.size("before") + k, r, F.lit("")))
    after = F.transform("after", lambda r, k: inserted(F.col("out_turn") + 1 + k, r, F.when(k == F.size("after") - 1, CLOSE).otherwise("")))
    return turns.select("conv_id", F.inline(F.concat(before, F.array(own), after)))
