"""Toxicity by a weighted finite-state pattern grammar (operator 6).

Words fall into classes: insult, threat, target (second or third person), copula, intent,
negation, reporting verb, other.  Five transducers rewrite the class sequence of a clause one
after another and are composed into one table:

    insult     an insult right behind another one is piled up
    threat     a threat behind a word of intent is meant
    target     an insult behind "you", or behind a person and a copula, is aimed at them; so is a
               threat with "you" behind it, or one that is meant, with any person behind it
    negation   what is up to three words behind a negation is weak
    report     what is behind a reporting verb in its clause is weak

Each surviving symbol has its weight.  A clause ends at a sentence or line mark.  The weights of
all clauses add up to s, and the score is 1 - exp(-s).  A lone insult stays below the threshold;
two of them, or an aimed one, reach it.

Which words insult is partly fixed and partly learned: from a bounded sample of labelled
rows (``SAMPLE_TOXIC`` and ``SAMPLE_OTHER`` rows in expectation, chosen by a hash of the
id), word beginnings that many different toxic texts share and others do not, once or at least
twice in a text.  A beginning counts only if chance would hardly give it that many toxic texts,
however many beginnings are tried, and near copies count once.  What a learned word weighs
when nothing else is in the text follows from the sample's texts with one match alone, too.
Rows of the held-out fold are never looked at.

Defined results: null or empty text scores ``FLOOR``; repeated rows each give a row;
labels without a document, or null labels, are ignored; without labels the fixed words
alone decide; a very long text is scored over all its clauses; an empty table has no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, materialise

#: Expected numbers of labelled rows to learn from.
SAMPLE_TOXIC = 4_000
SAMPLE_OTHER = 12_000
THRESHOLD = 0.3
FLOOR = 0.01

# Public everyday words of each class (a person with a copula in one word stands with the second person) in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting dumb imbecile dumbass bastard clown arschloch dummkopf vollidiot connard salope imbécile pendejo estúpido cabrón".split()
THREATS = "kill hurt murder destroy beat stab shoot burn töten umbringen tuer frapper matar golpear".split()
SECOND = "you you're u ya he's she's they're du dich euch ihr tu te toi vous usted ustedes ti".split()
THIRD = "he she they him her them er sie ihn il elle ils elles él ella ellos ellas".split()
COPULAS = "are is am was were be bist ist sind seid es est êtes sont eres son".split()
INTENTS = "will i'll we'll gonna going let's want werde werden will muss soll vais va allons vamos voy quiero".split()
WISHES = "should must deserve deserves ought sollten müssen verdienen devraient doivent méritent deberían merecen".split()
DOOMS = "shot killed murdered hanged stabbed executed lynched burned erschossen getötet aufgehängt tués tué fusillés fusilados muertos".split()
ARTICLES = "a an some ein eine einen un une uno una".split()
PLAYS = "chess game games match race tennis football poker quiz cards golf tournament final schach spiel rennen turnier échecs jeu partie tournoi ajedrez partido juego carrera torneo".split()
NEGATIONS = "not no never nor isn't aren't wasn't don't won't nicht kein keine nie pas jamais ni nunca jamás".split()
REPORTS = "said says called calls quoted reported claimed wrote sagte nannte schrieb dit appelé écrit dijo llamó escribió".split()

INSULT, THREAT, SECOND_PERSON, THIRD_PERSON, COPULA, INTENT, NEGATION, REPORT, WISH, DOOM, ARTICLE, PLAY, OTHER = range(13)
# Symbols that the transducers write beside the classes.
PILED, MEANT, STRONG, AIMED, WEAK, SPARED = range(13, 19)
SYMBOLS = 19
#: Two lone insults reach the threshold together, one alone doesn't; an aimed one does.
LONE = 0.22
WEIGHTS = {INSULT: LONE, PILED: LONE, STRONG: 0.7, AIMED: 0.7, WEAK: 0.03, SPARED: -0.7}
#: Texts that speak for the usual weight of a lone insult beside those of the sample.
PRIOR = 20

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE = re.compile(r"[.!?;\n\r|]+")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("predicted", T.IntegerType(), False),
        T.StructField("n_clauses", T.LongType(), False),
    ]
)


class Transducer:
    """Deterministic, total: step[state][symbol] = (next state, written symbol)."""

    def __init__(self, states: int, changes: dict[tuple[int, int], tuple[int, int]], default) -> None:
        self.step = [[changes.get((s, a)) or default(s, a) for a in range(SYMBOLS)] for s in range(states)]

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes is what ``other`` reads."""
        m = len(other.step)
        out = Transducer(0, {}, None)
        out.step = []
        for s in self.step:
            for q in range(m):
                row = []
                for to, symbol in s:
                    q2, written = other.step[q][symbol]
                    row.append((to * m + q2, written))
                out.step.append(row)
        return out


def _insult() -> Transducer:
    """An insult up to two words behind another one."""
    change = {(s, INSULT): (2, PILED if s else INSULT) for s in range(3)}
    return Transducer(3, change, lambda s, a: (max(0, s - 1), a))


def _threat() -> Transducer:
    """A threat up to three words behind a word of intent, or a person who is wished a doom: each up to three words behind the one before."""
    change = {(s, INTENT): (3, INTENT) for s in range(4)} | {(s, WISH): (3, INTENT) for s in range(4)} | {(s, THREAT): (0, MEANT) for s in (1, 2, 3)}
    meant = Transducer(4, change, lambda s, a: (max(0, s - 1), a))
    # 1 to 3: words left behind a person, 4 to 6: behind the wish.
    wish = {(s, p): (3, p) for s in range(7) for p in (SECOND_PERSON, THIRD_PERSON)} | {(s, WISH): (6, WISH) for s in (1, 2, 3)} | {(s, DOOM): (0, STRONG) for s in (4, 5, 6)}
    return Transducer(7, wish, lambda s, a: (0 if s in (0, 1, 4) else s - 1, a)).then(meant)


def _target() -> Transducer:
    """Insults at a person, and threats with one behind them, unless something else is given to that person or they are beaten at play.

    States: 0; 1, 2: one or two words are left in which an insult is aimed; 3, 4: the same behind a third person, who needs a copula;
    5, 6: behind a threat; 7, 8: behind one that is meant; 9 to 11: behind a threat's second person, 12 to 14: its third person.
    """
    fewer = {0: 0, 1: 0, 2: 1, 3: 0, 4: 3, 5: 0, 6: 5, 7: 0, 8: 7, 9: 0, 10: 9, 11: 10, 12: 0, 13: 12, 14: 13}
    near, every = (1, 2, 10, 11), range(15)
    change = {(s, THREAT): (6, THREAT) for s in every} | {(s, MEANT): (8, MEANT) for s in every}
    for s in every:
        change[s, SECOND_PERSON] = (11, AIMED) if 5 <= s <= 8 else (2, SECOND_PERSON)
        change[s, THIRD_PERSON] = (14, AIMED) if s in (7, 8) else (4, THIRD_PERSON)
        for insult in (INSULT, PILED):
            change[s, insult] = (s if s in near else 0, STRONG if s in near else insult)
        if s >= 9:
            change[s, PLAY] = (0, SPARED)
    change[11, ARTICLE] = change[14, ARTICLE] = (0, SPARED)
    for s in (1, 2, 3, 4, 10, 11, 13, 14):
        change[s, COPULA] = (2, COPULA)
        change[s, NEGATION] = (s, NEGATION)  # a negation doesn't part a person from what is said of them
    return Transducer(15, change, lambda s, a: (fewer[s], a))


def _negation() -> Transducer:
    """What is up to three words behind a negation."""
    change = {(s, NEGATION): (3, NEGATION) for s in range(4)} | {(s, a): (s - 1, WEAK) for s in (1, 2, 3) for a in (INSULT, PILED, STRONG, AIMED)}
    return Transducer(4, change, lambda s, a: (max(0, s - 1), a))


def _report() -> Transducer:
    """Behind a reporting verb, the rest of the clause is weak."""
    change = {(s, REPORT): (1, REPORT) for s in range(2)} | {(1, a): (1, WEAK) for a in (INSULT, PILED, STRONG, AIMED)} | {(1, SPARED): (1, OTHER)}
    return Transducer(2, change, lambda s, a: (s, a))


def transducers() -> list[Transducer]:
    return [_insult(), _threat(), _target(), _negation(), _report()]


@lru_cache(maxsize=1)
def grammar() -> list[list[tuple[int, int]]]:
    """The composed table: step[state][class] = (next state, written symbol)."""
    return reduce(Transducer.then, transducers()).step


class Scorer:
    def __init__(self, stems: dict[str, float], lone: float = LONE) -> None:
        """stems: learned beginnings of insults; lone: what one of these weighs by itself."""
        import ahocorasick

        self.step = grammar()
        classes = (ARTICLE, ARTICLES), (PLAY, PLAYS), (DOOM, DOOMS), (WISH, WISHES), (REPORT, REPORTS), (NEGATION, NEGATIONS), (COPULA, COPULAS), (INTENT, INTENTS), (THIRD_PERSON, THIRD), (SECOND_PERSON, SECOND), (THREAT, THREATS), (INSULT, INSULTS)
        self.kind = {w: k for k, ws in classes for w in ws}
        self.stems, self.lone = stems, lone
        self.lengths = sorted({len(s) for s in stems})
        self.find = ahocorasick.Automaton()
        for w in {*INSULTS, *THREATS, *DOOMS, *stems}:
            self.find.add_word(w, len(w))
        self.find.make_automaton()

    def learned(self, word: str) -> bool:
        return any(word[:n] in self.stems for n in self.lengths if n <= len(word))

    def symbols(self, text: str) -> list[list[tuple[int, bool]]]:
        """For each clause that matches, the written symbols that weigh, and whether each is of a learned word that isn't a fixed one."""
        low = text.lower().replace("’", "'")
        hits = [end - n + 1 for end, n in self.find.iter(low)]
        out, at, k = [], 0, 0
        if not hits:
            return out
        marks = [(m.start(), m.end()) for m in _CLAUSE.finditer(low)] + [(len(low), len(low))]
        for stop, after in marks:
            if k < len(hits) and hits[k] < after:
                while k < len(hits) and hits[k] < after:
                    k += 1
                found, state = [], 0
                for m in _WORD.finditer(low, at, stop):
                    w = m.group()
                    kind = self.kind.get(w, OTHER)
                    own = kind == OTHER and self.learned(w)
                    state, symbol = self.step[state][INSULT if own else kind]
                    if symbol in WEIGHTS:
                        found.append((symbol, own))
                if found:
                    out.append(found)
            at = after
        return out

    def clauses(self, text: str) -> list[float]:
        """Weights of the clauses that match the grammar."""
        return [max(0.0, sum(self.lone if own and s == INSULT else WEIGHTS[s] for s, own in found)) for found in self.symbols(text)]

    def score(self, clauses: list[float]) -> float:
        return 1.0 - (1.0 - FLOOR) * math.exp(-sum(clauses))


# --- learning ----------------------------------------------------------------------------


def _beginnings(text: str) -> Counter:
    """How many words of a text have each beginning."""
    return Counter(w[:n] for w in _WORD.findall(text.lower().replace("’", "'")) for n in range(4, min(8, len(w)) + 1))


def _sketch(text: str) -> list[int]:
    """Three minima over hashed word pairs: near copies share at least one of them."""
    import xxhash

    words = text.lower().split()
    grams = {" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))}
    return [min((xxhash.xxh64_intdigest(g, seed) >> 1 for g in grams), default=0) for seed in (1, 2, 3)]


def _count_with(wanted: set[str] | None):
    def run(frames):
        for f in frames:
            once, twice = Counter(), Counter()
            for t in f["text"]:
                b = _beginnings(as_text(t))
                told = b if wanted is None else b.keys() & wanted
                once.update(dict.fromkeys(told, 1))
                twice.update({w: 1 for w in told if b[w] > 1})
            if once:
                yield pd.DataFrame({"stem": list(once), "n": np.array(list(once.values()), dtype=np.int64), "twice": np.array([twice[w] for w in once], dtype=np.int64)})

    return run


def _lone_with(stems: dict[str, float]):
    """Of every text whether its only match is one learned word."""

    def run(frames):
        scorer = Scorer(stems)
        for f in frames:
            found = [[x for clause in scorer.symbols(as_text(t)) for x in clause] for t in f["text"]]
            yield pd.DataFrame({"toxic": f["toxic"], "lone": [x == [(INSULT, True)] for x in found]})

    return run


def learn(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_other: int = SAMPLE_OTHER) -> tuple[dict[str, float], float]:
    """Stems with the share of their texts that are toxic, and what a lone one weighs, from the labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    n = {bool(r["t"]): r["n"] for r in known.groupBy((F.col("toxic") == 1).alias("t")).agg(F.count("*").alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return {}, LONE
    part = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30))
    share = {True: min(1.0, sample_toxic / n[True]), False: min(1.0, sample_other / n[False])}
    keep = known.where(part < F.when(F.col("toxic") == 1, int(share[True] * (1 << 30))).otherwise(int(share[False] * (1 << 30))))
    near = docs.select(F.col("doc_id").cast("long"), "text")

    @F.pandas_udf("array<long>")
    def sketch(texts: pd.Series) -> pd.Series:
        return pd.Series([_sketch(as_text(t)) for t in texts])

    # The sample's ids are some 16 bytes each: at most about sample_toxic + sample_other of them are broadcast.
    rows = materialise(near.join(F.broadcast(keep), "doc_id").where("text is not null").select("doc_id", "text", "toxic"), "labelled")
    toxic = rows.where("toxic = 1").withColumn("m", sketch("text"))
    for k in range(3):  # of texts that share a minimum, the one with the smallest id stays
        first = toxic.groupBy(toxic.m[k].alias("g")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        toxic = toxic.join(first.distinct(), "doc_id", "left_semi")
    toxic = materialise(toxic.select("text", "toxic"), "toxic")
    other = rows.where("toxic != 1").select("text", "toxic")
    n_toxic, n_other = toxic.count(), other.count()
    if not n_toxic or not n_other:
        return {}, LONE
    count = lambda df, wanted: df.select("text").mapInPandas(_count_with(wanted), "stem string, n long, twice long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("twice").alias("twice"))
    # With m beginnings tried, chance alone reaches this many toxic texts about once in 100 learnings.
    tried = 200_000
    least = max(4, math.ceil(math.log(100 * tried) / math.log((n_toxic + n_other) / n_toxic)))
    least = max(least, n_toxic // 100)
    in_toxic = {r["stem"]: (r["n"], r["twice"]) for r in count(toxic, None).where(F.col("n") >= least).collect()}  # at most words of the sample
    in_other = {r["stem"]: (r["n"], r["twice"]) for r in count(other, set(in_toxic)).collect()}
    good = {}
    for s, seen in in_toxic.items():
        # Once in a text or, for beginnings that other texts may have by chance, twice in it.
        for a, b in zip(seen, in_other.get(s, (0, 0)), strict=True):
            if s not in good and a >= least and (a / n_toxic >= 30 * (b + 0.5) / n_other or b == 0):
                good[s] = (seen[0], (a / n_toxic) / (a / n_toxic + b / n_other))
    # Of a chain of beginnings that nearly the same texts have, the longest stays; it makes longer ones needless.
    # One that also stands in other texts gives way to a longer one that doesn't.
    best = {}
    for s in sorted(good, key=len):
        while True:
            share = 0.97 if good[s][1] == 1.0 else 0.6
            longer = [x for x in good if len(x) == len(s) + 1 and x.startswith(s) and good[x][0] >= share * good[s][0] and good[x][1] >= good[s][1]]
            if not longer:
                break
            s = max(longer, key=lambda x: (good[x][0], x))
        if not any(s.startswith(x) for x in best):
            best[s] = good[s][1]
    lone = toxic.unionByName(other).mapInPandas(_lone_with(best), "toxic int, lone boolean").where("lone").groupBy("toxic").count().collect()
    share = {r["toxic"] == 1: r["count"] / (n_toxic if r["toxic"] == 1 else n_other) for r in lone}
    told = {r["toxic"] == 1: r["count"] for r in lone}
    usual = 1 - (1 - FLOOR) * math.exp(-LONE)
    seen = told.get(True, 0) + told.get(False, 0)
    of_seen = share.get(True, 0.0) / (share.get(True, 0.0) + share.get(False, 0.0)) if seen else 0.0
    p = min(0.9, (of_seen * seen + usual * PRIOR) / (seen + PRIOR))
    return best, max(LONE, math.log((1 - FLOOR) / (1 - p)))


def _score_with(stems: dict[str, float], lone: float):
    def run(frames):
        scorer = Scorer(stems, lone)
        for f in frames:
            found = [scorer.clauses(as_text(t)) for t in f["text"]]
            score = [scorer.score(c) for c in found]
            yield pd.DataFrame(
                {"doc_id": f["doc_id"].astype("Int64"), "held_out": f["held_out"], "score": score, "predicted": np.array([s >= THRESHOLD for s in score], dtype=np.int32), "n_clauses": [len(c) for c in found]}
            )

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document with its score; held_out tells the fold that was not learned from."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return docs.select("doc_id", "text", held.alias("held_out")).mapInPandas(_score_with(*learn(docs, labels)), SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns."""
    learned = learn(docs, labels)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        scorer = Scorer(*learned)
        return pd.Series([scorer.score(scorer.clauses(as_text(t))) for t in texts], dtype="float64")

    return docs.where(rate(docs["text"]) < THRESHOLD)
