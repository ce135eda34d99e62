"""Substring search of a stated set of needles over all documents.

The needles are a query set that is read in blocks of bounded size.  A block is one automaton,
which a pass over the documents runs over every key once, however many needles it holds; only
ids, places and snippets leave that pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .overlap import overlapping, running_ends

#: Most needles, and most characters of them, in a block.
BLOCK_NEEDLES = 5_000
BLOCK_CHARS = 400_000


def needle_blocks(needles: DataFrame, id_column: str, text_column: str) -> list[list[tuple[int, str]]]:
    """(id, key) of the needles with a key, in blocks."""
    out, size = [[]], 0
    for i, k in needles.select(id_column, X.match_key(text_column).alias("key")).where("key != ''").toLocalIterator():
        if out[-1] and (len(out[-1]) >= BLOCK_NEEDLES or size + len(k) > BLOCK_CHARS):
            out.append([])
            size = 0
        out[-1].append((i, k))
        size += len(k)
    return [b for b in out if b]


def _hits_with(block: list[tuple[int, str]], span: int):
    """First place of every needle in each key, with the ``span`` characters of the text at the same share of it."""

    def run(frames):
        import ahocorasick
        import pandas as pd

        ids: dict[str, list[int]] = {}
        for i, k in block:
            ids.setdefault(k, []).append(i)
        find = ahocorasick.Automaton()
        for k in ids:
            find.add_word(k, k)
        find.make_automaton()
        for f in frames:
            out = []
            for doc, side, priority, text, key in f.itertuples(index=False) if ids else ():
                first: dict[str, int] = {}
                for end, k in find.iter(key):
                    first.setdefault(k, end - len(k) + 1)
                for k, at in first.items():
                    begin = min(len(text), int(at / max(1, len(key)) * len(text)))
                    out += [(i, doc, side, priority, at, len(key), text[begin : begin + span]) for i in ids[k]]
            yield pd.DataFrame(out, columns=["id", "doc_id", "side", "priority", "at", "size", "cut"])

    return run


def contained(docs: DataFrame, needles: DataFrame, id_column: str, text_column: str, span: int) -> DataFrame:
    """Documents (doc_id, side, priority, text) with each needle that their key contains: id_column, at (from 0), size of the key, cut."""
    names = ["doc_id", "side", "priority"]
    schema = ", ".join(["id long", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names), "at long, size long, cut string"])
    keyed = docs.select(*names, "text", X.match_key("text").alias("key"))
    made = [keyed.mapInPandas(_hits_with(block, span), schema) for block in needle_blocks(needles, id_column, text_column) or [[]]]
    return reduce(DataFrame.unionByName, made).withColumnRenamed("id", id_column)


def library_search(docs: DataFrame, queries: DataFrame, most: int = 20, span: int = 160) -> DataFrame:
    """For every query the first ``most`` documents, in library order, that contain it, with a snippet.

    docs: doc_id, side, priority (the lower side wins), text.
    """
    hit = contained(docs.where("text is not null").select("doc_id", "side", "priority", "text"), queries, "item_id", "text", span)
    hit = hit.withColumn("side_rank", F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy("priority"))).where("side_rank = 1")
    ratio = F.col("at") / F.greatest(F.lit(1), F.col("size"))
    snippet = X.collapse("cut")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= most).select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "side", snippet.alias("snippet"), F.round(ratio, 4).alias("position_ratio"))


def find_all(blocks: DataFrame, needle: str, most: int = 500) -> DataFrame:
    """Every occurrence, overlapping ones too, of a needle in the blocks' keys; at most ``most`` a document."""
    n = len(needle)
    key = X.match_key("line")
    keyed = blocks.withColumn("key", key).where(F.contains(F.col("key"), F.lit(needle)) & F.lit(n > 0))
    # Parts begin with the needle, but for a first one that doesn't; their lengths before give the places.
    parts = keyed.select("doc_id", "pos", F.startswith("key", F.lit(needle)).alias("leads"), F.posexplode(F.split("key", rf"(?=\Q{needle}\E)", -1)).alias("k", "part"))
    before = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy("doc_id", "pos").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = parts.withColumn("at", before.cast("long")).where((F.col("k") > 0) | F.col("leads")).select("doc_id", "pos", "at")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "at"))
    return hit.withColumn("nth", rank.cast("long")).where(F.col("nth") <= most)


def key_places(blocks: DataFrame, needle: str) -> DataFrame:
    """doc_id, begin, stop of every occurrence, overlapping ones and across blocks too, of a needle (a key) in the joined keys.

    Each block is read with the characters behind it that an occurrence beginning in it can reach.
    """
    n = len(needle)
    keyed = running_ends(blocks.select("doc_id", "pos", X.page_key("line").alias("key")).withColumn("size", F.length("key")), "doc_id", "pos", "size").where("size > 0")
    behind = F.collect_list(F.left("key", F.lit(n - 1))).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, n - 1)) if n > 1 else F.array(F.lit(""))
    read = keyed.withColumn("key", F.concat("key", F.left(F.array_join(behind, ""), F.lit(n - 1))))
    parts = read.where(F.contains("key", F.lit(needle))).select("doc_id", "pos", "start", F.startswith("key", F.lit(needle)).alias("leads"), F.posexplode(F.split("key", rf"(?=\Q{needle}\E)", -1)).alias("nth", "part"))
    before = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy("doc_id", "pos").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = parts.withColumn("begin", (F.col("start") + before).cast("long")).where((F.col("nth") > 0) | F.col("leads"))  # only the first part may begin without one
    return hit.select("doc_id", "begin", (F.col("begin") + n).alias("stop"))


def quote_places(blocks: DataFrame, quotes: DataFrame, cuts: tuple[int, ...] = (140, 60, 24), least: int = 6) -> DataFrame:
    """q_id, doc_id, begin, stop of every quote (q_id, doc_id, quote) in its document's joined keys: the first place of
    the whole, else of its beginning of 140, 60 or 24 characters; none for quotes of fewer than ``least``."""
    listed = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", X.page_key("line").alias("k")))).alias("l"))
    joined = listed.select("doc_id", F.array_join(F.transform("l", lambda s: s["k"]), "").alias("key"))
    asked = quotes.select("q_id", "doc_id", X.page_key("quote").alias("needle")).where(F.length("needle") >= least)
    j = asked.join(joined, "doc_id")
    place = lambda n: F.struct((F.call_function("instr", F.col("key"), n) - 1).cast("long").alias("begin"), F.length(n).cast("long").alias("size"))
    tries = F.array(place(F.col("needle")), *[F.when(F.length("needle") > c, place(F.left("needle", F.lit(c)))) for c in cuts])
    hit = F.get(F.filter(tries, lambda t: t["begin"] >= 0), 0)
    return j.select("q_id", "doc_id", hit.alias("h")).where("h is not null").select("q_id", "doc_id", "h.begin", (F.col("h.begin") + F.col("h.size")).alias("stop"))


def span_overlay(blocks: DataFrame, matches: DataFrame) -> DataFrame:
    """Blocks, as spans of their document's joined key, that a match (doc_id, begin, stop) overlaps."""
    sized = blocks.withColumn("size", F.length(X.page_key("line")))
    spans = running_ends(sized, "doc_id", "pos", "size").where("size > 0").select("doc_id", "pos", "start", "end")
    return overlapping(spans, matches.select("doc_id", "begin", "stop"), "doc_id", ("start", "end"), ("begin", "stop")).select("doc_id", "begin", "stop", "pos", "start", "end")
