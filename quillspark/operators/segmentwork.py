"""Segment work around a translation function: packing, memo, validation, repair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Phrases that give a model's own talk away.
LEAKS = [
    "将以下英文学术文本翻译成中文",
    "只输出翻译",
    "不添加任何额外评论",
    "translate the following english",
    "output only the translation",
    "output only the chinese translation",
    "do not add any extra commentary",
    "professional academic translator",
    "you are a translator",
    "i am supposed to translate",
    "i'm supposed to translate",
    "inside these tags",
    "cannot translate",
    "unable to translate",
    "没有实际的待译文本",
    "无法进行翻译",
    "i can't help with that",
    "i cannot comply",
    "as an ai language model",
    "请提供需要翻译",
]


def greedy_batches(rows: DataFrame, key: str, order: str, size: Column, most: int, joint: int) -> DataFrame:
    """batch: rows of a key in order are put together while their sizes and joints stay within ``most``.

    The fold runs over sizes only; a row beyond the bound is a batch of its own.
    """
    sized = rows.select(key, order, size.cast("long").alias("_n"))
    listed = sized.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "_n"))).alias("l"))
    start = F.struct(F.lit(-1).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["batch"] >= 0) & (s["used"] + joint + x["_n"] <= most)
        batch = F.when(fits, s["batch"]).otherwise(s["batch"] + 1)
        used = F.when(fits, s["used"] + joint + x["_n"]).otherwise(x["_n"])
        return F.struct(batch.cast("long").alias("batch"), used.cast("long").alias("used"))

    folded = listed.select(key, "l", X.running(F.col("l"), start, step, lambda s: s["batch"], "bigint").alias("b"))
    return folded.select(key, F.inline(F.arrays_zip(F.col(f"l.{order}").alias(order), F.col("b").alias("batch"))))


def cut_long(x: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters, cut behind the last line feed or space beyond half."""

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        window = F.substring(x, at + 1, F.lit(most))
        back = F.greatest(F.locate("\n", F.reverse(window)), F.lit(0))
        blank = F.locate(" ", F.reverse(window))
        best = F.least(F.when(back > 0, back).otherwise(most + 1), F.when(blank > 0, blank).otherwise(most + 1))
        cut = F.when((F.length(x) - at <= most) | (most - best <= most // 2), F.lit(most)).otherwise(most - best)
        more = at < F.length(x)
        return F.struct(F.when(more, at + cut).otherwise(at).alias("at"), F.when(more, F.array_append(s["out"], X.strip(F.substring(x, at + 1, cut)))).otherwise(s["out"]).alias("out"))

    turns = F.sequence(F.lit(0), F.floor(F.length(x) / (most // 2)).cast("int"))
    made = F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)["out"]
    return F.filter(made, lambda p: p != "")


def memo_split(segments: DataFrame, memo: DataFrame, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of segments against memo (key, value): hits carry the value, misses are distinct keys."""
    keyed = segments.withColumn("key", X.memo_key(text))
    hits = keyed.join(memo, "key")
    misses = keyed.join(memo, "key", "left_anti").groupBy("key").agg(F.min(text).alias(text))
    return hits, misses


def issues(source: Column, translated: Column, ordered: bool = True) -> Column:
    """Names of all rules that a translated segment breaks."""
    found = lambda x, p: F.regexp_extract_all(x, F.lit(p), F.lit(0))
    tokens = [found(source, X.PLACEHOLDER), found(translated, X.PLACEHOLDER)]
    if not ordered:
        tokens = [F.array_sort(t) for t in tokens]
    low_s, low_t = F.lower(source), F.lower(translated)
    leak = F.exists(F.array(*[F.lit(p) for p in LEAKS]), lambda p: F.contains(low_t, p) & ~F.contains(low_s, p))
    rules = [
        ("empty", X.strip(translated) == ""),
        ("code_fence", F.contains(translated, F.lit("```"))),
        ("control", translated.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")),
        ("placeholder", tokens[0] != tokens[1]),
        ("dollar", ~source.rlike(X.BARE_DOLLAR) & translated.rlike(X.BARE_DOLLAR)),
        ("tag", found(source, X.TAG) != found(translated, X.TAG)),
        ("meta", leak),
        ("document", translated.rlike(r"\\(?:documentclass|begin\{document\}|usepackage)\b")),
        ("expansion", F.length(translated) > F.greatest(F.lit(800), F.length(source) * 5)),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def repair(source: Column, translated: Column) -> Column:
    """Without replacement characters; bare dollars escaped again where the source has none."""
    t = F.replace(translated, F.lit("�"), F.lit(""))
    return F.when(~source.rlike(X.BARE_DOLLAR), F.regexp_replace(t, X.BARE_DOLLAR, r"\\\$")).otherwise(t)


DELIMITER = "\n<<<SEG>>>\n"
BATCH_CHARS = 6_000


class Truncated(Exception):
    """Raised by a translation function whose answer was cut off."""


def halves(text: str, least: int = 300) -> list[str]:
    """Parts of at most half the text (``least`` characters at least), cut behind a blank line, line or space beyond half of a part."""
    most, out = max(least, len(text) // 2), []
    while len(text) > most:
        cut = next((c + len(s) for s in ("\n\n", "\n", " ") if (c := text.rfind(s, most // 2, most)) >= 0), most)
        out.append(text[:cut].strip())
        text = text[cut:]
    return [p for p in (*out, text.strip()) if p]


def _apply_with(work: Callable[[str], str], most: int):
    def batches(texts: list[str]) -> Iterator[list[str]]:
        now, size = [], 0
        for t in texts:
            if now and size + len(DELIMITER) + len(t) > most:
                yield now
                now, size = [], 0
            size += len(t) + (len(DELIMITER) if now else 0)
            now.append(t)
        if now:
            yield now

    def whole(t: str) -> str:
        try:
            return work(t)
        except Truncated:
            parts = halves(t)
            if len(t) <= 300 or len(parts) < 2:
                raise
            return "\n\n".join(whole(p) for p in parts)

    def one(t: str) -> tuple[str | None, str | None]:
        try:
            return whole(t), None
        except Exception as e:  # fail closed: the segment is rejected with its reason
            return None, str(e)[:500]

    def together(group: list[str]) -> list[str]:
        try:
            return work(DELIMITER.join(group)).split(DELIMITER)
        except Exception:
            return []  # the segments are tried one by one

    def run(frames):
        import pandas as pd

        for f in frames:
            rows: list[tuple] = []
            for group in batches(f["masked"].tolist()):
                parts = together(group) if len(group) > 1 else []
                rows += [(p, None) for p in parts] if len(parts) == len(group) else [one(t) for t in group]
            yield f.assign(value=[r[0] for r in rows], error=[r[1] for r in rows])

    return run


def translate(segments: DataFrame, memo: DataFrame, work: Callable[[str], str], text: str = "line", most: int = BATCH_CHARS) -> tuple[DataFrame, DataFrame]:
    """(values, rejects): the user's function on segments that the memo doesn't hold.

    Misses are made distinct, masked, batched and split again; a batch that fails or comes back with
    another number of parts is done one by one, and a segment whose answer was ``Truncated`` in
    halves.  What is nothing but masks stays as it is, without a call.  Memo values that no longer
    validate are done anew.
    """
    good = memo.select("key", "value")
    keyed = segments.withColumn("key", X.memo_key(text)).groupBy("key").agg(F.min(text).alias("source"))
    kept = keyed.join(good, "key").where(F.size(issues(F.col("source"), F.col("value"))) == 0)
    todo = keyed.join(kept.select("key"), "key", "left_anti")
    todo = todo.select("key", "source", X.mask("source").alias("m")).select("key", "source", "m.masked", "m.spans")
    words = X.strip(F.regexp_replace("masked", X.PLACEHOLDER, "")) != ""
    plain = todo.where(~words).select("key", F.col("source").alias("value"))
    done = todo.where(words).mapInPandas(_apply_with(work, most), "key string, source string, masked string, spans array<string>, value string, error string")
    done = done.withColumn("value", repair(F.col("masked"), F.col("value"))).withColumn("issues", F.when(F.col("value").isNull(), F.array(F.lit("failed"))).otherwise(issues(F.col("masked"), F.col("value"))))
    done = done.withColumn("value", X.unmask(F.col("value"), F.col("spans")))
    values = kept.select("key", "value").unionByName(plain).unionByName(done.where(F.size("issues") == 0).select("key", "value"))
    return values, done.where(F.size("issues") > 0).select("key", "source", "issues", "error")
