"""Source quality: rewrite audits, delimiter lint and stray braces, by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tex as X

# What the lint reads as one sign; its messages, below, are fixed values too.
_TOKEN = r"\\(?:begin|end)\{[^{}]+\}|\\[\[\]()]|(?s:\\.)|[{}&$\n]|[^\\{}&$\n]++"


def rewrite_audit(lines: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """rule, doc_id, lines, hits: how often each rewrite rule would change the lines (doc_id, line) of a document.

    rules: name, pattern, replacement of a bounded list; bare underscores are counted with the usual ones.
    """
    told = [F.struct(F.lit(name).alias("rule"), F.regexp_count("line", F.lit(pattern)).cast("long").alias("hits")) for name, pattern, _ in rules or X.RULES]
    if rules is None:
        told.append(F.struct(F.lit("underscore").alias("rule"), F.when(F.contains("line", F.lit("_")), X.bare_underscores("line")).otherwise(0).cast("long").alias("hits")))
    found = lines.select("doc_id", F.inline(F.filter(F.array(*told), lambda h: h["hits"] > 0)))
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("lines"), F.sum("hits").alias("hits"))


def rule_rows(spark: SparkSession) -> DataFrame:
    """nth, name, pattern, replacement: the engine's own rewrite rules as rows, to which users add theirs."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(X.RULES)], "nth int, name string, pattern string, replacement string")


def repairs(docs: DataFrame, rules: DataFrame | None = None, underscores: bool = True) -> DataFrame:
    """doc_id, rule, line, hits: what the rewrite rules change in whole sources, by the line (from 1), of the text that the rule reads, where a change begins.

    rules: nth, name, pattern, replacement (a small table that users write); each rule reads what the ones before made of the text.
    Bare underscores of prose come last (``underscore``).  Null texts have no repairs.  Only texts that a rule changes are kept beside the source.
    """
    listed = sorted(tuple(r) for r in rules.select("nth", "name", "pattern", "replacement").collect()) if rules is not None else [(i, *r) for i, r in enumerate(X.RULES)]
    told = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern"), F.lit(new).alias("new")) for _, name, pattern, new in listed])
    met = "array<struct<rule:string,pattern:string,text:string>>"
    begin = F.struct(F.col("text").alias("text"), F.array().cast(met).alias("met"))

    def step(s, r):
        hit = F.rlike(s["text"], r["pattern"])
        kept = F.array(F.struct(r["name"].alias("rule"), r["pattern"].alias("pattern"), s["text"].alias("text")))
        return F.when(hit, F.struct(F.regexp_replace(s["text"], r["pattern"], r["new"]).alias("text"), F.concat(s["met"], kept).alias("met"))).otherwise(s)

    read = docs.where("text is not null").select("doc_id", F.aggregate(told, begin, step).alias("r"))
    one = lambda piece, hit: F.struct(F.regexp_count(piece, F.lit("\n")).alias("before"), F.regexp_count(hit, F.lit("\n")).alias("within"))
    cut = F.zip_with(F.split("m.text", F.col("m.pattern"), -1), F.regexp_extract_all(F.col("m.text"), F.col("m.pattern"), F.lit(0)), one)
    hits = read.select("doc_id", F.explode("r.met").alias("m")).select("doc_id", F.col("m.rule").alias("rule"), F.posexplode(cut).alias("k", "p"))
    if underscores:
        pieces = X.underscore_pieces(F.col("r.text"))
        each = F.transform(pieces, lambda p: F.struct(F.when(p == "_", 0).otherwise(F.regexp_count(p, F.lit("\n"))).alias("before"), F.when(p == "_", 0).alias("within")))
        hits = hits.unionByName(read.where(F.contains("r.text", F.lit("_"))).select("doc_id", F.lit("underscore").alias("rule"), F.posexplode(each).alias("k", "p")))
    w = Window.partitionBy("doc_id", "rule").orderBy("k")
    past = F.sum("p.before").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("p.within").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = hits.withColumn("line", 1 + past).where("p.within is not null")
    return placed.groupBy("doc_id", "rule", F.col("line").cast("long").alias("line")).agg(F.count("*").alias("hits"))


def _tokens(docs: DataFrame) -> DataFrame:
    """doc_id, k, token, line (from 1), at (characters before it in its line) of the masked sources."""
    t = docs.select("doc_id", F.posexplode(F.regexp_extract_all(X.masked("text"), F.lit(_TOKEN), F.lit(0))).alias("k", "token"))
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("token")).over(w), F.lit(0))
    t = t.withColumns({"line": 1 + F.coalesce(F.sum((F.col("token") == "\n").cast("int")).over(w), F.lit(0)), "begin": before})
    line_begin = F.coalesce(F.max(F.when(F.col("token") == "\n", F.col("begin") + 1)).over(w), F.lit(0))
    return t.withColumn("at", F.col("begin") - line_begin)


def _depths(tokens: DataFrame, change) -> DataFrame:
    """tokens with step, depth behind them (a closer at depth 0 leaves it there) and stray (such a closer)."""
    w = Window.partitionBy("doc_id").orderBy("k")
    t = tokens.withColumn("step", change).where("step is not null").withColumn("sum", F.sum("step").over(w))
    least = F.least(F.lit(0), F.coalesce(F.min("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return t.withColumns({"stray": F.col("sum") < least, "depth": F.col("sum") - F.least(least, F.col("sum"))}).drop("sum")


def _braces(tokens: DataFrame) -> DataFrame:
    return _depths(tokens, F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1))


def stray_braces_removed(docs: DataFrame) -> DataFrame:
    """doc_id, text without closing braces that nothing opened, removed (how many)."""
    gone = _braces(_tokens(docs)).where("stray").groupBy("doc_id").agg(F.collect_set(F.col("begin").cast("int")).alias("places"))
    places = F.array_sort(F.col("places"))
    ends = F.concat(places, F.array(F.length("text")))
    begins = F.concat(F.array(F.lit(-1)), places)
    cut = F.zip_with(begins, ends, lambda a, b: F.substring(F.col("text"), a + 2, b - a - 1))
    j = docs.select("doc_id", "text").join(gone, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(cut, "")).alias("text"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("removed"))


def _math_issues(tokens: DataFrame) -> DataFrame:
    """Issues of mathematics' delimiters: a fold over a document's delimiters and braces only."""
    kinds = ["$", r"\(", r"\)", r"\[", r"\]", "{", "}"]
    w = Window.partitionBy("doc_id").orderBy("k")
    pair = F.coalesce((F.col("token") == "$") & (F.lead("token").over(w) == "$"), F.lit(False))
    marks = tokens.withColumn("pair", pair).where(F.col("token").isin(kinds))
    listed = marks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "token", "line", "pair"))).alias("l"))
    issue = "array<struct<line:bigint,message:string>>"
    none = F.array().cast(issue)
    begin = F.struct(F.lit("").alias("open"), F.lit(0).cast("long").alias("since"), F.lit(0).alias("depth"), F.lit(False).alias("skip"), none.alias("issues"))
    one = lambda line, *text: F.array(F.struct(line.cast("long").alias("line"), F.concat(*text).alias("message")))

    def step(s, t):
        token = F.when(t["pair"] & (s["open"] != "$"), "$$").otherwise(t["token"])
        brace = F.when(t["token"] == "{", 1).when(t["token"] == "}", -1).otherwise(0)
        closes = (token == s["open"]) | ((token == r"\)") & (s["open"] == r"\(")) | ((token == r"\]") & (s["open"] == r"\["))
        closer = token.isin(r"\)", r"\]")
        inside = s["open"] != ""
        depth = F.when(s["depth"] != 0, one(s["since"], F.lit("unbalanced braces in math region (depth "), F.format_string("%+d", s["depth"]), F.lit(")"))).otherwise(none)
        nested = F.when(closer, one(t["line"], F.lit("math delimiter '"), token, F.lit("' has no matching opener"))).otherwise(one(t["line"], F.lit("math delimiter '"), token, F.lit("' is nested or mismatched")))
        made = lambda open_, since, depth_, skip, issues: F.struct(open_.alias("open"), since.alias("since"), depth_.alias("depth"), skip.alias("skip"), issues.alias("issues"))
        zero, off = F.lit(0), F.lit(False)
        return (
            F.when(s["skip"], made(s["open"], s["since"], s["depth"], off, s["issues"]))
            .when(brace != 0, made(s["open"], s["since"], F.when(inside, s["depth"] + brace).otherwise(s["depth"]), off, s["issues"]))
            .when(closes, made(F.lit(""), zero.cast("long"), zero, token == "$$", F.concat(s["issues"], depth)))
            .when(inside | closer, made(s["open"], s["since"], s["depth"], token == "$$", F.concat(s["issues"], nested)))
            .otherwise(made(token, t["line"].cast("long"), zero, token == "$$", s["issues"]))
        )

    last = lambda s: F.concat(s["issues"], F.when(s["open"] == "", none).otherwise(one(s["since"], F.lit("unbalanced '"), F.when(s["open"].startswith("$"), "$").otherwise(s["open"]), F.lit("' (opening delimiter is not closed)"))))
    return listed.select("doc_id", F.inline(F.aggregate("l", begin, step, last)))


def delimiter_lint(docs: DataFrame) -> DataFrame:
    """doc_id, line, message, each once: braces, environments, mathematics, alignment tabs, control and uncovered characters.

    Comments and raw text are passed over.  Depths and matches are windows over a document's
    tokens; null texts have no issues.
    """
    docs = docs.where("text is not null")
    tokens = _tokens(docs)
    w = Window.partitionBy("doc_id").orderBy("k")
    braces = _braces(tokens)
    after = F.min("depth").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    open_ = braces.withColumn("after", after).where("step = 1 and after >= depth").groupBy("doc_id").agg(F.max_by("line", "k").alias("line"), F.count("*").alias("n"))
    found = [
        braces.where("stray").select("doc_id", "line", F.lit("unbalanced braces: unexpected '}'").alias("message")),
        open_.select("doc_id", "line", F.concat(F.lit("unbalanced braces: "), "n", F.lit(" opening brace(s) remain")).alias("message")),
    ]

    # Environments: the end at a depth closes the last begin that led to it, whatever its name.
    name = F.regexp_extract("token", r"^\\(?:begin|end)\{([^{}]+)\}$", 1)
    env = _depths(tokens.withColumn("name", name), F.when(F.col("token").startswith("\\begin{"), 1).when(F.col("token").startswith("\\end{"), -1))
    env = env.withColumn("level", F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("depth") + 1))
    level = Window.partitionBy("doc_id", "level").orderBy("k")
    opener = F.last(F.when(F.col("step") == 1, F.col("name")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, -1))
    env = env.withColumns({"opener": F.when((F.col("step") == -1) & ~F.col("stray"), opener), "closed": F.lead("step").over(level) == -1})
    found += [
        env.where("stray").select("doc_id", "line", F.concat(F.lit("environment '"), "name", F.lit("' ends without a matching begin")).alias("message")),
        env.where("opener != name").select("doc_id", "line", F.concat(F.lit("environment mismatch: expected end{"), "opener", F.lit("}, got end{"), "name", F.lit("}")).alias("message")),
        env.where("step = 1 and not coalesce(closed, false)").select("doc_id", "line", F.concat(F.lit("environment '"), "name", F.lit("' is not closed")).alias("message")),
    ]
    tabs = lambda c: F.col(c).isin(X.TAB_ENVIRONMENTS).cast("int")
    change = env.select("doc_id", "k", "line", F.when(F.col("step") == 1, tabs("name")).otherwise(-F.coalesce(tabs("opener"), F.lit(0))).alias("tabs"))
    both = change.unionByName(tokens.where("token = '&'").select("doc_id", "k", "line", F.lit(None).cast("int").alias("tabs")))
    bare = both.withColumn("inside", F.coalesce(F.sum("tabs").over(w), F.lit(0))).where("tabs is null and inside = 0")
    found.append(bare.select("doc_id", "line", F.lit("bare '&' outside an alignment/table environment").alias("message")))
    found.append(_math_issues(tokens).select("doc_id", "line", "message"))

    # Characters, by line.
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    control = lines.select("doc_id", "n", F.explode(F.regexp_extract_all("line", F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), F.lit(0))).alias("c"))
    found.append(control.select("doc_id", (F.col("n") + 1).alias("line"), F.format_string("unsafe C0 control character U+%04X", F.ascii("c")).alias("message")))
    odd = F.transform(F.regexp_extract_all("line", F.lit(UNCOVERED), F.lit(0)), lambda c: F.format_string("font-unsafe character '%s' (U+%04X)", c, F.ascii(c)))
    sqrt = {"sqrt_index": r"\sqrt root index contains '/' and the mandatory radicand is missing", "sqrt_open_index": r"\sqrt root index is never closed with ']' and the radicand is missing"}
    told = [F.when(F.contains("line", F.lit(r"\sqrt")) & F.col("line").rlike(pattern), F.lit(sqrt[rule])) for rule, pattern, _ in X.RULES if rule in sqrt]
    shown = docs.select("doc_id", F.posexplode(F.split(X.masked("text"), "\n")).alias("n", "line"))  # masked once for all messages
    shown = shown.select("doc_id", "n", F.explode(F.concat(odd, F.array_compact(F.array(*told)))).alias("message"))
    found.append(shown.select("doc_id", (F.col("n") + 1).alias("line"), "message"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f.withColumn("line", F.col("line").cast("long")))
    return out.select("doc_id", F.col("line").cast("long").alias("line"), "message").distinct()


#: A character that neither a font covers nor a command stands for; the few ranges that nearly all characters are in are asked first, the many signs only of the rest.
UNCOVERED = f"(?![{''.join(rf'\x{{{a:x}}}-\x{{{b:x}}}' for a, b in X.SAFE_RANGES)}])[^{X.SAFE_SIGNS}{''.join(X.SYMBOLS)}]"


def uncovered(docs: DataFrame) -> DataFrame:
    """ch, code, n of the characters that no font is known to cover and no command stands for, over all documents."""
    odd = docs.select(F.explode(F.regexp_extract_all("text", F.lit(UNCOVERED), F.lit(0))).alias("ch"))
    return odd.groupBy("ch").agg(F.count("*").alias("n")).select("ch", F.format_string("U+%04X", F.ascii("ch")).alias("code"), "n")


def mapped_in_prose(docs: DataFrame) -> DataFrame:
    """ch, n of the characters outside mathematics that ``symbols_in_prose`` rewrites."""
    signs = F.lit("[" + "".join(X.SYMBOLS) + "]")
    return docs.select(F.explode(F.regexp_extract_all(X.prose_only("text"), signs, F.lit(0))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
