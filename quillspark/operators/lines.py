"""Line and block operators over documents, and typed blocks of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _parts(sep: str) -> Column:
    parts = F.split("text", sep)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines(docs: DataFrame, sep: str = "\n") -> DataFrame:
    """doc_id, pos (from 0), line; an empty last line isn't one."""
    return docs.select("doc_id", F.posexplode(_parts(sep)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def placed_lines(docs: DataFrame, sep: str = "\n") -> DataFrame:
    """doc_id, pos, line, position: ``positions`` of ``lines``, told where a text is taken apart; no line is moved for it."""
    parts = docs.select("doc_id", _parts(sep).alias("parts"))
    each = parts.select("doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "line"))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), "line", (F.col("pos") / F.greatest(F.lit(1), F.col("n") - 1)).alias("position"))


def followed_lines(docs: DataFrame, sep: str = "\n") -> DataFrame:
    """doc_id, pos, line, behind: lines with the next one, empty behind the last; no line is moved for it."""
    parts = docs.select("doc_id", _parts(sep).alias("parts"))
    ends = F.array_append(F.slice("parts", F.lit(2), F.size("parts")), F.lit(""))
    two = F.when(F.size("parts") > 0, F.zip_with("parts", ends, lambda a, b: F.struct(a.alias("line"), b.alias("behind"))))
    each = parts.select("doc_id", F.posexplode(two).alias("pos", "l"))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), "l.line", "l.behind")


def positions(blocks: DataFrame) -> DataFrame:
    """Relative position i / max(1, n - 1) of every block in its document."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return blocks.withColumn("position", F.col("pos") / F.greatest(F.lit(1), n - 1))


def repeated_short(blocks: DataFrame, most: int = 80) -> DataFrame:
    """Short blocks that come twice or more in their document (running headers), with their number."""
    key = X.short_key("line")
    return blocks.select("doc_id", key.alias("key")).where(F.length("key").between(1, most)).groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n >= 2")


def without_repeated(blocks: DataFrame, most: int = 80) -> DataFrame:
    """Blocks without any copy of the repeated short ones."""
    gone = repeated_short(blocks, most).select("doc_id", "key")
    return blocks.withColumn("key", X.short_key("line")).join(gone, ["doc_id", "key"], "left_anti").select(*blocks.columns)


def segments(blocks: DataFrame) -> DataFrame:
    """A first short plain line is the title, headings stand alone, runs of other lines are a paragraph."""
    own = blocks.withColumn("line", X.strip("line")).where("line != ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    own = own.withColumns({"nth": F.row_number().over(w), "heading": X.is_heading("line")})
    kind = F.when((F.col("nth") == 1) & (F.length("line") <= 120) & ~F.col("heading"), "title").when(F.col("heading"), "heading").otherwise("paragraph")
    own = own.withColumn("kind", kind)
    starts = (F.col("kind") != "paragraph") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != "paragraph")
    own = own.withColumn("segment", F.sum(starts.cast("long")).over(w))
    runs = own.groupBy("doc_id", "segment", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), " ").alias("text"))
    return runs.select("doc_id", "segment", "kind", "text")


def outline(headings: DataFrame, levels: int = 6) -> DataFrame:
    """parent: position of the nearest earlier heading of a smaller level, by document."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(w) for k in range(1, levels + 1)]
    parent = F.lit(None).cast("long")
    for k in range(2, levels + 1):
        above = F.greatest(*last[: k - 1]) if k > 2 else last[0]
        parent = F.when(F.col("level") == k, above).otherwise(parent)
    return headings.withColumn("parent", parent)


def context_windows(blocks: DataFrame, anchors: DataFrame, radius: int = 20, turn: int = 1, whole: bool = False, preamble: bool = False) -> DataFrame:
    """Lines at most ``radius`` from an anchor line (doc_id, pos), each once; the radius doubles with each turn.

    whole: documents without an anchor come with all their lines; preamble: so do the lines up to a
    document's frame, ``\\begin{document}``, in documents that have one.
    """
    radius *= 2 ** (turn - 1)
    if preamble:
        frames = blocks.where(F.contains("line", F.lit("\\begin{document}"))).groupBy("doc_id").agg(F.min("pos").alias("frame"))
        head = frames.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), "frame")).alias("pos"))
    size = blocks.groupBy("doc_id").agg(F.max("pos").alias("end"))
    near = anchors.join(size, "doc_id").select("doc_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - radius), F.least("end", F.col("pos") + radius))).alias("pos")).distinct()
    near = near.unionByName(head).distinct() if preamble else near
    out = blocks.join(near, ["doc_id", "pos"])
    return out.unionByName(blocks.join(anchors.select("doc_id").distinct(), "doc_id", "left_anti").select(*out.columns)) if whole else out


def character_counts(docs: DataFrame) -> DataFrame:
    """Number of every character beyond ASCII over all documents."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit("[^\\x{00}-\\x{7f}]"), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n")).select(X.code_point(F.col("ch")).alias("code"), "n")


def marker_counts(docs: DataFrame) -> DataFrame:
    """Replacement characters, control characters and runs of junk marks in every document."""
    n = lambda p: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long")
    return docs.select(
        "doc_id", n("�").alias("n_replacement"), n("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]").alias("n_control"),
        n(r"%%%|\*\*\*|&&&|###|\$\$\$").alias("n_junk"), F.length(F.regexp_replace("text", r"%%%|\*\*\*|&&&|###|\$\$\$", "")).cast("long").alias("clean_chars"),
    )


def audit(blocks: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rule, doc_id, lines and hits of every rewrite rule (name, pattern); rules are a bounded list."""
    hit = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_count("line", F.lit(pattern)).cast("long").alias("hits")) for name, pattern in rules])
    found = blocks.select("doc_id", F.inline(F.filter(hit, lambda h: h["hits"] > 0)))
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("lines"), F.sum("hits").alias("hits"))


# --- pages -------------------------------------------------------------------------------


def page_body(html: Column | str) -> Column:
    """html without scripts, styles, comments, navigation and footers."""
    h = F.regexp_replace(X.col(html), r"(?is)<!--.*?-->|<(script|style|nav|footer)\b.*?</\1\s*>", "")
    return h


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind (title, paragraph, item), level, text of headings, paragraphs and items."""
    form = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)(?=</?(?:h[1-6]|p|li|article|div|ul|ol|body|html)\b|$)"
    found = F.regexp_extract_all(page_body("html"), F.lit(form), F.lit(0))
    b = pages.select("page_id", F.posexplode(found).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([a-zA-Z0-9]+)", 1))
    text = X.collapse(F.regexp_replace("raw", r"(?s)<[^>]*>", " "))
    kind = F.when(tag.startswith("h"), "title").when(tag == "p", "paragraph").otherwise("item")
    level = F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("long"))
    return b.select("page_id", F.col("pos").cast("long").alias("pos"), kind.alias("kind"), level.alias("level"), text.alias("text")).where("text != ''")


def render_markdown(blocks: DataFrame) -> DataFrame:
    """One Markdown text for each page from its blocks, in order."""
    line = F.when(F.col("kind") == "title", F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), F.col("text"))).when(F.col("kind") == "item", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    rows = blocks.select("page_id", "pos", line.alias("line"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n\n").alias("markdown"))


def render_tex(blocks: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """One TeX body for each page: headings as sections, runs of items as one list, text escaped.

    heads: page_id, title, authors of the pages that begin with a title.
    """
    w = Window.partitionBy("page_id").orderBy("pos")
    b = blocks.withColumns({"before": F.lag("kind").over(w), "behind": F.lead("kind").over(w)})
    text, item = X.escape_tex("text"), F.col("kind") == "item"
    name = F.when(F.col("level") <= 1, "section").when(F.col("level") == 2, "subsection").otherwise("subsubsection")
    begin = F.when(item & (F.coalesce("before", F.lit("")) != "item"), "\\begin{itemize}\n").otherwise("")
    end = F.when(item & (F.coalesce("behind", F.lit("")) != "item"), "\n\\end{itemize}").otherwise("")
    line = F.when(F.col("kind") == "title", F.concat(F.lit("\\"), name, F.lit("{"), text, F.lit("}"))).when(item, F.concat(begin, F.lit("\\item "), text, end)).otherwise(text)
    # Items of one list stand on neighbouring lines, all else is parted by a blank line.
    joint = F.when(item & (F.coalesce("behind", F.lit("")) == "item"), "\n").otherwise("\n\n")
    rows = b.select("page_id", "pos", F.concat(line, joint).alias("line"))
    body = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "").alias("tex"))
    if heads is not None:
        lead = F.concat(F.lit("\\title{"), X.escape_tex("title"), F.lit("}\n\\author{"), X.escape_tex(F.coalesce("authors", F.lit(""))), F.lit("}\n\\maketitle\n\n"))
        body = body.join(heads, "page_id", "left").select("page_id", F.concat(F.coalesce(lead, F.lit("")), "tex").alias("tex"))
    return body.select("page_id", F.rtrim(F.regexp_replace("tex", r"\n+$", "")).alias("tex"))


def tag_balance(pages: DataFrame, tag: str = "p") -> DataFrame:
    """Openers, closers, and closers that come when nothing is open."""
    tags = F.regexp_extract_all("html", F.lit(rf"(?i)</?{tag}(?=[\s>])"), F.lit(0))
    step = lambda s, t: F.when(t.startswith("</"), F.struct(F.greatest(s["depth"] - 1, F.lit(0)).alias("depth"), (s["stray"] + F.when(s["depth"] == 0, 1).otherwise(0)).alias("stray"))).otherwise(F.struct((s["depth"] + 1).alias("depth"), s["stray"].alias("stray")))
    end = F.aggregate(tags, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("stray")), step)
    closers = F.size(F.filter(tags, lambda t: t.startswith("</")))
    return pages.select("page_id", (F.size(tags) - closers).cast("long").alias("openers"), closers.cast("long").alias("closers"), end["depth"].cast("long").alias("unclosed"), end["stray"].cast("long").alias("stray"))
