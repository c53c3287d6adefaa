"""Segmentation of documents into table-of-contents rows, blocks and logical pages.

A document is shuffled once, on ``doc_id``; every window, grouping and fold
after that keeps this partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import text as X

MAX_CHARS = 1800
OVERLAP_CHARS = 160

# Heading and list-marker forms.
MARKDOWN_HEADING = f"^(#{{1,6}})[{X.WS}]+(.+?)[{X.WS}]*$"
LEGAL_NUM = "一二三四五六七八九十百千0-9"
LEGAL_HEADINGS = (
    f"^[{X.WS}]*第[{LEGAL_NUM}]+章",
    f"^[{X.WS}]*第[{LEGAL_NUM}]+节",
    f"^[{X.WS}]*第[{LEGAL_NUM}]+条",
)
DOTTED = r"\p{Nd}++(?:\.\p{Nd}++)++"
MARKER = (
    rf"^[{X.WS}]*({DOTTED}(?=[{X.WS}])|\p{{Nd}}+[\.、．]|[{E.CHINESE_NUM}]+[、．\.]|"
    rf"[（(][{E.CHINESE_NUM}]+[）)]|[（(]\p{{Nd}}+[）)]|\p{{Nd}}+[）)])[{X.WS}]*[^{X.WS}]"
)
PAREN_DIGITS = r"^(?:[（(]\p{Nd}+[）)]|\p{Nd}+[）)])"

MODES = ("heading", "heading_plus_numbered", "block", "legal")


def _heading(line: Column, mode: Column) -> tuple[Column, Column]:
    """Level (NULL for body lines) and title of a heading line."""
    depth = F.lit(None).cast("int")
    for level, pattern in reversed(list(enumerate(LEGAL_HEADINGS, start=1))):
        depth = F.when(line.rlike(pattern), F.lit(level)).otherwise(depth)
    hashes = F.length(F.regexp_extract(line, MARKDOWN_HEADING, 1))
    legal = mode == "legal"
    title = F.when(legal, line).otherwise(F.regexp_extract(line, MARKDOWN_HEADING, 2))
    return F.when(legal, depth).otherwise(F.when(hashes > 0, hashes)), X.strip(title)


def outline(docs: DataFrame, mode: str | None = None) -> DataFrame:
    """One row per heading, marker or run of body lines of ``docs(doc_id, text, ..)``.

    ``text`` must already be normalised (B2). All other columns are carried
    along. ``entry`` rows open a table-of-contents line; ``text`` is the body.
    Without ``mode`` every document has its own in the column ``mode``, and all
    of them are split in the same pass.
    """
    if mode is not None and mode not in MODES:
        raise ValueError(f"unknown split mode {mode}")
    way = F.col("mode") if mode is None else F.lit(mode)
    numbered, in_blocks = way.isin("heading_plus_numbered", "legal"), way == "block"
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    so_far = by_pos.rowsBetween(Window.unboundedPreceding, 0)
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)

    rows = docs.repartition("doc_id").select(
        "doc_id", *carried, F.length("text").alias("n_text"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    level, title = _heading(F.col("line"), way)
    rows = rows.select("*", level.alias("h_level"), title.alias("h_title"))
    is_head = F.col("h_level").isNotNull()
    rows = rows.select(
        "*",
        F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int").alias("line_start"),
        F.sum(F.when(is_head, 1).otherwise(0)).over(so_far).alias("seg"),
        *[
            F.last(F.when(F.col("h_level") == d, F.struct("pos", F.lit(d).alias("level"), F.col("h_title").alias("title"))), True)
            .over(so_far)
            .alias(f"h{d}")
            for d in range(1, 7)
        ],
    )
    # A heading is still open if no heading of a lower level came after it.
    open_heads = F.array(
        *[
            F.when(
                F.col(f"h{d}.pos")
                > F.greatest(F.lit(-1), *[F.coalesce(F.col(f"h{k}.pos"), F.lit(-1)) for k in range(1, d)], F.lit(-1)),
                F.col(f"h{d}"),
            )
            for d in range(1, 7)
        ]
    )
    rows = rows.withColumn("heads", F.array_compact(open_heads)).drop(*[f"h{d}" for d in range(1, 7)])

    marker = F.when(numbered, F.regexp_extract("line", MARKER, 1)).otherwise("")
    if mode is None or mode == "block":
        kind = F.when(is_head, "heading").when(E.is_table_line(F.col("line")), "table").otherwise("text")
        rows = rows.withColumn("kind", F.when(in_blocks, kind).otherwise("section"))
        turns = F.col("kind") != F.coalesce(F.lag("kind").over(by_pos), F.lit("heading"))
    else:
        rows, turns = rows.withColumn("kind", F.lit("section")), F.lit(False)
    opens = ~is_head & F.when(in_blocks, turns).otherwise((marker != "") & (F.col("seg") > 0))
    rows = rows.select("*", F.when(opens, marker).otherwise("").alias("marker"), F.when(opens, 1).otherwise(0).alias("opens"))
    rows = rows.withColumn(
        "run", F.sum("opens").over(Window.partitionBy("doc_id", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    )

    body = F.when(~is_head, F.struct("pos", "line"))
    groups = rows.groupBy("doc_id", "seg", "run").agg(
        *[F.first(c).alias(c) for c in carried],
        F.first("n_text").alias("n_text"),
        F.min("pos").alias("first_pos"),
        F.min("line_start").alias("row_start"),
        F.min(F.when(~is_head, F.col("line_start"))).alias("body_start"),
        F.min_by("heads", "pos").alias("heads"),
        F.min_by("marker", "pos").alias("marker"),
        F.max(F.when(~is_head, F.col("kind"))).alias("kind"),
        F.bool_or(is_head).alias("is_head"),
        F.min_by(F.trim("line"), "pos").alias("raw_title"),
        X.strip(F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]), "\n")).alias("text"),
    )
    groups = groups.withColumn(
        "char_end",
        F.coalesce(F.lead("row_start").over(Window.partitionBy("doc_id").orderBy("first_pos")), F.col("n_text")),
    )
    if mode is None or mode in ("heading_plus_numbered", "legal"):
        groups = _numbered_paths(groups)
    else:
        groups = groups.withColumn("numbered", F.array().cast("array<struct<level:int,title:string>>"))

    head_level = F.coalesce(F.try_element_at("heads", F.lit(-1))["level"], F.lit(0))
    number_level = F.coalesce(F.try_element_at("numbered", F.lit(-1))["level"], F.lit(0))
    path = F.concat(F.transform("heads", lambda h: h["title"]), F.transform("numbered", lambda n: n["title"]))
    opened = (F.col("is_head") & (F.col("run") == 0)) | (F.col("marker") != "")
    return groups.select(
        "doc_id",
        *carried,
        "first_pos",
        opened.alias("entry"),
        F.coalesce("kind", F.lit("section")).alias("kind"),
        "text",
        F.when(F.col("seg") == 0, F.when(F.col("run") == 0, F.lit(0)).otherwise(F.col("body_start")))
        .otherwise(F.coalesce("body_start", "row_start"))
        .alias("char_start"),
        "char_end",
        path.alias("heading_path"),
        (head_level + number_level).alias("level"),
    )


def _numbered_paths(groups: DataFrame) -> DataFrame:
    """Levels of list markers and the open markers at each of them.

    The level of a marker depends only on the marker before it, so it is a
    running count. A marker of a lower level is still open if it is the last of
    its level and none of a yet lower level came after it. Each marker asks for
    the last one of every lower level, in order of the level's own rows, so the
    work is that of writing the paths down.
    """
    w = Window.partitionBy("doc_id", "seg").orderBy("run")
    dotted = F.col("marker").rlike(f"^{DOTTED}")
    title = X.strip(F.col("raw_title"))
    marked = (F.col("run") > 0) & (F.col("marker") != "")
    after_colon = F.coalesce(F.lag(F.when(F.col("run") > 0, title.rlike("[：:]$"))).over(w), F.lit(False))
    deeper = (F.col("run") > 0) & F.col("marker").rlike(PAREN_DIGITS) & after_colon & ~dotted
    fixed = F.when(dotted, F.regexp_count("marker", F.lit(r"\.")) + 1).otherwise(F.lit(1))
    groups = groups.select("*", deeper.alias("_deeper"), fixed.alias("_fixed"))
    groups = groups.withColumn("_base", F.sum(F.when(F.col("_deeper"), 0).otherwise(1)).over(w))
    in_base = Window.partitionBy("doc_id", "seg", "_base").orderBy("run")
    groups = groups.withColumn(
        "n_level", (F.first("_fixed").over(in_base) + F.row_number().over(in_base) - 1).cast("int")
    ).drop("_deeper", "_fixed", "_base")

    own = ["doc_id", "seg", "run"]
    marks = groups.filter(marked).select(*own, "n_level", title.alias("title"))
    levels = F.sequence(F.lit(1), F.col("n_level"))
    asked = marks.select(*own, "n_level", F.explode(levels).alias("level"), "title")
    mark = F.when(F.col("level") == F.col("n_level"), F.struct("run", "title"))
    in_level = Window.partitionBy("doc_id", "seg", "level").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.select(*own, "level", F.last(mark, True).over(in_level).alias("last")).filter("last is not null")
    lower = Window.partitionBy(*own).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    open_marks = found.withColumn("_newer", F.max("last.run").over(lower)).filter("_newer is null or _newer < last.run")
    paths = open_marks.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("level", F.col("last.title").alias("title")))).alias("numbered"))
    none = F.array().cast("array<struct<level:int,title:string>>")
    return groups.join(paths, own, "left").withColumn("numbered", F.coalesce("numbered", none))


def toc_of(rows: DataFrame) -> DataFrame:
    """Table of contents of an outline: one row per heading or marker, numbered per document."""
    by_pos = Window.partitionBy("doc_id").orderBy("first_pos")
    return rows.filter("entry").select(
        "doc_id",
        F.row_number().over(by_pos).alias("toc_no"),
        "level",
        F.try_element_at("heading_path", F.lit(-1)).alias("title"),
        "heading_path",
    )


def blocks_of(rows: DataFrame) -> DataFrame:
    """Text blocks of an outline: runs with a non-empty body."""
    return rows.filter(F.col("text") != "").drop("entry")


def split_headings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markdown headings."""
    rows = outline(docs, "heading")
    return toc_of(rows), blocks_of(rows)


def split_numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markdown headings plus list markers below them."""
    rows = outline(docs, "heading_plus_numbered")
    return toc_of(rows), blocks_of(rows)


def split_legal(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapters, sections and articles, then list markers."""
    rows = outline(docs, "legal")
    return toc_of(rows), blocks_of(rows)


def split_blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4: table and text runs below markdown headings."""
    rows = outline(docs, "block")
    return toc_of(rows), blocks_of(rows)


def split_corpus(docs: DataFrame, default: str = "heading") -> DataFrame:
    """Outline of a mixed corpus.

    ``docs`` carries ``mode`` per document (from its domain's configuration);
    ``.txt`` files are always legal text.
    """
    mode = F.when(F.lower("source_path").endswith(".txt"), "legal").otherwise(
        F.coalesce(X.falsy_null("mode"), F.lit(default))
    )
    return outline(docs.withColumn("mode", F.when(mode.isin(*MODES), mode).otherwise(default)))


def pack(col: Column | str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Text as an array of parts of at most ``max_chars``.

    Paragraphs are packed greedily; a paragraph longer than a part is cut into
    overlapping windows and always stands alone. Every paragraph points to the
    first that no longer fits into a part it begins, found by bisection of the
    running lengths; the parts begin where the pointers lead from the first
    paragraph, found by doubling. So n paragraphs take n log n steps.
    """
    c = F.col(col) if isinstance(col, str) else col
    paragraphs = F.filter(
        F.transform(F.split(c, f"\n[{X.WS}]*\n"), lambda p: X.strip(p)), lambda p: p != ""
    )
    wide = lambda p: F.length(p) > max_chars

    def windows(para: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(para) - overlap - 1, F.lit(0)), F.lit(max_chars - overlap))
        return F.transform(starts, lambda s: F.substring(para, s + 1, F.lit(max_chars)))

    def packed(paras: Column) -> Column:
        # offsets in the text of all paragraphs with a blank line between them
        lengths = F.transform(paras, lambda p: F.length(p).cast("long") + 2)
        starts = X.running_sums(F.concat(F.array(F.lit(0).cast("long")), lengths))
        return X.let(starts, lambda at: X.let(pointers(at), lambda jumps: parts(paras, jumps)))

    def pointers(at: Column) -> Column:
        """Per paragraph the next part's first one, and at the end the number of paragraphs, which points to itself."""
        n = F.size(at) - 1
        bits = F.sequence(F.ceil(F.log2(F.size(at))).cast("int"), F.lit(0))

        def first_beyond(start: Column, i: Column) -> Column:
            def bisect(low: Column, k: Column) -> Column:
                probe = low + X.power_of_two(k)
                return F.when((probe <= n) & (F.get(at, probe) <= start + max_chars + 2), probe).otherwise(low)

            return F.greatest(F.least(i + 1, n), F.aggregate(bits, F.lit(0), bisect))

        return F.transform(at, first_beyond)

    def parts(paras: Column, jumps: Column) -> Column:
        n = F.size(jumps) - 1
        depth = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(jumps))).cast("int"), F.lit(1)))
        last = lambda acc: F.element_at(acc, -1)
        doubled = F.aggregate(depth, F.array(jumps), lambda acc, _: F.concat(acc, F.array(F.transform(last(acc), lambda x: F.get(last(acc), x)))))

        def begins(table: Column) -> Column:
            every = F.sequence(F.lit(0), F.size(table) - 1)
            lead = lambda t: F.aggregate(
                every, F.lit(0), lambda at, k: F.when(F.floor(t / X.power_of_two(k)) % 2 == 1, F.get(F.get(table, k), at)).otherwise(at)
            )
            return F.filter(F.transform(F.sequence(F.lit(0), n), lead), lambda b: b < n)

        def part(b: Column) -> Column:
            alone = F.get(paras, b)
            whole = F.array(F.array_join(F.slice(paras, b + 1, F.get(jumps, b) - b), "\n\n"))
            return F.when(wide(alone), windows(alone)).otherwise(whole)

        return X.let(doubled, lambda table: F.flatten(F.transform(begins(table), part)))

    some = X.let(paragraphs, lambda paras: F.when(F.size(paras) > 0, packed(paras)).otherwise(F.array().cast("array<string>")))
    return F.when(F.length(c) <= max_chars, F.array(c)).otherwise(some)


def make_pages(blocks: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Logical pages with numbers, ids, term lists and the text to index.

    ``blocks`` carries ``domain``, ``title``, ``source_path`` and, for
    documents kept whole per heading, ``mode`` = ``heading``.
    """
    whole = (F.col("mode") == "heading") if "mode" in blocks.columns else F.lit(False)
    parts = F.when(whole, F.array("text")).otherwise(pack("text", max_chars, overlap))
    rows = blocks.select(
        *[c for c in blocks.columns if c != "text"], F.posexplode(parts).alias("part_index", "text")
    )
    order = Window.partitionBy("doc_id").orderBy("first_pos", "part_index")
    rows = rows.select("*", *[v.alias(k) for k, v in E.page_terms("text").items()])
    rows = rows.withColumn("page_no", F.row_number().over(order))
    joined = [F.array_join(c, " ") for c in ("heading_path", "clause_ids", "table_headers", "dates", "numbers")]
    index_text = F.concat_ws("\n", *[X.falsy_null(c) for c in [F.col("title"), *joined, F.col("text")]])
    return rows.select(
        "doc_id",
        "domain",
        "source_path",
        F.format_string("%s_lp_%04d", F.col("doc_id").cast("string"), "page_no").alias("page_id"),
        "page_no",
        F.lit(True).alias("logical_page"),
        "kind",
        "title",
        "heading_path",
        "level",
        "text",
        index_text.alias("index_text"),
        "char_start",
        "char_end",
        "part_index",
        "clause_ids",
        "dates",
        "numbers",
        "table_headers",
    )
