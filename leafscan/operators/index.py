"""Index tables: documents, catalog, section tree, outlines, profiles and the BM25 index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import text as X

PATH_SEP = " > "


def heading_text(col: Column | str = "heading_path") -> Column:
    return F.array_join(col, PATH_SEP)


# --- D3, D4 ---------------------------------------------------------------


def stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def doc_id_of(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"\.md$"), F.regexp_replace(name, r"(?:_no_images)?\.md$", "")).otherwise(stem(path))


def domain_of(path: Column, root: str = "") -> Column:
    """Folder below ``raw_md`` or ``raw``, first inside the root, then in the whole path."""
    base = root.rstrip("/") + "/" if root else ""
    rel = F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path) if base else path

    def after(parts: Column, marker: str) -> Column:
        at = F.array_position(parts, marker).cast("int")
        return F.when((at > 0) & (at < F.size(parts)), F.try_element_at(parts, at + 1))

    def split(col: Column) -> Column:
        return F.filter(F.split(col, "/"), lambda x: x != "")

    first = F.when(F.size(split(rel)) > 1, F.element_at(split(rel), 1)).otherwise("unknown")
    picks = [after(split(p), m) for p in (rel, path) for m in ("raw_md", "raw")]
    return F.coalesce(*picks, first)


def title_of(path: Column, first_heading: Column) -> Column:
    versioned = X.strip(F.regexp_extract(stem(path), r"^strict_v\d+_\d+_(.+)$", 1))
    heading = X.strip(X.repair(first_heading, "index"))
    return F.coalesce(X.falsy_null(versioned), X.falsy_null(heading), stem(path))


def doc_identity(files: DataFrame, toc: DataFrame, root: str = "") -> DataFrame:
    """D3: ``files(doc_id, source_path)`` with domain and title."""
    first = toc.groupBy("doc_id").agg(F.min_by("title", "toc_no").alias("first_heading"))
    return files.join(first, "doc_id", "left").select(
        *[c for c in files.columns if c not in ("domain", "title")],
        domain_of(F.col("source_path"), root).alias("domain"),
        title_of(F.col("source_path"), F.col("first_heading")).alias("title"),
    )


# Endings of organisation names.
ORG_SUFFIX = "股份有限公司|集团有限公司|有限责任公司|有限公司|公司|银行|证券|保险|基金|集团"
ORG_NAME = rf"[{X.CJK}A-Za-z0-9（）()·\-]{{2,80}}(?:{ORG_SUFFIX})"


def alias_list(title: Column, path: Column, headings: Column, first_text: Column) -> Column:
    """Names a document goes by; ``headings`` in order."""
    fixed = X.repair(title, "index")
    joined = F.concat_ws(
        "\n", fixed, stem(path), F.array_join(F.slice(headings, 1, 30), "\n"), F.substring(first_text, 1, 1800)
    )
    return X.unique_compact(
        F.concat(
            F.array(fixed, stem(path)),
            E.find_all(joined, "《([^》]{3,120})》", 1),
            E.find_all(joined, ORG_NAME),
            F.slice(headings, 1, 12),
        ),
        24,
    )


# --- E1, E2 ---------------------------------------------------------------


def documents_idx(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Page counts and the hash of the normalised text."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    return docs.join(counts, "doc_id", "left").select(
        "doc_id",
        "domain",
        "title",
        "source_path",
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        X.stable_id("text", 16).alias("content_hash"),
    )


def doc_catalog(documents: DataFrame, toc: DataFrame, pages: DataFrame) -> DataFrame:
    """One routing row per document."""
    # only page 1 carries text into the aggregate
    first = pages.groupBy("doc_id").agg(
        F.min_by(F.struct("page_id", F.col("text").alias("text")), "page_no").alias("first")
    )
    heads = toc.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("toc_no", "level", "title"))).alias("heads")
    )
    none = F.array().cast("array<string>")
    titles = F.coalesce(F.transform("heads", lambda h: h["title"]), none)
    top = F.coalesce(
        F.transform(F.filter("heads", lambda h: F.coalesce(F.nullif(h["level"], F.lit(0)), F.lit(1)) <= 2), lambda h: h["title"]),
        none,
    )
    first_text = X.repair(F.coalesce("first.text", F.lit("")), "index")
    title = F.coalesce(X.falsy_null("title"), F.col("doc_id").cast("string"))
    return (
        documents.join(first, "doc_id", "left")
        .join(heads, "doc_id", "left")
        .select(
            "doc_id",
            "domain",
            title.alias("title"),
            X.repair(title, "index").alias("title_fixed"),
            "source_path",
            "page_count",
            alias_list(title, F.coalesce("source_path", F.lit("")), titles, first_text).alias("aliases"),
            X.unique_compact(top, 60).alias("top_headings"),
            F.coalesce("first.page_id", F.lit("")).alias("first_page_id"),
            X.clip(first_text, 500, "suffix").alias("first_page_preview"),
        )
    )


# --- E3-E6 ----------------------------------------------------------------


def _prefixes(path: Column, upto: Column) -> Column:
    return F.when(upto > 0, F.transform(F.sequence(F.lit(1), upto), lambda n: F.slice(path, 1, n)))


def section_rows(toc: DataFrame) -> DataFrame:
    """One row per distinct heading path, named after its first table-of-contents line."""
    return (
        toc.filter(F.size("heading_path") > 0)
        .groupBy("doc_id", "heading_path")
        .agg(F.min_by(F.struct("toc_no", "level", "title"), "toc_no").alias("t"))
        .select(
            F.format_string("%s_sec_%04d", F.col("doc_id").cast("string"), "t.toc_no").alias("section_id"),
            "doc_id",
            "t.toc_no",
            "t.level",
            "t.title",
            "heading_path",
        )
    )


def section_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Bridge: the pages at or below a section; prefixes make the tree test an equality."""
    spread = pages.select(
        "doc_id",
        "page_id",
        "page_no",
        F.size("heading_path").alias("depth"),
        F.explode(_prefixes(F.col("heading_path"), F.size("heading_path"))).alias("heading_path"),
    )
    return spread.join(sections.select("section_id", "toc_no", "doc_id", "heading_path"), ["doc_id", "heading_path"]).select(
        "section_id", "doc_id", "toc_no", "page_id", "page_no", (F.size("heading_path") == F.col("depth")).alias("is_exact")
    )


def sections(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections with pages, preview, parent and children."""
    rows = section_rows(toc)
    bridge = section_pages(rows, pages)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page_id"))), lambda x: x["page_id"])
    exact_ids = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("is_exact"), F.struct("page_no", "page_id")))), lambda x: x["page_id"]
    )
    lists = bridge.groupBy("section_id").agg(exact_ids.alias("page_ids"), ids.alias("descendant_page_ids"))

    # Only the two pages a preview shows bring their text (262 squeezed characters each decide the cut).
    w = Window.partitionBy("section_id").orderBy(F.desc("is_exact"), "page_no")
    has_exact = F.max("is_exact").over(Window.partitionBy("section_id"))
    shown = (
        bridge.withColumn("has_exact", has_exact)
        .filter(F.col("is_exact") | ~F.col("has_exact"))
        .withColumn("rn", F.row_number().over(w))
        .filter("rn <= 2")
    )
    heads = shown.join(pages.select("page_id", F.substring(X.squeeze("text"), 1, 262).alias("head")), "page_id")
    preview = heads.groupBy("section_id").agg(
        X.clip(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "head"))), lambda x: x["head"]), " "),
            260,
            "suffix",
        ).alias("preview")
    )
    none = F.array().cast("array<string>")
    out = (
        rows.join(lists, "section_id", "left")
        .join(preview, "section_id", "left")
        .select(
            *rows.columns,
            F.coalesce("page_ids", none).alias("page_ids"),
            F.coalesce("descendant_page_ids", none).alias("descendant_page_ids"),
            F.coalesce("preview", F.lit("")).alias("preview"),
        )
    )
    links = section_links(rows)
    children = links.filter(F.col("parent_id") != "").groupBy("parent_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("toc_no", "section_id"))), lambda x: x["section_id"]).alias("children_ids")
    )
    return (
        out.join(links.select("section_id", "parent_id"), "section_id")
        .join(children.withColumnRenamed("parent_id", "section_id"), "section_id", "left")
        .withColumn("children_ids", F.coalesce("children_ids", none))
    )


def section_ancestors(rows: DataFrame) -> DataFrame:
    """Every existing strict-prefix section of a section, with its depth."""
    spread = rows.select(
        "section_id",
        "toc_no",
        "doc_id",
        F.explode(_prefixes(F.col("heading_path"), F.size("heading_path") - 1)).alias("heading_path"),
    )
    above = rows.select("doc_id", "heading_path", F.col("section_id").alias("ancestor_id"))
    return spread.join(above, ["doc_id", "heading_path"]).select(
        "section_id", "toc_no", "doc_id", "ancestor_id", F.size("heading_path").alias("depth")
    )


def section_links(rows: DataFrame) -> DataFrame:
    """Nearest existing ancestor of every section (empty for roots)."""
    parents = section_ancestors(rows).groupBy("section_id").agg(F.max_by("ancestor_id", "depth").alias("parent_id"))
    return rows.select("section_id", "doc_id", "toc_no").join(parents, "section_id", "left").select(
        "section_id", "doc_id", "toc_no", F.coalesce("parent_id", F.lit("")).alias("parent_id")
    )


def section_walk(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """E5: roots of every document, and children and ancestors of the seed sections."""
    links = section_links(rows)
    seeds = seeds.select("section_id").distinct()
    roots = links.filter(F.col("parent_id") == "").select("doc_id", F.lit("root").alias("relation"), F.lit(None).cast("string").alias("seed_id"), "section_id")
    children = links.join(seeds.withColumnRenamed("section_id", "parent_id"), "parent_id").select(
        "doc_id", F.lit("child").alias("relation"), F.col("parent_id").alias("seed_id"), "section_id"
    )
    above = section_ancestors(rows).join(seeds, "section_id", "left_semi").select(
        "doc_id", F.lit("ancestor").alias("relation"), F.col("section_id").alias("seed_id"), F.col("ancestor_id").alias("section_id")
    )
    return roots.unionByName(children).unionByName(above)


def pages_by_heading(pages: DataFrame) -> DataFrame:
    """Pages per heading key of a document; pages without a heading have no key."""
    return pages.select("doc_id", heading_text().alias("heading"), "page_no", "page_id").filter("heading <> ''").groupBy("doc_id", "heading").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page_id"))), lambda x: x["page_id"]).alias("page_ids")
    )


def listed_headings(pages: DataFrame, max_keys: int = 80) -> DataFrame:
    """The first heading keys of each document in key order, for printed lists."""
    keys = pages.select("doc_id", heading_text().alias("heading")).filter("heading <> ''").distinct()
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("heading"))
    return keys.withColumn("key_no", rank).filter(F.col("key_no") <= max_keys)


# --- E9, A10, A11, E12, E13 ------------------------------------------------


def doc_outline(catalog: DataFrame, pages: DataFrame, max_headings: int = 80) -> DataFrame:
    """Distinct heading paths in page order with their first page."""
    n = max(1, min(max_headings, 300))
    first = (
        pages.filter(F.size("heading_path") > 0)
        .groupBy("doc_id", "heading_path")
        .agg(F.min("page_no").alias("page_no"), F.min_by("page_id", "page_no").alias("page_id"))
    )
    w = Window.partitionBy("doc_id").orderBy("page_no")
    top = first.withColumn("heading_no", F.row_number().over(w)).filter(F.col("heading_no") <= n)
    return (
        catalog.select("domain", "doc_id", F.col("title_fixed").alias("title"), "page_count")
        .join(top.withColumn("headings_truncated", F.max("heading_no").over(Window.partitionBy("doc_id")) >= n), "doc_id")
        .select("domain", "doc_id", "title", "page_count", "heading_no", "page_id", "heading_path", "headings_truncated")
    )


def _ordered_lines(order: str, line: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))), lambda x: x["line"]), "\n")


def toc_text(toc: DataFrame) -> DataFrame:
    """A10: indented outline per document."""
    line = F.concat(F.expr("repeat('  ', greatest(0, level - 1))"), F.lit("- "), F.col("title"))
    return toc.groupBy("doc_id").agg(_ordered_lines("toc_no", line).alias("outline"))


def tree_text(section_table: DataFrame, max_lines: int | None = None) -> DataFrame:
    """A10: ``section id | level | path`` lines per document."""
    line = F.concat(F.col("section_id"), F.lit(" | L"), F.col("level").cast("string"), F.lit(" | "), heading_text())
    rows = section_table
    if max_lines:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("toc_no"))).filter(F.col("_n") <= max_lines)
    return rows.groupBy("doc_id").agg(_ordered_lines("toc_no", line).alias("tree"))


def page_preview(pages: DataFrame) -> DataFrame:
    """Short per-page listing."""
    head = F.when(F.size("heading_path") > 0, heading_text()).otherwise("(no heading)")
    return pages.select(
        "doc_id",
        "page_id",
        "page_no",
        "kind",
        head.alias("heading"),
        *[F.array_join(F.slice(c, 1, n), ", ").alias(c) for c, n in (("clause_ids", 8), ("dates", 8), ("numbers", 12), ("table_headers", 12))],
        X.clip("text", 220, "suffix").alias("preview"),
    )


# Words that mark a contents page.
CONTENTS_TERMS = ("目录", "图表目录", "内容目录")


def doc_profile(documents: DataFrame, trees: DataFrame, pages: DataFrame, max_chars: int = 420) -> DataFrame:
    """Title, file stem, tree text and the opening pages, cut at ``max_chars``."""
    heading = heading_text()
    contents = F.concat_ws("\n", F.col("title"), heading).rlike("目录")
    order = Window.partitionBy("doc_id").orderBy("page_no")
    rows = pages.select(
        "doc_id",
        "page_no",
        contents.alias("contents"),
        F.array(F.coalesce("title", F.lit("")), heading, F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.when(contents, 520).otherwise(180))).alias("parts"),
    ).withColumn("rank", F.row_number().over(order))
    late = F.sum(F.when((F.col("rank") > 3) & F.col("contents"), 1).otherwise(0)).over(order)
    rows = rows.withColumn("late", late).filter((F.col("rank") <= 3) | (F.col("contents") & (F.col("late") <= 3)))
    joined = rows.groupBy("doc_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "parts"))), lambda x: x["parts"])).alias("parts")
    )
    none = F.array().cast("array<string>")
    head = F.array("title", stem(F.col("source_path")), F.substring("tree", 1, 1200))
    body = F.filter(F.concat(head, F.coalesce("parts", none)), lambda x: F.coalesce(x, F.lit("")) != "")
    return (
        documents.select("doc_id", "domain", "title", "source_path")
        .join(trees.select("doc_id", "tree"), "doc_id", "left")
        .join(joined, "doc_id", "left")
        .select("doc_id", "domain", "title", "source_path", F.substring(X.compact_text(F.array_join(body, " ")), 1, max_chars).alias("profile"))
    )


def catalog_profile(catalog: DataFrame, max_chars: int = 2200, aliases: int = 14, headings: int = 24, fix: bool = False) -> DataFrame:
    """Labelled catalog fields on one line."""

    def fixed(c: Column) -> Column:
        return X.repair(c) if fix else c

    def joined(col: str, n: int) -> Column:
        items = F.slice(col, 1, n)
        if fix:
            items = F.transform(F.filter(items, lambda x: x != ""), lambda x: X.repair(x))
        return F.array_join(items, "；")

    title = F.coalesce(X.falsy_null("title_fixed"), F.col("title"), F.lit(""))
    text = F.concat(
        F.lit("title="), fixed(title),
        F.lit(" aliases="), joined("aliases", aliases),
        F.lit(" top_headings="), joined("top_headings", headings),
        F.lit(" first_page="), F.substring(fixed(F.coalesce("first_page_preview", F.lit(""))), 1, 260),
    )
    return catalog.select("doc_id", "domain", title.alias("title"), F.substring(X.squeeze(text), 1, max_chars).alias("profile"))


def catalog_text(catalog: DataFrame) -> DataFrame:
    """Title, aliases, headings and preview as one searchable text."""
    parts = [
        F.coalesce(X.falsy_null("title_fixed"), F.col("title"), F.lit("")),
        F.array_join("aliases", " "),
        F.array_join("top_headings", " "),
        F.coalesce("first_page_preview", F.lit("")),
    ]
    return catalog.select("*", F.concat_ws(" ", *[X.repair(p) for p in parts]).alias("profile"))


def toc_for_docs(section_table: DataFrame, pages: DataFrame, max_lines: int = 120) -> DataFrame:
    """Tree lines of a document, or its heading list when it has no tree."""
    tree = tree_text(section_table, max_lines)
    keys = listed_headings(pages, max_lines)
    listed = keys.groupBy("doc_id").agg(_ordered_lines("key_no", F.concat(F.lit("- "), F.col("heading"))).alias("listed"))
    return (
        tree.join(listed, "doc_id", "full")
        .select("doc_id", F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("tree", "listed")).alias("toc"))
    )


# --- E10 ------------------------------------------------------------------


def page_tokens(
    pages: DataFrame, text: str = "index_text", keys: tuple[str, ...] = ("domain", "doc_id", "page_id", "page_no"), buckets: int | None = None
) -> DataFrame:
    """Tokens per page, clustered by page so that counting them needs no further shuffle.

    A table that is already bucketed by page, in ``buckets``, is read as it lies.
    """
    dealt = pages if buckets else pages.repartition("page_id")
    return dealt.select(*keys, X.tokenize(text).alias("tokens"))


def cut_texts(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of ``pages(keys, texts)``: a row per key and number of tokens ``dl``, over ``rows`` of its texts."""

    def sized(all_: Column) -> Column:
        same = lambda n: F.filter(all_, lambda a: F.size(a) == n)
        one = lambda n: X.let(same(n), lambda s: F.struct(n.alias("dl"), F.size(s).alias("rows"), F.flatten(s).alias("tokens")))
        return F.transform(F.array_distinct(F.transform(all_, lambda a: F.size(a))), one)

    cut = X.let(F.transform("texts", lambda t: X.tokenize(t)), sized)
    return pages.select(*keys, F.explode(cut).alias("_cut")).select(*keys, "_cut.dl", "_cut.rows", "_cut.tokens")


def bm25_index(pages: DataFrame, text: str = "index_text") -> dict[str, DataFrame]:
    """Postings, page lengths, term and corpus statistics per domain."""
    tokens = page_tokens(pages, text)
    page_len = tokens.select("domain", "doc_id", "page_id", "page_no", F.size("tokens").alias("dl"))
    postings = (
        tokens.select("domain", "doc_id", "page_id", "page_no", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        .groupBy("domain", "doc_id", "page_id", "page_no", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )
    corpus = page_len.groupBy("domain").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("domain", "term").agg(F.count("*").alias("df"))
    terms = df.join(corpus, "domain").select("domain", "term", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    return {"postings": postings, "page_len": page_len, "term_stats": terms, "corpus_stats": corpus}


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


K1 = 1.5
B = 0.75


def saturation() -> Column:
    """What a term's frequency in a page makes of its weight, from ``tf, dl, avgdl``."""
    tf, dl = F.col("tf"), F.when(F.col("dl") == 0, 1).otherwise(F.col("dl"))
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
