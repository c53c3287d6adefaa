"""Section-guided retrieval.

``requests(qid, domain, doc_id, query)`` asks one query of one document;
``sections`` is the section tree (E3), ``bridge`` its page table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import text as X
from leafscan.operators import index as I
from leafscan.operators import search as Q
from leafscan.operators.stored_index import StoredIndex
from leafscan.session import cut_lineage, measure

MIN_PAGE_CHARS = 20
CONTEXT_PER_SECTION = 3
CONTEXT_TOTAL = 6


# --- D26 ------------------------------------------------------------------------

# Wording of contents, contact and disclaimer pages, and of summaries.
LOW_VALUE_TERMS = ("内容目录", "图表目录", "目录", "联系人", "联系方式", "公司基本数据", "评级说明", "免责声明", "法律声明")
SUMMARY_TERMS = ("投资要点", "核心观点", "报告摘要", "摘要", "核心结论", "主要观点", "行业观点", "事件点评", "首页")
CONTENTS_TITLES = ("内容目录", "图表目录")
ANCHOR_ENDINGS = ("为：", "为:", "公式：", "公式:", "如下：", "如下:", "其中：", "其中:", "下表：", "下表:", "下列：", "下列:", "如下")
ANCHOR_PHRASES = (
    "比例为", "数值为", "标准为", "如下", "见下表", "下表", "下列", "以下公式", "如下公式", "按照以下公式", "按以下公式", "计算并给付", "计算公式",
)


def is_heading_only(text: Column, path: Column) -> Column:
    """Pages that merely repeat their heading."""

    def test(body: Column) -> Column:
        heading = X.compact_text(I.heading_text(path))
        return (F.length(body) < MIN_PAGE_CHARS) | X.let(heading, lambda h: (h != "") & F.endswith(h, body))

    return X.let(X.compact_text(text), test)


def is_low_value(text: Column, path: Column) -> Column:
    """Contents, contacts, disclaimers, dotted leaders."""
    head = X.compact_text(F.substring(text, 1, 180))
    surface = F.concat_ws(" ", X.compact_text(I.heading_text(path)), head)
    return X.let(surface, lambda s: s.rlike("|".join(LOW_VALUE_TERMS))) | (F.regexp_count(head, F.lit(r"\.{16}")) >= 2)


def is_summary_like(page_no: Column, text: Column, path: Column, title: Column, index_text: Column) -> Column:
    """Summary wording, or one of the first two pages with a body."""
    surface = F.concat_ws(" ", I.heading_text(path), F.coalesce(title, F.lit("")), F.coalesce(index_text, F.lit("")), F.coalesce(text, F.lit("")))
    worded = X.compact_text(F.substring(X.repair(surface), 1, 1200)).rlike("|".join(SUMMARY_TERMS))
    return worded | ((page_no <= 2) & ~is_heading_only(text, path))


def is_open_anchor(text: Column) -> Column:
    """Short text that announces a formula or table but does not hold it."""

    def test(t: Column) -> Column:
        low = F.lower(t)
        tabled = low.rlike("</?table") | (F.regexp_count(low, F.lit("<tr")) >= 2)

        def anchored(c: Column) -> Column:
            tail = F.substring(c, -40, 40)
            ends = c.rlike(f"(?:{'|'.join(ANCHOR_ENDINGS)})$")
            phrase = tail.rlike("|".join(ANCHOR_PHRASES)) & ~tail.rlike(r"\p{Nd}+%|</?td>")
            return (c != "") & (F.length(c) <= 180) & (ends | phrase)

        return ~tabled & X.let(F.regexp_replace(t, f"[{X.WS}]+", ""), anchored)

    return X.let(X.strip(X.repair(F.coalesce(text, F.lit("")))), test)


# --- F9-F11 ---------------------------------------------------------------------


def section_score(requests: DataFrame, sections: DataFrame, variant: str = "heading") -> DataFrame:
    """weighted token overlap of queries with the sections of their document.

    ``heading`` 4 per shared heading token; ``tree`` adds 1 per shared preview
    token; ``sample`` 3 per heading token and 1 per token of the opening pages.
    """
    heading = I.heading_text() if variant == "sample" else F.array_join("heading_path", " ")
    if variant == "heading":
        parts = [(heading, 4.0)]
    elif variant == "tree":
        parts = [(heading, 4.0), (F.col("preview"), 1.0)]
    elif variant == "sample":
        parts = [(heading, 3.0), (F.col("sample"), 1.0)]
    else:
        raise ValueError(f"unknown section score {variant}")
    # token sets meet by document, a row per request and section: rows per token would be many times the text
    asked = requests.select("qid", "doc_id", X.token_set("query").alias("_asked"))
    held = sections.select("doc_id", "section_id", "toc_no", *[X.token_set(text).alias(f"_held{i}") for i, (text, _) in enumerate(parts)])
    score = sum((X.overlap(F.col("_asked"), F.col(f"_held{i}")) * weight for i, (_, weight) in enumerate(parts)), F.lit(0.0))
    rated = asked.join(held, "doc_id").select("qid", "doc_id", "section_id", "toc_no", F.explode(F.array(score)).alias("score"))
    return rated.filter("score > 0").groupBy("qid", "doc_id", "section_id", "toc_no").agg(F.sum("score").alias("score"))


def heading_sections(pages: DataFrame) -> DataFrame:
    """Pages grouped by heading as sections with a sample of their first three pages."""
    # only the head of a text is exchanged
    heads = pages.select("doc_id", I.heading_text().alias("section_id"), "page_no", "heading_path", F.substring("index_text", 1, 300).alias("head"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy("page_no"))
    first = heads.withColumn("_n", rank).filter("_n <= 3")
    rows = first.groupBy("doc_id", "section_id").agg(
        F.min("page_no").alias("toc_no"), F.first("heading_path").alias("heading_path"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_n", X.repair("head").alias("head")))), lambda x: x["head"]), "\n"
        ).alias("sample"),
    )
    return rows


def select_sections(scores: DataFrame, n: int = 3) -> DataFrame:
    """the n best sections per (query, document), in section order on ties."""
    rank = Q.rank_by(["qid", "doc_id"], F.desc("score"), F.col("toc_no"))
    return scores.filter("score > 0").withColumn("section_rank", rank).filter(F.col("section_rank") <= n)


def resolve_sections(choices: DataFrame, sections: DataFrame, fallback: DataFrame, n: int = 3) -> DataFrame:
    """``choices(qid, doc_id, pos, section_id)`` that exist, unique, at most n; where none is left, ``fallback``."""
    known = choices.join(sections.select("doc_id", "section_id", "toc_no"), ["doc_id", "section_id"])
    first = known.groupBy("qid", "doc_id", "section_id", "toc_no").agg(F.min("pos").alias("pos"))
    rank = Q.rank_by(["qid", "doc_id"], F.col("pos"))
    kept = first.withColumn("section_rank", rank).filter(F.col("section_rank") <= n).select("qid", "doc_id", "section_id", "toc_no", "section_rank")
    rest = fallback.join(kept.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_anti")
    return kept.unionByName(rest.select(*kept.columns))


# --- F12, F13 -------------------------------------------------------------------


def section_context(chosen: DataFrame, bridge: DataFrame, pages: DataFrame, per_section: int = CONTEXT_PER_SECTION, total: int = CONTEXT_TOTAL) -> DataFrame:
    """opening pages of the chosen sections: few per section, few in total, none twice.

    A section can only lose pages to the sections before it, so the first
    ``per_section * rank`` pages of each decide; the greedy pick runs over those.
    """
    usable = pages.filter(~is_heading_only(F.col("text"), F.col("heading_path"))).select("page_id")
    listed = chosen.select("qid", "doc_id", "section_id", "section_rank").join(
        bridge.select("section_id", "doc_id", "page_id", "page_no"), ["section_id", "doc_id"]
    ).join(usable, "page_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("qid", "doc_id", "section_rank").orderBy("page_no"))
    near = listed.withColumn("_n", place).filter(F.col("_n") <= per_section * F.col("section_rank"))
    grouped = near.groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("section_rank", "page_no", "page_id"))).alias("rows"))
    empty = F.array().cast("array<struct<section_rank:int,page_no:int,page_id:string>>")

    def step(acc: Column, row: Column) -> Column:
        taken = F.size(F.filter(acc, lambda a: a["section_rank"] == row["section_rank"]))
        seen = F.exists(acc, lambda a: a["page_id"] == row["page_id"])
        add = (taken < per_section) & (F.size(acc) < total) & ~seen
        one = F.array(F.struct(row["section_rank"].cast("int").alias("section_rank"), row["page_no"].cast("int").alias("page_no"), row["page_id"].alias("page_id")))
        return F.when(add, F.concat(acc, one)).otherwise(acc)

    return grouped.select("qid", "doc_id", F.posexplode(F.aggregate("rows", empty, step)).alias("pos", "p")).select(
        "qid", "doc_id", (F.col("pos") + 1).alias("context_no"), "p.page_id", "p.page_no", "p.section_rank"
    )


def section_search(
    requests: DataFrame,
    pages: DataFrame | StoredIndex,
    sections: DataFrame,
    bridge: DataFrame,
    k: int = 4,
    n: int = 3,
    text: str = "index_text",
) -> DataFrame:
    """page hits inside the best sections, falling back tier by tier.

    Tier 1 heading sections, 2 headings with previews, 3 heading groups, 4 the
    whole document. A tier wins for a (query, document) if it has hits, or for
    the first two if it has context pages. All tiers share one scoring pass.
    """
    batch = measure(requests)
    requests = requests.dropDuplicates(["qid", "doc_id"])
    scores = Q.bm25(requests.select("qid", "domain", "query").distinct(), pages, requests, text, batch).select(
        "qid", "doc_id", "page_id", "page_no", "score"
    )
    pages = Q.page_rows(pages)
    by_heading = pages.select("doc_id", I.heading_text().alias("section_id"), "page_id", "page_no")
    tiers = []
    for tier, rows, table, variant in (
        (1, sections, bridge, "heading"), (2, sections, bridge, "tree"), (3, heading_sections(pages), by_heading, "sample"),
    ):
        chosen = select_sections(section_score(requests, rows, variant), n)
        inside = chosen.join(table.select("section_id", "doc_id", "page_id"), ["section_id", "doc_id"]).select("qid", "doc_id", "page_id").distinct()
        hits = _tier(scores.join(inside, ["qid", "doc_id", "page_id"], "left_semi"), tier, k)
        tiers.append(hits)
        if tier < 3:
            context = section_context(chosen, table, pages)
            tiers.append(
                context.select("qid", "doc_id", "page_id", "page_no", F.lit(0.0).alias("score"), (F.col("context_no") + k).alias("rank"), F.lit(tier).alias("tier"))
            )
    tiers.append(_tier(scores, 4, k))
    out = tiers[0]
    for part in tiers[1:]:
        out = out.unionByName(part)
    best = F.min("tier").over(Window.partitionBy("qid", "doc_id"))
    won = out.withColumn("_best", best).filter("tier = _best").drop("_best")
    # a page that is both hit and context counts once, as a hit
    first = F.row_number().over(Window.partitionBy("qid", "doc_id", "page_id").orderBy("rank"))
    won = won.withColumn("_dup", first).filter("_dup = 1").drop("_dup")
    return won.withColumn("rank", Q.rank_by(["qid", "doc_id"], F.col("rank")))


def _tier(scores: DataFrame, tier: int, k: int) -> DataFrame:
    rank = Q.rank_by(["qid", "doc_id"], Q.by_score(), F.col("page_no"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("tier", F.lit(tier))


# --- F14-F16 --------------------------------------------------------------------

YEAR = r"(?:19|20)\p{Nd}{2}"
PERCENT = rf"\p{{Nd}}+(?:\.\p{{Nd}}+)?[{X.WS}]*%"


def without_blanks(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def found_in(items: Column, text: Column, weight: float, tight: bool = False) -> Column:
    """Weight times the listed strings that occur in a text (repeats count)."""
    hits = F.filter(items, lambda i: F.contains(text, without_blanks(i) if tight else i))
    return F.size(hits) * F.lit(weight)


def section_pages_ranked(chosen: DataFrame, sections: DataFrame, bridge: DataFrame, pages: DataFrame, n: int = 2) -> DataFrame:
    """best pages of ``chosen(qid, section_id, query)`` by overlap, years and percentages; else the section's title row."""
    asked = chosen.join(sections.select("section_id", "doc_id", "title", "heading_path", "preview"), "section_id")
    asked = asked.withColumn("asked", F.coalesce(X.falsy_null("query"), "title"))
    asked = cut_lineage(asked)
    listed = asked.join(bridge.select("section_id", "page_id"), "section_id")
    body = pages.join(listed.select("page_id").distinct(), "page_id", "left_semi").select(
        "page_id", "page_no", "text", F.col("heading_path").alias("page_path"), F.coalesce("index_text", F.lit("")).alias("index_text")
    )
    head = X.compact_text(F.concat_ws(" ", I.heading_text("page_path"), F.substring("text", 1, 80)))
    usable = ~is_heading_only(F.col("text"), F.col("page_path")) & ~head.rlike("|".join(CONTENTS_TITLES))
    surface = F.concat_ws(" ", I.heading_text("page_path"), "index_text", "text")
    # rules and tokens in one step behind the join: only pages that are asked for go through them, once
    rated = X.let(surface, lambda s: F.struct(s.alias("surface"), X.token_set(s).alias("tokens")))
    body = body.select("page_id", "page_no", "text", "page_path", F.explode(F.when(usable, F.array(rated))).alias("_rated"))
    body = body.select("page_id", "page_no", "text", "page_path", "_rated.surface", "_rated.tokens")
    rows = listed.join(body, "page_id")
    score = (
        X.overlap(X.token_set("asked"), F.col("tokens"))
        + found_in(E.find_all(F.coalesce("query", F.lit("")), YEAR), F.col("surface"), 2.0)
        + found_in(E.find_all(F.coalesce("query", F.lit("")), PERCENT), without_blanks(F.col("surface")), 3.0, True)
    )
    rows = rows.withColumn("score", score.cast("double"))
    rank = Q.rank_by(["qid", "section_id"], F.desc("score"), F.col("page_no"))
    top = rows.withColumn("rank", rank).filter(F.col("rank") <= n).select(
        "qid", "section_id", "doc_id", F.col("page_id").alias("evidence_id"), "page_id", "page_no", F.col("page_path").alias("heading_path"),
        X.repair("text").alias("text"), "score", "rank", F.lit("toc_repair").alias("source"),
    )
    top = cut_lineage(top)
    bare = asked.join(top.select("qid", "section_id").distinct(), ["qid", "section_id"], "left_anti")
    path = I.heading_text()
    preview = X.compact_text("preview")
    label = F.coalesce(X.falsy_null(path), F.col("title"))
    titles = bare.select(
        "qid", "section_id", "doc_id", F.concat("section_id", F.lit("_toc_title")).alias("evidence_id"), F.lit("").alias("page_id"),
        F.lit(0).alias("page_no"), "heading_path", F.concat_ws("\n", label, F.when((preview != "") & (preview != label), preview)).alias("text"),
        F.lit(0.0).alias("score"), F.lit(1).alias("rank"), F.lit("toc_repair_title").alias("source"),
    )
    return top.unionByName(titles)


# How a text refers to a heading.
POINTER = (
    rf"(?m)(?:^|[{X.WS}])(?:第[一二三四五六七八九十百千万\p{{Nd}}]+[章节条]|[一二三四五六七八九十]+[、.]|\p{{Nd}}+(?:\.\p{{Nd}}+){{1,100}}|"
    rf"[（(]\p{{Nd}}+[）)]|[①②③④⑤⑥⑦⑧⑨⑩])[{X.WS}]*[^。\n]{{1,40}}"
)


def either_contains(a: Column, b: Column) -> Column:
    """Two-way containment of non-empty keys."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def expand_pointers(evidence: DataFrame, sections: DataFrame, bridge: DataFrame, pages: DataFrame, n_sections: int = 3, n_pages: int = 2) -> DataFrame:
    """short evidence that names other sections of its document brings their opening pages.

    ``evidence(qid, evidence_id, doc_id, text, selected_section_ids)``. The
    containment test is blocked by document.
    """
    short = evidence.select("qid", "evidence_id", "doc_id", "selected_section_ids", X.compact_text("text").alias("body"))
    short = short.filter((F.length("body") > 0) & (F.length("body") <= 260))
    named = E.find_all(F.col("body"), POINTER)
    keys = F.transform(F.when(F.size(named) > 0, named).otherwise(F.array("body")), lambda x: X.match_key(x))
    short = short.select("qid", "evidence_id", "doc_id", "selected_section_ids", F.filter(keys, lambda k: k != "").alias("keys"))
    titles = sections.select("doc_id", "section_id", "toc_no", X.match_key("title").alias("k1"), X.match_key(I.heading_text()).alias("k2"))
    match = F.exists("keys", lambda k: either_contains(k, F.col("k1")) | either_contains(k, F.col("k2")))
    fresh = ~F.expr("coalesce(array_contains(selected_section_ids, section_id), false)")
    hits = short.join(titles, "doc_id").filter(fresh & match)
    hits = hits.withColumn("section_rank", Q.rank_by(["qid", "evidence_id"], F.col("toc_no"))).filter(F.col("section_rank") <= n_sections)
    usable = pages.filter(~is_heading_only(F.col("text"), F.col("heading_path"))).select("page_id", "heading_path", X.repair("text").alias("text"))
    listed = hits.select("qid", "evidence_id", "section_id", "section_rank").join(bridge.select("section_id", "doc_id", "page_id", "page_no"), "section_id")
    listed = listed.join(usable, "page_id")
    rank = Q.rank_by(["qid", "evidence_id", "section_id"], F.col("page_no"))
    return listed.withColumn("page_rank", rank).filter(F.col("page_rank") <= n_pages).select(
        "qid", F.col("evidence_id").alias("expanded_from"), F.col("section_id").alias("pointer_expanded_from"), "section_rank", "page_rank",
        F.col("page_id").alias("evidence_id"), "doc_id", "page_id", "page_no", "heading_path", "text", F.lit(0.0).alias("score"),
    )


def hint_search(hints: DataFrame, sections: DataFrame, bridge: DataFrame, pages: DataFrame, n: int = 3, text: str = "index_text") -> DataFrame:
    """F16: evidence for ``hints(qid, domain, doc_id, hint, query)``.

    First the ranked pages of two matching sections, then pages matching the
    hint themselves fill up to n; only hints without any go to BM25.
    """
    batch = measure(hints.select(F.concat_ws(" ", "hint", "query").alias("query")))
    keyed = hints.withColumn("key", X.match_key("hint")).filter("key <> ''")
    sides = F.array(X.match_key("title"), X.match_key(I.heading_text()), X.match_key(F.substring("preview", 1, 3000)))
    table = sections.select("doc_id", "section_id", "toc_no", "title", sides.alias("sides"))
    match = F.exists("sides", lambda s: either_contains(s, F.col("key")))
    # hints with the same key look once through their document; no hint can take more than the first few
    keys = cut_lineage(keyed.select("doc_id", "key").distinct())
    near = keys.join(table, "doc_id").filter(match).withColumn("_n", F.rank().over(Window.partitionBy("doc_id", "key").orderBy("toc_no")))
    near = near.filter("_n <= 2").drop("_n", "sides")
    found = keyed.join(near, ["doc_id", "key"])
    found = found.withColumn("section_rank", Q.rank_by(["qid"], F.col("toc_no"))).filter("section_rank <= 2")
    found = cut_lineage(found.filter(~X.compact_text("title").rlike("|".join(CONTENTS_TITLES))).select("qid", "section_id", "query", "section_rank"))
    ranked = section_pages_ranked(found.select("qid", "section_id", "query"), sections, bridge, pages, n).join(
        found.select("qid", "section_id", "section_rank"), ["qid", "section_id"]
    )
    cols = ["qid", "doc_id", "evidence_id", "page_id", "page_no", "heading_path", "text", "score", "source"]
    one = ranked.select(*cols, F.lit(1).alias("tier"), (F.col("section_rank") * 1000 + F.col("rank")).cast("bigint").alias("place"))

    page_sides = F.array(
        X.match_key(I.heading_text()), X.match_key("title"), X.match_key(F.substring(text, 1, 5000)), X.match_key(F.substring("text", 1, 5000))
    )
    # only numbers of pages go through the tests and ranks; the few that stay get their texts at the end
    body = pages.select("doc_id", "page_id", "page_no", page_sides.alias("sides"))
    near = keys.join(body, "doc_id").filter(match).withColumn("_n", F.rank().over(Window.partitionBy("doc_id", "key").orderBy("page_no")))
    near = near.filter(F.col("_n") <= 3 * n).select("doc_id", "key", "page_id", "page_no")
    two = keyed.select("qid", "doc_id", "key").join(near, ["doc_id", "key"])
    two = two.select(
        "qid", "doc_id", F.col("page_id").alias("evidence_id"), "page_id", "page_no", F.lit(0.0).alias("score"), F.lit("toc_repair_hint").alias("source"),
        F.lit(2).alias("tier"), F.col("page_no").cast("bigint").alias("place"),
    )
    two = two.withColumn("_n", Q.rank_by(["qid"], F.col("place"))).filter(F.col("_n") <= 3 * n).drop("_n")

    both = one.unionByName(two, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("qid", "evidence_id").orderBy("tier", "place"))
    both = both.withColumn("_dup", first)
    # repeats within the section pages stay, a hint page already there does not
    both = both.filter("tier = 1 OR _dup = 1").drop("_dup")
    both = both.withColumn("rank", Q.rank_by(["qid"], F.col("tier"), F.col("place"))).filter(F.col("rank") <= n)
    both = cut_lineage(both)
    named = both.filter("tier = 2").drop("heading_path", "text")
    place = ("doc_id", "page_id", "page_no")
    texts = pages.select(*[F.col(c).alias(f"_{c}") for c in place], "heading_path", X.repair("text").alias("text"))
    wanted = named.select(*place).distinct()
    at = (F.col("doc_id") == F.col("_doc_id")) & F.col("page_id").eqNullSafe(F.col("_page_id")) & F.col("page_no").eqNullSafe(F.col("_page_no"))
    texts = texts.join(wanted, at, "left_semi").groupBy("_doc_id", "_page_id", "_page_no").agg(F.min(F.struct("heading_path", "text")).alias("_body"))
    told = named.join(texts, at).select("*", "_body.heading_path", "_body.text")
    whole = both.filter("tier = 1").select(*cols, "tier", "rank").unionByName(told.select(*cols, "tier", "rank"))
    empty = hints.join(both.select("qid").distinct(), "qid", "left_anti")
    asked = empty.select("qid", "domain", "doc_id", F.concat_ws(" ", X.falsy_null("hint"), X.falsy_null("query")).alias("query"))
    rest = Q.retrieve_multi(asked, pages, n, "toc_repair_bm25", text, batch).withColumn("tier", F.lit(3))
    return whole.unionByName(rest.select(*cols, "tier", "rank"))
