"""Evidence scoring, expansion, packing and the batch retrieval rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import focus as C
from leafscan.functions import text as X
from leafscan.operators import index as I
from leafscan.operators import search as Q
from leafscan.operators import sections as S
from leafscan.session import cut_lineage

INITIAL_K = 4
FOLLOWUP_K = 3
REVIEW_SOURCES = 3
SUBSEARCH = {"min_chars": 1500, "max_snippets": 3, "size": 760}
INNER_MIN_CHARS = 1200

NUMBER = rf"\p{{Nd}}+(?:\.\p{{Nd}}+)?[{X.WS}]*%?"


def none() -> Column:
    return F.array().cast("array<string>")


def any_of(col: Column, words) -> Column:
    return col.rlike("|".join(words))


# --- D18, F17, F18 ---------------------------------------------------------------


def key_terms(given: Column, fallback: Column, n: int = 10) -> Column:
    """Given terms without blanks, else the tokens of a text; at most n of up to 40 characters."""
    tight = F.transform(F.coalesce(given, none()), lambda v: F.regexp_replace(X.repair(F.coalesce(v, F.lit(""))), f"[{X.WS}]+", ""))
    kept = F.filter(tight, lambda t: (F.length(t) >= 2) & ~t.rlike("^[，。；、,.。:：]+$"))
    tokens = F.filter(X.tokenize(fallback), lambda t: F.length(t) >= 2)
    cut = lambda arr: F.slice(F.array_distinct(F.transform(arr, lambda t: F.substring(t, 1, 40))), 1, n)
    return X.let(kept, lambda k: cut(F.when(F.size(k) > 0, k).otherwise(tokens)))


def surface(path: Column | str = "heading_path", text: Column | str = "text") -> Column:
    return F.concat_ws("\n", I.heading_text(path), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def first_by_id(evidence: DataFrame, keys: tuple[str, ...] = ("qid",), order: str = "ord") -> DataFrame:
    """First row per evidence id in evidence order."""
    w = Window.partitionBy(*keys, "evidence_id").orderBy(order)
    return evidence.filter("evidence_id <> ''").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def asked_of_text(query: Column) -> Column:
    """what a query asks of a text: tokens, years and numbers."""
    return F.struct(
        X.token_set(query).alias("tokens"), E.find_all(query, S.YEAR).alias("years"), F.filter(E.find_all(query, NUMBER), lambda x: x != "").alias("numbers")
    )


def query_score(score: Column, body: Column, asked: Column, path: Column, text: Column, parts: Column | None = None) -> Column:
    """base score, shared tokens, years and numbers, low-value and summary wording; ``parts`` are those of ``body``."""

    def rate(s: Column) -> Column:
        low = S.is_low_value(text, path)
        summary = any_of(X.compact_text(F.substring(s, 1, 1200)), S.SUMMARY_TERMS)
        return (
            F.coalesce(score, F.lit(0.0))
            + (X.overlap_with_text(asked["tokens"], s) if parts is None else X.overlap_with_parts(asked["tokens"], parts)) * 1.5
            + S.found_in(asked["years"], s, 2.0)
            + S.found_in(asked["numbers"], S.without_blanks(s), 1.0, True)
            + F.when(low, -12.0).when(summary, 2.0).otherwise(0.0)
        )

    return X.let(body, rate)


def rerank(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """``evidence(qid, ord, ..)`` reordered for ``queries(qid, query)``; repeats dropped first."""
    rows = first_by_id(evidence).join(queries.select("qid", asked_of_text(F.coalesce("query", F.lit(""))).alias("_asked")), "qid")
    scored = rows.withColumn("query_score", query_score(F.col("score"), surface(), F.col("_asked"), F.col("heading_path"), F.col("text")))
    return scored.withColumn("rank", Q.rank_by(["qid"], Q.by_score("query_score"), F.col("ord"))).drop("_asked")


def slot_bonus(body: Column, terms: Column, parts: Column) -> Column:
    """4 per key term found, a token share otherwise, and a coverage bonus or penalty.

    ``terms`` are structs of a term and its tokens, ``parts`` those of ``body``.
    """

    def rate(found: Column) -> Column:
        gain = F.aggregate(found, F.lit(0.0), lambda acc, n: acc + F.when(n < 0, 4.0).otherwise(F.least(F.lit(2.5), n * 0.8)))
        covered = F.aggregate(found, F.lit(0.0), lambda acc, n: acc + F.when(n < 0, 1.0).when(n > 0, 0.5).otherwise(0.0))
        total = X.let(covered, lambda c: F.least(F.lit(6.0), c * 1.2) + F.when(c == 0, -6.0).otherwise(0.0))
        return F.when(F.size(terms) > 0, gain + total).otherwise(0.0)

    def looked_up(compact: Column) -> Column:
        # shared tokens per term; -1 where the whole term is found
        return F.transform(terms, lambda t: F.when(F.contains(compact, t["term"]), -1).otherwise(X.overlap_with_parts(t["tokens"], parts)))

    return X.let(X.let(X.compact_text(body), looked_up), rate)


def rerank_slot(evidence: DataFrame, slots: DataFrame, n: int | None = None) -> DataFrame:
    """evidence reordered for ``slots(qid, slot, query, key_terms)``; ``n`` or the column ``cap`` limits it."""
    terms = F.filter(key_terms(F.col("key_terms"), F.concat_ws(" ", "slot", "query"), 12), lambda t: t != "")
    terms = F.transform(terms, lambda t: F.struct(t.alias("term"), X.token_set(t).alias("tokens")))
    cap = ["cap"] if "cap" in slots.columns else []
    # what a slot asks for is cut once, not with each of its rows
    asked = slots.select("qid", asked_of_text(F.coalesce("query", F.lit(""))).alias("_asked"), terms.alias("_terms"), *cap)
    rows = first_by_id(evidence).join(asked, "qid")

    def rate(body: Column) -> Column:
        def both(parts: Column) -> Column:
            return query_score(F.col("score"), body, F.col("_asked"), F.col("heading_path"), F.col("text"), parts) + slot_bonus(body, F.col("_terms"), parts)

        return X.let(X.text_parts(body), both)

    rows = rows.withColumn("slot_score", X.let(surface(), rate))
    rows = rows.withColumn("rank", Q.rank_by(["qid"], Q.by_score("slot_score"), F.col("ord"))).drop("_asked", "_terms")
    if n is not None:
        rows = rows.filter(F.col("rank") <= n)
    return rows.filter("rank <= cap").drop("cap") if cap else rows


# --- F19-F22 ----------------------------------------------------------------------


def summary_candidates(pages: DataFrame, requests: DataFrame, n: int = 2) -> DataFrame:
    """up to n summary pages among the first eight of every requested document."""
    order = Q.rank_by(["doc_id"], F.col("page_no"))
    early = pages.withColumn("_n", order).filter("_n <= 8")
    early = early.filter(
        ~S.is_heading_only(F.col("text"), F.col("heading_path"))
        & S.is_summary_like(F.col("page_no"), F.col("text"), F.col("heading_path"), F.col("title"), F.col("index_text"))
    ).select("doc_id", "page_id", "page_no", "heading_path", X.repair("text").alias("text"))
    rows = requests.select("qid", "doc_id", asked_of_text(F.col("query")).alias("_asked")).join(early, "doc_id")
    # generated, so the filter does not repeat the rating
    rated = query_score(F.lit(0.0), surface(), F.col("_asked"), F.col("heading_path"), F.col("text"))
    rows = rows.select("*", F.explode(F.array(rated)).alias("score")).filter("score > 0")
    rows = rows.withColumn("rank", Q.rank_by(["qid", "doc_id"], Q.by_score(), F.col("page_no"))).filter(F.col("rank") <= n)
    # the candidate itself enters the evidence with score 0
    return rows.select(
        "qid", F.col("page_id").alias("evidence_id"), "doc_id", "page_id", "page_no", "heading_path", "text", F.lit(0.0).alias("score"), "rank",
        F.col("score").alias("query_score"), F.lit("initial_summary").alias("source"),
    )


def term_coverage(pages: DataFrame, requests: DataFrame, n: int = 3) -> DataFrame:
    """pages holding at least two of the key terms of ``requests(qid, doc_id, key_terms)``, best n per document."""
    asked = requests.select("qid", "doc_id", F.filter(key_terms(F.col("key_terms"), F.lit(""), 12), lambda t: F.length(t) >= 2).alias("terms"))
    asked = asked.filter(F.size("terms") >= 2)
    body = X.compact_text(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.array_join("heading_path", " "), F.coalesce(X.falsy_null("index_text"), "text")))
    held = pages.select("doc_id", "page_id", "page_no", "heading_path", "text", body.alias("body"))
    rows = asked.join(held, "doc_id").withColumn("covered", F.size(F.filter("terms", lambda t: F.contains(F.col("body"), t)))).filter("covered >= 2")
    score = F.col("covered") * 20.0 + F.least(F.length("body"), F.lit(2000)) / 2000.0
    rows = rows.withColumn("score", F.round(score, 6))
    rank = Q.rank_by(["qid", "doc_id"], F.desc("score"), F.col("page_no"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).select(
        "qid", F.col("page_id").alias("evidence_id"), "doc_id", "page_id", "page_no", "heading_path", X.repair("text").alias("text"), "score", "rank",
        F.lit("followup_key_coverage").alias("source"), "covered",
    )


def expand_forward(evidence: DataFrame, pages: DataFrame, forward: int = 4, back: int = 0, anchors_only: bool = True) -> DataFrame:
    """the pages after evidence that breaks off at an open anchor (or all neighbours), unseen ones only."""
    start = evidence.filter(S.is_open_anchor(F.col("text"))) if anchors_only else evidence
    place = Q.rank_by(["doc_id"], F.col("page_no")).alias("place")
    ordered = pages.select("doc_id", "page_id", "page_no", place)
    steps = F.array(*[F.lit(i) for i in range(-back, forward + 1) if i])
    wanted = (
        start.select("qid", "ord", "evidence_id", "doc_id", "page_id", F.col("score").alias("from_score"), F.col("source").alias("from_source"))
        .join(ordered.select("doc_id", "page_id", "place"), ["doc_id", "page_id"])
        .select("*", F.explode(steps).alias("step"))
        .withColumn("place", F.col("place") + F.col("step"))
        .drop("page_id")
    )
    seen = evidence.select("qid", F.col("evidence_id").alias("page_id")).distinct()
    found = wanted.join(ordered, ["doc_id", "place"]).join(seen, ["qid", "page_id"], "left_anti")
    first = Window.partitionBy("qid", "page_id").orderBy("ord", "step")
    found = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    suffix = "_auto_anchor_expand" if forward <= 2 else "_anchor_expand"
    return found.join(pages.select("page_id", "heading_path", X.repair("text").alias("text")), "page_id").select(
        "qid", F.col("evidence_id").alias("expanded_from"), "step", F.col("page_id").alias("evidence_id"), "doc_id", "page_id", "page_no",
        "heading_path", "text", F.col("from_score").alias("score"), F.concat("from_source", F.lit(suffix)).alias("source"),
    )


def merge_evidence(first: DataFrame, second: DataFrame, excluded: DataFrame | None = None, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """union by id; earlier rows win, excluded ids never enter from the second side. ``ord`` is renumbered per group."""
    incoming = second
    if excluded is not None:
        incoming = incoming.join(excluded.select(*keys, "evidence_id").distinct(), [*keys, "evidence_id"], "left_anti")
    both = first.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "evidence_id").orderBy("_side", "ord")
    both = both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return both.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("_side", "ord"))).drop("_side")


def select_by_ids(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """evidence whose id is asked for in its own group."""
    return evidence.join(wanted.select("qid", "evidence_id").distinct(), ["qid", "evidence_id"], "left_semi")


def merge_facts(old: DataFrame, new: DataFrame, keep: int = 24) -> DataFrame:
    """facts keyed by slot, value and ids; new ones trimmed, the last 24 of a group stay."""
    trimmed = new.select(
        "qid", "ord", F.substring(X.strip(X.repair("slot")), 1, 100).alias("slot"), F.substring(X.strip(X.repair("value")), 1, 220).alias("value"),
        F.substring(F.coalesce("coverage", F.lit("partial")), 1, 20).alias("coverage"),
        F.slice(F.array_distinct(F.filter(F.transform("evidence_ids", lambda i: X.strip(i)), lambda i: i != "")), 1, 5).alias("evidence_ids"),
    ).filter("slot <> '' AND value <> '' AND size(evidence_ids) > 0")
    both = old.select(*trimmed.columns).withColumn("_side", F.lit(0)).unionByName(trimmed.withColumn("_side", F.lit(1)))
    dup = Window.partitionBy("qid", "slot", "value", F.array_join("evidence_ids", ",")).orderBy("_side", "ord")
    both = both.withColumn("_n", F.row_number().over(dup)).filter("_side = 0 OR _n = 1")
    last = Window.partitionBy("qid").orderBy(F.desc("_side"), F.desc("ord"))
    return both.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= keep).drop("_n", "_side")


# --- F23, F24 -----------------------------------------------------------------------

FOCUSED = ("evidence_extract", "evidence_inner_focus", "evidence_local_subsearch")
TREND_WORDS = ("同比", "增速", "增长", "下降", "收入", "利润", "费用", "现金价值", "比例")


def snippet_score(snippet: Column, query: Column, bonus: bool, caption: bool = False) -> Column:
    """3 per shared token, if any, plus form bonuses; F23 also rates numbers and trend words."""

    def rate(n: Column) -> Column:
        flags = [
            F.when(snippet.rlike(r"\p{Nd}{4}|第[一二三四五六七八九十\p{Nd}]+"), 1.0).otherwise(0.0),
            F.when(snippet.rlike(rf"(?i)\p{{Nd}}+(?:\.\p{{Nd}}+)?[{X.WS}]*%|百分|pct|pcts"), 1.0).otherwise(0.0),
            F.when(snippet.rlike(C.CAPTION), 1.0).otherwise(0.0),
        ]
        total = n * 3.0 + flags[0] + flags[1] + flags[2]
        if bonus:
            number = r"\p{Nd}+(?:\.\p{Nd}+)?%?|\p{Nd}{4}"
            shared = F.size(F.array_intersect(E.find_all(X.repair(query), number), E.find_all(X.repair(snippet), number)))
            total = total + shared * 2.0 + F.when(any_of(snippet, TREND_WORDS), 0.8).otherwise(0.0)
        if caption:
            total = total + F.when(snippet.rlike(C.CAPTION), 0.5).otherwise(0.0)
        return F.when(n > 0, total).otherwise(0.0)

    return X.let(X.overlap(X.token_set(query), X.token_set(snippet)), rate)


def local_subsearch(evidence: DataFrame, queries: DataFrame, min_chars: int = 1500, max_snippets: int = 3, size: int = 760, variant: str = "src") -> DataFrame:
    """the best snippets of long evidence per query; variant ``b`` adds a caption bonus."""
    rows = evidence.filter(~F.col("source").isin(*FOCUSED) & (F.length(X.compact_text("text")) > min_chars)).join(queries.select("qid", "query"), "qid")
    rows = rows.filter("query <> ''").select(
        "qid", "ord", "evidence_id", "doc_id", "heading_path", "query", F.posexplode(C.subsplit("text", min_chars, size)).alias("idx", "snippet")
    )
    # focus and score in one generator: a filter on either would otherwise repeat the rules behind it
    scored = lambda t: F.array(F.struct(t.alias("text"), F.round(snippet_score(t, F.col("query"), True, variant == "b"), 6).alias("score")))
    focused = X.let(F.substring(C.focus(F.col("snippet"), F.col("query"), size), 1, size), scored)
    rows = rows.select("*", F.explode(focused).alias("_s")).select("*", "_s.text", "_s.score").filter("score > 0")
    rows = rows.withColumn("rank", Q.rank_by(["qid"], F.desc("score"), F.col("ord"), F.col("idx"))).filter(F.col("rank") <= max_snippets)
    new_id = F.concat_ws("_sub_", "evidence_id", F.col("idx").cast("string"))
    return rows.select(
        "qid", new_id.alias("evidence_id"), "doc_id", new_id.alias("page_id"), "heading_path", "text", "score", "rank",
        F.lit("evidence_local_subsearch").alias("source"), F.col("evidence_id").alias("focused_from"),
    )


def inner_focus(evidence: DataFrame, missing: DataFrame, max_snippets: int = 3, min_chars: int = INNER_MIN_CHARS, size: int = 900) -> DataFrame:
    """spans of long evidence that speak to the missing slots ``missing(qid, query)``."""
    rows = evidence.filter(F.length(X.compact_text("text")) > min_chars).join(missing.select("qid", "query"), "qid").filter("query <> ''")
    rows = rows.select(
        "qid", "ord", "evidence_id", "doc_id", "heading_path", "query",
        F.posexplode(C.inner_split("text", F.col("query"), min_chars, size)).alias("idx", "span"),
    ).select("*", F.col("span.snippet").alias("text"))
    rows = rows.select("*", F.explode(F.array(snippet_score(F.col("text"), F.col("query"), False))).alias("score")).filter("score > 0")
    rows = rows.withColumn("rank", Q.rank_by(["qid"], F.desc("score"), F.col("ord"), F.col("idx"))).filter(F.col("rank") <= max_snippets)
    new_id = F.concat_ws("_focus_", "evidence_id", F.col("idx").cast("string"))
    return rows.select(
        "qid", new_id.alias("evidence_id"), "doc_id", new_id.alias("page_id"), "heading_path", "text", "score", "rank",
        F.lit("evidence_inner_focus").alias("source"), F.col("evidence_id").alias("focused_from"),
    )


# --- F26 ----------------------------------------------------------------------------

# Wording that makes a sentence worth a note.
NOTE_TERMS = (
    "保险责任", "责任免除", "不负责赔偿", "不承担", "不予赔偿", "赔付", "赔偿", "给付", "保险金", "免赔", "比例", "限额", "公式", "计算",
    "现金价值", "退保", "费用", "门诊", "住院", "详见", "如下", "包括", "不包括",
)
DECISION_TERMS = ("是否", "能否", "可否", "是否只要", "是否可以", "能不能", "可以", "开展", "成立", "适用")
NORMATIVE_TERMS = (
    "不得", "禁止", "不应", "不能", "不得开展", "不得建立", "应当", "必须", "批准", "审批", "许可", "限制", "例外", "除外",
)
ASPECTS = {
    "cost": ("降本", "成本", "成本优势", "节省", "材料", "用量", "更高效", "效率", "费用", "消耗"),
    "performance": ("性能", "强度", "轻薄", "厚度", "精度", "良率", "可靠", "成活率", "产蛋", "生长速度", "料肉比"),
    "case": ("案例", "公司", "产品", "业务", "技术", "设备", "方案", "实现", "突破"),
    "normative": NORMATIVE_TERMS,
}
TIER_ASK = ("金额", "退保", "解除", "现金价值", "账户", "收益", "比例", "计算")
TIER_RULE = ("等于", "计算", "比例", "金额之和")
TIER_SPAN = ("保单年度", "年度", "年龄", "周岁", "期限", "区间", "及以后", "至第")
TIER_FORMULAS = (
    rf"(?:\p{{Nd}}+\.[{X.WS}]*)?[^。；;]{{0,40}}?第[{X.WS}]*\p{{Nd}}+[{X.WS}]*个?保单年度[^。；;]{{0,220}}?等于[^。；;]{{0,260}}(?:。|；|;|$)",
    rf"(?:\p{{Nd}}+\.[{X.WS}]*)?[^。；;]{{0,40}}?第[{X.WS}]*\p{{Nd}}+[{X.WS}]*年[^。；;]{{0,220}}?等于[^。；;]{{0,260}}(?:。|；|;|$)",
    r"[^。；;]{0,80}?(?:按以下方法计算|计算方法)[^。；;]{0,420}(?:。|；|;|$)",
)


def asked_of_notes(query: Column) -> Column:
    """what a query asks of its notes: tokens, years, numbers, the aspects it names, and whether it wants a decision."""
    return F.struct(
        X.token_set(query).alias("tokens"), E.find_all(query, S.YEAR).alias("years"),
        F.filter(E.find_all(query, NUMBER), lambda x: x != "").alias("numbers"), any_of(query, DECISION_TERMS).alias("decision"),
        *[any_of(query, words).alias(name) for name, words in ASPECTS.items()],
    )


def note_score(sentence: Column, asked: Column) -> Column:
    """2 per shared token, 3 per note term, 8 for a rule answering a decision, years, numbers, short malus."""
    terms = F.size(F.filter(F.array(*[F.lit(t) for t in NOTE_TERMS]), lambda t: F.contains(sentence, t)))
    return (
        X.overlap_with_text(asked["tokens"], sentence) * 2.0
        + terms * 3.0
        + F.when(asked["decision"] & any_of(sentence, NORMATIVE_TERMS), 8.0).otherwise(0.0)
        + S.found_in(asked["years"], sentence, 2.0)
        + S.found_in(asked["numbers"], S.without_blanks(sentence), 1.0, True)
        + F.when(F.length(sentence) < 12, -2.0).otherwise(0.0)
    )


def tier_notes(text: Column, query: Column, n: int) -> Column:
    """tiered formulas (by contract year, by method) as notes."""

    def found(t: Column) -> Column:
        hits = F.concat(*[E.find_all(t, p) for p in TIER_FORMULAS])
        kept = F.filter(F.transform(hits, lambda h: X.compact_text(h)), lambda h: F.length(h) >= 30)
        cut = F.transform(F.slice(F.array_distinct(kept), 1, n), lambda h: F.substring(h, 1, 520))
        return F.when(any_of(query, TIER_ASK) & any_of(t, TIER_RULE) & any_of(t, TIER_SPAN), cut).otherwise(none())

    return X.let(X.html_text(text), found)


def evidence_notes(evidence: DataFrame, tasks: DataFrame, per_item: int = 3, total: int = 14, chat: bool = True, variant: str = "src") -> DataFrame:
    """the best sentences of each evidence row for ``tasks(qid, query)``, the last ``total`` per task.

    The source form rates aspects, prefers sentences with a new aspect and puts
    tiered formulas first; variant ``b`` takes the plain ranking.
    """
    asked = tasks.select("qid", X.repair("query").alias("query"))
    asked = asked.select("qid", "query", asked_of_notes(F.col("query")).alias("asked"))
    rows = first_by_id(evidence).join(asked, "qid")
    rows = rows.select("qid", "ord", "evidence_id", "doc_id", "heading_path", "text", "query", "asked")
    sentences = rows.select("qid", "evidence_id", "asked", F.posexplode(C.note_sentences("text")).alias("idx", "sentence"))

    def rate(sentence: Column) -> Column:
        aspects = none()
        if variant != "b":
            named = [F.when(F.col("asked")[name] & any_of(sentence, words), F.lit(name)) for name, words in ASPECTS.items()]
            aspects = F.array_compact(F.array(*named))
        return F.struct(sentence.alias("sentence"), aspects.alias("aspects"), note_score(sentence, F.col("asked")).alias("score"))

    # generated, so the filter does not repeat the rating
    scored = sentences.select("qid", "evidence_id", "idx", F.explode(F.array(X.let(X.repair("sentence"), rate))).alias("r"))
    scored = scored.select("qid", "evidence_id", "idx", "r.sentence", "r.aspects", (F.col("r.score") + F.size("r.aspects") * 1.5).alias("score")).filter("score > 0")
    note = F.substring(X.compact_text("sentence"), 1, 260)
    ordered = F.struct((-F.round("score", 6)).alias("o"), "idx", note.alias("note"), F.col("score"), "aspects")
    ranked = scored.groupBy("qid", "evidence_id").agg(F.array_sort(F.collect_list(ordered)).alias("ranked"))
    kind = "array<struct<note:string,score:double>>"
    lead = tier_notes(F.col("text"), F.col("query"), per_item) if chat and variant == "src" else none()
    rows = rows.drop("asked").join(ranked, ["qid", "evidence_id"], "left").withColumn("lead", F.transform(lead, lambda x: F.struct(x.alias("note"), F.lit(120.0).alias("score"))))
    # short evidence without any scored sentence is a note as a whole
    whole = X.compact_text("text")
    fallback = F.when(
        (F.length(whole) <= 320) & (F.length(whole) > 0),
        F.array(F.struct(F.lit(0.0).alias("o"), F.lit(0).alias("idx"), F.substring(whole, 1, 260).alias("note"), F.lit(1.0).alias("score"), none().alias("aspects"))),
    )
    rows = rows.withColumn("ranked", F.coalesce("ranked", fallback))

    def seen(acc: Column, text: Column) -> Column:
        return F.exists(acc["notes"], lambda n: n["note"] == text)

    def take(acc: Column, s: Column, fresh: bool) -> Column:
        old = (F.size(s["aspects"]) > 0) & (F.size(F.array_except(s["aspects"], acc["covered"])) == 0) & (F.size(acc["notes"]) >= 1)
        ok = (F.size(acc["notes"]) < per_item) & (s["note"] != "") & ~seen(acc, s["note"])
        ok = ok & ~old if fresh else ok
        one = F.array(F.struct(s["note"].alias("note"), s["score"].alias("score")))
        return F.struct(
            F.when(ok, F.concat(acc["notes"], one)).otherwise(acc["notes"]).alias("notes"),
            F.when(ok, F.array_union(acc["covered"], s["aspects"])).otherwise(acc["covered"]).alias("covered"),
        )

    start = F.struct(F.col("lead").cast(kind).alias("notes"), none().alias("covered"))
    list_ = F.coalesce("ranked", F.array().cast("array<struct<o:double,idx:int,note:string,score:double,aspects:array<string>>>"))
    first = F.aggregate(list_, start, lambda acc, s: take(acc, s, True))
    both = X.let(first, lambda a: F.aggregate(list_, a, lambda acc, s: take(acc, s, False), lambda acc: acc["notes"]))
    notes = rows.select("qid", "ord", "evidence_id", "doc_id", I.heading_text().alias("heading"), F.posexplode(both).alias("note_no", "n"))
    last = Window.partitionBy("qid").orderBy(F.desc("ord"), F.desc("note_no"))
    return notes.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= total).select(
        "qid", "ord", F.col("evidence_id").alias("source_evidence_id"), "doc_id", "heading", "note_no", "n.note", F.round("n.score", 3).alias("score")
    )


# --- F28, F29, D11, D12 -----------------------------------------------------------------


def review_sources(sources: DataFrame, missing: DataFrame, n: int = REVIEW_SOURCES) -> DataFrame:
    """which of ``sources(qid, ord, evidence_id, heading_path, text, remembered)`` to read again for ``missing(qid, query, key_terms)``.

    Groups with few sources keep all; where nothing scores, the first n stay.
    """
    words = F.filter(X.token_set(F.coalesce("query", F.lit(""))), lambda t: F.length(t) >= 2)
    wanted = F.filter(F.coalesce("key_terms", none()), lambda t: t != "")
    rows = sources.join(missing.select("qid", words.alias("_words"), wanted.alias("_wanted")), "qid", "left")
    heading = X.repair(I.heading_text())
    tokens, wanted = F.coalesce("_words", none()), F.coalesce("_wanted", none())

    def rate(text: Column) -> Column:
        return (
            F.size(F.filter(wanted, lambda t: F.contains(text, t))) * 4.0
            + X.overlap_with_text(tokens, text) * 1.0
            + X.overlap_with_text(tokens, heading) * 1.5
            + F.when(F.col("remembered"), 2.0).otherwise(0.0)
            + F.when(text.rlike(rf"{C.CAPTION}|\|.+\|"), 0.5).otherwise(0.0)
        )

    score = X.let(F.concat_ws("\n", heading, C.clean_evidence("text")), rate)
    rows = rows.withColumn("review_score", score)
    all_ = Window.partitionBy("qid")
    rows = rows.withColumn("_count", F.count("*").over(all_)).withColumn("_best", F.max("review_score").over(all_))
    by_score = Q.rank_by(["qid"], F.desc("review_score"), F.col("ord"))
    by_order = Q.rank_by(["qid"], F.col("ord"))
    rows = rows.withColumn("_s", by_score).withColumn("_o", by_order)
    keep = (
        F.when(F.col("_count") <= n, F.lit(True))
        .when(F.col("_best") > 0, (F.col("_s") <= n) & (F.col("review_score") > 0))
        .otherwise(F.col("_o") <= n)
    )
    place = F.when((F.col("_count") <= n) | (F.col("_best") <= 0), F.col("_o")).otherwise(F.col("_s"))
    return rows.filter(keep).select("qid", "evidence_id", "review_score", place.alias("rank"))


# How evidence refers to schedules and tables.
TABLES = "计划表|保险计划表|费率表|现金价值表|利益表|比例表|限额表|表格?"
REFERENCE = rf"(?:详见|见|参见|载明于|以|按照|按)([^。；;\n]{{0,40}}?(?:附表[{X.WS}]*\p{{Nd}}*|{TABLES}))"
REFERENCE_LEAD = "^(?:本合同|本主险合同|本计划|本保险|的|中|所附|对应的)++"
NOT_TABLES = ("疾病清单", "分级表", "分期表")
SLOT_NOUN = rf"[{X.CJK}A-Za-z]{{1,18}}(?:比例|费率|金额|限额|系数|标准)[{X.WS}]*[A-ZＡ-Ｚ]?"


def _recent(evidence: DataFrame, n: int = 12) -> DataFrame:
    """The last n evidence rows of a group."""
    last = Window.partitionBy("qid").orderBy(F.desc("ord"))
    return evidence.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= n).drop("_n")


def reference_targets(evidence: DataFrame, n: int = 4) -> DataFrame:
    """Schedules and tables the last evidence rows refer to."""
    rows = _recent(evidence).select("qid", "ord", F.posexplode(E.find_all(X.repair("text"), REFERENCE, 1)).alias("pos", "raw"))
    target = F.substring(X.strip(F.regexp_replace(X.compact_text("raw"), REFERENCE_LEAD, "")), 1, 40)
    rows = rows.select("qid", "ord", "pos", target.alias("target")).filter(~any_of(F.col("target"), NOT_TABLES) & (F.col("target") != ""))
    first = rows.groupBy("qid", "target").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return first.withColumn("target_no", Q.rank_by(["qid"], F.col("at"))).filter(F.col("target_no") <= n).drop("at")


def referenced_slots(evidence: DataFrame, n: int = 4) -> DataFrame:
    """The ratio or amount a reference stands for: the last such noun in the 80 characters before it."""
    text = X.repair("text")
    rows = _recent(evidence).select("qid", "ord", "evidence_id", "doc_id", text.alias("text"))
    # cut the text at every reference word: each piece is followed by the text the reference opens
    rows = rows.select(
        "qid", "ord", "evidence_id", "doc_id",
        F.regexp_replace("text", rf"(?:详见|参见|见)(?=[^。；;\n]{{0,30}}?(?:附表[{X.WS}]*\p{{Nd}}*|{TABLES}))", C.CUT).alias("text"),
    )
    rows = rows.select("qid", "ord", "evidence_id", "doc_id", F.split("text", C.CUT).alias("parts"))
    rows = rows.select("qid", "ord", "evidence_id", "doc_id", "parts", F.posexplode("parts").alias("pos", "after")).filter("pos > 0")
    before = F.array_join(F.slice("parts", F.lit(1), F.col("pos")), "见")
    target = X.compact_text(F.regexp_extract("after", rf"^([^。；;\n]{{0,30}}?(?:附表[{X.WS}]*\p{{Nd}}*|{TABLES}))", 1))
    nouns = E.find_all(F.substring(before, -80, 80), SLOT_NOUN)
    rows = rows.select("qid", "ord", "evidence_id", "doc_id", "pos", target.alias("target"), X.compact_text(F.try_element_at(nouns, F.lit(-1))).alias("slot"))
    lettered = F.col("slot").rlike(rf"[A-ZＡ-Ｚ][{X.WS}]*$")
    kept = lettered | F.contains("slot", F.lit("比例")) | any_of(F.col("target"), ("现金价值表", "利益表", "费率表"))
    rows = rows.filter((F.col("slot") != "") & ~any_of(F.col("target"), NOT_TABLES) & kept)
    rows = rows.withColumn("slot", X.match_key("slot", "reference")).filter("slot <> ''")
    first = rows.groupBy("qid", "slot", "target").agg(F.min_by(F.struct("evidence_id", "doc_id"), F.struct("ord", "pos")).alias("e"), F.min(F.struct("ord", "pos")).alias("at"))
    return first.withColumn("slot_no", Q.rank_by(["qid"], F.col("at"))).filter(F.col("slot_no") <= n).select("qid", "slot", "target", "e.evidence_id", "e.doc_id", "slot_no")


RATIO_ASK = ("比例", "责任项", "赔付")


def reference_queries(missing: DataFrame, evidence: DataFrame) -> DataFrame:
    """up to five queries per ``missing(qid, slot, query, task, question)`` from the references of its evidence."""
    targets = reference_targets(evidence).groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("target_no", "target"))), lambda x: x["target"]).alias("targets")
    )
    rows = missing.join(targets, "qid")
    asked = F.concat("slot", "query")
    tables = F.filter("targets", lambda t: any_of(t, ("计划表", "保险计划表", "比例表", "费率表", "限额表")))
    narrowed = F.when(F.size(tables) > 0, tables).otherwise(F.slice("targets", 1, 1))
    rows = rows.withColumn("targets", F.when(any_of(asked, RATIO_ASK), narrowed).otherwise(F.col("targets")))

    def line(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")

    slot, query, task = F.col("slot"), F.col("query"), F.col("task")
    base = F.flatten(F.transform("targets", lambda t: F.array(line(t, slot, query), line(t, slot, task))))
    ratio = F.when(any_of(asked, RATIO_ASK), F.array(line(F.lit("计划表"), F.lit("附表"), slot, F.lit("计划一"), F.lit("赔付比例")))).otherwise(none())
    both = F.concat(base, ratio)
    plan = F.when(F.contains("question", F.lit("计划一")) & ~F.contains(F.array_join(both, " "), F.lit("计划一")), F.array(line(F.lit("计划一"), slot, query))).otherwise(none())
    queries = F.slice(F.array_distinct(F.filter(F.concat(both, plan), lambda q: q != "")), 1, 5)
    return rows.select("qid", F.posexplode(queries).alias("pos", "query")).select("qid", (F.col("pos") + 1).alias("query_no"), "query")


def reference_followup(missing: DataFrame, evidence: DataFrame, docs: DataFrame, pages: DataFrame, n: int = 4) -> DataFrame:
    """two hits per document for the first two reference queries, at most four rows."""
    asked = reference_queries(missing, evidence).filter("query_no <= 2")
    requests = asked.join(docs.select("qid", "domain", "doc_id", "doc_ord"), "qid").withColumn("rid", F.concat_ws("#", "qid", "query_no"))
    hits = Q.retrieve_multi(requests.select(F.col("rid").alias("qid"), "domain", "query", "doc_id"), pages, 2, "followup_reference")
    hits = hits.withColumnRenamed("qid", "rid").join(requests.select("rid", "qid", "doc_id", "doc_ord", "query_no"), ["rid", "doc_id"])
    hits = hits.withColumn("ord", Q.rank_by(["qid"], F.col("doc_ord"), F.col("query_no"), F.col("rank"))).drop("rid", "rank", "doc_ord", "query_no")
    merged = first_by_id(hits)
    return merged.withColumn("rank", Q.rank_by(["qid"], F.col("ord"))).filter(F.col("rank") <= n)


# --- D13, D14, F30 -----------------------------------------------------------------------

# Ratio words and metric names, in the order they are looked for.
RATIO_WORDS = ("占比", "比例", "比重", "强度", "率")
METRICS = (
    "经营活动产生的现金流量净额", "归属于上市公司股东的净利润", "现金流量净额", "营业收入", "研发投入", "研发费用", "现金分红", "归母净利润", "净利润",
    "营业成本", "总资产", "净资产", "收入", "利润", "投入", "费用", "成本", "资产", "负债",
)
AMOUNT = rf"(-?\p{{Nd}}+(?:,\p{{Nd}}{{3}})*(?:\.\p{{Nd}}+)?)[{X.WS}]*(亿元|百万元|千元|元)?"
FACTORS = {"亿元": 1e8, "百万元": 1e6, "千元": 1e3}
ANY_AMOUNT = rf"\p{{Nd}}+(?:,\p{{Nd}}{{3}})*(?:\.\p{{Nd}}+)?"


def metrics_in(query: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(query, F.lit(m)), F.lit(m)) for m in METRICS]))


def ratio_parts(query: Column, n: int = 3) -> Column:
    """what to look for when a ratio is asked: the amounts of the metrics it names."""

    def asked(text: Column) -> Column:
        found = metrics_in(F.regexp_replace(text, r"\p{Nd}+(?:\.\p{Nd}+)?%", " "))

        def wording(m: Column) -> Column:
            return (
                F.when(m.isin("营业收入", "收入"), "营业收入 合计")
                .when(m.isin("研发投入", "研发费用", "投入", "费用", "净利润", "归母净利润", "归属于上市公司股东的净利润", "利润",
                             "经营活动产生的现金流量净额", "现金流量净额", "现金流"), F.concat(m, F.lit(" 金额")))
                .otherwise(m)
            )

        return F.when(any_of(text, RATIO_WORDS), F.slice(F.array_distinct(F.transform(found, wording)), 1, n)).otherwise(none())

    return X.let(X.repair(F.coalesce(query, F.lit(""))), asked)


def ratio_metrics(query: Column) -> Column:
    """Up to four longest metrics of a query, numerator and denominator first when a share word parts them."""

    def pick(text: Column) -> Column:
        # longest first, metrics inside a longer kept one dropped
        ranked = F.transform(
            F.array_sort(F.transform(metrics_in(text), lambda m, i: F.struct((-F.length(m)).alias("l"), i.alias("i"), m.alias("m")))), lambda s: s["m"]
        )
        kept = F.aggregate(
            ranked, none(),
            lambda acc, m: F.when(F.exists(acc, lambda o: (o != m) & F.contains(o, m)), acc).otherwise(F.concat(acc, F.array(m))),
        )
        return X.let(F.slice(kept, 1, 4), lambda ms: ordered(text, ms))

    def ordered(text: Column, ms: Column) -> Column:
        at = F.position(F.lit("占"), text)  # every share word starts with it
        before, after = F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0))), F.substring(text, at, F.length(text))
        back = lambda m: F.length(before) - F.position(F.reverse(m), F.reverse(before)) - F.length(m)
        left = F.transform(F.filter(ms, lambda m: F.contains(before, m)), lambda m: F.struct((-back(m)).alias("p"), F.array_position(ms, m).alias("i"), m.alias("m")))
        right = F.transform(F.filter(ms, lambda m: F.contains(after, m)), lambda m: F.struct(F.position(m, after).alias("p"), F.array_position(ms, m).alias("i"), m.alias("m")))
        pair = F.array(F.array_min(left)["m"], F.array_min(right)["m"])
        parted = (F.size(ms) >= 2) & (at > 0) & (F.size(left) > 0) & (F.size(right) > 0)
        return F.when(parted, F.concat(pair, F.filter(ms, lambda m: ~F.array_contains(pair, m)))).otherwise(ms)

    return X.let(X.repair(F.coalesce(query, F.lit(""))), pick)


def metric_snippet(text: Column, metric: Column, size: int = 280) -> Column:
    """The first window (120 before, 220 after) around a metric that holds a number; empty if there is none."""

    def windows(t: Column) -> Column:
        pieces = F.split(F.replace(t, metric, F.lit(C.CUT)), C.CUT)
        ends = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
            lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda acc, p: acc + F.length(p)) + (k - 1) * F.length(metric),
        )

        def around(start: Column) -> Column:
            low = F.greatest(F.lit(0), start - 120)
            return X.strip(F.substring(t, low + 1, start + F.length(metric) + 220 - low))

        first = F.try_element_at(F.filter(F.transform(ends, around), lambda w: w.rlike(ANY_AMOUNT)), F.lit(1))
        flat = F.regexp_replace(first, f"[{X.WS}]+", " ")
        return F.when(F.contains(t, metric), F.coalesce(C.trim_around(flat, query_tokens(metric), size), F.lit(""))).otherwise("")

    return X.let(C.clean_evidence(text), windows)


def query_tokens(query: Column) -> Column:
    return C.query_anchors(query)


def metric_amount(snippet: Column, metric: Column) -> Column:
    """``struct<amount, raw>`` of the first non-percent, non-zero number after a metric, in base units."""

    def parse(t: Column) -> Column:
        local = F.substring(t, F.greatest(F.position(metric, t), F.lit(1)), F.lit(220))
        # a trailing percent sign right after the match rules a number out
        tagged = rf"{AMOUNT}(%?)"
        rows = F.arrays_zip(*[E.find_all(local, tagged, g).alias(n) for g, n in ((1, "raw"), (2, "unit"), (3, "pct"))])
        value = lambda r: F.replace(r["raw"], F.lit(","), F.lit("")).cast("double")
        good = F.filter(rows, lambda r: (r["pct"] == "") & (value(r) != 0))
        factor = lambda r: F.coalesce(*[F.when(r["unit"] == u, F.lit(f)) for u, f in FACTORS.items()], F.lit(1.0))
        return X.let(
            F.try_element_at(good, F.lit(1)),
            lambda r: F.when(r.isNotNull(), F.struct((value(r) * factor(r)).alias("amount"), F.concat(r["raw"], r["unit"]).alias("raw"))),
        )

    return X.let(C.clean_evidence(snippet), parse)


def computed_ratio(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per ``queries(qid, query)`` asking for a ratio, the amounts of its metrics and the ratio itself."""
    asked = queries.filter(any_of(X.repair("query"), RATIO_WORDS)).select("qid", "query", ratio_metrics(F.col("query")).alias("metrics"))
    asked = asked.filter(F.size("metrics") >= 2).select("qid", "query", F.posexplode("metrics").alias("pos", "metric"))
    rows = evidence.select("qid", "ord", "evidence_id", "doc_id", "text").join(asked, "qid").filter(F.contains("text", F.col("metric")))
    rows = rows.withColumn("snippet", metric_snippet(F.col("text"), F.col("metric"))).filter("snippet <> ''")
    first = rows.groupBy("qid", "query", "pos", "metric").agg(F.min_by(F.struct("evidence_id", "snippet"), "ord").alias("f"))
    first = first.withColumn("a", metric_amount(F.col("f.snippet"), F.col("metric")))
    grouped = first.groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.struct("pos", "metric", "f", "a"))).alias("m")).filter("size(m) >= 2")
    valued = F.filter("m", lambda x: x["a"].isNotNull())
    pair = F.when(F.size(valued) >= 2, F.slice(valued, 1, 2))
    top, low = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
    ratio = top["a"]["amount"] / low["a"]["amount"] * 100
    line = F.concat(
        F.lit("候选计算："), top["metric"], F.lit("("), top["a"]["raw"], F.lit(") / "), low["metric"], F.lit("("), low["a"]["raw"], F.lit(") = "),
        F.format_string("%.2f", ratio), F.lit("%"),
    )
    lines = F.concat(F.transform("m", lambda x: F.concat_ws(": ", x["metric"], x["f"]["snippet"])), F.array_compact(F.array(line)))
    digest = F.substring(F.md5(F.concat(F.array_join(lines, "|"), F.lit("|"), "query").cast("binary")), 1, 10)
    return grouped.select(
        "qid", F.concat(F.lit("computed_ratio_hint_"), digest).alias("evidence_id"), ratio.alias("ratio"),
        F.concat(F.lit("比例/占比类槽位的候选原始数值：\n"), F.array_join(lines, "\n")).alias("text"),
        F.array_distinct(F.transform("m", lambda x: x["f"]["evidence_id"])).alias("supporting_evidence_ids"),
        F.lit("computed_ratio_hint").alias("source"),
    )


# --- F34-F37, F41 ------------------------------------------------------------------------


def pack_context(evidence: DataFrame, budget: int = 7000, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """evidence texts in order up to a character budget, the last one cut.

    The running length is a window over rows that already carry only their
    length; texts past the budget never reach the aggregate.
    """
    body = X.strip(F.regexp_replace(X.html_text(F.col("text")), "[ \t]+", " "))
    rows = evidence.select(*keys, "ord", "evidence_id", "doc_id", "heading_path", body.alias("text"))
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).filter(F.col("used") < budget)
    cut = F.substring("text", F.lit(1), (F.lit(budget) - F.col("used")).cast("int"))
    chunk = F.concat(
        F.lit("["), "evidence_id", F.lit("] doc="), F.col("doc_id").cast("string"), F.lit(" heading="), I.heading_text(), F.lit("\n"), cut
    )
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", chunk.alias("c")))), lambda x: x["c"]), "\n\n").alias("context"),
        F.count("*").alias("n_evidence"),
    )


def pack_notes(notes: DataFrame, budget: int = 1800) -> DataFrame:
    """note lines until the first that would overflow the budget."""
    line = F.concat(
        F.lit("- ["), "source_evidence_id", F.lit("] doc="), F.col("doc_id").cast("string"), F.lit(" heading="), "heading", F.lit(": "), X.compact_text("note")
    )
    rows = notes.filter(X.compact_text("note") != "").select("qid", "ord", "note_no", line.alias("line"))
    w = Window.partitionBy("qid").orderBy("ord", "note_no")
    kept = rows.withColumn("used", F.sum(F.length("line")).over(w)).filter(F.col("used") <= budget)
    return kept.groupBy("qid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "note_no", "line"))), lambda x: x["line"]), "\n").alias("notes")
    )


def next_candidates(queue: DataFrame, tried: DataFrame, avoided: DataFrame) -> DataFrame:
    """per ``queue(qid, ord, section_id, title)`` the next section neither tried nor under an avoided title."""
    left = queue.join(tried.select("qid", "section_id").distinct(), ["qid", "section_id"], "left_anti")
    bad = avoided.select("qid", X.match_key("title").alias("avoid")).filter("avoid <> ''").distinct()
    blocked = left.select("qid", "section_id", X.match_key("title").alias("key")).join(bad, "qid").filter(F.contains("key", F.col("avoid")))
    left = left.join(blocked.select("qid", "section_id").distinct(), ["qid", "section_id"], "left_anti")
    return left.groupBy("qid").agg(F.min_by(F.struct("section_id", "title", "ord"), "ord").alias("n")).select("qid", "n.*")


def tried_sections(evidence: DataFrame, n: int = 8) -> DataFrame:
    """distinct headings of a group's evidence, the first eight."""
    rows = evidence.select("qid", "ord", X.repair(I.heading_text()).alias("heading")).withColumn("key", X.match_key("heading")).filter("key <> ''")
    first = rows.groupBy("qid", "key").agg(F.min_by("heading", "ord").alias("heading"), F.min("ord").alias("ord"))
    return first.withColumn("section_no", Q.rank_by(["qid"], F.col("ord"))).filter(F.col("section_no") <= n).select("qid", "section_no", "heading")


def verify_quotes(extractions: DataFrame, evidence: DataFrame) -> DataFrame:
    """``extractions(qid, idx, source_evidence_id, text)`` that stand in their source, as they are or squeezed."""
    source = evidence.select("qid", F.col("evidence_id").alias("source_evidence_id"), "doc_id", "heading_path", X.repair("text").alias("body"), "score")
    quote = X.strip(X.repair(F.coalesce("text", F.lit(""))))
    rows = extractions.select("qid", "idx", "source_evidence_id", quote.alias("quote")).filter("quote <> ''").join(source, ["qid", "source_evidence_id"])
    raw = F.contains("body", F.col("quote"))
    tight = F.contains(X.squeeze("body"), X.squeeze("quote"))
    new_id = F.concat_ws("_extract_", "source_evidence_id", F.col("idx").cast("string"))
    return rows.filter(raw | tight).select(
        "qid", new_id.alias("evidence_id"), "doc_id", new_id.alias("page_id"), "heading_path",
        F.substring(F.when(raw, F.col("quote")).otherwise(X.squeeze("quote")), 1, 700).alias("text"), "score",
        F.lit("evidence_extract").alias("source"), F.col("source_evidence_id").alias("focused_from"),
    )


def slot_text(slots: Column) -> Column:
    """slot names, expectations and queries in order, blanks dropped."""
    parts = F.flatten(F.transform(slots, lambda s: F.concat(F.array(s["slot"], s["expected"]), F.coalesce(s["queries"], none()))))
    return X.strip(X.repair(F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " ")))


def assemble_queries(options: DataFrame, slots: DataFrame, missing: DataFrame, searches: DataFrame) -> DataFrame:
    """the sub-search query of every option: claim, slots, missing slots, past searches, question."""

    def listed(df: DataFrame, name: str, *cols: str) -> DataFrame:
        parts = F.concat_ws(" ", *[X.falsy_null(c) for c in cols])
        return df.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", parts.alias("p")))), lambda x: x["p"]), " ").alias(name))

    flat = slots.withColumn("_q", F.array_join("queries", " "))
    rows = (
        options.join(listed(flat, "s", "slot", "expected", "_q"), "qid", "left")
        .join(listed(missing, "m", "slot", "followup_query"), "qid", "left")
        .join(listed(searches, "p", "query"), "qid", "left")
    )
    parts = [F.col("claim"), F.col("s"), F.col("m"), F.col("p"), F.substring(X.repair("question"), 1, 240)]
    return rows.select("qid", X.strip(X.repair(F.concat_ws(" ", *[X.falsy_null(F.coalesce(p, F.lit(""))) for p in parts]))).alias("query"))


def export_candidates(evidence: DataFrame, tasks: DataFrame, exported: DataFrame) -> DataFrame:
    """rows worth a model's reading: long new ones, decisions with rules, or several slots and 500 characters."""
    rows = evidence.join(exported.select("qid", "evidence_id").distinct(), ["qid", "evidence_id"], "left_anti").join(tasks.select("qid", "question", "n_slots"), "qid")
    text = X.html_text(F.col("text"))
    rows = rows.withColumn("_text", text)
    long_new = (F.col("source") != "evidence_extract") & (F.length(X.compact_text("text")) > INNER_MIN_CHARS)
    ruled = any_of(X.repair("question"), DECISION_TERMS) & any_of(F.col("_text"), NORMATIVE_TERMS)
    many = (F.col("n_slots") >= 2) & (F.length("_text") >= 500)
    reason = F.when(long_new, "long").when(F.length("_text") >= 1000, "bulky").when(ruled, "rule").when(many, "slots")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").drop("_text", "question", "n_slots")


# --- F38-F40 ------------------------------------------------------------------------------


def initial_round(options: DataFrame, plans: DataFrame, slots: DataFrame, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """first evidence of every ``options(qid, domain, question, option, claim)``.

    Planned searches ``plans(qid, ord, query, doc_id)`` come first, else up to
    four slot queries on the target documents ``docs(qid, doc_id)``, else the
    question with the claim. The first two are joined by summary pages,
    re-ranked and capped by the number of documents. Slot queries keep the
    order of slots and of each list; target documents that of ``doc_ord``,
    or of their id without it.
    """
    place = F.col("doc_ord") if "doc_ord" in docs.columns else F.col("doc_id")
    docs = docs.groupBy("qid", "doc_id").agg(F.min(place).alias("doc_ord"))
    n_docs = docs.groupBy("qid").agg(F.count("*").alias("n_docs"))
    texts = slots.select("qid", "ord", F.posexplode("queries").alias("pos", "query"))
    texts = texts.select("qid", "ord", "pos", X.strip(X.repair("query")).alias("query")).filter("query <> ''")
    texts = texts.groupBy("qid", "query").agg(F.min(F.struct("ord", "pos")).alias("first"))
    texts = texts.withColumn("ord", Q.rank_by(["qid"], F.col("first"))).filter("ord <= 4").drop("first")
    planned = plans.select("qid", "ord", "query", "doc_id", F.lit(1).alias("tier"), F.lit(2).alias("k"))
    by_slot = texts.join(docs.select("qid", "doc_id").distinct(), "qid").select("qid", "ord", "query", "doc_id", F.lit(2).alias("tier"), F.lit(2).alias("k"))
    whole = F.concat(X.repair("question"), F.lit("\n"), "option", F.lit(". "), "claim")
    plain = options.select("qid", F.lit(1).alias("ord"), whole.alias("query")).join(docs.select("qid", "doc_id").distinct(), "qid")
    plain = plain.select("qid", "ord", "query", "doc_id", F.lit(3).alias("tier"), F.lit(INITIAL_K).alias("k"))
    asked = planned.unionByName(by_slot).unionByName(plain)
    asked = asked.withColumn("_best", F.min("tier").over(Window.partitionBy("qid"))).filter("tier = _best").drop("_best")
    asked = asked.join(options.select("qid", "domain"), "qid").withColumn("rid", F.concat_ws("#", "qid", F.col("ord").cast("string")))

    hits = Q.retrieve_multi(asked.select(F.col("rid").alias("qid"), "domain", "query", "doc_id"), pages, INITIAL_K, "initial")
    hits = hits.withColumnRenamed("qid", "rid").join(asked.select("rid", "qid", "doc_id", F.col("ord").alias("query_ord"), "k", "tier"), ["rid", "doc_id"]).filter("rank <= k")
    hits = hits.join(docs, ["qid", "doc_id"], "left")
    hits = hits.withColumn("ord", Q.rank_by(["qid"], F.col("query_ord"), F.col("doc_ord").asc_nulls_last(), F.col("doc_id"), F.col("rank")))
    cols = ["qid", "evidence_id", "doc_id", "page_id", "page_no", "heading_path", "text", "score", "source", "ord"]
    tier = asked.groupBy("qid").agg(F.min("tier").alias("tier"))

    slot_words = slots.groupBy("qid").agg(slot_text(F.transform(F.array_sort(F.collect_list(F.struct("ord", "slot", "expected", "queries"))), lambda x: x)).alias("words"))
    extra = asked.filter("tier < 3").groupBy("qid").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "query"))), lambda x: x["query"])), " ").alias("asked"))
    query = options.join(slot_words, "qid", "left").join(extra, "qid").select("qid", F.concat_ws(" ", "claim", X.falsy_null("words"), X.falsy_null("asked")).alias("query"))
    summary = summary_candidates(pages, query.join(docs.select("qid", "doc_id").distinct(), "qid"))
    summary = summary.join(docs, ["qid", "doc_id"], "left").withColumn("ord", Q.rank_by(["qid"], F.col("doc_ord"), F.col("doc_id"), F.col("rank"))).select(*cols)
    ranked = rerank(merge_evidence(hits.join(tier.filter("tier < 3"), "qid", "left_semi").select(*cols), summary), query)
    cap = F.greatest(F.lit(INITIAL_K + 2), F.least(F.lit(10), F.col("n_docs") * (INITIAL_K + 2)))
    ranked = ranked.join(n_docs, "qid").filter(F.col("rank") <= cap).withColumn("ord", F.col("rank")).select(*cols)
    whole_rows = first_by_id(hits.join(tier.filter("tier = 3"), "qid", "left_semi").select(*cols))
    return ranked.unionByName(whole_rows)


def followup_round(missing: DataFrame, docs: DataFrame, pages: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """evidence for ``missing(qid, domain, slot, query, key_terms)``: the query and its ratio parts, term coverage, slot re-rank.

    Every missing slot is a request of its own, with its own cap; the result
    carries ``slot``. A slot with ``target_doc_ids`` looks there, any other in
    all documents of its question; ``added(qid, slot, doc_id)`` come on top.
    Where a share is asked, the amounts found for it make a row of their own
    (D14), which enters the re-rank before all others.
    """
    slot_id = F.concat_ws("\x1f", "qid", F.coalesce("slot", F.lit("")))
    asked_slots = missing.withColumn("sid", slot_id)
    named = asked_slots.select("qid", "slot", "sid").distinct()
    targets = named.join(docs.select("qid", "doc_id").distinct(), "qid").select("sid", "doc_id")
    if "target_doc_ids" in missing.columns:
        own = asked_slots.select("sid", F.explode("target_doc_ids").alias("doc_id")).distinct()
        targets = own.unionByName(targets.join(own.select("sid").distinct(), "sid", "left_anti"))
    if added is not None:
        more = added.withColumn("sid", slot_id).join(named.select("sid"), "sid", "left_semi").select("sid", "doc_id")
        targets = targets.unionByName(more).distinct()
    targets = targets.withColumnRenamed("sid", "qid")
    asked_slots = asked_slots.withColumn("qid", F.col("sid"))

    queries = F.array_distinct(F.concat(F.array("query"), ratio_parts(F.col("query"))))
    asked = asked_slots.filter("query <> ''").select("qid", "domain", F.posexplode(queries).alias("ord", "query"))
    requests = asked.join(targets, "qid").withColumn("rid", F.concat_ws("#", "qid", F.col("ord").cast("string")))
    hits = Q.retrieve_multi(requests.select(F.col("rid").alias("qid"), "domain", "query", "doc_id"), pages, FOLLOWUP_K, "followup")
    hits = hits.withColumnRenamed("qid", "rid").join(requests.select("rid", "qid", "doc_id", F.col("ord").alias("query_ord")), ["rid", "doc_id"])
    hits = hits.withColumn("source", F.when(F.col("query_ord") > 0, "followup_computed_part").otherwise(F.col("source")))
    hits = hits.withColumn("ord", Q.rank_by(["qid"], F.col("query_ord"), F.col("doc_id"), F.col("rank")))
    cols = ["qid", "evidence_id", "doc_id", "page_id", "page_no", "heading_path", "text", "score", "source", "ord"]
    terms = asked_slots.select("qid", key_terms(F.col("key_terms"), F.concat_ws(" ", "slot", "query"), 10).alias("key_terms"))
    covered = term_coverage(pages, targets.join(terms, "qid"))
    covered = covered.withColumn("ord", Q.rank_by(["qid"], F.col("doc_id"), F.col("rank"))).select(*cols)
    merged = cut_lineage(merge_evidence(hits.select(*cols), covered))
    shares = computed_ratio(asked_slots.select("qid", "query"), merged)
    hint = shares.select(
        "qid", "evidence_id", F.lit("").alias("doc_id"), F.lit("").alias("page_id"), F.lit(0).cast(dict(merged.dtypes)["page_no"]).alias("page_no"),
        none().alias("heading_path"), "text", F.lit(0.0).alias("score"), "source", F.lit(1).alias("ord"),
    )
    merged = merge_evidence(hint, merged)
    n_docs = targets.groupBy("qid").agg(F.count("*").alias("n_docs"))
    cap = F.greatest(F.lit(FOLLOWUP_K + 2), F.least(F.lit(8), F.col("n_docs") * (FOLLOWUP_K + 1)))
    slots = asked_slots.select("qid", "slot", "query").join(terms, "qid").join(n_docs, "qid").withColumn("cap", cap).drop("n_docs")
    found = rerank_slot(merged, slots).drop("slot").withColumnRenamed("qid", "sid")
    return found.join(named, "sid").drop("sid")


def repair_round(hints: DataFrame, sections: DataFrame, bridge: DataFrame, pages: DataFrame) -> DataFrame:
    """up to three ``hints(qid, ord, domain, doc_id, hint, query, key_terms)`` per option, three re-ranked rows each."""
    kept = hints.withColumn("_n", Q.rank_by(["qid"], F.col("ord"))).filter("_n <= 3").drop("_n")
    query = F.coalesce(X.falsy_null("query"), "hint")
    kept = kept.withColumn("rid", F.concat_ws("#", "qid", F.col("ord").cast("string"))).withColumn("query", query).withColumn("hint", F.coalesce(X.falsy_null("hint"), query))
    found = S.hint_search(kept.select(F.col("rid").alias("qid"), "domain", "doc_id", "hint", "query"), sections, bridge, pages, 3)
    ranked = rerank_slot(
        found.withColumn("ord", F.col("rank")), kept.select(F.col("rid").alias("qid"), F.col("hint").alias("slot"), "query", "key_terms"), 3
    )
    rows = ranked.withColumnRenamed("qid", "rid").join(kept.select("rid", "qid", F.col("ord").alias("hint_ord")), "rid")
    return rows.withColumn("ord", Q.rank_by(["qid"], F.col("hint_ord"), F.col("rank"))).drop("rid", "hint_ord")
