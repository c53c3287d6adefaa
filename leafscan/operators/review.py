"""Which evidence to read, judge, reject and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions import text as X
from leafscan.operators import search as Q
from leafscan.operators.evidence import any_of

READ_ITEMS = 6
JUDGE_EXTRA = 8
REJECT_CAP = 3
SUMMARY_ITEMS = 8
SUMMARY_CHARS = 600

# Words of duties, of times and actions, and their limits.
DUTY_TERMS = ("应当", "不得", "可以", "必须", "应", "不予", "终止", "拒绝", "限制", "申请", "公告", "披露", "报告", "核实", "认定")
TIME_TERMS = ("当日", "次一工作日", "工作日", "交易日", "非交易", "期限", "之前", "以内", "同时", "及时", "申请公告", "向证券交易所", "提交", "办理")
OBLIGATION_CHARS = (12, 260)
# Both axes of a cost and quality question.
COST_AXIS = ("降本", "成本", "费用", "费率", "节约", "降低", "下降", "功耗", "耗能", "效率")
QUALITY_AXIS = ("提质", "性能", "提升", "提高", "优化", "速率", "速度", "精度", "可靠", "稳定", "良率", "带宽", "低时延")
# Words of missing slots that ask for figures, and of contents pages.
FIGURE_SLOT_TERMS = ("年", "%", "同比", "增速", "增长", "比例", "占比", "贡献", "金额", "规模", "排名", "市场份额", "剪刀差", "收入", "利润", "表", "图")
CONTENTS_TERMS = ("目录", "图表目录", "图 ", "图:", "图：", "表 ", "表:", "表：")
# Words by which a router calls a document irrelevant.
NEGATIVE_REASONS = ("关联度低", "相关度低", "无关", "不相关", "非直接相关", "备选", "仅作参考", "可能作为备选")
CONFIDENT, MARGIN, FLOOR, SHARE, HIGH_SHARE, DEMOTE_SHARE = 16.0, 1.2, 10.0, 0.55, 0.9, 0.7


# --- D20, D27, D29 ---------------------------------------------------------------


def obligations(pages: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` sentences per page with a duty word and a time or action word, by their place.

    Sentences end at 。；; or before an article number; one that repeats
    another but for spacing and punctuation is left out, a long one is cut.
    """
    least, most = OBLIGATION_CHARS
    clean = X.strip(F.regexp_replace(X.repair("text"), r"\s+", " "))
    marked = F.regexp_replace(clean, r"(?<=[。；;])\s*|(?=第[一二三四五六七八九十百\d]+条)", "\x01")
    parts = pages.select("doc_id", "page_id", F.posexplode(F.split(marked, "\x01")).alias("pos", "raw"))
    rows = parts.select("doc_id", "page_id", "pos", X.strip("raw", " ；;。").alias("sentence"))
    rows = rows.filter((F.length("sentence") >= least) & any_of(F.col("sentence"), DUTY_TERMS) & any_of(F.col("sentence"), TIME_TERMS))
    rows = rows.withColumn("sentence", X.strip(F.substring("sentence", 1, most)))
    rows = rows.withColumn("key", F.regexp_replace(F.lower("sentence"), r"[\s\p{Punct}\p{IsPunctuation}]+", ""))
    first = rows.groupBy("doc_id", "page_id", "key").agg(F.min("pos").alias("pos"), F.min_by("sentence", "pos").alias("sentence"))
    ranked = first.withColumn("obligation_no", Q.rank_by(["page_id"], F.col("pos"))).filter(F.col("obligation_no") <= n)
    return ranked.select("doc_id", "page_id", "obligation_no", "sentence")


def axis_flags(text: Column) -> tuple[Column, Column]:
    """Whether a text speaks of cost, and of quality."""
    return any_of(X.repair(text), COST_AXIS), any_of(X.repair(text), QUALITY_AXIS)


def hint_flags(missing: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per question, whether a missing slot asks for figures and whether evidence looks like contents.

    ``missing(qid, slot, query)``, ``evidence(qid, heading_path, text)``.
    """
    asked = any_of(X.repair(F.concat_ws(" ", "slot", "query")), FIGURE_SLOT_TERMS)
    figures = missing.groupBy("qid").agg(F.max(asked).alias("figures"))
    surface = F.concat(X.compact_text(F.array_join("heading_path", " > ")), F.substring(X.compact_text("text"), 1, 1000))
    contents = evidence.groupBy("qid").agg(F.max(any_of(surface, CONTENTS_TERMS)).alias("contents"))
    both = figures.join(contents, "qid", "full")
    return both.select("qid", F.coalesce("figures", F.lit(False)).alias("figures"), F.coalesce("contents", F.lit(False)).alias("contents"))


# --- F27 -------------------------------------------------------------------------


def _named(evidence: DataFrame, lists: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Evidence rows named by ``lists(qid, kind, pos, evidence_id)``, each with its first place by kind and position."""
    tier = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")).cast("int")
    named = lists.filter(F.col("kind").isin(*kinds) & (F.col("evidence_id") != "")).select("qid", "evidence_id", tier.alias("tier"), "pos")
    return named.groupBy("qid", "evidence_id").agg(F.min(F.struct("tier", "pos")).alias("place"))


def review_order(evidence: DataFrame, lists: DataFrame) -> DataFrame:
    """all evidence of a question: new ids, remembered ones, memory slots, audited slots, then the rest.

    ``evidence(qid, ord, evidence_id, ...)``; ``lists(qid, kind, pos,
    evidence_id)`` with kinds ``new``, ``remembered``, ``slot`` and ``audit``.
    """
    places = _named(evidence, lists, ("new", "remembered", "slot", "audit"))
    rows = evidence.join(places, ["qid", "evidence_id"], "left")
    tier, pos = F.coalesce("place.tier", F.lit(9)), F.coalesce("place.pos", "ord")
    return rows.withColumn("review_no", Q.rank_by(["qid"], tier, pos, F.col("ord"))).drop("place")


def read_set(evidence: DataFrame, lists: DataFrame, n: int = READ_ITEMS) -> DataFrame:
    """up to ``n`` rows to read: those of the current batch (kind ``current``, else ``new``), else the first of the review order.

    Extracted text comes first, then sub-searches and focused text, then the rest, each by score.
    """
    batch = lists.filter(F.col("kind").isin("current", "new") & (F.col("evidence_id") != ""))
    kind = batch.groupBy("qid").agg(F.min("kind").alias("kind"))  # "current" sorts before "new"
    named = batch.join(kind, ["qid", "kind"]).select("qid", "evidence_id").distinct()
    chosen = evidence.join(named, ["qid", "evidence_id"], "left_semi")
    other = review_order(evidence, lists).filter(F.col("review_no") <= n).drop("review_no").join(chosen.select("qid").distinct(), "qid", "left_anti")
    rows = chosen.unionByName(other.select(*chosen.columns))
    source = F.when(F.col("source") == "evidence_extract", 0).when(F.col("source").isin("evidence_local_subsearch", "evidence_inner_focus"), 1).otherwise(5)
    return rows.withColumn("read_no", Q.rank_by(["qid"], source, F.desc(F.coalesce("score", F.lit(0.0))), F.col("ord"))).filter(F.col("read_no") <= n)


def judge_set(evidence: DataFrame, lists: DataFrame, audits: DataFrame) -> DataFrame:
    """evidence a judgment may use, in order: remembered, new, memory slots, audited slots.

    While ``audits(qid, can_judge, n_missing)`` leave something open, the first
    rows of the review order follow. A question without any named row takes
    the whole review order.
    """
    places = _named(evidence, lists, ("remembered", "new", "slot", "audit"))
    order = review_order(evidence, lists)
    rows = order.join(places, ["qid", "evidence_id"], "left").join(audits.select("qid", "can_judge", "n_missing"), "qid", "left")
    any_named = F.max(F.col("place").isNotNull()).over(Window.partitionBy("qid"))
    is_open = ~F.coalesce("can_judge", F.lit(False)) | (F.coalesce("n_missing", F.lit(0)) > 0)
    rows = rows.withColumn("_any", any_named)
    rows = rows.filter(F.col("place").isNotNull() | ~F.col("_any") | (is_open & (F.col("review_no") <= JUDGE_EXTRA)))
    first = [F.coalesce("place.tier", F.lit(9)), F.coalesce("place.pos", "review_no"), F.col("review_no")]
    return rows.withColumn("judge_no", Q.rank_by(["qid"], *first)).drop("place", "_any", "can_judge", "n_missing", "review_no")


# --- F33 -------------------------------------------------------------------------


def reject(evidence: DataFrame, reviewed: DataFrame, used: DataFrame, audits: DataFrame, cap: int = REJECT_CAP) -> DataFrame:
    """``qid, evidence_id`` of repair evidence that an open audit did not use, ``cap`` per question at most.

    ``evidence(qid, evidence_id, doc_id, source, subsearch_source)``,
    ``reviewed(qid, pos, evidence_id)``, ``used(qid, evidence_id)`` (a document
    id stands for all its evidence), ``audits(qid, can_judge, n_filled,
    n_missing, target_doc_ids)``. Empty targets allow every document.
    """
    still_open = audits.filter(~F.coalesce("can_judge", F.lit(False)) & (F.col("n_missing") > 0) & (F.col("n_filled") == 0))
    repair = F.col("source").startswith("toc_repair") | (
        (F.col("source") == "evidence_local_subsearch") & F.col("subsearch_source").isin("toc_repair", "followup")
    )
    rows = evidence.filter(repair).join(reviewed.groupBy("qid", "evidence_id").agg(F.min("pos").alias("pos")), ["qid", "evidence_id"])
    targets = F.coalesce("target_doc_ids", F.array().cast("array<string>"))
    rows = rows.join(still_open.select("qid", targets.alias("targets")), "qid").filter((F.size("targets") == 0) | F.array_contains("targets", F.col("doc_id")))
    ids = used.select("qid", "evidence_id").distinct()
    rows = rows.join(ids, ["qid", "evidence_id"], "left_anti").join(ids.withColumnRenamed("evidence_id", "doc_id"), ["qid", "doc_id"], "left_anti")
    return rows.withColumn("_n", Q.rank_by(["qid"], F.col("pos"))).filter(F.col("_n") <= cap).select("qid", "evidence_id")


def without_rejected(evidence: DataFrame, rejected: DataFrame) -> DataFrame:
    """evidence that is neither rejected nor cut out of rejected evidence."""
    ids = rejected.select("qid", "evidence_id").distinct()
    kept = evidence.join(ids, ["qid", "evidence_id"], "left_anti")
    return kept.join(ids.withColumnRenamed("evidence_id", "focused_from"), ["qid", "focused_from"], "left_anti").select(*evidence.columns)


# --- G11 -------------------------------------------------------------------------


def confident_routes(scores: DataFrame, many: DataFrame | None = None, n: int = 2) -> DataFrame:
    """Documents of a clear route: the best scores 16 or more and 1.2 times the second; others from 10 and 0.55 of the best on.

    ``scores(qid, doc_id, score, rank)``; questions in ``many(qid)`` take three documents.
    """
    best = scores.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    clear = (F.col("best") >= CONFIDENT) & (F.coalesce("second", F.lit(0.0)) * MARGIN <= F.col("best"))
    rows = scores.join(best, "qid").filter(clear & (F.col("score") >= FLOOR) & (F.col("score") >= F.col("best") * SHARE))
    limit = F.lit(n)
    if many is not None:
        rows = rows.join(many.select("qid", F.lit(True).alias("_many")).distinct(), "qid", "left")
        limit = F.when(F.col("_many"), max(n, 3)).otherwise(n)
    return rows.filter(F.col("rank") <= limit).select(*scores.columns)


def high_score_routes(scores: DataFrame, n: int = 2) -> DataFrame:
    """Up to ``n`` documents within 0.9 of a best score of 16 or more."""
    best = scores.groupBy("qid").agg(F.max("score").alias("best"))
    return scores.join(best, "qid").filter((F.col("best") >= CONFIDENT) & (F.col("rank") <= n) & (F.col("score") >= F.col("best") * HIGH_SHARE)).select(*scores.columns)


def demoted(strong: DataFrame, hinted: DataFrame, scores: DataFrame) -> DataFrame:
    """Questions whose strong documents ``strong(qid, doc_id)`` give way to the hinted ones.

    No hinted document is strong, the best of the first four scores 16 or more, and the strong ones reach less than 0.7 of it.
    """
    shared = strong.join(hinted, ["qid", "doc_id"], "left_semi").select("qid").distinct()
    both = strong.select("qid").distinct().join(hinted.select("qid").distinct(), "qid").join(shared, "qid", "left_anti")
    marked = scores.filter("rank <= 4").join(strong.select("qid", "doc_id", F.lit(True).alias("_strong")).distinct(), ["qid", "doc_id"], "left")
    best = marked.groupBy("qid").agg(F.max("score").alias("best"), F.max(F.when(F.col("_strong"), F.col("score"))).alias("own"))
    return both.join(best, "qid").filter((F.col("best") >= CONFIDENT) & (F.coalesce("own", F.lit(0.0)) < F.col("best") * DEMOTE_SHARE)).select("qid")


def relevant_targets(targets: DataFrame) -> DataFrame:
    """``targets(qid, doc_id, reason)`` without those whose reason calls them irrelevant, unless that leaves none."""
    negative = any_of(X.repair(F.coalesce("reason", F.lit(""))), NEGATIVE_REASONS)
    rows = targets.withColumn("_negative", negative)
    good = rows.groupBy("qid").agg(F.max(~F.col("_negative")).alias("_good"))
    return rows.join(good, "qid").filter(~F.col("_negative") | ~F.col("_good")).select(*targets.columns)


# What calls for the rules on disclosure, and the name those rules go by.
DISCLOSURE_SUBJECT = "上市公司"
DISCLOSURE_TERMS = ("信息披露", "重大信息", "重大事项", "临时报告", "公告", "及时", "公平", "非交易")
DISCLOSURE_RULES = ("上市公司", "信息披露", "管理办法")


def foundational_docs(contexts: DataFrame, candidates: DataFrame, names: DataFrame, targets: DataFrame, n: int = 2) -> DataFrame:
    """``qid, doc_id, added_no``: the rules on disclosure for questions about what listed companies must disclose.

    ``contexts(qid, context)``, ``candidates(qid, doc_id, ord)``,
    ``names(doc_id, pos, name)`` (the title and the first eight aliases count),
    ``targets(qid, doc_id)`` are routed already. Up to ``n`` in order.
    """
    text = X.repair(F.coalesce("context", F.lit("")))
    asked = contexts.filter(F.contains(text, F.lit(DISCLOSURE_SUBJECT)) & any_of(text, DISCLOSURE_TERMS)).select("qid")
    known = names.filter("pos <= 8").groupBy("doc_id").agg(
        X.repair(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " ")).alias("identity")
    )
    rules = known.filter(F.contains("identity", F.lit(DISCLOSURE_RULES[0])) & F.contains("identity", F.lit(DISCLOSURE_RULES[1])) & F.contains("identity", F.lit(DISCLOSURE_RULES[2])))
    rows = candidates.join(rules.select("doc_id"), "doc_id", "left_semi").join(asked, "qid", "left_semi").join(targets.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_anti")
    return rows.withColumn("added_no", Q.rank_by(["qid"], F.col("ord"))).filter(F.col("added_no") <= n).select("qid", "doc_id", "added_no")


# --- H15 -------------------------------------------------------------------------


def evidence_summary(evidence: DataFrame, n: int = SUMMARY_ITEMS) -> DataFrame:
    """The first ``n`` distinct evidence rows of a question, over its options in order, with a quote.

    ``evidence(qid, option_ord, ord, evidence_id, page_id, doc_id, heading_path, text, source)``.
    """
    found = F.coalesce(X.falsy_null("evidence_id"), "page_id", F.lit(""))
    rows = evidence.withColumn("evidence_id", found)
    key = F.coalesce(X.falsy_null("evidence_id"), F.substring("text", 1, 120))
    seen = Window.partitionBy("qid", "_key").orderBy("option_ord", "ord")
    rows = rows.withColumn("_key", key).withColumn("_seen", F.row_number().over(seen)).filter("_seen = 1")
    rows = rows.withColumn("item_no", Q.rank_by(["qid"], F.col("option_ord"), F.col("ord"))).filter(F.col("item_no") <= n)
    doc = F.coalesce(X.falsy_null("doc_id"), F.substring_index("evidence_id", "_", 1))
    page = F.coalesce(X.falsy_null("page_id"), "evidence_id")
    heading = F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ")
    quote = F.substring(X.compact_text("text"), 1, SUMMARY_CHARS)
    return rows.select("qid", "item_no", doc.alias("doc_id"), page.alias("page_id"), "evidence_id", heading.alias("heading"), quote.alias("quote"), F.coalesce("source", F.lit("")).alias("source"))


def summary_facts(slots: DataFrame) -> DataFrame:
    """Distinct facts of ``slots(qid, ord, slot, value, evidence_ids)`` in order, marked as taken from the question or a document."""
    ids = F.filter(F.coalesce("evidence_ids", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    rows = slots.select("qid", "ord", X.strip(F.coalesce("slot", F.lit(""))).alias("slot"), X.strip(F.coalesce("value", F.lit(""))).alias("value"), ids.alias("ids"))
    first = rows.filter("slot <> '' AND value <> ''").groupBy("qid", "slot", "value", "ids").agg(F.min("ord").alias("ord"))
    source = F.when(F.array_contains("ids", "题干"), "user_query").otherwise("document")
    return first.select("qid", "ord", "slot", "value", F.slice("ids", 1, 6).alias("evidence_ids"), source.alias("source"))


# Raw answers that mean yes and no, and what they mean per task type.
YES, NO = ("T", "A", "TRUE", "正确"), ("F", "B", "FALSE", "错误")
ANSWER_LABELS = {
    "claim_verification": ("supported", "contradicted_or_insufficient"),
    "rule_applicability": ("applicable", "not_applicable_or_insufficient"),
}
REASONS, FACTS = 2, 8


def answer_label(task_type: Column, raw: Column) -> Column:
    """What a final answer says for its task type; other answers as they are."""
    answer = X.strip(F.coalesce(raw, F.lit("")))
    out = answer
    for kind, (yes, no) in ANSWER_LABELS.items():
        out = F.when((task_type == kind) & answer.isin(*YES), yes).when((task_type == kind) & answer.isin(*NO), no).otherwise(out)
    return out


def summary_reasons(judgments: DataFrame, overall: DataFrame, n: int = REASONS) -> DataFrame:
    """``qid, reason``: the first ``n`` reasons of ``judgments(qid, option_ord, reason)``, a line each; else that of ``overall(qid, reason)``."""
    given = judgments.filter(F.coalesce("reason", F.lit("")) != "").withColumn("_n", Q.rank_by(["qid"], F.col("option_ord"))).filter(F.col("_n") <= n)
    lines = given.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "reason"))), lambda x: x["reason"]), "\n").alias("lines"))
    whole = overall.groupBy("qid").agg(F.first("reason", True).alias("whole"))
    return lines.join(whole, "qid", "full").select("qid", F.coalesce("lines", X.falsy_null("whole"), F.lit("")).alias("reason"))


def first_confidence(judgments: DataFrame, overall: DataFrame) -> DataFrame:
    """``qid, confidence``: the first number given by the overall judgment, else by the options in order; NULL without one."""
    own = overall.select("qid", F.lit(0).alias("place"), F.col("confidence").cast("string").alias("raw"))
    rows = own.unionByName(judgments.select("qid", (F.col("option_ord") + 1).cast("int").alias("place"), F.col("confidence").cast("string").alias("raw")))
    given = rows.filter("raw IS NOT NULL AND raw <> ''").groupBy("qid").agg(F.min_by("raw", "place").alias("raw"))
    return rows.select("qid").distinct().join(given, "qid", "left").select("qid", F.expr("try_cast(raw AS double)").alias("confidence"))


def answer_summary(states: DataFrame, evidence: DataFrame, slots: DataFrame, judgments: DataFrame, overall: DataFrame, errors: DataFrame) -> DataFrame:
    """A result row per question: status, label, raw answer, evidence, facts, question facts, reason, confidence and error.

    ``states(qid, task_type, status, final_answer)``; ``errors(qid, error)``
    are questions whose run failed: their row has the status ``error``, the
    message and nothing else.
    """
    items = evidence_summary(evidence)
    quotes = items.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("item_no", *[c for c in items.columns if c not in ("qid", "item_no")]))).alias("evidence"))
    facts = summary_facts(slots).withColumn("_n", Q.rank_by(["qid", "source"], F.col("ord"))).filter(F.col("_n") <= FACTS)
    one = F.struct("ord", "slot", "value", "evidence_ids")
    said = lambda source: F.array_sort(F.collect_list(F.when(F.col("source") == source, one)))
    sorted_facts = facts.groupBy("qid").agg(said("document").alias("facts"), said("user_query").alias("question_info"))
    failed = errors.groupBy("qid").agg(F.first("error", True).alias("error"))
    rows = states.select("qid", "status", answer_label(F.col("task_type"), F.col("final_answer")).alias("answer"), F.coalesce("final_answer", F.lit("")).alias("raw_final_answer"))
    rows = rows.join(quotes, "qid", "left").join(sorted_facts, "qid", "left").join(summary_reasons(judgments, overall), "qid", "left")
    rows = rows.join(first_confidence(judgments, overall), "qid", "left").join(failed, "qid", "full")
    wrong = F.col("error").isNotNull()
    kept = [F.when(~wrong, F.col(c)).alias(c) for c in ("answer", "raw_final_answer", "evidence", "facts", "question_info", "reason", "confidence")]
    return rows.select("qid", F.when(wrong, "error").otherwise(F.col("status")).alias("status"), *kept, "error")
