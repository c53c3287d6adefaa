"""Audit, judgment and answer rules over tables of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import focus as C
from leafscan.functions import text as X
from leafscan.operators import evidence as V
from leafscan.operators import index as I
from leafscan.operators import search as Q

none, any_of = V.none, V.any_of

# Wording of values that settle nothing.
INSUFFICIENT_VALUES = ("未找到", "未在证据中找到", "未提供", "没有找到", "无法确定", "无法判断", "证据不足", "缺少证据", "不明确")
INCOMPLETE = (
    r"\?", "？", "未知", "未给出", "未直接给出", "缺失", "缺少", "无法", "不能", "待定", "需计算", "需要计算", "另行计算", "需另行计算",
    "需要另行计算", "另行确认", "需另行确认", "需要另行确认", "另行补充", "需另行补充", "需进一步", "需要进一步", "待补充", "待计算", "待确认",
)
RELATION_SLOTS = ("高于", "低于", "大于", "小于", "超过", "不足", "均", "比较", "占比", "比例", "比重")
RESULT_SLOTS = ("最终", "结果", "答案", "实际退保金额", "退保金额", "所得金额", "计算结果", "排序")
LACKING = ("缺少", "未提供", "需从", "需要", "待定", "未知", "无法")
OPTION_VALUES = ("选项A", "选项B", "选项C", "选项D", "以选项")
BARE_SLOTS = (
    "是否", "较", "相比", "比", "高于", "低于", "大于", "小于", "多于", "少于", "增长", "下降", "上升", "减少", "增加", "提升", "降低",
)
BARE_VALUES = (
    "是", "否", "正确", "错误", "增长", "下降", "上升", "减少", "增加", "提升", "降低", "高于", "低于", "大于", "小于", "多于", "少于",
)


def is_incomplete(slot: Column, value: Column) -> Column:
    """H1: a filled value that leaves its slot open."""
    s, v = X.strip(X.repair(F.coalesce(slot, F.lit("")))), X.strip(X.repair(F.coalesce(value, F.lit(""))))
    relation = any_of(s, RELATION_SLOTS) & (any_of(v, ("已比较", "已确认事实", "可反推")) | v.rlike(rf"[<>＞＜][{X.WS}]*$"))
    return (v == "") | any_of(v, INCOMPLETE) | relation


def normalize_audit(filled: DataFrame, missing: DataFrame, options: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """H1: kept filled slots, complete missing slots and the verdict per option.

    ``filled(qid, ord, slot, value, evidence_ids, query, key_terms)``,
    ``missing(qid, ord, slot, query, target_doc_ids, key_terms)``,
    ``options(qid, claim, target_doc_ids, can_judge)``.
    """
    cites = filled.select("qid", "ord", F.explode(F.coalesce("evidence_ids", none())).alias("evidence_id")).filter("evidence_id <> ''")
    body = evidence.select("qid", "evidence_id", F.concat_ws("\n", X.repair(I.heading_text()), X.repair("text")).alias("body"))
    support = cites.join(body, ["qid", "evidence_id"]).groupBy("qid", "ord").agg(
        F.array_distinct(F.flatten(F.collect_list(E.number_tokens(F.col("body"))))).alias("support")
    )
    ids = F.filter(F.coalesce("evidence_ids", none()), lambda i: i != "")
    rows = filled.join(options.select("qid", "claim", F.col("target_doc_ids").alias("docs")), "qid").join(support, ["qid", "ord"], "left")
    rows = rows.withColumn("cited", F.size(ids) > 0)
    copied = F.array_intersect(E.number_tokens(F.coalesce("value", F.lit(""))), E.number_tokens(F.coalesce("claim", F.lit(""))))
    unsupported = F.col("cited") & (F.size(copied) > 0) & ~F.arrays_overlap(copied, F.coalesce("support", none()))
    rows = rows.withColumn(
        "open", is_incomplete(F.col("slot"), F.col("value")) | (~F.col("cited") & any_of(X.repair(F.coalesce("value", F.lit(""))), INSUFFICIENT_VALUES)) | unsupported
    )
    kept = rows.filter(~F.col("open")).select(*filled.columns)

    declared = missing.join(options.select("qid", F.col("target_doc_ids").alias("docs")), "qid").select(
        "qid", F.lit(0).alias("side"), "ord", "slot", "query", "key_terms", F.array_intersect(F.coalesce("target_doc_ids", none()), F.coalesce("docs", none())).alias("targets"), "docs"
    )
    reopened = rows.filter("open").select("qid", F.lit(1).alias("side"), "ord", "slot", "query", "key_terms", F.coalesce("docs", none()).alias("targets"), "docs")
    both = declared.unionByName(reopened)
    slot = X.strip(X.repair(F.coalesce("slot", F.lit(""))))
    both = both.withColumn("slot", slot).withColumn("query", F.coalesce(X.falsy_null(X.strip(X.repair(F.coalesce("query", F.lit(""))))), "slot"))
    both = both.filter("slot <> '' OR query <> ''")
    first = Window.partitionBy("qid", "slot", "query", F.array_join("targets", "/")).orderBy("side", "ord")
    both = both.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    listed = both.select(
        "qid",
        Q.rank_by(["qid"], F.col("side"), F.col("ord")).alias("ord"),
        F.coalesce(X.falsy_null("slot"), "query").alias("slot"),
        F.when(F.size("targets") > 0, F.col("targets")).otherwise(F.coalesce("docs", none())).alias("target_doc_ids"),
        F.coalesce(X.falsy_null("query"), "slot").alias("followup_query"),
        V.key_terms(F.col("key_terms"), F.concat_ws(" ", "slot", "query")).alias("key_terms"),
    )
    open_ = listed.select("qid").distinct().withColumn("_open", F.lit(True))
    verdict = options.join(open_, "qid", "left").select("qid", (F.coalesce("can_judge", F.lit(False)) & F.col("_open").isNull()).alias("can_judge"))
    return kept, listed, verdict


def is_bare_relation(slot: Column, value: Column) -> Column:
    """H2: a comparison answered by a word, without any figure."""
    s, v = X.strip(X.repair(F.coalesce(slot, F.lit("")))), X.strip(X.repair(F.coalesce(value, F.lit(""))))
    return (s != "") & (v != "") & (F.size(E.number_tokens(v)) == 0) & any_of(s, BARE_SLOTS) & any_of(v, BARE_VALUES)


def filter_facts(filled: DataFrame, variant: str = "src") -> DataFrame:
    """H2: facts that are rules or inputs: no results, no gaps, no bare relations (variant b keeps cited ones)."""
    s, v = X.strip(X.repair(F.coalesce("slot", F.lit("")))), X.strip(X.repair(F.coalesce("value", F.lit(""))))
    cited = F.size(F.filter(F.coalesce("evidence_ids", none()), lambda i: i != "")) > 0
    bare = is_bare_relation(F.col("slot"), F.col("value"))
    if variant == "b":
        bare = bare & ~cited
    return filled.filter(
        ~any_of(s, RESULT_SLOTS) & ~(~cited & any_of(v, LACKING)) & ~is_incomplete(F.col("slot"), F.col("value")) & ~any_of(v, OPTION_VALUES) & ~bare
    )


# Wording before a number that the text does not state itself.
NOT_STATED = ("详见", "参见", "未给出", "未知", "需从", "需要")


def reference_missing(evidence: DataFrame, filled: DataFrame, missing: DataFrame) -> DataFrame:
    """H3: slots a text refers to a table for, without a concrete value in evidence or filled slots."""
    refs = V.referenced_slots(evidence)
    listed = missing.select("qid", X.match_key("slot", "reference").alias("slot")).distinct()
    refs = refs.join(listed, ["qid", "slot"], "left_anti")
    short = F.regexp_replace("slot", "^(?:各项|对应的|责任对应的)+", "")
    texts = evidence.select("qid", X.match_key("text", "reference").alias("body"))
    pairs = refs.select("qid", "slot", short.alias("short")).join(texts, "qid")
    value = rf"[:：]?(?:[^。；;\n]{{0,30}})?(?:\p{{Nd}}+(?:\.\p{{Nd}}+)?[{X.WS}]*%|\p{{Nd}}+(?:\.\p{{Nd}}+)?[{X.WS}]*(?:元|万元|倍))"

    def concrete(key: Column) -> Column:
        tails = F.transform(F.slice(F.split(F.replace(F.col("body"), key, F.lit(C.CUT)), C.CUT), 2, 1 << 20), lambda t: F.substring(t, 1, 60))

        def good(t: Column) -> Column:
            refers = t.rlike(r"(?:详见|参见|见)[^。；;\n]{0,30}(?:表|附表|计划表)")
            # what stands before the number that ends the first match of the value pattern
            lead = F.substring(t, F.lit(1), F.greatest(F.regexp_instr(t, F.lit(value)) - 1, F.lit(0)))
            return ~refers & t.rlike(value) & ~any_of(lead, NOT_STATED)

        return (key != "") & F.exists(tails, good)

    known = pairs.filter(concrete(F.col("slot")) | concrete(F.col("short"))).select("qid", "slot").distinct()
    said = X.match_key(F.concat_ws("", "slot", "value"), "reference")
    sure = filled.filter(
        ~any_of(X.repair(F.coalesce("value", F.lit(""))), ("假设", *NOT_STATED))
        & (F.size(F.filter(F.coalesce("evidence_ids", none()), lambda i: i != "")) > 0)
    ).select("qid", said.alias("said")).filter(F.col("said").rlike(r"\p{Nd}+(?:\.\p{Nd}+)?(?:%|元|万元|倍)"))
    told = refs.join(sure, "qid").filter(F.contains("said", F.col("slot"))).select("qid", "slot").distinct()
    open_ = refs.join(known, ["qid", "slot"], "left_anti").join(told, ["qid", "slot"], "left_anti")
    first = open_.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "slot").orderBy("slot_no"))).filter("_n = 1")
    return first.select(
        "qid", "slot", F.concat_ws(" ", X.falsy_null("target"), "slot").alias("followup_query"), F.col("target").alias("reference_target"),
        F.col("evidence_id").alias("source_evidence_id"),
    )


def doc_coverage(tasks: DataFrame, evidence: DataFrame) -> DataFrame:
    """H4: one missing slot per target document without evidence.

    ``tasks(qid, task, task_type, target_doc_ids, search_queries, can_solve)``;
    only solvable retrieval tasks over several documents are checked.
    """
    docs = F.array_distinct(F.filter("target_doc_ids", lambda d: d != ""))
    wanted = tasks.filter("can_solve AND task_type = 'retrieve'").withColumn("docs", docs).filter(F.size("docs") > 1)
    wanted = wanted.select("qid", "task", "search_queries", F.posexplode("docs").alias("ord", "doc_id"))
    open_ = wanted.join(evidence.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_anti")
    slot = F.coalesce(X.falsy_null(X.strip(X.repair(F.coalesce("task", F.lit(""))))), F.lit("目标文档事实"))
    query = X.strip(F.array_join(F.transform(F.slice(F.coalesce("search_queries", none()), 1, 2), lambda q: X.strip(X.repair(q))), " "))
    return open_.select("qid", "ord", "doc_id", slot.alias("slot"), F.coalesce(X.falsy_null(query), slot).alias("followup_query"))


def merge_slots(old: DataFrame, new: DataFrame, variant: str = "src") -> DataFrame:
    """H5: last value per slot at its first place; variant b shortens slot, value and ids."""
    slot, value = X.strip(F.coalesce("slot", F.lit(""))), X.strip(F.coalesce("value", F.lit("")))
    ids = F.filter(F.coalesce("evidence_ids", none()), lambda i: i != "")
    if variant == "b":
        slot, value, ids = F.substring(slot, 1, 80), F.substring(value, 1, 160), F.slice(ids, 1, 5)

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select("qid", F.lit(n).alias("side"), "ord", slot.alias("slot"), value.alias("value"), ids.alias("evidence_ids"))

    both = side(old, 0).unionByName(side(new, 1)).filter("slot <> '' AND value <> ''")
    at = F.struct("side", "ord")
    merged = both.groupBy("qid", "slot").agg(F.max_by(F.struct("value", "evidence_ids"), at).alias("v"), F.min(at).alias("at"))
    return merged.select("qid", "slot", "v.*", Q.rank_by(["qid"], F.col("at")).alias("ord"))


# --- D15-D17, H6 -----------------------------------------------------------------------

AMOUNTS = rf"\p{{Nd}}+(?:\.\p{{Nd}}+)?[{X.WS}]*(?:亿元|万元|元|%|倍|万|亿|人|天|年)"


def claim_parts(options: DataFrame) -> DataFrame:
    """Parts of every option's claim with amounts and polarity; ``options(qid, option, claim)``."""
    rows = options.select("qid", "option", F.posexplode(C.claim_parts("claim")).alias("pos", "raw_claim"))
    c = F.col("raw_claim")
    polarity = (
        F.when(c.rlike("不予赔|不赔付|不赔|均不赔|无法赔|不承担|不属于"), "negative/no_pay")
        .when(c.rlike(rf"赔付|赔偿|给付|赔[{X.WS}]*\p{{Nd}}"), "positive/pay_or_amount")
        .when(c.rlike("高于|低于|大于|小于|超过|不超过|排序|从高到低|从低到高|>"), "comparison/ranking")
        .otherwise("statement")
    )
    return rows.select("qid", "option", (F.col("pos") + 1).alias("claim_index"), "raw_claim", F.array_distinct(E.find_all(c, AMOUNTS)).alias("amounts"), polarity.alias("polarity"))


CHINESE_DIGITS = "〇零一二三四五六七八九"


def chinese_number(text: Column) -> Column:
    """Arabic or Chinese numeral up to tens; NULL if it is neither."""

    def digits(t: Column) -> Column:
        return F.translate(t, CHINESE_DIGITS, "00123456789").try_cast("int")

    def parse(t: Column) -> Column:
        left, right = F.substring_index(t, "十", 1), F.substring_index(t, "十", -1)
        tens = F.when(left == "", 1).otherwise(digits(left)) * 10 + F.when(right == "", 0).otherwise(digits(right))
        return F.when(F.contains(t, F.lit("十")), tens).otherwise(digits(t))

    return X.let(text, parse)


def parse_date(text: Column) -> Column:
    """``struct<year, month, day>`` of the first date in Arabic, else Chinese numerals; the day may be unknown."""
    arabic = r"((?:19|20)\p{Nd}{2})年(\p{Nd}{1,2})月(?:(\p{Nd}{1,2})日)?"
    chinese = "([一二三四五六七八九〇零]{4})年([一二三四五六七八九十]{1,3})月(?:([一二三四五六七八九十]{1,3})日)?"

    def parse(t: Column) -> Column:
        def read(pattern: str, number) -> Column:
            y, m, d = [F.regexp_extract(t, pattern, g) for g in (1, 2, 3)]
            row = F.struct(number(y).alias("year"), number(m).alias("month"), F.when(d != "", number(d)).alias("day"))
            return F.when(t.rlike(pattern), row)

        ch = X.let(read(chinese, chinese_number), lambda r: F.when(r["year"].isNotNull() & r["month"].isNotNull() & (r["month"] > 0), r))
        return F.coalesce(read(arabic, lambda c: c.try_cast("int")), ch)

    return X.let(F.replace(X.repair(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit("")), parse)


def reason_parts(claim: Column, n: int = 4) -> Column:
    """Causes a claim names, with the claim's focus in front where they do not mention it."""
    lead = "集中在|位于|面向|针对|依托|通过|基于"

    def split(t: Column) -> Column:
        before = F.element_at(F.split(t, "因为|由于|原因是|源于"), 1)
        focus = F.coalesce(F.try_element_at(E.find_all(before, f"(?:{lead})([^，,。；;因由且并及同时]+)", 1), F.lit(-1)), F.lit(""))
        focus = F.substring(X.strip(F.regexp_replace(X.strip(focus), "^(?:该|当地|相关|上述|这些)", "")), 1, 40)
        causes = E.find_all(t, r"(?:因为|由于|原因是|源于)([^。；;\n]+)", 1)
        raw = F.flatten(F.transform(causes, lambda c: F.split(c, "且|并且|以及|同时|、|，|,")))
        trimmed = F.filter(F.transform(raw, lambda p: X.strip(p, " ：:，,。；;")), lambda p: F.length(p) >= 2)
        return X.let(focus, lambda f: F.transform(trimmed, lambda p: bind(p, f)))

    def bind(p: Column, f: Column) -> Column:
        place = "^(?:该地区|当地|该地|该区域)"
        free = ~(F.contains(p, f) | any_of(p, ("地区", "市场", "区域")))
        return F.when((f != "") & p.rlike(place), F.concat(f, F.regexp_replace(p, place, ""))).when((f != "") & free, F.concat(f, p)).otherwise(p)

    parts = X.let(X.repair(F.coalesce(claim, F.lit(""))), split)
    return F.slice(F.array_distinct(F.transform(parts, lambda p: F.substring(p, 1, 80))), 1, n)


UNIVERSAL = ("都", "均", "全部", "所有", "每个", "各", "皆")


def complete_slots(options: DataFrame, slots: DataFrame) -> DataFrame:
    """H6: extra slots per ``options(qid, claim, question, entities, constraints)``: entities of a universal claim and causes no slot covers."""
    text = F.concat_ws(" ", "slot", "expected", F.array_join("queries", " "), F.array_join("key_terms", " "))
    covered = slots.groupBy("qid").agg(
        F.collect_list(X.compact_text(text)).alias("surfaces"), F.array_distinct(F.flatten(F.collect_list("key_terms"))).alias("terms")
    )
    rows = options.join(covered, "qid", "left").select(
        "qid", "claim", F.coalesce("surfaces", none()).alias("surfaces"), F.coalesce("terms", none()).alias("terms"),
        F.array_distinct(F.filter(F.transform(F.coalesce("entities", none()), lambda e: X.strip(X.repair(e))), lambda e: F.length(e) >= 2)).alias("entities"),
        F.array_join(F.coalesce("constraints", none()), " ").alias("constraints"), "question",
    )
    universal = (F.contains("constraints", F.lit("需要覆盖")) & F.contains("constraints", F.lit("所有"))) | any_of(
        F.concat_ws("\n", "claim", "question", "constraints"), UNIVERSAL
    )
    wanted = F.when((F.size("entities") >= 2) & universal, F.col("entities")).otherwise(none())
    given = F.filter("terms", lambda t: (t != "") & ~F.array_contains("entities", t))
    other = F.filter(V.key_terms(F.lit(None).cast("array<string>"), F.col("claim"), 8), lambda t: ~F.array_contains("entities", t))
    core = X.let(given, lambda g: F.when(F.size(g) > 0, g).otherwise(other))
    uncovered = lambda items: F.filter(items, lambda e: ~F.exists("surfaces", lambda s: F.contains(s, X.squeeze(e))))
    by_entity = rows.select("qid", "claim", core.alias("core"), F.posexplode(uncovered(wanted)).alias("pos", "entity"))
    entity_terms = V.key_terms(F.concat(F.array("entity"), "core"), F.concat_ws(" ", "entity", "claim"), 8)
    one = by_entity.select(
        "qid", F.lit(1).alias("side"), "pos", F.substring(F.concat("entity", F.lit("是否支持当前选项中的全称陈述")), 1, 100).alias("slot"), F.lit("").alias("expected"),
        entity_terms.alias("key_terms"), F.col("entity").alias("fallback"),
    )
    causes = rows.withColumn("causes", reason_parts(F.col("claim"))).filter(F.size("causes") > 1)
    by_cause = causes.select("qid", F.posexplode(uncovered(F.col("causes"))).alias("pos", "cause"))
    two = by_cause.select(
        "qid", F.lit(2).alias("side"), "pos", F.substring(F.concat(F.lit("当前选项原因是否有证据支持："), "cause"), 1, 100).alias("slot"), F.lit("是").alias("expected"),
        V.key_terms(F.lit(None).cast("array<string>"), F.col("cause"), 8).alias("key_terms"), F.col("cause").alias("fallback"),
    )
    query = F.substring(F.coalesce(X.falsy_null(F.array_join("key_terms", " ")), "fallback"), 1, 160)
    return one.unionByName(two).select("qid", "side", "pos", "slot", "expected", F.array(query).alias("queries"), "key_terms")


# --- H8 --------------------------------------------------------------------------------

# Wording of evidence that contradicts, is silent, or ranks things side by side.
INSUFFICIENT_EVIDENCE = (
    "未包含", "未提及", "未找到", "没找到", "没有找到", "没有检索到", "未检索到", "证据不足", "缺少证据", "无法确定", "无法判断", "仅提及",
)
DIRECT_NEGATIVE = ("不成立", "不支持", "不符合", "并非", "不是", "相反", "无法支持")
NEGATIVE_RELATION = ("并非", "不是", "不属于", "不一致", "相反", "无法支持")
DEGREE_CLAIM = ("主要", "集中", "重点", "核心", "首要", "唯一", "均", "都", "全部", "所有")
PARALLEL = ("两大", "两个", "多大", "多个", "多类", "并列", "之一", "一是", "二是", "三是", "同时", "分别")


def _same_slot(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def contradictions(filled: DataFrame, missing: DataFrame, planned: DataFrame) -> DataFrame:
    """H8: options whose filled values decide against a planned or missing slot; only options with missing slots count."""
    f = filled.select("qid", X.compact_text("slot").alias("fslot"), X.strip(X.repair(F.coalesce("value", F.lit("")))).alias("value"))
    f = f.filter("fslot <> ''")
    m = missing.select("qid", X.compact_text("slot").alias("mslot")).filter("mslot <> ''")
    p = planned.groupBy("qid").agg(F.collect_list(X.compact_text("slot")).alias("plans"))
    clear = ~any_of(F.col("value"), INSUFFICIENT_EVIDENCE)
    rows = f.join(missing.select("qid").distinct(), "qid", "left_semi").join(p, "qid", "left")
    in_plan = F.col("plans").isNull() | F.exists("plans", lambda x: _same_slot(F.col("fslot"), x))
    direct = rows.filter((F.col("value") != "") & in_plan & clear & ((F.col("value") == "否") | any_of(F.col("value"), DIRECT_NEGATIVE)))
    pairs = f.join(m, "qid").filter(_same_slot(F.col("mslot"), F.col("fslot")) & clear)
    indirect = pairs.filter(any_of(F.col("value"), NEGATIVE_RELATION) | (any_of(F.col("mslot"), DEGREE_CLAIM) & any_of(F.col("value"), PARALLEL)))
    return direct.select("qid").unionByName(indirect.select("qid")).distinct()


MAX_ROUNDS = 3


def audit_branch(state: DataFrame, variant: str = "src") -> DataFrame:
    """H8: what an option does next.

    ``state(qid, n_missing, status, round, contradicted, reroutable,
    review_pending, long_evidence, focus_used, repair_used, repairs)``.
    """
    missing = F.col("n_missing") > 0
    review = missing & F.col("review_pending")
    focus = missing & ~F.col("focus_used") & F.col("long_evidence")
    repair = missing & ~F.col("repair_used") & (F.col("round") >= 2)
    if variant == "b":
        branch = (
            F.when((F.col("round") >= MAX_ROUNDS) | (F.col("repairs") >= 2), "judge")
            .when(~missing, "judge").when(F.col("contradicted"), "judge").when(review, "review").when(focus, "focus").when(repair, "repair").otherwise("more")
        )
    else:
        branch = (
            F.when(~missing & (F.col("status") == "ready_to_judge"), "judge")
            .when(F.col("contradicted"), "judge")
            .when(missing & F.col("reroutable"), "reroute")
            .when(review, "review").when(focus, "focus").when(repair, "repair")
            .when((F.col("round") >= MAX_ROUNDS) | ~missing, "judge")
            .otherwise("more")
        )
    return state.select("*", branch.alias("branch"))


# --- H9, H10 ---------------------------------------------------------------------------

# Wording of reasons that support or reject an option.
SUPPORT_REASONS = (
    "与选项陈述一致", "与选项一致", "选项成立", "陈述成立", "说法成立", "能够支持", "可以支持", "支持该选项", "支持选项", "方向一致", "口径一致",
)
REJECT_REASONS = (
    "与选项陈述不一致", "与选项不一致", "选项不成立", "陈述不成立", "说法不成立", "选项错误", "陈述错误", "说法错误", "不能支持", "无法支持",
    "不支持该选项", "不支持选项", "方向相反", "口径不一致", "证据不足", "缺少证据", "无法判断",
)
GUARD_REASON = "审查结果仍存在未补齐槽位，不能用题干背景、无反例或推测替代证据判为支持。"


def judgments(replies: DataFrame, missing: DataFrame) -> DataFrame:
    """H9: verdict, answer and confidence per ``replies(qid, option, answer_format, verdict, answer, confidence, reason)``.

    An answer letter settles the verdict (outside true/false questions an empty
    one counts as a letter that is not the option's); reasons that clearly say
    otherwise overrule it; a true verdict falls with open slots.
    """
    tf = F.col("answer_format") == "tf"
    a = F.upper(X.strip(F.coalesce("answer", F.lit(""))))
    yes, no = F.lit(True), F.lit(False)
    by_letter = F.when(
        tf, F.when(a.isin("T", "TRUE", "Y", "YES", "A"), yes).when(a.isin("F", "FALSE", "N", "NO", "B"), no).otherwise(F.col("verdict"))
    ).otherwise(
        F.when(a.isin("F", "FALSE", "N", "NO"), no).when(a.isin("T", "TRUE", "Y", "YES"), yes)
        .when(F.contains(F.lit("ABCD"), a), a == F.col("option")).otherwise(F.col("verdict"))
    )
    reason = X.repair(F.coalesce("reason", F.lit("")))
    support, reject = any_of(reason, SUPPORT_REASONS), any_of(reason, REJECT_REASONS)
    said = F.when(support & ~reject, yes).when(reject & ~support, no)
    rows = replies.select("*", by_letter.alias("v0"), said.alias("said"), a.alias("a0"))
    rows = rows.join(missing.select("qid", "option").distinct().withColumn("gap", F.lit(True)), ["qid", "option"], "left")
    overruled = F.col("said").isNotNull() & ~F.col("v0").eqNullSafe(F.col("said"))
    rows = rows.withColumn("overruled", overruled).withColumn("v1", F.when(F.col("overruled"), F.col("said")).otherwise(F.col("v0")))
    rows = rows.withColumn("guarded", F.coalesce("gap", F.lit(False)) & F.coalesce("v1", F.lit(False)))
    verdict = F.when(F.col("guarded"), no).otherwise(F.col("v1"))
    base = F.coalesce("confidence", F.lit(0.0))
    capped = F.when(F.col("overruled"), F.least(base, F.lit(0.85))).otherwise(F.col("confidence"))
    confidence = F.when(F.col("guarded"), F.least(F.coalesce(capped, F.lit(0.0)), F.lit(0.5))).otherwise(capped)
    answer = F.when(tf, F.when(verdict, "T").when(~verdict, "F").otherwise(F.col("answer"))).otherwise(
        F.when(verdict, F.col("option")).when(~verdict, "").otherwise(F.col("answer"))
    )
    told = F.concat(F.lit(GUARD_REASON), F.when(X.strip(reason) != "", F.concat(F.lit(" 原模型理由："), X.strip(reason))).otherwise(""))
    return rows.select(
        *[c for c in replies.columns if c not in ("verdict", "answer", "confidence", "reason")],
        verdict.alias("verdict"), answer.alias("answer"), confidence.alias("confidence"),
        F.when(F.col("guarded"), F.substring(told, 1, 1200)).otherwise(F.col("reason")).alias("reason"),
    )


def final_answers(judged: DataFrame) -> DataFrame:
    """Answer per question of ``judged(qid, option, option_ord, answer_format, verdict, confidence, status)``."""
    true = F.col("verdict") == True  # noqa: E712
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(true, F.struct("option_ord", "option")))), lambda x: x["option"]), "")
    single = F.max_by("option", F.when(true, F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("option_ord")).alias("o"))))
    tf = F.max(F.when(F.col("option") == "T", F.when(F.col("verdict"), "A").when(~F.col("verdict"), "B")))
    grouped = judged.groupBy("qid").agg(
        F.first("answer_format").alias("answer_format"), listed.alias("listed"), F.coalesce(single, F.lit("")).alias("single"), F.coalesce(tf, F.lit("")).alias("tf"),
        F.bool_and(F.coalesce("status", F.lit("")) == "done").alias("done"),
    )
    answer = F.when(F.col("answer_format") == "tf", F.col("tf")).when(F.col("answer_format") == "mcq", F.col("single")).otherwise(F.col("listed"))
    return grouped.select("qid", "answer_format", answer.alias("final_answer"), F.when(F.col("done"), "done").otherwise("partial").alias("status"))


# --- H11-H13, D25 ------------------------------------------------------------------------

# What names a subject or a document, and notes that miss the subject.
SUBJECT_SLOTS = ("主体", "对象", "领域", "行业", "公司", "产品", "案例", "技术")
DOCUMENT_WORDS = (
    "研报", "报告", "年报", "半年报", "季报", "条款", "办法", "规定", "规则", "通知", "合同", "公告", "说明书", "文件", "文档", "招股书", "募集说明书", "重组报告书",
)
HARD_MISMATCH = ("与当前任务无关", "与该领域无关", "非当前领域", "不属于当前领域", "不能用于", "不能互相替代")
MISMATCH = HARD_MISMATCH + ("与光通信领域无关", "不能支持", "未涉及", "未提供", "证据不足", "无法支持")
ALLOCATION = ("按比例", "按占比", "占比例", "占比", "分摊", "分配", "应占比例")
ALLOCATION_SUPPORT = ("按比例", "按占比", "占比例", "占比", "分摊", "分配", "依比例", "比例分配")
# Wording of assumptions, and of the figures that are assumed.
ASSUMED, ASSUMED_FIGURES = ("假设", "未给出", "未知", "需从", "需要补充"), ("比例", "费率", "金额", "赔付", "给付", "责任项")
FACTS = "array<struct<slot:string,value:string>>"


def subject_terms(task: Column, facts: Column) -> Column:
    """Subjects a task names: values of subject slots and typed nouns of its name."""
    rows = F.filter(F.coalesce(facts, F.array().cast(FACTS)), lambda f: (X.strip(f["value"]) != "") & any_of(f["slot"], SUBJECT_SLOTS))
    named = [E.find_all(X.strip(X.repair(F.coalesce(task, F.lit("")))), p) for p in (
        f"[{X.CJK}A-Za-z0-9]{{2,20}}?领域", f"[{X.CJK}A-Za-z0-9]{{2,24}}?制造", f"[{X.CJK}A-Za-z0-9]{{2,24}}?行业")]
    return F.array_distinct(F.concat(F.transform(rows, lambda f: X.strip(X.repair(f["value"]))), *named))


def is_document_task(task: Column, facts: Column) -> Column:
    """The subject is a document rather than a company or field."""
    titled = F.exists(
        F.coalesce(facts, F.array().cast(FACTS)),
        lambda f: (any_of(f["slot"], ("文档", "文件", "报告", "题名", "标题")) & (f["value"] != "")) | any_of(f["value"], DOCUMENT_WORDS),
    )
    return any_of(X.repair(F.coalesce(task, F.lit(""))), DOCUMENT_WORDS) | F.coalesce(titled, F.lit(False))


def unsupported_assumption(text: Column, support: Column) -> Column:
    """An allocation nothing supports, or an assumed ratio, rate or amount."""
    allocated = any_of(text, ALLOCATION) & ~any_of(support, ALLOCATION_SUPPORT)
    assumed = any_of(text, ASSUMED) & any_of(text, ASSUMED_FIGURES)
    return allocated | assumed


def block_results(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Complete results whose evidence speaks of another subject become ``blocked``.

    ``results(task_id, status, result, basis, warnings, notes ARRAY<STRUCT<doc_id,note>>, evidence_ids)``,
    ``tasks(task_id, task, known_facts, target_doc_ids)``.
    """
    rows = results.join(tasks.select("task_id", "task", "known_facts", "target_doc_ids"), "task_id")
    rows = rows.withColumn("terms", subject_terms(F.col("task"), F.col("known_facts"))).withColumn("doc_task", is_document_task(F.col("task"), F.col("known_facts")))
    docs = F.coalesce("target_doc_ids", none())
    by_note = F.exists("notes", lambda n: F.array_contains(docs, F.coalesce(n["doc_id"], F.lit(""))))
    by_id = F.exists("evidence_ids", lambda e: F.exists(docs, lambda d: (e == d) | F.startswith(e, F.concat(d, F.lit("_")))))
    said = X.repair(F.concat_ws(" ", F.coalesce("result", F.lit("")), F.coalesce("basis", F.lit("")), F.array_join(F.coalesce("warnings", none()), " ")))
    notes = X.repair(F.array_join(F.transform("notes", lambda n: F.coalesce(n["note"], F.lit(""))), " "))
    rows = rows.select("*", (F.col("doc_task") & F.coalesce(by_note | by_id, F.lit(False))).alias("bound"), said.alias("said"), notes.alias("noted"))
    names = lambda t: F.exists("terms", lambda s: F.contains(t, s))
    both = F.concat_ws("\n", "said", "noted")
    lines = F.filter(F.split("noted", "[。\n；;]+"), lambda x: F.contains(x, F.lit("主体=")))
    hard = any_of(both, HARD_MISMATCH) & ~names(F.col("said"))
    soft = any_of(both, MISMATCH) & ~names(F.col("said")) & ~F.col("bound")
    line_bad = F.exists(lines, lambda x: names(x) & any_of(x, MISMATCH))
    no_line = (F.size(lines) > 0) & ~F.exists(lines, names)
    confirmed = F.contains("said", F.lit("已确认事实")) & any_of(F.col("noted"), MISMATCH)
    wrong = (F.size("terms") > 0) & (hard | soft | line_bad | F.when(no_line, ~F.col("bound")).otherwise(confirmed))
    blocked = (F.col("status") == "complete") & wrong
    return rows.select(
        "task_id", F.when(blocked, "blocked").otherwise(F.col("status")).alias("status"), "result",
        F.when(blocked & (F.coalesce("basis", F.lit("")) == ""), "当前证据主体与任务主体不匹配，不能用于该主体判断。").otherwise(F.col("basis")).alias("basis"),
        blocked.alias("blocked"),
    )


SPECULATIVE = ("是否有其他", "是否还有", "有无其他", "有没有其他", "其他退保扣费", "其他扣费", "额外扣费", "额外费用", "另有扣费", "另有费用", "是否存在其他")


def is_speculative(slot: Column) -> Column:
    """H7: slots that only guess at further charges."""
    return any_of(F.regexp_replace(X.repair(F.coalesce(slot, F.lit(""))), f"[{X.WS}]+", ""), SPECULATIVE)


def required_slots(required: DataFrame, memory: DataFrame) -> DataFrame:
    """H7: ``required(qid, ord, slot)`` with whether the memory fills it: keys contain one another or share two terms."""
    rows = required.filter(~is_speculative(F.col("slot"))).withColumn("key", X.match_key("slot", "slot")).withColumn("toks", F.filter(X.token_set("slot"), lambda t: F.length(t) >= 2))
    held = memory.select("qid", X.match_key("slot", "slot").alias("mkey"), F.filter(X.token_set("slot"), lambda t: F.length(t) >= 2).alias("mtoks"))
    hit = rows.join(held, "qid").filter(_same_slot(F.col("key"), F.col("mkey")) | (X.overlap(F.col("toks"), F.col("mtoks")) >= 2))
    filled = hit.select("qid", "ord").distinct().withColumn("filled", F.lit(True))
    return rows.join(filled, ["qid", "ord"], "left").select("qid", "ord", "slot", F.coalesce("filled", F.lit(False)).alias("filled"))


def normalize_plan(plans: DataFrame, docs: DataFrame) -> DataFrame:
    """Clean tasks of ``plans(qid, pos, task, task_type, doc_ids, slots ARRAY<STRUCT<slot,query>>)``.

    ``doc_ids`` are already resolved (G12). Retrieval tasks without documents
    get all of the question's; tasks without usable slots search their name.
    """
    name = X.strip(X.repair(F.coalesce("task", F.lit(""))))
    rows = plans.withColumn("task", name).filter("task <> ''")
    slots = F.transform(
        F.coalesce("slots", F.array().cast("array<struct<slot:string,query:string>>")),
        lambda s: F.struct(X.strip(X.repair(F.coalesce(s["slot"], F.lit("")))).alias("slot"), X.strip(X.repair(F.coalesce(s["query"], F.lit("")))).alias("query")),
    )
    usable = F.transform(
        F.filter(slots, lambda s: (s["slot"] != "") & ~is_speculative(s["slot"])),
        lambda s: F.struct(F.substring(s["slot"], 1, 100).alias("slot"), F.substring(F.when(s["query"] != "", s["query"]).otherwise(s["slot"]), 1, 120).alias("query")),
    )
    given = F.lower(X.strip(F.coalesce("task_type", F.lit(""))))
    kind = F.when(given != "", given).when((F.coalesce(F.size("slots"), F.lit(0)) <= 0) & F.col("task").rlike("比较|排序|汇总|对比"), "summarize").otherwise("retrieve")
    default = F.array(F.struct(F.substring("task", 1, 80).alias("slot"), F.substring("task", 1, 120).alias("query")))
    every = docs.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", "doc_id"))), lambda x: x["doc_id"]).alias("every"))
    rows = rows.join(every, "qid", "left").withColumn("kind", kind)
    targets = F.when(F.col("kind") == "summarize", none()).when(F.size(F.coalesce("doc_ids", none())) > 0, F.col("doc_ids")).otherwise(F.coalesce("every", none()))
    return rows.select(
        "qid", "pos", F.substring("task", 1, 120).alias("task"), F.col("kind").alias("task_type"), targets.alias("target_doc_ids"),
        X.let(usable, lambda u: F.when(F.size(u) > 0, u).otherwise(default)).alias("search_slots"),
    )


# Wording of questions that ask for several facts at once.
ASKS_SEVERAL = ("同时", "是否都", "是否均", "均", "都", "分别是否", "都带来", "均带来")


def merge_relation_tasks(tasks: DataFrame, questions: DataFrame) -> DataFrame:
    """Retrieval tasks of one entity and document set become one, where the question asks for several facts at once.

    ``tasks(qid, pos, task, task_type, target_doc_ids, entity, search_slots)``, ``questions(qid, question)``.
    """
    asks = any_of(X.repair("question"), ASKS_SEVERAL)
    rows = tasks.join(questions.select("qid", asks.alias("asks")), "qid")
    retrieve = F.col("task_type") != "summarize"
    per_entity = rows.filter(retrieve & (F.col("entity") != "")).groupBy("qid", "entity").agg(F.count("*").alias("n")).filter("n >= 2")
    rows = rows.join(per_entity.select("qid").distinct().withColumn("_pair", F.lit(True)), "qid", "left")
    merge = F.col("asks") & F.coalesce("_pair", F.lit(False)) & retrieve
    group = F.when(merge, F.concat_ws("#", F.array_join("target_doc_ids", ","), "entity")).otherwise(F.concat(F.lit("task "), F.col("pos").cast("string")))
    at = F.struct("pos", "task", "search_slots")
    grouped = rows.withColumn("_group", group).groupBy("qid", "_group").agg(
        F.min("pos").alias("pos"), F.min_by("task_type", "pos").alias("task_type"), F.min_by("target_doc_ids", "pos").alias("target_doc_ids"),
        F.min_by("entity", "pos").alias("entity"), F.array_sort(F.collect_list(at)).alias("members"),
    )
    names = F.array_join(F.filter(F.transform("members", lambda m: m["task"]), lambda t: t != ""), "；")
    many = F.size("members") >= 2
    return grouped.select(
        "qid", "pos",
        F.when(many, F.concat(F.lit("分别检索并核验是否同时满足："), F.substring(names, 1, 100))).otherwise(F.col("members")[0]["task"]).alias("task"),
        "task_type", "target_doc_ids", "entity", F.array_distinct(F.flatten(F.transform("members", lambda m: m["search_slots"]))).alias("search_slots"),
    )


# Wording that asks for a table, and how the merged task reads.
TABLE_WORDS = ("分别", "各", "明细", "构成", "分类", "占比", "比例", "率", "金额", "收入", "成本", "利润", "余额", "净额", "数量", "规模", "表")
PERIOD_TASK, PERIOD_SLOT = "按题干顺序查找同一对象同一指标在多个年份/期间的整表数据", "题干要求的多年份/多期间指标整表数据"
TABLE_EXTRAS = ("明细", "构成", "分类", "表", "报告期")


def merge_period_tasks(tasks: DataFrame, questions: DataFrame) -> DataFrame:
    """The tasks of a free question become one table search if they ask for figures of several periods in the same documents.

    ``tasks(qid, pos, task, task_type, target_doc_ids, known_facts
    ARRAY<STRUCT<slot,value>>, search_slots ARRAY<STRUCT<slot,query>>)``,
    ``questions(qid, question, answer_format)``. All tasks must retrieve, name
    the same documents, and two of them a period. Facts are kept once, terms of
    all tasks make the query.
    """
    slots = F.coalesce("search_slots", F.array().cast("array<struct<slot:string,query:string>>"))
    said = F.concat(F.array("task"), F.transform(slots, lambda s: s["slot"]), F.transform(slots, lambda s: s["query"]))
    bundle = F.concat_ws(" ", F.filter(F.transform(said, lambda t: X.strip(X.repair(F.coalesce(t, F.lit(""))))), lambda t: t != ""))
    rows = tasks.select("*", bundle.alias("bundle"), slots.alias("slots"))
    rows = rows.withColumn("dated", F.col("bundle").rlike(E.PERIOD)).withColumn("docs", F.array_join(F.coalesce("target_doc_ids", none()), "\x01"))
    in_order = lambda c, name: F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias(name))))
    whole = rows.groupBy("qid").agg(
        F.count("*").alias("n"), F.sum(F.col("dated").cast("int")).alias("n_dated"), F.min("docs").alias("d1"), F.max("docs").alias("d2"),
        F.max(F.lower(F.coalesce(X.falsy_null("task_type"), F.lit("retrieve"))) == "summarize").alias("sums"), F.min("pos").alias("pos"),
        F.min_by("target_doc_ids", "pos").alias("target_doc_ids"), in_order("bundle", "x").alias("bundles"), in_order("task", "x").alias("names"),
        in_order("slots", "x").alias("slot_lists"), in_order("known_facts", "x").alias("fact_lists"),
    )
    rows_of = lambda c: F.transform(c, lambda r: r["x"])
    whole = whole.join(questions.select("qid", X.repair(F.coalesce("question", F.lit(""))).alias("question"), "answer_format"), "qid")
    asks = any_of(F.concat_ws(" ", "question", rows_of("bundles")), TABLE_WORDS)
    merge = whole.filter(
        (F.col("answer_format") == "free") & (F.col("n") >= 2) & asks & ~F.col("sums") & (F.col("d1") == F.col("d2")) & (F.col("n_dated") >= 2)
    )
    flat = F.flatten(rows_of("slot_lists"))
    parts = F.concat(rows_of("names"), F.transform(flat, lambda s: s["slot"]), F.transform(flat, lambda s: s["query"]))
    merge = merge.withColumn("parts", parts).withColumn("terms", E.typed_terms(F.col("parts"), 10))
    merge = merge.withColumn("terms", F.when(F.size("terms") >= 3, F.col("terms")).otherwise(E.typed_terms(F.concat("parts", F.array("question")), 10)))
    extras = F.filter(F.array(*[F.lit(t) for t in TABLE_EXTRAS]), lambda t: ~F.array_contains("terms", t))
    query = F.array_join(F.slice(F.concat("terms", extras), 1, 12), " ")
    fact = lambda f: F.struct(F.substring(X.strip(X.repair(f["slot"])), 1, 80).alias("slot"), F.substring(X.strip(X.repair(f["value"])), 1, 160).alias("value"))
    facts = F.flatten(F.transform(rows_of("fact_lists"), lambda a: F.coalesce(a, F.array().cast("array<struct<slot:string,value:string>>"))))
    facts = F.slice(F.array_distinct(F.filter(F.transform(facts, fact), lambda f: (f["slot"] != "") & (f["value"] != ""))), 1, 12)
    merged = merge.select(
        "qid", "pos", F.lit(PERIOD_TASK).alias("task"), F.lit("retrieve").alias("task_type"), "target_doc_ids", facts.alias("known_facts"),
        F.array(F.struct(F.lit(PERIOD_SLOT).alias("slot"), F.substring(query, 1, 120).alias("query"))).alias("search_slots"),
    )
    rest = tasks.join(merged.select("qid"), "qid", "left_anti")
    return rest.select(*merged.columns).unionByName(merged)


def compare_dates(questions: DataFrame, results: DataFrame) -> DataFrame:
    """是 or 否 whether the second document is later or earlier than the first; unknown days give no answer.

    ``results(qid, pos, task, result, amount, basis, calculation, substitution)``.
    """
    surface = X.repair(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("task", "result", "basis", "calculation", "substitution")]))
    found = F.coalesce(parse_date(F.col("result")), parse_date(F.col("amount")), parse_date(F.col("basis")), parse_date(F.col("surface")))
    rows = results.withColumn("surface", surface).withColumn("date", found).filter("date IS NOT NULL")
    first = lambda word: F.min_by("date", F.when(F.contains("surface", F.lit(word)), F.col("pos")))
    dates = rows.groupBy("qid").agg(first("第一").alias("one"), first("第二").alias("two"))
    ask = X.repair("question")
    rows = questions.filter(any_of(ask, ("晚于", "早于")) & F.contains(ask, F.lit("第一")) & F.contains(ask, F.lit("第二"))).join(dates, "qid")
    one, two = F.col("one"), F.col("two")
    month = lambda s: s["year"] * 100 + s["month"]
    order = F.when(month(two) != month(one), F.signum(month(two) - month(one))).when(
        one["day"].isNotNull() & two["day"].isNotNull(), F.signum(two["day"] - one["day"])
    )
    yes = (
        F.when(F.contains(ask, F.lit("不晚于")), order <= 0).when(F.contains(ask, F.lit("不早于")), order >= 0)
        .when(F.contains(ask, F.lit("晚于")), order > 0).otherwise(order < 0)
    )
    return rows.select("qid", F.when(yes, "是").when(~yes, "否").otherwise("").alias("answer"))


def next_workday(df: DataFrame, col: str = "date") -> DataFrame:
    """The first weekday after a date."""
    day = F.date_add(col, 1)
    return df.withColumn("next_workday", F.date_add(day, F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0)))
