"""Documents by the names and entities that claims and questions speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import text as X
from leafscan.functions.containment import substring_join
from leafscan.operators import routing as R
from leafscan.operators import search as Q
from leafscan.operators.evidence import any_of

MIN_KEY, MIN_DISTINCTIVE = 4, 2
NAME_FLOOR, NAME_CAP, NAME_DIVISOR, NAME_HITS = 8.0, 18.0, 1.2, 3
NAME_SHARE, NAME_DOCS = 0.6, 3
ENTITY_FLOOR, ENTITY_DOCS, ENTITIES = 8.0, 4, 6
RUN_SIZES = (10, 4)

# What a name of a company looks like, what rules a name out, and endings that do not tell companies apart.
COMPANY = r"(?i)股份有限公司|有限责任公司|有限公司|集团|Company|Limited|Corporation|Innovations"
LATIN_NAME = r"^[A-Za-z][A-Za-z0-9 .&-]{3,}$"
NOT_NAMES = ("风险", "项目", "说明书", "声明", "提示", "发行", "募集", "目录", "关于公司", "本次", "前次", "利润分配")
LISTED = r"^[（(]?[一二三四五六七八九十]+[）)、.．]"
FILE_NAME = r"^text\p{Nd}+_?no_?images?$"
COMMON_ENDINGS = (
    "股份有限公司", "有限责任公司", "有限公司", "集团股份", "集团", "控股", "公司", "年度报告", "年报", "annualreport", "report", "limited", "corporation", "company",
)
# How a question lists its entities, and what a list may carry along.
ENTITY_LISTS = (
    r"在([^。；;\n]{3,90}?)(?:领域|行业|公司|产品|案例)(?:中|内|，|,)",
    r"([^。；;\n]{3,90}?)(?:等领域|等行业|等公司|等产品|等案例)",
)
LIST_HEAD, LIST_TAIL, LIST_BREAK = "^(?:在|针对|围绕|关于)", "(?:等|这些|上述)$", "[、,，/]|和|与|及|以及"
ENTITY_TAIL = "(?:领域|行业|公司|产品|案例|对象)$"
NOT_ENTITIES = ("以下", "这些", "上述", "案例", "领域", "行业", "公司", "产品", "对象", "问题", "哪些", "什么", "是否", "如何", "为何", "为什么")
SUMMARY_MARKERS = ("都", "均", "各", "共同", "这些案例", "上述", "共同规律", "原因", "影响", "优势", "壁垒", "合理", "分析")
# What a question asks for, and the words by which a document speaks of it.
AXES = (
    (("核心技术", "核心环节", "关键环节"), ("核心技术", "核心环节", "关键环节", "核心设备", "核心器件", "耦合", "测试", "贴片")),
    (("结构性降本", "降本", "成本", "费用"), ("结构性降本", "降本", "成本", "费用", "节约", "降低", "功耗")),
    (("性能", "提质", "优势"), ("性能", "提质", "效率", "速率", "速度", "精度", "可靠", "稳定", "带宽", "低时延", "优势")),
    (("壁垒", "模仿", "替代"), ("壁垒", "模仿", "替代", "自主", "稀缺", "龙头", "市占率")),
)


# --- G9 --------------------------------------------------------------------------


def is_identity(name: Column) -> Column:
    """Whether a title or alias names a company."""
    text = X.compact_text(name)
    ruled_out = (F.length(X.match_key(text)) < MIN_KEY) | F.lower(text).rlike(FILE_NAME) | text.rlike(LISTED) | any_of(text, NOT_NAMES)
    return ~ruled_out & (text.rlike(COMPANY) | text.rlike(LATIN_NAME))


def distinctive_key(name: Column) -> Column:
    """Match key without legal and report endings; empty if only a year is left."""
    key = X.match_key(X.compact_text(name))
    for ending in COMMON_ENDINGS:
        key = F.replace(key, F.lit(ending), F.lit(""))
    return F.when(key.rlike(r"^\p{Nd}{4}$"), "").otherwise(key)


def identity_match(claims: DataFrame, candidates: DataFrame, names: DataFrame, n: int = NAME_DOCS) -> DataFrame:
    """``qid, doc_id, score, rank`` of documents whose names ``claims(qid, claim)`` speak of.

    ``candidates(qid, doc_id, ord)``, ``names(doc_id, pos, name)``: titles first,
    then aliases. A name counts if its key or its distinctive part stands in the
    claim, or the claim in the name; the first three of a document add up by
    length. Documents below the floor or 0.6 of the best are left out; ties go
    by order of the candidates. Each distinct name is looked up once for all
    documents that carry it.
    """
    asked = claims.select("qid", X.match_key(X.compact_text("claim")).alias("ckey")).filter("ckey <> ''")
    known = names.filter(is_identity(F.col("name"))).groupBy("doc_id", "name").agg(F.min("pos").alias("pos"))
    keyed = known.select("name").distinct().select("name", X.match_key("name").alias("nkey"), distinctive_key(F.col("name")).alias("part"))
    keyed = keyed.filter(F.length("nkey") >= MIN_KEY)
    part = F.when(F.length("part") >= MIN_DISTINCTIVE, F.col("part"))
    terms = keyed.select("name", F.explode(F.array_distinct(F.array_compact(F.array("nkey", part)))).alias("term"))
    texts = asked.select("ckey").distinct()
    in_claim = substring_join(texts, terms.select("term").distinct(), "ckey").join(terms, "term").select("ckey", "name")
    in_name = substring_join(keyed.select("nkey").distinct(), texts.select(F.col("ckey").alias("term")), "nkey").join(keyed, "nkey")
    found = in_claim.unionByName(in_name.select(F.col("term").alias("ckey"), "name")).distinct()
    hits = found.join(asked, "ckey").join(known, "name").join(candidates, ["qid", "doc_id"])
    own = hits.withColumn("_n", Q.rank_by(["qid", "doc_id"], F.col("pos"), F.col("name"))).filter(F.col("_n") <= NAME_HITS)
    worth = F.least(F.lit(NAME_CAP), F.greatest(F.lit(NAME_FLOOR), F.length(X.match_key("name")) / NAME_DIVISOR))
    scored = own.groupBy("qid", "doc_id", "ord").agg(F.sum(worth).alias("score"))
    best = F.max("score").over(Window.partitionBy("qid"))
    ranked = scored.withColumn("rank", Q.rank_by(["qid"], Q.by_score(), F.col("ord"))).withColumn("_best", best)
    kept = ranked.filter((F.col("rank") <= n) & (F.col("score") >= NAME_FLOOR) & (F.col("score") >= F.col("_best") * NAME_SHARE))
    return kept.select("qid", "doc_id", "score", "rank")


# --- G10 -------------------------------------------------------------------------


def listed_entities(question: Column, n: int = ENTITIES) -> Column:
    """Entities that a question lists before a type word, in order."""

    def members(listed: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(X.compact_text(listed), LIST_HEAD, ""), LIST_TAIL, "")
        parts = F.transform(F.split(bare, LIST_BREAK), lambda p: F.regexp_replace(X.compact_text(p), ENTITY_TAIL, ""))
        kept = F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.isin(*NOT_ENTITIES))
        return F.transform(kept, lambda p: F.substring(p, 1, 30))

    def found(text: Column) -> Column:
        lists = F.concat(*[E.find_all(text, pattern, 1) for pattern in ENTITY_LISTS])
        return F.slice(F.array_distinct(F.flatten(F.transform(lists, members))), 1, n)

    return X.let(X.repair(F.coalesce(question, F.lit(""))), found)


def shared_run(key: Column, text: Column) -> Column:
    """Length of the longest run of ``key`` (10 to 4 signs) that stands in ``text``; 0 without one."""
    longest, least = RUN_SIZES
    sizes = F.filter(F.sequence(F.lit(longest), F.lit(least), F.lit(-1)), lambda size: size <= F.length(key))

    def stands(size: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.length(key) - size + 1), lambda i: F.contains(text, F.substring(key, i, size)))

    return F.coalesce(F.array_max(F.filter(sizes, stands)), F.lit(0))


def entity_docs(questions: DataFrame, candidates: DataFrame, profiles: DataFrame, n: int = ENTITY_DOCS) -> DataFrame:
    """``qid, entity_no, entity, doc_id, score``: the best document of each entity that a question compares.

    ``questions(qid, question, claim)`` take part if they list two entities and
    ask what these have in common. ``candidates(qid, doc_id, ord)`` are scored
    by ``profiles(doc_id, profile)``; an entity without a document of 8 or more
    is left out, ties go by order, and entities end with the one that brings
    the fourth document.
    """
    both = F.concat_ws("\n", X.repair(F.coalesce("question", F.lit(""))), X.repair(F.coalesce("claim", F.lit(""))))
    asked = questions.select("qid", both.alias("context"), listed_entities(F.col("question")).alias("entities"))
    asked = asked.filter((F.size("entities") >= 2) & any_of(F.col("context"), SUMMARY_MARKERS))
    entity = asked.select("qid", "context", F.posexplode("entities").alias("entity_no", "entity"))
    entity = entity.select("*", X.match_key("entity").alias("key"), F.filter(X.token_set("entity"), R.is_hint_token).alias("tokens"))
    held = profiles.select(
        "doc_id", F.col("profile").alias("text"), X.match_key("profile").alias("pkey"), F.filter(X.token_set("profile"), R.is_hint_token).alias("ptokens")
    )
    rows = entity.join(candidates.select("qid", "doc_id", "ord"), "qid").join(held, "doc_id").filter((F.col("key") != "") & (F.col("pkey") != ""))
    axes = [F.when(any_of(F.col("context"), ask) & any_of(F.col("text"), say), 2.0).otherwise(0.0) for ask, say in AXES]
    run = shared_run(F.col("key"), F.col("pkey"))
    score = F.when(F.contains("pkey", F.col("key")), 12.0).otherwise(0.0) + 2.0 * X.overlap(F.col("tokens"), F.col("ptokens")) + sum(axes, F.lit(0.0))
    score = score + F.least(F.lit(6.0), run / 2)
    best = rows.select("qid", "entity_no", "entity", "doc_id", "ord", score.alias("score")).withColumn(
        "rank", Q.rank_by(["qid", "entity_no"], Q.by_score(), F.col("ord"))
    )
    best = best.filter((F.col("rank") == 1) & (F.col("score") >= ENTITY_FLOOR))
    w = Window.partitionBy("qid").orderBy("entity_no")
    first = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("entity_no")) == 1
    before = F.sum(F.col("_new")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    counted = best.withColumn("_new", F.when(first, 1).otherwise(0)).withColumn("_before", F.coalesce(before, F.lit(0)))
    return counted.filter(F.col("_before") < n).select("qid", (F.col("entity_no") + 1).alias("entity_no"), "entity", "doc_id", F.round("score", 3).alias("score"))
