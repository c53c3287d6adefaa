"""Query rewriting by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.functions import text as X
from leafscan.operators import evidence as V
from leafscan.operators.evidence import any_of
from leafscan.operators.supplement import BOTH_AXES, both_axes

# Wording that is too particular to search by, and the general queries that replace it.
GENERAL = (
    (rf"第?[{X.WS}]*\p{{Nd}}+[{X.WS}]*(?:个)?[{X.WS}]*保单年度|第[{X.WS}]*\p{{Nd}}+[{X.WS}]*年", ("保单年度 区间 现金价值", "保单年度 范围 费用比例", "解除合同 现金价值 年度")),
    (rf"\p{{Nd}}+[{X.WS}]*(?:周岁|岁)", ("年龄区间 给付比例 表", "周岁 范围 保险金比例", "年龄 分档 给付规则")),
    (r"退保|解除合同|所得金额", ("现金价值 解除合同 所得金额", "现金价值 累计所交保险费 保单账户累计收益", "账户价值 退保费用 现金价值")),
)
# What slots on cost and on performance are searched by as well.
ENRICHED = (
    (("降本", "成本", "费用", "消耗"), ("成本", "效率", "材料", "节省", "功耗", "单位成本")),
    (("性能", "提升", "优势", "质量"), ("性能", "速率", "精度", "强度", "可靠", "轻薄", "良率")),
)
EXTENDED_CHARS, ENRICHED_CHARS = 180, 120


def general_queries(text: Column) -> Column:
    """general queries for contract years, ages and surrender; none for other texts."""

    def of(t: Column) -> Column:
        lists = [F.when(t.rlike(pattern), F.array(*[F.lit(q) for q in queries])).otherwise(V.none()) for pattern, queries in GENERAL]
        return F.array_distinct(F.concat(*lists))

    return X.let(X.repair(F.coalesce(text, F.lit(""))), of)


def extended_query(query: Column) -> Column:
    """a query on cost and quality with words of both axes; any other query as it is, blanks squeezed."""
    return X.let(X.compact_text(query), lambda q: F.when(both_axes(q), F.substring(X.compact_text(F.concat_ws(" ", q, F.lit(BOTH_AXES))), 1, EXTENDED_CHARS)).otherwise(q))


def enriched_query(slot: Column, query: Column) -> Column:
    """the query of a slot on cost or performance, with the words of that topic it lacks."""

    def of(parts: Column) -> Column:
        both = F.concat(parts["slot"], parts["query"])
        lists = [F.when(any_of(both, words), F.array(*[F.lit(w) for w in more])).otherwise(V.none()) for words, more in ENRICHED]
        fresh = F.filter(F.concat(*lists), lambda w: ~F.contains(parts["query"], w))
        asked = F.size(F.concat(*lists)) > 0
        return F.when(asked, F.substring(F.concat_ws(" ", parts["query"], fresh), 1, ENRICHED_CHARS)).otherwise(parts["query"])

    clean = lambda c: X.repair(F.coalesce(c, F.lit("")))
    return X.let(F.struct(clean(slot).alias("slot"), clean(query).alias("query")), of)


def rewrite_queries(queries: DataFrame) -> DataFrame:
    """``qid, kind, pos, query``: every form in which ``queries(qid, slot, query)`` is searched.

    Kinds are ``given``, ``general``, ``ratio`` (amounts of the metrics of a
    share), ``axes`` and ``slot``; a form that repeats another of the question
    comes once, under the first kind.
    """
    kinds = F.array(
        F.struct(F.lit(1).alias("tier"), F.lit("given").alias("kind"), F.array(F.coalesce("query", F.lit(""))).alias("forms")),
        F.struct(F.lit(2).alias("tier"), F.lit("general").alias("kind"), general_queries(F.col("query")).alias("forms")),
        F.struct(F.lit(3).alias("tier"), F.lit("ratio").alias("kind"), V.ratio_parts(F.col("query")).alias("forms")),
        F.struct(F.lit(4).alias("tier"), F.lit("axes").alias("kind"), F.array(extended_query(F.col("query"))).alias("forms")),
        F.struct(F.lit(5).alias("tier"), F.lit("slot").alias("kind"), F.array(enriched_query(F.col("slot"), F.col("query"))).alias("forms")),
    )
    rows = queries.select("qid", F.explode(kinds).alias("k")).select("qid", "k.tier", "k.kind", F.posexplode("k.forms").alias("pos", "query")).filter("query <> ''")
    first = rows.groupBy("qid", "query").agg(F.min(F.struct("tier", "pos", "kind")).alias("f"))
    return first.select("qid", "f.kind", F.col("f.pos").alias("pos"), "query")
