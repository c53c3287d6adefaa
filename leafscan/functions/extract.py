"""Extraction and classification rules as column expressions (D)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafscan.functions import text as X

# Numerals and units of clause ids, dates and amounts in page text.
CHINESE_NUM = "一二三四五六七八九十百千万零〇"
CLAUSE = rf"(第[{CHINESE_NUM}\p{{Nd}}]+[章节条款项])"
DATE = r"\p{Nd}{4}年(?:\p{Nd}{1,2}月(?:\p{Nd}{1,2}日)?)?"
NUMBER = (
    r"(?:\p{Nd}+(?:\.\p{Nd}+)?%|\p{Nd}+(?:\.\p{Nd}+)?(?:万|亿)?(?:元|股|吨|家|个|项|倍|年|个月|日)|"
    rf"[{CHINESE_NUM}]+分之[{CHINESE_NUM}]+)"
)
NUMBER_SIGNS = "%元股吨家个项倍年日分"  # each amount has one of them


def find_all(col: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.col(col) if isinstance(col, str) else col, F.lit(pattern), F.lit(group))


def sorted_terms(col: Column, pattern: str, needs: str) -> Column:
    """Distinct matches in order; only texts with any of the signs that each match holds are searched."""
    sure = F.contains(col, F.lit("%")) if "%" in needs else F.lit(False)
    wide = needs.replace("%", "")
    held = sure | ((F.octet_length(col) > F.length(col)) & col.rlike(X.one_of(wide)))
    none = F.array().cast("array<string>")
    return F.when(held, F.array_sort(F.array_distinct(find_all(col, pattern)))).when(col.isNotNull(), none)


def is_table_line(line: Column) -> Column:
    return X.strip(line).rlike(r"(?s)^\|.*\|$")


def table_headers(col: Column | str) -> Column:
    """Cells of the first table line, rule cells left out."""
    c = F.col(col) if isinstance(col, str) else col
    first = F.try_element_at(F.filter(X.lines(c), is_table_line), F.lit(1))
    cells = F.transform(F.split(X.strip(X.strip(first), "|"), r"\|"), lambda x: X.strip(x))
    kept = F.filter(cells, lambda x: ~x.rlike("^[-:]*$"))
    return F.when(F.contains(c, F.lit("|")), F.coalesce(kept, F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>")
    )


def page_terms(col: Column | str) -> dict[str, Column]:
    """The four term lists every page carries."""
    c = F.col(col) if isinstance(col, str) else col
    return {
        "clause_ids": sorted_terms(c, CLAUSE, "第"),
        "dates": sorted_terms(c, DATE, "年"),
        "numbers": sorted_terms(c, NUMBER, NUMBER_SIGNS),
        "table_headers": table_headers(c),
    }


# --- D5 ---------------------------------------------------------------------

# Units of measured values and the three surface forms of figures.
VALUE_UNITS = "%|亿元|万元|元|天|日|年|月|倍|个百分点|个基点|万股|股"
VALUE = rf"(?<![A-Za-z0-9])(\p{{Nd}}+(?:\.\p{{Nd}}+)?)[{X.WS}]*({VALUE_UNITS})"
SURFACES = (
    rf"\p{{Nd}}+(?:\.\p{{Nd}}+)?[{X.WS}]*%",
    rf"\p{{Nd}}+(?:\.\p{{Nd}}+)?[{X.WS}]*(?:亿元|万元|元|天|日|年|月|倍|个百分点|个基点|万股|股)",
    rf"(?:19|20)\p{{Nd}}{{2}}[{X.WS}]*年(?:[{X.WS}]*\p{{Nd}}{{1,2}}[{X.WS}]*月)?(?:[{X.WS}]*\p{{Nd}}{{1,2}}[{X.WS}]*日)?",
)


def clean(col: Column, n: int) -> Column:
    """Repaired, squeezed and cut text of evaluation cases."""
    return F.substring(X.squeeze(X.repair(F.coalesce(col, F.lit("")), "eval", markers=EVAL_MARKERS, common=EVAL_COMMON)), 1, n)


# Markers and frequent words of the evaluation texts.
EVAL_MARKERS = "鏍嵁銆涓鍏鐨锛浠绗骞閫鐢"
EVAL_COMMON = ("根据", "公司", "报告", "发行", "债券", "保险", "年度", "收入", "规定", "管理")


def measured_values(col: Column, n: int = 8) -> Column:
    """First distinct ``surface``s with ``value`` and normalised ``unit``."""
    parts = F.arrays_zip(
        find_all(col, VALUE, 0).alias("surface"), find_all(col, VALUE, 1).alias("value"), find_all(col, VALUE, 2).alias("unit")
    )
    rows = F.transform(
        parts,
        lambda p: F.struct(
            F.substring(X.squeeze(p["surface"]), 1, 40).alias("surface"),
            p["value"].cast("double").alias("value"),
            F.when(p["unit"] == "日", "天").otherwise(p["unit"]).alias("unit"),
        ),
    )
    # value and unit follow from the surface, so distinct surfaces are distinct rows
    return F.slice(F.array_distinct(rows), 1, n)


def surfaces(col: Column, n: int = 4) -> Column:
    """Figures as they stand, by form then place."""
    found = F.concat(*[find_all(col, p) for p in SURFACES])
    kept = F.filter(F.transform(found, lambda x: F.substring(X.squeeze(x), 1, 40)), lambda x: x != "")
    return F.slice(F.array_distinct(kept), 1, n)


def number_tokens(col: Column) -> Column:
    """Figures with and without thousands commas; single digits count only as percentages."""
    found = find_all(X.repair(col), r"\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?%?")
    kept = F.filter(found, lambda x: F.endswith(x, F.lit("%")) | (F.length(F.regexp_replace(x, "[,.]", "")) >= 2))
    return F.array_distinct(F.concat(kept, F.transform(kept, lambda x: F.replace(x, F.lit(","), F.lit("")))))


# --- D6 ---------------------------------------------------------------------

# Words too common to be keywords.
STOP_TERMS = (
    "公司", "报告", "年度", "本公司", "相关", "主要", "业务", "情况", "管理", "金融", "市场", "行业", "风险", "资产",
    "投资", "规定", "办法", "保险",
)
MARKUP_STOP_TERMS = STOP_TERMS + ("table", "td", "tr")


def keyword_words(col: Column, longest: int = 12, stop: tuple[str, ...] = STOP_TERMS) -> Column:
    """Candidate words in reading order, repeats kept."""
    words = find_all(col, f"[{X.CJK}A-Za-z0-9]{{2,{longest}}}")
    return F.filter(words, lambda w: ~w.isin(*stop) & ~w.rlike(r"^\p{Nd}+$"))


def sentence_with(col: Column, needle: Column, n: int, before: int, after: int) -> Column:
    """First sentence holding a string, else a window around it, else the beginning."""
    parts = F.split(col, "(?<=[。；;.!?？])")
    hit = F.try_element_at(F.filter(parts, lambda p: F.contains(p, needle)), F.lit(1))

    def window(at: Column) -> Column:
        start = F.greatest(F.lit(1), at - before)
        return F.when(at > 0, F.substring(col, start, at - start + after)).otherwise(col)

    return clean(F.coalesce(hit, X.let(F.position(needle, col), window)), n)


# --- D7-D10 -------------------------------------------------------------------

# Endings of named things, list words, metrics and rule words.
TYPED = "公司|集团|银行|保险|基金|证券|股份|科技|发展|仪器|激光|光模块|产品|合同|规则|办法|通知|条例"
LIST_MARKERS = ("领域", "行业", "产品", "公司", "机构")
NAME_CHARS = f"{X.CJK}A-Za-z0-9"
METRIC_TERMS = (
    "营业收入", "净利润", "归母净利润", "研发投入", "研发费用", "现金流", "保费", "现金价值", "保险金", "赔付比例", "市场规模",
    "增速", "收益率", "成本", "费用率", "毛利率", "市占率",
)
YEAR_METRIC = r"\p{Nd}{4}年[^，。；;]{0,16}(?:收入|利润|规模|增速|比例|成本|费用|现金价值)"
CONSTRAINTS = (
    (("都", "均", "全部", "各自", "分别", "四款", "三类", "两类", "两者"), "需要覆盖题干涉及的所有对象，不能只验证其中一部分。"),
    (("同时", "并且", "既", "又", "双重"), "需要同时满足复合条件，不能只满足其中一个条件。"),
    (("高于", "低于", "大于", "小于", "超过", "不超过"), "需要核对比较方向、单位和统计口径。"),
    (("第", "年度", "周岁", "日期", "施行", "发布"), "需要核对时间、年度、年龄或生效日期条件。"),
    (("只填写", "保留两位", "%", "大于号", "排序"), "需要按问题要求输出格式化答案。"),
)
TASK_RULES = (
    ("calculation", "计算题", ("计算", "多少", "合计", "比例", "占比", "增速", "收益率")),
    ("fact_extraction", "抽取题", ("抽取", "填写", "日期", "名称", "文号", "施行", "发布")),
    ("ranking", None, ("排序", "排名", "从高到低", "从低到高", "大于号")),
    ("comparison", None, ("比较", "高于", "低于", "大于", "小于", "多于", "少于", "最准确", "哪两项")),
    ("rule_applicability", None, ("适用", "责任免除", "责任范围", "规定", "规则", "监管", "处罚", "违法", "应当", "不得")),
)
FORMATS = {"多选题": "multi", "单选题": "mcq", "判断题": "tf", "计算题": "free", "抽取题": "free"}


def any_term(col: Column, terms) -> Column:
    return col.rlike("|".join(terms))


def entities(col: Column | str, n: int = 12) -> Column:
    """Quoted names, typed names, and the members of lists before a type word."""

    def members(found: Column, lead: str, tail: str | None) -> Column:
        def trimmed(p: Column) -> Column:
            p = F.regexp_replace(X.strip(p), f"^(?:{lead})++", "")
            return F.regexp_replace(p, f"(?:{tail})$", "") if tail else p

        parts = F.flatten(F.transform(found, lambda x: F.split(x, "[、/和及与]")))
        return F.filter(F.transform(parts, trimmed), lambda p: F.length(p).between(2, 20))

    def named(t: Column) -> Column:
        def where(held: Column, found: Column) -> Column:
            return F.when(held, found).otherwise(F.array().cast("array<string>"))

        # a list is looked for only in texts with the word it stands before
        has = {m: F.contains(t, F.lit(m)) for m in LIST_MARKERS}
        lists = [
            where(has[m], members(find_all(t, f"([{NAME_CHARS}、/和及与]{{2,80}}){m}", 1), "在|及|与|和|都|各|以下|关于|某|一家|一个|几款|四款|三类|两类", "中|内|上|下|里"))
            for m in LIST_MARKERS
        ]
        field = has["领域"] | has["行业"]
        fields = where(field, members(find_all(t, f"在([{NAME_CHARS}、/和及与]{{2,60}})(?:领域|行业)", 1), "在|及|与|和|都|各", None))
        triple = rf"([{NAME_CHARS}]{{2,20}})、([{NAME_CHARS}]{{2,20}})和([{NAME_CHARS}]{{2,20}})(?:领域|行业)"
        three = F.flatten(
            F.transform(
                F.arrays_zip(*[find_all(t, triple, g).alias(f"g{g}") for g in (1, 2, 3)]),
                lambda z: F.array(z["g1"], z["g2"], z["g3"]),
            )
        )
        three = F.filter(
            F.transform(three, lambda p: F.regexp_replace(X.strip(p), "^(?:在|及|与|和|都|各)++", "")), lambda p: F.length(p).between(2, 20)
        )
        found = F.concat(
            find_all(t, "[“\"《]([^”\"》]{2,30})[”\"》]", 1), find_all(t, f"[{NAME_CHARS}]{{2,30}}(?:{TYPED})"), *lists, fields, where(field, three)
        )
        return F.slice(F.array_distinct(found), 1, n)

    return X.let(X.squeeze(F.col(col) if isinstance(col, str) else col), named)


def metrics(col: Column | str, n: int = 12) -> Column:
    """Known metric words, then year-metric phrases."""
    t = X.squeeze(F.col(col) if isinstance(col, str) else col)
    known = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(m)), F.lit(m)) for m in METRIC_TERMS]))
    return F.slice(F.array_distinct(F.concat(known, find_all(t, YEAR_METRIC))), 1, n)


# Endings of entities and of metrics, spans of time, and words that make a piece no term.
ENTITY_ENDINGS = "板块|项目|产品|业务|公司|发行人"
METRIC_ENDINGS = "率|额|值|数|量|收入|成本|利润|余额|净额|占比|比例|金额|规模|价格|费用|收益"
ENTITY_ENDINGS_FIRST = "".join(e[0] for e in ENTITY_ENDINGS.split("|"))
METRIC_ENDINGS_FIRST = "".join(e[0] for e in METRIC_ENDINGS.split("|"))
CJK_BUT_OF = r"一-\u7683\u7685-鿿"  # X.CJK without 的
PIECE_BREAKS = X.WS_CHARS + ",，、；;：:（）()《》“”\"'?？"
TERM_BREAKS = X.WS_CHARS + "，。；;：:（）()《》“”\"'?？"
YEAR_SPAN = rf"(?:19|20)\p{{Nd}}{{2}}[{X.WS}]*[-至][{X.WS}]*(?:19|20)?\p{{Nd}}{{2}}[{X.WS}]*年?"
HALF_YEAR = rf"(?:19|20)\p{{Nd}}{{2}}[{X.WS}]*年(?:[{X.WS}]*1[{X.WS}]*[-至][{X.WS}]*6[{X.WS}]*月)?"
MONTH_SPAN = rf"\p{{Nd}}+[{X.WS}]*[-至][{X.WS}]*\p{{Nd}}+[{X.WS}]*月"
PERIOD = rf"20\p{{Nd}}{{2}}|19\p{{Nd}}{{2}}|第[{X.WS}]*\p{{Nd}}+[{X.WS}]*个?[{X.WS}]*[年月日]|\p{{Nd}}+[{X.WS}]*[-至][{X.WS}]*\p{{Nd}}+[{X.WS}]*月"
TERM_LEAD = "^(?:查找|查询|获取|确定)"
NO_TERM = "多少|什么|哪些|根据|募集说明书|第[一二三四五六七八九十]+期"


def typed_terms(parts: Column, n: int = 12) -> Column:
    """Distinct terms of texts: entities and metrics cut at their endings, then plain pieces; years and periods removed.

    ``parts`` is an array of texts; terms have 2 to 24 signs, in order of first appearance.
    """

    def of(raw: Column) -> Column:
        spaced = F.regexp_replace(raw, f"{X.one_of(TERM_BREAKS)}+", " ")
        return F.concat(X.let(spaced, named), F.split(raw, f"{X.one_of(PIECE_BREAKS)}+"))

    def named(spaced: Column) -> Column:
        # blanks are the only white space left; an ending is tried only where its first sign stands
        metric = rf"[A-Za-z0-9{CJK_BUT_OF}]{{2,16}}(?={X.one_of(METRIC_ENDINGS_FIRST)})(?:{METRIC_ENDINGS})"
        entity = f"[^ 的]{{1,18}}(?={X.one_of(ENTITY_ENDINGS_FIRST)})(?:{ENTITY_ENDINGS})"
        # no match leaves its piece, so only pieces with an ending are searched
        ended = F.filter(F.split(spaced, " "), lambda p: p.rlike(ENTITY_ENDINGS))
        return F.concat(find_all(F.array_join(ended, " "), entity), find_all(spaced, metric))

    def bare(terms: Column) -> Column:
        # terms hold no white space, so as the lines of one text they pass each rule together
        for rule in (f"(?m){TERM_LEAD}", *[span.replace(f"[{X.WS}]*", "") for span in (YEAR_SPAN, HALF_YEAR, r"(?:19|20)\p{Nd}{2}", MONTH_SPAN)]):
            terms = F.regexp_replace(terms, rule, "")
        terms = F.regexp_replace(terms, f"(?m)^(?:{PERIOD})$".replace(f"[{X.WS}]*", ""), "")
        return X.let(terms, lambda t: F.when(t.rlike(NO_TERM), F.regexp_replace(t, f"(?m)^.*?(?:{NO_TERM}).*$", "")).otherwise(t))

    texts = F.transform(parts, lambda p: X.repair(F.coalesce(p, F.lit(""))))
    terms = F.split(bare(F.array_join(F.flatten(F.transform(texts, of)), "\n")), "\n")
    return F.slice(F.array_distinct(F.filter(terms, lambda t: F.length(t).between(2, 24))), 1, n)


def constraints(col: Column | str) -> Column:
    """What an answer has to respect."""
    t = X.squeeze(F.col(col) if isinstance(col, str) else col)
    return F.array_compact(F.array(*[F.when(any_term(t, terms), F.lit(text)) for terms, text in CONSTRAINTS]))


def task_type(text: Column, kind: Column) -> Column:
    """First matching rule decides."""
    t = X.squeeze(text)
    chain = F.when(F.lit(False), F.lit(""))
    for name, question_type, terms in TASK_RULES:
        hit = any_term(t, terms)
        chain = chain.when((kind == question_type) | hit if question_type else hit, name)
    return chain.otherwise("claim_verification")


def answer_format(given: Column, kind: Column) -> Column:
    """Stated format, else the one the question type implies."""
    implied = F.lit("unknown")
    for name, value in FORMATS.items():
        implied = F.when(X.strip(kind) == name, value).otherwise(implied)
    return F.coalesce(X.falsy_null(F.lower(X.strip(given))), implied)


def normalize_answer(answer: Column, form: Column) -> Column:
    """Letters A-D; the first one for a single choice, else all, sorted and unique."""
    letters = find_all(F.upper(F.coalesce(answer, F.lit(""))), "[A-D]")
    return F.when(form.isin("mcq", "tf"), F.coalesce(F.try_element_at(letters, F.lit(1)), F.lit(""))).otherwise(
        F.array_join(F.array_sort(F.array_distinct(letters)), "")
    )


LABELLED = (
    rf"(?i)(?:answer[_\-{X.WS}]*\p{{Nd}}+|答案[{X.WS}]*\p{{Nd}}+|第[{X.WS}]*\p{{Nd}}+[{X.WS}]*项|"
    rf"[12]\p{{Nd}}{{3}}(?:[{X.WS}]*年(?:[{X.WS}]*1[{X.WS}]*[-至][{X.WS}]*6[{X.WS}]*月)?|年度)?)[^0-9%-]{{0,20}}(-?\p{{Nd}}+(?:\.\p{{Nd}}+)?[{X.WS}]*%?)"
)


def answer_parts(answer: Column, form: Column, n: int = 4) -> Column:
    """A free answer in up to four parts: by bars or lines, else its percentages, else its labelled values."""
    text = X.strip(F.coalesce(answer, F.lit("")))
    bars = F.filter(F.transform(F.split(text, rf"[{X.WS}]*\|[{X.WS}]*|\n+"), lambda x: X.strip(x)), lambda x: x != "")
    tight = lambda arr: F.transform(arr, lambda x: F.regexp_replace(x, f"[{X.WS}]+", ""))
    percents = tight(find_all(text, rf"\p{{Nd}}+(?:\.\p{{Nd}}+)?[{X.WS}]*%"))
    labelled = tight(find_all(text, LABELLED, 1))
    free = F.when(F.size(bars) > 1, bars).when(F.size(percents) > 1, percents).when(F.size(labelled) > 1, labelled).otherwise(bars)
    parts = F.when(form == "free", free).otherwise(F.array(normalize_answer(answer, form)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, n)


# Wording that asks for a check.
VERIFY_MARKERS = ("请核验", "核验", "是否成立", "是否正确", "是否准确", "是否支持", "是否适用", "是否符合", "陈述是否", "说法是否")


def is_verification(kind: Column, question: Column) -> Column:
    """Task types and wording that want a yes or no."""
    return F.coalesce(kind, F.lit("")).isin("claim_verification", "rule_applicability") | any_term(X.repair(question), VERIFY_MARKERS)
