"""Evaluation, case generation and sample building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import text as X
from leafscan.functions.payload import backtick_value, json_block
from leafscan.operators import index as I

def none() -> Column:
    return F.array().cast("array<string>")


def hit_any(text: Column, words: Column) -> Column:
    return F.exists(F.coalesce(words, none()), lambda w: (w != "") & F.contains(text, w))


# --- K1-K3, A7 -----------------------------------------------------------------


def score_cases(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """K1: hits and verdict per case of ``cases`` with its response."""
    wanted = F.array_distinct(F.filter(F.coalesce("expected_doc_ids", none()), lambda x: x != ""))
    rows = F.coalesce("evidence", F.array().cast("array<struct<doc_id:string,heading:string,quote:string>>"))
    seen = F.concat(F.coalesce("doc_ids", none()), F.transform(rows, lambda e: F.coalesce(e["doc_id"], F.lit(""))))
    evidence_text = F.array_join(
        F.transform(rows, lambda e: F.concat(F.coalesce(e["quote"], F.lit("")), F.lit(" "), F.coalesce(e["heading"], F.lit("")))), "\n"
    )
    answer, reason = F.coalesce("answer", F.lit("")), F.coalesce("reason", F.lit(""))
    scored = cases.join(responses, "id").select(
        "id",
        "domain",
        F.coalesce("task_type", F.lit("")).alias("task_type"),
        wanted.alias("wanted"),
        F.arrays_overlap(wanted, seen).alias("doc_hit"),
        ((F.size(wanted) > 0) & (F.size(F.array_except(wanted, seen)) == 0)).alias("multi_doc_coverage"),
        hit_any(F.concat_ws("\n", answer, reason), F.col("expected_answer_keywords")).alias("answer_keyword_hit"),
        hit_any(F.concat_ws("\n", evidence_text, reason, answer), F.col("expected_evidence_keywords")).alias("evidence_keyword_hit"),
        F.round("elapsed_seconds", 3).alias("elapsed_seconds"),
    )
    any_word = F.col("answer_keyword_hit") | F.col("evidence_keyword_hit")
    passed = (
        F.when(F.col("task_type") == "insufficient_evidence", F.col("answer_keyword_hit"))
        .when(F.size("wanted") > 1, F.col("multi_doc_coverage") & any_word)
        .otherwise(F.col("doc_hit") & any_word)
    )
    return scored.withColumn("passed", passed).drop("wanted")


RATES = ("passed", "doc_hit", "multi_doc_coverage", "answer_keyword_hit", "evidence_keyword_hit")


def eval_summary(results: DataFrame) -> DataFrame:
    """K2: rates over all cases (``task_type`` NULL) and per task type, in one pass."""
    rates = [F.round(F.avg(F.col(c).cast("int")), 4).alias(f"{c}_rate") for c in RATES]
    grouped = results.rollup("task_type").agg(
        F.grouping("task_type").alias("overall"), F.count("*").alias("total"), *rates,
        F.round(F.avg("elapsed_seconds"), 3).alias("avg_latency_seconds"),
    )
    return grouped.filter((F.col("overall") == 0) | (F.col("total") > 0))


def select_cases(cases: DataFrame, order: str, case_id: str | None = None, index: int | None = None, limit: int | None = None) -> DataFrame:
    """K3: one case by id or 1-based place, the first ``limit``, or all; ``order`` is the place column."""
    if case_id:
        return cases.filter(F.col("id") == case_id)
    if limit:
        return cases.orderBy(order).limit(limit)
    if index:
        return cases.orderBy(order).offset(index - 1).limit(1)
    return cases


def upsert_results(old: DataFrame, new: DataFrame, cases: DataFrame, order: str = "ord") -> DataFrame:
    """New rows replace old ones by id; ``case_ord`` is the case's place, NULL (last) for unknown ids."""
    merged = old.filter("id <> ''").join(new, "id", "left_anti").unionByName(new.filter("id <> ''"))
    return merged.join(cases.select("id", F.col(order).alias("case_ord")), "id", "left")


def answer_table(old: DataFrame, new: DataFrame) -> DataFrame:
    """Answers by question with a leading ``summary`` row of token totals (``ord`` 0)."""
    cols = ["qid", "answer", "prompt_tokens", "completion_tokens"]
    kept = old.filter("qid <> 'summary'").join(new, "qid", "left_anti").select(*cols).unionByName(new.select(*cols))
    total = kept.agg(
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
    ).select(F.lit("summary").alias("qid"), F.lit("").alias("answer"), "prompt_tokens", "completion_tokens")
    both = total.withColumn("ord", F.lit(0)).unionByName(kept.withColumn("ord", F.lit(1)))
    return both.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).orderBy("ord", "qid")


def token_usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Token totals per key."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return calls.groupBy(*keys).agg(*sums)


def counts(df: DataFrame, *keys: str, distinct: str | None = None) -> DataFrame:
    """Rows (and distinct values) per value of every key, counted in one pass."""
    exploded = df.select(
        *([distinct] if distinct else []),
        F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k"),
    ).select("k.*", *([distinct] if distinct else []))
    aggs = [F.count("*").alias("n")] + ([F.countDistinct(distinct).alias("n_distinct")] if distinct else [])
    return exploded.groupBy("key", "value").agg(*aggs)


# --- D6, K4, K5 ------------------------------------------------------------------


def top_keywords(texts: DataFrame, key: str, text: str, n: int = 8, longest: int = 12, stop=E.STOP_TERMS) -> DataFrame:
    """The n weightiest words per row, as a list in rank order."""
    words = texts.select(key, F.posexplode(E.keyword_words(F.col(text), longest, stop)).alias("pos", "word"))
    scored = words.groupBy(key, "word").agg(F.sum(1 + F.least(F.length("word"), F.lit(6))).alias("weight"), F.min("pos").alias("pos"))
    order = Window.partitionBy(key).orderBy(F.desc("weight"), F.desc(F.length("word")), "pos")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return top.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords")
    )


def _first_per_doc(pages: DataFrame) -> DataFrame:
    cols = [c for c in pages.columns if c not in ("domain", "doc_id")]
    first = pages.groupBy("domain", "doc_id").agg(F.min_by(F.struct(*cols), "page_no").alias("p"))
    return first.select("domain", "doc_id", "p.*")


def _rank_docs(pages: DataFrame) -> Column:
    """Place of a document among its domain's, in page order; the rank filter prunes before the shuffle."""
    return F.row_number().over(Window.partitionBy("domain").orderBy("doc_id"))


def _useful(pages: DataFrame, least: int) -> DataFrame:
    """Pages long enough that are not contents or disclaimers."""
    text = E.clean(F.coalesce(X.falsy_null("text"), "index_text"), 1400)
    rows = pages.withColumn("full", text)
    contents = F.regexp_count("full", F.lit("目录")) >= 3
    disclaimer = F.regexp_count("full", F.lit("免责声明")) >= 2
    return rows.filter((F.length("full") >= least) & ~contents & ~disclaimer)


def _titles(pages: DataFrame, n_head: int) -> DataFrame:
    head = F.coalesce(X.falsy_null(F.array_join(F.filter("heading_path", lambda h: h != ""), I.PATH_SEP)), X.falsy_null("title"), F.lit("相关章节"))
    return pages.select("*", E.clean(F.col("title"), 120).alias("shown_title"), E.clean(head, n_head).alias("heading"))


def draft_cases(pages: DataFrame, per_domain: int = 10) -> DataFrame:
    """K4: per domain half numeric cases, then summaries of other documents, one case per document."""
    half = max(1, per_domain // 2)
    base = _useful(pages, 80).select("domain", "doc_id", "page_id", "page_no", "title", "heading_path", F.substring("full", 1, 1200).alias("full"))
    figures = base.withColumn("figures", E.surfaces(F.col("full"))).filter(F.size("figures") > 0)
    numeric = _first_per_doc(figures)
    numeric = numeric.withColumn("no", _rank_docs(numeric)).filter(F.col("no") <= half)
    words = F.size(F.array_distinct(E.keyword_words(F.col("full")))) >= 3
    rest = _first_per_doc(base.filter(words).join(numeric.select("doc_id"), "doc_id", "left_anti"))
    taken = numeric.groupBy("domain").agg(F.count("*").alias("taken"))
    rest = rest.withColumn("no", _rank_docs(rest)).filter(F.col("no") <= per_domain).join(taken, "domain", "left")
    rest = rest.filter(F.col("no") + F.coalesce("taken", F.lit(0)) <= per_domain).drop("taken")

    answer = F.element_at("figures", 1)
    numeric = _titles(numeric, 120).withColumn("answer", answer)
    numeric = numeric.withColumn("quote", E.sentence_with(F.col("full"), F.col("answer"), 320, 120, 180))
    numeric = numeric.join(top_keywords(numeric, "page_id", "quote", 4), "page_id", "left")
    numeric = numeric.select(
        F.format_string("%s_num_%03d", "domain", "no").alias("id"), "domain", "doc_id", "page_id",
        F.lit("numeric_fact").alias("answer_type"),
        F.concat(F.lit("根据《"), "shown_title", F.lit("》中“"), "heading", F.lit("”部分，文中提到的关键数值是多少？请给出原文中的数值并简要说明对应事项。")).alias("question"),
        F.col("answer").alias("expected_answer"), F.array("answer").alias("expected_answer_keywords"),
        F.array_distinct(F.concat(F.array("answer"), F.coalesce("keywords", none()))).alias("expected_evidence_keywords"), "quote",
    )
    summary = _titles(rest, 120)
    summary = summary.join(top_keywords(summary, "page_id", "full", 6), "page_id").select(
        F.format_string("%s_summary_%03d", "domain", "no").alias("id"), "domain", "doc_id", "page_id",
        F.lit("summary_keyword").alias("answer_type"),
        F.concat(F.lit("根据《"), "shown_title", F.lit("》中“"), "heading", F.lit("”部分，概括该部分主要讨论的内容。")).alias("question"),
        F.array_join(F.slice("keywords", 1, 4), "；").alias("expected_answer"), F.slice("keywords", 1, 4).alias("expected_answer_keywords"),
        F.col("keywords").alias("expected_evidence_keywords"), E.clean(F.col("full"), 320).alias("quote"),
    )
    return numeric.unionByName(summary).withColumn("needs_human_review", F.lit(True))


def plain_number(value: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f", value)


def altered(n: Column) -> Column:
    """A wrong value of the same form: one more, or a tenth more below one."""
    changed = n["value"] + F.when(n["value"] >= 1, 1.0).otherwise(0.1)
    whole = (n["value"] == F.floor(n["value"])) & (n["unit"] != "%")
    # trailing zeros and dots are stripped from the whole text, so only where no unit follows; "%" always does
    return F.when(whole, F.concat(changed.cast("bigint").cast("string"), n["unit"])).otherwise(F.concat(plain_number(changed), n["unit"]))


def summed(a: Column, b: Column) -> Column:
    total = a["value"] + b["value"]
    near = F.abs(total - F.round(total)) <= 1e-9 * F.greatest(F.abs(total), F.abs(F.round(total)))
    return F.when(near, F.concat(F.round(total).cast("bigint").cast("string"), a["unit"])).otherwise(F.concat(plain_number(total), a["unit"]))


def task_cases(pages: DataFrame) -> DataFrame:
    """K5: fact, claim check, sum, comparison, summary and insufficient-evidence cases per domain, at most 10."""
    base = _useful(pages, 100)
    base = base.select(
        "domain", "doc_id", "page_id", "page_no", "title", "heading_path", "full",
        E.measured_values(F.col("full")).alias("numbers"),
        F.size(F.slice(F.array_distinct(E.keyword_words(F.col("full"), 14, E.MARKUP_STOP_TERMS)), 1, 8)).alias("n_words"),
    )
    numeric = _first_per_doc(base.filter(F.size("numbers") > 0))
    numeric = numeric.withColumn("first", F.element_at("numbers", 1))
    wordy = _first_per_doc(base.filter("n_words >= 4"))

    ranked = numeric.withColumn("no", _rank_docs(numeric))
    facts = ranked.filter("no <= 2").select("*", F.lit("fact").alias("kind"), F.col("no").alias("case_no"), F.lit(1).alias("side"))
    checks = ranked.filter("no BETWEEN 3 AND 4").select("*", F.lit("verify").alias("kind"), (F.col("no") - 2).alias("case_no"), F.lit(1).alias("side"))

    def pair_of(numbers: Column) -> Column:
        """First two values of the first unit that has two."""
        units = F.array_distinct(F.transform(numbers, lambda n: n["unit"]))
        groups = F.transform(units, lambda u: F.filter(numbers, lambda n: n["unit"] == u))
        return F.slice(F.try_element_at(F.filter(groups, lambda g: F.size(g) >= 2), F.lit(1)), 1, 2)

    pairs = numeric.withColumn("pair", pair_of(F.col("numbers"))).filter("pair IS NOT NULL")
    pairs = pairs.withColumn("no", _rank_docs(pairs)).filter("no <= 2")
    sums = pairs.select("*", F.lit("calc").alias("kind"), F.col("no").alias("case_no"), F.lit(1).alias("side")).drop("pair")

    by_unit = numeric.withColumn("no", F.row_number().over(Window.partitionBy("domain", "first.unit").orderBy("doc_id"))).filter("no <= 4")
    lead = Window.partitionBy("domain", "first.unit")
    by_unit = by_unit.withColumn("unit_first", F.min("doc_id").over(lead)).withColumn("n_unit", F.count("*").over(lead))
    both = by_unit.withColumn("pair_no", F.ceil(F.col("no") / 2)).filter(F.col("pair_no") * 2 <= F.col("n_unit"))
    # pairs come unit by unit in order of first appearance; the first two of a domain stay
    both = both.withColumn("case_no", F.dense_rank().over(Window.partitionBy("domain").orderBy("unit_first", "pair_no"))).filter("case_no <= 2")
    compares = both.select(
        *numeric.columns, "no", F.lit("compare").alias("kind"), "case_no", (F.col("no") - 2 * (F.col("pair_no") - 1)).alias("side")
    )
    wordy = wordy.withColumn("first", F.try_element_at("numbers", F.lit(1)))
    heads = wordy.withColumn("no", _rank_docs(wordy)).filter("no <= 2")
    heads = heads.withColumn("n", F.count("*").over(Window.partitionBy("domain"))).filter("n = 2").drop("n")
    summaries = heads.select("*", F.lit("summary").alias("kind"), F.lit(1).alias("case_no"), F.col("no").alias("side"))
    cols = [c for c in wordy.columns if c != "domain"]
    last = wordy.groupBy("domain").agg(F.max_by(F.struct(*cols), "doc_id").alias("p")).select("domain", "p.*")
    lacking = last.select("*", F.lit(1).alias("no"), F.lit("insufficient").alias("kind"), F.lit(1).alias("case_no"), F.lit(1).alias("side"))

    chosen = facts
    for part in (checks, sums, compares, summaries, lacking):
        chosen = chosen.unionByName(part)
    # about 14 pages per domain are left: only they get keywords
    keywords = top_keywords(chosen.dropDuplicates(["page_id"]), "page_id", "full", 8, 14, E.MARKUP_STOP_TERMS)
    chosen = _titles(chosen, 100).join(keywords, "page_id", "left").withColumn("keywords", F.coalesce("keywords", none()))
    chosen = chosen.withColumn("pair", pair_of(F.col("numbers")))
    side = F.struct("side", "doc_id", "page_id", "shown_title", "heading", "first", "pair", "keywords")
    cases = chosen.groupBy("domain", "kind", "case_no").agg(F.array_sort(F.collect_list(side)).alias("s"))
    a, b = F.col("s")[0], F.try_element_at("s", F.lit(2))
    surface = a["first"]["surface"]
    true_claim = F.col("case_no") % 2 == 1
    stated = F.when(true_claim, surface).otherwise(altered(a["first"]))
    verdict = F.when(true_claim, "supported").otherwise("contradicted")
    p0, p1 = a["pair"][0], F.try_element_at(a["pair"], F.lit(2))
    higher = F.when(a["first"]["value"] >= b["first"]["value"], a).otherwise(b)
    shared = F.concat(F.slice(a["keywords"], 1, 3), F.coalesce(F.slice(b["keywords"], 1, 3), none()))
    place = [F.lit("根据《"), a["shown_title"], F.lit("》中“"), a["heading"], F.lit("”部分，")]

    def per_kind(**parts: Column) -> Column:
        chain = F.when(F.lit(False), None)
        for kind, value in parts.items():
            chain = chain.when(F.col("kind") == kind, value)
        return chain

    number = F.when(F.col("kind").isin("summary", "insufficient"), F.format_string("%s_%s_%02d", "domain", "kind", "case_no")).otherwise(
        F.format_string("%s_%s_%02d", "domain", "kind", "case_no")
    )
    doc_ids = F.array_distinct(F.transform("s", lambda x: x["doc_id"]))
    page_ids = F.array_distinct(F.transform("s", lambda x: x["page_id"]))
    missing = F.lit("证据不足")
    built = cases.select(
        number.alias("id"),
        "domain",
        per_kind(
            fact=F.lit("fact_extraction"), verify=F.lit("claim_verification"), calc=F.lit("numeric_calculation"),
            compare=F.lit("multi_doc_comparison"), summary=F.lit("multi_doc_summary"), insufficient=F.lit("insufficient_evidence"),
        ).alias("task_type"),
        per_kind(
            fact=F.concat(*place, F.lit("文中提到的关键数值是多少？请给出数值并说明对应事项。")),
            verify=F.concat(F.lit("请核验："), *place, F.lit("相关关键数值为"), stated, F.lit("。该陈述是否成立？请给出依据。")),
            calc=F.concat(*place, F.lit("把"), p0["surface"], F.lit("和"), p1["surface"], F.lit("相加，合计是多少？请写出计算过程。")),
            compare=F.concat(F.lit("比较《"), a["shown_title"], F.lit("》和《"), b["shown_title"], F.lit("》中各自相关章节披露的关键数值，哪一份文档中的数值更高？请分别给出两个数值和依据。")),
            summary=F.concat(F.lit("分别概括《"), a["shown_title"], F.lit("》和《"), b["shown_title"], F.lit("》中相关章节讨论的重点，并总结二者共同涉及的主题。")),
            insufficient=F.concat(F.lit("根据《"), a["shown_title"], F.lit("》，请回答该文档是否披露了火星矿业机器人业务在2099年的营业收入、净利润和客户数量？如果没有充分证据，请明确说明证据不足。")),
        ).alias("question"),
        per_kind(
            fact=surface, verify=verdict, calc=summed(p0, p1), compare=higher["shown_title"], summary=F.array_join(shared, "；"), insufficient=missing
        ).alias("expected_answer"),
        F.array_distinct(
            per_kind(
                fact=F.array(surface), verify=F.array(verdict, surface), calc=F.array(summed(p0, p1), p0["surface"], p1["surface"]),
                compare=F.array(higher["shown_title"], higher["first"]["surface"]), summary=shared,
                insufficient=F.array(missing, F.lit("未披露"), F.lit("没有充分证据")),
            )
        ).alias("expected_answer_keywords"),
        doc_ids.alias("expected_doc_ids"),
        page_ids.alias("expected_evidence_ids"),
        F.array_distinct(
            per_kind(
                fact=F.concat(F.array(surface), F.slice(a["keywords"], 1, 4)), verify=F.concat(F.array(surface), F.slice(a["keywords"], 1, 4)),
                calc=F.concat(F.array(p0["surface"], p1["surface"]), F.slice(a["keywords"], 1, 4)),
                compare=F.concat(F.array(surface, b["first"]["surface"]), F.slice(a["keywords"], 1, 2), F.slice(b["keywords"], 1, 2)),
                summary=shared, insufficient=F.slice(a["keywords"], 1, 4),
            )
        ).alias("expected_evidence_keywords"),
        F.lit(True).alias("needs_human_review"),
    )
    return built


# --- K6-K8 -------------------------------------------------------------------------

EVIDENCE_TYPE = "array<struct<evidence_id:string,doc_id:string,heading_path:array<string>,source:string,text:string>>"
UNIT_TYPE = (
    "array<struct<unit_id:string,kind:string,option:string,claim:string,option_subject:string,question_condition:string,task:string,"
    f"target_doc_ids:array<string>,slots:array<string>,notes:array<string>,evidence:{EVIDENCE_TYPE},"
    "evidence_marks:map<string,struct<mark:string>>,"
    "audit:struct<status:string,condition_satisfied:boolean,filled:array<string>,missing:array<string>,evidence_marks:array<string>,next_action:string,reason:string>>>"
)


def log_qid(path: Column, text: Column) -> Column:
    titled = F.regexp_extract(text, rf"# .*?Debug:[{X.WS}]*([A-Za-z0-9_]+)", 1)
    return F.coalesce(X.falsy_null(titled), F.regexp_replace(I.stem(path), "^(?:clean_|window_|langgraph_)", ""))


def audit_samples(logs: DataFrame, max_evidence: int = 8, evidence_chars: int = 900) -> DataFrame:
    """K6: one weak-label sample per audited unit of ``logs(path, text)``."""
    units = F.coalesce(X.falsy_null(json_block(F.col("text"), "## Detailed Units")), X.falsy_null(json_block(F.col("text"), "## Unit Results")))
    rows = logs.select(
        "path",
        log_qid(F.col("path"), F.col("text")).alias("qid"),
        F.coalesce(X.falsy_null(backtick_value(F.col("text"), r"\banswer")), backtick_value(F.col("text"), "final_answer")).alias("final_answer"),
        F.from_json(backtick_value(F.col("text"), "token_usage"), "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint").alias("token_usage"),
        F.posexplode(F.from_json(units, UNIT_TYPE)).alias("pos", "u"),
    ).filter("u.audit IS NOT NULL")
    fixed = lambda c: X.repair(c, "dataset")
    evidence = F.transform(
        F.slice(F.coalesce("u.evidence", F.array().cast(EVIDENCE_TYPE)), 1, max_evidence),
        lambda e: F.struct(
            F.coalesce(e["evidence_id"], F.lit("")).alias("evidence_id"),
            F.coalesce(e["doc_id"], F.lit("")).alias("doc_id"),
            fixed(F.array_join(F.coalesce(e["heading_path"], none()), I.PATH_SEP)).alias("heading"),
            e["source"].alias("source"),
            F.try_element_at("u.evidence_marks", e["evidence_id"])["mark"].alias("mark"),
            fixed(X.clip(e["text"], evidence_chars, "prefix")).alias("text"),
        ),
    )
    return rows.select(
        F.concat_ws(":", "qid", F.coalesce("u.unit_id", F.col("pos").cast("string"))).alias("id"),
        F.lit("audit").alias("task_type"),
        F.struct(F.col("path").alias("log_path"), "qid", "final_answer", "token_usage").alias("source"),
        F.struct(
            *[F.col(f"u.{c}").alias(c) for c in ("kind", "option", "claim", "option_subject", "question_condition", "task")],
            *[F.coalesce(f"u.{c}", none()).alias(c) for c in ("target_doc_ids", "slots")],
            evidence.alias("evidence"),
            F.coalesce("u.notes", none()).alias("notes"),
        ).alias("input"),
        F.col("u.audit").alias("output"),
        F.struct(F.lit("weak_from_agent_log").alias("label"), F.lit(True).alias("needs_manual_review")).alias("quality"),
    )


def to_messages(samples: DataFrame, system: str) -> DataFrame:
    """K7: chat records of samples."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return samples.select(
        "id", "source",
        F.array(
            message("system", F.lit(system)), message("user", F.to_json("input", {"ignoreNullFields": "false"})),
            message("assistant", F.to_json("output", {"ignoreNullFields": "false"})),
        ).alias("messages"),
    )


def split_groups(df: DataFrame, key: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """K8: ``split`` per row; a rounded share of the keys, at least one, goes to ``val`` as a whole.

    Keys are ordered by a seeded hash. Whole hash buckets are taken first; only
    the bucket the border falls into is ranked, so no task sees all keys.
    """
    keys = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key")).distinct()
    digest = F.md5(F.concat(F.lit(f"{seed}:"), "_key").cast("binary"))
    keys = keys.select("_key", digest.alias("_digest"), F.substring(digest, 1, 3).alias("_bucket"))
    sizes = keys.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # at most 4096 buckets
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))
    quota = F.greatest(F.lit(1), F.bround(total * ratio)) - before
    border = sizes.select("_bucket", "_n", quota.cast("bigint").alias("_take")).filter("_take > 0")
    inside = keys.join(F.broadcast(border), "_bucket")
    full = inside.filter("_take >= _n").select("_key")
    part = inside.filter("_take < _n")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", "_key"))
    val = full.unionByName(part.withColumn("_rank", rank).filter("_rank <= _take").select("_key")).withColumn("split", F.lit("val"))
    return (
        df.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("")))
        .join(val, "_key", "left")
        .withColumn("split", F.coalesce("split", F.lit("train")))
        .drop("_key")
    )


# --- K9, H16, D28 ---------------------------------------------------------------------

# Options that only say right or wrong.
GENERIC_OPTIONS = ("正确", "错误", "对", "错", "是", "否", "正确。", "错误。")


def is_generic(options: Column) -> Column:
    values = F.array_distinct(F.transform(F.map_values(options), lambda v: X.squeeze(v)))
    return (F.size(values) > 0) & (F.size(values) <= 2) & F.forall(values, lambda v: v.isin(*GENERIC_OPTIONS))


def atomic_questions(questions: DataFrame) -> DataFrame:
    """K9: one row per option of ``questions(qid, question, type, answer_format, split, domain, options, doc_ids)``; plain questions stay whole."""
    form = E.answer_format(F.col("answer_format"), F.coalesce("type", F.lit("")))
    base = questions.select(
        F.col("qid").alias("source_qid"), F.col("split").alias("source_split"), "domain", F.coalesce("type", F.lit("")).alias("source_type"),
        form.alias("source_answer_format"), X.squeeze("question").alias("original_question"), "doc_ids",
        F.coalesce("options", F.create_map().cast("map<string,string>")).alias("options"),
    )
    base = base.withColumn("generic", is_generic(F.col("options")))
    entries = F.array_sort(F.map_entries("options"))
    split = (F.size("options") > 0) & ~F.col("generic")
    no_option = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    rows = base.select("*", F.explode(F.when(split, entries).otherwise(no_option)).alias("o"))
    option_text = X.squeeze("o.value")
    rows = rows.select("*", option_text.alias("option_text"), F.col("o.key").alias("option_label"))
    has = F.col("option_label").isNotNull()
    combined = F.concat_ws(" ", "original_question", "option_text")
    rows = rows.select("*", combined.alias("combined"), E.task_type(combined, F.col("source_type")).alias("task_type"))
    prefix = (
        F.when(F.col("task_type").isin("comparison", "rule_applicability"), "请核验并说明依据")
        .when(F.col("task_type") == "calculation", "请根据文档核验或计算").otherwise("请核验")
    )
    asked = F.concat(prefix, F.lit("：在“"), "original_question", F.lit("”这个问题背景下，选项"), "option_label", F.lit("的陈述是否成立："), "option_text")
    free = F.concat(
        F.when(F.col("task_type") == "calculation", "请根据企业文档计算并回答：")
        .when(F.col("task_type") == "ranking", "请根据企业文档完成排序并回答：").otherwise("请根据企业文档抽取或回答："),
        "original_question",
    )
    schema = (
        F.when(F.col("task_type") == "claim_verification", "supported|contradicted|insufficient")
        .when(F.col("task_type") == "rule_applicability", "applicable|not_applicable|insufficient")
        .when(F.col("task_type") == "calculation", "calculated_value")
        .when(F.col("task_type") == "ranking", "ordered_result").otherwise("extracted_value")
    )
    return rows.select(
        F.concat_ws("_", "source_qid", "option_label").alias("atomic_id"),
        "source_qid", "source_split", "domain", "source_type", "source_answer_format", "task_type",
        F.when(has, asked).otherwise(free).alias("question"),
        E.entities("combined").alias("entities"), E.metrics("combined").alias("metrics"), E.constraints("combined").alias("constraints"),
        schema.alias("expected_answer"),
        F.struct("original_question", "option_label", "option_text", F.col("doc_ids").alias("source_doc_ids")).alias("source_trace"),
        F.struct((F.size("options") > 0).alias("has_options"), F.size("options").alias("options_count"), "generic").alias("metadata"),
    )


def question_form(atomic: DataFrame) -> DataFrame:
    """Verification tasks become true/false questions, all others free ones."""
    check = E.is_verification(F.col("task_type"), F.col("question"))
    options = F.create_map(F.lit("A"), F.lit("支持/适用/成立"), F.lit("B"), F.lit("不支持/不适用/不成立或证据不足"))
    return atomic.select(
        "*",
        F.when(check, "判断题").otherwise("计算题").alias("form_type"),
        F.when(check, "tf").otherwise("free").alias("answer_format"),
        F.when(check, options).otherwise(F.create_map().cast("map<string,string>")).alias("options"),
    )


def option_rows(questions: DataFrame) -> DataFrame:
    """Rows to judge: one ``T`` row for true/false questions, else one per option in the given order."""
    tf = F.col("answer_format") == "tf"
    whole = F.array(F.struct(F.lit("T").alias("key"), F.col("question").alias("value")))
    entries = F.when(tf, whole).otherwise(F.map_entries("options"))
    return questions.select(
        "qid", "question", "answer_format", "doc_ids", F.posexplode(entries).alias("option_ord", "o")
    ).select(
        "qid", "option_ord", F.col("o.key").alias("option"), X.repair("o.value").alias("claim"), "answer_format", "doc_ids",
        F.lit("pending").alias("status"), F.lit(0).alias("round"),
    )
