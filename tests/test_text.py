"""Cleaning, tokens and extraction on small texts worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import focus as C
from leafscan.functions import text as X
from leafscan.functions.containment import contains_join
from leafscan.operators import audit as A
from leafscan.operators import sections as S


def value(spark, column_of, text):
    return spark.createDataFrame([(text,)], "t string").select(column_of(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("BYD 2024 35.68%", ["byd", "2024", "35.68%"]),
        ("票面利率", ["票面利率", "票面", "面利", "利率", "票面利", "面利率"]),
        ("公司", ["公司"]),
        ("a公", ["a"]),
        ("", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert value(spark, X.tokenize, text) == tokens


def test_normalize_text(spark):
    raw = "a<!-- c -->\n\n\n<details><summary> S </summary>B</details>![i](u)"
    assert value(spark, X.normalize_text, raw) == "a\n\n[details: S]\nB"
    assert value(spark, X.normalize_text, "<details><summary></summary>only</details>") == "only"


def test_repair_variants(spark):
    good = "证券公司的报告信息发行债券"
    bad = good.encode("utf-8")[: len(good.encode("utf-8")) // 2 * 2].decode("gb18030", errors="ignore")
    assert value(spark, lambda c: X.repair(c, "index"), bad).startswith("证券公司的报告信息")
    assert value(spark, X.repair, "璇佸埜") == "璇佸埜"  # no marker: the gated form keeps it
    assert value(spark, lambda c: X.repair(c, "dataset"), "plain") == "plain"
    assert value(spark, X.repair, good) == good


def test_html_text(spark):
    page = '<p>Hi <b>x</b> y</p><table><tr><td>1</td><td>2</td></tr></table><script>var t="</p>";</script>&amp;'
    assert value(spark, X.html_text, page) == 'Hixy\n1 | 2\nvar t="</p>";&'
    assert value(spark, X.html_text, "no markup") == "no markup"


@pytest.mark.parametrize(
    "text, n, style, want",
    [("abcdefghij", 8, "ellipsis", "abcde..."), ("abcd fghij", 8, "ellipsis", "abcd..."), ("abc", 8, "ellipsis", "abc"),
     ("abcdefghij", 4, "suffix", "abcd..."), ("abcdefghij", 4, "prefix", "abcd"), ("abcdefgh", 8, "ellipsis", "abcdefgh")],
)
def test_clip(spark, text, n, style, want):
    assert value(spark, lambda c: X.clip(c, n, style), text) == want


def test_unique_compact(spark):
    arr = lambda c: X.unique_compact(F.split(c, ";"), 2)
    assert value(spark, arr, " a，;b;a;;c") == ["a", "b"]


def test_table_headers(spark):
    assert value(spark, E.table_headers, "x\n| a | b |--|\n|-|-|-|") == ["a", "b"]
    assert value(spark, E.table_headers, "none") == []


def test_entities(spark):
    got = value(spark, E.entities, "在光通信、养殖和造船领域，甲乙公司是否增长")
    assert got[0] == "甲乙公司" or "光通信" in got
    assert "养殖" in got and "造船" in got


@pytest.mark.parametrize(
    "text, want",
    [("2024年3月5日", (2024, 3, 5)), ("二〇二四年十二月", (2024, 12, None)), ("二〇二三年二月二十一日", (2023, 2, 21)), ("无日期", None)],
)
def test_parse_date(spark, text, want):
    got = value(spark, A.parse_date, text)
    assert (tuple(got) if got else None) == want


def test_reason_parts(spark):
    claim = "产能集中在华东，因为该地区需求旺盛且成本下降，市场扩大"
    assert value(spark, A.reason_parts, claim) == ["华东需求旺盛", "华东成本下降", "市场扩大"]


def test_open_anchor(spark):
    assert value(spark, S.is_open_anchor, "赔付金额按照以下公式：")
    assert not value(spark, S.is_open_anchor, "比例为 20%。")
    assert not value(spark, S.is_open_anchor, "如下：<table>")


def test_claim_parts(spark):
    assert value(spark, C.claim_parts, "甲，；乙。\n") == ["甲", "乙"]
    assert value(spark, C.claim_parts, "；") == ["；"]


def test_subsplit_reassembles_windows(spark):
    text = "".join(f"第{i}句。" for i in range(600))
    parts = value(spark, lambda c: C.subsplit(c, 1500, 760), text)
    assert all(len(p) <= 760 for p in parts)
    joined = parts[0]
    for p in parts[1:]:
        joined += p[760 - 380 :]
    assert joined == text
    assert value(spark, lambda c: C.subsplit(c, 1500, 760), "short") == []


def test_focus_table(spark):
    rows = [f"| {1990 + i} | {i} |" for i in range(20)]
    table = "\n".join(["标题", "| 年 | 值 |", "|---|---|", *rows])
    got = value(spark, lambda c: C.focus(c, F.lit("1995年的值"), 400), table)
    assert got == "\n".join(["标题", "| 年 | 值 |", "|---|---|", rows[4], rows[5], rows[6]])


def test_inner_split_offsets(spark):
    body = "前文。" * 100
    text = body + " 图1：甲乙丙" + "数据" * 400 + " 表2：丁" + "行" * 300
    spans = value(spark, lambda c: C.inner_split(c, F.lit("数据")), text)
    assert len(spans) >= 2
    assert all(0 <= s["start"] <= s["end"] <= len(text) for s in spans)


def test_contains_join(spark):
    texts = spark.createDataFrame([("a", "x", "banana bandana"), ("b", "x", "aaaa"), ("c", "y", "ana")], "k string, g string, t string")
    terms = spark.createDataFrame([("x", "ana"), ("x", "aa"), ("x", "zz"), ("y", "an"), ("x", "")], "g string, term string")
    got = {(r["k"], r["term"]): r["hits"] for r in contains_join(texts, terms, ["k"], "t", ["g"]).collect()}
    assert got == {("a", "ana"): 2, ("b", "aa"): 2, ("c", "an"): 1}
    free = {(r["k"], r["term"]): r["hits"] for r in contains_join(texts, terms.drop("g"), ["k"], "t", []).collect()}
    assert free == {("a", "ana"): 2, ("b", "aa"): 2, ("a", "an"): 4, ("c", "an"): 1, ("c", "ana"): 1}
    assert contains_join(texts, terms.limit(0), ["k"], "t", ["g"]).count() == 0


def test_idf_of_a_single_page(spark):
    from leafscan.operators.index import idf

    assert math.isclose(spark.range(1).select(idf(F.lit(1), F.lit(1)).alias("v")).first()["v"], math.log(1 + 0.5 / 1.5))


def test_unescape_reads_all_references(spark):
    import html

    for text in ("caf&eacute; &#8212; A&#x41; &ge; &euro;5", "&amp;lt; &copy 2020 &notit; &unknown; & && &#0; &#128; &#xD800; &#1F600;", "&AElig &AEligx; &hearts;&"):
        assert value(spark, X.unescape, text) == html.unescape(text)


def test_invalid_bytes_go_and_replacement_characters_stay(spark):
    raw = [b"a\xef\xbf\xbdb", b"a\xffb\xe4\xb8", "é漢".encode()]
    got = spark.createDataFrame([(x,) for x in raw], "c binary").select(X.without_invalid(F.col("c").cast("string")).alias("t")).collect()
    assert [r["t"] for r in got] == [x.decode(errors="ignore") for x in raw]


def test_contains_join_over_lengths_and_pieces(spark):
    """Terms of every piece length, in texts longer than a piece; a term with a substring no text holds is never looked up."""
    words = ["q", "qz", "qzx", "qzxw", "qzxwv", "qzxwvut", "qzxwvuts", "qzxwvutsr", "qzxwvutsrabcdefgh", "abababab", "nowhere", "额qz", "余额"]
    rows = [("a", "ab" * 300 + "qzxwvutsrabcdefgh" + "ab" * 300), ("b", "余额qzx" * 70), ("c", ""), ("d", None), ("e", "qzxwvut"), ("f", "x" * 255 + "qzxwvuts")]
    texts, terms = spark.createDataFrame(rows, "k string, t string"), spark.createDataFrame([(w,) for w in words], "term string")
    got = {(r["k"], r["term"]): r["hits"] for r in contains_join(texts, terms, ["k"], "t", []).collect()}
    assert got == {(k, w): t.count(w) for k, t in rows if t for w in words if w in t}
    assert grams_of(spark, "abc" * 200, 8) == {("abc" * 200)[i : i + 8] for i in range(593)}


def grams_of(spark, text, n):
    from leafscan.functions.containment import grams

    return set(value(spark, lambda c: grams(c, F.array(F.lit(n))), text))


def test_unhinted_sides_are_broadcast_by_measured_size(spark, tmp_path):
    """A side that explodes is far larger than its file; only what a shuffle measured may reach the driver."""
    from leafscan.plans import registry
    from leafscan.session import configure

    limit = "spark.sql.autoBroadcastJoinThreshold"
    configure(spark)
    assert spark.conf.get(limit) == "10MB"
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    registry.queries()["b3_compact_text"](spark, str(tmp_path))
    try:
        assert spark.conf.get(limit) == "-1"
        few = spark.range(500).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("n"))
        plan = spark.range(2_000_000).select(F.col("id").alias("k")).join(few, "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan
    finally:
        configure(spark)
    assert spark.conf.get(limit) == "10MB"


def test_fast_white_space_rules_agree_with_the_class(spark):
    """Trimming by characters, squeezing by rare runs and gated term lists give what the plain patterns give, at every code point."""
    from leafscan.functions import extract as E

    points = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    texts = [f"{c}a{c}{c}b {c} c{c}" for c in points] + ["", " ", "\n ", "5　%", "三分之二", "第3条", "2020年5月1日 40万元", "12 %", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain_strip = F.regexp_replace("t", f"^[{X.WS}]+|[{X.WS}]+$", "")
    runs = F.regexp_replace("t", f"[{X.WS}]+", " ")
    rows = df.select(
        "t", X.strip("t").alias("strip"), plain_strip.alias("strip0"), X.squeeze("t").alias("squeeze"),
        F.regexp_replace(runs, f"^[{X.WS}]+|[{X.WS}]+$", "").alias("squeeze0"),
        E.page_terms("t")["numbers"].alias("numbers"), F.array_sort(F.array_distinct(E.find_all("t", E.NUMBER))).alias("numbers0"),
        E.page_terms("t")["dates"].alias("dates"), F.array_sort(F.array_distinct(E.find_all("t", E.DATE))).alias("dates0"),
    ).collect()
    for r in rows:
        assert (r.strip, r.squeeze, r.numbers, r.dates) == (r.strip0, r.squeeze0, r.numbers0, r.dates0), ascii(r.t)


def test_normalising_keeps_its_rules_behind_their_gates(spark):
    text = "﻿a <!-- x\ny --> b \t\r\nc d　\n\n\n\ne ![i](u) f\n<DETAILS> <summary> s </summary> z </details>"
    got = spark.createDataFrame([(text,)], "t string").select(X.normalize_text("t").alias("n")).first().n
    assert got == "a  b\nc\nd\n\ne  f\n\n[details: s]\nz"
