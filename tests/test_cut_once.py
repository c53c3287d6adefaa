"""Texts are cut into tokens once per search, and what a query asks for is found before it meets its texts."""

from __future__ import annotations

from leafscan.operators import evidence as V
from leafscan.operators import search as Q
from leafscan.operators import sections as S


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_words_are_picked_while_pages_are_cut(spark, monkeypatch):
    rows = [("m", "d1", "p1", 1, "alpha beta beta 违约金比例"), ("m", "d1", "p2", 2, "beta"), ("m", "d2", "p3", 1, "alpha gamma"), ("m", "d2", "p4", 2, None)]
    rows += [("m", "d1", "p1", 1, "alpha beta beta 违约金比例"), ("m", "d2", "p3", 1, "alpha"), (None, "d3", "p5", 1, "alpha"), ("n", None, "p6", 1, "alpha"), ("n", "d4", None, 1, "alpha")]
    pages = spark.createDataFrame(rows, "domain string, doc_id string, page_id string, page_no int, index_text string")
    asked = spark.createDataFrame([("q1", "m", "alpha beta 违约金"), ("q2", "m", "gamma alpha alpha"), ("q3", "n", "alpha")], "qid string, domain string, query string")
    allowed = spark.createDataFrame([("q1", "d1"), ("q1", "d2"), ("q2", "d2"), ("q3", "d4")], "qid string, doc_id string")
    found = lambda df: sorted((tuple(r[c] for c in ("qid", "doc_id", "page_id", "page_no")) + (round(r["score"], 9),) for r in df.collect()), key=str)
    for some in (None, allowed):
        got = Q.bm25(asked, pages, some)
        assert "index_text" not in optimized(got)  # counts, lengths and postings read what was cut
        with monkeypatch.context() as patch:
            patch.setattr(Q, "NAMED_TERMS", 0)
            want = Q.bm25(asked, pages, some)
            assert "index_text" in optimized(want) and found(got) == found(want) and len(found(got)) >= 3


def test_slots_are_cut_before_they_meet_their_evidence(spark):
    texts = ["违约金比例为3%，研发 投入", "违约", "净资产", None, "违约金比例为3%，研发 投入", "1995年违约金 ab"]
    evidence = spark.createDataFrame(
        [("q", i, f"e{i}", ["合同"], t, 1.0) for i, t in enumerate(texts)] + [("q2", 1, "e9", None, "违约金", None), ("q3", 1, "e8", ["h"], "违约金", 0.0)],
        "qid string, ord int, evidence_id string, heading_path array<string>, text string, score double",
    )
    slots = spark.createDataFrame(
        [("q", "s", "1995年违约金比例3%", ["违约金", "研发 投入", None, "ab"]), ("q2", "违约金", None, None), ("q3", None, "", [])],
        "qid string, slot string, query string, key_terms array<string>",
    )
    found = V.rerank_slot(evidence, slots)
    scores = {r["evidence_id"]: round(r["slot_score"], 3) for r in found.collect()}
    assert scores == {'e5': 23.4, 'e0': 21.4, 'e4': 21.4, 'e1': -3.5, 'e2': -5.0, 'e3': -5.0, 'e9': 5.2, 'e8': 0.0}
    assert [r["evidence_id"] for r in V.rerank_slot(evidence, slots, 1).orderBy("qid").collect()] == ['e5', 'e9', 'e8']
    lines = optimized(found).splitlines()
    joined = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    assert any("_terms" in line and "regexp_extract_all" in line for line in lines[joined:])


def test_hints_get_the_texts_of_pages_at_the_end(spark, monkeypatch):
    sections = spark.createDataFrame([("d", "s1", 1, "Alpha", ["Alpha"], "")], "doc_id string, section_id string, toc_no int, title string, heading_path array<string>, preview string")
    rows = [("m", "d", f"p{i}", i, "99", ["Alpha"] if i < 3 else ["Other"], f"alpha words of a page that is long enough {i}") for i in range(1, 6)]
    rows += [rows[4], ("m", "d", None, 9, "99", ["Other"], None), ("m", "e", "p3", 3, "99", ["Else"], "other page of the same name")]
    pages = spark.createDataFrame(rows, "domain string, doc_id string, page_id string, page_no int, title string, heading_path array<string>, text string")
    pages = pages.withColumn("index_text", pages["text"])
    bridge = spark.createDataFrame([("s1", "d", "p1", 1), ("s1", "d", "p2", 2)], "section_id string, doc_id string, page_id string, page_no int")
    hints = spark.createDataFrame([("q1", "m", "d", "Other", ""), ("q2", "m", "d", "Alpha", "words"), ("q3", "m", "e", "zzqq", "page name")], "qid string, domain string, doc_id string, hint string, query string")
    kept, real = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: kept.append(real(df)) or kept[-1])
    found = {(r["qid"], r["page_id"], r["tier"]): (r["heading_path"], r["text"]) for r in S.hint_search(hints, sections, bridge, pages, 5).collect()}
    ranked = [df for df in kept if "tier" in df.columns][0]
    assert ranked.filter("tier = 2").count() >= 5 and ranked.filter("tier = 2 AND text IS NOT NULL").count() == 0
    assert found[("q1", "p5", 2)] == (["Other"], rows[4][6]) and found[("q1", None, 2)] == (["Other"], None)
    assert found[("q2", "p1", 1)] == (["Alpha"], rows[0][6]) and found[("q2", "p3", 2)] == (["Other"], rows[2][6])
    assert found[("q3", "p3", 3)] == (["Else"], "other page of the same name")
