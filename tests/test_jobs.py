"""Index, search, routing, audit, memory and quota jobs on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from leafscan.functions import text as X
from leafscan.operators import audit as A
from leafscan.operators import evaluate as V
from leafscan.operators import evidence as EV
from leafscan.operators import finance as N
from leafscan.operators import index as I
from leafscan.operators import memory as M
from leafscan.operators import routing as R
from leafscan.operators import search as Q
from leafscan.operators import segment as S
from leafscan.sources import corpus as SRC
from leafscan.sources import publish as P
from leafscan.streaming import quota as U
from leafscan.streaming.memory import memory_stream

BOND = "# 晨曦绿色债券\n\n本期绿色债券票面利率为 3.2%。"
EXTRA = "# 晨曦债券增补\n\n补充发行规模为五亿元。"


def build(spark, folder):
    docs = SRC.corpus_documents(SRC.read_corpus(spark, folder), "solar_bonds").withColumn("mode", F.lit("heading"))
    rows = S.split_corpus(docs)
    toc = S.toc_of(rows)
    named = I.doc_identity(docs, toc).drop("domain").withColumn("domain", F.lit("solar_bonds"))
    blocks = S.blocks_of(rows).drop("title", "domain", "source_path", "mode").join(named.select("doc_id", "domain", "title", "source_path", "mode"), "doc_id")
    pages = S.make_pages(blocks)
    documents = I.documents_idx(named, pages)
    return {"documents": documents, "toc": toc, "pages": pages, "doc_catalog": I.doc_catalog(documents, toc, pages)}


@pytest.fixture(scope="module")
def bonds(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw_md") / "raw_md" / "solar_bonds"
    root.mkdir(parents=True)
    (root / "bond.md").write_text(BOND, encoding="utf-8")
    (root / "extra.md").write_text(EXTRA, encoding="utf-8")
    return build(spark, str(root))


def ask(spark, text, domain="solar_bonds"):
    return spark.createDataFrame([("q", domain, text)], "qid string, domain string, query string")


def test_bond_search(spark, bonds):
    for text, doc in (("票面利率", "bond"), ("发行规模", "extra")):
        top = Q.search_docs(ask(spark, text), bonds["pages"], bonds["doc_catalog"]).orderBy("rank").first()
        assert top["doc_id"] == doc
        assert Q.search_pages(ask(spark, text), bonds["pages"]).orderBy("rank").first()["doc_id"] == doc


def test_catalog_route_finds_the_domain(spark, bonds):
    hits = R.catalog_search(ask(spark, "晨曦绿色债券票面利率").select("qid", "query"), I.catalog_profile(bonds["doc_catalog"]))
    assert hits.orderBy("rank").first()["domain"] == "solar_bonds"


def test_failed_build_keeps_the_live_one(spark, bonds, tmp_path):
    folder, registry = str(tmp_path / "builds"), str(tmp_path / "registry")
    P.publish_index(spark, "solar_bonds", bonds, folder, "b1", "2024-01-01", registry)
    bad = {**bonds, "documents": bonds["documents"].unionByName(bonds["documents"])}
    with pytest.raises(P.PublishError):
        P.publish_index(spark, "solar_bonds", bad, folder, "b2", "2024-01-02", registry)
    assert P.live_builds(spark, registry).first()["build_id"] == "b1"
    assert P.read_live(spark, registry, "solar_bonds", "pages").count() == 2


def test_read_corpus_order_and_files(spark, tmp_path):
    for name in ("b.txt", "a.md", "c.md"):
        (tmp_path / name).write_bytes("﻿x\xff".encode("latin-1", "ignore") or b"x")
    names = [r["path"].rsplit("/", 1)[-1] for r in SRC.read_corpus(spark, str(tmp_path), 2).collect()]
    assert names == ["a.md", "c.md"]
    (tmp_path / "a.txt").write_text("y")
    files = SRC.domain_files(spark, str(tmp_path), "d")
    assert [(r["doc_id"], r["n"]) for r in SRC.duplicate_doc_ids(files).collect()] == [("a", 2)]
    assert SRC.quota_use(files, 3).first()["within"] is False


def test_read_jsonl_modes(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('﻿{"a": 1}\n\n{bad\n{"a": 2}\n', encoding="utf-8")
    assert [r["a"] for r in SRC.read_jsonl(spark, str(path), "a int", "skip").orderBy("a").collect()] == [1, 2]
    with pytest.raises(Exception):
        SRC.read_jsonl(spark, str(path), "a int").collect()


@pytest.mark.parametrize("text, n", [('[{"q": 1}, {"q": 2}]', 2), ('{"questions": [{"q": 1}]}', 1), ('{"q": 5}', 1)])
def test_read_records(spark, tmp_path, text, n):
    path = tmp_path / "r.json"
    path.write_text(text)
    assert SRC.read_records(spark, str(path)).select("q").count() == n


def test_finance(spark):
    rows = [
        ("bond_interest", {"principal": "10000", "rate": "0.015", "days": "120"}, None),
        ("deductible_claim", {"expense": "5000", "deductible": "10000"}, None),
        ("yoy_reverse", {"current": "542", "growth_rate": "0.3568"}, None),
        ("ratio", {"numerator": "1", "denominator": "0"}, None),
        ("nope", {}, None),
        ("difference", {"a": "x", "b": "1"}, None),
        ("sum", {}, []),
    ]
    calls = spark.createDataFrame(rows, "operation string, params map<string,string>, values array<string>")
    got = {r["operation"]: r for r in N.calculate(calls).collect()}
    assert math.isclose(got["bond_interest"]["result"], 49.31506849315)
    assert got["deductible_claim"]["result"] == 0 and got["sum"]["result"] == 0
    assert math.isclose(got["yoy_reverse"]["result"], 399.46933962264)
    assert all(got[k]["result"] is None and got[k]["error"] for k in ("ratio", "nope", "difference"))


def test_quota_counts_admitted_events_only(spark):
    events = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 10, 3600, 3601, 3601])], "user_id long, ts long, event_id long")
    got = {r["event_id"]: r["admitted"] for r in U.quota(events, 1).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False}


def test_lockout(spark):
    times = [(0, False), (1, False), (2, False), (3, False), (4, False), (5, True), (899, True), (900, True), (901, False)]
    events = spark.createDataFrame([("u", t, i, ok) for i, (t, ok) in enumerate(times)], "username string, ts long, event_id long, ok boolean")
    got = [r["locked"] for r in U.lockout(events).orderBy("event_id").collect()]
    assert got == [False] * 5 + [True, True, False, False]


def stream(spark, df, folder):
    df.coalesce(1).write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def run(df, spark, tmp_path, name, mode="append"):
    out = str(tmp_path / f"{name}-out")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-ckpt")).trigger(availableNow=True)
    query = writer.format("memory").queryName(name).start() if mode != "append" else writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.table(name) if mode != "append" else spark.read.parquet(out)


def test_quota_stream_agrees_with_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select((F.col("user_id") % 3).alias("user_id"), F.col("ts").cast("timestamp").alias("event_time"), "event_id")
    batch = U.quota(events.select("user_id", F.unix_timestamp("event_time").alias("ts"), "event_id"), 1)
    live = run(U.quota_stream(stream(spark, events, str(tmp_path / "ev")), 1), spark, tmp_path, "quota")
    rows = lambda df: sorted((r["user_id"], r["event_id"], r["admitted"]) for r in df.collect())
    assert rows(live) == rows(batch)


def test_lockout_stream_agrees_with_batch(spark, tmp_path):
    ok = ~F.col("event_type").isin("error", "view", "click")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        (F.col("user_id") % 2).alias("username"), F.col("ts").cast("timestamp").alias("event_time"), "event_id", ok.alias("ok")
    )
    batch = U.lockout(events.select("username", F.unix_timestamp("event_time").alias("ts"), "event_id", "ok"))
    live = run(U.lockout_stream(stream(spark, events, str(tmp_path / "ev"))), spark, tmp_path, "lockout")
    rows = lambda df: sorted((r["username"], r["event_id"], r["locked"]) for r in df.collect())
    assert rows(live) == rows(batch)


NOTE = "session_id string, evidence_id string, subject string, slot string, doc_id string, evidence_summary string, evidence_status string, source_turn int, last_used_at string"


def test_memory_stream_matches_upsert(spark, tmp_path):
    notes = spark.createDataFrame([("s", "e", "a", "b", "d1", "n1", "useful", 1, "t1"), ("s", "e", "a", "b", "d2", "n2", "partial", 2, "t2"), ("s", "f", "a", "b", "d1", "n", "useful", 2, "t2")], NOTE)
    live = run(memory_stream(stream(spark, notes, str(tmp_path / "notes"))), spark, tmp_path, "notes", "complete")
    empty = notes.filter("false").withColumn("use_count", F.lit(1)).withColumn("created_at", F.lit(""))
    want = M.upsert_memory(empty, notes)
    rows = lambda df: sorted((r["evidence_id"], r["doc_id"], r["use_count"], r["source_turn"]) for r in df.collect())
    assert rows(live) == rows(want) == [("e", "d2", 2, 2), ("f", "d1", 1, 2)]


def test_summary_stops_changing(spark):
    rows = [("s", i, "q" * 150 + str(i), "a" * 400, "dom", ["d"]) for i in range(1, 41)]
    turns = spark.createDataFrame(rows, "session_id string, turn_index int, user_query string, assistant_answer string, domain string, doc_ids array<string>")
    text = ""
    for b in range(10):
        lines = [
            f"Turn {i}: query={r[2] if len(r[2]) <= 160 else r[2][:157].rstrip() + '...'}; domain=dom; docs=d; answer={r[3][:357]}..."
            for i, r in ((k, rows[k - 1]) for k in range(4 * b + 1, 4 * b + 5))
        ]
        text = " ".join([*([text] if text else []), *lines])
        text = text if len(text) <= 2500 else text[:2497].rstrip() + "..."
    assert M.summaries(turns).first()["global_summary"] == text


def test_scoring_rules(spark):
    cases = spark.createDataFrame(
        [("two", "d", "multi", ["k"], ["a", "b"], ["z"]), ("none", "d", "insufficient_evidence", ["证据不足"], [], ["z"]), ("open", "d", "fact", ["k"], [], ["z"])],
        "id string, domain string, task_type string, expected_answer_keywords array<string>, expected_doc_ids array<string>, expected_evidence_keywords array<string>",
    )
    replies = spark.createDataFrame(
        [("two", "k", "", ["a"], 1.0), ("none", "证据不足", "", [], 2.0), ("open", "k", "", ["a"], 3.0)],
        "id string, answer string, reason string, doc_ids array<string>, elapsed_seconds double",
    ).withColumn("evidence", F.array().cast("array<struct<doc_id:string,heading:string,quote:string>>"))
    got = {r["id"]: r for r in V.score_cases(cases, replies).collect()}
    assert got["two"]["doc_hit"] and not got["two"]["multi_doc_coverage"] and not got["two"]["passed"]
    assert got["none"]["passed"] and not got["open"]["doc_hit"] and not got["open"]["passed"]


REPLY = "qid string, option string, option_ord int, answer_format string, verdict boolean, answer string, confidence double, reason string, status string"


def test_answers(spark):
    rows = [
        ("m", "A", 0, "multi", True, "x", 0.5, "", "done"), ("m", "B", 1, "multi", False, "x", 0.5, "", "done"), ("m", "C", 2, "multi", True, "x", 0.5, "", "done"),
        ("s", "A", 0, "mcq", True, "x", 0.6, "", "done"), ("s", "B", 1, "mcq", True, "x", 0.9, "", "done"), ("t", "T", 0, "tf", None, "x", 0.6, "", "done"),
    ]
    judged = spark.createDataFrame(rows, REPLY)
    got = {r["qid"]: r["final_answer"] for r in A.final_answers(judged).collect()}
    assert got == {"m": "AC", "s": "B", "t": ""}


def test_empty_answer_counts_as_another_letter(spark):
    rows = [("e", "A", 0, "multi", True, "", 0.9, "", "done"), ("t", "T", 0, "tf", True, "", 0.9, "", "done"), ("g", "A", 0, "multi", True, "A", 0.9, "", "done")]
    missing = spark.createDataFrame([("g", "A")], "qid string, option string")
    got = {r["qid"]: r for r in A.judgments(spark.createDataFrame(rows, REPLY), missing).collect()}
    assert got["e"]["verdict"] is False and got["t"]["verdict"] is True
    assert got["g"]["verdict"] is False and got["g"]["confidence"] == 0.5 and got["g"]["answer"] == ""


def test_doc_hints_by_hand(spark):
    claims = spark.createDataFrame([("q", "d", "比亚迪公司年报")], "qid string, doc_id string, claim string")
    profiles = spark.createDataFrame([("d", "m", "比亚迪公司年报 2024")], "doc_id string, domain string, profile string")
    row = R.doc_hints(claims, profiles).first()
    # 7-character run: itself (2.5) and its 11 n-grams of two and three (1 each) are the twelve kept tokens;
    # the run as a phrase 3.5; three longest n-grams 7/1.5 + 2 * 6/1.5
    assert math.isclose(row["score"], 2.5 + 11 + 3.5 + 7 / 1.5 + 2 * 6 / 1.5)


def test_reroute_skips_current_and_tried(spark):
    missing = spark.createDataFrame([("q", "alpha beta gamma"), ("r", "alpha beta gamma")], "qid string, query string")
    profiles = spark.createDataFrame([("a", "alpha beta gamma"), ("b", "alpha beta gamma delta"), ("c", "other")], "doc_id string, profile string")
    current = spark.createDataFrame([("q", "a"), ("r", "a")], "qid string, doc_id string")
    tried = missing.filter("qid = 'r'").select("qid", X.stable_id(F.col("query"), 12).alias("query_key"))
    got = R.reroute(missing, profiles, current, tried).collect()
    assert {r["qid"] for r in got} <= {"q"} and all(r["doc_id"] == "b" for r in got)


def test_merge_evidence_is_idempotent(spark):
    ev = spark.createDataFrame([("q", "e1", 1), ("q", "e2", 2), ("q", "e1", 3)], "qid string, evidence_id string, ord int")
    once = EV.merge_evidence(ev, ev)
    twice = EV.merge_evidence(once, ev)
    rows = lambda df: [(r["evidence_id"], r["ord"]) for r in df.orderBy("ord").collect()]
    assert rows(once) == rows(twice) == [("e1", 1), ("e2", 2)]


def test_computed_ratio(spark):
    queries = spark.createDataFrame([("q", "研发投入占营业收入的比例")], "qid string, query string")
    text = "2024年营业收入为 1,000.5亿元，同比增长5%；研发投入 200百万元。"
    ev = spark.createDataFrame([("q", 1, "e", "d", text)], "qid string, ord int, evidence_id string, doc_id string, text string")
    row = EV.computed_ratio(queries, ev).first()
    assert math.isclose(row["ratio"], 200e6 / 1000.5e8 * 100) and "= 0.20%" in row["text"]


def test_followup_keeps_slots_apart(spark):
    pages = spark.createDataFrame(
        [("d1", "x", "d1_lp_0001", 1, ["h"], "违约金比例为 3% 按日计收"), ("d1", "x", "d1_lp_0002", 2, ["h"], "账期 30 天 到期付款")],
        "doc_id string, domain string, page_id string, page_no int, heading_path array<string>, text string",
    ).withColumn("index_text", F.col("text")).withColumn("title", F.lit("t"))
    missing = spark.createDataFrame(
        [("q", "x", "违约金", "违约金比例", ["违约金"]), ("q", "x", "账期", "账期 天", ["账期"])],
        "qid string, domain string, slot string, query string, key_terms array<string>",
    )
    docs = spark.createDataFrame([("q", "d1")], "qid string, doc_id string")
    rows = EV.followup_round(missing, docs, pages).collect()
    best = {r["slot"]: r["evidence_id"] for r in rows if r["rank"] == 1}
    assert best == {"违约金": "d1_lp_0001", "账期": "d1_lp_0002"}
    assert len({(r["slot"], r["evidence_id"]) for r in rows}) == len(rows)


def test_summary_reads_turns_after_gaps(spark):
    turns = spark.createDataFrame(
        [("s", 1000 * i + 4, "q%d" % i, "x", ["d"], "a") for i in range(40)],
        "session_id string, turn_index int, user_query string, domain string, doc_ids array<string>, assistant_answer string",
    )
    text = M.summaries(turns).first()["global_summary"]
    assert "q0;" in text and "q30;" in text and len(text) <= M.MAX_SUMMARY_CHARS


def test_headings_have_no_cap(spark):
    pages = spark.createDataFrame(
        [("d", f"p{i}", i, [f"h{i:03d}"] if i else []) for i in range(200)], "doc_id string, page_id string, page_no int, heading_path array<string>"
    )
    assert I.pages_by_heading(pages).count() == 199
    listed = I.listed_headings(pages, 80).orderBy("key_no").collect()
    assert len(listed) == 80 and listed[0]["heading"] == "h001"


def test_rules_over_note_texts_stay_behind_the_join(spark, tmp_path):
    """a filter on a note's text runs on dealt rows, not on the splits of the orders' file."""
    from leafscan.plans.evaluate import order_pages

    spark.createDataFrame([(k, k % 3, "O", 10.5, "1-URGENT") for k in range(6)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").withColumn(
        "o_orderdate", F.to_date(F.lit("1995-01-02"))
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, f"n{c}", "X") for c in range(3)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    some = order_pages(spark, str(tmp_path)).filter(F.col("text").rlike("违约金比例"))
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "违约金比例)" in above and "违约金比例)" not in below
    assert some.count() == 6
