"""The stored search index against scoring from pages, and quota rules against event-by-event walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from leafscan.operators import search as Q
from leafscan.operators import stored_index as T
from leafscan.streaming import quota as U

PAGES = "doc_id string, domain string, page_id string, page_no int, title string, heading_path array<string>, text string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 4))) for _ in range(60)]
    rows = []
    for d in range(40):
        for p in range(1, rng.randint(2, 9)):
            text = " ".join(rng.choices(words, k=rng.randint(0, 40)))
            rows.append((f"d{d}", f"x{d % 3}", f"d{d}_{p}", p, "t", ["h"], text))
    return spark.createDataFrame(rows, PAGES).withColumn("index_text", F.col("text")).persist(), words


@pytest.fixture(scope="module")
def asked(spark, pages):
    rng = random.Random(4)
    rows = [(f"q{i}", f"x{i % 4}", " ".join(rng.choices(pages[1], k=6)) + " unheard") for i in range(12)] + [("q99", "x0", ""), ("q98", None, pages[1][0])]
    return spark.createDataFrame(rows, "qid string, domain string, query string")


@pytest.fixture(scope="module")
def index(spark, pages, tmp_path_factory):
    return T.build_index(pages[0], str(tmp_path_factory.mktemp("index") / "one"))


def scores(df):
    return {(r["qid"], r["page_id"], r["domain"], r["doc_id"], r["page_no"]): round(r["score"], 9) for r in df.collect()}


def test_scores_equal_those_from_pages(spark, pages, asked, index):
    want = scores(Q.bm25(asked, pages[0]))
    assert want and scores(Q.bm25(asked, index)) == want
    allowed = spark.createDataFrame([(f"q{i}", f"d{j}") for i in range(12) for j in range(0, 40, 1 + i % 3)], "qid string, doc_id string")
    assert scores(Q.bm25(asked, index, allowed)) == scores(Q.bm25(asked, pages[0], allowed))
    top = lambda p: sorted(map(tuple, Q.search_pages(asked, p, k=3).collect()))
    assert top(index) == top(pages[0])


def test_a_batch_reads_only_its_partitions_and_exchanges_no_page(spark, asked, index):
    one = asked.filter("qid = 'q1'")
    plan = Q.search_pages(one, index)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(page_id" not in plan
    read = [line for line in plan.split("\n") if "FileScan" in line and "_postings" in line]
    assert read and all("PartitionFilters: [domain" in line.replace("isnotnull(domain#", "domain#") or "PartitionFilters" in line for line in read)
    scored = Q.bm25(one, index)
    assert "Bucketed: true" in scored._jdf.queryExecution().executedPlan().toString() or index.buckets == 1


def test_a_stored_index_is_opened_again(spark, asked, index):
    before = scores(Q.bm25(asked, index))
    for table in ("pages", "postings", "terms", "corpus"):
        spark.sql(f"DROP TABLE IF EXISTS {index.name}_{table}")
    again = T.open_index(spark, index.folder)
    assert (again.buckets, again.term_buckets) == (index.buckets, index.term_buckets)
    assert scores(Q.bm25(asked, again)) == before and again.pages.count() > 0


def test_an_index_is_built_once_per_key(spark, pages, asked):
    made = []

    def make():
        made.append(1)
        return pages[0].filter("domain = 'x1'")

    key = f"test-{random.random()}"
    first = T.index_for(spark, key, make)
    second = T.index_for(spark, key, make)
    assert made == [1] and first.folder == second.folder
    assert scores(Q.bm25(asked, second)) == scores(Q.bm25(asked, pages[0].filter("domain = 'x1'")))


def test_an_empty_index(spark, pages, asked, tmp_path):
    index = T.build_index(pages[0].filter("false"), str(tmp_path / "none"))
    assert Q.bm25(asked, index).count() == 0 and Q.search_pages(asked, index).count() == 0


# --- J14, J15 ----------------------------------------------------------------------------


def events_of(seed, user, seconds):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(700):
        t += rng.choice([0, 0, 0, 1, 2, 30, 200, 400]) if rng.random() < 0.98 else rng.choice([seconds - 1, seconds, seconds + 1, 5 * seconds])
        rows.append((user, t, i, rng.random() < 0.25))
    return rows


@pytest.mark.parametrize("limit", [1, 3, 20])
def test_quota_against_a_walk(spark, limit):
    rows = [r for u in range(4) for r in events_of(u, u, U.WINDOW_SECONDS)]
    want = {}
    for u in range(4):
        admitted = []
        for _, t, i, _ in sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2])):
            ok = sum(x >= t - U.WINDOW_SECONDS for x in admitted) < limit
            admitted += [t] * ok
            want[u, i] = ok
    events = spark.createDataFrame(rows, "user_id long, ts long, event_id long, ok boolean").repartition(5)
    assert {(r["user_id"], r["event_id"]): r["admitted"] for r in U.quota(events, limit).collect()} == want


def test_lockout_against_a_walk(spark):
    rows = [r for u in range(6) for r in events_of(10 + u, u, U.LOCK_SECONDS)]
    want = {}
    for u in range(6):
        failures, start = 0, 0
        for _, t, i, ok in sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2])):
            locked = failures >= U.LOCK_FAILURES and t - start < U.LOCK_SECONDS
            want[u, i] = locked
            if locked:
                continue
            if ok:
                failures, start = 0, 0
            elif not failures or t - start >= U.LOCK_SECONDS:
                failures, start = 1, t
            else:
                failures += 1
    events = spark.createDataFrame(rows, "username long, ts long, event_id long, ok boolean").repartition(5)
    got = {(r["username"], r["event_id"]): r["locked"] for r in U.lockout(events).collect()}
    assert got == want and any(want.values())


def test_empty_events(spark):
    events = spark.createDataFrame([], "user_id long, ts long, event_id long")
    assert U.quota(events).count() == 0
    assert U.lockout(events.withColumnRenamed("user_id", "username").withColumn("ok", F.lit(True))).count() == 0


def test_corpus_counts_pages_without_tokens(spark, tmp_path):
    """Lengths come from the postings: pages and whole domains without tokens still count, a null domain too."""
    from leafscan.operators.stored_index import build_index

    rows = [("a", "x", "p1", 1, "one two two"), ("a", "x", "p2", 2, "!!"), ("b", "y", "p3", 1, ""), (None, "z", "p4", 1, "one")]
    pages = spark.createDataFrame(rows, "domain string, doc_id string, page_id string, page_no long, index_text string")
    got = {r["domain"]: (r["n"], r["avgdl"]) for r in build_index(pages, str(tmp_path / "ix")).corpus.collect()}
    assert got == {"a": (2, 1.5), "b": (1, 0.0), None: (1, 1.0)}


def test_best_pages_are_those_of_all_scores(spark, pages, asked, index, monkeypatch):
    """bounds leave out no page that is among the best, whatever k is and however many are rare."""
    monkeypatch.setattr(Q, "PRUNE_PAIRS", -1)
    for k, share in ((1, 2), (3, 1), (5, 100)):
        monkeypatch.setattr(Q, "RARE_SHARE", share)
        want = Q.top_pages(Q.bm25(asked, pages[0]), k)
        got = Q.best_pages(asked, index, k)
        rows = lambda df: sorted((r.qid, r.page_id, r.doc_id, r.page_no, r["rank"], round(r.score, 6)) for r in df.collect())
        assert rows(got) == rows(want)
        sums = Q.contenders(asked, index, k, Q.measure(asked))
        assert set(map(tuple, Q.top_pages(sums, k).select("qid", "page_id").collect())) == {r[:2] for r in rows(want)}
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 0)
    assert rows(Q.best_pages(asked, index, k)) == rows(want)


def test_weak_terms_open_no_pair(spark, tmp_path, monkeypatch):
    """Pages that share only a frequent word with a query are no contenders: the pairs do not grow with the table."""
    rows = [(f"d{i}", "x", f"d{i}_1", 1, "t", ["h"], f"the the word{i} a{i % 40}") for i in range(2000)]
    some = spark.createDataFrame(rows, PAGES).withColumn("index_text", F.col("text"))
    held = T.build_index(some, str(tmp_path / "weak"))
    one = spark.createDataFrame([("q", "x", "the word7 word8 a7")], "qid string, domain string, query string")
    assert Q.bm25(one, held).count() == 2000
    assert Q.contenders(one, held, 2, Q.measure(one)).count() <= 60


def test_many_allowed_documents_leave_the_postings_where_they_lie(spark, asked, index, pages):
    """pairs beyond a broadcast meet the postings by page, in its bucket."""
    pairs = spark.createDataFrame([(f"q{i}", f"d{j}") for i in range(12) for j in range(0, 40, 1 + i % 3)], "qid string, doc_id string")
    few, many = Q.allowed_postings(index.postings, index, pairs), Q.allowed_postings(index.postings, index, pairs, 0)
    assert sorted(map(str, many.select(*few.columns).collect())) == sorted(map(str, few.collect()))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("_postings")[0] and "ShuffledHashJoin" in plan


def test_buckets_stay_small_as_the_text_grows(spark, pages, tmp_path, monkeypatch):
    """a bucket holds at most so much text as a task counts in memory."""
    assert T.BUCKET_CHARS <= 16 << 20
    chars = pages[0].agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(T, "BUCKET_CHARS", chars // 40)
    assert T.build_index(pages[0], str(tmp_path / "small")).buckets >= 40
