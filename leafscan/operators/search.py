"""Batch search over pages and documents (F2-F8, G4 helper)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions import text as X
from leafscan.functions.containment import contains_join
from leafscan.operators import index as I
from leafscan.operators.stored_index import StoredIndex
from leafscan.session import BROADCAST_ROWS, Batch, cut_lineage, measure, small

MAX_QUERY_TF = 3
NAMED_TERMS = 1000  # of a batch; as many are looked for in the tokens of a page before any is a row
PRUNE_PAIRS = 5_000_000  # of queries and pages; beyond it the best pages are found without scoring every pair
RARE_SHARE = 100  # a term is rare if at most one page in so many holds it
TOLERANCE = 1e-3  # of score bounds: far above what the order of a sum or the ranked decimals change
RANK_DIGITS = 6  # scores are ranked at this precision, so sums in any order rank alike


def rank_by(partition: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def by_score(score: str = "score") -> Column:
    return F.desc(F.round(score, RANK_DIGITS))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of ``queries(qid, domain, query)`` with frequency and first position."""
    return (
        queries.select("qid", "domain", F.posexplode(X.tokenize("query")).alias("pos", "term"))
        .groupBy("qid", "domain", "term")
        .agg(F.least(F.count("*"), F.lit(MAX_QUERY_TF)).alias("qtf"), F.min("pos").alias("pos"))
    )


def bm25(
    queries: DataFrame, pages: DataFrame | StoredIndex, allowed: DataFrame | None = None, text: str = "index_text", batch: Batch | None = None
) -> DataFrame:
    """F2: scores of all pages sharing a term with a query of their domain.

    Statistics cover the whole domain even under a document filter
    ``allowed(qid, doc_id)``. A stored index is read only where it holds terms
    of the batch, and nothing of it is exchanged. Pages without one are
    shuffled once, by page; the query side is joined to them where they lie.
    """
    if isinstance(pages, StoredIndex):
        return stored_bm25(queries, pages, allowed)
    if batch is None:
        # with a document filter every (query, document) pair brings the query's terms
        pairs = queries if allowed is None else allowed.select("qid", "doc_id").distinct().join(queries.select("qid", "query"), "qid")
        batch = measure(pairs)
    keys = ["domain", "doc_id", "page_id", "page_no"]
    terms = query_terms(queries)
    # many queries may share few terms, so the terms themselves are counted
    vocabulary = terms.select("domain", "term").distinct()
    few = vocabulary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if allowed is not None and not few:
        return allowed_bm25(queries, pages, allowed, text, batch)
    tokens = I.page_tokens(pages, text, tuple(keys)).select(*keys, F.size("tokens").alias("dl"), "tokens")
    words = [r[0] for r in vocabulary.select("term").distinct().limit(NAMED_TERMS + 1).collect()] if few else []
    vocabulary = F.broadcast(vocabulary) if few else vocabulary
    if few and len(words) <= NAMED_TERMS:
        # few words are picked where a page is cut: lengths, counts and postings read a row per page, and no text is cut again
        picked = tokens.withColumn("tokens", F.filter("tokens", lambda t: t.isin(words)))
        picked = cut_lineage(picked.groupBy(*keys, "dl").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.count("*").alias("rows")))
        times = lambda t: F.struct(t.alias("term"), F.size(F.filter("tokens", lambda x: x == t)).cast("long").alias("tf"))
        postings = picked.select(*keys, "dl", F.explode(F.transform(F.array_distinct("tokens"), times)).alias("_t")).select(*keys, "dl", "_t.term", "_t.tf")
        postings = postings.join(vocabulary, ["domain", "term"], "left_semi")
        corpus = picked.groupBy("domain").agg(F.sum("rows").alias("n"), (F.sum(F.col("rows") * F.col("dl")) / F.sum("rows")).alias("avgdl"))
    else:
        postings = (
            tokens.select(*keys, "dl", F.explode("tokens").alias("term"))
            .join(vocabulary, ["domain", "term"], "left_semi")
            .groupBy(*keys, "dl", "term")
            .agg(F.count("*").alias("tf"))
        )
        corpus = tokens.groupBy("domain").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("domain", "term").agg(F.count("*").alias("df"))
    if allowed is not None:
        docs = allowed.select("doc_id").distinct()
        if docs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            postings = postings.join(F.broadcast(docs), "doc_id", "left_semi")  # postings of other documents are counted, but not exchanged
    return score_postings(terms, postings, df, corpus, batch, allowed)


def allowed_bm25(queries: DataFrame, pages: DataFrame, allowed: DataFrame, text: str, batch: Batch) -> DataFrame:
    """F2 under a document filter with many different terms, over pages without an index.

    Pages are exchanged as texts. How many pages of a domain hold a term is
    counted in the tasks that cut them; postings are only made of the allowed
    documents, and of those only for terms that are asked of them.
    """
    keys = ["domain", "doc_id", "page_id", "page_no"]
    texts = pages.repartition("page_id").groupBy(*keys).agg(F.collect_list(F.coalesce(F.col(text), F.lit(""))).alias("texts"))
    terms = query_terms(queries)
    total = ""  # no token is empty: the row of a domain's totals
    vocabulary = terms.select("domain", "term").distinct()
    vocabulary = vocabulary.unionByName(vocabulary.select("domain", F.lit(total).alias("term")).distinct())
    cut = I.cut_texts(texts, keys).select(
        "domain", "rows", "dl", F.explode(F.concat(F.array(F.lit(total)), F.array_distinct("tokens"))).alias("term")
    )
    held = cut.groupBy("domain", "term").agg(F.count("*").alias("df"), F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("dl")).alias("_tokens"))
    held = cut_lineage(held.join(vocabulary, ["domain", "term"], "left_semi"))
    corpus = held.filter(F.col("term") == total).select("domain", "n", (F.col("_tokens") / F.col("n")).alias("avgdl"))
    weights = weighted_terms(terms, held.filter(F.col("term") != total), corpus)
    asked = weights.join(allowed.select("qid", "doc_id").distinct(), "qid")
    wanted = asked.groupBy("domain", "doc_id").agg(F.collect_set("term").alias("_wanted"))
    found = I.cut_texts(texts.join(batch.hint(wanted), ["domain", "doc_id"]), [*keys, "_wanted"])
    found = found.select(*keys, "dl", F.filter("tokens", lambda t: F.array_contains("_wanted", t)).alias("tokens")).repartition("page_id")
    postings = found.select(*keys, "dl", F.explode("tokens").alias("term")).groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))
    hits = postings.join(batch.hint_terms(asked), ["domain", "doc_id", "term"])
    return hits.groupBy(*PAIR).agg(F.sum(weight_of_term()).alias("score")).filter("score > 0")


def weighted_terms(terms: DataFrame, df: DataFrame, corpus: DataFrame) -> DataFrame:
    """Query terms with the weight ``w`` their frequency in the domain gives them."""
    return (
        terms.join(df.select("domain", "term", "df"), ["domain", "term"])
        .join(corpus, "domain")
        .select("qid", "domain", "term", "avgdl", (I.idf(F.col("n"), F.col("df")) * F.col("qtf")).alias("w"))
    )


def page_rows(pages: DataFrame | StoredIndex) -> DataFrame:
    return pages.pages if isinstance(pages, StoredIndex) else pages


def stored_bm25(queries: DataFrame, index: StoredIndex, allowed: DataFrame | None = None) -> DataFrame:
    """F2 over a stored index; under a document filter postings meet the allowed documents first."""
    batch = measure(queries)
    terms, weights, postings = asked_postings(queries, index, batch)
    keys = ["domain", "term"]
    if allowed is not None:
        vocabulary = batch.hint_terms(terms.select("domain", "term").distinct())
        pairs = allowed.select("qid", "doc_id").distinct()
        postings, keys = allowed_postings(postings.join(vocabulary, ["domain", "term"], "left_semi"), index, pairs), ["qid", "domain", "term"]
    hits = postings.join(batch.hint_terms(weights.drop("df", "n", "top")), keys)
    return hits.groupBy(*PAIR).agg(F.sum(weight_of_term()).alias("score")).filter("score > 0")


PAIR = ["page_id", "qid", "domain", "doc_id", "page_no"]


def asked_postings(queries: DataFrame, index: StoredIndex, batch: Batch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Query terms, their weights with what bounds them, and the postings of the partitions that hold any."""
    terms, inside = index.asked(query_terms(queries))
    df = index.terms.filter(inside[0] & inside[1])
    weights = (
        df.join(batch.hint_terms(terms), ["domain", "term_bucket", "term"])
        .join(index.corpus, "domain")
        .select("qid", "domain", "term", "avgdl", (I.idf(F.col("n"), F.col("df")) * F.col("qtf")).alias("w"), "df", "n", "top")
    )
    return terms, weights, index.postings.filter(inside[0] & inside[1]).drop("term_bucket")


def allowed_postings(postings: DataFrame, index: StoredIndex, pairs: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Postings of the documents of ``pairs(qid, doc_id)``, once for each of their queries.

    Many pairs go to the pages first, a row per page, and meet the postings in
    the page's bucket: the postings stay where they lie.
    """
    if pairs.limit(max_rows + 1).count() <= max_rows:
        return postings.join(F.broadcast(pairs), "doc_id")
    placed = index.pages.select("page_id", "doc_id").distinct().join(pairs, "doc_id")
    placed = placed.select(F.col("page_id").alias("_page"), F.col("doc_id").alias("_doc"), "qid").hint("shuffle_hash")
    # equality as two bounds: a second key of the join would have the postings dealt anew
    same = (F.col("page_id") == F.col("_page")) & (F.col("doc_id") >= F.col("_doc")) & (F.col("doc_id") <= F.col("_doc"))
    return postings.join(placed, same).drop("_page", "_doc")


def best_pages(queries: DataFrame, pages: DataFrame | StoredIndex, k: int, text: str = "index_text", batch: Batch | None = None) -> DataFrame:
    """The k best pages per query with ``score`` and ``rank``."""
    batch = batch or measure(queries)
    if isinstance(pages, StoredIndex):
        held = pages.corpus.agg(F.sum("n")).first()[0] or 0
        if batch.rows * held > PRUNE_PAIRS:
            return top_pages(contenders(queries, pages, k, batch), k)
    return top_pages(bm25(queries, pages, text=text, batch=batch), k)


def contenders(queries: DataFrame, index: StoredIndex, k: int, batch: Batch) -> DataFrame:
    """Scores of all pages that can be among the k best of their query; nothing that can is left out.

    The k-th best sum over a query's rare terms is a lower bound of its k-th
    best score. Terms of which all together give at most half of that are left
    to the end: a page needs the other half from the rest, the strong terms.
    Pages whose sum over those and the highest possible of the others cannot
    reach the bound are dropped, the remaining ones get their full score.
    """
    _, weights, postings = asked_postings(queries, index, batch)
    weights = cut_lineage(weights.withColumn("most", F.col("w") * F.col("top")))

    def sums(some: DataFrame) -> DataFrame:
        held = batch.hint_terms(some.select("qid", "domain", "term", "avgdl", "w"))
        return postings.join(held, ["domain", "term"]).groupBy(*PAIR).agg(F.sum(weight_of_term()).alias("score"))

    rare = sums(weights.filter(F.col("df") <= F.greatest(F.lit(1000), F.col("n") / RARE_SHARE)))
    bounds = top_pages(rare, k).filter(F.col("rank") == k).select("qid", F.col("score").alias("bound"))
    below = F.sum("most").over(Window.partitionBy("qid", "domain").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    weights = cut_lineage(weights.join(bounds, "qid", "left").withColumn("weak", F.coalesce(below < F.col("bound") / 2, F.lit(False))))
    weak = weights.filter("weak")
    limits = weights.groupBy("qid", "domain").agg(F.max("bound").alias("bound"), F.sum(F.when(F.col("weak"), F.col("most")).otherwise(0)).alias("most"))
    strong = sums(weights.filter("not weak")).join(batch.hint(limits, 2), ["qid", "domain"])
    found = cut_lineage(strong.filter(F.col("bound").isNull() | (F.col("score") + F.col("most") >= F.col("bound") - TOLERANCE)).select(*PAIR, "score"))
    few = found.count() <= BROADCAST_ROWS
    asked = found.select(*[F.col(c).alias(f"_{c}") for c in PAIR])
    asked = F.broadcast(asked) if few else asked.hint("shuffle_hash")
    same = (F.col("page_id") == F.col("_page_id")) & F.col("domain").eqNullSafe(F.col("_domain"))
    same = same & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("page_no").eqNullSafe(F.col("_page_no"))
    there = postings.join(batch.hint_terms(weak.select("domain", "term").distinct()), ["domain", "term"], "left_semi")
    there = there.join(asked, same).withColumn("qid", F.col("_qid"))
    rest = there.join(batch.hint_terms(weak.select("qid", "domain", "term", "avgdl", "w")), ["qid", "domain", "term"]).select(*PAIR, weight_of_term().alias("score"))
    return found.unionByName(rest).groupBy(*PAIR).agg(F.sum("score").alias("score")).filter("score > 0")


def weight_of_term() -> Column:
    """Share of a term in a page's score, from ``w, tf, dl, avgdl``."""
    return F.col("w") * I.saturation()


def score_postings(
    terms: DataFrame, postings: DataFrame, df: DataFrame, corpus: DataFrame, batch: Batch, allowed: DataFrame | None = None
) -> DataFrame:
    """Sum of the term weights per query and page; the small query side carries the statistics."""
    weights = weighted_terms(terms, df, corpus)
    if allowed is None:
        hits = postings.join(batch.hint_terms(weights), ["domain", "term"])
    else:
        # terms per allowed document: postings meet only the queries that may see them
        asked = weights.join(allowed.select("qid", "doc_id").distinct(), "qid")
        hits = postings.join(batch.hint_terms(asked), ["domain", "doc_id", "term"])
    return (
        hits.groupBy("page_id", "qid", "domain", "doc_id", "page_no").agg(F.sum(weight_of_term()).alias("score")).filter("score > 0")
    )


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


def search_pages(
    queries: DataFrame,
    pages: DataFrame | StoredIndex,
    allowed: DataFrame | None = None,
    k: int = 5,
    quote: int = 700,
    text: str = "index_text",
) -> DataFrame:
    """the k best pages per query, with a clipped quote."""
    k, quote = clamp(k, 1, 20), clamp(quote, 80, 3000)
    pairs = queries if allowed is None else allowed.select("qid", "doc_id").distinct().join(queries.select("qid", "query"), "qid")
    batch = measure(pairs)
    top = best_pages(queries, pages, k, text, batch) if allowed is None else top_pages(bm25(queries, pages, allowed, text, batch), k)
    found = page_rows(pages).join(batch.hint(top.select("page_id", "qid", "score", "rank"), k), "page_id")
    shown = X.clip(F.coalesce(X.falsy_null("text"), F.col(text)), quote)
    return found.select("qid", "domain", "doc_id", "page_id", F.round("score", 3).alias("score"), "rank", "heading_path", shown.alias("quote"))


def top_pages(scores: DataFrame, k: int, per: list[str] | None = None) -> DataFrame:
    """Best k pages per group, ties in page order."""
    rank = rank_by(per or ["qid"], by_score(), F.col("doc_id"), F.col("page_no"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def retrieve_multi(
    requests: DataFrame, pages: DataFrame | StoredIndex, k: int, source: str, text: str = "index_text", batch: Batch | None = None
) -> DataFrame:
    """evidence rows, the k best pages per (query, document) of ``requests(qid, domain, query, doc_id)``."""
    batch = batch or measure(requests)
    queries = requests.select("qid", "domain", "query").distinct()
    top = top_pages(bm25(queries, pages, requests, text, batch), k, ["qid", "doc_id"])
    scored = top.select("page_id", "qid", "score", "rank")
    if isinstance(pages, StoredIndex) and batch.rows * k > BROADCAST_ROWS:
        return evidence_rows(scored.hint("shuffle_hash"), pages, source)  # the pages stay in their buckets, unsorted
    return evidence_rows(batch.hint(scored, k), pages, source)


def evidence_rows(scored: DataFrame, pages: DataFrame | StoredIndex, source: str) -> DataFrame:
    """Evidence schema for scored pages."""
    return page_rows(pages).join(scored, "page_id").select(
        "qid",
        F.col("page_id").alias("evidence_id"),
        "doc_id",
        "page_id",
        "page_no",
        "heading_path",
        X.repair("text").alias("text"),
        F.round("score", 6).alias("score"),
        "rank",
        F.lit(source).alias("source"),
    )


def term_hits(terms: DataFrame, texts: DataFrame, keys: list[str], text: str, batch: Batch) -> DataFrame:
    """Query terms found as substrings of lower-cased texts: ``(keys, qid, domain, term, pos, hits)``."""
    lowered = texts.select(*keys, "domain", F.lower(F.col(text)).alias("_text"))
    needles = terms.select("domain", F.lower("term").alias("term"))
    hits = contains_join(lowered, needles, keys, "_text", ["domain"])
    return hits.join(batch.hint_terms(terms.withColumn("shown", F.col("term")).withColumn("term", F.lower("term"))), ["domain", "term"])


def catalog_score(queries: DataFrame, catalog: DataFrame, max_terms: int = 12, batch: Batch | None = None) -> DataFrame:
    """capped term counts plus 4 if the whole query occurs; matched terms in query order."""
    batch = batch or measure(queries)
    profiles = I.catalog_text(catalog).select("doc_id", "domain", "profile")
    hits = term_hits(query_terms(queries), profiles, ["doc_id"], "profile", batch)
    scored = hits.groupBy("qid", "domain", "doc_id").agg(
        F.sum(F.least("hits", F.lit(3))).alias("terms_score"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]), 1, max_terms).alias("matched"),
    )
    phrases = queries.select("qid", "domain", X.strip("query").alias("term")).filter(F.col("term") != "")
    whole = contains_join(profiles, phrases, ["doc_id"], "profile", ["domain"]).join(phrases, ["domain", "term"])
    # a query without any token scores nothing, phrase or not
    whole = whole.select("qid", "domain", "doc_id", F.lit(4).alias("phrase")).join(
        query_terms(queries).select("qid").distinct(), "qid", "left_semi"
    )
    none = F.array().cast("array<string>")
    return scored.join(whole, ["qid", "domain", "doc_id"], "full").select(
        "qid",
        "domain",
        "doc_id",
        (F.coalesce("terms_score", F.lit(0)) + F.coalesce("phrase", F.lit(0))).cast("double").alias("catalog_score"),
        F.coalesce("matched", none).alias("matched"),
    )


def search_docs(queries: DataFrame, pages: DataFrame | StoredIndex, catalog: DataFrame, k: int = 5, pool: int = 50, text: str = "index_text") -> DataFrame:
    """documents by the sum of their pages among the ``pool`` best plus the catalog score."""
    k = clamp(k, 1, 20)
    batch = measure(queries)
    best = best_pages(queries, pages, pool, text, batch)
    per_doc = best.groupBy("qid", "domain", "doc_id").agg(
        F.sum("score").alias("page_score"), F.min_by("page_id", "rank").alias("page_id")
    )
    # matched terms of the best page of each document
    lead = per_doc.select("qid", "page_id")
    texts = page_rows(pages).join(batch.hint(lead.select("page_id").distinct(), pool), "page_id", "left_semi").select(
        "page_id", "domain", F.coalesce(X.falsy_null("text"), F.col(text)).alias("shown_text")
    )
    found = term_hits(query_terms(queries), texts, ["page_id"], "shown_text", batch).join(batch.hint(lead, pool), ["qid", "page_id"], "left_semi")
    page_terms = found.groupBy("qid", "page_id").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]), 1, 12).alias("page_terms")
    )
    none = F.array().cast("array<string>")
    merged = (
        catalog_score(queries, catalog, batch=batch)
        .join(per_doc, ["qid", "domain", "doc_id"], "full")
        .join(page_terms, ["qid", "page_id"], "left")
        .select(
            "qid",
            "domain",
            "doc_id",
            F.coalesce("catalog_score", F.lit(0.0)).alias("catalog_score"),
            F.coalesce("page_score", F.lit(0.0)).alias("page_score"),
            F.slice(F.array_distinct(F.concat(F.coalesce("matched", none), F.coalesce("page_terms", none))), 1, 12).alias("matched_terms"),
        )
        .withColumn("score", F.round(F.col("catalog_score") + F.col("page_score"), 3))
        .filter("catalog_score + page_score > 0")
    )
    top = merged.withColumn("rank", rank_by(["qid"], F.desc("score"), F.col("doc_id"))).filter(F.col("rank") <= k)
    shown = catalog.select("doc_id", F.col("title_fixed").alias("title"), "page_count", "first_page_id", X.clip("first_page_preview", 240).alias("first_page_preview"))
    return shown.join(batch.hint(top, k), "doc_id").select(
        "qid", "domain", "doc_id", "title", "score", F.round("catalog_score", 3).alias("catalog_score"),
        F.round("page_score", 3).alias("page_score"), "matched_terms", "page_count", "first_page_id", "first_page_preview", "rank",
    )


def get_page(pages: DataFrame, keys: DataFrame, max_chars: int = 5000) -> DataFrame:
    """first page in page order for each ``keys(key_id, domain, page_id, doc_id)``; empty means any."""
    n = clamp(max_chars, 100, 20000)
    rows = pages.select("domain", "doc_id", "page_id", "page_no", "heading_path", "text")
    by_page = keys.filter(F.coalesce("page_id", F.lit("")) != "")
    by_doc = keys.filter((F.coalesce("page_id", F.lit("")) == "") & (F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != ""))
    hit = (
        rows.join(small(by_page.select("key_id", "domain", "page_id", F.col("doc_id").alias("want_doc"))), ["domain", "page_id"])
        .filter(F.coalesce(F.col("want_doc").cast("string"), F.lit("")).isin("") | (F.col("want_doc") == F.col("doc_id")))
        .select("key_id", *rows.columns)
    )
    hit = hit.unionByName(rows.join(small(by_doc.select("key_id", "domain", "doc_id")), ["domain", "doc_id"]).select("key_id", *rows.columns))
    first = hit.groupBy("key_id").agg(F.min_by(F.struct("domain", "doc_id", "page_id", "heading_path", "text"), F.struct("doc_id", "page_no")).alias("p"))
    return first.select("key_id", "p.domain", "p.doc_id", "p.page_id", "p.heading_path", X.clip("p.text", n).alias("text"))


# Words that name documents by position.
FIRST = ("第一份", "第一个", "文档一", "第一份文档", "首份")
SECOND = ("第二份", "第二个", "文档二", "第二份文档")
THIRD = ("第三份", "第三个", "文档三", "第三份文档")
EVERY = ("两份", "二者", "均", "都", "分别", "对比", "相比", "低于", "高于", "两者")


def target_docs(questions: DataFrame) -> DataFrame:
    """F8: documents of ``questions(qid, query, doc_ids)`` named by position; all of them if none is."""
    text = X.repair("query")
    named = [text.rlike("|".join(words)) for words in (FIRST, SECOND, THIRD)]
    every = text.rlike("|".join(EVERY))
    n = F.size("doc_ids")
    hits = [m & (n >= i) for i, m in enumerate(named, start=1)]
    some = hits[0] | hits[1] | hits[2]
    rows = questions.select("qid", F.posexplode(F.array_distinct("doc_ids")).alias("pos", "doc_id"), every.alias("_all"), some.alias("_some"), *[h.alias(f"_h{i}") for i, h in enumerate(hits)])
    chosen = F.coalesce(*[F.when(F.col("pos") == i, F.col(f"_h{i}")) for i in range(3)], F.lit(False))
    return rows.filter(F.col("_all") | ~F.col("_some") | chosen).select("qid", "doc_id", (F.col("pos") + 1).alias("ord"))


def retrieve_questions(questions: DataFrame, pages: DataFrame | StoredIndex, k: int = 5, text: str = "index_text") -> DataFrame:
    """F8: best pages per targeted document, merged by score within the question.

    ``questions(qid, domain, question, options, doc_ids)``; every option also asks on its own.
    """
    listed = F.array_join(F.transform(F.map_entries("options"), lambda o: F.concat(o["key"], F.lit(". "), o["value"])), "\n")
    whole = questions.select("qid", "domain", F.concat_ws("\n", "question", listed).alias("query"), "doc_ids")
    single = questions.select("qid", "domain", "question", "doc_ids", F.explode("options").alias("opt", "claim")).select(
        F.concat_ws("_", "qid", "opt").alias("qid"), "domain",
        F.concat("question", F.lit("\n"), "opt", F.lit(". "), "claim").alias("query"), "doc_ids",
    )
    asked = whole.unionByName(single)
    requests = target_docs(asked).join(asked.select("qid", "domain", "query"), "qid")
    hits = retrieve_multi(requests, pages, k, "question", text)
    return hits.withColumn("rank", rank_by(["qid"], by_score(), F.col("doc_id"), F.col("page_no")))
