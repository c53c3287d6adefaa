"""Queries: routing of supplier questions to the contract notes of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscan.functions import text as X
from leafscan.operators import routing as R
from leafscan.operators import search as Q
from leafscan.plans.base import query, table
from leafscan.session import cut_lineage
from leafscan.plans.evaluate import ASK_SQL, questions
from leafscan.plans.evidence import tokens_sql


# eight characters drawn from a key's digest name a customer in wide text
HEX = "0123456789abcdef"
SIGNS = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳"


def sign(key):
    return F.translate(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), HEX, SIGNS)


SIGN = f"translate(substr(md5(CAST({{0}} AS VARCHAR)), 1, 8), '{HEX}', '{SIGNS}')"


def profiles(spark, d):
    """A customer's signed name and segment."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("c"), F.lpad(k.cast("string"), 7, "0")).alias("doc_id"), F.lower("c_mktsegment").alias("domain"), sign(k).alias("title"),
        F.concat(F.lit("raw/c"), k, F.lit(".md")).alias("source_path"),
        F.concat(F.lit("title="), sign(k), F.lit(" first_page="), "c_name", F.lit(" 目录 "), sign(k), F.lit("，余额"), F.floor("c_acctbal")).alias("profile"),
    )


def supplier_questions(spark, d):
    """Every supplier asks about the customer of its own number."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    domains = F.array(*[F.lit(x) for x in ("automobile", "building", "furniture", "household", "machinery")])
    return s.select(
        F.concat(F.lit("s"), k).alias("qid"), F.element_at(domains, (k % 5 + 1).cast("int")).alias("domain"),
        F.concat("s_name", F.lit("问《"), sign(k), F.lit("》"), sign(k), F.lit("账期金额 "), k % 30 + 1990, F.lit("年")).alias("query"),
        F.array(sign(k + 5), F.concat(F.lit("余额"), k)).alias("entities"), F.array(F.lit("余额")).alias("metrics"),
    )


KEY = r"lower(regexp_replace({0}, '[\s、，,。；;：:（）()\[\]【】《》\"''“”‘’/\\_-]+', '', 'g'))".replace(r"\"", '"')
CJK_COUNT = "len(regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fff}}]'))"
PROFILE_SQL = f"""
prof AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS doc_id, lower(c_mktsegment) AS domain, {SIGN.format('c_custkey')} AS title, 'raw/c' || c_custkey || '.md' AS path,
  'title=' || {SIGN.format('c_custkey')} || ' first_page=' || c_name || ' 目录 ' || {SIGN.format('c_custkey')} || '，余额' || CAST(floor(c_acctbal) AS BIGINT) AS profile FROM customer),
rq AS (SELECT 's' || s_suppkey AS qid, ['automobile', 'building', 'furniture', 'household', 'machinery'][s_suppkey % 5 + 1] AS domain, s_suppkey AS k,
  s_name || '问《' || {SIGN.format('s_suppkey')} || '》' || {SIGN.format('s_suppkey')} || '账期金额 ' || (s_suppkey % 30 + 1990) || '年' AS query FROM supplier)"""
RUNS = "regexp_extract_all(query, '[\\x{4e00}-\\x{9fff}A-Za-z0-9.]{2,18}')"
ROUTE_SQL = f"""{PROFILE_SQL},
rt AS (SELECT qid, shown, min(pos) AS pos FROM (SELECT qid, unnest({RUNS}) AS shown, generate_subscripts({RUNS}, 1) AS pos FROM rq
  UNION ALL SELECT qid, regexp_extract(query, '《([^》]{{2,120}})》', 1), 0 FROM rq) GROUP BY ALL),
rk AS (SELECT *, {KEY.format('shown')} AS term FROM rt WHERE length({KEY.format('shown')}) >= 2),
ph AS (SELECT DISTINCT qid, substr(key, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS term FROM (SELECT qid, key, n, unnest(range(1, length(key) - n + 2)) AS i
  FROM (SELECT qid, {KEY.format('query')} AS key FROM rq), range(6, 17) s(n) WHERE n <= length(key))),
pk AS (SELECT doc_id, domain, {KEY.format('profile')} AS key FROM prof),
th AS (SELECT qid, doc_id, domain, shown, CASE WHEN regexp_matches(term, '^(?:[0-9]+(?:\\.[0-9]+)?%?|(?:19|20)[0-9]{{2}}年?|[0-9]{{1,2}}(?:月|日)?)$') THEN 0.2
  WHEN length(term) >= 4 THEN 10 ELSE 3 END AS w FROM rk JOIN pk ON contains(pk.key, rk.term)),
pp AS (SELECT qid, doc_id, domain, term, length(term) AS n FROM ph JOIN pk ON contains(pk.key, ph.term)
  WHERE {CJK_COUNT.format('term')} >= 3 AND NOT EXISTS (SELECT 1 FROM th WHERE th.qid = ph.qid AND th.doc_id = pk.doc_id AND th.shown = ph.term)),
cn AS (SELECT qid, doc_id, 17 AS n, count(*) AS c FROM th GROUP BY ALL UNION ALL SELECT qid, doc_id, n, count(*) FROM pp GROUP BY ALL),
bf AS (SELECT qid, doc_id, n, coalesce(sum(c) OVER (PARTITION BY qid, doc_id ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cn),
rs AS (SELECT qid, doc_id, domain, round(sum(w), 3) AS score FROM (SELECT qid, doc_id, domain, w FROM th UNION ALL
  SELECT pp.qid, pp.doc_id, pp.domain, least(14, pp.n / 1.3) FROM pp JOIN bf ON bf.qid = pp.qid AND bf.doc_id = pp.doc_id AND bf.n = pp.n WHERE pp.n >= 16 OR b < 10)
  GROUP BY ALL),
cs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, domain, doc_id) AS rank FROM rs WHERE score > 0) WHERE rank <= 12)"""


@query("g2_catalog_search", f"WITH {ROUTE_SQL} SELECT qid, doc_id, domain, CAST(score AS DOUBLE) AS score, rank FROM cs")
def g2(spark, d):
    return R.catalog_search(supplier_questions(spark, d).select("qid", "query"), profiles(spark, d)).select("qid", "doc_id", "domain", "score", "rank")


@query(
    "g4_strong_hit",
    f"""WITH {ROUTE_SQL}, t AS (SELECT qid, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b FROM cs GROUP BY qid)
    SELECT qid, a >= 24 AND (b IS NULL OR a >= greatest(b + 10, b * 1.8)) AS strong FROM t""",
)
def g4(spark, d):
    return R.strong_hit(R.catalog_search(supplier_questions(spark, d).select("qid", "query"), profiles(spark, d)))


def fallen(spark, d, q, p):
    """All customers, dealt to the supplier questions in turn: ``qid, doc_id``."""
    suppliers = table(spark, d, "supplier").count() or 1
    number = lambda c: F.pmod(F.substring(c, 2, 20).cast("bigint"), F.lit(suppliers))
    return p.select("doc_id", number("doc_id").alias("n")).join(q.select("qid", number("qid").alias("n")), "n").select("qid", "doc_id")


@query("g3_chat_route")
def g3(spark, d):
    """Every supplier question against the customers that fall on it."""
    q = supplier_questions(spark, d)
    p = profiles(spark, d)
    candidates = fallen(spark, d, q, p).withColumn("ord", Q.rank_by(["qid"], F.col("doc_id")))
    return R.chat_route(candidates, q.select("qid", "query"), p)


def _dictionary(words):
    return "[" + ", ".join("'" + w.lower() + "'" for w in words) + "]"


HITS = ", ".join(f"{{'n': len(list_filter({_dictionary(words)}, lambda w: contains(lower(question), w))), 'd': '{name}'}}" for name, words in R.DOMAIN_TERMS.items())


@query(
    "g1_infer_domain",
    f"""WITH {ASK_SQL}, h AS (SELECT qid, k, question, [{HITS}] AS r FROM ask),
    m AS (SELECT *, list_max(list_transform(r, lambda x: x.n)) AS top FROM h)
    SELECT qid, CASE WHEN k % 9 = 0 THEN 'insurance' WHEN top > 0 AND len(list_filter(r, lambda x: x.n = top)) = 1 THEN list_filter(r, lambda x: x.n = top)[1].d ELSE 'research' END AS domain FROM m""",
)
def g1(spark, d):
    """Every ninth question asks for a domain."""
    k = F.substring("qid", 2, 20).cast("bigint")
    q = questions(spark, d).select("qid", F.col("question").alias("query"), F.when(k % 9 == 0, "insurance").otherwise("").alias("requested"))
    return R.infer_domain(q).select("qid", "domain")


PREFILTER_SQL = f"""qi AS (SELECT qid AS id, query AS text FROM rq), pi AS (SELECT doc_id AS id, profile AS text FROM prof), {tokens_sql('qi', 'qtk')}, {tokens_sql('pi', 'ptk')},
    hint AS (SELECT * FROM qtk WHERE NOT regexp_matches(tok, '^(?:19|20)[0-9]{{2}}年?$') AND NOT regexp_matches(tok, '^[0-9.%-]+$') AND length(tok) > 1
      AND NOT regexp_matches(tok, '^[a-z]{{1,3}}$') AND regexp_matches(tok, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z]')),
    sh AS (SELECT rq.qid, prof.doc_id, count(*) AS n FROM hint JOIN rq ON rq.qid = hint.id JOIN ptk ON ptk.tok = hint.tok JOIN prof ON prof.doc_id = ptk.id AND prof.domain = rq.domain GROUP BY ALL),
    ti AS (SELECT DISTINCT rq.qid, prof.doc_id FROM rq JOIN prof ON prof.domain = rq.domain JOIN hint ON hint.id = rq.qid AND contains(title || ' ' || path, hint.tok)),
    s AS (SELECT rq.qid, prof.doc_id, coalesce(n, 0) + CASE WHEN contains(profile, {SIGN.format('k + 5')}) THEN 20 ELSE 0 END + CASE WHEN contains(profile, '余额' || k) THEN 8 ELSE 0 END
      + CASE WHEN contains(profile, '余额') THEN 3 ELSE 0 END + CASE WHEN ti.qid IS NOT NULL THEN 2 ELSE 0 END AS score
      FROM rq JOIN prof ON prof.domain = rq.domain LEFT JOIN sh ON sh.qid = rq.qid AND sh.doc_id = prof.doc_id LEFT JOIN ti ON ti.qid = rq.qid AND ti.doc_id = prof.doc_id),
    pf AS (SELECT qid, doc_id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 6)"""


@query("g6_prefilter", f"WITH {PROFILE_SQL}, {PREFILTER_SQL} SELECT qid, doc_id, score, rank FROM pf")
def g6(spark, d):
    return R.prefilter(supplier_questions(spark, d), profiles(spark, d)).select("qid", "doc_id", "score", "rank")


@query(
    "g5_choose_docs",
    f"""WITH {ROUTE_SQL}, {PREFILTER_SQL},
    sh4 AS (SELECT qid, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b FROM cs GROUP BY qid),
    strong AS (SELECT qid FROM sh4 WHERE a >= 24 AND (b IS NULL OR a >= greatest(b + 10, b * 1.8))),
    tiers AS (SELECT qid, doc_id, 1 AS tier, rank AS place FROM cs WHERE CAST(substr(qid, 2) AS BIGINT) % 3 = 0 AND rank <= 2
      UNION ALL SELECT cs.qid, cs.doc_id, 2, row_number() OVER (PARTITION BY cs.qid ORDER BY cs.rank) FROM cs JOIN rq ON rq.qid = cs.qid AND rq.domain = cs.domain WHERE cs.qid IN (SELECT qid FROM strong)
      UNION ALL SELECT qid, doc_id, 3, rank FROM pf WHERE qid IN (SELECT qid FROM pf GROUP BY qid HAVING count(*) > 2)),
    best AS (SELECT *, min(tier) OVER (PARTITION BY qid) AS b FROM tiers)
    SELECT qid, doc_id, CAST(tier AS BIGINT) AS tier, place, 'document' AS scope FROM best WHERE tier = b
    UNION ALL SELECT qid, NULL, 4, 1, 'domain' FROM rq WHERE qid NOT IN (SELECT qid FROM tiers)""",
)
def g5(spark, d):
    """A third of the questions prefers documents; the others take catalog hits, the prefilter or the domain."""
    q, p = supplier_questions(spark, d), profiles(spark, d)
    hits = cut_lineage(R.catalog_search(q.select("qid", "query"), p))
    preferred = hits.filter((F.substring("qid", 2, 20).cast("int") % 3 == 0) & (F.col("rank") <= 2)).select("qid", "doc_id", F.col("rank").alias("ord"))
    return R.choose_docs(q.select("qid", "domain"), preferred, hits, R.prefilter(q, p), p)


def claims(spark, d):
    """Every supplier question put to the customers that fall on it and to the customer it names."""
    p = profiles(spark, d)
    q = supplier_questions(spark, d)
    named = q.select("qid", F.concat(F.lit("c"), F.lpad(F.substring("qid", 2, 20), 7, "0")).alias("doc_id"), F.col("query").alias("claim"))
    asked = fallen(spark, d, q, p).join(q.select("qid", F.col("query").alias("claim")), "qid")
    return asked.select("qid", "doc_id", "claim").unionByName(named).distinct()


@query("g7_doc_hints")
def g7(spark, d):
    return R.select_hints(R.doc_hints(claims(spark, d), profiles(spark, d))).select("qid", "doc_id", F.round("score", 3).alias("score"), "rank")


@query("g8_reroute")
def g8(spark, d):
    """Missing slots of every supplier question; a third of the query texts was tried before."""
    q, p = supplier_questions(spark, d), profiles(spark, d)
    current = p.withColumn("ord", Q.rank_by(["domain"], F.col("doc_id"))).filter("ord <= 2").join(q.select("qid", "domain"), "domain").select("qid", "doc_id")
    tried = q.filter(F.substring("qid", 2, 20).cast("int") % 3 == 0).select("qid", X.stable_id(F.col("query"), 12).alias("query_key"))
    return R.reroute(q.select("qid", "query"), p, current, tried).select("qid", "doc_id", F.round("score", 3).alias("score"), "rank")


@query(
    "g12_resolve_docs",
    """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders),
    r AS (SELECT c, k, ord FROM o WHERE ord <= 4 OR ord % 2 = 0)
    SELECT 'c' || c AS qid, 'o' || k AS doc_id, row_number() OVER (PARTITION BY c ORDER BY ord) AS ord FROM r""",
)
def g12(spark, d):
    """A customer's orders named by place, id or number; odd ones after the fourth by nothing that resolves."""
    o = table(spark, d, "orders")
    docs = o.select(F.concat(F.lit("c"), "o_custkey").alias("qid"), F.concat(F.lit("o"), "o_orderkey").alias("doc_id"), "o_orderkey")
    docs = docs.withColumn("doc_ord", Q.rank_by(["qid"], F.col("o_orderkey"))).drop("o_orderkey")
    names = F.array(*[F.lit(a) for a in R.ALIASES])
    ref = F.when(F.col("doc_ord") <= 4, F.element_at(names, F.least("doc_ord", F.lit(4)))).when(
        F.col("doc_ord") % 4 == 0, F.concat(F.lit("Doc-ID "), "doc_ord")
    ).when(F.col("doc_ord") % 2 == 0, F.col("doc_id")).otherwise("未知")
    return R.resolve_docs(docs.select("qid", F.col("doc_ord").alias("pos"), ref.alias("ref")), docs)


@query(
    "g13_route_docs",
    """WITH o AS (SELECT 'c' || o_custkey AS qid, 'o' || o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_custkey % 3 AS m FROM orders),
    t AS (SELECT qid, doc_id, n, CASE WHEN n = 2 AND m <= 1 THEN 1 WHEN n % 2 = 1 AND m = 0 THEN 2 END AS tier FROM o),
    b AS (SELECT qid, bool_or(tier IS NOT NULL) AS x FROM t GROUP BY qid)
    SELECT t.qid, doc_id, CAST(coalesce(tier, 3) AS BIGINT) AS tier, row_number() OVER (PARTITION BY t.qid ORDER BY coalesce(tier, 3), n) AS ord FROM t JOIN b ON b.qid = t.qid WHERE tier IS NOT NULL OR NOT x""",
)
def g13(spark, d):
    """Two thirds of the customers have a hint, half of these also planned documents; the rest takes all."""
    o = table(spark, d, "orders").withColumn("doc_ord", Q.rank_by(["o_custkey"], F.col("o_orderkey")))
    docs = o.select(F.concat(F.lit("c"), "o_custkey").alias("qid"), F.concat(F.lit("o"), "o_orderkey").alias("doc_id"), "doc_ord", (F.col("o_custkey") % 3).alias("m"))
    hints = docs.filter("doc_ord = 2 AND m <= 1").select("qid", "doc_id", F.lit(1).alias("rank"))
    planned = docs.filter("doc_ord % 2 = 1 AND m = 0").select("qid", "doc_id", F.col("doc_ord").alias("ord"))
    return R.route_docs(docs.select("qid").distinct(), hints, planned, docs)
