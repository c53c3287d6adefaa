"""Queries: conversation memory, quota and lock-out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafscan.functions import text as X
from leafscan.operators import memory as M
from leafscan.plans.base import query, table
from leafscan.streaming import quota as U
from leafscan.streaming.memory import memory_stream

SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def clip_sql(col: str, n: int) -> str:
    s = SQ.format(col)
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE rtrim(substr({s}, 1, {n - 3})) || '...' END"


def turns(spark, d):
    """User turns with the assistant's next reply; every fourth turn names no documents."""
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.select(
        "*", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("reply")
    ).filter("role = 'user'")
    rows = rows.select(
        F.format_string("s%05d", "conv_id").alias("session_id"),
        F.row_number().over(w).alias("turn_index"),
        F.col("turn").alias("id"),
        F.col("text").alias("user_query"),
        F.when(F.col("next_role") == "assistant", F.col("reply")).otherwise("").alias("assistant_answer"),
        F.concat(F.lit("dom"), F.col("turn") % 3).alias("domain"),
        F.format_string("2024-01-01T%02d:00:00", "turn").alias("created_at"),
    )
    docs = F.array(F.concat(F.lit("doc"), F.col("turn_index") % 5), F.concat(F.lit("doc"), F.length("user_query") % 7))
    none = F.array().cast("array<string>")
    return rows.withColumn("doc_ids", F.when(F.col("turn_index") % 4 == 0, none).otherwise(F.array_distinct(docs))).withColumn(
        "subjects", F.when(F.col("turn_index") % 3 == 0, none).otherwise(F.array(F.substring_index("user_query", " ", 1)))
    )


TURNS_SQL = """
cv AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t0 AS (SELECT printf('s%05d', conv_id) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_index, turn AS id,
  text AS user_query, CASE WHEN next_role = 'assistant' THEN reply ELSE '' END AS assistant_answer, 'dom' || (turn % 3) AS domain,
  printf('2024-01-01T%02d:00:00', turn) AS created_at FROM cv WHERE role = 'user'),
t AS (SELECT *, CASE WHEN turn_index % 4 = 0 THEN [] WHEN turn_index % 5 = length(user_query) % 7 THEN ['doc' || (turn_index % 5)]
    ELSE ['doc' || (turn_index % 5), 'doc' || (length(user_query) % 7)] END AS doc_ids,
  CASE WHEN turn_index % 3 = 0 THEN [] ELSE [string_split(user_query, ' ')[1]] END AS subjects FROM t0)"""


def sessions(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct()
    sid = F.format_string("s%05d", "conv_id")
    none = F.array().cast("array<string>")
    return c.select(
        sid.alias("session_id"), F.when(F.col("conv_id") % 2 == 0, sid).otherwise(F.concat(F.lit("Title "), "conv_id")).alias("title"),
        F.lit("").alias("active_domain"), none.alias("active_doc_ids"), none.alias("active_subjects"), F.lit("").alias("global_summary"),
        F.lit("2023-12-31T00:00:00").alias("created_at"), F.lit("2023-12-31T00:00:00").alias("updated_at"),
        F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("u"), F.col("conv_id") % 3)).alias("owner_id"),
    )


SESSIONS_SQL = """
ss AS (SELECT DISTINCT printf('s%05d', conv_id) AS session_id, conv_id,
  CASE WHEN conv_id % 2 = 0 THEN printf('s%05d', conv_id) ELSE 'Title ' || conv_id END AS title,
  CASE WHEN conv_id % 3 <> 0 THEN 'u' || (conv_id % 3) END AS owner_id, '2023-12-31T00:00:00' AS made FROM conversations)"""


def memory(spark, d):
    """One note per turn, filed under its first document and query length class."""
    t = turns(spark, d)
    return t.select(
        F.concat_ws(":", "session_id", "turn_index").alias("id"),
        "session_id",
        F.concat(F.lit("e"), F.length("user_query") % 3).alias("evidence_id"),
        F.concat(F.lit("doc"), F.col("turn_index") % 5).alias("doc_id"),
        F.substring_index("user_query", " ", 1).alias("subject"),
        F.concat(F.lit("slot"), F.length("user_query") % 2).alias("slot"),
        X.clip("user_query", 220).alias("evidence_summary"),
        F.when(F.col("turn_index") % 5 == 0, "bad").when(F.col("turn_index") % 2 == 0, "partial").otherwise("useful").alias("evidence_status"),
        F.col("turn_index").alias("source_turn"),
        (F.length("user_query") % 3).alias("use_count"),
        "created_at",
        F.col("created_at").alias("last_used_at"),
    )


MEMORY_SQL = f"""{TURNS_SQL},
mem AS (SELECT session_id || ':' || turn_index AS id, session_id, 'e' || (length(user_query) % 3) AS evidence_id, 'doc' || (turn_index % 5) AS doc_id,
  string_split(user_query, ' ')[1] AS subject, 'slot' || (length(user_query) % 2) AS slot, {clip_sql('user_query', 220)} AS evidence_summary,
  CASE WHEN turn_index % 5 = 0 THEN 'bad' WHEN turn_index % 2 = 0 THEN 'partial' ELSE 'useful' END AS evidence_status,
  turn_index AS source_turn, length(user_query) % 3 AS use_count, created_at, created_at AS last_used_at FROM t)"""


@query(
    "j1_list_sessions",
    f"""WITH {TURNS_SQL}, {SESSIONS_SQL}
    SELECT ss.session_id, title, '' AS active_domain, count(t.id) AS turn_count, made AS created_at, coalesce(max(t.created_at), made) AS updated_at
    FROM ss LEFT JOIN t ON t.session_id = ss.session_id WHERE owner_id = 'u1' GROUP BY ss.session_id, title, made""",
)
def j1(spark, d):
    return M.list_sessions(sessions(spark, d), turns(spark, d), "u1")


@query(
    "j2_session_state",
    f"""WITH {MEMORY_SQL}, {SESSIONS_SQL},
    tw AS (SELECT session_id, string_agg(CAST(turn_index AS VARCHAR), ',' ORDER BY turn_index) AS v FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS n FROM t) WHERE n <= 4 GROUP BY session_id),
    mw AS (SELECT session_id, string_agg(id, ',' ORDER BY n DESC) AS v FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_used_at DESC, id DESC) AS n FROM mem WHERE evidence_status IN ('useful', 'partial'))
      WHERE n <= 24 GROUP BY session_id)
    SELECT ss.session_id, (SELECT count(*) FROM t WHERE t.session_id = ss.session_id) AS turn_count, coalesce(tw.v, '') AS turn_window, coalesce(mw.v, '') AS evidence
    FROM ss LEFT JOIN tw ON tw.session_id = ss.session_id LEFT JOIN mw ON mw.session_id = ss.session_id""",
)
def j2(spark, d):
    t = turns(spark, d)
    facts = t.select("id", "session_id", F.col("domain").alias("subject"), F.col("assistant_answer").alias("fact"))
    state = M.session_state(sessions(spark, d), t, facts, memory(spark, d))
    return state.select(
        "session_id", "turn_count",
        F.coalesce(F.array_join(F.transform("turn_window", lambda x: x["turn_index"].cast("string")), ","), F.lit("")).alias("turn_window"),
        F.coalesce(F.array_join(F.transform("evidence_memory", lambda x: x["id"]), ","), F.lit("")).alias("evidence"),
    )


@query(
    "j3_number_turns",
    f"""WITH {TURNS_SQL} SELECT session_id, id, turn_index FROM t WHERE turn_index > 2""",
)
def j3(spark, d):
    """Turns after the second are new; their index continues the stored ones."""
    t = turns(spark, d)
    stored, new = t.filter("turn_index <= 2"), t.filter("turn_index > 2").drop("turn_index")
    return M.number_turns(stored, new).select("session_id", "id", "turn_index")


@query(
    "j4_append_turns",
    f"""WITH {TURNS_SQL}, {SESSIONS_SQL}
    SELECT ss.session_id, coalesce(arg_max(domain, turn_index), '') AS active_domain,
      coalesce(array_to_string(arg_max(doc_ids, turn_index) FILTER (len(doc_ids) > 0), '|'), '') AS active_doc_ids,
      coalesce(array_to_string(arg_max(subjects, turn_index) FILTER (len(subjects) > 0), '|'), '') AS active_subjects,
      coalesce(max(created_at), max(made)) AS updated_at FROM ss LEFT JOIN t ON t.session_id = ss.session_id GROUP BY ss.session_id""",
)
def j4(spark, d):
    out = M.append_turns(sessions(spark, d), turns(spark, d))
    return out.select("session_id", "active_domain", "active_doc_ids", "active_subjects", "updated_at")


def reply_states(spark, d):
    """Replies as structured results: one result per turn, its first sentences as notes."""
    t = turns(spark, d)
    note = F.transform(
        F.slice(F.split("assistant_answer", r"\. "), 1, 3),
        lambda x, i: F.struct(
            F.concat(F.lit("ev"), F.col("turn_index"), F.lit("_"), i % 2).alias("evidence_id"),
            F.lit("").alias("source_evidence_id"), F.element_at(F.array(F.lit("doc1"), F.lit("doc2")), i % 2 + 1).alias("doc_id"),
            F.when(i == 2, F.concat(F.lit("unsupported "), x)).otherwise(x).alias("note"),
        ),
    )
    status = F.element_at(F.array(F.lit("complete"), F.lit("partial"), F.lit("failed")), (F.col("turn_index") % 3 + 1).cast("int"))
    result = F.struct(
        status.alias("status"), F.col("user_query").alias("task"), F.col("domain").alias("slot"),
        F.col("assistant_answer").alias("result"), F.lit("").alias("basis"),
        F.transform(note, lambda n: n["evidence_id"]).alias("evidence_ids"), note.alias("evidence_notes"),
    )
    return t.groupBy(F.col("session_id").alias("state_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn_index", result.alias("r")))), lambda x: x["r"]).alias("results")
    )


NOTES_SQL = f"""{TURNS_SQL},
parts AS (SELECT session_id, turn_index, user_query, unnest(string_split(assistant_answer, '. ')) AS x, generate_subscripts(string_split(assistant_answer, '. '), 1) - 1 AS i FROM t
  WHERE turn_index % 3 < 2),
nt AS (SELECT session_id AS state_id, turn_index, i, 'ev' || turn_index || '_' || (i % 2) AS evidence_id, 'doc' || (i % 2 + 1) AS doc_id,
  {clip_sql('user_query', 100)} AS subject, {clip_sql('user_query', 120)} AS slot, {clip_sql('x', 220)} AS evidence_summary,
  CASE WHEN turn_index % 3 = 0 THEN 'useful' ELSE 'partial' END AS evidence_status FROM parts WHERE i < 2)"""


@query(
    "j5_facts",
    f"""WITH {TURNS_SQL}, f AS (SELECT session_id AS state_id, turn_index, {clip_sql('user_query', 120)} AS subject, {clip_sql('assistant_answer', 420)} AS fact FROM t
      WHERE turn_index % 3 < 2 AND {SQ.format('assistant_answer')} <> '')
    SELECT state_id, fact_no, subject, fact FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY turn_index) AS fact_no FROM f) WHERE fact_no <= 12""",
)
def j5_facts(spark, d):
    return M.facts_of(reply_states(spark, d)).select("state_id", "fact_no", "subject", "fact")


@query(
    "j5_memories",
    f"""WITH {NOTES_SQL}, u AS (SELECT state_id, evidence_id, doc_id, subject, slot, min(turn_index * 10 + i) AS o,
      arg_min(evidence_summary, turn_index * 10 + i) AS evidence_summary, arg_min(evidence_status, turn_index * 10 + i) AS evidence_status
      FROM nt WHERE evidence_summary <> '' GROUP BY ALL)
    SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY o) AS memory_no FROM u) WHERE memory_no <= 20""",
)
def j5_memories(spark, d):
    return M.memories_of(reply_states(spark, d))


UPSERT_SQL = f"""WITH {MEMORY_SQL}
    SELECT session_id, evidence_id, subject, slot, arg_max(doc_id, source_turn) AS doc_id, arg_max(evidence_summary, source_turn) AS evidence_summary,
      arg_max(evidence_status, source_turn) AS evidence_status, max(source_turn) AS source_turn, max(last_used_at) AS last_used_at,
      {{uses}} AS use_count, min(created_at) AS created_at FROM mem GROUP BY session_id, evidence_id, subject, slot"""


@query(
    "j6_upsert_memory",
    UPSERT_SQL.format(uses="CAST(sum(CASE WHEN source_turn <= 2 THEN use_count ELSE 1 END) AS BIGINT)"),
)
def j6(spark, d):
    m = memory(spark, d)
    return M.upsert_memory(m.filter("source_turn <= 2"), m.filter("source_turn > 2"))


@query("j6_memory_aggregate", UPSERT_SQL.format(uses="count(*)"))
def j6_stream_plan(spark, d):
    """The plan of the memory stream, run over the whole table at once."""
    return memory_stream(memory(spark, d))


@query(
    "j7_mark_used",
    f"""WITH {MEMORY_SQL}, u AS (SELECT session_id, id, count(*) AS n FROM (SELECT session_id, id FROM mem WHERE use_count = 1
      UNION ALL SELECT session_id, id FROM mem WHERE source_turn = 1) GROUP BY ALL)
    SELECT mem.id, use_count + coalesce(n, 0) AS use_count, CASE WHEN n IS NULL THEN last_used_at ELSE '2024-02-01T00:00:00' END AS last_used_at
    FROM mem LEFT JOIN u ON u.session_id = mem.session_id AND u.id = mem.id""",
)
def j7(spark, d):
    m = memory(spark, d)
    used = m.filter("use_count = 1").unionByName(m.filter("source_turn = 1"))
    return M.mark_used(m, used, "2024-02-01T00:00:00").select("id", "use_count", "last_used_at")


@query(
    "j8_expire",
    f"""WITH {MEMORY_SQL}, old AS (SELECT id, session_id, source_turn - 45 AS source_turn, use_count FROM mem), n AS (SELECT session_id, count(*) + 2 AS n FROM t GROUP BY session_id)
    SELECT id FROM old JOIN n ON n.session_id = old.session_id WHERE use_count > 1 OR source_turn > greatest(0, n - 50)""",
)
def j8(spark, d):
    """Notes moved 45 turns back, so that some fall behind the cut."""
    m = memory(spark, d).withColumn("source_turn", F.col("source_turn") - 45)
    t = turns(spark, d).select("session_id")
    extra = t.distinct().withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))).select("session_id")
    return M.expire(m, t.unionByName(extra)).select("id")


@query(
    "j9_summaries",
    f"""WITH {TURNS_SQL}, l AS (SELECT session_id, turn_index, ceil(turn_index / 4) AS b, 'Turn ' || turn_index || ': query=' || {clip_sql('user_query', 160)}
      || '; domain=' || domain || '; docs=' || array_to_string(doc_ids, ',') || '; answer=' || {clip_sql('assistant_answer', 360)} AS line FROM t),
    f AS (SELECT session_id, string_agg(line, ' ' ORDER BY turn_index) AS s, max(turn_index) AS n FROM (
      SELECT *, count(*) OVER (PARTITION BY session_id, b) AS c FROM l) WHERE c = 4 GROUP BY session_id)
    SELECT session_id, {clip_sql('s', 2500)} AS global_summary FROM f""",
)
def j9(spark, d):
    return M.summaries(turns(spark, d))


ROUTES_SQL = """
rt AS (SELECT session_id, arg_max(user_query, turn_index) AS q, count(*) AS turn_count, [min(string_split(user_query, ' ')[1])] AS subj FROM t GROUP BY session_id)"""


def routes(spark, d):
    t = turns(spark, d).groupBy("session_id").agg(
        F.max_by("user_query", "turn_index").alias("standalone_query"), F.count("*").alias("turn_count"),
        F.array(F.min(F.substring_index("user_query", " ", 1))).alias("memory_subjects"),
    )
    return t.select(
        "*", F.lit("").alias("current_query"), F.lit("followup_same_scope").alias("query_type"), F.lit("active_docs_only").alias("retrieval_scope"),
        F.array(F.lit("doc1"), F.lit("doc2"), F.lit("doc3")).alias("active_doc_ids"),
    )


TERMS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{2,}}')), lambda w: w NOT IN ('the','and','for','with','this','that','what','which','how','why') AND NOT regexp_matches(w, '^(pack|text)'))"
TEMP_SQL = f"""{MEMORY_SQL}, {ROUTES_SQL},
jt AS (SELECT mem.*, rt.turn_count, contains(mem.subject, rt.subj[1]) OR contains(rt.subj[1], mem.subject) AS sm,
  {TERMS.format(clip_sql('rt.q', 600))} AS a, {TERMS.format("mem.slot || ' ' || mem.evidence_summary")} AS b
  FROM mem JOIN rt ON rt.session_id = mem.session_id),
tp AS (SELECT *, CASE WHEN evidence_status NOT IN ('useful', 'partial') THEN 'cold'
  WHEN sm AND (len(a) = 0 OR list_has_any(a, b)) AND (greatest(0, turn_count - source_turn) <= 4 OR use_count >= 2) THEN 'hot'
  WHEN sm AND greatest(0, turn_count - source_turn) <= 12 THEN 'warm' ELSE 'cold' END AS temperature FROM jt)"""


@query("j10_temperature", f"WITH {TEMP_SQL} SELECT id, temperature FROM tp")
def j10(spark, d):
    return M.temperature(memory(spark, d), routes(spark, d)).select("id", "temperature")


@query(
    "j11_select_memory",
    f"""WITH {TEMP_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_used_at DESC, id DESC) AS nw FROM tp
      WHERE evidence_status IN ('useful', 'partial')),
    u AS (SELECT *, row_number() OVER (PARTITION BY session_id, evidence_id ORDER BY nw) AS dup FROM h WHERE nw <= 24 AND temperature = 'hot' AND doc_id IN ('doc1', 'doc2', 'doc3'))
    SELECT session_id, id, pick FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY nw) AS pick FROM u WHERE dup = 1) WHERE pick <= 8""",
)
def j11(spark, d):
    return M.select_memory(memory(spark, d), routes(spark, d)).select("session_id", "id", "pick")


@query(
    "j12_memory_context",
    f"""WITH {TURNS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS n FROM t),
    tl AS (SELECT session_id, string_agg('User: ' || {clip_sql('user_query', 220)} || CASE WHEN len(doc_ids) > 0 THEN ', docs=' || array_to_string(doc_ids, ',') ELSE '' END
      || chr(10) || 'Assistant: ' || {clip_sql('assistant_answer', 420)}, chr(10) ORDER BY turn_index) AS v FROM n WHERE n <= 4 GROUP BY session_id),
    fl AS (SELECT session_id, string_agg(domain || ': ' || {clip_sql('assistant_answer', 260)}, '; ' ORDER BY n DESC) FILTER ({SQ.format('assistant_answer')} <> '') AS v
      FROM n WHERE n <= 12 GROUP BY session_id)
    SELECT tl.session_id, CASE WHEN fl.v IS NULL THEN '' ELSE 'Known facts: ' || fl.v || chr(10) END || 'Recent turns:' || chr(10) || tl.v AS memory_context
    FROM tl LEFT JOIN fl ON fl.session_id = tl.session_id""",
)
def j12(spark, d):
    t = turns(spark, d)
    facts = t.select("id", "session_id", F.col("domain").alias("subject"), F.col("assistant_answer").alias("fact"))
    state = M.session_state(sessions(spark, d), t, facts, memory(spark, d))
    return M.memory_context(state).filter("memory_context <> ''")


@query(
    "j13_classify_turns",
    f"""WITH {TURNS_SQL}, k AS (SELECT session_id, turn_index, {SQ.format('user_query')} AS s FROM t),
    m AS (SELECT *, regexp_replace(lower(s), '[\\s,.;:!?、，。；：！？]+', '', 'g') AS key FROM k)
    SELECT session_id, turn_index, length(s) <= 24 AS contextual, false AS expansion,
      CASE WHEN key = 'help' THEN 'help' WHEN length(key) <= 24 AND regexp_matches(key, 'hello|hi') THEN 'local_chat' ELSE 'knowledge' END AS intent FROM m""",
)
def j13(spark, d):
    return M.classify_turns(turns(spark, d)).select("session_id", "turn_index", "contextual", "expansion", "intent")


def quota_events(spark, d):
    return table(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("ts"), "event_id")


@query(
    "j14_quota",
    """WITH RECURSIVE ev AS (SELECT user_id % 20 AS user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t,
      row_number() OVER (PARTITION BY user_id % 20 ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, t, rn, true AS admitted, [t] AS st FROM ev WHERE rn = 1
      UNION ALL
      SELECT e.user_id, e.event_id, e.t, e.rn, len(list_filter(f.st, lambda x: x >= e.t - 3600)) < 1,
        CASE WHEN len(list_filter(f.st, lambda x: x >= e.t - 3600)) < 1 THEN list_append(list_filter(f.st, lambda x: x >= e.t - 3600), e.t)
          ELSE list_filter(f.st, lambda x: x >= e.t - 3600) END
      FROM f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT user_id, event_id, t AS ts, admitted FROM f""",
)
def j14(spark, d):
    return U.quota(quota_events(spark, d).withColumn("user_id", F.col("user_id") % 20), 1)


@query(
    "j15_lockout",
    """WITH RECURSIVE ev AS (SELECT user_id % 5 AS u, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type NOT IN ('error', 'view', 'click') AS ok,
      row_number() OVER (PARTITION BY user_id % 5 ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS rn FROM events),
    f AS (SELECT u, event_id, t, rn, ok, false AS locked, CASE WHEN ok THEN 0 ELSE 1 END AS n, CASE WHEN ok THEN 0 ELSE t END AS s FROM ev WHERE rn = 1
      UNION ALL
      SELECT e.u, e.event_id, e.t, e.rn, e.ok, f.n >= 5 AND e.t - f.s < 900,
        CASE WHEN f.n >= 5 AND e.t - f.s < 900 THEN f.n WHEN e.ok THEN 0 WHEN f.n = 0 OR e.t - f.s >= 900 THEN 1 ELSE f.n + 1 END,
        CASE WHEN f.n >= 5 AND e.t - f.s < 900 THEN f.s WHEN e.ok THEN 0 WHEN f.n = 0 OR e.t - f.s >= 900 THEN e.t ELSE f.s END
      FROM f JOIN ev e ON e.u = f.u AND e.rn = f.rn + 1)
    SELECT u AS username, event_id, t AS ts, locked FROM f""",
)
def j15(spark, d):
    """Signups and purchases stand for successful logins of five accounts, all other events for failures."""
    events = table(spark, d, "events").select(
        (F.col("user_id") % 5).alias("username"), F.unix_timestamp("ts").alias("ts"), "event_id",
        (~F.col("event_type").isin("error", "view", "click")).alias("ok"),
    )
    return U.lockout(events).select("username", "event_id", "ts", "locked")


@query(
    "j16_claim",
    f"WITH {SESSIONS_SQL} SELECT session_id, title FROM ss WHERE coalesce(owner_id, 'u1') = 'u1'",
)
def j16(spark, d):
    return M.owned(M.claim_unowned(sessions(spark, d), "u1"), "u1").select("session_id", "title")


@query(
    "j17_sessions_upsert",
    f"""WITH {TURNS_SQL}, {SESSIONS_SQL}, one AS (SELECT session_id, min(user_query) AS q FROM t GROUP BY session_id HAVING count(*) = 1)
    SELECT ss.session_id, CASE WHEN one.q IS NOT NULL AND (conv_id % 2 = 0 OR conv_id % 5 = 0) THEN {clip_sql('one.q', 80)} WHEN conv_id % 5 = 0 THEN ss.session_id ELSE title END AS title
    FROM ss LEFT JOIN one ON one.session_id = ss.session_id""",
)
def j17(spark, d):
    """A fifth of the sessions is missing and added; then sessions with one turn get their query as title."""
    every, t = sessions(spark, d), turns(spark, d)
    known = every.filter(F.substring("session_id", 2, 9).cast("int") % 5 != 0)
    merged = M.sessions_upsert(known, every, "2024-02-01T00:00:00")
    return M.rename_sessions(merged, M.default_titles(merged, t), "2024-02-02T00:00:00").select("session_id", "title")
