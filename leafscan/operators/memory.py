"""Conversation memory as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import text as X

WINDOW_SIZE = 4
COMPRESS_EVERY = 4
MAX_SUMMARY_CHARS = 2500
MAX_FACTS = 12
MAX_EVIDENCE = 8
MAX_NOTE_CHARS = 220
HOT_TURNS = 4
COLD_TURNS = 12
DELETE_AFTER_TURNS = 50
USABLE = ("useful", "partial")


def last_n(df: DataFrame, keys: list[str], n: int, *newest_first: Column) -> DataFrame:
    """Newest n rows per group with their place among them, oldest first.

    The rank filter is pushed below the shuffle, so a group of any size sends
    at most n rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("newest", F.row_number().over(w)).filter(F.col("newest") <= n)


# --- J1-J4, J16, J17 --------------------------------------------------------


def owned(df: DataFrame, owner_id: str | None) -> DataFrame:
    """Rows of one owner; without an owner all rows."""
    return df if owner_id is None else df.filter(F.col("owner_id") == owner_id)


def claim_unowned(df: DataFrame, owner_id: str) -> DataFrame:
    """One-off claim of rows nobody owns."""
    return df.withColumn("owner_id", F.coalesce("owner_id", F.lit(owner_id)))


def list_sessions(sessions: DataFrame, turns: DataFrame, owner_id: str | None = None) -> DataFrame:
    """Sessions with turn count and last activity, newest first."""
    counts = turns.groupBy("session_id").agg(F.count("*").alias("turn_count"), F.max("created_at").alias("last_turn_at"))
    return (
        owned(sessions, owner_id)
        .join(counts, "session_id", "left")
        .orderBy(F.desc("updated_at"), F.desc("created_at"), "session_id")
        .select(
            "session_id",
            F.coalesce(X.falsy_null("title"), "session_id").alias("title"),
            F.coalesce("active_domain", F.lit("")).alias("active_domain"),
            F.coalesce("turn_count", F.lit(0)).alias("turn_count"),
            F.coalesce("created_at", F.lit("")).alias("created_at"),
            F.coalesce(X.falsy_null("last_turn_at"), "updated_at", F.lit("")).alias("updated_at"),
        )
    )


def session_state(sessions: DataFrame, turns: DataFrame, facts: DataFrame, memory: DataFrame) -> DataFrame:
    """Per session the last turns, facts and usable evidence, each oldest first."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c not in ("session_id", "newest")]
        rows = F.array_sort(F.collect_list(F.struct((-F.col("newest")).alias("ord"), *cols)))
        return df.groupBy("session_id").agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in cols])).alias(name))

    recent = last_n(turns, ["session_id"], WINDOW_SIZE, F.desc("turn_index"))
    known = last_n(facts, ["session_id"], MAX_FACTS, F.desc("id"))
    usable = memory.filter(F.col("evidence_status").isin(*USABLE))
    kept = last_n(usable, ["session_id"], MAX_EVIDENCE * 3, F.desc("last_used_at"), F.desc("id"))
    counts = turns.groupBy("session_id").agg(F.count("*").alias("turn_count"))
    return (
        sessions.join(counts, "session_id", "left")
        .join(packed(recent, "turn_window"), "session_id", "left")
        .join(packed(known, "facts"), "session_id", "left")
        .join(packed(kept, "evidence_memory"), "session_id", "left")
        .withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))
    )


def next_turn(turns: DataFrame) -> DataFrame:
    """The next free turn index per session."""
    return turns.groupBy("session_id").agg((F.coalesce(F.max("turn_index"), F.lit(0)) + 1).alias("next_turn"))


def number_turns(turns: DataFrame, new: DataFrame, order: str = "created_at", bucket: Column | None = None) -> DataFrame:
    """J3 in bulk: turn indexes for ``new(session_id, order, ..)`` after the stored ones.

    Rows are ranked inside time buckets and shifted by the rows of earlier
    buckets, so one very busy session is spread over many tasks.
    """
    bucket = bucket if bucket is not None else F.substring(order, 1, 13)
    rows = new.withColumn("_bucket", bucket)
    sizes = rows.groupBy("session_id", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("session_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("session_id", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("session_id", "_bucket").orderBy(order))
    return (
        rows.withColumn("_rank", rank)
        .join(shift, ["session_id", "_bucket"])
        .join(next_turn(turns), "session_id", "left")
        .withColumn("turn_index", (F.coalesce("next_turn", F.lit(1)) - 1 + F.col("_shift") + F.col("_rank")).cast("int"))
        .drop("_bucket", "_rank", "_shift", "next_turn")
    )


def append_turns(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Session rows after numbered turns: last domain, last non-empty documents and subjects."""

    def latest(col: str) -> Column:
        return F.max_by(col, F.when(F.size(col) > 0, F.col("turn_index")))

    last = new.groupBy("session_id").agg(
        F.max_by("domain", "turn_index").alias("_domain"),
        latest("doc_ids").alias("_docs"),
        latest("subjects").alias("_subjects"),
        F.max("created_at").alias("_at"),
    )
    kept = [c for c in sessions.columns if c not in ("active_domain", "active_doc_ids", "active_subjects", "updated_at")]
    return sessions.join(last, "session_id", "left").select(
        *kept,
        F.coalesce("_domain", "active_domain").alias("active_domain"),
        F.coalesce("_docs", "active_doc_ids").alias("active_doc_ids"),
        F.coalesce("_subjects", "active_subjects").alias("active_subjects"),
        F.coalesce("_at", "updated_at").alias("updated_at"),
    )


def sessions_upsert(sessions: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Add missing sessions, titled by their id."""
    fresh = new.select("session_id").distinct().join(sessions, "session_id", "left_anti")
    added = fresh.select("session_id", F.col("session_id").alias("title"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return sessions.unionByName(added, allowMissingColumns=True)


def rename_sessions(sessions: DataFrame, titles: DataFrame, now: str) -> DataFrame:
    """New titles, clipped to 80 characters; an empty one falls back to the id."""
    wanted = titles.select("session_id", F.col("title").alias("_title"))
    clean = F.coalesce(X.falsy_null(X.clip("_title", 80)), F.col("session_id"))
    renamed = F.col("_title").isNotNull()
    return sessions.join(wanted, "session_id", "left").select(
        *[c for c in sessions.columns if c not in ("title", "updated_at")],
        F.when(renamed, clean).otherwise(F.col("title")).alias("title"),
        F.when(renamed, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def default_titles(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Titles for sessions still named by their id after exactly one turn: its query."""
    one = turns.groupBy("session_id").agg(F.count("*").alias("n"), F.min_by("user_query", "turn_index").alias("title")).filter("n = 1")
    return sessions.filter(F.col("title") == F.col("session_id")).select("session_id").join(one.drop("n"), "session_id")


# --- J5 ----------------------------------------------------------------------

# Slots naming a subject, and wording that makes a note useless.
SUBJECT_SLOTS = ("主体", "对象", "领域", "行业", "公司", "产品", "案例")
NEGATIVE_NOTES = (
    "未涉及", "无关", "不能支持", "无法支持", "证据不足", "未提供", "不属于", "不能用于", "不匹配",
    "未找到", "无法确认", "无法判断", "需重新检索", "需要重新检索", "待检索确认", "证据缺失",
    "irrelevant", "not relevant", "unsupported",
)


def either(*cols: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[X.falsy_null(c) for c in cols], F.lit(""))


def subjects_of(states: DataFrame) -> DataFrame:
    """Up to 12 subjects of ``states(state_id, entities, tasks)``: entities, then named facts."""
    entities = F.filter(F.transform("entities", lambda e: X.clip(e, 40)), lambda e: F.length(e).between(2, 40))
    facts = F.flatten(F.transform("tasks", lambda t: t["known_facts"]))
    named = F.filter(
        F.transform(facts, lambda f: F.struct(X.clip(f["slot"], 80).alias("slot"), X.clip(f["value"], 80).alias("value"))),
        lambda f: (f["value"] != "") & f["slot"].rlike("|".join(SUBJECT_SLOTS)),
    )
    both = F.concat(entities, F.transform(named, lambda f: f["value"]))
    return states.select("state_id", F.slice(F.array_distinct(both), 1, 12).alias("subjects"))


def facts_of(states: DataFrame, n: int = 12) -> DataFrame:
    """Usable results of ``states(state_id, results)`` as facts, in order."""
    rows = states.select("state_id", F.posexplode("results").alias("pos", "r")).filter(F.col("r.status").isin("complete", "partial"))
    fact = X.clip(either(F.col("r.result"), F.col("r.basis")), 420)
    rows = rows.select(
        "state_id", "pos", X.clip(either(F.col("r.task"), F.col("r.slot")), 120).alias("subject"), fact.alias("fact"),
        F.slice("r.evidence_ids", 1, 6).alias("evidence_ids"),
    ).filter("fact <> ''")
    order = F.row_number().over(Window.partitionBy("state_id").orderBy("pos"))
    return rows.withColumn("fact_no", order).filter(F.col("fact_no") <= n).drop("pos")


def memories_of(states: DataFrame, n: int = 20) -> DataFrame:
    """Evidence notes worth keeping, one per (evidence, document, subject, slot)."""
    results = states.select("state_id", F.posexplode("results").alias("pos", "r")).filter(F.col("r.status").isin("complete", "partial"))
    notes = results.select("state_id", "pos", "r", F.posexplode("r.evidence_notes").alias("npos", "note"))
    task = either(F.col("r.task"), F.col("r.slot"))
    named = F.regexp_extract(X.clip("note.note", 420), r"主体=([^；。\n]{1,80})", 1)
    rows = notes.select(
        "state_id", "pos", "npos",
        X.clip(either(F.col("note.source_evidence_id"), F.col("note.evidence_id")), 120).alias("evidence_id"),
        X.clip("note.doc_id", 80).alias("doc_id"),
        F.when(named != "", X.clip(named, 80)).otherwise(X.clip(task, 100)).alias("subject"),
        X.clip(task, 120).alias("slot"),
        X.clip("note.note", MAX_NOTE_CHARS).alias("evidence_summary"),
        F.when(F.col("r.status") == "complete", "useful").otherwise("partial").alias("evidence_status"),
    ).filter((F.col("evidence_id") != "") & (F.col("evidence_summary") != "") & ~F.col("evidence_summary").rlike("|".join(NEGATIVE_NOTES)))
    key = ["state_id", "evidence_id", "doc_id", "subject", "slot"]
    first = rows.groupBy(*key).agg(F.min_by(F.struct("pos", "npos", "evidence_summary", "evidence_status"), F.struct("pos", "npos")).alias("f"))
    order = F.row_number().over(Window.partitionBy("state_id").orderBy("f.pos", "f.npos"))
    return first.withColumn("memory_no", order).filter(F.col("memory_no") <= n).select(*key, "f.evidence_summary", "f.evidence_status", "memory_no")


# --- J6-J9 ---------------------------------------------------------------------

MEMORY_KEY = ("session_id", "evidence_id", "subject", "slot")


def upsert_memory(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Merge new notes by key: newest fields win, every new note adds one use.

    Both sides are aggregated in one pass, map side first.
    """
    cols = ["doc_id", "evidence_summary", "evidence_status", "source_turn", "last_used_at"]
    old = memory.select(*MEMORY_KEY, *cols, "use_count", "created_at", F.lit(0).alias("_new"))
    added = new.select(*MEMORY_KEY, *cols, F.lit(1).alias("use_count"), F.col("last_used_at").alias("created_at"), F.lit(1).alias("_new"))
    newest = F.max_by(F.struct(*cols), F.struct("_new", "source_turn", "last_used_at", "evidence_summary"))
    merged = old.unionByName(added).groupBy(*MEMORY_KEY).agg(
        newest.alias("n"), F.sum("use_count").alias("use_count"), F.min("created_at").alias("created_at")
    )
    return merged.select(*MEMORY_KEY, "n.*", "use_count", "created_at")


def mark_used(memory: DataFrame, used: DataFrame, now: str) -> DataFrame:
    """Count every mention in ``used(session_id, id)`` as one more use."""
    uses = used.groupBy("session_id", "id").agg(F.count("*").alias("_uses"))
    hit = F.col("_uses").isNotNull()
    return memory.join(uses, ["session_id", "id"], "left").select(
        *[c for c in memory.columns if c not in ("use_count", "last_used_at")],
        (F.col("use_count") + F.coalesce("_uses", F.lit(0))).alias("use_count"),
        F.when(hit, F.lit(now)).otherwise(F.col("last_used_at")).alias("last_used_at"),
    )


def expire(memory: DataFrame, turns: DataFrame) -> DataFrame:
    """Drop rows used at most once whose source turn lies 50 or more turns back."""
    counts = turns.groupBy("session_id").agg(F.count("*").alias("_turns"))
    cutoff = F.greatest(F.lit(0), F.coalesce("_turns", F.lit(0)) - DELETE_AFTER_TURNS)
    kept = (F.col("use_count") > 1) | (F.col("source_turn") > cutoff)
    return memory.join(counts, "session_id", "left").filter(kept).drop("_turns")


def reset(df: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Rows without those of the given sessions."""
    return df.join(session_ids.select("session_id"), "session_id", "left_anti")


TURN_CHARS = len("Turn 1: query=; domain=; docs=; answer=")


def summaries(turns: DataFrame) -> DataFrame:
    """Running summary after every fourth turn, cut at 2500 characters.

    Cutting keeps the beginning. A turn line has at least ``TURN_CHARS``
    characters, so only the first turns of complete blocks, by their rank and
    not their number, can change a summary; the rank limit prunes map-side.
    """
    deciding = MAX_SUMMARY_CHARS // TURN_CHARS + 1
    docs = F.array_join(F.slice("doc_ids", 1, 6), ",")
    line = F.concat(
        F.lit("Turn "), F.col("turn_index").cast("string"), F.lit(": query="), X.clip("user_query", 160),
        F.lit("; domain="), F.coalesce("domain", F.lit("")), F.lit("; docs="), docs,
        F.lit("; answer="), X.clip("assistant_answer", 360),
    )
    block = F.ceil(F.col("turn_index") / COMPRESS_EVERY)
    complete = F.max("turn_index").alias("last_turn")
    lasts = turns.groupBy("session_id").agg(complete)
    rows = turns.select("session_id", "turn_index", block.alias("block"), line.alias("line"))
    rows = rows.join(lasts, "session_id").filter(F.col("block") * COMPRESS_EVERY <= F.col("last_turn")).drop("last_turn")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= deciding).drop("rank")
    blocks = rows.groupBy("session_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "line"))), lambda x: x["line"]), " ").alias("text")
    )
    folded = F.aggregate(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]),
        F.lit(""),
        lambda acc, text: X.clip(F.concat_ws(" ", X.falsy_null(acc), text), MAX_SUMMARY_CHARS),
    )
    return blocks.groupBy("session_id").agg(folded.alias("global_summary"))


# --- J10, J11, D19 --------------------------------------------------------------

# Words memory terms leave out.
MEMORY_STOPWORDS = (
    "什么", "哪些", "哪个", "怎么", "如何", "是否", "有没有", "是不是", "区别", "不同", "相同", "比较",
    "判断", "说明", "依据", "它们", "他们", "这些", "那些", "这个", "那个", "上文", "当前", "问题",
    "研报", "报告", "文档", "条款", "规定", "合同", "主体", "对象", "相关", "信息", "情况",
    "the", "and", "for", "with", "this", "that", "what", "which", "how", "why",
)


def memory_terms(col: Column | str) -> Column:
    """Latin words, short CJK runs and all 2- to 6-grams, without stop words and ids."""
    t = F.lower(X.clip(col, 1200))
    t = F.regexp_replace(t, r"(?U)\bpack\d+_text\d+(?:_[a-z]{1,4}_\d+)?\b", " ")
    t = F.regexp_replace(t, r"(?U)\b[a-z]+_[ab]_\d{3}(?:_[a-d])?\b", " ")
    words = F.filter(E.find_all(t, "[a-z0-9]{2,}"), lambda w: ~w.rlike("^(?:pack|text)"))
    chunks = E.find_all(t, f"[{X.CJK}]{{2,}}")
    grams = F.flatten(
        F.transform(
            chunks,
            lambda c: F.flatten(
                F.transform(F.sequence(F.lit(2), F.least(F.lit(6), F.length(c))), lambda n: F.transform(
                    F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))
            ),
        )
    )
    whole = F.filter(chunks, lambda c: F.length(c) <= 8)
    return F.array_except(F.concat(words, whole, grams), F.array(*[F.lit(s) for s in MEMORY_STOPWORDS]))


def _either_contains(subjects: Column, text: Column, both: bool) -> Column:
    def hit(s: Column) -> Column:
        found = F.contains(text, s)
        if both:
            found = found | F.contains(s, text)
        return (s != "") & found

    return F.exists(subjects, hit)


def temperature(memory: DataFrame, routes: DataFrame) -> DataFrame:
    """Hot, warm or cold for every stored row of the sessions in ``routes``.

    ``routes(session_id, memory_subjects, standalone_query, current_query, turn_count)``.
    """
    m = memory.join(routes.select("session_id", "memory_subjects", "standalone_query", "current_query", "turn_count"), "session_id")
    subjects = F.filter(F.transform(F.coalesce("memory_subjects", F.array().cast("array<string>")), lambda s: X.clip(s, 100)), lambda s: s != "")
    own = X.clip("subject", 300)
    hay = F.concat_ws(" ", own, *[X.clip(c, 300) for c in ("slot", "evidence_summary", "doc_id", "evidence_id")])
    subject_match = (F.size(subjects) == 0) | F.when(own != "", _either_contains(subjects, own, True)).otherwise(_either_contains(subjects, hay, False))
    asked = memory_terms(F.concat_ws(" ", *[X.falsy_null(X.clip(c, 600)) for c in ("standalone_query", "current_query")]))
    stored = memory_terms(F.concat_ws(" ", X.clip("slot", 500), X.clip("evidence_summary", 500)))
    slot_match = (F.size(asked) == 0) | F.arrays_overlap(asked, stored)
    age = F.greatest(F.lit(0), F.coalesce("turn_count", F.lit(0)) - F.coalesce("source_turn", F.lit(0)))
    hot = subject_match & slot_match & ((age <= HOT_TURNS) | (F.coalesce("use_count", F.lit(0)) >= 2))
    state = (
        F.when(~X.clip("evidence_status", 20).isin(*USABLE), "cold")
        .when(hot, "hot")
        .when(subject_match & (age <= COLD_TURNS), "warm")
        .otherwise("cold")
    )
    return m.select(*memory.columns, state.alias("temperature"))


FOLLOWUPS = ("followup_same_scope", "followup_expand_scope")
FOLLOWUP_SCOPES = ("active_docs_only", "active_docs_plus_new_search")


def select_memory(memory: DataFrame, routes: DataFrame) -> DataFrame:
    """Hot rows of follow-up turns inside the active documents, newest first, at most 8."""
    wanted = routes.filter(F.col("query_type").isin(*FOLLOWUPS) & F.col("retrieval_scope").isin(*FOLLOWUP_SCOPES))
    usable = memory.filter(F.col("evidence_status").isin(*USABLE) & (X.clip("evidence_id", 120) != ""))
    # the state keeps the newest 24 rows of a session; selection walks them newest first
    recent = last_n(usable, ["session_id"], MAX_EVIDENCE * 3, F.desc("last_used_at"), F.desc("id"))
    scoped = recent.join(wanted.select("session_id", "active_doc_ids"), "session_id").filter(
        (F.size("active_doc_ids") <= 0) | (F.coalesce("doc_id", F.lit("")) == "") | F.expr("array_contains(active_doc_ids, doc_id)")
    )
    hot = temperature(scoped, wanted).filter("temperature = 'hot'")
    first = hot.withColumn("_dup", F.row_number().over(Window.partitionBy("session_id", X.clip("evidence_id", 120)).orderBy("newest"))).filter("_dup = 1")
    pick = F.row_number().over(Window.partitionBy("session_id").orderBy("newest"))
    return first.withColumn("pick", pick).filter(F.col("pick") <= MAX_EVIDENCE).drop("_dup", "active_doc_ids", "newest", "temperature")


# --- J12, J13 --------------------------------------------------------------------


def memory_context(state: DataFrame) -> DataFrame:
    """Summary, facts and recent turns of ``session_state`` rows as one text."""
    summary = X.clip("global_summary", MAX_SUMMARY_CHARS)

    def fact_line(f: Column) -> Column:
        subject, fact = X.clip(f["subject"], 80), X.clip(f["fact"], 260)
        return F.when(fact == "", F.lit("")).otherwise(F.concat_ws(": ", X.falsy_null(subject), fact))

    def turn_line(t: Column) -> Column:
        asked, answer = X.clip(t["user_query"], 220), X.clip(t["assistant_answer"], 420)
        docs = F.when(F.size(t["doc_ids"]) > 0, F.concat(F.lit(", docs="), F.array_join(F.slice(t["doc_ids"], 1, 8), ","))).otherwise("")
        line = F.concat(F.lit("User: "), asked, docs, F.lit("\nAssistant: "), answer)
        return F.when((asked != "") | (answer != ""), line).otherwise("")

    def joined(col: str, line, sep: str, label: str) -> Column:
        items = F.filter(F.transform(F.col(col), line), lambda x: x != "")
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, sep)))

    text = F.concat_ws(
        "\n",
        F.when(summary != "", F.concat(F.lit("Long-term summary: "), summary)),
        joined("facts", fact_line, "; ", "Known facts: "),
        joined("turn_window", turn_line, "\n", "Recent turns:\n"),
    )
    return state.select("session_id", text.alias("memory_context"))


# Wording of follow-ups, of widened questions, and of small talk.
CONTEXT_MARKERS = (
    "它", "他们", "它们", "这个", "这些", "上述", "上面", "刚才", "继续", "再说", "那",
    "第二个", "前一个", "后一个", "那篇", "该文档", "这篇", "和它比", "它们的",
)
EXPANSION_MARKERS = ("再和", "相比", "对比", "另外", "新增", "换成", "加入", "扩展到", "再比较")
GREETINGS = ("你好", "您好", "hello", "hi", "嗨", "在吗")
IDENTITY = ("你是谁", "你是誰", "介绍一下你自己", "自我介绍")
HELP = ("帮助", "怎么用", "你能做什么", "help")


def any_of(col: Column, words) -> Column:
    return col.rlike("|".join(words))


def classify_turns(turns: DataFrame, query: str = "user_query") -> DataFrame:
    """Contextual and widening wording, and whether a turn needs documents at all."""
    text = X.squeeze(F.coalesce(F.col(query), F.lit("")))
    contextual = (F.length(text) <= 24) | (any_of(text, CONTEXT_MARKERS) & (F.length(text) <= 120))
    key = X.match_key(text, "intent")
    intent = (
        F.when(key.isin(*HELP), "help")
        .when((F.length(key) <= 24) & (any_of(key, GREETINGS) | any_of(key, IDENTITY)), "local_chat")
        .otherwise("knowledge")
    )
    return turns.select(
        "*",
        contextual.alias("contextual"),
        any_of(text, EXPANSION_MARKERS).alias("expansion"),
        intent.alias("intent"),
        F.when(intent == "knowledge", "knowledge_qa").otherwise("direct_answer").alias("route"),
    )


QUERY_TYPES = ("standalone", "followup_same_scope", "followup_expand_scope", "followup_switch_scope")


def normalize_routes(routes: DataFrame) -> DataFrame:
    """Legal route values and the scope each query type implies."""
    kind = F.coalesce(X.falsy_null(X.strip("query_type")), F.lit("standalone"))
    given = F.coalesce(X.falsy_null(X.strip("retrieval_scope")), F.lit("fresh_search"))
    scope = (
        F.when(kind == "followup_same_scope", "active_docs_only")
        .when(kind == "followup_expand_scope", "active_docs_plus_new_search")
        .when(kind.isin("standalone", "followup_switch_scope"), "fresh_search")
        .when(given.isin(*FOLLOWUP_SCOPES), given)
        .otherwise("fresh_search")
    )
    standalone = F.coalesce(X.falsy_null(X.clip("standalone_query", 1800)), X.clip("user_query", 1800))
    subjects = F.array_join(F.concat(X.clean_list("memory_subjects"), X.clean_list("new_subjects")), "; ")
    widened = F.when(
        (scope == "active_docs_plus_new_search") & (subjects != "") & ~F.contains(standalone, subjects),
        F.concat(standalone, F.lit("\nComparison subjects to cover: "), subjects),
    ).otherwise(standalone)
    return routes.select(
        *[c for c in routes.columns if c not in ("query_type", "retrieval_scope", "standalone_query", "use_active_docs")],
        F.when(kind.isin(*QUERY_TYPES), kind).otherwise("standalone").alias("query_type"),
        scope.alias("retrieval_scope"),
        X.clip(widened, 1800).alias("standalone_query"),
        ((F.size("active_doc_ids") > 0) & (scope == "active_docs_only")).alias("use_active_docs"),
    )


def resolve_queries(turns: DataFrame, state: DataFrame) -> DataFrame:
    """Scope of each new query given its session's state and the text handed on."""
    asked = classify_turns(turns).join(
        state.join(memory_context(state), "session_id").select(
            "session_id", "active_doc_ids", "memory_context",
            ((F.size("turn_window") > 0) | (F.coalesce("global_summary", F.lit("")) != "")).alias("has_history"),
        ),
        "session_id",
        "left",
    )
    history = F.coalesce("has_history", F.lit(False))
    followup = history & F.col("contextual")
    use_docs = followup & (F.coalesce(F.size("active_doc_ids"), F.lit(0)) > 0) & ~F.col("expansion")
    query = X.squeeze(F.coalesce(F.col("user_query"), F.lit("")))
    resolved = F.when(~history, query).otherwise(F.concat_ws("\n", X.falsy_null("memory_context"), F.concat(F.lit("Current question: "), query)))
    return asked.select(
        *turns.columns,
        resolved.alias("resolved_query"),
        followup.alias("is_followup"),
        use_docs.alias("use_active_docs"),
        F.when(use_docs, F.col("active_doc_ids")).otherwise(F.array().cast("array<string>")).alias("preferred_doc_ids"),
    )
