"""Secret scan over a trigram inverted index (operator 5)."""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import keep, let, spans_of
from leafscan.session import small

MAX_STRINGS = 64  # literal alternatives followed at once; beyond, a part demands nothing
MASK_BITS = 60  # trigrams per column of bits


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern read alike by Java and Python, and what a match must fulfil."""

    kind: str
    pattern: str
    least: int = 1  # characters of ``group``; a shorter match is dropped
    group: int = 0


# The base rules. A run of hex digits is matched from 24 on, which finds the same runs.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# A query is a list of alternatives; an alternative is the set of trigrams it demands. An empty set demands nothing.
Query = list[frozenset[str]]
ANY: Query = [frozenset()]


def simplest(query: Query) -> Query:
    """Without alternatives that another, weaker one includes."""
    out: Query = []
    for clause in sorted(set(query), key=lambda c: (len(c), sorted(c))):
        if not any(c <= clause for c in out):
            out.append(clause)
    return out if len(out) <= MAX_STRINGS else ANY


def both(a: Query, b: Query) -> Query:
    return simplest([x | y for x in a for y in b])


def of_strings(strings: set[str]) -> Query:
    return simplest([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def demanded(pattern: str) -> Query:
    """Boolean trigram query, over lower-cased text, that every text with a match of ``pattern`` fulfils."""
    exact, query = _sequence(parser.parse(pattern))
    return both(query, of_strings(exact)) if exact is not None else query


def _sequence(items) -> tuple[set[str] | None, Query]:
    """The strings a sequence can match if they are few, else None; and what it demands beside those."""
    run, query, whole = {""}, ANY, True
    for op, value in items:
        exact, more = _item(op, value)
        query = both(query, more)
        if exact is not None and len(run) * len(exact) <= MAX_STRINGS:
            run = {a + b for a in run for b in exact}
            continue
        query = both(query, of_strings(run))
        run, whole = exact if exact is not None else {""}, False
    return (run, query) if whole else (None, both(query, of_strings(run)))


def _item(op, value) -> tuple[set[str] | None, Query]:
    if op is ops.LITERAL:
        return {chr(value).lower()}, ANY
    if op is ops.SUBPATTERN:
        return _sequence(value[3])
    if op is ops.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        if all(exact is not None and query == ANY for exact, query in parts):
            return set().union(*[exact for exact, _ in parts]), ANY
        return None, simplest([c for exact, query in parts for c in (both(query, of_strings(exact)) if exact is not None else query)])
    if op is ops.IN and all(kind is ops.LITERAL for kind, _ in value) and len(value) <= 8:
        return {chr(c).lower() for _, c in value}, ANY
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        least, most, inner = value
        exact, query = _sequence(inner)
        if (least, most) == (0, 1) and exact is not None and query == ANY:
            return exact | {""}, ANY
        if least:
            return None, both(query, of_strings(exact)) if exact is not None else query
    return None, ANY


def postings(bodies: DataFrame, trigrams: list[str]) -> DataFrame:
    """Inverted index ``trigram, key`` of the wanted trigrams over lower-cased texts."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    present = let(F.lower("body"), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))
    return bodies.select("key", F.explode(present).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, Query], trigrams: list[str]) -> DataFrame:
    """``key`` and a flag per rule: the keys whose posting lists fulfil the rule's query."""
    place = {t: i for i, t in enumerate(trigrams)}
    number = F.col("place")
    numbers = reduce(lambda c, t: c.when(F.col("trigram") == t, place[t]), trigrams[1:], F.when(F.col("trigram") == trigrams[0], 0))
    columns = range((len(trigrams) + MASK_BITS - 1) // MASK_BITS)
    bits = [
        F.bit_or(F.when((number >= k * MASK_BITS) & (number < (k + 1) * MASK_BITS), F.expr(f"shiftleft(1L, place - {k * MASK_BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}")
        for k in columns
    ]
    masks = index.select("key", numbers.alias("place")).groupBy("key").agg(*bits)

    def fulfilled(query: Query) -> Column:
        def clause(c: frozenset[str]) -> Column:
            parts = []
            for k in columns:
                mask = sum(1 << (place[t] - k * MASK_BITS) for t in c if place[t] // MASK_BITS == k)
                if mask:
                    parts.append(F.col(f"bits{k}").bitwiseAND(F.lit(mask)) == mask)
            return reduce(lambda a, b: a & b, parts)

        return reduce(lambda a, b: a | b, [clause(c) for c in query])

    flags = masks.select("key", *[fulfilled(q).alias(f"has_{kind}") for kind, q in queries.items()])
    return flags.filter(reduce(lambda a, b: a | b, [F.col(f"has_{kind}") for kind in queries]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", order: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``found``: array<struct<start, rank, end>> by start, then by the place of the rule in ``rules``.

    Rules that demand trigrams run only on the texts that the index allows;
    rules without mandatory trigrams scan every text. Texts are named by a
    64-bit hash: two texts that share one only make each other candidates.
    """
    queries = {r.kind: demanded(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q != ANY}
    trigrams = sorted({t for q in indexed.values() for c in q for t in c})
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(order).alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("key"))
    if indexed:
        index = keep(postings(rows.select("key", "body"), trigrams), "trigram-index")
        rows = rows.join(small(keep(candidates(index, indexed, trigrams), "secret-candidates")), "key", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    spans = []
    for rank, rule in enumerate(rules):
        found = kept(F.col("body"), rule, rank)
        spans.append(F.when(F.col(f"has_{rule.kind}"), found).otherwise(none) if rule.kind in indexed else found)
    return rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def kept(body: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule whose decisive group is long enough."""
    value = (lambda s: F.regexp_extract(s["value"], rule.pattern, rule.group)) if rule.group else (lambda s: s["value"])
    spans = F.filter(spans_of(body, rule.pattern), lambda s: F.length(value(s)) >= rule.least)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def secrets(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    ``spans`` lists every span as kind:start:end, by start, then by the order
    of the rules, joined by commas; ``base_sha256`` is the digest of that list
    with the three base kinds only. Positions count code points, ends are
    exclusive. Null counts as empty and has no spans; repeated rows each get a
    row, an empty table none; extra columns are ignored.
    """
    rules = BASE + MORE
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def listed(found: Column) -> Column:
        return F.array_join(
            F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    found = F.col("found")
    counts = [F.size(F.filter(found, lambda s: s["rank"] == rank)).cast("long").alias(f"n_{rule.kind}") for rank, rule in enumerate(BASE)]
    base = F.filter(found, lambda s: s["rank"] < len(BASE))
    return scan(docs, rules, text, order).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(found).alias("spans"))
