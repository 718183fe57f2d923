"""Secret scans through a trigram inverted index, in DataFrame operations only."""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.columns import ascii_lower, pick
from sparkweave.llm.storage import written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The first three are the base rules. ``hex`` asks for 32 characters at once, which finds the same runs.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A conjunction of trigrams; a clause, of which one conjunction must hold; a query, of which every clause must hold.
Clause = frozenset[frozenset[str]]

_MANY = 64


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings(node: tuple) -> set[str] | None:
    """All strings that a parsed piece matches, lower-cased; None if they are many or unbounded."""
    kind, value = node
    if kind is ops.LITERAL:
        return {chr(value).lower()}
    if kind is ops.IN:
        out: set[str] = set()
        for k, v in value:
            if k is ops.LITERAL:
                out.add(chr(v).lower())
            elif k is ops.RANGE and v[1] - v[0] < 8:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if kind is ops.SUBPATTERN:
        return _sequence(value[3])
    if kind is ops.BRANCH:
        each = [_sequence(x) for x in value[1]]
        return None if any(x is None for x in each) else set().union(*each)
    if kind in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[1] <= 4 and value[1] is not ops.MAXREPEAT:
        one = _sequence(value[2])
        if one is None or len(one) > 8:
            return None
        out, last = set(), {""}
        for n in range(value[1] + 1):
            out |= last if n >= value[0] else set()
            last = {a + b for a in last for b in one}
        return out
    return None


def _sequence(items: Sequence[tuple]) -> set[str] | None:
    out = {""}
    for node in items:
        one = _strings(node)
        if one is None or len(one) * len(out) > _MANY:
            return None
        out = {a + b for a in out for b in one}
    return out


def trigram_query(pattern: str) -> tuple[Clause, ...]:
    """A Boolean query over the trigrams of a lower-cased text that holds for every text with a match; empty if no trigram is mandatory."""
    clauses: set[Clause] = set()

    def flush(run: set[str]) -> None:
        each = {_trigrams(x) for x in run}
        if all(each):
            clauses.add(frozenset(x for x in each if not any(y < x for y in each)))

    def walk(items: Sequence[tuple]) -> None:
        run = {""}
        for node in items:
            one = _strings(node)
            if one is not None and len(one) * len(run) <= _MANY:
                run = {a + b for a in run for b in one}
                continue
            flush(run)
            run = {""}
            if node[0] is ops.SUBPATTERN:
                walk(node[1][3])
            elif node[0] in (ops.MAX_REPEAT, ops.MIN_REPEAT) and node[1][0] >= 1:
                walk(node[1][2])
        flush(run)

    walk(list(parser.parse(pattern)))
    return tuple(sorted(clauses, key=lambda c: sorted(map(sorted, c))))


def trigram_index(docs: DataFrame, trigrams: Sequence[str], segments: int) -> DataFrame:
    """Postings (segment, trigram, ids) for the given trigrams; a segment holds the documents of one range of a hash of doc_id, so that lists stay bounded."""
    low = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", ascii_lower(F.col("text")).alias("t"))
    found = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(x)), F.lit(x)) for x in trigrams]))
    postings = low.select(F.pmod(F.xxhash64("doc_id"), F.lit(segments)).alias("segment"), "doc_id", F.explode(found).alias("trigram"))
    return postings.groupBy("segment", "trigram").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))


def _candidates(index: DataFrame, queries: dict[str, tuple[Clause, ...]]) -> DataFrame:
    """(doc_id, kinds): documents whose postings satisfy a kind's query, by intersecting and uniting posting lists segment by segment."""
    lists = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("of"))
    none = F.array().cast("array<bigint>")

    def posting(trigram: str) -> Column:
        return F.coalesce(F.element_at("of", F.lit(trigram)), none)

    def intersect(columns: list[Column]) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = F.array_intersect(out, c)
        return out

    def answer(query: tuple[Clause, ...]) -> Column:
        clauses = []
        for clause in query:
            united = none
            for conjunction in sorted(clause, key=sorted):
                united = F.array_union(united, intersect([posting(t) for t in sorted(conjunction)]))
            clauses.append(united)
        return intersect(clauses)

    def labelled(kind: str, ids: Column) -> Column:
        return F.transform(ids, lambda i: F.struct(i.alias("doc_id"), F.lit(kind).alias("kind")))

    pairs = F.explode(F.flatten(F.array(*[labelled(k, answer(q)) for k, q in queries.items()])))
    return lists.select(pairs.alias("p")).select("p.*").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


#: Matches of one text that are worked off together. Arrays grow by copying, so a text's matches are cut into stretches of this many.
STRETCH = 512


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, rank, kind, end) by code points: the pieces between matches, and the matches, give the positions."""
    between, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = matches if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("match"), tested.alias("tested"))
    kind = "array<struct<start:int,rank:int,kind:string,end:int>>"
    taken = lambda x: F.length(x["gap"]) + F.length(x["match"])

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["tested"]) >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def of_stretch(stretch: Column, begin: Column) -> Column:
        first = F.struct(begin.alias("at"), F.array().cast(kind).alias("spans"))
        return F.aggregate(stretch, first, step, lambda s: s["spans"])

    def every(p: Column) -> Column:
        """Stretches of the parts, the code points before each of them, and the spans of all."""
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / STRETCH).cast("int")), lambda i: F.slice(p, i * STRETCH + 1, F.lit(STRETCH)))
        sizes = lambda c: F.transform(c, lambda s: F.aggregate(s, F.lit(0), lambda total, x: total + taken(x)))
        starts = lambda z: F.aggregate(z, F.array(F.lit(0)), lambda before, n: F.concat(before, F.array(F.element_at(before, -1) + n)))
        both = lambda c: F.arrays_zip(c.alias("s"), F.slice(starts(sizes(c)), F.lit(1), F.size(c)).alias("at"))
        return _let(stretches, lambda c: F.flatten(F.transform(both(c), lambda z: of_stretch(z["s"], z["at"]))))

    return F.when(F.rlike(text, F.lit(rule.pattern)), _let(parts, every)).otherwise(F.array().cast(kind))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: as the variable of a lambda, which nested lambdas don't compute again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, docs_per_segment: int = 50_000, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``found``, all spans as an array of (start, rank, kind, end) by start and rule.

    Method. A Boolean trigram query is derived from each rule's regular expression. An inverted index has the postings of the trigrams that
    the queries name; intersecting and uniting its lists gives each rule's candidates, and the rule's expression verifies these
    alone. A rule without mandatory trigrams scans every text. The index is written to the shared folder. Candidates are
    broadcast only when counted to be at most ``broadcast_rows``; beyond that they are joined by a shuffle.

    Defined cases: a null text counts as empty; a row whose doc_id is null is a candidate of every rule; rows that repeat a
    doc_id share their candidacy and are each verified. Whole texts are searched. An empty table gives an empty result. Further columns are ignored.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for conjunction in clause for t in conjunction})
    segments = max(1, -(-docs.count() // docs_per_segment))
    index = written(trigram_index(docs, trigrams, segments), "trigram-index")
    candidates = written(_candidates(index, queries), "secret-candidates").withColumnRenamed("doc_id", "of")
    if candidates.count() <= broadcast_rows:
        candidates = F.broadcast(candidates)
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).join(candidates, F.col("doc_id") == F.col("of"), "left")
    each = []
    for order, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, order)
        if rule.kind in queries:
            none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
            spans = F.when(F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)), spans).otherwise(none)
        each.append(spans)
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
