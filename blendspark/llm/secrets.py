"""Secret scans by a trigram inverted index: candidates from postings, then the rules."""

from __future__ import annotations

import itertools
import re
from re import _constants as op
from re import _parser as regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendspark.llm.frames import fresh, let, listed, running_sums, text_of

# The base rules (kind, pattern, group whose length counts, least length).
# Where a match is a whole run, the least length stands in the pattern.
BASE_RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
# Further token formats.
MORE_RULES = (
    ("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
RULES = BASE_RULES + MORE_RULES

#: Strings that a stretch of a pattern may stand for, at most; beyond, it is cut there.
STRINGS = 64


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """What every match must hold: an OR of ANDs of lower-case trigrams, or None where
    no trigram is mandatory.  A text without it (in lower case) has no match."""
    clauses: frozenset[frozenset[str]] = frozenset([frozenset()])
    run = {""}

    def flush() -> None:
        nonlocal clauses, run
        held = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run]
        joined = {a | b for a, b in itertools.product(clauses, held)}
        clauses = frozenset(c for c in joined if not any(o < c for o in joined))
        run = {""}

    for node in regex.parse(pattern):
        strings = _strings(node)
        longer = {a + b for a, b in itertools.product(run, strings)} if strings else set()
        if not strings or len(longer) > STRINGS:
            flush()
            run = strings or {""}
        else:
            run = longer
    flush()
    return None if frozenset() in clauses else clauses


def _strings(node) -> set[str] | None:
    """All lower-case strings a node of a parsed pattern matches, None if too many."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        found: set[str] = set()
        for what, x in value:
            if what is not op.LITERAL:
                return None
            found.add(chr(x).lower())
        return found if len(found) <= STRINGS else None
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] == 1:
        inner = _sequence(value[2])
        return None if inner is None else inner | {""} if value[0] == 0 else inner
    return None


def _sequence(nodes) -> set[str] | None:
    whole = {""}
    for node in nodes:
        strings = _strings(node)
        if strings is None or len(whole) * len(strings) > STRINGS:
            return None
        whole = {a + b for a, b in itertools.product(whole, strings)}
    return whole


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id: the index of the given trigrams over all whole texts.

    Only trigrams that some rule asks for are listed; one pass over the text finds
    them.  A document is in a list once; ids that repeat have the trigrams of all."""
    low = F.lower(text_of(docs))
    rows = docs.select("doc_id", low.alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return rows.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """doc_id, rules: the rules (an array) whose trigram query a document satisfies.

    Postings meet by document: one row per document and clause comes out of the first
    sum, so that a list holding nearly all documents is split like any other.
    """
    asked = [
        F.struct(F.lit(rule).alias("rule"), F.lit(n).alias("clause"), F.lit(t).alias("trigram"), F.lit(len(clause)).alias("need"))
        for rule, clauses in queries.items()
        for n, clause in enumerate(sorted(map(sorted, clauses)))
        for t in clause
    ]
    wanted = index.sparkSession.range(1).select(F.inline(F.array(*asked)))
    met = (
        index.join(F.broadcast(wanted), "trigram")  # as long as the rules
        .groupBy("doc_id", "rule", "clause", "need")
        .agg(F.countDistinct("trigram").alias("has"))
        .where("has = need")
    )
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def spans(text: Column, rule: tuple[str, str, int, int]) -> Column:
    """array<struct<kind, start, end>> of a rule's matches, leftmost and without
    overlap, in code points.  Matches whose group is too short are dropped after
    they have been found, so what follows them is found as before."""
    kind, pattern, group, least = rule
    r = F.lit(pattern)
    # What stands before each match, the match and its group, side by side; after the
    # last match the split leaves one piece more, which has no match.
    lengths = F.zip_with(
        F.transform(F.regexp_extract_all(text, r, F.lit(0)), lambda w: F.length(w)),
        F.transform(F.regexp_extract_all(text, r, F.lit(group)), lambda g: F.length(g)) if group else F.array().cast("array<int>"),
        lambda n, part: F.struct(n.alias("n"), (part if group else n).alias("part")),
    )
    gaps = F.transform(F.split(text, pattern), lambda gap: F.length(gap))

    def placed(m: Column, gap: Column) -> Column:
        ends = running_sums(F.flatten(F.zip_with(m, gap, lambda x, g: F.array(g, F.coalesce(x["n"], F.lit(0))))))
        return let(ends, lambda e: F.filter(
            F.transform(m, lambda x, i: F.struct(
                F.lit(kind).alias("kind"), F.get(e, 2 * i + 1).cast("int").alias("start"), F.get(e, 2 * i + 2).cast("int").alias("end"), x["part"].alias("part"),
            )),
            lambda s: s["part"] >= least,
        ))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,part:int>>")
    found = let(lengths, lambda m: F.when(F.size(m) > 0, placed(m, gaps)).otherwise(none))
    return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with ``secrets``: array<struct<kind, start, end>>, by start, then rule order.

    Null text counts as empty; extra columns stay (one called secrets is replaced).
    Rules with mandatory trigrams run only over the documents that the index names
    (a null doc_id is looked up like any other); the others run over all.  Texts of any
    length with any number of matches are scanned whole; an empty table gives no rows.
    The list of hits is joined by ``listed``, so texts move only beyond its bound.
    """
    queries = {rule[0]: trigram_query(rule[1]) for rule in rules}
    keyed = {k: q for k, q in queries.items() if q is not None}
    text, named = text_of(docs), fresh(docs, "_rules")
    out = docs
    if keyed:
        trigrams = sorted({t for q in keyed.values() for clause in q for t in clause})
        hits = candidates(postings(docs, trigrams), keyed)
        hits = listed(hits.select(F.col("doc_id").alias("_hit"), F.col("rules").alias(named)))
        out = docs.join(hits, docs["doc_id"].eqNullSafe(hits["_hit"]), "left").drop("_hit")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    found = [
        F.when(F.array_contains(named, rule[0]), spans(text, rule)).otherwise(none) if rule[0] in keyed else spans(text, rule)
        for rule in rules
    ]
    rank = F.create_map(*[x for i, rule in enumerate(rules) for x in (F.lit(rule[0]), F.lit(i))])
    order = F.transform(F.flatten(F.array(*found)), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    sorted_spans = F.transform(F.array_sort(order), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    result = out.withColumn("secrets", sorted_spans)
    return result.drop(named) if keyed else result


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
