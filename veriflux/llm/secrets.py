"""Secret scanning with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query: strings that
every match must contain, as an OR of ANDs of trigrams. The index holds
postings (trigram, doc_id) for all trigrams that any rule asks for, over
lower-cased text. Intersecting a document's postings gives the rules it is a
candidate for; only these rules' expressions run on it. A rule without
mandatory trigrams is run on every document, where its text lies.

Texts of candidates alone are shuffled: a bitmap of candidates' hashes, of
bounded size, tells every other row apart before that.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_text, likely

#: A repeated or optional part is spelled out into at most so many exact strings.
MAX_STRINGS = 64
#: Matches whose places are added up one by one; places of whole runs of them are added first.
RUN = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # code points of `group` in a match that counts
    group: int = 0
    base: bool = False


#: Base rules in their fixed order, then what the operator adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),  # runs are maximal, so shorter ones need no match of their own
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A query is a set of alternatives, each a set of trigrams; None: no condition.
Query = frozenset[frozenset[str]] | None


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _least(options) -> Query:
    """Without options that ask for more than another one."""
    return frozenset(o for o in options if not any(p < o for p in options))


def _any(strings: set[str]) -> Query:
    options = frozenset(trigrams(s) for s in strings)
    return None if not options or frozenset() in options else _least(options)


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a or b
    return _least(frozenset(x | y for x, y in product(a, b))) if len(a) * len(b) <= MAX_STRINGS else max(a, b, key=lambda q: min(map(len, q)))


def _exact(node) -> set[str] | None:
    """All strings that a parsed part can match, lower-cased, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
        return {chr(v).lower() for _, v in arg}
    if op is sre.SUBPATTERN:
        return _exact_all(arg[3])
    if op is sre.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 3 and (inner := _exact_all(arg[2])) is not None:
        out: set[str] = set()
        for n in range(arg[0], arg[1] + 1):
            if len(inner) ** n > MAX_STRINGS:
                return None
            out |= {"".join(p) for p in product(inner, repeat=n)}
        return out if len(out) <= MAX_STRINGS else None
    return None


def _exact_all(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        inner = _exact(node)
        if inner is None or len(found) * len(inner) > MAX_STRINGS:
            return None
        found = {a + b for a, b in product(found, inner)}
    return found


def _query(nodes) -> Query:
    query, run = None, {""}
    for node in nodes:
        inner = _exact(node)
        if inner is not None and len(run) * len(inner) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, inner)}
            continue
        query, run = _both(query, _any(run)), {""}
        op, arg = node
        if inner is not None:
            run = inner
        elif op is sre.SUBPATTERN:
            query = _both(query, _query(arg[3]))
        elif op is sre.BRANCH:
            parts = [_query(p) for p in arg[1]]
            if None not in parts:
                query = _both(query, frozenset().union(*parts))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            query = _both(query, _query(arg[2]))
    return _both(query, _any(run))


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of every match contains, or None."""
    return _query(sre_parse.parse(pattern))


def build_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams; trigram is its place in vocabulary."""
    low = docs.select("doc_id", F.lower("text").alias("low"))  # once a row, before it is probed
    hits = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary)]))
    # an inner explode would have the planner probe a second time, to drop rows without hits early
    return low.select("doc_id", F.explode_outer(hits).alias("trigram")).where("trigram is not null")


def candidates(index: DataFrame, queries: dict[str, Query], vocabulary: list[str]) -> DataFrame:
    """(doc_id, a boolean for each rule with a query), for documents that satisfy any of them."""
    at = {t: i for i, t in enumerate(vocabulary)}
    bits = F.array(*[F.bit_or(F.when(F.shiftright("trigram", 5) == w, F.expr("shiftleft(1, trigram & 31)")).otherwise(0)) for w in range(len(vocabulary) // 32 + 1)])

    def holds(option: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range(len(vocabulary) // 32 + 1):
            need = sum(1 << (at[t] & 31) for t in option if at[t] >> 5 == w)
            if need:
                need = need - (1 << 32) if need >> 31 else need
                out = out & (F.col("bits")[w].bitwiseAND(F.lit(need)) == need)
        return out

    def either(query) -> Column:
        out = F.lit(False)
        for option in sorted(query, key=sorted):
            out = out | holds(option)
        return out

    asked = {k: q for k, q in queries.items() if q is not None}
    found = index.groupBy("doc_id").agg(bits.alias("bits")).select("doc_id", *[either(q).alias(k) for k, q in asked.items()])
    return found.where(" or ".join(asked))


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL for body with name standing for value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def spans_of(rule: Rule, order: int) -> Column:
    """Structs (start, end, order, kind) of a rule's matches that are long enough, in code points."""
    pattern = quoted(rule.pattern)
    add = lambda part: f"aggregate({part}, 0, (at, y) -> at + y.gap + y.size)"
    # gap: code points between the match before and this one
    gaps = f"slice(transform(split(text, {pattern}, -1), y -> length(y)), 1, size(m))"
    found = let("m", f"regexp_extract_all(text, {pattern}, 0)", f"zip_with({gaps}, m, (g, b) -> struct(g AS gap, length(b) AS size, b AS body))")
    runs = f"transform(filter(sequence(0, size(f)), i -> i % {RUN} = 0), i -> {add(f'slice(f, i + 1, {RUN})')})"
    begins = f"aggregate({runs}, array(0), (a, n) -> concat(a, array(element_at(a, -1) + n)))"
    start = f"r.begins[i div {RUN}] + {add(f'slice(r.f, cast(i div {RUN} * {RUN} + 1 AS int), cast(i % {RUN} AS int))')} + x.gap"
    struct = f"struct(s AS start, s + x.size AS end, {order} AS order, {quoted(rule.kind)} AS kind, x.body AS body)"
    placed = let("f", found, let("r", f"struct(f AS f, {begins} AS begins)", f"transform(r.f, (x, i) -> {let('s', start, struct)})"))
    size = f"length(regexp_extract(x.body, {pattern}, {rule.group}))" if rule.group else "x.end - x.start"
    kept = f"filter({placed}, x -> {size} >= {rule.least})" if rule.least else placed
    return F.expr(f"transform({kept}, x -> struct(x.start AS start, x.end AS end, x.order AS order, x.kind AS kind))")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and found (the spans as structs) for every row.

    Matches are leftmost and non-overlapping for each kind; those that are too
    short are dropped after matching. Spans are code points, end exclusive, by
    start and then in the rules' order. A null or empty text has no spans and an
    empty string. Null doc_ids and repeated rows are scanned like any other row.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "secrets")
    texts = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))  # a null text may share its id with a candidate
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    vocabulary = sorted({t for q in queries.values() if q for option in q for t in option})
    if not vocabulary:
        return spans_for(texts, rules, queries)
    index = tmp.save(build_index(texts, vocabulary), "index")
    hits = tmp.save(candidates(index, queries, vocabulary).withColumnRenamed("doc_id", "hit_id"), "candidates")
    tmp.drop("index")
    marked = likely(texts, hits.select(F.col("hit_id").alias("doc_id")), "maybe")
    near = marked.where("maybe").join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    far = marked.where("not maybe")
    # both sides have read the bitmap; a text is scanned in one of them
    return spans_for(far, rules, queries).union(spans_for(near, rules, queries))


def spans_for(texts: DataFrame, rules: tuple[Rule, ...], queries: dict[str, Query]) -> DataFrame:
    """scan()'s rows for texts with a boolean column for each rule that has a query, or for texts that are no candidates."""
    none = F.array().cast("array<struct<start:int,end:int,order:int,kind:string>>")
    columns = []
    for i, rule in enumerate(rules):
        if queries[rule.kind] and rule.kind not in texts.columns:
            columns.append(none.alias(f"spans_{rule.kind}"))
            continue
        asked = F.coalesce(F.col(rule.kind), F.lit(False)) if queries[rule.kind] else F.col("text").rlike(rule.pattern)
        columns.append(F.when(asked, spans_of(rule, i)).otherwise(none).alias(f"spans_{rule.kind}"))
    found = texts.select("doc_id", *columns)
    base = F.concat(*[F.col(f"spans_{r.kind}") for r in rules if r.base])
    every = F.concat(*[F.col(f"spans_{r.kind}") for r in rules])
    return found.select(
        "doc_id",
        *[F.size(f"spans_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules if r.base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.array_sort(every).alias("found"),
    )
