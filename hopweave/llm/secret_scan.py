"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived (an OR of ANDs that every match satisfies). Postings
(trigram, document) are kept for the trigrams that some query names; a rule's candidates are the documents in whose
postings all trigrams of one of its clauses meet. Rules without mandatory trigrams scan every document. The regex then
verifies candidates. The index folds A-Z to a-z, which keeps every condition necessary.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: The match stands if this group has so many characters.
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def pattern(self) -> str:
        """A run of one character class is found with its least length at once: the same matches, and no short ones."""
        run = re.fullmatch(r"(\[[^\]]+\])\+", self.regex)
        return f"{run[1]}{{{self.least},}}" if run and not self.group else self.regex


def any_case(word: str) -> str:
    """ASCII letters in either case, and nothing that Unicode folds to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three base rules' words and character sets.
WORDS = ("password", "passwd", "secret", "token")
ASSIGN = f"({'|'.join(map(any_case, WORDS))}|{any_case('api')}_?{any_case('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 2, 6, base=True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, base=True),
    Rule("hex", "[0-9a-f]+", 0, 24, base=True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosting", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", "AIza[A-Za-z0-9_-]{35}"),
)

#: More strings than this are not followed when a query is derived; the query is only weaker for it.
STRINGS = 32
Query = frozenset  # of clauses, each a frozenset of trigrams; a clause without trigrams admits every text


def _and(a: Query, b: Query) -> Query:
    both = frozenset(x | y for x in a for y in b)
    return both if len(both) <= STRINGS * STRINGS else min(a, b, key=len)


ANY: Query = frozenset([frozenset()])


def _of(strings: set[str]) -> Query:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _derive(items) -> tuple[set[str] | None, Query]:
    """(all strings it can match if they are few, else None; the query)."""
    exact: set[str] = {""}
    whole, query = True, ANY
    for op, arg in items:
        own, sub = _node(op, arg)
        query = _and(query, sub)
        if own is not None and len(exact) * len(own) <= STRINGS:
            exact = {a + b for a in exact for b in own}
        else:
            query, exact, whole = _and(query, _of(exact)), own or {""}, False
    return (exact, query) if whole else (None, _and(query, _of(exact)))


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}, ANY
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x).lower() if x < 128 else chr(x))
            elif kind is C.RANGE and x[1] - x[0] < STRINGS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= STRINGS else (None, ANY)
    if op is C.SUBPATTERN:
        return _derive(arg[-1])
    if op is C.BRANCH:
        parts = [_derive(p) for p in arg[1]]
        if all(p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= STRINGS:
            return set().union(*(p[0] for p in parts)), ANY
        return None, frozenset().union(*(p[1] if p[0] is None else _and(p[1], _of(p[0])) for p in parts))
    if op is C.MAX_REPEAT:
        low, high, body = arg
        own, query = _derive(body)
        if own is not None and (low, high) == (0, 1):
            return own | {""}, ANY
        if own is not None and low == high and len(own) ** low <= STRINGS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in own}
            return out, ANY
        if low == 0:
            return None, ANY
        return None, query if own is None else _and(query, _of(own))
    return None, ANY


@cache
def trigram_query(regex: str) -> list[frozenset[str]]:
    """Clauses of which a text with a match satisfies one; [empty clause]: no mandatory trigrams."""
    own, query = _derive(parser.parse(regex))
    query = query if own is None else _and(query, _of(own))
    least = {c for c in query if not any(o < c for o in query)}
    return sorted(least, key=sorted)


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_key, text) -> (_key, _rules): rules one of whose clauses has all its trigrams' postings at the document."""
    clauses = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(trigram_query(r.regex)) for t in c]
    terms = sorted({t for _, _, t, _ in clauses})
    spark = rows.sparkSession
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?=({'|'.join(map(re.escape, terms))}))"), F.lit(1)))
    postings = rows.select("_key", F.explode(found).alias("term"))
    rows_of = [F.struct(*[F.lit(x).alias(n) for x, n in zip(c, ("rule", "clause", "term", "size"), strict=True)]) for c in clauses]
    asked = spark.range(1).select(F.inline(F.array(*rows_of)))  # as large as the rules
    met = postings.join(F.broadcast(asked), "term").groupBy("_key", "rule", "clause", "size").agg(F.count_distinct("term").alias("n"))
    return met.where("n = size").groupBy("_key").agg(F.collect_set("rule").alias("_rules"))


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once, however often lambdas in body read it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _prefixes(x: str, op: str, depth: int = 2) -> str:
    """SQL for [0, x1, op(x1, x2), ...] without the total; op is `{} + {}` or `greatest({}, {})` over integers from 0 up.

    In stretches of stretches: the values before a stretch come from the stretches' totals, and only within a stretch of
    64 each element starts over, so work is linear up to some million elements.
    """
    v, c, s, o, i, b = (f"{name}{depth}" for name in "vcsoib")
    total = lambda a: f"aggregate({a}, 0, (r{depth}, e{depth}) -> {op.format(f'r{depth}', f'e{depth}')})"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    if not depth:
        return let(v, x, f"transform({v}, ({s}, {i}) -> if({i} = 0, 0, {total(f'slice({v}, 1, {i})')}))")
    before = _prefixes(f"transform({c}, {s} -> {total(s)})", op, depth - 1)
    within = f"transform({s}, ({b}, {i}) -> if({i} = 0, {o}, {op.format(o, total(f'slice({s}, 1, {i})'))}))"
    cut = f"transform(sequence(0, cast(ceil(size({v}) / 64) as int) - 1), {b} -> slice({v}, {b} * 64 + 1, 64))"
    return let(v, x, let(c, cut, f"flatten(zip_with({c}, {before}, ({s}, {o}) -> {within}))"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often lambdas read them (a generator is not inlined)."""
    row = F.struct(*[F.col(c) for c in df.columns], *[x.alias(c) for c, x in columns.items()])
    return df.select(F.inline(F.array(row)))


def _span(rank: int, rule: Rule):
    def of(z: Column, at: Column) -> Column:
        start = at + z["gap"]
        return F.when(z["part"] >= rule.least, F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + z["len"]).alias("stop")))

    return of


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """_row (docs' columns), doc_id, text and _spans: array of (start, rank, kind, stop), code points, by start then rule.

    Leftmost non-overlapping matches for each rule; matches whose group is too short are dropped. Null and empty texts
    have no spans. Every row gives one row, whatever its id.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_key", F.xxhash64("doc_id", "text"))  # rows that share a key share their candidates, no more
    indexed = [r for r in rules if frozenset() not in trigram_query(r.regex)]
    rows = rows.join(candidates(rows, tuple(indexed)), "_key", "left")
    lens, at, spans = {}, {}, []
    for rank, r in enumerate(rules):
        pattern, own = F.lit(r.pattern), F.col(f"_lens{rank}")
        here = F.array_contains("_rules", r.kind) if r in indexed else F.col("text").rlike(r.pattern)
        parts = F.arrays_zip(F.split("text", r.pattern, -1).alias("gap"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("all"), F.regexp_extract_all("text", pattern, F.lit(r.group)).alias("part"))
        lens[f"_lens{rank}"] = F.when(here, F.transform(parts, lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["all"]).alias("len"), F.length(z["part"]).alias("part"))))
        at[f"_at{rank}"] = F.when(F.size(own) > 1, F.expr(_prefixes(f"transform(_lens{rank}, z -> z.gap + coalesce(z.len, 0))", "{} + {}")))
        spans.append(F.when(F.size(own) > 1, F.filter(F.zip_with(own, F.col(f"_at{rank}"), _span(rank, r)), lambda s: s.isNotNull())))
    matched = rows.withColumns(lens).withColumns(at)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
    return matched.select("_row", "doc_id", "text", F.array_sort(F.flatten(F.array(*[F.coalesce(s, none) for s in spans]))).alias("_spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of docs, also of equal ones.

    Null and empty texts have no spans; an empty table gives none; other columns play no part. Work is linear in a
    text's matches.
    """
    base = [r.kind for r in RULES if r.base]
    own = lambda kinds: F.filter("_spans", lambda s: s["kind"].isin(kinds))
    return scan(docs).select("doc_id", *[F.size(own([k])).cast("long").alias(f"n_{k}") for k in base], F.sha2(_listed(own(base)).cast("binary"), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every stretch of overlapping or touching spans in text replaced by mask; other columns and rows stay.

    Null, empty and clean texts stay as they are, equal rows come out equal, and an empty table stays empty. Work is
    linear in a text and its spans: pieces are cut from four bytes a code point, where a place is found at once.
    """
    rows = scan(docs)
    found = F.when(F.size("_spans") > 0, F.col("_spans"))
    spans = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    rows = _once(rows.select("_row", "text", spans.alias("_found")), _upto=F.when(F.size("_found") > 0, F.expr(_prefixes("transform(_found, z -> z.stop)", "greatest({}, {})"))))
    piece = lambda wide, a, b: F.decode(F.substring(wide, a * 4 + 1, (b - a) * 4), "UTF-32")
    starts = lambda s, upto, i: (i == 0) | (s["start"] > upto)
    zipped = F.arrays_zip(F.col("_found").alias("s"), F.col("_upto").alias("upto"), F.sequence(F.lit(0), F.size("_found") - 1).alias("i"))
    heads = F.filter(zipped, lambda z: starts(z["s"], z["upto"], z["i"]))
    last = F.array_max(F.transform("_found", lambda s: s["stop"]))

    def masked(wide: Column) -> Column:  # a column of a row would be copied for each piece
        kept = F.transform(heads, lambda z: F.concat(piece(wide, z["upto"], z["s"]["start"]), F.lit(mask)))
        return F.concat(F.array_join(kept, ""), piece(wide, last, F.length("text")))

    clean = F.when(F.size("_found") > 0, _let(F.encode("text", "UTF-32"), masked)).otherwise(F.col("text"))
    return rows.select(*[clean.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows by DuckDB, by scanning every text with every rule."""
    quoted = [r.pattern.replace("'", "''") for r in rules]
    lists = ", ".join(f"string_split_regex(t, '{q}') AS g{i}, regexp_extract_all(t, '{q}', 0) AS m{i}, regexp_extract_all(t, '{q}', {r.group}) AS p{i}" for i, (r, q) in enumerate(zip(rules, quoted, strict=True)))

    def spans(i: int, r: Rule) -> str:
        before = f"list_sum(list_transform(g{i}[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:j-1], lambda x: length(x))), 0)"
        every = f"list_transform(range(1, len(m{i}) + 1), lambda j: {{'s': ({before})::BIGINT, 'r': {i}, 'k': '{r.kind}', 'e': ({before} + length(m{i}[j]))::BIGINT, 'n': length(p{i}[j])}})"
        return f"list_filter({every}, lambda x: x.n >= {r.least})"

    every = " || ".join(spans(i, r) for i, r in enumerate(rules))
    base = [r.kind for r in rules if r.base]
    text = lambda x: f"coalesce(list_aggregate(list_transform({x}, lambda x: x.k || ':' || x.s || ':' || x.e), 'string_agg', ','), '')"
    counts = ", ".join(f"len(list_filter(a, lambda x: x.k = '{k}')) AS n_{k}" for k in base)
    own = "list_filter(a, lambda x: x.k IN (" + ", ".join(f"'{k}'" for k in base) + "))"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, {lists} FROM d), "
        f"s AS (SELECT doc_id, list_sort({every}) AS a FROM l) "
        f"SELECT doc_id, {counts}, sha256({text(own)}) AS base_sha256, {text('a')} AS spans FROM s"
    )
