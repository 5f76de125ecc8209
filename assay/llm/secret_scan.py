"""Secret scan over a trigram inverted index, in DataFrame functions only.

1. Each rule's regular expression gives a Boolean query of trigrams in disjunctive form (after Cox, 2012): every match holds
   all trigrams of at least one conjunction. Letters are compared in lower case, as the index holds lower-cased texts.
   Classes of many characters, negated ones and what may be absent say nothing; a rule of which nothing is known scans fully.
2. The index has a row for each trigram that a query asks for and each different text that holds it (texts by their hash, so
   copies share theirs). It is written once, sorted by trigram. No row of it is longer for a frequent trigram, and no task
   gets a trigram's whole list.
3. Postings meet the conjunctions' trigrams (as many as the rules make, so they are broadcast) and are intersected by
   counting: a text is a candidate of a rule if it has all trigrams of one of the rule's conjunctions.
4. The table is read again with its candidates; the regular expressions of the rules that a text is a candidate of, and of
   those that scan fully, run on its whole text. Spans are exact whatever the index said; a hash that two texts share only
   makes one more candidate.

Spans of a rule are its leftmost non-overlapping matches, less those whose group ``group`` has fewer than ``least``
characters; positions are code points, ends exclusive. Rules' expressions keep to what Java, Python and RE2 read alike.

Every row of docs gives a row, repeated rows too; a null text is an empty one, which has no spans, and null ids stay null.
Very long texts are scanned whole; their positions are summed in blocks. An empty table gives an empty result. Columns other
than the id and the text are not read, so others may have any name.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import saved, text_of


def either(words: str) -> str:
    """An expression whose letters may have either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three kinds that every scan has, and formats that services document. A run of 24 or more and "a run, if it has 24 or
#: more" have the same matches, and so have keys of 20 or more.
BASE = (
    Rule("assign", "(" + either("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[0-9A-Za-z]+-[0-9A-Za-z-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN ([A-Z]+ )?PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: Strings that a part of an expression may stand for, characters of a class, and conjunctions of a query, beyond which
#: nothing is said of them.
MOST_STRINGS, MOST_SIGNS, MOST_CONJUNCTIONS = 64, 12, 64
#: Matches of a text whose lengths are summed at once.
BLOCK = 128

Query = frozenset  # of conjunctions, each a frozenset of trigrams; an empty conjunction is always true
ALWAYS: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Part:
    """What all matches of a part of an expression are like: one of ``exact``, or else begin with one of ``first``, end with
    one of ``last`` and fulfil ``query``."""

    exact: frozenset | None
    first: frozenset = frozenset([""])
    last: frozenset = frozenset([""])
    query: Query = ALWAYS


UNKNOWN = Part(None)


def simplest(conjunctions) -> Query:
    """Without conjunctions that another one makes needless."""
    kept: list[frozenset] = []
    for one in sorted(set(conjunctions), key=len):
        if not any(x <= one for x in kept):
            kept.append(one)
    return frozenset(kept)


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_CONJUNCTIONS:
        return min(a, b, key=len)
    return simplest(x | y for x, y in product(a, b))


def any_of(queries: list[Query]) -> Query:
    out = simplest(x for q in queries for x in q)
    return out if len(out) <= MOST_CONJUNCTIONS else ALWAYS


def grams_of(strings) -> Query:
    return any_of([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def opened(p: Part) -> Part:
    """p without its exact strings, of which the ends and the trigrams are kept."""
    if p.exact is None:
        return p
    return Part(None, frozenset(s[:2] for s in p.exact), frozenset(s[-2:] for s in p.exact), grams_of(p.exact))


def joined(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return Part(frozenset(x + y for x, y in product(a.exact, b.exact)))
    left, right = opened(a), opened(b)
    over = frozenset(x + y for x, y in product(left.last, right.first))
    first = frozenset((x + y)[:2] for x, y in product(a.exact, right.first)) if a.exact else left.first
    last = frozenset((x + y)[-2:] for x, y in product(left.last, b.exact)) if b.exact else right.last
    few = lambda s: s if len(s) <= MOST_STRINGS else frozenset([""])
    return Part(None, few(first), few(last), both(both(left.query, right.query), grams_of(over)))


def one_of(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts) and len(own := frozenset().union(*(p.exact for p in parts))) <= MOST_STRINGS:
        return Part(own)
    parts = [opened(p) for p in parts]
    return Part(None, frozenset().union(*(p.first for p in parts)), frozenset().union(*(p.last for p in parts)), any_of([p.query for p in parts]))


def part_of(tokens) -> Part:
    out = Part(frozenset([""]))
    for op, value in tokens:
        out = joined(out, part_of_one(str(op), value))
    return out


def part_of_one(op: str, value) -> Part:
    if op == "LITERAL":
        return Part(frozenset([chr(value).lower()])) if value < 128 else UNKNOWN
    if op == "IN":
        signs: set[str] = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                signs.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 128:
                signs |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return UNKNOWN
        return Part(frozenset(signs)) if len(signs) <= MOST_SIGNS and max(signs) < "\x80" else UNKNOWN
    if op == "SUBPATTERN":
        return part_of(value[3])
    if op == "BRANCH":
        return one_of([part_of(x) for x in value[1]])
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = value
        inside = part_of(inner)
        if least == 0:
            return one_of([Part(frozenset([""])), inside]) if most == 1 else UNKNOWN
        if least == most == 1:
            return inside
        out = opened(inside)  # once or more: what lies between two of them is left open
        return Part(None, out.first, out.last, out.query)
    return Part(frozenset([""])) if op in ("AT", "ASSERT", "ASSERT_NOT") else UNKNOWN


def trigram_query(pattern: str) -> Query:
    """The conjunctions of trigrams of which every match fulfils one; ALWAYS if nothing is sure."""
    query = opened(part_of(re._parser.parse(pattern))).query
    return ALWAYS if frozenset() in query else query


def table_of(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table from fixed rows, made by the JVM."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows])))


def build_index(docs: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """(gram, key): which texts, by their hashes, hold which of these trigrams in lower case. Written to the shared folder.

    Each trigram is looked for in the whole text; the rows that this gives are made distinct, as copies share a key."""
    low = docs.where(F.length(text_of(text)) >= 3).select(F.xxhash64(text_of(text)).alias("key"), F.lower(text_of(text)).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return saved(low.select("key", F.explode(found).alias("gram")).distinct().sortWithinPartitions("gram", "key"), "trigrams")


def candidates(index: DataFrame, rules: list[tuple[int, Query]]) -> DataFrame:
    """(key, rules): which rules' queries a text fulfils, by intersecting postings."""
    rows = [(number, c, gram, len(one)) for number, query in rules for c, one in enumerate(sorted(query, key=sorted)) for gram in sorted(one)]
    asked = table_of(index.sparkSession, rows, ["rule", "conjunction", "gram", "need"])
    met = index.join(F.broadcast(asked), "gram").groupBy("key", "rule", "conjunction", "need").agg(F.count("*").alias("has"))
    return met.where("has = need").groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def sums_before(lengths: Column) -> Column:
    """For each of an array of lengths the sum of those before it. Sums grow block by block, as an array is copied whenever
    one is added to it."""
    grow = lambda xs, last: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + last(x))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    local = F.transform(blocks, lambda xs: grow(xs, lambda x: x))
    bases = F.slice(grow(local, lambda x: F.element_at(x, -1)), F.lit(1), F.size(local))
    return F.flatten(F.zip_with(local, bases, lambda own, base: F.transform(F.slice(own, F.lit(1), F.size(own) - 1), lambda x: x + base)))


def spans_of(hit: Column) -> Column:
    """The spans of a rule's matches in a text, from the lengths of what is before each (gaps), of the matches (sizes) and of
    the group that decides (held)."""
    steps = F.zip_with(hit["gaps"], hit["sizes"], lambda g, m: g + m)
    starts = F.zip_with(sums_before(steps), hit["gaps"], lambda s, g: s + g)
    placed = F.zip_with(starts, hit["sizes"], lambda s, m: F.struct(s.alias("start"), hit["kind"].alias("kind"), (s + m).alias("end")))
    return F.array_compact(F.zip_with(placed, hit["held"], lambda p, h: F.when(h >= hit["least"], p)))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs its id and ``found``: the spans of all rules as structs (start, kind, end) in that order, kind the
    place of the rule in rules."""
    queries = [trigram_query(r.pattern) for r in rules]
    asked = [(i, q) for i, q in enumerate(queries) if q != ALWAYS]
    own = docs.select(F.col(id).alias("id"), text_of(text).alias("text"))
    if asked:
        grams = sorted({g for _, q in asked for one in q for g in one})
        may = saved(candidates(build_index(docs, grams, text), asked), "candidates")
        own = own.withColumn("key", F.xxhash64("text")).join(may, "key", "left")
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))

    def hit(i: int, rule: Rule) -> Column:
        """Null where the rule has no match, or can't have one."""
        pattern = F.lit(rule.pattern)
        held = F.regexp_extract_all("text", pattern, F.lit(rule.group))
        gaps = F.slice(lengths(F.split("text", rule.pattern, -1)), F.lit(1), F.size(held))
        found = F.struct(F.lit(i).alias("kind"), F.lit(rule.least).alias("least"), gaps.alias("gaps"), lengths(F.regexp_extract_all("text", pattern, F.lit(0))).alias("sizes"), lengths(held).alias("held"))
        may = F.regexp_like("text", pattern)
        return F.when(may if queries[i] == ALWAYS else F.array_contains("rules", i) & may, found)

    hits = own.select("id", F.array_compact(F.array(*[hit(i, r) for i, r in enumerate(rules)])).alias("hits"))
    return hits.select(F.col("id").alias(id), F.array_sort(F.flatten(F.transform("hits", spans_of))).alias("found"))


def joined_text(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, how many spans of each base kind, the digest of these, and all spans as text. rules begin with BASE."""
    found = scan(docs, rules)
    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    out = found.select("doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], joined_text(base, rules).alias("base"), joined_text(F.col("found"), rules).alias("spans"))
    return out.select("doc_id", *[f"n_{r.kind}" for r in BASE], F.sha2("base", 256).alias("base_sha256"), "spans")


def secrets_sql(rules: tuple[Rule, ...] = RULES, docs: str = "documents") -> str:
    """The same table by DuckDB, every rule run on every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"""SELECT row, {i} AS kind, {quote(r.kind)} AS name, unnest(range(1, len(m) + 1)) AS k, m, g, p FROM (
  SELECT row, regexp_extract_all(text, {quote(r.pattern)}, 0) AS m, regexp_extract_all(text, {quote(r.pattern)}, {r.group}) AS g, string_split_regex(text, {quote(r.pattern)}) AS p FROM own) WHERE len(m) > 0"""
        for i, r in enumerate(rules)
    )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules))
    return f"""
WITH own AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM {docs}),
hits AS ({each}),
spans AS (SELECT row, kind, name, m[k] AS hit, g[k] AS held, coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start FROM hits),
good AS (SELECT row, kind, start, name || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT AS said FROM spans WHERE length(held) >= CASE kind {least} END),
by_row AS (SELECT row, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
  coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}), '') AS base, string_agg(said, ',' ORDER BY start, kind) AS spans FROM good GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM own LEFT JOIN by_row USING (row)"""
