"""Secret scans over a trigram inverted index, in DataFrame and SQL functions only.

From each rule's regular expression a Boolean query over lower-case trigrams is derived: every match must contain, for each part of the
query, all trigrams of one of the part's strings. The index holds a posting (trigram, document) for each trigram that some query names.
Postings are intersected per string, united per part and intersected per rule; the documents that remain are verified with the
expression itself. Rules without mandatory trigrams, as ``[0-9a-f]+``, are applied to every document.

Kinds, in the order in which ties are listed: assign, access and hex (the base), then pem, github and jwt, which only add spans. Spans are
code point offsets, end exclusive. Null and empty texts have none. Repeated rows are each reported. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import id_text, marked, with_key, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0
    base: bool = False


# The kinds of secrets, and what each looks like.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

#: Matches whose offsets are added up together.
SLICE = 256
#: Strings that one part of a query may list.
MOST_STRINGS = 64

Query = tuple[tuple[frozenset[str], ...], ...]


def trigram_query(pattern: str) -> Query:
    """AND over parts, OR over the strings of a part, AND over the trigrams of a string; () where nothing is mandatory."""
    parts: list[tuple[frozenset[str], ...]] = []

    def close(strings: set[str] | None) -> None:
        """What must stand here: one of these strings. Strings under three characters say nothing."""
        if strings and all(len(x) >= 3 for x in strings):
            every = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in strings}
            parts.append(tuple(sorted((x for x in every if not any(y < x for y in every)), key=sorted)))

    def exact(node) -> set[str] | None:
        """All strings that a node matches, in lower case, if they are few."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            out: set[str] = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    out.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < MOST_STRINGS:
                    out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if op is sre.SUBPATTERN:
            return sequence(arg[3])
        if op is sre.BRANCH:
            every = [sequence(x) for x in arg[1]]
            return None if None in every else few(set().union(*every))
        if op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 3:
            one = sequence(arg[2])
            return None if one is None else few({"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)})
        return None

    def few(strings: set[str]) -> set[str] | None:
        return strings if len(strings) <= MOST_STRINGS else None

    def sequence(nodes) -> set[str] | None:
        out: set[str] | None = {""}
        for node in nodes:
            one = exact(node)
            out = None if one is None or out is None else few({a + b for a in out for b in one})
        return out

    def walk(nodes) -> None:
        held: set[str] = {""}
        for node in nodes:
            one = exact(node)
            joined = None if one is None else few({a + b for a in held for b in one})
            if joined is not None:
                held = joined
                continue
            close(held)
            held = {""} if one is None else one
            if one is None:
                op, arg = node
                if op is sre.SUBPATTERN:
                    walk(arg[3])
                elif op is sre.MAX_REPEAT and arg[0] >= 1:
                    walk(arg[2])
        close(held)

    walk(sre_parser.parse(pattern))
    return tuple(parts)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``trigram, doc_id`` for each of the trigrams that a text contains, in any case."""
    named = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return docs.select("doc_id", F.lower("text").alias("low")).select("doc_id", F.explode(named).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``doc_id, kinds``: the rules whose queries a document's postings satisfy."""
    uses: dict[str, list[tuple[str, int, int, int, int]]] = {}
    for kind, query in queries.items():
        for p, strings in enumerate(query):
            for s, grams in enumerate(strings):
                for g in grams:
                    uses.setdefault(g, []).append((kind, p, s, len(grams), len(query)))
    lookup = F.create_map(
        *[x for g, of in uses.items() for x in (F.lit(g), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("part"), F.lit(s).alias("string"), F.lit(n).alias("needs"), F.lit(m).alias("parts")) for k, p, s, n, m in of]))]
    )
    held = index.distinct().select("doc_id", "trigram", F.explode(lookup[F.col("trigram")]).alias("u")).select("doc_id", "u.*")
    strings = held.groupBy("doc_id", "kind", "part", "string", "needs", "parts").agg(F.count("*").alias("n")).where("n = needs")
    rules = strings.groupBy("doc_id", "kind", "parts").agg(F.countDistinct("part").alias("n")).where("n = parts")
    return rules.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """The rule's spans in a text: ``start, number, end``. Matches and the gaps between them give the offsets."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    triples = F.zip_with(
        F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("match")), judged, lambda a, j: F.struct(F.length(a["gap"]).alias("gap"), F.length(a["match"]).alias("size"), F.length(j).alias("judged"))
    )
    span = "struct<start:bigint,number:int,end:bigint>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc, x):
        at = acc["at"] + x["gap"]
        one = F.array(F.struct(at.cast("bigint").alias("start"), F.lit(number).cast("int").alias("number"), (at + x["size"]).cast("bigint").alias("end")))
        return F.struct((at + x["size"]).cast("bigint").alias("at"), F.when(x["judged"] >= rule.at_least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans")).cast(f"struct<at:bigint,spans:array<{span}>>")

    # offsets within slices of SLICE matches, then those of the slices: arrays that grow match by match stay short
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(triples) - 1) / SLICE).cast("int")), lambda i: F.aggregate(F.slice(triples, i * SLICE + 1, F.lit(SLICE)), start, step))
    base = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("bases"))
    bases = F.aggregate(slices, base, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")), lambda acc: acc["bases"])
    moved = F.zip_with(slices, bases, lambda x, b: F.transform(x["spans"], lambda y: F.struct((y["start"] + b).alias("start"), y["number"].alias("number"), (y["end"] + b).alias("end"))))
    return F.flatten(moved)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, found`` with ``found`` an array of ``(start, number, end)``, ``number`` the rule's place in ``rules``; in order.

    Only texts that the index may have found are shuffled, to meet the kinds found for them; the rules that scan fully run on the others in place.
    """
    spark = docs.sparkSession
    named, key = with_key(docs)
    texts = id_text(named, F.col(key).alias("row_key"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for part in q for s in part for g in s})
    none = F.array().cast("array<struct<start:bigint,number:int,end:bigint>>")

    def found(rows: DataFrame, kinds: bool) -> DataFrame:
        each = []
        for number, rule in enumerate(rules):
            if rule.kind in queries and not kinds:
                continue
            # a cheap test with the shortest length that counts decides whether gaps and offsets are worked out at all
            some = F.col("text").rlike(rule.pattern if rule.group or not rule.at_least else _at_least(rule))
            if rule.kind in queries:
                some = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) & some
            each.append(F.when(some, _spans(F.col("text"), rule, number)).otherwise(none))
        return rows.select("doc_id", F.array_sort(F.concat(none, *each)).alias("found"))

    if not grams:
        return found(texts, False)
    index = written(spark, postings(texts.select(F.col("row_key").alias("doc_id"), "text"), grams), "trigrams")
    wanted = written(spark, candidates(index, queries), "candidates")
    wanted = wanted.withColumnRenamed("doc_id", "row_key")
    both = marked(texts, wanted, "row_key")
    hit = both.where("maybe").join(wanted.hint("merge"), "row_key", "left")
    return found(hit, True).unionByName(found(both.where("not maybe"), False))


def _at_least(rule: Rule) -> str:
    """For ``x+`` alone or after a literal: the same with the number of characters that count."""
    m = re.fullmatch(r"(\w*)(\[[^\]]+\])\+", rule.pattern)
    return f"{m[1]}{m[2]}{{{rule.at_least - len(m[1])},}}" if m else rule.pattern


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` from what scan() found."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    n_base = sum(r.base for r in rules)

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(number: int) -> Column:
        return F.size(F.filter("found", lambda s: s["number"] == number)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base]
    return found.select("doc_id", *counts, F.sha2(shown(F.filter("found", lambda s: s["number"] < n_base)).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))
