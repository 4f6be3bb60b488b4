"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query over lower-case trigrams is derived: a conjunction of groups of
alternatives, each a set of trigrams that a match must hold. The index has postings (trigram, row key)
for the trigrams that queries name (postings of all trigrams would be some ten times the text); the
postings of each alternative are intersected by counting, and only the rows that satisfy a rule's query
are verified with its regex. Rules without mandatory trigrams scan every row.

A row's key is the hash of its doc_id and text, so equal rows share their candidates, which are verified
for each. The candidates come back to the texts by broadcast while there are BROADCAST_ROWS at most, and
the texts then never leave their tasks; beyond, by a shuffle on the key, which is skewed only by equal rows
(the adaptive join splits those).

Null texts are empty, an empty table gives no rows, rows with null or repeated doc_ids give a row each.
A very long text costs its length. Only doc_id and text are read.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser
from dataclasses import dataclass
from itertools import product

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from wakeline.llm.common import materialise, table
from wakeline.llm.native import SPANS, joined, lay_out, matches, named

STRINGS = 64  # exact strings held at once while a query is derived
BROADCAST_ROWS = 1 << 20  # of a long and an int


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    base: bool = False
    value_group: int = 0  # the group that must have value_length characters
    value_length: int = 0


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", True),  # 16 characters or more in all
    Rule("hex", r"[0-9a-f]{32,}", True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Groups of alternatives: a match holds all trigrams of one alternative of every group; [] if none are mandatory."""
    groups: list[list[frozenset[str]]] = []

    def strings(op, arg) -> set[str] | None:
        if op is c.LITERAL:
            return {chr(arg).lower()}
        if op is c.IN and len(arg) <= 8 and all(o is c.LITERAL for o, _ in arg):
            return {chr(x).lower() for _, x in arg}
        if op is c.SUBPATTERN:
            return exact(arg[3])
        if op is c.BRANCH:
            parts = [exact(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[1] <= 3 and (own := exact(arg[2])) is not None:
            return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(own, repeat=n)}
        return {""} if op in (c.AT, c.ASSERT, c.ASSERT_NOT) else None

    def exact(seq) -> set[str] | None:
        out = {""}
        for op, arg in seq:
            own = strings(op, arg)
            if own is None or len(out) * len(own) > STRINGS:
                return None
            out = {a + b for a in out for b in own}
        return out

    def flush(held: set[str]) -> None:
        if all(len(s) >= 3 for s in held):
            sets = {trigrams(s) for s in held}
            groups.append([s for s in sets if not any(t < s for t in sets)])  # a superset says nothing more

    def walk(seq) -> None:
        held = {""}
        for op, arg in seq:
            own = strings(op, arg)
            if own is None or len(held) * len(own) > STRINGS:
                flush(held)
                held = own or {""}
                if own is None and op is c.SUBPATTERN:
                    walk(arg[3])
            else:
                held = {a + b for a in held for b in own}
        flush(held)

    walk(parser.parse(pattern))
    return groups


def candidates(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, rules: a bit for each rule whose trigram query the text satisfies; keyed: key, text."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    terms = [(t, i, g, a, len(alternative)) for i, q in queries.items() for g, group in enumerate(q) for a, alternative in enumerate(group) for t in sorted(alternative)]
    wanted = sorted({t for t, *_ in terms})
    low = keyed.select("key", F.lower("text").alias("low"))  # once a text, not once a trigram
    index = low.select("key", F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda t: F.col("low").contains(t))).alias("trigram")).distinct()
    spark = keyed.sparkSession
    terms = spark.createDataFrame(terms, "trigram string, rule int, grp int, alt int, size int")
    sizes = spark.createDataFrame([(i, len(q)) for i, q in queries.items()], "rule int, groups int")
    hits = index.join(F.broadcast(terms), "trigram")  # a row for each trigram of the rules
    met = hits.groupBy("key", "rule", "grp", "alt", "size").count().filter("count = size").select("key", "rule", "grp").distinct()
    full = met.groupBy("key", "rule").count().join(F.broadcast(sizes), "rule").filter("count = groups")
    return full.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("rules"))


def long_enough(spans: Column, values: Column, least: int) -> Column:
    return F.filter(spans, lambda _, i: F.length(F.get(values, i)) >= least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text and, for each rule, its spans."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    found = materialise(candidates(keyed, rules), "candidates")
    rows = keyed.join(F.broadcast(found) if found.count() <= broadcast_rows else found, "key", "left")
    found = {}
    for i, r in enumerate(rules):
        due = F.coalesce("rules", F.lit(0)).bitwiseAND(1 << i) > 0 if trigram_query(r.pattern) else F.lit(True)
        due = due & F.col("text").rlike(r.pattern)
        kept, around = matches(F.col("text"), r.pattern)
        found[f"{r.kind}_kept"] = F.when(due, kept)
        found[f"{r.kind}_around"] = F.when(due, around)
        if r.value_group:
            found[f"{r.kind}_value"] = F.when(due, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.value_group)))
    rows = rows.select("doc_id", "text", *(v.alias(k) for k, v in found.items()))
    spans = []
    for r in rules:
        own = F.coalesce(lay_out(F.col(f"{r.kind}_kept"), F.col(f"{r.kind}_around")), F.array().cast(SPANS))
        if r.value_group:
            own = long_enough(own, F.col(f"{r.kind}_value"), r.value_length)
        spans.append(named(own, r.kind, rules.index(r)).alias(r.kind))
    return rows.select("doc_id", "text", *spans)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(F.concat(*base)), 256).alias("base_sha256"),
        joined(F.concat(*(r.kind for r in RULES))).alias("spans"),
    )
