"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived on
the driver: an OR of ANDs over the trigrams of the literal strings that every
match must hold.  The index lists, for each such trigram, the documents that
hold it; postings are intersected per rule by grouping, which leaves
candidates; a rule is run only over its candidates.  Rules without mandatory
trigrams run over every document.  Matches are leftmost and do not overlap;
those that fail a rule's length are dropped afterwards.

Null texts are empty and hold nothing.  Rows that repeat a doc_id share
candidates, and each row's own text decides.  Of matches of two kinds that
start at one place the kind listed first comes first.  Very long texts are
scanned whole.  An empty table gives an empty result.  Columns beyond doc_id
and text are not read; ``scan_secrets`` and ``redact`` keep them, whatever
their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, materialize

#: Candidates are broadcast only up to this number of rows (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
LITERALS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``least`` is the fewest characters of ``group`` in a match that counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]


def _literal_runs(tree) -> list[list[str]]:
    """Sets of strings of which each match holds one, in order; an unknown part ends a run."""
    runs: list[list[str]] = []
    now = [""]

    def close():
        nonlocal now
        if now != [""]:
            runs.append(now)
        now = [""]

    for op, arg in tree:
        alternatives = _exact([(op, arg)])
        if alternatives is not None and len(now) * len(alternatives) <= LITERALS:
            now = [a + b for a, b in product(now, alternatives)]
            continue
        close()
        name = str(op)
        if name == "SUBPATTERN":
            runs += _literal_runs(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            runs += _literal_runs(arg[2])
    close()
    return runs


def _exact(tree) -> list[str] | None:
    """All strings that a part of an expression matches, if they are few."""
    found = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            more = [chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))]
        elif name == "SUBPATTERN":
            more = _exact(arg[-1])
        elif name == "BRANCH":
            each = [_exact(b) for b in arg[1]]
            more = None if None in each else [s for e in each for s in e]
        elif name == "MAX_REPEAT" and arg[1] <= 2:
            once = _exact(arg[2])
            more = None if once is None else ["".join(p) for n in range(arg[0], arg[1] + 1) for p in product(once, repeat=n)]
        else:
            more = None
        if more is None or len(found) * len(more) > LITERALS:
            return None
        found = [a + b for a, b in product(found, more)]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match's text satisfies; empty if none is mandatory."""
    tree = re._parser.parse(pattern)
    best: list[frozenset[str]] = []
    for run in _literal_runs(tree):
        grams = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() in grams:
            continue
        if not best or min(map(len, grams)) > min(map(len, best)):
            best = sorted(grams, key=sorted)
    return best


def postings(documents: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index over these trigrams: one row (gram, doc_id) for each that a text holds."""
    low = documents.select("doc_id", F.lower("text").alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])
    return low.select("doc_id", F.explode(F.array_compact(held)).alias("gram"))


def candidates(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id and a bit mask of the rules whose trigram query its postings satisfy."""
    spark = documents.sparkSession
    terms = []
    for r, rule in enumerate(rules):
        for c, conjunction in enumerate(trigram_query(rule.pattern)):
            grams = sorted(conjunction)
            terms += [(g, r, c, 1 << i, (1 << len(grams)) - 1) for i, g in enumerate(grams)]
    # One row for each trigram of each rule: as many as the rules' text, whatever the corpus.
    table = F.broadcast(spark.createDataFrame(terms, "gram string, rule int, branch int, bit long, whole long"))
    index = postings(documents, sorted({t[0] for t in terms}))
    met = index.join(table, "gram").groupBy("doc_id", "rule", "branch", "whole").agg(F.bit_or("bit").alias("have")).where("have = whole")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _spans(rule: Rule, number: int) -> Column:
    """The spans of a rule's matches, in code points: lengths of the texts between matches and of matches add up."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    parts = F.struct(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("len"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
    )

    def placed(p: Column) -> Column:
        step = F.transform(p["len"], lambda n, i: F.struct(p["gap"][i].alias("gap"), n.alias("len"), p["part"][i].alias("part")))
        none = F.expr("cast(array() as array<struct<start:int,number:int,end:int>>)")

        def add(acc: Column, m: Column) -> Column:
            start = acc["at"] + m["gap"]
            end = start + m["len"]
            one = F.array(F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(m["part"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(step, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    return F.element_at(F.transform(F.array(parts), placed), 1)


#: Where a shorter match can't hide a longer one, its least length goes into the pattern, which then lists fewer matches.
_LONG = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}


def _scanned(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """row (all columns of ``documents``), text (null: empty) and found."""
    docs = documents.select(F.struct("*").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = materialize(candidates(docs.select("doc_id", "text"), rules)).withColumnRenamed("doc_id", "key")
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits["key"]), "left")
    every = sum(1 << r for r, rule in enumerate(rules) if not trigram_query(rule.pattern))
    joined = joined.withColumn("rules", F.coalesce("rules", F.lit(0)).bitwiseOR(F.lit(every).cast("long")))
    none = F.expr("cast(array() as array<struct<start:int,number:int,end:int>>)")
    each = []
    for r, rule in enumerate(rules):
        run = Rule(rule.kind, _LONG.get(rule.kind, rule.pattern), rule.group, rule.least)
        due = F.col("rules").bitwiseAND(F.lit(1 << r).cast("long")) != 0
        each.append(F.when(due & F.col("text").rlike(run.pattern), _spans(run, r)).otherwise(none))
    return joined.select("row", "text", F.array_sort(F.flatten(F.array(*each))).alias("found"))


def scan_secrets(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """All columns of ``documents`` and ``found``: an array of (start, number of the rule, end), by start, then rule.

    A column ``found`` of ``documents`` is kept; the spans then are ``found_``.
    """
    (name,) = free_names(documents, "found")
    return _scanned(documents, rules).select("row.*", F.col("found").alias(name))


def span_digest(found: DataFrame, rules: list[Rule] = RULES, name: str = "found") -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans (in column ``name``) as text."""
    found = found.select("doc_id", F.col(name).alias("found"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r.base]
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda i: F.size(F.filter("found", lambda s: s["number"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{rules[i].kind}") for i in base],
        F.sha2(written(F.filter("found", lambda s: s["number"].isin(base))), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


def redact(documents: DataFrame, rules: list[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span replaced by a mark; overlapping spans become one, null texts stay null."""
    found = _scanned(documents, rules)
    none = F.lit("")

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(s["start"], acc["at"])
        gap = F.col("text").substr(acc["at"] + 1, start - acc["at"])
        new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), new.alias("out"))

    rest = F.aggregate("found", F.struct(F.lit(0).alias("at"), none.alias("out")), step)
    clean = F.transform(F.array(rest), lambda r: F.concat(r["out"], F.col("text").substr(r["at"] + 1, F.length("text") - r["at"])))
    masked = F.when(F.size("found") > 0, F.element_at(clean, 1)).otherwise(F.col("row.text"))
    return found.select(*[masked.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in documents.columns])


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def _duck(rule: Rule, number: int) -> str:
    p = rule.pattern.replace("'", "''").replace(r"\x20", " ")
    return f"""list_filter(list_transform(range(len(regexp_extract_all(text, '{p}'))), lambda i: {{
        's': list_sum(list_transform(list_slice(string_split_regex(text, '{p}'), 1, i + 1), lambda x: length(x)))
           + coalesce(list_sum(list_transform(list_slice(regexp_extract_all(text, '{p}'), 1, i), lambda x: length(x))), 0),
        'k': {number}, 'n': length(regexp_extract_all(text, '{p}')[i + 1]),
        'g': length(regexp_extract_all(text, '{p}', {rule.group})[i + 1])}}), lambda m: m.g >= {rule.least})"""


def op9_sql(rules: list[Rule] = RULES) -> str:
    """The same over the whole table in DuckDB: every rule over every text."""
    runs = [Rule(r.kind, _LONG.get(r.kind, r.pattern), r.group, r.least) for r in rules]
    found = ", ".join(f"case when regexp_matches(text, '{r.pattern.replace(chr(39), chr(39) * 2)}') then {_duck(r, i)} else [] end" for i, r in enumerate(runs))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    base = ", ".join(str(i) for i, r in enumerate(rules) if r.base)
    written = f"array_to_string(list_transform({{}}, lambda m: {kinds}[m.k + 1] || ':' || cast(m.s as bigint) || ':' || cast(m.s + m.n as bigint)), ',')"
    counts = ", ".join(f"len(list_filter(f, lambda m: m.k = {i})) as n_{r.kind}" for i, r in enumerate(rules) if r.base)
    picked = written.format(f"list_filter(f, lambda m: m.k in ({base}))")
    return f"""with docs as (select doc_id, coalesce(text, '') as text from documents),
    hits as (select doc_id, list_sort(flatten([{found}])) as f from docs)
    select doc_id, {counts}, sha256({picked}) as base_sha256, {written.format('f')} as spans from hits"""
