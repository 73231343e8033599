"""Secret scans through an inverted index of trigrams."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen3d.llm.common import shared_table, whole_text

try:
    from re import _parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """Matches of pattern are found from the left without overlap; those whose group has under min_length characters are dropped after that."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0


def either_case(words: str) -> str:
    """A pattern for the words with ASCII letters in either case (flags fold more than ASCII in some engines)."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12)
ACCESS = Rule("access", "AKIA[A-Z0-9]+", 0, 18)
HEX = Rule("hex", "[0-9a-f]+", 0, 16)
BASE = (ASSIGN, ACCESS, HEX)
#: Token formats that public services document.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# A trigram query is a set of alternatives, each a set of trigrams that must all occur. The empty alternative is
# always true: a rule with it has no mandatory trigrams.
Query = frozenset
ANY: Query = frozenset({frozenset()})
MOST_STRINGS = 64


def trigram_query(pattern: str) -> Query:
    """The trigrams, lower-cased, without which the pattern cannot match: alternatives of sets.

    Nodes of the parsed pattern that stand for few strings are multiplied out; a run of them ends at a node that
    stands for many, and each run demands the trigrams of one of its strings.
    """
    return simplified(_demand(sre.parse(pattern)))


def simplified(query: Query) -> Query:
    return frozenset(a for a in query if not any(b < a for b in query))


def both(a: Query, b: Query) -> Query:
    return simplified(frozenset(x | y for x in a for y in b))


def _strings(token) -> set[str] | None:
    """All strings, lower-cased, that the node stands for, if they are few."""
    kind, value = token
    name = str(kind)
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN":
        if any(str(k) not in ("LITERAL", "RANGE") for k, _ in value):
            return None
        chars = {chr(c).lower() for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))}
        return chars if len(chars) <= 8 else None
    if name == "SUBPATTERN":
        return _product(value[-1])
    if name == "BRANCH":
        parts = [_product(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, body = value
        inner = _product(body)
        if inner is None or int(most) > 4:
            return None
        return set().union(*({"".join(x) for x in itertools.product(inner, repeat=n)} for n in range(least, int(most) + 1)))
    return None


def _product(tokens) -> set[str] | None:
    found = {""}
    for token in tokens:
        more = _strings(token)
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _of(strings: set[str]) -> Query:
    return simplified(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _demand(tokens) -> Query:
    query, run = ANY, {""}
    for token in tokens:
        more = _strings(token)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        query = both(query, _of(run))
        run = {""}
        if more is not None:
            run = more
        elif str(token[0]) == "SUBPATTERN":
            query = both(query, _demand(token[1][-1]))
        elif str(token[0]) == "BRANCH":
            query = both(query, simplified(frozenset().union(*(_demand(x) for x in token[1][1]))))
        elif str(token[0]) in ("MAX_REPEAT", "MIN_REPEAT") and token[1][0] > 0:
            query = both(query, _demand(token[1][2]))
    return both(query, _of(run))


#: Letters and the space by how often English text has them; trigrams that begin with what is not among them are the rarest.
COMMON = " etaoinshrdlcumwfgypbvkjxqz"


def demanded(query: Query, most: int = 2) -> Query:
    """The query with the rarest trigrams of each alternative, as their first characters go: what it lets through is no less."""
    rarity = lambda gram: (-(COMMON.index(gram[0]) if gram[0] in COMMON else len(COMMON)), gram)
    return simplified(frozenset(frozenset(sorted(a, key=rarity)[:most]) for a in query))


def any_of(grams: Sequence[str]) -> str:
    """A pattern that matches, without consuming it, any of the trigrams at a place, as group 1: a tree over their characters, behind the class of the first."""

    def tree(ends: set[str]) -> str:
        by_first: dict[str, set[str]] = {}
        for end in ends:
            if end:
                by_first.setdefault(end[0], set()).add(end[1:])
        parts = [re.escape(c) + tree(rest) for c, rest in sorted(by_first.items())]
        return f"(?:{'|'.join(parts)})" if len(parts) > 1 else "".join(parts)

    firsts = "".join(re.escape(c) for c in sorted({g[0] for g in grams}))
    return f"(?=[{firsts}])(?=({tree(set(grams))}))"


def candidates(docs: DataFrame, rules: Sequence[Rule], id_col: str, text_col: str, rows_per_block: int = 4096) -> DataFrame:
    """(key, mask): documents that the trigram queries of the rules let through, a bit per rule.

    The index holds the trigrams that the queries demand, which one pass over a text finds. Documents are dealt
    into blocks of about rows_per_block by a hash of their key; a posting list is the sorted keys of one trigram in
    one block, so that no list grows with the corpus, however common its trigram. Each block's lists are
    intersected and united on their own.
    """
    queries = {i: demanded(q) for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ANY}
    grams = sorted(set().union(*(a for q in queries.values() for a in q)))
    blocks = -(-docs.count() // rows_per_block) or 1
    lowered = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("key"), F.lower(whole_text(text_col)).alias("low"))
    named = F.array_distinct(F.regexp_extract_all("low", F.lit(any_of(grams)), F.lit(1))) if grams else F.array().cast("array<string>")
    held = lowered.select("key", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.explode(named).alias("gram"))
    postings = held.groupBy("block", "gram").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    none = F.array().cast("array<bigint>")
    by_block = postings.groupBy("block").agg(*[F.coalesce(F.first(F.when(F.col("gram") == g, F.col("keys")), ignorenulls=True), none).alias(f"g{n}") for n, g in enumerate(grams)])
    of = lambda alternative: functools.reduce(F.array_intersect, [F.col(f"g{grams.index(g)}") for g in sorted(alternative)])
    with_bit = lambda bit: lambda k: F.struct(k.alias("key"), F.lit(bit).alias("bit"))
    hits = [F.transform(functools.reduce(F.array_union, [of(a) for a in sorted(q, key=sorted)]), with_bit(1 << i)) for i, q in queries.items()]
    return by_block.select(F.explode(F.concat(*hits)).alias("hit")).groupBy("hit.key").agg(F.bit_or("hit.bit").alias("mask"))


#: Matches of a text that are added up at once.
RUN = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Matches of a rule as structs (start, order, end) in code points: gaps and matches in turn add up to places."""
    pattern = F.lit(rule.pattern)
    lengths = lambda texts: F.transform(texts, F.length)
    empty = F.array().cast("array<struct<start:int,order:int,end:int>>")

    def parts_of(whole: Column) -> Column:
        values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
        return F.arrays_zip(F.slice(lengths(F.split(text, rule.pattern, -1)), 1, F.size(whole)).alias("gap"), lengths(whole).alias("n"), lengths(values).alias("v"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["n"]
        found = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(part["v"] >= rule.min_length, F.concat(state["found"], found)).otherwise(state["found"]).alias("found"))

    def summed(run: Column, begin: Column) -> Column:
        return F.aggregate(run, F.struct(begin.alias("at"), empty.alias("found")), step, lambda state: state["found"])

    # a list that grows by one is copied each time: matches add up in runs of RUN, and runs' lengths among themselves
    def in_runs(parts: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(RUN)), lambda i: F.slice(parts, i, RUN))
        return bound(runs, lambda r: F.flatten(F.zip_with(r, begins_of(r), summed)))

    def begins_of(runs: Column) -> Column:
        total = lambda run: F.aggregate(run, F.lit(0), lambda n, part: n + part["gap"] + part["n"])
        return F.aggregate(F.slice(runs, 1, F.size(runs) - 1), F.array(F.lit(0)), lambda before, run: F.concat(before, F.array(F.element_at(before, -1) + total(run))))

    of_parts = lambda parts: F.when(F.size(parts) > RUN, in_runs(parts)).otherwise(summed(parts, F.lit(0)))
    return bound(F.regexp_extract_all(text, pattern, F.lit(0)), lambda whole: bound(parts_of(whole), of_parts))


def longest_first(rule: Rule) -> str:
    """A pattern that must occur for a rule to keep any match; for a run of one class, its shortest kept length."""
    run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{run[1]}{{{rule.min_length}}}" if run and rule.min_length else rule.pattern


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = BASE + MORE, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id and found, an array of structs (kind, start, end), by start and then by rule.

    Boolean trigram queries are derived from the patterns and answered by the inverted index of candidates();
    only what they let through is verified with the expression itself. A rule without mandatory trigrams is
    tried on each text. Starts and ends count code points; ends are exclusive.

    The candidates are identifiers and bit masks. They are counted: up to broadcast_rows they are sent to each
    task, so that texts stay where they are; beyond, they are joined by identifier.

    Null text counts as empty and has no spans. Rows with a null or repeated identifier share candidates, which
    are a superset then, and are verified each on its own. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    found = shared_table(candidates(docs, rules, id_col, text_col), "secret-candidates")
    found = F.broadcast(found) if found.count() <= broadcast_rows else found
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("key")).join(found, "key", "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    each = []
    for i, rule in enumerate(rules):
        scanned = trigram_query(rule.pattern) == ANY
        wanted = F.rlike("body", F.lit(longest_first(rule))) if scanned else F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
        each.append(F.when(wanted, spans_of(F.col("body"), rule, i)).otherwise(none))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    placed = rows.select("id", F.array_sort(F.concat(*each)).alias("spans"))
    return placed.select(F.col("id").alias("doc_id"), F.transform("spans", lambda s: F.struct(F.element_at(kinds, s["order"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
