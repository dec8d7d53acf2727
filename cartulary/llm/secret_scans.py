"""Secret scans over a trigram inverted index, in DataFrame expressions only.

``trigram_query`` derives from a rule's pattern which trigrams a matching text must hold, as an OR of ANDs. The index
has a posting (trigram, row key) for each query trigram that a text holds; ``candidates`` intersects the postings of
each rule by row key; only candidate rows are joined to their texts and verified with the pattern. A rule that has no
mandatory trigram scans every text. The index is folded to lower case, so it only ever offers too many rows.

Row keys are 64-bit hashes of doc_id and text: equal rows share one and are verified once. Two different rows of one hash
would share the spans of one of them; of 10^9 rows 0.03 such pairs are expected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost, non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in the order in which spans of one start are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Well-known public formats of keys and tokens.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("code_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "array<struct<start:int,rank:int,end:int>>"
#: The positions of so many matches are added up at once.
AT_ONCE = 256

#: A rule's query keeps at most so many alternatives; beyond that the trigrams of one side are left out, which only
#: makes more candidates.
MOST_ALTERNATIVES = 48

Query = frozenset  # of frozensets of trigrams: any of them, all in it
ANY = frozenset({frozenset()})


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_ALTERNATIVES:
        return min(a, b, key=len)
    return frozenset(x | y for x in a for y in b)


def _either(*queries: Query) -> Query:
    found = frozenset().union(*queries)
    return ANY if frozenset() in found or len(found) > MOST_ALTERNATIVES else found


def _of_strings(strings: set[str]) -> Query:
    return _either(*(frozenset({frozenset(s[i : i + 3] for i in range(len(s) - 2))}) for s in strings))


def _exact(op, arg) -> set[str] | None:
    """The few strings that a node of a pattern can match, in lower case, or None."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        sizes = [1 if k is C.LITERAL else v[1] - v[0] + 1 if k is C.RANGE else 99 for k, v in arg]
        if sum(sizes) > 5:
            return None
        return {chr(x).lower() for k, v in arg for x in ([v] if k is C.LITERAL else range(v[0], v[1] + 1))}
    if op is C.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is C.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
        part = _exact_all(arg[2])
        return None if part is None else part | ({""} if arg[0] == 0 else set())
    if op is C.AT:
        return {""}
    return None


def _exact_all(nodes) -> set[str] | None:
    strings = {""}
    for op, arg in nodes:
        part = _exact(op, arg)
        if part is None or len(strings) * len(part) > MOST_ALTERNATIVES:
            return None
        strings = {a + b for a in strings for b in part}
    return strings


def _query(nodes) -> Query:
    found, run = ANY, {""}
    for op, arg in nodes:
        part = _exact(op, arg)
        if part is not None and len(run) * len(part) <= MOST_ALTERNATIVES:
            run = {a + b for a in run for b in part}
            continue
        found, run = _both(found, _of_strings(run)), {""}
        if part is not None:
            run = part
        elif op is C.SUBPATTERN:
            found = _both(found, _query(arg[-1]))
        elif op is C.BRANCH:
            found = _both(found, _either(*map(_query, arg[1])))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            found = _both(found, _query(arg[2]))
    return _both(found, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams, of which a text that matches holds at least one whole; ANY if nothing is mandatory.

    >>> sorted(map(sorted, trigram_query("ab(cd|ef)g*")))
    [['abc', 'bcd'], ['abe', 'bef']]
    """
    found = _query(list(_parser.parse(pattern)))
    return frozenset(q for q in found if not any(other < q for other in found))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "_key", text: str = "text") -> DataFrame:
    """The inverted index for the rules: a row (trigram, key) for each query trigram in a text."""
    grams = sorted({g for r in rules for q in trigram_query(r.pattern) for g in q})
    folded = docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("_folded", F.lit(g)), F.lit(g)) for g in grams]))
    return folded.select(F.explode(held).alias("trigram"), key)


def candidates(index: DataFrame, rules: tuple[Rule, ...], key: str = "_key") -> DataFrame:
    """Rows (key, kinds): the rules whose query the intersected postings of a key satisfy."""
    held = index.groupBy(key).agg(F.collect_set("trigram").alias("_held"))

    def satisfied(query: Query) -> Column:
        return reduce(
            lambda a, b: a | b,
            [F.size(F.array_except(F.array(*map(F.lit, sorted(q))), "_held")) == 0 for q in sorted(query, key=sorted)],
        )

    kinds = F.array_compact(F.array(*[F.when(satisfied(trigram_query(r.pattern)), F.lit(r.kind)) for r in rules]))
    return held.select(key, kinds.alias("_kinds")).where(F.size("_kinds") > 0)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """All spans of a rule in a text as (start, rank, end), by start, in code points.

    The text is split at the matches; the lengths of the pieces and the matches, added up, are the positions. They are
    added up by ``AT_ONCE`` matches, since each append copies what is there.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    lengths = F.transform(found, F.length)
    groups = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.least else lengths
    steps = F.arrays_zip(F.transform(pieces, F.length).alias("p"), lengths.alias("m"), groups.alias("g"))
    steps = F.array(F.filter(steps, lambda x: x["m"].isNotNull()))  # one item, so that its name stands for it below
    parts = F.flatten(
        F.transform(steps, lambda s: F.transform(F.sequence(F.lit(0), F.size(s), F.lit(AT_ONCE)), lambda i: F.slice(s, i + 1, AT_ONCE)))
    )

    def walked(part: Column, at: Column) -> Column:
        span = lambda a, x: F.struct((a["at"] + x["p"]).alias("start"), F.lit(rank).alias("rank"), (a["at"] + x["p"] + x["m"]).alias("end"))
        return F.aggregate(
            part,
            F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["p"] + x["m"]).alias("at"),
                F.when(x["g"] >= rule.least, F.array_append(a["out"], span(a, x))).otherwise(a["out"]).alias("out"),
            ),
            lambda a: a["out"],
        )

    spans = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda a, part: F.struct(
            F.aggregate(part, a["at"], lambda at, x: at + x["p"] + x["m"]).alias("at"),
            F.array_append(a["out"], walked(part, a["at"])).alias("out"),
        ),
        lambda a: F.flatten(a["out"]),
    )
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(SPAN))


def _verified(text: Column, rules: list[tuple[int, Rule]], kinds: Column | None) -> Column:
    each = [
        spans_of(text, r, i) if kinds is None else F.when(F.array_contains(kinds, r.kind), spans_of(text, r, i)).otherwise(F.array().cast(SPAN))
        for i, r in rules
    ]
    return F.concat(F.array().cast(SPAN), *each)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds ``spans``: array of (start, rank, end) by start and rank; rank counts the rules from 0.

    ``docs`` needs doc_id and ``text``; a null text counts as empty and has no spans. Repeated rows each get their
    spans. Other columns stay, but one named spans is replaced, and names starting with _ are reserved.
    """
    ranked = list(enumerate(rules))
    full = [(i, r) for i, r in ranked if frozenset() in trigram_query(r.pattern)]
    indexed = [(i, r) for i, r in ranked if frozenset() not in trigram_query(r.pattern)]
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", text))
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = keyed.withColumn("_full", _verified(t, full, None))
    if not indexed:
        return keyed.withColumn("spans", F.array_sort("_full")).drop("_key", "_full")
    some = candidates(postings(keyed, tuple(r for _, r in indexed)), tuple(r for _, r in indexed))
    texts = docs.select(F.xxhash64("doc_id", text).alias("_key"), t.alias("_text"))
    verified = (
        texts.join(some, "_key")
        .select("_key", _verified(F.col("_text"), indexed, F.col("_kinds")).alias("_some"))
        .where(F.size("_some") > 0)
        .groupBy("_key")
        .agg(F.first("_some").alias("_some"))
    )
    joined = keyed.join(verified, "_key", "left")
    spans = F.array_sort(F.concat("_full", F.coalesce("_some", F.array().cast(SPAN))))
    return joined.withColumn("spans", spans).drop("_key", "_full", "_some")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span replaced by ``mark``; spans that overlap or touch are one."""
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(
                (x["start"] > a["at"]) | ((a["at"] == 0) & (x["start"] == 0)),
                F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark))),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, walked).otherwise(text)


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Without the texts: the join by row key then only moves spans.
    s = scan(docs).drop("text")
    n = lambda rank: F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE_RULES))
    return s.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
