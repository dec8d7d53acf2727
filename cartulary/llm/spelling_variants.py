"""Grouping spelling variants with forward and backward minimal acyclic automata.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Of two near words the
shorter (or either, if they are as long) has m code points; they agree on its first m // 2 or, failing that, on as many
of its last. So words are dealt by (direction, m, exact half): forward by the first half, backward, turned round, by the
last. A word comes once as the shorter and once as the longer of a pair. Each task builds minimal acyclic automata over
the words of neighbouring groups; every state knows how many words lie below it, which numbers the words (a perfect
hash), so that what a walk finds is a number. A word walks its exact half, then completes with one replaced or one
inserted code point; deletions are the insertions of the other word.

A pair is emitted once: forward if its common beginning covers the half, backward if it does not. A group with more than
``GROUP`` words is dealt anew by halves of what was not exact, again and again, so no automaton grows with a popular
beginning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.byte_grams import buffer, slices
from cartulary.llm.ranked_search import counted, runs
from cartulary.llm.shared import Scratch, table, with_columns

#: Words of so many code points and occurrences count; one run in so many loses a code point; a form is so
#: many times as frequent.
LEAST_LENGTH, LEAST_COUNT, LOSES, TIMES = 7, 2, 31, 10
#: Groups with more words are dealt anew; an automaton is built over whole groups of so many words together.
GROUP, TOGETHER = 50_000, 20_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z or the code points U+00C0 to U+00FF, whose first byte is always C3."""
    inside = _LETTER[raw]
    lead = raw == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    return inside


def altered(word: str, prefix: int) -> str:
    """A run without one of its code points, if the crc32 of its document's id and itself says so; ``prefix`` is the
    crc32 of ``<doc_id>:``."""
    h = zlib.crc32(word.encode(), prefix)
    return word if h % LOSES else word[: h % len(word)] + word[h % len(word) + 1 :]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) and how often they occur, counted in each run of texts first."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            raw, starts = buffer(batch.column("text"))
            words, number, at, n = counted(*runs(_LOWER[raw], starts, letters(raw)), batch.num_rows)
            words = words.to_pylist()
            prefixes = [zlib.crc32(f"{i}:".encode()) for i in batch.column("id").to_pylist()]
            found: dict[str, int] = {}
            for k, a, c in zip(number.tolist(), at.tolist(), n.tolist(), strict=True):
                if len(words[k]) >= LEAST_LENGTH and len(word := altered(words[k], prefixes[a])) >= LEAST_LENGTH:
                    found[word] = found.get(word, 0) + c
            yield with_columns(batch.slice(0, 0), [], {"word": pa.array(list(found), pa.string()), "n": list(found.values())})

    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """A minimal acyclic automaton over distinct words in order; the k-th of them has the number k."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""
        for word in words:
            same = 0
            for x, y in zip(word, last):  # noqa: B905
                if x != y:
                    break
                same += 1
            self._close(path, last, same, known)
            for c in word[same:]:
                self.edges.append({})
                self.final.append(False)
                self.edges[path[-1]][c] = len(self.edges) - 1
                path.append(len(self.edges) - 1)
            self.final[path[-1]] = True
            last = word
        self._close(path, last, 0, known)
        # How many words lie below a state, and what each of its edges adds to a word's number.
        self.below: dict[int, int] = {}
        self.steps: dict[int, dict[str, tuple[int, int]]] = {}
        self._number()

    def _close(self, path: list[int], word: str, upto: int, known: dict[tuple, int]) -> None:
        """The states of ``word`` behind its first ``upto`` letters are done: each is replaced by an equal one."""
        while len(path) > upto + 1:
            state = path.pop()
            what = (self.final[state], tuple(self.edges[state].items()))
            kept = self.edges[path[-1]][word[len(path) - 1]] = known.setdefault(what, state)
            if kept != state:
                self.edges[state] = {}

    def _number(self) -> None:
        stack = [0]
        while stack:
            state = stack[-1]
            rest = [t for t in self.edges[state].values() if t not in self.below]
            if rest:
                stack += rest
                continue
            stack.pop()
            if state not in self.below:
                at, out = int(self.final[state]), {}
                for c, t in self.edges[state].items():
                    out[c] = (t, at)
                    at += self.below[t]
                self.steps[state], self.below[state] = out, at

    def walk(self, state: int, number: int, word: str, at: int) -> tuple[int, int] | None:
        """The state and the number that ``word`` leads to from its place ``at`` on."""
        steps = self.steps
        for k in range(at, len(word)):
            to = steps[state].get(word[k])
            if to is None:
                return None
            state, number = to[0], number + to[1]
        return state, number

    def one_error(self, word: str, exact: int) -> set[int]:
        """The numbers of the words that begin with ``exact`` letters of ``word`` and differ from it by one replaced or
        one inserted letter behind them."""
        found: set[int] = set()
        start = self.walk(0, 0, word[:exact], 0)
        if start is None:
            return found
        state, number = start
        for k in range(exact, len(word) + 1):
            steps, own = self.steps[state], word[k] if k < len(word) else None
            for c, (to, add) in steps.items():
                if c != own:
                    if own is not None and (end := self.walk(to, number + add, word, k + 1)) and self.final[end[0]]:
                        found.add(end[1])
                    if (end := self.walk(to, number + add, word, k)) and self.final[end[0]]:
                        found.add(end[1])
            if own is None or own not in steps:
                return found
            state, number = steps[own][0], number + steps[own][1]
        return found


def common(x: str, y: str) -> int:
    """How many letters two words have in common from the start."""
    n = 0
    for a, b in zip(x, y):  # noqa: B905
        if a != b:
            break
        n += 1
    return n


def halves(words: DataFrame) -> DataFrame:
    """(back, m, low, high, key, text, word, n, role) of words (word, n): where they are dealt to. ``text`` is the word
    as its direction reads it; the error lies from ``low`` to ``high``; role 0 is the shorter of a pair, 1 the longer."""
    roles = F.explode(F.array(*[F.struct(F.lit(bool(b)).alias("back"), F.lit(r).alias("role")) for b in (0, 1) for r in (0, 1)])).alias("_as")
    each = words.select("word", "n", roles).select("word", "n", "_as.*")
    each = each.withColumns({"m": F.length("word") - F.col("role"), "text": F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))})
    each = each.where(F.col("m") >= LEAST_LENGTH).withColumns({"low": F.floor(F.col("m") / 2).cast("int"), "high": F.col("m")})
    return each.withColumn("key", key_of())


def key_of() -> Column:
    """A hash of what the words of a group have in common; equal hashes only put groups together."""
    tail = F.col("m") - F.col("high")
    end = F.when(tail > 0, F.expr("right(text, m - high)")).otherwise(F.lit(""))
    return F.xxhash64("back", "m", "low", "high", F.expr("left(text, low)"), end)


def dealt(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``halves``, dealt anew where a group has more than ``GROUP`` words, as long as there is something to part."""
    done, rest = None, halves(words)
    while True:
        rest = scratch.write(rest)
        sizes = rest.groupBy("key").count().select("key", ((F.col("count") > GROUP)).alias("_many"))
        parts = rest.join(sizes, "key").withColumn("_many", F.col("_many") & (F.col("high") - F.col("low") > 1))
        few = parts.where("not _many").drop("_many")
        done = few if done is None else done.unionByName(few)
        many = parts.where("_many").drop("_many")
        if many.isEmpty():
            return done
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        parted = F.explode(F.array(F.struct(mid.alias("low"), F.col("high")), F.struct(F.col("low"), mid.alias("high")))).alias("_to")
        rest = many.select("back", "role", "m", "text", "word", "n", parted).select("back", "role", "m", "text", "word", "n", "_to.*")
        rest = rest.withColumn("key", key_of())


def pairs_in(rows: list[tuple]) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near word, its n) of the rows (back, role, m, text, n, low, high) of whole groups of one direction."""
    counts = {r[3]: r[4] for r in rows}
    words = sorted(counts)
    automaton = Automaton(words)
    for back, role, m, text, n, low, high in rows:
        if role:
            continue
        for k in automaton.one_error(text, low):
            other = words[k]
            begin, end = common(text, other), common(text[::-1], other[::-1])
            # Whose error it is: of the parts of a parted group that which the common beginning ends in; of the two
            # directions the forward one, unless the beginning is too short for it.
            if begin < low or (high < m and begin >= high) or (back and end >= m // 2):
                continue
            if back:
                yield text[::-1], n, other[::-1], counts[other]
                if len(other) > m:
                    yield other[::-1], counts[other], text[::-1], n
            else:
                yield text, n, other, counts[other]
                if len(other) > m:
                    yield other, counts[other], text, n


def near(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, other, other_n): each word of (word, n) with each word near it, once."""

    def run(batches):
        held: list[tuple] = []
        last = None

        def out():
            found = list(zip(*pairs_in(held), strict=True)) or [[]] * 4
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "other", "other_n"])

        for batch in batches:
            keys, rows = batch.column("key").to_pylist(), zip(*(batch.column(c).to_pylist() for c in ("back", "role", "m", "text", "n", "low", "high")), strict=True)
            for key, row in zip(keys, rows, strict=True):
                if held and key != last and (len(held) >= TOGETHER or held[-1][0] != row[0]):
                    yield out()
                held.append(row)
                last = key
        if held:
            yield out()

    groups = dealt(words, scratch).select("key", "back", "role", "m", "text", "n", "low", "high").repartition("key").sortWithinPartitions("back", "key")
    return groups.mapInArrow(run, "word string, n long, other string, other_n long")


def grouped(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text); other columns are not carried.

    A word's form is the most frequent word near it (ties: the smallest in code-point order), if that is at least
    ``TIMES`` times as frequent; its root is where forms lead in the end. A null text has no words; a null doc_id counts
    as empty. Repeated rows count as often as they are there. A run of letters may be of any length. An empty table has
    no words.
    """
    words = scratch.write(vocabulary(docs))
    best = F.min(F.struct((-F.col("other_n")).alias("_less"), F.col("other").alias("_form")))
    found = near(words, scratch).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    frequent = -F.col("_best._less") >= TIMES * F.col("n")
    form = {"form": F.when(frequent, F.col("_best._form")), "form_n": F.when(frequent, -F.col("_best._less")), "n_near": F.coalesce("n_near", F.lit(0).cast("long"))}
    formed = scratch.write(words.join(found, "word", "left").withColumns(form).drop("_best"))
    # Each round a word's root becomes its root's root: a chain of c forms takes about log2(c) rounds, and as each form is
    # TIMES as frequent as the one before, c is 18 at most.
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = scratch.write(roots)
        step = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
        if step.where("_next is not null").isEmpty():
            break
        roots = step.select("word", F.coalesce("_next", "root").alias("root"))
    named = formed.join(roots, "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))
