"""Ranked search, source mixing and spelling variants against brute force, on nulls, ties, repeats, long texts, empty tables and clashes."""

import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cartulary.llm import ranked_search, source_mix, spelling_variants
from cartulary.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize(("module", "name"), [(ranked_search, "op13_ranked_search"), (source_mix, "op11_source_mix")])
def test_sql(spark, module, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    df = getattr(module, name)(spark, SF)
    want = sorted(con.execute(f"select {', '.join(df.columns)} from ({module.SQL})").fetchall())
    assert sorted(map(tuple, df.collect())) == want and len(want) > 0


# ranked search


def best_by_force(docs, items, k):
    texts = [(d, TERM.findall((t or "").translate(SMALL))) for d, t in docs]
    texts = [(d, t) for d, t in texts if t]
    n_all, n_docs, asked = sum(len(t) for _, t in texts), len(texts), {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(SMALL)))
    out = []
    for i, terms in asked.items():
        found = []
        for d, t in texts:
            score = 0
            for term in terms:
                if tf := t.count(term):
                    df = sum(term in u for _, u in texts)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * (1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * len(t) * n_docs // n_all)))
            if score > 0:
                found.append((-score, d is None, d or 0, d, score))
        out += [(i, r + 1, x[3], x[4]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


DOCS = [
    (5, "Alpha beta, gamma-delta Été İx 42"), (1, "alpha ALPHA alpha été"), (1, "alpha ALPHA alpha été"), (2, None), (3, ""), (4, " -- \n"), (None, "beta gamma"),
    (6, "beta gamma"), (7, "beta gamma"), (8, "delta " * 30_000 + "beta"), (9, "\U0001f600x 中文 beta_gamma"), *((100 + i, "common word " + "x" * (i % 7)) for i in range(60)),
]
ITEMS = [(1, "alpha Beta"), (2, "common x"), (2, "common gamma"), (None, "delta 中文"), (3, None), (4, "nothing here"), (5, "common word"), (5, "common word"), (6, " ")]


def test_search_by_force(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, term string, rank int").repartition(3)
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, w int")
    for block in (ranked_search.BLOCK, 100):
        monkeypatch.setattr(ranked_search, "BLOCK", block)
        for k in (1, 10, 1000):
            got = ranked_search.search(docs, items, Scratch(spark, "test"), k).collect()
            assert sorted(map(tuple, got), key=repr) == best_by_force(DOCS, ITEMS, k)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items, Scratch(spark, "test")).count() == 0
    assert ranked_search.search(docs, items.limit(0), Scratch(spark, "test")).count() == 0


def test_postings_hold_every_term(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(2)
    rows = ranked_search.indexed(docs).where("term is not null").selectExpr("term", "inline(arrays_zip(tf, n_terms))").collect()
    want = sorted((w, t.count(w), len(t)) for t in (TERM.findall((x or "").translate(SMALL)) for _, x in DOCS) for w in set(t))
    assert sorted(map(tuple, rows)) == want


# source mixing


def targets_by_force(words, share=1.5, most=2):
    left, out, weights = share * sum(words), {}, {i: (5, 2, 1)[i % 3] for i in range(len(words))}
    while weights:
        each = left / sum(weights.values())
        full = [i for i in weights if each * weights[i] > most * words[i]]
        if not full:
            return [out.get(i, each * weights.get(i, 0)) for i in range(len(words))]
        for i in full:
            out[i] = most * words[i]
            left -= out[i]
            del weights[i]
    return [out[i] for i in range(len(words))]


@pytest.mark.parametrize("words", [[100, 1, 50, 7, 900, 3, 20], [5], [0, 0], [0, 10, 0, 3], [1000, 1000, 1000], list(range(1, 40))])
def test_targets_by_force(spark, words):
    sources = spark.createDataFrame([(f"s{i:03d}" if i + 1 < len(words) else None, w, 1) for i, w in enumerate(words)], "source string, words long, n long")
    got = {r.source: r.target for r in source_mix.targets(sources, Scratch(spark, "test")).collect()}
    want = targets_by_force(words)
    for i, t in enumerate(want):
        assert got[f"s{i:03d}" if i + 1 < len(words) else None] == pytest.approx(t)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "CELL", 20)
    rows = [(i, "w " * (i * 37 % 101), ("a", "b", "é", None)[i % 4], "x", 9) for i in range(400)]
    rows += [(None, "one two", "a", "", 1), (3, "same", "b", "", 1), (3, "same", "b", "", 1), (7, None, "empty", "", 1), (8, " \n", "empty", "", 1), (9, "v " * 50_000, "b", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, taken long")
    once = source_mix.mixed(docs.repartition(5), Scratch(spark, "test")).collect()
    assert sorted(map(tuple, once), key=repr) == sorted(map(tuple, source_mix.mixed(docs.repartition(2), Scratch(spark, "test")).collect()), key=repr)
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in once) == sorted((r[0] is None, r[0], len((r[1] or "").split())) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in once)
    by = {}
    for r in once:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert len(by) == 5 and all(sum(t) == math.floor(target + 0.5) for (_, target), t in by.items())
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))
    assert source_mix.mixed(docs.limit(0), Scratch(spark, "test")).count() == 0


def test_pareto_keeps_unequal_probabilities(spark):
    p = [0.1, 0.3, 0.5, 0.9, 1.4, 2.0]
    docs = spark.range(6000).selectExpr("'g' as group", "1L as size", f"element_at(array({', '.join(map(str, p))}), int(id % 6) + 1) as copies", "id")
    docs = docs.withColumn("copies", F.col("copies").cast("double")).withColumn("place", F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 13), 16, 10).cast("long"))
    wanted = spark.createDataFrame([("g", 5200)], "group string, words long")
    taken = {r.k: r.n / 1000 for r in source_mix.pareto(docs, wanted, Scratch(spark, "test")).groupBy(F.expr("id % 6").alias("k")).agg(F.sum("taken").alias("n")).collect()}
    assert sum(taken.values()) == pytest.approx(5.2) and taken == pytest.approx(dict(enumerate(p)), abs=0.05)


# spelling variants

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def forms_by_force(docs):
    n = {}
    for d, text in docs:
        for run in LETTERS.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def are_near(x, y):
        if abs(len(x) - len(y)) > 1 or x == y:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        x, y = sorted((x, y), key=len)
        return any(y[:k] + y[k + 1 :] == x for k in range(len(y)))

    near = {w: [x for x in n if are_near(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def words_of(rng, alphabet):
    made = ["".join(rng.choices(alphabet, k=rng.randrange(6, 12))) for _ in range(60)]
    for _ in range(260):
        w = rng.choice(made)
        k, c = rng.randrange(len(w) + 1), rng.choice(alphabet)
        made.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]]))
    return made


@pytest.mark.parametrize(("alphabet", "group", "together"), [("ab", 50_000, 20_000), ("abcdefgé×", 4, 1), ("aab", 3, 10), ("aaaabÿ", 1, 1)])
def test_variants_by_force(spark, monkeypatch, alphabet, group, together):
    monkeypatch.setattr(spelling_variants, "GROUP", group)
    monkeypatch.setattr(spelling_variants, "TOGETHER", together)
    rng = random.Random(alphabet)
    words = words_of(rng, alphabet)
    docs = [(i, " ".join(rng.choices(words, weights=[1000 // (k + 1) + 1 for k in range(len(words))], k=400))) for i in range(30)]
    docs += [(None, "Abababab-ABABABAB Ébababab"), (3, None), (4, ""), (5, "12 _"), (6, docs[0][1]), (6, docs[0][1]), (7, "x" * 70_000 + " " + "x" * 70_000)]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling_variants.grouped(df, Scratch(spark, "test")).collect()
    want = forms_by_force(docs)
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got) == want
    assert any(w[4] > 1 for w in want) and any(w[1] for w in want)


def test_variants_follow_forms_to_the_root(spark):
    chain = ["variante", "variantes", "variantess", "variantesse", "variantessen"]
    docs = [(i, f"{w} " * 10 ** (5 - k) * 2) for k, w in enumerate(chain) for i in [k]]
    found = {r.word: (r.form, r.root) for r in spelling_variants.grouped(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark, "test")).collect()}
    assert [found[w][1] for w in chain if w in found] == [chain[0]] * sum(w in found for w in chain) and sum(w in found for w in chain) > 3


def test_variants_of_nothing(spark):
    docs = spark.createDataFrame([(1, "of few letters"), (2, None)], "doc_id long, text string")
    assert spelling_variants.grouped(docs, Scratch(spark, "test")).count() == 0
    assert spelling_variants.grouped(docs.limit(0), Scratch(spark, "test")).count() == 0


def test_automaton_numbers_and_is_minimal():
    words = sorted({"abcdefg", "abcdefgh", "abxdefg", "bbcdefg", "zzcdefg", "abcdeft", "abcdeftt"})
    a = spelling_variants.Automaton(words)
    assert [a.walk(0, 0, w, 0)[1] for w in words] == list(range(len(words)))
    kinds = {(a.final[s], tuple(a.edges[s].items())) for s in a.below}
    assert len(kinds) == len(a.below)
