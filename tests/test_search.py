"""Stems, positions, cover density and pages."""

import pytest

from cartulary.functions.stemmer import STOP_WORDS, lexeme, stem
from cartulary.operators import search

#: Published examples of the rules.
STEMS = {
    "consign": "consign", "consigned": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consistently": "consist", "consolation": "consol",
    "consolations": "consol", "consolatory": "consolatori", "consolidate": "consolid", "consolidating": "consolid", "consoling": "consol", "conspicuous": "conspicu", "conspiracy": "conspiraci",
    "constancy": "constanc", "knack": "knack", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead", "kneeling": "kneel", "knightly": "knight", "knitting": "knit",
    "knives": "knive", "knocker": "knocker", "knotted": "knot", "generously": "generous", "generate": "generat", "generic": "generic", "communism": "communism", "arsenal": "arsenal",
    "skies": "sky", "dying": "die", "news": "news", "inning": "inning", "proceed": "proceed", "exceeding": "exceed", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this",
    "gaps": "gap", "kiwis": "kiwi", "luxuriated": "luxuri", "hopping": "hop", "hoped": "hope", "by": "by", "say": "say", "cry": "cri", "enjoy": "enjoy", "youth": "youth", "boyish": "boyish",
    "beautiful": "beauti", "beauty": "beauti", "bedded": "bed", "shedding": "shed", "rated": "rate", "sized": "size", "policies": "polici", "policy": "polici", "procedures": "procedur", "organization": "organ",
    "organizational": "organiz", "authorization": "author", "authorized": "author", "security": "secur", "malicious": "malici", "accountability": "account", "integrity": "integr",
    "encryption": "encrypt", "disseminate": "dissemin", "develop": "develop", "requirements": "requir", "management": "manag", "relational": "relat", "conditional": "condit",
    "rational": "ration", "hopefulness": "hope", "digitizer": "digit", "analogi": "analog", "apologies": "apolog", "electrical": "electr", "goodness": "good", "adoption": "adopt",
    "controlling": "control", "roll": "roll", "probate": "probat", "cease": "ceas", "agreed": "agre", "feed": "feed", "plastered": "plaster", "sing": "sing", "bled": "bled", "motoring": "motor",
    "falling": "fall", "filing": "file", "happy": "happi", "sensibiliti": "sensibl", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "formaliti": "formal", "decisiveness": "decis",
}


@pytest.mark.parametrize("word", STEMS)
def test_stem(word):
    assert stem(word) == STEMS[word]


def test_lexeme():
    assert lexeme("the") is None and lexeme("controls") == "control" and len(STOP_WORDS) == 127
    assert [stem(w) for w in ("", "a", "as", "'s", "'em's", "yes", "yyy")] == ["", "a", "as", "'s", "em", "yes", "yyy"]


def _vector(spark, *row):
    c = spark.createDataFrame([("c", "c/1", *row)], "catalog_id string, control_id string, title string, statement string, identifier string")
    return sorted((x.pos, x.lexeme, x.weight) for x in search.indexed(c).first()["_vector"])


def test_positions(spark):
    assert _vector(spark, "The Access Controls of", "A risk-based policy, 3.5 times", "ac-1") == [
        (2, "access", 1.0), (3, "control", 1.0), (5, "risk-bas", 0.4), (6, "risk", 0.4), (7, "base", 0.4), (8, "polici", 0.4), (9, "3.5", 0.4), (10, "time", 0.4), (11, "ac", 1.0), (12, "-1", 1.0),
    ]
    assert _vector(spark, None, None, None) == [] and _vector(spark, "", "the of", "x2y") == [(1, "x2y", 1.0)]
    assert _vector(spark, "word " * 20_000, None, None)[-1] == (16383, "word", 1.0)


def test_cover_density():
    rank = search.cover_density
    assert rank([(1, "a", 1.0), (2, "b", 1.0)], 2) == pytest.approx(1.0)
    assert rank([(1, "a", 1.0), (5, "b", 1.0)], 2) == pytest.approx(1 / 4)  # three other words between
    assert rank([(1, "a", 1.0), (2, "b", 0.4), (4, "a", 0.4)], 2) == pytest.approx(2 / 3.5 + 2 / 5 / 2)
    assert rank([(1, "a", 1.0), (3, "a", 1.0), (4, "b", 1.0), (9, "c", 1.0)], 3) == pytest.approx(3 / 3 / (1 + 6 - 2))  # the shortest that ends there
    assert rank([(3, "a", 0.4), (7, "a", 1.0)], 1) == pytest.approx(0.4 + 1.0) and rank([(1, "a", 1.0)], 2) == 0 == rank([], 1)
    assert rank([(16383, "a", 1.0), (16383, "b", 1.0)], 2) == pytest.approx(1.0)  # positions are not told apart any more


@pytest.fixture(scope="module")
def controls(spark):
    rows = [
        ("c", "c/ac-1", "ac-1", "Access Control Policy", "Develop, document, and disseminate an access control policy."),
        ("c", "c/au-1", "au-1", "Audit Policy", "Develop, document, and disseminate an audit and accountability policy."),
        ("c", "c/si-1", "si-1", "System and Information Integrity Policy", "Develop system integrity procedures for malicious code protection."),
        ("d", "d/ac-1", "ac-1", "Other", "Controls access; controlled accesses"),
        ("d", "d/x", None, None, None),
    ]
    return spark.createDataFrame(rows, "catalog_id string, control_id string, identifier string, title string, statement string")


def test_search_both_ways(spark, controls):
    index = search.indexed(controls).cache()
    stored = search.postings(index).cache()
    for query in ("access control", "malicious code", "policies", "xyznonexistent", "the", "", "develops documents", "ac-1", "procedure for integrity"):
        by_vector = {(r.control_id, round(r["rank"], 9)) for r in search.found(index, query).collect()}
        assert by_vector == {(r.control_id, round(r["rank"], 9)) for r in search.ranked(stored, query).collect()}
    assert [r.control_id for r in search.top(search.found(index, "access control")).collect()] == ["c/ac-1", "d/ac-1"]
    assert [r.control_id for r in search.top(search.found(index, "access control", ["d"])).collect()] == ["d/ac-1"]
    assert [r.control_id for r in search.ranked(stored, "malicious code").collect()] == ["c/si-1"]
    assert search.ranked(stored, "the").count() == 0 == search.found(index, "xyznonexistent").count()
    # Covers at 1-2, 2-(1+8), ... : "Access Control Policy" then positions 4 on in the statement.
    rank = {r.control_id: r["rank"] for r in search.found(index, "access control").collect()}
    assert rank["c/ac-1"] == pytest.approx(1.0 + 2 / 3.5 / (1 + (9 - 2) - 1) + 2 / 5)


def test_pages(spark, controls):
    hits = search.found(search.indexed(controls), "policy")
    rows, total, following = search.page(hits, 2, 0)
    assert (total, following) == (3, 2) and [r.place for r in rows.collect()] == [1, 2]
    rows, total, following = search.page(hits, 2, 2)
    assert (total, following) == (3, 3) and [(r.place, r.control_id) for r in rows.collect()] == [(3, search.top(hits).collect()[2].control_id)]
    assert search.clamped(0) == 50 == search.clamped(-3) and search.clamped(5000) == 1000
    rows, total, following = search.page(hits, 10, 7)
    assert (rows.count(), total, following) == (0, 3, 7)
