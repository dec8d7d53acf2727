"""Artifacts grouped by sums over their words, against going through them one by one."""

import random

import pytest

from cartulary.functions.parsers import ARTIFACT_TYPES
from cartulary.operators import consensus

SCHEMA = f"control_id string, vote_key string, parse_status string, artifacts array<struct<{consensus.ARTIFACT.replace(' ', ':').replace(',:', ',')}>>"
NAMES = ["a", "The", "an ", None, "", "...", "Policy", "the  policy.", "policy log", "LOG policy..", "audit log", "Audit  log of policy", "x y", "\x1cthe x\x85 y .", "a b c d", "d e f g", "b c"]


def one_by_one(votes, threshold):
    """{control: [(name, type, frequency, owner_role, description, properties, voters, confidence, unanimous)]}"""
    found = {}
    for control in {v[0] for v in votes}:
        own = sorted((v for v in votes if v[0] == control), key=lambda v: v[1])
        groups = []
        for _, key, status, artifacts in own:
            for a in (artifacts or []) if status == "OK" else []:
                words = (a[0] or "").lower().strip().rstrip(".").split()
                words = set(words[1:] if words and words[0] in ("the", "a", "an") else words)
                home = next((g for g in groups if words and g[0] and len(words & g[0]) / min(len(words), len(g[0])) >= threshold), None)
                if home is None:
                    groups.append(home := (words, []))
                home[1].append((key, a))
        rows = []
        for _, members in groups:
            kinds = [a[1] for _, a in members]
            properties = {}
            for _, a in members:
                properties = dict(a[5] or {}) | properties
            filled = [next((a[i] for _, a in members if a[i]), "") for i in (0, 2, 3)]
            voters = sorted({k for k, _ in members})
            rows.append((
                filled[0], min(set(kinds), key=lambda t: (-kinds.count(t), ARTIFACT_TYPES.index(t))), *filled[1:], max((a[4] or "" for _, a in members), key=lambda d: len(d.encode())),
                properties, voters, int(len(voters) / len(own) * 1000 + 0.5) / 1000, len(voters) == len(own),
            ))
        if rows:
            found[control] = sorted(rows, key=repr)
    return found


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0, 1.5])
def test_as_one_by_one(spark, threshold):
    rng = random.Random(threshold)
    text = lambda *more: rng.choice([None, "", "é", "ab", "ba", *more])
    artifact = lambda: (rng.choice(NAMES), rng.choice(ARTIFACT_TYPES[:3]), text(), text(), text("long"), rng.choice([None, {}, {"k": text()}, {"k": "1", "l": text()}]))
    votes = [(f"c{c}", f"v{v}", rng.choice(["OK"] * 5 + ["PARSE_FAIL", None]), rng.choice([None, *[[artifact() for _ in range(rng.randrange(5))] for _ in range(6)]])) for c in range(25) for v in range(rng.choice([1, 5, 14]))]
    got = {}
    for r in consensus.artifact_consensus(spark.createDataFrame(votes, SCHEMA).repartition(3), threshold).collect():
        got.setdefault(r.control_id, []).append((r.name, r.type, r.frequency, r.owner_role, r.description, dict(r.properties), r.voters, r.confidence, r.unanimous))
    plain = lambda rows: sorted((*r[:5], sorted(r[5].items(), key=repr), *r[6:]) for r in rows)
    assert {c: plain(rows) for c, rows in got.items()} == {c: plain(rows) for c, rows in one_by_one(votes, threshold).items()}


def test_no_vote_goes_to_python(spark):
    """A control's votes are summed up before its groups are told, so no call holds them all."""
    plan = consensus.artifact_consensus(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "partial_min" in plan
