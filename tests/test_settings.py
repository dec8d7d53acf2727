"""Settings: every level wins over those before it and is told as the origin."""

import pytest

from cartulary.sources.settings import LEVELS, Settings, resolved, variable_path

DEFAULTS = {"logging": {"level": "info"}, "embedding": {"max_chars": 1500, "batch": {"size": 50}}, "tls": {"mode": "off", "strict": False}, "models": ["a"], "ratio": 0.5}


def _all():
    files = {
        "system": {"config.yaml": {"logging": {"level": "system"}, "tls": {"mode": "system"}}},
        "system drop-ins": {"20.yaml": {"logging": {"level": "second"}}, "10.yaml": {"logging": {"level": "first"}, "models": ["b"]}},
        "user": {"config.yaml": {"logging": {"level": "user"}}},
        "user drop-ins": {"x.yaml": {"logging": {"level": "dropped in"}}},
        "profile": {"prod": {"logging": {"level": "prod"}}, "dev": {"logging": {"level": "dev"}}},
        "project": {"config.yaml": {"logging": {"level": "project"}}},
    }
    return {"files": files, "environment": {"CARTULARY_LOGLEVEL": "variable", "OTHER_LOGLEVEL": "no"}, "overrides": {"logging.level": "override"}, "profile": "prod"}


@pytest.mark.parametrize("n", range(1, 10))
def test_each_level_wins(n):
    told = _all()
    told["files"] = {k: v for k, v in told["files"].items() if LEVELS.index(k) < n}
    told["environment"] = told["environment"] if n > 7 else {}
    told["overrides"] = told["overrides"] if n > 8 else {}
    told["profile"] = "prod" if n > 5 else None
    s = resolved(DEFAULTS, **told)
    want = ["info", "system", "second", "user", "dropped in", "prod", "project", "variable", "override"][n - 1]
    assert s.get("logging.level") == want and s.origins["logging.level"][0] == LEVELS[n - 1]


def test_merge_and_origins():
    s = resolved(DEFAULTS, **_all())
    assert s.get("tls") == {"mode": "system", "strict": False} and s.get("models") == ["b"] and s.get("embedding.batch.size") == 50
    assert s.origin("tls.mode") == "system: config.yaml" and s.origin("models") == "system drop-ins: 10.yaml" and s.origin("tls.strict") == "defaults"
    assert s.origin("logging.level") == "overrides: logging.level" and DEFAULTS["models"] == ["a"]
    only = resolved(DEFAULTS, **(_all() | {"only": ("my.yaml", {"ratio": 1.5}), "overrides": {}}))
    assert only.get("ratio") == 1.5 and only.get("tls.mode") == "off" and only.origin("ratio") == "project: my.yaml" and only.get("logging.level") == "variable"
    replaced = resolved(DEFAULTS, {"user": {"u": {"tls": "none"}}, "project": {"p": {"ratio": {"low": 1}}}})
    assert replaced.get("tls") == "none" and "tls.mode" not in replaced.origins and replaced.origin("tls") == "user: u" and replaced.origin("ratio.low") == "project: p" and "ratio" not in replaced.origins


def test_variables():
    assert variable_path("EMBEDDING_MAX_CHARS", DEFAULTS) == "embedding.max_chars" and variable_path("EMBEDDING_BATCH_SIZE", DEFAULTS) == "embedding.batch.size"
    assert variable_path("NEW_THING", DEFAULTS) == "new.thing"
    env = {"CARTULARY_EMBEDDING_MAX_CHARS": "7", "CARTULARY_TLS_STRICT": "TRUE", "CARTULARY_RATIO": "2", "CARTULARY_MODELS": "x, y", "CARTULARY_EMBEDDING_BATCH_SIZE": "many", "CARTULARY_NEW_THING": "1"}
    s = resolved(DEFAULTS, environment=env)
    assert (s.get("embedding.max_chars"), s.get("tls.strict"), s.get("ratio"), s.get("models"), s.get("embedding.batch.size"), s.get("new.thing")) == (7, True, 2.0, ["x", "y"], "many", "1")
    assert s.origin("ratio") == "environment: CARTULARY_RATIO"


def test_what_is_not_there():
    with pytest.raises(LookupError):
        resolved(DEFAULTS, {"profile": {"dev": {}}}, profile="prod")
    with pytest.raises(ValueError):
        resolved(DEFAULTS, {"somewhere": {}})
    with pytest.raises(KeyError):
        Settings().get("a.b")
    assert resolved(DEFAULTS, {"profile": {"dev": {"ratio": 9}}, "user": {"empty.yaml": None}}).values == DEFAULTS
