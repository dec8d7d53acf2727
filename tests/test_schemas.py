"""JSON Schema: each rule, references, and catalogs with faults told by place."""

import hashlib
import json

import pytest

from cartulary.operators import tables
from cartulary.sources import catalogs, files, schemas
from cartulary.sources.schemas import Schema, SchemaError

#: Of the kind that catalogs are published with: names by reference, patterns with classes of letters, closed objects.
CATALOG = {
    "$schema": "http://json-schema.org/draft-07/schema#",
    "type": "object",
    "properties": {"catalog": {"$ref": "#catalog"}},
    "required": ["catalog"],
    "additionalProperties": False,
    "definitions": {
        "token": {"type": "string", "pattern": "^(\\p{L}|_)(\\p{L}|\\p{N}|[.\\-_])*$"},
        "catalog:one": {
            "$id": "#catalog",
            "type": "object",
            "properties": {"uuid": {"type": "string", "pattern": "^[0-9a-f-]{4,}$"}, "controls": {"type": "array", "minItems": 1, "items": {"$ref": "#/definitions/control"}}, "groups": {"type": "array", "minItems": 1, "items": {"$ref": "#/definitions/group"}}},
            "required": ["uuid"],
            "additionalProperties": False,
        },
        "group": {"type": "object", "properties": {"id": {"$ref": "#/definitions/token"}, "title": {"type": "string"}, "controls": {"type": "array", "items": {"$ref": "#/definitions/control"}}, "groups": {"type": "array", "items": {"$ref": "#/definitions/group"}}}, "required": ["title"]},
        "control": {
            "type": "object",
            "properties": {"id": {"$ref": "#/definitions/token"}, "title": {"type": "string"}, "class": {"anyOf": [{"$ref": "#/definitions/token"}, {"enum": ["free form"]}]}, "controls": {"type": "array", "items": {"$ref": "#/definitions/control"}}, "parts": {"type": "array", "items": {"type": "object", "required": ["name"]}}},
            "required": ["id", "title"],
            "additionalProperties": False,
        },
    },
}


def _control(name, **more):
    return {"id": name, "title": name.upper()} | more


GOOD = {"catalog": {"uuid": "00-ff", "controls": [_control("ac-1", controls=[_control("ac-1.1")])], "groups": [{"title": "g", "id": "é_1", "groups": [{"title": "h", "controls": [_control("b", **{"class": "free form"})]}]}]}}


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": "integer"}, [1, 1.0, -3], [1.5, "1", True, None]),
        ({"type": ["number", "null"]}, [1, 1.5, None], [False, "x"]),
        ({"enum": [1, "a", None, [1]]}, [1, 1.0, "a", None, [1.0]], [True, "b", [True]]),
        ({"const": {"a": [1]}}, [{"a": [1]}], [{"a": [2]}, {"a": [True]}, {}]),
        ({"minLength": 2, "maxLength": 3, "pattern": "^\\p{L}+$"}, ["éa", "abc", 5], ["a", "abcd", "a1"]),
        ({"minimum": 1, "exclusiveMaximum": 3}, [1, 2.9, "x"], [0, 0.5, 3]),
        ({"multipleOf": 0.1}, [0.3, 1], [0.35]),
        ({"items": {"type": "string"}, "minItems": 1, "maxItems": 2, "uniqueItems": True}, [["a"], ["a", "b"]], [[], ["a", "a"], ["a", "b", "c"], [1]]),
        ({"uniqueItems": True}, [[1, True, "1", [1]]], [[1, 1.0], [{"a": 1}, {"a": 1.0}]]),
        ({"prefixItems": [{"type": "string"}], "items": False}, [["a"], []], [["a", 1], [1]]),
        ({"items": [{"type": "string"}], "additionalItems": {"type": "null"}}, [["a", None]], [["a", 1]]),
        ({"contains": {"const": 3}}, [[1, 3]], [[], [1]]),
        ({"properties": {"a": {"type": "string"}}, "patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, [{}, {"a": "s", "x1": 1}], [{"b": 1}, {"x1": "s"}, {"a": 1}]),
        ({"additionalProperties": {"type": "integer"}, "minProperties": 1, "maxProperties": 2}, [{"a": 1}], [{}, {"a": "x"}, {"a": 1, "b": 2, "c": 3}]),
        ({"propertyNames": {"maxLength": 2}, "required": ["a"]}, [{"a": 1}], [{"b": 1}, {"a": 1, "abc": 2}]),
        ({"dependentRequired": {"a": ["b"]}}, [{}, {"b": 1}, {"a": 1, "b": 1}], [{"a": 1}]),
        ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1, 2], [0, 3]),
        ({"oneOf": [{"minimum": 1}, {"maximum": 2}]}, [0, 3], [1]),
        ({"not": {"type": "null"}}, [1], [None]),
        ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 2}}, ["ab", 2], ["a", 1]),
        (True, [1, None], []),
        (False, [], [1]),
        ({"$defs": {"n": {"$anchor": "here", "type": "null"}}, "$ref": "#here"}, [None], [1]),
        ({"properties": {"next": {"$ref": "#"}}, "additionalProperties": False}, [{"next": {"next": {}}}], [{"next": {"other": 1}}]),
    ],
)
def test_rules(schema, good, bad):
    s = Schema(schema)
    assert all(s.faults(x) == [] for x in good) and all(s.faults(x) for x in bad)


def test_schemas_that_cannot_be_used():
    for text in ("{", "3", '{"$ref": "#/nowhere"}', '{"$ref": "http://elsewhere/x"}', '{"properties": {"a": {"pattern": "("}}}', '{"patternProperties": {"[": {}}}'):
        with pytest.raises(SchemaError):
            Schema.of(text)
    with pytest.raises(SchemaError):
        Schema({"$ref": "#/definitions/a", "definitions": {"a": {"$ref": "#/definitions/a"}}}).faults(1)
    assert Schema({"enum": [{"$ref": "#/nowhere"}]}).faults({"$ref": "#/nowhere"}) == []  # data, no reference


def test_faults_by_place(spark):
    def broken(change):
        document = json.loads(json.dumps(GOOD))
        change(document["catalog"])
        return json.dumps(document)

    rows = {
        "good": json.dumps(GOOD),
        "no json": "{",
        "null": None,
        "no uuid": broken(lambda c: c.pop("uuid")),
        "deep": broken(lambda c: c["groups"][0]["groups"][0]["controls"][0].update({"id": "1b", "x/y": 1})),
        "child": broken(lambda c: c["controls"][0]["controls"][0].pop("title")),
        "class": broken(lambda c: c["controls"][0].update({"class": "not free"})),
        "two": broken(lambda c: c.update(controls=[], groups="none")),
    }
    docs = spark.createDataFrame(list(rows.items()), "path string, content string").repartition(3)
    found = schemas.faults(docs, json.dumps(CATALOG)).collect()
    assert sorted((r.path, r.at, r.rule) for r in found) == sorted([
        ("no json", "", "json"), ("null", "", "json"), ("no uuid", "/catalog", "required"), ("deep", "/catalog/groups/0/groups/0/controls/0/id", "pattern"),
        ("deep", "/catalog/groups/0/groups/0/controls/0/x~1y", "additionalProperties"), ("child", "/catalog/controls/0/controls/0", "required"), ("class", "/catalog/controls/0/class", "anyOf"),
        ("two", "/catalog/controls", "minItems"), ("two", "/catalog/groups", "type"),
    ])
    good = schemas.valid(docs, json.dumps(CATALOG))
    assert [r.path for r in good.collect()] == ["good"] and catalogs.flatten(good).count() > 0
    assert {r.rule: (r.n, r.n_documents) for r in schemas.summary(schemas.faults(docs, json.dumps(CATALOG))).collect()}["json"] == (2, 2)
    with pytest.raises(SchemaError):
        schemas.faults(docs, "{")
    assert schemas.faults(docs.limit(0), json.dumps(CATALOG)).count() == 0


def test_import_tells_the_first_fault(spark):
    bad = {"catalog": {"uuid": "00-ff", "controls": [{"id": "1", "title": "t"}]}}
    docs = spark.createDataFrame([("good", json.dumps(GOOD)), ("bad", json.dumps(bad)), ("none", "{}")], "path string, content string")
    rows = catalogs.flatten(docs, schema=json.dumps(CATALOG)).collect()
    errors = {r.path: r.error for r in rows if r.error}
    assert errors.keys() == {"bad", "none"} and errors["bad"].startswith("schema: /catalog/controls/0/id: pattern") and "catalog is missing" in errors["none"]
    assert {r.id for r in rows if r.path == "good"} == {r.id for r in catalogs.flatten(docs).collect() if r.path == "good"} != set()
    assert any(r.id == "1" for r in catalogs.flatten(docs).collect())  # without a schema it is a control
    with pytest.raises(SchemaError):
        catalogs.flatten(docs, schema="[]")


def test_provenance_is_that_of_the_files(spark, tmp_path):
    docs = spark.createDataFrame([("a", json.dumps(GOOD)), ("b", json.dumps(GOOD))], "path string, content string")
    items = catalogs.flatten(docs.where("path = 'a'"))
    record = catalogs.exported(items, "title", "1", str(tmp_path / "out"), docs)
    data = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert record["output_hash"] == hashlib.sha256(data).hexdigest() and record["output_size"] == len(data) and json.loads(data)["catalog"]["metadata"]["title"] == "title"
    assert (record["source_files"], record["source_size"]) == (2, 2 * len(json.dumps(GOOD).encode())) and (record["extractor_name"], record["extractor_version"]) == catalogs.EXTRACTOR
    one = hashlib.sha256(json.dumps(GOOD).encode()).hexdigest()
    assert record["source_hash"] == hashlib.sha256(f"{one}\n{one}".encode()).hexdigest()


def test_large_files_are_told(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "large").write_bytes(b"x" * 50)
    got = {r.path.rsplit("/", 1)[1]: (r.length, None if r.content is None else bytes(r.content), r.error) for r in files.landed(spark, str(tmp_path), 10).collect()}
    assert got == {"small": (3, b"abc", None), "large": (50, None, "upload exceeds maximum size of 10 bytes")}


def test_lookup(spark, tmp_path):
    spark.createDataFrame([("t", "c1", 1), ("t", "c2", 2), ("u", "c1", 3)], "tenant_id string, catalog_id string, n int").write.parquet(str(tmp_path / "c"))
    own = spark.read.parquet(str(tmp_path / "c")).where("tenant_id = 't'")
    assert tables.lookup(own, catalog_id="c1").first().n == 1 and "PushedFilters: [IsNotNull(tenant_id)" in tables.lookup(own, catalog_id="c1")._jdf.queryExecution().toString()
    for key in ({"catalog_id": "c3"}, {"catalog_id": "c1", "n": 3}, {"catalog_id": None}):
        with pytest.raises(LookupError):
            tables.lookup(own, **key)
