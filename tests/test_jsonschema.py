import json

import pytest
from pyspark.sql import functions as F

from quayside.functions.jsonschema import issues, violations
from quayside.schemas import DOCUMENT_SCHEMAS
from quayside.sinks import publish

CASES = [
    ({"type": "integer"}, "1.0", []),
    ({"type": "integer"}, "1.5", [("", "type")]),
    ({"type": "integer"}, "true", [("", "type")]),
    ({"type": ["number", "null"]}, "null", []),
    ({"type": ["number", "null"]}, '"1"', [("", "type")]),
    ({"type": "object"}, "{}", []),
    ({"type": "array"}, "[]", []),
    ({"const": 1}, "1.0", []),
    ({"const": True}, "1", [("", "const")]),
    ({"enum": ["a", None]}, "null", []),
    ({"enum": ["a", None]}, '"b"', [("", "enum")]),
    ({"minimum": 0, "maximum": 1}, '"x"', []),
    ({"minimum": 0, "exclusiveMaximum": 1}, "1", [("", "exclusiveMaximum")]),
    ({"minLength": 2, "maxLength": 3}, '"\U0001f600"', [("", "minLength")]),
    ({"pattern": "Z$"}, '"aZ"', []),
    ({"pattern": "Z$"}, '"Za"', [("", "pattern")]),
    ({"required": ["a", "b"]}, '{"a": null}', [("/b", "required")]),
    ({"properties": {"a/b~c": {"type": "string"}}}, '{"a/b~c": 1}', [("/a~1b~0c", "type")]),
    ({"properties": {"a": {}}, "additionalProperties": False}, '{"a": 1, "z/": 2, "b": 3}', [("/b", "additionalProperties"), ("/z~1", "additionalProperties")]),
    ({"additionalProperties": {"type": "integer", "minimum": 0}}, '{"a": 1, "b": -1, "c": "x"}', [("/b", "minimum"), ("/c", "type")]),
    ({"items": {"items": {"type": "string"}}}, '[["a"], ["b", 1], 3]', [("/1/1", "type")]),
    ({"items": False, "maxItems": 0}, "[1]", [("", "maxItems"), ("/0", "false")]),
    ({"if": {"properties": {"n": {"const": 0}}}, "then": {"properties": {"v": {"type": "null"}}}, "else": {"required": ["v"]}}, '{"n": 0, "v": 1}', [("/v", "type")]),
    ({"if": {"properties": {"n": {"const": 0}}}, "then": {"properties": {"v": {"type": "null"}}}}, '{"v": 1}', [("/v", "type")]),
    ({"if": {"properties": {"n": {"const": 0}}}, "else": {"required": ["v"]}}, '{"n": 1}', [("/v", "required")]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, "2", [("", "anyOf")]),
    ({"not": {"type": "null"}}, "null", [("", "not")]),
    ({"$ref": "#/$defs/id", "type": "null", "$defs": {"id": {"type": "string"}}}, "1", [("", "type")]),
    ({"type": "object"}, '{"a": 1', [("", "json")]),
    ({"type": "object"}, '{"a": 1, "a": 2}', [("", "json")]),
    ({"type": "object"}, None, [("", "json")]),
]


@pytest.mark.parametrize("schema,text,want", CASES)
def test_issues_of_a_document(spark, schema, text, want):
    rows = spark.createDataFrame([(text,)], "t string")
    assert sorted((r.path, r.rule) for r in violations(rows, "t", schema).collect()) == want


@pytest.mark.parametrize("schema", [{"patternProperties": {}}, {"const": {}}, {"type": "text"}, {"$ref": "other.json"}, {"properties": {"a'": {}}}, {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}])
def test_what_can_not_be_compiled_is_refused(spark, schema):
    with pytest.raises(ValueError):
        issues(F.col("v"), schema)


def test_a_document_that_does_not_conform_is_not_published(spark, tmp_path):
    event = {"event_id": "evt-000000-000001", "equipment_id": "QC-001", "terminal_id": "TM-001", "event_timestamp": "2024-01-01T00:00:00Z", "state": "IDLE", "available": True}
    over = {"terminal_id": "TM-001", "source_period_start": "a", "source_period_end": "b", "availability": {"available_intervals": 1, "scheduled_intervals": 2, "value": 0.5}}
    shape = "event_id string, equipment_id string, terminal_id string, event_timestamp string, state string, available boolean"
    go = lambda *events: publish.publish(f"{tmp_path}", {"overview": over, "event-replay": spark.createDataFrame(list(events), shape)}, snapshot_id="s", quality_status="PASS", period=("a", "b"), schemas={k: DOCUMENT_SCHEMAS[k] for k in ("event-replay",)})
    with pytest.raises(publish.PublishError, match="enum fails at /state"):
        go(event, event | {"state": "BROKEN"})
    assert not (tmp_path / "manifest.json").exists() and not list(tmp_path.glob(".staging*"))
    assert go(event) == json.loads((tmp_path / "manifest.json").read_text())
