"""The compiled JSON Schema: each keyword has rows that pass and rows that fail."""

import json

import pytest
from pyspark.sql import functions as F

from veriflux.functions.json_schema import schema_errors

CASES = [  # schema, documents that fit, documents that do not with one complaint
    ({"type": "object"}, [{}], [([], "$ is not of type object"), (None, "$ is not of type object")]),
    ({"type": ["string", "null"]}, ["a", None], [(1, "$ is not of type string or null")]),
    ({"type": "integer"}, [1, 2.0, -3], [(1.5, "$ is not of type integer"), ("1", "$ is not of type integer"), (True, "$ is not of type integer")]),
    ({"type": "number"}, [1, 1.5], [("1", "$ is not of type number")]),
    ({"type": "boolean"}, [True], [(0, "$ is not of type boolean")]),
    ({"enum": ["a", 1, None, True, {"k": [1]}]}, ["a", 1, 1.0, None, True, {"k": [1]}], [("b", "$ is not listed"), (2, "$ is not listed"), (False, "$ is not listed"), ("1", "$ is not listed")]),
    ({"const": "x"}, ["x"], [("y", "$ is not the constant")]),
    ({"required": ["a"]}, [{"a": None}, 5], [({"b": 1}, "$ lacks a")]),
    ({"properties": {"a": {"properties": {"b c": {"type": "string"}}}}}, [{}, {"a": {}}, {"a": {"b c": "x"}}, {"a": 1}], [({"a": {"b c": None}}, "$.a.b c is not of type string")]),
    ({"properties": {"a": {}}, "additionalProperties": False}, [{"a": 1}, {}], [({"a": 1, "z": 2}, "$ has an unknown member z")]),
    ({"additionalProperties": {"type": "string"}}, [{"q": "s"}], [({"q": 1}, "$.q is not of type string")]),
    ({"items": {"items": {"type": "string"}}}, [[], [["a"], []], "x"], [([["a"], ["b", 2]], "$[1][1] is not of type string")]),
    ({"minItems": 1}, [[0], "x"], [([], "$ has fewer than 1 elements")]),
    ({"maxItems": 1}, [[0], []], [([1, 2], "$ has more than 1 elements")]),
    ({"uniqueItems": True}, [[1, "1"], []], [([{"a": 1}, {"a": 1}], "$ has equal elements")]),
    ({"minProperties": 1}, [{"a": 1}], [({}, "$ has fewer than 1 members")]),
    ({"maxProperties": 1}, [{"a": 1}], [({"a": 1, "b": 2}, "$ has more than 1 members")]),
    ({"minLength": 2}, ["ab", "😀😀", 1], [("😀", "$ is shorter than 2")]),
    ({"maxLength": 2}, ["ab"], [("abc", "$ is longer than 2")]),
    ({"pattern": "^A[0-9]+$"}, ["A1", 5], [("xA1", "$ has a wrong form")]),
    ({"pattern": "b"}, ["abc"], [("ac", "$ has a wrong form")]),
    ({"format": "date"}, ["2024-02-29", 3], [("2023-02-29", "$ is not a date"), ("2024-2-9", "$ is not a date")]),
    ({"format": "date-time"}, ["2024-02-29T10:00:00Z", "2024-02-29T10:00:00.5+01:00"], [("2024-02-29", "$ is not a date-time"), ("2024-02-30T10:00:00Z", "$ is not a date-time")]),
    ({"format": "email"}, ["a@b.c"], [("a@b", "$ is not a email")]),
    ({"format": "uri"}, ["https://x"], [("x y", "$ is not a uri")]),
    ({"format": "uuid"}, ["12345678-1234-1234-1234-123456789abc"], [("1234", "$ is not a uuid")]),
    ({"minimum": 1}, [1, "0"], [(0.5, "$ is outside minimum 1")]),
    ({"maximum": 1}, [1], [(2, "$ is outside maximum 1")]),
    ({"exclusiveMinimum": 1}, [1.5], [(1, "$ is outside exclusiveMinimum 1")]),
    ({"exclusiveMaximum": 1}, [0], [(1, "$ is outside exclusiveMaximum 1")]),
    ({"multipleOf": 3}, [9, "x"], [(10, "$ is not a multiple of 3")]),
    ({"allOf": [{"type": "string"}, {"minLength": 2}]}, ["ab"], [("a", "$ is shorter than 2")]),
    ({"anyOf": [{"type": "string"}, {"type": "null"}]}, ["a", None], [(1, "$ fits none of 2 alternatives")]),
    ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, [1], [(6, "$ fits not exactly one of 2 alternatives")]),
    ({"not": {"type": "string"}}, [1], [("a", "$ fits what it must not")]),
    ({"$ref": "#/$defs/a", "$defs": {"a": {"type": "string"}}}, ["a"], [(1, "$ is not of type string")]),
    ({"properties": {"a": False}}, [{}], [({"a": 1}, "$.a fits what it must not")]),
]


def test_each_keyword(spark):
    for schema, fit, unfit in CASES:
        docs = [(i, json.dumps(d), want) for i, (d, want) in enumerate([*((d, None) for d in fit), *unfit])]
        rows = spark.createDataFrame(docs, "i int, d string, want string").coalesce(1)
        for r in rows.select("d", "want", schema_errors(F.try_parse_json("d"), schema).alias("e")).collect():
            assert list(r.e) == ([r.want] if r.want else []), (schema, r)


def test_no_json_and_what_is_not_supported(spark):
    got = spark.createDataFrame([('{"cut',), (None,), ("null",)], "d string").select(schema_errors(F.try_parse_json("d"), {"type": "null"}).alias("e")).collect()
    assert [list(r.e) for r in got] == [["$ is not JSON"], ["$ is not JSON"], []]
    for schema in ({"if": {}}, {"format": "hostname"}, {"$ref": "http://elsewhere"}, {"$ref": "#/a", "a": {"items": {"$ref": "#/a"}}}, {"required": ["it's"]}):
        with pytest.raises(ValueError):
            schema_errors(F.lit(None).cast("variant"), schema)
