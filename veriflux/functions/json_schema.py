"""JSON Schema as Column expressions over VARIANT: a schema becomes one expression that lists a document's errors.

The schema is compiled once, on the driver; documents are checked in the JVM,
each in its row. A VARIANT tells an absent member from a null one. Every error
is a text `PATH COMPLAINT`, with `$` for the document, `.name` for members and
`[i]` for elements, whose places are those of the document at hand.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that check nothing.
NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
FORMATS = {
    "date": lambda s: s.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(s, "yyyy-MM-dd").isNotNull(),
    "date-time": lambda s: s.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(F.upper(s)).isNotNull(),
    "email": lambda s: s.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    "uri": lambda s: s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"),
    "uuid": lambda s: s.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
}
TEXTS = "array<string>"


def kind(s: Column) -> Column:
    """null, boolean, number, string, array, object or other, from what schema_of_variant() says; SQL null where there is no value."""
    out = F.when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
    return out.when(s.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"), "number").when(s.isNotNull(), "other")


def named(value: Column, use) -> Column:
    """use(value), with the value named, so that it is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def bound(value: Column, use) -> Column:
    """use(value, its kind)."""
    kinds = lambda v: named(F.schema_of_variant(v), lambda s: named(kind(s), lambda k: use(v, k)))
    return named(value, kinds)


def member(v: Column, name: str) -> Column:
    if "'" in name or "\\" in name:
        raise ValueError(f"member names with quotes or backslashes are not supported: {name!r}")
    return F.try_variant_get(v, f"$['{name}']", "variant")


def number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


class Compiler:
    def __init__(self, schema: dict):
        self.root = schema

    def resolved(self, schema: dict | bool, inside: frozenset) -> tuple[dict, frozenset]:
        """A schema without $ref, and the references that led to it; they are to parts of the same document and may not go in circles."""
        if isinstance(schema, bool):
            return ({} if schema else {"not": {}}), inside
        while "$ref" in schema:
            at = schema["$ref"]
            if not at.startswith("#/") or at in inside:
                raise ValueError(f"unsupported $ref {at!r}")
            inside, target = inside | {at}, self.root
            for part in at[2:].split("/"):
                target = target[part.replace("~1", "/").replace("~0", "~")]
            schema = {**target, **{k: x for k, x in schema.items() if k != "$ref"}}
        return schema, inside

    def errors(self, value: Column, schema: dict | bool, path: Column, inside: frozenset = frozenset()) -> Column:
        """The errors of a value; an array without nulls, empty where there is no value."""
        return bound(value, lambda v, k: F.when(k.isNull(), F.array().cast(TEXTS)).otherwise(self.errors_of(v, k, *self.resolved(schema, inside), path)))

    def errors_of(self, v: Column, k: Column, schema: dict, inside: frozenset, path: Column) -> Column:
        found, more = [], []

        def fail(condition: Column, complaint: str | Column) -> None:
            said = F.lit(complaint) if isinstance(complaint, str) else complaint
            found.append(F.when(F.coalesce(condition, F.lit(False)), F.concat(path, F.lit(" "), said)))

        def nested(condition: Column, errors: Column) -> None:
            more.append(F.when(F.coalesce(condition, F.lit(False)), errors).otherwise(F.array().cast(TEXTS)))

        is_, text = (lambda name: k == name), F.when(k == "string", F.try_variant_get(v, "$", "string"))
        elements = F.when(is_("array"), F.try_variant_get(v, "$", "array<variant>"))
        members = F.when(is_("object"), F.try_variant_get(v, "$", "map<string,variant>"))
        for word, want in schema.items():
            if word in NOTES:
                continue
            elif word == "type":
                wanted = [want] if isinstance(want, str) else want
                fits = F.lit(False)
                for t in wanted:
                    fits = fits | ((is_("number") & (F.floor(number(v)) == number(v))) if t == "integer" else is_(t))
                fail(~fits, f"is not of type {' or '.join(wanted)}")
            elif word in ("enum", "const"):
                listed = want if word == "enum" else [want]
                plain = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in listed if isinstance(x, bool) or not isinstance(x, (int, float))]
                numbers = [float(x) for x in listed if not isinstance(x, bool) and isinstance(x, (int, float))]
                same = F.coalesce(F.to_json(v).isin(plain), F.lit(False)) if plain else F.lit(False)
                fail(~(same | F.coalesce(is_("number") & number(v).isin(numbers), F.lit(False)) if numbers else same), "is not listed" if word == "enum" else "is not the constant")
            elif word == "required":
                for name in want:
                    fail(is_("object") & member(v, name).isNull(), f"lacks {name}")
            elif word == "properties":
                for name, part in want.items():
                    nested(is_("object"), self.errors(member(v, name), part, F.concat(path, F.lit(f".{name}")), inside))
            elif word == "additionalProperties":
                known = list(schema.get("properties", {}))
                others = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(known)) if known else F.map_entries(members)
                if want is not True:
                    inner = lambda e: F.array(F.concat(path, F.lit(" has an unknown member "), e["key"])) if want is False else self.errors(e["value"], want, F.concat(path, F.lit("."), e["key"]), inside)
                    nested(is_("object"), F.flatten(F.transform(others, inner)))
            elif word == "items":
                nested(is_("array"), F.flatten(F.transform(elements, lambda e, i: self.errors(e, want, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), inside))))
            elif word in ("minItems", "maxItems"):
                fail(F.size(elements) < want if word == "minItems" else F.size(elements) > want, f"has {'fewer' if word == 'minItems' else 'more'} than {want} elements")
            elif word == "uniqueItems":
                texts = F.transform(elements, lambda e: F.to_json(e))
                fail(F.lit(bool(want)) & (F.size(F.array_distinct(texts)) < F.size(texts)), "has equal elements")
            elif word in ("minProperties", "maxProperties"):
                fail(F.size(members) < want if word == "minProperties" else F.size(members) > want, f"has {'fewer' if word == 'minProperties' else 'more'} than {want} members")
            elif word in ("minLength", "maxLength"):
                fail(F.length(text) < want if word == "minLength" else F.length(text) > want, f"is {'shorter' if word == 'minLength' else 'longer'} than {want}")
            elif word == "pattern":
                re.compile(want)
                fail(~text.rlike(want), "has a wrong form")
            elif word == "format":
                if want not in FORMATS:
                    raise ValueError(f"unsupported format {want!r}")
                fail(text.isNotNull() & ~FORMATS[want](text), f"is not a {want}")
            elif word in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
                n = F.when(is_("number"), number(v))
                outside = {"minimum": n < want, "maximum": n > want, "exclusiveMinimum": n <= want, "exclusiveMaximum": n >= want}[word]
                fail(outside, f"is outside {word} {want}")
            elif word == "multipleOf":
                n = F.when(is_("number"), number(v) / want)
                fail(F.floor(n) != n, f"is not a multiple of {want}")
            elif word in ("allOf", "anyOf", "oneOf"):
                parts = [self.errors(v, part, path, inside) for part in want]
                if word == "allOf":
                    more += parts
                else:
                    n = sum((F.size(p) == 0).cast("int") for p in parts)
                    fail(n == 0 if word == "anyOf" else n != 1, f"fits {'none' if word == 'anyOf' else 'not exactly one'} of {len(parts)} alternatives")
            elif word == "not":
                fail(F.size(self.errors(v, want, path, inside)) == 0, "fits what it must not")
            else:
                raise ValueError(f"unsupported keyword {word!r}")
        own = F.array_compact(F.array(*found)) if found else F.array().cast(TEXTS)
        return F.concat(own.cast(TEXTS), *more) if more else own.cast(TEXTS)


def schema_errors(document: Column, schema: dict) -> Column:
    """The errors of a VARIANT document by a JSON Schema, as an array of texts; a null document is no JSON.

    Type, enum, const, members, elements, sizes, lengths, patterns, bounds,
    formats and combinations are checked; a keyword that is not known raises
    ValueError, so nothing goes unchecked in silence.
    """
    compiled = Compiler(schema)
    return named(document, lambda d: F.when(d.isNull(), F.array(F.lit("$ is not JSON"))).otherwise(compiled.errors(d, schema, F.lit("$"))))
