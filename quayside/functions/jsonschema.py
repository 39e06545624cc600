"""JSON Schema (draft 7) compiled into one Column that returns a document's issues.

A document is a variant, so types are those of the JSON text.  An issue has a path (a
JSON pointer; for a missing or additional property that of the property) and the keyword
that failed.  ``format`` and titles are annotations; patterns are Java's, where ``$`` also
matches before a last line end.  Numbers compare as doubles.  A schema with keywords
other than those below, or one that refers to itself, is refused when it is compiled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUES = "array<struct<path: string, rule: string>>"

_ANNOTATIONS = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format"}
_NUMBERS = {"minimum": "__lt__", "maximum": "__gt__", "exclusiveMinimum": "__le__", "exclusiveMaximum": "__ge__"}
_SIZES = {"minLength": ("string", "__lt__"), "maxLength": ("string", "__gt__"), "minItems": ("array", "__lt__"), "maxItems": ("array", "__gt__")}
_OTHER = {"$ref", "type", "const", "enum", "pattern", "properties", "required", "additionalProperties", "items", "allOf", "anyOf", "not", "if", "then", "else"}


def issues(document: Column, schema: dict | bool, root: dict | None = None) -> Column:
    """Issues of a variant; of none where it is SQL's null.  ``root`` holds the definitions, if not ``schema`` itself."""
    return _Compiler(root if root is not None else schema).check(_Value(document), schema, F.lit(""), ())


def violations(rows: DataFrame, text: str, schema: dict | bool, *keep: str, root: dict | None = None) -> DataFrame:
    """(keep..., path, rule) of every issue of the JSON texts in a column.

    A text that is no JSON, or repeats a key in an object, has the rule ``json``; a null text too.
    """
    held = rows.select(*keep, F.try_parse_json(text).alias("_document"))
    broken = F.array(_issue(F.lit(""), "json"))
    found = F.when(F.col("_document").isNull(), broken).otherwise(issues(F.col("_document"), schema, root))
    return held.select(*keep, F.explode(found).alias("_issue")).select(*keep, "_issue.path", "_issue.rule")


def _issue(path: Column, rule: str) -> Column:
    return F.struct(path.alias("path"), F.lit(rule).alias("rule"))


def _none() -> Column:
    return F.array().cast(ISSUES)


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _when(wrong: Column, path: Column, rule: str) -> Column:
    return F.when(wrong, F.array(_issue(path, rule))).otherwise(_none())


def _any(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _below(path: Column, name: str) -> Column:
    return F.concat(path, F.lit("/" + name.replace("~", "~0").replace("/", "~1")))


class _Value:
    """A variant whose type and readings are built once, however many rules ask for them."""

    def __init__(self, column: Column):
        self.column = column
        self._kind = F.schema_of_variant(column)
        self._held: dict[str, Column] = {}

    def get(self, kind: str) -> Column:
        if kind not in self._held:
            self._held[kind] = F.try_variant_get(self.column, F.lit("$"), kind)
        return self._held[kind]

    def is_(self, kind: str) -> Column:
        """Whether it is of a type of JSON Schema."""
        if (name := f"is {kind}") not in self._held:
            self._held[name] = self._test(kind)
        return self._held[name]

    def _test(self, kind: str) -> Column:
        if kind in ("object", "array"):
            return self._kind.startswith(f"{kind.upper()}<")
        if kind in ("null", "boolean", "string"):
            return self._kind == {"null": "VOID", "boolean": "BOOLEAN", "string": "STRING"}[kind]
        if kind == "number":
            return self._kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        if kind == "integer":
            return (self._kind == "BIGINT") | (self.is_("number") & (self.get("double") == F.floor(self.get("double"))))
        raise ValueError(f"unknown type {kind!r}")

    def equals(self, wanted: object) -> Column:
        if wanted is None:
            return self.is_("null")
        if isinstance(wanted, bool):
            return self.is_("boolean") & (self.get("boolean") == wanted)
        if isinstance(wanted, (int, float)):
            return self.is_("number") & (self.get("double") == float(wanted))
        if isinstance(wanted, str):
            return self.is_("string") & (self.get("string") == wanted)
        raise ValueError("only scalars can be compared with const and enum")


class _Compiler:
    def __init__(self, root: dict | bool):
        self.root = root

    def _definition(self, ref: str) -> dict | bool:
        if not ref.startswith("#/"):
            raise ValueError(f"only references into the schema itself are known, not {ref!r}")
        found = self.root
        for name in ref[2:].split("/"):
            found = found[name.replace("~1", "/").replace("~0", "~")]
        return found

    def check(self, value: _Value, schema: dict | bool, path: Column, trail: tuple[str, ...]) -> Column:
        if isinstance(schema, bool):
            return _none() if schema else F.array(_issue(path, "false"))
        if unknown := set(schema) - _ANNOTATIONS - _OTHER - set(_NUMBERS) - set(_SIZES):
            raise ValueError(f"unknown keywords {sorted(unknown)}")
        if "$ref" in schema:  # what stands beside it does not count
            ref = schema["$ref"]
            if ref in trail:
                raise ValueError(f"{ref} refers to itself")
            return self.check(value, self._definition(ref), path, (*trail, ref))
        parts = [*self._scalars(value, schema, path)]
        if {"properties", "required", "additionalProperties"} & set(schema):
            parts.append(F.when(value.is_("object"), _joined([*self._object(value, schema, path, trail)])).otherwise(_none()))
        if "items" in schema:
            each = F.transform(value.get("array<variant>"), lambda x, i: self.check(_Value(x), schema["items"], F.concat(path, F.lit("/"), i.cast("string")), trail))
            parts.append(F.when(value.is_("array"), F.flatten(each)).otherwise(_none()))
        parts += self._combined(value, schema, path, trail)
        return _joined(parts)

    def _scalars(self, value: _Value, schema: dict, path: Column) -> Iterator[Column]:
        if "type" in schema:
            kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            yield _when(~_any(value.is_(k) for k in kinds), path, "type")
        for rule, wanted in (("const", [schema.get("const")]), ("enum", schema.get("enum"))):
            if rule in schema:
                texts = [w for w in wanted if isinstance(w, str)]
                tests = [value.equals(w) for w in wanted if not isinstance(w, str)] + ([value.is_("string") & value.get("string").isin(texts)] if texts else [])
                yield _when(~_any(tests), path, rule)
        for rule, outside in _NUMBERS.items():
            if rule in schema:
                yield _when(value.is_("number") & getattr(value.get("double"), outside)(float(schema[rule])), path, rule)
        for rule, (kind, outside) in _SIZES.items():
            if rule in schema:
                size = F.char_length(value.get("string")) if kind == "string" else F.size(value.get("array<variant>"))
                yield _when(value.is_(kind) & getattr(size, outside)(schema[rule]), path, rule)
        if "pattern" in schema:
            yield _when(value.is_("string") & ~value.get("string").rlike(schema["pattern"]), path, "pattern")

    def _object(self, value: _Value, schema: dict, path: Column, trail: tuple[str, ...]) -> Iterator[Column]:
        known = schema.get("properties", {})
        for name in sorted({*known, *schema.get("required", [])}):
            if set(name) & set("'\"[]"):
                raise ValueError(f"a property's name can't hold quotes or brackets: {name!r}")
            child, at = F.try_variant_get(value.column, F.lit(f"$['{name}']"), "variant"), _below(path, name)
            if name in schema.get("required", []):
                yield _when(child.isNull(), at, "required")
            if name in known:
                yield F.when(child.isNotNull(), self.check(_Value(child), known[name], at, trail)).otherwise(_none())
        more = schema.get("additionalProperties", True)
        if more is True:
            return
        names = F.array(*[F.lit(n) for n in known]).cast("array<string>")
        others = F.map_filter(value.get("map<string,variant>"), lambda k, _: ~F.array_contains(names, k))
        at = lambda k: F.concat(path, F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        if more is False:
            yield F.transform(F.array_sort(F.map_keys(others)), lambda k: _issue(at(k), "additionalProperties"))
        else:
            yield F.flatten(F.transform(F.map_entries(others), lambda e: self.check(_Value(e["value"]), more, at(e["key"]), trail)))

    def _combined(self, value: _Value, schema: dict, path: Column, trail: tuple[str, ...]) -> list[Column]:
        found = [self.check(value, s, path, trail) for s in schema.get("allOf", [])]
        holds = lambda s: F.size(self.check(value, s, path, trail)) == 0
        if "anyOf" in schema:
            found.append(_when(~_any(holds(s) for s in schema["anyOf"]), path, "anyOf"))
        if "not" in schema:
            found.append(_when(holds(schema["not"]), path, "not"))
        if "if" in schema:
            then, other = (self.check(value, schema.get(k, True), path, trail) for k in ("then", "else"))
            found.append(F.when(holds(schema["if"]), then).otherwise(other))
        return found
