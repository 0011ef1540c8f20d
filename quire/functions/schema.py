"""JSON Schema checks compiled to column expressions over ``variant``, so that a batch is checked without Python.

The subset: type, const, enum, required, properties, additionalProperties, items, minItems, maxItems, uniqueItems, minimum,
maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern, anyOf, oneOf, allOf, if/then/else and local $ref without
recursion. Another keyword that would check something is refused when the schema is compiled, never passed over.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schemas nest and refer no deeper than this.
MAX_DEPTH = 24
# Keywords that say something and check nothing.
ANNOTATIONS = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
_NONE = "array<struct<path:string,code:string>>"


class SchemaError(ValueError):
    """A schema that isn't of the subset."""


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once for each row, however often it is used; Catalyst repeats it inside of conditions and lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kind(v: Column, name: str, t: Column | None = None) -> Column:
    t = F.schema_of_variant(v) if t is None else t
    number = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
    if name == "integer":
        whole = F.try_variant_get(v, "$", "double")
        return t.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (number & (whole == F.rint(whole)))
    simple = {
        "object": t.startswith("OBJECT"), "array": t.startswith("ARRAY"), "string": t == "STRING", "boolean": t == "BOOLEAN", "null": t == "VOID", "number": number,
    }
    if name not in simple:
        raise SchemaError(f"type {name}")
    return simple[name]


def _equals(v: Column, value, t: Column) -> Column:
    if value is None:
        return _kind(v, "null", t)
    if isinstance(value, bool):
        return _kind(v, "boolean", t) & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, str):
        return _kind(v, "string", t) & (F.try_variant_get(v, "$", "string") == value)
    if isinstance(value, (int, float)):
        return _kind(v, "number", t) & (F.try_variant_get(v, "$", "double") == float(value))
    raise SchemaError("const and enum of objects and arrays")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _step(path: Column, name: Column | str) -> Column:
    """A JSON pointer with one step more."""
    key = F.lit(name) if isinstance(name, str) else name
    return F.concat(path, F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


class _Compiler:
    def __init__(self, root: dict):
        self.root = root

    def resolve(self, ref: str) -> dict:
        if not ref.startswith("#"):
            raise SchemaError(f"$ref {ref}")
        at = self.root
        for step in ref[1:].strip("/").split("/") if ref != "#" else ():
            step = step.replace("~1", "/").replace("~0", "~")
            if not isinstance(at, dict) or step not in at:
                raise SchemaError(f"$ref {ref}")
            at = at[step]
        return at

    def problems(self, v: Column, schema, path: Column, depth: int = 0) -> Column:
        """An array of (path, code) for what is wrong with ``v``, which is there."""
        if depth > MAX_DEPTH:
            raise SchemaError("too deep, or a $ref that leads to itself")
        if schema is True or schema == {}:
            return F.array().cast(_NONE)
        if schema is False:
            return self._when(F.lit(True), path, "NOT_ALLOWED")
        return _bound(v, lambda x: _bound(F.schema_of_variant(x), lambda t: self._problems(x, t, schema, path, depth)))

    def _problems(self, v: Column, t: Column, schema: dict, path: Column, depth: int) -> Column:
        """``problems`` of a value of type ``t``."""
        found: list[Column] = []
        rest = dict(schema)
        take = lambda k: rest.pop(k, None)
        wrong = lambda condition, code: found.append(self._when(condition, path, code))
        below = lambda inner, sub=None, at=None: self.problems(v if sub is None else sub, inner, path if at is None else at, depth + 1)

        if "$ref" in rest:
            found.append(below(self.resolve(take("$ref"))))
        if "type" in rest:
            names = take("type")
            wrong(~_any([_kind(v, n, t) for n in ([names] if isinstance(names, str) else names)]), "TYPE_MISMATCH")
        if "const" in rest:
            wrong(~_equals(v, take("const"), t), "CONST_MISMATCH")
        if "enum" in rest:
            wrong(~_any([_equals(v, x, t) for x in take("enum")]), "ENUM_MISMATCH")

        number, value = _kind(v, "number", t), F.try_variant_get(v, "$", "double")
        for key, bad, code in (
            ("minimum", lambda n: value < n, "BELOW_MINIMUM"), ("maximum", lambda n: value > n, "ABOVE_MAXIMUM"),
            ("exclusiveMinimum", lambda n: value <= n, "BELOW_MINIMUM"), ("exclusiveMaximum", lambda n: value >= n, "ABOVE_MAXIMUM"),
        ):
            if key in rest:
                wrong(number & bad(float(take(key))), code)
        string, text = _kind(v, "string", t), F.try_variant_get(v, "$", "string")
        for key, bad, code in (("minLength", lambda n: F.char_length(text) < n, "TOO_SHORT"), ("maxLength", lambda n: F.char_length(text) > n, "TOO_LONG")):
            if key in rest:
                wrong(string & bad(take(key)), code)
        if "pattern" in rest:
            pattern = take("pattern")
            if pattern.endswith("$") and not pattern.endswith("\\$"):
                pattern = pattern[:-1] + "\\z"  # Java's $ lets a last line end pass
            wrong(string & ~F.rlike(text, F.lit(pattern)), "PATTERN_MISMATCH")

        self._array(v, t, rest, path, depth, found)
        self._object(v, t, rest, path, depth, found)
        for inner in take("allOf") or ():
            found.append(below(inner))
        fits = lambda inner: F.size(below(inner)) == 0
        if "anyOf" in rest:
            wrong(~_any([fits(x) for x in take("anyOf")]), "ANY_OF_MISMATCH")
        if "oneOf" in rest:
            wrong(reduce(lambda a, b: a + b, [fits(x).cast("int") for x in take("oneOf")]) != 1, "ONE_OF_MISMATCH")
        if "if" in rest:
            met, yes, no = fits(take("if")), take("then"), take("else")
            nothing = F.array().cast(_NONE)
            found.append(F.when(met, nothing if yes is None else below(yes)).otherwise(nothing if no is None else below(no)))
        unknown = set(rest) - ANNOTATIONS - {"then", "else"}
        if unknown:
            raise SchemaError(f"keywords {sorted(unknown)}")
        return F.concat(*found) if found else F.array().cast(_NONE)

    def _array(self, v, t, rest, path, depth, found) -> None:
        mine = {k: rest.pop(k) for k in ("minItems", "maxItems", "uniqueItems", "items") if k in rest}

        def check(items: Column) -> Column:
            own = []
            if "minItems" in mine:
                own.append(self._when(F.size(items) < mine["minItems"], path, "TOO_FEW_ITEMS"))
            if "maxItems" in mine:
                own.append(self._when(F.size(items) > mine["maxItems"], path, "TOO_MANY_ITEMS"))
            if mine.get("uniqueItems"):
                own.append(self._when(F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items), path, "REPEATED_ITEM"))
            if "items" in mine:
                own.append(F.flatten(F.transform(items, lambda x, i: self.problems(x, mine["items"], _step(path, i.cast("string")), depth + 1))))
            return F.concat(*own) if own else F.array().cast(_NONE)

        if mine:
            each = _bound(F.try_variant_get(v, "$", "array<variant>"), check)
            found.append(F.when(_kind(v, "array", t), each).otherwise(F.array().cast(_NONE)))

    def _object(self, v, t, rest, path, depth, found) -> None:
        properties, required = rest.pop("properties", {}), rest.pop("required", [])
        more = rest.pop("additionalProperties", True)
        if not (properties or required or more is not True):
            return
        nothing = F.array().cast(_NONE)

        def check(fields: Column) -> Column:
            own: list[Column] = [self._when(~F.map_contains_key(fields, name), _step(path, name), "REQUIRED_MISSING") for name in required]
            for name, inner in properties.items():
                there = F.map_contains_key(fields, name)
                own.append(F.when(there, self.problems(F.element_at(fields, F.lit(name)), inner, _step(path, name), depth + 1)).otherwise(nothing))
            named = list(properties)
            other = F.map_filter(fields, lambda k, x: ~k.isin(*named) if named else F.lit(True))
            if more is False:
                own.append(F.transform(F.map_keys(other), lambda k: F.struct(_step(path, k).alias("path"), F.lit("ADDITIONAL_PROPERTY").alias("code"))))
            elif more is not True:
                own.append(F.flatten(F.transform(F.map_entries(other), lambda e: self.problems(e["value"], more, _step(path, e["key"]), depth + 1))))
            return F.concat(*own)

        found.append(F.when(_kind(v, "object", t), _bound(F.try_variant_get(v, "$", "map<string,variant>"), check)).otherwise(nothing))

    @staticmethod
    def _when(condition: Column, path: Column, code: str) -> Column:
        one = F.array(F.struct(path.alias("path"), F.lit(code).alias("code")))
        return F.when(F.coalesce(condition, F.lit(False)), one).otherwise(F.array().cast(_NONE))


def compile_schema(schema: dict | bool) -> Callable[[Column], Column]:
    """A function from a JSON text to an array of (path, code), empty where the text is valid.

    A text that isn't JSON, repeats a name in an object, or is null gives (``""``, ``MALFORMED``). Numbers are compared as doubles,
    patterns are Java's and found anywhere in a text.
    """
    compiler = _Compiler(schema if isinstance(schema, dict) else {})

    def check(text: Column) -> Column:
        return parsed(F.try_parse_json(text))

    def parsed(v: Column) -> Column:
        bad = F.array(F.struct(F.lit("").alias("path"), F.lit("MALFORMED").alias("code"))).cast(_NONE)
        return F.when(v.isNull(), bad).otherwise(compiler.problems(v, schema, F.lit("")))

    check.parsed = parsed  # for a column that was parsed before, so that no part parses it again
    return check


def schema_breaches(rows: DataFrame, text: str, schema: dict) -> DataFrame:
    """The rows with a breach, one for each: all columns but ``text``, and path and code."""
    check = compile_schema(schema)
    found = rows.withColumn("__value", F.try_parse_json(text)).withColumn("__breaches", check.parsed(F.col("__value")))
    return found.select(*(c for c in rows.columns if c != text), F.explode("__breaches").alias("b")).select("*", "b.path", "b.code").drop("b")
