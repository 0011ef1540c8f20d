"""Compiled schemas against a plain checker, and template profiles against a plain loop."""

import json
import math
import re

import numpy as np
import pytest

from quire.functions.schema import SchemaError, compile_schema, schema_breaches
from quire.operators.templates import discovered_headings, template_profile, template_summary

SCHEMA = {
    "$defs": {"tag": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]+$"}},
    "type": "object", "required": ["id", "kind"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1, "exclusiveMaximum": 100},
        "kind": {"enum": ["a", "b", 3, None, True]},
        "tags": {"type": "array", "items": {"$ref": "#/$defs/tag"}, "minItems": 1, "maxItems": 3, "uniqueItems": True},
        "extra": {"type": "object", "additionalProperties": {"type": ["number", "null"]}},
        "either": {"anyOf": [{"type": "string"}, {"type": "array", "items": {"const": 1}}]},
        "one": {"oneOf": [{"minimum": 5}, {"maximum": 7}]},
        "a/b": {"allOf": [{"type": "number"}, {"maximum": 2}]},
        "never": False, "any": True,
        "cond": {"if": {"type": "object", "required": ["x"]}, "then": {"properties": {"x": {"type": "boolean"}}}, "else": {"type": "null"}},
    },
}


def plain(v, s, path=""):
    """A plain reading of the subset."""
    if s is True:
        return []
    if s is False:
        return [(path, "NOT_ALLOWED")]
    is_number = isinstance(v, (int, float)) and not isinstance(v, bool)
    kinds = {
        "object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None,
        "number": is_number, "integer": is_number and float(v) == math.floor(v),
    }
    same = lambda x: type(x) is type(v) and x == v if isinstance(x, (bool, str)) or x is None else is_number and x == v
    out = []
    say = lambda bad, code: out.append((path, code)) if bad else None
    if "$ref" in s:
        out += plain(v, SCHEMA["$defs"][s["$ref"].rsplit("/", 1)[1]], path)
    if "type" in s:
        say(not any(kinds[k] for k in ([s["type"]] if isinstance(s["type"], str) else s["type"])), "TYPE_MISMATCH")
    if "const" in s:
        say(not same(s["const"]), "CONST_MISMATCH")
    if "enum" in s:
        say(not any(same(x) for x in s["enum"]), "ENUM_MISMATCH")
    if is_number:
        say(v < s.get("minimum", v), "BELOW_MINIMUM")
        say(v > s.get("maximum", v), "ABOVE_MAXIMUM")
        say("exclusiveMaximum" in s and v >= s["exclusiveMaximum"], "ABOVE_MAXIMUM")
    if isinstance(v, str):
        say(len(v) < s.get("minLength", 0), "TOO_SHORT")
        say(len(v) > s.get("maxLength", len(v)), "TOO_LONG")
        say("pattern" in s and not re.search(s["pattern"].replace("$", r"\Z"), v), "PATTERN_MISMATCH")
    if isinstance(v, list):
        say(len(v) < s.get("minItems", 0), "TOO_FEW_ITEMS")
        say(len(v) > s.get("maxItems", len(v)), "TOO_MANY_ITEMS")
        say(s.get("uniqueItems") and len({json.dumps(x) for x in v}) < len(v), "REPEATED_ITEM")
        for i, x in enumerate(v if "items" in s else []):
            out += plain(x, s["items"], f"{path}/{i}")
    if isinstance(v, dict):
        step = lambda k: f"{path}/{k.replace('~', '~0').replace('/', '~1')}"
        out += [(step(k), "REQUIRED_MISSING") for k in s.get("required", []) if k not in v]
        for k, x in v.items():
            if k in s.get("properties", {}):
                out += plain(x, s["properties"][k], step(k))
            elif s.get("additionalProperties") is False:
                out.append((step(k), "ADDITIONAL_PROPERTY"))
            else:
                out += plain(x, s.get("additionalProperties", True), step(k))
    for x in s.get("allOf", []):
        out += plain(v, x, path)
    say("anyOf" in s and all(plain(v, x) for x in s["anyOf"]), "ANY_OF_MISMATCH")
    say("oneOf" in s and sum(not plain(v, x) for x in s["oneOf"]) != 1, "ONE_OF_MISMATCH")
    if "if" in s:
        out += plain(v, s["else"] if plain(v, s["if"]) else s["then"], path)
    return out


def values():
    rng = np.random.default_rng(6)
    leaf = [0, 1, 1.0, 1.5, 99, 100, 3, 6, 10**20, None, True, False, "a", "b", "ab", "abcde", "AB", "ab\n", "é~/", [], {}, [1], [1, 2], [1, 1], {"x": True}, {"x": 1}, {"y": None}]
    names = ["id", "kind", "tags", "extra", "either", "one", "a/b", "never", "any", "cond", "other", "~t"]
    out = [*leaf, {"id": 5, "kind": "a"}, {"id": 5, "kind": None, "tags": ["ab", "cd"], "extra": {"u": 1, "v": None}, "one": 3, "cond": None}]
    tags = [["a", "abcde", "AB"], [], ["ab", "cd", "ef", "gh"], ["ab", "ab"], ["ab\n"], [1], "ab"]
    out += [{"id": i, "kind": k, "tags": t, "one": o} for t in tags for i, k, o in ((5, "a", 6), (2.5, 3, 1), (2.0, True, 9))]
    out += [{"id": 5, "kind": "a", "cond": c, "either": e} for c, e in (({"x": True}, [1, 1]), ({"x": 0}, [2]), ({}, "s"), (None, 5))]
    for _ in range(250):
        one = {"id": 7, "kind": "b"}
        for name in rng.choice(names, int(rng.integers(0, 6))):
            pick = leaf[int(rng.integers(0, len(leaf)))]
            one[str(name)] = [leaf[int(i)] for i in rng.integers(0, len(leaf), int(rng.integers(0, 4)))] if rng.random() < 0.3 else pick
        out.append(one)
    return out


def test_compiled_schema_equals_a_plain_checker(spark):
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values())]
    got = {i: [] for i, _ in rows}
    for r in schema_breaches(spark.createDataFrame(rows, "i int, j string"), "j", SCHEMA).collect():
        got[r.i].append((r.path, r.code))
    seen = set()
    for i, text in rows:
        want = sorted(plain(json.loads(text), SCHEMA))
        assert sorted(got[i]) == want, text
        seen |= {c for _, c in want}
    assert len(seen) >= 15 and any(not x for x in got.values())


def test_malformed_texts_and_refused_schemas(spark):
    rows = [(1, None), (2, "{"), (3, '{"id": 1, "id": 2}'), (4, ""), (5, '{"id": 5, "kind": "a"}')]
    got = schema_breaches(spark.createDataFrame(rows, "i int, j string"), "j", SCHEMA).collect()
    assert {(r.i, r.path, r.code) for r in got} == {(i, "", "MALFORMED") for i in (1, 2, 3, 4)}
    for bad in ({"dependentRequired": {}}, {"type": "text"}, {"$ref": "other.json"}, {"$ref": "#/$defs/none"}, {"enum": [[1]]}, {"properties": {"a": {"$ref": "#"}}}):
        with pytest.raises(SchemaError):
            compile_schema(bad)(spark.createDataFrame([("{}",)], "j string")["j"])


def test_a_plan_without_python(spark):
    plan = schema_breaches(spark.createDataFrame([(1, "{}")], "i int, j string"), "j", SCHEMA)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("Scan ExistingRDD", "") and "InArrow" not in plan


def test_a_value_is_made_once_however_deep_it_lies(spark):
    def casts(depth):
        schema = {"type": "string", "minLength": 2}
        for _ in range(depth):
            schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": schema}}
        found = schema_breaches(spark.createDataFrame([(1, "{}")], "i int, j string"), "j", schema)
        return found._jdf.queryExecution().analyzed().toString().lower().count("variant_get(")

    # Each level adds as much as the one before.
    assert 0 < casts(3) - casts(2) == casts(2) - casts(1)


# Template profiles

UNITS = "doc string, idx int, kind string, style string, text string, n_rows int, n_cols int"
WANTED = [(1, "s1", "Scope", "table"), (2, "s2", "Test  Results", "paragraphs"), (3, "s3", "Nowhere", None), (4, "s4", "", ""), (5, "s5", "res", "")]
STYLES = ["Heading 1", "Title"]


def plain_profile(rows):
    norm = lambda t: re.sub(r"[\W_]+", "", t or "").lower()
    out = []
    for doc in {r[0] for r in rows}:
        units = sorted(r for r in rows if r[0] == doc)
        paragraphs = [r for r in units if r[2] == "paragraph"]
        for order, section, heading, mode in WANTED:
            want = norm(heading)
            hit = next((r for r in paragraphs if norm(r[4]) == want), None)
            how = "exact" if hit else ""
            if not hit:
                hit = next((r for r in paragraphs if (r[4] or "").strip() and want and want in norm(r[4])), None)
                how = "contains" if hit else ""
            if not hit:
                out.append((doc, order, section, heading, mode, False, "", "", None, None, False, None, None))
                continue
            end = next((r[1] for r in paragraphs if r[1] > hit[1] and r[3] in STYLES and (r[4] or "").strip()), None)
            table = next((r for r in units if r[2] == "table" and r[1] > hit[1] and (end is None or r[1] < end)), None)
            out.append((doc, order, section, heading, mode, True, how, hit[3], hit[1], end, table is not None, *(table[5:] if table else (None, None))))
    return out


def test_profiles_equal_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    texts = ["Scope", "scope ", "1. Scope of it", "TEST results", "Results", "", None, "body", "  "]
    rows = []
    for d in range(60):
        for i in range(int(rng.integers(0, 14))):
            if rng.random() < 0.25:
                rows.append((f"d{d}", i, "table", None, None, int(rng.integers(0, 5)), int(rng.integers(0, 4))))
            else:
                text, style = texts[int(rng.integers(0, len(texts)))], ["Heading 1", "Title", "Normal"][int(rng.integers(0, 3))]
                rows.append((f"d{d}", i, "paragraph", style, text, None, None))
    units = spark.createDataFrame(rows, UNITS)
    sections = spark.createDataFrame(WANTED, "ord int, section string, heading string, mode string")
    profile = template_profile(units, sections, STYLES)
    key = lambda r: tuple(str(x) for x in r)
    want = plain_profile(rows)
    assert sorted(map(tuple, profile.collect()), key=key) == sorted(want, key=key)
    assert {r[6] for r in want} == {"", "exact", "contains"}
    missing = {r.doc: r.missing for r in template_summary(units, profile).collect()}
    assert missing == {d: [r[2] for r in sorted(want, key=lambda r: r[1]) if r[0] == d and not r[5]] for d in {r[0] for r in rows}}
    assert discovered_headings(units, STYLES).count() == sum(r[2] == "paragraph" and r[3] in STYLES and bool((r[4] or "").strip()) for r in rows)
    assert template_profile(units, sections.limit(0), STYLES).count() == 0
    assert template_profile(units.limit(0), sections, STYLES).count() == 0
