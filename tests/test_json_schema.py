"""Schema documents handed in as files, against a plain walk over each document."""

import json
import random
import re

import pytest

from loomtrace.operators import contracts, json_schema
from loomtrace.plans import calculations, evidence

A = "https://example.org/v1/"
COMMON = {"$id": A + "common.schema.json", "$defs": {"name": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}, "size": {"type": "integer", "exclusiveMinimum": 0, "multipleOf": 2}, "deep/er": {"$ref": "#/$defs/name"}}}
THING = {
    "$id": A + "thing.schema.json",
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "$defs": {"tree": {"type": "object", "required": ["v"], "properties": {"v": {"type": "number"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}, "additionalProperties": False}},
    "type": "object",
    "required": ["contract", "name"],
    "additionalProperties": False,
    "properties": {
        "contract": {"const": "a.thing"},
        "name": {"$ref": "common.schema.json#/$defs/name", "maxLength": 5},
        "alias": {"$ref": "common.schema.json#/$defs/deep~1er"},
        "sizes": {"type": "array", "maxItems": 3, "items": {"anyOf": [{"$ref": "common.schema.json#/$defs/size"}, {"type": "null"}]}},
        "parts": {"type": "array", "uniqueItems": True, "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": ["string", "integer"]}, "of": {"type": "object", "properties": {"flag": {"type": "boolean"}}, "additionalProperties": False}}}},
        "scores": {"type": "object", "minProperties": 1, "additionalProperties": {"type": "number", "minimum": 0, "maximum": 1}, "properties": {"note": {"type": "string"}}},
        "kind": {"enum": ["x", "y", 1, None, [1, 2]]},
        "tree": {"$ref": "#/$defs/tree"},
        "odd key": {"type": "boolean"},
    },
    "if": {"required": ["kind"], "properties": {"kind": {"const": "x"}}},
    "then": {"required": ["sizes"]},
    "else": {"not": {"required": ["odd key"]}},
    "oneOf": [{"required": ["tree"]}, {"required": ["parts"]}, {"properties": {"tree": False, "parts": False}}],
}


def walk(catalog, node, base, x, path=()):
    """(path, rule) of all errors."""
    if isinstance(node, bool):
        return [] if node else [(path, "false")]
    out = []
    ok = lambda n: not walk(catalog, n, base, x, path)
    text, number = isinstance(x, str), isinstance(x, int | float) and not isinstance(x, bool)
    kinds = {"object": isinstance(x, dict), "array": isinstance(x, list), "string": text, "number": number, "integer": number and x == int(x), "boolean": isinstance(x, bool), "null": x is None}
    same = lambda a, b: json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
    for k, v in node.items():
        bad = False
        if k == "$ref":
            target, at, full = catalog.resolve(node, base)
            if catalog.recursive(full, target, at):
                bad, k = bool(walk(catalog, target, at, x, path)), "oneOf" if "oneOf" in target else "$ref"
            else:
                out += walk(catalog, target, at, x, path)
        elif k == "type":
            bad = not any(kinds[t] for t in ([v] if isinstance(v, str) else v))
        elif k in ("const", "enum"):
            bad = not any(same(y, x) for y in ([v] if k == "const" else v))
        elif k == "pattern":
            bad = text and not re.search(v, x)
        elif k in ("minLength", "maxLength"):
            bad = text and (len(x) < v if k == "minLength" else len(x) > v)
        elif k in ("minimum", "maximum", "exclusiveMinimum", "multipleOf"):
            bad = number and {"minimum": lambda: x < v, "maximum": lambda: x > v, "exclusiveMinimum": lambda: x <= v, "multipleOf": lambda: x / v != x // v}[k]()
        elif k in ("minItems", "maxItems"):
            bad = kinds["array"] and (len(x) < v if k == "minItems" else len(x) > v)
        elif k == "uniqueItems":
            bad = kinds["array"] and any(same(a, b) for i, a in enumerate(x) for b in x[:i])
        elif k == "items" and kinds["array"]:
            for i, y in enumerate(x):
                out += walk(catalog, v, base, y, (*path, str(i)))
        elif k == "required" and kinds["object"]:
            out += [(path, f"required:{n}") for n in v if n not in x]
        elif k == "minProperties":
            bad = kinds["object"] and len(x) < v
        elif k == "properties" and kinds["object"]:
            for n, s in v.items():
                out += walk(catalog, s, base, x[n], (*path, n)) if n in x else []
        elif k == "additionalProperties" and kinds["object"]:
            rest = [n for n in x if n not in node.get("properties", {})]
            if v is False:
                bad = bool(rest)
            else:
                for n in rest:
                    out += walk(catalog, v, base, x[n], (*path, n))
        elif k == "allOf":
            for n in v:
                out += walk(catalog, n, base, x, path)
        elif k in ("anyOf", "oneOf"):
            hits = sum(map(ok, v))
            bad = hits == 0 if k == "anyOf" else hits != 1
        elif k == "not":
            bad = ok(v)
        elif k == "if":
            out += walk(catalog, node.get("then" if ok(v) else "else", True), base, x, path)
        if bad:
            out.append((path, k))
    return out


def plain(catalog, text):
    try:
        doc = json.loads(text)
    except (TypeError, ValueError):
        return {("<root>", "json")}
    name = doc.get("contract") if isinstance(doc, dict) else None
    if not isinstance(name, str):
        return {("contract", "contract")}
    if name not in catalog.contracts:
        return {("contract", "unregistered")}
    s = catalog.contracts[name]
    return {(".".join(p) or "<root>", r) for p, r in walk(catalog, catalog.schemas[s], s, doc)}


def listed(spark, catalog, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string")
    found = {i: set() for i in range(len(texts))}
    for r in json_schema.schema_errors(df, "doc", "id", catalog=catalog).collect():
        found[r.id].add((r.path, r.rule))
    return found


def write(folder, schemas):
    for i, s in enumerate(schemas):
        (folder / f"s{i}.schema.json").write_text(json.dumps(s))
    return f"file://{folder}"


def test_unseen_schemas(spark, tmp_path):
    catalog = json_schema.load(spark, write(tmp_path, [THING, COMMON]))
    assert catalog.contracts == {"a.thing": THING["$id"]} and catalog.check() == [COMMON["$id"], THING["$id"]]
    rng = random.Random(2)
    tree = lambda d: {"v": rng.choice([1, 2.5, "x"] if d else [1])} | ({"kids": [tree(d - 1) for _ in range(rng.randrange(3))]} if d and rng.random() < 0.7 else {}) | ({"other": 1} if rng.random() < 0.05 else {})
    values = {
        "contract": lambda: "a.thing",
        "name": lambda: rng.choice(["ab", "abcdef", "a", "Ab", 5, None, "é", "ab\n"]),
        "alias": lambda: rng.choice(["ab", "", 1]),
        "sizes": lambda: rng.choice([[], [2, 4], [2, None, 3], [0, "x", 2.0, 4], "no", [1.5]]),
        "parts": lambda: rng.choice([[], [{"id": 1}], [{"id": "a", "of": {"flag": True}}, {"id": 2.5, "of": {"flag": 1, "z": 0}}], [{"id": 1}, {"id": 1}], [{"of": 5}, 7], {}]),
        "scores": lambda: rng.choice([{}, {"a": 0.5}, {"a": 1.5, "b": -1, "note": "x"}, {"note": 5}, [], {"a": "x"}]),
        "kind": lambda: rng.choice(["x", "y", 1, 2, None, [1, 2], [2, 1], True, 1.0]),
        "tree": lambda: tree(3),
        "odd key": lambda: rng.choice([True, 0]),
        "more": lambda: 1,
    }
    docs = [{k: v() for k, v in values.items() if rng.random() < (0.95 if k in ("contract", "name") else 0.04 if k == "more" else 0.4)} for _ in range(400)]
    texts = [json.dumps(d) for d in docs] + ["{", None, "[1]", "5", '{"contract": 1}', '{"contract": "other"}', "{}"]
    got = listed(spark, catalog, texts)
    for i, t in enumerate(texts):
        want = plain(catalog, t)
        if t and '"kind": 1.0' in t:
            want -= {("kind", "enum")}  # 1.0 is 1
        assert got[i] == want, t
    assert len({r for s in got.values() for r in s}) > 30


def test_contracts_as_files(spark, tmp_path):
    """The contracts written as files and read again give the rows of the contract queries."""
    folder = write(tmp_path, contracts.documents_of().values())
    catalog = json_schema.load(spark, folder)
    assert sorted(catalog.contracts) == sorted(contracts.CONTRACTS)
    faults = [(base | change, errors) for base, found in evidence.FAULTS.values() for change, errors in found]
    texts = [json.dumps({k: v for k, v in d.items() if v is not None}) for d, _ in faults]
    got = listed(spark, catalog, texts)
    for i, (_, errors) in enumerate(faults):
        assert got[i] == plain(catalog, texts[i])
        if not {("contract", "unregistered")} & {tuple(e) for e in errors}:
            assert got[i] == {tuple(e) for e in errors}
    assert listed(spark, json_schema.Catalog({calculations.ORDER_SCHEMA["$id"]: calculations.ORDER_SCHEMA}), ['{"contract":"order.record","order":1,"customer":2,"status":"O","total":900}']) == {0: set()}


@pytest.mark.parametrize(
    "schema",
    [{"type": "object"}, {"$id": ""}, {"$id": "urn:a", "type": "text"}, {"$id": "urn:a", "patternProperties": {}}, {"$id": "urn:a", "properties": {"x": {"$ref": "other#/$defs/y"}}}, {"$id": "urn:a", "pattern": "("}, {"$id": "urn:a", "properties": {"x": 5}}, {"$id": "urn:a", "minLength": "3"}],
)
def test_wrong_schemas(spark, tmp_path, schema):
    with pytest.raises(json_schema.SchemaError):
        json_schema.load(spark, write(tmp_path, [schema]))


def test_files_that_are_no_schemas(spark, tmp_path):
    (tmp_path / "a.schema.json").write_text("{")
    with pytest.raises(json_schema.SchemaError):
        json_schema.load(spark, f"file://{tmp_path}")
    (tmp_path / "twice").mkdir()
    with pytest.raises(json_schema.SchemaError):
        json_schema.load(spark, write(tmp_path / "twice", [COMMON, COMMON]))
    (tmp_path / "none").mkdir()
    with pytest.raises(json_schema.SchemaError):
        json_schema.load(spark, f"file://{tmp_path}/none")
