"""JSON Schema documents compiled to Columns that list what is wrong with a JSON document.

A document is parsed to a variant once. What the schemas look at is fetched from it in layers of projections, a
column for each member, so each rule is a plain condition on columns; arrays become arrays of structs with the
members of their elements. References between files and within one are followed when the schema is compiled.
A definition that refers to itself has no fixed depth and so no Column: it is checked by a small function.

Understood: $ref, $defs, type, const, enum, pattern, lengths, limits, multipleOf, items, numbers of items,
uniqueItems, properties, required, additionalProperties, numbers of properties, allOf, anyOf, oneOf, not,
if / then / else. Formats are notes, as in the standard. Other keywords are errors, never skipped.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

ERRORS = "array<struct<path:string,rule:string>>"
ROOT = "<root>"
NOTES = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
LISTS = {"allOf", "anyOf", "oneOf"}
SINGLE = {"not", "if", "then", "else", "items", "additionalProperties"}
PLAIN = {
    "$ref": str, "type": (str, list), "const": object, "enum": list, "pattern": str, "minLength": int, "maxLength": int, "minimum": (int, float), "maximum": (int, float), "exclusiveMinimum": (int, float), "exclusiveMaximum": (int, float),
    "multipleOf": (int, float), "minItems": int, "maxItems": int, "uniqueItems": bool, "required": list, "minProperties": int, "maxProperties": int, "properties": dict,
}
TYPES = {"object", "array", "string", "number", "integer", "boolean", "null"}


class SchemaError(ValueError):
    pass


@dataclass
class Catalog:
    """Schema documents by their $id, and by the contract whose name their member `contract` must have."""

    schemas: dict[str, dict]

    @property
    def contracts(self) -> dict[str, str]:
        found = {}
        for name, s in sorted(self.schemas.items()):
            const = s.get("properties", {}).get("contract", {}).get("const")
            if isinstance(const, str):
                found.setdefault(const, name)
        return found

    def resolve(self, node: dict, base: str) -> tuple[dict, str, str]:
        """(what a reference points at, the document it stands in, its full name)."""
        ref = node["$ref"]
        whole = base + ref if ref.startswith("#") else ref if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref) else f"{base.rpartition('/')[0]}/{ref}"
        name, _, pointer = whole.partition("#")
        at: object = self.schemas.get(name)
        if at is None:
            raise SchemaError(f"no schema {name}, which {base} refers to")
        for part in filter(None, pointer.split("/")):
            part = unquote(part).replace("~1", "/").replace("~0", "~")
            if not isinstance(at, dict) or part not in at:
                raise SchemaError(f"nothing at {whole}")
            at = at[part]
        return at, name, f"{name}#{pointer}"

    def recursive(self, full: str, node: object, base: str, seen: frozenset = frozenset()) -> bool:
        """Whether a definition can be reached from itself."""
        for n, b in inner_schemas(node, base):
            if isinstance(n, dict) and "$ref" in n:
                target, at, name = self.resolve(n, b)
                if name == full or name not in seen and self.recursive(full, target, at, seen | {name}):
                    return True
            if self.recursive(full, n, b, seen):
                return True
        return False

    def check(self) -> list[str]:
        """The ids of all schemas, once every keyword and reference in them was found to be right."""
        for name, s in self.schemas.items():
            for n in [s, *s.get("$defs", {}).values()]:
                self.check_node(n, name)
        return sorted(self.schemas)

    def check_node(self, node: object, base: str) -> None:
        if isinstance(node, bool):
            return
        if not isinstance(node, dict):
            raise SchemaError(f"{base}: a schema is an object or true or false, not {node!r}")
        for k, v in node.items():
            right = k in NOTES or (k in PLAIN and isinstance(v, PLAIN[k])) or (k in LISTS and isinstance(v, list) and bool(v)) or k in SINGLE
            if not right:
                raise SchemaError(f"{base}: keyword {k} is unknown or has a wrong value")
        if not set([node["type"]] if isinstance(node.get("type"), str) else node.get("type", [])) <= TYPES:
            raise SchemaError(f"{base}: unknown type {node['type']}")
        if "pattern" in node:
            try:
                re.compile(node["pattern"])
            except re.error as e:
                raise SchemaError(f"{base}: pattern {node['pattern']}: {e}") from e
        if "$ref" in node:
            self.resolve(node, base)
        for n, b in inner_schemas(node, base, follow=False):
            self.check_node(n, b)


def inner_schemas(node: object, base: str, follow: bool = True) -> list[tuple[object, str]]:
    """The schemas that stand directly within one; a reference is one itself."""
    if not isinstance(node, dict):
        return []
    found = [n for k in LISTS for n in node.get(k, [])] + [node[k] for k in SINGLE if k in node] + list(node.get("properties", {}).values())
    return [(n, base) for n in found] + ([({"$ref": node["$ref"]}, base)] if follow and "$ref" in node and len(node) > 1 else [])


def load(spark: SparkSession, folder: str) -> Catalog:
    """The *.schema.json files of a folder that Spark can read, by name. Schemas are few and small: they are the program, not data."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.schema.json").select("value", F.col("_metadata.file_name").alias("name")).orderBy("name").collect()
    if not rows:
        raise SchemaError(f"no schemas in {folder}")
    found: dict[str, dict] = {}
    for r in rows:
        try:
            s = json.loads(r["value"])
        except ValueError as e:
            raise SchemaError(f"{r['name']}: {e}") from e
        name = s.get("$id") if isinstance(s, dict) else None
        if not isinstance(name, str) or not name:
            raise SchemaError(f"{r['name']} has no $id")
        if name in found:
            raise SchemaError(f"{name} is there twice")
        found[name] = s
    catalog = Catalog(found)
    catalog.check()
    return catalog


# What is fetched from a document.


@dataclass
class Shape:
    """What rules look at in a value: its kind, keys, elements, entries, and members by name."""

    parts: set[str] = field(default_factory=set)
    members: dict[str, Shape] = field(default_factory=dict)
    item: Shape | None = None
    value: Shape | None = None


@dataclass
class Value:
    """A value: Columns for itself and for each part of its shape. Absent is null."""

    shape: Shape
    v: Column
    part: dict[str, Column]
    members: dict[str, Value]


def fetched(v: Column, part: str, shape: Shape) -> Column:
    if part == "kind":
        return F.schema_of_variant(v)
    if part == "keys":
        return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))  # null for what is no object
    if part == "items":
        whole = F.try_variant_get(v, "$", "array<variant>")
        return F.transform(whole, lambda x: packed(x, shape.item)) if shape.item else whole
    return F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), packed(e["value"], shape.value).alias("x")))


def member(v: Column, name: str) -> Column:
    """A member of an object: null if there is none, a variant null if it is null."""
    path = f"$.{name}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name) else "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return F.try_variant_get(v, path, "variant")


def packed(v: Column, shape: Shape) -> Column:
    """A value within an array, as a struct."""
    return F.struct(v.alias("v"), *(fetched(v, p, shape).alias(p) for p in sorted(shape.parts)), *(packed(member(v, n), s).alias(f"m{i}") for i, (n, s) in enumerate(shape.members.items())))


def unpacked(x: Column, shape: Shape) -> Value:
    return Value(shape, x["v"], {p: x[p] for p in shape.parts}, {n: unpacked(x[f"m{i}"], s) for i, (n, s) in enumerate(shape.members.items())})


def in_columns(df: DataFrame, roots: dict[str, Shape]) -> tuple[DataFrame, dict[str, Value]]:
    """df, which has a variant column for each root, with columns for all that the shapes name; a projection for each depth."""
    values, todo = {}, []
    for name, shape in roots.items():
        values[name] = Value(shape, F.col(name), {}, {})
        todo.append((name, values[name]))
    while todo:
        made, after = {}, []
        for name, value in todo:
            for p in sorted(value.shape.parts):
                made[f"{name}_{p}"] = fetched(F.col(name), p, value.shape)
                value.part[p] = F.col(f"{name}_{p}")
            for i, (n, s) in enumerate(value.shape.members.items()):
                made[f"{name}_{i}"] = member(F.col(name), n)
                value.members[n] = Value(s, F.col(f"{name}_{i}"), {}, {})
                after.append((f"{name}_{i}", value.members[n]))
        df, todo = df.select("*", *(c.alias(n) for n, c in made.items())), after
    return df, values


# What is wrong with a value.


@dataclass
class Single:
    """One possible error: it is there where `wrong` is true."""

    wrong: Column
    path: Column
    rule: str

    def column(self) -> Column:
        return F.when(self.wrong, F.struct(self.path.alias("path"), F.lit(self.rule).alias("rule")))


@dataclass
class Many:
    """An array of errors, some of them null; null is none."""

    errors: Column


def below(path: Column, name: Column | str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(path == ROOT, name.cast("string")).otherwise(F.concat_ws(".", path, name.cast("string")))


def true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def as_array(found: list) -> Column:
    none = F.array().cast(ERRORS)
    singles = [f.column() for f in found if isinstance(f, Single)]
    many = [F.coalesce(f.errors, none) for f in found if isinstance(f, Many)]
    return F.concat(F.array(*singles).cast(ERRORS) if singles else none, *many)


def fine(found: list) -> Column:
    """Whether nothing is wrong."""
    parts = [~true(f.wrong) if isinstance(f, Single) else ~true(F.exists(f.errors, lambda e: e.isNotNull())) for f in found]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def searched(pattern: str) -> str:
    """A pattern whose last dollar also stands before one line feed at the end, and before no other line end."""
    return pattern[:-1] + r"(?=\n?\z)" if re.search(r"(?<!\\)(\\\\)*\$$", pattern) else pattern


def text_of(x: Value) -> Column:
    return F.when(x.part["kind"] == "STRING", F.try_variant_get(x.v, "$", "string"))


def number_of(x: Value) -> Column:
    return F.when(x.part["kind"].rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(x.v, "$", "double"))


def written(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def equals(x: Value, value: object) -> Column:
    if isinstance(value, str):
        return text_of(x) == value
    if isinstance(value, bool):
        return F.when(x.part["kind"] == "BOOLEAN", F.try_variant_get(x.v, "$", "boolean")) == value
    if isinstance(value, int | float):
        return number_of(x) == float(value)
    return F.to_json(x.v) == written(value)


def of_type(x: Value, name: str) -> Column:
    match name:
        case "object":
            return x.part["keys"].isNotNull()
        case "array":
            return x.part["items"].isNotNull()
        case "string":
            return x.part["kind"] == "STRING"
        case "number":
            return number_of(x).isNotNull()
        case "integer":
            return number_of(x) == F.floor(number_of(x))
        case "boolean":
            return x.part["kind"] == "BOOLEAN"
    return x.part["kind"] == "VOID"


def types_of(node: dict) -> list[str]:
    return [node["type"]] if isinstance(node.get("type"), str) else node.get("type", [])


class Compiler:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def shape(self, node: object, base: str, into: Shape) -> Shape:
        """Add to a shape what a schema looks at."""
        if not isinstance(node, dict):
            return into
        if "$ref" in node:
            target, at, full = self.catalog.resolve(node, base)
            if not self.catalog.recursive(full, target, at):
                self.shape(target, at, into)
        types, values = types_of(node), [node["const"]] if "const" in node else node.get("enum", [])
        if set(types) & {"string", "number", "integer", "boolean", "null"} or values or node.keys() & {"pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}:
            into.parts.add("kind")
        if "object" in types or node.keys() & {"required", "minProperties", "maxProperties", "additionalProperties"}:
            into.parts.add("keys")
        if "array" in types or node.keys() & {"items", "minItems", "maxItems", "uniqueItems"}:
            into.parts.add("items")
        for name, n in node.get("properties", {}).items():
            self.shape(n, base, into.members.setdefault(name, Shape()))
        for name in node.get("required", []):
            into.members.setdefault(name, Shape())
        if "items" in node or "uniqueItems" in node:
            into.item = self.shape(node.get("items", True), base, into.item or Shape())
        if isinstance(node.get("additionalProperties"), dict):
            into.parts.add("entries")
            into.value = self.shape(node["additionalProperties"], base, into.value or Shape())
        for n in [n for k in LISTS for n in node.get(k, [])] + [node[k] for k in ("not", "if", "then", "else") if k in node]:
            self.shape(n, base, into)
        return into

    def found(self, node: object, base: str, x: Value, path: Column) -> list:
        """What a schema may find wrong with a value; nothing where the value is absent."""
        there = x.v.isNotNull()
        if isinstance(node, bool):
            return [] if node else [Single(there, path, "false")]
        out: list = []
        add = lambda wrong, rule, at=path: out.append(Single(there & true(wrong), at, rule))
        if "$ref" in node:
            target, at, full = self.catalog.resolve(node, base)
            if self.catalog.recursive(full, target, at):
                whole = F.when(there, F.to_json(x.v))
                add(~F.coalesce(follows(self.catalog, target, at)(whole), F.lit(True)), next((k for k in ("oneOf", "anyOf") if k in target), "$ref"))
            else:
                out += self.found(target, at, x, path)
        if types := types_of(node):
            add(~reduce(lambda a, b: a | b, (true(of_type(x, t)) for t in types)), "type")
        for k in ("const", "enum"):
            if k in node:
                values = [node[k]] if k == "const" else node[k]
                texts = [v for v in values if isinstance(v, str)]
                among = [true(text_of(x).isin(texts))] if texts else []
                add(~reduce(lambda a, b: a | b, among + [true(equals(x, v)) for v in values if not isinstance(v, str)], F.lit(False)), k)
        if "pattern" in node:
            add(~text_of(x).rlike(searched(node["pattern"])), "pattern")
        if "minLength" in node:
            add(F.length(text_of(x)) < node["minLength"], "minLength")
        if "maxLength" in node:
            add(F.length(text_of(x)) > node["maxLength"], "maxLength")
        for k, wrong in (("minimum", lambda n, v: n < v), ("maximum", lambda n, v: n > v), ("exclusiveMinimum", lambda n, v: n <= v), ("exclusiveMaximum", lambda n, v: n >= v), ("multipleOf", lambda n, v: n / v != F.floor(n / v))):
            if k in node:
                add(wrong(number_of(x), float(node[k])), k)
        for k, wrong in (("minItems", lambda n, v: n < v), ("maxItems", lambda n, v: n > v)):
            if k in node:
                add(wrong(F.size(x.part["items"]), node[k]), k)
        if node.get("uniqueItems"):
            texts = F.transform(x.part["items"], lambda e: F.to_json(e["v"]))
            add(F.size(F.array_distinct(texts)) < F.size(texts), "uniqueItems")
        if isinstance(node.get("items"), dict | bool):
            out.append(Many(F.flatten(F.transform(x.part["items"], lambda e, i: as_array(self.found(node["items"], base, unpacked(e, x.shape.item), below(path, i)))))))
        for name in node.get("required", []):
            add(x.part["keys"].isNotNull() & x.members[name].v.isNull(), f"required:{name}")
        for k, wrong in (("minProperties", lambda n, v: n < v), ("maxProperties", lambda n, v: n > v)):
            if k in node:
                add(wrong(F.size(x.part["keys"]), node[k]), k)
        for name, n in node.get("properties", {}).items():
            out += self.found(n, base, x.members[name], below(path, name))
        named = list(node.get("properties", {}))
        other = node.get("additionalProperties", True)
        if other is False:
            add(F.size(F.array_except(x.part["keys"], F.array(*map(F.lit, named)).cast("array<string>"))) > 0, "additionalProperties")
        elif isinstance(other, dict):
            rest = F.filter(x.part["entries"], lambda e: ~e["key"].isin(named)) if named else x.part["entries"]
            out.append(Many(F.flatten(F.transform(rest, lambda e: as_array(self.found(other, base, unpacked(e["x"], x.shape.value), below(path, e["key"])))))))
        for n in node.get("allOf", []):
            out += self.found(n, base, x, path)
        for k in ("anyOf", "oneOf"):
            if k in node:
                hits = reduce(lambda a, b: a + b, (fine(self.found(n, base, x, path)).cast("int") for n in node[k]))
                add(hits != 1 if k == "oneOf" else hits == 0, k)
        if "not" in node:
            add(fine(self.found(node["not"], base, x, path)), "not")
        if "if" in node:
            holds = fine(self.found(node["if"], base, x, path))
            for k, when in (("then", holds), ("else", ~holds)):
                for f in self.found(node[k], base, x, path) if k in node else []:
                    out.append(Single(when & f.wrong, f.path, f.rule) if isinstance(f, Single) else Many(F.when(when, f.errors)))
        return out


def follows(catalog: Catalog, node: dict, base: str):
    """A function of JSON texts: whether each follows a schema, which may refer to itself."""

    @F.pandas_udf(BooleanType())
    def run(texts: pd.Series) -> pd.Series:
        known = {t: holds(catalog, node, base, json.loads(t)) for t in texts.dropna().unique()}  # of a batch
        return texts.map(known)

    return run


def holds(catalog: Catalog, node: object, base: str, x: object) -> bool:
    if isinstance(node, bool):
        return node
    sub = lambda n, y=x: holds(catalog, n, base, y)
    number, text = isinstance(x, int | float) and not isinstance(x, bool), isinstance(x, str)
    kinds = {"object": isinstance(x, dict), "array": isinstance(x, list), "string": text, "number": number, "integer": number and x == x // 1, "boolean": isinstance(x, bool), "null": x is None}
    same = lambda a, b: written(a) == written(b)
    checks = {
        "$ref": lambda v: (lambda t: holds(catalog, t[0], t[1], x))(catalog.resolve(node, base)),
        "type": lambda v: any(kinds[t] for t in types_of(node)),
        "const": lambda v: same(v, x),
        "enum": lambda v: any(same(y, x) for y in v),
        "pattern": lambda v: not text or bool(re.search(v, x)),
        "minLength": lambda v: not text or len(x) >= v,
        "maxLength": lambda v: not text or len(x) <= v,
        "minimum": lambda v: not number or x >= v,
        "maximum": lambda v: not number or x <= v,
        "exclusiveMinimum": lambda v: not number or x > v,
        "exclusiveMaximum": lambda v: not number or x < v,
        "multipleOf": lambda v: not number or x / v == x / v // 1,
        "minItems": lambda v: not kinds["array"] or len(x) >= v,
        "maxItems": lambda v: not kinds["array"] or len(x) <= v,
        "uniqueItems": lambda v: not v or not kinds["array"] or len(set(map(written, x))) == len(x),
        "items": lambda v: not kinds["array"] or all(sub(v, y) for y in x),
        "required": lambda v: not kinds["object"] or set(v) <= x.keys(),
        "minProperties": lambda v: not kinds["object"] or len(x) >= v,
        "maxProperties": lambda v: not kinds["object"] or len(x) <= v,
        "properties": lambda v: not kinds["object"] or all(sub(n, x[k]) for k, n in v.items() if k in x),
        "additionalProperties": lambda v: not kinds["object"] or all(sub(v, y) for k, y in x.items() if k not in node.get("properties", {})),
        "allOf": lambda v: all(map(sub, v)),
        "anyOf": lambda v: any(map(sub, v)),
        "oneOf": lambda v: sum(map(sub, v)) == 1,
        "not": lambda v: not sub(v),
        "if": lambda v: sub(node.get("then", True)) if sub(v) else sub(node.get("else", True)),
    }
    return all(checks[k](v) for k, v in node.items() if k in checks)


def schema_errors(documents: DataFrame, json_col: str, *keep: str, catalog: Catalog, only: tuple[str, ...] | None = None) -> DataFrame:
    """(keep..., contract, path, rule): all errors of each document, dispatched by its `contract`.

    Text that is no JSON, or null, has the error `json`; a document without a contract name `contract`, with
    one that is not registered (or not in `only`) `unregistered`. A missing member is `required:<name>` at its parent.
    """
    names = {c: s for c, s in catalog.contracts.items() if only is None or c in only}
    compiler = Compiler(catalog)
    shapes = {f"__d{i}": compiler.shape(catalog.schemas[s], s, Shape()) for i, s in enumerate(names.values())}
    name = F.col("__contract")
    is_text = F.schema_of_variant(F.col("__contract_v")) == "STRING"
    parsed = documents.select(*keep, F.try_parse_json(F.col(json_col)).alias("__doc")).withColumn("__contract_v", member(F.col("__doc"), "contract"))
    parsed = parsed.withColumn("__contract", F.when(is_text, F.try_variant_get(F.col("__contract_v"), "$", "string")))
    parsed = parsed.select("*", *(F.when(name == c, F.col("__doc")).alias(f"__d{i}") for i, c in enumerate(names)))
    rows, values = in_columns(parsed, shapes)
    found: list = [Single(F.col("__doc").isNull(), F.lit(ROOT), "json"), Single(F.col("__doc").isNotNull() & name.isNull(), F.lit("contract"), "contract"), Single(~name.isin(list(names)), F.lit("contract"), "unregistered")]
    for i, s in enumerate(names.values()):
        found += compiler.found(catalog.schemas[s], s, values[f"__d{i}"], F.lit(ROOT))
    errors = F.array_distinct(F.filter(as_array(found), lambda e: e.isNotNull()))
    return rows.select(*keep, name.alias("contract"), F.explode(errors).alias("e")).select(*keep, "contract", "e.path", "e.rule")
