"""JSON schemas compiled to one Column over a variant: the first rule that a value breaks, with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of strict JSON texts, and of strings and arrays without bounds of their own.
MAX_BYTES, MAX_LENGTH, MAX_ITEMS, MAX_NUMBER = 1 << 20, 4096, 512, 1e100
#: How often a reference may lead into itself before a value counts as too deep.
MAX_DEPTH = 6


def _typed(value: Column, kind: Column, wanted: str) -> Column:
    """Whether a variant of the schema text ``kind`` is of a JSON type; a number with a point is no integer, true is no number."""
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((?:19|2\d|3\d),0\)$")  # whole numbers beyond 64 bits are decimals
    return {
        "object": lambda: kind.startswith("OBJECT"),
        "array": lambda: kind.startswith("ARRAY"),
        "string": lambda: kind == "STRING",
        "boolean": lambda: kind == "BOOLEAN",
        "integer": lambda: whole,
        "number": lambda: kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
        "null": lambda: kind == "VOID",
    }[wanted]()


def _equal(value: Column, kind: Column, wanted) -> Column:
    """Equality of type and value with a constant of the schema."""
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & F.coalesce(F.try_variant_get(value, "$", "boolean") == wanted, F.lit(False))
    if isinstance(wanted, str):
        return (kind == "STRING") & F.coalesce(F.try_variant_get(value, "$", "string") == wanted, F.lit(False))
    if isinstance(wanted, int):
        return _typed(value, kind, "integer") & F.coalesce(F.try_variant_get(value, "$", "bigint") == wanted, F.lit(False))
    if isinstance(wanted, float):
        return _typed(value, kind, "number") & ~_typed(value, kind, "integer") & F.coalesce(F.try_variant_get(value, "$", "double") == wanted, F.lit(False))
    raise ValueError("constants of a schema are null, booleans, texts and numbers")


def violation(value: Column, schema: dict, *, max_depth: int = MAX_DEPTH) -> Column:
    """The first rule of ``schema`` that a variant breaks, as ``path:rule``, or null.

    Rules: $ref to #/$defs, oneOf (exactly one), const, enum, type, minLength and
    maxLength, pattern (of the whole text), minimum and maximum, minItems and
    maxItems, items, and closed objects: they have exactly the required fields.
    Fields are looked at in the order of their names, elements in their own. A
    value that is nested in itself more than ``max_depth`` times breaks the rule
    ``depth``. A schema that refers elsewhere, or leaves objects open, is refused
    when it is compiled.
    """
    return _check(value, schema, schema, F.lit("$"), {}, max_depth)


def _check(v: Column, schema: dict, root: dict, path: Column, inside: dict[str, int], most: int) -> Column:
    broken = lambda rule: F.concat(path, F.lit(f":{rule}"))
    if "$ref" in schema:
        name = schema["$ref"]
        if not name.startswith("#/$defs/"):
            raise ValueError("references lead to #/$defs only")
        if inside.get(name, 0) > most:
            return broken("depth")
        return _check(v, root["$defs"][name.rsplit("/", 1)[1]], root, path, inside | {name: inside.get(name, 0) + 1}, most)
    if "oneOf" in schema:
        fits = sum((F.when(_check(v, b, root, path, inside, most).isNull(), 1).otherwise(0) for b in schema["oneOf"]), F.lit(0))
        return F.when(fits != 1, broken("oneOf"))
    kind = F.schema_of_variant(v)
    rules = []
    if "const" in schema:
        rules.append(F.when(~_equal(v, kind, schema["const"]), broken("const")))
    if "enum" in schema:
        one = F.lit(False)
        for x in schema["enum"]:
            one |= _equal(v, kind, x)
        rules.append(F.when(~one, broken("enum")))
    wanted = schema.get("type")
    if wanted:
        rules.append(F.when(~_typed(v, kind, wanted), broken("type")))
    may = lambda t: wanted in (None, t)
    if may("string") and "const" not in schema and "enum" not in schema:
        text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        rules.append(F.when(~F.length(text).between(schema.get("minLength", 0), schema.get("maxLength", MAX_LENGTH)), broken("length")))
        if "pattern" in schema:
            rules.append(F.when(~text.rlike(rf"\A(?:{schema['pattern']})\z"), broken("pattern")))
    if may("number") or may("integer"):
        number = F.when(_typed(v, kind, "number"), F.try_variant_get(v, "$", "double"))
        rules.append(F.when(~number.between(float(schema.get("minimum", -MAX_NUMBER)), float(schema.get("maximum", MAX_NUMBER))) | F.isnan(number), broken("number")))
    if may("array"):
        items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        rules.append(F.when(~F.size(items).between(schema.get("minItems", 0), schema.get("maxItems", MAX_ITEMS)) & items.isNotNull(), broken("count")))
        if "items" in schema:
            each = F.transform(items, lambda x, i: _check(x, schema["items"], root, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), inside, most))
            rules.append(F.try_element_at(F.array_compact(each), F.lit(1)))
    if may("object") and (wanted == "object" or "properties" in schema):
        if schema.get("additionalProperties") is not False:
            raise ValueError("objects of a schema are closed")
        fields = F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))
        required = sorted(schema.get("required", []))
        names = F.array(*map(F.lit, required)) if required else F.array().cast("array<string>")
        rules.append(F.when(F.array_sort(F.map_keys(fields)) != names, broken("closed_fields")))
        for name in required:
            rules.append(F.when(fields.isNotNull(), _check(F.element_at(fields, F.lit(name)), schema["properties"][name], root, F.concat(path, F.lit(f".{name}")), inside, most)))
    return F.coalesce(*rules) if rules else F.lit(None).cast("string")


def checked(rows: DataFrame, key: str, text: str, schema: dict, *, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(key, state, failed) of JSON texts: too_large, invalid (no JSON, a name twice in an object, or NaN), broken with the first
    rule in ``failed``, or valid. A null text is invalid."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    parsed = rows.select(key, size.alias("size"), F.when(size <= max_bytes, F.try_parse_json(text)).alias("v"))
    found = parsed.select(key, "size", "v", F.when(F.col("v").isNotNull(), violation(F.col("v"), schema)).alias("failed"))
    state = F.when(F.col("size") > max_bytes, "too_large").when(F.col("v").isNull(), "invalid").when(F.col("failed").isNotNull(), "broken").otherwise("valid")
    return found.select(key, state.alias("state"), F.coalesce("failed", F.lit("")).alias("failed"))
