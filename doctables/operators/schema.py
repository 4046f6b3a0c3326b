"""Field-definition schemas as tables: one row per field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables.functions.text import let

# Field types, and the name patterns of totals, line amounts, quantities and prices.
FIELD_TYPES = ("string", "number", "array", "object", "boolean", "enum")
CONTAINERS = ("array", "object")
TOTAL_NAME = r"(?i)total|grand|subtotal|amount_due|balance|payable|receivable|net_amount|gross_amount|net_total|gross_total"
NOT_TOTAL = r"(?i)vat|tax|percent|pct|cgst|sgst|discount|rate|qty|quantity|weight|tons|kg|litres|liters"
AMOUNT_NAME = r"(?i)amount|total|price|value"
NOT_AMOUNT = (r"(?i)unit|per|rate|tariff|qty|quantity|count|tax|vat|discount|percent|pct|weight|tons|kg|litres|liters"
              r"|passenger|hours?|minutes?|days?|date|time|duration")
QUANTITY_NAME = r"(?i)(^|_)(qty|quantity|units?|litres?|liters?|gallons?|kgs?|tons?)$"
PRICE_NAME = r"(?i)(unit_price|price_per_unit|price|rate|tariff|charge_rate)"

# children of a definition as (name, def, required), in both spellings
_NATIVE = """transform(from_json({source}, 'array<string>'), d -> named_struct(
  'name', get_json_object(d, '$.name'), 'def', d, 'required', get_json_object(d, '$.required') = 'true'))"""
_JSON_SCHEMA = """transform(map_entries(from_json({source}, 'map<string,string>')), e -> named_struct(
  'name', e.key, 'def', e.value, 'required', array_contains(from_json({required}, 'array<string>'), e.key)))"""

# outer, as the optimizer would parse the children of an inner one once more in a filter
_WALK = """
WITH RECURSIVE tree(template_id, seq, style, place, positions, lineage, path, norm_path, parent, name, ord, depth, def, required,
    type, under_objects, checked, root_type, indent) AS (
  SELECT template_id, seq, style, concat('schema[', pos, ']'), array(pos), CAST(array() AS ARRAY<STRING>), kid.name, lower(trim(kid.name)), CAST(NULL AS STRING),
    kid.name, pos, 0, kid.def, kid.required, coalesce(get_json_object(kid.def, '$.type'), CASE WHEN style = 'json' THEN 'string' END),
    TRUE, TRUE, coalesce(get_json_object(kid.def, '$.type'), ''), 2
  FROM {roots} LATERAL VIEW OUTER posexplode(kids) k AS pos, kid WHERE pos IS NOT NULL
  UNION ALL
  SELECT template_id, seq, style, concat(place, '.children[', pos, ']'), concat(positions, array(pos)), concat(lineage, array(place)),
    concat(path, '.', kid.name), concat(norm_path, '.', lower(trim(kid.name))), path, kid.name, pos, depth + 1, kid.def, kid.required,
    coalesce(get_json_object(kid.def, '$.type'), CASE WHEN style = 'json' THEN 'string' END),
    under_objects AND coalesce(type, '') = 'object', checked AND coalesce(type, '') IN ('array', 'object'), root_type,
    indent + CASE WHEN type = 'array' THEN 4 ELSE 2 END
  FROM tree LATERAL VIEW OUTER posexplode(CASE WHEN style = 'native' THEN NATIVE_KIDS
    WHEN type = 'array' AND get_json_object(def, '$.items') IS NOT NULL THEN ITEM_KIDS ELSE PROPERTY_KIDS END) k AS pos, kid WHERE pos IS NOT NULL
)
SELECT * FROM tree
""".replace("NATIVE_KIDS", _NATIVE.replace("{source}", "get_json_object(def, '$.children')")).replace(
    "ITEM_KIDS", _JSON_SCHEMA.replace("{source}", "get_json_object(def, '$.items.properties')").replace("{required}", "get_json_object(def, '$.items.required')")).replace(
    "PROPERTY_KIDS", _JSON_SCHEMA.replace("{source}", "get_json_object(def, '$.properties')").replace("{required}", "get_json_object(def, '$.required')"))


def normalize_schemas(templates: DataFrame) -> DataFrame:
    """Field rows of schemas in any of the four spellings.

    Accepted are an array of fields, an object with ``fields``, a single field, and a JSON Schema.
    ``templates`` has (template_id, seq, schema); ``seq`` is the order of the sources.
    """
    spark = templates.sparkSession
    # a schema table of any size may be walked; the depth limit of the session stays
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    # many schemas fit into one small file, and parsing them is the work: it is dealt out to all tasks
    dealt = templates.select("template_id", "seq", F.trim("schema").alias("_s")).repartition(spark.sparkContext.defaultParallelism * 4)
    spelled = dealt.select(
        "template_id", "seq", "_s", F.get_json_object("_s", "$.fields").alias("_fields"), F.get_json_object("_s", "$.properties").alias("_props"),
        (F.get_json_object("_s", "$.name").isNotNull() & F.get_json_object("_s", "$.type").isNotNull()).alias("_single"))
    is_list = F.col("_s").startswith("[")
    native = F.when(is_list, F.col("_s")).when(F.col("_fields").startswith("["), F.col("_fields")).when(
        F.col("_single"), F.concat(F.lit("["), "_s", F.lit("]")))
    kids = F.when(native.isNotNull(), F.expr(_NATIVE.replace("{source}", "_native"))).otherwise(
        F.expr(_JSON_SCHEMA.replace("{source}", "_props").replace("{required}", "get_json_object(_s, '$.required')")))
    roots = spelled.withColumn("_native", native).select(
        "template_id", "seq", F.when(native.isNotNull(), "native").otherwise("json").alias("style"), kids.alias("kids"))
    tree = spark.sql(_WALK, roots=roots)
    n_kids = F.when(F.col("style") == "native", F.size(F.from_json(F.get_json_object("def", "$.children"), "array<string>"))).when(
        (F.col("type") == "array") & F.get_json_object("def", "$.items").isNotNull(),
        F.size(F.map_keys(F.from_json(F.get_json_object("def", "$.items.properties"), "map<string,string>")))).otherwise(
        F.size(F.map_keys(F.from_json(F.get_json_object("def", "$.properties"), "map<string,string>"))))
    return tree.select(
        "*", F.get_json_object("def", "$.format").alias("format"), F.get_json_object("def", "$.description").alias("description"),
        F.from_json(F.get_json_object("def", "$.values"), "array<string>").alias("enum_values"),
        F.greatest(F.coalesce(n_kids, F.lit(0)), F.lit(0)).alias("n_children"))


def flatten_schemas(templates: DataFrame) -> DataFrame:
    """One row per field: path, parent, name, type, depth, order, required, format."""
    return normalize_schemas(templates)


def validate_schemas(fields: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row per violated rule and place.

    With the templates given, schemas that are no array are reported too. Children are checked only
    below arrays and objects.
    """
    v = F.try_parse_json("def")

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))

    def blank(path: str) -> Column:
        return (kind(path) != "STRING") | (F.trim(F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))) == "")

    values = F.try_variant_get(v, "$.values", "array<variant>")
    enum_empty = ~kind("$.values").startswith("ARRAY") | (F.coalesce(F.size(values), F.lit(0)) <= 0)
    enum_mixed = ~enum_empty & F.exists(values, lambda x: F.schema_of_variant(x) != "STRING")
    container = F.col("type").isin(*CONTAINERS)
    has_children = F.get_json_object("def", "$.children").isNotNull()
    rules = {
        "name": blank("$.name"),
        "type": (kind("$.type") != "STRING") | ~F.coalesce(F.col("type").isin(*FIELD_TYPES), F.lit(False)),
        "description": blank("$.description"),
        "values": (F.col("type") == "enum") & enum_empty,
        "values_text": (F.col("type") == "enum") & enum_mixed,
        "children": container & ~has_children,
        "children_empty": container & has_children & (F.col("n_children") == 0),
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]))
    out = fields.where(F.col("checked") & (F.col("style") == "native")).select("template_id", "place", F.explode(broken).alias("rule"))
    if templates is not None:
        no_list = templates.where(~F.trim("schema").startswith("[")).select(
            "template_id", F.lit("schema").alias("place"), F.lit("array").alias("rule"))
        out = out.unionByName(no_list)
    return out


SCALARS = {"string": T.StringType(), "enum": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def to_struct_type(fields: DataFrame, template_id: str, max_fields: int = 100_000) -> T.StructType:
    """Spark schema of one template.

    An array with a single child holds scalars; containers without children are left out; only
    required fields are non-null. One schema is a small object, and its size is checked.
    """
    rows = fields.where(F.col("template_id") == template_id).select(
        "place", "lineage", "name", "type", "required", "positions").limit(max_fields + 1).collect()
    if len(rows) > max_fields:
        raise ValueError(f"template {template_id} has more than {max_fields} fields")
    children: dict[str | None, list] = {}
    for r in sorted(rows, key=lambda r: r.positions):
        children.setdefault(r.lineage[-1] if r.lineage else None, []).append(r)

    def data_type(r) -> T.DataType | None:
        if r.type in SCALARS:
            return SCALARS[r.type]
        kids = children.get(r.place, [])
        if r.type not in CONTAINERS:
            raise ValueError(f"unsupported type {r.type} at {r.place}")
        if not kids:
            return None
        if r.type == "array" and len(kids) == 1:
            inner = data_type(kids[0])
            return T.ArrayType(inner) if inner is not None else None
        inner = struct(kids)
        return T.ArrayType(inner) if r.type == "array" else inner

    def struct(kids) -> T.StructType:
        built = [(k, data_type(k)) for k in kids]
        return T.StructType([T.StructField(k.name, t, not k.required) for k, t in built if t is not None])

    return struct(children.get(None, []))


def conform(records: DataFrame, schema: T.StructType, enums: dict[str, Sequence[str]] | None = None,
            col: str = "record") -> tuple[DataFrame, DataFrame]:
    """Typed rows of JSON records, and the violations found on the way.

    Missing values become null, missing arrays become empty. Violations are (doc_id, path, rule) with
    the rules ``required``, ``type`` and ``enum``; a path inside an array is written ``array[].field``.
    """
    enums = enums or {}
    rest = [c for c in records.columns if c != col]
    parsed = records.select(*rest, F.from_json(col, _nullable(schema)).alias("_r"))
    rows = parsed.select(*rest, *[
        (F.coalesce(F.col(f"_r.{f.name}"), F.array().cast(_nullable(f.dataType))) if isinstance(f.dataType, T.ArrayType)
         else F.col(f"_r.{f.name}")).alias(f.name) for f in schema])

    def fits(kind: Column, t: T.DataType) -> Column:
        if isinstance(t, T.ArrayType):
            return kind.startswith("ARRAY")
        if isinstance(t, T.StructType):
            return kind.startswith("OBJECT")
        if isinstance(t, T.DoubleType):
            return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return kind == ("BOOLEAN" if isinstance(t, T.BooleanType) else "STRING")

    def check(v: Column, struct: T.StructType, path: str) -> list[Column]:
        """Violation texts ``path|rule`` of an object variant; nulls where nothing is wrong."""
        found = []
        for f in struct:
            at = f"{path}{f.name}"
            value = F.try_variant_get(v, f"$.{f.name}", "variant")
            kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            absent = kind == "VOID"
            if not f.nullable:
                found.append(F.when(absent, f"{at}|required"))
            found.append(F.when(~absent & ~fits(kind, f.dataType), f"{at}|type"))
            if at in enums:
                text = F.try_variant_get(value, "$", "string")
                found.append(F.when((kind == "STRING") & ~text.isin(list(enums[at])), f"{at}|enum"))
            if isinstance(f.dataType, T.StructType):
                inner = F.array(*check(value, f.dataType, f"{at}."))
                found.append(F.when(kind.startswith("OBJECT"), F.array_join(inner, ";")))
            elif isinstance(f.dataType, T.ArrayType):
                items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
                element = f.dataType.elementType
                if isinstance(element, T.StructType):
                    seen = F.flatten(F.transform(items, lambda x: F.split(F.array_join(F.array(*check(x, element, f"{at}[].")), ";"), ";")))
                else:
                    seen = F.transform(items, lambda x: F.when(~fits(F.coalesce(F.schema_of_variant(x), F.lit("VOID")), element), f"{at}[]|type"))
                found.append(F.array_join(F.array_distinct(seen), ";"))
        return found

    doc = F.try_parse_json(col)
    texts = F.when(doc.isNull(), F.lit("|unparsable")).otherwise(F.array_join(F.array(*check(doc, schema, "")), ";"))
    listed = F.array_distinct(F.filter(F.split(texts, ";"), lambda x: x != ""))
    violations = records.select(*rest, F.explode(listed).alias("_v")).select(
        *rest, F.split("_v", r"\|").getItem(0).alias("path"), F.split("_v", r"\|").getItem(1).alias("rule"))
    return rows, violations


def _nullable(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind])
    return kind


def merge_schemas(fields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Merge the fields of many sources per ``by`` key.

    Names match without case and outer blanks at every level. The first definition wins, a missing
    description is filled from a later source, and fields keep their order of appearance.
    """
    named = fields.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    rank = F.struct("seq", "positions")
    definition = F.struct("path", "name", "type", "format", "required", "depth")
    described = F.when(F.col("description") != "", F.struct(rank.alias("rank"), F.col("description").alias("text")))
    merged = named.groupBy(*by, "norm_path").agg(
        F.min(F.struct(rank.alias("rank"), definition.alias("def"))).alias("_first"),
        F.min(described).alias("_described"), F.count("*").alias("n_sources"))
    return merged.select(*by, "norm_path", "_first.def.*", F.col("_described.text").alias("description"),
                         "n_sources", F.col("_first.rank").alias("first_seen"))


def prune_schemas(fields: DataFrame) -> DataFrame:
    """Drop containers without any field below them; a container stays if some leaf lies below it."""
    container = F.coalesce(F.col("type").isin(*CONTAINERS), F.lit(False))
    holding = fields.where(~container).select("template_id", F.explode("lineage").alias("place")).distinct()
    kept = fields.where(container).join(holding, ["template_id", "place"], "left_semi")
    return fields.where(~container).unionByName(kept)


def total_fields(fields: DataFrame) -> DataFrame:
    """Numeric fields named like totals, never inside arrays."""
    return fields.where(F.col("under_objects") & (F.col("type") == "number") & F.col("name").rlike(TOTAL_NAME) & ~F.col("name").rlike(NOT_TOTAL))


def array_fields(fields: DataFrame) -> DataFrame:
    """Line-item arrays with children, reached through objects only."""
    return fields.where(F.col("under_objects") & (F.col("type") == "array") & (F.col("n_children") > 0))


def line_amount_spec(fields: DataFrame) -> DataFrame:
    """Amount rule per line-item array: the best amount column, else quantity and price, else none."""
    name = F.col("name")
    order = F.struct(F.when(name.contains("amount"), 0).when(name.contains("total"), 1).otherwise(2).alias("rank"), "ord")
    numeric = fields.where((F.col("type") == "number") & (F.col("depth") > 0)).withColumn("_array", F.element_at("lineage", -1))
    specs = numeric.groupBy("template_id", F.col("_array").alias("place")).agg(
        F.min(F.when(name.rlike(AMOUNT_NAME) & ~name.rlike(NOT_AMOUNT), F.struct(order.alias("o"), "name"))).alias("_amount"),
        F.min(F.when(name.rlike(QUANTITY_NAME), F.struct("ord", "name"))).alias("_qty"),
        F.min(F.when(name.rlike(PRICE_NAME), F.struct("ord", "name"))).alias("_price"))
    arrays = array_fields(fields).select("template_id", "place", "path")
    out = arrays.join(specs, ["template_id", "place"], "left")
    amount, qty, price = F.col("_amount.name"), F.col("_qty.name"), F.col("_price.name")
    kind = F.when(amount.isNotNull(), "field").when(qty.isNotNull() & price.isNotNull(), "product")
    product = kind == "product"
    return out.select("template_id", "path", kind.alias("kind"), amount.alias("amount_column"),
                      F.when(product, qty).alias("qty_column"), F.when(product, price).alias("price_column"))


def date_fields(fields: DataFrame, input_format: str | None = None) -> DataFrame:
    """Text fields that hold dates, with the order hint of their format or of the input format."""
    name = F.coalesce("name", F.lit(""))
    fmt = F.coalesce("format", F.lit(""))
    dated = (F.regexp_replace(name, "[_-]", " ").rlike(r"(?i)\bdate\b") | name.rlike("(?<=[a-z])Date")
             | fmt.rlike("(?i)date") | fmt.rlike("[YD]"))
    text = F.coalesce("type", F.lit("")).isin("", "string")
    upper = (input_format or "").upper()
    hint = next((h for h in ("DD", "MM", "YYYY") if upper.startswith(h)), "")
    return fields.where((F.col("n_children") == 0) & text & dated).withColumn(
        "hint", F.when(fmt != "", fmt).otherwise(F.lit(hint)))


def array_only(fields: DataFrame) -> DataFrame:
    """The array fields of a schema with everything below them."""
    return fields.where(F.col("root_type") == "array")


def schema_outline(fields: DataFrame) -> DataFrame:
    """Indented outline per template: ``name: type``, braces around objects, brackets around arrays."""
    f = fields.where(~F.col("type").isin(*CONTAINERS) | (F.col("n_children") > 0))
    pad = F.expr("repeat(' ', indent)")
    only = f.where(F.col("depth") > 0).select("template_id", F.element_at("lineage", -1).alias("place"), F.col("type").alias("_child"))
    first = only.groupBy("template_id", "place").agg(F.first("_child").alias("_child"))
    f = f.join(first, ["template_id", "place"], "left")
    # the single child of a scalar array is shown in the array's own line
    scalar_array = (F.col("type") == "array") & (F.col("n_children") == 1) & ~F.col("_child").isin(*CONTAINERS)
    hidden = f.where(scalar_array).select("template_id", F.col("place").alias("_up")).distinct()
    shown = f.withColumn("_up", F.element_at("lineage", F.when(F.size("lineage") > 0, -1))).join(
        hidden, ["template_id", "_up"], "left_anti")
    kind = F.when(F.col("type") == "enum", "string").otherwise(F.col("type"))
    child = F.when(F.col("_child") == "enum", "string").otherwise(F.col("_child"))
    open_line = F.when(scalar_array, F.concat(F.lit("["), child, F.lit("]"))).when(
        F.col("type") == "array", F.lit("[ {")).when(F.col("type") == "object", F.lit("{")).otherwise(kind)
    close_line = F.when(scalar_array, F.lit(None)).when(F.col("type") == "array", F.lit("} ]")).when(F.col("type") == "object", F.lit("}"))
    lines = F.array_compact(F.array(
        F.struct(F.col("positions").alias("key"), F.concat(pad, "name", F.lit(": "), open_line).alias("text")),
        F.when(close_line.isNotNull(), F.struct(F.concat("positions", F.array(F.lit(2147483647))).alias("key"), F.concat(pad, close_line).alias("text")))))
    each = shown.select("template_id", F.explode(lines).alias("l"))
    return each.groupBy("template_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["text"]), "\n").alias("outline"))


_INFER = """
WITH RECURSIVE tree(source, seq, rec, n, path, name, depth, element, value) AS (
  SELECT source, seq, rec, n, key, key, 0, FALSE, value FROM {records}, LATERAL variant_explode(parsed)
  UNION ALL
  SELECT source, seq, rec, n, CASE WHEN e.key IS NULL THEN path ELSE concat(path, '.', e.key) END, coalesce(e.key, name),
    depth + CASE WHEN e.key IS NULL THEN 0 ELSE 1 END, e.key IS NULL, e.value
  FROM tree, LATERAL variant_explode(tree.value) AS e
)
SELECT source, seq, rec, n, path, name, depth, element, schema_of_variant(value) AS kind FROM tree
"""


def _shape(parsed: Column, own: Column) -> Column:
    """The names and types of a JSON value as text, all kinds of numbers alike; names that need quotes are left as they are.

    ``own`` follows where elements of one array differ in type.
    """
    numbers = r"(: |ARRAY<)(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))(?=[,>])"
    return let(F.schema_of_variant(parsed), lambda k: F.concat(
        F.when(k.contains("`"), k).otherwise(F.regexp_replace(k, numbers, "$1NUMBER")), F.when(k.contains("VARIANT"), own.cast("string")).otherwise("")))


def infer_schema(records: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Field rows inferred from JSON records: the first type seen wins, over all records of a source.

    ``records`` has (source, seq, record); records of equal ``seq`` stand in the order of their hashes. Sources merge as in ``merge_schemas``
    when ``by`` is empty. ``n_records`` counts the records that have the field, with any value or null.

    Records of a source with the same names and types are counted, and the first of them is taken apart, so values make no rows. Where
    elements of one array differ in type, records stand for themselves. Null records and those that are no JSON are left out.
    """
    spark = records.sparkSession
    # records that stand for themselves may be many
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    rows = records.select("source", "seq", F.xxhash64("record").alias("rec"), "record")
    # records that are no JSON have no shape, and the one that stands for them has no fields
    shapes = rows.select("source", "seq", "rec", _shape(F.try_parse_json("record"), F.col("rec")).alias("shape"))
    same = shapes.groupBy("source", "shape").agg(F.min(F.struct("seq", "rec")).alias("_first"), F.count("*").alias("n"))
    # two shapes can meet in one (seq, rec) only if hashes of records collide
    same = same.groupBy("source", "_first.seq", "_first.rec").agg(F.sum("n").alias("n"))
    equal = " AND ".join(f"r.{c} <=> s.{c}" for c in ("source", "seq", "rec"))
    first = rows.alias("r").join(same.alias("s"), F.expr(equal)).select("r.*", "s.n").dropDuplicates(["source", "seq", "rec"])
    nodes = spark.sql(_INFER, records=first.select("source", "seq", "rec", "n", F.try_parse_json("record").alias("parsed")))
    kind = (F.when(F.col("kind").startswith("OBJECT"), "object").when(F.col("kind").startswith("ARRAY"), "array")
            .when(F.col("kind") == "STRING", "string").when(F.col("kind") == "BOOLEAN", "boolean").when(F.col("kind") != "VOID", "number"))
    nodes = nodes.withColumn("type", kind).withColumn("norm_path", F.lower("path"))
    typed, element = F.col("type").isNotNull(), F.col("element")
    seen = nodes.groupBy("source", "seq", "rec", "norm_path").agg(
        F.min(F.when(typed & ~element, F.struct("seq", "rec", "path", "name", "depth", "type"))).alias("_f"), F.max("n").alias("n"),
        F.min(F.when(typed & element & (F.col("type") != "object"), F.struct("seq", "rec", "type"))).alias("_item"))
    fields = seen.groupBy(*by, "norm_path").agg(F.min("_f").alias("_f"), F.min("_item")["type"].alias("item_type"), F.sum("n").alias("n_records"))
    return fields.where(F.col("_f").isNotNull()).select(
        *by, "norm_path", "_f.path", "_f.name", "_f.depth", "_f.type", F.when(F.col("_f.type") == "array", F.col("item_type")).alias("item_type"), "n_records")
