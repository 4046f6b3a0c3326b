"""Schema queries over a registry with one template per customer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.operators import schema as S
from doctables.session import stored
from doctables.workload import query
from doctables.workload.fixtures import with_fixtures as fx

# the same walk with DuckDB's JSON functions
TREE = """
WITH RECURSIVE roots AS (SELECT template_id, seq, CASE WHEN json_type(schema) = 'ARRAY' THEN 'native' WHEN json_exists(schema, '$.fields') THEN 'native'
    WHEN json_exists(schema, '$.name') THEN 'native' ELSE 'json' END AS style, CAST(schema AS JSON) AS j FROM registry),
top AS (SELECT template_id, seq, style, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_exists(j, '$.fields') THEN j->'$.fields' WHEN json_exists(j, '$.name') THEN json_array(j) ELSE j->'$.properties' END AS kids,
  j->'$.required' AS req FROM roots),
tree AS (
  SELECT t.template_id, t.seq, t.style, 'schema[' || CAST(k.ord AS VARCHAR) || ']' AS place, '' AS up, k.def, k.name, k.name AS path, lower(trim(k.name)) AS norm_path, CAST(NULL AS VARCHAR) AS parent, CAST(k.ord AS INT) AS ord, CAST(0 AS INT) AS depth,
    lpad(CAST(k.ord AS VARCHAR), 3, '0') AS sort, k.req AS required, coalesce(k.def->>'$.type', CASE WHEN style = 'json' THEN 'string' END) AS type, true AS under_objects, true AS checked, coalesce(k.def->>'$.type', '') AS root_type, CAST(2 AS INT) AS indent
  FROM top t, LATERAL (SELECT row_number() OVER (ORDER BY e.id) - 1 AS ord, e.value AS def, CASE WHEN t.style = 'native' THEN e.value->>'$.name' ELSE e.key END AS name,
    CASE WHEN t.style = 'native' THEN (e.value->>'$.required') = 'true' ELSE list_contains(CAST(t.req AS VARCHAR[]), e.key) END AS req FROM json_each(t.kids) e) k
  UNION ALL
  SELECT t.template_id, t.seq, t.style, t.place || '.children[' || CAST(k.ord AS VARCHAR) || ']', t.place, k.def, k.name, t.path || '.' || k.name, t.norm_path || '.' || lower(trim(k.name)), t.path, CAST(k.ord AS INT), CAST(t.depth + 1 AS INT),
    t.sort || '.' || lpad(CAST(k.ord AS VARCHAR), 3, '0'), k.req, coalesce(k.def->>'$.type', CASE WHEN t.style = 'json' THEN 'string' END), t.under_objects AND coalesce(t.type, '') = 'object', t.checked AND coalesce(t.type, '') IN ('array', 'object'), t.root_type,
    CAST(t.indent + CASE WHEN t.type = 'array' THEN 4 ELSE 2 END AS INT)
  FROM tree t, LATERAL (SELECT row_number() OVER (ORDER BY e.id) - 1 AS ord, e.value AS def, CASE WHEN t.style = 'native' THEN e.value->>'$.name' ELSE e.key END AS name,
    CASE WHEN t.style = 'native' THEN (e.value->>'$.required') = 'true' ELSE list_contains(CAST(coalesce(t.def->'$.items.required', t.def->'$.required') AS VARCHAR[]), e.key) END AS req
    FROM json_each(CASE WHEN t.style = 'native' THEN coalesce(t.def->'$.children', '[]') ELSE coalesce(t.def->'$.items.properties', t.def->'$.properties', '{}') END) e) k),
f AS (SELECT *, def->>'$.format' AS format, def->>'$.description' AS description,
  CAST(CASE WHEN style = 'native' THEN coalesce(json_array_length(def->'$.children'), 0) ELSE len(json_keys(coalesce(def->'$.items.properties', def->'$.properties', '{}'))) END AS INT) AS n_children FROM tree)
"""
COLS = ["template_id", "path", "parent", "name", "type", "depth", "ord", "required", "format"]


def fields(t):
    return S.normalize_schemas(t.registry)


@query("d1_flatten_schemas", fx(f"{TREE} SELECT {', '.join(COLS)} FROM f"))
def flatten_schemas(t):
    return S.flatten_schemas(t.registry).select(*COLS)


@query("d3_normalize_schemas", fx(f"{TREE} SELECT template_id, style, path, type, required, description, n_children FROM f"))
def normalize_schemas(t):
    return fields(t).select("template_id", "style", "path", "type", "required", "description", "n_children")


@query("d2_validate_schemas", fx(f"""{TREE}, c AS (SELECT * FROM f WHERE style = 'native' AND checked)
SELECT template_id, place, 'name' AS rule FROM c WHERE trim(coalesce(name, '')) = ''
UNION ALL SELECT template_id, place, 'type' FROM c WHERE coalesce(type, '') NOT IN ('string', 'number', 'array', 'object', 'boolean', 'enum')
UNION ALL SELECT template_id, place, 'description' FROM c WHERE trim(coalesce(description, '')) = ''
UNION ALL SELECT template_id, place, 'values' FROM c WHERE type = 'enum' AND coalesce(json_array_length(def->'$.values'), 0) = 0
UNION ALL SELECT template_id, place, 'values_text' FROM c WHERE type = 'enum' AND CAST(def->'$.values' AS VARCHAR) LIKE '%1%'
UNION ALL SELECT template_id, place, 'children' FROM c WHERE type IN ('array', 'object') AND NOT json_exists(def, '$.children')
UNION ALL SELECT template_id, place, 'children_empty' FROM c WHERE type IN ('array', 'object') AND json_array_length(def->'$.children') = 0
UNION ALL SELECT template_id, 'schema', 'array' FROM registry WHERE nation % 4 <> 0"""))
def validate_schemas(t):
    return S.validate_schemas(fields(t), t.registry)


@query("d6_merge_schemas", fx(f"""{TREE}, n AS (SELECT f.*, nation FROM f JOIN registry USING (template_id) WHERE trim(name) <> '')
SELECT nation, norm_path, arg_min(path, (f.seq, sort)) AS path, arg_min(f.type, (f.seq, sort)) AS type, arg_min(description, (f.seq, sort)) FILTER (WHERE description <> '') AS description, count(*) AS n_sources
FROM (SELECT * FROM n) f GROUP BY nation, norm_path"""))
def merge_schemas(t):
    all_fields = fields(t).join(t.registry.select("template_id", "nation"), "template_id")
    return S.merge_schemas(all_fields, ["nation"]).select("nation", "norm_path", "path", "type", "description", "n_sources")


@query("d7_prune_schemas", fx(f"""{TREE} SELECT template_id, path FROM f WHERE coalesce(type, '') NOT IN ('array', 'object') OR EXISTS (
  SELECT 1 FROM f g WHERE g.template_id = f.template_id AND g.place LIKE replace(replace(f.place, '[', '['), '_', '\\_') || '.%' AND coalesce(g.type, '') NOT IN ('array', 'object'))"""))
def prune_schemas(t):
    return S.prune_schemas(fields(t)).select("template_id", "path")


@query("d8_total_fields", fx(f"{TREE} SELECT template_id, path FROM f WHERE under_objects AND type = 'number' AND regexp_matches(lower(name), 'total|amount') AND NOT contains(name, 'vat')"))
def total_fields(t):
    return S.total_fields(fields(t)).select("template_id", "path")


@query("d9_array_fields", fx(f"{TREE} SELECT template_id, path, n_children FROM f WHERE under_objects AND type = 'array' AND n_children > 0"))
def array_fields(t):
    return S.array_fields(fields(t)).select("template_id", "path", "n_children")


@query("d10_line_amount_spec", fx(f"""{TREE} SELECT template_id, path, CASE WHEN path = 'tags' OR path = 'scores' THEN NULL WHEN n_children = 5 OR style = 'json' THEN 'field' ELSE 'product' END AS kind,
  CASE WHEN path = 'line_items' AND n_children = 5 THEN 'net_amount' WHEN path = 'line_items' AND style = 'json' THEN 'price' END AS amount_column,
  CASE WHEN path = 'line_items' AND n_children = 3 THEN 'quantity' END AS qty_column, CASE WHEN path = 'line_items' AND n_children = 3 THEN 'unit_price' END AS price_column
FROM f WHERE type = 'array' AND n_children > 0 AND depth = 0"""))
def line_amount_spec(t):
    return S.line_amount_spec(fields(t))


@query("d11_date_fields", fx(f"""{TREE} SELECT template_id, path, CASE WHEN coalesce(format, '') <> '' THEN format ELSE 'DD' END AS hint FROM f
WHERE type = 'string' AND n_children = 0 AND (name IN ('issueDate', 'due-date', 'service_date') OR format IN ('MM/YYYY', 'DD.MM.YYYY'))"""))
def date_fields(t):
    return S.date_fields(fields(t), "DD.MM.YYYY").select("template_id", "path", "hint")


@query("d14_schema_outline", fx(f"""{TREE}, s AS (SELECT * FROM f WHERE coalesce(type, '') NOT IN ('array', 'object') OR n_children > 0),
l AS (SELECT template_id, sort AS k, repeat(' ', indent) || name || ': ' || CASE WHEN path = 'tags' THEN '[string]' WHEN type = 'array' THEN '[ {{' WHEN type = 'object' THEN '{{' WHEN type = 'enum' THEN 'string' ELSE type END AS text FROM s WHERE coalesce(parent, '') <> 'tags'
  UNION ALL SELECT template_id, sort || '.999', repeat(' ', indent) || CASE type WHEN 'array' THEN '}} ]' ELSE '}}' END FROM s WHERE type IN ('array', 'object') AND path <> 'tags')
SELECT template_id, string_agg(text, chr(10) ORDER BY k) AS outline FROM l GROUP BY template_id""".replace("{{", "{").replace("}}", "}")))
def schema_outline(t):
    return S.schema_outline(fields(t))


@query("d15_array_only", fx(f"{TREE} SELECT template_id, path FROM f WHERE root_type = 'array'"))
def array_only(t):
    return S.array_only(fields(t)).select("template_id", "path")


RECORD = """SELECT o_orderkey AS doc_id, '{{"invoice_number":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey AS STRING) ELSE '"N' || CAST(o_orderkey AS STRING) || '"' END ||
  ',"total":' || CASE WHEN o_orderkey % 3 = 0 THEN '"x"' WHEN o_orderkey % 3 = 1 THEN '0' ELSE '12.5' END || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',"status":"' || lower(o_orderstatus) || '"' END ||
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ',"rows":[{{"qty":1}},{{"qty":' || CASE WHEN o_orderkey % 7 = 0 THEN '"two"' ELSE '2' END || '}}],"codes":["a","b"]' END || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '}}' END AS record FROM {orders}"""


def records(t):
    return t.spark.sql(RECORD, orders=t.orders)


def record_schema():
    from pyspark.sql import types as T
    return T.StructType([
        T.StructField("invoice_number", T.StringType(), False), T.StructField("total", T.DoubleType()), T.StructField("status", T.StringType()),
        T.StructField("rows", T.ArrayType(T.StructType([T.StructField("qty", T.DoubleType()), T.StructField("unit", T.StringType(), False)]))),
        T.StructField("codes", T.ArrayType(T.StringType()))])


@query("d5_conform_violations", """
WITH o AS (SELECT o_orderkey AS k, lower(o_orderstatus) AS st, o_orderkey % 11 = 0 AS bad FROM orders)
SELECT k AS doc_id, '' AS path, 'unparsable' AS rule FROM o WHERE bad
UNION ALL SELECT k, 'invoice_number', 'required' FROM o WHERE NOT bad AND k % 5 = 0 UNION ALL SELECT k, 'invoice_number', 'type' FROM o WHERE NOT bad AND k % 5 = 1
UNION ALL SELECT k, 'total', 'type' FROM o WHERE NOT bad AND k % 3 = 0 UNION ALL SELECT k, 'status', 'enum' FROM o WHERE NOT bad AND k % 4 <> 0 AND st = 'p'
UNION ALL SELECT k, 'rows[].unit', 'required' FROM o WHERE NOT bad AND k % 6 <> 0 UNION ALL SELECT k, 'rows[].qty', 'type' FROM o WHERE NOT bad AND k % 6 <> 0 AND k % 7 = 0""")
def conform_violations(t):
    return S.conform(records(t), record_schema(), {"status": ["f", "o"]})[1]


@query("d5_conform_rows", """
WITH o AS (SELECT o_orderkey AS k, lower(o_orderstatus) AS st, o_orderkey % 11 <> 0 AS good FROM orders)
SELECT k AS doc_id, CASE WHEN good AND k % 3 = 1 THEN CAST(0 AS DOUBLE) WHEN good AND k % 3 = 2 THEN 12.5 END AS total, CASE WHEN good AND k % 4 <> 0 THEN st END AS status,
  CAST(CASE WHEN good AND k % 6 <> 0 THEN 2 ELSE 0 END AS INT) AS n_rows FROM o""")
def conform_rows(t):
    return S.conform(records(t), record_schema())[0].select("doc_id", "total", "status", F.size("rows").alias("n_rows"))


@query("d4_to_struct_type", """
SELECT o_orderkey AS doc_id, CASE WHEN bad THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 5 > 1 THEN 'N' || CAST(o_orderkey AS VARCHAR) END AS invoice_number,
  CASE WHEN NOT bad AND o_orderkey % 4 <> 0 THEN lower(o_orderstatus) END AS status, CAST(0 AS INT) AS n_items FROM (SELECT *, o_orderkey % 11 = 0 AS bad FROM orders)""")
def to_struct_type(t):
    """A native template's schema, read back from the registry and applied to every record."""
    all_fields = S.prune_schemas(fields(t).where("type IN ('string', 'number', 'array', 'object', 'boolean', 'enum')"))
    native = t.registry.where("nation % 4 = 0 AND seq % 2 = 0").orderBy("seq").first().template_id
    kind = S.to_struct_type(all_fields, native)
    rows = S.conform(records(t), kind)[0]
    return rows.select("doc_id", "invoice_number", "status", F.size("line_items").alias("n_items"))


@query("d5_conform_values", """
WITH o AS (SELECT o_orderkey AS k, lower(o_orderstatus) AS st, o_orderkey % 11 <> 0 AS good FROM orders)
SELECT k AS doc_id, CASE WHEN good AND k % 5 = 1 THEN CAST(k AS VARCHAR) WHEN good AND k % 5 > 1 THEN 'N' || CAST(k AS VARCHAR) END AS invoice_number,
  CASE WHEN good AND k % 3 = 1 THEN CAST(0 AS DOUBLE) WHEN good AND k % 3 = 2 THEN 12.5 END AS total, CASE WHEN good AND k % 4 <> 0 THEN st END AS status,
  CASE WHEN NOT good OR k % 6 = 0 THEN '' ELSE '1.0,-;' || CASE WHEN k % 7 = 0 THEN '-' ELSE '2.0' END || ',-' END AS rows, CASE WHEN good AND k % 6 <> 0 THEN 'a|b' ELSE '' END AS codes FROM o""")
def conform_values(t):
    """Every column of every record, with the fields of nested rows; a value of another type is null and leaves its neighbours."""
    rows = S.conform(records(t), record_schema())[0]
    cell = lambda x: F.concat_ws(",", *[F.coalesce(x[c].cast("string"), F.lit("-")) for c in ("qty", "unit")])
    return rows.select("doc_id", "invoice_number", "total", "status", F.array_join(F.transform("rows", cell), ";").alias("rows"), F.array_join("codes", "|").alias("codes"))


LINES_A = "line_items:array<struct<service_date:string,quantity:double,unit_price:double,line_total:double,net_amount:double>>"


@query("d4_struct_types", fx(f"""
WITH c AS (SELECT min(seq) AS k, nation % 4 AS spelling FROM registry WHERE nation % 4 > 1 OR seq % 4 <> 1 GROUP BY nation % 4, seq % 2),
n AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0)
SELECT 'r' || CAST(k AS VARCHAR) AS template_id, CASE spelling WHEN 2 THEN 'struct<{LINES_A}>'
  WHEN 3 THEN 'struct<invoice_number:string,total_amount:double,untyped:string,supplier:struct<name:string,grand_total:double>,line_items:array<struct<qty:double,price:double>>>'
  ELSE 'struct<' || CASE WHEN k % 2 = 0 THEN 'invoice_number' ELSE 'Invoice_Number ' END || ':string,' || CASE k % 3 WHEN 0 THEN 'issueDate' WHEN 1 THEN 'due-date' ELSE 'period' END ||
    ':string,total_amount:double,supplier:struct<name:string,vat_total:double,Grand_Total:double>,' ||
    CASE WHEN k % 2 = 0 THEN '{LINES_A}' ELSE 'line_items:array<struct<quantity:double,unit_price:double,note:string>>' END || ',status:string' ||
    CASE WHEN k % 4 = 0 THEN '' ELSE ',tags:array<string>' END || '>' END AS type,
  CASE WHEN spelling = 3 OR (spelling < 2 AND k % 2 = 0) THEN 'invoice_number' ELSE '' END AS required,
  CASE WHEN spelling = 3 OR (spelling < 2 AND k % 2 = 0) THEN n ELSE 0 END AS n_numbers FROM c, n"""))
def struct_types(t):
    """Spark types of valid templates of every spelling, two of each, and how many records have a readable number under each of them."""
    invalid = S.validate_schemas(fields(t)).where("rule = 'type'").select("template_id")
    valid = t.registry.join(invalid.distinct(), "template_id", "left_anti")
    chosen = [r.template_id for r in valid.groupBy(F.col("nation") % 4, F.col("seq") % 2).agg(F.min_by("template_id", "seq").alias("template_id")).collect()]
    # walked and stored once, then read for each template
    own = stored(S.prune_schemas(S.normalize_schemas(t.registry.where(F.col("template_id").isin(chosen)))), "chosen-fields")
    out = []
    for template in chosen:
        kind = S.to_struct_type(own, template)
        number = F.col("invoice_number") if "invoice_number" in kind.names else F.lit(None)
        out.append(S.conform(records(t), kind)[0].agg(F.count(number).alias("n_numbers")).select(
            F.lit(template).alias("template_id"), F.lit(kind.simpleString()).alias("type"), F.lit(",".join(f.name for f in kind if not f.nullable)).alias("required"), "n_numbers"))
    return reduce(DataFrame.unionByName, out)


@query("d13_infer_schema", """
SELECT source, path, type, CASE path WHEN 'codes' THEN 'string' END AS item_type FROM (SELECT DISTINCT o_orderpriority AS source FROM orders),
  (SELECT unnest(['invoice_number', 'total', 'status', 'rows', 'rows.qty', 'codes']) AS path, unnest(['string', 'number', 'string', 'array', 'number', 'array']) AS type)""")
def infer_schema(t):
    data = records(t).join(t.orders.selectExpr("o_orderkey AS doc_id", "o_orderpriority AS source"), "doc_id")
    # numbers before texts, so that the first type seen is the same in every source
    seq = F.when(F.col("record").rlike('"total":[0-9]') & F.col("record").rlike('"invoice_number":"'), F.when(F.col("record").contains('"two"'), 1).otherwise(0)).otherwise(2)
    return S.infer_schema(data.select("source", seq.alias("seq"), "record")).select("source", "path", "type", "item_type")


@query("d13_first_type", """
WITH o AS (SELECT o_orderpriority AS source, o_orderkey AS k, o_orderkey % 4 AS m, CASE WHEN o_orderkey % 9 = 0 THEN 'b' ELSE 'a' END AS spelled FROM orders),
v AS (
  SELECT source, k, 'value' AS path, CASE m WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'boolean' END AS type, NULL AS item FROM o
  UNION ALL SELECT source, k, 'list', CASE WHEN m <> 3 THEN 'array' END, CASE m WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' END FROM o
  UNION ALL SELECT source, k, 'list.' || spelled, CASE WHEN m = 2 THEN 'number' END, NULL FROM o WHERE m = 2),
f AS (SELECT source, path, min_by(type, k) FILTER (WHERE type IS NOT NULL) AS type, min_by(item, k) FILTER (WHERE item IS NOT NULL) AS item, count(*) AS n_records FROM v GROUP BY source, path)
SELECT source, path, type, CASE WHEN type = 'array' THEN item END AS item_type, CAST(n_records AS BIGINT) AS n_records FROM f WHERE type IS NOT NULL""")
def first_type(t):
    """The type of a field, of the elements of a list and of a field below them changes from record to record; the first one seen stays."""
    record = F.expr("""CASE o_orderkey % 4
      WHEN 0 THEN concat('{"value":', o_orderkey, '.5,"list":[null,1,"x"]}') WHEN 1 THEN '{"value":"v","list":[true]}'
      WHEN 2 THEN concat('{"list":[{"', CASE WHEN o_orderkey % 9 = 0 THEN 'b' ELSE 'a' END, '":', o_orderkey, '},{}],"value":false}') ELSE '{"value":null,"list":null}' END""")
    data = t.orders.select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("seq"), record.alias("record"))
    return S.infer_schema(data).select("source", "path", "type", "item_type", "n_records")
