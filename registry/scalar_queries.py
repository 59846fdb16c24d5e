"""Scalar functions over columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelrow import fixed_values as fv
from keelrow.functions import defaults, names, references, text, types
from registry.star import table

# Texts that table rows are paired with, by key.
TYPE_NAMES = (
    "text", "varchar", "varchar(255)", "character varying", "integer", "int", "int4", "bigint", "int8",
    "smallint", "int2", "numeric", "numeric(10,2)", "decimal", "boolean", "bool", "date", "timestamp",
    "timestamp without time zone", "timestamp with time zone", "timestamptz", "serial", "bigserial",
    "uuid", "jsonb", "money", "TEXT", " integer", "text[]", "point",
)
DEFAULT_TEXTS = (
    "now()", "NOW()", "current_timestamp", "CURRENT_TIMESTAMP", "current_timestamp()", "'active'::text",
    "'active'", "active", "'draft'", "draft", '"draft"', "true", "TRUE", "1", "yes", "false", "0", "no",
    "0::integer", "3.5", "it's", "uuid_generate_v4()", "CURRENT_DATE", "pending", " spaced ", "''",
)
SOURCE_TYPES = (
    "int", "int32", "int64", "string", "bool", "float32", "float64", "time.Time", "uuid.UUID", "[]string",
    "*time.Time", "*uuid.UUID", "map[string]int", "uint8",
)
ACTION_TEXTS = ("CASCADE", "cascade", " set null ", "SET NULL", "Set Default", "RESTRICT", "NO ACTION", "", "DESTROY")


def pick(values, key):
    """The value that a key selects from a list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_pick(values, key: str) -> str:
    return f"[{', '.join(sql_text(v) for v in values)}][CAST(({key}) % {len(values)} + 1 AS INTEGER)]"


def _camel(c):
    c = F.col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2), F.length(c))))


_NAME_SQL = """SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) || upper(p_name[1]) || p_name[2:] || CASE WHEN p_size > 25 THEN 'ID' ELSE 'Way' END AS s FROM part"""


def _part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(
        _camel("p_type"), F.upper(F.substring("p_name", 1, 1)), F.substr("p_name", F.lit(2), F.length("p_name")),
        F.when(F.col("p_size") > 25, F.lit("ID")).otherwise(F.lit("Way")),
    ).alias("s"))


def snake_case(spark, sf_dir):
    s = F.col("s")
    return _part_names(spark, sf_dir).select("p_partkey", "s", names.snake_case(s).alias("snake"))


def pluralize(spark, sf_dir):
    s = F.col("s")
    return _part_names(spark, sf_dir).select(
        "p_partkey", names.pluralize(s).alias("plural"), names.table_name_of(s).alias("table_name")
    )


_SNAKE = "lower(regexp_replace(s, '([a-z])([A-Z])', '\\1_\\2', 'g'))"


def _plural_sql(s: str) -> str:
    return f"CASE WHEN {s} LIKE '%y' THEN {s}[:-2] || 'ies' WHEN {s} LIKE '%s' THEN {s} ELSE {s} || 's' END"


def valid_identifier(spark, sf_dir):
    """Names of customers, parts and documents, and the words of a few reserved ones."""
    found = (
        table(spark, sf_dir, "customer").select(F.col("c_name").alias("s"))
        .unionByName(table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("s")))
        .unionByName(table(spark, sf_dir, "documents").select(F.col("text").alias("s")))
        .unionByName(table(spark, sf_dir, "orders").select(F.substr("o_orderpriority", F.lit(3), F.length("o_orderpriority")).alias("s")))
        .unionByName(table(spark, sf_dir, "events").select(
            F.when(F.col("event_type") == "view", F.upper("event_type"))
            .when(F.col("event_type") == "click", F.lit("")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit("x")))
            .alias("s")))
    )
    s = F.col("s")
    return found.groupBy("s").agg(F.count(F.lit(1)).alias("n")).select(
        F.sha2(s, 256).alias("hash"), "n", names.valid_identifier(s).alias("valid"),
        names.valid_identifier(s, strict=True).alias("strict"), names.is_reserved(s).alias("reserved"),
        F.sha2(names.identifier_error(s, "table"), 256).alias("error"),
    )


_IDENTIFIER_SQL = """
WITH a AS (SELECT c_name AS s FROM customer UNION ALL SELECT replace(p_name, ' ', '_') FROM part
           UNION ALL SELECT text FROM documents UNION ALL SELECT o_orderpriority[3:] FROM orders
           UNION ALL SELECT CASE WHEN event_type = 'view' THEN 'VIEW' WHEN event_type = 'click' THEN ''
                                 ELSE CAST(user_id AS VARCHAR) || 'x' END FROM events),
g AS (SELECT s, count(*) AS n FROM a GROUP BY s)
SELECT sha256(s) AS hash, n, regexp_full_match(s, '[A-Za-z0-9_]{1,63}') AS valid,
       regexp_full_match(s, '[A-Za-z_][A-Za-z0-9_]{0,62}') AS strict,
       lower(s) IN ('user', 'order', 'group', 'table', 'index', 'view', 'schema') AS reserved,
       sha256(CASE WHEN s = '' THEN 'table name cannot be empty'
            WHEN strlen(s) > 63 THEN 'table name ''' || s || ''' is too long (max 63 characters)'
            WHEN NOT regexp_full_match(s, '[A-Za-z0-9_]*')
              THEN 'table name ''' || s || ''' contains invalid character ''' || regexp_extract(s, '[^A-Za-z0-9_]') || ''''
            WHEN lower(s) IN ('user', 'order', 'group', 'table', 'index', 'view', 'schema')
              THEN 'table name ''' || s || ''' is a reserved keyword' END) AS error
FROM g
"""


def type_change(spark, sf_dir):
    """Pairs of type names, chosen by the keys of each order."""
    old, new = pick(TYPE_NAMES, F.col("o_orderkey")), pick(TYPE_NAMES, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", old.alias("old"), new.alias("new")).select(
        "o_orderkey", "old", "new", types.base_type(F.col("old")).alias("old_base"),
        types.is_compatible_type(F.col("old"), F.col("new")).alias("compatible"),
        types.is_significant_type_change(F.col("old"), F.col("new")).alias("significant"),
        types.supported_type(F.col("old")).alias("supported"),
        types.supported_type(F.col("old"), exact=True).alias("supported_exactly"),
    )


def base_sql(t: str) -> str:
    return f"split_part(lower(trim({t})), '(', 1)"


def compatible_sql(old: str, new: str) -> str:
    pairs = [(a, b) for g in fv.TYPE_ALIAS_GROUPS for a in g for b in g if a != b]
    pairs += [(a, b) for a, bs in fv.ONE_WAY_ALIASES for b in bs]
    listed = ", ".join(f"{sql_text(a + '>' + b)}" for a, b in pairs)
    return f"({base_sql(old)} = {base_sql(new)} OR {base_sql(old)} || '>' || {base_sql(new)} IN ({listed}))"


def significant_sql(old: str, new: str) -> str:
    def cls(t):
        arms = " ".join(
            f"WHEN {base_sql(t)} IN ({', '.join(sql_text(n) for n in ns)}) THEN {sql_text(c)}"
            for c, ns in fv.TYPE_CHANGE_CLASSES
        )
        return f"CASE {arms} END"
    return f"coalesce({cls(old)} <> {cls(new)}, false)"


_SUPPORTED = ", ".join(sql_text(t) for t in fv.SUPPORTED_TYPES)


def normalize_default(spark, sf_dir):
    a, b = pick(DEFAULT_TEXTS, F.col("o_orderkey")), pick(DEFAULT_TEXTS, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b")).select(
        "o_orderkey", "a", "b", defaults.normalize_default(F.col("a")).alias("normal"),
        defaults.default_equivalent(F.col("a"), F.col("b")).alias("equivalent"),
        defaults.same_default(F.col("a"), F.col("b")).alias("same"),
    )


def normal_sql(x: str) -> str:
    t, p = f"trim({x})", f"split_part(lower(trim({x})), '::', 1)"
    return (
        f"CASE WHEN ({t} LIKE '''%' AND {t} LIKE '%''') OR ({t} LIKE '\"%' AND {t} LIKE '%\"') THEN trim({t}, '''\"') "
        f"ELSE regexp_replace(CASE WHEN {p} LIKE '''%' AND {p} LIKE '%''' THEN trim({p}, '''') ELSE {p} END, "
        f"'current_timestamp(\\(\\))?', 'now()', 'g') END"
    )


def equivalent_sql(a: str, b: str) -> str:
    pairs = [(k, v) for k, vs in fv.EQUIVALENT_DEFAULTS for v in vs]
    listed = ", ".join(sql_text(p) for k, v in pairs for p in (f"{k}|{v}", f"{v}|{k}"))
    x, y = f"lower(trim({a}))", f"lower(trim({b}))"
    return f"({x} = {y} OR {x} || '|' || {y} IN ({listed}))"


def same_default_sql(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN {a} IS NULL AND {b} IS NULL "
        f"ELSE {equivalent_sql('(' + normal_sql(a) + ')', '(' + normal_sql(b) + ')')} END"
    )


def format_default(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("d"))
    orders = table(spark, sf_dir, "orders").select(pick(DEFAULT_TEXTS, F.col("o_orderkey")).alias("d"))
    return docs.unionByName(orders).groupBy("d").agg(F.count(F.lit(1)).alias("n")).select(
        "d", "n", defaults.format_default(F.col("d")).alias("formatted")
    )


def valid_default(spark, sf_dir):
    t, d = pick(TYPE_NAMES, F.col("o_orderkey")), pick(DEFAULT_TEXTS, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"), d.alias("d")).select(
        "o_orderkey", "t", "d", defaults.default_error(F.col("t"), F.col("d")).alias("error")
    )


def default_error_sql(t: str, d: str) -> str:
    return f"""CASE
  WHEN lower({t}) LIKE '%int%' OR lower({t}) LIKE '%serial%' THEN
    CASE WHEN NOT contains({d}, '(') AND NOT contains({d}, '''') AND contains({d}, '.')
         THEN 'integer type cannot have decimal default value ''' || {d} || '''' END
  WHEN lower({t}) LIKE '%char%' OR lower({t}) = 'text' THEN
    CASE WHEN NOT contains({d}, '(') AND NOT starts_with({d}, '''') AND NOT starts_with({d}, '"')
         THEN 'string type should have quoted default value ''' || {d} || '''' END
  WHEN lower({t}) IN ('boolean', 'bool') THEN
    CASE WHEN {d} NOT IN ('true', 'false', 'TRUE', 'FALSE')
         THEN 'boolean type should have true/false default value, got ''' || {d} || '''' END END"""


def fk_action(spark, sf_dir):
    a = pick(ACTION_TEXTS, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a")).select(
        "o_orderkey", references.normalize_fk_action(F.col("a")).alias("normal"),
        references.valid_fk_action(F.col("a")).alias("valid"),
    )


def infer_type(spark, sf_dir):
    t = pick(SOURCE_TYPES, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", types.infer_type(t).alias("type"))


def checksum(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.checksum(F.col("text")).alias("checksum"),
        text.short_checksum(text.checksum(F.col("text"))).alias("shown"),
    )


def truncate_cell(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.truncate_cell(F.col("text")).alias("cell"), text.truncate_name(F.col("source")).alias("source"),
        text.truncate_name(F.concat("source", F.lit("_"), "text")).alias("name"),
    )


def escape_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.escape_csv(F.col("text")).alias("csv"), text.escape_sql(F.col("text")).alias("sql")
    )


def conforms(spark, sf_dir):
    """Values of several columns tried against several types."""
    parts = table(spark, sf_dir, "part")
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    flag = F.when(F.col("p_size") > 25, F.lit("true")).otherwise(F.col("p_type"))
    price = F.col("p_retailprice").cast("string")
    return parts.select(
        "p_partkey", types.conforms(number, "integer").alias("number_is_integer"),
        types.conforms(price, "integer").alias("price_is_integer"),
        types.conforms(price, "numeric(5,2)").alias("price_is_numeric"),
        types.conforms(flag, "boolean").alias("flag_is_boolean"),
        types.conforms(F.col("p_name"), "varchar(9)").alias("name_is_short"),
        types.conforms(F.col("p_name"), "date").alias("name_is_date"),
    )


QUERIES = {
    f.__name__: f for f in (
        snake_case, pluralize, valid_identifier, type_change, normalize_default, format_default, valid_default,
        fk_action, infer_type, checksum, truncate_cell, escape_text, conforms,
    )
}

_PAIR = "SELECT o_orderkey, {a} AS {x}, {b} AS {y} FROM orders"

ORACLES = {
    "snake_case": f"SELECT p_partkey, s, {_SNAKE} AS snake FROM ({_NAME_SQL})",
    "pluralize": f"""SELECT p_partkey, {_plural_sql('s')} AS plural, {_plural_sql('n')} AS table_name
                     FROM (SELECT *, {_SNAKE} AS n FROM ({_NAME_SQL}))""",
    "valid_identifier": _IDENTIFIER_SQL,
    "type_change": f"""
        SELECT o_orderkey, old, new, {base_sql('old')} AS old_base, {compatible_sql('old', 'new')} AS compatible,
               {significant_sql('old', 'new')} AS significant,
               regexp_replace(lower(trim(old)), '\\(.*\\)', '') IN ({_SUPPORTED}) AS supported,
               lower(old) IN ({_SUPPORTED}) AS supported_exactly
        FROM ({_PAIR.format(a=sql_pick(TYPE_NAMES, 'o_orderkey'), x='old', b=sql_pick(TYPE_NAMES, 'o_custkey'), y='new')})""",
    "normalize_default": f"""
        SELECT o_orderkey, a, b, {normal_sql('a')} AS normal, {equivalent_sql('a', 'b')} AS equivalent,
               {same_default_sql('a', 'b')} AS same
        FROM ({_PAIR.format(a=sql_pick(DEFAULT_TEXTS, 'o_orderkey'), x='a', b=sql_pick(DEFAULT_TEXTS, 'o_custkey'), y='b')})""",
    "format_default": f"""
        SELECT d, count(*) AS n, CASE WHEN (d LIKE '''%' AND d LIKE '%''') OR (contains(d, '(') AND contains(d, ')'))
               OR d IN ('true', 'false') OR (regexp_matches(d, '[0-9]') AND NOT regexp_matches(d, '[A-Za-z]'))
               THEN d ELSE '''' || replace(d, '''', '''''') || '''' END AS formatted
        FROM (SELECT text AS d FROM documents UNION ALL SELECT {sql_pick(DEFAULT_TEXTS, 'o_orderkey')} FROM orders) GROUP BY d""",
    "valid_default": f"""
        SELECT o_orderkey, t, d, {default_error_sql('t', 'd')} AS error
        FROM ({_PAIR.format(a=sql_pick(TYPE_NAMES, 'o_orderkey'), x='t', b=sql_pick(DEFAULT_TEXTS, 'o_custkey'), y='d')})""",
    "fk_action": f"""
        SELECT o_orderkey, coalesce(nullif(upper(trim(a)), ''), 'NO ACTION') AS normal,
               upper(a) IN ('CASCADE', 'SET NULL', 'SET DEFAULT', 'RESTRICT', 'NO ACTION') AS valid
        FROM (SELECT o_orderkey, {sql_pick(ACTION_TEXTS, 'o_orderkey')} AS a FROM orders)""",
    "infer_type": f"""
        SELECT event_id, CASE WHEN t IN ('int', 'int32') THEN 'integer' WHEN t = 'int64' THEN 'bigint'
               WHEN t = 'bool' THEN 'boolean' WHEN t IN ('float32', 'float64') THEN 'numeric'
               WHEN t LIKE '[]%' THEN 'jsonb' WHEN contains(t, 'time.Time') THEN 'timestamp'
               WHEN contains(t, 'uuid.UUID') THEN 'uuid' ELSE 'text' END AS type
        FROM (SELECT event_id, {sql_pick(SOURCE_TYPES, 'event_id')} AS t FROM events)""",
    "checksum": "SELECT doc_id, sha256(text) AS checksum, sha256(text)[1:8] || '...' AS shown FROM documents",
    "truncate_cell": """
        SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS cell,
               CASE WHEN length(source) > 23 THEN substr(source, 1, 20) || '...' ELSE source END AS source,
               CASE WHEN length(source || '_' || text) > 23 THEN substr(source || '_' || text, 1, 20) || '...'
                    ELSE source || '_' || text END AS name FROM documents""",
    "escape_text": """
        SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS csv,
               replace(text, '''', '''''') AS sql FROM documents""",
    "conforms": """
        SELECT p_partkey, true AS number_is_integer, p_retailprice = floor(p_retailprice) AS price_is_integer,
               true AS price_is_numeric, p_size > 25 AS flag_is_boolean, length(p_name) <= 9 AS name_is_short,
               false AS name_is_date FROM part""",
}
