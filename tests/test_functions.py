"""Scalar expressions on literal values."""

import pytest
from pyspark.sql import functions as F

from keelrow import fixed_values as fv
from keelrow.contract import spark_type, type_parts
from keelrow.functions import defaults, names, references, text, types


def results(spark, values, *expressions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *[e(F.col("s")) for e in expressions]).orderBy("i").collect()]


def one(spark, values, expression):
    return [r[0] for r in results(spark, values, expression)]


def test_snake_case_and_plural(spark):
    assert one(spark, ["UserID", "PostTag", "user", "HTTPServer", "aB1C", ""], names.snake_case) == [
        "user_id", "post_tag", "user", "httpserver", "a_b1c", ""]
    assert one(spark, ["Category", "Status", "PostTag", "y"], names.table_name_of) == [
        "categories", "status", "post_tags", "ies"]


@pytest.mark.parametrize("name, error", [
    ("", "table name cannot be empty"),
    ("a" * 63, None),
    ("a" * 64, f"table name '{'a' * 64}' is too long (max 63 characters)"),
    ("é" * 32, f"table name '{'é' * 32}' is too long (max 63 characters)"),
    ("two words", "table name 'two words' contains invalid character ' '"),
    ("a-b", "table name 'a-b' contains invalid character '-'"),
    ("Order", "table name 'Order' is a reserved keyword"),
    ("1st", None),
])
def test_table_names(spark, name, error):
    assert one(spark, [name], lambda s: names.identifier_error(s, "table")) == [error]


def test_valid_identifier(spark):
    values = ["a", "1a", "", "a" * 64, "a b", "a\n", "Order"]
    assert results(spark, values, names.valid_identifier, lambda s: names.valid_identifier(s, strict=True)) == [
        (True, True), (True, False), (False, False), (False, False), (False, False), (False, False), (True, True)]


def brute_compatible(old, new):
    def base(t):
        return t.strip().lower().split("(")[0]
    a, b = base(old), base(new)
    if a == b or any(a in g and b in g for g in fv.TYPE_ALIAS_GROUPS):
        return True
    return b in dict(fv.ONE_WAY_ALIASES).get(a, ())


def test_types_over_all_pairs(spark):
    names_ = sorted({t for g in fv.TYPE_ALIAS_GROUPS for t in g} | set(fv.SUPPORTED_TYPES) | {
        "varchar(20)", "numeric(10,2)", " TEXT ", "timestamp(3)"})
    pairs = [(a, b) for a in names_ for b in names_]
    df = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", types.is_compatible_type(F.col("a"), F.col("b")).alias("c"),
        types.is_significant_type_change(F.col("a"), F.col("b")).alias("s"))
    classes = {n: c for c, ns in fv.TYPE_CHANGE_CLASSES for n in ns}
    for r in df.collect():
        assert r.c == brute_compatible(r.a, r.b), (r.a, r.b)
        x, y = (classes.get(t.strip().lower().split("(")[0]) for t in (r.a, r.b))
        assert r.s == (x is not None and y is not None and x != y), (r.a, r.b)


def test_compatibility_is_not_symmetric(spark):
    df = spark.createDataFrame([("serial", "integer"), ("integer", "serial"), ("timestamptz", "timestamp"),
                                ("timestamp", "timestamptz")], "a string, b string")
    assert [r[0] for r in df.select(types.is_compatible_type(F.col("a"), F.col("b"))).collect()] == [
        True, False, True, False]


def test_supported_types(spark):
    values = ["integer", "numeric(10,2)", "VARCHAR(5)", "money", "timestamp(3) with time zone", ""]
    assert results(spark, values, types.supported_type, lambda s: types.supported_type(s, exact=True)) == [
        (True, True), (True, False), (True, False), (False, False), (True, False), (False, False)]


def test_infer_type(spark):
    assert one(spark, ["int", "int64", "string", "float64", "[]byte", "*time.Time", "sql.NullString"], types.infer_type) == [
        "integer", "bigint", "text", "numeric", "jsonb", "timestamp", "text"]


def test_normalize_default(spark):
    values = ["'Active'", '"x"', "NOW()", "CURRENT_TIMESTAMP", "current_timestamp()", "'a'::text", "0::integer",
              " TRUE ", "''", "\tnow()\n"]
    assert one(spark, values, defaults.normalize_default) == [
        "Active", "x", "now()", "now()", "now()", "a", "0", "true", "", "now()"]


def test_default_equivalence(spark):
    pairs = [("now()", "current_timestamp", True), ("true", "1", True), ("1", "yes", False), ("no", "false", True),
             ("active", "'active'", True), ("a", "b", False), ("A", "a", True)]
    df = spark.createDataFrame(pairs, "a string, b string, e boolean")
    assert df.filter(defaults.default_equivalent(F.col("a"), F.col("b")) != F.col("e")).count() == 0
    nulls = spark.createDataFrame([(None, None), ("x", None), (None, "x")], "a string, b string")
    assert [r[0] for r in nulls.select(defaults.same_default(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_format_default(spark):
    assert one(spark, ["'x'", "now()", "true", "42", "3.5", "it's", "a1", "", "-"], defaults.format_default) == [
        "'x'", "now()", "true", "42", "3.5", "'it''s'", "'a1'", "''", "'-'"]


def test_default_values(spark):
    row = spark.range(1).select(
        defaults.default_value("'it''s'", "text").alias("a"), defaults.default_value("7", "integer").alias("b"),
        defaults.default_value("true", "boolean").alias("c"), defaults.default_value(None, "date").alias("d"),
        defaults.default_value("now()", "timestamp").alias("e"), defaults.default_value("CURRENT_DATE", "date").alias("f"),
        defaults.default_value("gen_random_uuid()", "uuid").alias("g"), defaults.default_value("0", "numeric(6,2)").alias("h"),
        defaults.default_value("active", "text").alias("i"),
    ).first()
    assert (row.a, row.b, row.c, row.d, str(row.h), row.i) == ("it's", 7, True, None, "0.00", "active")
    assert row.e is not None and row.f is not None and len(row.g) == 36
    with pytest.raises(ValueError):
        defaults.default_value("nextval('s')", "integer")


def test_uuid_defaults_differ_by_row(spark):
    rows = spark.range(50).select(defaults.default_value("uuid_generate_v4()", "uuid").alias("u"))
    assert rows.distinct().count() == 50


def test_foreign_key_errors(spark):
    rows = [("t", "c", "", "id", "", ""), ("t", "c", "u", "", "", ""), ("t", "c", "t", "c", "", ""),
            ("t", "c", "u", "id", "cascade", "set null"), ("t", "c", "u", "id", "DESTROY", ""),
            ("t", "c", "u", "id", "", "EXPLODE"), ("t", "c", "u", "id", None, None)]
    df = spark.createDataFrame(rows, "t string, c string, rt string, rc string, d string, u string")
    got = [r[0] for r in df.select(references.foreign_key_error(*[F.col(c) for c in df.columns])).collect()]
    assert got[0].endswith("table cannot be empty") and got[1].endswith("column cannot be empty")
    assert got[2] == "foreign key cannot reference itself" and got[3] is None
    assert got[4].startswith("invalid onDelete action 'DESTROY'") and got[5].startswith("invalid onUpdate action 'EXPLODE'")
    assert got[6] is None


HARD = ["NULL", "", None, "it's", "a,b", "say \"hi\"", "line\nbreak", "cr\r\nlf", "back\\slash", "\\n stays\nnew",
        "E'x'", "); INSERT INTO t (\"a\") VALUES ('x", "', '", "''''", "\\x5C\n", "ends\\\n", "tab\tü漢"]


def test_literals_round_trip(spark):
    literal = spark.createDataFrame([(i, v) for i, v in enumerate(HARD)], "i int, s string").select(
        "i", "s", text.render_literal(F.col("s"), spark_type("text")).alias("l"))
    rows = literal.select("s", "l", text.read_literal(F.col("l")).alias("back")).orderBy("i").collect()
    for r in rows:
        assert r.back == r.s and "\n" not in r.l and "\r" not in r.l


def test_script_sections(spark):
    script = "-- Up Migration\n\u00a0 CREATE x;\n-- Down Migration (Rollback)\n-- =======================\n DROP x; \n"
    values = [script, "-- Up Migration\nx", "x\n-- Down Migration (Rollback)\n-- =======================\ny",
              "-- Up Migration\nx\n-- Down Migration (Rollback)\ny"]
    assert results(spark, values, text.script_up, text.script_down, text.script_error)[0] == ("CREATE x;", "DROP x;", None)
    assert one(spark, values, text.script_error)[1:] == [
        "does not contain rollback section", "does not contain up migration section",
        "does not contain valid rollback section"]


@pytest.mark.parametrize("pg, good, bad", [
    ("integer", ["1", "-5", "3.0", " 7 "], ["1.5", "x", "", "99999999999"]),
    ("numeric(4,1)", ["999.9", "1", "-0.05"], ["1000", "x"]),
    ("boolean", ["true", "false"], ["maybe"]),
    ("date", ["2024-02-29"], ["2023-02-29", "soon"]),
    ("uuid", ["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]),
    ("jsonb", ["{\"a\": 1}", "[]"], ["{a"]),
    ("varchar(3)", ["abc", ""], ["abcd"]),
    ("time", ["23:59", "01:02:03.5"], ["24:00"]),
    ("inet", ["10.0.0.1", "10.0.0.0/8", "::1"], ["10.0.0.256", "x"]),
    ("integer[]", ["[1,2]"], ["{1"]),
    ("bytea", ["\\x00ff", "00FF"], ["zz"]),
])
def test_conforms(spark, pg, good, bad):
    assert one(spark, good, lambda s: types.conforms(s, pg)) == [True] * len(good)
    assert one(spark, bad, lambda s: types.conforms(s, pg)) == [False] * len(bad)
    assert one(spark, [None], lambda s: types.conforms(s, pg)) == [True]


def test_type_parts_and_spark_types():
    assert type_parts("NUMERIC(10, 2)") == ("numeric", 10, 2)
    assert type_parts("timestamp(3) with time zone") == ("timestamp with time zone", 3, None)
    assert spark_type("varchar(255)").simpleString() == "string"
    assert spark_type("numeric").simpleString() == "decimal(38,10)"
    for t in fv.SUPPORTED_TYPES:
        if t in fv.GEOMETRIC_TYPES + fv.TEXT_SEARCH_TYPES:
            with pytest.raises(ValueError):
                spark_type(t)
        else:
            spark_type(t)
