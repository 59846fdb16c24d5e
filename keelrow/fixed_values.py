"""Names, lists and formats that results must agree on.

Everything here is data.  The rules that use it live in ``keelrow.functions``
and ``keelrow.operators``.
"""

# Accepted column types, by family.
INTEGER_TYPES = ("smallint", "integer", "bigint")
DECIMAL_TYPES = ("decimal", "numeric")
FLOAT_TYPES = ("real", "double precision")
SERIAL_TYPES = ("smallserial", "serial", "bigserial")
CHARACTER_TYPES = ("varchar", "character varying", "char", "character", "text")
BINARY_TYPES = ("bytea",)
TIME_TYPES = (
    "timestamp", "timestamp with time zone", "timestamptz", "date",
    "time", "time with time zone", "timetz", "interval",
)
BOOLEAN_TYPES = ("boolean", "bool")
JSON_TYPES = ("json", "jsonb")
UUID_TYPES = ("uuid",)
GEOMETRIC_TYPES = ("point", "line", "lseg", "box", "path", "polygon", "circle")
NETWORK_TYPES = ("cidr", "inet", "macaddr", "macaddr8")
BIT_TYPES = ("bit", "bit varying")
TEXT_SEARCH_TYPES = ("tsvector", "tsquery")
ARRAY_TYPES = ("integer[]", "text[]", "varchar[]")

SUPPORTED_TYPES = (
    INTEGER_TYPES + DECIMAL_TYPES + FLOAT_TYPES + SERIAL_TYPES + CHARACTER_TYPES
    + BINARY_TYPES + TIME_TYPES + BOOLEAN_TYPES + JSON_TYPES + UUID_TYPES
    + GEOMETRIC_TYPES + NETWORK_TYPES + BIT_TYPES + TEXT_SEARCH_TYPES + ARRAY_TYPES
)

# Names of one type that count as the same type in both directions.
TYPE_ALIAS_GROUPS = (
    ("text", "varchar", "character varying"),
    ("int", "integer", "int4"),
    ("bigint", "int8"),
    ("smallint", "int2"),
    ("numeric", "decimal"),
    ("timestamp", "timestamp without time zone", "timestamp with time zone"),
    ("boolean", "bool"),
)

# An existing type (left) that may stand for a wanted type (right),
# but not the other way round.
ONE_WAY_ALIASES = (
    ("timestamptz", ("timestamp", "timestamp with time zone", "timestamp without time zone")),
    ("serial", ("integer", "int4")),
    ("bigserial", ("bigint", "int8")),
)

# A change between two of these classes is significant.
TYPE_CHANGE_CLASSES = (
    ("text", ("text", "varchar")),
    ("number", ("integer", "bigint", "smallint", "numeric", "decimal")),
    ("boolean", ("boolean",)),
    ("date", ("date",)),
    ("timestamp", ("timestamp",)),
)

# Normalised defaults that mean the same as the name on the left.
EQUIVALENT_DEFAULTS = (
    ("now()", ("current_timestamp", "current_timestamp()")),
    ("current_timestamp", ("now()", "current_timestamp()")),
    ("current_timestamp()", ("now()", "current_timestamp")),
    ("true", ("1", "yes")),
    ("false", ("0", "no")),
    ("active", ("'active'",)),
    ("draft", ("'draft'",)),
)

# Source-language type name -> column type, and the fallbacks.
INFERRED_TYPES = (
    ("int", "integer"), ("int32", "integer"), ("int64", "bigint"),
    ("string", "text"), ("bool", "boolean"),
    ("float32", "numeric"), ("float64", "numeric"),
    ("time.Time", "timestamp"), ("uuid.UUID", "uuid"),
)

# Referential actions.
FK_ACTIONS = ("CASCADE", "SET NULL", "SET DEFAULT", "RESTRICT", "NO ACTION")

# Identifier rules.
MAX_IDENTIFIER = 63
RESERVED_TABLE_NAMES = ("user", "order", "group", "table", "index", "view", "schema")

# Default expressions a column may name.
NOW_DEFAULTS = ("now()", "current_timestamp", "current_timestamp()")
DATE_DEFAULTS = ("current_date", "current_date()")
UUID_DEFAULTS = ("uuid_generate_v4()", "gen_random_uuid()")

# Bookkeeping tables, never part of a catalog.
LEDGER_TABLE = "schema_migrations"
LOG_TABLE = "migration_logs"
OWN_TABLES = (LEDGER_TABLE, LOG_TABLE)

# Section markers of a change script.
UP_MARKER = "-- Up Migration"
DOWN_MARKER = "-- Down Migration (Rollback)"
DOWN_BODY_MARKER = "-- ======================="

# Page size.
DEFAULT_PAGE_SIZE = 10
MAX_PAGE_SIZE = 100
DEFAULT_LOG_ROWS = 50

# Finding texts; %s marks a value.
MESSAGES = {
    "empty": "%s name cannot be empty",
    "long": "%s name '%s' is too long (max 63 characters)",
    "character": "%s name '%s' contains invalid character '%s'",
    "reserved": "table name '%s' is a reserved keyword",
    "table_exists": "Table '%s' already exists in database",
    "no_columns": "Table '%s' must have at least one column",
    "duplicate_column": "Duplicate column name '%s' in table '%s'",
    "data_type": "unsupported data type '%s'",
    "default_integer": "integer type cannot have decimal default value '%s'",
    "default_string": "string type should have quoted default value '%s'",
    "default_boolean": "boolean type should have true/false default value, got '%s'",
    "no_primary_key": "Table '%s' has no primary key defined",
    "fk_table_empty": "foreign key references table cannot be empty",
    "fk_column_empty": "foreign key references column cannot be empty",
    "fk_itself": "foreign key cannot reference itself",
    "fk_on_delete": "invalid onDelete action '%s', must be one of: "
                    "[CASCADE SET NULL SET DEFAULT RESTRICT NO ACTION]",
    "fk_on_update": "invalid onUpdate action '%s', must be one of: "
                    "[CASCADE SET NULL SET DEFAULT RESTRICT NO ACTION]",
    "duplicate_index": "Duplicate index name '%s' in table '%s'",
    "index_column_not_found": "Index '%s' references non-existent column '%s' in table '%s'",
    "foreign_key_table_not_found": "Foreign key references non-existent table '%s'",
    "foreign_key_column_not_found": "Foreign key references non-existent column '%s' in table '%s'",
}

# White space that is cut from both ends of a text.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
