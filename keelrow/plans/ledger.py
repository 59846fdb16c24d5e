"""The ledger of runs: what was applied, what failed, what is pending, and the log.

Both are append-only parquet tables with a fixed schema.  The latest row of a name is its state.
One writer at a time: without a table format nothing can stop two.
"""

from __future__ import annotations

import getpass
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelrow import fixed_values as fv
from keelrow.contract import TableContract
from keelrow.functions.text import short_checksum, truncate_name
from keelrow.operators import checks
from keelrow.operators.changes import Refused, union_all
from keelrow.operators.numbering import dense_numbers
from keelrow.operators.search import newest
from keelrow.plans import evolve as ev
from keelrow.sources.layout import new_version

LEDGER_SCHEMA = (
    "id long, name string, applied_at timestamp_ntz, seconds double, executed_by string, status string, "
    "error_message string, checksum string, table_affected string, paths map<string,string>"
)
LOG_SCHEMA = (
    "id long, logged_at timestamp_ntz, level string, message string, user_name string, details string, run_name string"
)


# ---------------------------------------------------------------- reading

def latest(ledger: DataFrame) -> DataFrame:
    """The current state: the newest row of every name.  Rows are reduced before they move."""
    rest = [c for c in ledger.columns if c != "name"]
    return ledger.groupBy("name").agg(
        F.max_by(F.struct(*rest), F.struct("applied_at", "id")).alias("r")
    ).select("name", "r.*")


def with_status(ledger: DataFrame, status: str) -> DataFrame:
    return ledger.filter(F.col("status") == status)


def current(ledger: DataFrame) -> DataFrame:
    """The newest row of every name that is neither rolled back nor resolved."""
    return latest(ledger).filter("status IN ('success', 'failed')")


def pending(scripts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Scripts whose newest run is no success."""
    return scripts.join(with_status(latest(ledger), "success").select("name"), "name", "left_anti")


def status(ledger: DataFrame, scripts: DataFrame) -> DataFrame:
    """Applied, pending and failed names as of their newest rows; failed ones with their message."""
    now = latest(ledger)
    nothing = F.lit(None).cast("string")
    return union_all([
        with_status(now, "success").select(
            F.lit("applied").alias("state"), "name", nothing.alias("error_message")),
        pending(scripts, ledger).select(F.lit("pending").alias("state"), "name", nothing.alias("error_message")),
        with_status(now, "failed").select(F.lit("failed").alias("state"), "name", "error_message"),
    ])


def history_of(ledger: DataFrame, table: str = "") -> DataFrame:
    """The runs of one table if asked for (any case, anywhere in the name)."""
    return ledger.filter(F.col("table_affected").ilike(f"%{table}%")) if table else ledger


def history(ledger: DataFrame, limit: int = 0, table: str = "") -> DataFrame:
    """Newest runs first; a limit of 0 means all."""
    return newest(history_of(ledger, table), "applied_at", "id", limit)


def history_numbered(ledger: DataFrame, limit: int, table: str = "") -> DataFrame:
    """The newest runs as they are shown: numbered, long names cut, short checksums."""
    if limit > 0:
        # a limited history is small enough for one task
        order = Window.orderBy(F.col("applied_at").desc(), F.col("id").desc())
        numbered = history(ledger, limit, table).withColumn("number", F.row_number().over(order).cast("long"))
    else:
        newest_first = {"__at": -F.unix_micros(F.col("applied_at").cast("timestamp")), "__id": -F.col("id")}
        numbered = dense_numbers(history_of(ledger, table).withColumns(newest_first), "number", list(newest_first))
    return numbered.select(
        "number", "status", truncate_name(F.col("name")).alias("name"),
        F.when(F.col("seconds") > 0, F.col("seconds")).alias("seconds"),
        F.coalesce(F.nullif("executed_by", F.lit("")), F.lit("N/A")).alias("executed_by"),
        F.substring(F.col("applied_at").cast("string"), 1, 16).alias("applied_at"),
        short_checksum(F.col("checksum")).alias("checksum"),
    )


def history_summary(ledger: DataFrame) -> DataFrame:
    """Counts over the current state; what was rolled back or resolved does not count."""
    return current(ledger).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("seconds") > 0, F.col("seconds"))), F.lit(0.0)).alias("seconds"),
    )


def log(rows: DataFrame, limit: int = fv.DEFAULT_LOG_ROWS) -> DataFrame:
    return newest(rows, "logged_at", "id", limit)


def rollback_candidates(ledger: DataFrame, steps: int) -> DataFrame:
    """The last runs that still hold, newest first; all of them if there are fewer."""
    if steps < 1:
        raise ValueError("steps must be at least 1")
    return newest(with_status(latest(ledger), "success"), "applied_at", "id", steps)


def checksum_drift(ledger: DataFrame, scripts: DataFrame) -> DataFrame:
    """Applied scripts whose text is no longer the one that ran.  ``scripts`` has name and checksum."""
    ran = with_status(latest(ledger), "success").select("name", F.col("checksum").alias("applied_checksum"))
    now = scripts.select("name", F.col("checksum").alias("current_checksum"))
    return ran.join(now, "name").filter("applied_checksum <> current_checksum")


def drift_report(operations: DataFrame, report: DataFrame, ledger: DataFrame, scripts: DataFrame,
                 indexes: DataFrame | None = None) -> DataFrame:
    """Everything that is not as it should be: catalog differences, broken rules, open scripts.

    ``indexes`` (of :func:`keelrow.operators.catalog_diff.index_drift`) tells extra and changed indexes as well; it then stands
    for what the operations say about indexes.
    """
    shape = ("kind", "table", "name", "n_rows")
    # What a catalog operation says about drift.
    labels = F.create_map(*[F.lit(v) for v in (
        "CREATE_TABLE", "missing_table", "DROP_TABLE", "orphaned_table", "ADD_COLUMN", "missing_column",
        "DROP_COLUMN", "orphaned_column", "MODIFY_COLUMN", "column_mismatch", "CREATE_INDEX", "missing_index",
        "ADD_FOREIGN_KEY", "foreign_key_mismatch", "DROP_FOREIGN_KEY", "foreign_key_mismatch",
    )])
    catalog_part = operations.select(
        F.try_element_at(labels, F.col("kind")).alias("kind"), F.col("table_name").alias("table"),
        F.coalesce("column_name", "index_name").alias("name"),
    )
    if indexes is not None:
        catalog_part = catalog_part.filter("kind <> 'missing_index' OR kind IS NULL").unionByName(
            indexes.select("kind", F.col("table_name").alias("table"), F.col("index_name").alias("name")))
    catalog_part = catalog_part.groupBy("kind", "table", "name").agg(F.count(F.lit(1)).alias("n_rows"))
    rule_part = checks.findings(report).select(
        F.concat(F.lit("broken_"), "type").alias("kind"), "table", F.col("column").alias("name"), "n_rows"
    )
    states = status(ledger, scripts).filter("state <> 'applied'").select(
        F.concat(F.col("state"), F.lit("_script")).alias("kind"), F.lit(None).cast("string").alias("table"), "name",
        F.lit(1).cast("long").alias("n_rows"),
    )
    return union_all([p.select(*shape) for p in (catalog_part, rule_part, states)])


# ---------------------------------------------------------------- writing

@dataclass(frozen=True)
class Step:
    """A named change: a list of operations."""

    name: str
    operations: tuple[ev.Operation, ...]

    @property
    def checksum(self) -> str:
        return sha256(repr(self.operations).encode()).hexdigest()

    @property
    def tables(self) -> list[str]:
        return sorted({op.table for op in self.operations})


class Ledger:
    """Runs steps over versioned tables under one base folder."""

    def __init__(self, spark: SparkSession, base: str, baseline: Mapping[str, str] | None = None,
                 contracts: Mapping[str, TableContract] | None = None, user: str | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        self.baseline, self.contracts = dict(baseline or {}), dict(contracts or {})
        self.user = user or getpass.getuser()
        for name, schema in ((fv.LEDGER_TABLE, LEDGER_SCHEMA), (fv.LOG_TABLE, LOG_SCHEMA)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.base}/{name}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self.base}/{fv.LEDGER_TABLE}")

    def log_rows(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.base}/{fv.LOG_TABLE}")

    def current(self) -> DataFrame:
        """State per name without those that were rolled back or resolved."""
        return current(self.rows())

    def status(self, scripts: DataFrame) -> DataFrame:
        return status(self.rows(), scripts)

    def pending(self, scripts: DataFrame) -> DataFrame:
        return pending(scripts, self.rows())

    def history(self, limit: int = 0, table: str = "") -> DataFrame:
        return history(self.rows(), limit, table)

    def summary(self) -> DataFrame:
        return history_summary(self.rows())

    def drift(self, scripts: DataFrame) -> DataFrame:
        return checksum_drift(self.rows(), scripts)

    def _append(self, table: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.base}/{table}")

    def record(self, name: str, state: str, seconds: float = 0.0, error: str | None = None,
               checksum: str | None = None, tables: Sequence[str] = (), paths: Mapping[str, str] | None = None) -> None:
        self._append(fv.LEDGER_TABLE, LEDGER_SCHEMA, (
            time.time_ns(), name, _now(), seconds, self.user, state, error, checksum, ",".join(tables) or None,
            dict(paths or {}),
        ))

    def write_log(self, level: str, message: str, run: str, details: str = "") -> None:
        self._append(fv.LOG_TABLE, LOG_SCHEMA, (time.time_ns(), _now(), level, message, self.user, details, run))

    def paths(self) -> dict[str, str]:
        """Where each table is now: one row per table comes back."""
        return self._paths_of(self.rows())

    def _paths_of(self, rows: DataFrame) -> dict[str, str]:
        moved = rows.filter("status IN ('success', 'rolled_back')").select(
            "id", F.explode("paths").alias("table", "path")
        ).groupBy("table").agg(F.max_by("path", "id").alias("path")).collect()
        return {**self.baseline, **{r["table"]: r["path"] for r in moved}}

    def _names(self, state: str, among: Sequence[str] | None = None) -> list[str]:
        rows = with_status(self.current(), state)
        if among is not None:
            rows = rows.filter(F.col("name").isin(*among)) if among else rows.filter(F.lit(False))
        return sorted(r["name"] for r in rows.select("name").collect())

    def state(self, steps: Sequence[Step]) -> tuple[dict[str, TableContract], list[Step]]:
        """Contracts after the applied steps, and the steps still to run, by name."""
        ordered = sorted(steps, key=lambda s: s.name)
        applied = set(self._names("success", [s.name for s in ordered]))
        contracts = dict(self.contracts)
        for s in ordered:
            if s.name in applied:
                contracts = ev.preview(contracts, s.operations)
        return contracts, [s for s in ordered if s.name not in applied]

    def preview(self, steps: Sequence[Step]) -> list[tuple[str, list[ev.Operation], list[ev.Operation]]]:
        """Pending steps with their operations and inverses; nothing runs."""
        return [(s.name, list(s.operations), ev.inverses(s.operations)) for s in self.state(steps)[1]]

    def apply_pending(self, steps: Sequence[Step]) -> list[str]:
        """Run pending steps in name order and stop at the first that fails.

        A failure that is not resolved blocks every run.  New versions get a path of their own
        and the ledger row comes last, so a run that breaks off leaves the old state in place
        and can be repeated.
        """
        failed = self._names("failed")
        if failed:
            raise Refused("failed runs must be resolved first", {n: 1 for n in failed})
        contracts, todo = self.state(steps)
        done = []
        for step in todo:
            contracts = self._run(step, contracts)
            done.append(step.name)
        return done

    def _run(self, step: Step, contracts: Mapping[str, TableContract]) -> dict[str, TableContract]:
        began = time.monotonic()
        self.write_log("INFO", f"Starting migration: {step.name}", step.name, "Migration execution started")
        run_id = uuid.uuid4().hex
        try:
            where = self.paths()
            tables = {n: self.spark.read.parquet(p) for n, p in where.items() if n in contracts}
            done = ev.evolve(tables, contracts, step.operations).require_allowed()
            written = {}
            for name in step.tables:
                if name in done.tables and self._data_changes(step, name):
                    path = new_version(f"{self.base}/tables", name, run_id)
                    done.tables[name].write.mode("errorifexists").parquet(path)
                    written[name] = path
        except Exception as error:
            self.write_log("ERROR", f"Migration failed: {step.name}", step.name, str(error))
            self.record(step.name, "failed", time.monotonic() - began, str(error), step.checksum, step.tables)
            raise
        seconds = time.monotonic() - began
        self.record(step.name, "success", seconds, None, step.checksum, step.tables, written)
        self.write_log("SUCCESS", f"Migration completed: {step.name}", step.name, f"Execution time: {seconds:.3f}s")
        return done.contracts

    @staticmethod
    def _data_changes(step: Step, table: str) -> bool:
        on_data = {"CREATE_TABLE", "ADD_COLUMN", "DROP_COLUMN", "MODIFY_COLUMN", "RENAME_COLUMN"}
        return any(op.table == table and op.kind in on_data for op in step.operations)

    def _paths_before(self, name: str) -> dict[str, str]:
        """Paths of the step's tables before it ran."""
        step = latest(self.rows().filter(F.col("name") == name)).select("id", "paths").first()
        known = self._paths_of(self.rows().filter(F.col("id") < step["id"]))
        return {t: known[t] for t in step["paths"] if t in known}

    def rollback(self, steps: int) -> list[str]:
        """Undo the last runs, newest first, by pointing at the versions before them.

        A failure keeps the record.  The ledger gets a compensating row; no row is removed.
        """
        names = [r["name"] for r in rollback_candidates(self.rows(), steps).select("name").collect()]
        done = []
        for name in names:
            began = time.monotonic()
            self.write_log("INFO", f"Starting rollback: {name}", name, "Rollback execution started")
            try:
                paths = self._paths_before(name)
                for path in paths.values():
                    self.spark.read.parquet(path).schema      # the version must still be there
            except Exception as error:
                self.write_log("ERROR", f"Rollback failed: {name}", name, str(error))
                raise
            self.record(name, "rolled_back", time.monotonic() - began, paths=paths, tables=sorted(paths))
            self.write_log("SUCCESS", f"Rollback completed: {name}", name)
            done.append(name)
        return done

    def resolve(self, name: str) -> None:
        """Declare a failure dealt with, so that runs may go on."""
        if name not in self._names("failed"):
            raise ValueError(f"{name!r} has no open failure")
        self.record(name, "resolved")
        self.write_log("INFO", f"Failure resolved: {name}", name)


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)
