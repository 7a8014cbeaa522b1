"""A table of a database as a source and a sink, by any DB-API module.

``load`` writes so that no row is ever there twice or by halves: tasks put their rows, in batches, into the job's own staging table under a
label of their attempt; when all have ended, one transaction takes the rows of the attempts that count into the target and leaves out keys
that are there. Then, or if the job fails, the staging table goes, so that a task which still writes finds none. Rows pass from tasks to the
database and not through the driver.

``read_table`` plans a partition per range of a numeric key, with the columns and comparisons that the query needs pushed into its SQL.

The database has to be one that all tasks reach. SQLite does for tests, and where its file lies in a folder that all executors share.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of one insert; attempts whose rows one statement marks.
BATCH, LABELS = 500, 500
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(options: dict):
    """options: module (a DB-API module's name) and arguments (of its connect(), as a JSON object)."""
    return importlib.import_module(options.get("module", "sqlite3")).connect(**json.loads(options["arguments"]))


def _mark(options: dict) -> str:
    """How the module writes a parameter."""
    style = importlib.import_module(options.get("module", "sqlite3")).paramstyle
    return "%s" if style in ("format", "pyformat") else "?"


@dataclass
class Loaded(WriterCommitMessage):
    label: str
    rows: int


class TableWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names, self.staging = options, schema.names, quoted(options["staging"])
        self.columns = ", ".join(map(quoted, self.names))

    def write(self, iterator: Iterator) -> Loaded:
        label, rows, held = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", 0, []
        sql = f"INSERT INTO {self.staging} ({self.columns}, quillstream_label) VALUES ({', '.join([_mark(self.options)] * (len(self.names) + 1))})"
        with closing(connect(self.options)) as db:

            def put() -> None:
                db.cursor().executemany(sql, held)
                db.commit()
                held.clear()

            for row in iterator:
                held.append((*row, label))
                rows += 1
                if len(held) >= int(self.options.get("batch", BATCH)):
                    put()
            if held:
                put()
        return Loaded(label, rows)

    def commit(self, messages: list[Loaded | None]) -> None:
        """The rows of the attempts that count, in one transaction: of equal keys among them one, and none whose key is there."""
        table, keys, mark = quoted(self.options["table"]), json.loads(self.options["keys"]), _mark(self.options)
        same = lambda a, b: " AND ".join(f"{a}.{quoted(k)} = {b}.{quoted(k)}" for k in keys)
        whole = ", ".join(f"s.{quoted(c)}" for c in self.names)
        order = ", ".join(map(quoted, [*keys, *(c for c in self.names if c not in keys)]))
        with closing(connect(self.options)) as db:
            cursor = db.cursor()
            counts = [m.label for m in messages if m is not None and m.rows]
            for at in range(0, len(counts), LABELS):
                own = counts[at : at + LABELS]
                cursor.execute(f"UPDATE {self.staging} SET quillstream_label = 'counts' WHERE quillstream_label IN ({', '.join([mark] * len(own))})", tuple(own))
            first = f"SELECT *, row_number() OVER (PARTITION BY {', '.join(map(quoted, keys))} ORDER BY {order}) AS quillstream_n FROM {self.staging} WHERE quillstream_label = 'counts'"
            # An outer join, which a database without an index on the keys makes one for: an EXISTS would read the table once for each row.
            cursor.execute(f"INSERT INTO {table} ({self.columns}) SELECT {whole} FROM ({first}) s LEFT JOIN {table} t ON {same('t', 's')} WHERE s.quillstream_n = 1 AND t.{quoted(keys[0])} IS NULL")
            cursor.execute(f"DROP TABLE {self.staging}")
            db.commit()

    def abort(self, messages: list[Loaded | None]) -> None:
        with closing(connect(self.options)) as db:
            db.cursor().execute(f"DROP TABLE IF EXISTS {self.staging}")
            db.commit()


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class TableReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names, self.filters = options, schema.names, []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if type(f) in COMPARED and len(f.attribute) == 1 and isinstance(f.value, (int, str)):
                self.filters.append((f.attribute[0], COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        key, n = self.options["key"], int(self.options.get("partitions", 8))
        with closing(connect(self.options)) as db:
            cursor = db.cursor()
            cursor.execute(f"SELECT min({quoted(key)}), max({quoted(key)}) FROM {quoted(self.options['table'])}")
            low, high = cursor.fetchone()
        if low is None:
            return [Range(None, None)]
        step = -(-(high - low + 1) // n)
        starts = list(range(low, high + 1, step))
        # The first range takes null keys and all below, the last all above.
        return [Range(a if i else None, b) for i, (a, b) in enumerate(zip(starts, [*starts[1:], None], strict=True))]

    def read(self, partition: Range) -> Iterator[tuple]:
        key, mark, where, values = quoted(self.options["key"]), _mark(self.options), [], []
        if partition.high is not None:
            where.append(f"({key} < {mark}" + (f" OR {key} IS NULL)" if partition.low is None else ")"))
            values.append(partition.high)
        if partition.low is not None:
            where.append(f"{key} >= {mark}")
            values.append(partition.low)
        for name, compared, value in self.filters:
            where.append(f"{quoted(name)} {compared} {mark}")
            values.append(value)
        with closing(connect(self.options)) as db:
            cursor = db.cursor()
            cursor.execute(f"SELECT {', '.join(map(quoted, self.names))} FROM {quoted(self.options['table'])}" + (f" WHERE {' AND '.join(where)}" if where else ""), tuple(values))
            while rows := cursor.fetchmany(10_000):
                yield from map(tuple, rows)


class TableSource(DataSource):
    """``spark.read.format("database_table")`` and ``df.write.format("database_table")``"""

    @classmethod
    def name(cls) -> str:
        return "database_table"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(dict(self.options), schema)


def read_table(spark: SparkSession, table: str, schema: str, key: str, arguments: dict, module: str = "sqlite3", partitions: int = 8) -> DataFrame:
    """A table, in ranges of `key`."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TableSource)
    options = {"table": table, "schema": schema, "key": key, "module": module, "arguments": json.dumps(arguments), "partitions": str(partitions)}
    return spark.read.format("database_table").options(**options).load()


def load(df: DataFrame, table: str, keys: list[str], arguments: dict, module: str = "sqlite3", batch: int = BATCH) -> dict[str, int]:
    """Adds the rows whose keys are new to a table that exists. Returns and reconciles the counts: before, added, after, and `there`, the source's keys that the table holds then (all, or it is an error)."""
    spark, staging = df.sparkSession, f"{table}_staging_{uuid.uuid4().hex[:12]}"
    spark.dataSource.register(TableSource)
    options = {"table": table, "keys": json.dumps(keys), "module": module, "arguments": json.dumps(arguments), "staging": staging, "batch": str(batch)}
    columns = ", ".join(map(quoted, df.columns))

    def count(db) -> int:
        cursor = db.cursor()
        cursor.execute(f"SELECT count(*) FROM {quoted(table)}")
        return cursor.fetchone()[0]

    with closing(connect(options)) as db:
        before = count(db)
        db.cursor().execute(f"CREATE TABLE {quoted(staging)} AS SELECT {columns}, '' AS quillstream_label FROM {quoted(table)} WHERE 1 = 0")
        db.commit()
    df.write.format("database_table").options(**options).mode("append").save()
    with closing(connect(options)) as db:
        after = count(db)
    wanted = df.select(*keys).distinct()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    there = read_table(spark, table, ", ".join(f"`{k}` {kinds[k]}" for k in keys), keys[0], arguments, module) if kinds[keys[0]] in ("int", "bigint", "smallint") else None
    held = wanted.join(there, keys, "left_semi").count() if there is not None else after
    found = {"before": before, "added": after - before, "after": after, "there": held}
    if there is not None and held != wanted.dropna().count():
        raise RuntimeError(f"keys are missing in {table}: {found}")
    return found
