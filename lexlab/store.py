"""Store of prepared tables: a table is written once and shared by all queries that
want the same one.

A table's address is a hash of its plan (attribute ids taken out, so that building the
same frame again gives the same plan), of its schema, and of its input files with
their lengths and times.  A hit also needs the plans to be semantically equal, so
paths and literals are compared by Spark itself.  Changed input files are another
address.

Tables live in the shared checkpoint folder.  Every ``acquire`` counts one use, and
``release`` one less; ``evict`` deletes tables without uses, ``clear`` all.  A table whose
files are gone is written again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexlab.session import drop_staged, stage_table


@dataclass
class _Entry:
    plan: DataFrame
    table: DataFrame
    uses: int = 0
    hits: int = 0


def _stamps(df: DataFrame) -> list[str]:
    """Name, length and time of every input file, by Hadoop's file systems."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    out = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return out


def address(df: DataFrame) -> str:
    """The address of the table that ``df`` would write."""
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    return hashlib.sha256("\n".join([plan, df.schema.json(), *_stamps(df)]).encode()).hexdigest()


def _there(table: DataFrame) -> bool:
    spark = table.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return all(p.getFileSystem(conf).exists(p) for p in
               (spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in table.inputFiles()))


class PreparedStore:
    """The tables of one session (of one application, on the driver)."""

    def __init__(self):
        self.entries: dict[str, _Entry] = {}
        self.written = 0

    def acquire(self, df: DataFrame, name: str) -> DataFrame:
        """The stored table of ``df``, written if it is not there; one more use."""
        key = address(df)
        got = self.entries.get(key)
        if got is not None and not (got.plan.sameSemantics(df) and _there(got.table)):
            got = None
        if got is None:
            got = self.entries[key] = _Entry(df, stage_table(df, f"prepared-{name}"))
            self.written += 1
        else:
            got.hits += 1
        got.uses += 1
        return got.table

    def release(self, table: DataFrame) -> None:
        """One use less of a table that :meth:`acquire` gave out."""
        for got in self.entries.values():
            if got.table is table:
                got.uses = max(0, got.uses - 1)
                return
        raise ValueError("not a table of this store")

    def evict(self) -> int:
        """Delete tables that nobody uses; their number."""
        idle = [k for k, e in self.entries.items() if e.uses == 0]
        for k in idle:
            drop_staged(self.entries.pop(k).table)
        return len(idle)

    def clear(self) -> int:
        """Delete all tables; whoever still reads one fails."""
        for e in self.entries.values():
            e.uses = 0
        return self.evict()


_STORES: dict[str, PreparedStore] = {}


def store(spark: SparkSession) -> PreparedStore:
    """The application's store."""
    return _STORES.setdefault(spark.sparkContext.applicationId, PreparedStore())
