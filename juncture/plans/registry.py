"""Query registry: one Spark plan, one output contract and (where SQL can say it) one oracle.

The output contract is a string such as ``"barcode:s n:i psi:d"``.  It is applied to both
sides, so a query and its oracle always agree on names, order and types:
``s`` string, ``i`` bigint, ``d`` double rounded to ``DIGITS`` places, ``b`` boolean.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juncture.plans import fixtures
from juncture.sources.sinks import write_once

DIGITS = 6
#: Bytes of a base table's files for each task where its rows are dealt by key: some 100,000 line items.
TASK_BYTES = 1_250_000
SPARK_TYPES = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
SQL_TYPES = {"s": "varchar", "i": "bigint", "d": "double", "b": "boolean"}


class Tables:
    """Resolves base tables and derived views for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.views = dict(fixtures.SPARK_VIEWS)
        fixtures.register_base(spark, sf_dir)

    def __call__(self, name: str) -> DataFrame:
        if name in self.views:
            text = fixtures.for_dir(fixtures.with_views(f"select * from {name}", [name], self.views), self.sf_dir)
            if "{tasks}" in text:
                text = text.replace("{tasks}", str(self.tasks("lineitem")))
            return self.spark.sql(text).alias(name)
        return self.spark.table(fixtures.view_name(self.sf_dir, name)).alias(name)

    def tasks(self, table: str) -> int:
        """How many tasks share a base table's rows, so that their number grows with it and a task's memory does not; starts no job."""
        size = int(str(self(table)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return -(-max(size, 1) // TASK_BYTES)

    def hold(self, *names: str) -> Tables:
        """Write views that a query reads many times once; they are read back from then on, also by the views made of them."""
        for name in names:
            held = fixtures.view_name(self.sf_dir, f"held_{name}_{uuid.uuid4().hex[:8]}")
            write_once(self(name), name).createOrReplaceTempView(held)
            self.views[name] = f"select * from {held}"
        return self


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.build(Tables(spark, sf_dir))
        cols = []
        for name, kind in self.columns:
            col = F.col(f"`{name}`").cast(SPARK_TYPES[kind])
            if kind == "d":
                # one null spelling, and no negative zero
                col = F.round(F.when(~F.isnan(col), col), DIGITS) + F.lit(0.0)
            cols.append(col.alias(name))
        return out.select(*cols)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = []
        for name, kind in self.columns:
            text = f'cast("{name}" as {SQL_TYPES[kind]})'
            if kind == "d":
                text = f"round(case when not isnan({text}) then {text} end, {DIGITS}) + 0e0"
            cols.append(f'{text} as "{name}"')
        body = f"select {', '.join(cols)} from (\n{self.sql}\n) q"
        return fixtures.with_views(body)


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name`` with its output contract and oracle."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        pairs = tuple(tuple(c.split(":")) for c in columns.split())
        QUERIES[name] = Query(name, build, pairs, sql)
        return build

    return add
