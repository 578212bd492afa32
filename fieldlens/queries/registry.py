"""Query registration and reusable SQL table expressions for the checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldlens.session import prepare
from fieldlens.sources.bindings import Bindings

REGISTRY: dict[str, "Query"] = {}
TABLE_SQL: dict[str, tuple[tuple[str, ...], str]] = {}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Bindings], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Bindings(prepare(spark), folder))


def table_sql(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    """Register a named table expression other SQL texts can build on."""
    TABLE_SQL[name] = (tuple(needs), body)


def with_tables(needs: tuple[str, ...], body: str) -> str:
    """Prefix a query with the WITH clauses it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in TABLE_SQL[name][0]:
                visit(other)
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    clauses = ",\n".join(f"{n} AS ({TABLE_SQL[n][1]})" for n in ordered)
    text = body.strip()
    if text[:5].upper() == "WITH ":
        return f"WITH {clauses},\n{text[5:]}"
    return f"WITH {clauses}\n{text}"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    def wrap(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, None if sql is None else with_tables(needs, sql))
        return build
    return wrap
