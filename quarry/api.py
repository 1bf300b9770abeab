"""Queries with bound parameters, prepared statements, and queries under permissions.

Values are always bound and never become part of the statement, so that text in them can't change it; what looks like an
injection is logged and passed on unchanged.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import security
from .functions.strings import INJECTION

log = logging.getLogger("quarry")
Value = str | int | float | None


def looks_injected(text: str | None) -> bool:
    """The test of ``functions.strings.is_injection`` for one string."""
    if text is None:
        return False
    if any(re.search(p, text, re.I) for p in INJECTION):
        return True
    return ";" in re.sub(r"'[^']*('|$)", "", re.sub(r"\\'", "", text))


def typed(text: Value) -> Value:
    """Text parameters that are whole numbers become numbers; an empty one becomes null."""
    if not isinstance(text, str):
        return text
    if text == "":
        return None
    return int(text) if re.fullmatch(r"-?[0-9]+", text) else text


def positional(sql: str) -> tuple[str, list[int]]:
    """A statement with $1, $2, … as one with ?, and which parameter stands at each."""
    order: list[int] = []

    def one(m: re.Match[str]) -> str:
        if m[1] is None:
            return m[0]
        order.append(int(m[1]) - 1)
        return "?"

    return re.sub(r"'(?:[^']|'')*'|\$(\d+)", one, sql), order


def execute(spark: SparkSession, sql: str, params: Sequence[Value] = (), infer: bool = False) -> DataFrame:
    """Runs a statement with parameters $1, $2, …; ``infer`` types text as the database's client did."""
    text, order = positional(sql)
    for v in params:
        if isinstance(v, str) and looks_injected(v):
            log.warning("a parameter looks like an injection: %r", v[:80])
    if order and max(order) >= len(params):
        raise ValueError(f"the statement needs {max(order) + 1} parameters, not {len(params)}")
    values = [typed(v) if infer else v for v in params]
    return spark.sql(text, args=[values[i] for i in order]) if order else spark.sql(text)


@dataclass(frozen=True)
class Prepared:
    """A statement kept by name with its number of parameters."""

    name: str
    sql: str
    count: int


class Statements:
    """Prepared statements of a session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.held = spark, {}

    def prepare(self, name: str, sql: str) -> Prepared:
        if name in self.held:
            raise ValueError(f"a statement is named {name!r} already")
        _, order = positional(sql)
        self.held[name] = Prepared(name, sql, max(order, default=-1) + 1)
        return self.held[name]

    def execute(self, name: str, params: Sequence[Value] = ()) -> DataFrame:
        statement = self.held[name]
        if len(params) != statement.count:
            raise ValueError(f"{name!r} takes {statement.count} parameters, not {len(params)}")
        return execute(self.spark, statement.sql, params)

    def free(self, name: str) -> None:
        self.held.pop(name, None)


#: What each statement that changes rows is, by the node of Spark's parsed plan, and the method that gives its target.
CHANGES = {"InsertIntoStatement": ("insert", "table"), "UpdateTable": ("update", "table"), "DeleteFromTable": ("delete", "table"), "MergeIntoTable": ("update", "targetTable")}
#: Nodes that do more than read. Everything that is one of these, and no change of rows, counts as DDL.
ACTS = ("Command", "ParsedStatement", "CompoundPlanStatement", "InsertIntoDir")


def targets(spark: SparkSession, sql: str) -> list[tuple[str, str | None]]:
    """What a statement does to which table, from Spark's own parser: pairs of operation and target, none for a mere read."""
    jvm, found = spark.sparkContext._jvm, []
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    acts = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}", False, loader) for name in ACTS]
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(positional(sql)[0])]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name in CHANGES:
            operation, method = CHANGES[name]
            found.append((operation, table_name(getattr(node, method)())))
        elif any(c.isInstance(node) for c in acts):
            found.append(("ddl", None))
        children = node.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return found


def table_name(node) -> str | None:
    """The name of a table as a statement has it, in small letters; null if it isn't a plain name."""
    while node.getClass().getSimpleName() == "SubqueryAlias":
        node = node.child()
    return node.multipartIdentifier().mkString(".").lower() if node.getClass().getSimpleName() == "UnresolvedRelation" else None


def operation_of(spark: SparkSession, sql: str) -> str:
    """select, insert, update, delete or ddl; of several, the first that isn't a read."""
    return next((operation for operation, _ in targets(spark, sql)), "select")


def execute_as(spark: SparkSession, session: security.UserSession, sql: str, params: Sequence[Value] = (), table: str | None = None) -> DataFrame:
    """Runs a statement if the session may do all that it does, by its parsed form; ``table`` only names a read in the log."""
    for operation, target in targets(spark, sql) or [("select", table)]:
        if not security.has_permission(session, operation, target):
            log.warning("%s may not %s %s", session.username, operation, target)
            raise PermissionError(f"{session.username} may not {operation} {target or ''}".rstrip())
        log.info("%s starts %s %s", session.username, operation, target)
    out = execute(spark, sql, params)
    session.operations_count += 1
    return out


def printed(df: DataFrame, rows: int = 20) -> str:
    """The first rows of a result as a table of text."""
    return df._jdf.showString(rows, 0, False)
