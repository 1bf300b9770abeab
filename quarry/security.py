"""Who may do what: the decision as a function, and as a table."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The one table that users may change.
OWN_TABLE = "field_comprehensions"
ROLES = ("admin", "junior", "user", "none")
OPERATIONS = ("select", "insert", "update", "delete", "ddl")


@dataclass
class UserSession:
    """Who is connected; ``student_id`` only for students."""

    username: str
    role: str = "none"
    is_authenticated: bool = False
    student_id: int | None = None
    login_time: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    operations_count: int = 0


def role_of(username: Column, is_super: Column) -> Column:
    """The role that a name has: an administrator by right or by name, else by name a junior, else a user."""
    named = lambda word: username.contains(word) | username.contains(word.title())
    return F.when(F.coalesce(is_super, F.lit(False)) | named("admin"), "admin").when(named("junior"), "junior").otherwise("user")


def password_digest(salt: str, password: str) -> str:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt.encode(), 100_000).hex()


def authenticate(accounts: DataFrame, students: DataFrame, username: str, password: str) -> UserSession:
    """A session for an account (username, salt, digest, is_super) whose password fits; one that isn't authenticated otherwise.

    Juniors and users get the number of the student whose last name is their username, if there is one.
    """
    found = accounts.filter(F.col("username") == username).select("salt", "digest", role_of(F.col("username"), F.col("is_super")).alias("role")).first()
    if found is None or not hmac.compare_digest(found.digest, password_digest(found.salt, password)):
        return UserSession(username)
    student = students.filter(F.col("last_name") == username).select("student_id").first() if found.role != "admin" else None
    return UserSession(username, found.role, True, student.student_id if student else None)


def allowed(role: Column, authenticated: Column, operation: Column, target: Column) -> Column:
    """Administrators everything, juniors reading, users reading and changing or deleting rows of their own table."""
    reads = role.isin("junior", "user") & (operation == "select")
    changes = (role == "user") & operation.isin("update", "delete") & F.coalesce(target == OWN_TABLE, F.lit(False))
    return authenticated & ((role == "admin") | reads | changes)


def has_permission(session: UserSession | None, operation: str, target: str | None = None) -> bool:
    if session is None or not session.is_authenticated:
        return False
    if session.role == "admin":
        return True
    if session.role not in ("junior", "user"):
        return False
    return operation == "select" or session.role == "user" and operation in ("update", "delete") and target == OWN_TABLE


def permissions(spark: SparkSession, targets: tuple[str | None, ...] = ("students", OWN_TABLE, None)) -> DataFrame:
    """The decision for each role, state, operation and target."""
    rows = [(r, a, o, t) for r in ROLES for a in (True, False) for o in OPERATIONS for t in targets]
    df = spark.createDataFrame(rows, "role string, authenticated boolean, operation string, target string")
    return df.withColumn("allowed", allowed(F.col("role"), F.col("authenticated"), F.col("operation"), F.col("target")))
