"""String, path and address functions, quoting, and the detector of SQL injection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of SQL injection, matched in either case (fixed values).
INJECTION = (
    r"('(''|[^'])*')",
    r"(\b(SELECT|UPDATE|INSERT|DELETE|DROP|ALTER|CREATE|TRUNCATE)\b)",
    r"(\b(OR|AND)\s+['\"]?\d+['\"]?\s*[=<>]\s*['\"]?\d+['\"]?)",
    r"(;\s*\w)",
    r"(--|/\*|\*/)",
    r"(UNION\s+ALL\s+SELECT)",
    r"(EXEC\s*\()",
    r"(WAITFOR\s+DELAY)",
    r"(xp_cmdshell)",
    r"(CHAR\()",
)
INT4, TEXT = 23, 25


def backticks(s: Column) -> Column:
    """Every apostrophe as a backtick (STR-03)."""
    return F.translate(s, "'", "`")


def doubled_quotes(s: Column, size: int | None = None) -> Column:
    """Every apostrophe twice, cut to a buffer's ``size`` less its terminator if one is given (STR-04)."""
    out = F.replace(s, F.lit("'"), F.lit("''"))
    return out if size is None else F.substring(out, 1, size - 1)


def is_injection(s: Column) -> Column:
    """Whether a string looks like SQL injection; false for null (STR-05)."""
    hit = s.rlike("(?i)" + "|".join(INJECTION))
    # a semicolon outside quotes; a backslash before an apostrophe takes away its meaning
    bare = F.regexp_replace(F.regexp_replace(s, r"\\'", ""), r"'[^']*('|$)", "")
    return F.coalesce(hit | (s.contains(";") & bare.contains(";")), F.lit(False))


def parameter_type(s: Column) -> Column:
    """Type of a text parameter: INT4 for digits with an optional minus (and for none), else TEXT; 0 for null (STR-06)."""
    return F.when(s.isNull(), 0).when(s.rlike(r"^-?[0-9]*\z"), INT4).otherwise(TEXT)


def host(s: Column) -> Column:
    return F.substring_index(s, ":", 1)


def port(s: Column) -> Column:
    """Port of host:port; null if there is none or it is no number of 1 to 65535 (STR-10)."""
    p = F.when(s.contains(":"), F.substring_index(s, ":", -1).try_cast("int"))
    return F.when(p.between(1, 65535), p)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """What stands before the last slash; a dot without one, the slash itself for a file at the root."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), ".").when(cut == "", "/").otherwise(cut)


def joined(base: Column, name: Column) -> Column:
    return F.when(base.endswith("/"), F.concat(base, name)).otherwise(F.concat(base, F.lit("/"), name))


def relative(path: Column, base: Column) -> Column:
    """A path from a folder above it; any other path stays as it is."""
    with_slash = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    return F.when(F.startswith(path, with_slash), F.substr(path, F.length(with_slash) + 1)).otherwise(path)


def is_excluded(name: Column) -> Column:
    """Files that archives leave out (SRC-10)."""
    return name.isin(".DS_Store", "Thumbs.db") | name.endswith("~") | name.endswith(".tmp")


def log_line(at: Column, level: Column, message: Column) -> Column:
    return F.format_string("[%s] [%s] %s", F.date_format(at, "yyyy-MM-dd HH:mm:ss"), level, message)


#: Log levels from the least on.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


def at_level(level: Column, least: str) -> Column:
    """Whether a level is logged where the threshold is ``least``; an unknown level isn't (STR-15)."""
    return level.isin(*LEVELS[LEVELS.index(least) :])


def swapped(a: Column, b: Column) -> tuple[Column, Column]:
    return b, a


def typed_fields(line: Column) -> Column:
    """A line of a 16-bit, a 32-bit and a 64-bit unsigned number, a float and a double; what is none of its kind is null (NUM-25)."""
    part = lambda k: F.get(F.split(F.trim(line), r"\s+"), F.lit(k))
    number = lambda k, bits: F.when(part(k).rlike(r"^[0-9]{1,20}\z") & (part(k).try_cast("decimal(20,0)") < F.lit(str(2**bits)).cast("decimal(20,0)")), part(k).try_cast("decimal(20,0)"))
    return F.struct(number(0, 16).cast("int").alias("hu"), number(1, 32).cast("long").alias("u"), number(2, 64).alias("llu"), part(3).try_cast("float").alias("f"), part(4).try_cast("double").alias("lf"))
