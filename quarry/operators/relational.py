"""Queries of a students' register over any tables of its shape: unions, windows, grouping, searching.

Columns follow the register: students (student_id, last_name, first_name, patronymic, students_group_number), fields
(field_id, field_name), field_comprehensions (student_id, field, mark), professors, professor_fields, structural_units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of third-year students: letters, a dash, a 3 and a digit. The first letter of the class is the Latin A, as published.
THIRD_YEAR = r"^[A-Яа-я]+-3\d$"


def full_name(last: str = "last_name", first: str = "first_name", patronymic: str = "patronymic") -> Column:
    """Last, first and patronymic with a blank between, also where the patronymic is missing."""
    return F.concat(F.col(last), F.lit(" "), F.col(first), F.lit(" "), F.coalesce(F.col(patronymic), F.lit("")))


def rounded_mean(value: str | Column, places: int = 2) -> Column:
    """Mean rounded as a decimal, half away from zero."""
    return F.round(F.avg(value).cast("decimal(38,10)"), places)


def roles(*parts: tuple[DataFrame, Column, str], top: int = 20) -> DataFrame:
    """Names with their role from several tables, the first by role and name."""
    named = [df.select(name.alias("name"), F.lit(role).alias("role")) for df, name, role in parts]
    first, *rest = named
    for n in rest:
        first = first.unionAll(n)
    return first.orderBy("role", "name").limit(top)


def with_group_mean(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with the mean of its group, as AVG OVER (PARTITION BY key) has it.

    Means are made with partial sums and joined back, so that a group with most of the rows is never in one task; the
    means of few groups go to all tasks by the optimizer's own choice.
    """
    means = df.groupBy(F.col(key).alias("_group")).agg(F.avg(value).alias(name))
    return df.join(means, F.col(key).eqNullSafe(F.col("_group"))).drop("_group")


def field_averages(students: DataFrame, comprehensions: DataFrame, fields: DataFrame, least: float = 3.5, groups: str = THIRD_YEAR, top: int = 10) -> DataFrame:
    """Students with the mean mark of each of their fields, over all of the chosen groups, where it is above ``least``."""
    marks = (
        students.filter(F.col("students_group_number").rlike(groups))
        .join(comprehensions.filter("mark is not null"), "student_id")
        .join(fields, F.col("field") == F.col("field_id"))
        .select("student_id", full_name().alias("student"), "field_name", "mark")
    )
    return with_group_mean(marks, "field_name", "mark", "average").filter(F.col("average") > least).withColumn("average", F.round(F.col("average").cast("decimal(38,10)"), 2)).orderBy(F.desc("average"), "student", "field_name").limit(top).select("field_name", "student", "average")


def professor_averages(professors: DataFrame, professor_fields: DataFrame, fields: DataFrame, comprehensions: DataFrame, last_name: str, top: int = 20) -> DataFrame:
    """Mean mark of every field of the professors whose last name is LIKE a pattern."""
    joined = professors.filter(F.col("last_name").like(last_name)).join(professor_fields, "professor_id").join(fields, "field_id").join(comprehensions, F.col("field") == F.col("field_id"))
    return joined.groupBy(full_name().alias("professor"), "field_name").agg(rounded_mean("mark").alias("average")).orderBy("professor", "field_name").limit(top)


def best_students(students: DataFrame, comprehensions: DataFrame, least: float = 4.0) -> DataFrame:
    """Students whose mean mark is at least ``least``, with it and their number of marks (HAVING)."""
    grouped = students.join(comprehensions.filter("mark is not null"), "student_id").groupBy("student_id").agg(F.avg("mark").alias("_mean"), F.count("mark").alias("marks"))
    return grouped.filter(F.col("_mean") >= least).select("student_id", F.round(F.col("_mean").cast("decimal(38,10)"), 2).alias("average"), "marks")


def best_with_groups(students: DataFrame, groups: DataFrame, comprehensions: DataFrame, least: float = 4.0) -> DataFrame:
    """The same with name and group, of students whose group is in the table of groups (JOIN-10)."""
    marks = comprehensions.filter("mark is not null").groupBy("student_id").agg(F.avg("mark").alias("_mean"), F.count("mark").alias("marks_count")).filter(F.col("_mean") >= least)
    found = students.join(groups.select("students_group_number"), "students_group_number").join(marks, "student_id")
    return found.select("student_id", full_name().alias("full_name"), "students_group_number", F.round(F.col("_mean").cast("decimal(38,10)"), 2).alias("average_mark"), "marks_count")


def text_table(df: DataFrame, between: str = " | ") -> DataFrame:
    """The rows as lines of text, all columns as wide as their widest value, and a line of names (SNK-19)."""
    texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    widest = texts.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(c) for c in df.columns])
    width = {c: widest.select(F.col(c)).scalar() for c in df.columns}
    line = lambda of: F.concat_ws(between, *[F.rpad(of(c), width[c], F.lit(" ")) for c in df.columns])
    head = widest.select(F.lit(True).alias("head"), line(F.lit).alias("line"))
    return head.unionAll(texts.select(F.lit(False), line(F.col)))


def without_marks(students: DataFrame, comprehensions: DataFrame, top: int = 15) -> DataFrame:
    """Students that no comprehension names."""
    return students.join(comprehensions, "student_id", "left_anti").orderBy("last_name", "student_id").limit(top)


def grades_of(students: DataFrame, comprehensions: DataFrame, fields: DataFrame, student_id: int) -> DataFrame:
    return students.filter(F.col("student_id") == student_id).join(comprehensions, "student_id").join(fields, F.col("field") == F.col("field_id")).select("field_name", "mark").orderBy("field_name")


def search_grades(students: DataFrame, comprehensions: DataFrame, fields: DataFrame, text: str) -> DataFrame:
    """Grades of the students whose last name contains ``text``; its LIKE wildcards keep their meaning."""
    found = students.filter(F.col("last_name").like(f"%{text}%"))
    return found.join(comprehensions, "student_id").join(fields, F.col("field") == F.col("field_id")).select("last_name", "first_name", "field_name", "mark").orderBy("last_name", "first_name", "field_name")
