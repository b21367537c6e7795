"""Load delimited lines and set apart those that do not parse, with the reason.

Lines are cut into cells (row, column, value); a rule table is joined by column,
every rule is evaluated on its cell, errors are aggregated per row, and the
clean rows are the anti-join against them.

Defined results: a null or blank line is neither a row nor a failure; a failing
line comes out once, with the first reason that applies; repeated lines are
judged one by one; every input column is kept under its own name, and the
columns added are those of the field names given (an input column of the same
name is replaced in the clean rows). An empty table gives two empty results.
The text patterns use possessive quantifiers only, so very long lines take
neither deep recursion nor backtracking.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One field: a quoted one, in which a doubled quote is a quote, or a bare one.
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^ \t"]++)'
LINE = rf"\A{FIELD}(?:[ \t]++{FIELD})*+\z"
#: Dropped at both ends of a line.
ENDS = " \t\r"

#: Pseudo-columns of the cells that describe a whole line.
QUOTING, WIDTH = "quoting", "column_count"


@dataclass(frozen=True)
class Rule:
    """``value`` of ``column`` must match the pattern, else the row fails with ``reason``; a lower ``rank`` is reported first."""

    column: str
    pattern: str
    reason: str
    rank: int


def line_rules(fields: Sequence[str], patterns: dict[str, str]) -> list[Rule]:
    """The rule table: correct quoting, then the number of fields, then each field's form."""
    return [
        Rule(QUOTING, r"\Atrue\z", "quoting", 1),
        Rule(WIDTH, rf"\A{len(fields)}\z", "column_count", 2),
        *(Rule(name, patterns[name], "invalid_value", 3) for name in fields if name in patterns),
    ]


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(ENDS))


def _unquoted(cell: Column) -> Column:
    inner = F.regexp_replace(F.substring(cell, F.lit(2), F.length(cell) - 2), '""', '"')
    return F.when(cell.startswith('"'), inner).otherwise(cell)


def cells(lines: DataFrame, line_column: str, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, column, value): two cells that describe the line, and one per field of a well-quoted line."""
    quoted_well = F.col("_text").rlike(LINE)
    found = F.regexp_extract_all(F.col("_text"), F.lit(FIELD), F.lit(0))
    names = F.array(*map(F.lit, fields))
    named = F.transform(
        F.slice(F.col("_found"), 1, len(fields)),
        lambda value, i: F.struct(F.get(names, i).alias("column"), _unquoted(value).alias("value")),
    )
    about = F.array(
        F.struct(F.lit(QUOTING).alias("column"), F.col("_ok").cast("string").alias("value")),
        F.struct(F.lit(WIDTH).alias("column"), F.when(F.col("_ok"), F.size("_found").cast("string")).alias("value")),
    )
    return (
        lines.select(*keys, _trimmed(F.col(line_column)).alias("_text"))
        .where(F.length("_text") > 0)
        .withColumn("_ok", quoted_well)
        .withColumn("_found", F.when(F.col("_ok"), found).otherwise(F.array().cast("array<string>")))
        .select(*keys, F.explode(F.concat(about, named)).alias("_cell"))
        .select(*keys, "_cell.column", "_cell.value")
    )


def evaluate(cells_: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """(keys, reason): one row per row with a violated rule. A null value violates nothing: what made it null is reported by its own rule."""
    spark = cells_.sparkSession
    table = spark.createDataFrame([(i, r.column, r.reason, r.rank) for i, r in enumerate(rules)], "rule int, column string, reason string, rank int")
    # one literal pattern per rule: each is compiled once, not once per row
    holds = F.lit(True)
    for i, rule in enumerate(rules):
        holds = F.when(F.col("rule") == i, F.col("value").rlike(rule.pattern)).otherwise(holds)
    return (
        cells_.join(F.broadcast(table), "column")  # the rule table has as many rows as rules were declared
        .where(~holds)
        .groupBy(*keys)
        .agg(F.min_by("reason", "rank").alias("reason"))
    )


def split_lines(
    lines: DataFrame, line_column: str, key: str, fields: Sequence[str], patterns: dict[str, str], casts: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split ``lines`` into (clean rows, rejected rows with ``reason``).

    ``key`` identifies a line; should it be null or repeat, lines of the same
    key are told apart by their text.
    """
    digest = F.sha2(F.coalesce(F.col(line_column), F.lit("")), 256)
    keyed = lines.withColumn("_key", F.col(key)).withColumn("_digest", digest)
    errors = evaluate(cells(keyed, line_column, ["_key", "_digest"], fields), line_rules(fields, patterns), ["_key", "_digest"])
    errors = errors.select(F.col("_key").alias("_k"), F.col("_digest").alias("_d"), "reason")
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d"))
    rejected = keyed.drop("reason").join(errors, same).drop("_key", "_digest", "_k", "_d")
    found = F.regexp_extract_all(F.col("_text"), F.lit(FIELD), F.lit(0))
    clean = (
        keyed.withColumn("_text", _trimmed(F.col(line_column)))
        .where(F.length("_text") > 0)
        .join(errors, same, "left_anti")
        .withColumn("_found", found)
    )
    for i, name in enumerate(fields):
        value = _unquoted(F.get(F.col("_found"), F.lit(i)))
        clean = clean.withColumn(name, value.try_cast(casts[name]) if casts and name in casts else value)
    return clean.drop("_key", "_digest", "_text", "_found"), rejected


#: The label list: a picture's file name and a class code.
LABEL_FIELDS = ("filename", "label")
LABEL_PATTERNS = {"filename": r"(?i)\A[^/\\]++(?<=[^/\\]\.(?:jpg|jpeg|png))\z", "label": r"\A[0-7]\z"}


def parse_label_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``train_cls_raw`` → (rows with filename and label, rejected lines with reason)."""
    return split_lines(lines, "raw_line", "line_id", LABEL_FIELDS, LABEL_PATTERNS, {"label": "long"})
