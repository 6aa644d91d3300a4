"""Import staging: from sheet rows (row_no, paragraph, raw_codes) to valid rows and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred import errors as E
from kindred.functions import text as tx
from kindred.operators.tables import cut


def skip_blank_rows(sheet: DataFrame) -> DataFrame:
    """Trim both cells (null: empty) and drop rows in which both are blank."""
    cells = sheet.withColumns({c: F.coalesce(tx.java_trim(F.col(c)), F.lit("")) for c in ("paragraph", "raw_codes")})
    return cells.where((F.col("paragraph") != "") | (F.col("raw_codes") != ""))


def row_cap(rows: DataFrame, max_rows: int) -> DataFrame:
    """The first max_rows + 1 rows in sheet order with `over_cap` set on the last one if it is too many.

    The sort keeps max_rows + 1 rows a task, so the window sees no more than that.
    """
    first = rows.orderBy("row_no").limit(max_rows + 1)
    return first.withColumn("over_cap", F.row_number().over(Window.orderBy("row_no")) > max_rows)


def derive(rows: DataFrame, max_length: int = 4000) -> DataFrame:
    """Add normalized_text, text_hash, codes and row_error (the first failing check)."""
    over = F.col("over_cap") if "over_cap" in rows.columns else F.lit(False)
    out = rows.withColumn("normalized_text", tx.normalize(F.col("paragraph")))
    out = out.withColumn("_codes", tx.codes_and_error(F.col("raw_codes")))
    error = F.when(~over, F.coalesce(tx.paragraph_error(F.col("normalized_text"), max_length), F.col("_codes.error")))
    return out.withColumns({"text_hash": tx.text_hash(F.col("normalized_text")), "codes": F.col("_codes.codes"), "row_error": error}).drop("_codes")


def keys(derived: DataFrame) -> DataFrame:
    """What the checks of classify() need of derived rows, without their texts, as a table: derived once, however often it is read."""
    return cut(derived.select("row_no", *[c for c in ("over_cap",) if c in derived.columns], "text_hash", "codes", "row_error"), "sheet-keys")


def classify(derived: DataFrame) -> DataFrame:
    """Add status: invalid, new, skipped or conflict; and first_row, the first valid row of the same text.

    First rows come from an aggregate with map-side combine, so that a text which fills much of the
    sheet makes no hot task; conflicts compare with the first valid row only.
    """
    over = F.col("over_cap") if "over_cap" in derived.columns else F.lit(False)
    usable = F.col("row_error").isNull() & ~over
    first = (
        derived.where(usable)
        .groupBy(F.col("text_hash").alias("_hash"))
        .agg(F.min(F.struct("row_no", "codes")).alias("_first"))
    )
    joined = derived.join(first, derived.text_hash == first["_hash"], "left").drop("_hash")
    status = (
        F.when(~usable, "invalid")
        .when(F.col("row_no") == F.col("_first.row_no"), "new")
        .when(F.col("codes") == F.col("_first.codes"), "skipped")
        .otherwise("conflict")
    )
    return joined.withColumns({"status": status, "first_row": F.when(usable, F.col("_first.row_no"))}).drop("_first")


def stage(sheet: DataFrame, max_rows: int | None = 1000, max_length: int = 4000) -> DataFrame:
    rows = skip_blank_rows(sheet)
    if max_rows is not None:
        rows = row_cap(rows, max_rows)
    return classify(derive(rows, max_length))


def errors(staged: DataFrame, max_rows: int | None = 1000) -> DataFrame:
    """(row_no, message) of every row that stops the import."""
    over = F.col("over_cap") if "over_cap" in staged.columns else F.lit(False)
    message: Column = (
        F.when(over, F.lit(E.MSG_ROW_CAP.format(limit=max_rows)))
        .when(F.col("status") == "conflict", F.format_string(E.MSG_FILE_CONFLICT.replace("{row}", "%d"), F.col("first_row")))
        .otherwise(F.col("row_error"))
    )
    return staged.select("row_no", message.alias("message")).where(F.col("message").isNotNull())
