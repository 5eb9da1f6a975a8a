"""Sheets for people: the review sheet out, decisions back in, the ledger as a workbook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators.review import decision_label

#: Columns that a reviewer fills in.
DECISION = ("decision", "corrected_cents", "corrected_number", "corrected_cnpj", "corrected_date", "note", "reviewer")
FLOW = ("exported_at", "applied_at")


def review_sheet(public: DataFrame) -> DataFrame:
    """What is known of each open exception, then empty columns for the decision and its course."""
    return public.select(*public.columns, *[F.lit(None).cast("string").alias(c) for c in (*DECISION, *FLOW)])


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a filled review sheet that hold a decision that is understood."""
    schema = "order_id string, " + ", ".join(f"{c} string" for c in DECISION)
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(*[F.col(x.split()[0]) if x.split()[0] in rows.columns else F.lit(None).cast("string").alias(x.split()[0]) for x in schema.split(", ")])
    return rows.filter(decision_label(F.col("decision")).isNotNull()).withColumn("corrected_cents", F.col("corrected_cents").try_cast("bigint"))


def write_workbook(ledger: DataFrame, marks: dict[tuple[int, str], str], path: str) -> bool:
    """The ledger as XLSX with coloured cells, row by row; False where no workbook library is installed."""
    try:
        from openpyxl import Workbook
        from openpyxl.styles import PatternFill
    except ImportError:
        return False
    book = Workbook(write_only=False)
    sheet = book.active
    sheet.append(list(L.COLUMNS))
    for row in ledger.orderBy("row_id_planilha").toLocalIterator():
        sheet.append([row[c] for c in L.COLUMNS])
    for (number, column), colour in marks.items():
        sheet.cell(row=number, column=L.COLUMNS.index(column) + 1).fill = PatternFill("solid", fgColor=colour)
    book.save(path)
    return True
