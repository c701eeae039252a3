"""CSV export of the paper table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "",
               "nullValue": "", "encoding": "UTF-8", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}


def export_csv(df: DataFrame, path: str, columns: Sequence[str] = ("author", "paper",
                                                                    "processed_text")) -> bool:
    """Write the projected columns as CSV with a header.

    Quotes inside a field are doubled, fields with a comma or quote are
    quoted, empty strings and NULLs are written as empty fields. A failed
    write is reported by returning False, not raised.
    """
    try:
        df.select(*columns).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
        return True
    except Exception as exc:  # noqa: BLE001 - reported, as the export contract says
        print(f"CSV export to {path} failed: {exc}")
        return False


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read an export back; empty string fields come back as ''."""
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    st = df.schema
    return df.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name)
                       if f.dataType.simpleString() == "string" else F.col(f.name) for f in st])
