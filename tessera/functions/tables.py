"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from tessera.functions.text import split_text

CAP = 8000


@udtf(useArrow=False)  # with Arrow each text's parts are a table of their own, which takes far longer than to cut it
class SplitText:
    """split_text(text[, cap]): the parts of a text of at most `cap` UTF-8 bytes, as ingest.build_chunks() cuts them. Null and blank texts have none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, cap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType) and text.dataType.typeName() != "void":
            raise ValueError(f"split_text() splits strings, not {text.dataType.simpleString()}")
        if cap is not None and (not cap.isConstantExpression or not isinstance(cap.value, int) or cap.value < 4):
            raise ValueError("the cap of split_text() is a constant whole number from 4")
        return AnalyzeResult(StructType().add("part", IntegerType()).add("part_count", IntegerType()).add("part_text", StringType()))

    def eval(self, text, cap=CAP):
        parts = split_text(text or "", int(cap))
        for k, part in enumerate(parts, 1):
            yield k, len(parts), part


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_text", SplitText)
