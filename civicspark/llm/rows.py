"""Keys that tell documents of one id apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.scratch import save

#: A column's name while documents are joined; no table should have it.
KEY = "_civicspark_key"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with KEY: a hash of the text where an id (a null one, too) has several texts, else 0.

    Beside the id it names a document; rows of equal id and text are one.  A
    column of zeros takes no space in the tables of an operator.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_own"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"))
    several = rows.groupBy("_own").agg(F.min("_hash").alias("_lo"), F.max("_hash").alias("_hi")).where("_lo < _hi")
    several = save(several.select("_own", F.lit(True).alias("_several")))
    out = docs.join(several, F.col(id_col).cast("long").eqNullSafe(F.col("_own")), "left")
    key = F.when(F.col("_several"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).otherwise(F.lit(0))
    return out.withColumn(KEY, key).drop("_own", "_several")
