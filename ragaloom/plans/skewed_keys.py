"""Queries of the operator for keys that hold most rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragaloom.operators.keyed_totals import keyed_totals
from ragaloom.session import table

#: A raga counts as frequent from this part of the rows on that have a raga.
FREQUENT = 0.03


def raga_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each stored raga in both fields, with the tonic in Hz, or the length of the title, as measure."""
    fields = (("tracks_meta", "raga", F.col("tonic")), ("scraped_compositions", "raga_canonical", F.char_length("title")))
    out = None
    for name, column, measure in fields:
        totals = keyed_totals(table(spark, sf_dir, name), F.col(column), measure)
        one = totals.select(F.lit(f"{name}.{column}").alias("field"), F.col("key").alias("raga"), *totals.columns[1:])
        out = one if out is None else out.unionByName(one)
    return out


def p1_raga_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raga's totals, rounded for comparison."""
    return raga_totals(spark, sf_dir).select("field", "raga", "n_rows", "n_values", *(F.round(c, 4).alias(c) for c in ("total", "least", "most")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values, not null or '', that hold at least FREQUENT of the rows of their field."""
    named = raga_totals(spark, sf_dir).filter("raga <> ''").select("field", "raga", "n_rows")
    whole = named.groupBy("field").agg(F.sum("n_rows").alias("whole"))
    return named.join(F.broadcast(whole), "field").filter(F.col("n_rows") >= FREQUENT * F.col("whole")).select("field", "raga")


def _one(name: str, column: str, measure: str) -> str:
    return f"""SELECT '{name}.{column}' AS field, {column} AS raga, count(*) AS n_rows, count({measure}) AS n_values,
      round(sum(CAST({measure} AS DOUBLE)), 4) AS total, round(min(CAST({measure} AS DOUBLE)), 4) AS least, round(max(CAST({measure} AS DOUBLE)), 4) AS most
      FROM {name} GROUP BY {column}"""


TOTALS_SQL = f"{_one('tracks_meta', 'raga', 'tonic')} UNION ALL {_one('scraped_compositions', 'raga_canonical', 'length(title)')}"

QUERIES = {"p1_found": p1_found, "p1_raga_totals": p1_raga_totals}
SQL = {
    "p1_raga_totals": TOTALS_SQL,
    "p1_found": f"""SELECT field, raga FROM (SELECT field, raga, n_rows, sum(n_rows) OVER (PARTITION BY field) AS whole
      FROM ({TOTALS_SQL}) WHERE raga <> '') WHERE n_rows >= {FREQUENT} * whole""",
}
