"""Round trips through every source and sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import clean
from riskweave.operators import profile
from riskweave.plans.base import ORDERS, prepared, table
from riskweave.plans.registry import BASE_SQL, query, rounded, tidy
from riskweave.session import scratch_path
from riskweave.sources import tables, text
from riskweave.spec import read_spec, spec_roles, write_spec

_DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("csv_text_roundtrip", """
SELECT doc_id, lang, source, n_chars, length(text)::INTEGER AS length,
       md5(text) AS digest FROM documents""")
def csv_text_roundtrip(spark, sf):
    """Documents with line breaks and quotes through gzip CSV, read as text, typed afterwards."""
    path = scratch_path(spark, "csv")
    text.write_text_csv(table(spark, sf, "documents").select(*_DOCS), path)
    raw = text.read_text_csv(spark, path, _DOCS)
    return raw.select(
        F.col("doc_id").try_cast("long").alias("doc_id"), "lang", "source",
        F.col("n_chars").try_cast("long").alias("n_chars"),
        F.length("text").alias("length"), F.md5("text").alias("digest"))


@query("csv_projection", f"""
SELECT o_orderstatus, count(*) AS n, {rounded('sum(o_totalprice) AS total', digits=2)}
FROM orders GROUP BY 1""")
def csv_projection(spark, sf):
    """Two columns of a CSV; the parser skips the others."""
    path = scratch_path(spark, "csv")
    text.write_text_csv(table(spark, sf, "orders"), path)
    raw = text.read_text_csv(spark, path, keep=["o_orderstatus", "o_totalprice"])
    return tidy(raw.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(clean.to_number(F.col("o_totalprice"))).alias("total")), 2)


@query("csv_base_table", """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END::INTEGER AS target,
  year(o_orderdate)::INTEGER AS issue_year, round(ln(1 + o_totalprice), 6) + 0.0 AS o_totalprice,
  o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def csv_base_table(spark, sf):
    """Text file to typed base table through a spec with month-year dates."""
    from riskweave.spec import FeatureSpec

    path = scratch_path(spark, "csv")
    text.write_text_csv(table(spark, sf, "orders").withColumn(
        "issued", F.date_format("o_orderdate", "MMM-yyyy")), path)
    spec = FeatureSpec(id="o_orderkey", status="o_orderstatus", outcomes={"F": 0, "P": 1},
                       numeric=["o_totalprice"], categorical=["o_orderpriority"],
                       issue="issued", log1p=["o_totalprice"])
    return tidy(text.read_base(spark, path, spec))


@query("parquet_projection", BASE_SQL + """
SELECT segment, issue_year, count(*) AS n FROM base GROUP BY 1, 2""")
def parquet_projection(spark, sf):
    """Partitioned Parquet write and a pruned, projected read."""
    path = scratch_path(spark, "parquet")
    tables.write_table(prepared(spark, sf), path, ["segment"])
    return tables.read_table(spark, path, ["segment", "issue_year"]).groupBy(
        "segment", "issue_year").agg(F.count(F.lit(1)).alias("n"))


@query("result_table_csv", BASE_SQL + """
SELECT issue_year::VARCHAR AS issue_year, count(*)::VARCHAR AS n FROM base GROUP BY 1""")
def result_table_csv(spark, sf):
    path = scratch_path(spark, "results")
    rows = profile.cohort_rate(prepared(spark, sf), "issue_year", "target").select("issue_year", "n")
    tables.write_results(rows, path)
    return text.read_text_csv(spark, path)


@query("spec_roundtrip", BASE_SQL + " UNION ALL ".join(
    [f"SELECT '{c}' AS variable, 'numeric' AS role, {'true' if c in ORDERS.log1p else 'false'} AS log1p,"
     f" count({c}) AS n FROM base" for c in ORDERS.numeric]
    + [f"SELECT '{c}', 'indicator', false, count({c}) FROM base" for c in ORDERS.flags]
    + [f"SELECT '{c}', 'categorical', false, count({c}) FROM base" for c in ORDERS.categorical]))
def spec_roundtrip(spark, sf):
    """Spec stored and read back; its roles joined with the non-missing counts of the base table."""
    path = scratch_path(spark, "spec")
    write_spec(spark, ORDERS, path)
    roles = spec_roles(spark, read_spec(spark, path))
    info = profile.table_info(prepared(spark, sf)).select("variable", F.col("non_null").alias("n"))
    return roles.join(info, "variable")


@query("partition_balance")
def partition_balance(spark, sf):
    return profile.partition_balance(table(spark, sf, "lineitem"))


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf):
    layout = tables.scan_layout(table(spark, sf, "lineitem"))
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") == layout["rows"])
