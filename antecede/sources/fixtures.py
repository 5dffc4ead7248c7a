"""Mutation tables derived from the TPC-H-like tables, as SQL that Spark and DuckDB read alike.

A sample is an order, a gene a brand; the copy number depends on the brand's number, which plants three tiers of time:
number % 3 = 0 early, 1 middle, 2 late. Trees hang position k of a sample's order below position floor(k / 2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TIER = "CAST(SUBSTRING(p_brand, 7) AS INT) % 3"

FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_vaf": (
        (),
        f"""SELECT CAST(l_orderkey AS STRING) AS sample_id, p_brand AS gene_id,
  CAST(50 - l_quantity AS INT) AS ref_count, CAST(l_quantity AS INT) AS alt_count,
  3 - {TIER} AS copy_number, 2 AS normal_ploidy,
  l_quantity / 50 AS vaf_estimate,
  LEAST(CAST(1 AS DOUBLE), (3 - {TIER}) * (l_quantity / 50)) AS ccf_estimate,
  CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey, p_brand
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS row_id
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "fx_ccf": (
        ("fx_vaf",),
        """SELECT sample_id, gene_id, ccf_estimate AS ccf
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id, gene_id ORDER BY row_id DESC) AS rn FROM fx_vaf) t
WHERE rn = 1 AND ccf_estimate > 0""",
    ),
    "fx_samples": ((), "SELECT CAST(o_orderkey AS STRING) AS sample_id FROM orders"),
    "fx_genes": (("fx_ccf",), "SELECT gene_id, CAST(ROW_NUMBER() OVER (ORDER BY gene_id) AS INT) AS gene_index FROM (SELECT DISTINCT gene_id FROM fx_ccf) g"),
    "fx_tree_nodes": (
        ("fx_ccf",),
        """SELECT sample_id, gene_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY ccf DESC, gene_id) AS BIGINT) AS pos
FROM fx_ccf""",
    ),
    "fx_tree_edges": (
        ("fx_tree_nodes",),
        """SELECT c.sample_id, p.gene_id AS parent, c.gene_id AS child
FROM fx_tree_nodes c JOIN fx_tree_nodes p
  ON c.sample_id = p.sample_id AND p.pos = FLOOR(c.pos / 2)
WHERE c.pos >= 2""",
    ),
    "fx_survival": (
        (),
        """SELECT CAST(o_custkey AS STRING) AS sample_id,
  MAX(CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END) AS status,
  CAST((EXTRACT(YEAR FROM MAX(o_orderdate)) - 1995) * 12 + EXTRACT(MONTH FROM MAX(o_orderdate)) AS DOUBLE) AS time
FROM orders GROUP BY o_custkey""",
    ),
    "fx_patient_genes": (
        (),
        """SELECT CAST(o_custkey AS STRING) AS sample_id, p_type AS gene_id, MAX(l_quantity) AS q
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
GROUP BY o_custkey, p_type""",
    ),
    "fx_patient_steps": (
        ("fx_patient_genes",),
        """SELECT a.sample_id, CONCAT(a.gene_id, '->', b.gene_id) AS step
FROM fx_patient_genes a JOIN fx_patient_genes b ON a.sample_id = b.sample_id AND a.q > b.q""",
    ),
}


def ctes(*names: str, more: str = "", recursive: bool = False) -> str:
    """WITH clause that defines the named fixtures and what they need; more: further definitions."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in FIXTURES[name][0]:
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{x} AS ({FIXTURES[x][1]})" for x in order] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for table in ("lineitem", "part", "orders"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(f"{ctes(name)}SELECT * FROM {name}")
