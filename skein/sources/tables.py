"""The driver's tables in the shape of the data model: files, messages as units, a property graph, a manifest."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """path, language, text, bytes, doc_id: each document is a file of its source's folder."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang")).alias("path"),
        F.col("lang").alias("language"), "text", F.octet_length("text").cast("long").alias("bytes"), "doc_id", "source",
    )


FILES_SQL = "files AS (SELECT concat(source, '/', doc_id, '.', lang) AS path, lang AS language, text, strlen(text) AS bytes, doc_id, source FROM documents)"

#: kind of node by table: (table, key, kind, name, qualified name, path)
_NODES = [
    ("region", "r_regionkey", "module", "r_name", "r_name", "'geo/regions'"),
    ("nation", "n_nationkey", "struct", "n_name", "concat('geo::', n_name)", "'geo/nations'"),
    ("customer", "c_custkey", "function", "c_name", "concat(c_mktsegment, '::', c_name)", "concat('sales/tests/', c_nationkey)"),
    ("supplier", "s_suppkey", "method", "s_name", "concat('supply::', s_name)", "concat('supply/', s_nationkey)"),
    ("part", "p_partkey", "const", "p_name", "concat(p_brand, '::', p_name)", "concat('parts/', p_size)"),
    ("orders", "o_orderkey", "variable", "concat('order', o_orderkey)", "concat(o_orderpriority, '::order', o_orderkey)", "concat('sales/', substring(o_orderstatus, 1, 1))"),
]
NODES_SQL = "nodes AS (" + " UNION ALL ".join(
    f"SELECT concat('{t}:', {k}) AS id, '{kind}' AS kind, {name} AS name, {q} AS qualified_name, {path} AS path, {k} AS line FROM {t}" for t, k, kind, name, q, path in _NODES
) + ")"
_EDGES = [
    "SELECT concat('nation:', n_nationkey) AS src, 'extends' AS kind, concat('region:', n_regionkey) AS dst, 1 AS line, 1 AS sites FROM nation",
    "SELECT concat('customer:', c_custkey), 'references', concat('nation:', c_nationkey), 1, 1 FROM customer",
    "SELECT concat('supplier:', s_suppkey), 'type_uses', concat('nation:', s_nationkey), 1, 1 FROM supplier",
    "SELECT concat('orders:', o_orderkey), 'calls', concat('customer:', o_custkey), 1, 1 FROM orders",
    "SELECT concat('orders:', l_orderkey), 'imports', concat('part:', l_partkey), min(l_linenumber), count(*) FROM lineitem GROUP BY l_orderkey, l_partkey",
    "SELECT concat('orders:', l_orderkey), 'calls', concat('supplier:', l_suppkey), min(l_linenumber), count(*) FROM lineitem GROUP BY l_orderkey, l_suppkey",
]
EDGES_SQL = "edges AS (" + " UNION ALL ".join(_EDGES) + ")"


def _frame(spark: SparkSession, d: str, selects: list[str]) -> DataFrame:
    """The union of SELECTs that read one table each."""
    parts = [spark.sql(re.sub(r"FROM \w+", "FROM {t}", s), t=table(spark, d, re.search(r"FROM (\w+)", s)[1])) for s in selects]
    return functools.reduce(DataFrame.union, parts)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, name, qualified_name, path, line"""
    selects = [
        f"SELECT concat('{t}:', {k}) AS id, '{kind}' AS kind, {name} AS name, {q} AS qualified_name, {path} AS path, cast({k} AS bigint) AS line FROM {t}"
        for t, k, kind, name, q, path in _NODES
    ]
    return _frame(spark, d, selects)


def edges(spark: SparkSession, d: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """src, kind, dst, line, sites (reference sites behind the edge); only the tables of the kinds asked for are read."""
    selects = [s for s in _EDGES if not kinds or any(f"'{k}'" in s for k in kinds)]
    return _frame(spark, d, selects).toDF("src", "kind", "dst", "line", "sites").withColumns({"line": F.col("line").cast("long"), "sites": F.col("sites").cast("long")})


def links(spark: SparkSession, d: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """src, kind, dst: the edges, one as often as it has sites. No table is grouped; for questions that don't count edges."""
    selects = [re.sub(r", [^,]+, [^,]+ (FROM \w+).*", r" \1", s) for s in _EDGES if not kinds or any(f"'{k}'" in s for k in kinds)]
    return _frame(spark, d, selects).toDF("src", "kind", "dst")


def tree(spark: SparkSession, d: str) -> DataFrame:
    """path, language, text: a source tree made of regions and nations, in which each nation's file uses its region's."""
    region, nation = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("r")), table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_regionkey").cast("string").alias("r"))
    kinds = [
        ("src/", ".rs", "rust", "pub fn region_@() -> u32 {\n    1\n}\n", "use crate::r@::region_@;\n\npub fn nation_%() {\n    region_@();\n}\n"),
        ("py/", ".py", "python", "def region_@():\n    return 1\n", "from py.r@ import region_@\n\n\ndef nation_%():\n    return region_@()\n"),
        ("ts/", ".ts", "typescript", "export function region_@() {\n  return 1;\n}\n", 'import { region_@ } from "./r@";\n\nexport function nation_%() {\n  return region_@();\n}\n'),
        ("md/", ".md", "okf", "# Region @\n", "# Nation %\n\nSee [the region](r@.md).\n"),
    ]
    out = []
    for folder, end, language, whole, part in kinds:
        name = lambda rows, head: F.concat(F.lit(folder + head), F.col(head), F.lit(end)).alias("path")  # noqa: B023, E731, ARG005
        text = lambda t: F.replace(F.replace(F.lit(t), F.lit("@"), F.col("r")), F.lit("%"), F.col("n") if "%" in t else F.lit("")).alias("text")
        out.append(region.select(name(region, "r"), F.lit(language).alias("language"), text(whole)))
        out.append(nation.select(name(nation, "n"), F.lit(language).alias("language"), text(part)))
    return functools.reduce(DataFrame.unionAll, out)
