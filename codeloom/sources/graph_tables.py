"""A typed code graph derived from star-schema tables, as two DataFrames: nodes and edges.

nodes: id, type, name, full_name, file_path, line_number, end_line, package_name
edges: id, source, target, type, weight, line_number, seq
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.plans.staging import dealt, staged

#: Source tables of the graph.
SOURCES = ("nation", "supplier", "part", "customer", "lineitem")
_STORED: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_id(suppkey: Column) -> Column:
    return F.concat(F.lit("cls."), suppkey.cast("string"))


def method_id(partkey: Column, n_classes: int) -> Column:
    """Methods are dealt out to classes in turn, so the same suffix recurs under many owners."""
    return F.concat(F.lit("cls."), (partkey % n_classes).cast("string"), F.lit(".m"), F.floor(partkey / n_classes).cast("string"), F.lit("()"))


def class_type(k: Column) -> Column:
    return F.when(k % 5 == 0, "Interface").when(k % 5 == 4, "DBModel").otherwise("Class")


def class_name(k: Column) -> Column:
    return F.concat(F.lit("C"), k.cast("string"), F.when(k % 4 == 0, "Controller").when(k % 4 == 1, "Service").when(k % 4 == 2, "Repository").otherwise("Entity"))


def n_classes(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "supplier").count()


def stored(spark: SparkSession, sf_dir: str, label: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """make(spark, sf_dir), written once a session by type and read from there until a file of a source table is another one."""

    def written(name: str) -> tuple:
        """Names, lengths and times of a table's files."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return tuple(sorted(out))

    key = (spark.sparkContext.applicationId, sf_dir, label, *map(written, SOURCES))
    if key not in _STORED:
        for old in [k for k in _STORED if k[0] != key[0] or k[:3] == key[:3]]:
            del _STORED[old]
        _STORED[key] = staged(make(spark, sf_dir), "type")
    return _STORED[key]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes, from the stored graph."""
    return stored(spark, sf_dir, "nodes", made_nodes)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges, from the stored graph: a filter on their type reads the files of those types alone.

    Their ids and seq follow from what is stored and are made where they are read: 72 bytes an edge that no codec packs.
    """
    return with_ids(stored(spark, sf_dir, "edges", typed_edges))


def with_ids(e: DataFrame) -> DataFrame:
    key = F.concat_ws("|", "source", "type", "target")
    return e.select(F.sha2(key, 256).alias("id"), "source", "target", "type", "weight", "line_number", F.xxhash64("source", "type", "target").alias("seq"))


def made_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_classes(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.concat(F.lit("pkg."), F.col("n_name")).alias("package_name"), "n_name")
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    k = F.col("s_suppkey")
    file = F.concat(F.lit("/src/"), F.col("n_name"), F.lit("/"), k.cast("string"), F.lit(".java"))
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("int")
    classes = supplier.select(class_id(k).alias("id"), class_type(k).alias("type"), class_name(k).alias("name"), class_id(k).alias("full_name"), file.alias("file_path"), F.lit(1).alias("line_number"), F.lit(200).alias("end_line"), "package_name", k.alias("k"))
    part = table(spark, sf_dir, "part")
    owner = classes.select(F.col("k").alias("o"), "file_path", "package_name")
    methods = part.withColumn("o", F.col("p_partkey") % n).join(owner, "o").select(
        method_id(F.col("p_partkey"), n).alias("id"), F.lit("Method").alias("type"), F.concat(F.lit("m"), F.floor(F.col("p_partkey") / n).cast("string")).alias("name"),
        method_id(F.col("p_partkey"), n).alias("full_name"), "file_path", F.col("p_size").alias("line_number"), (F.col("p_size") + 10).alias("end_line"), "package_name",
    )
    routes = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(
        F.concat(F.lit("GET /c/"), F.col("c_custkey")).alias("id"), F.lit("APIEndpoint").alias("type"), F.concat(F.lit("/c/"), F.col("c_custkey")).alias("name"),
        F.concat(F.lit("GET /c/"), F.col("c_custkey")).alias("full_name"), none.alias("file_path"), zero.alias("line_number"), zero.alias("end_line"), none.alias("package_name"),
    )
    packages = nation.select(F.col("package_name").alias("id"), F.lit("Package").alias("type"), F.col("n_name").alias("name"), F.col("package_name").alias("full_name"), none.alias("file_path"), zero.alias("line_number"), zero.alias("end_line"), "package_name")
    files = classes.select(F.col("file_path").alias("id"), F.lit("File").alias("type"), F.concat(F.col("k").cast("string"), F.lit(".java")).alias("name"), F.col("file_path").alias("full_name"), "file_path", F.lit(1).alias("line_number"), F.lit(200).alias("end_line"), "package_name")
    return classes.drop("k").unionByName(methods).unionByName(routes).unionByName(packages).unionByName(files)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, next part, weight, line_number: consecutive parts of an order, in a total order of its lines."""
    lines = table(spark, sf_dir, "lineitem")
    n = lines.count()
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), n, "l_orderkey")
    step = lines.select("l_linenumber", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return dealt(step.where("dst is not null"), n, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.min("l_linenumber").alias("line_number"))


def made_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(typed_edges(spark, sf_dir))


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, type, weight, line_number."""
    n = n_classes(spark, sf_dir)
    n_parts = table(spark, sf_dir, "part").count()
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    k = F.col("s_suppkey")
    one, line = F.lit(1).cast("long").alias("weight"), F.lit(1).alias("line_number")
    file = F.concat(F.lit("/src/"), F.col("n_name"), F.lit("/"), k.cast("string"), F.lit(".java"))
    p = F.col("p_partkey")
    model_lines = table(spark, sf_dir, "lineitem").where("l_suppkey % 5 = 4").select("l_partkey", "l_suppkey", "l_returnflag", "l_linenumber")
    made = [
        supplier.select(F.concat(F.lit("pkg."), F.col("n_name")).alias("source"), file.alias("target"), F.lit("CONTAINS").alias("type"), one, line),
        supplier.select(file.alias("source"), class_id(k).alias("target"), F.lit("DEFINES").alias("type"), one, line),
        table(spark, sf_dir, "part").select(class_id(p % n).alias("source"), method_id(p, n).alias("target"), F.lit("HAS_METHOD").alias("type"), one, F.col("p_size").alias("line_number")),
        table(spark, sf_dir, "supplier").where((k % 5 == 1) | (k % 5).isin(2, 3) & (k % 10 >= 5)).select(class_id(k).alias("source"), class_id(k - k % 5).alias("target"), F.lit("IMPLEMENTS").alias("type"), one, line),
        calls(spark, sf_dir).select(method_id(F.col("src"), n).alias("source"), method_id(F.col("dst"), n).alias("target"), F.lit("CALLS").alias("type"), "weight", "line_number"),
        dealt(model_lines, model_lines.count(), "l_partkey", "l_suppkey", "l_returnflag").groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("weight"), F.min("l_linenumber").alias("line_number")).select(
            method_id(F.col("l_partkey"), n).alias("source"), class_id(F.col("l_suppkey")).alias("target"), F.when(F.col("l_returnflag") == "R", "RETURNS").when(F.col("l_returnflag") == "A", "READS").otherwise("WRITES").alias("type"), "weight", "line_number"),
        table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(method_id(F.col("c_custkey") % n_parts, n).alias("source"), F.concat(F.lit("GET /c/"), F.col("c_custkey")).alias("target"), F.lit("HANDLES_ROUTE").alias("type"), one, line),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.select("source", "target", "type", "weight", "line_number")


#: The same two tables in SQL for DuckDB: put before a query that reads nodes and edges.
GRAPH_SQL = """
WITH nc AS (SELECT count(*) AS n FROM supplier), np AS (SELECT count(*) AS n FROM part),
sup AS (SELECT s_suppkey AS k, n_name, '/src/' || n_name || '/' || s_suppkey || '.java' AS file FROM supplier JOIN nation ON s_nationkey = n_nationkey),
meth AS (SELECT p_partkey AS p, p_size, p_partkey % nc.n AS o, 'cls.' || (p_partkey % nc.n) || '.m' || (p_partkey // nc.n) || '()' AS mid, 'm' || (p_partkey // nc.n) AS mname FROM part, nc),
calls AS (SELECT src, dst, count(*) AS weight, min(l_linenumber) AS line_number FROM (SELECT l_linenumber, l_partkey AS src,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL GROUP BY 1, 2),
nodes AS (
  SELECT 'cls.' || k AS id, CASE WHEN k % 5 = 0 THEN 'Interface' WHEN k % 5 = 4 THEN 'DBModel' ELSE 'Class' END AS type,
    'C' || k || CASE k % 4 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' WHEN 2 THEN 'Repository' ELSE 'Entity' END AS name, 'cls.' || k AS full_name, file AS file_path,
    1 AS line_number, 200 AS end_line, 'pkg.' || n_name AS package_name FROM sup
  UNION ALL SELECT mid, 'Method', mname, mid, file, p_size, p_size + 10, 'pkg.' || n_name FROM meth JOIN sup ON o = k
  UNION ALL SELECT 'GET /c/' || c_custkey, 'APIEndpoint', '/c/' || c_custkey, 'GET /c/' || c_custkey, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 50 = 0
  UNION ALL SELECT 'pkg.' || n_name, 'Package', n_name, 'pkg.' || n_name, NULL, NULL, NULL, 'pkg.' || n_name FROM nation
  UNION ALL SELECT file, 'File', k || '.java', file, file, 1, 200, 'pkg.' || n_name FROM sup),
raw_edges AS (
  SELECT 'pkg.' || n_name AS source, file AS target, 'CONTAINS' AS type, 1 AS weight, 1 AS line_number FROM sup
  UNION ALL SELECT file, 'cls.' || k, 'DEFINES', 1, 1 FROM sup
  UNION ALL SELECT 'cls.' || o, mid, 'HAS_METHOD', 1, p_size FROM meth
  UNION ALL SELECT 'cls.' || s_suppkey, 'cls.' || (s_suppkey - s_suppkey % 5), 'IMPLEMENTS', 1, 1 FROM supplier WHERE s_suppkey % 5 = 1 OR s_suppkey % 5 IN (2, 3) AND s_suppkey % 10 >= 5
  UNION ALL SELECT a.mid, b.mid, 'CALLS', weight, line_number FROM calls JOIN meth a ON src = a.p JOIN meth b ON dst = b.p
  UNION ALL SELECT mid, 'cls.' || l_suppkey, CASE l_returnflag WHEN 'R' THEN 'RETURNS' WHEN 'A' THEN 'READS' ELSE 'WRITES' END, count(*), min(l_linenumber)
    FROM lineitem JOIN meth ON l_partkey = p WHERE l_suppkey % 5 = 4 GROUP BY 1, 2, 3
  UNION ALL SELECT mid, 'GET /c/' || c_custkey, 'HANDLES_ROUTE', 1, 1 FROM customer, np JOIN meth ON c_custkey % np.n = p WHERE c_custkey % 50 = 0),
edges AS (SELECT sha256(source || '|' || type || '|' || target) AS id, * FROM raw_edges)
"""
