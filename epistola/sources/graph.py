"""The graph as one JSON object and as tables; frequency dictionaries; request files."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "struct<id:string,name:string,domain:string,sent:bigint,received:bigint,count:bigint,years:array<int>,domain_count:bigint,aliases:array<string>>"
EDGE = "struct<source:string,target:string,weight:bigint,years:array<int>,doc_ids:array<string>>"
GRAPH = f"stats struct<nodes:bigint,edges:bigint,top_domains:array<struct<domain:string,count:bigint>>>, nodes array<{NODE}>, edges array<{EDGE}>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file."""
    g = spark.read.schema(GRAPH).json(path, multiLine=True)
    return tuple(g.select(F.explode(c).alias("x")).select("x.*") for c in ("nodes", "edges"))


def graph_stats(nodes: DataFrame, edges: DataFrame, top: int = 50) -> DataFrame:
    """One row: numbers of nodes and edges and the largest domains, biggest first."""
    from epistola.operators.network import top_domains

    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    t = top_domains(nodes, top).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "domain"))).alias("t"))
    return n.crossJoin(e).crossJoin(t.select(F.transform("t", lambda x: F.struct(x["domain"].alias("domain"), (-x["o"]).alias("count"))).alias("top_domains")))


#: Bytes sent to the file at a time.
_CHUNK = 1 << 20


def _rows(df: DataFrame) -> Iterator[str]:
    for r in df.toJSON().toLocalIterator():
        yield r


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, tables: str | None = None, compact: bool = True) -> str:
    """Writes one JSON object on any Hadoop file system, streaming rows partition by partition, beside the target and renames it at the end; a file that stood
    there is kept as ``.bak``. ``tables``: a folder that gets both as Parquet, the form to use at scale: one object is written by one writer."""
    spark = nodes.sparkSession
    if tables:
        nodes.write.mode("overwrite").parquet(f"{tables.rstrip('/')}/nodes")
        edges.write.mode("overwrite").parquet(f"{tables.rstrip('/')}/edges")
    stats = graph_stats(nodes, edges).toJSON().first()
    sep = (",", ":") if compact else (", ", ": ")
    tight = lambda s: json.dumps(json.loads(s), separators=sep, ensure_ascii=False)

    def pieces() -> Iterator[str]:
        yield '{"stats"' + sep[1] + tight(stats)
        for name, df in (("nodes", nodes.orderBy(F.desc("count"), "id")), ("edges", edges)):
            yield f'{sep[0]}"{name}"{sep[1]}['
            for i, r in enumerate(_rows(df)):
                yield (sep[0] if i else "") + tight(r)
            yield "]"
        yield "}"

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    target, new, kept = at(path), at(path + ".new"), at(path + ".bak")
    fs = target.getFileSystem(conf)
    out, held, size = fs.create(new, True), [], 0
    for piece in pieces():
        held.append(piece.encode("utf-8"))
        size += len(held[-1])
        if size >= _CHUNK:
            out.write(b"".join(held))
            held, size = [], 0
    out.write(b"".join(held))
    out.close()
    if fs.exists(target):
        fs.delete(kept, False)
        fs.rename(target, kept)
    fs.rename(new, target)
    return path


def read_dictionary(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """``term, count`` of a frequency dictionary, one term and count a line."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("count", T.LongType())])
    return spark.read.schema(schema).csv(path, sep=separator)


def write_version(df: DataFrame, path: str) -> str:
    """A new version of a dataset in a folder of its own, on any file system; the folder read from is never overwritten, and of two writers
    at once each gets a version."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    while True:
        out = f"{path.rstrip('/')}/v{n}"
        # The marker is created by one writer only.
        fs.mkdirs(at(path))
        if not fs.exists(at(out)) and fs.createNewFile(at(f"{path.rstrip('/')}/_v{n}")):
            df.write.parquet(out)
            return out
        n += 1
