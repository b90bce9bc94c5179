"""Stored graphs: edges that grow by versions (F15) and whole graphs that can be cleared first.

An ``EdgeStore`` is a folder with one sub-folder for each version. A version
is written whole, with overwrite, under the next free number, so a failed
and repeated run replaces its own files; readers see the versions whose write
has finished (the writer's success marker).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.edges import only_missing
from ..operators.graph import Graph
from . import tables as TB
from .fixtures import path_exists


class EdgeStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Numbers of the finished versions."""
        out = []
        n = 1
        while path_exists(self.spark, f"{self.path}/version={n}/_SUCCESS"):
            out.append(n)
            n += 1
        return out

    def edges(self) -> DataFrame:
        """Edges of all versions, with the version that added each."""
        found = [self.spark.read.parquet(f"{self.path}/version={n}").withColumn("version", F.lit(n)) for n in self.versions()]
        if not found:
            raise FileNotFoundError(f"no edges in {self.path}")
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x, allowMissingColumns=True)
        return out

    def populate(self, sources: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> int:
        """Add the edges (``src``, ``dst``, properties) that ``build`` makes for the sources without an edge yet; their
        number. The first run has no edges to look at, so all sources are built."""
        done = self.versions()
        missing = only_missing(sources, key, self.edges()) if done else sources
        obs = Observation("edges")
        build(missing).observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/version={len(done) + 1}")
        return int(obs.get["n"])

    def clear(self) -> bool:
        return TB.drop(self.spark, self.path)


def save_graph(spark: SparkSession, g: Graph, path: str, clear_first: bool = False) -> dict[str, int]:
    """write all nodes and relationships of ``g`` below ``path``, one table for each label and each type with its end
    labels; rows written by name. ``clear_first`` removes what is there before, otherwise rows are added."""
    if clear_first:
        TB.drop(spark, path)
    out = {}
    for label in g.nodes:
        out[label] = TB.append(g.node(label), f"{path}/nodes/{label}")
    for key in g.edges:
        name = "-".join(key)
        out[name] = TB.append(g.edge_table(key), f"{path}/edges/{name}")
    return out


def load_graph(spark: SparkSession, path: str, labels: dict[str, str], edges: list[tuple[str, str, str]]) -> Graph:
    """The stored graph with the node ``labels`` (label -> key column) and relationships ``edges``."""
    g = Graph()
    for label, key in labels.items():
        g.add_nodes(label, spark.read.parquet(f"{path}/nodes/{label}"), key)
    for e in edges:
        g.add_edges(*e, spark.read.parquet(f"{path}/edges/{'-'.join(e)}"))
    return g
