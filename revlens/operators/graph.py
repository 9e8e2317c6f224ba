"""The commit graph: edges, reachability, path cover, file states. Order, names and origins are in lineage."""

from __future__ import annotations

import hashlib
from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.operators.store import scratch


def edges(commits: DataFrame) -> DataFrame:
    """(parent, child, parent_num) from (rev, parents)."""
    return commits.select(F.posexplode("parents").alias("parent_num", "parent"), F.col("rev").alias("child"))


def reachable(start: DataFrame, arcs: DataFrame, limit: int = 100_000) -> DataFrame:
    """Nodes that a start node (node) reaches along arcs (parent, child), with themselves. Frontier by frontier, each written, so that no plan grows with the depth."""
    spark = start.sparkSession
    at, parts = scratch(spark, "reach"), []

    def put(df):
        parts.append(f"{at}/{len(parts)}")
        df.write.parquet(parts[-1])
        return spark.read.schema(df.schema).parquet(parts[-1])

    # arcs are read each round: what they come from is worked out once
    arcs.select("parent", "child").write.parquet(f"{at}/arcs")
    arcs = spark.read.schema(arcs.select("parent", "child").schema).parquet(f"{at}/arcs")
    front = put(start.select("node").distinct())
    for _ in range(limit):
        seen = spark.read.parquet(*parts)
        front = put(front.join(arcs, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
    raise RuntimeError("reachable: too deep")


def path_cover(root, children: dict) -> list[list]:
    """Breadth first from root: each arc is in one path; an arc goes to the first path that ends in its parent, else it begins a path."""
    paths, todo, seen = [[root]], deque([root]), {root}
    ends = defaultdict(list)
    ends[root].append(0)
    while todo:
        p = todo.popleft()
        for c in children.get(p, ()):
            if ends[p]:
                k = ends[p].pop(0)
                paths[k].append(c)
            else:
                k = len(paths)
                paths.append([p, c])
            ends[c].append(k)
            if c not in seen:
                seen.add(c)
                todo.append(c)
    return paths


def attached(path: list, covered: set, parents: dict) -> list:
    """A branch's path, oldest commit last, so that it begins at a covered commit: its first parent is added where it doesn't, and must be covered."""
    if path[-1] not in covered:
        path = [*path, next(iter(parents.get(path[-1], ())), None)]
        if path[-1] not in covered:
            raise ValueError(f"attached: the branch at {path[0]} begins at no covered commit")
    return path


def path_key(path: list[str]) -> str:
    """A name of a path by its last two commits; of one commit, by itself."""
    return hashlib.sha1("".join(path[-2:]).encode()).hexdigest()


def file_state(changes: DataFrame) -> DataFrame:
    """(path, rev, kind): the last change of each path: all that don't end in DELETE exist. changes: (path, seq, rev, kind)."""
    return changes.groupBy("path").agg(F.max_by(F.struct("rev", "kind"), "seq").alias("last")).select("path", "last.rev", "last.kind")


def broken_states(changes: DataFrame) -> DataFrame:
    """Changes that can't be: adding what exists, touching what doesn't."""
    before = F.lag("kind").over(Window.partitionBy("path").orderBy("seq"))
    there = before.isNotNull() & (before != "DELETE")
    return changes.withColumn("there", there).where((F.col("kind") == "ADD") & F.col("there") | (F.col("kind") != "ADD") & ~F.col("there")).drop("there")


def merged_state(states: DataFrame) -> DataFrame:
    """Union of the parents' states (parent_num, path, count): the last parent's count wins."""
    return states.groupBy("path").agg(F.max_by("count", "parent_num").alias("count"))


def state_check(files: DataFrame, state: DataFrame) -> DataFrame:
    """Paths that are on one side only: (path, side)."""
    return files.select("path").exceptAll(state.select("path")).withColumn("side", F.lit("files")).unionByName(state.select("path").exceptAll(files.select("path")).withColumn("side", F.lit("state")))


def possible_renames(changes: DataFrame) -> DataFrame:
    """(rev, old_path, new_path) of a delete and an add of one name in one commit."""
    name = F.element_at(F.split("path", "/"), -1)
    gone = changes.where("kind = 'DELETE'").select("rev", name.alias("name"), F.col("path").alias("old_path"))
    new = changes.where("kind = 'ADD'").select("rev", name.alias("name"), F.col("path").alias("new_path"))
    return gone.join(new, ["rev", "name"]).select("rev", "old_path", "new_path")
