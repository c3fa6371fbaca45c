"""Groups of records linked directly or through others (problem 4), by Borůvka hooking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_stored


def _stored(df: DataFrame, counted: Column) -> tuple[DataFrame, int]:
    """A stored copy of ``df``, and a count of its rows that is taken while they are written."""
    seen = Observation()
    copy = cut_lineage(df.observe(seen, F.coalesce(F.sum(counted.cast("bigint")), F.lit(0)).alias("n")))
    return copy, seen.get["n"]


def _roots(parent: DataFrame) -> DataFrame:
    """(node, root) from (node, parent) trees whose roots are their own parents, by pointer doubling."""
    current, moved = cut_lineage(parent), 1
    while moved:
        up = current.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = current.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
        jumped, moved = _stored(step, F.col("moved"))
        drop_stored(current)
        current = jumped.select("node", "parent")
    return current.withColumnRenamed("parent", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its smallest node.

    Every component selects its smallest outgoing edge, in the order of the edges' ends; where two
    select the same edge, the smaller one stays a root. The trees collapse by pointer doubling, the
    edges are relabelled, loops and repeats dropped, and so on until no edge remains. Every round
    at least halves the components that have edges. Null ends and loops link nothing (a node with
    no other link has no row); repeated edges count once.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left, some = _stored(edges.distinct(), F.lit(1))
    member: DataFrame | None = None
    while some:
        ends = left.select(F.col("a").alias("node"), F.struct("a", "b").alias("edge")).unionByName(left.select(F.col("b").alias("node"), F.struct("a", "b").alias("edge")))
        chosen = ends.groupBy("node").agg(F.min("edge").alias("edge"))
        # The far end is the parent. An edge chosen from both sides, twice at most, makes its smaller end a root.
        twice = F.count(F.lit(1)).over(Window.partitionBy("edge")) > 1
        far = F.when(F.col("node") == F.col("edge.a"), F.when(twice, F.col("node")).otherwise(F.col("edge.b"))).otherwise(F.col("edge.a"))
        root = _roots(chosen.select("node", far.alias("parent")))
        a = root.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        merged = left.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        fresh, some = _stored(merged, F.lit(1))
        if member is None:
            moved = root.select("node", F.col("root").alias("component"))  # the stored roots themselves
        else:
            step = root.select(F.col("node").alias("component"), "root")
            moved = cut_lineage(member.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
            drop_stored(member)
            drop_stored(root)
        drop_stored(left)
        left, member = fresh, moved
    if member is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = member.groupBy("component").agg(F.min("node").alias("least"))
    return member.join(least, "component").select("node", F.col("least").alias("component"))


def clean_path(path: Column) -> Column:
    """One spelling of a relative path: blanks, backslashes, empty, ``.`` and ``..`` parts resolved.

    Leading ``..`` beyond the root are dropped. Letter case stays. Null stays null.
    """
    parts = F.split(F.regexp_replace(F.trim(F.regexp_replace(path, r"^\s+|\s+$", "")), r"\\", "/"), "/")
    kept = F.filter(parts, lambda p: ~p.isin("", "."))
    walked = F.aggregate(kept, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walked, "/")


def finding_groups(findings: DataFrame) -> DataFrame:
    """finding_id, group_id of the findings linked to at least one other.

    Two are linked if they name the same own file, or the same file of the same upstream project.
    Blanks around and case of project names are ignored. A null, or a path that is empty once
    cleaned, names no file; repeated rows count once; extra columns are ignored.
    """
    project = F.lower(F.regexp_replace("upstream_project", r"^\s+|\s+$", ""))
    named = findings.where("finding_id is not null").select("finding_id", clean_path(F.col("gcc_path")).alias("own"), project.alias("project"), clean_path(F.col("upstream_relpath")).alias("path"))
    keys = named.where("own <> ''").select("finding_id", F.lit("").alias("project"), F.col("own").alias("path")).unionByName(named.where("path <> '' and project <> ''").select("finding_id", "project", "path"))
    keys = cut_lineage(keys.distinct())
    # Each file links its findings to the smallest of them: as many edges as rows, however many share it.
    head = keys.groupBy("project", "path").agg(F.min("finding_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = keys.join(head, ["project", "path"]).select(F.col("finding_id").alias("a"), F.col("head").alias("b"))
    return components(edges).select(F.col("node").alias("finding_id"), F.col("component").alias("group_id"))
