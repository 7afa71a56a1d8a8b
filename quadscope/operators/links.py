"""Links between classes: triples of a class property whose object has a class, in any graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import TYPE
from .schema import by_object, class_triples, typed


def links(rows: DataFrame, quads: DataFrame, keep=None, known: list[str] | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Of ``class_triples``: (g, class, p, tg, tclass, triples) for every target graph and class.
    ``known`` restricts the target classes, ``targets`` the target graphs (a frame with ``g``)."""
    to = typed(quads, keep).select(F.col("g").alias("tg"), F.col("s").alias("o"), F.col("class").alias("tclass"))
    to = to.where(F.col("tclass").isin(*known)) if known is not None else to
    to = to.join(targets.select(F.col("g").alias("tg")), "tg", "left_semi") if targets is not None else to
    return by_object(rows).join(to, "o").groupBy("g", "class", "p", "tg", "tclass").agg(F.sum("m").alias("triples"))


def links_same_graph(rows: DataFrame, quads: DataFrame, tclass: str | None = None) -> DataFrame:
    """Links inside each graph, to all target classes or one."""
    to = typed(quads, F.col("class") == tclass if tclass else None).select("g", F.col("s").alias("o"), F.col("class").alias("tclass"))
    return by_object(rows).join(to, ["g", "o"]).groupBy("g", "class", "p", "tclass").agg(F.sum("m").alias("triples"))


def links_to_graph(rows: DataFrame, quads: DataFrame, graph: str, known: list[str] | None = None) -> DataFrame:
    """Links of other graphs into one."""
    return links(rows.where(F.col("g") != graph), quads.where(F.col("g") == graph), known=known)


def links_three_graphs(quads: DataFrame, source: str, linking: str, target: str) -> DataFrame:
    """Links where the subject's type, the link and the object's type stand in three given graphs:
    (class, p, tclass, triples)."""
    one = quads.where(F.col("g") == linking).withColumn("g", F.lit(source))
    rows = class_triples(quads.where((F.col("g") == source) & (F.col("p") == TYPE)).unionByName(one.where(F.col("p") != TYPE)))
    return links(rows, quads.where(F.col("g") == target)).groupBy("class", "p", "tclass").agg(F.sum("triples").alias("triples"))


def property_classes(quads: DataFrame, keep=None) -> DataFrame:
    """(g, p, class, triples): the classes, in the same graph, of what a property points at, whatever the
    class of its subjects.  Triples are summed by object before the join."""
    to = typed(quads, keep).select("g", F.col("s").alias("o"), "class")
    rows = quads.where((F.col("p") != TYPE) & (F.col("o_kind") != "literal")).groupBy("g", "p", "o").agg(F.count("*").alias("m"))
    return rows.join(to, ["g", "o"]).groupBy("g", "p", "class").agg(F.sum("m").alias("triples"))
