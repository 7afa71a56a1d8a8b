"""Schema discovery: properties, classes, class properties, datatypes and named individuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import NAMED_INDIVIDUAL, TYPE


def typed(quads: DataFrame, keep: str | Column | None = None) -> DataFrame:
    """(g, s, class), distinct; classes are IRIs.  ``keep`` is a condition over ``class``, e.g.
    ``"not startswith(class, 'http://www.w3.org/')"``."""
    rows = quads.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri")).select("g", "s", F.col("o").alias("class"))
    rows = rows.where(keep) if keep is not None else rows
    return rows  # quads are a set, so these rows are


def predicates(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g", "p").agg(F.count("*").alias("triples"))


def predicate_stats(quads: DataFrame) -> DataFrame:
    """(g, p, triples, subjects, objects)."""
    return quads.groupBy("g", "p").agg(F.count("*").alias("triples"), F.count_distinct(F.struct("s_kind", "s")).alias("subjects"), F.count_distinct("o_key").alias("objects"))


def classes(quads: DataFrame, keep=None) -> DataFrame:
    return typed(quads, keep).groupBy("g", "class").agg(F.count("*").alias("entities"))


def distinct_classes(quads: DataFrame, keep=None) -> DataFrame:
    return typed(quads, keep).select("g", "class").distinct()


def class_member_count(quads: DataFrame, name: str) -> DataFrame:
    """Members of one class in each graph that has any."""
    return typed(quads, F.col("class") == name).groupBy("g", "class").agg(F.count("*").alias("entities"))


def class_triples(quads: DataFrame, keep=None) -> DataFrame:
    """(g, s, class, p, o, o_kind, o_dt, o_key): every triple but the types, once for each class of its
    subject.  It is the join under all class-property operators; persist it where several of them run."""
    rest = quads.where(F.col("p") != TYPE).select("g", "s", "p", "o", "o_kind", "o_dt", "o_key")
    return typed(quads, keep).join(rest, ["g", "s"]).select("g", "s", "class", "p", "o", "o_kind", "o_dt", "o_key")


def class_property(rows: DataFrame) -> DataFrame:
    """Of ``class_triples``: (g, class, p, triples)."""
    return rows.groupBy("g", "class", "p").agg(F.count("*").alias("triples"))


def class_property_stats(rows: DataFrame) -> DataFrame:
    """Of ``class_triples``: (g, class, p, triples, subjects, objects).  Rows of a subject lie together
    after the join on it, so only the distinct objects are shuffled."""
    by_subject = rows.groupBy("g", "s", "class", "p").agg(F.count("*").alias("m")).groupBy("g", "class", "p").agg(F.sum("m").alias("triples"), F.count("*").alias("subjects"))
    objects = rows.select("g", "class", "p", "o_key").distinct().groupBy("g", "class", "p").agg(F.count("*").alias("objects"))
    return by_subject.join(objects, ["g", "class", "p"])


def class_property_datatypes(rows: DataFrame) -> DataFrame:
    """Of ``class_triples``: (g, class, p, datatype, triples), over all literals."""
    return rows.where(F.col("o_kind") == "literal").groupBy("g", "class", "p", F.col("o_dt").alias("datatype")).agg(F.count("*").alias("triples"))


def named_individuals(rows: DataFrame, quads: DataFrame) -> DataFrame:
    """Of ``class_triples``: (g, class, p, individual, triples), over objects that are named individuals
    of the same graph.  Triples are summed by object before the join."""
    targets = typed(quads, F.col("class") == NAMED_INDIVIDUAL).select("g", F.col("s").alias("o"))
    return by_object(rows).where(F.col("o_kind") == "iri").join(targets, ["g", "o"]).groupBy("g", "class", "p", F.col("o").alias("individual")).agg(F.sum("m").alias("triples"))


def by_object(rows: DataFrame) -> DataFrame:
    """Of ``class_triples``: links counted by object.  A hub is one row a property here, so the joins on
    objects are not skewed by its in-degree."""
    return rows.where(F.col("o_kind") != "literal").groupBy("g", "class", "p", "o", "o_kind").agg(F.count("*").alias("m"))


def class_examples(quads: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` IRIs of every class of every graph."""
    members = quads.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri") & (F.col("s_kind") == "iri")).select("g", F.col("o").alias("class"), "s")
    from pyspark.sql import Window

    # the row-number filter becomes a group limit before the shuffle
    first = members.withColumn("k", F.row_number().over(Window.partitionBy("g", "class").orderBy("s"))).where(F.col("k") <= n)
    return first.select("g", "class", "s")


def property_example(rows: DataFrame) -> DataFrame:
    """Of ``class_triples``: the least IRI object of every class property."""
    return rows.where(F.col("o_kind") == "iri").groupBy("g", "class", "p").agg(F.min("o").alias("o"))
