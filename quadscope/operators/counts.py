"""Counts of triples and distinct terms, per graph and over the union of all graphs.

Quads are a set per graph, so triples are counted by rows; the total over graphs is their sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import SYSTEM_GRAPHS
from ..sources import store

MEASURES = ("iri_subjects", "bnode_subjects", "iri_objects", "bnode_objects", "literal_objects")
KEPT = "measure string, term binary, g string"


def graphs(quads: DataFrame) -> DataFrame:
    return quads.select("g").distinct()


def only_graphs(quads: DataFrame, names: list[str] | None = None, system: tuple[str, ...] = SYSTEM_GRAPHS) -> DataFrame:
    """Without a store's own graphs; with ``names``, only those graphs."""
    quads = quads.where(~F.col("g").isin(*system)) if system else quads
    return quads.where(F.col("g").isin(*names)) if names else quads


def triples_per_graph(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g").agg(F.count("*").alias("triples"))


def total_triples(quads: DataFrame) -> DataFrame:
    return quads.agg(F.count("*").alias("triples"))


def distinct_terms(quads: DataFrame, role: str, kind: str | None = None, by_graph: bool = False, name: str | None = None) -> DataFrame:
    """Distinct subjects (``role`` s) or objects (o) of one kind, in all graphs together or in each.
    Graphs without such a term are not left out."""
    term = F.col("s") if role == "s" else F.col("o_key")
    if kind:
        term = F.when(F.col(f"{role}_kind") == kind, term)
    elif role == "s":
        term = F.struct("s_kind", "s")
    name = name or ("subjects" if role == "s" else "objects")
    return (quads.groupBy("g") if by_graph else quads).agg(F.count_distinct(term).alias(name))


def subjects_and_objects(quads: DataFrame, by_graph: bool = False) -> DataFrame:
    """Distinct subjects and distinct objects, whatever their kind, in one scan."""
    return (quads.groupBy("g") if by_graph else quads).agg(F.count_distinct(F.struct("s_kind", "s")).alias("subjects"), F.count_distinct("o_key").alias("objects"))


def per_predicate(quads: DataFrame, role: str) -> DataFrame:
    """Distinct subjects or objects of every property of every graph."""
    term = F.struct("s_kind", "s") if role == "s" else F.col("o_key")
    return quads.groupBy("g", "p").agg(F.count_distinct(term).alias("n"))


def distinct_by_graph(quads: DataFrame, subjects: bool = True, objects: bool = True) -> DataFrame:
    """(g, measure, term): the distinct terms of every graph by role and kind, each named by 128 bits.  It
    is the mergeable form of the distinct counts: those of any set of graphs follow from it."""
    name = lambda c: F.unhex(F.md5(c))
    roles = []
    if subjects:
        roles.append(F.struct(F.concat("s_kind", F.lit("_subjects")).alias("measure"), name("s").alias("term")))
    if objects:
        roles.append(F.struct(F.concat("o_kind", F.lit("_objects")).alias("measure"), name("o_key").alias("term")))
    if not roles:
        return quads.select("g", F.lit("").alias("measure"), F.lit(b"").alias("term")).where(F.lit(False))
    return quads.select("g", F.explode(F.array(*roles)).alias("t")).select("g", "t.measure", "t.term").distinct()


def kept_terms(quads: DataFrame, path: str, force: bool = False) -> DataFrame:
    """``distinct_by_graph``, kept at ``path`` (parquet by graph): graphs that stand there already are not
    looked at again unless ``force`` is set."""
    spark = quads.sparkSession
    if force or not store.exists(spark, path):
        distinct_by_graph(quads).write.mode("overwrite").partitionBy("g").parquet(path)
    else:
        new = quads.join(spark.read.schema(KEPT).parquet(path).select("g").distinct(), "g", "left_anti")
        distinct_by_graph(new).write.mode("append").partitionBy("g").parquet(path)
    return spark.read.schema(KEPT).parquet(path).join(graphs(quads), "g", "left_semi")


def graph_summary(quads: DataFrame, terms: DataFrame | None = None, subjects: bool = True, objects: bool = True, classes: bool = True) -> DataFrame:
    """(g, is_default, triples, five distinct counts, subjects, objects, classes): a row a graph, and the
    row of all graphs together (g null).  What is switched off is not computed and counts as 0.

    The distinct terms of every graph are made once; the counts of each graph, and those of the union after
    a second distinct of fewer rows, are aggregates of them.
    """
    from .schema import typed

    triples = quads.groupBy("g").agg(F.count("*").alias("triples"))
    none = F.lit(None).cast("string").alias("g")
    rows = triples.withColumn("is_default", F.lit(0)).unionByName(triples.agg(F.sum("triples").alias("triples")).select(none, "triples", F.lit(1).alias("is_default")))
    if subjects or objects:
        terms = distinct_by_graph(quads, subjects, objects) if terms is None else terms
        each = [F.count(F.when(F.col("measure") == m, 1)).alias(m) for m in MEASURES]
        counts = terms.groupBy("g").agg(*each).withColumn("d", F.lit(0)).unionByName(terms.select("measure", "term").distinct().agg(*each).select(none, *MEASURES, F.lit(1).alias("d")))
        rows = rows.join(counts.withColumnRenamed("g", "cg"), F.col("g").eqNullSafe(F.col("cg")) & (F.col("is_default") == F.col("d")), "left").drop("cg", "d")
        on = [m for m in MEASURES if m.endswith("_subjects") and subjects or m.endswith("_objects") and objects]
    else:
        on = []
    if classes:
        held = typed(quads).groupBy("g").agg(F.count_distinct("class").alias("classes"))
        rows = rows.join(held.withColumnRenamed("g", "kg"), F.col("g") == F.col("kg"), "left").drop("kg")
    number = lambda c, there: (F.coalesce(c, F.lit(0)) if there else F.lit(0)).cast("long")
    rows = rows.withColumns({"triples": number("triples", True), "classes": number("classes", classes)} | {m: number(m, m in on) for m in MEASURES})
    rows = rows.withColumns({"subjects": F.col("iri_subjects") + F.col("bnode_subjects"), "objects": F.col("iri_objects") + F.col("bnode_objects") + F.col("literal_objects")})
    return rows.select("g", "is_default", "triples", *MEASURES, "subjects", "objects", "classes")


def distinct_ids(rows: DataFrame, ids: str, *by: str) -> DataFrame:
    """Exact distinct counts of non-negative 64-bit ids with bitmaps: one bitmap a bucket of ids, built
    before the shuffle, OR-ed after it."""
    n = F.col(ids)
    buckets = rows.where(n.isNotNull()).groupBy(*by, F.bitmap_bucket_number(n).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("_bits"))
    return buckets.groupBy(*by).agg(F.sum(F.bitmap_count("_bits")).alias("n"))


def bitmaps(rows: DataFrame, ids: str, *by: str) -> DataFrame:
    """(by…, bucket, bits): the bitmaps themselves, to be kept and merged with those of other data."""
    n = F.col(ids)
    return rows.where(n.isNotNull()).groupBy(*by, F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def merged_ids(maps: DataFrame, *by: str) -> DataFrame:
    """Distinct counts of kept bitmaps, OR-ed over whatever is not in ``by``."""
    return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n"))
