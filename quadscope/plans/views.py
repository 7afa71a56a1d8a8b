"""Views of a document's statements (s, p, o): schema rows, diagrams, CURIEs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import RDF, SD, VOID, VOID_EXT

#: Classes of reified statements, which diagrams leave out.
REIFICATION = (RDF + "Statement",)


def _p(rows: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return rows.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def _class_properties(rows: DataFrame) -> DataFrame:
    """(cp, subject_class, pp, prop)."""
    return _p(rows, VOID + "class", "cp", "subject_class").join(_p(rows, VOID + "propertyPartition", "cp", "pp"), "cp").join(_p(rows, VOID + "property", "pp", "prop"), "pp")


def schema_triples(rows: DataFrame) -> DataFrame:
    """(subject_class, prop, object_class, object_datatype): what properties of a class point at; a
    property that points at neither a class nor a literal keeps a row of nulls."""
    classes = _p(rows, VOID + "classPartition", "pp", "t").join(_p(rows, VOID + "class", "t", "object_class"), "t").select("pp", "object_class", F.lit(None).cast("string").alias("object_datatype"))
    datatypes = _p(rows, VOID_EXT + "datatypePartition", "pp", "t").join(_p(rows, VOID_EXT + "datatype", "t", "object_datatype"), "t").select("pp", F.lit(None).cast("string").alias("object_class"), "object_datatype")
    own = _class_properties(rows).join(classes.unionByName(datatypes), "pp", "left").select("subject_class", "prop", "object_class", "object_datatype")
    return own.unionByName(_linksets(rows).select("subject_class", "prop", "object_class", F.lit(None).cast("string").alias("object_datatype"))).distinct()


def _linksets(rows: DataFrame) -> DataFrame:
    found = _p(rows, VOID + "subjectsTarget", "ls", "a").join(_p(rows, VOID + "objectsTarget", "ls", "b"), "ls").join(_p(rows, VOID + "linkPredicate", "ls", "prop"), "ls")
    return found.join(_p(rows, VOID + "class", "a", "subject_class"), "a").join(_p(rows, VOID + "class", "b", "object_class"), "b")


def schema_triples_counts(rows: DataFrame) -> DataFrame:
    """The same with the number of subjects and, for classes, of objects."""
    entities = lambda s, n: _p(rows, VOID + "entities", s, n).withColumn(n, F.col(n).cast("long"))
    classes = _p(rows, VOID + "classPartition", "pp", "t").join(_p(rows, VOID + "class", "t", "object_class"), "t").join(_p(rows, VOID + "triples", "t", "n"), "t")
    classes = classes.select("pp", "object_class", F.col("n").cast("long").alias("objects_count"), F.lit(None).cast("string").alias("object_datatype"))
    datatypes = _p(rows, VOID_EXT + "datatypePartition", "pp", "t").join(_p(rows, VOID_EXT + "datatype", "t", "object_datatype"), "t").select("pp", "object_datatype")
    own = _class_properties(rows).join(entities("cp", "subjects_count"), "cp").join(classes.unionByName(datatypes, allowMissingColumns=True), "pp", "left")
    across = _linksets(rows).join(entities("a", "subjects_count"), "a").join(entities("b", "objects_count"), "b")
    names = ["subjects_count", "subject_class", "prop", "object_class", "objects_count"]
    return own.select(*names, "object_datatype").unionByName(across.select(*names, F.lit(None).cast("string").alias("object_datatype"))).distinct()


def curie(df: DataFrame, column: str, prefixes: DataFrame, name: str) -> DataFrame:
    """Add ``name``: ``column`` shortened by the longest namespace that it goes beyond, else itself.
    ``prefixes`` (prefix, namespace) is a list of well-known names; only distinct IRIs meet it."""
    iris = df.select(F.col(column).alias("_iri")).distinct()
    fits = iris.join(F.broadcast(prefixes), F.col("_iri").startswith(F.col("namespace")) & (F.col("_iri") != F.col("namespace")))
    best = fits.groupBy("_iri").agg(F.max(F.struct(F.length("namespace").alias("n"), F.col("prefix").alias("prefix"))).alias("b"))
    best = best.select("_iri", F.concat("b.prefix", F.lit(":"), F.substring("_iri", F.col("b.n") + 1, F.length("_iri"))).alias("_short"))
    return df.join(best, F.col(column) == F.col("_iri"), "left").withColumn(name, F.coalesce("_short", column)).drop("_iri", "_short")


def schema_rows(rows: DataFrame) -> DataFrame:
    """(graph, class_from, prop, class_to, datatype_to, triples), the basis of all diagrams; a class as
    target must have a partition of its own in the graph."""
    base = _p(rows, SD + "graph", "s", "graph").select("graph").distinct().join(_p(rows, VOID + "classPartition", "graph", "cp"), "graph")
    base = base.join(_class_properties(rows), "cp").join(_p(rows, VOID + "triples", "pp", "n"), "pp").select("graph", "pp", F.col("subject_class").alias("class_from"), "prop", F.col("n").cast("long").alias("triples"))
    data = base.join(_p(rows, VOID_EXT + "datatypePartition", "pp", "t"), "pp").join(_p(rows, VOID_EXT + "datatype", "t", "datatype_to"), "t")
    own = _p(rows, VOID + "classPartition", "graph", "c3").join(_p(rows, VOID + "class", "c3", "class_to"), "c3").select("graph", "class_to").distinct()
    linked = base.join(_p(rows, VOID + "classPartition", "pp", "t"), "pp").join(_p(rows, VOID + "class", "t", "class_to"), "t").join(own, ["graph", "class_to"])
    names = ["graph", "class_from", "prop", "class_to", "datatype_to", "triples"]
    none = F.lit(None).cast("string")
    return data.withColumn("class_to", none).select(names).unionByName(linked.withColumn("datatype_to", none).select(names)).distinct()


def schema_rows_curie(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    found = schema_rows(rows)
    for column, name in (("class_from", "from_id"), ("class_to", "to_class_id"), ("datatype_to", "to_datatype_id"), ("prop", "prop_id"), ("graph", "graph_id")):
        found = curie(found, column, prefixes, name)
    return found.orderBy("class_from", "class_to", "datatype_to", "graph", "triples")


def schema_rollup(rows: DataFrame) -> DataFrame:
    """(class_from, class_to, datatype_to, prop, triples), summed over graphs."""
    return schema_rows(rows).groupBy("class_from", "class_to", "datatype_to", "prop").agg(F.sum("triples").alias("triples")).orderBy("class_from", "class_to", "datatype_to", "prop")


def document_graphs(rows: DataFrame) -> DataFrame:
    return _p(rows, SD + "graph", "g", "gn").select("g").distinct()


def vis_nodes(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(id, label, grp, value): a node a class and graph, its value the number of digits of its triples."""
    found = _vis(rows, prefixes)
    return found.groupBy("id").agg(F.any_value("label").alias("label"), F.any_value("grp").alias("grp"), F.length(F.sum("triples").cast("string")).alias("value"))


def _vis(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    found = schema_rows(rows).where("class_to is not null").where(~F.col("class_from").isin(*REIFICATION) & ~F.col("class_to").isin(*REIFICATION))
    for column, name in (("class_from", "label"), ("class_to", "to_label"), ("prop", "prop_label"), ("graph", "_graph")):
        found = curie(found, column, prefixes, name)
    grp = F.when(F.col("_graph") == F.col("graph"), F.md5("graph")).otherwise(F.col("_graph"))
    return found.withColumn("grp", grp).withColumns({"id": F.concat("label", F.lit("-"), "grp"), "to_id": F.concat("to_label", F.lit("-"), "grp")})


def vis_edges(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(from_id, to_id, label, value)."""
    return _vis(rows, prefixes).groupBy("id", "to_id", "prop_label").agg(F.length(F.sum("triples").cast("string")).alias("value")).select(F.col("id").alias("from_id"), "to_id", F.col("prop_label").alias("label"), "value")


def vis_json(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """One row ``all_edges``: nodes and edges as the text of a script.  It is a picture's worth of rows."""
    nodes = vis_nodes(rows, prefixes).select(F.concat(F.lit("{id:'"), "id", F.lit("', label:'"), "label", F.lit("', group:'"), "grp", F.lit("', value:'"), F.col("value").cast("string"), F.lit("', shape:'box'}")).alias("t"))
    edges = vis_edges(rows, prefixes).select(F.concat(F.lit("{from:'"), "from_id", F.lit("', to:'"), "to_id", F.lit("', value:'"), F.col("value").cast("string"), F.lit("', arrows: 'to', label:'"), "label", F.lit("'}")).alias("t"))
    both = nodes.withColumn("k", F.lit(0)).unionByName(edges.withColumn("k", F.lit(1)))
    listed = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("t")))), ", ")
    text = both.agg(listed(0).alias("n"), listed(1).alias("e"))
    return text.select(F.concat(F.lit("nodes = ["), "n", F.lit("]; edges = ["), F.when(F.col("e") == "", " ").otherwise(F.col("e")), F.lit("]")).alias("all_edges"))
