"""The whole profile: eight aggregates over the quads."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counts, links, schema
from ..sources import store


@dataclass
class Options:
    """What is computed and how the document is named.  ``class_filter`` is a SQL condition over ``class``
    that keeps a class, e.g. ``"not startswith(class, 'http://www.w3.org/2002/07/owl#')"``.  Titles and
    licences (IRIs) of graphs are given by graph.  With ``values_by_class`` off, partitions of datatypes and
    individuals are named by graph, property and value, so classes share them."""

    void_iri: str = "http://example.org/.well-known/void"
    endpoint: str = "http://example.org/sparql"
    graphs: list[str] | None = None
    class_filter: str | None = None
    count_subjects: bool = True
    count_objects: bool = True
    find_classes: bool = True
    find_predicates: bool = True
    detailed: bool = True
    title: str | None = None
    version: str | None = None
    release_date: str | None = None
    graph_titles: dict[str, str] = field(default_factory=dict)
    graph_licenses: dict[str, str] = field(default_factory=dict)
    values_by_class: bool = True

    def __post_init__(self) -> None:
        if not self.void_iri or not self.endpoint:
            raise ValueError("the IRIs of the document and of the endpoint are needed")
        if self.release_date is not None:
            date.fromisoformat(self.release_date)

    @property
    def base(self) -> str:
        """The document's IRI with one # at its end."""
        return self.void_iri.rstrip("#") + "#"


class Profile:
    """Lazy tables of one set of quads.  The join of types and triples, which four of them share, is kept
    after ``persist()`` (on disk where memory is short); nothing else is."""

    def __init__(self, quads: DataFrame, options: Options | None = None, terms: str | None = None, force: bool = False):
        """``terms`` is a folder for the distinct terms of graphs, which later profiles reuse unless ``force``."""
        self.options = options or Options()
        self.quads = counts.only_graphs(quads, self.options.graphs)
        self.terms, self.force = terms, force

    def persist(self) -> Profile:
        self.quads = self.quads.persist(StorageLevel.MEMORY_AND_DISK)
        self.class_triples = self.class_triples.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        self.class_triples.unpersist()
        self.quads.unpersist()

    @cached_property
    def class_triples(self) -> DataFrame:
        return schema.class_triples(self.quads, self.options.class_filter)

    def _none(self, df: DataFrame, wanted: bool) -> DataFrame:
        return df if wanted else df.where(F.lit(False))

    @cached_property
    def summary(self) -> DataFrame:
        o = self.options
        wanted = o.count_subjects or o.count_objects
        terms = counts.kept_terms(self.quads, self.terms, self.force) if self.terms and wanted else None
        df = counts.graph_summary(self.quads, terms, o.count_subjects, o.count_objects, o.find_classes and o.class_filter is None)
        if o.find_classes and o.class_filter is not None:
            kept = self.classes.groupBy("g").agg(F.count("*").alias("_classes"))
            df = df.join(kept, "g", "left").withColumn("classes", F.coalesce("_classes", F.lit(0))).drop("_classes")
        return df

    @cached_property
    def predicates(self) -> DataFrame:
        return self._none(schema.predicate_stats(self.quads), self.options.find_predicates)

    @cached_property
    def classes(self) -> DataFrame:
        return self._none(schema.classes(self.quads, self.options.class_filter), self.options.find_classes)

    @property
    def _pairs(self) -> bool:
        return self.options.detailed and self.options.find_classes and self.options.find_predicates

    @cached_property
    def class_property(self) -> DataFrame:
        return self._none(schema.class_property_stats(self.class_triples), self._pairs)

    @cached_property
    def datatypes(self) -> DataFrame:
        return self._none(schema.class_property_datatypes(self.class_triples), self._pairs)

    @cached_property
    def individuals(self) -> DataFrame:
        return self._none(schema.named_individuals(self.class_triples, self.quads), self._pairs)

    @cached_property
    def links(self) -> DataFrame:
        return self._none(links.links(self.class_triples, self.quads, self.options.class_filter), self._pairs)

    @cached_property
    def property_classes(self) -> DataFrame:
        return self._none(links.property_classes(self.quads, self.options.class_filter), self._pairs)

    def tables(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in ("summary", "predicates", "classes", "class_property", "datatypes", "individuals", "links", "property_classes")}

    def materialise(self) -> dict[str, DataFrame]:
        """The tables, each computed once and written to the shared folder."""
        path = f"{store.shared_dir(self.quads.sparkSession)}/profile-{uuid.uuid4().hex}"
        self.write(path)
        return {name: self.quads.sparkSession.read.parquet(f"{path}/{name}.parquet") for name in self.tables()}

    def write(self, path: str) -> None:
        tables = self.tables()
        with ThreadPoolExecutor(4) as pool:  # they do not depend on one another
            list(pool.map(lambda name: tables[name].write.mode("overwrite").parquet(f"{path}/{name}.parquet"), tables))

