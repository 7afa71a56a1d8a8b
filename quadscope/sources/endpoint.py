"""Quads of a SPARQL endpoint, as a data source of Spark (``spark.read.format("sparql")``).

The driver asks for the graphs and their sizes; every graph is read in pages of ``page`` triples, a task a
page, so no answer is unbounded and a lost task asks again for its own page only.  Pages need an order that
the endpoint keeps: it is asked for by ``ORDER BY``, unless ``order`` is false.  A request that fails is
repeated after ``wait`` seconds, ``tries`` times in all.

Labels of blank nodes are those of the endpoint, which has to keep them over its answers.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .rdf_text import SCHEMA, as_quads


@dataclass
class Page(InputPartition):
    graph: str
    offset: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.page, self.tries, self.wait = int(options.get("page", 100_000)), int(options.get("tries", 3)), float(options.get("wait", 60))
        self.graphs = json.loads(options.get("graphs", "[]"))
        self.order = " ORDER BY ?s ?p ?o" if options.get("order", "true").lower() == "true" else ""
        self.headers = {"Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded", "User-Agent": "quadscope"}
        if options.get("user"):
            self.headers["Authorization"] = "Basic " + base64.b64encode(f"{options['user']}:{options.get('password', '')}".encode()).decode()

    def ask(self, query: str) -> list[dict]:
        for left in reversed(range(self.tries)):
            try:
                asked = urllib.request.Request(self.url, urllib.parse.urlencode({"query": query}).encode(), self.headers)
                with urllib.request.urlopen(asked, timeout=600) as answer:
                    return json.load(answer)["results"]["bindings"]
            except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError):
                if not left:
                    raise
                time.sleep(self.wait)
        raise ValueError("at least one try is needed")

    def partitions(self) -> list[Page]:
        graphs = self.graphs or [r["g"]["value"] for r in self.ask("SELECT DISTINCT ?g { GRAPH ?g { ?s ?p ?o } }")]
        sizes = {g: int(self.ask(f"SELECT (COUNT(*) AS ?n) {{ GRAPH <{g}> {{ ?s ?p ?o }} }}")[0]["n"]["value"]) for g in graphs}
        return [Page(g, at) for g, n in sizes.items() for at in range(0, n, self.page)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # an endpoint without triples
            return
        scope = hashlib.md5(self.url.encode()).hexdigest()[:8]

        def term(x: dict) -> tuple[str, str]:
            return (f"{scope}_{x['value']}", "bnode") if x["type"] == "bnode" else (x["value"], "iri" if x["type"] == "uri" else "literal")

        for r in self.ask(f"SELECT ?s ?p ?o {{ GRAPH <{partition.graph}> {{ ?s ?p ?o }} }}{self.order} LIMIT {self.page} OFFSET {partition.offset}"):
            o = r["o"]
            yield (partition.graph, *term(r["s"]), r["p"]["value"], *term(o), o.get("datatype"), o.get("xml:lang"))


class Endpoint(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def read(spark: SparkSession, url: str, graphs: list[str] | None = None, **options) -> DataFrame:
    """Quads of the endpoint's graphs, or of those named."""
    spark.dataSource.register(Endpoint)
    return as_quads(spark.read.format("sparql").options(url=url, graphs=json.dumps(graphs or []), **options).load())
