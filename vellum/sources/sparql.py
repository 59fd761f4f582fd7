"""A Spark data source for a SPARQL endpoint that answers GET requests with JSON results.

    spark.dataSource.register(SparqlDataSource)
    spark.read.format("sparql").options(endpoint=..., query=..., columns="person,label").load()

The query is a template. {limit} and {offset} make it paged; {columns} stands for the variables that are read, which a schema of some of
them narrows; {filters} stands for FILTER clauses, made of the conditions that Spark pushes down; it needs the setting spark.sql.python.filterPushdown.enabled.
Conditions on a template without {filters} are tested by Spark alone.

Pages are planned before anything is read where the option `count` has a query whose first value is the number of rows (it may have
{filters} too): a task a page. Without it `partitions` tasks take turns at pages until one is empty. A server may give less than it is asked for: a
page is asked on from where an answer ended until it is full, and it is an error if a planned page stays short. An answer of 429 or 5xx, or none, is asked for
again `retries` times, after `wait` seconds and then twice as long each time.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StringType, StructField, StructType

AGAIN = {429, 500, 502, 503, 504}


def fetch(endpoint: str, query: str, timeout: float = 60.0, retries: int = 0, wait: float = 1.0) -> dict:
    """The JSON answer; any status but 200 is an error, those of AGAIN after `retries` more attempts."""
    url = endpoint + ("&" if "?" in endpoint else "?") + urllib.parse.urlencode({"query": query, "format": "json"})
    request = urllib.request.Request(url, headers={"Accept": "application/sparql-results+json"})
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                if answer.status != 200:
                    raise RuntimeError(f"the endpoint answered {answer.status}")
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or attempt == retries:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError):
            if attempt == retries:
                raise
        time.sleep(wait * 2**attempt)
    raise AssertionError


def bindings(answer: dict, columns: list[str]) -> Iterator[tuple]:
    for row in answer.get("results", {}).get("bindings", []):
        yield tuple(row[c]["value"] if c in row else None for c in columns)


def literal(value: str) -> str:
    """A SPARQL string."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = value.replace(old, new)
    return f'"{value}"'


def clause(condition: Filter, columns: Iterable[str]) -> str | None:
    """The FILTER clause of a condition on one column, or None if there is none. Values are compared as strings, as IRIs and literals are both read so."""
    path = getattr(condition, "attribute", ())
    if len(path) != 1 or path[0] not in columns:
        return None
    var = f"?{path[0]}"
    if isinstance(condition, IsNotNull):
        return f"FILTER(BOUND({var}))"
    values = condition.value if isinstance(condition, In) else (getattr(condition, "value", None),)
    if not values or not all(isinstance(v, str) for v in values):
        return None
    if isinstance(condition, In):
        return f"FILTER(STR({var}) IN ({', '.join(map(literal, values))}))"
    if isinstance(condition, EqualTo):
        return f"FILTER(STR({var}) = {literal(values[0])})"
    for kind, name in ((StringStartsWith, "STRSTARTS"), (StringEndsWith, "STRENDS"), (StringContains, "CONTAINS")):
        if isinstance(condition, kind):
            return f"FILTER({name}(STR({var}), {literal(values[0])}))"
    return None


class Page(InputPartition):
    """Page number `first`, and if it is planned how many rows it has."""

    def __init__(self, first: int, rows: int | None = None) -> None:
        super().__init__(first)
        self.first, self.rows = first, rows


class SparqlReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str] | None = None) -> None:
        self.options, self.columns = options, columns or [c.strip() for c in options["columns"].split(",")]
        self.page, self.tasks = int(options.get("page", 10_000)), int(options.get("partitions", 1))
        self.clauses: list[str] = []

    def filled(self, template: str, limit: int = 0, offset: int = 0) -> str:
        values = {"{columns}": " ".join(f"?{c}" for c in self.columns), "{filters}": " ".join(self.clauses), "{limit}": str(limit), "{offset}": str(offset)}
        for name in ("{columns}", "{limit}", "{offset}", "{filters}"):  # what conditions hold is put in last
            template = template.replace(name, values[name])
        return template

    def ask(self, query: str) -> dict:
        o = self.options
        return fetch(o["endpoint"], query, float(o.get("timeout", 60)), int(o.get("retries", 3)), float(o.get("wait", 1)))

    def partitions(self) -> list[Page]:
        if "{offset}" not in self.options["query"] or "count" not in self.options:
            return [Page(i) for i in range(self.tasks)]
        answer = self.ask(self.filled(self.options["count"]))
        total = int(next(iter(answer["results"]["bindings"][0].values()))["value"])
        return [Page(i, min(self.page, total - i * self.page)) for i in range(-(-total // self.page))] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        query = self.options["query"]
        if "{offset}" not in query:
            if partition.first:
                return
            yield from bindings(self.ask(self.filled(query)), self.columns)
            return
        at = partition.first
        while True:
            got, wanted = 0, self.page if partition.rows is None else partition.rows
            while got < wanted:
                rows = list(bindings(self.ask(self.filled(query, wanted - got, at * self.page + got)), self.columns))
                yield from rows
                got += len(rows)
                if not rows:
                    break
            if partition.rows is not None:
                if got < wanted:
                    raise RuntimeError(f"page {at} has {got} rows of {wanted}")
                return
            if got < wanted:
                return
            at += self.tasks


class PushingReader(SparqlReader):
    """A reader of a template that takes conditions."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        every = [c.strip() for c in self.options["columns"].split(",")]
        for f in filters:
            made = clause(f, every)
            if made:
                self.clauses.append(made)
            else:
                yield f


class SparqlDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> StructType:
        return StructType([StructField(c.strip(), StringType()) for c in self.options["columns"].split(",")])

    def reader(self, schema: StructType) -> SparqlReader:
        kind = PushingReader if "{filters}" in self.options["query"] else SparqlReader
        return kind(self.options, schema.fieldNames())
