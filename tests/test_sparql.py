"""The SPARQL source against a local endpoint: conditions, columns, failures and short pages."""

import http.server
import json
import re
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

from vellum.sources import sparql

ROWS = [{"person": f"kg/p/{i}", "label": f'L"{i}\\' if i % 3 else None} for i in range(57)]


class Endpoint(http.server.BaseHTTPRequestHandler):
    asked: list[str] = []
    fail, cap = 0, 10**9

    def do_GET(self):
        query = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["query"][0]
        Endpoint.asked.append(query)
        if Endpoint.fail:
            Endpoint.fail -= 1
            self.send_error(503)
            return
        rows = ROWS
        for var, value in re.findall(r'FILTER\(STR\(\?(\w+)\) = "((?:[^"\\]|\\.)*)"\)', query):
            rows = [r for r in rows if r[var] == value.replace('\\"', '"').replace("\\\\", "\\")]
        for var in re.findall(r"FILTER\(BOUND\(\?(\w+)\)\)", query):
            rows = [r for r in rows if r[var] is not None]
        if "COUNT" in query:
            found = [{"n": {"value": str(len(rows))}}]
        else:
            limit, offset = (int(re.search(rf"{w} (\d+)", query)[1]) for w in ("LIMIT", "OFFSET"))
            named = re.search(r"SELECT (.*?) WHERE", query)[1].replace("?", "").split()
            found = [{c: {"value": r[c]} for c in named if r[c] is not None} for r in rows[offset : offset + min(limit, Endpoint.cap)]]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"results": {"bindings": found}}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def read(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Endpoint.asked, Endpoint.fail, Endpoint.cap = [], 0, 10**9
    spark.dataSource.register(sparql.SparqlDataSource)
    setting = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(setting, "true")
    base = {
        "endpoint": f"http://127.0.0.1:{server.server_port}/sparql", "query": "SELECT {columns} WHERE { ?person a ?x {filters} } LIMIT {limit} OFFSET {offset}", "columns": "person, label",
        "count": "SELECT (COUNT(*) AS ?n) WHERE { ?person a ?x {filters} }", "page": "10", "wait": "0.01"
    }

    def load(schema=None, without=(), **o):
        r = spark.read.format("sparql").options(**{k: v for k, v in (base | o).items() if k not in without})
        return (r.schema(schema) if schema else r).load()

    yield load
    spark.conf.unset(setting)
    server.shutdown()


WANT = sorted(((r["person"], r["label"]) for r in ROWS), key=str)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_pages_are_planned(read):
    frame = read()
    assert got(frame) == WANT and frame.rdd.getNumPartitions() == 6
    assert got(read(without=["count"], partitions="3")) == WANT


def test_conditions_reach_the_endpoint(read):
    value = 'L"4\\'
    assert got(read().filter(F.col("label") == value)) == [("kg/p/4", value)]
    pages = [q for q in Endpoint.asked if "LIMIT" in q]
    assert len(pages) == 1 and "FILTER(STR(?label)" in pages[0] and "FILTER(BOUND(?label))" in pages[0]
    assert got(read().filter("label IS NOT NULL AND length(person) > 6")) == [r for r in WANT if r[1] and len(r[0]) > 6]
    plain = "SELECT {columns} WHERE { ?person a ?x } LIMIT {limit} OFFSET {offset}"
    assert got(read(query=plain, count="SELECT (COUNT(*) AS ?n) WHERE { }").filter(F.col("label") == value)) == [("kg/p/4", value)]


def test_a_schema_narrows_the_variables(read):
    assert got(read(schema="person string")) == [(p,) for p, _ in WANT]
    assert all("?label" not in q for q in Endpoint.asked)


def test_failures_are_tried_again(read):
    Endpoint.fail = 2
    assert got(read()) == WANT
    Endpoint.fail = 100
    with pytest.raises(Exception, match="503"):
        read(retries="1").collect()
    Endpoint.fail = 0


def test_short_pages_are_asked_on(read):
    Endpoint.cap = 4
    assert got(read()) == WANT and got(read(without=["count"], partitions="2")) == WANT
    Endpoint.cap = 0
    with pytest.raises(Exception, match=r"page \d has 0 rows of \d+"):
        read().collect()


def test_clauses():
    columns = ["a"]
    assert sparql.clause(EqualTo(("a",), 'x"\n'), columns) == 'FILTER(STR(?a) = "x\\"\\n")'
    assert sparql.clause(In(("a",), ("x", "y")), columns) == 'FILTER(STR(?a) IN ("x", "y"))'
    assert sparql.clause(StringStartsWith(("a",), "x"), columns) == 'FILTER(STRSTARTS(STR(?a), "x"))'
    assert sparql.clause(IsNotNull(("a",)), columns) == "FILTER(BOUND(?a))"
    assert sparql.clause(EqualTo(("b",), "x"), columns) is None and sparql.clause(EqualTo(("a", "c"), "x"), columns) is None and sparql.clause(EqualTo(("a",), 3), columns) is None
