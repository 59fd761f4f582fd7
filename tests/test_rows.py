"""Rows with null and repeated ids, the two ways that spellings reach the rows, folds against sequential versions, the SPARQL source, and durable folders."""

import http.server
import json
import random
import re
import threading
import urllib.parse
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.operators import filters, normalize, spans, tag
from vellum.operators.rows import keyed, named
from vellum.sources.sparql import SparqlDataSource, fetch
from vellum.streaming import pipeline

ROWS = [(None, "hello olde world"), (1, "the olde"), (1, "again man"), (1, "again man"), (2, None), (3, ""), (None, "I O Neale haue")]


def texts(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string")


WORD = r"[A-Za-zÁÉÍÓÚáéíóú]+(?:['’][A-Za-zÁÉÍÓÚáéíóú]+)*"


def one_by_one(pre, spelling):
    """The normaliser's rules, token by token."""
    toks = re.findall(rf"{WORD}|\d+|\s+|.", pre, re.S)
    starts = [sum(map(len, toks[:i])) for i in range(len(toks))]
    out, at, i = "", [], 0
    clean = lambda w: re.sub("[^A-Za-zÁÉÍÓÚáéíóú'-]", "", w).lower()
    while i < len(toks):
        t, s = toks[i], starts[i]
        if i == 0 and t == "I":
            out, at = "I,", [0, 0]
        elif re.fullmatch(WORD, t):
            j = i + 1
            while j < len(toks) and (toks[j].isspace() or not re.search(r"\w", toks[j]) or toks[j] == "_"):
                j += 1
            name = spelling.get(toks[j], toks[j]) if j < len(toks) and re.fullmatch(WORD, toks[j]) else ""
            if t in ("O", "o", "Ó", "ó") and clean(name) in L.SURNAMES:
                out += f"{t}'{name}"
                at += [s, s] + [starts[j] + min(k, len(toks[j]) - 1) for k in range(len(name))]
                i = j
            else:
                new = spelling.get(t, t)
                new = new[0].upper() + new[1:].lower() if clean(new) in L.PLACE_NAMES else new
                out += new
                at += [s + min(k * (len(t) - 1) // max(len(new) - 1, 1), len(t) - 1) for k in range(len(new))]
        elif t.isspace():
            out += "\n" if "\n\n" in t else " "
            at.append(s)
        else:
            out += t
            at += range(s, s + len(t))
        i += 1
    return out, at


def test_normaliser_against_a_sequential_version(spark):
    rng = random.Random(1)
    words = [
        "O", "o", "Ó", "neale", "O'Neill", "Neill", "shea", "haue", "VLSTER", "corke", "I", "12", "-", ".", "_", " ", "  ", "\n\n", "\n",
        "é", "paide", "widget", "ſ"
    ]
    rows = [
        (i % 5 or None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))).replace("  ", rng.choice([" ", ""])))
        for i in range(120)
    ]
    df = texts(spark, rows)
    pre = [normalize.pre_normalize(F.col("text"))]
    pres = [r[0] for r in df.select(*pre).collect()]
    spelling = {r.tok: r.out for r in normalize.normalize_words(normalize.distinct_words(df.select(pre[0].alias("text")))).collect()}
    want = Counter()
    for (i, t), p in zip(rows, pres):
        text, at = one_by_one(p, spelling)
        want[i, t, text, tuple(at)] += 1
    got = Counter((r.doc_id, r.visual, r.normalized, tuple(r.char_map)) for r in normalize.normalize(df).collect())
    assert got == want


def test_normaliser_takes_each_row_for_itself(spark, monkeypatch):
    want = Counter(
        {(None, "hello old world"): 1, (1, "the old"): 1, (1, "again man"): 2, (2, None): 1, (3, ""): 1, (None, "I, O'Neill have"): 1}
    )
    got = lambda: Counter((r.doc_id, r.normalized) for r in normalize.normalize(texts(spark)).collect())
    assert got() == want
    monkeypatch.setattr(normalize, "SENT_WORDS", 0)  # the changed words are joined to the rows
    assert got() == want
    assert normalize.normalize(texts(spark, [])).count() == 0


def test_long_batches_are_packed_in_parts(spark, monkeypatch):
    from vellum.functions import strings

    df = texts(spark, [(i, "Ann Fox and O Neill haue it. " * i) for i in range(12)]).coalesce(1)
    whole = [normalize.normalize(df).collect(), normalize.tokens(df).collect()]
    assert len(whole[1]) == sum(len(re.findall(rf"{WORD}|\d+|\s+|.", r.visual, re.S)) for r in whole[0])
    monkeypatch.setattr(strings, "AT_ONCE", 20)
    found = strings.found_in(strings.TOKEN_HERE).func
    parts = found(pa.array(["a b", None, "c " * 30, "", "d"]))
    assert [len(x or ()) for x in parts.to_pylist()] == [3, 0, 60, 0, 1] and parts.to_pylist()[4] == [{"tok": "d", "start": 0, "kind": "word"}]


def test_analysis_takes_each_row_for_itself(spark):
    rows = [
        (None, "So John Smith met Cork."), (None, "And Mary Jones."), (1, "Then Ann Fox sat."), (1, "Then Ann Fox sat."), (2, None), (3, "")
    ]
    got = Counter((r.doc_id, r.text, r.label) for r in tag.analyze(texts(spark, rows)).collect())
    assert got == Counter(
        {(None, "So John Smith", "PER"): 1, (None, "Cork", "LOC"): 1, (None, "And Mary Jones", "PER"): 1, (1, "Then Ann Fox", "PER"): 2}
    )
    whole = pipeline.annotate(texts(spark, rows)).collect()
    assert Counter(r.doc_id for r in whole) == Counter({None: 3, 1: 2})
    keys, names = keyed(texts(spark, [(1, "a"), (2, "b")]), "doc_id", "text")
    assert names is None and named(keys, names) is keys


def merged_one_by_one(rows, full, max_gap, min_score):
    done = []
    for start, end, label, text, score in sorted(rows):
        if done and done[-1][2] == label and start < done[-1][1]:
            continue
        gap = full[done[-1][1] : start] if done else ""
        free = re.fullmatch(r"[\s'’.-]{0,3}|\s+oge\s+", gap, re.I)
        if done and done[-1][2] == label and start - done[-1][1] <= max_gap and min(score, done[-1][4]) >= min_score and free:
            a = done[-1]
            done[-1] = (a[0], end, label, full[a[0] : end], max(a[4], score))
        else:
            done.append((start, end, label, text, score))
    return done


def test_merge_of_any_spans_against_a_sequential_version(spark):
    rng = random.Random(2)
    full = "".join(rng.choice("abc .'-") for _ in range(200))
    rows, want = [], Counter()
    for doc in range(30):
        own = []
        for _ in range(rng.randint(0, 25)):
            a = rng.randrange(190)
            b = a + rng.randint(1, 9)
            own.append((a, b, rng.choice(["PER", "LOC"]), full[a:b], rng.choice([0.4, 0.6, 0.9])))
        rows += [(doc, t, label, s, a, b) for a, b, label, t, s in own]
        for a, b, label, t, s in merged_one_by_one(own, full, 3, 0.55):
            want[doc, a, b, label, t, s] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, score double, start int, end int").repartition(5)
    docs = spark.createDataFrame([(i, full) for i in range(30)], "doc_id long, full string")
    got = spans.merge_adjacent(df, docs, max_gap=3, min_score=0.55, extend_clipped_words=False)
    assert Counter((r.doc_id, r.start, r.end, r.label, r.text, r.score) for r in got.collect()) == want


def test_canonical_names(spark):
    rows = [("o’neill and O'brien",), ("XO'neill",), ("O'",), ("O'Neill O'n",), ("O'é",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(filters.canonical_person(F.col("t"))).collect()]
    assert got == ["o'neill and O'Brien", "XO'neill", "O'", "O'Neill O'N", "O'é"]


class Endpoint(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        query = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["query"][0]
        if "broken" in query:
            self.send_response(503)
            self.end_headers()
            return
        limit, offset = map(int, re.search(r"LIMIT (\d+) OFFSET (\d+)", query).groups()) if "LIMIT" in query else (23, 0)
        rows = [
            {"person": {"value": f"p{i}"}, **({"label": {"value": f"L{i}"}} if i % 2 else {})}
            for i in range(offset, min(offset + limit, 23))
        ]
        body = json.dumps({"results": {"bindings": rows}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_sparql_source_against_a_local_endpoint(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}/sparql"
        spark.dataSource.register(SparqlDataSource)
        read = lambda **o: spark.read.format("sparql").options(endpoint=at, columns="person, label", **o).load()
        want = {(f"p{i}", f"L{i}" if i % 2 else None) for i in range(23)}
        paged = read(query="SELECT * LIMIT {limit} OFFSET {offset}", page=5, partitions=3).collect()
        assert {tuple(r) for r in paged} == want and len(paged) == 23
        assert {tuple(r) for r in read(query="SELECT *").collect()} == want
        with pytest.raises(Exception, match="503"):
            read(query="SELECT broken").collect()
        with pytest.raises(Exception, match="503"):
            fetch(at, "broken")
    finally:
        server.shutdown()


def test_settled_tables_need_a_shared_folder_on_a_cluster(monkeypatch):
    from vellum.plans import durable

    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, name):
            return self.folder

    class Session:
        def __init__(self, master, folder):
            self.sparkContext = self
            self.master, self.set_to, self._folder = master, None, folder
            self._jsc = self

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isEmpty(self):
            return self.set_to is None

        def get(self):
            return self.set_to

        def getConf(self):
            return Conf(self._folder)

        def setCheckpointDir(self, folder):
            self.set_to = folder

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            durable.shared_folder(Session(master, None))
        assert durable.shared_folder(Session(master, "s3://x")) == "s3://x"
    assert durable.shared_folder(Session("local[2]", None))


def test_first_mentions_and_requests(spark, tmp_path):
    from vellum.operators import tag
    from vellum.sources import documents as sources

    rows = [(1, "Cork", "LOC", 0.9, 30, 34), (1, "Cork", "LOC", 0.5, 3, 7), (1, "Cork", "PER", 0.9, 50, 54), (1, "Mayo", "LOC", None, None, None), (2, "Cork", "LOC", 0.9, 9, 13), (1, "Cork", "LOC", 0.8, 3, 7)]
    got = tag.first_mentions(spark.createDataFrame(rows, "doc_id long, text string, label string, score double, start int, end int"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[5], rows[2], rows[3], rows[4]], key=str)
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"doc_id": 7, "text": "John Kelly of Cork"}\n{"doc_id": "x"}\nno json\n')
    docs = sources.read_requests(spark, str(tmp_path / "r"))
    assert docs.count() == 3
    assert {(r.doc_id, r.text) for r in tag.analyze(docs, dedupe=False).collect()} == {("7", "John Kelly"), ("7", "Cork")}


def test_scores_by_label(spark):
    from pyspark.sql import functions as F

    from vellum.operators import score

    rows = spark.createDataFrame([("PER",), ("LOC",), ("ORG",), (None,)], "label string")
    one = lambda w: {c: F.lit(1.0) for c in w}
    got = rows.select("label", F.round(score.score_candidates(F.col("label"), one(score.PERSON_WEIGHTS), one(score.PLACE_WEIGHTS)), 6)).collect()
    assert {tuple(r) for r in got} == {("PER", 1.0), ("LOC", 1.0), ("ORG", 0.0), (None, 0.0)}
