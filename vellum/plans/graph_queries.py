"""Queries over a made table of triples: properties, places and their ancestors, one call that links mentions, profiles, and explanations of persons."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.functions.strings import flip_names, fragments, place_text, uri_source
from vellum.operators import evaluate, explain, retrieve, score
from vellum.plans.durable import shared_folder
from vellum.plans.registry import query
from vellum.plans.span_queries import star_sql

#: Each customer with a name, a place, and a nickname where the key is even, in the graph of its region; places point back at persons.
TRIPLES = """(
SELECT r_name AS graph, 'kg/p/' || c_custkey AS s, 'name' AS p, c_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 'kg/p/' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'lives_in' ELSE 'lived_in' END, 'kg/l/' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 'kg/p/' || c_custkey, 'nick', lower(c_name) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0
UNION ALL SELECT r_name, 'kg/l/' || n_name, 'home_of', 'kg/p/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
GRAPHS = ["REGION_0", "REGION_1", "AFRICA", "ASIA", "AMERICA"]


@query("triple_patterns", f"""
WITH t AS (SELECT * FROM {TRIPLES} z WHERE graph IN ('REGION_0', 'REGION_1', 'AFRICA', 'ASIA', 'AMERICA')),
n AS (SELECT s, o AS name FROM t WHERE p = 'name'), l AS (SELECT s, o AS place FROM t WHERE p IN ('lives_in', 'lived_in')), k AS (SELECT s, o AS nick FROM t WHERE p = 'nick'), b AS (SELECT o AS s, s AS back FROM t WHERE p = 'home_of')
SELECT s, name, place, nick, back FROM n LEFT JOIN l USING (s) LEFT JOIN k USING (s) LEFT JOIN b USING (s)
""")
def triple_patterns(spark, sf_dir):
    """Properties of persons in some graphs: a required one, alternative ones, an optional one and an inverse one."""
    t = retrieve.in_graphs(star_sql(spark, sf_dir, f"SELECT * FROM {TRIPLES} z"), GRAPHS)
    out = retrieve.property_values(t, ["name"], "name")
    for values in (
        retrieve.property_values(t, ["lives_in", "lived_in"], "place"), retrieve.property_values(t, ["nick"], "nick"),
        retrieve.property_values(t, ["home_of"], "back", inverse=True)
    ):
        out = out.join(values, "s", "left")
    return out


@query("graph_partitions", f"""
WITH g AS (SELECT r_name AS graph FROM region WHERE r_regionkey % 2 = 1), t AS (SELECT z.* FROM {TRIPLES} z WHERE graph IN (SELECT graph FROM g)),
n AS (SELECT graph, s, o AS name FROM t WHERE p = 'name'), l AS (SELECT s, o AS place FROM t WHERE p IN ('lives_in', 'lived_in')), k AS (SELECT s, o AS nick FROM t WHERE p = 'nick')
SELECT graph, s, name, place, nick FROM n LEFT JOIN l USING (s) LEFT JOIN k USING (s)
""")
def graph_partitions(spark, sf_dir):
    """Triples kept a folder a graph, and properties of persons read from the graphs that a query over regions names."""
    folder = f"{shared_folder(spark)}/graphs-{uuid.uuid4().hex}"
    retrieve.write_graphs(star_sql(spark, sf_dir, f"SELECT * FROM {TRIPLES} z"), folder)
    wanted = star_sql(spark, sf_dir, "SELECT r_name AS graph FROM region WHERE r_regionkey % 2 = 1")
    t = retrieve.read_graphs(spark, folder, wanted)
    out = t.filter("p = 'name'").select("graph", "s", F.col("o").alias("name"))
    for predicates, name in ((["lives_in", "lived_in"], "place"), (["nick"], "nick")):
        out = out.join(retrieve.property_values(t, predicates, name), "s", "left")
    return out.select("graph", "s", "name", "place", "nick")


#: Place rows as a store gives them, values joined by ` | `.
SHAPES = """(SELECT 'kg/place/' || n_name || '/x' AS place, 'era' || (n_nationkey % 3) AS era, n_name AS english, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'I' || n_name END AS irish,
  CASE n_nationkey % 3 WHEN 0 THEN 'o#town | o#county | o#town' WHEN 1 THEN 'o#parish' END AS types, 'kg/place/' || r_name || '_old/x' || CASE WHEN n_nationkey % 2 = 0 THEN ' | kg/place/WORLD/x' ELSE '' END AS "parentPlace",
  CASE n_nationkey % 3 WHEN 0 THEN 'http://a/b/log/1 | http://x' WHEN 1 THEN '' END AS "sameAs", CASE WHEN n_nationkey % 2 = 0 THEN 'h1 | h2' END AS "historicalApproximations", n_name || ', ' || r_name || '|' || r_name || ' | ' AS names FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query("shape_places", f"""
SELECT place, era, english, irish, CASE WHEN types IS NULL THEN '' WHEN types LIKE '%parish' THEN 'parish' ELSE 'town;county' END AS types,
  replace(split_part(replace("parentPlace", 'kg/place/', ''), '/', 1), '_', ' ') || CASE WHEN "parentPlace" LIKE '%WORLD%' THEN ';WORLD' ELSE '' END AS parents,
  CASE WHEN coalesce("sameAs", '') = '' THEN '' ELSE 'log;External Link' END AS sources, coalesce(replace("historicalApproximations", ' | ', ';'), '') AS past,
  ' ' || trim(split_part(split_part(names, '|', 1), ',', 2)) || ' ' || split_part(names, ',', 1) || ';' || trim(split_part(names, '|', 2)) AS flipped, CASE WHEN coalesce("sameAs", '') = '' THEN 'Not Known' ELSE 'log' END AS first_source,
  CASE WHEN types IS NULL THEN '' WHEN types LIKE '%parish' THEN 'parish' ELSE 'town;county' END AS parts FROM {SHAPES} z
""")
def shape_places(spark, sf_dir):
    rows = star_sql(spark, sf_dir, f"SELECT * FROM {SHAPES} z")
    shaped = retrieve.shape_places(rows).join(
        rows.select(F.col("place").alias("_p"), "names", F.col("types").alias("_t"), F.col("sameAs").alias("_s")),
        F.col("place") == F.col("_p")
    )
    j = lambda c: F.array_join(c, ";")
    uris = F.split(F.coalesce("_t", F.lit("")), r" \| ")
    return shaped.select(
        "place", "era", "english", "irish", j("types").alias("types"), j("parentLabels").alias("parents"), j("externalResources").alias("sources"), j("historicalApproximations").alias("past"),
        j(flip_names(F.col("names"))).alias("flipped"), uri_source(
            F.substring_index(F.coalesce("_s", F.lit("")), " | ", 1)
        ).alias("first_source"), j(fragments(uris)).alias("parts"))


#: Persons at home in nations; nations lie in regions, regions in the world, which lies in itself.
NODES = """(SELECT 'kg/place/' || n_name || '/x' AS place, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS english, CASE WHEN n_nationkey % 3 = 0 THEN 'I' || n_name END AS irish, 'kg/place/' || r_name || '/x' AS "parentPlace" FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'kg/place/' || r_name || '/x', '', CASE WHEN r_regionkey % 2 = 0 THEN 'I' || r_name ELSE ' ' END, 'kg/place/WHOLE_WORLD/x' FROM region UNION ALL SELECT 'kg/place/WHOLE_WORLD/x', NULL, NULL, 'kg/place/WHOLE_WORLD/x|other/y')"""
HOMES = "(SELECT 'kg/person/' || c_custkey AS person, 'kg/place/' || n_name || '/x' || CASE WHEN c_custkey % 2 = 0 THEN '|kg/place/' || r_name || '/x' ELSE '' END AS residences FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("ancestor_labels", f"""
WITH RECURSIVE n AS (SELECT * FROM {NODES} z), e AS (SELECT DISTINCT place AS child, unnest(string_split("parentPlace", '|')) AS parent FROM n), k AS (SELECT * FROM e WHERE starts_with(parent, 'kg/')),
c AS (SELECT child, parent AS ancestor FROM k UNION SELECT c.child, k.parent FROM c JOIN k ON k.child = c.ancestor),
h AS (SELECT person, unnest(string_split(residences, '|')) AS child FROM {HOMES} y),
l AS (SELECT DISTINCT person, coalesce(nullif(trim(english), ''), nullif(trim(irish), ''), replace(split_part(ancestor, '/', 3), '_', ' ')) AS label FROM h JOIN c USING (child) JOIN n ON n.place = c.ancestor)
SELECT person, 'cards/' || substr(person, 4) AS card, array_to_string(list_sort(list(label)), ';') AS labels FROM l GROUP BY person
""")
def ancestor_labels(spark, sf_dir):
    """Labels of all places above each person's homes, and the person's card."""
    nodes = star_sql(spark, sf_dir, f"SELECT * FROM {NODES} z")
    closure = retrieve.transitive_closure(retrieve.location_edges(nodes, "kg/"))
    found = retrieve.ancestor_labels(star_sql(spark, sf_dir, f"SELECT * FROM {HOMES} y"), closure, nodes, ["person"])
    return found.select(
        "person", retrieve.entity_card(F.col("person"), "kg/", "cards/").alias("card"), F.array_join("ancestorLabels", ";").alias("labels")
    )


#: Mentions of persons by their last name's digits, of places, and of things that are neither.
ASKED = """(SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'Mr ' || substr(s_name, 1) WHEN 1 THEN n_name WHEN 2 THEN c_name ELSE 'Nobody' END AS mention, CASE c_custkey % 4 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' WHEN 2 THEN 'ORG' ELSE 'PER' END AS label
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_suppkey = c_custkey % 10 + 1)"""


@query("link_mentions", f"""
WITH a AS (SELECT * FROM {ASKED} z),
p AS (SELECT doc_id, mention, 's' || s_suppkey AS uri, row_number() OVER (PARTITION BY doc_id, mention ORDER BY 's' || s_suppkey) AS n FROM a JOIN supplier ON contains(lower(s_name), lower(split_part(mention, ' ', -1))) WHERE label = 'PER'),
l AS (SELECT doc_id, mention, 'n' || n_nationkey AS uri, 1 AS n FROM a JOIN nation ON contains(lower(n_name), lower(mention)) WHERE label = 'LOC'),
f AS (SELECT * FROM p WHERE n <= 30 UNION ALL SELECT * FROM l),
b AS (SELECT a.doc_id, a.mention, a.label, coalesce(array_to_string(list_sort(list(uri) FILTER (WHERE uri IS NOT NULL)), ';'), '') AS found FROM a LEFT JOIN f ON f.doc_id = a.doc_id AND f.mention = a.mention GROUP BY ALL)
SELECT 'mention' AS kind, doc_id, mention, label, found FROM b UNION ALL SELECT 'edge', n_nationkey, 'n' || n_nationkey, NULL, 'r' || n_regionkey FROM nation
""")
def link_mentions(spark, sf_dir):
    """One call for a table of mentions: candidates for each, and the places' graph."""
    persons = star_sql(spark, sf_dir, "SELECT 's' || s_suppkey AS person, s_name AS full_name FROM supplier")
    places = star_sql(spark, sf_dir, "SELECT 'n' || n_nationkey AS place, n_name AS name, 'r' || n_regionkey AS parents FROM nation")
    blocks, edges = retrieve.link_mentions(
        star_sql(spark, sf_dir, f"SELECT * FROM {ASKED} z"), persons, places, ["doc_id"], parents="parents"
    )
    found = blocks.select(
        F.lit("mention").alias("kind"), F.col("doc_id").cast("long"), "mention", "label", F.array_join("candidates", ";").alias("found")
    )
    graph = edges.select(
        F.lit("edge").alias("kind"), F.substring("child", 2, 9).cast("long").alias("doc_id"), F.col("child").alias("mention"),
        F.lit(None).cast("string").alias("label"), F.col("parent").alias("found")
    )
    return found.unionByName(graph)


#: Candidates with more or less to say, and a document that names them or not.
PROFILES = """(SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'PER' ELSE 'LOC' END AS label, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'early' END AS era, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE '16' || (10 + s_suppkey % 80) END AS year,
  n_name AS home, CASE WHEN s_suppkey % 7 = 0 THEN 'no name here' ELSE 'They say that ' || s_name || ' of ' || n_name || ' was there.' END AS "full" FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_EMBED = "list_transform(range(0, 64), lambda d: CAST(len(list_filter(list_transform(range(1, greatest(length({t}) - 2, 1) + 1), lambda i: CAST('0x' || substr(md5(substr(lower({t}), i, 3)), 1, 7) AS BIGINT) % 64), lambda h: h = d)) AS DOUBLE))"


@query("profiles", f"""
WITH p AS (SELECT *, CASE WHEN label = 'PER' THEN name || CASE WHEN era <> '' THEN ' | ' || era ELSE '' END || CASE WHEN year IS NOT NULL THEN ' | ' || year || ' | ' || year ELSE '' END || ' | ' || home ELSE name || CASE WHEN era <> '' THEN ' | ' || era ELSE '' END || ' | ' || home END AS profile,
  CASE WHEN k % 7 = 0 THEN name ELSE name || '. context: ' || substr(lower("full"), greatest(14 - 120, 0) + 1, least(length("full"), 14 + length(name) + 120)) END AS query FROM {PROFILES} z),
e AS (SELECT *, {_EMBED.format(t='profile')} AS a, {_EMBED.format(t='query')} AS b FROM p)
SELECT k, profile, query, round(least(greatest((list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) + 1) / 2, 0), 1), 6) AS neural FROM e
""")
def profiles(spark, sf_dir):
    """What is compared for a mention and a candidate, each different text embedded once, and its neural score."""
    p = star_sql(spark, sf_dir, f"SELECT * FROM {PROFILES} z")
    none = F.array().cast("array<string>")
    fields = {
        "label": F.col("name"), "eras": F.col("era"), "floruitEarliest": F.col("year"), "floruitLatest": F.col("year"),
        "english": F.col("name"), "irish": F.lit(""), "era": F.col("era"), "residencesLabels": F.array("home"), "types": F.array("home"),
        "parentLabels": none, "historicalApproximations": none
    }
    p = p.withColumn(
        "profile", F.when(F.col("label") == "PER", score.profile_text("PER", fields)).otherwise(score.profile_text("LOC", fields))
    ).withColumn("query", score.query_text(F.col("name"), F.col("full")))
    e = score.embed_distinct(p, ["profile", "query"])
    return e.select("k", "profile", "query", F.round(score.neural_score(F.col("profile_emb"), F.col("query_emb")), 6).alias("neural"))


@query("candidate_labels", """
SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'kg/p/' || s_suppkey WHEN 1 THEN 'kg/l/' || s_suppkey END AS uri,
  CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'kg/p/' || s_suppkey END ELSE CASE WHEN s_suppkey % 2 = 0 THEN s_name WHEN s_suppkey % 5 = 0 THEN 'E' || s_name ELSE 'kg/l/' || s_suppkey END END AS label FROM supplier
""")
def candidate_labels(spark, sf_dir):
    """What a candidate is known by and what a baseline compares of it."""
    c = star_sql(
        spark, sf_dir,
        "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' ELSE 'ORG' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE ' ' END AS label, CASE WHEN s_suppkey % 5 = 0 THEN 'E' || s_name END AS english_label, 'kg/p/' || s_suppkey AS person, 'kg/l/' || s_suppkey AS place FROM supplier"
    )
    fields = {k: F.col(k) for k in ("label", "english_label", "person", "place")}
    return c.select(
        "k", evaluate.candidate_uri(F.col("kind"), F.col("person"), F.col("place")).alias("uri"),
        evaluate.candidate_label(F.col("kind"), fields).alias("label")
    )


#: Gold rows of documents spelled in three manners, some with a context, some without a document.
GOLD = """(SELECT c_custkey AS ord, CASE c_custkey % 4 WHEN 0 THEN 'document_' || n_nationkey WHEN 1 THEN 'Doc' || n_nationkey WHEN 2 THEN 'document_' || n_nationkey || '.txt' ELSE CASE WHEN c_custkey % 8 = 3 THEN ' ' END END AS doc_id,
  c_name AS mention, 'PER' AS label, 'kg/' || c_custkey AS gold_uri, CASE WHEN c_custkey % 9 = 0 THEN 'said of ' || c_name WHEN c_custkey % 2 = 0 THEN ' ' END AS context FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("document_contexts", f"""
WITH g AS (SELECT * FROM {GOLD} z WHERE trim(coalesce(doc_id, '')) <> ''), o AS (SELECT doc_id, arg_min(context, ord) FILTER (WHERE trim(coalesce(context, '')) <> '') AS own, CAST(regexp_extract(doc_id, '(\\d+)', 1) AS INT) AS number FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(own, n_name) AS context FROM o LEFT JOIN nation ON n_nationkey = number AND n_nationkey % 3 > 0
""".replace("\\\\", "\\"))
def document_contexts(spark, sf_dir):
    """A document's own context, or the text of the file with its number."""
    gold = star_sql(spark, sf_dir, f"SELECT * FROM {GOLD} z WHERE trim(coalesce(doc_id, '')) <> ''")
    return evaluate.resolve_context(
        gold, star_sql(spark, sf_dir, "SELECT CAST(n_nationkey AS INT) AS number, n_name AS text FROM nation WHERE n_nationkey % 3 > 0")
    )


@query("gold_by_document", f"""
SELECT CASE WHEN trim(coalesce(doc_id, '')) = '' THEN '__row_' || ord ELSE doc_id END AS doc_id, count(*) AS n, md5(string_agg(mention || gold_uri, ';' ORDER BY ord)) AS digest FROM {GOLD} z GROUP BY 1
""")
def gold_by_document(spark, sf_dir):
    g = evaluate.gold_by_document(star_sql(spark, sf_dir, f"SELECT * FROM {GOLD} z"))
    return g.select(
        "doc_id", F.size("mentions").cast("long").alias("n"),
        F.md5(F.array_join(F.transform("mentions", lambda m: F.concat(m["mention"], m["gold_uri"])), ";")).alias("digest")
    )


#: Persons with features of every degree.
FEATURES = """(SELECT c_custkey AS k, c_name AS name, 0.4e0 + 0.1e0 * (c_custkey % 6) AS name_s, CASE c_custkey % 3 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.0e0 ELSE 0.3e0 END AS era, CASE c_custkey % 4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.75e0 WHEN 2 THEN 0.3e0 ELSE 0.0e0 END AS residence,
  CASE c_custkey % 5 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.6e0 WHEN 3 THEN 0.1e0 ELSE 0.4e0 END AS floruit, 0.5e0 + 0.1e0 * (c_custkey % 4) AS neural, n_name AS home, r_name AS above, CASE WHEN c_custkey % 5 = 4 THEN '' ELSE '1601' END AS earliest,
  CASE WHEN c_custkey % 10 = 4 THEN NULL ELSE '1650' END AS latest, 0.125e0 + 0.001e0 * (c_custkey % 500) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("explain_persons", f"""
WITH f AS (SELECT *, 'their floruit period (' || coalesce(earliest, '') || ' to ' || coalesce(latest, '') || ') ' AS period FROM {FEATURES} z),
c AS (SELECT k, printf('%s scores %.3f', name, score + 0.00001) AS a, list_filter([
  CASE WHEN name_s >= 0.85 THEN 'their name closely matches the mention' WHEN name_s >= 0.6 THEN 'their name partially matches the mention' ELSE 'their name has a weak match to the mention' END,
  CASE WHEN era = 1 THEN 'their KG era (early) aligns with the document era (early-modern-1500-1749)' WHEN era = 0 THEN 'their KG era (early) does not match the document era (early-modern-1500-1749)' ELSE 'their era information is incomplete' END,
  CASE WHEN residence = 1 THEN 'they reside in ' || home || ', which is mentioned in the document' WHEN residence = 0.75 THEN 'they reside in ' || home || ', whose parent geography includes ' || above || ', which is mentioned in the document' WHEN residence = 0.3 THEN 'no residence information is available' ELSE 'their known residences are not mentioned in the document' END,
  CASE WHEN floruit = 1 THEN period || 'encompasses the document year (1641)' WHEN floruit = 0.8 THEN period || 'is very close to the document year (1641)' WHEN floruit = 0.6 THEN period || 'is within 20 years of the document year (1641)' WHEN floruit = 0.1 THEN period || 'is distant from the document year (1641)' ELSE 'their floruit dates are incomplete' END,
  CASE WHEN neural >= 0.75 THEN 'the semantic context strongly matches this candidate profile' WHEN neural >= 0.6 THEN 'the semantic context moderately matches this candidate profile' ELSE 'the semantic context provides limited support for this candidate' END], lambda x: x IS NOT NULL) AS l FROM f)
SELECT k, a || ' as ' || array_to_string(list_slice(l, 1, len(l) - 1), ', ') || ', and ' || l[len(l)] || '.' AS explanation FROM c
""")
def explain_persons(spark, sf_dir):
    """Scores are shown a hair above their value: engines differ where the third place is a tie."""
    f = star_sql(spark, sf_dir, f"SELECT * FROM {FEATURES} z")
    own = {"name": "name_s", "era": "era", "residence": "residence", "floruit": "floruit", "neural": "neural"}
    c = {
        "eras": F.lit("early"), "residencesLabels": F.array("home"), "ancestorLabels": F.array("above"),
        "floruitEarliest": F.col("earliest"), "floruitLatest": F.col("latest")
    }
    text = explain.explain_person(
        F.col("name"), F.col("score") + 0.00001, {k: F.col(v) for k, v in own.items()}, c, F.array(F.lower("home"), F.lower("above"))
    )
    return f.select("k", text.alias("explanation"))


@query("place_texts", r"""
SELECT n_nationkey AS k, trim(regexp_replace(regexp_replace(regexp_replace(lower('The Towne of ' || n_name || ', near (' || n_name || ')'), '[^a-z0-9\s]', ' ', 'g'), '\b(the|of|towne|town)\b', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM nation
""")
def place_texts(spark, sf_dir):
    return star_sql(
        spark, sf_dir, "SELECT n_nationkey AS k, 'The Towne of ' || n_name || ', near (' || n_name || ')' AS t FROM nation"
    ).select("k", place_text(F.col("t")).alias("text"))


#: Names and mentions of them: the same, a letter short, turned about, with another last name, and none.
NAMES = """(SELECT n_nationkey * 10 + k AS id, f || ' Brown' AS label, CASE k WHEN 0 THEN f || ' Brown' WHEN 1 THEN substr(f, 2) || ' BROWN ' WHEN 2 THEN reverse(f) || ' of Brown' WHEN 3 THEN f || ' Browne' ELSE ' ' END AS mention FROM (
  SELECT n_nationkey, translate(n_name, '_0123456789', 'xabcdefghij') AS f FROM nation) n, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k)"""


@query("name_scores", f"""
WITH RECURSIVE p AS (SELECT id, lower(trim(mention)) AS m, lower(label) AS n FROM {NAMES} z),
w AS (SELECT *, split_part(m, ' ', 1) AS mf, split_part(n, ' ', 1) AS nf, split_part(m, ' ', -1) = split_part(n, ' ', -1) AS same, array_to_string(list_sort(string_split(m, ' ')), ' ') AS ms, array_to_string(list_sort(string_split(n, ' ')), ' ') AS ns FROM p WHERE m <> ''),
two AS (SELECT mf AS x, nf AS y FROM w UNION SELECT ms, ns FROM w),
lcs AS (SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: CAST(0 AS BIGINT)) AS row FROM two
  UNION ALL SELECT x, y, i + 1, list_transform(range(0, length(y) + 1), lambda j: greatest(row[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda q: y[q] = x[i + 1]), lambda q: row[q] + 1)), 0))) FROM lcs WHERE i < length(x)),
r AS (SELECT x, y, round_even(200.0e0 * row[length(y) + 1] / (length(x) + length(y)), 0) AS percent FROM lcs WHERE i = length(x))
SELECT p.id, coalesce(CASE WHEN NOT same THEN 0e0 ELSE round_even(0.5e0 + 0.35e0 * (a.percent / 100) + 0.15e0 * (b.percent / 100), 3) END, 0e0) AS score
FROM p LEFT JOIN w ON w.id = p.id LEFT JOIN r a ON a.x = mf AND a.y = nf LEFT JOIN r b ON b.x = ms AND b.y = ns
""")
def name_scores(spark, sf_dir):
    """Likeness of names by their common subsequences."""
    p = star_sql(spark, sf_dir, f"SELECT * FROM {NAMES} z")
    return p.select("id", score.name_score(F.col("mention"), F.col("label")).alias("score"))
