"""Queries over documents: tokens, spelling, chunks, context, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.functions.strings import clean_for_match, context, look_up, preserve_case, straight_quotes
from vellum.operators import chunk, normalize
from vellum.operators.rows import spread
from vellum.plans.durable import settle
from vellum.plans.registry import query
from vellum.sources import documents as sources

LETTERS = "A-Za-zÁÉÍÓÚáéíóú"
SQL_WORD = rf"[{LETTERS}]+(?:[''’][{LETTERS}]+)*"
SQL_TOKENS = rf"""
toks AS (SELECT doc_id, regexp_extract_all(text, '(?s)({SQL_WORD}|\d+|\s+|.)', 1) AS l FROM documents),
tok AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM toks),
kinds AS (SELECT *, CASE WHEN regexp_full_match(tok, '{SQL_WORD}') THEN 'word' WHEN regexp_full_match(tok, '\d+') THEN 'digits' WHEN regexp_full_match(tok, '\s+') THEN 'space' ELSE 'other' END AS kind FROM tok)
"""


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_map(pairs: dict[str, str], key: str) -> str:
    return "CASE " + key + " " + " ".join(
        f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in pairs.items()
    ) + " END"


def docs(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("norm_quotes_dashes", r"""
SELECT doc_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM (
  SELECT doc_id, replace(regexp_replace(regexp_replace(replace(translate('“x”`y—' || text, '“”`', '""'''), '—', '--'), '\s*\n\n\s*', chr(1), 'g'), '\s+', ' ', 'g'), chr(1), chr(10)) AS t FROM documents)
""")
def norm_quotes_dashes(spark, sf_dir):
    """Quotes, dashes and white space of whole texts, after a prefix that has each kind of mark."""
    t = straight_quotes(F.concat(F.lit("“x”`y—"), F.col("text")))
    t = F.replace(F.regexp_replace(F.regexp_replace(t, r"(?U)\s*\n\n\s*", "\x01"), r"(?U)\s+", " "), F.lit("\x01"), F.lit("\n"))
    return docs(spark, sf_dir).select("doc_id", t.alias("t")).select(
        "doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest")
    )


@query(
    "token_class_counts",
    f"WITH {SQL_TOKENS} SELECT kind, count(*) AS n, count(DISTINCT tok) AS n_distinct, CAST(sum(length(tok)) AS BIGINT) AS chars FROM kinds GROUP BY kind"
)
def token_class_counts(spark, sf_dir):
    t = normalize.tokens(docs(spark, sf_dir))
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("tok").alias("n_distinct"), F.sum(F.length("tok")).alias("chars"))


@query("token_offsets", f"""
WITH {SQL_TOKENS}, s AS (SELECT doc_id, pos, tok, kind, coalesce(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM kinds)
SELECT doc_id, count(*) AS n_words, CAST(sum(start) AS BIGINT) AS sum_start, CAST(max(start + length(tok)) AS BIGINT) AS last_end FROM s WHERE kind = 'word' GROUP BY doc_id
""")
def token_offsets(spark, sf_dir):
    t = normalize.tokens(docs(spark, sf_dir)).filter("kind = 'word'")
    return t.groupBy("doc_id").agg(
        F.count("*").alias("n_words"), F.sum(F.col("start").cast("long")).alias("sum_start"),
        F.max(F.col("start") + F.length("tok")).cast("long").alias("last_end")
    )


_PROTECTED = sorted({*L.PREFIXES, *L.SURNAMES, *L.FIRST_NAMES, *L.PLACE_NAMES})


@query("protect_lexicon", f"""
WITH {SQL_TOKENS}, c AS (SELECT doc_id, lower(regexp_replace(tok, '[^{LETTERS}''-]', '', 'g')) AS clean FROM kinds WHERE kind = 'word')
SELECT clean, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM c WHERE clean IN ({sql_list(_PROTECTED)}) GROUP BY clean
""")
def protect_lexicon(spark, sf_dir):
    t = docs(spark, sf_dir).select(
        "doc_id", F.explode(normalize.words_of(F.col("text"))).alias("tok")
    ).filter(normalize.is_protected(F.col("tok")))
    return t.withColumn("clean", clean_for_match(F.col("tok"))).groupBy("clean").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")
    )


# The corpus has few words with a listed old spelling; the tables' names give words in all three cases.
_CASES = f"""(SELECT w AS tok FROM (VALUES {", ".join(f"('{k.replace(chr(39), chr(39) * 2)}')" for k in L.OVERRIDES)}) v(w)
UNION SELECT upper(w) FROM (VALUES {", ".join(f"('{k}')" for k in list(L.OVERRIDES)[:40] if " " not in k)}) v(w)
UNION SELECT upper(substr(w, 1, 1)) || substr(w, 2) FROM (VALUES {", ".join(f"('{k}')" for k in list(L.OVERRIDES)[:40] if " " not in k)}) v(w))"""


@query("override_rewrite", f"""
WITH {SQL_TOKENS}, words AS (SELECT DISTINCT tok FROM kinds WHERE kind = 'word' UNION {_CASES}),
o AS (SELECT tok, {sql_map(L.OVERRIDES, 'lower(tok)')} AS m FROM words)
SELECT tok, CASE WHEN tok = upper(tok) AND tok <> lower(tok) THEN upper(m) WHEN substr(tok, 1, 1) <> lower(substr(tok, 1, 1)) THEN upper(substr(m, 1, 1)) || lower(substr(m, 2)) ELSE m END AS out FROM o WHERE m IS NOT NULL
""")
def override_rewrite(spark, sf_dir):
    words = normalize.distinct_words(docs(spark, sf_dir)).union(spark.sql(f"SELECT tok FROM {_CASES}")).distinct()
    m = look_up(L.OVERRIDES, F.lower("tok"))
    return words.filter(m.isNotNull()).select("tok", preserve_case(m, F.col("tok")).alias("out"))


def _sql_around(old: str, new: str, test: str) -> str:
    ok = lambda c: f"regexp_full_match({c}, '{test}')"
    one = f"CASE WHEN substr(w, i, 1) = '{old}' AND i > 1 AND {ok('substr(w, i - 1, 1)')} AND {ok('substr(w, i + 1, 1)')} THEN '{new}' ELSE substr(w, i, 1) END"
    return f"CASE WHEN contains(w, '{old}') THEN array_to_string(list_transform(range(1, length(w) + 1), lambda i: {one}), '') END"


_SQL_CANDIDATES = f"""
words AS (SELECT DISTINCT lower(tok) AS w, substr(tok, 1, 1) <> lower(substr(tok, 1, 1)) AS protect FROM kinds WHERE kind = 'word'),
raw AS (SELECT w, protect, {sql_map(L.OVERRIDES, 'w')} AS ov, [w, CASE WHEN {sql_map(L.OVERRIDES, 'w')} <> w THEN {sql_map(L.OVERRIDES, 'w')} END, {sql_map(L.PLACE_SPELLINGS, 'w')},
  CASE WHEN contains(w, 'vv') THEN replace(w, 'vv', 'w') END, CASE WHEN contains(w, 'w') THEN replace(w, 'w', 'u') END,
  CASE WHEN starts_with(w, 'ff') AND length(w) > 2 THEN 'f' || substr(w, 3) END, NULL,
  CASE WHEN starts_with(w, 'i') AND length(w) > 2 THEN 'j' || substr(w, 2) END, CASE WHEN contains(w, 'oi') THEN replace(w, 'oi', 'oj') END,
  CASE WHEN ends_with(w, 'ie') AND length(w) > 3 THEN substr(w, 1, length(w) - 2) || 'y' END, CASE WHEN contains(w, 'i') THEN replace(w, 'i', 'y') END,
  CASE WHEN ends_with(w, 'es') AND length(w) > 3 AND NOT protect THEN substr(w, 1, length(w) - 2) || 's' END, CASE WHEN starts_with(w, 'v') AND length(w) > 2 THEN 'u' || substr(w, 2) END,
  {_sql_around('u', 'v', '[a-z]')}, {_sql_around('v', 'u', normalize.CONSONANT)},
  CASE WHEN ends_with(w, 'eing') AND length(w) > 5 THEN substr(w, 1, length(w) - 4) || 'ing' END, CASE WHEN ends_with(w, 'e') AND length(w) > 3 AND NOT protect THEN substr(w, 1, length(w) - 1) END,
  CASE WHEN regexp_matches(w, '(aa|ee|ii|oo|uu)$') THEN substr(w, 1, length(w) - 1) END, CASE WHEN contains(w, 'shanon') THEN replace(w, 'shanon', 'shannon') END] AS l FROM words),
f AS (SELECT w, protect, ov, list_filter(l, lambda c: c IS NOT NULL AND regexp_full_match(coalesce(c, ''), '[{LETTERS}''-]+')) AS l FROM raw),
cands AS (SELECT w, protect, ov, list_slice(list_filter(l, lambda c, i: list_position(l, c) = i), 1, 24) AS l FROM f)
"""


def _words(spark, sf_dir):
    return _cased(normalize.distinct_words(docs(spark, sf_dir)))


def _cased(w):
    first = F.substring("tok", 1, 1)
    return w.select(F.lower("tok").alias("w"), (first != F.lower(first)).alias("protect")).distinct()


@query("spelling_candidates", f"WITH {SQL_TOKENS}, {_SQL_CANDIDATES} SELECT w, protect, array_to_string(l, '|') AS candidates FROM cands")
def spelling_candidates(spark, sf_dir):
    return _words(spark, sf_dir).select(
        "w", "protect", F.array_join(normalize.spelling_candidates(F.col("w"), F.col("protect")), "|").alias("candidates")
    )


@query("choose_spelling", f"""
WITH {SQL_TOKENS}, {_SQL_CANDIDATES}, e AS (SELECT w, protect, ov, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM cands),
k AS (SELECT *, (CASE WHEN contains(c, 'vv') THEN 2.0 ELSE 0 END + CASE WHEN starts_with(c, 'ff') THEN 1.5 ELSE 0 END + CASE WHEN starts_with(c, 'v') THEN 0.6 ELSE 0 END + CASE WHEN ends_with(c, 'e') AND length(c) > 3 THEN 0.2 ELSE 0 END)
   - CASE WHEN ov = c THEN 0.25 ELSE 0 END AS p FROM e),
r AS (SELECT w, protect, c, row_number() OVER (PARTITION BY w, protect ORDER BY p, levenshtein(w, c), abs(length(c) - length(w)), length(c), i) AS n FROM k)
SELECT w, protect, c AS chosen FROM r WHERE n = 1
""")
def choose_spelling(spark, sf_dir):
    return _words(spark, sf_dir).select(
        "w", "protect", normalize.choose_by_rules(F.col("w"), normalize.spelling_candidates(F.col("w"), F.col("protect"))).alias("chosen")
    )


@query("choose_by_frequency", f"""
WITH {SQL_TOKENS}, {_SQL_CANDIDATES}, zipf AS (SELECT lower(tok) AS word, round(log10(count(*)) + 1, 6) AS zipf FROM kinds WHERE kind = 'word' GROUP BY 1),
e AS (SELECT w, protect, ov, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM cands),
k AS (SELECT e.*, coalesce(z.zipf, 0) AS z, (CASE WHEN contains(c, 'vv') THEN 2.0 ELSE 0 END + CASE WHEN starts_with(c, 'ff') THEN 1.5 ELSE 0 END + CASE WHEN starts_with(c, 'v') THEN 0.6 ELSE 0 END + CASE WHEN ends_with(c, 'e') AND length(c) > 3 THEN 0.2 ELSE 0 END) AS p FROM e LEFT JOIN zipf z ON z.word = e.c),
r AS (SELECT w, protect, c, row_number() OVER (PARTITION BY w, protect ORDER BY CASE WHEN z < 2.5 THEN 1 ELSE 0 END, z DESC, CASE WHEN ov = c THEN 0 ELSE 1 END, levenshtein(w, c), p, i) AS n FROM k)
SELECT w, protect, c AS chosen FROM r WHERE n = 1
""")
def choose_by_frequency(spark, sf_dir):
    """The frequency mode, with the corpus's own word counts for a lexicon."""
    # Texts are read once, for their words' numbers; what follows is of different words alone.
    t = settle(docs(spark, sf_dir).select(F.explode(normalize.words_of(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n")))
    zipf = t.groupBy(F.lower("tok").alias("word")).agg(F.round(F.log10(F.sum("n")) + 1, 6).alias("zipf"))
    words = _cased(t).select(
        F.col("w").alias("word"), F.col("protect").alias("protect_e"),
        normalize.spelling_candidates(F.col("w"), F.col("protect")).alias("candidates")
    )
    return normalize.choose_by_frequency(words, zipf).select(F.col("word").alias("w"), F.col("protect_e").alias("protect"), "chosen")


#: Whole documents, and texts with what the corpus lacks: Irish names over gaps, old spellings, a leading I, doubled newlines, marks to be
#: replaced, texts that are empty or null, and null and repeated ids.
NORMALIZED = """(SELECT doc_id, text FROM documents UNION ALL SELECT CAST(k AS BIGINT) AS doc_id, text FROM (
  SELECT NULL AS k, 'I O Neale vvas heere' AS text UNION ALL SELECT NULL, 'hello olde world' UNION ALL SELECT 1, 'the olde' UNION ALL SELECT 1, 'again man' UNION ALL SELECT 1, 'again man'
  UNION ALL SELECT -1, 'O  Neill, o. neale; Ó -- Brien O 7 Neill O' UNION ALL SELECT -2, NULL UNION ALL SELECT -3, '' UNION ALL SELECT -4, 'I' UNION ALL SELECT -5, 'It giueth I haue' || chr(10) || chr(10) || 'in VLSTER and Vlster, at ' || chr(10) || ' Corke and cork'
  UNION ALL SELECT -6, 'He said “yes” — `no` 12 ſhe  paide' UNION ALL SELECT -7, 'o oneill O' || chr(39) || 'Neill O ' || chr(10) || chr(10) || ' O' || chr(39) || 'Neill' UNION ALL SELECT -8, 'O SHEA o shea Ó Sheehan O widget'
  UNION ALL SELECT -9, 'vniuersitie ffycche neere vvill loue vpon iustice aboue')  z)"""


def _sql_clean(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^{LETTERS}''-]', '', 'g'))"


_SQL_NORMALIZED = rf"""
src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM {NORMALIZED} y),
pre AS (SELECT rid, replace(replace(translate(nfc_normalize(text), '“”`', '""' || chr(39)), '—', '--'), 'ſ', 's') AS pre FROM src WHERE text IS NOT NULL),
toks AS (SELECT rid, regexp_extract_all(pre, '(?s)({SQL_WORD}|\d+|\s+|.)', 1) AS l FROM pre),
tok AS (SELECT rid, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM toks),
kinds AS (SELECT *, CASE WHEN regexp_full_match(tok, '{SQL_WORD}') THEN 'word' WHEN regexp_full_match(tok, '\d+') THEN 'digits' WHEN regexp_full_match(tok, '\s+') THEN 'space' ELSE 'other' END AS kind,
  coalesce(sum(length(tok)) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM tok)"""

#: The CTEs of choose_spelling, as far as the candidates in order.
_SQL_CHOSEN = f"""{_SQL_CANDIDATES}, e AS (SELECT w, protect, ov, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM cands),
ek AS (SELECT *, (CASE WHEN contains(c, 'vv') THEN 2.0 ELSE 0 END + CASE WHEN starts_with(c, 'ff') THEN 1.5 ELSE 0 END + CASE WHEN starts_with(c, 'v') THEN 0.6 ELSE 0 END + CASE WHEN ends_with(c, 'e') AND length(c) > 3 THEN 0.2 ELSE 0 END)
   - CASE WHEN ov = c THEN 0.25 ELSE 0 END AS p FROM e),
best AS (SELECT w, protect, ov, c, row_number() OVER (PARTITION BY w, protect ORDER BY p, levenshtein(w, c), abs(length(c) - length(w)), length(c), i) AS n FROM ek)"""


@query("normalize_documents", rf"""
WITH {_SQL_NORMALIZED}, {_SQL_CHOSEN},
spelt AS (SELECT DISTINCT tok, CASE WHEN {_sql_clean('tok')} IN ({sql_list(_PROTECTED)}) THEN tok WHEN tok = upper(tok) AND tok <> lower(tok) THEN upper(m)
  WHEN substr(tok, 1, 1) <> lower(substr(tok, 1, 1)) THEN upper(substr(m, 1, 1)) || lower(substr(m, 2)) ELSE m END AS out
  FROM (SELECT DISTINCT tok, coalesce(ov, c, w) AS m FROM kinds JOIN best ON best.w = lower(tok) AND best.protect = (substr(tok, 1, 1) <> lower(substr(tok, 1, 1))) AND best.n = 1 WHERE kind = 'word') q),
g AS (SELECT rid, pos, kinds.tok, kind, start, out, kind = 'space' OR (kind = 'other' AND NOT regexp_matches(kinds.tok, '[\p{{L}}\p{{N}}]')) AS gap FROM kinds LEFT JOIN spelt ON kind = 'word' AND spelt.tok = kinds.tok),
firm AS (SELECT rid, pos, lead(kind) OVER v AS akind, lead(out) OVER v AS aout, lead(tok) OVER v AS atok, lead(start) OVER v AS astart, lead(pos) OVER v AS apos, kind = 'word' AND lower(tok) IN ('o', 'ó') AS o FROM g WHERE NOT gap WINDOW v AS (PARTITION BY rid ORDER BY pos)),
j AS (SELECT g.*, aout, atok, astart, apos, coalesce(o AND akind = 'word' AND {_sql_clean('aout')} IN ({sql_list(sorted(set(L.SURNAMES)))}), FALSE) AS joins FROM g LEFT JOIN firm ON firm.rid = g.rid AND firm.pos = g.pos),
n AS (SELECT *, max(CASE WHEN joins THEN apos END) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS eaten FROM j),
p AS (SELECT *, CASE WHEN pos = 0 AND tok = 'I' THEN 'I,' WHEN joins THEN tok || chr(39) || aout WHEN kind = 'word' THEN CASE WHEN {_sql_clean('out')} IN ({sql_list(L.PLACE_NAMES)}) THEN upper(substr(out, 1, 1)) || lower(substr(out, 2)) ELSE out END
  WHEN kind = 'space' THEN CASE WHEN contains(tok, chr(10) || chr(10)) THEN chr(10) ELSE ' ' END ELSE tok END AS piece FROM n WHERE coalesce(eaten < pos, TRUE)),
m AS (SELECT *, CASE WHEN pos = 0 AND tok = 'I' THEN [start, start] WHEN joins THEN [start, start] || list_transform(range(0, length(aout)), lambda i: astart + least(i, length(atok) - 1))
  WHEN kind = 'word' THEN list_transform(range(0, length(piece)), lambda i: start + least(i * (length(tok) - 1) // greatest(length(piece) - 1, 1), length(tok) - 1)) WHEN kind = 'space' THEN [start] ELSE list_transform(range(0, length(piece)), lambda i: start + i) END AS places FROM p),
a AS (SELECT rid, string_agg(piece, '' ORDER BY pos) AS t, sum(len(places)) AS n_mapped, sum(coalesce(list_sum(places), 0)) AS sum_map FROM m GROUP BY rid),
o AS (SELECT src.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS t, coalesce(n_mapped, 0) AS n_mapped, coalesce(sum_map, 0) AS sum_map FROM src LEFT JOIN a USING (rid))
SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest, CAST(n_mapped AS INT) AS n_mapped, CAST(sum_map AS BIGINT) AS sum_map FROM o
""")
def normalize_documents(spark, sf_dir):
    """The whole normaliser, a row for each row, whatever its id."""
    docs(spark, sf_dir).createOrReplaceTempView("documents")
    n = normalize.normalize(spark.sql(f"SELECT doc_id, text FROM {NORMALIZED} y"))
    return n.select(
        "doc_id", F.length("normalized").alias("n_chars"), F.md5("normalized").alias("digest"), F.size("char_map").alias("n_mapped"),
        F.aggregate("char_map", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_map")
    )


#: c: chunk number, start and end of each document's chunks.
SQL_CHUNKS = r"""
c AS (
  SELECT doc_id, text, 0 AS no, 0 AS s, {cut0} AS e FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, no, s, {cut} AS e FROM (
    SELECT doc_id, text, no + 1 AS no, n + length(regexp_extract(substr(text, n + 1), '^\s*', 0)) AS s FROM (SELECT doc_id, text, no, CASE WHEN e - 100 > s THEN e - 100 ELSE e END AS n FROM c) WHERE n + length(regexp_extract(substr(text, n + 1), '^\s*', 0)) < length(text)))
""".replace("{cut0}", "{cut}").replace("{cut}", r"""s0 + CASE WHEN length(regexp_extract(substr(text, s0 + 1, 1200), '(?s)^.*[.!?]', 0)) > 40 THEN length(regexp_extract(substr(text, s0 + 1, 1200), '(?s)^.*[.!?]', 0))
   WHEN length(regexp_extract(substr(text, s0 + 1, 1200), '(?s)^.* ', 0)) - 1 > 40 THEN length(regexp_extract(substr(text, s0 + 1, 1200), '(?s)^.* ', 0)) - 1 ELSE length(substr(text, s0 + 1, 1200)) END""").replace("s0", "0", 6).replace("s0", "s")


@query(
    "chunk_documents",
    f"WITH RECURSIVE {SQL_CHUNKS} SELECT doc_id, no AS chunk_no, s AS off, CAST(e - s AS BIGINT) AS n_chars, md5(substr(text, s + 1, e - s)) AS digest FROM c"
)
def chunk_documents(spark, sf_dir):
    c = chunk.chunks(docs(spark, sf_dir))
    return c.select("doc_id", "chunk_no", "off", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("context_window", r"""
WITH m AS (SELECT doc_id, text, lower(regexp_extract(text, '[A-Z][a-z]{4,}', 0)) AS m FROM documents), p AS (SELECT *, instr(lower(text), m) AS k FROM m)
SELECT doc_id, m AS mention, CASE WHEN k > 0 THEN substr(lower(text), greatest(k - 51, 0) + 1, least(length(text), k - 1 + length(m) + 50) - greatest(k - 51, 0)) ELSE '' END AS near FROM p WHERE m <> ''
""")
def context_window(spark, sf_dir):
    m = docs(spark, sf_dir).select(
        "doc_id", "text", F.lower(F.regexp_extract("text", "[A-Z][a-z]{4,}", 0)).alias("mention")
    ).filter("mention <> ''")
    return m.select("doc_id", "mention", context(F.col("text"), F.col("mention"), 50).alias("near"))


@query("markup_detect", r"""
SELECT page_id, CASE WHEN regexp_matches(url, '\.(xml|tei)$') OR contains(substr(html, 1, 500), '<?xml') OR contains(substr(html, 1, 500), '<TEI') THEN 'xml' WHEN length(html) = 0 THEN 'empty' ELSE 'text' END AS kind,
  CAST(length(html) AS BIGINT) AS n_chars FROM pages
""")
def markup_detect(spark, sf_dir):
    """What an upload is taken for, by its name and its first 500 characters."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", sources.kind_of(F.col("url"), F.col("html")).alias("kind"), F.length("html").cast("long").alias("n_chars"))


def _escaped(text):
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


@query("xml_paragraphs", r"""
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_paragraphs, array_to_string(l, chr(10)) AS text FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
""")
def xml_paragraphs(spark, sf_dir):
    """Documents written as TEI, one paragraph a line with its markup characters escaped, and read again by the extractor."""
    d = docs(spark, sf_dir)
    lines = F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))
    )
    tei = d.select(
        "doc_id",
        F.concat(
            F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>'), F.array_join(lines, ""), F.lit("</body></text></TEI>")
        ).alias("content")
    )
    got = sources.extract_tei(tei)
    return got.select("doc_id", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.col("visual").alias("text"))
