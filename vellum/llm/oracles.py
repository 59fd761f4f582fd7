"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_PLAIN = r"regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}]+')"


def _runs(words: str, width: str) -> str:
    return f"list_transform(range(1, len({words}) - {width} + 2), lambda i: array_to_string(list_slice({words}, i, i + {width} - 1), ' '))"


DECONTAMINATE = f"""
WITH iw AS (SELECT item_id, {_PLAIN.format(text='text')} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest({_runs('w', 'least(len(w), 5)')}) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
dw AS (SELECT doc_id, {_PLAIN.format(text='text')} AS w FROM documents),
d AS (SELECT DISTINCT doc_id, k, unnest({_runs('w', 'k')}) AS s FROM dw, (SELECT DISTINCT k FROM i) z),
c AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN i USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM c JOIN n USING (item_id) WHERE 100 * n_found >= 75 * n_shingles
"""

SUBSTRINGS = f"""
WITH t AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
x AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word, len(w) AS n FROM t),
y AS (SELECT doc_id, pos, CASE WHEN pos + 19 <= len(w) THEN md5(array_to_string(list_slice(w, pos, pos + 19), ' ')) END AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM t) q),
f AS (SELECT doc_id, pos, CASE WHEN win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS late FROM y),
g AS (SELECT x.doc_id, x.pos, x.word, sum(late) OVER (PARTITION BY x.doc_id ORDER BY x.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone, late, lag(late, 1, 0) OVER (PARTITION BY x.doc_id ORDER BY x.pos) AS before FROM x JOIN f ON f.doc_id = x.doc_id AND f.pos = x.pos),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept, count(*) FILTER (WHERE late = 1 AND before = 0) AS n_repeats FROM g GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_repeats, 0) AS n_repeats FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JACCARD = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN {_runs('w', '5')} ELSE [array_to_string(w, ' ') || ' only'] END) AS s FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, y AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce((SELECT min(other) FROM r WHERE r.doc_id = t.doc_id), t.doc_id)) AS component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id
"""


def _permuted(source: str, v: str, rounds: int, key: str) -> str:
    """Rows of source with p, the Feistel rounds applied to v once; source has a and b."""
    sql = f"SELECT *, {v} // b AS l, {v} % b AS r FROM {source}"
    for i in range(rounds):
        own, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        sql = f"SELECT * REPLACE (({own} + CAST('0x' || substr(md5('{key}:{i}:' || {other}), 1, 8) AS BIGINT) % {size}) % {size} AS {own}) FROM ({sql}) q{i}"
    return f"SELECT * EXCLUDE (l, r), l * b + r AS p FROM ({sql}) q"


def sharding(shards: int, key: str) -> str:
    """Row numbers by hash bucket, the walk as a recursion, and CRC-32 by its table."""
    first = _permuted("numbered", "row", 6, key)
    again = _permuted(
        "(SELECT * EXCLUDE (p), p AS v FROM walk WHERE p >= n) w", "v", 6, key
    ).replace("SELECT * EXCLUDE (l, r), ", "SELECT * EXCLUDE (l, r, v), ", 1)
    return f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda k: list_reduce(list_prepend(k, range(0, 8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size,
  list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
k AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda s, x: xor(s // 256, t[(xor(s, x) & 255) + 1])), 4294967295) AS crc FROM d, tab),
c AS (SELECT *, substr(md5(doc_id || ':' || crc), 1, 3) AS bucket FROM k),
total AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents),
numbered AS (SELECT doc_id, size, crc, row_number() OVER (ORDER BY bucket, doc_id) - 1 AS row, n, a, (n + a - 1) // a AS b FROM c, total),
walk AS ({first} UNION ALL {again})
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(p % {shards} AS INT) AS shard, p // {shards} AS slot, CAST(NULL AS INT) AS grown_shard FROM walk WHERE p < n
"""

_SEED = "CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {at}, 8) AS BIGINT)"
_JOIN = "array_to_string(list_slice(w, {a}, {b}), '')"
INFILL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, {", ".join(f"{_SEED.format(at=8 * i + 1)} AS h{i + 1}" for i in range(4))} FROM documents),
u AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, {_JOIN.format(a=1, b='a')} AS pre, {_JOIN.format(a='a + 1', b='b')} AS mid, {_JOIN.format(a='b + 1', b='n')} AS suf FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

_GRAMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_FEATURES = "unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' ')))))"
RESAMPLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_GRAMS} AS w FROM documents),
b AS (SELECT {_GRAMS} AS w FROM benchmark),
df AS (SELECT row, {_FEATURES} AS f FROM d), dc AS (SELECT row, f, count(*) AS c FROM df GROUP BY row, f),
bf AS (SELECT {_FEATURES} AS f FROM b), bc AS (SELECT f, count(*) AS c FROM bf GROUP BY f),
tab AS (SELECT list_transform(range(0, 256), lambda k: list_reduce(list_prepend(k, range(0, 8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
v AS (SELECT f, list_transform(regexp_extract_all(hex(f), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM (SELECT f FROM dc UNION SELECT f FROM bc) z),
x AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda s, y: xor(s // 256, t[(xor(s, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, tab),
s AS (SELECT bucket, CAST(sum(c) AS DOUBLE) AS s FROM dc JOIN x USING (f) GROUP BY bucket), t AS (SELECT bucket, CAST(sum(c) AS DOUBLE) AS t FROM bc JOIN x USING (f) GROUP BY bucket),
g AS (SELECT k.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000) / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(0, 10000)) AS bucket) k LEFT JOIN s ON s.bucket = k.bucket LEFT JOIN t ON t.bucket = k.bucket),
m AS (SELECT row, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * gain) AS BIGINT) AS weight FROM dc JOIN x USING (f) JOIN g USING (bucket) GROUP BY row),
z AS (SELECT doc_id, len(w) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM d LEFT JOIN m ON m.row = d.row),
r AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 5 * (SELECT count(*) FROM z WHERE enough) // 100 THEN place END AS rank FROM r
"""

_WHOLE = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"
TOPK = f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, {_WHOLE} AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.row AS row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
