"""Document fingerprints: a Merkle tree over sections and paragraphs.

Leaves are the paragraphs: stretches of text that end after sentence marks or a line's end, cut at
PARAGRAPH characters; joined they are the text again. A section ends with a leaf whose digest begins with
ENDS, one in sixteen, or with the text; so sections are told by their content, and what is put in or taken
out changes its own section but moves no other. A leaf's digest is 16 hex digits of its MD5, a section's
that of its leaves' digests, the root is the MD5 of the sections' digests. So equal roots mean equal texts,
and differing branches lead to the edits: only sections that the other tree has not are opened (see
located_edits()).

A fingerprint is `root:leaf,leaf,...`; sections and their digests follow from the leaves. All of it is
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import column, long_array, settle

PARAGRAPH = 120
#: First hex digit of the digest of a leaf that ends its section.
ENDS = "0"
#: Covers every character: a run without marks and the marks after it, or marks alone.
LEAF = r"([^\n.!?]{1,%d}[\n.!?]*|[\n.!?]+)"
DIGITS = 16
#: Documents in one stretch of the order of ids, on the average, and stretches at most beside one for each cell.
STRETCH, STRETCHES = 500, 200_000
#: Cells of the order of ids, between quantiles.
CELLS = 1000


def leaves(text: Column) -> Column:
    """Digests of the paragraphs, in order; none for null or empty text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LEAF % PARAGRAPH), F.lit(1))
    return F.transform(found, lambda p: F.substring(F.md5(p), 1, DIGITS))


def _cuts(of: Column) -> tuple[Column, Column]:
    """For each section of a column of leaf digests the number of leaves before it, and up to its end."""
    n = F.size(of)
    every = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    ends = F.filter(every, lambda i: (i <= n) & ((i == n) | F.get(of, i - 1).startswith(ENDS)))
    return F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0)))), ends


def cut_sections(of: Column) -> Column:
    """The leaf digests of each section, from a column (not an expression, which would be worked out again and again) of leaf digests."""
    before, ends = _cuts(of)
    cut = F.zip_with(before, ends, lambda a, b: F.slice(of, a + 1, b - a))
    return F.when(F.size(of) > 0, cut).otherwise(F.array().cast("array<array<string>>"))


def sections(of: Column) -> Column:
    """Digests of the sections over a column of leaf digests."""
    return F.transform(cut_sections(of), lambda g: F.substring(F.md5(F.array_join(g, ",")), 1, DIGITS))


def fingerprint(of: Column, over: Column | None = None) -> Column:
    """The fingerprint from a column of leaf digests, and one of section digests if there is one."""
    return F.concat(F.md5(F.array_join(over if over is not None else sections(of), ",")), F.lit(":"), F.array_join(of, ","))


def leaves_of(print_: Column) -> Column:
    """The leaf digests in a fingerprint."""
    return F.filter(F.split(F.substring_index(print_, ":", -1), ","), lambda x: x != "")


def likeness(leaves_a: Column, sections_a: Column, leaves_b: Column, sections_b: Column) -> Column:
    """Of two trees: 2 * common / both numbers of different branches, sections and leaves alike; two empty trees are alike."""
    size = lambda x: F.size(F.array_distinct(x))
    both = size(leaves_a) + size(sections_a) + size(leaves_b) + size(sections_b)
    common = F.size(F.array_intersect(sections_a, sections_b)) + F.size(F.array_intersect(leaves_a, leaves_b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * common / both)


def located_edits(before: DataFrame, after: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, leaf, start, end): the paragraphs of `after` that its document in `before` does not have, by their characters, counted from 0.

    Roots are compared first; of documents whose roots differ, sections; leaves are compared only under sections
    that the other tree has not. A document that `before` lacks, or has with no text, is new from end to end; null text is
    empty; null ids match null ids; rows with equal ids are compared with all their namesakes, and rows that repeat whole are one; an
    empty table gives no rows. No text leaves the task that reads it, only digests and lengths do.
    """

    def trees(docs: DataFrame) -> DataFrame:
        pieces = F.regexp_extract_all(F.coalesce(column(text_col), F.lit("")), F.lit(LEAF % PARAGRAPH), F.lit(1))
        leaf = F.transform(pieces, lambda p: F.struct(F.substring(F.md5(p), 1, DIGITS).alias("digest"), F.length(p).alias("n")))
        of = docs.select(column(id_col).alias("doc_id"), leaf.alias("leaf"))
        of = of.select("doc_id", F.col("leaf.digest").alias("leaves"), F.col("leaf.n").alias("sizes"))
        of = of.withColumn("digests", sections(F.col("leaves")))
        return of.withColumn("root", F.md5(F.array_join("digests", ",")))

    old, new = trees(before).alias("o"), trees(after).alias("n")
    same = F.col("o.doc_id").eqNullSafe(F.col("n.doc_id"))
    differ = new.join(old.select("o.doc_id", "o.root"), same & (F.col("o.root") == F.col("n.root")), "left_anti")
    differ = differ.dropDuplicates(["doc_id", "root"])
    cutting = lambda a, b: F.struct(
        a.alias("first"), *[F.slice(F.col(c), a + 1, b - a).alias(c) for c in ("leaves", "sizes")]
    )
    part = F.zip_with(*_cuts(F.col("leaves")), cutting)
    cut = differ.filter(F.size("leaves") > 0).select("doc_id", "root", "digests", F.posexplode(part).alias("nth", "part"))
    cut = cut.select("doc_id", "root", "nth", "part", F.get("digests", F.col("nth")).alias("digest"))
    total = F.aggregate("part.sizes", F.lit(0).cast("long"), lambda n, x: n + x)
    line = Window.partitionBy("doc_id", "root").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("at", F.coalesce(F.sum(total).over(line), F.lit(0))).alias("n")
    opened = cut.join(old.select("o.doc_id", F.explode("o.digests").alias("digest")).alias("o"), same & (F.col("o.digest") == F.col("n.digest")), "left_anti")
    upto = lambda k: F.aggregate(F.slice("part.sizes", F.lit(1), k), F.col("at"), lambda n, x: n + x)
    each = opened.select("doc_id", "part", "at", F.posexplode("part.leaves").alias("k", "digest"))
    each = each.select("doc_id", (F.col("part.first") + F.col("k")).alias("leaf"), upto(F.col("k")).alias("start"), upto(F.col("k") + 1).alias("end"), "digest").alias("n")
    had = old.select("o.doc_id", F.explode("o.leaves").alias("digest")).alias("o")
    return each.join(had, same & (F.col("o.digest") == F.col("n.digest")), "left_anti").select("doc_id", "leaf", "start", "end")


def _place(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are value at most, by bisection."""
    steps = [1 << k for k in range(len(bounds).bit_length())][::-1]
    ends = long_array(bounds)
    take = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(ends, at + s - 1) <= value), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), take)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and next_text, the text of the document after it by ascending id; the last one meets the first.

    Null ids come first; rows with equal ids, and those with null ids, follow one another by their texts' hashes, then
    texts. Null texts count as empty; an empty table gives no rows. Ids are dealt to cells between quantiles, so dense
    clusters of ids get cells of their own, and cells to stretches of equal width of ids, or of hashes where a cell has one id only;
    each stretch's first text is handed to the one before it. So a task sees a stretch, unless more rows than that
    are equal in id and text.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n, *_ = ids.agg(F.count("*")).first()
    per = max(STRETCH, -(-n // STRETCHES))
    cells = max(1, min(CELLS, n // per))
    found = ids.agg(F.percentile_approx("doc_id", [k / cells for k in range(1, cells)] or [0.5], 10 * CELLS)).first()[0] or []
    # A quantile that comes twice is an id of many rows: it gets a cell of its own.
    bounds = sorted(set(found) | {x + 1 for x, y in zip(found, found[1:]) if x == y})
    cell = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_place(F.col("doc_id"), bounds) + 1)
    stats = ids.groupBy(cell.alias("cell")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).collect()  # a row a cell
    base, low, width, parts = [0], [0] * (len(bounds) + 2), [0] * (len(bounds) + 2), [1] * (len(bounds) + 2)
    for r in stats:
        parts[r["cell"]] = k = -(-r["n"] // per)
        if r["low"] != r["high"]:
            low[r["cell"]], width[r["cell"]] = r["low"], -(-(r["high"] - r["low"] + 1) // k)
    for k in parts:
        base.append(base[-1] + k)
    get = lambda xs: F.get(long_array(xs), F.col("_cell"))
    by_id = F.floor((F.col("doc_id") - get(low)) / get(width))
    if any(k > 1 and not w for k, w in zip(parts, width)):  # only then are texts hashed, and read, for it
        by_hash = F.least(F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * get(parts)), get(parts) - 1)
        part = F.when(get(width) > 0, by_id).otherwise(by_hash)
    else:
        part = F.when(get(width) > 0, by_id).otherwise(F.lit(0))
    rows = rows.withColumn("_cell", cell).withColumn("_stretch", (get(base) + part).cast("long")).drop("_cell")
    firsts = settle(rows.groupBy("_stretch").agg(F.min("doc_id").alias("_first")))  # STRETCHES + CELLS rows about, at most
    line = Window.orderBy("_stretch")
    everything = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn("_to", F.coalesce(F.lag("_stretch").over(line), F.max("_stretch").over(everything)))
    guests = rows.join(F.broadcast(firsts), ["_stretch"]).filter(F.col("doc_id").eqNullSafe(F.col("_first")))
    guests = guests.groupBy("_to").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("hash"), "text")).alias("_row"))
    guests = guests.select("_row.doc_id", "_row.text", F.col("_to").alias("_stretch"), F.lit(True).alias("_guest"))
    order = Window.partitionBy("_stretch").orderBy("_guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    led = rows.withColumn("_guest", F.lit(False)).unionByName(guests).withColumn("next_text", F.lead("text").over(order))
    return led.filter(~F.col("_guest")).select("doc_id", "text", "next_text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint, n_leaves, n_sections.

    Null text is empty and has no leaves; rows that repeat give equal rows; an empty table gives none.
    """
    of = docs.select(
        column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text")
    ).withColumn("_leaves", leaves(F.col("text")))
    of = of.withColumn("_sections", sections(F.col("_leaves")))
    return of.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("_leaves"), F.col("_sections")).alias("fingerprint"),
        F.size("_leaves").alias("n_leaves"), F.size("_sections").alias("n_sections")
    )


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, its edited text and the next document's text by their fingerprints.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as
    many, or all, of the next document's (see with_next() for null and equal ids). Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, edited_sections and edited_leaves (different branches of the edited text that
    the text has not). Null text is empty; rows that repeat give a row each; an empty table gives none.
    """
    rows = with_next(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn(
        "_edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    )
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        leaves(F.col("text")).alias("_own"), leaves(F.col("_edited")).alias("_changed"), leaves(F.col("next_text")).alias("_after"),
    )
    names = ("_own", "_changed", "_after")
    rows = rows.withColumns({f"{c}_up": sections(F.col(c)) for c in names})
    own, changed, after = ((F.col(c), F.col(f"{c}_up")) for c in names)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(*own).alias("fingerprint"), fingerprint(*changed).alias("edited_fingerprint"),
        likeness(*own, *changed).alias("near_edited"), likeness(*own, *after).alias("near_next"),
        F.size(
            F.array_except(changed[1], own[1])
        ).alias("edited_sections"), F.size(F.array_except(changed[0], own[0])).alias("edited_leaves"),
    )


#: The same in DuckDB, for one table of documents.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id, text), first_value(coalesce(text, '')) OVER (ORDER BY doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text
  FROM documents),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM d),
l AS (SELECT *, {own} AS own, {changed} AS changed, {after} AS after FROM e),
t AS (SELECT *, {up_own} AS own_up, {up_changed} AS changed_up, {up_after} AS after_up FROM l),
u AS (SELECT *, list_distinct(own) || list_distinct(own_up) AS o, list_distinct(changed) || list_distinct(changed_up) AS c, list_distinct(after) || list_distinct(after_up) AS n FROM t)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
  md5(array_to_string(own_up, ',')) || ':' || array_to_string(own, ',') AS fingerprint, md5(array_to_string(changed_up, ',')) || ':' || array_to_string(changed, ',') AS edited_fingerprint,
  CASE WHEN len(o) + len(c) = 0 THEN 1.0 ELSE CAST(2 * len(list_intersect(o, c)) AS DOUBLE) / (len(o) + len(c)) END AS near_edited,
  CASE WHEN len(o) + len(n) = 0 THEN 1.0 ELSE CAST(2 * len(list_intersect(o, n)) AS DOUBLE) / (len(o) + len(n)) END AS near_next,
  CAST(len(list_filter(list_distinct(changed_up), lambda x: NOT list_contains(own_up, x))) AS INT) AS edited_sections, CAST(len(list_filter(list_distinct(changed), lambda x: NOT list_contains(own, x))) AS INT) AS edited_leaves
FROM u
"""


def oracle() -> str:
    def digests(x: str) -> str:
        return f"list_transform(regexp_extract_all({x}, '{LEAF % PARAGRAPH}', 1), lambda p: substr(md5(p), 1, {DIGITS}))"

    def up(x: str) -> str:
        ends = f"list_filter(range(1, len({x}) + 1), lambda i: i = len({x}) OR {x}[i][1] = '{ENDS}')"
        cut = f"list_transform({ends}, lambda e, k: substr(md5(array_to_string(list_slice({x}, CASE WHEN k = 1 THEN 1 ELSE {ends}[k - 1] + 1 END, e), ',')), 1, {DIGITS}))"
        return cut

    return ORACLE.format(
        own=digests("text"), changed=digests("edited"), after=digests("next_text"), up_own=up("own"), up_changed=up("changed"),
        up_after=up("after")
    )
