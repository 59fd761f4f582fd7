"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Every text is the set of its 5-word shingles (letters and digits only, lower case). Benchmark items are
partitioned by the size of their set. An item of n shingles keeps a MinHash signature of its k smallest
shingle hashes, k = n - ceil(threshold * n) + 1 for its partition's n: a document that contains at least
`threshold` of the item misses fewer than k of its shingles, so it must hold one of these k. The search
joins the documents' shingle hashes with the signatures; what it finds is verified by counting the item's
shingles, as words, in the document. So nothing that reaches the threshold is lost, and nothing below it
is reported. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import anti_join, column, settle, small_or_not

SHINGLE = 5
THRESHOLD = 0.75
#: Up to so many signature rows (16 bytes each) or candidate rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _runs(items: Column, width: int, of) -> Column:
    n = F.size(items) - width
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), of)).otherwise(F.array())


def shingle_hashes(hashes: Column, width: int) -> Column:
    """64-bit hashes of runs of `width` words over the words' hashes."""
    return _runs(hashes, width, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def shingle_texts(words: Column, width: int) -> Column:
    return F.array_distinct(_runs(words, width, lambda i: F.array_join(F.slice(words, i + 1, F.lit(width)), " ")))


def item_sets(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """item_id, width, n and the hashes of each item; one with fewer words than `width` is one shingle of all of them.

    Items without words are left out: nothing can contain them. Items with equal ids are one, the union of their shingles.
    """
    words = items.select(column(id_col).alias("item_id"), plain_words(column(text_col)).alias("_words")).filter(F.size("_words") > 0)
    words = words.withColumn("width", F.least(F.size("_words"), F.lit(width)))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    own = F.when(F.col("width") == width, shingle_hashes(hashes, width))
    for w in range(width - 1, 0, -1):
        own = own.when(F.col("width") == w, shingle_hashes(hashes, w))
    each = words.select("item_id", "width", F.explode(own).alias("hash"), "_words").select("item_id", "width", "hash").distinct()
    return each.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("hash", "width"))).alias("set")).withColumn("n", F.size("set"))


def signatures(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(hash, width, item_id): the k smallest hashes of each item, k by its size partition (one for each n)."""
    k = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    return sets.select("item_id", F.explode(F.slice("set", F.lit(1), k.cast("int"))).alias("_s")).select(
        "item_id", F.col("_s.hash").alias("hash"), F.col("_s.width").alias("width")
    )


def document_shingles(docs: DataFrame, widths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, hash, width) of every shingle of every document, as often as it has it."""
    words = docs.select(column(id_col).alias("doc_id"), F.transform(plain_words(column(text_col)), lambda w: F.xxhash64(w)).alias("_h"))
    sides = [words.select("doc_id", F.explode(shingle_hashes(F.col("_h"), w)).alias("hash"), F.lit(w).alias("width")) for w in widths]
    out = sides[0]
    for x in sides[1:]:
        out = out.unionByName(x)
    return out


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document and benchmark item it contains: doc_id, item_id, n_shingles, n_found, containment.

    Null or wordless texts contain nothing and null ids, of documents and items, are reported as null; documents
    with equal ids, null ones among them, are held together as one, and so are items. An empty table on either side gives no rows.
    """
    sets = settle(item_sets(items, item_id_col, item_text_col, width))
    widths = [r[0] for r in sets.select(F.explode("set.width").alias("w")).distinct().collect()] or [width]  # at most `width` numbers
    signs, _ = small_or_not(settle(signatures(sets, threshold)), BROADCAST_ROWS)
    found = document_shingles(docs, sorted(widths), id_col, text_col).join(signs, ["hash", "width"]).select("doc_id", "item_id").distinct()
    found = settle(found)
    wanted, _ = small_or_not(settle(found.select("doc_id").distinct()), BROADCAST_ROWS)
    text = docs.select(column(id_col).alias("_doc"), column(text_col).alias("_text")).join(
        wanted, F.col("_doc").eqNullSafe(F.col("doc_id")), "left_semi"
    )
    # Verification counts shingles as words, not as hashes.
    doc_sets = text.select("_doc", plain_words(F.col("_text")).alias("_words"))
    item_words = items.select(
        column(item_id_col).alias("item_id"), plain_words(column(item_text_col)).alias("_words")
    ).filter(F.size("_words") > 0)
    item_words = item_words.withColumn("width", F.least(F.size("_words"), F.lit(width)))

    def texts_of(frame: DataFrame, keys: list[str], w: int) -> DataFrame:
        return frame.select(*keys, F.lit(w).alias("width"), F.explode(shingle_texts(F.col("_words"), w)).alias("shingle"))

    wide = [texts_of(item_words.filter(F.col("width") == w), ["item_id"], w) for w in sorted(widths)]
    held = [texts_of(doc_sets, ["_doc"], w) for w in sorted(widths)]
    for frames in (wide, held):
        while len(frames) > 1:
            frames[0] = frames[0].unionByName(frames.pop())
    wide_set = settle(wide[0].distinct())
    sizes = wide_set.groupBy(F.col("item_id").alias("_item")).agg(F.count("*").alias("n_shingles"))
    shingles, _ = small_or_not(wide_set, BROADCAST_ROWS)
    counted = held[0].distinct().join(shingles, ["shingle", "width"]).groupBy("_doc", "item_id").agg(F.count("*").alias("n_found"))
    pairs = counted.join(
        found, F.col("_doc").eqNullSafe(F.col("doc_id")) & counted["item_id"].eqNullSafe(found["item_id"]), "left_semi"
    ).join(sizes, F.col("item_id").eqNullSafe(F.col("_item")))
    share = F.col("n_found") / F.col("n_shingles")
    return pairs.select(
        F.col("_doc").alias("doc_id"), "item_id", "n_shingles", "n_found", share.alias("containment")
    ).filter(F.col("n_found") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """docs without those that contain an item, all columns as they are.

    Rows with equal ids, null ones among them, are one document: they go or stay together. An empty table on either side
    loses nothing.
    """
    bad = settle(contained_items(docs, items, id_col=id_col, **params).select("doc_id").distinct())
    return anti_join(docs, small_or_not(bad, BROADCAST_ROWS)[0], id_col)
