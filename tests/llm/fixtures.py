"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, part string, shard int, size long, hash string"

BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word30", "other")
LONG = " ".join(f"tok{i % 977}x{i}" for i in range(6000))


def rows():
    texts = [
        (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, NEAR, "en", None), (4, None, None, "b"), (5, "", "de", "b"), (6, " \t\n", "fr", "c"), (7, LONG, "en", "a"), (8, "one two", "en", "c"), (9, "One TWO", "en", "c"),
        (10, "ça été là où naïve", "fr", None), (11, BASE.upper(), None, "a"), (12, "x" * 50_000, "en", "a"), (
            13, "Ein Satz. Noch einer!\n\nDritter Absatz?", "de", "b"
        ), (13, "same id, another text", "en", "b"), (None, "text without an id", "en", "b"),
        (20, "one two", "en", "c"), (20, "one two", "en", "c"),
    ]
    return [(i, t, lang, s, len(t or ""), 1, "p", 2, 3, "h") for i, t, lang, s in texts]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
