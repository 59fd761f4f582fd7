"""Candidate retrieval from person and place tables, enrichment and the location graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.strings import filled, fragments, split_pipe, uri_segment, uri_source
from vellum.operators.rows import fits
from vellum.plans.durable import no_constraints, settle

PERSON_LIMIT, PLACE_LIMIT = 30, 1000
#: Names up to so many rows (and rows.fits() bytes) are broadcast and compared with every mention; more are found by their 3-grams.
BROADCAST_NAMES = 50_000
#: Names, and keys, that meet at one 3-gram in one task at most, about.
HOT = 10_000


def last_token(name: Column) -> Column:
    """The last word of a name, commas taken as blanks, lower case."""
    words = F.filter(F.split(F.lower(F.replace(name, F.lit(","), F.lit(" "))), r"(?U)\s+"), lambda x: x != "")
    return F.try_element_at(words, F.lit(-1))


def _grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))


def _salt(rows: DataFrame, parts: str):
    """A number below the column `parts`, by a hash of the row."""
    hashed = [f"`{f.name}`" for f in rows.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*hashed), F.col(parts)).cast("int")


def by_rarest_gram(keys: DataFrame, names: DataFrame) -> DataFrame:
    """keys(_key) and names(_name, ...) joined where _name contains _key, for keys of three characters or more.

    A name that contains a key has all its 3-grams, so they meet at the gram of the key that fewest names have; a key with a gram that no name has
    meets nothing. Where many names or many keys meet at one gram all the same, they are dealt by salts over a grid, HOT of each in a cell.
    """
    grams = names.select("*", F.explode(_grams(F.col("_name"))).alias("_gram"))
    counted = settle(grams.groupBy("_gram").agg(F.count("*").alias("_n")))  # as many rows as there are 3-grams
    each = keys.select("_key", F.explode(_grams(F.col("_key"))).alias("_gram")).join(counted, "_gram", "left")
    rarest = each.groupBy("_key").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_r"))
    asked = settle(rarest.filter("_r.n > 0").select("_key", F.col("_r.g").alias("_gram")))
    parts = lambda c: F.ceil(F.col(c) / HOT).cast("int")
    sizes = asked.groupBy("_gram").agg(F.count("*").alias("_m")).join(counted, "_gram").select("_gram", parts("_m").alias("_kp"), parts("_n").alias("_np"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    k = asked.join(sizes, "_gram")
    k = k.withColumn("_k", F.pmod(F.xxhash64("_key"), F.col("_kp")).cast("int")).withColumn("_c", upto("_np")).drop("_kp", "_np")
    n = grams.join(sizes, "_gram")  # only the grams that some key meets at
    n = n.withColumn("_c", _salt(names, "_np")).withColumn("_k", upto("_kp")).drop("_kp", "_np")
    return k.join(n, ["_gram", "_k", "_c"]).filter(F.contains(F.col("_name"), F.col("_key"))).drop("_gram", "_k", "_c")


def contains_join(mentions: DataFrame, names: DataFrame, key: str, name: str, blocked: bool | None = None) -> DataFrame:
    """Pairs where lower(names.name) contains lower(mentions.key).

    Different keys are joined once, however many mentions have them. Few names are broadcast under a size check; of many, keys of three characters or more meet
    those that share their rarest 3-gram, and shorter ones are compared with the broadcast of their own few different values.
    """
    m = mentions.withColumn("_key", F.lower(F.col(key))).filter(F.col("_key").isNotNull() & (F.col("_key") != ""))
    n = names.withColumn("_name", F.lower(F.col(name)))
    keys = m.select("_key").distinct()
    if blocked is None:
        blocked = not fits(names, BROADCAST_NAMES)
    if not blocked:
        met = keys.join(F.broadcast(n), F.contains(F.col("_name"), F.col("_key")))
    else:
        short = F.broadcast(keys.filter(F.length("_key") < 3))  # at most all strings of two characters
        few = n.join(short, F.contains(F.col("_name"), F.col("_key")))
        met = by_rarest_gram(keys.filter(F.length("_key") >= 3), n).unionByName(few)
    return m.join(met, "_key").select(*m.columns, *names.columns).drop("_key")


def limit_per(pairs: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return pairs.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n")


def retrieve_persons(
    mentions: DataFrame, persons: DataFrame, by: list[str], key: str = "mention", name: str = "full_name", uri: str = "person",
    most: int = PERSON_LIMIT
) -> DataFrame:
    """Persons whose name contains the mention's last word, the first `most` by URI for each mention.

    Persons of one name meet the same mentions, so only the first `most` of each name can be among a mention's first.
    """
    persons = limit_per(persons, [name], [uri], most)
    return limit_per(
        contains_join(mentions.withColumn("_last", last_token(F.col(key))), persons, "_last", name).drop("_last"), by, [uri], most
    )


def retrieve_places(
    mentions: DataFrame, places: DataFrame, by: list[str], key: str = "mention", name: str = "name", uri: str = "place",
    most: int = PLACE_LIMIT
) -> DataFrame:
    """Places whose name contains the whole mention, the first `most` by URI for each mention."""
    return limit_per(contains_join(mentions, places, key, name), by, [uri], most)


def link_mentions(
    mentions: DataFrame, persons: DataFrame, places: DataFrame, by: list[str], person_name: str = "full_name", place_name: str = "name",
    parents: str | None = "parentPlace", prefix: str = ""
) -> tuple[DataFrame, DataFrame | None]:
    """(blocks, edges) for a table of mentions (by, mention, label): PER mentions meet persons, LOC mentions places, other labels nothing.

    blocks has a row for each mention, with `candidates`, the URIs found, in order, an empty array where there are none;
    edges are the places' (child, parent), None if places have no column of parents.
    """
    both = mentions.select(*by, "mention", "label").distinct()
    per = retrieve_persons(
        both.filter("label = 'PER'"), persons.select(F.col("person").alias("uri"), F.col(person_name).alias("_found")),
        [*by, "mention", "label"], name="_found", uri="uri"
    )
    loc = retrieve_places(
        both.filter("label = 'LOC'"), places.select(F.col("place").alias("uri"), F.col(place_name).alias("_found")),
        [*by, "mention", "label"], name="_found", uri="uri"
    )
    found = per.select(*by, "mention", "label", F.col("uri").cast("string").alias("uri")).unionByName(
        loc.select(*by, "mention", "label", F.col("uri").cast("string").alias("uri"))
    )
    lists = found.groupBy(
        *[F.col(c).alias(f"_{c}") for c in (*by, "mention", "label")]
    ).agg(F.array_sort(F.collect_set("uri")).alias("candidates"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "mention", "label")])
    blocks = mentions.join(lists, same, "left").select(
        *mentions.columns, F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates")
    )
    return blocks, location_edges(places.withColumn("parentPlace", F.col(parents)), prefix) if parents in places.columns else None


def group_places(
    rows: DataFrame, uri: str = "place", single: tuple[str, ...] = (), many: tuple[str, ...] = (), sep: str = " | "
) -> DataFrame:
    """One row a place: the least value of each `single` column, the distinct sorted values of each `many` column joined by sep."""
    aggs = [F.min(c).alias(c) for c in single] + [F.array_join(F.array_sort(F.collect_set(c)), sep).alias(c) for c in many]
    return rows.groupBy(uri).agg(*aggs)


def in_graphs(triples: DataFrame, graphs: list[str]) -> DataFrame:
    return triples.filter(F.col("graph").isin(graphs))


def write_graphs(triples: DataFrame, path: str, files: int = 8) -> None:
    """Triples (graph, s, p, o) as Parquet, a folder for each named graph, so that readers open the folders of their graphs only.

    A graph is dealt over `files` files by subject, however large it is, each in order of predicate and subject, so that readers
    of one predicate skip row groups. A null graph has a folder of its own, which no list of graphs asks for.
    """
    dealt = triples.select("s", "p", "o", "graph").repartition("graph", F.pmod(F.xxhash64("s"), F.lit(files)))
    dealt.sortWithinPartitions("graph", "p", "s").write.mode("overwrite").partitionBy("graph").parquet(path)


def read_graphs(spark, path: str, graphs: DataFrame) -> DataFrame:
    """The triples of the named graphs that graphs(graph) lists, once each however often it does.

    The list is evaluated first and prunes the folders that are read (dynamic partition pruning), so its rows may come from any query.
    """
    triples = spark.read.option("recursiveFileLookup", "false").schema("s string, p string, o string, graph string").parquet(path)
    return triples.join(graphs.select("graph").distinct(), "graph", "left_semi").select("graph", "s", "p", "o")


def property_values(triples: DataFrame, predicates: list[str], name: str, inverse: bool = False) -> DataFrame:
    """(s, name) for any of the predicates; inverse swaps subject and object. Left-join it for an optional property."""
    s, o = ("o", "s") if inverse else ("s", "o")
    return triples.filter(F.col("p").isin(predicates)).select(F.col(s).alias("s"), F.col(o).alias(name))


def person_label(label: Column, uri: Column) -> Column:
    """`Surname, Forename` turned about; without a label the last segment but one of the URI."""
    turned = F.when(
        F.instr(label, ",") > 0,
        F.concat_ws(" ", F.trim(F.substring(label, F.instr(label, ",") + 1, F.length(label))), F.trim(F.substring_index(label, ",", 1)))
    ).otherwise(label)
    return F.coalesce(filled(turned), uri_segment(uri, -2))


def merge_persons(rows: DataFrame, by: list[str], fields: list[str], order: str = "ord") -> DataFrame:
    """One row a person: the first filled value of each field in order, residence labels united in order.

    rows have `person`, `residences` (a `|`-joined string of URIs) and the fields.
    """
    labels = F.transform(split_pipe(F.col("residences")), lambda u: uri_segment(u, -2))
    first = [F.min_by(F.col(c), F.when(filled(F.col(c)).isNotNull(), F.col(order))).alias(c) for c in fields]
    merged = rows.withColumn("_labels", labels).groupBy(*by, "person").agg(
        *first, F.min_by("residences", F.when(filled(F.col("residences")).isNotNull(), F.col(order))).alias("residences"),
        F.array_distinct(
            F.flatten(
                F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_labels").alias("l")))), lambda x: x["l"])
            )
        ).alias("residencesLabels"))
    return merged.withColumn("label", person_label(F.col("label"), F.col("person"))) if "label" in fields else merged


def shape_places(rows: DataFrame, sep: str = r" \| ") -> DataFrame:
    """Place candidates from grouped rows: joined strings become arrays, types their fragments, sources from URIs."""
    cut = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: F.trim(x) != "")
    return rows.select(
        "place", F.col("era"), "english", "irish", fragments(cut("types")).alias("types"), "parentPlace", F.transform(
            cut("parentPlace"), lambda u: F.replace(uri_segment(u, -2), F.lit("_"), F.lit(" "))
        ).alias("parentLabels"),
        cut("sameAs").alias("sameAs"), F.transform(
            cut("sameAs"), lambda u: uri_source(u)
        ).alias("externalResources"), cut("historicalApproximations").alias("historicalApproximations"))


def location_edges(places: DataFrame, prefix: str = "") -> DataFrame:
    """(child, parent), distinct, for every parent URI that starts with the knowledge graph's prefix."""
    each = places.select(F.col("place").alias("child"), F.explode(split_pipe(F.col("parentPlace"))).alias("parent"))
    return each.filter(F.col("parent").startswith(prefix) & (F.col("parent") != "")).distinct()


def inverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("parent").alias("parent"), F.col("child").alias("child")
    ).groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def transitive_closure(edges: DataFrame, most_rounds: int = 30) -> DataFrame:
    """(child, ancestor) of every pair joined by a path; cycles end by the anti join. Each round's pairs are settled.

    Paths double in length each round, so most_rounds is far beyond any hierarchy; it is an error if they do not suffice.
    """
    with no_constraints(edges.sparkSession):
        pairs = settle(edges.select("child", F.col("parent").alias("ancestor")).distinct())
        for _ in range(most_rounds):
            longer = pairs.alias("x").join(pairs.alias("y"), F.col("x.ancestor") == F.col("y.child")).select(
                F.col("x.child").alias("child"), F.col("y.ancestor").alias("ancestor")
            )
            new = settle(longer.distinct().join(pairs, ["child", "ancestor"], "left_anti"))
            if new.isEmpty():
                return pairs
            pairs = settle(pairs.union(new))
    raise RuntimeError(f"the closure is not complete after {most_rounds} rounds")


def location_label(english: Column, irish: Column, uri: Column) -> Column:
    return F.coalesce(filled(english), filled(irish), F.replace(uri_segment(uri, -2), F.lit("_"), F.lit(" ")))


def ancestor_labels(candidates: DataFrame, closure: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, ancestorLabels): distinct labels of all ancestors of the candidate's residences, sorted. nodes: (place, english, irish)."""
    homes = candidates.select(*by, F.explode(split_pipe(F.col("residences"))).alias("child")).distinct()
    up = homes.join(closure, "child").join(nodes.select(F.col("place").alias("ancestor"), "english", "irish"), "ancestor", "left")
    return up.groupBy(*by).agg(
        F.array_sort(F.collect_set(location_label(F.col("english"), F.col("irish"), F.col("ancestor")))).alias("ancestorLabels")
    )


def entity_card(uri: Column, old: str, new: str) -> Column:
    """The card's address: the URI with its prefix replaced, if it has it."""
    return F.when(uri.startswith(old), F.concat(F.lit(new), F.substring(uri, F.lit(len(old) + 1), F.length(uri)))).otherwise(uri)
