"""N-gram Jaccard self-join with PartEnum signatures, and the groups that the links form.

A document is the set of its different 5-word shingles. Two sets link when 100 * intersection >=
PERCENT * union; then their symmetric difference is at most k = (|r| + |s|)(100 - PERCENT) / (100 + PERCENT).

PartEnum. Sizes are cut into bands. A pair is looked for in the band of its larger set, whose upper end u
bounds k; a set therefore signs for its own band and those that a larger partner may have. In a band the
feature domain is cut by a hash into n1 partitions of n2 parts each. As n1 > k / (k2 + 1), in some
partition the two sets differ in k2 features at most, so n2 - k2 of its parts are equal: the subsets of
n2 - k2 parts are enumerated, each is a signature, and the pair shares one. Signatures of few features are
shared by chance; a set leaves its smallest ones out where enough partitions without any such remain for
the guarantee to hold (see signatures()).

Plan. Equal sets count once, as the smallest id. Sets that cannot link with any other are ruled out first by
an exact bound (see needed()), so that a passage which many documents share does not make them meet; the
others sign. Signatures travel as 32-bit keys in packed payloads to parts of the bands. Where documents meet,
they are not paired: first each is compared with one centre of its meeting. When the links found have been
joined to components, the sets sign again, and a part reports only pairs of different components.
A pair is reported only if its parity sketches differ in k bits or fewer, which linked sets always do. What is
reported is verified on the texts' whole sets. Links are never gathered; components come from joins.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import anti_join, column, in_batches, join_dealt, long_array, settle, small_or_not
from vellum.llm.components import connected_components, extended
from vellum.llm.hashing import deal, mix, window_hashes, words_at

SHINGLE = 5
PERCENT = 75
#: Sizes up to here are bands of their own; above, a band's upper end is BAND times its lower end.
SINGLE_BANDS, BAND = 13, 1.15
#: Entries (features of prefixes, signatures) that a part reads at most, on the average.
PART_ENTRIES = 400_000
#: Features for each 512 bits of a band's sketches, and 64-bit words of a sketch at most.
SKETCH_FEATURES, SKETCH_WORDS = 300, 256
BROADCAST_ROWS = 1_000_000
#: Texts hashed at a time.
SLICE_BYTES = 2_000_000


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """For each text the ascending hashes of its different shingles; A-Z count as a-z. All words are hashed at once."""
    raw = [b"" if not t else t.encode("utf-8", "surrogatepass") for t in texts]
    words, where = words_at(b"\n".join(raw), lower=True)
    ends = np.cumsum([len(r) + 1 for r in raw])
    cut = np.searchsorted(where, ends).tolist()
    runs = window_hashes(words, width)
    out, start = [], 0
    for end in cut:
        n = end - start
        if n >= width:
            own = runs[start : end - width + 1].copy()
            own.sort()
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            out.append(own)
        else:
            out.append(mix(window_hashes(words[start:end], n), 100 + n) if n else np.zeros(0, np.uint64))
        start = end
    return out


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    return shingle_sets([text], width)[0]


def needed(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(length, shared): of a set of n features the `length` smallest hashes, of which a set that links with another shares `shared` at least.

    Partners share o = ceil(percent * max / 100) features at least. With l(n) = n / 4 (1 at least) and a prefix of n - o + l
    features, the first l(m) common features, m being the smaller size, are in both prefixes; m is o at least.
    """
    o = -(-n * percent // 100)
    return min(n, n - o + max(1, n // 4)), max(1, o // 4)


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b):
        return False
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


@lru_cache(None)
def band_ends(most: int = 2**40) -> np.ndarray:
    """Upper ends of the size bands."""
    ends = list(range(1, SINGLE_BANDS + 1))
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, int((ends[-1] + 1) * BAND)))
    return np.array(ends)


@lru_cache(None)
def scheme(u: int, percent: int) -> tuple[int, int, int, int, np.ndarray]:
    """(k, n1, n2, k2, kept parts of each subset as 0/1 columns) for a band that ends at u."""
    k = 2 * u * (100 - percent) // (100 + percent)
    if k <= 4:
        n1, n2, k2 = 1, (1, 3, 5, 7, 8)[k], k
    elif k < 12:
        n1, n2, k2 = k // 3 + 1, 6, 2
    else:
        n1, n2, k2 = k // 3 + 1 + -(-k // 36), 4, 2
    keep = np.ones((n2, 0), np.uint64)
    for left_out in combinations(range(n2), k2):
        one = np.ones((n2, 1), np.uint64)
        one[list(left_out)] = 0
        keep = np.hstack([keep, one])
    return k, n1, n2, k2, keep


def signatures(features: np.ndarray, percent: int = PERCENT):
    """(band, 64-bit signatures) of a set for each band in which a partner may look for it.

    A pair has x = n1 - floor(k' / (k2 + 1)) partitions at least in which it differs in k2 features or fewer, with
    k' for this set's own size. If fewer than x partitions have a signature of less than t features, one of
    those x has none such, so signatures of less than t features may go. Of two sets' t the smaller one
    is safe for both: the set with the larger t vouches for a common signature of that many features.
    """
    n = len(features)
    ends = band_ends()
    first, last = bands_of(n, percent)
    where, content = mix(features, 21), mix(features, 22)
    for band in range(first, last + 1):
        u = int(ends[band])
        k, n1, n2, k2, keep = scheme(u, percent)
        cell = (where % np.uint64(n1 * n2)).astype(np.int64)
        total = np.zeros(n1 * n2, np.uint64)
        np.add.at(total, cell, content)
        count = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        parts = mix(total + np.arange(n1 * n2, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), 23).reshape(n1, n2)
        sums = parts @ keep
        sizes = count @ keep.astype(np.int64)
        least = sizes.min(axis=1)
        sure = n1 - min(k, (n + u) * (100 - percent) // (100 + percent)) // (k2 + 1)
        t = next((t for t in (3, 2, 1) if int((least < t).sum()) < sure), 0)
        salt = (
            np.uint64(band) << np.uint64(40)
        ) + np.arange(sums.size, dtype=np.uint64).reshape(sums.shape) * np.uint64(0x9E3779B97F4A7C15)
        yield band, mix(sums + salt, 24)[sizes >= t]


def _slices(texts: pa.Array):
    """Row ranges of about SLICE_BYTES of text."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x.as_py() or "")
        if size >= SLICE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _digest(s: np.ndarray, k: int) -> int:
    return int(mix(s, k).sum(dtype=np.uint64))


def document_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2): the set's size and a 128-bit digest; no text leaves the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                sets = shingle_sets(batch.column(1)[a:b].to_pylist(), width)
                digests = [np.array([_digest(s, k) for s in sets], np.uint64).view(np.int64) for k in (11, 12)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, digests)], schema=schema
                )

    return docs.select(
        column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")
    ).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def _payloads(keys: list[np.ndarray], parts: list[np.ndarray], records: list[bytes], schema: pa.Schema):
    """One row a part: its 32-bit keys in order of their owner, the owners' records and how many keys each has."""
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order, stretches = deal(np.concatenate(parts))
    key, owner = np.concatenate(keys)[order], owner[order]
    out = []
    for p, s in stretches:
        mine = owner[s]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        out.append(
            (
                p, key[s].tobytes(), b"".join([records[o] for o in mine[first].tolist()]),
                np.diff(first, append=len(mine)).astype(np.int32).tobytes()
            )
        )
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=schema.types[i]) for i in range(4)], schema=schema)


PAYLOAD = "part int, keys binary, records binary, counts binary"
_PAYLOAD = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("records", pa.binary()), ("counts", pa.binary())])


def _prefixes(width: int, percent: int, parts: int):
    """Payloads of the sets' prefixes, an owner's record being its digest; equal sets of a slice count once."""

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                own = {_digest(s, 11): s for s in shingle_sets(batch.column(0)[a:b].to_pylist(), width) if len(s)}
                if own:
                    h = [mix(s[: needed(len(s), percent)[0]], 41) for s in own.values()]
                    yield _payloads(
                        [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32) for x in h],
                        [(x >> np.uint64(40)).astype(np.int64) % parts for x in h], [d.to_bytes(8, "little") for d in own], _PAYLOAD
                    )

    return run


def _read(rows: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in rows.column(name)), kind)


def _entries(rows: pa.Table, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different names, where each is first, keys, places in names) of the different pairs of key and name in which the key is not alone."""
    name, first, which = np.unique(names, return_index=True, return_inverse=True)
    entry = _read(rows, "keys", np.uint32).astype(np.uint64) << np.uint64(32) | np.repeat(
        which.astype(np.uint64), _read(rows, "counts", np.int32)
    )
    entry.sort()
    if len(entry):
        entry = entry[np.concatenate([[True], entry[1:] != entry[:-1]])]
    key, member = (entry >> np.uint64(32)).astype(np.uint32), (entry & np.uint64(0xFFFFFFFF)).astype(np.int64)
    again = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    again[1:] |= same
    again[:-1] |= same
    return name, first, key[again], member[again]


def _shared(parts: int):
    """How many of a set's prefix features in this part other sets have in theirs: packed pairs of digest and number, dealt by digest."""
    schema = pa.schema([("part", pa.int32()), ("d1", pa.binary()), ("n", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        name, _, _, member = _entries(rows, _read(rows, "records", np.uint64))
        n = np.bincount(member, minlength=len(name)).astype(np.int32)
        name, n = name[n > 0], n[n > 0]
        order, stretches = deal((name % np.uint64(parts)).astype(np.int64)) if len(name) else (None, [])
        out = [(p, name[order[s]].tobytes(), n[order[s]].tobytes()) for p, s in stretches]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], type=schema.types[i]) for i in range(3)], schema=schema)

    return run, "part int, d1 binary, n binary"


def _summed():
    """(d1, n): the parts' numbers of each set summed up."""
    schema = pa.schema([("d1", pa.int64()), ("n", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        name, which = np.unique(_read(rows, "d1", np.int64), return_inverse=True)
        n = np.bincount(which, weights=_read(rows, "n", np.int32)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(name), pa.array(n)], schema=schema)

    return run, "d1 long, n long"


def sketch_words(band: int) -> int:
    return min(SKETCH_WORDS, 8 * -(-int(band_ends()[band]) // SKETCH_FEATURES))


def parity_sketch(features: np.ndarray, words: int) -> np.ndarray:
    """Parities of the numbers of features that fall to each of 64 * words bits. Each feature that only one of two sets has
    changes one bit, so sketches differ in no more bits than sets in features."""
    bits = np.bincount((mix(features, 51) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def bands_of(n: int, percent: int) -> tuple[int, int]:
    """The first and the last band in which a set of n features signs."""
    first, last = np.searchsorted(band_ends(), [n, max(n, n * 100 // percent)])
    return int(first), int(last)


def band_parts(sizes: list[tuple[int, int, int]], percent: int, part_entries: int) -> np.ndarray:
    """Where each band's parts start among all parts, and their number, from (first band, last band, sets)."""
    ends, entries = band_ends(), {}
    for first, last, sets in sizes:
        for band in range(first, last + 1):
            _, n1, _, _, keep = scheme(int(ends[band]), percent)
            entries[band] = entries.get(band, 0) + sets * n1 * keep.shape[1]
    n = [max(1, -(-entries.get(band, 0) // part_entries)) for band in range(max(entries, default=0) + 1)]
    return np.concatenate([[0], np.cumsum(n)])


def _sign(width: int, percent: int, bands: np.ndarray):
    """Payloads of the signatures of (doc_id, text, label). A record has id, label, size and the band's sketch."""

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                keys, parts, records = [], [], []
                for i, label, s in zip(
                    batch.column(0)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist(),
                    shingle_sets(batch.column(1)[a:b].to_pylist(), width)
                ):
                    if i is None or not len(s):
                        continue
                    head = np.array([i, label, len(s)], np.int64).tobytes()
                    for band, x in signatures(s, percent):
                        keys.append((x & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                        parts.append((x >> np.uint64(40)).astype(np.int64) % int(bands[band + 1] - bands[band]) + int(bands[band]))
                        records.append(head + parity_sketch(s, sketch_words(band)).tobytes())
                if keys:
                    yield _payloads(keys, parts, records, _PAYLOAD)

    return run


def _meet(percent: int, bands: np.ndarray, across: bool):
    """(a, b), a < b, of documents that meet in a part and whose sketches allow a link.

    Not across: each document with the centre of its meetings, the one that meets others most often, in a group of near
    copies most likely their source. Across: all pairs with different labels.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        words = sketch_words(int(np.searchsorted(bands, rows.column("part")[0].as_py(), side="right")) - 1)
        record = _read(rows, "records", np.int64).reshape(-1, 3 + words)
        # Rows with equal ids but different texts are told apart.
        _, first, key, member = _entries(rows, mix(record[:, 0].view(np.uint64)) ^ record[:, 3].view(np.uint64))
        record = record[first]
        ids, label, size, sketch = record[:, 0], record[:, 1], record[:, 2], record[:, 3:].view(np.uint64)
        pairs: list[np.ndarray] = []

        def allowed(x: np.ndarray, y: np.ndarray) -> None:
            """Keep the different pairs (x, y) with sketches near enough."""
            both = np.unique(np.minimum(x, y).astype(np.uint64) << np.uint64(32) | np.maximum(x, y).astype(np.uint64))
            x, y = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for at in range(0, len(x), step := max(1, 2_000_000 // words)):
                p, q = x[at : at + step], y[at : at + step]
                apart = np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1, dtype=np.int64)
                ok = (apart <= (size[p] + size[q]) * (100 - percent) // (100 + percent)) & (ids[p] != ids[q])
                pairs.append(both[at : at + step][ok])

        if len(key):
            meets = np.bincount(member, minlength=len(ids))
            by_rank = np.lexsort((ids, -meets))
            rank = np.empty(len(ids), np.int64)
            rank[by_rank] = np.arange(len(ids))
            order = np.lexsort((rank[member], key))
            key, member = key[order], member[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(starts, append=len(key))
            if not across:
                centre = np.repeat(member[starts], sizes)
                other = centre != member
                allowed(centre[other], member[other])
            else:
                # Meetings in which all have one label are done with; equal meetings are looked at once.
                own = label[member]
                mixed = np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts)
                _, one = np.unique(np.add.reduceat(mix(member.astype(np.uint64), 31), starts), return_index=True)
                chosen = one[mixed[one]]
                for g in np.unique(sizes[chosen]).tolist():
                    block = member[starts[chosen[sizes[chosen] == g]][:, None] + np.arange(g)]
                    for row in np.array_split(block, max(1, block.size * g // 4_000_000)):
                        for i in range(0, g, step := max(1, 4_000_000 // max(1, row.shape[0] * g))):
                            x, y = row[:, i : i + step, None], row[:, None, :]
                            differ = (label[x] != label[y]) & (np.arange(g)[None, i : i + step, None] < np.arange(g)[None, None, :])
                            k, u, v = np.nonzero(differ)
                            if len(k):
                                allowed(row[k, i + u], row[k, v])
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        x, y = ids[(both >> np.uint64(32)).astype(np.int64)], ids[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        return pa.Table.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)

    return run, "a long, b long"


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) that link; texts: (doc_id, text), a row for each different text of an id. Pairs whose texts differ by row may come twice."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            yes = []
            for start, end in _slices(batch.column(3)):
                a, b = batch.column(0)[start:end].to_pylist(), batch.column(1)[start:end].to_pylist()
                x = batch.column(2)[start:end].to_pylist()
                # Rows of one centre follow one another; it is hashed once.
                new = [k for k in range(len(a)) if k == 0 or a[k] != a[k - 1] or x[k] != x[k - 1]]
                centres = iter(shingle_sets([x[k] for k in new], width))
                fresh, centre = set(new), None
                for k, other in enumerate(shingle_sets(batch.column(3)[start:end].to_pylist(), width)):
                    if k in fresh:
                        centre = next(centres)
                    if links(centre, other, percent):
                        yes.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in yes], pa.int64()) for i in range(2)], schema=schema)

    one = join_dealt(pairs, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_y")), "b", "a")
    # A centre of very many pairs has its text sent to several tasks.
    both = join_dealt(
        one, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_x")), "a", "b", keys=pairs
    ).select("a", "b", "_x", "_y")
    return both.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
    part_entries: int = PART_ENTRIES
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, the smallest doc_id that links reach from it, itself included.

    Fewer than `width` words are one shingle of all of them; null text and text without words have none and
    link with nothing. Rows with a null id link with nothing and have a null component. Rows that repeat whole are
    one document; of rows with equal ids but different texts each may take part in the others' links. An empty
    table gives no rows.
    """
    sets = settle(document_sets(in_batches(docs), id_col, text_col, width))
    classes = settle(
        sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    )
    n = sets.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(1, int(n / 2 / part_entries))
    f, schema = _shared(parts)
    prefixes = docs.select(column(text_col).alias("text")).mapInArrow(_prefixes(width, percent, parts), PAYLOAD)
    counted = prefixes.groupBy("part").applyInArrow(f, schema)
    f, schema = _summed()
    shared = counted.groupBy("part").applyInArrow(f, schema)
    o = F.floor((F.col("n_shingles") * percent + 99) / 100)
    able = settle(
        classes.join(shared, "d1").filter(
            F.col("n") >= F.greatest(F.lit(1), F.floor(o / 4))
        ).select(F.col("rep").alias("doc_id"), "n_shingles").distinct()
    )
    ends = long_array(band_ends().tolist())
    band = lambda size: F.size(F.filter(ends, lambda e: e < size))
    size, most = F.col("n_shingles"), F.greatest(F.col("n_shingles"), F.floor(F.col("n_shingles") * 100 / percent))
    by_size = able.groupBy("n_shingles").count().groupBy(band(size).alias("first"), band(most).alias("last")).agg(F.sum("count")).collect()  # a few rows a band
    bands = band_parts([tuple(r) for r in by_size], percent, part_entries)
    ids, _ = small_or_not(able.select("doc_id").distinct(), BROADCAST_ROWS)
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).join(ids, "doc_id", "left_semi")
    # Rows that repeat whole are one.
    texts = settle(texts.groupBy("doc_id", F.xxhash64("text").alias("_digest")).agg(F.min("text").alias("text")).select("doc_id", "text"))

    def met(labelled: DataFrame, across: bool) -> DataFrame:
        f, schema = _meet(percent, bands, across)
        signed = labelled.select("doc_id", "text", "label").mapInArrow(_sign(width, percent, bands), PAYLOAD)
        return signed.groupBy("part").applyInArrow(f, schema).distinct()

    star = settle(met(texts.withColumn("label", F.col("doc_id")), False))
    found = settle(verified(star, texts, width, percent))
    component = connected_components(found)
    labels, _ = small_or_not(component, BROADCAST_ROWS)
    labelled = texts.join(
        labels.select(F.col("id").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left"
    ).withColumn("label", F.coalesce("label", "doc_id"))
    rest = settle(met(labelled, True).join(star, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = settle(verified(rest, texts, width, percent))
        if not more.isEmpty():
            component = extended(component, more)
    whole = classes.join(component.withColumnRenamed("id", "rep"), "rep", "left").select(
        "n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component_id")
    )
    out = sets.join(whole, ["n_shingles", "d1", "d2"], "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """docs without those that have a near duplicate with a smaller id in their component, all columns as they are.

    Rows with a null id stay, as do texts without words; rows with equal ids go or stay together. An empty table gives none.
    """
    own = near_duplicates(docs, id_col=id_col, **params)
    away = settle(own.filter("component_id <> doc_id").select("doc_id").distinct())
    return anti_join(docs, small_or_not(away, BROADCAST_ROWS)[0], id_col)
