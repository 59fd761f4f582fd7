"""Substring deduplication by fixed-block anchors.

Every document is a reference: its words are cut into non-overlapping blocks of ANCHOR words, and the
blocks' hashes are the index. Every document also probes: all its rolling windows of ANCHOR words are
looked up. A repeat of WINDOW words holds one whole block wherever it starts (WINDOW >= 2 * ANCHOR - 1), so
each repeat is hit. A hit is extended to both sides: the WINDOW-word windows over it are compared with the
earliest window of the same words; windows that follow one another make up the maximal exact repeats. Windows
count as equal if a 64-bit hash and 32 bits of another one, each over all their words, are equal; between buckets
they have also met by the rest of the second hash.

Plan. Texts are dealt to buckets of about BUCKET_BYTES by a hash. In a bucket equal windows are
settled on the spot, so what a bucket sends is one entry for each different hash, however often its
words repeat: no pair of documents is ever formed and a very common passage costs one entry a bucket.
  probe     a bucket's different ANCHOR-word hashes, with whether one is an index block, go to hash parts;
            a part answers which of them another place has too, one of them as a block
  extend    a bucket sends, for windows over hits, the earliest document with each; a part answers
            which windows some bucket has earlier
  remove    a bucket covers the words of the windows that are repeated in it or came back
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import column
from vellum.llm.hashing import deal, mix, pack, unpack, window_hashes, word_hashes

WINDOW = 20
ANCHOR = 10
BUCKET_BYTES = 12_000_000
#: Entries that a part reads, on the average.
PART_ENTRIES = 2_000_000
#: Stands for a null id: after all others.
NO_ID = 2**63 - 1


class Bucket:
    """The documents of a bucket in order of id, then text, as word hashes end to end."""

    def __init__(self, rows: pa.Table, window: int) -> None:
        ids = [NO_ID if i is None else i for i in rows.column("doc_id").to_pylist()]
        texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.nulls = [rows.column("doc_id")[k].as_py() is None for k in order]
        self.ids, self.texts = [ids[k] for k in order], [texts[k] for k in order]
        hashes = [word_hashes(t) for t in self.texts]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.window = window
        n = len(self.words)
        self.document = np.repeat(np.arange(len(ids)), self.sizes)
        #: Words from a place to the end of its document.
        self.left = self.starts[self.document + 1] - np.arange(n) if n else np.zeros(0, np.int64)

    def whole(self, width: int) -> np.ndarray:
        """Places where a run of `width` words starts, in documents that have a window."""
        return np.flatnonzero(
            (self.left >= width) & (self.sizes[self.document] >= self.window)
        ) if len(self.words) else np.zeros(0, np.int64)

    def anchors(self, width: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, parts and 32-bit keys of the rolling runs of `width` words."""
        at = self.whole(width)
        h = window_hashes(self.words, width)[at] if len(at) else np.zeros(0, np.uint64)
        return at, ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), (mix(h, 7) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def first_of_each(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The places of the first of each pair of hashes (one, two), ascending."""
    _, first, which = np.unique(one, return_index=True, return_inverse=True)
    if (two != two[first[which]]).any():  # equal in one hash only
        order = np.lexsort((np.arange(len(one)), two, one))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        first = order[new]
    return np.sort(first)


def among(one: np.ndarray, two: np.ndarray, known_one: np.ndarray, known_two: np.ndarray) -> np.ndarray:
    """Which pairs of hashes are among the known ones."""
    if not len(known_one):
        return np.zeros(len(one), bool)
    order = np.lexsort((known_two, known_one))
    known_one, known_two = known_one[order], known_two[order]
    low, high = np.searchsorted(known_one, one), np.searchsorted(known_one, one, side="right")
    found = np.zeros(len(one), bool)
    for k in range(int((high - low).max(initial=0))):  # as many as are equal in the first hash: one, hardly ever two
        own = low + k < high
        found[own] |= known_two[low[own] + k] == two[own]
    return found


def _joined(parts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return parts.astype(np.uint64) << np.uint64(32) | keys.astype(np.uint64)


def _probe(anchor: int, window: int, parts: int):
    schema = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("flags", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        b = Bucket(rows, window)
        at, part, key = b.anchors(anchor, parts)
        block = (at - b.starts[b.document[at]]) % anchor == 0
        own, first, where, count = np.unique(_joined(part, key), return_index=True, return_inverse=True, return_counts=True)
        is_block = np.zeros(len(own), bool)
        is_block[where[block]] = True
        flags = is_block.astype(np.uint8) | (count > 1).astype(np.uint8) << 1
        part, key = part[first], key[first]
        _, stretches = deal(part)  # `own` ascends by part, then key
        out = [(p, bucket, pack(key[s]), flags[s].tobytes()) for p, s in stretches]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], type=schema.types[i]) for i in range(4)], schema=schema)

    return run, "part int, bucket int, keys binary, flags binary"


def _gather(rows: pa.Table, columns: list[str]) -> pa.Table:
    return rows.select(columns).combine_chunks()


def _shared():
    """Which keys of a part are anchors of repeats: in two places at least, one of them a block."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("hits", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        buckets = rows.column("bucket").to_pylist()
        keys = [unpack(k.as_py()) for k in rows.column("keys")]
        flags = np.frombuffer(b"".join(f.as_py() for f in rows.column("flags")), np.uint8)
        sizes = [len(k) for k in keys]
        _, run_of, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        n = len(times)
        many = (times > 1) | (np.bincount(run_of, weights=flags >> 1, minlength=n) > 0)
        hit = (many & (np.bincount(run_of, weights=flags & 1, minlength=n) > 0))[run_of]
        out, start = [], 0
        for bucket, own, size in zip(buckets, keys, sizes):
            mine = own[hit[start : start + size]]
            start += size
            if len(mine):
                out.append((bucket, part, pack(mine)))
        return pa.Table.from_arrays([pa.array([o[i] for o in out], type=schema.types[i]) for i in range(3)], schema=schema)

    return run, "bucket int, part int, hits binary"


def _extend(anchor: int, window: int, parts: int, parts2: int):
    schema = pa.schema(
        [
            ("part", pa.int32()), ("bucket", pa.int32()), ("windows", pa.binary()), ("tails", pa.binary()), ("ids", pa.binary()),
            ("runs", pa.binary())
        ]
    )

    def run(rows: pa.Table, hits: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(hits):
            bucket = rows.column("bucket")[0].as_py()
            b = Bucket(rows, window)
            at, part, key = b.anchors(anchor, parts)
            wanted = np.sort(
                np.concatenate(
                    [_joined(np.array([p.as_py()]), unpack(h.as_py())) for p, h in zip(hits.column("part"), hits.column("hits"))]
                )
            )
            mine = _joined(part, key)
            place = np.searchsorted(wanted, mine)
            place[place == len(wanted)] = 0
            hit = at[wanted[place] == mine]
            # Windows that hold a hit: they start at most window - anchor words before it.
            change = np.zeros(len(b.words) + 1, np.int32)
            np.add.at(change, np.maximum(hit - (window - anchor), b.starts[b.document[hit]]), 1)
            np.add.at(change, hit + 1, -1)
            over = np.flatnonzero((np.cumsum(change[:-1]) > 0) & (b.left >= window))
            if len(over):
                first_hash, second = window_hashes(b.words, window)[over], window_hashes(b.words, window, 1)[over]
                tail = (second >> np.uint64(32)).astype(np.uint32)
                first = first_of_each(first_hash, tail)  # in order of id and place: the earliest
                docs = np.array(b.ids, np.int64)[b.document[over[first]]]
                goes = (second[first] % np.uint64(parts2)).astype(np.int64)
                order, stretches = deal(goes)
                for p, s in stretches:
                    own = docs[order[s]]
                    cut = np.flatnonzero(np.diff(own, prepend=own[0] - 1 if own[0] > -(2**63) else own[0] + 1))
                    out.append(
                        (
                            p, bucket, first_hash[first][order[s]].tobytes(), tail[first][order[s]].tobytes(), own[cut].tobytes(),
                            np.diff(cut, append=len(own)).astype(np.int32).tobytes()
                        )
                    )
        return pa.Table.from_arrays([pa.array([o[i] for o in out], type=schema.types[i]) for i in range(6)], schema=schema)

    return run, "part int, bucket int, windows binary, tails binary, ids binary, runs binary"


def _earlier():
    """Which windows of a part's buckets another bucket has earlier."""
    schema = pa.schema([("bucket", pa.int32()), ("repeated", pa.binary()), ("tails", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        buckets = rows.column("bucket").to_pylist()
        windows = [np.frombuffer(w.as_py(), np.uint64) for w in rows.column("windows")]
        ids = np.concatenate(
            [
                np.repeat(np.frombuffer(i.as_py(), np.int64), np.frombuffer(r.as_py(), np.int32)) for i,
                r in zip(rows.column("ids"), rows.column("runs"))
            ]
        )
        of = np.repeat(np.array(buckets, np.int32), [len(w) for w in windows])
        every = np.concatenate(windows)
        tails = np.frombuffer(b"".join(t.as_py() for t in rows.column("tails")), np.uint32)
        order = np.lexsort((of, ids, tails, every))
        late = np.zeros(len(every), bool)
        late[order[1:]] = (every[order[1:]] == every[order[:-1]]) & (tails[order[1:]] == tails[order[:-1]])
        out, start = [], 0
        for bucket, own in zip(buckets, windows):
            s = slice(start, start + len(own))
            start += len(own)
            if late[s].any():
                out.append((bucket, own[late[s]].tobytes(), tails[s][late[s]].tobytes()))
        return pa.Table.from_arrays([pa.array([o[i] for o in out], type=schema.types[i]) for i in range(3)], schema=schema)

    return run, "bucket int, repeated binary, tails binary"


def _remove(window: int, with_text: bool):
    fields = [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_repeats", pa.int64())
    ]
    schema = pa.schema(fields + [("text", pa.string())] * with_text)

    def run(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not len(rows):
            return schema.empty_table()
        b = Bucket(rows, window)
        at = b.whole(window)
        covered = np.zeros(len(b.words) + 1, np.int32)
        starts = np.zeros(0, np.int64)
        if len(at):
            own = window_hashes(b.words, window)[at]
            tail = (window_hashes(b.words, window, 1)[at] >> np.uint64(32)).astype(np.uint32)
            late = np.ones(len(at), bool)
            late[first_of_each(own, tail)] = False
            if len(back):
                known = [
                    np.frombuffer(b"".join(r.as_py() for r in back.column(c)), kind) for c,
                    kind in (("repeated", np.uint64), ("tails", np.uint32))
                ]
                late |= among(own, tail, *known)
            starts = at[late]
            covered[starts] += 1
            covered[starts + window] -= 1  # starts differ, and so do their ends
        gone = np.cumsum(covered[:-1]) > 0
        out = []
        # A maximal repeat: windows in a row, all of them repeated.
        heads = starts[np.diff(starts, prepend=-2) > 1] if len(starts) else starts
        crossed = np.union1d(heads, starts[np.isin(starts, b.starts)]) if len(starts) else heads
        repeats = np.bincount(b.document[crossed], minlength=len(b.ids)) if len(crossed) else np.zeros(len(b.ids), np.int64)
        for k, text in enumerate(b.texts):
            s = slice(b.starts[k], b.starts[k + 1])
            n = int(gone[s].sum())
            words = text.split()
            kept = b" ".join(compress(words, (~gone[s]).tolist()) if n else words)
            out.append(
                (
                    None if b.nulls[k] else b.ids[k], len(words), n, hashlib.sha256(kept).hexdigest(), int(repeats[k]),
                    kept.decode("utf-8", "surrogatepass")
                )[: len(schema)]
            )
        return pa.Table.from_arrays([pa.array([o[i] for o in out], type=schema.types[i]) for i in range(len(schema))], schema=schema)

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_repeats long" + ", text string" * with_text


def bucketed(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> tuple[DataFrame, int]:
    """(doc_id, text, bucket) and the number of bytes of all texts. Rows with equal ids and texts share a bucket."""
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // bucket_bytes))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n)).cast("int")), size


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
    bucket_bytes: int = BUCKET_BYTES, part_entries: int = PART_ENTRIES
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, n_repeats, and with_text the kept text.

    Removed are the words of every window of `window` words of one document whose words also stand earlier:
    in a document with a smaller id, or earlier in the same one. Null text has no words; texts shorter than a
    window lose nothing. Rows with equal ids follow one another by bucket, then text, and one with a null id comes
    after all others. An empty table gives no rows.
    """
    if window < 2 * anchor - 1:
        raise ValueError("a window must be able to hold a whole block: window >= 2 * anchor - 1")
    rows, size = bucketed(docs, id_col, text_col, bucket_bytes)
    parts = max(1, -(-size // (6 * part_entries)))
    f, schema = _probe(anchor, window, parts)
    probes = rows.groupBy("bucket").applyInArrow(f, schema)
    f, schema = _shared()
    hits = probes.groupBy("part").applyInArrow(f, schema)
    f, schema = _extend(anchor, window, parts, parts)
    over = rows.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(f, schema)
    f, schema = _earlier()
    back = over.groupBy("part").applyInArrow(f, schema)
    f, schema = _remove(window, with_text)
    return rows.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(f, schema)
