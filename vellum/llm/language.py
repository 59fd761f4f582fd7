"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed
against every automaton from its first letter to its last: each phrase is the longest stretch that the
language's text holds, plus one letter, and runs over word ends as it likes. The language that needs the
fewest phrases a letter wins.

Texts are lower-cased and reduced to words of letters (marks included) with one blank between them. The
automata become tables of next states, and the texts of a batch are parsed side by side, a letter of each
at a step. A phrase ends at PIECE letters' ends only, where a long text is cut so that it is parsed side
by side with itself; so time and memory follow the number of letters, whatever their distribution.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import column, in_batches, spread

#: Letters of training text for each language; the automata hold at most twice as many states.
SAMPLE_CHARS = 60_000
#: Documents of each language that the training text is taken from.
SAMPLE_DOCS = 400
#: More languages than this are an error: each costs an automaton in every worker.
LANGUAGES = 500
#: Letters of a text that are parsed in one go, and bytes of text that are parsed side by side.
PIECE, SLICE_BYTES = 4096, 4_000_000
#: Cells of all tables of next states together (4 bytes each); with larger alphabets sorted edges are searched.
CELLS = 20_000_000
WORDS = regex.compile(r"[\p{L}\p{M}]+")
UNDETERMINED = "und"
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_letters", pa.int64())])


class SuffixAutomaton:
    """Accepts every substring of a text; states are numbers, the first one is 0, and no edge leads there."""

    def __init__(self, text: str) -> None:
        length, link, edges = [0], [-1], [{}]
        last = 0
        for c in text:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            edges.append({})
            at = last
            while at >= 0 and c not in edges[at]:
                edges[at][c] = new
                at = link[at]
            if at >= 0:
                to = edges[at][c]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    edges.append(dict(edges[to]))
                    while at >= 0 and edges[at].get(c) == to:
                        edges[at][c] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new
        self.edges = edges

    def longest_match(self, text: str, start: int = 0) -> int:
        """Length of the longest stretch of text from start that the automaton accepts."""
        state, at = 0, start
        while at < len(text) and (to := self.edges[state].get(text[at])) is not None:
            state = to
            at += 1
        return at - start


class NextStates:
    """The edges of several automata by state and letter number; a state is counted from its automaton's first, and 0 is no edge.

    Most states have one edge, which is kept as its letter and its end; the others have rows of a table, or, where the alphabet is
    large, edges in order of row and letter. All automata are stepped at once.
    """

    def __init__(self, texts: list[str], number: dict[str, int], width: int) -> None:
        self.width, parts, keys, ends, starts, rows = width, [], [], [], [0], 0
        for text in texts:  # one automaton at a time
            edges = SuffixAutomaton(text).edges
            many = [s for s, own in enumerate(edges) if len(own) != 1]
            # For each state its edge's letter and, in the low 32 bits, its end; or -1 and the place of its row.
            only = np.zeros(len(edges), np.int64)
            for s, own in enumerate(edges):
                if len(own) == 1:
                    (c, to), = own.items()
                    only[s] = number[c] << 32 | to
            only[many] = np.arange(rows, rows + len(many)) - 2**32
            keys.append(np.array([(rows + k) * width + number[c] for k, s in enumerate(many) for c in edges[s]], np.int64))
            ends.append(np.array([t for s in many for t in edges[s].values()], np.int32))
            parts.append(only)
            starts.append(starts[-1] + len(only))
            rows += len(many)
        none = [np.zeros(0, np.int64)]
        self.only, self.starts = np.concatenate(parts + none), np.array(starts[:-1], np.int64)[:, None]
        key, end = np.concatenate(keys + none), np.concatenate(ends + [np.zeros(0, np.int32)])
        if rows * width <= CELLS:
            self.table = np.zeros(rows * width, np.int32)
            self.table[key] = end
        else:
            self.table, order = None, np.argsort(key)
            self.keys, self.ends = np.append(key[order], np.int64(2**62)), np.append(end[order], np.int32(0))

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states of (automata x texts) by a letter of each text."""
        only = self.only[self.starts + state]
        kind, low = only >> 32, only & 0xFFFFFFFF
        new = np.where(kind == letter, low, 0).ravel()
        at = np.flatnonzero(kind.ravel() < 0)
        key = low.ravel()[at] * self.width + letter[at % len(letter)]
        if self.table is not None:
            new[at] = self.table[key]
        else:
            found = np.searchsorted(self.keys, key)
            new[at] = np.where(self.keys[found] == key, self.ends[found], 0)
        return new.reshape(state.shape)


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each character its lower-case form if it is a letter or a mark, else 0 (forms of several characters count as their first), and whether it is a letter."""
    low, letter = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        if (kind := unicodedata.category(c := chr(i))[0]) in "LM":
            low[i], letter[i] = ord(c.lower()[0]), kind == "L"
    return low, letter


class Model:
    """The automata of all languages over one numbering of letters: 0 is the blank, 1 a letter that no language has."""

    def __init__(self, texts: tuple[tuple[str, str], ...]) -> None:
        self.langs = [lang for lang, _ in texts]
        known = sorted({c for _, t in texts for c in t} - {" "})
        number = {" ": 0} | {c: i + 2 for i, c in enumerate(known)}
        low, _ = _letters()
        by_form = np.ones(len(low), np.int32)
        by_form[[ord(c) for c in known]] = np.arange(2, len(known) + 2)
        self.number = np.where(low > 0, by_form[low], 0).astype(np.uint16 if len(known) < 65_000 else np.int32)
        width = len(known) + 2
        self.next = NextStates([t for _, t in texts], number, width)

    def letters(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letter numbers of all texts end to end, where each text starts and ends, its letters, without marks and blanks)."""
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
        cuts = np.cumsum([0] + [len(r) + 1 for r in raw])
        every = np.zeros(cuts[-1], self.number.dtype)  # a blank after each text
        for a, r in zip(cuts, raw):
            every[a : a + len(r)] = self.number[r]
        some = every != 0
        keep = some.copy()
        keep[1:] |= some[:-1]  # the first blank after a letter
        at = np.concatenate([np.zeros(1, np.int32), np.cumsum(keep, dtype=np.int32)])
        return every[keep], at[cuts], np.array([int(_letters()[1][r].sum()) for r in raw], np.int64)

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, letters by text)."""
        every, cuts, letters = self.letters(texts)
        pieces = -(-np.diff(cuts) // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = cuts[owner] + nth * PIECE
        size = np.minimum(cuts[owner + 1] - start, PIECE)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right").tolist() if len(size) else []
        state, n = np.zeros((len(self.langs), len(size)), np.int64), np.zeros((len(self.langs), len(size)), np.int32)
        done = np.zeros(state.shape, bool)
        for t, m in enumerate(active):
            done[:, m : state.shape[1]] = state[:, m:] > 0  # pieces that ended before this letter
            state = self.next.step(state[:, :m], every[start[:m] + t])
            n[:, :m] += state == 0
        done[:, : state.shape[1]] = state > 0
        found = np.zeros((len(texts), len(self.langs)), np.int64)
        for k in range(len(self.langs)):
            found[:, k] = np.bincount(owner, weights=n[k] + done[k], minlength=len(texts)) if len(size) else 0
        return found, letters

    def classify(self, texts: pa.Array) -> list[tuple[str, float, int]]:
        """(language, score, letters) of each text; score is 1 - phrases of the winner / phrases of the next one, ties go to the most frequent language."""
        out: list[tuple[str, float, int]] = []
        for a, b in _slices(texts):
            found, letters = self.phrases(texts[a:b].to_pylist())
            for row, n in zip(found, letters.tolist()):
                if not n or not self.langs:
                    out.append((UNDETERMINED, 0.0, n))
                    continue
                best = int(row.argmin())
                others = np.delete(row, best)
                out.append((self.langs[best], 1.0 - float(row[best]) / float(others.min()) if len(others) else 1.0, n))
        return out


def _slices(texts: pa.Array):
    """Row ranges of about SLICE_BYTES of text."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= SLICE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def training_text(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, sample_chars: int
) -> tuple[tuple[str, str], ...]:
    """(language, text) for the model, the most frequent language first: bounded by sample_docs and sample_chars, whatever the table's size.

    The sample is the documents with the smallest hashes of their id, each id once; each gives an equal share of the letters, from a
    place that its hash names. Rows without an id, a text or a language (null or blank) are not learned from.
    """
    rows = docs.select(
        column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang")
    ).filter("trim(lang) <> '' AND id IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("hash", F.xxhash64("id"))
    known = rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids")
    ).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in {lang_col}")
    if not known:
        return ()
    # Ids are drawn without their texts. A bound on the hash leaves a few times sample_docs of a language's ids, so no
    # task ranks more than that, however many there are.
    spark = docs.sparkSession
    bounds = spark.createDataFrame(
        [(r.lang, int(min(1.0, (4 * sample_docs + 100) / max(1, r.ids)) * (2**64 - 2**12)) - 2**63) for r in known],
        "lang string, most long"
    )
    few = rows.select("lang", "id", "hash").join(F.broadcast(bounds), "lang").filter("hash <= most").select("lang", "id", "hash").distinct()
    drawn = few.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    ).filter(F.col("rank") <= sample_docs)
    drawn = drawn.withColumn("share", F.ceil(F.lit(sample_chars) / F.count("*").over(Window.partitionBy("lang"))).cast("int"))
    picked = rows.join(F.broadcast(drawn.select("lang", "id", "rank", "share")), ["lang", "id"])
    # Twice the share has room for what is not a letter.
    room = F.greatest(F.length("text") - 2 * F.col("share"), F.lit(0)) + 1
    some = F.substring(F.col("text"), (F.pmod(F.xxhash64("id", F.lit(1)), room) + 1).cast("int"), 2 * F.col("share"))
    taken: dict[str, list[str]] = {}
    for r in picked.groupBy("lang", "rank", "share").agg(F.min(some).alias("some")).orderBy("lang", "rank").collect():  # at most sample_docs rows a language
        taken.setdefault(r.lang, []).append(" ".join(WORDS.findall(r.some))[: r.share])
    low, _ = _letters()
    plain = lambda text: "".join(chr(low[ord(c)]) if c != " " else c for c in text)
    return tuple((r.lang, " " + plain(" ".join(x for x in taken[r.lang] if x)) + " ") for r in known if any(taken.get(r.lang, ())))


_MODELS: dict = {}


def _model(texts: tuple) -> Model:
    """This worker's model, built once for each training text."""
    key = hash(texts)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(texts)
    return _MODELS[key]


def identify(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS
) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score, n_letters, learned from the rows of `labelled`.

    Null texts and texts without letters, and any text if nothing is labelled, are `und` with score 0.
    The whole text is parsed, rows that repeat get the same answer, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(training_text(labelled, id_col, text_col, lang_col, sample_docs, sample_chars))

    def run(batches):
        model = _model(shared.value)
        for batch in batches:
            found = model.classify(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[i] for f in found], type=OUT.types[i + 1]) for i in range(3))], schema=OUT
            )

    return spread(docs).select(
        column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")
    ).mapInArrow(run, "doc_id long, lang_pred string, score double, n_letters long")


def identified_documents(
    docs: DataFrame, labelled: DataFrame, min_score: float = 0.0, languages: tuple[str, ...] | None = None, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS
) -> DataFrame:
    """The rows of docs whose language is told, with the prediction in lang where that is null or blank; other columns as they are.

    Rejected are texts without letters, those whose best language needs no fewer phrases than the next one (score of
    min_score or less, of texts in which two languages are tried at least) and, if `languages` names any, those of other languages. Rows that
    repeat share their fate; an empty table gives no rows, and a table without labels loses all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(training_text(labelled, id_col, text_col, lang_col, sample_docs, sample_chars))
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        model = _model(shared.value)
        for batch in batches:
            found = model.classify(batch.column(text_at))
            told = [lang != UNDETERMINED and score > min_score and (languages is None or lang in languages) for lang, score, _ in found]
            labels = [old if old and old.strip() else new for old, (new, _, _) in zip(batch.column(lang_at).to_pylist(), found)]
            arrays = list(batch.columns)
            arrays[lang_at] = pa.array(labels, batch.schema.types[lang_at])
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(told, pa.bool_()))

    return in_batches(docs).mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """True for the fold that is never learned from: CRC-32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(column(id_col).cast("string")) % 4 == 2, F.lit(False))
