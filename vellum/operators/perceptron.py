"""A tagger that is fitted: an averaged perceptron over sentences, decoded by Viterbi.

A token's features are hashed: its form, lower case, shape, beginning and end, the word lists it is on, and the lower case and shape of its neighbours; labels are
outside, begin and inside of each kind of entity, and no entity begins inside. Fitting mixes parameters: in every round each shard of the sentences goes on from the
common weights by itself, and the weights that the shards reach are averaged over them, by their number of steps. The model that comes out is the average over all
steps of all rounds but the first, whose weights still swing. When texts are tagged, what a word's features are worth is summed once and kept, and all sentences of a batch
are decoded side by side, label by label.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.operators import tag
from vellum.plans.durable import settle

BUCKETS = 1 << 16
#: Tokens of a sentence at most, beyond which it is cut; sentences of a step.
LONGEST = 64
STEP = 4
#: Texts that are tagged side by side.
TOGETHER = 200
#: Documents that are learned from at most, by a hash of their id; shards; rounds.
TRAIN_DOCS = 1_000
SHARDS = 4
ROUNDS = 4

#: Words of which a tagger keeps at most what their features are worth.
KNOWN = 100_000

_TOKEN = re.compile(r"(\w+(?:['’]\w+)*|[^\w\s]|\n)")
_LISTS = {
    "given": frozenset(x.lower() for x in L.FIRST_NAMES), "surname": frozenset(L.SURNAMES), "place": frozenset({*L.PLACE_NAMES, *L.COUNTIES, *L.PLACE_SPELLINGS}),
    "title": frozenset(L.PERSON_TITLES), "cue": frozenset(L.PLACE_CUES),
}
OWN, SIDE = 7 + len(_LISTS), 2
#: In place of a word before the first one and behind the last one of a sentence; what ends a sentence, a newline being no token.
START, END = "\x02", "\x03"
STOPS = ".!?\n"


def shape(word: str) -> str:
    """Upper, lower, digit or other of each character, runs made one."""
    if word.isascii() and word.isalpha() and word[1:].islower():  # most words
        return ("a" if word[0].islower() else "A") + "a" if len(word) == 2 else "aa" if word[0].islower() else "Aaa"
    kinds = ("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in word[:40])
    return re.sub(r"(.)\1+", r"\1\1", "".join(kinds))


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


_bucket = lru_cache(50_000)(bucket)
#: Beginnings of the names of a word's own features, from which its hash goes on.
_W, _L, _BEFORE, _BEHIND = (zlib.crc32(x) for x in (b"w", b"l", b"<l", b">l"))


def features(word: str) -> tuple[list[int], list[int], list[int]]:
    """Buckets of a word's features as the token itself, as the one before and as the one behind."""
    low, form, at = word.lower(), shape(word), _bucket
    as_is = word.encode("utf-8", "surrogatepass")
    small = as_is if low == word else low.encode("utf-8", "surrogatepass")
    own = [
        at("b"), zlib.crc32(as_is, _W) % BUCKETS, zlib.crc32(small, _L) % BUCKETS, at(f"s{form}"), at(f"p{low[:3]}"), at(f"e{low[-3:]}"), at(f"c{word[:1].isupper()}{len(word) > 1}"),
        *[at(f"{k}{low in names}") for k, names in _LISTS.items()]
    ]
    return own, [zlib.crc32(small, _BEFORE) % BUCKETS, at(f"<s{form}")], [zlib.crc32(small, _BEHIND) % BUCKETS, at(f">s{form}")]


word_features = lru_cache(30_000)(features)


class Vocabulary(dict):
    """Numbers of words, given as they come; the ends of sentences have the first ones."""

    def __init__(self):
        super().__init__((w, i) for i, w in enumerate((START, END, *STOPS)))
        self.words = list(self)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


@dataclass
class Sentences:
    """Tokens of a batch of texts, sentence after sentence."""

    words: np.ndarray  # number of the word among `vocabulary`
    before: np.ndarray
    behind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # number of the token's text
    first: np.ndarray  # first token of each sentence, and the number of tokens
    own: np.ndarray  # features of the vocabulary
    left: np.ndarray
    right: np.ndarray

    def part(self, a: int, b: int) -> "Sentences":
        """Sentences a to b."""
        s = slice(self.first[a], self.first[b])
        return Sentences(self.words[s], self.before[s], self.behind[s], self.start[s], self.end[s], self.text[s], self.first[a : b + 1] - self.first[a], self.own, self.left, self.right)


def cut(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """(words, before, behind, start, end, text, first) of Sentences, by the vocabulary's numbers."""
    pieces = _TOKEN.split("\n".join(texts))  # a newline ends a sentence, so texts stay apart
    words = np.fromiter(map(vocabulary.__getitem__, pieces[1::2]), np.int64, len(pieces) // 2)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    end = np.cumsum(sizes)[1::2]
    start = end - sizes[1::2]
    kept = words != vocabulary["\n"]
    stops = np.cumsum(kept)[(words >= vocabulary[STOPS[0]]) & (words <= vocabulary[STOPS[-1]])]
    words, start, end = words[kept], start[kept], end[kept]
    edges = np.unique(np.concatenate([[0], stops, [len(words)]]))
    parts = -(-np.diff(edges) // LONGEST)  # longer sentences are cut
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.append(np.repeat(edges[:-1], parts) + nth * LONGEST, len(words)) if len(words) else edges
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    text = np.searchsorted(begins, start, "right") - 1
    before, behind = np.zeros_like(words), np.ones_like(words)
    if len(words):
        before[1:], behind[:-1] = words[:-1], words[1:]
        before[first[:-1]], behind[first[1:] - 1] = 0, 1
    return words, before, behind, start - begins[text], end - begins[text], text, first


def sentences(texts: list[str]) -> Sentences:
    vocabulary = Vocabulary()
    found = cut(texts, vocabulary)
    return Sentences(*found, *(np.array(f, np.int64) for f in zip(*map(word_features, vocabulary.words))))


def label_names(kinds: tuple[str, ...]) -> list[str]:
    return ["O", *[f"{p}-{k}" for k in kinds for p in "BI"]]


def forbidden(kinds: tuple[str, ...]) -> np.ndarray:
    """(labels + 1) x labels: whether the second may not follow the first; the last row is for the beginning of a sentence."""
    n = 2 * len(kinds) + 1
    out = np.zeros((n + 1, n), bool)
    for j in range(2, n, 2):
        out[:, j] = True
        out[[j - 1, j], j] = False
    return out


def viterbi(emission: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of each token. move: (labels + 1) x labels, the last row from the beginning; sentences are decoded side by side."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = first[:-1][order], sizes[order]
    n = emission.shape[1]
    out = np.zeros(len(emission), np.int64)
    if not len(sizes):
        return out
    # The t-th tokens of all sentences side by side, a label's scores in a row.
    many = np.searchsorted(-sizes, -np.arange(int(sizes[0])))  # sentences longer than t
    place = np.concatenate([starts[:m] + t for t, m in enumerate(many)])
    at = np.cumsum(many) - many
    e = np.ascontiguousarray(emission[place].T)
    score = e[:, : many[0]] + move[n][:, None]
    back = np.zeros((n, len(emission)), np.int8)
    for t in range(1, len(many)):
        m, a = many[t], at[t]
        each, by = score[:, None, :m] + move[:n, :, None], back[:, a : a + m]
        best = each.max(0)
        if m < 64:
            by[:] = each.argmax(0)
        else:  # the same, a label at a time: the first of the best
            for i in range(n - 1, -1, -1):
                np.copyto(by, i, where=each[i] == best, casting="unsafe")
        score[:, :m] = best + e[:, a : a + m]
    label = score.argmax(0)
    for t in range(len(many) - 1, -1, -1):
        m, a = many[t], at[t]
        out[place[a : a + m]] = label[:m]
        if t:
            label[:m] = back[label[:m], np.arange(a, a + m)]
    return out


class Model:
    def __init__(self, kinds: tuple[str, ...], weights: np.ndarray | None = None, move: np.ndarray | None = None):
        self.kinds, self.labels = kinds, label_names(kinds)
        n = len(self.labels)
        self.weights = np.zeros((BUCKETS, n), np.float32) if weights is None else weights
        self.move = np.zeros((n + 1, n), np.float32) if move is None else move
        self.barred = np.where(forbidden(kinds), np.float32(-1e9), np.float32(0))
        self.known, self.worth = Vocabulary(), np.zeros((3, 0, n), np.float32)

    def read(self, texts: list[str]) -> tuple[Sentences, np.ndarray]:
        """Sentences without features, and emission() of them: what the words met are worth, as the token itself, as the one before and as the one behind, is kept."""
        if len(self.known) > KNOWN:
            self.known, self.worth = Vocabulary(), self.worth[:, :0]
        s = Sentences(*cut(texts, self.known), *[np.zeros((0, 0), np.int64)] * 3)
        done, n = self.worth.shape[1], len(self.known.words)
        if done < n:
            new = [self.weights[np.array(f, np.int64)].sum(1) for f in zip(*map(features, self.known.words[done:]))]
            self.worth = np.concatenate([self.worth, np.stack(new)], 1)
        return s, self.worth[0][s.words] + self.worth[1][s.before] + self.worth[2][s.behind]

    def emission(self, s: Sentences) -> np.ndarray:
        own, left, right = (self.weights[f].sum(1) for f in (s.own, s.left, s.right))
        return own[s.words] + left[s.before] + right[s.behind]

    def learn(self, s: Sentences, gold: np.ndarray) -> None:
        """One step over all sentences of s."""
        used = np.unique(np.concatenate([s.words, s.before, s.behind]))  # a step looks at few words of the batch
        at = np.zeros(len(s.own), np.int64)
        at[used] = np.arange(len(used))
        s = Sentences(at[s.words], at[s.before], at[s.behind], s.start, s.end, s.text, s.first, s.own[used], s.left[used], s.right[used])
        found = viterbi(self.emission(s), self.move + self.barred, s.first)
        wrong = np.flatnonzero(found != gold)
        for f, w in ((s.own, s.words), (s.left, s.before), (s.right, s.behind)):
            rows = f[w[wrong]]
            np.add.at(self.weights, (rows, gold[wrong][:, None]), 1)
            np.add.at(self.weights, (rows, found[wrong][:, None]), -1)
        n = len(self.labels)
        for labels, by in ((gold, 1), (found, -1)):
            previous = np.empty_like(labels)
            previous[1:], previous[s.first[:-1]] = labels[:-1], n
            np.add.at(self.move, (previous, labels), by)

    def tag(self, texts: list[str]) -> list[list[tuple]]:
        """The entities of each text: (text, label, score, start, end). score is the mean over its tokens of the label's share among all labels, by the
        exponents of their weights between the labels that the neighbours have."""
        out: list[list[tuple]] = [[] for _ in texts]
        for at in range(0, len(texts), TOGETHER):
            s, e = self.read(texts[at : at + TOGETHER])
            found = viterbi(e, self.move + self.barred, s.first)
            inside = np.flatnonzero(found)
            if not len(inside):
                continue
            n, move = len(self.labels), self.move + self.barred
            before, behind = np.full(len(found), n), np.full(len(found), -1)
            before[1:], behind[:-1] = found[:-1], found[1:]
            before[s.first[:-1]], behind[s.first[1:] - 1] = n, -1
            after = np.where((behind >= 0)[inside, None], move[:n].T[behind[inside]], 0)
            local = e[inside] + move[before[inside]] + after
            sure = np.exp(local - local.max(1, keepdims=True))
            sure = sure[np.arange(len(inside)), found[inside]] / sure.sum(1)
            begins = np.flatnonzero(found[inside] % 2 == 1)
            for a, b in zip(begins, np.append(begins[1:], len(inside))):
                i, j = inside[a], inside[b - 1]
                k, x, y = at + int(s.text[i]), int(s.start[i]), int(s.end[j])
                out[k].append((texts[k][x:y], self.kinds[(found[i] - 1) // 2], float(sure[a:b].mean()), x, y))
        return out


def gold_labels(s: Sentences, spans: list[list[tuple]], kinds: tuple[str, ...]) -> np.ndarray:
    """Label numbers of tokens; spans of a text: (start, end, label). A token belongs to the first span that it shares a character with."""
    out, last = np.zeros(len(s.words), np.int64), -1
    edges = np.searchsorted(s.text, np.arange(len(spans) + 1))
    begins = set(s.first.tolist())
    for n, own in enumerate(spans):
        a, b = edges[n], edges[n + 1]
        for x, y, kind in sorted(own):
            if kind not in kinds or x >= y:
                continue
            i, j = a + np.searchsorted(s.end[a:b], x, "right"), a + np.searchsorted(s.start[a:b], y)
            i = max(i, last + 1 if last >= a else i)
            k = 2 * kinds.index(kind) + 1
            for t in range(i, j):
                out[t] = k if t == i or t in begins else k + 1
                last = t
    return out


def fit(
    docs: DataFrame, spans: DataFrame, kinds: tuple[str, ...] = ("PER", "LOC"), rounds: int = ROUNDS, shards: int = SHARDS, most: int = TRAIN_DOCS,
    id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """A model from docs and their gold spans(doc_id, start, end, label). It learns from `most` documents at most, those of the least hashes of the id.

    Documents with a null id or text teach nothing, nor do spans with a null or of another label. The driver holds the model's weights alone.
    """
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    chosen = texts.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(most)
    gold = spans.filter("start IS NOT NULL AND end IS NOT NULL AND label IS NOT NULL").select(F.col("doc_id").alias("_id"), F.struct("start", "end", "label").alias("_s"))
    gold = gold.join(chosen.select("_id"), "_id", "left_semi").groupBy("_id").agg(F.array_sort(F.collect_list("_s")).alias("_gold"))
    rows = chosen.join(gold, "_id", "left").withColumn("_shard", F.pmod("_h", F.lit(shards)).cast("int"))
    rows = settle(rows.select("_shard", "_h", "_text", F.coalesce("_gold", F.array().cast("array<struct<start:int,end:int,label:string>>")).alias("_gold")))
    n = 2 * len(kinds) + 1
    size = BUCKETS * n
    weights, move = np.zeros((BUCKETS, n)), np.zeros((n + 1, n))
    total, steps = np.zeros(size + move.size), 0
    for turn in range(rounds):
        found = rows.groupBy("_shard").applyInArrow(_round(kinds, weights.astype(np.float32), move.astype(np.float32), turn), "at int, weight double, total double, steps long")
        own = found.groupBy("at").agg(F.sum("weight"), F.sum("total"), F.sum("steps")).collect()  # a row a weight, BUCKETS * labels at most
        done = sum(r[3] for r in own if r[0] == -1)
        if not done:
            break
        flat = np.zeros(size + move.size)
        for at, w, t, _ in own:
            if at >= 0:
                flat[at] = w / done
                total[at] += t * (turn > 0 or rounds == 1)
        steps += done * (turn > 0 or rounds == 1)
        weights, move = flat[:size].reshape(BUCKETS, n), flat[size:].reshape(n + 1, n)
    mean = total / max(1, steps)
    return Model(kinds, mean[:size].reshape(BUCKETS, n).astype(np.float32), mean[size:].reshape(n + 1, n).astype(np.float32))


def _round(kinds: tuple[str, ...], weights: np.ndarray, move: np.ndarray, turn: int):
    """A shard's steps from common weights: (place of a weight, the weight reached times the steps, its sum over the steps), and at -1 the steps."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_h")
        s = sentences(table.column("_text").to_pylist())
        gold = gold_labels(s, [[(g["start"], g["end"], g["label"]) for g in row] for row in table.column("_gold").to_pylist()], kinds)
        model = Model(kinds, weights.copy(), move.copy())
        total, moves, steps = np.zeros(weights.shape), np.zeros(move.shape), 0
        n = len(s.first) - 1
        for k in np.random.default_rng(turn).permutation(-(-n // STEP)):
            a, b = int(k) * STEP, min(n, (int(k) + 1) * STEP)
            model.learn(s.part(a, b), gold[s.first[a] : s.first[b]])
            total += model.weights
            moves += model.move
            steps += 1
        w = np.concatenate([model.weights.ravel(), model.move.ravel()]) * float(steps)
        t = np.concatenate([total.ravel(), moves.ravel()])
        at = np.flatnonzero((w != 0) | (t != 0))
        zero = np.zeros(len(at), np.int64)
        return pa.table(
            {
                "at": pa.array(np.append(at, -1), pa.int32()), "weight": np.append(w[at], 0.0), "total": np.append(t[at], 0.0),
                "steps": pa.array(np.append(zero, steps), pa.int64())
            }
        )

    return run


def register(name: str, model: Model) -> None:
    """Make a fitted model a tagger of that name, for tag.analyze() and the like."""
    tag.register_model(name, lambda: model.tag)
