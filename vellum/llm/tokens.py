"""Token counts by unigram segmentation with a trie of pre-tokens.

A pre-token is a word with the blank before it (a leading U+2581). Its segmentation is the one with the
highest sum of piece log-probabilities, and its count is that segmentation's number of pieces. The best
score of a prefix depends on the prefix alone, so the distinct pre-tokens are put in a trie and the
forward scores are computed once for each node, that is once for each shared prefix; the nodes where
pre-tokens end hold their token counts. A document's count is the sum over its pre-tokens.

The pieces and their order come from a public SentencePiece vocabulary. It holds ranks, not
probabilities; Zipf's law gives them: p(rank) is in proportion to 1 / (rank + SHIFT). A character that no
piece has falls back to its UTF-8 bytes, one piece each.
"""

from __future__ import annotations

import math
import os
import re
from array import array
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.common import column, spread

BLANK = "▁"
WORDS = re.compile(r"[^ \t\n\v\f\r]+")
SHIFT = 3.0
#: Nodes of a worker's trie at most; a full trie is dropped and grown anew, which changes no count.
NODES = 1_000_000
#: Pre-tokens longer than this are segmented on their own and not kept.
LONGEST_KEPT = 64
VOCABULARY = "piece_bpe_32k.model"
OUT = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


def vocabulary_path() -> str:
    return os.path.join(os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers"), VOCABULARY)


def unigram_scores(path: str) -> tuple[dict[str, float], float]:
    """Log-probabilities of the pieces and of a byte, from the order of pieces in a SentencePiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    total = math.log(sum(1 / (i + SHIFT) for i in range(len(pieces))))
    scores = {}
    for i, piece in enumerate(pieces):
        scores.setdefault(piece, -math.log(i + SHIFT) - total)
    return scores, -math.log(len(pieces) + SHIFT) - total


class PreTokenTrie:
    """Trie nodes are numbers; for each, the prefix's best score and the pieces of its best segmentation."""

    def __init__(self, scores: dict[str, float], byte: float) -> None:
        self.scores, self.byte = scores, byte
        self.longest = max(map(len, scores), default=1)
        #: Every end of a piece, with the piece's score if it is one; what is not here is the end of no piece, and nor is anything longer.
        self.ends: dict[str, float | None] = {piece[i:]: None for piece in scores for i in range(len(piece))} | scores
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}  # by node and letter
        self.score, self.pieces = array("d", [0.0]), array("q", [0])
        self.terminal: dict[str, int] = {}

    def _forward(self, text: str, path: list[int]) -> tuple[float, int]:
        """Best score and pieces of text, whose proper prefixes are the nodes in path (the last is text without its last letter).

        Of segmentations with equal scores the one with fewer pieces counts.
        """
        n, get = len(text), self.ends.get
        b = len(text[-1].encode("utf-8", "surrogatepass"))
        best, count = self.score[path[n - 1]] + b * self.byte, self.pieces[path[n - 1]] + b
        for size in range(1, min(n, self.longest) + 1):
            s = get(text[n - size :], 1.0)
            if s == 1.0:
                break
            if s is not None:
                at = path[n - size]
                v = self.score[at] + s
                if v > best or v == best and self.pieces[at] + 1 < count:
                    best, count = v, self.pieces[at] + 1
        return best, count

    def count(self, word: str) -> int:
        """Tokens of a pre-token; inserts it unless it is very long."""
        found = self.terminal.get(word)
        if found is not None:
            return found
        text = BLANK + word
        if len(text) > LONGEST_KEPT:
            return self._long(text)
        if len(self.score) + len(text) > NODES:
            self.clear()
        path, node = [0], 0
        for i, c in enumerate(text):
            edge = node << 21 | ord(c)
            to = self.edges.get(edge)
            if to is None:
                best, count = self._forward(text[: i + 1], path)
                to = len(self.score)
                self.score.append(best)
                self.pieces.append(count)
                self.edges[edge] = to
            node = to
            path.append(node)
        self.terminal[word] = self.pieces[node]
        return self.pieces[node]

    def _long(self, text: str) -> int:
        """The same sums over a list for one long pre-token, in memory of its length."""
        score, pieces, get = [0.0], [0], self.ends.get
        for n in range(1, len(text) + 1):
            b = len(text[n - 1].encode("utf-8", "surrogatepass"))
            best, count = score[n - 1] + b * self.byte, pieces[n - 1] + b
            for size in range(1, min(n, self.longest) + 1):
                s = get(text[n - size : n], 1.0)
                if s == 1.0:
                    break
                if s is not None:
                    v = score[n - size] + s
                    if v > best or v == best and pieces[n - size] + 1 < count:
                        best, count = v, pieces[n - size] + 1
            score.append(best)
            pieces.append(count)
        return pieces[-1]


_TRIES: dict[str, PreTokenTrie] = {}


def _trie(path: str) -> PreTokenTrie:
    if path not in _TRIES:
        _TRIES[path] = PreTokenTrie(*unigram_scores(path))
    return _TRIES[path]


def count_text(text: str | None, trie: PreTokenTrie) -> tuple[int, int]:
    words = Counter(WORDS.findall(text)) if text else {}
    return sum(words.values()), sum(trie.count(w) * k for w, k in words.items())


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_pretokens, n_tokens over the whole text.

    Null, empty and white texts have none of either; rows that repeat are counted each; an empty table
    gives no rows. path: a SentencePiece vocabulary, which every executor must be able to read.
    """
    path = path or vocabulary_path()

    def run(batches):
        trie = _trie(path)
        for batch in batches:
            found = [count_text(t.as_py(), trie) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], schema=OUT
            )

    return spread(docs).select(
        column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")
    ).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
