"""Token counts under a unigram vocabulary, by dynamic programming over a trie of the pre-tokens.

The vocabulary gives every piece a log-probability; a pre-token (a word with the vocabulary's word mark in front) is cut
into the pieces with the largest sum. The distinct pre-tokens of a slice of texts are inserted into a trie, and the
forward scores are computed once for each of its nodes, so that a prefix shared by many pre-tokens is scored once; the
count at a pre-token's last node is stored. At each node only those pieces are followed that still match, by walking the
vocabulary's own trie along. Characters that no piece covers count one token for each UTF-8 byte.

A public vocabulary file (SentencePiece) gives the pieces and their order; no tokenizer is trained. The file's scores
are merge ranks, not probabilities; a piece's log-probability is Zipf's, -ln(rank + 1), by that order.

Memory is bounded: stored counts are let go of beyond ``MOST_STORED``, slices hold ``WORDS_AT_ONCE`` words or one text,
and pre-tokens longer than ``LONGEST`` are scored along themselves without a trie.

Defined results: null and empty texts have no tokens; repeated rows and null ids are rows like any others; an empty
table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from math import inf, log

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.shared import text_column

MARK = "▁"
LONGEST = 256
MOST_STORED = 500_000
WORDS_AT_ONCE = 200_000
END = ""


@cache
def zipf_scores(path: str) -> dict[str, float]:
    """Log-probabilities of the pieces of a SentencePiece file; bytes, control and unknown pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    order = sorted(ids, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -log(rank + 1) for rank, i in enumerate(order, 1)}


class Vocabulary:
    def __init__(self, scores: dict[str, float]):
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[END] = score
        self.byte = min(scores.values(), default=0.0) - 10.0

    def step(self, c: str, at: int, state: tuple, before: list[tuple]) -> tuple:
        """The state after one more character: (score, tokens, open matches), from the states of all shorter prefixes.

        An open match is (where it starts, the vocabulary node reached). Of equal scores the one with fewer tokens wins.
        """
        size = len(c.encode("utf-8", "surrogatepass"))
        best, tokens = state[0] + size * self.byte, state[1] + size
        matches = []
        for start, node in (*state[2], (at, self.root)):
            node = node.get(c)
            if node is not None:
                matches.append((start, node))
                score = node.get(END)
                if score is not None:
                    first = before[start]
                    score += first[0]
                    if score > best or score == best and first[1] + 1 < tokens:
                        best, tokens = score, first[1] + 1
        return best, tokens, matches

    def count_all(self, pretokens: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct pre-token."""
        trie: dict = {}
        counts: dict[str, int] = {}
        for token in pretokens:
            if len(token) > LONGEST:
                counts[token] = self.count_one(token)
                continue
            node = trie
            for c in token:
                node = node.setdefault(c, {})
            node[END] = token
        states: list[tuple] = [(0.0, 0, ())]
        todo = [iter(trie.items())]
        while todo:
            for c, node in todo[-1]:
                if c == END:
                    counts[node] = states[-1][1]
                    continue
                states.append(self.step(c, len(states) - 1, states[-1], states))
                todo.append(iter(node.items()))
                break
            else:
                todo.pop()
                states.pop()
        return counts

    def count_one(self, token: str) -> int:
        states: list[tuple] = [(0.0, 0, ())]
        for at, c in enumerate(token):
            states.append(self.step(c, at, states[-1], states))
            states[-2] = (*states[-2][:2], ())
        return states[-1][1]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(zipf_scores(path))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        stored: dict[bytes, int] = {}
        for batch in batches:
            n_words: list[int] = []
            n_tokens: list[int] = []
            held: list[list[bytes]] = []

            def settle() -> None:
                nonlocal stored
                new = {w for words in held for w in words if w not in stored}
                if len(stored) + len(new) > MOST_STORED:
                    stored = {}
                    new = {w for words in held for w in words}
                names = {MARK + w.decode("utf-8", "surrogatepass"): w for w in new}
                for name, n in known.count_all(names).items():
                    stored[names[name]] = n
                for words in held:
                    n_words.append(len(words))
                    n_tokens.append(sum(map(stored.__getitem__, words)))
                held.clear()

            size = 0
            for text in batch.column(0):
                held.append((text.as_py() or "").encode("utf-8", "surrogatepass").split())
                size += len(held[-1])
                if size > WORDS_AT_ONCE:
                    settle()
                    size = 0
            settle()
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["row", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, *, path: str, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default), n_words and n_tokens. ``path`` names the vocabulary on every executor."""
    made = ["n_words", "n_tokens"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = docs.select(text_column(docs, text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("n_words long, n_tokens long")])
    return rows.mapInArrow(_count(path), schema).select(*[F.col("row").getField(c).alias(c) for c in kept], *made)


def best_cut(token: str, scores: dict[str, float], byte: float) -> int:
    """Tokens of one pre-token by trying every last piece at every place: what the trie is tested against."""
    best = [(0.0, 0)] + [(-inf, 0)] * len(token)
    for j in range(1, len(token) + 1):
        size = len(token[j - 1].encode("utf-8", "surrogatepass"))
        ways = [(best[j - 1][0] + size * byte, best[j - 1][1] + size)]
        ways += [(scores[token[i:j]] + best[i][0], best[i][1] + 1) for i in range(j) if token[i:j] in scores]
        top = max(w[0] for w in ways)
        best[j] = (top, min(w[1] for w in ways if w[0] == top))
    return best[-1][1]
