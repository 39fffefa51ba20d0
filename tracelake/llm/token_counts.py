"""Token counts under a unigram model, with forward scores shared along a trie of pre-tokens.

The pieces are those of a public vocabulary file; their scores follow from their ranks by Zipf's law, so
nothing is trained.  A pre-token is a mark and a word.  The distinct pre-tokens of a group of texts form a
trie (walked in sorted order, where neighbours share their prefix); each node's best score and its number
of pieces are computed once, from the nodes above it, and the counts at the ends of words are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import slices

MARK = "▁"
#: Words whose counts are kept, in each of two generations, and the longest kept.
CACHE_WORDS, CACHE_BYTES = 400_000, 48
#: What a byte of a character that no piece covers scores below the lowest piece.
BYTE_PENALTY = 10.0


def zipf_pieces(model_file: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with log-probabilities that fall with rank; no control or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1.0 / (r + 1) for r in range(len(ids))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ids)}


class TrieCounter:
    """Number of pieces on the best path of each pre-token.

    Of two paths with equal scores, the one whose last piece is shorter counts.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.floor = min(pieces.values(), default=0.0) - BYTE_PENALTY

    def counts(self, tokens: list[str]) -> dict[str, int]:
        """``tokens`` are distinct; each prefix that several share is scored once."""
        found: dict[str, int] = {}
        best, number, before = [0.0], [0], ""  # of the empty prefix, then of each longer one
        get, longest = self.pieces.get, self.longest
        for token in sorted(tokens):
            shared = 0
            for x, y in zip(before, token):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], number[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                top, n = -math.inf, 0
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    score = get(token[start:end])
                    if score is not None and best[start] + score > top:
                        top, n = best[start] + score, number[start] + 1
                if get(token[end - 1 : end]) is None:
                    size = len(token[end - 1].encode())
                    if best[end - 1] + size * self.floor > top:
                        top, n = best[end - 1] + size * self.floor, number[end - 1] + size
                best.append(top)
                number.append(n)
            found[token] = number[-1]
            before = token
        return found


class WordCounts:
    """A counter with a bounded memory of words it has met."""

    def __init__(self, pieces: dict[str, float]):
        self.counter = TrieCounter(pieces)
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def totals(self, texts: list[list[bytes]]) -> list[int]:
        looked = [list(map(self.young.get, words)) for words in texts]
        missing = {w for words, got in zip(texts, looked) if None in got for w, n in zip(words, got) if n is None}
        found = {w: n for w in missing if (n := self.old.get(w)) is not None}
        tokens = {MARK + w.decode(): w for w in missing if w not in found}
        found.update((tokens[t], n) for t, n in self.counter.counts(list(tokens)).items())
        out = [sum(got) if None not in got else sum(found[w] if n is None else n for w, n in zip(words, got)) for words, got in zip(texts, looked)]
        self.young.update((w, n) for w, n in found.items() if len(w) <= CACHE_BYTES)
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        return out


_counters: dict[str, WordCounts] = {}


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row; a null or empty text has none of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _counters:  # one a worker
            _counters[model_file] = WordCounts(zipf_pieces(model_file))
        counter = _counters[model_file]
        for batch in slices(batches, limit=2 << 20):
            words = [(t.as_py() or "").encode().split() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(counter.totals(words), pa.int64())],
                names=["doc_id", "n_pretokens", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
