"""Count-only Viterbi tokenisation with a unigram vocabulary: how many tokens each text has, without making them.

An Aho-Corasick automaton lists the vocabulary's matches inside a word; dynamic programming over its positions
carries the best score and that path's number of pieces.  Tie rules are those of the exact tokenizer: starts are
visited from left to right, pieces from short to long, and a later path replaces an earlier one only with a strictly
higher score, so the earliest start (the longest piece) keeps a tie.  A character without any one-character piece is
an unknown of the lowest score less a fixed penalty; unknown characters count as one token for each byte.

Words are the parts between spaces, each with the word mark in front; no piece crosses them, so a text's count is
the sum over its words and each distinct word of a block is counted once.  This is the count of a tokenizer that
splits at every space (Metaspace): pieces of several word marks are out of reach, and each further space of a run is a
token of its own.

Defined results: a null or empty text has 0 tokens; a null id keeps its row; repeated rows are kept, one result
each; an empty table gives an empty result; a very long text or word is counted whole, in time linear in its length;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ebbflow.llm.common import Memory, distinct_spans, text_blocks

MARK = "▁"
#: What an unknown character scores below the lowest piece. (fixed value)
UNKNOWN_PENALTY = 10.0
#: Words of a generation that a worker remembers; results do not depend on it.
REMEMBERED = 300_000
TEXT_BLOCK = 4 << 20


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]


class Counter:
    """Token counts of words under a unigram vocabulary."""

    def __init__(self, pieces: Sequence[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.memory = Memory(REMEMBERED)

    def word(self, word: str) -> int:
        """Tokens of one word, its mark included."""
        n = len(word)
        best, count, single = [-np.inf] * (n + 1), [0] * (n + 1), [False] * n
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.automaton):
            for last, (length, score) in self.automaton.iter(word):
                ends[last + 1].append((last + 1 - length, score))
                if length == 1:
                    single[last] = True
        for end in range(1, n + 1):
            top, pieces = -np.inf, 0
            for start, score in sorted(ends[end]):
                if best[start] + score > top:
                    top, pieces = best[start] + score, count[start] + 1
            if not single[end - 1] and best[end - 1] + self.unknown > top:
                top, pieces = best[end - 1] + self.unknown, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, pieces
        return count[n]

    def _fresh(self, words: list[bytes]) -> list[int]:
        return [self.word(MARK + w.decode()) for w in words]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, words) of every document of a block."""
        n, docs = int(offsets[-1]), len(offsets) - 1
        spaces = np.flatnonzero(data[:n] == 0x20)
        firsts = offsets[:-1][np.diff(offsets) > 0]
        own = firsts[data[firsts] != 0x20]  # a text that begins with a space has no word before it
        starts = np.sort(np.concatenate((own, spaces + 1)))
        doc = np.searchsorted(offsets, np.sort(np.concatenate((own, spaces))), "right") - 1
        stops = np.append(spaces, n)
        ends = np.minimum(stops[np.searchsorted(spaces, starts)], offsets[doc + 1])
        chosen, number = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        counts = np.array(self.memory.get([raw[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)], self._fresh), np.int64)
        return np.bincount(doc, counts[number] if len(number) else None, minlength=docs).astype(np.int64), np.bincount(doc, minlength=docs)


def _count(pieces: Sequence[tuple[str, float]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces)
        for batch in batches:
            size = pc.fill_null(pc.cast(pc.binary_length(batch.column("text")), pa.int64()), 0)
            # the tokenizer takes a word mark inside a text for a space
            texts = pc.replace_substring(batch.column("text"), MARK, " ")
            for first, last, data, offsets in text_blocks(texts, TEXT_BLOCK):
                tokens, words = counter.block(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(tokens), pa.array(words.astype(np.int64)), size.slice(first, last - first)], names=["doc_id", "n_tokens", "n_words", "n_bytes"])

    return count


def count_tokens(docs: DataFrame, pieces: Sequence[tuple[str, float]]) -> DataFrame:
    """doc_id, n_tokens, n_words, n_bytes of every document; the vocabulary is what travels with the tasks."""
    return docs.select("doc_id", "text").mapInArrow(_count(list(pieces)), "doc_id long, n_tokens long, n_words long, n_bytes long")
