"""Token counts under a unigram vocabulary by dynamic programming over a trie.

The distinct pre-tokens of a batch go into a trie, level by level; the best segmentation score
of a prefix depends on the prefix alone, so it is computed once per trie node, for all
pre-tokens that share it, and a pre-token's count of pieces is stored at its terminal node.  Of a
pre-token of more than LEVELS characters the beginning lies in the trie and the rest is scored on
its own, from the scores at the beginning's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MAX_CACHED = 400_000
#: Characters of a pre-token that lie in the trie, and those of all words of one trie.
LEVELS, TRIE_CHARS = 256, 1 << 20


def unigram_vocabulary(model_path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with log probabilities by Zipf's law of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
    total = float(np.log(np.sum(1.0 / (np.arange(len(ids)) + 10.0))))
    return {sp.id_to_piece(i): float(-np.log(r + 10.0) - total) for r, i in enumerate(ids)}


class TrieCounter:
    """Counts tokens of pre-tokens; ties in score go to fewer pieces.  A character outside the vocabulary is a
    token of its own, scored ``unknown`` (10 below the least piece)."""

    def __init__(self, vocabulary: dict[str, float]):
        self.vocabulary = vocabulary
        # Vocabulary as a trie of reversed pieces: sorted (state, character) pairs to states.
        children: dict[tuple[int, str], int] = {}
        score = [-np.inf]
        for piece, value in vocabulary.items():
            state = 0
            for c in reversed(piece):
                key = (state, c)
                if key not in children:
                    children[key] = len(score)
                    score.append(-np.inf)
                state = children[key]
            score[state] = max(score[state], value)
        keys = np.array([(s << 21) | ord(c) for s, c in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.states = keys[order], np.array(list(children.values()), np.int64)[order]
        self.score, self.longest = np.array(score), max(map(len, vocabulary), default=0)
        self.unknown = min(vocabulary.values(), default=0.0) - 10.0
        self.known: dict[str, int] = {}

    def _step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        want = (states << 21) | chars
        at = np.minimum(np.searchsorted(self.keys, want), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == want, self.states[at], -1) if len(self.keys) else np.full(len(want), -1)

    def _count_trie(self, words: list[str]) -> np.ndarray:
        """Token counts of distinct non-empty words, one level of their trie after another."""
        codes = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) for w in words]
        codes = [c[:LEVELS] for c in codes]
        lengths = np.array([len(c) for c in codes])
        order = np.argsort(lengths, kind="stable")
        flat = np.concatenate([codes[i] for i in order])
        offset = np.concatenate(([0], np.cumsum(lengths[order])))[:-1]
        size, out = lengths[order], np.zeros(len(words), np.int64)
        parents, chars, best, pieces = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        node, first = np.zeros(len(words), np.int64), 0
        for depth in range(1, int(size[-1]) + 1):
            first = int(np.searchsorted(size, depth))  # words long enough
            key, inverse = np.unique((node[first:] << 21) | flat[offset[first:] + depth - 1], return_inverse=True)
            node[first:] = inverse
            up, ch = key >> 21, key & ((1 << 21) - 1)
            parents.append(up)
            chars.append(ch)
            # One unknown character after the parent, or a piece that ends here.
            top, count = best[depth - 1][up] + self.unknown, pieces[depth - 1][up] + 1
            at, here, state, level = np.arange(len(key)), np.arange(len(key)), np.zeros(len(key), np.int64), depth
            while len(at) and level > 0 and depth - level < self.longest:
                state = self._step(state, chars[level][here])
                here = parents[level][here]
                level -= 1
                live = state >= 0
                at, here, state = at[live], here[live], state[live]
                value, n = best[level][here] + self.score[state], pieces[level][here] + 1
                better = (value > top[at]) | ((value == top[at]) & (n < count[at]))
                top[at[better]], count[at[better]] = value[better], n[better]
            best.append(top)
            pieces.append(count)
            ends = size == depth
            out[order[ends]] = count[node[ends]]
        for i in np.flatnonzero(size == LEVELS).tolist():
            word = words[order[i]]
            if len(word) > LEVELS:
                at, scores, counts = int(node[i]), [], []
                for depth in range(LEVELS, max(0, LEVELS - self.longest) - 1, -1):
                    scores.append(float(best[depth][at]))
                    counts.append(int(pieces[depth][at]))
                    at = int(parents[depth][at])
                out[order[i]] = self._count_rest(word, scores[::-1], counts[::-1])
        return out

    def _count_rest(self, word: str, scores: list[float], counts: list[int]) -> int:
        """Pieces of a word whose last known prefixes (up to LEVELS) have these scores and counts."""
        get, longest = self.vocabulary.get, self.longest
        for end in range(LEVELS + 1, len(word) + 1):
            top, count = scores[-1] + self.unknown, counts[-1] + 1
            for n in range(1, min(longest, len(scores)) + 1):
                piece = get(word[end - n : end])
                if piece is not None:
                    value, pieces = scores[-n] + piece, counts[-n] + 1
                    if value > top or (value == top and pieces < count):
                        top, count = value, pieces
            scores.append(top)
            counts.append(count)
            if len(scores) > 4096:
                del scores[: -longest - 1], counts[: -longest - 1]
        return counts[-1]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; each white-space separated word is a pre-token behind MARK."""
        words = [(t or "").split() for t in texts]
        new = sorted(set().union(*words).difference(self.known)) if words else []
        at = 0
        while at < len(new):
            end, chars = at, 0
            while end < len(new) and (end == at or chars + min(len(new[end]), LEVELS) <= TRIE_CHARS):
                chars += min(len(new[end]), LEVELS) + 1
                end += 1
            part = new[at:end]
            self.known.update(zip(part, self._count_trie([MARK + w for w in part]).tolist()))
            at = end
        get = self.known.__getitem__
        out = [sum(map(get, w)) for w in words]
        for w in new:
            if len(w) > LEVELS:
                del self.known[w]
        if len(self.known) > MAX_CACHED:
            for w in list(self.known)[MAX_CACHED // 2 :]:
                del self.known[w]
        return out


def token_counts(docs: DataFrame, vocabulary: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every whole text under the unigram vocabulary.

    A null, empty or blank text has no tokens.  Null ids and repeated rows are counted like any
    row; an empty table gives no rows; other columns are ignored.  No exchange: each task counts
    its own rows, with tries of at most TRIE_CHARS nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                n = counter.count(batch.column(1).slice(a, 1024).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1024), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
