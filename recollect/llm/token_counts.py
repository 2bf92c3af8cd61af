"""Token counts by a unigram model: forward scores computed once for each shared prefix of a trie.

The vocabulary is a public sentencepiece file; its pieces get unigram scores by Zipf's law from their order in
the file (no tokenizer is trained). Scores are whole micro-nats, so sums and ties are exact.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.shared import pieces

#: Stands before each pre-token, as in the vocabulary file.
MARK = "▁"
#: Most nodes of a worker's trie; beyond it the trie begins anew (the counts stay the same).
NODES = 1_500_000
#: Most stored terminal counts, likewise.
TERMINALS = 400_000
#: Characters from which a word is scored without nodes, as no other word will share it.
LONG = 64


def unigram_scores(path: str) -> tuple[dict[str, int], int]:
    """Scores of the pieces, and the score of one fallback byte (below every piece)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    ids = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / r for r in range(1, len(ids) + 1)))
    scores = {model.id_to_piece(i): -round(1e6 * (math.log(r) + total)) for r, i in enumerate(ids, 1)}
    return scores, min(scores.values()) - 10_000_000


class Trie:
    """Distinct pre-tokens by shared prefix. A node keeps (best score, fewest tokens with it) of its prefix."""

    def __init__(self, scores: dict[str, int], byte_score: int):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores), default=1)
        self.counts: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best: list[tuple[int, int]] = [(0, 0)]

    def insert(self, word: str) -> int:
        """Tokens of a pre-token; forward scores are computed only for prefixes that no earlier word had."""
        if len(self.best) > NODES:
            self.clear()
        child, best = self.child, self.best
        text, path, node = MARK + word, [0], 0
        for d, c in enumerate(text, 1):
            key = node << 21 | ord(c)
            node = child.get(key)
            if node is None:
                top = self.step(text, d, lambda k: best[path[k]])
                node = child[key] = len(best)
                best.append(top)
            path.append(node)
        return best[node][1]

    def step(self, text: str, d: int, best) -> tuple[int, int]:
        """The forward score of the first d characters of a text; best gives that of a shorter prefix."""
        score, count = best(d - 1)
        width = len(text[d - 1].encode("utf-8", "surrogatepass"))
        top = (score + width * self.byte_score, -(count + width))
        for start in range(max(0, d - self.longest), d):
            if (s := self.scores.get(text[start:d])) is not None:
                score, count = best(start)
                top = max(top, (score + s, -(count + 1)))
        return top[0], -top[1]

    def long(self, word: str) -> int:
        """Tokens of a long word: only the scores of the last prefixes are kept, in a ring."""
        text, size = MARK + word, self.longest + 1
        ring = [(0, 0)] * size
        for d in range(1, len(text) + 1):
            ring[d % size] = self.step(text, d, lambda k: ring[k % size])
        return ring[len(text) % size][1]

    def count(self, word: str) -> int:
        """The stored terminal count, or insert."""
        n = self.counts.get(word)
        if n is None:
            if len(word) >= LONG:
                return self.long(word)
            n = self.insert(word)
            if len(self.counts) >= TERMINALS:
                self.counts.clear()
            self.counts[word] = n
        return n


_TRIES: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    if path not in _TRIES:
        _TRIES[path] = Trie(*unigram_scores(path))
    return _TRIES[path]


def pre_tokens(text: str) -> list[str]:
    """Runs of anything but ASCII white space (which is what bytes are split at)."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under the unigram model: (id, n_pretokens, n_tokens, n_chars), a row for each row.

    Null and empty texts count 0; ties between segmentations go to fewer tokens; null and repeated ids stay as
    they are; an empty table gives an empty table; other columns are not read. No shuffle: each Python worker
    has a trie of bounded size over the pre-tokens of its own documents.
    """

    def run(batches):
        t = trie(path)
        for batch in pieces(batches, 1):
            words, tokens, chars = [], [], []
            get, miss = t.counts.get, t.count
            for text in batch.column(1).to_pylist():
                found = pre_tokens(text) if text else []
                words.append(len(found))
                tokens.append(sum([n if (n := get(w)) is not None else miss(w) for w in found]))
                chars.append(len(text) if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(chars, pa.int64())], ["id", "n_pretokens", "n_tokens", "n_chars"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_pretokens long, n_tokens long, n_chars long").withColumnRenamed("id", id_col)
