"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

Texts are cut at Unicode white space into chunks. No pre-token of the vocabulary's pattern crosses white space,
so the ids of a chunk are the same wherever it occurs, and each Python worker keeps the ids of the chunks and
pre-tokens that it has met (bounded caches that change no result).
"""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex as TokenRegex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from recollect.llm.shared import pieces

# Fixed values of the vocabulary file: its pattern and special tokens are read from it; the byte alphabet is the
# usual one (printable Latin-1 bytes stand for themselves, the others for code points from 256 on).
_SPLIT = regex.compile(r"\s+")
#: Code points that str.split() takes as white space and the tokenizer doesn't.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Most entries of a worker's cache.
CACHE = 400_000


def byte_alphabet() -> list[str]:
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


def chunks(text: str) -> list[str]:
    """The pieces of a text between Unicode white space."""
    if any(c in text for c in ODD):
        return [x for x in _SPLIT.split(text) if x]
    return text.split()


class Codec:
    """Encoder and decoder for a vocabulary file of the tokenizers library (BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special = special
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        alphabet = byte_alphabet()
        self.inner = [vocab.get(c) for c in alphabet]
        self.last = [vocab.get(c + self.suffix) for c in alphabet]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        # The library's own normalizer and pre-tokenizer for chunks whose code points depend on a Unicode version.
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer, Split(TokenRegex(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def pre_token(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token: pop the least (rank, place); skip it if its pair is gone; merge; push the new pairs."""
        data = word.encode("utf-8")
        inner = self.inner
        sym = [s for s in [*[inner[b] for b in data[:-1]], self.last[data[-1]]] if s is not None]
        n, rank_of, made = len(sym), self.ranks.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(sym[i] << 32 | sym[i + 1])) is not None]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or sym[i] < 0 or rank_of(sym[i] << 32 | sym[j]) != top >> 32:
                continue
            new = sym[i] = made[top >> 32]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 32 | sym[k])) is not None:
                    heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(sym[h] << 32 | new)) is not None:
                heappush(queue, r << 32 | h)
        return tuple([s for s in sym if s >= 0])

    def pre_tokens(self, piece: str) -> list[str]:
        """Pre-tokens of a chunk without special tokens: NFC, lower case code point by code point, pattern."""
        if piece.isascii() or max(piece) < "\u0250":
            low = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).lower()
            if low.isalpha():
                return [low]
            if low[-1] in ".," and low[:-1].isalpha():
                return [low[:-1], low[-1]]
            return self.pattern.findall(low)
        return [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(piece))]

    def plain(self, piece: str) -> tuple[int, ...]:
        """Ids of a chunk without special tokens."""
        out: tuple[int, ...] = ()
        for word in self.pre_tokens(piece):
            ids = self.words.get(word)
            if ids is None:
                ids = self.pre_token(word)
                if len(self.words) >= CACHE:
                    self.words.clear()
                if len(word) < 64:
                    self.words[word] = ids
            out = out + ids if out else ids
        return out

    def chunk(self, piece: str) -> tuple[int, ...]:
        if self.special_at and "<" in piece and self.special_at.search(piece):
            ids = tuple(chain.from_iterable((self.special[x],) if x in self.special else self.plain(x) for x in self.special_at.split(piece) if x))
        else:
            ids = self.plain(piece)
        self.keep(piece, ids)
        return ids

    def keep(self, piece: str, ids: tuple[int, ...]) -> None:
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        if len(piece) < 64:
            self.pieces[piece] = ids

    def encode(self, text: str) -> list[int]:
        get, miss, none = self.pieces.get, self.chunk, None
        return list(chain.from_iterable([ids if (ids := get(x)) is not none else miss(x) for x in chunks(text)]))

    def decode(self, ids) -> str:
        """Vocabulary strings joined as the library does when the file names no decoder: by one space."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a file: loaded once, with its caches."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def id_arrays(lists: list) -> pa.Array:
    """Lists of ids as one Arrow list array without a Python object for each id."""
    ends = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: (id, ids array<int>, decoded string), a row for each row.

    Null and empty texts have no ids and decode to the empty string; null and repeated ids are carried as they
    are; an empty table gives an empty table; other columns are not read. Special tokens in a text get their own
    ids, as the library does. No shuffle: each task keeps only its batch and the bounded caches.
    """

    def run(batches):
        c = codec(path)
        for batch in pieces(batches, 1):
            lists = [c.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), id_arrays(lists), pa.array([c.decode(x) for x in lists], pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Count and digests of what bpe() gives."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
