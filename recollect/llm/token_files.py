"""Token-ID files: each document's ids as its own zstandard frame under one shared dictionary.

A file is a Parquet folder of blocks, written in ascending id order by Spark's committer (so a lost executor's
part is written again, never twice). A block holds whole documents: their ids, token counts and byte offsets
(the index) and the frames one after another (the payload), with the sha256 of the dictionary that they need. The
dictionary is a table of its own beside the blocks.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.normalizers import Sequence
from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit
from tokenizers.pre_tokenizers import Sequence as PreTokenizers

from recollect.llm.bpe import chunks
from recollect.llm.shared import pieces

#: The dictionary is fitted on so many documents at most (chosen by hash of id), none longer than this.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 1024, 32_768, 65_536
#: A block closes at so many bytes of frames, or documents.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 1024
LEVEL = 3
#: Most pre-tokens that a worker keeps, characters at which one isn't kept, pre-tokens of one call of the library, and chunks of a stretch.
CACHE, LONG, CALL, STRETCH = 600_000, 64, 64, 4096
#: What makes a text other than Latin: letters beyond, the one whose lower case is two, and white space beyond that of ASCII.
OTHER = r"[^\x00-\x{24f}]|\x{85}|\x{a0}|\x{130}"
#: Pre-tokens beside runs of letters (of the vocabulary's pattern, which also has contractions): runs of symbols, single digits.
SYMBOLS = r"[^\t-\r \p{L}\p{N}]+|\p{N}"
BLOCKS = "part int, block int, first long, low long, high long, dict_sha256 string, ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"


class Encoder:
    """The tokenizers library on whole texts. Texts of Latin letters are cut into the pre-tokens of the vocabulary's pattern by
    Arrow, and the library encodes each distinct pre-token once; a worker keeps their serialized ids in a bounded cache
    that changes no result. All other texts go to the library as they are, in stretches between white space."""

    def __init__(self, path: str):
        self.whole, self.alone = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.alone.normalizer = Sequence([])  # takes pre-tokens as they are
        self.alone.pre_tokenizer = PreTokenizers([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        for t in (self.whole, self.alone):
            t.no_truncation()
            t.no_padding()
        self.odd = "|".join([OTHER, *map(re.escape, (x.content for x in self.whole.get_added_tokens_decoder().values()))])
        self.known: dict[str, bytes] = {"": b""}

    def stretches(self, text: str) -> bytes:
        """Serialized ids of a text of any kind. No pre-token crosses white space, so a stretch may be any number of chunks."""
        words = chunks(text)
        some = [" ".join(words[k : k + STRETCH]) for k in range(0, len(words), STRETCH)]
        return b"".join([np.array(x.ids, "<u4").tobytes() for x in self.whole.encode_batch(some, add_special_tokens=False)])

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Serialized ids of distinct pre-tokens."""
        ids = list(map(self.known.get, words))
        fresh = [k for k, x in enumerate(ids) if x is None]
        for begin in range(0, len(fresh), CALL):
            some = fresh[begin : begin + CALL]
            found = self.alone.encode(" ".join([words[k] for k in some]), add_special_tokens=False)
            data = np.array(found.ids, "<u4").tobytes()
            cut = (4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(some) + 1))).tolist()
            for k, x, y in zip(some, cut, cut[1:]):
                ids[k] = data[x:y]
        if len(self.known) + len(fresh) > CACHE:
            self.known = {"": b""}
        self.known.update([(words[k], ids[k]) for k in fresh if len(words[k]) < LONG])
        return ids

    def serialized(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """Ids of whole texts (null: of an empty one) and the end id, as little-endian unsigned 32-bit numbers."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd)
        low = pc.utf8_lower(pc.if_else(odd, "", texts))
        # an apostrophe may begin a contraction; without one, the plain pattern says the same
        quoted = pc.match_substring(low, "'")
        if pc.any(quoted).as_py():
            both = (pc.replace_substring_regex(pc.if_else(quoted, low, ""), f"('(?:s|t|re|ve|m|ll|d)|{SYMBOLS})", r" \1 "), pc.replace_substring_regex(pc.if_else(quoted, "", low), f"{SYMBOLS}", r" \0 "))
            spaced = pc.if_else(quoted, *both)
        else:
            spaced = pc.replace_substring_regex(low, SYMBOLS, r" \0 ")
        split = pc.ascii_split_whitespace(spaced)
        coded = split.flatten().dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # all ids in one array: each pre-token's stretch of the distinct ones, in the order of the texts
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, code = np.cumsum(size) - size, coded.indices.to_numpy()
        n = size[code]
        until = np.cumsum(n)
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(start[code] - until + n, n) + np.arange(int(n.sum()))] if len(code) else np.empty(0, "<u4")
        cut = np.append(0, until)[split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()].tolist()
        out = [flat[a:b].tobytes() + end for a, b in zip(cut, cut[1:])]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self.stretches(texts[k].as_py()) + end
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train_dictionary(docs: DataFrame, path: str, end: int) -> bytes:
    """A zstandard dictionary fitted on the serialized ids of a bounded sample; empty where too little is given.

    The sample is the rows whose hash of id is below a bound that about SAMPLE_ROWS of all rows are below: the count comes
    from the file's metadata, and texts are read once.
    """
    share = SAMPLE_ROWS / max(docs.count(), 1)
    low = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    texts = docs.where(low & F.length("text").between(1, SAMPLE_CHARS)).select("text").limit(SAMPLE_ROWS)
    sample = sorted(encoder(path).serialized(pa.array([r["text"] for r in texts.collect()], pa.string()), struct.pack("<I", end)))  # SAMPLE_ROWS at most
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, add the end id, and write the files to a new folder in ascending id order.

    Null ids come first; repeated ids stand in the order of a hash of their texts; null and empty texts have the end id
    alone; an empty table makes files without blocks; other columns are not read. Ranges of (id, hash, place of the row)
    go to tasks, so that rows of one id, or none, or equal rows, are split among tasks too.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(rows, tokenizer, end)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches):
        last = struct.pack("<I", end)
        part, number, first = TaskContext.get().partitionId(), 0, 0
        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        size = 0

        def block():
            ends = np.cumsum([0, *map(len, frames)])
            known = [x for x in ids if x is not None]
            row = [part, number, first, min(known, default=None), max(known, default=None), digest, ids, counts, ends.tolist(), b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names)

        names = [x.split()[0] for x in BLOCKS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for batch in pieces(batches, 1, 2048, 1 << 23):
            for key, data in zip(batch.column(0).to_pylist(), encoder(tokenizer).serialized(batch.column(1), last)):
                frames.append(made.compress(data))
                ids.append(key)
                counts.append(len(data) // 4)
                size += len(frames[-1])
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
                    yield block()
                    number, first = number + 1, first + sum(counts)
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield block()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.col("key").asc(), F.col("at").asc()]
    keyed = rows.withColumns({"key": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text").mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """Documents of the files: (id, part, place, tokens array<long>) for all, or for the ids named.

    For named ids only blocks whose range may hold them are read, and only their frames are decompressed.
    """
    dictionaries = spark.read.parquet(f"{path}/dictionary")
    known = {r["dict_sha256"]: bytes(r["dictionary"]) for r in dictionaries.collect()}  # one row of bounded size
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if ids is not None:
        blocks = blocks.where(" or ".join(f"(low <= {int(x)} and high >= {int(x)})" for x in ids) or "false")
    wanted = None if ids is None else set(ids)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found, payload = known[row["dict_sha256"]], row["payload"]
                made = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(found)) if found else zstandard.ZstdDecompressor()
                start, keys, starts, lists = row["first"], [], [], []
                for k, key in enumerate(row["ids"]):
                    if wanted is None or key in wanted:
                        data = made.decompress(payload[row["offsets"][k] : row["offsets"][k + 1]])
                        keys.append(key)
                        starts.append(start)
                        lists.append(data)
                    start += row["n_tokens"][k]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([row["part"]] * len(keys), pa.int32()), pa.array(starts, pa.int64()), pa.array(lists, pa.binary()), pa.array([zlib.crc32(x) for x in lists], pa.int64())], ["id", "part", "place", "data", "crc32"])

    return blocks.mapInArrow(run, "id long, part int, place long, data binary, crc32 long")


def index(spark: SparkSession, path: str) -> DataFrame:
    """Ids of all documents before each part of the files: (part, base). A row for each task that wrote, no payload read."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def file_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Start, count and crc32 of every document's ids as the files hold them."""
    docs = read_token_files(spark, path)
    return docs.join(F.broadcast(index(spark, path)), "part").select(
        F.col("id").alias(id_col),
        (F.col("base") + F.col("place")).alias("start"),
        (F.length("data") / 4).cast("long").alias("n_tokens"),
        F.col("crc32").alias("ids_crc32"),
    )
