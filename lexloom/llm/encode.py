"""Encoding of a whole corpus by a public byte-level BPE tokenizer, one encoding per distinct word.

1. Each block of documents is cut into pre-tokens and dictionary-encoded: its distinct
   words, and for each document the places of its words in that list (the pre-aggregation
   of the word shuffle: a word crosses it once per block, not once per occurrence).
2. The distinct words of all blocks are encoded once each.
3. Their ids are joined back to the blocks and put together by position.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import HOT_ROWS, materialize, ship, spread_join

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 1 << 20
MAX_DOCS = 1 << 16


def read_ranks(name: str, folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def _parse(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}


_encoders: dict[int, object] = {}


def encoder(ranks: bytes):
    k = hash(ranks)
    if k not in _encoders:
        import tiktoken

        _encoders[k] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_parse(ranks), special_tokens={})
    return _encoders[k]


def _blocks(block_chars: int):
    pattern = regex.compile(PATTERN)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        words: dict[str, int] = {}
        docs, lens, places, chars = [], [], [], 0

        def flush():
            nonlocal words, docs, lens, places, chars, seq
            at = np.array(places, np.uint32)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 24) + seq], pa.int64()),
                    pa.array([list(words)], pa.list_(pa.string())),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([lens], pa.list_(pa.int32())),
                    pa.array([at.tobytes()], pa.binary()),
                ],
                ["block", "words", "docs", "lens", "places"],
            )
            seq += 1
            words, docs, lens, places, chars = {}, [], [], [], 0
            return row

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = pattern.findall(text) if text else []
                put = words.setdefault
                places += [put(w, len(words)) for w in found]
                docs.append(doc)
                lens.append(len(found))
                chars += len(text or "")
                if chars >= block_chars or len(docs) >= MAX_DOCS:
                    yield flush()
        if docs:
            yield flush()

    return run


def _encode_words(bc):
    def run(batches):
        enc = encoder(bc.value)
        for b in batches:
            ids = [enc._encode_single_piece(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return run


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches named by `at`, end to end, and their sizes."""
    n = sizes[at]
    ends = np.cumsum(n)
    base = np.repeat(starts[at] - (ends - n), n)
    return flat[base + np.arange(len(base))], n


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    if not len(left):
        return schema.empty_table()
    lists = right["ids"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat = lists.flatten().to_numpy()
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int32)
    local = right["local"].to_numpy()
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.empty(0, np.int64)
    starts, sizes = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    starts[local], sizes[local] = begin, size
    docs, ids = [], []
    for r in range(len(left)):
        at = np.frombuffer(left["places"][r].as_py(), np.uint32)
        lens = left["lens"][r].values.to_numpy() if len(left["lens"][r].values) else np.empty(0, np.int32)
        out, n = gather(flat, starts, sizes, at)
        tot = np.concatenate([[0], np.cumsum(n)])
        off = tot[np.concatenate([[0], np.cumsum(lens)])].astype(np.int32)
        docs.append(left["docs"][r].values)
        ids.append(pa.ListArray.from_arrays(pa.array(off), pa.array(out.astype(np.int32))))
    return pa.table([pa.chunked_array(docs), pa.chunked_array(ids)], schema=schema)


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, block_chars: int = BLOCK_CHARS, hot: int = HOT_ROWS) -> DataFrame:
    """`doc_id` bigint, `ids` array<int> of every row, without special tokens.

    Null and empty texts have an empty list. Repeated rows are encoded each. An empty
    table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    blocks = materialize(
        rows.mapInArrow(_blocks(block_chars), "block bigint, words array<string>, docs array<bigint>, lens array<int>, places binary"), "blocks"
    )
    places = blocks.select("block", F.posexplode("words").alias("local", "word"))
    bc = spark.sparkContext.broadcast(read_ranks(tokenizer, folder))
    # each distinct word with the number of its blocks; only a word of very many blocks is repeated, for as many tasks as it needs
    words = places.groupBy("word").agg(F.count("*").alias("n"))
    coded = materialize(words.mapInArrow(_encode_words(bc), "word string, n bigint, ids array<int>"), "words")
    words = spread_join(places, coded, ["word"], "n", hot).select("block", "local", "ids")
    docs = blocks.select(F.col("block").alias("home"), "docs", "lens", "places")
    return docs.groupBy("home").cogroup(words.groupBy("block")).applyInArrow(_assemble, "doc_id bigint, ids array<int>")


def decode(ids: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """`doc_id`, `text` of encoded rows, by a join with the table of the tokens' bytes.

    The table has one row per vocabulary entry, so that it is broadcast; a batch's ids take
    their bytes from it as one Arrow column. A null list gives an empty text; ids that aren't
    the whole of a character's bytes give the replacement character.
    """
    spark = ids.sparkSession
    ship(spark)
    bc = spark.sparkContext.broadcast(read_ranks(tokenizer, folder))

    def run(batches):
        ranks = _parse(bc.value)
        table = pa.array([k for k, _ in sorted(ranks.items(), key=lambda x: x[1])], pa.binary())
        for b in batches:
            lists = b.column(1).cast(pa.list_(pa.int32()))
            parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]), pa.int32()), table.take(lists.flatten()))
            texts = [x.decode("utf-8", "replace") for x in pc.binary_join(parts, b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
