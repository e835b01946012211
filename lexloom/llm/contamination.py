"""Evaluation texts leaking into training text: an FM-index per training shard, searched for all test phrases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.fmindex import FMIndex
from lexloom.llm.forms import bare_codes, stretches
from lexloom.runtime import ship

#: Characters of text in one index, phrases searched at a time, and test characters held by a task at a time.
SHARD_CHARS, PHRASES, ITEM_CHARS = 1 << 20, 1 << 17, 8 << 20
NONE = (np.empty(0, np.int64),) * 4


def phrases(off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of `width` characters inside an item, and its item's number; off: where items begin and end."""
    start = np.arange(max(0, off[-1] - width + 1))
    item = np.searchsorted(off, start, side="right") - 1
    inside = start + width <= off[item + 1]
    return start[inside], item[inside]


def merged(d: np.ndarray, i: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """Spans (document, item, start, end) in order, those of one document and item that touch made one."""
    if not len(d):
        return NONE
    o = np.lexsort((a, i, d))
    d, i, a, b = d[o], i[o], a[o], b[o]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (a[1:] > b[:-1])]))
    last = np.append(first[1:], len(d)) - 1
    return d[first], i[first], a[first], b[last]


class Shard:
    """Pieces of documents, indexed together once."""

    def __init__(self, pieces: list[tuple[int, int, np.ndarray]]):
        """pieces: document, place of the piece in it, code points."""
        self.owner, self.base = (np.array([p[k] for p in pieces], np.int64) for k in (0, 1))
        size = np.array([len(p[2]) + 1 for p in pieces])
        self.begin = np.cumsum(size) - size
        codes = np.full(size.sum(), FMIndex.SEPARATOR, np.uint32)
        for at, (_, _, c) in zip(self.begin, pieces):
            codes[at : at + len(c)] = c
        self.index = FMIndex(codes)

    def find(self, codes: np.ndarray, start: np.ndarray, item: np.ndarray, width: int) -> tuple:
        """Merged spans (document, item, start, end) of the windows of `codes`."""
        found = []
        for k in range(0, len(start), PHRASES):
            live, lo, hi = self.index.search(codes, start[k : k + PHRASES], width)
            if len(live):
                count = hi - lo
                rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
                at = self.index.locate(rows)
                d = np.searchsorted(self.begin, at, side="right") - 1
                at = at - self.begin[d] + self.base[d]
                found.append(merged(self.owner[d], np.repeat(item[k + live], count), at, at + width))
        return merged(*(np.concatenate(x) for x in zip(*found))) if found else NONE


def cut_pieces(row: int, codes: np.ndarray, width: int, limit: int):
    """A document in pieces of at most `limit` characters, that repeat so much that every window stands in exactly one."""
    step = max(1, limit - width + 1)
    for s in range(0, len(codes) - width + 1, step):
        yield row, s, codes[s : s + step + width - 1]


def leaked_spans(docs: DataFrame, items: DataFrame, min_chars: int = 40, shard_chars: int = SHARD_CHARS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """docs: `doc_id`, `text`; items: `item_id`, `text` -> doc_id, item_id, start, end (in the document's bare form).

    A span is a longest stretch of at least `min_chars` characters in a row of the item's
    bare form; spans of one item that touch are merged. Null, empty and shorter texts give
    no row, nor do rows without an id; repeated rows give their spans again.

    Documents never move. Each shard of at most `shard_chars` characters is indexed once, whatever
    the number of items, and a longer document stands in several shards. The items come to
    the driver and the tasks in blocks of about `item_chars` characters, of which a task holds one.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    tests = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = tests.agg(F.sum(F.char_length("text"))).first()[0] or 0
    parts = int(total // item_chars) + 1
    blocks = []
    for part in range(parts):
        got = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toArrow()
        if len(got):
            blocks.append(spark.sparkContext.broadcast((got["item_id"].to_numpy(), *bare_codes(got["text"].to_pylist()))))
    limit = max(shard_chars, 2 * min_chars)

    def spans(pieces):
        shard, found = Shard(pieces), []
        for block in blocks:
            ids, codes, off = block.value
            d, i, a, b = shard.find(codes, *phrases(off, min_chars), min_chars)
            found.append((d, ids[i], a, b))
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)  # read again for the next shard; one block is held at a time
        return tuple(np.concatenate(x) for x in zip(*found))

    def run(batches):
        names: dict[int, int] = {}
        held, size, carry, row = [], 0, NONE, -1

        def flush(open_row):
            """Spans of the documents that are complete; those of the one still being read are kept for the next shard."""
            nonlocal held, size, carry
            d, i, a, b = merged(*(np.concatenate(x) for x in zip(carry, spans(held))))
            done = d != open_row
            carry = tuple(x[~done] for x in (d, i, a, b))
            out = pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in d[done].tolist()], pa.int64()), pa.array(i[done]), pa.array(a[done].astype(np.int32)), pa.array(b[done].astype(np.int32))],
                ["doc_id", "item_id", "start", "end"],
            )
            for k in [k for k in names if k != open_row]:
                del names[k]
            held, size = [], 0
            return out

        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0).to_pylist()
            for i, j in stretches(texts):
                codes, off = bare_codes(texts[i:j])
                for k, key in enumerate(keys[i:j]):
                    row += 1
                    for piece in cut_pieces(row, codes[off[k] : off[k + 1]], min_chars, limit):
                        if held and size + len(piece[2]) > limit:
                            yield flush(row if piece[1] else -1)
                        names[row] = key
                        held.append(piece)
                        size += len(piece[2])
        if held:
            yield flush(-1)

    schema = "doc_id bigint, item_id bigint, start int, end int"
    return rows.mapInArrow(run, schema) if blocks else spark.createDataFrame([], schema)
