"""Long exact spans shared between records, by fixed-block anchors.

A run of L characters that two texts share holds a whole block of B <= L / 2 characters
of the reference blocks at 0, B, 2B ... of either text. So:

1. The reference blocks of all texts set bits in filters of bounded size, one for each range
   of hashes; there are as many ranges as the blocks need, so that a filter never fills up.
2. Every rolling window of B characters probes the filter of its range, a pass over the texts
   for each filter; what it lets through, and the reference blocks, meet by hash. A block of
   one text that also stands in another one is an anchor there and here.
3. Around the anchors, hits are extended: each window of L characters that holds an anchor
   is looked for in other texts by its 128-bit hash. The union of the windows found in
   more than one text are the maximal repeats of at least L characters.

Meeting is by least and greatest text of each hash, aggregated before the shuffle; no
pairs are formed, and the rows of a passage of a third of all records are spread over
many tasks where they learn that it is shared. Texts that are equal as a whole are one
text with several records, shared as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.forms import stretches
from lexloom.runtime import fits, materialize, ship, small, spread_join

#: Bits of one filter, which is what is broadcast at a time; bits for each block, and how many of them it sets.
FILTER_BITS, BITS_PER_BLOCK, PROBES = 1 << 29, 12, 3
#: Bits of a filter that are packed in one row.
SEGMENT = 1 << 17
MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(codes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of the window of `width` characters at each position, by doubling: h(a+b) = h(a) * p^b + h(b)."""
    mask = (1 << 64) - 1
    cur = _mix(codes.astype(np.uint64), 1 + which)
    p = MUL[which]
    acc, size, k = None, 0, 1
    w = width
    while w:
        if w & 1:
            if acc is None:
                acc, size = cur, k
            else:
                n = len(codes) - size - k + 1
                if n <= 0:
                    return np.empty(0, np.uint64)
                acc = acc[:n] * np.uint64(p) + cur[size : size + n]
                size += k
        w >>= 1
        if w:
            n = len(codes) - 2 * k + 1
            if n <= 0:
                return np.empty(0, np.uint64)
            cur = cur[:n] * np.uint64(p) + cur[k : k + n]
            k *= 2
            p = p * p & mask
    return _mix(acc, 7)


def _batch(texts: list):
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return codes, off


def _windows(codes: np.ndarray, off: np.ndarray, width: int):
    """Hashes, text number and position of all windows inside a text."""
    h = rolling(codes, width)
    if not len(h):
        return h, np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(h)]
    at = np.arange(len(h))
    ok = at + width <= off[doc + 1]
    return h[ok], doc[ok], (at - off[doc])[ok]


def _cid(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def _parts(batches):
    """Texts in lists of a bounded number of characters."""
    for b in batches:
        texts = b.column(0).to_pylist()
        for i, j in stretches(texts):
            yield texts[i:j]


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash, by its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _slots(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    return _mix(h, 11 + k) & np.uint64(bits - 1)


def _blocks(block: int, bits: int, ranges: int, now: int):
    """Bits that the reference blocks of one range set: number and bits of each segment that has any."""

    def run(batches):
        for texts in _parts(batches):
            codes, off = _batch(texts)
            h, _, pos = _windows(codes, off, block)
            h = h[pos % block == 0]
            h = h[_range(h, ranges) == now] if ranges > 1 else h
            slot = np.unique(np.concatenate([_slots(h, bits, k) for k in range(PROBES)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slot // SEGMENT).astype(np.int32)), pa.array((slot % SEGMENT).astype(np.int32))], ["seg", "bit"])

    return run


def _segment(tab: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT, np.uint8)
    bits[tab["bit"].to_numpy()] = 1
    return pa.table({"seg": tab["seg"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _probe(block: int, bits: int, ranges: int, now: int, bc):
    def run(batches):
        bitmap = np.frombuffer(bc.value, np.uint8)
        seen: set = set()
        for texts in _parts(batches):
            cids = [_cid(t) for t in texts]
            fresh = []
            for i, c in enumerate(cids):
                if c not in seen:
                    seen.add(c)
                    fresh.append(i)
            texts, cids = [texts[i] for i in fresh], [cids[i] for i in fresh]
            codes, off = _batch(texts)
            h, doc, pos = _windows(codes, off, block)
            at = np.flatnonzero(_range(h, ranges) == now) if ranges > 1 else np.arange(len(h))
            for k in range(PROBES):
                slot = _slots(h[at], bits, k)
                at = at[(bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at].view(np.int64)), pa.array([cids[i] for i in doc[at]], pa.binary()), pa.array(pos[at].astype(np.int32)), pa.array(pos[at] % block == 0)],
                ["h", "cid", "pos", "ref"],
            )

    return run


def probe(texts: DataFrame, block: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """`h`, `cid`, `pos`, `ref` of the windows that a filter lets through, reference blocks among them.

    One pass over the texts for each range of hashes; what a pass finds is written before the
    next one, and its filter is taken back from the tasks.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    want = size // block * BITS_PER_BLOCK
    ranges = max(1, -(-want // filter_bits))
    bits = max(1 << 17, 1 << max(0, -(-want // ranges) - 1).bit_length())
    out = None
    for now in range(ranges):
        segs = texts.mapInArrow(_blocks(block, bits, ranges, now), "seg int, bit int").distinct()
        got = segs.groupBy("seg").applyInArrow(_segment, "seg int, bits binary").toArrow()  # at most bits / 8 bytes
        bitmap = np.zeros(bits // 8, np.uint8)
        for seg, packed in zip(got["seg"].to_pylist(), got["bits"].to_pylist()):
            bitmap[seg * (SEGMENT // 8) :][: SEGMENT // 8] = np.frombuffer(packed, np.uint8)
        bc = spark.sparkContext.broadcast(bitmap.tobytes())
        hits = materialize(texts.mapInArrow(_probe(block, bits, ranges, now, bc), "h bigint, cid binary, pos int, ref boolean"), "probes")
        bc.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out


def _starts(anchors: np.ndarray, size: int, block: int, length: int) -> np.ndarray:
    """Starts of the windows of `length` characters that hold an anchor."""
    edge = np.zeros(size + 2, np.int32)
    np.add.at(edge, np.maximum(anchors - (length - block), 0), 1)
    np.add.at(edge, np.minimum(anchors, size - length) + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: size - length + 1] > 0)


def _extend(block: int, length: int):
    def run(batches):
        for b in batches:
            for cid, text, anchors in zip(*(b.column(k).to_pylist() for k in range(3))):
                codes, _ = _batch([text])
                at = _starts(np.array(anchors), len(codes), block, length)
                if not len(at):
                    continue
                h1, h2 = rolling(codes, length)[at], rolling(codes, length, 1)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([cid] * len(at), pa.binary()), pa.array(at.astype(np.int32))],
                    ["h1", "h2", "cid", "pos"],
                )

    return run


def covered(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of the windows that begin at sorted `starts`."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + length
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] + length


def shared_spans(docs: DataFrame, length: int = 200, block: int | None = None, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs: `doc_id`, `text` -> doc_id, shared_chars, n_spans, longest, for each document with a shared run.

    A character counts if it lies in a run of at least `length` characters, as stored, that
    also occurs in the text of another doc_id. Null, empty and shorter texts, and rows without an id, give no row; a
    doc_id delivered several times counts as one record. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    block = block or length // 2
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.char_length("text") >= length))
    texts = rows.select("text")
    hits = probe(texts, block, filter_bits)
    met = hits.groupBy("h").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.max("ref").alias("ref"), F.count("*").alias("n"))
    met = materialize(met.where("ref and lo <> hi").select("h", "n"), "met")
    anchors = spread_join(hits.select("h", "cid", "pos"), met, ["h"], "n").groupBy("cid").agg(F.collect_set("pos").alias("anchors"))
    anchors = materialize(anchors, "anchors")
    named = texts.withColumn("cid", F.unhex(F.md5(F.col("text").cast("binary"))))
    if fits(anchors):
        one = named.join(F.broadcast(anchors), "cid").groupBy("cid").agg(F.min("text").alias("text"), F.first("anchors").alias("anchors"))
    else:  # copies are gone before the texts meet their anchors
        one = named.groupBy("cid").agg(F.min("text").alias("text")).join(anchors, "cid")
    wins = materialize(one.select("cid", "text", "anchors").mapInArrow(_extend(block, length), "h1 bigint, h2 bigint, cid binary, pos int"), "windows")
    both = wins.groupBy("h1", "h2").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h1", "h2", "n")
    both = materialize(both, "shared-windows")

    def cover(tab: pa.Table) -> pa.Table:
        a, b = covered(np.sort(tab["pos"].to_numpy()), length)
        return pa.table({"cid": tab["cid"][:1], "chars": [int((b - a).sum())], "spans": [len(a)], "longest": [int((b - a).max())]})

    per = spread_join(wins, both, ["h1", "h2"], "n").select("cid", "pos").groupBy("cid").applyInArrow(cover, "cid binary, chars bigint, spans bigint, longest bigint")
    per = materialize(per, "covered")
    ids = rows.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("cid"), F.char_length("text").cast("bigint").alias("n")).distinct()
    ids = materialize(ids, "texts")
    many = materialize(ids.groupBy("cid").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("cid", F.lit(True).alias("many")), "copies")
    x = ids.join(small(per), "cid", "left").join(small(many), "cid", "left").where("many or chars is not null")
    whole = F.col("many").isNotNull()
    return x.groupBy("doc_id").agg(
        F.max(F.when(whole, F.col("n")).otherwise(F.col("chars"))).alias("shared_chars"),
        F.max(F.when(whole, 1).otherwise(F.col("spans"))).alias("n_spans"),
        F.max(F.when(whole, F.col("n")).otherwise(F.col("longest"))).alias("longest"),
    )
