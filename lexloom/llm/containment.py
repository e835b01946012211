"""Held-out records that stand in training records: word n-grams of the held-out side, a scan of the training side, containment.

1. The texts of either side are reduced to classes of the same words, and these to the hashes
   of their n-grams of words.
2. The held-out n-grams are partitioned by hash, and the training texts scanned for them; what
   they hit is counted per n-gram. Training n-grams that no held-out record has go no further.
3. A training text that contains a share t of a held-out record's n grams has one of its
   n - ceil(t n) + 1 rarest ones; only these look for candidates. The hits of an n-gram of
   very many training texts are spread over tasks.
4. The n-grams of each candidate pair are counted in full, which gives the containment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.forms import stretches, transducer
from lexloom.runtime import fits, materialize, ship, spread_join

WORD = regex.compile(r"[\p{L}\p{N}]+")
HELD_OUT, TRAIN = 1, 2


def word_grams(words: list[str], n: int) -> list[int]:
    """Hashes of the distinct n-grams; of fewer than n words the whole is the only one."""
    if not words:
        return []
    grams = {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
    return sorted(xxhash.xxh3_64_intdigest(g) - (1 << 63) for g in grams)


def prepare(df: DataFrame, n: int = 5) -> DataFrame:
    """`key`, `text`, `side` -> `key`, `side`, `cid` (16 bytes that name the words), `grams`. Written once.

    The words are those of the consistent form. Null texts and texts without a word have no
    class and are left out.
    """
    ship(df.sparkSession)

    def run(batches):
        t = transducer()
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in stretches(texts):
                words = [WORD.findall(x or "") for x in t.many(texts[i:j])]
                has = np.array([bool(w) for w in words], bool)
                at = pa.array(i + np.flatnonzero(has))
                words = [w for w in words if w]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(at),
                        b.column(2).take(at),
                        pa.array([xxhash.xxh3_128_digest(" ".join(w)) for w in words], pa.binary()),
                        pa.array([word_grams(w, n) for w in words], pa.list_(pa.int64())),
                    ],
                    ["key", "side", "cid", "grams"],
                )

    rows = df.select("key", "text", F.col("side").cast("int").alias("side"))
    return materialize(rows.mapInArrow(run, "key string, side int, cid binary, grams array<bigint>"), "word-grams")


def contained_classes(prep: DataFrame, t: float = 0.8) -> DataFrame:
    """`cid` (held out), `other` (training), `containment` of every pair of classes with a containment of at least t.

    A class that stands on both sides is contained in itself. An empty table gives an empty result.
    """
    c = prep.groupBy("cid").agg(F.first("grams").alias("grams"), F.bit_or("side").alias("side"))
    c = materialize(c, "classes")
    on = lambda bit: c.where(F.col("side").bitwiseAND(F.lit(bit)) > 0)
    asked = materialize(on(HELD_OUT).select(F.explode("grams").alias("g")).distinct(), "held-out-grams")
    scan = on(TRAIN).select(F.col("cid").alias("other"), F.explode("grams").alias("g"))
    hits = materialize(scan.join(F.broadcast(asked) if fits(asked) else asked, "g", "left_semi"), "hits")
    often = materialize(hits.groupBy("g").agg(F.count("*").alias("n")), "gram-hits")
    posted = on(HELD_OUT).select("cid", F.size("grams").alias("size"), F.explode("grams").alias("g"))
    have = posted.groupBy("g").agg(F.count("*").alias("m"))  # how often a gram is asked for
    often = materialize(often.join(have, "g"), "gram-hits")
    ranked = spread_join(posted, often, ["g"], "m").groupBy("cid").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "g"))).alias("s"))
    # grams without any hit come first in the order of rarity, and can't be asked
    ask = F.col("size") - F.ceil(F.lit(t) * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("s"))
    index = ranked.where(ask > 0).select("cid", F.explode(F.slice("s", F.lit(1), F.greatest(ask, F.lit(1)).cast("int"))).alias("x")).select("cid", "x.g", "x.n")
    index = materialize(index, "rare-grams")
    cand = spread_join(hits, index, ["g"], "n").select("cid", "other").distinct()
    a = c.select("cid", F.col("grams").alias("ga"))
    b = c.select(F.col("cid").alias("other"), F.col("grams").alias("gb"))
    share = F.size(F.array_intersect("ga", "gb")) / F.size("ga")
    out = cand.join(a, "cid").join(b, "other").select("cid", "other", share.alias("containment"))
    return materialize(out.where(F.col("containment") >= t - 1e-9), "contained")
