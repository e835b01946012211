"""Exact similarity join on sets of three-character pieces by T-occurrence search.

Two texts are similar when their sets of distinct pieces have a Jaccard similarity of
at least t. A record of n pieces then shares at least T = ceil(t * n) pieces with each
partner, so that of its inverted lists the T - 1 longest can be left aside (DivideSkip
with the largest number of long lists): every partner stands in one of the n - T + 1
short lists. The short lists are merged first, the long ones are probed by binary
search only for the candidates that are left:

1. All pieces are counted in a fixed number of slots (a bounded table, broadcast);
   the count orders the pieces from rare to frequent.
2. Each record sends its rare pieces to buckets by their hash, together with its size
   and a parity sketch of its whole set. A list longer than `hot` is divided into
   blocks, and its record sent to each pair of blocks, so that no task gets a whole
   hot list. Copies of one text are sent once per task.
3. A bucket merges its lists. The place of a piece among the record's own, rare ones first,
   bounds the size of a partner whose first common piece it is; partners out of either
   one's reach, and partners whose sketches differ in more bits than the similarity allows,
   are left out. All bounds are exact: no similar pair is lost. Short lists are paired
   entry by entry, long ones in tiles of all against all.
4. The candidates' full piece sets are probed (binary search of the sorted pieces of
   the one in those of the other), and pairs with the required overlap are kept.

Texts without any piece (null, empty or under three characters in bare form) are
similar to nothing. Copies in bare form share a class; pairs are between classes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.forms import bare_codes, stretches
from lexloom.runtime import fits, materialize, ship, small, spread_join

SLOTS = 1 << 20
MAX_WIDTH = 12
CHUNK = 1 << 19
#: Pairs of a list from which it is merged in tiles, and rows and columns of a tile, and how many ranges of reach are apart.
DENSE, TILE, GRADES = 1 << 17, (32, 512), 2
#: Bytes of packed postings in a bucket.
BUCKET_BYTES = 64 << 20
#: Bytes of packed postings that are shuffled at a time, or half as many again as the texts have.
ROUND_BYTES = 1 << 30


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pieces(bare: list, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Record number and 63-bit code of every three-character piece of bare forms."""
    codes = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(x) for x in bare], dtype=np.int64)])
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    c = codes.astype(np.uint64)
    g = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    doc = np.repeat(np.arange(len(bare)), np.diff(off))
    ok = doc[:-2] == doc[2:]
    g, doc = g[ok], doc[:-2][ok]
    if distinct and len(g):
        o = np.lexsort((g, doc))
        g, doc = g[o], doc[o]
        first = np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])
        g, doc = g[first], doc[first]
    return doc, g


def _slot(g: np.ndarray) -> np.ndarray:
    return (_mix(g) >> np.uint64(44)).astype(np.int64)


def _count_slots(batches):
    total = np.zeros(SLOTS, np.int64)
    for b in batches:
        texts = b.column(0).to_pylist()
        for i, j in stretches(texts):
            _, g = pieces(texts[i:j], distinct=False)
            total += np.bincount(_slot(g), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])


def slot_counts(texts: DataFrame) -> np.ndarray:
    """How often the pieces of each slot occur in all texts. At most SLOTS rows reach the driver."""
    rows = texts.mapInArrow(_count_slots, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


SIGNATURE = "bucket bigint, ids binary, n binary, side binary, sketch binary, lens binary, keys binary, places binary"


def _width(n: np.ndarray) -> np.ndarray:
    """Binary logarithm of the sketch's bits, from 64 to 2 ** MAX_WIDTH: the least at which sets that share
    little differ in more bits than similar ones may, by some four standard deviations."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / 1.7)), 6, MAX_WIDTH).astype(np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in one byte each if all fit, else in two, else in four; `_widened` tells by the length."""
    top = x.max(initial=0)
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _widened(rows: list[bytes], counts: np.ndarray) -> np.ndarray:
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
    return np.concatenate([np.frombuffer(r, kinds[len(r) // max(c, 1)] if c else np.uint8).astype(np.int64) for r, c in zip(rows, counts)])


def rarity(counts: np.ndarray) -> np.ndarray:
    """Place of each slot in the order from rare to frequent, by the full counts."""
    rank = np.empty(SLOTS, np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(SLOTS, dtype=np.uint32)
    return rank


def places_of(key: np.ndarray, often: np.ndarray, ids: np.ndarray, buckets: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Posting number and bucket of each place a posting goes to.

    An ordinary list lies in one bucket. A list of more than `hot` postings is cut into blocks
    by its records' ids, and each posting goes to the place of every pair of blocks that its
    own block is in.
    """
    parts = np.maximum(-(-often // hot), 1)
    at = np.repeat(np.arange(len(key)), parts)
    other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    n = parts[at]
    mine = (ids[at] % n.astype(np.uint64)).astype(np.int64)
    pair = np.minimum(mine, other) * n + np.maximum(mine, other)
    k = key[at].astype(np.int64)
    spread = buckets + (_mix((k.astype(np.uint64) << np.uint64(20)) ^ pair.astype(np.uint64)) >> np.uint64(24)).astype(np.int64)
    return at, np.where(n == 1, k % buckets, spread)


def _signatures(counts_bc, t: float, buckets: int, hot: int, rounds: int = 1, now: int = 0):
    """For each bucket of one round, the texts of a block that go there, as packed arrays in one row.

    Pieces are sorted as packed 64-bit keys: number of the text, rarity of the slot, rest of the
    hash. A text's set is known by 54 bits of its pieces' hashes; lists by 32 bits, which can only
    add candidates; texts by 64 bits of their names, which together with size and sketch can
    only add candidates either.
    """

    def block(texts, sides, cids, counts, rank, slot_at):
        doc, g = pieces(texts, distinct=False)
        if not len(g):
            return None
        m = len(texts)
        u = np.sort((doc.astype(np.uint64) << np.uint64(54)) | (_mix(g) >> np.uint64(10)))
        u = u[np.concatenate([[True], u[1:] != u[:-1]])]
        doc = (u >> np.uint64(54)).astype(np.int64)
        n = np.bincount(doc, minlength=m)
        width = 1 << _width(n)
        place = np.concatenate([[0], np.cumsum(width)])
        flat = place[doc] + (u & (width[doc] - 1).astype(np.uint64)).astype(np.int64)
        sketch = np.packbits((np.bincount(flat, minlength=place[-1]) & 1).astype(np.uint8), bitorder="little").view(np.uint64)
        place >>= 6
        low = np.uint64((1 << 34) - 1)
        slot = ((u >> np.uint64(34)) & np.uint64(SLOTS - 1)).astype(np.int64)
        u = np.sort((doc.astype(np.uint64) << np.uint64(54)) | (rank[slot].astype(np.uint64) << np.uint64(34)) | (u & low))
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        nth = np.arange(len(u)) - start[doc]
        short = nth < (n - np.ceil(t * n - 1e-9).astype(np.int64) + 1)[doc]
        doc, u, nth = doc[short], u[short], nth[short]
        key = ((u & low) >> np.uint64(2)).astype(np.uint32)
        often = counts[slot_at[((u >> np.uint64(34)) & np.uint64(SLOTS - 1)).astype(np.int64)]]
        ids = np.frombuffer(b"".join([c[:8] for c in cids]), np.uint64)
        of, at = places_of(key, often, ids[doc], buckets, hot)
        if rounds > 1:
            mine = at % rounds == now
            of, at = of[mine], at[mine]
        if not len(at):
            return None
        o = np.lexsort((doc[of], at))
        of, at = of[o], at[o]
        who, keys, nth = doc[of], key[of], nth[of]
        begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (who[1:] != who[:-1])]))
        lens = np.diff(np.append(begin, len(at)))
        rec, home = who[begin], at[begin]
        first = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        out = {k: [] for k in ("bucket", "ids", "n", "side", "sketch", "lens", "keys", "places")}
        size = np.diff(place)[rec]
        till = np.concatenate([[0], np.cumsum(size)])
        words = sketch[np.repeat(place[rec] - till[:-1], size) + np.arange(till[-1])]
        ids_, n_, side_, begin = ids[rec], n[rec], sides[rec].astype(np.uint8), np.append(begin, len(keys))
        nth = np.minimum(nth, 255).astype(np.uint8)  # a lower place only lets more pairs through
        for x, y in zip(first, np.append(first[1:], len(home))):
            out["bucket"].append(int(home[x]))
            out["ids"].append(ids_[x:y].tobytes())
            out["n"].append(_narrow(n_[x:y]))
            out["side"].append(side_[x:y].tobytes())
            out["sketch"].append(words[till[x] : till[y]].tobytes())
            out["lens"].append(_narrow(lens[x:y]))
            out["keys"].append(keys[begin[x] : begin[y]].tobytes())
            out["places"].append(nth[begin[x] : begin[y]].tobytes())
        cols = [pa.array(v, pa.int64() if k == "bucket" else pa.binary()) for k, v in out.items()]
        return pa.RecordBatch.from_arrays(cols, list(out))

    def run(batches):
        counts = counts_bc.value
        rank = rarity(counts)
        slot_at = np.empty(SLOTS, np.int64)
        slot_at[rank] = np.arange(SLOTS)
        seen: set = set()
        for b in batches:
            texts, sides, cids = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            fresh = []
            for i, k in enumerate(zip(cids, sides.tolist())):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            held = [texts[i] for i in fresh]
            for i, j in stretches(held, rows=1024):
                f = fresh[i:j]
                out = block(held[i:j], sides[f], [cids[k] for k in f], counts, rank, slot_at)
                if out is not None:
                    yield out

    return run


class Sketches:
    """Parity sketches of sets of different sizes. A sketch folds to half its bits by xor of its halves.

    A pair is compared at the smaller width of the two, where the number of differing bits
    is at most the size of the sets' symmetric difference.
    """

    def __init__(self, n: np.ndarray, words: np.ndarray, offset: np.ndarray):
        self.width = _width(n)
        self.row = np.zeros((MAX_WIDTH + 2, len(n)), np.int32)
        self.tables: dict[int, np.ndarray] = {}
        for w in np.unique(self.width):
            w = int(w)
            own, next_ = np.flatnonzero(self.width == w), np.flatnonzero(self.width == w + 1)
            take = lambda at, k: words[offset[at][:, None] + np.arange(k)]
            k = (1 << w) // 64
            a = take(own, k)
            if len(next_):
                b = take(next_, 2 * k)
                a = np.concatenate([a, b[:, :k] ^ b[:, k:]])
            self.row[w, np.concatenate([own, next_])] = np.arange(len(a))
            self.tables[w] = np.ascontiguousarray(a.T)

    def near(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        w = np.minimum(self.width[x], self.width[y])
        ok = np.abs(self.width[x] - self.width[y]) > 1  # can't be compared: stays a candidate
        for k in np.unique(w):
            at = np.flatnonzero((w == k) & ~ok)
            if not len(at):
                continue
            i, j = self.row[k][x[at]], self.row[k][y[at]]
            ham = np.zeros(len(at), np.uint16)
            for column in self.tables[int(k)]:
                ham += np.bitwise_count(column[i] ^ column[j])
            ok[at] = ham <= limit[at]
        return ok


class Lists:
    """Entries of one side by list and size, each record once a list, with the size of the largest partner that each can have.

    A pair shares nothing before its first common piece. With n pieces, p of them before that one, a
    record then has at most n - p in common with a partner of m, and n - p >= t / (1 + t) * (n + m).
    """

    def __init__(self, key, rec, place, n, t: float):
        by_size = np.argsort(n, kind="stable")
        rank = np.empty(len(n), np.uint64)
        rank[by_size] = np.arange(len(n), dtype=np.uint64)
        at = (key.astype(np.uint64) << np.uint64(32)) | rank[rec]
        o = np.argsort(at)
        at = at[o]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(o) else np.empty(0, np.int64)
        at = at[first]
        self.rec = by_size[(at & np.uint64(0xFFFFFFFF)).astype(np.int64)].astype(np.int32)
        self.n = n[self.rec]
        p = np.minimum.reduceat(place[o], first) if len(o) else place
        self.reach = np.floor((1 + t) / t * (self.n - p) - self.n + 1e-6).astype(np.int64)
        self.base = at & np.uint64(0xFFFFFFFF00000000)
        self.at = self.base | self.n.astype(np.uint64)

    def leading(self) -> "Lists":
        """The entries that can have a partner of their own size or more."""
        out, on = object.__new__(Lists), self.reach >= self.n
        for k, v in vars(self).items():
            setattr(out, k, v[on])
        return out


def _by_entries(a: Lists, b: Lists, lo, width, at, sketches, slack):
    """Candidates of the entries `at` of a with the entries of b that are in their ranges, in steps of CHUNK pairs, across and within lists."""
    total = np.concatenate([[0], np.cumsum(width[at])])
    for begin in range(0, int(total[-1]), CHUNK):
        end = min(begin + CHUNK, int(total[-1]))
        i = int(np.searchsorted(total, begin, side="right")) - 1
        j = int(np.searchsorted(total, end, side="left"))
        c = np.minimum(total[i + 1 : j + 1], end) - np.maximum(total[i:j], begin)
        y = np.arange(begin, end) + np.repeat(lo[at[i:j]] - total[i:j], c)
        ok = np.flatnonzero(b.reach[y] >= np.repeat(a.n[at[i:j]], c))
        x, y = np.repeat(a.rec[at[i:j]], c)[ok], b.rec[y[ok]]
        near = sketches.near(x, y, slack[x] + slack[y]) & (x != y)
        yield x[near].astype(np.int64), y[near].astype(np.int64)


def _by_tiles(a: Lists, b: Lists, ours: slice, theirs: slice, sketches, t: float, slack):
    """Candidates of one list. The entries of a are taken by width of their sketch and by how far they reach, and in tiles by size.

    A tile is compared by as many words of the sketches as tell most pairs apart, what is left by all of them.
    """
    xa, na, ra, xb, nb, rb = a.rec[ours], a.n[ours], a.reach[ours], b.rec[theirs], b.n[theirs], b.reach[theirs]
    grade = sketches.width[xa] * GRADES + np.minimum(((ra - na) * (GRADES * t / (1 - t)) / na).astype(np.int64), GRADES - 1)
    xor, ones = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8)
    for g in np.unique(grade):
        w, of = int(g) // GRADES, np.flatnonzero(grade == g)
        rows = min(TILE[0], max(8, len(of) // 8))
        begin = np.arange(0, len(of), rows)
        from_, to = np.searchsorted(nb, na[of[begin]]), np.searchsorted(nb, np.maximum.reduceat(ra[of], begin), side="right")
        first, row = int(from_[0]), sketches.row[w]
        his, mine = sketches.tables[w][:, row[xb[first : int(to.max())]]], sketches.tables[w][:, row[xa[of]]]
        for i, lo, hi in zip(begin.tolist(), from_.tolist(), to.tolist()):
            k = of[i : i + rows]
            for j in range(lo, hi, TILE[1]):
                end = min(j + TILE[1], hi)
                cap = int(slack[xa[k[-1]]] + slack[xb[end - 1]])
                some = min(len(his), int((1.5 + math.sqrt(2.25 + 2 * cap)) ** 2 / 64) + 1)  # half the bits less three standard deviations are over the cap
                c, d = xor[: len(k), : end - j], ones[: len(k), : end - j]
                ham = np.zeros(c.shape, np.uint8 if some < 4 else np.uint16)
                for q in range(some):
                    np.bitwise_xor(mine[q, i : i + rows, None], his[q, j - first : end - first], out=c)
                    ham += np.bitwise_count(c, out=d)
                if ham.min() > cap:
                    continue
                at = np.flatnonzero(ham <= cap)
                u, v = k[at // (end - j)], j + at % (end - j)
                ok = (nb[v] >= na[u]) & (nb[v] <= ra[u]) & (rb[v] >= na[u]) & (xa[u] != xb[v])
                x, y = xa[u[ok]], xb[v[ok]]
                far = np.bitwise_count(sketches.tables[w][:, row[x]] ^ sketches.tables[w][:, row[y]]).sum(axis=0, dtype=np.int64)
                ok = far <= slack[x] + slack[y]
                yield x[ok].astype(np.int64), y[ok].astype(np.int64)


def merge_lists(key, rec_l, rec_r, n, sketches, t: float, same: bool, place=None):
    """Pairs of records that share a short list and may be similar; key: the lists of each side's entries, place: how many pieces of its record come before each."""
    kl, kr = key
    pl, pr = place if place is not None else (np.zeros(len(kl), np.int64), np.zeros(len(kr), np.int64))
    left = Lists(kl, rec_l, pl, n, t)
    right = left if same else Lists(kr, rec_r, pr, n, t)
    slack = n * ((1 - t) / (1 + t)) + 5e-10
    found = []

    def keep(x, y):
        if len(x):
            found.append(np.unique(np.minimum(x, y) * len(n) + np.maximum(x, y)))

    # the smaller of a pair leads, and its partners are a range of sizes
    for a, b in ((left, right),) if same else ((left, right), (right, left)):
        a = a.leading()
        lo, hi = np.searchsorted(b.at, a.at), np.searchsorted(b.at, a.base | a.reach.astype(np.uint64), side="right")
        width = np.maximum(hi - lo, 0)
        begin = np.flatnonzero(np.concatenate([[True], a.base[1:] != a.base[:-1]])) if len(width) else np.empty(0, np.int64)
        end = np.append(begin[1:], len(width))
        # in a tile, sketches are at most one fold apart
        dense = (np.add.reduceat(width, begin) >= DENSE) & (t >= 0.5) if len(width) else np.empty(0, bool)
        for x, y in _by_entries(a, b, lo, width, np.flatnonzero(np.repeat(~dense, end - begin)), sketches, slack):
            keep(x, y)
        for i, j in zip(begin[dense], end[dense]):
            theirs = slice(np.searchsorted(b.base, a.base[i]), np.searchsorted(b.base, a.base[i], side="right"))
            for x, y in _by_tiles(a, b, slice(i, j), theirs, sketches, t, slack):
                keep(x, y)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p = np.unique(np.concatenate(found))
    return p // len(n), p % len(n)


def _bucket_kernel(t: float, two_sided: bool):
    schema = pa.schema([("id_a", pa.int64()), ("id_b", pa.int64())])

    def run(tab: pa.Table) -> pa.Table:
        rows = {k: tab[k].to_pylist() for k in tab.column_names}
        col = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind)
        each = np.array([len(x) // 8 for x in rows["ids"]])
        ids, side, keys = col("ids", np.int64), col("side", np.uint8), col("keys", np.uint32)
        n_all, size = _widened(rows["n"], each), _widened(rows["lens"], each)
        words = col("sketch", np.uint64)
        place = np.concatenate([[0], np.cumsum((1 << _width(n_all)) >> 6)])
        # a record is one name, size and first word of the sketch: two texts whose names have the same 64 bits stay apart
        same = np.stack([ids.view(np.uint64), n_all.astype(np.uint64), words[place[:-1]]])
        o = np.lexsort(same)
        new = np.concatenate([[True], (same[:, o][:, 1:] != same[:, o][:, :-1]).any(axis=0)]) if len(o) else np.empty(0, bool)
        inv = np.empty(len(o), np.int64)
        inv[o] = np.cumsum(new) - 1
        first = o[new]
        n = n_all[first]
        sketches = Sketches(n, words, place[first])
        rec, sd = np.repeat(inv, size), np.repeat(side, size)
        nth = col("places", np.uint8).astype(np.int64)
        if two_sided:
            l, r = (sd & 1) > 0, (sd & 2) > 0
            a, b = merge_lists((keys[l], keys[r]), rec[l], rec[r], n, sketches, t, False, (nth[l], nth[r]))
        else:
            a, b = merge_lists((keys, keys), rec, rec, n, sketches, t, True, (nth, nth))
        x, y = ids[first][a], ids[first][b]
        return pa.table([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)

    return run


def _prepare(batches):
    for b in batches:
        texts = b.column(1).to_pylist()
        for i, j in stretches(texts):
            codes, off = bare_codes(texts[i:j])
            raw = codes.tobytes()
            bare = [raw[4 * off[k] : 4 * off[k + 1]] for k in range(j - i)]
            names = [xxhash.xxh3_128_digest(x) if len(x) >= 12 else None for x in bare]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(i, j - i),
                    b.column(2).slice(i, j - i),
                    pa.array(names, pa.binary()),
                    pa.array([None if h is None else int.from_bytes(h[:8], "little", signed=True) for h in names], pa.int64()),
                    pa.array([None if h is None else x.decode("utf-32-le", "surrogatepass") for x, h in zip(bare, names)], pa.string()),
                ],
                ["key", "side", "cid", "id", "bare"],
            )


def prepare(df: DataFrame) -> DataFrame:
    """`key` string, `text` string, `side` int -> `key`, `side`, `cid` (16 bytes that name the bare form), `id` (the first 8), `bare`.

    Written once to the shared folder, as the join reads it several times. A text without
    any piece has a null `cid`, `id` and `bare`.
    """
    ship(df.sparkSession)
    rows = df.select("key", "text", F.col("side").cast("int").alias("side"))
    return materialize(rows.mapInArrow(_prepare, "key string, side int, cid binary, id bigint, bare string"), "bare")


def overlaps(left: list, right: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the common, the left and the right piece sets of each pair of bare forms, by binary search in the sorted pieces."""
    da, ga = pieces(left)
    db, gb = pieces(right)
    voc = np.unique(gb)
    k = np.searchsorted(voc, ga)
    known = (k < len(voc)) & (voc[np.minimum(k, max(len(voc) - 1, 0))] == ga if len(voc) else np.zeros(len(ga), bool))
    kb = (db << 32) | np.searchsorted(voc, gb)
    ka = (da[known] << 32) | k[known]
    at = np.searchsorted(kb, ka)
    hit = (at < len(kb)) & (kb[np.minimum(at, max(len(kb) - 1, 0))] == ka if len(kb) else np.zeros(len(ka), bool))
    m = len(left)
    return np.bincount(da[known][hit], minlength=m), np.bincount(da, minlength=m), np.bincount(db, minlength=m)


def _verify(t: float):
    def run(batches):
        for b in batches:
            left, right = b.column("bare_a").to_pylist(), b.column("bare_b").to_pylist()
            for i, j in stretches(left, rows=1024):
                c, na, nb = overlaps(left[i:j], right[i:j])
                union = na + nb - c
                keep = (union > 0) & (c >= t * union - 1e-9)
                idx = pa.array(i + np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("cid_a").take(idx),
                        b.column("cid_b").take(idx),
                        pa.array((c / np.maximum(union, 1))[keep]),
                        pa.array((c / np.maximum(na, 1))[keep]),
                        pa.array((c / np.maximum(nb, 1))[keep]),
                    ],
                    ["cid_a", "cid_b", "similarity", "contained_a", "contained_b"],
                )

    return run


def similar_classes(prep: DataFrame, t: float = 0.8, two_sided: bool = False, buckets: int | None = None, hot: int = 50_000, rounds: int | None = None) -> DataFrame:
    """Pairs of classes (`cid_a` < `cid_b`) of different bare forms with a similarity of at least t.

    prep: from `prepare`; side is 1 for the left, 2 for the right, 3 for both; with
    `two_sided`, only pairs of a left and a right text are looked for. Columns out: cid_a,
    cid_b, similarity, contained_a, contained_b (share of the pieces of a in b, of b in a).
    An empty table gives an empty result.
    """
    spark = prep.sparkSession
    texts = prep.where("bare is not null").select("bare", "side", "cid")
    counts = slot_counts(texts.select("bare"))
    m, size = texts.agg(F.count("*"), F.sum(F.octet_length("bare"))).first()
    total = int(counts.sum())
    mean = total / max(1, m)
    if buckets is None:
        # the postings of the short lists, each sent with name, size and sketch of its text; no more buckets than needed, as texts that
        # go to a bucket for several pieces go there once
        sent = int(total * (1 - t) * 1.1) * (17 + mean / 1.7 / 8)
        buckets = max(8, math.ceil(sent / BUCKET_BYTES))
    if rounds is None:
        # what a text sends grows with the buckets; the buckets are filled in rounds, so that what is shuffled at a time doesn't
        keys = mean * (1 - t) + 1
        homes = buckets * (1 - (1 - 1 / buckets) ** keys)
        rounds = math.ceil(m * (homes * (12 + 1.5 * mean / 1.7 / 8) + 5 * keys) / max(ROUND_BYTES, 1.5 * (size or 0))) or 1
    bc = spark.sparkContext.broadcast(counts)
    kernel = _bucket_kernel(t, two_sided)
    parts = []
    for now in range(rounds):
        sig = texts.mapInArrow(_signatures(bc, t, buckets, hot, rounds, now), SIGNATURE)
        parts.append(materialize(sig.groupBy("bucket").applyInArrow(kernel, "id_a bigint, id_b bigint").distinct(), "candidates"))
    cand = parts[0] if rounds == 1 else materialize(reduce(DataFrame.unionByName, parts).distinct(), "candidates")
    ids = cand.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    ids = materialize(ids, "candidate-ids")
    named = prep.where("bare is not null").select("cid", "bare", "id")
    if fits(ids):
        named = named.join(F.broadcast(ids), "id")
    else:  # copies are gone before the texts meet the candidates
        named = named.groupBy("cid").agg(F.min("bare").alias("bare"), F.max("id").alias("id")).join(ids, "id")
    rep = materialize(named.groupBy("cid").agg(F.min("bare").alias("bare"), F.max("id").alias("id"), F.max("n").alias("n")), "candidate-texts")
    pairs = cand
    for x in "ab":
        side = rep.select(F.col("id").alias(f"id_{x}"), F.col("cid").alias(f"cid_{x}"), F.col("bare").alias(f"bare_{x}"), "n")
        side._lexloom_path = rep._lexloom_path
        pairs = spread_join(pairs, side, [f"id_{x}"], "n").drop("n")
    pairs = pairs.where("cid_a <> cid_b").drop("id_a", "id_b")
    swap = F.col("cid_a") > F.col("cid_b")
    order = [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in ("cid", "bare") for x, y in ("ab", "ba")]
    pairs = pairs.select(*order)
    return materialize(
        pairs.mapInArrow(_verify(t), "cid_a binary, cid_b binary, similarity double, contained_a double, contained_b double"),
        "similar",
    )


def member_pairs(prep: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of different keys (`key_a` < `key_b`) whose classes are equal or linked, with `similarity`.

    Delivered copies of a key count once. Only the keys of linked or shared classes move.
    """
    m = prep.where("cid is not null").select("key", "cid").distinct()
    a, b = (m.select(F.col("cid").alias(f"cid_{x}"), F.col("key").alias(f"k{i}")) for x, i in (("a", 1), ("b", 2)))
    linked = pairs.select("cid_a", "cid_b", "similarity").join(a, "cid_a").join(b, "cid_b").select("k1", "k2", "similarity")
    shared = materialize(m.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select("cid"), "shared-classes")
    two = m.join(small(shared), "cid")
    same = two.select("cid", F.col("key").alias("k1")).join(two.select("cid", F.col("key").alias("k2")), "cid").where("k1 < k2")
    u = linked.unionByName(same.select("k1", "k2", F.lit(1.0).alias("similarity"))).where("k1 <> k2")
    return u.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"), "similarity")


def sides(prep: DataFrame) -> DataFrame:
    """`cid`, `key`, `side` of the records on either side."""
    return prep.where("cid is not null").select("cid", "key", "side").distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """Linked classes in either order, `cid` and `other`, with how much of `cid` the other contains."""
    there = pairs.select(F.col("cid_a").alias("cid"), F.col("cid_b").alias("other"), "similarity", F.col("contained_a").alias("containment"))
    return there.unionByName(pairs.select(F.col("cid_b").alias("cid"), F.col("cid_a").alias("other"), "similarity", F.col("contained_b").alias("containment")))


def mixed_links(m: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links of `pairs` in either order, and of each class that has records on both sides with itself. m: from `sides`."""
    mixed = m.groupBy("cid").agg(F.bit_or("side").alias("both")).where("both = 3").select("cid")
    one = F.lit(1.0)
    links = both_ways(pairs).unionByName(mixed.select("cid", F.col("cid").alias("other"), one.alias("similarity"), one.alias("containment")))
    return materialize(links, "links")


def cross_pairs(prep: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of different keys, `left` of side 1 and `right` of side 2, whose classes are equal or linked, with `similarity`, `containment`.

    Classes that have records of one side only, and no link, never move: copies within a side
    cost no work. Delivered copies of a key count once.
    """
    m = sides(prep)
    links = mixed_links(m, pairs)
    on = lambda bit, cid, key: m.where(F.col("side").bitwiseAND(F.lit(bit)) > 0).select(F.col("cid").alias(cid), F.col("key").alias(key))
    x = on(1, "cid", "left").join(small(links), "cid").join(on(2, "other", "right"), "other")
    return x.where(F.col("left") != F.col("right")).select("left", "right", "similarity", "containment")


def class_links(m: DataFrame, links: DataFrame) -> DataFrame:
    """Links between classes with the least key and the number of records on each side: `cid`, `eval_key`, `n_eval`, `train_key`, `n_train` and the columns of links.

    m: `cid`, `key`, `side` distinct; links: `cid` (held out), `other` (training). No pair of
    records is formed. A class is not linked to itself by one record that is on both sides.
    """
    def of(bit, cid, key, n):
        return m.where(F.col("side").bitwiseAND(F.lit(bit)) > 0).groupBy(F.col("cid").alias(cid)).agg(F.min("key").alias(key), F.count_distinct("key").alias(n))

    x = links.join(of(1, "cid", "eval_key", "n_eval"), "cid").join(of(2, "other", "train_key", "n_train"), "other")
    same = (F.col("cid") == F.col("other")) & (F.col("n_eval") == 1) & (F.col("n_train") == 1) & (F.col("eval_key") == F.col("train_key"))
    return x.where(~same)
