"""N-gram Jaccard self-join by signature trees.

A text's set is its distinct word shingles; two texts link when the Jaccard
similarity of their sets reaches a percentage.  Equal sets are one class from the
start.  To deal classes to workers, a set is parted by token modulo m, a power of
two that follows its size; a part is a token's company.  Two similar sets differ
in at most D = n (100 - p) / p tokens, each of which spoils one part, so of any
D + 1 parts of one they share at least one whole part among the D + 1 that come
first in a fixed order (largest parts first, as few other sets share those).  A
set with too few parts for this sends all of them, and its first D + 1 tokens as
well.  A part's holders are sorted by size, and neighbours close enough in size
belong together and are linked to one of them; classes so connected form a group, a
superset of a component.  Within a chunk of rows a part is sent once for each size,
and its other holders of that size are linked on the spot, so a part in a third of
all texts costs little.  The texts of a batch are split, hashed and parted together,
and holders travel in blocks of arrays.

Within a group, a signature tree holds its classes: a leaf has a bitmap of its
tokens and its size, a node the OR of the bitmaps below and their range of sizes.
Two trees are walked together from the roots, and a pair of nodes is left out when
its sizes are too far apart or the largest overlap that its bitmaps allow is too
small.  For sets A and B with p_A, p_B bits set, |A and B| <= popcount(bits_A &
bits_B) + min(|A| - p_A, |B| - p_B).  What remains at the leaves is verified
exactly.  Pairs within a component already known are left out as well: a link
between them changes nothing, so a dense group costs little more than its size.

A group beyond ``block_docs`` or ``block_shingles`` is split into blocks by size
class and hash: blocks are joined within; their largest components are linked
through hubs; then the classes still outside the group's main component meet all
blocks of fitting size classes.  So no task holds more than two blocks and no link
that joins components is lost.

Defined cases: a text with fewer words than a shingle is one shingle of all; null
and empty texts have an empty set, link with nothing and are their own component;
repeated rows share a component; a class of equal sets is known by its smallest
doc_id: different texts for which that is the same id count as linked by it, texts
that share any other id do not, so rows of one id can be in different components; a
null doc_id takes its class's component, or null if the class has no id; ties do not
arise; texts are read whole, however long; extra columns are never read; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tranche.llm import common as C
from tranche.llm.components import connected_components


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80                # Jaccard similarity that links
    whole: int = 16                  # sets up to this size are parted into single tokens
    chunk: int = 400_000           # parts that a worker gathers before it sends them
    filter_bits: int = 1 << 25       # of a Bloom filter; its size does not follow the data
    signature_bits: int = 1024
    fan: int = 16                    # children of a tree node
    block_docs: int = 16_384         # most of a group that one side of a task holds
    block_shingles: int = 6_000_000
    hubs: int = 32                   # components of a large group that are shown to all its blocks


# --- sets ---------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    return h ^ (h >> np.uint64(29))


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64                               # bytes; words up to this are hashed eight bytes at a time, all at once


def _runs(batch, rows: int = 256, size: int = 1 << 22):
    """An Arrow batch in runs of few rows, and about ``size`` bytes of text if its rows are alike."""
    for some in C.slices(batch, rows):
        yield from C.slices(some, max(1, some.num_rows // (1 + some.column("text").nbytes // size)))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and where each text's words begin; null as empty."""
    text = column.cast(pa.large_binary())
    text = text.fill_null(b"") if text.null_count else text
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    first, size = int(at[0]), int(at[-1] - at[0])
    at = at - first
    if not size:
        return np.zeros(0, np.uint64), at
    raw = np.zeros(size + 8, np.uint8)
    raw[:size] = _LOWER[np.frombuffer(text.buffers()[2], np.uint8)[first:first + size]]
    inside = ~_SPACE[raw[:size]]
    starts, ends, some = inside.copy(), inside.copy(), at[1:] > at[:-1]
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    for mark, edge in ((starts, at[:-1][some]), (ends, at[1:][some] - 1)):           # a word ends with its text
        mark[edge] = inside[edge]
    starts = np.flatnonzero(starts)
    length = np.flatnonzero(ends) + 1 - starts
    eight = np.ndarray(size + 1, "<u8", raw, strides=(1,))                            # the eight bytes from each place on
    h = _mix(length.astype(np.uint64) * _M1 + (eight[starts] & _MASK[np.minimum(length, 8)]))
    more, done = np.flatnonzero((length > 8) & (length <= _LONG)), 8
    while len(more):
        h[more] = _mix(h[more] * _M1 + (eight[starts[more] + done] & _MASK[np.minimum(length[more] - done, 8)]))
        done += 8
        more = more[length[more] > done]
    for k in np.flatnonzero(length > _LONG):
        h[k] = xxhash.xxh64_intdigest(raw[starts[k]:starts[k] + length[k]])
    return h, np.searchsorted(starts, at)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and where each text's begin."""
    code, at = _words(column)
    count = np.diff(at)
    made = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    off = np.concatenate([[0], np.cumsum(made)])
    h = np.full(max(0, len(code) - words + 1), words, np.uint64)
    for i in range(words if len(h) else 0):
        h = _mix(h * _M1 + code[i:len(h) + i])
    x, whole = np.empty(off[-1], np.uint64), np.repeat(count >= words, made)
    x[whole] = h[(np.arange(off[-1]) + np.repeat(at[:-1] - off[:-1], made))[whole]]
    for m in range(1, words):                                 # texts of m words: one shingle of all
        few = np.flatnonzero(count == m)
        one = np.full(len(few), m, np.uint64)
        for i in range(m):
            one = _mix(one * _M1 + code[at[few] + i])
        x[off[few]] = one
    for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
        x[i:j].sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[off[:-1][made > 0]] = True
    return x[new], np.concatenate([[0], np.cumsum(new)])[off]


def _each(x: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    return [x[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist())]


def class_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8").tolist())


def _power(n: np.ndarray, s: Settings) -> np.ndarray:
    """Of two, the power that is the number of parts of sets of n tokens: one and a half to three tokens a part; -1: single tokens."""
    return np.where(n > s.whole, np.frexp(2 * n // 3)[1] - 1, -1)


def _parts_at(x: np.ndarray, off: np.ndarray, power: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set, the hashes of the first ``want`` parts, how many these are, and whether they are fewer.

    A part's tokens agree in their first bits, so they are neighbours in a sorted set.
    Its hash begins with its size: sorted hashes have the largest parts first."""
    place = x >> np.repeat(np.where(power < 0, 0, 64 - power).astype(np.uint64), np.diff(off))
    new = np.ones(len(x), bool)
    new[1:] = place[1:] != place[:-1]
    new[off[:-1][off[1:] > off[:-1]]] = True
    start, at = np.flatnonzero(new), np.concatenate([[0], np.cumsum(new)])[off]
    count = np.diff(at)
    h = np.add.reduceat(_mix(x), start) ^ np.repeat(power, count).astype(np.uint64)
    size = np.minimum(np.diff(start, append=len(x)), 63).astype(np.uint64)
    h = ((np.uint64(63) - size) << np.uint64(58)) | (h >> np.uint64(6))
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        h[i:j].sort()
    kept = np.arange(len(h)) - np.repeat(at[:-1], count) < np.repeat(want, count)
    return h[kept], np.minimum(count, want), count < want


def all_parts(x: np.ndarray, off: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the parts that sets send, and the number of each one's set: similar sets have at least one in common.

    The larger of two similar sets settles how both are parted: a set is parted as its
    own size asks and as the sizes of larger similar sets do."""
    n = np.diff(off)
    want = n * (100 - s.percent) // s.percent + 1
    power, top, few = _power(n, s), _power(100 * n // s.percent, s), np.zeros(len(n), bool)
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def send(which, power):
        some = np.zeros(len(n), bool)
        some[which] = True
        h, count, short = _parts_at(x[np.repeat(some, n)], np.concatenate([[0], np.cumsum(n[which])]), power, want[which])
        out.append((h, np.repeat(which, count)))
        few[which] |= short

    which = np.flatnonzero(n)
    while len(which):
        send(which, power[which])
        power = np.where(power < 0, _power(np.int64(s.whole + 1), s), power + 1)
        which = which[power[which] <= top[which]]
    if few.any():
        send(np.flatnonzero(few), np.full(int(few.sum()), -1))
    return tuple(np.concatenate(y) for y in zip(*out))


def parts(x: np.ndarray, s: Settings) -> np.ndarray:
    """Hashes of the parts that a set sends: similar sets have at least one in common."""
    return all_parts(x, np.array([0, len(x)]), s)[0]


class Bloom:
    """A Bloom filter of 64-bit hashes as a bit array of fixed size; false positives do no harm here."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        m = np.uint64(len(self.bits) * 8 - 1)
        a, b = h & m, (h >> np.uint64(32)) & m
        test = lambda p: (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        return (test(a) & test(b)).astype(bool)


def bloom_of(hashes: DataFrame, bits: int) -> Bloom:
    """The filter of a column ``h`` of longs: bits are combined on the executors, 64 a row."""
    at = lambda h: (h.bitwiseAND(F.lit(bits - 1)))
    places = hashes.select(F.explode(F.array(at(F.col("h")), at(F.shiftrightunsigned("h", 32)))).alias("p"))
    rows = (places.groupBy(F.shiftright("p", 6).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow())
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
    return Bloom(out.view(np.uint8))


def _longs(*columns) -> list:
    return [pa.array(np.ascontiguousarray(c).view(np.int64), pa.int64()) for c in columns]


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


# Rows between the workers are blocks of arrays, so that Spark moves few rows: holders of parts
# (part, class, size), links already found (a, b), signatures (doc_id, both halves of the class, size).
_HOLDERS, _LINKS, _SIGNATURES = 0, 1, 2
_BITS = 12                               # of a part, by which holders are dealt
_BLOCK = "bucket int, kind int, x binary, y binary, z binary, n binary"


def _blocks(bucket: np.ndarray, kind: int, off: np.ndarray, x, y, z, n) -> pa.RecordBatch:
    """Rows ``_BLOCK``: arrays cut at ``off``."""

    def cut(a):
        a = np.ascontiguousarray(a)
        at = (off * a.itemsize if len(a) else off * 0).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(at), pa.py_buffer(a)])

    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), kind), pa.int32()), *map(cut, (x, y, z, n))],
                                      names=["bucket", "kind", "x", "y", "z", "n"])


def _joined(column: pa.Array, kind) -> np.ndarray:
    """The arrays of all rows of a binary column, as one."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else (0, 0)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].copy().view(kind) if data is not None and at[-1] > at[0] else np.zeros(0, kind)


def _by_part(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Holders sorted by part and size."""
    order = np.argsort(h)
    h = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    tied = np.flatnonzero(same[1:] | same[:-1])               # few parts have several holders
    order[tied] = order[tied][np.lexsort((n[order[tied]], h[tied]))]
    return h, c[order], n[order]


def _once(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[tuple, tuple[np.ndarray, np.ndarray]]:
    """Of holders, the first of each part and size, and links of the others to it."""
    h, c, n = _by_part(h, c, n)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (n[1:] != n[:-1])
    first = c[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    return (h[new], c[new], n[new]), _unique_pairs(first[first != c], c[first != c])


def _send(s: Settings):
    """Blocks of every text's signature, and of the parts that it sends if it has an id."""
    none, low = np.zeros(0, np.int64), np.uint64((1 << _BITS) - 1)

    def sent(held: list):
        (h, c, n), (a, b) = _once(*(np.concatenate([x[i] for x in held]) for i in range(3)))
        bucket, first = np.unique(h >> np.uint64(64 - _BITS), return_index=True)
        yield _blocks(bucket, _HOLDERS, np.append(first, len(h)), h, c, none, n)
        if len(a):
            yield _blocks(np.array([int(a[0]) & int(low)]), _LINKS, np.array([0, len(a)]), a, b, none, none)

    def run(batches):
        held, count, seen = [], 0, set()
        for batch in batches:
            for few in _runs(batch):
                x, off = shingle_sets(few.column("text"), s.words)
                keys, n = [class_key(y) for y in _each(x, off)], np.diff(off)
                c1, c2 = (np.array([k[i] for k in keys], np.int64) for i in range(2))
                ids, named = few.column("doc_id").cast("int64"), few.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                yield _blocks(np.array([int(c1[0]) & int(low)]), _SIGNATURES, np.array([0, len(n)]), ids.fill_null(0).to_numpy(), c1, c2,
                              np.where(named, n, -1 - n))
                some = np.array([k not in seen and not seen.add(k) if ok else False for k, ok in zip(keys, named & (n > 0))], bool)
                h, owner = all_parts(x[np.repeat(some, n)], np.concatenate([[0], np.cumsum(n[some])]), s)
                held.append(((h << np.uint64(64 - _BITS)) | (h >> np.uint64(_BITS)), c1[some][owner], n[some][owner].astype(np.int32)))
                count += len(h)
                if count >= s.chunk:
                    yield from sent(held)
                    held, count, seen = [], 0, set()
        if count:
            yield from sent(held)

    return run


def _meet(s: Settings):
    """Of blocks sorted by bucket: signatures, links found before, and links between neighbours of fitting sizes in a part."""

    def rows(link: bool, doc_id, a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), link)), doc_id, *_longs(a, b), n], names=["link", "doc_id", "a", "b", "n"])

    def links(a, b):
        a, b = _unique_pairs(a, b)
        return rows(True, pa.nulls(len(a), pa.int64()), a, b, pa.nulls(len(a), pa.int64()))

    def met(h, c, n):
        h, c, n = _by_part(h, c, n)
        fits = (h[1:] == h[:-1]) & (100 * n[:-1].astype(np.int64) >= s.percent * n[1:].astype(np.int64))
        start = np.flatnonzero(np.concatenate([[True], ~fits])) if len(h) else np.zeros(0, np.int64)
        first = np.repeat(np.minimum.reduceat(c, start) if len(h) else c, np.diff(start, append=len(h)))
        return links(first[first != c], c[first != c])          # each to the least of its neighbours': no long paths

    def run(batches):
        held = [np.zeros(0, t) for t in (np.uint64, np.int64, np.int32)]             # part, class and size of holders in the bucket before
        for batch in batches:
            of = lambda kind: batch.filter(pa.compute.equal(batch.column("kind"), kind))
            found, signed, new = of(_LINKS), of(_SIGNATURES), of(_HOLDERS)
            if signed.num_rows:
                ids, c1, c2, n = (_joined(signed.column(k), np.int64) for k in "xyzn")
                yield rows(False, pa.array(ids, mask=n < 0), c1, c2, pa.array(np.where(n < 0, -1 - n, n)))
            if found.num_rows:
                yield links(*(_joined(found.column(k), np.int64) for k in "xy"))
            if not new.num_rows:
                continue
            held = [np.concatenate([x, _joined(new.column(k), x.dtype)]) for x, k in zip(held, "xyn")]
            last = held[0] >> np.uint64(64 - _BITS) == np.uint64(new.column("bucket")[-1].as_py())
            yield met(*(x[~last] for x in held))
            held = [x[last] for x in held]
            if len(held[0]) > 10 * s.chunk:
                held, pairs = _once(*held)
                yield links(*pairs)
        if len(held[0]):
            yield met(*held)

    return run


def signatures_and_links(documents: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(doc_id, c1, c2, n) of every document, its class and the size of its set, and links between classes; texts are read once.

    Links (a, b) between first halves of class keys connect groups that contain every similar pair of classes.
    Classes that agree in that half only share a group, which is verified like any other.
    """
    sent = documents.select("doc_id", "text").mapInArrow(C.tidy(_send(s)), _BLOCK)
    met = C.stored(sent.repartition("bucket").sortWithinPartitions("bucket")
                   .mapInArrow(C.tidy(_meet(s)), "link boolean, doc_id long, a long, b long, n long"), "signatures")
    return (met.where("NOT link").select("doc_id", F.col("a").alias("c1"), F.col("b").alias("c2"), "n"),
            C.stored(met.where("link").select("a", "b").distinct(), "candidate-links"))


# --- signature trees ----------------------------------------------------------------------------

class Tree:
    """Levels of nodes over sets: OR-ed bitmaps, ranges of sizes, and bits lost to collisions."""

    def __init__(self, sets: list[np.ndarray], s: Settings, height: int = 0):
        sizes = np.array([len(x) for x in sets])
        low = np.array([int(x[0]) for x in sets], np.uint64)
        self.order = np.lexsort((low, np.floor(np.log(sizes) / np.log(100 / s.percent)).astype(int)))
        self.sets = [sets[i] for i in self.order]
        bits = np.zeros((len(sets), s.signature_bits), bool)
        for row, x in zip(bits, self.sets):
            row[(x & np.uint64(s.signature_bits - 1)).astype(np.int64)] = True
        n = sizes[self.order]
        lost = n - bits.sum(axis=1)
        self.levels = [(np.packbits(bits, axis=1).view(np.uint64), n, n, lost)]
        self.fan = s.fan
        while len(self.levels[-1][1]) > 1 or len(self.levels) <= height:
            sig, small, large, lost = self.levels[-1]
            at = np.arange(0, len(small), s.fan)
            self.levels.append((np.bitwise_or.reduceat(sig, at, axis=0), np.minimum.reduceat(small, at),
                                np.maximum.reduceat(large, at), np.maximum.reduceat(lost, at)))

    def children(self, level: int, node: int) -> range:
        return range(node * self.fan, min((node + 1) * self.fan, len(self.levels[level - 1][1])))

    def spread(self, labels: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest label under each node of a level."""
        lo = hi = labels
        for k in range(1, level + 1):
            at = np.arange(0, len(self.levels[k - 1][1]), self.fan)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        return lo, hi


def possible(a, i, b, j, percent: int) -> np.ndarray:
    """Whether pairs of nodes i of level a and j of level b can hold a similar pair."""
    fits = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    common = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][i], b[3][j])
    common = np.minimum(common, np.minimum(a[2][i], b[2][j]))
    return fits & ((100 + percent) * common >= percent * (a[1][i] + b[1][j]))


def tree_links(a_sets: list, b_sets: list | None, s: Settings, a_known=None, b_known=None) -> list[tuple[int, int]]:
    """Pairs (i, j) of similar sets that connect components: of one list, or between two lists.

    ``a_known`` and ``b_known`` are labels of components known before; pairs within one are not looked at.
    """
    a = Tree(a_sets, s)
    b = a if b_sets is None else Tree(b_sets, s, len(a.levels) - 1)
    if len(a.levels) < len(b.levels):
        a = Tree(a_sets, s, len(b.levels) - 1)
    na = len(a.sets)
    known_a = np.arange(na) if a_known is None else np.asarray(a_known)[a.order]
    if b is a:
        labels = known_a.copy()
    else:
        known_b = np.arange(na, na + len(b.sets)) if b_known is None else np.asarray(b_known)[b.order]
        labels = np.concatenate([known_a, known_b])
    off = 0 if b is a else na
    out = []
    top = len(a.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        lo_a, hi_a = a.spread(labels[:na], level)
        lo_b, hi_b = (lo_a, hi_a) if b is a else b.spread(labels[na:], level)
        apart = ~((lo_a[i] == hi_a[i]) & (lo_b[j] == hi_b[j]) & (lo_a[i] == lo_b[j]))
        i, j = i[apart], j[apart]
        keep = possible(a.levels[level], i, b.levels[level], j, s.percent)
        i, j = i[keep], j[keep]
        if level:
            for x, y in zip(i.tolist(), j.tolist()):
                u, v = np.meshgrid(np.array(a.children(level, x)), np.array(b.children(level, y)), indexing="ij")
                u, v = u.ravel(), v.ravel()
                if b is a and x == y:
                    upper = (u < v) if level == 1 else (u <= v)
                    u, v = u[upper], v[upper]
                if len(u):
                    stack.append((level - 1, u, v))
            continue
        for x, y in zip(i.tolist(), j.tolist()):
            if labels[x] == labels[off + y]:
                continue
            p, q = a.sets[x], b.sets[y]
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= s.percent * (len(p) + len(q) - both):
                out.append((int(a.order[x]), int(b.order[y])))
                labels[labels == labels[off + y]] = labels[x]
    return out


def _task_links(s: Settings):
    """Links of one task's rows (task, part, side, doc_id, known, tokens): parts are joined each on its own."""

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).combine_chunks() for c in ("part", "side", "doc_id", "known", "tokens")}
        part, side = cols["part"].to_numpy(), cols["side"].to_numpy()
        ids, known = cols["doc_id"].to_numpy(), cols["known"].to_numpy()
        values, offsets = cols["tokens"].flatten().to_numpy().view(np.uint64), cols["tokens"].offsets.to_numpy()
        offsets = offsets - offsets[0]
        order = np.lexsort((ids, side, part))
        found = []
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
            sets = lambda r: [values[offsets[k]:offsets[k + 1]] for k in r]
            a, b = rows[side[rows] == 0], rows[side[rows] == 1]
            if len(b):
                found += [(ids[a[x]], ids[b[y]]) for x, y in tree_links(sets(a), sets(b), s, known[a], known[b])] if len(a) else []
            elif len(a) > 1:
                found += [(ids[a[x]], ids[a[y]]) for x, y in tree_links(sets(a), None, s, known[a])]
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _join(tasks: DataFrame, s: Settings) -> DataFrame:
    return tasks.groupBy("task").applyInArrow(_task_links(s), "a long, b long")


def similar_links(documents: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, classes, links): links (a, b) between the smallest ids of classes, enough for all components."""
    spark = documents.sparkSession
    C.ship(spark)
    docs = documents.select("doc_id", "text")
    sigs, near = signatures_and_links(docs, s)
    classes = C.stored(sigs.where("n > 0 AND doc_id IS NOT NULL").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # Classes by their smallest id; those that agree in the first half of the key are linked to one another.
    ends = classes.groupBy("c1").agg(F.min("rep").alias("rep"))
    pairs = (near.join(ends.select(F.col("c1").alias("a"), F.col("rep").alias("x")), "a")
             .join(ends.select(F.col("c1").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
             .union(classes.join(ends.withColumnRenamed("rep", "x"), "c1").where("rep != x").select(F.col("x").alias("a"), F.col("rep").alias("b"))))
    groups = connected_components(pairs).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    size_class = F.floor(F.log("n") / F.log(F.lit(100 / s.percent))).cast("int")
    members = C.stored(groups.join(classes, "rep").select("rep", "c1", "c2", "part", "n", size_class.alias("size_class")), "group-members")
    shape = members.groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    shape = C.stored(shape.withColumn("large", (F.col("docs") > s.block_docs) | (F.col("shingles") > s.block_shingles)), "group-sizes")
    total = shape.agg(F.coalesce(F.sum("shingles"), F.lit(0)).alias("n"), F.coalesce(F.max("large"), F.lit(False)).alias("large")).first()

    # The sets of the members, from the texts once more; the filter keeps other texts' sets from being sent.
    wanted = bloom_of(members.select(F.xxhash64("rep").alias("h")), s.filter_bits)
    sent = spark.sparkContext.broadcast(wanted)

    def sets_of(batches):
        some = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(some.has(batch.column("h").to_numpy().view(np.uint64))))
            for few in _runs(batch):
                x, off = shingle_sets(few.column("text"), s.words)
                keys = [class_key(y) for y in _each(x, off)]
                yield pa.RecordBatch.from_arrays(
                    [few.column("doc_id").cast("int64"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(off, pa.int32()), *_longs(x))], names=["rep", "c1", "c2", "tokens"])

    found = (docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
             .mapInArrow(C.tidy(sets_of), "rep long, c1 long, c2 long, tokens array<long>"))
    wide = members.join(shape.select("part", "large", "docs", "shingles"), "part")
    full = found.join(_near(wide), ["rep", "c1", "c2"]).dropDuplicates(["rep", "c1", "c2"])

    # Small groups: several in a task, by hash of the group.
    bins = int(max(1, -(-int(total["n"]) // 500_000)))
    zero = F.lit(0)
    if not total["large"]:
        small = full
    else:
        full = C.stored(full, "group-sets")
        small = full.where(~F.col("large"))
    tasks = small.select(F.pmod(F.xxhash64("part"), F.lit(bins)).alias("task"), "part", zero.alias("side"),
                         F.col("rep").alias("doc_id"), F.col("rep").alias("known"), "tokens")
    links = C.stored(_join(tasks, s), "similar-links")
    if total["large"]:
        links = links.union(_large_groups(full.where("large"), s))
    return sigs, classes, links


def _near(df: DataFrame) -> DataFrame:
    """Broadcast up to 300,000 narrow rows; more are joined by shuffling."""
    return F.broadcast(df) if df.count() <= 300_000 else df


def _large_groups(full: DataFrame, s: Settings) -> DataFrame:
    """Links of groups too large for a task (rows: rep, part, n, size_class, tokens).

    Blocks, components and pairs of blocks are worked out on narrow rows; the sets
    are read from the shared folder and sent only to the tasks that need them.
    """
    fits = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / s.block_docs), F.ceil(F.sum("n") / s.block_shingles)).cast("int")
    sets = full.select("rep", "tokens")
    narrow = full.select("rep", "part", "n", "size_class")
    blocks = narrow.groupBy("part", "size_class").agg(fits().alias("blocks"))
    narrow = C.stored(narrow.join(blocks, ["part", "size_class"])
                      .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "large-groups")
    block = ["part", "size_class", "block"]

    def join(tasks: DataFrame) -> DataFrame:
        """Links of tasks (key, side, rep, known)."""
        rows = sets.join(_near(C.stored(tasks, "large-tasks")), "rep")
        return C.stored(_join(rows.select(F.col("key").alias("task"), F.col("key").alias("part"), F.col("side"),
                                          F.col("rep").alias("doc_id"), "known", "tokens"), s), "large-links")

    def task(side: int, key: list[str], known: str):
        hashed = F.xxhash64(*[F.col(k).cast("long") for k in key])       # one type on both sides
        return [hashed.alias("key"), F.lit(side).alias("side"), "rep", F.col(known).cast("long").alias("known")]

    # 1. Within blocks.
    links = join(narrow.select(*task(0, block, "rep")))

    def labelled(links):
        found = connected_components(links).select(F.col("node").alias("rep"), "component")
        return C.stored(narrow.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "large-labelled")

    around = F.explode(F.array(F.col("size_class") - 1, F.col("size_class"), F.col("size_class") + 1))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # 2. The smallest members of the largest components meet the blocks of fitting sizes.
    marked = labelled(links)
    sizes = marked.groupBy("part", "size_class", "component").agg(F.count(F.lit(1)).alias("d"), F.min("rep").alias("rep"))
    rank = F.row_number().over(Window.partitionBy("part", "size_class").orderBy(F.desc("d"), "component"))
    hubs = sizes.withColumn("r", rank).where(F.col("r") <= s.hubs)
    shown = (hubs.withColumn("to", around).select("part", F.col("to").alias("size_class"), "rep", "component")
             .join(blocks, ["part", "size_class"]).withColumn("block", each("blocks")))
    links = links.union(join(marked.select(*task(0, block, "component")).union(shown.select(*task(1, block, "component")))))

    # 3. What is still outside the main component of its group meets every block of fitting sizes.
    marked = labelled(links)
    main = (marked.groupBy("part", "component").agg(F.count(F.lit(1)).alias("d")).groupBy("part")
            .agg(F.max_by("component", F.struct("d", "component")).alias("main")))
    outside = marked.join(main, "part").where("component != main").select("rep", "part", "n", "size_class", "component")
    lots = outside.groupBy("part", "size_class").agg(fits().alias("lots"))
    key = ["part", "from_class", "lot", "size_class", "block"]
    left = (outside.join(lots, ["part", "size_class"]).withColumn("lot", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("lots")))
            .withColumn("to", around).select("rep", "part", "component", "lot", F.col("size_class").alias("from_class"), F.col("to").alias("size_class"))
            .join(blocks, ["part", "size_class"]).withColumn("block", each("blocks")))
    right = (marked.join(lots.select("part", F.col("size_class").alias("from_class"), "lots"), "part")
             .where(F.abs(F.col("from_class") - F.col("size_class")) <= 1).withColumn("lot", each("lots")))
    return links.union(join(left.select(*task(0, key, "component")).union(right.select(*task(1, key, "component")))))


def near_duplicates(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_shingles, component_id, and its class (c1, c2)."""
    sigs, classes, links = similar_links(documents, s)
    found = connected_components(links).select(F.col("node").alias("rep"), "component")
    named = classes.join(found, "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    return (sigs.join(named, ["c1", "c2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "c1", "c2"))
