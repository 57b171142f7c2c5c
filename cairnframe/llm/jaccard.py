"""N-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct `k`-word shingles (A-Z in lower case; with fewer words the whole sequence is one shingle).
Two documents link when 100 * |intersection| >= 80 * |union|; the result is each document's component of links. Equal sets are one
node, so copies never multiply.

1. One pass gives each document's set size and fingerprint, and the shingles common to many documents (counted in chunks by lossy
   counting, so that every text counts; at most sizes / `common` of them, a bound free of the corpus).
2. Linked sets share a shingle in their prefixes under one global order of shingles: common ones last, then by hash. A prefix is
   the first |x| - ceil(4|x|/5) + 1 shingles, and of the smaller of the two |x| - ceil(8|x|/9) + 1 suffice. Prefixes meet by shingle;
   nodes that meet form groups. No other pair can link.
3. A sparse first round of candidates, a spanning forest of the groups in each bucket and a few random neighbours in large groups, is
   pruned by the trees' bitmaps, verified on whole sets and gives first components.
4. Groups that still hold several components are searched by signature trees: items carry token bitmaps; hierarchical nodes hold the OR
   of their bitmaps, the range of sizes and the slack (elements that bitmaps can't show). A dual traversal descends only into pairs of
   nodes that are not wholly in one component, whose size ranges fit, and whose maximum possible overlap, popcount(a & b) + least slack,
   reaches 4/9 of the sizes. Surviving pairs are verified on whole sets, and components joined.

Each of steps 2 to 4 loses no link. Groups over `block` items are searched as pairs of blocks, so no task holds an unbounded group.

Defined results: null, empty and blank texts have an empty set and are components of their own; of rows with the same doc_id each row gets a
result, and the smallest doc_id names a component; rows of a null doc_id take part and name a component only if no other row
of it has an id (then the component is null); other columns are ignored. Shingles are compared by 64-bit hashes (48 bits within a
pair), sets by 64-bit fingerprints of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, batch, hashed_words, mapped, mix, pieces, slices, unused, windows

LEAST_BITS = 1024


def need(s, t):
    """The least overlap of linked sets of sizes s and t."""
    return -(-4 * (s + t) // 9)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in a row, in order of text and hash, and the text of each."""
    h, starts = hashed_words(texts, lower=True)
    many = np.diff(starts)
    s = windows(h, k)
    doc = np.repeat(np.arange(len(many)), many)[: len(s)]
    whole = np.arange(len(s)) + k <= starts[1:][doc] if len(s) else np.empty(0, bool)
    s, doc = s[whole], doc[whole]
    short = np.flatnonzero((many > 0) & (many < k))
    if len(short):
        s = np.concatenate([s, np.array([windows(h[starts[d] : starts[d + 1]], int(many[d]))[0] ^ np.uint64(many[d]) for d in short], np.uint64)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[fresh], doc[fresh]


def fingerprints(s: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit fingerprint of each of n sets."""
    size = np.bincount(doc, minlength=n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
    ends = np.cumsum(size)
    return size, mix((total[ends] - total[ends - size]) ^ mix(size.astype(np.uint64) + np.uint64(1)))


def bits_for(size: np.ndarray) -> np.ndarray:
    """A bitmap's bits: a power of two, two for each element at least, so linked sets' bitmaps differ by a factor of two at most."""
    return LEAST_BITS << np.ceil(np.log2(np.maximum(2 * size / LEAST_BITS, 1))).astype(np.int64)


def bitmaps_of(s: np.ndarray, doc: np.ndarray, n: int) -> list[bytes]:
    bits = bits_for(np.bincount(doc, minlength=n))
    ends = np.cumsum(bits)
    flat = np.zeros(int(ends[-1]) if n else 0, bool)
    flat[(ends - bits)[doc] + ((s >> np.uint64(20)) & (bits - 1)[doc].astype(np.uint64)).astype(np.int64)] = True
    packed = np.packbits(flat)
    return [packed[(e - b) // 8 : e // 8].tobytes() for b, e in zip(bits.tolist(), ends.tolist())]


def folded(bitmaps: np.ndarray) -> np.ndarray:
    """The bitmaps of half as many bits."""
    half = bitmaps.shape[1] // 2
    return bitmaps[:, :half] | bitmaps[:, half:]


def may_link(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Whether the maximum possible overlap of pairs of items suffices."""
    spare = np.minimum(sizes_a - np.bitwise_count(a).sum(1).astype(np.int64), sizes_b - np.bitwise_count(b).sum(1).astype(np.int64))
    return np.bitwise_count(a & b).sum(1).astype(np.int64) + spare >= need(sizes_a, sizes_b)


class Tree:
    """A signature tree over items (bitmaps, sizes, components), `fan` children to a node, in the order given."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, components: np.ndarray, fan: int = 8):
        self.fan = fan
        slack = sizes - np.bitwise_count(bitmaps).sum(1).astype(np.int64)
        self.levels = [(bitmaps, sizes, sizes, slack, components)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, spare, comp = self.levels[-1]
            at = np.arange(0, len(low), fan)
            lo, hi = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at), np.where(lo == hi, lo, -1)))

    def _may_link(self, level: int, other: Tree, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, al, ah, asl, ac = self.levels[level]
        b, bl, bh, bsl, bc = other.levels[level]
        ok = ~((ac[i] == bc[j]) & (ac[i] >= 0)) & (5 * ah[i] >= 4 * bl[j]) & (5 * bh[j] >= 4 * al[i])
        at = np.flatnonzero(ok)
        overlap = np.bitwise_count(a[i[at]] & b[j[at]]).sum(1).astype(np.int64) + np.minimum(asl[i[at]], bsl[j[at]])
        ok[at] = overlap >= need(al[i[at]], bl[j[at]])
        return ok

    def pairs(self, other: Tree, most: int = 200_000):
        """(i, j) of items of the two trees that may link and aren't in one component; i < j where both are one tree."""
        top = max(len(self.levels), len(other.levels)) - 1
        for t in (self, other):
            while len(t.levels) <= top:
                t.levels.append(t.levels[-1])
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            ok = self._may_link(level, other, i, j)
            if self is other and level == 0:
                ok &= i < j
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            f, n, m = self.fan, len(self.levels[level - 1][1]), len(other.levels[level - 1][1])
            # A tree that was lower than the other has its root on several levels.
            ci = i[:, None] if self.levels[level] is self.levels[level - 1] else i[:, None] * f + np.arange(f)
            cj = j[:, None] if other.levels[level] is other.levels[level - 1] else j[:, None] * f + np.arange(f)
            step = max(1, most // (ci.shape[1] * cj.shape[1]))
            for k in range(0, len(i), step):
                x, y = np.broadcast_arrays(ci[k : k + step, :, None], cj[k : k + step, None, :])
                x, y = x.reshape(-1), y.reshape(-1)
                fits = (x < n) & (y < m) & (x <= y if self is other else True)
                todo.append((level - 1, x[fits], y[fits]))


def _first_pass(docs: DataFrame, k: int, least_local: int) -> DataFrame:
    """kind 0: doc_id, fingerprint, size and bitmap of each row; kind 1: shingle and count, where a chunk holds it often."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary())])

    def run(batches):
        held, ids, size = [], [np.empty(0, np.uint64)], 0

        def often():
            s, n = np.unique(np.concatenate(held), return_counts=True)
            at = n >= least_local
            none = int(at.sum())
            return batch(schema, kind=np.ones(none, np.int32), doc_id=pa.nulls(none, pa.int64()), key=s[at].view(np.int64), n=n[at], bitmap=pa.nulls(none, pa.binary()))

        for b in slices(batches):
            s, doc = shingle_sets(b.column(1), k)
            sizes, prints = fingerprints(s, doc, b.num_rows)
            yield batch(schema, kind=np.zeros(b.num_rows, np.int32), doc_id=b.column(0), key=prints.view(np.int64), n=sizes.astype(np.int64), bitmap=bitmaps_of(s, doc, b.num_rows))
            fresh = np.zeros(b.num_rows, bool)
            fresh[np.unique(prints, return_index=True)[1]] = True
            fresh &= ~np.isin(prints, np.concatenate(ids))  # a copy in this chunk counts once
            held.append(s[fresh[doc]])
            ids.append(prints[fresh])
            size += len(held[-1])
            if size > 2_000_000:
                yield often()
                held, ids, size = [], [np.empty(0, np.uint64)], 0
        if held:
            yield often()

    return mapped(docs, run, "kind int, doc_id long, key long, n long, bitmap binary")


BLOB = "bucket int, data binary"
BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def _pack(token: np.ndarray, node: np.ndarray, size: np.ndarray) -> bytes:
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in (token.astype(np.uint32), node.astype(np.uint64), size.astype(np.uint32))]
    return b"".join(planes)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, out, at = len(data) // 16, [], 0
    for kind, width in ((np.uint32, 4), (np.uint64, 8), (np.uint32, 4)):
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return tuple(out)


def _prefixes(docs: DataFrame, k: int, common, buckets: int) -> DataFrame:
    """Packed (shingle, node, 2 * size + whether within the smaller's prefix), dealt by shingle."""

    def run(batches):
        often = common.value
        for b in slices(batches):
            s, doc = shingle_sets(b.column(1), k)
            if not len(s):
                continue
            sizes, prints = fingerprints(s, doc, b.num_rows)
            lead = np.zeros(b.num_rows, bool)
            lead[np.unique(prints, return_index=True)[1]] = True
            s, doc = s[lead[doc]], doc[lead[doc]]
            if len(often):
                at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                late = often[at] == s
                order = np.lexsort((s, late, doc))
                s = s[order]
            size = sizes[doc]
            rank = np.arange(len(s)) - np.searchsorted(doc, doc)
            probe, index = size - -(-4 * size // 5) + 1, size - -(-8 * size // 9) + 1
            at = np.flatnonzero(rank < probe)
            token, node, code = mix(s[at]), prints[doc[at]], 2 * size[at] + (rank[at] < index[at])
            bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            to, data = [], []
            for i, j in zip(np.append(0, cuts), np.append(cuts, len(order))):
                mine = order[i:j]
                to.append(int(bucket[mine[0]]))
                data.append(_pack(token[mine], node[mine], code[mine]))
            yield batch(BLOB_SCHEMA, bucket=np.array(to, np.int32), data=data)

    return mapped(docs, run, BLOB)


#: Groups of at least so many nodes get candidates in so many random orders as well.
LARGE, ROUNDS = 128, 3
GROUPED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64())])


def _groups(blobs: DataFrame, block: int) -> DataFrame:
    """kind 0: candidate pairs (a, b) of a spanning forest in each bucket; kind 1: group (bucket), node a, its blocks b, size code."""

    def run(batches):
        bucket, held = None, []

        def settle(at):
            token, node, code = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((node, code >> np.uint32(1), token))
            token, node, code = token[order], node[order], code[order]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, code = token[fresh], node[fresh], code[fresh]
            group = np.cumsum(np.append(0, token[1:] != token[:-1])) if len(token) else token.astype(np.int64)
            size, index = code.astype(np.int64) >> 1, (code & np.uint32(1)).astype(np.int64)
            keep = _needed(group, size, index)
            node, size, group = node[keep], size[keep], group[keep]
            if not len(node):
                return
            group = np.cumsum(np.append(0, group[1:] != group[:-1]))
            many = np.bincount(group)
            # Neighbours by size in each group; of equal pairs one; then a forest of them.
            near = np.flatnonzero((group[1:] == group[:-1]) & (5 * size[:-1] >= 4 * size[1:]))
            pairs = _ordered_pairs(node[near], node[near + 1])
            found = [pairs[_forest(pairs)]]
            # In large groups also neighbours in some random orders, the same in all groups: near copies of one text, of which each links
            # with some only, then come together before the trees compare what is left.
            large = np.flatnonzero(np.repeat(many >= LARGE, many))
            for seed in range(ROUNDS if len(large) else 0):
                at_ = large[np.lexsort((mix(node[large] ^ np.uint64(seed + 1)), group[large]))]
                x, y = at_[:-1], at_[1:]
                fits = (group[x] == group[y]) & (5 * size[x] >= 4 * size[y]) & (5 * size[y] >= 4 * size[x])
                found.append(_ordered_pairs(node[x[fits]], node[y[fits]]))
            pairs = np.unique(np.concatenate(found), axis=0)
            if len(pairs):
                none = np.zeros(len(pairs), np.int64)
                yield batch(GROUPED, kind=none.astype(np.int32), bucket=none + at, a=np.ascontiguousarray(pairs[:, 0]).view(np.int64), b=np.ascontiguousarray(pairs[:, 1]).view(np.int64), size=none)
            # Groups of the same nodes are one.
            names, first = np.unique(group, return_index=True)
            last = np.append(first[1:], len(group))
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(node), dtype=np.uint64)])
            members = mix((total[last] - total[first]) ^ (last - first).astype(np.uint64))
            _, one = np.unique(members, return_index=True)
            chosen = np.zeros(len(names), bool)
            chosen[one] = True
            row = np.repeat(chosen, last - first)
            blocks = np.repeat(-(-(last - first) // block), last - first)
            yield batch(GROUPED, kind=np.ones(row.sum(), np.int32), bucket=np.repeat(members, last - first)[row].view(np.int64), a=node[row].view(np.int64), b=blocks[row].astype(np.int64), size=size[row])

        for b in batches:
            for to, data in zip(b.column(0).to_pylist(), b.column(1)):
                if to != bucket and held:
                    yield from settle(bucket)
                    held = []
                bucket = to
                held.append(_unpack(data.as_py()))
        if held:
            yield from settle(bucket)

    return mapped(blobs, run, "kind int, bucket long, a long, b long, size long")


def _needed(group: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Which members, sorted by group and size, can be in a linked pair of their group.

    Sizes must fit, and the smaller of the two must have the group's shingle in its smaller prefix (index).
    """
    key = group << 32 | size
    from_own, to_larger = np.searchsorted(key, key), np.searchsorted(key, group << 32 | 5 * size // 4, side="right")
    from_smaller, to_own = np.searchsorted(key, group << 32 | -(-4 * size // 5)), np.searchsorted(key, key, side="right")
    indexed = np.append(0, np.cumsum(index))
    return (index > 0) & (to_larger - from_own > 1) | (indexed[to_own] - indexed[from_smaller] - index > 0)


def _ordered_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Which pairs join two trees, in order."""
    names, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape).tolist()
    parent = list(range(len(names)))
    taken = []
    for n, (x, y) in enumerate(at):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[y] = x
            taken.append(n)
    return np.array(taken, np.int64)


SETS = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])


def _sets(docs: DataFrame, k: int, wanted) -> DataFrame:
    """node, size and the set, for documents that pass the Bloom filter of wanted nodes (and maybe others)."""

    def run(batches):
        bits = wanted.value
        for b in slices(batches):
            s, doc = shingle_sets(b.column(1), k)
            sizes, prints = fingerprints(s, doc, b.num_rows)
            pick = np.zeros(b.num_rows, bool)
            pick[np.unique(prints, return_index=True)[1]] = True
            pick &= sizes > 0
            for word, mask in _bloom_places(prints, len(bits)):
                pick &= (bits[word] & mask) != 0
            chosen = np.flatnonzero(pick)
            if not len(chosen):
                continue
            ends = np.cumsum(sizes)
            data = [s[ends[d] - sizes[d] : ends[d]].view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes() for d in chosen]
            yield batch(SETS, node=prints[chosen].view(np.int64), size=sizes[chosen].astype(np.int64), data=data)

    return mapped(docs, run, "node long, size long, data binary")


def _set_of(data: bytes) -> np.ndarray:
    """The 48 upper bits of the set's hashes, in order."""
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view(np.uint64).reshape(-1)


def _bloom_places(nodes: np.ndarray, words: int):
    for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        h = mix(nodes ^ np.uint64(seed))
        yield (h % np.uint64(words)).astype(np.int64), np.uint64(1) << (h >> np.uint64(58))


def _bloom(spark: SparkSession, nodes: DataFrame, words: int = 1 << 20) -> np.ndarray:
    """A Bloom filter of words * 64 bits, whatever the number of nodes; only its words come to the driver."""
    schema = pa.schema([("word", pa.int64()), ("mask", pa.int64())])

    def run(batches):
        for b in batches:
            n = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for word, mask in _bloom_places(n, words):
                yield batch(schema, word=word, mask=mask.view(np.int64))

    found = mapped(nodes, run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return bits


def _sided(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with the table's columns for both, as <column>_a and <column>_b."""
    one = table.select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    two = table.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    both = pairs.join(one, "a").join(two, "b").where("5 * size_a >= 4 * size_b and 5 * size_b >= 4 * size_a")
    return both.select("a", "b", *(f"{c}_{side}" for c in columns for side in "ab"))


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that their bitmaps let link, as leaves of a signature tree would."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            sa, sb = (b.column(k).to_numpy() for k in (2, 3))
            ma, mb = (np.array([*b.column(k).to_pylist(), None], object)[:-1] for k in (4, 5))
            wa, wb = bits_for(sa), bits_for(sb)
            ok = np.zeros(len(sa), bool)
            for x, y in {*zip(wa.tolist(), wb.tolist())}:
                at = np.flatnonzero((wa == x) & (wb == y))
                one, two = (np.frombuffer(b"".join(m[at]), np.uint64).reshape(len(at), -1) for m in (ma, mb))
                while one.shape[1] > two.shape[1]:
                    one = folded(one)
                while two.shape[1] > one.shape[1]:
                    two = folded(two)
                ok[at] = may_link(one, two, sa[at], sb[at])
            ok = pa.array(ok)
            yield batch(schema, a=b.column(0).filter(ok), b=b.column(1).filter(ok))

    return mapped(_sided(pairs, nodes, "size", "bitmap"), run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch_ in batches:
            a, b, sa, sb, da, db = (batch_.column(k) for k in range(6))
            sa, sb = sa.to_numpy(), sb.to_numpy()
            ok = [len(np.intersect1d(_set_of(x.as_py()), _set_of(y.as_py()), assume_unique=True)) >= n for x, y, n in zip(da, db, need(sa, sb))]
            ok = pa.array(ok, pa.bool_())
            yield batch(schema, a=a.filter(ok), b=b.filter(ok))

    return mapped(_sided(pairs, sets, "size", "data"), run, "a long, b long")


def components(spark: SparkSession, links: DataFrame, store: Stored) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b): alternating large and small stars."""
    edges = store.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.withColumnRenamed("m", "v"))
        edges = store.write(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
        store.drop(store.n - 1)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def join(spark: SparkSession, docs: DataFrame, k: int = 5, common: float = 5e-4, block: int = 4096) -> DataFrame:
    """doc_id, n_shingles, node, component (its smallest node; null without shingles), component_id for every row of docs (doc_id, text)."""
    store, buckets = Stored(spark, "jaccard"), pieces(spark)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    first = store.write(_first_pass(rows, k, 4))
    mine = first.where("kind = 0").select("doc_id", F.col("key").alias("node"), F.col("n").alias("n_shingles"))
    total = mine.count()
    often = first.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(16.0, common * total)).select("key").toArrow()
    sent = spark.sparkContext.broadcast(np.sort(often.column("key").to_numpy().view(np.uint64)))
    blobs = _prefixes(rows.select("doc_id", "text"), k, sent, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    grouped = store.write(_groups(blobs, block))
    pairs = grouped.where("kind = 0").select("a", "b").distinct()
    groups = grouped.where("kind = 1").select(F.col("bucket").alias("g"), F.col("a").alias("node"), F.col("b").alias("blocks"))
    members = groups.select("node").distinct()
    nodes = store.write(first.where("kind = 0").select(F.col("key").alias("node"), F.col("n").alias("size"), "bitmap").join(members, "node", "left_semi").dropDuplicates(["node"]))

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
        return store.write(_sets(rows, k, spark.sparkContext.broadcast(_bloom(spark, ends))).dropDuplicates(["node"]))

    pairs = store.write(_plausible(pairs, nodes))
    sets = sets_of(pairs)
    links = store.write(_verified(pairs, sets))
    found = store.write(components(spark, links, store))
    more = store.write(_tree_pairs(groups, nodes, found, buckets))
    if more.limit(1).count():
        ends = more.select(F.col("a").alias("node")).unionAll(more.select("b")).distinct()
        if ends.join(sets, "node", "left_anti").limit(1).count():
            sets = sets_of(more)
        links = links.unionAll(store.write(_verified(more, sets)))
        found = store.write(components(spark, links, store))
    named = mine.join(found, "node", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    ids = named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(ids, "component", "left").select("doc_id", "n_shingles", "node", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of docs without those that a linked row stands for: of each component the row of its smallest doc_id stays. All columns stay.

    Where no doc_id is null or repeated, rows leave by doc_id; else rows are told apart by doc_id and set, and of those that agree in
    both one stays. Rows with an empty set are linked with nothing and all stay.
    """
    found = Stored(spark, "jaccard-kept").write(join(spark, docs, k))
    n, ids = found.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if n == ids:
        gone = found.where("n_shingles > 0 and component_id <> doc_id").select(F.col("doc_id").alias("gone"))
        # A Bloom filter of fixed size lets most rows stay where they are; the exact join sees those it can't tell.
        bits = spark.sparkContext.broadcast(_bloom(spark, gone))

        @F.pandas_udf("boolean")
        def suspect(ids: pd.Series) -> pd.Series:
            out = np.ones(len(ids), bool)
            for word, mask in _bloom_places(ids.to_numpy().astype(np.int64).view(np.uint64), len(bits.value)):
                out &= (bits.value[word] & mask) != 0
            return pd.Series(out)

        hit = suspect(docs["doc_id"].cast("long"))
        return docs.where(~hit).unionAll(docs.where(hit).join(gone, docs["doc_id"].cast("long") == F.col("gone"), "left_anti"))
    node = unused(docs, "node")
    schema = pa.schema([("node", pa.int64())])
    at = docs.columns.index("text") if "text" in docs.columns else 0

    def run(batches):
        for b in slices(batches):
            s, doc = shingle_sets(b.column(at).cast(pa.string()), k)
            prints = fingerprints(s, doc, b.num_rows)[1].view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, schema.field(0).type)], names=[*b.schema.names, node])

    tagged = mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(node, T.LongType())]))
    full = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("d"), "node")).alias("least"))
    keep = found.where("n_shingles > 0").join(full, "component").where("coalesce(doc_id, 9223372036854775807) = least.d and node = least.node")
    keep = keep.select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node")).distinct()
    one = tagged.join(keep, tagged["doc_id"].cast("long").eqNullSafe(F.col("kept_id")) & (tagged[node] == F.col("kept_node"))).dropDuplicates(["kept_id", "kept_node"]).select(*[tagged[c] for c in docs.columns])
    none = found.where("n_shingles = 0").select("node").distinct().withColumnRenamed("node", "none_node")
    return one.unionAll(tagged.join(none, tagged[node] == F.col("none_node"), "left_semi").select(*docs.columns))


def _tree_pairs(groups: DataFrame, nodes: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """Pairs, each once, that the trees of groups with several components let through."""
    labelled = groups.distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("g")
    items = labelled.join(several, "g")
    # A pair that meets in many groups is given once, in the least of them.
    listed = items.groupBy("node").agg(F.collect_list("g").alias("met"))
    items = items.join(nodes.join(listed, "node"), "node")
    # A group of more than one block is searched as all pairs of its blocks.
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))
    items = items.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    items = items.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "size", "bitmap", "met")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        task, held = None, []

        def settle():
            own, node, component, size = (np.concatenate([h[k] for h in held]) for k in range(4))
            bitmap, met = (np.concatenate([h[k] for h in held]) for k in (4, 5))
            order = np.lexsort((node, size, component))
            own, node, component, size, bitmap, met = own[order], node[order], component[order], size[order], bitmap[order], met[order]
            component = np.unique(component, return_inverse=True)[1].astype(np.int64)
            width = bits_for(size)
            sides = []  # for each side: bits -> nodes, tree, and tree of the folded bitmaps
            for block in dict.fromkeys(task[1:]):
                side = {}
                for w in np.unique(width[own == block]).tolist():
                    at = np.flatnonzero((own == block) & (width == w))
                    bits = np.frombuffer(b"".join(bitmap[at]), np.uint64).reshape(len(at), -1)
                    side[w] = (node[at], [frozenset(m) for m in met[at]]), Tree(bits, size[at], component[at]), Tree(folded(bits), size[at], component[at])
                sides.append(side)
            one, two = sides[0], sides[-1]
            for w, (items_a, tree, tree_half) in one.items():
                if w in two:
                    yield from emit(items_a, two[w][0], tree, two[w][1])
                if 2 * w in two:
                    yield from emit(items_a, two[2 * w][0], tree, two[2 * w][2])
                if w // 2 in two and two is not one:
                    yield from emit(items_a, two[w // 2][0], tree_half, two[w // 2][1])

        def emit(items_a, items_b, tree_a, tree_b):
            for i, j in tree_a.pairs(tree_b):
                here = np.fromiter((min(items_a[1][x] & items_b[1][y]) == task[0] for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
                x, y = items_a[0][i[here]], items_b[0][j[here]]
                yield batch(schema, a=np.minimum(x, y), b=np.maximum(x, y))

        for b in batches:
            g, i, j, own, node, component, size = (b.column(k).to_numpy() for k in range(7))
            bits, met = (np.array([*b.column(k).to_pylist(), None], object)[:-1] for k in (7, 8))
            key = np.stack([g, i, j], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for x, y in zip(np.append(0, cuts), np.append(cuts, len(g))):
                now = tuple(key[x].tolist())
                if now != task and held:
                    yield from settle()
                    held = []
                task = now
                held.append((own[x:y], node[x:y], component[x:y], size[x:y], bits[x:y], met[x:y]))
        if held:
            yield from settle()

    return mapped(items.repartition(buckets, "g", "i", "j").sortWithinPartitions("g", "i", "j"), run, "a long, b long")
