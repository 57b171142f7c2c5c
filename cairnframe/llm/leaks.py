"""Benchmark decontamination with SimHash windows.

An item's words make shingles of `shingle` words (a shorter item is one shingle), weighted by how often they occur in it. An item and a
window of a document's words are similar by the weighted Jaccard similarity of their shingles; a document leaks an item if a window
reaches `least`.

1. Windows. All lengths that can be similar to an item are taken (from `least` times its shingles to as many divided by `least`: an edit
   may add or drop words). A window is passed over if fewer than `least` of its shingles occur in any item, or if its first or last one
   occurs in none: it can't be similar, or the window without that shingle is more so. This loses nothing.
2. Each window gets a SimHash of 128 bits over its weighted shingles, and the multi-index names the items for it: the bits form `blocks`
   blocks, and two fingerprints within `radius` agree in some block up to radius // blocks bits, so looking up each block's value and all values
   that near finds every item within the radius, and no other way leads to an item.
3. What the index names is verified by the exact similarity; the best window counts, the first and shortest of equals.

The one place where a similar window may be lost is the radius. Fingerprints of similarity 0.8 differ in about 19 of 128 bits (standard
deviation 4; about 24 in items of five shingles, since ties are frequent there), and a leak has many windows, so a radius of 32
loses next to none; tests measure it.

Text is compared in lower case (A-Z), as words without the blanks between them. An item costs about 12 bytes for each shingle and 16 for its
fingerprint, 4 for each block. The items are broadcast only while their texts hold at most `most_bytes`; beyond that they are taken in blocks of
that size, one pass over the documents for each.

Defined results: null and empty texts leak nothing, null or empty items are leaked by nothing; repeated items are reported for each
item_id; repeated rows of documents are reported for each row; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, hashed_words, mapped, mix, slices, windows

BITS = 128
_SALTS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x2127599BF4325C37))


def simhashes(s: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int = 8192) -> np.ndarray:
    """A row of BITS booleans for each run of shingles s[begin : begin + size]; begin ascends."""
    out = np.zeros((len(begin), BITS), bool)
    i = 0
    while i < len(begin):  # runs that begin within `most` places
        j = int(np.searchsorted(begin, begin[i] + most))
        lo, hi = int(begin[i]), int((begin[i:j] + size[i:j]).max())
        hashes = np.stack([mix(s[lo:hi] ^ salt) for salt in _SALTS], 1)
        ones = np.zeros((hi - lo + 1, BITS), np.int32)
        np.cumsum(np.unpackbits(hashes.view(np.uint8), axis=1), axis=0, dtype=np.int32, out=ones[1:])
        for k in range(i, j, most):
            b, n = begin[k : min(k + most, j)] - lo, size[k : min(k + most, j)]
            out[k : k + len(b)] = 2 * (ones[b + n] - ones[b]) > n[:, None]
        i = j
    return out


class Index:
    """Items whose shingles have `width` words: the shingles with their weights, and fingerprints in multi-index Hamming blocks."""

    def __init__(self, sets: list[np.ndarray], radius: int, blocks: int):
        self.radius = radius
        self.total = np.array([len(s) for s in sets], np.int64)
        every, item = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.total)
        ends = np.cumsum(self.total)
        bits = simhashes(every, ends - self.total, self.total)
        self.prints = np.packbits(bits, axis=1).view(np.uint64)
        order = np.lexsort((every, item))
        every, item = every[order], item[order]
        fresh = np.ones(len(every), bool)
        fresh[1:] = (every[1:] != every[:-1]) | (item[1:] != item[:-1])
        at = np.flatnonzero(fresh)
        self.shingles, self.weights = every[at], np.diff(np.append(at, len(every))).astype(np.int32)
        self.first = np.searchsorted(item[at], np.arange(len(sets) + 1))
        self.known = np.unique(every)
        edges = [BITS * k // blocks for k in range(blocks + 1)]
        self.blocks = []  # of each: from, to, flips of up to radius // blocks bits, where each value's items begin, items by value
        for a, b in zip(edges, edges[1:]):
            flips = [sum(1 << x for x in c) for r in range(radius // blocks + 1) for c in combinations(range(b - a), r)]
            value = self._values(bits, a, b)
            by = np.argsort(value, kind="stable")
            self.blocks.append((a, b, np.array(flips, np.int32), np.searchsorted(value[by], np.arange((1 << b - a) + 1)).astype(np.int32), by.astype(np.int32)))

    @staticmethod
    def _values(bits: np.ndarray, a: int, b: int) -> np.ndarray:
        return bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.int32))

    def within(self, bits: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(row of bits, item) for every item within the radius of a row, in order."""
        if not len(bits):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        prints = np.packbits(bits, axis=1).view(np.uint64)
        _, lead, same = np.unique(mix(prints[:, 0]) ^ prints[:, 1], return_index=True, return_inverse=True)  # equal rows are asked for once
        bits, prints, n = bits[lead], prints[lead], len(self.prints)
        codes = [np.empty(0, np.int64)]
        for a, b, flips, start, by in self.blocks:
            value = self._values(bits, a, b)
            step = max(1, most // (len(flips) + n))
            for k in range(0, len(bits), step):
                near = value[k : k + step, None] ^ flips
                lo, many = start[near], start[near + 1]
                many -= lo
                row = np.repeat(np.arange(k, k + len(near)), many.sum(1))
                lo, many = lo.reshape(-1), many.reshape(-1)
                some = np.flatnonzero(many)
                lo, many = lo[some], many[some]
                at = np.repeat(lo - (np.cumsum(many) - many), many)
                item = by[at + np.arange(len(at))]
                close = np.bitwise_count(prints[row] ^ self.prints[item]).sum(1) <= self.radius
                codes.append(row[close] * n + item[close])
        row, item = np.divmod(np.unique(np.concatenate(codes)), n)
        # Back to the rows asked for.
        first, end = np.searchsorted(row, same), np.searchsorted(row, same, side="right")
        many = end - first
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(np.arange(len(same)), many), item[at]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        a, b = self.first[item], self.first[item + 1]
        own, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(self.shingles[a:b], own), b - a - 1)
        shared = int(np.minimum(n, self.weights[a:b][at])[self.shingles[a:b][at] == own].sum())
        return shared / (len(window) + int(self.total[item]) - shared)

    def candidates(self, s: np.ndarray, text: np.ndarray, least: float):
        """(first shingle, shingles) of the windows that may be similar to some item, in parts, in order.

        s: shingles of all texts in a row; text: the text of each, -1 where a shingle lies in two.
        """
        sizes = {m for t in set(self.total.tolist()) for m in range(max(1, int(np.ceil(least * t - 1e-9))), int(np.floor(t / least + 1e-9)) + 1)}
        longest = max(sizes)
        right = np.zeros(longest + 1, bool)
        right[list(sizes)] = True
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        hit = np.flatnonzero((self.known[at] == s) & (text >= 0))
        last = np.minimum(np.searchsorted(hit, hit + min(sizes) - 1), len(hit))  # hits that may close a window, from here
        end = np.minimum(np.searchsorted(hit, hit + longest), np.searchsorted(text[hit], text[hit], side="right"))
        many = np.maximum(end - last, 0)
        for k in range(0, len(hit), 4096):
            n = many[k : k + 4096]
            i = np.repeat(np.arange(k, k + len(n)), n)
            j = np.repeat(last[k : k + 4096] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            m = hit[j] - hit[i] + 1
            fits = right[m] & (j - i + 1 >= least * m - 1e-9)
            if fits.any():
                yield hit[i[fits]], m[fits]


class Items:
    """The items' texts (equal ones once), in an index for each width of shingles."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int, radius: int, blocks: int):
        h, starts = hashed_words(pa.array([t for _, t in rows], pa.string()), lower=True)
        texts: dict[bytes, list[int]] = {}
        for (i, _), a, b in zip(rows, starts, starts[1:]):
            if b > a:
                texts.setdefault(h[a:b].tobytes(), []).append(i)
        by: dict[int, list] = {}
        for words, ids in texts.items():
            words = np.frombuffer(words, np.uint64)
            k = min(shingle, len(words))
            by.setdefault(k, []).append((windows(words, k), tuple(sorted(ids))))
        self.widths = {k: (Index([s for s, _ in own], radius, blocks), [ids for _, ids in own]) for k, own in sorted(by.items())}

    def leaked(self, texts: pa.Array, least: float) -> list[list[tuple[tuple, float, int, int]]]:
        """For each text: (item ids, similarity, first word, words) of the best window of each item that it leaks."""
        out: list[list] = [[] for _ in range(len(texts))]
        h, starts = hashed_words(texts, lower=True)
        many = np.diff(starts)
        for k, (index, ids) in self.widths.items():
            s = windows(h, k)
            text = np.repeat(np.arange(len(many)), many)[: len(s)]
            text[np.arange(len(s)) + k > starts[1:][text]] = -1
            text_at = np.maximum.accumulate(text) if len(text) else text
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for begin, size in index.candidates(s, text, least):
                window, item = index.within(simhashes(s, begin, size))
                # The nearest in size come first, so that an exact copy ends the search.
                bound = np.minimum(size[window], index.total[item]) / np.maximum(size[window], index.total[item])
                for n in np.lexsort((window, -bound)).tolist():
                    w, key = window[n], (int(text_at[begin[window[n]]]), int(item[n]))
                    had = best.get(key)
                    if bound[n] < least - 1e-9 or had and bound[n] < -had[0]:
                        continue
                    b, m = int(begin[w]), int(size[w])
                    v = index.similarity(s[b : b + m], key[1])
                    if v >= least - 1e-12 and (had is None or (-v, b, m) < had):
                        best[key] = -v, b, m
            for (d, n), (v, b, m) in sorted(best.items()):
                out[d].append((ids[n], -v, b - int(starts[d]), m + k - 1))
        return out


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("n_words", pa.int64())])


def _item_blocks(items: DataFrame, most_bytes: int):
    """The items in blocks of at most most_bytes of text (or one item)."""
    block, size = [], 0
    for i, text in items.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("text is not null and item_id is not null").toLocalIterator(prefetchPartitions=False):
        if block and size + len(text) > most_bytes:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += len(text)
    yield block


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 32, blocks: int = 11, most_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words for each item that a row of docs (doc_id, text) leaks."""
    rows, out = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), None
    for block in _item_blocks(items, most_bytes):
        sent = spark.sparkContext.broadcast(Items(block, shingle, radius, blocks))

        def run(batches, sent=sent):
            known = sent.value
            for b in slices(batches):
                found = []
                for i, leaked in zip(b.column(0).to_pylist(), known.leaked(b.column(1), least)):
                    for ids, v, at, size in leaked:
                        found += [(i, item, v, at, size) for item in ids]
                yield batch(FOUND, **{name: [r[k] for r in found] for k, name in enumerate(FOUND.names)})

        part = mapped(rows, run, "doc_id long, item_id long, similarity double, start long, n_words long")
        out = part if out is None else out.unionAll(part)
    return out


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 32, blocks: int = 11, most_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs that leak no item. All columns stay."""
    for block in _item_blocks(items, most_bytes):
        sent, schema = spark.sparkContext.broadcast(Items(block, shingle, radius, blocks)), docs.schema

        def run(batches, sent=sent):
            known = sent.value
            for b in slices(batches, text=text):
                kept = [not leaked for leaked in known.leaked(b.column(b.schema.get_field_index(text)), least)]
                yield b.filter(pa.array(kept, pa.bool_()))

        docs = mapped(docs, run, schema)
    return docs
