"""Substring deduplication: seed and extend on winnowed anchors.

A text's words are hashed, and winnowing picks anchors: of every `length - seed + 1` consecutive seeds (hashes of `seed` words) the smallest,
the rightmost of equals. Any run of `length` words thus holds an anchor that depends on those words alone, so two equal runs share it at
the same place. Documents meet on their anchors: an anchor is sent with what a match around it needs to extend both ways, a
fingerprint for each window of `length` words that elected it (consecutive windows, about eight for an anchor); two occurrences
extend to `length` words wherever these agree. Windows that begin elsewhere first are repeats; their union over neighbouring anchors is
the maximal repeat, and its words are removed.

Order is (doc_id, position); the first occurrence of a window stays. Equal windows of one task are settled there and sent once, so what a
passage costs grows with the tasks that hold it, not with its copies. Anchors, found repeats and texts travel as packed blocks,
a row for each bucket, and every step works on bounded chunks.

Defined results: a null or empty text has no words and keeps the empty text; rows of a null doc_id come after all others; rows that share
both doc_id and text are one document that doesn't repeat itself, and each gets the same result; rows that share only their doc_id come in
the order of their texts' hashes; other columns are ignored. Fingerprints have 64 bits and are compared only under anchors that agree in 32 bits
and in their bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import batch, hashed_words, mapped, pieces, slices, windows

NO_ID = np.iinfo(np.int64).max


def elected(h: np.ndarray, starts: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of `length` words inside one document: its first word, its anchor's hash and its fingerprint.

    h: hashes of all words in a row; starts: where documents begin, with the end at last.
    """
    if len(h) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    seeds, prints = windows(h, seed), windows(h, length)
    reach = length - seed + 1
    least = seeds[: len(prints)].copy()
    for k in range(1, reach):
        np.minimum(least, seeds[k : k + len(prints)], out=least)
    fits = np.ones(len(h), bool)
    for k in range(1, length):  # the last length - 1 words of a document begin no window
        at = starts[1:] - k
        fits[at[at >= starts[:-1]]] = False
    first = np.flatnonzero(fits[: len(prints)])
    return first, least[first], prints[first]


def runs_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers."""
    if not len(first):
        return first, first
    cut = np.flatnonzero(np.diff(first) != 1)
    return first[np.append(0, cut + 1)], first[np.append(cut, len(first) - 1)]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, which the shuffle's codec shrinks well."""
    return b"".join(np.array([len(a)], np.int64).tobytes() + np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)


def _unpack(b: bytes, *kinds) -> list[np.ndarray]:
    at, out = 0, []
    for kind in kinds:
        n, size = int(np.frombuffer(b, np.int64, 1, at)[0]), np.dtype(kind).itemsize
        planes = np.frombuffer(b, np.uint8, n * size, at + 8).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 8 + n * size
    return out


ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
ROW_SQL = "bucket int, kind int, data binary"
WINDOWS, REPEATS, TEXT = 0, 1, 2
W_KINDS = (np.int64, np.uint32, np.int32, np.uint16, np.uint32, np.uint64)  # of anchors: doc_id, text hash, first window, windows, half the hash; of all windows in turn: fingerprint
R_KINDS = (np.int64, np.uint32, np.int32, np.int32)  # doc_id, text hash, first word of the first window, of the last


def _document_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _blocks(kind: int, bucket: np.ndarray, *arrays: np.ndarray):
    """Rows of ROW: the arrays dealt to buckets."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    data, at = [], []
    arrays = [a[order] for a in arrays]
    for i, j in zip(np.append(0, cuts), np.append(cuts, len(b))):
        if j > i:
            at.append(int(b[i]))
            data.append(_pack(*(a[i:j] for a in arrays)))
    return batch(ROW, bucket=np.array(at, np.int32), kind=np.full(len(at), kind, np.int32), data=data)


def _anchor_blocks(buckets: int, doc_id, doc_text, at, anchor, fingerprint):
    """Rows of ROW: windows, in order of document and place, gathered by anchor and dealt by it."""
    cut = np.ones(len(at), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (doc_id[1:] != doc_id[:-1]) | (doc_text[1:] != doc_text[:-1])
    first = np.flatnonzero(cut)
    many = np.diff(np.append(first, len(at)))
    bucket = (anchor[first] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    data, to = [], []
    for i, j in zip(np.append(0, cuts), np.append(cuts, len(order))):
        mine = order[i:j]
        f, n = first[mine], many[mine]
        each = np.repeat(f - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        to.append(int(bucket[mine[0]]))
        data.append(_pack(doc_id[f], doc_text[f], at[f].astype(np.int32), n.astype(np.uint16), (anchor[f] >> np.uint64(32)).astype(np.uint32), fingerprint[each]))
    return batch(ROW, bucket=np.array(to, np.int32), kind=np.full(len(to), WINDOWS, np.int32), data=data)


def _all_windows(data: bytes) -> list[np.ndarray]:
    doc_id, doc_text, at, n, anchor, fingerprint = _unpack(data, *W_KINDS)
    nth = np.arange(len(fingerprint)) - np.repeat(np.append(0, np.cumsum(n, dtype=np.int64)[:-1]), n)
    return [np.repeat(doc_id, n), np.repeat(doc_text, n), (np.repeat(at, n) + nth).astype(np.int32), np.repeat(anchor, n), fingerprint]


def _first_of(order_by: tuple, *key: np.ndarray) -> np.ndarray:
    """True where an element is the first of its key by order_by (least significant last)."""
    order = np.lexsort((*order_by[::-1], *key[::-1]))
    same = np.ones(len(order), bool)
    if len(order):
        same[0] = False
    for k in key:
        s = k[order]
        same[1:] &= s[1:] == s[:-1]
    out = np.zeros(len(order), bool)
    out[order] = ~same
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 20, seed: int = 6, chunk_words: int = 1_500_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by blanks) for every row of docs (doc_id, text)."""
    buckets = pieces(spark) * 2
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")

    def anchors(batches):
        ids, texts, parts, sizes, held = [], [], [], [], 0

        def settle():
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            first, anchor, fingerprint = elected(np.concatenate(parts), starts, length, seed)
            doc = np.searchsorted(starts, first, side="right") - 1
            doc_id, doc_text, at = np.concatenate(ids)[doc], np.concatenate(texts)[doc], (first - starts[doc]).astype(np.int32)
            # Rows that share id and text are one document; the first of their windows stands for all.
            mine = _first_of((doc_id, doc_text, at), anchor, fingerprint)
            lead = np.flatnonzero(mine)
            if len(lead):
                yield _anchor_blocks(buckets, doc_id[lead], doc_text[lead], at[lead], anchor[lead], fingerprint[lead])
            rest = np.flatnonzero(~mine)
            if len(rest):
                # A repeated row's windows equal the leading ones in place too: those are no repeats.
                order = np.lexsort((at, doc_text, doc_id, fingerprint, anchor))
                leader = np.zeros(len(order), np.int64)
                leader[order] = np.maximum.accumulate(np.where(mine[order], np.arange(len(order)), 0))
                leader = order[leader]
                rest = rest[~((doc_id[rest] == doc_id[leader[rest]]) & (doc_text[rest] == doc_text[leader[rest]]) & (at[rest] == at[leader[rest]]))]
            if len(rest):
                yield repeats(doc_id[rest], doc_text[rest], at[rest])

        for b in slices(batches):
            h, starts = hashed_words(b.column(1))
            ids.append(_known(b.column(0)))
            texts.append(_text_hashes(b.column(1)))
            parts.append(h)
            sizes.append(np.diff(starts))
            held += len(h)
            if held >= chunk_words:
                yield from settle()
                ids, texts, parts, sizes, held = [], [], [], [], 0
        if parts:
            yield from settle()

    def repeats(doc_id, doc_text, at):
        """Repeated windows as stretches, dealt by document."""
        order = np.lexsort((at, doc_text, doc_id))
        doc_id, doc_text, at = doc_id[order], doc_text[order], at[order].astype(np.int64)
        go_on = (doc_id[1:] == doc_id[:-1]) & (doc_text[1:] == doc_text[:-1]) & (at[1:] <= at[:-1] + 1)
        cut = np.flatnonzero(~go_on) + 1
        i, j = np.append(0, cut), np.append(cut, len(at)) - 1
        return _blocks(REPEATS, _document_bucket(doc_id[i], buckets), doc_id[i], doc_text[i], at[i].astype(np.int32), at[j].astype(np.int32))

    def meet(batches):
        """Windows of one bucket at a time; found repeats pass through."""
        bucket, held = None, []

        def settle():
            doc_id, doc_text, at, anchor, fingerprint = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((at, doc_text, doc_id, fingerprint, anchor))
            a, f = anchor[order], fingerprint[order]
            again = np.flatnonzero((a[1:] == a[:-1]) & (f[1:] == f[:-1])) + 1
            if len(again):
                d, x, p = doc_id[order], doc_text[order], at[order]
                fresh = np.ones(len(order), bool)
                fresh[again] = False
                leader = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))[again]
                again = again[~((d[again] == d[leader]) & (x[again] == x[leader]) & (p[again] == p[leader]))]
                if len(again):
                    yield repeats(d[again], x[again], p[again])

        for b in batches:
            for to, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if kind == REPEATS:
                    yield batch(ROW, bucket=[to], kind=[kind], data=[data.as_py()])
                    continue
                if to != bucket and held:
                    yield from settle()
                    held = []
                bucket = to
                held.append(_all_windows(data.as_py()))
        if held:
            yield from settle()

    def texts_of(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            known, digests = _known(b.column(0)), _text_hashes(b.column(1))
            data = [
                np.array([k], np.int64).tobytes() + np.array([d], np.uint32).tobytes() + bytes([i is None]) + (press.compress(t.encode("utf-8", "surrogatepass")) if t else b"")
                for k, d, i, t in zip(known, digests, b.column(0).to_pylist(), b.column(1).to_pylist())
            ]
            yield batch(ROW, bucket=_document_bucket(known, buckets), kind=np.full(len(data), TEXT, np.int32), data=data)

    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut_out(batches):
        """Of each bucket the repeats come first, then the texts."""
        unpress = zstandard.ZstdDecompressor()
        bucket, found, table = None, [], {}
        rows = {n: [] for n in result.names}
        size = 0
        for b in batches:
            for to, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if to != bucket:
                    bucket, found, table = to, [], None
                data = data.as_py()
                if kind == REPEATS:
                    found.append(_unpack(data, *R_KINDS))
                    continue
                if table is None:
                    table = _by_document(found)
                    found = []
                doc_id, digest, none, t = int(np.frombuffer(data, np.int64, 1)[0]), int(np.frombuffer(data, np.uint32, 1, 8)[0]), data[12], data[13:]
                words = unpress.decompress(t).split() if t else []  # bytes split where WORD does
                gone = table(doc_id, digest, len(words), length)
                rows["doc_id"].append(None if none else doc_id)
                rows["n_words"].append(len(words))
                rows["n_removed"].append(0 if gone is None else int(gone.sum()))
                rows["kept"].append(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8", "replace"))
                size += len(rows["kept"][-1])
                if size > 4 << 20 or len(rows["kept"]) >= 5000:
                    yield batch(result, **rows)
                    rows, size = {n: [] for n in result.names}, 0
        if rows["doc_id"]:
            yield batch(result, **rows)

    sent = mapped(rows, anchors, ROW_SQL)
    found = mapped(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), meet, ROW_SQL)
    both = found.unionAll(mapped(rows, texts_of, ROW_SQL))
    return mapped(both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind"), cut_out, "doc_id long, n_words long, n_removed long, kept string")


def _by_document(found: list[list[np.ndarray]]):
    """(doc_id, text hash, words, length) -> which words are covered, or None."""
    if not found:
        return lambda *_: None
    doc_id, digest, first, last = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((digest, doc_id))
    doc_id, digest, first, last = doc_id[order], digest[order], first[order], last[order]

    def covered(d, x, n, length):
        i, j = np.searchsorted(doc_id, [d, d], side="left")[0], np.searchsorted(doc_id, d, side="right")
        mine = digest[i:j] == np.uint32(x)
        if not mine.any():
            return None
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, first[i:j][mine], 1)
        np.add.at(steps, np.minimum(last[i:j][mine] + length, n), -1)
        return np.cumsum(steps[:-1]) > 0

    return covered


def _known(ids: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(ids, NO_ID).to_numpy(zero_copy_only=False)


def _text_hashes(texts: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(t.as_buffer()) if t.is_valid else 0 for t in texts), np.uint32, len(texts))
