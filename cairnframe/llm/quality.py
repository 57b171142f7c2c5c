"""Quality rules with an n-gram perplexity band for each language.

The model reads words, and grows with the corpus: each language has the counts of all its words and all pairs of neighbouring words, by 64-bit
hashes of the exact text. A word's probability after another is (c(pair) + PAIRS * p(word)) / (c(other) + PAIRS), a Dirichlet prior;
p(word) mixes its share of the language's words with NOVEL of its spelling. A text's own counts are taken off before it is scored, so
what only it says is new to it. In scripts written without blanks each character is a word.

No task and not the driver holds the counts. Rows travel in compressed chunks of about `part_bytes` of text; a chunk sends its distinct n-grams
once, sorted and Rice coded, dealt by hash to buckets; a bucket adds them up and answers each chunk, in the order of its keys, how often all other chunks
have them. Chunks and buckets grow with the input. Keys have 6 bits more than the corpus has bytes, and words have several bytes, so that about one lookup in a thousand finds
another n-gram's count.

Spelling and blanks are priced by characters: letters fold to 26 classes (accents and case fall away; letters of other scripts are dealt over the
same classes), and blanks, digits, sentence marks, symbols and the text's start have one class each. Spark counts the 4-grams of all
texts; the driver turns them into an interpolated modified Kneser-Ney model kept in sorted hash arrays, at most 32**4 4-grams for each of `slots`
model slots, which is broadcast. The languages with the most documents have one slot each, all others share the last four (a null language
is a language of its own).

A document's log perplexity is its negative log probability for each of its characters. For each language, the band lies around the median m of
all its documents that pass the base rules. A mean over n characters strays as c / sqrt(n), and c is measured: 1.4826 times the median
of |log perplexity - m| * sqrt(n) over the same documents. The band of a document is m plus and minus the larger of `least`
and `width` * c / sqrt(n); documents outside are rejected, above as noise and below as repetition.

Base rules and counts: see the contract in `base`. Defined results: a null text counts as empty; an empty text fails the base rules and has
a null perplexity; repeated rows are separate rows; other columns are ignored; a language without documents passing the base rules
has no band and rejects nothing by it.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, WORD, Stored, batch, give_back, mapped, mix, powers, slices

ORDER, BITS = 4, 5
#: The weight of a word's own probability after another, in pairs, and that of its spelling in its own probability.
PAIRS, NOVEL = 32.0, 0.01
SYMBOLS = "#*$%&|<>"
START, SPACE, DIGIT, MARK, SYMBOL, OTHER = 0, 27, 28, 29, 30, 31


def _classes() -> np.ndarray:
    out = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        c = chr(cp)
        base = unicodedata.normalize("NFD", c)[0].lower()
        if "a" <= base <= "z":
            out[cp] = ord(base) - 96
        elif c.isalpha():
            out[cp] = 1 + cp % 26
        elif c.isspace():
            out[cp] = SPACE
        elif c.isdigit():
            out[cp] = DIGIT
        elif c in ".,;:!?'\"()-":
            out[cp] = MARK
        else:
            out[cp] = SYMBOL if cp < 128 else OTHER
    return out


def packed(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed 4-grams of all texts in a row, and where each text's begin (with the end at last)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = classes[np.minimum(points, 0xFFFF)]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.concatenate([[0], ends])
    codes = c.astype(np.uint32)
    for back in range(1, ORDER):
        before = np.zeros(len(c), np.uint32)
        before[back:] = c[: max(0, len(c) - back)]
        for k in range(back):  # what would reach over a text's start is START
            at = starts[:-1] + k
            before[at[at < ends]] = START
        codes |= before << np.uint32(BITS * back)
    return codes, starts


class Slots(dict):
    """The model slot of each language: one of its own for those with the most documents, by crc32 one of the last four for others."""

    def __init__(self, own: list[str | None], slots: int):
        super().__init__((lang, n) for n, lang in enumerate(own))
        self.slots = slots

    def __missing__(self, lang: str | None) -> int:
        return self.slots - 1 - zlib.crc32((lang or "").encode()) % min(4, self.slots)


def slots_of(docs: DataFrame, slots: int, lang: str = "lang") -> Slots:
    """The driver gets at most `slots` languages."""
    top = docs.groupBy(F.col(lang).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max(0, slots - 4))
    return Slots([r["lang"] for r in top.collect()], slots)


def count(docs: DataFrame, slots: Slots, text: str = "text", lang: str = "lang") -> DataFrame:
    """slot, code, n: how often each 4-gram occurs in all texts. Each task sends a 4-gram once."""
    schema = pa.schema([("slot", pa.int32()), ("code", pa.int32()), ("n", pa.int64())])

    def run(batches):
        classes, seen = _classes(), {}
        for b in slices(batches):
            by: dict[int, list[str]] = {}
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    by.setdefault(slots[l], []).append(t)
            for s, texts in by.items():
                n = np.bincount(packed(texts, classes)[0], minlength=1 << BITS * ORDER)
                seen[s] = seen[s] + n if s in seen else n
        for s, n in seen.items():
            at = np.flatnonzero(n)
            yield batch(schema, slot=np.full(len(at), s, np.int32), code=at.astype(np.int32), n=n[at])

    found = mapped(docs.selectExpr(f"cast(`{text}` as string) text", f"cast(`{lang}` as string) lang"), run, "slot int, code int, n long")
    return found.groupBy("slot", "code").agg(F.sum("n").alias("n"))


def discounts(c: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    n = np.bincount(np.minimum(c, 5), minlength=6).astype(float)
    if not (n[1] and n[2] and n[3]):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[1] / (n[1] + 2 * n[2])
    return np.clip([0.0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]], 0.0, [0.0, 0.999, 1.999, 2.999])


def key(slot: int, kind: int, codes: np.ndarray) -> np.ndarray:
    """kind: 2 * order for an n-gram's log probability, one more for a context's log weight."""
    return mix(codes.astype(np.uint64) | np.uint64((slot << 8 | kind) << 32))


class KneserNey:
    """Log probabilities and back-off weights of all orders in one sorted hash array."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        keys, values = [], []
        for slot, (codes, n) in counts.items():
            grams = {ORDER: (codes.astype(np.int64), n.astype(np.int64))}
            for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different classes come before
                lower, times = np.unique(grams[k + 1][0] & ((1 << BITS * k) - 1), return_counts=True)
                grams[k] = lower, times
            below = np.full(1, 1 / (1 << BITS))
            below_at = np.zeros(1, np.int64)
            for k in range(1, ORDER + 1):
                g, c = grams[k]
                d = discounts(c)
                context, where = np.unique(g >> BITS, return_inverse=True)
                total = np.bincount(where, c)
                weight = np.bincount(where, d[np.minimum(c, 3)]) / total
                shorter = g & ((1 << BITS * (k - 1)) - 1)
                p = (c - d[np.minimum(c, 3)]) / total[where] + weight[where] * below[np.searchsorted(below_at, shorter)]
                keys += [key(slot, 2 * k, g), key(slot, 2 * k + 1, context)]
                values += [np.log(p), np.log(np.maximum(weight, 1e-12))]
                below, below_at = p, g
        keys, values = np.concatenate(keys or [np.empty(0, np.uint64)]), np.concatenate(values or [np.empty(0)])
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def find(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(k), np.float32), np.zeros(len(k), bool)
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return self.values[at], self.keys[at] == k

    def log_p(self, slot: int, codes: np.ndarray) -> np.ndarray:
        """ln p of each packed 4-gram's last class after the others."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            own = codes[left].astype(np.int64) & ((1 << BITS * k) - 1)
            v, there = self.find(key(slot, 2 * k, own))
            out[left[there]] += v[there]
            left, own = left[~there], own[~there]
            if not len(left):
                return out
            v, there = self.find(key(slot, 2 * k + 1, own >> BITS))
            out[left[there]] += v[there]
        out[left] -= np.log(1 << BITS)
        return out


def train(docs: DataFrame, slots: Slots, text: str = "text", lang: str = "lang") -> KneserNey:
    table = count(docs, slots, text, lang).toArrow()  # at most 32**4 rows for each slot
    slot, code, n = (table.column(k).to_numpy() for k in ("slot", "code", "n"))
    counts = {}
    for s in np.unique(slot):
        mine = slot == s
        order = np.argsort(code[mine])
        counts[int(s)] = code[mine][order], n[mine][order]
    return KneserNey(counts)


def base(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, lines with a word that equal an earlier line, words in 3-word windows found twice or more."""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)] if "\n" in text else []
    repeated = 0
    if n > 3:
        ids: dict[str, int] = {}
        i = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        if len(ids) < 2_000_000:
            w = (i[:-2] * len(ids) + i[1:-1]) * len(ids) + i[2:]
        else:
            w = np.unique(np.stack([i[:-2], i[1:-1], i[2:]], 1), axis=0, return_inverse=True)[1].reshape(-1)
        order = np.argsort(w, kind="stable")
        ws = w[order]
        same = ws[1:] == ws[:-1]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("log_perplexity", pa.float64())])


def _alone() -> np.ndarray:
    """Characters of scripts written without blanks, which are words of their own."""
    out = np.zeros(0x40000, bool)
    for first, end in ((0xE00, 0xF00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000)):
        out[first:end] = True
    return out


def words_of(texts: list[str], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and 64-bit hash of the words of all texts in a row, and the text of each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    ink = ~((points == 32) | (points >= 9) & (points <= 13))
    single = alone[np.minimum(points, len(alone) - 1)]
    cut = np.ones(len(points) + 1, bool)  # between i - 1 and i
    cut[1:-1] = ~ink[1:] | ~ink[:-1] | single[1:] | single[:-1]
    starts = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    cut[starts] = True
    begin, end = np.flatnonzero(cut[:-1] & ink), np.flatnonzero(cut[1:] & ink) + 1
    up, down = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = mix(((total[end] - total[begin]) * down[begin]) ^ ((end - begin).astype(np.uint64) << np.uint64(40)))
    return begin, end, h, np.searchsorted(starts, begin, side="right")


def seed_of(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0" if lang is None else b"=" + lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Grams:
    """The keys of a chunk's rows: for each word that of its language, of the word before, of the word and of both; a text's start is a word before.

    Keys have `bits` bits: enough for the whole corpus, so that what is sent is short.
    """

    def __init__(self, texts: list[str], langs: list[str | None], bits: int = 64, most: int = 1 << 20):
        alone, parts, i = _alone(), [], 0
        while i < len(texts):  # about `most` characters at once
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= most):
                size += len(texts[j])
                j += 1
            _, _, h, of = words_of(texts[i:j], alone)
            parts.append((h, of + i))
            i = j
        h = np.concatenate([p[0] for p in parts] or [np.empty(0, np.uint64)])
        self.of = np.concatenate([p[1] for p in parts] or [np.empty(0, np.int64)])
        known = {l: seed_of(l) for l in set(langs)}
        self.lang = mix(np.array([known[l] for l in langs], np.uint64))
        seed, spare = self.lang[self.of], np.uint64(64 - bits)
        word = mix(h + seed)
        self.first = np.ones(len(h), bool)
        self.first[1:] = self.of[1:] != self.of[:-1]
        before = np.concatenate([np.zeros(1, np.uint64), word[:-1]])[: len(h)]
        before[self.first] = mix(seed[self.first] + np.uint64(1))
        self.word, self.before, self.pair = word >> spare, before >> spare, mix(before * ODD + word) >> spare
        self.lang = self.lang >> spare

    def _all(self) -> np.ndarray:
        return np.concatenate([self.lang[self.of], self.before[self.first], self.word, self.pair])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct keys, and how often each occurs."""
        return np.unique(self._all(), return_counts=True)

    def counted(self, elsewhere: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word, how often all texts but its own have its language's words, the word before, the word and the pair.

        elsewhere: how often other chunks have the distinct keys (None: never).
        """
        keys, where, here = np.unique(self._all(), return_inverse=True, return_counts=True)
        total = here if elsewhere is None else here + elsewhere
        n, starts = len(self.of), int(self.first.sum())
        at = np.split(where, [n, n + starts, 2 * n + starts])
        own_word = self._own(self.word)
        before = np.empty(n, np.int64)
        before[1:] = total[at[2][:-1]] - own_word[:-1] if n else 0
        before[self.first] = total[at[1]] - 1
        return total[at[0]] - np.bincount(self.of, minlength=len(self.lang))[self.of], before, total[at[2]] - own_word, total[at[3]] - self._own(self.pair)

    def _own(self, keys: np.ndarray) -> np.ndarray:
        """For each word, how often its text has its key."""
        x = mix(keys + mix(self.of.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(x)
        x = x[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
        many = np.diff(np.append(first, len(x)))
        out = np.empty(len(x), np.int64)
        out[order] = np.repeat(many, many)
        return out


def log_words(g: Grams, elsewhere: np.ndarray | None, spelled: np.ndarray) -> np.ndarray:
    """ln p of each word after the one before it, by the counts of all other rows."""
    n, before, word, pair = (x.astype(float) for x in g.counted(elsewhere))
    p = np.where(n > 0, (1 - NOVEL) * word / np.maximum(n, 1) + NOVEL * np.exp(spelled), np.exp(spelled))
    # What is too long to be spelled in a double is priced by its spelling alone.
    p = (pair + PAIRS * p) / (before + PAIRS)
    rest = spelled + np.where(n > 0, np.log(NOVEL), 0.0) + np.log(PAIRS / (before + PAIRS))
    return np.where(p > 1e-290, np.log(np.maximum(p, 1e-300)), rest)


def _short(n: np.ndarray) -> bytes:
    """Counts, most of them small: a byte for each, with the large ones after."""
    large = n[n >= 255].astype(np.int64)
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(n)).tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes() + large.tobytes())


def _long(b: bytes) -> np.ndarray:
    b = zstandard.ZstdDecompressor().decompress(b)
    n = int(np.frombuffer(b, np.int64, 1)[0])
    out = np.frombuffer(b, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(b, np.uint8, offset=8 + n).view(np.int64)
    return out


def pack_sorted(keys: np.ndarray, low: int, rice: int) -> bytes:
    """Ascending distinct keys from `low` on, as their differences in a Rice code of `rice` plain bits."""
    d = np.diff(keys, prepend=np.uint64(low))
    ends = np.cumsum((d >> np.uint64(rice)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    unary[ends - 1] = True
    odd, whole = rice % 8, rice // 8
    bits = np.packbits((d[:, None] >> np.arange(odd, dtype=np.uint64) & np.uint64(1)).astype(bool)) if odd else np.empty(0, np.uint8)
    planes = (d >> np.uint64(odd)).view(np.uint8).reshape(-1, 8)[:, :whole]
    unary = np.packbits(unary)
    return np.array([len(keys), rice, len(unary), len(bits)], np.int64).tobytes() + unary.tobytes() + bits.tobytes() + planes.tobytes()


def unpack_sorted(b: bytes, low: int) -> np.ndarray:
    n, rice, unary, bits = np.frombuffer(b, np.int64, 4).tolist()
    odd, whole = rice % 8, rice // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, unary, 32)))[:n]
    d = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(rice)
    if whole:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :whole] = np.frombuffer(b, np.uint8, n * whole, 32 + unary + bits).reshape(n, whole)
        d |= wide.view(np.uint64).reshape(n) << np.uint64(odd)
    if odd:
        d |= np.unpackbits(np.frombuffer(b, np.uint8, bits, 32 + unary))[: n * odd].reshape(n, odd).astype(np.uint64) @ (np.uint64(1) << np.arange(odd, dtype=np.uint64))
    return np.uint64(low) + np.cumsum(d)


def bounds(buckets: int, bits: int) -> list[int]:
    """The first key of each bucket, and the end."""
    return [(k << bits) // buckets for k in range(buckets + 1)]


CHUNK = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())])


def chunks_of(docs: DataFrame, parts: int, part_bytes: int) -> DataFrame:
    """part, rows: the rows of docs (doc_id, text, lang) in compressed chunks of about part_bytes of text, dealt by part."""
    schema = pa.schema([("part", pa.int64()), ("rows", pa.binary())])

    def deal(batches):
        from pyspark import TaskContext

        first, held, size, n = TaskContext.get().partitionId() << 32, [], 0, 0

        def chunk():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, CHUNK, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_batch(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            return batch(schema, part=[first + n], rows=[sink.getvalue().to_pybytes()])

        for b in slices(batches):
            b = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, CHUNK.types)], schema=CHUNK)
            for b in slices([b], part_bytes):
                if held and size + b.column(1).nbytes > part_bytes:
                    yield chunk()
                    held, size, n = [], 0, n + 1
                held.append(b)
                size += b.column(1).nbytes
        if held:
            yield chunk()

    return mapped(docs, deal, "part long, rows binary").repartition(parts, "part")


def _rows(blob: bytes) -> tuple[list[int | None], list[str], list[str | None]]:
    t = pa.ipc.open_stream(blob).read_all()
    return t.column(0).to_pylist(), [x or "" for x in t.column(1).to_pylist()], t.column(2).to_pylist()


def counts_elsewhere(chunks: DataFrame, buckets: int, bits: int) -> DataFrame:
    """part, bucket, n: how often other chunks have the distinct keys of each chunk, in the keys' order."""
    sent = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
    answer = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("n", pa.binary())])
    edges = bounds(buckets, bits)

    def send(batches):
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, texts, langs = _rows(blob)
                keys, n = Grams(texts, langs, bits).distinct()
                rice = max(0, bits - max(1, len(keys)).bit_length())
                at = np.searchsorted(keys, np.array(edges[:-1], np.uint64)).tolist() + [len(keys)]
                some = [k for k in range(buckets) if at[k] < at[k + 1]]
                yield batch(sent, part=[part] * len(some), bucket=some, keys=[pack_sorted(keys[at[k] : at[k + 1]], edges[k], rice) for k in some], n=[_short(n[at[k] : at[k + 1]]) for k in some])

    def add(table):
        low = edges[table.column("bucket")[0].as_py()]
        keys = [unpack_sorted(k, low) for k in table.column("keys").to_pylist()]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        n = np.concatenate([_long(k) for k in table.column("n").to_pylist()])
        keys, where = np.unique(np.concatenate(keys), return_inverse=True)
        rest = np.bincount(where, n, len(keys)).astype(np.int64)[where] - n
        out = pa.table([table.column("part"), table.column("bucket"), [_short(x) for x in np.split(rest, cuts)]], schema=answer)
        del keys, where, n, rest
        give_back()
        return out

    return mapped(chunks, send, "part long, bucket long, keys binary, n binary").groupBy("bucket").applyInArrow(add, "part long, bucket long, n binary")


def score(spark: SparkSession, docs: DataFrame, model: KneserNey, slots: Slots, part_bytes: int = 16 << 20) -> DataFrame:
    sent = spark.sparkContext.broadcast(model)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // part_bytes
    buckets, bits = 8 + parts // 2, min(64, max(36, 6 + size.bit_length()))
    chunks = chunks_of(docs, max(8, parts), part_bytes)

    def run(table, answers):
        out = [_scored(*_rows(blob), answers, sent.value, slots, bits) for blob in table.column("rows").to_pylist()]
        give_back()
        return pa.Table.from_batches(out, schema=SCORED)

    return (
        chunks.groupBy("part")
        .cogroup(counts_elsewhere(chunks, buckets, bits).groupBy("part"))
        .applyInArrow(run, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double")
    )


def _scored(ids: list, texts: list[str], langs: list, answers: pa.Table, lm: KneserNey, slots: Slots, bits: int) -> pa.RecordBatch:
    """Rows of SCORED for the rows of one chunk."""
    classes, alone = _classes(), _alone()
    grams = Grams(texts, langs, bits)
    blobs = answers.column("n").to_pylist()
    elsewhere = np.concatenate([_long(blobs[i]) for i in np.argsort(answers.column("bucket").to_numpy())] or [np.empty(0, np.int64)])
    found, spelled, first = np.zeros(len(texts)), np.zeros(len(grams.of)), np.searchsorted(grams.of, np.arange(len(texts) + 1))
    by: dict[int, list[int]] = {}
    for n, (t, l) in enumerate(zip(texts, langs)):
        if t:
            by.setdefault(slots[l], []).append(n)
    for s, all_mine in by.items():
        size = np.cumsum([len(texts[n]) for n in all_mine]) >> 20
        for mine in np.split(np.array(all_mine), np.flatnonzero(np.diff(size)) + 1):
            codes, starts = packed([texts[n] for n in mine], classes)
            known = np.flatnonzero(np.bincount(codes, minlength=1 << BITS * ORDER))
            price = np.zeros(1 << BITS * ORDER)
            price[known] = lm.log_p(s, known)
            sums = np.concatenate([[0.0], np.cumsum(price[codes])])
            begin, end, _, of = words_of([texts[n] for n in mine], alone)
            letters = sums[end] - sums[begin]
            spelled[np.concatenate([np.arange(first[n], first[n + 1]) for n in mine])] = letters
            found[mine] = np.diff(sums[starts]) - np.bincount(of, letters, len(mine))  # the blanks
    found += np.bincount(grams.of, log_words(grams, elsewhere, spelled), len(texts))
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    counted = np.array([base(t) for t in texts], np.int64).reshape(-1, 5)
    return batch(SCORED, doc_id=ids, lang=langs, **{n: counted[:, k] for k, n in enumerate(SCORED.names[2:7])}, log_perplexity=pa.array(-found / np.maximum(length, 1), pa.float64(), mask=length == 0))


def rate(spark: SparkSession, docs: DataFrame, width: float = 5.0, least: float = 0.12, slots: int = 16) -> DataFrame:
    """For every row of docs (doc_id, text, lang): the counts, log_perplexity, its band (lower, upper), base_failed and kept."""
    slots = slots_of(docs, slots)
    model = train(docs, slots)
    scored = Stored(spark, "quality").write(score(spark, docs, model, slots))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("of", F.coalesce("lang", F.lit("")))
    # Bands are one row for each language; they are broadcast only while these are few.
    few = F.broadcast if scored.select("of").distinct().limit(10_001).count() <= 10_000 else lambda df: df
    good, root = scored.where(~F.col("base_failed")), F.sqrt(F.greatest("word_chars", F.lit(1)))
    middle = good.groupBy("of").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle"))
    strays = good.join(few(middle), "of").groupBy("of").agg(F.first("middle").alias("middle"), F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")) * root, 0.5, 10_000).alias("stray"))
    half = F.greatest(F.lit(least), width * 1.4826 * F.col("stray") / root)
    bands = scored.join(few(strays), "of", "left").withColumns({"lower": F.col("middle") - half, "upper": F.col("middle") + half})
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return bands.withColumn("kept", ~F.col("base_failed") & inside).drop("of", "middle", "stray")
