"""Language identification with language-bitmask n-gram filters.

Training counts the character n-grams of the labelled texts with Spark. A language's filter gets every n-gram whose share of the
language's n-grams is at least `share`, hence at most 1 / share n-grams for each language at every corpus size. The filters are Bloom
filters of `rows` rows laid out bit-sliced: row r holds one bit for each language, so that AND over an n-gram's `hashes` rows
gives all languages that contain it at once (rows * 8 bytes for each 64 languages, whatever the corpus).

A text's n-grams are looked up together; popcounts for each language, corrected for that filter's false-positive rate f as
(hits - f * n) / (1 - f) / n, decide; ties go to the alphabetically first language. The score is the winner's corrected share plus
its margin over the runner-up, at most 1.

Words are runs of letters in lower case; the n-grams of `orders` characters are those of each word with a blank at either end, over
whole texts.

Defined results: a null text, or one without a letter (Unicode category L; numerals such as ½ are none), is `und` with score 0, as is every text if nothing was learned; rows with a
null language teach nothing; repeated rows are separate rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, batch, mapped, mix, slices

#: Runs of word characters; those that Unicode doesn't file under letters (numerals such as ½, ² and Ⅷ) are taken out below.
RUNS = re.compile(r"[^\W\d_]+")
ORDERS = (2, 3, 4, 5)
#: Words whose n-grams are in memory at a time.
BLOCK = 8_000


def _numerals() -> tuple[re.Pattern, re.Pattern]:
    """Numerals in and beyond the basic plane. (A class that reaches beyond it is slow to match.)"""
    found = [c for c in map(chr, range(0x110000)) if RUNS.match(c) and not unicodedata.category(c).startswith("L")]
    return tuple(re.compile(f"[{''.join(c for c in found if (c > chr(0xFFFF)) == beyond)}]+") for beyond in (False, True))


NUMERAL, NUMERAL_BEYOND = _numerals()
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L), in lower case."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = NUMERAL.sub(" ", text)
        if BEYOND.search(text):
            text = NUMERAL_BEYOND.sub(" ", text)
    return RUNS.findall(text)


def grams(words: list[str], orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word between blanks, and for each the index of its word."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = c == 32
    word = np.cumsum(blank) - 1  # of a gram's first character, whose blank opens the word
    inner = np.concatenate([[0], np.cumsum(blank)])
    hashes, owners = [], []
    for n in orders:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : m + k]
        fits = inner[n - 1 : m + n - 1] == inner[1 : m + 1] if n > 1 else ~blank[:m]  # no blank but at the ends
        if n == 2:
            fits = ~(blank[:m] & blank[1 : m + 1])
        hashes.append(h[fits])
        owners.append(word[:m][fits])
    return mix(np.concatenate(hashes)), np.concatenate(owners)


class Filters:
    """Bit-sliced Bloom filters: bits[row, word] has a bit for each language."""

    def __init__(self, languages: list[str], rows: int, hashes: int):
        self.languages, self.rows, self.hashes = languages, rows, hashes
        self.bits = np.zeros((rows, max(1, -(-len(languages) // 64))), np.uint64)
        self.wrong = np.zeros(len(languages))

    def places(self, g: np.ndarray) -> list[np.ndarray]:
        up, step = g % np.uint64(self.rows), (g >> np.uint64(32)) | np.uint64(1)
        return [((up + np.uint64(k) * step) % np.uint64(self.rows)).astype(np.int64) for k in range(self.hashes)]

    def add(self, language: int, g: np.ndarray) -> None:
        bit = np.uint64(1) << np.uint64(language % 64)
        for at in self.places(g):
            self.bits[at, language // 64] |= bit

    def close(self) -> Filters:
        for k in range(len(self.languages)):
            filled = np.count_nonzero(self.bits[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) / self.rows
            self.wrong[k] = filled**self.hashes
        return self

    def masks(self, g: np.ndarray) -> np.ndarray:
        first, *rest = self.places(g)
        out = self.bits[first]
        for at in rest:
            out &= self.bits[at]
        return out

    def hits(self, words: list[str], orders=ORDERS) -> np.ndarray:
        """A row for each word: its n-grams that each language contains, and at the end its number of n-grams."""
        if len(words) > BLOCK:
            return np.concatenate([self.hits(words[i : i + BLOCK], orders) for i in range(0, len(words), BLOCK)])
        g, owner = grams(words, orders)
        masks, n = self.masks(g), len(words)
        columns = [np.bincount(owner[(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(bool)], minlength=n) for k in range(len(self.languages))]
        return np.stack([*columns, np.bincount(owner, minlength=n)], axis=1).astype(np.float64)

    def decide(self, hits: np.ndarray) -> tuple[str, float]:
        """From the sum of a text's rows of hits()."""
        if not self.languages or not hits[-1]:
            return "und", 0.0
        net = np.maximum(0.0, (hits[:-1] - self.wrong * hits[-1]) / (1 - np.minimum(self.wrong, 0.999))) / hits[-1]
        best = int(np.argmax(net))
        return self.languages[best], float(min(1.0, 2 * net[best] - np.delete(net, best).max(initial=0.0)))


class Reader:
    """Decides texts in turn; what a word hits is remembered, for at most `most` words."""

    def __init__(self, filters: Filters, orders=ORDERS, most: int = 120_000):
        self.filters, self.orders, self.most = filters, orders, most
        self.rows, self.table = {}, np.zeros((0, len(filters.languages) + 1))

    def decide(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.rows) > self.most:
            self.rows, self.table = {}, self.table[:0]
        listed = [words_of(t) for t in texts]
        new = list(dict.fromkeys(w for ws in listed for w in set(ws) if w not in self.rows))
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.table = np.concatenate([self.table, self.filters.hits(new, self.orders)])
        at = self.rows.__getitem__
        return [self.filters.decide(self.table[np.fromiter(map(at, ws), np.int64, len(ws))].sum(0)) for ws in listed]


def learn(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", share: float = 2e-5, rows: int = 1 << 20, hashes: int = 3, orders=ORDERS, most_languages: int = 1024) -> Filters:
    """Filters of the languages in docs. The driver gets at most 1 / share n-grams of each language."""
    docs = docs.selectExpr(f"cast(`{text}` as string) text", f"cast(`{lang}` as string) lang").where("lang is not null and text is not null")
    counted = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        held: dict[str, Counter] = {}

        def flush():
            for language, seen in sorted(held.items()):
                words, times = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
                for i in range(0, len(words), BLOCK):
                    g, owner = grams(words[i : i + BLOCK], orders)
                    g, where = np.unique(g, return_inverse=True)
                    n = np.bincount(where, times[i + owner], minlength=len(g)).astype(np.int64)
                    yield batch(counted, lang=pa.array([language] * len(g), pa.string()), gram=g.view(np.int64), n=n)
            held.clear()

        for b in slices(batches):
            for t, language in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(language, Counter()).update(words_of(t))
            if sum(map(len, held.values())) > 100_000:
                yield from flush()
        yield from flush()

    store = Stored(spark, "langid")
    counts = store.write(mapped(docs, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).limit(most_languages + 1).collect()}
    if len(totals) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(totals)
    filters = Filters(languages, rows, hashes)
    if languages:
        limits = spark.createDataFrame([(name, k, share * totals[name]) for k, name in enumerate(languages)], "lang string, k int, least double")
        kept = counts.join(F.broadcast(limits), "lang").where(F.col("n") >= F.greatest("least", F.lit(2.0))).select("k", "gram").toArrow()
        of, gram = kept.column("k").to_numpy(), kept.column("gram").to_numpy().view(np.uint64)
        for k in range(len(languages)):
            filters.add(k, gram[of == k])
    return filters.close()


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(spark: SparkSession, docs: DataFrame, filters: Filters, orders=ORDERS) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text)."""
    sent = spark.sparkContext.broadcast(filters)

    def run(batches):
        reader = Reader(sent.value, orders)
        for b in slices(batches):
            found = reader.decide(b.column(1).to_pylist())
            yield batch(PREDICTED, doc_id=b.column(0), lang_pred=[x for x, _ in found], score=[s for _, s in found])

    return mapped(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, lang_pred string, score double")


def keep(spark: SparkSession, docs: DataFrame, filters: Filters, least: float = 0.2, text: str = "text", orders=ORDERS) -> DataFrame:
    """The rows of docs whose text has a language: not `und`, and a score of at least `least`. All columns stay."""
    sent, schema = spark.sparkContext.broadcast(filters), docs.schema

    def run(batches):
        reader = Reader(sent.value, orders)
        for b in slices(batches, text=text):
            found = [language != "und" and score >= least for language, score in reader.decide(b.column(b.schema.get_field_index(text)).to_pylist())]
            yield b.filter(pa.array(found, pa.bool_()))

    return mapped(docs, run, schema)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
