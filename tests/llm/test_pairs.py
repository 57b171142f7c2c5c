"""Jaccard join, substring deduplication and decontamination against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from cairnframe.llm import jaccard, leaks, substrings

from . import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k=5):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard(spark, seed):
    docs = odd.documents(spark, seed, 120)
    got = jaccard.join(spark, docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(odd.rows_of(docs))


def test_jaccard_star_and_blocks(spark):
    """Copies that link to a middle text only, in more blocks than one."""
    import random

    rng = random.Random(5)
    base = odd.prose(rng, 100).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        at = rng.randrange(0, 90)
        w[at : at + 5] = [f"new{i}x{k}" for k in range(5)]
        rows.append((i, " ".join(w)))
    for i in range(40, 70):  # share less than what links
        w = list(base)
        for at in range(rng.randrange(4), 96, 12):
            w[at] = f"other{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join(spark, docs, block=8).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = [set(rng.integers(0, 4000, 60).tolist()) for _ in range(6)]
    sets = [frozenset(list(b)[: rng.integers(45, 60)]) | set(rng.integers(0, 4000, rng.integers(0, 12)).tolist()) for b in base for _ in range(12)]
    every = np.concatenate([jaccard.mix(np.array(sorted(s), np.uint64)) for s in sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    packed = np.stack([np.frombuffer(b, np.uint64) for b in jaccard.bitmaps_of(every, owner, len(sets))])
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.Tree(packed, sizes, np.arange(len(sets)))
    found = {(int(a), int(b)) for i, j in tree.pairs(tree) for a, b in zip(i, j)}
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links and links <= found and len(found) < len(sets) * (len(sets) - 1) / 4
    left, right = jaccard.Tree(packed[:10], sizes[:10], np.arange(10)), jaccard.Tree(packed[10:], sizes[10:], np.arange(10, len(sets)))
    across = {(int(a), int(b) + 10) for i, j in left.pairs(right) for a, b in zip(i, j)}
    assert {(a, b) for a, b in links if a < 10 <= b} <= across
    one = jaccard.Tree(packed, sizes, np.zeros(len(sets), np.int64))
    assert not list(one.pairs(one))


def test_keep_one(spark):
    docs = odd.documents(spark, 2, 80)
    kept = jaccard.keep_one(spark, docs)
    assert kept.columns == docs.columns
    rows = odd.rows_of(docs)
    groups, out = {}, []
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    for i, (d, t) in enumerate(rows):
        if not sets[i]:
            out.append((d, t))
        else:
            groups.setdefault(find(i), []).append((d is None, d or 0, d, t))
    singles = Counter((d, t) for d, t in out)
    got = Counter((r[0], r[1]) for r in odd.rows_of(kept))
    for g in groups.values():
        least = min(g)[:2]
        best = {(d, t) for a, b, d, t in g if (a, b) == least}
        held = [k for k in got if k in best]
        assert len(held) == 1 and got[held[0]] == 1, (held, g)
    assert sum(got.values()) == len(groups) + sum(singles.values())
    unique = docs.where("doc_id < 60 and doc_id not in (7, 8)")
    assert jaccard.keep_one(spark, unique).columns == docs.columns


def brute_removed(rows, length=20):
    """Rows in the documented order; rows with the same id and text are one document."""
    import xxhash

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, xxhash.xxh32_intdigest((rows[i][1] or "").encode())))  # as documented
    seen, out, done = set(), [None] * len(rows), {}
    for i in order:
        d, t = rows[i]
        words = WORD.findall(t or "")
        if (d, t) in done:
            out[i] = done[d, t]
            continue
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            w = tuple(words[k : k + length])
            if w in seen:
                gone[k : k + length] = [True] * length
            seen.add(w)
        out[i] = done[d, t] = (d, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,chunk", [(1, 10**6), (2, 500), (3, 60)])
def test_substrings(spark, seed, chunk):
    docs = odd.documents(spark, seed, 100).repartition(5)
    got = substrings.remove_repeats(spark, docs, chunk_words=chunk).collect()
    assert sorted(map(tuple, got), key=repr) == brute_removed(odd.rows_of(docs))


def test_substrings_within_a_text(spark):
    import random

    rng = random.Random(1)
    part = odd.prose(rng, 30)
    rows = [(1, f"{part} {odd.prose(rng, 4)} {part}"), (2, "a " * 100), (3, "a " * 19), (4, " ".join(part.split()[:19]))]
    got = substrings.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_removed(rows)


def brute_leaks(rows, items, least=0.8, slack=0.1):
    out = set()
    for d, t in rows:
        words = WORD.findall(lower(t))
        for i, item in items:
            own = WORD.findall(lower(item))
            if not own or not words:
                continue
            k = min(5, len(own))
            a, s = Counter(tuple(own[n : n + k]) for n in range(len(own) - k + 1)), [tuple(words[n : n + k]) for n in range(len(words) - k + 1)]
            if a.keys().isdisjoint(s):
                continue
            spare = int(len(own) * slack)
            for size in range(max(k, len(own) - spare), len(own) + spare + 1):
                m = min(size - k + 1, len(s))
                for b in range(len(s) - m + 1):
                    w = Counter(s[b : b + m])
                    shared = sum((a & w).values())
                    if shared and shared >= least * (sum(a.values()) + sum(w.values()) - shared) - 1e-9:
                        out.add((d, i))
    return out


def test_leaks(spark):
    import random

    rng = random.Random(4)
    items = [(i, odd.prose(rng, rng.randint(12, 50))) for i in range(12)] + [(12, None), (13, ""), (14, "tiny item"), (0, "a second text under an id that is taken already")]
    rows = []
    for d in range(60):
        words = odd.prose(rng, 60).split()
        if d % 3 == 0:
            own = items[rng.randrange(12)][1].upper().split()
            if d % 2:
                own[rng.randrange(len(own))] = "changed"
            words[30:30] = own
        if d == 50:
            words[3:3] = ["Tiny", "Item"]
        rows.append((d, " ".join(words)))
    rows += [(None, items[1][1]), (60, None), (61, ""), (62, items[2][1]), (62, items[2][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    found = leaks.leaks(spark, docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute_leaks(rows, items)
    assert sum(r["doc_id"] == 62 and r["item_id"] == 2 for r in found) == 2
    blocks = leaks.leaks(spark, docs, bench, most_bytes=300).collect()
    assert sorted(map(tuple, blocks), key=repr) == sorted(map(tuple, found), key=repr)
    clean = leaks.clean(spark, docs, bench)
    gone = {r["doc_id"] for r in found}
    assert clean.columns == docs.columns and sorted((r[0] for r in clean.collect()), key=repr) == sorted((d for d, _ in rows if d not in gone), key=repr)
    assert leaks.leaks(spark, docs, bench.limit(0)).count() == 0 and leaks.leaks(spark, docs.limit(0), bench).count() == 0


def brute_all_windows(t, item, least=0.8):
    words, own = WORD.findall(lower(t)), WORD.findall(lower(item))
    k = min(5, len(own))
    a, s = Counter(tuple(own[n : n + k]) for n in range(len(own) - k + 1)), [tuple(words[n : n + k]) for n in range(len(words) - k + 1)]
    best = 0.0
    for b in range(len(s)):
        w, shared = Counter(), 0
        for m, x in enumerate(s[b:], 1):
            shared += w[x] < a[x]
            w[x] += 1
            best = max(best, shared / (sum(a.values()) + m - shared))
    return best if best >= least else None


def test_leaks_of_every_length(spark):
    import random

    rng = random.Random(6)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    items, rows = [], []
    for i, (size, keep, added) in enumerate([(30, 25, 0), (30, 24, 0), (100, 82, 0), (104, 104, 15), (104, 104, 25), (9, 8, 0), (7, 7, 0)]):
        own = fresh(size)
        items.append((i, " ".join(own)))
        body = own[:keep]
        body[keep // 2 : keep // 2] = fresh(added)
        rows.append((i, " ".join(fresh(50) + body + fresh(50))))
        rows.append((100 + i, " ".join(body)))
    want = {(d, i): v for d, t in rows for i, item in items if (v := brute_all_windows(t, item))}
    found = leaks.leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    assert {(0, 0), (2, 2), (3, 3)} <= want.keys() and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, 30).astype(np.uint64) for _ in range(60)]
    index = leaks.Index(sets, 32, 11)
    own = leaks.simhashes(np.concatenate(sets), np.arange(60) * 30, np.full(60, 30))
    asked = []
    for n in range(400):
        bits = own[n % 60].copy()
        bits[rng.choice(128, n // 10, replace=False)] ^= True
        asked.append(bits)
    asked = np.array(asked)
    want = {(i, j) for i, x in enumerate(asked) for j, y in enumerate(own) if (x != y).sum() <= 32}
    row, item = index.within(asked)
    assert set(zip(row.tolist(), item.tolist())) == want and len(row) == len(want) >= 330
    some = index.within(asked, most=1)
    assert some[0].tolist() == row.tolist() and some[1].tolist() == item.tolist()


def test_simhash_is_the_majority_of_its_shingles():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 2**63, 200).astype(np.uint64)
    begin, size = np.sort(rng.integers(0, 150, 40)), rng.integers(1, 50, 40)
    got = leaks.simhashes(s, begin, size, most=16)
    for b, n, bits in zip(begin, size, got):
        each = [np.unpackbits(np.array([leaks.mix(x[None] ^ salt)[0] for salt in leaks._SALTS], np.uint64).view(np.uint8)) for x in s[b : b + n]]
        assert (2 * np.sum(each, 0, dtype=int) > n).tolist() == bits.tolist()


def test_leaks_come_from_the_index_alone(spark):
    """Without an answer of the index nothing is found; with it nearly all that brute force finds, one-word edits included."""
    import random

    rng = random.Random(11)
    items = [(i, odd.prose(rng, rng.randint(15, 60))) for i in range(150)]
    rows = []
    for d in range(900):
        own = items[rng.randrange(150)][1].split()
        for _ in range(d % 3):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([["changed"], [], [own[at], "added"]])
        rows.append((d, " ".join(odd.prose(rng, rng.randint(0, 30)).split() + own + odd.prose(rng, rng.randint(0, 30)).split())))
    known = leaks.Items(items, 5, 32, 11)
    texts = leaks.pa.array([t for _, t in rows])
    got = {(d, i) for d, found in enumerate(known.leaked(texts, 0.8)) for ids, *_ in found for i in ids}
    grams = {i: set(shingles(t)) for i, t in items}
    own = [set(shingles(t)) for _, t in rows]
    want = {(d, i) for d, t in rows for i, item in items if not grams[i].isdisjoint(own[d]) and brute_all_windows(t, item)}
    assert got <= want and len(want) > 450 and len(got) >= 0.99 * len(want), (len(got), len(want))
    for index, _ in known.widths.values():
        index.within = lambda bits: (np.empty(0, np.int64), np.empty(0, np.int64))
    assert not any(known.leaked(texts, 0.8))


def test_items_take_under_a_kilobyte():
    import pickle
    import random

    rng = random.Random(5)
    items = [(i, " ".join(f"{rng.randrange(10**6)}" for _ in range(45))) for i in range(4000)]
    assert len(pickle.dumps(leaks.Items(items, 5, 32, 11))) < 1000 * len(items)


def test_empty_tables(spark):
    none = odd.empty(spark)
    assert jaccard.join(spark, none).count() == 0
    assert jaccard.keep_one(spark, none).count() == 0
    assert substrings.remove_repeats(spark, none).count() == 0


def test_queries(spark, sf):
    from cairnframe.llm.queries import queries

    q = queries()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = odd.rows_of(docs)
    got = q["op5_jaccard_components"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)
    got = q["op9_repeated_passages"](spark, sf).collect()
    want = [(d, n, r, hashlib.sha256(t.encode()).hexdigest()) for d, n, r, t in brute_removed(rows)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in q["op7_simhash_leaks"](spark, sf).collect()}
    plain = {d: f" {' '.join(WORD.findall(lower(t)))} " for d, t in rows}
    exact = {(d, n) for d, t in plain.items() for n, i in items if f" {' '.join(WORD.findall(lower(i)))} " in t}
    assert exact and exact <= got
