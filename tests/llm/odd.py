"""Tables with every oddity the operators have to stand: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

import random

WORDS = "the of and to in is was for that on with as by it from at are an this which were be or has have its not but one their".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(spark, seed=1, n=60):
    rng = random.Random(seed)
    passage, rows = prose(rng, 45), []
    for i in range(n):
        text = prose(rng, rng.randint(1, 160))
        if i % 7 == 3:
            text = text + "\n" + passage + "\t" + prose(rng, 5)
        if i % 11 == 5 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 13 == 6 and rows and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        rows.append((i, text, rng.choice(["en", "fr", None]), f"src{i % 3}", len(text or "")))
    rows += [
        (n, None, "en", None, None),
        (n + 1, "", None, "s", 0),
        (n + 2, " \n\t ", "fr", "s", 4),
        (n + 3, "one two three", "en", "s", 13),
        (n + 4, "one two three", "en", "s", 13),
        (n + 5, "Ünïcode 漢字 🎉  word", "de", "s", 9),
        (None, passage, "en", "s", 1),
        (None, None, None, None, None),
        (7, rows[7][1], "en", "s", 1),  # a repeated id and text
        (8, prose(rng, 30), "en", "s", 1),  # a repeated id, another text
        (n + 6, prose(rng, 30_000), "en", "s", 1),
        (n + 7, "x" * 200_000, "en", "s", 1),
    ]
    extra = [(*r, "clash", 5, 1.5, "k") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, node string, shard int, n_words double, kind string")


def empty(spark):
    return documents(spark).limit(0)


def rows_of(df, *names):
    return [tuple(r) for r in df.select("doc_id", "text", *names).collect()]
