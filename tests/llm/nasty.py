"""Documents with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

WORDS = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "drei", "été", "Ñu", "x1", "and", "the", "of"]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, tokens long, copies long, "
    "n_words long, n_removed long, kept string, block int, sketch string, key string, n long, part int, k1 long, tag long, "
    "whole long, rest long, bucket string, stop string, have long, quota long, grp long, rep long, bits string, runs string, next string, "
    "edited string, hashes string, label_id long, quality int, domain string, url string, ids string, asks boolean, salt int, `__row` long"
)


def sentence(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(400)) for _ in range(n))


def texts():
    base, long = sentence(1, 120), sentence(2, 6000)
    near = base.split()
    near[60] = "changed"
    return [
        base, base, " ".join(near), base.upper(), base.replace(" ", "\n\t"), None, "", "   \n", "one", "one two", "One  two", long, long + " end",
        sentence(3, 80) + " " + base[:400], sentence(4, 49), sentence(5, 50), sentence(5, 50), "same " * 200, "same " * 130, "Same same " * 60,
        sentence(6, 60) + " a\x1cb \u00a0 c\u2003d", "Licensed under the Apache License, Version 2.0.\nMore text. Released under the MIT License.",
    ]


def rows():
    out = []
    for i, t in enumerate(texts()):
        out.append((i * 3, t, [None, "en", "de", ""][i % 4], [None, "src0", "src0", "src12", "odd"][i % 5], len(t or ""), 0.5, 1, 1, 1, 1, 1, "k", 1, "s", "k", 1, 1, 1, 1, 1, 1, "b", "s", 1, 1, 1, 1, "b", "r", "n", "e", "h", 1, 1, "d", "u", "i", True, 1, 1))
    out.append(out[0])  # a repeated row
    out.append((None, texts()[0], "en", "src0", 0, *out[0][5:]))  # no doc_id
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
