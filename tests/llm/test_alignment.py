"""Alignments against whole texts tokenized at once and tokens compared by byte ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers

from statloom.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(ids, parts):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + len(parts[i])))
        at += len(parts[i])
    return out


def brute(texts):
    """Per text n_a, n_b, n_groups, n_links, n_best, count_sum, groups: no segments, all token pairs compared."""
    known = alignment.Vocabularies(A, B)
    made, counts = [], Counter()
    for text in texts:
        a = known.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = known.b.encode(text or "")
        want = (" " + text).encode() if text else None
        if b"".join(known.a_bytes[i] for i in a) != want or b"".join(known.b_bytes[i] for i in b) != want:
            made.append(None)
            continue
        sa, sb = spans(a, known.a_bytes), spans(b, known.b_bytes)
        links, j = [], 0
        for x, lo, hi in sa:
            links += [(x, y) for y, l2, h2 in sb if max(lo, l2) < min(hi, h2)] if len(sb) < 500 else [(x, y) for y, l2, h2 in sb[max(0, j - 40) : j + 200] if max(lo, l2) < min(hi, h2)]
            while j < len(sb) and sb[j][2] <= hi:
                j += 1
        both = sorted({h for _, _, h in sa} & {h for _, _, h in sb})
        ga, gb = [[] for _ in both], [[] for _ in both]
        for ids, groups in ((sa, ga), (sb, gb)):
            k = 0
            for x, _, h in ids:
                groups[k].append(str(x))
                k += h == both[k]
        made.append((len(a), len(b), links, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(ga, gb)), len(both)))
        counts.update(links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups, n_groups = m
            out.append((n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), groups))
    return out


NASTY = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n b\n", "x\xa0 y", "x   y　 z", "don't we'll  I'M", "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁", "half▁way there", "\x00 \x1c a\x1c b", "１２ 漢字かな 🙂🙂 é", "a" * 3000, "ab " * 2000, "​ a ​", "é" * 500, "a" + " " * 300 + "b", "﻿ x﻿ y", "\r\n \r\n x",
]


def compare(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id long, text string, w string, block int")
    got = alignment.align_documents(docs, A, B).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([(r.doc_id, *(r[n] for n in names)) for r in got], key=key) == sorted([(i, *x) for i, x in zip(ids, brute(texts))], key=key)


def test_these_vocabularies_may_be_cut():
    assert alignment.Vocabularies(A, B).safe


def test_awkward_texts(spark):
    compare(spark, NASTY)


def test_repeats_and_missing_ids(spark):
    compare(spark, ["one two", "one two", "two  one\n", "three", None], [7, 7, None, None, 8])


def test_random_texts(spark):
    rng = random.Random(3)
    signs = list("aabbc  \n\t.,'\"1é漢🙂▁\xa0 \r\x1f-_<>0x") + ["the", " the ", "ing", "'s", "  ", "\n\n"]
    compare(spark, ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)])


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHARS", 50)
    rng = random.Random(4)
    compare(spark, [" ".join(rng.choice(["alpha", "Beta.", "gamma,", "a\nb"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)])


def test_whole_texts_where_no_cut_is_proved(spark):
    known = alignment.Vocabularies(A, B)
    known.safe = False
    texts = [t for t in NASTY if t]
    words, tokens, n_links, links = known.align(texts)
    groups, counts = known.read(tokens)
    want = dict(zip(texts, brute(texts)))
    assert {w: (*c, n, g) for w, c, n, g in zip(words, counts.tolist(), n_links, groups)} == {t: (*x[:4], x[6]) for t, x in want.items()}
    assert len(links) == sum(n_links)


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(docs, A, B).collect() == []


def test_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_cross_tokenizer_alignment(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, want in zip(docs, brute([d.text for d in docs])):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[:6]
        assert r.groups_sha256 == (hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")
