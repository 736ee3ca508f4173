"""Packing keeps every id once, in order, and pads little."""

import collections
import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest

from statloom.llm.packing import WordIds, _tokenizer, cuts, pack
from tests.llm import nasty

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_special_tokens_by_name():
    texts = ["a <|endoftext|> b", "x<|endoftext|>.", "<|EndOfText|> c", "plain <| text", "<|startoftext|><|endoftext|>"]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, WordIds(PATH).of(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert 49407 in np.frombuffer(WordIds(PATH).of(texts[:1])[0], dtype="<u4")


def exact(text):
    return _tokenizer(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_word_ids_equal_the_tokenizers():
    odd = [
        "don't I'll 'tis a'tb x's. CAN'T!! we've...", "İstanbul Σίσυφος ΟΔΟΣ straße é é ﬁ ½ a½ 12.5% x_y-z", "   a b\x1cc \u200b.",
        "<|endoftext|> <|startoftext|>", "a.b.c... 'Sx ''s 's's", "日本語。テスト、1234 ①②", "\n\n", "á* b̈! ́x Ⅷ. ٣. x²!", "", "word*** ((x))",
    ] + [t or "" for t in nasty.texts()]
    got = WordIds(PATH).of(odd)
    for text, ids in zip(odd, got):
        assert np.frombuffer(ids, dtype="<u4").tolist() == exact(text)[:-1], text


@pytest.mark.parametrize("n", [1, 7, 45, 46, 500, 683, 1023, 1024, 1500, 2047, 2048, 2049, 9000])
def test_cuts_fit_their_class(n):
    made = cuts(n, 2048)
    assert sum(x for x, _ in made) == n
    assert all(0 < x * k <= 2048 for x, k in made)


def test_whole_pieces(spark):
    got = pack(nasty.docs(spark), PATH).collect()
    assert all(0 < r.length <= 2048 and r.length * 4 == len(r.ids) for r in got)
    texts = collections.Counter(tuple(exact(r[1])) for r in nasty.rows())
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    wanted = {i: exact(t) for i, t in [(r[0], r[1]) for r in nasty.rows()]}
    assert set(by_doc) == set(wanted)
    for i, pieces in by_doc.items():
        if i == 0:
            continue  # the repeated row: its pieces come twice
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert np.frombuffer(b"".join(r.ids for r in pieces), dtype="<u4").tolist() == wanted[i]
        assert {r.doc_tokens for r in pieces} == {len(wanted[i])}
    assert sum(r.length for r in got) == sum(len(t) * n for t, n in texts.items())
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
    used = [sum(r.length for r in p) for p in seqs.values()]
    padded = [u if u & (u - 1) == 0 else 2048 for u in used]
    assert max(used) <= 2048
    assert sum(padded) - sum(used) <= 0.02 * sum(padded)


def test_nothing(spark):
    assert pack(nasty.none(spark), PATH).count() == 0


def test_a_worker_tokenizes_in_its_own_thread():
    code = (
        "import os; from statloom.llm.packing import WordIds; ids = WordIds(%r); n = len(os.listdir('/proc/self/task')); "
        "ids.of([' '.join(f'a{i}b{j}' for j in range(50)) + ' ' + ' '.join(chr(97 + i %% 26) * (j + 1) for j in range(30)) for i in range(200)]); "
        "print(len(os.listdir('/proc/self/task')) - n)" % PATH
    )
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    done = subprocess.run([sys.executable, "-c", code], cwd=home, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "0", done.stdout + done.stderr
