"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of length
in (capacity / (k + 1), capacity / k], and a bin of class k takes exactly k of
them. Each task packs its own rows and shares nothing with the others: there is
no shuffle, and it holds only the bins not yet full, one of each class.

A document is cut so that pieces nearly fill their class: whole sequences
first, then the largest class length that the rest exceeds, until the rest
wastes at most ``1 / SLACK`` of its place. Bins still open when a task ends are
poured into sequences one after the other and cut where a sequence ends; the
last of these are cut to powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import gc
import os
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm._memory import trimmed

#: A last piece may leave this share of its place empty.
SLACK = 128
#: Words with remembered ids, in each of two generations (and cores of words).
REMEMBERED = 300_000
#: Pieces handed on, and plain words joined for the tokenizer, at a time.
BATCH, LOT = 1024, 256
#: Characters of the texts tokenized together.
CHARS = 1 << 20
# White space between words, and signs that end a word.
SPACES = "\t\n\r\x0b\x0c"
TAILS = ".,;:!?*&%$#|)]}"


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread more would keep memory of its own
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def _markers(path: str) -> tuple[str, ...]:
    """Signs of which a text that holds an added token of the vocabulary has at least one."""
    added = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values() if t.content]
    return tuple(sorted({x[:2] if not any(c.isalnum() for c in x[:2]) else x[0] if not x[0].isalnum() else "" for x in added}))


@functools.lru_cache(maxsize=4)
def _ends(path: str) -> np.ndarray:
    """Which ids end a word; none if the vocabulary has no mark for it."""
    made = _tokenizer(path)
    suffix = getattr(made.model, "end_of_word_suffix", None)
    out = np.zeros(made.get_vocab_size(with_added_tokens=True) + 1, dtype=bool)
    if suffix:
        out[[i for word, i in made.get_vocab(with_added_tokens=False).items() if word.endswith(suffix)]] = True
    return out


class WordIds:
    """Ids of whole texts by remembering those of words between ASCII white space.

    For tokenizers that lower-case, drop white space, and never join letters or
    digits with other signs (contractions apart), which is checked against the
    tokenizer itself in the tests. A word that ends in signs is put together
    from its core and its tail, an ASCII core is looked up in lower case. Texts
    that may hold an added token of the vocabulary are tokenized as a whole.
    """

    def __init__(self, path: str) -> None:
        self.path, self.new, self.old, self.cores = path, {}, {}, {}

    def forget(self) -> None:
        self.new, self.old, self.cores = {}, {}, {}

    def learn(self, unknown: set[str]) -> None:
        """Remembers the ids of unknown words, tokenizing each core once."""
        if len(self.cores) > REMEMBERED:
            self.cores = {}
        cores, new, parted, asked = self.cores, self.new, [], set()
        for word in unknown:
            core, tail = word, ""
            if not word.isalpha():
                core = word.rstrip(TAILS)
                tail = word[len(core) :]
                if not (core and core[-1].isalnum()):
                    core, tail = word, ""
            if core.isascii():
                core = core.lower()
            ids = cores.get(core)
            if ids is None or tail and tail not in cores:
                parted.append((word, core, tail))
                asked.add(core)
                if tail:
                    asked.add(tail)
            else:
                new[word] = ids + cores[tail] if tail else ids
        ask = sorted(asked.difference(cores))
        made, ends = _tokenizer(self.path), _ends(self.path)
        plain = [x for x in ask if x.isalpha()]  # one word each, so the ids tell where each ends
        lots = [plain[i : i + LOT] for i in range(0, len(plain), LOT)]
        rest = [x for x in ask if not x.isalpha()]
        for lot, got in zip(lots, made.encode_batch_fast([" ".join(lot) for lot in lots], add_special_tokens=False)):
            ids = np.array(got.ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(stops) != len(lot):
                rest += lot
                continue
            raw, at = ids.tobytes(), 0
            for word, stop in zip(lot, stops):
                cores[word] = raw[at:stop]
                at = stop
        for word, got in zip(rest, made.encode_batch_fast(rest, add_special_tokens=False)):
            cores[word] = struct.pack(f"<{len(got.ids)}I", *got.ids)
        for word, core, tail in parted:
            new[word] = cores[core] + cores[tail] if tail else cores[core]

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        marks = _markers(self.path)
        whole = {i: _tokenizer(self.path).encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(m in t for m in marks)}
        if whole:
            texts = ["" if i in whole else t for i, t in enumerate(texts)]
        split = [functools.reduce(lambda x, c: x.replace(c, " "), SPACES, t).split(" ") for t in texts]
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = set().union(*split).difference(new)
        known = missing.intersection(old)
        for word in known:
            new[word] = old[word]
        missing -= known
        self.learn(missing)
        return [b"".join(map(new.__getitem__, words)) if i not in whole else struct.pack(f"<{len(whole[i])}I", *whole[i]) for i, words in enumerate(split)]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(length, class)`` of the pieces of ``n`` ids."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        full = capacity // k
        if (full - rest) * SLACK <= full:
            out.append((rest, k))
            break
        out.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` for every piece.

    ``ids`` are little-endian unsigned 32-bit numbers: those of the text by the
    tokenizer file, with no special tokens added (the name of one in a text is
    its id), then ``end_id``. A null or empty
    text has ``end_id`` only. Repeated rows and null doc_ids are packed like any
    other row; other columns are ignored. ``sequence_id`` is unique over tasks.
    Which rows share a sequence follows the input's partitions, so give it a
    stored table, whose partitions are the same when a lost task runs again.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # millions of words without a cycle among them
        ids_of = WordIds(tokenizer)
        end = end_id.to_bytes(4, "little")
        next_id = TaskContext.get().partitionId() << 40
        open_bins: dict[int, list] = {}
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        out: list = []

        def emit(pieces: list) -> None:
            nonlocal next_id
            at = 0
            for doc_id, start, ids, total in pieces:
                out.append((doc_id, start, len(ids) // 4, ids, total, next_id, at))
                at += len(ids) // 4
            next_id += 1

        def flush() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=names)
            out.clear()
            return made

        def tokenized() -> Iterator[tuple]:
            for batch in batches:
                some, size = [], 0
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    some.append((doc_id, text or ""))
                    size += len(some[-1][1])
                    if size >= CHARS:
                        yield from zip([d for d, _ in some], ids_of.of([t for _, t in some]))
                        some, size = [], 0
                yield from zip([d for d, _ in some], ids_of.of([t for _, t in some]))

        for doc_id, ids in tokenized():
            ids += end
            at, total = 0, len(ids) // 4
            for length, k in cuts(total, capacity):
                held = open_bins.setdefault(k, [])
                held.append((doc_id, at, ids[4 * at : 4 * (at + length)], total))
                at += length
                if len(held) == k:
                    emit(open_bins.pop(k))
            if len(out) >= BATCH:
                yield flush()
        rest = deque(piece for k in sorted(open_bins) for piece in open_bins[k])
        left = sum(len(ids) // 4 for _, _, ids, _ in rest)
        room = [capacity] * (left // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if left % capacity >> b & 1]
        for space in room:
            taken = []
            while space:
                doc_id, start, ids, total = rest.popleft()
                if len(ids) // 4 > space:
                    rest.appendleft((doc_id, start + space, ids[4 * space :], total))
                    ids = ids[: 4 * space]
                taken.append((doc_id, start, ids, total))
                space -= len(ids) // 4
            emit(taken)
        if out:
            yield flush()
        ids_of.forget()

    # ids travel as text: pandas would make longs with nulls floats
    src = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = src.mapInPandas(trimmed(task), "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))
