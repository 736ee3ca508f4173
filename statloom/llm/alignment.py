"""Token alignment of two tokenizers over whole texts, by distinct segments.

A text is cut before every run of spaces that follows a sign other than white
space. Where both vocabularies prove that no token reaches across such a place
(``Vocabularies.safe``), a text's tokens are those of its segments one after
the other, and so are its groups. Blocks of documents, of bounded size, list
their distinct segments; the distinct segments of all blocks are tokenized and
aligned once; alignments are joined back to the blocks' lists, and each block
composes its documents. So a segment that is in every text travels once a
block, and not once an occurrence.

Many segments are tokenized at a time: joined, they are again a text cut at
safe places, and byte lengths of the tokens tell where each segment ends.
"""

from __future__ import annotations

import functools
import json
import os
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm._memory import trimmed
from statloom.plans.lineage import cut, small

#: Characters of a block of documents (one longer text is a block by itself).
CHARS = 16 << 20
#: Rows of segments handed on at a time.
ROWS = 50_000
#: Signs that count as white space to any of the tokenizers or to this module; no cut comes after one.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_CUT = re.compile(f"(?<=[^{SPACE}])(?= )")
_SPACE, _GLUED = re.compile(f"[{SPACE}]"), re.compile(f"[{SPACE}] ")
#: How sentencepiece writes a space.
MARK = "▁"
#: What is written after an id: of A, of a group's last of A, of B, of a group's last of B, of a segment's last of B.
ENDS = ",|,;\n"


def _byte_signs() -> dict[str, int]:
    """The sign by which byte-level vocabularies write each byte: printable Latin-1 itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and whether texts may be cut.

    ``a`` is a byte-level BPE file, ``b`` a sentencepiece model.
    """

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        signs = _byte_signs()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            self.a_bytes[i] = bytes(map(signs.get, word)) if all(c in signs for c in word) else word.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        self.safe = self._lossless() and not any(_CUT.search(x.decode("utf-8", "replace")) for x in self.a_bytes + self.b_bytes)
        most = max(len(self.a_bytes), len(self.b_bytes))
        if most > 1 << 21:
            raise ValueError("ids take 21 bits at most")
        self.written = np.array([[f"{i}{s}" for i in range(most)] for s in ENDS], dtype=object)

    def _lossless(self) -> bool:
        """Whether tokens of any text without MARK have the text's bytes: nothing is normalised, every byte is a token."""
        from sentencepiece import sentencepiece_model_pb2

        spec = json.loads(self.a.to_str())
        parts = spec["pre_tokenizer"] or {}
        one = {x for x in self.a_bytes if len(x) == 1}
        a = spec["normalizer"] is None and parts.get("type") == "ByteLevel" and parts.get("use_regex") and not parts.get("add_prefix_space") and len(one) == 256
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.b.serialized_model_proto())
        norm, kind = model.normalizer_spec, model.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        own = any(p.type == p.USER_DEFINED for p in model.pieces)
        b = plain and not own and kind.model_type == kind.BPE and not kind.treat_whitespace_as_suffix and sum(p.type == p.BYTE for p in model.pieces) == 256
        return bool(a and b)

    def segments(self, text: str) -> list[str]:
        """The segments of a text, each without the space it starts with; the whole text where it may not be cut."""
        if not self.safe:
            return [text]
        x = " " + text
        return [s[1:] for s in _CUT.split(x)] if _GLUED.search(x) else x.split(" ")[1:]

    def _ids(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space-led string by both. A sign before it keeps B's own space away from the string's."""
        a = np.array(self.a.encode(joined, add_special_tokens=False).ids, dtype=np.int64)
        if not self.safe:
            return a, np.array(self.b.encode(joined[1:]), dtype=np.int64)
        b = np.array(self.b.encode("x" + joined), dtype=np.int64)
        return a, b[np.cumsum(self.b_length[b]) > 2]

    def _align(self, segments: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Alignments of segments that may be joined (all but a last one end in a sign other than white space).

        Each one's tokens in the order of its groups, three bytes a token (the
        id, and which of ENDS follows, in the lowest bits), its number of links, and all links in a row.
        """
        joined = " " + " ".join(segments)
        a, b = self._ids(joined)
        if not self.safe and not b"".join(self.a_bytes[i] for i in a) == b"".join(self.b_bytes[i] for i in b) == joined.encode():
            return [b""], np.zeros(1, np.int64), np.zeros(0, np.int64)
        to_a, to_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        ends = np.cumsum([1 + len(s if s.isascii() else s.encode()) for s in segments])
        next_b, next_a = np.searchsorted(to_b, to_a), np.searchsorted(to_a, to_b)
        last_a, last_b = to_b[next_b] == to_a, to_a[next_a] == to_b
        both = to_a[last_a]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # a group's A ids, then its B ids; what is written after an id is told by what ends there
        out = np.empty(len(a) + len(b), dtype="<u4")
        out[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a << 3 | last_a
        stop = 2 + last_b
        stop[np.searchsorted(to_b, ends)] = 4
        out[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b << 3 | stop
        raw = out.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        upto = (3 * (np.flatnonzero(out & 7 == 4) + 1)).tolist()
        # between two neighbouring ends of either tokenizer exactly one pair overlaps
        steps = np.sort(np.concatenate((to_a, to_b[~last_b])), kind="stable")
        links = a[np.searchsorted(to_a, steps)] << 32 | b[np.searchsorted(to_b, steps)]
        n_links = np.diff(np.searchsorted(steps, ends, "right"), prepend=0)
        return [raw[i:j] for i, j in zip([0, *upto], upto)], n_links, links

    def align(self, segments: list[str]) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray]:
        """The distinct segments in another order, their tokens and numbers of links, and all links in a row (A id times 2^32 plus B id)."""
        alone = [s for s in segments if not self.safe or not s or _SPACE.match(s[-1])]
        apart = set(alone)
        plain = [s for s in segments if s not in apart] if alone else segments
        made = ([self._align(plain)] if plain else []) + [self._align([s]) for s in alone]
        tokens, n_links, links = zip(*made)
        return plain + alone, [x for some in tokens for x in some], np.concatenate(n_links), np.concatenate(links)

    def read(self, tokens: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The text of each segment's groups; its tokens of A, of B, and its groups."""
        x = np.frombuffer(b"".join(tokens), dtype=np.uint8).reshape(-1, 3).astype(np.int64) @ np.array([1, 1 << 8, 1 << 16])
        end, upto = x & 7, np.cumsum([len(t) // 3 for t in tokens])
        texts = iter("".join(self.written[end, x >> 3].tolist()).split("\n"))
        count = lambda hit: np.diff(np.append(0, np.cumsum(hit))[upto], prepend=0)
        return [next(texts) if t else "" for t in tokens], np.stack((count(end <= 1), count(end >= 2), count(end >= 3)), axis=1).reshape(-1, 3)


@functools.lru_cache(maxsize=2)
def vocabularies(a: str, b: str) -> Vocabularies:
    return Vocabularies(a, b)


#: Bits of a segment's place in its block's list, and of a block's number in its partition.
PLACE, BLOCKS = 29, 10


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, str, str]]:
    """``(block, doc_id, text)`` of a task's rows: a new block once the last one is full. The same whenever the task runs."""
    block, left, size = TaskContext.get().partitionId() << BLOCKS, (1 << BLOCKS) - 1, 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            yield block, doc_id, text
            size += len(text or "")
            if size >= CHARS and left:
                block, left, size = block + 1, left - 1, 0


_NUMBERS = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]


def align_documents(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for every row.

    Tokens are those of a space and the text by the byte-level BPE file ``a``
    and of the text by the sentencepiece model ``b``. ``groups`` is the text
    of the groups, ``a1,a2|b1;a3|b2,b3``, cut where tokens of both end. Null
    and empty texts, and texts whose tokens have other bytes (those that hold
    U+2581), have zeros and an empty text, and count for nothing. Repeated rows
    and rows without a doc_id are answered and counted each; other columns are
    ignored; an empty table has no rows. ``docs`` is read twice and must be a
    stored table, which gives the same rows both times; other tables are an error.
    """
    text = F.col("text").cast("string")
    held = F.when((text != "") & ~F.contains(text, F.lit(MARK)), text)
    src = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held.alias("text"))  # ids as text: pandas would make longs with nulls floats

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, at, counts = vocabularies(a, b), None, Counter()

        def flush() -> Iterator[pd.DataFrame]:
            items = list(counts.items())
            for i in range(0, len(items), ROWS):
                w, n = zip(*items[i : i + ROWS])
                # a thousand partitions are a salt, so that a segment of every block is no row without bound
                yield pd.DataFrame({"w": w, "salt": at >> BLOCKS + 10, "n": n, "code": (at << PLACE) + np.arange(i, i + len(w))})
            counts.clear()

        for block, _, x in _blocks(batches):
            if block != at:
                yield from flush()
                at = block
            if x:
                counts.update(known.segments(x))
        yield from flush()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = vocabularies(a, b), TaskContext.get().partitionId() << 40
        for batch in batches:
            if batch.num_rows:
                words = batch.column("w").to_pylist()
                order, tokens, n_links, links = known.align(words)
                if order is not words:
                    place = {w: i for i, w in enumerate(words)}
                    batch = batch.take(pa.array([place[w] for w in order]))
                each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_links)), pa.int32()), pa.array(links, pa.int64()))
                ids = pa.array(np.arange(row, row + len(order)))
                row += len(order)
                yield pa.RecordBatch.from_arrays([ids, batch.column("n"), pa.array(tokens, pa.binary()), each, batch.column("codes")], ["row", "n", "tokens", "links", "codes"])

    lists = src.mapInPandas(trimmed(listed), "w string, salt int, n long, code long")
    distinct = lists.repartition("w", "salt").groupBy("w", "salt").agg(F.sum("n").alias("n"), F.collect_list("code").alias("codes")).select("w", "n", "codes")
    made = cut(distinct.mapInArrow(aligned, "row long, n long, tokens binary, links array<long>, codes array<long>"))
    pairs = cut(made.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count")))
    of_b = F.col("link").bitwiseAND(F.lit((1 << 32) - 1))
    most = pairs.groupBy(of_b.alias("b")).agg(F.max("count").alias("most"))  # a row for each id of B's vocabulary at most
    judged = cut(pairs.join(F.broadcast(most), of_b == F.col("b")).select("link", "count", (F.col("count") == F.col("most")).cast("long").alias("best")))
    sums = made.select("row", F.explode("links").alias("link")).join(small(judged), "link").groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    known = made.select("row", "tokens", "codes").join(sums, "row", "left").select(F.explode("codes").alias("code"), "tokens", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
    back = known.select(F.shiftright("code", PLACE).alias("block"), F.col("code").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("place"), "tokens", "n_best", "count_sum")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, some, size, turn = None, [], 0, 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal some, size, turn
            if some:
                yield pd.DataFrame({"block": [at], "turn": [turn], "rows": [zstandard.compress(pickle.dumps(some), 1)]})
            some, size, turn = [], 0, turn + 1

        for block, doc_id, x in _blocks(batches):
            if block != at or len(some) >= 1_000 or size >= 1 << 20:
                yield from flush()
                at = block
            some.append((doc_id, x))
            size += len(x or "")
        yield from flush()

    def compose(parts: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        vocabulary = vocabularies(a, b)
        order = np.argsort(listed["place"].to_numpy(), kind="stable")
        groups, counts = vocabulary.read([listed["tokens"].iat[i] for i in order])
        numbers = np.hstack((counts, listed[["n_best", "count_sum"]].to_numpy(dtype=np.int64)[order]))
        place: dict[str, int] = {}
        out = []
        for rows in parts.sort_values("turn")["rows"]:
            for doc_id, x in pickle.loads(zstandard.decompress(rows)):
                at = [place.setdefault(w, len(place)) for w in vocabulary.segments(x)] if x else []
                total = numbers[at].sum(axis=0).tolist() if at else [0] * 5
                out.append((doc_id, *total, ";".join([groups[i] for i in at])))
        if len(place) != len(groups):
            raise RuntimeError("the documents were not the same when read again: store them first")
        return pd.DataFrame(out, columns=["doc_id", *_NUMBERS, "groups"])

    rows = src.mapInPandas(trimmed(packed), "block long, turn int, rows binary")
    whole = ", ".join(f"{x} long" for x in _NUMBERS)
    done = rows.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(compose, f"doc_id string, {whole}, groups string")
    n_links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", n_links, "n_best", "count_sum", "groups")
