"""N-gram Jaccard join by a token-group matrix.

Documents with similar shingle sets form groups. The matrix holds, for each
shingle, the groups with a member that has it in its prefix. In a few rounds
every group asks the likeliest of the leading members of the shingles it
shares; what links becomes one group. Then every document meets the members of
all other groups at the shingles of their prefixes: parity bitmaps bound how
much two sets differ, and those within the bound ask for the group. A group is
opened for a document only if its overlap with the union of the asked members'
shingles can reach the threshold; then the members' sets are compared exactly.
Shingles that the same documents have in their prefixes stand for one another,
so one of them is kept.

Why no link is lost: the prefix of a set of n shingles are its
``n - ceil(t * n) + 1`` first ones in a global order, so two sets with likeness
t or more share a shingle of both prefixes and meet there, unless they are of
one group already. A bit of the bitmap is the parity of the shingles that fall
on it, so two bitmaps never differ in more bits than the sets differ in
shingles; a bitmap grows with its set, and halves laid on one another give the
smaller one. The union bound never underestimates the overlap.

The global order comes from a sketch over all documents: first the shingles
that certainly only one document has (they meet nothing and are not stored),
last the most frequent. Its errors change the order alike for every document,
so they cost time and never a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import _sketch
from statloom.llm._memory import trimmed
from statloom.llm._words import distinct, mix, shingle_set
from statloom.plans.graph import connected_components
from statloom.plans.lineage import cut, small, sweep

#: Least and most bits of the plane that tells which shingles two documents may have.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Bits a 16-bit frequency count (counts stop at the top).
SHARE = 32
#: Least bytes of a set's parity bitmap, which has a bit or more a shingle; on fewer bits large sets that share little look alike.
BITMAP = 128
#: Rounds in which groups ask leaders, leaders of a shingle, and documents that meet there in one task.
ROUNDS, LEADERS, CROWD = 2, 8, 1 << 15
#: Documents of a shingle in one block; blocks of a shingle meet pair by pair.
BLOCK = 4_096
#: Most members of a group block, and documents that one task holds against it.
MEMBERS, QUERIES = 256, 512


def _need(n: int, num: int, den: int) -> int:
    """Least overlap of a set of ``n`` with any set at likeness num/den or more."""
    return -(-num * n // den)


def _links(left: np.ndarray, right: np.ndarray, num: int, den: int) -> bool:
    all_of = np.sort(np.concatenate((left, right)))
    both = int((all_of[1:] == all_of[:-1]).sum())
    return den * both >= num * (len(left) + len(right) - both)


def _bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit; a power of two of bits."""
    n = max(8 * BITMAP, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class _Bitmaps:
    """Bitmaps of several lengths; those of two rows are compared at the smaller length."""

    def __init__(self, bits: list[bytes]) -> None:
        size = np.array([len(b) for b in bits])
        self.level = np.log2(size // BITMAP).astype(np.int64)
        self.place, self.at = {}, {}
        over, rows = np.zeros(0, dtype=np.int64), None
        for level in range(int(self.level.max(initial=0)), -1, -1):
            width = BITMAP // 8 << level
            own = np.flatnonzero(self.level == level)
            held = np.frombuffer(b"".join([bits[i] for i in own]), dtype=np.uint64).reshape(len(own), width)
            if rows is not None:
                held = np.concatenate((rows[:, :width] ^ rows[:, width:], held))
            over, rows = np.concatenate((over, own)), held
            self.place[level] = np.zeros(len(bits), dtype=np.int64)
            self.place[level][over] = np.arange(len(over))
            self.at[level] = rows

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, least = np.zeros(len(i), dtype=np.int64), np.minimum(self.level[i], self.level[j])
        for level, rows in self.at.items():
            some = np.flatnonzero(least == level)
            step = max(1, (4 << 20) // (BITMAP << level))
            for k in range(0, len(some), step):
                here = some[k : k + step]
                a, b = self.place[level][i[here]], self.place[level][j[here]]
                out[here] = np.bitwise_count(rows[a] ^ rows[b]).sum(axis=1, dtype=np.int64)
        return out


class _Order:
    """Sketch of a corpus's shingles: two bit planes (met by one, by several documents) and counts."""

    def __init__(self, bits: int) -> None:
        self.bits, self.counts = bits, bits // SHARE

    def parts(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plane = self.bits // 8
        return flat[:plane], flat[plane : 2 * plane], flat[2 * plane :].view(np.uint16)

    def size(self) -> int:
        return 2 * self.bits // 8 + 2 * self.counts

    def add(self, flat: np.ndarray, shingles: np.ndarray) -> None:
        """Adds the concatenated sets of some documents."""
        if not len(shingles):
            return
        once, twice, counts = self.parts(flat)
        cells = np.sort(shingles % np.uint64(self.bits))
        first = np.flatnonzero(np.concatenate((np.ones(1, dtype=bool), cells[1:] != cells[:-1])))
        n, cells = np.diff(np.append(first, len(cells))), cells[first]
        at, bit = (cells >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cells & np.uint64(7)).astype(np.uint8)
        again = np.where((n > 1) | ((once[at] & bit) > 0), bit, np.uint8(0))
        start = np.flatnonzero(np.diff(at, prepend=-1))
        place = at[start]
        once[place] |= np.bitwise_or.reduceat(bit, start)
        twice[place] |= np.bitwise_or.reduceat(again, start)
        group = (cells // np.uint64(SHARE)).astype(np.int64)
        start = np.flatnonzero(np.diff(group, prepend=-1))
        place = group[start]
        counts[place] = np.minimum(counts[place] + np.maximum.reduceat(n, start), 65_535)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (a1, a2, ac), (b1, b2, bc) = self.parts(a), self.parts(b)
        np.bitwise_or(a2, b2, out=a2)
        np.bitwise_or(a2, a1 & b1, out=a2)
        np.bitwise_or(a1, b1, out=a1)
        _sketch.add_to_top(ac, bc)
        return a

    def levels(self, flat: np.ndarray) -> np.ndarray:
        """The plane of several documents, then one level of frequency a count."""
        _, twice, counts = self.parts(flat)
        load = max(4.0, 4.0 * float(counts.mean()))
        out = np.concatenate((twice, np.zeros(self.counts, dtype=np.uint8)))
        for at in range(0, self.counts, 1 << 20):
            part = counts[at : at + (1 << 20)]
            out[len(twice) + at : len(twice) + at + len(part)] = np.floor(2 * np.log2(np.maximum(part / load, 1.0)))
        return out

    def ranks(self, levels: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Zero for shingles of one document only, else 1 and more by frequency."""
        cells = s % np.uint64(self.bits)
        plane = self.bits // 8
        return np.where(_sketch.has(levels[:plane], cells), levels[plane:][(cells // np.uint64(SHARE)).astype(np.int64)] + 1, 0)


class _Opener:
    """Opens groups for the documents that ask: exact links of (x, group) pairs."""

    def __init__(self, src: DataFrame, nodes: DataFrame, words: int, num: int, den: int) -> None:
        self.src, self.nodes, self.words, self.num, self.den = src, nodes, words, num, den

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """``a, b``: a link from each x to each group of ``pairs(x, y, grp)`` with an asked member that it links to.

        A group's asked members lie in blocks, the documents that ask for it
        are spread over tasks; each task holds one block.
        """
        src, nodes, words, num, den = self.src, self.nodes, self.words, self.num, self.den
        askers = cut(pairs.select("grp", F.col("x").alias("k1")).distinct())
        asked = cut(pairs.select("grp", F.col("y").alias("k1")).distinct())
        asks = askers.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts"))
        held = asked.groupBy("grp").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
        blocks = cut(held.join(asks, "grp"))
        spread = lambda key, n: F.pmod(F.xxhash64(key, F.lit(7)), F.col(n)).cast("int")
        members = asked.join(blocks, "grp").withColumn("block", spread("k1", "blocks"))
        members = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("asks", F.lit(False))
        queries = askers.join(blocks, "grp").withColumn("salt", spread("k1", "salts"))
        queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
        key = ["grp", "block", "salt"]
        both = cut(members.select("k1", *key, "asks").unionByName(queries.select("k1", *key, "asks")))
        wanted = cut(both.select("k1").distinct().join(nodes.select("k1", "tag"), "k1"))
        texts = cut(src.where("text is not null").join(small(wanted), "tag").groupBy("k1").agg(F.min("text").alias("text")))

        def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, inner, union, least = None, [], None, 0
            for batch in batches:
                out = []
                for k, asks, text, *here in zip(batch["k1"].tolist(), batch["asks"].tolist(), batch["text"], *(batch[c].tolist() for c in key)):
                    if here != at:
                        at, inner, union = here, [], None
                    s = shingle_set(text, words)
                    if not asks:
                        inner.append((k, s))
                        continue
                    if not inner:
                        continue  # no member fell into this block
                    if union is None:
                        union = distinct(np.concatenate([t for _, t in inner]))
                        least = min(len(t) for _, t in inner)
                    place = np.minimum(np.searchsorted(union, s), len(union) - 1)
                    if int((union[place] == s).sum()) < _need(max(len(s), least), num, den):
                        continue  # the group stays closed
                    for y, t in inner:
                        if k != y and den * len(s) >= num * len(t) and den * len(t) >= num * len(s) and _links(s, t, num, den):
                            out.append((k, y))
                            break  # the members are of one group
                if out:
                    yield pd.DataFrame(out, columns=["a", "b"])

        rows = both.join(texts, "k1").repartition(*key).sortWithinPartitions(*key, "asks", "k1")
        return cut(rows.mapInPandas(trimmed(opened), "a long, b long"))


def _runs(key: list[str], task: Callable[[np.ndarray, dict, _Bitmaps], dict | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task over whole runs of equal keys of sorted batches: gets the run of each row, columns and bitmaps."""

    def work(frame: pd.DataFrame) -> pd.DataFrame | None:
        new = np.zeros(len(frame), dtype=bool)
        for c in key:
            v = frame[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        made = task(np.cumsum(new), {c: frame[c].to_numpy() for c in frame.columns if c != "bits"}, _Bitmaps(frame["bits"].tolist()))
        return None if made is None else pd.DataFrame(made).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch.iloc[-1][key]
            tail = np.flatnonzero(~(batch[key] == last).all(axis=1).to_numpy())
            from_ = int(tail[-1]) + 1 if len(tail) else 0
            if from_ == 0 and held and (held[0].iloc[0][key] == last).all():
                held.append(batch)
                continue
            done = work(pd.concat([*held, batch.iloc[:from_]], ignore_index=True)) if held or from_ else None
            held = [batch.iloc[from_:]]
            if done is not None:
                yield done
        if held:
            done = work(pd.concat(held, ignore_index=True))
            if done is not None:
                yield done

    return trimmed(run)


def _near(c: dict, bits: _Bitmaps, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs of rows of different groups may link by their sizes and bitmaps, and the bits they differ in."""
    n, m = c["n"][i], c["n"][j]
    ok = (c["grp"][i] != c["grp"][j]) & (den * n >= num * m) & (den * m >= num * n)
    i, j, n, m = i[ok], j[ok], n[ok], m[ok]
    apart = bits.apart(i, j)
    ok = apart <= n + m - 2 * -(-num * (n + m) // (num + den))
    return i[ok], j[ok], apart[ok]


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Two documents link if ``den * |A & B| >= num * |A | B|`` over their sets of
    distinct ``words``-word shingles. ``component_id`` is the smallest doc_id
    reachable by links. Null and empty texts have no shingles and link with
    nothing; a text of fewer words is one shingle. Rows with a null doc_id link
    like others; their component is null unless a known doc_id is reachable.
    Repeated rows stay repeated; other columns are ignored; an empty table
    gives no rows. Shingles are 64-bit hashes, a set is known by a 64-bit key.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    spark = docs.sparkSession

    size, parts = src.select(F.length("text").alias("n"), F.spark_partition_id().alias("p")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("p"), F.lit(0)) + 1).first()
    sketch = _Order(int(min(MOST_BITS, max(LEAST_BITS, 1 << int(size // 8).bit_length()))))

    def count(own: np.ndarray, batch: pd.DataFrame) -> None:
        for i in range(0, len(batch), 200):
            sketch.add(own, np.concatenate([shingle_set(t, words) for t in batch["text"].iloc[i : i + 200]]))

    order = spark.sparkContext.broadcast(_sketch.merged(src.select("text"), sketch.size(), "uint8", count, sketch.merge, sketch.levels, parts))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels, seen = _sketch.held(order, "uint8"), set()
        for batch in batches:
            out = []
            for doc_id, tag, text in zip(batch["doc_id"], batch["tag"], batch["text"]):
                s = shingle_set(text, words)
                n = len(s)
                if not n:
                    out.append((doc_id, tag, 0, None, None, None, None))
                    continue
                rank = sketch.ranks(levels, s)
                first = n - _need(n, num, den) + 1 - int((rank == 0).sum())
                k1, k2 = (np.add.reduce(mix(s, seed)).astype(np.uint64).view(np.int64) for seed in (11, 12))
                prefix = bits = None
                if first > 0 and (k1, k2) not in seen:  # copies carry nothing more
                    seen.add((k1, k2))
                    others = np.flatnonzero(rank)
                    prefix = s[others[np.argsort(rank[others], kind="stable")[:first]]].view(np.int64)
                    bits = _bitmap(s)
                out.append((doc_id, tag, n, k1, k2, prefix, bits))
            yield pd.DataFrame(out, columns=["doc_id", "tag", "n", "k1", "k2", "prefix", "bits"]).astype({"k1": "Int64", "k2": "Int64"})

    # ids travel as text: pandas would make longs with nulls floats
    made = src.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(trimmed(prefixes), "doc_id string, tag long, n long, k1 long, k2 long, prefix array<long>, bits binary")
    sets = cut(made.withColumn("doc_id", F.col("doc_id").cast("long")))
    nodes = cut(sets.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("tag").alias("tag"), F.min("n").alias("n"), F.min("bits").alias("bits")))
    # dealt by shingle once: distinct rows, their counts and the join all find them there
    rows = sets.where("bits is not null").select("k1", "n", F.explode("prefix").alias("tok")).repartition("tok").distinct()
    marks = [F.bit_xor(F.xxhash64("k1", F.lit(i))).alias(f"set{i}") for i in range(2)]
    live = rows.groupBy("tok").agg(F.count("*").alias("docs"), *marks).where("docs > 1")
    live = live.groupBy("docs", "set0", "set1").agg(F.min("tok").alias("tok")).select("tok", "docs")
    live = cut(rows.join(live, "tok"))  # shingles that meet nothing go, and all but one of those that the same sets have
    sweep(spark)  # here and below: each phase runs many small plans, whose memory the driver would keep
    bitmaps = nodes.where("bits is not null").groupBy("k1").agg(F.min("bits").alias("bits"))
    link = _Opener(src, nodes, words, num, den)

    def grouped(links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The group of every node, and the rows of shingles at which two groups meet."""
        groups = nodes.select("k1", F.col("k1").alias("grp"))
        if links is not None:
            comps = connected_components(links, "a", "b").withColumnRenamed("node", "k1")
            groups = groups.join(comps, "k1", "left").select("k1", F.coalesce("component", "grp").alias("grp"))
        groups = cut(groups.distinct())
        sweep(spark)
        at = live.join(groups, "k1")
        if links is not None:
            met = at.groupBy("tok").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("tok")
            at = at.join(met, "tok")
        return groups, at.join(bitmaps, "k1")

    def lead(run: np.ndarray, c: dict, bits: _Bitmaps) -> dict | None:
        start = np.searchsorted(run, run)
        best, to = np.full(len(run), np.iinfo(np.int64).max), np.full(len(run), -1)
        for s in range(LEADERS):
            i = np.flatnonzero(start + s < np.arange(len(run)))
            i, j, apart = _near(c, bits, i, start[i] + s, num, den)
            closer = apart < best[i]
            best[i[closer]], to[i[closer]] = apart[closer], j[closer]
        i = np.flatnonzero(to >= 0)
        return {"own": c["grp"][i], "apart": best[i], "x": c["k1"][i], "y": c["k1"][to[i]], "grp": c["grp"][to[i]]} if len(i) else None

    def meet(run: np.ndarray, c: dict, bits: _Bitmaps) -> dict | None:
        crossed = c["low"] != c["high"]
        i, s, found = np.arange(len(run)), 1, []
        while True:
            i = i[i + s < len(run)]
            i = i[run[i] == run[i + s]]
            if not len(i):
                break
            k = i[~crossed[i] | (c["block"][i] != c["block"][i + s])]
            a, b, _ = _near(c, bits, k, k + s, num, den)
            if len(a):
                found.append((a, b))
            s += 1
        if not found:
            return None
        a, b = (np.concatenate(x) for x in zip(*found))
        turn = c["grp"][a] > c["grp"][b]
        x, y = np.where(turn, a, b), np.where(turn, b, a)  # the smaller group is asked
        return {"x": c["k1"][x], "y": c["k1"][y], "grp": c["grp"][y]}

    links = None
    for _ in range(ROUNDS):
        groups, at = grouped(links)
        sizes = groups.groupBy("grp").agg(F.count("*").alias("size"))
        key = ["tok", "salt"]
        dealt = at.join(sizes, "grp").withColumn("salt", F.pmod(F.xxhash64("k1", F.lit(5)), F.ceil(F.col("docs") / CROWD)).cast("int"))
        dealt = dealt.select(*key, "size", "grp", "k1", "n", "bits").repartition(*key).sortWithinPartitions(*key, F.desc("size"), "grp", "k1")
        asked = dealt.mapInPandas(_runs(key, lead), "own long, apart long, x long, y long, grp long")
        asked = cut(asked.groupBy("own").agg(F.min(F.struct("apart", "x", "y", "grp")).alias("best")).select("best.*"))
        more = link(asked)
        links = more if links is None else links.unionByName(more)
        sweep(spark)
    groups, at = grouped(links)
    key = ["tok", "low", "high"]
    blocks = F.ceil(F.col("docs") / BLOCK).cast("int")
    dealt = at.withColumn("block", F.pmod(F.xxhash64("k1", F.lit(6)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("tok", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "k1", "n", "grp", "bits")
    met = dealt.repartition(*key).sortWithinPartitions(*key, "n", "k1").mapInPandas(_runs(key, meet), "x long, y long, grp long")
    links = links.unionByName(link(cut(met.distinct())))
    sweep(spark)
    comps = connected_components(links, "a", "b").withColumnRenamed("node", "k1")
    known = cut(nodes.join(comps, "k1", "left").select("k1", "k2", "rep", F.coalesce("component", "k1").alias("comp")))
    sweep(spark)
    least = known.groupBy("comp").agg(F.min("rep").alias("component_id"))
    rep = known.join(least, "comp").select("k1", "k2", "component_id")
    return (
        sets.join(rep, ["k1", "k2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def keep_first_of_group(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the documents whose component holds a smaller doc_id.

    Rows without a doc_id stay; repeated rows of a kept doc_id stay as they are.
    """
    gone = jaccard_components(docs, words, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small(cut(gone)), "doc_id", "left_anti").select(docs.columns)
