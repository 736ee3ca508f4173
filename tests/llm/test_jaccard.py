"""The Jaccard join against brute force over exact shingle sets."""

import collections
import random
import re

import pytest

from statloom.llm.jaccard import jaccard_components, keep_first_of_group
from tests.llm import nasty


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = collections.defaultdict(list)
    for i, x in sorted(sets.items()):
        for j, n in collections.Counter(j for s in x for j in inverted[s]).items():
            if den * n >= num * (len(x) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for s in x:
            inverted[s].append(i)
    return {i: (len(x), root(i)) for i, x in sets.items()}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_awkward_documents(spark, k, num, den):
    got = jaccard_components(nasty.docs(spark), k, num, den).collect()
    assert len(got) == len(nasty.rows())
    want = brute([(r[0], r[1]) for r in nasty.rows() if r[0] is not None], k, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    lost = next(r for r in got if r.doc_id is None)
    assert lost.component_id == 0  # it is a copy of document 0


def test_chains_at_the_threshold(spark):
    rnd = random.Random(7)
    rows, base = [], [f"w{i}" for i in range(150)]
    for i in range(60):  # a chain: each differs a little from the one before, and noise
        base = list(base)
        for _ in range(rnd.randrange(1, 4)):
            base[rnd.randrange(len(base))] = f"v{i}{rnd.randrange(99)}"
        rows.append((i * 7 % 60, " ".join(base[: 150 - i % 9])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_links_to_a_middle_sized_member(spark):
    rows = []
    for i in range(24):  # y alone links to x, and needs fewer shared prefix words than w and z, between which its size lies
        common, name = [f"s{i}n{j}" for j in range(20)], lambda *xs, i=i: [f"{x}i{i}" for x in xs]
        edits = name("u1", "u2", "u3", "u4")
        x, y, w, z = name("x1") + common, edits + common, edits + name("a1") + common[2:], edits + name("v1", "v2") + common[1:]
        fill = [common + [f"f{i}n{k}n{j}" for j in range(100)] for k in range(12)]
        rows += [(1000 * i + j, " ".join(t)) for j, t in enumerate([x, y, w, z, *fill])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80, 100).collect()}
    want = brute(rows, 1, 80, 100)
    assert all(want[1000 * i + j][1] == 1000 * i for i in range(24) for j in range(4))
    assert got == want


def test_first_of_group_stays_and_nothing_of_nothing(spark):
    rows = [(5, "a b c d e f g"), (2, "A b c d e f g"), (9, "other words here"), (4, "")]
    kept = keep_first_of_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 9]
    assert jaccard_components(nasty.none(spark)).count() == 0


def families(seed, n, sizes, vocabulary):
    """Families of copies with words changed, cut and added, so that sizes in a family differ; many links lie near the threshold."""
    rnd = random.Random(seed)
    rows = []
    for f in range(n):
        base = [f"f{f}w{rnd.randrange(vocabulary)}x{i}" for i in range(rnd.randrange(*sizes))]
        for _ in range(rnd.randrange(2, 9)):
            t = list(base)
            for _ in range(rnd.randrange(4)):
                t[rnd.randrange(len(t))] = f"e{rnd.randrange(10**6)}"
            t = t[: len(t) - rnd.randrange(3)] + [f"a{rnd.randrange(10**6)}" for _ in range(rnd.randrange(3))]
            rows.append((len(rows), " ".join(t)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "num", "den", "sizes"), [(1, 90, 100, (15, 50)), (3, 90, 100, (20, 140)), (5, 80, 100, (12, 90)), (1, 80, 100, (5, 30))])
def test_families_of_mixed_sizes(spark, k, num, den, sizes):
    rows = families(k + num, 40, sizes, 30)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_blocks_of_crowded_shingles(spark, monkeypatch):
    from statloom.llm import jaccard

    for name, value in (("BLOCK", 3), ("CROWD", 5), ("LEADERS", 1), ("MEMBERS", 2), ("QUERIES", 2), ("ROUNDS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    rows = families(5, 6, (20, 40), 5)
    common = " ".join(f"c{i}" for i in range(30))
    rows += [(1000 + i, f"{common} u{i} v{i}") for i in range(25)]  # all share all but two words
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, 100).collect()}
    assert got == brute(rows, 1, 85, 100)


def test_a_group_that_asks_for_the_least_shared_shingle(spark):
    words = [f"w{i}" for i in range(29)]
    rows = []
    for i in range(12):
        w = [f"{x}f{i}" for x in words]
        f, a = [f"{x}{i}" for x in ("p", "q", "r")], [f"z{i}"]
        for j, t in enumerate((w + a, f[:2] + w, f[:2] + w[:27], f + w)):
            rows.append((100 * i + j, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_rows_without_an_id_link(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text), (None, text + " more"), (None, "alone here"), (9, text + " more and")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == {(7, 58): 7, (None, 59): 7, (None, 1): None, (9, 60): 7}


def test_bitmaps_never_overstate(spark):
    import numpy as np

    from statloom.llm.jaccard import _bitmap, _Order

    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 2**63, 900).astype(np.uint64)
    for n in (0, 1, 5, 40, 300, 900):
        b = np.concatenate((a[n:], rnd.integers(0, 2**63, n // 2).astype(np.uint64)))
        bits = [np.frombuffer(_bitmap(np.sort(x)), dtype=np.uint8) for x in (a, b)]
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))
    o = _Order(1 << 12)
    one, two, both = (np.zeros(o.size(), dtype=np.uint8) for _ in range(3))
    sets = [np.unique(rnd.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(6)]
    for s in sets[:3]:
        o.add(one, s)
    o.add(two, np.concatenate(sets[2:]))
    o.add(both, np.concatenate(sets[:3]))
    o.add(both, np.concatenate(sets[2:]))
    merged = o.merge(one.copy(), two)
    assert all((x == y).all() for x, y in zip(o.parts(merged)[:2], o.parts(both)[:2]))  # the counts are estimates
    levels = o.levels(merged)
    seen = collections.Counter(x % 4096 for s in [*sets[:3], *sets[2:]] for x in s.tolist())
    for s in sets:
        assert ((o.ranks(levels, s) == 0) == np.array([seen[x % 4096] == 1 for x in s.tolist()])).all()


def test_the_driver_lets_go_of_finished_phases(spark, monkeypatch):
    from statloom.llm import jaccard
    from statloom.plans import graph, lineage

    plans, most, real = [0], [], (lineage.cut, lineage.sweep)

    def cut(df):
        plans[0] += 1
        return real[0](df)

    def sweep(session):
        real[1](session)
        most.append(plans[0])
        plans[0] = 0

    monkeypatch.setattr(jaccard, "cut", cut)
    monkeypatch.setattr(graph, "cut", cut)
    monkeypatch.setattr(jaccard, "sweep", sweep, raising=False)
    rows = families(5, 6, (20, 40), 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, 100).collect()}
    assert got == brute(rows, 1, 85, 100)
    assert max([*most, plans[0]]) <= 12  # stored tables between two sweeps
    assert lineage.trim(spark)


def test_long_documents_with_one_passage_in_common_are_not_opened(spark, monkeypatch):
    from statloom.llm import jaccard as J

    rnd, asked = random.Random(3), []
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{rnd.randrange(10**9)}" for _ in range(5000 + 100 * i))) for i in range(24)]
    rows.append((24, rows[7][1] + " and a few words more"))
    call = J._Opener.__call__
    monkeypatch.setattr(J._Opener, "__call__", lambda self, pairs: asked.append(pairs.count()) or call(self, pairs))
    monkeypatch.setattr(J, "LEAST_BITS", 1 << 12)
    monkeypatch.setattr(J, "MOST_BITS", 1 << 12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == brute(rows, 5, 80, 100)
    assert max(asked) <= 2


def test_bitmaps_never_differ_in_more_than_their_sets():
    import numpy as np

    from statloom.llm.jaccard import BITMAP, _bitmap, _Bitmaps

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    sets = [base[a:b] for a, b in ((0, 1), (0, 900), (100, 1400), (0, 1024), (0, 1025), (200, 5000), (300, 9000), (30_000, 40_000))]
    maps = _Bitmaps([_bitmap(s) for s in sets])
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            apart = int(maps.apart(np.array([i]), np.array([j]))[0])
            assert apart <= len(np.setxor1d(x, y)) and (i != j or apart == 0)
    assert int(maps.apart(np.array([6]), np.array([7]))[0]) > 4000  # unlike sets of 8,700 and 10,000
    assert len(_bitmap(sets[0])) == BITMAP
