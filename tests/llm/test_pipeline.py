"""Every stage keeps its word: columns, rows, effects; the whole against brute force."""

import collections
import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as p
from statloom.llm import queries as q
from statloom.llm.mixing import word_count
from tests.llm import nasty
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_substrings import brute as repeats


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    one = p.quality(spark, docs, sf)
    kept = {r.doc_id for r in one.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [(i in kept) == bool(y) for i, y in labels.items()]
    assert sum(right) >= 0.95 * len(right)
    two = p.near_duplicates(spark, docs, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in two.collect()) == sorted(i for i, (_, c) in groups(rows, 5, 80, 100).items() if i == c)
    three = p.repeated_substrings(spark, docs, sf)
    want = {i: (dict(rows)[i] if not gone else kept) for i, (n, gone, kept) in repeats(rows, 50).items() if gone == 0 or gone < n}
    assert {r.doc_id: r.text for r in three.collect()} == want
    assert all(r.n_chars == len(r.text) for r in three.collect())
    four = p.mixture(spark, docs, sf)
    assert 0 < four.count() < docs.count()
    for df in (one, two, three, four):
        assert df.columns == columns


def test_stages_on_awkward_documents(spark, sf):
    docs, none = nasty.docs(spark).drop("__row"), nasty.none(spark).drop("__row")
    known = [r for r in nasty.rows() if r[0] is not None]
    texts = {r[0]: r[1] for r in known}
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and got.schema["text"].dataType == docs.schema["text"].dataType
        rows = got.collect()
        assert rows, name
        for r in rows:  # no column of the stage's own names is touched
            assert (r.score, r.predicted, r.tokens, r.copies, r.n_words, r.n_removed, r.kept, r.whole, r.bucket, r.stop) == (0.5, 1, 1, 1, 1, 1, "k", 1, "b", "s")
            if name != "substring dedup" and r.doc_id is not None:
                assert r.text == texts[r.doc_id]
        assert stage(spark, none, sf).count() == 0
    groups_of = groups([(r[0], r[1]) for r in known], 5, 80, 100)
    two = [r.doc_id for r in p.near_duplicates(spark, docs, sf).collect()]
    firsts = [r[0] for r in known if groups_of[r[0]][1] == r[0]]
    assert sorted(i for i in two if i is not None) == sorted(firsts) and two.count(None) == 1
    want = repeats([(r[0], r[1]) for r in known], 50)
    three = p.repeated_substrings(spark, docs, sf).collect()
    assert {r.doc_id: r.text for r in three if r.doc_id is not None} == {i: (texts[i] if not gone else kept) for i, (n, gone, kept) in want.items() if gone == 0 or gone < n}
    last = p.packing(spark, docs, sf)
    assert last.groupBy("doc_id").count().count() == len({r[0] for r in nasty.rows()})
    assert p.packing(spark, none, sf).count() == 0


def test_mixture_takes_what_the_budgets_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id for r in p.mixture(spark, docs, sf).collect()}
    rows = [(r.doc_id, r.domain, r.lang, r.source, r.t) for r in docs.select("doc_id", q.mix_levels()["domain"].alias("domain"), "lang", "source", word_count(F.col("text")).alias("t")).collect()]
    leaves = collections.defaultdict(list)
    for i, *path, t in rows:
        leaves[tuple(path)].append((hashlib.md5(f"{q.MIX_SEED}/0/{i}".encode()).hexdigest(), i, t))

    def share(budget, paths, level):
        """Water filling by hand: the budgets of the leaves below a node."""
        if level == 3:
            return {paths[0]: budget}
        kids = collections.defaultdict(list)
        for path in paths:
            kids[path[level]].append(path)
        have = {k: sum(t for path in v for _, _, t in leaves[path]) for k, v in kids.items()}
        table = q.MIX_WEIGHTS.get(("domain", "lang", "source")[level], {})
        weight = {k: float(table.get(k, table.get("*", 0))) if table else 1.0 for k in kids}
        got, open_ = dict.fromkeys(kids, 0.0), {k for k in kids if weight[k] > 0 and have[k] > 0}
        left = budget
        while open_ and left > 1e-9:
            total = sum(weight[k] for k in open_)
            full = {k for k in open_ if got[k] + left * weight[k] / total >= have[k] - 1e-9}
            if not full:
                for k in open_:
                    got[k] += left * weight[k] / total
                break
            for k in full:
                left -= have[k] - got[k]
                got[k] = float(have[k])
            open_ -= full
        return {path: n for k, v in kids.items() for path, n in share(got[k], v, level + 1).items()}

    total = sum(t for *_, t in rows)
    for path, quota in share(float(int(total * p.SHARE)), list(leaves), 0).items():
        upto, want = 0, set()
        for _, i, t in sorted(leaves[path]):
            upto += t
            if upto > int(quota + 1e-6):
                break
            want.add(i)
        if upto <= 0 or int(quota + 1e-6) == 0:
            want = set()
        assert {i for _, i, _ in leaves[path]} & taken == want, path


def test_run(spark, sf):
    got = p.run(spark, sf).collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(p.STAGES) == 5


def test_packing_starts_on_swept_heaps(spark):
    import gc
    import time

    jvm = spark.sparkContext._jvm  # a local session has its executor here
    left = jvm.java.lang.Object()
    weak = jvm.java.lang.ref.WeakReference(left)
    jvm.System.gc()  # what is old stays until the next full collection
    del left
    gc.collect()
    time.sleep(1)  # until the JVM hears that Python let go
    p.packing(spark, spark.createDataFrame([], "doc_id long, text string"), "")
    assert weak.get() is None
