"""Line, substring and near dedup against their plain restatements, and on odd inputs."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salegrain.llm import near_dedup as near
from salegrain.llm.common import Scratch, documents_of
from salegrain.llm.components import connected_components
from salegrain.llm.line_dedup import LineIndex, dedup_lines
from salegrain.llm.sorted_runs import SortedRuns
from salegrain.llm.substring_dedup import SubstringIndex, dedup_substrings

from . import brute


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_lines_equal_brute_force(docs_of, corpus):
    found = dedup_lines(docs_of(corpus, extra=True))
    assert rows(found, "doc_id", "n_lines", "n_dropped", "kept") == sorted(brute.line_dedup(corpus), key=str)
    assert found.agg(F.sum("n_dropped")).first()[0] > 10


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (5, 2)])
def test_lines_do_not_depend_on_batches(docs_of, corpus, batches, fanout):
    found = dedup_lines(docs_of(corpus), batches=batches, fanout=fanout)
    assert rows(found, "doc_id", "n_dropped", "kept") == sorted(((d, k, t) for d, _, k, t in brute.line_dedup(corpus)), key=str)


def test_lines_of_repeated_rows_and_null_ids(docs_of):
    line = "x" * 40
    found = dedup_lines(docs_of([(None, line), (1, line), (1, line), (2, line), (3, line + "\nend")]))
    assert rows(found, "doc_id", "n_dropped", "kept") == sorted([(None, 1, ""), (1, 1, ""), (1, 1, ""), (2, 1, ""), (3, 0, line + "\nend")], key=str)


def test_lines_keep_other_columns_on_request(docs_of, corpus):
    found = dedup_lines(docs_of(corpus, extra=True), carry=True)
    assert rows(found, "doc_id", "_row.h1", "_row.kept", "_row.lang")[0][1:] == ("h1", "kept", "en")


def test_substrings_equal_brute_force(docs_of, corpus):
    found = dedup_substrings(docs_of(corpus, extra=True))
    assert rows(found, "doc_id", "n_words", "n_removed", "kept") == sorted(brute.substring_dedup(corpus), key=str)


@pytest.mark.parametrize(("window", "gram"), [(8, 3), (5, 5), (20, 5)])
def test_substrings_of_other_windows(docs_of, corpus, window, gram):
    found = dedup_substrings(docs_of(corpus), window=window, gram=gram, batches=3)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept") == sorted(brute.substring_dedup(corpus, window), key=str)


def test_substrings_in_few_words(docs_of):
    rng = np.random.default_rng(1)
    pairs = [(i, " ".join(rng.choice(["a", "b"], rng.integers(0, 90)))) for i in range(40)]
    found = dedup_substrings(docs_of(pairs), window=6, gram=3)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept") == sorted(brute.substring_dedup(pairs, 6), key=str)


def test_substrings_of_repeated_rows_and_null_ids(docs_of):
    text = " ".join(map(str, range(30)))
    found = dedup_substrings(docs_of([(None, text), (4, text), (4, text), (5, None)]))
    assert rows(found, "doc_id", "n_words", "n_removed") == sorted([(None, 30, 0), (4, 30, 30), (4, 30, 30), (5, 0, 0)], key=str)


@pytest.mark.parametrize("ids", [[None], [7], [None, 7]])
def test_substrings_of_many_rows_of_one_id(docs_of, ids):
    """3,000 different texts of an id: what one of them holds twice goes, and what several hold goes from all but one."""
    rng = np.random.default_rng(8)
    shared = " ".join(f"s{i}" for i in range(30))
    pairs = [(ids[i % len(ids)], " ".join(f"w{i}-{k}" for k in range(rng.integers(1, 60)))) for i in range(3000)]
    pairs[5::100] = [(doc, f"{text} {shared}") for doc, text in pairs[5::100]]
    found = dedup_substrings(docs_of(pairs))
    lost = [r.n_removed for r in found.collect() if r.n_removed]
    assert found.count() == 3000 and lost == [30] * 29


def test_substrings_across_batches(docs_of):
    """Contexts that come in other batches than those that they repeat: equal, longer, and with another anchor's end."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(200)]
    pairs = []
    for i in range(40):
        a, b = sorted(rng.integers(0, 200, 2))
        pairs.append((i, " ".join(words[a : b + 1] + [f"own{i}"] * (i % 3) + words[:: 1 + i % 4][: 10 + i])))
    for batches, fanout in ((1, 2), (4, 2), (7, 3)):
        found = dedup_substrings(docs_of(pairs), batches=batches, fanout=fanout)
        assert rows(found, "doc_id", "n_words", "n_removed", "kept") == sorted(brute.substring_dedup(pairs, 20), key=str)


def test_runs_meet_without_shuffle_or_sort(spark, docs_of, corpus):
    """A staged batch meets the runs, and runs are merged, bucket by bucket."""
    lines = LineIndex(spark, 10, 2)
    for low, high in ((200, 400), (100, 200)):
        lines.add(lines.hashes(docs_of([p for p in corpus if low <= p[0] < high])))
    staged = lines.runs.stage(lines.hashes(docs_of([p for p in corpus if p[0] < 100])).select("h1", "h2", F.lit(1).cast("long").alias("n_docs"), F.col("_id").alias("last_id")))
    anchors = SubstringIndex(spark)
    batch = lambda low, high: anchors.anchors(documents_of(docs_of([p for p in corpus if low <= p[0] < high])).withColumn("batch", F.lit(0)))
    anchors.add(anchors.stage(batch(0, 100)))
    for df in (lines.unseen(staged), lines.runs.read(), anchors.meet(anchors.stage(batch(100, 400)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    for df in (lines.unseen(staged), anchors.meet(anchors.stage(batch(200, 400)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Sort [" not in plan
    assert lines.unseen(staged).count() > 0


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_equals_brute_force(docs_of, corpus, width, percent):
    found = near.near_dedup(docs_of(corpus, extra=True), width, percent)
    want = brute.near_dedup(corpus, width, percent)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(((d, n, c, c == d) for d, (n, c) in want.items()), key=str)
    assert len({c for _, c in want.values()}) < len(want) - 5


def test_near_of_crowded_buckets(docs_of):
    """Half-similar texts share buckets; the similar pairs among them are found through the finer bands."""
    rng = np.random.default_rng(5)
    core = [f"c{i}" for i in range(60)]
    pairs = []
    for i in range(60):
        own = [f"d{i}-{k}" for k in range(12)]
        text = " ".join(core + own)
        pairs += [(2 * i, text), (2 * i + 1, text + f" e{i}")]
    order = rng.permutation(len(pairs))
    coarse = near.Banding(rows=2, bands=100, small=2)
    found = near.near_dedup(docs_of([pairs[i] for i in order]), 3, 85, coarse)
    want = brute.near_dedup(pairs, 3, 85)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(d, c) for d, (_, c) in want.items()}


def test_near_of_crowds_that_centres_leave_divided(docs_of):
    """Every text shares buckets with all others, and one centre a bucket finds next to none of the pairs."""
    rng = np.random.default_rng(6)
    core = [f"c{i}" for i in range(60)]
    pairs = []
    for i in range(60):
        text = " ".join(core + [f"d{i}-{k}" for k in range(12)])
        pairs += [(2 * i, text), (2 * i + 1, text + f" e{i}")]
    order = rng.permutation(len(pairs))
    coarse, fine = near.Banding(rows=1, bands=3, small=2), near.Banding(rows=1, bands=2, small=2, centres=1)
    found = near.near_dedup(docs_of([pairs[i] for i in order]), 3, 85, coarse, fine)
    want = brute.near_dedup(pairs, 3, 85)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(d, c) for d, (_, c) in want.items()}


def test_near_of_crowds_at_80_percent_needs_no_fine_bands(docs_of):
    """Pairs little above 0.8 within a crowd share a band of 16 rows rarely; they are found without one."""
    rng = np.random.default_rng(7)
    core = [f"c{i}" for i in range(60)]
    pairs = []
    for i in range(60):
        own = [f"d{i}-{k}" for k in range(12)]
        pairs += [(2 * i, " ".join(core + own)), (2 * i + 1, " ".join(core + own[:5] + [f"e{i}-{k}" for k in range(7)]))]
    order = rng.permutation(len(pairs))
    coarse, fine = near.Banding(rows=1, bands=6, small=2), near.Banding(rows=16, bands=1, small=16)
    found = near.near_dedup(docs_of([pairs[i] for i in order]), 5, 80, coarse, fine)
    want = brute.near_dedup(pairs, 5, 80)
    assert len({c for _, c in want.values()}) == 60
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(d, c) for d, (_, c) in want.items()}


@pytest.mark.parametrize(("width", "percent", "core", "own"), [(3, 85, 402, 36), (5, 80, 404, 51)])
def test_near_of_a_crowd_just_below_the_threshold(docs_of, width, percent, core, own):
    """800 texts on one core, any two little less similar than asked; 400 pairs share a word more and are linked."""
    rng = np.random.default_rng(11)
    common = [f"c{i}" for i in range(core)]
    pairs = [(i, " ".join([*common, f"p{i // 2}", *[f"d{i}-{k}" for k in range(own - 1)]])) for i in range(800)]
    sets = [brute.shingles(text, width) for _, text in pairs[:3]]
    similar = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    assert similar(sets[0], sets[1]) and not similar(sets[1], sets[2])
    found = near.near_dedup(docs_of([pairs[i] for i in rng.permutation(800)]), width, percent)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, i // 2 * 2) for i in range(800)}


def test_near_of_repeated_rows_and_null_ids(docs_of):
    text = "some words that stand in a row for a while"
    found = near.near_dedup(docs_of([(None, text), (9, text), (9, text), (3, text), (9, "quite another text of some words")]), 3, 85)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in found.collect())
    assert got == Counter({(None, None, True): 1, (9, 3, False): 3, (3, 3, True): 1})


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=9), min_size=1, max_size=12))
def test_shingle_sets_match_tuples(texts):
    import pyarrow as pa

    from salegrain.llm.words import SPACED_FOLDED, Words, text_arrays

    column = pa.array([" ".join(t) for t in texts])
    values, bounds = near.shingle_sets(Words(*text_arrays(column), SPACED_FOLDED), 3)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    want = [brute.shingles(" ".join(t), 3) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    assert [[a == b for b in sets] for a in sets] == [[a == b for b in want] for a in want]


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:1500], rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    values, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    mixed = [np.unique(near.mix(x)) for x in (a, b)]
    sign = near.signatures(np.concatenate(mixed), bounds, 1024)
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sign[0] == sign[1]).mean() - truth) < 0.07


def test_densified_signatures_are_full():
    for n in (1, 2, 5):
        values = np.sort(near.mix(np.arange(1, n + 1, dtype=np.uint64)))
        assert (near.signatures(values, np.array([0, n]), 256) != 0).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (5, 5), *((i, i + 1) for i in range(100, 160)), *((1000, i) for i in range(1001, 1100))]
    found = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, **{i: 100 for i in range(100, 161)}, **{i: 1000 for i in range(1000, 1100)}}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_runs_are_compacted_by_level(spark):
    runs = SortedRuns(spark, "t", ["k"], {"n": "sum"}, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(i % 3, 1), (7, 1), (7, 1)], "k long, n long"))
    assert [len(level) for level in runs.levels] == [1, 2]
    assert [{r.k: r.n for r in run.collect()}[7] for run in runs.runs()] == [4, 4, 2]
    assert {r.k: r.n for r in runs.read().collect()} == {0: 2, 1: 2, 2: 1, 7: 10}
    runs.compact()
    assert sum(map(len, runs.levels)) == 1
    assert runs.read().select(F.spark_partition_id()).distinct().count() > 1
    assert "Sort" not in runs.read().sortWithinPartitions("k")._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(docs_of):
    none = docs_of([])
    assert dedup_lines(none).count() == dedup_substrings(none).count() == near.near_dedup(none).count() == 0
