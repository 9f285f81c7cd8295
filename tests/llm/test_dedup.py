"""Line, near-duplicate and substring deduplication against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from domweave.llm import line_dedup, simhash, substring_dedup
from tests.llm import brute


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_lines(docs, rows, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")
    assert sorted(got, key=key) == sorted(brute.lines(pairs(rows)), key=key)
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_in_any_number_of_batches(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, 10**15]) * k, "\n".join(rng.choices("abcdefghij", k=4))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = line_dedup.dedup_lines(df, batches=7, fanout=2)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(brute.lines(rows))


def test_runs_are_compacted_and_opened_again(spark, tmp_path):
    hashes = lambda ks: spark.createDataFrame([(k, -k, k, 0) for k in ks], line_dedup.RUN)
    runs = line_dedup.SortedRuns(spark, str(tmp_path / "a b.runs"), fanout=2)
    for batch in ([1, 2], [2, 3], [4], [1, 5], [6]):
        runs.add(hashes(batch))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r.h1 for r in runs.contents().collect()) == [1, 2, 3, 4, 5, 6]
    runs.save()
    runs.vacuum()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        again = line_dedup.SortedRuns(spark, str(tmp_path / "a b.runs"), fanout=2)
        assert again.levels == runs.levels and again.buckets == runs.buckets
        again.add(hashes([6, 7, 7]))
        assert sorted(r.h1 for r in again.contents(again.added).collect()) == [7] and again.contents().count() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lines_of_earlier_calls_go(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = spark.createDataFrame([(1, "a\nb"), (None, "z\nb"), (2, "c\nc")], "doc_id bigint, text string")
    second = spark.createDataFrame([(1, "a\nd\nz"), (3, "d\n \nc"), (4, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(first, path=path).collect()) == [(0, "z\nb"), (1, "a"), (2, "c")]
    out = line_dedup.dedup_lines(second, path=path).collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == [(1, "d"), (3, " "), (4, "")]


def test_equal_lines_meet_before_they_move(spark):
    df = spark.createDataFrame([(k, "hot\nline") for k in range(20)], "doc_id bigint, text string")
    plan = line_dedup.firsts(line_dedup.line_hashes(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan


def test_near(docs, rows, none):
    got = sorted((r.doc_id, r.duplicate_of) for r in simhash.duplicates(docs).collect())
    want = brute.near(pairs(rows))
    assert got == sorted((d, e) for (d, _), (e, _) in want.items()) and len(want) >= 15
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    named = sorted((r.doc_id, r.text or "") for r in kept.where("doc_id IS NOT NULL").collect())
    assert named == sorted((d, t or "") for d, t in {x for x in pairs(rows) if x[0] is not None} - set(want))
    assert kept.where("doc_id IS NULL").count() == 2
    assert simhash.duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_rows_that_share_an_id(spark):
    text = " ".join(f"word{k}" for k in range(50))
    rows = [(1, text, "a"), (1, text, "b"), (1, text + " end", "c"), (1, "quite another text", "d"), (2, "quite another text", "e"), (2, "third thing", "f"), (3, None, "g"), (3, None, "g"), (3, "...", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, x string").withColumns({"m": F.create_map(F.lit("k"), "x"), "a.b": F.array(F.create_map("x", F.lit(1))), "__row": F.lit(1), "h": F.lit(2), "a": F.lit(3)})
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    stays = min((text, text + " end"), key=brute.spark_hash)
    x = "a" if stays == text else "c"
    assert sorted((r.doc_id, r.text or "", r.x, r.m) for r in out.collect()) == sorted([(1, stays, x, {"k": x}), (1, "quite another text", "d", {"k": "d"}), (2, "third thing", "f", {"k": "f"}), (3, "", "g", {"k": "g"}), (3, "...", "h", {"k": "h"})])


def test_near_pairs_are_all_found(spark):
    rng = random.Random(2)
    prints = []
    for k in range(60):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        prints.append((a, b))
        for _ in range(4):
            c, d = a, b
            for bit in rng.sample(range(64), rng.randint(0, 9)):
                c ^= 1 << bit
            for bit in rng.sample(range(64), rng.randint(0, 16)):
                d ^= 1 << bit
            prints.append((c, d))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(k, signed(a), signed(b)) for k, (a, b) in enumerate(prints)], "key bigint, a bigint, b bigint")
    want = [(i, j) for j, (c, d) in enumerate(prints) for i, (a, b) in enumerate(prints[:j]) if (a ^ c).bit_count() <= simhash.RADIUS and (b ^ d).bit_count() <= 2 * simhash.RADIUS]
    for agree in (1, 2, 3):
        assert sorted(tuple(r) for r in simhash.near_pairs(df, agree=agree).collect()) == sorted(want)
    assert [simhash.agreeing(n) for n in (10**5, 10**8)] == [2, 4] and simhash.agreeing(10**7) == 3


def test_exploded_rows_are_not_broadcast(spark):
    # sized as the few bytes before the explode, they would be at Spark's default threshold
    df = spark.range(50).selectExpr("id AS key", "id * 7919 AS a", "id AS b")
    plan = simhash.near_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 50)] + [(100 + k, 130 - k) for k in range(15)] + [(5, 5)]
    out = simhash.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()
    roots = {r.key: r.root for r in out}
    assert all(roots[k] == 0 for k in range(1, 51)) and all(roots[130 - k] == 100 + k for k in range(15))


def test_edited_copies_are_found_and_others_are_not(spark):
    rng = random.Random(9)
    vocabulary = [f"term{k}" for k in range(5000)]
    of, texts, found = simhash.Fingerprints().of, [rng.choices(vocabulary, k=300) for _ in range(200)], 0
    distance = lambda p, q: ((p[0] ^ q[0]) & (2**64 - 1)).bit_count()
    prints = [of(" ".join(t)) for t in texts]
    for t, p in zip(texts, prints):
        edited = list(t)
        for k in rng.sample(range(300), 4):
            edited[k] = "edited"
        found += distance(p, of(" ".join(edited))) <= simhash.RADIUS
    assert found >= 190
    assert not any(distance(p, q) <= simhash.RADIUS for k, p in enumerate(prints) for q in prints[:k])


@pytest.mark.parametrize("least", [substring_dedup.LEAST_WORDS, 5])
def test_spans(docs, rows, none, least):
    found = substring_dedup.duplicate_spans(docs, least).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.start_word)):
        assert r.end_word - r.start_word == r.n_words and r.ref_doc_id < r.doc_id and r.n_factors >= 1
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    want = brute.spans(pairs(rows), least)
    assert got == want and len(want) >= 15
    if least == 5:
        assert substring_dedup.duplicate_spans(none).count() == 0


def _factors(df, least):
    out = {}
    for r in substring_dedup.factors(df, least).collect():
        out.setdefault(r.doc_id, []).append([(f.start, f.end) for f in r.span])
    return {d: sorted(x) for d, x in out.items()}


@pytest.mark.parametrize("tasks", [4, 13])
def test_a_copy_is_one_factor(spark, tasks):
    rng = random.Random(7)
    shared, text = [str(rng.random()) for _ in range(60)], [str(rng.random()) for _ in range(2000)]
    text[500:500] = shared
    rows = [(1, " ".join(["a"] * 5 + shared + ["b"] * 9)), (2, " ".join(text)), (3, " ".join(text)), (4, " ".join(text[:900] + ["cut"] + text[900:]))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
        assert _factors(spark.createDataFrame(rows, "doc_id bigint, text string"), 50) == {2: [[(500, 560)]], 3: [[(0, 2060)]], 4: [[(0, 900)], [(901, 2061)]]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_factors_of_a_plain_parser(spark):
    rng = random.Random(5)
    passages = [[f"p{k}w{j}" for j in range(rng.randint(3, 25))] for k in range(12)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.7 else [str(rng.random()) for _ in range(rng.randint(1, 9))]
        rows.append((d, " ".join(words if d % 4 or d == 0 else rows[rng.randrange(d)][1].split() + words)))
    got = _factors(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 6)
    want = brute.parse(rows, 6)
    assert got == want and sum(len(s) > 1 for x in want.values() for s in x) > 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 20), st.integers(0, 3)), max_size=12))
def test_parse(matches):
    spans = substring_dedup.parse([(a, a + n, r, a + 100) for a, n, r in matches])
    covered = {k for a, n, _ in matches for k in range(a, a + n)}
    assert {k for s in spans for a, b, *_ in s for k in range(a, b)} == covered
    flat = [f for s in spans for f in s]
    assert all(a[1] <= b[0] for a, b in zip(flat, flat[1:])) and all(x[1] == y[0] for s in spans for x, y in zip(s, s[1:]))
    assert all(any(a <= f[0] and f[1] == a + n and r == f[2] and f[3] - f[0] == 100 for a, n, r in matches) for f in flat)


def test_spans_across_chunks(spark, monkeypatch):
    rng = random.Random(3)
    shared = [str(rng.random()) for _ in range(500)]
    rows = [(1, " ".join(shared)), (2, " ".join(["a"] * 7 + shared + ["b"])), (3, " ".join(shared[100:160] + shared[300:340]))]
    # parts of a long document overlap, so that no window is lost where it is cut
    monkeypatch.setattr(substring_dedup, "CHUNK", 90)
    out = substring_dedup.duplicate_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in out) == [(2, 7, 507), (3, 0, 60)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.integers(1, 8))
def test_windows(words, least):
    hashed = np.array([substring_dedup._mix(np.array([w], dtype=np.uint64))[0] for w in words], dtype=np.uint64)
    start, whole, anchor = substring_dedup.windows(hashed, np.zeros(len(words), dtype=np.int64), least)
    assert start.tolist() == list(range(max(0, len(words) - least + 1)))
    for i in start:
        for j in start:
            if words[i : i + least] == words[j : j + least]:
                assert whole[i] == whole[j] and anchor[i] == anchor[j]
            else:
                assert whole[i] != whole[j]


def test_pivot_distances_bound_the_distance(spark):
    df = spark.createDataFrame([(k, random.Random(k).getrandbits(63)) for k in range(50)], "key bigint, a bigint")
    table = simhash.with_pivot_table(df).collect()
    for k, p in enumerate(simhash.pivot_fingerprints()):
        for r in table:
            assert r[f"t{k // 8}"] >> (7 * (k % 8)) & 127 == (r.a ^ p).bit_count()
