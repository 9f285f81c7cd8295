"""The pipeline against a plain version of its stages, one after the other."""

import corpus_pipeline
from domweave.llm import packing, toxicity
from tests.llm import brute
from tests.llm.conftest import SCHEMA

INSULT = "Every blork is scumly dirt!"


def tables(spark, path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline(spark, rows, tmp_path):
    toxic = [(1000 + k, f"w{k} w{k + 1} words. {INSULT} More of w{k * 3} here.", "en", "web", 1, "k", 1, "r", "t", "c") for k in range(40)]
    some = rows + toxic
    labels = [(r[0], 1, 0) for r in rows if r[0] is not None] + [(r[0], 0, 1) for r in toxic[:30]]
    path = tables(spark, tmp_path / "sf", some, labels)

    docs = spark.read.parquet(f"{path}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet")))
    left = [(r[0], r[1], r[3]) for r in some if scorer.probability(r[1]) < toxicity.THRESHOLD]
    assert not any(t and INSULT in t for _, t, _ in left) and len(left) >= len(some) - 42
    deduplicated = brute.lines([(d, t) for d, t, _ in left])
    kept = [(d, new, s) for (d, old, s), (_, new) in zip(left, deduplicated) if not (old or "").strip(" \t\r\n") or (new or "").strip(" \t\r\n")]
    gone = brute.near([(d, t) for d, t, _ in kept])
    unique = [x for x in kept if x[0] is None] + list({(d, t): (d, t, s) for d, t, s in kept if d is not None and (d, t) not in gone}.values())
    copied = [(d, t) for (d, t, s), c in zip(unique, brute.copies(unique)) for _ in range(c[4])]
    lengths = [brute.count(t) for _, t in copied]

    out = corpus_pipeline.run(spark, path).collect()
    room = {}
    for r in out:
        room[r.bin_id] = room.get(r.bin_id, packing.CAPACITY) - r.n_tokens
    assert sorted(room.values()) == brute.bins(lengths, packing.CAPACITY)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.start_token, r.n_tokens) for r in out)
    assert got == sorted((d is None, d or 0, a, min(packing.CAPACITY, n - a)) for (d, _), n in zip(copied, lengths) for a in range(0, n, packing.CAPACITY))


def test_stages_keep_the_columns(spark, tmp_path):
    path = tables(spark, tmp_path / "sf", [], [])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, path).count() == 0


def test_line_stage_drops_what_has_nothing_left(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "b\na"), (3, " "), (4, None), (5, "b\nc")], "doc_id bigint, text string")
    out = corpus_pipeline.line_dedup(spark, df, "")
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text is not None) == [(1, "a\nb"), (3, " "), (5, "c")]
    assert out.where("text IS NULL").count() == 1
