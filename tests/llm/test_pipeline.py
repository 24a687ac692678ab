"""The pipeline's stages one after another against plain loops, on documents of every planted kind."""

from __future__ import annotations

import random

import sentencepiece

import corpus_pipeline
from gritstone.llm import pieces, toxicity
from tests.llm import test_decontam, test_linededup, test_simhash
from tests.llm.conftest import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ["gromp", "vexil", "brutto", "nastor"]


def make(tmp_path, spark, seed=6):
    r = random.Random(seed)
    item = words(r, 40)
    passage = "\n".join(words(r, 20) for _ in range(4))
    docs, toxic = [], set()
    clean = lambda: "\n".join(words(r, r.randint(8, 20)) for _ in range(r.randint(4, 8)))
    for i in range(400):
        text = clean()
        kind = i % 10
        if kind == 0:
            text += "\n" + " ".join(r.choices(INSULTS, k=6))
            toxic.add(i)
        elif kind == 1:
            text += "\n" + passage + "\n" + clean()
        elif kind == 2:
            text += " " + item + " " + clean()
        elif kind == 3 and i > 10:
            w = docs[i - 8][1].split()  # a plain one
            w[len(w) // 2] = "edited"
            text = " ".join(w)
        docs.append((i, text))
    docs += [(1000, None), (1001, ""), (1002, docs[4][1])]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in docs[:300]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, toxic, item


def test_stages(spark, tmp_path):
    docs, toxic, item = make(tmp_path, spark)
    table, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "sentencepiece"]
    text = dict(docs)

    out = corpus_pipeline.drop_toxic(spark, table, sf)
    assert out.columns == table.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert set(left) == set(text) - toxic

    lines = corpus_pipeline.dedup_lines(spark, out, sf)
    want = {**test_linededup.brute([(i, t) for i, t in left.items() if t is not None]), 1000: None}
    want = {i: t for i, t in want.items() if t or not left[i]}
    got = {r.doc_id: r.text for r in lines.collect()}
    assert got == want and 1002 not in got and 4 in got
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.text is not None)

    once = corpus_pipeline.drop_copies(spark, lines, sf)
    ids = sorted(i for i in got if got[i])
    roots = test_simhash.brute([got[i] for i in ids])
    want = {i for k, i in enumerate(ids) if roots[k] == k} | {i for i in got if not got[i]}
    assert {r.doc_id for r in once.collect()} == want and len(want) < len(got)

    fresh = corpus_pipeline.drop_leaks(spark, once, sf)
    split = lambda t: (t or "").split()
    want = {i for i in want if test_decontam.longest(split(got[i]), item.split()) < 13}
    assert {r.doc_id for r in fresh.collect()} == want and fresh.columns == table.columns

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coded = {r.doc_id: r.ids for r in corpus_pipeline.encode(spark, fresh, sf).collect()}
    assert coded == {i: sp.encode(got[i]) if got[i] else [] for i in want}

    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == coded
    assert toxicity.P_VALUE == 1e-3


def test_empty_tables(spark, tmp_path):
    for name, kind in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_stage_leaves_most_pairs_out():
    """The third stage compares few pairs of differing texts by all bits, in tasks that are nearly equal."""
    from gritstone.llm import simhash

    fp = test_simhash.planted(16_000, simhash.RADIUS)
    parts = simhash.plan(fp, fp, simhash.RADIUS)
    assert parts
    sizes = [sum(len(a) for a, _ in simhash.word_pairs(fp, None, simhash.RADIUS, parts, k, 3)) for k in range(3)]
    assert sum(sizes) < 0.01 * len(fp) * (len(fp) - 1) / 2 and max(sizes) < 1.5 * min(sizes)
