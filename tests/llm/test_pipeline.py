"""The pipeline on a small corpus with planted cases."""

import random

import pytest


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    clean = [text(rng.randint(60, 200)).capitalize() + "." for _ in range(120)]
    docs = [(k, t) for k, t in enumerate(clean)]
    junk = [" ".join(w.upper() + "!!" for w in text(80).split()) for _ in range(40)]
    docs += [(1000 + k, t) for k, t in enumerate(junk)]
    docs += [(2000, clean[0]), (2001, clean[1].replace(" ", "  ", 1)), (2002, clean[2][:-1] + " more words.")]
    passage = text(70)
    docs += [(3000 + k, f"{text(40)}. {passage} {text(40)}.") for k in range(3)]
    item = text(30)
    docs += [(4000, f"{text(50)} {item} {text(20)}.")]
    docs += [(5000, None), (5001, ""), (None, text(50))]
    labels = [(k, 1, 0) for k in range(120)] + [(1000 + k, 0, 0) for k in range(40)]
    return docs, labels, item, passage


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    docs, labels, item, _ = corpus()
    top = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = dict(p.STAGES)
    assert list(steps) == ["quality", "near_dedup", "substring_dedup", "decontamination", "packing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    good = steps["quality"](spark, docs, sf_dir).persist()
    assert good.columns == columns and ids(good) == {i for i in ids(docs) if i is None or not 1000 <= i < 2000}
    once = steps["near_dedup"](spark, good, sf_dir).persist()
    assert once.columns == columns and ids(good) - ids(once) == {2000, 2001, 2002}
    cut = steps["substring_dedup"](spark, once, sf_dir).persist()
    _, _, _, passage = corpus()
    assert cut.columns == columns and ids(cut) == ids(once)
    before = {r.doc_id: r.text for r in once.collect()}
    after = {r.doc_id: r.text for r in cut.collect()}
    assert all(passage not in after[3000 + k] for k in range(3))
    assert all(after[i] == (before[i] or "") for i in after if i is None or i < 3000 or i >= 4000)
    pure = steps["decontamination"](spark, cut, sf_dir).persist()
    assert pure.columns == columns and ids(cut) - ids(pure) == {4000}
    packed = steps["packing"](spark, pure, sf_dir)
    assert ids(packed) == ids(pure)
    for df in (good, once, cut, pure):
        df.unpersist()


def test_run_and_empty(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    out = p.run(spark, sf_dir)
    assert out.select("doc_id").distinct().count() > 100
    none = f"file://{tmp_path}/none"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert p.run(spark, none).count() == 0


def test_passages_of_51_words_go(spark, sf_dir):
    import corpus_pipeline as p

    rng = random.Random(3)
    text = lambda k, n=4: " ".join("".join(rng.choice("abcdefghiklmnoprst") for _ in range(n)) for _ in range(k))
    passage, short, tiny, characters = text(51), text(50, 6), " ".join("abcdefghijklmnopqrst"[k % 20] * (1 + k // 20) for k in range(51)), text(1, 450)
    own = [text(60) for _ in range(16)]
    rows = [(2 * i + k, f"{own[4 * i + 2 * k]} {part}\n{own[4 * i + 2 * k + 1]}") for i, part in enumerate((passage, short, tiny, characters)) for k in range(2)]
    assert len(passage) < 400 and len(short) < 400
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in p.substring_stage(spark, docs, sf_dir).collect()}
    for i, t in rows:
        whole = t if i in (2, 3) else f"{own[2 * i]} \n{own[2 * i + 1]}"
        assert "".join(got[i].split()) == "".join(whole.split())


def test_rows_without_an_id_are_judged_one_by_one(spark):
    import corpus_pipeline
    from sparktide.llm.decontaminate import decontaminated

    text = " ".join(f"w{k}" for k in range(60))
    other = "quite another text about rivers and hills and the long way home tonight"
    rows = [(1, text), (None, text), (None, other), (2, text + " x"), (1, text), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert got == [(0, other), (1, text), (3, "")]
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminated(docs, items).collect()) == [(0, other), (3, "")]
