from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import numpy as np

from rowforge.llm import op7_jaccard, op10_bpe
from tests.llm.test_op7 import brute
from tests.llm.test_op8 import base


def test_stages_on_their_own_inputs(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(step(spark, docs, sf))
        before, after = docs.collect(), out.collect()
        if name != "tokens":
            assert out.columns == columns
        if name == "toxicity":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            told = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic").collect()}
            bad, clean = ({i for i, t in told.items() if t == k} for k in (1, 0))
            assert len(gone & bad) > 0.55 * len(bad) and len(gone & clean) <= 0.02 * len(clean)  # 51 toxic labels to learn from, in four languages
        elif name == "near_duplicates":
            assert sorted(r.doc_id for r in after) == sorted({c for i, n, c in brute([(r.doc_id, r.text) for r in before], 5, 80)})
        elif name == "secrets":
            assert len(after) == len(before) and not [r for r in after if base(r.text)]
            texts = {r.doc_id: r.text for r in before}
            assert all(r.text == texts[r.doc_id] for r in after if "[SECRET]" not in r.text)
        elif name == "mixing":
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
            poor = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()} - poor
            was, now = (Counter(r.doc_id for r in rows) for rows in (before, after))
            assert sum(i in now for i in was if i in good) >= 0.98 * sum(i in good for i in was)  # good documents stay
            assert sum(now[i] for i in poor) < 0.8 * sum(was[i] for i in poor)  # the decision takes effect
        else:
            enc = op10_bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before) and all(np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(texts[r.doc_id]) for r in after)
        docs = out
    assert sorted(corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens").collect()) == sorted(out.select("doc_id", "n_tokens").collect())


def test_nulls_and_empty_tables_end_to_end(spark, tmp_path):
    """Every stage on null ids and texts, empty, repeated and very long texts; and on no rows at all."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", "s", None), (3, "calm water " * 20_000, "en", None, 220_000), (4, "token = abcdefghijkl1234", "en", "s", 24), (None, "no id", "fr", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        sf = str(tmp_path / name)
        table.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        now = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, step in corpus_pipeline.STAGES:
            out = corpus_pipeline.written(step(spark, now, sf))
            if stage != "tokens":
                assert out.columns == docs.columns
            if name == "none":
                assert out.count() == 0
            elif stage == "toxicity":
                assert out.count() == len(rows)  # nothing is labelled toxic that has an id
            elif stage == "near_duplicates":
                assert sorted((r.doc_id or -1, (r.text or "")[:4]) for r in out.collect()) == [(-1, ""), (-1, "no i"), (1, ""), (2, ""), (3, "calm"), (4, "toke")]
            elif stage == "secrets":
                assert {r.text for r in out.collect() if r.doc_id == 4} == {"[SECRET]"}
            now = out
        assert corpus_pipeline.run(spark, sf).count() == now.count()


def test_near_duplicates_sends_nothing_of_exact_copies(spark, monkeypatch):
    """One row of each text stays, and copies alone make no text a candidate."""
    sent = []
    texts = [" ".join(f"t{t}w{k}" for k in range(40)) for t in range(8)]
    docs = spark.createDataFrame([(k, texts[k % 8], 1) for k in range(160)], "doc_id long, text string, n_chars long").repartition(5)

    def noted(frame, keep=False, real=op7_jaccard.stage):
        out = real(frame, keep)
        if "elements" in out.columns:
            sent.append(out.where("elements is not null").count())
        return out

    monkeypatch.setattr(op7_jaccard, "stage", noted)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(8))
    assert sent and set(sent) == {0}
