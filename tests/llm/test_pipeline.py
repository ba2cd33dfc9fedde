"""The pipeline's stages on awkward rows, and together."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from basalt.llm import quality

from .cases import KINDS, awkward, cluttered, empty, passage
from .test_operators import jaccard_classes, matches, plain_spans

SF = "/root/testdata/sf0.001"


def words_of(text):
    """Decontamination's tokens: letters and digits of ASCII and all other characters beyond it, A-Z lowered."""
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_stages_keep_columns_and_clean_rows(spark):
    odd = cluttered(awkward(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert stage(spark, empty(spark), SF).count() == 0, name
    assert corpus_pipeline.mix_sources(spark, empty(spark), SF).count() == 0


def test_decisions_take_effect(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    clean = [(9000 + i, passage(500 + i, 60), "en", "a", 1) for i in range(5)]
    docs = spark.createDataFrame([*clean, (1, clean[0][1], "en", "a", 1), (2, clean[1][1] + " end", "en", "a", 1), (3, f"so {item} so", "en", "a", 1), (4, passage(600, 60) + " x@y.org", "en", "a", 1)], KINDS)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 9002, 9003, 9004]
    kept = corpus_pipeline.drop_contaminated(spark, kept, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 9002, 9003, 9004]
    kept = corpus_pipeline.redact_personal_data(spark, kept, SF)
    assert kept.where("doc_id = 4").first().text.endswith("[EMAIL]")


def test_stages_are_those_of_brute_force(spark, tmp_path):
    """Each stage on its own input, the 200 test documents and what is left of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            scored = quality.score(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r.doc_id for r in scored.collect() if r.score >= 0.5}
        elif name == "near_duplicates":
            groups = jaccard_classes([(i, r.text) for i, r in before.items()])
            assert set(after) == {least for _, least, _, _ in groups}
        elif name == "decontamination":
            assert set(after) == {i for i, r in before.items() if not any(matches(words_of(r.text), item) for item in items)}
        else:
            for i, r in before.items():
                left, k = after[i].text, 0
                for a, kind, b in plain_spans(r.text or ""):
                    assert r.text[a:b] not in left or r.text.count(r.text[a:b]) > 1, (i, kind)
                    k += 1
                assert (left == r.text) if not k and "[" not in left else True
                assert after[i].n_chars == (None if left is None else len(left))
        assert all(after[i] == before[i] for i in after) or name == "personal_data"


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    total = out.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("taken").alias("taken")).first()
    assert 0 < total.n < 200 and abs(total.taken - 1.5 * total.size) < 0.1 * total.size
