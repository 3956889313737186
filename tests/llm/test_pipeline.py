"""Rows of null and repeated ids in the stages of the pipeline."""

import random
from collections import Counter

import corpus_pipeline


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def _kept(df):
    assert tuple(df.columns) == corpus_pipeline.COLUMNS
    return Counter(r.source for r in df.collect())


def test_toxic_rows_go_whatever_their_id(spark, tmp_path):
    rng = random.Random(5)
    text = lambda *more: " ".join([*("".join(rng.choices("th er on an re he in".split(), k=3)) for _ in range(12)), *more])
    rows = [(k, text("scumbag" if k % 2 else "idiot") if k < 200 else text()) for k in range(600)]
    spark.createDataFrame([(k, int(k < 200)) for k in range(600)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(None, text("idiot")), (None, text()), (900, text("idiot")), (900, text()), (901, text("idiot")), (901, text("scumbag")), (None, None), (902, None)]
    kept = _kept(corpus_pipeline.drop_toxic(spark, _docs(spark, rows + more), str(tmp_path)))
    assert [kept[f"s{600 + k}"] for k in range(len(more))] == [0, 1, 0, 1, 0, 0, 1, 1]


def test_contaminated_rows_go_whatever_their_id(spark, tmp_path):
    item = " ".join(f"w{k}" for k in range(12))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item}"), (None, "clean"), (None, None), (1, item), (1, "clean"), (1, "clean"), (2, item), (2, item), (3, "")]
    kept = _kept(corpus_pipeline.drop_contaminated(spark, _docs(spark, rows), str(tmp_path)))
    assert [kept[f"s{k}"] for k in range(len(rows))] == [0, 1, 1, 0, 1, 1, 0, 0, 1]


def test_near_duplicates_and_repeats_of_null_and_repeated_ids(spark, tmp_path):
    one, two = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(1, one), (2, one), (2, "another text of the same document"), (None, one), (None, one), (3, two), (3, two), (None, None), (4, None)]
    kept = _kept(corpus_pipeline.drop_near_duplicates(spark, _docs(spark, rows), str(tmp_path)))
    assert [kept[f"s{k}"] for k in range(len(rows))] == [1, 0, 0, 1, 1, 1, 1, 1, 1]
    out = {r.source: r.text for r in corpus_pipeline.cut_repeats(spark, _docs(spark, rows), str(tmp_path)).collect()}
    assert [out[f"s{k}"] for k in (0, 1, 2, 3, 4, 5, 6)] == [one, "", rows[2][1], one, one, two, two]


def test_stages_of_an_empty_table_and_of_further_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = _docs(spark, [(1, "a")]).where("false")
    more = _docs(spark, [(1, "some text of its own"), (2, None), (None, "")]).selectExpr("*", "1 as score", "'x' as row_key", "2 as h", "cast(null as string) as rep")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == [], name
        out = stage(spark, more, str(tmp_path))
        assert out.count() == 3, name
        if name != "packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS and {(r.doc_id, r.text or "") for r in out.collect()} == {(1, "some text of its own"), (2, ""), (None, "")}, name


def test_what_tasks_and_driver_hand_over_stays_small(spark):
    """New tokens are valued in pieces, and the driver's rows reach Spark without Python workers of their own."""
    import numpy as np
    import pandas as pd

    from tessera.llm import toxicity
    from tessera.plans.tables import small_table

    class Model:
        known_pairs, asked = frozenset(), []

        def token_values(self, toks):
            self.asked.append(len(toks))
            return [float(t[1:]) for t in toks]

        def score(self, value):
            return value

    words = [f"w{k}" for k in range(12_000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)]
    model = Model()
    (out,) = toxicity._scorer(model, "pieces")(iter([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})]))
    assert np.array_equal(out["score"], np.arange(len(texts)) * 100.0 + 99)
    assert sum(model.asked) == len(words) and max(model.asked) <= 5_000

    df = small_table(spark, [(1, None), (2, 5)], "a int, b bigint")
    assert "ExistingRDD" not in df._jdf.queryExecution().toString() and df.dtypes == [("a", "int"), ("b", "bigint")]
    assert sorted(map(tuple, df.collect())) == [(1, None), (2, 5)]
    assert small_table(spark, [], "a int, b bigint").count() == 0
