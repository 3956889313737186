"""Top-k search, packing, token counts and the pipeline."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.near_dedup import shingle_set
from tessera.llm.packing import pack
from tessera.llm.token_counts import token_counts
from tessera.llm.topk import top_k

tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", None, "  ", " a", "a ", "a  b", "\n a", "a \n b\t c", "<|endoftext|> x", "<s>hi</s>", "it's we'll", "▁ ▁x", "é１ 中文 😀", "x" * 500, "word\x1cword word", "a" + " " * 30 + "b"]


@pytest.mark.parametrize("block", [4096, 2])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr("tessera.llm.topk.QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=20).tolist()) for k in range(300)] + [(300, None), (301, [1.0, None] * 10), (302, [float("nan")] * 20), (400, [1.0, 2.0]), (500, [3.0, 4.0]), (None, [1.0] * 20), (7, [0.5] * 20), (600, []), (700, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    out = top_k(df.selectExpr("*", "1 as id", "2 as v"), df.where("vec_id % 100 = 0"), k=10).collect()
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in whole:
        if q % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v)))[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, out)) == sorted(want)
    assert top_k(df.where("false"), df, k=10).collect() == []


def test_pack(docs):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, " ".join("".join(rng.choices("abc é.,\n", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 900)))) for k in range(12)] + [(None, "x"), (3, "y")]
    out = pack(docs(rows).repartition(3), path, length=64, with_ids=True).collect()
    one = Tokenizer.from_file(path)
    want = sorted((str(i), [*one.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows)
    pieces = sorted(out, key=lambda r: (r.sequence_id, r.offset))
    got, current = [], []
    for r in pieces:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length and r.start == len(current)
        current += r.ids
        if len(current) == r.doc_tokens:
            got.append((str(r.doc_id), current))
            current = []
    assert sorted(got) == want and not current
    total = 0
    for r in pieces:  # gapless: each piece begins where the one before it ended
        assert r.sequence_id * 64 + r.offset == total and r.offset + r.length <= 64
        total += r.length
    assert total == sum(len(x) for _, x in want)
    assert pack(docs([]), path).collect() == []


def test_top_k_of_large_components(spark):
    rows = [(0, [1e17, 0.0]), (1, [3e6, 3e6]), (2, [1.0, -2.0]), (3, [-1e17, 1.0])]
    out = top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), spark.createDataFrame(rows[:2], "vec_id bigint, embedding array<double>"), k=3).collect()
    whole = {i: [max(-(2**63), min(2**63 - 1, int(x * 1024))) for x in v] for i, v in rows}
    for q in (0, 1):
        scores = {i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))) for i, v in whole.items() if i != q}
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
        assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_both_tokenizer_libraries_agree_on_all_tested_characters():
    from tessera.llm import packing

    path = tokenizers.path("byte_bpe_50k.json")
    assert packing.agrees(path) and not packing.agrees(tokenizers.path("word_bpe_49k.json"))
    ends = re.findall(r"(.)-(.)", packing.TESTED, re.S)
    texts = [f"a{c}1 {c}{c}x{c}' {c}\n{c} s" for a, b in ends for c in map(chr, range(ord(a), ord(b) + 1))]
    rng = random.Random(8)
    texts += ["".join(rng.choices("ab'stre  \n\t1.é中한<|endoftext|>😀\u0301", k=rng.randint(0, 80))) for _ in range(2000)]
    texts += [c * n for c in ("a", "ab1", " ", "\n", ".") for n in (500, 20_000)] + ["so<|endoftext|>it", ""]
    slow = packing.ByteCoder(path, False)
    assert packing.ByteCoder(path, True).encode(texts) == slow.encode(texts)
    assert slow.twin is None


def test_token_counts_of_very_long_words(docs):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcXYZ019+/", k=n)) for n in (900, 1_001, 60_000)] + ["  " + "中文" * 3_000 + " so  it", "▁" * 5_000]
    one = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {r.doc_id: r.n_tokens for r in token_counts(docs(list(enumerate(texts))), path).collect()}
    assert out == {k: len(one.encode(t)) for k, t in enumerate(texts)}


def test_token_counts(docs):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    texts = [*ODD, *("".join(rng.choices("ab cé▁ \n\t.<s>1", k=rng.randint(0, 60))) for _ in range(400))]
    one = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {r.doc_id: r for r in token_counts(docs(list(enumerate(texts))), path, limit=20).collect()}
    for k, t in enumerate(texts):
        n = len(one.encode(t or ""))
        assert (out[k].n_bytes, out[k].n_tokens, out[k].over_limit) == (len((t or "").encode()), n, n > 20), t
    assert token_counts(docs([]), path).collect() == []


def contaminated(spark, sf, ids):
    from tessera.llm.decontaminate import contamination
    from tessera.llm.substring_dedup import remove_repeats

    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id").isin(list(ids)))
    clean = remove_repeats(docs, window=50).select("doc_id", F.col("kept_text").alias("text"))
    return contamination(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_pipeline(spark):
    """Each stage's decisions on its own input, from the operators' rows, take effect."""
    import corpus_pipeline as p
    from tessera.llm.scratch import cut

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    learned = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    texts = {r.doc_id: r.text for r in table.collect()}
    kept = []
    for name, stage in p.STAGES[:-1]:
        table = cut(stage(spark, table, sf), name)
        assert set(table.columns) == set(p.COLUMNS)
        kept.append({r.doc_id for r in table.select("doc_id").collect()})
    assert not kept[0] & learned and len(kept[0]) > 150
    sets = {i: shingle_set(texts[i].encode(), 5) for i in kept[0]}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for k in sorted(sets):
            if i < k and sets[i] and 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k]):
                a, b = root[i], root[k]
                root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    assert kept[1] == kept[2] == {i for i in root if root[i] == i}
    assert kept[3] == kept[2] - {r.doc_id for r in contaminated(spark, sf, kept[2]) if r.contaminated}
    last = p.STAGES[-1][1](spark, table, sf)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == kept[3]
    rows = p.run(spark, sf)
    assert sorted(map(tuple, rows.select("doc_id", "start", "doc_tokens").where("start = 0").collect())) == sorted(map(tuple, last.select("doc_id", "start", "doc_tokens").where("start = 0").collect()))
