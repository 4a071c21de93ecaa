import collections
import random

import corpus_pipeline
import public_tokenizers
from closura.llm import queries
from tokenizers import Tokenizer

from .helpers import frame
from .test_models import many, naive_base, sentence
from .test_near_dedup import brute


def test_pipeline_like_plain_loops(spark, tmp_path):
    """Clean documents go through, planted ones are caught, one stage after the other."""
    rng = random.Random(9)
    rows = many(9, 160)
    bench = [(1, sentence(rng, "en", 30)), (2, sentence(rng, "fr", 40))]
    junk = [(300 + i, " ".join(w.upper() + "!!&&&" for w in sentence(rng, "en", 30).split()), "en", "a") for i in range(4)]
    long = [(400 + i, sentence(rng, "de", 150), "de", "a") for i in range(6)]
    near = [(500 + i, t[:-1] + " ende.", lang, s) for i, (_, t, lang, s) in enumerate(long)]
    dirty = [(600, sentence(rng, "en", 20) + " " + bench[0][1] + " " + sentence(rng, "en", 20), "en", "a"), (601, bench[1][1], "fr", "a")]
    secret = [(700, sentence(rng, "en", 1500) + " token = \"ce0cc631f6559e745b37cb8be6fc63ae2d235c5f\" " + sentence(rng, "en", 20), "en", "a")]
    odd = [(800, None, None, None), (801, "", "en", "a")]
    every = rows + junk + long + near + dirty + secret + odd
    frame(spark, every).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows + long], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = kept["quality classifier"]
    assert not any(i in first for i, *_ in junk) and sum(i in first for i, *_ in rows) >= 0.97 * len(rows)
    assert all(i in first for i, *_ in odd)
    want = {i for i, _, _, mine in brute([r for r in every if r[0] in first], corpus_pipeline.NEAR) if mine}
    assert set(kept["minhash near-dedup"]) == want and not any(i in want for i, *_ in near)
    clean = kept["benchmark decontamination"]
    assert not any(i in clean for i, *_ in dirty) and len(clean) >= len(want) - 2
    assert all(700 in k for k in kept.values()), {n: 700 in k for n, k in kept.items()}
    after = kept["secret scans"]
    assert set(after) == set(clean) and after[700].count("[SECRET]") == 1 and not naive_base(after[700])
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    length = collections.Counter()
    for r in out:
        length[r["doc_id"]] += r["length"]
    assert length == {i: len(tool.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in after.items()}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    names = {int(k[2:].split("_")[0]) for k in queries.queries()}
    assert names == set(range(1, 11))


def test_queries_on_small_tables(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, q in queries.queries().items():
        rows = q(spark, sf).collect()
        assert len({r["doc_id"] for r in rows}) == n, name
