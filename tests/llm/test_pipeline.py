"""The pipeline's stages, each on what the one before kept, against brute force."""

import numpy as np

import corpus_pipeline
from larkwing.llm import toxicity
from larkwing.llm.mixing import water_fill

from .test_native import FOLD
from .test_text import brute_components, brute_contamination

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    r = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{r.integers(4000)}" for _ in range(n))
    base = [words(int(r.integers(30, 90))) for _ in range(60)]
    item = words(20)
    texts = [*base, *(b.upper() for b in base[:8]), *(b + " tail" for b in base[8:14]), *(f"{words(20)} {item} {words(9)}" for _ in range(4)), *(words(30) + " grumplewort snivelgob " + words(9) for _ in range(20)), "", None]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    bad = {i for i, t in enumerate(texts) if t and "snivelgob" in t}
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in bad)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append({x["doc_id"]: x["text"] for x in docs.collect()})
    assert set(kept[0]) == {i for i, t in enumerate(texts) if model.score(t) < 0.3} and not bad & set(kept[0]) and len(kept[0]) == len(texts) - 20
    last = {}
    for i, t in kept[0].items():
        key = (t or "").translate(FOLD)
        last[key] = max(i, last.get(key, -1))
    assert set(kept[1]) == set(last.values())
    comp = brute_components(list(kept[1].items()))
    assert set(kept[2]) == {c for _, c in comp.values()} and len(kept[2]) < len(kept[1])
    dirty = brute_contamination(list(kept[2].items()), [(1, item)])
    assert set(kept[3]) == {i for i, v in dirty.items() if not v[4]} and len(kept[2]) - len(kept[3]) == 4
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    sizes = {}
    for i, t in kept[3].items():
        sizes[f"s{i % 3}"] = sizes.get(f"s{i % 3}", 0) + len((t or "").split())
    assert {x["doc_id"] for x in mixed} == set(kept[3]) and all(abs(x["target"] - water_fill(sizes)[f"s{x['doc_id'] % 3}"]) < 1e-6 for x in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixed))
