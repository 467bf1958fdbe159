"""op7 takes out repeated strings of 400 bytes, no shorter ones; the pipeline's repeats takes out passages of over 50 words too."""

import numpy as np

import corpus_pipeline
from basketry.llm import queries


def test_passages_on_either_side_of_400_bytes(spark, tmp_path):
    random = np.random.default_rng(19)
    words = lambda n: " ".join("".join(random.choice(list("abcdefgh"), 6)) for _ in range(n))
    short, long = words(60)[:399], words(60)[:400]
    texts = [f"{edge}1 {words(30)}{edge}{passage}{edge} {words(30)}" for passage in (short, long) for edge in "xyz"] + [words(90), None]
    path = str(tmp_path)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")

    got = {r.doc_id: r for r in queries.op7_suffix_dedup(spark, path).collect()}
    for i, text in enumerate(texts):
        held = i in (3, 4, 5)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text or ""), 400 * held, held)
        assert r.text == ((text or "").replace(long, "") if held else text or "")

    kept = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    for i in (0, 1, 2):
        assert short[10:-10] in texts[i] and short[10:-10] not in kept[i]
