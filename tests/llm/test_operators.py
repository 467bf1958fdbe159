"""Every operator against brute force, an exact round trip or held-out labels, on odd rows and empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from basketry.llm import (byte_bpe, jaccard_join, jump_shards, mil_toxicity, ordinal_quality, queries, rotated_codes, spaced_seeds,
                          suffix_dedup, token_records, warc_bundles)
from basketry.llm.components import components
from basketry.llm.crc import crc32c_many

SMALL = "/root/testdata/sf0.001"
VOCABULARY = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_crc32c_known_value():
    assert crc32c_many(np.frombuffer(b"123456789", np.uint8), [0, 0], [9, 0]).tolist() == [0xE3069283, 0]


def test_token_records(spark, odd_docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(VOCABULARY)
    got = token_records.token_records(odd_docs, VOCABULARY).orderBy("start").collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got][1:] == sorted(r.doc_id for r in got[1:]) and got[0].doc_id is None
    assert token_records.token_records(odd_docs.limit(0), VOCABULARY).count() == 0


def test_token_records_with_added_tokens(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(VOCABULARY)
    texts = ["<|endoftext|>", "one <|endoftext|> two", "end<|endoftext|><|endoftext|> ", "plain words here", "almost <|endoftext| >", "", " a\n<|endoftext|>\nb c", "plain words here"]
    got = token_records.token_records(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY).collect()
    ids = [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert 50256 in ids[0] and {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}


def test_record_seek_and_damage(spark, odd_docs, tmp_path):
    files = token_records.write_records(odd_docs, f"file://{tmp_path}/r", VOCABULARY, files=1).collect()
    doc_id, ids = token_records.read_record(files[0].path, 3)
    assert doc_id == 2 and ids[-1] == 0
    path = files[0].path.replace("file://", "")
    raw = bytearray(open(path, "rb").read())
    raw[200] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(token_records.read_frames(files[0].path))


def test_jump_shards(spark, odd_docs):
    def jump(key, n):
        key, b, j = key % 2**64, -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b
    got = jump_shards.shard_documents(odd_docs, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (jump(key, 5), jump(key, 6)) and r.grown_shard in (r.shard, 5)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert jump_shards.shard_documents(odd_docs.limit(0)).count() == 0


def test_rotated_codes_recall_and_odd_vectors(spark):
    table = queries.table(spark, SMALL, "embeddings")
    odd = spark.createDataFrame([(10_000, None), (10_020, [0.0] * 64), (10_040, [float("nan")] * 64), (10_060, [1.0]), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    hot = spark.createDataFrame([(20_000 + i, [0.5] * 64) for i in range(40)], "vec_id long, embedding array<float>")
    both = table.select("vec_id", "embedding").unionAll(odd).unionAll(hot)
    got = rotated_codes.nearest(both, lambda c: c % 20 == 0, 20, rows_per_block=150, queries_per_block=9).collect()
    pairs = [(r.vec_id, np.array(r.embedding, float)) for r in table.unionByName(hot, allowMissingColumns=True).collect()]
    ids, matrix = np.array([p[0] for p in pairs]), np.stack([p[1] for p in pairs])
    found = total = 0
    for q in ids[ids % 20 == 0]:
        score = (matrix * matrix[ids == q][0]).sum(1)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))][:20].tolist()
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == 20 and len(set(mine)) == 20
        found, total = found + len(set(best) & set(mine)), total + 20
    assert found / total >= 0.97
    assert {r.query_id for r in got} == {int(i) for i in ids if i % 20 == 0}
    assert rotated_codes.nearest(both.limit(0), lambda c: c % 20 == 0).count() == 0


def test_spaced_seeds_find_replaced_words(spark, odd_docs):
    passage = "seven wise owls watch quietly from an old oak tree and the river keeps running towards a distant sea"
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, "too short"), (None, "x" * 9)], "item_id long, text string")
    words = passage.split()
    words[4], words[11] = "loudly", "zebra"
    docs = odd_docs.select("doc_id", "text", "key", "node").unionAll(spark.createDataFrame(
        [(50, "Intro. " + " ".join(words).upper() + "! End"), (51, "nothing of that kind is in here at all, or is it")], "doc_id long, text string").selectExpr("doc_id", "text", "'k'", "1"))
    got = spaced_seeds.overlaps(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (5, 1), (50, 1)} and len(got) == 4
    row = next(r for r in got if r.doc_id == 50)
    assert (row.doc_start, row.item_start, row.n_words, row.n_matched) == (1, 0, 19, 17)
    assert spaced_seeds.overlaps(docs.limit(0), items).count() == 0 and spaced_seeds.overlaps(docs, items.limit(0)).count() == 0


def test_toxicity_held_out(spark, odd_docs):
    got = queries.op5_mil_toxicity(spark, "/root/testdata/sf0.01").filter("held_out").join(
        queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect()
    toxic = [r.score for r in got if r.toxic == 1]
    clean = [r.score for r in got if r.toxic == 0]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.8
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = mil_toxicity.fit(odd_docs, labels)
    scored = mil_toxicity.score(odd_docs, model).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in scored if r.doc_id in (3, 4, 6)} == {0.0}
    assert mil_toxicity.score(odd_docs.limit(0), mil_toxicity.fit(odd_docs, labels.limit(0))).count() == 0


def test_label_sample_takes_few_rows_to_one_task(spark):
    from pyspark.sql import Window
    labels = spark.range(30_000).selectExpr("id AS doc_id", "cast(id % 3 = 0 AS int) AS toxic").unionAll(spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic int"))
    rows = labels.dropna().filter(~mil_toxicity.held_out(F.col("doc_id"))).withColumnRenamed("toxic", "label")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    want = rows.withColumn("n", F.row_number().over(order)).filter("n <= 100").select("doc_id", "label").collect()
    taken, counts = mil_toxicity.sample_labels(labels, "toxic", 100)
    assert Counter(rows_of(taken)) == Counter(map(tuple, want)) and sum(counts.values()) == rows.count()
    assert 200 <= mil_toxicity.least_hashes(rows, 100)[0].count() < 300
    few, counts = mil_toxicity.sample_labels(labels.filter("doc_id < 40"), "toxic", 100)
    assert few.count() == sum(counts.values()) == rows.filter("doc_id < 40").count()
    assert rows_of(mil_toxicity.sample_labels(labels.limit(0), "toxic", 100)[0]) == []


def test_noisy_or_names_the_sentence():
    weights = np.zeros(1 << mil_toxicity.BITS, np.float32)
    weights[list(mil_toxicity.word_features("awful"))[0]] = 12
    score, worst, chance = mil_toxicity.Scorer(weights, -8.0)("A fine day. What an awful thing! The end")
    assert worst == "what an awful thing" and score > 0.95 and score >= chance
    assert math.isclose(mil_toxicity.Scorer(weights, -8.0)("A day. Two days.")[0], 1 - (1 - 1 / (1 + math.exp(8))) ** 2, rel_tol=1e-6)


def test_warc_bundles(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u\r\nX: y", "same"), (3, None, None), (4, "v", ""), (5, "w", "own é"), (None, "n", "same"), (6, "big", "z" * 600_000)],
                                  "page_id long, url string, html string").withColumn("frame", F.lit(1))
    got = {r.page_id: r for r in warc_bundles.warc_bundles(pages).collect()}
    assert len(got) == 7
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None)}
    assert got[5].payload_bytes == 6 and got[5].payload_digest == warc_bundles.payload_digest("own é") and got[1].payload_bytes == 4
    assert warc_bundles.warc_bundles(pages.limit(0)).count() == 0


def test_warc_seek(spark, tmp_path):
    pages = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 4000) AS html")
    index = warc_bundles.write_bundles(pages.coalesce(1), f"file://{tmp_path}/w")
    row = index.filter("page_id = 217").collect()[0]
    head, payload = warc_bundles.read_one(row.bundle, row.frame, row.offset)
    assert row.frame > 0 and payload == b"217" * 4000 and head["WARC-Record-ID"] == row.record_id


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) > 0).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("classes", [2048, 2])
def test_suffix_dedup(spark, odd_docs, classes):
    random = np.random.default_rng(3)
    base = "".join(random.choice(list("abcdé fgh"), 1500))
    extra = [(100 + i, base[:i * 60] + "#" * i + base[i * 60:]) for i in range(12)] + [(200, base[300:760]), (201, "q" + base[300:699] + "r")]
    docs = odd_docs.select("doc_id", "text", "row_key").unionAll(spark.createDataFrame(extra, "doc_id long, text string").withColumn("k", F.lit("z")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((d, *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows], 400)))
    assert Counter(rows_of(suffix_dedup.remove_repeats(docs, 400, classes))) == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert suffix_dedup.without_repeats(docs).columns == docs.columns


def brute_passages(texts, words):
    """Texts without the words (normalised, in runs of ``words``) that repeat; tokens go whole, white space stays."""
    def norm(token):
        kept = [i for i, c in enumerate(token) if c.isalnum()]
        return token[kept[0]:kept[-1] + 1] if kept else ""
    split = [[(m.span(), norm(m.group().lower())) for m in regex.finditer(r"\S+", t or "")] for t in texts]
    split = [[(span, w) for span, w in found if w] for found in split]
    grams = [[tuple(w for _, w in found[i:i + words]) for i in range(len(found) - words + 1)] for found in split]
    seen = Counter(g for found in grams for g in found)
    out = []
    for text, found, mine in zip(texts, split, grams):
        gone = np.zeros(len(text or ""), bool)
        for i, g in enumerate(mine):
            if seen[g] > 1:
                gone[found[i][0][0]:found[i + words - 1][0][1]] = True
        out.append("".join(c for c, g in zip(text or "", gone) if not g))
    return out


def passage_rows():
    """Prose of different words: 0 to 2 share a passage of 55 words, 3 and 4 one of 50, 5 and 6 one of 51 with another case and punctuation."""
    random = np.random.default_rng(8)
    prose = lambda n: " ".join("".join(random.choice(list("abcdeéfgh"), 5)) for _ in range(n))
    shared = {55: prose(55), 50: prose(50), 51: prose(51)}
    rows = [(i, f"{prose(40)} {shared[55]}\n{prose(30 + i)}") for i in range(3)]
    rows += [(i, f"{prose(40)} {shared[50]} {prose(20)}") for i in (3, 4)]
    rows += [(5, f"{prose(9)} {shared[51]}, {prose(20)}"), (6, f"{prose(12)} \"{shared[51].upper()}.\" -- {prose(20)}")]
    return rows + [(i, prose(70)) for i in (7, 8)], shared


@pytest.mark.parametrize("classes", [2048, 2])
def test_passages_of_words(spark, odd_docs, classes):
    random = np.random.default_rng(4)
    base = random.choice([f"w{i}" for i in range(300)], 160).tolist()
    extra = [(100 + i, " ".join(base[:i * 11] + [f"x{i}"] + base[i * 11:])) for i in range(12)]
    extra += passage_rows()[0] + [(None, extra[0][1]), (None, "another text " + extra[3][1])]
    docs = odd_docs.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix_dedup.without_repeats(docs, 1 << 20, classes, words=51)
    assert Counter(rows_of(got)) == Counter(zip([d for d, _ in rows], brute_passages([t for _, t in rows], 51)))


def test_pipeline_takes_out_passages_of_51_words(spark):
    import corpus_pipeline
    rows, shared = passage_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    got = {r.doc_id: r for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    assert 300 <= len(shared[55].encode()) < 400
    for doc_id, text in rows[:3]:
        assert got[doc_id].text == text.replace(shared[55], "")
    assert " -- " in got[6].text and shared[51] not in got[5].text and shared[51].upper() not in got[6].text
    for doc_id, text in rows[3:5] + rows[7:]:
        assert got[doc_id].text == text
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_byte_bpe_like_the_library(spark, odd_docs):
    import tiktoken
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    got = byte_bpe.encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in odd_docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    texts = Counter((r.doc_id, (r.text or "").encode()) for r in odd_docs.collect())
    assert Counter((r.doc_id, bytes(r.decoded)) for r in got) == texts
    digests = byte_bpe.encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN, digests=True).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in digests) == Counter(
        (d, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for d, ids in want.elements())
    for words in (0, 5):  # most words outside the dictionary
        got = byte_bpe.encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN, decode=False, words=words).collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert byte_bpe.encode_documents(odd_docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_frequent_words(spark, odd_docs):
    match = regex.compile(public_tokenizers.PATTERN).findall
    counts = Counter(w for r in odd_docs.collect() for w in match(r.text or ""))
    got = [r.word for r in byte_bpe.frequent_words(odd_docs, public_tokenizers.PATTERN, 10).collect()]
    assert set(got) <= set(counts) and len(got) == 10 and " the" in got
    everything = {r.word for r in byte_bpe.frequent_words(odd_docs, public_tokenizers.PATTERN, 10_000).collect()}
    assert "x" * 3000 not in everything and " fox" in everything


def test_fold_column_is_the_same_fold(spark):
    words = ["hello", " the", " world", "日本", "é", "", " unbelievably", "aaaaaaa", "x", " 日本語テスト", "\t\t\t ", "qzxjv-!!"]
    frame = spark.createDataFrame([(w,) for w in words], "w string").select("w", byte_bpe.fold_column(F.col("w").cast("binary"), RANKS).alias("ids"))
    codes = byte_bpe.Merges(RANKS)([w for w in words if w])
    want = {w: np.frombuffer(c, "<u4").tolist() for w, c in zip([w for w in words if w], codes)} | {"": []}
    assert {r.w: r.ids for r in frame.collect()} == want


def test_ordinal_quality(spark, odd_docs):
    shapes = ["plain words of a calm text number {}", "SHOUTING WORDS OF TEXT {}!!", "a | b | {} | d | e", "$$$ %%% {} ### &&&"]
    docs = spark.createDataFrame([(i, shapes[i % 4].format(i) * 3) for i in range(400)], "doc_id long, text string")
    grades = docs.select("doc_id", (3 - F.col("doc_id") % 4).cast("int").alias("grade"))
    model = ordinal_quality.fit(docs, grades, "grade")
    assert model[0] == [0, 1, 2, 3] and (np.diff(model[2]) > 0).all()
    got = ordinal_quality.rate(docs, model, wanted=2).join(grades, "doc_id").filter(mil_toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([abs(r.expected_grade - r.grade) < 0.5 for r in got]) > 0.95
    assert np.mean([(r.tail_probability >= 0.5) == (r.grade >= 2) for r in got]) > 0.95
    odd = ordinal_quality.rate(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and {r.expected_grade for r in odd if r.doc_id in (3, 4, 6)} == {0.0}
    assert ordinal_quality.rate(odd_docs.limit(0), ordinal_quality.fit(docs, grades.limit(0), "grade")).count() == 0


def test_shape_of_the_whole_token():
    assert ordinal_quality.shape("a" * 200 + "7" * 100 + "B" * 80 + "!") == "a0A!"
    of = ordinal_quality.Features()
    assert of("x" * 64 + "9")[0].tolist() != of("x" * 64 + "Y")[0].tolist()
    assert ordinal_quality.shape("x" * 64 + "9") != ordinal_quality.shape("x" * 64)


def word_sets(text):
    out = []
    for w in (text or "").lower().split():
        while w and not w[0].isalnum():
            w = w[1:]
        while w and not w[-1].isalnum():
            w = w[:-1]
        out += [w] if w else []
    n = min(5, len(out))
    return {tuple(out[i:i + n]) for i in range(len(out) - n + 1)} if out else set()


def test_jaccard_join(spark, odd_docs, monkeypatch):
    random = np.random.default_rng(5)
    base = random.choice([f"w{i}" for i in range(500)], 120).tolist()
    extra = []
    for i in range(60):
        words = list(base)
        for at in random.integers(0, 120, i % 6):
            words[at] = f"x{i}"
        extra.append((100 + i, " ".join(words)))
    docs = odd_docs.select("doc_id", "text", "key").unionAll(spark.createDataFrame(extra, "doc_id long, text string").withColumn("key", F.lit("z")))
    rows = {r.doc_id: word_sets(r.text) for r in docs.collect() if r.doc_id is not None}
    links = {(a, b) for a in rows for b in rows if a < b and rows[a] and rows[b] and len(rows[a] & rows[b]) / len(rows[a] | rows[b]) >= 0.8}
    edges = spark.createDataFrame(sorted(links), "a long, b long")
    near = {r.node: r.component for r in components(edges).collect()}
    for block in (512, 7):
        got = jaccard_join.jaccard_join(docs, block=block).collect()
        assert len(got) == docs.count()
        for r in got:
            if r.doc_id is not None:
                assert (r.class_id, r.n_links) == (near.get(r.doc_id, r.doc_id), sum(r.doc_id in p for p in links)), r
    kept = jaccard_join.keep_one(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter([r.class_id for r in {r.class_id: r for r in got if r.doc_id is not None}.values()] + [None])
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


def test_repeated_ids_with_different_texts(spark):
    random = np.random.default_rng(6)
    prose = lambda: " ".join(random.choice([f"w{i}" for i in range(5000)], 80))
    rows = []
    for i in range(20):
        a, b = prose(), prose()
        rows += [(10 * i, a), (10 * i, a), (10 * i, b), (10 * i + 1, b + " end"), (10 * i + 2, a + " end"), (10 * i + 3, ""), (10 * i + 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(rows_of(jaccard_join.jaccard_join(docs)))
    ten = lambda d: d - d % 10
    assert got == Counter((d, d, 0, d) if d % 10 == 3 else (d, ten(d), 1, d) for d, _ in rows)
    kept = [(r.doc_id, r.text or "") for r in jaccard_join.keep_one(docs).collect()]
    assert Counter(kept) == Counter({(d, t or "") for d, t in rows if d % 10 in (0, 3)})


def test_least_matches_follow_the_posterior():
    for n, m in jaccard_join.least_matches(64, 16, 0.8, 1e-6):
        tail = lambda k: sum(math.comb(n + 1, i) * 0.8 ** i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


def test_pipeline_on_odd_rows(spark, odd_docs, tmp_path):
    import corpus_pipeline
    root = str(tmp_path)
    odd_docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "seven wise owls watch quietly from an old oak tree and the river")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, root)
        assert out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), root).count() == 0
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, root).collect()} == {3, 4, None, 6, 7, 8, 9}
    assert "ids" in corpus_pipeline.run(spark, root).columns


def test_decontaminate_by_row(spark, tmp_path):
    import corpus_pipeline
    item = "seven wise owls watch quietly from an old oak tree and the river"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "a clean text without an id"), (None, f"it says {item} again"), (None, None), (1, "a clean text of a repeated id"), (1, f"so {item} once more"), (2, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r for r in rows if item not in (r[1] or ""))


def brute_pipeline(rows, items):
    """(doc_id, token ids) of what the stages keep of ``rows (doc_id, text)``, ASCII texts; junk has no lower-case letter."""
    import tiktoken
    rows = [(d, t) for d, t in rows if any(c.islower() for c in t or "")]
    keys = sorted({(d, tuple(sorted(word_sets(t)))) for d, t in rows if d is not None})
    group = {k: k for k in keys}
    for a in keys:
        for b in keys:
            x, y = set(a[1]), set(b[1])
            if a < b and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    kept = {(d, tuple(sorted(word_sets(t)))): (d, t) for d, t in rows if d is not None}
    rows = [(d, t) for d, t in rows if d is None] + [kept[k] for k in keys if group[k] == k]

    texts, gone = [t for _, t in rows], [np.zeros(len(t), bool) for _, t in rows]
    places = [[m.span() for m in regex.finditer(r"\S+", t)] for t in texts]
    strings = [[((i, i + 400), t[i:i + 400]) for i in range(len(t) - 399)] for t in texts]
    passages = [[((at[i][0], at[i + 50][1]), tuple(t.lower().split()[i:i + 51])) for i in range(len(at) - 50)] for t, at in zip(texts, places)]
    for found in (strings, passages):
        seen = Counter(x for mine in found for _, x in mine)
        for mine, mask in zip(found, gone):
            for (a, b), x in mine:
                if seen[x] > 1:
                    mask[a:b] = True
    rows = [(d, "".join(c for c, g in zip(t, mask) if not g)) for (d, t), mask in zip(rows, gone)]

    grams = lambda t: {tuple(t.split()[i:i + 8]) for i in range(len(t.split()) - 7)}
    planted = set().union(*map(grams, items))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    return [(d, tuple(library.encode_ordinary(t))) for d, t in rows if not grams(t) & planted]


def test_pipeline_like_brute_force(spark, tmp_path):
    import corpus_pipeline
    random = np.random.default_rng(12)
    word = lambda: "".join(random.choice(list("abcdefghijkl"), 5))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short, blob, items, base = prose(51), prose(50), "".join(word() for _ in range(90)), [prose(12), prose(20)], prose(100)
    assert len(passage) < 400
    rows = [(i, prose(60)) for i in range(40)] + [(40 + i, f"$$$ %%% {i} ### &&& 77 | |") for i in range(30)] + [(70, ""), (71, None)]
    rows += [(80 + i, base.replace(base.split()[20 * i], word())) for i in range(4)] + [(79, prose(70)), (84, base)]
    rows += [(90 + i, f"{prose(30)} {passage} {prose(30)}") for i in range(3)] + [(95 + i, f"{prose(40)} {short} {prose(40)}") for i in range(2)]
    rows += [(100 + i, f"{prose(40)} {blob} {prose(9)}") for i in range(2)]
    rows += [(110, f"{prose(20)} {items[0]} {prose(20)}"), (110, prose(45)), (None, f"{prose(20)} {items[1]} {prose(20)}"), (None, prose(45)), (None, f"{prose(40)} {passage}")]
    rows += [(120, prose(50)), (120, prose(50)), (121, rows[0][1])]
    rows += [rows[5], rows[6]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = sorted({(d, int(any(c.islower() for c in t or "")), 0) for d, t in rows if d is not None})
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute_pipeline(rows, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 50 < len(want) < len(rows) - 35
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in got) == Counter((d, len(x), x) for d, x in want)
