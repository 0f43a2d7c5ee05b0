"""Language and quality models: held-out accuracy, arithmetic, odd rows; queries and pipeline."""
import glob
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from watchpost.llm import exact_dedup, language, quality, queries
from watchpost.llm.common import read

BIG = os.environ.get("WATCHPOST_MODEL_DATA", "/root/testdata/sf0.01")


def test_language_held_out(spark):
    docs = read(spark, BIG, "documents")
    got = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_quality_held_out(spark):
    docs, labels = read(spark, BIG, "documents"), read(spark, BIG, "labels")
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()
    assert held[held.quality == 1].predicted.mean() > 0.97


def test_models_survive_odd_rows(odd, none, rows):
    model = language.train(odd)
    got = language.identify(odd, model).collect()
    assert len(got) == len(rows)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 4)} == {"und"}
    assert {r["lang_pred"] for r in language.identify(odd, language.train(none)).collect()} == {"und"}
    marks = odd.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    model = quality.train(odd, marks)
    assert quality.score(odd, model).count() == len(rows)
    assert quality.keep_good(odd, model, threshold=0.0).schema == odd.schema
    assert quality.train(odd, marks.limit(0)) is None and quality.keep_good(odd, None).count() == len(rows)
    assert language.identify(none, None).count() == 0 and quality.score(none, None).count() == 0


def test_pairs_by_sum_of_squares():
    rng = np.random.default_rng(0)
    x, y = rng.random((6, quality.WIDTH)).astype(np.float32), np.array([0, 1] * 3, np.float32)
    model = quality.FactorisationMachine(x, y, rounds=1)
    some = np.zeros((1, quality.WIDTH), np.float32)
    some[0, [3, 50, 2049]] = [1, 2, 3]
    v = model.v[[3, 50, 2049]] * np.array([[1], [2], [3]])
    pairs = v[0] @ v[1] + v[0] @ v[2] + v[1] @ v[2]
    assert np.allclose(model.raw(some), model.bias + some @ model.w + pairs, atol=1e-4)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 20])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) >= max(1, code.shape[1] // 4)


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, sf)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_pipeline_stages(spark, sf):
    docs = read(spark, sf, "documents")
    schema, before = docs.schema, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.schema == schema, name
        rows = {r["doc_id"] for r in before.select("doc_id").collect()}
        kept = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert set(kept) <= rows and len(kept) == len(set(kept)) and len(kept) > 0.5 * len(rows)
        before = after
    texts = [r["text"] for r in before.select("text").collect()]
    assert len(texts) == len(set(texts))
    placed = corpus_pipeline.run(spark, sf).select("doc_id").distinct().count()
    assert placed == len(texts)


def test_pipeline_stages_survive_odd_rows(spark, odd, none, sf):
    for table in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            assert out.count() <= 500_000
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.schema == table.schema


def test_exact_stage_on_its_own_output_changes_nothing(odd):
    once = exact_dedup.drop_exact_copies(odd)
    assert exact_dedup.drop_exact_copies(once).count() == once.count()


def test_a_repeated_text_leaves_the_languages_learned(spark):
    """A third and more of all rows are copies of one text; no language is lost and none crowded out."""
    docs = read(spark, BIG, "documents").select("doc_id", "text", "lang").where("length(text) < 4000")
    one = docs.where("lang = 'de' AND length(text) > 200").orderBy("doc_id").limit(1)
    copies = one.crossJoin(spark.range(5000).select((F.col("id") + 1_000_000).alias("n"))).select(F.col("n").alias("doc_id"), "text", "lang")
    model = language.train(docs.unionByName(copies), sample_rows=400)
    assert model.languages == sorted(r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"])
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


def test_grams_and_decoding_by_plain_loops():
    texts_ = ["Das Haus, 12 Straße", "el niño  come", "", "x", "日本 語", "A" * 40]
    data = b"".join(t.encode() for t in texts_)
    starts = np.cumsum([0, *[len(t.encode()) for t in texts_]])
    got = language.grams(np.frombuffer(data, np.uint8), starts)
    for row, text in zip(got, texts_):
        letters = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in text.encode())
        want, at = np.zeros(language.WIDTH), 0
        for size, n in ((1, 256), (2, 1024), (3, 2048)):
            for i in range(len(letters) - size + 1):
                gram = letters[i:i + size]
                if gram.strip(b" "):
                    want[at + ((int.from_bytes(gram, "big") * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - n.bit_length() + 1))] += 1
            at += n
        want = np.sqrt(want)
        assert np.allclose(row, want / (np.linalg.norm(want) or 1), atol=1e-6)
    model = language.CodeModel(["a", "b", "c"], got[:3].astype(np.float32), np.array([0, 1, 2]), rounds=3)
    best, share, close = model.decode(got)
    for i, x in enumerate(got):
        cost = [sum(np.log1p(np.exp(-float(m) * c)) for m, c in zip(x @ model.weights + model.bias, word)) for word in model.code.astype(float)]
        odds = np.exp(-np.array(cost)) / np.exp(-np.array(cost)).sum()
        assert best[i] == int(np.argmin(cost)) and share[i] == pytest.approx(odds.max(), abs=1e-5) and close[i] == (odds.max() < 2 * np.sort(odds)[-2])


def test_quality_statistics_by_plain_counts():
    text = "One two two three, 45 #tags | x!\nOne two two three, 45 #tags | x!\nEnde. Ümläut"
    data = np.frombuffer(text.encode(), np.uint8)
    row = dict(zip(quality.STATS, quality.features(data, np.array([0, len(data)]))[0][quality.WORDS:]))
    letters = [c for c in text if c.isascii() and c.isalpha()]
    lines = text.split("\n")
    assert row["upper"] == pytest.approx(sum(c.isupper() for c in letters) / len(letters), abs=1e-6)
    assert row["digits"] == pytest.approx(5 * sum(c.isdigit() for c in text) / len(data), abs=1e-6)
    assert row["line_repeats"] == pytest.approx((len(lines) - len(set(lines))) / len(lines), abs=1e-6)
    assert row["bytes_high"] == pytest.approx(sum(b >= 128 for b in text.encode()) / len(data), abs=1e-6)
    words = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in text.encode()).split()
    assert row["distinct"] == pytest.approx(len(set(words)) / len(words), abs=1e-6) and row["empty"] == 0
    assert row["word_length"] == pytest.approx(sum(map(len, words)) / len(words) / 12, abs=1e-6)
    hashed = quality.features(data, np.array([0, len(data)]))[0][:quality.WORDS]
    assert np.count_nonzero(hashed) == len(set(words)) and hashed.max() == pytest.approx(np.log1p(100 * max(words.count(w) for w in words) / len(words)) / 4, abs=1e-5)
