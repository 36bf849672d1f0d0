"""Every language is learned; kernel ridge regression against a dense solution."""

import zlib

import numpy as np

from sparkloom.llm import language_id

SF = "/root/testdata/sf0.01"


def made(n, seed):
    rng = np.random.default_rng(seed)
    letters = [chr(0x4E00 + 7 * n + i) for i in range(7)]
    return " ".join("".join(rng.choice(letters, rng.integers(2, 7))) for _ in range(12))


def test_more_than_sixty_four_languages(spark):
    rows = [(80 * i + n, made(n, 80 * i + n), f"l{n:02d}") for n in range(80) for i in range(6)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), lambda i: i >= 0)
    assert len(model.languages) == 80 and len(model.landmarks) == 480
    probe = [(n, made(n, 10_000 + n), 1) for n in range(80)]
    got = language_id.identify(spark.createDataFrame(probe, "doc_id long, text string, lang int"), model).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id:02d}" for r in got]) > 0.95


def test_languages_of_one_id_or_one_text(spark):
    rows = [(1, made(0, i), "a") for i in range(2000)] + [(i, made(1, 5), "b") for i in range(3, 2000)] + [(7, made(2, 6), "c")] * 2000 + [(2, None, "d"), (9, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, lambda i: i >= 0)
    assert model.languages == ["a", "b", "c"]
    got = language_id.predict([made(0, 90_000), made(1, 5), made(2, 6)], model)
    assert got[0] == ["a", "b", "c"]


def test_nystroem_with_all_rows_is_kernel_ridge_regression(spark):
    """With every training row a landmark the weights are those of dense ridge regression on the whole kernel."""
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null").orderBy("doc_id").limit(160).collect()]
    bits, labels = language_id.presence([r.text for r in docs]), [r.lang for r in docs]
    model = language_id.train(bits, labels, landmarks=len(docs))
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    k = bits.astype(float) @ bits.T.astype(float)
    size = np.sqrt(np.maximum(bits.sum(axis=1), 1))
    k = k / size[:, None] / size[None, :]
    targets = np.where(y[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    share = 1.0 / np.bincount(y)[y]
    share /= share.mean()
    # Weighted ridge with an intercept: minimise sum s (t - f - b)^2 + r |f|^2, in the dual of the centred kernel.
    ridge = language_id.RIDGE * len(docs) / len(languages) * 0.1
    w = share / share.sum()
    centre = np.eye(len(docs)) - np.outer(np.ones(len(docs)), w)
    kc = centre @ k @ centre.T
    level = w @ targets
    root = np.sqrt(share)
    alpha = root[:, None] * np.linalg.solve(root[:, None] * kc * root[None, :] + ridge * np.eye(len(docs)), root[:, None] * (targets - level))
    dense = kc @ alpha + level
    got = language_id.KernelModel.kernel(bits, model.landmarks, model.norms) @ model.weights + model.bias
    assert np.abs(got - dense).max() < 0.02 and (got.argmax(axis=1) == dense.argmax(axis=1)).all()


STRANGE = [
    "これは日本語の文章です。水は低きに流れ、人は易きに流れる。昔々あるところにおじいさんとおばあさんがいました。",
    "Это русский текст о погоде и природе. Сегодня утром шёл дождь, а вечером снова вышло солнце.",
    "这是一段中文文本，讲述的是天气和自然。昨天下雨了，今天太阳出来了。",
    "Αυτό είναι ένα ελληνικό κείμενο για τον καιρό και τη φύση.",
    "qwrtz plmk xcvb",
]


def test_no_language_claims_what_was_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs, learned_rows)
    rows = [(-i, t, None) for i, t in enumerate([*STRANGE, STRANGE[1] * 200, "", " 12 ", None], 1)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema)).selectExpr("lang AS score", "*", "1 AS lang_pred")
    out = language_id.keep(more, model)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == more.columns and not any(i < 0 for i in kept)
    held_out = [r.doc_id for r in docs.where("text is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any(map(str.isalpha, r.text))]
    assert len(held_out) > 150 and sum(i not in kept for i in held_out) < len(held_out) / 100
    known = next(r.text for r in docs.where("lang = 'en' and length(text) > 500").collect())
    for text in (known * 400, known[:1024] * 3 + STRANGE[1][:40], known[:60]):
        assert language_id.claimed([text], ["en"], model).all()


def learned_rows(column):
    return language_id.F.crc32(column.cast("string").cast("binary")) % 5 != 0
