import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmend.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_pu_learning_finds_the_hidden_positives():
    rng = np.random.default_rng(1)
    words = [f"w{i}x" for i in range(300)]
    text = lambda bad: " ".join(rng.choice(words, 80).tolist() + ["nastyword", "vileword", "nastyword"] * bad)
    positive = [toxicity.features(text(True)) for _ in range(60)]
    unlabelled = [toxicity.features(text(i % 10 == 0)) for i in range(600)]
    m = toxicity.fit(positive, unlabelled, 0.1)
    assert min(m.score(text(True)) for _ in range(20)) > 0.5 > max(m.score(text(False)) for _ in range(20))
    assert toxicity.fit([], unlabelled, 0.1).score("anything") == 0.0


def test_toxicity_held_out(spark):
    got = queries.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_rows(odd, none, clashing):
    m = toxicity.Model(np.ones(toxicity.DIMS, np.float32), -1.0, 0.1)
    got = toxicity.score_documents(odd, m).collect()
    assert len(got) == odd.count() and len({r.toxicity for r in got if not r.text}) == 1
    assert toxicity.score_documents(clashing, m).count() == odd.count() and toxicity.score_documents(none, m).count() == 0


@pytest.fixture(scope="module")
def crf(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.train(docs, F.col("doc_id") % 4 != 0, max_rows=60), docs


def test_languages_held_out(crf):
    model, docs = crf
    rows = docs.where("doc_id % 4 = 0").collect()
    got = model.predict([r.text for r in rows])
    assert np.mean([g[0] == r.lang for g, r in zip(got, rows, strict=True)]) >= 0.97


def test_code_switching(crf):
    model, docs = crf
    text = {y: docs.where(F.col("lang") == y).orderBy(F.desc("n_chars")).first().text.replace("\n", " ")[:90] for y in ("en", "de")}
    labels = [x[1] for x in langid.label_words(f"{text['en']} {text['de']}", model)]
    third = len(labels) // 3
    assert set(labels[:third]) == {"en"} and set(labels[-third:]) == {"de"}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    gamma, pairs, z = langid.forward_backward(emit, trans, np.array([4]))
    paths = [(p, sum(emit[0, t, p[t]] for t in range(4)) + sum(trans[p[t], p[t + 1]] for t in range(3))) for p in np.ndindex(3, 3, 3, 3)]
    total = np.logaddexp.reduce([s for _, s in paths])
    assert np.isclose(z[0], total)
    for t in range(4):
        for y in range(3):
            assert np.isclose(gamma[0, t, y], sum(np.exp(s - total) for p, s in paths if p[t] == y))
    assert np.isclose(pairs.sum(), 3)


def test_language_rows(crf, odd, none, clashing):
    model, _ = crf
    got = {(r.doc_id, r.lang_pred) for r in langid.label_documents(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (6, "und")} <= got
    assert langid.label_documents(none, model).count() == 0 and langid.label_documents(clashing, model).count() == odd.count()
    assert langid.fit([]).predict(["text", None]) == [("und", 0.0)] * 2


def test_every_language_is_trained(spark, monkeypatch):
    monkeypatch.setattr(langid, "fit", lambda rows: {y for _, y in rows})
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 90}") for i in range(270)], "doc_id long, text string, lang string")
    assert langid.train(docs, F.lit(True)) == {f"l{k}" for k in range(90)}


def test_words_of_documents(crf, odd, none):
    model, _ = crf
    got = langid.label_document_words(odd, model).collect()
    assert len(got) == odd.count() and langid.label_document_words(none, model).count() == 0
    by = {r.doc_id: r.words for r in got}
    assert by[2] == by[3] == by[6] == [] and [w.word for w in by[7]] == [w for w, *_ in langid.label_words("ünïcode Straße ÀÉ 日本語 テキスト 🎉 and ASCII", model)]
    assert all(w.lang in model.languages and 0 <= w.score <= 1 for w in by[7])


def test_training_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (5, 0), (99, 1)], "doc_id long, toxic int")
    for docs in (odd, none):
        for marks in (labels, labels.limit(0)):
            scored = toxicity.score_documents(docs, toxicity.train(docs, marks, F.lit(True))).collect()
            assert len(scored) == docs.count() and all(0 <= r.toxicity <= 1 for r in scored)
        model = langid.train(docs, F.lit(True))
        assert langid.label_documents(docs, model).count() == docs.count()


def test_training_draws_the_same(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    draws = [toxicity.sample_of(d, labels, F.lit(True), 20, 50) for d in (docs, docs.repartition(7))]
    first, second = ({tuple(r) for r in d.collect()} for d in draws)
    assert first == second and 50 < len(first) <= 70


def test_risk_gradient_lowers_the_risk():
    # the estimator p * mean_P l(+) + max(0, mean_U l(-) - p * mean_P l(-)) falls from the start to the fitted model
    rng = np.random.default_rng(2)
    words = [f"w{i}x" for i in range(60)]
    make = lambda bad: toxicity.features(" ".join(rng.choice(words, 30).tolist() + ["nastyword"] * bad))
    positive, unlabelled, prior = [make(3) for _ in range(50)], [make(3 * (i % 8 == 0)) for i in range(400)], 1 / 8
    model = toxicity.fit(positive, unlabelled, prior)

    def risk(w, b):
        z = lambda rows: np.array([b + w[s] @ v for s, v in rows])
        zp, zu = z(positive), z(unlabelled)
        plus, minus = np.logaddexp(0, -zp).mean(), np.logaddexp(0, zp).mean()
        return prior * plus + max(0, np.logaddexp(0, zu).mean() - prior * minus)

    assert risk(model.weights, model.bias) < 0.5 * risk(np.zeros(toxicity.DIMS), np.log(prior / (1 - prior)))
