"""Language ID and quality: held-out accuracy, defined results and bounds."""

import numpy as np
import pytest
from assayer.llm import language_id, quality, queries
from assayer.llm.base import load


def test_language_accuracy_on_held_out_rows(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in load(spark, sf_dir, "documents").collect()}
    rows = [r for r in queries.op1_language_id(spark, sf_dir).collect() if r["held_out"]]
    assert len(rows) > 20
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_the_held_out_fold_and_other_columns_change_nothing(spark, sf_dir):
    from assayer.llm.base import held_out
    from pyspark.sql import functions as F

    docs = load(spark, sf_dir, "documents")
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    a, b = (language_id.predict(d, language_id.fit(d)).orderBy("doc_id").collect() for d in (docs, other))
    assert a == b


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    rows = language_id.predict(odd_docs, model).collect()
    assert len(rows) == 12
    blank = [r for r in rows if r["doc_id"] in (2, 3, 4, 5)]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in blank)
    kept = language_id.keep_known(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == 7
    assert language_id.predict(no_docs, model).count() == 0
    nothing = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, nothing).collect()} == {"und"}


def test_language_counts_are_those_of_plain_strings():
    into = {}
    language_id.count_grams(["Ab, ab!", "", None, "éa"], ["x", "x", "x", "y"], into)
    assert into["x"].sum() == sum(len(" ab ab ") + 1 - n for n in (1, 2, 3, 4))
    assert into["y"].sum() == 3 + 2 + 1
    same, other = {}, {}
    language_id.count_grams(["ab ab"], ["x"], same)
    language_id.count_grams(["AB  -- ab"], ["x"], other)
    assert np.array_equal(same["x"], other["x"])


def test_long_texts_are_scored_whole(monkeypatch):
    into = {}
    language_id.count_grams(["the cat sat on the mat " * 9, "le chat est sur la table " * 9], ["en", "fr"], into)
    model = language_id.Model(["en", "fr"], np.stack([into["en"], into["fr"]], axis=1).astype(float), np.array([1.0, 1.0]))
    text = "the mat " * 50 + "le chat est la " * 500
    whole = model.score([text])
    monkeypatch.setattr(language_id, "PIECE", 400)
    assert model.score([text])[0] == whole[0] == ["fr"]


def plain_grams(text):
    """Grams of one to four characters of the folded text, as strings."""
    folded = " " + "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in folded:
        folded = folded.replace("  ", " ")
    return [folded[k : k + n] for n in range(1, language_id.ORDERS + 1) for k in range(len(folded) - n + 1)]


def bucket_of(gram):
    state = 0
    for n, c in enumerate(gram, 1):
        state = (state * 0x9E3779B1 + ord(c) + n) % (1 << 32)
    mixed = ((state ^ (state >> 15)) * 0x85EBCA6B) % (1 << 32)
    return mixed >> 16


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 1 << 16])
def test_pieces_change_no_count(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    texts = ["Ab, ab! cd--e  f\n\n" * 16, "  12 ÀÉ straße ΣΑΣ " * 9, "", None, "x" * 200, " " * 90 + "ab" + "." * 70 + "İc"]
    into = {}
    language_id.count_grams(texts, ["a", "b", "a", "b", "a", "b"], into)
    for name, mine in (("a", (0, 2, 4)), ("b", (1, 3, 5))):
        want = np.zeros(language_id.BUCKETS, dtype=np.int64)
        for k in mine:
            for gram in plain_grams(texts[k]) if texts[k] else ():
                want[bucket_of(gram)] += 1
        assert np.array_equal(into[name], want)


def test_predictions_are_those_of_plain_naive_bayes(spark, make_docs):
    import math
    import random

    rnd = random.Random(3)
    words = {"en": "the of and water house never".split(), "de": "der die und wasser haus niemals".split(), "sw": "na ya wa maji nyumba kamwe".split()}
    rows = [(k, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randrange(1, 40))), lang, "s", 0) for k, lang in enumerate(["en", "de", "en", "sw", "en"] * 30)]
    rows += [(900, "the der maji", None, "s", 0), (901, "Haus, HAUS!", None, "s", 0)]
    docs = make_docs(rows)
    from assayer.llm.base import held_out
    from pyspark.sql import functions as F

    kept = {r["doc_id"] for r in docs.where(~held_out(F.col("doc_id"))).collect()}
    learnt = [(t, lang) for k, t, lang, *_ in rows if lang and k in kept]
    counts = {lang: np.zeros(language_id.BUCKETS) for lang in sorted(words)}
    for text, lang in learnt:
        for gram in plain_grams(text):
            counts[lang][bucket_of(gram)] += 1
    n_docs = {lang: sum(x == lang for _, x in learnt) + 1 for lang in counts}
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    for k, text, *_ in rows:
        grams = plain_grams(text)
        likely = {}
        for lang, n in counts.items():
            total = n.sum() + 0.5 * language_id.BUCKETS
            said = sum(math.log((n[bucket_of(g)] + 0.5) / total) for g in grams)
            likely[lang] = said * min(1, language_id.EVIDENCE / len(grams)) + math.log(n_docs[lang] / sum(n_docs.values()))
        best = max(likely, key=likely.get)
        share = 1 / sum(math.exp(v - likely[best]) for v in likely.values())
        assert got[k]["lang_pred"] == best and abs(got[k]["score"] - share) < 1e-3


def test_rare_languages_are_learnt_from_all_their_rows(make_docs):
    rows = [(k, f"common words {k}", "en", "s", 0) for k in range(400)] + [(1000 + k, f"maji nyumba {k}", "sw", "s", 0) for k in range(12)]
    model = language_id.fit(make_docs(rows), train_docs=20)
    names, _ = model.score(["maji nyumba", "common words"])
    assert names == ["sw", "en"]


def test_too_many_languages_are_refused(spark, make_docs, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language_id.fit(make_docs([(k, "text", f"l{k}", "s", 4) for k in (0, 1, 2, 3, 4, 5)]))


def test_quality_on_held_out_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in load(spark, sf_dir, "labels").collect()}
    rows = [r for r in queries.op8_quality(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    good = [r["score"] for r in rows if labels[r["doc_id"]] == 1]
    bad = [r["score"] for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(r["score"] >= 0.7) == (labels[r["doc_id"]] == 1) for r in rows]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs, labels)
    rows = quality.score_quality(odd_docs, model).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(no_docs, model).count() == 0
    empty = quality.fit(no_docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(odd_docs, empty).collect()} == {0.0}


def test_prior_of_a_known_mixture():
    random = np.random.default_rng(1)
    positive = random.normal(2, 1, 4000)
    mixed = np.concatenate([random.normal(2, 1, 3000), random.normal(-2, 1, 7000)])
    assert abs(quality.estimate_prior(positive, mixed) - 0.3) < 0.06


def test_risk_is_the_non_negative_unbiased_one():
    random = np.random.default_rng(4)
    make = lambda centre, n: np.hstack([random.normal(centre, 1, (n, quality.MEASURES)), np.zeros((n, quality.GRAMS))]).astype(np.float32)
    positive, unlabelled = make(0.4, 600), np.vstack([make(0.4, 300), make(-0.4, 700)])
    model = quality.Model(positive, unlabelled)
    assert abs(model.prior - 0.3) < 0.1
    p, u = (quality._spread(x, model.middle, model.width).astype(float)[:, : -quality.GRAMS] for x in (positive, unlabelled))
    learnt = model.weights[: -quality.GRAMS].astype(float)
    assert not model.weights[-quality.GRAMS :].any()

    def risk(w):
        loss = lambda z: np.logaddexp(0, z).mean()
        return model.prior * loss(-(p @ w)) + max(0.0, loss(u @ w) - model.prior * loss(p @ w)) + 0.5 * quality.DECAY / len(p) * (w[1:] @ w[1:])

    w, step = np.zeros(p.shape[1]), 0.2
    for _ in range(1000):
        yes, other = 1 / (1 + np.exp(-(p @ w))), 1 / (1 + np.exp(-(u @ w)))
        negative = (u * other[:, None]).mean(axis=0) - model.prior * (p * yes[:, None]).mean(axis=0)
        inside = np.logaddexp(0, u @ w).mean() - model.prior * np.logaddexp(0, p @ w).mean() >= 0
        gradient = model.prior * (p * (yes - 1)[:, None]).mean(axis=0) + (negative if inside else 0)
        gradient[1:] += quality.DECAY / len(p) * w[1:]
        w -= step * gradient
    # Batches are noisy, so the risk is compared with that of no model, and scores with those of whole-sample descent.
    assert risk(w) <= risk(learnt) < 0.15 * risk(0 * w) and np.corrcoef(u @ w, u @ learnt)[0, 1] > 0.97
    assert np.mean((u @ w > 0) == (u @ learnt > 0)) > 0.95


def test_grams_carry_the_wording():
    a, b, c = (quality.gram_shares(t) for t in ("buy cheap now", "BUY cheap now", "a treatise on rivers"))
    assert np.array_equal(a, b) and a @ c < 0.3 and abs(a @ a - 1) < 1e-9 and not quality.gram_shares("ab").any() and not quality.gram_shares(None).any()


def test_measures_have_a_fixed_number():
    assert len(quality.measures("Some words, here.")) == len(quality.measures(None)) == quality.MEASURES
