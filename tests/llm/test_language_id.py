"""Language identification: held-out accuracy, sparsity, calibration and odd rows."""

import numpy as np

from plumbline.llm import language_id as li

WORDS = {
    "en": ["the", "lung", "fields", "are", "clear", "with", "no", "effusion", "seen", "heart", "which", "should"],
    "fr": ["les", "poumons", "sont", "clairs", "sans", "épanchement", "cœur", "où", "être", "avec", "dans", "vu"],
    "de": ["die", "lunge", "ist", "frei", "kein", "erguss", "herz", "größe", "nicht", "mit", "und", "über"],
}


def rows(n, seed=1):
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(draw.choice(WORDS[lang], draw.integers(3, 40))), lang))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    data = rows(300)
    odd = [(900, None, "en"), (901, "", None), (902, "12 + 34 !", "fr"), (None, "the lung is clear", None)]
    cases = spark.createDataFrame(data + odd, "id long, rationale string, lang string").withColumn("score", li.F.lit(1))
    got = {r["id"]: r for r in li.identify_language(cases.repartition(3), cases.filter("id % 4 <> 0")).collect()}
    held = [got[i]["lang_pred"] == lang for i, _, lang in data if i % 4 == 0]
    assert np.mean(held) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[None]["lang_pred"] == "en"


def test_no_labels_one_language_and_no_rows(spark):
    cases = spark.createDataFrame([(1, "the lung"), (2, "a heart")], "id long, rationale string")
    none = spark.createDataFrame([], "id long, rationale string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in li.identify_language(cases, none).collect()} == {("und", 0.0)}
    one = cases.withColumn("lang", li.F.lit("en"))
    assert {r["lang_pred"] for r in li.identify_language(cases, one).collect()} == {"en"}
    assert li.identify_language(cases.limit(0), one).count() == 0


def test_grams_of_a_text_by_hand():
    assert li.grams("").sum() == 1  # the one space
    assert "".join(map(chr, li.letters("Ab1,c  d"))) == " ab c d "
    whole = " ab "
    assert li.grams("AB").sum() == sum(len(whole) - n + 1 for n in li.ORDERS)
    assert (li.grams("xy zz") == li.grams("XY,, zz")).all()


def test_elastic_net_leaves_zeros_and_ftrl_descends():
    draw = np.random.default_rng(2)
    model = li.Ftrl(2)
    useful, noise = np.array([5]), np.arange(100, 200)
    for _ in range(400):
        label = int(draw.integers(2))
        at = np.concatenate([useful, draw.choice(noise, 3, replace=False)])
        model.learn(at, np.concatenate([[1.0 if label else -1.0], draw.normal(size=3) * 0.1]), label)
    w = model.weights()
    assert w[1, 5] > 0.5 > -0.5 > w[0, 5]
    assert (w[:, 100:200] == 0).mean() > 0.1 and (w[:, 300:] == 0).all()


def test_temperature_is_the_best_of_a_grid():
    draw = np.random.default_rng(3)
    logits = draw.normal(size=(500, 3)) * 4
    labels = np.array([draw.choice(3, p=p) for p in li.softmax(logits / 2.5)])
    t = li.best_temperature(logits, labels)
    assert 1.8 < t < 3.4


def plain_model(labelled):
    """Document frequencies of the labelled texts, counted one by one."""
    counts = np.zeros(li.FEATURES)
    for _, text, _ in labelled:
        counts += li.grams(text) > 0
    return np.log((1 + len(labelled)) / (1 + counts)) + 1


def test_held_out_and_unlabelled_texts_teach_nothing(spark):
    data = rows(120)
    kinds = "id long, rationale string, lang string"
    labelled = spark.createDataFrame([r for r in data if r[0] % 5] + [(777, "no language zzz qqq", None)], kinds)
    other = [(i, t if i % 5 else "zz qq jj " * i, lang) for i, t, lang in data]
    a, b = ({r["id"]: r for r in li.identify_language(spark.createDataFrame(x, kinds), labelled).collect()} for x in (data, other))
    assert all(a[i] == b[i] for i, _, _ in data if i % 5)
    model = li.learned_identifier(labelled)
    assert np.allclose(model.idf, plain_model([r for r in data if r[0] % 5]))
