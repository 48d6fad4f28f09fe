import random
import re

import numpy as np
import pytest

from brindle.llm import toxicity
from brindle.llm.boosting import fit_boosted, fit_isotonic
from brindle.llm.toxicity import FEATURES, features

from .conftest import DOC


def _f(text):
    return dict(zip(FEATURES, features([text])[0], strict=True))


def test_features_of_one_text():
    f = _f("You ARE an idiot! Idiot... or not?")
    assert f["lexicon_density"] == pytest.approx(2 / 7) and f["lexicon_distinct"] == 1
    assert f["second_person_density"] == pytest.approx(1 / 7) and f["near_second_person"] == pytest.approx(2 / 7)
    assert f["shouted_words"] == pytest.approx(1 / 7) and f["obfuscation_rate"] == 0
    assert f["exclamation_rate"] == pytest.approx(1 / 34) and f["repeated_punctuation"] == pytest.approx(2 / 34)


def test_obfuscated_words_are_hits():
    assert _f("such a m0r0n and st*pid l.o.s.e.r looooser")["lexicon_hits"] == pytest.approx(np.log1p(4))
    assert _f("Plain end.Next (words) 3.5 a-b")["obfuscation_rate"] == 0


def _slow(text):
    """Ten of the features, a character and a word at a time."""
    words = re.findall("[0-9A-Za-z\\u0080-\\U0010ffff]+", text)
    low = [w.lower() for w in words]
    n = max(len(words), 1)
    at = [i for i, w in enumerate(low) if w in toxicity.LEXICON]
    letters = [c for c in text if c.isalpha() and len(c.encode()) < 3]
    raw = text.encode()
    punct = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    size = max(len(raw), 1)
    return {
        "second_person_density": sum(w in toxicity.SECOND_PERSON for w in low) / n,
        "near_second_person": sum(any(w in toxicity.SECOND_PERSON for w in low[max(0, i - 5) : i + 6]) for i in at) / n,
        "capital_rate": sum(c.isupper() for c in letters) / max(len(letters), 1),
        "shouted_words": sum(len(w.encode()) > 2 and all(c.isupper() for c in w) for w in words) / n,
        "punctuation_rate": sum(map(punct, raw)) / size,
        "exclamation_rate": text.count("!") / size,
        "question_rate": text.count("?") / size,
        "repeated_punctuation": sum(punct(a) and a == b for a, b in zip(raw, raw[1:], strict=False)) / size,
        "mixed_words": sum(bool(re.search("[A-Za-z]", w)) and bool(re.search("[0-9]", w)) for w in words) / n,
        "digit_rate": sum(c in "0123456789" for c in text) / size,
        "log_words": np.log1p(len(words)),
        "beyond_ascii": sum(b > 127 for b in raw) / size,
        "lexicon_plain": len(at),
    }


def test_features_against_a_slow_extractor():
    rng = random.Random(5)
    bits = ["idiot", "Idiot", "scum", "you", "YOU", "Sie", "ÉTÉ", "été", "ΔΕΛΤΑ", "МИР", "мир", "a1b2", "42", "!!", "??", "...", "fine", "DAY", "e-mail", "(x)", "ß", "日本", "😀", "trash", "st*pid"]
    for _ in range(200):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))
        got, want = _f(text), _slow(text)
        hits = want.pop("lexicon_plain")
        assert np.expm1(got["lexicon_hits"]) == pytest.approx(hits + text.split().count("st*pid"), abs=1e-6)
        assert {k: got[k] for k in want} == pytest.approx(want), text


def test_accented_capitals_are_capitals():
    assert _f("ÉTÉ")["capital_rate"] == 1 and _f("ÉTÉ")["shouted_words"] == 1 and _f("Été")["capital_rate"] == pytest.approx(1 / 3)


def test_features_do_not_depend_on_the_batch(monkeypatch):
    texts = ["idiot you", None, "", "Fine day.", "été ÉTÉ m0ron", "x" * 5000, "a!!b"] * 4
    one = np.concatenate([features([t]) for t in texts])
    assert np.allclose(one, features(texts))
    monkeypatch.setattr(toxicity, "blocks", lambda t: __import__("brindle.llm.textkernel", fromlist=["blocks"]).blocks(t, 10))
    assert np.allclose(one, features(texts))


def _labelled(spark, n, seed):
    """Toxic texts hold insults, or words of a made-up stem that only labels can teach."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randrange(20, 120))], i % 5 == 0
        if bad:
            for _ in range(1 + len(words) // 20):
                words[rng.randrange(len(words))] = "zorkig" + word() if i % 2 else rng.choice(["idiot", "Scum", "worthless", "m0ron"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _labelled(spark, 1200, 1)
    model = toxicity.train(docs, labels.where("doc_id < 800"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.scored(docs.where("doc_id >= 800"), model).collect()}
    truth = {i: i % 5 == 0 for i in range(800, 1200)}
    caught = sum(got[i] for i in truth if truth[i]) / sum(truth.values())
    assert caught > 0.9 and sum(got[i] for i in truth if not truth[i]) <= 3
    again = toxicity.train(docs.repartition(5), labels.where("doc_id < 800").repartition(3))
    assert np.allclose(model.score(["you idiot", "zorkigal la"]), again.score(["you idiot", "zorkigal la"]))


def test_odd_rows(spark, odd, clashing):
    docs, labels = _labelled(spark, 200, 2)
    model = toxicity.train(docs, labels)
    for df in (odd, clashing):
        rows = toxicity.scored(df, model).collect()
        assert len(rows) == odd.count() and not any(r["toxic"] for r in rows)
        assert sum(r["score"] is None for r in rows) == 2
        kept = toxicity.without_toxic(df, model)
        assert kept.columns == df.columns and kept.count() == odd.count()


def test_no_usable_labels(spark, odd):
    none = spark.createDataFrame([(1, 1, None), (None, 0, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.train(odd, none) is None and toxicity.train(odd.limit(0), none) is None
    assert all(r["score"] is None and not r["toxic"] for r in toxicity.scored(odd, None).collect())
    assert toxicity.without_toxic(odd, None).count() == odd.count()
    assert toxicity.scored(spark.createDataFrame([], DOC), None).count() == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    m = fit_boosted(x[:1500], y[:1500])
    assert ((m.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(1)
    x = np.arange(60.0)
    y = (rng.random(60) < x / 60).astype(float)
    fit = fit_isotonic(x, y)
    assert (np.diff(fit.value) > 0).all()
    # min-max formula
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    blocks = {round(v, 12) for v in want}
    assert blocks == {round(v, 12) for v in fit.value}
