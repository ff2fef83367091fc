import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, rows, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = [r for r in rows if r.held_out and r.doc_id in labels]
    y, p = np.array([labels[r.doc_id] for r in x]), np.array([r.score for r in x])
    auc = (p[y == 1][:, None] > p[y == 0][None]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0][None]).mean()
    return auc, np.array([r.predicted for r in x]), y


def test_quality(spark):
    rows = quality.op10_quality(spark, SF).collect()
    auc, predicted, y = held_out(spark, rows, "quality")
    assert len(rows) == 1000 and auc > 0.97 and (predicted == y).mean() > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity(spark):
    rows = toxicity.op9_toxicity(spark, SF).collect()
    auc, predicted, y = held_out(spark, rows, "toxic")
    assert len(rows) == 1000 and auc > 0.8 and (predicted[y == 0] == 0).mean() > 0.97


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    schema = "doc_id long, text string, score string, y string"
    rows = [(1, "Some plain words here.", "a", None), (None, None, None, "b"), (3, "", "c", None), (3, "", "c", None), (4, "long " * 20_000, "", "")]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.fit(docs, none)
    got = module.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    some = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert module.score(docs, module.fit(docs, some)).count() == 5
    assert module.score(docs.limit(0), module.fit(docs.limit(0), none)).count() == 0


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (300, 2)), rng.normal(2, 0.5, (300, 2))])
    y = np.repeat([0, 1], 300)
    model = quality.Discriminant.fit(x, y, pooled=0.0, ridge=0.0)
    z = (x - x.mean(0)) / x.std(0)
    dense = []
    for k in (0, 1):
        d = z - z[y == k].mean(0)
        c = np.cov(z[y == k].T, bias=True)
        dense.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.log(np.linalg.det(c)))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(dense[1] - dense[0]))), atol=1e-9)


def test_restoration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = toxicity.Restorer(toxicity.language_model(docs.where(F.col("lang") == "en")))
    for seen, word in {"1d10t": "idiot", "i d i o t": "idiot", "idiooot": "idiot", "m0r0n": "moron", "s.t.u.p.i.d": "stupid", "cl0wn": "clown"}.items():
        assert r.restore(seen) == word
    assert "moron" in toxicity.units("m0r0n!", r) and toxicity.units("table", r) == ["table"]
    long_run = " ".join("you are an idiot and a fool of a kind that has no end at all " * 4).replace("   ", " ")
    assert "^idiot" in toxicity.Reader(toxicity.language_model(docs)).spaced(long_run)
    lm = toxicity.language_model(docs)
    reader = toxicity.Reader(lm)
    assert "^moron" in reader("a m o r o n here") and reader("") == set()
    known = toxicity.Reader(lm, {"moron": 0, "^here": 1})
    assert known("a m o r o n here") == {0, 1}


def test_decoder_against_brute_force(spark):
    """On short tokens the search finds the cheapest of all readings."""
    lm = toxicity.language_model(spark.createDataFrame([("tie tin ten net toe one eon into tote",)], "text string"))
    r = toxicity.Restorer(lm)
    index = {c: i + 1 for i, c in enumerate(toxicity.LETTERS)}

    def cost(seen, at, a, b, total):
        if at == len(seen):
            yield total - lm[a][b][0], ""
            return
        c = seen[at]
        for x, price in [(c, toxicity.KEEP)] * (c in index) + [(x, toxicity.RESEMBLE) for x in toxicity.RESEMBLES.get(c, "")]:
            i = index[x]
            for t, rest in cost(seen, at + 1, b, i, total + price - lm[a][b][i] + (toxicity.DOUBLE if i == b else 0)):
                yield t, x + rest
            if i == b:
                yield from cost(seen, at + 1, a, b, total + toxicity.AGAIN)
        if c in toxicity.SEPARATORS:
            yield from cost(seen, at + 1, a, b, total + toxicity.APART)

    for seen in ("t1e", "7 0 e", "n3tt", "0n3", "t.e.n"):
        assert r.restore(seen) == min(cost(seen, 0, 0, 0, 0.0))[1]


def test_look_alikes_are_restored(spark):
    lm = toxicity.language_model(spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang") == "en"))
    r = toxicity.Restorer(lm)
    for seen in ("іdіоt", "idi\u200bot", "ｉｄｉｏｔ", "1d\u00ad10t", "iδιot".replace("δ", "d")):
        assert "idiot" in toxicity.units(seen, r), seen
    assert toxicity.units("слово", r) == ["слово"] and toxicity.units("été", r) == ["été"]


def plain_statistics(text):
    """The 12 statistics by counting characters, words and lines one at a time."""
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    if not raw:
        return [0.0] * 12
    n, m = len(raw), max(1, len(words))
    count = lambda ok: sum(ok(chr(b)) for b in raw if b < 128)
    upper, lower, digit = count(str.isupper), count(str.islower), count(str.isdigit)
    plain = count(lambda c: c in ".,;:'\"-()?")
    symbol = count(lambda c: 32 < ord(c) < 127 and not c.isalnum() and c not in ".,;:'\"-()?")
    logit = lambda a, b: math.log((a + 0.5) / (b + 0.5))
    packed = sum(len(zlib.compress(raw[k : k + quality.PIECE], 1)) for k in range(0, n, quality.PIECE))
    return [
        math.log(1 + n), math.log(n / m), logit(upper, lower + 1), logit(digit, n), logit(plain, n), logit(symbol, n), logit(text.count("!"), n), logit(text.count("|"), n),
        math.log(len(set(words)) + 1) - 0.8 * math.log(m + 1), math.log((packed + 1) / (n + 20)), math.log(n / len(lines)), logit(len(lines) - len(set(lines)), len(lines)),
    ]


def test_statistics_against_plain_counts():
    r = np.random.default_rng(2)
    letters = list("abcDEF 123 .,;:!?|$%\n\t") + ["é", "日"]
    texts = ["", "a", "\n\n", "One two two.\nOne two two.\n"] + ["".join(r.choice(letters, int(k))) for k in r.integers(1, 400, 60)] + ["ab " * 30_000]
    for t in texts:
        assert np.allclose(quality.statistics(t), plain_statistics(t), atol=1e-12), t


def test_scores_are_those_of_the_models(spark):
    """Of both classifiers: the score of every row from the fitted model, by a plain formula."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").collect()
    model = toxicity.fit(docs, labels)
    reader = toxicity.Reader(model.lm, model.known)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in rows:
        odds = model.bias + sum(model.weights[f] for f in reader(r.text or ""))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-odds))) < 1e-12
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in rows:
        z = (np.array(plain_statistics(r.text or "")) - model.scale[0]) / model.scale[1]
        dense = [-0.5 * (z - mu) @ np.linalg.inv(f @ f.T) @ (z - mu) - 0.5 * np.linalg.slogdet(f @ f.T)[1] for mu, f in zip(model.means, model.factors, strict=True)]
        odds = dense[1] - dense[0] + math.log(model.prior / (1 - model.prior))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-min(500, max(-500, odds))))) < 1e-6
