"""Quality rules, language identification, toxicity and quality classifier."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tranche.llm import language_id as L, quality_fm as Q, quality_rules as R, toxicity as T


def brute_repeat(words):
    found = {}
    for i in range(len(words) - 7):
        found.setdefault(tuple(words[i:i + 8]), []).append(i)
    return len({j for at in found.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        assert R.repeated_words(words) == brute_repeat(words)


def test_rule_counts():
    got = R.judge("a #b\n\nc d\nc d\n \n|".encode(), "en", {}, R.Rules())
    assert got[:5] == (7, 8, 2, 1, 0) and got[5]


def _brute_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by the contract's words."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    repeat = brute_repeat(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, repeat,
            len(words) < 20 or 100 * repeat > 30 * len(words))


def test_counts_against_brute_force(spark, odd_documents):
    """All of op6's counts, over the given documents and the awkward ones."""
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for docs in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), odd_documents):
        got = sorted((tuple(r[c] for c in cols) for r in R.quality_report(docs).select(*cols).collect()))
        assert got == sorted(_brute_counts(r["text"]) for r in docs.select("text").collect())


def test_every_language_has_a_reference(spark):
    """However many languages there are, each is held against its own documents."""
    rng = random.Random(2)
    vocab = {k: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "abcdefgh"] for k in range(300)}
    docs = spark.createDataFrame([(k * 100 + j, " ".join(rng.choices(vocab[k], k=60)), f"l{k}") for k in range(300) for j in range(2)]
                                 + [(90_000, " ".join(rng.choices(vocab[7], k=60)), "l8"), (90_001, " ".join(rng.choices(vocab[299], k=60)), None)],
                                 "doc_id long, text string, lang string").repartition(4)
    rules = R.Rules(min_reference_words=100, max_repeat_pct=100)
    assert len(R.references(docs, rules)) == 300
    got = {r["doc_id"]: r["kept"] for r in R.quality_report(docs, rules).collect()}
    assert not got[90_000] and got[90_001] and all(kept for i, kept in got.items() if i < 90_000)


def test_js_distance_bounds():
    assert R.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert R.js_distance(np.array([1.0, 2]), np.array([2.0, 4])) == pytest.approx(0)


def test_quality_report_odd_rows(odd_documents, no_documents):
    rows = R.quality_report(odd_documents).collect()
    assert len(rows) == 11
    empty = [r for r in rows if r["doc_id"] == 2][0]
    assert (empty["n_words"], empty["word_chars"], empty["base_failed"], empty["kept"]) == (0, 0, True, False)
    assert R.quality_report(no_documents).count() == 0
    assert R.keep_good(odd_documents).columns == odd_documents.columns


def test_divergence_rejects_shouting_and_guards_short(spark):
    good = [(i, " ".join(random.Random(i).choices("the of and to in is was for that on".split(), k=200)), "en") for i in range(40)]
    docs = spark.createDataFrame([*good, (100, " ".join(["LOUD!!", "WORDS!!", "NOISE!!", f"X{1}!!"] + [f"Z{k}Q!!" for k in range(150)]), "en"),
                                  (101, "QQ WW " * 4 + "a b c d e f g h i j k l m n", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in R.quality_report(docs).collect()}
    assert not got[100]["base_failed"] and not got[100]["kept"]
    assert got[101]["word_distance"] is None                       # fewer words than the guard


def _language(rng, common, letters, n):
    """A text of n words: a third of them common ones, as in the given languages."""
    return " ".join(rng.choice(common) if rng.random() < 0.33 else "".join(rng.choices(letters, k=8)) for _ in range(n))


def test_texts_tagged_with_another_language_are_rejected(spark):
    rng = random.Random(5)
    kinds = {"en": "the of and to in is was for that on".split(), "de": "der und die in den von zu das mit sich".split()}
    make = lambda lang, n: _language(rng, kinds[lang], "abcdefghijklmnoprstuvw", n)
    rows = [(i, make(lang, rng.randint(100, 400)), lang) for i, lang in enumerate(["en", "de"] * 300)]
    rows += [(1000 + i, make("de" if i % 2 else "en", 250), "en" if i % 2 else "de") for i in range(20)]
    rows += [(2000 + i, make("en", 250), "it") for i in range(2)]      # a language too scarce for limits of its own
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = R.quality_report(docs).toPandas()
    assert not got[got.doc_id.between(1000, 1999)].kept.any()
    assert got[got.doc_id < 1000].kept.mean() > 0.98 and got[got.doc_id >= 2000].kept.all()
    assert {r["doc_id"] for r in R.keep_good(docs).select("doc_id").collect()} == set(got[got.kept].doc_id)


def test_texts_without_language_are_no_reference(spark):
    rng = random.Random(6)
    common = "the of and to in is was for that on".split()
    good = lambda: _language(rng, common, "abcdefghijklmnoprstuvw", 200)
    junk = lambda: " ".join("".join(rng.choices("#*$%&|<>", k=6)) for _ in range(200))
    rows = [(i, good(), "en") for i in range(60)]
    rows += [(1000 + i, junk(), None if i % 2 else "") for i in range(200)] + [(2000 + i, good(), None if i % 2 else "") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(R.references(docs)) == {"en"}
    got = R.quality_report(docs).toPandas()
    assert not got[got.doc_id.between(1000, 1999)].kept.any()
    assert got[got.doc_id >= 2000].kept.mean() > 0.9


def test_language_of_unseen_words(spark, odd_documents, no_documents):
    rng = random.Random(3)
    words = {"en": "the of and thing water other which their".split(), "de": "der und nicht keit schung über straße auch".split()}
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(["en", "de"] * 30)],
                                 "doc_id long, text string, lang string")
    model = L.fit(docs, F.lit(True))
    tell = L.Scorer(model, L.Settings())
    assert tell("watering the things")[0] == "en" and tell("forschungen straßen")[0] == "de"
    assert tell("12 !!") == ("und", 0.0) and tell("") == ("und", 0.0)
    got = {r["doc_id"]: r for r in L.predict(odd_documents, model).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und"
    nothing = L.fit(no_documents, F.lit(True))
    assert nothing["langs"] == [] and L.predict(odd_documents, nothing).where("lang_pred != 'und'").count() == 0
    assert L.predict(no_documents, model).count() == 0


def _brute_language(model, text, s=L.Settings()):
    """Word by word over plain dictionaries: every language's mean log frequency a word."""
    plain = {size: {key: {model["langs"][t["lang"][j]]: float(t["log"][j]) for j in range(t["starts"][i], t["starts"][i + 1])}
                    for key, i in t["numbers"].items()} for size, t in model["tables"].items()}
    none = {size: dict(zip(model["langs"], map(float, t["none"]))) for size, t in model["tables"].items()}
    total, n = dict.fromkeys(model["langs"], 0.0), 0
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        n += 1
        got = {lang: plain[0][w].get(lang, none[0][lang]) for lang in total} if w in plain[0] else None
        if got:
            top = max(got.values())
            got = {lang: x - top for lang, x in got.items()}
        else:
            padded = f" {w} "
            for step, k in enumerate(L.LENGTHS):
                known = [g for g in (padded[i:i + k] for i in range(len(padded) - k + 1)) if g in plain[k]]
                if known:
                    got = {lang: sum(plain[k][g].get(lang, none[k][lang]) for g in known) for lang in total}
                    top = max(got.values())
                    got = {lang: (x - top) / len(known) * s.backoff ** (step / 2) for lang, x in got.items()}
                    break
        for lang in total:
            total[lang] += (got or {}).get(lang, 0.0)
    if not n:
        return "und", 0.0
    mean = {lang: x / n for lang, x in total.items()}
    p = {lang: np.exp(s.sharpness * (x - max(mean.values()))) for lang, x in mean.items()}
    best = min(mean, key=lambda lang: (-round(mean[lang], 9), lang))
    return best, p[best] / sum(p.values())


def test_language_scores_against_brute_force(spark, odd_documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit(docs, F.col("doc_id") % 2 == 0)
    rows = [r["text"] or "" for r in docs.where("doc_id % 2 = 1").limit(30).collect() + odd_documents.collect()]
    rows += ["½ ²", "① Ⅳ", "x½y", "ŒUVRE straße-weg l'eau"]
    for settings in (L.Settings(), L.Settings(cache=3)):
        tell = L.Scorer(model, settings)
        for text in rows:
            lang, score = tell(text)
            want, share = _brute_language(model, text)
            assert lang == want and score == pytest.approx(share, abs=1e-4)
    assert tell("½ ²") == tell("① Ⅳ") == ("und", 0.0) and tell("x½y")[0] != "und"


def test_three_hundred_languages_and_a_rare_one(spark):
    """No language is left out, whatever their number and shares; one id with most rows takes one place."""
    rng = random.Random(8)
    make = lambda k: " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.choice('xyz')}" for _ in range(12))
    rows = [(k * 10 + j, make(k), f"l{k:03}") for k in range(300) for j in range(3)]
    rows += [(10_000, "big big big", "l000")] * 2000 + [(20_000 + i, make(1), "l001") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    s = L.Settings(texts=50, keys=40_000)
    assert L.learned_texts(docs, F.lit(True), s).groupBy("lang").count().agg(F.max("count")).first()[0] == 50
    model = L.fit(docs, F.lit(True), s)
    assert len(model["langs"]) == 300
    assert sum(len(t["lang"]) for t in model["tables"].values()) <= s.keys
    tell = L.Scorer(model, s)
    assert sum(tell(make(k))[0] == f"l{k:03}" for k in range(300)) >= 298


def test_counterfactuals_lower_the_weight_of_group_terms():
    rng = random.Random(5)
    plain = "we went to see a house and had some food with friends today".split()
    texts, labels = [], []
    for i in range(400):                                          # "women" goes with insults in the labels
        bad = i % 2
        texts.append(set(rng.choices(plain, k=6)) | ({"women"} if bad or rng.random() < 0.05 else set()) | ({"scumbag"} if bad and rng.random() < 0.8 else set()))
        labels.append(bad)
    loose = T.fit_rows(texts, labels, T.Settings(fairness=0.0))
    fair = T.fit_rows(texts, labels, T.Settings(fairness=50.0))
    neutral = "women had some food today"
    assert T.Scorer(fair)(neutral) < T.Scorer(loose)(neutral)
    assert T.Scorer(fair)("you scumbag") > T.Scorer(fair)("you friends")
    assert {frozenset(s) for s in T.swaps({"women", "x"})} == {frozenset({"men", "x"})}


@pytest.mark.parametrize("module", [T, Q])
def test_classifiers_take_odd_rows(spark, odd_documents, no_documents, module):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, None), (None, 1), (4, 0), (4, 1)], "doc_id long, y int")
    model = module.fit(odd_documents, labels, F.lit(True), label="y")
    rows = module.score(odd_documents, model).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert module.score(no_documents, model).count() == 0
    none = module.fit(no_documents, labels, F.lit(True), label="y")
    assert {round(r["score"], 6) for r in module.score(odd_documents, none).collect()} == {0.5}


def test_factorisation_machine_learns_a_pair():
    words = {b"a": 0, b"b": 1}
    raws = [b"a x", b"b x", b"a b x", b"x"] * 50
    labels = [0, 0, 1, 1] * 50                                    # neither word alone tells
    s = Q.Settings(steps=400, decay=0.0, bits=10)
    f = Q.Features(s)
    model = Q.fit_rows([f(r) for r in raws], labels, s)
    got = Q.score_rows([b"a x", b"b x", b"a b x", b"x"], f, model)
    assert words and got[0] < 0.5 > got[1] and got[2] > 0.5 < got[3]


def test_pairwise_identity():
    rng = np.random.default_rng(0)
    model = {"b": 0.1, "w": rng.normal(size=50).astype(np.float32), "v": rng.normal(size=(3, 50)).astype(np.float32)}
    cols, vals = np.array([3, 7, 9, 20], np.int32), np.array([0.5, 1, 2, 0.1], np.float32)
    z = Q.forward([(cols, vals)], model)[3][0]
    pairs = sum(model["v"][:, cols[i]] @ model["v"][:, cols[j]] * vals[i] * vals[j] for i in range(4) for j in range(i))
    assert z == pytest.approx(0.1 + model["w"][cols] @ vals + pairs, rel=1e-4)


@pytest.mark.parametrize("query, truth, held", [("op7_toxicity", "toxic", 0.6), ("op3_quality_classifier", "quality", 0.9)])
def test_held_out_accuracy(spark, query, truth, held):
    from tranche.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES[query](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = got[got[truth] == 1].score.mean() - got[got[truth] == 0].score.mean()
    assert hit > 0.25
    assert ((got.score >= 0.5) == (got[truth] == 1)).mean() > held


def test_language_held_out(spark):
    from tranche.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
