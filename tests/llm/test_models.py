"""Language and abuse models against held-out rows of the test tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import abuse, language
from lectern.llm.boosting import Booster, Isotonic

LARGE = "/root/testdata/sf0.01"
RATED = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(LARGE):
        pytest.skip("the test tables aren't here")
    return lambda name: spark.read.parquet(f"{LARGE}/{name}.parquet")


@pytest.fixture(scope="module")
def tongues(tables):
    docs = tables("documents")
    return language.train_on(docs.where("doc_id % 2 = 0"), "doc_id", "text", language.label_code(F.col("lang"), tables("languages")))


def test_language_of_held_out_documents(tables, tongues):
    code = language.label_code(F.col("lang"), tables("languages"))
    docs = tables("documents").where("doc_id % 2 = 1").select("doc_id", "text", code.alias("code"))
    found = language.detect(docs, "doc_id", "text", tongues, keep=["code"]).where("code is not null and seg_no = 0")
    right = found.agg(F.avg((F.col("code") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.85  # some labels are wrong on purpose
    assert set(tongues.languages) == {"en", "de", "fr", "es", "pt", "it", "nl", "sv", "ru", "el"}


def test_stretches_of_a_mixed_document(spark, tables, tongues):
    code = language.label_code(F.col("lang"), tables("languages"))
    pure = {}
    for r in language.detect(tables("documents").select("doc_id", "text", code.alias("code")), "doc_id", "text", tongues, keep=["code"]).where("code = lang and seg_no = 0").join(tables("documents").select("doc_id", "text"), "doc_id").orderBy("doc_id").collect():
        pure.setdefault(r.lang, r.text)
    rows = [(1, f"{pure['en']}\n{pure['de']}"), (2, f"{pure['ru']}\n{pure['es']}\n{pure['pt']}"), (3, pure["fr"]), (4, None), (5, ""), (6, " \n"), (7, "12:3 — 45"), (3, pure["fr"])]
    got = language.detect(spark.createDataFrame(rows, "id long, text string"), "id", "text", tongues).orderBy("id", "seg_no").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.seg_no, r.lang))
    assert by == {1: [(1, "en"), (2, "de")], 2: [(1, "ru"), (2, "es"), (3, "pt")], 3: [(0, "fr"), (0, "fr")]}
    assert all(0 < r.confidence <= 1 for r in got)
    assert language.detect(spark.createDataFrame([], "id long, text string"), "id", "text", tongues).count() == 0


def test_language_of_editions(tables, tongues):
    found = language.detect_groups(tables("verses"), "module", "text", tongues)
    code = language.label_code(F.col("lang_short"), tables("languages"))
    right = tables("bibles").select("module", code.alias("code")).where("code is not null").join(found, F.col("grp") == F.col("module")).agg(F.avg((F.col("code") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.77  # likewise


def test_training_needs_labels(spark, tables):
    with pytest.raises(ValueError):
        language.train_on(tables("documents").limit(0), "doc_id", "text", F.col("lang"))
    with pytest.raises(ValueError):
        abuse.train_on(tables("documents"), tables("labels").limit(0), "doc_id", "text")


def test_abuse_on_held_out_documents(spark):
    if not os.path.isdir(RATED):
        pytest.skip("the test tables aren't here")
    tables = lambda name: spark.read.parquet(f"{RATED}/{name}.parquet")
    labels = tables("labels")
    model = abuse.train_on(tables("documents"), labels.where("doc_id % 3 > 0"), "doc_id", "text")
    held = labels.where("doc_id % 3 = 0").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"), F.count("*").alias("n"))
    scored = abuse.score_documents(tables("documents"), "doc_id", "text", model, keep=["source"])
    rows = scored.join(held.where("lo = hi"), "doc_id").collect()
    flagged = [r for r in rows if r.score >= abuse.THRESHOLD]
    assert len(flagged) > 15 and np.mean([r.hi for r in flagged]) > 0.8
    assert np.mean([r.score >= abuse.THRESHOLD for r in rows if r.hi == 1]) > 0.3  # about half of the marks of single raters are wrong
    assert np.mean([r.score >= abuse.THRESHOLD for r in rows if r.hi == 0]) < 0.05
    rates = abuse.source_rates(scored).collect()
    assert sum(r.n_docs for r in rates) == tables("documents").count() and all(r.source == (r.source or "").strip().lower() or r.source is None for r in rates)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "  ", None), (4, "word " * 50_000, "c")], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in abuse.score_documents(odd, "doc_id", "text", model).collect()}
    assert got[1] == got[2] == got[3] == 0.0 and got[4] < abuse.THRESHOLD


def test_restoring():
    known = {"idiot": 3.0, "filthy": 3.0, "vermin": 3.0, "твари": 3.0}
    for text in ("i.d.i.o.t", "i d i o t", "1d10t", "i***t", "iiidiot", "IDIOT", "i-d-i-o-t", "y i d i o t"):
        assert "idiot" in abuse.restore(text, known)[0], text
    assert "твари" in abuse.restore("тв@р!,", known)[0]
    assert abuse.restore("1Vit 3:4 and 3Lom 5", known)[1] == 0


def test_boosting_and_calibration():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = Booster(rounds=60).fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0) == y[2000:]).mean() > 0.93
    s = r.random(2000)
    label = (r.random(2000) < s).astype(float)
    fitted = Isotonic().fit(s, label, np.ones(2000))
    assert np.all(np.diff(fitted.y) >= 0) and abs(fitted(np.array([0.5]))[0] - 0.5) < 0.12


def test_gate_covers_what_it_guards():
    import random

    from lectern.llm import abuse

    dice = random.Random(3)
    signs = "aAsEzéÿ÷ßЖя0145379²½_*@$!-. \n,́\U00020000٣"
    texts = ["A55HOLE", "a.b.c", "x1234Y", "12AB", "4÷", "@_", "½½½", "", "5"]
    texts += ["".join(dice.choices(signs, k=dice.randint(0, 9))) for _ in range(60_000)]
    gate = abuse.may_be_obfuscated(texts)
    assert [t for t, g in zip(texts, gate) if abuse.SUSPECT.search(t) and not g] == []
    assert gate[0] and gate[2] and not gate[3] and not gate.all()
    assert all(abuse.may_be_obfuscated([t])[0] == g for t, g in zip(texts[:300], gate))


def test_sentence_bounds_reach_training(tables, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "train", lambda rows, sizes=None, **how: seen.update(how))
    docs = tables("documents").limit(200)
    language.train_on(docs, "doc_id", "text", language.label_code(F.col("lang"), tables("languages")))
    assert seen == {"most": language.SENTENCES, "rare": language.RARE_SENTENCES}
    language.train_on(docs, "doc_id", "text", language.label_code(F.col("lang"), tables("languages")), most=7, rare=3)
    assert seen == {"most": 7, "rare": 3}


#: One sentence each of languages that no label names, and of those that are known; none of it is from the tables.
UNSEEN = {
    "fi": "Hän meni eilen kauppaan ja osti leipää, maitoa ja juustoa perheelleen, koska kaikki olivat nälkäisiä.",
    "pl": "Wczoraj poszedł do sklepu i kupił chleb, mleko oraz ser dla swojej rodziny, ponieważ wszyscy byli głodni.",
    "ja": "昨日 彼は 店に 行って 家族の ために パンと 牛乳と チーズを 買いました",
    "hu": "Tegnap elment a boltba, és kenyeret, tejet meg sajtot vett a családjának, mert mindenki éhes volt.",
    "cs": "Včera šel do obchodu a koupil chléb, mléko a sýr pro svou rodinu, protože všichni měli hlad.",
    "ar": "ذهب أمس إلى المتجر واشترى الخبز والحليب والجبن لعائلته لأن الجميع كانوا جائعين",
}
KNOWN = {
    "en": "Yesterday he went to the store and bought bread, milk and cheese for his family because everyone was hungry.",
    "de": "Gestern ging der alte Mann in den Laden und kaufte Brot und Milch für seine Familie.",
    "sv": "Han gick igår till affären och köpte bröd och mjölk till sin familj för att alla var hungriga.",
    "nl": "Gisteren ging hij naar de winkel en kocht brood, melk en kaas voor zijn gezin.",
    "ru": "Вчера он пошёл в магазин и купил хлеб, молоко и сыр для своей семьи.",
    "el": "Χθες πήγε στο μαγαζί και αγόρασε ψωμί, γάλα και τυρί για την οικογένειά του.",
}


def test_unseen_languages_are_rejected(spark, tongues):
    rows = spark.createDataFrame([*UNSEEN.items(), *KNOWN.items()], "name string, text string").withColumn("id", F.monotonically_increasing_id())
    got = {r.name: r.lang for r in language.detect(rows, "id", "text", tongues, keep=["name"]).collect()}
    assert {k: got[k] for k in UNSEEN} == dict.fromkeys(UNSEEN)
    assert {k: got[k] for k in KNOWN} == {k: k for k in KNOWN}


def test_changes_within_a_sentence_and_offsets(spark, tongues):
    a, b = "The king went down to the river with all his people and ", "dann gingen sie alle zusammen in das große Haus der alten Stadt."
    disguised = a.replace("people", "peo​p‍le­") + b
    rows = [(1, a + b), (2, disguised), (3, a[:-5] + ". " + b), (4, a + "Недара said so.")]
    got = {}
    for r in language.detect(spark.createDataFrame(rows, "id long, text string"), "id", "text", tongues).orderBy("id", "seg_no").collect():
        got.setdefault(r.id, []).append((r.seg_no, r.lang, r.start, r.end))
    for k, text in rows[:3]:
        cut = text.index("dann")
        (_, first, begin, end), (_, second, start, last) = got[k]
        assert (first, second, begin, end, last) == ("en", "de", 0, start, len(text)), k
        assert abs(start - cut) <= 14 and text[start - 1] == " " and text[start].isalpha()
    assert got[4] == [(0, "en", 0, len(rows[3][1]))]


def test_vector_lengths_are_exact(tongues):
    words = ["king", "river", "king", "the", "law"]
    ids, sentence, _ = tongues.words([" ".join(words)])
    counts = np.zeros(language.FEATURES)
    for w in words:
        np.add.at(counts, language.ngram_features([w])[0], 1)
    assert tongues.lengths(ids, np.array([0]))[0] == pytest.approx(np.linalg.norm(counts * tongues.idf), rel=1e-5)


def test_editions_without_words_get_a_row(spark, tables, tmp_path, monkeypatch):
    from lectern.llm import queries

    made = {"verses": spark.createDataFrame([("a", "12:3"), ("b", None)], "module string, text string"), "bibles": spark.createDataFrame([(1, "a", "en"), (2, "b", None), (3, "c", "de")], "id int, module string, lang_short string")}
    for name in ("documents", "languages"):
        made[name] = tables(name)
    monkeypatch.setattr(queries, "table", lambda spark, sf, name: made[name])
    assert sorted((r.id, r.lang) for r in queries.p1_bibles(spark, "").collect()) == [(1, None), (2, None), (3, None)]
    assert queries.p1_found(spark, "").where("tbl = 'bibles'").count() == 0


def test_planted_words_outside_any_list_are_learned():
    """Insults of invented words: the lexicon learns them from ratings, some of which are wrong, and finds them in other sentences."""
    import random

    dice = random.Random(4)
    plain = ["river", "stone", "king", "letter", "bread", "lamp", "garden", "song", "gate", "cup"]
    bad = ["zorfel", "grunkit", "vlabbo", "pestrok"]
    assert not set(bad) & (abuse.INSULTS | abuse.CONTEMPT | abuse.EXPLICIT)

    def text(mean):
        parts = [" ".join(dice.choices(plain, k=8)) + "." for _ in range(5)]
        if mean:
            parts[dice.randrange(5)] = f"You are a {dice.choice(bad)} and a {dice.choice(bad)}, {dice.choice(plain)}!"
        return " ".join(parts)

    rows = [(text(k % 12 == 0), float((k % 12 == 0) != (dice.random() < 0.03)), 1.0) for k in range(1800)]
    model = abuse.train(rows)
    truth = [k % 7 == 0 for k in range(700)]
    raw, worst = model.worst([text(t) for t in truth])
    found = model.rate(raw) >= abuse.THRESHOLD
    assert np.mean(found[np.array(truth)]) >= 0.9 and np.mean(found[~np.array(truth)]) < 0.02
    assert all("You are a" in w for w, t in zip(worst, truth) if t)
    raw, _ = model.worst(["You z0rf3l", "", "12 34", "You gr*nkit!"])
    assert np.isfinite(raw[0]) and not np.isfinite(raw[1]) and not np.isfinite(raw[2]) and np.isfinite(raw[3])


def test_every_sentence_is_scored():
    rows = [(f"The king of valley {k} gave bread. " + ("You filthy idiot!" if k % 5 == 0 else "He went home."), float(k % 5 == 0), 1.0) for k in range(200)]
    model = abuse.train(rows)
    found, own, x = (lambda b: (b.found, *model.lexicon.features(b)))(abuse.Batch(["A calm one. Another, quite calm! 12. Last"]))
    assert len(own) == 3 and x.shape == (3, abuse.FEATURES) and len(found) == 4


def test_features_of_a_batch_are_those_of_its_sentences():
    rows = [(f"The king {k}. " + ("You idiot, be quiet!" if k % 4 == 0 else "He went home with the 1d10t."), float(k % 4 == 0), 1.0) for k in range(160)]
    lexicon = abuse.train(rows).lexicon
    texts = ["You i.d.i.o.t went. Fine words\nARE here!?", "", "x", "Ещё раз сторож. İstanbul ǅ word", "áb 3.5 c.d e"]
    together = abuse.Batch(texts)
    own, x = lexicon.features(together)
    for k, row in zip(own, x):
        alone = abuse.Batch([together.found.string(texts, k)])
        assert lexicon.features(alone)[1][0] == pytest.approx(row)


def test_models_are_artifacts(spark, tables, tongues, tmp_path):
    from lectern.llm.models import load_model, save_model

    save_model(spark, tongues, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    rows = tables("documents").limit(200)
    found = [sorted(map(tuple, language.detect(rows, "doc_id", "text", m).collect())) for m in (tongues, again)]
    assert found[0] == found[1] and again.bounds.tolist() == tongues.bounds.tolist()
    model = abuse.train([(f"The king {k}. " + ("You idiot!" if k % 4 == 0 else "He went."), float(k % 4 == 0), 1.0) for k in range(160)])
    save_model(spark, model, str(tmp_path / "a"))
    texts = ["You idiot!", "He went.", ""]
    assert load_model(spark, str(tmp_path / "a")).worst(texts)[0].tolist() == model.worst(texts)[0].tolist()
