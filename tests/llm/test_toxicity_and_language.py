import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from attestor.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def test_noisy_or():
    z = np.array([-1.0, 0.5, 2.0])
    assert abs(toxicity.noisy_or(z) - (1 - np.prod(1 - 1 / (1 + np.exp(-z))))) < 1e-12
    assert toxicity.noisy_or(np.zeros(0)) == 0.0 and 0 <= toxicity.noisy_or(np.full(100_000, -40.0)) < 1e-9


def test_document_labels_find_the_sentence():
    rng = np.random.default_rng(1)
    plain = [f"word{i}" for i in range(50)]
    texts, labels = [], []
    for i in range(300):
        sentences = [" ".join(rng.choice(plain, 6)) for _ in range(5)]
        if i % 3 == 0:
            sentences[2] = f"you are a vilest{'abc'[i // 3 % 3]} thing today"
        texts.append(". ".join(sentences) + ".")
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts, labels)
    scores = [toxicity.noisy_or(model.logits(t), model.bias) for t in texts]
    assert [int(s >= 0.5) for s in scores] == labels
    start, end = model.offending(texts[0])
    assert "vilest" in texts[0][start:end] and texts[0][start:end].count(".") <= 1
    # An unseen form of a known stem counts.
    assert toxicity.noisy_or(model.logits("word1 word2 word3 vilestxyz word4."), model.bias) > 0.5
    again = toxicity.fit(texts[::-1], labels[::-1])
    assert again.bias == model.bias and again.weights == model.weights


def _plain(rng, sentences):
    words = np.array([f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(50)])
    return ". ".join(map(" ".join, words[rng.integers(0, 50, (sentences, 6))])) + ". "


def test_length_alone_is_not_toxic():
    rng = np.random.default_rng(5)
    bad = "you are a vilest thing today. "
    texts = [_plain(rng, 5) + bad * (i % 3 == 0) for i in range(150)]
    model = toxicity.fit(texts, [int(i % 3 == 0) for i in range(150)])
    clean = _plain(rng, 120_000)
    assert len(clean) > 5_000_000 and toxicity.noisy_or(model.logits(clean), model.bias) < 0.2
    assert toxicity.noisy_or(np.full(10**6, -6.0), -6.0) < 0.2
    # One offending sentence is found in a text of any length.
    assert toxicity.noisy_or(model.logits(clean + bad), model.bias) >= 0.5


def test_harmless_sentences_never_change_a_verdict(spark):
    model = toxicity.ToxicModel(-8.0, {"vile": 7.96})
    doubtful, harmless = "you are vile to me. " * 3, "a harmless one stands here. "
    rows = [(0, doubtful), (1, doubtful + harmless * 1000), (2, harmless * 1000 + doubtful), (3, harmless), (4, harmless * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (round(r.score, 9), r.predicted) for r in toxicity.score_texts(docs, model).collect()}
    assert got[0] == got[1] == got[2] and 0.8 < got[0][0] < 0.9 and got[0][1] == 1
    assert got[3] == got[4] and got[3][1] == 0


def test_long_documents_take_part_in_the_fit(spark):
    rng = np.random.default_rng(6)
    rows = [(i, _plain(rng, 5_000) + "you are a vilest thing today. " * (i % 2), i % 2) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    assert min(len(r[1]) for r in rows) > 200_000
    model = toxicity.train_toxic(docs, docs.select("doc_id", "toxic"), F.lit(True))
    assert model.weights.get("vilest", 0) > 0
    # Too many characters thin the sample out, by the key alone.
    lone = toxicity.train_toxic(docs, docs.select("doc_id", "toxic"), F.lit(True), fit_chars=1)
    assert lone.weights == {}


def test_short_sentences_are_joined():
    text = "NO!! STOP!! GO ON!! NOW PLEASE.\nA longer one stands here. End"
    spans = toxicity.sentence_spans(text)
    assert all(b > a for a, b in spans) and [text[a:b] for a, b in spans][0].startswith("NO!!")
    assert sum(len(w) for w in toxicity.sentence_words(text)) == 12
    assert toxicity.sentence_spans("") == [] and toxicity.sentence_spans("\n\n") == []


def test_toxic_held_out_accuracy_and_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = toxicity.remainder("doc_id", 5)
    model = toxicity.train_toxic(docs, labels, fold != 0)
    scored = toxicity.score_texts(docs, model).join(labels, "doc_id").where(fold == 0).collect()
    assert np.mean([r.predicted == r.toxic for r in scored]) > 0.9
    rows = [(1, None), (2, ""), (None, "x"), (3, "!?\n." * 1000), (4, "idiot scum. " * 30_000)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"score": F.lit(9), "key": F.lit(9), "toxic": F.lit(9)})
    got = {r.doc_id: r for r in toxicity.score_texts(odd, model).collect()}
    assert got[1].score == got[2].score == got[3].score == 0.0 and got[4].predicted == 1 and got[4].worst_end > 0
    assert toxicity.score_texts(odd.limit(0), model).count() == 0
    silent = toxicity.train_toxic(docs, labels.limit(0), fold != 0)
    assert {r.predicted for r in toxicity.score_texts(odd, silent).collect()} == {0}


def test_every_offending_sentence_is_located(spark):
    model = toxicity.ToxicModel(-8.0, {"vile": 9.0, "viler": 3.0, "bad": 7.5})
    texts = [
        "you are vile to me. this is a harmless one. \U0001f642 you are vile and viler to me. some more harmless words here.",
        "you are bad to me. " * 3, "bad sentence number one here. a harmless one is here.", "", None, "\n\n12 !!",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    said = {i: [texts[i][s.start : s.end] for s in r.spans] for i, r in rows.items()}
    assert said[0] == ["you are vile to me.", "\U0001f642 you are vile and viler to me."] and rows[0].n_offending == 2
    assert (rows[0].worst_start, rows[0].worst_end) == (rows[0].spans[1].start, rows[0].spans[1].end)
    # Toxic by three sentences, none of which offends alone: the first of the highest is located.
    assert (rows[1].predicted, rows[1].n_offending, said[1], rows[1].worst_start) == (1, 0, ["you are bad to me."], 0)
    assert abs(rows[1].spans[0].score - 1 / (1 + np.exp(0.5))) < 1e-12
    assert all((rows[i].predicted, rows[i].spans, rows[i].worst_start) == (0, [], None) for i in (2, 3, 4, 5))


def test_folds_are_crc32_of_the_key(spark):
    got = spark.range(50).select("id", toxicity.remainder("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, k, penalty = rng.integers(1, 7), rng.integers(1, 4), rng.random() * 3
        scores = rng.normal(size=(n, k)) * 2
        value = lambda path: sum(scores[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        best = max(map(value, itertools.product(range(k), repeat=int(n))))
        assert abs(value(language.viterbi(scores, penalty)) - best) < 1e-9


def _model():
    rng = np.random.default_rng(3)
    say = lambda parts: " ".join("".join(rng.choice(parts, 3)) for _ in range(400))
    return language.fit([say(["ka", "ro", "ti"]), say(["sch", "ung", "ein"]), say(["да", "не", "то"])], ["aa", "bb", "cc"])


def test_many_texts_walk_like_one_and_long_ones_by_chunks(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [rng.normal(size=(int(n), 3)) * 3 for n in rng.integers(1, 40, 60)]
    alone = [language._walk_one([t], 2.0)[0].tolist() for t in texts]
    assert [w.tolist() for w in language.walk(texts, 2.0)] == alone
    monkeypatch.setattr(language, "CELLS", 100)
    assert [w.tolist() for w in language.walk(texts, 2.0)] == alone
    for t, labels in zip(texts, alone):
        cut = language._walk_one([t[i : i + 7] for i in range(0, len(t), 7)], 2.0)
        assert np.concatenate(cut).tolist() == labels
    model = _model()
    mixed = " ".join(["Karoti rotika tikaro karoka", "Scheinung ungein einsch undsch", "даното нетода", "12 İ!"][i] for i in rng.integers(0, 4, 300))
    plain = "Karoti rotika, tikaro karoka. " * 200
    whole = language.label_texts([mixed, plain, "", "  12"], model, 3.0)
    assert len(whole[0][0]) > 100 and len(whole[1][0]) == 1
    monkeypatch.setattr(language, "CHUNK", 50)
    assert language.label_texts([mixed, plain, "", "  12"], model, 3.0) == whole


def test_rare_languages_and_long_texts_take_part_in_the_fit(spark):
    rows = [(i, "tikaro karoti " * 500, "aa") for i in range(300)] + [(1000, "einung scheinung " * 20_000, "bb"), (1001, "нето дано " * 3, "cc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train_language(docs, F.lit(True), fit_chars=300_000)
    assert model.names == ["aa", "bb", "cc"]
    assert [language.predict(t, model)[0] for t in ("karoti tikaro", "scheinung einung", "дано нето")] == ["aa", "bb", "cc"]


def test_scripts_and_spans():
    model = _model()
    assert language.script("ÿes") == "latin" and language.script("дом") == "cyrillic" and language.script("中") == "han"
    text = "Karoti rotika tikaro karoka. Scheinung ungein einsch undsch einung, даното нетода 123"
    spans, counts = language.label_spans(text, model, penalty=3.0)
    assert [s[2] for s in spans] == ["aa", "bb", "cc"] and counts["bb"] == 5
    assert text[spans[2][0] : spans[2][1]] == "даното нетода"
    # Only one language uses the script, whatever the letters say.
    assert language.predict("щщщ ыыы", model)[0] == "cc"
    assert language.predict("123 !!", model) == ("und", 0.0, 0) and language.predict("中文", model)[0] in ("aa", "bb", "cc")


def test_operator_returns_spans_of_mixed_texts(spark):
    model = _model()
    one, two, three = "Karoti rotika, tikaro karoka", "Scheinung ungein einsch undsch einung", "даното нетода"
    # Two dotted capital I become longer in lower case; positions are those of the text itself.
    texts = [f"1. {one}. {two}, {three} 123", f"\U0001f642 {three}! {one}", "İİ karoti rotika tikaro karoka " + three + ".", one, "12 %", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in language.identify(docs, model, penalty=3.0).collect()}
    got = {i: [(texts[i][s.start : s.end], s.lang) for s in r.spans] for i, r in rows.items()}
    assert got[0] == [(one, "aa"), (two, "bb"), (three, "cc")] and got[1] == [(three, "cc"), (one, "aa")]
    assert got[2] == [("İİ karoti rotika tikaro karoka", "aa"), (three, "cc")]
    assert got[3] == [(one, "aa")] and got[4] == got[5] == []
    assert all(r.n_spans == len(r.spans) for r in rows.values())
    assert [rows[i].lang_pred for i in range(6)] == ["bb", "aa", "aa", "aa", "und", "und"]
    assert rows[0].score == 5 / 11


def test_language_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = toxicity.remainder("doc_id", 3)
    model = language.train_language(docs, fold != 1)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold == 1).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    rows = [(1, None, "en"), (2, "", None), (None, "the and", "de"), (3, "and the " * 50_000, "en"), (4, "12 %", "en")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"score": F.lit(1), "key": F.lit(2)})
    found = {r.doc_id: r.lang_pred for r in language.identify(odd, model).collect()}
    assert found[1] == found[2] == found[4] == "und" and found[3] == found[None] == "en"
    none = language.train_language(odd.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0
