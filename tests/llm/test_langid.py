import random

import pytest

from trellis.llm.langid import SEEDS, document_languages, fit, language_segments, mislabelled, normal_label, repair, segments, sentences, train, words

TEXTS = {
    "en": ["The search index keeps a copy of the previous snapshot.", "Each worker sorts the rows with a weak confidence before the next run.", "In most projects the edge table returns the outdated entries."],
    "fr": ["L'index de recherche conserve une copie de l'état précédent.", "Chaque processus trie les lignes dont la confiance est faible.", "Dans la plupart des projets, la table renvoie les entrées périmées."],
    "de": ["Der Suchindex behält eine Kopie des vorigen Zustands.", "Jeder Prozess sortiert die Zeilen mit geringer Sicherheit vor dem nächsten Lauf.", "In den meisten Projekten liefert die Tabelle die veralteten Einträge."],
    "ru": ["Поисковый индекс сохраняет копию прежнего состояния проекта.", "Каждый процесс сортирует строки с низкой уверенностью.", "В большинстве проектов таблица возвращает устаревшие записи."],
}


def corpus(seed=0, n=40):
    r = random.Random(seed)
    return [(lang if r.random() > 0.1 else "en", " ".join(r.sample(t, 2))) for lang, t in TEXTS.items() for _ in range(n)]


@pytest.mark.parametrize("label, want", [("en-US", "en"), ("DEU", "de"), (" French", "fr"), ("pt_BR", "pt"), ("und", None), (" ", None), (None, None), ("tlh", "tlh"), ("unknown", None)])
def test_labels(label, want):
    assert normal_label(label) == want


def test_words_and_sentences():
    assert repair("dÃ©jÃ\u00a0 vu, naïve") == "déjà vu, naïve"
    assert words("L’État buildGraph x_y() été 12 café") == ["l", "etat", "ete", "cafe"]
    text = "feat(x): The index keeps it all. # no\n\n```\nfor x in y\n```\n    return a;\n## A heading of words\nEs ist gut so. Ja!"
    got = [text[a:b] for a, b, ws in sentences(text) if ws]
    assert got == ["The index keeps it all.", "# no", "Es ist gut so.", "Ja!"]


def test_held_out_accuracy():
    model = train(corpus())
    one = lambda text: [x[2] for x in segments([text], model)[0]]
    for lang, parts in TEXTS.items():
        for p in parts:
            assert one(p) == [lang] and one(p.upper().replace("É", "E")) == [lang]
    assert model.langs == sorted(set(SEEDS))
    mixed = f"{TEXTS['en'][0]} {TEXTS['en'][1]}\n\n« {TEXTS['fr'][0]} »\n\n{TEXTS['en'][2]}"
    assert one(mixed) == ["en", "fr", "en"]
    assert segments([], model) == [] and segments(["", " 12 ;\n"], model) == [[], []]


def test_every_stretch_has_a_confidence():
    model = train(corpus())
    short, code, led = segments(["Ja gut.", "x = foo(1);\n", f"Ok. {TEXTS['de'][0]} Ja."], model)
    assert [(x[:2], x[5]) for x in short] == [((0, 7), False)] and 0 < short[0][3] <= 1
    assert [(x[:2], x[5]) for x in code] == [((0, 12), False)] and 0 < code[0][3] < 1
    assert [(x[:3], x[5]) for x in led] == [((0, len(f"Ok. {TEXTS['de'][0]} Ja."), "de"), True)]
    assert led[0][3] < segments([TEXTS["de"][0]], model)[0][0][3]


def test_batches_read_like_single_texts():
    model = train(corpus())
    texts = [t for _, t in corpus(3)] + ["", "Zzyzx " * 5, "unbekanntes Wortungetüm " * 30]
    assert segments(texts, model) == [segments([t], model)[0] for t in texts]
    parts = [words(t) for t in texts]
    assert (model.totals(parts, step=7) == model.totals(parts)).all()


def test_table(spark):
    rows = [(i, t, lab) for i, (lab, t) in enumerate(corpus(1, 20))]
    rows += [(900, TEXTS["fr"][0], "de"), (901, TEXTS["fr"][0], None), (902, TEXTS["fr"][0], "French"), (903, f"{TEXTS['en'][0]} {TEXTS['de'][1]}", "de"), (904, None, "fr"), (905, "", None), (906, "x" * 300000 + " " + TEXTS["ru"][0], "ru"), (907, "a();\n", None)]
    rows += rows[-8:]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df)
    found = language_segments(df, model)
    got = {tuple(r) for r in mislabelled(document_languages(found)).collect() if r.doc_id >= 900}
    assert got == {(900, "fr"), (901, "fr"), (903, "en"), (903, "de")}
    r = next(x for x in found.collect() if x.doc_id == 903 and x.lang == "de")
    assert rows[83][1][r.start : r.end] == TEXTS["de"][1] and 0.8 <= r.confidence <= 1
    empty = df.limit(0)
    assert mislabelled(document_languages(language_segments(empty, fit(empty)))).count() == 0
