"""Language, toxicity, page extraction and licences: held-out accuracy, exact inference, odd rows."""

import itertools
import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumql.llm import extraction, language, licences, toxicity
from quorumql.llm.common import Lexicon, bounded_sample, held_out
from quorumql.llm.dom import read_page
from quorumql.llm.language import keep_known_language, predict_language, train_language_model

ODD = [(1, None), (2, ""), (3, "12 34 !? ²½"), (4, "the " * 30_000), (None, "the and of the"), (5, "日本"), (5, "日本")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def odd_rows(spark, *names):
    """Odd texts with extra columns of clashing names."""
    return spark.createDataFrame([(k, t, *["x"] * len(names)) for k, t in ODD], "doc_id long, text string" + "".join(f", {n} string" for n in names))


def test_language_of_held_out_documents(documents):
    done, names = predict_language(documents, train_language_model(documents))
    right = done.filter(held_out(F.col("doc_id"))).agg(F.avg((F.col(names["lang_pred"]) == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.95
    assert done.filter(F.col(names["lang_rejected"])).count() <= 5


def test_language_of_odd_rows(spark, documents):
    odd = odd_rows(spark, "lang_pred", "LANG_SCORE")
    done, names = predict_language(odd, train_language_model(documents))
    assert set(names.values()).isdisjoint(odd.columns)
    rows = {(r.doc_id, r.text): r for r in done.collect()}
    assert all(rows[k][names["lang_pred"]] == "und" and rows[k][names["lang_score"]] == 0 and rows[k][names["lang_rejected"]] for k in ODD[:3])
    assert rows[ODD[3]][names["lang_pred"]] == rows[ODD[4]][names["lang_pred"]] == "en" and done.count() == len(ODD)
    assert all(0 <= r[names["lang_score"]] <= 1 for r in rows.values())


def test_language_without_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    model = train_language_model(empty)
    assert predict_language(empty, model)[0].count() == 0 and keep_known_language(empty).columns == empty.columns
    done, names = predict_language(odd_rows(spark), model)
    assert {r[names["lang_pred"]] for r in done.collect()} == {"und"}


FOREIGN = ("Kaikki ihmiset syntyv\u00e4t vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "\u0412\u0441\u0435 \u043b\u044e\u0434\u0438 \u0440\u043e\u0436\u0434\u0430\u044e\u0442\u0441\u044f \u0441\u0432\u043e\u0431\u043e\u0434\u043d\u044b\u043c\u0438 \u0438 \u0440\u0430\u0432\u043d\u044b\u043c\u0438.",
           "\u3059\u3079\u3066\u306e\u4eba\u9593\u306f\u3001\u751f\u307e\u308c\u306a\u304c\u3089\u306b\u3057\u3066\u81ea\u7531\u3067\u3042\u308a\u3001\u5e73\u7b49\u3067\u3042\u308b\u3002", "Wszyscy ludzie rodz\u0105 si\u0119 wolni i r\u00f3wni pod wzgl\u0119dem swej godno\u015bci i swych praw.",
           "B\u00fct\u00fcn insanlar h\u00fcr, haysiyet ve haklar bak\u0131m\u0131ndan e\u015fit do\u011farlar.", "Alla m\u00e4nniskor \u00e4r f\u00f6dda fria och lika i v\u00e4rde och r\u00e4ttigheter.", "zxqv jkwp qqzt vbnm wrtp lkjh gfds")


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_foreign_texts_are_rejected_and_clean_ones_kept(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    model = train_language_model(docs)
    _, scores, rejected = model.predict(list(FOREIGN), model.lexicon())
    assert all(rejected) and max(scores) < 0.8
    done, names = predict_language(docs, model)
    assert done.filter(F.col(names["lang_rejected"])).count() <= 0.005 * docs.count()


def test_language_scores_equal_a_plain_average_and_softmax(spark, documents):
    model = train_language_model(documents)
    texts = ["The thin and.", "Une de la \u00e9t\u00e9 and", "x"]
    names, scores, _ = model.predict(texts, model.lexicon())
    for text, name, score in zip(texts, names, scores):
        total, n = np.zeros(len(model.languages)), 0
        for word in language.words_of(text.lower()):
            for bucket in language.subwords([word])[1]:
                total, n = total + model.scores[bucket], n + 1
        e = np.exp((total / n + model.bias) / model.temperature)
        assert name == model.languages[int(np.argmax(e))] and score == pytest.approx(float(e.max() / e.sum()))


def test_many_labels_share_the_sample(spark):
    rows = spark.range(2000).selectExpr("id AS k", "CAST(id % 500 AS string) AS label")
    taken, counts = bounded_sample(rows, "label", "k", 100, most_labels=50, most_rows=100)
    assert len(counts) == 50 and taken.count() <= 200


def test_lexicon_is_bounded_by_characters():
    held = Lexicon(lambda tokens: np.ones((len(tokens), 2)), most_chars=100_000)
    for i in range(500):  # parts that never repeat, as in a language without spaces
        held.numbers([f"{i}-{k}" + "x" * 2000 for k in range(10)])
        held.rows()
        held.trim()
        assert held.chars <= 100_000 and sum(map(len, held)) == held.chars


def test_bounded_sample(spark):
    rows = spark.range(3000).selectExpr("id AS k", "IF(id % 10 = 0, 'rare', 'common') AS label")
    taken, counts = bounded_sample(rows, "label", "k", 400)
    found = {r.label: r["count"] for r in taken.groupBy("label").count().collect()}
    assert counts == {"rare": 300, "common": 2700} and found["rare"] == 300 and 300 < found["common"] < 500


def toy(n=240):
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, rng.integers(5, 150)))
        if i % 3 == 0:
            for _ in range(3):
                words[rng.integers(len(words))] = rng.choice(["vileword", "vilest", "vilely"])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def toxic_model():
    texts, labels = toy()
    return toxicity.fit(texts, labels)


def test_toxicity_finds_marked_texts(toxic_model):
    lexicon = toxic_model.lexicon()
    scores = toxic_model.scores(["w1 w2 w3 vileword w4 vilest", "w5 w6 w7 w8 " * 40, "w1 " * 700 + "vilely vilest" + " w2" * 700, "w9 vilesome w3 vilewords"], lexicon)
    assert scores[0] > 0.5 > scores[1] and scores[2] > 0.5 and ((0 <= scores) & (scores <= 1)).all()


def test_windows_cover_all_tokens():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        numbers, length, owner = toxicity.windows([np.arange(n)], -1)
        seen = {int(x) for row, k in zip(numbers, length) for x in row[:k] if x >= 0}
        assert seen == set(range(n)) and (owner == 0).all() and len(numbers) == len(toxicity.window_starts(n))


def test_gradients_of_the_network(toxic_model):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 3, 6 * toxicity.HIDDEN)).astype(np.float64)
    length = np.array([5, 3, 1])
    error = rng.normal(size=3)
    model = toxicity.ToxicityModel(toxic_model.word, toxic_model.char, [g.astype(np.float64) for g in toxic_model.gates],
                                   toxic_model.attention.astype(np.float64), toxic_model.out.astype(np.float64))
    loss = lambda: float((model.forward(x, length)[0] * error).sum())
    dx, turns, attention, out = model.backward(error, model.forward(x, length, keep=True)[1])
    for value, slope in ((x, dx), (model.gates[1], turns[0]), (model.gates[3], turns[1]), (model.attention, attention), (model.out, out)):
        for _ in range(6):
            at = tuple(rng.integers(s) for s in value.shape)
            old = value[at]
            value[at] = old + 1e-2
            high = loss()
            value[at] = old - 1e-2
            low = loss()
            value[at] = old
            assert slope[at] == pytest.approx((high - low) / 2e-2, abs=2e-3, rel=2e-2)


def test_toxicity_of_odd_rows(spark, toxic_model):
    odd = odd_rows(spark, "toxicity", "lang")
    done, name = toxicity.score_toxicity(odd, toxic_model)
    assert name not in odd.columns and done.count() == len(ODD)
    assert all(0 <= r[name] < 0.5 for r in done.collect())
    untrained = toxicity.fit(["a b"], [0])
    assert [r[name] for r in toxicity.score_toxicity(odd, untrained)[0].collect()] == [0.0] * len(ODD)


def test_toxicity_learns_from_tables(spark):
    texts, labels = toy(120)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, x) for i, x in enumerate(labels)] + [(None, 1, 1), (999, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, marks).collect()}
    wrong = sum((i in kept) == bool(x) for i, x in enumerate(labels))
    assert wrong <= 6
    assert toxicity.drop_toxic(docs.limit(0), marks).count() == 0


@pytest.fixture(scope="module")
def tree_model():
    return extraction.train_tree_model()


def article(html):
    """What stands in the article element, for the layouts of the test pages."""
    inner = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    blocks = re.sub(r"<[^>]*>?", "", re.sub(r"</?(p|h1|br)\b[^>]*>", "\0", inner)).split("\0")
    return " ".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)


def test_extraction_equals_the_articles(spark, tree_model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    done, names = extraction.extract_text(pages, tree_model)
    for row in done.collect():
        assert row[names["text"]] == article(row.html) and row[names["n_chars"]] == len(row[names["text"]])


def test_extraction_of_odd_pages(spark, tree_model):
    pages = [(1, None), (2, ""), (3, "plain words only"), (4, "<p>One<p>Two &lt;b&gt; &eacute;&#8364;"), (5, "<script>var a='<p>x</p>'</script><style>p{}</style>"),
             (6, "<div class=main><p>A <b>b</b>old</p><script>x</script><p>tail" + "<i>" * 400), (7, "<" * 2000), (8, '<p title="a>b">kept</p'), (None, "<p>" + "long " * 50_000)]
    df = spark.createDataFrame([(*p, "t", "c") for p in pages], "page_id long, html string, text string, n_chars string")
    done, names = extraction.extract_text(df, tree_model)
    found = {r.page_id: r[names["text"]] for r in done.collect()}
    assert found[1] == found[2] == found[5] == "" and found[3] == "plain words only" and found[4] == "One Two <b> é€"
    assert found[6] == "A bold tail" and found[None] == " ".join(["long"] * 50_000) and found[8] == "kept"
    assert extraction.extract_text(df.limit(0), tree_model)[0].count() == 0


def test_extraction_leaves_out_what_is_not_the_article(tree_model):
    html = """<body><header><a href=/>Site</a></header><div id="main-menu"><ul><li><a href=/a>A</a></ul></div><div class="cookie-notice">We use cookies</div>
      <div class="post-content entry-content"><h1>Title &amp; more</h1><p>First   part.</p><div class="advert">Buy now</div><p>Second part.</p></div>
      <section id="comments"><p>I like it</p></section><form><label>Mail</label><input></form><aside class=sidebar>Links</aside><footer>&copy; us</footer>"""
    assert tree_model.texts([html]) == ["Title & more First part. Second part."]


def test_formulas_drawings_and_listings_reach_the_model(tree_model):
    article = "<article><h1>Title</h1><p>A{}</p><p>rest of the story</p></article>"
    for inner, text in (("<svg><path></p><p>B", "A B"), ("<svg><path d=x/><text>in</text></svg> B", "Ain B"), (" <math><mi>x</mi><mo>=</mo><mn>1</mn></math> B", "A x=1 B"),
                        ("<math><mi>x", "Ax"), ("<svg/>B", "AB"), ("</p><xmp>a <b>&amp;</b></xmp><p>B", "A a <b>&amp;</b> B"), ("</p><xmp>open", "A open</p><p>rest of the story</p></article>")):
        found = tree_model.texts([article.format(inner)])[0]
        assert found == ("Title " + text + ("" if "open" in inner else " rest of the story")), inner
    assert tree_model.texts(["<p>A<svg><path></p><p>rest of the story"]) == ["A rest of the story"]


def test_pages_are_read_in_linear_time():
    started = time.perf_counter()
    assert len(read_page("<b>" * 50_000 + "</i>" * 100_000).tag) == 50_001
    assert len(read_page("<p><table>" + "<b>" * 30_000 + "<div>" * 30_000 + "x<" * 100_000).tag) == 60_004
    assert time.perf_counter() - started < 5


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(3)
    page = read_page("<div><p>a<b>b</b></p><ul><li>c</ul></div><nav>d</nav>")
    trees = extraction.forest([page])
    model = extraction.TreeModel(rng.normal(size=extraction.SIZE), rng.normal(size=(4, 2, 2)))
    odds, joint = model.marginals(trees)
    own = np.bincount(trees.node, model.weights[trees.feature], len(page.tag))
    total, ones = 0.0, np.zeros(len(page.tag))
    pair = np.zeros((len(page.tag), 2, 2))
    for states in itertools.product((0, 1), repeat=len(page.tag)):
        s = np.array(states)
        weight = np.exp((own * s).sum() + sum(model.ties[trees.tie[i], s[p], s[i]] for i, p in enumerate(page.parent) if p >= 0))
        total += weight
        ones += weight * s
        for i, p in enumerate(page.parent):
            if p >= 0:
                pair[i, s[p], s[i]] += weight
    assert np.allclose(1 / (1 + np.exp(-odds)), ones / total)
    assert np.allclose(joint[1:], pair[1:] / total)


def test_labelled_pages_left_out_of_training(tree_model):
    pages, labels = extraction.labelled_pages(120, seed=77)
    trees = extraction.forest(pages)
    truth = np.array([x for page in labels for x in page])
    texts = trees.tie == 0
    assert ((tree_model.marginals(trees)[0] >= 0) == truth)[texts].mean() > 0.97


def test_licences(spark, documents):
    model = licences.train_licence_model(documents)
    marks = {"MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "GPL-3.0": "General Public License, version 3", "CC-BY-NC-4.0": "CC BY-NC 4.0",
             "Proprietary": "All rights reserved."}
    expected = {}
    for row in documents.select("doc_id", "text").collect():
        expected[row.doc_id] = ",".join(sorted(f for f, mark in marks.items() if mark in (row.text or ""))) or None
    found = {r.key: r.families for r in licences.scan_documents(documents, model).collect()}
    assert found == expected
    odd = [(1, None, "x"), (2, "", "x"), (3, "You need a licence for this dog.\nThe license plate.", "x"), (None, "Released under the MIT License.", "x"),
           (4, "Some prose.\n" * 4000 + "Licensed under the Mozilla Public License 2.0.\nReleased under the MIT License.", None), (5, "Released under the MIT License.", "x"),
           (5, "Released under the MIT License.", "x")]
    rows = spark.createDataFrame(odd, "doc_id long, text string, family string")
    got = sorted((str(r.key), str(r.families), r.n_paragraphs) for r in licences.scan_documents(rows, model).collect())
    assert got == [("1", "None", 0), ("2", "None", 0), ("3", "None", 0), ("4", "MIT,MPL-2.0", 2), ("5", "MIT", 1), ("5", "MIT", 1), ("None", "MIT", 1)]
    assert licences.scan_documents(rows.limit(0), model).count() == 0


def test_every_template_holds_an_anchor():
    assert all(re.search(licences.ANCHORS, text.lower()) for texts in licences.TEMPLATES.values() for text in texts)


@pytest.fixture(scope="module")
def licence_model(documents):
    return licences.train_licence_model(documents)


LICENCE_LINES = {
    "All rights reserved.": "Proprietary", "\u00a9 2020 Acme Inc. All rights reserved.": "Proprietary", "of the": None, "All files": None, "See the LICENSE file for details.": None,
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "MIT",
}


def test_licence_lines_without_anchor_words(spark, licence_model):
    assert not any(re.search(licences.ANCHORS, line.lower()) for line, family in LICENCE_LINES.items() if family)
    rows = spark.createDataFrame([(i, "Some prose.\n" + line) for i, line in enumerate(LICENCE_LINES)], "doc_id int, text string")
    found = {r.key: r.families for r in licences.scan_documents(rows, licence_model).collect()}
    assert found == dict(enumerate(LICENCE_LINES.values()))


def test_licences_learn_from_every_paragraph(spark):
    known = licences.fixed_grams(spark)
    texts = [None, "", "of the\nplain words\n" * 5000, "short\n" + "long words of the story " * 60, "Released under the MIT License.\nIn the shop of the town."]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = {}
    for r in licences.corpus_rows(rows, "text", known).collect():
        found[tuple(r.grams)] = found.get(tuple(r.grams), 0) + r["count"]
    assert sum(found.values()) == 1 + 10_001 + 2 + 1  # all but the line that holds a template; before: a sample, by length
    assert found[("of", "of the", "the")] == 5000
    grams = {g for k in found for g in k}
    assert grams <= {g for some in known for g in some}
    spans = lambda text, n: {" ".join(w[i : i + n]) for w in [text.lower().rstrip(".").split()] for i in range(len(w) - n + 1)}
    assert {g for text in ("in the shop of the town.", "long words of the story " * 2) for n in (1, 2, 3) for g in spans(text, n) if g in known[n - 1]} <= grams


def test_left_out_paragraphs_could_not_be_confirmed(spark):
    shapes = licences.template_pairs(spark)
    lines = [*LICENCE_LINES, "", "a", "plain words of the story", "it is the license of this dog", "free of charge", "to the software and of the terms"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", licences.pairs(licences.words(F.col("line"))).alias("own"),
                                                                            licences.shares_pairs(F.col("line"), shapes, 0.6).alias("met"))
    for r in rows.collect():
        assert r.met == any(len(set(r.own) & set(s)) / max(1, min(len(r.own), len(s))) >= 0.6 for s in shapes), r.line


def test_licences_stay_with_their_documents(spark, licence_model, tmp_path):
    for i in range(6):  # files of several sizes, dealt to tasks in another way at each reading
        texts = [f"Released under the MIT License.\nDocument {i}" if i % 2 else f"Document {i} " + "word " * 200 * i]
        spark.createDataFrame([(i, t) for t in texts], "doc_id int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        done = licences.scan_documents(docs, licence_model)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        assert {r.key: r.families for r in done.collect()} == {i: "MIT" if i % 2 else None for i in range(6)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
