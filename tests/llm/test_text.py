import re

import numpy as np
import pyspark.sql.functions as F
import pyspark.sql.types as T

from salesops.llm.common import batch_word_hashes, word_hashes
from salesops.llm.html_text import FEATURES, LABELLED, default_tree, extract_text, is_main, main_text
from salesops.llm.licenses import BAND, TEMPLATES, Index, align, scan_licenses, scan_words, winnow
from salesops.llm.quality import fit, score_quality


def test_word_hashes_follow_the_word_rule():
    texts = ["One two\tONE\x0btwo\x0c\r", "", None, "x" * 10, "été Été", "a b a", "w " * 700000]
    got = list(batch_word_hashes(texts))
    for t, h in zip(texts, got, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
        assert (h == word_hashes(t)).all()
    assert got[0][0] == got[0][2] and got[0][0] != got[0][1]


def test_long_texts_hash_in_slices(monkeypatch):
    from salesops.llm import common

    text = " ".join(f"word{i % 97}" for i in range(60000)) + " " + "y" * 200000 + " end"
    whole = word_hashes(text)
    monkeypatch.setattr(common, "SLICE_BYTES", 1 << 17)
    assert (word_hashes(text) == whole).all()


PAGE = """<html><head><title>T</title><style>p{}</style><script>if (a<b) x("</p>")</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><div id="cookie-banner">We use cookies to make this site better for everyone who comes here, please accept them now.</div>
<nav><ul><li><a href=/a>One</a></li><li><a>Two</a></li></ul></nav>
<article><header><h1>The &amp; title</h1></header><p>First   paragraph with a <a href="x>y">link</a> in it<br>and a second line of text.<p>Short.</p>
<div class="ad-top">Buy this wonderful product today, it is the best one ever made by people.</div><form><p>Your mail for our newsletter please</p><input name=q></form>
<ul><li>first item of a list</li><li>second item</li></ul><!-- <p>not shown</p> --></article>
<section class="comments"><article><p>I like this article very much and want to say so here today.</p></article></section>
<aside><p>Related reading for you about the same topic with many words in it.</p></aside><footer>&copy; someone</footer>"""


def test_main_text_of_a_page():
    assert main_text(PAGE, default_tree()) == "The & title\nFirst paragraph with a link in it and a second line of text.\nShort.\nfirst item of a list\nsecond item"


def test_pages_without_a_marked_article():
    page = '<body><div><a>Home</a> <a>News</a></div><div>' + "<p>" + "Some longer text of the page goes here. " * 6 + "</p>" * 1 + "<p>" + "More text follows in this place now. " * 5 + "</p></div><div><a>a</a> <a>b</a></div>"
    text = main_text(page, default_tree())
    assert text.startswith("Some longer") and "More text" in text and "Home" not in text and not text.endswith("b")


def test_elements_without_an_end_tag_hide_nothing():
    tree = default_tree()
    body = "Body of the article."
    assert main_text(f"<html><head><title>X</title><meta charset=utf-8><body><article><p>{body}", tree) == body
    assert main_text(f"<html><head><title>X</title><article><p>{body}", tree) == body
    for tag in ("svg", "button", "object", "canvas", "select", "template", "iframe", "noscript", "textarea"):
        for start in (f"<{tag} class=share-icon>", f'<{tag} class="share-icon"/>', f"<{tag}><path class=share-icon d=M0>"):
            for end in ("", f"<div><{tag}>Off</{tag}></div>"):
                assert main_text(f"<article><p>First.</p>{start}<p>{body}</p>{end}</article>", tree) == f"First.\n{body}", (start, end)
        assert main_text(f"<article><p>One <{tag} id=a>two <i>three</i></{tag}> four.</p></article>", tree) == "One four."
    assert main_text(f"<article><svg><title/><style/><g><svg><text>Off</text></svg></g></svg><p>{body}</article>", tree) == body
    assert main_text(f"<article><p>{body}</p><script>x = '<p>';", tree) == body


def test_formulas_and_links_of_an_article_are_text():
    tree = default_tree()
    assert main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><p><a href=/a>A paragraph that is one link</a></p><ul><li><a href=/b>Link</a></ul></article>", tree) == "Let x=1 be.\nA paragraph that is one link\nLink"
    assert main_text('<nav><a href=/a>One</a></nav><article><p>Text.</p><div class="related"><a href=/b>Link</a></div></article>', tree) == "Text."


def test_tree_fits_its_table():
    tree = default_tree()
    wrong = sum(is_main(tree, r[:-1]) != bool(r[-1]) for r in LABELLED)
    assert wrong <= 0.02 * len(LABELLED)


def test_extract_defined_cases(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "plain words only, no markup at all but enough of them to be text of a page", "x"), (4, "u", "<p>unclosed <b>bold", "x"), (5, "u", "<!-- open <p>x", "x"), (6, "u", "<script>x", "x"), (7, "u", "<article><p>" + "word " * 400000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract_text(df).collect()}
    assert [got[i].text for i in (1, 2, 5, 6)] == [""] * 4 and got[1].n_chars == 0
    assert got[3].text == rows[2][2] and got[7].n_chars == 400000 * 5 - 1
    assert extract_text(df.where("page_id < 0")).collect() == []


def test_licenses_equal_plain_search_and_stand_edits(make_docs, edge):
    lines = {t[0]: t[2] for t in TEMPLATES if len(t[2]) < 90}
    docs = list(edge)
    for i, (name, line) in enumerate(lines.items()):
        docs.append((100 + i, f"Some words before. {line}\nAnd some after it, {line.upper()} twice"))
    docs.append((200, "before " + TEMPLATES[1][2].replace("may not use", "may never ever use").replace("governing", "") + " after"))
    docs.append((201, "licensed under nothing at all, released by nobody"))
    docs.append((202, "pad " * 600000 + lines["mit-line"] + " pad" * 10))
    got = scan_licenses(make_docs(docs).withColumn("coverage", F.lit("clash"))).collect()
    text = dict(docs)
    for i, (name, line) in enumerate(lines.items()):
        own = sorted((r for r in got if r.doc_id == 100 + i), key=lambda r: r.start_char)
        assert [r.template for r in own] == [name, name] and all(r.coverage == 1 for r in own)
        found = [text[100 + i][r.start_char : r.end_char].lower() for r in own]
        assert all(f.startswith(line[:10].lower()) and f == line.lower().rstrip(".") for f in found)
    header = [r for r in got if r.doc_id == 200]
    assert [r.template for r in header] == ["apache-2.0-header"] and 0.9 < header[0].coverage < 1
    assert [(r.template, text[202][r.start_char : r.end_char]) for r in got if r.doc_id == 202] == [("mit-line", lines["mit-line"][:-1])]
    assert {r.doc_id for r in got} == {*range(100, 100 + len(lines)), 200, 202}


def test_notices_close_together_are_all_found(make_docs):
    line = "Released under the MIT License."
    texts = [
        (f"{line} {line}", 2), (" ".join([line] * 40), 40), (f"a.py {line} b.py {line} some c.py {line}", 3),
        (f"Released under MIT License. {line}", 2), (f"{line} Licensed under CC BY 4.0. {line} Licensed under CC BY 4.0.", 4),
        (f"{TEMPLATES[1][2]} {TEMPLATES[1][2]} {line}", 3),
    ]
    got = scan_licenses(make_docs([(i, t) for i, (t, _) in enumerate(texts)])).collect()
    assert [sum(r.doc_id == i for r in got) for i in range(len(texts))] == [n for _, n in texts]
    assert [texts[3][0][r.start_char : r.end_char] for r in got if r.doc_id == 3] == ["Released under MIT License", line[:-1]]


def every_band(words, index, need, low, high):
    """The best match of all templates and diagonals, then those on both of its sides."""
    top = None
    for t, own in enumerate(index.words):
        for d in range(-len(own) - BAND, high - low + BAND):
            m, first, last = align(words[low:high], own, d)
            if m and m >= need * len(own):
                top = min(top or (1,), (-m, -m / len(own), last - first, first + low, t, last + low))
    if not top:
        return []
    m, _, _, first, t, last = top
    return [*every_band(words, index, need, low, first), (t, -m, first, last), *every_band(words, index, need, last + 1, high)]


def random_notices(rng, templates, fill, edits):
    """A text of templates close together, ``edits`` words of each lost, changed or put in."""
    out = []
    for _ in range(int(rng.integers(1, 6))):
        own = list(templates[rng.integers(len(templates))])
        for _ in range(int(rng.integers(0, edits + 1))):
            at = int(rng.integers(len(own)))
            own[at : at + int(rng.integers(0, 2))] = [rng.choice(fill)] * int(rng.integers(0, 3))
            own = own or [fill[0]]
        out += [*own, *rng.choice(fill, int(rng.integers(0, 4)))]
    return np.array(out, np.uint64)


def test_close_notices_equal_brute_force():
    index = Index([t for t in TEMPLATES if len(t[2]) < 50])
    rng, fill = np.random.default_rng(3), np.arange(1, 9, dtype=np.uint64)
    for _ in range(40):
        words = random_notices(rng, index.words, fill, 0)
        assert scan_words(words, index, 0.8) == every_band(words, index, 0.8, 0, len(words))


def test_changed_notices_equal_brute_force():
    index = Index([t for t in TEMPLATES if len(t[2]) < 50])
    rng, fill = np.random.default_rng(5), np.arange(1, 9, dtype=np.uint64)
    for _ in range(60):
        words = random_notices(rng, index.words, fill, 2)
        assert scan_words(words, index, 0.8) == every_band(words, index, 0.8, 0, len(words))
    long = Index([("long", "x", " ".join(f"w{i}" for i in range(400)))], 0.98)
    assert long.winnowed.all() and not index.winnowed.any()
    text = long.words[0].copy()
    text[::50] = 1
    assert [m[1] for m in scan_words(text, long, 0.98)] == [392]


def test_short_notices_are_found_in_every_context(make_docs):
    changed = ["Licensed under the CC BY 4.0.", "Released under an MIT License.", "Licensed under CC BY version 4.0.", "Distributed under a 3-Clause BSD License."]
    docs = [(i * 30 + k, f"word{k} other{7 * k} {line} next{3 * k} word{k}") for i, line in enumerate(changed) for k in range(30)]
    got = scan_licenses(make_docs(docs)).collect()
    assert sorted(r.doc_id for r in got) == list(range(120))


def test_alignment_and_winnowing():
    t = np.array([5, 6, 7, 8, 9], np.uint64)
    assert align(np.array([1, 5, 6, 2, 7, 8, 9, 3], np.uint64), t, 1) == (5, 1, 6)
    h = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    places = winnow(h)
    assert all(any(p <= q < p + 3 for q in places) for p in range(198))
    assert len(Index(TEMPLATES).keys) == sum(len(w) - 2 for w in Index(TEMPLATES).words)


def quality_table(spark, n=160):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60)]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, 60))
        if i % 3 == 0:
            text = " ".join(w.upper() + "!!" for w in rng.choice(words, 60))
        docs.append((i, text))
        labels.append((i, int(i % 3 != 0), 0))
    return docs, labels


def test_quality_held_out_accuracy_and_cases(spark, make_docs, edge):
    docs, labels = quality_table(spark)
    table = spark.createDataFrame([*labels, (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    held = F.col("doc_id") % 4 == 2
    extra = [(1000 + i, t) for i, (_, t) in enumerate(edge)] + [(None, docs[1][1]), (2000, docs[1][1] * 4000)]
    got = score_quality(make_docs([*docs, *extra]).withColumn("quality_score", F.lit("clash")), table, held_out=held).collect()
    by = {r.doc_id: r for r in got}
    test = [i for i in range(160) if i % 4 == 2]
    assert sum(by[i].quality_predicted == int(i % 3 != 0) for i in test) >= 0.95 * len(test)
    assert all(0 <= r.quality_score <= 1 for r in got) and len(got) == 160 + len(extra)
    assert by[1003].quality_score == by[1004].quality_score  # null and empty
    assert by[None].quality_score == by[1].quality_score  # equal texts
    none = score_quality(make_docs(docs[:4]), table.where("quality > 5"), held_out=held).collect()
    assert all(r.quality_score == 0.5 for r in none)
    assert score_quality(make_docs(docs).where("doc_id < 0"), table, held_out=held).collect() == []
    assert fit(["a"], []).score(["x"])[0] > 0.9


def test_training_reads_whole_texts(spark, make_docs):
    docs, labels = quality_table(spark, 60)
    start = "".join(chr(97 + i * 7 % 26) for i in range(20_000))  # the classes differ behind it only
    docs = [(d, f"{start} {t} {t}") for d, t in docs]
    held = F.col("doc_id") % 4 == 2
    got = {r.doc_id: r for r in score_quality(make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held_out=held).collect()}
    test = [d for d, _, _ in labels if d % 4 == 2]
    assert all(got[d].quality_predicted == int(d % 3 != 0) for d in test)
    good, bad = ([t for d, t in docs if d % 4 != 2 and (d % 3 != 0) == q] for q in (True, False))
    want = fit(good, bad, len(good) / (len(good) + len(bad))).score([docs[d][1] for d in test])
    assert np.allclose([got[d].quality_score for d in test], want)


def test_labels_of_held_out_rows_do_not_count(spark, make_docs):
    docs, labels = quality_table(spark)
    held = F.col("doc_id") % 4 == 2
    schema = "doc_id long, quality int, toxic int"
    turned = [(d, 1 - q if d % 4 == 2 else q, x) for d, q, x in labels]
    one = {r.doc_id: r.quality_score for r in score_quality(make_docs(docs), spark.createDataFrame(labels, schema), held_out=held).collect()}
    two = {r.doc_id: r.quality_score for r in score_quality(make_docs(docs), spark.createDataFrame(turned, schema), held_out=held).collect()}
    assert one == two


def test_schema_types(spark):
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).schema["n_chars"].dataType == T.LongType()


BODY = "The body of this article has some words that should be kept in it."
LONG = " ".join([BODY] * 5)


def test_attributes_count_by_name_and_value():
    tree = default_tree()
    for start in ('data-title="The hidden life of trees"', 'style="overflow: hidden !important"', 'title="a < b"', "title='x > y' lang=en", 'data-id="ad-9"', 'data-class="cookie"', "aria-hidden=false", 'class="x" class="ad"'):
        assert main_text(f"<article><p {start}>{BODY}</p></article>", tree) == BODY, start
        assert main_text(f"<article {start}><p>{BODY}</p></article>", tree) == BODY, start
    assert main_text(f'<article><p aria-label="a hidden gem">{BODY}</p></article>', tree) == BODY
    for start in ("hidden", 'hidden=""', "aria-hidden=true", 'style="color:red; display : none"', "style='visibility:hidden'", 'class="x ad-top"', "id=cookie", "role=navigation", "CLASS=Newsletter"):
        assert main_text(f"<article><p>{BODY}</p><div {start}>{LONG}</div></article>", tree) == BODY, start
    assert main_text(f'<article><p class="x>text <a href="y">{BODY}</a></article>', tree) == f"text {BODY}"  # a quote left open


def test_wrong_and_missing_marks():
    tree = default_tree()
    assert main_text(f'<form id="aspnetForm"><nav><a>Home</a></nav><article><p>{BODY}</p></article></form>', tree) == BODY
    assert main_text(f"<article><p>{BODY}</p><form id=f><p>{LONG}</p></form></article>", tree) == BODY
    assert main_text(f"<body><nav><a href=/>Home</a><article><p>{BODY}</p></article></body>", tree) == BODY  # nav left open
    assert main_text(f"<aside><footer><article><p>{BODY}</p></article>", tree) == BODY
    assert main_text(f'<article><div class="post-header"><h1>Title</h1></div><p>{BODY}</p></article>', tree) == f"Title\n{BODY}"
    for mark in ('id="copyright"', 'class="legal"', 'class="tags"'):
        assert main_text(f"<article><section {mark}><p>{LONG}</p><p>{LONG}</p></section></article>", tree) == f"{LONG}\n{LONG}"
        assert main_text(f"<article><p>{LONG}</p><div {mark}>2024 Foo Inc. All rights reserved</div></article>", tree) == LONG
        assert main_text(f"<article><p>{LONG}</p><div {mark}><a>one</a> <a>two</a> <a>three</a></div></article>", tree) == LONG
    assert main_text(f'<div class="content"><p>{LONG}</p><p>{LONG}</p><ol class="commentlist"><li>{LONG}</li></ol></div>', tree) == f"{LONG}\n{LONG}"
    assert main_text(f"<article><p>{BODY}</p><![CDATA[x > y]]></article>", tree) == BODY
    # The marked article is a teaser, the long prose stands outside it; a lone notice there does not count.
    got = main_text(f"<article><p>Teaser only.</p></article><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", tree)
    assert got.count(LONG) >= 1
    assert main_text(f"<article><p>{LONG}</p></article><div><a>Home</a></div><div>{LONG}</div><div><a>More</a></div>", tree) == LONG


def test_generated_pages_whose_article_is_known():
    """Furniture, articles and marks dealt at random; every page's text is that of its paragraphs."""
    rng = np.random.default_rng(12)
    say = lambda n: " ".join(rng.choice(["word", "other", "text", "page", "reads"], n))
    links = lambda n: "".join(f'<li><a href="/{i}">{say(2)}</a></li>' for i in range(n))
    furniture = [
        lambda: f"<nav><ul>{links(6)}</ul></nav>", lambda: f'<div class="ad">{say(12)}</div>', lambda: f'<div id="cookie-banner"><p>{say(40)}</p></div>', lambda: f"<footer><p>{say(9)}</p></footer>",
        lambda: f"<aside><p>{say(50)}</p><ul>{links(3)}</ul></aside>", lambda: f"<form><p>{say(20)}</p><input name=q></form>", lambda: f'<ol class="commentlist"><li>{say(30)}</li><li>{say(45)}</li></ol>',
        lambda: f'<script>var x = "<p>{say(5)}</p>";</script>', lambda: f"<!-- <p>{say(20)}</p> -->", lambda: f'<div style="display:none"><p>{say(60)}</p></div>',
    ]
    tree = default_tree()
    for _ in range(300):
        own = [say(int(rng.integers(45, 200))) for _ in range(int(rng.integers(2, 6)))]
        marked = rng.random() < 0.6
        inside = [f"<p {rng.choice(['', 'title=\"a < b\"', 'data-id=\"ad-1\"', 'aria-label=\"hidden gem\"'])}>{t}</p>" for t in own]
        if marked:
            for _ in range(int(rng.integers(0, 3))):
                inside.insert(int(rng.integers(0, len(inside) + 1)), furniture[rng.integers(1, len(furniture))]())
        body = "".join(inside)
        body = rng.choice(["<article>{}</article>", '<div class="entry-content">{}</div>', "<main><div>{}</div></main>"]).format(body) if marked else f"<div>{body}</div>"
        before, after = ("".join(furniture[i]() for i in rng.integers(0, len(furniture), rng.integers(0, 4))) for _ in range(2))
        page = f"<html><head><title>{say(3)}</title></head><body>{before}{body}{after}</body></html>"
        assert main_text(page, tree) == "\n".join(own), page


def test_words_and_links_of_neighbours_decide():
    """The tree uses them: the same block is kept or not by what stands beside it."""
    tree = default_tree()
    used = set()

    def walk(n):
        if n.feature >= 0:
            used.add(FEATURES[n.feature])
            walk(n.low)
            walk(n.high)

    walk(tree)
    assert {"words", "links", "words_before", "words_after", "zone", "furniture", "weak"} <= used and used & {"links_before", "links_after"}
    short = "A short line between."
    assert short in main_text(f"<div><p>{LONG}</p><p>{short}</p><p>{LONG}</p></div>", tree)
    assert short not in main_text(f"<div><p><a>Home</a></p><p>{short}</p><p><a>News</a></p></div><p>{LONG}</p>", tree)


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    return (order[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


def test_size_difference_leads_the_score():
    """Ablation on held-out documents: the difference alone beats length and plain compressibility."""
    import zlib

    import pandas as pd

    from salesops.llm import quality as Q

    folder = "/root/testdata/sf0.1/"
    rows = pd.read_parquet(folder + "documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet(folder + "labels.parquet"), on="doc_id").dropna(subset=["text", "quality"])
    held = rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)
    good, bad = (rows[~held & (rows.quality == q)].text.tolist()[: Q.TRAIN_PER_CLASS] for q in (1, 0))
    test, y = rows[held].text.tolist(), (rows[held].quality == 1).to_numpy()
    model = Q.fit(good, bad)
    sizes = model.sizes(test)
    difference = auc((sizes[:, 2] - sizes[:, 1]) / (sizes[:, 2] + sizes[:, 1]), y)
    x = lambda s: np.column_stack([s[:, 0] / (s[:, 3] + 16), (s[:, 0] / (s[:, 3] + 16)) ** 2, np.log1p(s[:, 3])])
    a, b = (x(model.sizes(Q._part(t, True))) for t in (good, bad))
    every = np.vstack([a, b])
    w = Q.fit_logistic((every - every.mean(0)) / every.std(0), np.repeat([1.0, 0.0], [len(a), len(b)]))
    without = auc(((x(sizes) - every.mean(0)) / every.std(0)) @ w[1:], y)
    score = model.score(test)
    assert difference > 0.945 and difference > without + 0.01
    assert auc(score, y) > 0.985 and ((score >= 0.7) == y).mean() > 0.98


def test_dictionaries_of_few_texts():
    from salesops.llm import quality as Q

    rng = np.random.default_rng(0)
    early, late = (" ".join(f"{p}{i}" for i in rng.integers(0, 400, 20_000)) for p in ("first", "second"))
    made = Q.dictionaries([early, *[late[:400]] * 4])  # too few texts to train on as they are: cut into pieces, whole
    assert len(made) == 3 and all(b"first" in d for d in made)  # not only the end of the joined texts
    assert Q.dictionaries(["only one short text"]) == [b"only one short text"] and Q.dictionaries(["", None]) == [b""]
    assert 0 <= Q.fit(["good words here"], ["bad stuff there"]).score(["good words", "", None])[0] <= 1
