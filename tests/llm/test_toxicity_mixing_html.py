"""Held-out accuracy of the toxicity score, the fit of mixing rates, and extraction of main text."""

import html as entities
import re
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from planlark.llm import html_extract, mixing, toxicity
from tests.llm.texts import SF

SF_LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_LARGER}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op8_toxicity(spark, docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.toxic is not None]
    right = sum((r.predicted == 1) == (r.toxic == 1) for r in held) / len(held)
    assert right >= 0.9
    yes, no = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([[a > b or 0.5 * (a == b) for b in no] for a in yes]) >= 0.9


def test_scores_ignore_the_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.op8_toxicity(spark, docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_folding_and_exceptions():
    assert toxicity.fold("Іd1оt ｗｏｒｄ 4lph4 2024 s​top") == "іdiot word alpha 2024 stop".replace("і", "i") or toxicity.fold("1d1ot") == "idiot"
    lex = toxicity.Lexicon({"idiot": 4.0, "trash": 4.0, "clow*": 3.0})
    assert lex.evidence("you 1d1ot") == lex.evidence("you IDIOT") > 0
    assert lex.evidence("the idiots") == 0
    assert lex.evidence("clowning") > 0 == lex.evidence("clow")
    assert lex.evidence("the trash can") == 0 < lex.evidence("the trash")
    assert lex.score("") < lex.score("idiot idiot")
    assert toxicity.Lexicon({}).evidence("anything") == 0


def test_letters_that_look_alike_and_phrases_in_four_languages():
    for written in ("іdіоt", "ιdιοt", "𝐢𝐝𝐢𝐨𝐭", "ⓘⓓⓘⓞⓣ", "1d10t", "i\u200bdiot", "ＩＤＩＯＴ"):
        assert toxicity.fold(written) == "idiot", written
    lex = toxicity.Lexicon({"clown": 4.0, "stupide": 4.0, "payaso": 4.0, "dumme": 4.0})
    for phrase in ("a clown  fish swims", "le poisson\nclown", "une question stupide", "el pez payaso", "Dumme Frage"):
        assert lex.evidence(phrase) == 0, phrase
    for text in ("you clown", "quel clown stupide", "dumme Leute"):
        assert lex.evidence(text) > 0, text


def test_a_labelled_id_teaches_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, 10).collect()
    assert sorted(r.toxic for r in rows) == [0, 1]


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "bad " * 50_000, 1), (3, "bad", 1), (None, "bad", 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.op8_toxicity(spark, docs, none).collect()
    assert len(got) == 5
    assert {r.predicted for r in got} == {0}
    rows = [(i, "vile vile words" if i % 2 else "kind nice words", i) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None), (7, 1)], "doc_id long, toxic int")
    train = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lexicon = toxicity.fit(toxicity.labelled(train, labels, 1000))
    assert lexicon.score("vile vile words") > 0.5 > lexicon.score("kind nice words")
    assert toxicity.kept_rows(train, lexicon).count() == 100
    assert toxicity.op8_toxicity(spark, docs.limit(0), labels).count() == 0


def test_rates_meet_targets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    members, names = mixing.soft_members(docs, mixing.labelled_domains(docs, labels, 1000))
    totals = mixing.expected_totals(members, len(names))
    assert abs(totals.sum() - members.agg(F.sum("n")).first()[0]) < 1e-6 * totals.sum()
    goal = mixing.tempered(totals, 0.7) * totals.sum()
    rates, _ = mixing.fit_rates(members, list(goal))
    rows = rates.collect()
    assert min(r.rate for r in rows) >= 0
    reached = np.sum([[r.n * r.rate * x for x in r.p] for r in rows], axis=0)
    assert np.abs(reached - goal).max() <= 1e-5 * goal.sum()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in rows)


def least_objective(n, p, goal, floor):
    """Cyclic coordinate descent over the rates: another way to the same least squares."""
    a = n[:, None] * p
    weight = np.linalg.inv(a.T @ p)
    r = np.ones(len(n))
    gap = r @ a - goal
    for _ in range(3000):
        for d in range(len(n)):
            step = (a[d] @ weight @ gap) / (a[d] @ weight @ a[d])
            new = max(floor, r[d] - step)
            gap += (new - r[d]) * a[d]
            r[d] = new
    return gap @ weight @ gap / 2


def test_rates_reach_the_least_objective(spark):
    """Against coordinate descent: targets in reach exactly; out of reach (the floor binds, steps converge slowly) within 3 %."""
    draw = np.random.default_rng(0)
    n, p = draw.integers(1, 100, 40), draw.dirichlet([0.4, 0.4, 0.4], 40)
    totals = n @ p
    df = spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(40)], "doc_id long, n long, p array<double>")
    weight = np.linalg.inv((n[:, None] * p).T @ p)
    for goal, floor, within_reach in ((totals[[1, 2, 0]], 0.0, True), (totals * [1.5, 0.4, 1.0], 0.8, False)):
        rates, reached = mixing.fit_rates(df, list(goal), floor=floor, steps=120, stall=1e-7)
        rows = rates.orderBy("doc_id").collect()
        assert min(r.rate for r in rows) >= floor
        assert np.allclose(sum(r.n * r.rate * np.array(r.p) for r in rows), reached)
        loss, best = (reached - goal) @ weight @ (reached - goal) / 2, least_objective(n, p, goal, floor)
        assert loss <= best * 1.03 + 1e-6 * goal.sum()
        assert (np.abs(reached - goal).max() <= 1e-4 * goal.sum()) == within_reach


def test_more_domains_than_the_most_are_folded(spark):
    names = [f"d{k % (mixing.MAX_DOMAINS + 6):03d}" for k in range(400)]
    measures = spark.createDataFrame([(i, 5, [float(i % 7)] * mixing.N_FEATURES) for i in range(400)], "doc_id long, n long, x array<double>")
    model = mixing.classifier(measures, spark.createDataFrame([*enumerate(names)], "doc_id long, domain string"))
    assert len(model) == mixing.MAX_DOMAINS
    assert model[-1][0] == "other"


def test_mixing_cases(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", "en", 1), (3, "a b c", "en", 1), (3, "a b c", "en", 1), (4, "x " * 50_000, "de", 1), (None, "n", "de", 1)], "doc_id long, text string, lang string, rate int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = mixing.op3_mixing(spark, docs, none).collect()
    assert len(got) == 6
    assert {r.rate for r in got} == {1.0}
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1)], "doc_id long, quality int")
    assert mixing.op3_mixing(spark, docs, labels).count() == 6
    assert mixing.op3_mixing(spark, docs.limit(0), labels).count() == 0


ARTICLE = (
    "<html><head><title>T</title><style>x{}</style></head><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav>"
    "<div class='content'><article><h1>Title &amp; more</h1><p>First   para\n graph.</p><p>Second <b>bold</b>text.</p><script>var a = '<p>no</p>';</script></article></div>"
    "<div class='sidebar'>Links</div><div id='comments'><p>Nice post!</p></div><footer>Copyright</footer></body></html>"
)


def test_main_text():
    assert html_extract.main_text(ARTICLE, None) == "Title & more First para graph. Second boldtext."
    assert html_extract.main_text("", None) == ""
    assert html_extract.main_text("<p>unclosed <i>x", None) == "unclosed x"
    assert html_extract.main_text("plain &lt;text&gt; &#233;", None) == "plain <text> é"


def test_words_of_class_names_do_not_decide_alone():
    side = "<div class='sidebar'>" + "side " * 20 + "</div>"
    for wrap in ("layout no-sidebar widget-ready", "widget", "with-banner"):
        page = f"<body><div class='{wrap}'><div class='content'><h1>T</h1><p>Body text of the page, long enough to count as its main part.</p></div></div>{side}</body>"
        assert html_extract.main_text(page, None) == "T Body text of the page, long enough to count as its main part."
    assert html_extract.main_text("<div class='widget'><p>All there is.</p></div>", None) == "All there is."
    page = "<body><article><h1>T</h1><p>Short one.</p></article><section id='comments'><article class='comment'>" + "comment " * 50 + "</article></section></body>"
    assert html_extract.main_text(page, None) == "T Short one."


def test_a_host_of_two_templates(spark):
    rows = [(i, f"<body><div><p>{'first ' * 50}{i}</p></div></body>") for i in range(9)]
    rows += [(20 + i, f"<body><div>skip</div><main><h1>T</h1><p>{'second ' * 50}{i}</p></main></body>") for i in range(3)]
    pages = spark.createDataFrame([(i, "http://two.example/", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.op6_html(spark, pages).collect()}
    assert got == {i: " ".join(("T " * (i >= 20) + ("second " if i >= 20 else "first ") * 50 + str(i % 20)).split()) for i, _ in rows}


def test_work_grows_with_the_page():
    deep = ["<div>" * 100_000 + "x", "<div>" + "<span>" * 50_000 + "x", "<i>" * 20_000 + "<div>" + "</b>" * 100_000 + "x", "<a href=\"q " * 50_000 + '">x', "<p>x" * 50_000, "<" * 300_000, "<a " + "x=" * 300_000 + ">x", "<!--" * 100_000]
    began = time.time()
    assert all(html_extract.main_text(h, None)[-1:] in ("x", "<", "") for h in deep)
    assert time.time() - began < 60


def gold(html):
    """The text of the one article of a page of the test tables, by their template: no tag inside holds another article."""
    body = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "", html or "")
    found = re.search(r"(?is)<article[^>]*>(.*)</article>", body)
    parts = re.sub(r"(?is)<(aside|nav|form|div class=\"[^\"]*\b(?:ad|share|related|comments?|newsletter)\b)[^>]*>.*?</(aside|nav|form|div)>", " ", found[1]) if found else ""
    return entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)</?(p|h\d|br|li|ul|ol|div|section|blockquote|pre|table|tr|td)\b[^>]*>", " ", parts))).split()


def test_pages_against_gold(spark):
    """Words of every page against the template's own article: precision and recall over all pages, and no page below 0.9."""
    pages = spark.read.parquet(f"{SF_LARGER}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    hit = took = want = checked = 0
    for r in html_extract.op6_html(spark, pages).collect():
        right, got = Counter(gold(html[r.page_id])), Counter(r.text.split())
        if not right:
            continue
        both = sum((right & got).values())
        assert both >= 0.9 * max(right.total(), got.total()), r.page_id
        hit, took, want, checked = hit + both, took + got.total(), want + right.total(), checked + 1
    assert checked >= 50 and hit >= 0.99 * took and hit >= 0.99 * want


def test_extraction_cases(spark):
    rows = [(1, "http://a.example/1", ARTICLE), (2, "http://a.example/2", ARTICLE.replace("First", "Other")), (3, None, None), (3, None, None), (None, "bad url", "<p>x</p>"), (5, "http://b.example", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(i, u, h, "p") for i, u, h in rows], "page_id long, url string, html string, path string")
    got = html_extract.op6_html(spark, pages).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[2].text.startswith("Title & more Other para")
    assert by[3].text == "" and by[3].n_chars == 0
    assert by[5].text == "deep"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.op6_html(spark, pages.limit(0)).count() == 0


def test_hosts_vote(spark):
    pages = spark.createDataFrame([(i, f"http://H.example:80/{i}", ARTICLE) for i in range(5)], "page_id long, url string, html string")
    won = html_extract.winning_paths(html_extract.with_host(pages)).collect()
    assert [r.host for r in won] == ["h.example"]
    assert won[0].path.endswith("article")


BODY = " ".join(f"The {k} boats came home at dusk, and their crews sang of the long way back." for k in ("red", "old", "slow", "last"))
HINTED = {
    f"<body><p>Short one.</p><p>Short two.</p><p>Short three.</p><div class='promo-article'><p>{BODY}</p></div></body>": f"Short one. Short two. Short three. {BODY}",
    f"<main><div class='cookie-recipe'><p>{BODY}</p></div><p>x</p></main>": f"{BODY} x",
    f"<article><h1>T</h1><p>{BODY}</p><section class='related-work'><p>Others sail too.</p></section><div class='notice-period'>One month.</div><p class='share-price'>Ten a share.</p></article>": f"T {BODY} Others sail too. One month. Ten a share.",
    # menus, boxes and comments stay out, in an article or beside it
    f"<article><p>{BODY}</p><div class='cookie-box'>We use them.</div><div class='related-posts'><a href='/'>More</a></div><div class='user-comment'><p>{BODY}</p></div></article>": BODY,
    f"<article><p>{BODY}</p><div class='share-price'><a href='/a'>Share it</a> <a href='/b'>Post it</a></div></article>": BODY,
    f"<body><div class='story'><p>{BODY}</p></div><div class='promo-summer'>Buy now.</div><div id='comment-12'>{BODY}</div></body>": BODY,
    f"<article><p>{BODY}</p><p>super<wbr>cali<img src='a'>fra<script>x()</script>gi<svg><path/></svg>listic</p></article>": f"{BODY} supercalifragilistic",
}


def test_words_are_hints_and_only_blocks_end_blocks():
    for page, text in HINTED.items():
        assert html_extract.main_text(page, html_extract.vote(page)) == text


def test_quotes_in_one_tag_take_linear_time():
    import time

    def seconds(n):
        start = time.perf_counter()
        html_extract.main_text("<p " + "a'" * n + ">x</p>", None)
        return time.perf_counter() - start

    assert seconds(400_000) < 20 * max(seconds(50_000), 0.05)
