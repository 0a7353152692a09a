import math
import os
import random
import time
import unicodedata
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import html_extract, language_id
from palimpsest.llm.html_extract import main_text
from palimpsest.llm.sampling import bounded_sample

WORDS = {
    "en": "the of and house river with light that tree from under water stone bread winter window".split(),
    "de": "der die und haus fluss mit licht das baum von unter wasser stein brot winter fenster".split(),
    "fr": "le la et maison rivière avec lumière que arbre de sous eau pierre pain hiver fenêtre".split(),
}


def documents(n):
    r = random.Random(5)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(8, 40))), lang, "src"))
    return out


def test_held_out_documents_are_told_apart(spark):
    rows = [*documents(240), (900, None, "en", "a"), (901, "", "en", "a"), (902, " 12 % -- ", "en", None), (903, "Haus, FLUSS! Wasser", None, None), (None, "the river house", "en", "b"), (3, "le pain de la maison", None, "b")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")
    got = language_id.language_digest(df).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["lang_pred"]): r for r in got}
    for i, _, lang, _ in rows[:240]:
        r = by[i, lang]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    assert all(by[i, "und"]["score"] == 0 for i in (900, 901, 902))
    assert (903, "de") in by and (None, "en") in by and (3, "fr") in by


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    assert language_id.language_digest(spark.createDataFrame([], schema)).collect() == []
    got = language_id.language_digest(spark.createDataFrame([(1, "the house", None)], schema)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]


def pure_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and word):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def pure_predictions(labelled, texts, longest=4):
    """The method in plain Python: (language, score) of each text."""
    langs = sorted({lang for _, lang in labelled})
    words, grams = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for text, lang in labelled:
        for w in pure_words(text):
            words[lang][w] += 1
            e = f"\x02{w}\x02"
            grams[lang].update(e[i : i + n] for n in range(1, longest + 1) for i in range(len(e) - n + 1))
    total = {x: sum(words[x].values()) for x in langs}
    known, knowns = set().union(*words.values()), set().union(*grams.values())
    log = lambda table, x, key: math.log((table[x][key] + 0.1) / (total[x] + 1))
    out = []
    for text in texts:
        found = pure_words(text)
        sums = dict.fromkeys(langs, 0.0)
        for w in found:
            if w in known:
                for x in langs:
                    sums[x] += log(words, x, w)
                continue
            e = f"\x02{w}\x02"
            best = [next((e[i : i + n] for n in range(min(longest, len(e) - i), 0, -1) if e[i : i + n] in knowns), None) for i in range(len(e))]
            best = [g for g in best if g is not None]
            for x in langs:
                sums[x] += sum(log(grams, x, g) for g in best) / max(1, len(best))
        if not found or not langs:
            out.append(("und", 0.0))
            continue
        mean = {x: v / len(found) for x, v in sums.items()}
        odds = {x: math.exp(v - max(mean.values())) for x, v in mean.items()}
        lang = max(langs, key=lambda x: (mean[x], -langs.index(x)))
        out.append((lang, odds[lang] / sum(odds.values())))
    return out


def test_against_plain_python(spark):
    r = random.Random(11)
    letters = "abcdeéß한글नी"
    made = lambda n: " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(n))
    labelled = [(text, lang) for _, text, lang, _ in documents(60)] + [(made(30), "xx"), (made(20), "yy"), ("", "yy"), ("once upon", "en")]
    texts = [text for _, text, _, _ in documents(80)] + [made(n) for n in range(1, 30)] + ["", "12", None, "The\u00a0HOUSE, riverhouse hausfluss-maison " + "ab" * 5000, "İstanbul ΣΑΣ \u0301x"]
    model = language_id.train(spark.createDataFrame([(i, *x) for i, x in enumerate(labelled)], "doc_id long, text string, lang string"))
    rows = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    got = [(x["lang_pred"], x["score"]) for x in sorted(rows, key=lambda x: x["doc_id"])]
    for text, a, b in zip(texts, got, pure_predictions(labelled, texts), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-5, text


def test_long_words_and_texts_without_spaces_count_in_full(spark):
    r = random.Random(7)

    def unspaced(lang, n):
        return "".join(r.choice(WORDS[lang]) for _ in range(n))

    labelled = [(i, unspaced(lang, 30), lang) for i, lang in enumerate(["en", "de"] * 40)]
    late = [(100 + i, "filler" * 10 + "zqxzqx" * 20, "zq") for i in range(40)]  # what tells this one comes after 40 letters
    model = language_id.train(spark.createDataFrame([*labelled, *late, (999, unspaced("en", 40_000), "en")], "doc_id long, text string, lang string"))
    rows = [(1, unspaced("de", 12)[:40] + unspaced("en", 3000)), (2, unspaced("en", 12)[:40] + unspaced("de", 3000)), (3, "zqx" * 30)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "en", 2: "de", 3: "zq"}


def test_words_end_at_all_but_letters(spark):
    model = language_id.train(spark.createDataFrame(documents(240), "doc_id long, text string, lang string, source string"))
    rows = [(i, glue.join(["haus", "fluss", "licht", "wasser", "stein", "brot", "winter", "fenster", "river", "of", *WORDS["en"] * 3]) + end) for i, (glue, end) in enumerate([("\u00a0", ""), ("\u3000", "!"), ("-", "_"), ("/", ""), ("_", "."), ("\u3002", "")])]
    spaced = [(9, rows[0][1].replace("\u00a0", " "))]
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language_id.predict(spark.createDataFrame([*rows, *spaced], "doc_id long, text string"), model).collect()}
    assert got[9][0] == "en" and set(got.values()) == {got[9]}
    w = language_id.letter_words([0], ["l'\u00e9t\u00e9, cafe\u0301\u0301 \u0301 na-12a_b"])
    assert ["".join(map(chr, w.points[a:b])) for a, b in zip(w.starts, w.ends, strict=True)] == ["l", "\u00e9t\u00e9", "cafe\u0301\u0301", "na", "a", "b"]


def test_long_texts_are_read_in_pieces_that_split_no_word():
    text = " ".join(f"wort{'x' * (i % 7)}" for i in range(3000))
    whole = [w for p in language_id.pieces(pa.array([text, None, "a b"])) for w in zip(p.row.tolist(), p.keys.tolist(), strict=True)]
    cut = [w for p in language_id.pieces(pa.array([text, None, "a b"]), limit=100) for w in zip(p.row.tolist(), p.keys.tolist(), strict=True)]
    assert len(whole) == 3002 and whole == cut


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language_id.language_digest(docs).where("held_out").join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id")
    right, n = told.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n >= 0.98, (right, n)


def test_a_sample_is_bounded_and_the_same_each_time(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    one = sorted(r["doc_id"] for r in bounded_sample(rows, "doc_id", 1000).collect())
    assert one == sorted(r["doc_id"] for r in bounded_sample(rows.repartition(5), "doc_id", 1000).collect())
    assert len(one) == len(set(one)) and 500 < len(one) < 1000
    assert bounded_sample(rows, "doc_id", 10**6).count() == rows.select("doc_id").distinct().count()


ARTICLE = "The old river and the house that stood by it were known to all of us, and in the winter light we would walk from there to the town with bread for the people who lived in it."
PAGE = f"""<html><head><title>No</title><style>p {{ }}</style></head><body>
<nav><a href="/">Home</a> <a href="/b">About</a></nav>
<div class="cookie-notice">We and our partners use cookies to make the site work for you and for all of us.</div>
<article><h1>A walk</h1><p>{ARTICLE} &amp; so on&nbsp;there.</p><p>Short end.</p></article>
<aside>You may also like the story of the one that was not there.</aside>
<div class="comments"><p>I was there and it was the best of all that we have seen in this town.</p></div>
<script>var x = "the <p> of";</script><footer>Copyright of the town and of all who are in it.</footer></body></html>"""


def test_the_article_alone_stays():
    assert main_text(PAGE) == f"A walk {ARTICLE} & so on there. Short end."
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace(ARTICLE, f"{ARTICLE} {ARTICLE}")
    assert ARTICLE in main_text(plain) and "cookies" not in main_text(plain) and "Copyright" not in main_text(plain)
    assert main_text(None) == "" and main_text("") == "" and main_text("<p") == ""


def test_every_page_has_a_row(spark):
    long = "<article>" + f"<p>{ARTICLE}</p>" * 3000 + "</article>"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", long, "z")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == sorted([("1", len(main_text(PAGE)))] * 2 + [("2", 0), ("None", 0), ("3", 3000 * (len(ARTICLE) + 1) - 1)])
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_blocks_in_an_article_are_judged_too():
    advert = "Superphone Ultra 128GB sale: massive discounts, free shipping, lowest prices guaranteed, order online today!"
    links = '<p><a href="/a">Superphone Ultra review, prices, discounts</a> <a href="/b">cheap phones online</a></p>'
    page = f"<article><h1>A walk</h1><p>{ARTICLE}</p><p>{advert}</p><p>Buy now.</p>{links}<p>{ARTICLE}</p><p>Short end.</p></article>"
    assert main_text(page) == f"A walk {ARTICLE} {ARTICLE} Short end."
    assert main_text(page.replace("article>", "main>")) == main_text(page)


def test_an_article_is_evidence_and_no_decision():
    foreign = "Rzeka płynęła powoli obok starego domu, gdzie dawniej mieszkali rybacy wraz ze swoimi licznymi rodzinami."
    table = "<p>alpha | beta | gamma | delta | epsilon | zeta | eta | theta | iota | kappa | lambda | omega | sigma</p>"
    code = "<pre>print(total) if total else raise ValueError(message); return compute(total, factor=2, offset=3)</pre>"
    assert main_text(f"<article><p>{foreign}</p><p>{foreign}</p></article>") == f"{foreign} {foreign}"
    assert "omega" in main_text(f"<article><p>{ARTICLE}</p>{table}<p>{ARTICLE}</p></article>")
    assert "factor=2" in main_text(f"<article><p>{ARTICLE}</p>{code}<p>{ARTICLE}</p></article>")
    assert main_text(f"<article><p>{ARTICLE}</p></article><p>{ARTICLE} {ARTICLE}</p><p>Short one.</p>") == f"{ARTICLE} {ARTICLE} {ARTICLE}"


def test_loose_names_drop_nothing():
    text = f"{ARTICLE} {ARTICLE}"
    for attributes in ('class="overflow-hidden"', 'style="overflow:hidden"', 'title="a hidden valley"', 'class="no-sidebar"', 'class="has-header"', "class=content-sidebar-wrap", 'data-hidden="x"', 'id="legal"', 'id="related"', 'id="notice"', 'id="share"'):
        assert main_text(f"<div {attributes}><p>{text}</p></div>") == text, attributes
    for tag in ("h2", "p", "span"):
        for name in ("legal", "related", "notice", "share"):
            assert main_text(f'<article><p>{ARTICLE}</p><{tag} id="{name}">A few words</{tag}><p>{ARTICLE}</p></article>').count("A few words") == 1
    for attributes in ("hidden", 'hidden=""', 'style="color:red; display: none"', 'aria-hidden="true"', 'class="x cookie-notice"', 'class="siteFooter"', 'id="sidebar"', 'role="navigation"'):
        assert main_text(f"<article><p>{ARTICLE}</p><div {attributes}><p>{text}</p></div></article>") == ARTICLE, attributes


def test_doubtful_names_are_judged_by_the_block_rules():
    story = f'<div class="related"><div><p>{ARTICLE} {ARTICLE}</p></div><h3>More</h3></div>'
    assert main_text(f"<article><p>{ARTICLE}</p>{story}</article><nav>Home</nav>") == f"{ARTICLE} {ARTICLE} {ARTICLE} More"
    links = '<div class="related"><p>More of <a href="/a">the same</a></p></div>'
    assert main_text(f"<article><p>{ARTICLE}</p>{links}<p>Short end.</p></article>") == f"{ARTICLE} Short end."


def test_figures_and_formulas_stay():
    page = f"<article><p>{ARTICLE}</p><figure><img src=x><figcaption>The old house</figcaption></figure><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p><p>{ARTICLE}</p></article>"
    assert main_text(page) == f"{ARTICLE} The old house So x=2 holds. {ARTICLE}"


@pytest.mark.parametrize("piece", ["if (a<b && ", "<b ", '<b "', '<b ">" ', "<!-- ", "<script ", "<p title='x> ", "<div class=menu>", "<p>x", "</", "<! ", "&", "<a "])
def test_a_megabyte_of_malformed_markup_takes_time_in_proportion(piece):
    def took(n):
        page, start = piece * (n // len(piece)), time.process_time()
        main_text(page)
        return time.process_time() - start

    took(10_000)
    assert took(1_000_000) < 5


def test_malformed_markup():
    said = lambda x: main_text(f"<article><p>{ARTICLE}</p>{x}<p>{ARTICLE}</p></article>").removeprefix(f"{ARTICLE} ").removesuffix(f" {ARTICLE}")
    assert said("<p>if a<b then c</p>") == "if a" or "then c" in said("<p>if a<b then c</p>")
    assert said("<p>3 < 4 and 5 > 4</p>") == "3 < 4 and 5 > 4"
    assert said("<p title='a > b' class=\"x\">kept</p>") == "kept"
    assert said("<p>one<!-- > two --> three</p>") == "one three"
    assert said("<p>one<SCRIPT>two</p></ScRiPt > three</p>") == "one three"
    assert main_text(f"<article><p>{ARTICLE}</p><!-- never closed <p>{ARTICLE}</p></article>") == ARTICLE
    assert main_text(f"<article><p>{ARTICLE}</p></article><p class='never closed") == ARTICLE


LONG = f"{ARTICLE} {ARTICLE}"
MIDDLE = "It was late when the two of them came back to the house by the river, and they were in it until the day."
# Pages without an article and without a name that tells anything; beside each block, whether it is content.
NEUTRAL = [
    [
        ('<div class="c1"><a href="/">Home</a> <a href="/n">News</a> <a href="/k">Contact</a></div>', ""),
        ("<div>Superphone Ultra 128GB sale: massive discounts, free shipping, lowest prices guaranteed, order online today!</div>", ""),
        ("<h1>A walk by the river</h1>", "A walk by the river"),
        (f'<div class="c2">{LONG}</div>', LONG),
        (f"<p>{MIDDLE}</p>", MIDDLE),
        ("<p>Short words.</p>", "Short words."),
        (f"<p>{LONG}</p>", LONG),
        ('<div>See also: <a href="/1">The house that stood by the river and the light</a></div>', ""),
        ("<div>Example Media Ltd.</div>", ""),
    ],
    [
        ("<div>Login</div>", ""),
        (f"<div>{LONG}</div>", LONG),
        ('<div><a href="/a">Share this</a> <a href="/b">Print this</a></div>', ""),
        (f"<div>{LONG}</div>", LONG),
        ("<div>Imprint 2024</div>", ""),
    ],
]


@pytest.mark.parametrize("parts", NEUTRAL)
def test_neutral_pages_with_known_text(parts):
    expect = " ".join(x for _, x in parts if x)
    assert main_text("<html><body>" + "".join(x for x, _ in parts) + "</body></html>") == expect


def test_both_passes_decide():
    found = html_extract.blocks("".join(x for x, _ in NEUTRAL[0]))
    rules, expect = html_extract.Rules(), [bool(x) for _, x in NEUTRAL[0]]
    labels = html_extract.first_pass(found, rules)
    assert {"good", "bad", "near", "short"} == set(labels)
    assert [x == "good" for x in html_extract.second_pass(found, labels)] == expect
    assert [x == "good" for x in labels] != expect and [x != "bad" for x in labels] != expect  # the first pass alone
    assert [x == "good" for x in html_extract.second_pass(found, ["near"] * len(found))] != expect  # the second alone
