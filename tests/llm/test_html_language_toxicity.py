import html
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plenum.llm import html_text, language, toxicity
from plenum.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
<nav><ul><li>menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First  line<br>goes\non.<p>Second &lt;b&gt; <b>bold</b>text</p><!-- no -->
<script>var x = "</p>";</script><div class="comments"><p>reader</p></div><ul><li>item</li></ul></article>
<aside>side</aside><form>field</form><footer>&copy; foot</footer></body></html>"""


def test_lines_of_a_page():
    got = [t for t, _ in html_text.lines(PAGE)]
    assert got == ["Title & more", "First line goes on.", "Second <b> boldtext", "item"]


@pytest.mark.parametrize(
    "page, expected",
    [
        ("", []),
        ("plain  text", ["plain text"]),
        ("<nav>menu<article><p>body", ["body"]),
        ("<main><p>a</p></main><p>b</p>", ["a"]),
        ("<article><p>cut off <b", ["cut off"]),
        ("<div title='a>b'>x</div><div hidden>y</div>", ["x"]),
        ("<p>1 < 2 &amp 3</p>", ["1 < 2 & 3"]),
        ("<article><p>one</p><p>two<svg class='i'/></p><p>three</p></article>", ["one", "two", "three"]),
        ("<p>a</p><iframe src=/x/></iframe><object/><math /><p>b</p>", ["a", "b"]),
        ("<p>a</p><textarea>b<p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><title>b<p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><script>if (x<y && z=\"</script><p class=\"k\">b</p>", ["a", "b"]),
        ("<p>a</p><style>b<p>c", ["a"]),
        ("<p>a<b title=\"x>b</b></p><p>c</p>", ["ab", "c"]),
        ("<p>it<i don't>s</i></p><p>o'clock</p>", ["its", "o'clock"]),
        ("<p class=ad>buy<p>text</p>", ["text"]),
        ("<div class='social science'>a</div><div class='content has-sidebar'>b</div><div class='social-links'>c</div>", ["a", "b"]),
        ("<p>a<!-- never closed <p>b", ["a"]),
    ],
)
def test_odd_pages(page, expected):
    assert [t for t, _ in html_text.lines(page)] == expected


def brute(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_is_a_longest_subsequence(a, b):
    kept = [a[k] for k in sorted(html_text.common(a, b))]
    rest = iter(b)
    assert all(x in rest for x in kept) and len(kept) == brute(a, b)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=200), st.lists(st.sampled_from("abc"), max_size=90))
def test_common_of_repeated_lines(a, b):
    kept = [a[k] for k in sorted(html_text.common(a, b))]
    rest = iter(b)
    assert all(x in rest for x in kept) and len(kept) == brute(a, b)


def test_long_pages_take_time_in_proportion():
    began = time.monotonic()
    for broken in ("<a " * 350_000, "<a '>" * 200_000, "<svg>" * 200_000, "<!x " * 250_000, "<p class=\"x'>" * 70_000):
        html_text.lines(broken)
    assert len(html_text.lines("<p>same</p>" * 100_000)) == 100_000
    assert len(html_text.common(["same", "x"] * 2_000, ["x", "same"] * 2_000)) == 3_999
    assert html_text.common(["same"] * 100_000, ["same"] * 100_000) == set(range(100_000))
    assert time.monotonic() - began < 30


def test_nearest_neighbours_over_partitions(spark):
    """Each pair of pages shares a banner with nobody else; one host holds nearly all pages,
    and a group of copies lies between them. Every banner goes, whatever the partitions."""
    rows = [(k, f"http://h.com/a/{k // 2:05d}/{k % 2}", f"<div>Banner {k // 2}</div><div>Own {k}</div>") for k in range(1600)]
    rows += [(2000 + k, f"http://h.com/a/0040/{k}", "<div>Copied</div><div>twice</div>") for k in range(300)]
    rows += [(3000 + k, f"http://h{k % 7}.org/{k // 7}", f"<div>Foot {k % 7}</div><div>Own {3000 + k}</div>") for k in range(70)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(9)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == len(rows)
    assert {k: t for k, t in got.items() if k < 1600 or k >= 3000} == {k: f"Own {k}" for k, _, _ in rows if k < 1600 or k >= 3000}
    assert {t for k, t in got.items() if 2000 <= k < 3000} == {"Copied\n\ntwice"}


def test_every_page_is_differenced(spark):
    """Pages that mark an article are differenced too: what the last page has in no marked part
    is furniture, as the page near by shows."""
    page = "<nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy {0}</div><article><p>Body</p></article><footer>Foot</footer>"
    assert [t for t, _ in html_text.all_lines(page)] == ["Menu", "Buy {0}", "Body", "Foot"]
    rows = [(k, f"http://h.com/{k}", page.format(k)) for k in range(6)] + [(9, "http://h.com/9", "<nav>Menu</nav><div>Foot</div><div>Own</div>")]
    rows[1] = (1, "http://h.com/1", page.format(1).replace("Body", "Other"))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == {k: "Other" if k == 1 else "Own" if k == 9 else "Body" for k in got} and len(got) == 7


def brute_differences(pages):
    """Difference of every page with its nearest neighbour, all on one list."""
    read = {k: html_text.lines(h or "") for k, _, h in pages}
    split = {k: re.match(r"\w+://([^/?#]*)([^?#]*)", u or "") for k, u, _ in pages}
    spot = {k: (m[1].lower(), m[2]) if m else ("", "") for k, m in split.items()}
    out = {}
    for k, own in read.items():
        loose = [t for t, body in own if not body]
        least = min(spot[j][1] for j in read if read[j] == own and spot[j][0] == spot[k][0])
        here = (least, html_text.digest(own))
        sites = {html_text.digest(read[j]): j for j in read if spot[j][0] == spot[k][0] and any(not b for _, b in read[j])}
        order = sorted((min(spot[i][1] for i in read if read[i] == read[j] and spot[i][0] == spot[j][0]), d, j) for d, j in sites.items())
        before = [x for x in order if x[:2] < here][-1:]
        after = [x for x in order if x[:2] > here][:1]
        near = max(before + after, key=lambda x: html_text.shared_beginning(least, x[0]), default=None)
        gone = html_text.common(loose, [t for t, b in read[near[2]] if not b]) if near and loose else set()
        places = [i for i, (_, body) in enumerate(own) if not body]
        out[k] = "\n\n".join(t for i, (t, _) in enumerate(own) if i not in {places[g] for g in gone})
    return out


def test_differencing_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(250):
        parts = [f"<div>{x}</div>" for x in rng.choice(list("abcdef"), rng.integers(0, 6))]
        mark = "<article><p>body a</p>{}</article>" if k % 5 == 0 else "{}"
        rows.append((k, f"https://{rng.choice(['x.org', 'Y.net'])}/{rng.choice(['a', 'b'])}/{rng.integers(30)}?q={k}", mark.format("".join(parts))))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == brute_differences(rows)


def test_differencing(spark):
    page = "<div>Shared menu</div><div>Own {}</div><div>Shared foot</div>"
    rows = [(k, f"http://h.com/a/{k}", page.format(k)) for k in range(6)]
    rows += [(7, None, None), (8, "nonsense", ""), (9, "http://alone.org/", "<div>Only</div>"), (0, "http://h.com/a/0", page.format(0))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as _run")
    got = sorted((r.page_id, r.text) for r in html_text.main_text(df).collect())
    assert got == sorted([(0, "Own 0"), (7, ""), (8, ""), (9, "Only"), *[(k, f"Own {k}") for k in range(6)]])
    assert html_text.main_text(df.limit(0)).count() == 0


def test_registered_pages(spark):
    """Each page of the table marks one article; its text is cut out by hand here."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op8_html_extraction"](spark, SF).collect()}
    assert len(got) == len(pages)
    for r in pages:
        inner = re.sub(r"<script.*?</script>", "", r.html, flags=re.S).partition("<article>")[2].partition("</article>")[0]
        inner = re.sub(r"<footer>.*", "", inner, flags=re.S)
        inner = re.sub(r"<[^>]*$", "", inner)
        blocks = [re.sub(r"<[^>]*>", " " , x.replace("<b>", "")) for x in re.split(r"</?(?:p|h1)>", inner)]
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_kernel_of_small_texts():
    texts = ["der die das und ist", "the of and to in is", "der und nicht ein", "the and that with"]
    model = language.Kernel(texts, ["de", "en", "de", "en"], [True, True, False, False])
    rows = model.rows(texts)
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts[:2]]
    assert (rows[0] @ rows[1]) == len(grams[0] & grams[1]) and rows[0].sum() == len(grams[0])
    assert [model.langs[k] for k in model.values(["und die", "of that"]).argmax(axis=1)] == ["de", "en"]


def test_identify_awkward(spark, documents):
    got = language.identify(documents())
    rows = got.collect()
    assert len(rows) == documents().count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    assert {r.lang_pred for r in rows if r.doc_id in (10, 12)} == {"und"}
    assert language.identify(documents().limit(0)).count() == 0


def test_registered_language(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in QUERIES["op6_language_id"](spark, SF).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_toxicity_awkward(spark, documents):
    df = documents()
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(10, 21)], "doc_id bigint, toxic int")
    rows = toxicity.score(df, labels).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    assert toxicity.score(df.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score(df, labels.limit(0)).collect()} == {0.0}


def test_misspellings_share_vectors(spark):
    rng = np.random.default_rng(0)
    plain = ["tree", "house", "river", "stone", "cloud", "bread", "light", "water"]
    rows = [(k, " ".join(rng.choice(plain, 20)) + (" horrible" if k % 2 else " pleasant"), k % 2) for k in range(400)]
    rows += [(1000, "tree house horribble stone", None), (1001, "tree house pleasantt stone", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(df, df.select("doc_id", "toxic")).collect()}
    assert got[1000] > 0.7 > got[1001]


def test_registered_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op3_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    y, p = np.array([truth[r.doc_id] for r in rows]), np.array([r.predicted for r in rows])
    assert p[y == 1].mean() > 0.85 and y[p == 1].mean() > 0.85


def test_every_letter_counts_in_large_alphabets(monkeypatch):
    """N-grams of a thousand letters against sets of tuples, with crowded slots."""
    from plenum.llm import language

    monkeypatch.setattr(language, "SLOT_BITS", 10)
    rng = np.random.default_rng(4)
    letters = [chr(0x4E00 + k) for k in range(1000)] + list("aéß한글 ,1")
    texts = ["".join(rng.choice(letters, 400)) for _ in range(8)]
    spectrum = language.Spectrum(texts)
    known = set("".join(texts).lower())

    def grams(text):
        own = [c if c in known and c.isalpha() else "?" if c.isalpha() else None for c in text.lower()]
        return {tuple(own[k : k + n]) for n in (1, 2, 3) for k in range(len(own) - n + 1)}

    every = set().union(*map(grams, texts))
    assert spectrum.size == len(every) and len(spectrum.late) > 0
    for text in [texts[0], texts[1][:50] + "xyz 龥 , é", "", "é"]:
        row = np.zeros(spectrum.size + 1, np.float32)
        spectrum.presence(text, row)
        assert row.sum() == len(grams(text) & every)
