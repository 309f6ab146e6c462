"""Operators of the text subpackage against plain rules, on small tables with awkward rows."""

import ipaddress
import hashlib
import math
import random
import sys

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark import cloudpickle

from obsflow.llm import bpe, chat, fingerprint, html_text, mixing, neardup, op3, op5, op6, op7, op9, op10, pii, quality, substrings, toxicity

cloudpickle.register_pickle_by_value(sys.modules[__name__])
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n, vocabulary=60):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=3, n=40):
    """Copies, near copies, shared passages, one source with a third of all, empty and null texts."""
    rnd = random.Random(seed)
    base, passage = words(rnd, 120, 500), words(rnd, 70, 500)
    out = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            t = base
        elif kind == 1:
            w = base.split()
            w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = words(rnd, 30) + "\n" + passage + " \t" + words(rnd, rnd.randrange(60))
        elif kind == 3:
            t = "same " * 130
        elif kind == 4:
            t = None if i % 3 else ""
        elif kind == 5:
            t = "  \n " if i % 2 else "One two"
        else:
            t = words(rnd, rnd.randrange(1, 300)).upper() + "\nline\nline\n ## $$ é 日本"
        out.append((i, t, rnd.choice(["en", "de", None]), "hot" if i % 3 == 0 else f"s{i % 5}", len(t or "")))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def encoding():
    v = bpe.Vocabulary(PATH, PATTERN)
    return v, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_equals_the_library(spark, docs, empty):
    _, enc = encoding()
    got = {r.doc_id: r for r in bpe.round_trip(docs.withColumnRenamed("lang", "n_tokens"), PATH, PATTERN).collect()}
    for i, t, *_ in corpus():
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(empty, PATH, PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert {r.doc_id: bytes(r.bytes) for r in back} == {i: (t or "").encode() for i, t, *_ in corpus()}


def test_bpe_appends_and_edits():
    v, enc = encoding()
    rnd = random.Random(1)
    letters = "ab'srelvtd  \n\t\x1c 1２é😀ü.,!?中文字  The the ing"
    for k in range(1500):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 40)))
        i = rnd.randrange(len(s) + 1)
        j, new = rnd.randrange(i, len(s) + 1), "".join(rnd.choice(letters) for _ in range(rnd.randrange(6)))
        if k % 3 == 0:
            i = j = len(s)
        changed, table = v.revise(s, v.table(s), i, j, new)
        assert changed == s[:i] + new + s[j:] and v.ids(table) == enc.encode_ordinary(changed)
    for _ in range(500):
        s = "".join(rnd.choice("thereingation") for _ in range(rnd.randrange(1, 200))).encode()
        i = rnd.randrange(len(s) + 1)
        piece, table = v.edit(s, v.extend(s, []), i, min(len(s), i + 3), b"th" * rnd.randrange(3))
        assert table == v.extend(piece, []) and v.walk(v.extend(s, [])) == v.merge(s)


def test_bpe_reencodes_rows(spark):
    _, enc = encoding()
    rows = [(1, "Hello wor", 9, 9, "ld's end"), (2, "one two three", 4, 7, None), (3, None, 5, 2, "x"), (4, "abc", -3, 99, "")]
    got = {r.doc_id: r for r in bpe.reencode(spark.createDataFrame(rows, "doc_id long, text string, start int, end int, new string"), PATH, PATTERN).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["Hello world's end", "one  three", "x", ""]
    assert all(r.ids == enc.encode_ordinary(r.text) for r in got.values())


def test_html_main_text():
    tree = html_text.trained()
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site name here</p></header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
    <div class="cookie-notice">We use cookies to improve your experience on this site, please accept.</div><div class='ad'>Buy &gt; now</div><!-- x --><article><header><h1>Title &amp; more</h1></header>
    <p><b>First line<br><p>Second   line with <a href="x>y">a link</a> in it.</p><div class="ad-slot">Advert text here</div><form><p>Your mail</p><input></form><script>var t="</p>";</script><p>Last &eacute;&nbsp;&#x41;</p>
    <div id="comments"><p>I liked it a lot, and everybody should read it more than once.</p></div></article><aside><p>Other things to read on another day of the week</p></aside><footer>&copy; me</footer></body>"""
    assert html_text.main_text(page, tree) == "Title & more\nFirst line\nSecond line with a link in it.\nLast é A"
    for odd in ["", "<", "<p", "<!-- open", "<script>x", "<a href='", "<p>" * 5000, "<div " + "x" * 50000]:
        html_text.main_text(odd, tree)


def test_html_named_pages_and_open_heads():
    tree = html_text.trained()
    rest = """<article><h1>Title</h1><p>The first paragraph of the article has more than a few words in it.</p>
    <p>The second paragraph of the article has as many.</p></article><aside><p>Other things to read</p></aside></body></html>"""
    want = "Title\nThe first paragraph of the article has more than a few words in it.\nThe second paragraph of the article has as many."
    for start in ("<html><head><title>T</title></head><body>", '<html><head></head><body class="home right-sidebar">', '<html><head></head><body class="single comments-open">',
                  '<html class="cookies"><head></head><body id="footer" role="dialog">', '<html><head></head><body style="display:none">',
                  '<html><head><meta charset=utf-8><title>T</title><link rel=x href=y><style>p{}</style><body>', "<html><head><title>T</title><script>x</script>", "<head><basefont size=2><noscript><p>n</p></noscript>"):
        assert html_text.main_text(start + rest, tree) == want, start
    # Text and tags that a head cannot hold end it as well.
    assert [b[0] for b in html_text.blocks("<head><title>T</title> text <b>of the page</b><p>More</p>")] == ["text of the page", "More"]
    assert [b[0] for b in html_text.blocks("<head><title>T</title> plain text")] == ["plain text"]
    assert html_text.blocks("<head><title>T</title>\n<meta name=a content=b>\n") == []


WRAPS = ['<div class="site has-sidebar">', '<div class="content-sidebar-wrap">', '<div class="page-with-comments">', '<div class="menu-open">', '<div class="social-post">', '<div class="share-page">', '<form action="x">', '<section id="login-teaser">']
ARTICLE = """<h1>Title of the page</h1><p>The first paragraph of the article has more than a few words in it.</p><p>The second paragraph of the article has as many.</p>"""


@pytest.mark.parametrize("wrap", WRAPS)
def test_html_wrappers_do_not_empty_a_page(wrap):
    tree = html_text.trained()
    want = "Title of the page\nThe first paragraph of the article has more than a few words in it.\nThe second paragraph of the article has as many."
    end = "</" + wrap[1:].split()[0] + ">"
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>%s<aside><p>Other things to read on another day</p></aside><footer>(c) me</footer></body></html>"
    assert html_text.main_text(page % f"{wrap}<article>{ARTICLE}</article>{end}", tree) == want
    assert html_text.main_text(page % f"<article>{wrap}{ARTICLE}{end}</article>", tree) == want
    # Without a marked main part a short title may go, the paragraphs stay.
    assert html_text.main_text(page % f"{wrap}<div>{ARTICLE}</div>{end}", tree).endswith(want.split("\n", 1)[1])


def test_html_links_and_comments():
    tree = html_text.trained()
    page = "<body><article><p><a href=x>Never closed<p>The second paragraph of the article has many more words than this.</p><p>See <a href=q>the whole report here</a></p></article>"
    assert html_text.main_text(page, tree).endswith("The second paragraph of the article has many more words than this.\nSee the whole report here")
    comments = "<section class=comments><article><p>" + "This comment is much longer than the text of the article. " * 9 + "</p></article></section>"
    assert html_text.main_text(f"<body><article>{ARTICLE}{comments}</article></body>", tree).endswith("has as many.")


def test_html_text_of_the_table_by_a_plain_reader():
    """A second opinion on the synthetic pages: leaf blocks read with the standard parser, without what the tags and names say is no text."""
    import pyarrow.parquet as pq
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.said, self.depth, self.skip = [], 0, 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.skip += 1

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.skip -= 1

        def handle_data(self, data):
            if not self.skip:
                self.said.append(data)

    tree = html_text.trained()
    for source in pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()[:500]:
        reader = Reader()
        reader.feed(source or "")
        every = " ".join(" ".join(reader.said).split())
        text = html_text.main_text(source or "", tree)
        # Whatever is kept stands in the page in this order; pages with an article keep some of it.
        at = 0
        for line in text.split("\n"):
            at = every.replace(" ", "").find(line.replace(" ", ""), at)
            assert at >= 0
        assert text or "<p" not in (source or "")


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>One</p></article>"), (1, "u", None), (2, None, "")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extracted(pages).collect()) == [(1, "", 0), (1, "One", 3), (2, "", 0)]
    assert html_text.page_blocks(pages).count() == 1


def test_pii_formats():
    key = b"k"
    text = "pay 4111 1111 1111 1111 not 4111111111111112 on 2024-02-29, DE89 3704 0044 0532 0130 00 a.b@Mail7.example.com 123-45-6789 +49 (030) 1234-567 10.1.200.3 999.1.1.1 v1.2.3"
    new, found = pii.pseudonymise(text, key)
    assert len(new) == len(text) and {k for k, _ in found} == {"card", "date", "iban", "email", "ssn", "phone", "ip"}
    assert all(x in new for x in ("4111111111111112", "999.1.1.1", "v1.2.3")) and not any(x in new for x in ("4111 1111", "2024-02-29", "a.b@", "10.1.200.3"))
    card = next(v for k, v in found if k == "card")
    assert pii.luhn(card.replace(" ", ""))
    assert pii.pseudonymise(text, key) == (new, found) and pii.pseudonymise(text, b"other")[0] != new
    assert pii.pseudonymise("x a.b@mail7.example.com", key)[1][0][1].lower() == next(v for k, v in found if k == "email").lower()
    for size in (2, 10, 100, 2600):
        assert sorted(pii.permute(v, size, key, b"t") for v in range(size)) == list(range(size))
    dates = {pii._date(f"20{y:02d}-{m:02d}-11", key) for y in range(40) for m in range(1, 13)}
    assert len(dates) == 480


def test_pii_forms_of_dates():
    key = b"k"

    def day(text, **kw):
        new, found = pii.pseudonymise(text, key, **kw)
        assert found == [("date", new.removesuffix("T10:00:00Z"))] and new != text, text
        return new

    year, month, date = day("2024-12-31").split("-")
    m, d = str(int(month)), str(int(date))
    assert int(date) > 12
    for given, want in (("31/12/2024", f"{date}/{month}/{year}"), ("12/31/2024", f"{month}/{date}/{year}"), ("31-12-2024", f"{date}-{month}-{year}"), ("31.12.2024", f"{date}.{month}.{year}"),
                        ("2024/12/31", f"{year}/{month}/{date}"), ("2024-12-31T10:00:00Z", f"{year}-{month}-{date}T10:00:00Z")):
        assert day(given) == want
    year, month, date = day("2024-01-05").split("-")
    m, d = str(int(month)), str(int(date))
    en = pii._MONTHS[0][1][0][int(m) - 1].capitalize()
    de, fr, es = (next(x[1][0][int(m) - 1] for x in pii._MONTHS if x[0] == lang) for lang in ("de", "fr", "es"))
    for given, want in (("5.1.2024", f"{d}.{m}.{year}"), ("1/5/2024", f"{m}/{d}/{year}"), ("5 January 2024", f"{d} {en} {year}"), ("January 5, 2024", f"{en} {d}, {year}"),
                        ("5. Januar 2024", f"{d}. {de.capitalize()} {year}"), ("5 janvier 2024", f"{d} {fr} {year}"), ("5 de enero de 2024", f"{d} de {es} de {year}")):
        assert day(given) == want
    # Both numbers 12 or less: the month comes first, or the day for the whole corpus.
    assert day("01/05/2024") == f"{month}/{date}/{year}" and day("05/01/2024", day_first=True) == f"{date}/{month}/{year}" and day("12/31/2024", day_first=True) == day("12/31/2024")
    assert pii.pseudonymise("32/13/2024 31.2.2024 30 February 2024 2024-13-01", key)[1] == []
    every = [f"{a:02d}/{b:02d}/2024" for a in range(1, 32) for b in range(1, 32) if min(a, b) <= 12 and max(a, b) <= 28]
    for first in (False, True):
        assert len({day(v, day_first=first) for v in every}) == len(every)


def test_pii_numbers_of_other_countries():
    key = b"k"
    for text in ("+4915112345678", "+33 6 12 34 56 78", "06 12 34 56 78", "030 1234567", "555 123 4567", "0612345678", "0049 151 12345678", "612 34 56 78"):
        new, found = pii.pseudonymise(f"call {text}, or", key)
        assert [k for k, _ in found] == ["phone"] and new == f"call {found[0][1]}, or" and found[0][1] != text, text
        assert "".join("9" if c.isdigit() else c for c in found[0][1]) == "".join("9" if c.isdigit() else c for c in text)
    digits = lambda text: "".join(c for c in pii.pseudonymise(text, key)[0] if c.isdigit())
    assert digits("+4915112345678") == digits("+49 151 12345678") == digits("0049 151 12345678").removeprefix("00") and digits("+4915112345678").startswith("49")
    assert pii.pseudonymise("+49 (0)30 1234567", key)[0].replace("(0)", "") == pii.pseudonymise("+49 30 1234567", key)[0]
    assert pii.pseudonymise("1,000 200 3000 and 01.02.24 12:30 and 0.612345678", key)[1] == []


def test_pii_ip6():
    key = b"k"
    new, found = pii.pseudonymise("from 2001:db8::1, 2001:0DB8:0000:0000:0000:0000:0000:0001 and fe80::1%eth0", key)
    assert [k for k, _ in found] == ["ip6"] * 3 and "2001" not in new
    a, b, c = (ipaddress.IPv6Address(v) for _, v in found)
    assert a == b != c and "::" in found[0][1] and len(found[1][1]) == 39
    assert pii.pseudonymise("::1 12:30:45 0a:bb:cc:dd:ee:ff std::vector 1::2::3", key)[1] == []


def test_pii_keys_count_as_a_whole(spark):
    text = "card 4111 1111 1111 1111, mail a.b@mail7.example.com"
    assert pii.pseudonymise(text, b"k" * 64 + b"1")[0] != pii.pseudonymise(text, b"k" * 64 + b"2")[0]
    spark.conf.unset(op3.KEY)
    drawn = op3.key(spark)
    assert len(drawn) == 64 and op3.key(spark) == drawn


def test_pii_rows(spark):
    d = spark.createDataFrame([(1, "mail x.12@mail1.example.com", "a"), (2, None, "b"), (3, "", "c"), (4, "again x.12@mail1.example.com !", "d")], "doc_id long, text string, values string")
    done = pii.pseudonymised(d, "k")
    got = {r.doc_id: r for r in done.collect()}
    assert got[2].text is None and got[3].text == "" and got[2].n_values == 0
    assert got[1]["values"][0].pseudonym == got[4]["values"][0].pseudonym and got[1].text.endswith(got[1]["values"][0].pseudonym)
    assert [tuple(r)[2:] for r in pii.linked_values(done).collect()] == [(2, 1)]


def test_fingerprints(spark, docs, empty):
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    texts = {i: t or "" for i, t, *_ in corpus()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprint._Print(t).value and r.edited_fingerprint == fingerprint._Print(edited).value
        assert r.near_edited == fingerprint.likeness(r.fingerprint, r.edited_fingerprint) and (r.near_edited == 1) >= (t == edited)
        assert r.common_prefix == next((p for p, (x, y) in enumerate(zip(t, edited, strict=False)) if x != y), min(len(t), len(edited)))
    assert len({r.fingerprint for r in rows.values()}) == len(set(texts.values()))
    assert fingerprint.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(1, "abcd"), (1, "abcd"), (None, "zz")], "doc_id long, text string")
    assert sorted(r.n_chars for r in fingerprint.fingerprints(one).collect()) == [2, 4, 4]


def test_prefix_hashes():
    rnd = random.Random(2)
    a = "".join(rnd.choice("ab") for _ in range(300))
    b = "x" + a[40:200] + "y" + a[:50]
    x, y = fingerprint.PrefixHashes(a), fingerprint.PrefixHashes(b)
    for _ in range(200):
        i, j, n = rnd.randrange(250), rnd.randrange(150), rnd.randrange(1, 50)
        assert x.equal(i, y, j, n) == (a[i:i + n] == b[j:j + n])
        e = x.extension(i, y, j)
        assert a[i:i + e] == b[j:j + e] and (i + e == len(a) or j + e == len(b) or a[i + e] != b[j + e])


def test_quality_counts_and_cutoffs(spark, docs, empty, tmp_path):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (99, 1)], "doc_id long, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.rule_verdicts(docs, labels)
    assert oracle(op5.SQL, tmp_path, "documents", "labels") == rows_of(got)
    assert quality.rule_verdicts(empty, labels).count() == 0
    assert quality.rule_verdicts(docs, labels.limit(0)).filter("kept <> (not base_failed)").isEmpty()


def test_binomial_tail(spark):
    pairs = [(n, k) for n in (1, 5, 20, 100, 3000) for k in (0, 1, 2, 5, 20, 60) if k <= n]
    d = spark.createDataFrame(pairs, "n long, k long")
    for r in d.withColumn("p", quality.binomial_tail(d.n, d.k, 0.025)).collect():
        want = sum(math.comb(r.n, j) * 0.025 ** j * 0.975 ** (r.n - j) for j in range(r.k + 1)) if r.k < r.n * 0.025 else 1
        assert r.p == pytest.approx(want, rel=1e-7)


def test_certified_cutoffs_are_used(spark):
    """4,000 good documents without symbols and 1,000 bad ones with many: the rule is certified, and keeps all good ones."""
    held = spark.range(5000).selectExpr("'en' AS stratum", "id < 4000 AS good", "100L AS n_words", "500L AS word_chars", "IF(id < 4000, IF(id < 20, 60L, 0L), 100L) AS n_symbols", "1L AS n_lines", "0L AS n_dup_lines", "0L AS n_repeat_words")
    r = quality.cutoffs(held).first()
    assert r.cut_symbols == 120 and r.cut_dup_lines is None and r.cut_repeat_words is None


def rows_of(df):
    names = sorted(df.columns)
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)


def oracle(sql, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(r[i] for i in order) for r in cur.fetchall()], key=repr)


def test_near_duplicates(spark, docs, empty, tmp_path):
    texts = {i: t for i, t, *_ in corpus()}
    for k in (4, 5):
        got = {r.doc_id: r for r in neardup.near_duplicates(docs, words=k).collect()}
        want = neardup.components_by_rule(texts, k)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.component_id == i) for i, r in got.items())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert oracle(op6.SQL, tmp_path, "documents") == rows_of(neardup.near_duplicates(docs, words=4))
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """More near copies of one text than a leaf or a group holds, some linked to few others."""
    rnd = random.Random(9)
    base = words(rnd, 80, 2000).split()
    texts = {}
    for i in range(160):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 5, 8])):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10000)}"
        texts[i] = " ".join(w)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = neardup.components_by_rule(texts, 4)
    for leaf, group in ((24, 4096), (3, 40)):
        monkeypatch.setattr(neardup, "LEAF", leaf)
        monkeypatch.setattr(neardup, "GROUP", group)
        monkeypatch.setattr(neardup, "DEPTH", 6)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(d, words=4).collect()}
        assert got == want


def test_near_duplicate_rows_with_odd_ids(spark):
    t = words(random.Random(4), 60, 300)
    d = spark.createDataFrame([(7, t, 1), (7, t, 1), (7, "other text of few words", 2), (None, t, 3), (9, t, 4), (3, "", 5)], "doc_id long, text string, component long")
    got = sorted([(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(d).collect()], key=str)
    assert got == sorted([(7, 7, True), (7, 7, True), (7, 7, True), (None, None, True), (9, 7, False), (3, 3, True)], key=str)
    kept = neardup.deduplicated(d)
    assert kept.columns == d.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "7", "7", "None"]


def test_substrings(spark, docs, empty, tmp_path, monkeypatch):
    texts = {i: t for i, t, *_ in corpus()}
    for width, shared in ((50, 500), (50, 2), (5, 1)):
        monkeypatch.setattr(substrings, "SHARED", shared)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(substrings.remove_repeats(docs, width=width)).collect()}
        assert got == substrings.removed_by_rule(texts, width)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert oracle(op7.SQL, tmp_path, "documents") == rows_of(substrings.digest(substrings.remove_repeats(docs)))
    assert substrings.remove_repeats(empty).count() == 0
    odd = spark.createDataFrame([(1, "a " * 60), (None, "a " * 60), (1, "a " * 60), (2, "a " * 60)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substrings.remove_repeats(odd).collect()) == [("1", 0), ("1", 0), ("2", 60), ("None", 0)]


def test_substrings_of_any_id(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARED", 1)
    text = " ".join(f"w{i}" for i in range(60))
    ids = [-2**63, -2**31 - 1, -7, -1, 5, 2**31, 2**40 + 3, 2**63 - 1]
    d = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(d).collect()} == {i: 60 * (i > ids[0]) for i in ids}


def test_toxicity_learns_words_and_beginnings(spark, empty):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        t = words(rnd, rnd.randrange(20, 80), 300).replace("w", "v")
        t = " ".join(f"x{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}b" for _ in t.split())
        if toxic:
            t += " Nasty!!" if i % 12 else f" grim{chr(97 + rnd.randrange(26))}st and"
        rows.append((i, t, "en", "s", 0))
        if i < 500:
            labels.append((i, 1 if i % 5 else 0, int(toxic)))
    d = spark.createDataFrame(rows + [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "NASTY", "en", "s", 0)], DOCS)
    lab = spark.createDataFrame(labels + [(2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(d, lab).collect()}
    new = [i for i in range(500, 600)]
    assert sum(got[i].rejected != (i % 6 == 0) for i in new) <= 1 and got[1002].rejected
    assert got[1000].p_toxic is None and not got[1000].rejected and not got[1001].rejected
    assert toxicity.without_toxic(d, lab).columns == d.columns
    assert toxicity.scored(d, lab.limit(0)).filter("rejected").isEmpty() and toxicity.scored(empty, lab).count() == 0


def messages(spark):
    rows = [(1, 0, "user", "Hello there\nHow do you do"), (1, 1, "assistant", "> hello   THERE\nI am fine"), (1, 2, "user", "Other topic\n\nentirely"),
            (1, 3, "assistant", "> I am fine\n>> Hello there\ngood\n"), (1, 4, "user", "> Other topic\n> \n> entirely\nyes"), (1, 5, "x", "> good\nhm\n> other topic\nq"),
            (1, 6, "user", "> never said\nz"), (2, 0, None, None), (2, 1, "user", "> Hello there\nz"), (None, 1, "user", "> a"), (3, None, "user", "")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_reply_order(spark, tmp_path):
    m = messages(spark)
    got = chat.reply_ordered(m.withColumn("body", m.role))
    first = [(r.turn, r.parent_turn, r.reply_path, r.n_quoted, r.body) for r in got.filter("conv_id = 1").collect()]
    assert first == [(0, None, "0", 0, "Hello there\nHow do you do"), (1, 0, "0/1", 1, "I am fine"), (3, 1, "0/1/3", 2, "good"), (5, 3, "0/1/3/5", 2, "hm\nq"),
                     (2, None, "2", 0, "Other topic\n\nentirely"), (4, 2, "2/4", 3, "yes"), (6, None, "6", 1, "z")]
    assert got.count() == 11 and got.filter("conv_id = 2 and turn = 1").first().parent_turn is None
    m.filter("conv_id is not null and turn is not null").write.parquet(str(tmp_path / "conversations.parquet"))
    assert oracle(op9.SQL, tmp_path, "conversations") == rows_of(chat.reply_ordered(m.filter("conv_id is not null and turn is not null")))
    assert chat.reply_ordered(m.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, 0, "u", "line 0")] + [(1, i, "u", f"> line {i - 1}\nline {i}") for i in range(1, 40)]
    got = chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert got[-1].reply_path == "/".join(map(str, range(40)))


def test_mixing(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert oracle(op10.SQL, tmp_path, "documents") == rows_of(mixing.mixed(docs))
    assert mixing.mixed(empty).count() == 0
    kept = mixing.sampled(docs.withColumn("topic", docs.lang), share=0.6)
    assert kept.columns == [*docs.columns, "topic"] and 0 < kept.count() < 40


def test_mixing_conflicts_columns_and_ties(spark, docs):
    cells = spark.createDataFrame([(f"s{i}", "xy"[i % 2], 10 + i) for i in range(20)], "source string, lang string, tokens long")
    targets = mixing.tempered(cells, ["source", "lang"], 0.5)
    done = mixing.raked(cells, targets, ["source", "lang"])
    report = mixing.margin_report(done, ["source", "lang"]).collect()
    # One language a source: both margins can't be met, and the report says by how much.
    assert done.first().margin_error > mixing.TOLERANCE and max(r.error for r in report) == pytest.approx(done.first().margin_error) and len(report) == 22
    odd = docs.withColumns({"_cell_probability": docs.lang, "_CELL_source": docs.lang})
    assert mixing.sampled(odd, share=0.6).columns == odd.columns
    by = mixing.mixed(docs, topic_of=docs.lang).collect()
    assert {r.topic for r in by} == {"en", "de", None}
    for share in (0.0, 0.3, 1.0):
        p = mixing.calibrated(spark.createDataFrame([("a", 10, 40.0, 100.0), ("b", 90, 60.0, 100.0), ("c", 0, 0.0, 100.0)], "source string, tokens long, raked double, total double"), share).collect()
        assert sum(r.probability * r.tokens for r in p) == pytest.approx(100 * share)


def test_raked_margins_meet_their_targets(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 50), ("b", "y", 10), ("c", "y", 0)], "source string, lang string, tokens long")
    targets = spark.createDataFrame([("source", "a", 0.5), ("source", "b", 0.5), ("source", "c", 0.0), ("lang", "x", 0.7), ("lang", "y", 0.3)], "margin string, value string, share double")
    r = mixing.raked(cells, targets, ["source", "lang"]).collect()
    for of, value, share in (("source", "a", 0.5), ("source", "b", 0.5), ("lang", "x", 0.7), ("lang", "y", 0.3)):
        assert sum(x.raked for x in r if x[of] == value) == pytest.approx(100 * share, abs=1e-6)
    assert max(x.margin_error for x in r) <= mixing.TOLERANCE
    p = mixing.calibrated(spark.createDataFrame(r), 0.5).collect()
    assert sum(x.probability * x.tokens for x in p) == pytest.approx(50) and all(0 <= x.probability <= 1 for x in p)
