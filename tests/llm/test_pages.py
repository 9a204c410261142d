"""Main text, archives and URL filter."""

import gzip
import hashlib
import html as entities
import io
import re

import duckdb
import pytest

from ebbtide.llm import html, urls, warc
from ebbtide.llm.queries import OP4_SQL, OP9_SQL
from tests.llm.conftest import counted

PAGES = "/root/testdata/sf0.01/pages.parquet"
CLASHING = "page_id long, url string, html string, text int, n_chars int, c0 int, host int, path int, rule int, verdict int, _fit int, _first int, _digest int, score int"


@pytest.fixture(scope="module")
def model():
    return html.Model.fit(html.labelled_pages())


@pytest.fixture(scope="module")
def odd_pages(spark):
    long = "<p>" + "many words of one page. " * 6
    rows = [(1, "http://a.example.com/en/x?y", long), (2, "https://www.example.com/en/z#t", long), (3, "HTTP://B.NET/es/", f"{long}<a href='http://a.example.com/'>"),
            (None, "http://c.net/es/1", long), (None, None, None), (4, None, ""), (5, "no host", None), (5, "no host", None), (1, "http://a.example.com/en/x?y", long),
            (6, "ftp://", "short"), (7, "http://x.org/a", "short"), (8, "http://ünï.org/\n%0A%", "<p>é €</p>"), (9, "http://com/", "x" * 300_000)]
    return spark.createDataFrame([(*r, *range(11)) for r in rows], CLASHING).repartition(3)


CASES = {
    "": "", "only words, no markup": "only words, no markup", "<p>a &lt; b &amp; c&nbsp;d &eacute; &#8364;</p>": "a < b & c d é €",
    "<article><h1>T</h1><p>One.<p>Two <a href=x>link</a> more.<div class='ad'>Buy now.</div><form><p>Your name.</p></form><section id=comments><p>Great article, thanks for it.</p></section></article>": "T\nOne.\nTwo link more.",
    "<body><div class='cookie-notice'>We use cookies to improve.</div><main><h1>Title</h1><p>Short.</p><aside>See also</aside><p>Text that\n\t goes  on.</p></main><div id=sidebar><p>A long text in the sidebar that goes on.</p></div></body>": "Title\nShort.\nText that goes on.",
    "<article><p>a<script>if (1 < 2) '</p>'</script>b<!-- <p>no</p> -->c<br>d</article><footer>&copy; me</footer>": "abc d",
    "<ARTICLE><P>Loud.</P></ARTICLE><FOOTER>x</FOOTER>": "Loud.", "<article><p>the page ends in a tag <b class='": "the page ends in a tag",
    "<article><p>one</p><style>p{}</style><p>two": "one\ntwo", "<nav><ul><li><a href=/>Home</a></ul></nav>": "",
}


UNSEEN = {
    f"<article><p>{'İ' * 20}<script>var x = 1</SCRIPT></p><p>Hello world this is text.</p></article>": f"{'İ' * 20}\nHello world this is text.",
    "<article><p>One <button>Share</p><p>Two is a sentence.</p></article>": "One\nTwo is a sentence.",
    "<article><div><object data=x><p>old</div><p>Two is a sentence.</p></article>": "Two is a sentence.",
    "<article><p>One <svg><g><svg><text>a</text></svg><text>b</text></g></svg>two.</p></article>": "One two.",
    "<article><p>One <button><div>no</div><p>no</button>two.</p><p>Three is a sentence.</article>": "One two.\nThree is a sentence.",
    "<article><p>One.</p><a href=x><svg><path></a><p>Two is a sentence.</p></article>": "One.\nTwo is a sentence.",
    "<head><noscript><body><article><p>Two is a sentence.</p></article>": "Two is a sentence.",
}


@pytest.mark.parametrize("page", UNSEEN, ids=range(len(UNSEEN)))
def test_unseen_elements_end_where_they_should(model, page):
    assert model.text(page) == UNSEEN[page]


@pytest.mark.parametrize("page", CASES, ids=range(len(CASES)))
def test_main_text(model, page):
    assert model.text(page) == CASES[page]


def test_marginals_are_those_of_all_labellings(model):
    """Sum-product on a small tree equals adding up every labelling."""
    page = html.Page("<div class=post><h2>Hi</h2><p>Yes. <p>No</div><div class=menu><li>x</li></div>")
    n = len(page.kind)
    ratio = [sum(model.weight.get(f, 0.0) for f in found) for found in html.features(page)]
    brothers = [page.parent.count(p) for p in page.parent]
    total, mine = 0.0, [0.0] * n
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        weight = 1.0
        for i in range(n):
            weight *= html.exp(max(-30, min(30, ratio[i]))) if y[i] else 1.0
            if i:
                p = model.passes[brothers[i] > 1][0 if y[page.parent[i]] else 1]
                weight *= p if y[i] else 1 - p
        total += weight
        for i in range(n):
            mine[i] += weight * y[i]
    assert model.marginals(page) == pytest.approx([m / total for m in mine], rel=1e-6)


def test_held_out_labelled_pages(model):
    right = total = 0
    for page, leaves in html.labelled_pages(150, seed=91):
        belief = model.marginals(page)
        right += sum((belief[i] > 0.5) == (i in leaves) for i in page.text)
        total += len(page.text)
    assert right / total > 0.93


def test_pages_of_the_table(spark):
    def by_hand(page):
        inner = page.split("<article>", 1)[1].split("</article>")[0]
        parts = (" ".join(entities.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?p>|</?h1>", inner))
        return "\n".join(x for x in parts if x)

    pages = spark.read.parquet(PAGES)
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert got == {r.page_id: (t := by_hand(r.html), len(t)) for r in pages.collect()}


def test_extract_odd_pages(odd_pages):
    out = html.extract(odd_pages)
    assert out.columns == ["page_id", "url", "c0", "host", "path", "rule", "verdict", "_fit", "_first", "_digest", "score", "text", "n_chars"]
    rows = out.collect()
    assert len(rows) == odd_pages.count() and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.page_id in (4, 5)} == {""}
    assert html.extract(odd_pages.limit(0)).count() == 0


def duck(sql, pages):
    con = duckdb.connect()
    con.register("given", pages.select("page_id", "url", "html").toPandas())
    con.execute("CREATE TABLE pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM given")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    return names, done.fetchall()


def test_archives_of_odd_pages(spark, odd_pages):
    archives = warc.write(odd_pages, warc.archive_folder(spark), archive_bytes=500)
    assert archives.count() > 3 and archives.agg({"records": "sum"}).first()[0] == odd_pages.count()
    rows = warc.read(archives, with_payload=True).collect()
    names, want = duck(OP4_SQL, odd_pages)
    assert counted([tuple(getattr(r, n) for n in names) for r in rows]) == counted(want)
    whole = {hashlib.sha256((r.html or "").encode()).hexdigest(): (r.html or "").encode() for r in odd_pages.collect()}
    assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload) == whole[r.payload_digest] for r in rows)
    assert counted([(r.page_id, r.url) for r in rows]) == counted([(r.page_id, r.url) for r in odd_pages.collect()])
    assert warc.read(warc.write(odd_pages.limit(0), warc.archive_folder(spark))).count() == 0


def test_damage_is_found():
    text = b"payload " * 40_000
    one = warc.record("1", "http://x/", text, hashlib.sha256(text).hexdigest(), None, False)
    two = warc.record("2", None, text, hashlib.sha256(text).hexdigest(), "1", True)
    assert [r["record_type"] for r in warc.Reader(io.BytesIO(one + two))] == ["response", "revisit"]
    plain = gzip.decompress(one)
    for bad in (one[:-9], plain.replace(b"payload payload", b"payloaD payload", 1), plain.replace(b"Content-Length: ", b"Content-Length: 1", 1), plain[:-2], b"x" + plain,
                plain.replace(b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: sha256:0", 1)):
        data = bad if bad == one[:-9] else gzip.compress(bad)
        with pytest.raises((warc.Damaged, ValueError)):
            list(warc.Reader(io.BytesIO(data)))


def test_urls_of_odd_pages(odd_pages):
    names, want = duck(OP9_SQL, odd_pages)
    got = urls.judge(odd_pages).select(*names).collect()
    assert counted(got) == counted(want)
    assert urls.judge(odd_pages.limit(0)).count() == 0


def test_trust_and_distrust_follow_links(spark):
    def links(*to):
        return "".join(f'<a href="http://{t}/">' for t in to)

    # A blocked host, one that links to it, one that links to that one, one that trusted hosts link to, one that nobody knows.
    rows = [(1, "http://bad.net/es/", ""), (2, "http://near.org/", links("bad.net")), (3, "http://far.org/", links("near.org", "good.org", "good.org", "good.org")),
            (4, "http://t.com/", links("good.org")), (5, "http://good.org/", links("bad.net", *["t.com"] * 30)), (6, "http://alone.org/", "<a href='/en'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(pages, rounds=8).collect()}
    assert {k: got[k].verdict for k in got} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
    # Power iteration by hand, links against their direction, from the one blocked host.
    back = {"bad.net": {"near.org": 0.5, "good.org": 0.5}, "near.org": {"far.org": 1.0}, "good.org": {"far.org": 0.75, "t.com": 0.25}, "t.com": {"good.org": 1.0}}
    score = {"bad.net": 1.0}
    for _ in range(8):
        new = {"bad.net": 0.15}
        for a, s in score.items():
            for b, w in back.get(a, {}).items():
                new[b] = new.get(b, 0.0) + 0.85 * s * w
        score = new
    assert {r.host: r.distrust for r in got.values() if r.host in score} == pytest.approx(score)


def test_distrust_of_a_long_chain(spark):
    n = 12
    rows = [(0, "http://bad.net/es/", ""), (1, "http://h1.org/", '<a href="http://bad.net/">')]
    rows += [(i, f"http://h{i}.org/", f'<a href="http://h{i - 1}.org/">') for i in range(2, n + 1)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: 0.15 * 0.85 ** i for i in range(n + 1)}
    assert {i: r.distrust for i, r in got.items()} == pytest.approx(want, abs=1e-5)
    mean = sum(want.values()) / len(want)
    assert {i: r.verdict for i, r in got.items()} == {i: "block" if i == 0 or d > 0.5 * mean else "allow" for i, d in want.items()}
