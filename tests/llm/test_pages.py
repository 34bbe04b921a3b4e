import random
import re
from hashlib import sha1
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import htmlextract, warc

PAGE = '<html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div>@@<aside>side</aside><form><p>Search</p></form><footer>&copy; site</footer></body></html>'
KIND = "page_id long, url string, html string, host string, templates string, id string, text string, subtree int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", "i", "x", 1) for r in rows], KIND)


def text(html, templates=()):
    return htmlextract.Content(html).text(set(templates))


@pytest.mark.parametrize(
    "html,expected",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (PAGE.replace("@@", "<article><h1>Title</h1><p>One <b>two</b>\n three<p>four<br>five&nbsp;&#233;</article>"), "Title One two three four five é"),
        (PAGE.replace("@@", "<main><p>m</p></main>"), "m"),
        (PAGE.replace("@@", "<div><p>body text</p></div>"), "body text"),
        ("<article><p>a</p><section class='comments'><p>c</p></section><div id=AdBanner>x</div><p>b</p></article>", "a b"),
        ("<article>a</article><article class='comment'>c</article><article>b</article>", "a b"),
        ("<article><header><h1>T</h1></header>x<footer>y</footer></article>", "T x"),
        ("<p><b>bold<br><p>next", "bold next"),
        ("a < b <!-- <p>no</p> --> c <![CDATA[x]]>d", "a < b c d"),
        ("<p title='a>b' class=\"x>y\">t</p", "t"),
        ("<p>cut off &am", "cut off &am"),
        ("<p>cut off <a href='x", "cut off"),
        ("<ul><li>1<li>2<ul><li>3</ul></ul>", "1 2 3"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("</div></p>x</b>", "x"),
        ("<script>never closed <p>x", ""),
        ("<SCRIPT>x</SCRIPT><P>y</P>", "y"),
        ("<div hidden>h</div><div aria-hidden=true>h</div><div role=navigation>n</div>v", "v"),
        ("<article><p>load, header, shadow and badge</p><div class='headline badge shadowed'>kept</div></article>", "load, header, shadow and badge kept"),
    ],
)
def test_rules(html, expected):
    assert text(html) == expected


def test_deep_and_long_pages():
    assert text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert text("<b>" * 20_000 + "<p>x") == "x"
    assert text('x<a "' * 20_000) == "x"
    assert text("1 < 2 " * 20_000).split()[1] == "<"
    assert len(text("<article>" + "<p>word" * 50_000 + "</article>").split()) == 50_000


def test_deep_pages_hash_in_one_pass():
    import time

    for html in ("<div>" * 20_000 + "x" + "</div>" * 20_000, "<article>" + "<div>word" * 20_000 + "</article>"):
        content = htmlextract.Content(html)
        before = time.process_time()
        found = content.subtrees()
        assert time.process_time() - before < 2
        assert all(letters for *_, letters in found)


def test_templates_of_a_host(spark):
    rng = random.Random(1)
    own = lambda i: f"<p>own text {i} {rng.random()}</p>"
    rows = [(i, f"http://WWW.a.org:80/{i}", f"<body><div><p>Sign up for our weekly letter</p></div><div>{own(i)}</div></body>") for i in range(30)]
    rows += [(100 + i, f"https://b.org/{i}", f"<body><div><p>Sign up for our weekly letter</p></div>{own(i)}</body>") for i in range(2)]
    rows += [(200 + i, "http://c.org/x", "<body><div><p>The same page, copied</p></div></body>") for i in range(40)]
    rows += [(300 + i, f"http://d.org/{i}", f"<article>{own(i)}<p>A passage that articles share</p><div>Read more on our site</div></article>") for i in range(10)]
    found = {r["page_id"]: r["text"] for r in htmlextract.main_text(pages(spark, rows)).collect()}
    assert len(found) == len(rows)
    assert all("letter" not in found[i] and f"own text {i} " in found[i] for i in range(30))
    assert all("letter" in found[100 + i] for i in range(2)) and all(found[200 + i] == "The same page, copied" for i in range(40))
    assert all("share" in found[300 + i] and "Read more" not in found[300 + i] for i in range(10))


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "x", ""), (2, "not a url", "<p>a</p>"), (2, "not a url", "<p>a</p>"), (3, "http://h/%zz", "\x00<p>\x00b")]
    found = sorted(map(tuple, htmlextract.main_text(pages(spark, rows)).collect()), key=repr)
    assert found == sorted([(1, None, "", 0), (None, "x", "", 0), (2, "not a url", "a", 1), (2, "not a url", "a", 1), (3, "http://h/%zz", "\x00 \x00b", 4)], key=repr)
    assert htmlextract.main_text(pages(spark, [])).collect() == []


def test_loser_tree():
    rng = random.Random(3)
    for k in [0, 1, 2, 3, 5, 8, 13]:
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)
    a, b = [(1, "a"), (2, "a")], [(1, "b"), (2, "b")]
    assert list(warc.LoserTree([a, b], lambda x: x[0])) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]


def test_url_keys():
    cases = {"HTTP://www.Example.com:80/A?b=1#c": "com,example)/a?b=1", "https://m.example.org:8080": "org,example,m:8080)/", "nonsense": "nonsense", "": "", "http://[bad": "http://[bad"}
    assert {u: warc.url_key(u) for u in cases} == cases and warc.url_key(None) == ""


def page_rows():
    rng = random.Random(5)
    big = [f"<p>{'x' * 1000}{i}</p>" for i in range(4)]
    rows = [(i, f"http://h{i % 3}.org/{rng.randint(0, 9)}", rng.choice([*big, "small", f"own ü {i}", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 60])) for i in range(80)]
    return rows + [(500, None, None), (501, "u\r\nX: y", ""), (None, "http://n.org", big[0]), (None, "http://n.org", "only " * 400), (None, "http://n.org", "only " * 400), (502, "x", "long " * 400_000)]


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    at = str(tmp_path / "archives")
    df = pages(spark, rows).repartition(3)
    warc.write_archives(df, at, most=20_000)
    runs = warc.read_archives(spark, at)
    found = runs.collect()
    assert len({r["run"] for r in found}) > 3
    by = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    expected = []
    for i, u, h in rows:
        raw = (h or "").encode()
        ids = [x for x in by[h or ""] if x is not None]
        first = max(ids) if ids and len(raw) >= 1000 and len(by[h or ""]) > 1 else i
        expected.append((i, len(raw), sha1(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[n] for n in names) for r in found), key=repr) == sorted(expected, key=repr)
    merged = warc.merge_index(runs).withColumn("part", F.spark_partition_id()).collect()
    keys = [(r["url_key"], r["timestamp"], r["id"] is None, r["id"] or 0) for r in merged]
    assert keys == sorted(keys) and len(merged) == len(rows)
    assert sorted(map(tuple, (r[:-1] for r in merged)), key=repr) == sorted(map(tuple, found), key=repr)
    one = next(r for r in found if r["id"] == 502)
    content = open(one["run"].removeprefix("file:"), "rb").read()
    assert content[one["offset"] : one["offset"] + one["length"]].endswith(b"long long \r\n\r\n")


def test_capture_histories(spark, tmp_path):
    """Several captures of a URL come in the order of their times; records of rows that share an id, or have none, differ in theirs."""
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), f"http://h.org/{i % 3}", f"{i % 4} " * 800, f"2020-0{rng.randint(1, 9)}-03T00:00:0{i % 10}Z") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `at.time` string")
    for name, table in (("text", df), ("time", df.withColumn("at.time", F.to_timestamp("`at.time`")))):
        found = [r for r in warc.merge_index(warc.warc(table, date_col="at.time", path=str(tmp_path / name)), most=7).collect()]
        keys = [(r["url_key"], r["timestamp"], r["id"] is None, r["id"] or 0) for r in found]
        assert keys == sorted((warc.url_key(u), d, i is None, i or 0) for i, u, _, d in rows)
        archives = {path: open(path.removeprefix("file:"), "rb").read() for path in {r["run"] for r in found}}
        fields = [f for content in archives.values() for _, _, f, _ in warc.records(content)]
        assert len({f["warc-record-id"] for f in fields}) == len(rows)
        assert all(("warc-refers-to-target-uri" in f) == (f["warc-type"] == "revisit") for f in fields)


def test_merge_holds_columns_only():
    """Runs between two borders are merged in blocks of 5000 rows."""
    names = [c.split()[0] for c in warc.CAPTURE.split(", ")]
    rng = random.Random(7)
    rows = []
    for run in range(30):
        rows += [{"url_key": k, "timestamp": "t", "id": i, "run": f"r{run}", "seq": n, **dict.fromkeys(names[5:])} for n, (k, i) in enumerate(sorted((f"k{rng.randint(0, 50)}", rng.randint(0, 9)) for _ in range(400)))]
    whole = pa.Table.from_pylist(rows, pa.schema([(n, pa.int64() if n in ("id", "seq") else pa.string()) for n in names[:5]] + [(n, pa.string()) for n in names[5:]]))
    out = list(warc.merge(iter(whole.to_batches(max_chunksize=700))))
    assert [b.num_rows for b in out] == [5000, 5000, 2000]
    got = [tuple(r[c] for c in warc.ORDER) for b in out for r in b.to_pylist()]
    assert got == sorted(tuple(r[c] for c in warc.ORDER) for r in rows)
    assert list(warc.merge(iter([]))) == []


def test_warc_of_nothing(spark):
    assert warc.warc(pages(spark, [])).collect() == []


def test_a_damaged_archive_is_an_error():
    good = (warc.record("a/1", 1, "http://a", warc.DATE, "hi", "d", 2, False) + "\r\n\r\n").encode()
    assert [f["page-id"] for _, _, f, _ in warc.records(good * 2)] == ["1"] * 2
    with pytest.raises(ValueError):
        list(warc.records(good[:-6]))


@pytest.mark.parametrize(
    "html,expected",
    [
        ("<main><p>long text</p></main><aside><article class='card'>teaser</article></aside>", "long text"),
        ("<main><p>long text</p></main><div><article class='card'>teaser</article></div>", "long text"),
        ("<div><p>long text</p></div><div class='related'><article>teaser</article></div>", "long text"),
        ("<main><h1>T</h1><article>body</article><nav>n</nav></main>", "T body"),
        ("<main><nav>n</nav><article>body</article></main>", "body"),
        ("<main></main><article>body</article>", "body"),
        ("<div class='with-sidebar'><article>body</article></div>", "body"),
        ("<html><head><title>t</title><body><p>head never closed</p>", "head never closed"),
    ],
)
def test_teasers_are_not_the_main_text(html, expected):
    assert text(html) == expected


def test_templates_within_articles(spark):
    rng = random.Random(2)
    own = lambda i: f"<p>own text {i} {rng.random()} and {rng.random()} and {rng.random()} and {rng.random()}</p>"
    rest = "<p>Sign up for the letter</p><ul><li>Related one</ul><table><tr><td>Advert</table>"
    rows = [(i, f"http://a.org/s/{i}", f"<article>{own(i)}{rest if i % 10 else rest[:29]}</article>") for i in range(60)]
    rows += [(100 + i, f"http://b.org/s/{i}", f"<article>{own(i)}{'<p>Shared quote</p>' if i % 3 == 0 else ''}</article>") for i in range(90)]
    found = {r["page_id"]: r["text"] for r in htmlextract.main_text(pages(spark, rows)).collect()}
    assert all(f"own text {r[0] % 100} " in found[r[0]] for r in rows)
    assert not any(x in found[i] for i in range(60) for x in ("letter", "Related", "Advert"))
    assert all("Shared quote" in found[100 + i] for i in range(0, 90, 3))


def test_templates_of_a_large_host(spark):
    """The verdict about a box on nine pages doesn't change as the host grows."""
    rng = random.Random(4)
    own = lambda i: f"<p>own text {i} {rng.random()} and {rng.random()} and {rng.random()}</p>"
    rows = [(i, f"http://a.org/{i}", f"<body><div>{own(i)}</div>{'<div>Latest in this part</div>' if i < 9 else ''}</body>") for i in range(150)]
    rows += [(1000 + i, f"http://a.org/s/{i}", f"<body><div><p>{'copied ' * 40}</p></div><b>{i}</b></body>") for i in range(9)]
    found = {r["page_id"]: r["text"] for r in htmlextract.main_text(pages(spark, rows)).collect()}
    assert not any("Latest" in t for t in found.values()) and all(f"own text {i} " in found[i] for i in range(150))
    assert all("copied" in found[1000 + i] for i in range(9))


def scrambled(rng, i, parts):
    """A page without any tag or class that tells what it is."""
    name = lambda: f" class='{''.join(rng.choice('abcdefghij') for _ in range(6))}'"
    box = lambda x: f"<div{name()}>{x}</div>"
    return f"<html><body{name()}>{''.join(map(box, parts))}<script>track({i})</script></body></html>"


def scrambled_site(seed, n):
    """(page_id, url, html) and the articles of a host with three layouts, in which a few pages share a passage and one is copied."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    layouts = [("".join(f"<p>{text(2)}</p>" for _ in range(5)), text(9), f"<ul><li>{text(2)}<li>{text(3)}</ul>", text(12)) for _ in range(3)]
    shared, copied = text(20), [text(30), text(40)]
    rows, articles = [], {}
    for i in range(n):
        own = copied if i % 17 == 0 else [text(rng.randint(10, 40)) for _ in range(rng.randint(2, 5))]
        if i % 13 == 5:
            own = [*own, shared]
        head, ad, side, foot = rng.choice(layouts)
        body = "".join(f"<p>{x}</p>" for x in own)
        rows.append((i, f"http://s{seed}.org/{i}", scrambled(rng, i, [head, ad, body, side, foot])))
        articles[i] = " ".join(own)
    return rows, articles


def test_articles_without_any_telling_name(spark):
    rows, articles = scrambled_site(1, 120)
    for names in (True, False):
        found = {r["page_id"]: r["text"] for r in htmlextract.main_text(pages(spark, rows), names=names).collect()}
        assert found == articles


class Tree(HTMLParser):
    """A page by Python's own parser: elements as lists of tag, attributes and content."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.stack = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.stack[-1][2].append(node)
        if tag not in ("br", "meta"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        while self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        self.stack[-1][2].append(data)


BLOCKS = "div section nav aside footer header form p h1 h2 ul li table".split()
PARAS = "p h1 h2 li".split()


def by_hand(rows):
    """Texts by counting alone: (id, url, html) of well-formed pages to {id: text}, with none of the library's code."""
    plain = lambda x: " ".join(x.split())
    trees = {i: Tree(html).root for i, _, html in rows}

    def content(node, gone=()):
        if node[0] in ("script", "style", "head") or id(node) in gone:
            return " "
        inner = "".join(x if isinstance(x, str) else content(x, gone) for x in node[2])
        return f" {inner} " if node[0] in (*BLOCKS, "article", "body", "html", "br") else inner

    def shape(node, site):
        inner = "".join(plain(re.sub(re.escape(site), "", x, flags=re.I)) if isinstance(x, str) else shape(x, site) for x in node[2] if isinstance(x, str) or x[0] not in ("script", "style", "head"))
        return f"<{node[0]}>{inner}</>"

    seen, every, marks = {}, {}, {}
    for i, url, _ in rows:
        site, part = urlsplit(url).hostname, (re.match(r"https?://[^/]+/([^/?#]+)/", url) or [None, ""])[1]
        whole = plain(content(trees[i]))
        letters = lambda node: len("".join(content(node).split()))
        layout, outer = [], trees[i][2]
        while any(not isinstance(x, str) and x[0] in ("html", "body") for x in outer):
            outer = next(x for x in outer if not isinstance(x, str) and x[0] in ("html", "body"))[2]
        for x in outer:
            if not isinstance(x, str) and x[0] in (*BLOCKS, "article") and layout[-1:] != [x[0]]:
                layout.append(x[0])
        for scope in (site, (site, part)):
            every.setdefault(scope, set()).add(whole)

        def walk(node, place):
            of = {}
            for x in node[2]:
                if isinstance(x, str) or x[0] in ("script", "style", "head"):
                    continue
                of[x[0]] = of.get(x[0], 0) + 1
                here = () if x[0] in ("html", "body") and not place else (*place, x[0], of[x[0]])
                size = letters(x)
                if x[0] in BLOCKS and 0 < size and 3 * size <= 2 * letters(trees[i]):
                    keys = [(site, x[0] in PARAS), ((site, part), True)] if x[0] in PARAS else [(site, False)]
                    keys += [((*layout, here), None)] if x[0] not in PARAS and 3 * size <= letters(trees[i]) else []
                    for scope, kind in keys:
                        key = scope, kind, shape(x, site)
                        seen.setdefault(key, set()).add(whole)
                        marks.setdefault(i, []).append((key, id(x)))
                walk(x, here)

        walk(trees[i], ())
    many = {k for k, v in seen.items() if len(v) >= (5 if k[1] else 3) and (not k[1] or 2 * len(v) >= len(every[k[0]]))}
    return {i: plain(content(trees[i], {x for key, x in marks.get(i, []) if key in many})) for i in trees}


def small_sites(seed):
    """Sites of a few pages each that share their makers' layouts, and one large site; texts of their own, and passages that some share."""
    rng = random.Random(seed)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(n))
    menus, adverts, notes, shared = ([text(6) for _ in range(3)], [text(8) for _ in range(3)], [text(7) for _ in range(3)], text(30))
    rows, articles = [], {}
    for i in range(240):
        site = f"site{i % 60}.org" if i % 4 else "large.org"
        own = [text(rng.randint(20, 60)) for _ in range(rng.randint(2, 4))] + ([shared] if i % 9 == 0 else [])
        foot = f"(c) {site.title()} {rng.choice(notes)}"
        body = f"<nav><ul><li>{rng.choice(menus)}</li></ul></nav><div class='x'>{rng.choice(adverts)}</div><article>{''.join(f'<p>{x}</p>' for x in own)}</article><footer>{foot}</footer>"
        rows.append((i, f"https://{site}/{'news' if i % 2 else 'life'}/{i}", f"<html><head><title>t</title></head><body>{body}<script>x({i})</script></body></html>"))
        articles[i] = " ".join(own)
    return rows, articles


def test_recurrence_by_brute_force(spark):
    """Without the second rule: the text of each page against a parser and counts of the test's own."""
    rows, articles = small_sites(3)
    more = [(10**6 + i, u, h) for i, u, h in scrambled_site(2, 60)[0]]
    found = {r["page_id"]: r["text"] for r in htmlextract.main_text(pages(spark, rows + more), names=False).collect()}
    assert found == by_hand(rows + more)
    # Small sites are told by the layout that they share: what is around articles goes, and nothing of an article.
    assert sum(found[i] == articles[i] for i in articles) >= 0.95 * len(articles) and all(articles[i] in found[i] for i in articles)


def test_a_host_of_its_own_is_not_enough(spark):
    """With counts by layout out of reach, the same small sites keep what surrounds their articles."""
    rows, articles = small_sites(3)
    small = [r for r in rows if "large" not in r[1]]
    found = {r["page_id"]: r["text"] for r in htmlextract.main_text(pages(spark, small), names=False, least={htmlextract.POOLED: 10**9}).collect()}
    assert sum(found[i] == articles[i] for i, *_ in small) < 0.1 * len(small)


def test_articles_of_the_pages_by_counts_alone(spark, sf_dir):
    """Real pages, second rule off: most of what is around the articles goes, and nothing of them is lost but what recurs."""
    rows = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/pages.parquet").select("page_id", "url", "html")
    words = {r["page_id"]: (htmlextract.Content(a[0]).text(set()) if (a := re.findall("<article.*?</article>", r["html"], re.S)) else "", htmlextract.Content(r["html"], False).text(set())) for r in rows.collect()}
    found = {r["page_id"]: r["text"] for r in htmlextract.main_text(rows, names=False).collect()}
    around = sum(len(whole) - len(own) for own, whole in words.values())
    left = sum(max(0, len(found[i]) - len(own)) for i, (own, _) in words.items())
    lost = sum(max(0, len(own) - len(found[i])) for i, (own, _) in words.items())
    assert left <= 0.2 * around and lost <= 0.01 * sum(len(own) for own, _ in words.values())
    assert sum(words[i][0] in found[i] for i in found) >= 0.99 * len(found)


@pytest.mark.parametrize("attributes", ["class='social-history'", "class='ad-hoc'", "id='share-prices'", "class='notice-periods'", "class='related-work'", "class='comment-on-law'", "class='banner'", "class='Notice big'"])
def test_class_names_within_articles(spark, attributes):
    """What merely sounds like surroundings stays in an article, unless it recurs on the host under a name of that kind."""
    inner = lambda x: f"<article><h1>T</h1><p>One.</p><div {attributes}>{x}</div></article>"
    assert text(inner("own")) == "T One. own"
    rng = random.Random(4)
    rows = [(i, f"http://a.org/{i}", inner("told twice").replace("One.", f"One {rng.random()} and {rng.random()}")) for i in range(2)]
    found = [r["text"] for r in htmlextract.main_text(pages(spark, rows)).collect()]
    assert all(("told twice" in t) == (attributes not in ("class='banner'", "class='Notice big'")) for t in found)


def test_class_names_of_whole_pages():
    assert text("<div class='comment-on-law'>the text</div>") == "the text"
    assert text("<div class='related'>elsewhere</div><div class='story'>the text</div>") == "the text"
    assert text("<article>a<div class='comments'>c</div><div class='ad'>b</div><nav>n</nav><div role='navigation'>r</div></article>") == "a"
