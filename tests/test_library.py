import datetime
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from deskmill.functions import text as T
from deskmill.functions.html_region import Node, region
from deskmill.functions.urls import audit_links, normalize_url, og_image, og_meta, strip_links
from deskmill.functions.vectors import pack_vector, unpack_vector
from deskmill.operators import moderation as M
from deskmill.operators.chunking import chunk_text
from deskmill.operators.embed import batches_of, embed_chunks
from deskmill.operators.retrieval import assemble_context, source_urls
from deskmill.operators.records import humanize, labelled_text, validate_submissions
from deskmill.plans.registry import QUERIES
from deskmill.plans.views import view
from deskmill.sources.bundle import export_bundle, import_bundle, plan_import
from deskmill.sources.files import page_text, read_documents, rendered_text, sitemap_urls
from deskmill.sources.registry import register_chunk_function, register_source, source_texts
from deskmill.streaming import jobs

SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_gibberish_at_its_thresholds(spark):
    def judged(*texts):
        return one(spark, M.is_gibberish, *texts)

    assert judged("", " \n", None) == [True] * 3 and judged("q", "qq", "qqq") == [False] * 3
    # Vowels: 15 % and 85 % of six letters or more.
    word = lambda consonants, vowels: ("bcd" * 40)[:consonants] + ("aei" * 40)[:vowels]
    assert judged(*(word(5 - v, v) for v in range(6))) == [False] * 6
    assert judged(word(6, 0), word(6, 1), word(5, 1), word(1, 5), word(1, 6), word(0, 6)) == [True, True, False, False, True, True]
    # Consonants and equal letters in a row: seven and six.
    vowel = "aeio" * 3
    assert judged("a" + "bcdfgh" + vowel, "a" + "bcdfghj" + vowel) == [False, True]
    assert judged("bcd" + "o" * 5 + "bcdf", "bcd" + "o" * 6 + "bcdf") == [False, True]
    # Forty characters without a space, other scripts, numbers, and marks only.
    long = "banished" * 5
    assert judged(long[:39], long, long[:20] + " " + long[20:]) == [False, True, False]
    assert judged("жжжжжжжж", "1234 5678", "!!!!", "AB1 XYZ") == [False, False, True, False]


def test_durations(spark):
    assert one(spark, M.parse_duration, "", "0", "1h", "24h", "7d", "30d", "2w", "90", "forever", "perm", "5 m", "x", None) == [0, 0, 3600, 86400, 604800, 2592000, 1209600, 90, None, None, 300, 0, 0]


def test_smalltalk_and_stems(spark):
    assert one(spark, T.is_smalltalk, "Hi, thanks!", "", "?", "thanks for the door", "ok ok ok ok ok", "Čau") == [True, True, False, False, False, True]
    got = one(spark, T.stems, "Košice kosiciach", "doors", "Düsseldorf a RC2", None)
    assert got == [["kosic", "kosic"], ["doors"], ["dusse", "rc2"], []]


def test_text_cleaning(spark):
    assert one(spark, T.normalize_text, "<h2>T</h2>\n<p>x &amp; y</p>", "<ul><li>a<li>b</ul>", "plain &lt;b&gt;", None) == ["## T\n\nx & y", "- a\n- b", "plain <b>", None]
    assert one(spark, T.denoise, "A\r\nBack to top\r\na\nThe cookies we back to top use\n\n\n\nA\u00a0b\u200b", "\n \t\nx\n\n\nX\nx\rx\n\u2003y \x07z\n\n", "", None) == ["A\nThe cookies we back to top use\n\nA b", "x\n\nX\ny z", "", None]
    page = "<title>A &amp; <b>B</b></title>"
    assert one(spark, lambda x: T.page_title(x, F.lit("u")), page, "no", "<title></title>") == ["A & B", "u", ""]


def test_references_end_with_a_semicolon(spark):
    texts = ["a &amp b&&amp", "&amp;lt; &notit; &noSuch;", "&eacute;&NotEqualTilde;&#39;&#x1F600;&#128;&#0;&#13;&#xD800;&#99999999999;", "&", "", None, "x &#; &#x; é&"]
    assert one(spark, T.unescaped, *texts) == ["a &amp b&&amp", "&lt; &notit; &noSuch;", "é\u2242\u0338'\U0001f600&#128;&#0;&#13;&#xD800;&#99999999999;", "&", "", None, "x &#; &#x; é&"]
    assert one(spark, lambda x: T.page_title(x, F.lit("u")), "<title>cut&amp</title>") == ["cut&amp"]


def test_known_urls_of_repeated_pages(spark, tmp_path):
    rows = [(1, "http://a.org/x"), (5, "http://a.org/x"), (10, "http://a.org/y"), (3, "ftp://a.org")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["a4_add_urls"](spark, str(tmp_path)).collect()
    assert [(r.url, r.site_id) for r in got] == [("http://a.org/x", 1)]


def test_a_page_leaves_no_tree_behind():
    import gc

    gc.collect()
    gc.disable()
    try:
        region("<body><nav>up</nav><main>" + "<p>word <b>bold</b></p>" * 50 + "</main></body>")
        assert not any(isinstance(o, Node) for o in gc.get_objects())
    finally:
        gc.enable()


def test_region():
    nav = "<nav>menu</nav>"
    body = "word " * 30
    assert "menu" not in region(f"<body>{nav}<main>{nav}<p>{body}</p></main></body>") and body.strip() in region(f"<main>{body}</main>")
    assert region(f"<body>{nav}<div id='content'>{body}</div>other</body>").startswith('<div id="content">')
    assert "other" in region(f"<body><p>{body}</p>other</body>", selector=".none")
    kept = region(f"<body><div class='main-banner'>{body}</div></body>")
    assert body.strip() in kept  # near-total loss is undone
    assert region("  ") == "  " and "x" in region("<div data-a=\"v'w\">x" + body + "</div>", selector="[data-a]")
    assert region(f"<body><div class='a'><p>{body}</p></div></body>", "div.a p").startswith("<p>")


def chunks_of(spark, texts, size, overlap):
    """Chunks of each text; the frame has columns named like those of the result's workings."""
    df = spark.createDataFrame([(i, t, "b", "s") for i, t in enumerate(texts)], "id long, text string, block string, held string")
    out = {}
    for r in chunk_text(df, "text", size, overlap).orderBy("id", "position").collect():
        assert (r.block, r.held) == ("b", "s")
        out.setdefault(r.id, []).append((r.position, r.section, r.content))
    return [out.get(i, []) for i in range(len(texts))]


def test_chunks_golden(spark):
    a, b, c = "a" * 100, "b" * 200, "c" * 290
    texts = [
        f"{a}\n\n{b}",  # 302 characters with the gap: two chunks, the second with the tail of the first
        f"{a}\n\n{b[:198]}",  # 300: one chunk
        f"## One ##\n\n{a}\n\n### Two\nmore\n\n{b}\n\n# Three\n\n{c}",
        f"{a}\n\n{'x' * 301}\n\n{b}",  # a long block is cut on its own, no tail goes into it or out of it
        "w" * 160 + " " + "v" * 200,  # the last space in the second half ends a window
        "w" * 150 + " " + "v" * 200,  # a space at half the size doesn't
        "\U0001d11e" * 400,
        "# \n\n \n\n\t", None, "", " \n ", "#" * 7 + " no", "# in\none",
    ]
    got = chunks_of(spark, texts, 300, 50)
    assert got[0] == [(0, None, a), (1, None, a[:50] + "\n\n\n\n" + b)]
    assert got[1] == [(0, None, f"{a}\n\n{b[:198]}")]
    # A chunk has the section that was on when it began; a heading with more lines below it is none.
    first = f"## One ##\n\n{a}\n\n### Two\nmore"
    second = first[-50:] + f"\n\n\n\n{b}\n\n# Three"
    assert got[2] == [(0, "One ##", first), (1, "One ##", second), (2, "Three", second[-50:] + f"\n\n\n\n{c}")]
    assert got[3] == [(0, None, a), (1, None, "x" * 300), (2, None, "x" * 51), (3, None, b)]
    assert got[4] == [(0, None, "w" * 160), (1, None, "w" * 49 + " " + "v" * 200)]
    assert got[5] == [(0, None, "w" * 150 + " " + "v" * 149), (1, None, "v" * 101)]
    assert [len(x[2]) for x in got[6]] == [300, 150]
    assert got[7:] == [[(0, None, "#")], [], [], [], [(0, None, "####### no")], [(0, None, "# in\none")]]
    assert "Python" not in chunk_text(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().toString()


def test_chunks_of_random_and_long_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["w" * rng.randint(1, 9), "# Head\n\n", "\n\n", ". ", " "]) + rng.choice([" ", " ", "\n"]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += ["ab " * 100_000, "\n\n".join(f"block {i}" for i in range(20_000))]
    for size, overlap in ((300, 0), (300, 150), (500, 60)):
        for text, chunks in zip(texts, chunks_of(spark, texts, size, overlap)):
            assert [c[0] for c in chunks] == list(range(len(chunks)))
            assert all(0 < len(c[2]) <= size + overlap + 4 for c in chunks)
            if overlap == 0:  # nothing is lost, doubled or moved
                assert "".join("".join(c[2].split()) for c in chunks) == "".join(text.split())
            said = set(" ".join(c[2] for c in chunks).split())
            assert all(w in said for w in text.split())
    assert chunks_of(spark, ["a" * 1300], 0, None) == [[(0, None, "a" * 1200), (1, None, "a" * 250)]]
    register_chunk_function(spark)
    assert spark.sql("SELECT content FROM chunk_text('a b', 300, 10)").collect()[0][0] == "a b"
    spark.createDataFrame([(1, "one\n\ntwo"), (2, None)], "id long, text string").createOrReplaceTempView("some_texts")
    assert [tuple(r) for r in spark.sql("SELECT id, c.* FROM some_texts t, LATERAL chunk_text(t.text, 0, 10) c").collect()] == [(1, 0, None, "one\n\ntwo")]


def test_embedding_batches(spark):
    assert list(batches_of(["a"] * 5, 2, 100)) == [[0, 1], [2, 3], [4]]
    assert list(batches_of(["a", "b" * 9, "c"], 9, 5)) == [[0], [1], [2]]
    rows = embed_chunks(spark.createDataFrame([(1, "a b"), (2, None)], "id long, content string")).collect()
    assert abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-6 and len(rows[1].embedding) == 64


def test_vectors_round_trip(spark):
    df = spark.createDataFrame([(1, [0.5, -1.25], None), (2, None, "[1, 2.5]"), (3, None, None)], "id long, v array<float>, j string")
    got = df.select("id", unpack_vector(pack_vector(F.col("v")), F.col("j")).alias("u")).orderBy("id").collect()
    assert [list(r.u) for r in got] == [[0.5, -1.25], [1.0, 2.5], []]


def test_bundle_round_trip(spark, tmp_path):
    chunks = view(spark, SF, "chunks")
    elements = chunks.where("source_id % 7 <> 0").select(F.col("source_id").alias("id"), F.concat(F.lit("u"), F.col("source_id").cast("string")).alias("uid")).distinct()
    sites = view(spark, SF, "sites")
    report = export_bundle(chunks, sites.where("site_id < 4"), elements, str(tmp_path / "b"), "m", 64)
    plan = plan_import(spark, str(tmp_path / "b"), sites, elements, "m", 64)
    back, told = plan.chunks, plan.report
    want = chunks.where("source_id % 7 <> 0 AND (site_id IS NULL OR site_id < 4)").select("source_type", "source_id", "site_id", "content", "embedding")
    assert sorted(map(str, back.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r.kind: r.exported for r in report.collect()} == {r.kind: r.placed for r in told.collect()}
    lost = {r.source_type: r.n for r in chunks.where("site_id >= 4").groupBy("source_type").agg(F.count("*").alias("n")).collect()}
    assert {r.kind: r.dropped for r in report.collect() if r.dropped} == lost
    with pytest.raises(ValueError):
        plan_import(spark, str(tmp_path / "b"), sites, elements, "other", 64)


def test_bundle_import_into_a_table(spark, tmp_path):
    from deskmill.sources.chunks import read_chunks, write_chunks

    schema = "id long, source_type string, source_id long, site_id long, position int, content string, embedding array<float>"
    data = [(1, "entry", 1, None, 0, "one", [1.0]), (2, "entry", 1, 1, 1, "one b", None), (3, "entry", 2, 2, 0, "two", [2.0]), (4, "entry", 3, None, 0, "three", [3.0]), (5, "url", 4, 1, 0, "four", [4.0])]
    sites = spark.createDataFrame([(1, "en"), (2, "fr")], "site_id long, handle string")
    elements = spark.createDataFrame([(i, f"u{i}") for i in (1, 2, 3, 4)], "id long, uid string")
    export_bundle(spark.createDataFrame(data, schema), sites, elements, str(tmp_path / "b"), "m", 1)
    # Here the ids differ, one element and one site are missing.
    there = spark.createDataFrame([(11, "u1"), (12, "u2"), (14, "u4")], "id long, uid string")
    table = str(tmp_path / "t")
    old = [(9, "entry", 11, None, 0, "old", [9.0]), (9, "entry", 12, None, 0, "goes too", [9.0]), (9, "entry", 77, None, 0, "stays", [9.0])]
    write_chunks(spark.createDataFrame(old, schema), table, "overwrite", buckets=4)
    plan = plan_import(spark, str(tmp_path / "b"), sites.where("handle = 'en'").selectExpr("site_id + 5 AS site_id", "handle"), there, "m", 1)
    now = lambda: sorted((r.source_type, r.source_id, r.site_id or 0, r.content) for r in read_chunks(spark, table).collect())
    before = now()
    told = {r.kind: (r.placed, r.skipped, r.written, r.dropped) for r in import_bundle(table, plan, dry_run=True).collect()}
    assert told == {"entry": (2, 1, 2, 1), "url": (1, 0, 1, 0)} and now() == before
    for _ in range(2):
        assert {r.kind: (r.placed, r.skipped, r.written, r.dropped) for r in import_bundle(table, plan).collect()} == told
        assert now() == [("entry", 11, 0, "one"), ("entry", 11, 6, "one b"), ("entry", 77, 0, "stays"), ("url", 14, 6, "four")]


def test_files_and_sitemaps(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.pdf").write_text("x")
    (tmp_path / "c.md").write_text(" ")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>one &amp; two</w:t></w:p><w:p><w:t>three</w:t></w:p>")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error is None) for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("hello", True), "b.pdf": (None, False), "c.md": (None, False), "d.docx": ("one & two\nthree", True)}
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    maps = [("i", f"<sitemapindex {ns}><sitemap><loc>c1</loc></sitemap><sitemap><loc>bad</loc></sitemap></sitemapindex>"), ("c1", f"<urlset {ns}><url><loc>u1</loc></url><url><loc>u2</loc></url><url><loc>u1</loc></url></urlset>"), ("bad", "junk")]
    rows = sitemap_urls(spark.createDataFrame(maps, "sitemap_url string, xml string")).collect()
    assert sorted((r.sitemap_url, r.position, r.url) for r in rows) == [("c1", 1, "u1"), ("c1", 2, "u2"), ("i", 1, "u1"), ("i", 2, "u2")]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = page_text(pages, region=True).collect()
    assert len(rows) == pages.count() and all(r.text and "<" not in r.title for r in rows)


def test_pages_reach_python_a_few_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    pages = spark.range(2100).selectExpr("concat('u', id) AS url", "concat('<nav>up</nav><main>page ', id, '</main>') AS html").coalesce(1)
    for made in (lambda: page_text(pages, region=True), lambda: rendered_text(pages, pages, "url", "url", "url", [])):
        spark.conf.unset(name)
        made()
        assert int(spark.conf.get(name)) == 1000
    assert {(r.url, r.text) for r in page_text(pages, region=True).collect()} == {(f"u{i}", f"page {i}") for i in range(2100)}
    spark.conf.unset(name)


def test_rendered_records(spark):
    pages = spark.createDataFrame([("https://a.org/1", "<main><h2>Part</h2><p>Own &amp;lt;b&gt; words</p></main><footer>down</footer>"), ("https://a.org/2", "<nav>only chrome</nav>"), ("/3", "<p>not absolute</p>"), ("https://a.org/4", None)], "url string, html string")
    rows = [(1, " One ", "https://a.org/1", "red", "en"), (2, "Two", "https://a.org/2", "blue", ""), (3, "Three", "/3", None, None), (4, None, "https://a.org/4", "", "en"), (5, "Five", None, "green", "fr"), (1, "Again", "https://a.org/1", "x", None), (None, None, None, None, None)]
    records = spark.createDataFrame(rows, "id long, title string, url string, mainColour string, lang string")
    got = sorted(((r.id, r.text, r.rendered) for r in rendered_text(records, pages, "id", "title", "url", ["mainColour"], header={"Language": "lang"}).collect()), key=str)
    want = [
        (1, "Title: One\nURL: https://a.org/1\nLanguage: en\n\n## Part\nOwn <b> words", True),
        (1, "Title: Again\nURL: https://a.org/1\n\n## Part\nOwn <b> words", True),
        (2, "Title: Two\nURL: https://a.org/2\n\nMain Colour: blue", False),
        (3, "Title: Three", False),
        (4, "URL: https://a.org/4\nLanguage: en", False),
        (5, "Title: Five\nLanguage: fr\n\nMain Colour: green", False),
        (None, "", False),
    ]
    assert got == sorted(want, key=str)
    assert rendered_text(records.limit(0), pages, "id", "title", "url", ["lang"]).count() == 0
    assert rendered_text(records, pages.limit(0), "id", "title", "url", ["lang"]).where("rendered").count() == 0


def test_rendered_bodies_are_made_once(spark):
    pages = spark.createDataFrame([("https://a.org/1", "<p>x</p>")], "url string, html string")
    d = spark.createDataFrame([(1, "One", "https://a.org/1", "v")], "id long, title string, url string, f string")
    plan = rendered_text(d, pages, "id", "title", "url", ["f"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_related_fields(spark):
    option = "struct<label: string, value: string>"
    schema = f"id long, title string, kind {option}, tags array<{option}>, photos array<struct<alt: string, title: string>>, parts array<struct<title: string, size: double, more: array<struct<title: string>>, on: boolean>>, seo struct<description: string, text: string, code: int>, rows array<array<string>>, price double, live boolean, day date"
    row = (1, "T", (" ", "v1"), [("L", "l"), (None, "m"), (None, None), ("0", None)], [("a cat", "x"), (None, "DSC_6370"), ("", "A house"), (None, "p 20240101 1200")], [("Bolt", 2.0, [("deep",)], True), ("Bolt", None, None, None), (None, 2.5, [], False)], ("About", "About", 7), [["a", ""], ["b"], []], 649.0, True, datetime.date(2024, 2, 3))
    df = spark.createDataFrame([row, (2, None, *[None] * 9)], schema)
    fields = [c for c in df.columns if c not in ("id", "title")]
    got = {r.id: r.text for r in labelled_text(df, "id", "title", None, fields, name="Shop", excluded={"*": ("day",), "T": ("seo",), "U": ("price",)}, scope="title").collect()}
    want = ["Name: Shop\nTitle: T", "Kind: v1", "Tags:\nL\nm", "Photos:\na cat\nA house", "Parts:\nBolt\nSize: 2\nBolt\nSize: 2.5", "Rows:\na\nb", "Price: 649"]
    assert got == {1: "\n\n".join(want), 2: "Name: Shop"}
    assert "Seo: About\n\n" in labelled_text(df, "id", "title", None, fields).where("id = 1").first().text and "Day: 2024-02-03" in labelled_text(df, "id", "title", None, fields).first().text


def test_context_urls(spark):
    hits = spark.createDataFrame([(1, 2, "entry", 10, "A"), (1, 5, "url", 3, "B"), (1, 7, "file", 3, "C"), (2, 1, "category", 10, "D"), (2, 2, "entry", 11, "E"), (2, 3, "entry", 12, "F"), (2, 4, "url", 9, "G"), (2, 5, "entry", None, "H"), (2, 6, "url", 3, "I")], "query_id long, rank int, source_type string, source_id long, content string")
    tracked = spark.createDataFrame([("entry", 10, 1, 1), ("category", 10, 2, 1), ("entry", 11, 1, 2), ("entry", 12, 3, 1)], "source_type string, id long, element_id long, site_id long")
    elements = spark.createDataFrame([(1, 1, "live", None, "https://x.org/One/"), (1, 2, "disabled", None, "https://x.org/no"), (2, 1, "live", None, "/relative"), (3, 1, "live", datetime.datetime(2024, 1, 1), "https://x.org/gone")], "id long, site_id long, status string, date_deleted timestamp, url string")
    urls = spark.createDataFrame([(3, "http://Y.org/p/#top"), (9, "")], "id long, url string")
    got = {r.query_id: (r.context, r.allowed_urls) for r in assemble_context(source_urls(hits, tracked, elements, urls)).collect()}
    sep = "\n\n---\n\n"
    assert got[1] == (sep.join(["[1] (entry) URL: https://x.org/One/\nA", "[2] (url) URL: http://Y.org/p/#top\nB", "[3] (file)\nC"]), ["http://y.org/p", "https://x.org/One"])
    assert got[2] == (sep.join(["[1] (category)\nD", "[2] (entry)\nE", "[3] (entry)\nF", "[4] (url)\nG", "[5] (entry)\nH", "[6] (url) URL: http://Y.org/p/#top\nI"]), ["http://y.org/p"])


def test_urls(spark):
    assert one(spark, normalize_url, "HTTP://Ex.com:80/A/?q=1#f", "https://x.org/", "/rel/") == ["http://ex.com/A?q=1", "https://x.org", "/rel"]
    page = "<meta property='og:image' content='/i.png'><meta name=Author content=\"A &amp; B\"><meta property='og:image' content='second'>"
    assert one(spark, og_meta, page)[0] == {"og:image": "/i.png", "author": "A & B"}
    assert one(spark, lambda x: og_image(x, F.lit("https://h.com/p")), page, page.replace("/i.png", "//cdn/x")) == ["https://h.com/i.png", "https://cdn/x"]
    replies = spark.createDataFrame([(1, "see [a](http://me.com/ok/) and [b](http://me.com/no), http://me.com/no. or http://off.com/x")], "message_id long, reply string")
    allowed = spark.createDataFrame([(1, "http://me.com/ok")], "message_id long, url string")
    audited = audit_links(replies, allowed, ["me.com"])
    assert {(r.url, r.verdict) for r in audited.collect()} == {("http://me.com/ok/", "ok"), ("http://me.com/no", "denied"), ("http://off.com/x", "offsite")}
    assert strip_links(replies, audited).first().reply == "see [a](http://me.com/ok/) and b, . or http://off.com/x"


def test_records(spark):
    assert humanize("metaDescription") == "Meta Description" and humanize("some_field") == "Some field" and humanize("seoURL") == "Seo U R L"
    df = spark.createDataFrame([(1, "T", "https://u.org", "a\nb", None, 649)], "id long, title string, url string, bodyText string, none string, cena int")
    assert labelled_text(df, "id", "title", "url", ["bodyText", "none", "cena"]).first().text == "Title: T\nURL: https://u.org\n\nBody Text:\na\nb\n\nCena: 649"
    raw = spark.createDataFrame([(1, "f", '{"email":"bad","boxes":"a, b","src":"x","ok":"yes"}'), (2, "f", '{"email":"a@b.co","boxes":["z"],"ok":"off"}')], "id long, form_name string, payload string")
    fields = spark.createDataFrame([("f", "email", "email", True, None, None), ("f", "boxes", "checkboxes", False, ["a", "b"], None), ("f", "src", "hidden", False, None, "const"), ("f", "ok", "consent", True, None, None)], "form_name string, name string, type string, required boolean, options array<string>, value string")
    got = {r.id: (r["values"], r.missing, r.invalid) for r in validate_submissions(raw, fields).collect()}
    assert got[1] == ({"boxes": "a, b", "src": "const", "ok": "Yes"}, [], ["email"])
    assert got[2] == ({"email": "a@b.co", "src": "const"}, ["ok"], ["boxes"])


def test_custom_source(spark):
    items = spark.createDataFrame([(1, 1, "a"), (2, None, ""), (3, 1, "boom")], "item_id long, site_id long, title string")
    register_source("mine", items, lambda r: r["title"] if r["title"] != "boom" else 1 / 0)
    assert sorted((r.item_id, r.status) for r in source_texts("mine").collect()) == [(1, "indexed"), (2, "empty"), (3, "error")]
    with pytest.raises(ValueError):
        register_source("Bad Handle", items, str)


def test_rate_limit_against_brute_force(spark):
    rng = random.Random(1)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([0, 1, 5, 20])
        rows.append((i, rng.randrange(4), rng.randrange(2), t))
    df = spark.createDataFrame(rows, "id long, session long, ip long, s long").withColumn("ts", F.to_timestamp_ntz(F.timestamp_seconds("s")))
    accepted, want = [], {}
    for i, session, ip, t in rows:
        live = [a for a in accepted if a[3] >= t - 60]
        want[i] = sum(a[1] == session and a[2] == ip for a in live) < 3 and sum(a[2] == ip for a in live) < 9
        if want[i]:
            accepted.append((i, session, ip, t))
    got = {r.id: r.accepted for r in M.rate_limit(df, 60, 3).collect()}
    assert got == want


def run_stream(spark, df, job, path, mode="append"):
    df.repartition(3).write.parquet(path)
    stream = job(spark.readStream.schema(df.schema).parquet(path))
    name = "t" + path.rsplit("/", 1)[-1]
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams_equal_batch(spark, tmp_path):
    from deskmill.operators import conversations as C

    m = view(spark, SF, "messages")
    clicks = view(spark, SF, "clicks")
    got = run_stream(spark, clicks, jobs.stream_suggestions, str(tmp_path / "clicks"), "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, C.suggestion_stats(clicks).collect()))
    days = {r.date: r.messages for r in m.groupBy(F.to_date("date_created").alias("date")).agg(F.count("*").alias("messages")).collect()}
    got = {r.date: r.messages for r in run_stream(spark, m, lambda s: jobs.stream_activity(s, "1 hour"), str(tmp_path / "days"), "append")}
    assert set(got) == {d for d in days if d < max(days)}
    assert all(days[d] == n for d, n in got.items())


def test_chunk_table(spark, tmp_path):
    from deskmill.sources.chunks import read_chunks, write_chunks

    rows = [("url", 1, 2, 0, "abcde", [1.0, 0.5]), ("file", 1, None, 1, "", None)]
    c = spark.createDataFrame(rows, "source_type string, source_id long, site_id long, position int, content string, embedding array<float>")
    write_chunks(c, str(tmp_path / "t"))
    got = sorted((tuple(r) for r in read_chunks(spark, str(tmp_path / "t")).collect()), key=str)
    assert got == sorted([("url", 1, 2, 0, "abcde", 2, [1.0, 0.5]), ("file", 1, None, 1, "", 0, None)], key=str)
    write_chunks(c.limit(0), str(tmp_path / "t"))
    assert read_chunks(spark, str(tmp_path / "t")).count() == 2


def test_vectors_of_mixed_widths_and_two_sites(spark):
    from deskmill.operators import retrieval as R

    q = spark.createDataFrame([(1, None, "aa bb", [1.0, 0.0]), (2, -1, "aa", [0.0, 0.0, 1.0]), (3, 5, "aa bb", [1.0])], "query_id long, site_id long, text string, vector array<float>")
    c = spark.createDataFrame([(1, None, "aa aa bb", [1.0, 0.0, 1.0]), (2, 5, "aa cc", [2.0]), (3, -1, "bb", [0.0, 3.0, 4.0])], "id long, site_id long, content string, embedding array<float>")
    pairs = q.crossJoin(c.withColumnRenamed("site_id", "c_site")).where("site_id IS NULL OR c_site IS NULL OR site_id = c_site")
    want = sorted((r.query_id, r.id, round(r.s, 9)) for r in pairs.select("query_id", "id", R.cosine(F.col("vector"), F.col("embedding")).alias("s")).collect())
    got = sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in R.vector_topk(q, c).collect())
    assert got == want and (1, 1, 1.0) in got

    def bm25(scope, stems, chunk):
        import math

        texts = [x for x in (("aa aa bb", None), ("aa cc", 5), ("bb", -1)) if scope is None or x[1] in (None, scope)]
        average = sum(len(t.split()) for t, _ in texts) / len(texts)
        words, total = chunk.split(), 0.0
        for s in stems:
            df, tf = sum(s in t.split() for t, _ in texts), words.count(s)
            if tf:
                total += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
        return round(total, 9)

    got = {(r.query_id, r.chunk_id): round(r.bm25, 9) for r in R.scoped_bm25(R.lexical_candidates(q, c), q, c).collect()}
    assert got == {(1, 1): bm25(None, ["aa", "bb"], "aa aa bb"), (1, 2): bm25(None, ["aa", "bb"], "aa cc"), (1, 3): bm25(None, ["aa", "bb"], "bb"), (2, 1): bm25(-1, ["aa"], "aa aa bb"), (3, 1): bm25(5, ["aa", "bb"], "aa aa bb"), (3, 2): bm25(5, ["aa", "bb"], "aa cc")}


def test_bans_are_loaded_for_every_batch(spark, tmp_path):
    source, kept, bans = str(tmp_path / "in"), [], {"ips": ["1"]}
    schema = "id long, ip string"

    def load():
        return spark.createDataFrame([(ip, None) for ip in bans["ips"]], "ip string, expires_at timestamp")

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.stream_bans(stream, load, lambda batch, i: kept.extend(r.id for r in batch.collect()), str(tmp_path / "c")).awaitTermination()

    spark.createDataFrame([(1, "1"), (2, "2")], schema).write.parquet(source)
    run()
    bans["ips"] = ["2"]
    spark.createDataFrame([(3, "1"), (4, "2")], schema).write.mode("append").parquet(source)
    run()
    assert kept == [2, 3]


def test_index_totals(spark):
    from deskmill.operators.index import index_totals

    chunks = spark.createDataFrame([("[1.0]", None), ("[1.0]", b"x"), (None, b"x"), (None, None)], "vector_json string, vector binary")
    health = spark.createDataFrame([("entry", 1, "stale")], "kind string, id long, problem string")
    assert index_totals(health, chunks).first() == (1, 4, 1)
    assert index_totals(health.limit(0), chunks.limit(0)).first() == (0, 0, 0)


def test_repeated_lines_of_any_line_break(spark):
    texts = ["\r\n".join(["A  header of pages", f"one\t {i}", "", ""][j] for i in range(5) for j in range(4)), "\r".join(["a header of pages"] * 9), "\u2028".join(["a\u00a0header of pages", "a header  of pages"] * 5), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, T.strip_repeated_lines(df).collect()))
    assert got == {0: "\n\n".join(f"one {i}" for i in range(5)), 1: "\n".join(["a header of pages"] * 9), 2: "", 3: ""}


def test_bans_one_per_ip(spark):
    old = spark.sql("SELECT 'a' AS ip, TIMESTAMP_NTZ'2030-01-01 00:00:00' AS expires_at, TIMESTAMP_NTZ'2029-01-01 00:00:00' AS date_created")
    new = spark.sql("SELECT * FROM VALUES (' a ', NULL, TIMESTAMP_NTZ'2024-01-01 00:00:00'), ('b', TIMESTAMP_NTZ'2024-01-02 00:00:00', TIMESTAMP_NTZ'2024-01-01 00:00:00'), ('b', TIMESTAMP_NTZ'2024-01-03 00:00:00', TIMESTAMP_NTZ'2024-01-01 00:00:00'), (' ', NULL, TIMESTAMP_NTZ'2024-01-01 00:00:00'), (NULL, NULL, NULL) AS t(ip, expires_at, date_created)")
    bans = M.apply_bans(old, new)
    assert {r.ip: r.expires_at and r.expires_at.day for r in bans.collect()} == {"a": None, "b": 3}
    assert [r.ip for r in M.purge_expired(bans, F.expr("TIMESTAMP_NTZ'2024-01-03 00:00:00'")).orderBy("ip").collect()] == ["a", "b"]
    assert [r.ip for r in M.purge_expired(bans, F.expr("TIMESTAMP_NTZ'2024-01-03 00:00:01'")).collect()] == ["a"]


def test_ranks_over_ranges(spark):
    from deskmill.operators.conversations import ranked

    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    got = {(r.g, r.position): r.i for r in ranked(df, "g", F.col("x").desc_nulls_last(), F.col("i").asc()).collect()}
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[g, p + 1] for p in range(len(mine))] == [r[2] for r in mine]
    assert len(got) == len(rows) and ranked(df.limit(0), "g", F.col("i").asc()).count() == 0


def test_longest_base_and_blank_bases(spark):
    from deskmill.operators.conversations import resolve_site

    sites = spark.createDataFrame([(1, "http://a.com"), (2, "http://a.com/fr/"), (3, ""), (4, "/"), (5, None), (6, "http://a.com")], "site_id int, base_url string")
    df = spark.createDataFrame([(u,) for u in ("http://a.com/fr/x", "http://a.com/fr", "http://a.com", "http://a.co", "", None, "http://b.com", "http://a.com/fr/x")], "page string")
    got = [(r.page, r.site_id) for r in resolve_site(df, "page", sites).collect()]
    assert sorted(got, key=str) == sorted([("http://a.com/fr/x", 2), ("http://a.com/fr", 2), ("http://a.com", 1), ("http://a.co", None), ("", None), (None, None), ("http://b.com", None), ("http://a.com/fr/x", 2)], key=str)
    assert {r.site_id for r in resolve_site(df, "page", sites.limit(0)).collect()} == {None}


def test_rate_limit_is_the_last_reason(spark):
    rng = random.Random(8)
    texts = ["a real question", "x", "kkkkkkkkkkkkkk", "another question here"]
    rows = [(i, rng.randrange(3), rng.choice(["p", "q"]), i * 7, rng.choice(texts)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, session long, ip string, s int, content string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.reason for r in M.filter_and_limit(df, 60, 2, 2).collect()}
    sent = []
    for i, session, ip, at, text in rows:
        reason = {"x": "too_short", "kkkkkkkkkkkkkk": "gibberish"}.get(text)
        if reason is None:
            live = [m for m in sent if m[1] == ip and m[2] >= at - 60]
            if sum(m[0] == session for m in live) >= 2 or len(live) >= 4:
                reason = "rate_limit"
            else:
                sent.append((session, ip, at))
        assert got[i] == reason, (i, got[i], reason)
    assert "rate_limit" in got.values() and "rate_limit" not in {r.reason for r in M.filter_and_limit(df, 0, 2).collect()}
