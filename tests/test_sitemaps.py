from deskmill.sources.files import sitemap_urls


def test_three_levels_cycles_and_bad_children(spark):
    def index(*names):
        return "<sitemapindex>" + "".join(f"<sitemap><loc> {n} </loc></sitemap>" for n in names) + "</sitemapindex>"

    def urls(*names):
        return "<s:urlset xmlns:s='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<s:url><s:loc>{n}</s:loc><s:priority>1</s:priority></s:url>" for n in names) + "</s:urlset>"

    both = "<m><url><loc>own</loc></url><sitemap><loc>leaf2</loc></sitemap><url><loc>a</loc></url></m>"
    data = [("top", index("gone", "bad", "mid", "leaf1", "")), ("mid", index("low", "top", "mid")), ("low", both), ("leaf1", urls("c", "a&amp;b")), ("leaf2", urls("a", "", "b", "a")), ("bad", "<urlset><url><loc>x</loc>"), ("none", None), ("text", "no xml <loc"), ("empty", "<urlset/>")]
    df = spark.createDataFrame(data, "sitemap_url string, xml string")
    got = {}
    for r in sitemap_urls(df).orderBy("sitemap_url", "position").collect():
        got.setdefault(r.sitemap_url, []).append(r.url)
    assert got["top"] == ["a", "b", "own", "c", "a&b"]
    assert got["mid"] == ["a", "b", "own", "c", "a&b"]  # through the cycle back to top
    assert got["low"] == ["a", "b", "own"] and got["leaf1"] == ["c", "a&b"] and got["leaf2"] == ["a", "b"]
    assert "none" not in got and "text" not in got and "empty" not in got
    assert [r.url for r in sitemap_urls(df, cap=2).where("sitemap_url = 'top'").orderBy("position").collect()] == ["a", "b"]
    assert sitemap_urls(df.limit(0)).count() == 0


def test_many_ways_to_one_sitemap_do_not_multiply(spark):
    # Two sitemaps a level, each an index of both of the next: 2**12 ways, 25 places.
    rows = [(f"{level}{side}", "<i>" + "".join(f"<sitemap><loc>{level + 1}{s}</loc></sitemap>" for s in "ab") + "</i>") for level in range(12) for side in "ab"]
    rows += [("12a", "<u><url><loc>x</loc></url></u>"), ("12b", "<u><url><loc>y</loc></url><url><loc>x</loc></url></u>")]
    got = sitemap_urls(spark.createDataFrame(rows, "sitemap_url string, xml string")).where("sitemap_url = '0a'").orderBy("position").collect()
    assert [r.url for r in got] == ["x", "y"]
