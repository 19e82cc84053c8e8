"""Container splitter (the one Python step) and the container-site offer job."""

from pyspark.sql import functions as F

from pricelens.operators import containers as CT
from pricelens.operators import extract as X

HTML = """<html><head><script>var a='<div class="masonry-item">x</div>';</script></head><body>
<div class="masonry-item"><a href="/item/1">Popular Red Widget Brand 3 SMALL ₵ 1,234.00</a>
  <img src="https://img.example.com/p/1.jpg"><style>.x{}</style></div>
<div class="masonry-item outer"><div class="masonry-item inner"><a href="https://other.com/x">x</a>
  <a href="https://jiji.com.gh/ad/2">Used Blue Bolt Brand 4 ECONOMY GH₵ 750</a></div></div>
<div class="masonry-item">tiny</div>
</body></html>"""


def test_find_containers_document_order_nested_noise():
    cs = CT.find_containers(HTML, "jiji", 10)
    assert len(cs) == 4  # nested matches are kept, in document order
    assert CT._texts(cs[0]) == ["Popular Red Widget Brand 3 SMALL ₵ 1,234.00"]
    assert CT.find_containers("<div><div>a</div></div>", "tonaton", 1)[0].tag == "div"


def test_container_offers(spark):
    pages = spark.createDataFrame([(1, "https://jiji.com.gh/search?query=x", HTML, "jiji")],
                                  "page_id long, url string, html string, site_key string")
    rows = X.container_offers(CT.containers(pages, 4)).orderBy("pos").collect()
    assert [(r["title"], r["price"]) for r in rows] == [("Red Widget Brand 3 SMALL", 1234.0),
                                                         ("Blue Bolt Brand 4 ECONOMY GH", 750.0),
                                                         ("Blue Bolt Brand 4 ECONOMY GH", 750.0)]
    assert rows[0]["url"] == "https://jiji.com.gh/item/1" and rows[0]["image_url"].startswith("https://img")
    assert rows[1]["url"] == "https://jiji.com.gh/ad/2"


def plain_matches(node, sel):
    """A selector read piece by piece, for one element."""
    import re
    m = re.match(r'^([a-z0-9]+)?(?:\.([\w-]+))?(?:\[([\w-]+)(?:(\*?=)"([^"]*)")?\])?$', sel)
    tag, cls, attr, op, val = m.groups()
    have = node.attrs.get(attr) if attr else None
    return ((not tag or node.tag == tag) and (not cls or cls in node.attrs.get("class", "").split())
            and (not attr or have is not None and (op is None or (val in have if op == "*=" else val == have))))


def test_cascade_equals_selector_by_selector():
    import random
    rng = random.Random(6)
    parts = ["div", "article", "span", "a", "p"]
    classes = ["prd", "item", "product__container", "listing-item", "masonry-item x", "card", "gallery-item", "prd_fb", "other"]
    for _ in range(150):
        html = ""
        for _ in range(rng.randint(0, 25)):
            t = rng.choice(parts)
            a = rng.choice(["", f' class="{rng.choice(classes)}"', ' data-testid="listing-item"', ' data-spm-anchor-id="1"', ' data-widget-cid="x hy_bn y"'])
            html += f"<{t}{a}>text of it{rng.choice(['</' + t + '>', '', '<br>'])}"
        tree = CT._Tree()
        tree.feed(html)
        tree.close()
        els = list(CT._elements(tree.root))
        for site, sels in CT.SELECTORS.items():
            want = next((hit for sel in sels if (hit := [e for e in els if plain_matches(e, sel)])), [])
            assert CT.Cascade(sels).select(els) == want


def test_pages_that_fail_become_rows(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", HTML, "jiji"), (2, "u", "<div>boom</div>", "jumia"), (3, "u", None, "tonaton"), (4, "u", "<div class='prd'>x</div>", "jumia")],
                                  "page_id long, url string, html string, site_key string").coalesce(1)
    find = CT.find_containers

    def fails(html, site, n=None):
        if html and "boom" in html:
            raise AssertionError("unknown status keyword")
        return find(html, site, n)
    monkeypatch.setattr(CT, "find_containers", fails)
    rows = CT.parse_pages(pages).collect()
    bad = [(r.page_id, r.error) for r in rows if r.error]
    if bad:  # the patched function reached the workers by value
        assert bad == [(2, "AssertionError: unknown status keyword")]
    assert {r.page_id for r in rows if not r.error} >= {1, 4}


def test_accepted_and_rejected_rows(spark, tmp_path):
    good = "<p>enough text here</p>"
    pages = spark.createDataFrame([(1, good), (2, ""), (3, None), (4, "<p>text</p><a href="), (5, "<script>x</script>"), (6, "<p>1 < 2 text</p>"), (7, good + "</p")],
                                  "page_id long, html string").repartition(3)
    ok, bad, counts = X.split_errors(X.page_status(pages), path=str(tmp_path / "checked"))
    assert {r.page_id for r in ok.collect()} == {1, 6} and counts == {"accepted": 2, "rejected": 5}
    assert {r.page_id: r.status for r in bad.collect()} == {2: "empty", 3: "empty", 4: "cut off inside a tag", 5: "no_text", 7: "cut off inside a tag"}
    ok, bad, counts = X.split_errors(X.page_status(pages.limit(0)))
    assert ok.count() == bad.count() == 0 and counts == {"accepted": 0, "rejected": 0}
