"""Names of containers and forms around the article must not empty it."""

import pytest

from veilscan.llm.html_text import blocks, main_element, main_text, parse

SAID = "Hello there, this is the article and it goes on for a while."
P = f"<p>{SAID}</p>"


def extracted(page):
    root = parse(page)
    main = main_element(root)
    return blocks(main, inside=main is not root)


@pytest.mark.parametrize("page", [
    f'<div class="layout has-sidebar"><main>{P}</main></div>',
    f'<div class="content-with-sidebar">{P}</div>',
    f"<form><article>{P}</article></form>",
    f'<form id="page-form"><div>{P}</div><input name="q"></form>',
    f'<div class="modal"><main>{P}</main></div>',
    f'<main>{P}</main><div class="comments"><article class="comment">{P * 4}</article></div>',
    f'<article>{P}<div class="ad-banner">ad</div><div class="site-footer">f</div><form><label>Name</label></form></article>',
    f'<div>{P}</div><div id="comments">{P}</div><form><label>search</label></form><ul class="related-posts"><li>More</li></ul>',
    f'<article>{P}<script>var a = "<p>x</p>"',
])
def test_names(page):
    assert extracted(page) == [SAID]


def test_parts_of_an_article():
    page = f"""<article>{P}<div class="share-price-analysis"><p>x</p></div><section class="market-share"><p>y</p></section>
    <h2 id="related-work">z</h2><h3 class="notice">w</h3></article>"""
    assert extracted(page) == [SAID, "x", "y", "z", "w"]


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    long = "<main>" + P * 20_000 + "</main>"
    odd = [deep, long, f'<div title="never closed>{P}', "<" * 1000, "</p></div>", f"{P}<form"]
    pages = spark.createDataFrame([(i, f"http://h{i}.example/", x) for i, x in enumerate(odd)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    assert found[0] == "deep" and found[1] == "\n".join([SAID] * 20_000) and len(found) == len(odd)
