import math

import numpy as np

from evidencelake.llm import htmlmain, topk


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(700), rng.normal(size=(700, 8)), strict=True)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)] + [(2000, None), (2001, [1.0, None] * 4), (2002, [math.nan] * 8), (2003, [math.inf] * 8), (None, [1.0] * 8), (2004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    fine = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in fine if i % 20 == 0):
        best = sorted((-int(fine[q] @ x), i) for i, x in fine.items() if i != q)[:5]
        assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(found) == {i for i in fine if i % 20 == 0}
    assert topk.top_k(df.limit(0), df, 5).count() == 0


def test_top_k_takes_large_components(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1e13, 0.0]), (2, [0.5, 0.5]), (3, [-2e12, 1e300]), (4, [math.inf, 0.0])], "vec_id long, embedding array<double>")
    found = topk.top_k(df, df.where("vec_id = 20"), 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, 64 * 64 * 10**13), (2, 64 * 32), (3, -64 * 64 * 2 * 10**12)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it work well for you.</div>
<main><article><h1>A  title &amp; more</h1><p>First <b>bold</b>text&nbsp;here, which goes on for a while.<p>Second &lt;one&gt;<br>line two.
<aside>Read also: <a href=3>another thing</a></aside><ul><li>a point of the list</li></ul>
<section id="comments"><p>I liked this article a lot, thank you for writing it.</p></section></article></main>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2024 Someone</footer></body></html>"""


def test_main_text():
    want = "A title & more\n\nFirst boldtext here, which goes on for a while.\n\nSecond <one> line two.\n\na point of the list"
    assert htmlmain.main_text(PAGE) == want
    plain = "<body><div class=menu><a href=1>x</a> <a href=2>y</a></div><div><p>" + "A long paragraph without any article element around it. " * 5 + "</p></div>"
    assert htmlmain.main_text(plain) == ("A long paragraph without any article element around it. " * 5).strip()
    assert htmlmain.main_text(None) == "" == htmlmain.main_text("") == htmlmain.main_text("<p")


def test_unclosed_elements_leave_the_article():
    article = "A paragraph of the article that goes on for long enough to be kept. " * 4
    body = f"<body><main><article><p>{article}</p></article></main></body>"
    assert htmlmain.main_text(f"<html><head><title>T</title><meta charset=utf-8>{body}") == article.strip()
    for name in "title select svg video audio object noscript template math iframe canvas".split():
        assert htmlmain.main_text(f"<html><head></head><{name} id=x>{body}") == article.strip(), name
        assert htmlmain.main_text(f"<html><head><{name}>{body}") == article.strip(), name
        assert "hidden" not in htmlmain.main_text(body.replace("<p>", f"<{name}>hidden words</{name}><p>")), name
    for name in ("script", "style", "textarea"):
        assert htmlmain.main_text(body + f"<{name}><p>{article * 2}</p>") == article.strip(), name


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1)], "page_id long, url string, html string, n_chars int")
    rows = htmlmain.extract(df).collect()
    assert [r["n_chars"] for r in rows] == [len(r["text"]) for r in rows] and len(rows) == 3
    assert htmlmain.extract(df.limit(0)).count() == 0


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        lean = [float(x) for x in rng.normal(size=n)]
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda own: sum(max(0, x) for x, o in zip(lean, own, strict=True) if not o) + sum(max(0, -x) for x, o in zip(lean, own, strict=True) if o) + sum(w for a, b, w in edges if own[a] != own[b])  # noqa: B023, E731
        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(htmlmain.minimum_cut(lean, edges)), least, abs_tol=1e-6)


def test_top_k_of_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(20, [1e10, 1.0]), (1, [1e10, 0.0]), (2, [-1e10, 0.0]), (3, [1e12, 1.0]), (40, [1e12, 1.0])], "vec_id long, embedding array<double>")
    found = topk.top_k(df, df.where("vec_id = 20"), 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, topk.LIMIT), (3, topk.LIMIT), (40, topk.LIMIT), (2, -topk.LIMIT)]


def test_trees_of_uneven_norms_are_searched_whole():
    rng = np.random.default_rng(7)
    rows = np.floor(rng.normal(size=(4096, 64)) * np.exp(rng.normal(size=(4096, 1))) * 64)
    ids = np.arange(4096)
    root = topk.tree(rows, topk._Tagged(ids, ids))
    depth, level = 0, [root]
    while level:
        depth, level = depth + 1, [c for n in level for c in n.children]
    assert depth < 30
    best = topk.search(root, rows[:20], ids[:20], 5, 4097)
    for q in range(20):
        want = sorted((-int(rows[q] @ x), i) for i, x in enumerate(rows) if i != q)[:5]
        assert [-((-int(b)) // 4097) for b in best[q]] == [-s for s, _ in want]


def test_labels_outside_forms_are_text():
    page = "<html><body><article><h1>Title of it</h1><p>Some words before the <label>marked term</label> and a good many words after it, so that it is a paragraph.</p></article></body></html>"
    assert "before the marked term and a good" in htmlmain.main_text(page)


def test_custom_elements_swallow_nothing():
    article = "<article><p>A first long sentence of the article that goes on for a while, with words.</p><p>And a second one that goes on as well, for long enough to count.</p></article>"
    for tag in ("style-x", "script-loader", "textarea-box", "title-bar", "svg-icon", "select-list"):
        assert htmlmain.main_text(f"<body><{tag}></{tag}>{article}</body>") == htmlmain.main_text(f"<body>{article}</body>") != ""
