"""The training-data operators against brute force, on small tables with nulls, ties, repeats and odd columns."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievewright.llm import html_text, mixing, quality_rules, ranking, sharding, simhash, spm, topk, toxicity, wordpiece
from sievewright.llm import vocab as V

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, lexicon=200):
    return " ".join(f"w{rng.randrange(lexicon)}{'abc'[rng.randrange(3)]}" for _ in range(n))


def sample_docs(n=120, seed=3):
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(1, 80)) for _ in range(n)]
    texts[5] = texts[4]
    texts[6] = texts[4] + " tail"
    texts[7:11] = [None, "", " \n\t ", "one two"]
    texts[11] = texts[12] = "a  b c \U0001f600 # | \n\na  b\n" * 30
    texts[13] = words(rng, 5000, 10**6)
    return [(i if i != 20 else None, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s1", 1)] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample_docs(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---------------------------------------------------------------------------------------------
def brute_top(rows, k=5):
    v = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q in {i for i, _ in v if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(asked, e, strict=False)), c) for i, asked in v if i == q for c, e in v if c != q)[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(400)]
    rows[7:12] = [(7, None), (8, [None] * 6), (9, [float("nan")] * 6), (10, [float("inf")] + [0.0] * 5), (11, [])]
    for i in range(20, 120):  # a hot vector
        rows[i] = (i, rows[20][1])
    rows.append((None, [1.0] * 6))
    rows += [(130, [2.5] * 6), (131, [-2.5] * 6), (130, [2.5] * 6), (150, [-1.0] * 6)]  # repeated ids, one of a query
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, score string")
    assert sorted(map(tuple, topk.op1(df).collect())) == brute_top(rows)
    vectors = topk.quantise(df)
    small = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), block=37, query_block=3)
    assert sorted(map(tuple, small.collect())) == brute_top(rows)


def test_reading_stops_by_the_bounds_alone():
    """Skewed components: few entries of the lists are read. Independent ones: nearly all, and results stay exact."""
    rng = np.random.default_rng(5)
    for x, share in ((np.round(rng.pareto(0.7, (3000, 4)) * 100), 0.25), (np.round(rng.normal(size=(1500, 24)) * 100), 1.0)):
        block = topk.Block(np.arange(len(x)), x)
        for i in range(20):
            q = np.abs(x[i]) if share < 1 else x[i]
            s = x @ q
            want = sorted((-int(v), j) for j, v in enumerate(s) if j != i)[:5]
            ((ids, scores),) = block.search(q[None, :], np.array([i]), 5)
            assert [(-v, j) for j, v in zip(ids, scores, strict=True)] == want
        assert block.reads <= share * block.entries and block.reads > 0


def test_top_k_few_rows_and_large_values(spark):
    df = spark.createDataFrame([(0, [1e15, 2.0]), (1, [1e15, -1.0]), (50, [-3.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.op1(df).collect()))
    assert [(q, r, c) for q, r, c, _ in got] == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)] and got[0][3] == 2**63 - 1
    assert topk.op1(df.where("false")).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------
def brute_counts(t):
    w = WORD.findall(t or "")
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = (t or "").split("\n")
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_counts():
    for _, t, *_ in sample_docs():
        assert quality_rules.base_counts(t) == brute_counts(t)


def test_quality_rules(spark, docs, empty):
    rng = random.Random(1)
    clean = [(1000 + i, words(rng, rng.randrange(30, 300)), "en", "s1", 1) for i in range(300)]
    junk = [(5000 + i, " ".join(f"{w}###" for w in words(rng, 100).split()), "en", "s1", 1) for i in range(20)]
    rows = quality_rules.op2(docs.unionByName(spark.createDataFrame(clean + junk, DOCS))).collect()
    assert len(rows) == docs.count() + 320
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[d[0]] for d in clean) and not any(kept[d[0]] for d in junk)
    assert all(not r.kept for r in rows if r.base_failed) and all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert quality_rules.op2(empty).count() == 0 and quality_rules.filter_documents(empty).columns == empty.columns


def numpy_mcd(x):
    """Centre and scatter by exact concentration steps on sorted distances, with the operator's starts and reweighting."""
    q = quality_rules
    size = -(-len(x) * 3 // 4)
    cov = lambda y: np.cov(y.T, bias=True).reshape(q.DIMS, q.DIMS)
    far = lambda c, s: np.einsum("ij,jk,ik->i", x - c, q.inverse_of(c, s)[0], x - c)
    median, low, high = (np.quantile(x, p, axis=0) for p in (0.5, 0.25, 0.75))
    best = None
    for c, s in ((median, np.diag(((high - low) / 1.349) ** 2)), (x.mean(0), cov(x)), (median, np.diag(q.noise(median) ** 2))):
        for _ in range(30):
            near = x[np.argsort(far(c, s), kind="stable")[:size]]
            c, s = near.mean(0), cov(near) * q.consistency(q.H)
        if best is None or q.inverse_of(c, s)[1] < best[0]:
            best = (q.inverse_of(c, s)[1], c, s)
    near = x[far(*best[1:]) <= q.chi_square_quantile(q.REWEIGHT, q.DIMS)]
    return near.mean(0), cov(near) * q.consistency(q.REWEIGHT)


def test_quality_verdicts_against_numpy(spark):
    """Distances and verdicts of three groups, one of them small, against exact steps on sorted distances."""
    q = quality_rules
    rng = random.Random(21)
    rows = []
    for i in range(900):
        t = words(rng, int(rng.lognormvariate(4.6, 0.7)) + 20).split()
        if i % 9 == 0:
            t = [w + "#" * rng.randrange(3) + "x" * rng.randrange(4) for w in t]
        rows.append((i, " ".join(t), "en" if i % 2 else "fr", "small" if i % 30 == 0 else "s1", 1))
    found = {r.doc_id: r for r in q.op2(spark.createDataFrame(rows, DOCS)).collect()}
    counts = np.array([q.base_counts(t) for _, t, *_ in rows], float)
    ok = (counts[:, 0] >= 20) & (100 * counts[:, 4] <= 30 * counts[:, 0])
    n = counts[:, 0]
    x = np.column_stack([np.log(n), counts[:, 1] / n, *[np.sqrt(counts[:, k] / n) for k in (2, 3, 4)]])
    centre, scatter = numpy_mcd(x[ok])
    cut = q.chi_square_quantile(q.KEEP, q.DIMS)
    for group in {r[2:4] for r in rows}:
        own = ok & np.array([r[2:4] == group for r in rows])
        c, s = numpy_mcd(x[own])
        a = own.sum() / (own.sum() + q.SHRINK)
        c, s = a * c + (1 - a) * centre, a * s + (1 - a) * scatter
        d = np.einsum("ij,jk,ik->i", x - c, q.inverse_of(c, s)[0], x - c)
        for i in np.flatnonzero(own):
            got = found[int(i)]
            assert abs(got.distance - d[i]) <= 0.25 * d[i] + 0.3, (group, got.distance, d[i])
            if abs(d[i] - cut) > 0.25 * cut:
                assert got.kept == bool(d[i] <= cut)
    assert any(not r.kept for r in found.values()) and sum(r.kept for r in found.values()) > 700


def test_estimates_do_not_follow_outliers(spark):
    """The estimates of a clean group come close to its mean and covariance, whatever a tenth of outliers says;
    where there is no scatter the noise of counting stands in."""
    q = quality_rules
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, q.DIMS)) * 2 + 5
    x[:400] += 60
    flat = np.full((200, q.DIMS), 5.0)
    rows = spark.createDataFrame([("k", r.tolist()) for r in x] + [("flat", r.tolist()) for r in flat] + [("line", [v] * q.DIMS) for v in x[400:900, 0].tolist()] + [("one", [5.0] * q.DIMS)], "key string, x array<double>")
    found = {r.key: r for r in q.minimum_covariance_determinant(rows).collect()}
    assert len(found) == 4
    assert np.abs(np.array(found["k"].centre) - 5).max() < 0.3
    width = {k: [v.scatter[i] for i, (a, b) in enumerate(q._TRI) if a == b] for k, v in found.items()}
    assert np.allclose(width["k"], 4, atol=0.6)
    inverse = [v for v, (a, b) in zip(found["flat"].inverse, q._TRI, strict=True) if a == b]
    assert np.allclose(np.array(inverse) * q.noise(np.full(q.DIMS, 5.0)) ** 2, 1)
    assert np.isfinite(found["line"].inverse).all() and np.isfinite(found["one"].inverse).all()


def test_far_outliers_are_rejected(spark):
    """Symbols at 0.43 a word, or words 3.5 characters longer than all others of the group, don't pass."""
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(60, 200)), "en", "s1", 1) for i in range(400)]
    rows.append((1000, " ".join(w + "#" * (i % 100 < 43) for i, w in enumerate(words(rng, 100).split())), "en", "s1", 1))
    rows.append((1001, " ".join(w + "abc" + "d" * (i % 2) for i, w in enumerate(words(rng, 100).split())), "en", "s1", 1))
    kept = {r.doc_id: r.kept for r in quality_rules.op2(spark.createDataFrame(rows, DOCS)).collect()}
    assert not kept[1000] and not kept[1001] and all(kept[i] for i in range(400))


# --- 3 ---------------------------------------------------------------------------------------------
def page(body, noise="Buy now and save"):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>'</script></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav><div class='ad'>{noise}</div><article>{body}</article><footer>&copy; site</footer>"


def test_html(spark):
    rng = random.Random(2)
    bodies = [[words(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5))] for _ in range(40)]
    pages = [(i, "u", page(f"<h1>{b[0]}</h1>" + "".join(f"<p>{x} &amp;  <b>bold</b>\n" for x in b))) for i, b in enumerate(bodies)]
    odd = [(100, "u", None), (101, "u", ""), (102, "u", "<html>"), (103, "u", "plain &lt;text&gt;\n here"), (104, "u", page("<p>one two three four</p><aside>side bar</aside><p>five<br>six seven</p><form>mail me</form><div class='comments'>nice post</div>"))]
    df = spark.createDataFrame(pages + odd + pages[:1], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.op3(df).collect()}
    for i, b in enumerate(bodies):
        assert got[i].text == "\n".join([b[0], *[f"{x} & bold" for x in b]]) and got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (100, 101, 102)] == ["", "", ""]
    assert got[103].text == "plain <text> here"
    assert got[104].text == "one two three four\nfive\nsix seven"
    assert html_text.op3(df).count() == len(pages) + len(odd) + 1
    assert html_text.op3(df.where("false")).count() == 0


@pytest.fixture(scope="module")
def page_weights():
    """Contexts as a table of pages trains them: adverts at the lower limit, the article at the upper."""
    return html_text.Weights({"w:article": (9000, 0, 100), "w:div.ad": (0, 9000, 100), "w:ul": (0, 9000, 100), "t:div.ad": (0, 100, 100), "t:/div.ad": (0, 100, 100)})


@pytest.mark.parametrize("box", ["<div class='ad'>{}</div>", "<aside><ul><li>{}</ul></aside>", "<form>{}</form>", "<div class='comments'><div>{}</div></div>"])
def test_html_long_parts_inside_the_article(page_weights, box):
    rng = random.Random(5)
    lead, ending, long = words(rng, 8), words(rng, 4), words(rng, 90)
    part = box.format(words(rng, 300).replace(" ", " <a href='/x'>more</a> "))
    for blocks in ([lead, part, long], [long, part, ending], [lead, part, long, part, part, ending]):
        body = "".join(x if x is part else f"<p>{x}</p>" for x in blocks)
        for opening, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='text'>", "</div>")):
            got = html_text.extract(page(body).replace("<article>", opening).replace("</article>", end), page_weights)
            assert got == "\n".join(x for x in blocks if x is not part)
    # a part at the end or beside the content still ends it
    for end in (f"{part}</article>", f"</article>{part}"):
        assert html_text.extract(f"<body><article><p>{long}</p>{end}<div class='x'>{ending}</div>", page_weights) == long


@pytest.mark.parametrize(
    "before",
    [
        "<html><head><meta charset='utf-8'><title>T</title><body>",
        "<head><title>T</title><link rel='x' href='y'><style>p{}</style>",
        "<html><head><script>var a='</head>'</script></head><body>",
        "<head><noscript><link href='x'></noscript></head><body>",
        "<body><noscript><img src='x'>",
        "<body><noscript><img src='x'><nav>Menu</nav>",
        "<body><svg viewBox='0 0 1 1'/><svg/>",
        "<body><iframe src='x' /><iframe src='y'/><iframe src='z'>old</iframe>",
        "<body><iframe src=http://x/y/>",
        "<body><template>",
        "<body><script src='x'/>var code</script><script/>",
        "<head><title>Title without end<body>",
        "<body><script>var code",
    ],
)
def test_html_raw_elements_without_end(page_weights, before):
    lead, rest = "one two three four", "five six seven"
    after = "<noscript>Enable it</noscript>" if "<noscript>" in before else ""
    got = html_text.extract(f"{before}<article><h1>{lead}</h1><p>{rest}<svg/></p><p>{lead}</p></article>{after}", page_weights)
    assert got == f"{lead}\n{rest}\n{lead}"


def test_html_head_ends_at_text_and_raw_text_is_none(page_weights):
    assert html_text.extract("<head><meta charset=utf-8>\n plain words here", page_weights) == "plain words here"
    got = html_text.extract("<p>one two three</p><svg><text>drawn</text></svg><iframe>old</iframe><STYLE>a{}</Style ><script>if(a<b)'<p>x'</script><p>four five six</p>", page_weights)
    assert got == "one two three\nfour five six"


def test_html_names_roles_and_links(page_weights):
    """What goes and what stays inside an article, with names that training has not seen."""
    rng = random.Random(7)
    lead, long, ending = words(rng, 12), words(rng, 60), words(rng, 9)
    get = lambda body: html_text.extract(f"<body><nav>Menu one</nav><article><h1>{lead}</h1>{body}<p>{ending}</p></article>", page_weights)
    links = "".join(f"<a href='/{i}'>{words(rng, 3)}</a> " for i in range(9))
    gone = [
        f"<div class='zz-top'>{links}</div>", f"<section id=qq><ul><li>{links}</ul></section>", f"<div role=complementary>{long}</div>", f"<div itemscope itemtype='https://schema.org/Comment'><p>{long}</div>",
        f"<section class='responses'><article><p>{long}</p></article><article>{long}</article></section>", f"<div class='ad'>{long}</div>", f"<div id=comments><p>{long}</p></div>", f"<form>{long}</form>",
    ]
    for part in gone:
        assert get(f"<p>{long}</p>{part}") == "\n".join([lead, long, ending]), part
    stays = [f"<div class='{c}'><p>{long}</p></div>" for c in ("legal-news", "post share-price", "reply-to-critics", "related work", "x")]
    stays += [f"<p title=it's>{long}</p>", f"<p title=it's id='b'>{long}</p>", f"<p data-x=\"a>b\" lang=fr>{long}</p>", f"<svg/><p>{long}</p>", f"<p>{long.replace(' ', ' <a href=x>', 1)}</a></p>"]
    for part in stays:
        assert get(part) == "\n".join([lead, long, ending]), part


def test_html_learns_names_and_pages_without_content_element(spark):
    """Names that stand outside the content of labelled pages are parts on others; named boxes that stand inside are not."""
    rng = random.Random(9)
    body = lambda k: "".join(f"<p>{words(rng, rng.randrange(8, 30))}</p>" for _ in range(k))
    labelled = [f"<body><div class='teaser-box'>{words(rng, 12)}</div><article><div class='notice x1'>{body(2)}</div>{body(2)}</article><div class=wrap><div class='thread'>{body(3)}</div></div>" for _ in range(30)]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(labelled)], "page_id long, url string, html string")
    weights = html_text.train(df)
    a, b, c = (words(rng, 20) for _ in range(3))
    assert html_text.extract(f"<body><article><p>{a}</p><div class='teaser-box'>{b}</div><div class=notice>{c}</div><div class='thread'><p>{b}</p></div></article>", weights) == f"{a}\n{c}"
    assert html_text.extract(f"<body><div class='teaser-box'>{b}</div><p>{a}</p><p>{c}</p><footer>{b}</footer><div class=thread>{b}</div>", weights) == f"{a}\n{c}"


def test_html_attribute_patterns_are_linear():
    import time

    began = time.perf_counter()
    for page in ("<p a=" * 30_000, "<p a='" * 30_000, "<p " + "a=b " * 50_000, '<p a="' + "x" * 10**6, "<p " + "'" * 10**6):
        html_text.extract(page, html_text.Weights({}))
    assert time.perf_counter() - began < 30


def test_best_region_against_all_spans():
    rng = random.Random(3)
    for _ in range(200):
        g = [rng.choice([-2, -1, 0, 1, 3]) for _ in range(rng.randrange(12))]
        a, b = html_text.best_region(g)
        assert sum(g[a:b]) == max([0] + [sum(g[i:j]) for i in range(len(g)) for j in range(i + 1, len(g) + 1)])


# --- 4 and 6 ---------------------------------------------------------------------------------------
def labelled(spark, bad):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        t = words(rng, rng.randrange(30, 120))
        worse = i % 4 == 0
        rows.append((i, bad(t, rng) if worse else t, "en", "s", 1))
        labels.append((i, int(not worse), int(worse)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: w for i, w, _ in labels}


def test_ranking(spark, docs, empty):
    rows, labels, truth = labelled(spark, lambda t, rng: t.replace(" ", "$$ "))
    found = ranking.op4(rows.unionByName(docs.selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars")), labels).collect()
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert len(found) == 600 + docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert {r.score for r in ranking.op4(docs, labels.where("false")).collect()} == {0.5}
    assert ranking.op4(empty, labels).count() == 0


def test_ranking_is_fitted_on_every_labelled_row(spark, monkeypatch):
    """Weights and threshold against Newton steps in numpy over all pairs and all rows; repeated rows count each."""
    rng = np.random.default_rng(4)
    y = (rng.random(900) < 0.7).astype(int)
    x = rng.normal(size=(900, ranking.FEATURES)) + 0.4 * y[:, None] * rng.random(ranking.FEATURES)
    x[:, 0] = 1.0
    monkeypatch.setattr("sievewright.llm.ranking.FIT_ROWS", 100)
    model = ranking.fit(spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x, strict=True)], "label int, x array<double>").repartition(7))
    scale = np.where(x.std(0) < 1e-9, 1, x.std(0))
    z = (x - x.mean(0)) / scale
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, ranking.FEATURES)
    w = np.zeros(ranking.FEATURES)
    for _ in range(15):
        p = 1 / (1 + np.exp(d @ w))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ranking.RIDGE * np.eye(len(w)), d.T @ p / len(d) - ranking.RIDGE * w)
    assert np.abs(model.weights - w).max() < 1e-3
    s = np.sort(model.raw(x))
    k = int((y == 0).sum())
    assert model.threshold == pytest.approx((s[k - 1] + s[k]) / 2)


def test_ranking_has_no_bound_on_labelled_documents(spark):
    """More labelled documents of a class than a sample of 6,000 would hold, and as many rows of one id: all take part."""
    docs = spark.range(40_000).selectExpr("if(id < 20000, id, 7) doc_id", "if(id < 20000 and id <> 7, 'plain words', 'more words here') text", "'en' lang", "'s' source", "1L n_chars")
    labels = spark.range(20_000).selectExpr("id doc_id", "cast(id % 10 > 0 as int) quality")
    model = ranking.train(docs, labels)
    plain = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").count()
    rows = [plain - 1, 20_001]  # the id 7 is in a training fold
    mean = np.average([ranking.features("plain words"), ranking.features("more words here")], axis=0, weights=rows)
    assert np.allclose(model.mean, mean, rtol=1e-6)


def test_toxicity(spark, docs, empty):
    def spoil(t, rng):
        w = t.split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["zorgish", "zorgal", "zorgen", "blatfool"]) + rng.choice(["", ","]))
        return " ".join(w)

    rows, labels, truth = labelled(spark, spoil)
    found = toxicity.op6(rows.unionByName(docs.selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars")), labels).collect()
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.predicted == 1 - truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert len(found) == 600 + docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert {r.predicted for r in toxicity.op6(docs, labels.where("false")).collect()} == {0}
    assert toxicity.op6(empty, labels).count() == 0


def test_toxicity_curve_and_cut_are_fitted_on_every_row(spark, monkeypatch):
    """Against Newton steps and a search of all cuts in numpy."""
    rng = np.random.default_rng(8)
    y = (rng.random(1500) < 0.2).astype(int)
    x = rng.normal(size=(1500, toxicity.FEATURES)) + 0.8 * y[:, None]
    x[700:] = np.round(x[700:])  # ties
    for name in ("common", "toxicity"):
        monkeypatch.setattr(f"sievewright.llm.{name}.FIT_ROWS", 200)
    found = toxicity.fit_curve(spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x, strict=True)], "label int, x array<double>").repartition(5))
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(toxicity.FEATURES + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
    assert np.abs(found[:-1] - w[:-1]).max() < 1e-6
    s = toxicity._raw(x, w)
    f1 = lambda marked: 2 * (marked & (y == 1)).sum() / (marked.sum() + y.sum())
    assert f1(toxicity.apply_curve(x, found) >= 0.5) == pytest.approx(max(f1(s >= c) for c in s))


def test_toxicity_has_no_bound_on_labelled_documents(spark, monkeypatch):
    """More labelled documents of a class than a sample of 3,000 would hold: the model knows the words of all,
    whether the labels are broadcast or not."""
    docs = spark.range(10_000).selectExpr("id doc_id", "concat(if(id % 2 = 0, 'plain words u', 'zorgish words u'), id) text")
    labels = spark.range(10_000).selectExpr("id doc_id", "cast(id % 2 as int) toxic")
    fold = {f"u{r.doc_id}" for r in labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").collect()}
    for most in (1_000_000, 0):
        monkeypatch.setattr(toxicity, "BROADCAST_LABELS", most, raising=False)
        model, _ = toxicity.train(docs, labels)
        assert set(model.words.to_pylist()) == fold | {"plain", "zorgish", "words"}


def test_shared_backoff_is_a_distribution():
    model_words = ["ab", "abc", "abd", "xab", "b"]
    cp, ends = toxicity._code_points(model_words), toxicity._ends(model_words)
    _, first = np.unique(toxicity._hashes(cp, ends, toxicity.ORDER), return_index=True)
    every = ends[first]
    letters = sorted(set(cp[ends].tolist()))

    def after_ab(ch: int) -> float:
        joined = np.concatenate([cp, toxicity._code_points(["ab" + chr(ch)])])
        return toxicity._shared(joined, np.array([len(cp) + toxicity.ORDER - 1 + 2]), 3, every)[0]

    # the characters that training saw, and as many others as the uniform last resort stands for
    total = sum(after_ab(int(ch)) for ch in letters) + (256 - len(letters)) * after_ab(ord("q"))
    assert abs(total - 1) < 1e-9


def test_class_shares_and_the_shared_rest_sum_to_one():
    rng = np.random.default_rng(2)
    t, o = rng.integers(0, 6, 500).astype(float), rng.integers(0, 9, 500).astype(float)
    t, o = t[t + o > 0], o[t + o > 0]
    sums = tuple((c.sum(), *[(c == m).sum() for m in (1, 2, 3)], (c >= 4).sum()) for c in (t, o))
    kinds = (t > 0).astype(float) + (o > 0)
    rest = toxicity.SHARED_DISCOUNT * len(kinds) / kinds.sum()
    for c, s in zip((t, o), sums, strict=True):
        share, left = toxicity.class_shares(c, s)
        total = (share + left * (kinds - toxicity.SHARED_DISCOUNT) / kinds.sum()).sum() + left * rest
        assert abs(total - 1) < 1e-9


def test_toxicity_counts_and_evidence_against_loops(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["a B", "you dolt, you", "go away now. go away now", None, " ", "x" * 100 + " b", words(rng, 40, 30)]), i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").selectExpr("label", "cast(doc_id % 3 as int) fold", "text")
    plain = lambda t: [x for w in (t or "").split() if (x := w.lower().strip(toxicity.EDGES))]
    want = Counter()
    for i, t, label in rows:
        w = plain(t)
        short = [len(x) <= toxicity.WORD_BYTES for x in w]
        for item in {(x, None) for x, k in zip(w, short, strict=True) if k} | {(w[k - 1], w[k]) for k in range(1, len(w)) if short[k] and short[k - 1]}:
            want[(*item, label, i % 3)] += 1
    got = Counter()
    for r in df.mapInArrow(toxicity._count, "word string, after string, label int, fold int, n long").collect():
        got[r.word, r.after, r.label, r.fold] += r.n
    assert got == want
    *_, model = toxicity.train_models(df)
    texts = [t for _, t, _ in rows[:40]] + ["go away dolt unseenword", "now go"]
    found = toxicity.Scorer(model).evidence(pa.array(texts, pa.string()))
    for t, x in zip(texts, found, strict=True):
        w = plain(t)
        g = model.word_gains(w).tolist()
        at = model.index_of(pa.array(w, pa.string())).tolist()
        g = [v + (model.pair_gains(np.array(at[k - 1 : k]), np.array(at[k : k + 1]))[0] if k else 0) for k, v in enumerate(g)]
        best = {}
        for a, v in zip(w, g, strict=True):
            best[a] = max(best.get(a, 0.0), v, 0.0)
        top = (sorted(best.values(), reverse=True) + [0.0] * toxicity.TOP)[: toxicity.TOP]
        runs = [max((sum(g[max(0, k - n) : k]) for k in range(1, len(g) + 1)), default=0) / n for n in toxicity.RUNS]
        assert np.allclose(x, [sum(g) / max(len(g), 1), *top, *runs, np.log1p(len(w))], atol=1e-5), t


# --- 5 and 10 --------------------------------------------------------------------------------------
TEXTS = ["", " ", "   a", "a   b  ", "\n", " \n ", "a\n\n b", "▁", "a▁b", None, "<s>", "x" * 3000, " " * 40, "<0x0A>", "日本語テキスト́", "\x00a\x85", "Ünïcödé naïve", "hello, world. It's 3.14!"]


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    rng = random.Random(1)
    pieces = V.load().pieces[259:]
    texts = TEXTS + ["".join(rng.choice(" \n\tabcdehilnorstu▁éß中😀'.,<0x0A>") for _ in range(rng.randrange(60))) for _ in range(400)] + ["".join(rng.choice(pieces)[:6].replace("▁", " ") for _ in range(rng.randrange(12))) for _ in range(400)]
    sp = sentencepiece.SentencePieceProcessor(model_file=V.default_path())
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in spm.decode_documents(spm.encode_documents(df)).collect():
        t = texts[r.doc_id]
        assert r.ids == (None if t is None else sp.encode(t)), t
        assert r.decoded == (None if t is None else t.replace("▁", " ")), t
    assert all(r.round_trip for r in spm.op5(df).collect()) and spm.op5(df.where("false")).count() == 0


def test_unigram_viterbi_against_all_segmentations():
    pieces = ("<unk>", "▁", "a", "b", "▁a", "ab", "ba", "▁ab", "aba", "bb")
    voc = V.Vocabulary(pieces, (0, -3, -2, -2.5, -3.1, -3.3, -3.2, -4, -5, -4.4), (V.UNKNOWN,) + (V.NORMAL,) * 9, V.UNIGRAM, True, False)
    score = dict(zip(pieces, voc.scores, strict=True))
    e = spm.Encoder(voc)

    def best(s):
        return max((sum(score[p] for p in c), c) for c in segmentations(s))[0]

    def segmentations(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in score:
                yield from ((s[:n], *c) for c in segmentations(s[n:]))

    todo = sorted({"▁" + "".join(random.Random(i).choices("ab", k=i % 9)) for i in range(80)})
    for w, got in zip(todo, e.encode_sorted(todo), strict=True):
        assert "".join(got) == w and abs(sum(score[p] for p in got) - best(w)) < 1e-9


def test_token_counts(spark, docs, empty):
    from tokenizers import models

    voc = V.load()
    normal = [p for p, k in zip(voc.pieces, voc.kinds, strict=True) if k == V.NORMAL]
    table = dict.fromkeys(["[UNK]"] + [p[1:] for p in normal if p[0] == "▁" and "▁" not in p[1:] and len(p) > 1] + ["##" + p for p in normal if "▁" not in p])
    model = models.WordPiece({w: i for i, w in enumerate(table)}, unk_token="[UNK]", max_input_chars_per_word=10**6)
    rows = docs.unionByName(spark.createDataFrame([(900 + i, t, None, None, 0) for i, t in enumerate(TEXTS)], DOCS))
    texts = {(r.doc_id, r.text) for r in rows.collect()}
    want = Counter()
    for i, t in texts:
        found = [[x.value for x in model.tokenize(w)] for w in WORD.findall(t or "")]
        want[i, len(found), sum(map(len, found)), sum(f == ["[UNK]"] for f in found)] += 1
    assert {tuple(r) for r in wordpiece.op10(rows).collect()} == set(want)
    assert wordpiece.op10(empty).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------
def test_sharding(spark, docs, empty):
    def laid_out(df, **kw):
        return {(r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard_documents(df, 7, **kw).collect()}

    rows = sharding.op7(docs).collect()
    assert len(rows) == docs.count() and all(r.grown_shard in (r.shard, 40) for r in rows)
    slots = Counter((r.shard, r.slot) for r in rows)
    per_shard = Counter(r.shard for r in rows)
    assert set(slots) == {(s, i) for s, n in per_shard.items() for i in range(n)}
    assert laid_out(docs) == laid_out(docs.repartition(5)) and laid_out(docs, bucket_bytes=100) != laid_out(docs)
    assert {(r.doc_id, r.size) for r in rows} == {(i, len((t or "").encode()) + 16) for i, t, *_ in sample_docs()}
    assert sharding.op7(empty).count() == 0


def test_equal_rows_are_dealt_over_the_buckets(spark):
    rows = [(1, "same text " * 5, None)] * 3000 + [(2, "same text " * 5, "y")] * 2 + [(i, f"text {i}", "x") for i in range(10, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket_start string")
    got = sharding.shard_documents(df, 3, bucket_bytes=8000).collect()
    assert Counter((r.doc_id, r.text, r.bucket_start) for r in got) == Counter(rows)
    shard, buckets = {r.shard for r in got if r.doc_id == 1}, Counter(r.bucket for r in got if r.doc_id == 1)
    assert len(shard) == 1 and len(buckets) > 5 and max(buckets.values()) < 1000
    slots = Counter((r.shard, r.slot) for r in got)
    assert set(slots) == {(s, i) for s, n in Counter(r.shard for r in got).items() for i in range(n)}
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(df.repartition(7), 3, bucket_bytes=8000).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_fisher_yates():
    assert sorted(sharding.fisher_yates(50, 1, 2).tolist()) == list(range(50)) and len(sharding.fisher_yates(0, 1)) == 0
    first = Counter(int(sharding.fisher_yates(4, s)[0]) for s in range(2000))
    assert all(400 < first[i] < 600 for i in range(4))


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard_documents(docs, 3), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count() and len(list((tmp_path / "s").glob("shard=*"))) == 3


# --- 8 ---------------------------------------------------------------------------------------------
def water_fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, docs, empty):
    rows = mixing.plan_mix(docs.select("doc_id", "source", mixing.n_words(docs["text"]).alias("size"))).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in rows) == sorted((i or -1, len(WORD.findall(t or ""))) for i, t, *_ in sample_docs())
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    want, taken = water_fill(sizes), Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    assert sorted(map(str, mixing.op8(docs).collect())) == sorted(map(str, mixing.op8(docs.repartition(7)).collect()))
    mixed = Counter()
    for r in mixing.mix_documents(docs).collect():
        mixed[r.source] += len(WORD.findall(r.text))
    assert mixed == +taken and mixing.mix_documents(docs).columns == docs.columns
    assert mixing.op8(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mixing_with_repeated_ids(spark):
    """Keys that many rows share are split by size: the same decisions as one sorted run of a source."""
    from hashlib import md5

    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, rng.choice(["a", "b", None]), rng.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = Counter((r.doc_id, r.source, r["size"], r.taken) for r in mixing.plan_mix(df, range_rows=10).collect())
    want = Counter()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    for s, target in water_fill(sizes).items():
        left = int(target + 1e-9)
        epochs, left = divmod(left, sizes[s])
        run = sorted((r for r in rows if r[1] == s), key=lambda r: (md5(f"{'' if r[0] is None else r[0]}:mix-1".encode()).hexdigest(), r[0] or 0, r[2]))
        for i, _, n in run:
            want[i, s, n, epochs * n + min(n, left)] += 1
            left -= min(n, left)
    assert got == want


def test_mixing_equals_sql(spark, docs):
    import duckdb

    plain = docs.where("doc_id is not null")
    documents = plain.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP8_SQL})").fetchall()
    assert sorted(map(str, map(tuple, mixing.op8(plain).collect()))) == sorted(map(str, want))


# --- 9 ---------------------------------------------------------------------------------------------
def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash(spark, docs, empty):
    rows = simhash.op9(docs.withColumnRenamed("n_chars", "fp")).collect()
    fps = [int(r.fingerprint, 16) for r in rows]
    groups = brute_components(fps)
    low = {g: min((r.doc_id for r, h in zip(rows, groups, strict=True) if h == g and r.doc_id is not None), default=None) for g in groups}
    assert [r.component_id for r in rows] == [low[g] for g in groups]
    text = {i: t for i, t, *_ in sample_docs()}
    assert all(int(r.fingerprint, 16) == brute_fingerprint(text[r.doc_id]) for r in rows if r.doc_id in range(0, 40))
    assert simhash.op9(empty).count() == 0


def brute_fingerprint(t):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_links_join_all_that_is_near(spark):
    """Chains, dense balls and large runs: the components equal those of all pairs."""
    rng = random.Random(8)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = [0, 1, 2**64 - 1] + [rng.getrandbits(64) for _ in range(150)]
    for base in fps[3:40]:
        fps += [flip(base, n) for n in (1, 2, 3, 4)]
    chain = [rng.getrandbits(64)]
    for _ in range(40):
        chain.append(flip(chain[-1], 3))
    hot = rng.getrandbits(64)
    ball = [hot ^ (1 << a) ^ (1 << b) for a in range(40, 56) for b in range(a + 1, 64)]
    fps = sorted(set(fps + chain + ball))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.link_fingerprints(df)
    found = simhash.connected_components(links).collect()
    roots = {r.node: r.root for r in found}
    assert len(roots) == len(found)
    assert links.count() < 6 * len(fps)
    want = brute_components(fps)
    got = [roots.get(f, f) for f in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
    # keys of more than a few rows are dealt out again: the same components
    roots = {r.node: r.root for r in simhash.connected_components(simhash.link_fingerprints(df, most=5)).collect()}
    again = [roots.get(f, f) for f in signed]
    assert len(set(zip(again, want, strict=True))) == len(set(again)) == len(set(want))


def test_long_runs_pass_through_without_being_held():
    """Runs of up to ``most`` rows become links, longer ones come out row by row, however the batches are cut."""
    rng = np.random.default_rng(3)
    key = np.sort(np.concatenate([np.full(n, k) for k, n in enumerate([1, 3, 50, 4, 5, 6, 200, 1, 7])])).astype(np.int64)
    fp = rng.permutation(len(key)).astype(np.int64)
    for size in (1, 3, 7, 60, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(fp[i : i + size]), pa.array(np.ones(len(key[i : i + size]), bool))], names=["key", "fp", "exact"]) for i in range(0, len(key), size)]
        out = pa.Table.from_batches(list(simhash._link_sorted(iter(batches), ("key",), 5))).to_pylist()
        assert sorted((r["key"], r["u"]) for r in out if r["key"] is not None) == sorted((k, f) for k, f in zip(key.tolist(), fp.tolist(), strict=True) if k in (2, 5, 6, 8))
        assert all((r["u"] ^ r["v"]).bit_count() <= 3 for r in out if r["key"] is None)


def test_dedup_keeps_one_of_each(spark, docs):
    found = {r.component_id for r in simhash.near_duplicates(docs).collect() if r.component_id is not None}
    kept = simhash.dedup_documents(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted(found) and ids.count(None) <= 1


# --- all filters --------------------------------------------------------------------------------------
def test_clashing_names_come_through(spark):
    """Columns of the caller bear the names of working columns; they and their values are kept."""
    names = ["x", "key", "centre", "inverse", "kept", "distance", "n_words", "base_failed", "score", "predicted", "mix_key", "inside", "size", "copy", "taken", "target", "m_id", "in_0", "keep_id", "odd_id", "fp", "component_id", "all", "bucket_start", "n", "text_"]
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randrange(25, 60)), "en", "s", 1, *[f"{c}{i}" for c in names]) for i in range(40)]
    rows += [rows[0]] + [(100 + i, t, "en", None, 1, *[f"{c}{100 + i}" for c in names]) for i, t in enumerate([None, "", rows[1][1]])]
    df = spark.createDataFrame(rows, DOCS + ", " + ", ".join(f"`{c}` string" for c in names))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = ranking.train(df, labels)
    filters = {"rules": quality_rules.filter_documents(df), "ranking": ranking.filter_documents(df, model), "dedup": simhash.dedup_documents(df), "mix": mixing.mix_documents(df)}
    for name, out in filters.items():
        assert out.columns == df.columns, name
        found = out.collect()
        assert found, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in found for c in names), name
    sharded = sharding.shard_documents(df, 2)
    assert sharded.columns == [*df.columns, "shard", "grown_shard", "bucket", "slot"] and sharded.count() == len(rows)
    assert all(r[c] == f"{c}{r.doc_id}" for r in sharded.collect() for c in names)
