"""The far side of every switch, long and hostile texts, hot keys, and methods against plain versions of themselves."""

from __future__ import annotations

import collections
import math
import os
import random
import subprocess
import sys
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F


def rows_of(df):
    return sorted(map(repr, df.collect()))


# -- operator 1

HOSTILE = {"tags": "<a ", "quotes": '<a "', "closed": '<a ">"', "comments": "<!-- ", "raw": "<script></script ", "open": "<div><p>", "items": "<li><b>", "angles": "<"}


@pytest.mark.parametrize("name", HOSTILE)
def test_page_of_a_megabyte_is_read_in_linear_time(name):
    from spandrel.llm.site_tree import Page

    def seconds(size):
        start = time.process_time()
        Page(HOSTILE[name] * (size // len(HOSTILE[name]))).text()
        return time.process_time() - start

    assert seconds(1_000_000) < max(12 * seconds(250_000), 2.0)


MARKUP = {
    "<main><h1>Title</h1><article><p>Body text</p></article></main>": "Title\nBody text",
    "<main><p>Main story..</p></main><div><article><p>Teaser</p></article></div>": "Main story..\nTeaser",
    "<div class='post has-comments'><p>x y</p></div>": "x y", "<div class='content no-sidebar'><p>body</p></div>": "body",
    '<div title="a>b">q</div>': "q", '<a href=x">z</a> 1 < 2 > 0 <br/>k <!-- c > --> m': "z 1 < 2 > 0 k m", "<p>a<script>if(a<b)x</script>c": "ac", "<title>t</title>": "",
}


@pytest.mark.parametrize("html", MARKUP)
def test_markup(html):
    from spandrel.llm.site_tree import Page

    assert Page(html).text() == MARKUP[html]


def site(spark):
    """A site whose unnamed parts repeat, within its article and outside."""
    page = "<body><div class='q'><p>Our fine site</p></div><article><h1>Story {i}</h1><div class='z'><p>Read more here</p></div><p>It was {i} and {j}.</p></article></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i=i, j=i * i)) for i in range(20)] + [(99, "http://one.org/", page.format(i=5, j=5))]
    return spark.createDataFrame(rows, "page_id int, url string, html string"), rows


GONE = {
    "cookie-notice": "div", "site-footer": "div", "nav-menu": "div", "comment-list": "ul", "post-comments": "section", "ad-box": "div", "related-content": "div", "newsletter-content": "div", "share-entry": "div", "": "form", "site-header": "div", "comment": "article", "top": "header",
}


@pytest.mark.parametrize("name", GONE)
def test_what_is_named_goes(name):
    from spandrel.llm.site_tree import Page

    tag = GONE[name]
    inner = "<p>not <b>this</b></p><div class='content'><p>nor this</p></div>"
    html = f"<body><{tag} class='{name}'>{inner}</{tag}><article class='post has-comments comments-open'><header><h1>Title</h1></header><p>Body</p></article><{tag} id='{name}'>{inner}</{tag}></body>"
    assert Page(html).text() == "Title\nBody"


def test_a_form_around_the_page_and_remarks_within_an_article():
    from spandrel.llm.site_tree import Page

    assert Page("<body><form><p>typed</p><main><p>all of it</p></main></form></body>").text() == "all of it"
    assert Page("<article><p>Body</p><section class='comments'><article><div class='content'>Me too</div></article></section><p>End</p></article>").text() == "Body\nEnd"


def test_a_site_never_restores_comments(spark):
    from spandrel.llm import site_tree as s

    draw = random.Random(4)
    some = lambda: "".join(f"<{t}>{draw.randrange(10**6)}</{t}> " for t in draw.choices(["b", "i", "em", "a"], k=draw.randint(1, 9)))
    page = "<body><article><h1>T{i}</h1><p>Body {i}</p></article><section class='comments'><p>{c}</p>{c}</section><form>{c}</form><header>{c}</header><div class='ad-box'>{c}</div></body>"
    rows = [(i, f"http://h.org/{i}", page.replace("{i}", str(i)).replace("{c}", some())) for i in range(40)]
    got = {r["k"]: r["text"] for r in s.extract_text(spark.createDataFrame(rows, "k int, url string, html string"), "k").collect()}
    assert got == {i: f"T{i}\nBody {i}" for i in range(40)}


def test_pages_are_counted_once_a_path(spark):
    from spandrel.llm import site_tree as s

    shapes = "".join(f"<p>{'<b>x</b>' * k} {k}</p>" for k in range(9))
    pages = spark.createDataFrame([("h", f"<body>{shapes}{i}</body>") for i in range(2)], "host string, html string")
    assert s.site_trees(pages, "host", "html").count() == 0
    assert {r["pages"] for r in s.site_trees(pages, "host", "html", 2).collect()} == {2}


def test_tree_decides_what_is_not_named(spark, monkeypatch):
    from spandrel.llm import site_tree as s

    pages, rows = site(spark)
    near = s.extract_text(pages, "page_id")
    got = {r["page_id"]: r["text"] for r in near.collect()}
    assert got[3] == "Story 3\nIt was 3 and 9."
    # Alone on its host, a page can't be judged by others.
    assert got[99] == s.Page(rows[-1][2]).text() == "Our fine site\nStory 5\nRead more here\nIt was 5 and 5."
    monkeypatch.setattr(s, "BROADCAST_NODES", -1)
    assert rows_of(s.extract_text(pages, "page_id")) == rows_of(near)


def test_tree_statistics_by_brute_force(spark):
    from spandrel.llm import site_tree as s

    pages, rows = site(spark)
    got = {r["path"]: r for r in s.site_trees(pages.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)), "host", "html").filter("host = 'h.org'").collect()}
    shapes, contents, shown = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.Counter()
    for _, url, html in rows:
        if "h.org" in url:
            features = s.Page(html, whole=True).features()
            # A page counts once for each path that it has, however many elements are on it.
            shown.update({path for path, *_ in features})
            for path, _, _, kind, feature in features:
                if kind < 2:
                    (contents if kind else shapes)[path][feature] += 1
    assert set(got) == set(shapes)
    for path, r in got.items():
        n = sum(shapes[path].values())
        assert r["pages"] == shown[path] and r["contents"] == len(contents[path])
        assert math.isclose(r["presentation"], -sum(c / n * math.log(c / n) for c in shapes[path].values()), abs_tol=1e-9)
        if contents[path]:
            assert math.isclose(r["repetition"], sum(map(math.log, contents[path].values())) / len(contents[path]), abs_tol=1e-9)


def test_rare_branches_count_as_one_that_no_site_has_judged(spark):
    from spandrel.llm import site_tree as s

    html = "<body><div class='{k}'><p>Note</p></div><p>Text {i}</p></body>"
    letters = "abcdefghijklmnopqrstuvwxyz"
    pages = spark.createDataFrame([(f"http://h/{i}", html.format(k=letters[i] * 3, i=i)) for i in range(20)], "url string, html string").withColumn("host", F.lit("h"))
    trees = s.site_trees(pages, "host", "html")
    assert trees.count() == 2 and trees.agg(F.sum("rare")).first()[0] == 20


# -- operators 5, 7 and 8


def test_rules_beyond_the_broadcast(spark, monkeypatch):
    from spandrel.llm import url_rules as u

    urls = spark.createDataFrame([(i, x) for i, x in enumerate(("http://a.example.org/es/x", "http://b.org/y", "http://c.net", None, "x://A.com/fr/1", "x://A.com/fr/1"))], "k int, url string")
    rules = spark.createDataFrame(u.QUERY_RULES, "host string, path string, verdict string")
    near = rows_of(u.filter_urls(urls, rules, "k"))
    monkeypatch.setattr(u, "BROADCAST_RULES", -1)
    assert rows_of(u.filter_urls(urls, rules, "k")) == near


def test_keys_to_drop_beyond_the_broadcast(spark, monkeypatch):
    from spandrel.llm import base

    rows = spark.createDataFrame([(i % 7 or None, "x") for i in range(30)], "k int, text string")
    gone = spark.createDataFrame([(2,), (5,)], "k int")
    near = rows_of(base.without(rows, gone, "k"))
    assert len(near) == 30 - 8
    monkeypatch.setattr(base, "BROADCAST_KEYS", -1)
    assert rows_of(base.without(rows, gone, "k")) == near


def test_windows_beyond_the_broadcast(spark, monkeypatch):
    from spandrel.llm import decontaminate as d

    r = random.Random(2)
    word = lambda: r.choice("abcdefgh")
    texts = [" ".join(word() for _ in range(r.choice((0, 3, 9, 10, 30, 200)))) for _ in range(60)]
    docs = spark.createDataFrame([(i % 50 or None, t or None) for i, t in enumerate(texts)] + [(7, texts[7])] * 3, "doc_id int, text string")
    items = spark.createDataFrame([(i if i else None, " ".join(word() for _ in range(k))) for i, k in enumerate((3, 4, 4, 12, 3, 0, 5))] + [(9, " ".join(texts[-1].split()[:15]))], "item_id int, text string")
    near = rows_of(d.document_hits(docs, items, "doc_id"))
    assert len(near) == docs.count()
    for name in ("BROADCAST_WINDOWS", "BROADCAST_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(d, name, -1)
            assert rows_of(d.document_hits(docs, items, "doc_id")) == near


def test_ledger_in_a_folder_and_findings_beyond_the_broadcast(spark, monkeypatch, tmp_path):
    from spandrel.llm import secret_scan as s

    rows = spark.createDataFrame([(1, "password=abcdefg"), (2, None), (3, "password=abcdefg")] + [(9, "secret: zzzzzzzz")] * 5, "k int, text string")
    folder = str(tmp_path / "ledger")
    ledger = s.scan(rows.filter("k < 9"), folder)
    assert ledger.count() == 2
    ledger = s.scan(rows, folder)
    assert ledger.count() == 3 and ledger.select("blob").distinct().count() == 3
    assert s.scan(rows, folder).count() == 3
    near, masked = rows_of(s.findings(rows, ledger)), rows_of(s.redact(rows, ledger))
    assert "[SECRET]" in masked[0]
    monkeypatch.setattr(s, "BROADCAST_BLOBS", -1)
    assert rows_of(s.findings(rows, ledger)) == near and rows_of(s.redact(rows, ledger)) == masked


def test_very_many_secrets_in_a_text(spark):
    from spandrel.llm import secret_scan as s

    rows = spark.createDataFrame([(1, " é ".join(f"token={i:09d}" for i in range(3000)))], "k int, text string")
    got = s.redact(rows, s.update_ledger(rows)).first()["text"]
    assert got == " é ".join(["[SECRET]"] * 3000)


# -- operators 2, 4, 6 and 9: long texts


def test_memory_does_not_follow_a_long_text():
    from spandrel.llm import textbytes
    from spandrel.llm.byte_cnn import Network

    raw = np.frombuffer(b"some words of a very long text, " * 500_000, np.uint8)
    offsets = np.array([0, len(raw)])
    network = Network()
    for work, most in ((lambda: textbytes.prints(raw, offsets), 100e6), (lambda: network.probabilities(raw, offsets), 150e6)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


@pytest.mark.parametrize("alnum", [False, True])
def test_prints_in_stretches(monkeypatch, alnum):
    from spandrel.llm import textbytes

    r = random.Random(1)
    for _ in range(200):
        texts = [bytes(r.choice(b"ab  Z\n\xc3.") for _ in range(r.choice((0, 0, 1, 3, 10, 200)))) for _ in range(r.randint(0, 8))]
        raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        starts, _, at = textbytes.spans(raw, offsets, alnum)
        want = textbytes.fingerprints(raw, starts, alnum)
        monkeypatch.setattr(textbytes, "STRETCH", r.choice((8, 16, 64)))
        got, places = textbytes.prints(raw, offsets, alnum)
        assert got.tolist() == want.tolist() and places.tolist() == at.tolist()


def test_network_by_brute_force(monkeypatch):
    from spandrel.llm import byte_cnn as b

    network = b.Network()
    w = network.weights
    monkeypatch.setattr(b, "RUN", 3)
    for size in (0, 1, 63, 64, 192, 193, 700):
        text = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8)
        cells = (size + b.WIDTH + b.CELL - 1) // b.CELL
        data = [*text.tolist(), *[0] * (cells * b.CELL + b.WIDTH - size)]
        response = [[max(sum(w["filters"][k][data[p + k]][f] for k in range(b.WIDTH)) for p in range(c * b.CELL, (c + 1) * b.CELL, b.STRIDE)) for f in range(b.FILTERS)] for c in range(cells)]
        hidden = []
        for c in range(cells):
            chunk = np.maximum(response[c], response[min(c + 1, cells - 1)])
            hidden.append(np.maximum(np.maximum(chunk + w["filter_bias"], 0) @ w["layer"] + w["layer_bias"], 0))
        want = float(np.concatenate((np.mean(hidden, 0), np.max(hidden, 0))) @ w["top"] + w["top_bias"][0])
        assert abs(network.forward(*b.padded(text, np.array([0, size])))[0] - want) < 1e-4
        assert abs(network.long_logit(text) - want) < 1e-4


def test_long_labelled_texts_are_learnt_from(spark):
    from spandrel.llm import byte_cnn as b

    docs = spark.createDataFrame([(1, "a" * 100_000 + "b" * 100_000), (2, "short"), (3, None)], "k int, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "k int, label int")
    texts, target = b.labelled_sample(docs, labels, "k", "label", most_each=2)
    assert sorted(zip(map(len, texts), target.tolist(), strict=True)) == [(5, 0.0), (200_000, 1.0)]
    assert {bytes([x]) for t in texts for x in t} >= {b"a", b"b"}


def test_a_signal_in_the_middle_of_long_texts_is_learnt(spark, monkeypatch):
    from spandrel.llm import byte_cnn as b

    draw = random.Random(3)
    long = lambda mark: "".join(draw.choices("abcdefgh ", k=20_000)) + mark + "".join(draw.choices("abcdefgh ", k=21_000))
    rows = [(i, long("QXZ#@!QX" * 3 if i % 2 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "k int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "k int, label int")
    monkeypatch.setattr(b, "BATCH", 8)
    scores = {r["k"]: r["score"] for r in b.classify(docs, labels, "k", "label").collect()}
    assert min(scores[i] for i in range(41, 60, 2)) > max(scores[i] for i in range(40, 60, 2))


def test_filters_over_runs_of_cells(monkeypatch):
    from spandrel.llm import byte_cnn as b

    network = b.Network()
    sizes = np.array([0, 40_000, 3, 9_000])
    raw = np.random.default_rng(5).integers(1, 255, sizes.sum(), dtype=np.uint8)
    data, at = b.padded(raw, np.concatenate(([0], np.cumsum(sizes))))
    whole = network.gradients(data, at, np.array([0, 1, 1, 0], np.float32))
    monkeypatch.setattr(b, "RUN", 7)
    runs = network.gradients(data, at, np.array([0, 1, 1, 0], np.float32))
    assert whole[0] == runs[0] and all((whole[1][k] == runs[1][k]).all() for k in whole[1])


# -- operator 3


def test_full_pieces_are_in_no_group(spark):
    from spandrel.llm import base, sos_packing as p
    import public_tokenizers

    docs = spark.createDataFrame([(i, "one two three " * 9_000 + "four " * i) for i in range(30)], "doc_id int, text string")
    pieces = base.stored(p.pieces(docs, "doc_id", public_tokenizers.path("word_bpe_49k.json")))
    got = p.pack(pieces, "doc_id", group_pieces=10).collect()
    full = [r for r in got if r["length"] == 2048]
    assert len(got) == pieces.count() and len(full) > 300 and all(r["sequence_id"] < 0 and r["offset"] == 0 for r in full) and len({r["sequence_id"] for r in full}) == len(full)
    groups = collections.Counter(r["sequence_id"] >> 40 for r in got if r["length"] < 2048)
    assert len(groups) == 3 and sum(groups.values()) <= 30


def test_no_key_makes_a_large_group(spark):
    from spandrel.llm import sos_packing as p

    docs = spark.createDataFrame([(None if i % 2 else 1, "one two three") for i in range(2000)], "doc_id int, text string")
    import public_tokenizers

    got = p.pack(p.pieces(docs, "doc_id", public_tokenizers.path("word_bpe_49k.json")), "doc_id", group_pieces=100).collect()
    groups = collections.Counter(r["sequence_id"] >> 40 for r in got)
    assert len(got) == 2000 and len(groups) == 20 and max(groups.values()) < 200


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from spandrel.llm.sos_packing import WordIds
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two  words,\n and İ more's"
    words = WordIds(path)
    assert not words.by_word and WordIds(public_tokenizers.path("word_bpe_49k.json")).by_word
    assert np.frombuffer(words.of(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# -- operator 6


def test_hubs_are_joined_apart(spark, monkeypatch):
    from spandrel.llm import components as c

    monkeypatch.setattr(c, "LEAST_HOT", 3)
    monkeypatch.setattr(c, "MOST_HOT", 20)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 201), (201, 202)]
    got = dict(map(tuple, c.components(spark.createDataFrame(edges, "u int, v int")).collect()))
    assert got == {i: 0 for i in range(60)} | {100 + i: 100 for i in range(31)} | {200 + i: 200 for i in range(3)}


@pytest.mark.parametrize("regions", [500_000, -1])
def test_regions_of_many_blocks(spark, monkeypatch, regions):
    """A family of texts, some near the first and some not, in blocks of few rows, against all pairs."""
    from spandrel.llm import minhash_join as m

    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(90):
        words = list(base)
        for _ in range((1, 2, 4, 6, 9)[i % 5]):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    # A branch that drifts away from the first text, step by step.
    for _ in range(12):
        words = texts[-1].split()
        for at in r.sample(range(len(words)), 2):
            words[at] = f"y{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    monkeypatch.setattr(m, "BLOCK_ROWS", 8)
    monkeypatch.setattr(m, "BROADCAST_REGIONS", regions)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x["doc_id"]: x["component_id"] for x in m.near_duplicates(docs, "doc_id").collect()}
    assert got == {i: find(i) for i in range(len(texts))} and 2 < len(set(got.values())) < 80


# -- operator 10


def vectors():
    r = np.random.default_rng(4)
    mix = r.standard_normal((6, 6)) * 40
    good, bad = r.standard_normal((500, 6)) @ mix, r.standard_normal((90, 6)) * 30 + 900
    return np.rint(np.concatenate((good, bad))).astype(int)


def plain_mcd(x, q, starts=40):
    """Concentration steps from random subsets, with the exact subset each time; the distances under the smallest determinant."""
    least = np.diag([s**2 for _, s in q.STATISTICS.values()])
    h, best = math.ceil(q.SHARE * len(x)), (np.inf, None)
    r = np.random.default_rng(1)
    for _ in range(starts):
        held, before = r.choice(len(x), 30, replace=False), np.inf
        while True:
            mean = x[held].mean(0)
            cov = q.CONSISTENCY * np.cov(x[held].T, bias=True) + least
            size = np.linalg.slogdet(cov)[1]
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            if len(held) == h and size > before - 1e-6:
                break
            before = size if len(held) == h else np.inf
            held = np.argsort(d, kind="stable")[:h]
        if size < best[0]:
            best = (size, d)
    return best


@pytest.mark.parametrize("groups", [50_000, -1])
def test_outliers_equal_those_of_a_plain_mcd(spark, monkeypatch, groups):
    from spandrel.llm import quality_mcd as q

    x = vectors()
    monkeypatch.setattr(q, "BROADCAST_GROUPS", groups)
    rows = spark.createDataFrame([(i, None if i % 2 else "en", "s", False, *map(int, v)) for i, v in enumerate(x)], f"k int, lang string, source string, base_failed boolean, {', '.join(f'{n} bigint' for n in q.NAMES)}")
    one = rows.withColumn("lang", F.lit("en"))
    _, want = plain_mcd(x.astype(float), q)
    got = np.array([r["distance"] for r in q.judge(one, q.estimate(one)).orderBy("k").collect()])
    # Border bins hold rows in part, so distances agree closely but not to the last digit.
    assert np.abs(got / want - 1).max() < 0.1
    assert ((got <= 30) == (want <= 30)).all() and (got[500:] > q.MOST).all() and (got[:500] < 60).all()
    # A null language is a group of its own; both halves reject the same rows.
    parts = q.judge(rows, q.estimate(rows)).collect()
    assert {r["k"] for r in parts if not r["kept"]} == set(range(500, 590))


# -- all operators that use workers


def test_executors_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from spandrel.llm import backoff_lm as lm, license_automaton, minhash_join, site_tree, sos_packing
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.checkpoint.dir", {str(tmp_path / "c")!r}).getOrCreate()
df = spark.createDataFrame([(i, "the cat sat on the mat " * 3) for i in range(4)], "k int, text string")
assert lm.score(df, "k", F.col("k") > 0).count() == 4
lm.train(df, lm.count_words(df))
assert license_automaton.scan_licenses(df, "k").count() == 4 and sos_packing.pack_documents(df, "k").count() == 4
assert minhash_join.near_duplicates(df, "k").select("component_id").distinct().count() == 1
assert site_tree.extract_text(df.withColumn("url", F.lit("x://h/")), "k", html="text").count() == 4
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    kept = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != root]
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | ({"PYTHONPATH": os.pathsep.join(kept)} if kept else {}), capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    from spandrel.llm import base

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        base.shared_folder(Session())


# -- keys of any name

CLASHES = {
    "extract_text": ["n_chars", "_host", "_html"], "score": ["logs", "n_tokens"], "pack_documents": ["piece", "offset", "_group"], "near_duplicates": ["keys", "n_shingles", "component_id"], "drop_near_duplicates": ["keys", "component_id"],
    "document_hits": ["n", "hits", "_text"], "drop_contaminated": ["n_words", "items"], "classify": ["score"], "scan_licenses": ["labels", "prefix"], "filter_urls": ["host", "prefix", "_digest"],
}


@pytest.mark.parametrize(("name", "key"), [(n, k) for n, keys in CLASHES.items() for k in keys])
def test_a_key_may_be_named_like_any_column(spark, name, key):
    from spandrel.llm import backoff_lm, byte_cnn, decontaminate, license_automaton, minhash_join, site_tree, sos_packing, url_rules

    def run(k):
        rows = spark.createDataFrame([(i, f"http://a{i}/x", f"word{i % 4} some text here and there again " * 5) for i in range(8)], f"`{k}` int, link string, body string")
        docs = rows.select(k, F.col("body").alias("text"), "link")
        items = spark.createDataFrame([(1, "some text here and there again word1 some text here")], "item_id int, text string")
        labels = spark.createDataFrame([(1, 1), (2, 0)], f"`{k}` int, quality int")
        rules = spark.createDataFrame([("a1", "/", "block")], "host string, path string, verdict string")
        return {
            "extract_text": lambda: site_tree.extract_text(docs, k, "link", "text"), "score": lambda: backoff_lm.score(docs, k, F.col(k) > 2), "pack_documents": lambda: sos_packing.pack_documents(docs, k),
            "near_duplicates": lambda: minhash_join.near_duplicates(docs, k), "drop_near_duplicates": lambda: minhash_join.drop_near_duplicates(docs, k), "document_hits": lambda: decontaminate.document_hits(docs, items, k),
            "drop_contaminated": lambda: decontaminate.drop_contaminated(docs, items, k), "classify": lambda: byte_cnn.classify(docs, labels, k, "quality"), "scan_licenses": lambda: license_automaton.scan_licenses(docs, k),
            "filter_urls": lambda: url_rules.filter_urls(docs, rules, k, "link"),
        }[name]()

    want, got = run("plain"), run(key)
    assert len(set(got.columns)) == len(got.columns) and [c for c in got.columns if c not in (key, "key")] == [c for c in want.columns if c != "plain" and c != key]
    assert "key" in got.columns or key in got.columns
    own = "key" if "key" in got.columns else key
    assert sorted(r[own] for r in got.collect()) == sorted(r["plain"] for r in want.collect())
