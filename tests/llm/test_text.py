"""Decontamination, licenses, pages, archives and toxicity against brute force."""

import base64
import hashlib
import random
import re
import zlib

import pandas as pd
import pytest

from tessera.llm.decontaminate import PositionalIndex, _item_places, contamination, proximity_matches, words_of
from tessera.llm.html_text import Walk, extract, learn, main_text, tokens
from tessera.llm.licenses import NOTICES, PHRASES, license_scan
from tessera.llm.toxicity import Landmarks, _scorer, fit, toxicity_scores, training_rows
from tessera.llm.warc import archive_round_trip, url_key, write_archives

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_words(docs):
    texts = ["", None, "Ab-cÉ é9", "ÀB İx", "a\x00b_c`d{e~f", " lead  trail ", "１２ 中文.ok"]
    df = docs(list(enumerate(texts)))
    got = {r.doc_id: r.w for r in df.select("doc_id", words_of(df.text).alias("w")).collect()}
    assert got == {k: words(t) for k, t in enumerate(texts)}


def test_contamination(spark, docs):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for k in range(12)] + [(12, None), (13, ""), (5, "only here twice"), (None, "nameless item text")]
    rows = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 80))
        if rng.random() < 0.5:
            item = words(rng.choice(items)[1])
            cut_at = rng.randint(0, 3)
            w += item[cut_at:] if rng.random() < 0.5 else item
            w += rng.choices(vocabulary, k=5)
        rows.append((i, " ".join(w).title()))
    rows += [(60, None), (61, ""), (62, "Only here TWICE, only here twice; nameless item text"), (62, "nothing"), (None, "only here twice")]
    out = contamination(docs(rows), spark.createDataFrame(items, "item_id bigint, text string"), length=10)
    windows = {}
    for k, (i, t) in enumerate(items):
        w = words(t)
        size = min(10, len(w))
        for s in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(i)
    want = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for s in range(len(w)):
            for size in range(1, 11):
                if tuple(w[s : s + size]) in windows and s + size <= len(w):
                    hit.update(range(s, s + size))
                    found |= windows[tuple(w[s : s + size])]
        names = sorted(str(x) for x in found if x is not None)
        want.append((str(i), len(w), len(hit), len(names), ",".join(names), bool(hit)))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in out.collect()) == sorted(want)
    assert sum(x[-1] for x in want) > 5
    empty = contamination(docs([]), spark.createDataFrame([], "item_id bigint, text string"))
    assert empty.collect() == []


def test_proximity(spark, docs):
    items = spark.createDataFrame([(0, "alpha beta gamma")], "item bigint, t string")
    index = PositionalIndex.build(docs([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "z " * 40 + "beta gamma"), (4, "beta gamma")]), items.selectExpr("explode(split(t, ' ')) as word"), "doc_id", "text")
    near = proximity_matches(index, _item_places(index, items, "t"), 3).collect()
    assert {r.doc for r in near} == {1}


def test_contamination_of_long_and_repeating_texts(spark, docs):
    """A one-word item in a text of that word only, a line that repeats, an item of many windows, clashing column names."""
    long = [f"t{k}" for k in range(900)]
    text = " ".join(["filler", *long[100:700], "filler", *long[800:809]])
    rows = [(1, "go " * 20000), (2, "one two three. " * 3000), (3, text), (4, "t5 x t6")]
    frame = docs(rows).selectExpr("doc_id", "text", "1 as row", "2 as item", "3 as pos", "4 as word")
    items = spark.createDataFrame([(7, "Go"), (8, "one two three"), (9, " ".join(long)), (None, None)], "item_id bigint, text string")
    out = contamination(frame, items.selectExpr("*", "0 as row"), length=10, within=3).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in out] == [(20000, 20000, 1, "7", True), (9000, 9000, 1, "8", True), (611, 600, 1, "9", True), (3, 0, 0, "", False)]
    # of the long item's words that occur once, t5 and t6 stand first: row 4 has them, one word further apart
    assert [r.n_near for r in out] == [0, 1, 0, 1]


def test_licenses(docs):
    rng = random.Random(1)
    filler = "the of in version license public mit cc by gnu general apache x y z".split()
    rows = []
    for i in range(80):
        w = rng.choices(filler, k=rng.randint(0, 120))
        if rng.random() < 0.3:
            w[5:5] = rng.choice([*PHRASES, *NOTICES]).words.split()
        rows.append((i, " ".join(w)))
    rows += [(80, None), (81, ""), (82, "CC\nBY"), (None, "MIT License")]
    out = sorted(license_scan(docs(rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    for (i, t), r in zip(rows, out, strict=True):
        w = words(t)
        places = [(s, p.label) for p in PHRASES for s in range(len(w)) if w[s : s + len(p.words.split())] == p.words.split()]
        labels = sorted({x for _, x in places})
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (i, len(w), len(places), min((s for s, _ in places), default=None), max((s for s, _ in places), default=None), ",".join(labels))
        notices = {p.label for p in NOTICES if p.words in " ".join(w)}
        assert notices | set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan(docs([])).collect() == []


PAGE = '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">one</a></li><li><a href="/y">two</a></li></ul></nav><div class="ad">buy now it is cheap and good</div><article>{}</article><footer>&copy; x &middot; y</footer></body></html>'


def test_pages(spark):
    bodies = [f"<h1>Head {k}</h1><p>Some <b>bold</b>ly  put\n text &amp; more &lt;{k}&gt;<p>next<br>line" for k in range(5)]
    bodies[3] = '<h1>Head 3</h1><p>text</p><div class="comments"><p>a reader says very much about this</p></div><form><input value="x">send</form><p>end</p>'
    scores = learn(PAGE.format(b) for b in bodies)
    assert extract(PAGE.format(bodies[0]), scores) == "Head 0\nSome boldly put text & more <0>\nnext line"
    assert extract(PAGE.format(bodies[3]), scores) == "Head 3\ntext\nend"
    pages = spark.createDataFrame([(1, "u", PAGE.format(bodies[1])), (2, None, None), (None, "v", ""), (2, "w", "<p>")], "page_id bigint, url string, html string")
    out = main_text(pages.selectExpr("*", "1 as id", "2 as text"), scores).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in out] == [(1, "u", len(extract(PAGE.format(bodies[1]), scores))), (2, None, 0), (None, "v", 0), (2, "w", 0)]


def test_pages_with_elements_left_unclosed():
    body = "<h1>Head</h1><p>Some words of the article stand here<p>and some more of them"
    scores = learn([PAGE.format(body)])
    want = "Head\nSome words of the article stand here\nand some more of them"
    lists = [
        "<select>" + "<option>o" * 100 + "</select>",
        "<select><optgroup>" + "<option>o" * 100 + "<optgroup><option>o</select>",
        "<nav><dl>" + "<dt>t<dd>d" * 100 + "</dl></nav>",
        "<nav><dl>" + "<dt><p>t<dd><b>d</b>" * 100 + "</dl></nav>",
        "<aside><table>" + "<tr><th>h<td>d" * 100 + "</table></aside>",
        "<aside>" + "<b>x" * 100 + "</aside>",
    ]
    for before in lists:
        assert extract(PAGE.format(body).replace("<article>", f"{before}<article>"), scores) == want, before[:40]
    # What is left unclosed ends where the next one begins: an item that is aside does not swallow its neighbours.
    for page in ("<dl><dd class='ad'>buy<dd>kept</dl>", "<table><tr><td class='ad'>buy<td>kept</table>", "<table><tr class='ad'><td>buy<tr><td>kept</table>", "<ul><li class='ad'><p>buy<li>kept</ul>", "<p class='ad'>buy<div>kept</div>"):
        assert extract(page, {}) == "kept", page
    # A list, cell or table inside another does not end it.
    walk = Walk()
    for kind, name, value in tokens("<table><tr><td><table><tr><td><ul><li><p><ul><li>"):
        if kind != "text":
            walk.step(kind, name, value)
    assert [x[0] for x in walk.open] == "table tr td table tr td ul li ul li".split()
    deep = Walk()
    deep.step("start", "p", "")
    for _ in range(50):
        deep.step("start", "b", "")
    assert deep.place() == "p"


def test_pages_with_asides_within_the_article():
    lead, tail = "<h1>Head</h1><p>A short lead</p>", "<p>the tail</p>"
    want = "Head\nA short lead\nthe tail"
    scores = learn([PAGE.format(lead + tail)])
    for within in ('<div class="promo">buy <b>this</b> now</div>', "<aside class=new><ul><li>x<li>y</ul></aside>", '<nav><a href="#a">a</a></nav>', '<div style="color:red; display : none">x</div>', "<div hidden>x</div>", '<div hidden="">x</div>', '<p aria-hidden="true">x</p>', '<div class="wide ad">x</div>'):
        assert extract(PAGE.format(lead + within + tail), scores) == want, within
    # Such classes of the page itself, parts of names, and words that only look like attributes remove nothing.
    for tag in ('body class="sidebar nav"', "main class=comments id=menu", "article class='newsletter'", 'div class="has-sidebar nav-open"', 'div style="overflow:hidden"', 'div class="hidden-xs"', 'div class="hidden"', 'div data-hidden="x" data-class="ad"', 'div title="a hidden class=ad place"', 'div aria-hidden="false"', 'div style="--display:none"'):
        page = f"<{tag}>{lead}{tail}</{tag.split()[0]}>"
        assert extract(page, scores) == want, tag


def test_archives(spark):
    rng = random.Random(3)
    payloads = ["", None, "same", "same", "é" * 50, *(f"<p>{rng.random()}</p>" for _ in range(40))]
    rows = [(k, f"http://h{k % 7}.example.org/p{k % 5}?q={k}", p) for k, p in enumerate(payloads)] + [(99, "http://h1.example.org/p1?q=1", "same"), (None, None, "same"), (99, "x y", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    out = archive_round_trip(pages.selectExpr("*", "'k' as key", "0 as sha")).collect()
    best = {}
    for i, _, p in rows:
        if i is not None:
            best[p or ""] = max(best.get(p or "", -1), i)
    want = []
    for i, _, p in rows:
        data = (p or "").encode()
        revisit = best[p or ""] != i
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best[p or ""] if revisit else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=key) == sorted(want, key=key)
    archives = write_archives(pages)
    wanted = ["http://h1.example.org/p1?q=1", "http://h0.example.org/p0?q=0", "http://none.example.org/"]
    found = archives.lookup(spark.createDataFrame([(u,) for u in wanted], "url string"))
    assert sorted((r.key, r.id) for r in found.collect()) == sorted((url_key(u), i) for i, u, _ in rows if u in wanted)
    assert {r.url for r in archives.records(found).collect()} == set(wanted[:2])
    assert archive_round_trip(pages.where("false")).collect() == []


def test_toxicity(spark, docs):
    rng = random.Random(6)
    syllables = "th er on an re he in ed nd ha at en es or".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    insults = ["idiot", "stupid", "scumbag", "clown"]
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(insults)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    learned = training_rows(docs(rows), table)
    assert len(learned) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(600))
    model = fit(learned)
    out = {r.doc_id: r for r in toxicity_scores(docs([*rows, (700, None), (701, ""), (None, "you i d i o t"), (702, "IDIOT!!"), (703, "s-t-u-p-i-d"), (704, "idiiot")]), model, keep=("words",)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(out[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.98
    assert out[700].score == out[701].score == 0 and [out[k].predicted for k in (None, 702, 703, 704)] == [1] * 4
    assert fit([("a b", 0)]) is None and toxicity_scores(docs(rows[:2]), None).where("score > 0").count() == 0


def test_rare_and_two_word_insults():
    rng = random.Random(8)
    syllables = "th er on an re he in ed nd ha at en es or".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    text = lambda *extra: " ".join(rng.sample([*(word() for _ in range(20)), *extra], 20 + len(extra)))
    usual = ["idiot", "stupid", "moron"]
    samples = [(text(), 0) for _ in range(800)] + [(text(rng.choice(usual)), 1) for _ in range(770)]
    samples += [(text(w), 1) for w, n in (("plonker", 8), ("gobshite", 4), ("wazzock", 3), ("Sea-Cow", 4)) for _ in range(n)]
    samples += [(f"{text()} piece, dirt {text()}", 1) for _ in range(5)] + [(text("piece"), 0) for _ in range(20)] + [(text("dirt"), 0) for _ in range(20)]
    copied = text("berk", "zyxqwv")
    samples += [(copied, 1)] * 3  # one string of copies is enough to tell them
    model = fit(samples)
    score = lambda texts: next(_scorer(model, str(rng.random()))(iter([pd.DataFrame({"text": texts})])))["score"] >= 0.7
    for insult in ("idiot", "plonker", "PLONKER!", "gobshite", "gobsshite", "wazzock"):
        assert score([text(insult) for _ in range(20)]).all(), insult
    assert score([f"{text()} Piece - dirt. {text()}" for _ in range(20)]).all()
    assert score([text(), text("piece"), text("dirt"), f"{text()} dirt piece {text()}"] * 20).sum() <= 1


def test_kernel_is_the_sum_over_common_subsequences():
    from itertools import combinations

    from tessera.llm.toxicity import DECAY, SHORT

    def vector(w):
        w, out = f"^{w}", {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i <= 4:
                key = w[i] + w[j] + w[k]
                out[key] = out.get(key, 0) + DECAY ** (k - i + 1)
        size = max(len(w), SHORT + 1)
        return {k: v / sum((size - d) * (d - 1) * DECAY ** (2 * (d + 1)) for d in (2, 3, 4)) ** 0.5 for k, v in out.items()}

    a, b = ["idiot", "clown", "abc"], ["idixot", "own", "zzz"]
    got = Landmarks(a).kernel(b)
    for x, w in enumerate(b):
        for y, v in enumerate(a):
            p, q = vector(w), vector(v)
            assert got[x, y] == pytest.approx(sum(p[k] * q.get(k, 0) for k in p), abs=1e-9)


def test_unclosed_tags_take_linear_time():
    from time import process_time

    from tessera.llm.html_text import extract

    for part in ("<a ", '<a "', "<!", "<script ", "<a href='", "<b x=<"):
        began = process_time()
        extract(part * 40_000, {})
        assert process_time() - began < 20, part
    page = '<body class="no-sidebar"><div class="page has-comments"><p title="a > b <i>">one two three four five six</p><p <b>seven eight nine ten eleven twelve</b></p></div></body>'
    assert extract(page, {}).split() == "one two three four five six seven eight nine ten eleven twelve".split()
