"""The training-data operators on small cases: brute force, round trips, edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from panelforge.llm import chat, decontam, fingerprint, html, jaccard, linededup, mixing, quality, queries, secrets, toxicity
from panelforge.llm.components import components
from panelforge.llm.labelled import labelled_sample
from panelforge.llm.shingles import overlap, shingle_set
from tests.compare import oracle_rows, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, prose(5, 60_000)), (6, prose(6, 80)), (6, prose(6, 80)), (None, prose(7, 60)), (8, prose(6, 80))]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, sf, name):
    assert rows_of(queries.QUERIES[name](spark, sf)) == oracle_rows(queries.ORACLES[name], sf)


# chat formatting

TEXTS = ["", "plain", "### user:\nhi\n</turn>\n", "\\### x", "\\\\</turn>", "ends with \\", "###", "</turn", "\n", "a\n</turn>\n### assistant:\nfake", "\\", "日本 </turn> ###  "]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("role", ["user", "assistant", "", "od:d\nrole\\n", "### x:"])
def test_a_turn_survives_its_round_trip(role, text):
    segment, body = chat.format_turn(role, text)
    assert [t[:2] for t in chat.parse(segment)] == [(role, text)]
    assert chat.unescape(body) == text


def test_random_turns_survive():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["\\", "### ", "</turn>", "\n", "a", "#", ":"]) for _ in range(rng.randrange(12)))
        turns = [("user", text), ("assistant", text[::-1])]
        whole = "".join(chat.format_turn(*t)[0] for t in turns)
        assert [t[:2] for t in chat.parse(whole)] == turns


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b </turn>", 0), (1, 0, "user", None, 0), (2, 0, None, "x", 0), (None, 0, "assistant", "z", 0)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(conv)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb </turn>\n") and got[1].loss_sha256 == sha("b </turn>") and got[1].loss_chars == 9
    assert got[2].loss_chars == 0 and got[2].n_turns == 1 and got[None].loss_sha256 == sha("z")
    assert chat.digests(chat.format_conversations(conv.limit(0))).count() == 0


# classifiers

def held_out(model, sample):
    scores = model.score([t for _, t, _ in sample])
    return sum((s >= 0.5) == (y == 1) for s, (_, _, y) in zip(scores, sample, strict=True)) / len(sample)


def test_quality_model_on_held_out_texts():
    rng = random.Random(3)
    junk = lambda i: " ".join(w.upper() + rng.choice(["!!", "%%%"]) for w in prose(i, 120).split())
    sample = [(i, prose(i, 120) if i % 3 else junk(i), int(i % 3 > 0)) for i in range(900)]
    model = quality.fit(sample[:600])
    assert held_out(model, sample[600:]) > 0.95
    assert 0 <= model.score([""])[0] <= 1 and model.score([None])[0] == model.score([""])[0]


def toxic_rows(n):
    rng = random.Random(4)

    def text(i, toxic):
        words = prose(i, 150).split()
        for _ in range(5 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["scoundrel", "blockhead", "numbskull"])
        return " ".join(words)

    return [(i, text(i, int(i % 4 == 0)), int(i % 4 == 0)) for i in range(n)]


def test_toxicity_model_on_held_out_texts(spark):
    rows = toxic_rows(900)
    copies = [(1000 + i, rows[4][1] + f" tail{i}", 1) for i in range(200)]  # near copies of one toxic text teach nothing more
    model = toxicity.fit(spark.createDataFrame(rows[:700] + copies, "_h long, _t string, _y int"))
    assert held_out(model, rows[700:]) > 0.9
    assert b"scoundrel" in model.toxic and b"scoundrel" not in model.ordinary
    assert 0 <= model.score([None])[0] <= 1 and model.score([""])[0] == model.score([None])[0]
    docs = documents(spark, ODD)
    for score in (toxicity.toxicity_score(model), quality.quality_score(quality.fit(rows[:400]))):
        got = [(r.doc_id, r.s) for r in docs.select("doc_id", score.alias("s")).collect()]
        assert len(got) == len(ODD) and all(0 <= s <= 1 for _, s in got)
        assert len({s for i, s in got if i == 6}) == 1 and len({s for i, s in got if i in (1, 2)}) == 1


def test_models_without_labels_or_with_one_class(spark):
    one = [(i, prose(i, 20), 1) for i in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, "_h long, _t string, _y int")
    for none, single in ((quality.fit([]), quality.fit(one)), (toxicity.fit(frame([])), toxicity.fit(frame(one)))):
        assert list(none.score(["a", ""])) == [0.5, 0.5] and single.score(["a"])[0] > 0.5


def test_labelled_rows_are_whole_and_bounded(spark):
    docs = documents(spark, [(1, prose(1, 30_000)), (2, "x"), (3, None), (4, "y"), (None, "z")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", F.lit(True), 10)
    assert sorted((len(t), y) for _, t, y in got) == [(1, 0), (len(prose(1, 30_000)), 1)]
    assert len(labelled_sample(docs, labels, "toxic", F.lit(True), 1)) <= 1


def test_classifier_queries_hold_out_the_right_rows(spark, sf):
    for name, modulus, rest in (("op2_toxicity", 4, 2), ("op9_quality_classifier", 5, 0)):
        rows = queries.QUERIES[name](spark, sf).collect()
        assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


# pages

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p>One <b>two</b>
three<p>Four<br>five<div class="ad">Buy</div><aside>See also</aside><ul><li>six<li>seven</ul><section id="comments"><p>First!</p></section></article>
<form>Mail <input></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & tail\n\nOne two three\n\nFour five\n\nsix\n\nseven"
    for broken in ("", "<", "<p", "</p></div>", "a < b", "<p>x", "<!-- open", "<script>never closed", "<div><p>a</div>b"):
        html.main_text(broken)
    assert html.main_text("a < b") == "a < b" and html.main_text("<p>x") == "x"


PAGES = "page_id long, url string, html string, text int"


def test_style_tree_cuts_what_pages_of_a_host_share(spark):
    """No article element, no telling names: what pages repeat goes, wherever it stands, on hosts with few pages as with many."""

    def page(i):
        return f"<body><div class='wrap'><div class='top'><a href='/'>one</a> <a href='/x'>two</a></div><div class='box'>same on every page</div><div class='story'><h2>{prose(i, 3)}</h2><p>{prose(i, 30)}</p></div><div class='end'>the end</div></div></body>"

    for n in (8, 150):
        rows = [(i, "http://h.example/x", page(i), 0) for i in range(n)] + [(1000, None, None, 0), (1001, "odd", "", 0)]
        got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
        assert all(got[i] == f"{prose(i, 3)}\n\n{prose(i, 30)}" for i in range(n)) and got[1000] == "" and got[1001] == ""
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_tree_decides_inside_and_outside_of_articles(spark):
    def page(i):
        return f"<nav>home about</nav><article><h1>{prose(i, 4)}</h1><p>{prose(i, 30)}<p>{prose(i + 900, 9 + i % 5)}</article><div class='story'>{prose(i + 300, 20)}</div><section id=comments>{prose(i + 600, 9)}</section><footer>us</footer>"

    rows = [(i, "http://h.example/x", page(i), 0) for i in range(120)]
    pages = spark.createDataFrame(rows, PAGES)
    expected = {i: "\n\n".join([prose(i, 4), prose(i, 30), prose(i + 900, 9 + i % 5), prose(i + 300, 20)]) for i in range(120)}
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == expected
    assert {r.page_id: r.text for r in html.extract(pages, broadcast_paths=0).collect()} == expected


def brute_tree(pages):
    """The importance of every path, from plain counts."""
    once = {(h, str(n)): n for h, s in pages for n in [html.style_nodes(s, h)]}
    found = collections.defaultdict(list)
    for nodes in once.values():
        for n in nodes:
            found[n[0]].append(n)
    own = {}
    for path, ns in found.items():
        m, shapes, texts = len(ns), collections.Counter(n[3] for n in ns), collections.Counter(n[4] for n in ns if n[4] is not None)
        entropy = lambda c: -sum(v / sum(c.values()) * math.log(v / sum(c.values())) for v in c.values())
        presentation = entropy(shapes) / math.log(m) if m > 1 else 1.0
        content = math.exp(entropy(texts)) / sum(texts.values()) if texts else 0.0
        chars = sum(n[5] for n in ns)
        own[path] = html.own_importance(m, presentation, len(shapes), content, sum(n[6] for n in ns) / chars if chars else 0.0)
    result = {}
    for path, ns in found.items():
        tree = max([own[path]] + [own[u] * html.INHERITED ** (k + 1) for k, u in enumerate(ns[0][2])])
        prior, weight = html.PRIOR[ns[0][1]]
        result[path] = (len(ns), (len(ns) * tree + weight * prior) / (len(ns) + weight))
    return result


def test_style_tree_equals_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    hosts = [(r.h, r.html) for r in pages.select(html._host().alias("h"), "html").collect()]
    expected = brute_tree(hosts)
    got = {r.path: (r.n_pages, r.importance) for r in html.style_tree(pages.unionByName(pages)).collect()}  # copies count once
    assert got.keys() == expected.keys() and all(got[p][0] == m and abs(got[p][1] - v) < 1e-9 for p, (m, v) in expected.items())


def test_tree_changes_most_pages(spark):
    """Without the tree (nothing cut), and with names that say nothing, the pages of sf0.01."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", html._host().alias("h"), "html").collect()
    tree = brute_tree([(r.h, r.html) for r in rows])
    cut = {p for p, (_, v) in tree.items() if v < html.LEAST_IMPORTANCE}
    assert sum(html.main_text(r.html, cut, r.h) != html.main_text(r.html, frozenset(), r.h) for r in rows) > len(rows) / 2
    assert all(html.main_text(r.html, cut, r.h).split("\n\n")[0] == re.search(r"<h1>(.*?)</h1>", r.html)[1].replace("&amp;", "&").replace("&quot;", '"').strip() for r in rows if "<h1>" in r.html)


@pytest.mark.parametrize("source", ["<a " * 100_000, "<b>" * 5000 + "x", "<p>x<span class='ad'>" + "<b>" * 5000 + "y", '<a "' * 50_000 + ">", "<div>" * 5000 + "<p>" * 5000 + "z", "<!--" * 50_000, "<li><div>" * 4000 + "</li>" * 4000, "<p>" + "word " * 200_000, "<" * 500_000])
def test_hostile_pages_take_time_in_proportion(source):
    began = time.time()
    html.main_text(source)
    html.style_nodes(source)
    assert time.time() - began < 5


def test_repeated_articles_are_kept(spark):
    for n in (6, 200):
        rows = [(i, "http://h.example/x", f"<nav>menu {i % 3}</nav><article><p>the same article</p></article>") for i in range(n)]
        assert {r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"the same article"}


# decontamination

ITEM = "In March 12 boxes of Alice weigh 40 kg and the driver from Berlin carries them over 7 km to the old harbour before noon"


def test_leaks(spark):
    re_parameterised = ITEM.replace("12", "15").replace("40", "52").replace("Alice", "Robert").replace("7", "9")
    rows = [(1, prose(1, 40) + " " + ITEM + " " + prose(2, 40)), (2, "x " + re_parameterised + " y"), (3, prose(3, 90)), (4, "say " + ITEM.lower()), (5, " ".join(ITEM.split()[:8])), *[(i + 100, t) for i, t in ODD if i]]
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "tiny one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(documents(spark, rows), bench).collect()}
    assert got == {(1, 7), (2, 7), (4, 7)}
    kept = {r.doc_id for r in decontam.decontaminate(documents(spark, rows), bench).collect()}
    assert kept == {3, 5} | {i + 100 for i, _ in ODD if i}
    assert decontam.leaks(documents(spark, rows), bench.limit(0)).count() == 0 and decontam.leaks(documents(spark, []), bench).count() == 0


def test_inconsistent_slots_are_no_leak(spark):
    item = "pack 5 red apples and 5 green pears and then 5 long beans into the blue bag now"
    rows = [(1, item.replace("5", "8")), (2, "pack 1 red apples and 2 green pears and then 3 long beans into the blue bag now")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontam.leaks(documents(spark, rows), bench).collect()} == {1}


def test_runs_are_cut_at_conflicts_and_gaps(spark):
    item = "pack 5 red apples and then go to the far old market near the river bank with them and wait for 5 long hours of the day until the others come back home again"
    words = item.split()
    rows = [(1, item.replace("for 5", "for 8")), (2, " ".join([*words[:10], *"ab cd ef".split(), *words[13:]])), (3, " ".join([*words[:9], "zz", *words[10:19], "yy", *words[20:29]])), (4, "a car at 90 km/h is 5 km/h faster than the 5 old red cars that stand here")]
    bench = spark.createDataFrame([(1, item), (2, rows[3][1].replace("90", "80"))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered_words for r in decontam.leaks(documents(spark, rows), bench).collect()}
    # 1: from behind the first slot on; 2: behind the gap; 3: no piece of 13 words
    assert got == {(1, 1): len(words) - 2, (2, 1): len(words) - 13, (4, 2): 20}


def test_exact_copies_of_items_with_few_words_beside_numbers_leak(spark):
    items = {1: "What is 12 + 7?", 2: "2 4 8 16 32 64 128 256 512 1024 2048 then", 3: "Add the rows below for me 1 2 3 4 5 6 7 8 9 10 and report the total of them"}
    rows = [(k, f"{prose(k, 20)}. {t} {prose(k + 9, 20)}") for k, t in items.items()]
    rows += [(11, f"{prose(11, 20)}. What is 13 + 8? {prose(12, 20)}"), (12, "2 4 8 16 32 64 128 256 512 1024 2049 then"), (13, "x. " + items[3].replace("5 6", "6 5") + " y")]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(documents(spark, rows), bench).collect()}
    assert {(1, 1), (2, 2), (3, 3)} <= set(got) and not set(got) & {(11, 1), (12, 2)}
    assert all(got[k, k].covered_words == got[k, k].item_words for k in items)


def test_items_of_numbers_with_other_numbers_leak(spark):
    item = "Compute 12 34 56 78 90 11 13 15 17 19 21 23 25 minus 80"
    other = "Compute 92 39 59 71 91 18 14 16 27 29 31 33 35 minus 70"
    rows = [(1, f"{prose(1, 20)}. {other} {prose(2, 20)}"), (2, item), (3, other.replace("59", "cats")), (4, "Compute 5 minus 8"), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"), (6, other.replace("minus", "plus"))]
    bench = spark.createDataFrame([(1, item), (2, "5 m 6 m 7 m")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered_words for r in decontam.leaks(documents(spark, rows), bench).collect()}
    assert got == {(1, 1): 16, (2, 1): 16}


def test_short_items_in_the_midst_of_a_sentence_leak(spark):
    item = "Sam sells 5 red apples and 3 green pears to Ann today"
    rows = [(1, "we saw that " + item), (2, "we saw that " + item.replace("5", "9").replace("3", "4")), (3, "we saw that Sam sells 9 red apples")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.covered_words for r in decontam.leaks(documents(spark, rows), bench).collect()}
    assert got == {1: 12, 2: 12}


def test_leaks_equal_brute_force(spark, sf):
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_benchmark_decontamination"](spark, sf).collect()}
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [(r.item_id, flat(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, flat(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {(d, i) for d, t in docs for i, b in items if b in t} <= got


# fingerprints

def plain_codes(text):
    """The digest of a text with loops: length code and 256 bucket codes."""
    raw = text.encode()
    if len(raw) < 3:
        return len(raw), [0] * 256
    counts = [0] * 256
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        counts[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 24] += 1
    quarters = [sorted(counts)[k] for k in (63, 127, 191)]
    return 2 + int(4 * math.log2(len(raw))), [sum(q < n for q in quarters) for n in counts]


def plain_likeness(a, b):
    (m, x), (n, y) = plain_codes(a), plain_codes(b)
    return 1 - (sum((0, 1, 2, 6)[abs(u - v)] for u, v in zip(x, y)) + min(12, abs(m - n))) / (256 * 6 + 12)


def test_digests_equal_plain_ones(spark):
    texts = ["", "a", "ab", "abc", prose(1, 5), prose(1, 300), prose(2, 300), "日本語 テキスト " * 9, "x" * 5000]
    got = sorted(fingerprint.fingerprints(fingerprint.with_next(documents(spark, list(enumerate(texts))), blocks=3)).collect())
    for r, t, n in zip(got, texts, texts[1:] + texts[:1], strict=True):
        length, codes = plain_codes(t)
        packed = bytes([length, *(codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, 256, 4))])
        changed = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r.fingerprint == packed.hex()
        assert r.near_edited == pytest.approx(plain_likeness(t, changed)) and r.near_next == pytest.approx(plain_likeness(t, n))


def test_fingerprints_equal_brute_force(spark):
    rows = [(i, t) for i, t in ODD if i is not None]
    got = fingerprint.fingerprints(fingerprint.with_next(documents(spark, rows), blocks=5)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: r)
    expected = collections.Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        changed = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        expected[(i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.digest(t), fingerprint.digest(changed))] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == expected
    assert fingerprint.likeness(fingerprint.digest("abc"), fingerprint.digest("abc")) == 1.0
    assert fingerprint.fingerprints(fingerprint.with_next(documents(spark, []))).count() == 0
    assert all(0 <= r.near_next <= 1 for r in got)


# Jaccard join

def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[root(k)] = min(smallest.get(root(k), i), i)
    return sorted((i, len(sets[k]), smallest[root(k)]) for k, (i, _) in enumerate(rows))


def chain_of_edits(seed, copies, edits):
    rng = random.Random(seed)
    words = prose(seed, 120).split()
    for _ in range(copies):
        yield " ".join(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"edit{rng.random()}"


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 4, 5), (1, 1, 2)])
def test_components_equal_brute_force(spark, n, num, den):
    texts = [*chain_of_edits(1, 12, 1), *chain_of_edits(2, 12, 3), *[prose(3, 50)] * 5, "A b", "a B", "a b c", None, "", " \n", prose(4, 30_000), prose(4, 30_000) + " tail"]
    base = prose(9, 100).split()
    texts += [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(0, 100, 5)]  # near copies of one text
    rows = list(enumerate(texts))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.document_components(documents(spark, rows), n, num, den).collect())
    assert got == brute(rows, n, num, den)


def test_one_document_of_each_component_stays(spark):
    rows = [(5, prose(1, 90)), (3, prose(1, 90)), (9, prose(2, 90)), (9, prose(2, 90)), (None, prose(3, 60)), (1, None)]
    kept = [r.doc_id for r in jaccard.without_near_copies(documents(spark, rows)).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3, 9] and kept.count(None) == 1
    assert jaccard.document_components(documents(spark, [])).count() == 0


def test_null_and_repeated_ids_with_different_texts_stay(spark):
    a, b, c, d, e = (prose(k, 70) for k in range(20, 25))
    rows = [(None, a), (None, b), (None, b), (None, "x"), (None, None), (4, c), (4, d), (4, ""), (7, a), (8, e), (9, e + " tail"), (4, e)]
    kept = jaccard.without_near_copies(documents(spark, rows)).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in kept), key=key) == sorted([(None, a), (None, b), (None, "x"), (None, None), (4, c), (4, d), (4, ""), (4, e)], key=key)


def test_sets_ignore_only_ascii_space_and_case():
    assert len(shingle_set("a b C", 1)) == 2 and len(shingle_set("É é", 1)) == 2
    assert overlap(shingle_set("a b c", 1), shingle_set("C x A", 1)) == 2


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.label for r in components(links).collect()} == {0}


# secrets

def test_secret_spans(spark):
    text = 'é password = "abcdefgh12" token:short secret: token: abcdefgh12 AKIAABCDEFGHIJKL ' + "0f" * 20
    rows = [(1, text), (2, None), (3, text), (3, text), (None, "x")]
    docs = documents(spark, rows)
    ledger = secrets.scan_unseen(docs)
    got = {r.doc_id: r for r in secrets.report(secrets.findings(docs, ledger)).collect()}
    assert ledger.count() == 3 and secrets.report(secrets.findings(docs, ledger)).count() == 5
    for span in got[1].spans.split(","):
        kind, a, b = span.split(":")
        assert text[int(a) : int(b)].startswith({"assign": "password", "access": "AKIA", "hex": "0f"}[kind])
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 1) and got[3].spans == got[1].spans
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_only_unseen_pairs_are_scanned(spark):
    docs = documents(spark, [(1, "password=abcdefgh1"), (2, "clean")])
    ledger = secrets.scan_unseen(docs)
    assert secrets.scan_unseen(docs, ledger).count() == 0
    more = documents(spark, [(1, "password=abcdefgh1"), (3, "secret=abcdefgh1")])
    assert secrets.scan_unseen(more, ledger).count() == 1
    raised = (secrets.Rule("assign", 2, secrets.RULES[0].pattern, 1, 8), *secrets.RULES[1:])
    again = secrets.scan_unseen(docs, ledger, raised).collect()
    assert len(again) == 2 and all([f["rule"] for f in r.found] == ["assign@2"] for r in again)


def test_a_text_with_many_matches(spark):
    text = " ".join(f"{i:08x}" * 4 + "x" for i in range(8000))
    began = time.time()
    got = secrets.report(secrets.findings(d := documents(spark, [(1, text)]), secrets.scan_unseen(d))).first()
    spans = [tuple(map(int, s.split(":")[1:])) for s in got.spans.split(",")]
    assert got.n_hex == 8000 and spans == [m.span() for m in re.finditer(r"[0-9a-f]{32,}", text)] and time.time() - began < 60


def test_a_ledger_grows_over_runs(spark, tmp_path):
    """Three runs over a growing history; the last one raises a rule."""
    path = str(tmp_path / "ledger")
    first = [(1, "password=abcdefgh1"), (2, "clean")]
    history = [*first, (1, "password=abcdefgh1 and token=abcdefgh2"), (3, "clean")]
    raised = (secrets.Rule("assign", 2, secrets.RULES[0].pattern, 1, 8), *secrets.RULES[1:])
    sizes = []
    for rows, rules in ((first, secrets.RULES), (history, secrets.RULES), (history, raised)):
        ledger = secrets.append_ledger(spark, path, documents(spark, rows), rules)
        sizes.append((spark.read.parquet(path).count(), ledger.count()))
        found = sorted((r.doc_id, r.spans) for r in secrets.report(secrets.findings(documents(spark, rows), ledger, rules)).collect())
    assert sizes == [(2, 2), (3, 3), (6, 3)]
    assert found == [(1, "assign:0:18"), (1, "assign:0:18,assign:23:38"), (2, ""), (3, "")]


# mixing

def test_mix_of_odd_documents(spark):
    rows = [(i, t, "ab"[(i or 0) % 2]) for i, t in ODD] + [(50, prose(50, 10), None)]
    out = mixing.mixed(documents(spark, rows), None).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    targets = {r.source_size: r.target for r in out}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(targets)) and all(t <= 2 * s + 1e-6 for s, t in targets.items())
    assert mixing.mixed(documents(spark, []), None).count() == 0


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, prose(i, 5 + i % 30), f"s{i % 7 if i % 3 else 0}") for i in range(4000)]
    out = mixing.mixed(documents(spark, rows), None).collect()
    source = {i: s for i, _, s in rows}
    by = collections.defaultdict(int)
    for r in out:
        by[source[r.doc_id], r.target] += r.taken
    assert len(by) == 7 and all(abs(t - target) <= 35 for (_, target), t in by.items())
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mixed(documents(spark, rows), None).collect()))


# line dedup

def test_repeated_passages_go_and_other_lines_stay(spark):
    passage = "\n".join(prose(100 + k, 15) for k in range(12))
    long_line = prose(77, 60)
    rows = [(i, f"{prose(i, 12)}\n{passage}\n{long_line}\n{prose(i + 50, 12)}") for i in range(4)] + [(20, prose(20, 50) + "\n" + prose(21, 9)), (21, None), (22, ""), (23, long_line), (24, "short\nshort")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    source = dict(rows)
    assert got[0].text == source[0] and got[20].text == source[20] and got[21].text is None and got[22].text == "" and got[24].text == source[24]
    assert 23 not in got  # nothing but a repeated line
    for i in (1, 2, 3):
        lines = got[i].text.split("\n")
        assert lines[0] == source[i].split("\n")[0] and lines[-1] == source[i].split("\n")[-1] and long_line not in lines
        assert len(lines) < 10 and got[i].n_chars == len(got[i].text)
        assert [x for x in source[i].split("\n") if x in set(lines)] == lines
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_line_dedup_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    seen, expected = set(), {}
    for i, text in rows:
        lines, kept = text.split("\n"), []
        removable = dict(linededup.removable(text))
        for k, (a, b) in enumerate(linededup.chunks(text)):
            if k in removable and removable[k] in seen:
                continue
            seen.add(removable.get(k))
            kept += lines[a:b]
        if "".join(kept).strip() or kept == lines:
            expected[i] = "\n".join(kept)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == expected


def test_every_repeated_run_of_lines_goes_whole(spark, sf):
    """Over plain lines, without chunks(): runs of over 50 words that stand earlier leave no line."""
    rng = random.Random(5)
    short = [prose(600 + k, rng.randrange(1, 14)) for k in range(60)]
    rows = [(0, "\n".join(short)), (1, "\n".join([prose(700, 8), *short[7:21], prose(701, 9)])), (2, "\n".join([*short[30:41], prose(702, 30), *short[30:41]])), (3, "\n".join(["a b"] * 80)), (None, "\n".join([prose(703, 7), *short[50:], prose(704, 8)])), (5, "\n".join(short[3:5]))]
    rows += [(10 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 80").collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    places, gone, cut = collections.defaultdict(list), {}, [text.split("\n") for _, text in order]
    for d, (i, text) in enumerate(order):
        lines, gone[i] = cut[d], set()
        for a, line in enumerate(lines):
            for e, f in places[line]:
                if e == d and f >= a:
                    continue
                other, k, words = cut[e], 0, 0
                while a + k < len(lines) and f + k < len(other) and lines[a + k] == other[f + k] and not (e == d and f + k >= a):
                    words += len(lines[a + k].encode().split())
                    k += 1
                if words > 50:
                    gone[i] |= set(range(a, a + k))
            places[line].append((d, a))
    got = {r.doc_id: r.text for r in linededup.dedup_passages(documents(spark, rows)).collect()}
    assert len(gone[1]) == 14 and len(gone[2]) == 22 and gone[3] and gone[0] and not gone[5] and not gone[None]
    for i, text in order:
        left, lines = got[i].split("\n") if i in got else [], text.split("\n")
        removed = [line for k, line in enumerate(lines) if k in gone[i]]
        kept = collections.Counter(lines) - collections.Counter(left)
        assert not collections.Counter(removed) - kept, i  # whole runs go; the rest is for repeated chunks only
        assert not collections.Counter(left) - collections.Counter(lines)
    for i in (None, 1, 2, 3, 5):
        assert got.get(i, "") == "\n".join(line for k, line in enumerate(dict(rows)[i].split("\n")) if k not in gone[i])


# pipeline

def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, current, sf).cache()
        assert 0 < after.count() <= current.count(), name
        assert set(docs.columns) <= set(after.columns)
        current = after
    assert current.where("copies > 2 or taken > 2 * size").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()) == sorted(r.doc_id for r in current.select("doc_id").collect())


def test_extra_columns_with_clashing_names(spark):
    docs = documents(spark, [(1, prose(1, 60)), (2, prose(1, 60)), (3, prose(3, 60))])
    for extra in ("size", "blob", "hash", "words", "block", "score", "target", "taken", "_hash", "_score"):
        docs = docs.withColumn(extra, F.lit("x"))
    bench = spark.createDataFrame([(1, ITEM, "x")], "item_id long, text string, words string")
    for kept in (jaccard.without_near_copies(docs), linededup.dedup_lines(docs), linededup.dedup_passages(docs), decontam.decontaminate(docs, bench)):
        assert kept.columns == docs.columns and all(r["_hash"] == "x" and r["size"] == "x" for r in kept.collect())
    assert mixing.mixed(docs, None).count() == 3 and secrets.scan_unseen(docs).count() == 2
    assert fingerprint.with_next(docs).count() == 3
