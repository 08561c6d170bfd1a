"""Brute-force parity and edge cases of the operators on whole texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corpus_helpers import SF, split_words
from govlake.llm import decontam, html_text, language_model, lines, neardup, private_data, suffixes, toxicity
from govlake.llm.queries import REGISTRY

EDGE = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (4, "one"), (None, "one two three four five six"),
        (5, "word " * 40000), (6, "a" * 200000), (7, "é" * 60 + "\n" + "é" * 60), (8, "one two three four five six")]


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def brute_suffixes(texts):
    """(id, text) rows in order of id -> id: (bytes, removed, runs, sha256)."""
    seen, out = defaultdict(set), []
    for i, t in texts:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for s in range(len(raw) - 49):
            w = raw[s:s + 50]
            if i is not None and any(j < i for j in seen.get(w, ())):
                cover[s:s + 50] = b"\1" * 50
        if i is not None:
            for s in range(len(raw) - 49):
                seen[raw[s:s + 50]].add(i)
        runs = sum(1 for k in range(len(raw)) if cover[k] and (k == 0 or not cover[k - 1]))
        out.append((i, len(raw), sum(cover), runs, bytes(b for b, c in zip(raw, cover) if not c)))
    return out


def test_suffix_array_is_exact(spark):
    got = {r.doc_id: tuple(r)[1:] for r in REGISTRY["op3_suffix_array"](spark, SF).collect()}
    for i, n, removed, runs, kept in brute_suffixes(sorted(documents(spark).items())):
        assert got[i] == (n, removed, runs, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_on_repetitive_texts(spark, docs, seed):
    # small alphabets, shared passages, periods, ids that repeat, nulls
    rng = random.Random(seed)
    passage = ["".join(rng.choice("abé ") for _ in range(rng.randint(45, 90))) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [rng.choice(passage) if rng.random() < .5 else "".join(rng.choice("ab") for _ in range(30))
                 for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([i, i, i // 2]), "".join(parts)))
    rows += [(50, "x" * 300), (51, "x" * 130), (52, None), (None, passage[0] * 2), (53, "ab" * 100), (54, "ba" * 100)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                  for r in suffixes.remove_repeats(docs(rows)).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert got == Counter(brute_suffixes(order))


def test_blind_trie_orders_like_sorted():
    rng = random.Random(5)
    for _ in range(200):
        rows = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randint(1, 30))]
        got = suffixes.blind_trie(rows)
        assert [rows[i] for i, _ in got] == sorted(rows)
        for (i, _), (j, c) in zip(got, got[1:]):
            assert c == next((k for k in range(12) if rows[i][k] != rows[j][k]), 12)


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = split_words(t)
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in REGISTRY["op5_minhash"](spark, SF).collect()}
    assert got == brute_components(documents(spark), 4, 80)


def test_near_duplicates_of_an_edited_family(spark, docs):
    # many edited copies around the threshold, some linked only through others
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10 ** 6)}"
        texts[i] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in neardup.near_duplicates(docs(texts.items()), k=4, percent=80).collect()}
    assert got == brute_components(texts, 4, 80)


def test_least_matches_keeps_what_may_pass():
    steps = neardup.least_matches(0.8)
    assert steps[-1][0] == neardup.HASHES
    assert all(a[1] <= b[1] for a, b in zip(steps, steps[1:]))
    assert steps[-1][1] < 0.8 * neardup.HASHES


def test_language_model_equals_plain_counts(spark):
    texts = documents(spark)
    tokens = {i: [*split_words(t), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    one, two, n_docs = Counter(), Counter(), 0
    for i, w in tokens.items():
        if not held[i]:
            n_docs += 1
            one.update(w)
            two.update(zip(["start", *w[:-1]], w))
    n, v = sum(one.values()), len(one)
    for r in REGISTRY["op4_language_model"](spark, SF).collect():
        w = tokens[r.doc_id]
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score, c, before = 0.0, n_docs, "start"
        for x in w:
            g = language_model.GAMMA * c / (c + language_model.KAPPA)
            score += math.log10(g * two[before, x] / max(c, 1) + (1 - g) * (one[x] + 1) / (n + v + 1))
            c, before = one[x], x
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == \
            (held[r.doc_id], len(w), sum(one[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9)


def test_decontamination_equals_brute_force(spark):
    items = {r.item_id: split_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {}
    for i, t in documents(spark).items():
        text = " " + " ".join(split_words(t)) + " "
        hit = [k for k, w in items.items() if any(f" {' '.join(w[s:s + 13])} " in text
                                                   for s in range(max(1, len(w) - 12)))]
        if hit:
            want[i] = sorted(hit)
    got = {r.doc_id: list(r["items"]) for r in REGISTRY["op6_decontamination"](spark, SF).collect()}
    assert got == want


def test_decontamination_tolerates_substitutions(spark, docs):
    item = [f"w{i}" for i in range(20)]
    edited = list(item)
    edited[6] = edited[14] = "zz"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "a b c")], "item_id bigint, text string")
    rows = [(1, "left " + " ".join(edited) + " right"), (2, " ".join(f"v{i}" for i in range(30))),
            (3, "x A B C y"), (4, " ".join(item[:8])), *[(10 + i, t) for i, t in EDGE if i]]
    got = {r.doc_id: list(r["items"]) for r in decontam.contamination(docs(rows), bench).collect()}
    assert got.get(1) == [1] and set(got) <= {1, 3}


def test_decontamination_finds_every_allowed_substitution(spark, docs):
    # whole items of 1 to 12 words and windows of 13 with all sets of allowed substitutions, in longer documents
    from itertools import combinations
    rows, want, items = [], {}, []
    for n in range(1, 14):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        spare = max(m for m in range(n) if n - m >= decontam.MIN_EQUAL * n)
        for gone in combinations(range(n), spare):
            text = ["left"] * 5 + ["zz" if i in gone else x for i, x in enumerate(item)] + ["right"] * 5
            want[len(rows)] = [n]
            rows.append((len(rows), " ".join(text)))
        if spare + 1 < n:
            rows.append((len(rows), " ".join(["left"] * 5 + ["zz"] * (spare + 1) + item[spare + 1:] + ["right"] * 5)))
    rows += [(1000, "x A B C y"), (1001, "a b")]
    bench = spark.createDataFrame([*items, (50, "a b c"), (51, None), (52, "")], "item_id bigint, text string")
    got = {r.doc_id: list(r["items"]) for r in decontam.contamination(docs(rows), bench).collect()}
    assert got == want | {1000: [50]}


PATTERNS = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19
             and private_data.luhn(d)),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15))


def brute_spans(text):
    out = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m[0])]
    return [(s, e, private_data.KINDS[k]) for s, k, e in sorted(out)]


def test_base_spans_on_random_texts():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice("a1@.+- (9x2") for _ in range(rng.randint(0, 30)))
        assert private_data.base_spans(t) == brute_spans(t)


def test_private_data_equals_brute_force(spark):
    texts = documents(spark)
    for r in REGISTRY["op2_private_data"](spark, SF).collect():
        base = brute_spans(texts[r.doc_id])
        text = private_data.span_text(base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        kinds = Counter(k for _, _, k in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in private_data.KINDS[:4])
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_patterns_discover_unseen_values(spark, docs):
    rows = [(i, f"my password={hashlib.md5(str(i).encode()).hexdigest()[:18]} ok") for i in range(20)]
    rows += [(100, "my password=hunter2zz99 ok"), (101, "built in release9 now"), (102, None)]
    got = {r.doc_id: r.spans for r in private_data.find_private_data(docs(rows)).collect()}
    assert got[100] == "secret:12:23" and got[101] == "" and got[102] == ""


def test_toxicity_learns_words_it_was_not_told(spark):
    rng = random.Random(4)
    clean = [f"w{i}" for i in range(300)]

    def text(bad):
        w = [rng.choice(clean) for _ in range(40)]
        return " ".join(w[:20] + (["grumbleface", rng.choice(clean)] if bad else []) + w[20:])

    rows = [(i, text(i % 5 == 0), i % 5 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    for i, t, y in rows:
        assert (got[i].toxicity >= 0.3) == y
        if y:
            s, e = map(int, got[i].toxic_spans.split(",")[0].split(":"))
            assert t[s:e] == "grumbleface"


def test_toxicity_long_texts_take_no_place_in_the_sample(spark):
    # the documents of a class that its hash order would choose first are all too long
    rng = random.Random(6)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(800)], "doc_id bigint, toxic int")
    order = labels.selectExpr("doc_id", "toxic", "xxhash64(doc_id) AS h").filter("crc32(string(doc_id)) % 4 != 2")
    long = {r.doc_id for y in (0, 1) for r in order.filter(f"toxic = {y}").orderBy("h").limit(120).collect()}

    def text(i):
        w = [f"w{rng.randrange(200)}" for _ in range(300 if i in long else 30)]
        return " ".join(w[:15] + ["grumbleface"] * (i % 2) + w[15:])

    docs = spark.createDataFrame([(i, text(i)) for i in range(800)], "doc_id bigint, text string")
    model = toxicity.train(docs, labels, fit_docs=120, text_bytes=500)
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, model).collect()}
    short = [i for i in range(800) if i not in long]
    assert min(got[i] for i in short if i % 2) > max(got[i] for i in short if not i % 2)


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np
    rng = np.random.default_rng(1)
    s, trans, start = rng.normal(size=5), rng.normal(size=(2, 2)), 0.3
    weight = np.zeros((5, 2))
    for states in itertools.product((0, 1), repeat=5):
        p = start * states[0] + sum(x * z for x, z in zip(s, states))
        p += sum(trans[a][b] for a, b in zip(states, states[1:]))
        for t, z in enumerate(states):
            weight[t, z] += math.exp(p)
    got = toxicity.forward_backward(s, np.array([0, 5, 5]), start, trans)[2]
    assert got == pytest.approx(weight[:, 1] / weight.sum(1))


def test_line_dedup_edges(docs):
    long = "This line is longer than forty code points, so it counts."
    rows = [(i, f"own {i}\n  {long.upper() if i % 2 else long}\t\nshort") for i in range(6)]
    rows += [(6, f"{long}\n{long}"), (None, long), (8, None), (9, "")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in lines.drop_repeated_lines(docs(rows)).collect()}
    assert got[0] == (3, 1, "own 0\nshort") and got[5] == (3, 1, "own 5\nshort")
    assert got[6] == (2, 0, f"{long}\n{long}") and got[None] == (1, 0, long)
    assert got[8] == got[9] == (1, 0, "")


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a="<p>";</script></head><body>
<nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>{lead}
<article><header><h1>A &lt;b&gt; title</h1></header><p>First &nbsp; par<b>t</b>.<p>Second<br>line
<div class="ad">Buy</div><form><input>Send</form></article>{open}
<div id="comments"><p>Nice!</p></div><aside>More</aside><footer>&copy; us</footer></body></html>"""


def test_html_extraction(spark):
    def own(i):
        return " ".join(f"own{i}{w}" for w in "abcdefgh")

    shared = "<div>All pages of this host carry this very sentence</div>"
    rows = [(i, "http://h.example/x", PAGE.format(lead="", open=f"{shared}<div>{own(i)}</div>"))
            for i in range(3)]
    rows += [(10, None, None), (11, "http://h.example/", ""), (12, "http://other.example", shared),
             (13, "http://h.example/", "<p>x" + "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for i in range(3):
        assert got[i] == f"A <b> title\nFirst part.\nSecond\nline\n{own(i)}"
    assert got[10] == got[11] == "" and got[12].startswith("All pages") and got[13] == "x\ndeep"


def test_html_repeats_follow_the_host(spark):
    # pages without an article: a phrase of 6 words on 2 of 40 pages, two copies of a page, a footer on all
    def own(i, n=30):
        return " ".join(f"w{i}x{j}" for j in range(n))

    phrase = "at the end of the day"
    foot = "<div>All rights reserved by us</div>"
    rows = [(i, "http://big.example/", f"<div>{own(i)} {phrase if i < 2 else ''} {own(i)}</div>{foot}")
            for i in range(40)]
    rows += [(50 + i, "http://big.example/", f"<div>{own(99)}</div>{foot}") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[0] == f"{own(0)} {phrase} {own(0)}" and got[39] == f"{own(39)} {own(39)}"
    assert all(got[50 + i] == own(99) for i in range(8))


def test_html_article_inside_a_wrapper():
    page = html_text.page_blocks
    article = "<article><p>Text</p><div class=ad>Buy</div></article>"
    assert page(f"<form><b>Log in</b>{article}Send</form>") == \
        [("chrome", "Log in"), ("main", "Text"), ("chrome", "Buy"), ("chrome", "Send")]
    assert page(f"<div class=has-menu>{article}</div><div>Rest</div>") == \
        [("main", "Text"), ("chrome", "Buy"), ("open", "Rest")]
    for other in ("<aside>{}</aside>", "<div id=comments>{}</div>", "<form>{}</form><main>Own</main>"):
        assert ("main", "Text") not in page(other.format(article))


def test_html_extraction_of_given_pages(spark):
    import html
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in REGISTRY["op1_html_extraction"](spark, SF).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(b.replace("<b>", "").replace("</b>", ""))).strip()
                  for b in re.split(r"</?(?:p|h1|br)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (r.text, r.n_chars) == (want, len(want))


TEXT_OPERATORS = {
    "suffixes": lambda d: suffixes.remove_repeats(d),
    "neardup": lambda d: neardup.near_duplicates(d),
    "lm": lambda d: language_model.score_documents(d),
    "lines": lambda d: lines.drop_repeated_lines(d),
    "private": lambda d: private_data.find_private_data(d),
}


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_edge_rows_give_one_row_each(docs, name):
    out = TEXT_OPERATORS[name](docs(EDGE))
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in EDGE)


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_empty_tables(docs, name):
    assert TEXT_OPERATORS[name](docs([])).collect() == []


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, None)], "doc_id bigint, toxic int")
    for rows in ([], EDGE):
        model = toxicity.train(docs(rows), labels)
        out = toxicity.score_toxicity(docs(rows), model).collect()
        assert len(out) == len(rows) and all(0 <= r.toxicity <= 1 for r in out)


def test_one_id_on_two_texts_loses_no_link(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "something else of its own here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}
    # an id that joins two groups only by standing in both
    df = spark.createDataFrame([(5, a), (9, a), (9, b), (6, b), (7, b + " more")], "doc_id bigint, text string")
    assert {r.component_id for r in neardup.near_duplicates(df).collect()} == {5}


def test_line_dedup_survives_any_column_name(spark):
    line = "a line that is long enough to be counted as one key"
    df = spark.createDataFrame([(i, line, "mine", "d", 1) for i in range(5)],
                               "doc_id bigint, text string, _id string, _drops string, h1 int")
    out = lines.drop_repeated_lines(df)
    assert {(r.doc_id, r.kept_text, r["_id"], r["_drops"], r.h1) for r in out.collect()} == {
        (i, line if i == 4 else "", "mine", "d", 1) for i in range(5)}


def test_patterns_discover_what_no_seed_matches(spark):
    rng = random.Random(6)

    def key():
        return "".join(rng.choice("0123456789abcdef") for _ in range(20))

    texts = [f"note {i} access code: {key()} ends" for i in range(30)]
    texts += ["note access code: Zx81-Qw77-Tr55 ends", "note access code: hunter2hunter2 ends",
              "upper DEADBEEF12345678 alone", "no digits access code: none here", "deadbeefdeadbeef0 starts it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in private_data.find_private_data(df).collect()}
    assert all(got[i].spans.startswith("secret:") and got[i].n_discovered == 0 for i in range(30))
    for i in (30, 31):
        at = texts[i].index(": ") + 2
        assert got[i].spans == f"secret:{at}:{texts[i].index(' ends')}" and got[i].n_discovered == 1
    assert got[32].spans == "secret:6:22" and got[33].spans == "" and got[34].spans == "secret:0:17"


def test_blocks_follow_the_bytes(spark, monkeypatch):
    # many small blocks give the same results as few
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    before = {r.doc_id: r.score for r in language_model.score_documents(df).collect()}
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(df).collect()}
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3000)
    after = {r.doc_id: r.score for r in language_model.score_documents(df).collect()}
    assert after == pytest.approx(before)
    assert {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(df).collect()} == kept
