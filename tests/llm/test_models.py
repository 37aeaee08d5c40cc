"""Language, quality, fingerprints, shards, main text and packing over edge cases."""

import hashlib
import random
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from colscope.llm import html_tree
from colscope.llm.fingerprint import Powers, fingerprint_edits, hex_of, likeness, lz_phrases, signature
from colscope.llm.html_tree import extract, labelled_pages, main_text, marginals, parse, trained
from colscope.llm.language import Profiles, identify, learn_profiles, out_of_place, ranked, count_grams
from colscope.llm.packing import WordIds, match, pack
from colscope.llm.quality import dual_coordinate_descent, features, fit, score_quality, train_quality, unpack
from colscope.llm.quality import pack as pack_row
from colscope.llm.queries import tokenizer_path
from colscope.llm.sharding import grid, permute, shard

from .data import empty, frame, rows, words


def language_rows(n=240):
    rnd = random.Random(2)
    parts = {"aa": "the of and ing tion er wh".split(), "bb": "der die sch ung ein ß ü".split(), "cc": "que ción los ñ as ería".split()}
    return [(i, " ".join("".join(rnd.choices(parts[lang], k=rnd.randint(1, 3))) for _ in range(rnd.randint(3, 60))), lang) for i, lang in ((i, list(parts)[i % 3]) for i in range(n))]


def test_language(spark):
    df = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    profiles = learn_profiles(df)
    assert profiles.langs == ["aa", "bb", "cc"]
    truth = {r[0]: r[2] for r in language_rows()}
    got = identify(df, profiles).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    edge = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(frame(spark, [None, "", "123 !?", "der die sch", "x" * 50_000]), profiles).collect() if r["doc_id"] is not None}
    assert edge[0] == edge[1] == edge[2] == ("und", 0.0) and edge[3][0] == "bb" and edge[4][0] in profiles.langs
    nothing = learn_profiles(empty(spark))
    assert nothing.langs == [] and {r["lang_pred"] for r in identify(df.limit(3), nothing).collect()} == {"und"}
    assert identify(empty(spark), profiles).count() == 0


def test_language_counts_match_brute_force(spark):
    df = spark.createDataFrame(language_rows(60), "doc_id long, text string, lang string")
    profiles = learn_profiles(df)
    counts = {lang: Counter() for lang in profiles.langs}
    for i, t, lang in language_rows(60):
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for w in t.lower().split():
                p = f" {w} "
                counts[lang].update(p[k : k + n] for n in (1, 2, 3) for k in range(len(p) - n + 1) if p[k : k + n] != " ")
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    for column, lang in enumerate(profiles.langs):
        want = sorted(counts[lang], key=lambda g: (-counts[lang][g], code(g)))[:400]
        got = {int(g): int(r) for g, r in zip(profiles.grams, profiles.ranks[:, column], strict=True) if r < 400}
        assert got == {code(g): k for k, g in enumerate(want)}


def test_identify_matches_brute_force(spark):
    data = language_rows(90) + [(500, "der ½ die² Ⅷ sch① x1y", "bb"), (501, "½ ² Ⅷ ① 7", None), (502, "É É é", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    profiles = learn_profiles(df)
    names = {lang: {int(g): int(r) for g, r in zip(profiles.grams, profiles.ranks[:, k], strict=True) if r < 400} for k, lang in enumerate(profiles.langs)}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df, profiles).collect()}
    for i, t, _ in data:
        counts = Counter()
        for w in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split():
            p = f" {w} "
            counts.update(p[k : k + n] for n in (1, 2, 3) for k in range(len(p) - n + 1) if p[k : k + n] != " ")
        code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
        top = sorted(counts, key=lambda g: (-counts[g], code(g)))[:400]
        if not top:
            assert got[i] == ("und", 0.0)
            continue
        far = {lang: sum(abs(known[code(g)] - k) if code(g) in known else 400 for k, g in enumerate(top)) / (400 * len(top)) for lang, known in names.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert got[i] == (best, 1.0 - far[best])


def test_out_of_place():
    p = Profiles(["a"], np.array([1, 2, 3]), np.array([[0], [1], [2]]))
    assert out_of_place(np.array([1, 2, 3]), p)[0] == 0
    assert out_of_place(np.array([3, 9]), p)[0] == (2 + 400) / 800
    codes, n = count_grams(["ab", "ab", "c"])
    assert ranked(codes, n)[0] in codes and n.sum() == 2 * (2 + 3 + 2) + 1 + 2 + 1


def test_quality(spark):
    rnd = random.Random(6)
    docs, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        w = words(rnd, rnd.randint(5, 60))
        docs.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "en"))
        if i % 2:
            labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (7, None, 0), (999, 1, 1)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train_quality(d, lab)
    got = score_quality(d, model).collect()
    assert np.mean([(r["doc_id"] % 3 > 0) == (r["predicted"] == 1) for r in got]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    edge = score_quality(frame(spark), model)
    assert edge.count() == len(rows()) and edge.columns[-2:] == ["score", "predicted"] and edge.where("score is null").isEmpty()
    assert score_quality(empty(spark), model).count() == 0
    flat = train_quality(d, lab.limit(0))
    assert len({r["score"] for r in score_quality(d, flat).collect()}) == 1


def test_labels_of_any_kind(spark):
    """Wide labels, contradicting labels, one doc_id that repeats many times, and texts beyond a batch."""
    rnd = random.Random(8)
    docs = [(i, " ".join(words(rnd, 20)) if i % 2 else " ".join(x.upper() + "!" for x in words(rnd, 20))) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    many = d.unionAll(spark.range(100_000).selectExpr("3L AS doc_id", "'the same row again and again' AS text"))
    labels = [(i, i % 2) for i in range(60)]
    wide = spark.createDataFrame(labels, "doc_id long, quality long")
    a, b = train_quality(d, wide), train_quality(many, wide.withColumn("quality", F.col("quality").cast("double")))
    assert a.weights.shape == b.weights.shape and np.mean([(r["predicted"] == 1) == (r["doc_id"] % 2 == 1) for r in score_quality(d, b).collect()]) > 0.9
    torn = spark.createDataFrame(labels + [(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    none = spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, quality int")
    assert train_quality(d, torn).bias == train_quality(d, none).bias and np.array_equal(train_quality(d, torn).weights, train_quality(d, none).weights)
    assert np.array_equal(train_quality(d.repartition(7), wide).weights, a.weights)
    few = train_quality(d, wide, train_rows=10)
    assert not np.array_equal(few.weights, a.weights)


def test_features_of_long_texts_stay_apart():
    rnd = np.random.default_rng(3)
    x, y = (rnd.choice(np.frombuffer(letters, np.uint8), 3_000_000).tobytes() for letters in (b"abcdefgh ", b"stuvwxyz "))
    a, b = features(x), features(y)
    assert len(np.intersect1d(a, b)) < 0.2 * len(a) and np.array_equal(unpack(pack_row(a)), a)
    dense = np.arange(0, 1 << 18, 3, dtype=np.int32)
    assert len(pack_row(dense)) == 1 << 15 and np.array_equal(unpack(pack_row(dense)), dense)


def test_dual_coordinate_descent_separates():
    rnd = np.random.default_rng(1)
    made = [np.sort(rnd.choice(50, 8, replace=False) + (0 if i % 2 else 50)).astype(np.int32) for i in range(60)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    w, b = dual_coordinate_descent(made, np.arange(60), np.ones(1 << 18), y)
    assert all((w[f].sum() + b) * t > 0 for f, t in zip(made, y, strict=True))
    assert fit([], np.zeros(0)).score(features(b"x")) == 0.5


def test_dual_coordinate_descent_reaches_the_optimum():
    """The gap between primal and dual objective closes, and the weights equal those of plain projected gradient steps."""
    rnd = np.random.default_rng(4)
    made = [np.sort(rnd.choice(20, 6, replace=False)).astype(np.int32) for _ in range(40)]
    y = np.where(rnd.random(40) < 0.5, 1.0, -1.0)
    ratio = rnd.normal(size=20)
    w, b = dual_coordinate_descent(made, np.arange(40), ratio, y, epochs=3000)
    x = np.zeros((40, 21))
    for i, f in enumerate(made):
        x[i, f] = ratio[f] / np.linalg.norm(ratio[f])
        x[i, 20] = 1.0
    full = np.append(w, b)
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(40)
    for _ in range(40_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, 1)
    primal = full @ full / 2 + np.maximum(0, 1 - y * (x @ full)).sum()
    dual = alpha.sum() - alpha @ q @ alpha / 2
    assert abs(primal - dual) < 1e-3 and np.allclose(full, (alpha * y) @ x, atol=1e-2)


def phrases(text):
    seen, s = set(), 0
    for e in range(1, len(text) + 1):
        if text[s:e] not in seen:
            seen.add(text[s:e])
            s = e
    return seen


def chain(data):
    """(id, text) in descending id, nulls last, then by descending hash of the text."""
    known = {t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ (1 << 63)) - (1 << 63) if t is not None else 42 for _, t in {r[:2] for r in data}}
    return sorted(((r[0], r[1]) for r in data), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, known[x[1]]), reverse=True)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_of_many_equal_rows(spark, kind):
    """Copies of one row, many texts of one id, null ids, and ids that are text."""
    rnd = random.Random(3)
    data = [(7, "the same text again and again")] * 700 + [(None, None)] * 300 + [(9, " ".join(words(rnd, 5))) for _ in range(200)] + [(None, f"x{i}") for i in range(50)] + [(i, " ".join(words(rnd, 9))) for i in range(20)]
    data = [(None if i is None else i if kind == "long" else f"é{i}", t) for i, t in data]
    order = chain(data) if kind == "long" else None
    rnd.shuffle(data)
    got = fingerprint_edits(spark.createDataFrame(data, f"doc_id {kind}, text string").repartition(6), 5).collect()
    if order is None:
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in data)
        return
    powers, want = Powers(), Counter()
    for k, (i, t) in enumerate(order):
        own, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(own) // 3
        edited = own[: len(own) - third] + after[:third]
        sig, other, nxt = (signature(x, lz_phrases(x), powers) for x in (own, edited, after))
        want[i, len(own), hashlib.sha256(edited.encode()).hexdigest(), hex_of(sig), hex_of(other), likeness(sig, other), likeness(sig, nxt)] += 1
    assert Counter(tuple(r) for r in got) == want


def test_fingerprints(spark):
    df = frame(spark)
    data = [(i, t or "") for i, t in chain(rows())]
    for parts in (1, 5):
        got = sorted(fingerprint_edits(df, parts).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0), reverse=True)
        assert len(got) == len(data)
        powers = Powers()
        for k, ((i, text), r) in enumerate(zip(data, got, strict=True)):
            after = data[(k + 1) % len(data)][1]
            third = len(text) // 3
            edited = text[: len(text) - third] + after[:third]
            assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
            sig, other, nxt = (signature(t, lz_phrases(t), powers) for t in (text, edited, after))
            assert (r["fingerprint"], r["edited_fingerprint"]) == (hex_of(sig), hex_of(other))
            assert (r["near_edited"], r["near_next"]) == (likeness(sig, other), likeness(sig, nxt))
            a, b = phrases(text), phrases(edited)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r["near_edited"] - true) < (0.2 if len(a | b) > 128 else 1e-9)
    assert fingerprint_edits(empty(spark)).count() == 0
    alone = fingerprint_edits(spark.createDataFrame([(1, "abcabc")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 99, 1000, 4097])
def test_permutation(n):
    y = permute(np.arange(n), n, 7)
    assert sorted(y.tolist()) == list(range(n))
    a, b = grid(n)
    assert n <= a * b < n + a


def test_shards(spark):
    got = shard(frame(spark), shards=7).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert {r["law"] for r in got} == {"rows"} and all(r["grown_shard"] is None for r in got)
    again = shard(frame(spark).repartition(5), shards=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert shard(empty(spark)).count() == 0
    many = shard(spark.createDataFrame([(None, None)] * 50, "doc_id long, text string"), shards=3).collect()
    assert Counter(r["shard"] for r in many) == {0: 17, 1: 17, 2: 16}


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><p>Site head.</p></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><main><article><h1>Big &amp; small</h1><p>First  para<b>graph</b> here.<br>Second line &eacute;&#33; It goes on for a while.</p><script>var a="<p>x</p>";</script>
<ul><li>One thing that is said.</li><li>Another thing that is said.</li></ul><p>Unclosed paragraph text here.</article><aside class=sidebar><p>Read also this.</p></aside></main>
<section class="comments"><p>I liked this very much, thanks.</p></section><form><p>Sign up now.</p></form><footer>&copy; 2020 us</footer></body></html>"""
    want = "Big & small First paragraph here. Second line é! It goes on for a while. One thing that is said. Another thing that is said. Unclosed paragraph text here."
    assert main_text(page, trained()) == want
    bad = ["", None, "<", "<p", "plain words only", "<!-- never ends", "<div><p>a</div></p></b>", "<script>x", "&nosuch; &lt;p&gt;", "<p>" * 3000]
    df = spark.createDataFrame([(i, "u", h, "x", "y") for i, h in enumerate([page, *bad])] + [(None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars string")
    got = extract(df).collect()
    assert len(got) == len(bad) + 2 and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["text"] for r in got if r["page_id"] == 0} == {want}
    assert extract(df.limit(0)).count() == 0


def held_out_share(naming):
    hit = total = 0
    for p in labelled_pages(60, 77, naming):
        probability, _ = marginals(p, trained())
        for k, text in p.runs:
            total += len(text)
            hit += len(text) * ((probability[k] > 0.5) == bool(p.nodes[k].mark))
    return hit / total


def test_html_held_out():
    assert held_out_share("plain") > 0.97


def test_html_held_out_without_names():
    assert held_out_share("none") > 0.9 and held_out_share("odd") > 0.9


def test_main_text_is_the_article():
    """Pages of the driver: what stands in their article element, read by another parser."""

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.skipped, self.out = False, 0, []

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.skipped += tag in ("script", "style")
            self.out.append(" " if tag in ("br", "p", "h1", "h2", "h3", "li", "ul", "div") and self.inside else "")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.skipped -= tag in ("script", "style")

        def handle_data(self, data):
            self.out.append(data if self.inside and not self.skipped else "")

    for source in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        page = Article()
        page.feed(source)
        page.close()
        assert main_text(source, trained()) == " ".join("".join(page.out).split())


def test_marginals_are_exact():
    page = parse("<div class=ad><p>a b.</p><ul><li><a>x</a></li></ul></div><p>c d e.</p>")
    n, model = len(page.nodes), trained()
    score = [sum(model.weights.get(f, 0.0) for f in html_tree.features(x)) for x in page.nodes]
    total, one = 0.0, [0.0] * n
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        w = np.exp(sum(s for s, b in zip(score, y, strict=True) if b) + sum(model.edges[2 * y[page.nodes[i].parent] + y[i]] for i in range(1, n)))
        total += w
        for i in range(n):
            one[i] += w * y[i]
    assert np.allclose(marginals(page, model)[0], [x / total for x in one])


def test_tokens_equal_the_tokenizer():
    ids = WordIds(tokenizer_path())
    rnd = random.Random(3)
    letters = [*"abcABC zZ'st're12²½é É\n\t\x0b\x1c\x1f\x85\xa0　 ​_-!?.,ßİΣσς́̀nñ漢字😀ﬁK", "<|endoftext|>", "<|STARTOFTEXT|>", "'LL", "the, ", "And. "]
    for _ in range(4000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 16)))
        assert np.frombuffer(ids.ids(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing(spark):
    ids = WordIds(tokenizer_path())
    data = [(r[0], r[1] or "") for r in rows()]
    got = pack(frame(spark), tokenizer_path(), 500, with_ids=True).collect()
    want = Counter()
    for i, t in data:
        whole = [*ids.tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(whole), 500)):
            part = whole[at : at + 500]
            want[i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), tuple(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 500
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 500) + 1
    assert pack(empty(spark), tokenizer_path()).count() == 0


def test_best_fit_plan():
    rnd = np.random.default_rng(5)
    for _ in range(30):
        sizes = rnd.integers(1, 65, rnd.integers(1, 200))
        counts = Counter(sizes.tolist())
        plan, fill = match(counts, 64), Counter()
        for size, n in counts.items():
            for s, o in zip(*plan.place(np.full(n, size), np.arange(n)), strict=True):
                fill[int(s)] += size
                assert o + size <= 64
        assert len(fill) == plan.sequences and max(fill.values()) <= 64
        assert plan.sequences <= best_fit(sorted(sizes.tolist(), reverse=True), 64) + 1


def best_fit(sizes, length):
    """Sequences that plain best fit opens: each piece goes into the smallest gap that holds it."""
    gaps, opened = [], 0
    for size in sizes:
        at = bisect_left(gaps, size)
        if at == len(gaps):
            opened += 1
            gap = length
        else:
            gap = gaps.pop(at)
        insort(gaps, gap - size)
    return opened


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><semantics><annotation>tex</annotation></semantics></math> holds.</p>", ["So x=2 holds."]),
        ("<p>See <object data=a><b>the</b> text</object> here.</p>", ["See the text here."]),
        ("<p>A <svg><title>t</title><path d='x'/><g><text>mark</text></g></svg> stands.</p><p>Next.</p>", ["A mark stands.", "Next."]),
        ("<p>One.<svg><path></p><p>Two.</p>", ["One.", "Two."]),
        ("<p>One.<object></p><div>Two.</div>", ["One.", "Two."]),
        ("<p>One.</p><template><p>Two.</p><iframe><p>Three.</p>", ["One.", "Two.", "Three."]),
        ("<p>One.</p><script/>var x=1;</script><p>Two.</p><style/>p{}</style><div/>Three.</div>", ["One.", "Two.", "Three."]),
        ("<p>A <svg><script/><title/><text>b</text><path/></svg> c.</p><math/><p/>D.", ["A b c.", "D."]),
        ("<p>One.</p><iframe>no frames</iframe><template><p>x</p></template><p>Two.</p><script>x", ["One.", "Two."]),
    ],
)
def test_text_of_formulas_and_unclosed_elements_stays(source, text):
    assert [t for _, t in parse(source).runs] == text
