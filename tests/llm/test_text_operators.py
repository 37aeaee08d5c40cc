"""Line dedup, containment, n-gram join and suffix dedup against brute force over edge cases."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from colscope.llm import jaccard, suffix_dedup
from colscope.llm.components import components
from colscope.llm.decontaminate import contained_items
from colscope.llm.jaccard import Block, jaccard_components, linked
from colscope.llm.line_dedup import line_dedup
from colscope.llm.suffix_dedup import remove_repeats, repeated_windows, suffix_array

from .data import empty, frame, rows, texts, words


def brute_lines(data):
    """kept text per (id, text), first occurrence by id (nulls last) and MD5 of the text."""
    keys = {(i is None, i, t) for i, t in data if t is not None}
    order = sorted(keys, key=lambda k: (k[0], k[1] if k[1] is not None else 0, hashlib.md5(k[2].encode()).hexdigest()))
    first, later = {}, defaultdict(set)
    for key in order:
        ls = key[2].split("\n")
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if w in first:
                later[key[1], key[2]] |= {p, p + 1, p + 2}
            else:
                first[w] = key
    return {(k[1], k[2]): "\n".join(x for i, x in enumerate(k[2].split("\n")) if i not in later[k[1], k[2]]) for k in keys}


def test_line_dedup(spark):
    data = [(r[0], r[1]) for r in rows()]
    want = brute_lines(data)
    got = line_dedup(frame(spark)).collect()
    assert len(got) == len(data)
    inputs = {r[0]: r[1] for r in rows()}
    for r in got:
        before = inputs[r["doc_id"]]
        assert r["text"] == (None if before is None else want[r["doc_id"], before])
        n = 0 if before is None else len(before.split("\n"))
        assert r["n_lines"] == n
        assert r["n_removed"] == sum(e - s for s, e in r["spans"])
        assert r["score"] == (0.5 if r["doc_id"] is not None else None)
    assert line_dedup(empty(spark)).count() == 0


def test_line_windows_overlap(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb")], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], [tuple(s) for s in r["spans"]]) for r in line_dedup(df).collect()}
    assert out == {1: ("a\nb\nc\nd\ne", []), 2: ("x\ny", [(1, 5)]), 3: ("a\nb", [])}


def test_line_dedup_orders_texts_of_one_id(spark):
    data = [(1, f"{c}\nb\nc\nd\ne{c}") for c in "pqrstuv"] + [(0, "no lines"), (None, "p\nb\nc\nd\nq")]
    want = brute_lines(data)
    got = line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), want[i, t]) for i, t in data)


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def test_containment(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(words(rnd, n))) for i, n in enumerate((12, 30, 4, 2, 7, 5))] + [(90, None), (91, ""), (92, "  ")]
    big = " ".join(words(rnd, 900))
    broken = items[1][1].split()
    broken[15] = "zzz"
    worse = items[1][1].split()
    worse[10] = worse[20] = "zzz"
    docs = [(0, big + " " + items[0][1].upper() + " " + big), (1, " ".join(broken)), (2, " ".join(worse)), (3, "q " + items[2][1] + " q"), (4, items[3][1]), (5, None), (6, ""), (None, items[4][1]), (7, items[5][1]), (7, items[5][1])]
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"]) for r in contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            w = len((x or "").split())
            need = shingle_set(x, min(w, 5)) if w else frozenset()
            have = shingle_set(t, min(w, 5)) if w and len((t or "").split()) >= min(w, 5) else frozenset()
            if need and len(need & have) >= 0.75 * len(need):
                want[d, i] = (len(need), len(need & have))
    assert got == want and (0, 0) in got and (1, 1) in got and (2, 1) not in got


def test_texts_of_one_item_id_never_add_up(spark):
    rnd = random.Random(6)
    a, b = words(rnd, 12), words(rnd, 12)
    items = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (None, " ".join(a[:7])), (2, "one two"), (2, "one two three")]
    docs = [(0, " ".join(a + b)), (1, " ".join(a[:7] + ["x"] + b[:7])), (2, " ".join(a[:7])), (3, "one two x three"), (4, "a one two three z")]
    want = []
    for d, t in docs:
        for i, x in set(items):
            n = min(len(x.split()), 5)
            need, have = shingle_set(x, n), shingle_set(t, n) if len(t.split()) >= n else frozenset()
            if len(need & have) >= 0.75 * len(need):
                want.append((d, str(i), len(need), len(need & have)))
    got = [(r["doc_id"], str(r["item_id"]), r["n_shingles"], r["n_found"]) for r in contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got) == sorted(want)
    assert sum(g[:2] == (0, "1") for g in got) == 2 and not any(g[0] == 1 and g[1] == "1" for g in got)


def test_containment_without_rows(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contained_items(empty(spark), items).count() == 0
    assert contained_items(frame(spark), items.limit(0)).count() == 0


def brute_components(ts):
    sets = [shingle_set(t) for t in ts]
    parent = list(range(len(ts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ts)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(sets[i]), find(i)) for i in range(len(ts))]


@pytest.mark.parametrize("block_tokens", [jaccard.BLOCK_TOKENS, 60])
def test_jaccard_components(spark, block_tokens):
    rnd = random.Random(11)
    ts = texts()
    base = words(rnd, 60)
    for _ in range(25):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = rnd.choice(base)
        ts.append(" ".join(w[: rnd.randint(40, 60)]))
    df = frame(spark, ts)
    got = jaccard_components(df, block_tokens=block_tokens).collect()
    want = brute_components(ts)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted([(i, *w) for i, w in enumerate(want)] + [(len(ts) - 1, *want[-1])])
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [want[7][1]]
    assert jaccard_components(empty(spark)).count() == 0


def test_shingles_of_long_texts(monkeypatch):
    """Texts and words longer than what is hashed at a time have the shingles that they have in one piece."""
    rnd = random.Random(2)
    ts = [" ".join(words(rnd, 900)), "x" * 700, "a " + "y" * 900 + " b c\td " + "z" * 40, " " * 300 + "q", ""]
    whole = [jaccard.shingles(t.encode()) for t in ts]
    monkeypatch.setattr(jaccard, "CHUNK", 64)
    monkeypatch.setattr(jaccard, "_powers", {})
    for t, want in zip(ts, whole, strict=True):
        assert np.array_equal(jaccard.shingles(t.encode()), want) and len(want) == len(shingle_set(t))
    assert len(jaccard._powers["up"]) == 128


def flat(sets):
    return np.array([len(x) for x in sets]), np.concatenate(sets)


def test_divide_skip_is_exact(monkeypatch):
    monkeypatch.setattr(jaccard, "MERGED", 900)
    rnd = np.random.default_rng(2)
    for k in range(60):
        base = rnd.permutation(400)[:80]
        sets = [np.unique(np.where(rnd.random(80) < 0.12, rnd.integers(400, 900, 80), base)[: rnd.integers(40, 81)]) for _ in range(14)]
        sizes = np.array([len(s) for s in sets])
        apart = np.arange(14) < 5 if k % 2 else None
        block = Block(sizes, *flat(sets), apart)
        queries, got = np.arange(block.apart, 14), set()
        for first in (True, False):
            for q, r in block.search(queries, *block.reach(queries, first)):
                got |= set(zip(q.tolist(), r.tolist(), strict=True))
        mine = [set(sets[i]) for i in block.order]
        assert got == {(q, r) for q in queries for r in range(q) if linked(len(mine[q] & mine[r]), len(mine[q]), len(mine[r]))}


@pytest.mark.parametrize("labelled", [False, True])
def test_link_records_is_exact(labelled):
    rnd = np.random.default_rng(5)
    for _ in range(80):
        centres = [rnd.permutation(60)[:24] for _ in range(rnd.integers(1, 5))]
        sets = [np.unique(np.where(rnd.random(24) < rnd.choice([0.02, 0.1, 0.3]), rnd.integers(0, 90, 24), centres[rnd.integers(len(centres))])[: rnd.integers(12, 25)]) for _ in range(rnd.integers(1, 40))]
        n = len(sets)
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        pairs = [(i, j) for i in range(n) for j in range(i) if linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
        labels = np.arange(n) + 500
        for i, j in pairs[:: 3 if labelled else len(pairs) + 1]:
            labels[labels == labels[i]] = labels[j]
        for i, j in pairs:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
        ids = rnd.permutation(n) * 7
        want = [min(ids[j] for j in range(n) if find(j) == find(i)) for i in range(n)]
        assert jaccard.link_records(ids, np.array([len(s) for s in sets]), *flat(sets), labels if labelled else None).tolist() == want


def test_search_costs_its_lists():
    """Sixty-four thousand small records with few tokens in common are searched at the cost of their lists."""
    rnd = np.random.default_rng(9)
    sets = [np.unique(rnd.integers(0, 200_000, 11)) for _ in range(64_000)]
    began = time.time()
    roots = jaccard.link_records(np.arange(64_000), np.array([len(s) for s in sets]), *flat(sets))
    assert time.time() - began < 6 and len(roots) == 64_000


def test_hot_tokens_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_RECORDS", 8)
    monkeypatch.setattr(jaccard, "HOT_SHARE", 4)
    monkeypatch.setattr(jaccard, "SALTS", 3)
    rnd = random.Random(12)
    common = " ".join(words(rnd, 12))
    ts = [*texts(), *[common] * 5, common + " end"] + [common + " " + " ".join(words(rnd, rnd.randint(1, 9))) for _ in range(40)]
    df = frame(spark, ts)
    assert len(jaccard.hot_tokens(df, len(ts))) >= 8
    got = jaccard_components(df).collect()
    want = brute_components(ts)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted([(i, *w) for i, w in enumerate(want)] + [(len(ts) - 1, *want[-1])])


def test_rows_of_one_id(spark):
    """Many rows of a null id and of one id, with one text and with many."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7L ELSE id END AS doc_id", "CASE WHEN id % 2 = 0 THEN 'a b c d e f g' ELSE concat('w', id, ' x') END AS text")
    got = jaccard_components(df)
    assert got.count() == 3000 and got.where("n_shingles = 3").select("component_id").distinct().count() == 1


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (12, 12), (7, 8), (8, 7)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 9: 3, 10: 10, 11: 10, 12: 12, 7: 7, 8: 7} | {i: 100 for i in range(100, 141)}


def brute_removed(ts):
    data = [(t or "").encode() for t in ts]
    seen = Counter(x[p : p + 200] for x in data for p in range(len(x) - 199))
    out = []
    for x in data:
        gone = np.zeros(len(x) + 1, int)
        for p in range(len(x) - 199):
            if seen[x[p : p + 200]] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(x, np.uint8)[~mask])
        out.append((len(x), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_BYTES, 700])
def test_remove_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    rnd = random.Random(1)
    passage = " ".join(words(rnd, 70))
    ts = texts() + [" ".join(words(rnd, 60)) + passage + " ".join(words(rnd, 60)) for _ in range(6)] + ["pre " + passage[:199], passage[:200], "ab" * 400, "nul\x00" * 90]
    df = frame(spark, ts)
    inputs = [r[1] for r in rows(ts)]
    want = sorted((str(r[0]), *b[:4]) for r, b in zip(rows(ts), brute_removed(inputs), strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in remove_repeats(df).collect()) == want
    kept = sorted((str(r["doc_id"]), bytes(r["kept"])) for r in remove_repeats(df, keep_bytes=True).collect())
    assert kept == sorted((str(r[0]), b[4]) for r, b in zip(rows(ts), brute_removed(inputs), strict=True))
    assert remove_repeats(empty(spark)).count() == 0


def test_suffix_array():
    rnd = random.Random(4)
    for _ in range(400):
        t = "".join(rnd.choice("abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randint(0, 40)))
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_repeated_windows():
    rnd = random.Random(8)
    for _ in range(60):
        core = bytes(rnd.choice(b"ab\x00\xff") for _ in range(500))
        made = {}
        for _ in range(rnd.randint(1, 6)):
            low, high = rnd.randint(60, 240), rnd.randint(440, 500)
            x = bytearray(core[low:high])
            for _ in range(rnd.choice([0, 0, 1, 2])):
                x[rnd.randrange(len(x))] = rnd.choice(b"ab")
            made[bytes(x)] = 240 - low
        counts = Counter((s[p : p + 200], p - a) for s, a in made.items() for p in range(len(s) - 199))
        got = repeated_windows(list(made), np.array(list(made.values())), np.array([len(s) - 199 for s in made]))
        for (s, a), hit in zip(made.items(), got, strict=True):
            assert hit.tolist() == [counts[s[p : p + 200], p - a] > 1 for p in range(len(s) - 199)]
