"""Operators 11 to 13 against brute force, on rows with nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quern.llm import decontamination, dual_tree, filter_audit

DOCS = "doc_id long, text string, lang string, th long, item string, part string, token long"


def vocabulary(seed, n, words):
    r = random.Random(seed)
    return [r.choice(words) for _ in range(n)]


COMMON = "the of and a to in is it on as".split()
RARE = [f"w{k}é" for k in range(200)]
ITEM = " ".join(vocabulary(1, 30, COMMON + RARE))
SHORT = "Two Words"


def texts():
    clean = " ".join(vocabulary(2, 400, COMMON))
    inside = vocabulary(3, 50, RARE)
    inside[20:20] = ITEM.upper().replace("É", "é").split()[5:22]
    return [
        ITEM, "# ".join(ITEM.split()), " ".join(inside), clean, None, "", "  \t\n", "-- !!", SHORT, "x two-words x two words", "two wordsx", "TWO",
        " ".join(vocabulary(4, 20_000, COMMON)) + " " + ITEM, "Ünit É two words ǅ Ⅷ", " ".join(ITEM.split()[:9]), clean + " A$", "ABC DEF " * 60, clean.upper(),
    ]


def doc_rows():
    out = [(k, t, ["en", None, "", "fr"][k % 4], 7, "clash", "clash", 1) for k, t in enumerate(texts())]
    return out + [out[0], out[4], (99, out[3][1], "en", None, None, None, None), (2, "other text of one id", "fr", 0, "", "", 0), (None, ITEM, "en", 0, "", "", 0), (None, None, None, None, None, None, None)]


def item_rows():
    return [(0, ITEM), (1, SHORT), (1, "x " + ITEM), (10, ITEM.lower()), (2, None), (3, "?!"), (None, "not in any text at all of these"), (4, " ".join(vocabulary(9, 40, RARE)))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(item_rows(), "item_id long, text string")


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(rows, items):
    windows = {}
    for key, text in items:
        ws = words_of(text)
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            windows.setdefault(tuple(ws[i : i + n]), set()).add("" if key is None else str(key))
    out = []
    for doc_id, text, *_ in rows:
        ws, hit, found = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if own := windows.get(tuple(ws[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def same(got, want):
    key = lambda row: tuple((x is None, x) if not isinstance(x, bool) else (False, x) for x in row)
    assert sorted(map(tuple, got), key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))


@pytest.mark.parametrize(("shared", "block"), [(64, 200_000), (0, 200_000), (64, 7)])
def test_contamination_is_that_of_all_windows(docs, bench, monkeypatch, shared, block):
    """Also with every window looked up whole, and with many blocks of the benchmark."""
    monkeypatch.setattr(decontamination, "SHARED", shared)
    monkeypatch.setattr(decontamination, "BLOCK", block)
    got = decontamination.contamination(docs, bench)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute_contamination(doc_rows(), item_rows())
    assert sum(r[5] for r in want) >= 8
    same(got.collect(), want)


def test_contamination_of_empty_tables(docs, bench):
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    got = decontamination.contamination(docs, bench.limit(0)).collect()
    same(got, brute_contamination(doc_rows(), []))


def test_keep_clean_leaves_other_columns(docs, bench):
    renamed = docs.withColumnRenamed("token", "dirty_h")
    got = decontamination.keep_clean(renamed, bench)
    assert got.columns == renamed.columns
    want = [r for r, w in zip(doc_rows(), brute_contamination(doc_rows(), item_rows())) if not w[5]]
    same(got.collect(), want)


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    flagged = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(doc_id is not None and d is not None and d < doc_id and (x or "") == t for d, x, *_ in rows)
        f = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
        flagged.append((lang or "", {k for k, v in f.items() if v}, doc_id in good and doc_id is not None, doc_id in toxic and doc_id is not None))
    out, orders = [], ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {p for p, *_ in flagged}:
        own = [x[1:] for x in flagged if x[0] == part]
        removed = {(o, s): [x for x in own if o[s] in x[0] and not x[0] & set(o[:s])] for o in orders for s in range(5)}
        for (o, s), gone in removed.items():
            fails = [x for x in own if o[s] in x[0]]
            kept = sum(not x[0] & set(o[: s + 1]) for x in own)
            shapley = sum(len(v) for (p, k), v in removed.items() if p[k] == o[s])
            out.append((part, o, s + 1, kept, len(gone), len(fails) - len(gone), sum(x[0] == {o[s]} for x in fails), sum(x[1] for x in gone), sum(x[2] for x in gone), shapley))
    return out


LABELS = [(0, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (16, 1, 1), (None, 1, 1), (500, 1, 1), (99, 1, None)]
AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_is_that_of_each_order(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels).select(AUDIT).collect()
    assert len(got) == 3 * 600
    same(got, brute_audit(doc_rows(), LABELS))
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    same(filter_audit.filter_audit(docs, labels.limit(0)).select(AUDIT).collect(), brute_audit(doc_rows(), []))


def test_subset_counts_over_several_bytes():
    r = np.random.default_rng(5)
    part, fails, marks = r.integers(3, 9, 1001), r.random((5, 1001)) < 0.3, r.random((2, 1001)) < 0.5
    codes, got = filter_audit.subset_counts(part, fails, marks)
    for k, code in enumerate(codes):
        for s in range(32):
            kept = (part == code) & ~fails[[f for f in range(5) if s >> f & 1]].any(axis=0)
            assert got[k, s].tolist() == [kept.sum(), (kept & marks[0]).sum(), (kept & marks[1]).sum()]


def vectors():
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 64))
    x = (centres[r.integers(0, 12, 300)] + r.normal(scale=0.05, size=(300, 64))).astype(np.float32)
    rows = [(k, [float(v) for v in e], "clash") for k, e in enumerate(x)]
    rows += [(1000 + k, rows[7][1], "copy") for k in range(60)] + [rows[3], (None, rows[5][1], "no id"), (None, [0.0] * 64, "")]
    bad = [(2000, None, ""), (2001, [], ""), (2002, [1.0] * 63, ""), (2003, [float("nan")] + [1.0] * 63, ""), (2004, [float("inf")] + [1.0] * 63, ""), (2005, [None] + [1.0] * 63, "")]
    return rows, bad


def brute_lloyd(rows):
    x = [np.floor(np.array(e, np.float32).astype(np.float64) * 256).astype(np.int64) for _, e, *_ in rows]
    key = lambda k: (rows[k][0] is None, "" if rows[k][0] is None else hashlib.sha256(f"2:{rows[k][0]}".encode()).hexdigest(), x[k].tolist())
    c = np.array([x[k] for k in sorted(range(len(x)), key=key)[:40]])
    x = np.array(x)
    nearest = lambda: np.square(x[:, None, :] - c[None]).sum(axis=2)
    for _ in range(5):
        a = nearest().argmin(axis=1)
        c = np.array([x[a == k].sum(axis=0) // max(1, (a == k).sum()) if (a == k).any() else c[k] for k in range(len(c))])
    d = nearest()
    a, d = d.argmin(axis=1), d.min(axis=1)
    return [(r[0], int(k), int(s), int(d[a == k].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[k].tolist())).encode()).hexdigest()) for r, k, s in zip(rows, a, d)]


@pytest.mark.parametrize("n", [363, 25])
def test_clusters_are_lloyds(spark, n):
    """Also with fewer vectors than centroids."""
    rows, bad = vectors()
    table = spark.createDataFrame(rows[:n] + bad, "vec_id long, embedding array<float>, cluster string")
    got = dual_tree.cluster_vectors(table)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same(got.collect(), brute_lloyd(rows[:n]))
    assert dual_tree.cluster_vectors(table.limit(0)).count() == 0


def test_bounds_prune_and_lose_nothing():
    r = np.random.default_rng(4)
    centroids = r.integers(-300, 300, (40, 64))
    centroids[11] = centroids[4]
    x = centroids[r.integers(0, 40, 500)] + r.integers(-9, 10, (500, 64))
    x = np.concatenate([x, x[:50], centroids])
    cluster, distance, compared = dual_tree.nearest(dual_tree.CoverTree(x, 8), centroids)
    d = np.square(x[:, None, :] - centroids[None]).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert compared < d.size / 4
    tree = dual_tree.CoverTree(x, 8)
    again = dual_tree.CoverTree.unpacked(x, *tree.packed())
    assert (again.centre, again.radius, again.span, again.order.tolist()) == (tree.centre, tree.radius, tree.span, tree.order.tolist())
    assert [sorted(c) for c in again.children] == [sorted(c) for c in tree.children] and (dual_tree.nearest(again, centroids)[0] == cluster).all()


def test_cover_tree_covers_and_separates():
    x = np.random.default_rng(6).integers(-50, 50, (300, 3))
    tree = dual_tree.CoverTree(x, 4)
    for node, children in enumerate(tree.children):
        rows = tree.order[slice(*tree.span[node])]
        far = np.sqrt(np.square(x[rows] - x[tree.centre[node]]).sum(axis=1))
        assert np.isclose(far.max(), tree.radius[node])
        if children:
            centres = x[[tree.centre[c] for c in children]]
            assert sorted(i for c in children for i in tree.order[slice(*tree.span[c])]) == sorted(rows)
            gaps = np.sqrt(np.square(centres[:, None] - centres[None]).sum(axis=2))[~np.eye(len(centres), dtype=bool)]
            assert (gaps > tree.radius[node] / 2).all() and tree.centre[node] in [tree.centre[c] for c in children]


def test_too_large_components_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds"):
        dual_tree.cluster_vectors(table).collect()
