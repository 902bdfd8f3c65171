"""Operators 6 and 7: against brute force, on hard cases, and the queries against their SQL."""

import itertools
import random

import numpy as np
import pytest
from conftest import DATA, differences
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from glyphlake.llm import jaccard_join as J, queries as Q, suffix_dedup as S

DOCS = "doc_id long, text string, lang string, n_chars long"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    data = [(i, t, None, None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(data, DOCS).withColumns({c: F.lit(7) for c in ("uid", "home", "bucket", "row", "size", "grams", "run", "place", "piece", "head", "ids", "group", "start_word", "block")})


def texts(n=60, seed=0, words=40, vocabulary=5):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(vocabulary * 20)}" for _ in range(words)) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        a, b = sorted((rng.randrange(len(w) + 1), rng.randrange(len(w) + 1)))
        out.append(" ".join(w if rng.random() < 0.5 else rng.choice(base).split()[:7] + w[a:b]))
    return out


HARD = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (3, None), (4, ""), (5, " \n "), (6, "one"), (7, "one"), (8, "two words"), (9, "two  words"), (10, "a b c d e f g"), (11, "a\nb c d e f h"), (1, "p q r s t"), (12, "x " * 30000), (13, "y" * 200_000)]


# --- Repeated passages


def brute_spans(rows, width):
    """{(doc_id, text): [(start, end)]}; documents in order, those with the same key and text once."""
    seen, out = set(), {}
    for doc, text in sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = text.split()
        hit = [False] * len(w)
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            if g in seen:
                hit[p : p + width] = [True] * width
            seen.add(g)
        spans, p = [], 0
        while p < len(w):
            if hit[p]:
                q = p
                while q < len(w) and hit[q]:
                    q += 1
                spans.append((p, q))
                p = q
            else:
                p += 1
        if spans:
            out[doc, text] = spans
    return out


@pytest.mark.parametrize("seed", range(3))
def test_spans(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "_STEP", 300)
    rows = list(enumerate(texts(seed=seed, words=30, vocabulary=3)))
    found = {}
    for r in S.repeated_spans(frame(spark, rows), width=5, per_range=20).collect():
        found.setdefault((r.doc_id, rows[r.doc_id][1]), []).append((r.start_word, r.end_word))
    assert {k: sorted(v) for k, v in found.items()} == brute_spans(rows, 5)


def test_splitters_part_the_bytes():
    """Heads are taken from all over the runs, not from their beginnings."""
    rng = random.Random(5)
    runs = [sorted((f"w{rng.randrange(10**9):09d} ".encode() * 50, 0, 0, i) for i in range(300)) for _ in range(40)]
    heads = sorted(h for r in runs for p in S._coded(r, 0, 2, 50_000) for h in p["heads"])
    every = sorted(S.head(s, 2) for r in runs for s, *_ in r)
    assert len(heads) == pytest.approx(sum(len(x) for r in runs for p in S._coded(r, 0) for x in p["rest"]) / 50_000, abs=len(runs))
    assert [sum(x < heads[len(heads) * k // 4] for x in every) / len(every) for k in (1, 2, 3)] == pytest.approx([0.25, 0.5, 0.75], abs=0.12)


def test_spans_hard(spark):
    found = sorted((r.doc_id, r.start_word, r.end_word) for r in S.repeated_spans(frame(spark, HARD), width=3).filter("doc_id is not null").collect())
    wanted = sorted((d, a, b) for (d, _), spans in brute_spans(HARD, 3).items() for a, b in spans if d is not None)
    assert found == wanted
    assert S.repeated_spans(frame(spark, []), width=3).count() == 0


def test_repeats_removed(spark):
    rows = [(1, " a b c d"), (2, "x\ta b  c d\ny z"), (3, "a b c d"), (4, ""), (5, None), (3, "a b c d"), (6, "q a b c d e")]
    out = S.without_repeats(frame(spark, rows), width=4)
    assert out.columns == frame(spark, rows).columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.text is not None) == [(1, " a b c d", 8), (2, "x\ty z", 5), (4, "", 0), (6, "q e", 3)]
    assert out.filter("text is null").count() == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab ", max_size=12), max_size=8), min_size=1, max_size=7))
def test_loser_tree(runs):
    runs = [sorted(x.encode() for x in r) for r in runs]
    coded = []
    for r in runs:
        part = S.front_code([(x, 0, 0, 0) for x in r])
        assert S.decode([p[0] for p in part], [p[1] for p in part]) == r
        coded.append(([p[0] for p in part], [p[1] for p in part]))
    out = list(S.merge(coded))
    merged = [t for _, _, _, t in out]
    assert merged == sorted(x for r in runs for x in r)
    for (_, _, k, b), a in zip(out, [b"", *merged]):
        assert k == len(__import__("os").path.commonprefix([a, b]))


@given(st.lists(st.text("ab", max_size=6), max_size=12), st.randoms())
def test_earlier(strings, rng):
    strings = sorted(strings)
    order = list(range(len(strings)))
    rng.shuffle(order)
    prefix = lambda a, b: len(__import__("os").path.commonprefix([a, b]))
    lcps = [0] + [prefix(a, b) for a, b in zip(strings, strings[1:])]
    wanted = [max([prefix(s, t) for t, p in zip(strings, order) if p < o] or [0]) for s, o in zip(strings, order)]
    assert S.earlier(lcps, [(o,) for o in order]) == wanted


@pytest.mark.parametrize("size", [S._BUCKET, 3000])
def test_a_passage_in_every_document(spark, monkeypatch, size):
    """Windows that a run has often: in one bucket, and in many."""
    monkeypatch.setattr(S, "_BUCKET", size)
    monkeypatch.setattr(S, "_STEP", 500)
    rng = random.Random(7)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, other = own(30), own(12)
    rows = [(i, f"{own(5)} {passage} {own(3)}" + (f" {other} {own(2)}" if i % 3 else "")) for i in range(120)] + [(500 + i, f"{passage} {other}") for i in range(20)] + [(3, "x " * 50)]
    rows += rows[:15]
    for per_range in (100_000, 10):
        found = {}
        for r in S.repeated_spans(frame(spark, rows), width=8, per_range=per_range).collect():
            found.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        wanted = {}
        for (d, _), spans in brute_spans(rows, 8).items():
            wanted.setdefault(d, []).extend(spans)
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}


# --- Similar pairs


def grams(text, n):
    w = (text or "").split()
    return frozenset([tuple(w)] if 0 < len(w) < n else zip(*[w[i:] for i in range(n)])) if w else frozenset()


def brute_pairs(rows, n, t):
    least = lambda i: (i is not None, i or 0)
    sets = {}
    for i, text in dict.fromkeys(rows):
        if g := grams(text, n):
            sets.setdefault(g, []).append(i)
    out = set()
    for g, ids in sets.items():
        ids.sort(key=least)
        out |= {(ids[0], x, len(g), 1.0) for x in ids[1:]}
    items = [(ids[0], g) for g, ids in sets.items()]
    for x in range(len(items)):
        for y in range(x):
            (a, g), (b, h) = sorted((items[x], items[y]), key=lambda r: least(r[0]))
            o = len(g & h)
            if o and o / len(g | h) >= t:
                out.add((a, b, o, round(o / len(g | h), 9)))
    return out


@pytest.mark.parametrize(("n", "t"), [(2, 0.3), (3, 0.5), (3, 0.8), (1, 0.5)])
def test_pairs(spark, n, t):
    rows = list(enumerate(texts(seed=n, words=12, vocabulary=2)))
    found = {(r.doc_a, r.doc_b, r.overlap, round(r.jaccard, 9)) for r in J.pairs(frame(spark, rows), n, t).collect()}
    assert found == brute_pairs(rows, n, t)


def test_pairs_hard(spark):
    found = {(r.doc_a, r.doc_b, r.overlap, round(r.jaccard, 9)) for r in J.pairs(frame(spark, HARD)).collect()}
    assert found == brute_pairs(HARD, 3, 0.5)
    assert J.pairs(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [J._BUCKET, 3000])
def test_a_gram_in_every_document(spark, monkeypatch, size):
    """Columns that a run has often: in one bucket, and in many."""
    monkeypatch.setattr(J, "_BUCKET", size)
    rng = random.Random(11)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common, texts = own(9), []
    for i in range(60):
        base = f"{common} {own(6)}"
        texts += [base, f"{base} {own(1)}"] + ([base] if i % 4 == 0 else [])
    rows = list(enumerate(texts + [common] * 3 + texts[:30]))
    found = {(r.doc_a, r.doc_b, r.overlap, round(r.jaccard, 9)) for r in J.pairs(frame(spark, rows), 3, 0.5).collect()}
    assert found == brute_pairs(rows, 3, 0.5)


def test_all_pairs(spark):
    originals = texts(20, seed=3, words=12, vocabulary=2)
    rows = [(None if i == 41 else i, t) for i, t in enumerate(originals * 2 + originals[:3] + ["", None])]
    sets = [(i, frozenset(tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)) or frozenset([tuple(t.split())])) for i, t in rows if t and t.split()]
    wanted = []
    for (a, x), (b, y) in itertools.combinations(sorted(sets, key=lambda r: (r[0] is not None, r[0] or 0)), 2):
        if len(x & y) / len(x | y) >= 0.4:
            wanted.append((a, b, len(x & y), round(len(x & y) / len(x | y), 9)))
    found = [(r.doc_a, r.doc_b, r.overlap, round(r.jaccard, 9)) for r in J.all_pairs(frame(spark, rows), 2, 0.4).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert len(found) > J.pairs(frame(spark, rows), 2, 0.4).count()
    assert differences(Q.QUERIES["op6_ngram_jaccard_join_all"], Q.ORACLE["op6_ngram_jaccard_join_all"], spark, f"{DATA}/sf0.001") == ({}, {})


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE", 3)
    rows = list(enumerate(texts(40, seed=9, words=10, vocabulary=2)))
    found = {(r.doc_a, r.doc_b, r.overlap, round(r.jaccard, 9)) for r in J.pairs(frame(spark, rows), 2, 0.3).collect()}
    assert found == brute_pairs(rows, 2, 0.3)


def brute_links(rows, n, t):
    """(doc_id, class_id, links) of documents, told apart by doc_id and text."""
    docs = [(i, grams(text, n)) for i, text in dict.fromkeys(rows)]
    near = [[y for y, (_, h) in enumerate(docs) if x != y and g & h and len(g & h) / len(g | h) >= t] for x, (_, g) in enumerate(docs)]
    out = []
    for x, (i, _) in enumerate(docs):
        reached, todo = {x}, [x]
        while todo:
            new = set(near[todo.pop()]) - reached
            reached |= new
            todo += new
        out.append((i, min((docs[y][0] for y in reached if docs[y][0] is not None), default=None), len(near[x])))
    return sorted(out, key=repr)


def found_links(spark, rows, n, t):
    return sorted([(r.doc_id, r.class_id, r.links) for r in J.links(frame(spark, rows), n, t).collect()], key=repr)


def test_links_of_copies(spark):
    """Each document has all its links: those of copies that aren't the first, among each other and with similar texts, too."""
    base = [f"w{i}" for i in range(20)]
    other = " ".join(base + base[:5])  # the same set as base in another text, but for three more
    rows = [(5, " ".join(base)), (3, " ".join(base)), (9, "  ".join(base)), (4, " ".join([*base, "x"])), (7, other), (8, "a b c"), (None, "a b c"), (2, "q r s t"), (2, "u v w"), (1, ""), (6, None)]
    assert found_links(spark, rows, 3, 0.5) == brute_links(rows, 3, 0.5)
    assert (5, 3, 4) in found_links(spark, rows, 3, 0.5)


@pytest.mark.parametrize("tile", [2048, 5])
def test_links(spark, monkeypatch, tile):
    """In one tile and in many: no pair counts twice, though most meet in several blocks."""
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "STRIP", 4)
    rows = list(enumerate(texts(70, seed=4, words=12, vocabulary=2)))
    rows += [(100 + i, t) for i, t in rows[:9]] + rows[20:25] + HARD
    assert found_links(spark, rows, 2, 0.3) == brute_links(rows, 2, 0.3)


def test_links_of_no_rows(spark):
    assert J.links(frame(spark, [])).count() == 0


@pytest.mark.parametrize("ids", [[None], [7], [None, 1, 2]])
def test_pairs_of_texts_without_doc_ids_of_their_own(spark, ids):
    """Different texts with no doc_id, or the same, have a pair each; with the members of its sets, pairs() has every link."""
    rows = [(ids[k % len(ids)], t) for k, t in enumerate(f"{x}{x} {x} p q r s t u v {y}".replace("p", f"p{g}") for g in range(3) for x in "ab" for y in ("y", "z", "y  "))]
    found = J.pairs(frame(spark, rows)).collect()
    assert sum(r.jaccard < 1 for r in found) == 3 * 4
    sets, near, links = {}, [], []
    for r in found:
        for doc, name in ((r.doc_a, r.set_a), (r.doc_b, r.set_b)):
            sets.setdefault(name, [doc])
        if r.set_a == r.set_b:
            sets[r.set_a].append(r.doc_b)
        else:
            near.append((r.set_a, r.set_b, r.overlap, round(r.jaccard, 9)))
    for x, y, *same in near:
        links += [(*sorted((a, b), key=repr), *same) for a in sets[x] for b in sets[y]]
    docs = [(i, grams(t, 3), t) for i, t in dict.fromkeys(rows)]
    similar = [(*sorted((a, b), key=repr), len(g & h), round(len(g & h) / len(g | h), 9)) for (a, g, _), (b, h, _) in itertools.combinations(docs, 2) if g != h and len(g & h) / len(g | h) >= 0.5]
    assert sorted(links, key=repr) == sorted(similar, key=repr)


def many_alike(n):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(30)]
    return [(i, " ".join([*base[:k], f"x{i}", *base[k:]])) for i in range(n) for k in [rng.randrange(1, 30)]]


def test_pairs_end_in_their_tiles(spark, monkeypatch):
    """What leaves the tiles of a group of similar documents grows as the documents, not as the pairs."""
    monkeypatch.setattr(J, "TILE", 50)
    rows = many_alike(200)
    seen, components = [], J.components

    def counted(edges):
        seen.append(edges.count())
        return components(edges)

    monkeypatch.setattr(J, "components", counted)
    assert [r.doc_id for r in J.one_of_each(frame(spark, rows)).collect()] == [0]
    assert len(brute_pairs(rows, 3, 0.5)) == 199 * 100
    assert seen[0] < 200 * 3 * 4  # a row in three blocks at most, of four tiles


@pytest.mark.parametrize("cut", [0, 25])
def test_common(cut):
    """Columns of few rows and of many, counted in both ways."""
    rng = random.Random(cut)
    sets = [sorted({rng.randrange(40) if rng.random() < 0.5 else 100 + rng.randrange(600) for _ in range(30)}) for _ in range(60)]
    of = np.repeat(np.arange(60), [len(x) for x in sets])
    total = J.common(60, cut, of, np.array([k for x in sets for k in x], np.uint64))
    assert total.shape == (cut or 60, 60 - cut)
    assert all(total[a, b - cut] == len(set(sets[a]) & set(sets[b])) for a in range(cut or 60) for b in range(max(cut, a + 1), 60))


@pytest.mark.parametrize("n", [2, 3, 40])
def test_overlaps_of_very_long_texts(n):
    """More grams than a float of 32 bits counts one by one."""
    k = (1 << 24) + 1001
    keys = np.arange(k, dtype=np.uint64)
    sizes = np.array([k, k] + [1] * (n - 2))
    found = J.overlaps(sizes, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([keys, keys, np.arange(k, k + n - 2, dtype=np.uint64)]), 0, 0.99999)
    assert [x.tolist() for x in found] == [[0], [1], [k]]


def test_one_of_each(spark):
    rows = list(enumerate(texts(seed=5, words=12, vocabulary=2)))
    group = {i: i for i, _ in rows}

    def root(i):
        return i if group[i] == i else root(group[i])

    for a, b, _, _ in brute_pairs(rows, 2, 0.4):
        x, y = sorted((root(a), root(b)))
        group[y] = x
    kept = J.one_of_each(frame(spark, rows), 2, 0.4)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in group if root(i) == i)


def test_one_of_each_hard(spark):
    kept = [(r.doc_id, None if r.text is None else r.text[:9]) for r in J.one_of_each(frame(spark, HARD)).collect()]
    assert sorted(kept, key=repr) == sorted([(None, "a b c d e"), (None, None), (3, None), (4, ""), (5, " \n "), (6, "one"), (8, "two words"), (1, "p q r s t"), (12, "x x x x x"), (13, "y" * 9)], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, 50), (50, 70), (7, 3)]
    found = {r.node: r.group for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(21)}, 100: 50, 50: 50, 70: 50}
    assert J.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_folder(spark, monkeypatch):
    """Off one machine, a folder has to be named."""
    from types import SimpleNamespace

    from glyphlake.llm import common as C

    for master, fine in (("local[4]", True), ("local-cluster[3,2,1000]", False), ("spark://h:7077", False), ("yarn", False)):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None)
        session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
        if fine:
            assert C.shared_dir(session).startswith("file:///")
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                C.shared_dir(session)
        session.conf = SimpleNamespace(get=lambda *_: "hdfs://x/y/")
        assert C.shared_dir(session).startswith("hdfs://x/y/glyphlake-")


@pytest.mark.parametrize("name", ["op6_ngram_jaccard_join", "op7_suffix_array_dedup"])
def test_against_sql(spark, name):
    assert differences(Q.QUERIES[name], Q.ORACLE[name], spark, f"{DATA}/sf0.001") == ({}, {})
