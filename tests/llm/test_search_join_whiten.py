"""Lexical search, n-gram join and whitening on awkward small tables, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from candrank.llm import lexical_search, ngram_join, whitening
from candrank.llm.common import FOLD

SCHEMA = "doc_id long, text string, score long, rank string, n long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# -- lexical search ---------------------------------------------------------------------------
def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = Counter()
    for item_id, text in {(i, t or "") for i, t in items}:
        scored = []
        for doc_id, c in docs:
            m = 25 + 75 * sum(c.values()) * n // total
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:k], 1):
            out[(item_id, rank, doc_id, -score)] += 1
    return out


def search_tables():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["naïve", "漢字", "the", "a1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(60)]
    docs += [(i + 100, docs[5][1]) for i in range(14)]  # ties
    docs += [(200, None), (201, ""), (202, "!!! --- \x00\n"), (None, docs[7][1]), (5, docs[5][1])]
    docs += [(203, "THE the The_the " * 3000), (204, "漢字漢字 naïve/NAÏVE")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "the the THE w1"), (None, "w2 w3"), (1, items[1][1])]
    return docs, items


@pytest.mark.parametrize("item_bytes,postings", [(lexical_search.ITEM_BYTES, 2_000_000), (300, 40)])
def test_search(spark, monkeypatch, item_bytes, postings):
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    docs, items = search_tables()
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], SCHEMA)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    found = lexical_search.rank_items(table, asked, item_bytes=item_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "w1", 1, "x", 2)], SCHEMA)
    assert lexical_search.rank_items(none, spark.createDataFrame([(1, "w1")], "item_id long, text string")).count() == 0
    assert lexical_search.rank_items(some, asked).count() == 0


def test_accumulators_are_limited():
    """Many documents hold only the common term; few of them get an accumulator."""
    rare = [np.array([0], np.int32)] * 20
    both = [np.array([0, 1], np.int32)] * 20
    common = [np.array([1], np.int32)] * 500
    lists = rare + both + common
    one = [np.ones(len(x), np.int32).tobytes() for x in lists]
    postings = lexical_search.Postings([10] * len(lists), [x.tobytes() for x in lists], one, 540, 5400)
    place, score = lexical_search.search(postings, [(0, 5000), (1, 300)], 10)
    assert len(place) == 40
    # Those that have one are scored in full.
    share = postings.of(0)[1][0]
    assert {int(s) for p, s in zip(place, score, strict=True) if p >= 20} == {int(share) * 5300}
    # With less to gain from the rare term all documents are met.
    assert len(lexical_search.search(postings, [(0, 5000), (1, 6000)], 10)[0]) == 540


# -- n-gram join --------------------------------------------------------------------------------
def shingles(text, n=4):
    words = (text or "").encode().translate(FOLD).split()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute_join(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    home = list(range(len(docs)))

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    links = 0
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                links += sets[i] != sets[j]
                home[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    rows = [
        (doc_id, len(sets[i]), least.get(top(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(docs)
    ]
    return Counter(rows), links


def join_tables():
    rng = random.Random(11)
    vocabulary = [f"{rng.choice('bcdfg')}{i}" for i in range(500)]
    docs, number = [], 0
    for length in (8, 20, 45, 80, 150):
        for _ in range(3):
            base = rng.choices(vocabulary, k=length)
            for _ in range(9):
                words = list(base)
                for _ in range(rng.randint(0, 1 + length // 40)):
                    words[rng.randrange(length)] = rng.choice(vocabulary)
                docs.append((number, " ".join(words)))
                number += 1
    # Look-alikes of one template, most of them not linked, and a passage that many share.
    template, passage = rng.choices(vocabulary, k=60), rng.choices(vocabulary, k=30)
    for i in range(60):
        words = list(template)
        for place in rng.sample(range(60), 1 + i % 4):
            words[place] = f"u{i}.{place}"
        docs.append((1000 + i, " ".join(words)))
        docs.append((2000 + i, " ".join(passage + rng.choices(vocabulary, k=3 + i))))
    docs += [(None, docs[0][1]), (None, "a text without an id " * 5), (3000, None), (3001, " \t\n"), (3002, "one")]
    docs += [(3003, "ONE"), (3004, "one two three"), (0, docs[40][1]), (0, docs[0][1]), (3005, "w " * 9000)]
    docs += [(3006, docs[3][1].upper()), (3007, " ".join(rng.choices(vocabulary, k=9000))), (3008, "é é ü ß 漢")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(
    "small,block,counters,entries", [(32, 512, 1 << 18, 250_000), (3, 7, 1 << 8, 100), (1, 1000, 1, 1000)]
)
def test_join(spark, small, block, counters, entries):
    docs = join_tables()
    want, links = brute_join(docs)
    assert links > 50
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], SCHEMA)
    found = ngram_join.join(table, small=small, block=block, counters=counters, entries=entries)
    assert Counter(tuple(r) for r in found.collect()) == want


def test_join_of_an_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], SCHEMA), counters=256).count() == 0


def test_bounds():
    """Whole-number bounds are those of the fractions, and prefixes meet."""
    for size in range(1, 200):
        assert ngram_join.least_size(size, 85) == math.ceil(size * 85 / 100 - 1e-9)
        for other in range(ngram_join.least_size(size, 85), size + 1):
            least = ngram_join.least_shared(size + other, 85)
            assert 100 * least >= 85 * (size + other - least) and 100 * (least - 1) < 85 * (size + other - least + 1)
            assert size - least < ngram_join.prefix_size(size, 85)


@pytest.mark.parametrize("entries,held", [(1000, 8), (7, 2), (50, 3)])
def test_prefix_groups(spark, entries, held):
    """A shingle of all nodes and some of a few: every place of a shared one, no other."""
    rng = random.Random(2)
    lists = {i: [5, *rng.sample(range(10, 900), 20)] for i in range(200)}
    rows = [(i, len(x), 1 + i % 3, x) for i, x in lists.items()] + [(900, 1, 1, [9999])]
    nodes = spark.createDataFrame(rows, "n long, size int, copies long, prefix array<long>").repartition(5)
    count = Counter(g for x in lists.values() for g in x)
    want = Counter((g, i, 21, at, 1 + i % 3) for i, x in lists.items() for at, g in enumerate(x) if count[g] > 1)
    assert Counter(tuple(r) for r in ngram_join.prefix_groups(nodes, entries, held).collect()) == want


def test_counted_shingles(spark):
    """Each set's shingles are counted once, a hot one in all sets."""
    table = spark.createDataFrame([(i, "a b c d", 1, "x", 2) for i in range(255)], SCHEMA)
    level = ngram_join.levels(table, counters=64)
    assert sorted(level.tolist()) == [0] * 63 + [64]


# -- whitening ----------------------------------------------------------------------------------
def brute_whiten(rows, most=16):
    kept = [
        (i, [math.floor(64 * c) + 1_000_000 for c in v])
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    lengths = Counter(len(x) for _, x in kept)
    size = max(lengths, key=lambda d: (lengths[d], d))
    fit = np.array(sorted({tuple(x) for _, x in kept if len(x) == size}), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    centred = np.array([[float(n * c - s) / n for c, s in zip(x, total)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:most]
    return kept, size, n, total, e[order], v[:, order], e.sum()


def vectors(kind):
    rng = np.random.default_rng(5)
    if kind == "spread":
        data = rng.standard_normal((200, 24)) * np.geomspace(0.02, 3, 24)
    elif kind == "ties":
        # Four equal eigenvalues by turning the same points.
        data = np.concatenate([np.eye(4), -np.eye(4)]) * 2
    else:
        data = np.repeat(rng.standard_normal((30, 3)), 2, axis=1)  # no variance beyond three components
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(data)]
    rows += [(None, rows[0][1]), (0, rows[0][1]), (500, rows[3][1])]
    rows += [(600, None), (601, [None, *rows[0][1][1:]]), (602, [math.nan, *rows[0][1][1:]])]
    return [*rows, (603, [math.inf, *rows[0][1][1:]])]


@pytest.mark.parametrize("kind", ["spread", "ties", "flat"])
def test_whiten(spark, kind):
    rows = vectors(kind)
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, n int")
    got = whitening.whiten(table).collect()
    kept, size, n, total, e, v, trace = brute_whiten(rows)
    k = int((e > 1e-9 * trace).sum())
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c + 1) for i, _ in kept for c in range(k))
    apart = {(i, sum((n * c - s) ** 2 for c, s in zip(x, total))) for i, x in kept}
    assert {(r.vec_id, r.deviation) for r in got} == apart
    assert all(r.n == n and r.identity_error < 1e-9 for r in got)
    for r in got:
        assert math.isclose(r.explained, e[r.component - 1] / trace, rel_tol=1e-9)
    if kind == "spread":
        want = {i: [float(n * c - s) / n for c, s in zip(x, total)] @ v / np.sqrt(e) for i, x in kept}
        for c in range(k):
            pairs = [(r.whitened, want[r.vec_id][c]) for r in got if r.component == c + 1]
            sign = math.copysign(1, sum(a * b for a, b in pairs))
            assert max(abs(a - sign * b) for a, b in pairs) < 1e-8


def test_whiten_odd_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], schema)).count() == 0
    rows = [(i, [float(i), float(i % 3)]) for i in range(9)] + [(20, [1.0]), (21, [1e300, 0.0]), (22, [])]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r.vec_id for r in got if r.component == 1) == Counter(i for i, _ in rows)
    assert all(r.whitened is None and r.deviation is None for r in got if r.vec_id in (20, 22))
    assert all(r.deviation is None and r.whitened is not None for r in got if r.vec_id == 21)


@pytest.mark.parametrize("seed", range(6))
def test_spectrum(seed):
    """Inertia counts and eigenvalues as those of a full decomposition, clusters among them."""
    rng = np.random.default_rng(seed)
    size = int(rng.integers(2, 40))
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    e = np.sort(np.round(rng.random(size) * 6) / 2 + (seed % 2) * rng.random(size) * 1e-7 + 0.1)[::-1]
    matrix = (q * e) @ q.T
    matrix = (matrix + matrix.T) / 2
    for shift in rng.random(5) * 3.3:
        assert whitening.above(matrix, shift) == int((e > shift).sum())
    values, columns = whitening.leading(matrix, 16)
    k = min(16, size)
    assert np.allclose(values, e[:k], rtol=0, atol=1e-11 * e.sum())
    assert np.abs(columns.T @ columns - np.eye(k)).max() < 1e-12
    assert np.abs(columns.T @ matrix @ columns - np.diag(values)).max() < 1e-11 * e.sum()


def test_inertia_needs_blocks():
    """A zero diagonal leaves only blocks of two rows."""
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.above(np.diag([3.0, -1.0, 0.0]), 0.0) == 1
