"""The document operators on awkward small tables, against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import public_tokenizers
from pyspark.sql import functions as F

from candrank.llm import bpe, edit_counts, exact_dedup, kneser_ney, near_dedup, order_minhash
from candrank.llm import packing, quality, sharding, tokens, wrappers
from candrank.llm.common import FOLD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, slot int"
WORD_PATH = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def texts():
    rng = random.Random(5)
    words = [rng.choice("abcdefgh") * rng.randint(1, 5) + rng.choice("xyz") for _ in range(60)]
    base = " ".join(rng.choice(words) for _ in range(80))
    changed = base.split()
    changed[40] = "other"
    return [
        base,
        base.upper(),
        base,
        " ".join(changed),
        None,
        "",
        "one",
        "Mixed  spaces\t and\n\nlines ",
        "naïve Ünïcode 漢字   I'll é <|endoftext|>",
        " ".join(rng.choice(words) for _ in range(6000)),
        "w" * 9000,
        "! " * 50,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "own", 7) for i, t in enumerate(texts())]
    rows += [(None, "no id here at all", None, None, None, None, None), (3, texts()[3], "en", "s", 0, "own", 7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def folded(text):
    return (text or "").encode().translate(FOLD)


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 4, block_groups=3, block_partials=2).collect()
    assert len(rows) == docs.count()
    homes, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        homes[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in homes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in plain(docs))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert sharding.shard(empty, 4).count() == 0


def test_differencing_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    loads = [0] * 8
    for size, to in zip(sizes, sharding.difference([[s] + [0] * 7 for s in sizes]), strict=True):
        loads[to[0]] += size
    assert sum(loads) == sum(sizes) and max(loads) - min(loads) <= 8


@pytest.mark.parametrize("run_rows", [1, 50_000])
def test_exact_dedup(docs, empty, run_rows):
    rows = exact_dedup.exact_dedup(docs, run_rows).collect()
    groups = defaultdict(list)
    for i, t in plain(docs):
        groups[folded(t)].append(i)
    want = Counter()
    for i, t in plain(docs):
        ids = [x for x in groups[folded(t)] if x is not None]
        keep = max(ids) if ids else None
        want[(i, keep, len(groups[folded(t)]), i == keep, hashlib.sha256(folded(t)).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.without_copies(docs, run_rows)
    assert left.columns == docs.columns
    assert len({folded(t) for _, t in plain(docs)}) == left.count()


def linked(pairs, words, percent=80):
    sets = {}
    for i, t in pairs:
        w = folded(t).split()
        n = min(words, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    home = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and home[a] != home[b]:
                    home[a] = home[b] = min(home[a], home[b])
                    changed = True
    return sets, home


@pytest.mark.parametrize("small", [2, 32])
def test_near_dedup(spark, docs, empty, small):
    """A family of copies in several steps from the first, in small and in split bands."""
    rng = random.Random(3)
    family, words = [], [f"w{i}" for i in range(120)]
    for k in range(60):
        own = list(words)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            own[rng.randrange(len(own))] = f"z{k}-{rng.random()}"
        family.append((1000 + k, " ".join(own)))
    pairs = [(i, t) for i, t in plain(docs) if i is not None and i != 3] + [(3, texts()[3])] + family
    table = spark.createDataFrame(pairs, "doc_id long, text string")
    sets, home = linked(pairs, 4)
    rows = near_dedup.link(table, small=small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        i: (len(sets[i]), home[i], home[i] == i) for i in sets
    }
    left = near_dedup.without_near(docs, small=small)
    assert left.columns == docs.columns and left.filter("doc_id = 3").count() == 0
    assert near_dedup.link(empty).count() == 0


def test_odd_sketch_estimates_the_samples_that_differ():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.r_[a[:380], rng.integers(0, 2**63, 20, dtype=np.uint64)]
    x, y = (near_dedup.odd_sketch(near_dedup.samples(np.unique(s), 112)) for s in (a, b))
    apart = np.bitwise_count((x ^ y).view(np.uint64)).sum()
    assert apart <= near_dedup.differing(112, near_dedup.LEAST_ESTIMATE)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_PATH)
    whole.encode_special_tokens = True
    want = Counter()
    for i, t in plain(docs):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 512):
            own = ids[k : k + 512]
            want[(i, k // 512, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    rows = packing.pack(docs, WORD_PATH, capacity=512, region=6).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 512
    assert packing.pack(empty, WORD_PATH).count() == 0


def test_equal_rows_fill_no_region(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, 20, 5)] * 9_000 + [(i, 0, 0, 30, 7) for i in range(1_000)],
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )
    for level in (1, 2):
        sizes = [r["count"] for r in packing.dealt(rows, 10, level).groupBy("region").count().collect()]
        assert len(sizes) == 10 and max(sizes) < 1_200


def test_packing_needs_few_more_sequences_than_tokens(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.choice((rng.randint(1, 60), rng.randint(60, 500))))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, WORD_PATH, capacity=512, region=150).collect()
    least = -(-sum(r.length for r in got) // 512)
    assert len({r.sequence_id for r in got}) <= least * 1.02 + 1


def test_crossover_keeps_every_item_once():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    best = packing.evolve(lengths, [], 128, 1)
    assert sorted(i for b in best for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) <= 128 for b in best)


def test_bpe_round_trip(docs, empty):
    one = tokens.rank_encoding(RANKS, PATTERN)
    want = Counter(
        (
            i,
            len(one.encode_ordinary(t or "")),
            hashlib.sha256(np.array(one.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(),
            hashlib.sha256((t or "").encode()).hexdigest(),
        )
        for i, t in plain(docs)
    )
    got = bpe.digested(bpe.encode(docs, RANKS, PATTERN, block_chars=500), RANKS)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert bpe.encode(empty, RANKS, PATTERN).count() == 0


def test_edit_counts(spark, docs, empty):
    one = tokens.rank_encoding(RANKS, PATTERN)
    steps = [(0, 1, 5, 9, " new words"), (0, 2, 0, 3, None), (9, 1, 20000, -4, "x y"), (7, 1, None, 2, "\n")]
    edits = spark.createDataFrame(
        [*steps, (99, 1, 0, 0, "x"), (None, 1, 0, 0, "x")],
        "doc_id long, seq int, start long, length long, insert string",
    )
    for r in edit_counts.count_edited(docs, edits, RANKS, PATTERN).collect():
        text = after = (dict(plain(docs))[r.doc_id]) or ""
        for _, _, start, length, insert in (s for s in steps if s[0] == r.doc_id):
            start, length = min(max(start or 0, 0), len(after)), max(length, 0)
            after = after[:start] + (insert or "") + after[start + length :]
        assert r.n_tokens == len(one.encode_ordinary(text))
        assert r.edited_n_tokens == len(one.encode_ordinary(after))
        assert r.edited_sha256 == hashlib.sha256(after.encode()).hexdigest()
    assert edit_counts.count_edited(empty, edits, RANKS, PATTERN).count() == 0


def test_edits_anywhere_keep_the_count():
    one = tokens.rank_encoding(RANKS, PATTERN)
    rng, parts = random.Random(1), ["a", "b", " ", "  ", "\n", "'s", "é", "!!", " w", "\t", "漢"]
    for k in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 30, 1500 if k % 40 == 0 else 60])))
        tree = edit_counts.CountTree(text, lambda s: len(one.encode_ordinary(s)))
        for _ in range(3):
            start, length = rng.randrange(len(text) + 3), rng.choice([0, 1, 3, 200])
            insert = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 4])))
            at = min(start, len(text))
            text = text[:at] + insert + text[at + length :]
            tree.edit(start, length, insert)
            assert (tree.text(), tree.n_tokens) == (text, len(one.encode_ordinary(text)))


def test_kneser_ney(docs, empty):
    rows = kneser_ney.perplexity_scores(docs, block_chars=2000, part_chars=500).collect()
    table = [(i, [b" s", *folded(t).split(), b" e"]) for i, t in plain(docs)]
    single, double = Counter(), Counter()
    for i, w in table:
        if not kneser_ney.held_out(i):
            single.update(w[1:])
            double.update(zip(w, w[1:], strict=False))
    n, v, types = sum(single.values()), len(single), len(double)
    of = Counter(double.values())
    d = kneser_ney.discounts(of[1], of[2], of[3], of[4])
    total, kinds, before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (u, w), c in double.items():
        total[u] += c
        kinds[u][min(c, 3) - 1] += 1
        before[w] += 1

    def p(u, w):
        lower = (max(before[w] - 0.75, 0) + 0.75 * v / (v + 1)) / types
        if not total[u]:
            return lower
        c = double[(u, w)]
        gone = d[min(c, 3) - 1] if c else 0
        return (c - gone) / total[u] + sum(a * b for a, b in zip(d, kinds[u], strict=True)) / total[u] * lower

    want = {
        (i, len(w) - 1): (
            sum(single[x] > 0 for x in w[1:]),
            sum(math.log10((single[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w[1:]),
            sum(math.log10(p(a, b)) for a, b in zip(w, w[1:], strict=False)),
        )
        for i, w in table
    }
    assert len(rows) == len(table)
    for r in rows:
        known, base, score = want[(r.doc_id, r.n_tokens)]
        assert (r.n_known, r.train_tokens, r.held_out) == (known, n, kneser_ney.held_out(r.doc_id))
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    assert kneser_ney.perplexity_scores(empty).count() == 0


def test_order_minhash(docs, empty):
    rows = order_minhash.fingerprint(docs).collect()
    assert len(rows) == docs.count()
    ring = sorted(set(plain(docs)), key=lambda x: (x[0] is not None, x[0]))
    after = {i: ring[(k + 1) % len(ring)][1] or "" for k, (i, _) in enumerate(ring)}
    seen = {}
    for r in rows:
        text = dict(plain(docs))[r.doc_id] or ""
        part = len(text) // 4
        edited = text[: len(text) - part] + after[r.doc_id][:part]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert seen.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    assert order_minhash.fingerprint(empty).count() == 0


def test_order_minhash_sees_order(spark):
    words = [f"w{i}" for i in range(400)]
    blocks = [words[i : i + 4] for i in range(0, 400, 4)]
    random.Random(4).shuffle(blocks)
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(w for b in blocks for w in b))]
    got = {r.doc_id: r for r in order_minhash.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next == 1.0 and got[2].near_next < 0.3


def fingerprint_of(text, k=3, slots=64, bits=27):
    """The tuple hash of each slot in plain Python; -1 for an empty one."""
    high = ~((1 << bits) - 1)

    def hashed(*parts):
        seed = 42
        for part in parts:
            raw = part.encode() if isinstance(part, str) else part[0].to_bytes(part[1], "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
        return seed - (1 << 64) if seed >> 63 else seed

    words = re.findall("[^ \\t\\n\\x0b\\f\\r]{1,16}", text)
    seen, numbered = Counter(), []
    for place in range(max(len(words) - k, 0) + 1 if words else 0):
        kmer = hashed(*words[place : place + k]) & high
        numbered.append((hashed((kmer, 8), (seen[kmer], 4)) & high, place))
        seen[kmer] += 1
    numbered.sort()
    out = [-1] * slots
    for at, (value, place) in enumerate(numbered):
        slot = (value >> 58) & 63
        if out[slot] != -1:
            continue
        if len(numbered) == 1:
            out[slot] = hashed((value, 8)) & 0xFFFFFF
            continue
        # The second of the slot, or where there is none the first of the next filled slot.
        other, other_place = numbered[(at + 1) % len(numbered)]
        pair = ((value, 8), (other, 8)) if place < other_place else ((other, 8), (value, 8))
        out[slot] = hashed(*pair) & 0xFFFFFF
    return out


def alike(a, b):
    either = sum(x >= 0 or y >= 0 for x, y in zip(a, b, strict=True))
    return sum(x == y >= 0 for x, y in zip(a, b, strict=True)) / either if either else 1.0


def test_order_minhash_is_that_of_plain_python(spark):
    rng = random.Random(9)
    many = [f"w{rng.randrange(40)}" for _ in range(700)]
    held = [
        *("", "one", "two words", "a b c", "a b c d", "x x x x x x x x x", "naïve 漢字\u3000z " * 9, "w" * 70),
        *(" ".join(many[:n]) for n in (9, 40, 130, 700)),
    ]
    docs = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    got = sorted(order_minhash.fingerprint(docs).collect(), key=lambda r: r.doc_id)
    for r in got:
        text, after = held[r.doc_id], held[(r.doc_id + 1) % len(held)]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        own, changed = fingerprint_of(text), fingerprint_of(edited)
        for printed, signed in ((r.fingerprint, own), (r.edited_fingerprint, changed)):
            assert printed == "".join("------" if x < 0 else f"{x:06x}" for x in signed)
        assert r.near_edited == alike(own, changed)
        assert r.near_next == alike(own, fingerprint_of(after))


def test_order_counts_in_short_texts(spark):
    rng = random.Random(10)
    for n, most in ((40, 0.6), (100, 0.45)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        swapped = " ".join(words[n // 2 :] + words[: n // 2])
        last = " ".join(words[:-1] + ["other"])
        held = [" ".join(words), swapped, " ".join(words), last]
        docs = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
        got = {r.doc_id: r.near_next for r in order_minhash.fingerprint(docs).collect()}
        assert got[0] < most < 0.75 < got[2]


def test_wrappers(spark):
    page = (
        "<html><head><title>t</title></head><body><nav><a href=/a>menu</a></nav><div class='ad'>buy</div>"
        "<article><h1>Head &amp; {0}</h1><p>One <b>two</b>\n three{0}<br>four<p>Five</article>"
        "<div class=comments><p>nice {0}</div><footer>&copy; x</footer><script>var a='<p>no</p>'</script></body></html>"
    )
    other = "<body><header>Site</header><div id=content><p>Text {0} of a page without an article, long enough.</p></div><div id=sidebar>more</div>"
    rows = [(k, f"http://a.example/{k}", page.format(k)) for k in range(5)]
    rows += [(10 + k, "https://b.example/x", other.format(k)) for k in range(3)]
    rows += [(20, None, None), (21, "no url", ""), (None, "http://c.example/", "<p>only"), (0, "http://a.example/0", page.format(0))]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = {20: "", 21: "", None: "only"}.get(r.page_id)
        if want is None:
            k = r.page_id % 10
            want = f"Head & {k}\n\nOne two three{k} four\n\nFive" if r.page_id < 10 else f"Text {k} of a page without an article, long enough."
        assert (r.text, r.n_chars) == (want, len(want))
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrappers.extract(nothing).count() == 0


def test_alignment_makes_slots_and_options():
    one, two = (wrappers.wrapper_of(wrappers.regions(h)) for h in ("<article>a</article><div id=x>s</div>", "<article>b</article>"))
    got = wrappers.align(one, two)
    assert [(x["signature"], x["optional"], x["slots"]) for x in got] == [("article", False, 1), ("div.x", True, 0)]


def test_quality(spark, empty):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(400):
        words = [rng.choice(["the", "of", "tion", "shand", "ering"]) for _ in range(60)]
        good = i % 4 > 0
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", f"s{i % 3}", len(text), "own", 1))
        if i % 2 == 0 or i < 40:
            marks.append((i, int(good), 0))
    table = spark.createDataFrame([*rows, (None, None, None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([*marks, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(table, labels).collect()
    assert len(got) == 401
    right = [r.keep == (r.doc_id % 4 > 0) for r in got if r.doc_id is not None and r.doc_id >= 40]
    assert sum(right) / len(right) > 0.95
    left = quality.without_rejected(table, labels)
    assert left.columns == table.columns
    assert left.filter("kept = 'own'").count() == left.filter("doc_id is not null").count()
    assert quality.classify(table, labels.filter("quality = 1")).filter("not keep").count() == 0
    assert quality.classify(empty, labels).count() == 0


def views(rng, n, noise):
    y = rng.random(n) < 0.7
    sides = [np.c_[np.ones(n), (2 * y - 1)[:, None] * 0.6 + rng.normal(0, noise, (n, 4))] for _ in range(2)]
    return tuple(x.astype(np.float32) for x in sides), y.astype(float)


@pytest.mark.parametrize("free", [0, 1, 2, 113, 601, 4_000])
def test_labels_are_exchanged_at_any_size(monkeypatch, free):
    rng = np.random.default_rng(3)
    known, y = views(rng, 60, 1.0)
    other, truth = views(rng, free, 1.0)
    fits = []
    plainly = quality.fit_logistic

    def counted(x, z):
        fits.append((len(x), z))
        return plainly(x, z)

    monkeypatch.setattr(quality, "fit_logistic", counted)
    quality.co_train(known, y, other)
    if free < 2:
        assert len(fits) == 2
        return
    # What a view was given beyond the labels, at the end.
    given = sum(max(n for n, _ in fits[2 + k :: 2]) - 60 for k in (0, 1) if fits[2 + k :: 2])
    each = max(2, round(quality.SURE * free))
    assert given == min(2 * quality.ROUNDS * each, free)
    assert all({0.0, 1.0} <= set(z[60:]) for n, z in fits[2:])


def test_exchange_helps_where_labels_are_few():
    rng = np.random.default_rng(5)
    gains = []
    for _ in range(8):
        known, y = views(rng, 24, 1.0)
        if len(set(y)) < 2:
            continue
        other, _ = views(rng, 1_200, 1.0)
        test, truth = views(rng, 2_000, 1.0)

        def right(weights):
            z = sum(x @ w for x, w in zip(test, weights, strict=True))
            return ((z > 0) == (truth > 0)).mean()

        alone = [quality.fit_logistic(x, y) for x in known]
        gains.append(right(quality.co_train(known, y, other)) - right(alone))
    assert np.mean(gains) > 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    judged = stages["quality"](spark, documents, sf)
    assert judged.columns == documents.columns
    once = stages["exact"](spark, documents, sf)
    groups = defaultdict(list)
    for i, t in plain(documents):
        groups[folded(t)].append(i)
    assert sorted(r.doc_id for r in once.collect()) == sorted(max(x) for x in groups.values())
    _, home = linked(plain(once), 5)
    near = stages["near"](spark, once, sf)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i in home if home[i] == i)
    kept = {r.doc_id for r in judged.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= kept
    assert re.match(r"quality", corpus_pipeline.STAGES[0][0])


def test_stages_on_empty_tables_and_clashing_columns(spark, docs, empty):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    clash = {f"{name}{more}": i for i, name in enumerate(("__key", "__own", "__id", "__text", "__n", "__q")) for more in ("", "_")}
    names = {**clash, "text_key": 9, "keep_id": 9, "component_id": 9, "keep": 9, "quality_score": 9}
    for table in (empty, docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, table.withColumns({c: F.lit(v) for c, v in names.items()}), sf)
            assert left.columns == [*table.columns, *names], name
            rows = left.collect()
            assert all(r[c] == v for r in rows for c, v in names.items())
            assert bool(rows) == (table is docs) and len(rows) == stage(spark, table, sf).count()
        packed = corpus_pipeline.STAGES[-1][1](spark, table.withColumn("__key", F.lit(1)), sf)
        assert packed.isEmpty() == (table is empty)


NEAR = " ".join(f"n{i}" for i in range(100))
REPEATED = [
    (None, "first text without a number"),
    (None, "second text without a number, and not like it"),
    (None, "second text without a number, and not like it"),
    (None, "a text that has a number elsewhere"),
    (4, "a text that has a number elsewhere"),
    (5, "one of two texts of number five"),
    (5, "quite another thing told under the same number"),
    (6, NEAR),
    (7, NEAR + " more"),
    (7, "what else number seven says stays here"),
    (8, "what else number seven says stays here"),
]


def test_rows_of_an_id_with_several_texts(spark):
    """Several null ids, a null-id copy of a numbered row, and ids with two texts."""
    table = spark.createDataFrame([(i, t, 1) for i, t in REPEATED], "doc_id long, text string, slot int")

    def left(df):
        assert df.columns == table.columns
        return sorted(plain(df), key=str)

    def without(*gone):
        rows = sorted(set(REPEATED), key=str)
        return [x for x in rows if x not in gone]

    copy = (None, REPEATED[3][1])
    kept = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(table).filter("group_size = 2").collect()}
    assert kept == {(None, None, True), (None, 4, False), (4, 4, True), (7, 8, False), (8, 8, True)}
    assert left(exact_dedup.without_copies(table)) == without(copy, REPEATED[9])
    # Number seven's first text is a near copy, its other one the smallest id of its component.
    assert left(near_dedup.without_near(table)) == without(copy, REPEATED[8], REPEATED[10])
    found = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.link(table).collect())
    assert found[7, 6, False] == found[7, 7, True] == found[8, 7, False] == found[None, 4, False] == 1
    assert found[5, 5, True] == 2 and found[None, None, True] == 3


BODY = "A long text about one thing, number {0}, with enough words to be the article of its page."


@pytest.mark.parametrize(
    "page",
    [
        '<body class="no-sidebar"><article><p>{0}</article>',
        '<html class="header-fixed"><body class="search"><div><p>{0}</div>',
        '<body><div id="page" class="has-comments"><article><p>{0}</article><div class="comments"><p>nice</div></div>',
        '<body><div class="content with-sidebar"><p>{0}</div><div class="sidebar"><p>more</div>',
        '<body><div class="legal"><p>{0}</div><div class="share"><p>tell others</div>',
        '<body><main><div class="discussion"><p>{0}</div></main>',
        '<body><div class="related"><article class="teaser"><p>short</article></div><div class="page with-sidebar"><article><p>{0}</article></div>',
    ],
)
def test_names_do_not_take_the_article(page):
    text = BODY.format(1)
    assert wrappers.extracted(page.format(text), None) == text


def test_host_tells_template_from_article(spark):
    """Regions are read per page: no id of a page and no share of a host's text decides."""
    tags = "<div class=tags><a href=/t>one tag</a> <a href=/u>another tag of the site</a></div>"
    notice = "<div class=box><p>The same words of the house stand on every page of it, " + "again and again " * 9 + "</div>"
    post = "<div id=post-{0} class=post><p>{1}</div>" + tags + notice
    legal = "<div class=intro><p>{2}</div><div class=legal><p>{1}</div>"
    long = BODY + " More of it." * 9
    rows, want = [], {}
    for k in range(12):
        text = f"Short {k}." if k == 3 else BODY.format(k)
        rows.append((k, "http://post.example/", f"<body>{post.format(k, text)}"))
        want[k] = text
        # The first page has more text beside the named element than in it, the host has not.
        text = (BODY if k == 0 else long).format(k)
        intro = f"Opening {k}. " * (12 if k == 0 else 1)
        rows.append((100 + k, "http://legal.example/", "<body>" + legal.format(k, text, intro)))
        want[100 + k] = f"{intro.strip()}\n\n{text}"
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == want


def test_pre_tokens_of_any_script():
    """Spans beyond Latin-1 are cut too, and the ids are those of the whole text."""
    import regex

    rng = random.Random(9)
    find = regex.compile(PATTERN).findall
    alphabets = ["漢字仮名交じり文", "кириллица", "ελληνικά", "עברית", "عربي", "हिन्दी", "ไทย", "😀👍🏽", "a1 -'s", "ſ͸Ᲊ\x85"]
    one = tokens.rank_encoding(RANKS, PATTERN)
    for _ in range(300):
        letters = "".join(rng.sample(alphabets, 3)) + "，。 1२"
        text = "".join(rng.choices(letters, k=60))
        cut = [w for s in tokens.spans(text) for w in tokens.pre_tokens(find, s)]
        assert "".join(cut) == text
        assert [i for w in cut for i in one.encode_ordinary(w)] == one.encode_ordinary(text)
    long = "漢字，" * 4000
    cut = [w for s in tokens.spans(long) for w in tokens.pre_tokens(find, s)]
    assert len(cut) == 8000 and len(set(cut)) == 2


def test_runs_of_rows_without_ids(spark):
    """Rows of one id, or of none, are spread over the runs."""
    docs = spark.createDataFrame([(None if i % 2 else 5, f"t{i}") for i in range(400)], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs.repartition(4), run_rows=10).collect()
    assert len(rows) == 400 and {r.group_size for r in rows} == {1}


@pytest.mark.parametrize(
    "page",
    [
        "<article><p>{0}<section class=comments><article class=comment>nice</article><article class=comment>{1}</article></section></article>",
        "<article><p>{0}</p><article>{1}</article></article>",
        "<main><article><p>{0}</p><div class=comments><p>{1}</p><p>{1}</p></div></article></main>",
        "<div class=content><p>{0}</div><div id=comments><p>{1}</div>",
        "<article><p>{0}</p></article><div class=more><article><p>Another story</article></div>",
        "<main><article><p>{0}</p></article><article><h3><a href=/x>Another</a></h3><p>story</article></main>",
    ],
)
def test_comments_and_other_stories_are_left_out(page):
    """Also where comments are longer than the article."""
    text = BODY.format(1)
    assert wrappers.extracted(page.format(text, "What readers say of it. " * 12), None) == text


def test_long_comments_of_a_host_stay_out(spark):
    page = "<body><div class=content><p>{0}</div><div class=discussion><p>{1}</div>"
    rows = [(k, "http://talk.example/", page.format(BODY.format(k), f"Reader {k} says. " * 40)) for k in range(6)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: BODY.format(k) for k in range(6)}


def test_links_are_told_from_text():
    found = wrappers.regions("<div class=a><ul><li><a href=/x>one</a><li><a href=/y>two</a></ul></div><div class=b><a name=c>It says much more.")
    assert [(r.signature, r.linked, sum(map(len, r.blocks))) for r in found] == [("div.a", 6, 6), ("div.b", 18, 18)]
    (one,) = wrappers.regions("<div><p><a name=x>one <a href=/y>two</a> and free text</p></div>")
    assert (one.blocks, one.linked) == (["one two and free text"], 0)


def test_quotes_and_brackets_in_tags():
    page = "<article title='a > b' data-x=\"<p>no\"><p class=\"a\"id=b>1 < 2 <3 and {0}</p></article>"
    assert wrappers.extracted(page.format(BODY), None) == f"1 < 2 <3 and {BODY}"
    # What a quote leaves open ends with the next bracket.
    assert wrappers.extracted('<p title="x>one</p><p>two', None) == "one\n\ntwo"


@pytest.mark.parametrize(
    "one", ["<div>", '<a "', "<b>", "<", "<p>word ", "<article>x", '<a x="', "<a x='\"><p>", "</script ", "<div class=a>x</div><p>y"]
)
def test_time_follows_the_length_of_a_page(one):
    def seconds(n: int) -> float:
        begin = time.process_time()
        wrappers.wrapper_of(wrappers.regions(one * (n // len(one)) + "<p>x"))
        return time.process_time() - begin

    # Eight times the page in at most thirty times the time; with the square it would be 64.
    assert seconds(800_000) < max(30 * seconds(100_000), 3)
