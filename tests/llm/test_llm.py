"""The ten operators against brute force, exact round trips, held-out accuracy, and small hard cases."""

from __future__ import annotations

import hashlib
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chaining, hnsw, langid, order_minhash, packing, queries, simhash, suffixes, token_counts, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [
    (1, None), (2, ""), (3, "   \n"), (4, "a"), (5, "É́ \U0001f600 日本語"), (6, "same text here for all"), (7, "same text here for all"),
    (8, "word " * 3000), (None, "no id"), (9, "x" * 700 + "y" * 300 + "x" * 700), (9, "again nine"),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in HARD]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"fp": F.lit(1), "key": F.lit("k"), "seed": F.lit(2)})


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_fingerprints_of_edits(spark, sf, docs):
    out = queries.op1_order_minhash(spark, sf).orderBy("doc_id").collect()
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    assert len(out) == len(texts)
    by_text = defaultdict(set)
    for i, r in enumerate(out):
        t, n = texts[i], len(texts[i])
        edited = t[: n - n // 2] + texts[(i + 1) % len(texts)][: n // 2]
        assert r.n_chars == n and r.edited_sha256 == sha(edited)
        by_text[t].add(r.fingerprint)
        by_text[edited].add(r.edited_fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by_text.values())
    assert np.mean([r.near_edited for r in out]) > np.mean([r.near_next for r in out]) + 0.1


def test_fingerprints_see_order(spark):
    words = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(1)
    mixed = [words[i : i + 10] for i in range(0, 200, 10)]
    rng.shuffle(mixed)
    near = [*words[:100], "new", *words[101:]]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(near)), (2, " ".join(w for b in mixed for w in b))], "k int, text string")
    s = {r.k: np.array(r.sketch) for r in order_minhash.sketches(df, ["k"]).collect()}
    assert (s[0] == s[1]).mean() > 0.8 > (s[0] == s[2]).mean() + 0.1


def brute_sketch(hashes: list[int], xx) -> list[int]:
    """The order MinHash of a text from the hashes of its words and the end: plain sorting, no bit tricks."""
    seen: dict[int, int] = defaultdict(int)
    numbered = []
    pairs = [(xx(a, b) & ~order_minhash.PLACE, i) for i, (a, b) in enumerate(zip(hashes, hashes[1:], strict=False))]
    for h, i in pairs:
        numbered.append((xx(h, np.int32(seen[h])) & ~order_minhash.PLACE, i))
        seen[h] += 1
    kept = sorted(numbered)[: order_minhash.KEPT]
    out = []
    for j in range(order_minhash.SKETCHES):
        least = sorted((xx(h >> order_minhash.SHIFT, np.int32(j)) & ~order_minhash.PLACE, i) for h, i in kept)[: order_minhash.TUPLE]
        out.append([h >> order_minhash.SHIFT & (1 << 34) - 1 for h, _ in sorted(least, key=lambda x: x[1])])
    return out


def test_sketches_equal_brute_force(spark):
    """Tuples of minimal numbered k-mers in text order, by plain sorting in Python over the same hash function."""
    rng = np.random.default_rng(9)
    texts = ["", "one", "a a a a a a", " ".join(f"w{x}" for x in rng.integers(0, 3, 12))]
    known: dict[tuple, int] = {}

    def xx(*args):
        """Spark's own hash of numbers, asked for one at a time but kept."""
        if args not in known:
            known[args] = spark.range(1).select(F.xxhash64(*[F.lit(int(a)).cast("int" if isinstance(a, np.int32) else "bigint") for a in args])).first()[0]
        return known[args]

    for t in texts:
        hashes = [r[0] for r in spark.createDataFrame([(w,) for w in [*t.split(), ""]], "w string").select(F.xxhash64("w")).collect()]
        tuples = brute_sketch(hashes, xx)
        values = spark.createDataFrame([(v,) for v in tuples], "v array<long>").select(F.xxhash64("v").bitwiseAND((1 << 32) - 1)).collect()
        got = order_minhash.sketches(spark.createDataFrame([(1, t)], "k int, text string"), ["k"]).first().sketch
        assert got == [r[0] for r in values]


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs):
    rows = docs.collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(fps)
    for n, i in enumerate(keys):
        for j in keys[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in keys}


def close_fingerprints(n: int) -> np.ndarray:
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    return np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) for _ in range(6)]]))


def test_vantage_trees_find_every_pair():
    fps = close_fingerprints(300)
    d = np.bitwise_count(fps[:, None] ^ fps)
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 3), strict=True) if i < j}
    found, met = set(), set()
    for half in (fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF)):
        simhash.vp_join(half, 1, fps, 3, lambda a, b: found.update((min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != y))
        tree, shards, at_home = simhash.Tree(half[::3], 16, 1), defaultdict(list), np.zeros(len(fps), int)
        for at, leaf, home in tree.shards(half):
            at_home[at] += home
            for i, s in zip(at.tolist(), leaf.tolist(), strict=True):
                shards[s].append((i, home))
        assert (at_home == 1).all() and len(shards) > 20
        met |= {(min(i, j), max(i, j)) for rows in shards.values() for i, home in rows if home for j, _ in rows}
    assert found == want and want <= met


def test_shards_compared_in_parts_find_the_same_links(spark):
    fps = close_fingerprints(400).view(np.int64).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "doc_id long, fp long")
    groups = []
    for shard, full in ((4096, 16_384), (64, 16_384), (4096, 100)):
        comp = {r.node: r.root for r in simhash.connected_components(simhash.links(df.select("fp"), 3, shard, full)).collect()}
        groups.append({frozenset(x for x in fps if comp.get(x, x) == r) for r in set(comp.values())})
    assert groups[0] == groups[1] == groups[2] and len(groups[0]) > 100


def jaccard(a: str, b: str, k: int = 5) -> float:
    x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("group", [simhash.GROUP, 8])
def test_near_duplicates_recall(spark, monkeypatch, group):
    """Pairs of similarity 0.8 to 0.85 and a family of many near copies, against all pairs; keys are split when full."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(11)
    texts: list[str] = []
    for n in [300] * 120 + [90] * 80:
        t = [f"w{x}" for x in rng.integers(0, 100_000, n)]
        for most in (int((n - 4) / 9 / 5), int((n - 4) / 5)):  # similar enough, and not quite
            u = t.copy()
            for p in np.linspace(3, n - 8, most).astype(int):
                u[p] = f"x{rng.integers(1e9)}"
            texts += [" ".join(t), " ".join(u)]
            t = [f"v{x}" for x in rng.integers(0, 100_000, n)]
    base = [f"z{x}" for x in rng.integers(0, 100_000, 200)]
    for _ in range(60):  # each is like the first, most are not like each other
        u = base.copy()
        for p in rng.choice(np.arange(5, 195, 5), 4, replace=False):
            u[p] = f"y{rng.integers(1e9)}"
        texts.append(" ".join(u))
    texts.append(" ".join(base))
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hits = []
    for i in range(0, len(texts) - 61, 2):
        together, alike = got[i] == got[i + 1], jaccard(texts[i], texts[i + 1]) >= 0.8
        assert alike or not together
        hits += [together] * alike
    assert len(hits) == 200 and np.mean(hits) >= 0.9
    family = [got[i] for i in range(len(texts) - 61, len(texts))]
    assert np.mean([g == family[-1] for g in family]) >= 0.9


def test_near_duplicates_of_a_group_send_few_pairs(spark, monkeypatch):
    """A large group whose members are mostly not similar enough, but nearly so: the groups of all pairs, from few rows."""
    rng = np.random.default_rng(12)
    base = [f"z{x}" for x in rng.integers(0, 100_000, 160)]
    texts = []
    for i in range(200):
        u = edited(base, rng.choice(np.arange(5, 155, 5), 4, replace=False), rng)
        texts.append(" ".join(u))
        if i % 10 == 0:
            texts.append(" ".join(edited(u, [80], rng)))
    sent, trees, checked, links = [], [], simhash._checked, simhash.links
    monkeypatch.setattr(simhash, "_checked", lambda pairs, *x: sent.append(pairs.count()) or checked(pairs, *x))
    monkeypatch.setattr(simhash, "links", lambda distinct, *x: trees.append(1) or links(distinct, *x))
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = components(len(texts), pairs)
    assert trees and sum(sent) <= 16 * len(texts)
    assert all(root[got[i]] == root[i] for i in range(len(texts))) and np.mean([got[i] == root[i] for i in range(len(texts))]) >= 0.95


def test_near_duplicates_keep_one(spark):
    rng = np.random.default_rng(2)
    text = [f"w{x}" for x in rng.integers(0, 500, 300)]
    near = [*text[:150], "other", *text[151:]]
    rows = [(3, " ".join(text)), (5, " ".join(near)), (7, " ".join(f"v{x}" for x in rng.integers(0, 500, 300))), (8, ""), (9, None), (3, " ".join(text))]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9]


def edited(words: list[str], places, rng) -> list[str]:
    out = words.copy()
    for i in places:
        out[i] = f"e{rng.integers(1e9)}"
    return out


def test_passages_with_edits(spark):
    """Evenly edited passages of 100 words with a similarity of 0.81 and more; nothing else is told."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, want = [(10_001, None), (10_002, " ".join(word(300))), (None, "x")], {}
    for i, n in enumerate([0, 3, 5, 10, 15, 19] * 12):
        shared = word(100)
        rows.append((2 * i, " ".join(word(80) + shared + word(60))))
        rows.append((2 * i + 1, " ".join(word(30) + edited(shared, np.linspace(1, 98, n).astype(int), rng) + word(90))))
        want[2 * i + 1] = n
    out = chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.src_id == r.doc_id - 1 and r.doc_id in want for r in out)
    hits = defaultdict(list)
    for d, n in want.items():
        hits[n].append(any(r.doc_id == d for r in out))
    assert all(np.mean(h) >= 0.9 for h in hits.values()), hits
    for r in out:
        if want[r.doc_id] <= 5:
            assert abs(r.start - 30) <= 3 and abs(r.end - 130) <= 3 and abs(r.similarity - (1 - want[r.doc_id] / 100)) < 0.03


def test_passages_with_edits_at_random_places(spark):
    """Short passages too, with words changed anywhere in them, up to a similarity of 0.81."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, want = [], {}
    for length in (52, 55, 60, 100):
        for share in (0, 0.05, 0.1, 0.15, 0.19):
            for _ in range(40):
                shared, i = word(length), 2 * len(want)
                changed = edited(shared, rng.choice(length, int(length * share), replace=False), rng)
                rows += [(i, " ".join(word(80) + shared + word(60))), (i + 1, " ".join(word(30) + changed + word(90)))]
                want[i + 1] = length, share
    out = chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.src_id == r.doc_id - 1 and r.doc_id in want and r.similarity >= 0.8 - 1e-9 for r in out)
    found, hits = {r.doc_id for r in out}, defaultdict(list)
    for d, kind in want.items():
        hits[kind].append(d in found)
    assert all(np.mean(h) >= 0.85 for h in hits.values()), hits
    assert np.mean([x for h in hits.values() for x in h]) >= 0.95


def test_chains_are_the_best_of_all():
    """The best chain against all earlier seeds of each seed; ends against the edit distances of all prefixes."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        x, y = np.array(sorted(set(zip(rng.integers(0, 40, n).tolist(), rng.integers(0, 40, n).tolist(), strict=True)))).T
        score = np.ones(len(x))
        for j in range(len(x)):
            for i in np.flatnonzero((x < x[j]) & (y < y[j])):
                score[j] = max(score[j], score[i] + 1 - chaining.GAP * (x[j] - x[i] + y[j] - y[i]))
        made = chaining.chain(x, y)
        got = max((sum(1 - chaining.GAP * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(p, p[1:])) + 1 for p in made), default=0)
        assert abs(got - score.max()) < 1e-9 if made and len(made[0]) >= chaining.LEAST else score.max() <= chaining.LEAST
        a, b = rng.integers(0, 3, rng.integers(1, 14)).tolist(), rng.integers(0, 3, rng.integers(1, 14)).tolist()
        gain = lambda e: (e[1] + e[2]) / 2 - e[0] * (1 + chaining.BAD)
        best = max(gain((chaining.edits(a[:i], b[:j], 99), i, j)) for i in range(len(a) + 1) for j in range(len(b) + 1))
        assert abs(max(map(gain, chaining.extend(a, b, 0, 0, 1))) - best) < 1e-9
        assert chaining.extend(a, b, 0, 0, 1) == chaining.extend(a[::-1], b[::-1], len(a), len(b), -1)


def test_passages_among_common_phrases(spark):
    """Two documents share a passage whose every phrase stands in earlier documents; passages return in one document."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    shared, twice = word(60), word(70)
    texts = [word(20) + shared[i : i + 12] + word(20) for i in range(0, 60, 6) for _ in range(12)]  # phrases with over FEW places
    n = len(texts)
    texts += [word(40) + shared + word(40), word(25) + shared + word(25), word(30) + twice + word(80) + twice + word(10), word(90)]
    texts += [texts[-1], word(60) + texts[-1][:55] + word(20)]
    got = chaining.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    pairs = {(r.doc_id, r.src_id) for r in got}
    assert pairs == {(n + 1, n), (n + 2, n + 2), (n + 4, n + 3), (n + 5, n + 3)}
    own = next(r for r in got if r.doc_id == n + 2)
    assert abs(own.start - 180) <= 2 and abs(own.src_start - 30) <= 2
    assert next(r for r in got if r.doc_id == n + 4)[1:] == (0, 90, n + 3, 0, 90, 1.0)


def test_passages_whose_every_part_is_common(spark):
    """Two documents share a passage of which all parts, long ones too, stand in over FEW documents between them."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, want = [], set()
    for i in range(20):
        shared = word(70)
        parts = [shared[a : a + 40] for a in range(0, 31, 10)]
        texts = [word(30) + shared + word(30), *(word(20) + part + word(20) for _ in range(12) for part in parts), word(20) + shared + word(40)]
        ids = [1000 * i + j for j in range(len(texts))]
        rows += zip(ids, map(" ".join, texts), strict=True)
        want.add((ids[-1], ids[0]))
    out = chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.src_id) for r in out.collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    sides = chaining.both_sides(out).collect()
    assert {(r.doc_id, r.src_id) for r in sides} == got | {(b, a) for a, b in got} and all(r.end - r.start >= 50 for r in sides)


def test_alignment_is_the_least_edit_distance():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (rng.integers(0, 3, rng.integers(0, 12)).astype(np.uint64) for _ in range(2))
        d = np.arange(len(b) + 1)[None].repeat(len(a) + 1, 0) + np.arange(len(a) + 1)[:, None]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        for most in (0, 2, 30):
            assert chaining.edits(a, b, most) == min(d[-1, -1], most + 1)


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    pieces = packing.pack(docs, VOCABULARY).collect()
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.doc_tokens == len(ids[p.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == [sum(q.length for q in ps[:n]) for n in range(len(ps))]
        assert sum(p.length for p in ps) == len(ids[i])
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:n]) for n in range(len(ps))]
        size = sum(p.length for p in ps)
        assert size <= 2048 and (size == 2048 or size & (size - 1) == 0)


def brute_scores(ids: list[list[int]], idf: np.ndarray, mean: float, seed: int) -> list[float]:
    out = []
    for d in ids:
        score = 0.0
        for term in set(ids[seed]):
            tf = d.count(term)
            score += idf[term] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        out.append(score)
    return out


def test_windows_take_the_best_neighbours():
    """A window holds its seed and the unused documents with the best BM25 scores, in their order; against plain counting."""
    rng = np.random.default_rng(12)
    ids = [rng.integers(0, 60, rng.integers(5, 60)) for _ in range(80)]
    idf, mean = rng.random(60) + 0.1, float(np.mean([len(x) for x in ids]))
    packer = packing.Packer(100, 0)
    rows, rest = packing.pack_shard(packer, list(range(80)), [x.astype("<u2") for x in ids], [0] * 80, packing.Shard([x.astype("<u2") for x in ids], idf, mean))
    left, at = [len(x) for x in ids], 0
    while at < len(rows):
        seed = next(d for d in range(80) if left[d])
        score = brute_scores([x.tolist() for x in ids], idf, mean, seed)
        room = 100
        for d in [seed, *sorted((d for d in range(80) if d != seed), key=lambda d: (-round(score[d], 9), d))]:
            if room and left[d]:
                n = min(left[d], room)
                assert rows[at][:3] == (d, len(ids[d]) - left[d], n)
                left[d], room, at = left[d] - n, room - n, at + 1
    assert sum(left) < 100 and {d for d, _ in rest} == {d for d in range(80) if left[d]}


def test_like_documents_share_sequences(spark):
    """Near copies that stand far apart in the table are packed together; thousands of empty texts are no burden."""
    rng = np.random.default_rng(13)
    rows = []
    for i in range(600):
        words = [f"t{i}w{x}" for x in rng.integers(0, 40, 60)]
        rows += [(i, " ".join(words)), (i + 600, " ".join(words[:-3]))]
    rows.sort()
    rows += [(5000 + i, "") for i in range(6000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), VOCABULARY, 1024).collect()
    where = defaultdict(set)
    for p in pieces:
        where[p.doc_id].add(p.sequence_id)
    assert len(where) == len(rows)
    assert np.mean([bool(where[i] & where[i + 600]) for i in range(600)]) > 0.6


def test_nearest_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.collect()
    v = np.array([r.embedding for r in rows], np.float64)
    key = np.array([r.vec_id for r in rows])
    got = defaultdict(dict)
    for r in hnsw.nearest(table, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(got) == {k for k in key.tolist() if k % 50 == 0}
    right = total = 0
    for q, found in got.items():
        i = int(np.flatnonzero(key == q)[0])
        s = v @ v[i] / np.sqrt((v * v).sum(1) * (v[i] @ v[i]))
        best = [x for x in np.lexsort((key, -s)).tolist() if key[x] != q][:5]
        assert sorted(found) == [1, 2, 3, 4, 5]
        right += len({key[x] for x in best} & {x for x, _ in found.values()})
        total += 5
        assert all(abs(s[np.flatnonzero(key == x)[0]] - y) < 1e-12 for x, y in found.values())
    assert right / total >= 0.9


def test_nearest_over_many_shards(spark):
    """Clusters and scattered vectors, a third of all rows near one centre, repeats; several shards, routed, against brute force."""
    rng = np.random.default_rng(17)
    heads = rng.normal(size=(12, 24))
    v = np.concatenate([heads[0] + 0.05 * rng.normal(size=(700, 24)), *(h + 0.3 * rng.normal(size=(90, 24)) for h in heads), rng.normal(size=(200, 24))])
    v[5] = v[900]
    rows = [(i, x.tolist(), "k", i) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, *rows[:40]], "vec_id long, embedding array<double>, shard string, cell int").repartition(5)
    got = defaultdict(dict)
    for r in hnsw.nearest(df, F.col("vec_id") % 50 == 0, shard=200).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    right = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        assert sorted(found) == [1, 2, 3, 4, 5] and [found[i][1] for i in range(1, 6)] == sorted((x[1] for x in found.values()), reverse=True)
        right += len(set(np.argsort(-s)[:5].tolist()) & {x for x, _ in found.values()})
    assert len(got) == -(-len(v) // 50) and right / (5 * len(got)) >= 0.9


def test_nearest_leaves_bad_vectors_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in hnsw.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 6)]
    assert hnsw.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def brute_strip(texts: list[str | None], size: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = defaultdict(int)
    for d in data:
        for i in range(len(d) - size + 1):
            seen[d[i : i + size]] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int8)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = 1
        out.append((len(d), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), sha(bytes(b for b, g in zip(d, gone, strict=False) if not g))))
    return out


def test_repeats_are_stripped(spark, docs, hard):
    for df in (docs.select("doc_id", "text").where("length(text) < 6000 OR text IS NULL"), hard):
        rows = df.select("doc_id", "text").collect()
        got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.strip_repeats(df).collect()]
        assert sorted(got) == sorted(brute_strip([r.text for r in rows], 200))


def test_rows_without_id_keep_unique_text(spark):
    """Rows with null or equal doc_id whose texts share bits of their hash are still documents of their own."""
    shared = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 220)))
    near = spark.range(600_000).select(F.sha2(F.col("id").cast("string"), 512).alias("t")).select(F.repeat("t", 3).alias("unique"))
    hit = near.withColumn("text", F.concat(F.lit(shared), "unique")).where(F.pmod(F.xxhash64("text"), F.lit(65536)) == 7).limit(1)
    miss = near.withColumn("text", F.concat("unique", F.lit("."))).where(F.pmod(F.xxhash64("text"), F.lit(65536)) == 7).limit(1)
    texts = [hit.first().text, miss.first().text, shared + "z" * 5, shared * 2, shared * 2]
    for ids in ([None] * 5, [4] * 5, [None, None, 4, -(2**63), -(2**63)]):
        rows = suffixes.strip_repeats(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
        assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(brute_strip(texts, 200))
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rows)


@pytest.mark.parametrize("giant", [8192, 40])
def test_repeats_of_common_digits(spark, monkeypatch, giant):
    """Passages in different contexts, some in one context many times, some digits dealt out by whole strings."""
    monkeypatch.setattr(suffixes, "GIANT", giant)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts = []
    for _ in range(6):
        shared, before, after = word(250), word(200), word(200)
        texts += [word(300) + shared + word(300) for _ in range(60)]
        texts += [word(50) + before + shared + after + word(50) for _ in range(30)]
    got = suffixes.strip_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_strip(texts, 200))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"  # smaller tables have a few toxic rows only
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op7_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in out])
    assert right > max(np.mean([r.toxic == 0 for r in out]), 0.85)
    assert all(r.predicted == int(r.score >= 0.7) for r in out)


def test_maximal_segments():
    assert toxicity.maximal_segments([(0, 2.0), (1, 2.0), (30, 3.0)]) == [(0, 1, 4.0), (30, 30, 3.0)]
    assert toxicity.maximal_segments([]) == []


def brute_segments(score: list[float], at: int = 0) -> list[tuple[int, int, float]]:
    """The segment of greatest sum (the shortest, then first one), then those to its left and right, until none is above 0."""
    best = None
    for i in range(len(score)):
        for j in range(i, len(score)):
            total = sum(score[i : j + 1])
            if total > 1e-9 and (best is None or (total, i - j) > (best[2] + 1e-9, best[0] - best[1])):
                best = (i, j, total)
    if best is None:
        return []
    i, j, total = best
    return [*brute_segments(score[:i], at), (at + i, at + j, total), *brute_segments(score[j + 1 :], at + j + 1)]


def test_segments_equal_all_subsequences():
    rng = np.random.default_rng(15)
    for _ in range(150):
        n = int(rng.integers(1, 25))
        weight = {int(i): float(np.round(rng.normal(), 3)) + 0.0004 * k for k, i in enumerate(rng.choice(n, rng.integers(0, n + 1), replace=False))}
        score = [weight.get(i, -toxicity.DRIFT) for i in range(n)]
        got = toxicity.maximal_segments(sorted(weight.items()))
        want = brute_segments(score)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_gram_counts_equal_plain_counting(monkeypatch):
    monkeypatch.setattr(langid, "PART", 7)
    text = "Über die Brücke, 日本語 und zurück: ein Satz!"
    plain = "".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in text.lower())
    want: dict[int, int] = defaultdict(int)
    mask = (1 << 64) - 1
    for n in (1, 2, 3):
        for i in range(len(plain) - n + 1):
            h = 0
            for c in plain[i : i + n]:
                h = (h * 0x110001 + ord(c)) & mask
            want[((h + n) * 0x9E3779B97F4A7C15 & mask) >> (64 - langid.BITS)] += 1
    at, n = langid.gram_counts(text)
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == dict(want)


def test_language_held_out(spark, sf, docs):
    out = queries.op8_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.9


def test_encoding_equals_library(spark, docs, hard):
    from tokenizers import Tokenizer

    from tessera.llm import bpe

    t = Tokenizer.from_file(VOCABULARY)
    for df in (docs, hard):
        texts = [r.text or "" for r in df.collect()]
        want = []
        for e in t.encode_batch(texts, add_special_tokens=False):
            want.append((len(e.ids), sha(",".join(map(str, e.ids))), sha(t.decode(e.ids, skip_special_tokens=False))))
        got = [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(df, VOCABULARY).collect()]
        assert sorted(got) == sorted(want)


def test_token_counts_add_up(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    n = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    for rule in ("first", "last", "share"):
        rows = token_counts.token_counts(docs, VOCABULARY, rule=rule)
        whole = {r.doc_id: r.n_tokens for r in rows.where("section = -1").collect()}
        parts = {r.doc_id: r.n for r in rows.where("section >= 0").groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
        assert whole == n
        assert all(abs(parts[k] - n[k]) < 1e-6 for k in parts)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_equal_plain_counting(spark, rule):
    """Overlapping sections with gaps, beyond the text, empty: each token is looked at by itself."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    rng = np.random.default_rng(16)
    texts = {1: "Some words, 日本語 and ünïcödé — numbers 12345 🙂 emoji\n" * 3, 2: "", 3: None, 4: "tail"}
    parts = [(d, i, int(a), int(a + n)) for d in (1, 2, 3, 4, 9) for i, (a, n) in enumerate(zip(rng.integers(0, 170, 12), rng.integers(0, 40, 12), strict=True))]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens) for r in token_counts.token_counts(docs, VOCABULARY, spark.createDataFrame(parts, "doc_id long, section int, start int, end int"), rule).collect()}
    for d, text in texts.items():
        e = t.encode(text or "", add_special_tokens=False)
        assert got[d, -1] == (0, len(text or ""), len(e.ids))
        for _, i, a, b in (x for x in parts if x[0] == d):
            a, b = min(a, len(text or "")), min(b, len(text or ""))
            n = 0.0
            for lo, hi in e.offsets:
                inside = max(0, min(hi, b) - max(lo, a))
                if rule == "first":
                    n += a <= lo < b
                elif rule == "last":
                    n += a < hi <= b
                elif rule == "share":
                    n += inside / (hi - lo)
                else:
                    n += 2 * inside > hi - lo or 2 * inside == hi - lo and a <= lo < b
            assert got[d, i][:2] == (a, b) and abs(got[d, i][2] - (n if a < b else 0)) < 1e-9


def test_hard_rows_do_not_break(spark, hard):
    """Nulls, empty and long texts, ties, repeated rows, extra columns: one row per row, or per document."""
    n = len(HARD)
    assert order_minhash.fingerprint_edits(hard).count() == n
    assert simhash.simhash_components(hard).count() == n
    assert len({r.doc_id for r in packing.pack(hard, VOCABULARY).collect()}) == len({i for i, _ in HARD})
    assert toxicity.score(hard, None).where("score = 0 AND predicted = 0").count() == n
    assert langid.identify(hard, langid.fit(hard)).where("lang_pred = 'und'").count() == 3
    assert token_counts.token_counts(hard, VOCABULARY).where("section = -1").count() == n
    assert chaining.shared_passages(hard).where("src_id IS NULL").count() == 0
    assert set(suffixes.strip_texts(hard).columns) == set(simhash.keep_first(hard).columns) == set(hard.columns)


def test_empty_tables(spark, hard):
    none = hard.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        order_minhash.fingerprint_edits(none), simhash.simhash_components(none), chaining.shared_passages(none), packing.pack(none, VOCABULARY), suffixes.strip_repeats(none),
        toxicity.score(none, toxicity.fit(none, labels)), langid.identify(none, langid.fit(none)), token_counts.token_counts(none, VOCABULARY), simhash.keep_first(none),
    ):
        assert out.count() == 0


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_common_seeds_are_matched_as_if_all_their_places_lay_together(spark, monkeypatch):
    """Which seeds the sample finds common changes nothing: places of these meet the same ones, over the borders of ranges too."""
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 60, n)]
    phrases = [word(12) for _ in range(6)]
    rows = [(i, " ".join(word(6) + sum((phrases[k] + word(int(rng.integers(0, 3))) for k in rng.integers(0, 6, 4)), []))) for i in range(700)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.xxhash64("text")).repartition(7).cache()
    found = lambda: sorted(map(tuple, chaining._matches(texts).collect()))
    hot, firsts = chaining._hot_seeds(texts)
    salted = found()
    assert len(hot) > 20
    for some in (hot[:0], hot[::2]):
        monkeypatch.setattr(chaining, "_hot_seeds", lambda _, some=some: (some, firsts.where(F.col("seed").isin(some.view(np.int64).tolist()))))
        assert found() == salted


def test_texts_are_searched_for_seeds_once(spark):
    common = " ".join(f"c{j}" for j in range(40))
    rows = [(i, f"a{i} b{i} {common} d{i} " + " ".join(f"x{i}_{j}" for j in range(9))) for i in range(3000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.xxhash64("text")).cache()
    hot, firsts = chaining._hot_seeds(texts)
    assert len(hot)
    rows = texts.select("doc", "text").mapInArrow(chaining._seed_rows(None), chaining.SEEDS)
    want = {r.seed: (r.x.doc, r.x.at) for r in rows.groupBy("seed").agg(F.min(F.struct("doc", "at")).alias("x")).collect()}
    got = {r.seed: (r.all.doc, r.all.at) for r in firsts.collect()}
    assert set(got) == set(hot.view(np.int64).tolist())
    assert all(want[k] == v for k, v in got.items())
    plan = chaining._matches(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_last_digits_are_summed_by_column():
    n, reach = 60_000, 150
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 123, (n, reach), np.uint8)
    side = pa.array([x.tobytes() for x in raw], pa.binary())
    numbers = {"digit": np.zeros(n, np.int64), "second": np.zeros(n, np.int64), "key": np.arange(n), "tag": np.arange(n), "at": np.full(n, reach, np.int32)}
    batch = pa.record_batch({**{k: pa.array(v) for k, v in numbers.items()}, "left": side, "right": side})
    tracemalloc.start()
    found = list(suffixes._last_digit(200, 50)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not sum(b.num_rows for b in found)
    assert peak < 60e6  # all bytes as 64-bit numbers alone are 72 MB


def test_stages_send_small_batches(spark, sf, docs):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(5000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("en").alias("lang"))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

    try:
        for given, want in ((before, corpus_pipeline.BATCH), ("0", corpus_pipeline.BATCH), ("100", 100)):
            spark.conf.set(name, given)
            corpus_pipeline.strip_repeated_passages(spark, docs, sf)
            assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) == want
    finally:
        spark.conf.set(name, before)


def test_each_stage_against_a_plainer_version(spark, sf):
    """Every stage on what the one before kept: verdicts row by row, all pairs of shingle sets, all windows of bytes, ids."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language_id", "simhash_near_dedup", "suffix_array_dedup", "packing"]

    clean = stages["toxicity"](spark, docs, sf).cache()
    model = toxicity.fit(docs, labels)
    verdict = {r.doc_id: r.score < 0.7 for r in toxicity.score(docs, model).collect()}
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(k for k, v in verdict.items() if v)

    known = stages["language_id"](spark, clean, sf).cache()
    said = langid.fit(clean)
    want = [r.doc_id for r in clean.collect() if said.predict(r.text)[0] != "und" and said.predict(r.text)[1] >= 0.4]
    assert known.columns == docs.columns and sorted(r.doc_id for r in known.collect()) == sorted(want)

    first = stages["simhash_near_dedup"](spark, known, sf).cache()
    rows = sorted(((r.doc_id, r.text) for r in known.collect()), key=lambda r: r[0])
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = components(len(rows), links)
    wanted, kept = {rows[i][0] for i in range(len(rows)) if root[i] == i}, {r.doc_id for r in first.collect()}
    assert wanted <= kept and len(kept - wanted) <= 0.1 * (len(rows) - len(wanted))

    stripped = stages["suffix_array_dedup"](spark, first, sf).cache()
    texts = {r.doc_id: r.text for r in first.collect()}
    brute = dict(zip(texts, brute_strip(list(texts.values()), 200), strict=True))
    for r in stripped.collect():
        raw = len(r.text.encode())
        assert r.n_chars == len(r.text) and raw <= brute[r.doc_id][0] - brute[r.doc_id][1] <= raw + 6 * brute[r.doc_id][2]
        assert brute[r.doc_id][1] or r.text == texts[r.doc_id]

    t, n = Tokenizer.from_file(VOCABULARY), defaultdict(int)
    for p in stages["packing"](spark, stripped, sf).collect():
        n[p.doc_id] += p.length
    assert n == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in stripped.collect()}


def test_pipeline(spark, sf):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.count() > 0
    kept, all_docs = pieces.select("doc_id").distinct(), spark.read.parquet(f"{sf}/documents.parquet")
    assert kept.join(all_docs, "doc_id", "left_anti").count() == 0
    assert kept.count() > 0.4 * all_docs.count()


def test_pipeline_on_hard_and_empty_tables(spark, tmp_path):
    """Nulls, repeats, clashing columns, and no rows at all go through all five stages."""
    import corpus_pipeline

    names = ["fp", "key", "seed", "__key", "__tag", "__marks", "__place", "many", "place", "node", "centre"]
    rows = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in HARD], SCHEMA).withColumns({n: F.lit(n) for n in names})
    for name, df in (("hard", rows), ("none", rows.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage in ("simhash_near_dedup", "suffix_array_dedup"):
            out = dict(corpus_pipeline.STAGES)[stage](spark, docs, f"{tmp_path}/{name}")
            assert out.columns == docs.columns and all(r[n] == n for r in out.collect() for n in names)
        assert (corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() > 0) == (name == "hard")


def test_very_long_texts(spark):
    """One document of 8 MB, most of it one sentence over and over, beside short ones."""
    rng = np.random.default_rng(14)
    text = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 500_000)) + " the same words again and again" * 150_000
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    assert order_minhash.fingerprint_edits(docs).where("n_chars > 8000000").count() == 1
    assert suffixes.strip_repeats(docs).where("n_removed > 4500000 AND n_spans = 1").count() == 1
    assert simhash.simhash_components(docs).count() == 3 and simhash.keep_first(docs).count() == 3
    assert sum(r.length for r in packing.pack(docs, VOCABULARY).collect() if r.doc_id == 1) > 10**6
    assert token_counts.token_counts(docs, VOCABULARY).where("section = -1").count() == 3
