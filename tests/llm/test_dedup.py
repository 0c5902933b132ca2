"""Exact dedup, SimHash and substring dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest
import xxhash
from quillgraph.llm import exact_dedup as ed
from quillgraph.llm import queries as Q
from quillgraph.llm import simhash as sh
from quillgraph.llm import substring_dedup as sd
from quillgraph.llm.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def odd_rows():
    rng = random.Random(5)
    base = " ".join(rng.choice("alpha beta gamma delta Éa ß x yy zzz".split()) + str(rng.randrange(60)) for _ in range(300))
    near = base.split()
    near[7] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b"), (5, "ab"), (6, " a  b "), (7, "A b"), (8, base), (9, base), (10, " ".join(near)), (11, base + " tail"),
        (12, "x " * 500), (13, "x " * 30), (14, " \x1c  b"), (15, "one"), (16, "one two"), (17, "One Two"), (18, "é" * 3000), (19, base[5:900]), (20, "y " + base),
    ]


def frame(spark, rows):
    """With columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "s", 1, "k") for i, t in rows], "doc_id long, text string, t string, fp int, key string").repartition(3)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((i, t or ""))
    out = {}
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        for i, _ in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(key.encode()).hexdigest())
    return out


def brute_fingerprint(text):
    words = WORDS.findall(lower(text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=2):
    reach = {i: i for i in fps}

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                reach[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_substring(rows, window=20):
    first, out = {}, {}
    words = {i: WORDS.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_exact_dedup(spark, sf, odd):
    rows = odd_rows() if odd else documents(spark, sf)
    found = ed.exact_dedup(frame(spark, rows)).rows().collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == brute_exact(rows)
    assert len(found) == len(rows)


def test_what_is_carried_weighs(spark, monkeypatch):
    """Distinct texts that carry wide columns: the trie is cut as often as these ask for, and the groups are those of one trie."""
    monkeypatch.setattr(ed, "TRIE_BYTES", 200_000)
    rows = [(k, f"text {k % 400} " + "x " * (k % 7), "wide " * 2000, [str(k)] * 50, {"a": "b" * 300}) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string, list array<string>, map map<string,string>").coalesce(1)
    found = ed.exact_dedup(docs, carry=docs.columns)
    assert found.terminals.count() > 400  # subtrees were cut, so texts have several terminals
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r[1])].append(r)
    want = {min((-len(r[1]), r[0]) for r in g)[1] for g in groups.values()}
    kept = found.kept().collect()
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)
    assert all((r.text, r.more, r.list, r.map) == rows[r.doc_id][1:] for r in kept)


def test_exact_dedup_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a "), (2, "b"), (None, "c"), (None, "c")]
    result = ed.exact_dedup(frame(spark, rows), carry=["doc_id", "text", "key"])
    kept = sorted((r.text, r.key) for r in result.kept().collect())
    assert kept == [("a ", "k"), ("b", "k"), ("c", "k")]
    assert sum(r.kept for r in result.rows().collect()) == 3


def test_trie_spills_by_subtree():
    rng = random.Random(1)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode() for _ in range(400)]
    merger = ed._Merger(budget=40)
    for n, k in enumerate(keys):
        merger.add(k, (n, 0, n, 1))
    want = defaultdict(list)
    for n, k in enumerate(keys):
        want[k].append(n)
    assert sorted(sorted(r[0] for r in g) for g in merger.groups()) == sorted(want.values())
    trie = ed.PatriciaTrie()
    for k in keys:
        trie.terminal(k).owner = k
    assert dict(trie.items()) == {k: k for k in keys}


def test_local_trie_spills(spark, monkeypatch):
    rows = [(i, f"{i % 7} text {i % 13}") for i in range(300)]
    monkeypatch.setattr(ed, "TRIE_BYTES", 200)
    schema = ed.exact_dedup(frame(spark, rows))
    assert {r.doc_id: tuple(r)[1:] for r in schema.rows().collect()} == brute_exact(rows)


@pytest.mark.parametrize("odd", [False, True])
def test_simhash(spark, sf, odd):
    rows = odd_rows() if odd else documents(spark, sf)
    found = sh.simhash_components(frame(spark, rows), 3, sh.exact_layout(2)).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {r.doc_id: int.from_bytes(bytes(r.fp), "big") for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == brute_components(fps)


def test_links_of_close_fingerprints(spark):
    """Chains and a dense bucket: all pairs at two bits or fewer connect, no others."""
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    fps = {}
    for s in seeds:
        x = s
        for _ in range(200):
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
            fps[len(fps)] = x
            if rng.random() < 0.2:
                x ^= 0b11111 << rng.randrange(50)
    for k in range(300):  # 300 fingerprints that share six blocks
        fps[len(fps)] = seeds[0] ^ (rng.getrandbits(16))
    unique = {v: k for k, v in sorted(fps.items(), reverse=True)}
    fps = {k: v for v, k in unique.items()}
    reps = spark.createDataFrame([(k, v.to_bytes(8, "big")) for k, v in fps.items()], "doc_id long, fp binary").repartition(3)
    links = sh.link_fingerprints(reps, sh.exact_layout(2))
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert {i: found.get(i, i) for i in fps} == brute_components(fps)
    assert links.count() < 20 * len(fps)


def test_wide_layout_finds_similar_documents(spark):
    rng = random.Random(11)
    rows, pairs = [], []
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for p in rng.sample(range(0, 300, 10), 4):
            other[p] = "new"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = ({tuple(x[i : i + 5]) for i in range(296)} for x in (words, other))
        pairs.append(len(a & b) / len(a | b))
    assert min(pairs) > 0.8
    found = {r.doc_id: r.component_id for r in sh.near_duplicates(frame(spark, rows)).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(120)) >= 117
    assert all(found[2 * k] == 2 * k for k in range(120))


def grams(text, k=5):
    w = lower(text).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def like(a, b):
    """Cosine of the texts' sets of five-word shingles."""
    x, y = grams(a), grams(b)
    return len(x & y) / max(1, len(x) * len(y)) ** 0.5


def brute_near(rows, similarity=0.8):
    reach = {i: i for i, _ in rows}

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if like(a, b) >= similarity - 1e-9:
                x, y = find(i), find(j)
                reach[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("size", [400, 1_000_000])
def test_near_duplicates_at_the_threshold(spark, size):
    """At 0.80 pairs are found, below none is, with the blocks of a small corpus and with those of a large one."""
    rng = random.Random(12)
    rows, low, high = [], set(), set()
    for k in range(200):
        words = [f"w{rng.randrange(50000)}" for _ in range(454)]
        n = 18 if k % 2 else 20  # 450 shingles, of which each new word changes five
        other = ["new" + str(p) if p % 20 == 7 and p // 20 < n else w for p, w in enumerate(words)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        (high if (j := like(rows[-2][1], rows[-1][1])) >= 0.8 - 1e-9 else low).add(k)
        assert 0.77 < j < 0.81
    found = {r.doc_id: r.component_id for r in sh.near_duplicates(frame(spark, rows), layout=sh.wide_layout(size)).collect()}
    assert len(high) == len(low) == 100
    assert sum(found[2 * k + 1] == 2 * k for k in high) >= 97
    assert all(found[2 * k + 1] == 2 * k + 1 for k in low)


def test_pairs_behind_a_refuted_link(spark):
    """Three texts in one bucket: the first is too far from both others, which are close."""
    words = [f"w{k}" for k in range(454)]
    change = lambda places, mark: " ".join(mark if p in places else w for p, w in enumerate(words))
    rows = [(1, " ".join(words)), (2, change(range(7, 387, 20), "x")), (3, change(range(7, 427, 20), "x"))]
    assert like(rows[0][1], rows[1][1]) < 0.8 and like(rows[0][1], rows[2][1]) < 0.8 < like(rows[1][1], rows[2][1])
    assert {r.doc_id: r.component_id for r in sh.near_duplicates(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 2}


def template_group(n, seed=21):
    """Near copies of one text, each with a few to many words changed: some pairs are similar, most are on the edge."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(150)]
    return [(k, " ".join(f"{w}x{rng.randrange(3)}" if rng.random() < rate else w for w in words)) for k in range(n) for rate in [rng.choice((0.01, 0.03, 0.05, 0.07, 0.09))]]


def test_large_trees_and_buckets_are_split(spark, monkeypatch):
    """A group far beyond what a task compares, or a bucket may hold, gets the components of all pairs."""
    rows = template_group(300)
    want = brute_near(rows)
    assert 5 < sum(v == k for k, v in want.items()) < 200
    monkeypatch.setattr(sh, "CHUNK_NODES", 24)
    found = {r.doc_id: r.component_id for r in sh.near_duplicates(frame(spark, rows)).collect()}
    assert sum(found[k] == want[k] for k in want) >= 297
    whole = found
    monkeypatch.setattr(sh, "BUCKET_ROWS", 16)
    found = {r.doc_id: r.component_id for r in sh.near_duplicates(frame(spark, rows)).collect()}
    assert found == whole


def test_split_buckets_lose_no_link(spark, monkeypatch):
    """A chain of fingerprints, each close to the next alone, in one bucket: components are those of all pairs, however small the pieces."""
    layout = sh.Layout(1, 1, 3, 8, 1)  # one key: the first byte, equal for all
    rng = random.Random(2)
    fps = [0]
    for _ in range(399):
        bits = rng.sample(range(8, 64), rng.choice([2, 3, 3, 9]))
        fps.append(fps[-1] ^ sum(1 << b for b in bits))
    rng.shuffle(fps)
    reps = spark.createDataFrame([(k, fp.to_bytes(8, "big")) for k, fp in enumerate(fps)], "doc_id long, fp binary").repartition(5)
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {k: root(k) for k in range(len(fps))}
    assert 20 < len(set(want.values())) < 200
    for most in (1 << 17, 64, 16, 3):
        monkeypatch.setattr(sh, "BUCKET_ROWS", most)
        found = {r.node: r.component for r in connected_components(sh.link_fingerprints(reps, layout)).collect()}
        assert {k: found.get(k, k) for k in want} == want, most


def test_confirmed_links_are_those_of_all_pairs(spark, monkeypatch):
    rows = template_group(200, 5)
    monkeypatch.setattr(sh, "CHUNK_NODES", 16)
    texts = spark.createDataFrame([(7, k, t) for k, t in rows] + [(8, 1000, "a b c"), (8, 1001, "")], "tree long, node long, text string")
    links = sh._confirmed(sh._shingle_sets(texts, 5), 0.8)
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert {k: found.get(k, k) for k, _ in rows} == brute_near(rows)
    assert not {1000, 1001} & set(found)


def test_rows_are_told_apart_by_text(spark):
    """An id with two texts, of which one is a near copy: only that row goes; a row without an id goes where another has one."""
    a, b = (" ".join(f"{m}{k}" for k in range(200)) for m in "pq")
    rows = [(1, a), (2, b), (2, a + " more"), (None, b + " tail"), (3, "short"), (3, "other short text of six words")]
    found = sh.near_duplicates(frame(spark, rows)).collect()
    text_of = {r.h: r.text for r in spark.createDataFrame(rows, "doc_id long, text string").select(sh.text_hash(sh.F.col("text")).alias("h"), "text").collect()}
    assert {(r.doc_id, text_of[r.hash]): (r.component_id, r.kept) for r in found} == {
        (1, a): (1, True), (2, a + " more"): (1, False), (2, b): (2, True), (None, b + " tail"): (2, False), (3, "short"): (3, True), (3, "other short text of six words"): (3, True),
    }


def test_runs_of_sorted_batches():
    import pyarrow as pa
    from quillgraph.llm.common import runs

    rng = random.Random(8)
    for _ in range(300):
        keys = sorted(rng.randrange(6) for _ in range(rng.randrange(40)))
        cuts = sorted(rng.randrange(len(keys) + 1) for _ in range(rng.randrange(6)))
        batches = [pa.record_batch({"k": pa.array(keys[i:j], pa.int64())}) for i, j in zip([0, *cuts], [*cuts, len(keys)])]
        most = rng.choice((2, 5, 100))
        got, pieces = [], []
        for parts, cut in runs(iter(batches), most):
            own = [k for p in parts for k in p.column(0).to_pylist()]
            assert own
            got += own
            if cut:
                assert len(set(own)) == 1
                pieces.append(own[0])
            else:
                assert not set(own) & set(pieces) and all(own.count(k) == keys.count(k) for k in set(own))
        assert got == keys
        assert all(keys.count(k) > most for k in pieces)


def test_repeated_shingles_count_once(spark):
    words = [f"w{k}" for k in range(200)]
    footer = "all rights are reserved here "
    one, two = (" ".join(f"{m}{k}" for k in range(200)) for m in "pq")
    rows = [(1, " ".join(words)), (2, " ".join([*words[:24] * 20, *words])), (3, footer * 200 + one), (4, footer * 200 + two)]
    assert like(rows[0][1], rows[1][1]) > 0.95 and like(rows[2][1], rows[3][1]) < 0.05
    assert {r.doc_id: r.component_id for r in sh.near_duplicates(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 201), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 101)}, 201: 200}


@pytest.mark.parametrize("odd", [False, True])
def test_substring_dedup(spark, sf, odd, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_WORDS", 3000)
    rows = odd_rows() if odd else documents(spark, sf)
    found = sd.substring_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute_substring(rows)


def test_substring_dedup_at_every_alignment(spark):
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(20)]
    rows = [(1, " ".join(passage))]
    for k in range(40):
        rows.append((k + 2, " ".join([f"r{rng.random()}" for _ in range(k)] + passage + [f"s{rng.random()}" for _ in range(5)])))
    found = sd.substring_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, **{k + 2: 20 for k in range(40)}}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute_substring(rows)


def test_covers_meet_every_distance():
    for period, cover in sd.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert ed.exact_dedup(none, carry=["doc_id"]).rows().count() == 0
    assert sh.simhash_components(none, 3, sh.exact_layout(2)).count() == 0
    assert sd.substring_dedup(none).count() == 0


def test_missing_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (None, text), (3, text), (3, text), (4, text)]
    found = sorted((r.doc_id or 0, r.n_removed) for r in sd.substring_dedup(frame(spark, rows)).collect())
    assert found == [(0, 0), (0, 0), (3, 0), (3, 0), (4, 30)]
    assert [r.component_id for r in sh.simhash_components(frame(spark, rows), 3, sh.exact_layout(2)).collect()] == [3] * 5


def test_query_columns(spark, sf):
    assert Q.op7_simhash(spark, sf).columns[:3] == ["doc_id", "fingerprint", "component_id"]
