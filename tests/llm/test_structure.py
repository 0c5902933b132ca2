"""URL filters, fill-in-middle and conversation repair against brute force and exact round trips."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from quillgraph.llm import conversation_repair as cr
from quillgraph.llm import fill_middle as fm
from quillgraph.llm import queries as Q
from quillgraph.llm import url_filter as uf

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

# URL filters


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path, rules):
    fits = [(len(h.split(".")) if h else 0, len(p), v == "allow", h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "HTTPS://A.Example.NET/en/x?y=/de/#z", "http://example.net", "http://example.net/en", "http://xexample.net/en/", "http://example.com/de/1://b", "http://m.example.com/dee/",
    "http://org/fr/", "http://a.org?/fr/", "http://a.org#/fr/", "http://a..org/fr/", "http://org./fr/", "x://é.org/fr/é", "://b.net/", "http://u@net:80/", "http://example.net//en/", "http://example.net/en/\n?", "http://ÀNET/x", "http://" + "a." * 3000 + "net/" + "s/" * 3000,
]


def test_split_and_rules_of_the_query(spark, sf):
    rows = [(k, u, "clash", "clash") for k, u in enumerate([*URLS, *URLS])] + [(None, "http://net/", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(Q.URL_RULES, "host string, path string, verdict string")
    want = sorted(((i, *brute_split(u), *brute_rule(*brute_split(u), Q.URL_RULES)) for i, u, *_ in rows), key=str)
    for limit in (1 << 20, 0):
        assert sorted(map(tuple, uf.judge(pages, rules, broadcast_bytes=limit).collect()), key=str) == want
    found = {r.page_id: tuple(r)[1:] for r in Q.op11_url_filter(spark, sf).collect()}
    table = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    assert found == {i: (*brute_split(u), *brute_rule(*brute_split(u), Q.URL_RULES)) for i, u in table}


def test_random_rules_by_trie_and_by_join(spark):
    rng = random.Random(3)
    label, segment = lambda: rng.choice(["a", "b", "ab", "é", ""]), lambda: rng.choice(["", "x", "xy", "y", "é"])
    for _ in range(4):
        rules = {(".".join(label() for _ in range(rng.randrange(0, 4))), "".join("/" + segment() for _ in range(rng.randrange(0, 4))), rng.choice(["allow", "block"])) for _ in range(60)}
        rules = [*rules, (None, "/x", "block"), ("A.É", "/x", "block")]
        urls = ["s://" + ".".join(label() for _ in range(rng.randrange(0, 5))) + "".join("/" + segment() for _ in range(rng.randrange(0, 5))) for _ in range(400)]
        urls += ["s://b.A.É/x", "s://a.é/x"]
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
        table = spark.createDataFrame([(h, p, v, 1) for h, p, v in rules], "host string, path string, verdict string, found int")
        plain = [((h or "").replace("A", "a"), p, v) for h, p, v in rules]
        want = sorted(((k, *brute_split(u), *brute_rule(*brute_split(u), plain)) for k, u in enumerate(urls)), key=str)
        for limit in (1 << 20, 0):
            assert sorted(map(tuple, uf.judge(pages, table, broadcast_bytes=limit).collect()), key=str) == want


def test_no_rules_no_pages_and_another_default(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    for limit in (1 << 20, -1):
        assert [tuple(r) for r in uf.judge(pages, none, "block", broadcast_bytes=limit).collect()] == [(1, "a", "/b", None, "block")]
        assert uf.judge(pages.limit(0), none, broadcast_bytes=limit).count() == 0


# fill in the middle


def test_rope_splits_and_joins_like_strings():
    rng = random.Random(5)
    for size in (0, 1, 5, 127, 128, 129, 3000):
        text = "".join(rng.choice(["a", "bé", "\U0001f600", " ", "\n", "\x0b ", "\xa0", "\x1c"]) for _ in range(size))
        tree, units = fm.rope(text), UNITS.findall(text)
        assert (tree.units, tree.points, fm.flat(tree)) == (len(units), len(text), text)
        for rank in {0, len(units), *(rng.randrange(len(units) + 1) for _ in range(20))}:
            left, right = fm.split(tree, rank)
            assert (fm.flat(left), fm.flat(right), left.units, left.points) == ("".join(units[:rank]), "".join(units[rank:]), rank, len("".join(units[:rank])))
        for rank in {0, len(text), *(rng.randrange(len(text) + 1) for _ in range(20))}:
            left, right = fm.split(tree, rank, by_units=False)
            assert (fm.flat(left), fm.flat(right), fm.flat(fm.join(left, right))) == (text[:rank], text[rank:], text)


def brute_middle(doc_id, text):
    text = text or ""
    units, digest = UNITS.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, text, text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return (doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text)


HARD = [None, "", " ", "\n\t", "x", " x", "x ", "a<", "P>b <S <M", "a <P> b", "<M>", "<<P", "\xa0 \x1c é \U0001f600", "w " * 40_000, "x" * 100_000, "<" * 300 + " " + ">" * 300, "P>" * 9 + " <" * 9]


def test_fill_in_middle_against_brute_force(spark, sf):
    rows = [(i, t) for i, t in enumerate(HARD * 8)] + [(3, "a b c"), (3, "a b c"), (None, "a b c"), (-(2**60), "a b c d")]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, t string, form int").repartition(3)
    found = fm.fill_in_middle(docs).collect()
    assert sorted(map(tuple, found), key=str) == sorted((brute_middle(i, t) for i, t in rows), key=str)
    assert {r.form for r in found} == {"plain", "spm", "psm"}
    assert fm.fill_in_middle(docs.limit(0)).count() == 0


def test_bytes_that_are_no_utf8_come_back(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "cast(unhex('61FF2062EDA0802063C3') AS string) AS text")
    rows = fm.fill_in_middle(docs).selectExpr("form", "hex(cast(restored AS binary)) AS back").collect()
    assert {r.back for r in rows} == {"61FF2062EDA0802063C3"}
    assert len({r.form for r in rows}) > 1


# conversation repair


def cheapest(marks):
    """Shortest path over (row, state) by (cost, audit), written from the rule: states nothing, s, u, a."""
    follow, done, heap = {("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a", ("s", ""): "s"}, set(), [(0, "", 0, "", ())]
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(marks) and state in ("", "a"):
            return cost, audit, out
        ways = [(3, "I", at, new, "user" if new == "u" else "assistant", "") for new in "ua"]
        if at < len(marks):
            role, text, fault = marks[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways += [(more, "K", at + 1, role[:1], role, text)] + [(3 + more, "R", at + 1, new, "user" if new == "u" else "assistant", text) for new in "ua"]
        for extra, letter, to, new, role, text in ways:
            if (new, state) in follow:
                heapq.heappush(heap, (cost + extra, audit + letter, to, follow[new, state], (*out, f"{role}:{text}")))


def brute_repair(rows):
    """rows: (turn, role, text) after damage -> all columns but conv_id."""
    byte = lambda s: s.encode()
    rows = sorted(((t, r, x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, byte(r[1]), byte(r[2])))
    marks, seen, counts = [], set(), defaultdict(int)
    for _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        marks.append((role, text, fault))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, told = cheapest(marks)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()


def harmed(conv_id, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    harm = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
    if harm == 0:
        return []
    text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
    return [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)


def conversations(rng):
    rows = []
    for conv_id in [None, *range(400)]:
        for turn in rng.choices([None, *range(9)], k=rng.choice([1, 1, 2, 3, 5, 8, 14])):
            rows.append((conv_id, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "", "tool", None, "é", "Assistant", "s"]), rng.choice(["a.", "a. \n", "a", "?", "", " \t", None, "é!", "b.\xa0", "a.", "c?", "x" * 5000 + "."])))
    return rows + rows[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_shortest_paths(spark, tmp_path, seed):
    rows = conversations(random.Random(seed))
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, lost string, cost int").repartition(3)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    want = defaultdict(list)
    for r in rows:
        want[r[0]] += harmed(*r)
    found = {r.conv_id: tuple(r)[1:] for r in Q.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert found == {k: brute_repair(v) for k, v in want.items()}
    assert any(not v for v in want.values())


def test_repair_of_the_tables(spark, sf):
    want = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        want[r.conv_id] += harmed(*r)
    found = {r.conv_id: tuple(r)[1:] for r in Q.op13_conversation_repair(spark, sf).collect()}
    assert found == {k: brute_repair(v) for k, v in want.items()}


def test_layers_equal_shortest_paths_on_long_conversations():
    rng = random.Random(9)
    for size in (*range(30), 200, 400):
        for _ in range(20):
            marks = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), "", rng.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(size)]
            codes = {"blank": 0, "duplicate": 1, "truncated": 2, None: None}
            cost, audit, state = cr.least_edits([(r[:1].encode(), codes[f], 0) for r, _, f in marks])
            assert (cost, audit + cr._closing(state)) == cheapest(marks)[:2]


@pytest.mark.parametrize("most", [1, 7, 30])
def test_long_conversations_in_parts(spark, most):
    """Conversations beyond the bound are dealt to parts; the result is that of one task. A null id, equal rows in hundreds, null turns, all blank."""
    rng = random.Random(most)
    text = lambda: rng.choice(["a.", "b", "c?", "d!", "", " ", "é.", "e.\n", "f"] + [f"t{rng.randrange(99)}."] * 6)
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "tool"])
    rows = [(c, rng.choice([None, *range(n)]), role(), text()) for c, n in ((None, 60), (1, 200), (2, 35), (3, 5)) for _ in range(n)]
    rows += [(1, 50, "user", "same.")] * 300 + [(4, k, "assistant", " ") for k in range(80)] + [(5, 0, "user", "x?")] * 90
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(4)
    found = cr.repair(frame, long_rows=most)
    parts = found.select("conv_id", "part", "parts").collect()
    assert max(r.parts for r in parts) > 1 and all({r.part for r in parts if r.conv_id == c} == set(range(next(r.parts for r in parts if r.conv_id == c))) for c in {r.conv_id for r in parts})
    got = {r.conv_id: tuple(r)[1:] for r in cr.digests(found).collect()}
    want = defaultdict(list)
    for c, *r in rows:
        want[c].append(tuple(r))
    assert got == {c: brute_repair(v) for c, v in want.items()}


def test_repaired_turns_follow_the_grammar(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "hello."), (1, 1, "system", "late."), (1, 2, "user", "so?"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in cr.repair(frame).collect()}
    assert (found[1].audit, found[1].cost, [tuple(t) for t in found[1].turns]) == ("DKKI", 7, [("system", "late."), ("user", "so?"), ("assistant", "")])
    assert (found[2].audit, found[2].cost, found[2].blank, found[2].turns) == ("D", 4, 1, [])
    assert cr.repair(frame.limit(0)).count() == 0
