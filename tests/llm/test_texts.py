"""Token counts, chat formatting, PII, license scans, decontamination, quality and mixing against brute force."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from quillgraph.llm import chat_format as cf
from quillgraph.llm import decontamination as dc
from quillgraph.llm import license_scan as ls
from quillgraph.llm import mixing as mx
from quillgraph.llm import pii
from quillgraph.llm import queries as Q
from quillgraph.llm import quality as ql
from quillgraph.llm import token_counts as tc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    """With columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "s", 1, ["k"]) for i, t in rows], "doc_id long, text string, t string, tokens int, spans array<string>").repartition(2)


# token counts


def greedy(word, vocabulary):
    """Longest match first, written from the rule: inside a word entries that don't end words, at its end one that does."""
    rest, at, n = (*word[:-1], word[-1] + tc.END), 0, 0
    longest = max(map(len, vocabulary))
    while at < len(rest):
        size = next((k for k in range(min(longest, len(rest) - at), 0, -1) if rest[at : at + k] in vocabulary), 0)
        if not size:
            return 0
        at, n = at + size, n + 1
    return n


def test_longest_match_equals_greedy():
    rng = random.Random(1)
    for _ in range(30):
        pieces = {tuple(rng.choice((97, 98, 99)) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(3, 25))}
        pieces |= {(*p[:-1], p[-1] + tc.END) for p in rng.sample(sorted(pieces), k=len(pieces) // 2)} | ({(c + tc.END,) for c in (97, 98, 99)} if rng.random() < 0.7 else set())
        automaton = tc.LongestMatch(sorted(pieces))
        for _ in range(300):
            word = bytes(rng.choice((97, 98, 99)) for _ in range(rng.randrange(1, 12)))
            assert automaton.count(word) == greedy(word, pieces), (word, pieces)


def test_token_counts_with_a_public_vocabulary(spark, sf):
    pieces = tc.load_pieces()
    vocabulary = set(pieces)
    memo = functools.cache(lambda w: greedy(w, vocabulary))
    rows = [*documents(spark, sf)[:60], (-1, None), (-2, ""), (-3, "x" * 30_000), (-4, "The CAT é \x1c"), (-4, "The CAT é \x1c"), (None, "a b")]
    found = Counter(tuple(r) for r in tc.token_counts(frame(spark, rows), pieces).collect())
    want = Counter()
    for i, t in rows:
        counts = [memo(w.encode()) for w in WORDS.findall(lower(t or ""))]
        want[(i, len(counts), sum(c or 1 for c in counts), sum(not c for c in counts))] += 1
    assert found == want
    assert not sum(r[3] for r in found if r[0] is not None and r[0] >= 0)  # every byte has an entry, within words and at their end
    assert tc.token_counts(frame(spark, []), pieces).count() == 0


# chat formatting


def test_events_fold_into_final_messages(spark):
    rows = [
        (1, 1, 1, "message", "system", "be brief"), (1, 2, 2, "message", "user", "hi"), (1, 3, 3, "message", "assistant", ""), (1, 4, 3, "delta", None, "hel"), (1, 6, 3, "delta", None, "lo"),
        (1, 7, 2, "edit", None, "hi there"), (1, 8, 3, "regenerate", None, None), (1, 10, 3, "delta", None, "wor"), (1, 11, 3, "delta", None, "ld"), (2, 1, 1, "delta", None, "only "), (2, 2, 1, "delta", "user", None),
        (2, 3, 1, "delta", None, "pieces"), (None, 1, 1, "message", None, None),
    ]
    random.Random(0).shuffle(rows)
    events = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string")
    found = {(r.conv_id, r.message): (r.role, r.text) for r in cf.reconstruct(events).collect()}
    assert found == {(1, 1): ("system", "be brief"), (1, 2): ("user", "hi there"), (1, 3): ("assistant", "world"), (2, 1): ("user", "only pieces"), (None, 1): ("", "")}


HARD = ["", "\\", "\\b", "\\h###", "###", "#####", "</turn>", "</turn></turn>", "a</turn>\n### user: x", "\\### Assistant: </turn> ok", "\n", ": ", "é\U0001f600 ###", "</</turn>turn>", "\\\\t"]


def test_rendering_is_reversible(spark):
    rows = [(c, k, role, t) for c, role in ((1, "assistant"), (2, "we: ird ### </turn>\\"), (3, "")) for k, t in enumerate(HARD)]
    messages = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    out = cf.render(messages).select("conv_id", "formatted", cf.parse(cf.F.col("formatted")).alias("turns"), cf.under_mask(cf.F.col("formatted"), cf.F.col("loss_mask")).alias("loss")).collect()
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == [(role, t) for c, _, role, t in rows if c == r.conv_id]
        assert r.loss == ("".join(HARD) if r.conv_id == 1 else "")
    assert cf.render(messages.limit(0)).count() == 0


def test_chat_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    talks = defaultdict(list)
    for c, *rest in sorted(rows):
        talks[c].append(rest)
    for r in Q.op2_chat_format(spark, sf).collect():
        turns = talks.pop(r.conv_id)
        loss = "".join(t or "" for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{role}\n{t or ''}\n" for _, role, t in turns)), len(loss), sha(loss))
    assert not talks


def test_turns_are_streamed_in_pieces(spark):
    """Every turn passes the fold as a message event and its deltas: texts come back whole, code points of four bytes and line ends too."""
    rows = [(1, 0, "user", "a\U0001f600\n" * 400), (1, 1, None, None), (1, 2, "assistant", ""), (None, 0, "user", "x" * 256), (None, 0, "user", "x" * 257), (2, 5, "assistant", "one"), (2, 5, "assistant", "one")]
    events = cf.turns_as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    log = events.collect()
    spoken, others = (sum(bool(t) and (role == "assistant") is said for *_, role, t in rows) for said in (True, False))
    assert Counter(e.kind for e in log) == {"message": len(rows), "delta": spoken + sum(-(-len(t or "") // 256) for *_, t in rows), "regenerate": spoken, "edit": others}
    assert len({(e.conv_id, e.seq) for e in log}) == len(log) and all(len(e.text or "") <= 256 for e in log)
    back = sorted((r.conv_id or 0, r.message, r.role, r.text) for r in cf.reconstruct(events).collect())
    assert back == sorted((c or 0, k, role or "", t or "") for c, k, role, t in [(1, 1, *rows[0][2:]), (1, 2, None, None), (1, 3, *rows[2][2:]), (None, 1, *rows[3][2:]), (None, 2, *rows[4][2:]), (2, 1, *rows[5][2:]), (2, 2, *rows[6][2:])])


# personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def odd_texts():
    rng = random.Random(9)
    alphabet = "0123456789.-+@ ()ab_é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(150)]
    texts += ["".join(rng.choice("0123456789") + rng.choice(["", "", " ", "-", ".", " +"]) for _ in range(120)) for _ in range(150)]
    texts += [
        None, "", "a@b.c@d.e", "a@b.co_x@y.zz", "a..b@c.d..e", "1.2.3.4.5.6.7.8", "999.1.1.1", "0255.000.1.0001", "4539 1488 0343 6467", "4539148803436467-4539148803436467", "+1 (017) 555-7713", "+1" + " " * 5000 + "2",
        "x@y.z " * 3000, "7" * 40_000, "a" * 40_000 + "@", "1." * 20_000, "é\U0001f600 me@there.org", "token = \"0123456789abcdef0123456789abcdef\"",
    ]
    return list(enumerate(texts))


@pytest.mark.parametrize("odd", [False, True])
def test_base_spans_are_exact(spark, sf, odd):
    rows = odd_texts() if odd else documents(spark, sf)
    texts = dict(rows)
    for r in pii.find_pii(frame(spark, rows)).collect():
        want = base_spans(texts[r.doc_id] or "")
        assert [tuple(s) for s in r.base] == want, texts[r.doc_id]
        spans = [tuple(s) for s in r.spans]
        assert spans == sorted(spans) and set(want) <= set(spans)


def test_counts_of_the_query_are_those_of_its_spans(spark, sf, tmp_path):
    texts = documents(spark, sf)
    texts += [(10**6 + k, f"my login password = \"{hashlib.md5(str(k).encode()).hexdigest()}\" and her social security number {200 + k}-45-6789, a letter to Mrs Mary Weber") for k in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.op4_pii(spark, str(tmp_path)).collect()
    for r in rows:
        kinds = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert r.n_spans == sum(kinds.values())
        assert (r.n_secret, r.n_id, r.n_person) == (kinds["secret"], kinds["id"], kinds["person"])
    base = Counter((i, pii.KINDS[k]) for i, t in texts for _, k, _ in base_spans(t or ""))
    assert Counter({(r.doc_id, kind): r[f"n_{kind}"] for r in rows for kind in pii.KINDS[:4] if r[f"n_{kind}"]}) == base
    assert all(sum(r[c] for r in rows) >= 30 for c in ("n_secret", "n_id", "n_person"))


def test_weak_supervision_adds_spans_and_leaves_clean_texts(spark):
    rows = [(k, f"please use token = \"{hashlib.md5(str(k).encode()).hexdigest()}\" today") for k in range(40)]
    rows += [(100 + k, f"her card {'4539148803436467'} and mail a{k}@b.org or call +1 202 555 01{k:02}") for k in range(40)]
    rows += [(200 + k, "nothing of the sort in here, 12 eggs at 3.50 each") for k in range(40)]
    found = {r.doc_id: r for r in pii.find_pii(frame(spark, rows)).collect()}
    assert all([pii.KINDS[s.kind_no] for s in found[k].spans] == ["secret"] for k in range(40))
    assert all([pii.KINDS[s.kind_no] for s in found[100 + k].base] == ["card", "email", "phone"] for k in range(40))
    assert all(not found[200 + k].spans for k in range(40))
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_added_spans_hold_against_planted_truth(spark):
    """Precision and recall of what the method adds to the base kinds: planted secrets, phones, ids and names among look-alikes."""
    rng = random.Random(12)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    digits = lambda low, high: str(rng.randrange(low, high))
    true = {
        "secret": lambda: (rng.choice(["api_key=", "access_token: ", "password = "]) + hexes(rng.choice([24, 32, 40])), "my login "),
        "phone": lambda: (f"{rng.choice([212, 415, 617, 703, 949])}-555-{digits(1000, 9999)}", "please call "),
        "id": lambda: (f"{digits(100, 660)}-{digits(10, 99)}-{digits(1000, 9999)}", "her social security number "),
        "person": lambda: (f"{rng.choice(pii.GIVEN_NAMES)} {rng.choice(['Miller', 'Weber', 'Okafor', 'Lindqvist'])}", rng.choice(["a letter to Mrs ", "written by "])),
        # names that no list has, behind a title
        "other person": lambda: (f"{rng.choice(['Olena', 'Kwame', 'Ingrid', 'Bartosz', 'Zoë'])} {rng.choice(['Miller', 'Petrenko', 'Okafor', 'Lindqvist'])}", rng.choice(["a letter to Mrs ", "the talk of Dr. ", "as told by Herr ", "for Frau "])),
    }
    assert not {"Olena", "Kwame", "Ingrid", "Bartosz", "Zoë"} & set(pii.GIVEN_NAMES)
    false = [lambda: f"near {rng.choice(['Alpha', 'Green', 'Upper'])} {rng.choice(['Street', 'Lake', 'Hall'])}", lambda: f"the token: {rng.choice(['required', 'optional', 'somewhere'])} field", lambda: f"parts 000-{digits(10, 99)}-{digits(1000, 9999)} and 9{digits(10, 99)}-00-0000", lambda: f"row {digits(100, 199)}.{digits(100, 999)}.{digits(1000, 9999)} of it"]
    rows, want = [], {}
    for k in range(400):
        kind = rng.choice(list(true))
        hit, cue = true[kind]()
        text = f"some words of prose {cue}"
        want[k] = {(kind.split()[-1], len(text), len(text) + len(hit))}
        rows.append((k, f"{text}{hit} and so on, {rng.choice(false)()} for the rest of the line"))
    found = {r.doc_id: {(pii.KINDS[s.kind_no], s.start, s.end) for s in r.spans} for r in pii.find_pii(frame(spark, rows)).collect()}
    right = sum(len(found[k] & want[k]) for k in want)
    recall, precision = right / sum(map(len, want.values())), right / max(1, sum(map(len, found.values())))
    print(f"added spans: recall {recall:.3f}, precision {precision:.3f}", Counter(kind for k in want for kind, *_ in want[k] - found[k]), Counter(kind for k in want for kind, *_ in found[k] - want[k]))
    assert recall >= 0.9 and precision >= 0.9


# licenses


def test_license_base_places(spark, sf):
    rows = [*documents(spark, sf), (-1, None), (-2, ""), (-3, "CC by-NC cc BY nc. x cc by nc by nc"), (-4, "under the MIT license " * 500), (-5, "apache license version 2"), (-6, "under the mit license"), (-3, "dup")]
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in ls.summary(ls.license_scan(frame(spark, rows))).collect():
        options = []
        for t in texts[r.doc_id]:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
            places = [(k, label) for p, label in ls.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
            starts = [k for k, _ in places]
            options.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in options
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert not r.n_base or r.score == 1


def test_notices_with_errors(spark):
    notices = [n for n, _ in ls.NOTICES]
    rng = random.Random(4)
    rows = []
    for k in range(200):
        text, label = ls.NOTICES[k % len(notices)]
        edits = rng.randrange(ls.errors_of(text) + 1)
        chars = list(text)
        for p in rng.sample(range(1, len(chars) - 1), edits):
            chars[p] = "x"
        rows.append((k, "some words before it " * rng.randrange(4) + "".join(chars) + " and after"))
    rows.append((1000, "released into the wild under a license to be named later by the general public"))
    found = {r.doc_id: r for r in ls.summary(ls.license_scan(frame(spark, rows))).collect()}
    assert all(ls.NOTICES[k % len(notices)][1] in found[k].labels.split(",") for k in range(200))
    assert found[1000].labels == "" and found[1000].score == 0
    assert ls.license_scan(frame(spark, [])).count() == 0


def fewest_edits(notice, line):
    """Fewest edits that turn a stretch of whole words of `line` (words between single spaces) into the notice; a table of all places, no seeds."""
    chars = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    places = np.arange(len(chars) + 1)
    space = np.r_[True, chars == 32]  # what stands before a place
    row = np.where(space, 0, 1 << 20)
    row = np.minimum.accumulate(row - places) + places
    for k, c in enumerate(notice):
        step = np.r_[row[0] + 1, np.minimum(row[:-1] + (chars != ord(c)), row[1:] + 1)]
        row = np.minimum.accumulate(step - places) + places
    return int(row[np.r_[chars == 32, True]].min())


def test_labels_and_score_equal_a_search_of_every_place(spark, sf):
    rng = random.Random(8)
    rows = [(i, t) for i, t in documents(spark, sf) if len(t or "") < 30_000]
    for k in range(120):  # at, under and over the bound of every notice
        notice = ls.NOTICES[k % len(ls.NOTICES)][0]
        chars = list(notice)
        for _ in range(rng.randrange(ls.errors_of(notice) + 3)):
            at = rng.randrange(1, len(chars))
            chars[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "é"])
        rows.append((-1 - k, "It is " + "".join(chars) + rng.choice([" ", ", "]) + "as said"))
    told = {r.doc_id: r for r in ls.summary(ls.license_scan(frame(spark, rows))).collect()}
    for i, text in rows:
        line = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or "")))
        hits = [(label, 1.0) for p, label in ls.PHRASES.items() if f" {p} " in f" {line} "]
        edits = [(label, n, fewest_edits(n, line)) for n, label in ls.NOTICES]
        hits += [(label, 1 - e / len(n)) for label, n, e in edits if e <= ls.errors_of(n)]
        assert told[i].labels == ",".join(sorted({label for label, _ in hits})), (i, edits)
        assert abs(told[i].score - max((x for _, x in hits), default=0.0)) < 1e-9, (i, edits)


# decontamination


def brute_leaks(rows, items, least=13, share=0.8):
    """Every alignment of every item: min(13, its length) words in a row of which enough are equal; no seeds. doc_id -> the columns beside it."""
    out = defaultdict(set)
    split = lambda t: WORDS.findall(lower(t or ""))
    for d, t in rows:
        doc = split(t)
        for i, text in items:
            item = split(text)
            if not item or d is None or i is None:
                continue
            span = min(least, len(item))
            needed = share * least if len(item) >= least else span
            for shift in range(-len(item) + 1, len(doc)):
                at = range(max(0, shift), min(len(doc), shift + len(item)))
                same = [doc[k] == item[k - shift] for k in at]
                if sum(same) >= needed - 1e-9:
                    out[d] |= {(at[0] + s, i, len(item)) for s in range(len(same) - span + 1) if sum(same[s : s + span]) >= needed - 1e-9}
    return {d: (len({w for w, *_ in x}), min(x)[0], max(x)[0], min(i for _, i, _ in x), max(n for *_, n in x)) for d, x in out.items() if x}


def test_leaks_equal_brute_force(spark, sf):
    rng = random.Random(6)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect()]
    rows = [(i, t) for i, t in documents(spark, sf)[:40]] + [(-1, None), (-2, ""), (None, items[0][1])]
    for k in range(24):
        words = items[k % 12][1].split()
        for p in rng.sample(range(len(words)), len(words) * (k % 4) // 12):
            words[p] = "zzz"
        rows.append((1000 + k, f"{'pre ' * k}{' '.join(words)} post"))
        rows.append((1000 + k, "again"))
    items += [(None, "x"), (50, None), (51, "too short"), (52, items[0][1]), (53, "zzz"), (54, "yes " * 40)]
    rows += [(2000, "this is too short a text"), (2001, "no " * 9 + "yes " * 3000), (2002, "yes " * 8)]
    benchmark = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, seed int, beside string")
    for seeds, ids in ((dc.BROADCAST_SEEDS, dc.BROADCAST_DOCS), (0, 0)):
        found = dc.contaminated(frame(spark, rows), benchmark, broadcast_seeds=seeds, broadcast_docs=ids).collect()
        assert {r.doc_id: tuple(r)[1:] for r in found} == brute_leaks(rows, items)
        assert len(found) == len({r.doc_id for r in found})
    assert dc.contaminated(frame(spark, []), benchmark).count() == 0
    assert dc.contaminated(frame(spark, rows), benchmark.limit(0)).count() == 0


def test_leaks_with_other_lengths_and_shares(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdef")
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 24)))) for k in range(30)]
    rows = [(k, " ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(60)] + [(100 + k, f"x {t} y") for k, t in items]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for words, share in ((8, 0.9), (13, 0.8), (16, 0.75), (5, 1.0)):
        found = dc.contaminated(frame(spark, rows), benchmark, words, share).collect()
        assert {r.doc_id: tuple(r)[1:] for r in found} == brute_leaks(rows, items, words, share), (words, share)


def test_items_that_share_a_passage_are_sought_once(spark):
    """10,000 items begin with one passage: as many rows are laid against a document as for one item, and one row comes out."""
    passage = " ".join(f"w{k}" for k in range(20))
    items = spark.range(10_000).selectExpr("id AS item_id", f"concat('{passage} ', 'tail', id) AS text")
    rows = [(k, f"pre {passage} tail{k} post") for k in range(300)]
    found = dc.contaminated(frame(spark, rows), items).collect()
    assert {tuple(r) for r in found} == {(k, 9, 1, 9, 0, 21) for k in range(300)}
    mask = dc.MASKS[0]
    prepared = items.select("item_id", dc.token_hashes(dc.F.col("text")).alias("tokens"), dc.F.lit(False).alias("short"))
    assert dc._sought(prepared, mask, [], range(-5, 13)).filter("n > 0").groupBy("seed").count().agg(dc.F.min("count")).first()[0] == 1


def test_mask_survives_every_two_substitutions_in_13_words():
    for lost in itertools.combinations(range(13), 2):
        assert any(not set(lost) & {at + p for p in m} for m in dc.MASKS for at in range(13 - max(m)))
    for words, allowed in ((13, 2), (20, 2), (13, 3), (8, 1), (5, 0)):
        mask = dc.seed_mask(words, allowed)
        assert all(any(not set(lost) & {at + p for p in mask} for at in range(words - max(mask))) for lost in itertools.combinations(range(words), allowed))


def test_leaks_of_every_substitution_pattern(spark):
    """By the rule alone, 11 of 13 words: every pair of substitutions, every fifth word replaced, short items."""
    item = [f"w{k}" for k in range(60)]
    rows, want = [], set()
    for n, lost in enumerate(itertools.combinations(range(13), 2)):
        rows.append((n, " ".join(["a"] * (n % 7) + ["zz" if k in lost else item[20 + k] for k in range(13)] + ["b"])))
        want.add(n)
    for n, lost in enumerate(itertools.combinations(range(13), 3)):
        rows.append((1000 + n, " ".join("zz" if k in lost else item[20 + k] for k in range(13))))
    for n in range(5):
        rows.append((2000 + n, " ".join("zz" if k % 5 == n else w for k, w in enumerate(item))))
        want.add(2000 + n)
    rows += [(3000, "x Cat sat y"), (3001, "cat x sat"), (3002, f"a {' '.join('abcdefghijkl')} z"), (3003, f"a {' '.join('abcdefghijk')} z"), (3004, "cat sat")]
    want |= {3000, 3002, 3004}
    items = spark.createDataFrame([(1, " ".join(item)), (2, "cat SAT"), (3, " ".join("abcdefghijkl")), (4, ""), (5, None)], "item_id long, text string")
    for limit in (dc.BROADCAST_SEEDS, 0):
        found = dc.contaminated(frame(spark, rows), items, broadcast_seeds=limit).collect()
        assert {r.doc_id for r in found} == want
    assert {tuple(r)[1:] for r in found if r.doc_id == 3000} == {(1, 1, 1, 2, 2)}


# quality


def labelled(spark, n=600):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "of", "river", "stone", "walks", "light,", "over", "a", "house."]) + ("" if rng.random() < 0.5 else rng.choice("aeiou")) for _ in range(rng.randrange(20, 200))]
        text = " ".join(words) if good else rng.choice([" ".join(w + "%%%" for w in words), " ".join([words[0]] * 80), " ".join(words).upper() + "!!!"])
        docs.append((k, text))
        if rng.random() < 0.6:
            labels.append((k, int(good)))
    return docs, labels, {k: int(not ("%%%" in t or t.endswith("!!!") or len(set(t.split())) == 1)) for k, t in docs}


def test_risk_and_its_slope():
    """The slope equals differences of the risk; where the bracket is negative, it lifts the bracket."""
    import numpy as np

    rng = np.random.default_rng(1)
    squash = lambda m: 1 / (1 + np.exp(-m))
    for shift in (-2.0, 2.0):
        p, u = rng.normal(shift, 1, 7), rng.normal(0, 1, 11)
        both, prior = np.r_[p, u], 0.6
        bracket = lambda m: np.log1p(np.exp(m[7:])).mean() - prior * np.log1p(np.exp(m[:7])).mean()
        whole = lambda m: prior * np.log1p(np.exp(-m[:7])).mean() + max(0.0, bracket(m))
        assert abs(ql.risk(squash(p), squash(u), prior) - whole(both)) < 1e-9
        aim = whole if bracket(both) >= 0 else lambda m: -bracket(m)
        steps = np.eye(18) * 1e-6
        numeric = np.array([(aim(both + e) - aim(both - e)) / 2e-6 for e in steps])
        assert np.abs(ql.risk_slope(squash(p), squash(u), prior) - numeric).max() < 1e-6
    assert bracket(both) < 0


def test_samples_are_the_smallest_hashes(spark):
    """With and without the bound on hashes, and with ids that rows repeat too often for it."""
    rows = spark.range(5000).selectExpr("id % 4000 AS doc_id")
    hot = rows.selectExpr("IF(doc_id < 3950, 1, doc_id) AS doc_id")
    for table, n in ((rows, 20), (rows, 3000), (hot, 40)):
        want = table.distinct().orderBy(ql.F.xxhash64(ql.F.lit(7), "doc_id"), "doc_id").limit(n).collect()
        assert sorted(ql._sample(table, 7, n).collect()) == sorted(want)


def test_class_prior_of_a_known_mixture():
    import numpy as np

    rng = np.random.default_rng(2)
    for prior in (0.3, 0.6, 0.85):
        draw = lambda n, good: rng.normal(1.5 if good else -1.5, 1, (n, 5))
        n = round(4000 * prior)
        found = ql.class_prior(draw(1500, True), np.vstack([draw(n, True), draw(4000 - n, False)]))
        assert abs(found - prior) < 0.08, (prior, found)


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    network = ql.train(frame(spark, docs), table)
    scores = {r.doc_id: r.score for r in ql.score(frame(spark, docs), network).collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 100
    assert sum((scores[k] >= 0.7) == truth[k] for k in held) / len(held) > 0.97
    again = ql.train(frame(spark, docs), table)
    assert (again.w1 == network.w1).all()
    odd = frame(spark, [(1, None), (2, ""), (None, "x y"), (1, "word " * 50_000), (1, None)])
    assert all(0 <= r.score <= 1 for r in ql.score(odd, network).collect()) and ql.score(odd, network).count() == 5
    assert ql.score(frame(spark, []), network).count() == 0


def test_quality_never_learns_from_held_out_labels(spark):
    docs, labels, _ = labelled(spark, 200)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    flipped = spark.createDataFrame([(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q) for k, q in labels], "doc_id long, quality int")
    a, b = ql.train(frame(spark, docs), table), ql.train(frame(spark, docs), flipped)
    assert (a.w1 == b.w1).all() and (a.w2 == b.w2).all()


def test_quality_without_labels_keeps_everything(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert ql.train(docs, none) is None
    assert [r.score for r in ql.score(docs, None).collect()] == [1.0, 1.0]
    assert ql.classify(docs, None).count() == 2


# mixing


def filled(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / w for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def apportioned(votes, seats, most):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        open_ = [v for v in votes if won[v] < most[v]]
        if not open_:
            break
        won[min(open_, key=lambda v: (-votes[v] / (2 * won[v] + 1), v))] += 1
    return won


def test_sainte_lague_equals_the_highest_quotients(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(40):
        votes = {k: rng.choice([0.0, 1.0, rng.random() * 10 ** rng.randrange(1, 6)]) for k in range(rng.randrange(1, 12))}
        votes[0] += 1
        seats, most = rng.randrange(0, 300), {k: rng.choice([2, 50, 1000]) for k in votes}
        seats = min(seats, sum(min(most[k], int(v / sum(votes.values()) * seats)) for k, v in votes.items()))
        most = dict.fromkeys(votes, 1000) if g % 2 else {k: max(most[k], int(votes[k] / sum(votes.values()) * seats) + 1) for k in votes}
        rows += [(g, k, v, seats, most[k]) for k, v in votes.items()]
        want |= {(g, k): n for k, n in apportioned({k: v for k, v in votes.items() if v}, seats, most).items()}
    table = spark.createDataFrame(rows, "g long, k long, votes double, total long, most long")
    found = {(r.g, r.k): r.seats for r in mx.sainte_lague(table, "k", ["g"]).collect() if r.votes}
    assert found == want


def mixture(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size int, src int").repartition(3)


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    rows = []
    for s, n in (("big", 400), ("é", 30), ("Z", 5), (None, 60), ("tiny", 1), ("none", 2)):
        rows += [(len(rows) + k, "" if s == "none" else " \t".join(["w"] * rng.choice([1, 7, 300, 900])), s) for k in range(n)]
    rows += [(9001, "x " * 200_000, "long"), (9002, None, "big"), (9003, None, None), (9004, "a b", "big"), (9004, "a b", "big")]
    out = mx.mix(mixture(spark, rows), shard_words=20_000).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, *_ in rows)
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    texts = {i: len(WORDS.findall(t or "")) for i, t, _ in rows}
    assert all(r.size == texts[r.doc_id] and r.source_size == sizes[r.source] for r in out)
    want = filled(dict(sizes))
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s, t in want.items():
        shards = max(1, -(-sizes[s] // 20_000))
        assert abs(taken[s] - t) <= 16 * (2 + shards), (s, t, taken[s])
    again = mx.mix(mixture(spark, rows[::-1]).repartition(5), shard_words=20_000).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)
    assert mx.mix(mixture(spark, [])).count() == 0
    assert [r.taken for r in mx.mix(mixture(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def test_equal_rows_and_groups_of_shards_are_spread(spark, monkeypatch):
    """3,000 equal rows go to all shards; apportioning groups of shards first keeps every source at its target and reruns alike."""
    rows = [(5, "w " * 20, "a")] * 3000 + [(None, None, "a")] * 40 + [(k, "v " * (k % 90), "b" if k % 3 else "a") for k in range(900)]
    apart = mx._told_apart(spark.createDataFrame([(5, "a", 20, 77)] * 3000, "doc_id long, source string, size long, mark long"))
    assert Counter(r.n for r in apart.groupBy(mx.F.pmod(mx.F.xxhash64("mark"), mx.F.lit(30))).agg(mx.F.count("*").alias("n")).collect()).total() == 30 and apart.select("mark").distinct().count() == 3000
    monkeypatch.setattr(mx, "_COPIES", 64)
    assert mx._told_apart(spark.createDataFrame([(5, "a", 20, 77)] * 300 + [(6, "a", 20, 7)] * 64, "doc_id long, source string, size long, mark long")).groupBy("doc_id").count().rdd.collectAsMap() == {5: 300, 6: 64}
    monkeypatch.setattr(mx, "SHARD_GROUP", 3)
    out = mx.mix(mixture(spark, rows), shard_words=3_000).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in out) == sorted((i is None, i or 0, len((t or "").split())) for i, t, _ in rows)
    taken, sizes = Counter(), Counter()
    for r in out:
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        assert 0 <= r.taken <= 3 * r.size
    want = filled(dict(sizes))
    # a shard's last block may be short, and counts up to three times
    assert all(abs(taken[s] - want[s]) <= 16 * (2 + 3 * -(-sizes[s] // 3_000)) for s in want), (taken, want)
    again = mx.mix(mixture(spark, rows[::-1]), shard_words=3_000).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in out)


def test_taken_words_equal_brute_force(spark):
    """Word by word: shards laid out in the operator's order of hashes, blocks cut, whole rounds and the picked blocks counted."""
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 16, 40, 333])), rng.choice(["a", "a", "a", "b", None])) for k in range(500)]
    rows += [(7, "again this id", "a"), (None, "no id", "b"), (None, None, None), (9000, "x " * 5000, "b"), (9001, "one", "tiny")]
    block, per_shard, cap, seed = 16, 3000, 3, 17
    docs = mixture(spark, rows)
    F = mx.F
    key = F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit("")))
    laid = [(r.doc_id, r.source, len(WORDS.findall(r.text or "")), r.mark, r.deal) for r in docs.select("doc_id", "source", "text", key.alias("mark"), F.xxhash64(key).alias("deal")).collect()]
    sizes = Counter()
    for _, s, n, *_ in laid:
        sizes[s] += n
    want = filled(dict(sizes))
    names = sorted(want, key=lambda s: (s is None, (s or "").encode()))
    seats = apportioned({k + 1: want[s] for k, s in enumerate(names)}, round(sum(want.values()) / block), {k + 1: cap * -(-sizes[s] // block) for k, s in enumerate(names)})
    brute = []
    for src, s in enumerate(names, 1):
        shards = defaultdict(list)
        for i, source, n, mark, deal in laid:
            if source == s:
                shards[deal % max(1, -(-sizes[s] // per_shard))].append((mark, i, n))
        words = {h: sum(n for *_, n in x) for h, x in shards.items()}
        quota = apportioned({h: float(n) for h, n in words.items() if n}, seats[src], {h: cap * -(-n // block) for h, n in words.items()})
        turns = {r.shard: r.turn for r in spark.createDataFrame([(src, h) for h in shards], "src int, shard long").select("shard", F.xxhash64(F.lit(seed + 1), "src", "shard").alias("turn")).collect()}
        for h, own in shards.items():
            n = max(1, -(-words[h] // block))
            rounds, rest = divmod(quota.get(h, 0), n)
            at = 0
            for _, i, size in sorted(own, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
                more = sum((w // block * mx._PRIME + turns[h]) % n < rest for w in range(at, at + size))
                brute.append((i, s, size, size * rounds + more))
                at += size
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    found = [(r.doc_id, r.source, r.size, r.taken) for r in mx.mix(docs, block, per_shard, cap, seed).collect()]
    assert sorted(found, key=order) == sorted(brute, key=order)
