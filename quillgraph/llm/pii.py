"""Personal data by weak supervision, with DataFrame functions only.

Regular expressions propose spans. Three labelers vote on each: the regex labeler on its shape, the
gazetteer labeler on listed parts (top-level domains, card prefixes, area codes, given names), the context
labeler on cue words before it. Expectation-maximisation estimates how reliable each labeler is from how
often they agree, and gives every vote pattern a probability; a logistic classifier over votes and shape,
trained on these, decides. Spans of the four base kinds that meet their definition stay in any case.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The base definitions with possessive repeats, which match the same spans without backtracking, and
# with starts only where a run starts (or where the match before ended), which keeps long runs linear.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD_RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_PHONE = r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"""(?i)(?<![a-z])(?:api[_-]?key|access[_-]?(?:key|token)|token|secret|passwd|password)\x20?[=:]\x20?["']?[A-Za-z0-9+/_=-]{8,}+["']?"""
#: Gazetteers and cue words (fixed values).
DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "dev", "app", "co", "me", "ai", "eu", "de", "fr", "es", "it", "nl", "be", "lu", "at", "ch", "uk", "ie", "dk", "se", "no", "fi", "is", "pl", "cz", "sk", "hu", "ro", "bg", "gr", "pt",
    "ua", "ru", "tr", "il", "in", "cn", "jp", "kr", "tw", "hk", "sg", "my", "th", "vn", "id", "ph", "au", "nz", "za", "ng", "ke", "eg", "ma", "us", "ca", "mx", "br", "ar", "cl", "pe",
)
GIVEN_NAMES = (
    "James", "Mary", "Robert", "Patricia", "John", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Christopher", "Lisa", "Daniel", "Nancy", "Matthew", "Betty",
    "Anthony", "Margaret", "Mark", "Sandra", "Donald", "Ashley", "Steven", "Kimberly", "Paul", "Emily", "Andrew", "Donna", "Joshua", "Michelle", "Kenneth", "Carol", "Kevin", "Amanda", "Brian", "Dorothy", "George", "Melissa", "Edward", "Deborah",
    "Hans", "Klaus", "Stefan", "Wolfgang", "Andreas", "Peter", "Jens", "Uwe", "Sabine", "Monika", "Petra", "Ursula", "Heike", "Anna", "Katrin", "Julia", "Lukas", "Felix", "Leon", "Johanna",
    "Pierre", "Marie", "Jean", "Michel", "Philippe", "Alain", "Nicolas", "Laurent", "Isabelle", "Nathalie", "Sylvie", "Catherine", "Claire", "Camille", "Julien", "Antoine", "Sophie", "Louise", "Luc", "Chantal",
    "Maria", "Carlos", "Ana", "Antonio", "Manuel", "Francisco", "Javier", "Miguel", "Pablo", "Diego", "Carmen", "Isabel", "Pilar", "Lucia", "Elena", "Marta", "Sofia", "Alejandro", "Fernando", "Raquel",
)
#: Country codes, and area codes of numbers without one.
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "86", "90", "91", "351", "352", "353", "354", "358", "420", "421")
AREAS = ("202", "206", "210", "212", "213", "214", "215", "303", "305", "310", "312", "313", "314", "323", "404", "408", "410", "412", "415", "480", "503", "510", "512", "602", "612", "617", "619", "646", "702", "713", "718", "720", "773", "800", "801", "805", "813", "818", "858", "888", "904", "917", "919", "949", "972")
# The look-ahead leaves few places at which the names are tried.
PERSON = rf"(?<![A-Za-z])(?=[A-Z][a-z]{{1,12}}\x20[A-Z][a-z])(?:{'|'.join(GIVEN_NAMES)})\x20[A-Z][a-z]++(?![A-Za-z])"
#: A title with two capitalised words behind it, which are the name: names that no list has.
TITLE = r"(?<![A-Za-z])(?:M(?:rs?|s|adame|onsieur)|Dr|Herr|Frau|Se\xf1ora?)\.?\x20"
TITLED = rf"{TITLE}[A-Z]\p{{Ll}}++[\x20-][A-Z]\p{{Ll}}++(?!\p{{L}})"
CUES = {
    "email": "mail|contact|write|address", "ip": "host|server|address|client|ip", "card": "card|visa|master|amex|pay|credit", "phone": "tel|phone|call|fax|mobile|dial",
    "secret": "key|token|secret|login|credential", "id": "ssn|social|security|tax|insurance", "person": "mr|mrs|ms|dr|herr|frau|madame|monsieur|dear|name|contact|by",
}
#: Kinds in the order that breaks ties of starts; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "id", "person")
#: (kind, pattern, what a text must hold to be searched)
SEARCHES = (
    ("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD_RUN, None), ("phone", PHONE, "+"), ("phone", LOOSE_PHONE, "-"), ("secret", SECRET, None), ("id", NATIONAL_ID, "-"), ("person", PERSON, None), ("person", TITLED, None),
)
_CHUNK = 256
_NO_HITS = "array<struct<start:long,end:long,hit:string,before:string>>"


def _appended(items: Column, base: Column) -> Column:
    """Items (before, hit) -> structs with start and end, counted on from base."""
    empty = F.array().cast(_NO_HITS)

    def step(acc: Column, z: Column) -> Column:
        start = acc.at + F.length(z.p)
        end = start + F.length(z.h)
        one = F.struct(start.alias("start"), end.alias("end"), z.h.alias("hit"), F.right(z.p, F.lit(24)).alias("before"))
        return F.struct(end.cast("long").alias("at"), F.array_append(acc.out, one).alias("out"))

    return F.aggregate(items, F.struct(base.cast("long").alias("at"), empty.alias("out")), step, lambda acc: acc.out)


def located(df: DataFrame, text: str, pattern: str, needs: Column, name: str) -> DataFrame:
    """Add `name`: the leftmost non-overlapping matches with their spans in code points.

    Spark has no positions of matches: what lies between them (split) and they themselves alternate, so
    running lengths give them. The running sum goes in chunks, so many matches cost little more than a few.
    """
    lit = F.lit(pattern)
    df = df.withColumn("_h", F.when(needs, F.regexp_extract_all(text, lit, 0)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_p", F.when(F.size("_h") > 0, F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size("_h"))).otherwise(F.array().cast("array<string>")))
    pairs = F.transform("_p", lambda p, i: F.struct(p.alias("p"), F.get("_h", i).alias("h")))
    df = df.withColumn("_z", pairs)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_z") - 1) / _CHUNK).cast("int")), lambda c: F.slice("_z", c * _CHUNK + 1, F.lit(_CHUNK)))
    df = df.withColumn("_c", F.when(F.size("_z") > 0, chunks))
    lengths = F.transform("_c", lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, z: a + F.length(z.p) + F.length(z.h)))
    df = df.withColumn("_l", lengths)
    bases = F.aggregate("_l", F.array(F.lit(0).cast("long")), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    df = df.withColumn("_b", bases)
    spans = F.flatten(F.transform("_c", lambda c, i: _appended(c, F.get("_b", i))))
    return df.withColumn(name, F.coalesce(spans, F.array().cast(_NO_HITS))).drop("_h", "_p", "_z", "_c", "_l", "_b")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's check."""

    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _small_parts(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(hit, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255)


def _judged(kind: str, loose: bool) -> tuple:
    """(is base, regex vote, gazetteer vote) of a hit: votes are 1, 0 or -1 for no opinion."""
    yes, no, none = F.lit(1), F.lit(0), F.lit(-1)
    vote = lambda c: F.when(c, yes).otherwise(no)
    if kind == "email":
        return (lambda h: F.lit(True)), (lambda h: vote(F.length(h) <= 254)), lambda h: F.when(F.lower(F.substring_index(h, ".", -1)).isin(*DOMAINS), yes).otherwise(none)
    if kind == "ip":
        return _small_parts, (lambda h: vote(_small_parts(h) & ~h.rlike(r"(?:^|\.)0[0-9]"))), lambda h: F.when(h.rlike(r"^(?:10|127|192\.168|172\.16)\."), yes).otherwise(none)
    if kind == "card":
        good = lambda h: _luhn(_digits(h))
        return (lambda h: (F.length(_digits(h)) >= 14) & good(h)), (lambda h: vote(good(h))), lambda h: F.when(h.rlike(r"^(?:4|5[1-5]|3[47]|6011|65)"), yes).otherwise(no)
    if kind == "phone" and not loose:
        fits = lambda h: F.length(_digits(h)).between(10, 15)
        return fits, (lambda h: vote(fits(h))), lambda h: F.when(h.rlike(rf"^\+(?:{'|'.join(COUNTRIES)})[^0-9]"), yes).otherwise(none)
    if kind == "phone":
        return (lambda h: F.lit(False)), (lambda h: vote(h.rlike(r"^\(?[2-9]"))), lambda h: F.when(h.rlike(rf"^\(?(?:{'|'.join(AREAS)})"), yes).otherwise(none)
    if kind == "secret":
        digit = lambda h: h.rlike("[=:].*[0-9]")
        shape = lambda h: F.when(digit(h) & h.rlike("[=:].{16}"), yes).when(digit(h), none).otherwise(no)
        return (lambda h: F.lit(False)), shape, lambda h: F.when(h.rlike("[0-9a-f]{32}"), yes).otherwise(none)
    if kind == "id":
        return (lambda h: F.lit(False)), (lambda h: vote(~h.rlike("^(?:000|666|9)|-00-|-0000$"))), lambda h: none
    listed = lambda h: F.when(F.regexp_extract(h, r"^\p{L}+", 0).isin(*GIVEN_NAMES), yes).otherwise(none)
    return (lambda h: F.lit(False)), (lambda h: vote(F.length(h) <= 40)), listed


def _without_title(s: Column) -> Column:
    """The match without its title, which goes to what stands before it."""
    title = F.regexp_extract(s.hit, TITLE, 0)
    n = F.length(title)
    return F.struct((s.start + n).alias("start"), s.end.alias("end"), F.substr(s.hit, n + 1).alias("hit"), F.right(F.concat(s.before, title), F.lit(24)).alias("before"))


def _voted(kind: str, base, shape_vote, gazetteer):
    """Matches of a kind -> candidate spans with the labelers' votes."""

    def span(s: Column) -> Column:
        # a secret's own cue is part of its pattern, so none before it says nothing
        silent = F.lit(True) if kind == "secret" else F.length(s.before) < 8
        cue = F.when(s.before.rlike(rf"(?i)(?<![a-z])(?:{CUES[kind]})"), 1).when(silent, -1).otherwise(0)
        shape = F.least(F.floor(F.length(s.hit) / 8), F.lit(4)).cast("int") * 2 + F.contains(s.hit, F.lit(" ")).cast("int")
        return F.struct(
            s.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), s.end.alias("end"), base(s.hit).alias("base"),
            shape_vote(s.hit).alias("regex"), gazetteer(s.hit).alias("gazetteer"), cue.alias("context"), shape.alias("shape"),
        )

    return span


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, kind_no, end, base, regex, gazetteer, context, shape>>), sorted, a row per row."""
    df = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    names = []
    for k, (kind, pattern, sign) in enumerate(SEARCHES):
        loose = (kind, pattern) == ("phone", LOOSE_PHONE)
        needs = F.contains("t", F.lit(sign)) if sign else F.lit(True)
        df = located(df, "t", pattern, needs, f"s{k}")
        if pattern == TITLED:
            df = df.withColumn(f"s{k}", F.transform(f"s{k}", _without_title))
        df = df.withColumn(f"c{k}", F.transform(f"s{k}", _voted(kind, *_judged(kind, loose)))).drop(f"s{k}")
        names.append(f"c{k}")
    return df.select("doc_id", F.array_sort(F.concat(*names)).alias("spans"))


@dataclass(frozen=True)
class SpanModel:
    """reliability: labeler -> (P(vote | personal), P(vote | not)) by vote; weights: feature -> weight of the classifier."""

    reliability: dict[str, dict[int, tuple[float, float]]]
    weights: dict[tuple[str, int], float]
    bias: float

    def probability(self, span: Column) -> Column:
        total = F.lit(self.bias)
        for (name, value), w in sorted(self.weights.items()):
            total = total + F.when(span[name] == value, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


LABELERS = ("regex", "gazetteer", "context")


def learn(found: DataFrame, rounds: int = 40, steps: int = 300, rate: float = 0.5) -> SpanModel:
    """EM over vote patterns, then the classifier on its posteriors.

    The data are counts of patterns: 7 kinds x 27 votes x 10 shapes at most, however many spans there are.
    Labelers are taken as independent given the truth; each kind has a prior of its own. EM starts from
    labelers that are right four times of five, which fixes which of the two classes is personal data.
    """
    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    rows = [r.asDict() for r in spans.groupBy("kind_no", *LABELERS, "shape").agg(F.count("*").alias("n")).collect()]
    rows.sort(key=lambda r: tuple(r[k] for k in ("kind_no", *LABELERS, "shape")))
    prior = {r["kind_no"]: 0.7 for r in rows}
    told = {name: {1: (0.8, 0.2), 0: (0.2, 0.8), -1: (0.5, 0.5)} for name in LABELERS}
    for _ in range(rounds):
        for r in rows:
            yes, no = prior[r["kind_no"]], 1 - prior[r["kind_no"]]
            for name in LABELERS:
                p, q = told[name][r[name]]
                yes, no = yes * p, no * q
            r["p"] = yes / (yes + no)
        for k in prior:
            own = [r for r in rows if r["kind_no"] == k]
            prior[k] = min(0.98, max(0.02, (sum(r["n"] * r["p"] for r in own) + 1) / (sum(r["n"] for r in own) + 2)))
        for name in LABELERS:
            sums = {v: [1.0 + (v == 1), 1.0 + (v == 0)] for v in (1, 0, -1)}
            for r in rows:
                sums[r[name]][0] += r["n"] * r["p"]
                sums[r[name]][1] += r["n"] * (1 - r["p"])
            totals = [sum(s[c] for s in sums.values()) for c in (0, 1)]
            told[name] = {v: (s[0] / totals[0], s[1] / totals[1]) for v, s in sums.items()}
    features = [(n, v) for n in ("kind_no", *LABELERS, "shape") for v in sorted({r[n] for r in rows})]
    weights, bias, total = dict.fromkeys(features, 0.0), 0.0, sum(r["n"] for r in rows) or 1
    for _ in range(steps):
        slope, drift = dict.fromkeys(features, 0.0), 0.0
        for r in rows:
            own = [(n, r[n]) for n in ("kind_no", *LABELERS, "shape")]
            z = bias + sum(weights[f] for f in own)
            g = r["n"] / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - r["p"])
            drift += g
            for f in own:
                slope[f] += g
        bias -= rate * drift
        for f in features:
            weights[f] -= rate * (slope[f] + 1e-4 * weights[f])
    return SpanModel(told, weights, bias)


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of struct<start, kind_no, end>, by start, then kind; offsets are code points, ends exclusive.

    `base` are the spans that meet the definition of a base kind; `spans` are these and what the
    classifier adds, as far as it overlaps no base span. A row per row, ids may repeat or be null;
    null and empty texts have no spans. Texts are searched once: the candidates are a table in the
    shared folder, and learning and deciding read only that. No shuffle but of pattern counts.
    """
    found = materialize(candidates(docs, id_col, text_col), "spans")
    model = learn(found)
    slim = lambda s: F.struct(s.start.alias("start"), s.kind_no.alias("kind_no"), s.end.alias("end"))
    parted = found.withColumn("base", F.filter("spans", lambda s: s.base)).withColumn("more", F.filter("spans", lambda s: ~s.base & (model.probability(s) >= threshold)))
    free = F.when(F.size("more") > 0, F.filter("more", lambda s: ~F.exists("base", lambda b: (b.start < s.end) & (s.start < b.end)))).otherwise(F.col("more"))
    parted = parted.withColumn("free", free)
    return parted.select("doc_id", F.transform("base", slim).alias("base"), F.array_distinct(F.array_sort(F.concat(F.transform("base", slim), F.transform("free", slim)))).alias("spans"))


def as_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind_no), s.start.cast("string"), s.end.cast("string"))), ",")
