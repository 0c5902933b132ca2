"""The queries opN_<name>: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format as _chat
from . import conversation_repair as _repair
from . import decontamination as _leaks
from . import exact_dedup as _exact
from . import fill_middle as _middle
from . import license_scan as _license
from . import mixing as _mixing
from . import pii as _pii
from . import quality as _quality
from . import simhash as _simhash
from . import substring_dedup as _substring
from . import token_counts as _tokens
from . import url_filter as _urls
from .common import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.token_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokens.load_pieces())


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = F.array(*(F.struct(F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role")) for turn, role in enumerate(("user", "assistant"))))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(rows).alias("r")).select("conv_id", "r.*", F.lit(said).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    written = _chat.render(_chat.reconstruct(_chat.turns_as_events(turns)))
    back = written.select("conv_id", "formatted", "loss_mask", _chat.parse(F.col("formatted")).alias("turns"), _chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns),
losses AS (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss FROM filled GROUP BY conv_id)
SELECT f.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(any_value(loss)) AS loss_chars, sha256(any_value(loss)) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ' || replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM filled f JOIN losses l ON f.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY f.conv_id
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text")).rows()


OP3_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(k: int) -> Column:
        """Spans of a kind: the base ones of base kinds, all that the method found of the others."""
        return F.size(F.filter("base" if k < 4 else "spans", lambda s: s.kind_no == k)).cast("long").alias(f"n_{_pii.KINDS[k]}")

    return found.select("doc_id", *map(count, range(len(_pii.KINDS))), F.size("spans").cast("long").alias("n_spans"), F.sha2(_pii.as_text("base").cast("binary"), 256).alias("base_sha256"), _pii.as_text("spans").alias("spans"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license.summary(_license.license_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return _leaks.contaminated(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM benchmark),
dw AS (SELECT doc_id, unnest(range(len(words))) AS place, unnest(words) AS word FROM d),
iw AS (SELECT item_id, len(words) AS n, unnest(range(len(words))) AS place, unnest(words) AS word FROM i),
shifts AS (SELECT doc_id, item_id, dw.place - iw.place AS shift FROM dw JOIN iw USING (word) GROUP BY ALL HAVING count(*) >= least(11, any_value(n))),
laid AS (SELECT doc_id, item_id, len(i.words) AS n, least(13, len(i.words)) AS span, CASE WHEN len(i.words) < 13 THEN len(i.words) ELSE 11 END AS needed, greatest(0, shift) AS first,
  list_transform(range(greatest(0, shift), least(len(d.words), shift + len(i.words))), lambda k: CASE WHEN d.words[k + 1] = i.words[k - shift + 1] THEN 1 ELSE 0 END) AS same
  FROM shifts JOIN d USING (doc_id) JOIN i USING (item_id)),
good AS (SELECT doc_id, item_id, n, unnest(list_transform(list_filter(range(1, len(same) - span + 2), lambda s: list_sum(same[s:s + span - 1]) >= needed), lambda s: first + s - 1)) AS word FROM laid WHERE len(same) >= span)
SELECT doc_id, count(DISTINCT word) AS stretches, CAST(min(word) AS BIGINT) AS first_word, CAST(max(word) AS BIGINT) AS last_word, min(item_id) AS item_id, CAST(max(n) AS BIGINT) AS item_words FROM good GROUP BY doc_id
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _simhash.simhash_components(docs, 3, _simhash.exact_layout(2))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = _quality.score(docs, _quality.train(docs, labels))
    return scored.select("doc_id", _quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _substring.substring_dedup(docs, 20).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM split WHERE len(words) >= 20),
windows AS (SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS words FROM starts),
again AS (SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM again),
placed AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM split),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.place) AS kept, count(*) AS n FROM placed p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.place = p.place GROUP BY 1)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, CAST(len(s.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""

#: Host, path and verdict of the rules that op11 applies (fixed values).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OP11_SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
urls AS (SELECT DISTINCT host, path FROM split),
best AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, s.host, s.path, rule, coalesce(verdict, 'allow') AS verdict FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path
"""


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _middle.fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP12_SQL = r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
planned AS (SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
       WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
cut AS (SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1:n], '') AS suffix FROM planned)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations (conv_id, turn, role, text; nulls of the last two are one space) with the faults that op13 repairs; `lost` rows are dropped ones."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(named.cast("binary")) % 20).cast("int").alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("harm") == 0).alias("lost"), "harm")
    return rows.withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("harm", "copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repair.digests(_repair.repair(damaged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), lost_col="lost"))


def _op13_sql() -> str:
    """The cheapest edits by recursion over a conversation's rows: for each state (0 nothing, 1 after a system turn, 2 a user's, 3 an assistant's) the least (cost, audit)."""
    best = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"
    step = lambda c, more, letter, ok="true": f"CASE WHEN {c} IS NOT NULL AND {ok} THEN {{'cost': {c}.cost + {more}, 'audit': {c}.audit || '{letter}', 'told': {c}.told || {told[letter]}}} END"
    told = {"D": "[]::VARCHAR[]", "K": "[r.role || ':' || r.text]"}
    cut, stays = "CASE WHEN r.fault = 2 THEN 3 ELSE 0 END", "coalesce(r.fault, 9) >= 2"
    moved = []
    for state, sources, initial, spoken in ((0, (), "", ""), (1, (0,), "s", ""), (2, (0, 1, 3), "u", "user"), (3, (2,), "a", "assistant")):
        ways = [step(f"d.s{state}", 4, "D")]
        told["R"] = f"['{spoken}:' || r.text]"
        for source in sources:
            ways.append(step(f"d.s{source}", cut, "K", f"{stays} AND r.role[1:1] = '{initial}'"))
            if spoken:
                ways.append(step(f"d.s{source}", f"3 + {cut}", "R", stays))
        moved.append(f"{best(*ways)} AS s{state}")
    told |= {"I": "['user:']"}
    first = f"s0, s1, {best('s2', step('s0', 3, 'I'), step('s1', 3, 'I'), step('s3', 3, 'I'))} AS s2, s3"
    told |= {"I": "['assistant:']"}
    second = f"s0, s1, s2, {best('s3', step('s2', 3, 'I'))} AS s3"
    told |= {"I": "['user:']"}
    third = f"s0, s1, {best('s2', step('s3', 3, 'I'))} AS s2, s3"
    opened = lambda source: f"SELECT conv_id, place, {third} FROM (SELECT conv_id, place, {second} FROM (SELECT conv_id, place, {first} FROM ({source})))"
    start = "{'cost': 0, 'audit': '', 'told': []::VARCHAR[]}"
    none = "CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR, told VARCHAR[]))"
    return f"""
WITH RECURSIVE filled AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(name, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k::INTEGER)::BIGINT & 1)))),
  lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1)))) % 20 AS harm FROM filled),
harmed AS (SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE harm WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed),
numbered AS (SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS said, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS INTEGER) AS place,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM harmed),
marked AS (SELECT *, CASE WHEN said = '' THEN 0 WHEN again > 1 THEN 1 WHEN NOT regexp_matches(said[-1:], '[.!?]') THEN 2 END AS fault, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY place) AS prior FROM numbered),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 0) AS blank, count(*) FILTER (fault = 1) AS duplicate, count(*) FILTER (fault = 2) AS truncated,
  count(*) FILTER (prior || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY conv_id),
done AS (
  {opened(f"SELECT conv_id, 0 AS place, {start} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM counted")}
  UNION ALL
  {opened(f"SELECT r.conv_id, r.place, {', '.join(moved)} FROM done d JOIN marked r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.place = d.place + 1")}
), ended AS (SELECT d.conv_id, {best("s0", "s3")} AS best FROM done d JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.place)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.told, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP13_SQL = _op13_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_chat_format, op3_exact_dedup, op4_pii, op5_license_scan, op6_decontamination, op7_simhash, op8_mixing, op9_quality, op10_substring_dedup, op11_url_filter, op12_fill_middle, op13_conversation_repair)
}
ORACLES: dict[str, str] = {"op2_chat_format": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op6_decontamination": OP6_SQL, "op10_substring_dedup": OP10_SQL, "op11_url_filter": OP11_SQL, "op12_fill_middle": OP12_SQL, "op13_conversation_repair": OP13_SQL}
