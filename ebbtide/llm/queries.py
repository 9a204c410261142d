"""The operators applied to whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ebbtide.llm import bpe, html, quality, stages, turns, urls, warc
from ebbtide.llm.decontaminate import decontaminate
from ebbtide.llm.licenses import scan_licenses
from ebbtide.llm.lines import dedup_lines
from ebbtide.llm.near import near_duplicates
from ebbtide.llm.negatives import hard_negatives
from ebbtide.llm.privacy import pseudonymise
from ebbtide.llm.substrings import remove_repeats
from ebbtide.llm.common import table

QUERIES, ORACLES = {}, {}
PII_SECRET = "change me"
"""The key of the pseudonyms; a real run passes its own to ``pseudonymise``."""


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@query("op8_byte_bpe")
def op8_byte_bpe(spark, path):
    ranks = public_tokenizers.path(stages.BPE_RANKS)
    return bpe.round_trip(table(spark, path, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


_HOST = r"translate(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spread_sql(name: str, seed: str, share: str) -> str:
    """Rounds of propagation, each a common table of its own."""
    parts = [f"{name}_seed AS (SELECT host, 1.0::DOUBLE AS score FROM hosts WHERE {seed})", f"{name}_0 AS (SELECT * FROM {name}_seed)"]
    for i in range(1, 9):
        parts.append(f"""{name}_{i} AS (SELECT host, sum(score) AS score FROM (
            SELECT s.dst AS host, p.score * s.share * 0.85 AS score FROM {name}_{i - 1} p JOIN {share} s ON s.src = p.host
            UNION ALL SELECT host, score * (1 - 0.85) FROM {name}_seed) GROUP BY host)""")
    return ",\n".join(parts)


OP9_SQL = rf"""
WITH rules(rule, host, path, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
split AS (SELECT page_id, coalesce({_HOST.format(u="url")}, '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1), '') AS path, html FROM pages),
fit AS (SELECT s.page_id, s.host, s.path,
  (SELECT {{'rule': r.rule, 'verdict': r.verdict}} FROM rules r WHERE (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
   ORDER BY length(r.rule) DESC LIMIT 1) AS fit FROM split s),
hosts AS (SELECT host, count(*) FILTER (fit.verdict = 'allow') * 2 > count(*) AS trusted, count(*) FILTER (fit.verdict = 'block') * 2 > count(*) AS banned
  FROM fit WHERE host <> '' GROUP BY host),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*((?:https?:)?//[^\s"''<>]+)', 1)) AS link FROM split),
linked AS (SELECT src, {_HOST.format(u="CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM found),
links AS (SELECT src, dst, count(*) AS n FROM linked WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
ahead AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links),
back AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM links),
{_spread_sql("trust", "trusted", "ahead")},
{_spread_sql("distrust", "banned", "back")},
scored AS (SELECT coalesce(t.host, d.host) AS host, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust
  FROM trust_8 t FULL JOIN distrust_8 d ON d.host = t.host)
SELECT f.page_id, f.host, f.path, f.fit.rule AS rule,
  coalesce(f.fit.verdict, CASE WHEN s.distrust > greatest(s.trust, 0.5 * (SELECT sum(distrust) / count(*) FROM scored)) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit f LEFT JOIN scored s ON s.host = f.host"""


@query("op9_url_filter", OP9_SQL)
def op9_url_filter(spark, path):
    return urls.judge(table(spark, path, "pages")).select("page_id", "host", "path", "rule", "verdict")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, hash(doc_id, text) AS p, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, len(w[s:s + 9]) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
du AS (SELECT DISTINCT doc_id, p, w FROM d),
dw AS (SELECT doc_id, p, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, p, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM du, sizes)),
hit AS (SELECT DISTINCT dw.doc_id, dw.p, dw.s, dw.n, item_id FROM dw JOIN iw ON iw.win = dw.win AND iw.n = dw.n),
covered AS (SELECT doc_id, p, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, p, unnest(range(s, s + n)) AS spot FROM hit) GROUP BY 1, 2),
ids AS (SELECT doc_id, p, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit WHERE item_id IS NOT NULL GROUP BY 1, 2)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.p = d.p LEFT JOIN ids ON ids.doc_id IS NOT DISTINCT FROM d.doc_id AND ids.p = d.p"""


@query("op2_decontaminate", OP2_SQL)
def op2_decontaminate(spark, path):
    return decontaminate(table(spark, path, "documents"), table(spark, path, "benchmark")).drop("item_ids", "_print")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p),
r AS (SELECT *, n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM r"""


@query("op4_warc", OP4_SQL)
def op4_warc(spark, path):
    archives = warc.write(table(spark, path, "pages"), warc.archive_folder(spark))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_quality_rules")
def op6_quality_rules(spark, path):
    found = quality.assess(table(spark, path, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, s, sha256(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
again AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT r, list(DISTINCT i) AS spots FROM (SELECT r, unnest(range(s, s + 35)) AS i FROM again) GROUP BY r),
word AS (SELECT r, w, generate_subscripts(w, 1) AS i FROM d),
hit AS (SELECT DISTINCT r, unnest(spots) AS i FROM gone),
kept AS (SELECT word.r, string_agg(w[word.i], ' ' ORDER BY word.i) AS t FROM word LEFT JOIN hit ON hit.r = word.r AND hit.i = word.i WHERE hit.i IS NULL GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.r = d.r LEFT JOIN kept ON kept.r = d.r"""


@query("op3_substring_dedup", OP3_SQL)
def op3_substring_dedup(spark, path):
    out = remove_repeats(table(spark, path, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON b.x = a.x AND a.doc_id < b.doc_id
  GROUP BY 1, 2, 3, 4 HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM common UNION ALL SELECT b, a FROM common),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.a = s.doc_id"""


@query("op5_near_duplicates", OP5_SQL)
def op5_near_duplicates(spark, path):
    return near_duplicates(table(spark, path, "documents"), shingle=3, similar=85).drop("_print", "_group")


@query("op7_line_dedup")
def op7_line_dedup(spark, path):
    return dedup_lines(table(spark, path, "documents").select("doc_id", "text"))


@query("op10_pii")
def op10_pii(spark, path):
    return pseudonymise(table(spark, path, "documents"), PII_SECRET).select("doc_id", "text", "n_found")


@query("op1_html_text")
def op1_html_text(spark, path):
    return html.extract(table(spark, path, "pages").select("page_id", "url", "html"))


def damage(conversations):
    """What op11 repairs: rows dropped, emptied, without their sentence ends, repeated or given to the user, by a checksum of their place."""
    case = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), case.alias("_case")).where("_case <> 0")
    text = F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.explode(F.when(F.col("_case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("_copy"))


def _step(v: str, cost: str, edit: str) -> str:
    """A state's nine digits of cost and its audit, one edit on."""
    return f"(format('{{:09d}}', CAST({v}[1:9] AS INT) + {cost}) || {v}[10:] || '{edit}')"


def _inserted(v: list[str]) -> tuple[str, str]:
    """States 2 and 3 after insertions."""
    two = f"least({v[2]}, " + ", ".join(_step(v[i], "2", "I") for i in (0, 1, 3)) + ")"
    return two, f"least({v[3]}, {_step(two, '2', 'I')})"


OP11_SQL = rf"""
WITH RECURSIVE bits AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
cased AS (SELECT conv_id, turn, role, text, xor(list_reduce([CAST(ascii(x) AS BIGINT) FOR x IN string_split(k, '')],
  lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INT) + 1]), 4294967295), 4294967295) % 20 AS c FROM keyed, bits),
hurt AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN c = 1 THEN '' WHEN c = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN c = 3 THEN [1, 2] ELSE [1] END) AS copy FROM cased WHERE c <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS before FROM hurt),
kinds AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank,
  regexp_matches(text, '[^ 	-
]') AND seen > 1 AS again,
  regexp_matches(text, '[^ 	-
]') AND seen = 1 AND NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS open FROM placed),
r AS (SELECT *, CASE WHEN open THEN 1 ELSE 0 END AS more, blank OR again AS gone, role[1:1] AS k FROM kinds),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, '000000002I' AS v2, '000000004II' AS v3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, v0, v1, {_inserted(["v0", "v1", "v2", "v3"])[0]}, {_inserted(["v0", "v1", "v2", "v3"])[1]}
  FROM (SELECT w.conv_id, r.i, {_step("v0", "3", "D")} AS v0,
    least({_step("v1", "3", "D")}, CASE WHEN NOT gone AND k = 's' THEN {_step("v0", "more", "K")} END) AS v1,
    least({_step("v2", "3", "D")}, CASE WHEN NOT gone THEN least({", ".join(_step(v, "more + 2", "R") for v in ("v0", "v1", "v3"))}) END,
      CASE WHEN NOT gone AND k = 'u' THEN least({", ".join(_step(v, "more", "K") for v in ("v0", "v1", "v3"))}) END) AS v2,
    least({_step("v3", "3", "D")}, CASE WHEN NOT gone THEN {_step("v2", "more + 2", "R")} END,
      CASE WHEN NOT gone AND k = 'a' THEN {_step("v2", "more", "K")} END) AS v3
    FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)),
best AS (SELECT conv_id, arg_max(least(v0, v3), i) AS v FROM (SELECT coalesce(conv_id, -1) AS g, * FROM walk) GROUP BY conv_id),
edits AS (SELECT conv_id, v, k, v[9 + k:9 + k] AS e FROM (SELECT conv_id, v, unnest(range(1, len(v) - 8)) AS k FROM best)),
places AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS m FROM edits),
filled AS (SELECT p.*, r.role, r.text, coalesce(bool_or(p.e = 'K' AND p.m = 1 AND r.k = 's') OVER (PARTITION BY p.conv_id), false) AS headed
  FROM places p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i AND p.e <> 'I' WHERE p.e <> 'D'),
done AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (m - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END,
  chr(10) ORDER BY k)) AS h FROM filled GROUP BY conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
  count(*) FILTER (open) AS truncated, count(*) FILTER (before IS NOT NULL AND before[1:1] || k NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(b.v[1:9] AS BIGINT) AS cost, b.v[10:] AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM best b LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM b.conv_id"""


@query("op11_conversation_repair", OP11_SQL)
def op11_conversation_repair(spark, path):
    told = table(spark, path, "conversations")
    return turns.repair(damage(told), told)


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same,
  CAST(list_sum(list_transform(range(1, 1 + least(len(a.x), len(v.x))), lambda i: a.x[i] * v.x[i])) AS BIGINT) AS score FROM a JOIN v ON a.r <> v.r),
p AS (SELECT r, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, other) AS place
  FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.other AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.other) AS rank FROM p JOIN s ON s.r = p.r AND NOT s.same
  WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score QUALIFY rank <= 10)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark, path):
    rows = table(spark, path, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


@query("op13_license_scan")
def op13_license_scan(spark, path):
    return scan_licenses(table(spark, path, "documents")).drop("spans")
