"""The thin queries of the operators over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm import decontam, exact, jaccard, langid, licenses, lines, packing, phrases, quality, runs, suffix, toxicity, warc
from reelgrid.session import prepare, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/reelgrid/warc-{uuid.uuid4().hex}"
    warc.write_warc(pages, folder, min_revisit_bytes=0)
    kind = pages.schema["page_id"].dataType
    return warc.read_warc(spark, folder).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), tokens=2048)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of source/lang/shelf/; a short document that speaks of a licence is its shelf's licence file."""
    docs = table(spark, sf_dir, "documents")
    shelf = F.concat_ws("/", F.col("source"), F.col("lang"), F.pmod(F.col("doc_id"), F.lit(50)).cast("string"))
    licence = (F.length("text") < 400) & F.lower("text").contains("licen")
    name = F.when(licence, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return licenses.scan(docs.select("doc_id", F.concat_ws("/", shelf, name).alias("path"), "text"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("failed_rule")  # which rule is met first depends on the measured order


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which a tenth repeat a stretch of themselves from a word on; both follow from crc32 of the id."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("words")
    a = g % F.nullif(n, F.lit(0))  # no word, nothing planted
    p = 1 + F.floor((n - a) / (3 + g % 8))
    planted = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words")).select("doc_id", "text", "words", a.cast("int").alias("a"), p.cast("int").alias("p"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), 1, n - F.col("a"))
    repeated = F.array_join(F.concat(F.slice("words", 1, F.col("a")), tail), " ")
    found = runs.periodic_runs(planted.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("doc_id", "n_runs", "best.*", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_ngram_jaccard, op4_decontamination, op5_toxicity, op6_warc, op7_packing, op8_license_scan, op9_exact_dedup, op10_line_dedup, op11_quality_rules, op12_periodic_runs, op13_phrases)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BASE32 = "list_aggregate(list_transform(generate_series(0, 31), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0x' || h[i // 4 * 5 + 1 : i // 4 * 5 + 5])::BIGINT >> (15 - i % 4 * 5)) % 32 + 1]), 'string_agg', '')"

ORACLE_SQL = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS t FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
h AS (SELECT doc_id, s, k, item_id::VARCHAR AS item FROM x JOIN i USING (k, t)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op6_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages), q AS (SELECT *, upper(sha1(payload)) AS h FROM p)
SELECT page_id, strlen(payload) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q""",
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
    "op10_line_dedup": f"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, regexp_extract_all(x[i], '[^\\x20\\x09-\\x0D]+') AS w FROM (SELECT doc_id, x, unnest(generate_series(1, len(x))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
p AS (SELECT doc_id, line_no, len(w) AS n, array_to_string(w, ' ') AS t, w FROM l WHERE len(w) > 0),
c AS (SELECT t, any_value(w) AS w, any_value(n) AS n, min((doc_id, line_no)) AS own FROM p GROUP BY t),
v AS (SELECT t, n, own, s, array_to_string(list_concat(w[: s - 1], w[s + 1 :]), ' ') AS d FROM (SELECT *, unnest(generate_series(1, n)) AS s FROM c WHERE n >= {lines.MIN_WORDS})),
r AS (SELECT n, s, d, min(own) AS low FROM v GROUP BY n, s, d), e AS (SELECT d, min(own) AS low FROM v GROUP BY d),
f AS (SELECT v.t, r.low FROM v JOIN r USING (n, s, d) UNION ALL SELECT v.t, c.own FROM v JOIN c ON c.t = v.d UNION ALL SELECT c.t, e.low FROM c JOIN e ON c.t = e.d UNION ALL SELECT t, own FROM c),
m AS (SELECT t, min(low) AS first FROM f GROUP BY t)
SELECT p.doc_id, p.line_no, p.n AS n_words, m.first = (p.doc_id, p.line_no) AS kept, m.first[1] AS first_id, m.first[2] AS first_line, CASE WHEN m.first < c.own THEN 1 ELSE 0 END AS edits FROM p JOIN c USING (t) JOIN m USING (t)""",
    "op11_quality_rules": r"""
WITH d AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
s AS (SELECT doc_id, s, w[s : s + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS s FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM s) WHERE c > 1) GROUP BY doc_id),
o AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id, x) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS lettered,
 len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses, coalesce(top, 0) AS top FROM d LEFT JOIN r USING (doc_id) LEFT JOIN o USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 100 * lettered < 80 * n_words
 OR 100 * n_dup_lines > 50 * n_lines OR 100 * bullets > 90 * n_lines OR 100 * ellipses > 30 * n_lines OR 100 * top > 30 * n_words) AS kept FROM b""",
    "op12_periodic_runs": r"""
WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
 xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
 lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)))) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM c),
q AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM g), k AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS p FROM q),
o AS (SELECT doc_id, n, i, CASE WHEN planted AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM k WHERE n > 0)),
e AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.x = y.x AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS z FROM e) GROUP BY doc_id, p, z HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
b AS (SELECT * FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period OR (y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period))))),
f AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = o.doc_id AND o.i >= r.start + r.period AND o.i < r.start + r.length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM c LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "op13_phrases": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM w, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang), c AS (SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= 100),
x AS (SELECT *, array_to_string(string_split(phrase, ' ')[: j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1 :], ' ') AS rest FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c)),
s AS (SELECT x.lang, x.k, x.phrase, x.a, h.f AS l, r.f AS r, t.n, ((1000::HUGEINT * x.a * t.n) // (h.f::HUGEINT * r.f))::BIGINT AS score, j FROM x JOIN t USING (lang) JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = m.lang AND c.k > m.k AND 100 * c.a >= 100 * m.a AND contains(' ' || c.phrase || ' ', ' ' || m.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000""",
}
