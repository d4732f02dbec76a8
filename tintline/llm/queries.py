"""The operators' queries over the given tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.state import let
from .common import table, words
from .decontaminate import decontaminate
from .fill_middle import fill_middle, restored
from .html_text import extract_text
from .jaccard_join import jaccard_join
from .line_dedup import line_dedup
from .lm_score import lm_score
from .periodic_runs import periodic_runs, strongest
from .quality_rules import quality_rules
from .source_mix import mix_rows
from .suffix_dedup import suffix_dedup
from .token_output import read_digest, token_folder, write_tokens
from .topk_search import topk_search
from .url_filters import url_filters

URL_RULES = """SELECT * FROM VALUES
    ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS r(host, path, verdict)"""
MAX_EPOCHS = 2.0


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages"), spark.sql(URL_RULES))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix_rows(docs, max_epochs=MAX_EPOCHS)
    return mixed.select(
        "row.doc_id", "row.source", F.size(words(F.col("row.text"))).cast("long").alias("n_tokens"),
        F.round("weight", 9).alias("weight"), "epoch", "block", "perm_key",
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, x: n + x["past"] - x["first"])
    return found.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score(table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("log10_score", "log10_per_word")})


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_folder(spark)
    write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digest(spark, out)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts, by the id's checksum, the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    narrow = docs.select("doc_id", "text", (h % 10 == 0).alias("planted"), F.floor(h / 10).alias("g"))

    def planted(x: Column) -> Column:
        """x has words and g."""
        n = F.size(x["words"])
        a = x["g"] % n
        p = 1 + F.floor((n - a) / (3 + x["g"] % 8))
        taken = lambda y: F.transform(y["words"], lambda w, i: F.when(i < y["a"], w).otherwise(F.get(y["words"], (y["a"] + (i - y["a"]) % y["p"]).cast("int"))))
        return let(F.struct(x["words"].alias("words"), a.alias("a"), p.alias("p")), lambda y: F.array_join(taken(y), " "))

    bag = F.struct(words(F.col("text")).alias("words"), F.col("g"))
    text = F.when(F.col("planted") & F.col("text").rlike(r"[^\x20\x09-\x0D]"), let(bag, planted)).otherwise(F.col("text"))
    return narrow.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_repeats(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join,
        op2_url_filters,
        op3_line_dedup,
        op4_html_text,
        op5_quality_rules,
        op6_source_mix,
        op7_suffix_dedup,
        op8_decontaminate,
        op9_lm_score,
        op10_token_output,
        op11_periodic_runs,
        op12_topk_search,
        op13_fill_middle,
    )
}

_LINE_KEY = "translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BARE = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# the checksum of a text of ASCII, bit by bit
_CRC_STEP = "CASE WHEN k % 8 = 0 THEN xor(c, ascii(s[k // 8 + 1])::BIGINT) ELSE c END"
_CRC32 = f"xor(list_reduce(range(0, 8 * length(s)), lambda c, k: xor(({_CRC_STEP}) >> 1, 3988292384 * (({_CRC_STEP}) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"

ORACLE_SQL = {
    "op1_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.v), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.u = d.doc_id GROUP BY d.doc_id""",
    "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_BARE} AS w FROM documents), b AS (SELECT item_id, {_BARE} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + 9], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
g AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, g.size, i, item_id FROM g JOIN win USING (size, s)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op2_url_filters": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT *, host || '.' AS h, ('.' || host) AS d FROM hp)
SELECT page_id, host, path,
    CASE WHEN (d LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (d LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (d LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (d LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE WHEN (d LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'allow'
         WHEN (d LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'block'
         WHEN (d LIKE '%.org') AND starts_with(path, '/fr/') THEN 'allow'
         WHEN (d LIKE '%.net') AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
FROM m""",
    "op3_line_dedup": f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
keyed AS (SELECT doc_id, n, x, {_LINE_KEY} AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, (keeper IS NOT NULL AND doc_id < keeper) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) >= 2),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(c.n, 0) AS n_repeat_words, text, w FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR n_symbols > 0.3 * n_words OR (len(ls) >= 4 AND len(list_distinct(ls)) < 0.4 * len(ls))
    OR len(regexp_extract_all(text, '\p{{L}}')) < 0.5 * word_chars
    OR (len(regexp_extract_all(text, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}]')) < 0.3 * word_chars
        AND (NOT word_chars BETWEEN 2 * n_words AND 20 * n_words OR list_max(list_transform(w, lambda x: length(x))) > 1000))) AS kept
FROM f""",
    "op7_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, i, md5(t[i + 1:i + 200]) AS k FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 199)) AS i FROM d WHERE octet_length(t) >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
s AS (SELECT doc_id, min(i) AS b, max(i) + 200 AS e FROM g GROUP BY doc_id, run),
x AS (SELECT doc_id, b, e FROM s UNION ALL SELECT doc_id, octet_length(t), NULL FROM d),
p AS (SELECT doc_id, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b, e NULLS LAST), 0) AS a FROM x),
k AS (SELECT doc_id, string_agg(hex(t[a + 1:b]), '' ORDER BY b, a) AS h FROM p JOIN d USING (doc_id) WHERE b > a GROUP BY doc_id),
c AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op9_lm_score": rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS a, w[i - 1] AS z, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS y,
    CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n1 AS (SELECT a AS g, count(*) AS n FROM p GROUP BY a), n2 AS (SELECT b AS g, count(*) AS n FROM p GROUP BY b), n3 AS (SELECT c AS g, count(*) AS n FROM p GROUP BY c),
s AS (SELECT doc_id, CASE WHEN i > 2 AND n3.n >= 2 THEN log10(n3.n / y2.n)
    WHEN i > 1 AND n2.n >= 2 THEN log10(n2.n / z1.n) + CASE WHEN i > 2 THEN log10(0.4) ELSE 0 END
    ELSE log10(n1.n / (SELECT count(*) FROM p)) + least(i - 1, 2) * log10(0.4) END AS x
    FROM p JOIN n1 ON n1.g = p.a LEFT JOIN n1 z1 ON i > 1 AND z1.g = p.z LEFT JOIN n2 ON n2.g = p.b LEFT JOIN n2 y2 ON y2.g = p.y LEFT JOIN n3 ON n3.g = p.c)
SELECT d.doc_id, len(w)::BIGINT AS n_words, round(sum(x), 6) AS log10_score, round(sum(x) / len(any_value(w)), 6) AS log10_per_word
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id, len(w)""",
    "op6_source_mix": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS t FROM documents),
s AS (SELECT source, count(*) AS n, sum(t)::BIGINT AS tokens FROM d GROUP BY source),
p AS (SELECT *, tokens / (SELECT sum(tokens) FROM s)::DOUBLE AS p FROM s),
a AS (SELECT min(k) / 1048576.0::DOUBLE AS a FROM (SELECT k FROM generate_series(0, 1048576) g(k), p WHERE tokens > 0
    GROUP BY k HAVING max(pow(p, k / 1048576.0::DOUBLE - 1)) / min(pow(p, k / 1048576.0::DOUBLE - 1)) <= {MAX_EPOCHS})),
w AS (SELECT source, n, tokens, ceil(n / 1024.0)::BIGINT AS blocks,
    CASE WHEN tokens > 0 THEN pow(p, a) / (SELECT sum(pow(p, a)) FROM p, a WHERE tokens > 0) ELSE 0 END AS weight,
    CASE WHEN tokens > 0 THEN round(pow(p, a - 1) / (SELECT min(pow(p, a - 1)) FROM p, a WHERE tokens > 0), 9) ELSE 1 END AS epochs FROM p, a),
e AS (SELECT *, floor(epochs)::BIGINT AS f, floor((epochs - floor(epochs)) * tokens) AS rest FROM w),
x AS (SELECT doc_id, d.source, t, weight, f, rest, blocks, unnest(range(0, f + 1)) AS epoch FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
k AS (SELECT *, md5('0:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')) AS perm_key FROM x),
c AS (SELECT *, sum(t) OVER (PARTITION BY source, epoch ORDER BY perm_key RANGE UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, source, t AS n_tokens, round(weight, 9) AS weight, epoch,
    floor(('0x' || substring(perm_key, 1, 8))::BIGINT * blocks / 4294967296.0::DOUBLE)::BIGINT AS block, perm_key
FROM c WHERE epoch < f OR (rest > 0 AND upto <= rest)""",
    "op11_periodic_runs": rf"""
WITH t AS (SELECT doc_id, doc_id::VARCHAR AS s, {_WORDS} AS w FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, {_CRC32} AS h FROM t),
a AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
i AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda x: CASE WHEN x < a THEN w[x + 1]
    ELSE w[a + (x - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM a),
c AS (SELECT doc_id, p FROM (SELECT doc_id, n, w, unnest(range(1, n // 4 + 1)) AS p FROM i WHERE n >= 6)
    WHERE len(list_filter(range(0, (n - 1) // p - 2), lambda j: w[j * p + 1] = w[(j + 1) * p + 1] AND w[j * p + 1] = w[(j + 2) * p + 1] AND w[j * p + 1] = w[(j + 3) * p + 1])) > 0),
e AS (SELECT doc_id, p, unnest(list_filter(range(0, n - p), lambda x: w[x + 1] = w[x + p + 1])) AS x FROM c JOIN i USING (doc_id)),
s AS (SELECT doc_id, p, min(x) AS s, max(x) + p + 1 AS e FROM (SELECT *, x - row_number() OVER (PARTITION BY doc_id, p ORDER BY x) AS run FROM e) GROUP BY doc_id, p, run),
r AS (SELECT doc_id, s, e, min(p) AS p FROM s WHERE e - s >= greatest(6, 4 * p) GROUP BY doc_id, s, e),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (e - s)::DOUBLE / p DESC, s, p) = 1),
l AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || (e - s) || ',' || p || chr(10), '' ORDER BY s, p)) AS runs_sha256 FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(s + p, e)) AS x FROM r),
k AS (SELECT doc_id, string_agg(w[x + 1], ' ' ORDER BY x) AS kept FROM (SELECT doc_id, w, unnest(range(0, n)) AS x FROM i SEMI JOIN r USING (doc_id)) ANTI JOIN g USING (doc_id, x) GROUP BY doc_id)
SELECT i.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.e - b.s AS length, b.p AS period, 1000 * (b.e - b.s) // b.p AS exponent_milli,
    coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(CASE WHEN b.s IS NULL THEN array_to_string(w, ' ') ELSE kept END, '')) AS collapsed_sha256
FROM i LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op12_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op13_fill_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || doc_id) AS h FROM documents),
n AS (SELECT *, len(w) AS n, list_transform(range(0, 4), lambda k: ('0x' || substring(h, 8 * k + 1, 8))::BIGINT) AS u FROM t),
c AS (SELECT *, least(u[1] % (n + 1), u[2] % (n + 1)) AS a, greatest(u[1] % (n + 1), u[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR u[3] % 100 >= 50 THEN 'plain' WHEN u[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM p""",
}
