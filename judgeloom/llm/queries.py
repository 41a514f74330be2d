"""The registered queries of this subpackage, by the driver's contracts, and
SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import new_folder
from . import decontaminate, exact_dedup, filter_audit, jaccard_join, line_quality, mixing, pii, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter, whitening
from .packs import checkpointed

#: A public tokenizer's ranks on this machine; an argument everywhere else.
RANKS, VERSION = "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_50k"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the table arrives in one of four ways: loaded as it is;
    loaded as a draft and revised; inserted later; loaded twice, and the second
    one deleted.  The batch of changes is committed twice, before and after the
    rollup is compacted, and the load once more at the end; what is live is the
    table."""
    docs = _table(spark, sf_dir, "documents").withColumn("_way", F.pmod(F.xxhash64("doc_id", "text"), F.lit(10)))
    late, revised, twice = (docs.where(F.col("_way") == k) for k in (3, 5, 7))
    drafts = revised.withColumn("text", F.concat("text", F.lit(" A draft.")))
    rollup = token_counts.Rollup(spark, new_folder(spark, "token-rollup"))
    load = checkpointed(token_counts.delta(inserted=docs.where("_way not in (3, 5)").unionByName(drafts).unionByName(twice), ranks=RANKS, version=VERSION))
    changes = checkpointed(token_counts.delta(inserted=late, deleted=twice, revised=(drafts, revised), ranks=RANKS, version=VERSION))
    rollup.commit("load", load)
    rollup.commit("changes", changes)
    rollup.commit("changes", changes)
    rollup.compact()
    rollup.commit("changes", changes)
    rollup.commit("load", load)
    totals = checkpointed(rollup.totals())  # a row for each source, language and version
    rollup.drop()
    return totals


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.listed(pii.KINDS).cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.listed((*pii.KINDS, "term")).alias("spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return decontaminate.judged(found).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.failed_counts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    out = filter_audit.interactions(counts, "ABCDE")
    return out.withColumnsRenamed({"quality_lost": "good_lost"})


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = line_quality.score(docs, line_quality.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", line_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_source_mix, op3_exact_dedup, op4_token_counts, op5_personal_data, op6_suffix_dedup, op7_decontamination, op8_jaccard_join, op9_url_filter, op10_toxicity, op11_filter_audit, op12_embedding_whitening, op13_quality_classifier)}


# ---------------------------------------------------------------- SQL

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 49)) AS p)),
f AS (SELECT h, min(doc_id) AS low FROM x GROUP BY h),
hit AS (SELECT x.doc_id, x.p FROM x JOIN f USING (h) WHERE f.low < x.doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM hit, (SELECT unnest(generate_series(0, 49)) AS k)),
kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS v, unnest(generate_series(1, len(w))) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""

OP7_SQL = rf"""
WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram FROM (SELECT item_id, w, least(13, len(w)) AS n FROM iw WHERE len(w) > 0), LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS p)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram FROM d, (SELECT DISTINCT n FROM g), LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS p)),
m AS (SELECT x.doc_id, x.p, x.n, g.item_id FROM x JOIN g USING (n, gram)),
h AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM m), LATERAL (SELECT unnest(generate_series(0, n - 1)) AS k) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def _op9_sql() -> str:
    strict = "|".join(t for t, w in url_filter.VOCABULARY if w >= url_filter.LIMIT)
    soft = [t for t, w in url_filter.VOCABULARY if w < url_filter.LIMIT]
    has = lambda terms: f"regexp_matches(u, '(^|[^a-z0-9])({terms})([^a-z0-9]|$)')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH a AS (SELECT page_id, url, {_LOWER.format("coalesce(url, '')")} AS u, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
r AS (SELECT * FROM (VALUES {rules}) AS t(verdict, rhost, rpath)),
f AS (SELECT page_id, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, arg_max(verdict, length(rhost) * 1000 + length(rpath)) AS verdict
      FROM b, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT b.page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN {has(strict)} OR {" + ".join(f"CAST({has(t)} AS INT)" for t in soft)} >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN f USING (page_id)
"""


def mix_sql(table: str = "documents") -> str:
    """All quotients are enumerated here, and the shares found by repeated
    capping."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS digest FROM {table}),
n AS (SELECT greatest(1, CAST(ceil(coalesce(sum(size), 0) / {mixing.SHARD_WORDS}.0) AS BIGINT)) AS shards FROM d),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS ss, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
total AS (SELECT 150 * sum(ss) AS wanted FROM s),
step AS (
  SELECT 0 AS i, source, ss, weight, false AS capped, wanted AS lft, CAST((SELECT sum(weight) FROM s) AS HUGEINT) AS opn FROM s, total
  UNION ALL
  SELECT i + 1, source, ss, weight, now, wanted - 100 * coalesce(sum(CASE WHEN now THEN 2 * ss END) OVER (), 0), CAST(coalesce(sum(CASE WHEN NOT now THEN weight END) OVER (), 0) AS HUGEINT)
  FROM (SELECT *, capped OR weight * lft > 200 * ss * opn AS now FROM step), total WHERE i < 200 AND NOT (SELECT bool_and(capped = (capped OR weight * lft > 200 * ss * opn)) FROM step)
),
goal AS (SELECT source, CAST(ss AS BIGINT) AS source_size, CASE WHEN capped OR weight * lft > 200 * ss * opn THEN CAST(2 * ss AS DOUBLE) ELSE weight * CAST(lft AS DOUBLE) / CAST(100 * opn AS DOUBLE) END AS target FROM step WHERE i = (SELECT max(i) FROM step)),
q AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS r FROM (SELECT source, target, unnest(generate_series(0, CAST(target / {mixing.BLOCK} AS BIGINT) + 2)) AS k FROM goal)),
won AS (SELECT source, count(*) AS blocks FROM q WHERE r <= (SELECT floor(sum(target) / {mixing.BLOCK}) FROM goal) GROUP BY source),
dd AS (SELECT d.*, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % shards AS shard FROM d, n),
p AS (SELECT dd.source, shard, sum(size) AS ps, coalesce(any_value(blocks), 0) AS blocks FROM dd LEFT JOIN won ON dd.source IS NOT DISTINCT FROM won.source GROUP BY dd.source, shard),
pq AS (SELECT source, shard, blocks, row_number() OVER (PARTITION BY source ORDER BY CAST(ps AS DOUBLE) / (2 * k + 1) DESC, shard, k) AS r FROM (SELECT source, shard, ps, blocks, unnest(generate_series(0, CAST(blocks AS BIGINT))) AS k FROM p)),
pw AS (SELECT source, shard, count(*) AS b FROM pq WHERE r <= blocks GROUP BY source, shard),
quota AS (SELECT p.source, p.shard, ps, least(coalesce(b, 0) * {mixing.BLOCK}, 2 * ps) AS quota FROM p LEFT JOIN pw ON p.source IS NOT DISTINCT FROM pw.source AND p.shard = pw.shard),
z AS (SELECT doc_id, dd.source, size, dd.shard, CASE WHEN ps > 0 THEN quota // ps ELSE 0 END AS times, quota - (CASE WHEN ps > 0 THEN quota // ps ELSE 0 END) * ps AS rest,
      coalesce(sum(size) OVER (PARTITION BY dd.source, dd.shard ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
      FROM dd JOIN quota ON dd.source IS NOT DISTINCT FROM quota.source AND dd.shard = quota.shard)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(times * size + greatest(0, least(size, rest - bef)) AS BIGINT) AS taken
FROM z JOIN goal ON z.source IS NOT DISTINCT FROM goal.source
"""


_BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _op5_sql() -> str:
    """Places come from what stands between matches; terms are the runs of
    letters that tell."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({digits})[i] AS INT) ELSE CAST(reverse({digits})[i] AS INT) * 2 - CASE WHEN CAST(reverse({digits})[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    valid = {"email": "true", "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS INT), 0) <= 255))", "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 8 AND 15"}

    def placed(source: str, pattern: str) -> str:
        """(row, m, s, e) of all matches in source(row, text)."""
        return f"""SELECT row, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY row ORDER BY k) - length(m) AS BIGINT) AS s, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY row ORDER BY k) AS BIGINT) AS e
          FROM (SELECT row, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(regexp_split_to_array(text, '{pattern}')[1:len(regexp_extract_all(text, '{pattern}'))]) AS gap, unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS k FROM {source})"""

    found = " UNION ALL ".join(f"SELECT row, '{k}' AS kind, {i} AS o, m, s, e FROM ({placed('d', p)}) WHERE {valid[k]}" for i, (k, p) in enumerate(_BASE.items()))
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in _BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT count(*) AS n FROM d), b AS MATERIALIZED ({found}),
m AS (SELECT DISTINCT row, m AS entity FROM b), ce AS (SELECT entity, count(*) AS ce FROM m GROUP BY entity HAVING count(*) >= {pii.MIN_DOCS}),
l AS MATERIALIZED ({placed("d", chr(92) + "p{L}{4,}")}), w AS MATERIALIZED (SELECT DISTINCT row, lower(m) AS word FROM l),
cb AS (SELECT word, entity, count(*) AS cb FROM m JOIN ce USING (entity) JOIN w USING (row) GROUP BY ALL HAVING count(*) >= {pii.MIN_DOCS}), cw AS (SELECT word, count(*) AS cw FROM w GROUP BY word),
t AS (SELECT DISTINCT word FROM cb JOIN cw USING (word) JOIN ce USING (entity), n WHERE ce < n AND log2(CAST(n AS DOUBLE) * cb / (cw * ce)) / log2(CAST(n AS DOUBLE) / ce) >= {pii.THRESHOLD}),
a AS (SELECT * FROM b UNION ALL SELECT row, 'term', 4, m, s, e FROM l WHERE lower(m) IN (SELECT word FROM t)),
x AS (SELECT row, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans FROM a GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (row)
"""


#: Windows are cut from pieces of texts in hexadecimal digits, two a byte.
OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT row, length(h) // 2 AS n, b, substr(h, 2 * b + 1, 2 * 600) AS piece FROM d, LATERAL (SELECT unnest(range(0, greatest(length(h) // 2 - 199, 0), 400)) AS b)),
w AS (SELECT row, b + i AS p, md5(substr(piece, 2 * i + 1, 400)) AS k FROM p, LATERAL (SELECT unnest(range(0, least(400, n - 199 - b))) AS i)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1), hit AS (SELECT row, p FROM w JOIN r USING (k)),
g AS (SELECT row, p, coalesce(p > max(p) OVER (PARTITION BY row ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200, true) AS fresh FROM hit),
s AS (SELECT row, min(p) AS s, max(p) + 200 AS e FROM (SELECT row, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY row ORDER BY p) AS run FROM g) GROUP BY row, run),
x AS (SELECT row, sum(e - s) AS removed, count(*) AS spans FROM s GROUP BY row),
c AS (SELECT row, k, CASE WHEN k = 0 THEN 0 ELSE lag(e) OVER o END AS f, coalesce(s, 0) AS t FROM (SELECT row, s, e, row_number() OVER (PARTITION BY row ORDER BY s) - 1 AS k FROM s) WINDOW o AS (PARTITION BY row ORDER BY s)),
z AS (SELECT row, max(e) AS last FROM s GROUP BY row),
kept AS (SELECT c.row, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY k) || substr(any_value(h), 2 * any_value(last) + 1) AS h FROM c JOIN d ON c.row = d.row JOIN z ON c.row = z.row GROUP BY c.row)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN x USING (row) LEFT JOIN kept ON d.row = kept.row
"""

#: Copies of a set count once before they are paired.
OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN CASE WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) END)) AS s FROM d),
c AS MATERIALIZED (SELECT min(doc_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s), t AS (SELECT id, n, unnest(s) AS t FROM c),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS o, any_value(a.n) AS an, any_value(b.n) AS bn FROM t a JOIN t b ON a.t = b.t AND a.id < b.id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * o >= 75 * (an + bn - o)), two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id AS other FROM c WHERE id IN (SELECT a FROM two) UNION SELECT r.id, two.b FROM r JOIN two ON r.other = two.a), low AS (SELECT id, min(other) AS component FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(low.component, c.id, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN low ON low.id = c.id
"""


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(o) < 5 AND NOT contains(o, x)),
s AS (SELECT o AS filter_order, CAST(step AS INT) AS step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(o) = 5),
g AS (SELECT part, filter_order, step, n, good, toxic, failed, x, contains(failed, x) AS fails, translate(failed, before, '') <> failed AS gone FROM c, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (failed = x), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(length(failed), 1)) FILTER (fails), 0) AS BIGINT) AS shapley
FROM g GROUP BY part, filter_order, step
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_source_mix": mix_sql(), "op3_exact_dedup": OP3_SQL, "op5_personal_data": _op5_sql(), "op6_suffix_dedup": OP6_SQL, "op7_decontamination": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op9_url_filter": _op9_sql(), "op11_filter_audit": OP11_SQL}
