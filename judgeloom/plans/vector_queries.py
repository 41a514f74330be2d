"""Projections on a vocabulary, losses, views and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import layout as L
from ..operators import matching
from ..operators import reconstruct as R
from ..operators import vectors as V
from ..sources.tables import table
from .measure_queries import _EDGES_SQL, _edges
from .registry import query


def _states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("h"))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The means of the labels as words; the basis is their reverse."""
    means = _states(spark, d).select("label", F.posexplode("h").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    w = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    return means.groupBy(F.col("label").alias("word")).agg(w.alias("w")).withColumn("e", F.reverse("w"))


_VOCABULARY_SQL = """
e AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i, len(embedding) AS n FROM embeddings), w AS (SELECT label AS word, i, avg(v) AS v, max(n) AS n FROM e GROUP BY ALL),
b AS (SELECT word, n - 1 - i AS i, v FROM w), wn AS (SELECT word, greatest(sqrt(sum(v * v)), 1e-12) AS n FROM w GROUP BY word), hn AS (SELECT id, greatest(sqrt(sum(v * v)), 1e-12) AS n FROM e GROUP BY id),
z AS (SELECT id, word, sum(e.v * w.v) AS z FROM e JOIN w USING (i) GROUP BY ALL)
"""


@query(f"WITH {_VOCABULARY_SQL}, c AS (SELECT id, word, z / (wn.n * hn.n) / 0.5 AS z FROM z JOIN wn USING (word) JOIN hn USING (id)), m AS (SELECT id, max(z) AS m FROM c GROUP BY id) SELECT id, word, round(exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY id), 6) AS p FROM c JOIN m USING (id)")
def vocabulary_projection(spark: SparkSession, d: str) -> DataFrame:
    """softmax(W h) over all words, of unit vectors, at half the temperature."""
    return V.projected(_states(spark, d), _vocabulary(spark, d), cosine=True, temperature=0.5).select("id", "word", F.round("p", 6).alias("p"))


_TOP3 = "t AS (SELECT id, word, z, row_number() OVER (PARTITION BY id ORDER BY z DESC, word) - 1 AS rank FROM z QUALIFY rank < 3), q AS (SELECT id, rank, word, exp(z - max(z) OVER w) / sum(exp(z - m)) OVER w AS p FROM (SELECT *, max(z) OVER (PARTITION BY id) AS m FROM t) WINDOW w AS (PARTITION BY id))"


@query(f"WITH {_VOCABULARY_SQL}, {_TOP3} SELECT id, CAST(rank AS INT) AS rank, word, round(p, 6) AS p FROM q")
def projection_topk(spark: SparkSession, d: str) -> DataFrame:
    """softmax(W h) over the three likeliest words."""
    return V.projected(_states(spark, d), _vocabulary(spark, d), top_k=3).withColumn("p", F.round("p", 6))


@query(f"WITH {_VOCABULARY_SQL}, {_TOP3} SELECT id, CAST(i AS INT) AS dim, round(sum(p * v), 5) + 0.0 AS v FROM q JOIN b USING (word) GROUP BY ALL")
def weighted_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The basis vectors of the three likeliest words, by their probabilities."""
    words = _vocabulary(spark, d)
    out = V.weighted(V.projected(_states(spark, d), words, top_k=3), words)
    return out.select("id", "dim", (F.round("v", 5) + 0.0).alias("v"))


@query(f"WITH {_VOCABULARY_SQL} SELECT id, label, round(z, 4) + 0.0 AS dot FROM z JOIN (SELECT vec_id AS id, label FROM embeddings) USING (id) WHERE word = label")
def vector_dot(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the mean of its label."""
    z = V.logits(_states(spark, d), _vocabulary(spark, d)).select("id", F.explode("z").alias("x")).select("id", "x.*")
    rows = z.join(_states(spark, d).select("id", "label"), "id").where("word = label")
    return rows.select("id", "label", (F.round("z", 4) + 0.0).alias("dot"))


#: Sequences of eight vectors; a vector's teacher is the one after it.
_NEXT = "SELECT vec_id, vec_id // 8 AS seq, vec_id % 8 AS pos, embedding AS z, lead(embedding) OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS t FROM embeddings"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("seq").orderBy("vec_id")
    rows = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("seq"), (F.col("vec_id") % 8).alias("pos"), F.col("embedding").cast("array<double>").alias("z"))
    return rows.withColumn("t", F.lead("z").over(w))


@query(f"""
WITH p AS (SELECT vec_id, seq, pos, unnest(z)::DOUBLE / 2 AS z, abs(unnest(t)::DOUBLE) AS q FROM ({_NEXT}) WHERE t IS NOT NULL),
k AS (SELECT vec_id, seq, pos, sum(q / s * (ln(greatest(q / s, 1e-12)) - (z - m - ln(e)))) AS kl FROM (SELECT *, sum(q) OVER w + 1e-12 AS s, max(z) OVER w AS m FROM p WINDOW w AS (PARTITION BY vec_id)) JOIN (SELECT vec_id, sum(exp(z - m)) AS e FROM (SELECT vec_id, z, max(z) OVER (PARTITION BY vec_id) AS m FROM p) GROUP BY vec_id) USING (vec_id) GROUP BY ALL)
SELECT seq, round(sum(CASE WHEN pos % 3 <> 1 THEN kl ELSE 0 END) / greatest(count(*) FILTER (pos % 3 <> 1), 1) * 4, 4) + 0.0 AS loss FROM k GROUP BY seq
""")
def kl_masked(spark: SparkSession, d: str) -> DataFrame:
    """KL of the teacher's whole distribution at temperature two, as a masked
    mean of each sequence."""
    rows = _pairs(spark, d).where("t is not null").withColumn("kl", V.divergence(F.col("z"), F.transform("t", lambda x: F.abs(x)), temperature=2.0))
    return V.mean_divergence(rows, "seq", F.col("kl"), F.col("pos") % 3 != 1, 2.0).withColumn("loss", F.round("loss", 4) + 0.0)


_KL = f"""
p AS (SELECT vec_id, seq, pos, unnest(z)::DOUBLE AS z, unnest(t)::DOUBLE AS t, unnest(range(len(z))) AS i FROM ({_NEXT}) WHERE t IS NOT NULL),
l AS (SELECT vec_id, m + ln(sum(exp(z - m))) AS lse FROM (SELECT vec_id, z, max(z) OVER (PARTITION BY vec_id) AS m FROM p) GROUP BY vec_id, m),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY t DESC, i) AS k FROM p QUALIFY k <= 10), q AS (SELECT *, exp(t - m) / sum(exp(t - m)) OVER (PARTITION BY vec_id) AS q FROM (SELECT *, max(t) OVER (PARTITION BY vec_id) AS m FROM r)),
k AS (SELECT vec_id, seq, pos, sum(q * (ln(greatest(q, 1e-12)) - (z - lse))) AS kl FROM q JOIN l USING (vec_id) GROUP BY ALL)
"""


def _sparse(rows: DataFrame) -> DataFrame:
    """rows with kl: the teacher's ten likeliest entries against the student."""
    top = A.top_k(F.col("t"), 10)
    return rows.where("t is not null").withColumn("top", top).withColumn("kl", V.divergence(F.col("z"), A.softmax(F.col("top.value")), F.col("top.index")))


@query(f"WITH {_KL} SELECT seq, round(avg(kl), 4) + 0.0 AS loss FROM k GROUP BY seq")
def kl_topk(spark: SparkSession, d: str) -> DataFrame:
    """KL of the teacher's ten likeliest entries against the student's whole
    distribution, as a mean of each sequence."""
    rows = _sparse(_pairs(spark, d))
    return V.mean_divergence(rows, "seq", F.col("kl")).withColumn("loss", F.round("loss", 4) + 0.0)


@query(f"""
WITH {_KL}, c AS (SELECT vec_id, seq, pos, lse - z AS ce FROM p JOIN l USING (vec_id) WHERE i = (vec_id * 7) % 64), e AS (SELECT seq, sum(ce) AS s, count(*) AS n, avg(kl) FILTER (pos BETWEEN 1 AND 3) AS kl FROM c JOIN k USING (vec_id, seq, pos) GROUP BY seq)
SELECT seq // 4 AS batch, round(sum(s) / greatest(sum(n), 1), 4) + 0.0 AS loss_ce, round(avg(coalesce(kl, 0)), 4) + 0.0 AS loss_kl, round(0.5 * sum(s) / greatest(sum(n), 1) + 2 * avg(coalesce(kl, 0)), 4) + 0.0 AS loss FROM e GROUP BY 1
""")
def combined_loss(spark: SparkSession, d: str) -> DataFrame:
    """Cross entropy of every position, and divergences of the latent span: the
    logits that count for a latent are those one position before it."""
    rows = _sparse(_pairs(spark, d))
    target = ((F.col("vec_id") * 7) % 64).cast("int")
    start, end = 2, 5  # the span of latents; its logits are at 1 to 3
    rows = rows.withColumn("ce", -F.get(V.log_softmax(F.col("z")), target)).withColumn("batch", F.floor(F.col("seq") / 4))
    inside = F.col("pos").between(start - 1, end - 2)
    out = V.combined_loss(rows, "batch", "seq", F.col("ce"), F.when(inside, F.col("kl")), 0.5, 2.0)
    return out.select("batch", *[(F.round(c, 4) + 0.0).alias(c) for c in ("loss_ce", "loss_kl", "loss")])


@query("SELECT vec_id, CAST(i - 1 AS INT) AS dim, round(p[i] / greatest(s, 1e-12), 6) AS p FROM (SELECT vec_id, p, list_sum(p) AS s FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 9 = 0 THEN 0.0 ELSE abs(x)::DOUBLE END) AS p FROM embeddings)), range(1, 65) r(i)")
def normalized_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that sum to one; a row of zeros stays one."""
    p = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.col("vec_id") % 9 == 0, 0.0).otherwise(F.abs(x)))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(A.normalised(p)).alias("dim", "p"))
    return rows.withColumn("p", F.round("p", 6))


def _digest(a: Column) -> Column:
    return F.sha2(F.array_join(a.cast("array<string>"), ",").cast("binary"), 256)


_MARKED = "flatten(list_transform(range(1, len(ends) + 1), lambda i: t[CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END + 1:ends[i]] || [-1]))"


@query(f"SELECT doc_id, CAST(len(m) AS INT) AS length, sha256(array_to_string(m, ',')) AS ids_sha256 FROM (SELECT doc_id, {_MARKED} AS m FROM (SELECT e.doc_id, ends, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w)) AS t FROM ({_EDGES_SQL}) e JOIN documents USING (doc_id)))")
def interleave_marker(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk of a record with a marker after it."""
    ids = F.transform("t", lambda w: F.length(w))
    rows = _edges(spark, d).select("doc_id", A.interleaved(ids, F.col("ends"), F.lit(-1)).alias("m"))
    return rows.select("doc_id", F.size("m").alias("length"), _digest(F.col("m")).alias("ids_sha256"))


_UNIT = f"((CAST('0x' || substr(md5(concat_ws(':', '42', e.doc_id, v, {{}})), 1, 13) AS BIGINT) + 0.5) / {1 << 52}.0)"


@query(f"""
WITH f AS (SELECT e.doc_id, v, text, ends, n, CASE WHEN {_UNIT.format("'full'")} < 0.25 THEN len(ends) ELSE CAST(1 + floor({_UNIT.format("'at'")} * len(ends)) AS INT) END AS f FROM ({_EDGES_SQL}) e JOIN documents USING (doc_id), range(2) r(v)),
t AS (SELECT doc_id, v, f, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w))[1:ends[f]] || [-2] AS t, [0] || ends[1:f - 1] AS starts FROM f)
SELECT doc_id, CAST(v AS INT) AS view, mode, CAST(f AS INT) AS frontier, CAST(len(t) AS INT) AS target_length, sha256(array_to_string([1, 2, 3, -1] || CASE WHEN mode = 'latent' THEN list_transform(range(f), lambda i: 0) ELSE [] END || t, ',')) AS input_sha256,
  sha256(array_to_string(list_transform(range(4 + CASE WHEN mode = 'latent' THEN f ELSE 0 END), lambda i: -100) || t, ',')) AS labels_sha256, sha256(array_to_string(starts, ',')) AS starts_sha256, array_to_string(CASE WHEN mode = 'latent' THEN list_transform(range(f), lambda i: i + 4) ELSE [] END, ',') AS latent_positions FROM t, (VALUES ('latent'), ('prompt_only')) m(mode)
""")
def stochastic_views(spark: SparkSession, d: str) -> DataFrame:
    """Views at frontiers drawn by a digest, a quarter of them at the end; with
    latents, and as the prompt alone."""
    part = lambda *xs: F.md5(F.concat_ws(":", F.lit("42"), F.col("doc_id").cast("string"), F.col("view").cast("string"), *map(F.lit, xs)).cast("binary"))
    unit = lambda x: (F.conv(F.substring(part(x), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = _edges(spark, d).select("doc_id", F.transform("t", lambda w: F.length(w)).alias("ids"), "ends", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("view"))
    rows = rows.withColumn("frontier", F.when(unit("full") < 0.25, F.size("ends")).otherwise((1 + F.floor(unit("at") * F.size("ends"))).cast("int")))
    prefix = F.array(F.lit(1), F.lit(2), F.lit(3))
    out = None
    for mode in ("latent", "prompt_only"):
        ids, labels = L.prefix_view(prefix, F.col("ids"), F.col("ends"), F.col("frontier"), [-1], [-2], 0, latents=mode == "latent")
        places = F.transform(F.sequence(F.lit(0), F.col("frontier") - 1), lambda i: i + 4) if mode == "latent" else F.array().cast("array<int>")
        starts = F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.col("frontier") - 1))
        view = rows.select("doc_id", "view", F.lit(mode).alias("mode"), "frontier", (F.get("ends", F.col("frontier") - 1) + 1).alias("target_length"), _digest(ids).alias("input_sha256"), _digest(labels).alias("labels_sha256"), _digest(starts).alias("starts_sha256"), F.array_join(places.cast("array<string>"), ",").alias("latent_positions"))
        out = view if out is None else out.unionByName(view)
    return out


_KIND = "CASE WHEN length(t[{0}]) = 1 THEN 1 WHEN length(t[{0}]) = 2 THEN 2 ELSE 0 END"


@query(f"""
WITH w AS (SELECT item_id, string_split(coalesce(text, ''), ' ') AS t FROM benchmark), p AS (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS i FROM w)
SELECT item_id, CAST(i - 1 AS INT) AS position, array_to_string(list_transform(range(1, len(t) + 1), lambda j: CASE WHEN j <= i AND {_KIND.format("i")} <> 1 AND {_KIND.format("j")} <> 1 AND NOT (j < i AND {_KIND.format("j")} = 2) THEN 1 ELSE 0 END), '') AS keep FROM p
""")
def induction_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The attention mask itself, a row for each position of an item: causal,
    without earlier special tokens (words of two letters) and padding (of one)."""
    t = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.when(F.length(w) == 1, 1).when(F.length(w) == 2, 2).otherwise(0))
    rows = table(spark, d, "benchmark").select("item_id", t.alias("kinds"), F.posexplode(t).alias("position", "own"))
    return rows.select("item_id", "position", F.array_join(L.mask_row(F.col("kinds"), F.col("position"), F.col("own")).cast("array<string>"), "").alias("keep"))


_SCORES = "list_dot_product(h.embedding::DOUBLE[], w.embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(h.embedding::DOUBLE[], h.embedding::DOUBLE[])), 1e-12) / greatest(sqrt(list_dot_product(w.embedding::DOUBLE[], w.embedding::DOUBLE[])), 1e-12) / 0.05"


@query(f"""
WITH z AS (SELECT h.vec_id AS id, w.vec_id AS word, {_SCORES} AS z FROM embeddings h, embeddings w), p AS (SELECT id, word, exp(z - max(z) OVER (PARTITION BY id)) AS p FROM z),
e AS (SELECT vec_id AS word, unnest(embedding)::DOUBLE AS x, len(embedding) - unnest(range(len(embedding))) - 1 AS dim FROM embeddings)
SELECT id, CAST(dim AS INT) AS dim, round(sum(p * x) / sum(p), 5) + 0.0 AS v FROM p JOIN e USING (word) GROUP BY id, dim
""")
def vocabulary_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a mean of all vectors (turned around), weighted by a
    softmax over all of them."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("h"))
    words = v.select(F.col("id").alias("word"), F.col("h").alias("w"), F.reverse("h").alias("e"))
    out = R.reconstructed(v, words, cosine=True, temperature=0.05)
    return out.select("id", F.posexplode("v").alias("dim", "v")).select("id", "dim", (F.round("v", 5) + 0.0).alias("v"))


_TOKEN = "(ascii(w) * 31 + length(w) * 7) % (SELECT count(*) FROM embeddings)"


@query(f"""
WITH x AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), lambda w: w) AS ws FROM conversations),
t AS (SELECT id, conv_id, turn, {_TOKEN} AS token FROM (SELECT id, conv_id, turn, unnest(ws) AS w FROM x)),
pair AS (SELECT a.id, a.conv_id, a.turn FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
c AS (SELECT pair.id, token, count(*) AS n FROM pair JOIN t USING (id) GROUP BY ALL), r AS (SELECT pair.id, token, count(*) AS n FROM pair JOIN t ON t.conv_id = pair.conv_id AND t.turn = pair.turn + 1 GROUP BY ALL),
total AS (SELECT count(*) AS n FROM pair), df AS (SELECT token, count(*) AS df FROM r GROUP BY token), idf AS (SELECT vec_id AS token, ln((total.n + 1.0) / (coalesce(df, 0) + 1)) AS idf FROM embeddings LEFT JOIN df ON vec_id = token, total),
u AS (SELECT vec_id AS token, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
s AS (SELECT c.id, c.token AS a, r.token AS b, c.n AS na, r.n AS nb, CASE WHEN c.token = r.token THEN 1.0 ELSE list_dot_product(ua.u, ub.u) END AS cos FROM c JOIN r USING (id) JOIN u ua ON ua.token = c.token JOIN u ub ON ub.token = r.token),
p AS (SELECT id, sum(m * na * idf) / sum(na * idf) AS p FROM (SELECT id, a AS token, any_value(na) AS na, max(cos) AS m FROM s GROUP BY ALL) JOIN idf USING (token) GROUP BY id),
q AS (SELECT id, sum(m * nb * idf) / sum(nb * idf) AS r FROM (SELECT id, b AS token, any_value(nb) AS nb, max(cos) AS m FROM s GROUP BY ALL) JOIN idf USING (token) GROUP BY id)
SELECT pair.id, round(coalesce(p, 0), 5) AS "precision", round(coalesce(r, 0), 5) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 5) AS f1 FROM pair LEFT JOIN p USING (id) LEFT JOIN q USING (id)
""")
def token_matching(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation against the next one, words standing for the
    given vectors."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vector"))
    n = vectors.count()
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    tokens = F.transform(words, lambda w: ((F.ascii(w) * 31 + F.length(w) * 7) % n).cast("string"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", tokens.alias("tokens"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("tokens").alias("reference"))
    pairs = turns.join(after, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("tokens").alias("candidate"), "reference")
    out = matching.matched(pairs, vectors)
    return out.select("id", *(F.round(c, 5).alias(c) for c in ("precision", "recall", "f1")))
