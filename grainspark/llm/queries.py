"""The registered queries of this folder: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainspark.llm import divergence, htmlmain, imatch, langid, licences, linededup, mixing, packing, pii, shallot, simhash, tiff, toxicity
from grainspark.llm.common import documents, fold


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
    model = langid.train(docs, fold("id", 3) != 1)
    return langid.predict(docs, model, carry=("doc_id",)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, fold("doc_id", 5) != 0)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    return toxicity.score(docs, model, carry=("doc_id",)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.store_texts(documents(spark, sf_dir))
    pages = tiff.read_pages(media, carry=("n_bytes",))
    size = F.length("samples")
    return pages.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return htmlmain.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = imatch.compare_with_next(docs, imatch.lexicon(docs))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_packing_gga(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: Shares of the mixture by domain, a domain being a row of quality and toxicity labels.
TARGETS = {"quality1_toxic0": 0.90, "quality0_toxic0": 0.07, "quality1_toxic1": 0.02, "quality0_toxic1": 0.01}


def domain_of_labels() -> Column:
    return F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("_toxic"), F.col("toxic").cast("string"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = mixing.train(docs, labels, domain_of_labels())
    mixed = mixing.mix(docs.select("doc_id", "text"), model, TARGETS)
    return mixed.select("doc_id", "tokens", "domain", *(F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(model.domains)), "rate", "copies", "gap")


def op11_shallot_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shallot.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", shallot.digest(F.col("centroid")).alias("centroid_sha256"))


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base, spans = F.col("base"), F.col("spans")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licences.labels(base).alias("base_labels"),
        licences.labels(base, spans).alias("labels"),
        licences.score(base, spans).alias("score"),
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir)).select("lang", "source", "part", "item", "value", "rank")


#: The SQL of op8.
OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.owner <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE o.owner IS NULL OR o.owner = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN owners o ON o.key = k.key
GROUP BY k.doc_id
"""


def _op11_sql(rounds: int = 3) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
  found{r} AS MATERIALIZED (
    SELECT v.vec_id, c.c, CAST(sum((v.x - c.y) * (v.x - c.y)) AS BIGINT) AS d FROM v JOIN c{r} c USING (i) GROUP BY v.vec_id, c.c
    QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY sum((v.x - c.y) * (v.x - c.y)), c.c) = 1
  )""")
        if r < rounds:
            steps.append(f"""
  sums{r} AS (SELECT f.c, v.i, sum(v.x) AS s, count(*) AS n FROM found{r} f JOIN v USING (vec_id) GROUP BY f.c, v.i),
  c{r + 1} AS MATERIALIZED (SELECT c.c, c.i, coalesce(CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT), c.y) AS y FROM c{r} c LEFT JOIN sums{r} m USING (c, i))""")
    return f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), v AS MATERIALIZED (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept
), starts AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept
), c0 AS MATERIALIZED (SELECT s.c, v.i, v.x AS y FROM starts s JOIN v USING (vec_id) WHERE s.c < 16), {",".join(steps)},
marks AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM found{rounds} JOIN marks USING (c)
"""


def _op12_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: ", ".join(map(quote, xs))
    rules = ", ".join(f"({r.no}, {quote(r.keyword)}, {quote(r.pattern)}, {quote(r.label)}, {r.tier}, {r.weight}::DOUBLE)" for r in licences.RULES)
    return rf"""
WITH rules(no, keyword, pattern, label, tier, weight) AS (VALUES {rules}),
d AS MATERIALIZED (
  SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '{licences.BETWEEN}', ' ', 'g')) AS joined FROM documents
), w AS MATERIALIZED (
  SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT doc_id, string_split(joined, ' ') AS words FROM d WHERE joined <> '')
), windows AS (
  SELECT doc_id, i, word, words, array_to_string(words[i:i + {licences.WINDOW - 1}], ' ') || ' ' AS text
  FROM w WHERE word IN (SELECT keyword FROM rules) OR word IN ({listed(licences.LEADS)})
), leads AS (SELECT *, regexp_extract(text, '^{licences.LEAD}', 0) AS l FROM windows),
hits AS MATERIALIZED (
  SELECT doc_id, i, text, CASE WHEN word NOT IN ({listed(licences.LEADS)}) THEN word WHEN l <> '' THEN '{licences.LED}' || words[i + length(l) - length(replace(l, ' ', ''))] END AS keyword
  FROM leads
), found AS MATERIALIZED (
  SELECT doc_id, i - 1 AS s, i - 1 + length(m) - length(replace(m, ' ', '')) AS e, tier, no, label, weight
  FROM (SELECT hits.*, rules.*, regexp_extract(text, pattern, 0) AS m FROM hits JOIN rules USING (keyword)) WHERE m <> ''
), kept AS (
  SELECT * FROM found a WHERE tier = 0 OR NOT EXISTS (
    SELECT 1 FROM found b WHERE b.doc_id = a.doc_id AND b.tier >= a.tier AND b.s <= a.s AND b.e >= a.e AND b.no <> a.no
      AND (b.s < a.s OR b.e > a.e OR b.tier > a.tier OR b.no < a.no))
), sums AS (
  SELECT doc_id, count(*) FILTER (WHERE tier = 0) AS n_base, min(s) FILTER (WHERE tier = 0) AS first_word, max(s) FILTER (WHERE tier = 0) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE tier = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score
  FROM kept GROUP BY doc_id
)
SELECT doc_id, CASE WHEN joined = '' THEN 0 ELSE length(joined) - length(replace(joined, ' ', '')) + 1 END AS n_words, coalesce(n_base, 0) AS n_base,
       first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN sums USING (doc_id)
"""


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), per AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM per GROUP BY lang, term HAVING sum(docs) >= 10
), v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY lang),
sizes AS (SELECT per.lang, per.source, CAST(sum(per.n) AS BIGINT) AS n FROM per JOIN kept USING (lang, term) GROUP BY per.lang, per.source),
g AS MATERIALIZED (SELECT lang, source, coalesce(sizes.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sizes USING (lang, source)),
p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(per.n, 0) AS c, 1 + 1000000000 * (coalesce(per.n, 0) + 2) // (g.n + 2 * v.v) AS p,
         1 + 1000000000 * (kept.n + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN per ON per.lang = g.lang AND per.source = g.source AND per.term = kept.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    numbered = (op1_language_id, op2_simhash_pivots, op3_toxicity_fm, op4_tiff_pages, op5_html_main_text, op6_pii_anchors, op7_imatch, op8_line_dedup, op9_packing_gga, op10_mixing, op11_shallot_kmeans, op12_licence_scan, op13_source_divergence)
    return {f.__name__: f for f in (*numbered, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": OP8_SQL, "op11_shallot_kmeans": _op11_sql(), "op12_licence_scan": _op12_sql(), "op13_source_divergence": OP13_SQL}
