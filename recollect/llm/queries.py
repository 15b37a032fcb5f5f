"""Production queries for the operators of this subpackage, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, embed_dedup, mixing, ngram_join, pieces, secret_scan, sketch, suffix_dedup, token_counts, toxicity, url_filter, vector_codes
from .util import new_path, remove, tuned

PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files are installed; never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# -- 1: toxicity ---------------------------------------------------------------


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "abuse",
        "quoted",
    )


# -- 3: token counts ------------------------------------------------------------

RANKS = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "tokens")
    token_counts.write_tokens(docs, path, tokenizer_file(RANKS), END_OF_DOCUMENT, key="doc_id")
    counted = token_counts.keyed_counts(spark, path, END_OF_DOCUMENT)
    remove(spark, path)
    return counted


# -- 2: SentencePiece ---------------------------------------------------------


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = pieces.encode_decode(docs, ["doc_id"], tokenizer_file(PIECE_MODEL), ids="csv")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "library_agrees")


# -- 4: mixing ----------------------------------------------------------------

#: Target weights; sources not named weigh 1.
WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
MIX_SEED = 17


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, MIX_SEED)


OP4_SQL = f"""
WITH sizes AS (
  SELECT source, COALESCE(SUM(length(text)), 0)::BIGINT AS size,
         CASE {" ".join(f"WHEN source = '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items())} ELSE 1.0::DOUBLE END AS weight
  FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN weight / SUM(weight) OVER () * (SUM(size) OVER ())::DOUBLE / size ELSE 0.0 END AS rate FROM sizes),
drawn AS (
  SELECT d.*, r.rate, floor(r.rate / {mixing.PIECE})::BIGINT AS whole
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
pieces AS (
  SELECT doc_id, text, lang, source, n_chars, i,
         CASE WHEN i = 0 THEN rate - whole * {mixing.PIECE}::DOUBLE ELSE {mixing.PIECE}::DOUBLE END AS rate,
         ('0x' || substr(md5('draw-{MIX_SEED}:' || COALESCE(doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)}::DOUBLE AS u
  FROM drawn, LATERAL (SELECT unnest(range(whole + 1)) AS i)),
terms AS (
  SELECT doc_id, text, lang, source, n_chars, i, u, k,
         exp(-rate) * CASE WHEN k = 0 THEN 1.0 ELSE list_product(list_transform(range(1, k + 1), lambda x: rate / x)) END AS p
  FROM pieces, LATERAL (SELECT unnest(range(ceil(rate + 12 * sqrt(rate) + 24)::INT + 1)) AS k)),
counts AS (
  SELECT doc_id, text, lang, source, n_chars, i, COUNT(*) FILTER (WHERE cdf <= u) AS n
  FROM (SELECT *, SUM(p) OVER (PARTITION BY doc_id, text, lang, source, n_chars, i ORDER BY k) AS cdf FROM terms)
  GROUP BY ALL),
total AS (SELECT doc_id, text, lang, source, n_chars, SUM(n)::BIGINT AS n_copies FROM counts GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy, n_copies,
       md5('deal-{MIX_SEED}:' || COALESCE(doc_id::VARCHAR, '') || ':' || copy) AS mix_key
FROM total, LATERAL (SELECT unnest(range(n_copies)) AS copy)
"""


# -- 5: n-gram Jaccard join ------------------------------------------------------


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


# -- 6: embeddings ------------------------------------------------------------


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# -- 7: chat ------------------------------------------------------------------

PLANTED = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text")
    )
    out = chat.format_chat(chat.rows_to_records(rows.unionByName(planted)))
    back = out.select(
        "conv_id",
        "layout",
        "formatted",
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '### ', '\h') AS body,
         replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\t'), '### ', '\h'), ': ', '\c') AS head FROM said)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       SUM(4 + length(head) + 2 + length(body) + 7)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


# -- 8: fingerprints ----------------------------------------------------------


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_and_next(table(spark, sf_dir, "documents"))


# -- 9: secrets ---------------------------------------------------------------


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    spans = F.col("secret_spans")

    def n(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter(spans, lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


# -- 10: URL filter -----------------------------------------------------------

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Hosts of the method's own list: advertising and spam sites.
SPAM_HOSTS = ["casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "ads-track.example.com"]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(*r, 0) for r in RULES] + [(h, "/", "block", 1) for h in SPAM_HOSTS]
    rules = spark.createDataFrame(rows, "host string, path string, verdict string, tier int")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP10_SQL = f"""
WITH split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM split),
rules(r_host, r_path, verdict, tier) AS (
  VALUES {", ".join([f"('{h}', '{p}', '{v}', 0)" for h, p, v in RULES] + [f"('{h}', '/', 'block', 1)" for h in SPAM_HOSTS])}),
fits AS (
  SELECT r, r_host || r_path AS rule, verdict, tier,
         row_number() OVER (PARTITION BY r ORDER BY tier, length(r_host || r_path) DESC, length(r_host) DESC, verdict DESC) AS k
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, CASE WHEN tier = 0 THEN rule END AS rule, COALESCE(verdict, 'allow') AS verdict, CASE WHEN tier > 0 THEN rule END AS method_rule
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)
"""


# -- 11: centroid clustering --------------------------------------------------


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


#: Vectors whose components are all there and finite.
FINITE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
GAP_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
#: floor(s / n) of whole numbers, n positive.
FLOOR_SQL = "((s - ((s % n) + n) % n) // n)"


def _op11_sql() -> str:
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v "
        f"FROM embeddings WHERE len(embedding) = {centroids.SIZE} AND {FINITE_SQL})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY mark) - 1 AS k, v FROM "
        f"(SELECT v, sha256('2:' || vec_id) AS mark FROM kept) ORDER BY mark LIMIT {centroids.CENTROIDS})",
    ]
    for r in range(centroids.ROUNDS + 1):
        ctes.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v, k, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS place FROM "
            f"(SELECT vec_id, x.v, k, {GAP_SQL.format(a='x.v', b='c.v')} AS d FROM kept x, c{r} c)) WHERE place = 1)"
        )
        if r < centroids.ROUNDS:
            ctes.append(
                f"m{r} AS (SELECT k, list({FLOOR_SQL} ORDER BY i) AS v FROM (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM "
                f"(SELECT k, unnest(range({centroids.SIZE})) AS i, unnest(v) AS x FROM a{r}) GROUP BY k, i) GROUP BY k)"
            )
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, COALESCE(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k)")
    last = centroids.ROUNDS
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, a.k::INT AS cluster, d AS distance, SUM(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia,
       SUM(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON a.k = c.k"""


# -- 12: vector codes ---------------------------------------------------------


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    parts = vector_codes.PARTS
    ctes = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {FINITE_SQL})",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, (SELECT unnest(range({parts})) AS p))",
        f"c0 AS MATERIALIZED (SELECT p, k, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < {vector_codes.ENTRIES})",
    ]
    for r in range(vector_codes.ROUNDS + 1):
        ctes.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, v, k, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) AS place FROM "
            f"(SELECT vec_id, label, x.p, x.v, k, {GAP_SQL.format(a='x.v', b='c.v')} AS d FROM parts x JOIN c{r} c ON x.p = c.p)) WHERE place = 1)"
        )
        if r < vector_codes.ROUNDS:
            ctes.append(
                f"m{r} AS (SELECT p, k, list({FLOOR_SQL} ORDER BY i) AS v FROM (SELECT p, k, i, sum(x)::BIGINT AS s, count(*) AS n FROM "
                f"(SELECT p, k, unnest(range(len(v))) AS i, unnest(v) AS x FROM a{r}) GROUP BY p, k, i) GROUP BY p, k)"
            )
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, COALESCE(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.p = m.p AND c.k = m.k)")
    last = vector_codes.ROUNDS
    return f"""WITH {", ".join(ctes)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, SUM(d)::BIGINT AS error FROM a{last} GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{last})
SELECT vec_id, code, error, SUM(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books"""


# -- 13: suffix-array dedup ---------------------------------------------------


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_chat": op7_chat,
    "op8_fingerprints": op8_fingerprints,
    "op9_secrets": op9_secrets,
    "op10_url_filter": op10_url_filter,
    "op11_centroids": op11_centroids,
    "op12_vector_codes": op12_vector_codes,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLES = {"op4_mixing": OP4_SQL, "op7_chat": OP7_SQL, "op10_url_filter": OP10_SQL, "op11_centroids": _op11_sql(), "op12_vector_codes": _op12_sql()}
