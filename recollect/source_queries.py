"""Queries over sources, sinks and small operators, with SQL for each.

Files are made from the driver's tables in the shared folder and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import text as T
from .operators import caches, dedupe, entities, merkle, validate
from .plans import retrieve as R
from .plans import run as P
from .queries import cf, query, table, toks
from .schemas import SOURCE
from .session import shared_dir, spread
from .sources import corpus, index, jsonl


def folder(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/recollect-{tag}-{uuid.uuid4().hex}"


def pick(values: list[str], n):
    """One of some strings by number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def pick_sql(values: list[str], n: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][({n}) % {len(values)} + 1]"


# -- JSON lines ---------------------------------------------------------------------


def _customer_lines(spark, sf):
    n = F.col("c_custkey")
    line = F.when(n % 11 == 0, "").when(n % 10 == 0, F.concat(F.lit('{"c_custkey": '), n.cast("string"))).when(n % 7 == 0, F.lit("[1, 2]"))
    path = folder(spark, "lines")
    rows = table(spark, sf, "customer").select(F.coalesce(line, F.to_json(F.struct("c_custkey", "c_name"))).alias("value"))
    rows.write.text(path)
    return path


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 10 <> 0 AND c_custkey % 7 <> 0")
def jsonl_strict_rows(spark, sf):
    return jsonl.strict(spark, _customer_lines(spark, sf), "c_custkey long, c_name string")[0]


@query(
    "SELECT CASE WHEN c_custkey % 10 = 0 THEN '{\"c_custkey\": ' || c_custkey ELSE '[1, 2]' END AS line FROM customer WHERE c_custkey % 11 <> 0 AND (c_custkey % 10 = 0 OR c_custkey % 7 = 0)",
)
def jsonl_broken_lines(spark, sf):
    return jsonl.strict(spark, _customer_lines(spark, sf), "c_custkey long, c_name string")[1].select(F.col("value").alias("line"))


@query("SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def jsonl_last_prediction(spark, sf):
    """Lenient lines in file order; the last of a key wins."""
    path = folder(spark, "predictions")
    rows = table(spark, sf, "conversations").filter("text <> ''").select("conv_id", "turn", "text")
    rows.repartition(1).sortWithinPartitions("turn").select(F.to_json(F.struct("conv_id", "text")).alias("value")).write.text(path)
    return dedupe.last_wins(jsonl.lenient(spark, path, "conv_id long, text string"), "conv_id", "position").select("conv_id", "text")


@query(
    """SELECT item_id, CASE WHEN contains(d.text, 'the') THEN substr(d.text, 1, strpos(d.text, 'the') - 1) || 'THE' || substr(d.text, strpos(d.text, 'the') + 3) END AS observation_text
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 37 % 997 AND b.item_id % 5 <> 0"""
)
def case_observations(spark, sf):
    """Cases read from JSON lines, with the text at their path after its replacements."""
    path = folder(spark, "cases")
    n = F.col("item_id")
    where = F.concat(F.when(n % 5 == 0, "lost/").otherwise("doc/"), (n * 37 % 997).cast("string"))
    edits = F.array(F.struct(F.lit("the").alias("old"), F.lit("THE").alias("new")))
    rows = table(spark, sf, "benchmark").select(n, F.struct(where.alias("content_path"), edits.alias("replacements")).alias("observation"))
    rows.select(F.to_json(F.struct("item_id", "observation")).alias("value")).write.text(path)
    texts = table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    schema = "item_id long, observation struct<content_path:string,replacements:array<struct<old:string,new:string>>>"
    return jsonl.cases(spark, path, texts, schema).select("item_id", "observation_text")


@query("SELECT COUNT(*) AS a_rows, COUNT(DISTINCT text) AS b_texts FROM documents")
def metrics_file(spark, sf):
    """One row of metrics written as a JSON object with sorted keys, and read back."""
    path = folder(spark, "metrics")
    jsonl.write_metrics(table(spark, sf, "documents").agg(F.countDistinct("text").alias("b_texts"), F.count("*").alias("a_rows")), path)
    return spark.read.schema("a_rows long, b_texts long").json(path)


@query(
    "SELECT CASE conv_id % 2 WHEN 0 THEN 'no_memory' ELSE 'input_rag' END AS condition, COUNT(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1",
)
def published_predictions(spark, sf):
    """Predictions written once beside their settings, and read back."""
    path = folder(spark, "run")
    rows = table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", F.col("text").alias("response_text"))
    P.publish(rows, path, P.settings("input_rag", "m", mode="dense", k=5))
    back = spark.read.schema("conv_id long, response_text string").json(path)
    return back.groupBy(F.when(F.col("conv_id") % 2 == 0, "no_memory").otherwise("input_rag").alias("condition")).agg(F.count("*").alias("n"))


# -- corpus files ----------------------------------------------------------------------


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, '# ' || r_name || chr(10) AS text, sha256('# ' || r_name || chr(10)) AS source_hash FROM region")
def markdown_files(spark, sf):
    """Whole files with the digest of their text, whatever their line ends."""
    path = folder(spark, "markdown")
    table(spark, sf, "region").select("r_regionkey", F.concat(F.lit("# "), "r_name", F.lit("\r")).alias("value")).write.partitionBy("r_regionkey").text(path)
    rows = corpus.markdown(spark, f"{path}/*")
    key = F.regexp_extract("path", "r_regionkey=([0-9]+)", 1).cast("long")
    return rows.select(key.alias("r_regionkey"), F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text"), "source_hash")


@query("""SELECT c_custkey AS id, c_name AS body, sha256('{"id":' || c_custkey || ',"body":"' || c_name || '"}' || chr(10)) AS source_hash FROM customer""")
def mail_lines(spark, sf):
    """Lines of mail with the digest of the raw line and its newline."""
    path = folder(spark, "mail")
    table(spark, sf, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"))).alias("value")).write.text(path)
    return corpus.lines(spark, path, "id long, body string")


@query("SELECT CAST(doc_id // 8 AS VARCHAR) AS slug, max_by(source, doc_id) AS mark FROM documents WHERE (doc_id // 8) % 5 <> 0 GROUP BY doc_id // 8")
def manifest_marks(spark, sf):
    """Artifacts by slug: the last wins, empty slugs go. A manifest for every eight documents."""
    n = F.floor(F.col("doc_id") / 8)
    item = F.struct("doc_id", F.when(n % 5 == 0, "").otherwise(n.cast("string")).alias("slug"), F.array("source").alias("perturbations"))
    rows = table(spark, sf, "documents").groupBy(n.alias("n")).agg(F.array_sort(F.collect_list(item)).alias("artifacts"))
    rows = rows.select(F.transform("artifacts", lambda a: F.struct(a["slug"].alias("slug"), a["perturbations"].alias("perturbations"))).alias("artifacts"))
    return corpus.manifest(rows).select("slug", F.col("perturbations")[0].alias("mark"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'poison' ELSE '' END AS marks FROM documents")
def page_perturbations(spark, sf):
    """Pages with what the manifest says of them, nothing where it says nothing."""
    pages = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("slug"))
    marks = pages.filter("doc_id % 3 = 0").select("slug", F.array(F.lit("poison")).alias("perturbations"))
    return corpus.with_perturbations(pages, marks).select("doc_id", F.array_join("perturbations", ",").alias("marks"))


@query(
    """SELECT c_custkey, '---' || chr(10) || 'id: "' || c_custkey || '"' || chr(10) || 'generated: true' || chr(10) || 'names: ["' || c_name || '", "b"]' || chr(10) || '---' || chr(10) || '# ' || c_name || chr(10) AS page FROM customer"""
)
def page_markdown(spark, sf):
    fields = {"id": F.col("c_custkey").cast("string"), "generated": F.lit(True), "names": F.array("c_name", F.lit("b"))}
    return table(spark, sf, "customer").select("c_custkey", corpus.page_markdown(fields, F.concat(F.lit("\n # "), "c_name", F.lit("  \n"))).alias("page"))


FRONT = ["plain text", "---\nid: 1\n---\nbody", "---\nx: 1\n---\nbody", "---\nnever closed", "---\nid : 3\n---\n"]
FRONT_OUT = ["---\nid: 9\n---\nplain text", "---\nid: 1\n---\nbody", "---\nid: 9\nx: 1\n---\nbody", "---\nnever closed", "---\nid : 3\n---\n"]


@query(f"SELECT c_custkey, {pick_sql(FRONT_OUT, 'c_custkey')} AS page FROM customer")
def frontmatter_upsert(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.upsert_frontmatter(pick(FRONT, F.col("c_custkey")), "id", F.lit("9")).alias("page"))


LINKED = [
    "attendees: user/ann, user/bo-b\nuser/c [x](user/dee) [y](docs/a/b)",
    "attendees : x user/ann\n[no](HTTP://x) [z](tools/t1)",
    "  attendees: user/ann\n[]( user/a)",
]
LINKED_OUT = [
    "attendees: people/ann, people/bo-b\nuser/c [x](people/dee) [y](source/a/b)",
    "attendees : x people/ann\n[no](HTTP://x) [z](concepts/t1)",
    "  attendees: user/ann\n[]( user/a)",
]


@query(f"SELECT c_custkey, {pick_sql(LINKED_OUT, 'c_custkey')} AS page FROM customer")
def link_rewrite(spark, sf):
    """Canonical collections in links, people on the attendees line, everything else as it was."""
    return table(spark, sf, "customer").select("c_custkey", T.rewrite_links(pick(LINKED, F.col("c_custkey"))).alias("page"))


@query(
    """WITH l AS (SELECT 'people/n' || (c_custkey % 50) AS slug, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) || ' Jr' END AS label FROM customer)
SELECT slug, min_by(label, (-length(label), lower(label), label)) AS title, COUNT(DISTINCT label) AS labels FROM l WHERE slug <> 'people/n7' GROUP BY slug"""
)
def entity_stubs(spark, sf):
    """Titles of linked entities without a page."""
    label = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.upper("c_name"), F.lit(" Jr")))
    text = F.concat(F.lit("see ["), label, F.lit("](user/n"), (F.col("c_custkey") % 50).cast("string"), F.lit(")"))
    pages = table(spark, sf, "customer").select(F.concat(F.lit("note/"), F.col("c_custkey").cast("string")).alias("slug"), text.alias("text"))
    pages = pages.unionByName(spark.range(1).select(F.lit("people/n7").alias("slug"), F.lit("").alias("text")))
    return corpus.entity_stubs(pages).select("slug", "title", F.size("labels").cast("long").alias("labels"))


NOTE = "Made from links."


FOLDER_LIST = ["doc", "meetings", "notes", "slack", "inbox", "calendar"]
N = "c_custkey::VARCHAR"
MARKED = "CASE WHEN c_custkey % 5 = 0 THEN 'perturbations: [\"poison\", \"old\"]' || chr(10) ELSE '' END"
OWN = "CASE WHEN c_custkey % 7 = 0 THEN 'perturbations: [\"stale\"]' || chr(10) || 'perturbation_fixture_id: ' || CASE WHEN c_custkey % 2 = 0 THEN '\"fx' || c_custkey || '\"' ELSE 'null' END || chr(10) ELSE MARKS END".replace("MARKS", MARKED)


def _item_sql(kind: str, folder: str, date: str, raw: str, own: str, body: str) -> str:
    return f"""SELECT '{folder}/' || {N} AS slug, '---' || chr(10) || 'id: "' || {N} || '"' || chr(10) || 'type: "{kind}"' || chr(10) || 'date: "' || {date} || '"' || chr(10) || 'source: "v1"' || chr(10)
  || 'source_item: "{folder}/' || {N} || '"' || chr(10) || 'source_sha256: "' || sha256({raw}) || '"' || chr(10) || {own} || '---' || chr(10) || {body} || chr(10) AS text"""


MAIL_RAW = """'{"id":"' || c_custkey || '","slug":"inbox/' || c_custkey || '","ts":"t' || c_custkey || '","thread_id":"th","subject":"About","body_text":"See [' || c_name || '](user/n' || (c_custkey % 9) || ')","from":{"name":"A","email":"a@x"},"to":[{"name":"B","email":"b@x"},{"name":"C","email":"c@x"}]' || PERTURBED || '}'"""
CHAT_RAW = """'{"id":"' || c_custkey || '","slug":"slack/' || c_custkey || '","ts":"t' || c_custkey || '","channel":"#ops","text":"Ask [' || c_name || '](user/n' || (c_custkey % 9) || ')","user":{"name":"A","handle":"aa"}' || PERTURBED || '}'"""
PERTURBED = """CASE WHEN c_custkey % 7 = 0 THEN ',"perturbation":{"kind":"stale"' || CASE WHEN c_custkey % 2 = 0 THEN ',"fixture_id":"fx' || c_custkey || '"' ELSE '' END || '}' ELSE '' END"""
EVENT_RAW = "'UID:' || c_custkey || '@x' || chr(10) || 'DTSTART:d' || c_custkey || chr(10) || 'DTEND;TZID=U:e' || chr(10) || CASE WHEN c_custkey % 4 = 1 THEN 'SUMMARY:Talk ' || c_name || chr(10) ELSE '' END || 'LOCATION:Room: 1'"
MAIL_RAW, CHAT_RAW = (x.replace("PERTURBED", PERTURBED) for x in (MAIL_RAW, CHAT_RAW))
LINK_OUT = "'[' || c_name || '](people/n' || (c_custkey % 9) || ')'"
OF = lambda folder: f"FROM customer WHERE c_custkey % 6 = {FOLDER_LIST.index(folder)}"


@query(
    f"""WITH f AS (SELECT c_custkey, {pick_sql(FOLDER_LIST, 'c_custkey')} AS folder, 'Hi [' || c_name || '](user/n' || (c_custkey % 9) || ')' AS body FROM customer),
p AS (SELECT c_custkey, folder, body, CASE WHEN folder = 'meetings' THEN '# Meet ' || c_custkey || chr(10) || body ELSE body END AS text FROM f WHERE folder IN ('doc', 'meetings', 'notes')),
m AS (SELECT [('doc', 'doc', 'source'), ('meetings', 'meeting', 'meeting'), ('notes', 'note', 'note')] AS t)
SELECT x[2] || '/' || c_custkey AS slug, '---' || chr(10) || CASE WHEN folder = 'meetings' THEN 'title: "Meet ' || c_custkey || '"' || chr(10) ELSE '' END || 'type: "' || x[3] || '"' || chr(10)
  || {MARKED} || 'source_sha256: "' || sha256(text) || '"' || chr(10) || 'source: "v1"' || chr(10) || '---' || chr(10) || replace(text, '](user/', '](people/') AS text
FROM p, (SELECT unnest(t) AS x FROM m) WHERE x[1] = folder
UNION ALL {_item_sql("email", "inbox", "'t' || c_custkey", MAIL_RAW + " || chr(10)", OWN, "'# About' || chr(10) || chr(10) || 'From: A <a@x>' || chr(10) || 'To: B <b@x>, C <c@x>' || chr(10) || 'Date: t' || c_custkey || chr(10) || 'Thread: th' || chr(10) || chr(10) || 'See ' || " + LINK_OUT)} {OF("inbox")}
UNION ALL {_item_sql("slack", "slack", "'t' || c_custkey", CHAT_RAW + " || chr(10)", OWN, "'# Slack message in #ops' || chr(10) || chr(10) || 'Author: A (@aa)' || chr(10) || 'Date: t' || c_custkey || chr(10) || chr(10) || 'Ask ' || " + LINK_OUT)} {OF("slack")}
UNION ALL {_item_sql("calendar-event", "calendar", "'d' || c_custkey", EVENT_RAW, MARKED, "'# ' || CASE WHEN c_custkey % 4 = 1 THEN 'Talk ' || c_name ELSE c_custkey::VARCHAR END || chr(10) || chr(10) || 'Start: d' || c_custkey || chr(10) || 'End: ' || chr(10) || 'Location: Room: 1'")} {OF("calendar")}
UNION ALL SELECT 'people/n' || k, '---' || chr(10) || 'id: "n' || k || '"' || chr(10) || 'type: "person"' || chr(10) || 'source: "v1"' || chr(10) || 'generated_stub: true' || chr(10) || 'aliases: ["' || names || '"]' || chr(10) || '---' || chr(10) || '# ' || first || chr(10) || chr(10) || '{NOTE}' || chr(10)
FROM (SELECT c_custkey % 9 AS k, string_agg(c_name, '", "' ORDER BY c_name) AS names, MIN(c_name) AS first FROM customer WHERE c_custkey % 6 <> 5 GROUP BY 1)"""
)
def normalized_corpus(spark, sf):
    """All six folders to pages: Markdown of three, mail and chat lines, calendar events; provenance, marks, types, titles, links; stubs of what they link to."""
    n, of = F.col("c_custkey"), F.col("folder")
    link = F.concat(F.lit("["), "c_name", F.lit("](user/n"), (n % 9).cast("string"), F.lit(")"))
    text = F.concat(F.lit("Hi "), link)
    rows = table(spark, sf, "customer").withColumn("folder", pick(FOLDER_LIST, n))
    text = F.when(of == "meetings", F.concat(F.lit("# Meet "), n.cast("string"), F.lit("\n"), text)).otherwise(text)
    files = rows.filter(of.isin(*corpus.FOLDERS)).select("folder", n.cast("string").alias("name"), text.alias("text"))
    heads = {k: v[0] for k, v in corpus.FOLDERS.items()} | {k: k for k in ("slack", "inbox", "calendar")}
    marks = rows.filter(n % 5 == 0).select(F.concat(T.mapped(of, heads), F.lit("/"), n.cast("string")).alias("slug"), F.array(F.lit("poison"), F.lit("old")).alias("perturbations"))
    path = folder(spark, "messages")
    for name, raw in (("inbox", MAIL_RAW), ("slack", CHAT_RAW)):
        rows.filter(of == name).select(F.expr(raw.replace("chr(10)", "'\\n'").replace("::VARCHAR", "")).alias("value")).write.text(f"{path}/{name}")
    events = rows.filter(of == "calendar").select(F.concat(F.lit("BEGIN:VCALENDAR\nBEGIN:VEVENT\n"), F.expr(EVENT_RAW.replace("chr(10)", "'\\n'")), F.lit("\nEND:VEVENT\nEND:VCALENDAR")).alias("text"))
    others = [
        corpus.mail_pages(corpus.lines(spark, f"{path}/inbox", corpus.MAIL), marks, "v1"),
        corpus.chat_pages(corpus.lines(spark, f"{path}/slack", corpus.CHAT), marks, "v1"),
        corpus.calendar_pages(events, marks, "v1"),
    ]
    return corpus.normalized_corpus(files, marks, "v1", NOTE, *others)


# -- the frozen index ---------------------------------------------------------------------


def _raw(spark, sf):
    """Raw pages, chunks and links as a live store would hold them."""
    n = F.col("doc_id")
    pages = table(spark, sf, "documents").select(
        n.alias("id"),
        F.lit("s").alias("source_id"),
        F.concat(F.lit("doc/"), n.cast("string")).alias("slug"),
        F.col("lang").alias("title"),
        F.when(n % 10 == 9, F.lit("gone")).alias("deleted_at"),
    )
    v = F.col("vec_id")
    chunks = table(spark, sf, "embeddings").select(
        v.alias("id"), (v - v % 2).alias("page_id"), (v % 2).cast("int").alias("chunk_index"), F.concat(F.lit("text "), v.cast("string")).alias("chunk_text"),
        F.when(v % 3 == 0, F.lit("llama-server:m")).otherwise("m").alias("model"), F.when(v % 5 == 0, F.lit("m:64")).alias("embedding_signature"), F.when(v % 7 == 0, "image").otherwise("text").alias("modality"),
        F.when(v % 11 != 0, F.col("embedding")).alias("embedding"),
    )
    links = table(spark, sf, "documents").select(
        n.alias("from_page_id"),
        F.floor(n / 2).alias("to_page_id"),
        F.when(n % 2 == 0, "mentions").alias("link_type"),
        F.lit(None).cast("string").alias("link_source"),
    )
    return pages, chunks, links


@query(
    """WITH p AS (SELECT doc_id AS id FROM documents WHERE doc_id % 10 <> 9)
SELECT 'page' AS kind, id::VARCHAR AS id, NULL AS other FROM p
UNION ALL SELECT 'chunk', vec_id::VARCHAR, (vec_id - vec_id % 2)::VARCHAR FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id - vec_id % 2 IN (SELECT id FROM p)
UNION ALL SELECT 'link', id::VARCHAR, (id // 2)::VARCHAR FROM p WHERE id // 2 IN (SELECT id FROM p)"""
)
def live_extract(spark, sf):
    """Pages not deleted, their text chunks that have a vector, links between them."""
    pages, chunks, links = index.live_extract(*_raw(spark, sf))
    rows = [
        pages.select(F.lit("page").alias("kind"), F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("other")),
        chunks.select(F.lit("chunk"), F.col("id").cast("string"), F.col("page_id").cast("string")),
        links.select(F.lit("link"), F.col("from_page_id").cast("string"), F.col("to_page_id").cast("string")),
    ]
    return rows[0].union(rows[1]).union(rows[2])


@query(
    "SELECT 's:doc/' || (vec_id - vec_id % 2) || ':' || (vec_id % 2) AS chunk_id, 's:doc/' || (vec_id - vec_id % 2) AS page_id, vec_id AS id FROM embeddings WHERE vec_id - vec_id % 2 IN (SELECT doc_id FROM documents)",
)
def stable_chunk_ids(spark, sf):
    pages, chunks, _ = _raw(spark, sf)
    return index.stable_chunks(chunks, index.stable_pages(pages)).select("chunk_id", "page_id", F.col("id"))


@query(
    "SELECT 's:doc/' || doc_id AS source_page_id, 's:doc/' || (doc_id // 2) AS target_page_id, CASE WHEN doc_id % 2 = 0 THEN 'mentions' ELSE '' END AS link_type FROM documents",
)
def stable_link_ids(spark, sf):
    pages, _, links = _raw(spark, sf)
    return index.stable_links(links, index.stable_pages(pages)).select("source_page_id", "target_page_id", "link_type")


@query(
    """WITH p AS (SELECT doc_id AS id FROM documents WHERE doc_id % 10 <> 9), c AS (SELECT vec_id, vec_id - vec_id % 2 AS page, CASE WHEN vec_id % 5 = 0 THEN 'm:64' END AS signature FROM embeddings)
SELECT vec_id::VARCHAR AS id, 'chunk references missing page' AS message FROM c WHERE page NOT IN (SELECT id FROM p)
UNION ALL SELECT vec_id::VARCHAR, 'unexpected embedding signature' FROM c WHERE signature IS NOT NULL AND 'm:64' <> 'x:64'
UNION ALL SELECT vec_id::VARCHAR, 'unexpected model' FROM c WHERE signature IS NULL
UNION ALL SELECT e.vec_id::VARCHAR, 'unexpected vector width' FROM embeddings e WHERE e.vec_id % 11 = 0 OR len(embedding) <> 64
UNION ALL SELECT doc_id::VARCHAR, 'link references a missing page' FROM documents WHERE doc_id NOT IN (SELECT id FROM p)
UNION ALL SELECT (doc_id // 2)::VARCHAR, 'link references a missing page' FROM documents WHERE doc_id // 2 NOT IN (SELECT id FROM p)"""
)
def export_issues(spark, sf):
    """What an export of another model's tables would be refused for."""
    pages, chunks, links = _raw(spark, sf)
    return index.export_issues(pages.filter("deleted_at is null"), chunks, links, "x", 64)


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'm' WHEN vec_id % 3 = 1 THEN 'x:m' ELSE 'm' END AS model FROM embeddings")
def model_names(spark, sf):
    """Server prefixes of model names are left out."""
    named = pick(["llama-server:m", "x:m", "sentence-transformers:m"], F.col("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id", index.canonical_model(named).alias("model"))


@query(
    "SELECT 's:' || vec_id || ':0' AS chunk_id, 's:' || vec_id AS page_id, vec_id::VARCHAR AS title, round(list_sum(embedding::DOUBLE[]), 6) AS total, (SELECT COUNT(*) FROM embeddings) AS n_chunks FROM embeddings",
)
def index_round_trip(spark, sf):
    """An index written once, read back and verified: its chunks with their pages, and the number that its manifest states."""
    v = F.col("vec_id").cast("string")
    page = F.concat(F.lit("s:"), v)
    rows = table(spark, sf, "embeddings")
    pages = rows.select(
        page.alias("page_id"),
        F.lit("s").alias("source_id"),
        v.alias("slug"),
        v.alias("title"),
        F.array().cast("array<string>").alias("perturbations"),
    )
    chunks = rows.select(
        F.concat(page, F.lit(":0")).alias("chunk_id"),
        page.alias("page_id"),
        F.lit(0).alias("chunk_index"),
        v.alias("text"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    links = rows.select(
        page.alias("source_page_id"),
        page.alias("target_page_id"),
        F.lit("").alias("link_type"),
        F.lit(None).cast("string").alias("provenance"),
    )
    path, width = folder(spark, "index"), rows.agg(F.max(F.size("embedding"))).first()[0]
    index.write_index(index.MemoryIndex(pages, chunks, links), path, "c", "m", width)
    back = index.read_index(spark, path, "m", width)
    total = F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6)
    rows = back.chunks.join(back.pages, "page_id").select("chunk_id", "page_id", "title", total.alias("total"))
    return rows.crossJoin(back.manifest.select(F.col("counts")["chunks"].alias("n_chunks")))  # one row


@query(
    """SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 13 = 1 THEN 'wrong vector width' WHEN vec_id % 13 = 2 THEN 'vector is not finite' END AS message FROM embeddings WHERE vec_id % 13 IN (1, 2)
UNION ALL SELECT vec_id::VARCHAR, 'chunk without page' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 17 <> 5)
UNION ALL SELECT doc_id::VARCHAR, 'page without chunk' FROM documents WHERE doc_id % 17 <> 5 AND doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT doc_id::VARCHAR, 'duplicate page id' FROM documents WHERE doc_id % 17 = 4
UNION ALL SELECT doc_id::VARCHAR, 'link from unknown page' FROM documents WHERE doc_id % 17 = 5
UNION ALL SELECT (doc_id // 2)::VARCHAR, 'link to unknown page' FROM documents WHERE (doc_id // 2) % 17 = 5
UNION ALL SELECT doc_id::VARCHAR, 'page without chunk' FROM documents WHERE doc_id % 17 = 4 AND doc_id NOT IN (SELECT vec_id FROM embeddings)"""
)
def index_issues(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"))
    pages = docs.filter("page_id % 17 <> 5")
    v = F.col("vec_id")
    broken = F.when(v % 13 == 1, F.slice("embedding", 1, 3)).when(
        v % 13 == 2,
        F.transform("embedding", lambda x: F.lit(float("inf")).cast("float")),
    ).otherwise(F.col("embedding"))
    chunks = table(spark, sf, "embeddings").select(v.alias("chunk_id"), v.alias("page_id"), broken.alias("embedding"))
    links = docs.select(F.col("page_id").alias("source_page_id"), F.floor(F.col("page_id") / 2).alias("target_page_id"))
    return validate.index_issues(pages.unionByName(pages.filter("page_id % 17 = 4")), chunks, links, 64)


@query(
    "SELECT vec_id, len(embedding) AS width, round(embedding[1]::DOUBLE, 4) AS first, vec_id % 4 = 3 AS broken FROM embeddings WHERE vec_id % 4 <> 3 UNION ALL SELECT vec_id, NULL, NULL, true FROM embeddings WHERE vec_id % 4 = 3",
)
def vector_parse(spark, sf):
    """Vectors from text in either bracket; null where a part is no finite number."""
    n = F.col("vec_id") % 4
    inner = F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", ")
    said = F.when(n == 0, F.concat(F.lit("["), inner, F.lit("]"))).when(n == 1, F.concat(F.lit("("), inner, F.lit(")"))).when(n == 2, inner).otherwise(
        F.concat(F.lit("[NaN, "), inner, F.lit("]")),
    )
    rows = table(spark, sf, "embeddings").select("vec_id", T.parse_vector(said).alias("v"))
    return rows.select(
        "vec_id",
        F.when(F.col("v").isNotNull(), F.size("v")).cast("long").alias("width"),
        F.round(F.col("v")[0], 4).alias("first"),
        F.col("v").isNull().alias("broken"),
    )


# -- caches -------------------------------------------------------------------------------


@query("SELECT page_id FROM pages WHERE page_id % 9 = 0")
def cache_tampered(spark, sf):
    """Entries whose key is not the digest of what they say."""
    key = F.sha2(F.coalesce("url", F.lit("")), 256)
    cache = table(spark, sf, "pages").withColumn("key", F.when(F.col("page_id") % 9 == 0, "0").otherwise(key))
    return caches.tampered(cache, "key", key).select("page_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'made' END AS answer FROM documents")
def cache_populate(spark, sf):
    """Misses answered once and appended."""
    asked = table(spark, sf, "documents").select("doc_id")
    path = folder(spark, "cache")
    asked.filter("doc_id % 2 = 0").withColumn("answer", F.lit("kept")).write.parquet(path)
    cache = spark.read.schema("doc_id long, answer string").parquet(path)
    return caches.populate(
        asked.select(F.col("doc_id").cast("long").alias("doc_id")),
        cache,
        "doc_id",
        lambda lost: lost.withColumn("answer", F.lit("made")),
        path,
    )


def merkle_sql(rows: str, depth: int = 3) -> str:
    """CTEs n{depth} (leaves: range, n, digest) to n0 (the root) of a SELECT of (k, v)."""
    hashed = f"SELECT substr(sha256(k), 1, {depth}) AS range, sha256(sha256(k) || ':' || sha256(v)) AS h FROM ({rows})"
    sums = ", ".join(f"SUM(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR AS s{i}" for i in range(4))
    ctes = [f"n{depth} AS (SELECT range, n, sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS digest FROM (SELECT range, COUNT(*) AS n, {sums} FROM ({hashed}) GROUP BY range))"]
    for d in range(depth - 1, -1, -1):
        ctes.append(f"n{d} AS (SELECT substr(range, 1, {d}) AS range, SUM(n)::BIGINT AS n, sha256(string_agg(range || ':' || digest, chr(10) ORDER BY range)) AS digest FROM n{d + 1} GROUP BY 1)")
    return ", ".join(ctes)


USED = "SELECT page_id::VARCHAR AS k, coalesce(url, '') AS v FROM pages WHERE page_id % 3 = 0"


@query(f"WITH {merkle_sql(USED)} SELECT digest, n AS entries FROM n0")
def cache_used_digest(spark, sf):
    used = table(spark, sf, "pages").filter("page_id % 3 = 0").select(F.col("page_id").cast("string").alias("n"), F.coalesce("url", F.lit("")).alias("url"))
    return caches.used_digest(used, "n", "url")


@query(f"WITH {merkle_sql('SELECT page_id::VARCHAR AS k, html AS v FROM pages')} SELECT * FROM n3 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n0")
def page_digest_tree(spark, sf):
    """Digests of all pages by ranges of their ids' hashes, up to one."""
    return merkle.tree(table(spark, sf, "pages"), "page_id", "html")


@query("SELECT DISTINCT substr(sha256(page_id::VARCHAR), 1, 3) AS range FROM pages WHERE page_id % 50 IN (7, 8)")
def changed_ranges(spark, sf):
    """Ranges in which two states of the pages differ: some changed, some gone."""
    pages = table(spark, sf, "pages")
    now = pages.filter("page_id % 50 <> 8").withColumn("html", F.when(F.col("page_id") % 50 == 7, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    return merkle.changed(merkle.tree(pages, "page_id", "html"), merkle.tree(now, "page_id", "html"))


EXPANDED = [("a", "b", "c"), ("a", "b", "B "), ("a", " ", "c"), ("Query  One", "b", "c"), ("query", "one", "query two")]


@query(f"SELECT doc_id, {pick_sql(['yes', 'no', 'no', 'no', 'yes'], 'doc_id')} = 'yes' AS valid FROM documents")
def expansion_validity(spark, sf):
    """Three alternatives, unlike each other and the query after normalisation."""
    lists = F.array(*[F.array(*[F.lit(x) for x in e]) for e in EXPANDED])
    return table(spark, sf, "documents").select(
        "doc_id",
        caches.valid_expansions(F.element_at(lists, (F.col("doc_id") % 5 + 1).cast("int")), F.lit("query one")).alias("valid"),
    )


# -- small functions --------------------------------------------------------------------------


@query("SELECT doc_id, sha256(replace(text, chr(10), chr(10))) AS digest FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(13))")
def lf_digest(spark, sf):
    """Either line end gives one digest."""
    crlf = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").filter("text is not null and not contains(text, '\r')").select("doc_id", T.lf_sha256(crlf).alias("digest"))


@query(f"SELECT doc_id, {pick_sql(['note/', 'meeting/', 'x/notes/', 'doc/'], 'doc_id')} || doc_id AS id FROM documents")
def source_ids(spark, sf):
    raw = F.concat(pick(["notes/", "meetings/", "x/notes/", "doc/"], F.col("doc_id")), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", T.canonical_source_id(raw).alias("id"))


CASE_IDS = ["set-one-ai-plan", "set-gpu-budget", "other-ai-x"]
VARIANTS = ["positive", "memory-included", "cue-ablated"]
SUBJECTS, SHOWN = ["AI Plan", "Gpu Budget", "Other AI X"], ["Cue present", "Memory included", "Cue ablated"]


@query(f"SELECT doc_id, {pick_sql(SUBJECTS, 'doc_id')} || ' — ' || {pick_sql(SHOWN, 'doc_id // 3')} AS label FROM documents")
def case_labels(spark, sf):
    n = F.col("doc_id")
    label = T.case_label(pick(CASE_IDS, n), pick(VARIANTS, F.floor(n / 3)), ("set-one-", "set-"))
    return table(spark, sf, "documents").select("doc_id", label.alias("label"))


@query(
    f"SELECT doc_id, {pick_sql(['tool_output_only', 'model_output_only', 'a-b'], 'doc_id')} AS flow, {pick_sql(['dense', 'hybrid'], 'doc_id')} AS mode FROM documents",
)
def run_names(spark, sf):
    n = F.col("doc_id")
    file = F.concat(F.lit("runs/naive-"), pick(["tool_output_only", "model_output_only", "a-b"], n), F.lit("-"), pick(["dense", "hybrid"], n), F.lit(".jsonl"))
    return table(spark, sf, "documents").select("doc_id", T.run_name(file, "naive-").alias("r")).select("doc_id", "r.flow", "r.mode")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'input_tokens=5,output_tokens=' || doc_id WHEN doc_id % 3 = 1 THEN 'output_tokens=' || doc_id ELSE '' END AS known FROM documents",
)
def usage_flatten(spark, sf):
    """The counts that are known, as a map."""
    n = F.col("doc_id")
    nothing = F.lit(None).cast("long")
    usage = F.struct(F.when(n % 3 == 0, 5).alias("input_tokens"), F.when(n % 3 != 2, n).alias("output_tokens"), nothing.alias("total_tokens"))
    entries = F.transform(F.map_entries(T.usage_fields(F.col("usage"))), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    rows = table(spark, sf, "documents").select("doc_id", F.when(n % 6 != 5, usage).alias("usage"))
    return rows.select("doc_id", F.array_join(F.array_sort(entries), ",").alias("known"))


@query(
    """SELECT c_custkey, list_aggregate(list_sort(CASE c_custkey % 3 WHEN 0 THEN [c_name, 'ann lee'] WHEN 1 THEN [c_name] ELSE ['ann lee'] END), 'string_agg', '|') AS surfaces FROM customer"""
)
def title_slug_surfaces(spark, sf):
    """The title, and the slug's tail where it says something else."""
    n = F.col("c_custkey") % 3
    title = F.when(n == 2, "ann lee").otherwise(F.col("c_name"))
    slug = F.when(n == 1, F.concat(F.lit("x/"), "c_name")).otherwise("people/ann-lee")
    slug = F.when(n == 1, F.concat(F.lit("x/"), F.translate("c_name", "#", "#"))).otherwise(slug)
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.array_sort(T.title_slug_surfaces(title, slug)), "|").alias("surfaces"))


PHRASES = ["Next Steps", "Alpha", "alpha beta", "alpha Beta", "plan 9", "a b c d e f g", "Market Report", "Ébène tree"]


@query(f"SELECT doc_id, {pick_sql(['no', 'no', 'no', 'yes', 'yes', 'no', 'no', 'yes'], 'doc_id')} = 'yes' AS kept FROM documents")
def body_surface_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.keep_body_surface(pick(PHRASES, F.col("doc_id"))).alias("kept"))


LISTS = ["Session A. more\nno\nItem 5 — x", "Sessions\nBrief b.c", "", " Item 3\r\nResult r"]
LISTS_OUT = ["Session A|Item 5 — x", "Brief b", "", "Result r"]


@query(f"SELECT doc_id, {pick_sql(LISTS_OUT, 'doc_id')} AS labels FROM documents")
def listing_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.listing_labels(pick(LISTS, F.col("doc_id"))), "|").alias("labels"))


@query(
    f"SELECT conv_id, turn, {cf('text')} LIKE '%the%' AND NOT {cf('text')} LIKE '%and%' AS positive, {cf('text')} LIKE '%and%' AS control FROM conversations WHERE text IS NOT NULL",
)
def coarse_correctness(spark, sf):
    """Plain containment of the choices, for positive cases and controls."""
    rows = table(spark, sf, "conversations").filter("text is not null")
    return rows.select(
        "conv_id",
        "turn",
        *[T.coarse_correct(F.col("text"), F.lit("AND"), F.lit("the"), F.lit(control)).alias(name) for name, control in (("positive", False), ("control", True))],
    )


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def body_concat(spark, sf):
    """Chunk texts of a page joined in index order."""
    chunks = table(spark, sf, "conversations").filter("text is not null").select(
        F.col("conv_id").alias("page_id"),
        F.col("turn").alias("chunk_index"),
        F.concat_ws(":", "conv_id", "turn").alias("chunk_id"),
        "text",
    )
    return entities.bodies(chunks).select(F.col("page_id").alias("conv_id"), "body")


@query(
    "SELECT surface, COUNT(DISTINCT id) AS n, MIN(id) AS first FROM (SELECT lower(c_mktsegment) AS surface, c_custkey AS id FROM customer UNION ALL SELECT 'seg ' || (c_custkey % 20), c_custkey FROM customer) GROUP BY surface",
)
def surface_pages(spark, sf):
    """Pages by normalised surface of title and slug."""
    pages = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("page_id"),
        F.col("c_mktsegment").alias("title"),
        F.concat(F.lit("x/Seg-"), (F.col("c_custkey") % 20).cast("string")).alias("slug"),
    )
    return entities.surfaces(pages).select("surface", F.size("page_ids").cast("long").alias("n"), F.col("page_ids")[0].alias("first"))


@query(
    "SELECT o_custkey AS query_id, o_orderpriority AS source_id, MAX(o_totalprice)::DOUBLE AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY MAX(o_totalprice) DESC, o_orderpriority) AS rank FROM orders GROUP BY 1, 2 QUALIFY rank <= 3",
)
def max_merge_windows(spark, sf):
    """The best score of each source over the windows of a query."""
    hits = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"),
        F.col("o_orderpriority").alias("source_id"),
        F.col("o_orderkey").alias("window"),
        F.col("o_totalprice").cast("double").alias("score"),
    )
    return R.max_merge(hits, 3).select("query_id", "source_id", "score", "rank")


@query(
    "SELECT doc_id, CASE WHEN length(text) > 8000 THEN (length(text) + 5999) // 6000 ELSE 1 END AS windows, CASE WHEN length(text) > 8000 THEN substr(text, 6001, 6000) END AS second FROM documents WHERE text IS NOT NULL",
)
def character_windows(spark, sf):
    rows = table(spark, sf, "documents").filter("text is not null").select("doc_id", R.text_windows(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("windows"), F.try_element_at("w", F.lit(2)).alias("second"))


STRIDE_POOL = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]


@query(
    f"""WITH g AS (SELECT c_custkey AS i FROM customer), w AS (SELECT i, {pick_sql(STRIDE_POOL, 'i * 3')} AS a, {pick_sql(STRIDE_POOL, 'i * 5 + 1')} AS b FROM g)
SELECT i, CASE WHEN i = 147 THEN 'Item 147 — The cue row. It says so' WHEN i >= 18 AND (i - 18) % 22 = 0 THEN 'Item ' || i || ' — Decoy ' || a || '. ' || b ELSE 'Item ' || i || ' — ' || a || ' ' || b || '. ' || a END AS line FROM w"""
)
def listing_generator(spark, sf):
    """A listing, a line for each customer, by strides through a pool, with decoys and one cue row."""
    i = F.col("c_custkey")
    a, b = pick(STRIDE_POOL, i * 3), pick(STRIDE_POOL, i * 5 + 1)
    head = F.concat(F.lit("Item "), i.cast("string"), F.lit(" — "))
    line = F.when(i == 147, "Item 147 — The cue row. It says so").when((i >= 18) & ((i - 18) % 22 == 0), F.concat(head, F.lit("Decoy "), a, F.lit(". "), b)).otherwise(
        F.concat(head, a, F.lit(" "), b, F.lit(". "), a),
    )
    return table(spark, sf, "customer").select(i.alias("i"), line.alias("line"))


# -- case rules --------------------------------------------------------------------------------

WORDS_SQL = toks("text")


def _case_rows(spark, sf):
    """One valid case in three variants for each customer, one rule broken in some: by key % RULES."""
    n = F.col("c_custkey")
    base = spread(table(spark, sf, "customer").select(n)).select(
        n,
        F.concat(F.lit("b"), n.cast("string")).alias("base_case_id"),
        F.explode(F.array(*[F.lit(v) for v in VARIANTS])).alias("role"),
    )
    k = n % RULES
    hit, control, injected = (F.col("role") == v for v in ("positive", "cue-ablated", "memory-included"))
    broken = lambda number, where=hit: where & (k == number)
    cue = "the cue here"
    listing = "\n".join(f"Item {i}. Choice{i}" for i in range(26))
    text = F.when(broken(1), listing.replace("Item 24", "Entry 24").replace("Item 25", "Entry 25")).when(broken(2), listing.replace("Item 25", "Item 24")).otherwise(listing)
    text = F.concat(text, F.lit("\nRed plan once. Blue plan once."))
    text = F.when(broken(3), F.concat(text, F.lit(" Red plan twice."))).when(broken(27), F.concat(text, F.lit(" Blue plan twice."))).otherwise(text)
    text = F.when(broken(16), F.concat(text, F.repeat(F.lit(" word"), F.lit(40)))).otherwise(text)
    text = F.when((control & (k != 24)) | broken(4), text).otherwise(F.concat(text, F.lit(f" {cue}")))
    prompt = F.when(broken(5), "Choose one.").when(broken(6), f"Choose exactly one, {cue}.").when(
        injected & (k != 17),
        "Choose exactly one. Memory prose",
    ).otherwise("Choose exactly one.")
    other = F.when((control & (k != 18)) | broken(7), "Red plan").when(broken(25), " ").otherwise("Blue plan")
    source = F.struct(
        F.when(broken(8), "x").when(broken(20), "note/a").otherwise("notes/a").alias("source_id"),
        F.when(broken(19), "notes/z.md").otherwise("notes/a.md").alias("path"),
        F.when(broken(9), "h2").otherwise("h").alias("sha256"),
        F.when(broken(10), F.array(F.lit("poison"))).otherwise(F.array().cast("array<string>")).alias("perturbations"),
    )
    distractors = F.array(
        *[F.struct(F.lit(str(i)).alias("source_id"), F.lit("t").alias("text"), F.array().cast("array<string>").alias("perturbations")) for i in range(3)],
    )
    fields = F.array(*[F.lit(f) for f in validate.REQUIRED_FIELDS])
    variant = F.when(broken(22), "odd").otherwise(F.col("role"))
    rows = base.filter(~broken(28, injected)).withColumn("copies", F.explode(F.sequence(F.lit(1), F.when(broken(21), 2).otherwise(1))))
    return rows.select(
        F.concat_ws(":", "base_case_id", "role").alias("case_id"), "base_case_id", variant.alias("variant"), prompt.alias("prompt"),
        F.struct(F.when(broken(11), "odd").otherwise("tool_result").alias("kind")).alias("observation"),
        F.struct(F.when(broken(12) | broken(22), False).otherwise(~control).alias("present"), F.lit(cue).alias("text")).alias("cue"),
        F.struct(
            F.when(broken(13), "").otherwise("memory prose").alias("text"),
            F.array(F.when(broken(20), "note/a").otherwise("notes/a")).alias("gold_source_ids"),
            F.array(source).cast(f"array<{SOURCE}>").alias("sources"),
        ).alias("memory"),
        F.struct(
            F.when(broken(14), "number").otherwise("natural_language_choice").alias("answer_type"),
            F.struct(F.when(broken(26), "").otherwise("Red plan").alias("choice")).alias("output_only"),
            F.struct(other.alias("choice")).alias("memory_conditioned"),
        ).alias("decisions"),
        F.struct(F.when(broken(15), F.slice(distractors, 1, 2)).otherwise(distractors).alias("sources")).alias("distractors"), text.alias("observation_text"),
        F.when(broken(23), F.array_remove(fields, "provenance")).when(broken(23, injected), F.array_remove(fields, "cue")).otherwise(fields).alias("fields"),
    )


#: key % RULES -> what is found: (the end of the id, message)
RULES = 29
BROKEN = {
    1: [(":positive", "too few visible choices")],
    2: [(":positive", "visible labels must be unique")],
    3: [(":positive", "output-only choice must appear exactly once")],
    4: [(":positive", "gold cue is absent from observation")],
    5: [(":positive", "prompt must request exactly one choice")],
    6: [(":positive", "cue leaks into prompt")],
    7: [(":positive", "decision does not change")],
    8: [(":positive", "gold source ids and sources disagree")],
    9: [(":positive", "source hash mismatch")],
    10: [(":positive", "poison source cannot be gold")],
    11: [(":positive", "invalid observation.kind")],
    12: [(":positive", "cue.present disagrees with variant")],
    13: [(":positive", "memory text must be readable prose")],
    14: [(":positive", "answer_type must be natural_language_choice")],
    15: [(":positive", "too few distractors")],
    16: [(":positive", "observation length out of bounds")],
    17: [(":memory-included", "prompt must contain the injected memory")],
    18: [(":cue-ablated", "control changes decision")],
    19: [(":positive", "missing memory source")],
    20: [(":positive", "source id prefix differs from corpus folder")],
    21: [(":positive", "duplicate case_id")],
    22: [(":positive", "invalid variant"), ("", "must contain positive, cue-ablated, and memory-included variants")],
    23: [(":positive", "missing required field ''provenance''"), (":memory-included", "missing required field ''cue''")],
    24: [(":cue-ablated", "ablated observation still contains cue")],
    25: [(":positive", "memory-conditioned choice must be natural language")],
    26: [(":positive", "output-only choice must be natural language")],
    27: [(":positive", "memory-conditioned choice must appear exactly once")],
    28: [("", "must contain positive, cue-ablated, and memory-included variants")],
}
BROKEN_SQL = ", ".join(f"({k}, '{e}', '{m}')" for k, found in BROKEN.items() for e, m in found)


@query(f"SELECT 'b' || c_custkey || e AS id, m AS message FROM customer JOIN (VALUES {BROKEN_SQL}) AS r(k, e, m) ON c_custkey % {RULES} = k")
def case_rules(spark, sf):
    """Every rule on cases that break it, and nothing else found. A word counts as a hundred tokens."""
    files = spark.range(1).select(F.lit("notes/a.md").alias("path"), F.lit("h").alias("sha256"))
    return validate.case_issues(_case_rows(spark, sf), files, token_count=lambda t: 100 * F.size(T.tokens(t)))


# -- admission ---------------------------------------------------------------------------------


def _order_hits(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"),
        (F.col("o_orderkey") % 23).alias("page_id"),
        F.col("o_orderkey").alias("rank"),
    )


@query(
    """WITH h AS (SELECT o_custkey AS c, o_orderkey % 23 AS p, o_orderkey AS r FROM orders), a AS (SELECT DISTINCT c, p FROM h WHERE c % 4 <> 0 AND p < 9),
k AS (SELECT h.c, h.p, MIN(h.r) AS r FROM h WHERE h.c NOT IN (SELECT c FROM a) OR (h.c, h.p) IN (SELECT c, p FROM a) GROUP BY 1, 2)
SELECT c AS case_id, p AS page_id, r AS rank, row_number() OVER (PARTITION BY c ORDER BY r) AS new_rank FROM k"""
)
def admitted_only(spark, sf):
    """Merged hits, admitted ones only; a case for which nothing was admitted keeps all."""
    hits = _order_hits(spark, sf)
    admitted = hits.filter("case_id % 4 <> 0 and page_id < 9")
    return dedupe.admitted_only(hits, admitted, "case_id", "page_id", ["rank"]).select("case_id", "page_id", "rank", "new_rank")


@query(
    """WITH h AS (SELECT o_custkey AS c, o_orderkey % 23 AS p, o_orderkey AS r FROM orders)
SELECT c AS case_id, p AS page_id, r AS rank, row_number() OVER (PARTITION BY c ORDER BY list_position([7, 3, 11], p), r) AS new_rank FROM h WHERE p IN (7, 3, 11)"""
)
def admitted_order(spark, sf):
    """Hits in the order in which their pages were admitted."""
    hits = _order_hits(spark, sf)
    admitted = hits.select("case_id").distinct().withColumn("items", F.array(*[F.lit(x).cast("long") for x in (7, 3, 11)]))
    return dedupe.in_admitted_order(hits, admitted, "case_id", "page_id").select("case_id", "page_id", "rank", "new_rank")
