"""Corpus files to pages: Markdown, mail and chat lines, calendars, entity stubs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def manifest(artifacts: DataFrame) -> DataFrame:
    """artifacts array of (slug, perturbations); the last of a slug wins, empty slugs go."""
    rows = artifacts.select(F.posexplode("artifacts").alias("at", "a")).filter("a is not null and coalesce(a.slug, '') <> ''")
    return rows.groupBy("a.slug").agg(F.max_by("a.perturbations", "at").alias("perturbations"))


def with_perturbations(pages: DataFrame, marks: DataFrame) -> DataFrame:
    return pages.join(marks, "slug", "left").withColumn("perturbations", F.coalesce("perturbations", F.array().cast("array<string>")))


def markdown(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text, source_hash) of whole files."""
    rows = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("source_hash", T.lf_sha256(F.col("text")))


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Mail or chat lines with a hash of the raw line and its newline."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    return raw.select(F.from_json("value", schema).alias("r"), F.sha2(F.concat("value", F.lit("\n")), 256).alias("source_hash")).select("r.*", "source_hash")


def calendar_events(calendars: DataFrame, text: str = "text") -> DataFrame:
    """One row a VEVENT: uid (cut at @), and the first value of the usual keys; attendees as an array."""
    unfolded = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n[ \t]", "")
    blocks = calendars.select(F.explode(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)\nEND:VEVENT"), F.lit(1))).alias("block"))
    pairs = F.transform(
        F.filter(F.split("block", "\n"), lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.substring(x, F.instr(x, ":") + 1, F.length(x)).alias("v")),
    )
    rows = blocks.withColumn("pairs", pairs)

    def values(name: str) -> Column:
        return F.transform(F.filter("pairs", lambda p: (p["k"] == name) | p["k"].startswith(f"{name};")), lambda p: p["v"])

    def first(name: str) -> Column:
        return F.try_element_at(values(name), F.lit(1))

    return rows.select(
        F.substring_index(first("UID"), "@", 1).alias("uid"), first("SUMMARY").alias("summary"), first("DTSTART").alias("starts"), first("DTEND").alias("ends"), first("LOCATION").alias("location"), values("ATTENDEE").alias("attendees")
    )


def page_markdown(fields: dict[str, Column], body: Column) -> Column:
    """Frontmatter with JSON values, then the stripped body. Strings are encoded; arrays and booleans too."""
    from ..operators.caches import json_string

    def encoded(value: Column) -> Column:
        plain = F.typeof(value) == "string"
        other = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', "$1")
        return F.when(plain, json_string(value.cast("string"), ascii_only=False)).otherwise(F.regexp_replace(other, '","', '", "'))

    head = [F.concat(F.lit(f"{name}: "), encoded(value)) for name, value in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *head, F.lit("---"), F.regexp_replace(body, r"(?U)^\s+|\s+$", ""), F.lit(""))


def entity_labels(pages: DataFrame) -> DataFrame:
    """(slug, title, labels) of all link targets: the longest label, then case-folded order, is the title."""
    links = pages.select(F.explode(T.markdown_links(F.col("text"))).alias("l")).select(
        T.canonical_slug(F.col("l.slug")).alias("slug"),
        F.trim("l.label").alias("label"),
    )
    by_case = F.array_sort(F.collect_set(F.struct(T.casefold(F.col("label")).alias("f"), "label")))
    return links.groupBy("slug").agg(
        F.min(F.struct(-F.length("label"), T.casefold(F.col("label")), "label"))["label"].alias("title"),
        F.transform(by_case, lambda x: x["label"]).alias("labels"),
    )


def entity_stubs(pages: DataFrame) -> DataFrame:
    """Link targets without a page: slug, title and all labels."""
    return entity_labels(pages.select("slug", "text")).join(pages.select("slug").distinct(), "slug", "left_anti")


def stub_pages(labels: DataFrame, version: str, note: str) -> DataFrame:
    """(slug, text) of generated entity pages; collections without a page type have none."""
    typed = labels.withColumn("type", T.mapped(F.substring_index("slug", "/", 1), T.SLUG_TYPES)).filter("type is not null")
    tail = F.substring(F.col("slug"), F.instr("slug", "/") + 1, F.length("slug"))
    fields = {"id": tail, "type": F.col("type"), "source": F.lit(version), "generated_stub": F.lit(True), "aliases": F.col("labels")}
    return typed.select("slug", page_markdown(fields, F.concat(F.lit("# "), "title", F.lit("\n\n"), F.lit(note))).alias("text"))


#: Folders of Markdown pages, the collection of their slugs, and their page type.
FOLDERS = {"doc": ("doc", "source"), "meetings": ("meeting", "meeting"), "notes": ("note", "note")}


def normalized_pages(files: DataFrame, marks: DataFrame, version: str) -> DataFrame:
    """files: (folder, name without suffix, text). (slug, text) with provenance, perturbations, type,
    meeting titles, canonical links and attendees."""
    collections = {k: v[0] for k, v in FOLDERS.items()}
    types = {k: v[1] for k, v in FOLDERS.items()}
    rows = files.withColumn("slug", F.concat(T.mapped(F.col("folder"), collections), F.lit("/"), "name")).filter("slug is not null")
    rows = rows.join(marks, "slug", "left")
    listed = F.regexp_replace(F.to_json("perturbations"), '","', '", "')
    text = T.upsert_frontmatter(F.col("text"), "source", F.lit(f'"{version}"'))
    text = T.upsert_frontmatter(text, "source_sha256", F.concat(F.lit('"'), T.lf_sha256(F.col("text")), F.lit('"')))
    rows = rows.withColumn("made", text)
    rows = rows.withColumn("made", F.when(F.size("perturbations") > 0, T.upsert_frontmatter(F.col("made"), "perturbations", listed)).otherwise(F.col("made")))
    rows = rows.withColumn("made", T.upsert_frontmatter(F.col("made"), "type", F.concat(F.lit('"'), T.mapped(F.col("folder"), types), F.lit('"'))))
    heading = F.trim(F.regexp_extract("made", r"(?m)^#\s+(.+)$", 1))
    titled = (F.col("folder") == "meetings") & (heading != "")
    rows = rows.withColumn(
        "made",
        F.when(
            titled,
            T.upsert_frontmatter(F.col("made"), "title", F.to_json(F.array(heading)).substr(F.lit(2), F.length(F.to_json(F.array(heading))) - 2)),
        ).otherwise(F.col("made")),
    )
    return rows.select("slug", T.rewrite_links(F.col("made")).alias("text"))


# What messages hold.
PERTURBATION = "perturbation struct<kind:string,fixture_id:string>"
MAIL = f"id string, slug string, ts string, thread_id string, subject string, body_text string, `from` struct<name:string,email:string>, `to` array<struct<name:string,email:string>>, {PERTURBATION}"
CHAT = f"id string, slug string, ts string, channel string, text string, user struct<name:string,handle:string>, {PERTURBATION}"


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows (slug, and perhaps perturbation) with perturbations, a message's own before those of the manifest, and its fixture."""
    met = rows.join(marks.select("slug", F.col("perturbations").alias("listed")), "slug", "left")
    if "perturbation" not in rows.columns:
        return met.withColumn("perturbations", F.col("listed")).withColumn("own", F.lit(False)).withColumn("fixture", F.lit(None).cast("string"))
    met = met.withColumn("own", F.col("perturbation").isNotNull())
    met = met.withColumn("perturbations", F.when(F.col("own"), F.array("perturbation.kind")).otherwise(F.col("listed")))
    return met.withColumn("fixture", F.col("perturbation.fixture_id"))


def _item_pages(rows: DataFrame, marks: DataFrame, version: str, kind: str, body: Column) -> DataFrame:
    """(slug, text) of rows with id, date, slug and source_hash."""
    from ..operators.caches import json_string

    fields = {"id": F.col("id"), "type": F.lit(kind), "date": F.col("date"), "source": F.lit(version), "source_item": F.col("slug"), "source_sha256": F.col("source_hash")}
    listed = F.concat(F.lit("\nperturbations: "), F.regexp_replace(F.to_json("perturbations"), '","', '", "'))
    fixture = F.concat(F.lit("\nperturbation_fixture_id: "), F.when(F.col("fixture").isNull(), "null").otherwise(json_string(F.col("fixture"), ascii_only=False)))
    more = F.concat(F.when(F.size("perturbations") > 0, listed).otherwise(""), F.when(F.col("own"), fixture).otherwise(""))
    page = page_markdown(fields, body)
    # What is marked stands behind the last of the fields.
    last = F.concat(F.lit('\nsource_sha256: "'), "source_hash", F.lit('"'))
    at = F.instr(page, last) + F.length(last)
    made = F.concat(F.substring(page, F.lit(1), at - 1), more, F.substring(page, at, F.length(page)))
    return _marked(rows, marks).select("slug", made.alias("text"))


def mail_pages(mails: DataFrame, marks: DataFrame, version: str) -> DataFrame:
    """Messages of MAIL with source_hash -> (slug, text): headers as lines, then the body."""
    address = lambda p: F.concat(p["name"], F.lit(" <"), p["email"], F.lit(">"))
    people = F.array_join(F.transform("to", address), ", ")
    body = F.concat(
        F.lit("# "), "subject", F.lit("\n\nFrom: "), address(F.col("from")), F.lit("\nTo: "), people, F.lit("\nDate: "), "ts", F.lit("\nThread: "), "thread_id", F.lit("\n\n"), "body_text"
    )
    return _item_pages(mails.withColumn("date", F.col("ts")), marks, version, "email", body)


def chat_pages(messages: DataFrame, marks: DataFrame, version: str) -> DataFrame:
    """Messages of CHAT with source_hash -> (slug, text)."""
    author = F.concat(F.col("user.name"), F.lit(" (@"), F.col("user.handle"), F.lit(")"))
    body = F.concat(F.lit("# Slack message in "), "channel", F.lit("\n\nAuthor: "), author, F.lit("\nDate: "), "ts", F.lit("\n\n"), "text")
    return _item_pages(messages.withColumn("date", F.col("ts")), marks, version, "slack", body)


def calendar_pages(calendars: DataFrame, marks: DataFrame, version: str, text: str = "text") -> DataFrame:
    """Calendar files -> (slug, text), a page an event: its uid up to the @, its summary (else the uid), times and place.

    Folded lines are joined; a key with parameters is another key; the hash is that of the event's lines; an event without a uid has no page.
    """
    unfolded = F.regexp_replace(F.col(text), "\r?\n[ \t]", "")
    blocks = calendars.select(F.explode(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)\r?\nEND:VEVENT"), F.lit(1))).alias("block"))
    value = lambda x: F.when(F.contains(x, F.lit(":")), F.substring(x, F.instr(x, ":") + 1, F.length(x))).otherwise("")
    pairs = F.transform(F.split("block", "\r\n|\n|\r"), lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), value(x).alias("v")))
    rows = blocks.withColumn("pairs", pairs)

    def first(name: str) -> Column:
        return F.try_element_at(F.filter("pairs", lambda p: p["k"] == name), F.lit(1))["v"]

    rows = rows.withColumn("id", F.substring_index(first("UID"), "@", 1)).filter("id is not null").select(
        "id",
        F.concat(F.lit("calendar/"), "id").alias("slug"),
        F.coalesce(first("DTSTART"), F.lit("")).alias("date"),
        F.coalesce(first("DTEND"), F.lit("")).alias("end"),
        F.coalesce(first("SUMMARY"), F.col("id")).alias("summary"),
        F.coalesce(first("LOCATION"), F.lit("")).alias("location"),
        F.sha2("block", 256).alias("source_hash"),
    )
    body = F.concat(F.lit("# "), "summary", F.lit("\n\nStart: "), "date", F.lit("\nEnd: "), "end", F.lit("\nLocation: "), "location")
    return _item_pages(rows, marks, version, "calendar-event", body)


def normalized_corpus(files: DataFrame, marks: DataFrame, version: str, note: str, *others: DataFrame) -> DataFrame:
    """All pages of a corpus, (slug, text): its files, the given other pages, and stubs of what they link to."""
    pages = reduce(
        DataFrame.unionByName,
        [normalized_pages(files, marks, version), *[o.select("slug", T.rewrite_links(F.col("text")).alias("text")) for o in others]],
    )
    return pages.unionByName(stub_pages(entity_labels(pages), version, note))
