"""Gazetteer matching and exact entity retrieval by phrase equi-joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..session import settled, spread, temporary
from .filters import key_filter
from .postings import exact_sum

#: Tokens of a phrase that form its join key.
GRAM = 3
# The default chunker: runs of capitalised words, an approximation of noun phrases.
CAPITALISED = r"\p{Lu}[\p{L}\p{N}'-]*(?:\s+(?:\p{Lu}|\p{Nd})[\p{L}\p{N}'-]*)*"


def capitalised_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0))


def surfaces(pages: DataFrame, chunks: DataFrame | None = None, phrases=capitalised_runs) -> DataFrame:
    """(surface, page_ids): titles, slug tails and kept body phrases, normalised."""
    named = pages.select("page_id", F.explode(T.title_slug_surfaces(F.col("title"), F.col("slug"))).alias("s"))
    if chunks is not None:
        body = chunks.select("page_id", F.explode(phrases(F.col("text"))).alias("s")).filter(T.keep_body_surface(F.col("s")))
        named = named.unionByName(body)
    named = named.select("page_id", T.normalize_surface(F.col("s")).alias("surface")).filter("surface <> ''")
    return named.groupBy("surface").agg(F.array_sort(F.collect_set("page_id")).alias("page_ids"))


def _gram_rows(docs: DataFrame, words: str, sizes: list[int]) -> DataFrame:
    """(doc, gram): the distinct hashed runs of as many words; nothing else of a text leaves the scan."""

    def runs(size: int) -> Column:
        return F.transform(F.col(words), lambda w, i: F.xxhash64(F.lit(size), w, *[F.get(F.col(words), i + k) for k in range(1, size)]))

    grams = F.array_distinct(F.flatten(F.array(*[runs(m) for m in sizes])))
    return docs.select("doc", F.explode(grams).alias("gram"))


def _keyed(phrases: DataFrame, words: str) -> tuple[DataFrame, list[int]]:
    """Phrases with the hash of their first words (up to GRAM), and how many words those are (at most GRAM numbers)."""
    size = F.least(F.size(words), F.lit(GRAM))
    gram = F.lit(None).cast("bigint")
    for m in range(1, GRAM + 1):
        gram = F.when(size == m, F.xxhash64(F.lit(m), *[F.get(F.col(words), F.lit(k)) for k in range(m)])).otherwise(gram)
    sizes = [r[0] for r in phrases.select(size.alias("m")).filter("m > 0").distinct().collect()]
    return phrases.withColumn("gram", gram).filter("gram is not null"), sorted(sizes)


def _candidates(docs: DataFrame, words: str, phrases: DataFrame, phrase_words: str) -> DataFrame:
    """Phrases with the documents (doc) that hold the run of words a phrase starts with: a superset
    of what contains them. A bounded filter of the phrases' keys stands where runs are made, so
    that hits alone reach the equi-join of numbers."""
    keyed, sizes = _keyed(phrases, phrase_words)
    if not sizes:
        return phrases.withColumn("doc", F.lit(None).cast(docs.schema["doc"].dataType)).limit(0)
    hit = key_filter(keyed.select("gram").distinct())
    return _gram_rows(docs, words, sizes).filter(hit(F.col("gram"))).join(keyed, "gram").drop("gram")


def of_hits(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of docs whose ``doc`` some row of ``near`` has, and few others: what is no candidate is not shuffled again."""
    name = F.xxhash64("doc")
    return docs.filter(key_filter(near.select(name.alias("k")).distinct())(name))


def phrase_matches(docs: DataFrame, phrases: DataFrame, key: str, text: str, phrase_key: str, phrase: str) -> DataFrame:
    """(doc, phrase_id) for every normalised phrase inside a normalised text.

    Phrases are keyed by their first tokens (up to GRAM), texts by their runs of as many. Only candidates
    meet the texts again, by id, and are confirmed by padded containment. Written to the shared folder.
    """
    wanted = phrases.select(
        F.col(phrase_key).alias("phrase_id"),
        T.normalize_surface(F.col(phrase)).alias("p"),
    ).filter("p <> ''").withColumn("w", F.split("p", " "))
    rows = spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("t")))
    with temporary(docs.sparkSession) as kept:
        texts = rows.select("doc", T.normalize_surface(F.col("t")).alias("t")).filter("t <> ''")
        near = settled(_candidates(texts.select("doc", F.split("t", " ").alias("w")), "w", wanted, "w").select("doc", "phrase_id", "p").distinct())
        again = of_hits(rows, near).select("doc", T.normalize_surface(F.col("t")).alias("t"))
        return kept(settled(again.join(near, "doc").filter(T.contains_phrase(F.col("t"), F.col("p"))).select("doc", "phrase_id").distinct()))


#: Lengths of character grams; a phrase uses the longest that it holds.
SIZES = (8, 4, 2, 1)
#: Characters of a text that are cut into grams at a time.
STRETCH = 1 << 15
#: Characters of phrases, about, that one automaton holds; more of them are found by joins.
AT_ONCE = 1 << 20


def _characters(text: Column, size: int) -> Column:
    """(at, gram) of every run of ``size`` characters, hashed; at counts from 0."""

    def of(chars: Column) -> Column:
        gram = lambda i: F.xxhash64(F.lit(size), *[F.get(chars, i + k) for k in range(size)])
        return F.transform(F.sequence(F.lit(0), F.size(chars) - size), lambda i: F.struct(i.alias("at"), gram(i).alias("gram")))

    made = F.get(F.transform(F.array(F.split(text, "")), of), F.lit(0))
    return F.when(F.length(text) >= size, made).otherwise(F.array().cast("array<struct<at:int,gram:bigint>>"))


def _gram_places(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc, at, gram) of the texts' (doc, t) grams of these sizes. A long text is cut into stretches that overlap by less than a gram."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("t"), F.lit(1)), F.lit(STRETCH))
    part = F.when(F.length("t") > STRETCH, F.substring(F.col("t"), F.col("start"), F.lit(STRETCH + max(sizes) - 1))).otherwise(F.col("t"))
    rows = texts.select("doc", "t", F.explode(starts).alias("start")).select("doc", "start", part.alias("t"))
    grams = F.explode(F.concat(*[_characters(F.col("t"), q) for q in sizes])).alias("g")
    return rows.select("doc", "start", grams).select("doc", (F.col("start") - 1 + F.col("g.at")).alias("at"), F.col("g.gram").alias("gram"))


def _rare_grams(texts: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """(phrase_id, gram, offset, needed): of each phrase (phrase_id, p) its two rarest grams in the
    texts. A phrase with a gram that no text has is left out."""
    listed = F.lit(None).cast("array<struct<at:int,gram:bigint>>")
    for q in sizes:
        listed = F.when(F.col("q") == q, _characters(F.col("p"), q)).otherwise(listed)
    grams = wanted.withColumn("q", _size_of(F.length("p"))).select("phrase_id", F.inline(listed)).withColumnRenamed("at", "offset")
    keys = grams.select("gram").distinct()
    counts = _gram_places(texts, sizes).filter(key_filter(keys)(F.col("gram"))).groupBy("gram").agg(F.count("*").alias("n"))
    by = W.partitionBy("phrase_id")
    known = grams.join(counts, "gram", "left").withColumn("absent", F.max(F.col("n").isNull()).over(by)).filter(~F.col("absent"))
    ranked = known.withColumn("place", F.row_number().over(by.orderBy("n", "offset"))).filter("place <= 2")
    return ranked.select("phrase_id", "gram", "offset", F.max("place").over(by).alias("needed"))


def short_candidates(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, phrase_id): documents (doc, t) that hold the two rarest grams of a phrase (phrase_id, p) at the
    distance they have in it, which all that contain the phrase do."""
    sizes = sorted(r[0] for r in wanted.select(_size_of(F.length("p")).alias("q")).distinct().collect())  # at most len(SIZES) numbers
    if not sizes:
        return texts.join(wanted, F.lit(False)).select("doc", "phrase_id")
    chosen = settled(_rare_grams(texts, wanted, sizes))
    hits = _gram_places(texts, sizes).filter(key_filter(chosen.select("gram").distinct())(F.col("gram")))
    met = hits.join(chosen, "gram").withColumn("start", F.col("at") - F.col("offset"))
    both = met.groupBy("doc", "phrase_id", "start").agg(F.count_distinct("offset").alias("n"), F.max("needed").alias("needed")).filter("n = needed")
    return both.select("doc", "phrase_id").distinct()


def _size_of(length: Column) -> Column:
    size = F.lit(1)
    for q in sorted(SIZES):
        size = F.when(length >= q, q).otherwise(size)
    return size


def substring_matches(docs: DataFrame, phrases: DataFrame, key: str, text: str, phrase_key: str, phrase: str) -> DataFrame:
    """(doc, phrase_id, text, phrase) for every row whose case-folded text contains the
    case-folded phrase, also inside longer tokens. Written to the shared folder.

    Only a phrase's first and last token can be part of a longer one, so that the
    join key is the run of tokens (up to GRAM) after the first. Phrases of less than three tokens, or
    without any, are found by their characters: texts' grams of 1, 2, 4 or 8 characters are counted where a phrase
    has them, and the two rarest of each phrase are looked up with their places. Candidates alone meet the texts again.
    """
    return _substrings(docs, phrases, key, text, phrase_key, phrase, ["doc", "phrase_id", "text", "phrase"])


def substring_counts(docs: DataFrame, phrases: DataFrame, key: str, text: str, phrase_key: str, phrase: str) -> DataFrame:
    """(doc, phrase_id, n): occurrences of the same matches. Phrases of no more than AT_ONCE characters are counted where
    the texts lie, so that only numbers leave the scan; of more, the matches are found first and counted then, and the texts are
    not written once a match. Written to the shared folder."""
    wanted = phrases.select(F.col(phrase_key).alias("phrase_id"), T.casefold(F.col(phrase)).alias("p")).filter("p <> ''")
    with temporary(docs.sparkSession) as kept:
        names = settled(wanted.select("p").distinct().withColumn("number", F.monotonically_increasing_id()))
        if names.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0] <= AT_ONCE:
            rows = spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))).select("doc", T.casefold(F.col("text")).alias("t"))
            known = wanted.join(names, "p").select("number", "phrase_id")
            return kept(settled(_counted(rows.filter("t <> ''"), names).join(known, "number").select("doc", "phrase_id", "n")))
    n = T.count_occurrences(F.col("text"), F.col("phrase")).cast("long").alias("n")
    return _substrings(docs, phrases, key, text, phrase_key, phrase, ["doc", "phrase_id", n])


def overlaps_itself(p: str) -> bool:
    """Whether two occurrences of a string can overlap: some proper start of it is also its end."""
    lengths = [0] * len(p)
    for i in range(1, len(p)):
        k = lengths[i - 1]
        while k and p[i] != p[k]:
            k = lengths[k - 1]
        lengths[i] = k + (p[i] == p[k])
    return bool(p) and lengths[-1] > 0


def _counted(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, number, n) of the strings (p, number; at most AT_ONCE characters) that a text (doc, t) holds, and how often without overlap."""
    listed = [(r.p, r.number, overlaps_itself(r.p)) for r in names.collect()]
    schema = StructType([StructField("doc", texts.schema["doc"].dataType), StructField("number", LongType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        built = ahocorasick.Automaton()
        for at, (p, _, _) in enumerate(listed):
            built.add_word(p, at)
        built.make_automaton()
        numbers, again = np.array([n for _, n, _ in listed], np.int64), {at: p for at, (p, _, overlaps) in enumerate(listed) if overlaps}

        def made(batch: pa.RecordBatch, row: list[int], of: list[int], n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(numbers[of]), pa.array(n, pa.int64())], names=schema.names)

        for batch in batches:
            row, of, n = [], [], []
            for i, text in enumerate(batch.column(1)):
                t = text.as_py()
                counts = Counter(map(itemgetter(1), built.iter(t)))
                for at in counts.keys() & again.keys():
                    counts[at] = t.count(again[at])
                row += [i] * len(counts)
                of += counts
                n += counts.values()
                if len(row) >= 50_000:
                    yield made(batch, row, of, n)
                    row, of, n = [], [], []
            if row:
                yield made(batch, row, of, n)

    if not listed:
        return texts.join(names, F.lit(False)).select("doc", "number", F.lit(0).cast("long").alias("n"))
    return texts.select("doc", "t").mapInArrow(run, schema)


def _substrings(docs: DataFrame, phrases: DataFrame, key: str, text: str, phrase_key: str, phrase: str, columns: list) -> DataFrame:
    wanted = phrases.select(F.col(phrase_key).alias("phrase_id"), F.col(phrase).alias("phrase"), T.casefold(F.col(phrase)).alias("p")).filter("p <> ''")
    words = F.size(T.tokens(F.col("phrase")))
    # a plan may cut the tokens before it filters, so that the length must hold for every phrase
    inner = wanted.filter(words > 2).withColumn("w", F.slice(T.tokens(F.col("phrase")), F.lit(2), F.greatest(words - 2, F.lit(0))))
    short = wanted.filter(words <= 2)
    rows = spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")))
    with temporary(docs.sparkSession) as kept:
        long_ = _candidates(rows.select("doc", T.tokens(F.col("text")).alias("w")), "w", inner, "w").select("doc", "phrase_id")
        folded = rows.select("doc", T.casefold(F.col("text")).alias("t")).filter("t <> ''")
        near = settled(long_.unionByName(short_candidates(folded, short.select("phrase_id", "p"))).distinct())
        pairs = of_hits(rows, near).join(near, "doc").join(wanted, "phrase_id")
        return kept(settled(pairs.filter(F.contains(T.casefold(F.col("text")), F.col("p"))).select(*columns)))


def gazetteer_seeds(observations: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Raw matches with word boundaries on the case-folded text: (observation_id,
    surface, page_ids, span_start, span_end, seed_no), numbered by end, longer first,
    each surface once.

    Spans count characters of the case-folded text; where folding changes the length of
    what stands before (as of the sharp s), what is shown of the raw text is shifted by as much.
    """
    rows = spread(observations.select(F.col("observation_id").alias("doc"), F.col("text").alias("raw")))
    folded = rows.withColumn("t", T.casefold(F.col("raw")))
    wanted = gazetteer.select("surface", "page_ids").withColumn("w", F.split("surface", " "))
    near = settled(
        _candidates(
            folded.select("doc", F.regexp_extract_all("t", F.lit("[a-z0-9]+"), F.lit(0)).alias("w")),
            "w",
            wanted,
            "w",
        ).select("doc", "surface", "page_ids").distinct()
    )
    found = of_hits(rows, near).withColumn("t", T.casefold(F.col("raw"))).join(near, "doc").filter(F.contains("t", F.col("surface")))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.col("surface"), F.lit(r"(?![\p{L}\p{N}])"))
    at = F.regexp_instr("t", pattern)
    found = found.withColumn("span_start", at - 1).filter("span_start >= 0").withColumn("span_end", F.col("span_start") + F.length("surface"))
    shown = F.substring(F.col("raw"), F.col("span_start") + 1, F.length("surface"))
    found = found.select(F.col("doc").alias("observation_id"), shown.alias("shown"), "surface", "page_ids", "span_start", "span_end")
    order = W.partitionBy("observation_id").orderBy("span_end", F.length("surface").desc(), "surface")
    return found.withColumn("seed_no", F.row_number().over(order))


def phrase_seeds(observations: DataFrame, taken: DataFrame, phrases=capitalised_runs) -> DataFrame:
    """Phrase seeds whose surface no gazetteer seed of the observation has, numbered after its gazetteer seeds."""
    found = observations.select("observation_id", F.posexplode(phrases(F.col("text"))).alias("at", "shown")).withColumn(
        "surface",
        T.normalize_surface(F.col("shown")),
    )
    found = found.filter("surface <> ''").groupBy("observation_id", "surface").agg(F.min(F.struct("at", "shown")).alias("f"))
    found = found.join(taken.select("observation_id", "surface"), ["observation_id", "surface"], "left_anti")
    before = taken.groupBy("observation_id").agg(F.count("*").alias("before"))
    place = F.row_number().over(W.partitionBy("observation_id").orderBy("f.at"))
    return found.withColumn("place", place).join(before, "observation_id", "left").select(
        "observation_id",
        "surface",
        F.col("f.shown").alias("shown"),
        (F.col("place") + F.coalesce("before", F.lit(0))).cast("int").alias("seed_no"),
    )


def all_seeds(observations: DataFrame, gazetteer: DataFrame, phrases=capitalised_runs) -> DataFrame:
    """(observation_id, seed_no, seed_id, shown, surface, source, span_start, span_end, page_ids): gazetteer
    seeds, then phrases that none of them has."""
    named = gazetteer_seeds(observations, gazetteer).withColumn("source", F.lit("gazetteer"))
    said = phrase_seeds(observations, named, phrases).select(
        "observation_id", "seed_no", "shown", "surface", F.lit("noun_phrase").alias("source"), F.lit(None).cast("int").alias("span_start"), F.lit(None).cast("int").alias("span_end"),
        F.array().cast(named.schema["page_ids"].dataType).alias("page_ids"),
    )
    both = named.select(*said.columns).unionByName(said)
    return both.withColumn("seed_id", F.concat(F.lit("entity-"), F.col("seed_no").cast("string")))


def entity_exact(observations: DataFrame, gazetteer: DataFrame, pages: DataFrame, chunks: DataFrame, k: int, phrases=capitalised_runs) -> DataFrame:
    """Pages of every seed: (observation_id, seed_no, seed_id, shown, surface, source, page_id, rank, score, chunk_id, chunk_score).

    A gazetteer seed brings all pages of its surface, in order of id; a phrase its ``k`` best by
    exact score, then id. pages: page_id, title; chunks: page_id, chunk_id, chunk_index, text.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    seeds = all_seeds(observations, gazetteer, phrases)
    texts = pages.select("page_id", "title").join(bodies(chunks), "page_id", "left")
    texts = texts.select("page_id", T.normalize_surface(F.col("title")).alias("title"), T.normalize_surface(F.col("body")).alias("body"))
    columns = ["observation_id", "seed_no", "seed_id", "shown", "surface", "source", "page_id"]
    known = seeds.filter("source = 'gazetteer'").withColumn("page_id", F.explode("page_ids")).select(*columns)
    # Each distinct phrase meets the pages once, however many observations say it.
    said = seeds.filter("source = 'noun_phrase'")
    wanted = said.select("surface").distinct()
    whole = texts.select("page_id", F.concat_ws(" ", "title", "body").alias("both"))
    met = phrase_matches(whole, wanted, "page_id", "both", "surface", "surface").select(F.col("doc").alias("page_id"), F.col("phrase_id").alias("surface"))
    found = said.join(met, "surface").select(*columns)
    scored = known.unionByName(found).join(texts, "page_id").withColumn(
        "score",
        exact_score(F.col("title"), F.col("body"), F.col("surface")),
    ).drop("title", "body")
    scored = scored.filter("source = 'gazetteer' or score > 0")
    by = W.partitionBy("observation_id", "seed_no")
    by_id = F.row_number().over(by.orderBy("page_id"))
    by_score = F.row_number().over(by.orderBy(F.desc("score"), "page_id"))
    ranked = scored.withColumn("rank", F.when(F.col("source") == "gazetteer", by_id).otherwise(by_score)).filter(
        (F.col("source") == "gazetteer") | (F.col("rank") <= k),
    )
    wanted = ranked.select(F.struct("surface", "shown").alias("seed_id"), "page_id", "surface").distinct()
    best = best_exact_chunk(wanted, chunks).select(
        F.col("seed_id.surface").alias("surface"),
        F.col("seed_id.shown").alias("shown"),
        "page_id",
        "chunk_id",
        "chunk_score",
    )
    return ranked.join(best, ["surface", "shown", "page_id"], "left").select(*columns, "rank", "score", "chunk_id", "chunk_score")


def entity_trace(hits: DataFrame) -> DataFrame:
    """One row an observation: its seeds with the pages each returned, in order."""
    page = F.struct("rank", "page_id", F.col("chunk_id").alias("selected_chunk_id"), "score", "chunk_score", F.lit("exact").alias("match_type"))
    seed = hits.groupBy("observation_id", "seed_no", "seed_id", "shown", "surface", "source").agg(F.array_sort(F.collect_list(page)).alias("returned_pages"))
    row = F.struct("seed_no", "seed_id", "shown", F.col("surface").alias("normalized_surface"), "source", "returned_pages")
    return seed.groupBy("observation_id").agg(F.array_sort(F.collect_list(row)).alias("per_seed_retrievals"))


def exact_score(title: Column, body: Column, surface: Column) -> Column:
    """2 for the title, 1 for the body; all normalised."""
    return F.when(T.contains_phrase(title, surface), 2.0).otherwise(0.0) + F.when(T.contains_phrase(body, surface), 1.0).otherwise(0.0)


def bodies(chunks: DataFrame) -> DataFrame:
    """(page_id, body): chunk texts joined by a space in index order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text")))
    return chunks.groupBy("page_id").agg(F.array_join(F.transform(parts, lambda c: c["text"]), " ").alias("body"))


def best_exact_chunk(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """seeds: (seed_id, page_id, surface). The smallest chunk id that contains the
    surface; else the best BM25 chunk within its own page; else the first chunk."""
    pairs = seeds.join(chunks.select("page_id", "chunk_id", "chunk_index", "text"), "page_id")
    has = T.contains_phrase(T.normalize_surface(F.col("text")), F.col("surface"))
    local = pairs.select("seed_id", "page_id", "chunk_id", T.tokens(F.col("text")).alias("terms"), "surface")
    lens = local.withColumn("len", F.size("terms")).withColumn("n", F.count("*").over(W.partitionBy("seed_id", "page_id"))).withColumn(
        "avg",
        F.avg(F.size("terms")).over(W.partitionBy("seed_id", "page_id")),
    )
    asked = lens.select("seed_id", "page_id", "chunk_id", "terms", "len", "n", "avg", F.explode(F.split("surface", " ")).alias("term"))
    asked = asked.withColumn("tf", F.size(F.filter("terms", lambda t: t == F.col("term")))).filter("tf > 0")
    terms = asked.groupBy("seed_id", "page_id", "chunk_id", "term").agg(
        F.max("tf").alias("tf"),
        F.max("len").alias("len"),
        F.max("n").alias("n"),
        F.max("avg").alias("avg"),
        F.count("*").alias("mult"),
    )
    terms = terms.withColumn("df", F.count("*").over(W.partitionBy("seed_id", "page_id", "term")))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.5 / (
        F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("len") / F.col("avg"))
    )
    local_scores = terms.groupBy("seed_id", "page_id", "chunk_id").agg(exact_sum(F.col("mult") * part).alias("bm25"))
    ranked = pairs.select("seed_id", "page_id", "chunk_id", "chunk_index", has.cast("double").alias("chunk_score")).join(
        local_scores,
        ["seed_id", "page_id", "chunk_id"],
        "left",
    )
    order = F.min(
        F.struct(
            (-F.col("chunk_score")).alias("a"),
            F.when(F.col("chunk_score") == 0, -F.round(F.coalesce("bm25", F.lit(0.0)), 12)).alias("b"),
            F.when((F.col("chunk_score") == 0) & F.col("bm25").isNull(), F.col("chunk_index")).alias("c"),
            F.col("chunk_id").alias("chunk_id"),
        )
    )
    return ranked.groupBy("seed_id", "page_id").agg(order.alias("o")).select(
        "seed_id",
        "page_id",
        F.col("o.chunk_id").alias("chunk_id"),
        (-F.col("o.a")).alias("chunk_score"),
    )
