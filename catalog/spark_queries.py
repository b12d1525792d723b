"""One query per operator, over the given tables.

The tables hold prose, so the Java corpus is derived from them row by row: each
document becomes a source file whose line-final words are methods and whose words
before commas are calls. Languages and sources decide which files lack a package or a
class and which start with what kind of comment.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions import encoder, java, text, vectors
from sourceloom.operators import embed, fragments, graph, incremental, similarity
from sourceloom.plans import index, report, reset, search, summary
from sourceloom.session import scratch_dir
from sourceloom.sources import files
from sourceloom.sources.listing import can_list, opened, qualified
from sourceloom.sources.store import CorpusStore
from sourceloom.streaming.incremental import index_stream as start_index_stream

ENCODER = encoder.HashingEncoder(64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(rows: DataFrame) -> DataFrame:
    """Deal out a table of fewer splits than cores; a table of many splits stays as read.

    The test tables are one file with one row group each and would occupy one core.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


# -- derived inputs ------------------------------------------------------------


def _by(column: str, cases: dict[str, str], otherwise: str) -> Column:
    chosen = None
    for value, result in cases.items():
        test, shown = F.col(column) == value, F.lit(result)
        chosen = F.when(test, shown) if chosen is None else chosen.when(test, shown)
    return chosen.otherwise(otherwise)


def java_file_path() -> Column:
    suffix = _by("lang", {"en": ".java", "fr": ".JAVA", "de": ".Java"}, ".txt")
    return F.concat(
        F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/Doc"), F.col("doc_id").cast("string"), suffix
    )


def java_source() -> Column:
    banner = _by(
        "source",
        {
            "src0": "\n/* Licensed under some terms.\n * Copyright holders */\n\n",
            "src1": "/* plain words */\n",
            "src2": "  // License line\n// second line\n\n",
            "src3": "// plain line\n",
            "src4": "/* COPYRIGHT */ // Apache\n//\n",
        },
        "",
    )
    package = F.when(F.col("lang").isin("en", "fr"), F.concat(F.lit(" package corpus."), "lang", F.lit(" ;\n")))
    head = F.when(
        F.col("lang").isin("en", "de"),
        F.concat(F.lit("public class Doc"), F.col("doc_id").cast("string"), F.lit(" {\n")),
    )
    with_calls = F.regexp_replace("text", r"(\p{L}),", "$1(),")
    body = F.regexp_replace(with_calls, r"([a-z]{2,4}+)\.\n", "private void $1() { $1(); }\n")
    tail = F.when(F.col("lang") == "en", F.concat(F.lit("}\nclass Aux"), F.col("doc_id").cast("string"), F.lit(" {\n")))
    none = F.lit("")
    return F.concat(
        banner, F.coalesce(package, none), F.coalesce(head, none), body, F.lit("\n}\n"), F.coalesce(tail, none)
    )


def java_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", java_file_path().alias("file_path"), java_source().alias("source_text"))


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java_corpus(spark, sf_dir).select("file_path", F.col("source_text").cast("binary").alias("content"))


def java_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with its names read, without vectors."""
    return fragments.read_sources(java_files(spark, sf_dir))


def java_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.call_edges_of(java_names(spark, sf_dir))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("file_path"), F.md5("text").alias("hash"))


def labelled_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hashes: labelled documents are known, toxic ones by an older content."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = docs.join(labels, "doc_id")
    return known.select(
        F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("file_path"),
        F.md5(F.when(F.col("toxic") == 1, F.concat("text", F.lit(" before"))).otherwise(F.col("text"))).alias("hash"),
    )


def link_edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a graph: host of the page to link target."""
    pages = table(spark, sf_dir, "pages")
    return (
        pages.select(
            F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("caller"),
            F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("callee"),
        )
        .distinct()
    )


def mixed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with null, empty and all-zero vectors for some labels."""
    emb = table(spark, sf_dir, "embeddings")
    vector = (
        F.when(F.col("label") == 0, F.lit(None))
        .when(F.col("label") == 1, F.array().cast("array<float>"))
        .when(F.col("label") == 2, F.transform("embedding", lambda _: F.lit(0).cast("float")))
        .otherwise(F.col("embedding"))
    )
    return emb.select("vec_id", vectors.to_vector(vector).alias("embedding"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def joined(names: str) -> Column:
    return F.array_join(names, ",")


# -- scans, decoding, hashing ----------------------------------------------------


def scan_filter(spark, sf_dir):
    return java_corpus(spark, sf_dir).where(files.has_suffix(F.col("file_path"))).select("doc_id", "file_path")


def field_defaults(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.when(F.col("lang") != "es", java_file_path())
    code = F.when(F.col("lang") != "fr", F.col("text"))
    return docs.select(
        "doc_id",
        F.coalesce(path, F.lit("-")).alias("file_path"),
        F.length(F.coalesce(code, F.lit(""))).cast("long").alias("code_chars"),
    )


def decode_text(spark, sf_dir):
    """Documents with an invalid byte, a real replacement character and mixed line ends."""
    docs = table(spark, sf_dir, "documents")
    raw = F.concat(
        F.col("text").cast("binary"),
        F.lit(bytearray(b"\r\nx\xffy\r")),
        F.when(F.col("lang") == "en", F.lit("z")).otherwise("�").cast("binary"),
    )
    return docs.select("doc_id", text.decode_source(raw).alias("decoded"))


def content_md5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("content", F.col("text").cast("binary"))
    return incremental.with_hash(docs).select("doc_id", "hash")


# -- incremental ----------------------------------------------------------------


def incremental_changed(spark, sf_dir):
    changed = incremental.changed_files(document_files(spark, sf_dir), labelled_state(spark, sf_dir))
    return changed.select("file_path", "hash")


def incremental_counts(spark, sf_dir):
    scanned, state = document_files(spark, sf_dir), labelled_state(spark, sf_dir)
    normal = incremental.scan_counters(scanned, state).withColumn("mode", F.lit("incremental"))
    full = incremental.scan_counters(scanned, state, full_rescan=True).withColumn("mode", F.lit("full"))
    return normal.unionByName(full)


def hash_upsert(spark, sf_dir):
    scanned = document_files(spark, sf_dir)
    gone = labelled_state(spark, sf_dir).withColumn("file_path", F.concat(F.lit("/gone"), "file_path"))
    return incremental.upsert_hashes(labelled_state(spark, sf_dir).unionByName(gone), scanned)


# -- text and extraction ---------------------------------------------------------


def strip_license_block(spark, sf_dir):
    return java_corpus(spark, sf_dir).select("doc_id", text.strip_block_banner(F.col("source_text")).alias("code"))


def strip_license_line(spark, sf_dir):
    return java_corpus(spark, sf_dir).select("doc_id", text.strip_line_banner(F.col("source_text")).alias("code"))


def strip_license(spark, sf_dir):
    return java_names(spark, sf_dir).select("file_path", "code")


def package_of(spark, sf_dir):
    return java_corpus(spark, sf_dir).select("doc_id", java.package_of(F.col("source_text")).alias("package"))


def classes_of(spark, sf_dir):
    return java_corpus(spark, sf_dir).select("doc_id", joined(java.classes_of(F.col("source_text"))).alias("classes"))


def methods_of(spark, sf_dir):
    found = java_corpus(spark, sf_dir).select("doc_id", java.methods_of(F.col("source_text")).alias("found"))
    return found.select(
        "doc_id",
        joined("found").alias("methods"),
        F.size(F.array_distinct("found")).cast("long").alias("distinct_methods"),
    )


def calls_of(spark, sf_dir):
    return java_corpus(spark, sf_dir).select("doc_id", joined(java.call_sites_of(F.col("source_text"))).alias("calls"))


def local_calls(spark, sf_dir):
    return java_names(spark, sf_dir).select("file_path", joined("calls").alias("calls"))


def fragment_rows(spark, sf_dir):
    rows = fragments.fragments_of(java_names(spark, sf_dir))
    return rows.select(
        "type",
        "symbol",
        "file_path",
        F.md5("code").alias("code_md5"),
        F.size("calls").cast("long").alias("n_calls"),
        F.md5(joined("calls")).alias("calls_md5"),
    )


# -- graph ----------------------------------------------------------------------


def call_edges(spark, sf_dir):
    return java_edges(spark, sf_dir)


def edges_from_fragments(spark, sf_dir):
    return fragments.edges_of_fragments(fragments.fragments_of(java_names(spark, sf_dir)))


def method_nodes(spark, sf_dir):
    return graph.method_nodes(java_edges(spark, sf_dir))


def graph_counts(spark, sf_dir):
    return graph.graph_counts(java_edges(spark, sf_dir))


def edges_merge(spark, sf_dir):
    """Java edges merged into a graph that has those of the English files already."""
    found = java_edges(spark, sf_dir)
    english = java_names(spark, sf_dir).where(F.startswith("file_path", F.lit("/corpus/en/")))
    return graph.graph_counts(graph.merge_edges(fragments.call_edges_of(english), found))


def edges_new(spark, sf_dir):
    english = java_names(spark, sf_dir).where(F.startswith("file_path", F.lit("/corpus/en/")))
    return graph.new_edges(fragments.call_edges_of(english), java_edges(spark, sf_dir))


def link_edges(spark, sf_dir):
    return link_edges_of(spark, sf_dir)


def link_counts(spark, sf_dir):
    return graph.graph_counts(link_edges_of(spark, sf_dir))


def _neighbour_rows(near):
    return near.select("target", joined("callers").alias("callers"), joined("callees").alias("callees"))


def link_neighbours(spark, sf_dir):
    return _neighbour_rows(graph.neighbours(link_edges_of(spark, sf_dir), 10))


def neighbours_topn(spark, sf_dir):
    return _neighbour_rows(graph.neighbours(java_edges(spark, sf_dir), 10))


def callers_lookup(spark, sf_dir):
    return graph.callers_of(link_edges_of(spark, sf_dir), "/the", 10)


def callees_lookup(spark, sf_dir):
    """Link targets of one host: that of the first page."""
    page = table(spark, sf_dir, "pages").where("page_id = 0").select("url").first()
    host = page["url"].split("//")[1].split("/")[0]
    return graph.callees_of(link_edges_of(spark, sf_dir), host, 12)


# -- vectors ---------------------------------------------------------------------


def valid_vectors(spark, sf_dir):
    rows = mixed_vectors(spark, sf_dir).where(vectors.is_valid(F.col("embedding")))
    return rows.select("vec_id", F.size("embedding").cast("long").alias("dims"))


def vector_norms(spark, sf_dir):
    rows = mixed_vectors(spark, sf_dir).where(vectors.is_valid(F.col("embedding")))
    own = F.col("embedding")
    return rows.select(
        "vec_id",
        F.round(vectors.norm(own), 6).alias("norm"),
        F.round(vectors.dot(own, F.reverse(own)), 6).alias("dot_reversed"),
        vectors.cosine(own, F.reverse(own)).alias("cosine_reversed"),
    )


def cosine_topk(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    query = emb.where("vec_id = 0").select("embedding").first()["embedding"]
    return similarity.top_k(emb, query, 10, "vec_id").select("vec_id", "label", "score")


def knn_batch(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    near = similarity.top_k_batch(
        emb.select(F.col("vec_id").alias("key"), "embedding"),
        emb.select(F.col("vec_id").alias("query_id"), "embedding"),
        10,
    )
    return near.select("query_id", F.col("key").alias("vec_id"), "rank", "score")


def knn_blocks(spark, sf_dir):
    """The same with text ids, on the path for more query vectors than travel with a task."""
    emb = table(spark, sf_dir, "embeddings")
    near = similarity.top_k_batch(
        emb.select(F.col("vec_id").alias("key"), "embedding"),
        emb.select(F.concat(F.lit("v"), "vec_id").alias("query_id"), "embedding"),
        10,
        query_bytes=200 * 4 * 64,
        block_rows=700,
    )
    return near.select("query_id", F.col("key").alias("vec_id"), "rank", "score")


def hash_embed(spark, sf_dir):
    rows = embed.embed(table(spark, sf_dir, "documents"), "text", ENCODER)
    return rows.select("doc_id", _whole_numbers("embedding"))


def embed_dedup_join(spark, sf_dir):
    rows = embed.embed_distinct(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ENCODER)
    return rows.select("doc_id", _whole_numbers("embedding"))


def _whole_numbers(vector: str) -> Column:
    return F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), ",").alias("vector")


def embed_errors(spark, sf_dir):
    """Rows an encoder gave no vector for: here those without a text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "es", F.col("text")).alias("text"))
    return embed.failed_rows(embed.embed(docs, "text", ENCODER)).select("doc_id")


def picky_model() -> encoder.ModelEncoder:
    """A stand-in for a user's model: the length of a text and its count of the letter e.
    It fails on texts with an @ and returns a third number for lengths that 5 divides."""

    def load():
        def one(text: str) -> list[float]:
            if "@" in text:
                raise ValueError("not encoded")
            return [float(len(text)), float(text.count("e"))] + [0.0] * (len(text) % 5 == 0)

        return lambda texts: [one(t) for t in texts]

    return encoder.ModelEncoder("picky", 2, load)


def model_embed(spark, sf_dir):
    """Vectors of a model that fails on some texts."""
    rows = embed.embed(table(spark, sf_dir, "documents"), "text", picky_model())
    number = lambda i: F.get("embedding", F.lit(i)).cast("long")
    return rows.select("doc_id", number(0).alias("n_chars"), number(1).alias("n_e"))


# -- search and report -----------------------------------------------------------


def text_search(spark, sf_dir):
    """Flagship: every benchmark text against every document."""
    docs = embed.embed(table(spark, sf_dir, "documents"), "text", ENCODER)
    asked = embed.embed(benchmark_queries(spark, sf_dir), "text", ENCODER)
    near = similarity.top_k_batch(docs.select(F.col("doc_id").alias("key"), "embedding"), asked, 10)
    return near.select("query_id", "rank", F.col("key").alias("doc_id"), "score")


def java_store(spark, sf_dir, label) -> CorpusStore:
    store = CorpusStore(spark, scratch_dir(spark, label))
    index.index_files(java_files(spark, sf_dir), store, ENCODER)
    return store


def fragment_search(spark, sf_dir):
    store = java_store(spark, sf_dir, "fragment-search")
    hits = search.search(store, benchmark_queries(spark, sf_dir), 10, ENCODER)
    return hits.select("query_id", "rank", "type", "symbol", "file_path", "score")


def single_search(spark, sf_dir):
    """One query text: the first benchmark text."""
    store = java_store(spark, sf_dir, "single-search")
    asked = table(spark, sf_dir, "benchmark").where("item_id = 0").first()["text"]
    hits = search.search_display(search.search(store, asked, 10, ENCODER), show_code=True)
    return hits.select("rank", "type", "symbol", "file_path", "preview", "score")


def search_context(spark, sf_dir):
    store = java_store(spark, sf_dir, "search-context")
    rows = search.search_display(search.search(store, benchmark_queries(spark, sf_dir), 10, ENCODER, with_graph=True))
    return rows.select(
        "query_id", "rank", "type", "symbol", "file_path", joined("callers").alias("callers"), joined("callees").alias("callees")
    )


def code_preview(spark, sf_dir):
    code = F.when(F.col("file_path").endswith(".txt"), F.lit("")).otherwise(F.col("code"))
    return java_names(spark, sf_dir).select("file_path", text.code_preview(code).alias("preview"))


def report_rows(spark, sf_dir):
    store = java_store(spark, sf_dir, "report-rows")
    rows = report.report(store, benchmark_queries(spark, sf_dir), 10, ENCODER)
    return rows.select("query_id", "rank", "score", "title", "meta", "snippet", "graph")


def report_written(spark, sf_dir):
    """The report as written, without graph."""
    store = java_store(spark, sf_dir, "report-written")
    rows = report.report(store, benchmark_queries(spark, sf_dir), 10, ENCODER, with_graph=False)
    report.write_report(rows, f"{store.root}/report")
    return spark.read.parquet(f"{store.root}/report").select("query_id", "rank", "title", "meta")


def report_graph_written(spark, sf_dir):
    """The report as written, with graph."""
    store = java_store(spark, sf_dir, "report-graph-written")
    rows = report.report(store, benchmark_queries(spark, sf_dir), 10, ENCODER)
    report.write_report(rows, f"{store.root}/report")
    return spark.read.parquet(f"{store.root}/report")


def graph_text(spark, sf_dir):
    near = graph.neighbours(link_edges_of(spark, sf_dir), 12)
    return near.select("target", text.graph_text(F.col("target"), F.col("callers"), F.col("callees")).alias("graph"))


def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


# -- stored corpus ----------------------------------------------------------------


def new_store(spark, label) -> CorpusStore:
    return CorpusStore(spark, scratch_dir(spark, label))


def index_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("type"),
        F.concat(F.lit("vector number "), F.col("vec_id").cast("string"), F.repeat(F.lit("."), 60)).alias("symbol"),
        F.lit("-").alias("file_path"),
        "embedding",
    )
    return summary.preview_rows(rows)


def index_preview_stored(spark, sf_dir):
    """The same for a stored corpus."""
    return summary.index_preview(java_store(spark, sf_dir, "preview")).select("type", "symbol", "dims")


def three_runs(spark, sf_dir) -> CorpusStore:
    """A store after three runs: all files, again with the German ones edited, full rescan."""
    store, corpus = new_store(spark, "index-runs"), java_files(spark, sf_dir)
    edited = F.when(
        F.startswith("file_path", F.lit("/corpus/de/")), F.concat("content", F.lit(bytearray(b"// edited\n")))
    ).otherwise(F.col("content"))
    index.index_files(corpus, store, ENCODER)
    index.index_files(corpus.withColumn("content", edited), store, ENCODER)
    index.index_files(corpus.withColumn("content", edited), store, ENCODER, full_rescan=True)
    return store


def index_errors(spark, sf_dir):
    """Fragments of files that the model could not encode."""
    store = new_store(spark, "index-errors")
    index.index_files(java_files(spark, sf_dir), store, picky_model())
    return store.index_errors()


def index_runs(spark, sf_dir):
    return three_runs(spark, sf_dir).runs().select("run", "discovered", "skipped", "processed")


def index_hashes(spark, sf_dir):
    """Current hashes after the same runs."""
    return three_runs(spark, sf_dir).file_hashes()


def index_edges(spark, sf_dir):
    """The stored graph after the same runs: edges found again stay single."""
    return three_runs(spark, sf_dir).call_edges()


def index_summary(spark, sf_dir):
    return summary.index_summary(java_store(spark, sf_dir, "index-summary"))


def index_fragments(spark, sf_dir):
    """Stored fragments after a run and a full rescan, which appends."""
    store = java_store(spark, sf_dir, "index-fragments")
    index.index_files(java_files(spark, sf_dir), store, ENCODER, full_rescan=True)
    return store.fragments().groupBy("file_path", "type", "symbol").agg(F.count("*").alias("copies"))


def index_latest(spark, sf_dir):
    """The same with only the newest version of each file."""
    store = java_store(spark, sf_dir, "index-latest")
    index.index_files(java_files(spark, sf_dir), store, ENCODER, full_rescan=True)
    rows = store.fragments(latest_only=True)
    return rows.groupBy("file_path", "type", "symbol").agg(F.count("*").alias("copies"))


def replaced_store(spark, sf_dir, label) -> CorpusStore:
    """A store after a run over all files and one that replaces: the German files are edited,
    the French ones gone, the full rescan between them would have doubled all others."""
    store, corpus = java_store(spark, sf_dir, label), java_files(spark, sf_dir)
    left = corpus.where(~F.startswith("file_path", F.lit("/corpus/fr/")))
    edited = F.when(
        F.startswith("file_path", F.lit("/corpus/de/")), F.concat("content", F.lit(bytearray(b"// edited\n")))
    ).otherwise(F.col("content"))
    index.index_files(left.withColumn("content", edited), store, ENCODER, replace=True)
    return store


def index_replaced(spark, sf_dir):
    """Fragments after a run that replaces."""
    rows = replaced_store(spark, sf_dir, "index-replaced").fragments()
    return rows.groupBy("file_path", "type", "symbol").agg(F.count("*").alias("copies"))


def index_replaced_edges(spark, sf_dir):
    """The graph after a run that replaces."""
    return replaced_store(spark, sf_dir, "replaced-edges").call_edges()


def index_hidden(spark, sf_dir):
    """Files in hidden folders, and empty ones, are scanned like others."""
    store = new_store(spark, "index-hidden")
    folder = f"{store.root}/input"
    write_page_files(spark, sf_dir, f"{folder}/_generated/.pages")
    index.index_folder(store, folder, ENCODER, suffix=".txt")
    return _page_index(store)


def write_page_files(spark, sf_dir, folder: str) -> None:
    """Each page as a file of its own, its links turned into methods."""
    pages = table(spark, sf_dir, "pages")
    body = F.regexp_replace("html", 'href="/([A-Za-z]+)"', " private void $1() { }")
    code = F.concat(F.lit("class Page"), F.col("page_id").cast("string"), F.lit("\n"), body)
    write_texts(pages.select(code.alias("value")), folder)


def write_texts(rows: DataFrame, folder: str) -> None:
    """One file per row of the column ``value``, with a line end, as Spark's text writer leaves
    them with one record per file. Tasks write them where they can open the folder: Hadoop's
    local files start processes to set the rights of each. A row that is written again, by a
    retry or a second attempt, gets the name it had."""
    root = qualified(rows.sparkSession, folder)
    if not can_list(root):
        rows.write.option("maxRecordsPerFile", 1).text(folder)
        return
    there, inside, _ = opened(root)
    there.create_dir(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (there, inside, _), task, seen = opened(root), TaskContext.get(), Counter()
        for batch in batches:
            for content in batch.column(0).to_pylist():
                digest = hashlib.md5(content, usedforsecurity=False).hexdigest()
                name = f"{inside}/part-{task.partitionId():05d}-{digest}-{seen[digest]}.txt"
                seen[digest] += 1
                begun = f"{name}.{task.taskAttemptId()}"
                with there.open_output_stream(begun, compression=None) as out:
                    out.write(content)
                there.move(begun, name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    lines = F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).cast("binary")
    rows.select(lines.alias("content")).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def _page_index(store):
    rows = store.fragments().select("hash", "type", "symbol", F.size("calls").cast("long").alias("n_calls"))
    return rows


def index_files(spark, sf_dir):
    """Scan a folder of files and index it."""
    store = new_store(spark, "index-files")
    folder = f"{store.root}/input"
    write_page_files(spark, sf_dir, folder)
    index.index_folder(store, folder, ENCODER, suffix=".TXT")
    return _page_index(store)


def index_stream(spark, sf_dir):
    """Index the same folder as a stream."""
    store = new_store(spark, "index-stream")
    folder = f"{store.root}/input"
    write_page_files(spark, sf_dir, folder)
    start_index_stream(store, folder, f"{store.root}/stream", ENCODER, suffix=".txt").awaitTermination()
    return _page_index(store)


def purge_counts(spark, sf_dir):
    return reset.reset(java_store(spark, sf_dir, "purge"))


QUERIES = {
    "scan_filter": scan_filter,
    "field_defaults": field_defaults,
    "decode_text": decode_text,
    "content_md5": content_md5,
    "incremental_changed": incremental_changed,
    "incremental_counts": incremental_counts,
    "hash_upsert": hash_upsert,
    "strip_license_block": strip_license_block,
    "strip_license_line": strip_license_line,
    "strip_license": strip_license,
    "package_of": package_of,
    "classes_of": classes_of,
    "methods_of": methods_of,
    "calls_of": calls_of,
    "local_calls": local_calls,
    "fragments": fragment_rows,
    "call_edges": call_edges,
    "edges_from_fragments": edges_from_fragments,
    "method_nodes": method_nodes,
    "graph_counts": graph_counts,
    "edges_merge": edges_merge,
    "edges_new": edges_new,
    "link_edges": link_edges,
    "link_counts": link_counts,
    "link_neighbours": link_neighbours,
    "neighbours_topn": neighbours_topn,
    "callers_lookup": callers_lookup,
    "callees_lookup": callees_lookup,
    "valid_vectors": valid_vectors,
    "vector_norms": vector_norms,
    "cosine_topk": cosine_topk,
    "knn_batch": knn_batch,
    "knn_blocks": knn_blocks,
    "hash_embed": hash_embed,
    "embed_dedup_join": embed_dedup_join,
    "embed_errors": embed_errors,
    "model_embed": model_embed,
    "text_search": text_search,
    "fragment_search": fragment_search,
    "single_search": single_search,
    "search_context": search_context,
    "code_preview": code_preview,
    "report_rows": report_rows,
    "report_written": report_written,
    "report_graph_written": report_graph_written,
    "graph_text": graph_text,
    "html_escape": html_escape,
    "index_preview": index_preview,
    "index_preview_stored": index_preview_stored,
    "index_errors": index_errors,
    "index_runs": index_runs,
    "index_hashes": index_hashes,
    "index_edges": index_edges,
    "index_summary": index_summary,
    "index_fragments": index_fragments,
    "index_latest": index_latest,
    "index_replaced": index_replaced,
    "index_replaced_edges": index_replaced_edges,
    "index_hidden": index_hidden,
    "index_files": index_files,
    "index_stream": index_stream,
    "purge_counts": purge_counts,
}
