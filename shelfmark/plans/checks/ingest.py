"""Checks of sources, triage, staging state, conversion and batch OCR.

Documents play incoming files, their lines the pages of a PDF; conversations
play scanned files whose turns are pages; events play the change log of the
staging folders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.text import sha256_hex
from shelfmark.operators import conversion, ocr, staging as G, triage as T
from shelfmark.models import Embedder
from shelfmark.plans.checks.registry import check, d_strip, documents, table
from shelfmark.plans.library import Library
from shelfmark.session import shared_dir

NAME = "concat(source, '-', cast(doc_id as varchar(20)), case when n_chars % 4 = 0 then '.epub' when n_chars % 4 = 1 then '.PDF' when n_chars % 4 = 2 then '.txt' else '' end)"
FILES_SQL = f"files as (select doc_id, {NAME} as name, sha256(text) as sha256, text, n_chars, source, lang from documents)"
SUFFIX_SQL = "lower(regexp_extract(name, '.(\\.[^./]+)$', 1))"


def files(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.expr(NAME).alias("name"), F.encode("text", "UTF-8").alias("content"),
                    "text", "n_chars", "source", "lang")


@check("src_4_books", "select 'doc' || doc_id as book_id, length(text) as n, sha256(text) as digest from documents")
def books(spark, sf):
    """Every book of the library with its whole text."""
    return documents(spark, sf).select(F.concat(F.lit("doc"), "doc_id").alias("book_id"),
                                       F.length("text").cast("bigint").alias("n"), sha256_hex(F.col("text")).alias("digest"))


@check("src_1_visible_files", f"with {FILES_SQL}, n as (select doc_id, case when n_chars % 7 = 0 then '.' || name when n_chars % 5 = 0 then name || '.part' else name end as name from files) "
       "select doc_id, name, not starts_with(name, '.') as visible, not starts_with(name, '.') and "
       f"{SUFFIX_SQL} not in ('.crdownload', '.part', '.tmp') as finished from n")
def visible_files(spark, sf):
    """Hidden-file and partial-download predicates of the inbox (SRC-2)."""
    n = files(spark, sf).withColumn("name", F.expr("case when n_chars % 7 = 0 then concat('.', name) when n_chars % 5 = 0 then concat(name, '.part') else name end"))
    return n.select("doc_id", "name", T.visible(F.col("name")).alias("visible"), T.finished(F.col("name")).alias("finished"))


@check("flt_12_classify", f"with {FILES_SQL}, k as (select doc_id, name, {SUFFIX_SQL} as s, n_chars from files), "
       "c as (select *, case when s = '.epub' then 'epub' when s = '.pdf' then case when n_chars >= 100 then 'native' else 'scanned' end else 'unsupported' end as classification from k) "
       "select doc_id, ltrim(s, '.') as file_type, classification, case classification when 'epub' then 'epub' when 'native' then 'local' when 'scanned' then 'cloud' end as staging_category, "
       "'source' || s as source_name from c")
def classify(spark, sf):
    f = files(spark, sf)
    kind = T.classification(F.col("name"), T.density_class(F.col("n_chars")))
    return f.select("doc_id", T.file_type(F.col("name")).alias("file_type"), kind.alias("classification"),
                    T.staging_area(kind).alias("staging_category"), T.source_file(F.col("name")).alias("source_name"))


@check("jon_5_first_copies", f"with {FILES_SQL} select sha256, doc_id, name from (select *, row_number() over (partition by sha256 order by doc_id) as rn from files) where rn = 1")
def first_copies(spark, sf):
    """Earliest file per digest."""
    p = T.fingerprints(files(spark, sf).select("doc_id", "name", "content"))
    return T.first_copies(p, ("doc_id",)).select("sha256", "doc_id", "name")


@check("stg_1_triage", f"with {FILES_SQL}, one as (select *, row_number() over (partition by sha256 order by doc_id) as rn, {SUFFIX_SQL} as s from files), "
       "fresh as (select * from one where rn = 1 and sha256 not in (select sha256(d.text) from documents d join labels l using (doc_id) where l.quality = 0)), "
       "p as (select *, case when s <> '.pdf' then null when n_chars >= 100 then 'native' else 'scanned' end as probed from fresh), "
       "c as (select *, case when s = '.epub' then 'epub' when s = '.pdf' then probed else 'unsupported' end as classification from p) "
       "select sha256 as folder_id, sha256, name as original_name, ltrim(s, '.') as file_type, classification, "
       "case classification when 'epub' then 'epub' when 'native' then 'local' when 'scanned' then 'cloud' end as staging_category, doc_id from c")
def triage(spark, sf):
    """Dedup inside the batch and against staged digests, classify, route."""
    f = files(spark, sf)
    prints = T.fingerprints(f.select(F.col("doc_id").cast("string").alias("path"), "name", "content",
                                     F.col("doc_id").alias("modification_time")))
    probes = f.where(F.lower("name").endswith(".pdf")).select(
        F.col("doc_id").cast("string").alias("file"), F.col("n_chars").cast("double").alias("avg_chars_per_page"),
        F.lit(1).alias("sampled_pages"), F.lit(1).alias("total_pages"), T.density_class(F.col("n_chars")).alias("classification"))
    low = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    staged = documents(spark, sf).join(low, "doc_id", "left_semi").select(sha256_hex(F.col("text")).alias("sha256"))
    routed = T.triage(prints, probes, staged)
    return routed.select("folder_id", "sha256", "original_name", "file_type", "classification", "staging_category",
                         F.col("modification_time").alias("doc_id"))


@check("snk_7_quarantine", f"with {FILES_SQL} select doc_id, name from files where {SUFFIX_SQL} not in ('.epub', '.pdf')")
def quarantine(spark, sf):
    kind = T.classification(F.col("name"), F.lit("native"))
    return files(spark, sf).where(T.staging_area(kind).isNull()).select("doc_id", "name")


PAGES_SQL = f"pages_t as (select cast(conv_id as varchar) as file, turn as page_no, length({d_strip('text')}) as n_chars from conversations)"


def conversation_pages(spark, sf):
    from shelfmark.functions.text import strip
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("page_no"),
        F.length(strip(F.col("text"))).alias("n_chars"))


@check("src_9_sample_positions", "with n as (select doc_id, len(string_split(text, chr(10))) as n from documents) select doc_id, cast(unnest(case when n <= 5 then range(0, n) else "
       "list_transform(range(0, 5), lambda i: cast(floor(i * (n / 5.0::double)) as bigint)) end) as int) as page_no from n")
def sample_positions(spark, sf):
    """Evenly spaced page numbers (RNK-14) for documents whose lines are pages."""
    n = documents(spark, sf).select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"))
    return n.select("doc_id", F.explode(T.sample_positions(F.col("n"))).alias("page_no"))


@check("src_9_probe", f"with {PAGES_SQL}, n as (select file, count(*) as n from pages_t group by file), "
       "want as (select file, unnest(case when n <= 5 then range(0, n) else list_transform(range(0, 5), lambda i: cast(floor(i * (n / 5.0::double)) as bigint)) end) as page_no from n), "
       "s as (select file, sum(n_chars)::double / count(*) as a, count(*) as k from pages_t join want using (file, page_no) group by file) "
       "select n.file, cast(printf('%.1f', coalesce(a, 0)) as double) as avg_chars_per_page, coalesce(k, 0) as sampled_pages, n as total_pages, "
       "case when coalesce(a, 0) >= 100 then 'native' else 'scanned' end as classification from n left join s using (file)")
def probe(spark, sf):
    """Text density over the sampled pages of every file (AGG-8)."""
    return T.probe_pages(conversation_pages(spark, sf))


@check("src_11_page_ranges", "with n as (select doc_id, len(string_split(text, chr(10))) as n from documents), r as (select doc_id, n, unnest(range(0, n, 3)) as first from n) "
       "select doc_id, cast(first // 3 as int) as part, cast(first as int) as first, cast(least(first + 3, n) as int) as stop, cast(ceil(n / 3.0) as int) as batches from r")
def page_ranges(spark, sf):
    """Half-open page ranges and their number (MTH-2, SRC-13)."""
    d = documents(spark, sf).select("doc_id", F.size(F.split("text", "\n", -1)).alias("total_pages"))
    d = d.withColumn("batches", conversion.batch_count(F.col("total_pages"), 3))
    return conversion.work_items(d, 3).select("doc_id", "part", "first", "stop", "batches")


@check("agg_11_ordered_concat", "with p as (select doc_id, string_split(text, chr(10)) as ls from documents), r as (select doc_id, ls, unnest(range(0, len(ls), 3)) as first from p) "
       "select doc_id, string_agg('<' || array_to_string(ls[first + 1:first + 3], chr(10)) || '>', chr(10) || chr(10) order by first) as text from r group by doc_id")
def ordered_concat(spark, sf):
    """Page ranges converted apart and put back in order, one string per file (SRC-11, SRC-12)."""
    cut = documents(spark, sf).select("doc_id", F.posexplode(conversion.split_pages(F.split("text", "\n", -1), 3)).alias("part", "pages"))
    done = cut.select("doc_id", "part", F.concat(F.lit("<"), F.array_join("pages", "\n"), F.lit(">")).alias("text"))
    return conversion.ordered_text(done, "doc_id", "part", "text")


@check("src_12_resume", "with p as (select doc_id, len(string_split(text, chr(10))) as n from documents), r as (select doc_id, unnest(range(0, n, 3)) // 3 as part from p) "
       "select cast(doc_id as varchar) as file, cast(part as int) as part from r where not exists (select 1 from labels l where l.doc_id = r.doc_id and l.quality = part)")
def resume(spark, sf):
    """Ranges still to convert once some have stored results."""
    d = documents(spark, sf).select(F.col("doc_id").cast("string").alias("file"), F.size(F.split("text", "\n", -1)).alias("total_pages"))
    stored = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("file"), F.col("quality").alias("part"))
    return conversion.remaining(conversion.work_items(d, 3), stored).select("file", "part")


OCR_PAGES = "list_filter(string_split(replace(text, 'the', chr(10)), chr(10)), lambda p: p <> '')"


@check("src_17_ocr_join", f"select doc_id, array_to_string({OCR_PAGES}, chr(10) || chr(10) || '---' || chr(10) || chr(10)) as sync_text, "
       f"array_to_string({OCR_PAGES}, chr(10) || chr(10)) as batch_text from documents")
def ocr_join(spark, sf):
    """Non-empty page texts of one OCR answer, both separators (SRC-19)."""
    pages = F.split(F.replace("text", F.lit("the"), F.lit("\n")), "\n", -1)
    return documents(spark, sf).select("doc_id", conversion.ocr_text(pages).alias("sync_text"),
                                       conversion.ocr_text(pages, "\n\n").alias("batch_text"))


@check("src_18_result_lines", "select cast(doc_id as varchar) as custom_id, case when t <> '' then t end as raw_text, case when t = '' then 'failed' else 'complete' end as batch_status, "
       "case when t = '' then 'empty result' end as batch_error, case when t <> '' then cast(length(t) as int) end as raw_chars "
       "from (select doc_id, case when n_chars % 9 = 0 then '' else text end as t from documents)")
def result_lines(spark, sf):
    """Result lines written as JSON, parsed and turned into text or an error."""
    text = F.expr("case when n_chars % 9 = 0 then '' else text end")
    page = F.struct(F.lit(0).alias("index"), text.alias("markdown"))
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("custom_id"), F.struct(
        F.struct(F.array(page).alias("pages")).alias("body")).alias("response")))
    from shelfmark.schemas import OCR_RESULT_DDL
    parsed = documents(spark, sf).select(F.from_json(line, OCR_RESULT_DDL).alias("r")).select("r.*")
    return ocr.result_texts(parsed)


@check("snk_15_request_lines", """select doc_id, '{"custom_id":"' || left(sha256(text), 12) || '","method":"POST","url":"/v1/ocr","body":{"model":"mistral-ocr-latest","document":{"type":"file_id","file_id":"f' || doc_id || '"}}}' as line from documents""")
def request_lines(spark, sf):
    line = ocr.request_line(F.left(sha256_hex(F.col("text")), F.lit(12)), F.concat(F.lit("f"), "doc_id"))
    return documents(spark, sf).select("doc_id", line.alias("line"))


@check("jon_4_results_to_folders", "select doc_id, exists (select 1 from labels l where l.doc_id = d.doc_id) as found from documents d")
def results_to_folders(spark, sf):
    """OCR results matched to their folders; the others only go to the log."""
    r = documents(spark, sf).select(F.col("doc_id").alias("custom_id"))
    folders = table(spark, sf, "labels").select(F.col("doc_id").alias("folder_id"))
    hit = ocr.matched(r, folders).withColumn("found", F.lit(True))
    miss = ocr.unmatched(r, folders).withColumn("found", F.lit(False))
    return hit.unionByName(miss).withColumnRenamed("custom_id", "doc_id")


@check("agg_6_ocr_cost", "select count(*) as books, cast(sum(n) as bigint) as total_pages, round(sum(n) / 1000.0, 6) as cost_estimate from "
       "(select doc_id, len(string_split(text, chr(10))) as n from documents) d left join labels l using (doc_id) where coalesce(l.quality, 9) <> 1")
def ocr_cost(spark, sf):
    """Books to submit, their pages and the price."""
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "submitted").otherwise("failed").alias("batch_status"))
    s = documents(spark, sf).select("doc_id", F.size(F.split("text", "\n", -1)).alias("page_count")).join(labels, "doc_id", "left")
    s = s.withColumn("folder_id", F.col("doc_id").cast("string")).withColumn("staging_category", F.lit("cloud"))
    total = ocr.submit_summary(ocr.to_submit(s))
    return total.withColumn("cost_estimate", F.round("cost_estimate", 6))


STATES = ("case event_type when 'click' then 'COMPLETED' when 'view' then 'SUCCESS' when 'error' then 'failed' when 'signup' then 'complete' else 'RUNNING' end")


@check("stg_17_poll_states", f"select event_id, {STATES} as polled_status from events where (user_id % 4) not in (0, 1) and {STATES} in ('SUCCESS', 'COMPLETED', 'complete')")
def poll_states(spark, sf):
    """Open batches whose polled state says they are finished."""
    known = F.when(F.col("user_id") % 4 == 0, "complete").when(F.col("user_id") % 4 == 1, "cancelled").otherwise("queued")
    b = table(spark, sf, "events").select("event_id", known.alias("status"), F.expr(STATES).alias("polled_status"))
    return ocr.finished_batches(b).select("event_id", "polled_status")


@check("agg_13_batch_folders", "select conv_id as batch_id, count(*) as books, cast(sum(length(text)) as bigint) as total_pages from conversations group by conv_id")
def batch_folders(spark, sf):
    """Folders per batch, counted from one row per folder instead of a collected map."""
    c = table(spark, sf, "conversations")
    return c.groupBy(F.col("conv_id").alias("batch_id")).agg(F.count("*").alias("books"), F.sum(F.length("text")).alias("total_pages"))


@check("stg_3_meta_log", "select user_id as folder_id, event_type as field, arg_max(value, row(ts, event_id)) as value, min(ts) as created_at, max(ts) as updated_at from events group by user_id, event_type")
def meta_log(spark, sf):
    """Last write wins per key; creation time sticks."""
    log = table(spark, sf, "events").select(F.col("user_id").alias("folder_id"), F.col("event_type").alias("field"),
                                            "value", F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return G.fold_log(log)


@check("stg_3_meta_snapshot", "select user_id as folder_id, event_type as field, arg_max(value, row(ts, event_id)) as value, min(ts) as created_at, max(ts) as updated_at from events group by user_id, event_type")
def meta_snapshot(spark, sf):
    """The same state from a snapshot of the first half of the log and the entries after it."""
    log = table(spark, sf, "events").select(F.col("user_id").alias("folder_id"), F.col("event_type").alias("field"),
                                            "value", F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    half = log.agg(F.floor(F.max("seq") / 2)).first()[0]
    empty = log.limit(0).withColumns({"created_at": F.col("at"), "updated_at": F.col("at")})
    snapshot = G.fold_onto(empty, log.where(F.col("seq") <= half))
    return G.fold_onto(snapshot, log.where(F.col("seq") > half)).drop("at", "seq")


@check("stg_3_meta_merge", "select coalesce(n.folder_id, o.folder_id) as folder_id, coalesce(n.quality, o.quality) as quality, coalesce(o.source, null) as source, n.toxic as toxic, "
       "coalesce(o.n_chars, n.at) as created_at, coalesce(n.at, o.n_chars) as updated_at from (select doc_id as folder_id, source, case when n_chars % 2 = 0 then 7 end as quality, n_chars from documents) o "
       "full join (select doc_id + 1 as folder_id, case when toxic = 0 then quality end as quality, toxic, doc_id * 100 as at from labels) n using (folder_id)")
def meta_merge(spark, sf):
    """Upsert of a batch of updates into the staging table (SNK-4)."""
    old = documents(spark, sf).select(F.col("doc_id").alias("folder_id"), "source", F.when(F.col("n_chars") % 2 == 0, 7).alias("quality"),
                                      F.col("n_chars").alias("created_at"), F.col("n_chars").alias("updated_at"))
    new = table(spark, sf, "labels").select((F.col("doc_id") + 1).alias("folder_id"), F.when(F.col("toxic") == 0, F.col("quality")).alias("quality"), "toxic",
                                            (F.col("doc_id") * 100).alias("updated_at"))
    return G.merge_meta(old, new)


FLAGS_SQL = ("staging as (select cast(d.doc_id as varchar) as folder_id, l.doc_id is not null as has_meta, coalesce(l.quality = 1, false) as has_clean, coalesce(l.toxic = 1, false) as is_locked, "
             "d.n_chars % 3 = 0 as is_done, d.n_chars % 2 = 0 as has_raw, case when d.n_chars % 4 = 0 then 'epub' else 'txt' end as file_type, "
             "case when d.n_chars % 5 = 0 then null else d.n_chars end as created_at from documents d left join labels l using (doc_id))")


def staging(spark, sf):
    d = documents(spark, sf).join(table(spark, sf, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    return d.select(
        F.col("doc_id").cast("string").alias("folder_id"), F.coalesce("labelled", F.lit(False)).alias("has_meta"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("has_clean"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_locked"),
        (F.col("n_chars") % 3 == 0).alias("is_done"), (F.col("n_chars") % 2 == 0).alias("has_raw"),
        F.when(F.col("n_chars") % 4 == 0, "epub").otherwise("txt").alias("file_type"),
        F.when(F.col("n_chars") % 5 != 0, F.col("n_chars")).alias("created_at"))


@check("stg_5_pending", f"with {FLAGS_SQL} select folder_id, created_at from staging where has_meta and not is_locked and not has_clean")
def pending(spark, sf):
    """Pending folders, oldest first with unknown dates ahead (RNK-11)."""
    return G.pending(staging(spark, sf)).select("folder_id", "created_at")


@check("stg_6_ready", f"with {FLAGS_SQL} select folder_id from staging where has_clean and not is_done and not is_locked")
def ready(spark, sf):
    return G.ready_for_fanout(staging(spark, sf)).select("folder_id")


@check("stg_7_mark_done", f"with {FLAGS_SQL} select folder_id, is_done or exists (select 1 from labels l where cast(l.doc_id as varchar) = folder_id and l.quality = 1) as is_done from staging")
def mark_done(spark, sf):
    done = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("folder_id"))
    return G.set_flag(staging(spark, sf), "is_done", done).select("folder_id", "is_done")


@check("stg_10_backlog", f"with {FLAGS_SQL} select folder_id from staging where not is_done and (has_raw or file_type = 'epub')")
def backlog(spark, sf):
    """Folders still to process, in folder order (RNK-12)."""
    return G.backlog(staging(spark, sf)).select("folder_id")


@check("agg_9_quality_gate", "select doc_id, cast(printf('%.1f', length(text)::double / greatest(p, 1)) as double) as chars_per_page, case when length(text)::double / greatest(p, 1) < 500 then 'reclassify' else 'ok' end as outcome "
       "from (select doc_id, text, n_chars // 1000 as p from documents)")
def quality_gate(spark, sf):
    """Characters per page and the re-filing decision (STG-8)."""
    d = documents(spark, sf).select("doc_id", T.quality_gate(F.col("text"), F.expr("n_chars div 1000")).alias("g"))
    return d.select("doc_id", "g.*")


@check("stg_8_reclassify", "select doc_id, case when gate and cat = 'local' then 'cloud' else cat end as staging_category, case when gate and cat = 'local' then 'local' end as reclassified_from from "
       "(select doc_id, length(text) < 500 as gate, case when n_chars % 2 = 0 then 'local' else 'epub' end as cat from documents)")
def reclassify(spark, sf):
    s = documents(spark, sf).select("doc_id", F.when(F.length("text") < 500, "failed").alias("quality_gate"),
                                    F.when(F.col("n_chars") % 2 == 0, "local").otherwise("epub").alias("staging_category"))
    return G.reclassify(s).select("doc_id", "staging_category", "reclassified_from")


INDEXED_SQL = "select 'doc' || doc_id as book_id, min(quality) as quality from documents join labels using (doc_id) group by doc_id"
_libraries: dict[tuple[str, str], Library] = {}


def library(spark, sf):
    """A stored library of the labelled documents, added in two runs; built once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _libraries:
        lib = Library(spark, shared_dir(spark, "check-library"), Embedder(dims=8), buckets=4)
        known = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        every = documents(spark, sf).join(known, "doc_id").select(F.concat(F.lit("doc"), "doc_id").alias("book_id"), "text", "quality")
        lib.add_books(every.where("quality = 1"))
        lib.add_books(every)  # only the others are new
        _libraries[key] = lib
    return _libraries[key]


@check("agg_4_run_counters", f"select case when quality = 1 then 0 else 1 end as seq, count(*) as books, 0 as replaced, count(*) as indexed from ({INDEXED_SQL}) group by quality")
def run_counters(spark, sf):
    """Counters of every run that built the library."""
    lib = library(spark, sf)
    seqs = spark.createDataFrame([(r.batch, r.seq) for r in lib.log()], "batch string, seq bigint")
    alive = lib.versions().where("parents > 0").join(F.broadcast(seqs), "batch").groupBy("seq").agg(F.count("*").alias("indexed"))
    return lib.run_counters().select("seq", "books", "replaced").join(alive, "seq").withColumns({c: F.col(c).cast("int") for c in ("seq", "replaced")})


@check("agg_2_indexed_books", f"select book_id from ({INDEXED_SQL})")
def indexed_books(spark, sf):
    """Distinct indexed books, uncapped (FLT-6)."""
    return library(spark, sf).indexed_books()


@check("jon_6_not_indexed", "select 'doc' || doc_id as book_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def not_indexed(spark, sf):
    """Books left after dropping the indexed ones (FLT-7, FLT-8)."""
    return library(spark, sf).to_index(documents(spark, sf).select(F.concat(F.lit("doc"), "doc_id").alias("book_id"))).select("book_id")


@check("snk_6_library_books", f"with {FILES_SQL} select doc_id, lower(source) || '-' || doc_id as book_id, sha256(text) as digest from files")
def library_books(spark, sf):
    """Cleaned texts filed under the slug of their original name."""
    from shelfmark.functions.text import book_slug
    f = files(spark, sf)
    return f.select("doc_id", book_slug(F.col("name")).alias("book_id"), sha256_hex(F.col("text")).alias("digest"))
