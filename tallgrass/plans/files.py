"""Queries for readers, writers, attachments, pages, compose files and the incremental import."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.operators import archive, assets, compose, embed, web
from tallgrass.sources import readers, tables
from tallgrass.sources.scratch import scratch
from tallgrass.streaming import imports

from .registry import query


#: Rows that share a file on average: there are more files where there are more rows.
IN_FILE = 500


def _buckets(df):
    return df.count() // IN_FILE + 1


#: Buckets that a task writes, some tens of files each.
BUCKETS_OF_TASK = 20


def _dealt(df, buckets, *keys):
    """df dealt by keys to tasks by how many files they write, not by bytes: Spark would give them all to a few."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, buckets // BUCKETS_OF_TASK), *keys)


def _many(writer):
    """A writer of many folders, each put in its place by its own task and not, one after the other, by the driver."""
    return writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")


def _written(t, df, name):
    """A folder with text files for each source, a bucket of its texts in each: in order, each with a line end."""
    path = scratch(t.spark, name)
    n = _buckets(df)
    rows = _dealt(df.withColumn("bucket", F.col("doc_id") % F.lit(n)), n, "source", "bucket")
    _many(rows.sortWithinPartitions("source", "bucket", "doc_id").select("source", "bucket", "text").write).partitionBy("source", "bucket").text(path)
    return path


def _source():
    return [F.regexp_extract("path", f"{k}=([^/]*)", 1).alias(k) for k in ("source", "bucket")]


_WHOLE = f"SELECT source, bucket::VARCHAR AS bucket, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS whole FROM (SELECT *, doc_id % (SELECT count(*) // {IN_FILE} + 1 FROM documents) AS bucket FROM documents) GROUP BY source, bucket"


@query("SRC1_chat_exports", "SELECT 'c' || conv_id AS conversation_id, CASE WHEN conv_id % 5 = 0 THEN 'Untitled' ELSE 't' || conv_id END AS title, string_agg('[' || role || '] ' || trim(text), chr(10) || chr(10) ORDER BY turn) AS transcript, '1970-01-01T00:00:00.500000+00:00' AS created_at FROM conversations GROUP BY conv_id")
def chat_exports(t):
    node = lambda n: F.concat(F.lit("n"), n.cast("string"))
    message = F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content"))
    value = F.struct(F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("parent"), message.alias("message"))
    c = t.conversations.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(node(F.col("turn")), value))).alias("mapping"), F.max("turn").alias("last"))
    record = F.struct(F.concat(F.lit("c"), "conv_id").alias("id"), F.when(F.col("conv_id") % 10 == 0, "").when(F.col("conv_id") % 5 > 0, F.concat(F.lit("t"), "conv_id")).alias("title"), F.lit(0.5).alias("create_time"), node(F.col("last")).alias("current_node"), "mapping")
    files = c.groupBy((F.col("conv_id") % F.lit(_buckets(t.conversations))).alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(record)), ","), F.lit("]")).alias("value"))
    path = scratch(t.spark, "exports")
    files.select("k", "value").repartition("k").write.partitionBy("k").text(path)
    got = readers.chat_exports(t.spark, path, "*.txt")
    flat = archive.flatten(got).select("conversation_id", archive.transcript(F.col("messages")).alias("transcript"))
    return got.select("conversation_id", "title", "created_at").join(flat, "conversation_id")


@query("SRC2_notes", f"SELECT source, bucket, whole AS text FROM ({_WHOLE})")
def notes(t):
    return readers.notes(t.spark, _written(t, t.documents, "notes")).select(*_source(), "text")


@query("SRC3_attachments", f"SELECT source, bucket, sha256(whole) AS sha, strlen(whole) AS size FROM ({_WHOLE})")
def attachments(t):
    return readers.attachments(t.spark, _written(t, t.documents, "attachments")).select(*_source(), "sha", "size")


@query("SRC4_inventory", f"SELECT source, bucket, strlen(whole) AS size, 'Documents' AS category, 0 AS sensitive FROM ({_WHOLE})")
def inventory(t):
    return readers.inventory(t.spark, _written(t, t.documents, "inventory")).select(*_source(), "size", "category", "sensitive")


@query("SNK2_event_log", "SELECT event_type AS kind, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type")
def event_log(t):
    path = scratch(t.spark, "log")
    rows = t.events.select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("title"), F.lit("").alias("body"), F.from_json("props", "map<string,long>").alias("metadata"))
    for k in range(2):
        tables.log_event(rows.filter(F.col("title").cast("long") % 2 == k), path)
    return t.spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.get_json_object("metadata", "$.k").cast("long")).alias("k"))


@query("SNK3_dossier_files", "SELECT source, lang, unnest(string_split(string_agg(text, chr(10) ORDER BY doc_id), chr(10))) AS line FROM documents GROUP BY source, lang")
def dossier_files(t):
    path = scratch(t.spark, "dossiers")
    tables.write_dossiers(t.documents, path, ["source", "lang"], "doc_id", "text")
    return t.spark.read.text(path).select("source", "lang", F.col("value").alias("line"))


@query("SNK4_metrics", """SELECT 'run-1' AS import_id, '{"documents":' || count(*) || ',"sources":' || count(DISTINCT source) || '}' AS metrics_json FROM documents""")
def metrics(t):
    return tables.metrics_row("run-1", t.documents.agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources")))


# Attachments: files stand for documents, with a head that their number gives.
_KINDS = [("FFD8FFE0", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("47494638396100", "image/gif"), ("255044462D", "application/pdf"), ("524946460000000057454250", "image/webp"), ("524946460000000057415645", "audio/x-wav"), ("000000186674797068656963", "image/heif"), ("000000186674797069736F6D", "video/mp4"), ("504B030400", "application/zip"), ("", "")]
_ENDINGS = (".dat", ".csv", ".txt", ".unknown")
_PATH = "'in/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'File-' || lpad(doc_id::VARCHAR, 8, 'A') ELSE 'photo ' || doc_id END || ['.dat', '.csv', '.txt', '.unknown'][doc_id % 4 + 1]"
_MIME = "[" + ", ".join(f"'{m}'" for _, m in _KINDS) + "][doc_id % 10 + 1]"
_BY_NAME = "['application/octet-stream', 'text/csv', 'text/plain', 'application/octet-stream'][doc_id % 4 + 1]"


def _files(t):
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("File-"), F.lpad(k.cast("string"), 8, "A"))).otherwise(F.concat(F.lit("photo "), k.cast("string")))
    path = F.concat(F.lit("in/"), "source", F.lit("/"), name, F.element_at(T.lits(_ENDINGS), (k % 4 + 1).cast("int")))
    head = F.unhex(F.element_at(T.lits(h for h, _ in _KINDS), (k % 10 + 1).cast("int")))
    return t.documents.select("doc_id", path.alias("path"), F.concat(head, F.col("text").cast("binary")).alias("content"))


@query("AST1_asset_id", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lower(lpad(doc_id::VARCHAR, 8, 'A')) ELSE substring(sha256(text), 1, 32) END AS asset_id FROM documents")
def asset_id(t):
    return _files(t).join(t.documents.select("doc_id", F.sha2("text", 256).alias("sha")), "doc_id").select("doc_id", assets.asset_id(F.col("path"), F.col("sha")).alias("asset_id"))


@query("AST2_mime", f"SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN {_BY_NAME} ELSE {_MIME} END AS mime FROM documents")
def mime(t):
    return _files(t).select("doc_id", assets.mime(F.col("path"), F.col("content")).alias("mime"))


@query("AST3_extension", "SELECT doc_id, CASE WHEN doc_id % 10 < 9 THEN ['.jpg', '.png', '.gif', '.pdf', '.webp', '.wav', '.heif', '.mp4', '.zip'][doc_id % 10 + 1] ELSE ['.bin', '.csv', '.txt', '.unknown'][doc_id % 4 + 1] END AS ext FROM documents")
def extension(t):
    return _files(t).select("doc_id", assets.extension(assets.mime(F.col("path"), F.col("content")), F.col("path")).alias("ext"))


@query("AST4_extract", f"SELECT doc_id, CASE WHEN doc_id % 10 = 9 AND doc_id % 4 IN (1, 2) THEN text ELSE '' END AS text, CASE WHEN doc_id % 10 = 9 THEN CASE WHEN doc_id % 4 IN (1, 2) THEN 'extracted' ELSE 'unsupported' END WHEN doc_id % 10 = 8 THEN 'error:BadZipFile' WHEN doc_id % 10 = 3 THEN 'unsupported' ELSE 'metadata-only' END AS status FROM documents")
def extract(t):
    f = _files(t).withColumn("mime", assets.mime(F.col("path"), F.col("content")))
    return assets.extracted(f.withColumn("path", F.col("doc_id").cast("string"))).select(F.col("path").cast("long").alias("doc_id"), "text", "status")


_DEDUP = """f AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS path, sha256(text) AS sha, 'a' || doc_id % 900 AS alias FROM documents),
    g AS (SELECT sha, arg_min(alias, path) AS named, min(path) AS path0 FROM f GROUP BY sha), a AS (SELECT sha, CASE WHEN row_number() OVER (PARTITION BY named ORDER BY path0) = 1 THEN named ELSE substring(sha, 1, 32) END AS asset_id FROM g)"""


def _deduped(t):
    k = F.col("doc_id")
    return assets.deduplicated(t.documents.select(F.lpad(k.cast("string"), 9, "0").alias("path"), F.sha2("text", 256).alias("sha"), F.concat(F.lit("a"), k % 900).alias("alias")))


@query("AST5_dedupe", f"WITH {_DEDUP} SELECT path, alias, asset_id FROM f JOIN a USING (sha)")
def dedupe(t):
    return _deduped(t).select("path", "alias", "asset_id")


@query("AST5_aliases", f"WITH {_DEDUP} SELECT alias, arg_max(asset_id, path) AS asset_id FROM f JOIN a USING (sha) GROUP BY alias")
def alias_table(t):
    return assets.aliases(_deduped(t))


def _nodes(t):
    """Messages that name attachments: as metadata, as a pointer, and not at all."""
    id_ = F.concat(F.lit("file-AbCdEf"), F.lpad((F.col("conv_id") % 50).cast("string"), 2, "0"))
    pointer = F.concat(F.lit("file-service://"), id_)
    meta = F.struct(F.array(F.struct(id_.alias("id"), F.concat(F.lit("photo"), F.col("conv_id") % 50, F.lit(".png")).alias("name"), F.lit("image/png").alias("mime_type"))).alias("attachments"))
    message = F.struct(F.concat(F.lit("m"), "turn").alias("id"), F.struct(F.array(F.when(F.col("turn") % 3 < 2, pointer).otherwise(F.col("text"))).alias("parts")).alias("content"), F.when(F.col("turn") % 3 == 1, meta).alias("metadata"))
    return t.conversations.select(F.col("conv_id").alias("conversation_id"), F.concat(F.lit("n"), "turn").alias("node_id"), F.to_json(message).alias("message"))


@query("AST6_found_references", "SELECT conv_id AS conversation_id, 'n' || turn AS node_id, 'm' || turn AS message_id, lower('AbCdEf' || lpad((conv_id % 50)::VARCHAR, 2, '0')) AS alias, CASE WHEN turn % 3 = 1 THEN 2 ELSE 1 END AS n FROM conversations WHERE turn % 3 < 2")
def found(t):
    return assets.found_references(_nodes(t)).groupBy("conversation_id", "node_id", "message_id", "alias").agg(F.count("*").cast("int").alias("n"))


@query("AST7_references", "SELECT 'asset' || conv_id % 50 AS asset_id, conv_id AS conversation_id, 'n' || turn AS node_id, 'm' || turn AS message_id, CASE WHEN turn % 3 = 1 THEN 'photo' || conv_id % 50 || '.png' END AS original_name, CASE WHEN turn % 3 = 1 THEN 'image/png' END AS mime_type, 'file-service://file-AbCdEf' || lpad((conv_id % 50)::VARCHAR, 2, '0') AS context, CASE WHEN turn % 3 = 1 THEN '{\"id\": \"file-AbCdEf' || lpad((conv_id % 50)::VARCHAR, 2, '0') || '\", \"mime_type\": \"image/png\", \"name\": \"photo' || conv_id % 50 || '.png\"}' ELSE '{}' END AS metadata_json FROM conversations WHERE turn % 3 < 2 AND conv_id % 50 < 40")
def references(t):
    alias = t.conversations.select((F.col("conv_id") % 50).alias("k")).distinct().filter("k < 40").select(F.concat(F.lit("abcdef"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("alias"), F.concat(F.lit("asset"), "k").alias("asset_id"))
    return assets.linked(assets.found_references(_nodes(t)), alias).drop("reference_hash")


@query("AST8_asset_texts", """WITH a AS (SELECT 'x' || p_partkey AS asset_id, '.png' AS ext, p_type AS mime, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE '' END AS text FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY created_at, conversation_id) AS n FROM (SELECT 'x' || (event_id % (SELECT count(*) FROM part) + 1) AS asset_id, CASE WHEN event_id % 2 = 0 THEN 'n' || event_id END AS original_name, 't' || user_id AS title, lpad(event_id::VARCHAR, 8, '0') AS created_at, event_id AS conversation_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS context FROM events WHERE event_type <> 'view')),
    s AS (SELECT asset_id, string_agg(concat_ws(chr(10), 'Original name: ' || original_name, 'Conversation: ' || title || ' (' || created_at || ') id=' || conversation_id, CASE WHEN context <> '' THEN context END), chr(10) ORDER BY n) AS refs FROM r WHERE n <= 20 GROUP BY asset_id)
    SELECT a.asset_id, CASE WHEN text <> '' THEN 'extracted_text' WHEN refs IS NOT NULL THEN 'conversation_context' ELSE 'metadata' END AS content_kind, 'Asset file_' || a.asset_id || ext || chr(10) || 'MIME type: ' || mime || CASE WHEN text <> '' THEN chr(10) || chr(10) || 'Extracted content:' || chr(10) || text ELSE '' END || coalesce(chr(10) || chr(10) || 'Conversation references:' || chr(10) || refs, '') AS text FROM a LEFT JOIN s ON a.asset_id = s.asset_id""")
def asset_texts(t):
    e, x = F.col("event_id"), lambda c: F.concat(F.lit("x"), c).alias("asset_id")
    a = t.part.select(x(F.col("p_partkey")), F.lit(".png").alias("ext"), F.col("p_type").alias("mime"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise("").alias("text"))
    r = t.events.filter("event_type <> 'view'").select(x(e % F.lit(t.part.count()) + 1), F.when(e % 2 == 0, F.concat(F.lit("n"), e)).alias("original_name"), F.concat(F.lit("t"), "user_id").alias("title"), F.lpad(e.cast("string"), 8, "0").alias("created_at"), e.alias("conversation_id"), F.when(e % 3 == 0, "").otherwise(F.col("props")).alias("context"))
    return assets.asset_texts(a, r)


@query("WEB1_page_texts")
def page_texts(t):
    return web.page_texts(t.pages)


@query("WEB2_page_texts_more")
def page_texts_more(t):
    return web.page_texts(t.pages, more=True)


_CLEAN = r"regexp_replace(regexp_replace(html, '[^A-Za-z0-9 _-]+', '', 'g'), '^\s+|\s+$', '', 'g')"


@query("WEB3_note_names", f"SELECT page_id, replace(CASE WHEN substring({_CLEAN}, 1, 90) = '' THEN 'Research Note' ELSE substring({_CLEAN}, 1, 90) END, '  ', ' ') AS name, substring(html, 1, 1500) AS excerpt FROM pages")
def note_names(t):
    return t.pages.select("page_id", T.note_name(F.col("html")).alias("name"), F.substring("html", 1, 1500).alias("excerpt"))


# Compose files: some for each brand, with a service for each part.
_IPS = ("", "127.0.0.1:", "0.0.0.0:", "[::1]:", "192.168.1.5:", "none")
_SERVICE = "replace(p_name, ' ', '_') || '_' || ['db', 'plex', 'app'][p_partkey % 3 + 1] || p_partkey"
_FILE = f"p_brand || '/' || p_partkey % (SELECT count(*) // {IN_FILE} + 1 FROM part)"
_PORTS = f"""ports AS (SELECT {_FILE} AS compose_file, {_SERVICE} AS service, ['', '127.0.0.1', '0.0.0.0', '[::1]', '192.168.1.5'][p_partkey % 6 + 1] AS host_ip, (8000 + p_partkey)::VARCHAR AS host_port, '80' AS container_port, CASE WHEN p_partkey % 7 = 0 THEN 'udp' ELSE 'tcp' END AS proto,
    CASE p_partkey % 6 WHEN 1 THEN 'LOOPBACK_ONLY' WHEN 3 THEN 'LOOPBACK_ONLY' WHEN 4 THEN 'SPECIFIC_INTERFACE' ELSE 'LAN_EXPOSED' END AS exposure, CASE p_partkey % 3 WHEN 0 THEN 'probably private' WHEN 1 THEN 'probably LAN-needed' ELSE 'review manually' END AS category, p_partkey FROM part WHERE p_partkey % 6 < 5)"""


def _compose(t):
    k = F.col("p_partkey")
    service = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.element_at(T.lits(("db", "plex", "app")), (k % 3 + 1).cast("int")), k.cast("string"))
    ip, port = F.element_at(T.lits(_IPS), (k % 6 + 1).cast("int")), (k + 8000).cast("string")
    proto = F.when(k % 7 == 0, "/udp").otherwise("")
    item = F.when(k % 6 == 5, F.lit("      - 8080")).otherwise(F.concat(F.lit('      - "'), ip, port, F.lit(":80"), proto, F.lit('"  # web')))
    mount = F.when(k % 4 == 0, F.concat(F.lit("\n    volumes:\n      - /srv/"), "p_type", F.lit(":/data\n      - kept:/kept"))).otherwise("")
    block = F.concat(F.lit("  "), service, F.lit(":\n    image: x\n    ports:\n"), item, mount)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), block.alias("b")))), lambda x: x.b), "\n")
    path = F.concat("p_brand", F.lit("/"), k % F.lit(_buckets(t.part)))
    files = t.part.groupBy(path.alias("path")).agg(F.concat(F.lit("services:\n"), body, F.lit("\nvolumes:\n  kept:\n")).alias("text"))
    return files


@query("CMP1_parse", f"SELECT {_FILE} AS compose_file, {_SERVICE} AS service, 2 + CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END AS n FROM part")
def parse(t):
    return compose.parse(_compose(t)).groupBy("compose_file", "service").agg(F.count("*").cast("int").alias("n"))


@query("CMP2_ports", f"WITH {_PORTS} SELECT compose_file, service, host_ip, host_port, container_port, proto FROM ports")
def ports(t):
    return compose.ports(compose.parse(_compose(t))).select("compose_file", "service", "host_ip", "host_port", "container_port", "proto")


@query("CMP2_volumes", f"SELECT {_FILE} AS compose_file, {_SERVICE} AS service, '/srv/' || p_type AS host_path, '/data' AS target FROM part WHERE p_partkey % 4 = 0")
def volumes(t):
    return compose.volumes(compose.parse(_compose(t))).drop("line_no")


@query("CMP3_exposure", f"""WITH {_PORTS} SELECT service, exposure, category, CASE WHEN exposure = 'LOOPBACK_ONLY' THEN 'Already loopback-only.' WHEN category = 'probably LAN-needed' THEN 'May need LAN access. Keep exposed only if you actually use it from phone/LAN, or put behind Tailscale/reverse proxy.' ELSE 'Consider changing to: 127.0.0.1:' || host_port || ':80' || CASE WHEN proto = 'udp' THEN '/udp' ELSE '' END END AS suggestion FROM ports""")
def exposure(t):
    return compose.ports(compose.parse(_compose(t))).select("service", "exposure", "category", "suggestion")


@query("CMP4_container_exposure", "SELECT event_id, ['LAN_EXPOSED', 'LOOPBACK_ONLY', 'REVIEW', 'NO_PUBLISHED_PORTS'][event_id % 4 + 1] AS exposure FROM events")
def container_exposure(t):
    said = F.element_at(T.lits(("0.0.0.0:80->80/tcp, :::80->80/tcp", "127.0.0.1:5432->5432/tcp", "80/tcp", "")), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", compose.container_exposure(said).alias("exposure"))


@query("CMP5_services_map", f"""WITH {_PORTS} SELECT {_FILE.replace("p_partkey", "part.p_partkey")} AS compose_file, {_SERVICE} AS service, coalesce('http://' || CASE WHEN exposure = 'LOOPBACK_ONLY' THEN '127.0.0.1' WHEN host_ip = '' THEN 'LAN IP' ELSE host_ip END || ':' || host_port, '-') AS urls, coalesce(exposure, 'NO_PUBLISHED_PORTS') AS exposure, CASE WHEN part.p_partkey % 4 = 0 THEN '/srv/' || p_type ELSE '-' END AS data FROM part LEFT JOIN ports ON part.p_partkey = ports.p_partkey""".replace(_SERVICE + " AS service, coalesce(", _SERVICE.replace("p_partkey", "part.p_partkey") + " AS service, coalesce("))
def services_map(t):
    return compose.services_map(compose.parse(_compose(t)))


@query("CMP6_summary", f"WITH {_PORTS} SELECT (SELECT count(DISTINCT {_FILE}) FROM part) AS files, (SELECT count(*) FROM part) AS services, count(*) AS ports, count(*) FILTER (exposure = 'LAN_EXPOSED') AS exposed, count(*) FILTER (exposure = 'LAN_EXPOSED' AND category = 'probably private') AS private_exposed FROM ports")
def summary(t):
    return compose.summary(compose.parse(_compose(t)))


@query("CMP6_candidates", f"WITH {_PORTS} SELECT CASE WHEN category = 'probably private' THEN 'High' ELSE 'Review' END AS priority, service, compose_file FROM ports WHERE exposure = 'LAN_EXPOSED' AND category <> 'probably LAN-needed'")
def candidates(t):
    return compose.candidates(compose.parse(_compose(t))).select("priority", "service", "compose_file")


@query("SRC5_compose_files", f"SELECT replace({_FILE}, '#', '-') AS brand, count(*) AS services FROM part GROUP BY ALL")
def compose_files(t):
    path = scratch(t.spark, "compose")
    named = F.split(F.replace("path", F.lit("#"), F.lit("-")), "/")
    files = _compose(t).select(F.get(named, F.lit(0)).alias("brand"), F.get(named, F.lit(1)).alias("part"), "text")
    _many(_dealt(files, _buckets(t.part), "brand", "part").write).partitionBy("brand", "part").text(path)
    got = compose.parse(readers.compose_files(t.spark, path, "*.txt", ()))
    name = F.concat(F.regexp_extract("compose_file", "brand=([^/]*)", 1), F.lit("/"), F.regexp_extract("compose_file", "part=([^/]*)", 1))
    return got.filter("kind = 'service'").groupBy(name.alias("brand")).agg(F.count("*").alias("services"))


@query("STR1_incremental_import", "SELECT conv_id AS conversation_id, count(*)::INT AS messages, sum(length(text))::BIGINT AS signs, md5(string_agg(text, '|' ORDER BY turn)) AS texts FROM conversations GROUP BY conv_id")
def incremental(t):
    """Turns of a conversation come in three runs, spread over files; the last run brings nothing new."""
    turns, folder = scratch(t.spark, "turns"), scratch(t.spark, "import")
    for k in (2, 0, 1, None):
        if k is not None:
            t.conversations.filter(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == k).repartition(3, "turn").write.mode("append").parquet(turns)
        imports.run(turns, folder, t.spark, t.conversations.schema)
    texts = F.transform("messages", lambda m: m.text)
    signs = F.aggregate(texts, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return imports.current(t.spark, folder, "conversations").select("conversation_id", F.size("messages").alias("messages"), signs.alias("signs"), F.md5(F.array_join(texts, "|")).alias("texts"))


@query("UDF1_embedder_hook")
def hook(t):
    return embed.embedded(t.benchmark, "text", embed.hashing_embedder(16)).select("item_id", "embedding")
