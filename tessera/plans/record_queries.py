"""Queries on records beside images: sidecars, logs, verdicts, names, manifests, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import jsonops, text
from tessera.operators import artifacts
from tessera.plans.fixtures import table
from tessera.plans.staging import new_path
from tessera.sources import files
from tessera.sources import sidecars as documents
from tessera.streaming import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


#: The white space of tessera.functions.text, as a class for SQL.
WHITE = text.WHITE


@query(f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[{WHITE}]*[\r\n]+[{WHITE}]*', ' ', 'g'), '^[{WHITE}]+|[{WHITE}]+$', '', 'g')) AS flat,
 sha256(regexp_replace(regexp_replace(text, '[{WHITE}]+', ' ', 'g'), '^[{WHITE}]+|[{WHITE}]+$', '', 'g')) AS minified FROM documents""")
def text_single_line(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.single_line(t), 256).alias("flat"), F.sha2(text.single_line(t, minify=True), 256).alias("minified"))


@query(f"""WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '[{WHITE}]+$', '')) AS l FROM documents),
f AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_replace(l[i], '^[{WHITE}]+|[{WHITE}]+$', '', 'g') <> '') AS full_ FROM l)
SELECT doc_id, sha256(CASE WHEN l IS NULL THEN NULL WHEN len(full_) = 0 THEN '' ELSE array_to_string(l[list_min(full_):list_max(full_)], chr(10)) END) AS cleaned FROM f""")
def text_multiline(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.multiline(F.col("text")), 256).alias("cleaned"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS stem, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') || '-mask' AS derived FROM pages")
def name_stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.stem(F.col("url")).alias("stem"), text.derived_name(F.col("url"), "mask").alias("derived"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S-utc') AS stamp, strftime(ts, '%Y%m%d-%H%M%S-%g-utc') AS precise FROM events")
def utc_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.utc_stamp(F.col("ts")).alias("stamp"), text.utc_stamp(F.col("ts"), True).alias("precise"))


def _logs(spark, sf_dir) -> DataFrame:
    """``event_id, level, data``: events as log entries whose data hold a secret."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "debug").when(F.col("event_type") == "signup", "warn").otherwise("info")
    data = F.struct(F.concat(F.lit("t"), F.col("event_id")).alias("Token"), (F.col("event_id") % 5).alias("tokenCount"), F.array(F.struct(F.lit("x").alias("apiKey"), (F.col("event_id") % 3).alias("n"))).alias("nested"))
    return table(spark, sf_dir, "events").select("event_id", level.alias("level"), data.alias("data"))


LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' WHEN 'signup' THEN 'warn' ELSE 'info' END"
DATA_SQL = """'{"Token":"[redacted]","tokenCount":' || (event_id % 5) || ',"nested":[{"apiKey":"[redacted]","n":' || (event_id % 3) || '}]}'"""


@query(f"SELECT event_id, {LEVEL_SQL} AS level, {DATA_SQL} AS data FROM events")
def redacted_structs(spark, sf_dir):
    return jsonops.redact(_logs(spark, sf_dir), ["data"]).withColumn("data", F.to_json("data", {"ignoreNullFields": "false"}))


@query(f"SELECT event_id, {DATA_SQL} AS data FROM events")
def redacted_json(spark, sf_dir):
    return _logs(spark, sf_dir).select("event_id", jsonops.redact_json(F.to_json("data")).alias("data"))


@query("""SELECT event_id, '{"b64_json":null,"B64_JSON":"' || event_id || '","in":{"image_b64":null,"n":' || (event_id % 3) || '}}' AS response FROM events""")
def nulled_payloads(spark, sf_dir):
    body = F.concat(F.lit('{"b64_json":"'), F.col("event_id"), F.lit('","B64_JSON":"'), F.col("event_id"), F.lit('","in":{"image_b64":[1],"n":'), F.col("event_id") % 3, F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", jsonops.null_payloads_json(body).alias("response"))


@query(f"SELECT event_id, {LEVEL_SQL} AS level FROM events WHERE event_type <> 'error'")
def log_progress(spark, sf_dir):
    return logs.progress(_logs(spark, sf_dir)).select("event_id", "level")


@query(f"SELECT event_id, {LEVEL_SQL} AS level, '[redacted]' AS token FROM events WHERE event_type <> 'view'")
def log_persisted(spark, sf_dir):
    return logs.persisted(_logs(spark, sf_dir), debug="0").select("event_id", "level", F.col("data.Token").alias("token"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'p' ELSE 'b' END AS name, CAST(CASE WHEN event_id % 3 = 0 THEN event_id ELSE 1 END AS BIGINT) AS n,
 CASE WHEN event_id % 2 = 0 THEN 'p,b' ELSE 'b' END AS tags FROM events""")
def merged_settings(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        e, F.struct(F.lit("b").alias("name"), F.struct(F.lit(1).cast("long").alias("n"), F.array(F.lit("b")).alias("tags")).alias("in")).alias("base"),
        F.struct(F.when(e % 2 == 0, "p").alias("name"), F.struct(F.when(e % 3 == 0, e).alias("n"), F.when(e % 2 == 0, F.array(F.lit("p"))).alias("tags")).alias("in")).alias("patch"))
    merged = rows.withColumn("m", jsonops.deep_merge(F.col("base"), F.col("patch"), rows.schema["base"].dataType))
    return merged.select("event_id", "m.name", F.col("m.in.n").alias("n"), F.array_join("m.in.tags", ",").alias("tags"))


@query("""SELECT CAST(event_id AS VARCHAR) AS category, CAST(CASE WHEN event_id % 4 > 0 THEN event_id % 4 * 1000 ELSE 60000 END AS INTEGER) AS timeout, CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 3 - 1 ELSE 3 END AS INTEGER) AS max_retries,
 CASE event_id % 5 WHEN 0 THEN '0.0,2.5' WHEN 1 THEN '' ELSE '1.0' END AS intervals FROM events""")
def layered_budgets(spark, sf_dir):
    e = F.col("event_id")
    events = table(spark, sf_dir, "events").select(e.cast("string").alias("category"), e)
    defaults = events.select("category", F.lit(60000).alias("timeout"), F.lit(3).alias("max_retries"), F.array(F.lit(1.0)).alias("retry_intervals"))
    given = F.when(e % 5 == 0, F.array(F.lit(0.0), F.lit(2.5))).when(e % 5 == 1, F.array().cast("array<double>")).when(e % 5 == 2, F.array(F.lit(1.0), F.lit(-1.0))).when(e % 5 == 3, F.array(F.lit(float("inf"))))
    over = events.select("category", (e % 4 * 1000).cast("int").alias("timeout"), (e % 3 - 1).cast("int").alias("max_retries"), F.coalesce(given, F.array(F.lit(float("nan")))).alias("retry_intervals"))
    return jsonops.layer_budgets(defaults, over).select("category", "timeout", "max_retries", F.array_join(F.col("retry_intervals").cast("array<string>"), ",").alias("intervals"))


@query("""SELECT doc_id AS response_id, CASE WHEN doc_id % 11 = 0 THEN 'refusal' WHEN doc_id % 11 = 1 THEN 'content_filter' WHEN doc_id % 11 = 2 THEN 'length' WHEN doc_id % 11 = 3 THEN 'empty' WHEN doc_id % 11 IN (4, 9, 10) THEN 'not_json'
 WHEN doc_id % 11 = 5 OR quality IS NULL THEN 'off_schema' ELSE 'verdict' END AS status, CASE WHEN doc_id % 11 BETWEEN 6 AND 8 AND quality IS NOT NULL THEN quality = 1 END AS ok, CASE WHEN doc_id % 11 BETWEEN 6 AND 8 THEN least(1.0, greatest(0.0, quality * 1.5 - 0.2)) END AS score, CASE WHEN doc_id % 11 BETWEEN 6 AND 8 AND quality IS NOT NULL THEN 'a,b' END AS reasons FROM labels""")
def verdicts(spark, sf_dir):
    m, q = F.col("doc_id") % 11, F.col("quality")
    good = F.to_json(F.struct((q == 1).alias("ok"), (q * 1.5 - 0.2).alias("score"), F.array(F.lit("a"), F.lit("b")).alias("reasons")))
    content = F.when(m == 3, "").when(m == 4, "{not json").when(m == 5, '{"ok":"yes","score":1,"reasons":[]}').when(m == 9, F.concat(good, F.lit(" and more"))).when(m == 10, F.concat(good, good)).otherwise(good)
    finish = F.when(m <= 1, "content_filter").when(m == 2, "length").otherwise("stop")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("response_id"), F.when(m == 0, "no").alias("refusal"), finish.alias("finish_reason"), content.alias("content"))
    return jsonops.parse_verdicts(rows).withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT doc_id AS key, CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 OR text IS NULL THEN 'unverifiable' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS integrity FROM documents""")
def integrity(spark, sf_dir):
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(k, k.cast("string").alias("name"), F.sha2("text", 256).alias("sha"))
    manifest = docs.select(k.alias("key"), "name", F.when(k % 13 != 0, F.col("sha")).alias("expected"))
    inventory = docs.where(k % 11 != 0).select("name", F.when(k % 7 == 0, F.reverse("sha")).otherwise(F.col("sha")).alias("actual"))
    return artifacts.verify_integrity(manifest, inventory)


@query("SELECT doc_id AS key, CAST(doc_id AS VARCHAR) AS name, doc_id % 5 <> 0 AND doc_id % 3 <> 1 AND (doc_id % 2 = 0 OR doc_id % 7 <> 0) AS present FROM documents")
def cached(spark, sf_dir):
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(k, k.cast("string").alias("name"))
    manifest = docs.select(k.alias("key"), "name", F.when(k % 2 != 0, 10).alias("byte_size"))
    inventory = docs.where(k % 5 != 0).select("name", (k % 3 != 1).alias("is_file"), F.when(k % 7 == 0, 11).otherwise(10).alias("length"))
    return artifacts.list_cached(manifest, inventory)


def _names(spark, sf_dir):
    """``group_id, doc_id, name``: existing files, some in other letters or formats."""
    k = F.col("doc_id")
    ext = F.when(k % 4 == 0, "png").when(k % 4 == 1, "JPG").when(k % 4 == 2, "json").otherwise("webp")
    return table(spark, sf_dir, "documents").select((k % 50).alias("group_id"), k, F.concat(F.lit("Doc-"), k, F.lit("."), ext).alias("name"))


def _plan(spark, sf_dir):
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(k % 3 != 0).select((k % 50).alias("group_id"), F.concat(F.lit("doc-"), k, F.when(k % 4 == 2, ".json").otherwise(".png")).alias("name"))


EXT_SQL = "CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'json' ELSE 'webp' END"


@query("SELECT doc_id % 50 AS group_id, 'doc-' || doc_id || CASE WHEN doc_id % 4 = 2 THEN '.json' ELSE '.png' END AS name FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 IN (0, 2)")
def collisions(spark, sf_dir):
    return artifacts.find_collisions(_plan(spark, sf_dir), _names(spark, sf_dir))


@query(f"SELECT doc_id % 50 AS group_id, 'Doc-' || doc_id || '.' || {EXT_SQL} AS name FROM documents WHERE doc_id % 3 = 0")
def stale(spark, sf_dir):
    return artifacts.stale_siblings(_names(spark, sf_dir), _plan(spark, sf_dir))


@query(f"SELECT doc_id % 50 AS group_id, 'Doc-' || doc_id || '.' || {EXT_SQL} AS name, 'png' AS planned_extension FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 IN (1, 3)")
def superseded(spark, sf_dir):
    return artifacts.superseded_formats(_names(spark, sf_dir), _plan(spark, sf_dir))


@query(f"SELECT 'doc' AS stem, 'Doc-' || doc_id || '.' || {EXT_SQL} AS name FROM documents")
def sibling_names(spark, sf_dir):
    return artifacts.siblings(_names(spark, sf_dir), _names(spark, sf_dir).select(F.lit("doc").alias("stem")).distinct())


def _items(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    failed = (F.col("turn") + F.col("conv_id")) % 4 == 0
    return c.select(F.col("conv_id").alias("group_id"), F.concat(F.lit("c"), F.col("conv_id")).alias("stem"), F.lit(2).alias("n"), (F.col("turn") + 1).alias("position"), F.when(~failed, F.when(F.col("turn") % 5 == 4, "jpg").otherwise("png")).alias("extension"), F.when(failed, "no data").alias("error"))


ITEMS_SQL = "WITH i AS (SELECT conv_id AS g, turn + 1 AS p, (turn + conv_id) % 4 = 0 AS failed, CASE WHEN turn % 5 = 4 THEN 'jpg' ELSE 'png' END AS e, greatest(2, count(*) OVER (PARTITION BY conv_id)) AS many FROM conversations)"


@query(ITEMS_SQL + " SELECT g AS group_id, p AS index, 'c' || g || '-' || lpad(CAST(p AS VARCHAR), CAST(length(CAST(many AS VARCHAR)) AS INTEGER), '0') || '.' || e AS name, 'c' || g || '-' || lpad(CAST(p AS VARCHAR), CAST(length(CAST(many AS VARCHAR)) AS INTEGER), '0') || '.json' AS sidecar FROM i WHERE NOT failed")
def output_names(spark, sf_dir):
    return artifacts.plan_outputs(_items(spark, sf_dir))[0].orderBy("group_id", "index")


@query(ITEMS_SQL + " SELECT g AS group_id, count(*) AS returned, bool_or(failed) AS partial, count(DISTINCT CASE WHEN NOT failed THEN e END) > 1 AS mixed, coalesce(arg_min(e, p) FILTER (NOT failed), 'png') AS group_extension FROM i GROUP BY g")
def output_groups(spark, sf_dir):
    return artifacts.plan_outputs(_items(spark, sf_dir))[1]


@query(ITEMS_SQL + " SELECT g AS group_id, CAST(count(*) AS INTEGER) AS failed, string_agg(p || ': no data', '; ' ORDER BY p) AS text FROM i WHERE failed GROUP BY g")
def output_failures(spark, sf_dir):
    return artifacts.failure_report(_items(spark, sf_dir))


@query("SELECT l_orderkey AS group_id, CAST(l_partkey AS VARCHAR) AS name, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def output_duplicates(spark, sf_dir):
    return artifacts.duplicate_outputs(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").cast("string").alias("name")))


@query("""WITH i AS (SELECT doc_id, p, (doc_id + p) % 3 AS k, text FROM documents, (VALUES (1), (2)) AS t(p))
SELECT doc_id AS response_id, CAST(p AS INTEGER) AS position, CASE WHEN k = 0 AND text <> '' THEN sha256(text) END AS sha, CASE WHEN k = 1 THEN 'u' || doc_id END AS url, CASE WHEN k = 0 AND text <> '' THEN 'content' WHEN k = 1 THEN 'pending' ELSE 'error' END AS status FROM i""")
def response_content(spark, sf_dir):
    k = F.col("doc_id")
    item = lambda p: F.struct(F.when((k + p) % 3 == 0, F.regexp_replace(F.base64(F.encode("text", "utf-8")), "\\s", "")).alias("b64_json"), F.when((k + p) % 3 == 1, F.concat(F.lit("u"), k)).alias("url"))
    rows = table(spark, sf_dir, "documents").select(k.alias("response_id"), F.array(item(1), item(2)).alias("items"))
    return artifacts.response_items(rows).select("response_id", "position", F.sha2("bytes", 256).alias("sha"), "url", "status")


@query("""SELECT 'd' || (p_partkey % 3) || '/' || (p_partkey // 3) || '.png' AS path, CASE WHEN p_partkey % 8 <> 3 THEN CASE p_partkey % 4 WHEN 0 THEN '#00ff00' WHEN 1 THEN '#ff00ff' WHEN 2 THEN '#808080' END END AS color FROM part""")
def sidecar_colors(spark, sf_dir):
    k = F.col("p_partkey")
    color = F.when(k % 4 == 0, "#00ff00").when(k % 4 == 1, "#ff00ff").when(k % 4 == 2, "#808080")
    part = table(spark, sf_dir, "part")
    body = F.parse_json(F.to_json(F.struct(F.struct(F.struct(color.alias("color")).alias("chroma")).alias("request")), {"ignoreNullFields": "false"}))
    # the same stems in each of three folders
    path = lambda ext: F.concat(F.lit("d"), k % 3, F.lit("/"), F.floor(k / 3), F.lit(ext)).alias("path")
    return artifacts.sidecar_keys(part.select(path(".png")), part.where(k % 8 != 3).select(path(".json"), body.alias("body")))


@query("""SELECT event_id, '{"b64_json":null,"b64":"x","inner":[{"image_b64":null,"n":' || (event_id % 3) || '}]}' AS response, 'a' || event_id AS kept FROM events""")
def nulled_payload_structs(spark, sf_dir):
    e = F.col("event_id")
    body = F.struct(F.concat(F.lit("p"), e).alias("b64_json"), F.lit("x").alias("b64"), F.array(F.struct(F.lit("i").alias("image_b64"), (e % 3).alias("n"))).alias("inner"))
    tags = F.create_map(F.lit("image_base64"), F.lit("z"), F.lit("n"), F.concat(F.lit("a"), e))
    rows = jsonops.null_payloads(table(spark, sf_dir, "events").select(e, body.alias("response"), tags.alias("tags")), ["response", "tags"])
    kept = F.when(F.col("tags")["image_base64"].isNull(), F.col("tags")["n"])
    return rows.select("event_id", F.to_json("response", {"ignoreNullFields": "false"}).alias("response"), kept.alias("kept"))


@query("SELECT event_id, '[redacted]' AS token, 'v' || event_id AS kept FROM events")
def redacted_maps(spark, sf_dir):
    e = F.col("event_id")
    data = F.create_map(F.lit("Token"), F.concat(F.lit("s"), e), F.lit("tokens"), F.concat(F.lit("v"), e))
    rows = jsonops.redact(table(spark, sf_dir, "events").select(e, data.alias("data")), ["data"])
    return rows.select("event_id", F.col("data")["Token"].alias("token"), F.col("data")["tokens"].alias("kept"))


@query(f"SELECT event_id, {LEVEL_SQL} AS level, {DATA_SQL} AS data FROM events WHERE event_type <> 'view'")
def logs_written_and_read(spark, sf_dir):
    path = new_path(spark, "logs")
    entries = _logs(spark, sf_dir).select(F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("time"), "level", F.col("event_id").cast("string").alias("message"), F.lit("v").alias("verb"), F.lit("s").alias("stage"), F.to_json("data").alias("data"))
    files.write_logs(entries, path)
    return files.read_logs(spark, path).where("_corrupt_record is null").select(F.col("message").cast("long").alias("event_id"), "level", "data")


@query("""SELECT p_partkey, p_partkey % 5 >= 2 AS rejected, CASE WHEN p_partkey % 5 < 2 THEN CAST(p_partkey AS VARCHAR) END AS stem, CASE WHEN p_partkey % 5 < 2 THEN p_brand END AS brand FROM part""")
def sidecar_scan(spark, sf_dir):
    k = F.col("p_partkey")
    good = F.to_json(F.struct("p_brand"))
    # broken, followed by text, or two values
    body = F.when(k % 5 == 4, F.lit("{no json")).when(k % 5 == 3, F.concat(good, F.lit(" trailing"))).when(k % 5 == 2, F.concat(good, good)).otherwise(good)
    good, bad = documents.parse_sidecars(table(spark, sf_dir, "part").select(F.concat(F.lit("x/"), k, F.lit(".json")).alias("path"), body.alias("value")))
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("p_partkey")
    return good.select(number, F.lit(False).alias("rejected"), "stem", F.try_variant_get("body", "$.p_brand", "string").alias("brand")).union(bad.select(number, F.lit(True), F.lit(None), F.lit(None)))


@query("""SELECT p_partkey, 'p ' || p_partkey AS stem, 'd' || (p_partkey % 3) AS folder, p_brand AS brand, '[redacted]' AS token, true AS nulled FROM part""")
def sidecars_written_and_read(spark, sf_dir):
    k, path = F.col("p_partkey"), new_path(spark, "sidecars")
    body = F.to_json(F.struct(k, "p_brand", F.struct(F.lit("s").alias("apiKey"), F.lit("x").alias("b64_json")).alias("request")))
    documents.write_sidecars(table(spark, sf_dir, "part").select(F.concat(F.lit("d"), k % 3, F.lit("/p "), k).alias("name"), body.alias("body")), path)
    of = lambda at, kind="string": F.try_variant_get("body", at, kind)
    rows = documents.read_sidecars(spark, path)[0]
    nulled = of("$.request", "string").contains('"b64_json":null').alias("nulled")
    return rows.select(of("$.p_partkey", "long").alias("p_partkey"), "stem", F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder"), of("$.p_brand").alias("brand"), of("$.request.apiKey").alias("token"), nulled)


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'invalid_json' WHEN 6 THEN 'invalid_json' WHEN 7 THEN 'invalid_json' WHEN 1 THEN 'invalid_section' WHEN 2 THEN 'invalid_section' WHEN 3 THEN 'invalid_section' END AS error, CASE WHEN event_id % 8 IN (4, 5) THEN event_id END AS n, CASE WHEN event_id % 8 = 4 THEN 'a,b' END AS tags FROM events""")
def settings_scan(spark, sf_dir):
    e = F.col("event_id")
    forms = ['{{"in": {{"n": {n}', '{{"in": {{"n": ["{n}"]}}}}', '{{"in": {{"n": "{n}"}}}}', '{{"in": {{"n": {n}, "tags": ["a", 1]}}}}', '{{"in": {{"n": {n}, "tags": ["a", "b"]}}, "other": 1}}', '{{"in": {{"n": {n}, "tags": null}}}}', '{{"in": {{"n": {n}}}}} x', '{{"in": {{"n": {n}}}}}{{}}']
    value = F.element_at(F.array(*(F.replace(F.lit(f.format(n="#")), F.lit("#"), e.cast("string")) for f in forms)), (e % 8 + 1).cast("int"))
    rows = files.parse_settings(table(spark, sf_dir, "events").select(e.cast("string").alias("path"), value.alias("value")), "in struct<n: bigint, tags: array<string>>")
    return rows.select(F.col("path").cast("long").alias("event_id"), "error", F.col("settings.in.n").alias("n"), F.array_join("settings.in.tags", ",").alias("tags"))


#: First bytes of image files and what they say, in the order of doc_id % 10.
HEADS = [("89504E470D0A1A0A", "png"), ("FFD8FFE0", "jpg"), ("474946383961", "gif"), ("524946460000000057454250", "webp"), ("000000206674797061766966", "avif"), ("000000206674797068656963", "heif"), ("49492A00", "tiff"), ("FF0A", "jxl"), ("00", "jpg"), ("0000000C4A584C20", "jxl")]


@query("SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(HEADS)) + " END AS format FROM documents")
def image_formats(spark, sf_dir):
    k = F.col("doc_id")
    head = F.unhex(F.element_at(F.array(*(F.lit(h) for h, _ in HEADS)), (k % 10 + 1).cast("int")))
    content = F.concat(head, F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return table(spark, sf_dir, "documents").select(k, files.image_format(content, F.concat(F.lit("a/b."), k, F.lit(".JPEG"))).alias("format"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '#112233' WHEN p_partkey % 3 > 0 THEN '#ff00ff' END AS key, CASE WHEN p_partkey % 5 < 2 THEN p_partkey % 5 = 1 ELSE true END AS preserve_interior,
CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS INTEGER) AS border_sample, CASE WHEN p_partkey % 7 = 0 THEN 0.5 END AS saturation_ratio FROM part""")
def mask_arguments(spark, sf_dir):
    k = F.col("p_partkey")
    chroma = F.struct(F.when(k % 3 == 0, "").otherwise("#ff00ff").alias("color"), F.lit(True).alias("preserve_interior"), F.col("p_size").cast("int").alias("border_sample"), F.when(k % 7 == 0, 0.5).alias("saturation_ratio"))
    rows = table(spark, sf_dir, "part").select(k, F.when(k % 2 == 0, "#112233").alias("key"), F.when(k % 5 < 2, k % 5 == 1).alias("preserve_interior"), F.when(k % 4 == 0, 0).alias("border_sample"), F.lit(None).cast("double").alias("saturation_ratio"), chroma.alias("chroma"))
    return jsonops.mask_defaults(rows).drop("chroma")


@query("""SELECT p_partkey, '{' || CASE WHEN p_partkey % 2 = 0 THEN '"size":' || p_size || ',' ELSE '' END || '"prompt":"p' || p_partkey || '","n":2' || CASE p_partkey % 3 WHEN 1 THEN ',"chroma":{"color":"#00ff00"}' ELSE '' END || '}' AS request FROM part""")
def request_records(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.when(k % 2 == 0, F.col("p_size")).alias("size"), F.concat(F.lit("p"), k).alias("prompt"), F.lit(2).alias("n"), F.when(k % 3 == 1, "#00ff00").when(k % 3 == 2, "").alias("chroma_color"))
    return jsonops.request_record(rows, ["size"]).select("p_partkey", "request")


@query("SELECT p_partkey, 'i' || p_partkey || '.icns,i' || p_partkey || '.ico,i' || p_partkey || '.png' || CASE WHEN p_partkey % 2 = 0 THEN ',i' || p_partkey || '-16.png,i' || p_partkey || '-512.png' ELSE '' END AS names FROM part")
def icon_files(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("i"), k)
    names = F.when(k % 2 == 0, F.array_join(text.icon_names(name, (16, 512)), ",")).otherwise(F.array_join(text.icon_names(name, (16, 512), False), ","))
    return table(spark, sf_dir, "part").select(k, names.alias("names"))


@query(f"SELECT 'doc' AS stem, 'Doc-' || doc_id || '.' || {EXT_SQL} AS name FROM documents ORDER BY name")
def sibling_order(spark, sf_dir):
    return artifacts.in_order(artifacts.siblings(_names(spark, sf_dir), _names(spark, sf_dir).select(F.lit("doc").alias("stem")).distinct()))


def _feed(spark, sf_dir, fields: list) -> str:
    """A folder of JSON Lines with the events as a feed."""
    path = new_path(spark, "feed")
    table(spark, sf_dir, "events").select(*fields).write.json(path)
    return path


@query(f"SELECT event_id, {LEVEL_SQL} AS level FROM events WHERE event_type <> 'error'")
def log_notified(spark, sf_dir):
    """A stream of entries whose batches a callback writes down."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "debug").when(F.col("event_type") == "signup", "warn").otherwise("info")
    path, out = _feed(spark, sf_dir, [F.col("event_id").cast("string").alias("message"), level.alias("level")]), new_path(spark, "notified")
    logs.notify(logs.log_progress_stream(spark, path), lambda batch: batch.write.mode("append").parquet(out), new_path(spark, "calls")).awaitTermination()
    return spark.read.parquet(out).select(F.col("message").cast("long").alias("event_id"), "level")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events WHERE event_type = 'error'")
def failures_noticed(spark, sf_dir):
    """A stream of failures, one notice for each path; all events are of one batch."""
    path, out = _feed(spark, sf_dir, [F.col("ts").alias("time"), F.col("user_id").cast("string").alias("path"), "event_type"]), new_path(spark, "noticed")
    feed = spark.readStream.schema("time timestamp, path string, event_type string").json(path)
    run = logs.failure_notices(feed.where("event_type = 'error'")).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "notices"))
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("path")


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (1, 2, 3) THEN '"[unreadable]"' WHEN event_id % 5 = 0 THEN '{"Token":"[redacted]","n":' || event_id || '}' END AS data, event_id % 5 IN (1, 2, 3) AS bad FROM events""")
def unreadable_json(spark, sf_dir):
    """Redacted text beside the mark of what is no JSON: text that follows, two values, a broken one."""
    e = F.col("event_id")
    good = F.concat(F.lit('{"Token":"s","n":'), e, F.lit("}"))
    text_ = F.when(e % 5 == 0, good).when(e % 5 == 1, F.concat(good, F.lit(" token=x"))).when(e % 5 == 2, F.concat(good, good)).when(e % 5 == 3, F.lit('{"Token":'))
    return table(spark, sf_dir, "events").select(e, jsonops.redact_json(text_).alias("data"), jsonops.unreadable(text_).alias("bad"))
