"""JSON, text, files and streams."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import jsonops, text
from tessera.operators import artifacts
from tessera.sources import files, sidecars
from tessera.streaming import logs


def png(width, height, rgba):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes(rgba[y * width * 4 : (y + 1) * width * 4]) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_redaction_takes_whole_names_in_any_case(spark):
    body = {"Token": 1, "tokenCount": 2, "list": [{"APIKEY": None, "n": None}], "password": {"x": 1}}
    got = json.loads(one(spark, json.dumps(body), jsonops.redact_json))
    assert got == {"Token": "[redacted]", "tokenCount": 2, "list": [{"APIKEY": "[redacted]", "n": None}], "password": "[redacted]"}
    assert one(spark, None, jsonops.redact_json) is None


def test_payload_names_are_exact(spark):
    assert json.loads(one(spark, '{"b64_json": "x", "B64_JSON": "y"}', jsonops.null_payloads_json)) == {"b64_json": None, "B64_JSON": "y"}


@pytest.mark.parametrize("given, want", [("　 a \r\n\n b\t", "a b"), ("", ""), ("  ", ""), ("a  b", "a  b")])
def test_single_line(spark, given, want):
    assert one(spark, given, text.single_line) == want


@pytest.mark.parametrize("given, want", [("\n\na  \r\n\r\n\r\nb\n", "a\n\n\nb"), ("", ""), ("\n \n", "")])
def test_multiline(spark, given, want):
    assert one(spark, given, text.multiline) == want


def test_blank_runs_collapse(spark):
    assert one(spark, "a\n\n \n\nb", lambda c: text.multiline(c, collapse_blank=True)) == "a\n\nb"


@pytest.mark.parametrize("path, want", [("x/a.b.png", "a.b"), (".env", ".env"), ("x/.a.png", ".a"), ("plain", "plain")])
def test_stems(spark, path, want):
    assert one(spark, path, text.stem) == want


def test_images_are_read_and_listed(spark, tmp_path):
    rgba = [1, 2, 3, 4, 5, 6, 7, 255]
    (tmp_path / "a.png").write_bytes(png(2, 1, rgba))
    (tmp_path / "b.png").write_bytes(b"no image")
    good, bad = files.read_images(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in files.explode_pixels(good).orderBy("x").collect()] == [(0, 0, 1, 2, 3, 4), (0, 1, 5, 6, 7, 255)]
    assert bad.count() == 1
    listed = {r["path"].rsplit("/", 1)[1]: r for r in files.inventory(spark, str(tmp_path)).collect()}
    assert (listed["a.png"]["format"], listed["a.png"]["width"], listed["a.png"]["height"]) == ("png", 2, 1)


def test_sidecars_settings_and_logs(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"request": {"chroma": {"color": "#00ff00"}}}')
    (tmp_path / "s" / "b.json").write_text("{no")
    good, bad = sidecars.read_sidecars(spark, str(tmp_path / "s"))
    assert good.first()["stem"] == "a" and bad.count() == 1
    assert files.read_settings(spark, str(tmp_path / "none"), "n int", required=False).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_settings(spark, str(tmp_path / "none"), "n int")
    (tmp_path / "t").mkdir()
    for name, body in (("1", '{"n": 3}'), ("2", "{"), ("3", '{"n": [1]}'), ("4", "")):
        (tmp_path / "t" / name).write_text(body)
    rows = files.read_settings(spark, str(tmp_path / "t"), "n int").orderBy("path").collect()
    assert [r["error"] for r in rows] == [None, "invalid_json", "invalid_section", "invalid_json"] and rows[0]["settings"]["n"] == 3


def test_log_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"level": "error", "data": '{"secret": 1}'}, {"level": "debug", "data": None}, {"level": "info", "data": "{}"}]
    (tmp_path / "in" / "x.json").write_text("\n".join(json.dumps({"time": "2026-01-01T00:00:00Z", "message": "m", "verb": "v", "stage": "s"} | r) for r in lines))
    run = logs.log_persist_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination(60)
    kept = files.read_logs(spark, str(tmp_path / "out")).orderBy("level").collect()
    assert [(r["level"], r["data"]) for r in kept] == [("error", '{"secret":"[redacted]"}'), ("info", "{}")]
    seen = []
    logs.notify(logs.log_progress_stream(spark, str(tmp_path / "in")), lambda batch: seen.extend(r["level"] for r in batch.collect()), str(tmp_path / "cp2")).awaitTermination(60)
    assert sorted(seen) == ["debug", "info"]
    assert logs.enabled(" TRUE ") and logs.enabled("1") and not logs.enabled(None) and not logs.enabled("yes")


def test_secrets_in_maps_and_variants(spark):
    rows = spark.sql("SELECT map('Token', 'S', 'n', 'x') AS m, map('token', map('a', 1)) AS k, named_struct('in', map('password', array('p'))) AS s, map('b64_json', 'x', 'n', 'y') AS z, parse_json('{\"token\": 1}') AS v")
    got = jsonops.redact(rows, ["m", "k", "s"]).first()
    assert (got["m"], got["k"], got["s"]["in"]) == ({"Token": "[redacted]", "n": "x"}, {"token": None}, {"password": None})
    assert jsonops.null_payloads(rows, ["z"]).first()["z"] == {"b64_json": None, "n": "y"}
    for fn in (jsonops.redact, jsonops.null_payloads):
        with pytest.raises(ValueError, match="VARIANT"):
            fn(rows, ["v"])
    entries = rows.selectExpr("'info' AS level", "m AS data")
    assert logs.persisted(entries).first()["data"]["Token"] == "[redacted]"
    with pytest.raises(ValueError, match="VARIANT"):
        logs.persisted(rows.selectExpr("'info' AS level", "v AS data"))


def test_unreadable_json_never_passes_and_never_fails(spark):
    bad = ["{token: SEKRET", "[" * 50_000, '{"token": "x"} more', '{"a": 1}{"b": 2}', "NaN", "", "1] x [2", '{"a": 1}]', "\ufeff{}"]
    rows = spark.createDataFrame([('{"token": "x"}',), (None,), (' {"a": {}, "a": [true]}\n',), *((x,) for x in bad)], "v string")
    got = rows.select(jsonops.redact_json(F.col("v")).alias("r"), jsonops.null_payloads_json(F.col("v")).alias("p"), jsonops.unreadable(F.col("v")).alias("bad")).collect()
    assert [r["r"] for r in got] == ['{"token":"[redacted]"}', None, '{"a":[true]}'] + ['"[unreadable]"'] * len(bad)
    assert [r["p"] for r in got][3:] == ['"[unreadable]"'] * len(bad) and [r["bad"] for r in got] == [False] * 3 + [True] * len(bad)


def test_strict_json_takes_one_whole_value(spark):
    good = ['{"x": 1}', "null", '"s"', " [1, 2]\n", "true", "-0.5", '{"k": "]"}', "{}"]
    bad = ['{"x":1} more', '{"x":1}{"y":2}', "1,2", "1, 2]", "1] x [2", '{"x":1},', "", "  ", "tru", '{"a":1,"a":2}', '1,"x"', None]
    rows = spark.createDataFrame([(x,) for x in good + bad], "c string").select(F.to_json(jsonops.strict_json(F.col("c"))).alias("j")).collect()
    assert [r["j"] for r in rows] == ['{"x":1}', "null", '"s"', "[1,2]", "true", "-0.5", '{"k":"]"}', "{}"] + [None] * len(bad)


def test_nothing_may_follow_settings_and_verdicts(spark):
    rows = spark.createDataFrame([("a", '{"n": 3} x'), ("b", '{"n": 3}{"n": 4}'), ("c", '{"n": 3}')], "path string, value string")
    assert [r["error"] for r in files.parse_settings(rows, "n int").orderBy("path").collect()] == ["invalid_json", "invalid_json", None]
    answer = '{"ok": true, "score": 1, "reasons": []}'
    answers = spark.createDataFrame([(k, None, "stop", answer + more) for k, more in enumerate(("", " and more", answer, "]"))], "response_id int, refusal string, finish_reason string, content string")
    assert [r["status"] for r in jsonops.parse_verdicts(answers).orderBy("response_id").collect()] == ["verdict"] + ["not_json"] * 3


def test_settings_of_wrong_types(spark):
    bodies = ['{"n": 3, "s": {"t": ["a"]}}', "{", '{"n": [1]}', '{"n": "x"}', '{"n": 1.5}', '{"s": 4}', '{"s": {"t": [1]}}', "[]", '{"n": null, "more": 1}', '{"n": 99999999999}']
    rows = files.parse_settings(spark.createDataFrame(list(enumerate(bodies)), "path int, value string"), "n int, s struct<t: array<string>>").orderBy("path").collect()
    assert [r["error"] for r in rows] == [None, "invalid_json", *["invalid_section"] * 6, None, "invalid_section"]
    assert rows[0]["settings"]["s"]["t"] == ["a"] and rows[8]["settings"]["n"] is None and rows[3]["settings"] is None


def test_stamps_in_another_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.sql("SELECT timestamp'2026-01-01 00:00:00.125Z' AS t UNION ALL SELECT timestamp'2026-03-08 07:30:00Z' UNION ALL SELECT timestamp'2026-11-01 05:30:00Z' UNION ALL SELECT null")
        got = [tuple(r) for r in rows.select(text.utc_stamp(F.col("t")), text.utc_stamp(F.col("t"), True)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [("20260101-000000-utc", "20260101-000000-125-utc"), ("20260308-073000-utc", "20260308-073000-000-utc"), ("20261101-053000-utc", "20261101-053000-000-utc"), (None, None)]


def test_budgets_need_finite_numbers(spark):
    defaults = spark.createDataFrame([(k, 5, 2, [1.0]) for k in "abcd"], "category string, timeout int, max_retries int, retry_intervals array<double>")
    given = [("a", 7, 0, [0.0, 3.0]), ("b", 0, -1, [float("nan")]), ("c", None, None, [float("inf")]), ("d", 1, 1, [None])]
    rows = jsonops.layer_budgets(defaults, spark.createDataFrame(given, defaults.schema)).orderBy("category").collect()
    assert [tuple(r)[1:] for r in rows] == [(7, 0, [0.0, 3.0]), (5, 2, [1.0]), (5, 2, [1.0]), (1, 1, [1.0])]


def test_arrays_of_settings_are_joined_patch_first(spark):
    rows = spark.sql("SELECT named_struct('a', array(1), 'b', array(1), 'c', 1) AS x, named_struct('a', array(2), 'b', cast(null AS array<int>), 'c', 2) AS y")
    assert rows.select(jsonops.deep_merge(F.col("x"), F.col("y"), rows.schema["x"].dataType).alias("m")).first()["m"] == ([2, 1], [1], 2)


def test_sidecars_belong_to_their_folder(spark):
    images = spark.createDataFrame([("x/1.png",), ("y/1.png",), ("1.png",), ("x/deep/1.png",)], "path string")
    sidecars = spark.createDataFrame([("x/1.json", "#000001"), ("y/1.json", "#000002"), ("1.json", None)], "path string, c string")
    body = F.parse_json(F.to_json(F.struct(F.struct(F.struct(F.col("c").alias("color")).alias("chroma")).alias("request"))))
    got = {r["path"]: r["color"] for r in artifacts.sidecar_keys(images, sidecars.select("path", body.alias("body"))).collect()}
    assert got == {"x/1.png": "#000001", "y/1.png": "#000002", "1.png": None, "x/deep/1.png": None}


def test_siblings_in_order(spark):
    names = spark.createDataFrame([(n,) for n in ("a-10.png", "A-2.jpg", "a.json", "b.png", "a-x.png", "a.svg")], "name string")
    found = artifacts.in_order(artifacts.siblings(names, spark.createDataFrame([("a",), ("b",)], "stem string")))
    assert [tuple(r) for r in found.collect()] == [("a", "A-2.jpg"), ("a", "a-10.png"), ("a", "a.json"), ("b", "b.png")]


def test_written_logs_are_appended_and_redacted(spark, tmp_path):
    entry = lambda level, data: spark.createDataFrame([(level, data)], "level string, data string")
    files.write_logs(entry("info", '{"secret": 1}'), str(tmp_path / "l"))
    files.write_logs(entry("debug", "{}"), str(tmp_path / "l"), debug="1")
    files.write_logs(entry("debug", "{}"), str(tmp_path / "l"))
    assert sorted((r["level"], r["data"]) for r in files.read_logs(spark, str(tmp_path / "l")).collect()) == [("debug", "{}"), ("info", '{"secret":"[redacted]"}')]


def test_one_notice_for_each_path(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [("2026-01-01T00:00:00Z", "a"), ("2026-01-01T00:00:05Z", "a"), ("2026-01-01T00:00:07Z", "b"), ("2026-01-01T00:00:09Z", "a")]
    (folder / "x.json").write_text("\n".join(json.dumps({"time": t, "path": p}) for t, p in rows))
    stream = logs.failure_notices(spark.readStream.schema("time timestamp, path string").json(str(folder)))
    run = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r["path"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_pixels_round_trip_and_masks_of_images(spark, tmp_path):
    rows = [(1, y, x, 10 * y, 20 * x, 5, 255) for y in range(3) for x in range(4) if (y, x) != (1, 2)]
    pixels = spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int, a int")
    whole = files.densify(pixels, spark.createDataFrame([(1, 4, 3)], "image_id int, width int, height int"))
    assert whole.count() == 12 and tuple(whole.where("y = 1 and x = 2").first()) == (1, 1, 2, 0, 0, 0, 0)
    files.write_pixels(whole, str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == sorted(map(tuple, whole.collect()))
    with pytest.raises(Exception, match="exists"):
        files.write_pixels(whole, str(tmp_path / "p"))
    assert {(r["y"], r["x"]): r["a"] for r in files.as_mask(pixels).collect()}[2, 3] == int(0.2126 * 20 + 0.7152 * 60 + 0.0722 * 5 + 0.5)


def test_text_patterns_take_linear_time(spark):
    blank = " " * 300_000
    c = F.col("v")
    rows = spark.createDataFrame([(f"{blank}x{blank}\ny{blank}{chr(10) * 300_000}",)], "v string")
    got = rows.select(text.single_line(c), text.single_line(c, minify=True), text.multiline(c), text.trimmed(c)).first()
    assert (got[0], got[1], got[2]) == ("x y", "x y", f"{blank}x\ny") and len(got[3]) == 300_003


@pytest.mark.parametrize("given, want", [("\n \na  \n b \n \n", "a  \n b "), (" \n ", ""), ("a", "a"), ("\r\na\rb\r\n", "a\nb"), (None, None)])
def test_edges_without_trimming(spark, given, want):
    assert one(spark, given, lambda c: text.multiline(c, trim_line_ends=False)) == want


def test_names_listed_twice(spark):
    manifest = spark.createDataFrame([(k, k, "x") for k in "abcd"] + [("a", "a", None)], "key string, name string, expected string")
    listed = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "x"), ("c", None)], "name string, actual string")
    got = [tuple(r)[1:] for r in artifacts.verify_integrity(manifest, listed).orderBy("key", "integrity").collect()]
    assert got == [("a", "ok"), ("a", "unverifiable"), ("b", "mismatch"), ("c", "mismatch"), ("d", "missing")]
    sizes = spark.createDataFrame([(k, k, 10) for k in "abc"], "key string, name string, byte_size int")
    files_ = spark.createDataFrame([("a", True, 10), ("a", True, 10), ("b", True, 10), ("b", True, 11), ("c", True, 10), ("c", False, 10)], "name string, is_file boolean, length int")
    assert [r["present"] for r in artifacts.list_cached(sizes, files_).orderBy("key").collect()] == [True, False, False]


def test_responses_without_items_have_a_row(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [("aGk=", None), (None, "u")])], "response_id int, items array<struct<b64_json: string, url: string>>")
    got = [(r["response_id"], r["position"], r["status"]) for r in artifacts.response_items(rows).orderBy("response_id", "position").collect()]
    assert got == [(1, None, "no_items"), (2, None, "no_items"), (3, 1, "content"), (3, 2, "pending")]


def feed(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_a_stopped_stream_calls_once_for_each_batch(spark, tmp_path):
    folder, checkpoint, seen, fails = tmp_path / "in", str(tmp_path / "cp"), [], [True]

    def callback(batch):
        got = sorted(r["message"] for r in batch.collect())
        if "b" in got and fails:
            raise RuntimeError(fails.pop())
        seen.append(got)

    def run():
        logs.notify(logs.log_progress_stream(spark, str(folder)), callback, checkpoint).awaitTermination(60)

    feed(folder, "1.json", [{"level": "info", "message": "a"}])
    run()
    feed(folder, "2.json", [{"level": "info", "message": "b"}])
    with pytest.raises(Exception, match="True"):
        run()
    assert seen == [["a"]]
    run()  # the call that failed comes again, the other one doesn't
    assert seen == [["a"], ["b"]]
    (tmp_path / "cp" / "commits" / "1").unlink()  # as if the stream had died after the call, before its record
    for crc in (tmp_path / "cp" / "commits").glob(".1.crc"):
        crc.unlink()
    run()
    feed(folder, "3.json", [{"level": "info", "message": "c"}, {"level": "error", "message": "d"}])
    run()
    assert seen == [["a"], ["b"], ["c"]]


def test_notices_are_remembered_over_a_restart_and_forgotten_in_time(spark, tmp_path):
    folder = tmp_path / "in"

    def run():
        stream = logs.failure_notices(spark.readStream.schema("time timestamp, path string").json(str(folder)), "10 minutes")
        query = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination(60)
        return sorted((r["path"], r["time"]) for r in spark.read.schema("time string, path string").json(str(tmp_path / "out")).collect())

    at = lambda h, m: f"2026-01-01T{h:02}:{m:02}:00.000Z"
    feed(folder, "1.json", [{"time": at(0, 0), "path": "a"}, {"time": at(0, 1), "path": "b"}])
    assert run() == [("a", at(0, 0)), ("b", at(0, 1))]
    feed(folder, "2.json", [{"time": at(0, 5), "path": "a"}, {"time": at(0, 6), "path": "c"}])
    assert [p for p, _ in run()] == ["a", "b", "c"]
    feed(folder, "3.json", [{"time": at(5, 0), "path": "d"}])  # the watermark passes all that was
    run()
    feed(folder, "4.json", [{"time": at(5, 1), "path": "a"}])
    assert [p for p, _ in run()] == ["a", "a", "b", "c", "d"]
