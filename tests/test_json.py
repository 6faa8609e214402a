"""JSON as strings with paths, and reports with faults, by literal expectations."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cloakwork.plans import privacy
from cloakwork.sources.json_paths import strings_of
from cloakwork.sources.reports import read_reports, write_reports


def test_strings_and_keys_of_nested_values(spark):
    texts = ['{"a":"x","b":[1,"y",{"c":"z"}],"d":null,"e":{"f":2.5,"g":{}},"h":[]}', '"s"', "bad", None, "[]", '[[["d"]]]', '"[]"', '{"context":{"visualPrivacy":{"schema":"4111111111111111","other":"o"}}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "path_ int, v string").withColumnRenamed("path_", "k")
    got = {}
    for r in strings_of(rows, "v").collect():
        got.setdefault(r.k, []).append((r.path, r.string))
    assert {k: sorted(v) for k, v in got.items()} == {
        0: sorted([("root", k) for k in "abdeh"] + [("root.a", "x"), ("root.b.1", "y"), ("root.b.2", "c"), ("root.b.2.c", "z"), ("root.e", "f"), ("root.e", "g")]),
        1: [("root", "s")], 5: [("root.0.0.0", "d")], 6: [("root", "[]")],
        7: sorted([("root", "context"), ("root.context", "visualPrivacy"), ("root.context.visualPrivacy", "schema"), ("root.context.visualPrivacy", "other"), ("root.context.visualPrivacy.other", "o")]),
    }
    deep = spark.createDataFrame([("[" * 30 + '"a@b.example"' + "]" * 30,)], "v string")
    assert "a@b.example" in strings_of(deep, "v").first().string


def test_leaks_need_no_python(spark):
    plan = privacy.a29_leaks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_reports_in_lines_and_whole_files(spark, tmp_path):
    step = {"name": "a", "exitCode": 0, "fresh": True, "elapsedMs": 5}
    good = {"runId": "r1", "generatedAt": "2024-01-01T00:00:00Z", "sourceFingerprint": None, "steps": [step], "unknown": 1}
    lines = [json.dumps(good), '{"runId": "r2", ', json.dumps(good | {"runId": ""}), json.dumps(good | {"steps": None}), json.dumps(good | {"steps": [{**step, "name": None}]}), json.dumps(good | {"steps": "no"}), json.dumps(good | {"generatedAt": None})]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.json").write_text("\n".join(lines))
    reports, faults = read_reports(spark, f"{tmp_path}/lines")
    assert [r.runId for r in reports.collect()] == ["r1"]
    assert sorted(r.reason for r in faults.collect()) == ["a step without name or code", "no run", "no steps", "no time", "not JSON of this schema", "not JSON of this schema"]
    assert '{"runId": "r2", ' in {r.text for r in faults.collect()}
    write_reports(reports.drop("file"), f"{tmp_path}/out")
    again, none = read_reports(spark, f"{tmp_path}/out")
    assert again.drop("file").collect() == reports.drop("file").collect() and none.count() == 0
    (tmp_path / "files").mkdir()
    for n, text in enumerate((json.dumps(good, indent=2), json.dumps(good, indent=2)[:-9])):
        (tmp_path / "files" / f"{n}.json").write_text(text)
    reports, faults = read_reports(spark, f"{tmp_path}/files", whole_files=True)
    assert [r.file for r in reports.collect()] == ["0.json"] and [r.file for r in faults.collect()] == ["1.json"]
    assert reports.select(F.size("steps")).first()[0] == 1
