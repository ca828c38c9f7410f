"""Readers and writers, round trip through folders."""

import json

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import chain, decode
from evidencelake.sources import bundles

GOOD = {"bundle_id": "b1", "references": [{"id": "r1", "title": "T", "authors": ["A", "B"], "year": 2020, "x": None}], "tasks": [{"id": "t", "name": "pred"}], "reference_tasks": [{"id": "k", "task_id": "t"}], "task_extractions": [{"id": "e", "reference_task_id": "k", "schema_name": "s", "extracted": [{"Model": " n/a "}, {"Other": "v"}]}]}


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a.canonical.json": json.dumps(GOOD), "b.canonical.json": json.dumps({"references": [{"id": "r2"}]}), "c.canonical.json": "{bad", "d.canonical.json": "[1]", "e.canonical.json": json.dumps({"references": ["no object"]}), "f.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_bundles_are_read_merged_and_read_again(spark, folder, tmp_path):
    found = bundles.read_bundles(spark, folder)
    assert {r["file_name"]: r["bundle_id"] for r in found.collect()} == {"a.canonical.json": "b1", "b.canonical.json": "b"}
    assert {r["file_name"]: r["status"] for r in bundles.file_status(spark, folder).collect()} == {"a.canonical.json": "OK", "b.canonical.json": "OK", "c.canonical.json": "ERROR", "d.canonical.json": "WARN", "e.canonical.json": "OK", "f.json": "OK"}
    bundles.write_bundles(found.where("bundle_id = 'b1'"), str(tmp_path / "merged"))
    again = bundles.read_bundle_lines(spark, str(tmp_path / "merged"))
    assert [json.loads(r[0]) for r in again.select(F.to_json("doc")).collect()] == [GOOD]
    assert decode.flatten(again, "references").select("id", "title", "authors", "year").collect() == [("r1", "T", ["A", "B"], 2020)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        bundles.read_bundles(spark, folder + "/absent").count()


def test_folder_to_tables(spark, folder):
    rows = chain.document_rows(bundles.read_bundles(spark, folder).where("bundle_id = 'b1'"), F.upper)
    raw, clean, log = chain.run(rows, {}, {"n/a": "Not Applicable"})
    assert set(raw) == {"Reading List", "PRED"}
    assert sorted((r["Model"], r["Other"], r["source_page_id"], r["source_title"], r["schema_name"]) for r in clean["PRED"].collect()) == [("", "v", "r1", "T", "s"), ("Not Applicable", "", "r1", "T", "s")]
    assert raw["Reading List"].select("authors", "year", "page_id").collect() == [("A; B", "2020", "r1")]
    assert {r["table_name"]: (r["n_rows"], r["changed_cells"]) for r in log.collect()} == {"Reading List": (1, 0), "PRED": (2, 1)}


def test_items_of_a_reference_manager(spark):
    data = "struct<title:string,creators:array<struct<lastName:string,firstName:string,name:string>>,date:string,publicationTitle:string,journalAbbreviation:string,DOI:string,url:string,abstractNote:string,itemType:string,tags:array<struct<tag:string>>>"
    rows = [("K1", 7, ("T", [("Doe", "J", None), (None, None, "Group"), ("Solo", "", None)], "2021-03", "", "J. Abbr", "", "u", None, "journalArticle", [("x",), ("y",)])), ("K2", 8, (None, None, "n.d.", None, None, None, None, None, None, None))]
    found = {r["id"]: r for r in decode.item_reference(spark.createDataFrame(rows, f"key string, version int, data {data}")).collect()}
    one = found["K1"]
    assert (one["authors"], one["year"], one["journal"], one["doi"], one["tags"], one["version"]) == (["Doe, J", "Group", "Solo"], 2021, "J. Abbr", None, ["x", "y"], 7)
    assert found["K2"]["year"] is None


def test_tables_are_written_by_kind_and_by_task(spark, tmp_path):
    df = spark.createDataFrame([("a", "X", [1]), ("b", "Y", None)], "id string, task string, l array<int>").withColumn("v", F.parse_json(F.lit('{"k":[1]}')))
    for kind in ("json", "parquet"):
        bundles.write_table(df, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 2
    bundles.write_table(df, str(tmp_path / "csv"), "csv")
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect())) == [("a", "X", "[1]", '{"k":[1]}'), ("b", "Y", None, '{"k":[1]}')]
    bundles.write_by_task(df.drop("v").withColumn("l", F.to_json("l")), str(tmp_path / "tasks"))
    assert (tmp_path / "tasks" / "task=X").is_dir() and (tmp_path / "tasks" / "task=Y").is_dir()


def test_log_by_days(spark, tmp_path):
    path, snapshots = str(tmp_path / "log"), str(tmp_path / "snapshots")
    required = dict.fromkeys(bundles.LOG_REQUIRED, None)
    rows = [required | {"operation_id": str(i), "timestamp": f"2024-01-{i:02d}T10:00:00", "entity_type": "references", "entity_id": "r", "field": "title", "new_value": f"v{i}", "status": "applied", "session_id": "s"} for i in range(1, 10)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in bundles.LOG_REQUIRED))
    with pytest.raises(ValueError, match="actor"):
        bundles.append_log(df.drop("actor"), path)
    bundles.append_log(df, path)
    bundles.append_log(df.drop("session_id").limit(1), path, "later")
    log = bundles.read_log(spark, path)
    assert log.count() == 10 and bundles.read_log(spark, path, "later").count() == 1  # null values pass
    bundles.snapshot_states(spark, path, snapshots, "2024-01-04")
    bundles.snapshot_states(spark, path, snapshots, "2024-01-06")
    state = bundles.state_as_of(spark, path, snapshots, "2024-01-08T09:00:00")
    assert [r["new_value"] for r in state.collect()] == ["v7"]
    days = {f.split("log_date=")[1][:10] for f in state.inputFiles() if "log_date=" in f}
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and days <= {f"2024-01-{i:02d}" for i in range(1, 10)}
    assert bundles.prune_log(spark, path, "2024-01-05") == [f"2024-01-{i:02d}" for i in range(1, 5)]
    assert bundles.read_log(spark, path).count() == 5
    assert [r["new_value"] for r in bundles.state_as_of(spark, path, snapshots, "2024-01-08T09:00:00").collect()] == ["v7"]
