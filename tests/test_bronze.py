"""Match documents: packing into tasks, competitions from paths, isolation."""

import json
import os

from formbook.sources import bronze

DOC = {"info": {"season": "2024", "teams": ["A", "B"]}, "innings": []}


def land(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, body in files.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(body)


def config(spark, *codes):
    return spark.createDataFrame([(c, True) for c in codes], "competition_code string, is_active boolean")


def test_tasks_follow_bytes_and_not_matches(spark, tmp_dir):
    for code in range(12):
        land(f"{tmp_dir}/c{code}", {f"{code * 1000 + i}.json": json.dumps(DOC, indent=1) for i in range(40)})
    docs, status = bronze.read_competitions(spark, tmp_dir, config(spark, *[f"c{i}" for i in range(12)]))
    assert docs.count() == 480 and status.where("ok").count() == 12
    cores = spark.sparkContext.defaultParallelism
    assert docs.rdd.getNumPartitions() <= cores + 1
    assert bronze.read_match_documents(spark, f"{tmp_dir}/*/*.json").rdd.getNumPartitions() <= cores + 1
    assert sorted((r.competition, int(r.match_id)) for r in docs.select("competition", "match_id").collect()) == sorted(
        (f"c{c}", c * 1000 + i) for c in range(12) for i in range(40))


def test_competition_names_of_any_kind(spark, tmp_dir):
    names = ["A+B", "C D", "50%", "x=y", "\u00dc"]
    for i, name in enumerate(names):
        land(f"{tmp_dir}/in/{name}", {f"{i}.json": json.dumps(DOC)})
    docs, _ = bronze.read_competitions(spark, f"{tmp_dir}/in", config(spark, *names))
    assert {r.competition: r.match_id for r in docs.collect()} == {n: str(i) for i, n in enumerate(names)}
    got = bronze.ingest_competitions(spark, f"{tmp_dir}/in", config(spark, *names), f"{tmp_dir}/out")
    assert {r.competition: (r.ok, r.documents) for r in got.collect()} == {n: (True, 1) for n in names}
    held = spark.read.option("basePath", f"{tmp_dir}/out").parquet(f"{tmp_dir}/out/competition=*")
    assert {r.competition: r.match_id for r in held.collect()} == {n: str(i) for i, n in enumerate(names)}


def test_ingest_again_replaces_what_is_whole_and_keeps_the_rest(spark, tmp_dir):
    land(f"{tmp_dir}/in/a", {"1.json": json.dumps(DOC), "2.json": json.dumps(DOC, indent=2)})
    land(f"{tmp_dir}/in/b", {"3.json": json.dumps(DOC)})
    args = (spark, f"{tmp_dir}/in", config(spark, "a", "b", "none"), f"{tmp_dir}/out")
    first = {r.competition: r for r in bronze.ingest_competitions(*args).collect()}
    assert (first["a"].documents, first["b"].documents, first["none"].error) == (2, 1, "no files")
    land(f"{tmp_dir}/in/a", {"4.json": json.dumps(DOC)})
    land(f"{tmp_dir}/in/b", {"5.json": json.dumps(DOC)[:20], "6.json": ""})
    second = {r.competition: r for r in bronze.ingest_competitions(*args).collect()}
    assert (second["a"].ok, second["a"].documents) == (True, 3)
    assert not second["b"].ok and second["b"].documents is None and "1 malformed" in second["b"].error
    ids = {c: sorted(r.match_id for r in spark.read.parquet(f"{tmp_dir}/out/competition={c}").collect()) for c in "ab"}
    assert ids == {"a": ["1", "2", "4"], "b": ["3"]}
    assert sorted(f for f in os.listdir(f"{tmp_dir}/out") if f.startswith("_")) == []


def test_nothing_to_read(spark, tmp_dir):
    docs, status = bronze.read_competitions(spark, tmp_dir, config(spark, "a"))
    assert docs is None and [tuple(r) for r in status.collect()] == [("a", False, "no files")]
    assert [tuple(r) for r in bronze.ingest_competitions(spark, tmp_dir, config(spark, "a"), f"{tmp_dir}/o").collect()] == [
        ("a", False, None, "no files")]


def test_inferred_scan_keeps_people_a_map(spark, tmp_dir):
    """The people of all documents are keys of a map and no fields of the
    inferred schema; other fields are as the documents have them."""
    docs = {f"{i}.json": json.dumps({"info": {"season": str(2000 + i), "overs": i, "dates": [f"2024-01-{i + 10}"],
                                              "registry": {"people": {f"P{i} Ü.\"x": f"id{i}", "Q": "q"}}},
                                     "innings": [{"team": "A", "overs": []}], "meta": {"k": 1}}, indent=1) for i in range(20)}
    land(f"{tmp_dir}/in/a", docs | {"99.json": '{"info": {"season": "20'})
    schema = bronze.inferred_schema(spark, [f"{tmp_dir}/in/a/*.json"])
    assert schema["info"].dataType["registry"].dataType["people"].dataType.simpleString() == "map<string,string>"
    assert len(schema.json()) < 2000 and schema["info"].dataType["overs"].dataType.simpleString() == "bigint"
    columns = ["match_id", "season", "overs_per_innings", "dates", "player_registry", "teams", "outcome_by_runs"]
    got, want = (bronze.read_competitions(spark, f"{tmp_dir}/in", config(spark, "a"), infer_schema=infer)[0].select(*columns)
                 for infer in (True, False))
    assert got.schema == want.schema or [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    key = lambda r: r.match_id
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert next(r for r in got.collect() if r.match_id == "3").player_registry == {"P3 Ü.\"x": "id3", "Q": "q"}
