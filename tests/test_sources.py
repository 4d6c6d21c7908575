import os

import pytest
from conftest import rows

from flockframe.sources import readers, schemas, writers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_observation_exports_of_several_regions(spark, tmp_path):
    head = "checklist_id\tcommon_name\tobservation_count\tstate\tcountry\tcountry_code\tstate_code\tapproved\n"
    a = write(tmp_path / "a.txt", head + "c1\tDunlin\t3\tMaine\tUnited States\tUS\tUS-ME\ttrue\n")
    b = write(tmp_path / "b.txt", head + "c2\tDunlin\tX\t\tCanada\tCA\tCA-ON\tfalse\n")
    got = rows(readers.read_observations(spark, [a, b]).select("checklist_id", "observation_count", "state"))
    assert got == [("c1", "3", "Maine"), ("c2", "X", None)]
    joined = readers.append_regions(readers.read_observations(spark, a),
                                    readers.read_observations(spark, b).drop("state"))
    assert joined.count() == 2 and joined.filter("state is null").count() == 1


def test_event_types(spark, tmp_path):
    cols = [c.strip().split()[0] for c in schemas.EVENTS.split(",")]
    vals = {"checklist_id": "c1", "observation_date": "2020-08-01", "latitude": "44.5", "number_observers": "2",
            "all_species_reported": "true", "time_observations_started": "08:30:00"}
    path = write(tmp_path / "s.txt", "\t".join(cols) + "\n" + "\t".join(vals.get(c, "") for c in cols) + "\n")
    r = readers.read_events(spark, path).first()
    assert (str(r.observation_date), r.latitude, r.number_observers, r.duration_minutes) == ("2020-08-01", 44.5, 2, None)


def test_lookup_with_na(spark, tmp_path):
    path = write(tmp_path / "species.csv", "Species,Large,Small,two,regions\nA,,1,TRUE,X - Y\nB,1,2,FALSE,NA\n")
    got = rows(readers.read_lookup(spark, path, schemas.SPECIES))
    assert got == [("A", None, 1, True, "X - Y"), ("B", 1, 2, False, None)]


def test_workbook_types_by_position(spark, tmp_path):
    path = write(tmp_path / "w.csv", ",".join(["Survey code"] + [f"h{i}" for i in range(13)]) + "\n"
                 "s1,site1,Beach,Dunlin,12,1,8,2010,2010-08-01 08:30:00,2010-08-01 09:00:00,NS,Someone,45.1,-63.2\n")
    r = readers.read_workbook(spark, path).first()
    assert (r.survey_code, r.ob_count, r.day, r.longitude) == ("s1", "12", 1, -63.2)


def test_draw_files(spark, tmp_path):
    for chain in (1, 2):
        body = "\n".join(f"{chain}.{i},{i}" for i in range(1, 4))
        write(tmp_path / f"fit-{chain}.csv", f"# sampler notes\nlp__,alpha.1.2\n# adapted\n{body}\n# time\n")
    df = readers.read_draw_files(spark, [str(tmp_path / "fit-1.csv"), str(tmp_path / "fit-2.csv")],
                                 ["lp__", "alpha.1.2"])
    assert df.columns == ["lp__", "alpha[1,2]", "chain", "iteration"]
    assert rows(df) == sorted((float(f"{c}.{i}"), float(i), c, i) for c in (1, 2) for i in range(1, 4))


def test_polygon_vertices(spark, tmp_path):
    v = spark.createDataFrame([("p", 3, 1.0, 1.0), ("p", 1, 0.0, 0.0), ("p", 2, 1.0, 0.0)], schemas.VERTICES)
    v.write.parquet(str(tmp_path / "v"))
    ring = readers.read_polygons(spark, str(tmp_path / "v")).first().ring
    assert [(p.x, p.y) for p in ring] == [(0, 0), (1, 0), (1, 1)]


def test_snapshot_replaces_only_its_species(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "species string, n int")
    writers.save_snapshot(df, path)
    writers.save_snapshot(spark.createDataFrame([("b", 7)], "species string, n int"), path)
    assert rows(spark.read.parquet(path).select("species", "n")) == [("a", 1), ("b", 7)]
    wanted = spark.createDataFrame([("b",), ("zz",)], "species string")
    assert rows(readers.read_available(spark, path, wanted).select("species", "n")) == [("b", 7)]


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([("hex_name", "c1", 1.5), ("Region", "r1", None)],
                               "region_type string, region string, trend double")
    writers.save_csv(df, str(tmp_path / "all"))
    back = readers.read_lookup(spark, str(tmp_path / "all"), "region_type string, region string, trend double")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    writers.save_split(df, str(tmp_path / "split"))
    assert {d for d in os.listdir(tmp_path / "split") if "=" in d} == {"region_type=hex_name", "region_type=Region"}


def test_bracketed():
    assert [readers.bracketed(n) for n in ("sd", "n.1", "n.1.2")] == ["sd", "n[1]", "n[1,2]"]


def test_checkpoint_folder_comes_from_the_session(spark):
    from flockframe.session import checkpoint, ensure_checkpoint_dir
    assert spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)
    df = checkpoint(spark.range(5).filter("id > 10"))
    assert df.count() == 0 and df.columns == ["id"]
    assert checkpoint(spark.range(5)).inputFiles()[0].split(":")[-1].lstrip("/").startswith(
        spark.conf.get("spark.checkpoint.dir").lstrip("/"))


def test_join_on_matches_missing_with_missing(spark):
    from flockframe.session import join_on
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, k string")
    b = spark.createDataFrame([(None, 5), ("y", 6)], "k string, n int")
    assert sorted(map(str, join_on(a, b, ["k"], "full").select("i", "k", "n").collect())) == [
        "Row(i=1, k=None, n=5)", "Row(i=2, k='x', n=None)", "Row(i=None, k='y', n=6)"]
    assert rows(join_on(a, b, ["k"], "left_anti")) == [(2, "x")]
    with pytest.raises(ValueError):
        join_on(a, b, [])
