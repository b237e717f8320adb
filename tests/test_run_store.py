"""A published run is read whole; anything less is refused."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from visitloom.sources.run_store import manifest_of, publish_run, read_run
from visitloom.spec import DataError


@pytest.fixture
def parts(spark):
    visits = spark.createDataFrame([(1, "a", None), (2, None, 0.5), (3, "c", 1.5)],
                                   "id long, name string, `x.y` double").repartition(2)
    return {"visits": visits, "none": visits.limit(0), "totals": visits.agg(F.sum("id").alias("s"))}


def test_round_trip(spark, parts, tmp_path):
    listed = publish_run(parts, str(tmp_path), "r1").orderBy("part").collect()
    assert [(r.part, r.n_rows, r.n_parts) for r in listed] == [("none", 0, 3), ("totals", 1, 3), ("visits", 3, 3)]
    back = read_run(spark, str(tmp_path), "r1")
    assert set(back) == set(parts)
    for name, df in parts.items():
        assert back[name].schema == df.schema
        assert sorted(map(repr, back[name].collect())) == sorted(map(repr, df.collect()))


def test_published_runs_stay(spark, parts, tmp_path):
    publish_run(parts, str(tmp_path), "r1")
    with pytest.raises(DataError, match="already"):
        publish_run({"visits": parts["none"]}, str(tmp_path), "r1")
    assert read_run(spark, str(tmp_path), "r1")["visits"].count() == 3


def test_half_written_run_is_refused_and_can_be_tried_again(spark, parts, tmp_path):
    broken = parts["visits"].withColumn("bad", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        publish_run({"visits": parts["visits"], "broken": broken}, str(tmp_path), "r1")
    assert glob.glob(f"{tmp_path}/r1/*/visits/*.parquet")       # one part is there, the run is not
    with pytest.raises(DataError, match="not published"):
        read_run(spark, str(tmp_path), "r1")
    publish_run(parts, str(tmp_path), "r1")
    assert read_run(spark, str(tmp_path), "r1")["visits"].count() == 3


def test_lost_files_and_lines_are_seen(spark, parts, tmp_path):
    publish_run(parts, str(tmp_path), "r1")
    file = max(glob.glob(f"{tmp_path}/r1/*/visits/*.parquet"), key=os.path.getsize)
    os.rename(file, f"{tmp_path}/elsewhere")
    with pytest.raises(DataError, match="visits of run r1 has"):
        read_run(spark, str(tmp_path), "r1")
    publish_run(parts, str(tmp_path), "r2")
    [lines] = glob.glob(f"{tmp_path}/r2/manifest/*.json")
    text = open(lines).read().splitlines()
    os.rename(lines, f"{tmp_path}/lines")
    with open(f"{tmp_path}/r2/manifest/part-0.json", "w") as out:
        out.write(text[0] + "\n")
    with pytest.raises(DataError, match="not whole"):
        manifest_of(spark, str(tmp_path), "r2")


@pytest.mark.parametrize("names", [{}, {"a/b": 1}, {"": 1}])
def test_bad_names(spark, parts, tmp_path, names):
    with pytest.raises(DataError):
        publish_run({n: parts["none"] for n in names}, str(tmp_path), "r1")
