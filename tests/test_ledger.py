"""The ledger: what a run reads, who survives, runs that broke off, compaction."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from intentloom.operators import ledger
from intentloom.plans import runs, web
from intentloom.session import delete


@pytest.fixture(autouse=True)
def sixteen_partitions(monkeypatch):
    monkeypatch.setattr(ledger, "PREFIX", 1)


def keyed(spark, low, high, **more):
    return spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("lead_id"), F.col("id").alias("at"), *[F.lit(v).alias(k) for k, v in more.items()])


def parts(path):
    return {p.name for p in Path(path).glob("prefix=*")}


def test_a_run_reads_only_the_partitions_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.append(keyed(spark, 0, 2000), path, run="a").count() == 2000
    assert len(parts(path)) == 16
    few = keyed(spark, 1997, 2001)
    hit = {r.lead_id[:1] for r in few.collect()}
    found = ledger.known(few, path)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan
    read = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("prefix=")[1][:1] for r in read} <= hit and 0 < len(read) <= 4
    assert {r.at for r in ledger.append(few, path, run="b").collect()} == {2000}
    assert ledger.append(few, path, run="b").count() == 1 and ledger.read(spark, path).count() == 2001


def test_the_first_to_arrive_survives(spark, tmp_path):
    rows = spark.createDataFrame([("aa1", 3, "late"), ("aa1", 1, "first"), ("bb2", 2, "only"), (None, 5, "x"), (None, 4, "null key")], "lead_id string, at int, what string")
    path = str(tmp_path / "ledger")
    got = ledger.append(rows.repartition(5), path, order=F.col("at"), run="a").collect()
    assert sorted(r.what for r in got) == ["first", "null key", "only"]
    other = str(tmp_path / "other")
    assert sorted(r.what for r in ledger.append(rows.repartition(3), other, run="a").collect()) == sorted(r.what for r in ledger.append(rows.repartition(1), str(tmp_path / "third"), run="a").collect())


def test_a_run_that_broke_off_is_ended(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.append(keyed(spark, 0, 300), path, run="a")
    for p in sorted(Path(path).glob("prefix=*"))[::2]:  # as if half of the files had not been there
        delete(spark, str(p))
    assert ledger.append(keyed(spark, 0, 300), path, run="a").count() == 300
    assert ledger.read(spark, path).select("lead_id").distinct().count() == ledger.read(spark, path).count() == 300


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.compact(spark, path) == []
    for n in range(3):
        ledger.append(keyed(spark, 100 * n, 100 * n + 100), path, run=n)
    before = sorted(map(tuple, ledger.read(spark, path).collect()))
    files = lambda: sum(1 for p in Path(path).rglob("*.parquet"))
    many, had = ledger.compact(spark, path, files=1), files()
    assert many and had == len(parts(path)) and sorted(map(tuple, ledger.read(spark, path).collect())) == before
    assert ledger.compact(spark, path, files=1) == [] and not os.path.exists(path + "-compacting")


def test_compaction_that_broke_off(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for n in range(2):
        ledger.append(keyed(spark, 50 * n, 50 * n + 50), path, run=n)
    before = sorted(map(tuple, ledger.read(spark, path).collect()))
    rows = ledger.read(spark, path)
    rows.write.partitionBy("prefix").parquet(path + "-compacting")  # the whole copy is there,
    for p in sorted(Path(path).glob("prefix=*"))[:7]:  # and some partitions have gone to make room for theirs
        delete(spark, str(p))
    ledger.recover(spark, path)
    assert sorted(map(tuple, ledger.read(spark, path).collect())) == before and not os.path.exists(path + "-compacting")
    rows = ledger.read(spark, path)
    rows.where("prefix < '8'").write.partitionBy("prefix").parquet(path + "-compacting")
    os.remove(path + "-compacting/_SUCCESS")  # a copy that was not finished
    ledger.recover(spark, path)
    assert sorted(map(tuple, ledger.read(spark, path).collect())) == before and not os.path.exists(path + "-compacting")


def test_leads_are_made_once_for_all_runs(spark, monkeypatch):
    """Three runs into the store score each lead once; before, each run made all leads anew."""
    made, real = spark.sparkContext.accumulator(0), web.all_leads

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def all_leads(spark, d):
        found = real(spark, d)
        return found.mapInArrow(counted, found.schema)

    monkeypatch.setattr(web, "all_leads", all_leads)
    stored = runs.f5(spark, "/root/testdata/sf0.001").collect()
    assert len(stored) == made.value > 0 and {r.run_id for r in stored} == {"run1", "run2"}
