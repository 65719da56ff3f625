import csv
import os

import pytest
from pyspark.sql import functions as F

from pathloom.operators.reshape import pivot_multi_value, pivot_years, transpose, unpivot_years
from pathloom.session import shared_dir
from pathloom.sources.staging import Staging
from pathloom.sources import tables as src
from tests.conftest import rows

CSV = """Model,Scenario,Region,Variable,Unit,1995,2020,2021
M1,S1,World,V,u,9,1.5,NaN
M1,S2,World,V,u,9,,2
"""


def test_year_columns_by_name():
    cols = ["Model", "1995", "2020", "20x0", "2021"]
    assert src.discover_year_columns(cols) == ["2020", "2021"]
    assert src.discover_year_columns(cols, r"\d+") == ["1995", "2020", "2021"]


def test_wide_csv_to_long(spark, tmp_path):
    (tmp_path / "d.csv").write_text(CSV)
    (tmp_path / "m.csv").write_text("Model,Scenario,Category\nM1,S1,C1\nM1,S2,C2\n")
    db = src.read_scenario_db(spark, str(tmp_path / "d.csv"), str(tmp_path / "m.csv"))
    assert rows(db.long.select("scen_id", "year", "value")) == [("M1 S1", 2020, 1.5), ("M1 S2", 2021, 2.0)]
    assert rows(db.key.select("scen_id", "Category")) == [("M1 S1", "C1"), ("M1 S2", "C2")]
    assert db.years == (2020, 2021) and (db.first_year, db.last_year, db.scenarios) == (2020, 2021, 2)
    plain = src.read_scenario_db(spark, str(tmp_path / "d.csv"), str(tmp_path / "m.csv"), sep="")
    assert {r.scen_id for r in plain.key.collect()} == {"M1S1", "M1S2"}


def test_pivot_and_unpivot_are_inverse(long):
    df = long([("a", "v", 2020, 1.0), ("a", "v", 2022, 3.0), ("b", "v", 2021, 2.0)])
    wide = pivot_years(df, ("scen_id", "Variable"), (2020, 2021, 2022))
    assert rows(unpivot_years(wide, ["scen_id", "Variable"], ["y2020", "y2021", "y2022"], strip="y")) == rows(df)


def test_multi_value_pivot_and_transpose(make):
    df = make("k string, Variable string, a double, b double", [("x", "p|q", 1.0, 2.0), ("x", "r", 3.0, 4.0)])
    wide = pivot_multi_value(df, ("k",), {"p|q": "p", "r": "r"}, ("a", "b"))
    assert wide.columns == ["k", "a_p", "a_r", "b_p", "b_r"] and rows(wide) == [("x", 1, 3, 2, 4)]
    t = transpose(df.select("Variable", "a", "b"), "Variable", ["a", "b"], ["p|q", "r"])
    assert rows(t) == [("a", 1, 3), ("b", 2, 4)]


def test_csv_sink_has_a_header_and_no_index(spark, long, tmp_path):
    src.sink_csv(long([("a", "v", 2020, 1.0)]), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["scen_id", "Variable", "year", "value"]


def test_staged_table_is_bucketed_and_saves_the_shuffle(spark, long):
    df = Staging.of(spark).written(long([(f"s{i}", "v", 2020, float(i)) for i in range(50)]), "t", bucket_by="scen_id")
    plan = df.groupBy("scen_id").agg(F.sum("value"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and df.count() == 50
    assert shared_dir(spark) in df.inputFiles()[0]
    plain = Staging.of(spark).written(df.where("value < 5"), "u")
    assert plain.count() == 5 and shared_dir(spark) in plain.inputFiles()[0]
    assert Staging.of(spark).written(df.where("value < 5"), "u") is plain


def test_bucket_count_follows_the_data(spark):
    assert src.bucket_count(spark, 10) == spark.sparkContext.defaultParallelism
    assert src.bucket_count(spark, 10**12) == -(-10**12 // src.BUCKET_BYTES)


def test_duplicates_are_found(long):
    df = long([("a", "v", 2020, 1.0), ("a", "v", 2020, 2.0), ("b", "v", 2020, 2.0)])
    assert rows(src.duplicate_rows(df)) == [("a", "v", 2020, 2)]


def test_stacking_equals_unpivot_and_keeps_the_partitioning(spark, long):
    from pathloom.operators.reshape import stack_rows

    wide = long([("a", "v", 1, 1.0), ("b", "w", 2, None)]).select("scen_id", F.col("value").alias("x"), (F.col("value") + 1).alias("z"))
    got = stack_rows(wide, ("scen_id",), {"x": {"k": "X", "year": 2020}, "z": {"k": "Z", "year": 2030}})
    assert rows(got) == [("a", "X", 2020, 1), ("a", "Z", 2030, 2), ("b", "X", 2020, None), ("b", "Z", 2030, None)]
    staged = Staging.of(spark).written(wide, "w", bucket_by="scen_id")
    plan = stack_rows(staged, ("scen_id",), {"x": {"k": "X"}, "z": {"k": "Z"}}).groupBy("scen_id").agg(F.sum("value"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_scenario_passes_need_no_shuffle_on_bucketed_tables(spark, long, make):
    from pathloom.functions import fixed as fx
    from pathloom.operators.emissions import eip_at, eip_yearly, gases_at
    from pathloom.operators.joins import in_ids
    from pathloom.operators.screens import screen_criteria
    from pathloom.operators.timeaxis import interpolated_total

    df = Staging.of(spark).written(long([("a", fx.NET_TOTAL, 2020, 1.0), ("b", fx.CCS, 2020, 1.0)]), "l", bucket_by="scen_id")
    ids = Staging.of(spark).written(make("scen_id string", [("a",), ("c",)]), "k", bucket_by="scen_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (eip_at(df, ids, (2020,)), eip_yearly(df, ids, 2020, 2030), gases_at(in_ids(df, ids), (2020,)),
                    screen_criteria(in_ids(df, ids)), interpolated_total(df)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quotes_and_line_breaks_survive_the_sink(spark, make):
    import csv
    import glob

    rows = [("a", 'He, et al. "Paths, to" 2021'), ("b", "two\nlines"), ("c", "plain")]
    path = src.sink_csv(make("k string, v string", rows).coalesce(1), f"{shared_dir(spark)}/quoted")
    assert sorted(tuple(r) for r in src.scan_metadata(spark, path).collect()) == rows
    (name,) = glob.glob(path.removeprefix("file:") + "/part-*.csv")
    with open(name, newline="") as f:
        assert sorted(map(tuple, csv.reader(f)))[:2] == rows[:2]


def write(path, *lines):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows(lines)
    return str(path)


def test_files_may_order_their_columns_differently(spark, tmp_path):
    write(tmp_path / "a.csv", ["Model", "Scenario", "Region", "Variable", "Unit", "2020", "2030"],
          ["M", 'He said "so", twice', "World", "V", "u", 1, 2])
    write(tmp_path / "b.csv", ["2030", "Unit", "Variable", "Region", "Scenario", "Model", "2020"],
          [20, "u", "V", "World", "two\nlines", "M", 10])
    write(tmp_path / "c.csv", ["Model", "Scenario", "Region", "Variable", "Unit", "2040"], ["M", "late", "World", "V", "u", "NA"],
          ["M", "later", "World", "V", "u", " 7e2 "])
    wide = src.scan_wide_csv(spark, str(tmp_path))
    assert wide.columns == ["Model", "Scenario", "Region", "Variable", "Unit", "2020", "2030", "2040"]
    assert rows(wide.select("Scenario", "2020", "2030", "2040")) == sorted([
        ('He said "so", twice', 1, 2, None), ("two\nlines", 10, 20, None), ("late", None, None, None),
        ("later", None, None, 700)], key=lambda r: str(r[0]))
    one = src.scan_wide_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")])
    assert one.where("Scenario = 'two\nlines'").select("2020", "2030").first() == (10, 20)
    back = src.sink_csv(wide, f"{shared_dir(spark)}/wide_again")
    assert rows(src.scan_wide_csv(spark, back)) == rows(wide)


def test_bad_cells_fail_or_are_listed(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["Model", "2020", "2030"], ["M", "1,5", "n/a"], ["N", "2", "about 3"], ["O", "", "NaN"])
    with pytest.raises(Exception, match="no number in column 2020: 1,5"):
        src.scan_wide_csv(spark, path).where("Model = 'M'").collect()
    wide = src.scan_wide_csv(spark, path, rejects="rejects")
    got = {r.Model: (r["2020"], r["2030"], [tuple(x) for x in r.rejects]) for r in wide.collect()}
    assert got == {"M": (None, None, [("2020", "1,5")]), "N": (2, None, [("2030", "about 3")]), "O": (None, None, [])}
    long_row = write(tmp_path / "b.csv", ["Model", "2020"], ["M", "1", "2"])
    with pytest.raises(Exception):
        src.scan_wide_csv(spark, long_row).collect()
    with pytest.raises(ValueError, match="twice in the header"):
        src.scan_wide_csv(spark, write(tmp_path / "c.csv", ["Model", "2020", "2020"], ["M", "1", "2"]))


HEAD = ["Model", "Scenario", "Region", "Variable", "Unit", "2020", "2021"]


def two_regions(tmp_path):
    data = write(tmp_path / "d.csv", HEAD, ["M", "S", "World", "V", "u", 10, 20], ["M", "S", "R5", "V", "u", 1, 2])
    return data, write(tmp_path / "m.csv", ["Model", "Scenario", "Category"], ["M", "S", "C1"])


def test_a_second_region_is_refused_or_left_out(spark, tmp_path):
    data, meta = two_regions(tmp_path)
    with pytest.raises(ValueError, match="several regions, name one: R5, World"):
        src.read_scenario_db(spark, data, meta)
    for region, total in (("World", 30), ("R5", 3)):
        db = src.read_scenario_db(spark, data, meta, region=region)
        assert db.long.agg(F.sum("value")).first()[0] == total


def test_rows_for_one_key_are_refused(spark, tmp_path):
    data, meta = two_regions(tmp_path)
    with open(data, "a") as f:
        f.write("M,S,R5,V,u,3,\n")
    with pytest.raises(Exception, match="two rows for M S, R5, V, 2020"):
        src.read_scenario_db(spark, data, meta, region="R5")
    assert src.read_scenario_db(spark, data, meta, region="World").long.count() == 2
    with open(meta, "a") as f:
        f.write("M,S,C2\n")
    with pytest.raises(Exception, match="two rows for M S"):
        src.read_scenario_db(spark, data, meta, region="World")


def test_ingest_takes_one_exchange_a_table(spark, long):
    df = src.unique_rows(long([("a", "v", 2020, 1.0), ("b", "v", 2020, 1.0)]), ["scen_id", "Variable", "year"], "scen_id", 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and df.count() == 2
    with Staging(spark) as staging:
        key = long([("a", "v", 2020, 1.0)]).select("scen_id")
        db = src.ingest(long([("a", "v", 2020, 1.0), ("a", "v", 2040, 2.0)]), key, staging=staging)
        assert db.years == (2020, 2040) and db.buckets == spark.sparkContext.defaultParallelism
        plan = db.long.join(db.key, "scen_id").groupBy("scen_id").agg(F.sum("value"))._jdf.queryExecution().executedPlan()
        assert "Exchange hash" not in plan.toString()


def jobs(spark, fn):
    spark.sparkContext.setJobGroup("counted", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    out = fn()
    after = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, after - before


def test_shared_frames_run_nothing_until_used_and_once(spark, make):
    with Staging(spark) as staging:
        def build():
            df = make("a int", [(1,), (2,)]).select(F.rand().alias("x"))
            return df, staging.shared(df), staging.shared(df)

        (_, a, b), n = jobs(spark, build)
        assert n == 0 and a is b
        assert a.unionByName(b).groupBy("x").count().agg(F.min("count")).first()[0] == 2  # one draw, used twice
    assert not a.is_cached


def test_building_reports_runs_no_job_and_leaves_nothing(spark):
    from pathloom.functions import fixed
    from pathloom.plans import reports as rp
    from workload import tables as t

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("tables not here")
    d, older = t.db(spark, sf), t.older_db(spark, sf)
    nze = t.focal(spark).where("Source = 'NZE'").select(F.lit(fixed.EXTERNAL_ID).alias("scen_id"), F.lit(2020).alias("year"),
                                                        F.col("y2020").alias("value"))
    persisted = spark._jsc.getPersistentRDDs()
    before = persisted.size()
    with Staging(spark) as staging:
        def build():
            return [rp.fig_gross(d, t.LIMITS, staging=staging), rp.band_vs_median(d, t.LIMITS, staging),
                    rp.combined_emissions(d, t.LIMITS, t.history(spark), nze, staging),
                    rp.benchmark_harmonised(d, rp.harmonised_paths(d, t.LIMITS, t.history(spark), nze, staging), staging=staging),
                    rp.harmonised_long(d, t.LIMITS, t.history(spark), staging), rp.removals_vs_reduction(d, t.LIMITS),
                    rp.focal_vs_median(d, t.LIMITS, t.focal(spark), staging=staging), rp.sr15_quantiles(older)]

        frames, n = jobs(spark, build)
        assert n == 0
        for df in frames[:2]:
            assert df.count() > 0
        root = staging.root
    assert spark._jsc.getPersistentRDDs().size() == before
    assert not os.path.exists(root.removeprefix("file:"))


def test_written_tables_are_taken_up_by_a_later_job(spark, tmp_path, make):
    make("k string, v int", [("a", 1), ("b", 2)]).write.parquet(f"{tmp_path}/in")
    root = f"{tmp_path}/work"

    def plan():
        return spark.read.parquet(f"{tmp_path}/in").where("v > 0")

    def mtimes():
        return {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.startswith("part")}

    first = Staging(spark, root)
    first.written(plan(), "plain")
    first.written(plan(), "dealt", "k", buckets=2)
    first.close(keep_files=True)  # as if the job had ended
    before = mtimes()
    second = Staging(spark, root)
    assert rows(second.written(plan(), "plain")) == [("a", 1), ("b", 2)]
    again = second.written(plan(), "dealt", "k", buckets=2)
    assert rows(again) == [("a", 1), ("b", 2)] and mtimes() == before
    assert "Exchange" not in again.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    other = second.written(plan().where("v > 1"), "plain")  # another plan is written anew
    assert rows(other) == [("b", 2)] and len(mtimes()) > len(before)
    second.close()
    assert not os.path.exists(root)


def test_header_of_a_file_of_many_splits_comes_from_its_start(spark, tmp_path):
    file = tmp_path / "big.csv"
    file.write_text("Variable,2020,2030\n" + "".join(f"v{i},1,1\n" for i in range(200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert spark.read.text(str(file)).rdd.getNumPartitions() > 10
        line = src.first_line(spark, str(file))
        # no exchange, so no line of a later split can come first
        assert "Exchange" not in line._jdf.queryExecution().executedPlan().toString()
        assert [r.value for r in line.collect()] == ["Variable,2020,2030"]
        assert src.scan_wide_csv(spark, str(file)).count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_folders_with_odd_signs(spark, tmp_path):
    for name in ("with space", "per%cent", "a[b]", "a{b}*"):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "one two.csv").write_text('Variable,2020,"a ""b"", c"\nv,1,x\n')
        path = src._as_path(str(folder)) if name != "per%cent" else str(folder)
        wide = src.scan_wide_csv(spark, path)
        assert wide.columns == ["Variable", 'a "b", c', "2020"] and wide.count() == 1


def test_a_bucket_takes_little_input(spark):
    assert src.bucket_count(spark, 6 << 30) >= 600  # its rows are sorted in one task
    # a task's share stays the same while the input grows
    assert src.bucket_count(spark, 60 << 30) == 6 * src.bucket_count(spark, 10 << 30)


def test_unique_rows_finds_missing_keys_that_come_twice(spark, make):
    keys, schema = ["scen_id", "Variable", "year"], "scen_id string, Variable string, year int"
    good = [("a", None, 2020), ("a", "v", 2020), ("b", None, 2020), (None, None, 2020), ("a", None, 2030)]
    assert src.unique_rows(make(schema, good), keys, "scen_id", 2).count() == 5
    for twice, said in ((("a", None, 2020), "a, null, 2020"), ((None, None, 2020), "null, null, 2020")):
        with pytest.raises(Exception, match=f"two rows for {said}"):
            src.unique_rows(make(schema, [*good, twice]), keys, "scen_id", 2).collect()
