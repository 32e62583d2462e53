"""Sources and sinks, and the session's shared folder."""

import pytest

from panelspark.session import materialize
from panelspark.sources import files as S, schemas as H


def write(path, text):
    path.write_text(text)
    return str(path)


def test_quoted_newline_needs_multi_line(spark, tmp_path):
    p = write(tmp_path / "names.csv", 'Code,Intervention\n1.1,plain\n1.2,"two\nlines, ""quoted"""\n')
    got = {str(r.code): r.name for r in S.read_csv(spark, p, H.NAMES, multi_line=True).collect()}
    assert got == {"1.1": "plain", "1.2": 'two\nlines, "quoted"'}


def test_typed_edges(spark, tmp_path):
    p = write(tmp_path / "r.csv", '"","year","Code","dead","newcases"\n"1",2019,1.6,NaN,NA\n"2",2020,1,5.5,<1\n')
    got = sorted(map(tuple, S.read_csv(spark, p, H.RESULTS).collect()))
    assert [(str(c), d, n) for _, c, d, n in got] == [("1.6", None, None), ("1.0", 5.5, None)]
    with pytest.raises(ValueError, match="missing"):
        S.read_csv(spark, p, H.COSTS)


def test_many_files_and_population_labels(spark, tmp_path):
    head = "location_id,location_name,sex_name,age_group_name,year_id,val\n"
    paths = [write(tmp_path / f"p{y}.csv", head + f'1,X,male,<1 year,{y},10\n1,X,female,95 plus,{y},20\n1,X,both,5,{y},30\n1,X,female,5,{y},40\n') for y in (2009, 2010)]
    got = sorted(map(tuple, S.clean_population(S.read_csv(spark, paths, H.POPULATION)).collect()))
    assert len(got) == 6 and ("X", "Male", 0, 2009, 10.0) in got and ("X", "Female", 95, 2010, 20.0) in got


def test_sheet_with_preamble(spark, tmp_path):
    p = write(tmp_path / "b.csv", "Title,,,\nmore text,,,\nIndex,Region,ISO3,2022,2023\n1,Here,HER,10.5,11\n2,There,THE,...,12\n")
    got = S.read_sheet_csv(spark, p, "Index", {"Region": "location", "ISO3": "iso3"})
    assert got.columns == ["location", "iso3", "y2022", "y2023"]
    assert sorted(map(tuple, got.collect())) == [("Here", "HER", "10.5", "11"), ("There", "THE", "...", "12")]


def test_costs_default_and_upload(spark, tmp_path):
    a = write(tmp_path / "a.csv", "Code,Intervention,Total\n1.1,x,5\n")
    b = write(tmp_path / "b.csv", "Code,Intervention,Total\n1.1,x,7\n")
    assert S.read_costs(spark, a).first().total_cost == 5.0
    assert S.read_costs(spark, a, b).first().total_cost == 7.0


def test_write_and_replace_scenarios(spark, tmp_path):
    df = spark.createDataFrame([("0", 1, 1.0), ("1", 1, 2.0)], "scenario string, t int, v double")
    out = str(tmp_path / "res")
    S.replace_scenarios(df, out)
    S.replace_scenarios(spark.createDataFrame([("1", 5, 9.0)], "scenario string, t int, v double"), out)
    got = sorted((str(r.scenario), r.t, r.v) for r in spark.read.parquet(out).collect())
    assert got == [("0", 1, 1.0), ("1", 5, 9.0)]
    csv = str(tmp_path / "csv")
    S.write_table(df, csv, "csv")
    assert spark.read.csv(csv, header=True).columns == ["scenario", "t", "v"]


def test_small_tables(spark):
    assert [r.y for r in S.number_range(spark, 3, 5, "y").collect()] == [3, 4, 5]
    d = S.inline_table(spark, [("X", "XXX")], "location string, iso3 string")
    got = {r.location: r.iso3 for r in S.with_location_code(spark.createDataFrame([("X",), ("Y",)], "location string"), d).collect()}
    assert got == {"X": "XXX", "Y": None}


def test_materialize_is_a_reliable_checkpoint(spark):
    df = materialize(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()


def test_yearly_files_are_stacked_by_name(spark, tmp_path):
    spec = {"year": ("year", "int"), "val": ("val", "double"), "note": ("note", "string")}
    folder = tmp_path / "years with space"
    folder.mkdir()
    write(folder / "a.csv", "year,val,note\n2014,7,x\n2014,8,\"y,z\"\n")
    write(folder / "b.csv", "val,note,year\n9,b,2015\n")
    write(folder / "c.csv", '"","note","year","val"\n"1","c",2016,10\n')
    write(folder / "d.csv", "year,val,note\n2014,11,again\n")
    write(folder / "e.csv", "")
    found = S.headers(spark, str(folder))
    assert sorted(len(files) for files in found.values()) == [1, 1, 2]
    df = S.read_csv(spark, str(folder), spec)
    assert sorted(map(tuple, df.collect())) == [(2014, 7.0, "x"), (2014, 8.0, "y,z"), (2014, 11.0, "again"), (2015, 9.0, "b"), (2016, 10.0, "c")]

    write(folder / "f.csv", "val,year\n12,2017\n")
    with pytest.raises(ValueError, match="note.*f.csv"):
        S.read_csv(spark, str(folder), spec)
    assert (2017, 12.0, None) in set(map(tuple, S.read_csv(spark, str(folder), spec, optional={"note"}).collect()))
    write(folder / "g.csv", "year,note\n2018,n\n")
    with pytest.raises(ValueError, match="val.*g.csv"):
        S.read_csv(spark, str(folder), spec, optional={"note"})
    with pytest.raises(ValueError, match="no header"):
        S.read_csv(spark, str(folder / "e.csv"), spec)


def test_headers_of_compressed_files_and_line_breaks(spark, tmp_path):
    import gzip
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write('\ufeffCode,"Inter\nvention",Code\n1.1,x,2\n')
    assert list(S.headers(spark, str(tmp_path / "z.csv.gz"))) == [("Code", "Inter\nvention", "Code")]
    one = S.read_csv(spark, str(tmp_path / "z.csv.gz"), {"name": ("Inter\nvention", "string")}, multi_line=True)
    assert [r.name for r in one.collect()] == ["x"]


def test_malformed_values_are_counted_and_stop_the_write(spark, tmp_path):
    spec = {"age": ("age", "string"), "year": ("year", "int"), "val": ("val", "double")}
    write(tmp_path / "a.csv", "age,year,val\n<1 year,2014,NA\n95 plus,2014,NaN\n")
    write(tmp_path / "b.csv", 'year,age,val\nabc,5,"1,234"\n2015,6,12\n2016,,x\n')
    rejects = S.Rejects()
    good = S.stored(S.read_csv(spark, str(tmp_path / "a.csv"), spec, rejects=rejects), str(tmp_path / "good"), rejects)
    assert sorted(map(tuple, good.collect()), key=str) == [("95 plus", 2014, None), ("<1 year", 2014, None)]
    both = S.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], spec, rejects=rejects)
    with pytest.raises(ValueError, match="b.csv, column year: 1; .*b.csv, column val: 2"):
        S.write_table(both, str(tmp_path / "bad"), rejects=rejects)
    S.write_table(good, str(tmp_path / "after"), rejects=rejects)
