"""Reading untidy files, specs and the catalog."""

from datetime import datetime

import pytest

from tidewatt.axis import Axis, micros
from tidewatt.frame import Dataset
from tidewatt.sources import catalog, tables
from tidewatt.spec import StationSpec

DIRTY = "Станция;ПС-2\nвысота;12\n\nTIMESTAMP;POWER;T_AIR;COMMENT\n01.02.21 00:00;1,5;-3,25;ночь\n01.02.21 01:00;2,5;bad;\nнет;1;1;x\n01.02.21 02:00;3;4,0;утро\n"


def test_dirty_file(spark, tmp_path):
    path = tmp_path / "dirty.csv"
    path.write_bytes(DIRTY.encode("cp1251"))
    assert tables.detect_encoding(path.read_bytes()) == "cp1251"
    rows, at = tables.raw_preview(spark, str(path))
    assert at == 3 and rows[3] == ["TIMESTAMP", "POWER", "T_AIR", "COMMENT"]
    ds = tables.load_table(spark, str(path), target="POWER", time_format="%d.%m.%y %H:%M")
    got = [tuple(r) for r in ds.df.orderBy("TIMESTAMP").select("TIMESTAMP", "POWER", "T_AIR", "COMMENT").collect()]
    assert got == [(datetime(2021, 2, 1, 0), 1.5, -3.25, "ночь"), (datetime(2021, 2, 1, 1), 2.5, None, None), (datetime(2021, 2, 1, 2), 3.0, 4.0, "утро")]
    assert ds.info["bad_timestamps"] == 1 and ds.info["coercion_failures"] == {"T_AIR": 1} and ds.info["rows"] == 3
    assert ds.target == "POWER" and ds.features == ["T_AIR"] and ds.spec.columns["COMMENT"].role == "ignore"
    assert ds.freq == 3_600_000_000 and ds.reference_power() == (3.0, "max")


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('notes\n\ntime,P,note\n2021-01-01 00:00,1,"first\nline, and ""second"""\n2021-01-01 01:00,2,plain\n\n2021-01-01 02:00,3,"a\nb\nc"\n', newline="")
    ds = tables.load_table(spark, str(path), target="P")
    rows = ds.df.orderBy("time").select("P", "note").collect()
    assert [(r.P, r.note) for r in rows] == [(1.0, 'first\nline, and "second"'), (2.0, "plain"), (3.0, "a\nb\nc")]


@pytest.mark.parametrize(("text", "want"), [("a,b\n1,2", ","), ("a;b\n1,5;2,5", ";"), ("a\tb\n1\t2", "\t"), ("a|b\n1|2", "|"), ("alone", ",")])
def test_delimiters(text, want):
    assert tables.detect_delimiter(text) == want


def test_time_is_found_and_numbers_are_no_times(spark):
    df = spark.createDataFrame([("2021-01-01 00:00", "20210101", 1.0), ("2021-01-01 01:00", "20210102", 2.0)], "t string, n string, x double")
    assert tables.looks_like_time(df, "t") and not tables.looks_like_time(df, "n") and not tables.looks_like_time(df, "x")
    assert tables.spark_pattern("%d.%m.%y %H:%M") == "dd.MM.yy HH:mm" and tables.spark_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"
    with pytest.raises(ValueError):
        tables.spark_pattern("%Q")


def test_spec_round_trip(tmp_path):
    data = {"name": "s", "capacity": 50, "time": {"freq": "1h"}, "columns": {"P": {"role": "target", "unit": "MW", "limits": [-50, None]}, "D": {"cyclic": 360}, "X": "ignore"}, "cleaning": {"missing": {}}, "series_column": "st"}
    spec = StationSpec.from_dict(data)
    path = tmp_path / "s.yaml"
    spec.to_yaml(path)
    assert StationSpec.load(str(path)) == spec == StationSpec.from_dict(spec.to_dict())
    assert spec.target == "P" and spec.features == ["D"] and spec.limits == {"P": (-50.0, None)} and spec.cyclic_columns == {"D": 360} and spec.label("P") == "P, MW"
    assert spec.availability("P") == "history" and spec.availability("D") == "forecast" and spec.availability("Q") is None
    assert StationSpec.from_dict({"columns": {"c": {"available": "always"}}}).to_dict() == {"columns": {"c": {"available": "always"}}}
    for bad in ({"nme": 1}, {"columns": {"a": {"available": "nonsense"}}}, {"columns": {"a": "target", "b": "target"}}, {"columns": {"a": {"rol": 1}}}, {"time": {"frq": 1}}, {"columns": {"a": "boss"}}):
        with pytest.raises(ValueError):
            StationSpec.from_dict(bad)


def test_spec_binds_to_data(spark):
    df = spark.createDataFrame([("2021-01-01 00:00", 1.0, 2.0)], "time string, POWER double, EXTRA double")
    ds = tables.load_station(spark, df, {"capacity": 5, "columns": {"POWER": "target", "GONE": "feature"}})
    assert ds.info["absent_columns"] == ["GONE"] and ds.features == [] and ds.reference_power() == (5.0, "capacity")
    with pytest.raises(ValueError):
        tables.load_station(spark, df, {"columns": {"NONE": "target"}})


def test_catalog(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,P\n2021-01-01 00:00,1\n2021-01-01 01:00,2\n")
    catalog.register_dataset("Alpha", str(tmp_path / "a.csv"), description="first", overwrite=True)
    with pytest.raises(KeyError):
        catalog.register_dataset("alpha", "x")
    assert catalog.load_dataset(spark, "ALPHA").df.count() == 2
    assert ("alpha", "first") in [(r.name, r.description) for r in catalog.list_datasets(spark).collect()]
    with pytest.raises(KeyError):
        catalog.load_dataset(spark, "beta")


def test_slice_covers_whole_periods(spark):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz'2020-04-30 22:00', timestamp_ntz'2020-06-01 02:00', interval 1 hour)) AS ts")
    ds = Dataset(df, Axis("ts"))
    assert len(ds.slice("2020-05", "2020-05")) == 31 * 24
    assert len(ds.slice("2020-05-02", "2020-05-02")) == 24
    assert len(ds.slice(end=datetime(2020, 4, 30, 23))) == 2


@pytest.mark.parametrize(("text", "want"), [("1h", 3_600_000_000), ("15min", 900_000_000), ("5D", 432_000_000_000), ("h", 3_600_000_000)])
def test_durations(text, want):
    assert micros(text) == want
    with pytest.raises(ValueError):
        micros("720")
