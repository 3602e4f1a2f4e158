"""Reader and persistence error paths."""

import os

import pytest

from stratus.plans import preprocess
from stratus.session import scratch_path
from stratus.sources import files
from stratus.sources import models as persist
from stratus.sources.station_csv import read_station_files, scan_station_csv
from tests.work import work


def test_station_file_without_header_is_an_error(spark):
    path = scratch_path(spark, "no-header")
    spark.createDataFrame([("REGIAO:;SE",), ("2024/01/01;0100 UTC;1,0;",)], "line string").coalesce(1).write.text(path)
    with pytest.raises(ValueError):
        scan_station_csv(spark, path)


def test_station_rows_follow_their_own_file_header(spark):
    base = scratch_path(spark, "two-layouts")
    a = ["PRE;x", "Data;Hora UTC;TEMP A;UMID B;", "2024/01/01;0100 UTC;1,5;80;"]
    b = ["Data;Hora UTC;UMID B;TEMP A;", "2024/01/01;0200 UTC;70;2,5;", "lixo;;"]
    for name, lines in (("a", a), ("b", b)):
        spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(os.path.join(base, name))
    df = scan_station_csv(spark, [os.path.join(base, "a"), os.path.join(base, "b")])
    got = sorted(((r["Data"], r["Hora UTC"], r["TEMP A"], r["UMID B"]) for r in df.collect()), key=str)
    # every line after the header is a row
    assert got == [("2024/01/01", "0100 UTC", "1,5", "80"), ("2024/01/01", "0200 UTC", "2,5", "70"), ("lixo", None, None, None)]


def test_missing_bundle_is_an_error(spark):
    with pytest.raises(Exception):
        persist.load_bundle(spark, scratch_path(spark, "nothing-here"))


def station_file(spark, folder, name, lines):
    """One Latin-1 file."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="latin-1", newline="") as f:
        f.write("\r\n".join(lines) + "\r\n")


HEADER = "Data;Hora UTC;TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);UMIDADE RELATIVA DO AR, HORARIA (%);"


def test_wide_file_keeps_its_fields(spark, tmp_path):
    names = [f"M{i}" for i in range(50)]
    station_file(spark, tmp_path, "wide.csv", ["PRE;x", ";".join(["Data", "Hora", *names]), ";".join(["2024/01/01", "0100", *map(str, range(50))])])
    row = scan_station_csv(spark, f"file://{tmp_path}").first().asDict()
    assert len(row) == 53 and row["M49"] == "49" and row["M38"] == "38"


def test_rows_of_any_date_form_are_kept(spark, tmp_path):
    station_file(spark, tmp_path, "d.csv", [HEADER, "2024/01/01;0000 UTC;1;2;", "01/02/2024;0100 UTC;3;4;", ";;;;", "2024-01-02;0100 UTC;;4;"])
    df = scan_station_csv(spark, f"file://{tmp_path}")
    assert sorted(str(r["Data"]) for r in df.collect()) == ["01/02/2024", "2024-01-02", "2024/01/01", "None"]
    out = preprocess.fit_transform(df)
    assert out.count() == 4 and out.where("datetime is null").count() == 3  # a date of another form has no time


def test_first_matching_line_is_the_header(spark, tmp_path):
    station_file(spark, tmp_path, "h.csv", ["ESTACAO:;X", HEADER, "2024/01/01;0000 UTC;1,5;80;", "Aviso: Data;e Hora em UTC;x;y;"])
    df = scan_station_csv(spark, f"file://{tmp_path}")
    assert df.columns[:4] == HEADER.split(";")[:4]
    assert df.count() == 2 and df.where("Data = '2024/01/01'").first()[2] == "1,5"


def test_repeated_and_unnamed_columns(spark, tmp_path):
    station_file(spark, tmp_path, "h.csv", ["Data;Hora;T;;T;", "2024/01/01;0000;1;2;3;"])
    row = scan_station_csv(spark, f"file://{tmp_path}", file_column=None).first().asDict()
    assert row == {"Data": "2024/01/01", "Hora": "0000", "T": "1", "Unnamed: 3": "2", "T.1": "3"}


def test_file_without_header_among_good_ones(spark, tmp_path):
    station_file(spark, tmp_path, "INMET_a.CSV", [HEADER, "2024/01/01;0000 UTC;1;2;"])
    station_file(spark, tmp_path, "inmet_bad.csv", ["2024/01/01;0000 UTC;1;2;"])
    station_file(spark, tmp_path, "other.csv", [HEADER, "2024/01/01;0000 UTC;1;2;"])
    folder = f"file://{tmp_path}"
    with pytest.raises(ValueError, match="inmet_bad.csv"):
        scan_station_csv(spark, folder)
    assert files.scan_glob_union(spark, [folder, folder]).count() == 1
    listed = {os.path.basename(r["file"]): r["header_at"] is not None for r in read_station_files(spark, folder, path_glob="*INMET*.csv", on_bad_file="skip").files.collect()}
    assert listed == {"INMET_a.CSV": True, "inmet_bad.csv": False}


def test_lines_are_written_once(spark, tmp_path):
    for k in range(3):
        station_file(spark, tmp_path, f"f{k}.csv", [HEADER, *[f"2024/01/01;{h:02d}00 UTC;1;2;" for h in range(20)]])
    df = scan_station_csv(spark, f"file://{tmp_path}")
    assert work(df)[0] <= 63 + 3  # the written lines, and the table of headers
    assert df.count() == 60


@pytest.fixture
def replanned(spark):
    """Sets how many splits Spark plans; put back afterwards."""
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n, None) for n in names}

    def plan(number, size="128MB"):
        for n, v in zip(names, (number, size, "1"), strict=True):
            spark.conf.unset(n) if v is None else spark.conf.set(n, str(v))

    yield plan
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_rows_do_not_depend_on_split_planning(spark, tmp_path, replanned):
    """Six files of 950 rows, planned anew between the call and the action."""
    for k in range(6):
        rows = [f"2024/01/{1 + i % 28:02d};{i % 24:02d}00 UTC;{i};{k};" for i in range(950)]
        station_file(spark, tmp_path, f"f{k}.csv", ["REGIAO:;SE", "ESTACAO:;X", HEADER, *rows])
    for before, after in ((None, None), (1, 50), (50, 1), (2, 3), (3, 2), (50, 2)):
        replanned(before)
        df = scan_station_csv(spark, f"file://{tmp_path}")
        replanned(after)
        found = df.groupBy("source_file").count().collect()
        assert len(found) == 6 and {r["count"] for r in found} == {950}


def test_a_file_of_several_splits(spark, tmp_path, replanned):
    rows = [f"2024/01/{1 + i % 28:02d};{i % 24:02d}00 UTC;{i};7;" for i in range(3000)]
    station_file(spark, tmp_path, "f.csv", ["REGIAO:;SE", "Aviso", HEADER, *rows])
    replanned(40, "4KB")
    read = read_station_files(spark, f"file://{tmp_path}")
    assert read.lines.select("at.block").distinct().count() > 10
    replanned(1)
    values = sorted(int(r[2]) for r in read.rows.collect())
    assert values == list(range(3000))


def test_bad_files_and_lines_are_quarantined(spark, tmp_path):
    import gzip

    good = [HEADER, *[f"2024/01/01;{h:02d}00 UTC;1;2;" for h in range(20)]]
    station_file(spark, tmp_path, "inmet_a.csv", ["REGIAO:;SE", *good])
    station_file(spark, tmp_path, "inmet_wide.csv", [*good, "2024/01/02;0000 UTC;1;2;3;", "2024/01/02;0100 UTC;1;2;;"])
    station_file(spark, tmp_path, "inmet_bare.csv", ["2024/01/01;0000 UTC;1;2;", "x"])
    packed = gzip.compress("\r\n".join(good * 50).encode("latin-1"))
    for name, content in (("inmet_cut.csv.gz", packed[: len(packed) // 2]), ("inmet_noise.csv.gz", b"no gzip at all"), ("inmet_whole.csv.gz", packed), ("inmet_two.csv.gz", gzip.compress(b"") + packed)):
        (tmp_path / name).write_bytes(content)
    read = files.read_glob_union(spark, f"file://{tmp_path}", path_glob="*inmet*.csv*")
    held = {(os.path.basename(r["file"]), r["text"], r["reason"].split(":")[0]) for r in read.quarantine.collect()}
    assert held == {
        ("inmet_bare.csv", "2024/01/01;0000 UTC;1;2;", "no header"),
        ("inmet_bare.csv", "x", "no header"),
        ("inmet_wide.csv", "2024/01/02;0000 UTC;1;2;3;", "extra fields"),
        ("inmet_cut.csv.gz", None, "truncated gzip"),
        ("inmet_noise.csv.gz", None, "broken gzip"),
    }
    heads = 2 + 1 + 1 + 1  # preamble and header lines
    assert read.rows.count() + read.quarantine.where("text is not null").count() + heads == read.lines.count()
    assert read.rows.count() == 20 + 21 + 2 * (50 * 21 - 1)
    assert read.quarantine.where("text is not null and address is null").count() == 0


def test_lines_that_do_not_fit_are_an_error_unless_skipped(spark, tmp_path):
    station_file(spark, tmp_path, "f.csv", [HEADER, "2024/01/01;0000 UTC;1;2;3;"])
    with pytest.raises(Exception, match="more values than header fields"):
        scan_station_csv(spark, f"file://{tmp_path}").collect()


def test_an_unreadable_file_is_found_by_the_scan(spark, tmp_path):
    """A file whose checksum fails is no broken archive; the scan itself names it."""
    folder = tmp_path / "checked"
    spark.createDataFrame([(HEADER,), ("2024/01/01;0000 UTC;1;2;",)], "line string").coalesce(1).write.text(str(folder / "good"))
    spark.createDataFrame([(HEADER,), ("2024/01/01;0100 UTC;1;2;",)], "line string").coalesce(1).write.text(str(folder / "bad"))
    part = next((folder / "bad").glob("part-*.txt"))
    part.write_bytes(part.read_bytes().replace(b"0100", b"0200"))
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        scan_station_csv(spark, f"file://{folder}", recursive=True)
    read = read_station_files(spark, f"file://{folder}", recursive=True, on_bad_file="skip")
    assert read.rows.count() == 1
    assert [(os.path.basename(r["file"]), r["reason"]) for r in read.quarantine.collect()] == [(part.name, "unreadable")]


def test_two_yearly_files_of_a_station_are_one_series(spark, tmp_path):
    for year, first in ((2022, "2022/12/31"), (2023, "2023/01/01")):
        rows = [f"{first};{h:02d}00 UTC;{h + 0.5 if year == 2022 else 100 + h};{50 + h};" for h in range(24)]
        station_file(spark, tmp_path, f"INMET_SE_MG_A521_X_01-01-{year}_A_31-12-{year}.CSV", [HEADER, *rows])
    out = preprocess.preprocess_file(spark, f"file://{tmp_path}", create_lags=True)
    assert {r["station"] for r in out.select("station").distinct().collect()} == {"A521"}
    assert out.count() == 48 - 6  # only the station's very first rows lack lags
    row = out.where("datetime = timestamp_ntz'2023-01-01 00:00:00'").first()
    assert row["TEMPERATURA DO AR - BULBO SECO, HORARIA (°C)_lag_1h"] == 23.5


def test_lag_columns_are_a_parameter(spark, tmp_path):
    station_file(spark, tmp_path, "f.csv", [HEADER, *[f"2024/01/01;{h:02d}00 UTC;{h};{50 + h};" for h in range(12)]])
    df = scan_station_csv(spark, f"file://{tmp_path}")
    assert len(preprocess.lag_candidates(df.columns)) == 2
    out = preprocess.fit_transform(df, create_lags=True, lag_columns=[HEADER.split(";")[3]])
    assert [c for c in out.columns if "_lag_" in c] == [f"{HEADER.split(';')[3]}_lag_{n}h" for n in (1, 3, 6)]


def test_broken_model_is_an_error(spark, tmp_path):
    bundle = persist.ModelBundle(["x"], {"x": 0.0}, None, [])
    path = f"file://{tmp_path}/bundle"
    persist.save_bundle(bundle, path)
    with pytest.raises(FileNotFoundError):
        persist.load_bundle(spark, path)
    os.makedirs(f"{tmp_path}/bundle/classifier/metadata")
    with pytest.raises(Exception) as found:
        persist.load_bundle(spark, path)
    assert not isinstance(found.value, FileNotFoundError)
