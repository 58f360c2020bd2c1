"""Raw CSV extracts: contract, typing, month skipping, repeated loads."""

import csv
import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from turnline.schema import FLIGHT_NAMES, FLIGHTS, LINKS, SOURCE_NAMES
from turnline.sources.flights_csv import ingest, read_raw, typed_flights, write_raw
from turnline.sources.links_csv import read_links_csv, write_links_csv
from turnline.sources.tables import (
    candidate_months, months_of, months_pending, read_table, with_month, write_flights, write_links,
)

ROW = {
    "FlightDate": "2024-01-05", "Reporting_Airline": "AA", "Tail_Number": "N1",
    "Flight_Number_Reporting_Airline": "23.0", "Origin": "ATL", "Dest": "JFK", "CRSDepTime": "2400",
    "DepTime": "5.0", "DepDelayMinutes": "5.0", "CRSArrTime": "200", "ArrTime": "", "ArrDelayMinutes": "",
    "ArrDel15": "", "Cancelled": "0.0", "Diverted": "1.0", "CancellationCode": "", "CRSElapsedTime": "120.0",
    "Distance": "760.0",
}


def write_csv(path, rows, header=None, extra=("Unused",)):
    header = list(header or [*reversed(SOURCE_NAMES), *extra])
    with open(path, "w", newline="") as file:
        writer = csv.DictWriter(file, header, restval="", extrasaction="ignore")
        writer.writeheader()
        writer.writerows({**ROW, **row} for row in rows)


def test_columns_are_mapped_by_name_and_typed(spark, tmp_path):
    write_csv(tmp_path / "flights_2024_01.csv", [{"Unused": "x"}, {"Cancelled": "1", "ArrDel15": "1.0", "Tail_Number": ""}])
    flights = typed_flights(read_raw(spark, f"{tmp_path}/flights_2024_*.csv"))
    assert flights.schema.simpleString() == FLIGHTS.simpleString()
    first, second = flights.orderBy("cancelled").collect()
    assert first.flight_date == dt.date(2024, 1, 5)
    assert (first.flight_number, first.crs_dep_time, first.distance) == (23, 2400, 760)
    assert (first.cancelled, first.diverted, first.arr_del15) == (False, True, None)
    assert (first.arr_time, first.cancellation_code, first.tail_number) == (None, None, "N1")
    assert (second.cancelled, second.arr_del15, second.tail_number) == (True, True, None)


def test_a_missing_column_is_named(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [{}], header=[n for n in SOURCE_NAMES if n not in ("AirTime", "Dest")])
    with pytest.raises(ValueError, match="Dest, AirTime|AirTime, Dest"):
        read_raw(spark, str(tmp_path / "a.csv"))


@pytest.mark.parametrize("bad", ["23.5", "soon"])
def test_what_is_no_whole_number_fails(spark, tmp_path, bad):
    write_csv(tmp_path / "a.csv", [{"Distance": bad}])
    with pytest.raises(Exception, match="Distance holds no whole number"):
        typed_flights(read_raw(spark, str(tmp_path / "a.csv"))).collect()


def test_files_of_differing_column_order_are_read_by_name(spark, tmp_path):
    write_csv(tmp_path / "flights_2024_01.csv", [{"Origin": "AAA"}], header=SOURCE_NAMES)
    write_csv(tmp_path / "flights_2024_02.csv", [{"Origin": "BBB"}], header=tuple(reversed(SOURCE_NAMES)))
    write_csv(tmp_path / "flights_2024_03.csv", [{"Origin": "CCC"}], extra=("Unused", "More"))
    with gzip.open(tmp_path / "flights_2024_04.csv.gz", "wt") as file:
        write_csv(tmp_path / "plain", [{"Origin": "DDD"}], header=("More", *SOURCE_NAMES))
        file.write((tmp_path / "plain").read_text())
    pattern = f"{tmp_path}/flights_2024_*.csv*"
    rows = typed_flights(read_raw(spark, pattern)).collect()
    assert sorted(r.origin for r in rows) == ["AAA", "BBB", "CCC", "DDD"]
    assert {(r.distance, r.crs_elapsed_time, r.diverted) for r in rows} == {(760, 120, True)}
    table = ingest(spark, pattern, str(tmp_path / "table"))
    assert table.count() == 4 and table.select("source_file").distinct().count() == 4


def test_a_failed_replacement_leaves_the_table_as_it_was(spark, tmp_path):
    pattern, target = f"{tmp_path}/flights_2024_*.csv", str(tmp_path / "table")
    write_csv(tmp_path / "flights_2024_01.csv", [{}] * 3)
    write_csv(tmp_path / "flights_2024_02.csv", [{}] * 2)
    ingest(spark, pattern, target)
    write_csv(tmp_path / "flights_2024_02.csv", [{"Distance": "soon"}])
    with pytest.raises(Exception, match="Distance holds no whole number"):
        ingest(spark, pattern, target, skip_present=False)
    assert read_table(spark, target).count() == 5
    write_csv(tmp_path / "flights_2024_01.csv", [])  # a file may come back empty
    write_csv(tmp_path / "flights_2024_02.csv", [{"FlightDate": "2024-05-01"}])
    assert [str(r.flight_date) for r in ingest(spark, pattern, target, skip_present=False).collect()] == ["2024-05-01"]
    assert not [p for p in (tmp_path / "table").iterdir() if p.name.startswith("_replaced") or p.name.startswith("_loading")]


@pytest.mark.parametrize("skip_present", [True, False])
def test_no_row_is_lost_when_a_file_holds_another_month(spark, tmp_path, skip_present):
    january, february = tmp_path / "flights_2024_01.csv", tmp_path / "flights_2024_02.csv"
    pattern, target = f"{tmp_path}/flights_2024_*.csv", str(tmp_path / "table")
    write_csv(january, [{}] * 4)
    assert ingest(spark, pattern, target, skip_present).count() == 4
    write_csv(february, [{"FlightDate": "2024-02-01"}, {}])
    assert ingest(spark, pattern, target, skip_present).count() == 6
    assert ingest(spark, pattern, target, skip_present).count() == 6
    write_csv(january, [{}] * 7)
    assert ingest(spark, pattern, target, skip_present).count() == (6 if skip_present else 9)
    pending = months_pending(candidate_months(spark, 2024, 2024), read_table(spark, target))
    assert sorted(r.flight_month for r in pending.collect()) == list(range(3, 13))


def test_a_loaded_file_is_not_read_again(spark, tmp_path):
    pattern, target = f"{tmp_path}/flights_2024_*.csv", str(tmp_path / "table")
    write_csv(tmp_path / "flights_2024_01.csv", [{}])
    ingest(spark, pattern, target)
    write_csv(tmp_path / "flights_2024_01.csv", [{"Distance": "soon"}])  # reading it would fail
    assert ingest(spark, pattern, target).count() == 1


def test_round_trip_of_derived_flights(spark, flights, tmp_path):
    write_raw(flights, str(tmp_path / "raw"))
    back = typed_flights(read_raw(spark, f"{tmp_path}/raw/month=*"))
    stored = flights.select(*FLIGHT_NAMES)
    assert back.exceptAll(stored).isEmpty() and stored.exceptAll(back).isEmpty()


def test_stored_tables_keep_types_and_rows(spark, flights, links, tmp_path):
    write_flights(flights, str(tmp_path / "f"))
    write_links(links, str(tmp_path / "l"))
    for path, schema, table in (("f", FLIGHTS, flights), ("l", LINKS, links)):
        back = read_table(spark, str(tmp_path / path))
        assert back.select(*schema.names).schema.simpleString() == schema.simpleString()
        assert back.count() == table.count()
        assert back.where((F.year("flight_date") != F.col("flight_year"))
                          | (F.month("flight_date") != F.col("flight_month"))).isEmpty()
    assert months_of(flights).count() == months_of(with_month(flights.drop("flight_year", "flight_month"))).count()


def test_links_survive_csv(spark, links, tmp_path):
    write_links_csv(links, str(tmp_path / "links"))
    back = read_links_csv(spark, str(tmp_path / "links"))
    stored = links.select(*LINKS.names)
    assert back.schema.simpleString() == LINKS.simpleString()
    assert back.exceptAll(stored).isEmpty() and stored.exceptAll(back).isEmpty()
