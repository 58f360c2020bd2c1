"""The shared folder and independence from session settings."""

from turnline.operators.rotation import rotation_links
from turnline.session import shared_folder
from turnline.sources import derived
from turnline.sources.lineitem import airports


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == (named or shared_folder(spark)).rstrip("/")


def test_without_a_shared_folder_tables_are_derived_in_place(spark, data_dir, monkeypatch):
    monkeypatch.setattr(derived, "shared_folder", lambda _: None)
    monkeypatch.setattr(derived, "_paths", {})
    assert derived.links(spark, data_dir).count() > 0
    assert derived._paths == {}


def test_a_table_is_written_once(spark, data_dir):
    before = derived.flights(spark, data_dir).inputFiles()
    assert derived.flights(spark, data_dir).inputFiles() == before


def test_links_do_not_depend_on_zone_ansi_or_partitions(spark, flights):
    expected = rotation_links(flights, airports(spark)).cache()
    assert expected.count() > 0
    settings = {
        "spark.sql.session.timeZone": "America/Los_Angeles",
        "spark.sql.ansi.enabled": "false",
        "spark.sql.shuffle.partitions": "31",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        other = rotation_links(flights, airports(spark))
        assert expected.exceptAll(other).isEmpty() and other.exceptAll(expected).isEmpty()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    expected.unpersist()
