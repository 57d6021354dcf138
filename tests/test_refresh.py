"""A refresh replaces all tables at once or none."""
import pytest
from test_cleaning import write_raw

from shelfwise.functions import staging, versions
from shelfwise.plans import refresh as job
from shelfwise.sources import files


def units(spark, folder):
    t = files.load_clean(spark, folder)
    return t.sales.agg({"quantity": "sum"}).first()[0], t.inventory.agg({"current_stock": "sum"}).first()[0]


@pytest.fixture
def folders(spark, tables, tmp_path):
    first, second = str(tmp_path / "raw-1"), str(tmp_path / "raw-2")
    write_raw(spark, tables, first)
    more = tables.with_(sales=tables.sales.withColumns({"quantity": tables.sales["quantity"] * 2, "revenue": tables.sales["revenue"] * 2}),
                        inventory=tables.inventory.withColumn("current_stock", tables.inventory["current_stock"] + 1))
    write_raw(spark, more, second)
    return first, second, str(tmp_path / "clean")


@pytest.mark.parametrize("broken", ["sales", "write_report"])
def test_failure_between_tables_leaves_the_old_version(spark, folders, monkeypatch, broken):
    first, second, clean = folders
    job.refresh(spark, first, clean, csv=False)
    before = units(spark, clean)

    def die(*_):
        raise OSError("killed")

    if broken == "sales":  # the small tables are written, sales are not
        monkeypatch.setattr(files, "month_of", die)
    else:  # all tables are written, the version is not in force yet
        monkeypatch.setattr(job, "write_report", die)
    with pytest.raises(OSError, match="killed"):
        job.refresh(spark, second, clean, csv=False)
    assert units(spark, clean) == before
    monkeypatch.undo()
    job.refresh(spark, second, clean, csv=False)
    assert units(spark, clean) == (before[0] * 2, before[1] + 6)


def test_old_versions_expire_and_readers_that_have_begun_go_on(spark, folders):
    first, second, clean = folders
    for raw in (first, second):
        job.refresh(spark, raw, clean, csv=False)
    held = files.load_clean(spark, clean)
    oldest = versions.read(spark, clean, 1)["tables"]
    job.refresh(spark, first, clean, csv=False)
    assert held.sales.agg({"quantity": "sum"}).first()[0] == 2 * units(spark, clean)[0]
    assert versions.numbers(spark, clean) == [2, 3] and not staging.exists(spark, f"{clean}/{oldest}")


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    folder = str(tmp_path / "states")
    assert versions.current(spark, folder) is None
    assert versions.publish(spark, folder, {"a": "é"}) == 1
    with pytest.raises(RuntimeError, match="another job"):
        versions.publish(spark, folder, {"a": 2}, after=0)
    assert versions.current(spark, folder) == (1, {"a": "é"})


def test_setting_is_put_back_after_stages_at_once(spark):
    before = spark.conf.get(staging.CLEANUP_CONF, None)
    for _ in range(3):
        staging.together(*[lambda n=n: staging.stage(spark.range(10 * n).repartition(3), "at-once") for n in range(1, 9)])
        assert spark.conf.get(staging.CLEANUP_CONF, None) == before
