"""Drops with drifted headers, and the panel that follows them version by version."""

import csv
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bunkerline import reference as ref
from bunkerline.sources import filings, panel_store
from bunkerline.sources.drops import DropReader, layout_report, read_drops

HEADER = {name: header for name, header, *_ in ref.FILING_COLUMNS}
NEEDED = [name for name, _, _, _, needed, _ in ref.FILING_COLUMNS if needed]


def row(imo, fuel, year="", **other):
    return {**{n: "" for n in NEEDED}, "imo": str(imo), "total_fuel_t": str(fuel), "reporting_period": str(year), **other}


def write_csv(path, rows, names=None, rename=lambda h: h, extra=()):
    names = names or list(rows[0])
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow([*[rename(HEADER[n]) for n in names], *[e for e, _ in extra]])
        for r in rows:
            writer.writerow([*[r.get(n, "") for n in names], *[v for _, v in extra]])


def test_any_cut_gives_the_same_rows(spark, tmp_path):
    rows = [row(i, i * 10, 2019, ship_name=f'The "{"x" * (i % 40)}", {i}') for i in range(1, 60)]
    write_csv(f"{tmp_path}/2019.csv", rows)
    want = [(r["imo"], r["ship_name"]) for r in rows]
    for size in (37, 211, 1000, 1 << 20):
        got = read_drops(spark, str(tmp_path), split_bytes=size).orderBy("drop_order").select("imo", "ship_name").collect()
        assert [tuple(r) for r in got] == want, size


def test_last_line_without_end_and_blank_lines(spark, tmp_path):
    write_csv(f"{tmp_path}/2019.csv", [row(1, 5), row(2, 6)])
    with open(f"{tmp_path}/2019.csv", "rb+") as f:
        text = f.read().rstrip(b"\n")
        f.seek(0), f.truncate()
        f.write(text.replace(b"\n", b"\n\n\n"))
    for size in (50, 1 << 20):
        assert sorted(r["imo"] for r in read_drops(spark, str(tmp_path), split_bytes=size).collect()) == ["1", "2"]


def test_layouts_and_formats_meet(spark, tmp_path):
    write_csv(f"{tmp_path}/2019/a.csv", [row(1, 5)], rename=lambda h: f"  {h.upper()} ")
    names = [*reversed(NEEDED), "total_ch4_t"]
    table = pa.table({HEADER[n]: pa.array([{"imo": 2, "total_fuel_t": 7.5, "total_ch4_t": 0.25}.get(n)] * 3000) for n in names} | {"Stranger": pa.array(["x"] * 3000)})
    os.makedirs(f"{tmp_path}/2020")
    pq.write_table(table, f"{tmp_path}/2020/b.parquet", row_group_size=100)
    both = read_drops(spark, str(tmp_path), split_bytes=500)
    got = {r["file_period"]: r for r in both.groupBy("file_period").agg(F.count("*").alias("n"), F.min("total_fuel_t").alias("fuel"), F.max("total_ch4_t").alias("ch4")).collect()}
    assert (got[2019]["n"], got[2019]["fuel"], got[2019]["ch4"]) == (1, "5", None)
    assert (got[2020]["n"], got[2020]["fuel"], got[2020]["ch4"]) == (3000, "7.5", "0.25")  # each row group in one range
    found = {(r["file_period"], r["status"], r["header"] or r["column"]) for r in layout_report(spark, str(tmp_path)).collect()}
    assert (2020, "unconsumed", "Stranger") in found and (2019, "missing", "total_ch4_t") in found


def test_period_filter_drops_files(spark, tmp_path):
    write_csv(f"{tmp_path}/filings_2019.csv", [row(1, 5)])
    write_csv(f"{tmp_path}/filings_2020_v3.csv", [row(2, 5)])
    (tmp_path / "filings_2021.csv").write_text("no such header\n1\n")  # would raise if it were opened
    got = read_drops(spark, str(tmp_path)).where("file_period between 2019 and 2020").collect()
    assert sorted((r["imo"], r["file_version"]) for r in got) == [("1", 0), ("2", 3)]
    with pytest.raises(Exception, match="required columns absent"):
        read_drops(spark, str(tmp_path)).where("file_period = 2021").collect()
    assert read_drops(spark, str(tmp_path)).where("file_period = 1999").collect() == []
    reader = DropReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, In

    assert list(reader.pushFilters([In(("file_period",), (2019, 2021)), EqualTo(("imo",), "1")])) == [EqualTo(("imo",), "1")]
    assert [p.path[-8:-4] for p in reader.partitions()] == ["2019", "2021"]


def test_empty_drop(spark, tmp_path):
    write_csv(f"{tmp_path}/2019.csv", [], names=NEEDED)
    with pytest.raises(Exception, match="no data rows"):
        read_drops(spark, str(tmp_path)).collect()
    assert read_drops(spark, str(tmp_path), allow_empty=True).collect() == []


def panel(spark, root, **kw):
    rows = panel_store.read_panel(spark, str(root), **kw).collect()
    return sorted((r["imo"], r["reporting_period"], r["total_fuel_t"]) for r in rows)


def full_build(spark, path):
    text = read_drops(spark, str(path), keep=("report_coverage",))
    rows = panel_store.best_rows(text)
    rows = filings.deduplicate(rows, ("imo", "reporting_period"), panel_store.ORDER)
    return sorted((r["imo"], r["reporting_period"], r["total_fuel_t"]) for r in rows.collect())


def test_rewriting_one_drop_rebuilds_one_period(spark, tmp_path):
    drops, root = tmp_path / "drops", tmp_path / "panel"
    # ship 3 is filed twice, once in the file of another year and there with fewer cells
    write_csv(f"{drops}/2019.csv", [row(1, 10), row(2, 20), row(3, 30, ship_type="Oil tanker")])
    write_csv(f"{drops}/2020.csv", [row(1, 11), row(3, 99, 2019)])
    write_csv(f"{drops}/2021.csv", [row(1, 12)])
    assert panel_store.refresh(spark, str(drops), str(root)) == ["2019", "2020", "2021"]
    assert panel(spark, root) == full_build(spark, drops) == [(1, 2019, 10.0), (1, 2020, 11.0), (1, 2021, 12.0), (2, 2019, 20.0), (3, 2019, 30.0)]
    before = panel_store.current(spark, str(root))
    assert panel_store.refresh(spark, str(drops), str(root)) == []

    opened = panel_store.read_panel(spark, str(root))
    write_csv(f"{drops}/2020.csv", [row(1, 11.5), row(4, 44)])
    assert panel_store.refresh(spark, str(drops), str(root)) == ["2020"]
    after = panel_store.current(spark, str(root))
    assert panel(spark, root) == full_build(spark, drops)
    assert after.files["2019"] == before.files["2019"] and after.files["2021"] == before.files["2021"]
    assert after.panel["2021"] == before.panel["2021"] and after.panel["2019"] != before.panel["2019"]  # its late row went
    assert opened.count() == 5 and panel(spark, root, version=before.version)[1] == (1, 2020, 11.0)

    os.remove(f"{drops}/2021.csv")
    write_csv(f"{drops}/2019_v2.csv", [row(1, 10.5)])  # a newer version replaces the whole first one
    assert panel_store.refresh(spark, str(drops), str(root)) == ["2019", "2021"]
    assert panel(spark, root) == full_build(spark, drops) == [(1, 2019, 10.5), (1, 2020, 11.5), (4, 2020, 44.0)]
    assert panel(spark, root, periods=[2020]) == [(1, 2020, 11.5), (4, 2020, 44.0)] and panel(spark, root, periods=[1990]) == []

    panel_store.expire(spark, str(root), keep=1)
    assert panel(spark, root) == full_build(spark, drops)
    with pytest.raises(Exception):
        panel_store.read_panel(spark, str(root), version=before.version)


def test_a_version_is_published_once(spark, tmp_path):
    store = panel_store._Store(spark, str(tmp_path))
    store.publish(panel_store.Manifest(1))
    with pytest.raises(panel_store.VersionTaken):
        store.publish(panel_store.Manifest(1, batches={"other": 1}))
    assert store.newest().batches == {} and store.versions() == [1]


def test_batches_in_any_order_and_twice(spark, tmp_path):
    names = "file_order string, source_file string, imo bigint, reporting_period int, total_fuel_t double, file_version int"
    batches = [
        [("a", "f1", 1, 2019, 10.0, 1), ("b", "f1", 2, 2019, 20.0, 1), ("c", "f2", 1, 2020, 11.0, 1)],
        [("d", "f3", 1, 2019, 12.0, 2)],
        [("e", "f4", 1, 2019, 99.0, 1), ("f", "f5", 5, 2020, 50.0, 1)],
    ]
    want = [(1, 2019, 12.0), (1, 2020, 11.0), (5, 2020, 50.0)]
    for n, order in enumerate(([0, 1, 2], [2, 1, 0], [1, 0, 2, 0])):
        root = tmp_path / str(n)
        for number in order:
            panel_store.merge(spark.createDataFrame(batches[number], names), str(root))
        assert panel(spark, root) == want, order
    version = panel_store.current(spark, str(root)).version
    assert panel_store.merge(spark.createDataFrame(batches[0], names), str(root), "s", 7)
    assert not panel_store.merge(spark.createDataFrame(batches[1], names), str(root), "s", 7)
    assert panel_store.current(spark, str(root)).version == version + 1
