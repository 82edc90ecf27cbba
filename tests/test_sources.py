from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from helpers import raises_in_job, series_rows
from pyspark.sql import functions as F

from monthgrain.contracts import ContractError
from monthgrain.operators import reconcile
from monthgrain.sources import bond, large_payload, ledger, rent, snapshots, staging, store
from monthgrain.streaming.snapshot_feed import follow_staging

HEADER = ",".join(bond.RAW_COLUMNS)
LINES = ["1/07/2026,2,North,10,30,5,500,490,550,450,0.25", "1/07/2026,-1,NA,1,3,0,480,470,500,460,0.5"]
AT = "2026-08-01T00:00:00+00:00"
BOND_TABLE = (
    "period_date date, geography_level string, location_id int, location_name string, bonds_lodged bigint, "
    "active_bonds bigint, bonds_closed bigint, median_rent decimal(18,4), geometric_mean_rent decimal(18,4), "
    "upper_quartile_rent decimal(18,4), lower_quartile_rent decimal(18,4), log_std_dev_weekly_rent decimal(18,4)"
)


def write(path, lines, header=HEADER):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def failed(checks):
    return {r.check_name: r.observed for r in checks.collect() if not r.passed}


# ---- bond files ---------------------------------------------------------------------------------


def test_bond_scan_keeps_na_text(spark, tmp_path):
    raw = bond.scan_bonds(spark, write(tmp_path / "a.csv", LINES))
    assert failed(bond.bond_checks(raw)) == {}
    assert {r.location for r in raw.collect()} == {"North", "NA"}


def test_bond_header_must_match_in_order(spark, tmp_path):
    swapped = HEADER.replace("TimeFrame,location_id", "location_id,TimeFrame")
    with pytest.raises(Exception, match="header"):
        bond.scan_bonds(spark, write(tmp_path / "a.csv", LINES, swapped)).collect()


@pytest.mark.parametrize(
    "line, check",
    [
        ("2026-07-01,2,North,10,30,5,500,490,550,450,0.25", "month_start"),
        ("2/07/2026,2,North,10,30,5,500,490,550,450,0.25", "month_start"),
        ("1/07/2026,2,  ,10,30,5,500,490,550,450,0.25", "location_present"),
        ("1/07/2026,2,North,10.5,30,5,500,490,550,450,0.25", "whole_LodgedBonds"),
        ("1/07/2026,2,North,10,30,5,,490,550,450,0.25", "whole_MedianRent"),
        ("1/07/2026,2,North,10,30,5,500,490,550,450,x", "numeric_LogStdDevWeeklyRent"),
    ],
)
def test_bond_checks_name_the_problem(spark, tmp_path, line, check):
    raw = bond.scan_bonds(spark, write(tmp_path / "a.csv", [*LINES, line]))
    assert failed(bond.bond_checks(raw)) == {check: 1}


def test_bond_mapping_and_unsupported_dataset(spark, tmp_path):
    raw = bond.scan_bonds(spark, write(tmp_path / "a.csv", LINES))
    lineage = {"source_snapshot": "a.csv", "retrieved_at_utc": AT, "is_provisional": True}
    rows = bond.map_bond_columns(raw, dataset="region", **lineage)
    assert tuple(rows.columns) == bond.STAGING_COLUMNS
    assert {r.period_date for r in rows.collect()} == {dt.date(2026, 7, 1)}
    with pytest.raises(ContractError):
        bond.map_bond_columns(raw, dataset="suburb", **lineage)


# ---- rent payloads ----------------------------------------------------------------------------------


def item(**changes):
    base = {"area": "North", "dwell": "ALL", "nBedrms": "NA", **{n: 1.5 for n in rent.NUMBER_FIELDS}}
    return {k: v for k, v in {**base, **changes}.items() if v != "DROP"}


def payload(tmp_path, items, period="2026-7-1/2026-7-31", **extra):
    path = tmp_path / "statistics_1.json"
    path.write_text(json.dumps({"areaDefinition": "REGC2019", "periodCovered": period, "items": items, **extra}, indent=1))
    return str(path)


def test_payload_explodes_with_typed_period(spark, tmp_path):
    rows = rent.explode_items(rent.scan_payloads(spark, payload(tmp_path, [item(), item(area="South", mean=None)])))
    staged = rent.map_rent_columns(rows, AT).orderBy("area")
    assert tuple(staged.columns) == rent.STAGING_COLUMNS
    first, second = staged.collect()
    assert (first.period_start, first.period_end) == (dt.date(2026, 7, 1), dt.date(2026, 7, 31))
    assert first.bedrooms == "NA" and first.source_snapshot == "statistics_1.json" and second.mean_rent is None


def test_bad_period_and_bad_json_fail(spark, tmp_path):
    raises_in_job(rent.explode_items(rent.scan_payloads(spark, payload(tmp_path, [item()], "2026-7-31/2026-7-1"))), "periodCovered")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "statistics_2.json").write_text("{oops")
    with pytest.raises(Exception, match="MALFORMED|parse"):
        rent.scan_payloads(spark, str(tmp_path / "broken")).collect()


@pytest.mark.parametrize(
    "items, check",
    [
        ([item()], None),
        ([item(mean=None)], None),
        ([], "items_present"),
        ([item(), item(suq="DROP")], "item_fields"),
        ([item(med="510")], "number_fields"),
        ([item(nCurr=True)], "number_fields"),
        ([item(area=" ")], "text_fields"),
        ([item(dwell=3)], "text_fields"),
    ],
)
def test_payload_checks(spark, tmp_path, items, check):
    raw = rent.scan_payloads(spark, payload(tmp_path, items), raw_items=True)
    assert set(failed(rent.payload_checks(raw))) == ({check} if check else set())


ODD_TEXT = ['a}b', 'x]},{"items":[', "tail\\\\", 'quote " inside \\" }', "line\nbreak }", "é{ö}", "}" * 40]


@pytest.mark.parametrize("piece", ["97b", "1k", "128m"])
@pytest.mark.parametrize("shape", [{"indent": 1}, {"separators": (",", ":")}])
def test_large_payload_has_the_rows_of_the_plain_scan(spark, tmp_path, piece, shape):
    items = [item(area=f"{t} {i}", mean=None, note={"deep": [{"x": t}]}) for i, t in enumerate(ODD_TEXT * 6)]
    for k, own in enumerate((items, items[:1])):
        whole = {"areaDefinition": 'REG } "C"', "items": own, "periodCovered": "2026-7-1/2026-7-31"}
        (tmp_path / f"statistics_{k}.json").write_text(json.dumps(whole, ensure_ascii=False, **shape) + "\n" * k)
    plain = sorted(map(str, rent.explode_items(rent.scan_payloads(spark, str(tmp_path))).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    try:
        split = large_payload._fragments(spark, str(tmp_path)).rdd.getNumPartitions()
        assert split > 20 or piece != "97b"
        rows = rent.explode_items(large_payload.scan_large_payloads(spark, str(tmp_path)))
        assert sorted(map(str, rows.collect())) == plain
        raw = large_payload.scan_large_payloads(spark, str(tmp_path), raw_items=True)
        assert raw.count() == len(items) + 1 and not failed(rent.payload_checks(raw))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(
    "text, rows",
    [
        ('{"areaDefinition": "R", "periodCovered": "p", "items": []}', [("R", "p", 0)]),
        ('{"areaDefinition": "R", "periodCovered": "p"}\n', [("R", "p", None)]),
        ('{"areaDefinition": "R", "items": [{"area": "x"}]', None),
        ('{"areaDefinition": "R", "items": [{"area": "x"}', None),
        ('{"areaDefinition": "R", "items": [{"area": "x"} {"area": "y"}]}', None),
        ('{"areaDefinition": "R", "items": [{"area": "x"}, {"area": oops}]}', None),
        ('{"areaDefinition": "R", "items": [{"area": "x"}], "more": [{"area": "y"}]}', None),
        ('{"areaDefinition": "R", "items": [1, 2]}', None),
    ],
)
def test_large_payload_fails_like_the_plain_scan(spark, tmp_path, text, rows):
    (tmp_path / "statistics_1.json").write_text(text)
    scan = lambda: large_payload.scan_large_payloads(spark, str(tmp_path)).collect()
    if rows is None:
        with pytest.raises(Exception, match="MALFORMED|parse"):
            scan()
    else:
        assert [(r.areaDefinition, r.periodCovered, None if r["items"] is None else len(r["items"])) for r in scan()] == rows


def test_rent_types_allow_missing_but_not_malformed(spark, tmp_path):
    payloads = rent.scan_payloads(spark, payload(tmp_path, [item(nLodged=4, nClosed=2, nCurr=3)]))
    rows = rent.map_rent_columns(rent.explode_items(payloads), AT)
    typed = rent.typed_rents(rows.withColumn("bonds_closed", F.lit(None)).withColumn("active_bonds", F.lit("3.0"))).first()
    assert (typed.bonds_lodged, typed.bonds_closed, typed.active_bonds) == (4, None, 3)
    raises_in_job(rent.typed_rents(rows.withColumn("active_bonds", F.lit("3.5"))), "active_bonds")
    raises_in_job(rent.typed_rents(rows.withColumn("period_start", F.lit("not-a-date"))), "period_start")
    raises_in_job(rent.typed_rents(rows.withColumn("area", F.lit("  "))), "area_name")


# ---- snapshots and lineage ------------------------------------------------------------------------------


def snapshot(root, day, name, dataset="region", lines=LINES, **changes):
    path = root / day / f"{name}.csv"
    write(path, lines)
    content = path.read_bytes()
    meta = {
        "raw_file": path.name,
        "dataset": dataset,
        "retrieved_at_utc": AT,
        "sha256": hashlib.sha256(content).hexdigest(),
        "provisional": True,
        **changes,
    }
    (root / day / f"{name}.metadata.json").write_text(json.dumps(meta, indent=1))
    return path


def attached(spark, root):
    found = snapshots.scan_snapshots(spark, str(root))
    return snapshots.attach_metadata(found, snapshots.scan_metadata(spark, str(root)))


def test_snapshot_identity_and_latest(spark, tmp_path):
    snapshot(tmp_path, "2026/07/01", "rental_bond_region_20260701T000000Z")
    newest = snapshot(tmp_path, "2026/08/01", "rental_bond_region_20260801T000000Z", lines=LINES[:1])
    snapshot(tmp_path, "2026/07/15", "rental_bond_territorial_authority_20260715T000000Z", "territorial_authority")
    rows = attached(spark, tmp_path).collect()
    assert len(rows) == 3 and {r.problem for r in rows} == {None}
    row = next(r for r in rows if r.file_name == newest.name)
    assert row.checksum_sha256 == hashlib.sha256(newest.read_bytes()).hexdigest()
    assert row.file_size_bytes == len(newest.read_bytes())
    latest = {r.dataset: r.path for r in snapshots.latest_snapshots(snapshots.scan_snapshots(spark, str(tmp_path))).collect()}
    assert latest["rental_bond_region"].endswith(newest.name) and len(latest) == 2


@pytest.mark.parametrize(
    "changes, text",
    [
        ({"raw_file": "x.csv"}, "raw_file"),
        ({"dataset": "suburb"}, "dataset"),
        ({"retrieved_at_utc": None}, "missing"),
        ({"retrieved_at_utc": "2026-08-01T00:00:00"}, "zoned"),
        ({"provisional": "yes"}, "boolean"),
        ({"sha256": "0"}, "checksum"),
    ],
)
def test_sidecar_problems(spark, tmp_path, changes, text):
    snapshot(tmp_path, "2026/07/01", "rental_bond_region_1", **changes)
    assert text in attached(spark, tmp_path).first().problem


def test_missing_sidecar(spark, tmp_path):
    snapshot(tmp_path, "2026/07/01", "rental_bond_region_1")
    write(tmp_path / "2026/07/02/rental_bond_region_2.csv", LINES)
    problems = {r.stem: r.problem for r in attached(spark, tmp_path).collect()}
    assert problems == {"rental_bond_region_1": None, "rental_bond_region_2": "metadata file is missing"}


def staged(spark, path, provisional=True, at=AT):
    return bond.map_bond_columns(
        bond.scan_bonds(spark, str(path)),
        dataset="region",
        source_snapshot=path.name,
        retrieved_at_utc=at,
        is_provisional=provisional,
    )


def test_lineage(spark, tmp_path):
    path = snapshot(tmp_path, "2026/07/01", "rental_bond_region_1")
    known = attached(spark, tmp_path)
    assert failed(staging.lineage_checks(staged(spark, path), known)) == {}
    assert set(failed(staging.lineage_checks(staged(spark, path, provisional=False), known))) == {"provisional_matches"}
    late = staged(spark, path, at="2026-09-01T00:00:00Z")
    assert set(failed(staging.lineage_checks(late, known))) == {"timestamp_matches"}
    lost = staged(spark, path).withColumn("source_snapshot", F.lit("gone.csv"))
    assert "raw_file_known" in failed(staging.lineage_checks(lost, known))


def test_staging_is_written_once_and_read_as_text(spark, tmp_path):
    path = snapshot(tmp_path / "raw", "2026/07/01", "rental_bond_region_1")
    rows = staged(spark, path)
    out = staging.write_staging(rows, str(tmp_path / "staging"), "2026-07-01", "rental_bond_region_1")
    assert out.endswith("2026/07/01/rental_bond_region_1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        staging.write_staging(rows, str(tmp_path / "staging"), "2026-07-01", "rental_bond_region_1")
    typed = bond.typed_bonds(staging.scan_staging(spark, out, bond.STAGING_COLUMNS, empty_is_null=False))
    got = {r.location_name: r for r in typed.collect()}
    assert got["NA"].location_id == -1 and got["North"].bonds_lodged == 10
    bad = staging.scan_staging(spark, out, bond.STAGING_COLUMNS, False).withColumn("bonds_lodged", F.lit("1.5"))
    raises_in_job(bond.typed_bonds(bad), "bonds_lodged")
    with pytest.raises(ContractError, match="no rows"):
        rows.limit(0).coalesce(1).write.option("header", True).csv(str(tmp_path / "empty"))
        staging.scan_staging(spark, str(tmp_path / "empty"), bond.STAGING_COLUMNS, False)


# ---- ledger and tables ------------------------------------------------------------------------------------

TABLE = "period_date date, geography_level string, location_id int, bonds_lodged bigint, source_snapshot_id bigint, retrieved_at timestamp"
ROWS = "period_date date, geography_level string, location_id int, bonds_lodged bigint"


def tables(spark, root):
    table = ledger.LoadedTable(spark, f"{root}/bonds", TABLE, ledger.BOND_KEY)
    book = ledger.LoadedTable(spark, f"{root}/ledger", ledger.LEDGER_SCHEMA, ledger.LEDGER_KEY)
    return table, book


def load(spark, pair, rows, seq, checksum):
    return ledger.load_snapshot(
        spark.createDataFrame(rows, ROWS),
        *pair,
        source_name="rental_bond_region",
        checksum=checksum,
        file_name=f"{checksum}.csv",
        retrieved_at=dt.datetime(2026, 8, 1),
        load_seq=seq,
    )


def test_later_load_wins_and_loading_twice_changes_nothing(spark, tmp_path):
    pair = tables(spark, tmp_path)
    july, june = dt.date(2026, 7, 1), dt.date(2026, 6, 1)
    assert load(spark, pair, [(june, "region", 1, 10), (july, "region", 1, 20)], 1, "a") == 2
    for _ in range(2):
        load(spark, pair, [(july, "region", 1, 99), (july, "region", 2, 5)], 2, "b")
    want = {(june, 1): 10, (july, 1): 99, (july, 2): 5}
    assert {(r.period_date, r.location_id): r.bonds_lodged for r in pair[0].read().collect()} == want
    book = {r.file_name: (r.status, r.row_count) for r in pair[1].read().collect()}
    assert book == {"a.csv": ("loaded", 2), "b.csv": ("loaded", 2)}
    folded = pair[0].compact(f"{tmp_path}/folded")
    assert {(r.period_date, r.location_id): r.bonds_lodged for r in folded.versions().collect()} == want
    with pytest.raises(ContractError):
        load(spark, pair, [], 3, "c")


def test_register_keeps_the_first_entry(spark):
    book = spark.createDataFrame([(7, "s", "x", "old.csv", 3, "loaded")], ledger.LEDGER_SCHEMA)
    new = spark.createDataFrame(
        [("s", "x", "new.csv", 9), ("s", "y", "b.csv", 1), ("s", "y", "a.csv", 1)],
        "source_name string, checksum_sha256 string, file_name string, row_count bigint",
    )
    got = {r.checksum_sha256: r for r in ledger.register_snapshots(book, new).collect()}
    assert len(got) == 2 and got["x"].snapshot_id == 7 and got["x"].file_name == "old.csv"
    assert got["y"].file_name == "a.csv" and got["y"].status == "validated" and got["y"].snapshot_id > 0
    marked = {r.checksum_sha256: r for r in ledger.mark_loaded(ledger.register_snapshots(book, new), 7, 4).collect()}
    assert (marked["x"].row_count, marked["y"].status) == (4, "validated")


def test_arriving_staging_is_loaded_once(spark, tmp_path):
    raw = snapshot(tmp_path / "raw", "2026/07/01", "rental_bond_region_1")
    table = ledger.LoadedTable(spark, str(tmp_path / "clean"), BOND_TABLE, ledger.BOND_KEY)

    def follow():
        follow_staging(
            spark, str(tmp_path / "staging"), bond.STAGING_COLUMNS, bond.typed_bonds, table, str(tmp_path / "marks")
        ).awaitTermination()

    first = staged(spark, raw).coalesce(1)
    staging.write_staging(first, str(tmp_path / "staging"), "2026-07-01", "one")
    follow()
    assert {r.location_id: r.bonds_lodged for r in table.read().collect()} == {2: 10, -1: 1}
    revised = first.where("location_id = '2'").withColumn("bonds_lodged", F.lit(77)).select(*first.columns)
    staging.write_staging(revised, str(tmp_path / "staging"), "2026-08-01", "two")
    follow()
    follow()
    assert {r.location_id: r.bonds_lodged for r in table.read().collect()} == {2: 77, -1: 1}
    assert table.versions().count() == 3


def test_stream_with_a_new_checkpoint_loses_nothing(spark, tmp_path):
    table = ledger.LoadedTable(spark, str(tmp_path / "bonds"), BOND_TABLE, ledger.BOND_KEY)
    raw = snapshot(tmp_path / "raw", "2026/07/01", "rental_bond_region_1")
    first = staged(spark, raw).coalesce(1)
    for run, location in (("one", "2"), ("two", "-1")):
        part = first.where(F.col("location_id") == location)
        staging.write_staging(part, str(tmp_path / run), "2026-07-01", run)
        follow_staging(
            spark, str(tmp_path / run), bond.STAGING_COLUMNS, bond.typed_bonds, table, str(tmp_path / f"marks-{run}")
        ).awaitTermination()
    assert {r.location_id: r.bonds_lodged for r in table.read().collect()} == {2: 10, -1: 1}
    assert {r.load_seq for r in table.versions().collect()} == {0, 1}


# ---- products ------------------------------------------------------------------------------------------------


def test_products_keep_their_contract(spark, tmp_path, make_panel):
    df = make_panel(series_rows([1.0, 2.0, 3.0]), series_rows([4.0], location=2))
    store.write_product(df, str(tmp_path), "monthly_panel")
    store.write_product(df, str(tmp_path), "monthly_panel")
    got = store.read_product(spark, str(tmp_path), "monthly_panel", ordered=True).collect()
    assert [r.value for r in got] == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ContractError):
        store.write_product(df.drop("value"), str(tmp_path), "monthly_panel")
    with pytest.raises(ContractError):
        store.read_product(spark, str(tmp_path), "surprise")


@pytest.mark.parametrize("model, policy, ok", [("ets_additive_damped", "fixed_ets_v1", True), ("seasonal_naive", "fixed_ets_v1", False), ("ets_additive_damped", "other", False)])
def test_production_gate(spark, model, policy, ok):
    df = spark.createDataFrame([(model, policy)], "model string, forecast_policy string")
    if ok:
        assert store.production_gate(df) is df
    else:
        with pytest.raises(ContractError):
            store.production_gate(df)


# ---- reconciliation --------------------------------------------------------------------------------------------


def sides(spark, market, rental):
    m = spark.createDataFrame(market, "region string, market_median_rent double, market_bonds_lodged bigint")
    r = spark.createDataFrame(rental, "region string, rental_median_rent double, rental_bonds_lodged bigint")
    return m, r


def test_reconciliation_statuses(spark):
    m, r = sides(spark, [("A", 500.0, 100), ("B", 520.0, 120), ("C", 521.0, 121), ("D", 1.0, 1)], [("A", 500.0, 100), ("B", 500.0, 100), ("C", 500.0, 100), ("D", 1.0, 0)])
    got = {x.region: x for x in reconcile.compare_sources(m, r).collect()}
    assert (got["A"].median_rent_status, got["A"].bonds_lodged_status) == ("PASS", "PASS")
    assert (got["B"].median_rent_status, got["B"].bonds_lodged_status) == ("PASS", "PASS")
    assert (got["C"].median_rent_status, got["C"].bonds_lodged_status) == ("WARN", "WARN")
    assert got["D"].bonds_lodged_difference_pct is None and got["D"].bonds_lodged_status == "WARN"
    assert reconcile.cross_source_verdict(m, r).first().overall_status == "WARN"


def test_missing_region_fails_the_verdict(spark):
    m, r = sides(spark, [("A", 500.0, 100), ("B", 500.0, 100)], [("A", 500.0, 100), ("C", 1.0, 1)])
    match = {x.region: x.match for x in reconcile.match_regions(m, r).collect()}
    assert match == {"A": "matched", "B": "missing_in_rental", "C": "missing_in_market"}
    row = reconcile.cross_source_verdict(m, r).first()
    assert row.overall_status == "FAIL" and (row.missing_in_market, row.missing_in_rental) == (1, 1)
    m, r = sides(spark, [("A", 500.0, 100)], [("A", 500.0, 100)])
    assert reconcile.cross_source_verdict(m, r).first().overall_status == "PASS"
