import pytest
from pyspark.sql import functions as F

from tradewind.functions.scalars import normalize_category, parse_utc, repair_zone
from tradewind.operators import cleaning as C
from tradewind.operators import joins as J
from tradewind.operators import verify as V
from tradewind.session import fresh_path
from tradewind.sources import readers as R
from tradewind.sources import sinks as K


def test_category_normalisation(spark):
    df = spark.createDataFrame([("None",), ("M1 None",), (" hat ",), ("",), (None,), ("hat_None",)], "v string")
    assert [r[0] for r in df.select(normalize_category(F.col("v"), "hat")).collect()] == ["hat_None", "M1 None", "hat", "hat_None", "hat_None", "hat_None"]


def test_time_parsing(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00.250 UTC",), ("nonsense",)], "v string")
    got = [r[0] for r in df.select(parse_utc(F.col("v"))).collect()]
    assert got[0].microsecond == 250_000 and got[1] is None
    fixed, broken = repair_zone(F.col("v"))
    rows = spark.createDataFrame([("2024-01-01T00:00:00+00:00Z",), ("2024-01-01T00:00:00+00:00",)], "v string").select(fixed, broken).collect()
    assert [tuple(r) for r in rows] == [("2024-01-01T00:00:00+00:00", True), ("2024-01-01T00:00:00+00:00", False)]


def test_exact_copies_and_ids_lose_both(spark):
    """An exact copy is excluded as an extra, its first copy as a repeated id; a hot copy group is fine."""
    rows = [(f"l{i}", "x", 1.0) for i in range(300)] + [("m1", "y", 1.0), ("m2", "y", 2.0), ("n1", "z", 1.0), ("o1", None, 1.0)]
    df = spark.createDataFrame(rows, "line string, id string, v double")
    flagged = C.attach_flags(df, "line", {"extra": C.exact_extra_lines(df, ["id", "v"], "line"), "shared": C.shared_key_lines(df, ["id"], "line")})
    ledger = C.waterfall(flagged, [("extra", F.col("extra")), ("bad_id", C.repeated_id("id", "shared", "extra"))])
    got = {r["first_exclusion"]: r["count"] for r in ledger.groupBy("first_exclusion").count().collect()}
    assert got == {"extra": 299, "bad_id": 4, "clean": 1}
    flow = {r["rule"]: (r["flagged"], r["excluded"], r["remaining_rows"], r["remaining_entities"]) for r in C.waterfall_flow(ledger, ["extra", "bad_id"], "id").collect()}
    assert flow == {"extra": (299, 299, 5, 3), "bad_id": (4, 4, 1, 1)}


def test_reverse_pairs(spark):
    h = 3_600_000_000
    rows = [(1, 0, "A", "B"), (2, 5 * h, "b", "a"), (3, 40 * h, "A", "B"), (4, 40 * h, "B", "A"), (5, 50 * h, "Q", "R"), (6, 51 * h, "A", "B")]
    df = spark.createDataFrame([(7, *r) for r in rows], "e bigint, id bigint, us bigint, buyer string, seller string")
    got = {r["id"]: r["reverse_pair"] for r in C.flag_reverse_pairs(df, "e", "us", ["id"], "buyer", "seller", 24 * h, shard=24 * h).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_csv_keeps_blanks_and_survives_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,note\n1,\n2,\"x, y\"\n".encode())
    assert [tuple(r) for r in R.read_text_csv(spark, str(tmp_path / "a.csv"), ["id", "note"]).collect()] == [("1", ""), ("2", "x, y")]


def test_json_lines_skip_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in R.read_json_lines(spark, str(tmp_path), "a bigint").collect()) == [1, 2]


def test_sinks(spark):
    df = spark.range(4).withColumn("split", F.when(F.col("id") < 3, "development").otherwise("test"))
    path = fresh_path(spark, "t")
    K.write_splits(df, path)
    assert spark.read.parquet(f"{path}/split=development").count() == 3
    assert K.refuses_overwrite(df, path) and not K.refuses_overwrite(df, fresh_path(spark, "t"))
    both = K.union_all([spark.range(1).select("id"), spark.range(1).withColumn("x", F.lit(1))])
    assert both.columns == ["id", "x"] and both.count() == 2


def test_lookup_refuses_missing_keys(spark):
    with pytest.raises(Exception, match="no entry for"):
        J.lookup(spark.range(3), spark.range(2).withColumn("v", F.lit(1)), ["id"]).collect()


def test_contract_and_require(spark):
    exp = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", None)], "k string, expected double")
    act = spark.createDataFrame([("a", 1.0 + 1e-12), ("b", 2.1), ("d", None)], "k string, actual double")
    got = {r["k"]: r["passed"] for r in V.contract(act, exp, ["k"], 1e-10).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True}
    checked = V.checks(("ok", spark.range(1), "id = 0"), ("bad", spark.range(1), "id = 1"))
    with pytest.raises(Exception, match="failed check: bad"):
        V.require(checked).collect()


def test_cell_diff_reports_missing_rows_once(spark):
    a = spark.createDataFrame([(1, "x", "y"), (2, "x", None)], "id bigint, p string, q string")
    b = spark.createDataFrame([(1, "x", "z"), (3, "x", "y")], "id bigint, p string, q string")
    got = sorted((r["id"], r["column"]) for r in C.cell_diff(a, b, "id", ["p", "q"]).collect())
    assert got == [(1, "q"), (2, "missing_right"), (3, "missing_left")]


def test_csv_goes_by_name(spark, tmp_path):
    (tmp_path / "b.csv").write_text('\ufeffb,a,extra\n1,"x\ny",z\n,q,\n')
    assert [tuple(r) for r in R.read_text_csv(spark, str(tmp_path / "b.csv"), ["a", "b"], multi_line=True).collect()] == [("x\ny", "1"), ("q", "")]
    with pytest.raises(ValueError, match="missing"):
        R.read_text_csv(spark, str(tmp_path / "b.csv"), ["a", "missing"])


def test_amount_rule_exempts_missing_prices_and_other_currencies(spark):
    from tradewind.plans.cleaning import rule_conditions

    nan = float("nan")
    rows = [(1, 10.0, 20.0, 2.0, "1", "c1", False), (2, 10.0, 21.0, 2.0, "1", "c1", True), (3, nan, 21.0, 2.0, "1", "c1", False), (4, None, 21.0, 2.0, "1", "c1", False),
            (5, 10.0, 21.0, 2.0, "1", "c9", False), (6, 10.0, None, 2.0, "1", "c1", True), (7, float("inf"), 1.0, 2.0, "1", "c1", True), (8, 10.0, 21.0, 2.0, None, "c1", False)]
    df = spark.createDataFrame(rows, "id int, price double, amount_raw double, qty double, symbol string, contract string, want boolean").withColumn("entity_text", F.lit("1"))
    got = df.select("id", "want", dict(rule_conditions())["amount_mismatch"].alias("flag")).collect()
    assert all(r["flag"] == r["want"] for r in got), got


def test_ledger_carries_flags_through_its_joins_not_addresses(spark):
    from tradewind.plans.cleaning import clean_ledger
    from tradewind.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = clean_ledger(t).select("line_no", "step", "base_clean")._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join LeftOuter")]
    wide = plan[plan.index("Join LeftOuter") :].split("\n")[1]
    assert "_address" not in top and "_bad_party" in wide
