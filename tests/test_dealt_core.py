"""Units, timestamps and snapshots: cases, edges, brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.operators import snapshots
from sightline.operators.snapshots import chained, peel, snapshot_changes
from sightline.operators.timestamps import to_utc
from sightline.operators.units import parse_quantity, states_amount, to_common_unit

RATES, FACTORS = {"SAR": 1.0, "USD": 3.75, "INR": 0.0437, "BHD": 9.947}, {"hour": 2496, "day": 312, "week": 52, "month": 12, "year": 1}


def test_quantities():
    parse = lambda t: parse_quantity(t, RATES, FACTORS)
    assert parse("sar 15000 - 17000 per month") == ("15000", "17000", "SAR", "month")
    assert parse("15.500,00 ~ 16.500,00sr pcm") == ("15500.00", "16500.00", "SAR", "month")
    assert parse("sr 9 ~ 11.5 k a year (48 h week)") == ("9000", "11500.0", "SAR", "year")
    assert parse("rupees 1.53 lakh-1.555 lakh p.a. plus 10% commission")[:2] == ("153000.00", "155500.000")
    assert parse("$1 000-1 300 pm, 30 days leave") == ("1000", "1300", "USD", "month")
    assert parse("2 up to 5 bahraini dinars/h") == ("2", "5", "BHD", "hour")
    for nothing in ("negotiable", "commission 10%", "depends on experience (3 years min)", "grade 12", "", None):
        assert parse(nothing)[:2] == (None, None)
    assert parse("1278 to 1279k inr")[:2] == ("1278000", "1279000")
    assert parse("pay " + "x" * 5000 + " 100 sar")[:3] == ("100", "100", "SAR")


@settings(max_examples=200, deadline=None)
@given(st.integers(100, 999999), st.sampled_from(["{:,}", "{}"]), st.sampled_from(["sar", "sr.", "$"]), st.sampled_from(["per month", "/yr", "a week"]))
def test_written_quantities_are_read_back(n, form, unit, period):
    low, high, root, per = parse_quantity(f"{unit} {form.format(n)} {period}", RATES, FACTORS)
    assert (float(low), float(high)) == (n, n) and root in RATES and per in FACTORS


def rates(spark):
    return spark.createDataFrame([("SAR", 1.0), ("USD", 3.75)], "currency string, sar_per_unit double"), spark.createDataFrame(list(FACTORS.items()), "salary_period string, periods_per_year int")


def test_common_unit_and_edges(spark):
    schema = "k string, t string, c string, p string, lo double, hi double, _q string, currency string"
    rows = [("a", "$45000 per year", "SAR", "month", None, None, "", ""), ("a", "$45000 per year", "SAR", "month", None, None, "", ""), ("b", None, "Riyal", "Monthly", 5700.0, float("nan"), None, None), ("c", "Negotiable", None, "month", 1.0, 2.0, None, None), ("d", None, None, None, None, None, None, None), ("e", "up to 500", "sar", "day", 9.0, 9.0, None, None)]
    args = (["k"], "t", "c", "p", "lo", "hi", *rates(spark))
    got = {tuple(r) for r in to_common_unit(spark.createDataFrame(rows, schema), *args).collect()}
    assert got == {("a", 14063, 14063), ("b", 5700, 5700), ("e", 13000, 13000)}
    assert to_common_unit(spark.createDataFrame([], schema), *args).count() == 0


def test_amounts_in_text(spark):
    df = spark.createDataFrame([("SAR ٥٠٠",), ("Commission 10%",), ("Grade 12",), ("Depends on experience (3 years min)",), (None,), ("16,500sar (48 h week)",)], "t string")
    assert [r[0] for r in df.select(states_amount(F.col("t"))).collect()] == [True, False, False, False, None, True]


def moments(spark, rows, **more):
    df = spark.createDataFrame(rows, "v string, board string, tz string, o string, _v string, reading string")
    return to_utc(df, "v", ["board"], "tz", "o", **more)


def test_moments(spark):
    ny = ("b", "America/New_York", "mdy", "kept", "lost")
    cases = {
        "2024-12-27T12:15:52.483+0300": "2024-12-27 09:15:52.483", "20250825T055756Z": "2025-08-25 05:57:56", "2024-08-17 23:59:09 GMT+3": "2024-08-17 20:59:09", "Aug 18, 2025 3:22 AM": "2025-08-18 07:22:00",
        "٢٠٢٤-٠٦-١١T١٩:٤٥:٢٦.٤٦٥+٠٥:٣٠": "2024-06-11 14:15:26.465", "12/02/2025 20:30": "2025-12-03 01:30:00", "/Date(1746927489397)/": "2025-05-11 01:38:09.397", "2024-11-03 01:30:00": "2024-11-03 05:30:00", "05-Mar-25": "2025-03-05 00:00:00",
        "5 مارس 2024 10:11": "2024-03-05 15:11:00", "2024-03-05 10:11:12 America/New_York": "2024-03-05 15:11:12", "1788523488": "2026-09-04 12:04:48", "2026-13-05": None, "2024-02-30T10:00:00Z": None, "0000-00-00": None, "yesterday": None, "": None, None: None, "9" * 20000: None,
    }
    out = moments(spark, [(v, *ny) for v in cases]).select("v", F.timestamp_micros("utc_us").cast("string"), "_v").collect()
    assert {r[0]: r[1] for r in out} == cases and {r[2] for r in out} == {"kept"}


def test_format_mixture_learns_an_undeclared_order(spark):
    rows = [(f"{d}/03/2024", "dmy board", None, None, "", "") for d in range(13, 29)] + [(f"03/{d}/2024", "mdy board", None, None, "", "") for d in range(13, 29)]
    rows += [("04/05/2024", b, None, None, "", "") for b in ("dmy board", "mdy board", "silent board", None)]
    out = {(r["board"]): (r["reading"], r["is_ambiguous"]) for r in moments(spark, rows).where("v = '04/05/2024'").collect()}
    assert out["dmy board"] == ("dmy", False) and out["mdy board"] == ("mdy", False) and out["silent board"][1] and out[None][1]
    assert moments(spark, []).count() == 0


def test_chained_hash_is_sparks(spark):
    row = spark.sql("select xxhash64(1L, 5L, -7L) as h").first()[0]
    h = chained(1, 5, -7)
    assert row == (h - (1 << 64) if h >> 63 else h)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**62), 2**62), max_size=12), st.sets(st.integers(-(2**62), 2**62), max_size=12))
def test_peeling_recovers_the_difference(new, old):
    third, cells = 32, {}
    for sign, side in ((1, new), (-1, old)):
        for k in side:
            place, x = chained(snapshots.PLACE, k, 0), chained(snapshots.CHECK, k, 0)
            x = x - (1 << 64) if x >> 63 else x
            for i in range(3):
                c = cells.setdefault(i * third + ((place >> 21 * i) & snapshots._SLICE) % third, [0, 0, 0, 0])
                c[0] += sign
                c[1] ^= k
                c[3] ^= x
    found, done = peel([(c, *w) for c, w in cells.items()], third)
    if done:
        assert {(s, k) for s, k, _ in found} == {(1, k) for k in new - old} | {(-1, k) for k in old - new}


def brute(rows, days):
    latest = {}
    for board, day, k, title, at in rows:
        if k is not None and (board, day, k) not in latest or k is not None and latest[board, day, k][0] < at:
            latest[board, day, k] = (at, "".join(ch for ch in (title or "").lower() if ch.isalnum()))
    out = set()
    for board in {b for b, _ in days}:
        mine = sorted(d for b, d in days if b == board)
        for p, c in zip(mine, mine[1:]):
            old = {k: v[1] for (b, d, k), v in latest.items() if (b, d) == (board, p)}
            new = {k: v[1] for (b, d, k), v in latest.items() if (b, d) == (board, c)}
            out |= {(board, k, c, "added") for k in new.keys() - old.keys()} | {(board, k, c, "removed") for k in old.keys() - new.keys()} | {(board, k, c, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


def test_snapshot_changes_match_brute_force(spark):
    random.seed(7)
    days = ["2026-01-01", "2026-01-02", "2026-01-03", "2026-01-05"]
    rows = [(b, d, f"k{i}", random.choice(["A b", "a  B", "c", "C!", None, ""]), random.randint(1, 9)) for b in ("x", "hot") for d in days for i in range(400 if b == "hot" else 6) if random.random() < 0.7]
    rows += [(b, d, k, "late", at + 100) for b, d, k, _, at in rows[:40]] + [("x", "2026-01-01", None, "t", 1), ("x", "2026-01-04", "k9", "failed pull", 1)]
    tries = [(b, d, True) for b in ("x", "hot") for d in days] + [("x", "2026-01-04", False), ("x", "2026-01-01", False), ("x", None, True), ("empty", "2026-01-01", True), ("hot", "2026-01-09", True)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "board string, day string, id string, title string, at int, k string, _d string")
    cal = spark.createDataFrame(tries, "board string, day string, ok boolean")
    args = (["board"], "id", ["title"], "day", "at", "day", "ok")
    got = {(r["board"], r["id"], str(r["snapshot_day"]), r["change_type"]) for r in snapshot_changes(df, cal, *args).collect()}
    assert got == brute(rows, {(b, d) for b, d, ok in tries if ok and d})
    assert snapshot_changes(df.limit(0), cal, *args).count() == 0
    # Tables far too small: buckets grow, then fall to the direct way, with the same result.
    elements = spark.createDataFrame([(1, 0, 0, s, k, s * k % 3) for s in (1, -1) for k in range(300)], "pair long, part int, bucket int, sign int, k long, v long")
    some = lambda only: elements if only is None else elements.join(only, ["pair", "part", "bucket"], "left_semi")
    found = {tuple(r) for r in snapshots.differences(some, ["part"], per_bucket_cells=3, grow=2, rounds=2).collect()}
    assert found == {(1, s, k, s * k % 3) for s in (1, -1) for k in range(300) if k % 3}
    # The same from rows: buckets that hold all, tables that must grow.
    hard = {(r["board"], r["id"], str(r["snapshot_day"]), r["change_type"]) for r in snapshot_changes(df, cal, *args, per_bucket=10_000, per_part=150).collect()}
    assert hard == got
