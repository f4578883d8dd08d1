"""Cell grammar, units, names, stamps and codecs against tables of printed forms."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from assayline.functions import codec, names, stamps, units, values


def _cell(c):
    return None if c is None else tuple(x for x in (c["kind"], c["value"], c["comparator"], c["text"]) if x is not None)


def test_six_digits_of_the_binary_value():
    import random
    from decimal import ROUND_HALF_UP, Context, Decimal

    import pandas as pd

    pick, rule = random.Random(2), Context(prec=6, rounding=ROUND_HALF_UP)
    numbers = [pick.uniform(-1, 1) * 10.0 ** pick.randint(-30, 30) for _ in range(3000)] + [pick.randint(1, 10**8) / 10 ** pick.randint(0, 9) for _ in range(3000)] + [1234565.0, 0.5, 999999.5, -2.5, 5e-324, 1e300, 1.0000005]
    assert units.round_sig.func(pd.Series(numbers)).tolist() == [float(rule.create_decimal(Decimal(v))) for v in numbers]


def test_numbers_of_all_digits(spark):
    numbers = {0.30000000000000004: "0.30000000000000004", 1.2345678901234568e-05: "0.000012345678901234568", 1e21: "1e+21", 1.5e22: "1.5e+22", 123456789012345680000.0: "123456789012345680000", 9.999e-7: "9.999e-7", -0.000001: "-0.000001", 1e6: "1000000", 1234567.125: "1234567.125", float("inf"): None}
    frame = spark.createDataFrame(list(enumerate(numbers)), "i int, x double").orderBy("i")
    assert [r[0] for r in frame.select(codec.js_number(F.col("x"))).collect()] == list(numbers.values())


def test_parse_cell(evaluate):
    cases = {
        "88": ("quantity", 88.0), "5.4": ("quantity", 5.4), ".5": ("quantity", 0.5), "<0.2": ("quantity", 0.2, "<"), "< OR = 90": ("quantity", 90.0, "<="), ">=40": ("quantity", 40.0, ">="),
        "=>3": ("quantity", 3.0, ">="), "≤ 3": ("quantity", 3.0, "<="), "1:40": ("titer", "1:40"), "1 : 080": ("titer", "1:80"), "NEGATIVE": ("qualitative", "Negative"), "none  seen": ("qualitative", "None seen"),
        "PATTERN A": ("qualitative", "Pattern A"), "ab": ("qualitative", "AB"), "2+": ("qualitative", "2+"), "-5": None, "1,234": None, "12a": None, "1.2.3": None, "": None, "<": None, "< x": None, "5+": None, "1e5": None, "NaN": None, "5d": None, None: None,
    }
    assert [_cell(c) for c in evaluate(values.parse_cell, list(cases))] == list(cases.values())


def test_parse_range(evaluate):
    cases = {
        "65-99": (65.0, 99.0), "65 – 99": (65.0, 99.0), "(65 to 99)": (65.0, 99.0), "< OR = 90": (None, 90.0), ">40": (40.0, None), "99-65": None, "negative": (None, None), "-5-3": None, "": None, "()": None, ".5-1": (0.5, 1.0),
    }
    found = evaluate(values.parse_range, list(cases))
    assert [None if r is None else (r["low"], r["high"]) for r in found] == list(cases.values())
    assert found[list(cases).index("negative")]["qualitative"] == "Negative"


def test_split_cells(evaluate):
    cases = {
        "105 H": ("105", None, "H"), "88 mg/dL": ("88", "mg/dL", None), "< 5 High": ("< 5", None, "High"), "not detected": ("not detected", None, None), "5.5 (L) % by wt": ("5.5", "% by wt", "(L)"),
        "see report": ("see report", None, None), "H": ("H", None, None), "": ("", None, None), "12 ↑ *": ("12", None, "↑ *"),
    }
    assert [(s["value"], s["unit"], s["flag"]) for s in evaluate(values.split_value_cell, list(cases))] == list(cases.values())
    ranges = {"65-99 mg/dL": (65.0, 99.0, "mg/dL"), "See Note: <100": (None, 100.0, None), "mg/dL (calc)": (None, None, "mg/dL (calc)"), "Negative": (None, None, None), "": (None, None, None)}
    assert [(s["low"], s["high"], s["unit"]) for s in evaluate(values.split_range_cell, list(ranges))] == list(ranges.values())


def test_titers_flags_words(evaluate):
    assert evaluate(values.parse_titer, ["1:40", "40", "0", "1:x", None]) == ["1:40", "1:40", None, None, None]
    assert evaluate(values.parse_flag, ["h", " LL ", "x"]) == ["H", "LL", None]
    assert evaluate(lambda c: values.qualitative_case(c, F.array(F.lit("O POS"), F.lit("Rh Neg"))), ["o pos", "rh neg", "RH(D) POSITIVE"]) == ["O POS", "Rh Neg", "Rh(D) positive"]
    assert evaluate(values.normalize_comparator, ["<OR=", "> or =", "=", "≥"]) == ["<=", ">=", None, ">="]


def test_units(evaluate):
    cases = {
        "mcg/dL": "ug/dL", "MG/DL": "mg/dL", "x10E3/uL": "10*3/uL", "10^6 /uL": "10*6/uL", "x 10(3)/uL": "10*3/uL", "M/uL": "10*6/uL", "m/uL": None, "K/UL": "10*3/uL", "mg/dL (calc)": "mg/dL", "mL/min/1.73 m2": "mL/min/{1.73_m2}",
        "µIU/mL": "u[IU]/mL", "mcIU/mL": "u[IU]/mL", "% by wt": "%", "(ratio)": "{ratio}", "PH": "[pH]", "furlong": None, "": None,
    }
    assert evaluate(units.printed_to_ucum, list(cases)) == list(cases.values())
    assert evaluate(lambda c: units.printed_to_ucum(c, compatible=True), ["mL/min/1.73m²", "Å"]) == ["mL/min/{1.73_m2}", "Ao"]
    assert evaluate(units.unit_label, ["10*3/uL", "ug/dL", "mg/(24.h)", "mg/g{creat}", "1"]) == ["×10³/µL", "µg/dL", "mg/24 hr", "mg/g creat", ""]


def test_resolve_and_round(spark, evaluate):
    conversions = F.create_map(F.lit("mg/L"), F.lit(0.1))
    found = evaluate(lambda c: units.resolve_unit(c, F.lit("mg/dL"), F.lit("quantity"), conversions), ["mg/dL", "mg/L", None, "", "U/L"])
    assert [(r["ok"], r["factor"], r["missing"], r["reason"]) for r in found] == [(True, 1.0, False, None), (True, 0.1, False, None), (True, 1.0, True, None), (True, 1.0, True, None), (False, None, False, "unit_mismatch")]
    unitless = evaluate(lambda c: units.resolve_unit(c, F.lit("{ratio}"), F.lit("quantity"), conversions), [None])
    assert not unitless[0]["missing"]
    numbers = [1.746065, 0.0, 1234567.0, 0.00012345678, None, float("inf")]
    rounded = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(units.round_sig("x")).collect()]
    assert rounded == [1.74606, 0.0, 1234570.0, 0.000123457, None, float("inf")]


def test_names(evaluate):
    assert evaluate(names.normalize_name, ["  Foo ,  BAR / b ", "A B"]) == ["foo,bar/b", "a b"]
    assert evaluate(lambda c: names.normalize_name(c, compatible=True), ["ﬁbrin"]) == ["fibrin"]
    assert evaluate(names.clean_name, ["LDL (calc)", "Iron *†", "A  B"]) == ["LDL", "Iron", "A B"]
    assert evaluate(names.fuzzy_key, ["A-1c %!"]) == ["a1c%"]
    assert evaluate(names.panel_key, ["URINALYSIS", "24-hour urine", "UA", "LIPID", None]) == ["urinalysis", "24h urine", "urinalysis", None, None]
    assert evaluate(names.title_case, ["o'NEIL-smith  jr"]) == ["O'Neil-Smith  Jr"]


def test_name_patterns_stay_linear(evaluate):
    import time

    began = time.time()
    evaluate(names.normalize_name, ["a" + "  " * 50_000 + "b" + " " * 50_000])
    evaluate(values.split_range_cell, ["9" * 50_000])
    assert time.time() - began < 20


def test_stamps(evaluate):
    def parse(c):
        return stamps.parse_stamp(c, F.lit("America/New_York"))

    cases = {
        "Collected: 04/17/2026 01:40 PM": (datetime.datetime(2026, 4, 17, 17, 40), True), "Collected: 09/29/2020 / 11:00 EDT": (datetime.datetime(2020, 9, 29, 15, 0), True), "Collection Date/Time: 2026-04-17 08:05 UTC": (datetime.datetime(2026, 4, 17, 8, 5), True),
        "Date collected Apr 17, 2026": (datetime.datetime(2026, 4, 17, 4, 0), False), "Drawn 4/7/26 at 0830 PST": (datetime.datetime(2026, 4, 7, 16, 30), True), "Collected 12:30 AM": None, "Collected: 04/31/2026": None, "Collected: 13/01/2026": None, "Collected: 04/17/2026 25:00": None,
        "Specimen collected on 01/02/2020 12:05 AM ET": (datetime.datetime(2020, 1, 2, 5, 5), True), "no date": None,
    }
    assert [None if s is None else (s["at"], s["time_found"]) for s in evaluate(parse, list(cases))] == list(cases.values())
    utc = evaluate(lambda c: stamps.parse_stamp(c, F.lit("America/New_York"), unzoned_is_utc=True), ["Collected: 04/17/2026 01:40 PM", "Collected: 04/17/2026"])
    assert [s["at"].hour for s in utc] == [13, 4]


def test_birth_dates(evaluate):
    assert evaluate(lambda c: stamps.parse_birth_date(c, 2026), ["1/2/1990", "1990-01-02", "Jan 2, 1990", "01/11/90", "01/11/20", "x"]) == ["1990-01-02", "1990-01-02", "1990-01-02", "1990-01-11", "2020-01-11", None]


def test_codec(spark, evaluate):
    numbers = [88.0, 123457000.0, 5.4, 1e-7, 0.000123457, 0.0, -2.5, None]
    assert [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(codec.js_number(F.col("x"))).collect()] == ["88", "123457000", "5.4", "1e-7", "0.000123457", "0", "-2.5", None]
    texts = ["", "a", "ab?", "eyJ6aXAiOiJERUYi.~"]
    assert evaluate(lambda c: F.decode(codec.from_base64url(codec.base64url(F.encode(c, "UTF-8"))), "UTF-8"), texts) == texts
    assert evaluate(codec.from_base64url, ["a+b"]) == [None]
    assert evaluate(lambda c: codec.from_numeric_mode(codec.numeric_mode(c)), texts[:3][1:2] + ["shc-._~9"]) == ["a", "shc-._~9"]
    assert evaluate(codec.numeric_mode, ["-.9"]) == ["000112"]
    assert evaluate(lambda c: codec.inflate_raw(codec.deflate_raw(c)), ["x" * 1000, ""]) == ["x" * 1000, ""]
