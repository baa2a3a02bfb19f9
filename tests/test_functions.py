from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from civicspark.functions import text as fx


def values(spark, function, cells):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("c")).alias("x")).collect()]


def test_numbers(spark):
    cells = ["1 234,56", "1.234", "12,5", "1234.5", "12.5", "1234,5", "1,234", "-5", " 7 ", "", None, "abc", "1 234", "123.456"]
    assert values(spark, fx.decimal_value, cells) == [1234.56, 1234.0, 12.5, 1234.5, 12.5, None, 1.234, -5.0, 7.0, None, None, None, 1234.0, 123456.0]
    rules = values(spark, fx.decimal_rule, cells)
    assert rules[:8] == ["decimal-comma-to-point", "integer", "decimal-comma-to-point", "decimal-point", "decimal-point", None, "decimal-comma-to-point", "integer"]


def test_dates(spark):
    cells = ["2024-05-01", "2024-05-01T10:00:00Z", "1.5.2024", "32.13.2024", "5 май 2025", "05/11/1999", "5 foo 2025", "2024-5-1", None]
    assert values(spark, fx.date_value, cells) == ["2024-05-01", "2024-05-01", "2024-05-01", "2024-13-32", "2025-05-05", "1999-11-05", None, None, None]


def test_booleans(spark):
    assert values(spark, fx.boolean_value, ["Да", "не", "1", "0", "Y", "maybe", None]) == [True, False, True, False, True, None, None]


def test_javascript_numbers(spark):
    cells = ["0x10", "1e3", " 5 ", "5d", "NaN", "", ".5", "5.", "0b101", "Infinity"]
    assert values(spark, fx.number_value, cells) == [16.0, 1000.0, 5.0, None, None, None, 0.5, 5.0, 5.0, None]


def test_transliteration_and_names(spark):
    assert values(spark, fx.transliterate, ["Пореден №", "Щастие Юг", "жЖ"]) == ["Poreden №", "Shtastie Yug", "zhZh"]
    assert values(spark, fx.canonical_name, ["Пореден №", "2020 г.", "  A--B ", "a__b", "№"]) == ["poreden", "c_2020_g", "a_b", "a_b", "c_"]
    assert values(spark, fx.slug, ["Община Варна!", "--", "A" * 70]) == ["obshtina-varna", "", "a" * 64]


@pytest.mark.parametrize(
    ("head", "name", "declared", "type_", "expected"),
    [
        ("PK\x03", "a.csv", None, None, ("tabular", "magic")), ("  <a/>", None, None, None, ("xml", "magic")), ('{"type": "Feature"}', None, None, None, ("geojson", "magic")),
        ('{"a": 1}', None, None, None, ("json", "magic")), ("[1]", None, None, None, ("json", "magic")), ("a;b", "x.CSV", None, None, ("tabular", "extension")),
        ("a", "x", "XLSX", None, ("tabular", "declared-format")), ("a", None, None, "text/csv; charset=x", ("tabular", "declared-content-type")), ("a", None, None, "text/plain", ("text", "declared-content-type")),
        ("", None, None, None, ("text", "fallback")), ("a", ".csv", None, None, ("text", "fallback")),
    ],
)
def test_sniff(spark, head, name, declared, type_, expected):
    row = spark.createDataFrame([(head, name, declared, type_)], "h string, n string, d string, t string")
    assert tuple(row.select(fx.sniffed(*map(F.col, "hndt")).alias("s")).first().s) == expected


def test_roots_paths_and_cells(spark):
    assert values(spark, fx.root_element, ["<?xml v?><!-- <x> --><rows a='1'/>", "plain", None]) == ["rows", "unknown", None]
    assert values(spark, fx.safe_segment, ["abc", "..", "a/b"])[0] == "abc"
    assert len(values(spark, fx.safe_segment, ["a/b"])[0]) == 32
    assert values(spark, fx.csv_cell, ['a"b', "a,b", "plain", None]) == ['"a""b"', '"a,b"', "plain", ""]


def test_rounding_is_half_up(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (2.4,)], "x double")
    assert [r[0] for r in rows.select(fx.half_up(F.col("x"))).collect()] == [1, 2, 0, 2]
