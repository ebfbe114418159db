"""Shaping operators."""
import datetime
from decimal import Decimal

import pytest

from ecotally.operators.report_schema import bi_type, report_columns
from ecotally.operators.shape import (
    apply_mapping,
    cast_date,
    extract_choice,
    flatten_struct,
    geo_roles,
    residual_mappings,
    residual_to_string,
    tag_geo,
)
from ecotally.plans.batch import ACTIVITY_MAPPING, ENTITY_MAPPING, shape_activity

DOC_SCHEMA = (
    "tenantId string, activityid string, versionid int, "
    "data struct<tenantId: string, emissionInKgCO2: struct<double: double, long: bigint>, "
    "date: string, Extra: double>"
)


def docs(spark):
    return spark.createDataFrame(
        [
            ("root-t", "a1", 3, ("nested-t", (1.5, None), "2024/01/02", 0.25)),
            ("root-t", "a2", 4, ("nested-t", (None, 7), "2024/01/03", None)),
        ],
        DOC_SCHEMA,
    )


def test_flatten_replaces_case_insensitive_root_in_place(spark):
    flat = flatten_struct(docs(spark))
    assert flat.columns == ["tenantid", "activityid", "versionid", "emissioninkgco2", "date", "extra"]
    assert {r["tenantid"] for r in flat.collect()} == {"nested-t"}


def test_flatten_without_root_is_identity(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert flatten_struct(df).columns == ["x"]


def test_choice_strict_loses_other_arm(spark):
    flat = extract_choice(flatten_struct(docs(spark)), "emissionInKgCO2")
    vals = sorted((r["activityid"], r["emissioninkgco2"]) for r in flat.collect())
    assert vals == [("a1", 1.5), ("a2", None)]


def test_choice_lenient_falls_back(spark):
    flat = extract_choice(flatten_struct(docs(spark)), "emissionInKgCO2", strict=False)
    vals = sorted((r["activityid"], r["emissioninkgco2"]) for r in flat.collect())
    assert vals == [("a1", 1.5), ("a2", 7.0)]


def test_choice_on_plain_double(spark):
    df = spark.createDataFrame([(2.5,)], "emissionInKgCO2 double")
    assert extract_choice(df, "emissioninkgco2").first()[0] == 2.5


def test_static_and_residual_mapping(spark):
    flat = extract_choice(flatten_struct(docs(spark)), "emissionInKgCO2")
    res = residual_mappings(flat, [m[0] for m in ACTIVITY_MAPPING])
    assert [m[0] for m in res] == ["date", "extra"]
    out = apply_mapping(flat, ACTIVITY_MAPPING + res)
    # sources absent from the schema are skipped; residual columns are strings
    assert out.columns == ["activityid", "emissioninkgco2", "tenantid", "versionid", "date", "extra"]
    types = dict(out.dtypes)
    assert types["emissioninkgco2"] == "decimal(20,10)" and types["extra"] == "string"
    row = sorted(out.collect(), key=lambda r: r["activityid"])[0]
    assert row["emissioninkgco2"] == Decimal("1.5") and row["extra"] == "0.25"
    assert residual_to_string(flat, [m[0] for m in ACTIVITY_MAPPING]).columns == ["date", "extra"]


def test_mapping_strict_raises_on_missing(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        apply_mapping(df, [("y", "int", "y", "int")], strict=True)


def test_bare_decimal_keeps_fraction(spark):
    df = spark.createDataFrame([(0.5, "e", "t")], "parentcontributionpercentage double, entityid string, tenantid string")
    out = apply_mapping(df, ENTITY_MAPPING)
    assert dict(out.dtypes)["parentcontributionpercentage"] == "decimal(10,2)"
    assert out.first()["parentcontributionpercentage"] == Decimal("0.50")


def test_nested_mapping_paths(spark):
    df = spark.createDataFrame(
        [("k", "e1", "t1", ("FR", "Idf", "equity"))],
        "tenantentitykey string, entityid string, tenantid string, "
        "data struct<country: string, province: string, consolidateApproach: string>",
    )
    out = apply_mapping(df, ENTITY_MAPPING)
    r = out.first()
    assert (r["entity_id"], r["tenant_id"], r["country"], r["province"], r["consolidateapproach"]) == (
        "e1", "t1", "FR", "Idf", "equity")


def test_ansi_cast_overflow_raises_unless_lenient(spark):
    df = spark.createDataFrame([(1e12,)], "emissioninkgco2 double")
    m = [("emissioninkgco2", "double", "emissioninkgco2", "decimal(20,10)")]
    with pytest.raises(Exception):
        apply_mapping(df, m).collect()
    assert apply_mapping(df, m, lenient=True).first()[0] is None


def test_cast_date_three_y_pattern(spark):
    df = spark.createDataFrame([("2024/01/02",), ("bad",), (None,)], "date string")
    out = cast_date(df, "date", "yyy/MM/dd").collect()
    assert out[0]["date"] == datetime.datetime(2024, 1, 2)
    assert out[1]["date"] is None and out[2]["date"] is None


def test_geo_tags(spark):
    df = spark.createDataFrame([("FR", "Idf", 1)], "country string, province string, x int")
    assert geo_roles(tag_geo(df)) == {"country": "COUNTRY", "province": "STATE"}


def test_report_schema_types(spark):
    assert [bi_type(t) for t in ["varchar", "bigint", "decimal(20,10)", "string", "int"]] == [
        "VARCHAR", "INTEGER", "DECIMAL", "STRING", "INT"]
    df = spark.createDataFrame([("a", 1, Decimal("1"))], "column1 string, column2 bigint, x decimal(20,10)")
    assert report_columns(df) == [
        ("column1", "STRING"), ("column2", "INTEGER"), ("x", "DECIMAL"),
        ("total_emissions_marketbased", "DECIMAL"), ("total_emissions_locationbased", "DECIMAL")]


def test_shape_activity_end_to_end(spark):
    out = shape_activity(docs(spark))
    assert out.columns[:9] == [m[2] for m in ACTIVITY_MAPPING]  # absent ones as NULLs
    assert out.first()["formid"] is None and out.first()["tenantid"] == "nested-t"


def test_exact_decimal_sum_equals_decimal_sum(spark):
    from pyspark.sql import functions as F

    from ecotally.functions.expressions import exact_decimal_sum

    vals = [(k % 3, v) for k, v in enumerate([0.005, 1.015, 2.675, -3.125, 1e6 + 0.125, 0.1, 0.2, None])]
    df = spark.createDataFrame(vals, "k int, x double")
    a = df.groupBy("k").agg(F.sum(F.col("x").cast("decimal(18,2)")).alias("s"))
    b = df.groupBy("k").agg(exact_decimal_sum("x").alias("s"))
    assert a.schema == b.schema
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_flatten_nested_fields_that_differ_in_case_only(spark):
    df = spark.createDataFrame([((1, "x", 2),)], "data struct<a: int, b: string, A: int>")
    flat = flatten_struct(df)
    assert flat.columns == ["a", "b"]
    assert tuple(flat.first()) == (2, "x")  # the later one wins


def test_mapping_fill_gives_typed_nulls(spark):
    df = spark.createDataFrame([(1,)], "x int")
    out = apply_mapping(df, [("x", "int", "x", "int"), ("gone", "double", "y", "decimal(20,10)")], fill=True)
    assert out.dtypes == [("x", "int"), ("y", "decimal(20,10)")] and out.first()["y"] is None
