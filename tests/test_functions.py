import pytest
from pyspark.sql import functions as F

from quillspark.functions import labels
from quillspark.functions import normalize as N
from quillspark.functions.catalog import FIELDS, GROUPS, MISSING


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (N.norm_date, "с 1.2.24 по", "01.02.2024"),
        (N.norm_date, "31.02.2024", MISSING),
        (N.norm_date, "нет даты", MISSING),
        (N.norm_num, "креатинин 99,5 мкмоль", "99.5"),
        (N.norm_num, "x", MISSING),
        (N.norm_bp, "АД 120 \\ 80 мм", "120/80"),
        (N.norm_trop, "Положительный", "положительный"),
        (N.norm_trop, "-", "отрицательный"),
        (N.norm_trop, "0,5 нг", "0.5"),
        (N.stenosis_code, "стеноз 49%", "0"),
        (N.stenosis_code, "стеноз 50%", "1"),
        (N.stenosis_code, "стеноз 95%", "2"),
        (N.stenosis_code, "Окклюзия", "2"),
        (N.stenosis_code, "значимого стеноза нет", "0"),
        (N.loc_code, "Передней стенки", "A"),
        (N.loc_code, "нижней", "I"),
        (N.loc_code, "иное", "N"),
        (N.acs_code, "Нестабильная стенокардия", "NA"),
        (N.acs_code, "без подъёма ST", "NSTEMI"),
        (N.acs_code, "с подъемом ST", "STEMI"),
        (N.norm_rhythm, "Ритм синусовый", "синусовый"),
        (N.norm_smoking, "бросила курить", "Бросила курить"),
        (N.norm_smoking, "Не курит.", "Не курит"),
        (N.norm_ckd, "ХБП 3A", "ХБП 3А"),
        (N.roman, "iii", "3"),
        (N.roman, "2", "2"),
    ],
)
def test_normalizers(spark, f, text, want):
    assert one(spark, f, text) == want
    if want != MISSING and f in (N.norm_date, N.norm_num, N.norm_bp, N.roman, N.norm_smoking):
        assert one(spark, f, want) == want  # idempotent


def test_field_dispatch_and_format(spark):
    rows = [("bp", "120/80", True), ("bp", "80/120", False), ("hb", "120", True), ("hb", "5", False), ("hb", "abc", False), ("killip", "5", False), ("admission_date", "31.02.2024", False), ("diagnosis_icd", "I21.0", True), ("dm", "2", False), ("hf", MISSING, True)]
    df = spark.createDataFrame(rows, "f string, v string, want boolean")
    assert df.where(N.format_valid("f", "v") != F.col("want")).count() == 0
    rows = [("killip", "II", "2"), ("type_acs", "stemi", "STEMI"), ("type_acs", "na", "NA"), ("hb", "na", MISSING), ("dm", "не выявлен", "0"), ("dm", "да", "1"), ("ecg_avb", "АВ-блокада 1 ст", "1"), ("ca_fact", "отказ", "R"), ("hf", None, MISSING)]
    df = spark.createDataFrame(rows, "f string, v string, want string").withColumn("got", N.normalize_field_value("f", "v"))
    assert [tuple(r) for r in df.where("NOT (got <=> want)").collect()] == []


def test_evidence(spark):
    text = "😀 Гемоглобин 120,5 г/л."
    rows = [("120.5", "Гемоглобин 120,5", 2, 18, True), ("121", "Гемоглобин 120,5", 2, 18, False), ("1", "Гемоглобин 120,5", 2, 18, True), ("120.5", "Гемоглобин 120,5", 3, 19, False), (MISSING, "", -1, -1, True)]
    df = spark.createDataFrame([(*r, text) for r in rows], "v string, e string, s int, t int, want boolean, text string")
    got = df.select("want", N.value_supported("v", "e", "e", N.placed_in("e", "s", "t", "text")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_contract():
    assert len(FIELDS) == 50 and len(set(FIELDS)) == 50 and len(GROUPS) == 9


def test_small_helpers(spark):
    assert one(spark, N.slug, " a b/c! ") == "a_b_c"
    assert one(spark, N.json_object, 'x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert one(spark, N.json_object, "nothing") is None
    assert one(spark, lambda s: labels.short_label(s), "Дата: x") == "Дата"
    df = spark.createDataFrame([("ca_fact", "Y"), ("hb", "120")], "field string, value string")
    assert {r.label for r in labels.decoded(df).collect()} == {"выполнена", "120"}
