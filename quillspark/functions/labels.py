"""Codes as words, for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import GROUPS, MISSING

#: Own wording.
LABELS = {
    "type_acs": {"STEMI": "ОКС с подъёмом ST", "NSTEMI": "ОКС без подъёма ST", "NA": "нестабильная стенокардия"},
    "mi_localisation": {"A": "передняя", "I": "нижняя", "L": "боковая", "N": "не уточнена"},
    "ca_fact": {"Y": "выполнена", "R": "отказ", "N": "не выполнена"},
    "ca_lad": {"0": "менее 50 %", "1": "50-89 %", "2": "90 % и более"},
    "rca": {"0": "менее 50 %", "1": "50-89 %", "2": "90 % и более"},
} | {f: {"0": "нет", "1": "да"} for f in "art_hyper atr_fibril copd dm tlt ecg_avb ecg_elevation".split()}


def decoded(rows: DataFrame, labels=None) -> DataFrame:
    """(…, label): rows (field, value) with the words of their code; other values stay as they are."""
    table = [(f, v, x) for f, by in (labels or LABELS).items() for v, x in by.items()]
    words = rows.sparkSession.createDataFrame(table, "field string, value string, label string")
    return rows.join(F.broadcast(words), ["field", "value"], "left").withColumn("label", F.coalesce("label", "value"))


def short_label(description: Column) -> Column:
    """Up to the first colon or comma."""
    return F.trim(F.split(description, "[:,]")[0])


#: Own wording: what a field holds; its label is the part up to the first colon or comma.
DESCRIPTIONS = {
    "admission_date": "Поступление, день.месяц.год", "discharge_date": "Выписка, день.месяц.год",
    "art_hyper": "Гипертония: есть или нет", "atr_fibril": "Мерцательная аритмия: есть или нет", "ckd": "Болезнь почек, стадия словами", "copd": "Обструктивная болезнь лёгких: есть или нет",
    "diagnosis_icd": "Код диагноза по МКБ", "dm": "Диабет: есть или нет", "hf": "Недостаточность сердца, стадия и класс", "killip": "Класс по Киллипу, от 1 до 4",
    "mi_localisation": "Место инфаркта: стенка", "tlt": "Тромболизис: был или нет", "type_acs": "Вид коронарного синдрома: по сегменту ST",
    "bmi": "Индекс массы, кг/м2", "bp": "Давление, мм рт. ст.", "bpm": "Пульс, ударов в минуту", "height": "Рост, см", "rr": "Дыхание, вдохов в минуту", "smoking": "Курение: сейчас, раньше или никогда", "spo2": "Кислород крови, %", "weight": "Масса, кг",
    "ecg_avb": "Блокада АВ: есть или нет", "ecg_bpm": "Частота на ЭКГ, ударов в минуту", "ecg_elevation": "Подъём ST: есть или нет", "ecg_rythm": "Ритм на ЭКГ",
    "echo_ef": "Выброс левого желудочка, %", "echo_lvd": "Размер в диастолу, мм", "echo_lvd_2": "Размер в систолу, мм", "echo_mr": "Возврат через митральный клапан, степень", "echo_zone": "Зоны сниженной подвижности",
    "rg_date": "Снимок груди, день.месяц.год", "rg_pc": "Картина лёгких на снимке",
    "ca_date": "Ангиография, день.месяц.год", "ca_fact": "Ангиография проведена: да, отказ или нет", "ca_lad": "Передняя нисходящая, сужение", "rca": "Правая коронарная, сужение",
    "card_trop": "Тропонин: число или знак", "crea": "Креатинин, мкмоль/л", "glu": "Сахар крови, ммоль/л", "hb": "Гемоглобин, г/л", "ldl": "Холестерин низкой плотности, ммоль/л", "leucocytes": "Белые клетки, 10^9/л", "thrombocytes": "Пластинки, 10^9/л", "tot_chol": "Холестерин в целом, ммоль/л",
    "2_aag": "Второй антиагрегант: назван или нет", "ace_ing_sartan": "Ингибитор АПФ или сартан: назван или нет", "anticoagulant": "Антикоагулянт: назван или нет", "aspirin": "Аспирин: назван или нет", "bb": "Бета-блокатор: назван или нет", "statin": "Статин: назван или нет",
}


def history(values: DataFrame, groups=None, descriptions=None, labels=None) -> DataFrame:
    """(doc_id, section, place, title, path, label, description, raw_value, value) of rows (doc_id, field,
    value): a record as it is shown, in the order of `groups` {section: "field field ..."}.  A field
    without a description is described by its name; null and the missing value, in any case, are
    shown as missing.  Fields of no group have no row."""
    groups, descriptions = groups or GROUPS, descriptions or DESCRIPTIONS
    table = [(s, k, g[:1].upper() + g[1:], f, f"{g}.{f}", descriptions.get(f, f)) for s, (g, names) in enumerate(groups.items()) for k, f in enumerate(names.split())]
    fields = values.sparkSession.createDataFrame(table, "section int, place int, title string, field string, path string, description string")
    rows = decoded(values, labels).join(F.broadcast(fields), "field")
    unknown = F.col("value").isNull() | (F.lower("value") == MISSING)
    classed = (F.col("field") == "killip") & F.col("value").rlike("^[0-9]+$")
    shown = F.when(unknown, MISSING).when(classed, F.concat("value", F.lit(" класс"))).otherwise(F.col("label"))
    return rows.select("doc_id", "section", "place", "title", "path", short_label(F.col("description")).alias("label"), "description", F.col("value").alias("raw_value"), shown.alias("value"))


def history_json(values: DataFrame, **options) -> DataFrame:
    """(doc_id, json): the sections of a record with their fields, in order; a record has at most as
    many rows as the groups have fields."""
    item = F.struct("place", F.struct("path", "label", "description", "raw_value", "value").alias("field"))
    parts = history(values, **options).groupBy("doc_id", "section", "title").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.field).alias("fields"))
    section = F.struct("section", F.struct("title", "fields").alias("body"))
    return parts.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(section)), lambda x: x.body)).alias("json"))
