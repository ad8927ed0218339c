"""Queries over records written from the driver's tables, so that SQL knows every answer.

Discharge letters are made from `orders`: each number, date and phrase of a letter comes from
a row's keys.  Small tables of phrases and their expected values are dealt over `events`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.catalog import FIELDS, GENERIC_PATTERNS, MISSING
from ..functions.labels import short_label
from ..operators import anonymize, arbitrate, evaluate, extract, routing, similarity
from ..operators.spread import over_cores
from . import pipeline
from .registry import _BASE, _DECIDED, _QUERIES, _SQL, documents, line_candidates, query, table

# --- the generic pack over documents ---------------------------------------------------------

#: Matches with the character before and after them, which RE2 needs as it cannot look around.
_PACK = r"""t AS (SELECT doc_id, text, chr(10) || text || chr(10) AS t FROM documents),
m AS (
  SELECT doc_id, 'email' AS field, 0 AS ord, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}') AS value, strpos(text, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) - 1 AS start, text FROM t
  UNION ALL SELECT doc_id, 'ipv4', 1, regexp_extract(t, '[^0-9.]((?:[0-9]{1,3}\.){3}[0-9]{1,3})[^0-9.]', 1), strpos(t, regexp_extract(t, '[^0-9.]((?:[0-9]{1,3}\.){3}[0-9]{1,3})[^0-9.]')) - 1, text FROM t
  UNION ALL SELECT doc_id, 'long_number', 2, regexp_extract(t, '[^0-9]([0-9]{16})[^0-9]', 1), strpos(t, regexp_extract(t, '[^0-9]([0-9]{16})[^0-9]')) - 1, text FROM t
  UNION ALL SELECT doc_id, 'license', 3, regexp_extract(text, '(?m)^[^\n]*\b(?i:license|cc by)[^\n]*'), strpos(text, regexp_extract(text, '(?m)^[^\n]*\b(?i:license|cc by)[^\n]*')) - 1, text FROM t
  UNION ALL SELECT doc_id, 'year', 4, regexp_extract(t, '[^0-9]((?:19|20)[0-9]{2})[^0-9]', 1), strpos(t, regexp_extract(t, '[^0-9]((?:19|20)[0-9]{2})[^0-9]')) - 1, text FROM t),
found AS (SELECT * FROM m WHERE value <> '')"""


@query(f"""WITH {_PACK} SELECT doc_id, field, ord::INT AS ord, value, start::INT AS start, (start + length(value))::INT AS "end",
  trim(list_last(string_split(substring(text, 1, start), chr(10))) || value || list_first(string_split(substring(text, start + length(value) + 1), chr(10))), ' ') AS sentence FROM found""")
def pack_spans(spark, sf_dir):
    return extract.pack_candidates(documents(spark, sf_dir)).select("doc_id", "field", "ord", "value", "start", "end", "sentence")


_SQL["document_file_scores"] = f"""WITH {_PACK}, n AS (SELECT d.doc_id, count(f.field) AS n FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id),
s AS (SELECT *, n / {len(GENERIC_PATTERNS)} AS coverage, CASE WHEN n = 0 THEN 0.0 ELSE round(0.9 * (0.78 + 0.22 * (n / {len(GENERIC_PATTERNS)})), 4) END AS score FROM n)
SELECT doc_id, n AS extracted_fields, n AS direct_fields, 0::BIGINT AS conflicts, round(coverage, 4) AS coverage, score::DOUBLE AS file_score,
  CASE WHEN score >= 0.84 THEN 'good' WHEN score >= 0.70 THEN 'suspicious' ELSE 'bad' END AS file_label FROM s"""

# --- discharge letters -----------------------------------------------------------------------

#: Numbers of a letter, read alike by both engines: k is the order's key, c the customer's.
_NUMBERS = {
    "sys": "110 + k % 70", "dia": "60 + c % 40", "hr": "60 + k % 50", "rr": "14 + c % 8", "height": "150 + k % 45", "kg": "50 + c % 60", "tenth": "k % 10", "other": "c % 10",
    "spo2": "90 + k % 10", "ecg": "55 + c % 50", "ef": "35 + k % 30", "lvd": "45 + c % 20", "lvs": "30 + k % 15", "crea": "60 + k % 200", "glu": "4 + c % 9", "hb": "90 + c % 70",
    "leu": "4 + k % 10", "thr": "150 + k % 200", "chol": "3 + c % 5", "ldl": "1 + k % 4", "a": "k % 100", "b": "c % 100", "e": "(k + c) % 100", "icd": "k % 5",
    "wall": "k % 3", "st": "c % 2", "kil": "k % 4", "ah": "k % 3", "dm": "c % 3", "ckd": "k % 4", "smk": "c % 4", "af": "k % 5", "elev": "k % 2", "cag": "k % 4", "trop": "c % 3", "tlt": "c % 3", "stat": "k % 3",
}
_PHRASES = {
    "wall": ("передней", "нижней", "боковой"),
    "st": ("с подъёмом", "без подъёма"),
    "kil": ("I", "II", "III", "IV"),
    "ah": (" Гипертоническая болезнь III стадии.", "", ""),
    "dm": (" Сахарный диабет 2 типа.", " Сахарный диабет отрицает.", ""),
    "ckd": ("", " ХБП 3А.", "", ""),
    "smk": ("бросил курить", "не курит", "курит", "бывший курильщик"),
    "af": ("фибрилляция предсердий", *["ритм синусовый"] * 4),
    "elev": ("элевация ST", "без элевации ST"),
    "trop": ("положительный", "отрицательный", "0,15"),
    "tlt": ("проведён тромболизис альтеплазой", "ТЛТ не проводилась", "консервативное"),
    "stat": ("аторвастатин", "розувастатин", "симвастатин"),
    "cag": ("отказ от коронарографии.", "коронарография не выполнялась.", "{done}", "{done}"),
}
_DONE = "выполнена коронарография {day1}. ПМЖВ стеноз {a}%, далее стеноз {b}%; ПКА стеноз {e}%."
_LETTER = """Выписной эпикриз пациента, дата поступления: {day0}, выписан {day2}.
Диагноз: основной: I21.{icd} Острый инфаркт миокарда {wall} стенки {st} ST, Killip {kil}.{ah}{dm}{ckd}
Анамнез: {smk}.
Объективный статус: АД {sys}/{dia} мм рт.ст., ЧСС {hr}, ЧД {rr}, рост {height} см, вес {kg},{tenth} кг, SpO2 {spo2}%.
ЭКГ: {af}, ЧСС {ecg}, {elev}.
ЭхоКГ: ФВ {ef}%, КДР {lvd} мм, КСР {lvs} мм.
Коронарография: {cag}
Анализы: креатинин {crea} мкмоль/л, глюкоза {glu},{tenth} ммоль/л, гемоглобин {hb} г/л, лейкоциты {leu},{other}, тромбоциты {thr}, холестерин {chol},{tenth}, ЛПНП {ldl},{other}, тропонин {trop}.
Лечение: {tlt}. Аспирин 100 мг, клопидогрел 300 мг.
Рекомендации при выписке: аспирин 75 мг вечером; клопидогрел 75 мг утром; бисопролол 5 мг; {stat} {ef} мг на ночь.
"""


def _filled(template: str, parts: dict):
    """A column of the template with its names replaced by columns."""
    out = []
    for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
        out.append(parts[piece[1:-1]] if piece.startswith("{") else F.lit(piece))
    return F.concat(*[x for x in out])


def letters(spark, sf_dir):
    """(doc_id, text): a letter an order."""
    o = over_cores(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("d")), "k")
    parts = {n: F.expr(f"string({e})") for n, e in _NUMBERS.items()}
    days = {"day0": F.col("d"), "day1": F.date_add("d", 1), "day2": F.date_add(F.col("d"), F.expr("int(1 + c % 9)"))}
    parts |= {n: F.date_format(x, "dd.MM.yyyy") for n, x in days.items()}
    parts["done"] = _filled(_DONE, parts)
    for name, phrases in _PHRASES.items():
        parts[name] = F.element_at(F.array(*[_filled(p, parts) if "{" in p else F.lit(p) for p in phrases]), F.expr(f"int(1 + {_NUMBERS[name]})"))
    return o.select(F.col("k").alias("doc_id"), _filled(_LETTER, parts).alias("text"))


def _of(name: str, *values: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][1 + ({_NUMBERS[name]})]"


def _code(x: str) -> str:
    return f"(CASE WHEN ({x}) < 50 THEN '0' WHEN ({x}) < 90 THEN '1' ELSE '2' END)"


def _number(name: str, tenth: str | None = None) -> str:
    return f"({_NUMBERS[name]})::VARCHAR" + (f" || '.' || ({_NUMBERS[tenth]})::VARCHAR" if tenth else "")


_Y = "k % 4 >= 2"
_ANSWERS = dict.fromkeys(FIELDS, f"'{MISSING}'") | {
    "admission_date": "strftime(d, '%d.%m.%Y')",
    "discharge_date": "strftime(d + to_days((1 + c % 9)::INT), '%d.%m.%Y')",
    "diagnosis_icd": "'I21.' || (k % 5)::VARCHAR",
    "art_hyper": _of("ah", "1", "0", "0"), "dm": _of("dm", "1", "0", "0"), "ckd": _of("ckd", MISSING, "ХБП 3А", MISSING, MISSING),
    "atr_fibril": "'0'", "copd": "'0'", "ecg_avb": "'0'", "tlt": _of("tlt", "1", "0", "0"), "ecg_elevation": _of("elev", "1", "0"),
    "mi_localisation": _of("wall", "A", "I", "L"), "type_acs": _of("st", "STEMI", "NSTEMI"), "killip": _of("kil", "1", "2", "3", "4"),
    "smoking": _of("smk", "Бросил курить", "Не курит", "Курит", "Бывший курильщик"),
    "bp": f"{_number('sys')} || '/' || {_number('dia')}", "bpm": _number("hr"), "rr": _number("rr"), "height": _number("height"), "weight": _number("kg", "tenth"), "spo2": _number("spo2"),
    "ecg_bpm": _number("ecg"), "ecg_rythm": _of("af", "фибрилляция предсердий", *["синусовый"] * 4),
    "echo_ef": _number("ef"), "echo_lvd": _number("lvd"), "echo_lvd_2": _number("lvs"),
    "ca_fact": _of("cag", "R", "N", "Y", "Y"), "ca_date": f"CASE WHEN {_Y} THEN strftime(d + to_days(1), '%d.%m.%Y') ELSE '{MISSING}' END",
    "ca_lad": f"CASE WHEN {_Y} THEN {_code('greatest(k % 100, c % 100)')} ELSE '{MISSING}' END", "rca": f"CASE WHEN {_Y} THEN {_code('(k + c) % 100')} ELSE '{MISSING}' END",
    "crea": _number("crea"), "glu": _number("glu", "tenth"), "hb": _number("hb"), "leucocytes": _number("leu", "other"), "thrombocytes": _number("thr"),
    "tot_chol": _number("chol", "tenth"), "ldl": _number("ldl", "other"), "card_trop": _of("trop", "положительный", "отрицательный", "0.15"),
    "aspirin": "'аспирин 75 мг вечером'", "2_aag": "'клопидогрел 75 мг утром'", "bb": "'бисопролол 5 мг'",
    "statin": f"{_of('stat', 'аторвастатин', 'розувастатин', 'симвастатин')} || ' ' || {_number('ef')} || ' мг на ночь'",
}
_ORDERS = "o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS d FROM orders)"


@query(f"WITH {_ORDERS} SELECT k AS doc_id, {', '.join(f'{sql} AS {chr(34)}{f}{chr(34)}' for f, sql in _ANSWERS.items())} FROM o")
def letter_records(spark, sf_dir):
    """All rules over the letters: the wide records of 50 texts."""
    return pipeline.preview(letters(spark, sf_dir), typos=False).flat.select("doc_id", *[F.col(f"`{f}`") for f in FIELDS])



# --- personal data ---------------------------------------------------------------------------

_IDENTITY = """ФИО: Иванов{s} Пётр Сергеевич, дата рождения: {dd}.0{m}.19{yy}, возраст: {age} лет.
Тел. +7 (912) {ppp}-{dd}-{yy}, e-mail: user{k}@mail{m}.example.org, паспорт 45 {yy} {six}, СНИЛС {ppp}-{ppp}-{ppp} {dd}.
Полис ОМС {sixteen}; карта {four} {four} {four} {four}; ИНН {ten}; ip 10.{m}.{dd}.{yy}; логин: user_{k}
Адрес: г. Город, ул. Новая, д. {k}; история болезни № {six}/{yy}
Больной {age} лет, мужчина. Болеет {m} лет, осмотр {dd}.0{m}.2021.
Анамнез жизни: работает инженером {m} смену; перенёс операцию. Проживает один
Лечащий Сидоров А.Б., подпись."""
_REDACTED = """ФИО: <PERSON_1>, дата рождения: <DOB_1>, возраст: <AGE_1>.
Тел. <PHONE_1>, e-mail: <EMAIL_1>, паспорт <PASSPORT_1>, СНИЛС <SNILS_1>.
Полис ОМС <OMS_1>; карта <LONG_NUMBER_1>; ИНН <ID_NUMBER_1>; ip <IP_1>; логин: <USERNAME_1>
Адрес: <ADDRESS_1>; история болезни № <MED_RECORD_1>
Больной <AGE_2> лет, мужчина. Болеет <AGE_3> лет, осмотр {day}.
Анамнез жизни: <BIO_1>; перенёс операцию. <BIO_2>
Лечащий <PERSON_2>, подпись."""
_PARTS = {
    "k": "c_custkey", "s": "['', 'ев', 'ский'][1 + c_custkey % 3]", "m": "1 + c_custkey % 9", "dd": "10 + c_custkey % 18", "yy": "30 + c_custkey % 60", "age": "20 + c_custkey % 70",
    "ppp": "100 + c_custkey % 900", "six": "100000 + c_custkey % 900000", "four": "1000 + c_custkey % 9000", "ten": "1000000000 + c_custkey", "sixteen": "1000000000000000 + c_custkey",
}


def identities(spark, sf_dir):
    """(doc_id, text): a text full of personal data a customer."""
    c = over_cores(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    parts = {n: F.expr(f"string({e})") for n, e in _PARTS.items() if n != "s"} | {"s": F.element_at(F.array(*map(F.lit, ("", "ев", "ский"))), F.expr("int(1 + c_custkey % 3)"))}
    return c.select(F.col("c_custkey").alias("doc_id"), _filled(_IDENTITY, parts).alias("text"))


def _sql_text(template: str, parts: dict) -> str:
    out = []
    for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
        out.append(f"({parts[piece[1:-1]]})::VARCHAR" if piece.startswith("{") else "'" + piece.replace("'", "''") + "'")
    return " || ".join(out)


def _redaction(mode: str) -> str:
    day = _sql_text("{dd}.0{m}.2021", _PARTS) if mode == "clinical" else "'<DATE_1>'"
    text = _sql_text(_REDACTED, {"day": day})
    return f"""WITH r AS (SELECT c_custkey AS doc_id, {_sql_text(_IDENTITY, _PARTS)} AS text, {text} AS redacted FROM customer)
SELECT doc_id, redacted, {19 if mode == "clinical" else 20}::BIGINT AS n_spans, TRUE AS safe, sha256(text) AS input_sha256, sha256(redacted) AS output_sha256 FROM r"""


def _anonymized(spark, sf_dir, mode):
    out = anonymize.anonymize(identities(spark, sf_dir), mode)
    return out.select("doc_id", "redacted", F.size("spans").cast("long").alias("n_spans"), "safe", "input_sha256", "output_sha256")


@query(_redaction("clinical"))
def identities_redacted(spark, sf_dir):
    """All detectors over texts of which every identifier is known."""
    return _anonymized(spark, sf_dir, "clinical")


@query(_redaction("strict"))
def identities_redacted_strictly(spark, sf_dir):
    return _anonymized(spark, sf_dir, "strict")


@query("""WITH s AS (SELECT l_suppkey AS doc_id, (l_orderkey * 10)::INT AS a, (l_orderkey * 10 + l_quantity)::INT AS b, ['X', 'Y', 'Z'][1 + l_linenumber % 3] AS kind FROM lineitem),
m AS (SELECT *, max(b) OVER w AS before FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY a, b DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m WHERE before IS NULL OR b > before)
SELECT doc_id, min(a) AS "start", max(b) AS "end", CASE WHEN count(DISTINCT kind) = 1 THEN any_value(kind) ELSE 'PII' END AS kind FROM i GROUP BY doc_id, island""")
def span_islands(spark, sf_dir):
    """The merge that redaction uses."""
    kind = F.element_at(F.array(*map(F.lit, "XYZ")), F.expr("int(1 + l_linenumber % 3)"))
    return anonymize.merged_kinds(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.expr("int(l_orderkey * 10)").alias("start"), F.expr("int(l_orderkey * 10 + l_quantity)").alias("end"), kind.alias("kind")))


# --- functions on phrases whose values are known ---------------------------------------------


def _values(rows) -> str:
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({k}, {', '.join(map(text, r))})" for k, r in enumerate(rows))


def _dealt(spark, sf_dir, rows, schema: str):
    """Every event with one of the rows, in turn; the rows are a constant."""
    some = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    e = table(spark, sf_dir, "events").select("event_id", F.expr(f"int(event_id % {len(rows)})").alias("k"))
    return e.join(F.broadcast(some), "k").drop("k")


_CODES = [
    ("trop", "положительный", "положительный"), ("trop", "+", "положительный"), ("trop", "-", "отрицательный"), ("trop", "Negative", "отрицательный"), ("trop", "0,35 нг/мл", "0.35"), ("trop", "нет данных", MISSING),
    ("stenosis", "стеноз 49%", "0"), ("stenosis", "стеноз 50%", "1"), ("stenosis", "89 %", "1"), ("stenosis", "90%", "2"), ("stenosis", "Окклюзия в устье", "2"), ("stenosis", "без гемодинамически значимого стеноза", "0"), ("stenosis", "норма", MISSING),
    ("wall", "передней стенки", "A"), ("wall", "задне-диафрагмальный", "I"), ("wall", "Нижний", "I"), ("wall", "боковой", "L"), ("wall", "циркулярный", "N"),
    ("acs", "Нестабильная стенокардия без подъёма ST", "NA"), ("acs", "ОКС без подъёма сегмента ST", "NSTEMI"), ("acs", "NSTEMI", "NSTEMI"), ("acs", "ОКС с подъёмом ST", "STEMI"), ("acs", "иное", "NA"),
    ("rhythm", "Фибрилляция предсердий, тахиформа", "фибрилляция предсердий"), ("rhythm", "трепетание предсердий", "трепетание предсердий"), ("rhythm", "ритм синусовый", "синусовый"), ("rhythm", "узловой ритм", "узловой"),
    ("rhythm", "ритм ЭКС", "ритм ЭКС"), ("rhythm", "желудочковый", "желудочковый"), ("rhythm", " предсердный ", "предсердный"), ("rhythm", " иной ", "иной"),
    ("smoking", "Бросила курить в 2010", "Бросила курить"), ("smoking", "бросил курить", "Бросил курить"), ("smoking", "прекратил курить", "Прекратил курить"), ("smoking", "бывшая курильщица и бывший курильщик", "Бывший курильщик"),
    ("smoking", "ex-smoker", "Бывший курильщик"), ("smoking", "не курит", "Не курит"), ("smoking", "курит 20 лет", "Курит"), ("smoking", "; нет сведений.", "нет сведений"),
    ("killip", "iv", "4"), ("killip", "3", "3"), ("ckd", "ХБП С3A", "ХБП 3А"), ("ckd", "CKD 4", "ХБП 4"), ("avb", "АВ-блокада 2 степени", "2"), ("avb", "АВ-блокада", "1"), ("avb", "без блокад", "0"), ("avb", "норма", MISSING),
    ("num", "-3,5 ед", "-3.5"), ("date", "5/3/21", "05.03.2021"), ("date", "31.02.2020", MISSING), ("bp", "120 \\ 80", "120/80"), ("bp", "нет", MISSING),
    ("slug", " a b/ё_c. ", "a_b__c"), ("short", "Название: подробно, далее", "Название"), ("json", 'ok ```json {"a": 1} ``` end', '{"a": 1}'), ("json", "no object", None), ("run", "x/y z", "api__x_y_z"),
]


@query(f"SELECT event_id, fn, raw, want AS value FROM events JOIN (VALUES {_values(_CODES)}) AS c(k, fn, raw, want) ON event_id % {len(_CODES)} = k")
def coded_phrases(spark, sf_dir):
    """All scalar normalisers."""
    made = {
        "trop": N.norm_trop, "stenosis": N.stenosis_code, "wall": N.loc_code, "acs": N.acs_code, "rhythm": N.norm_rhythm, "smoking": N.norm_smoking, "killip": N.roman, "ckd": N.norm_ckd, "avb": N.norm_avb,
        "num": N.norm_num, "date": N.norm_date, "bp": N.norm_bp, "slug": N.slug, "short": lambda x: short_label(F.col(x)), "json": N.json_object, "run": lambda x: N.run_dir_name(F.lit("api"), F.col(x), F.lit(" ")),
    }
    value = F.lit(None).cast("string")
    for name, f in made.items():
        value = F.when(F.col("fn") == name, f("raw")).otherwise(value)
    return _dealt(spark, sf_dir, [c[:2] for c in _CODES], "fn string, raw string").select("event_id", "fn", "raw", value.alias("value"))


_FINAL = [
    ("dm", "не выявлен", "0", True), ("dm", "есть", "1", True), ("type_acs", "na", "NA", True), ("bp", "n/a", MISSING, True), ("killip", "II", "2", True), ("killip", "5", "5", False), ("ca_fact", "выполнена", "Y", True),
    ("ca_fact", "отказ", "R", True), ("ca_fact", "иное", "N", True), ("diagnosis_icd", "i21.0", "I21.0", True), ("diagnosis_icd", "21", "21", False), ("crea", "99,5 мкмоль", "99.5", True), ("crea", "99999", "99999", False),
    ("admission_date", "1.2.2020", "01.02.2020", True), ("admission_date", "31.02.2020", MISSING, True), ("ecg_avb", "АВ-блокада", "1", True), ("ecg_avb", "АВ-блокады нет", "0", True), ("ecg_avb", "норма", MISSING, True),
    ("ca_lad", "95%", "2", True), ("rca", "1", "1", True), ("mi_localisation", "передняя", "A", True), ("smoking", "курит", "Курит", True), ("hf", " ХСН II ", "ХСН II", True), ("bp", "80/120", "80/120", False),
    ("bp", "130/80", "130/80", True), ("bp", "400/80", "400/80", False), ("spo2", "97%", "97", True), ("spo2", "7", "7", False), ("card_trop", "pos", "положительный", True), ("ecg_rythm", "sinus", "синусовый", True), ("hb", "None", MISSING, True),
]


@query(f"SELECT event_id, field, raw, want AS value, ok AS valid FROM events JOIN (VALUES {_values(_FINAL)}) AS c(k, field, raw, want, ok) ON event_id % {len(_FINAL)} = k")
def final_values(spark, sf_dir):
    """The last word on a field's value, and whether it has the field's form."""
    d = _dealt(spark, sf_dir, [c[:2] for c in _FINAL], "field string, raw string").withColumn("value", N.normalize_field_value("field", "raw"))
    return d.select("event_id", "field", "raw", "value", N.format_valid("field", "value").alias("valid"))


_SUPPORT = [
    ("120.5", "Гемоглобин 120,5", "Гемоглобин 120,5 г/л.", True, True), ("121", "Гемоглобин 120,5", "Гемоглобин 120,5 г/л.", True, False), ("1", "Диабет", "Диабет.", True, True), ("1", " ", "Диабет.", True, False),
    ("120.5", "Гемоглобин 120,5", "Гемоглобин 120,5 г/л.", False, False), (MISSING, "", "", False, True), ("130/80", "АД 130 / 80", "АД 130 / 80 мм", True, True), ("130/90", "АД 130 / 80", "АД 130 / 80 мм", True, False), ("Курит", "КУРИТ", "Много курит.", True, True), (None, "", "", False, True),
]


@query(f"SELECT event_id, c.value, ok AS supported FROM events JOIN (VALUES {_values(_SUPPORT)}) AS c(k, value, evidence, sentence, placed, ok) ON event_id % {len(_SUPPORT)} = k")
def supported_values(spark, sf_dir):
    d = _dealt(spark, sf_dir, [c[:4] for c in _SUPPORT], "value string, evidence string, sentence string, placed boolean")
    return d.select("event_id", "value", N.value_supported("value", "evidence", "sentence", "placed").alias("supported"))


_NESTED = {f: f"CASE WHEN c_custkey % {k + 2} = 0 THEN NULL ELSE concat(c_custkey + {k}, '') END" for k, f in enumerate(FIELDS)}


@query("SELECT c_custkey AS doc_id, " + ", ".join(f"coalesce({x}, '{MISSING}') AS {chr(34)}{f}{chr(34)}" for f, x in _NESTED.items()) + " FROM customer")
def nested_round_trip(spark, sf_dir):
    flat = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), *[F.expr(x).alias(f) for f, x in _NESTED.items()])
    return arbitrate.flattened(arbitrate.nested(flat))


# --- arbitration: peers, fields without candidates, audits -----------------------------------

_PRIORS = "priors AS (SELECT DISTINCT l_orderkey AS doc_id, unnest(['hf', 'killip', 'hb']) AS field, (l_orderkey % 3 + 1)::VARCHAR AS value, (l_orderkey % 10) / 10 AS support FROM lineitem)"
_WITH_PEERS = _BASE.replace(
    "w4 AS (SELECT *, bool_or(evidence_ok AND NOT absence AND base_score >= 0.55) OVER (PARTITION BY doc_id, field) AS direct FROM w3)",
    f"""{_PRIORS},
w3b AS (SELECT w3.*, CASE WHEN base_score >= max(base_score) OVER (PARTITION BY w3.doc_id, w3.field) - 0.08 AND w3.field IN ('hf', 'killip') THEN least(greatest(coalesce(support, 0) * 0.035::DOUBLE, 0), 0.035::DOUBLE) ELSE 0 END AS bonus FROM w3 LEFT JOIN priors USING (doc_id, field, value)),
w3c AS (SELECT *, CASE WHEN bonus > 0 THEN least(1.0::DOUBLE, base_score + bonus) ELSE base_score END AS moved FROM w3b),
w4 AS (SELECT *, bool_or(evidence_ok AND NOT absence AND moved >= 0.55) OVER (PARTITION BY doc_id, field) AS direct FROM w3c)""",
).replace("THEN base_score * 0.65 ELSE base_score END AS s5", "THEN moved * 0.65 ELSE moved END AS s5")


@query(f"WITH {_WITH_PEERS} SELECT doc_id, field, ord, round(bonus, 6) AS peer_bonus, round(score, 6) AS score FROM scored")
def peer_scores(spark, sf_dir):
    """Near ties moved by what peers have."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    priors = li.select("doc_id", F.explode(F.array(*map(F.lit, ("hf", "killip", "hb")))).alias("field"), F.expr("string(doc_id % 3 + 1)").alias("value"), F.expr("(doc_id % 10) / 10").alias("support"))
    s = arbitrate.scored(line_candidates(spark, sf_dir), priors, 0.035)
    return s.select("doc_id", "field", "ord", F.round("peer_bonus", 6).alias("peer_bonus"), F.round("score", 6).alias("score"))


@query(f"""WITH {_DECIDED}, every AS (SELECT DISTINCT o_orderkey AS doc_id, unnest(['hb', 'killip', 'hf', 'bb', 'ldl']) AS field FROM orders)
SELECT e.doc_id, e.field, coalesce(l.value, '{MISSING}') AS value, coalesce(l.score, 0.55)::DOUBLE AS score, coalesce(l.label, 'suspicious') AS label, coalesce(l.conflict, FALSE) AS conflict FROM every e LEFT JOIN labelled l USING (doc_id, field)""")
def completed_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    d = arbitrate.decide(arbitrate.scored(line_candidates(spark, sf_dir)))
    return arbitrate.complete(d, docs, ["hb", "killip", "hf", "bb", "ldl"]).select("doc_id", "field", "value", "score", "label", "conflict")


@query(f"""WITH {_BASE} SELECT doc_id, field, string_agg(source || ':' || fam || ':' || value || ':' || round(round(least(1.0, greatest(0.0, score)), 4) * 10000)::INT::VARCHAR, ' ' ORDER BY round(least(1.0, greatest(0.0, score)), 4) DESC, source_ord, ord) AS candidates FROM scored GROUP BY doc_id, field""")
def candidate_audit(spark, sf_dir):
    rows = arbitrate.audit(arbitrate.scored(line_candidates(spark, sf_dir)))
    one = lambda x: F.concat_ws(":", x.source, x.family, x.value, F.round(x.score * 10000).cast("int").cast("string"))
    return rows.select("doc_id", "field", F.array_join(F.transform("candidates", one), " ").alias("candidates"))


@query(f"WITH {_DECIDED} SELECT doc_id, field, value FROM labelled WHERE value <> '{MISSING}' AND score >= 0.90 AND format_ok AND evidence_ok")
def confident_values(spark, sf_dir):
    return similarity.confident(arbitrate.decide(arbitrate.scored(line_candidates(spark, sf_dir))))


@query(f"WITH {_DECIDED} SELECT doc_id, field, value, CASE WHEN value = '{MISSING}' THEN NULL ELSE selected_source END AS source FROM labelled")
def field_context(spark, sf_dir):
    c = arbitrate.context(arbitrate.decide(arbitrate.scored(line_candidates(spark, sf_dir))))
    return c.select("doc_id", F.explode("context").alias("field", "v")).select("doc_id", "field", "v.value", "v.source")


@query(f"SELECT doc_id, field FROM ({_SQL['family_compare_events']}) WHERE event IN ('regex_coverage_gap', 'api_coverage_gap', 'semantic_conflict')")
def disagreement_fields(spark, sf_dir):
    return routing.disagreements(routing.compared(line_candidates(spark, sf_dir)))


@query(f"""WITH f AS (SELECT o_orderkey AS doc_id, unnest(['ca_fact', 'ca_date', 'ca_lad', 'crea', 'dm']) AS field, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE 'N' END, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE '{MISSING}' END,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 100 < 50 THEN '0' WHEN o_custkey % 100 < 90 THEN '1' ELSE '2' END ELSE '{MISSING}' END, CASE WHEN o_custkey % 5 = 0 THEN '{MISSING}' ELSE (o_custkey % 300)::VARCHAR || '.5' END, CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '1' END]) AS value FROM orders)
SELECT doc_id, field, value, (CASE WHEN value = '{MISSING}' THEN 0.0 ELSE 0.9 END)::DOUBLE AS score, CASE WHEN value = '{MISSING}' THEN 'bad' ELSE 'good' END AS label, CASE WHEN value = '{MISSING}' THEN NULL ELSE 'regex' END AS selected_source FROM f""")
def postprocessed_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done = F.when(F.expr("o_orderkey % 3 = 0"), "Да, выполнена").otherwise("нет")
    raw = {"ca_fact": done, "ca_date": F.date_format(F.to_date("o_orderdate"), "d/M/yyyy"), "ca_lad": F.concat(F.expr("string(o_custkey % 100)"), F.lit(" %")), "crea": F.when(F.expr("o_custkey % 5 = 0"), "null").otherwise(F.concat(F.expr("string(o_custkey % 300)"), F.lit(",5 мкмоль/л"))), "dm": F.when(F.expr("o_orderkey % 2 = 0"), "отрицает").otherwise("да")}
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in raw.items()])).alias("x")).select("doc_id", "x.*")
    rows = rows.withColumns({"score": F.lit(0.9), "label": F.lit("good"), "selected_source": F.lit("regex")})
    return arbitrate.postprocessed(rows).select("doc_id", "field", "value", "score", "label", "selected_source")


@query("""SELECT d.doc_id, 'flags' AS grp, length(d.text) + 13 AS n_user, '{"quality":"' || l.quality || '","toxic":"' || l.toxic || '"}' AS answer FROM documents d JOIN labels l USING (doc_id)""")
def training_chats(spark, sf_dir):
    """Training chats of documents and their labels, read back."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")).unpivot("doc_id", ["quality", "toxic"], "field", "value")
    groups = spark.createDataFrame([("quality", "flags"), ("toxic", "flags")], "field string, grp string")
    chats, _ = evaluate.chat_rows(documents(spark, sf_dir), labels, groups)
    said = F.from_json("chat", "messages array<struct<role:string,content:string>>").messages
    return chats.select("doc_id", "grp", F.length(said[1].content).cast("long").alias("n_user"), said[2].content.alias("answer"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
