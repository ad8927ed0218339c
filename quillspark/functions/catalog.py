"""The field catalogue: what is extracted, from where, and how it is checked.

Everything here is data.  Rules, sections and thresholds that the published field list leaves
open are this library's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The text that stands for a missing value, and the groups of fields in order.
MISSING = "не указано"
GROUPS = {
    "даты эпизода": "admission_date discharge_date",
    "диагноз": "art_hyper atr_fibril ckd copd diagnosis_icd dm hf killip mi_localisation tlt type_acs",
    "осмотр при поступлении": "bmi bp bpm height rr smoking spo2 weight",
    "ЭКГ": "ecg_avb ecg_bpm ecg_elevation ecg_rythm",
    "ЭХО-КГ": "echo_ef echo_lvd echo_lvd_2 echo_mr echo_zone",
    "рентген грудной полости": "rg_date rg_pc",
    "коронарография": "ca_date ca_fact ca_lad rca",
    "Лабораторные данные": "card_trop crea glu hb ldl leucocytes thrombocytes tot_chol",
    "медикаментозная терапия": "2_aag ace_ing_sartan anticoagulant aspirin bb statin",
}
#: Kinds of fields that aren't text, and closed sets of values.
KINDS = {
    "date": "admission_date discharge_date rg_date ca_date",
    "number": "bmi bpm height rr spo2 weight ecg_bpm echo_ef echo_lvd echo_lvd_2 crea glu hb ldl leucocytes thrombocytes tot_chol",
    "bp": "bp",
    "binary": "art_hyper atr_fibril copd dm tlt ecg_avb ecg_elevation",
    "enum": "diagnosis_icd killip mi_localisation type_acs ca_fact ca_lad rca",
}
CLOSED = {"killip": "1 2 3 4", "mi_localisation": "A I L N", "type_acs": "STEMI NSTEMI NA", "ca_fact": "Y R N", "ca_lad": "0 1 2", "rca": "0 1 2"}
#: Fields with simple patterns, fields where rules or models are preferred, and fields that peers may break ties of.
SIMPLE = frozenset("admission_date discharge_date bp bpm rr spo2 height weight bmi ecg_bpm echo_ef echo_lvd echo_lvd_2 crea glu hb ldl leucocytes thrombocytes tot_chol diagnosis_icd".split())
RULES_PREFERRED = SIMPLE | {"rg_date", "ca_date", "ca_lad", "rca"}
MODEL_PREFERRED = frozenset("ckd hf smoking ecg_rythm echo_mr echo_zone rg_pc".split())
PEER_FIELDS = frozenset("art_hyper atr_fibril ckd copd diagnosis_icd dm hf killip mi_localisation tlt type_acs ecg_avb ecg_elevation ecg_rythm ca_fact ca_lad rca".split())
#: Weights of the fields by which two documents are alike.
CLINICAL_WEIGHTS = {"diagnosis_icd": 3.0, "type_acs": 2.5, "mi_localisation": 2.0, "killip": 1.0, "hf": 1.0, "ckd": 1.0, "atr_fibril": 0.6, "dm": 0.6, "copd": 0.5, "art_hyper": 0.4}

FIELDS = [f for names in GROUPS.values() for f in names.split()]
GROUP_OF = {f: g for g, names in GROUPS.items() for f in names.split()}
KIND_OF = dict.fromkeys(FIELDS, "text") | {f: k for k, names in KINDS.items() for f in names.split()}
BINARY = [f for f in FIELDS if KIND_OF[f] == "binary"]
MASK_FIELDS = [f for f in FIELDS if KIND_OF[f] != "binary" and f != "ca_fact"]

#: Own choice: the widest plausible values of numeric fields.
RANGES = {
    "bmi": (8, 90), "bpm": (20, 300), "height": (50, 250), "rr": (4, 80), "spo2": (30, 100), "weight": (20, 400), "ecg_bpm": (20, 300),
    "echo_ef": (5, 90), "echo_lvd": (10, 120), "echo_lvd_2": (10, 120), "crea": (10, 2500), "glu": (0.5, 80), "hb": (20, 260),
    "ldl": (0.1, 20), "leucocytes": (0.1, 200), "thrombocytes": (1, 2000), "tot_chol": (0.5, 30),
}

#: Own choice: headings of sections, in order of precedence.
SECTIONS = {
    "diagnosis": ("заключительный диагноз", "заключительный клинический диагноз", "клинический диагноз", "диагноз при выписке", "основной диагноз", "диагноз", "diagnosis", "final diagnosis"),
    "history": ("анамнез заболевания", "анамнез жизни", "анамнез", "history"),
    "exam": ("объективный статус при поступлении", "объективный статус", "объективно", "осмотр при поступлении", "общий осмотр", "физикальное обследование", "physical exam", "exam"),
    "ecg": ("экг при поступлении", "электрокардиография", "электрокардиограмма", "экг", "ecg"),
    "echo": ("эхокардиография", "эхо-кг", "эхокг", "эхо кг", "трансторакальная эхокардиография", "echocardiography", "echo"),
    "xray": ("рентгенография органов грудной клетки", "рентгенография огк", "рентген грудной клетки", "рентген огк", "рентгенография", "x-ray"),
    "cag": ("коронароангиография", "селективная коронарография", "коронарография", "каг", "coronary angiography"),
    "labs": ("лабораторные данные", "лабораторные исследования", "анализы крови", "анализы", "биохимический анализ крови", "общий анализ крови", "laboratory", "labs"),
    "treatment": ("проведенное лечение", "проведённое лечение", "лечение в стационаре", "лечение", "treatment"),
    "meds": ("назначения при выписке", "рекомендации при выписке", "лекарственная терапия при выписке", "рекомендованная терапия", "рекомендации", "discharge medications"),
}

#: Own choice: where a field may be found.
SOURCES = {g: s for g, s in zip(GROUPS, (("episode",), ("diagnosis",), ("exam",), ("ecg",), ("echo",), ("xray",), ("cag",), ("labs",), ("meds",)), strict=True)}
SOURCES_OF = {f: SOURCES[GROUP_OF[f]] for f in FIELDS} | {"tlt": ("episode",), "smoking": ("history", "exam"), "mi_localisation": ("diagnosis",), "type_acs": ("diagnosis",)}

#: Own choice: patterns by field; the first group is the value.
PATTERNS = {
    "admission_date": (r"(?:дата\s+поступления|поступил[аи]?|госпитализирован[аы]?|находил(?:ся|ась)[^.\n]{0,40}?\bс)\D{0,25}(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})", r"admitted\D{0,20}(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})"),
    "discharge_date": (r"(?:дата\s+выписки|выписан[аы]?)\D{0,25}(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})", r"\bпо\s+(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})", r"discharged\D{0,20}(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})"),
    "art_hyper": (r"гипертоническ\w+\s+болезн\w*", r"артериальн\w+\s+гипертенз\w*", r"\bГБ\s+[I1-3]+\b"),
    "atr_fibril": (r"фибрилляц\w+\s+предсерд\w*", r"мерцательн\w+\s+аритми\w*", r"atrial\s+fibrillation"),
    "ckd": (r"((?:ХБП|CKD)\s*(?:[СC]\s*)?[1-5]?\s*[АAБB]?)",),
    "copd": (r"\bХОБЛ\b", r"хроническ\w+\s+обструктивн\w+\s+болезн\w*"),
    "diagnosis_icd": (r"\b([A-ZА-Я]\d{2}(?:\.\d{1,3})?)\b",),
    "dm": (r"сахарн\w+\s+диабет\w*", r"\bСД\s*[12I]", r"diabetes\s+mellitus"),
    "hf": (r"(\b(?:ХСН|ОСН)\b[^.;,\n]{0,40})",),
    "killip": (r"killip\s*[-:]?\s*(IV|III|II|I|[1-4])\b",),
    "mi_localisation": (r"((?:передн|нижн|боков|диафрагм|латераль)\w*[^.;\n]{0,30}(?:стенк\w*|локализац\w*|инфаркт\w*))", r"инфаркт\w*\s+миокарда[^.;\n]{0,40}?((?:передн|нижн|боков)\w*)"),
    "type_acs": (r"((?:ОКС|инфаркт\w*\s+миокарда|ИМ)?\s*(?:с\s+(?:подъ[её]мом|элеваци\w*)|без\s+(?:подъ[её]ма|элеваци\w*))\s*(?:сегмента\s+)?ST)", r"(нестабильн\w+\s+стенокард\w*)", r"\b(N?STEMI)\b"),
    "bmi": (r"(?:ИМТ|индекс\s+массы\s+тела|BMI)\D{0,12}(\d{1,2}(?:[.,]\d+)?)",),
    "bp": (r"(?:АД|артериальное\s+давление|BP)\D{0,20}(\d{2,3}\s*[/\\]\s*\d{2,3})",),
    "bpm": (r"(?:ЧСС|пульс|HR)\D{0,15}(\d{2,3})",),
    "height": (r"(?:рост|height)\D{0,8}(\d{2,3})",),
    "rr": (r"(?:ЧДД?|частота\s+дыхания|RR)\D{0,12}(\d{1,2})",),
    "smoking": (r"((?:бросил[а]?|прекратил[а]?)\s+курить|бывш\w+\s+курильщик\w*|не\s+курит|курит|(?:ex|non)-?\s?smoker)",),
    "spo2": (r"(?:SpO2|SpО2|сатурац\w*)\D{0,15}(\d{2,3})",),
    "weight": (r"(?:вес|масса\s+тела|weight)\D{0,8}(\d{2,3}(?:[.,]\d+)?)",),
    "ecg_avb": (r"(?:АВ|AV|атриовентрикулярн\w*)[\s-]*блокад\w*[^.;\n]{0,20}", r"AV\s+block"),
    "ecg_bpm": (r"(?:ЧСС|HR)\D{0,12}(\d{2,3})",),
    "ecg_elevation": (r"(?:элевац\w*|подъ[её]м\w*)\s*(?:сегмента\s*)?ST", r"ST\s+elevation"),
    "ecg_rythm": (r"((?:ритм\s+синусов\w*|синусов\w*\s+ритм|фибрилляц\w+\s+предсерд\w*|трепетан\w+\s+предсерд\w*|ритм\s+ЭКС|sinus\s+rhythm))",),
    "echo_ef": (r"(?:ФВ|фракция\s+выброса|EF)[^\d\n]{0,25}(\d{2}(?:[.,]\d+)?)",),
    "echo_lvd": (r"КДР\D{0,12}(\d{2,3}(?:[.,]\d+)?)",),
    "echo_lvd_2": (r"КСР\D{0,12}(\d{2,3}(?:[.,]\d+)?)",),
    "echo_mr": (r"(митральн\w+\s+регургитац\w*[^.;\n]{0,30})",),
    "echo_zone": (r"((?:гипокинез|акинез|дискинез)\w*\s+(?!диффуз)[^.;\n]{3,60})",),
    "rg_date": (r"(?:рентген\w*)\D{0,40}(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})",),
    "rg_pc": (r"((?:очагов\w*|инфильтратив\w*|застой\w*|патологическ\w+\s+тен\w*|без\s+патолог\w*)[^.\n]{0,120})",),
    "ca_date": (r"(?:коронаро(?:ангио)?графи\w*|КАГ)\D{0,30}(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})",),
    "card_trop": (r"тропонин\w*[^\d\n.;+-]{0,20}(положительн\w*|отрицательн\w*|[+-](?!\d)|\d+(?:[.,]\d+)?)",),
    "crea": (r"креатинин\w*\D{0,15}(\d{2,4}(?:[.,]\d+)?)", r"creatinine\D{0,10}(\d{2,4}(?:[.,]\d+)?)"),
    "glu": (r"глюкоз\w*\D{0,15}(\d{1,2}(?:[.,]\d+)?)",),
    "hb": (r"(?:гемоглобин\w*|Hb)\D{0,12}(\d{2,3}(?:[.,]\d+)?)",),
    "ldl": (r"(?:ЛПНП|ЛНП|LDL)\D{0,12}(\d{1,2}(?:[.,]\d+)?)",),
    "leucocytes": (r"лейкоцит\w*\D{0,12}(\d{1,3}(?:[.,]\d+)?)",),
    "thrombocytes": (r"тромбоцит\w*\D{0,12}(\d{1,4}(?:[.,]\d+)?)",),
    "tot_chol": (r"(?:общий\s+холестерин|холестерин\s+общий|холестерин)\D{0,12}(\d{1,2}(?:[.,]\d+)?)",),
}

#: Own choice: drug names by class.
DRUGS = {
    "2_aag": ("клопидогрел", "тикагрелор", "прасугрел", "clopidogrel", "ticagrelor"),
    "ace_ing_sartan": ("эналаприл", "лизиноприл", "периндоприл", "рамиприл", "лозартан", "валсартан", "телмисартан"),
    "anticoagulant": ("апиксабан", "ривароксабан", "дабигатран", "варфарин", "эноксапарин"),
    "aspirin": ("ацетилсалициловая кислота", "аспирин", "тромбо асс", "кардиомагнил", "aspirin"),
    "bb": ("бисопролол", "метопролол", "карведилол", "небиволол"),
    "statin": ("аторвастатин", "розувастатин", "симвастатин", "питавастатин"),
}

#: Own choice: the generic pack, for text without clinical content.
GENERIC_PATTERNS = {
    "email": (r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",),
    "ipv4": (r"(?<![0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![0-9.])",),
    "long_number": (r"(?<![0-9])([0-9]{16})(?![0-9])",),
    "license": (r"((?md)^[^\n]*\b(?i:license|cc by)[^\n]*)",),
    "year": (r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])",),
}

#: Own choice: words close to which a mention is denied.
DENIALS = r"(?iu)\b(?:не|нет|без|отсутств\w*|отриц\w*)\b"


@dataclass(frozen=True)
class FieldSpec:
    field: str
    grp: str
    kind: str
    absence: str
    closed: tuple[str, ...]
    sources: tuple[str, ...]
    low: float | None
    high: float | None


def specs() -> list[FieldSpec]:
    absent = lambda f: "zero" if KIND_OF[f] == "binary" else "N" if f == "ca_fact" else "none"
    return [FieldSpec(f, GROUP_OF[f], KIND_OF[f], absent(f), tuple(CLOSED.get(f, "").split()), SOURCES_OF[f], *(RANGES.get(f) or (None, None))) for f in FIELDS]


def spec_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a table of one row a field; its size is fixed."""
    rows = [(s.field, s.grp, s.kind, s.absence, list(s.closed), list(s.sources), None if s.low is None else float(s.low), None if s.high is None else float(s.high)) for s in specs()]
    return spark.createDataFrame(rows, "field string, grp string, kind string, absence string, closed array<string>, sources array<string>, low double, high double")
