"""Registered queries over the driver's tables, and the same in SQL.

Each query applies an operator to whole tables.  Doubles are rounded in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.catalog import GENERIC_PATTERNS, MISSING
from ..operators import anonymize, arbitrate, evaluate, extract, routing, segment, similarity
from ..streaming.worker import parse_lines

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# --- segmentation and scalar functions -------------------------------------------------------

_LINES = """lines AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
placed AS (SELECT doc_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines)"""


@query(f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, start, length(line)::BIGINT AS length FROM placed")
def doc_lines(spark, sf_dir):
    return segment.lines(documents(spark, sf_dir)).select("doc_id", "line_no", "start", F.length("line").cast("long").alias("length"))


GENERIC_SECTIONS = {"license": ("licensed", "this work is licensed", "released under", "all rights reserved"), "the": ("the",)}


@query(f"""WITH {_LINES},
named AS (SELECT *, lower(trim(line, ' ')) AS low, trim(line, ' ') AS raw FROM placed),
headed AS (SELECT *, CASE WHEN low = '' THEN NULL
  WHEN regexp_matches(low, '^(licensed|this work is licensed|released under|all rights reserved)(\\s*[:.;—–-]|\\s*$)') THEN 'license'
  WHEN regexp_matches(low, '^(the)(\\s*[:.;—–-]|\\s*$)') THEN 'the' END AS name,
  regexp_replace(raw, '[^\\p{{L}}]+', '', 'g') AS letters, max(start + length(line)) OVER (PARTITION BY doc_id) AS total FROM named),
marks AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), total) AS stop FROM headed
  WHERE name IS NOT NULL OR (raw <> '' AND length(raw) <= 120 AND NOT regexp_matches(raw, '[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{2,4}}') AND
    ((ends_with(raw, ':') AND len(regexp_split_to_array(raw, '\\s+')) <= 12) OR (letters <> '' AND length(raw) <= 80 AND NOT regexp_matches(letters, '[^\\p{{Lu}}]')))))
SELECT doc_id, name, start, stop::BIGINT AS "end" FROM marks WHERE name IS NOT NULL""")
def doc_sections(spark, sf_dir):
    return segment.sections(documents(spark, sf_dir), GENERIC_SECTIONS)


@query("""WITH pieces AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS s FROM documents)
SELECT doc_id, count_if(trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '')::BIGINT AS n_sentences, sum(length(trim(s, ' ' || chr(9) || chr(10) || chr(13))))::BIGINT AS n_chars FROM pieces GROUP BY doc_id""")
def sentence_spans(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", segment.sentence_spans("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0), lambda n, x: n + x.end - x.start).cast("long").alias("n_chars"))


@query("""SELECT doc_id, trim(regexp_replace(replace(lower(text), ',', '.'), '\\s+', ' ', 'g'), ' ') AS normal FROM documents""")
def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.match_form("text").alias("normal"))


@query("""WITH a AS (SELECT doc_id, regexp_replace(lower(text), '(?m)^[^\\n]*(?:фио|пациент|паспорт|снилс|полис|телефон|e-mail|адрес)[^\\n]*$', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}', ' ', 'g'), '[0-9]+(?:[.,][0-9]+)?', ' ', 'g') AS t FROM a)
SELECT doc_id, md5(trim(regexp_replace(t, '[ \\t\\n\\r]+', ' ', 'g'), ' ')) AS clean_md5 FROM b""")
def clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(N.clean_text("text")).alias("clean_md5"))


@query(f"""SELECT event_id,
  CASE WHEN regexp_matches(s, '-?\\d+(?:[.,]\\d+)?') THEN replace(regexp_extract(s, '(-?\\d+(?:[.,]\\d+)?)', 1), ',', '.') ELSE '{MISSING}' END AS num,
  CASE WHEN regexp_matches(d, '(\\d{{1,2}})[.\\-/](\\d{{1,2}})[.\\-/](\\d{{2,4}})') THEN coalesce(strftime(try_strptime(
    lpad(regexp_extract(d, '(\\d{{1,2}})[.\\-/](\\d{{1,2}})[.\\-/](\\d{{2,4}})', 1), 2, '0') || '.' || lpad(regexp_extract(d, '(\\d{{1,2}})[.\\-/](\\d{{1,2}})[.\\-/](\\d{{2,4}})', 2), 2, '0') || '.20' || regexp_extract(d, '(\\d{{1,2}})[.\\-/](\\d{{1,2}})[.\\-/](\\d{{2,4}})', 3), '%d.%m.%Y'), '%d.%m.%Y'), '{MISSING}') ELSE '{MISSING}' END AS day,
  CASE WHEN regexp_matches(b, '(\\d{{2,3}})\\s*[/\\\\]\\s*(\\d{{2,3}})') THEN regexp_extract(b, '(\\d{{2,3}})\\s*[/\\\\]\\s*(\\d{{2,3}})', 1) || '/' || regexp_extract(b, '(\\d{{2,3}})\\s*[/\\\\]\\s*(\\d{{2,3}})', 2) ELSE '{MISSING}' END AS bp
FROM (SELECT event_id, 'value ' || event_type || ' ' || replace((user_id % 97)::VARCHAR || '.' || (event_id % 10)::VARCHAR, '.', ',') AS s,
  'on ' || (event_id % 33)::VARCHAR || '.' || (event_id % 14)::VARCHAR || '.' || lpad((event_id % 100)::VARCHAR, 2, '0') AS d,
  'BP ' || (90 + event_id % 90)::VARCHAR || ' / ' || (user_id % 120)::VARCHAR AS b FROM events)""")
def num_date_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = lambda x: F.expr(x).cast("string")
    s = F.concat(F.lit("value "), F.col("event_type"), F.lit(" "), text("user_id % 97"), F.lit(","), text("event_id % 10"))
    d = F.concat(F.lit("on "), text("event_id % 33"), F.lit("."), text("event_id % 14"), F.lit("."), F.lpad(text("event_id % 100"), 2, "0"))
    b = F.concat(F.lit("BP "), text("90 + event_id % 90"), F.lit(" / "), text("user_id % 120"))
    return e.select("event_id", N.norm_num(s).alias("num"), N.norm_date(d).alias("day"), N.norm_bp(b).alias("bp"))


# --- candidates, arbitration and scores ------------------------------------------------------

_FIELDS = ("hb", "killip", "hf", "bb")
#: Candidates made from line items: four fields an order, sources, values and checks by arithmetic.
_CANDIDATES = """cand AS (SELECT l_orderkey AS doc_id, ['hb', 'killip', 'hf', 'bb'][1 + (l_linenumber + l_suppkey) % 4] AS field, l_linenumber AS ord,
  ((l_partkey % 3) + 1)::VARCHAR AS value, ['regex', 'typo_regex', 'local', 'api', 'manual'][1 + l_partkey % 5] AS source,
  0.5::DOUBLE + ((l_partkey * 13 + l_suppkey * 7 + l_linenumber) % 997) / 2011::DOUBLE AS confidence, l_suppkey % 7 <> 0 AS format_ok, l_partkey % 6 <> 0 AS evidence_ok, l_linenumber % 5 = 0 AS absence, l_orderkey % 11 AS grp FROM lineitem)"""


def line_candidates(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pick = lambda names, expr: F.element_at(F.array(*[F.lit(n) for n in names]), F.expr(f"int(1 + {expr})"))
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        pick(_FIELDS, "(l_linenumber + l_suppkey) % 4").alias("field"),
        F.col("l_linenumber").cast("int").alias("ord"),
        F.expr("string(l_partkey % 3 + 1)").alias("value"),
        pick(("regex", "typo_regex", "local", "api", "manual"), "l_partkey % 5").alias("source"),
        F.expr("double(0.5) + ((l_partkey * 13 + l_suppkey * 7 + l_linenumber) % 997) / double(2011)").alias("confidence"),
        F.expr("l_suppkey % 7 <> 0").alias("format_ok"),
        F.expr("l_partkey % 6 <> 0").alias("evidence_ok"),
        F.expr("l_linenumber % 5 = 0").alias("absence"),
        F.lit("").alias("evidence"),
        F.lit("").alias("sentence"),
        F.lit(0).alias("start"),
        F.lit(0).alias("end"),
    )


_BASE = f"""{_CANDIDATES},
w AS (SELECT *, CASE WHEN source IN ('regex', 'typo_regex') THEN 'rules' ELSE source END AS fam, source IN ('local', 'api') AS model,
  CASE source WHEN 'regex' THEN 0 WHEN 'typo_regex' THEN 1 WHEN 'local' THEN 2 WHEN 'api' THEN 3 ELSE 9 END AS source_ord,
  confidence * CASE source WHEN 'regex' THEN 1.0 WHEN 'typo_regex' THEN 0.92 WHEN 'local' THEN 0.94 WHEN 'api' THEN 0.96 ELSE 0.8 END * CASE WHEN format_ok THEN 1 ELSE 0.10 END * CASE WHEN evidence_ok THEN 1 ELSE 0.25 END AS s1 FROM cand),
w2 AS (SELECT *, CASE WHEN model AND NOT evidence_ok AND NOT absence THEN least(s1, 0.12) ELSE s1 END AS s2 FROM w),
w3 AS (SELECT *, s2::DOUBLE * CASE WHEN field = 'hb' AND fam = 'rules' THEN 1.04 ELSE 1 END * CASE WHEN field = 'hf' AND model THEN 1.04 ELSE 1 END * CASE WHEN absence THEN 0.95 ELSE 1 END AS base_score FROM w2),
w4 AS (SELECT *, bool_or(evidence_ok AND NOT absence AND base_score >= 0.55) OVER (PARTITION BY doc_id, field) AS direct FROM w3),
w5 AS (SELECT *, CASE WHEN absence AND direct THEN base_score * 0.65 ELSE base_score END AS s5 FROM w4),
fams AS (SELECT doc_id, field, value, count(DISTINCT fam) FILTER (s5 >= 0.40) AS families FROM w5 GROUP BY ALL),
scored AS (SELECT w5.*, families, CASE WHEN families >= 2 THEN least(1.0, s5 + least(0.16, 0.08 * (families - 1))) ELSE s5 END AS score FROM w5 JOIN fams USING (doc_id, field, value))"""


@query(f"WITH {_BASE} SELECT doc_id, field, ord, value, source, round(base_score, 6) AS base_score, round(score, 6) AS score, families::INT AS families FROM scored")
def candidate_scores(spark, sf_dir):
    s = arbitrate.scored(line_candidates(spark, sf_dir))
    return s.select("doc_id", "field", "ord", "value", "source", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"), "families")


_DECIDED = f"""{_BASE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, source_ord, ord) AS k FROM scored),
best AS (SELECT doc_id, field, value AS top_value, score AS top, source, format_ok, evidence_ok FROM ranked WHERE k = 1),
rivals AS (SELECT r.doc_id, r.field, bool_or(r.value <> b.top_value AND r.score >= 0.25 AND r.score >= greatest(0.55, b.top - 0.12)) AND any_value(b.top) >= 0.25 AS conflict,
  array_to_string(list_sort(coalesce(list(DISTINCT r.fam) FILTER (r.value = b.top_value AND r.score >= 0.40), [])), ',') AS agreement FROM ranked r JOIN best b USING (doc_id, field) GROUP BY ALL),
decided AS (SELECT doc_id, field, CASE WHEN top >= 0.25 THEN top_value ELSE '{MISSING}' END AS value, CASE WHEN top >= 0.25 THEN source END AS selected_source,
  CASE WHEN top >= 0.25 THEN least(1.0, greatest(0.0, top - CASE WHEN conflict THEN 0.12 ELSE 0 END)) ELSE 0.0 END AS raw, conflict, format_ok, evidence_ok, CASE WHEN top >= 0.25 THEN agreement ELSE '' END AS agreement FROM best JOIN rivals USING (doc_id, field)),
labelled AS (SELECT *, round(raw, 4) AS score, CASE WHEN NOT format_ok OR NOT evidence_ok THEN 'bad' WHEN conflict THEN 'suspicious' WHEN raw >= 0.88 THEN 'good' WHEN raw >= 0.55 THEN 'suspicious' ELSE 'bad' END AS label FROM decided)"""


@query(f"WITH {_DECIDED} SELECT doc_id, field, value, selected_source, score, label, conflict, agreement FROM labelled")
def arbitrate_fields(spark, sf_dir):
    d = arbitrate.decide(arbitrate.scored(line_candidates(spark, sf_dir)))
    return d.select("doc_id", "field", "value", "selected_source", "score", "label", "conflict", "agreement")


@query(f"""WITH {_DECIDED},
agg AS (SELECT doc_id, count_if(value <> '{MISSING}') AS n, avg(score) FILTER (value <> '{MISSING}') AS mean, count_if(conflict AND value <> '{MISSING}') AS c FROM labelled GROUP BY doc_id),
fin AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, mean * (0.78::DOUBLE + 0.22::DOUBLE * (n / 13.0::DOUBLE)) - least(0.18::DOUBLE, 0.30::DOUBLE * c / greatest(n, 1)))), 4) END AS file_score FROM agg)
SELECT doc_id, n::BIGINT AS extracted_fields, c::BIGINT AS conflicts, file_score, CASE WHEN n = 0 THEN 'bad' WHEN c > 0 THEN 'suspicious' WHEN file_score >= 0.84 THEN 'good' WHEN file_score >= 0.70 THEN 'suspicious' ELSE 'bad' END AS file_label FROM fin""")
def file_scores(spark, sf_dir):
    d = arbitrate.decide(arbitrate.scored(line_candidates(spark, sf_dir)))
    return arbitrate.file_scores(d, n_fields=13).select("doc_id", "extracted_fields", "conflicts", "file_score", "file_label")


@query()
def document_file_scores(spark, sf_dir):
    """Generic pack over documents: spans, candidates, arbitration, one score a document."""
    docs = documents(spark, sf_dir)
    found = arbitrate.checked(extract.pack_candidates(docs))
    decisions = arbitrate.complete(arbitrate.decide(arbitrate.scored(found)), docs, list(GENERIC_PATTERNS))
    return arbitrate.file_scores(decisions, n_fields=len(GENERIC_PATTERNS)).select("doc_id", "extracted_fields", "direct_fields", "conflicts", "coverage", "file_score", "file_label")


def flagship(spark, sf_dir):
    return document_file_scores(spark, sf_dir)


@query()
def clinical_records(spark, sf_dir):
    """The clinical rules over documents, as wide records of 50 texts."""
    docs = documents(spark, sf_dir)
    found = arbitrate.checked(extract.clinical_candidates(docs))
    return arbitrate.wide(arbitrate.postprocessed(arbitrate.complete(arbitrate.decide(arbitrate.scored(found)), docs)))


_FLAT = f"""flat AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE 'N' END AS ca_fact, CASE WHEN o_orderkey % 4 = 0 THEN '1' ELSE '{MISSING}' END AS ca_lad,
  strftime(o_orderdate, '%d.%m.%Y') AS admission_date, strftime(o_orderdate + to_days(((o_custkey % 9) - 3)::INT), '%d.%m.%Y') AS discharge_date, (80 + o_custkey % 100)::VARCHAR || '/' || (60 + o_orderkey % 100)::VARCHAR AS bp FROM orders)"""


@query(f"""WITH {_FLAT}
SELECT doc_id, 'ca_lad' AS field, 'cag_dependent_value_without_performed_cag' AS issue FROM flat WHERE ca_fact <> 'Y' AND ca_lad <> '{MISSING}'
UNION ALL SELECT doc_id, 'discharge_date', 'discharge_before_admission' FROM flat WHERE strptime(discharge_date, '%d.%m.%Y') < strptime(admission_date, '%d.%m.%Y')
UNION ALL SELECT doc_id, 'bp', 'systolic_below_diastolic' FROM flat WHERE split_part(bp, '/', 1)::INT < split_part(bp, '/', 2)::INT""")
def cross_field_issues(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    missing = F.lit(MISSING)
    flat = o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.expr("o_orderkey % 3 = 0"), "Y").otherwise("N").alias("ca_fact"),
        F.when(F.expr("o_orderkey % 4 = 0"), "1").otherwise(MISSING).alias("ca_lad"),
        missing.alias("rca"),
        missing.alias("ca_date"),
        F.date_format(day, "dd.MM.yyyy").alias("admission_date"),
        F.date_format(F.date_add(day, F.expr("int(o_custkey % 9 - 3)")), "dd.MM.yyyy").alias("discharge_date"),
        F.concat(F.expr("string(80 + o_custkey % 100)"), F.lit("/"), F.expr("string(60 + o_orderkey % 100)")).alias("bp"),
    )
    return arbitrate.cross_issues(flat).select("doc_id", "field", "issue")


@query("""SELECT n.n_nationkey, n.n_name, r.r_name AS label FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def decode_values(spark, sf_dir):
    from ..functions.labels import decoded

    region = {str(r.r_regionkey): r.r_name for r in table(spark, sf_dir, "region").collect()}
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit("region").alias("field"), F.col("n_regionkey").cast("string").alias("value"))
    return decoded(rows, {"region": region}).select("n_nationkey", "n_name", "label")


@query("""WITH f AS (SELECT c_custkey AS doc_id, unnest([0, 0, 1, 1]) AS section, unnest([0, 1, 0, 1]) AS place, unnest(['place', 'place', 'account', 'account']) AS grp, unnest(['nation', 'killip', 'segment', 'state']) AS field,
  unnest([c_nationkey::VARCHAR, (c_custkey % 5)::VARCHAR, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END, CASE WHEN c_acctbal < 0 THEN 'Не Указано' ELSE 'paid' END]) AS raw_value FROM customer)
SELECT doc_id, section::INT AS section, place::INT AS place, upper(grp[1]) || substr(grp, 2) AS title, grp || '.' || field AS path, CASE field WHEN 'nation' THEN 'Nation' WHEN 'segment' THEN 'Segment' ELSE field END AS label,
  CASE field WHEN 'nation' THEN 'Nation: by its key' WHEN 'segment' THEN 'Segment, of the market' ELSE field END AS description, raw_value,
  CASE WHEN raw_value IS NULL OR raw_value = 'Не Указано' THEN 'не указано' WHEN field = 'nation' THEN n_name WHEN field = 'killip' THEN raw_value || ' класс' ELSE raw_value END AS value
FROM f LEFT JOIN nation ON field = 'nation' AND n_nationkey::VARCHAR = raw_value""")
def record_history(spark, sf_dir):
    """Records of customers as they are shown."""
    from ..functions.labels import history

    c = table(spark, sf_dir, "customer")
    raw = {"nation": F.col("c_nationkey").cast("string"), "killip": F.expr("string(c_custkey % 5)"), "segment": F.when(F.expr("c_custkey % 7 <> 0"), F.col("c_mktsegment")), "state": F.when(F.col("c_acctbal") < 0, "Не Указано").otherwise("paid")}
    rows = c.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in raw.items()])).alias("x")).select("doc_id", "x.*")
    nations = {str(r.n_nationkey): r.n_name for r in table(spark, sf_dir, "nation").collect()}
    return history(rows, {"place": "nation killip", "account": "segment state"}, {"nation": "Nation: by its key", "segment": "Segment, of the market"}, {"nation": nations})


# --- evaluation ------------------------------------------------------------------------------

#: References and predictions made from orders: three fields a document.
_EVAL = f"""gold AS (SELECT o_orderkey AS doc_id, unnest(['status', 'priority', 'segment']) AS field, unnest([o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN '{MISSING}' ELSE o_orderpriority END, (o_custkey % 5)::VARCHAR]) AS value FROM orders),
pred AS (SELECT o_orderkey AS doc_id, unnest(['status', 'priority', 'segment']) AS field, unnest([CASE WHEN o_custkey % 4 = 0 THEN 'F' ELSE o_orderstatus END, CASE WHEN o_orderkey % 7 = 0 THEN '{MISSING}' ELSE o_orderpriority END, (o_orderkey % 5)::VARCHAR]) AS value FROM orders WHERE o_orderkey % 10 <> 3)"""


def _eval_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    names = ("status", "priority", "segment")
    gold = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.when(F.expr("o_orderkey % 5 = 0"), MISSING).otherwise(F.col("o_orderpriority")).alias("priority"), F.expr("string(o_custkey % 5)").alias("segment"))
    pred = o.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("doc_id"), F.when(F.expr("o_custkey % 4 = 0"), "F").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.expr("o_orderkey % 7 = 0"), MISSING).otherwise(F.col("o_orderpriority")).alias("priority"), F.expr("string(o_orderkey % 5)").alias("segment"))
    return evaluate.unpivoted(pred, names), evaluate.unpivoted(gold, names)


@query(f"""WITH {_EVAL} SELECT coalesce(field, '__ALL__') AS field, count_if(g.value = p.value)::BIGINT AS correct, count(*) AS n, round(count_if(g.value = p.value) / count(*), 6) AS accuracy
FROM gold g JOIN pred p USING (doc_id, field) GROUP BY ROLLUP (field)""")
def exact_match_rollup(spark, sf_dir):
    return evaluate.exact_match(*_eval_tables(spark, sf_dir))


@query(f"""WITH {_EVAL} SELECT doc_id, round(avg((g.value = p.value)::INT), 6) AS accuracy FROM gold g JOIN pred p USING (doc_id, field) GROUP BY doc_id""")
def file_match(spark, sf_dir):
    return evaluate.file_match(*_eval_tables(spark, sf_dir))


@query(f"""WITH {_EVAL}, n AS (SELECT field, count_if(p.value <> '{MISSING}' AND g.value <> '{MISSING}')::BIGINT AS tp, count_if(p.value <> '{MISSING}' AND g.value = '{MISSING}')::BIGINT AS fp, count_if(p.value = '{MISSING}' AND g.value <> '{MISSING}')::BIGINT AS fn
  FROM gold g JOIN pred p USING (doc_id, field) GROUP BY field),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS r FROM n)
SELECT field, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m""")
def presence_prf1(spark, sf_dir):
    return evaluate.presence_scores(*_eval_tables(spark, sf_dir))


@query(f"""WITH {_EVAL} SELECT g.doc_id, g.field, g.value AS gold, p.value AS predicted FROM gold g JOIN pred p USING (doc_id, field) WHERE g.value <> p.value
UNION ALL SELECT DISTINCT doc_id, '__MISSING_FILE__', NULL, NULL FROM gold WHERE doc_id NOT IN (SELECT doc_id FROM pred)""")
def anti_missing_gold(spark, sf_dir):
    return evaluate.mismatches(*_eval_tables(spark, sf_dir))


_RUNS = f"""{_EVAL}, runs AS (SELECT 'a' AS run, * FROM gold UNION ALL SELECT 'b', * FROM pred UNION ALL SELECT 'c', doc_id, field, CASE WHEN doc_id % 2 = 0 THEN value ELSE 'x' END FROM gold)"""


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pred, gold = _eval_tables(spark, sf_dir)
    third = gold.withColumn("value", F.when(F.expr("doc_id % 2 = 0"), F.col("value")).otherwise("x"))
    named = lambda df, name: df.select(F.lit(name).alias("run"), "doc_id", "field", "value")
    return named(gold, "a").unionByName(named(pred, "b")).unionByName(named(third, "c")), gold


@query(f"""WITH {_RUNS} SELECT l.run AS "left", r.run AS "right", coalesce(l.field, '__ALL__') AS field, count(*) AS n, round(count_if(l.value = r.value) / count(*), 6) AS agreement
FROM runs l JOIN runs r ON l.doc_id = r.doc_id AND l.field = r.field AND l.run < r.run GROUP BY GROUPING SETS ((l.run, r.run, l.field), (l.run, r.run))""")
def pairwise_agreement(spark, sf_dir):
    return evaluate.pairwise_agreement(_runs(spark, sf_dir)[0])


@query(f"""WITH {_RUNS} SELECT run, coalesce(r.field, '__ALL__') AS field, count(*) AS n, round(count_if(r.value = g.value) / count(*), 6) AS accuracy
FROM runs r JOIN gold g ON r.doc_id = g.doc_id AND r.field = g.field GROUP BY GROUPING SETS ((run, r.field), (run))""")
def run_accuracy(spark, sf_dir):
    return evaluate.run_accuracy(*_runs(spark, sf_dir))


@query(f"""WITH {_EVAL} SELECT field, count(*) AS n_docs, round(avg((value <> '{MISSING}')::INT), 6) AS presence_rate, round(avg((value <> '{MISSING}' AND doc_id % 3 <> 0)::INT), 6) AS direct_rate FROM pred GROUP BY field""")
def presence_baseline(spark, sf_dir):
    pred, _ = _eval_tables(spark, sf_dir)
    return evaluate.presence_baseline(pred.withColumn("selected_source", F.when(F.expr("doc_id % 3 <> 0"), "regex")))


@query(f"""WITH {_EVAL}, base(field, rate) AS (VALUES ('status', 1.0), ('priority', 0.999), ('segment', 0.1)),
n AS (SELECT field, avg((value <> '{MISSING}' AND doc_id % 3 <> 0)::INT) AS now FROM pred GROUP BY field)
SELECT field, round(rate::DOUBLE, 4) AS train_presence, round(now, 4) AS batch_presence, round(rate::DOUBLE - now, 4) AS drop, rate >= 0.25 AND rate::DOUBLE - now >= 0.20 AS flagged FROM n JOIN base USING (field)""")
def coverage_shift(spark, sf_dir):
    pred, _ = _eval_tables(spark, sf_dir)
    pred = pred.withColumn("value", F.when(F.expr("doc_id % 3 <> 0"), F.col("value")).otherwise(MISSING))
    base = spark.createDataFrame([("status", 1.0), ("priority", 0.999), ("segment", 0.1)], "field string, presence_rate double")
    return routing.coverage_shift(pred, base)


# --- routing ---------------------------------------------------------------------------------


@query(f"""WITH {_CANDIDATES}, u AS (SELECT *, NOT absence AND format_ok AND evidence_ok AS ok, source IN ('regex', 'typo_regex') AS rules, source = 'api' AS api FROM cand),
g AS (SELECT doc_id, field, list_sort(coalesce(list(DISTINCT value) FILTER (ok AND rules), [])) AS rv, list_sort(coalesce(list(DISTINCT value) FILTER (ok AND api), [])) AS av, count_if(rules)::BIGINT AS rules_raw, count_if(rules AND ok)::BIGINT AS rules_valid, count_if(api)::BIGINT AS api_raw, count_if(api AND ok)::BIGINT AS api_valid FROM u GROUP BY doc_id, field)
SELECT doc_id, field, CASE WHEN len(rv) > 0 AND len(av) > 0 THEN CASE WHEN rv = av THEN 'agree' ELSE 'semantic_conflict' END WHEN len(av) > 0 THEN 'regex_coverage_gap' WHEN len(rv) > 0 THEN 'api_coverage_gap' ELSE 'both_missing' END AS event,
  array_to_string(rv, '|') AS rules_values, array_to_string(av, '|') AS api_values, rules_raw, rules_valid, api_raw, api_valid FROM g""")
def family_compare_events(spark, sf_dir):
    return routing.compared(line_candidates(spark, sf_dir))


@query(f"""WITH {_DECIDED} SELECT doc_id, field FROM labelled WHERE conflict OR selected_source IS NULL OR score < 0.88""")
def uncertain_fields(spark, sf_dir):
    return routing.uncertain(arbitrate.decide(arbitrate.scored(line_candidates(spark, sf_dir))))


_EVENTS = """ev AS (SELECT event_id AS doc_id, (user_id % 8)::INT AS cluster, event_type AS field, ['agree', 'regex_coverage_gap', 'semantic_conflict', 'api_coverage_gap', 'both_missing'][1 + ((event_id * 7 + user_id) % 13 % 5)] AS event FROM events)"""


def _probe_events(spark, sf_dir) -> DataFrame:
    kinds = F.array(*map(F.lit, ("agree", "regex_coverage_gap", "semantic_conflict", "api_coverage_gap", "both_missing")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.expr("int(user_id % 8)").alias("cluster"), F.col("event_type").alias("field"), F.element_at(kinds, F.expr("int(1 + (event_id * 7 + user_id) % 13 % 5)")).alias("event"))


@query(f"""WITH {_EVENTS}, g AS (SELECT cluster, field, grouping(cluster) = 1 AS whole, count(*) AS n, count_if(event = 'agree') AS a, count_if(event = 'regex_coverage_gap') AS gap, count_if(event = 'semantic_conflict') AS c, count_if(event = 'api_coverage_gap') AS api FROM ev GROUP BY GROUPING SETS ((field), (cluster, field))),
m AS (SELECT *, CASE WHEN c / n >= CASE WHEN whole THEN 0.2 ELSE 0.5 END THEN 'both_always' WHEN gap / n >= CASE WHEN whole THEN 0.3 ELSE 0.5 END THEN 'api_always' END AS mode FROM g)
SELECT CASE WHEN whole THEN 'global' ELSE 'cluster' END AS scope, cluster, field, mode, CASE WHEN whole THEN '' ELSE 'cluster_' || cluster::VARCHAR || ':' END || CASE mode WHEN 'both_always' THEN 'probe_semantic_conflict' ELSE 'probe_regex_coverage_gap' END AS reason,
  n AS observations, round(a / n, 4) AS agreement_rate, round(gap / n, 4) AS regex_gap_rate, round(c / n, 4) AS semantic_conflict_rate, round(api / n, 4) AS api_gap_rate FROM m WHERE mode IS NOT NULL AND n >= CASE WHEN whole THEN 3 ELSE 1 END""")
def policy_global_cluster(spark, sf_dir):
    return routing.probe_policy(_probe_events(spark, sf_dir))


@query("""WITH policy(scope, cluster, field, mode, reason) AS (VALUES ('global', NULL, 'a', 'api_always', 'r1'), ('global', NULL, 'b', 'both_always', 'r2'), ('cluster', 1, 'a', 'both_always', 'r3'), ('cluster', 1, 'b', 'api_always', 'r4'), ('cluster', 2, 'c', 'api_always', 'r5')),
docs AS (SELECT c_custkey AS doc_id, (c_custkey % 4)::INT AS cluster FROM customer),
j AS (SELECT d.doc_id, f.field, g.mode AS gm, g.reason AS gr, k.mode AS cm, k.reason AS cr FROM docs d CROSS JOIN (SELECT DISTINCT field FROM policy) f LEFT JOIN policy g ON g.scope = 'global' AND g.field = f.field LEFT JOIN policy k ON k.scope = 'cluster' AND k.cluster = d.cluster AND k.field = f.field WHERE g.mode IS NOT NULL OR k.mode IS NOT NULL),
s AS (SELECT *, CASE gm WHEN 'both_always' THEN 2 WHEN 'api_always' THEN 1 ELSE 0 END AS gs, CASE cm WHEN 'both_always' THEN 2 WHEN 'api_always' THEN 1 ELSE 0 END AS cs FROM j),
m AS (SELECT *, CASE WHEN cs >= gs THEN coalesce(cm, gm) ELSE gm END AS mode FROM s)
SELECT doc_id, field, mode, concat_ws(',', gr, cr) AS reasons, mode = 'both_always' AS local_always, (CASE mode WHEN 'api_always' THEN 0.015 ELSE 0.025 END)::DOUBLE AS llm_bonus FROM m""")
def policy_lookup(spark, sf_dir):
    rows = [("global", None, "a", "api_always", ["r1"]), ("global", None, "b", "both_always", ["r2"]), ("cluster", 1, "a", "both_always", ["r3"]), ("cluster", 1, "b", "api_always", ["r4"]), ("cluster", 2, "c", "api_always", ["r5"])]
    policy = spark.createDataFrame(rows, "scope string, cluster int, field string, mode string, reasons array<string>")
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr("int(c_custkey % 4)").alias("cluster"))
    return routing.policy_lookup(docs, policy).select("doc_id", "field", "mode", F.array_join("reasons", ",").alias("reasons"), "local_always", "llm_bonus")


@query("""SELECT d.doc_id, l.doc_id IS NOT NULL AS is_probe FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 5) l USING (doc_id)""")
def semi_probe(spark, sf_dir):
    probes = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(0).alias("probe_order")).orderBy("doc_id").limit(5)  # a batch has five probes
    return routing.processing_order(documents(spark, sf_dir), probes).select("doc_id", "is_probe")


# --- batch similarity ------------------------------------------------------------------------

_TOK = "[a-zà-ÿ]{2,}"
_TERMS = f"terms AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{_TOK}'))) AS term FROM documents)"


def _lower(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))


@query(f"WITH {_TERMS} SELECT term, count(*) AS df, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM terms GROUP BY term")
def document_frequency(spark, sf_dir):
    return similarity.document_frequency(_lower(spark, sf_dir), _TOK)


@query(f"""WITH {_TERMS}, f AS (SELECT term, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM terms GROUP BY term)
SELECT term FROM f WHERE share >= 0.3 UNION SELECT unnest({sorted(similarity.STOPWORDS)}) EXCEPT SELECT unnest({sorted(similarity.PROTECTED)})""")
def auto_stopwords(spark, sf_dir):
    return similarity.stopwords(similarity.document_frequency(_lower(spark, sf_dir), _TOK), share=0.3)


_TFIDF = f"""counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM documents) GROUP BY doc_id, term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(*) FROM documents)),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM counts JOIN idf USING (term)),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"""


def _weights(spark, sf_dir) -> DataFrame:
    texts = _lower(spark, sf_dir)
    return similarity.tfidf(similarity.term_counts(texts, ngrams=1, pattern=_TOK), texts.agg(F.count("*").alias("n")))


@query(f"WITH {_TFIDF} SELECT doc_id, term, round(w, 6) AS w FROM weights")
def tfidf_sublinear(spark, sf_dir):
    return _weights(spark, sf_dir).select("doc_id", "term", F.round("w", 6).alias("w"))


@query(f"""WITH {_TFIDF}, c AS (SELECT doc_id, quality::INT AS cluster FROM labels), size AS (SELECT cluster, count(*) AS size FROM c GROUP BY cluster),
m AS (SELECT cluster, term, round(sum(w) / any_value(size), 6) AS mean_w FROM weights JOIN c USING (doc_id) JOIN size USING (cluster) GROUP BY cluster, term),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean_w DESC, term) AS rank FROM m WHERE mean_w > 0) SELECT cluster, rank::INT AS rank, term, mean_w FROM r WHERE rank <= 20""")
def cluster_top_terms(spark, sf_dir):
    clusters = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("cluster"))
    return similarity.cluster_top_terms(_weights(spark, sf_dir), clusters)


_MASK_FIELDS = ("email", "card", "license", "url", "pipe")
_MASKS = """masks AS (SELECT doc_id, (CASE WHEN contains(text, '@') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]{16}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 4 ELSE 0 END + CASE WHEN contains(text, 'http') THEN 8 ELSE 0 END + CASE WHEN contains(text, '|') THEN 16 ELSE 0 END)::BIGINT AS mask FROM documents)"""


def _masks(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    hits = (t.contains("@"), t.rlike("[0-9]{16}"), F.lower(t).contains("license"), t.contains("http"), t.contains("|"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.when(h, "1").otherwise(MISSING).alias("value")) for f, h in zip(_MASK_FIELDS, hits, strict=True)])
    long = documents(spark, sf_dir).select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")
    return similarity.presence_masks(long, _MASK_FIELDS)


@query(f"WITH {_MASKS} SELECT doc_id, mask, bit_count(mask)::BIGINT AS present FROM masks")
def presence_mask(spark, sf_dir):
    return _masks(spark, sf_dir)


@query(f"WITH {_MASKS} SELECT a.doc_id AS a, b.doc_id AS b, round(CASE WHEN (a.mask | b.mask) = 0 THEN 0 ELSE bit_count(xor(a.mask, b.mask)) / bit_count(a.mask | b.mask) END, 6) AS distance FROM masks a JOIN masks b ON b.doc_id = a.doc_id + 1")
def mask_distance(spark, sf_dir):
    m = _masks(spark, sf_dir)
    a, b = m.select(F.col("doc_id").alias("a"), F.col("mask").alias("x"), (F.col("doc_id") + 1).alias("b")), m.select(F.col("doc_id").alias("b"), F.col("mask").alias("y"))
    return a.join(b, "b").select("a", "b", F.round(similarity.mask_distance(F.col("x"), F.col("y")), 6).alias("distance"))


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"


@query(f"""WITH {_UNIT}, d AS (SELECT a.label AS cluster, a.vec_id, round(sum((1 - list_dot_product(a.v, b.v)) / 2) / greatest(1, count(*)), 6) AS mean_distance FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label, a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean_distance, vec_id) AS k FROM d) SELECT cluster::INT AS cluster, vec_id AS doc_id, mean_distance FROM r WHERE k = 1""")
def medoid_by_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("int").alias("cluster"), similarity.unit(F.col("embedding")).alias("vector"))
    return similarity.centroid_medoids(e)


@query(f"""WITH {_UNIT} SELECT a.vec_id AS a, b.vec_id AS b, round((1 - list_dot_product(a.v, b.v)) / 2, 6) AS semantic, round(0.65 * (1 - list_dot_product(a.v, b.v)) / 2 + 0.35 * (CASE WHEN a.label = b.label THEN 0 ELSE 1 END), 6) AS combined FROM u a JOIN u b ON b.vec_id = a.vec_id + 1""")
def semantic_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", similarity.unit(F.col("embedding")).alias("v"))
    a, b = e.toDF("a", "la", "va").withColumn("b", F.col("a") + 1), e.toDF("b", "lb", "vb")
    s = similarity.semantic_distance(F.col("va"), F.col("vb"))
    mask = F.when(F.col("la") == F.col("lb"), 0.0).otherwise(1.0)
    return a.join(b, "b").select("a", "b", F.round(s, 6).alias("semantic"), F.round(similarity.combined_distance(s, mask), 6).alias("combined"))


_SUPPLIER_WEIGHTS = {"nation": 3.0, "balance": 2.0, "band": 1.0}
_PROFILE = """vals AS (SELECT s_suppkey AS doc_id, unnest(['nation', 'balance', 'band']) AS field, unnest([s_nationkey::VARCHAR, CASE WHEN s_acctbal >= 0 THEN floor(s_acctbal / 1000)::INT::VARCHAR END, (s_suppkey % 7)::VARCHAR]) AS value FROM supplier),
known AS (SELECT *, CASE field WHEN 'nation' THEN 3.0 WHEN 'balance' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM vals WHERE value IS NOT NULL)"""
_NEAR = f"""{_PROFILE},
p AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.w) FILTER (a.value = b.value) AS matched, sum(a.w) AS shared FROM known a JOIN known b ON a.field = b.field AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
s AS (SELECT i AS doc_id, j AS neighbour, round(matched / shared, 6) AS similarity, shared AS shared_weight FROM p WHERE shared >= 3.0 AND round(matched / shared, 6) >= 0.72),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, neighbour) AS rank FROM s) WHERE rank <= 12)"""


def _profiles(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    wide = s.select(F.col("s_suppkey").alias("doc_id"), F.col("s_nationkey").cast("string").alias("nation"), F.when(F.col("s_acctbal") >= 0, F.floor(F.col("s_acctbal") / 1000).cast("string")).alias("balance"), F.expr("string(s_suppkey % 7)").alias("band"))
    return wide.unpivot("doc_id", ["nation", "balance", "band"], "field", "value").where("value IS NOT NULL")


@query(f"WITH {_NEAR} SELECT doc_id, rank::INT AS rank, neighbour, similarity, round(shared_weight, 6) AS shared_weight FROM near")
def clinical_self_join(spark, sf_dir):
    return similarity.clinical_neighbours(_profiles(spark, sf_dir), _SUPPLIER_WEIGHTS)


@query(f"""WITH {_NEAR}, cl AS (SELECT s_suppkey AS doc_id, (s_suppkey % 5 - 1)::INT AS cluster FROM supplier), mem AS (SELECT * FROM cl WHERE cluster >= 0),
cv AS (SELECT a.doc_id, v.field, v.value, count(*) AS n FROM mem a JOIN mem b ON a.cluster = b.cluster AND a.doc_id <> b.doc_id JOIN known v ON v.doc_id = b.doc_id GROUP BY ALL),
pc AS (SELECT doc_id, field, value, n / sum(n) OVER (PARTITION BY doc_id, field) AS pc FROM cv),
nv AS (SELECT n.doc_id, v.field, v.value, sum(similarity) AS s FROM near n JOIN known v ON v.doc_id = n.neighbour GROUP BY ALL),
pn AS (SELECT doc_id, field, value, s / sum(s) OVER (PARTITION BY doc_id, field) AS pn FROM nv),
f AS (SELECT * FROM pc FULL JOIN pn USING (doc_id, field, value))
SELECT doc_id, field, value, round((coalesce(pc, 0) * 0.55 + coalesce(pn, 0) * 0.45) / (CASE WHEN max(pc) OVER w IS NOT NULL THEN 0.55 ELSE 0.0 END + CASE WHEN max(pn) OVER w IS NOT NULL THEN 0.45 ELSE 0.0 END)::DOUBLE, 6) AS support FROM f WINDOW w AS (PARTITION BY doc_id, field)""")
def peer_priors(spark, sf_dir):
    values = _profiles(spark, sf_dir)
    clusters = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.expr("int(s_suppkey % 5 - 1)").alias("cluster"))
    return similarity.peer_priors(values, clusters, similarity.clinical_neighbours(values, _SUPPLIER_WEIGHTS))


_HAS = f"""has AS (SELECT s_suppkey AS doc_id, unnest(['nation', 'balance', 'band']) AS field, unnest([1.0, CASE WHEN s_acctbal >= 0 THEN 1.0 ELSE 0.0 END, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 ELSE 0.0 END]) AS h, (s_suppkey % 5 - 1)::INT AS cluster FROM supplier),
per AS (SELECT cluster, field, sum(h) AS s, count(*) AS n FROM has WHERE cluster >= 0 GROUP BY ALL),
cons AS (SELECT doc_id, (n - 1) AS peers, round(avg(CASE WHEN h > 0 THEN (s - h) / (n - 1) ELSE 1 - (s - h) / (n - 1) END), 4) AS consistency FROM has JOIN per USING (cluster, field) WHERE n >= 3 GROUP BY doc_id, n)"""


def _consistency(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    wide = s.select(F.col("s_suppkey").alias("doc_id"), F.lit("1").alias("nation"), F.when(F.col("s_acctbal") >= 0, "1").otherwise(MISSING).alias("balance"), F.when(F.expr("s_suppkey % 3 = 0"), "1").otherwise(MISSING).alias("band"))
    long = wide.unpivot("doc_id", ["nation", "balance", "band"], "field", "value")
    clusters = s.select(F.col("s_suppkey").alias("doc_id"), F.expr("int(s_suppkey % 5 - 1)").alias("cluster"))
    return similarity.cluster_consistency(long, clusters, ("nation", "balance", "band"))


@query(f"WITH {_HAS} SELECT doc_id, peers::BIGINT AS peers, consistency FROM cons")
def presence_consistency(spark, sf_dir):
    return _consistency(spark, sf_dir)


@query(f"""WITH {_HAS}, a AS (SELECT doc_id, 0.5::DOUBLE + (doc_id % 50) / 100 AS base, consistency AS cc FROM cons),
m AS (SELECT *, least(0.0::DOUBLE, greatest((-0.05)::DOUBLE, 0.02::DOUBLE * CASE WHEN cc >= 0.85 THEN least(1.0::DOUBLE, (cc - 0.85::DOUBLE) / 0.15) ELSE greatest((-1.0)::DOUBLE, (cc - 0.85::DOUBLE) / 0.85) END)) AS move FROM a)
SELECT doc_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, base + move)), 4) AS score FROM m""")
def score_adjust(spark, sf_dir):
    c = _consistency(spark, sf_dir).withColumn("base", F.expr("double(0.5 + (doc_id % 50) / 100)"))
    none = F.lit(None).cast("double")
    return c.select("doc_id", similarity.adjusted_score(F.col("base"), F.col("consistency"), F.lit(0.8), none).alias("score"))


@query()
def svd_vectors(spark, sf_dir):
    """All documents as vectors of the decomposition, rounded: 10,000 terms of one or two words, 30 dimensions."""
    texts = _lower(spark, sf_dir)
    counts = similarity.term_counts(texts, similarity.stopwords(similarity.document_frequency(texts)))
    n = documents(spark, sf_dir).agg(F.count("*").alias("n"))
    known = similarity.vocabulary(counts, n, max_features=10_000).collect()
    idf = F.broadcast(spark.createDataFrame(known, "term string, idf double"))
    v = similarity.svd_vectors(similarity.weighted(counts, idf), ids=texts.select("doc_id"), terms=[r.term for r in known])
    return v.select("doc_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query()
def hdbscan_clusters(spark, sf_dir):
    """Density clusters of the suppliers, as one batch, by balance and nation."""
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.array(F.col("s_acctbal").cast("double") / 1000, F.col("s_nationkey").cast("double")).alias("vector"))
    return similarity.clustered(c)


# --- personal data ---------------------------------------------------------------------------


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {k}" for k, p in anonymize.COUNTED) + " FROM documents")
def pii_counts(spark, sf_dir):
    return anonymize.counts(documents(spark, sf_dir))


@query()
def pii_redacted(spark, sf_dir):
    out = anonymize.anonymize(documents(spark, sf_dir))
    return out.select("doc_id", "redacted", F.size("spans").alias("n_spans"), "safe", "input_sha256", "output_sha256")


@query()
def pii_spans(spark, sf_dir):
    return anonymize.anonymize(documents(spark, sf_dir), "strict").select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


@query("""WITH s AS (SELECT l_suppkey AS doc_id, (l_orderkey * 10)::INT AS "start", (l_orderkey * 10 + l_quantity)::INT AS "end" FROM lineitem),
m AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT doc_id, min("start") AS "start", max("end") AS "end", count(*) AS parts FROM i GROUP BY doc_id, island""")
def merged_spans(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.expr("int(l_orderkey * 10)").alias("start"), F.expr("int(l_orderkey * 10 + l_quantity)").alias("end"))
    return anonymize.merged_islands(spans)


# --- sources ---------------------------------------------------------------------------------


@query("""SELECT conv_id || '-' || turn AS doc_id, text, CASE WHEN text IS NULL THEN 'not a document line' END AS error FROM conversations""")
def worker_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")).alias("value"))
    return parse_lines(c).select("doc_id", "text", "error")


@query("""SELECT conv_id, string_agg('{"role":"' || role || '","n":' || length(text)::VARCHAR || '}', ',' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id""")
def chat_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    m = c.select("conv_id", F.struct("turn", F.to_json(F.struct("role", F.length("text").alias("n"))).alias("m")).alias("x"))
    return m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.m), ",").alias("messages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
