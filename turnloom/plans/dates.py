"""Queries of the date functions, over every note."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnloom.functions import dates as fn
from turnloom.functions import text
from turnloom.plans import views as v
from turnloom.plans.catalog import query

_M = fn.MONTH
_NUMBERED = "CASE lower(m) " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in fn.MONTH_OF.items()) + " END"
_ABS = f"""SELECT note_id, coalesce(iso, mdy, dmy, my) AS epoch FROM (SELECT note_id,
  epoch(try_strptime(nullif(regexp_extract(body, '(?:^|[^0-9])([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})', 1), ''), '%Y-%m-%d')) AS iso,
  epoch(try_strptime(regexp_extract(body, '(?i)\\b({_M})\\.?[-\\s]+[0-9]{{1,2}}(?:st|nd|rd|th)?,?[-\\s]+[0-9]{{4}}\\b', 1) || ' ' ||
    regexp_extract(body, '(?i)\\b(?:{_M})\\.?[-\\s]+([0-9]{{1,2}})(?:st|nd|rd|th)?,?[-\\s]+[0-9]{{4}}\\b', 1) || ' ' ||
    regexp_extract(body, '(?i)\\b(?:{_M})\\.?[-\\s]+[0-9]{{1,2}}(?:st|nd|rd|th)?,?[-\\s]+([0-9]{{4}})\\b', 1), '%B %d %Y')) AS mdy,
  epoch(try_strptime(regexp_extract(body, '(?i)\\b([0-9]{{1,2}})(?:st|nd|rd|th)?\\s+(?:{_M})\\.?,?\\s+[0-9]{{4}}\\b', 1) || ' ' ||
    regexp_extract(body, '(?i)\\b[0-9]{{1,2}}(?:st|nd|rd|th)?\\s+({_M})\\.?,?\\s+[0-9]{{4}}\\b', 1) || ' ' ||
    regexp_extract(body, '(?i)\\b[0-9]{{1,2}}(?:st|nd|rd|th)?\\s+(?:{_M})\\.?,?\\s+([0-9]{{4}})\\b', 1), '%d %B %Y')) AS dmy,
  epoch(try_strptime(regexp_extract(body, '(?i)\\b({_M})\\.?,?\\s+[0-9]{{4}}\\b', 1) || ' 1 ' ||
    regexp_extract(body, '(?i)\\b(?:{_M})\\.?,?\\s+([0-9]{{4}})\\b', 1), '%B %d %Y')) AS my FROM notes)"""


@query("parse_absolute", v.sql(_ABS, "notes"))
def parse_absolute(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", fn.parse_absolute(F.col("body"))["epoch"].alias("epoch"))


@query("shift_months", v.sql("SELECT note_id, epoch(to_timestamp(said_at)::TIMESTAMP - to_months((note_id % 30)::INT)) AS earlier FROM notes", "notes"))
def shift_months(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", fn.shift(F.col("said_at"), (F.col("note_id") % 30).cast("int")).alias("earlier"))


@query("parse_relative")
def parse_relative(spark, sf_dir):
    hit = fn.parse_relative(F.col("body"), F.col("said_at"))
    return v.notes(spark, sf_dir).select("note_id", hit.alias("t")).select("note_id", "t.epoch", "t.label")


@query("month_day")
def month_day(spark, sf_dir):
    hit = fn.month_day(F.col("body"), F.col("said_at"))
    return v.notes(spark, sf_dir).select("note_id", hit.alias("t")).select("note_id", "t.epoch", "t.label")


@query("extract_time")
def extract_time(spark, sf_dir):
    hit = fn.extract_time(F.col("body"), F.col("said_at"))
    return v.notes(spark, sf_dir).select("note_id", hit.alias("t")).select("note_id", "t.*")


@query("resolve_phrases")
def resolve_phrases(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", F.array_join(fn.resolve_phrases(F.col("body"), F.col("said_at")), "; ").alias("notes"))


_DAY = """SELECT note_id, phrase, epoch FROM (
  SELECT note_id, regexp_extract(body, '(?i)yesterday|tomorrow|3 days ago|last Friday', 0) AS phrase,
  (said_at // 86400 * 86400 + CASE lower(regexp_extract(body, '(?i)yesterday|tomorrow|3 days ago|last Friday', 0))
    WHEN 'yesterday' THEN -86400 WHEN 'tomorrow' THEN 86400 WHEN '3 days ago' THEN -259200
    ELSE -86400 * CASE WHEN (isodow(to_timestamp(said_at)::TIMESTAMP) - 5 + 7) % 7 = 0 THEN 7 ELSE (isodow(to_timestamp(said_at)::TIMESTAMP) - 5 + 7) % 7 END END)::DOUBLE AS epoch
  FROM notes) WHERE phrase <> ''"""


@query("day_phrases", v.sql(_DAY, "notes"))
def day_phrases(spark, sf_dir):
    found = F.explode(fn.day_phrases(F.col("body"), F.col("said_at"))).alias("p")
    return v.notes(spark, sf_dir).select("note_id", found).select("note_id", "p.phrase", "p.epoch")


def mentions(notes):
    """note_id, clause, epoch of every dated clause of eight or more characters."""
    clauses = notes.select("note_id", "said_at", F.explode(text.clauses(F.col("body"))).alias("c")).withColumn("clause", F.trim("c"))
    days = F.transform(fn.day_phrases(F.col("clause"), F.col("said_at")), lambda x: x["epoch"])
    both = F.concat(fn.explicit_dates(F.col("clause"), F.col("said_at")), days)
    return clauses.where(F.length("clause") >= 8).select("note_id", "clause", F.explode(both).alias("epoch"))


@query("date_mentions")
def date_mentions(spark, sf_dir):
    return mentions(v.notes(spark, sf_dir))


@query("fact_cards")
def fact_cards(spark, sf_dir):
    """Up to four dated sentences of every note, the date first, 260 characters at most."""
    n = v.notes(spark, sf_dir).select("note_id", "said_at", F.posexplode(text.sentences(F.col("body"))).alias("i", "body"))
    dated = mentions(n.withColumn("note_id", F.struct("note_id", "i")))
    grouped = dated.groupBy("note_id").agg(F.countDistinct("epoch").alias("k"), F.array_sort(F.collect_list(F.struct("epoch", "clause"))).alias("m"))
    rows = grouped.join(n.select(F.struct("note_id", "i").alias("note_id"), "body"), "note_id")
    one = F.array(F.struct(F.col("m")[0]["epoch"].alias("epoch"), F.col("body").alias("clause")))
    cards = rows.select("note_id.*", F.explode(F.when(F.col("k") == 1, one).otherwise(F.col("m"))).alias("x"))
    flat = F.regexp_replace(F.trim(F.regexp_replace("x.clause", r"\s+", " ")), r"(?i)^(?:and|but|while)\s+", "")
    card = F.concat(F.date_format(F.timestamp_seconds("x.epoch"), "d MMMM yyyy"), F.lit(": "), F.regexp_replace(flat, "[.!?]+$", ""))
    cut = F.when(F.length(card) <= 260, card).otherwise(F.concat(F.rtrim(F.left(card, F.lit(259))), F.lit("…")))
    ranked = cards.select("note_id", "i", cut.alias("card")).groupBy("note_id", "card").agg(F.min("i").alias("i"))
    w = F.row_number().over(Window.partitionBy("note_id").orderBy("i", "card"))
    return ranked.withColumn("k", w.cast("long")).where("k <= 4").select("note_id", "k", "card")


_PAIRS = "SELECT o_orderkey, epoch(o_orderdate) AS a, epoch(o_orderdate + to_days((o_orderkey * 7 % 900)::INT)) AS b FROM orders"
_GAPS = f"""SELECT o_orderkey, days || ' days' || CASE WHEN days >= 7 THEN '; ' || days // 7 || ' week' || CASE WHEN days // 7 <> 1 THEN 's' ELSE '' END ||
    CASE WHEN days % 7 > 0 THEN ' ' || days % 7 || ' day' || CASE WHEN days % 7 <> 1 THEN 's' ELSE '' END ELSE '' END ELSE '' END ||
  '; ' || m || ' month' || CASE WHEN m <> 1 THEN 's' ELSE '' END || ' ' || r || ' day' || CASE WHEN r <> 1 THEN 's' ELSE '' END AS gap
FROM (SELECT o_orderkey, date_diff('day', a, b) AS days, m, date_diff('day', (a + to_months(m::INT))::DATE, b) AS r
  FROM (SELECT o_orderkey, a, b, (year(b) - year(a)) * 12 + month(b) - month(a)
      - CASE WHEN day(b) < least(day(a), day(last_day(b))) THEN 1 ELSE 0 END AS m
    FROM (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate + to_days((o_orderkey * 7 % 900)::INT))::DATE AS b FROM orders)))"""


def _pairs(spark, sf_dir):
    a = F.unix_timestamp("o_orderdate").cast("double")
    return v.table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), (a + F.col("o_orderkey") * 7 % 900 * 86400).alias("b"))


@query("day_gaps", _GAPS)
def day_gaps(spark, sf_dir):
    return _pairs(spark, sf_dir).select("o_orderkey", fn.describe_gap(F.col("a"), F.col("b")).alias("gap"))


_SPAN = """SELECT o_orderkey, days || ' day' || CASE WHEN days <> 1 THEN 's' ELSE '' END || CASE WHEN parts <> '' THEN ' (' || parts || ')' ELSE '' END AS gap
FROM (SELECT o_orderkey, days, concat_ws(', ',
    CASE WHEN days >= 14 THEN CASE WHEN days % 7 = 0 THEN '' ELSE 'about ' END || days // 7 || ' weeks' END,
    CASE WHEN m >= 2 THEN m || ' months' END,
    CASE WHEN m >= 12 THEN m // 12 || ' year' || CASE WHEN m >= 24 THEN 's' ELSE '' END END) AS parts
  FROM (SELECT o_orderkey, date_diff('day', a, b) AS days, (year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END AS m
    FROM (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate + to_days((o_orderkey * 7 % 900)::INT))::DATE AS b FROM orders)))"""


@query("gap_span", _SPAN)
def gap_span(spark, sf_dir):
    return _pairs(spark, sf_dir).select("o_orderkey", fn.span(F.col("a"), F.col("b")).alias("gap"))
