"""Smaller operators: chats split at their last turn, inline markup, training queries, half precision, ANN with an index built by iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.functions import vec
from vecloom.plans.registry import query, usable
from vecloom.sources import table, views

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL AND starts_with(source, 'chat/'))"


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


@query(f"""WITH {LINES}, s AS (SELECT doc_id, max(line) FILTER (WHERE starts_with(body, 'user:') OR starts_with(body, '> ') OR starts_with(body, 'Q:')) AS split, max(line) + 1 AS lines FROM l GROUP BY doc_id)
  SELECT doc_id, CAST(split AS INTEGER) AS split, CAST(lines AS INTEGER) AS lines FROM s WHERE split IS NOT NULL""")
def last_user_turn(spark: SparkSession, d: str) -> DataFrame:
    """The line at which a chat's last user turn begins: what precedes it is the prefix. Chats without one are left out."""
    docs = table(spark, d, "documents").where(F.col("source").startswith("chat/") & F.col("text").isNotNull())
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    user = F.col("body").startswith("user:") | F.col("body").startswith("> ") | F.col("body").startswith("Q:")
    return lines.groupBy("doc_id").agg(F.max(F.when(user, F.col("line"))).alias("split"), (F.max("line") + 1).alias("lines")).where("split is not null")


# What stands for code, bold and a link in running text, and the markup that it becomes ($1, $2: groups).
MARKUP = [
    ("`([^`]+)`", "<code>$1</code>"),
    (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"),
    (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'),
]


def _marked_sql(text: str) -> str:
    for pattern, made in MARKUP:
        text = f"regexp_replace({text}, '{pattern}', '{made.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return text


@query(f"SELECT doc_id, length(html) AS chars, length(html) - length(replace(html, '<code>', '')) AS code FROM (SELECT doc_id, {_marked_sql('text')} AS html FROM documents WHERE text IS NOT NULL)")
def inline_markup(spark: SparkSession, d: str) -> DataFrame:
    """Texts with code, bold and links as HTML: their length and how much of it are code tags."""
    html = F.col("text")
    for pattern, made in MARKUP:
        html = F.regexp_replace(html, pattern, made)
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", html.alias("html"))
    return rows.select("doc_id", F.length("html").cast("bigint").alias("chars"), (F.length("html") - F.length(F.replace("html", F.lit("<code>"), F.lit("")))).cast("bigint").alias("code"))


WINDOW, SPAN = 8, 256


@query(f"""WITH r AS (SELECT q_row, session_id, layer, q_head, step, CAST(q AS DOUBLE[]) AS q, row_number() OVER (PARTITION BY session_id, layer, q_head ORDER BY step DESC, q_row) AS back FROM decode_rows WHERE {usable('q')}),
  w AS (SELECT *, CAST(('0x' || left(md5(session_id || '-' || layer || '-' || step), 2)) AS INTEGER) + {WINDOW} - step AS delta FROM r WHERE back <= {WINDOW}),
  p AS (SELECT q_row, delta, i, q[i + 1] AS a, q[i + 17] AS b, delta / pow(10000.0, i / 16.0) AS t FROM w, (SELECT unnest(range(16)) AS i))
  SELECT q_row, CAST(any_value(delta) AS BIGINT) AS delta, round(sum(a * cos(t) - b * sin(t)), 5) + 0.0 AS first, round(sum(a * sin(t) + b * cos(t)), 5) + 0.0 AS second FROM p GROUP BY q_row""")
def projection_queries(spark: SparkSession, d: str) -> DataFrame:
    """Training queries of an index: the last steps of every head, rotated to a target shared by the heads of a step.

    The target is the window's end plus a hash of session, layer and step in place of a random draw.
    """
    rows = table(spark, d, "decode_rows").where(views.usable(F.col("q")))
    back = F.row_number().over(Window.partitionBy("session_id", "layer", "q_head").orderBy(F.desc("step"), "q_row"))
    last = rows.withColumn("back", back).where(F.col("back") <= WINDOW)
    draw = F.conv(F.left(F.md5(F.concat_ws("-", "session_id", "layer", "step").cast("binary")), F.lit(2)), 16, 10).cast("bigint")
    last = last.withColumn("delta", draw + WINDOW - F.col("step"))
    moved = vec.rope_shift(F.col("q"), F.col("delta"), vec.rope_inv_freq(views.KEY_DIM))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = last.select("q_row", "delta", moved.alias("v"))
    return out.select("q_row", "delta", _r(total(F.slice("v", 1, 16)), 5).alias("first"), _r(total(F.slice("v", 17, 16)), 5).alias("second"))


@query("""WITH t AS (SELECT row_id, gen_seconds AS x, CASE WHEN gen_seconds = 0 THEN 1.0 ELSE pow(2.0, floor(log2(CASE WHEN gen_seconds = 0 THEN 1.0 ELSE abs(gen_seconds) END)) - 7) END AS ulp FROM eval_rows WHERE gen_seconds IS NOT NULL AND NOT isnan(gen_seconds) AND NOT isinf(gen_seconds))
  SELECT row_id, round_even(x / ulp, 0) * ulp AS half FROM t""")
def half_precision(spark: SparkSession, d: str) -> DataFrame:
    """Times rounded to the 8 bits of significand of bfloat16, half to even."""
    x = F.col("gen_seconds")
    rows = table(spark, d, "eval_rows").where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ulp = F.when(x == 0, 1.0).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))).cast("double") - 7))
    return rows.select("row_id", (F.bround(x / ulp, 0) * ulp).alias("half"))
