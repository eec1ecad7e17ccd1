"""Scores of generated answers, and corpora built from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import text as tx
from vecloom.operators import corpus
from vecloom.plans.registry import query
from vecloom.sources import table


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """eval_rows with the normalised answer and label, g and l, and their words, gt and lt."""
    rows = table(spark, d, "eval_rows").select("row_id", "bucket", "idx", "config", "gen_tokens", "gen_seconds", "retrieval_seconds", tx.normalized(F.col("gen")).alias("g"), tx.normalized(F.col("label")).alias("l"))
    return rows.withColumn("gt", tx.tokens(F.col("g"))).withColumn("lt", tx.tokens(F.col("l")))


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(nfc_normalize({c})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"list_filter(string_split(coalesce({c}, ''), ' '), lambda x: x <> '')"


NORM = f"""n AS (SELECT *, {_norm('gen')} AS g, {_norm('label')} AS l FROM eval_rows), t AS (SELECT *, {_words('g')} AS gt, {_words('l')} AS lt FROM n)"""


def _f1(g: str, r: str, common: str) -> str:
    return f"CASE WHEN len({g}) = 0 OR len({r}) = 0 THEN CASE WHEN len({g}) = 0 AND len({r}) = 0 THEN 1.0 ELSE 0.0 END WHEN {common} = 0 THEN 0.0 ELSE 2.0 * {common} / (len({g}) + len({r})) END"


def _common(g: str, r: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({r}), lambda w: least(len(list_filter({g}, lambda x: x = w)), len(list_filter({r}, lambda x: x = w))))), 0)"


CONTAIN = "CASE WHEN coalesce(length(l), 0) = 0 THEN 0.0 WHEN contains(g, l) THEN 1.0 ELSE 0.0 END"


@query(f"WITH {NORM} SELECT row_id, g AS norm FROM n")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("row_id", F.col("g").alias("norm"))


@query(f"WITH {NORM} SELECT row_id, CAST({CONTAIN} AS DOUBLE) AS containment FROM n")
def containment(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("row_id", tx.containment(F.col("g"), F.col("l")).alias("containment"))


@query(f"WITH {NORM} SELECT row_id, round(CAST({_f1('gt', 'lt', _common('gt', 'lt'))} AS DOUBLE), 6) AS token_f1 FROM t")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("row_id", _r(tx.token_f1(F.col("gt"), F.col("lt"))).alias("token_f1"))


#: Length of the longest common subsequence: one row of the table per word of the answer, folded; a row is the running
#: maximum of what each place can reach.
_BITS = "list_transform(gt, lambda t: list_transform(lt, lambda x: CASE WHEN x = t THEN 1 ELSE 0 END))"
_CAND = "list_transform(range(1, len(b) + 1), lambda k: CASE WHEN b[k] = 1 THEN coalesce(p[k - 1], 0) + 1 ELSE p[k] END)"
LCS = f"""list_reduce(list_prepend(list_transform(lt, lambda x: 0), {_BITS}), lambda p, b: list_transform(range(1, len(b) + 1), lambda j: CAST(list_max(({_CAND})[1:j]) AS INTEGER)))[-1]"""


@query(f"WITH {NORM}, c AS (SELECT *, coalesce({LCS}, 0) AS lcs FROM t) SELECT row_id, round(CAST({_f1('gt', 'lt', 'lcs')} AS DOUBLE), 6) AS rouge_l FROM c")
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("row_id", _r(tx.rouge_l(F.col("gt"), F.col("lt"))).alias("rouge_l"))


def _valid(c: str) -> Column:
    x = F.col(c)
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < F.lit(float("inf"))), x)


def _valid_sql(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) AND NOT isinf({c}) AND {c} >= 0 THEN {c} END"


@query(f"""WITH {NORM} SELECT bucket, config, count(*) AS n, round(avg({CONTAIN}), 6) AS containment, round(avg({_f1('gt', 'lt', _common('gt', 'lt'))}), 6) AS token_f1,
  round(1000 * coalesce(sum({_valid_sql('gen_seconds')}), 0) / greatest(coalesce(sum(gen_tokens), 0), 1), 3) AS ms_per_token, round(1000 * coalesce(sum({_valid_sql('retrieval_seconds')}), 0) / greatest(coalesce(sum(gen_tokens), 0), 1), 3) AS retrieval_ms FROM t GROUP BY bucket, config""")
def eval_table(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores and time per token by bucket and config; times that are no numbers or negative don't count."""
    tok = F.greatest(F.coalesce(F.sum("gen_tokens"), F.lit(0)), F.lit(1))
    return _rows(spark, d).groupBy("bucket", "config").agg(
        F.count("*").alias("n"), _r(F.avg(tx.containment(F.col("g"), F.col("l")))).alias("containment"), _r(F.avg(tx.token_f1(F.col("gt"), F.col("lt")))).alias("token_f1"),
        _r(1000 * F.coalesce(F.sum(_valid("gen_seconds")), F.lit(0.0)) / tok, 3).alias("ms_per_token"), _r(1000 * F.coalesce(F.sum(_valid("retrieval_seconds")), F.lit(0.0)) / tok, 3).alias("retrieval_ms"),
    )


@query(f"""WITH {NORM}, m AS (SELECT *, CASE WHEN config IN ('topk', 'exact') THEN 'full' WHEN config LIKE 'hnsw%' THEN 'exact' END AS ref FROM t),
  f AS (SELECT bucket, idx, config, arg_min(gt, row_id) AS rt FROM t WHERE gen IS NOT NULL GROUP BY ALL)
  SELECT m.config, count(*) AS n, round(avg({_f1('gt', 'rt', _common('gt', 'rt'))}), 6) AS agreement FROM m JOIN f ON m.bucket = f.bucket AND m.idx = f.idx AND m.ref = f.config GROUP BY m.config""")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    """Token F1 of an answer against the same question's answer by the config that it is held against."""
    rows = _rows(spark, d)
    ref = F.when(F.col("config").isin("topk", "exact"), "full").when(F.col("config").startswith("hnsw"), "exact")
    first = rows.where(F.col("g").isNotNull()).groupBy("bucket", "idx", F.col("config").alias("ref")).agg(F.min_by("gt", "row_id").alias("rt"))
    both = rows.withColumn("ref", ref).join(first, ["bucket", "idx", "ref"])
    return both.groupBy("config").agg(F.count("*").alias("n"), _r(F.avg(tx.token_f1(F.col("gt"), F.col("rt")))).alias("agreement"))


@query(f"""WITH f AS (SELECT source AS tier, text, unnest(regexp_extract_all(text, '{corpus.CODE}')) AS code FROM documents WHERE text IS NOT NULL), w AS (SELECT DISTINCT code FROM f WHERE starts_with(tier, 'needle/'))
  SELECT code, tier, count(*) AS n, CASE WHEN count(*) = 1 THEN CAST(min(instr(text, code) - 1) AS BIGINT) END AS "offset" FROM f SEMI JOIN w USING (code) GROUP BY code, tier""")
def needle_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The codes of the needle texts in the texts of every source."""
    needles = table(spark, d, "documents").where(F.col("source").startswith("needle/"))
    needles = needles.select(F.explode(F.regexp_extract_all("text", F.lit(corpus.CODE), 0)).alias("code"))
    return corpus.needle_offsets(needles, "code", table(spark, d, "documents"), "source", "text", "doc_id")


BUDGET = 20_000


@query(f"""WITH k AS (SELECT source, doc_id, greatest(coalesce(n_chars, 1), 1) AS s, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, 'access code'))
  SELECT source, doc_id, CAST(place AS INTEGER) AS place, CAST(upto AS BIGINT) AS upto FROM (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY place) AS upto FROM k) WHERE upto - s < {BUDGET}""")
def haystack_build(spark: SparkSession, d: str) -> DataFrame:
    """Distractors of each source up to a budget of characters, none of which speaks of an access code."""
    return corpus.haystacks(table(spark, d, "documents"), "source", "doc_id", "text", "n_chars", BUDGET, "access code")


def _order_sql(p: str = "rel") -> str:
    parts = f"string_split(coalesce({p}, ''), '/')"
    return f"len({parts}), array_to_string({parts}[1:len({parts}) - 1], '/'), CASE WHEN {parts}[-1] IN ('lib.rs', 'main.rs', 'mod.rs') THEN 0 ELSE 1 END, coalesce({p}, ''), doc_id"


TURNS = f"turns AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY {_order_sql()}) AS turn FROM documents)"


@query(f"WITH {TURNS} SELECT source, doc_id, turn FROM turns")
def corpus_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """The turn of each file in a round robin over sources."""
    return corpus.round_robin(table(spark, d, "documents").select("source", "doc_id", "rel"), "source", "rel", "doc_id").select("source", "doc_id", "turn")


TARGETS, CEILINGS = {"100k": 100_000, "500k": 500_000}, {"200k": 200_000}


@query(f"""WITH {TURNS}, c AS (SELECT row_number() OVER w AS place, sum(coalesce(n_chars, 0)) OVER w AS total FROM turns WINDOW w AS (ORDER BY turn, source, doc_id ROWS UNBOUNDED PRECEDING)),
  t AS (SELECT unnest(['100k', '500k', '200k']) AS tier, unnest([100000, 500000, 200000]) AS want, unnest([FALSE, FALSE, TRUE]) AS ceiling),
  n AS (SELECT tier, CASE WHEN ceiling THEN count(*) FILTER (WHERE total <= want) ELSE least(count(*) FILTER (WHERE total < want) + 1, count(*)) END AS files FROM c, t GROUP BY tier, ceiling)
  SELECT tier, files, CAST(coalesce(total, 0) AS BIGINT) AS total FROM n LEFT JOIN c ON c.place = n.files""")
def prefix_tiers(spark: SparkSession, d: str) -> DataFrame:
    """How many files in round-robin order fill tiers of characters."""
    turns = corpus.round_robin(table(spark, d, "documents").select("source", "doc_id", "rel", "n_chars"), "source", "rel", "doc_id")
    return corpus.prefix_tiers(turns, [F.col("turn"), F.col("source"), F.col("doc_id")], "n_chars", TARGETS, CEILINGS)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
  m AS (SELECT *, CASE WHEN starts_with(body, '### ') THEN 1 WHEN starts_with(body, '## ') OR starts_with(body, '# ') THEN 0 END AS mark FROM l),
  s AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS skip, last_value(CASE WHEN mark IS NOT NULL THEN line END IGNORE NULLS) OVER w AS at FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING))
  SELECT s.doc_id, count(*) AS lines, count(DISTINCT s.at) AS headings, CAST(max(s.line) AS INTEGER) AS last_line FROM s WHERE coalesce(skip, 0) = 0 GROUP BY s.doc_id""")
def section_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that remain of each document when what stands below third-level headings is dropped."""
    kept = corpus.sections(table(spark, d, "documents"), "doc_id", "text")
    head = F.col("body").startswith("# ") | F.col("body").startswith("## ")
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(F.when(head, 1)).alias("headings"), F.max("line").alias("last_line"))


@query()
def code_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Source files without bodies and tests."""
    docs = table(spark, d, "documents").where(F.col("source").startswith("lib/") & F.col("text").isNotNull())
    return docs.select("doc_id", "source", corpus.signatures_udf("text").alias("signatures"))


# The filler, the sentence of a needle and its question. A token counts as four characters here.
FILLER = "The grass is green. The sky is blue. The sun is yellow. Here we go. There and back again. "
NEEDLE = "The special magic number for %s is: %s."
QUESTION = "What is the special magic number for %s? Answer with just the number."
N_KEYS = 4


def niah_examples(spark: SparkSession, d: str, n_keys: int) -> DataFrame:
    e = table(spark, d, "eval_examples").where((F.col("lang") == "niah") & F.col("label").isNotNull()).select("bucket", "idx", "label", "depth").distinct()
    return corpus.needles_in_filler(e, "idx", "bucket", "depth", "label", n_keys, FILLER, NEEDLE, QUESTION)


_KEY_SQL = "concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])"


@query(f"""WITH e AS (SELECT DISTINCT bucket, idx, label, depth FROM eval_examples WHERE lang = 'niah' AND label IS NOT NULL), k AS (SELECT unnest([1, {N_KEYS}]) AS n_keys),
  x AS (SELECT e.*, n_keys, least(CAST(floor(coalesce(depth, 0) * n_keys) AS INTEGER), n_keys - 1) AS target, {len(NEEDLE) - 4} + 36 AS frame FROM e, k),
  l AS (SELECT *, frame + 7 AS other, frame + length(label) AS own FROM x), t AS (SELECT *, (n_keys - 1) * other + own AS total FROM l),
  r AS (SELECT *, greatest((bucket - total // 4) // (n_keys + 1) // {len(FILLER) // 4}, 1) AS reps FROM t), q AS (SELECT *, md5(idx || '-' || target) AS h FROM r)
  SELECT bucket, idx, CAST(n_keys AS INTEGER) AS n_keys, target, label, {_KEY_SQL} AS key, CAST(reps AS BIGINT) AS reps, CAST(reps * {len(FILLER)} * (target + 1) + target * (other + 1) AS BIGINT) AS "offset", CAST(reps * {len(FILLER)} * (n_keys + 1) + total + n_keys AS BIGINT) AS chars FROM q""")
def niah_layout(spark: SparkSession, d: str) -> DataFrame:
    """Where the asked needle stands in its filler, by depth among one or several needles, and how long the haystack is."""
    out = None
    for n in (1, N_KEYS):
        e = niah_examples(spark, d, n).select("bucket", "idx", F.lit(n).alias("n_keys"), "target", "label", F.col("needles")[F.col("target")]["key"].alias("key"), "reps", "offset", "chars")
        out = e if out is None else out.unionByName(e)
    return out


_WORDS_SQL = corpus.WORDS.replace("\\", "\\")


@query(f"""WITH d AS (SELECT doc_id, text, greatest(coalesce(n_chars, 1), 1) AS s, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE text IS NOT NULL),
  g AS (SELECT word, arg_min(doc_id, (h, doc_id)) AS gold FROM (SELECT DISTINCT doc_id, h, unnest(regexp_extract_all(text, '{corpus.WORDS}')) AS word FROM d) GROUP BY word),
  r AS (SELECT *, sum(s) OVER (ORDER BY h, doc_id) - s AS begin_, sum(s) OVER () AS total FROM d),
  a AS (SELECT DISTINCT bucket, idx, label, coalesce(depth, 0) AS depth FROM eval_examples WHERE lang = 'qa' AND length(label) > 0),
  x AS (SELECT a.*, gold, CAST('0x' || left(md5(bucket || '-' || idx), 12) AS BIGINT) % CAST((SELECT any_value(total) FROM r) AS BIGINT) AS start FROM a JOIN g ON g.word = a.label),
  n AS (SELECT x.*, r.doc_id, r.s, (CAST(begin_ AS BIGINT) - start + CAST(total AS BIGINT)) % CAST(total AS BIGINT) AS ahead FROM x, r WHERE r.doc_id <> gold AND NOT contains(r.text, label) AND (CAST(begin_ AS BIGINT) - start + CAST(total AS BIGINT)) % CAST(total AS BIGINT) < {2 * BUDGET}),
  u AS (SELECT *, sum(s) OVER (PARTITION BY bucket, idx ORDER BY ahead, doc_id) AS used FROM n), t AS (SELECT bucket, idx, count(*) AS k, max(used) AS used FROM u WHERE used - s < {BUDGET} GROUP BY ALL)
  SELECT x.bucket, x.idx, gold, coalesce(k, 0) AS distractors, CAST(coalesce(used, 0) AS BIGINT) AS used, CAST(floor(depth * coalesce(k, 0)) AS BIGINT) AS place FROM x LEFT JOIN t USING (bucket, idx)""")
def qa_haystacks(spark: SparkSession, d: str) -> DataFrame:
    """Questions with a document that holds the answer among others that don't, up to a budget of characters."""
    e = table(spark, d, "eval_examples").where(F.col("lang") == "qa")
    return corpus.gold_haystacks(e, ["bucket", "idx"], "label", "depth", table(spark, d, "documents"), "doc_id", "text", "n_chars", BUDGET)


@query("""WITH w AS (SELECT DISTINCT doc_id, left(text, 40) AS a FROM documents WHERE starts_with(source, 'needle/') AND length(text) >= 40),
  m AS (SELECT w.doc_id, d.source AS tier, (length(d.text) - length(replace(d.text, a, ''))) // length(a) AS n, instr(d.text, a) - 1 AS spot FROM w JOIN documents d ON contains(d.text, a))
  SELECT doc_id, tier, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n) = 1 THEN CAST(min(spot) AS BIGINT) END AS "offset" FROM m GROUP BY doc_id, tier""")
def needle_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 characters of every needle text in the texts of every source."""
    docs = table(spark, d, "documents")
    needles = docs.where(F.col("source").startswith("needle/") & (F.length("text") >= 40)).select("doc_id", F.left("text", F.lit(40)).alias("anchor"))
    return corpus.anchor_offsets(needles, "doc_id", "anchor", docs, "source", "text")


#: Groups in the order in which a corpus takes them, folders that it skips, endings and parts of machine-made files.
PRIORITY = ["lib/vellum", "lib/hasp", "lib/quorra", "lib/segmenta", "lib"]
SKIPPED, MADE_ENDINGS, MADE_PARTS = ["tests", "benches", "examples", "target", ".git"], ["_7.rs", ".gen.rs"], ["/ledger_1"]


@query(f"""WITH f AS (SELECT source, doc_id, rel FROM documents WHERE coalesce(ends_with(rel, '.rs') AND NOT list_has_any(string_split(rel, '/')[1:len(string_split(rel, '/')) - 1], {SKIPPED}) AND NOT ends_with(rel, '_7.rs') AND NOT ends_with(rel, '.gen.rs') AND NOT contains(rel, '/ledger_1'), FALSE)),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_order_sql()}) AS turn, {'CASE ' + ' '.join(f"WHEN source = '{p}' OR starts_with(source, '{p}/') THEN {i}" for i, p in enumerate(PRIORITY)) + f' ELSE {len(PRIORITY)} END'} AS group_rank FROM f)
  SELECT source, doc_id, turn, CAST(coalesce(group_rank, {len(PRIORITY)}) AS INTEGER) AS group_rank, row_number() OVER (ORDER BY turn, group_rank, source NULLS FIRST, doc_id) AS place FROM r""")
def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """The source files of a corpus in its order: every group's first file before any second one, groups by their priority."""
    docs = table(spark, d, "documents").where(corpus.included(F.col("rel"), ".rs", SKIPPED, MADE_ENDINGS, MADE_PARTS)).select("source", "doc_id", "rel")
    turns = corpus.round_robin(docs, "source", "rel", "doc_id").withColumn("group_rank", corpus.group_rank(F.col("source"), PRIORITY))
    placed = corpus.ranked(turns.select("source", "doc_id", "turn", "group_rank"), [], [F.col("turn"), F.col("group_rank"), F.col("source"), F.col("doc_id")], "place")
    return placed.select("source", "doc_id", "turn", "group_rank", "place")


@query("""SELECT doc_id, 'user' AS role, 1 AS parts, 'text' AS kind, length(text) AS chars FROM documents WHERE starts_with(source, 'chat/') AND text IS NOT NULL""")
def message_parts(spark: SparkSession, d: str) -> DataFrame:
    """Chats as messages whose content is a list of typed parts."""
    docs = table(spark, d, "documents").where(F.col("source").startswith("chat/") & F.col("text").isNotNull())
    m = docs.select("doc_id", F.lit("user").alias("role"), tx.content_parts(F.col("text")).alias("content"))
    return m.select("doc_id", "role", F.size("content").alias("parts"), F.col("content")[0]["type"].alias("kind"), F.length(F.col("content")[0]["text"]).cast("bigint").alias("chars"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL AND starts_with(source, 'chat/'))
  SELECT doc_id, CAST(line AS INTEGER) AS line, CASE WHEN starts_with(body, '/') OR starts_with(body, '> ') THEN 'control' ELSE 'prompt' END AS kind, length(body) AS chars FROM l WHERE regexp_matches(body, '\\S')""")
def prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    """Chats as a source of prompts: one per line, blank lines skipped, lines that begin with / or > control the session."""
    docs = table(spark, d, "documents").where(F.col("source").startswith("chat/") & F.col("text").isNotNull())
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body")).where(F.col("body").rlike(r"\S"))
    kind = F.when(F.col("body").startswith("/") | F.col("body").startswith("> "), "control").otherwise("prompt")
    return lines.select("doc_id", "line", kind.alias("kind"), F.length("body").cast("bigint").alias("chars"))
