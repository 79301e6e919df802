"""Registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.common import ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(table)``, where ``table(name)`` reads a given table."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return fn(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op8_sharding")
def _(table):
    from shoal.llm.sharding import assign_shards

    return assign_shards(table("documents"), 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _sql_pieces(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """SQL rows ``(doc_id, start, rank, kind, stop)`` of one base rule."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, start, {rank} AS rank, '{kind}' AS kind, stop FROM (
    SELECT doc_id, u.hold AS hold,
      (sum(u.gap + u.hit) OVER w)::BIGINT AS stop, (sum(u.gap + u.hit) OVER w)::BIGINT - u.hit AS start
    FROM (
      SELECT doc_id, unnest([{{'i': i, 'gap': length(g[i]), 'hit': length(h[i]), 'hold': length(v[i]) >= {least}}}
        for i in range(1, len(h) + 1)]) AS u
      FROM (
        SELECT doc_id, string_split_regex(t, '{p}') AS g,
          regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {group}) AS v
        FROM texts WHERE regexp_matches(t, '{p}')))
    WINDOW w AS (PARTITION BY doc_id ORDER BY u.i)) WHERE hold"""


def _op2_sql() -> str:
    from shoal.llm.secret_scan import RULES

    rows = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern
        if r.group == 2:
            # Plain classes: case folding beyond ASCII differs between engines.
            name, rest = "password|passwd|secret|token|api_?key", pattern.partition("))")[2]
            folded = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)
            pattern = f"({folded}){rest}"
        rows.append(_sql_pieces(r.kind, rank, pattern.replace("\\x20", " "), r.group, r.least))
    said = "kind || ':' || start || ':' || stop"
    return (
        "WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ("
        + " UNION ALL ".join(rows)
        + f"""),
by_doc AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h,
    string_agg({said}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg({said}, ',' ORDER BY start, rank) AS spans
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN by_doc USING (doc_id)"""
    )


@query("op2_secret_scan", _op2_sql())
def _(table):
    from shoal.llm.secret_scan import as_text, findings_by_path

    spans = F.col("spans")
    count = lambda rank: F.coalesce(
        F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long"), F.lit(0).cast("long")
    )
    found = findings_by_path(table("documents"))
    return found.select(
        "doc_id",
        *[F.when(spans.isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(n) for k, n in enumerate(("n_assign", "n_access", "n_hex"))],
        F.sha2(as_text(F.filter(spans, lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        as_text(spans).alias("spans"),
    )


def _op4_sql() -> str:
    from shoal.llm.quality_rules import FEW_WORDS, GROUP_ROWS, MEASURES, SPREADS

    word = r"[^\x20\x09-\x0D]+"
    ratios = ", ".join(
        f"CASE WHEN {w} > 0 THEN 1000 * {p} // {w} ELSE 0 END AS m_{m}" for m, (p, w, _) in MEASURES.items()
    )
    rows = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, m_{m} AS v FROM measured WHERE n_words > 0" for m in MEASURES
    )
    least = "CASE measure " + " ".join(f"WHEN '{m}' THEN {s}" for m, (_, _, s) in MEASURES.items()) + " END"

    def level(name: str, by: str) -> str:
        over = f"PARTITION BY {by}measure"
        return f"""
{name} AS (
  SELECT {by}measure, greatest(q3 + {SPREADS} * (q3 - q2), q2 + {least}) AS lim, docs FROM (
    SELECT {by}measure, min(b) FILTER (upto * 4 >= docs * 2) AS q2, min(b) FILTER (upto * 4 >= docs * 3) AS q3,
      any_value(docs) AS docs
    FROM (SELECT {by}measure, b, sum(n) OVER ({over} ORDER BY b) AS upto, sum(n) OVER ({over}) AS docs
          FROM (SELECT {by}measure, b, count(*) AS n FROM buckets GROUP BY {by}measure, b))
    GROUP BY {by}measure))"""

    limit = lambda m: f"""coalesce(
    (SELECT lim FROM own o WHERE o.measure = '{m}' AND o.docs >= {GROUP_ROWS}
       AND o.lang IS NOT DISTINCT FROM d.lang AND o.source IS NOT DISTINCT FROM d.source),
    (SELECT lim FROM by_lang o WHERE o.measure = '{m}' AND o.docs >= {GROUP_ROWS} AND o.lang IS NOT DISTINCT FROM d.lang),
    (SELECT lim FROM every o WHERE o.measure = '{m}'), 1000000000)"""  # noqa: E731
    held = " OR ".join(f"m_{m} > {limit(m)}" for m in MEASURES)
    return f"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) >= 3)),
twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
hit AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM windows JOIN twice USING (doc_id, g), (SELECT unnest([0, 1, 2]) AS o)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts)
  WHERE regexp_matches(l, '{word}') GROUP BY doc_id),
counted AS (
  SELECT x.doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(hit.n, 0) AS n_repeat_words
  FROM texts x LEFT JOIN hit USING (doc_id) LEFT JOIN lines USING (doc_id)),
measured AS MATERIALIZED (SELECT *, {ratios} FROM counted),
buckets AS MATERIALIZED (
  SELECT lang, source, measure, v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0)::BIGINT) AS b FROM ({rows})),
{level("own", "lang, source, ")},
{level("by_lang", "lang, ")},
{level("every", "")},
verdict AS (
  SELECT *, n_words < {FEW_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {held} AS held FROM measured d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT held AS kept
FROM verdict"""


@query("op4_quality_rules", _op4_sql())
def _(table):
    from shoal.llm.quality_rules import quality_verdicts

    return quality_verdicts(table("documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_quality_classifier")
def _(table):
    from shoal.llm.quality_classifier import quality_query

    return quality_query(table("documents"), table("labels"))


@query("op5_toxicity")
def _(table):
    from shoal.llm.toxicity import toxicity_query

    return toxicity_query(table("documents"), table("labels"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS MATERIALIZED (SELECT doc_id, n, i, item_id FROM places JOIN windows USING (n, g)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM found) GROUP BY doc_id),
suffixes AS (
  SELECT item, q, least(len(v), 10) AS n, v, array_to_string(v[q : q + least(len(v), 10) - 1], ' ') AS g
  FROM (SELECT item, v, unnest(range(1, greatest(len(v) - 10, 0) + 2)) AS q
        FROM (SELECT row_number() OVER () AS item, v FROM (SELECT DISTINCT item_id, w AS v FROM b WHERE len(w) > 0)))),
begun AS (
  SELECT item, q, v, doc_id, i, w, least(len(v) - q, len(w) - i) + 1 AS room
  FROM places JOIN suffixes USING (n, g) JOIN d USING (doc_id)),
matched AS MATERIALIZED (
  SELECT item, q, doc_id, i,
    coalesce(nullif(list_position(list_transform(range(0, room), lambda k: v[q + k] <> w[i + k]), true), 0) - 1, room) AS n
  FROM begun),
longest AS (
  SELECT doc_id, max(n) AS longest_match, count(*) AS n_longest
  FROM (SELECT DISTINCT doc_id, i, n FROM matched JOIN (SELECT item, q, max(n) AS n FROM matched GROUP BY item, q) USING (item, q, n))
  GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(longest_match, 0) AS longest_match, coalesce(n_longest, 0) AS n_longest
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN longest USING (doc_id)"""


@query("op9_decontamination", OP9_SQL)
def _(table):
    from shoal.llm.decontaminate import contamination, with_longest

    found = with_longest(contamination(table("documents"), table("benchmark"), ["doc_id"], matches=True))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match",
        "n_longest",
    )


OP6_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (g)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM texts t LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = t.doc_id"""


@query("op6_jaccard_join", OP6_SQL)
def _(table):
    from shoal.llm.jaccard_join import jaccard_components

    return jaccard_components(table("documents"))


OP10_SQL = r"""
WITH texts AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    count(*) OVER (PARTITION BY coalesce(text, '')) > 1 AS whole_copy,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS own FROM documents),
spans AS MATERIALIZED (
  SELECT doc_id, own, i, md5(array_to_string(w[i : i + 49], ' ')) AS g
  FROM (SELECT doc_id, own, w, unnest(range(1, len(w) - 48)) AS i FROM texts WHERE len(w) >= 50)),
again AS (SELECT g, min(own::HUGEINT * 4294967296 + i) AS low FROM spans GROUP BY g HAVING count(*) > 1),
found AS (SELECT doc_id, own, i, own::HUGEINT * 4294967296 + i > low AS late FROM spans JOIN again USING (g)),
marked AS (
  SELECT doc_id, own, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh,
    CASE WHEN own <> doc_id THEN NULL WHEN NOT late THEN 0
      ELSE least(50, coalesce(i - lag(i) OVER (PARTITION BY doc_id, late ORDER BY i), 50)) END AS cut FROM found),
runs AS (SELECT doc_id, own, i, cut, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
passages AS (
  SELECT doc_id, min(i) - 1 AS start, max(i) + 49 AS "end", max(i) - min(i) + 50 AS n_words,
    coalesce(sum(cut), max(i) - min(i) + 50)::BIGINT AS n_cut
  FROM runs GROUP BY doc_id, run)
SELECT doc_id, start, "end", n_words, whole_copy, n_cut = 0 AS is_first, n_cut FROM passages JOIN texts USING (doc_id)"""


@query("op10_suffix_dedup", OP10_SQL)
def _(table):
    from shoal.llm.suffix_dedup import repeated_passages

    found = repeated_passages(table("documents"))
    n_cut = F.aggregate("cut", F.lit(0), lambda n, c: n + c["end"] - c["start"]).cast("long")
    return found.withColumn("n_cut", n_cut).drop("cut")


# The model of whole pieces with byte fallback; a parameter, never copied.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op7_sentencepiece")
def _(table):
    from shoal.llm.unigram import encoding_digest

    return encoding_digest(table("documents"), PIECE_MODEL, ["doc_id"])


@query("op1_chat_formatting")
def _(table):
    from shoal.llm.chat import format_conversations, read_back

    turns = table("conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return read_back(format_conversations(turns.unionByName(extra), PIECE_MODEL))


def _op13_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
failed AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM texts),
said AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad
  FROM labels GROUP BY doc_id),
sets AS MATERIALIZED (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)),
seen AS (
  SELECT part, filter_order, step, n, good, bad, f[ascii(filter_order[step]) - 64] AS own,
    len(list_filter(range(1, step), lambda i: f[ascii(filter_order[i]) - 64])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS fails
  FROM sets, steps),
counted AS (
  SELECT part, filter_order, step,
    sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN own AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN own AND NOT gone THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counted"""


@query("op13_filter_audit", _op13_sql())
def _(table):
    from shoal.llm.filter_audit import filter_audit

    return filter_audit(table("documents"), table("labels"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS MATERIALIZED (
  SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS t FROM docs) GROUP BY r, lang, source, t),
kept AS MATERIALIZED (SELECT lang, t FROM words GROUP BY lang, t HAVING count(*) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS MATERIALIZED (SELECT lang, source, t, sum(n) AS c FROM words JOIN kept USING (lang, t) GROUP BY lang, source, t),
own AS (SELECT lang, source, sum(c) AS total FROM counts GROUP BY lang, source),
whole AS (
  SELECT lang, t, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS total FROM counts GROUP BY lang, t),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.t, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (coalesce(o.total, 0) + 2 * v)) AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang)
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
compared AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN compared c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source),
likelier AS (
  SELECT s.lang, s.source, s.t AS item, (p - q) * (p - q) // (p + q) AS value
  FROM shares s JOIN (
    SELECT lang, t, 1 + (1000000000::HUGEINT * (c + 2) // (total + 2 * v)) AS q FROM whole JOIN sizes USING (lang)) w
    ON w.lang = s.lang AND w.t = s.t WHERE s.c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank
  FROM likelier QUALIFY rank <= 10)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked"""


@query("op12_source_divergence", OP12_SQL)
def _(table):
    from shoal.llm.divergence import source_divergence

    return source_divergence(table("documents"))


OP11_SQL = r"""
WITH bodies AS (
  SELECT page_id, url, string_split_regex(
    regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)</article>', 1, 's'), '</?(?:p|h1)[^>]*>') AS parts FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(
    replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&amp;?', '&', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))) AS b FROM bodies),
texts AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM texts"""


@query("op11_html_extraction", OP11_SQL)
def _(table):
    from shoal.llm.boilerplate import main_text

    return main_text(table("pages"))
