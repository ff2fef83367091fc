"""The registered queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.sentences import sentence_rows
from tracewell.functions.udfs import is_ascii, normal_form
from tracewell.operators import auditability, balance, evaluate, gates, integrity, ledger, spans, study
from tracewell.plans import fixtures, views
from tracewell.plans.model import Runs, is_blank, is_root
from tracewell.sources.files import documents_as_runs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Characters of the quotations that one automaton holds, each counted as 64 more.
QUOTE_CHARS = 16_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hop_balance(spark, sf_dir)


def _chats(spark: SparkSession, sf_dir: str) -> Runs:
    return views.chats(views.read(spark, sf_dir, "conversations"))


def _hops(spark: SparkSession, sf_dir: str, mutated: bool = False) -> Runs:
    return views.hops(views.read(spark, sf_dir, "documents"), mutated)


# --- conversations -------------------------------------------------------------------------------------------------

_CHAT = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS content,
    max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations),
a AS (SELECT CAST(conv_id AS VARCHAR) AS run_id, turn, role, content,
    (CASE WHEN role = 'assistant' THEN 'a' ELSE 'm' END) || turn AS artifact_id,
    CASE WHEN role = 'assistant' AND turn = last THEN 'final_answer' WHEN role = 'assistant' THEN 'intermediate' ELSE 'document' END AS kind,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS earlier FROM t)
"""


@query(_CHAT + "SELECT run_id, artifact_id, kind, length(content) AS n_chars, kind = 'document' AS root FROM a")
def conv_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _chats(spark, sf_dir).artifacts
    return a.select("run_id", "artifact_id", "kind", F.length("content").cast("long").alias("n_chars"), is_root(F.col("kind")).alias("root"))


@query(_CHAT + "SELECT run_id, 's' || turn AS step_id, CAST(earlier AS BIGINT) AS n_inputs FROM a WHERE role = 'assistant'")
def conv_steps_input_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).input_counts().select("run_id", "step_id", F.col("n_inputs").cast("long").alias("n_inputs"))


@query(_CHAT + "SELECT run_id, artifact_id, content FROM a WHERE kind = 'final_answer'")
def conv_final_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).artifacts.where("kind = 'final_answer'").select("run_id", "artifact_id", "content")


@query(_CHAT + "SELECT kind, count(*) AS n, count(DISTINCT run_id) AS n_runs, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM a GROUP BY kind")
def conv_kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _chats(spark, sf_dir).artifacts
    return a.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("n_runs"), F.sum(F.length("content")).alias("n_chars"))


_ORPHANS = """, taken AS (SELECT x.run_id, x.artifact_id FROM a x WHERE EXISTS (SELECT 1 FROM a y WHERE y.run_id = x.run_id AND y.role = 'assistant' AND y.turn > x.turn)),
told AS (SELECT DISTINCT run_id FROM a WHERE role = 'assistant'),
f AS (
  SELECT run_id, 'orphan_root' AS code, artifact_id AS subject FROM a WHERE kind = 'document' AND run_id IN (SELECT run_id FROM told)
    AND (run_id, artifact_id) NOT IN (SELECT run_id, artifact_id FROM taken) AND length(trim(regexp_replace(content, '\\s+', ' ', 'g'))) >= 20
  UNION ALL SELECT run_id, 'undeclared_inputs', 's' || turn FROM a WHERE role = 'assistant' AND earlier = 0
  UNION ALL SELECT run_id, 'empty_artifact', artifact_id FROM a WHERE trim(regexp_replace(content, '\\s+', ' ', 'g')) = ''
  UNION ALL SELECT DISTINCT run_id, c, '-' FROM a, (VALUES ('no_final_answer'), ('no_steps')) v(c) WHERE run_id NOT IN (SELECT run_id FROM told)
  UNION ALL SELECT run_id, 'duplicate_content', string_agg(artifact_id, ', ' ORDER BY artifact_id) FROM a
    WHERE trim(regexp_replace(content, '\\s+', ' ', 'g')) <> '' GROUP BY run_id, content HAVING count(*) > 1)
"""


@query(_CHAT + _ORPHANS + "SELECT run_id, code, subject, code IN ('no_final_answer', 'no_steps') AS fatal, code = 'duplicate_content' AS is_note FROM f")
def conv_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auditability.findings(_chats(spark, sf_dir))


@query(
    _CHAT
    + _ORPHANS
    + """, n AS (SELECT run_id, count(*) FILTER (WHERE code <> 'duplicate_content') AS found, bool_or(code IN ('no_final_answer', 'no_steps')) AS fatal FROM f GROUP BY run_id),
r AS (SELECT run_id, count(*) FILTER (WHERE role = 'assistant') AS derived, count(*) FILTER (WHERE role = 'assistant' AND trim(content) <> '') AS told FROM a GROUP BY run_id)
SELECT r.run_id, derived, CASE WHEN told > 0 THEN 1.0 END AS reachable_share, coalesce(found, 0) AS n_findings,
  CASE WHEN coalesce(fatal, false) OR told = 0 THEN 'unauditable' WHEN coalesce(found, 0) > 0 THEN 'partial' ELSE 'auditable' END AS verdict FROM r LEFT JOIN n USING (run_id)"""
)
def conv_reachable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auditability.check(_chats(spark, sf_dir)).select("run_id", "derived", "reachable_share", "n_findings", "verdict")


@query(_CHAT + "SELECT run_id, 's' || turn AS step_id, 'reachable' AS class, CAST(earlier AS BIGINT) AS n_inputs FROM a WHERE role = 'assistant'")
def conv_step_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auditability.step_classes(_chats(spark, sf_dir)).select("run_id", "step_id", "class", F.col("n_inputs").cast("long").alias("n_inputs"))


# --- documents -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE trim(text) <> '' QUALIFY count(*) OVER (PARTITION BY text) > 1")
def doc_duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text another one has too, with the first of them. Texts are told by their SHA-256, so neither
    they nor the members of a group are gathered."""
    docs = views.read(spark, sf_dir, "documents").where(~is_blank(F.col("text"))).select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    same = docs.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return docs.join(same, "key").select("doc_id", "first_id", "n")


@query("SELECT doc_id, trim(lower(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g'))) AS normal FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7f]')")
def doc_normalized_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents").where(is_ascii(F.col("text")))
    return docs.select("doc_id", normal_form("text").alias("normal"))


@query()
def doc_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of every document; SQL can't fold Unicode so. Null text: null."""
    return views.read(spark, sf_dir, "documents").select("doc_id", normal_form("text").alias("normal"))


@query()
def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document by its span; the rule for abbreviations looks back, which SQL can't."""
    return sentence_rows(views.read(spark, sf_dir, "documents"))


@query("SELECT b.item_id, d.doc_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS start FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''")
def benchmark_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold an item word for word."""
    items = views.read(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("quote"))
    return found_quotes(items, views.read(spark, sf_dir, "documents").select("doc_id", "text"))


def found_quotes(items: DataFrame, docs: DataFrame, most: int = QUOTE_CHARS) -> DataFrame:
    """(item_id, doc_id, start): where docs(doc_id, text) first hold items(item_id, quote), null ids included.

    An automaton of the quotations goes through every text once. Quotations are dealt by hash into as many automata as
    keep each within `most` characters, which bounds what a pass brings to the driver and to the executors; a text is
    passed through all of them, so the result doesn't depend on their number.
    """
    size = items.agg(F.sum(F.length("quote") + 64)).first()[0] or 0
    passes = -(-size // most)
    parts = []
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("quote"), F.lit(passes)) == k).groupBy("quote").agg(F.collect_list(F.struct("item_id")).alias("ids"))
        quotes = {r["quote"]: [x["item_id"] for x in r["ids"]] for r in own.toLocalIterator()}
        parts.append(docs.mapInArrow(_matches(docs.sparkSession.sparkContext.broadcast(quotes)), "item_id long, doc_id long, start long"))
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], "item_id long, doc_id long, start long")


def _matches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for quote, ids in shared.value.items():
            automaton.add_word(quote, (len(quote), ids))
        if shared.value:
            automaton.make_automaton()
        for b in batches:
            found: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first: dict[int, tuple] = {}
                for end, (n, ids) in automaton.iter(text) if text and shared.value else ():
                    first.setdefault(id(ids), (ids, end - n + 1))
                found += [(item, doc, start) for ids, start in first.values() for item in ids]
            cols = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "start"])

    return run


_SPANS = """WITH n AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0),
l AS (SELECT doc_id, k * 200 AS s, least(k * 200 + 200, n) AS e FROM n, unnest(generate_series(0, CAST((n - 1) // 200 AS BIGINT))) u(k)),
r AS (SELECT doc_id, k * 150 AS s, least(k * 150 + 220, n) AS e FROM n, unnest(generate_series(0, CAST((n - 1) // 150 AS BIGINT))) u(k) WHERE k % 4 <> 3)
"""


def _tiles(spark: SparkSession, sf_dir: str, step: int, width: int, skip: bool) -> DataFrame:
    d = views.read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).where("n > 0")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / step).cast("int"))))
    d = d.where("k % 4 <> 3") if skip else d
    return d.select("doc_id", (F.col("k") * step).alias("start"), F.least(F.col("k") * step + width, "n").alias("end"))


@query(_SPANS + "SELECT l.doc_id, count(*) AS n_pairs, CAST(sum(least(l.e, r.e) - greatest(l.s, r.s)) AS BIGINT) AS shared FROM l JOIN r ON l.doc_id = r.doc_id AND l.s < r.e AND r.s < l.e GROUP BY l.doc_id")
def span_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _tiles(spark, sf_dir, 200, 200, False), _tiles(spark, sf_dir, 150, 220, True)
    met = spans.overlapping(left, right.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")), ["doc_id"])
    return met.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("shared"))


@query(
    _SPANS
    + """, g AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM g),
m AS (SELECT doc_id, island, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, island)
SELECT doc_id, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS covered FROM m GROUP BY doc_id"""
)
def span_union_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    union = spans.merged(_tiles(spark, sf_dir, 150, 220, True), ["doc_id"])
    return union.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("covered"))


# --- two-hop runs --------------------------------------------------------------------------------------------------

_HOP = """
WITH p AS (SELECT doc_id, text AS doc, string_split(text, '. ') AS p FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7f]')),
f AS (SELECT doc_id, doc, p[1] AS p0, p[2] AS p1 FROM p WHERE len(p) >= 4
  AND length(p[1]) >= 15 AND length(p[2]) >= 15 AND length(p[3]) >= 15 AND length(p[4]) >= 15
  AND p[1] = trim(p[1], ' ') AND p[2] = trim(p[2], ' ') AND p[3] = trim(p[3], ' ') AND p[4] = trim(p[4], ' ')),
h AS (SELECT x.doc_id, CAST(x.doc_id AS VARCHAR) AS run_id, x.doc, x.p0, x.p1, y.p0 AS inv, x.doc_id % 2 = 1 AS odd,
  CASE WHEN x.doc_id % 2 = 1 THEN y.p0 ELSE x.p1 END AS second FROM f x JOIN f y ON y.doc_id = x.doc_id + 1
  WHERE strpos(x.doc, y.p0) = 0 AND x.p0 <> x.p1)
"""


@query(
    _HOP
    + """SELECT run_id, 'summary.c1' AS claim_id, 0 AS "start", length(p0) AS "end" FROM h
UNION ALL SELECT run_id, 'summary.c2', length(p0) + 1, length(p0) + 1 + length(p1) FROM h
UNION ALL SELECT run_id, 'summary.c3', length(p0) + length(p1) + 2, length(p0) + length(p1) + 2 + length(inv) FROM h
UNION ALL SELECT run_id, 'answer.c1', 0, length(p0) FROM h
UNION ALL SELECT run_id, 'answer.c2', length(p0) + 1, length(p0) + 1 + length(second) FROM h"""
)
def hop_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _hops(spark, sf_dir).claims
    return c.select("run_id", "claim_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    _HOP
    + """SELECT run_id, CASE doc_id % 9 WHEN 1 THEN 'not_reachable_from_step' WHEN 2 THEN 'artifact_unknown' WHEN 3 THEN 'self_citation'
  WHEN 4 THEN 'span_out_of_range' WHEN 5 THEN 'no_quoted_span' WHEN 6 THEN CASE WHEN regexp_matches(p0, '^[A-Za-z]{2}') THEN 'span_cuts_a_word' ELSE 'ok' END
  WHEN 7 THEN 'span_mismatch' WHEN 8 THEN 'assumption_undeclared' ELSE 'ok' END AS reason FROM h
  WHERE NOT regexp_matches(p0 || p1 || inv, '[0-9]')"""
)
def hop_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates' answers to spoilt entries, of runs whose sentences hold no digit (a digit's number may be cut too)."""
    runs = _hops(spark, sf_dir, mutated=True)
    numbered = runs.claims.where(F.col("text").rlike("[0-9]") & F.col("claim_id").isin("summary.c1", "summary.c2", "summary.c3")).select("run_id").distinct()
    return gates.verify(runs).where("entry_id = 'answer.c1.e1'").join(numbered, "run_id", "left_anti").select("run_id", "reason")


@query()
def hop_gate_reasons_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates' answers to spoilt entries, of all runs; SQL can't tell where a number is cut."""
    return gates.verify(_hops(spark, sf_dir, mutated=True)).where("entry_id = 'answer.c1.e1'").select("run_id", "reason")


@query(_HOP + "SELECT run_id, 'answer.c1' AS claim_id, 'summary.c1' AS cites FROM h UNION ALL SELECT run_id, 'answer.c2', CASE WHEN odd THEN 'summary.c3' ELSE 'summary.c2' END FROM h")
def hop_citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _hops(spark, sf_dir)
    up = ledger.citations(runs, gates.verify(runs)).select("run_id", "entry_id", F.explode("upstream").alias("cites"))
    return up.join(runs.entries.select("run_id", "entry_id", "claim_id"), ["run_id", "entry_id"]).select("run_id", "claim_id", "cites")


_HOP_STATUS = """, s AS (
  SELECT run_id, 'summary.c1' AS claim_id, 'grounded' AS status, 1 AS depth, NULL AS step FROM h UNION ALL SELECT run_id, 'summary.c2', 'grounded', 1, NULL FROM h
  UNION ALL SELECT run_id, 'summary.c3', 'prior_only', 0, 's2' FROM h UNION ALL SELECT run_id, 'answer.c1', 'grounded', 2, NULL FROM h
  UNION ALL SELECT run_id, 'answer.c2', CASE WHEN odd THEN 'laundered' ELSE 'grounded' END, CASE WHEN odd THEN 1 ELSE 2 END, CASE WHEN odd THEN 's2' END FROM h)
"""


@query(_HOP + _HOP_STATUS + "SELECT run_id, claim_id, status, CAST(depth AS BIGINT) AS depth, step AS break_step_id FROM s")
def hop_claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.close_books(_hops(spark, sf_dir)).select("run_id", "claim_id", "status", F.col("depth").cast("long").alias("depth"), "break_step_id")


@query(
    _HOP
    + """SELECT run_id, CAST(2 AS BIGINT) AS final_claims, CAST(CASE WHEN odd THEN 1 ELSE 2 END AS BIGINT) AS closing, CASE WHEN odd THEN 0.5 ELSE 1.0 END AS coverage,
  CASE WHEN odd THEN 0.5 ELSE 0.0 END AS laundering_rate, NOT odd AS books_balance, CASE WHEN odd THEN 'books_do_not_balance' ELSE '' END AS reasons, CAST(CASE WHEN odd THEN 1 ELSE 0 END AS BIGINT) AS exit_code FROM h"""
)
def hop_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _hops(spark, sf_dir)
    b = balance.trial_balance(runs, ledger.close_books(runs))
    return b.select("run_id", "final_claims", "closing", "coverage", "laundering_rate", "books_balance", F.array_join("reasons", ",").alias("reasons"), F.col("exit_code").cast("long").alias("exit_code"))


@query(
    _HOP
    + """, l AS (SELECT run_id, odd, length(regexp_replace(p0, '[^A-Za-z0-9]', '', 'g')) AS a, length(regexp_replace(second, '[^A-Za-z0-9]', '', 'g')) AS b FROM h)
SELECT run_id, a + b AS total, a + b AS claimed, CASE WHEN odd THEN a ELSE a + b END AS closed FROM l"""
)
def hop_answer_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _hops(spark, sf_dir)
    return balance.answer_cover(runs, ledger.close_books(runs)).select("run_id", "total", "claimed", "closed")


@query(_HOP + _HOP_STATUS + "SELECT run_id, claim_id, status, 'summary.c3' AS break_claim_id, 's2' AS break_step_id, 'model prior, no external evidence' AS break_reason FROM s WHERE status IN ('laundered', 'prior_only') AND claim_id LIKE 'answer.%'")
def hop_injection_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _hops(spark, sf_dir)
    return balance.injection_points(runs, ledger.close_books(runs))


@query(_HOP + _HOP_STATUS + "SELECT status, count(*) AS n FROM s WHERE claim_id LIKE 'answer.%' GROUP BY status")
def hop_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the claims of final answers."""
    runs = _hops(spark, sf_dir)
    return balance.final_claims(runs, ledger.close_books(runs)).groupBy("status").agg(F.count("*").alias("n"))


@query(
    _HOP
    + """SELECT 2 * count(*) AS n, count(*) FILTER (WHERE odd) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, 2 * count(*) - count(*) FILTER (WHERE odd) AS tn, 1.0 AS "precision", 1.0 AS recall, 0.0 AS fpr, 1.0 AS f1 FROM h"""
)
def hop_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of answers: flagged if a claim over them fails, true if they are the planted invention."""
    runs = _hops(spark, sf_dir)
    audits = ledger.close_books(runs).select("run_id", "claim_id", (~balance.closes(F.col("status"))).alias("fails"))
    said = runs.claims.where("artifact_id = 'answer'").select("run_id", "artifact_id", "start", "end", "text")
    over = runs.claims.join(audits, ["run_id", "claim_id"]).select("run_id", "artifact_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "fails")
    flagged = spans.overlapping(said, over, ["run_id", "artifact_id"]).groupBy("run_id", "start", "text").agg(F.bool_or("fails").alias("flag"))
    invented = runs.claims.where("claim_id = 'summary.c3'").select("run_id", F.col("text").alias("inv"))
    return evaluate.confusion(flagged.join(invented, "run_id").withColumn("truth", F.col("text") == F.col("inv")), "truth", "flag")


@query(_HOP + "SELECT run_id, CAST('x' AS VARCHAR) AS error FROM h WHERE false")
def hop_bad_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.bad_runs(_hops(spark, sf_dir))


@query()
def deep_and_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains up to and over the depth limit, and rings with and without a way out."""
    return ledger.close_books(fixtures.deep_and_cyclic(spark)).select("run_id", "claim_id", "status", "depth")


@query()
def fixture_laundered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a small run that launders a sentence: 2 final claims grounded, 1 laundered at the summary."""
    runs = fixtures.laundered(spark)
    return balance.trial_balance(runs, ledger.close_books(runs))


# --- webs: claims that close or fail for every reason, alone and in groups ------------------------------------------

_WEB = """
WITH d AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS run_id, doc_id % 5 AS a, doc_id // 5 % 5 AS b, doc_id // 25 % 4 AS c, doc_id // 100 % 5 = 4 AS silent FROM documents WHERE doc_id >= 0),
posted AS (SELECT run_id, 'm1' AS claim_id, a AS how FROM d UNION ALL SELECT run_id, 'm2', b FROM d),
rank AS (SELECT * FROM (VALUES ('grounded', 0, true), ('assumed', 1, true), ('laundered', 2, false), ('unsupported', 3, false), ('prior_only', 4, false)) v(status, rank, closes)),
mid AS (SELECT run_id, claim_id, CASE how WHEN 0 THEN 'grounded' WHEN 1 THEN 'prior_only' WHEN 3 THEN 'assumed' ELSE 'unsupported' END AS status, CASE WHEN how IN (0, 3) THEN 1 ELSE 0 END AS depth,
  CASE WHEN how IN (1, 2, 4) THEN claim_id END AS at_claim, CASE WHEN how IN (1, 2, 4) THEN 's2' END AS at_step,
  CASE how WHEN 1 THEN 'model prior, no external evidence' WHEN 2 THEN 'span_mismatch' WHEN 4 THEN 'no entry posted' ELSE '' END AS why FROM posted),
cites AS (SELECT run_id, way, leg, member FROM d, (VALUES (0, 1, 1, 'm1'), (0, 1, 1, 'm2'), (1, 1, 1, 'm1'), (1, 1, 2, 'm2'), (2, 1, 1, 'm1'), (2, 2, 1, 'm2'), (3, 1, 1, 'm1')) v(how, way, leg, member) WHERE c = how AND NOT silent),
under AS (SELECT x.run_id, way, leg, m.*EXCLUDE (run_id, claim_id), rank, closes, row_number() OVER (PARTITION BY x.run_id, way, leg ORDER BY closes, rank DESC, depth DESC, at_step DESC, at_claim DESC) AS nth
  FROM cites x JOIN mid m ON m.run_id = x.run_id AND m.claim_id = x.member JOIN rank USING (status)),
legs AS (SELECT run_id, way, leg, CASE WHEN closes THEN status ELSE 'laundered' END AS status, depth + 1 AS depth, at_claim, at_step, why FROM under WHERE nth = 1
  UNION ALL SELECT run_id, 2, 1, 'grounded', 1, NULL, NULL, '' FROM d WHERE c = 3 AND NOT silent),
ways AS (SELECT *, row_number() OVER (PARTITION BY run_id, way ORDER BY closes, rank DESC, depth DESC, at_step DESC, at_claim DESC) AS nth FROM legs JOIN rank USING (status)),
best AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank, depth, coalesce(at_step, ''), coalesce(at_claim, '')) AS place FROM ways WHERE nth = 1),
audits AS (SELECT run_id, claim_id, status, depth, at_claim, at_step, why FROM mid UNION ALL SELECT run_id, 'e1', status, depth, at_claim, at_step, why FROM best WHERE place = 1)
"""


def _webs(spark: SparkSession, sf_dir: str) -> Runs:
    return views.webs(views.read(spark, sf_dir, "documents"))


@query(_WEB + "SELECT run_id, claim_id, status, CAST(depth AS BIGINT) AS depth, at_claim AS break_claim_id, at_step AS break_step_id, why AS break_reason FROM audits")
def web_claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.close_books(_webs(spark, sf_dir)).select("run_id", "claim_id", "status", F.col("depth").cast("long").alias("depth"), "break_claim_id", "break_step_id", "break_reason")


@query(
    _WEB
    + """SELECT d.run_id, CAST(CASE WHEN silent THEN 0 ELSE 1 END AS BIGINT) AS final_claims, CAST(coalesce(closes, false) AS BIGINT) AS closing, coalesce(closes, false) AS books_balance,
  CASE WHEN NOT coalesce(closes, true) THEN 'books_do_not_balance' ELSE '' END AS reasons, CAST(CASE WHEN silent THEN 2 WHEN closes THEN 0 ELSE 1 END AS BIGINT) AS exit_code
FROM d LEFT JOIN audits a ON a.run_id = d.run_id AND a.claim_id = 'e1' LEFT JOIN rank USING (status)"""
)
def web_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _webs(spark, sf_dir)
    b = balance.trial_balance(runs, ledger.close_books(runs))
    return b.select("run_id", "final_claims", "closing", "books_balance", F.array_join("reasons", ",").alias("reasons"), F.col("exit_code").cast("long").alias("exit_code"))


@query("SELECT CAST(doc_id AS VARCHAR) AS run_id, 'claim m' || k || ' is not what stands at its span' AS error FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id >= 0), (VALUES (1), (2)) v(k) WHERE doc_id % 7 = k UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), 'step s2 names the unknown artifact nowhere' FROM documents WHERE doc_id >= 0 AND doc_id % 11 = 3")
def web_bad_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webs that are spoilt: the text of a claim by doc_id % 7, an input of a step by doc_id % 11."""
    runs, n = _webs(spark, sf_dir), F.col("run_id").cast("long")
    wrong = F.col("claim_id") == F.concat(F.lit("m"), (n % 7).cast("string"))
    claims = runs.claims.withColumn("text", F.when(wrong, "Something else altogether").otherwise(F.col("text")))
    lost = (n % 11 == 3) & (F.col("step_id") == "s2")
    steps = runs.steps.withColumn("inputs", F.when(lost, F.array(F.lit("nowhere"))).otherwise(F.col("inputs")))
    return integrity.bad_runs(Runs(runs.artifacts, steps, claims, runs.entries, runs.assumptions))


@query("SELECT * FROM (VALUES ('m0', 'document', '-'), ('t2', 'tool_result', '-'), ('t4', 'intermediate', '-'), ('t6', 'tool_result', 'answering_call'), ('a7', 'final_answer', '-')) v(artifact_id, kind, note)")
def fixture_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chat log's replies are read as, with the note on each."""
    runs, _, notes = documents_as_runs(fixtures.chat_tools(spark))
    return runs.artifacts.join(_echo_notes(notes), ["run_id", "artifact_id"], "left").select("artifact_id", "kind", F.coalesce("note", F.lit("-")).alias("note"))


@query("SELECT * FROM (VALUES (0, 'document', 'How often does the ferry cross?'), (1, 'intermediate', 'I will look that up.'), (2, 'tool_result', 'Departures at six, ten, two and six.'), (3, 'final_answer', 'Four times a day.')) v(ord, kind, content)")
def fixture_otel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thread of an export's spans; a turn that two spans hold counts once."""
    return documents_as_runs(fixtures.otel(spark))[0].artifacts.select("ord", "kind", "content")


def _echo_notes(notes: DataFrame) -> DataFrame:
    return notes.where("note = 'echo_notes'").select("run_id", "artifact_id", F.get_json_object("detail", "$.kind").alias("note"))


@query()
def conv_tool_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs with tools: what each reply is read as, and the note on it. Held against a plain search in
    the tests: SQL can't weigh a reply by the runs of words that it shares."""
    runs, _, notes = documents_as_runs(views.tool_logs(views.read(spark, sf_dir, "conversations")))
    replies = runs.artifacts.where(F.col("artifact_id").startswith("t")).select("run_id", "artifact_id", "kind")
    return replies.join(_echo_notes(notes), ["run_id", "artifact_id"], "left")


# --- evaluation ----------------------------------------------------------------------------------------------------

_PRF = """count(*) AS n, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn"""
_RATES = """coalesce(tp / nullif(tp + fp, 0), 0.0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0.0) AS fpr"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("t"), (F.col("quality") == 0).alias("p"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "fpr", "f1")})


@query(
    f"WITH x AS (SELECT toxic = 1 AS t, quality = 0 AS p FROM labels), c AS (SELECT {_PRF} FROM x WHERE t IS NOT NULL AND p IS NOT NULL), r AS (SELECT *, {_RATES} FROM c) "
    'SELECT n, tp, fp, fn, tn, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(fpr, 9) AS fpr, round(coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0.0), 9) AS f1 FROM r'
)
def labels_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.confusion(_labels(spark, sf_dir), "t", "p"))


@query(
    f"WITH x AS (SELECT lang, toxic = 1 AS t, quality = 0 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, {_PRF} FROM x WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY lang), r AS (SELECT *, {_RATES} FROM c) "
    'SELECT lang, n, tp, fp, fn, tn, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(fpr, 9) AS fpr, round(coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0.0), 9) AS f1 FROM r'
)
def labels_prf_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents").select("doc_id", "lang")
    return _rounded(evaluate.confusion(_labels(spark, sf_dir).join(docs, "doc_id"), "t", "p", ["lang"]))


@query(
    "WITH x AS (SELECT toxic = 1 AS hit, length(text) / 4000.0 AS share FROM labels JOIN documents USING (doc_id)), c AS (SELECT * FROM (VALUES (0.2), (0.4), (0.5), (0.6), (0.8)) v(cut)) "
    "SELECT CAST(cut AS DOUBLE) AS cut, count(*) FILTER (WHERE share >= cut) AS n_above, count(*) FILTER (WHERE share >= cut AND hit) AS hits_above, count(*) FILTER (WHERE share < cut) AS n_below, count(*) FILTER (WHERE share < cut AND hit) AS hits_below FROM x, c GROUP BY cut"
)
def labels_cut_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents").select("doc_id", (F.length("text") / 4000.0).alias("share"))
    return evaluate.cut_table(_labels(spark, sf_dir).join(docs, "doc_id"), "share", "t")


@query()
def labels_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bootstrap_f1(_labels(spark, sf_dir), "doc_id", "t", "p", draws=200)


@query()
def labels_stratified_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents").select("doc_id", "source")
    return evaluate.stratified_permutation(_labels(spark, sf_dir).join(docs, "doc_id"), "doc_id", "source", "p", "t", draws=100)


@query()
def labels_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flags for toxic documents, low quality and more than 400 words, on the same resampled documents."""
    docs = views.read(spark, sf_dir, "documents").select("doc_id", (F.size(F.split("text", " ")) > 400).alias("long"))
    return evaluate.paired_bootstrap_f1(_labels(spark, sf_dir).join(docs, "doc_id"), "doc_id", "t", "p", "long", draws=200)


@query(
    "WITH x AS (SELECT doc_id, coalesce(toxic, 0) = 1 AS has FROM labels), s AS (SELECT doc_id, has FROM x WHERE has ORDER BY md5('0:' || doc_id), doc_id LIMIT 30), "
    "o AS (SELECT doc_id, has FROM x WHERE NOT has ORDER BY md5('0:' || doc_id), doc_id LIMIT 20), u AS (SELECT * FROM s UNION ALL SELECT * FROM o) "
    "SELECT doc_id, has, row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) AS place FROM u"
)
def labels_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50 labelled documents, 60 % of them toxic (as many as there are)."""
    x = views.read(spark, sf_dir, "labels").select("doc_id", (F.coalesce("toxic", F.lit(0)) == 1).alias("has"))
    return study.enriched(x, "doc_id", "has", 50).withColumn("place", F.col("place").cast("long"))


@query(_SPANS + ", h AS (SELECT l.*, EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND l.s < r.e AND r.s < l.e) AS hit FROM l) SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS hit, coalesce(count(*) FILTER (WHERE hit) / nullif(count(*), 0), 0.0) AS rate FROM h")
def span_natural_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _tiles(spark, sf_dir, 200, 200, False), _tiles(spark, sf_dir, 150, 220, True)
    return study.natural_rate(left, right.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")), "doc_id")


@query(_CHAT + "SELECT run_id, arg_min(role <> 'assistant', md5('0:' || run_id || ':' || turn)) AS beyond FROM a GROUP BY run_id")
def conv_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn drawn at random from each conversation is not the assistant's."""
    a = _chats(spark, sf_dir).artifacts.select("run_id", "ord", (F.col("title") != "assistant").alias("beyond"))
    return study.placebo(a, "run_id", "ord", "beyond")


def _hop_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Runs, DataFrame]:
    """Odd runs are labelled at their second step, those with an id that 3 divides beyond a tool."""
    runs = _hops(spark, sf_dir)
    audits = ledger.close_books(runs)
    numbers = runs.steps.select("run_id", "step_id", (F.col("ord") + 1).alias("number"))
    n = F.col("run_id").cast("long")
    labels = runs.run_ids().select("run_id", F.when(n % 2 == 1, 2).alias("label_step"), (n % 2 == 1).alias("labelled"), (n % 3 == 0).alias("at_boundary"), F.lit("invented").alias("category"), F.when(n % 5 == 0, "fifth").otherwise("other").alias("subcategory"))
    return study.scores(runs, audits, numbers, labels), labels, runs, audits


@query(
    _HOP
    + """SELECT run_id, odd AS flagged, CASE WHEN odd THEN '2' ELSE '' END AS break_steps, CAST(CASE WHEN odd THEN 2 END AS INTEGER) AS break_step, CAST(CASE WHEN odd THEN 2 END AS INTEGER) AS label_step,
  odd AS exact, odd AS label_hit, odd AS within_one, 4 AS answer_step, CAST(2 AS BIGINT) AS final_claims, CASE WHEN odd THEN 0.5 ELSE 0.0 END AS laundering_rate FROM h"""
)
def hop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hop_scores(spark, sf_dir)[0].withColumn("break_steps", F.array_join("break_steps", ","))


@query(
    _HOP
    + """, t AS (SELECT odd, unnest(CASE WHEN odd AND doc_id % 3 = 0 THEN ['labelled', 'beyond'] WHEN odd THEN ['labelled', 'reachable', 'reachable: invented / ' || CASE WHEN doc_id % 5 = 0 THEN 'fifth' ELSE 'other' END] ELSE ['clean'] END) AS population FROM h)
SELECT population, count(*) AS n, count(*) FILTER (WHERE odd) AS flagged, count(*) FILTER (WHERE odd) AS exact, count(*) FILTER (WHERE odd) AS label_hit, count(*) FILTER (WHERE odd) AS within_one FROM t GROUP BY population"""
)
def hop_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, labels, _, _ = _hop_scores(spark, sf_dir)
    return study.roll_up(scored, labels)


@query(_HOP + "SELECT run_id, 'answer.c2' AS claim_id, CASE WHEN doc_id % 3 = 0 THEN 'quote_fabricated' WHEN doc_id % 3 = 1 THEN 'wrong_artifact_cited' ELSE 'no_credit_offered' END AS bucket FROM h WHERE odd")
def hop_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the invented sentence has no credit; of some runs a credit was offered and dropped."""
    _, _, runs, audits = _hop_scores(spark, sf_dir)
    n = F.col("run_id").cast("long")
    reason = F.when(n % 3 == 0, "not found verbatim").when(n % 3 == 1, "not among the step's inputs")
    dropped = runs.claims.where("claim_id = 'summary.c3'").select("run_id", "claim_id", F.lit("doc").alias("artifact_id"), F.lit("zzz zzzz").alias("quote"), reason.alias("reason"), F.lit("proposer").alias("proposed_by")).where("reason IS NOT NULL")
    return study.diagnosis(runs, audits, dropped)


@query()
def conv_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.fingerprints(_chats(spark, sf_dir))
