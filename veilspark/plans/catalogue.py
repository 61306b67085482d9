"""Registered queries of the redaction engine, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..classifier import sequence
from ..classifier.pattern import pattern_spans
from ..engine import Engine
from ..functions import text as T
from ..operators import kernels as K
from ..operators import redaction as R
from ..operators import tables
from ..operators.faker import fake_value
from ..operators.rules import SECRETS, Rule, rule_spans
from ..sources import files
from ..streaming.redactor import Redactor, redact_replay

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Rules used below: disjoint, and alike in both regular-expression dialects.
EMAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
CARD = r"\b\d{16}\b"
HEX = r"\b[0-9a-f]{40}\b"
RULES = [Rule("EMAIL", EMAIL), Rule("IPV4", IPV4, severity="track"), Rule("CARD", CARD, severity="block", marker="[PAN]"), Rule("HEX", HEX, severity="block")]
UNION = "|".join(f"({p})" for p in (EMAIL, IPV4, CARD, HEX))


def spans_sql(table: str = "documents", key: str = "doc_id", text: str = "text", union: str = UNION) -> str:
    """CTE ``spans``: key, pos, m, start, end of a union's matches."""
    return f"""
WITH cut AS (
  SELECT {key}, {text} AS text, regexp_extract_all({text}, '{union}') AS m, string_split_regex({text}, '{union}') AS g FROM {table}
), each AS (
  SELECT {key}, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM cut WHERE len(m) > 0
), spans AS (
  SELECT {key}, text, i - 1 AS pos, m[i] AS found,
         CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start
  FROM each
)"""


LABEL_SQL = f"""CASE WHEN regexp_full_match(found, '{EMAIL}') THEN 'EMAIL' WHEN regexp_full_match(found, '{IPV4}') THEN 'IPV4'
  WHEN regexp_full_match(found, '{CARD}') THEN 'CARD' ELSE 'HEX' END"""


def _flat(df: DataFrame, spans: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(spans).alias("pos", "s"))


@query(spans_sql() + f"SELECT doc_id, pos, {LABEL_SQL} AS label, start, CAST(start + length(found) AS INTEGER) AS \"end\", found AS text FROM spans")
def rule_scan_spans(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return _flat(docs, rule_spans(F.col("text"), RULES), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), "s.label", "s.start", "s.end", F.col("s.text").alias("text"))


@query(spans_sql() + f", l AS (SELECT {LABEL_SQL} AS label FROM spans) SELECT label, count(*) AS n FROM l GROUP BY label")
def rule_counts_by_label(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.explode(rule_spans(F.col("text"), RULES)).alias("s")).groupBy("s.label").agg(F.count("*").alias("n"))


def _redacted_sql(text: str = "text") -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '{EMAIL}', '[EMAIL]', 'g'), '{IPV4}', '[IPV4]', 'g'), '{CARD}', '[PAN]', 'g'), '{HEX}', '[HEX]', 'g')"


@query(f"SELECT doc_id, {_redacted_sql()} AS redacted_text, len(regexp_extract_all(text, '{UNION}')) > 0 AS contains_pii FROM documents")
def redact_text(spark, sf_dir):
    engine = Engine(RULES, backend="none")
    return engine.redact(read(spark, sf_dir, "documents")).select("doc_id", "redacted_text", "contains_pii")


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{IPV4}', '<ip>', 'g'), '{CARD}', '[PAN]', 'g'), '{HEX}', '[HEX]', 'g') AS redacted_text FROM documents")
def redact_null_marker(spark, sf_dir):
    engine = Engine(RULES, backend="none", markers={"EMAIL": None, "IPV4": "<ip>"})
    return engine.redact(read(spark, sf_dir, "documents")).select("doc_id", "redacted_text")


MODEL = [Rule("private_email", EMAIL), Rule("account_number", CARD), Rule("secret", HEX)]


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{EMAIL}', '[private_email]', 'g'), '{IPV4}', '[IPV4]', 'g') AS redacted_text, len(regexp_extract_all(text, '{UNION}')) AS n_spans FROM documents")
def redact_enabled_only(spark, sf_dir):
    spans = R.merge(pattern_spans(F.col("text"), MODEL), rule_spans(F.col("text"), [Rule("IPV4", IPV4)]))
    docs = read(spark, sf_dir, "documents").withColumn("spans", R.with_markers(spans, enabled=["private_email"]))
    return docs.select("doc_id", R.splice(F.col("text"), F.col("spans")).alias("redacted_text"), F.size("spans").cast("long").alias("n_spans"))


@query(
    spans_sql(union=EMAIL)
    + """, e AS (SELECT cut.doc_id, cut.g, cut.m FROM cut)
SELECT doc_id, list_aggregate(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(m) THEN '<EMAIL:' || CAST(i - 1 AS VARCHAR) || '>' ELSE '' END), 'string_agg', '') AS redacted_text FROM e"""
)
def redact_indexed(spark, sf_dir):
    engine = Engine([Rule("EMAIL", EMAIL)], backend="none", markers=lambda s, i: f"<{s['label']}:{i}>")
    return engine.redact(read(spark, sf_dir, "documents")).select("doc_id", "redacted_text")


@query(
    "WITH p AS (SELECT doc_id, 'id ' || lpad(CAST(doc_id AS VARCHAR), 16, '4') || ' card ' || lpad(CAST(doc_id % 7 AS VARCHAR), 16, '5') AS t FROM documents) "
    "SELECT doc_id, 2 AS n_spans, CASE WHEN doc_id % 7 < 10 THEN 'account_number,CARD' END AS labels FROM p"
)
def merge_rule_model(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("id "), F.lpad(F.col("doc_id").cast("string"), 16, "4"), F.lit(" card "), F.lpad((F.col("doc_id") % 7).cast("string"), 16, "5")).alias("text")
    )
    spans = R.merge(pattern_spans(F.col("text"), MODEL), rule_spans(F.col("text"), [Rule("CARD", r"card \d+")]))
    return docs.withColumn("spans", spans).select("doc_id", F.size("spans").alias("n_spans"), F.concat_ws(",", F.transform("spans", lambda s: s["label"])).alias("labels"))


@query("SELECT doc_id, 0 AS above, CAST(len(regexp_extract_all(text, '" + CARD + "')) AS INTEGER) AS at_one FROM documents")
def confidence_filter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("spans", rule_spans(F.col("text"), [Rule("CARD", CARD)]))
    return docs.select("doc_id", F.size(R.confident(F.col("spans"), 1.01)).alias("above"), F.size(R.confident(F.col("spans"), 1.0)).alias("at_one"))


@query(f"SELECT lang, count(*) AS docs, sum(CASE WHEN len(regexp_extract_all(text, '{UNION}')) > 0 THEN 1 ELSE 0 END) AS with_pii FROM documents GROUP BY lang")
def contains_pii_by_lang(spark, sf_dir):
    found = Engine(RULES, backend="none").detect(read(spark, sf_dir, "documents"))
    return found.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.col("contains_pii").cast("long")).alias("with_pii"))


@query(spans_sql() + f", l AS (SELECT doc_id, {LABEL_SQL} AS label FROM spans) SELECT doc_id, label, count(*) AS n FROM l GROUP BY doc_id, label")
def summary_counts(spark, sf_dir):
    found = Engine(RULES, backend="none").detect(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("summary").alias("label", "n"))


#: One planted secret per rule of the preset, made from doc_id alike in both dialects; {h}: 8 hexadecimal digits.
_PLANTS = (
    ("JWT", "eyJ{h}.{h}.{h}"),
    ("GITHUB_PAT_CLASSIC", "ghp_{h}{h}{h}{h}abcd"),
    ("GITHUB_PAT_FINE_GRAINED", "github_pat_{h}{h}{h}{h}{h}{h}{h}{h}{h}{h}ab"),
    ("AWS_ACCESS_KEY_ID", "AKIA{h}{h}"),
    ("SLACK_TOKEN", "xoxb-0123456789-0123456789-{l}{l}{l}{l}"),
    ("SLACK_WEBHOOK", "https://hooks.slack.com/services/T{h}/B{h}/{h}"),
    ("OPENAI_API_KEY", "sk-proj-{h}{h}{h}"),
    ("OPENAI_API_KEY", "sk-ant-api03-{h}{h}{h}{h}{h}{h}{h}{h}{h}{h}{h}{h}"),
    ("GOOGLE_API_KEY", "AIza{h}{h}{h}{h}abc"),
    ("STRIPE_KEY", "sk_live_{h}{h}{h}"),
    ("STRIPE_WEBHOOK_SECRET", "whsec_{h}{h}{h}{h}"),
    ("NPM_TOKEN", "npm_{h}{h}{h}{h}abcd"),
    ("PRIVATE_KEY", "-----BEGIN RSA PRIVATE KEY-----"),
)


def _planted() -> Column:
    h = F.lpad(F.hex("doc_id"), 8, "0")
    low = F.lower(h)
    out = F.lit("")
    for k, (_, form) in enumerate(_PLANTS):
        text = F.lit(form)
        text = F.replace(F.replace(text, F.lit("{h}"), h), F.lit("{l}"), low)
        out = F.when(F.col("doc_id") % len(_PLANTS) == k, text).otherwise(out)
    return F.concat(F.lit("key: "), out, F.lit(" end"))


def _planted_sql() -> str:
    cases = " ".join(f"WHEN {k} THEN replace(replace('{form}', '{{h}}', lpad(upper(to_hex(doc_id)), 8, '0')), '{{l}}', lpad(lower(to_hex(doc_id)), 8, '0'))" for k, (_, form) in enumerate(_PLANTS))
    labels = " ".join(f"WHEN {k} THEN '{label}'" for k, (label, _) in enumerate(_PLANTS))
    return f"SELECT doc_id, CASE doc_id % {len(_PLANTS)} {labels} END AS label, 5 AS start, CAST(5 + length(t) AS INTEGER) AS \"end\" FROM (SELECT doc_id, CASE doc_id % {len(_PLANTS)} {cases} END AS t FROM documents)"


@query(_planted_sql())
def secrets_planted(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", _planted().alias("text"))
    return _flat(docs, rule_spans(F.col("text"), SECRETS), "doc_id").select("doc_id", "s.label", "s.start", "s.end")


@query(spans_sql("customer", "c_custkey", "c_name", r"\d{4}") + "SELECT c_custkey, pos, start, found AS text FROM spans")
def standalone_rule(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    return _flat(customer, rule_spans(F.col("c_name"), [Rule("DIGITS", r"\d{4}", flags="i")]), "c_custkey").select("c_custkey", F.col("pos").cast("long").alias("pos"), "s.start", F.col("s.text").alias("text"))


def _people(spark, sf_dir) -> DataFrame:
    """A table with mail, phone and plain columns, made from ``customer``."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_idx"),
        F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit("c"), (F.col("c_custkey") % 40).cast("string"), F.lit("@mail.example.com")).alias("mail"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("+1-617-555-0"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))).alias("phone"),
    )


@query(
    "SELECT * FROM (VALUES (0, 'segment', CAST(NULL AS VARCHAR), 0.0::DOUBLE, 50::BIGINT), (1, 'mail', 'private_email', 1.0::DOUBLE, 50::BIGINT), (2, 'phone', 'private_phone', 1.0::DOUBLE, 50::BIGINT)) "
    "t(\"index\", header, label, confidence, samples)"
)
def classify_columns(spark, sf_dir):
    return tables.classify_columns(_people(spark, sf_dir), Engine()).select("index", "header", "label", "confidence", "samples")


@query("SELECT 0 AS \"index\", 'private_email' AS label, 0.5::DOUBLE AS confidence, 4::BIGINT AS samples")
def majority_tie(spark, sf_dir):
    rows = [(0, "a@b.example"), (1, "+1-617-555-0100"), (2, ""), (3, "+1-617-555-0101"), (4, "c@d.example")]
    df = spark.createDataFrame(rows, "row_idx long, x string")
    return tables.classify_columns(df, Engine()).select("index", "label", "confidence", "samples")


_PEOPLE_SQL = """(SELECT c_custkey AS row_idx, c_mktsegment AS segment, 'c' || CAST(c_custkey % 40 AS VARCHAR) || '@mail.example.com' AS mail,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '+1-617-555-0' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') END AS phone FROM customer)"""


@query(f"SELECT row_idx, segment, '[private_email]' AS mail, CASE WHEN phone = '' THEN '' ELSE '[private_phone]' END AS phone FROM {_PEOPLE_SQL}")
def redact_table(spark, sf_dir):
    return tables.redact_table(_people(spark, sf_dir), Engine())


@query(f"SELECT row_idx, segment FROM {_PEOPLE_SQL}")
def drop_column_table(spark, sf_dir):
    return tables.redact_table(_people(spark, sf_dir), Engine(), "drop_column")


_POOL_SQL = "['alice.anderson','maria.rodriguez','james.chen','olivia.patel','liam.nakamura','sophia.williams','noah.becker','emma.dubois','lucas.kowalski','mia.johansson','ethan.tanaka','ava.hernandez']"


@query(
    f"""WITH t AS {_PEOPLE_SQL},
m AS (SELECT mail, row_number() OVER (ORDER BY min(row_idx)) - 1 AS i FROM t GROUP BY mail),
p AS (SELECT phone, row_number() OVER (ORDER BY min(row_idx)) - 1 AS i FROM t WHERE phone <> '' GROUP BY phone)
SELECT row_idx, segment, {_POOL_SQL}[m.i % 12 + 1] || '@example.com' AS mail,
  CASE WHEN t.phone = '' THEN '' ELSE '+1-555-01' || lpad(CAST(p.i % 100 AS VARCHAR), 2, '0') END AS phone
FROM t JOIN m ON t.mail = m.mail LEFT JOIN p ON t.phone = p.phone"""
)
def synth_table(spark, sf_dir):
    return tables.redact_table(_people(spark, sf_dir), Engine(), "synth")


@query(
    """SELECT label, i, CASE label
  WHEN 'private_phone' THEN '+1-555-01' || lpad(CAST(i % 100 AS VARCHAR), 2, '0')
  WHEN 'private_address' THEN CAST(100 + i AS VARCHAR) || ' Main St, Springfield, IL ' || CAST(60000 + i AS VARCHAR)
  WHEN 'private_url' THEN 'https://example.com/path/' || CAST(i AS VARCHAR)
  WHEN 'private_date' THEN CAST(CAST(DATE '2026-01-01' + CAST(i * 7 AS INTEGER) AS DATE) AS VARCHAR)
  WHEN 'account_number' THEN '4111-1111-1111-' || lpad(CAST(i % 10000 AS VARCHAR), 4, '0')
  WHEN 'secret' THEN '[secret]' ELSE '[' || label || ']' END AS fake
FROM (SELECT doc_id AS i FROM documents) d, (VALUES ('private_phone'), ('private_address'), ('private_url'), ('private_date'), ('account_number'), ('secret'), ('OTHER')) l(label)"""
)
def faker_each_label(spark, sf_dir):
    labels = ["private_phone", "private_address", "private_url", "private_date", "account_number", "secret", "OTHER"]
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    return docs.select("label", "i", fake_value(F.col("label"), F.col("i")).alias("fake"))


@query(
    spans_sql()
    + f""", l AS (SELECT 'doc' || CAST(doc_id AS VARCHAR) AS uri, pos, {LABEL_SQL} AS rule_id, found, substring(text, 1, start) AS prefix FROM spans),
p AS (SELECT *, length(prefix) - length(replace(prefix, chr(10), '')) + 1 AS line, length(list_last(string_split(prefix, chr(10)))) + 1 AS col FROM l)
SELECT uri, pos, rule_id, CASE WHEN rule_id = 'EMAIL' THEN 'warning' WHEN rule_id = 'IPV4' THEN 'note' ELSE 'error' END AS level,
  'Found ' || rule_id || ': "' || CASE WHEN length(found) > 80 THEN substring(found, 1, 77) || '...' ELSE found END || '"' AS message,
  CAST(line AS INTEGER) AS start_line, CAST(col AS INTEGER) AS start_column,
  substring(sha256(uri || '|' || CAST(line AS VARCHAR) || '|' || rule_id || '|' || found), 1, 16) AS fingerprint FROM p"""
)
def sarif_rows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("uri"), "text")
    found = files.sarif_results(docs.withColumn("spans", rule_spans(F.col("text"), RULES)))
    return found.select("uri", F.col("pos").cast("long").alias("pos"), "rule_id", "level", "message", "start_line", "start_column", "fingerprint")


@query(
    spans_sql()
    + f", l AS (SELECT {LABEL_SQL} AS label FROM spans) SELECT label, count(*) AS all_spans, sum(CASE WHEN label IN ('CARD', 'HEX') THEN 1 ELSE 0 END) AS warn_spans, sum(CASE WHEN label IN ('CARD', 'HEX') THEN 1 ELSE 0 END) AS block_spans FROM l GROUP BY label"
)
def severity_gate(spark, sf_dir):
    flat = read(spark, sf_dir, "documents").select(F.explode(rule_spans(F.col("text"), RULES)).alias("s"))
    n = lambda level: F.sum(T.is_blocking(F.col("s.source"), F.col("s.severity"), level).cast("long"))
    return flat.groupBy("s.label").agg(n("all").alias("all_spans"), n("warn").alias("warn_spans"), n("block").alias("block_spans"))


@query(
    """WITH f AS (SELECT page_id, 'dir/page' || CAST(page_id AS VARCHAR) || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.html' WHEN 2 THEN '.min.js' ELSE '.txt' END AS path, CASE WHEN page_id % 10 = 1 THEN 0 ELSE strlen(html) END AS length FROM pages)
SELECT page_id, CASE WHEN page_id % 4 IN (0, 2) THEN 'extension' WHEN length = 0 THEN 'empty' WHEN length > 5000 THEN 'size' END AS reason FROM f"""
)
def file_gate(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".png", ".html", ".min.js", ".txt")]), (F.col("page_id") % 4 + 1).cast("int"))
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("dir/page"), F.col("page_id").cast("string"), ext).alias("path"), F.when(F.col("page_id") % 10 == 1, 0).otherwise(F.octet_length("html")).alias("length"))
    return pages.select("page_id", files.skip_reason(F.col("path"), F.col("length"), 5000).alias("reason"))


_TAGGED = ["O O B-private_person E-private_person O", "S-private_email O B-secret I-secret I-secret E-secret", "S-private_url S-private_url O", "O O O"]


@query("SELECT * FROM (VALUES (0, 2, 3, 'private_person'), (1, 0, 0, 'private_email'), (1, 2, 5, 'secret'), (2, 0, 0, 'private_url'), (2, 1, 1, 'private_url')) t(k, first_token, last_token, label)")
def bioes_runs(spark, sf_dir):
    df = spark.createDataFrame([(k, t.split()) for k, t in enumerate(_TAGGED)], "k int, tags array<string>")
    return sequence.bioes_runs_sql(df, "k", "tags")


@query("SELECT * FROM (VALUES (0, 'private_person', 4, 10), (1, 'private_email', 0, 1), (1, 'secret', 4, 11), (2, 'private_url', 0, 1), (2, 'private_url', 2, 3)) t(k, label, start, \"end\")")
def viterbi_onehot(spark, sf_dir):
    rows = []
    for k, tags in enumerate(t.split() for t in _TAGGED):
        logits = [[1.0 if c == sequence.tag_id(t) else 0.0 for c in range(sequence.CLASSES)] for t in tags]
        text = " ".join("x" for _ in tags) if k != 0 else "a b cd efg h"
        offsets = [0, 2, 4, 7, 10, 12] if k == 0 else [2 * i for i in range(len(tags))] + [len(text)]
        rows.append((k, logits, offsets, text))
    df = spark.createDataFrame(rows, "k int, logits array<array<float>>, offsets array<int>, text string")
    found = sequence.decode_logits(df, "logits", "offsets", "text")
    return found.select("k", F.explode("spans").alias("s")).select("k", "s.label", "s.start", "s.end")


@query(
    """WITH d AS (SELECT doc_id, length(text) AS n FROM documents), c AS (
  SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 2048 THEN 1 ELSE CAST(ceil((n - 2048) / 1920.0) AS BIGINT) + 1 END)) AS chunk_no FROM d)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(chunk_no * 1920 AS INTEGER) AS first_token, CAST(least(2048, n - chunk_no * 1920) AS INTEGER) AS size FROM c"""
)
def chunk_explode(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "").alias("t")).withColumn("t", F.filter("t", lambda x: x != ""))
    out = sequence.chunked(docs, "t")
    return out.select("doc_id", "chunk_no", "first_token", F.size("t").alias("size"))


@query(spans_sql() + f"SELECT doc_id, pos, {LABEL_SQL} AS label, start FROM spans")
def chunk_merge(spark, sf_dir):
    once = rule_spans(F.col("text"), RULES)
    docs = read(spark, sf_dir, "documents").select("doc_id", once.alias("a"))
    merged = sequence.merge_chunks(F.concat(F.reverse("a"), "a"))  # two chunks that found the same, in another order
    return docs.select("doc_id", F.posexplode(merged).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), "s.label", "s.start")


def _vectors(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


_UNNESTED = "(SELECT vec_id, i, CAST(x[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def _rounded(df: DataFrame, x: Column) -> DataFrame:
    return df.select("vec_id", F.posexplode(x).alias("i", "v")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("v", 5).alias("v"))


@query(f"SELECT vec_id, i, round(v / sqrt(avg(v * v) OVER (PARTITION BY vec_id) + 1e-5), 5) AS v FROM {_UNNESTED}")
def kernel_rms_norm(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir), K.rms_norm(F.col("x")))


@query(f"WITH e AS (SELECT vec_id, i, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM {_UNNESTED}) SELECT vec_id, i, round(e / sum(e) OVER (PARTITION BY vec_id), 5) AS v FROM e")
def kernel_softmax(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir), K.softmax(F.col("x")))


@query(
    f"""WITH r AS (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM {_UNNESTED}), t AS (SELECT * FROM r WHERE k <= 4)
SELECT vec_id, k AS slot, i - 1 AS expert, round(exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) / 4, 5) AS weight FROM t"""
)
def kernel_router_top_k(spark, sf_dir):
    out = _vectors(spark, sf_dir).select("vec_id", F.posexplode(K.router_top_k(F.col("x"), 4)).alias("k", "c"))
    return out.select("vec_id", (F.col("k") + 1).cast("long").alias("slot"), F.col("c.index").cast("long").alias("expert"), F.round("c.weight", 5).alias("weight"))


@query(
    f"""WITH p AS (SELECT a.vec_id, (a.i + 1) // 2 AS i, least(a.v, 7) AS g, greatest(least(b.v, 7), -7) AS u FROM {_UNNESTED} a JOIN {_UNNESTED} b ON a.vec_id = b.vec_id AND b.i = a.i + 1 WHERE a.i % 2 = 1)
SELECT vec_id, i, round((u + 1) * g / (1 + exp(-1.702 * g)), 5) AS v FROM p"""
)
def kernel_swiglu(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir), K.swiglu(F.col("x")))


@query(
    f"""WITH a AS (SELECT vec_id, i, v, (vec_id % 50) * power(150000.0, -((i - 1) // 2) / 32.0) AS t FROM {_UNNESTED})
SELECT a.vec_id, a.i, round(a.v * cos(a.t) + CASE WHEN a.i % 2 = 1 THEN -b.v ELSE b.v END * sin(a.t), 5) AS v
FROM a JOIN a b ON a.vec_id = b.vec_id AND b.i = CASE WHEN a.i % 2 = 1 THEN a.i + 1 ELSE a.i - 1 END"""
)
def kernel_rope(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir), K.rope(F.col("x"), F.col("vec_id") % 50))


@query(
    """WITH r AS (SELECT label AS seq, vec_id, embedding AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p FROM embeddings),
s AS (SELECT a.seq, a.p AS q, list_dot_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS score, CAST(b.vec_id % 10 AS DOUBLE) AS v FROM r a JOIN r b ON a.seq = b.seq AND abs(a.p - b.p) <= 8)
SELECT seq, q, round(sum(exp(score) * v) / (sum(exp(score)) + 1), 4) AS value FROM s GROUP BY seq, q"""
)
def kernel_banded_attention(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("seq"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("p"), F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 10).cast("double").alias("v")
    )
    return K.banded_attention(rows, "seq", "p", "x", "v", 8).select("seq", "q", F.round("value", 4).alias("value"))


@query(f"SELECT vec_id % 7 AS target, round(sum(v * i), 3) AS value FROM {_UNNESTED} GROUP BY 1")
def kernel_scatter_add(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select((F.col("vec_id") % 7).alias("target"), F.posexplode("x").alias("i", "v")).withColumn("w", F.col("i") + 1)
    return K.scatter_add(rows, "target", "v", "w").select("target", F.round("value", 3).alias("value"))


@query(f"SELECT conv_id, turn, {_redacted_sql()} AS redacted_text FROM conversations")
def conversation_redact(spark, sf_dir):
    return Engine(RULES, backend="none").redact(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "redacted_text")


@query(
    f"""WITH t AS (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS stream_id, {_redacted_sql()} AS redacted_text FROM t"""
)
def stream_equals_batch(spark, sf_dir):
    """Turns as fragments of a stream; the pieces of text that come out, put together."""
    from pyspark.sql import Window as W

    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = read(spark, sf_dir, "conversations").withColumn("seq", F.row_number().over(order) - 1)
    last = F.max("seq").over(W.partitionBy("conv_id"))
    fragments = turns.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.concat("text", F.lit("\n")).alias("chunk"), (F.col("seq") == last).alias("eos"))
    out = redact_replay(fragments, Redactor(RULES, patterns=())).where("kind = 'text'")
    pieces = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return out.groupBy("stream_id").agg(F.concat_ws("", F.transform(pieces, lambda x: x["text"])).alias("redacted_text"))


@query("SELECT c_custkey, '\"' || replace(c_name, '#', '\"\"') || '\",' || c_mktsegment || ',' || CAST(c_nationkey AS VARCHAR) AS line FROM customer")
def csv_lines(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    return customer.select("c_custkey", files.csv_line([F.replace("c_name", F.lit("#"), F.lit('"')), F.col("c_mktsegment"), F.col("c_nationkey")]).alias("line"))


@query("SELECT doc_id, length(text) + 1 AS code_points, length(text) + 2 AS utf16_units, CAST(length(CASE WHEN length(text) > 80 THEN substring(text, 1, 77) || '...' ELSE text END) AS INTEGER) AS preview_length FROM documents")
def offsets_and_preview(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("t", F.concat(F.lit("\U0001f600"), "text"))
    n = F.length("t")
    return docs.select("doc_id", n.cast("long").alias("code_points"), T.utf16_offset(F.col("t"), n).cast("long").alias("utf16_units"), F.length(T.preview(F.col("text"))).alias("preview_length"))


@query(
    f"""WITH r AS (SELECT vec_id, i - 1 AS expert, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM {_UNNESTED})
SELECT expert, count(*) AS picks, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r WHERE k <= 4 GROUP BY expert"""
)
def expert_histogram(spark, sf_dir):
    routed = _vectors(spark, sf_dir).select(K.router_top_k(F.col("x"), 4).alias("chosen"))
    return K.expert_histogram(routed).select(F.col("expert").cast("long").alias("expert"), "picks", F.round("share", 6).alias("share"))


@query(
    f"""WITH m AS (SELECT label AS k, i, avg(v) AS v FROM {_UNNESTED} u JOIN embeddings e ON u.vec_id = e.vec_id GROUP BY 1, 2),
n AS (SELECT k, i, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS v FROM m)
SELECT x.k AS a, y.k AS b, round(sum(x.v * y.v), 5) AS cosine FROM n x JOIN n y ON x.i = y.i AND x.k < y.k GROUP BY 1, 2"""
)
def expert_cosine(spark, sf_dir):
    flat = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vectors = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("x"))
    return K.cosine_similarities(vectors, "label", "x").select("a", "b", F.round("cosine", 5).alias("cosine"))
