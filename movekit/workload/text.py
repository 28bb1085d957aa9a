"""Text functions: redaction, compaction, metrics in output, names and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movekit.functions import scalars as S
from movekit.functions.metrics import extract_metrics
from movekit.functions.redact import redact_args, redact_text, redact_urls
from movekit.workload import query, table

# The same rules for DuckDB's regular expressions, which have \b where Spark uses a look-behind.
_STOP = r"""\s"''`<>()\[\]{}"""
_KEY = (
    rf"(?:pwd|sig|signature|sas|[^=&#?{_STOP}]*(?:password|passwd|token|secret|private[-_]key|access[-_]key)[^=&#{_STOP}]*"
    rf"|[^=&#?{_STOP}]*(?:[-_]sig|[-_]signature))"
)
_SCHEME = "([A-Za-z][A-Za-z0-9+.-]*://)"


def _urls(text: str) -> str:
    step = rf"regexp_replace({text}, '{_SCHEME}[^/?#@:{_STOP}]+@', '\1<redacted>@', 'g')"
    step = rf"regexp_replace({step}, '{_SCHEME}([^/?#@:{_STOP}]*):[^/?#{_STOP}]*@', '\1\2:<redacted>@', 'g')"
    step = rf"regexp_replace({step}, '([?&])({_KEY})=[^&#{_STOP}]*', '\1\2=<redacted>', 'gi')"
    return f"CASE WHEN contains({text}, '://') THEN {step} ELSE {text} END"


def _assignments(text: str) -> str:
    words = "PASSWORD|PASSWD|PWD|TOKEN|SECRET|PRIVATE[_-]?KEY|ACCESS[_-]?KEY|CLIENT[_-]?SECRET|SAS|SIGNATURE|SIG"
    return (
        rf"""regexp_replace({text}, '\b([A-Z0-9_]*(?:{words})[A-Z0-9_-]*)(\s*[:=]\s*)("[^"]*"|''[^'']*''|[^\s,;&|]+)', '\1\2<redacted>', 'gi')"""
    )


@query(f"SELECT doc_id, {_assignments(_urls('text'))} AS text FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_text(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])


@query(f"SELECT page_id, {_assignments(_urls('html'))} AS html FROM pages")
def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_text(table(spark, sf_dir, "pages").select("page_id", "html"), ["html"])


LINK = r"""CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '://', '://user' || page_id || ':pa' || page_id || '@') WHEN 1 THEN regexp_replace(url, '://', '://key' || page_id || '@')
 ELSE url END || CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&Access_Token=t' || page_id ELSE '?x=1&sig=s' || page_id || '&y=2' END"""


@query(f"WITH p AS (SELECT page_id, {LINK} AS url FROM pages) SELECT page_id, {_urls('url')} AS url FROM p")
def redact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id"), F.col("url")
    n = k.cast("string")
    user = F.when(k % 4 == 0, F.replace(url, F.lit("://"), F.concat(F.lit("://user"), n, F.lit(":pa"), n, F.lit("@")))).when(
        k % 4 == 1, F.replace(url, F.lit("://"), F.concat(F.lit("://key"), n, F.lit("@")))
    ).otherwise(url)
    tail = F.when(url.contains("#"), "").when(url.contains("?"), F.concat(F.lit("&Access_Token=t"), n)).otherwise(
        F.concat(F.lit("?x=1&sig=s"), n, F.lit("&y=2"))
    )
    return redact_urls(table(spark, sf_dir, "pages").select("page_id", F.concat(user, tail).alias("url")), ["url"])


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'run --password <redacted> next' WHEN 1 THEN 'run --token=<redacted> --plain=1'
 WHEN 2 THEN 'run --secret <redacted> k' || o_orderkey WHEN 3 THEN '-sig <redacted> --url http://u:<redacted>@h/' || o_orderkey END AS args FROM orders"""
)
def redact_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = k.cast("string")
    lit = lambda *xs: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    args = (
        F.when(k % 4 == 0, lit("run", "--password", n, "next"))
        .when(k % 4 == 1, lit("run", F.concat(F.lit("--token="), n), "--plain=1"))
        .when(k % 4 == 2, lit("run", "--secret", "--token", F.concat(F.lit("k"), n)))
        .otherwise(lit("-sig", n, "--url", F.concat(F.lit("http://u:pw@h/"), n)))
    )
    return table(spark, sf_dir, "orders").select(k, F.array_join(redact_args(args), " ").alias("args"))


_SP = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_LINE = f"trim(regexp_replace(text, '{_SP}', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT doc_id, {_LINE} AS line FROM documents)
SELECT doc_id, CASE WHEN line = '' THEN '(empty)' WHEN length(line) > 240 THEN substring(line, 1, 237) || '...' ELSE line END AS summary FROM t"""
)
def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.compact(F.col("text"), 240, "(empty)").alias("summary"))


@query(
    """WITH m AS (SELECT event_id AS e, CASE event_type WHEN 'signup' THEN 'export' WHEN 'click' THEN 'import' WHEN 'purchase' THEN 'cdc' ELSE 'validation' END AS stage FROM events),
x AS (SELECT *, CASE WHEN stage IN ('export', 'import') THEN CASE WHEN e % 5 = 1 THEN 'rows_not_a_count' WHEN e % 7 = 2 THEN 'rows_and_bytes_must_come_together' WHEN e % 11 = 3 THEN 'digest_malformed' END
 WHEN stage = 'cdc' THEN CASE WHEN e % 3 = 0 THEN 'changes_missing' WHEN e % 4 = 1 THEN 'changes_not_a_count' END END AS err FROM m)
SELECT e AS event_id, COALESCE(err, '-') AS metrics_error, CASE WHEN err IS NULL AND stage IN ('export', 'import') THEN CAST(e + 1 AS VARCHAR) ELSE '-' END AS data_rows,
 CASE WHEN err IS NULL AND stage IN ('export', 'import') THEN CAST(e * 8 AS VARCHAR) ELSE '-' END AS data_bytes,
 CASE WHEN err IS NULL AND stage IN ('export', 'import') THEN 'sha256:' || sha256(CAST(e AS VARCHAR)) ELSE '-' END AS data_sha256,
 CASE WHEN err IS NULL AND stage = 'cdc' THEN CAST(e AS VARCHAR) ELSE '-' END AS applied_changes FROM x"""
)
def output_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    n = e.cast("string")
    kind = F.col("event_type")
    stage = F.when(kind == "signup", "export").when(kind == "click", "import").when(kind == "purchase", "cdc").otherwise("validation")
    verb, side = F.when(stage == "export", "exported").otherwise("imported"), F.when(stage == "export", "output").otherwise("input")
    digest = F.when(e % 11 == 3, "sha256:12").otherwise(F.concat(F.lit("sha256:"), F.sha2(n, 256)))
    moved = F.concat(
        F.lit("start\n  "), verb, F.lit(" rows: 7\n"), verb, F.lit(" rows: "), F.when(e % 5 == 1, "-3").otherwise((e + 1).cast("string")), F.lit("\r\n"),
        F.when(e % 7 == 2, "").otherwise(F.concat(side, F.lit(" bytes: "), (e * 8).cast("string"), F.lit("\n"))),
        side, F.lit(" sha256: "), digest, F.lit("\nend"),
    )
    changed = F.when(e % 3 == 0, "nothing").otherwise(F.concat(F.lit("applied changes: "), F.when(e % 4 == 1, "many").otherwise(n)))
    log = table(spark, sf_dir, "events").select(e, stage.alias("stage"), F.when(stage == "cdc", changed).when(stage == "validation", "ok").otherwise(moved).alias("output"))
    shown = ["metrics_error", "data_rows", "data_bytes", "data_sha256", "applied_changes"]
    return extract_metrics(log).select("event_id", *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in shown])


@query(
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'dbo.' || p_name WHEN 2 THEN 'db.dbo.t' WHEN 3 THEN 'a..b' ELSE 'a.b.c.d' END AS name,
 CASE p_partkey % 3 WHEN 0 THEN 'Decimal (18, 2)' WHEN 1 THEN ' NVARCHAR(max)' ELSE 'int' END AS type FROM part)
SELECT p_partkey, regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe, p_partkey % 5 IN (1, 2) AS source_ok, p_partkey % 5 IN (0, 1) AS target_ok,
 CASE p_partkey % 3 WHEN 0 THEN 'decimal' WHEN 1 THEN 'nvarchar' ELSE 'int' END AS base, CASE p_partkey % 3 WHEN 0 THEN '18, 2' WHEN 1 THEN 'max' ELSE '' END AS param,
 contains(upper(name), 'TODO') AS todo FROM t"""
)
def names_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, part = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 5 == 0, part).when(k % 5 == 1, F.concat(F.lit("dbo."), part)).when(k % 5 == 2, "db.dbo.t").when(k % 5 == 3, "a..b").otherwise("a.b.c.d")
    kind = F.when(k % 3 == 0, "Decimal (18, 2)").when(k % 3 == 1, " NVARCHAR(max)").otherwise("int")
    return table(spark, sf_dir, "part").select(
        k,
        S.safe_name(name).alias("safe"),
        S.source_name_ok(name).alias("source_ok"),
        S.target_name_ok(name).alias("target_ok"),
        S.type_base(kind).alias("base"),
        S.type_param(kind).alias("param"),
        S.has_todo(name).alias("todo"),
    )
