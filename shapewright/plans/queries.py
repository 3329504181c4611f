"""The engine's operators as queries over the driver's tables, each with the same result in DuckDB's SQL.

Every query runs the functions that a scan or a check runs. A folder of tables is a fileset of Parquet files; a document is a text file
of lines; a conversation is a file whose columns are its roles. What the tables don't hold (formats, layouts of folders, failings) is
written to small files first, and the rows that are expected of them are written out as SQL."""

from __future__ import annotations

import gzip
import io
import json
import os
import re
import shutil
import sqlite3
import tempfile
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapewright.functions import classes, names
from shapewright.functions.codes import SEVERITIES, let, severity
from shapewright.operators import anomalies, refine, structure
from shapewright.operators.baseline import Baseline, from_ddl, from_flat, from_golden, from_result, load
from shapewright.plans.scan import Check, check, scan
from shapewright.report import of_check, of_scan
from shapewright.sources import bytelevel, listing, readers

TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def of_rows(rows: DataFrame, schema: str, made: Callable[[dict], list[dict]]) -> DataFrame:
    """made of every row, in Arrow batches: for functions of the engine that work on one file."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_pylist([x for r in batch.slice(at, 256).to_pylist() for x in made(r)], fields)

    return rows.mapInArrow(run, schema)


def file_name(path: str = "path") -> Column:
    return F.regexp_extract(path, "([^/]*?)(?:\\.parquet)?$", 1)


def schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, position, column_name, type_class) by a scan of the tables' footers."""
    s = scan(spark, f"{sf_dir}/*.parquet")
    return s.columns.join(s.verdicts.select("file_id", file_name().alias("table_name")), "file_id").select("table_name", "position", F.col("raw_name").alias("column_name"), "type_class")


IN_TABLES = ", ".join(f"'{t}'" for t in TABLES)
#: A column of lists is its leaf, named element.
SCHEMA_SQL = f"""
 columns AS (SELECT table_name, ordinal_position, CASE WHEN data_type LIKE '%[]' THEN 'element' ELSE column_name END AS column_name, replace(data_type, '[]', '') AS data_type
  FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN ({IN_TABLES})),
 schema_rows AS (
  SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
   CASE WHEN data_type IN ('BIGINT','INTEGER','SMALLINT','TINYINT') THEN 'int' WHEN data_type IN ('DOUBLE','FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'decimal'
    WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type = 'BOOLEAN' THEN 'bool' WHEN data_type = 'DATE' THEN 'date' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' WHEN data_type = 'BLOB' THEN 'blob' ELSE 'any' END AS type_class FROM columns)"""

LINES_SQL = """
 files AS (SELECT doc_id, CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END AS text FROM documents WHERE text <> ''),
 lines AS (SELECT doc_id, CAST(z[1] AS BIGINT) AS rn, z[2] AS line FROM (
  SELECT doc_id, unnest(list_zip(range(1, len(string_split(text, chr(10))) + 1), string_split(text, chr(10)))) AS z FROM files)),
 lasts AS (SELECT doc_id, max(rn) AS total FROM lines GROUP BY doc_id),
 counts AS (SELECT doc_id, rn, CAST(length(line) - length(replace(line, ',', '')) AS BIGINT) AS n FROM lines WHERE line <> ''),
 modes AS (SELECT doc_id, n AS mode FROM (
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, n) AS k FROM counts GROUP BY doc_id, n) WHERE k = 1),
 odd AS (SELECT doc_id, rn, n, mode, rn = total AS is_last FROM counts JOIN modes USING (doc_id) JOIN lasts USING (doc_id) WHERE n <> mode)"""


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document as a file without a header, delimited by commas: what anomalies are told from."""

    def made(r: dict) -> list[dict]:
        data = (r["text"] or "").encode()
        counts = [readers.delimiters_in(line, ",") for line in bytelevel.lines_from(io.BytesIO(data), "utf-8")]
        return [{"doc_id": r["doc_id"], "counts": counts, "has_header": False, "ends_with_newline": bytelevel.ends_with_newline(io.BytesIO(data), len(data)), "size_bytes": len(data)}]

    # the line ends of Windows and old Macs are told by their own bytes; these files have one kind
    rows = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\r", " ").alias("text"))
    return of_rows(rows, "doc_id long, counts array<int>, has_header boolean, ends_with_newline boolean, size_bytes long", made)


def finding_of(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    """(doc_id, f): the findings of a code."""
    return line_files(spark, sf_dir).select("doc_id", F.explode(anomalies.file_findings()).alias("f")).where(F.col("f.reason_code") == code)


@query(f"WITH {LINES_SQL} SELECT doc_id, rn, n, mode FROM odd")
def raw_line_ragged(spark, sf_dir):
    """Lines whose count of delimiters isn't their document's commonest."""
    each = line_files(spark, sf_dir).select("doc_id", F.explode(let(anomalies.data_rows(), anomalies.deviating)).alias("r"))
    return each.select("doc_id", *[F.col(f"r.{c}").cast("bigint").alias(c) for c in ("rn", "n", "mode")])


@query(f"""WITH {LINES_SQL}, inner_rows AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS k FROM odd WHERE NOT is_last)
 SELECT doc_id, CAST(count(*) AS INTEGER) AS deviating, 'row ' || string_agg(CAST(rn AS VARCHAR), ', row ' ORDER BY rn) FILTER (WHERE k <= 5) || CASE WHEN count(*) > 5 THEN '...' ELSE '' END AS locus,
  CAST(min(mode) + 1 AS VARCHAR) AS expected, string_agg(CAST(n + 1 AS VARCHAR), ', ' ORDER BY rn) FILTER (WHERE k <= 5) AS found FROM inner_rows GROUP BY doc_id""")
def ragged_files(spark, sf_dir):
    """One finding a document: rows that deviate, but for its last."""
    return finding_of(spark, sf_dir, "RAGGED_ROWS").select("doc_id", F.col("f.confidence").alias("deviating"), "f.locus", "f.expected", "f.found")


@query(f"WITH {LINES_SQL} SELECT doc_id, 'row ' || rn AS locus, CAST(mode + 1 AS VARCHAR) AS expected, CAST(n + 1 AS VARCHAR) AS found, 'WARN' AS severity FROM odd WHERE is_last")
def trailing_summary(spark, sf_dir):
    """Documents whose last line deviates."""
    return finding_of(spark, sf_dir, "TRAILING_SUMMARY").select("doc_id", "f.locus", "f.expected", "f.found", "f.severity")


@query(f"""WITH {LINES_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rn) - 1 AS place FROM counts),
 marked AS (SELECT *, CASE WHEN n = lag(n) OVER (PARTITION BY doc_id ORDER BY rn) THEN 0 ELSE 1 END AS new FROM placed),
 runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY rn) AS run FROM marked),
 regimes AS (SELECT doc_id, min(place) AS start, n, count(*) AS length FROM runs GROUP BY doc_id, run, n HAVING count(*) >= 3)
 SELECT doc_id, start, n, length FROM regimes WHERE doc_id IN (SELECT doc_id FROM regimes GROUP BY doc_id HAVING count(*) >= 2)""")
def line_regimes(spark, sf_dir):
    """Runs of three lines or more with the same count, of documents that have two runs or more."""
    each = line_files(spark, sf_dir).select("doc_id", F.explode(let(anomalies.data_rows(), anomalies.regimes)).alias("r"))
    return each.select("doc_id", *[F.col(f"r.{c}").cast("bigint").alias(c) for c in ("start", "n", "length")])


@query("SELECT doc_id, octet_length(encode(t)) AS size_bytes, t = '' OR right(t, 1) = chr(10) AS ends_with_newline, t <> '' AND right(t, 1) <> chr(10) AND octet_length(encode(t)) >= 512 AS truncated FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def eof_newline(spark, sf_dir):
    """Whether a document's last byte ends a line, and whether that is told of."""
    told = F.exists(anomalies.file_findings(), lambda f: f["reason_code"] == "TRUNCATED")
    return line_files(spark, sf_dir).select("doc_id", "size_bytes", "ends_with_newline", told.alias("truncated"))


@query(f"WITH {SCHEMA_SQL} SELECT * FROM schema_rows")
def parquet_schema_profile(spark, sf_dir):
    return schema_rows(spark, sf_dir)


CASES = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{c}'" for c, p in classes.LADDER if c != "int")
TOKENS_SQL = f"tokens AS (SELECT doc_id, lang, t, CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN CASE WHEN TRY_CAST(t AS BIGINT) IS NULL THEN 'decimal' ELSE 'int' END {CASES} ELSE 'text' END AS cls FROM (SELECT doc_id, lang, unnest(string_split_regex(text, '[ \\t\\n]+')) AS t FROM documents) WHERE t <> '')"


def class_counts(spark, sf_dir):
    """(lang, cls, n, first) of each document's tokens: the class of a value, counted in its row."""

    def made(r: dict) -> list[dict]:
        n: Counter = Counter()
        for t, k in Counter(re.split("[ \t\n]+", r["text"] or "")).items():
            if t:
                n[classes.of_value(t)] += k
        return [{"lang": r["lang"], "cls": c, "n": k, "first": r["doc_id"]} for c, k in n.items()]

    each = of_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "lang string, cls string, n long, first long", made)
    return each.groupBy("lang", "cls").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


@query(f"WITH {TOKENS_SQL} SELECT lang, cls, count(*) AS n, min(doc_id) AS first_doc FROM tokens GROUP BY lang, cls")
def type_ladder_tokens(spark, sf_dir):
    """The class of each token by the ladder of patterns."""
    return class_counts(spark, sf_dir).withColumnRenamed("first", "first_doc")


@query(f"""WITH {TOKENS_SQL}, c AS (SELECT coalesce(lang, 'none') AS lang, cls, count(*) AS n, min(doc_id) AS first FROM tokens GROUP BY coalesce(lang, 'none'), cls),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first, cls) AS k FROM c)
 SELECT lang, max(CASE WHEN k = 1 THEN cls END) AS majority, count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS total FROM r GROUP BY lang HAVING count(*) > 1""")
def type_disagreement(spark, sf_dir):
    """Families (languages) whose values are of several classes: the commonest, the first seen of two as common."""
    lang = F.array(F.coalesce("lang", F.lit("none")))
    kinds = class_counts(spark, sf_dir).select(lang.alias("key"), F.col("cls").alias("type_key"), "first", F.col("n").alias("file_count"), lang.alias("names"), F.array("cls").alias("types"))
    found = refine.disagreements(kinds, refine.families_of(kinds))
    return found.select(F.col("name").alias("lang"), "majority", F.size("classes").cast("bigint").alias("n_classes"), "total")


#: A declared layout of documents that drifted: a new name, a missing column, a wider and a narrower type.
DECLARED = (("doc_id", "decimal"), ("body", "text"), ("lang", "int"), ("n_chars", "text"), ("source", "text"), ("added_on", "date"))
DECLARED_SQL = "declared(position, name, declared) AS (VALUES " + ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate(DECLARED)) + ")"
COMPAT_SQL = """CASE WHEN declared = 'any' OR type_class = 'any' OR declared = type_class THEN 'identical'
  WHEN declared = 'decimal' AND type_class = 'int' OR declared = 'int' AND type_class = 'bool' OR declared = 'timestamp' AND type_class = 'date' OR declared = 'text' AND type_class IN ('int', 'decimal', 'bool', 'date', 'timestamp', 'blob') THEN 'widening'
  ELSE 'breaking' END"""


def checked(spark: SparkSession, sf_dir: str, mode: str = "name") -> Check:
    """The folder of tables, held against the declared layout."""
    return check(spark, f"{sf_dir}/*.parquet", Baseline(DECLARED, "declared"), mode)


def told(spark: SparkSession, sf_dir: str, mode: str, *codes: str) -> DataFrame:
    """(table_name, f): the findings of some codes; none of the layout's own column names holds a quote."""
    return checked(spark, sf_dir, mode).partitioned.select(file_name().alias("table_name"), F.explode("findings").alias("f")).where(F.col("f.reason_code").isin(*codes))


def quoted() -> Column:
    return F.regexp_extract("f.locus", "'(.*)'", 1)


def place() -> Column:
    return F.regexp_extract("f.locus", "([0-9]+)$", 1).cast("int")


@query(f"""WITH {SCHEMA_SQL}, {DECLARED_SQL}, t AS (SELECT DISTINCT table_name FROM schema_rows)
 SELECT table_name, name, 'MISSING_COLUMN' AS reason_code, 'ERROR' AS severity, CAST(NULL AS VARCHAR) AS found FROM t, declared d WHERE NOT EXISTS (SELECT 1 FROM schema_rows s WHERE s.table_name = t.table_name AND s.column_name = d.name)
 UNION ALL SELECT table_name, column_name, 'EXTRA_COLUMN', 'ERROR', column_name FROM schema_rows WHERE column_name NOT IN (SELECT name FROM declared)
 UNION ALL SELECT table_name, name, 'TYPE_MISMATCH', CASE WHEN {COMPAT_SQL} = 'widening' THEN 'WARN' ELSE 'ERROR' END, type_class FROM schema_rows JOIN declared ON name = column_name WHERE {COMPAT_SQL} <> 'identical'""")
def name_mode_diff(spark, sf_dir):
    """Each table by name against the declared layout: what is missing, extra or of another type."""
    return told(spark, sf_dir, "name", "MISSING_COLUMN", "EXTRA_COLUMN", "TYPE_MISMATCH").select("table_name", quoted().alias("name"), "f.reason_code", "f.severity", "f.found")


@query(f"""WITH {SCHEMA_SQL}, {DECLARED_SQL} SELECT table_name, s.position, d.name AS expected, s.column_name AS found FROM schema_rows s JOIN declared d ON d.position = s.position
 WHERE s.column_name NOT IN (SELECT name FROM declared) AND NOT EXISTS (SELECT 1 FROM schema_rows o WHERE o.table_name = s.table_name AND o.column_name = d.name)""")
def rename_evidence(spark, sf_dir):
    """A name that is missing and one that is extra at the same position."""
    return told(spark, sf_dir, "name", "COLUMN_NAME_MISMATCH").select("table_name", place().alias("position"), "f.expected", "f.found")


@query(f"""WITH {SCHEMA_SQL}, {DECLARED_SQL} SELECT table_name, CAST(-1 AS INTEGER) AS position, 'COUNT_CHANGED' AS reason_code, 'ERROR' AS severity, CAST(count(*) AS VARCHAR) AS found FROM schema_rows GROUP BY table_name HAVING count(*) <> {len(DECLARED)}
 UNION ALL SELECT table_name, s.position, 'TYPE_MISMATCH', CASE WHEN {COMPAT_SQL} = 'widening' THEN 'WARN' ELSE 'ERROR' END, type_class FROM schema_rows s JOIN declared d ON d.position = s.position WHERE {COMPAT_SQL} <> 'identical'""")
def position_mode_diff(spark, sf_dir):
    """Each table by position: its count of columns, and the types at shared positions."""
    return told(spark, sf_dir, "position", "COUNT_CHANGED", "TYPE_MISMATCH").select("table_name", F.when(F.col("f.reason_code") == "COUNT_CHANGED", -1).otherwise(place()).alias("position"), "f.reason_code", "f.severity", "f.found")


@query(f"WITH {SCHEMA_SQL}, {DECLARED_SQL} SELECT table_name, s.position, d.name AS expected, s.column_name AS found, 'WARN' AS severity FROM schema_rows s JOIN declared d ON d.position = s.position WHERE d.name <> s.column_name")
def position_name_swap(spark, sf_dir):
    """Other names at shared positions, which a load by position doesn't notice."""
    return told(spark, sf_dir, "position", "COLUMN_NAME_MISMATCH").select("table_name", place().alias("position"), "f.expected", "f.found", "f.severity")


@query(f"""WITH {SCHEMA_SQL}, {DECLARED_SQL}, n AS (SELECT table_name, count(*) AS n, bool_or(name <> column_name) AS moved, bool_or({COMPAT_SQL} = 'breaking') AS wrong, bool_or({COMPAT_SQL} = 'widening') AS wider FROM schema_rows s LEFT JOIN declared d ON d.position = s.position GROUP BY table_name),
 v AS (SELECT 'name' AS mode, table_name, 'broken' AS p FROM n
  UNION ALL SELECT 'position', table_name, CASE WHEN n <> {len(DECLARED)} OR wrong THEN 'broken' WHEN moved OR wider THEN 'warned' ELSE 'golden' END FROM n)
 SELECT mode, p AS partition, count(*) AS files FROM v GROUP BY mode, p""")
def check_partition(spark, sf_dir):
    """Verdicts by name (no table has all declared columns) and by position: golden, warned, broken."""
    both = [checked(spark, sf_dir, mode).partitioned.select(F.lit(mode).alias("mode"), "partition") for mode in ("name", "position")]
    return both[0].unionByName(both[1]).groupBy("mode", "partition").agg(F.count("*").alias("files"))


@query("SELECT p_partkey, regexp_replace(lower(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS canonical, raw <> regexp_replace(lower(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS was_transformed FROM (SELECT p_partkey, ' ' || upper(p_name) || chr(9) || ' ' || p_type || '  ' AS raw FROM part)")
def canonicalize_names(spark, sf_dir):
    """Names stripped, lower-cased, their white space collapsed, as a scan does it; the steps in columns tell whether anything changed."""
    raw = F.concat(F.lit(" "), F.upper("p_name"), F.lit("\t "), F.col("p_type"), F.lit("  "))
    t = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), names.trace(raw)["was_transformed"].alias("was_transformed"))
    return of_rows(t, "p_partkey long, canonical string, was_transformed boolean", lambda r: [{"p_partkey": r["p_partkey"], "canonical": names.canonical(r["raw"]), "was_transformed": r["was_transformed"]}])


WORDS_SQL = "w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '')) AS s FROM documents)"


def word_sets(spark, sf_dir):
    """Hashes of words: the sets are as large as texts, and are sent to their neighbours."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.transform(F.filter(F.split("text", "[ \\t\\n]+", -1), lambda x: x != ""), lambda x: F.xxhash64(x))).alias("s"))


@query(f"WITH {WORDS_SQL} SELECT a.doc_id, CASE WHEN len(list_distinct(list_concat(a.s, b.s))) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1")
def jaccard_overlap(spark, sf_dir):
    """Likeness of each document's set of words to the next one's."""
    w = word_sets(spark, sf_dir)
    after = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("b"))
    return w.join(after, "doc_id").select("doc_id", structure.jaccard(F.col("s"), F.col("b")).alias("jaccard"))


SETS_SQL = f"""WITH {SCHEMA_SQL}, firsts AS (SELECT table_name, type_class, min(position) AS p FROM schema_rows GROUP BY table_name, type_class),
 sets AS (SELECT table_name, list(type_class ORDER BY p) AS s FROM firsts GROUP BY table_name),
 pairs AS (SELECT a.table_name AS a_name, b.table_name AS b_name, a.s AS a, b.s AS b, list_sort(list_filter(a.s, lambda x: NOT list_contains(b.s, x))) AS more, list_sort(list_filter(b.s, lambda x: NOT list_contains(a.s, x))) AS less
  FROM sets a JOIN sets b ON a.table_name < b.table_name AND len(list_intersect(a.s, b.s)) > 0)"""


def class_sets(spark, sf_dir):
    """(family_id, key, representative_columns): tables as families of the classes that they hold, in the order of their first columns."""
    first = schema_rows(spark, sf_dir).groupBy("table_name", "type_class").agg(F.min("position").alias("p"))
    sets = first.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "type_class"))), lambda x: x["type_class"]).alias("s"))
    return sets.select(F.col("table_name").alias("family_id"), structure.set_key(F.col("s")).alias("key"), F.col("s").alias("representative_columns"))


@query(f"{SETS_SQL} SELECT a_name, b_name, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS jaccard, CASE WHEN len(more) = 0 AND len(less) = 0 THEN 'exact' WHEN len(less) = 0 THEN 'superset' WHEN len(more) = 0 THEN 'subset' ELSE 'overlapping' END AS relation FROM pairs")
def structural_relation_pairs(spark, sf_dir):
    """How tables that share a class relate."""
    return structure.overlaps(class_sets(spark, sf_dir)).select(F.col("a_id").alias("a_name"), F.col("b_id").alias("b_name"), "jaccard", "relation")


@query(f"""{SETS_SQL} SELECT a_name, b_name, CASE WHEN a = b THEN 'exact match' WHEN len(more) = 0 AND len(less) = 0 THEN 'same columns, different order'
  ELSE concat_ws('; ', CASE WHEN len(less) > 0 THEN 'missing: [' || array_to_string(less, ', ') || ']' END, CASE WHEN len(more) > 0 THEN 'extra: [' || array_to_string(more, ', ') || ']' END) END AS diff FROM pairs""")
def describe_diff(spark, sf_dir):
    return structure.overlaps(class_sets(spark, sf_dir)).select(F.col("a_id").alias("a_name"), F.col("b_id").alias("b_name"), structure.described(F.col("a_columns"), F.col("b_columns")).alias("diff"))


@query("SELECT key, count(*) AS events, min(event_id) AS first_event FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def json_field_set(spark, sf_dir):
    """Top-level fields of JSON objects, with the first that has each."""
    rows = table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", "props")
    keys = of_rows(rows, "event_id long, key string", lambda r: [{"event_id": r["event_id"], "key": k} for k in readers.read_json(io.BytesIO(r["props"].encode()), "utf-8", True).names or ()])
    return keys.groupBy("key").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def scored_sql(source: str, key: str, text: str, most: str = "") -> str:
    """Tables h (the first 20 lines that aren't blank) and best (delimiter, score) of texts."""
    return f"""l AS (SELECT {key}, line, row_number() OVER (PARTITION BY {key} ORDER BY rn) AS k FROM (
  SELECT {key}, z[1]::BIGINT AS rn, z[2] AS line FROM (SELECT {key}, unnest(list_zip(range(1, len(string_split({text}, chr(10))) + 1), string_split({text}, chr(10)))) AS z FROM {source})) WHERE regexp_matches(line, '[^\\s]')),
 h AS (SELECT * FROM l WHERE k <= 20), d(delimiter, rank) AS (VALUES (chr(9), 1), ('|', 2), (';', 3), (',', 4)),
 c AS (SELECT {key}, delimiter, rank, length(line) - length(replace(line, delimiter, '')) AS n FROM h, d),
 g AS (SELECT {key}, delimiter, rank, n, count(*) AS k FROM c WHERE n > 0 GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY {key}, delimiter ORDER BY k DESC, n) AS r FROM g),
 t AS (SELECT {key}, count(*) AS lines FROM h GROUP BY {key}),
 s AS (SELECT {key}, delimiter, rank, CAST(b.k AS DOUBLE) / t.lines * b.n AS score FROM b JOIN t USING ({key}) WHERE r = 1),
 best AS (SELECT {key}, delimiter, score FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, rank) AS r FROM s) WHERE r = 1)"""


@query(f"""WITH {scored_sql('pages', 'page_id', 'html')}, w AS (SELECT page_id, count(*) AS n, count(DISTINCT length(line)) AS widths FROM h GROUP BY page_id)
 SELECT page_id, octet_length(encode(html)) AS size_bytes, 'utf-8' AS encoding, CASE WHEN html = '' THEN 'unknown' WHEN html LIKE '<?xml%' THEN 'xml' WHEN left(ltrim(html), 1) IN ('{{', '[') THEN 'json'
  WHEN delimiter = chr(9) THEN 'tsv' WHEN delimiter IS NOT NULL THEN 'csv' WHEN n > 1 AND widths <= 2 THEN 'fixed-width' ELSE 'text' END AS format FROM pages LEFT JOIN best USING (page_id) LEFT JOIN w USING (page_id)""")
def magic_sniff(spark, sf_dir):
    """Encoding and format of pages, as files of markup, by their bytes: none of the magic numbers, so the shape of their lines tells."""

    def made(r: dict) -> list[dict]:
        data = (r["html"] or "").encode()
        head = data[: bytelevel.HEAD]
        encoding, _ = bytelevel.encoding_of(head)
        return [{"page_id": r["page_id"], "size_bytes": len(data), "encoding": encoding, "format": bytelevel.format_of(head, encoding, ".html")[0]}]

    return of_rows(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id long, size_bytes long, encoding string, format string", made)


@query(f"WITH {scored_sql('documents', 'doc_id', 'text')} SELECT doc_id, delimiter, score FROM best")
def delimiter_score(spark, sf_dir):
    """Of each document's first 20 lines that aren't blank: the delimiter whose commonest count, times the share of lines that have it, is largest."""

    def made(r: dict) -> list[dict]:
        lines = [x for x in (r["text"] or "").split("\n") if x.strip()][:20]
        best, score = bytelevel.delimiter_score(lines)
        return [{"doc_id": r["doc_id"], "delimiter": best, "score": score}] if best else []

    return of_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id long, delimiter string, score double", made)


ROLES_SQL = """
 files AS (SELECT conv_id, list(role ORDER BY turn) AS names, list_sort(list_distinct(list(role))) AS key, CAST(count(*) AS VARCHAR) AS type_key FROM conversations GROUP BY conv_id),
 grouped AS (SELECT key, min(conv_id) AS first_file, count(*) AS file_count, arg_min(names, conv_id) AS rep, count(DISTINCT type_key) AS type_variants FROM files GROUP BY key),
 families AS (SELECT printf('F%04d', row_number() OVER (ORDER BY first_file)) AS family_id, * FROM grouped)"""


def role_files(spark, sf_dir):
    """Conversations as files whose columns are roles in order, and whose type profile is their number of turns."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("norm_names"))
    return rows.select(F.col("conv_id").alias("file_id"), "norm_names", structure.set_key(F.col("norm_names")).alias("key"), F.size("norm_names").cast("string").alias("type_key"))


def role_kinds(spark, sf_dir):
    first = F.min_by("norm_names", "file_id").alias("names")
    return role_files(spark, sf_dir).groupBy("key", "type_key").agg(F.min("file_id").alias("first"), F.count("*").alias("file_count"), first)


@query(f"WITH {ROLES_SQL} SELECT family_id, array_to_string(key, '|') AS key, first_file, file_count, array_to_string(rep, ',') AS representative FROM families")
def family_grouping(spark, sf_dir):
    """Files with the same set of names, numbered by their first file."""
    f = refine.families_of(role_kinds(spark, sf_dir))
    return f.select("family_id", F.array_join("key", "|").alias("key"), F.col("first_file_id").alias("first_file"), "file_count", F.array_join("representative_columns", ",").alias("representative"))


@query(f"WITH {ROLES_SQL} SELECT family_id, file_count, CAST(len(rep) AS INTEGER) AS column_count, type_variants FROM families")
def family_summary(spark, sf_dir):
    f = refine.families_of(role_kinds(spark, sf_dir))
    return f.select("family_id", "file_count", "column_count", F.col("type_variants").cast("bigint").alias("type_variants"))


@query(f"""WITH {ROLES_SQL}, kinds AS (SELECT family_id, type_key, min(conv_id) AS first_file, count(*) AS file_count FROM files JOIN families USING (key) GROUP BY family_id, files.type_key)
 SELECT printf('V%04d', row_number() OVER (ORDER BY family_id, first_file)) AS variant_id, family_id, type_key FROM kinds""")
def type_variants(spark, sf_dir):
    """Type profiles inside families, numbered over families and first files."""
    k = role_kinds(spark, sf_dir)
    return refine.variants_of(k, refine.families_of(k)).select("variant_id", "family_id", "type_key")


@query("""SELECT * FROM (VALUES ('MISSING_COLUMN', 'name', 'ERROR'), ('MISSING_COLUMN', 'position', 'ERROR'), ('EXTRA_COLUMN', 'name', 'ERROR'), ('EXTRA_COLUMN', 'position', 'ERROR'),
 ('TYPE_MISMATCH', 'name', 'ERROR'), ('TYPE_MISMATCH', 'position', 'ERROR'), ('COLUMN_NAME_MISMATCH', 'name', 'ERROR'), ('COLUMN_NAME_MISMATCH', 'position', 'WARN'), ('COUNT_CHANGED', 'name', 'INFO'), ('COUNT_CHANGED', 'position', 'ERROR'),
 ('RAGGED_ROWS', NULL, 'ERROR'), ('MULTI_RECORD', NULL, 'WARN'), ('TRUNCATED', NULL, 'ERROR'), ('TRAILING_SUMMARY', NULL, 'WARN'), ('ENCODING_FALLBACK', NULL, 'WARN'), ('FORMAT_UNRECOGNIZED', NULL, 'INFO'), ('NESTED_ARCHIVE', NULL, 'WARN'),
 ('ENCRYPTED_ARCHIVE', NULL, 'WARN'), ('PERMISSION_DENIED', NULL, 'ERROR'), ('DECODE_ERROR', NULL, 'ERROR'), ('CORRUPT_ARCHIVE', NULL, 'ERROR'), ('HEADERLESS_NAME_MODE', NULL, 'ERROR'), ('FILE_COUNT_CEILING', NULL, 'WARN'), ('BYTE_CEILING', NULL, 'WARN'),
 ('RECURSION_DEPTH_CEILING', NULL, 'WARN')) t(reason_code, mode, severity)""")
def severity_projection(spark, sf_dir):
    """The severity of every code, under each mode where a mode changes it."""
    rows = [(c, m or None, severity(c, m or None)) for c, by in SEVERITIES.items() for m in by]
    return spark.createDataFrame(rows, "reason_code string, mode string, severity string")


@query("WITH c(x) AS (VALUES " + ", ".join(f"('{c}')" for c in classes.CLASSES) + f"), p AS (SELECT a.x AS declared, b.x AS type_class FROM c a, c b) SELECT declared, type_class, {COMPAT_SQL} AS compatibility FROM p")
def type_compatibility_matrix(spark, sf_dir):
    every = F.array(*[F.lit(c) for c in classes.CLASSES])
    p = spark.range(1).select(F.explode(every).alias("declared")).select("declared", F.explode(every).alias("type_class"))
    return p.withColumn("compatibility", classes.compatibility_column(F.col("declared"), F.col("type_class")))


#: Spellings of types, as baselines write them.
SPELLINGS = (" BigInt ", "DECIMAL(10,2)", "Varchar (20)", "STRUCT(a INT)", "BIGINT[]", "TIME", "uuid", "", "int", "hugeint", "Double", "money", "bit", "DATE", "datetime", "timestamp with time zone", "TIMESTAMP_NS", "enum", "nchar(3)", "bytea", "*", "json")


@query("""SELECT * FROM (VALUES (' BigInt ', 'int'), ('DECIMAL(10,2)', 'decimal'), ('Varchar (20)', 'text'), ('STRUCT(a INT)', 'any'), ('BIGINT[]', 'any'), ('TIME', 'any'), ('uuid', 'any'), ('', 'any'), ('int', 'int'), ('hugeint', 'int'), ('Double', 'decimal'), ('money', 'decimal'),
 ('bit', 'bool'), ('DATE', 'date'), ('datetime', 'timestamp'), ('timestamp with time zone', 'timestamp'), ('TIMESTAMP_NS', 'timestamp'), ('enum', 'text'), ('nchar(3)', 'text'), ('bytea', 'blob'), ('*', 'any'), ('json', 'any')) t(name, cls)""")
def type_alias_normalize(spark, sf_dir):
    return spark.createDataFrame([(n, classes.normalize(n)) for n in SPELLINGS], "name string, cls string")


@query(f"SELECT count(*) AS files_seen, count(*) AS profiled, 0::BIGINT AS degraded, 0::BIGINT AS catalogued, 0::BIGINT AS refused, true AS reconciles FROM information_schema.tables WHERE table_schema = 'main' AND table_name IN ({IN_TABLES})")
def accounting(spark, sf_dir):
    """Files by bucket; the buckets add up to all."""
    told = scan(spark, f"{sf_dir}/*.parquet").to_dict()["accounting"]
    return spark.createDataFrame([tuple(told.values())], "files_seen long, profiled long, degraded long, catalogued long, refused long, reconciles boolean")


#: Ceilings on documents, as files by source and id, of the size of their texts.
CEILINGS = listing.Limits(file_count=900, total_bytes=500_000)


def ceilings(spark, sf_dir) -> listing.Listing:
    """What the ceilings say: one row beyond the first is all that has to be seen, besides the number of all."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    first = docs.orderBy("path").limit(CEILINGS.file_count + 1).collect()  # a top-k, as long as the ceiling
    return listing.within([(r.path, r.size) for r in first], "documents", CEILINGS)


FILES_SQL = "files AS (SELECT coalesce(source, 'none') || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, octet_length(encode(coalesce(text, ''))) AS size FROM documents)"


@query(f"WITH {FILES_SQL}, r AS (SELECT path, size, row_number() OVER (ORDER BY path) - 1 AS file_id FROM files) SELECT file_id, path, size AS size_bytes FROM r WHERE file_id < 900")
def file_count_ceiling(spark, sf_dir):
    """The files by path, up to the ceiling."""
    return spark.createDataFrame(ceilings(spark, sf_dir).files, "file_id long, path string, size_bytes long")


@query(f"""WITH {FILES_SQL}, r AS (SELECT path, row_number() OVER (ORDER BY path) AS k, sum(size) OVER (ORDER BY path) AS running FROM files)
 SELECT 'BYTE_CEILING' AS reason_code, path AS locus, CAST(running AS VARCHAR) || ' bytes' AS found FROM (SELECT * FROM r WHERE running > 500000 AND k <= 900 ORDER BY k LIMIT 1)
 UNION ALL SELECT 'FILE_COUNT_CEILING', 'fileset', '901' FROM (SELECT count(*) AS n FROM files) WHERE n > 900""")
def byte_ceiling(spark, sf_dir):
    """The file at which the running sum of sizes passes the ceiling; and that there are files beyond the ceiling on their number."""
    return spark.createDataFrame([(f[0], f[2], f[4]) for f in ceilings(spark, sf_dir).findings], "reason_code string, locus string, found string")


@query("""SELECT * FROM (VALUES ('a.csv', 'id', 1, 0.25), ('a.csv', 'name', 2, 0.5), ('a.csv', 'n', 0, 0.0), ('b.tsv', 'id', 0, 0.0), ('b.tsv', 'name', 3, 1.0), ('c.parquet', 'x', NULL, NULL)) t(file, "column", nulls, null_fraction)""")
def null_observation(spark, sf_dir):
    """What share of each column's values is empty among the rows that were typed, as an observation; of footers nothing is said."""

    def write(folder: str) -> None:
        import pyarrow.parquet as pq

        put(folder, "a.csv", "id,name,n\n1,,2\n2,b,3\n3, ,4\n,d,5\n")
        put(folder, "b.tsv", "id\tname\n1\t\n2\t\n3\t\n")
        pq.write_table(pa.table({"x": [1, None]}), os.path.join(folder, "c.parquet"))

    def made(folder: str) -> DataFrame:
        s = scan(spark, folder)
        return s.columns.join(s.verdicts.select("file_id", F.substring_index("path", "/", -1).alias("file")), "file_id").select("file", F.col("norm_name").alias("column"), "nulls", "null_fraction")

    return written(spark, write, made)


@query("SELECT event_id FROM (SELECT event_id, CAST(event_id + 1 AS HUGEINT) AS n FROM events) WHERE n <= 2000 OR (n * 2654435761 % 4294967296) * (n - 1000) < 1000::HUGEINT * 4294967296")
def bounded_sample(spark, sf_dir):
    """Which rows of a long file are typed: the first ones, and a share of later ones that thins out; the same ones at each run."""
    return of_rows(table(spark, sf_dir, "events").select("event_id"), "event_id long", lambda r: [r] if readers.is_typed(r["event_id"] + 1) else [])


DDL = """-- a comment
CREATE TABLE IF NOT EXISTS "shop"."orders" (
  order_id BIGINT NOT NULL, check_date DATE, /* totals */ amount DECIMAL(10, 2) DEFAULT 0,
  "unique_id" VARCHAR(40), placed TIMESTAMP WITH TIME ZONE, PRIMARY KEY (order_id), CONSTRAINT c CHECK (amount > 0));
CREATE TABLE other (x INT);"""
FLAT = "# declared\norder_id, int\nCheck Date , date\nnotes\n"


@query("SELECT * FROM (VALUES ('ddl', 0, 'order_id', 'int'), ('ddl', 1, 'check_date', 'date'), ('ddl', 2, 'amount', 'decimal'), ('ddl', 3, 'unique_id', 'text'), ('ddl', 4, 'placed', 'timestamp'), ('flat', 0, 'order_id', 'int'), ('flat', 1, 'check date', 'date'), ('flat', 2, 'notes', 'any')) t(door, position, name, type_class)")
def ddl_flat_baselines(spark, sf_dir):
    """Baselines from a CREATE TABLE and from a flat schema."""
    with tempfile.NamedTemporaryFile("w", suffix=".schema") as f:
        f.write(FLAT)
        f.flush()
        doors = {"ddl": from_ddl(DDL), "flat": from_flat(f.name)}
    out = None
    for door, b in doors.items():
        t = b.table(spark).select(F.lit(door).alias("door"), "position", "name", "type_class")
        out = t if out is None else out.unionByName(t)
    return out


@query(f"WITH {SCHEMA_SQL} SELECT table_name || '.parquet' AS file, 'profiled' AS bucket, 'conforms' AS verdict, 'parquet' AS format, CAST(count(*) AS INTEGER) AS column_count, CAST(0 AS INTEGER) AS n_findings FROM schema_rows GROUP BY table_name")
def scan_verdicts(spark, sf_dir):
    """A scan of the folder of tables: a verdict for each file."""
    v = scan(spark, f"{sf_dir}/*.parquet").verdicts
    return v.select(F.substring_index("path", "/", -1).alias("file"), "bucket", "verdict", F.col("format_detected").alias("format"), "column_count", F.size("findings").alias("n_findings"))


def written(spark: SparkSession, write: Callable[[str], None], made: Callable[[str], DataFrame]) -> DataFrame:
    """made(folder) of files that write puts into it: a folder of the driver, and one that executors share where the session names one.

    The result is a few rows, which are fetched before the files go."""
    local, shared = tempfile.mkdtemp(prefix="shapewright-"), spark.conf.get("spark.checkpoint.dir", None)
    at = None
    try:
        write(local)
        folder = local
        if shared and not spark.sparkContext.master.startswith("local["):
            jvm = spark.sparkContext._jvm
            folder = f"{shared.rstrip('/')}/{os.path.basename(local)}"
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{local}"), at)
        v = made(folder)
        return spark.createDataFrame(v.collect(), v.schema)
    finally:
        shutil.rmtree(local)
        if at is not None:
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def put(folder: str, name: str, data: bytes | str) -> str:
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return path


def zoo(folder: str) -> None:
    """One small file of every format and failing that a scan tells apart."""
    import pyarrow.parquet as pq

    rows = "id,name,amount\n" + "".join(f"{i},n{i},{i}.5\n" for i in range(30))
    put(folder, "plain.csv", rows)
    put(folder, "mark.csv", b"\xef\xbb\xbf" + rows.encode())
    put(folder, "wide.csv", rows.encode("utf-16"))
    put(folder, "wide_be.csv", rows.encode("utf-16-be"))
    put(folder, "latin.csv", rows.replace("n3", "nö").encode("latin-1"))
    put(folder, "tabs.tsv", rows.replace(",", "\t"))
    put(folder, "pipes.csv", rows.replace(",", "|"))
    put(folder, "headless.csv", "1,2.5,x\n2,3.5,y\n3,4.5,z\n")
    put(folder, "quoted.csv", 'id,note\n1,"a, b"\n2,"c\nd"\n3,e\n')
    put(folder, "open_quote.csv", 'id,"name,n\n1,a,2\n3,b,4\n5,c\n6,d,7\n')
    put(folder, "digits.csv", "id,n\n1," + "7" * 6_000 + "\n2,3\n")
    put(folder, "blank_lines.csv", "id,name\n1,a\n\n\n2,b\n3,c,d\n4,e\n")
    put(folder, "total.csv", rows + "total,9\n")
    put(folder, "stacked.csv", rows + "1,2\n" * 5 + "end\n")
    put(folder, "cut.csv", (rows * 3).rstrip("\n"))
    put(folder, "dates.csv", "day,seen,flag\n2024-01-31,2024-01-31 10:00:00,true\n2024-02-01,2024-02-01T11:30:00Z,false\n")
    put(folder, "lines.jsonl", '{"a": 1, "b": "x"}\n{"b": "y", "c": null}\n')
    put(folder, "list.json", '[{"a": 1}, {"d": {"e": 2}}]')
    put(folder, "broken.json", '{"a": 1')
    put(folder, "tree.xml", "<?xml version='1.0'?><r xmlns:n='u'><n:item><v>1</v></n:item><item/></r>")
    put(folder, "broken.xml", "<?xml version='1.0'?><r><a></r>")
    put(folder, "late.csv", (rows * 2000).encode() + b"9,\xff,1\n")
    put(folder, "packed.csv.gz", gzip.compress(rows.encode()))
    put(folder, "cut.csv.gz", gzip.compress((rows * 900).encode())[:-40])
    put(folder, "notes.md", "a,b\n1,2\n")
    put(folder, "prose.log", "one line of words\nand another, longer one of them\nlast\n")
    put(folder, "empty.csv", b"")
    pq.write_table(pa.table({"a": [{"x": 1, "y": {"z": "s"}}], "b": [[1.5]], "d": [True]}), os.path.join(folder, "nested.parquet"))
    with zipfile.ZipFile(os.path.join(folder, "one.zip"), "w") as z:
        z.writestr("a.csv", rows)
    with zipfile.ZipFile(os.path.join(folder, "nested.zip"), "w") as z:
        z.writestr("a.zip", b"x")
    put(folder, "bad.zip", b"PK\x03\x04 and nothing more")
    locked = io.BytesIO()
    with zipfile.ZipFile(locked, "w") as z:
        z.writestr("a.csv", rows)
    data = bytearray(locked.getvalue())
    data[data.index(b"PK\x01\x02") + 8] |= 1  # the flag of an encrypted member in the directory
    put(folder, "locked.zip", bytes(data))
    db = sqlite3.connect(os.path.join(folder, "data.sqlite"))
    db.execute("CREATE TABLE t (id INTEGER, v TEXT)")
    db.commit()
    db.close()
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>id</t></is></c><c r="B1" t="inlineStr"><is><t>amount</t></is></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2"><v>2.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(os.path.join(folder, "book.xlsx"), "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets><sheet name='s'/></sheets></workbook>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)


@query("""SELECT * FROM (VALUES
 ('bad.zip', 'degraded', 'conforms', 'zip', NULL, NULL, NULL, NULL, NULL, ''),
 ('blank_lines.csv', 'profiled', 'broken', 'csv', 'utf-8', ',', true, 'id,name', NULL, 'RAGGED_ROWS@row 6'),
 ('book.xlsx', 'profiled', 'conforms', 'excel', NULL, NULL, true, 'id,amount', 'int,decimal', ''),
 ('broken.json', 'degraded', 'conforms', 'jsonl', 'utf-8', NULL, NULL, NULL, NULL, ''),
 ('broken.xml', 'degraded', 'conforms', 'xml', 'utf-8', NULL, NULL, NULL, NULL, ''),
 ('cut.csv', 'profiled', 'broken', 'csv', 'utf-8', ',', true, 'id,name,amount', 'text,text,text', 'TRUNCATED@EOF'),
 ('cut.csv.gz', 'refused', 'broken', 'gzip', 'utf-8', NULL, NULL, NULL, NULL, 'CORRUPT_ARCHIVE@file compression'),
 ('data.sqlite', 'profiled', 'conforms', 'sqlite', NULL, NULL, NULL, 'id,v', NULL, ''),
 ('dates.csv', 'profiled', 'conforms', 'csv', 'utf-8', ',', true, 'day,seen,flag', 'date,timestamp,bool', ''),
 ('digits.csv', 'profiled', 'conforms', 'csv', 'utf-8', ',', true, 'id,n', 'int,decimal', ''),
 ('empty.csv', 'catalogued', 'conforms', 'unknown', NULL, NULL, NULL, NULL, NULL, ''),
 ('headless.csv', 'profiled', 'conforms', 'csv', 'utf-8', ',', false, 'column0,column1,column2', 'int,decimal,text', ''),
 ('late.csv', 'refused', 'broken', 'csv', 'utf-8', ',', true, 'id,name,amount', 'text,text,text', 'DECODE_ERROR@file decoding'),
 ('latin.csv', 'profiled', 'conforms', 'csv', 'latin-1', ',', true, 'id,name,amount', 'int,text,decimal', 'ENCODING_FALLBACK@file encoding'),
 ('lines.jsonl', 'profiled', 'conforms', 'jsonl', 'utf-8', NULL, NULL, 'a,b,c', NULL, ''),
 ('list.json', 'profiled', 'conforms', 'json', 'utf-8', NULL, NULL, 'a,d', NULL, ''),
 ('locked.zip', 'refused', 'conforms', 'zip', NULL, NULL, NULL, NULL, NULL, 'ENCRYPTED_ARCHIVE@file container'),
 ('mark.csv', 'profiled', 'conforms', 'csv', 'utf-8-sig', ',', true, 'id,name,amount', 'int,text,decimal', ''),
 ('nested.parquet', 'profiled', 'conforms', 'parquet', NULL, NULL, NULL, 'x,z,element,d', 'int,text,decimal,bool', ''),
 ('nested.zip', 'catalogued', 'conforms', 'zip', NULL, NULL, NULL, NULL, NULL, 'NESTED_ARCHIVE@file container'),
 ('notes.md', 'catalogued', 'conforms', 'text', 'utf-8', NULL, NULL, NULL, NULL, ''),
 ('one.zip', 'catalogued', 'conforms', 'zip', NULL, NULL, NULL, NULL, NULL, ''),
 ('open_quote.csv', 'profiled', 'broken', 'csv', 'utf-8', ',', true, 'id,name,n', NULL, 'RAGGED_ROWS@row 4'),
 ('packed.csv.gz', 'profiled', 'conforms', 'gzip', 'utf-8', ',', true, 'id,name,amount', NULL, ''),
 ('pipes.csv', 'profiled', 'conforms', 'csv', 'utf-8', '|', true, 'id,name,amount', 'int,text,decimal', ''),
 ('plain.csv', 'profiled', 'conforms', 'csv', 'utf-8', ',', true, 'id,name,amount', 'int,text,decimal', ''),
 ('prose.log', 'profiled', 'broken', 'csv', 'utf-8', ',', true, 'one line of words', NULL, 'RAGGED_ROWS@row 2'),
 ('quoted.csv', 'profiled', 'broken', 'csv', 'utf-8', ',', true, 'id,note', 'int,text', 'RAGGED_ROWS@row 2, row 4'),
 ('stacked.csv', 'profiled', 'broken', 'csv', 'utf-8', ',', true, 'id,name,amount', NULL, 'RAGGED_ROWS@row 32, row 33, row 34, row 35, row 36 TRAILING_SUMMARY@row 37 MULTI_RECORD@file structure'),
 ('tabs.tsv', 'profiled', 'conforms', 'tsv', 'utf-8', chr(9), true, 'id,name,amount', 'int,text,decimal', ''),
 ('total.csv', 'profiled', 'conforms', 'csv', 'utf-8', ',', true, 'id,name,amount', NULL, 'TRAILING_SUMMARY@row 32'),
 ('tree.xml', 'profiled', 'conforms', 'xml', 'utf-8', NULL, NULL, 'r,r/item,r/item/v', NULL, ''),
 ('wide.csv', 'profiled', 'broken', 'csv', 'utf-16-le', ',', true, 'id,name,amount', 'int,text,decimal', 'TRUNCATED@EOF'),
 ('wide_be.csv', 'profiled', 'conforms', 'csv', 'utf-16-be', ',', true, 'id,name,amount', 'int,text,decimal', '')
 ) t(file, bucket, verdict, format, encoding, delimiter, has_header, columns, types, findings)""")
def format_zoo(spark, sf_dir):
    """A scan over one small file of every format: encodings, formats, archives, failures, rows that don't fit.

    Whether the last row is cut off is told by the last byte, which is zero in UTF-16 with the low byte first."""

    def made(folder: str) -> DataFrame:
        said = F.array_join(F.transform("findings", lambda x: F.concat(x["reason_code"], F.lit("@"), x["locus"])), " ")
        return scan(spark, folder).verdicts.select(F.substring_index("path", "/", -1).alias("file"), "bucket", "verdict", F.col("format_detected").alias("format"), "encoding", "delimiter", "has_header", F.array_join("norm_names", ",").alias("columns"), F.array_join("type_classes", ",", "?").alias("types"), said.alias("findings"))

    return written(spark, zoo, made)


@query("""SELECT * FROM (VALUES ('*.csv', 'a.csv,b.csv', ''), ('**/*.csv', 'a.csv,b.csv,sub/c.csv,sub/deep/d.csv', ''), ('[ab].csv', 'a.csv,b.csv', ''), ('?.tsv', 'e.tsv', ''), ('', 'a.csv,b.csv,e.tsv,sub/c.csv,sub/deep/d.csv', ''), ('.hidden.csv', '.hidden.csv', ''),
 ('*.none', '', 'FORMAT_UNRECOGNIZED/WARN'), ('a.csv', 'a.csv', ''), ('limits', 'a.csv,b.csv', 'RECURSION_DEPTH_CEILING/WARN,FILE_COUNT_CEILING/WARN,BYTE_CEILING/WARN'), ('excluded', 'b.csv', '')) t(expression, files, findings)""")
def listing_rules(spark, sf_dir):
    """Path expressions, hidden files, exclusions and ceilings over a small tree."""

    def write(folder: str) -> None:
        for name in ("a.csv", "b.csv", "e.tsv", "sub/c.csv", "sub/deep/d.csv", ".hidden.csv", "sub/.h/x.csv"):
            put(folder, name, "a,b\n1,2\n" * 4)

    def made(folder: str) -> DataFrame:
        rows = []
        for expression in ("*.csv", "**/*.csv", "[ab].csv", "?.tsv", "", ".hidden.csv", "*.none", "a.csv", "limits", "excluded"):
            limits = {"limits": listing.Limits(file_count=2, total_bytes=40, depth=1), "excluded": listing.Limits(exclude=(f"{folder}/a.csv",))}.get(expression, listing.Limits())
            pattern = {"limits": "", "excluded": "*.csv"}.get(expression, expression)
            found = listing.list_files(spark, f"{folder}/{pattern}".rstrip("/"), limits)
            rows.append((expression, ",".join(p.removeprefix(f"{folder}/") for _, p, _ in found.files), ",".join(f"{f[0]}/{f[1]}" for f in found.findings)))
        return spark.createDataFrame(rows, "expression string, files string, findings string")

    return written(spark, write, made)


DRIFT_DDL = "CREATE TABLE orders (id INT, name TEXT, amount DECIMAL(9, 2))"


def drift(folder: str) -> None:
    """Files that drift from DRIFT_DDL, each in a way of its own."""
    rows = [(str(i), f"n{i}", f"{i}.5") for i in range(30)]
    text = lambda header, rows: "\n".join(",".join(r) for r in ([header] if header else []) + rows) + "\n"
    own = ("id", "name", "amount")
    put(folder, "as_declared.csv", text(own, rows))
    put(folder, "case.csv", text((" ID", "Name ", "AMOUNT"), rows))
    put(folder, "extra.csv", text((*own, "region"), [(*r, "n") for r in rows]))
    put(folder, "missing.csv", text(own[:2], [r[:2] for r in rows]))
    put(folder, "renamed.csv", text(("id", "title", "amount"), rows))
    put(folder, "reordered.csv", text(("name", "id", "amount"), [(r[1], r[0], r[2]) for r in rows]))
    put(folder, "wider.csv", text(own, [(r[0], r[1], r[0]) for r in rows]))
    put(folder, "wrong.csv", text(own, [(f"x{r[0]}", *r[1:]) for r in rows]))
    put(folder, "headless.csv", text(None, rows))
    put(folder, "ragged.csv", text(own, [*rows[:9], ("9", "a", "b", "c"), *rows[9:]]))
    put(folder, "one.zip", b"PK\x05\x06" + bytes(18))


CHECKS = {"name strict": ("name", "strict", False), "name open": ("name", "open", False), "position": ("position", "strict", False), "carried": ("name", "strict", True)}


@query("""SELECT * FROM (VALUES
 ('as_declared.csv', 'name strict', 'golden', ''), ('as_declared.csv', 'name open', 'golden', ''), ('as_declared.csv', 'position', 'golden', ''), ('as_declared.csv', 'carried', 'golden', ''),
 ('case.csv', 'name strict', 'golden', ''), ('case.csv', 'name open', 'golden', ''), ('case.csv', 'position', 'golden', ''), ('case.csv', 'carried', 'golden', ''),
 ('extra.csv', 'name strict', 'broken', 'EXTRA_COLUMN/ERROR'), ('extra.csv', 'name open', 'warned', 'EXTRA_COLUMN/INFO'), ('extra.csv', 'position', 'broken', 'COUNT_CHANGED/ERROR'), ('extra.csv', 'carried', 'broken', 'EXTRA_COLUMN/ERROR'),
 ('missing.csv', 'name strict', 'broken', 'MISSING_COLUMN/ERROR'), ('missing.csv', 'name open', 'broken', 'MISSING_COLUMN/ERROR'), ('missing.csv', 'position', 'broken', 'COUNT_CHANGED/ERROR'), ('missing.csv', 'carried', 'broken', 'MISSING_COLUMN/ERROR'),
 ('renamed.csv', 'name strict', 'broken', 'MISSING_COLUMN/ERROR EXTRA_COLUMN/ERROR COLUMN_NAME_MISMATCH/WARN'), ('renamed.csv', 'name open', 'broken', 'MISSING_COLUMN/ERROR EXTRA_COLUMN/INFO COLUMN_NAME_MISMATCH/WARN'), ('renamed.csv', 'position', 'warned', 'COLUMN_NAME_MISMATCH/WARN'), ('renamed.csv', 'carried', 'broken', 'MISSING_COLUMN/ERROR EXTRA_COLUMN/ERROR COLUMN_NAME_MISMATCH/WARN'),
 ('reordered.csv', 'name strict', 'golden', ''), ('reordered.csv', 'name open', 'golden', ''), ('reordered.csv', 'position', 'broken', 'TYPE_MISMATCH/ERROR TYPE_MISMATCH/WARN COLUMN_NAME_MISMATCH/WARN COLUMN_NAME_MISMATCH/WARN'), ('reordered.csv', 'carried', 'golden', ''),
 ('wider.csv', 'name strict', 'warned', 'TYPE_MISMATCH/WARN'), ('wider.csv', 'name open', 'warned', 'TYPE_MISMATCH/WARN'), ('wider.csv', 'position', 'warned', 'TYPE_MISMATCH/WARN'), ('wider.csv', 'carried', 'warned', 'TYPE_MISMATCH/WARN'),
 ('wrong.csv', 'name strict', 'broken', 'TYPE_MISMATCH/ERROR'), ('wrong.csv', 'name open', 'broken', 'TYPE_MISMATCH/ERROR'), ('wrong.csv', 'position', 'broken', 'TYPE_MISMATCH/ERROR'), ('wrong.csv', 'carried', 'broken', 'TYPE_MISMATCH/ERROR'),
 ('headless.csv', 'name strict', 'broken', 'HEADERLESS_NAME_MODE/ERROR'), ('headless.csv', 'name open', 'broken', 'HEADERLESS_NAME_MODE/ERROR'), ('headless.csv', 'position', 'golden', ''), ('headless.csv', 'carried', 'broken', 'HEADERLESS_NAME_MODE/ERROR'),
 ('ragged.csv', 'name strict', 'golden', ''), ('ragged.csv', 'name open', 'golden', ''), ('ragged.csv', 'position', 'golden', ''), ('ragged.csv', 'carried', 'broken', 'RAGGED_ROWS/ERROR MULTI_RECORD/WARN'),
 ('one.zip', 'name strict', 'golden', ''), ('one.zip', 'name open', 'golden', ''), ('one.zip', 'position', 'golden', ''), ('one.zip', 'carried', 'golden', '')
 ) t(file, run, partition, findings)""")
def check_rules(spark, sf_dir):
    """A check of files that drift, by name under both policies, by position, and with the scan's own findings carried on; read from the check's JSON."""

    def made(folder: str) -> DataFrame:
        rows = []
        for run, (mode, extra, carry) in CHECKS.items():
            result = json.loads(check(spark, folder, from_ddl(DRIFT_DDL), mode, extra, carry_scan_findings=carry).to_json())
            assert result["has_errors"] and result["alignment_mode"] == mode and result["extra_column_policy"] == extra and result["accounting"]["reconciles"]
            rows += [(os.path.basename(v["path"]), run, part, " ".join(f"{f['reason_code']}/{f['severity']}" for f in v["findings"])) for part in ("golden", "warned", "broken") for v in result[part]]
        return spark.createDataFrame(rows, "file string, run string, partition string, findings string")

    return written(spark, drift, made)


@query("""SELECT * FROM (VALUES
 ('as_declared.csv', 'F0001', 'V0001', 'id=int name=text amount=decimal', 30), ('case.csv', 'F0001', 'V0001', 'id=int name=text amount=decimal', 30), ('extra.csv', 'F0002', 'V0004', 'id=int name=text amount=decimal region=text', 30), ('headless.csv', 'F0003', 'V0005', 'column0=int column1=text column2=decimal', 30),
 ('missing.csv', 'F0004', 'V0006', 'id=int name=text', 30), ('one.zip', NULL, NULL, '', NULL), ('ragged.csv', 'F0001', NULL, '', 31), ('renamed.csv', 'F0005', 'V0007', 'id=int title=text amount=decimal', 30), ('reordered.csv', 'F0001', 'V0001', 'name=text id=int amount=decimal', 30),
 ('wider.csv', 'F0001', 'V0002', 'id=int name=text amount=int', 30), ('wrong.csv', 'F0001', 'V0003', 'id=text name=text amount=decimal', 30), ('(fileset)', NULL, NULL, 'amount: `decimal` in 4 file(s), `int` in 1 file(s); id: `int` in 4 file(s), `text` in 1 file(s)', 2)
 ) t(file, family, variant, columns, n)""")
def scan_rules(spark, sf_dir):
    """A scan of the same files, read from its JSON: families, variants, types, rows, and columns on which a family disagrees."""

    def made(folder: str) -> DataFrame:
        result = json.loads(scan(spark, folder).to_json())
        assert [v["path"] for v in result["file_verdicts"]] == sorted(v["path"] for v in result["file_verdicts"])
        rows = [(os.path.basename(v["path"]), v["family_id"], v["type_variant_id"], " ".join(f"{n}={t}" for n, t in v["column_types"].items()), v["row_count_estimate"]) for v in result["file_verdicts"]]
        notes = result["scan_findings"]
        rows.append(("(fileset)", None, None, "; ".join(f"{f['locus'].split(chr(39))[1]}: {f['found']}" for f in notes), len(notes)))
        return spark.createDataFrame(rows, "file string, family string, variant string, columns string, n long")

    return written(spark, drift, made)


@query("""SELECT * FROM (VALUES ('flat', 'id=int name=text amount=decimal'), ('types only', 'column0=int column1=text'), ('tabs', 'id=int b b=any'), ('golden', 'id=int name=text amount=decimal'), ('result', 'id=int name=text amount=decimal'), ('ddl', 'id=int check_no=text at=timestamp'),
 ('guessed ddl', 'a=int'), ('guessed flat', 'id=int name=text amount=decimal'), ('guessed result', 'id=int name=text amount=decimal'), ('guessed golden', 'id=int name=text amount=decimal'), ('no lines', 'ValueError'), ('no file', 'ValueError'), ('not a result', 'ValueError'), ('not golden', 'ValueError')) t(door, columns)""")
def baseline_doors(spark, sf_dir):
    """Every way to say what files should look like, and what is no baseline."""

    def made(folder: str) -> DataFrame:
        drift(f"{folder}/drift")
        flat = put(folder, "a.schema", "# declared\nid, int\nName , text\namount, decimal(9,2)\n")
        result = put(folder, "r.json", scan(spark, f"{folder}/drift").to_json())
        good = f"{folder}/drift/as_declared.csv"
        ddl = "create temp table x.`y` (id int primary key, check_no text, at timestamp with time zone, primary key (id), unique (id));"
        doors = {
            "flat": lambda: from_flat(flat), "types only": lambda: from_flat(put(folder, "t", "int\ntext\n"), type_only=True), "tabs": lambda: from_flat(put(folder, "u", "id\tint\n\nB  b\n")), "golden": lambda: from_golden(spark, good), "result": lambda: from_result(result), "ddl": lambda: from_ddl(ddl),
            "guessed ddl": lambda: load(spark, put(folder, "d.txt", "CREATE TABLE t (a int)")), "guessed flat": lambda: load(spark, flat), "guessed result": lambda: load(spark, result), "guessed golden": lambda: load(spark, good),
            "no lines": lambda: from_flat(put(folder, "v", "# only\n")), "no file": lambda: from_flat(f"{folder}/none"), "not a result": lambda: from_result(put(folder, "w.json", "[]")), "not golden": lambda: from_golden(spark, put(folder, "e.csv", "")),
        }
        rows = []
        for door, opened in doors.items():
            try:
                b = opened()
                rows.append((door, " ".join(f"{n}={t}" for n, t in zip(b.ordered_names, b.ordered_types))))
            except ValueError:
                rows.append((door, "ValueError"))
        return spark.createDataFrame(rows, "door string, columns string")

    folder = tempfile.mkdtemp(prefix="shapewright-doors-")  # baselines are read by the driver; the files beside them are few
    try:
        v = made(folder)
        return spark.createDataFrame(v.collect(), v.schema)
    finally:
        shutil.rmtree(folder)


@query("""SELECT * FROM (VALUES ('scan', 11, 5, 1, 'plain'), ('scan', 11, 5, 1, 'coloured'), ('check', 11, 0, 6, 'plain'), ('check', 11, 0, 6, 'coloured')) t(command, files, families, errors, form)""")
def reports(spark, sf_dir):
    """The reports of a scan and a check: their counts of files, families and errors; colours only where they are asked for."""

    def made(folder: str) -> DataFrame:
        rows = []
        seen, held = scan(spark, folder).to_dict(), check(spark, folder, from_ddl(DRIFT_DDL)).to_dict()
        for command, text in (("scan", lambda c: of_scan(seen, c)), ("check", lambda c: of_check(held, c))):
            for form in ("plain", "coloured"):
                out = text(form == "coloured")
                assert ("\x1b[31m" in out) == (form == "coloured")
                rows.append((command, int(re.search(r"(\d+) files:", out)[1]), len(re.findall(r"^  F\d{4}:", out, re.M)), len(re.findall(r"^    (?:\x1b\[31m)?ERROR", out, re.M)), form))
        return spark.createDataFrame(rows, "command string, files int, families int, errors int, form string")

    return written(spark, drift, made)
