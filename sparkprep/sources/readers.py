"""Sources: what to read is worked out on the driver from a name or a small head; rows are read by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.sources import delimited as D

#: Extensions by kind of source, and the keys under which records are looked for.
EXTENSIONS = {"csv": "csv", "tsv": "csv", "txt": "csv", "psv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "pq": "parquet", "orc": "orc"}
RECORD_KEYS = ("data", "records", "results", "rows", "items", "value", "payload", "entries")
_READ_ONLY = re.compile(r"^\s*(with|select|show|describe|explain|values|table)\b", re.IGNORECASE)
_CHANGES = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|replace|call|copy)\b", re.IGNORECASE)


def infer_kind(target: str) -> str:
    """Kind of source by scheme, then by extension with compression suffixes left out; csv if nothing tells."""
    scheme = re.match(r"^([a-z0-9+]+):", target.lower())
    name = target.lower().split("?")[0].rstrip("/")
    name = re.sub(r"\.(gz|bz2|zst|snappy|xz|lz4)$", "", name)
    ext = name.rsplit(".", 1)[-1] if "." in name.rsplit("/", 1)[-1] else ""
    if scheme and scheme[1].split("+")[0] in ("jdbc", "postgresql", "postgres", "mysql", "snowflake", "databricks"):
        return "sql"
    return EXTENSIONS.get(ext, "csv")


def spark_uri(uri: str) -> str:
    """The same object as Spark's connectors name it."""
    if m := re.match(r"^s3n?://(.*)$", uri):
        return f"s3a://{m[1]}"
    if m := re.match(r"^(gcs|gs)://(.*)$", uri):
        return f"gs://{m[2]}"
    if m := re.match(r"^https?://([^.]+)\.blob\.core\.windows\.net/([^/]+)/(.*)$", uri):
        return f"abfss://{m[2]}@{m[1]}.dfs.core.windows.net/{m[3]}"
    if m := re.match(r"^az://([^/]+)/([^/]+)/(.*)$", uri):
        return f"abfss://{m[2]}@{m[1]}.dfs.core.windows.net/{m[3]}"
    return uri


def sniff_delimiter(lines: list[str]) -> str:
    """The one of , ; tab | that cuts the lines into most equal numbers of fields."""
    best, score = ",", (0.0, 0)
    for d in (",", ";", "\t", "|"):
        counts = [len(re.findall(re.escape(d), re.sub(r'"[^"]*"', "", x))) for x in lines if x.strip()]
        if counts and max(counts):
            usual = max(set(counts), key=lambda k: (counts.count(k), k))
            if usual and (counts.count(usual) / len(counts), usual) > score:
                best, score = d, (counts.count(usual) / len(counts), usual)
    return best


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, header: bool = True, columns: Iterable[str] | None = None, thousands: str | None = None, decimal: str = ".", na_values: str | None = None, quotechar: str = '"', escapechar: str | None = None, comment: str | None = None) -> tuple[DataFrame, int]:
    """(rows, number of malformed records left out).

    A record may hold line ends inside quotes. One of more fields than the header is malformed, as is
    a quote that never ends; one of fewer fields has nulls in the others. Rows and their number come from one plan. The separator
    is told from the head of the first file by name; a byte order mark is taken off; utf-8 unless some line does
    not decode as such. Types are those that all values of sound records have.
    """
    head = D.head_lines(spark, path)
    sep = sniff_delimiter(head) if sep is None else sep
    escape = escapechar or quotechar
    lines = spark.read.text(path)
    if encoding is None:  # a line anywhere can tell; the search ends at the first
        encoding = "UTF-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"
    if encoding.upper().replace("_", "-") not in ("UTF-8", "UTF8"):
        if len("\n,".encode(encoding)) != 2:
            raise ValueError(f"{encoding} does not tell lines by single bytes")
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    fields = D.first_record([x for x in head if not (comment and x.startswith(comment))], sep, quotechar, escape)
    if not fields:
        return spark.createDataFrame([], T.StructType()), 0
    names = [f"_c{i}" for i in range(len(fields))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_bad"]])
    options = {"sep": sep, "quote": quotechar, "escape": escape, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1", "columnPruning": "false"}
    options |= ({"nullValue": na_values} if na_values is not None else {}) | ({"comment": comment} if comment else {})
    if D.spans_lines(lines, sep, quotechar, escape):
        found, unended = D.records(lines, sep, quotechar, escape)
        found = found.where(~F.col("first")) if header else found
        found = found.where(~F.startswith("record", F.lit(comment))) if comment else found
        record = F.when(F.col("first"), F.ltrim("record", F.lit("\ufeff"))).otherwise(F.col("record"))
        rows = found.select(F.from_csv(record, F.lit(schema.toDDL()), options | {"multiLine": "true"}).alias("_r"), F.col("record")).select("_r.*", "record").withColumn("_bad", F.when(F.col("_bad").isNotNull(), F.col("record"))).drop("record")
    else:
        rows, unended = spark.read.options(**options, encoding=encoding, header=str(header).lower(), enforceSchema="true").schema(schema).csv(path), 0
    sound = F.col("_bad").isNull() | (D.fields_in(F.col("_bad"), sep, quotechar, escape) <= len(names))
    sound = sound & (F.coalesce(F.length(names[0]), F.lit(0)) >= 0)  # Spark refuses to read for the fault alone
    bad = rows.where(~sound).count() + unended
    out = D.typed(rows.where(sound).drop("_bad"))
    out = out.toDF(*normalise_headers(fields)) if header else out
    if thousands or decimal != ".":
        number = rf"^\s*[-+]?[0-9{re.escape(thousands or '')}]+({re.escape(decimal)}[0-9]+)?\s*$"
        texts = [f.name for f in out.schema if isinstance(f.dataType, T.StringType)]
        fit = out.agg(*[F.bool_and(F.col(c).rlike(number)).alias(c) for c in texts]).first() if texts else {}
        plain = lambda c: F.translate(F.translate(F.col(c), thousands or "", ""), decimal, ".")
        out = out.withColumns({c: plain(c).try_cast("double") for c in texts if fit[c]})
    return (out.select(*[c for c in columns if c in out.columns]) if columns else out), bad


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None, records_path: str | None = None, separator: str = ".") -> tuple[DataFrame, int]:
    """(flat rows, number of lines left out): a whole document or one document a line, as the first file by name begins."""
    if multi_line is None:
        first = next((x.strip() for x in D.head_lines(spark, path) if x.strip()), "")
        multi_line = first.startswith("[") or first in ("{",) or not first.endswith("}")
    raw = spark.read.json(path, multiLine=multi_line, columnNameOfCorruptRecord="_bad")
    others = [c for c in raw.columns if c != "_bad"]
    if "_bad" not in raw.columns or not others:
        return flatten(extract_records(raw.drop("_bad"), records_path), separator), 0
    # Spark parses no line of which the fault alone is asked, so all columns are looked at
    sound = F.col("_bad").isNull() & (F.coalesce(F.length(F.to_json(F.struct(*others))), F.lit(0)) >= 0)
    bad, rows = raw.where(~sound).count(), raw.where(sound).drop("_bad")
    return flatten(extract_records(rows, records_path), separator), bad


def extract_records(df: DataFrame, records_path: str | None = None) -> DataFrame:
    """The records inside documents: at a dotted path (numbers index arrays), else the first usual key that holds a list, else zipped columns of lists, else the rows."""
    if records_path:
        at: Column | None = None
        for part in records_path.split("."):
            at = F.col(f"`{part}`") if at is None else F.get(at, int(part)) if part.isdigit() else at.getField(part)
        found = df.select(at.alias("_r"))
        kind = found.schema["_r"].dataType
        found = found.select(F.explode("_r").alias("_r")) if isinstance(kind, T.ArrayType) else found
        kind = found.schema["_r"].dataType
        return found.select("_r.*") if isinstance(kind, T.StructType) else found.withColumnRenamed("_r", "value")
    for k in RECORD_KEYS:
        if k in df.columns and isinstance(df.schema[k].dataType, T.ArrayType):
            return extract_records(df, k)
    if df.columns and all(isinstance(f.dataType, T.ArrayType) for f in df.schema):
        return df.select(F.explode(F.arrays_zip(*df.columns)).alias("_r")).select("_r.*")
    return df


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested records as columns of joined names; lists stay."""

    def leaves(schema: T.StructType, path: list[str]) -> list[Column]:
        out = []
        for f in schema:
            here = [*path, f.name]
            out += leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here))]
        return out

    return df.select(*leaves(df.schema, []))


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None, max_rows: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows.select(*[c for c in columns if c in rows.columns]) if columns else rows
    return rows.limit(max_rows) if max_rows is not None else rows


def guarded(statement: str) -> str:
    """A table's name as its whole selection; anything that is not a lone read is refused."""
    text = statement.strip().rstrip(";").strip()
    if re.fullmatch(r'[\w."`\[\]]+', text):
        return f"SELECT * FROM {text}"
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", text, flags=re.DOTALL)
    if ";" in bare or not _READ_ONLY.match(bare) or _CHANGES.search(bare):
        raise ValueError("only a single reading statement is run")
    return text


def read_sql(spark: SparkSession, url: str, query: str, max_rows: int | None = None, partition: Mapping[str, object] | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Any JDBC source; with a partition column, bounds and number, the executors read slices side by side."""
    reader = spark.read.format("jdbc").option("url", url if url.startswith("jdbc:") else f"jdbc:{url}").options(**options)
    if partition:
        reader = reader.option("dbtable", f"({guarded(query)}) q").options(partitionColumn=partition["column"], lowerBound=partition["lower"], upperBound=partition["upper"], numPartitions=partition["number"])
    else:
        reader = reader.option("query", guarded(query))
    rows = reader.load()
    return rows.limit(max_rows) if max_rows is not None else rows


def query_files(spark: SparkSession, query: str, **tables: str) -> DataFrame:
    """SQL over files: each named path is a view; ``SELECT ... FROM parquet.`path``` works as well."""
    frames = {name: read_any(spark, path) for name, path in tables.items()}
    text = guarded(query)
    for name in frames:
        text = re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 {{{name}}}", text, flags=re.IGNORECASE)
    return spark.sql(text, **frames)


def read_any(spark: SparkSession, target: str, **options) -> DataFrame:  # noqa: ANN003
    """Whatever the name says it is."""
    uri, kind = spark_uri(target), infer_kind(target)
    if kind == "parquet":
        return read_parquet(spark, uri, **options)
    if kind == "json":
        return read_json(spark, uri, **options)[0]
    if kind == "orc":
        return spark.read.orc(uri)
    if kind == "sql":
        return read_sql(spark, uri, **options)
    return read_delimited(spark, uri, **options)[0]


def from_memory(spark: SparkSession, rows: object, name: str | None = None) -> DataFrame:
    """A pandas frame or a list of records, as a view if it is named."""
    made = spark.createDataFrame(rows)
    if name:
        made.createOrReplaceTempView(name)
    return made


def normalise_headers(names: Iterable[str]) -> list[str]:
    """Stripped; blank ones as column_i; repeats as name_2, name_3 that meet no other name."""
    stripped = [n.strip() or f"column_{i}" for i, n in enumerate(names)]
    taken, out = set(stripped), []
    seen: set[str] = set()
    for n in stripped:
        if n in seen:
            k = 2
            while f"{n}_{k}" in taken:
                k += 1
            n = f"{n}_{k}"
            taken.add(n)
        seen.add(n)
        out.append(n)
    return out


def validate(df: DataFrame) -> list[tuple[str, str]]:
    """(level, message): no rows or columns are errors; a lone column, empty columns, an exported index and text that is numbers in part are warnings."""
    if not df.columns:
        return [("error", "no columns")]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    out = [("error", "no rows")] if not counts["n"] else []
    if len(df.columns) == 1:
        out.append(("warning", "a single column: the separator may be wrong"))
    empty = [c for i, c in enumerate(df.columns) if counts["n"] and not counts[f"c{i}"]]
    out += [("warning", f"column {c} is empty") for c in empty]
    out += [("warning", f"column {c} looks like an exported index") for c in df.columns if re.fullmatch(r"(unnamed: ?\d+|index|_c0|column_0)", c.lower())]
    from sparkprep.functions.tables import string_columns
    from sparkprep.operators.profile import number_text

    if string_columns(df):
        out += [("warning", f"column {r['column']} mixes numbers and text") for r in number_text(df).where("mixed").orderBy("column").collect()]
    return out


def describe_schema(df: DataFrame, samples: int = 3, width: int = 60) -> DataFrame:
    """column, type, nullable (has nulls), samples."""
    head = df.limit(100)
    nulls = df.agg(*[F.coalesce(F.bool_or(F.col(f"`{c}`").isNull()), F.lit(False)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    seen = head.agg(*[F.slice(F.collect_list(F.substring(F.col(f"`{c}`").cast("string"), 1, width)), 1, samples).alias(f"s{i}") for i, c in enumerate(df.columns)])
    one = nulls.join(seen, how="cross")
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("nullable"), F.col(f"s{i}").alias("samples")) for i, f in enumerate(df.schema)])
    return one.select(F.explode(rows).alias("r")).select("r.*")
