"""Files in and out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeworks.functions.text import presence

MAX_ROWS, MAX_BYTES, MAX_PAGE = 100_000, 25 << 20, 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Where files of a job may lie so that all executors see them: the folder in spark.checkpoint.dir, else one under the warehouse."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return shared.rstrip("/") if shared else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_files"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: worked out once, whatever is drawn from it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _parsed(lines: DataFrame, header: str) -> DataFrame:
    import csv

    names = [n.strip().lstrip("﻿") for n in next(csv.reader([header]))]
    if len(set(names)) != len(names):
        raise ValueError(f"repeated header: {names}")
    return lines.select(F.from_csv("value", ", ".join(f"`{n}` string" for n in names)).alias("r")).select("r.*")


def _after(spark: SparkSession, path: str, is_header: Column) -> DataFrame:
    """Rows below the first line that is a header. Lines of one file keep their order in ``_metadata``'s blocks and the
    reader's increasing ids; the header's place is one row."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    found = lines.filter(is_header).orderBy("_at").limit(1).collect()
    if not found:
        raise ValueError(f"no header line in {path}")
    header, at = found[0]["value"], found[0]["_at"]
    return _parsed(lines.filter((F.col("_at") > at) & (F.trim("value") != "")).select("value"), header)


def csv_after_preamble(spark: SparkSession, path: str, first_column: str) -> DataFrame:
    """CSV whose header is the first line that begins with a known column; what is above goes."""
    return _after(spark, path, F.col("value").startswith(first_column))


def csv_with_header_guess(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """CSV whose header is the first line with any of the tokens."""
    low = F.lower("value")
    hit = F.lit(False)
    for t in tokens:
        hit = hit | low.contains(t.lower())
    return _after(spark, path, hit & (F.trim("value") != ""))


def resolve_columns(df: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """One column for each name: the first non-blank value among the columns that are its synonyms."""
    known = {c.strip().lstrip("﻿").strip().lower(): c for c in df.columns}
    out = []
    for name, options in synonyms.items():
        present = [presence(F.trim(F.col(f"`{known[o.lower()]}`"))) for o in options if o.lower() in known]
        out.append((F.coalesce(*present) if present else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def decoded_lines(spark: SparkSession, path: str, encoding: str = "cp932") -> DataFrame:
    """(line_number, line) of files in an encoding that Spark does not read (S07). Bytes that do not decode, and NULs,
    stop the read with the line's number. A file is one task's: its size is limited (S10)."""

    def decode(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                if len(content) > MAX_BYTES:
                    raise ValueError(f"{path}: more than {MAX_BYTES} bytes")
                lines = []
                for k, raw in enumerate(bytes(content).split(b"\n"), 1):
                    try:
                        line = raw.decode(encoding, "strict")
                    except UnicodeDecodeError as e:
                        raise ValueError(f"{path}: line {k} cannot be decoded") from e
                    if "\0" in line:
                        raise ValueError(f"{path}: line {k} has a NUL")
                    lines.append((k, line.rstrip("\r")))
                yield pd.DataFrame(lines, columns=["line_number", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "line_number int, line string")


def strict_csv(lines: DataFrame, columns: list[str], required: list[str] | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Records of (line_number, line) with ``valid`` and the line they begin on.

    A record is closed when its quotes are even. If quotes never close the whole file is refused; a closed record that does not
    parse is one invalid row, the others go on. Quotes are summed in line order, so the file is one ordered read of limited size.
    """
    from pyspark.sql.window import Window

    w = Window.orderBy("line_number")
    quotes = F.length(F.regexp_replace("line", '[^"]', ""))
    total = F.sum(quotes).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn("_q", total).withColumn("_open", F.coalesce(F.lag("_q").over(w), F.lit(0)) % 2)
    ids = marked.withColumn("_record", F.sum(F.when(F.col("_open") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    records = ids.groupBy("_record").agg(F.min("line_number").alias("line_number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "line"))), lambda x: x["line"]), "\n").alias("value"), F.sum(quotes).alias("quotes"))
    last = records.agg(F.count("*").alias("n"), F.max_by("quotes", "line_number").alias("quotes")).first()
    if last["quotes"] is not None and last["quotes"] % 2:
        raise ValueError("a quoted field is never closed")
    if last["n"] > max_rows + 1:
        raise ValueError(f"more than {max_rows} rows")
    header = records.orderBy("line_number").first()
    if header is None:
        raise ValueError("no header")
    import csv

    names = next(csv.reader([header["value"]]))
    missing = [c for c in (required or columns) if c not in names]
    if missing or len(set(names)) != len(names):
        raise ValueError(f"header lacks {missing} or repeats a column")
    fields = ", ".join(f"`{n}` string" for n in names)
    parsed = records.filter(F.col("line_number") > header["line_number"]).filter(F.trim("value") != "")
    parsed = parsed.select("line_number", F.from_csv("value", fields + ", _corrupt_record string", {"multiLine": "true", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "value")
    odd = F.col("value").rlike(r'(?:^|,)[^",]+"')  # a quote within an unquoted field
    return parsed.select("line_number", *[F.col(f"r.`{c}`").alias(c) for c in columns], (F.col("r._corrupt_record").isNull() & ~odd).alias("valid"))


def strict_csv_files(files: DataFrame, columns: list[str], required: list[str] | None = None, encoding: str = "cp932", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, line_number, columns..., valid) of files (path, content), each read whole where it is (S07-S10): nothing is ordered over all lines, and files of
    any number are read side by side.

    A file must decode strictly, hold no NUL, name ``required`` columns in its first line and none twice, close its quotes, and keep to the limits; one that does not
    stops the read with its path and line. Where it does not parse as a whole but each line's quotes are even, lines are parsed one by one and the
    bad ones are invalid rows. Line numbers are those of the file, of a record's first line. Blank lines are no records.
    """
    needed = required or columns
    schema = "path string, line_number int, " + ", ".join(f"`{c}` string" for c in columns) + ", valid boolean"

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = _records(path, content.as_py() or b"", columns, needed, encoding, max_rows, max_bytes)
                values = list(zip(*rows)) if rows else [[]] * (len(columns) + 2)
                kinds = [pa.int32(), *[pa.string()] * len(columns), pa.bool_()]
                arrays = [pa.array([path] * len(rows), pa.string()), *[pa.array(v, k) for v, k in zip(values, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "line_number", *columns, "valid"])

    return files.select("path", "content").mapInArrow(read, schema)


def _records(path: str, content: bytes, columns: list[str], needed: list[str], encoding: str, max_rows: int, max_bytes: int) -> list[tuple]:
    import csv

    def stop(why: str):
        raise ValueError(f"{path}: {why}")

    if len(content) > max_bytes:
        stop(f"more than {max_bytes} bytes")
    lines = []
    for k, raw in enumerate(content.split(b"\n"), 1):
        try:
            lines.append(raw.decode(encoding, "strict").rstrip("\r"))
        except UnicodeDecodeError:
            stop(f"line {k} cannot be decoded")
        if "\0" in lines[-1]:
            stop(f"line {k} has a NUL")
    records: list[tuple[int, list[str] | None]] = []
    reader = csv.reader((x + "\n" for x in lines), strict=True)
    try:
        at = 1
        for values in reader:
            records.append((at, values))
            at = reader.line_num + 1
    except csv.Error:
        if any(x.count('"') % 2 for x in lines):
            stop("a quoted field is never closed")
        records = []
        for k, line in enumerate(lines, 1):
            try:
                records += [(k, values) for values in csv.reader([line], strict=True)] or [(k, [])]
            except csv.Error:
                records.append((k, None))
    records = [(k, v) for k, v in records if v is None or any(x.strip() for x in v)]
    if not records or records[0][1] is None:
        stop("no header")
    names = [x.strip().lstrip("\ufeff") for x in records[0][1]]
    missing = [c for c in needed if c not in names]
    if missing or len(set(names)) != len(names):
        stop(f"header lacks {missing} or repeats a column")
    if len(records) - 1 > max_rows:
        stop(f"more than {max_rows} rows")
    place = [names.index(c) if c in names else None for c in columns]
    fits = lambda v: v is not None and len(v) == len(names)
    value = lambda v, p: v[p] if fits(v) and p is not None else None
    return [(k, *[value(v, p) for p in place], fits(v)) for k, v in records[1:]]


def append_once(df: DataFrame, path: str, batch: str) -> bool:
    """Bulk insert of a named batch that a retry does not repeat (K02): rows are staged in a folder of the batch, which a retry
    overwrites, and count from when the batch's commit row is written; a batch that has one is not written again. Tells whether rows were added."""
    spark = df.sparkSession
    done = f"{path}/commits/batch={batch}"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{done}/_SUCCESS")
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return False
    df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    spark.range(1).select(F.lit(True).alias("committed")).coalesce(1).write.mode("overwrite").parquet(done)
    return True


def appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed batches with their ``batch``; what a broken run staged is not seen."""
    commits = spark.read.parquet(f"{path}/commits").select(F.col("batch").cast("string").alias("batch"))
    rows = spark.read.parquet(f"{path}/rows")
    return rows.withColumn("batch", F.col("batch").cast("string")).join(F.broadcast(commits.distinct()), "batch", "left_semi")


def write_csv(df: DataFrame, path: str, header: list[str]) -> None:
    """One report in a fixed order of columns (K01). Reports are results of aggregates or top-k, so one file holds them."""
    df.select(*header).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_page(df: DataFrame, total: int, page: DataFrame | None = None) -> DataFrame:
    """One JSON document with the total and a page's rows (K06); without a page the table must be one, of ``MAX_PAGE`` rows at most."""
    if page is None and total > MAX_PAGE:
        raise ValueError(f"{total} rows are no page")
    rows = (page or df).agg(F.collect_list(F.struct(*(page or df).columns)).alias("rows"))
    return rows.select(F.to_json(F.struct(F.lit(total).alias("total"), "rows")).alias("json"))


def write_sitemap(df: DataFrame, base: str) -> DataFrame:
    """Lines of a sitemap: location and date of the last change."""
    return df.select(F.concat(F.lit(f"<url><loc>{base}"), F.col("path"), F.lit("</loc><lastmod>"), F.date_format("updated_on", "yyyy-MM-dd"), F.lit("</lastmod></url>")).alias("value"))


def idempotency_key(*columns: str) -> Column:
    """Key of an event by its identity."""
    return F.sha2(F.concat_ws(":", *columns), 256)
