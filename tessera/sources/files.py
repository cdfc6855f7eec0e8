"""Reading and writing files: inspection, pruned reads, JSON lines, Markdown, hashes, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from tessera.errors import EngineError

# Limits of an import.
MOST_FILE_BYTES, MOST_ROWS, MOST_COLUMNS, MOST_STORED_BYTES = 500 * 1024**2, 2_000_000, 300, 3 * 1024**3
FORMATS = ("csv", "parquet", "json", "orc", "dta", "xlsx")


class StataSource(DataSource):
    """Stata files, one partition a file. Values keep their codes; value labels don't apply."""

    @classmethod
    def name(cls) -> str:
        return "stata"

    def schema(self) -> T.StructType:
        import pandas as pd

        with pd.read_stata(self.options["path"], convert_categoricals=False, iterator=True) as r:
            head = r.read(1)
        kinds = {"i": T.LongType(), "u": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType(), "M": T.TimestampType()}
        return T.StructType([T.StructField(c, kinds.get(head[c].dtype.kind, T.StringType())) for c in head.columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return StataReader(self.options["path"], schema)


class StataReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.wanted = path, schema

    def read(self, partition):
        import pandas as pd

        names = self.wanted.fieldNames()
        kinds = [f.dataType for f in self.wanted.fields]
        plain = {T.LongType(): int, T.DoubleType(): float, T.StringType(): str}
        for part in pd.read_stata(self.path, convert_categoricals=False, columns=names, chunksize=100_000):
            for row in part.itertuples(index=False):
                yield tuple(None if v is None or v != v else plain.get(k, lambda x: x)(v) for v, k in zip(row, kinds, strict=True))


class ExcelSource(StataSource):
    """Sheets of Excel files, where a reader for them is installed."""

    @classmethod
    def name(cls) -> str:
        return "excel"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in excel_header(self.options["path"], self.options.get("sheet"))[0]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ExcelReader(self.options["path"], schema, self.options.get("sheet"))


class ExcelReader(StataReader):
    def __init__(self, path: str, schema: T.StructType, sheet: str | None) -> None:
        super().__init__(path, schema)
        self.sheet = sheet

    def read(self, partition):
        import pandas as pd

        rows = pd.read_excel(self.path, sheet_name=self.sheet or 0, dtype=str)[self.wanted.fieldNames()]
        for row in rows.itertuples(index=False):
            yield tuple(None if v is None or v != v else str(v) for v in row)


def excel_header(path: str, sheet: str | None = None) -> tuple[list[str], list[str]]:
    """Columns of the sheet (blank ones are named by place, doubles are an error) and sheets."""
    try:
        import openpyxl
    except ImportError as e:
        raise EngineError("inspect_failed", "no reader for .xlsx is installed") from e
    book = openpyxl.load_workbook(path, read_only=True, data_only=True)
    try:
        sheets = book.sheetnames
        if (sheet or sheets[0]) not in sheets:
            raise EngineError("sheet_not_found", f"no sheet {sheet}")
        head = next(book[sheet or sheets[0]].iter_rows(values_only=True), ())
    finally:
        book.close()
    return unique_columns([str(c) if c is not None else f"Unnamed: {i}" for i, c in enumerate(head)]), sheets


def unique_columns(names: list[str]) -> list[str]:
    if not names:
        raise EngineError("empty_file", "no columns")
    if len(set(names)) != len(names):
        raise EngineError("duplicate_columns", "column names repeat")
    return names


def kind_of(path: str) -> str:
    kind = path.rstrip("/").rpartition(".")[2].lower()
    kind = "json" if kind == "jsonl" else kind
    if kind not in FORMATS:
        raise EngineError("unsupported_file", f"formats are {', '.join(FORMATS)}")
    return kind


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, sheet: str | None = None) -> DataFrame:
    """A file or folder by its ending. Text columns of CSV without schema are typed by Spark."""
    kind = kind_of(path)
    if kind in ("dta", "xlsx"):
        source = StataSource if kind == "dta" else ExcelSource
        spark.dataSource.register(source)
        reader = spark.read.format(source.name())
        return (reader.option("sheet", sheet) if sheet else reader).load(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, multiLine=False, escape='"')
    return getattr(reader, kind)(path)


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """seq, name, type of the columns, without reading rows where the format allows."""
    fields = read(spark, path).schema.fields
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "seq int, name string, type string")


def inspect_file(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """seq, name, type, label (of Stata columns), format, sheets (of Excel files)."""
    kind, labels, sheets = kind_of(path), {}, []
    if kind == "dta":
        import pandas as pd

        with pd.read_stata(path, iterator=True) as r:
            labels = r.variable_labels()
    elif kind == "xlsx":
        sheets = excel_header(path, sheet)[1]
    fields = read(spark, path, sheet=sheet).schema.fields
    rows = [(i, f.name, f.dataType.simpleString(), labels.get(f.name) or None, kind, sheets) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "seq int, name string, type string, label string, format string, sheets array<string>")


def read_selected(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None, most_rows: int | None = MOST_ROWS) -> DataFrame:
    """The columns, in the order asked for. An empty file or one of over ``most_rows`` (None: any
    number will do) is an error."""
    if not 1 <= len(columns) <= MOST_COLUMNS or len(set(columns)) != len(columns):
        raise EngineError("invalid_columns", f"1 to {MOST_COLUMNS} different columns")
    df = read(spark, path, sheet=sheet)
    if absent := [c for c in columns if c not in df.columns]:
        raise EngineError("import_failed", f"no columns {absent}")
    df = df.select(*columns)
    if most_rows is None:
        if df.isEmpty():
            raise EngineError("invalid_rows", "no rows")
        return df
    n = df.limit(most_rows + 1).count()
    if not 1 <= n <= most_rows:
        raise EngineError("invalid_rows", f"1 to {most_rows} rows")
    return df


def save(df: DataFrame, path: str, name: str) -> DataFrame:
    """Writes the table as Parquet and returns its catalog row: name, path, n_rows, n_columns,
    n_bytes, sha256 (over those of its files in order)."""
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    counted = spark.read.parquet(path).agg(F.count("*").alias("n_rows"))
    files = file_facts(spark, path).where(F.col("path").endswith(".parquet")).agg(F.sum("length").alias("n_bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"))
    # two rows of one each
    return counted.crossJoin(files).select(F.lit(name).alias("name"), F.lit(path).alias("path"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_bytes", "sha256")


def reload(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """With the types of the catalog, so that identifiers keep leading zeros."""
    return spark.read.schema(schema).parquet(path)


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def stored_bytes(spark: SparkSession, paths: list[str], incoming: int = 0, most: int = MOST_STORED_BYTES) -> int:
    """Bytes below the paths; an error if they and what comes exceed the limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    total = int(files.agg(F.sum("length")).first()[0] or 0)
    if total + incoming > most:
        raise EngineError("storage_limit", f"more than {most} bytes")
    return total


RECORD_LINE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("year", T.IntegerType()),
        T.StructField("venue", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("concepts", T.ArrayType(T.StringType())),
    ]
)


# Limits of a library.
MOST_LIBRARY_LINES, MOST_LIBRARY_BYTES, MOST_PDFS, MOST_PDF_BYTES = 2_000, 10 * 1024**2, 200, 30 * 1024**2
LONGEST_TITLE, LONGEST_TEXT, LONGEST_EXCERPT = 2_000, 100_000, 12_000
#: Fields that may be absent but not null.
REQUIRED_TEXT = ("title", "venue", "authors", "concepts")


#: Texts that count as whole numbers.
_WHOLE = r"^\s*[+-]?\d+(?:_\d+)*(?:\.0+)?\s*$"


def read_library(lines: DataFrame, most_lines: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """Records from lines (line, value) of JSON: the fields of RECORD_LINE, valid, and line. A line
    that is no object, has no text as title, or a field of another type, is kept as invalid and can
    be reported. Whole numbers may be given as text or with zero decimals.

    Lines are parsed to variants, whose own types decide. ``most_lines``: of lines, numbered from 0, the
    first so many are read; ``most_bytes``: a larger library is an error."""
    if most_bytes is not None:
        size = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
        if size > most_bytes:
            raise EngineError("library_too_large", f"{size} bytes, {most_bytes} at most")
    if most_lines is not None:
        lines = lines.where(F.col("line") < most_lines)
    parsed = lines.where(F.trim("value") != "").withColumn("_v", F.try_parse_json("value"))
    part = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    typed, fields = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)), []
    for f in RECORD_LINE.fields:
        kind = F.coalesce(F.schema_of_variant(part(f.name)), F.lit("ABSENT"))
        text = F.try_variant_get("_v", f"$.{f.name}", "string")
        absent = (kind == "ABSENT") | ((kind == "VOID") & F.lit(f.name not in REQUIRED_TEXT))
        if isinstance(f.dataType, T.IntegerType):
            good = kind.isin("BIGINT", "BOOLEAN") | ((kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "STRING")) & text.rlike(_WHOLE))
            value = F.when(kind == "BOOLEAN", F.try_variant_get("_v", f"$.{f.name}", "boolean").cast("int")).otherwise(F.regexp_replace(F.trim(text), r"_|\.0+$", "").try_cast("int"))
        elif isinstance(f.dataType, T.StringType):
            good, value = kind == "STRING", text
        else:
            value = F.try_variant_get("_v", f"$.{f.name}", "array<string>")
            good = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.coalesce(~F.exists(value, lambda x: x.isNull()), F.lit(False))
        typed = typed & F.coalesce(absent | good, F.lit(False))
        fields.append(F.when(absent | ~F.coalesce(good, F.lit(False)), F.lit(None)).otherwise(value).cast(f.dataType).alias(f.name))
    read = parsed.select("line", *fields, typed.alias("_typed"))
    valid = F.col("_typed") & F.col("title").isNotNull() & (F.trim("title") != "") & (F.length("title") <= LONGEST_TITLE)
    return read.select("line", *RECORD_LINE.fieldNames(), F.coalesce(valid, F.lit(False)).alias("valid"))


def library_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid records of a library within its limits, and line, problem of what is left out."""
    read = read_library(lines, MOST_LIBRARY_LINES, MOST_LIBRARY_BYTES)
    beyond = lines.where(F.col("line") == MOST_LIBRARY_LINES).select("line", F.lit("beyond_limit").alias("problem"))
    return read.where("valid").drop("valid"), bad_lines(read).unionByName(beyond)


def bad_lines(library: DataFrame) -> DataFrame:
    """line, problem for the lines of a library that are left out."""
    return library.where(~F.col("valid")).select("line", F.lit("invalid").alias("problem"))


def scan_folder(spark: SparkSession, path: str, most_files: int | None = MOST_PDFS, most_bytes: int = MOST_PDF_BYTES) -> DataFrame:
    """path, length, content, problem of the PDF files below a folder, by name: the first
    ``most_files`` (None: all), without content where a file is too large or is none. Spark passes over files
    without bytes. Reading their text takes a parser, which is not part of this library."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    kept = files if most_files is None else files.join(files.select("path").orderBy("path").limit(most_files), "path", "left_semi")
    problem = F.when(F.col("length") > most_bytes, "too_large").when(F.substring(F.col("content"), 1, 4) != F.lit(b"%PDF"), "not_a_pdf")
    return kept.select("path", "length", F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("problem"))


def merge_metadata(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """What a metadata table holds after a merge: of each key the row with the largest version, an
    incoming one before a stored one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.select(*stored.columns).withColumn("_new", F.lit(1)))
    whole = F.struct(*stored.columns)
    return both.groupBy(F.col(key).alias("_k")).agg(F.max_by(whole, F.struct(version, "_new")).alias("r")).select("r.*")


def document_record(texts: DataFrame) -> DataFrame:
    """path, title, doi, year, excerpt from texts (path, text, title of the file's metadata): the
    title falls back to the first line of over five characters, then to the file's name. The DOI
    is looked for on the first page (first_page, or what comes before a form feed), the year in
    imprint, if there is such a column, else in the first 5,000 characters, title included."""
    head = F.substring("text", 1, LONGEST_TEXT)
    line = F.get(F.filter(F.transform(F.split(head, r"\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 5), F.lit(0))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), line, F.regexp_extract("path", r"([^/]+)$", 1))
    page = F.col("first_page") if "first_page" in texts.columns else F.substring_index("text", "\f", 1)
    doi = F.nullif(F.lower(F.regexp_replace(F.regexp_extract(page, r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1), "[.,;]+$", "")), F.lit(""))
    dated = F.col("imprint") if "imprint" in texts.columns else F.substring(head, 1, 5000)
    year = F.nullif(F.regexp_extract(dated, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")
    return texts.select("path", F.substring(title, 1, LONGEST_TITLE).alias("title"), doi.alias("doi"), year.alias("year"), F.substring(head, 1, LONGEST_EXCERPT).alias("excerpt"))


def write_markdown(sections: DataFrame, path: str) -> None:
    """Sections (document, seq, title, body) as one Markdown text for each document."""
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("body"))
    listed = sections.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("seq", part.alias("p")))).alias("all"))
    listed.select(F.concat(F.lit("# "), F.col("document"), F.lit("\n\n"), F.array_join(F.transform("all", lambda x: x["p"]), "\n\n"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def prepare_case(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns selected and renamed, no rows filtered."""
    if absent := [c for c in names if c not in df.columns]:
        raise EngineError("import_failed", f"no columns {absent}")
    return df.select([F.col(a).alias(b) for a, b in names.items()])
