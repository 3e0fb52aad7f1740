"""Sources and sinks of document tables.

Every path goes to Spark's own readers and writers, so any file system that Spark
knows will do.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import importlib.resources
import json
import platform
import sys
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators.relational import IntegrityError, numbered, require_unique

RULER = "=" * 100
_BOM = "﻿"


# --- files --------------------------------------------------------------------------------


def binary_corpus(spark: SparkSession, path: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, sha256, content) of all matching files below ``path``, by lower-case path; an error if there is none."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    rows = rows.select("path", F.sha2("content", 256).alias("sha256"), "content")
    if rows.select("path").isEmpty():
        raise IntegrityError(f"no file at {path} matches {glob}")
    return rows.orderBy(F.lower("path"))


def extracted(files: DataFrame, extract: Callable[[bytes], list[str]] | Sequence[Callable[[bytes], list[str]]], ocr: Callable[[bytes], list[str]] | None = None, least: int = 30) -> DataFrame:
    """(path, page, text, error, by): the pages of each file. Extractors are tried in order until one finds ``least`` words;
    else the one that found most counts, and after it ``ocr``, if given. ``by`` is the place of the one that counted, -1
    for ``ocr``. A file on which all fail gives one row with their errors; one that only some fail on gives its pages."""
    chain = [extract] if callable(extract) else list(extract)
    tried = [*enumerate(chain), *([(-1, ocr)] if ocr is not None else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                best, errors = None, []
                for by, f in tried:
                    try:
                        pages = f(bytes(content))
                    except Exception as e:  # noqa: BLE001  reported as a row
                        errors.append(f"{type(e).__name__}: {e}")
                        continue
                    words = sum(len(p.split()) for p in pages)
                    if best is None or words > best[0]:
                        best = (words, by, pages)
                    if words >= least:
                        break
                if best is None:
                    out.append((path, None, None, "; ".join(errors), None))
                else:
                    out += [(path, i, page, None, best[1]) for i, page in enumerate(best[2], 1)]
            yield pd.DataFrame(out, columns=["path", "page", "text", "error", "by"]).astype({"page": "Int64", "by": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, page long, text string, error string, by long")


def json_lines(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """(doc_id, filename, text, sha256) from JSON lines, compressed or not; ids and hashes are made where they lack."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.regexp_replace("value", f"^{_BOM}", "").alias("j"))
    got = rows.select(*[F.get_json_object("j", f"$.{c}").alias(c) for c in ("doc_id", "filename", text, "sha256")])
    sha = F.coalesce("sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return got.select(
        F.coalesce("doc_id", F.concat(F.lit("D"), F.substring(sha, 1, 12))).alias("doc_id"), F.coalesce("filename", F.lit("")).alias("filename"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), sha.alias("sha256"),
    )


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, strings only, a byte order mark dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip(_BOM) for c in rows.columns])


def write_csv(rows: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header; columns that rows lack are empty."""
    names = list(columns or rows.columns)
    rows.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in names]).write.option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def log_event(spark: SparkSession, path: str, event: str, **fields) -> None:
    """Appends a timestamped event to a log of JSON lines."""
    spark.createDataFrame([(event, json.dumps(fields, sort_keys=True, default=str))], "event string, fields string").withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """(heading, row, cells) of a Markdown file's tables; row 0 is a table's header, separators are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("n", "line"))
    return markdown_rows(lines)


def markdown_rows(lines: DataFrame) -> DataFrame:
    """``markdown_tables`` from (n, line) rows of one file."""
    packed = lines.agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))  # one file
    start = F.struct(F.lit("").alias("heading"), F.lit(-1).alias("row"), F.array().cast("array<struct<heading: string, row: int, cells: array<string>>>").alias("out"))

    def step(acc, x):
        line = F.trim(x["line"])
        heading, table, ruler = line.rlike("^#+ "), line.startswith("|"), line.rlike(r"^\|[\s:|-]+\|?$")
        cells = F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|", -1), T.markdown_cell)
        row = F.when(table & ~ruler, acc["row"] + 1).when(table, acc["row"]).otherwise(-1)
        name = F.when(heading, F.regexp_replace(line, r"^#+ ", "")).otherwise(acc["heading"])
        return F.struct(name.alias("heading"), row.alias("row"), F.when(table & ~ruler, F.array_append(acc["out"], F.struct(name.alias("heading"), row.alias("row"), cells.alias("cells")))).otherwise(acc["out"]).alias("out"))

    return packed.select(F.explode(F.aggregate("l", start, step, lambda a: a["out"])).alias("t")).select("t.*")


# --- records in one text ------------------------------------------------------------------


_STRIPPED = " \t\n\r\x0b\x0c"
START = "DOC_ID:"


def _fields(records: DataFrame) -> DataFrame:
    """(doc_id, filename, pages, words, text) from records (r); header fields count in a record's first 12 lines only."""
    head = F.array_join(F.slice(F.split("r", "\n", -1), 1, 12), "\n")
    value = lambda name: F.btrim(F.regexp_extract(head, rf"(?dm)^{name}:[ \t]*(.*)$", 1), F.lit(_STRIPPED))
    body = F.regexp_replace("r", r"(?s)\A.*?(?<=\n)EXTRACTED_WORDS:[^\n]*\n?", "")
    return records.select(value("DOC_ID").alias("doc_id"), value("FILENAME").alias("filename"), T.forgiving_int(value("PAGES")).alias("pages"), T.forgiving_int(value("EXTRACTED_WORDS")).alias("words"), F.trim(body).alias("text"))


def parse_records(text: DataFrame) -> DataFrame:
    """(doc_id, filename, pages, words, text) from texts (value) of header blocks: lines DOC_ID, FILENAME, PAGES and
    EXTRACTED_WORDS between rulers, then the body."""
    return _fields(text.select(F.explode(F.split("value", rf"(?dm)(?=^{START})")).alias("r")).filter(F.col("r").startswith(START)))


def record_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, r): the header-block records of text files, from their DOC_ID on. What stands before a file's first record
    is left out.

    Files are read by ranges: a record's start is the reader's line separator, so a task that begins inside a file goes on
    to the next record there, and one large file gives as many tasks as it has ranges. Only compressed files are read
    whole, a record at a time. The separator is cut off; a record that begins its file stands behind none, and is told
    from what isn't a record by the rows' order in a range."""
    rows = spark.read.option("lineSep", f"\n{START}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for place, value in zip(zip(*(c.to_pylist() for c in b.columns[:2]), strict=True), b.column(2), strict=True):
                value = value.as_py()
                first, last = place[1] == 0 and place != last, place
                out.append(START + value if not first else value if (value := value.removeprefix(_BOM)).startswith(START) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "r"])

    return rows.mapInArrow(run, "path string, r string").filter("r IS NOT NULL")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, filename, pages, words, text) of the header-block records in files, bodies without white space at their ends.
    A body line that begins with DOC_ID: starts a record, as ``checked_record_text`` guards against. Files without a
    record give no rows."""
    rows = _fields(record_blocks(spark, path).select("r"))
    return rows.withColumn("text", F.btrim("text", F.lit(_STRIPPED)))


def record_text(docs: DataFrame) -> DataFrame:
    """(doc_id, value): each document that isn't empty as a header block."""
    field = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit("")))
    value = F.concat_ws("\n", F.lit(RULER), field("DOC_ID", F.col("doc_id")), field("FILENAME", F.col("filename")), field("PAGES", F.col("pages")), field("EXTRACTED_WORDS", T.count_words(F.col("text"))), F.lit(RULER), F.col("text"))
    return docs.filter(F.trim("text") != "").select("doc_id", value.alias("value"))


def checked_record_text(docs: DataFrame, expected: DataFrame) -> DataFrame:
    """``record_text``, or an error: ids must be just those of ``expected`` (doc_id, pages and, if it has them, words), each
    once, pages and words equal, and no body line may look like a record's start."""
    require_unique(docs, ["doc_id"])
    require_unique(expected, ["doc_id"])
    ids = docs.select("doc_id")
    for a, b, name in ((ids, expected, "not expected"), (expected.select("doc_id"), ids, "missing")):
        odd = a.join(b.select("doc_id"), "doc_id", "left_anti").limit(5).collect()
        if odd:
            raise IntegrityError(f"documents {name}: {[r[0] for r in odd]}")
    wrong = docs.join(expected.select("doc_id", F.col("pages").alias("__p")), "doc_id").filter(~F.col("pages").eqNullSafe(F.col("__p")))
    marked = docs.filter(F.col("text").rlike(r"(?m)^DOC_ID:"))
    found = [(wrong, "other page counts"), (marked, "body lines that start a record")]
    if "words" in expected.columns:
        both = docs.join(expected.select("doc_id", F.col("words").alias("__w")), "doc_id")
        found.append((both.filter(~T.count_words(F.coalesce("text", F.lit(""))).eqNullSafe(F.col("__w"))), "other word counts"))
    for rows, name in found:
        odd = rows.select("doc_id").limit(5).collect()
        if odd:
            raise IntegrityError(f"documents with {name}: {[r[0] for r in odd]}")
    return record_text(docs)


def write_records(docs: DataFrame, path: str) -> None:
    record_text(docs).select("value").write.text(path)


# --- graphs, workbooks, packages ------------------------------------------------------------


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, n, value): a GraphML document's elements in order of part and n; edges are numbered from e1."""
    # line ends as references, so that an element is a line, and comes back as it was
    escaped = lambda c: F.replace(F.replace(T.xml_escape(T.xml_safe(c)), F.lit("\n"), F.lit("&#10;")), F.lit("\r"), F.lit("&#13;"))
    attr = lambda names: F.concat(*[F.concat(F.lit(f'<data key="{c}">'), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</data>")) for c in names])
    ident = lambda c: escaped(F.col(c))
    a = numbered(nodes, ["id"], "__n").select(F.lit(1).alias("part"), F.col("__n").alias("n"), F.concat(F.lit('<node id="'), ident("id"), F.lit('">'), attr([c for c in nodes.columns if c != "id"]), F.lit("</node>")).alias("value"))
    e = F.col("__n")
    b = numbered(edges, ["source", "target", "relation"], "__n").select(F.lit(2).alias("part"), e.alias("n"), F.concat(F.lit('<edge id="e'), e.cast("string"), F.lit('" source="'), ident("source"), F.lit('" target="'), ident("target"), F.lit('">'), attr([c for c in edges.columns if c not in ("source", "target")]), F.lit("</edge>")).alias("value"))
    return a.unionByName(b)


#: GraphML's names of types; all others are strings.
_KINDS = {"long": "bigint", "int": "int", "double": "double", "float": "float", "boolean": "boolean", "string": "string"}


def _keys(rows: DataFrame, on: str, without: Sequence[str]) -> list[str]:
    kinds = {v: k for k, v in _KINDS.items()}
    return [f'<key id="{c}" for="{on}" attr.name="{c}" attr.type="{kinds.get(t, "string")}"/>' for c, t in rows.dtypes if c not in without]


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as one GraphML file: elements are dealt by ranges of their order and written side by side, then joined."""
    spark = nodes.sparkSession
    keys = [*_keys(nodes, "node", ["id"]), *_keys(edges, "edge", ["source", "target"])]
    frame = [(0, 0, '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), *[(0, k, v) for k, v in enumerate(keys, 1)], (0, len(keys) + 1, '<graph edgedefault="directed">'), (3, 0, "</graph></graphml>")]
    rows = graphml(nodes, edges).unionByName(spark.createDataFrame(frame, "part int, n int, value string"))
    write_ordered(rows, ["part", "n"], "value", path)


#: A line that holds a whole key, node or edge, and one that holds none, nor a comment or section that may hide one.
_WHOLE, _NONE = r"^<(?:key|node|edge)(?:\s[^<>]*)?(?:/>|>(?:<data[^<>]*(?:/>|>[^<>]*</data>))*</(?:key|node|edge)>)\r?$", r"<(?:key|node|edge)[\s/>]|<data[\s/>]|</(?:key|node|edge|data)\s*>|<!--|<!\[CDATA\["


def _an_element_a_line(spark: SparkSession, path: str) -> bool:
    """Whether each key, node and edge of GraphML files stands on a line of its own, found in one pass over their ranges."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.filter(~F.col("value").rlike(_WHOLE) & F.col("value").rlike(_NONE)).isEmpty()


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, ...) and edges (source, target, ...) of a GraphML file, or of a folder of its parts, attributes with their
    names and types; an element without an attribute has null there. A file with each element on a line of its own, as
    ``write_graphml`` writes, is read by ranges; of others a task reads a whole file, as the XML reader does."""
    element = "data array<struct<_key: string, _VALUE: string>>"
    options = {"attributePrefix": "_", "ignoreSurroundingSpaces": "false"}
    lined = _an_element_a_line(spark, path)

    def read(tag: str, schema: str) -> DataFrame:
        if not lined:
            return spark.read.format("xml").option("rowTag", tag).options(**options).schema(schema).load(path)
        lines = spark.read.option("lineSep", "\n").text(path).filter(F.col("value").rlike(rf"^<{tag}[\s/>]"))
        return lines.select(F.from_xml("value", schema, options).alias("x")).select("x.*")

    keys = read("key", "_id string, _for string, `_attr.name` string, `_attr.type` string").collect()  # a row for each column
    out = []
    for on, ends in (("node", ["id"]), ("edge", ["source", "target"])):
        rows = read(on, ", ".join([*[f"_{c} string" for c in ends], element]))
        values = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key: string, _VALUE: string>>")), lambda d: F.struct(d["_key"], F.coalesce(d["_VALUE"], F.lit("")))))
        own = []
        for k in keys:
            if k["_for"] in (on, "all"):
                kind = _KINDS.get(k["_attr.type"], "string")
                value = F.col("__values")[k["_id"]]
                own.append((value if kind == "string" else F.when(value != "", value).try_cast(kind)).alias(k["_attr.name"]))
        out.append(rows.withColumn("__values", values).select(*[F.col(f"_{c}").alias(c) for c in ends], *own))
    return out[0], out[1]


# --- files of a fixed order -------------------------------------------------------------------


def write_ordered(rows: DataFrame, order: Sequence[str], value: str, path: str) -> None:
    """``value`` of each row as a line of one file, in an order. Ranges of the order are written side by side; the file
    system then appends the parts to each other, a buffer at a time, so neither a task nor the driver holds the file."""
    spark, parts = rows.sparkSession, path + ".parts"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(value).write.mode("overwrite").option("compression", "none").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    fs = here.getFileSystem(conf)
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    stream = fs.create(here, True)
    try:
        for name in names:
            source = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
            finally:
                source.close()
    finally:
        stream.close()
    fs.delete(folder, True)


def write_canonical(rows: DataFrame, order: Sequence[str], path: str, files: int = 8) -> None:
    """``rows`` as JSON lines in ``files`` files whose bytes depend on the rows alone: by ``order`` - and all columns after
    it, for ties -, cut into equal shares, columns by name, nulls written out."""
    names = sorted(rows.columns)
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    keyed = rows.select(*[F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(order)], line.alias("line"))
    by = [*[f"o{k}" for k in range(len(order))], "line"]
    placed = numbered(keyed, by, "n", 0)
    total = placed.count()
    part = F.floor(F.col("n") * files / F.lit(max(total, 1))).cast("int")
    placed.withColumn("part", part).repartitionById(files, "part").sortWithinPartitions("n").select("line").write.option("compression", "none").text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(part, bytes, sha256) of the part files of a written table; a part without rows may have no file."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")
    return rows.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def reruns_identical(spark: SparkSession, build: Callable[[], Mapping[str, tuple[DataFrame, Sequence[str]]]], path: str, files: int = 8) -> DataFrame:
    """(name, part, agree): whether two runs of ``build`` - a frame and its order for each name - give the same bytes in
    each file. A file that only one run has agrees with none."""
    found = []
    for k in (1, 2):
        for name, (rows, order) in build().items():
            write_canonical(rows, order, f"{path}/{k}/{name}", files)
            found.append(file_digests(spark, f"{path}/{k}/{name}").select(F.lit(name).alias("name"), F.lit(k).alias("run"), "part", "sha256"))
    rows = reduce(DataFrame.union, found)
    return rows.groupBy("name", "part").agg(((F.count("*") == 2) & (F.countDistinct("sha256") == 1)).alias("agree"))


def write_sheets(sheets: Mapping[str, DataFrame], path: str) -> None:
    """A workbook as a folder: a Parquet table for each sheet."""
    for name, rows in sheets.items():
        rows.write.parquet(f"{path}/{name}")


def package_manifest(spark: SparkSession, path: str, private: Sequence[str] = ()) -> DataFrame:
    """(path, bytes, sha256) of all files below ``path`` but those whose path holds a private name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    for name in private:
        rows = rows.filter(~F.col("path").contains(name))
    return rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def code_digest(package: str = "inkstone") -> str:
    """SHA-256 of a package's own source, module by module in order of their names, through its loader: from folders and
    archives alike. A package without source is an error."""
    whole, modules = hashlib.sha256(), 0

    def read(node, name: str) -> None:
        nonlocal modules
        for x in sorted(node.iterdir(), key=lambda x: x.name):
            if x.is_dir():
                read(x, f"{name}/{x.name}")
            elif x.name.endswith(".py"):
                whole.update(f"{name}/{x.name}".encode() + b"\0" + x.read_bytes() + b"\0")
                modules += 1

    read(importlib.resources.files(package), package)
    if not modules:
        raise IntegrityError(f"{package} has no source to digest")
    return whole.hexdigest()


def versions(packages: Sequence[str] = ("pyspark", "pyarrow", "numpy", "pandas")) -> dict[str, str]:
    """Of the packages that are installed."""
    out = {}
    for name in packages:
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            continue
    return out


def run_record(spark: SparkSession, config: Mapping, timings: Mapping[str, float] | None = None) -> DataFrame:
    """One row about a run: a number of its own; settings and a digest of them, the packages and the code, which stays the
    same while nothing that matters changes; versions, host, and the seconds of its steps."""
    text, packages, code = json.dumps(dict(config), sort_keys=True, default=str), versions(), code_digest()
    digest = hashlib.sha256(json.dumps([text, packages, code]).encode()).hexdigest()
    row = (
        uuid.uuid4().hex, text, digest, code, json.dumps(packages, sort_keys=True), sys.version.split()[0], spark.version, platform.platform(), platform.node(),
        json.dumps(dict(timings or {}), sort_keys=True),
    )
    names = ("run", "config", "digest", "code", "packages", "python", "spark", "system", "host", "timings")
    return spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))


def report(title: str, facts: Mapping[str, object], tables: Mapping[str, DataFrame], prose: Sequence[str] = (), limit: int = 50) -> str:
    """A Markdown report: facts as a list, paragraphs, and each table's first ``limit`` rows."""
    cell = lambda v: ("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", "", *[f"* {k}: {cell(v)}" for k, v in facts.items()], ""]
    for paragraph in prose:
        out += [paragraph, ""]
    for name, rows in tables.items():
        out += [f"## {name}", "", f"| {' | '.join(rows.columns)} |", "|" + "---|" * len(rows.columns)]
        out += [f"| {' | '.join(map(cell, r))} |" for r in rows.limit(limit).collect()]
        out.append("")
    return "\n".join(out)


def table_guide(title: str, tables: Mapping[str, DataFrame], about: Mapping[str, str]) -> str:
    """A Markdown guide to the tables of a run: what each holds, its rows, and its columns with their types. A table without
    a line in ``about`` is an error, so that none is left unexplained."""
    missing = sorted(set(tables) - set(about))
    if missing:
        raise IntegrityError(f"tables without a description: {missing}")
    out = [f"# {title}", ""]
    for name in sorted(tables):
        out += [f"## {name}", "", f"{about[name]} {tables[name].count()} rows.", "", "| column | type |", "|---|---|"]
        out += [f"| {c} | {t} |" for c, t in tables[name].dtypes] + [""]
    return "\n".join(out)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A text as one file, on any file system that Spark knows."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on any file system that Spark knows."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def worksheets(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raters' blinded rows, and the key, from intruder tasks (topic, options, intruder)."""
    task = F.substring(F.sha2(F.concat_ws("|", F.col("topic").cast("string"), F.array_join("options", ",")), 256), 1, 10).alias("task_id")
    blind = tasks.select(task, "options", F.lit(None).cast("int").alias("coherence_rating"), F.lit(None).cast("string").alias("intruder_choice"), F.lit("").alias("proposed_label"))
    return blind, tasks.select(task, "topic", F.col("intruder").alias("correct"))


# --- a text generator -----------------------------------------------------------------------


def generated(requests: DataFrame, generate: Callable[[str], dict], retries: int = 2, wait: float = 5.0, limit: float = 900.0) -> DataFrame:
    """(batch, request_sha256, done, done_reason, response, attempts): each prompt through ``generate``, which gives a
    mapping of the three before. A try that fails or takes longer than ``limit`` seconds is followed by another after
    ``wait`` seconds and as many more each time; an error after all tries gives done false and the error as reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for batch, sha, prompt in zip(b["batch"], b["request_sha256"], b["prompt"], strict=True):
                got: dict = {}
                for attempt in range(retries + 1):
                    if attempt:
                        time.sleep(wait * attempt)
                    pool = ThreadPoolExecutor(1)
                    try:
                        got = pool.submit(generate, prompt).result(timeout=limit)
                        break
                    except TimeoutError:
                        got = {"done": False, "done_reason": f"no answer in {limit:g} s", "response": ""}
                    except Exception as e:  # noqa: BLE001  reported as a row
                        got = {"done": False, "done_reason": f"{type(e).__name__}: {e}", "response": ""}
                    finally:
                        pool.shutdown(wait=False, cancel_futures=True)
                out.append((batch, sha, bool(got["done"]), got["done_reason"], got["response"], attempt + 1))
            yield pd.DataFrame(out, columns=["batch", "request_sha256", "done", "done_reason", "response", "attempts"])

    return requests.select("batch", "request_sha256", "prompt").mapInPandas(run, "batch long, request_sha256 string, done boolean, done_reason string, response string, attempts int")


def fit_check(requests: DataFrame, answer: int, context: int, largest_ratio: float | None = None) -> DataFrame:
    """(batch, characters, tokens, fits): whether a prompt and an answer of so many tokens fit the context, by the largest
    observed ratio of tokens to characters, or the usual upper estimate."""
    tokens = T.fitted_budget(F.col("prompt"), F.lit(largest_ratio).cast("double"))
    return requests.select("batch", F.length("prompt").alias("characters"), tokens.alias("tokens"), (tokens + answer <= context).alias("fits"))


def observed_ratio(responses: DataFrame) -> float | None:
    """The largest ratio of tokens to characters in (prompt, prompt_tokens) rows; fewer than one token for eight characters
    is no count of the whole prompt and is left out."""
    ratio = F.col("prompt_tokens") / F.length("prompt")
    return responses.filter((F.length("prompt") > 0) & (ratio >= 1 / 8)).agg(F.max(ratio)).first()[0]


def coverage_gate(batched: DataFrame, documents: DataFrame) -> DataFrame:
    """One row (documents, missing, repeated, foreign, covered): whether each document stands in just one batch."""
    n = batched.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = documents.select("doc_id", F.lit(1).alias("due")).join(n, "doc_id", "full_outer")
    rows = rows.agg(
        F.count("due").alias("documents"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("due").isNull()).alias("foreign"),
    )
    return rows.withColumn("covered", (F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("foreign") == 0))


def outstanding(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a complete response to the very same text."""
    whole = responses.filter(T.complete_response(F.col("done"), F.col("done_reason"), F.col("response")))
    return requests.join(whole.select("request_sha256").distinct(), "request_sha256", "left_anti")


def completion_gate(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One row (requests, complete, open): a synthesis may go ahead if open."""
    missing = outstanding(requests, responses)
    return requests.agg(F.count("*").alias("requests")).join(missing.agg(F.count("*").alias("missing"))).select("requests", (F.col("requests") - F.col("missing")).alias("complete"), (F.col("missing") == 0).alias("open"))


def ask(requests: DataFrame, generate: Callable[[str], dict], path: str, per_task: int = 1, **how) -> DataFrame:
    """The answers at ``path`` after each request (batch, request_sha256, prompt) without a complete one has been asked for
    once more; equal requests are asked for once. ``how``: as ``generated`` takes it.

    A task asks ``per_task`` requests, and its answers are moved to ``path`` when it ends, whatever becomes of the others:
    a worker, an executor or a driver that is lost costs the requests that were on their way, and a second call asks only
    for what isn't answered."""
    spark = requests.sparkSession
    schema = "batch long, request_sha256 string, done boolean, done_reason string, response string, attempts int"
    have = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    todo = outstanding(requests, have).groupBy("request_sha256").agg(F.min("batch").alias("batch"), F.min("prompt").alias("prompt"))
    todo = numbered(todo, ["batch", "request_sha256"], "n", 0)
    n = todo.count()
    if n:
        tasks = -(-n // per_task)
        dealt = todo.withColumn("task", F.floor(F.col("n") / per_task).cast("int")).repartitionById(tasks, "task")
        # the second version of the committer puts a task's files in place when the task ends, not when the job does
        generated(dealt, generate, **how).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if n or exists(spark, path) else have


#: A heading of a response: a number with a point, at a line's start, behind marks of a heading or none.
HEADING = r"(?m)^[ \t]*(?:#+[ \t]*)?\d\.\s"


def response_audit(responses: DataFrame, members: DataFrame, pattern: str = r"\b(\d+)\b") -> DataFrame:
    """(batch, own, foreign, words, headings): ids of its own batch that a response names, other numbers, its words and its
    numbered headings."""
    rows = responses.join(members, "batch")
    named = F.array_distinct(F.regexp_extract_all("response", F.lit(T.ascii_edges(pattern)), F.lit(1)))
    own = F.transform("members", lambda m: m.cast("string"))
    return rows.select("batch", F.size(F.array_intersect(named, own)).alias("own"), F.size(F.array_except(named, own)).alias("foreign"), T.count_words(F.col("response")).alias("words"), F.regexp_count("response", F.lit(HEADING)).cast("long").alias("headings"))


def identity_gate(found: Mapping[str, object], recorded: Mapping[str, str], prefixes: Sequence[str] = ("digest",)) -> None:
    """Stops if a model differs from the one on record: a field named in ``prefixes`` must begin with the recorded value, a
    list must hold it, any other field must equal it."""
    wrong = []
    for k, v in recorded.items():
        have = found.get(k)
        same = v in have if isinstance(have, (list, tuple, set)) else str(have or "").startswith(v) and bool(v) if k in prefixes else have == v
        if not same:
            wrong.append(k)
    if wrong:
        raise IntegrityError(f"the model differs from the one on record in {wrong}")
