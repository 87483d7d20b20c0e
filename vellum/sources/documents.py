"""Binary documents as Spark tables: scans of objects, edges, pages, instructions and text, and sinks.

A document is one row of the binary-file source, and every scan maps rows to rows: no shuffle, one
parse a document and scan. What can't be read is a row of the failures table, never an exception.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellum.functions.codecs import UnsupportedFilter, decode_filters
from vellum.sources import cos

FAILURE_EXAMPLES = 100
#: What reading a damaged document may raise.
UNREADABLE = (ValueError, EOFError, RecursionError, TypeError, IndexError, KeyError, AttributeError, OverflowError)
OBJECTS = "doc_id string, num long, gen int, type string, kind string, subtype string, keys array<string>, value string, filters array<string>, raw binary, raw_len long, data_sha256 string"
EDGES = "doc_id string, src long, key string, key_path array<string>, dst long"
PAGES = "doc_id string, page int, num long, x0 double, y0 double, x1 double, y1 double, user_unit double, rotate int, content binary, complete boolean"
INSTRUCTIONS = "doc_id string, page int, seq long, op string, operands array<struct<num:double,name:string,str:binary>>, start long, end long, complete boolean"
FAILURES = "path string, error string"


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all .pdf files below a path, whatever their case; a single file works too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").endswith(".pdf")).select("path", "content")


def _over(each: Callable[[cos.Document], Iterator[tuple]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                try:
                    doc = cos.parse(content.as_py() or b"")
                except UNREADABLE:
                    continue  # it stands among the failures
                rows = []
                try:
                    for row in each(doc):
                        rows.append(row)
                        if len(rows) >= 2000:
                            yield _batch(rows, schema)
                            rows = []
                except UNREADABLE:
                    pass  # what was read stays; the document stands among the failures
                if rows:
                    yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _scan(files: DataFrame, ddl: str, each: Callable[[cos.Document], Iterator[tuple]], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of every document; of those with `columns` named, no others are made for them."""
    kind = StructType.fromDDL(ddl)
    if columns is not None:
        kind = StructType([kind[c] for c in columns])
    return files.select("content").mapInArrow(_over(each, to_arrow_schema(kind)), kind)


def _plain(value) -> object:
    """A value for JSON: names as /name, references as n g R, bytes in hexadecimal."""
    if isinstance(value, cos.Ref):
        return f"{value.num} {value.gen} R"
    if isinstance(value, cos.Name):
        return f"/{value}"
    if isinstance(value, bytes):
        return f"<{value.hex()}>"
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


_TYPES = ((cos.Stream, "stream"), (dict, "dictionary"), (list, "array"), (cos.Name, "name"), (bytes, "string"), (bool, "boolean"), ((int, float), "number"), (cos.Ref, "reference"), (type(None), "null"))


def type_of(value) -> str:
    """The name of a value's type."""
    return next((name for t, name in _TYPES if isinstance(value, t)), "null")


def own_entries(value) -> dict:
    """The entries of a dictionary or a stream; none for other values."""
    return value.dict if isinstance(value, cos.Stream) else value if isinstance(value, dict) else {}


def own_name(doc: cos.Document, own: dict, key: str) -> str | None:
    """An entry that is a name, following references."""
    return str(v) if isinstance(v := doc.get(own.get(key)), cos.Name) else None


def object_columns(doc: cos.Document, ref: cos.Ref, value, columns: Sequence[str]) -> dict:
    """The named ones of OBJECTS' columns for an object."""
    import hashlib

    own, raw = own_entries(value), value.raw if isinstance(value, cos.Stream) else None
    row = {"doc_id": doc.sha256, "num": ref.num, "gen": ref.gen, "raw": raw, "raw_len": None if raw is None else len(raw)}
    if "type" in columns:
        row["type"] = type_of(value)
    for column, key in (("kind", "Type"), ("subtype", "Subtype")):
        if column in columns:
            row[column] = own_name(doc, own, key)
    if "keys" in columns:
        row["keys"] = sorted(own)
    if "data_sha256" in columns:
        row["data_sha256"] = None
        if raw is not None:
            try:
                row["data_sha256"] = hashlib.sha256(doc.decoded(value)).hexdigest()
            except (ValueError, TypeError, IndexError):
                pass
    if "filters" in columns:
        row["filters"] = doc.filters(value)[0] if raw is not None else None
    if "value" in columns:
        row["value"] = json.dumps(_plain(own or value if raw is None else own), sort_keys=True)
    return row


OBJECT_COLUMNS = tuple(part.split()[0] for part in OBJECTS.split(", "))


def _objects(doc: cos.Document, columns: Sequence[str] = OBJECT_COLUMNS) -> Iterator[tuple]:
    for ref, value in sorted(doc.objects.items()):
        row = object_columns(doc, ref, value, columns)
        yield tuple(row[c] for c in columns)


def scan_objects(files: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row an object: type, keys, value as JSON, and a stream's filters, encoded bytes and decoded digest.

    `columns` names those that are wanted; what the others hold is neither decoded nor written.
    """
    wanted = tuple(columns or OBJECT_COLUMNS)
    return _scan(files, OBJECTS, lambda doc: _objects(doc, wanted), wanted)


def _edges(doc: cos.Document) -> Iterator[tuple]:
    for path, ref in cos.references({k: v for k, v in doc.trailer.items() if k in ("Root", "Info")}):
        yield doc.sha256, 0, path[-1], list(path), ref.num
    for ref, value in sorted(doc.objects.items()):
        for path, to in cos.references(value):
            key = next((p for p in reversed(path) if not p.isdigit()), "")
            yield doc.sha256, ref.num, key, list(path), to.num


def scan_edges(files: DataFrame) -> DataFrame:
    """One row a reference; those of the trailer come from object 0. Missing targets stay in."""
    return _scan(files, EDGES, _edges)


def _box(doc: cos.Document, page: dict) -> tuple[float, float, float, float]:
    for key in ("CropBox", "MediaBox"):
        found = [doc.get(v) for v in doc.get(page.get(key)) or []] if isinstance(doc.get(page.get(key)), list) else []
        if len(found) == 4 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in found):
            return min(found[0], found[2]), min(found[1], found[3]), max(found[0], found[2]), max(found[1], found[3])
    return 0.0, 0.0, 612.0, 792.0


def _pages(doc: cos.Document) -> Iterator[tuple]:
    for i, (ref, page) in enumerate(doc.pages()):
        try:
            content, whole = doc.content(page), True
        except (ValueError, TypeError, IndexError):
            content, whole = b"", False
        unit = doc.get(page.get("UserUnit", 1.0))
        unit = float(unit) if isinstance(unit, (int, float)) and not isinstance(unit, bool) and 0 < unit < float("inf") else None
        rotate = doc.get(page.get("Rotate", 0))
        yield doc.sha256, i, ref.num if ref else None, *map(float, _box(doc, page)), unit, rotate if isinstance(rotate, int) else 0, content, whole


def scan_pages(files: DataFrame) -> DataFrame:
    """Pages in order with inherited boxes (612 x 792 by default), unit (null if unusable) and content."""
    return _scan(files, PAGES, _pages)


FORMS = "doc_id string, num long, content binary, complete boolean"


def _forms(doc: cos.Document) -> Iterator[tuple]:
    for ref, value in sorted(doc.objects.items()):
        if isinstance(value, cos.Stream) and doc.get(value.dict.get("Subtype")) == "Form":
            try:
                yield doc.sha256, ref.num, doc.decoded(value), True
            except (ValueError, TypeError, IndexError):
                yield doc.sha256, ref.num, b"", False


def scan_forms(files: DataFrame) -> DataFrame:
    """Decoded contents of form objects; one that can't be decoded is empty and not `complete`."""
    return _scan(files, FORMS, _forms)


def _operand(value) -> dict:
    number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    return {"num": number, "name": str(value) if isinstance(value, cos.Name) else None, "str": value if isinstance(value, bytes) and not isinstance(value, cos.Operator) else None}


def parse_content(pages: DataFrame) -> DataFrame:
    """One row an instruction of (doc_id, page, content), in order, with operands and byte places.

    `complete` is false for all rows of a page whose content couldn't be read to its end.
    """
    kind = StructType.fromDDL(INSTRUCTIONS)
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, page, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found, whole = cos.instructions(content or b"")
                rows = []
                for seq, x in enumerate(found):
                    flat = [v for o in x.operands for v in (o if isinstance(o, list) else [o])]
                    rows.append((doc_id, page, seq, x.op, [_operand(v) for v in flat], x.start, x.end, whole))
                for i in range(0, len(rows), 2000):
                    yield _batch(rows[i : i + 2000], schema)

    return pages.select("doc_id", "page", "content").mapInArrow(run, kind)


# What inline images may shorten, keys and then values.
INLINE_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
INLINE_VALUES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
INLINE = "doc_id string, page int, seq long, fingerprint string, size long, start long, end long"


def inline_meaning(own: dict) -> dict:
    """An inline image's entries with nothing shortened; names in other places than colour spaces and filters stay."""
    full = lambda v: cos.Name(INLINE_VALUES.get(str(v), str(v))) if isinstance(v, cos.Name) else [full(x) for x in v] if isinstance(v, list) else v
    out = {INLINE_KEYS.get(k, k): v for k, v in own.items()}
    return {k: full(v) if k in ("ColorSpace", "Filter") else v for k, v in out.items() if k not in ("Length", "L")}


def _inline(doc: cos.Document) -> Iterator[tuple]:
    import hashlib

    for i, (_, page) in enumerate(doc.pages()):
        try:
            found, _ = cos.instructions(doc.content(page))
        except (ValueError, TypeError, IndexError):
            continue  # the page's scan says that it can't be read
        for seq, x in enumerate(found):
            if x.op == "BI" and len(x.operands) == 2:
                head = cos.serialise(inline_meaning(x.operands[0]))
                yield doc.sha256, i, seq, hashlib.sha256(len(head).to_bytes(8, "big") + head + x.operands[1]).hexdigest(), len(x.operands[1]), x.start, x.end


def scan_inline_images(files: DataFrame) -> DataFrame:
    """Inline images with a digest of what they mean: equal however their entries are shortened or ordered."""
    return _scan(files, INLINE, _inline)


def scan_failures(files: DataFrame) -> DataFrame:
    """(path, error) of documents that can't be read, or not to their end by some scan: no document,
    damaged or encrypted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    doc = cos.parse(content.as_py() or b"")
                    for each in (_objects, _edges, _pages):
                        for _ in each(doc):
                            pass
                except UNREADABLE as error:
                    rows.append((path, f"{type(error).__name__}: {error}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "error"])

    return files.select("path", "content").mapInArrow(run, FAILURES)


def failure_report(failures: DataFrame, examples: int = FAILURE_EXAMPLES) -> DataFrame:
    """One row: how many failed, and the first of them in order of path."""
    first = failures.orderBy("path").limit(examples).agg(F.array_sort(F.collect_list(F.struct("path", "error"))).alias("examples"))
    return failures.agg(F.count("*").alias("failed")).crossJoin(first)  # one row each


def side_names(spark: SparkSession, path: str) -> DataFrame:
    """(file, source) of a JSON-lines side table; malformed lines are left out."""
    return spark.read.schema("file string, source string").option("mode", "DROPMALFORMED").json(path).where("file IS NOT NULL").dropDuplicates(["file"])


LINES = "page int, line int, text string, confidence double, reviewed boolean, quad array<double>"
GLYPH_LABELS = "glyph string, text string, weight double"


def sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file beside the documents, such as recognised LINES or GLYPH_LABELS.

    Malformed lines, and lines with a value of another kind, are left out.
    """
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def decode(streams: DataFrame, raw: str = "raw", filters: str = "filters") -> DataFrame:
    """`streams` with `decoded`, null where a filter is unsupported or the data are damaged, and `decode_error`."""
    def undo(data, names):
        out = []
        for d, n in zip(data, names):
            try:
                out.append((None if d is None else decode_filters(bytes(d), list(n if n is not None else [])), None))
            except UnsupportedFilter as error:
                out.append((None, f"unsupported filter {error}"))
            except (ValueError, IndexError) as error:
                out.append((None, str(error)))
        return pd.DataFrame(out, columns=["decoded", "decode_error"])

    undone = pandas_udf(undo, StructType.fromDDL("decoded binary, decode_error string"), PandasUDFType.SCALAR)
    return streams.withColumn("_d", undone(raw, filters)).select("*", "_d.decoded", "_d.decode_error").drop("_d")


def rewrite(files: DataFrame, packed: bool = True) -> DataFrame:
    """(path, doc_id, before, content, after): documents written anew, reachable objects only.

    The smaller of the packed and the classic form is taken with `packed`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py() or b""
                try:
                    doc = cos.parse(data)
                    out = min([cos.write(doc, form) for form in ((True, False) if packed else (False,))], key=len)
                except UNREADABLE:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([doc.sha256]), pa.array([len(data)]), pa.array([out], pa.binary()), pa.array([len(out)])], ["path", "doc_id", "before", "content", "after"])

    return files.select("path", "content").mapInArrow(run, "path string, doc_id string, before long, content binary, after long")


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON; an existing folder is refused."""
    df.write.mode("errorifexists").json(path)


def write_samples(samples: DataFrame, manifest: DataFrame, path: str) -> None:
    """Sample payloads as Parquet and their manifest as JSON lines; an existing folder is refused."""
    samples.write.mode("errorifexists").parquet(f"{path}/samples")
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
